"""All registered queries of the library, and their SQL."""

from ..operators import admin, checks, cost, declared, evaluate, exposure, graph, identity, implied, inventory, leastpriv, network, org, paths, policy, reach, redact, secrets, trail
from ..sources import organization, readers
from ..streaming import trail_streams

_AREAS = (trail, admin, declared, implied, policy, redact, cost, inventory, leastpriv, network, org, exposure, graph, secrets, reach, paths, identity, checks, evaluate, readers, organization, trail_streams)
QUERIES = {k: v for area in _AREAS for k, v in area.QUERIES.items()}
ORACLES = {k: v for area in _AREAS for k, v in area.ORACLES.items()}
