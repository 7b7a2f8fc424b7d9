"""What the internet can reach, conditions on requests, and trust between accounts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..adapters import POLICY, derived, duck
from ..functions.text import let
from .policy import kinds, statements

# Ports that shouldn't be open to everyone.
RISKY = {
    20: "FTP data", 21: "FTP", 22: "SSH", 23: "Telnet", 135: "RPC", 139: "NetBIOS", 161: "SNMP", 389: "LDAP", 445: "SMB", 1433: "SQL Server", 1521: "Oracle", 2049: "NFS", 2375: "Docker API", 2376: "Docker API", 2379: "etcd", 3306: "MySQL",
    3389: "RDP", 5432: "PostgreSQL", 5601: "Kibana", 5900: "VNC", 5984: "CouchDB", 5985: "WinRM", 5986: "WinRM", 6379: "Redis", 6443: "Kubernetes API", 7001: "WebLogic", 8086: "InfluxDB", 9092: "Kafka", 9200: "Elasticsearch", 9300: "Elasticsearch",
    10250: "Kubelet", 11211: "Memcached", 27017: "MongoDB",
}
SEVERITIES = ("critical", "high", "medium", "low", "info")
WHOLE = 1 << 32
#: So many ports are more than one service needs.
MANY_PORTS = 1000
WEB = (80, 443)
#: How bad each kind of opening is, worst first.
KINDS = {"every protocol": "critical", "many ports": "high", "known service": "high", "other port": "medium", "ping": "low", "web": "info"}


def port_risk(protocol: Column, low: Column, high: Column) -> Column:
    """(kind, severity, first, last, services) of a protocol and port range that is open to everyone; a missing or negative
    end is the range's whole length. Services are the known ones in the range, by port."""
    proto = F.lower(F.coalesce(protocol, F.lit("-1")))
    first, last = F.when(low > 0, low).otherwise(0), F.when(high >= 0, high).otherwise(65535)
    table = F.array(*(F.struct(F.lit(p).alias("port"), F.lit(n).alias("name")) for p, n in RISKY.items()))
    inside = F.array_sort(F.filter(table, lambda k: k["port"].between(first, last)))
    holds = {
        "every protocol": proto.isin("-1", "all"), "ping": proto.isin("icmp", "1", "icmpv6", "58"), "many ports": last - first >= MANY_PORTS, "known service": F.exists(table, lambda k: k["port"].between(first, last)),
        "web": (first == last) & first.isin(*WEB),
    }
    kind = F.coalesce(*(F.when(test, F.lit(k)) for k, test in holds.items()), F.lit("other port"))
    severity = lambda k: F.element_at(F.create_map(*(F.lit(x) for kv in KINDS.items() for x in kv)), k)
    names = F.array_join(F.transform(inside, lambda k: F.concat_ws(" ", k["port"].cast("string"), k["name"])), ", ")
    ends = lambda k: F.struct(k.alias("kind"), severity(k).alias("severity"), first.cast("bigint").alias("first"), last.cast("bigint").alias("last"), F.when(k == "known service", names).otherwise("").alias("services"))
    return let(kind, ends)


def lowered(severity: Column, steps: Column) -> Column:
    """So many steps down the list, medium to low at the lowest; low and info stay."""
    at = F.array_position(F.array(*map(F.lit, SEVERITIES)), severity).cast("int")
    return F.when(at >= 4, severity).otherwise(F.element_at(F.array(*map(F.lit, SEVERITIES)), F.least(at + steps, F.lit(4))))


def wide(sources: DataFrame) -> DataFrame:
    """Per rule: does it reach everyone, alone or because its ranges add up, or a very broad public range."""
    w = Window.partitionBy("rule").orderBy("lo", "hi")
    before = F.coalesce(F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1))
    new = F.greatest(F.col("hi") - F.greatest(F.col("lo") - 1, before), F.lit(0))
    public = ~((F.col("lo") >= 167772160) & (F.col("hi") <= 184549375))
    each = sources.withColumn("new", new).withColumn("broad", (F.col("hi") - F.col("lo") >= (1 << 24) - 1) & public)
    return each.groupBy("rule").agg((F.sum("new") == WHOLE).alias("open"), F.bool_or("broad").alias("broad"))


def open_groups(rules: DataFrame, sources: DataFrame, used: DataFrame) -> DataFrame:
    """Findings for rules that reach everyone, or only a very broad range: that is a step lower, and so is a group that
    nothing uses; what lets every protocol in drops two steps there."""
    r = rules.join(wide(sources).where("open OR broad"), "rule").join(used.select("grp").distinct().withColumn("in_use", F.lit(True)), "grp", "left")
    r = r.withColumn("risk", port_risk(F.col("protocol"), F.col("from_port"), F.col("to_port")))
    reach = lowered(F.col("risk.severity"), F.when(F.col("open"), 0).otherwise(1))
    idle = F.col("in_use").isNull()
    severity = let(reach, lambda s: lowered(s, F.when(idle & (s == "critical"), 2).when(idle, 1).otherwise(0)))
    return r.select("rule", "grp", severity.alias("severity"), F.when(F.col("open"), "everyone").otherwise("broad range").alias("reach"), "risk.kind", "risk.services")


def severity_counts(findings: DataFrame) -> DataFrame:
    """Every severity has a row, with 0 where nothing was found."""
    zero = findings.sparkSession.createDataFrame([(s,) for s in SEVERITIES], "severity string")
    return F.broadcast(zero).join(findings.groupBy("severity").agg(F.count("*").alias("n")), "severity", "left").select("severity", F.coalesce("n", F.lit(0)).alias("findings"))


def gate(findings: DataFrame, limit: str) -> DataFrame:
    """One row: is there a finding at the limit or above."""
    bad = SEVERITIES[: SEVERITIES.index(limit) + 1]
    return findings.agg(F.coalesce(F.bool_or(F.col("severity").isin(*bad)), F.lit(False)).alias("fails"))


def trust_edges(stmts: DataFrame, inside: list[str]) -> DataFrame:
    """Who a role or resource trusts: public, same organisation, outside account, service or provider."""
    s = kinds(stmts).where("has_principal AND effect = 'Allow'")
    tag = lambda c, t: F.transform(c, lambda x: F.struct(F.lit(t).alias("type"), x.alias("who")))
    e = s.select("policy_id", "kind", F.explode(F.concat(tag(F.col("aws"), "aws"), tag(F.col("services"), "service"), tag(F.col("federated"), "federated"))).alias("p")).select("policy_id", "kind", "p.*")
    account = F.when(F.col("who").rlike(r"^\d{12}$"), F.col("who")).otherwise(F.regexp_extract("who", r"^arn:aws[\w-]*:(?:iam|sts)::(\d{12}):", 1))
    cls = F.when(F.col("type") == "service", "service").when((F.col("type") == "federated") & F.col("who").contains("saml"), "saml").when(F.col("type") == "federated", "oidc").when(F.col("who") == "*", "public").when(account.isin(*inside), "inside").otherwise("outside")
    return e.select("policy_id", "who", cls.alias("class")).distinct()


RULES = "SELECT CAST(s_suppkey AS BIGINT) AS rule, CAST(s_suppkey % 17 AS BIGINT) AS grp, CASE s_suppkey % 6 WHEN 0 THEN '-1' WHEN 1 THEN 'icmp' WHEN 2 THEN 'udp' ELSE 'tcp' END AS protocol, CASE s_suppkey % 7 WHEN 0 THEN 22 WHEN 1 THEN 443 WHEN 2 THEN 0 WHEN 3 THEN 8000 WHEN 4 THEN 20 WHEN 5 THEN 9999 END AS from_port, CASE s_suppkey % 7 WHEN 0 THEN 22 WHEN 1 THEN 443 WHEN 2 THEN 65535 WHEN 3 THEN 8100 WHEN 4 THEN 500 WHEN 5 THEN 9999 END AS to_port FROM $supplier"
SOURCES = "SELECT CAST(s_suppkey AS BIGINT) AS rule, CAST(0 AS BIGINT) AS lo, CASE s_suppkey % 4 WHEN 0 THEN 4294967295 WHEN 1 THEN 2147483647 ELSE 255 END AS hi FROM $supplier UNION ALL SELECT CAST(s_suppkey AS BIGINT), CASE s_suppkey % 3 WHEN 0 THEN 2147483648 ELSE 167772160 END, CASE s_suppkey % 3 WHEN 0 THEN 4294967295 ELSE 184549375 END FROM $supplier"
USED = "SELECT CAST(c_nationkey AS BIGINT) AS grp FROM $customer WHERE c_nationkey < 11"
INSIDE = ["111122223333"]


def _open(spark, sf_dir):
    return open_groups(*(derived(spark, sf_dir, q) for q in (RULES, SOURCES, USED)))


QUERIES = {
    "expo_open_port_risk": lambda spark, sf_dir: derived(spark, sf_dir, RULES).select("rule", port_risk(F.col("protocol"), F.col("from_port"), F.col("to_port")).alias("r")).select("rule", "r.*"),
    "expo_wide_sources": lambda spark, sf_dir: wide(derived(spark, sf_dir, SOURCES)),
    "expo_open_sg": _open,
    "expo_counts": lambda spark, sf_dir: severity_counts(_open(spark, sf_dir)),
    "findings_gate": lambda spark, sf_dir: gate(_open(spark, sf_dir), "high"),
    "trust_edges": lambda spark, sf_dir: trust_edges(statements(derived(spark, sf_dir, POLICY)), INSIDE),
    "trust_principals": lambda spark, sf_dir: trust_edges(statements(derived(spark, sf_dir, POLICY)), INSIDE).groupBy("class").agg(F.count("*").alias("edges"), F.countDistinct("policy_id").alias("policies")),
}
_known = "(VALUES " + ", ".join(f"({p}, '{p} {n}')" for p, n in RISKY.items()) + ") AS k(p, x)"
_R = f"""WITH r AS ({duck(RULES)}), n AS (SELECT *, coalesce(from_port, 0) AS fp, coalesce(to_port, 65535) AS tp FROM r), h AS (SELECT rule, list(x ORDER BY p) AS xs FROM n JOIN {_known} ON p BETWEEN fp AND tp GROUP BY rule),
o AS (SELECT n.*, coalesce(xs, []) AS xs FROM n LEFT JOIN h USING (rule)),
k AS (SELECT rule, grp, fp, tp, CASE WHEN protocol = '-1' THEN 'every protocol' WHEN protocol = 'icmp' THEN 'ping' WHEN tp - fp >= 1000 THEN 'many ports' WHEN len(xs) > 0 THEN 'known service' WHEN fp = tp AND fp IN (80, 443) THEN 'web' ELSE 'other port' END AS kind, array_to_string(xs, ', ') AS names FROM o),
b AS (SELECT *, CASE kind WHEN 'every protocol' THEN 'critical' WHEN 'ping' THEN 'low' WHEN 'web' THEN 'info' WHEN 'other port' THEN 'medium' ELSE 'high' END AS severity, CASE WHEN kind = 'known service' THEN names ELSE '' END AS services FROM k),
s AS ({duck(SOURCES)}), q AS (SELECT *, coalesce(max(hi) OVER (PARTITION BY rule ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS b FROM s), w AS (SELECT rule, sum(greatest(hi - greatest(lo - 1, b), 0)) = 4294967296 AS "open", bool_or(hi - lo >= 16777215 AND NOT (lo >= 167772160 AND hi <= 184549375)) AS broad FROM q GROUP BY rule),
f AS (SELECT b.*, CASE WHEN "open" THEN severity ELSE CASE severity WHEN 'critical' THEN 'high' WHEN 'high' THEN 'medium' WHEN 'medium' THEN 'low' ELSE severity END END AS s1, grp IN (SELECT grp FROM ({duck(USED)})) AS in_use, "open" FROM b JOIN w USING (rule) WHERE "open" OR broad),
z AS (SELECT rule, grp, CASE WHEN in_use THEN s1 ELSE CASE s1 WHEN 'critical' THEN 'medium' WHEN 'high' THEN 'medium' WHEN 'medium' THEN 'low' ELSE s1 END END AS severity, CASE WHEN "open" THEN 'everyone' ELSE 'broad range' END AS reach, kind, services FROM f) """
_TRUST = f"""WITH p AS (SELECT policy_id, unnest(string_split(x, ',')) AS who, t FROM (SELECT policy_id, aws AS x, 'aws' AS t, effect, has_principal FROM ({duck(POLICY)}) UNION ALL SELECT policy_id, services, 'service', effect, has_principal FROM ({duck(POLICY)}) UNION ALL SELECT policy_id, federated, 'federated', effect, has_principal FROM ({duck(POLICY)})) WHERE x IS NOT NULL AND has_principal AND lower(effect) = 'allow'),
e AS (SELECT DISTINCT policy_id, who, CASE WHEN t = 'service' THEN 'service' WHEN t = 'federated' THEN CASE WHEN who LIKE '%saml%' THEN 'saml' ELSE 'oidc' END WHEN who = '*' THEN 'public' WHEN who LIKE '%111122223333%' THEN 'inside' ELSE 'outside' END AS class FROM p) """
ORACLES = {
    "expo_open_port_risk": _R + "SELECT rule, kind, severity, fp AS first, tp AS last, services FROM b",
    "expo_wide_sources": _R + 'SELECT rule, "open", broad FROM w',
    "expo_open_sg": _R + "SELECT * FROM z",
    "expo_counts": _R + "SELECT v.severity, count(z.rule) AS findings FROM (VALUES ('critical'), ('high'), ('medium'), ('low'), ('info')) AS v(severity) LEFT JOIN z USING (severity) GROUP BY v.severity",
    "findings_gate": _R + "SELECT bool_or(severity IN ('critical', 'high')) AS fails FROM z",
    "trust_edges": _TRUST + "SELECT policy_id, who, class FROM e",
    "trust_principals": _TRUST + "SELECT class, count(*) AS edges, count(DISTINCT policy_id) AS policies FROM e GROUP BY class",
}
