"""Operations of a training-data pipeline. Nothing else in the library imports this subpackage."""

from .alignment import op11_alignment
from .decontaminate import ORACLE as _O7
from .decontaminate import op7_decontamination
from .hmm_scoring import op8_lm_scoring
from .html_extract import op4_html_extraction
from .ngram_join import ORACLE as _O1
from .ngram_join import op1_ngram_join
from .packing import op5_packing
from .quality_classifier import op13_quality_classifier
from .quality_rules import ORACLE as _O10
from .quality_rules import op10_quality_rules
from .secret_scan import op9_secret_scan
from .sharding import ORACLE as _O3
from .sharding import op3_sharding
from .suffix_dedup import op2_suffix_dedup
from .token_files import op6_token_files
from .whitening import op12_embedding_whitening

_OPERATORS = (
    op1_ngram_join, op2_suffix_dedup, op3_sharding, op4_html_extraction, op5_packing, op6_token_files, op7_decontamination, op8_lm_scoring, op9_secret_scan, op10_quality_rules,
    op11_alignment, op12_embedding_whitening, op13_quality_classifier,
)
QUERIES = {f.__name__: f for f in _OPERATORS}
ORACLES = {"op1_ngram_join": _O1, "op3_sharding": _O3, "op7_decontamination": _O7, "op10_quality_rules": _O10}
