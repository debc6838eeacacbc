"""The operators' queries, and oracle SQL where SQL can express them."""

from __future__ import annotations

from .decontamination import OP7_SQL, op7_decontamination
from .embeddings import OP9_SQL, op9_inverted_multi_index
from .extraction import op5_html_extraction
from .jaccard import OP6_SQL, op6_jaccard_join
from .mixing import op10_mixing
from .quality import op2_quality_classifier
from .secrets import OP8_SQL, op8_blob_ledger
from .sharding import op4_feistel_sharding
from .substrings import OP3_SQL, op3_radix_suffixes
from .warc import OP1_SQL, op1_warc

QUERIES = {
    "op1_warc": op1_warc,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_radix_suffixes": op3_radix_suffixes,
    "op4_feistel_sharding": op4_feistel_sharding,
    "op5_html_extraction": op5_html_extraction,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_decontamination": op7_decontamination,
    "op8_blob_ledger": op8_blob_ledger,
    "op9_inverted_multi_index": op9_inverted_multi_index,
    "op10_mixing": op10_mixing,
}

ORACLES: dict[str, str] = {
    "op1_warc": OP1_SQL,
    "op3_radix_suffixes": OP3_SQL,
    "op6_jaccard_join": OP6_SQL,
    "op7_decontamination": OP7_SQL,
    "op8_blob_ledger": OP8_SQL,
    "op9_inverted_multi_index": OP9_SQL,
}
