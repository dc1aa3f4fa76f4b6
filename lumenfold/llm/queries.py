"""The operators' registered queries: each over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bpe_count import op7_bpe_count
from .hashing_search import op8_multi_index_hashing
from .hmm import op3_hmm
from .merkle import OP1_SQL, op1_merkle_audit
from .minhash import op2_minhash
from .mixing import op5_mixing
from .multi_index import op4_multi_index
from .packing import op6_packing
from .toxicity import op10_toxicity
from .url_lists import OP9_SQL, op9_url_lists

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_merkle_audit": op1_merkle_audit,
    "op2_minhash": op2_minhash,
    "op3_hmm": op3_hmm,
    "op4_multi_index": op4_multi_index,
    "op5_mixing": op5_mixing,
    "op6_packing": op6_packing,
    "op7_bpe_count": op7_bpe_count,
    "op8_multi_index_hashing": op8_multi_index_hashing,
    "op9_url_lists": op9_url_lists,
    "op10_toxicity": op10_toxicity,
}

#: Only operators that SQL can express; the others are tested against brute force.
ORACLE: dict[str, str] = {
    "op1_merkle_audit": OP1_SQL,
    "op9_url_lists": OP9_SQL,
}
