"""The registered queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

from gleaner.llm.count import op7_token_counts
from gleaner.llm.encode import op6_byte_bpe
from gleaner.llm.langid import op9_language_id
from gleaner.llm.minhash import ORACLE as NEAR_SQL
from gleaner.llm.minhash import op4_near_dedup
from gleaner.llm.pack import op3_packing
from gleaner.llm.secrets import op1_secret_scan
from gleaner.llm.secrets import oracle as secrets_sql
from gleaner.llm.shard import op2_ring_shards
from gleaner.llm.spotsigs import op8_spotsigs
from gleaner.llm.substring import ORACLE as SUBSTRING_SQL
from gleaner.llm.substring import op5_substring_dedup
from gleaner.llm.topk import ORACLE as TOPK_SQL
from gleaner.llm.topk import op10_exact_topk

QUERIES = {
    "op1_secret_scan": op1_secret_scan,
    "op2_ring_shards": op2_ring_shards,
    "op3_packing": op3_packing,
    "op4_near_dedup": op4_near_dedup,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_byte_bpe": op6_byte_bpe,
    "op7_token_counts": op7_token_counts,
    "op8_spotsigs": op8_spotsigs,
    "op9_language_id": op9_language_id,
    "op10_exact_topk": op10_exact_topk,
}

SQL = {"op1_secret_scan": secrets_sql(), "op5_substring_dedup": SUBSTRING_SQL, "op4_near_dedup": NEAR_SQL, "op10_exact_topk": TOPK_SQL}
