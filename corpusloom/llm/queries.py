"""The queries of this subpackage and, where SQL expresses them, the same in DuckDB SQL."""

from __future__ import annotations

from corpusloom.llm.bpe import op9_bpe_round_trip
from corpusloom.llm.divergence import OP11_SQL, op11_source_divergence
from corpusloom.llm.fingerprint import op6_fingerprint
from corpusloom.llm.licenses import op7_license_scan
from corpusloom.llm.near_dedup import OP1_SQL, op1_minhash_near_dedup
from corpusloom.llm.packing import op3_packing
from corpusloom.llm.panes import OP12_SQL, op12_pane_revisions
from corpusloom.llm.partenum import OP13_SQL, op13_jaccard_join
from corpusloom.llm.quality import op8_quality
from corpusloom.llm.sharding import FINE_BYTES, op4_sharding, shard_sql, sharding_fine
from corpusloom.llm.substring_dedup import OP5_SQL, op5_substring_dedup
from corpusloom.llm.topk import OP10_SQL, op10_top_k
from corpusloom.llm.url_filter import OP2_SQL, op2_url_filter

QUERIES = {
    f.__name__: f
    for f in (op1_minhash_near_dedup, op2_url_filter, op3_packing, op4_sharding, op5_substring_dedup, op6_fingerprint, op7_license_scan, op8_quality, op9_bpe_round_trip, op10_top_k, op11_source_divergence, op12_pane_revisions, op13_jaccard_join, sharding_fine)
}
#: The others need a trained model, a tokenizer or Spark's own hash; tests compare those with brute force.
ORACLE_SQL = {
    "op1_minhash_near_dedup": OP1_SQL, "op2_url_filter": OP2_SQL, "op4_sharding": shard_sql(), "op5_substring_dedup": OP5_SQL, "op10_top_k": OP10_SQL,
    "op11_source_divergence": OP11_SQL, "op12_pane_revisions": OP12_SQL, "op13_jaccard_join": OP13_SQL,
    "sharding_fine": shard_sql(FINE_BYTES),
}
