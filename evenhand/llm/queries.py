"""Queries of the training-data operators and, where SQL can say it, their DuckDB twins."""

from __future__ import annotations

import corpus_pipeline

from evenhand.llm.decontam import OP10_SQL, op10_decontam
from evenhand.llm.extendible_shards import OP3_SQL, op3_extendible_shards
from evenhand.llm.line_dedup import OP6_SQL, op6_line_dedup
from evenhand.llm.metric_join import OP4_SQL, op4_metric_join
from evenhand.llm.minhash_dedup import op1_minhash_dedup
from evenhand.llm.mixing import OP5_SQL, op5_mixing
from evenhand.llm.quality import op9_quality
from evenhand.llm.suffix_dedup import op7_suffix_dedup
from evenhand.llm.token_store import op2_token_store
from evenhand.llm.warc import OP8_SQL, op8_warc

QUERIES = {
    "op1_minhash_dedup": op1_minhash_dedup,
    "op2_token_store": op2_token_store,
    "op3_extendible_shards": op3_extendible_shards,
    "op4_metric_join": op4_metric_join,
    "op5_mixing": op5_mixing,
    "op6_line_dedup": op6_line_dedup,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_warc": op8_warc,
    "op9_quality": op9_quality,
    "op10_decontam": op10_decontam,
    "pipeline": corpus_pipeline.run,
}
ORACLE_SQL: dict[str, str] = {
    "op3_extendible_shards": OP3_SQL,
    "op4_metric_join": OP4_SQL,
    "op5_mixing": OP5_SQL,
    "op6_line_dedup": OP6_SQL,
    "op8_warc": OP8_SQL,
    "op10_decontam": OP10_SQL,
}
