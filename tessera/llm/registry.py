"""The queries of the corpus operators, one for each, and the SQL of those it can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm.ann import OP5_SQL, op5_nearest_neighbours
from tessera.llm.chatfmt import OP4_SQL, op4_chat_formatting
from tessera.llm.decontam import op2_benchmark_decontamination
from tessera.llm.htmlblocks import op7_html_extraction
from tessera.llm.langid import op9_language_id
from tessera.llm.linededup import op10_substring_dedup
from tessera.llm.mixing import op6_source_mixing
from tessera.llm.secrets import op1_secret_scan
from tessera.llm.sharding import op3_sharding
from tessera.llm.simhash import op8_simhash_near_dedup

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    ops = (
        op1_secret_scan, op2_benchmark_decontamination, op3_sharding, op4_chat_formatting, op5_nearest_neighbours,
        op6_source_mixing, op7_html_extraction, op8_simhash_near_dedup, op9_language_id, op10_substring_dedup,
    )
    return {f.__name__: f for f in ops}


def oracle_sql() -> dict[str, str]:
    return {"op4_chat_formatting": OP4_SQL, "op5_nearest_neighbours": OP5_SQL}
