"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable
from importlib import resources

from pyspark.sql import DataFrame, SparkSession

from quorbit.llm.conversations import op12
from quorbit.llm.decontamination import op8
from quorbit.llm.language_id import op4
from quorbit.llm.line_dedup import op9
from quorbit.llm.lm_scoring import op7
from quorbit.llm.mixing import op11
from quorbit.llm.pieces import op6
from quorbit.llm.quality_gam import op2
from quorbit.llm.quality_rules import op10
from quorbit.llm.sharding import op5
from quorbit.llm.simhash import op1
from quorbit.llm.url_filter import op3
from quorbit.llm.vector_codes import op13
from quorbit.session import table

Query = Callable[[SparkSession, str], DataFrame]


def _over(operator: Callable[..., DataFrame], *tables: str) -> Query:
    return lambda spark, sf_dir: operator(*(table(spark, sf_dir, t) for t in tables))


def queries() -> dict[str, Query]:
    return {
        "op1_simhash_dedup": _over(op1, "documents"),
        "op2_quality_gam": _over(op2, "documents", "labels"),
        "op4_language_id": _over(op4, "documents"),
        "op6_sentencepiece": _over(op6, "documents"),
        "op3_url_filter": _over(op3, "pages", "labels"),
        "op5_sharding": _over(op5, "documents"),
        "op7_lm_scoring": _over(op7, "documents"),
        "op8_decontamination": _over(op8, "documents", "benchmark"),
        "op9_line_dedup": _over(op9, "documents"),
        "op10_quality_rules": _over(op10, "documents"),
        "op11_source_mixing": _over(op11, "documents"),
        "op12_conversation_repair": _over(op12, "conversations"),
        "op13_vector_codes": _over(op13, "embeddings"),
    }


def oracle_sql() -> dict[str, str]:
    folder = resources.files("quorbit.llm") / "sql"
    return {name: (folder / f"{name}.sql").read_text() for name in queries() if (folder / f"{name}.sql").is_file()}
