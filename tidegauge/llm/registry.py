"""Queries of this subpackage by name, and DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidegauge.llm.bpe import op10_bpe
from tidegauge.llm.chat import OP12_SQL, op12_chat
from tidegauge.llm.clustering import OP13_SQL, op13_clustering
from tidegauge.llm.decontaminate import OP3_SQL, op3_decontaminate
from tidegauge.llm.importance import op7_importance
from tidegauge.llm.language import op6_language
from tidegauge.llm.line_dedup import OP9_SQL, op9_line_dedup
from tidegauge.llm.quality_rules import op8_quality_rules
from tidegauge.llm.simhash import op1_simhash
from tidegauge.llm.substrings import op4_substrings
from tidegauge.llm.token_store import op2_token_store
from tidegauge.llm.url_filter import OP5_SQL, op5_url_filter
from tidegauge.llm.whitening import op11_whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_token_store": op2_token_store,
    "op3_decontaminate": op3_decontaminate,
    "op4_substrings": op4_substrings,
    "op5_url_filter": op5_url_filter,
    "op6_language": op6_language,
    "op7_importance": op7_importance,
    "op8_quality_rules": op8_quality_rules,
    "op9_line_dedup": op9_line_dedup,
    "op10_bpe": op10_bpe,
    "op11_whitening": op11_whitening,
    "op12_chat": op12_chat,
    "op13_clustering": op13_clustering,
}

ORACLES: dict[str, str] = {
    "op3_decontaminate": OP3_SQL,
    "op5_url_filter": OP5_SQL,
    "op9_line_dedup": OP9_SQL,
    "op12_chat": OP12_SQL,
    "op13_clustering": OP13_SQL,
}
