"""The queries of the operators, and their SQL where SQL can express them."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from typeweave.llm import byte_bpe, chat_format, gif_media, language_id, learned_ann, licence_scan, ngram_jaccard, packing, substring_dedup, warc
from typeweave.llm.common import ship

MODULES = (byte_bpe, chat_format, gif_media, language_id, learned_ann, licence_scan, ngram_jaccard, packing, substring_dedup, warc)

def _shipped(query):
    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run

def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    for module in MODULES:
        found.update({name: _shipped(query) for name, query in module.QUERIES.items()})
    return found

def oracle_sql() -> dict[str, str]:
    found: dict[str, str] = {}
    for module in MODULES:
        found.update(getattr(module, "ORACLES", {}))
    return found
