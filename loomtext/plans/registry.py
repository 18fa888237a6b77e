"""All queries of the reference's own operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomtext.plans import admission, cleaning, contracts, corpus_profile, judging, ledger, package, registers, retrieval, sources, style, works

MODULES = (corpus_profile, sources, cleaning, style, works, retrieval, registers, admission, judging, ledger, contracts, package)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in m.ORACLES.items()}
