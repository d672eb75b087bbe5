"""Registered queries of the core and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lontar.plans import evaluation, misc, nested, quality, relational, search, sources, text

MODULES = (nested, text, relational, search, quality, misc, evaluation, sources)

#: Columns whose SQL result has another width than Spark's.
WIDTHS = {
    "text_normalize_digest": {"n_bytes": "INTEGER"},
    "token_sets": dict.fromkeys(("space_words", "all_words", "tokens", "letter_words"), "INTEGER"),
    "ref_extract": {"n": "INTEGER", "others": "INTEGER"},
    "marker_codec": {"rest": "INTEGER"},
    "markup_clean": {"n": "INTEGER"},
    "bounded_strings": {"n40": "INTEGER", "n_bytes": "INTEGER"},
    "sentence_counts": {"sentences": "INTEGER"},
    "primary_companion": {"n_primary": "INTEGER", "n_companion": "INTEGER"},
    "group_batches": {"batch": "BIGINT"},
    "inverted_index": {"n_slugs": "INTEGER"},
    "vector_keys": {"n": "INTEGER"},
    "guard_violations": {"safe": "INTEGER"},
    "sentence_attribution": {"unbacked": "INTEGER"},
    "daily_pick": {"pick": "INTEGER"},
    "collocation_words": {"masked": "INTEGER"},
    "synonym_words": {"n": "INTEGER"},
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    out = {k: s for m in MODULES for k, s in m.SQL.items()}
    for k, columns in WIDTHS.items():
        casts = ", ".join(f"CAST({c} AS {w}) AS {c}" for c, w in columns.items())
        out[k] = f"SELECT * REPLACE ({casts}) FROM ({out[k]})"
    return out
