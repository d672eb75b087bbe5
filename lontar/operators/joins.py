"""Joins beyond the plain one: referential, drift, range, floor, alias chains, nearest vectors, ambiguous matches."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lontar.operators.windows import carry, top_n
from lontar.util import ship


def missing(child: DataFrame, parent: DataFrame, keys: list[str]) -> DataFrame:
    return child.join(parent.select(*keys).distinct(), keys, "left_anti")


def strict_join(child: DataFrame, parent: DataFrame, keys: list[str], what: str) -> DataFrame:
    """Inner join that fails the job on the first child without a parent."""
    j = child.join(parent.withColumn("_hit", F.lit(True)), keys, "left")
    return j.withColumn("_hit", F.when(F.col("_hit").isNull(), F.raise_error(F.concat(F.lit(f"{what}: no parent for "), F.to_json(F.struct(*keys))))).otherwise(True)).where("_hit").drop("_hit")


def drift(old: DataFrame, new: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, state): missing, unexpected or changed rows of two keyed snapshots; equal ones are left out."""
    a, b = old.select(*keys, F.col(value).alias("_a"), F.lit(1).alias("_in_a")), new.select(*keys, F.col(value).alias("_b"), F.lit(1).alias("_in_b"))
    state = F.when(F.col("_in_b").isNull(), "missing").when(F.col("_in_a").isNull(), "unexpected").when(~F.col("_a").eqNullSafe(F.col("_b")), "changed")
    return a.join(b, keys, "full_outer").select(*keys, state.alias("state")).where("state IS NOT NULL")


def expand(df: DataFrame, first: str, last: str, name: str) -> DataFrame:
    """One row per number of an inclusive range; inverted and null ranges give none."""
    return df.where(F.col(first) <= F.col(last)).withColumn(name, F.explode(F.sequence(first, last)))


def floor_lookup(points: DataFrame, at: str, spans: DataFrame, start: str, value: str, keys: list[str], bucket) -> DataFrame:
    """Adds the value of the span with the largest start <= the point, per key.

    Points and span starts are united and sorted by key and bucket(position); see carry(). No point meets all spans.
    """
    p = points.select("*", F.col(at).alias("_at"), F.lit(1).alias("_kind"), F.lit(None).cast(spans.schema[value].dataType).alias(value))
    s = spans.select(*keys, F.col(start).alias("_at"), F.lit(0).alias("_kind"), F.col(value))
    u = p.unionByName(s, allowMissingColumns=True)
    return carry(u, keys, ["_at", "_kind"], bucket(F.col("_at")), F.col(value), value).where("_kind = 1").drop("_at", "_kind")


def first_of(queries: DataFrame, key: str, rules: list[tuple[str, Column, DataFrame]]) -> DataFrame:
    """(key, rule, target): the first rule whose table (name, target) has the rule's form of the query."""
    out = queries
    for i, (_, form, names) in enumerate(rules):
        n = names.groupBy("name").agg(F.min("target").alias(f"_t{i}"))
        out = out.withColumn(f"_f{i}", form).join(n, F.col(f"_f{i}") == n["name"], "left").drop("name", f"_f{i}")
    rule = F.coalesce(*[F.when(F.col(f"_t{i}").isNotNull(), r) for i, (r, _, _) in enumerate(rules)])
    return out.select(key, rule.alias("rule"), F.coalesce(*[F.col(f"_t{i}") for i in range(len(rules))]).alias("target"))


def resolve(pairs: DataFrame, key: str, candidate: str) -> DataFrame:
    """(key, n, resolution, match): none, match, or ambiguous, which is no match. pairs may hold null candidates."""
    g = pairs.groupBy(key).agg(F.countDistinct(candidate).alias("n"), F.min(candidate).alias("_m"))
    return g.select(key, "n", F.when(F.col("n") == 0, "none").when(F.col("n") == 1, "match").otherwise("ambiguous").alias("resolution"), F.when(F.col("n") == 1, F.col("_m")).alias("match"))


MAX_BLOCK_CELLS = 4_000_000


def _block_top(block, k: int):
    """Arrow batches of (b_id, b_vec) to the task's own k best rows for each query of a block."""

    def run(batches):
        ids, matrix = block.value
        best_score, best_id = np.full((len(ids), 0), -np.inf), np.zeros((len(ids), 0), np.int64)
        for batch in batches:
            b = batch.column(0).to_numpy(zero_copy_only=False)
            v = np.array([x for x in batch.column(1).to_pylist()], np.float64)
            if not len(b):
                continue
            for i in range(0, len(b), 1024):  # scores of 1,024 rows at a time
                # rounded, so that equal vectors tie whatever the order of the sums
                score = np.concatenate([best_score, np.round(matrix @ v[i : i + 1024].T, 12)], axis=1)
                row = np.concatenate([best_id, np.broadcast_to(b[i : i + 1024], (len(ids), len(b[i : i + 1024])))], axis=1)
                order = np.lexsort((row, -score), axis=1)[:, :k]
                best_score, best_id = np.take_along_axis(score, order, 1), np.take_along_axis(row, order, 1)
        n = best_id.shape[1]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, n)), pa.array(best_id.reshape(-1)), pa.array(best_score.reshape(-1))], ["q_id", "b_id", "score"])

    return run


def nearest(queries: DataFrame, base: DataFrame, k: int, max_cells: int = MAX_BLOCK_CELLS) -> DataFrame:
    """(q_id, b_id, score, rank): the k rows of base with the greatest dot product for each query; ties by id.

    queries(q_id, q_vec) are a stated set against all rows of base(b_id, b_vec). They are cut into blocks of ids whose
    vectors, and whose k best of a task, hold at most max_cells numbers; a block is one broadcast matrix, and each task
    multiplies its Arrow batches of the base with it and passes on its own k best per query. Null ids and vectors, and
    those of another length than the queries, take no part.
    """
    q = queries.where("q_id IS NOT NULL AND q_vec IS NOT NULL").select("q_id", "q_vec")
    size = q.agg(F.count("*").alias("n"), F.max(F.size("q_vec")).alias("d")).first()
    spark, out = queries.sparkSession, None
    dim = size.d or 0
    q = q.where(F.size("q_vec") == dim)
    parts = max(1, math.ceil(size.n * max(dim, 2 * k) / max_cells))
    rows = base.where(F.col("b_id").isNotNull() & (F.size("b_vec") == dim) & ~F.exists("b_vec", lambda x: x.isNull())).select(F.col("b_id").cast("bigint"), F.col("b_vec").cast("array<double>"))
    for i in range(parts):
        own = sorted(q.where(F.pmod(F.xxhash64("q_id"), F.lit(parts)) == i).collect())
        block = spark.sparkContext.broadcast((np.array([r.q_id for r in own], np.int64), np.array([r.q_vec for r in own], np.float64).reshape(len(own), dim)))
        found = rows.mapInArrow(_block_top(block, k), "q_id bigint, b_id bigint, score double")
        out = found if out is None else out.unionByName(found)
    return top_n(out, ["q_id"], [F.col("score").desc(), F.col("b_id")], k).select("q_id", "b_id", "score", "rank")


ship(__name__)
