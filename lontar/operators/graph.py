"""Graphs of citations: bridges, weighted bonds, nodes and edges, related rows, a small layout."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lontar.operators.pairs import pair_counts


def bridges(citations: DataFrame, node: str, group: str) -> DataFrame:
    """(node, group, bridge): for each citation the other groups that cite the same node, sorted."""
    pairs = citations.select(node, group).distinct()
    all_ = pairs.groupBy(node).agg(F.collect_set(group).alias("_g"))
    return pairs.join(all_, node).select(node, group, F.sort_array(F.array_except("_g", F.array(group))).alias("bridge"))


def bonds(citations: DataFrame, node: str, group: str) -> DataFrame:
    """(a, b, n): how many nodes two groups both cite, a < b. Nodes that many groups cite are done in chunks of groups."""
    return pair_counts(citations.select(node, group).distinct().groupBy(node).agg(F.collect_set(group).alias("items")))


def nodes(citations: DataFrame, node: str, group: str) -> DataFrame:
    """(node, span, degree): how many groups cite it and how often."""
    return citations.groupBy(node).agg(F.countDistinct(group).alias("span"), F.count("*").alias("degree"))


def edges(citations: DataFrame, node: str, middle: str, group: str) -> DataFrame:
    """(kind, source, target, n): node cited_in middle, middle in_category group; a null middle links the node to the group."""
    cited = citations.groupBy(F.col(node).alias("source"), F.coalesce(middle, group).alias("target")).agg(F.count("*").alias("n")).withColumn("kind", F.lit("cited_in"))
    inside = citations.where(F.col(middle).isNotNull()).groupBy(F.col(middle).alias("source"), F.col(group).alias("target")).agg(F.count("*").alias("n")).withColumn("kind", F.lit("in_category"))
    return cited.unionByName(inside).select("kind", "source", "target", "n")


def inconsistent(df: DataFrame, node: str, attributes: list[str]) -> DataFrame:
    """Nodes that carry different values of an attribute in different places."""
    g = df.groupBy(node).agg(*[F.countDistinct(a).alias(a) for a in attributes])
    return g.select(node, F.explode(F.array(*[F.struct(F.lit(a).alias("attribute"), F.col(a).alias("n")) for a in attributes])).alias("x")).where("x.n > 1").select(node, "x.attribute", "x.n")


def valid_edges(df: DataFrame, predicates: list[str], text: str, span: str) -> DataFrame:
    """Proposed edges with a known predicate, evidence that stands in the text word for word, and a confidence from 0 to 1."""
    return df.where(F.col("predicate").isin(*predicates) & (F.length(span) > 0) & F.contains(F.col(text), F.col(span)) & F.col("confidence").between(0, 1))


def sphere(n: int, radius: float = 1000.0) -> np.ndarray:
    """Seed positions on a sphere at the golden angle."""
    i = np.arange(n)
    z = 1 - 2 * (i + 0.5) / max(1, n)
    r, a = np.sqrt(np.maximum(0, 1 - z * z)), i * math.pi * (3 - math.sqrt(5))
    return radius * np.stack([r * np.cos(a), r * np.sin(a), z], axis=1)


def layout(weights: np.ndarray, links: list[tuple[int, int, float]], ticks: int = 400, radius: float = 1000.0) -> np.ndarray:
    """A deterministic force layout of a small node set, on the driver: repulsion by weight, springs, then centred, scaled to the radius and rounded."""
    p, speed = sphere(len(weights), radius), np.zeros((len(weights), 3))
    if not len(weights):
        return p
    alpha, decay = 1.0, 1 - 0.001 ** (1 / 300)
    for _ in range(ticks):
        alpha += (0 - alpha) * decay
        d = p[:, None, :] - p[None, :, :]
        q = np.maximum((d * d).sum(axis=2), 1.0)
        np.fill_diagonal(q, np.inf)
        speed += alpha * (d * (weights[None, :] / q)[:, :, None]).sum(axis=1)
        for a, b, length in links:
            v = p[b] - p[a]
            n = max(float(np.linalg.norm(v)), 1e-6)
            pull = alpha * 0.9 * (n - length) / n * v / 2
            speed[a] += pull
            speed[b] -= pull
        speed *= 0.6
        p = p + speed
    p = p - p.mean(axis=0)
    return np.rint(p * radius / max(float(np.linalg.norm(p, axis=1).max()), 1e-9))
