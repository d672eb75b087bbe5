"""Nested shards and orphan references: cases and edges."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from lontar.operators import nested, orphans

SHARD = "shard_id bigint, slug string, category string, published_at timestamp_ntz, subtopics array<struct<subtopic:string,entries:array<struct<text:string,ref:string,refs:array<struct<surah:int,ayah:int,resolvable:boolean,bridge:array<string>>>>>>>, raw_json string"
T = dt.datetime


def ref(s, a, bridge=None):
    return (s, a, True, bridge)


def shards(spark, rows):
    """rows of (shard_id, subtopics, raw)"""
    return spark.createDataFrame([(i, "s", "S", T(2024, 5, 1), t, r) for i, t, r in rows], SHARD)


def leaf(spark, *rows):
    return sorted(tuple(r) for r in nested.leaves(shards(spark, rows)).collect())


def test_typed_leaves(spark):
    tree = [("a", [("t", "r", [ref(1, 2, ["x", "x"]), ref(None, None, []), ref(3, 4)]), ("t", None, None)]), (None, []), ("c", None)]
    want = [(1, 0, 0, 0, 0), (1, 0, 0, 0, 1), (1, 0, 0, 1, -1), (1, 0, 0, 2, -1), (1, 0, 1, -1, -1), (1, 1, -1, -1, -1), (1, 2, -1, -1, -1), (2, -1, -1, -1, -1), (3, -1, -1, -1, -1)]
    assert leaf(spark, (1, tree, None), (1, tree, None), (2, [], None), (3, None, None)) == want


def test_raw_leaves(spark):
    raw = {"subtopics": {"entries": [{"refs": {"surah": "1", "ayah": 2.0, "bridge": "q"}}, {"refs": [{"bridge": ["a", None]}, "odd"], "x": 1}, None]}}
    want = [(1, 0, 0, 0, 0), (1, 0, 1, 0, 0), (1, 0, 1, 0, 1), (1, 0, 1, 1, -1), (1, 0, 2, -1, -1), (2, -1, -1, -1, -1), (3, -1, -1, -1, -1), (4, -1, -1, -1, -1), (5, -1, -1, -1, -1)]
    assert leaf(spark, (1, None, json.dumps(raw)), (2, None, '{"subtopics": [{"a"'), (3, None, "[1]"), (4, None, ""), (5, None, "[" * 100_000)) == want


@pytest.mark.parametrize(
    "value, letter, number",
    [(3, "w", 3), ("3", "q", 3), (" -4 ", "q", -4), (None, "a", None), ("x", "x", None), (True, "x", None), (2.0, "w", 2), (2.5, "x", None), (2**40, "x", None), (float("nan"), "x", None), ([1], "x", None), ("٣", "x", None)],
)
def test_letters_of_numbers(value, letter, number):
    assert nested.Parser().number(value) == (letter, number)


def test_variants_and_tables(spark):
    refs = [{"surah": "1", "ayah": 2}, {"surah": 1}, {"surah": 1, "ayah": 2, "resolvable": "true"}, {"surah": 1, "ayah": 2, "note": [1]}, {"surah": "eins", "ayah": 2}, 7]
    raw = json.dumps({"subtopics": [{"subtopic": "u", "entries": [{"text": "t", "ref": "r", "refs": refs}, {"text": "t", "ref": "r", "refs": {"surah": 1, "ayah": 2}}, {"ref": "r", "refs": refs[:1]}]}, {"subtopic": "v", "entries": {"text": "t", "ref": "r", "refs": {"surah": 1, "ayah": 2}}}, 5]})
    typed = [(None, [("t", None, [ref(1, None)])]), ("v", [("t", "r", [ref(1, 2)])]), ("w", None)]
    df = shards(spark, [(1, typed, None), (2, None, raw), (3, None, "[1]"), (4, [], None)])
    df = df.withColumn("variant", F.lit(9)).withColumn("tree", F.lit(9)).withColumn("e", F.lit(1)).withColumn("state", F.lit(1)).withColumn("children", F.lit(1))
    t = nested.typed_tables(df, ("slug",))
    n = {level: {v: x.count() for v, x in t.tables(level).items() if x.count()} for level in nested.SUBTYPES}
    assert n["shards"] == {"mixed": 2, "broken": 1, "childless": 1}
    assert n["subtopics"] == {"untitled": 1, "full": 2, "childless": 1, "mixed": 1, "alien": 1}
    assert n["entries"] == {"full": 3, "partial": 2, "mixed": 1}
    assert n["refs"] == {"plain": 3, "quoted": 3, "partial": 2, "extended": 1, "alien": 2}
    assert t.table("subtopics", "untitled").columns == ["shard_id", "subtopic_no", "state", "children"]
    assert [r.extra for r in t.table("refs", "alien").orderBy("ref_no").collect()] == ['{"surah": "eins"}', "7"] and t.table("refs", "extended").first().extra == '{"note": [1]}'
    # equal shapes have equal states, whichever way they came: but a lone value is not a list
    full = {(r.shard_id, r.entry_no): r.state for r in t.table("entries", "full").collect()}
    assert len(full) == 3 and len(set(full.values())) == 2 and nested.leaves(df.limit(0)).count() == 0
    again = nested.typed_tables(shards(spark, [(7, None, json.dumps({"subtopics": [{"subtopic": "x", "entries": [{"text": "o", "ref": "o", "refs": [{"surah": 9, "ayah": 9, "resolvable": False}]}]}]})), (8, typed[1:2], None)]), ())
    states = [r.state for r in again.table("entries", "full").collect()]
    assert len(states) == 2 and states[0] == states[1]
    flat = nested.flat_tables(df, ("slug",))
    assert {k: v.count() for k, v in flat.items()} == {"shards": 4, "subtopics": 6, "entries": 6, "refs": 11, "bridges": 0}


META = "n int, ayahs int, added_at timestamp_ntz, removed_at timestamp_ntz, surah string, seg string"
REFS = "shard_id bigint, surah int, ayah int, published_at timestamp_ntz, n int, is_parent int"


def test_orphans(spark, monkeypatch):
    meta = [(1, 7, T(2022, 1, 1), None, "", ""), (2, 5, T(2022, 1, 1), T(2024, 1, 1), "", ""), (2, 3, T(2024, 1, 1), None, "", ""), (3, 9, T(2025, 1, 1), None, "", ""), (4, 0, T(2022, 1, 1), None, "", ""), (None, 5, T(2022, 1, 1), None, "", ""), (5, 5, None, None, "", ""), (1, 7, T(2022, 1, 1), None, "", "")]
    refs = [
        (1, 1, 7, T(2023, 1, 1)), (2, 1, 8, T(2023, 1, 1)), (3, 1, 0, T(2023, 1, 1)), (4, 1, 7, T(2021, 1, 1)), (5, 2, 5, T(2023, 12, 31)), (6, 2, 5, T(2024, 1, 1)), (7, 2, 3, T(2024, 1, 1)), (8, 3, 1, T(2024, 6, 1)),
        (9, 3, 1, T(2025, 1, 1)), (10, 4, 1, T(2023, 1, 1)), (11, 5, 1, T(2023, 1, 1)), (12, 9, 9, T(2023, 1, 1)), (13, None, 1, T(2023, 1, 1)), (14, 1, None, T(2023, 1, 1)), (15, 1, 7, None), (16, 2, 5, T(2022, 1, 1)),
    ]
    m, r = spark.createDataFrame(meta, META), spark.createDataFrame([(*x, 1, 1) for x in refs], REFS)
    want = [2, 3, 4, 6, 8, 10, 11, 12, 15]
    for most in (512, 1):
        monkeypatch.setattr(orphans, "MAX_MOMENTS", most)
        assert sorted(x.shard_id for x in orphans.orphan_references(r, m).collect()) == want
    counts = {x.period: (x.orphans, x.orphan_keys) for x in orphans.orphan_counts(r, m).collect()}
    assert counts["2023-01"] == (5, 5) and counts["2024-01"] == (1, 1) and sum(a for a, _ in counts.values()) == len(want)
    assert orphans.orphan_references(r, m).columns == r.columns
    assert sorted(x.shard_id for x in orphans.orphan_references(r, m.limit(0)).collect()) == [i for i in range(1, 17) if i not in (13, 14)]
    assert orphans.orphan_counts(r.limit(0), m).count() == 0


def test_hot_reference(spark):
    m = spark.createDataFrame([(1, 7, T(2022, 1, 1), None, "", "")], META)
    r = spark.range(50_000).select(F.col("id").alias("shard_id"), F.lit(2).alias("surah"), F.lit(7).alias("ayah"), F.lit(T(2023, 1, 1)).cast("timestamp_ntz").alias("published_at"))
    assert orphans.orphan_references(r, m).count() == 50_000
