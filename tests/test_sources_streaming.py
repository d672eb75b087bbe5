"""Readers, sinks and keyed state on small files and streams."""

import datetime as dt
import json
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from lontar import plans
from lontar.sources import readers as R
from lontar.sources import sinks as K
from lontar.streaming import state as S


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_pins(spark, tmp_path):
    write(tmp_path / "d/a.txt", "satu")
    write(tmp_path / "d/e/b.txt", "dua")
    lock = spark.createDataFrame(R.inventory(spark, str(tmp_path / "d")).collect())
    assert R.load_pinned(spark, str(tmp_path / "d"), lock).count() == 2
    write(tmp_path / "d/a.txt", "lain")
    write(tmp_path / "d/c.txt", "tiga")
    with pytest.raises(R.SourceError) as e:
        R.load_pinned(spark, str(tmp_path / "d"), lock)
    assert "changed" in str(e.value) and "unexpected" in str(e.value)
    assert R.load_pinned(spark, str(tmp_path / "d"), R.repin(spark, str(tmp_path / "d"))).count() == 3
    many = spark.createDataFrame([(f"file:/none/{i}", "0") for i in range(101)], "path string, sha256 string")
    with pytest.raises(R.SourceError) as e:
        R.load_pinned(spark, str(tmp_path / "d"), many)
    assert str(e.value).count("missing") == 101 and str(e.value).count("unexpected") == 3
    with pytest.raises(R.SourceError):
        R.by_id(R.registry(spark, [{"id": "x"}]), "y")


def test_pipe_text(spark, tmp_path):
    good, bad = R.pipe_text(spark, write(tmp_path / "p.txt", "# c\n\n1|1|satu|dua\n1|x|y\n2|3\n2|1|\n2|2|dua"))
    assert sorted(map(tuple, good.collect())) == [(1, 1, "satu|dua"), (2, 2, "dua")]
    assert sorted(r.line_no for r in bad.collect()) == [4, 5, 6]


def test_tags(spark, tmp_path):
    t = R.tags(spark, write(tmp_path / "x.xml", '<q><sura index="1" name="A" type="m"/><sura index="x" name="B" type="m"/>\n<sura index="3" type="z" name="C"/><sura name="D" type="m"/></q>'), "sura")
    good, bad = R.checked_tags(t, ["index"], {"type": ["m", "n"]}, ["name"])
    assert [(r["index"], r.name) for r in good.collect()] == [(1, "A")]
    assert {r.pos: r.reason for r in bad.collect()} == {1: "bad index", 2: "bad type", 3: "missing index"}
    m = spark.createDataFrame([("f", 0, 1), ("f", 1, 3)], "path string, pos int, index int")
    assert {tuple(r) for r in R.milestones(m, "index", 3).collect()} == {(1, 3), (3, 2)}


def test_json(spark, tmp_path):
    good, bad = R.json_records(spark, write(tmp_path / "l.jsonl", '{"a": 1}\n{"a": 2}\n{"a": '), "a int")
    assert sorted(r.a for r in good.collect()) == [1, 2] and bad.count() == 1
    many, none = R.json_records(spark, write(tmp_path / "a.json", '[\n{"a": 1, "b": [1]},\n{"a": 2}]'), "a int, b array<int>", multi_line=True)
    assert sorted(r.a for r in many.collect()) == [1, 2] and none.count() == 0
    b = spark.createDataFrame([(1, '[{"ayah": 1, "text": "x"}, {"surah": 5, "ayah": 2, "text": " "}]'), (2, '{"no": 1}')], "surah int, payload string")
    assert [tuple(r) for r in R.nested_bundle(b).collect()] == [(1, 1, "x")]
    d = spark.createDataFrame([(1, json.dumps({"data": {"verses": [{"verseNumber": 4, "translations": {"id": "y"}}, {"verseNumber": 5, "translations": {}}]}})), (2, "{}")], "surah int, payload string")
    assert [tuple(r) for r in R.deep_values(d, "id").collect()] == [(1, 4, "y")]
    with pytest.raises(R.SourceError):
        R.require_rows(b.limit(0), "bundle")


def test_dumps_and_mapped_rows(spark, tmp_path):
    paths = [write(tmp_path / f"p/{k}.json", str(k)) for k in (3, 1, 2)]
    assert [r.value for r in R.combined_dump(spark, paths).orderBy("pos").collect()] == ["3", "1", "2"]
    assert [r.value for r in R.combined_dump(spark, [*paths, f"file://{paths[0]}"][1:]).orderBy("pos").collect()] == ["1", "2", "3"]
    f = R.freshness(spark, str(tmp_path / "p")).first()
    assert f.files == 3 and f.newest is not None
    out = R.mapped(spark.range(20), lambda r: {"id": r["id"], "double": r["id"] * 2}, "id bigint, double bigint", 3)
    assert [(r.id, r.double) for r in out.collect()] == [(i, 2 * i) for i in range(20)]  # in input order
    u = spark.createDataFrame([("a/b/c-12.md",), ("a",)], "u string").select(R.path_key(F.col("u"), 0, 1), R.path_number(F.col("u"))).collect()
    assert [tuple(r) for r in u] == [("a/b", 12), ("", 0)]


def test_markdown(spark, tmp_path):
    write(tmp_path / "m/a.md", '---\nid: "x-1"\ntitle: T\nrights:\n  usage: private\n  by: z\n---\n# H\n## Satu\nisi\n\n## Dua\n1. a\n   lanjut\n2. b\n')
    m = R.markdown(spark, str(tmp_path / "m"))
    t = F.col("text")
    r = m.select(R.front_matter(t, "id"), R.front_matter(t, "none"), R.nested_front_matter(t, "rights", "usage"), R.sections(t), R.numbered_items(F.lit("1. a\n   lanjut\n2. b"))).first()
    assert (r[0], r[1], r[2]) == ("x-1", None, "private")
    assert [tuple(x) for x in r[3]] == [("Satu", "isi"), ("Dua", "1. a\n   lanjut\n2. b")] and r[4] == ["a lanjut", "b"]
    rep = spark.createDataFrame([("### ok 1\nx\n### ok 2",), ("### bad",)], "s string")
    assert len(rep.where("s LIKE '### ok%'").select(R.report_blocks(F.col("s"), r"^### ok \d")).first()[0]) == 2
    with pytest.raises(Exception, match="unreadable"):
        rep.select(R.report_blocks(F.col("s"), r"^### ok \d")).collect()


def test_shards_transcripts_repairs(spark):
    s = spark.createDataFrame([(1, 2, [(1,), (2,)]), (2, 2, [(1,)]), (3, 2, [(1,), (3,)])], "n int, ayahs int, verses array<struct<a:int>>")
    good, bad = R.checked_shards(s)
    assert [r.n for r in good.collect()] == [1] and {r.n: r.reason for r in bad.collect()} == {2: "count", 3: "gap"}
    t = spark.createDataFrame([("v", 2.0, "dua"), ("v", 1.0, " satu "), ("v", 3.0, None)], "k string, start double, text string")
    assert R.transcript(t, "k").first().text == "satu dua"
    d = spark.createDataFrame([(1, "ab�cd�"), (2, "ok"), (3, None)], "k int, t string")
    assert sorted((r.pos, r.before, r.after) for r in R.lost_characters(d, "k", "t").collect()) == [(2, "ab", "cd�"), (5, "ab�cd", "")]
    assert d.where("k = 1").select(R.repair_lost(F.col("t"), [(r"(?<=b)�", "é")])).first()[0] == "abécd�"


def test_artifacts_do_not_depend_on_order(spark, tmp_path):
    df = spark.range(500).select("id", F.when(F.col("id") % 3 == 0, "x").alias("s"))
    a, b = (K.artifact("t", x).first() for x in (df, df.orderBy(F.rand()).repartition(7)))
    assert a == b and a.rows == 500 and K.artifact("t", df.where("id <> 3")).first().sha256 != a.sha256
    m = K.manifest(spark.createDataFrame([tuple(a), ("u", *tuple(a)[1:])], "name string, sha256 string, bytes bigint, rows bigint")).first()
    assert len(m.version) == 12 and set(m.artifacts) == {"t", "u"}
    assert K.over_budget(df.withColumn("k", F.col("id") % 2), ["k"], 100, gz=False).count() == 2
    sizes = {r.k: r for r in K.shard_sizes(df.withColumn("k", F.col("id") % 2), ["k"]).collect()}
    assert all(r.gz_bytes < r.bytes for r in sizes.values()) and K.over_budget(df.withColumn("k", F.col("id") % 2), ["k"], max(r.gz_bytes for r in sizes.values())).count() == 0
    assert K.shard_sizes(df.withColumn("k", F.lit(None).cast("string")), ["k"]).first().bytes == sum(len(r.j) + 1 for r in df.withColumn("k", F.lit(None).cast("string")).select(F.to_json(F.struct("id", "s", "k")).alias("j")).collect())
    long = spark.range(1200).select("id", F.lit("x").alias("s"))
    assert len(K.markdown_table(long.orderBy("id")).splitlines()) == 1202
    assert K.write_shards(df.withColumn("k", F.col("id") % 4), str(tmp_path / "s"), ["k"], 4) == 4
    assert spark.read.json(str(tmp_path / "s")).count() == 500
    with pytest.raises(R.SourceError):
        K.write_shards(df.withColumn("k", F.lit(1)), str(tmp_path / "u"), ["k"], 2)
    K.write_lines(df, str(tmp_path / "g"), "gzip")
    assert spark.read.json(str(tmp_path / "g")).count() == 500
    assert K.append_new(df.limit(100), str(tmp_path / "j"), ["id"]) == 100
    assert K.append_new(df, str(tmp_path / "j"), ["id"]) == 400 and K.append_new(df, str(tmp_path / "j"), ["id"]) == 0
    assert K.markdown_table(df.orderBy("id").limit(1)) == "| id | s |\n|---|---|\n| 0 | x |"


EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double"


def events(spark, n=200):
    return [(i, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=(i * 7919) % 5000), i % 7, "abc"[i % 3], float(i)) for i in range(n)]


def test_stream_equals_batch(spark, tmp_path):
    rows = events(spark)
    for k in range(4):
        spark.createDataFrame(rows[k * 50 : (k + 1) * 50], EVENTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    state = "user_id bigint, event_type string, ts timestamp_ntz, event_id bigint, value double"
    target = S.KeyedTable(spark, str(tmp_path / "state"), state)
    for _ in range(2):
        source = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        S.upsert_stream(source, target, str(tmp_path / "cp")).awaitTermination(120)
    every = spark.createDataFrame(rows, EVENTS)
    want = S.merge(spark.createDataFrame([], state), every)
    assert sorted(map(tuple, target.read().collect())) == sorted(map(tuple, want.collect())) and want.count() == 21


def test_profiles_and_purge(spark, tmp_path):
    every = spark.createDataFrame(events(spark), EVENTS)
    old = S.profiles(every.where("event_id < 100"))
    fresh = {r.user_id: r for r in S.refresh(old, every).collect()}
    full = {r.user_id: r for r in S.profiles(every).collect()}
    olds = {r.user_id: r for r in old.collect()}
    for u, r in fresh.items():
        assert r.refreshed == (full[u].last_ts > olds[u].last_ts)
        assert r.top == (full if r.refreshed else olds)[u].top
    gone = spark.createDataFrame([(3,)], "user_id bigint")
    assert S.purge(every, gone, "user_id").where("user_id = 3").count() == 0
    base = every.limit(0).select("user_id", "event_type")
    assert S.insert_or_ignore(base, every, ["user_id"]).count() == 7
    log = S.EventLog(spark, str(tmp_path / "log"), EVENTS)
    prof = S.KeyedTable(spark, str(tmp_path / "prof"), "user_id bigint, top string, events bigint, last_ts timestamp_ntz", ["user_id"])
    assert log.read().count() == 0 and prof.read().count() == 0
    every.coalesce(1).write.parquet(str(tmp_path / "in"))
    S.profile_stream(spark.readStream.schema(EVENTS).parquet(str(tmp_path / "in")), log, prof, str(tmp_path / "cp")).awaitTermination(120)
    assert {r.user_id: (r.top, r.events) for r in prof.read().collect()} == {u: (r.top, r.events) for u, r in full.items()}


def test_log_and_table_write_only_what_they_must(spark, tmp_path):
    log = S.EventLog(spark, str(tmp_path / "log"), EVENTS)
    rows = events(spark, 30)
    for k in (0, 1, 1, 2):  # batch 1 is replayed
        log.append(spark.createDataFrame(rows[k * 10 : (k + 1) * 10], EVENTS), k)
    assert sorted(map(tuple, log.read().collect())) == sorted(rows)
    t = S.KeyedTable(spark, str(tmp_path / "t"), "k bigint, v bigint", ["k"], 8)
    put = lambda rows: t.update(spark.createDataFrame(rows, "k bigint, v bigint"), lambda old, new: S.merge(old, new, ["k"], ["v"]))
    put([(i, 0) for i in range(40)])
    for v in (1, 2, 3):
        put([(5, v)])
    assert {r.k: r.v for r in t.read().collect()} == {**{i: 0 for i in range(40)}, 5: 3}
    left = sorted(p.parent.name for p in (tmp_path / "t").glob("v*/bucket=*"))
    assert left.count("v3") == left.count("v2") == 1 and left.count("v1") == 0  # one bucket a version; the oldest are gone
    t.update(spark.createDataFrame([(i, 0) for i in range(40)], "k bigint, v bigint"), lambda old, new: old.limit(0))
    assert t.read().count() == 0 and t.version() == 4


def test_windowed_counts(spark, tmp_path):
    spark.createDataFrame(events(spark), EVENTS).withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.parquet(str(tmp_path / "in"))
    schema = EVENTS.replace("timestamp_ntz", "timestamp")
    s = S.windowed_counts(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
    q = s.writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("w").agg(F.sum("n")).first()[0] == 200


def test_profiles_by_shuffled_joins(spark, tmp_path):
    """The refresh can be written where its joins are shuffled and their parts merged at run time, and is as the SQL has it."""
    d = "/root/testdata/sf0.01"
    if not Path(d).exists():
        pytest.skip("no test data here")
    conf = {"autoBroadcastJoinThreshold": "-1", "shuffle.partitions": "40", "adaptive.advisoryPartitionSizeInBytes": "8k", "adaptive.coalescePartitions.minPartitionSize": "1k"}
    was = {k: spark.conf.get(f"spark.sql.{k}") for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(f"spark.sql.{k}", v)
        plans.queries()["profile_high_water"](spark, d).write.parquet(str(tmp_path / "out"))
    finally:
        for k, v in was.items():
            spark.conf.set(f"spark.sql.{k}", v)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{d}/events.parquet'")
    columns = "user_id, top, events, last_ts, refreshed"
    want = con.execute(f"SELECT {columns} FROM ({plans.oracle_sql()['profile_high_water']}) ORDER BY 1").fetchall()
    assert len(want) == 150 and con.execute(f"SELECT {columns} FROM '{tmp_path}/out/*.parquet' ORDER BY 1").fetchall() == want
    every = spark.createDataFrame(events(spark), EVENTS)
    kept = {r.user_id: r for r in S.refresh(S.profiles(every), every.where("user_id > 3")).collect()}
    assert len(kept) == 7 and not any(r.refreshed for r in kept.values())  # users whom the log lacks keep theirs
