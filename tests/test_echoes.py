"""Anchored echoes: a reference that many answers and translations have, in blocks, against the SQL."""

import random

import duckdb

from lontar import plans
from lontar.operators import similarity as S


def test_anchored_echoes_of_a_hot_reference(spark, tmp_path, monkeypatch):
    for name, value in (("PROSE_BLOCK", 100), ("TEXT_BLOCK", 150), ("MATCHES", 500)):
        monkeypatch.setattr(S, name, value)
    rng = random.Random(5)
    word = lambda: f"kata{rng.choice('abcdefgh')}{rng.choice('klmnopq')}{rng.choice('rstuvw')}{rng.choice('eioua')}x"
    say = lambda n: " ".join(word() for _ in range(n))
    texts = [say(14) for _ in range(700)]
    ref = lambda i: "2:7" if i % 4 else f"3:{i % 9}"
    prose = [None if i == 7 else "" if i == 8 else f'{say(9)} "{" ".join(rng.choice(texts).split()[2:9])}" {rng.choice(texts)} (5:{i % 3})' for i in range(700)]
    tr = [(i, f"ayah:{ref(i)}", "id", x) for i, x in enumerate(texts)] + [(i, "ayah:3:1", "id", texts[i]) for i in range(1, 60)] + [(900, "ayah:5:1", "id", None), (901, "ayah:2:7", "en", texts[0])]
    spark.createDataFrame(tr, "tr_id long, ayah_id string, lang string, text string").repartition(3).write.parquet(f"{tmp_path}/translations.parquet")
    dump = [(i, "answered", x, None if i == 9 else [ref(i), "3:1"], None) for i, x in enumerate(prose)]
    spark.createDataFrame(dump, "dump_id long, turn_bucket string, prose string, verse_refs array<string>, hits array<string>").repartition(3).write.parquet(f"{tmp_path}/dump_rows.parquet")

    moved = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(False).apply(0).totalShuffleWrite()
    was = moved()
    plans.queries()["echo_anchored"](spark, str(tmp_path)).write.parquet(f"{tmp_path}/out")
    shuffled = moved() - was
    assert shuffled < 2_500_000  # 3,900,000 where the pairs are listed
    con = duckdb.connect()
    for t in ("translations", "dump_rows"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    columns = "p_id, t_id, hit, rare, run, quoted"
    want = con.execute(f"SELECT {columns} FROM ({plans.oracle_sql()['echo_anchored']}) ORDER BY ALL").fetchall()
    assert len(want) > 500 and any(r[5] for r in want)
    assert con.execute(f"SELECT {columns} FROM '{tmp_path}/out/*.parquet' ORDER BY ALL").fetchall() == want
