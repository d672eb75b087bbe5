"""Readers of pinned texts, markup and JSON. Where rows can be malformed, a reader returns (good, rejects)."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W


class SourceError(Exception):
    """Raised with every problem of a load in its message."""


# Inventory and pins


def inventory(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, bytes, sha256) of every file below a folder."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    return f.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def pin_drift(current: DataFrame, lock: DataFrame) -> DataFrame:
    """(path, state): files that are missing, unexpected or changed against a lock of (path, sha256)."""
    j = current.select("path", F.col("sha256").alias("_c")).join(lock.select("path", F.col("sha256").alias("_l")), "path", "full_outer")
    state = F.when(F.col("_c").isNull(), "missing").when(F.col("_l").isNull(), "unexpected").when(F.col("_c") != F.col("_l"), "changed")
    return j.select("path", state.alias("state")).where("state IS NOT NULL")


def load_pinned(spark: SparkSession, path: str, lock: DataFrame, glob: str = "*") -> DataFrame:
    """The inventory, if it agrees with the lock; otherwise every drift is reported at once, however many there are."""
    now = inventory(spark, path, glob)
    drift = [f"{r.path}: {r.state}" for r in pin_drift(now, lock).orderBy("path").toLocalIterator()]
    if drift:
        raise SourceError("; ".join(drift))
    return now


def repin(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """A new lock (path, sha256, bytes) of the files as they are now, for a deliberate change of the pins."""
    return inventory(spark, path, glob).select("path", "sha256", "bytes")


def registry(spark: SparkSession, sources: list[dict], kind: str | None = None) -> DataFrame:
    """A table of sources (id, kind, url, licence), optionally of one kind; ids must be unique."""
    ids = [s["id"] for s in sources]
    if len(ids) != len(set(ids)):
        raise SourceError("source ids repeat")
    df = spark.createDataFrame([(s["id"], s.get("kind"), s.get("url"), s.get("licence")) for s in sources], "id string, kind string, url string, licence string")
    return df if kind is None else df.where(F.col("kind") == kind)


def by_id(sources: DataFrame, source_id: str) -> dict:
    r = sources.where(F.col("id") == source_id).first()
    if r is None:
        raise SourceError(f"no source {source_id}")
    return r.asDict()


# Text formats


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line_no, value): lines with their number, from 1, within each file.

    Whole files are read as one value each, as their lines must be numbered; give many files rather than a large one.
    """
    f = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.split("value", r"\r?\n").alias("l"))
    return f.select("path", F.posexplode("l").alias("i", "value")).select("path", (F.col("i") + 1).alias("line_no"), "value")


def pipe_text(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Lines int|int|text: (good(a, b, text), rejects(path, line_no, value)). Blank lines and # comments are skipped, further pipes belong to the text."""
    lines = text_lines(spark, path).where(~F.trim("value").isin("") & ~F.ltrim("value").startswith("#"))
    p = F.split("value", r"\|", 3)
    x = lines.withColumn("_p", p).withColumn("a", F.get("_p", F.lit(0)).try_cast("int")).withColumn("b", F.get("_p", F.lit(1)).try_cast("int")).withColumn("text", F.get("_p", F.lit(2)))
    ok = F.col("a").isNotNull() & F.col("b").isNotNull() & (F.trim(F.coalesce("text", F.lit(""))) != "")
    return x.where(ok).select("a", "b", "text"), x.where(~ok).select("path", "line_no", "value")


def attributes(tag: Column) -> Column:
    """Attribute map of one tag."""
    pairs = F.regexp_extract_all(tag, F.lit(r'([\w:-]+\s*=\s*"[^"]*")'), F.lit(1))
    return F.map_from_entries(F.transform(pairs, lambda p: F.struct(F.regexp_extract(p, r"^([\w:-]+)", 1).alias("k"), F.regexp_extract(p, r'"([^"]*)"', 1).alias("v"))))


def tags(spark: SparkSession, path: str, name: str) -> DataFrame:
    """(path, pos, attrs): the self-closing tags of a name with their attributes, in order of the file."""
    f = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.regexp_extract_all("value", F.lit(rf"(<{name}\s[^>]*/>)"), F.lit(1)).alias("t"))
    return f.select("path", F.posexplode("t").alias("pos", "tag")).select("path", "pos", attributes(F.col("tag")).alias("attrs"))


def checked_tags(df: DataFrame, ints: list[str], enums: dict[str, list[str]], texts: list[str]) -> tuple[DataFrame, DataFrame]:
    """(good, rejects with reason): required attributes as integers, members of a set, or text."""
    a = lambda k: F.get(F.array(F.try_element_at("attrs", F.lit(k))), F.lit(0))
    reason = F.lit(None).cast("string")
    for k in reversed([*ints, *enums, *texts]):
        bad = a(k).try_cast("int").isNull() if k in ints else ~a(k).isin(*enums[k]) if k in enums else F.trim(a(k)) == ""
        reason = F.when(a(k).isNull(), f"missing {k}").when(bad, f"bad {k}").otherwise(reason)
    x = df.withColumn("reason", reason)
    good = x.where("reason IS NULL").select("path", "pos", *[a(k).cast("int").alias(k) for k in ints], *[a(k).alias(k) for k in [*enums, *texts]])
    return good, x.where("reason IS NOT NULL").select("path", "pos", "reason")


def milestones(df: DataFrame, index: str, n: int) -> DataFrame:
    """Positions at which an index does not run 1..n in order: (pos, index); a missing end is reported at n."""
    r = df.withColumn("_r", F.row_number().over(W.partitionBy("path").orderBy("pos")))
    wrong = r.where(F.col(index) != F.col("_r")).select("pos", F.col(index).alias("index"))
    short = df.agg(F.count("*").alias("k")).where(F.col("k") != n).select(F.lit(n).alias("pos"), F.col("k").cast("int").alias("index"))
    return wrong.unionByName(short)


# JSON


def json_records(spark: SparkSession, path: str, schema: str, multi_line: bool = False) -> tuple[DataFrame, DataFrame]:
    """(good, rejects(raw)): JSON lines or, multi_line, files of an object or an array; a truncated last line is a reject."""
    text = spark.read.text(path, wholetext=multi_line).where("trim(value) <> ''")
    bad = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_raw"}
    if multi_line:
        x = text.select("value", F.from_json("value", f"array<struct<{_struct(schema)}>>").alias("a"))
        return x.select(F.explode("a").alias("r")).where("r IS NOT NULL").select("r.*"), x.where("a IS NULL").select(F.col("value").alias("raw"))
    x = text.select(F.from_json("value", f"{schema}, _raw string", bad).alias("r"))
    return x.where("r._raw IS NULL").select("r.*").drop("_raw"), x.where("r._raw IS NOT NULL").select(F.col("r._raw").alias("raw"))


def _struct(schema: str) -> str:
    return ", ".join(f"{name}: {kind}" for name, kind in (c.strip().split(" ", 1) for c in re.split(r",(?![^<]*>)", schema)))


def nested_bundle(df: DataFrame) -> DataFrame:
    """Rows (surah, ayah, text) of bundles (surah, payload JSON text): payloads that are no arrays are skipped, empty texts dropped."""
    rows = F.from_json("payload", "array<struct<surah:int,ayah:int,text:string>>")
    return df.where(F.ltrim("payload").startswith("[")).select(F.col("surah").alias("_s"), F.explode(rows).alias("r")).select(F.coalesce("r.surah", "_s").alias("surah"), "r.ayah", "r.text").where("trim(text) <> ''")


def deep_values(df: DataFrame, key: str) -> DataFrame:
    """(surah, verse, text): payload.data.verses[].translations[key] of documents (surah, payload); a missing path or key gives no row."""
    t = "struct<data:struct<verses:array<struct<verseNumber:int,translations:map<string,string>>>>>"
    v = df.select("surah", F.explode(F.from_json("payload", t).getField("data").getField("verses")).alias("v"))
    return v.select("surah", F.col("v.verseNumber").alias("verse"), F.try_element_at("v.translations", F.lit(key)).alias("text")).where("text IS NOT NULL")


def require_rows(df: DataFrame, what: str) -> DataFrame:
    """The table itself, or an error if it is empty."""
    if df.isEmpty():
        raise SourceError(f"{what}: no rows")
    return df


# Markdown


def front_matter(text: Column, key: str) -> Column:
    """A top-level scalar between the leading --- lines, without quotes; null if there is none."""
    head = F.regexp_extract(text, r"(?s)\A---\r?\n(.*?)\r?\n---(?:\r?\n|\z)", 1)
    v = F.trim(F.regexp_extract(head, rf"(?m)^{key}:[ \t]*(.*)$", 1))
    return F.nullif(F.regexp_replace(v, r"""^["'](.*)["']$""", "$1"), F.lit(""))


def nested_front_matter(text: Column, outer: str, key: str) -> Column:
    """A scalar one level below a top-level key."""
    head = F.regexp_extract(text, r"(?s)\A---\r?\n(.*?)\r?\n---(?:\r?\n|\z)", 1)
    block = F.regexp_extract(head, rf"(?m)^{outer}:[ \t]*\r?\n((?:[ \t]+.*(?:\r?\n|$))+)", 1)
    return F.nullif(F.regexp_replace(F.trim(F.regexp_extract(block, rf"(?m)^[ \t]+{key}:[ \t]*(.*)$", 1)), r"""^["'](.*)["']$""", "$1"), F.lit(""))


def body(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\A---\r?\n.*?\r?\n---(?:\r?\n|\z)", "")


def sections(text: Column) -> Column:
    """array<struct<title, content>> of the ## sections."""
    parts = F.filter(F.split(F.concat(F.lit("\n"), body(text)), r"\n(?=## )"), lambda p: p.startswith("## "))
    return F.transform(parts, lambda p: F.struct(F.trim(F.regexp_extract(p, r"\A## ([^\n]*)", 1)).alias("title"), F.regexp_replace(F.regexp_replace(p, r"\A## [^\n]*\n?", ""), r"\A\s+|\s+\z", "").alias("content")))


def numbered_items(text: Column) -> Column:
    """Items of a numbered list; lines without a number continue the item before."""
    items = F.filter(F.split(F.concat(F.lit("\n"), text), r"\n(?=\d+\. )"), lambda p: p.rlike(r"\A\s*\d+\. "))
    return F.transform(items, lambda p: F.trim(F.regexp_replace(F.regexp_replace(p, r"\A\s*\d+\. ", ""), r"\s*\n\s*", " ")))


def markdown(spark: SparkSession, path: str, glob: str = "*.md") -> DataFrame:
    """(path, text) of every .md file below a folder."""
    f = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter=glob)
    return f.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def report_blocks(text: Column, pattern: str) -> Column:
    """Blocks that begin with ### of a generated report, each of which must match the pattern; otherwise the job fails."""
    blocks = F.filter(F.split(F.concat(F.lit("\n"), text), r"\n(?=### )"), lambda b: b.startswith("### "))
    return F.transform(blocks, lambda b: F.when(b.rlike(pattern), b).otherwise(F.raise_error(F.concat(F.lit("unreadable block: "), F.left(b, F.lit(60))))))


# Shards and transcripts


def checked_shards(shards: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good, rejects(n, reason)) of shards (n, ayahs, verses array<struct<a, ...>>): declared count and contiguity 1..ayahs."""
    a = F.transform("verses", lambda v: v.a)
    whole = F.transform(F.sequence(F.lit(1), F.greatest("ayahs", F.lit(1))), lambda i: i)
    reason = F.when(F.size("verses") != F.col("ayahs"), "count").when(F.array_sort(a) != whole, "gap")
    x = shards.withColumn("reason", reason)
    return x.where("reason IS NULL").drop("reason"), x.where("reason IS NOT NULL").select("n", "reason")


def transcript(snippets: DataFrame, key: str) -> DataFrame:
    """(key, text): the snippets (start, text) of each transcript joined in order of their start."""
    g = snippets.where("text IS NOT NULL").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("start", "text"))).alias("l"))
    return g.select(key, F.trim(F.regexp_replace(F.array_join(F.transform("l", lambda x: x.text), " "), r"\s+", " ")).alias("text"))


def lost_characters(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pos, before, after): every U+FFFD with what stands around it."""
    n = F.length(text) - F.length(F.replace(text, F.lit("�"), F.lit("")))
    x = df.where(n > 0).select(key, F.col(text).alias("_t"), F.posexplode(F.split(text, "")).alias("pos", "c")).where(F.col("c") == "�")
    p = F.col("pos") + 1
    return x.select(key, "pos", F.substring("_t", F.greatest(p - 12, F.lit(1)), F.least(p - 1, F.lit(12))).alias("before"), F.substring("_t", p + 1, F.lit(12)).alias("after"))


def repair_lost(text: Column, rules: list[tuple[str, str]]) -> Column:
    """Replaces U+FFFD where a rule (pattern with lookaround, replacement) classifies it; the others stay."""
    for pattern, replacement in rules:
        text = F.regexp_replace(text, pattern, replacement)
    return text


# Dumps, mapped sources and layouts


def combined_dump(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(pos, path, value): the files of a partitioned source, whole, under the position each has in the given list."""
    conf, path = spark._jsc.hadoopConfiguration(), spark._jvm.org.apache.hadoop.fs.Path
    whole = [path(p).getFileSystem(conf).makeQualified(path(p)).toUri().toString() for p in paths]
    order = spark.createDataFrame(list(enumerate(map(_same_path, whole))), "pos int, path string")
    f = spark.read.text(paths, wholetext=True).select(F.regexp_replace(F.col("_metadata.file_path"), "^file:/+", "file:/").alias("path"), "value")
    return order.join(f, "path").select("pos", "path", "value")


def _same_path(uri: str) -> str:
    """One slash after the scheme of local files, as both ways to name them agree on."""
    return re.sub("^file:/+", "file:/", uri)


def mapped(df: DataFrame, fetch, schema: str, limit: int = 8) -> DataFrame:
    """Rows through an injected function of one row (a dict) to one row, in input order, with at most `limit` calls at once.

    The calls wait for others (downloads), so one task with `limit` threads makes them all: only so is the bound one of
    the whole job, and the order kept.
    """

    def run(frames):
        from concurrent.futures import ThreadPoolExecutor

        import pandas as pd

        with ThreadPoolExecutor(limit) as pool:
            for f in frames:
                yield pd.DataFrame(list(pool.map(fetch, f.to_dict("records"))))

    return df.coalesce(1).mapInPandas(run, schema)


def path_key(c: Column, first: int, last: int) -> Column:
    """Parts of a path from first to last (from 0), joined by /; empty if there are fewer."""
    p = F.split(c, "/")
    return F.when(F.size(p) > last, F.array_join(F.slice(p, first + 1, last - first + 1), "/")).otherwise("")


def path_number(c: Column) -> Column:
    """The number in the last part of a path; 0 if there is none."""
    return F.coalesce(F.regexp_extract(F.element_at(F.split(c, "/"), -1), "[0-9]+", 0).try_cast("int"), F.lit(0))


def freshness(spark: SparkSession, path: str) -> DataFrame:
    """(files, newest, sha256): number of files below a folder, the newest modification time, and a digest of their sorted path:hash lines."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("modificationTime", F.concat_ws(":", "path", F.sha2("content", 256)).alias("line"))
    return f.agg(F.count("*").alias("files"), F.max("modificationTime").alias("newest"), F.sha2(F.array_join(F.array_sort(F.collect_list("line")), "\n"), 256).alias("sha256"))
