"""Deeply nested shards as flat tables, by structural variants.

A bottom-up tree automaton gives every node of a shard a state. The letters are the kinds of its members (a whole or
quoted number, a text, a flag, absent, of a wrong kind; a list, a lone value or none), and the state of an object is the
hash of its kind, its letters and the sorted set of its children's states, so two objects have the same state if and
only if they have the same shape down to the leaves. The variant is the coarser class of the state that names a typed
subtype table: it follows from the same letters and from the variants of the children. Shards that come typed and those
that come as raw text are brought to one normalised tree first (the raw ones by Arrow batches of Python, which only
parse), and the transitions run over both as the same Spark expressions.

typed_tables() writes each level once, partitioned by variant, to the shared folder: every variant is a table of its own
columns (SUBTYPES) under the keys of the common supertype, which hold the link to the parent, with the state and the
number of children. leaves() is the union of these tables.

Rules: a lone object or string stands for an array of one; null, absent and empty arrays all mean no children; quoted
numbers count as numbers, other text in a number's place as absent; unknown members, and values of a wrong kind, are
kept as JSON text in `extra`; a raw text that does not parse, or is not an object, has nothing below it (variant
`broken`). An array element of a wrong kind keeps its position and has variant `alien`. A null shard_id is a key like
any other. Rows delivered again under the same shard_id count once.
"""

from __future__ import annotations

import json
import re
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from lontar.util import fresh_path, need, ship

REF = "STRUCT<k: STRING, surah: INT, ayah: INT, resolvable: BOOLEAN, bridge: ARRAY<STRING>, extra: STRING>"
ENTRY = f"STRUCT<k: STRING, text: STRING, ref: STRING, extra: STRING, refs: ARRAY<{REF}>>"
SUBTOPIC = f"STRUCT<k: STRING, subtopic: STRING, extra: STRING, entries: ARRAY<{ENTRY}>>"
TREE = f"ARRAY<{SUBTOPIC}>"

A_REF = pa.struct([("k", pa.string()), ("surah", pa.int32()), ("ayah", pa.int32()), ("resolvable", pa.bool_()), ("bridge", pa.list_(pa.string())), ("extra", pa.string())])
A_ENTRY = pa.struct([("k", pa.string()), ("text", pa.string()), ("ref", pa.string()), ("extra", pa.string()), ("refs", pa.list_(A_REF))])
A_SUBTOPIC = pa.struct([("k", pa.string()), ("subtopic", pa.string()), ("extra", pa.string()), ("entries", pa.list_(A_ENTRY))])

WHOLE = re.compile(r"\s*[+-]?[0-9]{1,18}\s*\Z")

#: Keys of each level, its payload, and the columns of each variant's table beside them.
KEYS = {"shards": ["shard_id"], "subtopics": ["shard_id", "subtopic_no"], "entries": ["shard_id", "subtopic_no", "entry_no"], "refs": ["shard_id", "subtopic_no", "entry_no", "ref_no"]}
SUBTYPES = {
    "shards": {"full": ("keep",), "mixed": ("keep",), "childless": ("keep",), "broken": ("keep",)},
    "subtopics": {"full": ("subtopic",), "mixed": ("subtopic",), "untitled": (), "childless": ("subtopic",), "extended": ("subtopic", "extra"), "alien": ("subtopic", "extra")},
    "entries": {"full": ("text", "ref"), "mixed": ("text", "ref"), "partial": ("text", "ref"), "childless": ("text", "ref"), "extended": ("text", "ref", "extra"), "alien": ("text", "ref", "extra")},
    "refs": {"plain": ("surah", "ayah", "resolvable", "bridge"), "quoted": ("surah", "ayah", "resolvable", "bridge"), "partial": ("surah", "ayah", "resolvable", "bridge"), "extended": ("surah", "ayah", "resolvable", "bridge", "extra"), "alien": ("surah", "ayah", "resolvable", "bridge", "extra")},
}


# Raw text to the normalised tree


class Parser:
    """Members as (letter, value): w whole, q quoted, t text, f flag, a absent, x of a wrong kind."""

    def number(self, v):
        if v is None:
            return "a", None
        if isinstance(v, bool):
            return "x", None
        letter = "w"
        if isinstance(v, str):
            if not WHOLE.match(v):
                return "x", None
            letter, v = "q", int(v)
        if isinstance(v, float):
            if v != v or v in (float("inf"), float("-inf")) or v != int(v):
                return "x", None
            v = int(v)
        if not isinstance(v, int) or not -(2**31) <= v < 2**31:
            return "x", None
        return letter, v

    def text(self, v):
        if v is None:
            return "a", None
        return ("t", v) if isinstance(v, str) else ("x", json.dumps(v, ensure_ascii=False))

    def flag(self, v):
        if isinstance(v, bool):
            return "f", v
        if isinstance(v, str) and v.strip().lower() in ("true", "false"):
            return "q", v.strip().lower() == "true"
        return ("a" if v is None else "x"), None

    def children(self, v):
        """(l list, o lone, n none; the children)."""
        if v is None or v == []:
            return "n", []
        return ("l", v) if isinstance(v, list) else ("o", [v])

    def extra(self, v: dict, known: tuple[str, ...], wrong: tuple[str, ...] = ()):
        rest = {k: x for k, x in v.items() if k not in known or k in wrong}
        return json.dumps(rest, ensure_ascii=False, sort_keys=True) if rest else None

    def ref(self, v):
        if not isinstance(v, dict):
            return {"k": "!", "surah": None, "ayah": None, "resolvable": None, "bridge": [], "extra": json.dumps(v, ensure_ascii=False)}
        (s, surah), (a, ayah), (f, resolvable) = self.number(v.get("surah")), self.number(v.get("ayah")), self.flag(v.get("resolvable"))
        b, bridge = self.children(v.get("bridge"))
        wrong = tuple(m for m, k in (("surah", s), ("ayah", a), ("resolvable", f)) if k == "x")
        return {"k": s + a + f + b, "surah": surah, "ayah": ayah, "resolvable": resolvable, "bridge": [self.text(x)[1] for x in bridge], "extra": self.extra(v, ("surah", "ayah", "resolvable", "bridge"), wrong)}

    def entry(self, v):
        if not isinstance(v, dict):
            return {"k": "!", "text": None, "ref": None, "extra": json.dumps(v, ensure_ascii=False), "refs": []}
        (t, text), (r, ref), (c, refs) = self.text(v.get("text")), self.text(v.get("ref")), self.children(v.get("refs"))
        return {"k": t + r + c, "text": text, "ref": ref, "extra": self.extra(v, ("text", "ref", "refs")), "refs": [self.ref(x) for x in refs]}

    def subtopic(self, v):
        if not isinstance(v, dict):
            return {"k": "!", "subtopic": None, "extra": json.dumps(v, ensure_ascii=False), "entries": []}
        (t, title), (c, entries) = self.text(v.get("subtopic")), self.children(v.get("entries"))
        return {"k": t + c, "subtopic": title, "extra": self.extra(v, ("subtopic", "entries")), "entries": [self.entry(x) for x in entries]}

    def shard(self, raw: str):
        try:
            v = json.loads(raw)
        except (ValueError, RecursionError):
            return "broken", []
        if not isinstance(v, dict):
            return "broken", []
        return "raw", [self.subtopic(x) for x in self.children(v.get("subtopics"))[1]]


def _parse(dropped: tuple[tuple[str, ...], ...]):
    """Arrow batches with raw_json parsed; members of subtopics, entries and refs in `dropped` are left null."""

    def run(batches):
        parser = Parser()
        for batch in batches:
            i = batch.schema.get_field_index("raw_json")
            out = [parser.shard(x) for x in batch.column(i).to_pylist()]
            for _, tree in out if any(dropped) else ():
                for s in tree:
                    s.update(dict.fromkeys(dropped[0]))
                    for e in s["entries"]:
                        e.update(dict.fromkeys(dropped[1]))
                        for r in e["refs"]:
                            r.update(dict.fromkeys(dropped[2]))
            rest = [batch.column(k) for k in range(batch.num_columns) if k != i]
            names = [n for k, n in enumerate(batch.schema.names) if k != i]
            yield pa.RecordBatch.from_arrays([*rest, pa.array([s for s, _ in out], pa.string()), pa.array([t for _, t in out], pa.list_(A_SUBTOPIC))], [*names, "origin", "tree"])

    return run


ship(__name__)


# Typed shards to the normalised tree


def _dropped(kind: ArrayType) -> tuple[tuple[str, ...], ...]:
    """Members of subtopics, entries and refs that the type of the typed column lacks."""
    s = kind.elementType
    e = s["entries"].dataType.elementType
    r = e["refs"].dataType.elementType
    gone = lambda t, names: tuple(n for n in names if n not in t.fieldNames())
    rest = () if "subtopic" in s.fieldNames() else ("extra",)
    return gone(s, ("subtopic",)) + rest, gone(e, ("text", "ref")) + rest, gone(r, ("surah", "ayah", "resolvable", "bridge")) + rest


def _typed_tree(c: Column, dropped: tuple[tuple[str, ...], ...]) -> Column:
    none = F.lit(None).cast("string").alias("extra")
    letter = lambda x, k: F.when(x.isNull(), "a").otherwise(k)
    some = lambda x: F.when(F.coalesce(F.size(x), F.lit(0)) <= 0, "n").otherwise("l")

    def member(level: int, x: Column, name: str, kind: str = "string") -> Column:
        return (F.lit(None).cast(kind) if name in dropped[level] else x[name]).alias(name)

    def ref(r: Column) -> Column:
        s, a, f, b = member(2, r, "surah", "int"), member(2, r, "ayah", "int"), member(2, r, "resolvable", "boolean"), member(2, r, "bridge", "array<string>")
        return F.struct(F.when(r.isNull(), "!").otherwise(F.concat(letter(s, "w"), letter(a, "w"), letter(f, "f"), some(b))).alias("k"), s, a, f, b, none)

    def entry(e: Column) -> Column:
        t, r = member(1, e, "text"), member(1, e, "ref")
        return F.struct(F.when(e.isNull(), "!").otherwise(F.concat(letter(t, "t"), letter(r, "t"), some(e.refs))).alias("k"), t, r, none, F.transform(e.refs, ref).alias("refs"))

    def subtopic(s: Column) -> Column:
        t = member(0, s, "subtopic")
        return F.struct(F.when(s.isNull(), "!").otherwise(F.concat(letter(t, "t"), some(s.entries))).alias("k"), t, none, F.transform(s.entries, entry).alias("entries"))

    return F.transform(c, subtopic)


def shard_trees(shards: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(shard_id, *keep, origin, tree): one row per shard, typed and raw ones in the same normalised form.

    origin: typed, raw or broken. Members that the type of `subtopics` lacks (as the table was read with a narrower
    schema) are null in both. Copies are dropped before anything is parsed.
    """
    dropped = _dropped(shards.schema["subtopics"].dataType)
    base = need(shards, ["shard_id", *keep, "subtopics", "raw_json"]).dropDuplicates(["shard_id"])
    is_raw = F.col("subtopics").isNull() & F.col("raw_json").isNotNull()
    typed = base.where(~is_raw).select("shard_id", *keep, F.lit("typed").alias("origin"), _typed_tree(F.col("subtopics"), dropped).alias("tree"))
    raw = base.where(is_raw).select("shard_id", *keep, "raw_json")
    kept = raw.drop("raw_json").schema
    return typed.unionByName(raw.mapInArrow(_parse(dropped), ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + ["origin string", f"tree {TREE}"])))


# The automaton


def _state(kind: str, letters: Column, extra: Column, children: Column | None = None) -> Column:
    parts = [F.lit(kind), letters, extra.isNotNull()]
    return F.xxhash64(*parts, *([F.array_sort(F.array_distinct(children))] if children is not None else [])).alias("state")


def _variant(letters: Column, extra: Column, own: list[tuple[Column, str]], otherwise: Column) -> Column:
    out = F.when(letters.rlike("[!x]"), "alien").when(extra.isNotNull(), "extended")
    for condition, name in own:
        out = out.when(condition, name)
    return out.otherwise(otherwise).alias("variant")


def _whole(variants: Column, best: str) -> Column:
    """full if all children are of the best variant, else mixed."""
    return F.when(F.forall(variants, lambda v: v == best), "full").otherwise("mixed")


def classified(trees: DataFrame) -> DataFrame:
    """trees with variant and state of the shards, and variant, state and children in every node of the tree."""

    def ref(r: Column) -> Column:
        variant = _variant(r.k, r.extra, [(F.substring(r.k, 1, 2).contains("a"), "partial"), (r.k.contains("q"), "quoted")], F.lit("plain"))
        return F.struct(variant, _state("ref", r.k, r.extra), r.surah.alias("surah"), r.ayah.alias("ayah"), r.resolvable.alias("resolvable"), r.bridge.alias("bridge"), r.extra.alias("extra"))

    def count(x: Column) -> Column:
        return F.greatest(F.coalesce(F.size(x), F.lit(0)), F.lit(0)).alias("children")

    def entry(e: Column) -> Column:
        refs = F.coalesce(e.refs, F.array().cast(e_type))
        variant = _variant(e.k, e.extra, [(F.size(refs) == 0, "childless"), (F.substring(e.k, 1, 2).contains("a"), "partial")], _whole(refs.variant, "plain"))
        return F.struct(variant, _state("entry", e.k, e.extra, refs.state), count(e.refs), e.text.alias("text"), e.ref.alias("ref"), e.extra.alias("extra"), e.refs.alias("refs"))

    def subtopic(s: Column) -> Column:
        entries = F.coalesce(s.entries, F.array().cast(s_type))
        variant = _variant(s.k, s.extra, [(F.size(entries) == 0, "childless"), (F.substring(s.k, 1, 1) == "a", "untitled")], _whole(entries.variant, "full"))
        return F.struct(variant, _state("subtopic", s.k, s.extra, entries.state), count(s.entries), s.subtopic.alias("subtopic"), s.extra.alias("extra"), s.entries.alias("entries"))

    inner = lambda s, f: F.struct(s.k.alias("k"), s.subtopic.alias("subtopic"), s.extra.alias("extra"), F.transform(s.entries, f).alias("entries"))
    with_refs = lambda e: F.struct(e.k.alias("k"), e.text.alias("text"), e.ref.alias("ref"), e.extra.alias("extra"), F.transform(e.refs, ref).alias("refs"))
    t = trees.withColumn("tree", F.transform("tree", lambda s: inner(s, with_refs)))
    e_type = t.schema["tree"].dataType.elementType["entries"].dataType.elementType["refs"].dataType
    t = t.withColumn("tree", F.transform("tree", lambda s: inner(s, entry)))
    s_type = t.schema["tree"].dataType.elementType["entries"].dataType
    t = t.withColumn("tree", F.transform("tree", subtopic))
    subs = F.coalesce("tree", F.array().cast(t.schema["tree"].dataType))
    variant = F.when(F.col("origin") == "broken", "broken").when(F.size(subs) == 0, "childless").otherwise(_whole(subs.variant, "full"))
    return t.withColumn("variant", variant).withColumn("state", F.xxhash64(F.lit("shard"), "origin", F.array_sort(F.array_distinct(subs.state)))).withColumn("children", count(F.col("tree")))


# Flat tables


def _levels(t: DataFrame, keep: tuple[str, ...], common: list[str]) -> dict[str, DataFrame]:
    at = lambda x: [F.col(f"{x}.{c}").alias(c) for c in (["variant", "state", "children"] if common else [])]
    s = t.select("shard_id", F.posexplode("tree").alias("subtopic_no", "s"))
    e = s.select("shard_id", "subtopic_no", F.posexplode("s.entries").alias("entry_no", "e"))
    r = e.select("shard_id", "subtopic_no", "entry_no", F.posexplode("e.refs").alias("ref_no", "r"))
    return {
        "shards": t.select("shard_id", *keep, "origin", *common),
        "subtopics": s.select("shard_id", "subtopic_no", *at("s"), "s.subtopic", "s.extra"),
        "entries": e.select("shard_id", "subtopic_no", "entry_no", *at("e"), "e.text", "e.ref", "e.extra"),
        "refs": r.select("shard_id", "subtopic_no", "entry_no", "ref_no", *at("r")[:2], *([F.greatest(F.coalesce(F.size("r.bridge"), F.lit(0)), F.lit(0)).alias("children")] if common else []), "r.surah", "r.ayah", "r.resolvable", "r.bridge", "r.extra"),
    }


def flat_tables(shards: DataFrame, keep: tuple[str, ...] = ("slug", "category", "published_at")) -> dict[str, DataFrame]:
    """Tables of every level without states: shards(shard_id, *keep, origin), subtopics(+ subtopic_no), entries(+ entry_no),
    refs(+ ref_no), bridges(+ bridge_no), each row with the keys of its parent. Positions count from 0."""
    out = _levels(shard_trees(shards, keep), keep, [])
    out["bridges"] = out["refs"].select(*KEYS["refs"], F.posexplode("bridge").alias("bridge_no", "bridge"))
    out["refs"] = out["refs"].drop("bridge")
    return out


class TypedTables:
    """The subtype tables of every level, as written: one folder per variant."""

    def __init__(self, spark: SparkSession, paths: dict[str, str], schemas: dict, keep: tuple[str, ...]) -> None:
        self.spark, self.paths, self.schemas, self.keep = spark, paths, schemas, keep

    def table(self, level: str, variant: str) -> DataFrame:
        """Keys, state, number of children and the columns that this variant has."""
        own = [c for name in SUBTYPES[level][variant] for c in (self.keep if name == "keep" else (name,))]
        return self.spark.read.schema(self.schemas[level]).parquet(self.paths[level]).where(F.col("variant") == variant).select(*KEYS[level], "state", "children", *own)

    def tables(self, level: str) -> dict[str, DataFrame]:
        return {v: self.table(level, v) for v in SUBTYPES[level]}


def typed_tables(shards: DataFrame, keep: tuple[str, ...] = ("slug", "category", "published_at")) -> TypedTables:
    """Classifies the shards and routes each level to the tables of its variants."""
    spark = shards.sparkSession
    root = fresh_path(spark, "nested")
    classified(shard_trees(shards, keep)).write.parquet(f"{root}/trees")
    levels = _levels(spark.read.parquet(f"{root}/trees"), keep, ["variant", "state", "children"])
    paths = {level: f"{root}/{level}" for level in levels}
    for level, df in levels.items():
        df.write.partitionBy("variant").parquet(paths[level])
    return TypedTables(spark, paths, {level: df.schema for level, df in levels.items()}, keep)


def leaves(shards: DataFrame) -> DataFrame:
    """(shard_id, subtopic_no, entry_no, ref_no, bridge_no): one row per leaf; -1 from the first level without children on.

    The union of the subtype tables: their rows without children, and the bridges of the references.
    """
    t = typed_tables(shards, ())
    numbers = ["subtopic_no", "entry_no", "ref_no", "bridge_no"]
    parts = []
    for level in ("shards", "subtopics", "entries"):
        for df in t.tables(level).values():
            parts.append(df.where("children = 0").select("shard_id", *[(F.col(n) if n in KEYS[level] else F.lit(-1)).alias(n) for n in numbers]))
    for df in t.tables("refs").values():
        parts.append(df.select(*KEYS["refs"], F.posexplode_outer("bridge").alias("bridge_no", "b")).select("shard_id", *[F.coalesce(n, F.lit(-1)).alias(n) for n in numbers]))
    return reduce(DataFrame.unionByName, parts)
