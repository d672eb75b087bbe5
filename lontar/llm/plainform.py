"""Visually identical text in one consistent form.

The form is computed by DuckDB inside Arrow partitions, from embedded SQL: compatibility forms (full width,
presentation forms, ligatures, mathematical letters) become ordinary characters by translate() and a map, invisible
characters are removed and spaces unified by regular expressions, look-alike letters become those of their word's
script, and nfc_normalize() composes and orders the marks. The tables are built from Unicode's own decompositions.

Plain form: NFC; ordinary-width characters without presentation forms or ligatures (the honorific U+FDFA stays);
U+0020 the only space (line ends and tabs included); no invisible characters; Arabic letters and digits in place of
their Persian and Urdu look-alikes; in a word of mixed scripts, the letters of the script that all of it can be
written in, Latin first. Words wholly in another script, typographic quotes and dashes stay. Null stays null, and the
empty text is plain.
"""

from __future__ import annotations

import sys
import unicodedata

import duckdb
import pyarrow as pa
from pyspark.sql import DataFrame

from lontar.util import ship

TAGS = ("<wide>", "<narrow>", "<initial>", "<medial>", "<final>", "<isolated>", "<font>")
KEPT = "ﷺ"
INVISIBLE = r"[\x{00AD}\x{034F}\x{061C}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{180B}-\x{180F}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{206F}\x{3164}\x{FE00}-\x{FE0F}\x{FEFF}\x{FFA0}\x{FFF9}-\x{FFFB}\x{E0000}-\x{E0FFF}]"
SPACES = r"[\t\n\x{0B}\x{0C}\r\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+?"
#: Arabic-script look-alikes and what Arabic writes, then letters of Cyrillic, Greek and others that look like Latin ones.
ARABIC = ("کڪیېہھەۃ۰۱۲۳۴۵۶۷۸۹", "ككييهههة٠١٢٣٤٥٦٧٨٩")
CYRILLIC = ("аеорсухѕіјԁһԛԝАВЕКМНОРСТХУЅІЈҮҺԚԜ", "aeopcyxsijdhqwABEKMHOPCTXYSIJYhQW")
GREEK = ("αονρικυγϲϳΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹ", "aovpikuycjABEZHIKMNOPTYXC")
LATIN_LIKE = ("ɑɡօ", "ago")


def compatibility() -> dict[str, str]:
    """Compatibility character -> ordinary ones."""
    out = {}
    for cp in range(0x80, sys.maxunicode + 1):
        c = chr(cp)
        d = unicodedata.decomposition(c)
        if c == KEPT or not d.startswith("<") or unicodedata.category(c) == "Zs":
            continue
        tag = d.split()[0]
        if tag in TAGS and (tag != "<font>" or cp >= 0x1D400) or tag == "<compat>" and 0xFB00 <= cp <= 0xFB17:
            to = unicodedata.normalize("NFKC", c)
            if 0xFE70 <= cp <= 0xFE7F:  # marks shown on a space or a kashida
                to = to.replace(" ", "").replace("ـ", "")
            if to and to != c:
                out[c] = to
    return out


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def char_class(chars) -> str:
    cps = sorted(map(ord, chars))
    out, start = [], None
    for i, cp in enumerate(cps):
        start = cp if start is None else start
        if i + 1 == len(cps) or cps[i + 1] != cp + 1:
            out.append(f"\\x{{{start:X}}}-\\x{{{cp:X}}}")
            start = None
    return "[" + "".join(out) + "]"


def form_sql(column: str = "v", source: str = "batch") -> str:
    """SELECT of the plain form of a column, as `form`, beside the row number `i`."""
    compat = compatibility()
    single = {c: t for c, t in compat.items() if len(t) == 1}
    several = {c: t for c, t in compat.items() if len(t) > 1}
    entries = ", ".join(f"{quoted(c)}: {quoted(t)}" for c, t in several.items())
    like = "".join(x[0] for x in (CYRILLIC, GREEK, LATIN_LIKE)), "".join(x[1] for x in (CYRILLIC, GREEK, LATIN_LIKE))

    def back(pair: tuple[str, str]) -> str:
        seen: dict[str, str] = {}
        for other, latin in zip(*pair, strict=True):
            seen.setdefault(latin, other)
        return f"translate(w, {quoted(''.join(seen))}, {quoted(''.join(seen.values()))})"

    foreign = r"[\p{Cyrillic}\p{Greek}\p{Armenian}\x{0251}\x{0261}]"
    word = f"""CASE WHEN NOT (regexp_matches(w, '\\p{{Latin}}') AND regexp_matches(w, '{foreign}')) THEN w
      WHEN NOT regexp_matches(translate(w, {quoted(like[0])}, {quoted(like[1])}), '{foreign}') THEN translate(w, {quoted(like[0])}, {quoted(like[1])})
      WHEN NOT regexp_matches({back(CYRILLIC)}, '\\p{{Latin}}') THEN {back(CYRILLIC)}
      WHEN NOT regexp_matches({back(GREEK)}, '\\p{{Latin}}') THEN {back(GREEK)}
      ELSE w END"""
    return f"""
    WITH a AS (SELECT i, regexp_replace(regexp_replace({column}, '{INVISIBLE}', '', 'g'), '{SPACES}', ' ', 'g') AS v FROM {source}),
    b AS (SELECT i, CASE WHEN regexp_matches(v, '{char_class(several)}') THEN array_to_string(list_transform(string_split(v, ''), lambda c: coalesce(map_extract_value(MAP {{{entries}}}, c), c)), '') ELSE v END AS v FROM a),
    c AS (SELECT i, CASE WHEN regexp_matches(v, '{char_class(single)}') THEN translate(v, {quoted(''.join(single))}, {quoted(''.join(single.values()))}) ELSE v END AS v FROM b),
    d AS (SELECT i, nfc_normalize(translate(v, {quoted(ARABIC[0])}, {quoted(ARABIC[1])})) AS v FROM c),
    e AS (SELECT i, CASE WHEN regexp_matches(v, '{foreign}') THEN array_to_string(list_transform(regexp_extract_all(v, '[\\p{{L}}\\p{{M}}\\p{{N}}]+|[^\\p{{L}}\\p{{M}}\\p{{N}}]+'), lambda w: {word}), '') ELSE v END AS v FROM d)
    SELECT i, nfc_normalize(v) AS form FROM e ORDER BY i"""


def _former(only_changed: bool):
    def run(batches):
        sql = form_sql()
        con = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "300MB"})
        for batch in batches:
            values = batch.column(batch.num_columns - 1).cast(pa.string())
            con.register("batch", pa.table({"i": pa.array(range(len(values)), pa.int64()), "v": values}))
            form = con.sql(sql).to_arrow_table().column("form").combine_chunks().cast(pa.string())
            con.unregister("batch")
            out = pa.RecordBatch.from_arrays([*batch.columns[:-1], values, form], [*batch.schema.names, "form"])
            if only_changed:
                out = out.filter(pa.compute.not_equal(values, form))
            yield out
        con.close()

    return run


ship(__name__)


def plain_forms(values: DataFrame, text: str, only_changed: bool = False) -> DataFrame:
    """values + form. With only_changed, the rows whose text is not in plain form (nulls are in none). A column `form` of values is left out."""
    keys = [c for c in values.columns if c not in (text, "form")]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in values.select(*keys, text).schema)
    return values.select(*keys, text).mapInArrow(_former(only_changed), f"{fields}, form string")
