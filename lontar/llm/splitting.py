"""Splitting texts above a size limit at natural boundaries, with overlap.

The text is viewed byte by byte (its UTF-8 bytes as Latin-1 characters), so that one bounded-quantifier regular
expression measures bytes. Its alternatives are ordered by the strength of the boundary they end at: paragraph,
sentence, word, and last a character; each takes as many bytes as the limit leaves. The first two also require that a
piece be filled by a quarter, and follow again without that. Matches follow one another without gaps, so the bodies
join to the whole text. Each piece but the first is led by up to `overlap` bytes of the body before, from a word start
where there is one, read by a lookback on the piece before. All of it is built from SQL array functions.

A null text gives no pieces; a text within the limit is one piece as it stands. A cut is never made inside a
character; combining marks may be parted from their base only by the last alternative.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lontar.util import need

LIMIT, OVERLAP = 3000, 200

#: Sentence ends, as bytes: . ! ? and … ؟ ۔ 。, then closing quotes and brackets (ASCII, ” ’ »). A point ends no sentence after a number, a single letter or a short capitalised abbreviation.
CLOSERS = r"(?:[\"')\]]|\xE2\x80[\x9D\x99]|\xC2\xBB)"
ABBREVIATIONS = "hlm|jil|dst|dll|dsb|cet|no|vol"
SPACE = r"(?:[ \t\n\r]|\xC2\xA0|\xE2\x80[\x80-\x8A\xAF]|\xE3\x80\x80)"
LAST = r"[ \t\n\r\xA0\x80-\x8A\xAF]"


def _pattern(body: int) -> str:
    """Each boundary begins with a plain byte class, the last byte of what it ends at, so that most places are refused at once."""
    fill = max(2, body // 4)
    paragraph = r"\n(?<=\n[ \t]{0,8}\n)(?!\n)"
    line = r"\n"
    sentence = rf"{LAST}(?:(?<=[!?]{SPACE})|(?<=[!?]{CLOSERS}{SPACE})|(?<=(?:\xE2\x80\xA6|\xD8\x9F|\xDB\x94|\xE3\x80\x82){SPACE})|(?<=\.{CLOSERS}{SPACE})|(?<=\.{SPACE})(?<!(?:[ \n(.][A-Za-z]|[ \n(][A-Z][a-zA-Z]|[ \n(][0-9]{{1,4}}|[ \n(](?:{ABBREVIATIONS}))\.{SPACE}))"
    word = rf"{LAST}(?<={SPACE})(?!{SPACE})"
    alternatives = [rf".{{1,{body}}}\z"]
    for least in (fill, 1):
        alternatives += [rf".{{{least - 1},{body - 1}}}{b}" for b in (paragraph, line, sentence)]
    alternatives += [rf".{{0,{body - 1}}}{word}", rf".{{1,{body}}}(?![\x80-\xBF])"]
    return "(?s)(?:" + "|".join(alternatives) + ")"


def _overlap(previous: Column, overlap: int) -> Column:
    """Up to the last `overlap` bytes of a body: from a word start, else from a character start."""
    previous = F.right(previous, F.lit(overlap + 3))  # a space has up to three bytes
    at_word = F.regexp_extract(previous, rf"(?s)(?<={SPACE})(?!{SPACE}).{{1,{overlap}}}\z", 0)
    at_char = F.regexp_extract(previous, rf"(?s)(?![\x80-\xBF]).{{1,{overlap}}}\z", 0)
    return F.when(at_word != "", at_word).otherwise(at_char)


def _view(text: Column) -> Column:
    return F.decode(F.encode(text, "UTF-8"), "ISO-8859-1")


def _text(view: Column) -> Column:
    return F.decode(F.encode(view, "ISO-8859-1"), "UTF-8")


def bodies(text: Column, limit: int = LIMIT, overlap: int = OVERLAP) -> Column:
    """Array of the bodies of a text in the byte view; null for a null text."""
    found = F.regexp_extract_all(_view(text), F.lit(_pattern(limit - overlap)), F.lit(0))
    return F.when(F.octet_length(text) <= limit, F.array(_view(text))).otherwise(found)


def pieces(bodies: Column, overlap: int = OVERLAP) -> Column:
    """array<struct<body, lead>> of the bodies, each with the overlap that leads it.

    Give a materialised column: each body is paired with the one before it outside the lambda, which sees both once.
    """
    before = F.concat(F.array(F.lit("")), F.slice(bodies, 1, F.size(bodies) - 1))
    lead = lambda b: F.when((b == "") | F.lit(overlap <= 0), F.lit("")).otherwise(_overlap(b, overlap))
    return F.zip_with(bodies, before, lambda b, p: F.struct(_text(b).alias("body"), _text(lead(p)).alias("lead")))


def split_texts(texts: DataFrame, key: str, text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(key, piece_no, n_pieces, piece, lead_bytes, n_bytes): ordered pieces of the texts above the limit.

    piece = lead + body; the bodies of a text join to the text. One row of each key is used, however often delivered.
    """
    big = need(texts, [key, text]).where(F.octet_length(text) > limit).dropDuplicates([key])
    b = big.select(key, bodies(F.col(text), limit, overlap).alias("_b"))
    p = b.select(key, pieces(F.col("_b"), overlap).alias("_p")).select(key, F.size("_p").alias("n_pieces"), F.posexplode("_p").alias("piece_no", "_x"))
    piece = F.concat("_x.lead", "_x.body")
    return p.select(key, "piece_no", "n_pieces", piece.alias("piece"), F.octet_length("_x.lead").alias("lead_bytes"), F.octet_length(piece).alias("n_bytes"))
