"""Predicates over prose: violations, attributions, proximity, repair. Cue lists are parameters."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, StringType, StructField, StructType

from lontar.functions import text as T
from lontar.util import ship

ARABIC = "[\\x{0600}-\\x{06FF}\\x{0750}-\\x{077F}\\x{FB50}-\\x{FDFF}\\x{FE70}-\\x{FEFF}]"
MAX_UNITS = 60
# Milliseconds below which no retry is made, and the least first attempt that is cut short for one.
MIN_RETRY_MS, FIRST_FLOOR_MS, MAX_ATTEMPTS = 11_500, 13_000, 2


def pad(c: Column) -> Column:
    return F.concat(F.lit(" "), T.norm(c), F.lit(" "))


def has_any(padded: Column, cues: list[str]) -> Column:
    out = F.lit(False)
    for c in cues:
        out = out | F.contains(padded, F.lit(f" {c} "))
    return out


def foreign_script(c: Column, allowed: str) -> Column:
    """Arabic script once the allowed signs are deleted."""
    return F.regexp_replace(c, f"[{allowed}]", "").rlike(ARABIC)


def verdict_sentences(c: Column, verdicts: list[str], deferring: list[str]) -> Column:
    """Sentences with a verdict cue that do not defer."""
    return F.filter(T.sentences(c), lambda s: has_any(pad(s), verdicts) & ~has_any(pad(s), deferring))


def unbacked_attributions(c: Column, speech: list[str]) -> Column:
    """Sentences that attribute something without a reference in the same sentence."""
    pieces = F.filter(F.transform(F.split(c, r"[!?\n]+|\.(?:\s|$)"), lambda x: F.trim(x)), lambda x: x != "")
    return F.filter(pieces, lambda s: has_any(pad(s), speech) & (F.size(T.refs(s)) == 0))


def unlisted_refs(c: Column, allowed: Column) -> Column:
    return F.array_except(T.refs(c), F.coalesce(allowed, F.array().cast("array<string>")))


def invalid_refs(c: Column, chapters: int = 114) -> Column:
    return F.filter(T.refs(c), lambda r: ~F.split_part(r, F.lit(":"), F.lit(1)).cast("int").between(1, chapters))


def asks_ruling(c: Column, markers: list[str], frames: list[str], procedure: list[str], nouns: list[str]) -> Column:
    """Whether a question asks for a ruling: an affix form of a word is a marker, a frame (a pattern on the normalised
    text) fits, or a word of procedure stands beside a noun it applies to. Nouns of several words count as they stand."""
    n, forms = T.norm(c), F.flatten(F.transform(T.words_of(c), T.affix_forms))
    some = lambda words: F.arrays_overlap(forms, F.array(*[F.lit(w) for w in words]).cast("array<string>"))
    framed = F.lit(False)
    for f in frames:
        framed = framed | n.rlike(f)
    noun = some([w for w in nouns if " " not in w])
    for w in nouns:
        noun = noun | F.contains(n, F.lit(w)) if " " in w else noun
    return some(markers) | framed | (has_any(pad(c), procedure) & noun)


def needs_referral(c: Column, topic: str, other_sense: list[str], own_sense: list[str], action: list[str]) -> Column:
    """Whether a question is to be referred: it has the topic, in no other sense, in the sense meant, and asks what to do."""
    p = pad(c)
    return F.contains(p, F.lit(topic)) & ~has_any(p, other_sense) & has_any(p, own_sense) & has_any(p, action)


def question_form(c: Column, personal: list[str], forms: list[tuple[str, list[str]]]) -> Column:
    """The first form whose cue opens the question or stands in it as a word; personal if it speaks of oneself, none without any."""
    p = pad(c)
    return F.coalesce(F.when(has_any(p, personal), "personal"), *[F.when(has_any(p, cues), name) for name, cues in forms], F.lit("none"))


def violations(*rules: tuple[str, Column, Column]) -> Column:
    """Ordered array of (kind, detail) of the rules (kind, condition, detail) that hold; ok means none."""
    return F.array_compact(F.array(*[F.when(cond, F.struct(F.lit(k).alias("kind"), F.substring(detail, 1, 80).alias("detail"))) for k, cond, detail in rules]))


def safe_text(c: Column, found: Column) -> Column:
    return F.when(F.size(found) == 0, c)


def first_cue(c: Column, cues: list[str]) -> Column:
    """The first cue of the list, in list order, that the text has."""
    p = pad(c)
    return F.coalesce(*[F.when(F.contains(p, F.lit(f" {x} ")), x) for x in cues])


def reasons(*rules: tuple[str, Column]) -> Column:
    """The reasons that hold, joined by ' + '; null if none does."""
    return F.nullif(F.concat_ws(" + ", *[F.when(c, r) for r, c in rules]), F.lit(""))


def first_reason(*rules: tuple[str, Column]) -> Column:
    """The first failing rule; null for an accepted row."""
    return F.coalesce(*[F.when(c, r) for r, c in rules])


def proximity(subjects: list[str], acts: list[str], agents: list[str], window: int = 64):
    """UDF: whether a subject is followed by a speech act within `window` characters with no other agent between, nor one right before the subject."""

    def alternatives(words: list[str]) -> str:
        return "|".join(sorted(map(re.escape, words), key=len, reverse=True))

    subject, act, agent = (re.compile(rf"(?<!\w)(?:{alternatives(w)})(?!\w)", re.IGNORECASE) for w in (subjects, acts, agents))

    def check(t: str | None) -> bool:
        for m in subject.finditer(t or ""):
            near = t[m.end() : m.end() + window]
            a = act.search(near)
            if a and not agent.search(near[: a.start()]) and not re.search(rf"(?:{agent.pattern})\W*$", t[max(0, m.start() - 24) : m.start()], re.IGNORECASE):
                return True
        return False

    @F.pandas_udf(BooleanType())
    def run(s: pd.Series) -> pd.Series:
        return s.map(check)

    return run


def attributed_quotes(cues: list[str], min_words: int = 8, before: int = 160, beside: int = 48):
    """UDF: quoted spans of min_words and more with a cue in the characters before, or a reference beside."""
    quote = re.compile(r"[\"“]([^\"“”]+)[\"”]")
    cue = re.compile(rf"(?<!\w)(?:{'|'.join(map(re.escape, cues))})(?!\w)", re.IGNORECASE)
    ref = re.compile(r"(?<!\d)\d{1,3}\s*[:.]\s*\d{1,3}(?!\d)")

    def count(t: str | None) -> int:
        n = 0
        for m in quote.finditer(t or ""):
            if len(m[1].split()) >= min_words:
                near = t[max(0, m.start() - beside) : m.start()] + " " + t[m.end() : m.end() + beside]
                n += bool(cue.search(t[max(0, m.start() - before) : m.start()]) or ref.search(near))
        return n

    @F.pandas_udf(IntegerType())
    def run(s: pd.Series) -> pd.Series:
        return s.map(count)

    return run


Guard = Callable[[str], list[tuple[str, str]]]


def excise(text: str, guard: Guard) -> tuple[str | None, int]:
    """(clean text or None, paragraphs dropped): the fewest paragraph deletions a guard accepts, searched greedily.

    A deletion that lowers the number of violations goes before one that only changes which are reported; ties go to
    fewer violations, then to the shorter paragraph. Where none helps, one pair may be dropped, once. Texts of one
    paragraph or of more than MAX_UNITS are given up.
    """
    found = guard(text)
    if not found:
        return text, 0
    units = re.findall(r"(?s).+?(?:\n{2,}|\Z)", text)
    if not 2 <= len(units) <= MAX_UNITS:
        return None, 0
    kept, pair_left = set(range(len(units))), True

    def without(*gone: int) -> str:
        return "".join(u for i, u in enumerate(units) if i in kept and i not in gone)

    while True:
        moves = []
        for i in sorted(kept):
            t = without(i)
            if t.strip():
                v = guard(t)
                if len(v) < len(found) or (len(v) == len(found) and v != found):
                    moves.append((len(v) == len(found), len(v), len(units[i]), (i,)))
        if not moves and pair_left:
            pair_left = False
            for i in sorted(kept):
                for j in sorted(kept):
                    if i < j and without(i, j).strip():
                        v = guard(without(i, j))
                        if len(v) < len(found):
                            moves.append((False, len(v), len(units[i]) + len(units[j]), (i, j)))
        if not moves:
            return None, 0
        kept -= set(min(moves)[3])
        found = guard(without())
        if not found:
            clean = without().strip()
            return (clean, len(units) - len(kept)) if clean else (None, 0)


REPAIRED = StructType([StructField("text", StringType()), StructField("dropped", IntegerType())])


def repairer(guard: Guard):
    """UDF of excise() with a guard; a null text stays null."""

    @F.pandas_udf(REPAIRED)
    def run(s: pd.Series) -> pd.DataFrame:
        out = [excise(t, guard) if t else (t, 0) for t in s]
        return pd.DataFrame({"text": [t for t, _ in out], "dropped": [n for _, n in out]})

    return run


def attempt_budget(attempt: Column, remaining: Column) -> Column:
    """Milliseconds of the next attempt, null where none is made: a first attempt leaves room for a retry if it can."""
    capped = remaining - MIN_RETRY_MS
    return (
        F.when((attempt >= MAX_ATTEMPTS) | (remaining <= 0) | ((attempt > 0) & (remaining < MIN_RETRY_MS)), None)
        .when((attempt == 0) & (capped >= FIRST_FLOOR_MS), capped)
        .otherwise(remaining)
    )


def outcome(attempts: Column, deadline: int) -> Column:
    """Terminal state of an array of (ms, outcome): the first ok that ends before the deadline, else the last failure."""
    zero = F.struct(F.lit(0).cast("bigint").alias("t"), F.lit("none").alias("end"))

    def step(acc: Column, a: Column) -> Column:
        t = (acc.t + a.ms).cast("bigint")
        end = F.when(acc.end == "ok", acc.end).when(t > deadline, "timeout").otherwise(a.outcome)
        return F.struct(t.alias("t"), end.alias("end"))

    return F.aggregate(attempts, zero, step, lambda a: a.end)


ship(__name__)
