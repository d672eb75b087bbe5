"""Text functions as Column builders; Python UDFs only where offsets or Unicode decomposition are needed."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from lontar.util import ship

# Indonesian affixes and function words that both sides of a comparison must share, English words that
# give a leak away, words of time, the ways to write a reference, and Arabic marks.
STEM_PREFIXES = "memper|mempe|meng|meny|mem|men|me|ber|per|ter|di|ke|se|pe"
STEM_SUFFIXES = "kanlah|annya|kannya|inya|nya|kan|lah|kah|an|i"
AFFIX_PREFIXES = ("memper", "menyeng", "meng", "meny", "peng", "pem", "pen", "mem", "men", "ber", "ter", "per", "me", "di", "ke", "se", "pe")
AFFIX_SUFFIXES = ("kannya", "annya", "kan", "an", "nya", "ku", "mu", "i")
STOP_WORDS = (
    "yang dan di ke dari itu ini adalah dengan untuk pada tidak akan sebagai atau juga oleh dalam agar maka bagi para "
    "kamu kami mereka dia nya ia aku saya kita telah sudah lebih hanya karena bahwa apa saja sangat sekali antara serta "
    "ada tiap setiap"
).split()
STEM_ENDINGS = ("kan", "nya", "lah", "an", "i")
ENGLISH_WORDS = "the and with that will from your not for who every upon when there his her they them".split()
TIME_CUES = ("jam", "pukul", "pkl", "wib", "wit", "wita", "am", "pm", "pagi", "siang", "sore", "petang", "malam", "subuh", "dini hari", "tengah malam", "menit", "detik")
SURAH_WORD, AYAH_WORD = "sur(?:ah|at|a)?", r"(?:ayat|ayah|ay\.?)"
BARE_REF = r"(?:^|\s)(\d{1,3})\s*[:.]\s*(\d{1,3})(?:\s|$)"
WORDED_REF = rf"(?i){SURAH_WORD}\s*(\d{{1,3}})\s*{AYAH_WORD}\s*(\d{{1,3}})"
MARKED_REF = r"(?i)(?:^|\s)q\.?s\.?\s*(\d{1,3})\s*[:.]\s*(\d{1,3})"
NAMED_REF = rf"(?i)^(?:{SURAH_WORD}\s+)?([\p{{L}}\s'’-]+?)(?:\s+{AYAH_WORD}\s*(\d{{1,3}}))?$"
ARABIC_MARKS = "[\\x{0610}-\\x{061A}\\x{064B}-\\x{065F}\\x{0670}\\x{0640}]"
ARABIC_SAME = ("أإآٱىة", "اااايه")


def norm(c: Column) -> Column:
    """Lower case; everything but letters, digits, white space and hyphens becomes a space; spaces collapse."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}\s-]", " "), r"\s+", " "))


def parts(c: Column, pattern: str = " ") -> Column:
    """Non-empty parts."""
    return F.filter(F.split(c, pattern), lambda x: x != "")


def word_set(c: Column) -> Column:
    """Distinct words of the normalised text, split on spaces only."""
    return F.array_distinct(parts(norm(c)))


def words_of(c: Column) -> Column:
    """Words of the normalised text, split on spaces and hyphens."""
    return parts(norm(c), "[ -]")


def long_words(c: Column, more_than: int, letters_only: bool = False) -> Column:
    """Distinct words of more than so many characters, of letters and digits or of letters only."""
    kept = r"[^\p{L}]+" if letters_only else r"[^\p{L}\p{N}]+"
    return F.array_distinct(F.filter(parts(F.regexp_replace(F.lower(c), kept, " ")), lambda x: F.length(x) > more_than))


def jaccard(a: Column, b: Column, empty: float = 1.0) -> Column:
    """Of two arrays of distinct words; `empty` where either has none."""
    both = F.size(F.array_intersect(a, b)).cast("double")
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(empty)).otherwise(both / (F.size(a) + F.size(b) - both))


def stem(w: Column) -> Column:
    """Light stem: restores a consonant lost under men-, mem-, meny- before a vowel, or strips one prefix; then strips one suffix. Under 3 characters left: the word."""
    s = (
        F.when(w.rlike("^men[aeiou]"), F.concat(F.lit("t"), F.substr(w, F.lit(4))))
        .when(w.rlike("^mem[aeiou]"), F.concat(F.lit("p"), F.substr(w, F.lit(4))))
        .when(w.rlike("^meny[aeiou]"), F.concat(F.lit("s"), F.substr(w, F.lit(5))))
        .otherwise(F.regexp_replace(w, f"^({STEM_PREFIXES})", ""))
    )
    s = F.regexp_replace(s, f"({STEM_SUFFIXES})$", "")
    return F.when(F.length(s) >= 3, s).otherwise(w)


def stems_of(c: Column) -> Column:
    """Stems, in order, of the words that are no function words; at least 3 characters."""
    w = parts(F.regexp_replace(F.lower(c), "[^a-z0-9' ]+", " "), r"\s+")
    kept = F.filter(w, lambda x: ~x.isin(*STOP_WORDS))
    return F.filter(F.transform(kept, stem), lambda x: F.length(x) >= 3)


def stem_set(c: Column) -> Column:
    """Distinct stems of the words that are no function words; each different word is stemmed once."""
    w = F.array_distinct(parts(F.regexp_replace(F.lower(c), "[^a-z0-9' ]+", " "), r"\s+"))
    kept = F.filter(w, lambda x: ~x.isin(*STOP_WORDS))
    return F.array_distinct(F.filter(F.transform(kept, stem), lambda x: F.length(x) >= 3))


def affix_forms(w: Column) -> Column:
    """The word, without one prefix (the first of the list that leaves more than 2 characters), and each without up to two suffixes."""

    def without_suffix(x: Column) -> Column:
        out = F.lit(None).cast("string")
        for s in reversed(AFFIX_SUFFIXES):
            out = F.when((F.length(x) > len(s) + 2) & x.endswith(s), F.substr(x, F.lit(1), F.length(x) - len(s))).otherwise(out)
        return out

    body = F.lit(None).cast("string")
    for p in reversed(AFFIX_PREFIXES):
        body = F.when((F.length(w) > len(p) + 2) & w.startswith(p), F.substr(w, F.lit(len(p) + 1))).otherwise(body)
    out = F.array(w, body)
    one = F.transform(out, without_suffix)
    two = F.transform(one, without_suffix)
    return F.array_distinct(F.array_compact(F.concat(out, one, two)))


def suffix_forms(w: Column) -> Column:
    """The word, and without each suffix that leaves at least 4 characters, in the order of the list."""
    return F.array_compact(F.array(w, *[F.when(w.endswith(s) & (F.length(w) >= len(s) + 4), F.substr(w, F.lit(1), F.length(w) - len(s))) for s in STEM_ENDINGS]))


def stem_reach(asked: Column, written: Column) -> Column:
    """Equal, or the asked word of 4 characters and more begins the written one."""
    return (asked == written) | ((F.length(asked) >= 4) & written.startswith(asked))


def phrase_hit(padded: Column, phrase: Column) -> Column:
    """Whether a phrase of plain words stands in a space-padded text, its last word with one suffix or none."""
    ends = "|".join(sorted(AFFIX_SUFFIXES, key=len, reverse=True))
    return F.regexp_like(padded, F.concat(F.lit(" "), phrase, F.lit(f"(?:{ends})? ")))


def refs(c: Column) -> Column:
    """Chapter:verse references, leading zeros dropped, distinct, in order. A separator may be : or a point."""
    found = F.regexp_extract_all(c, F.lit(r"(?:^|[^0-9A-Za-z_])([0-9]{1,3}\s*[:.]\s*[0-9]{1,3})(?=[^0-9A-Za-z_]|$)"), F.lit(1))
    return F.array_distinct(F.transform(found, lambda x: F.regexp_replace(F.regexp_replace(F.regexp_replace(x, r"\s", ""), r"\.", ":"), r"(^|:)0+([0-9])", "$1$2")))


def markers(c: Column) -> Column:
    """Distinct ids collection/number of [H:collection:number] markers, in order."""
    found = F.regexp_extract_all(c, F.lit(r"\[H:([a-z0-9-]+:[0-9]+)\]"), F.lit(1))
    return F.array_distinct(F.transform(found, lambda x: F.replace(x, F.lit(":"), F.lit("/"))))


def marker(collection: Column, number: Column) -> Column:
    return F.concat(F.lit("[H:"), collection, F.lit(":"), number.cast("string"), F.lit("]"))


def without_markers(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s*\[H:[a-z0-9-]+:[0-9]+\]", ""))


def quoted_spans(c: Column, least: int = 12) -> Column:
    """Contents of double quotes, straight or typographic, of at least so many characters."""
    return F.regexp_extract_all(c, F.lit(f"[\"“]([^\"“”]{{{least},}})[\"”]"), F.lit(1))


def clean_markup(c: Column) -> Column:
    """Line breaks and tags become spaces, three entities are read, spaces collapse."""
    s = F.regexp_replace(F.regexp_replace(c, r"(?i)<br\s*/?>", " "), "<[^>]*>", " ")
    for a, b in (("&nbsp;", " "), ("&quot;", '"'), ("&amp;", "&")):
        s = F.replace(s, F.lit(a), F.lit(b))
    return F.trim(F.regexp_replace(s, r"\s+", " "))


def html_escape(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def slugify(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def bounded(c: Column, n: int) -> Column:
    return F.left(c, F.lit(n))


def cut_at_word(c: Column, n: int) -> Column:
    """At most n characters up to a word end, with an ellipsis if something was cut."""
    return F.when(F.length(c) <= n, c).otherwise(F.concat(F.regexp_replace(F.left(c, F.lit(n)), r"\s+\S*$", ""), F.lit("…")))


def one_line(c: Column, n: int) -> Column:
    """White space flattened, at most n characters, the last an ellipsis if something was cut."""
    flat = F.trim(F.regexp_replace(c, r"\s+", " "))
    return F.when(F.length(flat) <= n, flat).otherwise(F.concat(F.left(flat, F.lit(n - 1)), F.lit("…")))


def time_label(seconds: Column) -> Column:
    """H:MM:SS, or M:SS under an hour; fractions are dropped."""
    s = F.floor(seconds).cast("bigint")
    h, m, r = F.floor(s / 3600), F.floor(s / 60) % 60, s % 60
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    return F.when(s >= 3600, F.concat_ws(":", h.cast("string"), two(m), two(r))).otherwise(F.concat_ws(":", m.cast("string"), two(r)))


def arabic_fold(c: Column) -> Column:
    """Without vowel marks and kashida; forms of alif, ya and ta marbuta unified."""
    return F.translate(F.regexp_replace(c, ARABIC_MARKS, ""), *ARABIC_SAME)


def _latin_fold(s: str | None) -> str | None:
    if s is None:
        return None
    d = "".join(ch for ch in unicodedata.normalize("NFD", s.lower()) if unicodedata.category(ch) != "Mn")
    return re.sub(r"['’ʾʿ`._\-\s]", "", d)


@F.pandas_udf(StringType())
def latin_fold(s: pd.Series) -> pd.Series:
    """Lower case without accents, apostrophes, hyphens, points, underscores and spaces. For distinct names."""
    return s.map(_latin_fold)


def variant_index(c: Column, n: int) -> Column:
    """Which of n variants a text gets: 31-multiplier hash over 32 bits, absolute value, modulo n."""
    h = F.aggregate(F.split(c, ""), F.lit(0).cast("bigint"), lambda a, x: F.when(x == "", a).otherwise((a * 31 + F.ascii(x)).bitwiseAND(4294967295)))
    signed = F.when(h >= 2147483648, h - 4294967296).otherwise(h)
    return F.pmod(F.abs(signed), F.lit(n))


def sentences(c: Column) -> Column:
    """Pieces between sentence ends and line ends, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(c, r"[.!?\n]+"), lambda x: F.trim(x)), lambda x: x != "")


def paragraphs(c: Column) -> Column:
    """Paragraphs with the blank lines that follow them: joined they give the text."""
    return F.regexp_extract_all(c, F.lit(r"(?s).+?(?:\n{2,}|\z)"), F.lit(0))


def strip_inline_markdown(c: Column) -> Column:
    c = F.regexp_replace(c, r"!?\[([^\]]*)\]\([^)]*\)", "$1")
    c = F.regexp_replace(c, r"(\*\*|__)([^*_]+)(\*\*|__)", "$2")
    c = F.regexp_replace(c, r"[*_`]([^*_`]+)[*_`]", "$1")
    return F.trim(c)


def title_echo(title: Column, line: Column, share: float = 0.6) -> Column:
    """Whether a line repeats a title: at least 2 title words of 4 letters and more, and this share of them in the line."""
    t = F.filter(word_set(title), lambda x: F.length(x) >= 4)
    return (F.size(t) >= 2) & (F.size(F.array_intersect(t, word_set(line))) >= F.size(t) * share)


def tolerant_json(c: Column, schema: str) -> Column:
    """Parsed from the first { to the last }; null if that is no object of the schema."""
    return F.from_json(F.regexp_extract(c, r"(?s)\{.*\}", 0), schema, {"mode": "PERMISSIVE"})


def list_or_lines(c: Column) -> Column:
    """A JSON list of strings, else the lines or comma-separated parts without bullets."""
    lines = F.transform(F.split(c, r"[\n,]"), lambda x: F.trim(F.regexp_replace(x, r"^\s*(?:[-*•]|[0-9]+[.)])\s*", "")))
    return F.coalesce(F.from_json(c, "array<string>"), F.filter(lines, lambda x: x != ""))


def first_int(c: Column, path: str) -> Column:
    """A JSON member as integer, else the first integer in the text."""
    return F.coalesce(F.get_json_object(c, path).try_cast("int"), F.regexp_extract(c, "-?[0-9]+", 0).try_cast("int"))


_MARK = re.compile(r"(?i)\b(?:qs|q\.s|surah|surat|ayat|quran|qur'an|qur’an)\b")
_STRICT = re.compile(r"(?<![0-9:])([0-9]{1,3}):([0-9]{1,3})(?![0-9])")


def _strict_refs(text: str | None) -> list[str] | None:
    if text is None:
        return None
    out, last = [], -1000
    for m in _STRICT.finditer(text):
        if not 1 <= int(m[1]) <= 114:
            continue
        before = text[max(0, m.start() - 40) : m.start()]
        if _MARK.search(before) or m.start() - last <= 40:
            last = m.end()
            ref = f"{int(m[1])}:{int(m[2])}"
            if ref not in out:
                out.append(ref)
    return out


@F.pandas_udf(ArrayType(StringType()))
def strict_refs(s: pd.Series) -> pd.Series:
    """References with a colon and a chapter from 1 to 114 that follow a citation mark, or another such reference, within 40 characters."""
    return s.map(_strict_refs)


def longest_run(a: list[str], b: list[str]) -> int:
    """Longest contiguous run of words that two lists share."""
    best, before = 0, [0] * (len(b) + 1)
    for x in a:
        row = [0] * (len(b) + 1)
        for j, y in enumerate(b, 1):
            if x == y:
                row[j] = before[j - 1] + 1
                best = max(best, row[j])
        before = row
    return best


def without_formula(c: Column, formula: str, first: Column, exempt: Column) -> Column:
    """The text without a leading formula, on first rows outside exempt groups; one that does not begin with it, marks and letter variants aside, fails the job."""
    n = len(formula.split())
    words = F.split(c, " ")
    opens = arabic_fold(F.array_join(F.slice(words, 1, n), " ")) == arabic_fold(F.lit(formula))
    rest = F.array_join(F.slice(words, n + 1, F.greatest(F.size(words) - n, F.lit(0))), " ")
    return F.when(~first | exempt, c).when(opens, rest).otherwise(F.raise_error(F.concat(F.lit("no formula: "), F.left(c, F.lit(40)))))


def with_synonyms(words: Column, synonyms: dict[str, str]) -> Column:
    """Words and, for those listed, the word they stand for; distinct, in order."""
    m = F.create_map(*[F.lit(x) for kv in synonyms.items() for x in kv])
    return F.array_distinct(F.flatten(F.transform(words, lambda w: F.array_compact(F.array(w, F.try_element_at(m, w))))))


def alias_hit(words: Column, alias: Column) -> Column:
    """Whether all words of an alias are among the words, in any order and with an enclitic or none."""
    bare = F.transform(words, lambda w: F.regexp_replace(w, "(?<=...)(?:nya|ku|mu|kah|lah)$", ""))
    return F.size(F.array_except(F.split(alias, " "), F.concat(words, bare))) == 0


def outside_phrases(c: Column, phrases: list[str]) -> Column:
    """Words of a text that stand outside fixed phrases; removal repeats until the text is stable, as one may uncover another."""

    @F.pandas_udf(StringType())
    def strip(s: pd.Series) -> pd.Series:
        def one(t):
            before = None
            while t is not None and t != before:
                before = t
                for p in phrases:
                    t = t.replace(f" {p} ", " ")
            return t

        return s.map(one, na_action="ignore")

    return F.array_distinct(parts(strip(F.concat(F.lit(" "), norm(c), F.lit(" "))), r"\s+"))


def linkify(c: Column, base: str) -> Column:
    """References chapter:verse as Markdown links."""
    return F.regexp_replace(c, r"(^|[^0-9A-Za-z_:])([0-9]{1,3}):([0-9]{1,3})(?=[^0-9A-Za-z_:]|$)", rf"$1[$2:$3]({base}/$2/$3)")


def failure_class(c: Column) -> Column:
    """Kind of a failure by its message; the first pattern that matches."""
    m = F.lower(c)
    return F.when(m.rlike("timed? ?out|deadline"), "timeout").when(m.rlike("429|rate limit"), "limited").when(m.rlike("40[13]|denied"), "denied").when(m.rlike("5[0-9][0-9]|unavailable"), "server").otherwise("other")


def opens_dangling(c: Column, openers: list[str]) -> Column:
    """Whether a text opens with a word that points back to something before it."""
    first = F.regexp_extract(norm(c), r"^([^\s]+)", 1)
    return first.isin(*openers)


def whole_word(words) -> str:
    """A pattern of one of these words between ASCII word boundaries, in any case, that Java and RE2 read alike."""
    return rf"(?i)(?:^|[^A-Za-z0-9_])(?:{'|'.join(words)})(?:$|[^A-Za-z0-9_])"


def english_leak(c: Column) -> Column:
    """The first English function word in a text of another language, in lower case; null without one."""
    found = F.regexp_extract(c, rf"(?i)(?:^|[^A-Za-z0-9_])({'|'.join(ENGLISH_WORDS)})(?:$|[^A-Za-z0-9_])", 1)
    return F.nullif(F.lower(found), F.lit(""))


def written_ref(c: Column) -> Column:
    """struct(form, surah, ayah, name): the reference that a message is, by the first form that fits.

    bare: N:M or N.M by itself, unless the message speaks of time; worded: surat N ayat M; marked: QS N:M; named: the
    whole message is a name, with a word for surah before it or a verse after it or neither; none. Numbers are not
    checked here.
    """
    q = F.trim(c)
    n = lambda pattern, k: F.regexp_extract(q, pattern, k).try_cast("int")
    form = F.when(q.rlike(BARE_REF) & ~q.rlike(whole_word(TIME_CUES)), "bare").when(q.rlike(WORDED_REF), "worded").when(q.rlike(MARKED_REF), "marked").when((q != "") & q.rlike(NAMED_REF), "named").otherwise("none")
    number = lambda k: F.when(form == "bare", n(BARE_REF, k)).when(form == "worded", n(WORDED_REF, k)).when(form == "marked", n(MARKED_REF, k))
    return F.struct(form.alias("form"), number(1).alias("surah"), F.coalesce(number(2), F.when(form == "named", n(NAMED_REF, 2))).alias("ayah"), F.when(form == "named", F.regexp_extract(q, NAMED_REF, 1)).alias("name"))


def lossless_sentences(c: Column, marker: str = r"(?:\s*\[H:[a-z0-9-]+:[0-9]+\])*") -> Column:
    """Sentences with the white space and the reference markers that follow them: joined they give the text."""
    return F.regexp_extract_all(c, F.lit(rf"(?s).+?(?:[.!?؟]+[\"'”’)\]]*{marker}(?:\s+|\z)|\n+|\z)"), F.lit(0))


ship(__name__)
