"""Text functions as Column expressions; pandas UDFs only for what Spark lacks (NFKC, case folding, display width, sequence matching)."""

from __future__ import annotations

import re
import unicodedata
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType

#: Fixed values.
PROTOCOL_MARKERS = ("<|audio|>", "<|im_start|>", "<|im_end|>", "<|endoftext|>")
ROLE_WORDS = ("language", "transcription", "transcript", "text")
SENTENCE_END, CLAUSE_END = ".?!。？！…", ",;:，；：、"
WORD = r"[\p{L}\p{N}]+(?:['’][\p{L}\p{N}]+)*(?:-[\p{L}\p{N}]+(?:['’][\p{L}\p{N}]+)*)*"
EDGE = r"[\p{L}\p{N}]+(?:['’][\p{L}\p{N}]+)*"
LINE_END = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]"


def normalize_value(text: str) -> str:
    """NFKC, case folding, then letters and numbers alone."""
    return "".join(c for c in unicodedata.normalize("NFKC", text).casefold() if unicodedata.category(c)[0] in "LN")


_GROUP = re.compile("[{0}]|[^\\W_{0}]+".format("\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\u3040-\u30ff\uac00-\ud7af"))


def mapping_groups_value(text: str, lang: str = "") -> list[str]:
    """What is matched as a whole (see ``joining.mapping_groups``, the same rule on columns)."""
    if lang in ("Chinese", "Cantonese", "zh", "yue"):
        return list(normalize_value(text))
    folded_ = unicodedata.normalize("NFKC", text).casefold()
    groups = _GROUP.findall(re.sub(r"(?<=[^\W_])['’.-](?=[^\W_])", "", folded_))
    return [g for g in map(normalize_value, groups) if g]


def width_value(text: str) -> int:
    """Columns of a terminal: two for wide and full-width characters, none for combining and control ones."""
    if text.isascii() and text.isprintable():
        return len(text)
    return sum(0 if unicodedata.combining(c) or unicodedata.category(c) in ("Cc", "Cf", "Mn", "Me", "Cn", "Zl", "Zp") else 1 + (unicodedata.east_asian_width(c) in "WF") for c in text)


@F.pandas_udf(StringType())
def folded(text: pd.Series) -> pd.Series:
    """Compatibility forms resolved and case folded."""
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t).casefold())


@F.pandas_udf(StringType())
def unit(text: pd.Series) -> pd.Series:
    """The same without blanks around: a word as word lists know it."""
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t).casefold().strip())


@F.pandas_udf(StringType())
def normalize(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else normalize_value(t))


@F.pandas_udf(LongType())
def display_units(text: pd.Series) -> pd.Series:
    return text.fillna("").map(width_value)


@F.pandas_udf(DoubleType())
def match_ratio(expected: pd.Series, actual: pd.Series) -> pd.Series:
    """Twice the matched characters over all, by longest matching blocks, on normalised text; empty only equals empty."""

    def one(a: str, b: str) -> float:
        a, b = normalize_value(a or ""), normalize_value(b or "")
        if not a or not b:
            return float(a == b)
        return 1.0 if a == b else SequenceMatcher(None, a, b, autojunk=False).ratio()

    return pd.Series([one(a, b) for a, b in zip(expected, actual)])


def visible_punctuation(text: Column) -> Column:
    return text.rlike(r"\p{P}")


def only_punctuation(text: Column) -> Column:
    return F.regexp_replace(text, r"[^\p{P}]", "")


def collapse_closing(text: Column) -> Column:
    """Commas directly after a stronger mark go."""
    return F.regexp_replace(text, "([.。!！?？:：;；])[,，、]+", "$1")


def trim_end_punctuation(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)[\p{P}\s\x1C-\x1F]+\z", "")


def ends_with(text: Column, marks: str) -> Column:
    """Whether the last character, but for blanks and closing brackets, is one of ``marks``."""
    return text.rlike(rf"[{marks}][\s\p{{Pe}}\p{{Pf}}]*\z")


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def split_blank(text: Column) -> Column:
    return F.filter(F.split(text, r"[ \t\n\x0B\f\r]+"), lambda x: x != "")


def _bound(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _one_character(text: Column) -> Column:
    """Whether one character makes up nine tenths of the others than blanks. One that does stands five times in a row somewhere (or
    is all of a shorter text), so only characters that do are counted; nothing is sorted."""
    bare = F.regexp_replace(text, r"\s", "")

    def counted(t: Column) -> Column:
        n = F.length(t)
        share = lambda c: (n - F.length(F.replace(t, c, F.lit("")))) >= n * 0.9
        return F.when(n == 0, False).when(n < 5, t == F.repeat(F.left(t, F.lit(1)), n)).otherwise(F.exists(F.array_distinct(F.regexp_extract_all(t, F.lit(r"(.)\1{4}"), F.lit(1))), share))

    return _bound(bare, counted)


def _one_word(words: Column) -> Column:
    """Whether one of at least 16 words makes up four fifths of them: the word that a majority vote leaves is counted."""
    empty = F.struct(F.lit("").alias("w"), F.lit(0).alias("n"))
    vote = lambda a, w: F.when(a.n == 0, F.struct(w.alias("w"), F.lit(1).alias("n"))).when(a.w == w, F.struct(a.w.alias("w"), (a.n + 1).alias("n"))).otherwise(F.struct(a.w.alias("w"), (a.n - 1).alias("n")))
    share = lambda items: _bound(F.aggregate(items, empty, vote).w, lambda left: F.size(F.filter(items, lambda x: x == left)) >= F.size(items) * 0.8)
    return _bound(words, lambda items: F.when(F.size(items) >= 16, share(items)).otherwise(False))


def abnormal(text: Column) -> Column:
    """Role words alone, protocol markers, or long text that is nearly all one character or one word."""
    value = F.trim(text)
    bare = F.regexp_replace(F.lower(value), "^[ :.!。！]+|[ :.!。！]+$", "")
    marked = F.lit(False)
    for m in PROTOCOL_MARKERS:
        marked = marked | value.contains(m)
    return F.when(F.length(value) >= 128, marked | _one_character(value) | _one_word(split_blank(F.lower(value))) | bare.isin(*ROLE_WORDS)).otherwise(marked | bare.isin(*ROLE_WORDS))


def repeated_suffix(items: Column, times: int = 20, longest: int = 20) -> Column:
    """Whether the items end in ``times`` repeats of one pattern of at most ``longest`` items."""

    def any_size(tail: Column) -> Column:
        def repeats(k: Column) -> Column:
            enough = F.size(tail) >= k * times
            size = F.when(enough, k * (times - 1)).otherwise(F.lit(0))
            first = F.when(enough, F.size(tail) - k * times + 1).otherwise(F.lit(1))
            return enough & (F.slice(tail, first, size) == F.slice(tail, first + k, size))

        return F.exists(F.sequence(F.lit(1), F.lit(longest)), repeats)

    most = times * longest
    last = lambda all_: F.slice(all_, F.greatest(F.lit(1), F.size(all_) - most + 1), F.lit(most))
    return _bound(_bound(items, last), any_size)


def occurrences(text: Column, find: str) -> Column:
    """Occurrences of a literal, overlapping ones too."""
    return F.regexp_count(text, F.lit("(?=\\Q" + find + "\\E)"))


def replacements(text: Column, find: str) -> Column:
    """How many replacements ``replace`` makes."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(find), F.lit("")))) / len(find)).cast("long")


def joined(tokens: Column) -> Column:
    """Tokens with a blank between, but none before closing and after opening marks."""
    text = F.array_join(tokens, " ")
    text = F.regexp_replace(text, r" ([.?!。？！…,;:，；：、\p{Pe}\p{Pf}])", "$1")
    return F.trim(F.regexp_replace(text, r"([\p{Ps}\p{Pi}]) ", "$1"))


def redacted(text: Column, longest: int = 500) -> Column:
    """One line without credentials, at most ``longest`` characters."""
    text = F.regexp_replace(text, r"\s+", " ")
    for rx, shown in ((r"Bearer\s+[A-Za-z0-9._~+/=-]+", "Bearer [redacted]"), (r"sb_[A-Za-z0-9_-]+", "sb_[redacted]"), (r"hf_[A-Za-z0-9_-]+", "hf_[redacted]"), (r"sk-[A-Za-z0-9_-]+", "sk-[redacted]")):
        text = F.regexp_replace(text, rx, shown)
    return F.when(F.length(text) > longest, F.concat(F.substring(text, 1, longest - 3), F.lit("..."))).otherwise(text)


def log_field(text: Column, fallback: str = "unknown") -> Column:
    """A field of a log line: letters, digits and ._- alone, at most 64 characters."""
    out = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"[\r\n\t]+", " "), r"\s+", "_"), r"[^A-Za-z0-9._-]", "_")
    out = F.when(out == "", fallback).otherwise(out)
    return F.when(F.length(out) > 64, F.concat(F.substring(out, 1, 61), F.lit("..."))).otherwise(out)


def file_name(title: Column, job: Column) -> Column:
    """The name of a temporary file: a title's letters, digits and hyphens, at most 64 characters, and a job's."""
    safe = F.substring(F.regexp_replace(F.coalesce(title, F.lit("Timeline")), "[^A-Za-z0-9-]+", "_"), 1, 64)
    return F.concat(safe, F.lit("_"), F.regexp_replace(job, "[^A-Za-z0-9-]", ""), F.lit("_audio_temp"))


def without_paths(text: Column, names: dict[str, str], longest: int = 1000) -> Column:
    """A message with private paths named instead of shown, cut to a length."""
    for path, name in names.items():
        text = F.replace(text, F.lit(path), F.lit(name))
    return F.substring(text, 1, longest)


def url_encoded(text: Column) -> Column:
    """Percent encoding that leaves letters, digits and -_.~ as they are."""
    out = F.url_encode(text)
    for a, b in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def fixed(x: Column, pattern: str) -> Column:
    """A number with a pattern's decimals, halves of its binary value to the even digit (``format_string`` rounds them up)."""
    return F.call_function("format_number", x, F.lit(pattern))


def bytes_shown(n: Column) -> Column:
    """A number of bytes in units of 1000."""
    shown = lambda x, pattern, unit: F.concat(fixed(x, pattern), F.lit(unit))
    return F.when(n >= 1e9, shown(n / 1e9, "0.00", " GB")).when(n >= 1e6, shown(n / 1e6, "0", " MB")).when(n >= 1e3, shown(n / 1e3, "0", " KB")).otherwise(F.format_string("%d B", F.floor(n)))


def version_newer(candidate: Column, current: Column) -> Column:
    """Whether a version ``vX.Y.Z`` is later than another; false where one is none."""

    def parsed(v: Column) -> Column:
        bare = F.regexp_replace(F.regexp_replace(F.trim(v), "^[vV]", ""), r"^([^+-]+).*$", "$1")
        part = lambda i: F.regexp_extract(bare, r"^(\d+)\.(\d+)\.(\d+)$", i).cast("long")
        return F.when(bare.rlike(r"^\d+\.\d+\.\d+$"), F.struct(part(1).alias("a"), part(2).alias("b"), part(3).alias("c")))

    return F.coalesce(parsed(candidate) > parsed(current), F.lit(False))
