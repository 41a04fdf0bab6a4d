"""Quality rules: base counts, and the content share of a line sequence labelling.

Lines are labelled content or boilerplate by a linear-chain CRF (``crf_lines``); the share of a
document's words in content lines decides whether it is kept. The CRF is fitted on a
bounded sample of labelled documents (``sample_rows`` of each label, by hash of the id, so any run takes the same
ones, one text for each id, of ``sample_bytes`` at most). Labels are of documents, so those of lines are learnt with them (multiple instances): a first
model of single lines scores each line; of a good document at least half the words stay content, of a bad one more than half become
boilerplate, the lines most like it first, and other lines follow their own score. The CRF learns from these, labels the lines anew under the
same rule, and learns again, so prose in a junk page counts as content and a menu inside prose as boilerplate.
Counts and labelling read every whole text.

Defined results: null reads as empty; a text without words has base_failed true and kept false;
repeated rows are judged each; an empty table gives none; without usable labels the
built-in weights of ``PRIOR`` decide; other columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import crf_lines
from tidemark.llm.common import batches, text_of

SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, content_share double"
SYMBOLS = "#*$%&|<>"
FEATURES = ("one", "symbols a character", "capitals a letter", "marks a word", "repeated words", "an earlier line", "long", "one word", "digits a character", "license")
_LICENSE = re.compile(r"licen[sc]ed under|all rights reserved|terms of use|privacy policy|cookie|copyright", re.I)
_WORD = re.compile(r"[^\x20\x09-\x0D]")
#: Brings each feature to about one where it is present.
_SCALE = np.array([1.0, 12, 3, 2, 3, 1, 1, 1, 5, 1])
#: Without labels: junk marks, shouting and repetition speak against a line.
PRIOR = {"w": np.array([[-2.0, 2.0], [2, -2], [2, -2], [2, -2], [2, -2], [1, -1], [0, 0], [0, 0], [1, -1], [1, -1]]) / 2, "a": np.eye(2) / 2, "s": np.zeros(2)}


def _mask(points) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(points)] = True
    return out


_WHITE = _mask([32, *range(9, 14)])
_SYMBOL = _mask(map(ord, SYMBOLS))
_CAPITAL = _mask(i for i in range(256) if chr(i).isupper())
_LETTER = _mask(i for i in range(256) if chr(i).isalpha())
_DIGIT = _mask(range(48, 58))
_MARK = _mask(map(ord, "!?;:~^=+_{}[]\\/@"))


def measured(text: str) -> tuple[tuple[int, int, int, int, int], np.ndarray, np.ndarray]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words), features of the lines with a word, their words."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    low = np.minimum(points, 255).astype(np.uint8)
    low[points > 254] = 255  # a letter of no other class
    white = _WHITE[low]
    lines = text.split("\n")
    starts = np.concatenate([[0], np.cumsum([len(x) + 1 for x in lines])])

    def by_line(mask: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(mask)])
        return np.diff(sums[np.minimum(starts, len(mask))])

    solid = ~white
    begins = solid.copy()
    begins[1:] &= white[:-1]
    words, chars, symbols = by_line(begins), by_line(solid), by_line(_SYMBOL[low])
    ids: dict[bytes, int] = {}
    seq = np.array([ids.setdefault(w, len(ids)) for w in text.encode("utf-8", "surrogatepass").split()], np.int64)
    n = len(seq)
    again = np.zeros(n, bool)
    if n >= 3:
        pairs = seq[:-1] * len(ids) + seq[1:]
        if len(ids) >= 1 << 20:  # three ids no longer fit in 63 bits
            pairs = np.unique(pairs, return_inverse=True)[1]
        _, where, count = np.unique(pairs[:-1] * len(ids) + seq[2:], return_inverse=True, return_counts=True)
        twice = count[where] > 1
        again[:-2] |= twice
        again[1:-1] |= twice
        again[2:] |= twice
    seen: set[str] = set()
    dup = np.zeros(len(lines), bool)
    for i, line in enumerate(lines):
        if words[i]:
            dup[i] = line in seen
            seen.add(line)
    counts = (n, int(solid.sum()), int(symbols.sum()), int(dup.sum()), int(again.sum()))
    has = words > 0
    w = words[has]
    ends = np.concatenate([[0], np.cumsum(w)])
    repeated = np.diff(np.concatenate([[0], np.cumsum(again)])[ends]) / w if n else np.zeros(0)
    c = chars[has]
    licensed = np.array([bool(_LICENSE.search(x)) for x, h in zip(lines, has) if h], float)
    features = np.stack([np.ones(len(w)), symbols[has] / c, by_line(_CAPITAL[low])[has] / np.maximum(1, by_line(_LETTER[low])[has]), np.minimum(3, by_line(_MARK[low])[has] / w), repeated, dup[has], np.minimum(1, np.log1p(w) / 6), w == 1, by_line(_DIGIT[low])[has] / c, licensed], 1)
    return counts, features * _SCALE, w


def _ruled(y: np.ndarray, odds: np.ndarray, words: np.ndarray, good: bool) -> np.ndarray:
    """Line labels made to agree with the document's: over half of the words on its side, the lines most like that first."""
    want = crf_lines.CONTENT if good else crf_lines.BOILERPLATE
    out, order = y.copy(), np.argsort(-odds if good else odds, kind="stable")
    have, need = int(words[out == want].sum()), words.sum() / 2
    for i in order:
        if have > need or (good and have >= need):
            break
        if out[i] != want:
            out[i] = want
            have += int(words[i])
    return out


def learnt(bags: list[tuple[np.ndarray, np.ndarray, bool]], rounds: int = 3) -> dict[str, np.ndarray]:
    """The CRF, from (line features, words of the lines, whether the document is good)."""
    single = crf_lines.train([x[i : i + 1] for x, _, _ in bags for i in range(len(x))], [np.array([int(good)]) for x, _, good in bags for _ in range(len(x))])
    odds = [x @ (single["w"][:, 1] - single["w"][:, 0]) + single["s"][1] - single["s"][0] for x, _, _ in bags]
    labels = [(o > (-1 if good else 0)).astype(np.int8) for o, (_, _, good) in zip(odds, bags)]
    for _ in range(rounds):
        ruled = [_ruled(y, o, w, good) for y, o, (_, w, good) in zip(labels, odds, bags)]
        model = crf_lines.train([x for x, _, _ in bags], ruled)
        labels = crf_lines.viterbi(model, [x for x, _, _ in bags])
        odds = [x @ (model["w"][:, 1] - model["w"][:, 0]) for x, _, _ in bags]
    return model


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = 700, sample_bytes: int = 500_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> dict[str, np.ndarray]:
    """The CRF, from at most ``sample_rows`` labelled documents of each label, texts of more than ``sample_bytes`` not among them."""
    one = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.min(label_col).alias("y"), F.max(label_col).alias("z")).where("y = z")
    rank = F.xxhash64(F.col(id_col).cast("string"))
    taken = [one.where(F.col("y") == y).orderBy(rank, id_col).limit(sample_rows) for y in (0, 1)]
    sample = taken[0].unionByName(taken[1]).select(F.col(id_col).alias("__id"), "y")  # bounded by the two limits
    texts = docs.select(F.col(id_col).alias("__doc"), text_of(text_col).alias("__text")).where(F.octet_length("__text") <= sample_bytes)
    rows = texts.join(F.broadcast(sample), F.col("__doc") == F.col("__id")).groupBy("__doc", "y").agg(F.min("__text").alias("__text")).toPandas()
    rows = rows.sort_values(["__doc", "__text"])
    bags = []
    for text, y in zip(rows["__text"], rows["y"]):
        _, x, w = measured(text)
        bags += [(x[at : at + 32], w[at : at + 32], bool(y)) for at in range(0, len(x), 32)]  # long texts as several sequences
    if len({good for _, _, good in bags}) < 2:
        return PRIOR
    return learnt(bags)


def judged(docs: DataFrame, model: dict[str, np.ndarray], min_share: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts and verdict of each document."""

    def run(frames):
        for batch in batches(frames):
            counts, features, weights = zip(*map(measured, batch.column(1).to_pylist())) if batch.num_rows else ((), (), ())
            labels = crf_lines.viterbi(model, list(features))
            share = [float((w * y).sum() / w.sum()) if len(w) else 0.0 for w, y in zip(weights, labels)]
            failed = [c[0] < 50 or 100 * c[4] > 50 * c[0] for c in counts]
            kept = [not f and s >= min_share for f, s in zip(failed, share)]
            columns = [batch.column(0), *(pa.array([c[i] for c in counts], pa.int64()) for i in range(5)), pa.array(failed, pa.bool_()), pa.array(kept, pa.bool_()), pa.array(share, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "content_share"])

    return docs.select(docs[id_col].cast("long").alias("doc_id"), text_of(text_col).alias("text")).mapInArrow(run, SCHEMA)


def lines(docs: DataFrame, model: dict[str, np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, is_content (for each line of the text; null for one without a word), content (the content lines)."""

    def run(frames):
        for batch in batches(frames):
            texts = batch.column(1).to_pylist()
            flags, content = [], []
            for text, labels in zip(texts, crf_lines.viterbi(model, [measured(t)[1] for t in texts])):
                rest = iter(labels.tolist())
                split = text.split("\n")
                flags.append([bool(next(rest)) if _WORD.search(x) else None for x in split])
                content.append("\n".join(x for x, f in zip(split, flags[-1]) if f))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(flags, pa.list_(pa.bool_())), pa.array(content, pa.string())], ["doc_id", "is_content", "content"])

    return docs.select(docs[id_col].cast("long").alias("doc_id"), text_of(text_col).alias("text")).mapInArrow(run, "doc_id long, is_content array<boolean>, content string")
