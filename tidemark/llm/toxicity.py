"""Toxicity: the recurrent network of ``gru`` over all overlapping windows of a text.

Training rows are a bounded sample (``sample_positive``, ``sample_negative`` labelled rows, by hash of the id); they never
include held-out ids, and the score sees nothing but the text. A label marks a document, so windows
first take their document's label; then windows of positive documents that the network itself finds harmless are
left out, and it is trained further. A word that harmful texts use often may occur in a harmless one, so a
document's score is the logistic of a linear map, fitted on the training rows, of its highest window
logit, the mean window probability (and its log odds) and the number of windows.

Defined results: null, empty and blank texts have no window and score as a text whose only window has the
lowest logit of the training rows; repeated rows score alike; an empty table gives none; without labels of both kinds
every score is 0; other columns are ignored. Whole texts are scored, in batches of windows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import gru
from tidemark.llm.common import batches, held, text_of, tidy

SIZE, STRIDE = 32, 16
_STRIP = ".,;:!?\"'()[]{}*#$%&|<>«»“”„…-–_~"


def held_out(doc_id):
    """Ids whose labels are never learnt from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def words(text: str) -> list[str]:
    return text.lower().split()


def core(word: str) -> str:
    """A word without marks at its ends."""
    return word.strip(_STRIP) or word


class Types:
    """Word types in order of first sight: what a text has between white space, without marks at its ends. Type 0 is padding."""

    def __init__(self, vocabulary: dict[str, int]):
        self.vocabulary, self.number, self.by_core, self.cores = vocabulary, {"": 0}, {"": 0}, [""]

    def of(self, seq: list[str]) -> np.ndarray:
        number, by_core = self.number, self.by_core
        for w in sorted(set(seq).difference(number)):  # in one order, whatever the hash seed: training adds up in it
            c = core(w)
            if c not in by_core:
                by_core[c] = len(self.cores)
                self.cores.append(c)
            number[w] = by_core[c]
        return np.fromiter(map(number.__getitem__, seq), np.int64, len(seq))

    def inputs(self, new: slice) -> tuple[np.ndarray, tuple[gru.Lists, gru.Lists]]:
        """Vocabulary numbers and characters of a range of types."""
        cores = self.cores[new]
        return np.array([self.vocabulary.get(c, 0) for c in cores], np.int64), gru.characters(cores)


class Scorer:
    """A trained network, applied to texts."""

    def __init__(self, p: dict, vocabulary: dict[str, int], scale: tuple[np.ndarray, float], bound: int = 130_000):
        self.p, self.vocabulary, self.scale, self.bound = p, vocabulary, scale, bound
        self._renew()

    def _renew(self):
        self.types, self.done = Types(self.vocabulary), 0
        k3 = self.p["cf"].shape[0]
        self.gx = {d: np.zeros((0, k3), gru.F32) for d in "fb"}

    def __getstate__(self):
        return self.p, self.vocabulary, self.scale, self.bound

    def __setstate__(self, state):
        self.__init__(*state)

    def _project(self):
        new = slice(self.done, len(self.types.cores))
        if new.start < new.stop:
            x = gru.inputs(self.p, *self.types.inputs(new))
            if len(self.gx["f"]) < new.stop:
                for d in "fb":
                    grown = np.zeros((max(1024, new.stop * 5 // 4), self.gx[d].shape[1]), gru.F32)
                    grown[: self.done] = self.gx[d][: self.done]
                    self.gx[d] = grown
            for d in "fb":
                self.gx[d][new] = x @ self.p[f"W{d}"] + self.p[f"c{d}"]
            self.done = new.stop

    def features(self, texts: list[str], block: int = 4096) -> np.ndarray:
        """(texts, 5): highest window logit, log odds of the mean window probability, that mean, log of the number of windows, and
        the product of the last two; nan without words."""
        if len(self.types.number) > self.bound:
            self._renew()
        seqs = [self.types.of(words(t)) for t in texts]
        self._project()
        flat = np.concatenate(seqs) if seqs else np.zeros(0, np.int64)
        doc, first, count = gru.windows([len(s) for s in seqs], SIZE, STRIDE)
        logit = np.empty(len(doc))
        for at in range(0, len(doc), block):
            part = slice(at, at + block)
            idx, mask = gru.gathered(flat, first[part], count[part], SIZE)
            logit[part] = gru.forward(self.p, self.gx, idx, mask)
        top = np.full(len(texts), -np.inf)
        np.maximum.at(top, doc, logit)
        n = np.bincount(doc, minlength=len(texts))
        mean = np.bincount(doc, 1 / (1 + np.exp(-np.clip(logit, -30, 30))), minlength=len(texts)) / np.maximum(1, n)
        return np.where((n > 0)[:, None], _summary(np.clip(top, -12, 12), mean, n), np.nan)

    def scores(self, texts: list[str]) -> np.ndarray:
        weights, low = self.scale
        x = self.features(texts)
        x = np.where(np.isnan(x), _summary(np.array([low]), 1 / (1 + np.exp(-np.array([low]))), np.ones(1)), x)
        return 1 / (1 + np.exp(-np.clip(x @ weights[:-1] + weights[-1], -500, 500)))


def in_worker(scorer: Scorer | None) -> Scorer | None:
    """The worker's own copy of a scorer: what it knows of words outlives a task."""
    if scorer is None:
        return None
    key = hashlib.sha256(b"".join(scorer.p[k].tobytes() for k in sorted(scorer.p)) + repr(scorer.scale).encode()).digest()
    return held(("toxicity", key), lambda: scorer)


def _summary(top: np.ndarray, mean: np.ndarray, n: np.ndarray) -> np.ndarray:
    held, size = np.clip(mean, 1e-5, 1 - 1e-5), np.log(np.maximum(1, n))
    return np.stack([top, np.log(held / (1 - held)), mean, size, mean * size], 1)


def _logistic(x: np.ndarray, y: np.ndarray, steps: int = 40) -> np.ndarray:
    """Weights and offset of a logistic regression, by Newton's method with a small ridge."""
    mean, dev = x.mean(0), x.std(0) + 1e-9
    z = np.concatenate([(x - mean) / dev, np.ones((len(x), 1))], 1)
    w, ridge = np.zeros(z.shape[1]), 0.1 * np.eye(z.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        w += np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge, z.T @ (y - p) - ridge @ w)
    return np.concatenate([w[:-1] / dev, [w[-1] - (w[:-1] * mean / dev).sum()]])


def train(texts: list[str], y: np.ndarray, min_docs: int = 3, first: int = 4, more: int = 3, rate: float = 0.01) -> Scorer | None:
    """A scorer from labelled texts; None unless both labels occur."""
    y = np.asarray(y, float)
    if len(set(y.tolist())) < 2:
        return None
    spread: dict[str, int] = {}
    for t in texts:
        for c in set(map(core, words(t))):
            spread[c] = spread.get(c, 0) + 1
    vocabulary = {c: i + 1 for i, c in enumerate(sorted(c for c, n in spread.items() if n >= min_docs))}
    types = Types(vocabulary)
    seqs = [types.of(words(t)) for t in texts]
    flat = np.concatenate(seqs)
    doc, start, count = gru.windows([len(s) for s in seqs], SIZE, SIZE)
    idx, mask = gru.gathered(flat, start, count, SIZE)
    label, (ids, chars) = y[doc], types.inputs(slice(0, None))
    # A document counts alike however long it is, up to a root; the labels count alike.
    weight = 1 / np.sqrt(np.bincount(doc, minlength=len(texts))[doc])
    for v in (0, 1):
        weight[label == v] *= 0.5 * len(weight) / max(1e-9, weight[label == v].sum())
    p = gru.fresh(len(vocabulary))
    times = int(np.clip(350 * 128 // max(1, len(idx)), 1, 4))  # few windows are read more often
    first, more = first * times, more * times
    for _ in gru.epochs(p, ids, chars, idx, mask, label, weight, first, rate):
        pass

    def by_window() -> np.ndarray:
        gx = {d: (x := gru.inputs(p, ids, chars)) @ p[f"W{d}"] + p[f"c{d}"] for d in "fb"}
        return np.concatenate([gru.forward(p, gx, idx[a : a + 4096], mask[a : a + 4096]) for a in range(0, len(idx), 4096)])

    logit = by_window()
    top = np.full(len(texts), -np.inf)
    np.maximum.at(top, doc, logit)
    use = (label == 0) | (logit > 0) & (logit >= 0.3 * top[doc])
    if use[label == 1].any():
        weight = np.ones(len(use))
        weight[label == 1] = 0.5 * (label == 0).sum() / max(1, (use & (label == 1)).sum())
        for _ in gru.epochs(p, ids, chars, idx[use], mask[use], label[use], weight[use], more, rate / 2, seed=4):
            pass
    scorer = Scorer(p, vocabulary, (np.zeros(6), 0.0))
    x = np.concatenate([scorer.features(texts[at : at + 500]) for at in range(0, len(texts), 500)])
    has = ~np.isnan(x[:, 0])
    scorer.scale = _logistic(x[has], y[has]), float(x[has, 0].min())
    return scorer


def fit(docs: DataFrame, labels: DataFrame, sample_positive: int = 600, sample_negative: int = 1500, sample_bytes: int = 500_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Scorer | None:
    """Train on at most so many labelled ids that are not held out, one text each, texts of more than ``sample_bytes`` not among them. Ids with two labels are left out."""
    one = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col))).groupBy(id_col).agg(F.min(label_col).alias("y"), F.max(label_col).alias("z")).where("y = z")
    rank = F.xxhash64(F.col(id_col).cast("string"))
    taken = [one.where(F.col("y") == y).orderBy(rank, id_col).limit(n) for y, n in ((0, sample_negative), (1, sample_positive))]
    sample = taken[0].unionByName(taken[1]).select(F.col(id_col).alias("__id"), "y")  # bounded by the two limits
    texts = docs.select(F.col(id_col).alias("__doc"), text_of(text_col).alias("__text")).where(F.octet_length("__text") <= sample_bytes)
    rows = texts.join(F.broadcast(sample), F.col("__doc") == F.col("__id")).groupBy("__doc", "y").agg(F.min("__text").alias("__text")).toPandas()
    rows = rows.sort_values(["__doc", "__text"])
    scorer = train(rows["__text"].tolist(), rows["y"].to_numpy())
    del rows
    if scorer is not None:
        scorer._renew()  # what it knows of the sample's words is not sent on
    tidy(docs.sparkSession)
    return scorer


def _scored(docs: DataFrame, scorer: Scorer | None, id_col: str, text_col: str, threshold: float) -> DataFrame:
    def run(frames):
        own = in_worker(scorer)
        for batch in batches(frames):
            texts = batch.column(2).to_pylist()
            score = own.scores(texts) if own else np.zeros(len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score, pa.float64()), pa.array((score >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    ids = docs[id_col]
    return docs.select(ids.cast("long").alias("doc_id"), F.coalesce(held_out(ids), F.lit(False)).alias("held_out"), text_of(text_col).alias("text")).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def scores(docs: DataFrame, scorer: Scorer | None, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted of each row."""
    return _scored(docs, scorer, id_col, text_col, threshold)


def keep_harmless(docs: DataFrame, scorer: Scorer | None, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """The rows whose text scores below the threshold, unchanged, in one pass over the rows."""
    at = docs.columns.index(text_col)

    def run(frames):
        own = in_worker(scorer)
        for batch in batches(frames):
            texts = [t or "" for t in batch.column(at).to_pylist()]
            score = own.scores(texts) if own else np.zeros(len(texts))
            yield batch.filter(pa.array(score < threshold))

    return docs.mapInArrow(run, docs.schema)
