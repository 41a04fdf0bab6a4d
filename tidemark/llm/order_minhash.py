"""Near-duplicate documents by Order MinHash, verified by banded alignment.

A document is its sequence of five-word shingles (lower case), each labelled with its occurrence number, so
repeats differ. A sketch takes the two smallest labelled shingles of one hash order and keeps
them in text order, so it favours texts that agree in order as well as in content. Two sketches make a band;
texts that share a band are candidates. A candidate pair is a link if aligning the two shingle
sequences inside a diagonal band (as wide as the threshold allows) matches at least ``similarity`` of
their union. Classes are the connected components of links.

Work is not quadratic in a group: equal word sequences count once; a band's members are compared with its most
central one, then with the most central one of a random part of the band. Members that still are in different classes meet where they share
one of their rarest shingles, as similar texts must (``_prefixed``): a template that very many texts share makes no pairs. Pairs go
on to their texts only if they can reach the threshold: each document has a bitmap of its shingles, a bit that one
has and the other lacks is a shingle without a match, and so an upper bound of the similarity is known without the texts.

Defined results: null and texts without words have no shingle and are classes of their own; texts of under five words
have one shingle, all their words; repeated rows share a class; rows with a null id are left out of classes (and
kept by ``deduplicate``); rows that repeat an id with different texts are compared by one of these texts; an empty table gives none; other columns are ignored or carried along.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import batches, materialise, text_of, tidy
from tidemark.llm.wordhash import U, mix, rolled, word_hashes

WORDS, SKETCHES, ROWS, TURNS, PART, BITS = 5, 32, 2, 2, 8, 12
_rng = np.random.default_rng(977)
_XOR = _rng.integers(1, 1 << 63, SKETCHES, dtype=np.int64).astype(U)
_MUL = _rng.integers(1, 1 << 63, SKETCHES, dtype=np.int64).astype(U) * U(2) + U(1)
#: Ids up to this many are sent to every task instead of dealing all texts out by id (8 bytes each).
SMALL_IDS = 500_000


def shingles(text: str) -> np.ndarray:
    """Hashes of the five-word shingles, in order."""
    h = word_hashes(text.lower().encode("utf-8", "surrogatepass"))
    return rolled(h, min(WORDS, len(h))) if len(h) else h


def labelled(s: np.ndarray) -> np.ndarray:
    """The shingles with their occurrence numbers mixed in."""
    values, where, counts = np.unique(s, return_inverse=True, return_counts=True)
    if len(values) == len(s):
        return mix(s)
    order = np.argsort(where, kind="stable")
    occurrence = np.empty(len(s), np.int64)
    occurrence[order] = np.arange(len(s)) - np.repeat(np.cumsum(counts) - counts, counts)
    return mix(s + occurrence.astype(U) * U(0xD6E8FEB86659FD93))


def sketch(x: np.ndarray, block: int = 1 << 19) -> np.ndarray:
    """The sketch values of labelled shingles: for each order, its two smallest in text order."""
    out = np.empty(SKETCHES, U)
    step = max(1, block // len(x))  # a very long text takes fewer orders at a time
    for at in range(0, SKETCHES, step):
        v = (x[None, :] ^ _XOR[at : at + step, None]) * _MUL[at : at + step, None]
        v ^= v >> U(29)
        rows = np.arange(len(v))
        p = v.argmin(1)
        a = v[rows, p]
        if len(x) > 1:
            v[rows, p] = np.iinfo(np.uint64).max
            q = v.argmin(1)
            b = v[rows, q]
            a, b = np.where(p < q, a, b), np.where(p < q, b, a)
            a = mix(a * U(3) + mix(b))
        out[at : at + step] = a
    return out


def bitmap(x: np.ndarray) -> np.ndarray:
    """4096 bits, one for each value of the labelled shingles' first 12 bits, as 64-bit numbers."""
    out = np.zeros(1 << BITS, bool)
    out[x >> U(64 - BITS)] = True
    return np.packbits(out, bitorder="little").view("<i8")


def bands(values: np.ndarray) -> np.ndarray:
    """One key for each pair of sketches."""
    pairs = values.reshape(-1, ROWS)
    return mix(pairs[:, 0] * U(7) + mix(pairs[:, 1]) + np.arange(len(pairs), dtype=U)).astype(np.int64)


def matches(a: np.ndarray, b: np.ndarray, half: int) -> int:
    """Matched elements of the best alignment whose matches lie within ``half`` of the diagonal (a bit-parallel row each)."""
    n = min(len(a), len(b))
    same = a[:n] == b[:n]
    head = n if same.all() else int(same.argmin())
    a, b = a[head:], b[head:]
    n = min(len(a), len(b))
    same = a[len(a) - n :][::-1] == b[len(b) - n :][::-1]
    tail = n if n == 0 or same.all() else int(same.argmin())
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    if not len(a) or not len(b):
        return head + tail
    where: dict[int, int] = {}
    for i, t in enumerate(a.tolist()):
        where[t] = where.get(t, 0) | 1 << i
    full = (1 << len(a)) - 1
    v, strip = full, (1 << (2 * half + 1)) - 1
    for j, t in enumerate(b.tolist()):
        m = where.get(t)
        if m is None:
            continue
        m &= strip << (j - half) if j >= half else strip >> (half - j)
        u = v & m
        v = ((v + u) | (v - u)) & full
    return head + tail + len(a) - v.bit_count()


def similarity(a: np.ndarray, b: np.ndarray, at_least: float = 0.8) -> float:
    """Matched shingles over the union, by banded alignment; exact from ``at_least`` on, lower values may be too low."""
    if not len(a) or not len(b):
        return 0.0
    if min(len(a), len(b)) < at_least * max(len(a), len(b)):
        return 0.0
    # At the threshold, at most (1 - t) / (1 + t) of all shingles have no match: no match is further off the diagonal.
    half = int((1 - at_least) / (1 + at_least) * (len(a) + len(b))) + 1
    m = matches(a, b, half)
    return m / (len(a) + len(b) - m)


def sketched(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, key of the word sequence, number of shingles, their bitmap, bands."""

    def run(frames):
        for batch in batches(frames):
            seq, n, bits, keys = [], [], [], []
            for text in batch.column(1).to_pylist():
                data = text.lower().encode("utf-8", "surrogatepass")
                s = shingles(text)
                n.append(len(s))
                if not len(s):
                    seq.append(None), bits.append([]), keys.append([])
                    continue
                x = labelled(s)
                seq.append(hashlib.sha256(b" ".join(data.split())).digest())
                bits.append(bitmap(x))
                keys.append(bands(sketch(x)))
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(seq, pa.binary()), pa.array(n, pa.int64()), pa.array(bits, longs), pa.array(keys, longs)], ["doc_id", "seq", "n_shingles", "bits", "bands"])

    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, seq binary, n_shingles long, bits array<long>, bands array<long>")


def can_reach(na: str, a: str, nb: str, b: str, at_least: float):
    """Whether two bitmaps, of ``na`` and ``nb`` shingles, leave enough that may match. Never false for a pair that is similar."""

    def lacking(x: str, y: str):
        return F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseAND(F.bitwise_not(q)))), F.lit(0), lambda s, n: s + n)

    sizes = F.least(F.col(na), F.col(nb)) >= F.greatest(F.col(na), F.col(nb)) * at_least - 1e-6
    most = F.least(F.col(na) - lacking(a, b), F.col(nb) - lacking(b, a))
    return sizes & (most * (1 + at_least) >= (F.col(na) + F.col(nb)) * at_least - 1e-6)


def _shared(members: DataFrame) -> DataFrame:
    """doc_id, key, n, company of members of bands of n > 1; company is the sum of n over a document's bands."""
    crowd = members.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("key").alias("k"), "n")
    shared = materialise(members.join(crowd, F.col("key") == F.col("k")).select("doc_id", "key", "n"), "omh-shared")
    company = shared.groupBy("doc_id").agg(F.sum("n").alias("company")).withColumnRenamed("doc_id", "d")
    return materialise(shared.join(company, F.col("doc_id") == F.col("d")).drop("d"), "omh-shared")


def _undecided(shared: DataFrame, found: DataFrame) -> DataFrame:
    """The members, with the root of their class as far as two rounds tell, of bands that hold more than one."""
    roots = components(found, 2)
    rooted = shared.drop("root").join(roots, F.col("doc_id") == F.col("id"), "left").withColumn("root", F.coalesce("root", "doc_id")).drop("id")
    rooted = materialise(rooted, "omh-rooted")
    open_ = rooted.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x < y").select(F.col("key").alias("k"))
    return materialise(rooted.join(open_, F.col("key") == F.col("k")).drop("k"), "omh-open")


def _starred(members: DataFrame, turn: int) -> DataFrame:
    """a, b: members of a band with its most central one, who has the most company (of a text and its altered copies, the
    text); from the second turn on, within random parts of a band, of another class only."""
    parts = F.lit(1) if not turn else F.ceil(F.col("n") / PART)
    dealt = members.withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit(turn)), parts))
    center = dealt.groupBy("key", "part").agg(F.max(F.struct("company", (-F.col("doc_id")).alias("minus"), "root")).alias("c"))
    center = materialise(center.select(F.col("key").alias("k"), F.col("part").alias("p"), (-F.col("c.minus")).alias("a"), F.col("c.root").alias("ra")), "omh-centers")
    met = dealt.join(center, (F.col("key") == F.col("k")) & (F.col("part") == F.col("p")) & (F.col("root") != F.col("ra")))
    return met.select("a", F.col("doc_id").alias("b"))


def _close(pairs: DataFrame, values: DataFrame, at_least: float) -> DataFrame:
    """The pairs, smaller id first, that can reach the threshold."""
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    of = lambda side: values.select(F.col("doc_id").alias(side), F.col("n_shingles").alias("n" + side), F.col("bits").alias("x" + side))
    return pairs.join(of("b"), "b").join(of("a"), "a").where(can_reach("na", "xa", "nb", "xb", at_least)).select("a", "b")


def _with_texts(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """a, b, text_a, text_b for each pair; texts come from ``docs`` (doc_id, text), one row each id."""
    ids = materialise(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "omh-ids")
    small = ids.limit(SMALL_IDS + 1).count() <= SMALL_IDS
    texts = docs.join(F.broadcast(ids) if small else ids, F.col("doc_id") == F.col("id"), "left_semi")
    left = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    return pairs.join(right, "b").join(left, "a").select("a", "b", "text_a", "text_b")


def verified(pairs: DataFrame, at_least: float) -> DataFrame:
    """a, b of the pairs whose banded alignment reaches the threshold."""

    def run(frames):
        for batch in batches(frames):
            known: dict[str, np.ndarray] = {}
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            keep = []
            for i, (x, y) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
                sx, sy = (known[t] if t in known else known.setdefault(t, shingles(t)) for t in (x, y))
                if similarity(sx, sy, at_least) >= at_least:
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([pa.array([a[i] for i in keep], pa.int64()), pa.array([b[i] for i in keep], pa.int64())], ["a", "b"])

    return pairs.mapInArrow(run, "a long, b long")


def links(docs: DataFrame, sketches: DataFrame, at_least: float = 0.8) -> DataFrame:
    """Verified links a < b between ids that stand for different word sequences, enough to connect every class. ``docs``: doc_id, text."""
    stands = sketches.where("n_shingles > 0").groupBy("seq").agg(F.min("doc_id").alias("rep")).select("rep")
    single = materialise(sketches.join(stands, F.col("doc_id") == F.col("rep"), "left_semi").dropDuplicates(["doc_id"]).drop("seq"), "omh-single")
    shared = _shared(single.select("doc_id", F.explode("bands").alias("key")))
    values = single.join(shared.select(F.col("doc_id").alias("d")).distinct(), F.col("doc_id") == F.col("d"), "left_semi").select("doc_id", "n_shingles", "bits")
    values = materialise(values, "omh-values")
    members, found = shared.withColumn("root", F.col("doc_id")), None
    for turn in range(TURNS):
        close = materialise(_close(_starred(members, turn), values, at_least), "omh-pairs")
        fresh = verified(_with_texts(docs, close), at_least).distinct()
        found = materialise(fresh if found is None else found.unionByName(fresh).distinct(), "omh-links")
        tidy(docs.sparkSession)
        members = _undecided(members, found)
        if not members.limit(1).count():
            return found
    members = materialise(members.select("doc_id", "root").distinct(), "omh-rest")
    pairs = materialise(_close(_prefixed(docs, members, at_least), values, at_least), "omh-pairs")
    return materialise(found.unionByName(verified(_with_texts(docs, pairs), at_least)).distinct(), "omh-links")


def _prefixed(docs: DataFrame, members: DataFrame, at_least: float) -> DataFrame:
    """a, b: pairs of members (doc_id, root) of different classes that may be similar, none that is left out.

    Similar texts share at least ``at_least`` of either one's labelled shingles. With all shingles in one order, rare ones first, the first
    n - ceil(at_least * n) + 1 of each text therefore have one in common, and behind the first common one either still has enough. A shingle
    that one member alone has takes a place there and meets nobody: texts that only share a template of less than that have no
    shingle of it among their first ones, however many they are.
    """
    ids = members.select("doc_id")
    small = ids.limit(SMALL_IDS + 1).count() <= SMALL_IDS
    texts = docs.join(F.broadcast(ids) if small else ids, "doc_id", "left_semi")

    def run(frames):
        for batch in batches(frames):
            rows = [labelled(shingles(t)).view(np.int64) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.int64()))], ["doc_id", "grams"])

    grams = materialise(texts.select("doc_id", "text").mapInArrow(run, "doc_id long, grams array<long>"), "omh-grams")
    each = grams.select("doc_id", F.size("grams").alias("n"), F.explode("grams").alias("g"))
    often = each.groupBy("g").agg(F.count(F.lit(1)).alias("f")).where("f > 1")
    ordered = each.join(often, "g").groupBy("doc_id", "n").agg(F.array_sort(F.collect_list(F.struct("f", "g"))).alias("x"))
    least = F.ceil(F.col("n") * at_least - 1e-6)
    first = ordered.select("doc_id", "n", F.size("x").alias("shared"), "x").where(F.col("shared") >= least)
    at = first.select("doc_id", "n", "shared", F.posexplode(F.slice("x", F.lit(1), (F.col("shared") - least + 1).cast("int"))).alias("i", "y"))
    rows = at.select("doc_id", "n", F.col("y.g").alias("g"), (F.col("shared") - F.col("i") - 1).alias("behind"))
    rows = materialise(rows.join(members, "doc_id"), "omh-prefix")
    other = rows.select(F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.col("g").alias("h"), F.col("behind").alias("bb"), F.col("root").alias("rb"))
    most = F.least("behind", "bb") + 1
    may = (most * (1 + at_least) >= (F.col("n") + F.col("nb")) * at_least - 1e-6) & (F.least("n", "nb") >= F.greatest("n", "nb") * at_least - 1e-6)
    met = rows.join(other, (F.col("g") == F.col("h")) & (F.col("doc_id") < F.col("b")) & (F.col("root") != F.col("rb")) & may)
    return met.select(F.col("doc_id").alias("a"), "b")


def components(edges: DataFrame, rounds: int | None = None) -> DataFrame:
    """id, root: the smallest id that links lead to (``rounds``: as far as so many rounds tell, an id of the same class). Labels fall to
    neighbours' and then to their own label's label."""
    both = materialise(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a != b").distinct(), "cc-edges")
    label = materialise(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("root")).withColumnRenamed("a", "id"), "cc")
    while True:
        near = both.join(label, both.b == label.id).groupBy("a").agg(F.min("root").alias("near"))
        step = label.join(near, label.id == near.a, "left").select("id", "root", F.least("root", F.coalesce("near", "root")).alias("next"))
        ahead = label.select(F.col("id").alias("i"), F.col("root").alias("up"))
        jumped = materialise(step.join(ahead, F.col("next") == F.col("i"), "left").select("id", F.least("next", F.coalesce("up", "next")).alias("new"), "root"), "cc")
        label = jumped.select("id", F.col("new").alias("root"))
        if rounds is not None:
            rounds -= 1
            if not rounds:
                return label
        elif not jumped.where("new != root").limit(1).count():
            return label


def classes(docs: DataFrame, at_least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row with an id: doc_id, class_id (its class's smallest id), class_rep (the smallest id of its word sequence), n_links (verified links of
    that sequence that were needed to connect its class: two texts that are in one class already are not compared any more)."""
    sketches = materialise(sketched(docs, id_col, text_col), "omh-sketches")
    texts = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    edges = links(texts, sketches, at_least)
    roots = components(edges)
    degree = edges.select(F.explode(F.array("a", "b")).alias("d")).groupBy("d").agg(F.count(F.lit(1)).alias("n_links"))
    stands = sketches.where("n_shingles > 0").groupBy("seq").agg(F.min("doc_id").alias("rep")).join(roots, F.col("rep") == F.col("id"), "left").join(degree, F.col("rep") == F.col("d"), "left")
    stands = materialise(stands.select(F.col("seq").alias("s"), "rep", F.coalesce("root", "rep").alias("root"), F.coalesce("n_links", F.lit(0)).cast("long").alias("links")), "omh-reps")
    joined = sketches.select("doc_id", "seq").join(stands, F.col("seq") == F.col("s"), "left")
    return joined.select("doc_id", F.coalesce("root", "doc_id").alias("class_id"), F.coalesce("rep", "doc_id").alias("class_rep"), F.coalesce("links", F.lit(0).cast("long")).alias("n_links"))


def deduplicate(docs: DataFrame, at_least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id is their class's smallest, with their own columns."""
    name = "gone"
    while name in {c.lower() for c in docs.columns}:
        name += "_"
    gone = materialise(classes(docs, at_least, id_col, text_col).where("doc_id != class_id").select(F.col("doc_id").alias(name)).distinct(), "omh-gone")
    small = gone.limit(SMALL_IDS + 1).count() <= SMALL_IDS
    return docs.join(F.broadcast(gone) if small else gone, F.col(f"`{id_col}`") == F.col(name), "left_anti")
