"""Hierarchical packing of token streams into windows of several sizes.

Each document's ids, with an end id, are routed to a tier, the smallest window that holds it
(longer ones are cut into full windows of the largest size and a rest that is routed). Windows of every
tier are closed from that tier's own queue, first-fit; a gap is filled from the shorter tiers, longest piece first, and
where nothing fits a document is cut. At the end of a task a piece whose window can no longer be filled is
halved into the next shorter tier; what then remains, less than the smallest tier, is laid out in windows of powers of
two, so that no sequence needs padding.

Sequences of one size, over all tasks, are dealt in order to step groups of at most ``group_tokens`` tokens that differ by one
sequence at most; a group has sequences of one size. That needs the number of sequences of each task and size, so the pieces are
written once to the shared folder and these counts (one row for each task and size) go to the driver.

A task keeps at most ``hold`` pieces open, about ``hold`` windows of memory; nothing is
shuffled, and the plan is the same for any size. Sequence ids are (partition, counter), stable when a
lost task runs again, since the partition's rows are.

Defined results: null and empty texts are one piece, the end id alone; a text of any length is encoded whole, and held whole by its
task; a text that spells one of the vocabulary's added tokens has that token's id, as the plain library gives it; repeated rows are
packed each; a null id stays null; an empty table gives none; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import batches, materialise, text_of
from tidemark.llm.word_tokens import word_tokens

TIERS = (512, 1024, 2048, 4096)
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group long"


class Packer:
    """Pieces (document, start, ids) to sequences. ``out`` collects (doc, start, ids, doc_tokens, sequence, offset, tier, rank in the tier)."""

    def __init__(self, tiers=TIERS, hold: int = 512, base: int = 0):
        self.tiers, self.hold, self.base = sorted(tiers), hold, base
        self.waiting = {t: deque() for t in self.tiers}
        self.tokens = dict.fromkeys(self.tiers, 0)
        self.n_waiting = 0
        self.sequences = 0
        self.closed: dict[int, int] = {}
        self.out: list[tuple] = []

    def _close(self, pieces: list[tuple], tier: int) -> None:
        number, offset = self.base + self.sequences, 0
        self.sequences += 1
        rank = self.closed.get(tier, 0)
        self.closed[tier] = rank + 1
        for doc, start, ids, total in pieces:
            self.out.append((doc, start, ids, total, number, offset, tier, rank))
            offset += len(ids)

    def _route(self, piece: tuple, first: bool = False) -> None:
        tier = next(t for t in self.tiers if len(piece[2]) <= t)
        (self.waiting[tier].appendleft if first else self.waiting[tier].append)(piece)
        self.tokens[tier] += len(piece[2])
        self.n_waiting += 1

    def _pop(self, tier: int, at: int = 0) -> tuple:
        piece = self.waiting[tier][at]
        del self.waiting[tier][at]
        self.tokens[tier] -= len(piece[2])
        self.n_waiting -= 1
        return piece

    def add(self, doc, ids: np.ndarray) -> None:
        top, n = self.tiers[-1], len(ids)
        full = n - n % top
        for at in range(0, full, top):
            self._close([(doc, at, ids[at : at + top], n)], top)
        if n > full:
            self._route((doc, full, ids[full:], n))
            if self.n_waiting > self.hold:
                self.pack_one()

    def _fills(self, tier: int) -> bool:
        """Whether what waits in a tier and the shorter ones fills a window of it."""
        return bool(self.waiting[tier]) and sum(self.tokens[t] for t in self.tiers if t <= tier) >= tier

    def _take(self, room: int, most: int) -> tuple:
        """The first waiting piece that fits, from the longest tier up to ``most`` that has one; else the head of a piece of the shortest such tier."""
        least = 0
        lines = [t for t in self.tiers if t <= most and self.waiting[t]]
        for tier in reversed(lines):
            least = max((t for t in self.tiers if t < tier), default=0)
            if room > least:
                for at, piece in enumerate(self.waiting[tier]):
                    if len(piece[2]) <= room:
                        return self._pop(tier, at)
        doc, start, ids, n = self._pop(lines[0])
        self._route((doc, start + room, ids[room:], n), first=True)
        return doc, start, ids[:room], n

    def _fill(self, size: int, most: int) -> None:
        pieces, room = [], size
        while room:
            piece = self._take(room, most)
            pieces.append(piece)
            room -= len(piece[2])
        self._close(pieces, size)

    def pack_one(self) -> None:
        """Fill one window of the tier with the most windows waiting: its own documents first, the gap from shorter ones."""
        full = [t for t in self.tiers if self._fills(t)]
        if full:
            tier = max(full, key=lambda t: self.tokens[t] / t)
            self._fill(tier, tier)

    def finish(self) -> None:
        """Windows of each tier while it can fill one, its other pieces halved into shorter tiers; of the last rest, falling powers of two."""
        while full := [t for t in self.tiers if self._fills(t)]:
            tier = max(full, key=lambda t: self.tokens[t] / t)
            self._fill(tier, tier)
        for tier, lower in zip(self.tiers[:0:-1], self.tiers[-2::-1]):
            while self.waiting[tier]:
                doc, start, ids, n = self._pop(tier)
                self._route((doc, start, ids[:lower], n))
                self._route((doc, start + lower, ids[lower:], n))
            while self._fills(lower):
                self._fill(lower, lower)
        while left := sum(self.tokens.values()):
            self._fill(1 << (left.bit_length() - 1), self.tiers[0])


def pack(streams: Iterable[tuple[object, np.ndarray]], packer: Packer) -> Iterator[list[tuple]]:
    for doc, ids in streams:
        packer.add(doc, ids)
        if len(packer.out) >= 4096:
            yield packer.out
            packer.out = []
    packer.finish()
    yield packer.out


def grouped(pieces: DataFrame, group_tokens: int) -> DataFrame:
    """``step_group``, which is a sequence's rank in its task and size, made the number of its group: size << 40 and a counter."""
    task = F.shiftright("sequence_id", 40)
    counts = pieces.where("offset = 0").groupBy(task.alias("task"), "tier").agg(F.count(F.lit(1)).alias("n")).collect()  # one row for each task and size
    total: dict[int, int] = {}
    rows = []
    for r in sorted(counts):
        rows.append((r.task, r.tier, total.get(r.tier, 0)))
        total[r.tier] = total.get(r.tier, 0) + r.n
    rows = [(t, tier, before, total[tier], -(-total[tier] // max(1, group_tokens // tier))) for t, tier, before in rows]
    starts = pieces.sparkSession.createDataFrame(rows, "t long, size int, before long, sequences long, groups long")
    joined = pieces.join(F.broadcast(starts), (task == F.col("t")) & (F.col("tier") == F.col("size")))
    group = F.shiftleft(F.col("tier").cast("long"), 40) + F.expr("((before + step_group) * groups) div sequences")
    return joined.select(*[group.alias(c) if c == "step_group" else c for c in pieces.columns])


def packed(docs: DataFrame, vocabulary: str = "word_bpe_49k.json", end_id: int = 2, tiers=TIERS, with_ids: bool = False, group_tokens: int = 65_536, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece; ``with_ids`` adds the piece's ids."""
    end = np.array([end_id], np.uint32)

    def run(frames):
        tokens = word_tokens(vocabulary)
        packer = Packer(tiers, base=TaskContext.get().partitionId() << 40)

        def streams():
            for batch in batches(frames):
                for doc, ids in zip(batch.column(0).to_pylist(), tokens.ids(batch.column(1).to_pylist())):
                    yield doc, np.concatenate([ids, end])

        for rows in pack(streams(), packer):
            doc, start, ids, total, number, offset, tier, rank = zip(*rows) if rows else [()] * 8
            columns = [pa.array(doc, pa.int64()), pa.array(start, pa.int64()), pa.array([len(x) for x in ids], pa.int64()), pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64()), pa.array(total, pa.int64()), pa.array(number, pa.int64()), pa.array(offset, pa.int64()), pa.array(tier, pa.int32()), pa.array(rank, pa.int64())]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier", "step_group"]
            if with_ids:
                columns.append(pa.array([x.tolist() for x in ids], pa.list_(pa.int64())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    pieces = docs.select(docs[id_col].cast("long").alias("doc_id"), text_of(text_col).alias("text")).mapInArrow(run, SCHEMA + (", ids array<long>" if with_ids else ""))
    return grouped(materialise(pieces, "packed-pieces"), group_tokens)
