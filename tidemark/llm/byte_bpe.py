"""Byte-level BPE in linear time: longest matches, backtracking, memoised pair compatibility.

The ranks of a tiktoken file are the vocabulary. Bytes are mapped one to one onto Latin-1, so
an Aho-Corasick automaton over characters finds the longest token that starts at each byte
position. An encoding is built left to right: the next token is the longest that fits, it stays if it is
compatible with the token before it, and else the next shorter one is tried; a position where all
fail is marked dead and the last token is taken back. Two tokens are compatible if merging their joined
bytes by rank gives these two tokens back; that is what makes the result the exact merge
result, and the answer is memoised for each pair.

Defined results: null reads as empty and encodes to no ids (the hashes are those of empty strings);
special tokens do not exist; other columns are ignored; ids of any length of text come whole.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import ahocorasick
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tidemark.llm.chunk_tokens import ChunkCache, regular
from tidemark.llm.common import batches, held, text_of

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


class ByteBpe:
    """Encoder and decoder over a file of ranks."""

    def __init__(self, path: str, pattern: str = public_tokenizers.PATTERN, memo: int = 600_000):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.tokens = {r: t for t, r in self.ranks.items()}
        self.split = regex.compile(pattern)
        self.latin = {t.decode("latin-1"): r for t, r in self.ranks.items()}
        self.length = {r: len(t) for t, r in self.ranks.items()}
        self.trie = ahocorasick.Automaton()
        for text, rank in self.latin.items():
            self.trie.add_word(text, rank)
        self.most = max(map(len, self.latin))
        self.within: dict[str, int] = {}  # every beginning of a token -> the longest token that it begins with, or -1
        for text in sorted(self.latin, key=len):
            for n in range(1, len(text) + 1):
                if text[:n] not in self.within:
                    self.within[text[:n]] = self.latin.get(text[:n], self.within.get(text[: n - 1], -1))
        self.shorter: dict[int, int] = {}
        self.compatible: dict[int, bool] = {}
        self.memo = memo

    def _next_shorter(self, token: int) -> int:
        """The longest token that is a proper prefix of this one, or -1."""
        found = self.shorter.get(token)
        if found is None:
            text = self.tokens[token]
            found = next((self.ranks[text[:n]] for n in range(len(text) - 1, 0, -1) if text[:n] in self.ranks), -1)
            self.shorter[token] = found
        return found

    def _merged(self, piece: bytes) -> list[int]:
        """Merges by rank, on a short piece: what compatibility is defined by."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            best, at = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if best == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def _decide(self, left: int, right: int) -> bool:
        if len(self.compatible) >= self.memo:
            self.compatible.clear()
        known = self._merged(self.tokens[left] + self.tokens[right]) == [left, right]
        self.compatible[left << 24 | right] = known
        return known

    def encode_piece(self, piece: bytes) -> list[int]:
        """The ids of one match of the pattern."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        n, text, most = len(piece), piece.decode("latin-1"), self.most
        prefix, within, length, compatible, shorter = self.trie.longest_prefix, self.within, self.length, self.compatible.get, self.shorter.get
        out: list[int] = []
        dead: set[int] = set()
        at, last = 0, -1
        token = within.get(text[: prefix(text[:most])], -1)
        while at < n:
            while token >= 0:
                after = at + length[token]
                if not dead or after not in dead:
                    if last < 0:
                        break
                    fits = compatible(last << 24 | token)
                    if fits or (fits is None and self._decide(last, token)):
                        break
                less = shorter(token)
                token = self._next_shorter(token) if less is None else less
            if token >= 0:
                out.append(token)
                at, last = after, token
                if at < n:
                    ahead = text[at : at + most]
                    token = within.get(ahead[: prefix(ahead)], -1)
            else:
                dead.add(at)
                if not out:
                    raise ValueError("the ranks do not cover all bytes")
                token = out.pop()
                at -= length[token]
                last = out[-1] if out else -1
                token = self._next_shorter(token)
        return out

    def encode_text(self, text: str) -> list[int]:
        return [i for m in self.split.findall(text) for i in self.encode_piece(m.encode())]

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


class TextEncoder:
    """Whole texts to their ids as decimal text, with caches for matches and chunks."""

    def __init__(self, path: str):
        self.bpe = ByteBpe(path)
        self.pieces = ChunkCache(self._pieces, 400_000)
        self.chunks = ChunkCache(self._chunks, 700_000)
        self.by_name = {str(r): t for r, t in self.bpe.tokens.items()}

    def _pieces(self, pieces: list[str]) -> list[str]:
        encode = self.bpe.encode_piece
        return [" ".join(map(str, encode(p.encode()))) for p in pieces]

    def _chunks(self, chunks: list[str]) -> list[str]:
        """A chunk of letters is one match; the matches of others are cached on their own, as words come with many marks."""
        split = self.bpe.split.findall
        cut = [[c] if c.strip(" ").isalpha() else split(c) for c in chunks]
        get = self.pieces.fill([row for row in cut if len(row) > 1])
        single = iter(self._pieces([row[0] for row in cut if len(row) == 1]))
        return [next(single) if len(row) == 1 else " ".join(map(get, row)) for row in cut]

    def ids(self, texts: list[str]) -> Iterator[str]:
        """Decimal ids of each text, joined by a space."""
        cut = []
        for text in texts:  # a space before a word belongs to its chunk, a newline between two is a match of its own
            cut.append(text.replace("\n", "\0\n\0").replace(" ", "\0 ").split("\0") if regular(text) else None)
        get = self.chunks.fill([row for row in cut if row])
        for text, row in zip(texts, cut):
            yield " ".join(map(get, row)) if row else " ".join(self._pieces(self.bpe.split.findall(text)))

    def decode(self, joined: str) -> bytes:
        return b"".join(map(self.by_name.__getitem__, joined.split(" "))) if joined else b""


def text_encoder(ranks: str) -> TextEncoder:
    """The worker's encoder: its caches outlive a task."""
    return held(("byte_bpe", ranks), lambda: TextEncoder(public_tokenizers.path(ranks)))


def digests(docs: DataFrame, ranks: str = "byte_bpe_50k.tiktoken", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each text: encoded, then decoded from the ids."""

    def run(frames):
        encoder = text_encoder(ranks)
        for batch in batches(frames):
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            n, a, b = [], [], []
            for joined in encoder.ids(texts):
                n.append(joined.count(" ") + 1 if joined else 0)
                a.append(hashlib.sha256(joined.encode()).hexdigest())
                b.append(hashlib.sha256(encoder.decode(joined)).hexdigest())
            yield pa.RecordBatch.from_arrays([ids.cast(pa.int64()), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(docs[id_col].cast("long").alias("doc_id"), text_of(text_col).alias("text")).mapInArrow(run, SCHEMA)


def encoded(docs: DataFrame, ranks: str = "byte_bpe_50k.tiktoken", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and its ids, the operator's general form."""

    def run(frames):
        encoder = text_encoder(ranks)
        for batch in batches(frames):
            rows = [[int(x) for x in j.split()] for j in encoder.ids(batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(rows, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select(docs[id_col].cast("long").alias("doc_id"), text_of(text_col).alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decoded(ids: DataFrame, ranks: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """doc_id and the decoded bytes of ``ids``."""

    def run(frames):
        bpe = text_encoder(ranks).bpe
        for batch in frames:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([bpe.decode(x or []) for x in batch.column(1).to_pylist()], pa.binary())], ["doc_id", "bytes"])

    return ids.select("doc_id", "ids").mapInArrow(run, "doc_id long, bytes binary")
