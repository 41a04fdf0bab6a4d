"""Token streams of whole texts, by way of a bounded cache of space-separated chunks.

A tokenizer that never merges across a single space between two visible characters can be run
chunk by chunk. ``ChunkCache`` keeps what a chunk encodes to; its bound changes speed and never results.
"""

from __future__ import annotations

from collections.abc import Callable


def regular(text: str) -> bool:
    """Whether all white space is single blanks and newlines between other characters (and no NUL is there, which marks cuts)."""
    words = text.split()
    gaps = len(words) - 1
    return gaps >= 0 and sum(map(len, words)) + gaps == len(text) and text.count(" ") + text.count("\n") == gaps and "\0" not in text


class ChunkCache:
    """chunk -> value, filled by ``encode`` for the chunks that are missing. Two generations: at its bound the present one
    becomes the one before, from which chunks that come again are taken over; the one before that is dropped."""

    def __init__(self, encode: Callable[[list[str]], list], bound: int = 330_000):
        self.encode, self.bound, self.known, self.before = encode, bound, {}, {}

    def fill(self, rows: list[list[str]]) -> Callable:
        """Make all chunks of ``rows`` known; returns the look-up."""
        chunks = set().union(*rows)
        new = chunks.difference(self.known)
        if len(self.known) + len(new) > self.bound:
            self.before, self.known, new = self.known, {}, chunks
        before = self.before
        again = {c: before[c] for c in new if c in before}
        self.known.update(again)
        missing = [c for c in new if c not in again]
        if missing:
            self.known.update(zip(missing, self.encode(missing)))
        return self.known.__getitem__
