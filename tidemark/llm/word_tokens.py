"""Ids of whole texts under a ``tokenizers`` vocabulary, equal to those of the plain library without ``add_special_tokens``.

Where the vocabulary's own file says that it drops white space, lower-cases and cuts at changes between letters, digits and marks
(``_BY_CHUNK``), no token reaches across white space: chunks between blanks and newlines encode independently, and a bounded
cache holds what they encode to. A chunk of lower-case Latin-1 letters is one word, for which a copy of the tokenizer without
normaliser and splitter gives the same ids in less time. Texts that spell an added token (the plain library makes that token of it), texts with
other white space and all texts under another vocabulary go to the library whole.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer, pre_tokenizers

from tidemark.llm.chunk_tokens import ChunkCache
from tidemark.llm.common import held

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallel unit

_LATIN = bytes(range(256)).decode("latin-1")
#: Latin-1 letters, digits and plain white space: what may stand around a comma or stop.
_NO_MARK = bytes(i for i, c in enumerate(_LATIN) if c.isalnum() or c in " \n")
#: White space of Latin-1 beside these two, for Python or for the library.
_OTHER_WHITE = frozenset(b"\t\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0")
_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"  # ASCII marks but the apostrophe, which may begin an ending
#: What a vocabulary's file must say for its texts to be cut into chunks.
_BY_CHUNK = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}


def _chunks_of(text: str) -> list[str] | None:
    """The chunks of a text between spaces and newlines, in fewer different forms that have the same ids: Latin-1 text
    in lower case, commas and stops apart from words. None if there is other white space."""
    try:
        marks = text.encode("latin-1").translate(None, _NO_MARK)
    except UnicodeEncodeError:
        row = text.split()
        return row if len(text) - sum(map(len, row)) == text.count(" ") + text.count("\n") else None
    text = text.lower()
    if marks:
        if not _OTHER_WHITE.isdisjoint(marks):
            return None
        if not marks.strip(b",.") and not any(x in text for x in ("..", ".,", ",.", ",,")):
            text = text.replace(", ", " , ").replace(". ", " . ").replace(".\n", " . ")
    return text.split()


class WordTokens:
    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        # How an added token begins, up to its first letter: a text without that spells none, in any case of letters.
        self.openings = {re.match(r"[^\w\s]*", t.content)[0] for t in self.library.get_added_tokens_decoder().values()}
        model = said["model"]
        self.by_chunk = all(said.get(k) == v for k, v in _BY_CHUNK.items()) and model.get("end_of_word_suffix") == "</w>" and not model.get("dropout") and not said.get("post_processor") and not said["truncation"] and not said["padding"] and "" not in self.openings
        self.words = Tokenizer.from_file(path)  # for lower-case words between blanks
        self.words.normalizer = None
        self.words.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.words.model._resize_cache(0)  # each word comes once: the chunk cache holds it
        self.last = np.zeros(self.library.get_vocab_size(), bool)
        self.last[[i for t, i in self.library.get_vocab().items() if t.endswith("</w>")]] = True  # every word's last id, and no other
        self.chunks = ChunkCache(self._chunks)
        self.tails = ChunkCache(self._plain, 10_000)

    def _plain(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, np.uint32).tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, words: list[str], step: int = 256) -> Iterator[bytes]:
        """The ids of lower-case words of Latin-1 letters, many to a call, told apart by their last ids."""
        for e in self.words.encode_batch_fast([" ".join(words[i : i + step]) for i in range(0, len(words), step)], add_special_tokens=False):
            ids = np.array(e.ids, np.uint32)
            ends = ((np.flatnonzero(self.last[ids]) + 1) * 4).tolist()
            data = ids.tobytes()
            yield from map(data.__getitem__, map(slice, [0, *ends], ends))

    def _chunks(self, chunks: list[str]) -> list[bytes]:
        """Chunks with marks behind a word are the word's ids and the marks' ids, as the splitter cuts there."""
        words, others, where = [], [], []
        for c in chunks:
            bare = c if c.isalpha() else c.rstrip(_MARKS)
            if bare.isalpha() and bare.islower() and (bare.isascii() or max(bare) < "Ā"):
                words.append(bare)
                where.append(c[len(bare) :])
            else:
                others.append(c)
                where.append(None)
        word, other = self._words(words), iter(self._plain(others))
        tail = self.tails.fill([[t for t in where if t]])
        return [next(other) if t is None else next(word) + tail(t) if t else next(word) for t in where]

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, unsigned 32-bit."""
        cut = [_chunks_of(t) if self.by_chunk and not any(x in t for x in self.openings) else None for t in texts]
        get = self.chunks.fill([row for row in cut if row])
        return [np.frombuffer(b"".join(map(get, row)) if row is not None else self._plain([text])[0], np.uint32) for text, row in zip(texts, cut)]


def word_tokens(name: str) -> WordTokens:
    """The worker's tokens: their cache outlives a task."""
    return held(("word_tokens", name), lambda: WordTokens(public_tokenizers.path(name)))
