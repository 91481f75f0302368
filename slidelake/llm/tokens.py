"""Token ids by the tokenizers library, with pieces of text kept between documents."""

from __future__ import annotations

import json
import os
from array import array
from collections.abc import Iterable, Iterator

import numpy as np

#: Bytes of words and their ids kept in a Python worker at most; what a word takes besides.
KEPT, EACH = 64 << 20, 180
#: Characters of text cut into pieces at a time.
CHUNK = 1_000_000
#: New words encoded in one text; the byte-level form of a space.
JOINED, SPACE = 200, "\u0120"
_encoders: dict[str, Encoder] = {}


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """Path of a public tokenizer's file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Encodes whole texts to little-endian unsigned 32-bit ids.

    A byte-level BPE never merges across the start of a word, and a single space belongs to
    the word after it. So a text is cut before its spaces, and each distinct piece is encoded
    once. Where a space stands between other white space, the library splits otherwise; such
    texts, which are rare, are encoded uncut. So are all texts where the file isn't of this kind
    (byte-level pieces, no normalizer, no space put before a text).
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            of = json.load(f)
        pre = of.get("pre_tokenizer") or {}
        self.cut = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not of.get("normalizer")
        self.wide = self.tokenizer.get_vocab_size() > 1 << 16
        vocabulary = self.tokenizer.get_vocab()
        self.opening = np.zeros(max(vocabulary.values()) + 1, bool)
        self.opening[[i for t, i in vocabulary.items() if t[:1] == SPACE]] = True
        # words met of late, and those before them; half of what may be kept each
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.size = 0
        self.spaced: set[str] = set()

    def _batch(self, texts: list[str]) -> list[bytes]:
        return [array("I", x.ids).tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, words: set[str]) -> None:
        """Encodes words, after a space each, many in a text; ids that begin with the space part them."""
        odd = {w for w in words if not w or w[-1].isspace()}
        self.spaced |= odd
        new = list(words - odd)
        for at in range(0, len(new), JOINED * 64):
            some = [new[i : i + JOINED] for i in range(at, min(at + JOINED * 64, len(new)), JOINED)]
            for part, ids in zip(some, self._batch(["".join([f" {w}" for w in part]) for part in some])):
                ends = [*(4 * np.flatnonzero(self.opening[np.frombuffer(ids, "<u4")])).tolist(), len(ids)]
                self.known.update(zip(part, [ids[i:j] for i, j in zip(ends, ends[1:])]))
        for w in odd:  # texts with these are encoded uncut
            self.known[w] = b""

    def encode(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """The ids of each text, in order; none for null. Some texts at a time are held encoded."""
        chunk: list[str] = []
        size = 0
        for text in texts:
            chunk.append(text or "")
            size += len(chunk[-1])
            if size >= CHUNK:
                yield from self._chunk(chunk)
                chunk, size = [], 0
        yield from self._chunk(chunk)

    def _chunk(self, texts: list[str]) -> list[bytes]:
        if not self.cut:
            return self._batch(texts)
        heads, words = [], []
        for text in texts:
            head, *rest = text.split(" ")
            if rest and head[-1:].isspace():
                head, rest = text, []
            heads.append(head)
            words.append(rest)
        known = self.known
        if new := set().union(*words).difference(known):
            known.update((w, self.older[w]) for w in new & self.older.keys())
            self._learn(new.difference(known))
            self.size += sum(EACH + len(w) + len(known[w]) for w in new)
        for i, rest in enumerate(words):
            if not self.spaced.isdisjoint(rest):
                heads[i], words[i] = texts[i], []
        out = [head + b"".join(map(known.__getitem__, rest)) for head, rest in zip(self._batch(heads), words)]
        if self.size > KEPT // 2:  # what was not met since the last time goes
            self.older, self.known, self.size = known, {}, 0
            self.spaced.intersection_update(known)
        return out


def encoder(path: str) -> Encoder:
    """The Python worker's encoder for a vocabulary file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
