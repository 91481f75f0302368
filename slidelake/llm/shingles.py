"""Sets of word shingles, as 64-bit hashes, for whole columns of texts at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

#: Bytes of text hashed at a time; a longer text is a chunk of its own.
CHUNK = 1 << 18
#: Words of more bytes are hashed one by one.
LONG = 1000
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_VALUES = np.random.default_rng(20_01).integers(1, 2**64, 256, np.uint64)
_BASE = 0x9E3779B97F4A7C15
_powers: dict[int, np.ndarray] = {}


def mixed(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A permutation of the 64-bit numbers, another one for each seed."""
    x = x + np.uint64(0x9E3779B97F4A7C15 * (seed + 1) & 2**64 - 1)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers_of(base: int, n: int) -> np.ndarray:
    """1, base, base**2, ... modulo 2**64; those of a chunk are kept."""
    if n > CHUNK or base not in _powers:
        made = np.full(max(n, CHUNK) + 1, base, np.uint64)
        made[0] = 1
        np.cumprod(made, out=made)
        if n > CHUNK:
            return made
        _powers[base] = made
    return _powers[base]


def token_sets(texts: pa.Array, k: int) -> Iterator[np.ndarray]:
    """Per text the sorted hashes of its distinct k-word shingles; of fewer words, their sequence.

    Words are runs of bytes other than ASCII white space, A-Z in lower case. Null has none.
    """
    if texts.null_count:
        texts = texts.fill_null("")
    width = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    bounds = np.frombuffer(texts.buffers()[1], width)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    data, at = np.frombuffer(texts.buffers()[2] or b"", np.uint8), 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + CHUNK, "right")) - 1)
        yield from _chunk(data[bounds[at] : bounds[to]], bounds[at : to + 1] - bounds[at], k)
        at = to


def _windows(words: np.ndarray, k: int) -> np.ndarray:
    n = len(words) - k + 1
    sums = np.full(max(0, n), k, np.uint64)
    for j in range(k if n > 0 else 0):
        sums = mixed(sums) + words[j : j + n]
    return mixed(sums)


def _chunk(data: np.ndarray, bounds: np.ndarray, k: int) -> Iterator[np.ndarray]:
    data = _LOWER[data]
    inside, cut = ~_SPACE[data], np.zeros(len(data) + 1, bool)
    cut[bounds] = True
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1] | cut[1:-1]
    ends[:-1] &= ~inside[1:] | cut[1:-1]
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    # a word's hash: its bytes' values times powers of a base, less the power of its place
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_VALUES[data] * _powers_of(_BASE, len(data))[: len(data)], out=sums[1:])
    words = mixed((sums[stops] - sums[starts]) * _powers_of(pow(_BASE, -1, 2**64), len(data))[starts])
    for i in np.flatnonzero(stops - starts > LONG):
        words[i] = xxhash.xxh3_64_intdigest(data[starts[i] : stops[i]].tobytes())
    windows, first = _windows(words, k), np.searchsorted(starts, bounds)
    for a, b in zip(first.tolist(), first[1:].tolist()):
        tokens = windows[a : b - k + 1] if b - a >= k else _windows(words[a:b], b - a) if b > a else words[a:a]
        tokens = np.sort(tokens)
        yield tokens[np.append(True, tokens[1:] != tokens[:-1])] if len(tokens) else tokens
