"""Words and shingles of Arrow text columns as NumPy arrays.

All helpers work on whole texts. Words are hashed block by block, so memory beside the text stays
near `BLOCK` times a small factor plus a few numbers per word, whatever the length of a text.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 1 << 20
#: Bytes of text that one step of a task holds at a time.
SLICE = 2 << 20
_U = np.uint64

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Letters, digits and every byte of a character outside ASCII.
ALNUM = np.array([chr(b).isalnum() if b < 128 else True for b in range(256)])
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)

_STEP = _U(0x9E3779B97F4A7C15 | 1)
_INVERSE = _U(pow(int(_STEP), -1, 1 << 64))
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits whose output bits all depend on all input bits."""
    x = x ^ (x >> _U(32))
    x = x * _U(0xD6E8FEB86659FD93)
    x ^= x >> _U(32)
    x *= _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


_BYTE = mix(np.arange(1, 257, dtype=_U) * _U(0xA0761D6478BD642F))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, BLOCK + 4096)
        _powers[:] = [np.cumprod(np.concatenate([[_U(1)], np.full(size - 1, m, _U)]), dtype=_U) for m in (_STEP, _INVERSE)]
    return _powers[0][:n], _powers[1][:n]


def column(batch: pa.RecordBatch, name: str) -> list[str]:
    return ["" if x is None else x for x in batch.column(name).to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], name: str) -> Iterator[pa.RecordBatch]:
    """The rows of all batches in pieces of about SLICE bytes of text, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.binary_length(batch.column(name)).fill_null(0).to_numpy(zero_copy_only=False)
        step = np.cumsum(sizes, dtype=np.int64) // SLICE
        cuts = [0, *(np.flatnonzero(np.diff(step)) + 1), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)


def joined(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts, one line feed after each, and where each text ends."""
    parts = [x.encode("utf-8", "surrogatepass") for x in texts]
    ends = np.cumsum([len(x) + 1 for x in parts], dtype=np.int64) - 1 if parts else np.zeros(0, np.int64)
    return np.frombuffer(b"\n".join([*parts, b""]), np.uint8), ends


def words(data: np.ndarray, ends: np.ndarray, inside: np.ndarray, fold: np.ndarray | None = LOWER) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For every maximal run of bytes marked in `inside`: its 64-bit hash, its text, its start and its end."""
    if fold is not None:
        data = fold[data]
    hashes, starts, stops = [], [], []
    at, n = 0, len(data)
    while at < n:
        to = min(n, at + BLOCK)
        if to < n:   # end the block at a separator; a longer word stretches it
            back = np.flatnonzero(~inside[data[max(at, to - 4096):to]])
            if len(back):
                to = max(at, to - 4096) + int(back[-1]) + 1
            else:
                while to < n and inside[data[to]]:
                    ahead = np.flatnonzero(~inside[data[to:to + BLOCK]])
                    to = to + int(ahead[0]) if len(ahead) else min(n, to + BLOCK)
        block = data[at:to]
        on = np.zeros(len(block) + 2, np.int8)
        on[1:-1] = inside[block]
        turn = np.diff(on)
        a, b = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
        up, down = powers(len(block) + 1)
        total = np.zeros(len(block) + 1, _U)
        np.cumsum(_BYTE[block] * up[:-1], out=total[1:])
        hashes.append(mix((total[b] - total[a]) * down[a]))
        starts.append(a + at)
        stops.append(b + at)
        at = to
    if not hashes:
        return np.zeros(0, _U), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    start = np.concatenate(starts)
    return np.concatenate(hashes), np.searchsorted(ends, start, side="left"), start, np.concatenate(stops)


def counts_by(owner: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(owner, minlength=n).astype(np.int64)


def shingles(word: np.ndarray, owner: np.ndarray, n: int, width: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, text and first word of every run of `width` words; a shorter text with words has one shingle of them all."""
    size = counts_by(owner, n)
    first = np.concatenate([[0], np.cumsum(size)])[:-1]
    total = np.zeros(len(word), _U)
    spread = np.zeros(len(word) + width, _U)
    spread[:len(word)] = word
    place = np.arange(len(word)) - first[owner] if len(word) else np.zeros(0, np.int64)
    left = size[owner] - place if len(word) else np.zeros(0, np.int64)
    for j in range(width):
        piece = mix(spread[j:j + len(word)] + _U(0x632BE59BD9B4E019 * (j + 1) & 0xFFFFFFFFFFFFFFFF))
        total += np.where(left > j, piece, _U(j + 1)) * _U(2 * j + 1)
    keep = (left >= width) | ((place == 0) & (left < width))
    at = np.flatnonzero(keep)
    return mix(total[at]), owner[at], at


def sequence_keys(word: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit keys of each text's whole word sequence; equal sequences have equal keys."""
    size = counts_by(owner, n)
    first = np.concatenate([[0], np.cumsum(size)])[:-1]
    place = (np.arange(len(word)) - first[owner]).astype(_U) if len(word) else np.zeros(0, _U)
    keys = []
    for seed in (0x2545F4914F6CDD1D, 0x9FB21C651E98DF25):
        term = mix(word + _U(seed)) * mix(place * _U(2) + _U(seed))
        total = np.concatenate([[_U(0)], np.cumsum(term)])
        keys.append(mix(total[first + size] - total[first] + size.astype(_U)))
    return keys[0], keys[1]


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
