"""Benchmark decontamination by SimHash windows of the items' sizes."""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from geolattice.llm import text as tx

_U = np.uint64
_BITS = np.arange(64, dtype=_U)


def signs(shingle: np.ndarray) -> np.ndarray:
    """+1 or -1 for each of a shingle hash's 64 bits."""
    return (((shingle[:, None] >> _BITS) & _U(1)).astype(np.int32) << 1) - 1


def folded(total: np.ndarray) -> np.ndarray:
    """64 sums to the fingerprint of their signs."""
    return ((total > 0).astype(_U) << _BITS).sum(1, dtype=_U)


@dataclass
class Index:
    """Items, and for every size of window one table per Hamming block over the items of that size.

    Fingerprints within `radius` differ in at most `radius // blocks` bits of some block: each block's table lists, for every value,
    the items whose block lies that near, so looking up all blocks meets every item within the radius.
    """
    ids: list
    shingles: list[np.ndarray]
    counts: list[np.ndarray]
    prints: np.ndarray
    windows: np.ndarray
    known: np.ndarray
    sizes: list[np.ndarray]       # of the items that hold each known shingle
    tables: dict[int, list[dict[int, np.ndarray]]]
    blocks: int
    radius: int

    def near(self, prints: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (print, item of that size) within the radius."""
        width = 64 // self.blocks
        at, item = [], []
        for b, table in enumerate(self.tables[size]):
            part = (prints >> _U(b * width)) & _U((1 << width) - 1)
            for value in np.unique(part).tolist():
                found = table.get(value)
                if found is not None:
                    rows = np.flatnonzero(part == _U(value))
                    at.append(np.repeat(rows, len(found)))
                    item.append(np.tile(found, len(rows)))
        if not at:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        pair = np.unique(np.concatenate(at) * len(self.ids) + np.concatenate(item))
        at_, item_ = pair // len(self.ids), pair % len(self.ids)
        close = np.bitwise_count(prints[at_] ^ self.prints[item_]) <= self.radius
        return at_[close], item_[close]


def build_index(ids: list, texts: list[str], width: int = 5, blocks: int = 8, radius: int = 23) -> Index:
    data, ends = tx.joined([t.lower() for t in texts])
    word, owner, *_ = tx.words(data, ends, tx.ALNUM, None)
    shingle, own, _ = tx.shingles(word, owner, len(texts), width)
    cut = np.searchsorted(own, np.arange(len(texts) + 1))
    sets = [np.unique(shingle[a:b], return_counts=True) for a, b in zip(cut, cut[1:])]
    prints = np.array([folded(signs(shingle[a:b]).sum(0)[None])[0] if b > a else 0 for a, b in zip(cut, cut[1:])], _U)
    size = cut[1:] - cut[:-1]
    full = np.flatnonzero(size > 0)
    known, at = np.unique(shingle, return_inverse=True)
    pairs = np.unique(at * (int(size.max(initial=0)) + 1) + size[own]) if len(own) else np.zeros(0, np.int64)
    base = int(size.max(initial=0)) + 1
    split = np.searchsorted(pairs // base, np.arange(len(known) + 1))
    sizes = [pairs[i:j] % base for i, j in zip(split, split[1:])]
    bits, reach = 64 // blocks, radius // blocks
    flips = np.array([f for f in range(1 << bits) if f.bit_count() <= reach], np.int64)
    tables: dict[int, list[dict[int, np.ndarray]]] = {}
    for n in np.unique(size[full]).tolist():
        alike = full[size[full] == n]
        tables[n] = []
        for b in range(blocks):
            part = ((prints[alike] >> _U(b * bits)) & _U((1 << bits) - 1)).astype(np.int64)
            value, item = (flips[None] ^ part[:, None]).ravel(), np.repeat(alike, len(flips))
            order = np.argsort(value, kind="stable")
            value, item = value[order], item[order]
            ends_ = np.flatnonzero(np.diff(np.append(value, -1)))
            tables[n].append({int(value[e]): x for e, x in zip(ends_, np.split(item, ends_[:-1] + 1))})
    return Index(ids, [x[0] for x in sets], [x[1] for x in sets], prints, size, known, sizes, tables, blocks, radius)


def _overlap(a: np.ndarray, n: np.ndarray, b: np.ndarray, m: np.ndarray) -> float:
    """Weighted Jaccard similarity of two shingle multisets."""
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    least = np.minimum(n[i], m[j]).sum()
    return float(least / (n.sum() + m.sum() - least))


def search(texts: list[str], index: Index, width: int, similarity: float) -> list[tuple[int, int, int, int, float]]:
    """(text, item, first word, words, similarity) of each item's best window in each text, where it is similar enough.

    A window can only be similar to an item if it shares a shingle with it, so windows are laid, at every offset, around each shared
    shingle and in the sizes of the items that own it; all such windows are fingerprinted and looked up.
    """
    data, ends = tx.joined([t.lower() for t in texts])
    word, owner, *_ = tx.words(data, ends, tx.ALNUM, None)
    shingle, own, first = tx.shingles(word, owner, len(texts), width)
    if not len(shingle) or not len(index.known):
        return []
    at = np.minimum(np.searchsorted(index.known, shingle), len(index.known) - 1)
    hits = np.flatnonzero(index.known[at] == shingle)
    best: dict[tuple[int, int], tuple[float, int, int]] = {}
    lo = np.searchsorted(own, np.arange(len(texts)))
    hi = np.searchsorted(own, np.arange(len(texts)), side="right")
    for t in np.unique(own[hits]).tolist():
        a, b = int(lo[t]), int(hi[t])
        mine = hits[(hits >= a) & (hits < b)]
        sums = np.zeros((b - a + 1, 64), np.int32)
        np.cumsum(signs(shingle[a:b]), axis=0, out=sums[1:])
        owned = [index.sizes[k] for k in at[mine].tolist()]
        spread, sized = np.repeat(mine - a, [len(x) for x in owned]), np.concatenate(owned)
        for size in np.unique(sized).tolist():
            n = b - a
            real = min(size, n)
            rows = np.unique(spread[sized == size])
            mark = np.zeros(n + 1, np.int32)      # starts whose window holds a wanted shingle
            np.add.at(mark, np.maximum(rows - real + 1, 0), 1)
            np.add.at(mark, np.minimum(rows + 1, n), -1)
            starts = np.flatnonzero(np.cumsum(mark[:n]) > 0)
            starts = starts[starts + real <= n]
            for block in np.array_split(starts, max(1, len(starts) // 8192)):
                prints = folded(sums[block + real] - sums[block])
                w, i = index.near(prints, size)
                for start, item in zip(block[w].tolist(), i.tolist()):
                    s, c = np.unique(shingle[a + start:a + start + real], return_counts=True)
                    sim = _overlap(s, c, index.shingles[item], index.counts[item])
                    if sim >= similarity - 1e-12 and (sim, -start) > (known := best.get((t, item), (-1.0, 0, 0)))[:1] + (-known[1],):
                        best[(t, item)] = (sim, start, real)
    return [(t, item, int(first[lo[t] + s] - first[lo[t]]), r + width - 1, sim) for (t, item), (sim, s, r) in best.items()]


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
               width: int = 5, similarity: float = 0.8, radius: int = 23, block_chars: int = 16_000_000) -> DataFrame:
    """Pairs of a document and a benchmark item that some window of the document nearly repeats.

    Words are runs of letters and digits in lower case; shingles are `width` words, weighted by how often they come. Items and
    windows of as many shingles get 64-bit SimHash fingerprints; those within `radius` bits are found over Hamming blocks and
    verified by the exact weighted Jaccard similarity, which must reach `similarity`. Returns doc_id, item_id, first_word, n_words, similarity: the best window, the first at ties.

    Defined cases: null or empty texts and items, and those without words, match nothing; an item of fewer than `width` words is one shingle; documents shorter than an item
    are compared whole; repeated rows of documents repeat their pairs, repeated items count once per row; null ids are carried. Extra columns are ignored.

    Scale: the benchmark is the query set. It is read in blocks of at most `block_chars` characters, each broadcast in turn against all documents
    (one pass per block and no shuffle), so the broadcast is bounded at any size of benchmark. Work beside hashing grows with the shared shingles only.
    """
    items = benchmark.select(F.col(item_col).alias("item_id"), F.coalesce(F.col(item_text), F.lit("")).alias("text"))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    spark = docs.sparkSession
    kinds = (rows.schema["doc_id"].dataType.simpleString(), items.schema["item_id"].dataType.simpleString())
    schema = f"doc_id {kinds[0]}, item_id {kinds[1]}, first_word long, n_words long, similarity double"

    def against(ids: list, texts: list[str]) -> DataFrame:
        shared = spark.sparkContext.broadcast(build_index(ids, texts, width, radius=radius))   # at most block_chars characters of items

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for b in tx.slices(batches, "text"):
                doc = b.column("doc_id")
                found = search(tx.column(b, "text"), index, width, similarity)
                if found:
                    yield pa.record_batch([doc.take(pa.array([f[0] for f in found])), pa.array([index.ids[f[1]] for f in found]), *[pa.array([f[j] for f in found], t) for j, t in ((2, pa.int64()), (3, pa.int64()), (4, pa.float64()))]],
                                          ["doc_id", "item_id", "first_word", "n_words", "similarity"])

        return rows.mapInArrow(run, schema)

    found, ids, texts, held = [], [], [], 0
    for r in items.toLocalIterator():
        ids.append(r.item_id)
        texts.append(r.text)
        held += len(r.text)
        if held >= block_chars:
            found.append(against(ids, texts))
            ids, texts, held = [], [], 0
    if ids or not found:
        found.append(against(ids, texts))
    return reduce(DataFrame.unionByName, found)
