"""Order MinHash fingerprints, which follow the edit distance of texts."""
from __future__ import annotations

import base64
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from geolattice.llm import text as tx

_U = np.uint64


#: Code points of the texts, and k-mers, that are worked on at once.
BLOCK = 1 << 16
#: The bits of a k-mer's hash that give way to its place when places are sorted by k-mer.
PLACE = 20


def fingerprint(text: str, k: int = 6, tuples: int = 64, size: int = 2) -> np.ndarray:
    """`tuples` hashes of 32 bits. Each of as many random orders ranks all of the text's k-mers, every occurrence numbered; its `size`
    least, put back into text order, are hashed together.

    A text of fewer than k code points is one k-mer; an empty text has none and gives zeros.
    """
    return fingerprints_of([text], k, tuples, size)[0]


def fingerprints_of(texts: list[str], k: int = 6, tuples: int = 64, size: int = 2) -> np.ndarray:
    """One row per text. Texts are taken together up to BLOCK code points; a longer one is taken alone."""
    made, group, weight = [np.zeros((0, tuples), np.uint32)], [], 0
    for t in texts:
        if group and weight + len(t) > BLOCK:
            made.append(_together(group, k, tuples, size))
            group, weight = [], 0
        group.append(t)
        weight += len(t)
    if group:
        made.append(_together(group, k, tuples, size))
    return np.concatenate(made)


def _together(texts: list[str], k: int, tuples: int, size: int) -> np.ndarray:
    keys, many = numbered(texts, k)
    total = np.zeros((len(texts), tuples), _U)
    first = np.cumsum(many) - many
    for i in np.flatnonzero((many > 0) & (many <= size)).tolist():
        for j in range(many[i]):
            total[i] = tx.mix(total[i] * _U(3) + keys[first[i] + j])
    rest = np.flatnonzero(many > size)
    if len(rest):
        best = _least(keys, np.repeat(np.arange(len(texts)), many), many, rest, tuples, size)
        for j in range(size):
            total[rest] = tx.mix(total[rest] * _U(3) + keys[best[rest, :, j]])
    return (total >> _U(32)).astype(np.uint32)


def numbered(texts: list[str], k: int) -> tuple[np.ndarray, np.ndarray]:
    """A key for every k-mer of the texts in text order, and how many each text has; equal k-mers of a text differ by how many came before."""
    code = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    length = np.array([len(t) for t in texts], np.int64)
    start = np.cumsum(length) - length
    many = np.where(length > 0, np.maximum(length - k + 1, 1), 0)
    wide = np.concatenate([code, np.zeros(k - 1, np.uint32)])
    kmer = np.zeros(len(code), _U)
    for j in range(k):
        kmer *= _U(0x9E3779B97F4A7C15)
        kmer += wide[j:j + len(code)]
    for i in np.flatnonzero((length > 0) & (length < k)).tolist():
        whole = 0
        for c in code[start[i]:start[i] + length[i]].tolist():
            whole = (whole * 0x9E3779B97F4A7C15 + c) & 0xFFFFFFFFFFFFFFFF
        kmer[start[i]] = whole
    kmer = tx.mix(kmer) >> _U(PLACE) << _U(PLACE)
    parts = []
    for a, n in zip(start.tolist(), many.tolist()):
        own = kmer[a:a + n]
        parts.append(own)
        if n < 2:
            continue
        if n <= 1 << PLACE:
            held = np.sort(own | np.arange(n, dtype=_U))       # text order within equal k-mers
            order = None
        else:
            order = np.argsort(own, kind="stable")
            held = own[order]
        again = np.flatnonzero((held[1:] ^ held[:-1]) < _U(1 << PLACE)) + 1
        if len(again):
            head = np.concatenate([[True], np.diff(again) > 1])         # each run of equal k-mers
            number = np.arange(len(again)) - np.flatnonzero(head)[np.cumsum(head) - 1] + 1
            at = (held[again] & _U((1 << PLACE) - 1)).astype(np.int64) if order is None else order[again]
            own[at] += number.astype(_U) * _U(0xC2B2AE3D27D4EB4F)
    return tx.mix(np.concatenate(parts)), many


def _least(keys: np.ndarray, owner: np.ndarray, many: np.ndarray, texts: np.ndarray, tuples: int, take: int) -> np.ndarray:
    """(all texts, tuples, take): the places of the least keys of every order, ascending, for the named texts, which have more than `take` keys.

    A key meets the orders at the times of its own random process, each time a random one of them; its rank in an order is when it first
    meets it, so ranks are independent and every order ranks all keys. Only times below a bound are worked out: an order that
    `take` keys have met by then has its least among them, and the bound is doubled until all orders have.
    """
    best = np.full((len(many), tuples, take), -1)
    bound = (4.0 * take + 2) / np.maximum(many, 1)
    while len(texts):
        open_ = np.zeros(len(many), bool)
        open_[texts] = True
        todo = np.flatnonzero(open_[owner])
        met = [_meetings(keys, todo[at:at + BLOCK], bound[owner[todo[at:at + BLOCK]]], tuples) for at in range(0, len(todo), BLOCK)]
        time, order, place = (np.concatenate([m[i] for m in met]) for i in range(3))
        group = owner[place] * tuples + order
        flat = best.reshape(-1, take)
        for j in range(take):
            low = np.full(len(flat), np.inf)
            np.minimum.at(low, group, time)
            hit = np.flatnonzero(time == low[group])
            flat[group[hit], j] = place[hit]
            keep = np.flatnonzero(place != flat[group, j])        # a key counts in an order from their first meeting
            time, group, place = time[keep], group[keep], place[keep]
        short = (best[texts] < 0).any((1, 2))
        texts = texts[short]
        best[texts] = -1
        bound[texts] *= 2
    return np.sort(best, axis=2)


def _meetings(keys: np.ndarray, place: np.ndarray, bound: np.ndarray, tuples: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Times below the bounds, orders and places of all meetings of the keys at `place`. One order is met in a unit of time on average."""
    times, orders, places = [], [], []
    state, time = keys[place], np.zeros(len(place))
    while len(place):
        state = tx.mix(state + _U(0x9E3779B97F4A7C15))
        # a chance of at most exp(-tuples x time left) ends a key's process: most go without a logarithm
        keep = np.flatnonzero((state >> _U(16)) >= (np.exp(-tuples * (bound - time)) * 2.0 ** 48).astype(_U)) if times else \
            np.flatnonzero((state >> _U(16)) >= np.repeat(*_runs(bound, tuples)))
        state, time, place, bound = state[keep], time[keep], place[keep], bound[keep]
        time = time - np.log(((state >> _U(16)) + _U(1)) * 2.0 ** -48) / tuples
        times.append(time)
        orders.append(((state & _U(0xFFFF)) * _U(tuples) >> _U(16)).astype(np.int64))
        places.append(place)
    return np.concatenate(times), np.concatenate(orders), np.concatenate(places)


def _runs(bound: np.ndarray, tuples: int) -> tuple[np.ndarray, np.ndarray]:
    """The least first draw that stays below each bound, and for how many keys on end."""
    at = np.concatenate([[0], np.flatnonzero(np.diff(bound)) + 1])
    return (np.exp(-tuples * bound[at]) * 2.0 ** 48).astype(_U), np.diff(np.concatenate([at, [len(bound)]]))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """The share of equal tuples, 0 to 1."""
    return float((a == b).mean())


def written_out(f: np.ndarray) -> str:
    return base64.b64encode(f.astype("<u4").tobytes()).decode()


def edited(text: str, following: str) -> str:
    """The last half (rounded down) replaced by as many first code points of the following text, or all it has."""
    n = len(text) // 2
    return text[:len(text) - n] + following[:n]


def _above(value: Column, bounds: list[int]) -> Column:
    """How many of the descending bounds lie above the value, by way of every k-th of them first."""
    k = max(1, math.isqrt(len(bounds)))
    count = lambda held: F.size(F.filter(held, lambda b: b > value))
    coarse = count(F.lit(bounds[::k]).cast("array<long>"))
    fine = F.slice(F.lit(bounds).cast("array<long>"), (coarse - 1) * k + 1, F.lit(k))
    return F.when(coarse == 0, F.lit(0)).otherwise((coarse - 1) * k + count(fine))


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranges: int | None = None) -> DataFrame:
    """Rows sorted within tasks so that each text is followed by the next one's, in descending order of ids; after the last comes the first.

    Rows: `part`, `doc_id`, `text`, `extra`. The ids are cut into ranges, `part`, from a sample's bounds; the first row of each range also ends the range
    before it, as `extra`. One shuffle of the texts, no global sort or window. Equal ids follow in descending order of text; null ids come last.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    spark = docs.sparkSession
    ranges = ranges or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    bounds = rows.agg(F.percentile_approx("doc_id", [i / ranges for i in range(1, ranges)], F.lit(20 * ranges))).first()[0] if ranges > 1 else []
    bounds = sorted(set(bounds or []), reverse=True)     # at most `ranges` numbers
    part = F.when(F.col("doc_id").isNull(), F.lit(len(bounds))).otherwise(_above(F.col("doc_id"), bounds))
    heads = rows.select(part.alias("part"), "doc_id").groupBy("part").agg(F.max("doc_id").alias("head")).orderBy("part").collect()   # one row per range
    before = {r.part: heads[i - 1].part for i, r in enumerate(heads)}
    rows = rows.withColumn("part", part)
    again = spark.createDataFrame([(r.part, r.head, before[r.part]) for r in heads], "p int, head long, before int")
    first = (rows.join(F.broadcast(again), (F.col("part") == F.col("p")) & F.col("doc_id").eqNullSafe(F.col("head")))   # one small row per range
             .select(F.col("before").alias("part"), "doc_id", "text", F.lit(True).alias("extra")))
    return (rows.select("part", "doc_id", "text", F.lit(False).alias("extra")).unionByName(first).repartition("part")
            .sortWithinPartitions("part", "extra", F.desc_nulls_last("doc_id"), F.desc("text")))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 6, tuples: int = 64, size: int = 2) -> DataFrame:
    """Fingerprints of every whole text, its edited text and how near its own is to that and to the next document's.

    Returns doc_id, n_chars, edited_text, fingerprint, edited_fingerprint (base64 of little-endian 32-bit tuples), near_edited, near_next.
    Defined cases: null texts are empty; the fingerprint of an empty text is all zeros, so two empty texts are alike in full;
    one document alone is its own next; repeated rows follow each other; null ids come last; an empty table gives an empty table; extra columns are ignored.
    """
    rows = with_next(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, current = None, None       # the row before, until its range has its one extra row
        for b in tx.slices(batches, "text"):
            texts = tx.column(b, "text")
            pairs = []
            for row in zip(b.column("part").to_pylist(), b.column("doc_id").to_pylist(), texts, fingerprints_of(texts, k, tuples, size), b.column("extra").to_pylist()):
                part, _, _, _, extra = row
                if part != current:
                    held, current = None, part
                elif held is None:
                    continue
                if held is not None:
                    pairs.append((held, row))
                held = None if extra else row
            if pairs:
                changed = [edited(x[2], y[2]) for x, y in pairs]
                yield _batch([(x[1], len(x[2]), t, written_out(x[3]), written_out(f), likeness(x[3], f), likeness(x[3], y[3]))
                              for (x, y), t, f in zip(pairs, changed, fingerprints_of(changed, k, tuples, size))])

    return rows.mapInArrow(run, "doc_id long, n_chars long, edited_text string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_text", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), _SCHEMA.types)], schema=_SCHEMA)
