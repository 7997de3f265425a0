"""Near-duplicate groups by ProbMinHash signatures, banding and exact verification."""
from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from geolattice.llm import text as tx
from geolattice.llm.groups import connected
from geolattice.session import written

_U = np.uint64


def weighted(texts: list[str], width: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """Distinct shingles of each text: text, hash, times; and the keys of the word sequences."""
    data, ends = tx.joined([t.lower() for t in texts])
    word, owner, *_ = tx.words(data, ends, tx.ALNUM, None)
    shingle, own, _ = tx.shingles(word, owner, len(texts), width)
    order = np.lexsort((shingle, own))
    o, s = own[order], shingle[order]
    new = np.flatnonzero(np.concatenate([[True], (np.diff(o) != 0) | (s[1:] != s[:-1])])) if len(o) else np.zeros(0, np.int64)
    return o[new], s[new], np.diff(np.append(new, len(o))), tx.sequence_keys(word, owner, len(texts))


def signatures(own: np.ndarray, element: np.ndarray, weight: np.ndarray, n: int, size: int) -> np.ndarray:
    """ProbMinHash signatures (n x size): each position agrees between two texts with their probability Jaccard similarity.

    Every element is a Poisson process whose rate is its weight; each arrival falls on a random position, and a position keeps the
    element that arrives there first. Arrivals are drawn round by round for all elements at once; an element is
    dropped when its latest arrival lies beyond the last first arrival of its text, as no later one can then win.
    """
    time = np.full(n * size, np.inf)
    winner = np.zeros(n * size, _U)
    doc, elem, rate, clock, step = own, element, weight.astype(float), np.zeros(len(own)), 0
    while len(doc):
        step += 1
        draw = tx.mix(elem + _U(step * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        clock = clock - np.log(((draw >> _U(12)).astype(float) + 0.5) * 2.0 ** -52)
        slot = doc * size + (tx.mix(draw ^ _U(0xA0761D6478BD642F)) >> _U(33)).astype(np.int64) % size
        arrival = clock / rate
        np.minimum.at(time, slot, arrival)
        won = arrival == time[slot]
        winner[slot[won]] = elem[won]
        live = arrival <= time.reshape(n, size).max(1)[doc]
        doc, elem, rate, clock = doc[live], elem[live], rate[live], clock[live]
    return winner.reshape(n, size)


def probability_jaccard(a: np.ndarray, x: np.ndarray, b: np.ndarray, y: np.ndarray) -> float:
    """The sum over shared elements i of 1 / sum over j of max(x_j / x_i, y_j / y_i)."""
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if not len(i):
        return 0.0
    ratio = np.log(x[i]) - np.log(y[j])
    order = np.argsort(ratio, kind="stable")
    shared = np.stack([x[i][order], y[j][order]]).astype(float)
    only_x, only_y = x.sum() - shared[0].sum(), y.sum() - shared[1].sum()
    below = np.cumsum(shared[1])                      # elements up to here: y_j / y_i is the larger
    above = shared[0].sum() - np.cumsum(shared[0])    # elements after: x_j / x_i is
    return float((1.0 / ((only_x + above) / shared[0] + (only_y + below) / shared[1])).sum())


def _prints(rows: DataFrame, width: int, bands: int, depth: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in tx.slices(batches, "text"):
            n = b.num_rows
            own, element, weight, (k1, k2) = weighted(tx.column(b, "text"), width)
            sig = signatures(own, element, weight, n, bands * depth).reshape(n, bands, depth)
            key = np.zeros((n, bands), _U)
            for d in range(depth):
                key = tx.mix(key * _U(3) + sig[:, :, d])
            some = np.bincount(own, minlength=n) > 0
            lists = [x if s else [] for x, s in zip(tx.signed(key).tolist(), some.tolist())]
            yield pa.record_batch([b.column("doc_id"), pa.array(tx.signed(k1)), pa.array(tx.signed(k2)), pa.array(lists, pa.list_(pa.int64()))], ["doc_id", "k1", "k2", "bands"])

    return rows.mapInArrow(run, "doc_id long, k1 long, k2 long, bands array<long>")


def _verified(pairs: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """Pairs (a, b) with their exact similarity. `texts`: doc_id, text of every document in a pair."""
    left = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("x")), "a")
    both = left.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("y")), "b").select("a", "b", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in tx.slices(batches, "x"):
            xs, ys = tx.column(b, "x"), tx.column(b, "y")
            n = len(xs)
            own, element, weight, _ = weighted(xs + ys, width)
            cut = np.searchsorted(own, np.arange(2 * n + 1))
            one = lambda i: (element[cut[i]:cut[i + 1]], weight[cut[i]:cut[i + 1]])
            yield pa.record_batch([b.column("a"), b.column("b"), pa.array([probability_jaccard(*one(i), *one(n + i)) for i in range(n)])], ["a", "b", "similarity"])

    return both.mapInArrow(run, "a long, b long, similarity double")


def _links_within(texts: list[str], docs: list[int], roots: list[int], first: list[bool], second: list[bool], similarity: float, width: int) -> list[tuple[int, int]]:
    """Links that join different roots, at most one fewer than roots, among all pairs of a `first` and a `second` text: the exact similarity of every pair
    is worked out, or bounded below `similarity` by the weight of its common shingles."""
    n = len(texts)
    own, element, weight, _ = weighted(texts, width)
    total, size = np.bincount(own, weight, n), np.bincount(own, minlength=n)
    cut = np.searchsorted(own, np.arange(n + 1))
    _, column, times = np.unique(element, return_inverse=True, return_counts=True)
    held = np.flatnonzero(times[column] > 1)
    _, column = np.unique(column[held], return_inverse=True)
    part = np.zeros((n, n), np.float32)        # [u, a]: u's share of weight on the shingles that it has in common with a
    order = np.argsort(column, kind="stable")
    bounds = np.searchsorted(column[order], np.arange(0, column.max(initial=-1) + 4097, 4096))
    for lo, hi in zip(bounds, bounds[1:]):
        at = order[lo:hi]
        has = np.zeros((n, 4096), np.float32)
        row, col = own[held[at]], column[at] % 4096
        has[row, col] = 1
        rate = np.zeros((n, 4096), np.float32)
        rate[row, col] = weight[held[at]] / total[row]
        part += rate @ has.T
    wanted = np.minimum(part, part.T) >= similarity - 1e-4
    wanted &= np.array(first)[:, None] & np.array(second)[None, :]
    root = {r: r for r in roots}

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    plain = size == total
    found = []
    for u, a in np.argwhere(wanted).tolist():
        p, q = top(roots[u]), top(roots[a])
        if p == q:
            continue
        if plain[u] and plain[a]:
            both = round(float(part[u, a]) * size[u])
            similar = both / (size[u] + size[a] - both)
        else:
            similar = probability_jaccard(element[cut[u]:cut[u + 1]], weight[cut[u]:cut[u + 1]], element[cut[a]:cut[a + 1]], weight[cut[a]:cut[a + 1]])
        if similar >= similarity - 1e-12:
            root[max(p, q)] = min(p, q)
            found.append((docs[u], docs[a]))
    return found


def _apart(groups: DataFrame, texts: DataFrame, similarity: float, width: int, block: int) -> DataFrame:
    """Links between the members of a hub that are in different groups. `groups`: hub, doc_id, root, linked (in the hub's own group).

    The members are dealt into blocks of about `block`, those linked to the hub apart from the others, and every two blocks that
    may hold a new link meet in one task, with their texts. Only links come out.
    """
    sizes = groups.groupBy("hub").agg(F.sum(F.col("linked").cast("int")).alias("n_linked"), F.sum(1 - F.col("linked").cast("int")).alias("n_other")).where("n_other > 0")
    sizes = sizes.select(F.bitwise_not("hub").alias("h"), F.ceil(F.col("n_linked") / block).cast("int").alias("b_linked"), F.ceil(F.col("n_other") / block).cast("int").alias("b_other"))
    dealt = groups.join(sizes, F.bitwise_not("hub") == F.col("h"))
    # blocks 0 .. b_other - 1 hold the others, those after them the linked; a pair of blocks has an other in it
    mine = F.when(F.col("linked"), F.col("b_other") + F.pmod(F.xxhash64("doc_id"), F.greatest("b_linked", F.lit(1)))).otherwise(F.pmod(F.xxhash64("doc_id"), F.col("b_other"))).cast("int")
    dealt = dealt.withColumn("mine", mine)
    others = F.when(F.col("linked"), F.sequence(F.lit(0), F.col("b_other") - 1)).otherwise(F.sequence(F.lit(0), F.col("b_other") + F.col("b_linked") - 1))
    pairs = dealt.select("hub", "doc_id", "root", "mine", F.explode(others).alias("other"))
    pairs = pairs.select("hub", "doc_id", "root", "mine", F.least("mine", "other").alias("one"), F.greatest("mine", "other").alias("two"))
    rows = pairs.join(texts.select(F.col("doc_id").alias("d"), "text"), F.col("doc_id") == F.col("d")).select("hub", "one", "two", "mine", "doc_id", "root", "text")
    rows = rows.repartition("hub", "one", "two").sortWithinPartitions("hub", "one", "two")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def members() -> Iterator[tuple]:
            for b in tx.slices(batches, "text"):
                yield from zip(*[b.column(c).to_pylist() for c in ("hub", "one", "two", "mine", "doc_id", "root", "text")])

        found: list[tuple[int, int]] = []
        for (_, one, two), group in groupby(members(), key=lambda r: r[:3]):
            held = list(group)         # two blocks
            mine = [r[3] for r in held]
            found += _links_within([r[6] for r in held], [r[4] for r in held], [r[5] for r in held], [m == one for m in mine], [m == two for m in mine], similarity, width)
            if len(found) > 4096:
                yield pa.record_batch([pa.array(x, pa.int64()) for x in zip(*found)], ["a", "b"])
                found = []
        if found:
            yield pa.record_batch([pa.array(x, pa.int64()) for x in zip(*found)], ["a", "b"])

    return rows.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.8, width: int = 5, bands: int = 32, depth: int = 6, block: int = 256) -> DataFrame:
    """Groups of documents whose texts nearly repeat each other.

    Words are runs of letters and digits in lower case, and a text is the multiset of its `width`-word shingles, weighted by how
    often they come. Two texts are linked if some band of `depth` of their ProbMinHash positions agrees and their exact probability Jaccard
    similarity is `similarity` or more (at 0.8 and the usual 32 bands of 6, a link is missed with chance 6e-5). Groups are the connected pieces.

    Returns one row per distinct id: `doc_id`, `class_id` (the least id of its group) and `copy_id` (the least id with the same word sequence).

    Defined cases: null and empty texts, and those without words, are one class and are linked to nothing else; a text of fewer than `width` words is one shingle of all
    its words; rows that repeat an id count once, by the greatest text; rows with a null id are left out, as they cannot be named; extra columns are ignored.

    Scale: equal texts become one representative first. In a bucket (one band value) every member is compared with one hub, the member that meets
    most others in all its buckets. Members that a hub leaves apart are then compared with all members of that hub, in tasks of two blocks of about
    `block` texts that give out links only, so a large group of copies gives rows in proportion to its size. Hot keys are pre-aggregated or
    meet single rows in joins that Spark can split. Nothing is collected.
    """
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    prints = written(_prints(rows, width, bands, depth), "prints")
    # repeated ids: one word sequence each
    named = written(prints.groupBy("doc_id").agg(F.max(F.struct("k1", "k2")).alias("k")).select("doc_id", "k.k1", "k.k2"), "named")
    copies = written(named.groupBy("k1", "k2").agg(F.min("doc_id").alias("copy_id")), "copies")
    members = written(named.join(copies, ["k1", "k2"]).select("doc_id", "copy_id"), "members")
    reps = copies.select("k1", "k2", F.col("copy_id").alias("doc_id"))
    banded = prints.join(reps, ["doc_id", "k1", "k2"]).dropDuplicates(["doc_id"]).select("doc_id", F.posexplode("bands").alias("band", "value"))
    banded = written(banded.select("doc_id", F.xxhash64("band", "value").alias("bucket")), "banded")
    full = banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.bitwise_not("bucket").alias("other"), "n")
    met = written(banded.join(full, F.bitwise_not("bucket") == F.col("other")).select("bucket", "doc_id", "n"), "met")
    central = written(met.groupBy(F.col("doc_id").alias("d")).agg(F.sum("n").alias("degree")), "central")
    ranked = written(met.join(central, F.col("doc_id") == F.col("d")).select("bucket", "doc_id", "degree"), "ranked")
    hubs = ranked.groupBy("bucket").agg(F.max(F.struct("degree", (-F.col("doc_id")).alias("least"))).alias("hub")).select(F.bitwise_not("bucket").alias("other"), (-F.col("hub.least")).alias("hub"))
    shared = written(ranked.join(hubs, F.bitwise_not("bucket") == F.col("other")).select("hub", "doc_id").distinct(), "shared")
    ids = shared.select(F.col("doc_id").alias("id")).distinct()
    # ids has no bound, so it is never broadcast
    texts = written(rows.join(ids.hint("merge"), F.col("doc_id") == F.col("id")).groupBy("doc_id").agg(F.max("text").alias("text")), "texts")
    star = shared.where("doc_id <> hub").select(F.col("doc_id").alias("a"), F.col("hub").alias("b"))
    links = written(_verified(star, texts, width).where(F.col("similarity") >= similarity - 1e-12).select("a", "b"), "links")
    found = connected(links)
    root = found.select(F.col("node").alias("hub_node"), F.col("root").alias("hub_root"))
    placed = shared.join(found, F.col("doc_id") == F.col("node"), "left").select("hub", "doc_id", F.coalesce("root", "doc_id").alias("root"))
    placed = placed.join(root, F.col("hub") == F.col("hub_node"), "left").select("hub", "doc_id", "root", (F.col("root") == F.coalesce("hub_root", "hub")).alias("linked"))
    more = written(_apart(written(placed, "placed"), texts, similarity, width, block), "more")
    groups = connected(links.union(more))
    return members.join(groups, F.col("copy_id") == F.col("node"), "left").select("doc_id", F.coalesce("root", "copy_id").alias("class_id"), "copy_id")
