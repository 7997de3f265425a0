"""Alignment of two tokenizers over a corpus: which tokens end together, and how often each pair of ids does."""
from __future__ import annotations

import hashlib
import itertools
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from geolattice.llm import text as tx
from geolattice.llm.packing import Encoder, _byte_letters
from geolattice.session import written

_U = np.uint64
#: Entries of a count vector that travel together.
CHUNK = 1 << 16
#: Vectors that one step of the tree adds up.
FAN = 16
#: Chunks up to so many characters whose alignment a worker remembers, and how many of them; others are aligned again, with the same result.
SHORT, REMEMBERED = 48, 500_000
_CUT = re.compile(r"(?<=\S)(?= )")
_pairs: dict[tuple[str, str], "TokenPair"] = {}
_chunks: dict[tuple[str, str], "Chunks"] = {}


class TokenPair:
    """The two tokenizers, with the bytes of their tokens."""

    def __init__(self, first: str, second: str) -> None:
        import sentencepiece
        self.a = Encoder(first).core
        with open(first, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        letters = _byte_letters()
        self.a_bytes = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.a_bytes[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        self.b = sentencepiece.SentencePieceProcessor(model_file=second)
        byte = re.compile(r"<0x([0-9A-F]{2})>")
        self.b_bytes = []
        for i in range(self.b.vocab_size()):
            piece = self.b.id_to_piece(i)
            found = byte.fullmatch(piece)
            self.b_bytes.append(bytes([int(found[1], 16)]) if found else piece.replace("▁", " ").encode())
        self.size_b = len(self.b_bytes)
        self.a_size, self.b_size = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))
        # no piece has a space after another character: then no token of either reaches over a cut before a space that follows a visible character
        self.cuts = not any("▁" in p[p.find(p.lstrip("▁")):] for p in map(self.b.id_to_piece, range(self.size_b)) if p.strip("▁"))
        digits = max(len(str(len(self.a_bytes))), len(str(self.size_b))) + 1
        # each id in decimal, with what follows it: inside a group, at its end
        self.a_text, self.b_text = (np.array([[f"{i},", f"{i}{end}"] for i in range(n)], f"S{digits}") for n, end in ((len(self.a_bytes), "|"), (self.size_b, ";")))

    def encode(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of both for each text; none where there is no text or either one's bytes are not the text's after a space."""
        a, b = [self.a.encode_ordinary(" " + t) if t else [] for t in texts], self.b.encode(texts, num_threads=1) if texts else []
        want = [b" " + t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
        for ids, table, size in ((a, self.a_bytes, self.a_size), (b, self.b_bytes, self.b_size)):
            # all at once where every text has its length and all of them together their bytes
            flat = np.fromiter(itertools.chain.from_iterable(ids), np.int64)
            ends = np.cumsum([len(x) for x in ids])
            long = np.diff(np.concatenate([[0], np.cumsum(size[flat])])[np.concatenate([[0], ends]).astype(np.int64)])
            if long.tolist() == [len(w) for w in want] and b"".join(map(table.__getitem__, flat.tolist())) == b"".join(want):
                continue
            for k, w in enumerate(want):
                if b"".join(map(table.__getitem__, ids[k])) != w:
                    a[k], b[k], want[k] = [], [], b""
        return a, b


def token_pair(first: str, second: str) -> TokenPair:
    if (first, second) not in _pairs:
        _pairs[first, second] = TokenPair(first, second)
    return _pairs[first, second]


@dataclass
class Aligned:
    """The tokens of some texts, one after the other, and which of them end a group."""
    a: np.ndarray
    b: np.ndarray
    n_a: np.ndarray
    n_b: np.ndarray
    last_a: np.ndarray
    last_b: np.ndarray

    def keys(self, size_b: int) -> np.ndarray:
        """A number for each link's pair of ids: the two tokens that end a group end together, and no others do."""
        return self.a[self.last_a] * size_b + self.b[self.last_b]

    def link_ends(self) -> np.ndarray:
        """Where each text's links begin, and where the last one's end."""
        return np.concatenate([[0], np.cumsum(self.last_a)])[np.concatenate([[0], np.cumsum(self.n_a)])]


def align(pair: TokenPair, texts: list[str]) -> Aligned:
    """Both token sequences of each text, cut wherever tokens of both end at one byte.

    As both sequences of a text have the same bytes, the ends can be counted on through all texts.
    """
    both = pair.encode(texts)
    a, b = (np.fromiter(itertools.chain.from_iterable(x), np.int64) for x in both)
    end_a, end_b = np.cumsum(pair.a_size[a]), np.cumsum(pair.b_size[b])
    total = int(end_a[-1]) + 1 if len(end_a) else 1
    at_a, at_b = np.zeros(total, bool), np.zeros(total, bool)
    at_a[end_a] = True
    at_b[end_b] = True
    sizes = (np.array([len(x) for x in ids], np.int64) for ids in both)
    return Aligned(a, b, *sizes, at_b[end_a], at_a[end_b])


def group_texts(pair: TokenPair, al: Aligned) -> list[bytes]:
    """`a1,a2|b1;a3|b2,b3` of each text: its groups' ids in order."""
    group_a, group_b = (np.cumsum(x) - x for x in (al.last_a, al.last_b))
    before_b = np.concatenate([[0], np.flatnonzero(al.last_b) + 1])     # B tokens before each group
    upto_a = np.concatenate([np.flatnonzero(al.last_a) + 1, [len(al.a)]])   # A tokens to each group's end
    line = np.empty(len(al.a) + len(al.b), pair.a_text.dtype)
    line[np.arange(len(al.a)) + before_b[group_a]] = pair.a_text[al.a, al.last_a.astype(np.int8)]
    line[np.arange(len(al.b)) + upto_a[group_b]] = pair.b_text[al.b, al.last_b.astype(np.int8)]
    width, data = line.dtype.itemsize, line.tobytes()
    ends = (np.concatenate([[0], np.cumsum(al.n_a + al.n_b)]) * width).tolist()
    return [data[x:y].replace(b"\0", b"")[:-1] for x, y in zip(ends, ends[1:])]


def pieces(pair: TokenPair, text: str) -> list[str]:
    """A space and the text, cut where both tokenizers cut; each chunk begins with a space."""
    return _CUT.split(" " + text) if pair.cuts else [" " + text]


class Chunks:
    """Aligned chunks under numbers: text is written with few words, so most chunks come again, and a worker keeps them from task to task.

    `rows` holds of each chunk the counts of both tokens, the keys of its links and the text of its groups. A text whose chunks are not
    all given back byte by byte counts as one chunk, for the whole text decides.
    """

    def __init__(self, pair: TokenPair) -> None:
        self.pair = pair
        self.known: dict[str, int] = {}
        self.rows: list[tuple[int, int, bytes, bytes]] = []

    def _add(self, texts: list[str]) -> list[int]:
        """Numbers of new chunks; -1 for one that is not given back."""
        al = align(self.pair, texts)
        key, ends = al.keys(self.pair.size_b), al.link_ends().tolist()
        out = []
        for n_a, n_b, x, y, text in zip(al.n_a.tolist(), al.n_b.tolist(), ends, ends[1:], group_texts(self.pair, al)):
            out.append(len(self.rows) if n_a else -1)
            if n_a:
                self.rows.append((n_a, n_b, key[x:y].tobytes(), text))
        return out

    def numbers(self, texts: list[str]) -> list[list[int]]:
        """The chunks of each text; none for a text without tokens. The numbers hold until the next call."""
        if len(self.rows) > REMEMBERED:
            self.known, self.rows = {}, []
        cut = [pieces(self.pair, t) if t else [] for t in texts]
        new = list(set(itertools.chain.from_iterable(cut)).difference(self.known))
        self.known.update(zip(new, self._add([c[1:] for c in new])))
        out = [list(map(self.known.__getitem__, x)) for x in cut]
        for c in new:
            if len(c) > SHORT:
                del self.known[c]
        odd = [k for k, x in enumerate(out) if x and min(x) < 0]
        for k, i in zip(odd, self._add([texts[k] for k in odd])):
            out[k] = [i] if i >= 0 else []
        return out

    def used(self, numbers: list[list[int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of some texts' chunks: the distinct ones, which of them each chunk is, the keys of the distinct ones' links, and how many each has."""
        one, which = np.unique(np.fromiter(itertools.chain.from_iterable(numbers), np.int64), return_inverse=True)
        links = [self.rows[i][2] for i in one.tolist()]
        return one, which, np.frombuffer(b"".join(links), np.int64), np.fromiter(map(len, links), np.int64) // 8


def chunks_of(first: str, second: str) -> Chunks:
    if (first, second) not in _chunks:
        _chunks[first, second] = Chunks(token_pair(first, second))
    return _chunks[first, second]


class PerfectHash:
    """A minimal perfect hash of distinct 64-bit keys: each key of the set has its own number below their count.

    In each level the keys that are left fall into twice as many places; a key alone in its place is settled there, the rest go on. Numbers are
    the ranks of the settled places. `keys` holds the key of each number, so a key outside the set is told apart (-1), never given another's number.
    """

    def __init__(self, keys: np.ndarray, room: float = 2.0) -> None:
        self.levels: list[np.ndarray] = []      # rank of a settled place, else -1
        self.keys = np.zeros(len(keys), np.int64)
        left, done = keys, 0
        while len(left):
            size = max(1, int(len(left) * room))
            place = self._place(left, len(self.levels), size)
            alone = np.bincount(place, minlength=size) == 1
            rank = np.full(size, -1, np.int32)
            rank[alone] = done + np.arange(alone.sum())
            settled = alone[place]
            self.keys[rank[place[settled]]] = left[settled]
            self.levels.append(rank)
            done += int(settled.sum())
            left = left[~settled]

    @staticmethod
    def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (tx.mix(keys.astype(_U) + _U((level + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) % _U(size)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, -1 for one outside the set."""
        out = np.full(len(keys), -1, np.int64)
        open_ = np.arange(len(keys))
        for level, rank in enumerate(self.levels):
            if not len(open_):
                break
            got = rank[self._place(keys[open_], level, len(rank))]
            out[open_[got >= 0]] = got[got >= 0]
            open_ = open_[got < 0]
        wrong = (out >= 0) & (self.keys[out] != keys) if len(self.keys) else np.zeros(len(keys), bool)
        out[wrong] = -1
        return out


@dataclass
class LinkCounts:
    """How many links of the corpus hold each pair of ids, and the most any pair of each B id has."""
    hash: PerfectHash
    counts: np.ndarray
    best: np.ndarray


_PARTIAL = pa.schema([("key", pa.int64()), ("n", pa.int64())])
_VECTOR = pa.schema([("part", pa.int32()), ("chunk", pa.int32()), ("counts", pa.binary())])


def _merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    key, where = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.zeros(len(key), np.int64)
    np.add.at(total, where, np.concatenate(counts))
    return key, total


def _count_links(first: str, second: str, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = chunks_of(first, second)
        keys, counts, waiting = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
        for batch in tx.slices(batches, text_col):
            _, which, key, sizes = chunks.used(chunks.numbers(tx.column(batch, text_col)))
            keys.append(key)
            counts.append(np.repeat(np.bincount(which, minlength=len(sizes)), sizes))
            waiting += len(key)
            if waiting > 1 << 20:
                k, n = _merged(keys, counts)
                keys, counts, waiting = [k], [n], 0
        key, n = _merged(keys, counts)
        for at in range(0, len(key), CHUNK):
            yield pa.RecordBatch.from_arrays([pa.array(key[at:at + CHUNK]), pa.array(n[at:at + CHUNK])], schema=_PARTIAL)
    return run


def _dense(table: PerfectHash):
    """One vector of counts a task, indexed by the hash, in chunks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(table.keys), np.int64)
        for batch in batches:
            at = table.find(batch.column("key").to_numpy())
            if (at < 0).any():
                raise ValueError("a pair of ids is not in the table of pairs")
            np.add.at(total, at, batch.column("n").to_numpy())
        part = TaskContext.get().partitionId()
        for c in range(0, len(total), CHUNK):
            if total[c:c + CHUNK].any():
                yield pa.RecordBatch.from_pylist([{"part": part, "chunk": c // CHUNK, "counts": total[c:c + CHUNK].astype("<i8").tobytes()}], schema=_VECTOR)
    return run


def _add(rows: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x.as_py(), "<i8") for x in rows.column("counts"))
    return pa.Table.from_pylist([{"part": rows.column("part")[0].as_py() // FAN, "chunk": rows.column("chunk")[0].as_py(), "counts": total.tobytes()}], schema=_VECTOR)


def count_links(docs: DataFrame, first: str, second: str, text_col: str = "text") -> LinkCounts:
    """Counts of all pairs of ids that end together anywhere in the corpus.

    Each task counts the pairs of the texts it reads and writes them down. Distinct pairs get a minimal perfect hash; each task
    then lays its counts into a dense vector by that hash, and a tree of sums, FAN vectors at a time, adds them up.

    Bound: of two tokens that end together, one is an end of the other. A token's bytes have as many ends as it has bytes, so there are no more
    pairs than the bytes of both vocabularies times the few ids that share their bytes: under a million for the given ones, whatever the corpus. So the hash, its
    keys and the vector (some 20 MB) may be built on the driver and sent to every task.
    """
    pair = token_pair(first, second)
    partial = written(docs.select(text_col).mapInArrow(_count_links(first, second, text_col), "key long, n long"), "links")
    table = PerfectHash(np.sort(partial.select("key").distinct().toArrow().column("key").to_numpy()))
    vectors = partial.mapInArrow(_dense(table), "part int, chunk int, counts binary")
    width = partial.rdd.getNumPartitions()
    while width > 1:
        vectors = vectors.groupBy((F.col("part") / FAN).cast("int").alias("group"), "chunk").applyInArrow(_add, "part int, chunk int, counts binary")
        width = -(-width // FAN)
    counts = np.zeros(len(table.keys), np.int64)
    for row in vectors.collect():
        counts[row.chunk * CHUNK:(row.chunk + 1) * CHUNK] += np.frombuffer(row.counts, "<i8")
    best = np.zeros(pair.size_b, np.int64)
    np.maximum.at(best, table.keys % pair.size_b, counts)
    return LinkCounts(table, counts, best)


_OUT = pa.schema([("doc_id", pa.int64()), *[(c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")], ("groups_sha256", pa.string())])


def align_documents(docs: DataFrame, first: str | None = None, second: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's tokens by both tokenizers, aligned, with the corpus-wide counts of its links.

    `first`: file of a byte-level BPE (A), given a space and the text; `second`: a sentencepiece model (B), which adds that space itself.
    Special tokens' strings are plain text. Bytes at which tokens of both end cut a document into groups; the last tokens of a group are linked.

    Returns every input row once: `doc_id`, `n_a`, `n_b`, `n_groups`, `n_links`, `n_best` (links whose pair is the commonest of its B id, ties included),
    `count_sum` (the pairs' counts, over links) and `groups_sha256`.

    Defined cases: a null or empty text, or one that either tokenizer does not give back byte by byte after its space, has no
    tokens: zeros and ''. Repeated rows and ids count each. Null ids stay null. An empty table gives an empty table. Other columns, of any name, are not read.

    Scale: texts are read and aligned twice and never shuffled, a slice of 2 MB (or one text) at a time; see `count_links` for the counts. Chunks of text
    that come again are aligned once a worker.
    """
    import public_tokenizers
    first = first or public_tokenizers.path("byte_bpe_50k.json")
    second = second or public_tokenizers.path("piece_bpe_32k.model")
    model = count_links(docs, first, second, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = chunks_of(first, second)
        size_b = chunks.pair.size_b
        for batch in tx.slices(batches, "text"):
            numbers = chunks.numbers(tx.column(batch, "text"))
            one, which, key, links = chunks.used(numbers)
            found = model.hash.find(key)
            if (found < 0).any():
                raise ValueError("a pair of ids is not in the table of pairs")
            count = model.counts[found]
            rows = [chunks.rows[i] for i in one.tolist()]
            owner = np.repeat(np.arange(len(one)), links)
            table = np.zeros((len(one), 5), np.int64)      # n_a, n_b, links, best, count_sum of each distinct chunk
            table[:, 0], table[:, 1], table[:, 2] = [r[0] for r in rows], [r[1] for r in rows], links
            np.add.at(table[:, 3], owner, count == model.best[key % size_b])
            np.add.at(table[:, 4], owner, count)
            sizes = np.array([len(x) for x in numbers], np.int64)
            total = np.zeros((len(which) + 1, 5), np.int64)
            np.cumsum(table[which], axis=0, out=total[1:])
            ends = np.cumsum(sizes)
            n_a, n_b, n_links, best, counts = (total[ends] - total[ends - sizes]).T
            digests = [hashlib.sha256(b";".join([chunks.rows[i][3] for i in x])).hexdigest() if x else "" for x in numbers]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(x, pa.int64()) for x in (n_a, n_b, n_links, n_links, best, counts)], pa.array(digests, pa.string())], schema=_OUT)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
