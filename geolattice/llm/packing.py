"""Order-preserving packing of documents into fixed-length token sequences by dynamic programming."""
from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from geolattice.llm import text as tx

#: Distinct chunks whose ids a worker remembers; others are encoded again, with the same result.
REMEMBERED = 250_000
#: Tokens that one dynamic programme looks at; its last window is carried into the next.
HORIZON = 1 << 21
_loaded: dict[str, "Encoder"] = {}


def _byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write for the 256 bytes."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Ids of whole texts as little-endian unsigned 32-bit bytes.

    The file's added tokens are taken out first, as the tokenizers library does by default: their strings in a text are their ids. What is between them is
    cut before each single space that a visible character follows: no token of this vocabulary's pattern reaches over such a place, so the chunks' ids, which
    repeat, can be remembered.
    """

    def __init__(self, path: str) -> None:
        import public_tokenizers
        import tiktoken
        with open(path, encoding="utf-8") as f:
            whole = json.load(f)
        model = whole["model"]
        letters = _byte_letters()
        ranks = {bytes(letters[c] for c in token): i for token, i in model["vocab"].items() if all(c in letters for c in token)}
        added = {i for i in model["vocab"].values()} - set(ranks.values())
        ranks = {token: i for token, i in ranks.items() if i < 256 + len(model["merges"])}
        self.core = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        size = max(ranks.values()) + 1
        size = max([size, *(t["id"] + 1 for t in whole.get("added_tokens") or [])])
        self.ends = np.zeros(size + len(added) + 1, bool)   # ids that end a sentence
        for token, i in ranks.items():
            self.ends[i] = token[-1:] in (b".", b"!", b"?") or b"\n" in token
        self.added = {t["content"]: np.array([t["id"]], "<u4").tobytes() for t in whole.get("added_tokens") or []}
        self.between = re.compile("(" + "|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        self.irregular = re.compile(r" (?=\s|$)")
        self.known: dict[str, bytes] = {}

    def encode(self, text: str) -> bytes:
        if self.between is None or not any(t in text for t in self.added):
            return self._plain(text)
        return b"".join(self.added[part] if k % 2 else self._plain(part) for k, part in enumerate(self.between.split(text)))

    def _plain(self, text: str) -> bytes:
        if self.irregular.search(text):
            return np.array(self.core.encode_ordinary(text), "<u4").tobytes()
        known, out = self.known, []
        first, *rest = text.split(" ")
        if first:
            out.append(np.array(self.core.encode_ordinary(first), "<u4").tobytes())
        for chunk in rest:
            ids = known.get(chunk)
            if ids is None:
                ids = np.array(self.core.encode_ordinary(" " + chunk), "<u4").tobytes()
                if len(known) < REMEMBERED:
                    known[chunk] = ids
            out.append(ids)
        return b"".join(out)


def encoder(path: str) -> Encoder:
    if path not in _loaded:
        _loaded[path] = Encoder(path)
    return _loaded[path]


def windows(places: np.ndarray, penalty: np.ndarray, size: int, hard: float) -> list[int]:
    """Ends of the windows that cut the stream with least padding plus penalties.

    `places`: where cuts may fall, ascending, from 0 to the stream's end; `penalty` of each. A window holds at most `size`
    tokens and is padded to it. Between two places may also lie one cut off any place, at a full
    window, for `hard`. With g(i) = f(i) + places[i], f(j) is the least g over the places within reach, plus terms of j alone: a window
    that slides with j, whose minimum a monotone queue hands over in constant time; one queue for one window, one for two.
    """
    pos, pen = places.tolist(), penalty.tolist()
    m = len(pos)
    f, g, back = [0.0] * m, [0.0] * m, [0] * m
    near, far = [0], []          # indices whose g ascends
    nh = fh = 0
    moved = 0                    # the first index not yet beyond one window
    for j in range(1, m):
        p = pos[j]
        while pos[moved] < p - size:
            v = g[moved]
            while len(far) > fh and g[far[-1]] >= v:
                far.pop()
            far.append(moved)
            moved += 1
        while nh < len(near) and near[nh] < moved:
            nh += 1
        while fh < len(far) and pos[far[fh]] < p - 2 * size:
            fh += 1
        best, who = 1e18, j - 1
        if nh < len(near):
            who = near[nh]
            best = g[who] + size - p
        if fh < len(far) and (v := g[far[fh]] + 2 * size - p + hard) < best:
            best, who = v, far[fh]
        best += pen[j]
        f[j], back[j] = best, who
        v = best + p
        g[j] = v
        while len(near) > nh and g[near[-1]] >= v:
            near.pop()
        near.append(j)
    cuts, j = [], m - 1
    while j > 0:
        cuts.append(pos[j])
        if pos[j] - pos[back[j]] > size:
            cuts.append(pos[back[j]] + size)
        j = back[j]
    return cuts[::-1]


def _places(ids: np.ndarray, ends: np.ndarray, doc_ends: np.ndarray, size: int, soft: float, hard: float) -> tuple[np.ndarray, np.ndarray]:
    stops = np.flatnonzero(ends[ids]) + 1
    cost = np.full(len(stops), soft)
    at = np.concatenate([[0], stops, doc_ends])
    cost = np.concatenate([[0.0], cost, np.zeros(len(doc_ends))])
    order = np.lexsort((cost, at))
    at, cost = at[order], cost[order]
    first = np.concatenate([[True], np.diff(at) > 0])
    at, cost = at[first], cost[first]
    for i in np.flatnonzero(np.diff(at) > size)[::-1].tolist():   # text without any sentence end
        extra = np.arange(at[i] + size // 8, at[i + 1], size // 8)
        at, cost = np.insert(at, i + 1, extra), np.insert(cost, i + 1, np.full(len(extra), hard))
    return at, cost


_OUT = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])


def pack(docs: DataFrame, tokenizer: str | None = None, size: int = 2048, end_id: int = 1, soft: float = 1.0, hard: float = 16.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack all documents, in the order of their ids, into sequences of at most `size` tokens.

    The stream of documents (their ids by the tokenizer, then `end_id`) is cut into windows at document ends (free), sentence
    ends (`soft` tokens' worth) or, seldom, elsewhere (`hard`), so that padding plus these penalties is least. `size` must be a power
    of two. Returns one row per piece: `doc_id`, `start`, `length`, `ids` (binary, little-endian unsigned 32-bit), `doc_tokens`, `sequence_id`, `offset`.

    Defined cases: a null or empty text is the end id alone. Rows that repeat are packed as often as they come, in the order of
    their texts' hashes; null ids come first. Extra columns are ignored. Control strings in a text are ordinary text.

    Scale: rows are dealt out by ranges of the id (and text hash, which splits an id with very many rows) and sorted; every range is a stream of
    its own and pads its last window only. A task holds `HORIZON` tokens or one document.
    """
    if tokenizer is None:
        import public_tokenizers
        tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    rows = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        ends = np.concatenate([enc.ends, np.zeros(max(0, end_id + 1 - len(enc.ends)), bool)])
        last = np.array([end_id], "<u4").tobytes()
        sequence = TaskContext.get().partitionId() << 40
        docs_held: list[tuple[int | None, int, int, int]] = []   # id, first token in it, tokens here, all its tokens
        parts: list[bytes] = []
        held = 0

        def emit(final: bool) -> pa.RecordBatch | None:
            nonlocal sequence, docs_held, parts, held
            ids = np.frombuffer(b"".join(parts), "<u4")
            bounds = np.cumsum([0, *(d[2] for d in docs_held)])
            cuts = windows(*_places(ids, ends, bounds[1:], size, soft, hard), size, hard)
            if not final:
                cuts = cuts[:-1]
            stop = cuts[-1] if cuts else 0
            edges = np.union1d(np.concatenate([[0], cuts]), bounds[bounds <= stop]).astype(np.int64)
            starts, lengths = edges[:-1], np.diff(edges)
            owner = np.searchsorted(bounds, starts, side="right") - 1
            window = np.searchsorted(np.array(cuts), starts, side="right")
            window_start = np.concatenate([[0], cuts])[window] if len(cuts) else starts
            own = [docs_held[i] for i in owner]
            raw = memoryview(ids.tobytes())
            batch = pa.record_batch([pa.array([d[0] for d in own], pa.int64()), pa.array(starts - bounds[owner] + np.array([d[1] for d in own], np.int64), pa.int64()),
                                     pa.array(lengths, pa.int64()), pa.array([bytes(raw[4 * a:4 * (a + n)]) for a, n in zip(starts.tolist(), lengths.tolist())], pa.binary()),
                                     pa.array([d[3] for d in own], pa.int64()), pa.array(window + sequence, pa.int64()), pa.array(starts - window_start, pa.int64())], schema=_OUT)
            sequence += len(cuts)
            rest = int(np.searchsorted(bounds, stop, side="right")) - 1
            left = docs_held[rest:]
            if left:
                d, cut = left[0], int(stop - bounds[rest])
                left[0] = (d[0], d[1] + cut, d[2] - cut, d[3])
            docs_held, parts, held = left, [bytes(raw[4 * stop:])], len(ids) - stop
            return batch

        for batch in tx.slices(batches, "text"):
            for doc, body in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                ids = enc.encode(body) + last
                parts.append(ids)
                docs_held.append((doc, 0, len(ids) // 4, len(ids) // 4))
                held += len(ids) // 4
                if held >= HORIZON:
                    yield emit(False)
        if docs_held:
            yield emit(True)

    return rows.mapInArrow(run, "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
