"""Quality scores learnt from preference pairs (Bradley-Terry)."""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from geolattice.llm import text as tx
from geolattice.session import written

_SIGNS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_KIND = np.full(256, 0, np.int64)
for _i, _c in enumerate(_SIGNS):
    _KIND[ord(_c)] = 1 + _i
_BASE = 1 + len(_SIGNS)
_KIND[48:58], _KIND[65:91], _KIND[97:123], _KIND[0x80:0xC0], _KIND[0xC0:] = _BASE, _BASE + 1, _BASE + 2, _BASE + 3, _BASE + 4
_KIND[0x20], _KIND[0x0A] = _BASE + 5, _BASE + 6
KINDS = _BASE + 7
_LINE = np.ones(256, bool)
_LINE[0x0A] = False


def _distinct(owner: np.ndarray, value: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of each text, and how often its commonest one comes."""
    if not len(owner):
        return np.zeros(n), np.zeros(n)
    order = np.lexsort((value, owner))
    o, v = owner[order], value[order]
    new = np.flatnonzero(np.concatenate([[True], (np.diff(o) != 0) | (v[1:] != v[:-1])]))
    runs = np.diff(np.append(new, len(o)))
    most = np.zeros(n)
    np.maximum.at(most, o[new], runs)
    return np.bincount(o[new], minlength=n).astype(float), most


def features(texts: list[str]) -> np.ndarray:
    """A row of numbers per whole text: shares of character kinds, word and line statistics; all 0 for an empty text."""
    n = len(texts)
    data, ends = tx.joined(texts)
    size = np.diff(np.concatenate([[-1], ends])) - 1
    owner = np.repeat(np.arange(n), size + 1)
    hist = np.bincount(owner * KINDS + _KIND[data], minlength=n * KINDS).reshape(n, KINDS).astype(float)
    hist[:, _BASE + 6] -= 1   # the added line feed
    share = hist / np.maximum(size, 1)[:, None]
    word, own, start, stop = tx.words(data, ends, ~tx.SPACE)
    count = np.bincount(own, minlength=n).astype(float)
    least = np.maximum(count, 1)
    length = stop - start
    mean = np.bincount(own, length, n) / least
    spread = np.sqrt(np.maximum(0, np.bincount(own, length.astype(float) ** 2, n) / least - mean ** 2))
    last = data[stop - 1] if len(stop) else np.zeros(0, np.uint8)
    signs = np.bincount(own, (_KIND[last] >= 1) & (_KIND[last] < _BASE), n) / least
    lone = np.bincount(own, (length == 1) & (_KIND[last] < _BASE), n) / least
    capital = np.bincount(own, _KIND[data[start]] == _BASE + 1, n) / least if len(start) else np.zeros(n)
    kinds, top = _distinct(own, word, n)
    pair = tx.mix(word[:-1] * np.uint64(3) + word[1:]) if len(word) > 1 else np.zeros(0, np.uint64)
    same = own[:-1] == own[1:] if len(own) > 1 else np.zeros(0, bool)
    pairs, top_pair = _distinct(own[:-1][same], pair[same], n)
    lines, line_own, *_ = tx.words(data, ends, _LINE)
    n_lines = np.bincount(line_own, minlength=n).astype(float)
    line_kinds, _ = _distinct(line_own, lines, n)
    some = (count > 0).astype(float)
    stats = [np.log1p(count), np.log1p(size), mean, spread, signs, lone, capital, kinds / least, top / least, pairs / np.maximum(count - 1, 1), top_pair / least,
             np.log1p(n_lines), count / np.maximum(n_lines, 1) / 100, some * (1 - line_kinds / np.maximum(n_lines, 1)), np.log1p(count) * kinds / least]
    return np.concatenate([share, np.sqrt(np.maximum(share, 0)), np.stack(stats, 1)], 1)


@dataclass
class Ranker:
    """score = 1 / (1 + exp(threshold - strength)), strength the weighted sum of the scaled features."""
    middle: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float

    def strength(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.middle) / self.scale, -6, 6) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(np.clip(self.threshold - self.strength(x), -60, 60)))


def fit_ranker(x: np.ndarray, label: np.ndarray, pairs: int = 40_000, ridge: float = 1e-3, quantile: float | None = None, seed: int = 5) -> Ranker:
    """Bradley-Terry strengths: a text of label 1 is preferred to one of label 0 with the logistic of their strengths' difference.

    The loss over `pairs` drawn pairs is minimised by Newton steps. The threshold is the `quantile` of the sample's strengths, by
    default the share of label 0, so that as many texts fall below it as were marked so; it is read as the middle between the quantiles
    a fiftieth of the way to either end, which keeps it off the border of a clean gap. Without both labels all scores are 0.5.
    """
    dims = x.shape[1]
    middle, scale = (x.mean(0), np.maximum(x.std(0), 1e-4)) if len(x) else (np.zeros(dims), np.ones(dims))
    good, bad = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
    if not len(good) or not len(bad):
        return Ranker(middle, scale, np.zeros(dims), 0.0)
    z = np.clip((x - middle) / scale, -6, 6)
    rng = np.random.default_rng(seed)
    d = z[rng.choice(good, pairs)] - z[rng.choice(bad, pairs)]
    w = np.zeros(dims)
    loss = lambda w: np.logaddexp(0, -d @ w).mean() + ridge * w @ w / 2
    now = loss(w)
    for _ in range(30):
        p = 1 / (1 + np.exp(np.clip(d @ w, -60, 60)))
        gradient = -(d * p[:, None]).mean(0) + ridge * w
        curve = (d * (p * (1 - p))[:, None]).T @ d / pairs + ridge * np.eye(dims)
        step = np.linalg.solve(curve, gradient)
        rate = 1.0
        while rate > 1e-4 and (new := loss(w - rate * step)) > now:
            rate /= 2
        if rate <= 1e-4 or now - new < 1e-7:
            break
        w, now = w - rate * step, new
    level = float((label == 0).mean()) if quantile is None else quantile
    return Ranker(middle, scale, w, float(np.quantile(z @ w, around(level)).mean()))


def around(level: float) -> list[float]:
    return [level * 0.98, level * 0.98 + 0.02]


def learn(docs: DataFrame, labels: DataFrame, sample: int = 8192, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", **fit: float) -> Ranker:
    """Fit the weights on at most `sample` labelled documents, those with the least hash of their id; rows with crc32(id) mod 3 = 1 are held out.

    The threshold is the quantile over the strengths of all labelled documents that are not held out, found in one pass on Spark.
    Null ids and labels teach nothing; an id with differing labels takes their majority, and nothing at a tie.
    """
    ids = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("double").alias("y")).where("id is not null and y is not null")
    ids = ids.where(F.crc32(F.col("id").cast("string")) % 3 != 1).groupBy("id").agg(F.avg("y").alias("y")).where("y <> 0.5")
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    chosen = ids.orderBy(F.xxhash64("id"), "id").limit(sample)   # the bound of the fit
    marked = texts.join(F.broadcast(chosen), "id").select("id", "text", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in tx.slices(batches, "text"):
            x = features(tx.column(b, "text"))
            yield pa.record_batch([b.column("id").cast(pa.int64()), b.column("y"), pa.array(x.tolist(), pa.list_(pa.float64()))], ["id", "y", "x"])

    made = marked.select(F.col("id").cast("long").alias("id"), "text", "y").mapInArrow(run, "id long, y double, x array<double>")
    got = sorted((r.id, tuple(r.x), r.y) for r in made.groupBy("id").agg(F.min("x").alias("x"), F.min("y").alias("y")).collect())   # at most `sample` rows
    x = np.array([r[1] for r in got]).reshape(len(got), -1) if got else np.zeros((0, 2 * KINDS + 15))
    ranker = fit_ranker(x, np.array([float(r[2] > 0.5) for r in got]), **fit)
    if not ranker.weights.any():
        return ranker
    shared = docs.sparkSession.sparkContext.broadcast(ranker)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in tx.slices(batches, "text"):
            yield pa.record_batch([b.column("id").cast(pa.int64()), pa.array(shared.value.strength(features(tx.column(b, "text"))))], ["id", "s"])

    # texts stay where they are: only an id and a number a row meet the labels; of an id's texts the least strength counts
    judged = texts.where(F.col("id").isNotNull() & (F.crc32(F.col("id").cast("string")) % 3 != 1)).select(F.col("id").cast("long").alias("id"), "text").mapInArrow(judge, "id long, s double")
    every = written(judged.groupBy("id").agg(F.min("s").alias("s")).join(ids.select(F.col("id").cast("long").alias("id"), "y"), "id").select("y", "s"), "strengths")
    level = fit.get("quantile")
    if level is None:
        level = every.agg(F.avg(F.when(F.col("y") > 0.5, 0.0).otherwise(1.0))).first()[0]
    ends = every.agg(F.percentile_approx("s", around(level), F.lit(1_000_000))).first()[0]     # two numbers
    return replace(ranker, threshold=float(np.mean(ends)))


def score_quality(docs: DataFrame, ranker: Ranker, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """Every input row with its score: `doc_id`, `score` (0 to 1), `predicted` (1 from 0.5 up) and, if asked to carry them, `row`, the input columns.

    Only the text counts. Null texts are empty; empty texts are scored from their (zero) features; ties at 0.5 are predicted 1; repeated rows get equal scores.
    One pass over the rows without a shuffle; extra columns ride in `row`, whatever their names.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *[F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] * carry)
    names = ["doc_id", "score", "predicted", *["row"] * carry]
    shared = docs.sparkSession.sparkContext.broadcast(ranker)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in tx.slices(batches, "text"):
            s = shared.value.score(features(tx.column(b, "text")))
            yield pa.record_batch([b.column("doc_id"), pa.array(s), pa.array((s >= 0.5).astype(np.int32)), *[b.column(c) for c in names[3:]]], names)

    schema = T.StructType([rows.schema["doc_id"], T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()), *[rows.schema[c] for c in names[3:]]])
    return rows.mapInArrow(run, schema)
