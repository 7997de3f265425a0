"""Landed feature files as a Spark data source: match, open and list by kind, pruned by box, in batch or as a stream.

``register(spark)`` once, then ``spark.read.format("landed").option("kind", "dted").load(path)`` or ``readStream``. Files are listed on the driver and opened in
the tasks through pyarrow's file systems, so a path may be local or any store they know. A new kind is an entry in ``KINDS``.
"""
from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import (DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual)

_VOID = -32767
# a grid of posts may run past 90 degrees, and its cells are still told by their names
_CELL = re.compile(r"([ew])(\d+)/([ns])(\d+)\.dt(\d)$", re.I)


@dataclass
class Kind:
    """What a kind of file gives: its rows' schema, which paths are its own, the box (s, w, n, e) a path tells, and its rows as Arrow batches."""
    schema: str
    match: Callable[[str], bool]
    box: Callable[[str], tuple[float, float, float, float] | None]
    rows: Callable[[str, object], Iterator]


def _dted_box(path: str):
    m = _CELL.search(path)
    if not m:
        return None
    w, s = int(m[2]) * (-1 if m[1].lower() == "w" else 1), int(m[4]) * (-1 if m[3].lower() == "s" else 1)
    return float(s), float(w), float(s + 1), float(w + 1)


def _dted_rows(path: str, file) -> Iterator:
    import numpy as np
    import pyarrow as pa
    b = file.read()
    cols, rows = int(b[47:51]), int(b[51:55])
    size, head = 12 + 2 * rows, 80 + 648 + 2700
    grid = np.frombuffer(b[head:head + cols * size], np.uint8).reshape(cols, size)[:, 8:8 + 2 * rows].copy().view(">u2").astype(np.int32)
    z = np.where(grid >= 32768, 32768 - grid, grid)      # sign and magnitude
    c, r = np.meshgrid(np.arange(cols), np.arange(rows), indexing="ij")
    s, w, n, e = _dted_box(path) or (np.nan,) * 4
    m = _CELL.search(path)
    name, level = (path[m.start():m.end() - 4], int(m[5])) if m else (path.rsplit("/", 1)[-1], 0)
    lat, lon = s + r * (n - s) / max(rows - 1, 1), w + c * (e - w) / max(cols - 1, 1)
    elev = z.ravel().astype(float)
    yield pa.RecordBatch.from_arrays([pa.array([name] * z.size), pa.array(np.full(z.size, level, np.int32)), pa.array(r.ravel().astype(np.int64)), pa.array(c.ravel().astype(np.int64)),
                                      pa.array(lat.ravel()), pa.array(lon.ravel()), pa.array(elev, mask=z.ravel() == _VOID)], names=["cell", "level", "row", "col", "lat", "lon", "elev"])


def _log_rows(path: str, file, lines: int = 50_000) -> Iterator:
    import pyarrow as pa
    held: list[tuple] = []

    def batch():
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*held), (pa.int64(), pa.float64(), pa.int64(), pa.string()))], names=["feed", "t", "seq", "line"])
    rest = b""
    while block := file.read(1 << 20):
        *whole, rest = (rest + block).split(b"\n")
        held += [_log_line(x) for x in whole if x]
        if len(held) >= lines:
            yield batch()
            held = []
    if rest:
        held.append(_log_line(rest))
    if held:
        yield batch()


def _log_line(line: bytes) -> tuple:
    feed, t, seq, text = (line.decode("utf-8", "replace").rstrip("\r").split("\t", 3) + [None] * 4)[:4]

    def number(x, kind):
        try:
            return kind(x)
        except (TypeError, ValueError):
            return None
    return number(feed, int), number(t, float), number(seq, int), text


KINDS = {
    "dted": Kind("cell string, level int, row long, col long, lat double, lon double, elev double", lambda p: re.search(r"\.dt\d$", p, re.I) is not None, _dted_box, _dted_rows),
    "nmea": Kind("feed long, t double, seq long, line string", lambda p: p.endswith((".log", ".nmea", ".txt")), lambda p: None, _log_rows),
}


def _store(path: str):
    from pyarrow import fs
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path)


def list_files(path: str, kind: Kind) -> list[tuple[int, str, int]]:
    """(modified, path, bytes) of the files of a kind under a path, by time and name. Names that begin with _ or . are skipped."""
    from pyarrow import fs
    store, root = _store(path)
    found = store.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
    return sorted((f.mtime_ns or 0, f.path, f.size) for f in found if f.type == fs.FileType.File and f.base_name[0] not in "_." and kind.match(f.path))


class Part(InputPartition):
    def __init__(self, paths: list[str]) -> None:
        self.paths = paths


def _parts(files: list[tuple[int, str, int]], size: int) -> list[Part]:
    """Files in parts of about ``size`` bytes."""
    parts, held, total = [], [], 0
    for _, path, n in files:
        if held and total + n > size:
            parts.append(Part(held))
            held, total = [], 0
        held.append(path)
        total += n
    return [*parts, Part(held)] if held or not parts else parts     # one part at least: Spark asks for some


class _Rows:
    def __init__(self, options: dict) -> None:
        self.path, self.kind = options["path"], KINDS[options.get("kind", "nmea")]
        self.size = int(options.get("partbytes", 64 << 20))

    def read(self, partition: Part) -> Iterator:
        store, _ = _store(self.path)
        for path in partition.paths:
            with store.open_input_stream(path) as f:
                yield from self.kind.rows(path, f)


class LandedReader(_Rows, DataSourceReader):
    """Batch: comparisons of lat and lon with numbers leave out files whose box lies outside; Spark still applies every filter to the rows."""

    def __init__(self, options: dict) -> None:
        super().__init__(options)
        self.low, self.high = {"lat": -1e9, "lon": -1e9}, {"lat": 1e9, "lon": 1e9}

    def pushFilters(self, filters):
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if name in self.low and isinstance(getattr(f, "value", None), (int, float)):
                if isinstance(f, (GreaterThan, GreaterThanOrEqual, EqualTo)):
                    self.low[name] = max(self.low[name], f.value)
                if isinstance(f, (LessThan, LessThanOrEqual, EqualTo)):
                    self.high[name] = min(self.high[name], f.value)
            yield f

    def partitions(self) -> list[Part]:
        def meets(path: str) -> bool:
            box = self.kind.box(path)
            return box is None or (box[0] <= self.high["lat"] and box[2] >= self.low["lat"] and box[1] <= self.high["lon"] and box[3] >= self.low["lon"])
        return _parts([f for f in list_files(self.path, self.kind) if meets(f[1])], self.size)


class LandedStream(_Rows, DataSourceStreamReader):
    """Stream: each file once, by the time it was written and its name; files must be moved in whole, and not with an older time."""

    def initialOffset(self) -> dict:
        return {"mtime": -1, "path": ""}

    def latestOffset(self) -> dict:
        files = list_files(self.path, self.kind)
        return {"mtime": files[-1][0], "path": files[-1][1]} if files else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[Part]:
        a, b = ((x["mtime"], x["path"]) for x in (start, end))
        return _parts([f for f in list_files(self.path, self.kind) if a < f[:2] <= b], self.size)

    def commit(self, end: dict) -> None:
        json.dumps(end)     # nothing is held between triggers


class LandedFiles(DataSource):
    """Options: path, kind (of ``KINDS``), partBytes (bytes of files a task reads)."""

    @classmethod
    def name(cls) -> str:
        return "landed"

    def schema(self) -> str:
        return KINDS[self.options.get("kind", "nmea")].schema

    def reader(self, schema) -> LandedReader:
        return LandedReader(dict(self.options))

    def streamReader(self, schema) -> LandedStream:
        return LandedStream(dict(self.options))


def register(spark) -> None:
    """Makes the format known to a session, with filters handed to it."""
    spark.dataSource.register(LandedFiles)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def write_dted(posts, path: str, level: int = 1) -> None:
    """Writes posts (w, s: whole degrees, row, col, elev) as one file per cell, voids where a post is null or missing. A task writes whole cells, so a repeated task writes the same files."""
    store_path = path

    def cells(key, pdf):
        import numpy as np
        import pandas as pd
        w, s = int(key[0]), int(key[1])
        rows, cols = int(pdf["row"].max()) + 1, int(pdf["col"].max()) + 1
        z = np.full((cols, rows), _VOID)
        known = pdf[pdf.elev.notna()]
        z[known["col"].to_numpy(int), known["row"].to_numpy(int)] = known.elev.to_numpy(float).round().astype(int)
        coded = np.where(z < 0, 32768 - z, z).astype(">u2")
        body = b"".join(b"\xaa" + i.to_bytes(3, "big") + i.to_bytes(2, "big") + b"\0\0" + coded[i].tobytes() + b"\0" * 4 for i in range(cols))
        head = b"UHL1".ljust(47, b"0") + b"%04d%04d" % (cols, rows)
        store, root = _store(store_path)
        folder = f"{root}/{'w' if w < 0 else 'e'}{abs(w):03d}"
        store.create_dir(folder, recursive=True)
        name = f"{folder}/{'s' if s < 0 else 'n'}{abs(s):02d}.dt{level}"
        with store.open_output_stream(name) as f:
            f.write(head.ljust(80, b" ") + b"DSI".ljust(648, b" ") + b"ACC".ljust(2700, b" ") + body)
        return pd.DataFrame({"path": [name]})
    posts.groupBy("w", "s").applyInPandas(cells, "path string").count()
