"""The landed-file data source: kinds, pruning by box, and the stream."""
from __future__ import annotations

import os
import time

import pytest
from pyspark.sql import functions as F

from geolattice.session import scratch
from geolattice.sources import landed


@pytest.fixture()
def source(spark):
    landed.register(spark)
    return spark


def heights(spark):
    rows = [(w, s, r, c, None if (r + c) % 7 == 3 else float((w * s + 10 * r - 4 * c) % 500 - 200)) for w in (-81, -80, 3) for s in (-2, 32) for r in range(5) for c in range(4)]
    return spark.createDataFrame(rows, "w int, s int, row long, col long, elev double"), rows


def test_dted_round_trip_and_pruning(source):
    spark, path = source, scratch(source, "dted")
    posts, rows = heights(spark)
    landed.write_dted(posts, path)
    got = spark.read.format("landed").option("kind", "dted").option("partBytes", 1).load(path)
    name = lambda w, s: f"{'w' if w < 0 else 'e'}{abs(w):03d}/{'s' if s < 0 else 'n'}{abs(s):02d}"
    want = sorted((name(w, s), 1, r, c, round(s + r / 4, 9), round(w + c / 3, 9), z) for w, s, r, c, z in rows)
    key = lambda r: (r[0], r[2], r[3])
    assert sorted(((r.cell, r.level, r.row, r["col"], round(r.lat, 9), round(r.lon, 9), r.elev) for r in got.collect()), key=key) == sorted(want, key=key)
    assert got.rdd.getNumPartitions() == 6
    near = got.filter("lat >= 32.1 and lat < 32.6 and lon > -80.5 and lon <= -79.5")
    assert near.rdd.getNumPartitions() == 2
    assert sorted(map(tuple, near.select("cell", "row", "col").collect())) == sorted((x[0], x[2], x[3]) for x in want if 32.1 <= x[4] < 32.6 and -80.5 < x[5] <= -79.5)
    reader = landed.LandedReader({"path": path, "kind": "dted"})
    assert len(list(reader.pushFilters([landed.LessThan(("lat",), 0.0), landed.EqualTo(("cell",), "x")]))) == 2
    assert sorted(p for part in reader.partitions() for p in part.paths) == sorted(p for _, p, _ in landed.list_files(path, landed.KINDS["dted"]) if "/s02" in p)


def test_logs_in_batch_and_as_a_stream(source):
    spark, path, out = source, scratch(source, "logs"), scratch(source, "read")
    os.makedirs(path)

    def write(name, lines):
        with open(f"{path}/.{name}", "w") as f:
            f.write("\n".join(lines))
        os.rename(f"{path}/.{name}", f"{path}/{name}")
        time.sleep(0.01)
    write("a.log", ["1\t10.5\t1\t$GPRMC,x*00", "", "1\t11.5\t2\t$GPGGA\twith tab", "bad"])
    write("b.nmea", ["2\t12.0\t1\t!AIVDM"])
    write("c.csv", ["3\t1.0\t1\tnot a log"])
    want = {(1, 10.5, 1, "$GPRMC,x*00"), (1, 11.5, 2, "$GPGGA\twith tab"), (None, None, None, None), (2, 12.0, 1, "!AIVDM")}
    assert {tuple(r) for r in spark.read.format("landed").option("kind", "nmea").load("file:" + path).collect()} == want

    def run():
        q = (spark.readStream.format("landed").option("kind", "nmea").load(path).writeStream.format("parquet").option("path", out).option("checkpointLocation", out + "-at").trigger(availableNow=True).start())
        q.awaitTermination(120)
    run()
    write("d.log", ["4\t20.0\t1\t$late"])
    run()
    run()
    assert sorted((tuple(r) for r in spark.read.schema(landed.KINDS["nmea"].schema).parquet(out).collect()), key=repr) == sorted([*want, (4, 20.0, 1, "$late")], key=repr)


def test_nothing_landed(source):
    assert source.read.format("landed").option("kind", "dted").load(scratch(source, "none")).count() == 0
