"""Line dedup: lines that many documents share stay in one document only. DataFrame functions throughout."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from geolattice.session import written

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    return F.translate(F.trim(line, F.lit(" \t\n\x0b\f\r")), _UPPER, _LOWER)


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """Drop repeated lines and put the rest together again by position.

    A line's key is the line without white space at its ends, A-Z lower-cased. A key of at least `min_chars` code
    points that at least `min_docs` documents hold loses all its lines, except those in the largest id that holds it.

    Returns every input row once: `doc_id`, `text` (what stays, joined by line feeds), `n_lines` (before), `n_dropped`
    and `row`, a struct of all input columns as they came, so that extra columns of any name do no harm.

    Defined cases: a null or empty text is one empty line. Rows that repeat an id count as one document and each loses
    its lines by its own text. Rows with a null id count as one document, below every other. A document that loses
    every line has an empty text. An empty table gives an empty table.

    Scale: lines travel as two 64-bit hashes, the id and the position. A hot line is counted from partial sums, and in the
    join its many rows face one row, from exchanges that Spark may split. Texts are shuffled once, by id.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"),
                       F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).withColumn("text_key", F.xxhash64("text"))
    lines = rows.select("doc_id", "text_key", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    key = line_key(F.col("line"))
    lines = written(lines.select("doc_id", "text_key", "pos", key.alias("key")).where(F.char_length("key") >= min_chars)
                    .select("doc_id", "text_key", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), "key").alias("h2")), "lines")
    holders = lines.select("h1", "h2", "doc_id").distinct()
    shared = (holders.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("keeper")).where(F.col("n") >= min_docs)
              # the key under another name: the join then deals out both sides anew, and Spark can split a hot line
              .select(F.bitwise_not("h1").alias("k1"), F.bitwise_not("h2").alias("k2"), "keeper"))
    lost = (lines.join(shared, (F.bitwise_not("h1") == F.col("k1")) & (F.bitwise_not("h2") == F.col("k2")))
            .where(~F.col("doc_id").eqNullSafe(F.col("keeper"))))
    dropped = (lost.groupBy(F.col("doc_id").alias("d_id"), F.col("text_key").alias("d_key")).agg(F.collect_set("pos").alias("positions")))
    both = rows.join(dropped, F.col("doc_id").eqNullSafe(F.col("d_id")) & (F.col("text_key") == F.col("d_key")), "left")
    pieces = F.split("text", "\n", -1)
    stay = F.array_except(F.sequence(F.lit(0), F.size(pieces) - 1), F.col("positions"))
    kept = F.when(F.col("positions").isNull(), F.col("text")).otherwise(F.array_join(F.transform(stay, lambda i: F.get(pieces, i)), "\n"))
    return both.select("doc_id", kept.alias("kept"), F.size(pieces).cast("long").alias("n_lines"),
                       F.coalesce(F.size("positions"), F.lit(0)).cast("long").alias("n_dropped"), "row").withColumnRenamed("kept", "text")
