"""Host-level quality rules: failures of document rules, gathered by host, decide on all documents of a host. DataFrame functions throughout."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from geolattice.session import written

#: Rules over the columns of `measures`; a document fails a rule where the condition holds.
RULES = {
    "short": "n_words < 50",
    "repeats": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "lines": "10 * n_dup_lines > 3 * n_lines",
}
#: The rules that reject a document by itself.
BASE = ("short", "repeats")
_SPACE = " \t\n\x0b\f\r"
_SIGNS = "#*$%&|<>"
#: Fixed point of the hosts' rates, so that their sums do not depend on the order of adding.
_UNIT = 1_000_000_000


def measures(text: Column) -> dict[str, Column]:
    """Counts over a whole text that need no windows: words' code points, signs, lines with a word and those that repeat an earlier one."""
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.translate(x, _SPACE, "") != "")
    return {
        "word_chars": F.char_length(F.translate(text, _SPACE, "")).cast("long"),
        "n_symbols": (F.char_length(text) - F.char_length(F.translate(text, _SIGNS, ""))).cast("long"),
        "n_lines": F.size(lines).cast("long"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
    }


def _covered(starts: Column, width: int) -> Column:
    """How many places the windows that begin at the ascending `starts` cover together."""
    start = F.struct(F.lit(0).alias("upto"), F.lit(0).cast("long").alias("n"))
    return F.aggregate(starts, start, lambda a, p: F.struct((p + width).alias("upto"), (a["n"] + p + width - F.greatest(p, a["upto"])).alias("n")), lambda a: a["n"])


def document_measures(docs: DataFrame, host_col: str = "source", id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """`doc_id`, `host` and the counts of every row's whole text; nothing is shuffled.

    `n_repeat_words` counts the words that lie in a window of `width` words which the text holds twice or more. Windows are
    compared by 64-bit hashes of their words: sorted together with their places, equal ones are neighbours.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(host_col).cast("string").alias("host"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    words = F.filter(F.split("text", "[ \\t\\n\\x0B\\f\\r]+", -1), lambda x: x != "")
    # each step is a row of its own (an explode of one element), so no later lambda works it out again for every element
    step = rows.select("doc_id", "host", *[c.alias(n) for n, c in measures(F.col("text")).items()], F.explode(F.array(F.transform(words, lambda x: F.xxhash64(x)))).alias("hash"))
    size = F.size("hash")
    shifted = [F.slice("hash", F.lit(j + 1), F.greatest(size - (width - 1), F.lit(0))).alias(f"w{j}") for j in range(width)]
    windows = F.transform(F.arrays_zip(*shifted), lambda x, i: F.struct(F.xxhash64(*[x[f"w{j}"] for j in range(width)]).alias("k"), i.alias("p")))
    kept = [c for c in step.columns if c != "hash"]
    step = step.select(*kept, size.cast("long").alias("n_words"), F.explode(F.array(F.sort_array(windows))).alias("sorted"))
    same = lambda x, j: F.coalesce(F.get("sorted", j)["k"] == x["k"], F.lit(False))
    twice = F.transform(F.filter("sorted", lambda x, i: same(x, i - 1) | same(x, i + 1)), lambda x: x["p"])
    return step.select(*kept, "n_words", _covered(F.sort_array(twice), width).alias("n_repeat_words"))


def host_rates(measured: DataFrame, rules: dict[str, str] = RULES) -> DataFrame:
    """Per host: `n`, and per rule its failures `f_<rule>` and its shrunk rate `rate_<rule>`.

    A host's rate is drawn towards the rate of hosts in general as by a beta prior. The prior's two moments are those of the
    hosts' rates, every host alike: the mean of f/n, and the mean of f(f-1)/(n(n-1)) over hosts of two rows or more, which
    a beta-binomial host has as its second moment. If hosts differ no more than chance lets them (or no host has two rows), the rate is the mean for all.
    """
    hosts = measured.where("host is not null").groupBy("host").agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.expr(f"if({c}, 1L, 0L)")).alias(f"f_{r}") for r, c in rules.items()])
    moments = []
    for r in rules:
        moments += [F.sum(F.expr(f"cast(f_{r} as decimal(20)) * {_UNIT} div n")).alias(f"a_{r}"),
                    F.sum(F.expr(f"if(n > 1, (cast(f_{r} as decimal(18)) * (f_{r} - 1) * {_UNIT}) div (cast(n as decimal(18)) * greatest(n - 1, 1)), 0L)")).alias(f"b_{r}")]
    prior = hosts.agg(F.count(F.lit(1)).alias("hosts"), F.count_if(F.col("n") > 1).alias("large"), *moments)   # one row
    joined = hosts.crossJoin(F.broadcast(prior))
    out = []
    for r in rules:
        mean = F.col(f"a_{r}").cast("double") / F.col("hosts").cast("double") / F.lit(float(_UNIT))
        square = F.col(f"b_{r}").cast("double") / F.col("large").cast("double") / F.lit(float(_UNIT))
        spread = square - mean * mean
        weight = mean * (1.0 - mean) / spread - 1.0
        f, n = F.col(f"f_{r}").cast("double"), F.col("n").cast("double")
        shrunk = F.when((F.col("large") > 0) & (spread > 0), (f + mean * F.greatest(weight, F.lit(0.0))) / (n + F.greatest(weight, F.lit(0.0)))).otherwise(mean)
        out += [F.col(f"f_{r}"), shrunk.alias(f"rate_{r}")]
    return joined.select("host", "n", *out)


def judge_hosts(docs: DataFrame, limit: float = 0.5, rules: dict[str, str] = RULES, base: tuple[str, ...] = BASE, host_col: str = "source", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rules by host: a host whose shrunk rate of failing any rule is above `limit` loses all its documents.

    Returns every input row once: `doc_id`, `host`, `n_words`, `word_chars`, `n_symbols`, `n_lines` (lines with a word), `n_dup_lines`,
    `n_repeat_words`, `base_failed` (a rule of `base` fails on the row itself), `host_blocked` and `kept` (neither). Other columns of the input, of any name, are not read.

    Defined cases: a null or empty text has no words and all counts 0; it fails as too short. Rows that repeat an id, or have none, are
    judged each by its own text and count each at its host. A row without a host belongs to none: only its own rules judge it. An empty table
    gives an empty table; one host alone, or hosts of one row each, share one rate. A rate equal to `limit` does not block.

    Scale: the counts are worked out once, in the tasks that read the texts, and written down; only they travel on. A hot host comes as
    partial sums, and meets its verdict in a join that Spark can split. A text's windows are sorted in its own row (some 50 bytes a word).
    """
    measured = written(document_measures(docs, host_col, id_col, text_col), "measured")
    over = reduce(lambda a, b: a | b, [F.col(f"rate_{r}") > limit for r in rules])
    blocked = host_rates(measured, rules).where(over).select(F.struct("host").alias("blocked"))
    judged = measured.withColumn("base_failed", F.expr(" or ".join(f"({rules[b]})" for b in base)))
    # the key inside a struct: the join then deals out both sides for itself, and a hot host can be split
    joined = judged.join(blocked, F.struct("host") == F.col("blocked"), "left")
    stop = F.col("blocked").isNotNull()
    return joined.select(*judged.columns, stop.alias("host_blocked"), (~F.col("base_failed") & ~stop).alias("kept"))
