"""Feed jobs in batch form: fragment assembly, fix assembly, vessel table, alarms, sessions.

Input lines carry a feed, an arrival time ``t`` (seconds) and a rising ``seq``. All ordered work goes
through ``Ordered``, so a feed or vessel of any size is spread over time chunks.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import ais, geo, nmea
from ..session import cut_lineage
from .ordered import Ordered, time_chunk

CHUNK = 86400.0
# Seconds a first fragment waits, a vessel stays unheard, a position stays fresh.
FRAGMENT_S, DROP_S, STALE_S = 10.0, 1800.0, 360.0


def sentences(lines: DataFrame) -> DataFrame:
    """AIS sentences of the feed with their fields; a line that fails its checks keeps a null ``f``."""
    d = geo.pinned(lines, _s=ais.split_tag(F.col("line"))).filter(ais.is_vdm(F.col("_s.sentence")))
    d = geo.pinned(d, _ok=ais.sentence_ok(F.col("_s.sentence")))
    return geo.pinned(d, f=F.when(F.col("_ok"), ais.sentence_fields(F.col("_s.sentence")))).withColumn("tag", F.col("_s.tag")).drop("_s", "_ok")


def assemble(sents: DataFrame) -> DataFrame:
    """Whole payloads: one row per message (feed, t, seq, tag, own, payload, fill) or dropped group (outcome).

    A first fragment opens a group and discards an open one of the same key; its last missing fragment closes it. A fragment
    without an open group, or later than ten seconds after the first, is an orphan; repeats in an open group change nothing;
    fill bits come from the last fragment; the tag is the first that is set.
    """
    # every kind of outcome reads the sentences, which are parsed once
    sents = cut_lineage(sents.select("feed", "t", "seq", "tag", "f"))
    bad = sents.filter(F.col("f").isNull()).select("feed", "t", "seq", F.lit("bad line").alias("outcome"))
    ok = sents.filter(F.col("f").isNotNull()).select("feed", "t", "seq", "tag", "f.*")
    one = ok.filter("count = 1").select("feed", "t", "seq", "tag", "own", "payload", "fill", F.lit("message").alias("outcome"))
    many = ok.filter("count > 1")
    keys = ["feed", "talker", "own", "seq_id", "channel", "count"]
    o = Ordered(many, keys, ["t", "seq"], time_chunk(F.col("t"), CHUNK))
    o = o.islands(F.col("number") == 1, "grp").running(lasts={"t0": F.when(F.col("number") == 1, F.col("t"))})
    r = o.result()
    live = (F.col("grp") > 0) & (F.col("t") - F.col("t0") <= FRAGMENT_S)
    r = cut_lineage(r.withColumn("live", live))
    early = r.filter(~F.col("live")).select("feed", "t", "seq", F.lit("orphan").alias("outcome"))
    # a group holds at most nine fragments once repeats are set aside
    per = r.filter("live").groupBy(*keys, "grp", "number").agg(F.min(F.struct("t", "seq", "payload", "fill", "tag")).alias("x"), F.count("*").alias("n"))
    # only a repeat can come after the fragment that closes its group
    shut = per.groupBy(*keys, "grp").agg(F.count("*").alias("_k"), F.max("n").alias("_n"), F.max(F.struct("x.t", "x.seq")).alias("_shut")).filter((F.col("_k") == F.col("count")) & (F.col("_n") > 1))
    late = r.filter("live").join(shut.hint("merge"), [*keys, "grp"]).filter(F.struct("t", "seq") > F.col("_shut")).select("feed", "t", "seq", F.lit("orphan").alias("outcome"))
    g = per.groupBy(*keys, "grp").agg(F.array_sort(F.collect_list(F.struct("number", F.col("x.payload").alias("payload"), F.col("x.fill").alias("fill")))).alias("parts"),
                                      F.max("x.seq").alias("seq"), F.max("x.t").alias("t"), F.min(F.when(F.col("x.tag").isNotNull(), F.struct("number", F.col("x.tag").alias("tag")))).alias("tg"))
    whole = F.size("parts") == F.col("count")
    done = g.select("feed", "t", "seq", F.when(whole, F.col("tg.tag")).alias("tag"), "own", F.when(whole, F.array_join(F.transform("parts", lambda p: p.payload), "")).alias("payload"),
                    F.when(whole, F.element_at("parts", -1).fill).alias("fill"), F.when(whole, "message").otherwise("dropped").alias("outcome"))
    return one.unionByName(done).unionByName(bad, allowMissingColumns=True).unionByName(early, allowMissingColumns=True).unionByName(late, allowMissingColumns=True)


def messages(assembled: DataFrame) -> DataFrame:
    """Decoded messages; the outcome tells decoded, unsupported and error apart."""
    m = assembled.filter("outcome = 'message'").drop("outcome")
    m = geo.pinned(m, bits=ais.payload_bits(F.col("payload"), F.col("fill")))
    return ais.decode(m).drop("bits")


def counters(outcomes: DataFrame) -> DataFrame:
    """Lines per feed and outcome, per feed and in all (grouping sets)."""
    return outcomes.rollup("feed", "outcome").agg(F.count("*").alias("n"))


STATIC = ["name", "call_sign", "imo", "ship_type", "dims"]


def vessel_table(msgs: DataFrame) -> DataFrame:
    """Latest merged record per MMSI.

    Static fields keep their last set value; voyage data comes whole from the last type 5; a type-27
    position gives way to another kind less than six minutes older. Partial aggregation by time, no
    per-vessel sort, except that type-27 rows look up the last other position first.
    """
    d = cut_lineage(msgs.filter((F.col("mmsi") != 0) & (F.col("outcome") == "decoded")).select(
        "mmsi", "t", "seq", "type", "lat", "lon", "sog_mps", "cog_deg", "heading_deg", "nav_status", "draught_m", "destination", "own", *STATIC))
    o = Ordered(d, ["mmsi"], ["t", "seq"], time_chunk(F.col("t"), CHUNK)).running(
        lasts={"_fine": F.when(F.col("lat").isNotNull() & F.col("lon").isNotNull() & (F.col("type") != 27), F.col("t"))}, inclusive=False).result()
    pos = F.col("lat").isNotNull() & F.col("lon").isNotNull() & ~F.coalesce((F.col("type") == 27) & (F.col("t") - F.col("_fine") < STALE_S), F.lit(False))
    at = F.struct("t", "seq")

    def last(c, cond):
        return F.max_by(c, F.when(cond, at))
    agg = [F.max_by("type", at).alias("last_type"), F.min("t").alias("first_heard"), F.max("t").alias("last_heard"), F.count("*").alias("messages"),
           last(F.struct("lat", "lon", F.col("t").alias("position_t"), F.col("type").alias("position_type"), "sog_mps", "cog_deg"), pos).alias("p"),
           last("heading_deg", pos & F.col("type").isin(1, 2, 3, 18, 19)).alias("heading_deg"), last("nav_status", pos & F.col("type").isin(1, 2, 3, 27)).alias("nav_status"),
           last(F.struct("draught_m", "destination"), F.col("type") == 5).alias("voyage"), F.max_by("own", at).alias("own_ship"),
           *[last(c, (F.col(c) != "") if c in ("name", "call_sign") else F.col(c).isNotNull()).alias(c) for c in STATIC]]
    v = o.groupBy("mmsi").agg(*agg)
    return v.select("mmsi", ais.kind_from_mmsi(F.col("mmsi")).alias("kind"), "first_heard", "last_heard", "messages", "p.*", "heading_deg", "nav_status", "voyage.*", "own_ship", *STATIC)


def evict_oldest(vessels: DataFrame, most: int) -> DataFrame:
    """The newest-heard vessels, own ship first."""
    return vessels.orderBy(F.col("own_ship").desc_nulls_last(), F.col("last_heard").desc(), "mmsi").limit(most)


def credits(msgs: DataFrame) -> DataFrame:
    """Distinct credits in the order first heard."""
    return msgs.groupBy("credit").agg(F.min(F.struct("t", "seq")).alias("first")).select("credit", F.col("first.t").alias("first_t"))


def alarms(cpa_rows: DataFrame, cpa_m: float = 926.0, tcpa_s: float = 600.0, release: float = 1.2) -> DataFrame:
    """Edge-triggered alarms over rows (mmsi, t, cpa_m, tcpa_s, stale): raised on entry, kept to a wider limit.

    Between the limits the last clear state holds, so the state is a running last value and edges are
    changes of it.
    """
    c = F.col
    off = F.coalesce(c("stale"), F.lit(False)) | c("cpa_m").isNull() | (c("tcpa_s") < 0)
    inside = ~off & (c("cpa_m") <= cpa_m) & (c("tcpa_s") <= tcpa_s)
    outside = off | (c("cpa_m") > release * cpa_m) | (c("tcpa_s") > release * tcpa_s)
    o = Ordered(cpa_rows, ["mmsi"], ["t", "seq"], time_chunk(c("t"), CHUNK)).running(lasts={"_alarm": F.when(inside, True).when(outside, False)})
    o = o.previous(on=F.coalesce("_alarm", F.lit(False))).result()
    on, was = F.coalesce("_alarm", F.lit(False)), F.coalesce("prev_on", F.lit(False))
    return o.filter(on != was).select("mmsi", "t", "seq", F.when(on, "raised").otherwise("cleared").alias("event"))


def assemble_fixes(lines: DataFrame, tolerance_s: float = 0.05) -> DataFrame:
    """Sentences sharing a time of day as one fix per feed: the first time of day of the group, dated by the last RMC date heard when it closes.

    A group still open at the end has the first date heard in it.
    """
    # each ordered step reads its input twice, so the parsed lines are kept, and so are the groups
    p = cut_lineage(nmea.with_reading(lines).filter(F.col("r").isNotNull() & (F.col("r.type") != "HDT")).select("feed", "t", "seq", "r.*"))
    o = Ordered(p, ["feed"], ["t", "seq"], time_chunk(F.col("t"), CHUNK)).running(lasts={"_tod": F.col("tod_s")}, inclusive=False)
    new = F.col("_tod").isNull() & F.lit(False) | (F.col("tod_s").isNotNull() & F.col("_tod").isNotNull() & (F.abs(F.col("tod_s") - F.col("_tod")) >= tolerance_s))
    o = o.islands(new, "grp").running(lasts={"_date": F.col("date")})
    at = F.struct("t", "seq")

    def last(c):
        return F.max_by(c, F.when(F.col(c).isNotNull(), at)).alias(c)

    def first(c):
        return F.min_by(c, F.when(F.col(c).isNotNull(), at))
    g = o.result().groupBy("feed", "grp").agg(F.min(at).alias("first"), F.max_by("_date", at).alias("_date"), F.min_by("date", at).alias("_opens"), first("date").alias("_own"), first("tod_s").alias("tod_s"),
                                              *[last(c) for c in ("lat", "lon", "speed_mps", "heading_deg", "satellites", "hdop", "alt_m")])
    # the sentence that closes a group is the first of the next one, and its date already counts
    q = Ordered(cut_lineage(g.withColumn("t", F.col("first.t"))), ["feed"], ["grp"], time_chunk(F.col("t"), CHUNK)).following(opens=F.col("_opens")).result()
    date = F.when(F.col("is_last"), F.coalesce("_own", "_date")).otherwise(F.coalesce("next_opens", "_date"))
    when = F.when(F.col("tod_s").isNotNull() & date.isNotNull(), F.unix_date(date) * 86400.0 + F.col("tod_s"))
    return q.filter(F.col("lat").isNotNull()).select("feed", "grp", when.alias("fix_t"), "lat", "lon", "speed_mps", "heading_deg", "satellites", "hdop", "alt_m")


def attach_heading(fixes: DataFrame, headings: DataFrame, within_s: float = 5.0, below_mps: float = 0.5) -> DataFrame:
    """A compass heading heard within five seconds replaces the course of a slow fix."""
    from .ordered import asof
    j = asof(fixes, headings, ["feed"], "t", CHUNK, ["heading"])
    use = (F.col("t") - F.col("asof_t") <= within_s) & (F.coalesce("speed_mps", F.lit(0.0)) < below_mps)
    return j.withColumn("heading_deg", F.when(use, F.col("asof_heading")).otherwise(F.col("heading_deg"))).drop("asof_t", "asof_heading")


def feed_silences(lines: DataFrame, silent_s: float = 15.0) -> DataFrame:
    """Stretches in which a feed was silent for longer than the limit."""
    o = Ordered(lines.select("feed", "t", "seq"), ["feed"], ["t", "seq"], time_chunk(F.col("t"), CHUNK)).previous(t=F.col("t")).result()
    return o.filter(F.col("t") - F.col("prev_t") > silent_s).select("feed", F.col("prev_t").alias("from_t"), F.col("t").alias("to_t"))
