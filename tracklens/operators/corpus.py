"""Chart text to timeline as relational steps.

Input is one row per text line: (item, line_no, line).  Every step is a frame keyed by item, so a
corpus is parsed by scans, group-bys and running sums; a long chart is never one task's private loop.
"""

from __future__ import annotations

from functools import cached_property

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.columns import decode_index
from ..session import cut
from . import skew

# fixed values: line patterns of the chart format
CONTROL = r"(?i)^#\s*(RANDOM|SETRANDOM|IF|ELSEIF|ELSE|ENDIF|ENDRANDOM|SWITCH|SETSWITCH|CASE|SKIP|DEF|ENDSW)\b"
CHANNEL = r"^#\s*(?:EXT\s+)?#?(\d{3,})([0-9A-Za-z]{2})\s*:\s*(.*)$"
HEADER = r"^#\s*([A-Za-z][0-9A-Za-z]*)\s*(.*)$"
# fixed values: channel -> lane, tap channels and held-note channels
TAP_LANES = {"16": 0, "11": 1, "12": 2, "13": 3, "14": 4, "15": 5, "18": 6, "19": 7}
HELD_LANES = {"56": 0, "51": 1, "52": 2, "53": 3, "54": 4, "55": 5, "58": 6, "59": 7}
DEFAULT_BPM = 130.0


def text_lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """Numbered trimmed lines (1-based), blanks kept out."""
    x = df.select(key, F.posexplode(F.split(text, "\n")).alias("_p", "_l"))
    return x.select(key, (F.col("_p") + 1).alias("line_no"), F.trim(F.regexp_replace("_l", "\r", "")).alias("line")).filter("line <> ''")


def classify(lines: DataFrame) -> DataFrame:
    """control / channel / header / unparsed, in that precedence; lines without a leading # are comments."""
    k = F.when(F.col("line").rlike(CONTROL), "control").when(F.col("line").rlike(CHANNEL), "channel").when(F.col("line").rlike(HEADER), "header").otherwise("unparsed")
    return lines.filter(F.col("line").startswith("#")).withColumn("kind", k)


def headers(cls: DataFrame) -> DataFrame:
    """Last value per upper-cased key."""
    h = cls.filter("kind = 'header'").select("item", "line_no", F.upper(F.regexp_extract("line", HEADER, 1)).alias("key"), F.trim(F.regexp_extract("line", HEADER, 2)).alias("value"))
    return h.groupBy("item", "key").agg(F.max_by("value", "line_no").alias("value"))


def chart_heads(cls: DataFrame) -> DataFrame:
    """One row per chart: typed headers, base, first tempo, rule-based quarantine flags."""
    def last(key, cast):
        v = F.expr(f"try_cast(value as {cast})")
        return F.max_by(v, F.when((F.col("key") == key) & v.isNotNull(), F.col("line_no")))

    h = cls.select("item", "line_no", "kind", F.upper(F.regexp_extract("line", HEADER, 1)).alias("key"), F.trim(F.regexp_extract("line", HEADER, 2)).alias("value"))
    raw = h.groupBy("item").agg(
        last("BPM", "double").alias("bpm_raw"), last("RANK", "double").cast("int").alias("rank"), last("PLAYER", "int").alias("player"), last("LNTYPE", "double").cast("int").alias("lntype"),
        F.max(F.when((F.col("key") == "BASE") & (F.col("value") == "62"), 62)).alias("base"), F.max((F.col("kind") == "control").cast("int")).alias("control"),
        F.count(F.when(F.col("kind") == "unparsed", 1)).alias("n_unparsed"))
    b = F.col("bpm_raw")
    init = F.when(b.isNull() | (b == 0) | F.isnan(b), DEFAULT_BPM).otherwise(F.abs(b))
    return raw.select("item", init.alias("initial_bpm"), "rank", F.coalesce("player", F.lit(1)).alias("player"), F.coalesce("lntype", F.lit(1)).alias("lntype"), F.coalesce("base", F.lit(36)).alias("base"),
                      (F.col("control") == 1).alias("control_flow"), "n_unparsed", (b == 0).alias("zero_bpm"), (b < 0).alias("negative_bpm"))


def definitions(cls: DataFrame, heads: DataFrame) -> DataFrame:
    """Indexed definitions (item, what = bpm / stop / lnobj, idx, value); EXBPM is an alias of BPM.

    Lines are read in order: a later one redefines its index, whichever spelling it uses; every LNOBJ adds a terminator.
    """
    h = cls.filter("kind = 'header'").select("item", "line_no", F.upper(F.regexp_extract("line", HEADER, 1)).alias("key"), F.trim(F.regexp_extract("line", HEADER, 2)).alias("value"))
    what = F.when(F.col("key").rlike("^(EX)?BPM.."), "bpm").when(F.col("key").rlike("^STOP.."), "stop").when(F.col("key") == "LNOBJ", "lnobj")
    pair = F.when(what == "lnobj", F.substring("value", 1, 2)).otherwise(F.regexp_extract("key", "^(?:EXBPM|BPM|STOP)(..)", 1))
    d = h.filter(what.isNotNull()).join(heads.select("item", "base"), "item")
    out = d.select("item", "line_no", what.alias("what"), decode_index(pair, F.col("base")).alias("idx"), F.expr("try_cast(value as double)").alias("value"))
    return out.filter("what = 'lnobj' or value is not null").groupBy("item", "what", "idx").agg(F.max_by("value", "line_no").alias("value"))


def channel_lines(cls: DataFrame) -> DataFrame:
    return cls.filter("kind = 'channel'").select(
        "item", "line_no", F.regexp_extract("line", CHANNEL, 1).try_cast("int").alias("measure"), F.upper(F.regexp_extract("line", CHANNEL, 2)).alias("channel"), F.trim(F.regexp_extract("line", CHANNEL, 3)).alias("data"))


def line_issues(cls: DataFrame, chan: DataFrame) -> DataFrame:
    """(item, issue) of lines that are well formed but carry a value that cannot be used."""
    h = cls.filter("kind = 'header'").select("item", F.upper(F.regexp_extract("line", HEADER, 1)).alias("key"), F.trim(F.regexp_extract("line", HEADER, 2)).alias("value"))
    kind = F.when(F.col("key") == "BPM", "bad_bpm_header").when(F.col("key").rlike("^BPM.."), "bad_bpm_def").when(F.col("key").rlike("^STOP.."), "bad_stop_def")
    no_number = F.expr("try_cast(value as double) is null")
    of_channel = F.when(F.col("measure") > 999, "measure_gt_999").when((F.col("channel") == "02") & F.expr("try_cast(data as double) is null"), "bad_ch02")
    return h.filter(no_number).select("item", kind.alias("issue")).unionByName(chan.select("item", of_channel.alias("issue"))).filter("issue is not null")


def objects(chan: DataFrame, heads: DataFrame) -> DataFrame:
    """(item, measure, channel, frac, value): the string in two-character slots, zero slots dropped, a later line wins its slot."""
    keep = [*TAP_LANES, *HELD_LANES, "03", "08", "09"]
    n = F.floor(F.length("data") / 2).cast("int")
    c = chan.filter(F.col("channel").isin(keep)).withColumn("n", n).filter("n > 0").join(heads.select("item", "base"), "item")
    filled = F.filter(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.substr("data", i * 2 + 1, F.lit(2)) != "00")
    x = c.select("item", "line_no", "measure", "channel", "base", "n", "data", F.explode(filled).alias("i"))
    pair = F.substr("data", F.col("i") * 2 + 1, F.lit(2))
    value = F.when(F.col("channel") == "03", F.conv(pair, 16, 10).cast("int")).otherwise(decode_index(pair, F.col("base")))
    x = x.select("item", "line_no", "measure", "channel", (F.col("i") / F.col("n")).alias("frac"), value.cast("int").alias("value")).filter("value > 0")
    return x.groupBy("item", "measure", "channel", "frac").agg(F.max_by("value", "line_no").alias("value"))


def measures(chan: DataFrame, hot=None) -> DataFrame:
    """(item, measure, len, start) for every used measure plus one end row (measure = max + 1, len NULL).

    Measures without an explicit length are 4 beats, so the start is 4 m plus a running correction - no spine of empty measures.
    """
    length = F.expr("try_cast(data as double)")
    used = chan.groupBy("item", "measure").agg(F.max_by(length, F.when((F.col("channel") == "02") & length.isNotNull(), F.col("line_no"))).alias("_len"))
    used = used.select("item", "measure", F.when(F.col("_len") > 0, F.col("_len")).otherwise(1.0).alias("len"))
    end = used.groupBy("item").agg((F.max("measure") + 1).alias("measure")).withColumn("len", F.lit(None).cast("double"))
    m = used.unionByName(end)
    s = skew.prefix(m, ["item"], ["measure"], {"_fix": ("sum", (F.col("len") - 1.0) * 4.0)}, None if hot is None else skew.hot_keys(m, ["item"], "measure"))
    return s.select("item", "measure", "len", (F.col("measure") * 4.0 + F.coalesce("_fix", F.lit(0.0))).alias("start"))


def beats(obj: DataFrame, meas: DataFrame) -> DataFrame:
    return obj.join(meas.filter("len is not null"), ["item", "measure"]).withColumn("beat", F.round(F.col("start") + F.col("frac") * F.col("len") * 4.0, 9))


def tempo_map(ob: DataFrame, defs: DataFrame, heads: DataFrame, hot=None) -> DataFrame:
    """Keypoints (item, beat, t_pre, t_post, bpm, stop_sec, n_bpm, n_stop): BPM before STOP on a beat, stop = v / 48 beat."""
    act = ob.filter(F.col("channel").isin("03", "08", "09"))
    what = F.when(F.col("channel") == "09", "stop").otherwise("bpm")
    j = act.select("item", "beat", "channel", "measure", what.alias("what"), F.col("value").alias("idx")).join(defs.withColumnRenamed("value", "dv"), ["item", "what", "idx"], "left")
    v = F.when(F.col("channel") == "03", F.col("idx").cast("double")).otherwise(F.col("dv"))
    j = j.withColumn("v", v).filter("v is not null")
    is_bpm = F.col("what") == "bpm"
    kp = j.groupBy("item", "beat").agg(
        F.max_by(F.greatest(F.abs("v"), F.lit(1e-9)), F.when(is_bpm, F.struct("channel", "measure"))).alias("set_bpm"), F.coalesce(F.sum(F.when(~is_bpm, F.col("v") / 48.0)), F.lit(0.0)).alias("stop_beats"),
        F.count(F.when(is_bpm, 1)).alias("n_bpm"), F.count(F.when(~is_bpm, 1)).alias("n_stop"), F.max((is_bpm & (F.col("v") < 0)).cast("int")).alias("neg"),
        F.min(F.when(is_bpm, F.greatest(F.abs("v"), F.lit(1e-9)))).alias("lo_bpm"), F.max(F.when(is_bpm, F.greatest(F.abs("v"), F.lit(1e-9)))).alias("hi_bpm"))
    kp = kp.join(heads.select("item", "initial_bpm"), "item")
    h = None if hot is None else skew.hot_keys(kp, ["item"], "beat")
    a = skew.prefix(kp, ["item"], ["beat"], {"_pb": ("prev", F.col("beat")), "_last": ("max", F.when(F.col("set_bpm").isNotNull(), F.struct("beat", "set_bpm")))}, h)
    before = F.coalesce(F.col("_last.set_bpm"), F.col("initial_bpm"))
    a = a.withColumn("bpm", F.coalesce("set_bpm", before)).withColumn("_d", (F.col("beat") - F.coalesce("_pb", F.lit(0.0))) * 60.0 / before)
    a = a.withColumn("stop_sec", F.col("stop_beats") * 60.0 / F.col("bpm"))
    s = skew.prefix(a, ["item"], ["beat"], {"_sd": ("sum", F.col("_d") + F.col("stop_sec"))}, h)
    pre = F.coalesce("_sd", F.lit(0.0)) + F.col("_d")
    return s.select("item", "beat", pre.alias("t_pre"), (pre + F.col("stop_sec")).alias("t_post"), "bpm", "stop_sec", "n_bpm", "n_stop", "neg", "lo_bpm", "hi_bpm")


def to_seconds(points: DataFrame, kp: DataFrame, heads: DataFrame, id_cols: list[str], hot=None) -> DataFrame:
    """Adds ``t`` to rows with (item, beat): as-of the latest keypoint; on the keypoint itself the time before its stop."""
    cols = points.columns
    q = points.withColumn("_k", F.lit(1)).withColumn("_kp", F.lit(None).cast("struct<beat:double,t_pre:double,t_post:double,bpm:double>"))
    k = kp.select("item", "beat", F.lit(0).alias("_k"), F.struct("beat", "t_pre", "t_post", "bpm").alias("_kp"))
    u = q.unionByName(k, allowMissingColumns=True)
    r = skew.prefix(u, ["item"], ["beat", "_k", *id_cols], {"_at": ("max", F.col("_kp"))}, None if hot is None else skew.hot_keys(u, ["item"], "beat"))
    r = r.filter("_k = 1").join(heads.select("item", "initial_bpm"), "item")
    t = (F.when(F.col("_at").isNull(), F.col("beat") * 60.0 / F.col("initial_bpm")).when(F.col("_at.beat") == F.col("beat"), F.col("_at.t_pre"))
         .otherwise(F.col("_at.t_post") + (F.col("beat") - F.col("_at.beat")) * 60.0 / F.col("_at.bpm")))
    return r.select(*cols, t.alias("t"))


def _lane(mapping: dict[str, int]) -> Column:
    m = F.create_map(*[F.lit(v) for kv in mapping.items() for v in kv])
    return F.try_element_at(m, F.col("channel"))


def taps(ob: DataFrame, defs: DataFrame) -> DataFrame:
    """Tap-channel objects with their terminator flag."""
    n = ob.withColumn("lane", _lane(TAP_LANES)).filter("lane is not null")
    term = defs.filter("what = 'lnobj'").select("item", F.col("idx").alias("value"), F.lit(True).alias("is_end"))
    return n.join(term, ["item", "value"], "left").select("item", "measure", "beat", "lane", "value", F.coalesce("is_end", F.lit(False)).alias("is_end"))


def pair_terminators(tp: DataFrame, hot=None) -> DataFrame:
    """Terminator notes close the latest open head of their lane (a stack).

    depth = running +1 / -1 floored at 0; on one depth heads and terminators alternate, so the
    partner is simply the neighbour inside (item, lane, depth).  Adds end_beat to heads; orphan terminators keep role 'orphan'.
    """
    keys = ["item", "lane"]

    def h(df, ks):
        return None if hot is None else skew.hot_keys(df, ks, "beat")

    step = F.when(F.col("is_end"), -1).otherwise(1).cast("long")
    a = tp.withColumn("_s", step)
    a = skew.prefix(a, keys, ["beat"], {"_before": ("sum", F.col("_s"))}, h(a, keys)).withColumn("_before", F.coalesce("_before", F.lit(0)))
    a = a.withColumn("_after", F.col("_before") + F.col("_s"))
    a = skew.prefix(a, keys, ["beat"], {"_min": ("min", F.col("_after"))}, h(a, keys))
    depth_before = F.col("_before") - F.least(F.lit(0), F.coalesce("_min", F.lit(0)))
    a = a.withColumn("_depth", F.when(F.col("is_end"), depth_before).otherwise(depth_before + 1))
    live = a.filter("_depth > 0").drop("_s", "_before", "_after", "_min")
    ks = ["item", "lane", "_depth"]
    p = skew.prefix(live, ks, ["beat"], {"_next_end": ("next", F.col("is_end")), "_next_beat": ("next", F.col("beat"))}, h(live, ks))
    heads = p.filter("not is_end").select("item", "measure", "beat", "lane", "value", F.when(F.col("_next_end"), F.col("_next_beat")).alias("end_beat"), F.lit("head").alias("role"))
    orphan = a.filter("_depth = 0").select("item", "measure", "beat", "lane", "value", F.lit(None).cast("double").alias("end_beat"), F.lit("orphan").alias("role"))
    return heads.unionByName(orphan)


def pair_alternating(ob: DataFrame, meas: DataFrame, hot=None) -> DataFrame:
    """Held-note channels pair by alternation per lane; a head left open closes at the end of the chart."""
    n = ob.withColumn("lane", _lane(HELD_LANES)).filter("lane is not null").select("item", "measure", "beat", "lane", "value")
    p = skew.prefix(n, ["item", "lane"], ["beat"], {"_rk": ("rank",), "_nb": ("next", F.col("beat"))}, None if hot is None else skew.hot_keys(n, ["item", "lane"], "beat"))
    end = meas.filter("len is null").select("item", F.col("start").alias("_total"))
    return p.filter("_rk % 2 = 1").join(end, "item").select("item", "measure", "beat", "lane", "value", F.coalesce("_nb", "_total").alias("end_beat"), F.col("_nb").isNull().alias("unclosed"))


class Chart:
    """All frames of a parsed corpus.

    The text is read and matched once: classified lines, heads and placed objects are cut to
    files, because every later step (tempo, pairing, timing) reads them several times.
    """

    def __init__(self, lines: DataFrame, hot=None):
        self.lines, self.hot = lines, hot

    @cached_property
    def cls(self):
        return cut(classify(self.lines))

    @cached_property
    def heads(self):
        return cut(chart_heads(self.cls))

    @cached_property
    def headers(self):
        return headers(self.cls)

    @cached_property
    def defs(self):
        return definitions(self.cls, self.heads)

    @cached_property
    def chan(self):
        return channel_lines(self.cls)

    @cached_property
    def meas(self):
        return cut(measures(self.chan, self.hot))

    @cached_property
    def obj(self):
        return cut(beats(objects(self.chan, self.heads), self.meas))

    @cached_property
    def kp(self):
        return cut(tempo_map(self.obj, self.defs, self.heads, self.hot))

    @cached_property
    def tap(self):
        return pair_terminators(taps(self.obj, self.defs), self.hot)

    @cached_property
    def held(self):
        return pair_alternating(self.obj, self.meas, self.hot)

    def notes(self) -> DataFrame:
        """(item, measure, lane, beat, held, value, t, end_t, dur)"""
        n = self.tap.filter("role = 'head'").select("item", "measure", "beat", "lane", "value", "end_beat", F.lit(0).alias("src")).unionByName(
            self.held.select("item", "measure", "beat", "lane", "value", "end_beat", F.lit(1).alias("src")))
        ends = n.filter("end_beat is not null").select("item", F.col("end_beat").alias("beat"), F.col("lane").alias("l"), "src", F.col("beat").alias("hb"), F.lit(1).alias("e"))
        starts = n.select("item", "beat", F.col("lane").alias("l"), "src", F.col("beat").alias("hb"), F.lit(0).alias("e"))
        t = to_seconds(starts.unionByName(ends), self.kp, self.heads, ["l", "src", "hb", "e"], self.hot)
        tt = t.groupBy("item", F.col("l").alias("lane"), "src", F.col("hb").alias("beat")).agg(F.max(F.when(F.col("e") == 0, F.col("t"))).alias("t"), F.max(F.when(F.col("e") == 1, F.col("t"))).alias("end_t"))
        return n.join(tt, ["item", "lane", "src", "beat"]).select("item", "measure", "lane", "beat", F.col("end_beat").isNotNull().cast("int").alias("held"), "value", "src", "t", "end_t", F.coalesce(F.col("end_t") - F.col("t"), F.lit(0.0)).alias("dur"))

    def durations(self) -> DataFrame:
        """(item, total_beats, measures, duration_sec)"""
        end = self.meas.filter("len is null").select("item", F.col("start").alias("beat"), F.col("measure").alias("measures"))
        return to_seconds(end, self.kp, self.heads, ["measures"], self.hot).select("item", F.col("beat").alias("total_beats"), "measures", F.col("t").alias("duration_sec"))


def peak_second(notes: DataFrame, hot=None) -> DataFrame:
    """Most notes in any half-open second (microsecond frames)."""
    n = notes.select("item", F.round(F.col("t") * 1000000).cast("long").alias("us"))
    w = skew.trailing(n, ["item"], ["us"], 999999, {"c": F.count(F.lit(1))}, None if hot is None else skew.hot_keys(n, ["item"], "us"), upto=0)
    return w.groupBy("item").agg(F.max("c").alias("peak_nps_1s"))


def peak_measure(notes: DataFrame, meas: DataFrame, dur: DataFrame) -> DataFrame:
    """Most notes per measure over its length at the chart's effective tempo."""
    c = notes.groupBy("item", "measure").agg(F.count(F.lit(1)).alias("c")).join(meas.filter("len is not null"), ["item", "measure"]).join(dur, "item")
    eff = F.col("total_beats") / F.greatest(F.col("duration_sec"), F.lit(1e-9)) * 60.0
    return c.groupBy("item").agg(F.max(F.col("c") / F.greatest(F.col("len") * 4.0 / eff * 60.0, F.lit(1e-6))).alias("peak_measure_nps"))


def chords(notes: DataFrame) -> DataFrame:
    g = notes.groupBy("item", F.round("beat", 3).alias("b")).agg(F.count(F.lit(1)).alias("s"))
    size = F.least("s", F.lit(7))
    return g.groupBy("item").agg(F.count(F.when(F.col("s") >= 2, 1)).alias("chord_count"), F.count(F.when(size == 2, 1)).alias("chord2_count"), F.count(F.when(size >= 3, 1)).alias("chord3plus_count"))


def jacks(notes: DataFrame, limit: float = 0.12, hot=None) -> DataFrame:
    p = skew.prefix(notes.select("item", "lane", "t", "src"), ["item", "lane"], ["t", "src"], {"_pt": ("prev", F.col("t"))}, None if hot is None else skew.hot_keys(notes, ["item", "lane"], "t"))
    return p.groupBy("item").agg(F.count(F.when(F.round(F.col("t") - F.col("_pt"), 9) < limit, 1)).alias("jack_count"))


# fixed values: the 26 statistics of a chart, in report order
STATS = ["total_notes", "ln_ratio", "duration_sec", "measures", "initial_bpm", "min_bpm", "max_bpm", "bpm_change_count", "stop_count", "stop_total_sec",
         "lane0_scratch", "lane1", "lane2", "lane3", "lane4", "lane5", "lane6", "lane7", "scratch_ratio", "avg_nps", "peak_nps_1s", "peak_measure_nps", "chord_count", "chord2_count", "chord3plus_count", "jack_count"]


def stats26(ch: Chart, notes: DataFrame | None = None) -> DataFrame:
    """The 26 ordered statistics per chart.  ``notes`` may be a materialised copy of ``ch.notes()``."""
    n = ch.notes() if notes is None else notes
    dur = ch.durations()
    tempo = ch.kp.groupBy("item").agg(F.sum("n_bpm").alias("bpm_change_count"), F.sum("n_stop").alias("stop_count"), F.sum("stop_sec").alias("stop_total_sec"), F.min("lo_bpm").alias("_lo"), F.max("hi_bpm").alias("_hi"))
    lanes = [F.count(F.when(F.col("lane") == i, 1)).alias("lane0_scratch" if i == 0 else f"lane{i}") for i in range(8)]
    base = n.groupBy("item").agg(F.count(F.lit(1)).alias("total_notes"), F.avg("held").alias("ln_ratio"), *lanes)
    j = ch.heads.join(dur, "item").join(tempo, "item", "left").join(base, "item", "left").join(peak_second(n, ch.hot), "item", "left")
    j = j.join(peak_measure(n, ch.meas, dur), "item", "left").join(chords(n), "item", "left").join(jacks(n, hot=ch.hot), "item", "left")
    j = j.withColumns({"min_bpm": F.least("initial_bpm", "_lo"), "max_bpm": F.greatest("initial_bpm", "_hi"), "total_notes": F.coalesce("total_notes", F.lit(0))})
    j = j.withColumns({"scratch_ratio": F.coalesce("lane0_scratch", F.lit(0)) / F.greatest(F.col("total_notes"), F.lit(1)), "avg_nps": F.coalesce(F.try_divide("total_notes", "duration_sec"), F.lit(0.0))})
    return j.select("item", *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in STATS])


# fixed values: difficulty and version suffixes removed from titles; the first of the list that fits goes
SUFFIXES = (
    "another", "hyper", "normal", "hard", "hardest", "easy", "beginner", "god", "hades", "insane", "maniaq", "extreme", "afother", "ex", "ln", "light", "pocket",
    "lastboss", "lumiere", "sa", "ecstacy", "presea", "main", "seiryu", "pham", "9dan", "plus", "myth", "hina", "onehand", "rather", "sarather", "trill", "トリル",
    "delay", "gb", "obj", "aria", "dios", "clover", "gunn", "gungnir", "グングニル", "black", "7", "07", "an", "sp", "dp", "bms",
)
NON_WORD = r"[\W_]+"
BRACKETS = r"[\[（(].*?[\]）)]"


def without_suffixes(title: str) -> str:
    """Takes suffixes away until none fits; a title is never taken away whole."""
    while True:
        tail = next((x for x in SUFFIXES if title.endswith(x) and title != x), None)
        if tail is None:
            return title
        title = title.removesuffix(tail)


@F.pandas_udf(StringType())
def folded(text: pd.Series) -> pd.Series:
    """Compatibility-normalised, lower case; null as empty."""
    return text.fillna("").str.normalize("NFKC").str.lower()


@F.pandas_udf(StringType())
def base_title(title: pd.Series) -> pd.Series:
    """Folded title without brackets, punctuation and trailing suffixes."""
    plain = title.fillna("").str.normalize("NFKC").str.lower().str.replace(BRACKETS, "", regex=True).str.replace(NON_WORD, "", regex=True)
    known: dict[str, str] = {}
    return plain.map(lambda x: known.get(x) or known.setdefault(x, without_suffixes(x)))


WORDLESS = r"[^\p{L}\p{N}]+"  # NON_WORD for Spark's patterns


def song_key(title: Column, path: Column) -> Column:
    """'t:' + base title, else 'f:' + normalised folder."""
    folder = F.regexp_replace(folded(F.regexp_extract(path, r"^(.*)/[^/]*$", 1)), WORDLESS, "")
    b = base_title(title)
    return F.when(F.length(b) > 0, F.concat(F.lit("t:"), b)).otherwise(F.concat(F.lit("f:"), F.when(F.length(folder) > 0, folder).otherwise("unknown")))


def artist_key(artist: Column) -> Column:
    """First non-empty '/' part, folded, punctuation removed."""
    parts = F.filter(F.split(folded(artist), "/"), lambda p: F.length(F.trim(p)) > 0)
    return F.coalesce(F.regexp_replace(F.get(parts, F.lit(0)), WORDLESS, ""), F.lit(""))
