"""Rosters of any size, title folding, redefinitions, chunks of equal values."""

from pyspark.sql import functions as F

from tracklens.operators import corpus as C
from tracklens.operators import joins, scoring, skew


def test_candidates_of_a_large_roster(spark):
    roster = F.array(*[F.lit(k) for k in range(-5, 65)])  # 70 members, negative codes too
    items = spark.createDataFrame([(1,), (2,)], "item long")
    played = spark.createDataFrame([(1, 63), (1, 64), (1, -1)], "item long, player int")
    got = {(r.item, r.player) for r in scoring.candidates(items, played, roster).collect()}
    assert got == {(i, k) for i in (1, 2) for k in range(-5, 65)} - {(1, 63), (1, 64), (1, -1)}


def test_overlap_of_a_large_roster(spark):
    rows = [(i, p) for i in range(3) for p in (0, 63, 64, 130)] + [(9, 130), (9, 64)]
    got = {(r.a, r.b): r.n_both for r in joins.pair_overlap(joins.roster_sets(spark.createDataFrame(rows, "item long, p int"), "item", "p")).collect()}
    assert got == {(0, 63): 3, (0, 64): 3, (0, 130): 3, (63, 64): 3, (63, 130): 3, (64, 130): 4}


def test_titles_reach_a_fixpoint_in_list_order(spark):
    rows = [("foo9dan", "foo"), ("foo" + "ex" * 10, "foo"), ("ex", "ex"), ("ＦＯＯ [x] another", "foo"), ("sarather", "sa"), (None, ""), ("foo hardest", "foo"), ("①song（下）", "1song")]
    got = [r.b for r in spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "i int, t string").select("i", C.base_title("t").alias("b")).orderBy("i").collect()]
    assert got == [w for _, w in rows]


def test_later_definitions_win_and_terminators_add_up(spark):
    text = "#BPM 60\n#BPM01 120\n#EXBPM01 90\n#LNOBJ YY\n#LNOBJ ZZ\n#00011:01000000\n#00108:01\n#00111:02YY03ZZ\n#100011:01"
    chart = C.Chart(C.text_lines(spark.createDataFrame([(1, text)], "item long, text string"), "item", "text"))
    defs = {(r.what, r.idx): r.value for r in chart.defs.collect()}
    assert defs["bpm", 1] == 90 and sum(w == "lnobj" for w, _ in defs) == 2
    assert sorted(r.measure for r in chart.chan.collect()) == [0, 1, 1, 1000]
    ends = [r.end_beat for r in chart.tap.filter("role = 'head' and end_beat is not null").collect()]
    assert sorted(ends) == [5.0, 7.0]


def test_chunks_of_one_value_stay_small(spark, monkeypatch):
    df = spark.range(20_000).select(F.lit(1).alias("v"), "id")
    seen = []
    real = skew.cut
    monkeypatch.setattr(skew, "cut", lambda x: seen.append(real(x)) or seen[-1])
    got = skew.global_prefix(df, ["v", "id"], {"rk": ("rank",)}, 1000)
    assert got.filter("rk = id + 1").count() == 20_000
    most = seen[-1].groupBy(skew.CHUNK).count().agg(F.max("count")).first()[0]
    assert most < 3000
