"""Golden chart-text fixtures (times within 2 ms)."""

import pytest
from pyspark.sql import functions as F

from tracklens.operators import corpus as C

# name, text, expected notes as (value, lane, time[, end])
CASES = [
    ("len", "#BPM 60¶#00111:01000002¶#00311:0003", [(1, 1, 4), (2, 1, 7), (3, 1, 14)]),
    ("ch03", "#BPM 60¶#00003:0078¶#00111:01", [(1, 1, 3.0)]),
    ("zero", "#BPM 0¶#00111:01", [(1, 1, 4 * 60 / 130)]),
    ("neg", "#BPM -120¶#00111:01", [(1, 1, 2.0)]),
    ("two03", "#BPM 100¶#00003:0060C0¶#00011:00010203¶#00111:04", [(1, 1, 0.6), (2, 1, 1.2167), (3, 1, 1.7375), (4, 1, 2.05)]),
    ("ch08", "#BPM 60¶#BPM01 120¶#00008:0001¶#00111:05", [(5, 1, 3.0)]),
    ("stop", "#BPM 60¶#STOP11 96¶#00111:01000200¶#00109:00110000", [(1, 1, 4.0), (2, 1, 8.0)]),
    ("stoplen", "#BPM 60¶#STOP11 96¶#00102:0.75¶#00111:010002¶#00109:001100", [(1, 1, 4.0), (2, 1, 8.0)]),
    ("bpmstop", "#BPM 60¶#BPM11 30¶#STOP11 96¶#00111:01000200¶#00109:00110000¶#00108:00110000", [(1, 1, 4.0), (2, 1, 11.0)]),
    ("prestop", "#BPM 120¶#STOP11 192¶#00111:01020304¶#00109:11000000", [(1, 1, 2.0), (2, 1, 4.5), (3, 1, 5.0), (4, 1, 5.5)]),
    ("meas", "#BPM 60¶#00102:0.750¶#00111:0104¶#00211:02¶#00311:03", [(1, 1, 4), (4, 1, 5.5), (2, 1, 7), (3, 1, 11)]),
    ("half", "#BPM 60¶#00002:0.5¶#00111:01", [(1, 1, 2.0)]),
    ("lnobj", "#BPM 60¶#LNOBJ ZZ¶#00111:00220000¶#06411:0000000000zz", [(74, 1, 5.0, 259.333)]),
    ("lntype", "#BPM 60¶#LNTYPE 1¶#00151:00220000¶#06451:000000000033", [(74, 1, 5.0, 259.333)]),
    ("open", "#BPM 60¶#00151:22", [(74, 1, 4.0, 8.0)]),
    ("lanes", "#BPM 60¶#00116:01¶#00111:02¶#00118:03¶#00119:04", [(1, 0, 4), (2, 1, 4), (3, 6, 4), (4, 7, 4)]),
    ("base62", "#BPM 60¶#BASE 62¶#00111:aa", [(2268, 1, 4)]),
    ("other", "#BPM 60¶#00117:01¶#0011A:02¶#001D1:03¶#00111:04", [(4, 1, 4)]),
    ("override", "#BPM 60¶#00113:11111111¶#00113:0022332255224400¶#00113:0066", None),
]


@pytest.fixture(scope="module")
def chart(spark):
    rows = [(i, text.replace("¶", "\n")) for i, (_, text, _) in enumerate(CASES)]
    lines = C.text_lines(spark.createDataFrame(rows, "item long, text string"), "item", "text")
    return C.Chart(lines)


def test_note_times(chart):
    got = {}
    for r in chart.notes().collect():
        got.setdefault(r.item, []).append(r)
    for i, (name, _, want) in enumerate(CASES):
        if want is None:
            continue
        rows = sorted(got[i], key=lambda r: (r.t, r.lane))
        assert len(rows) == len(want), name
        for r, w in zip(rows, sorted(want, key=lambda w: (w[2], w[1]))):
            assert (r.value, r.lane) == (w[0], w[1]), name
            assert abs(r.t - w[2]) < 2e-3, name
            if len(w) > 3:
                assert r.held == 1 and abs(r.end_t - w[3]) < 2e-3, name


def test_later_line_overrides_slot(chart):
    i = [c[0] for c in CASES].index("override")
    rows = chart.notes().filter(F.col("item") == i).collect()
    assert len(rows) == 7
    hit = [r for r in rows if r.beat == 6]
    assert len(hit) == 1 and hit[0].value == 222 and hit[0].lane == 3


def test_heads_flag_tempo_and_unclosed(chart):
    ix = [c[0] for c in CASES]
    heads = {r.item: r for r in chart.heads.collect()}
    assert heads[ix.index("zero")].zero_bpm and heads[ix.index("zero")].initial_bpm == 130.0
    assert heads[ix.index("neg")].negative_bpm and heads[ix.index("neg")].initial_bpm == 120.0
    open_ = chart.held.filter(F.col("item") == ix.index("open")).collect()
    assert [r.unclosed for r in open_] == [True]


def test_stats_count_tempo_events(chart):
    ix = [c[0] for c in CASES]
    s = {r.item: r for r in C.stats26(chart).collect()}
    assert s[ix.index("two03")].bpm_change_count == 2 and s[ix.index("two03")].max_bpm == 192
    assert s[ix.index("stop")].stop_count == 1 and abs(s[ix.index("stop")].stop_total_sec - 2.0) < 1e-9
    assert s[ix.index("lanes")].chord_count == 1 and s[ix.index("lanes")].chord3plus_count == 1
    assert s[ix.index("len")].total_notes == 3 and s[ix.index("len")].peak_nps_1s == 1


def test_nested_terminators_and_orphans(spark):
    text = "#BPM 60\n#LNOBJ ZZ\n#00011:ZZ0102ZZZZ03ZZZZ"
    ch = C.Chart(C.text_lines(spark.createDataFrame([(1, text)], "item long, text string"), "item", "text"))
    rows = {r.beat: r for r in ch.tap.collect()}
    assert rows[0.0].role == "orphan" and rows[3.5].role == "orphan"
    assert rows[0.5].end_beat == 2.0 and rows[1.0].end_beat == 1.5 and rows[2.5].end_beat == 3.0


def test_titles(spark):
    rows = [("Song [ANOTHER]", "song"), ("song -hyper another-", "song"), ("EX", "ex"), ("x07", "x0"), ("sarather", "sa"), ("Foo(bar) LN", "foo")]
    df = spark.createDataFrame(rows, "t string, want string").select("want", C.base_title(F.col("t")).alias("got"))
    for r in df.collect():
        assert r.got == r.want
