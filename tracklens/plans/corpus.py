"""Chart-text corpus queries.  The texts are derived from the events table: every user is one chart."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import DIGITS, r
from ..operators import corpus as C, joins
from ..session import cut
from ..sources import tables as t
from . import sqlparts as S
from .registry import query
from .sequence import rd

CH_TAP = ["16", "11", "12", "13", "14", "15", "18", "19"]
CH_HELD = ["56", "51", "52", "53", "54", "55", "58", "59"]

# (line_no, condition on item, text expression) - the same strings are valid Spark SQL and reference SQL
HEAD = [
    (1, "item % 2 = 0", "'// generated from events'"),
    (2, None, "concat('#TITLE Song ', CAST(item % 40 AS STRING), CASE item % 5 WHEN 0 THEN ' [ANOTHER]' WHEN 1 THEN ' (7key) hyper' WHEN 2 THEN ' -another- LN' WHEN 3 THEN ' insane ex' ELSE '' END)"),
    (3, None, "concat('#ARTIST ', CASE WHEN item % 7 = 0 THEN ' / ' ELSE '' END, 'Maker ', CAST(item % 11 AS STRING), ' / obj: someone')"),
    (4, None, "concat('#BPM ', CASE WHEN item % 23 = 0 THEN '0' WHEN item % 19 = 0 THEN '-120' ELSE CAST(60 + item % 5 * 30 AS STRING) END)"),
    (5, "item % 13 = 0", "'#bpm 90.5'"),
    (6, None, "concat('#RANK ', CAST(item % 4 AS STRING))"),
    (7, None, "concat('#PLAYER ', CASE WHEN item % 29 = 0 THEN '3' ELSE '1' END)"),
    (8, "item % 4 = 1", "'#LNOBJ ZZ'"),
    (9, None, "'#BPM01 240'"),
    (10, None, "'#EXBPM02 45.5'"),
    (11, None, "'#STOP01 96'"),
    (12, None, "'#STOP02 24'"),
    (13, "item % 31 = 0", "'#RANDOM 2'"),
    (14, "item % 37 = 0", "'#LNTYPE 2'"),
    (15, "item % 6 = 0", "'#@ broken line'"),
    (16, None, "'#WAV01 a.wav'"),
    (17, "item % 5 = 2", "'#EXBPM01 90'"),
    (18, "item % 8 = 1", "'#LNOBJ RR'"),
    (19, "item % 7 = 3", "'#STOP01 48'"),
    (26, "item % 9 = 4", "'#BPM fast'"),
    (27, "item % 10 = 3", "'#BPM05 x'"),
    (28, "item % 12 = 5", "'#STOP07 -'"),
    (29, "item % 11 = 2", "'#00702:wide'"),
    (20, "item % 3 = 0", "'#00203:0078'"),
    (21, "item % 3 = 1", "'#00408:00010002'"),
    (22, None, "'#00302:0.75'"),
    (23, "item % 4 = 0", "'#00802:1.5'"),
    (24, "item % 2 = 0", "'#00609:0001'"),
    (25, "item % 3 = 1", "'#00409:00020000'"),
]
ZZ = "item % 4 = 1 AND event_id % 6 = 0 AND type = 0"


def chart_lines(spark, sf):
    n = t.notes(spark, sf)
    v = F.expr("event_id % 1000 + 1")
    pair = F.when(F.expr(ZZ), "ZZ").otherwise(F.concat(F.substr(F.lit(DIGITS), F.floor(v / 36).cast("int") + 1, F.lit(1)), F.substr(F.lit(DIGITS), (v % 36).cast("int") + 1, F.lit(1))))
    names = F.when(F.col("type") == 1, F.element_at(F.array(*[F.lit(c) for c in CH_HELD]), F.col("lane") + 1)).otherwise(F.element_at(F.array(*[F.lit(c) for c in CH_TAP]), F.col("lane") + 1))
    slots = n.groupBy("item", F.floor(F.col("tick") / 64).alias("m"), names.alias("ch"), (F.col("tick") % 64).cast("int").alias("p")).agg(F.max(pair).alias("v"))
    packed = slots.groupBy("item", "m", "ch").agg(F.map_from_entries(F.collect_list(F.struct("p", "v"))).alias("mp"))  # at most 64 slots
    data = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(63)), lambda p: F.coalesce(F.try_element_at("mp", p), F.lit("00"))), "")
    body = packed.select("item", (F.lit(1000) + F.col("m") * 100 + F.col("ch").cast("int")).cast("long").alias("line_no"),
                         F.concat(F.lit("#"), F.when(F.col("m") < 1000, F.lpad(F.col("m").cast("string"), 3, "0")).otherwise(F.col("m").cast("string")), "ch", F.lit(":"), data).alias("line"))
    heads = F.array_compact(F.array(*[F.expr(f"CASE WHEN {c or 'TRUE'} THEN named_struct('line_no', CAST({i} AS BIGINT), 'line', {e}) END") for i, c, e in HEAD]))
    users = t.table(spark, sf, "events", "user_id").distinct().select(F.col("user_id").alias("item"))
    return users.select("item", F.inline(heads)).unionByName(body)


def chart(spark, sf):
    hot = t.hot(spark, sf, "note")
    return C.Chart(chart_lines(spark, sf), hot)


_hs = " UNION ALL ".join(f"SELECT item, CAST({i} AS BIGINT) AS line_no, {e.replace('AS STRING', 'AS VARCHAR')} AS line FROM us WHERE {c or 'TRUE'}" for i, c, e in HEAD)
_arr = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"
LINES = f"""{S.NOTES}, us AS (SELECT DISTINCT user_id AS item FROM events), sl AS (SELECT item, tick // 64 AS m, CASE WHEN type = 1 THEN {_arr(CH_HELD)}[lane + 1] ELSE {_arr(CH_TAP)}[lane + 1] END AS ch, tick % 64 AS p,
 max(CASE WHEN {ZZ} THEN 'ZZ' ELSE concat(substr('{DIGITS}', (event_id % 1000 + 1) // 36 + 1, 1), substr('{DIGITS}', (event_id % 1000 + 1) % 36 + 1, 1)) END) AS v FROM notes GROUP BY 1, 2, 3, 4),
 sp0 AS (SELECT item, m, ch, unnest(range(64)) AS p FROM (SELECT DISTINCT item, m, ch FROM sl)), bd AS (SELECT item, m, ch, string_agg(coalesce(v, '00'), '' ORDER BY p) AS data FROM sp0 LEFT JOIN sl USING (item, m, ch, p) GROUP BY 1, 2, 3),
 ln AS ({_hs} UNION ALL SELECT item, 1000 + m * 100 + CAST(ch AS BIGINT), concat('#', CASE WHEN m < 1000 THEN lpad(CAST(m AS VARCHAR), 3, '0') ELSE CAST(m AS VARCHAR) END, ch, ':', data) FROM bd)"""
CLS = LINES + f""", cl AS (SELECT item, line_no, line, CASE WHEN regexp_matches(line, '{C.CONTROL}') THEN 'control' WHEN regexp_matches(line, '{C.CHANNEL}') THEN 'channel' WHEN regexp_matches(line, '{C.HEADER}') THEN 'header' ELSE 'unparsed' END AS kind FROM ln WHERE line LIKE '#%'),
 hx AS (SELECT item, line_no, kind, upper(regexp_extract(line, '{C.HEADER}', 1)) AS key, trim(regexp_extract(line, '{C.HEADER}', 2)) AS value FROM cl)"""


def _last(key, ty):
    return f"arg_max(TRY_CAST(value AS {ty}), line_no) FILTER (WHERE key = '{key}' AND TRY_CAST(value AS {ty}) IS NOT NULL)"


HEADS = CLS + f""", hr AS (SELECT item, {_last('BPM', 'DOUBLE')} AS b, CAST({_last('RANK', 'DOUBLE')} AS INT) AS rank, coalesce({_last('PLAYER', 'INT')}, 1) AS player, coalesce(CAST({_last('LNTYPE', 'DOUBLE')} AS INT), 1) AS lntype,
 bool_or(kind = 'control') AS control_flow, count(*) FILTER (WHERE kind = 'unparsed') AS n_unparsed FROM hx GROUP BY item), heads AS (SELECT *, CASE WHEN b IS NULL OR b = 0 THEN 130.0 ELSE abs(b) END AS initial_bpm FROM hr)"""


def _dec(p):
    return f"((strpos('{DIGITS[:36]}', upper(substr({p}, 1, 1))) - 1) * 36 + strpos('{DIGITS[:36]}', upper(substr({p}, 2, 1))) - 1)"


DEFS = HEADS + f""", df AS (SELECT item, CASE WHEN key LIKE 'BPM__%' OR key LIKE 'EXBPM__%' THEN 'bpm' WHEN key LIKE 'STOP__%' THEN 'stop' WHEN key = 'LNOBJ' THEN 'lnobj' END AS what, CASE WHEN key = 'LNOBJ' THEN substr(value, 1, 2) ELSE right(key, 2) END AS p, TRY_CAST(value AS DOUBLE) AS value, line_no FROM hx),
 defs AS (SELECT item, what, CAST({_dec('p')} AS INT) AS idx, arg_max(value, line_no) AS value FROM df WHERE what IS NOT NULL AND (what = 'lnobj' OR value IS NOT NULL) GROUP BY 1, 2, 3)"""
OBJ = DEFS + f""", cn AS (SELECT item, line_no, CAST(regexp_extract(line, '{C.CHANNEL}', 1) AS INT) AS measure, upper(regexp_extract(line, '{C.CHANNEL}', 2)) AS channel, trim(regexp_extract(line, '{C.CHANNEL}', 3)) AS data FROM cl WHERE kind = 'channel'),
 px AS (SELECT item, line_no, measure, channel, length(data) // 2 AS n, unnest(range(length(data) // 2)) AS i, data FROM cn WHERE channel IN ({', '.join(repr(c) for c in [*CH_TAP, *CH_HELD, '03', '08', '09'])})),
 ov AS (SELECT item, line_no, measure, channel, i / n AS frac, CAST(CASE WHEN channel = '03' THEN CAST('0x' || substr(data, i * 2 + 1, 2) AS INT) ELSE {_dec('substr(data, i * 2 + 1, 2)')} END AS INT) AS value FROM px),
 obj AS (SELECT item, measure, channel, frac, arg_max(value, line_no) AS value FROM ov WHERE value > 0 GROUP BY 1, 2, 3, 4)"""
MEAS = OBJ + """, mx AS (SELECT item, max(measure) AS mm FROM cn GROUP BY item), ml0 AS (SELECT item, measure, TRY_CAST(arg_max(data, line_no) AS DOUBLE) AS len FROM cn WHERE channel = '02' GROUP BY 1, 2),
 msp AS (SELECT item, CAST(unnest(range(mm + 1)) AS INT) AS measure FROM mx), ml AS (SELECT item, measure, CASE WHEN len > 0 THEN len ELSE 1.0 END AS len FROM msp LEFT JOIN ml0 USING (item, measure)),
 ms AS (SELECT *, coalesce(sum(len * 4) OVER (PARTITION BY item ORDER BY measure ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM ml), tb AS (SELECT item, max(mm) + 1 AS measures, sum(len * 4) AS total_beats FROM ml JOIN mx USING (item) GROUP BY item),
 ob AS (SELECT obj.*, round(start + frac * len * 4, 9) AS beat FROM obj JOIN ms USING (item, measure))"""
KP = MEAS + """, ac AS (SELECT o.item, beat, channel, measure, CASE WHEN channel = '09' THEN 'stop' ELSE 'bpm' END AS what, CASE WHEN channel = '03' THEN CAST(o.value AS DOUBLE) ELSE defs.value END AS v FROM ob o LEFT JOIN defs ON defs.item = o.item AND defs.idx = o.value AND defs.what = CASE WHEN channel = '09' THEN 'stop' ELSE 'bpm' END WHERE channel IN ('03', '08', '09')),
 k0 AS (SELECT item, beat, arg_max(greatest(abs(v), 1e-9), (channel, measure)) FILTER (WHERE what = 'bpm') AS sb, coalesce(sum(v / 48) FILTER (WHERE what = 'stop'), 0) AS stb, count(*) FILTER (WHERE what = 'bpm') AS n_bpm, count(*) FILTER (WHERE what = 'stop') AS n_stop, min(greatest(abs(v), 1e-9)) FILTER (WHERE what = 'bpm') AS lo, max(greatest(abs(v), 1e-9)) FILTER (WHERE what = 'bpm') AS hi FROM ac WHERE v IS NOT NULL GROUP BY 1, 2),
 k1 AS (SELECT k0.*, initial_bpm, coalesce(last_value(sb IGNORE NULLS) OVER (PARTITION BY k0.item ORDER BY beat ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), initial_bpm) AS before, coalesce(lag(beat) OVER (PARTITION BY k0.item ORDER BY beat), 0) AS pb FROM k0 JOIN heads USING (item)),
 k2 AS (SELECT *, coalesce(sb, before) AS bpm, (beat - pb) * 60 / before AS d, stb * 60 / coalesce(sb, before) AS stop_sec FROM k1),
 kp AS (SELECT *, d + coalesce(sum(d + stop_sec) OVER (PARTITION BY item ORDER BY beat ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS t_pre, d + stop_sec + coalesce(sum(d + stop_sec) OVER (PARTITION BY item ORDER BY beat ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS t_post FROM k2)"""
TSEC = "CASE WHEN kp.beat IS NULL THEN {q}.beat * 60 / heads.initial_bpm WHEN kp.beat = {q}.beat THEN t_pre ELSE t_post + ({q}.beat - kp.beat) * 60 / bpm END"
_case = lambda xs: "CASE channel " + " ".join(f"WHEN '{c}' THEN {i}" for i, c in enumerate(xs)) + " END"
NOTES = KP + f""", tp AS (SELECT o.item, measure, beat, {_case(CH_TAP)} AS lane, o.value, defs.idx IS NOT NULL AS is_end FROM ob o LEFT JOIN defs ON defs.item = o.item AND what = 'lnobj' AND idx = o.value WHERE channel IN ({', '.join(repr(c) for c in CH_TAP)})),
 t1 AS (SELECT *, sum(CASE WHEN is_end THEN -1 ELSE 1 END) OVER (PARTITION BY item, lane ORDER BY beat) AS s FROM tp), t2 AS (SELECT *, least(0, min(s) OVER (PARTITION BY item, lane ORDER BY beat)) AS mn, coalesce(least(0, min(s) OVER (PARTITION BY item, lane ORDER BY beat ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), 0) AS mp FROM t1),
 t3 AS (SELECT *, CASE WHEN is_end THEN s + 1 - mp ELSE s - mn END AS depth FROM t2), pe AS (SELECT item, lane, depth, beat FROM t3 WHERE is_end AND depth > 0),
 ph AS (SELECT item, measure, beat, lane, value, depth, lead(beat) OVER (PARTITION BY item, lane, depth ORDER BY beat) AS nh FROM t3 WHERE NOT is_end), pt AS (SELECT ph.item, measure, ph.beat, ph.lane, value, min(pe.beat) AS end_beat FROM ph LEFT JOIN pe ON pe.item = ph.item AND pe.lane = ph.lane AND pe.depth = ph.depth AND pe.beat > ph.beat AND (nh IS NULL OR pe.beat < nh) GROUP BY 1, 2, 3, 4, 5),
 hl AS (SELECT item, measure, beat, {_case(CH_HELD)} AS lane, value, row_number() OVER (PARTITION BY item, channel ORDER BY beat) AS rk, lead(beat) OVER (PARTITION BY item, channel ORDER BY beat) AS nb FROM ob WHERE channel IN ({', '.join(repr(c) for c in CH_HELD)})),
 lc AS (SELECT item, measure, beat, lane, value, coalesce(nb, total_beats) AS end_beat, nb IS NULL AS unclosed FROM hl JOIN tb USING (item) WHERE rk % 2 = 1),
 n0 AS (SELECT item, measure, beat, lane, value, end_beat, 0 AS src FROM pt UNION ALL SELECT item, measure, beat, lane, value, end_beat, 1 FROM lc), n1 AS (SELECT n.*, {TSEC.format(q='n')} AS t FROM n0 n JOIN heads USING (item) ASOF LEFT JOIN kp ON kp.item = n.item AND n.beat >= kp.beat),
 en AS (SELECT item, lane, src, beat AS hb, end_beat AS beat FROM n0 WHERE end_beat IS NOT NULL), e1 AS (SELECT en.item, en.lane, en.src, en.hb, {TSEC.format(q='en')} AS end_t FROM en JOIN heads USING (item) ASOF LEFT JOIN kp ON kp.item = en.item AND en.beat >= kp.beat),
 nt AS (SELECT n1.item, measure, n1.lane, n1.beat, CAST(end_beat IS NOT NULL AS INT) AS held, value, n1.src, t, end_t, coalesce(end_t - t, 0) AS dur FROM n1 LEFT JOIN e1 ON e1.item = n1.item AND e1.lane = n1.lane AND e1.src = n1.src AND e1.hb = n1.beat),
 du AS (SELECT x.item, measures, x.beat AS total_beats, {TSEC.format(q='x')} AS duration_sec FROM (SELECT item, measures, total_beats AS beat FROM tb) x JOIN heads USING (item) ASOF LEFT JOIN kp ON kp.item = x.item AND x.beat >= kp.beat)"""


@query("src_text_lines", """WITH x AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, unnest(range(len(string_split(text, chr(10))))) + 1 AS n FROM documents), y AS (SELECT doc_id, CAST(n AS INT) AS line_no, trim(replace(l, chr(13), '')) AS line FROM x)
 SELECT doc_id, line_no, md5(line) AS line_hash FROM y WHERE line <> ''""")
def src_text_lines(spark, sf):
    return C.text_lines(t.table(spark, sf, "documents", "doc_id", "text"), "doc_id", "text").select("doc_id", "line_no", F.md5("line").alias("line_hash"))


@query("cor_classify", f"WITH {CLS} SELECT item, line_no, kind FROM cl")
def cor_classify(spark, sf):
    return C.classify(chart_lines(spark, sf)).select("item", "line_no", "kind")


@query("cor_headers", f"WITH {CLS} SELECT item, key, arg_max(value, line_no) AS value FROM hx WHERE kind = 'header' GROUP BY 1, 2")
def cor_headers(spark, sf):
    return C.headers(C.classify(chart_lines(spark, sf)))


@query("cor_defs", f"WITH {DEFS} SELECT item, what, idx, value FROM defs")
def cor_defs(spark, sf):
    return chart(spark, sf).defs.select("item", "what", F.col("idx").cast("int").alias("idx"), "value")


@query("cor_base_decode", f"WITH p AS (SELECT doc_id, substr(md5(text), 1, 2) AS p FROM documents) SELECT doc_id, CAST({_dec('p')} AS INT) AS b36, CAST((strpos('{DIGITS}', substr(p, 1, 1)) - 1) * 62 + strpos('{DIGITS}', substr(p, 2, 1)) - 1 AS INT) AS b62, CAST('0x' || p AS INT) AS hex FROM p")
def cor_base_decode(spark, sf):
    from ..functions.columns import decode_index

    p = t.table(spark, sf, "documents", "doc_id", "text").select("doc_id", F.substring(F.md5("text"), 1, 2).alias("p"))
    return p.select("doc_id", decode_index("p", F.lit(36)).cast("int").alias("b36"), decode_index("p", F.lit(62)).cast("int").alias("b62"), F.conv("p", 16, 10).cast("int").alias("hex"))


@query("cor_objects", f"WITH {OBJ} SELECT item, measure, channel, frac, value FROM obj")
def cor_objects(spark, sf):
    ch = chart(spark, sf)
    return C.objects(ch.chan, ch.heads)


@query("cor_measure_start", f"WITH {MEAS} SELECT item, measure, len, start FROM ms WHERE (item, measure) IN (SELECT (item, measure) FROM cn)")
def cor_measure_start(spark, sf):
    return chart(spark, sf).meas.filter("len is not null").select("item", "measure", "len", "start")


@query("cor_tempo_map", f"WITH {KP} SELECT item, round(beat, 4) AS beat, round(t_pre, 4) AS t_pre, round(t_post, 4) AS t_post, round(bpm, 4) AS bpm FROM kp")
def cor_tempo_map(spark, sf):
    return rd(chart(spark, sf).kp.select("item", "beat", "t_pre", "t_post", "bpm"))


@query("cor_beat_to_sec", f"WITH {KP}, q AS (SELECT o.item, measure, channel, frac, beat FROM ob o) SELECT q.item, q.measure, q.channel, q.frac, round({TSEC.format(q='q')}, 4) AS t FROM q JOIN heads USING (item) ASOF LEFT JOIN kp ON kp.item = q.item AND q.beat >= kp.beat")
def cor_beat_to_sec(spark, sf):
    ch = chart(spark, sf)
    o = ch.obj.select("item", "measure", "channel", "frac", "beat")
    return C.to_seconds(o, ch.kp, ch.heads, ["channel", "measure", "frac"], ch.hot).select("item", "measure", "channel", "frac", r("t", 4).alias("t"))


@query("cor_ln_pair", f"WITH {NOTES} SELECT item, lane, beat, end_beat, unclosed FROM lc")
def cor_ln_pair(spark, sf):
    return chart(spark, sf).held.select("item", "lane", "beat", "end_beat", "unclosed")


@query("cor_lnobj_pair", f"WITH {NOTES} SELECT item, lane, beat, end_beat, 'head' AS role FROM pt UNION ALL SELECT item, lane, beat, NULL, 'orphan' FROM t3 WHERE is_end AND depth = 0")
def cor_lnobj_pair(spark, sf):
    return chart(spark, sf).tap.select("item", "lane", "beat", "end_beat", "role")


STATS_SQL = f"""WITH {NOTES}, b AS (SELECT item, count(*) AS total_notes, avg(held) AS ln_ratio, {', '.join(f"count(*) FILTER (WHERE lane = {i}) AS {'lane0_scratch' if i == 0 else f'lane{i}'}" for i in range(8))} FROM nt GROUP BY item),
 te AS (SELECT item, CAST(sum(n_bpm) AS BIGINT) AS bpm_change_count, CAST(sum(n_stop) AS BIGINT) AS stop_count, sum(stop_sec) AS stop_total_sec, min(lo) AS lo, max(hi) AS hi FROM kp GROUP BY item),
 us2 AS (SELECT item, CAST(round(t * 1000000) AS BIGINT) AS us FROM nt), pk AS (SELECT item, max(c) AS peak_nps_1s FROM (SELECT item, count(*) OVER (PARTITION BY item ORDER BY us RANGE BETWEEN 999999 PRECEDING AND CURRENT ROW) AS c FROM us2) GROUP BY item),
 pm AS (SELECT item, max(c / greatest(len * 4 / (total_beats / greatest(duration_sec, 1e-9) * 60) * 60, 1e-6)) AS peak_measure_nps FROM (SELECT item, measure, count(*) AS c FROM nt GROUP BY 1, 2) JOIN ms USING (item, measure) JOIN du USING (item) GROUP BY item),
 cg AS (SELECT item, count(*) AS s FROM nt GROUP BY item, round(beat, 3)), ch AS (SELECT item, count(*) FILTER (WHERE s >= 2) AS chord_count, count(*) FILTER (WHERE s = 2) AS chord2_count, count(*) FILTER (WHERE s >= 3) AS chord3plus_count FROM cg GROUP BY item),
 jk AS (SELECT item, count(*) FILTER (WHERE round(d, 9) < 0.12) AS jack_count FROM (SELECT item, t - lag(t) OVER (PARTITION BY item, lane ORDER BY t, src) AS d FROM nt) GROUP BY item),
 st AS (SELECT *, least(initial_bpm, lo) AS min_bpm, greatest(initial_bpm, hi) AS max_bpm, lane0_scratch / greatest(total_notes, 1) AS scratch_ratio, total_notes / duration_sec AS avg_nps FROM heads JOIN du USING (item) LEFT JOIN te USING (item) LEFT JOIN b USING (item) LEFT JOIN pk USING (item) LEFT JOIN pm USING (item) LEFT JOIN ch USING (item) LEFT JOIN jk USING (item))"""
S26 = ", ".join(f"round(coalesce(CAST({c} AS DOUBLE), 0), 3) AS {c}" for c in C.STATS)


@query("cor_stats26", f"{STATS_SQL} SELECT item, {S26} FROM st")
def cor_stats26(spark, sf):
    ch = chart(spark, sf)
    return rd(C.stats26(ch, cut(ch.notes())), 3)


@query("cor_peak_1s", f"{STATS_SQL} SELECT item, peak_nps_1s FROM pk")
def cor_peak_1s(spark, sf):
    ch = chart(spark, sf)
    return C.peak_second(ch.notes(), ch.hot)


@query("cor_peak_measure", f"{STATS_SQL} SELECT item, round(peak_measure_nps, 4) AS peak_measure_nps FROM pm")
def cor_peak_measure(spark, sf):
    ch = chart(spark, sf)
    return rd(C.peak_measure(ch.notes(), ch.meas, ch.durations()))


@query("cor_chords", f"{STATS_SQL} SELECT item, chord_count, chord2_count, chord3plus_count FROM ch")
def cor_chords(spark, sf):
    return C.chords(chart(spark, sf).notes())


@query("cor_jacks", f"{STATS_SQL} SELECT item, jack_count FROM jk")
def cor_jacks(spark, sf):
    ch = chart(spark, sf)
    return C.jacks(ch.notes(), hot=ch.hot)


@query("cor_labels", """WITH e AS (SELECT p_partkey AS item, p_size, p_type, p_brand, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE sha256(CAST(p_partkey AS VARCHAR)) END AS sha, md5(CAST(p_partkey AS VARCHAR)) AS md FROM part),
 tb AS (SELECT 'satellite' AS "table", CASE WHEN p_partkey % 2 = 0 THEN sha256(CAST(p_partkey AS VARCHAR)) END AS sha, md5(CAST(p_partkey AS VARCHAR)) AS md, concat(CAST(p_size % 13 AS VARCHAR), CASE WHEN p_partkey % 5 = 0 THEN '?' ELSE '+' END) AS lv FROM part WHERE p_type = 'PROMO'
 UNION ALL SELECT 'insane', sha256(CAST(p_partkey AS VARCHAR)), NULL, CAST(p_size AS VARCHAR) FROM part WHERE p_brand IN ('Brand#1', 'Brand#2')),
 m AS (SELECT e.item, s."table", s.lv FROM e JOIN tb s ON e.sha = s.sha UNION ALL SELECT e.item, s."table", s.lv FROM e JOIN tb s ON e.md = s.md WHERE NOT EXISTS (SELECT 1 FROM tb x WHERE x.sha = e.sha AND x."table" = s."table"))
 SELECT item, "table", TRY_CAST(rtrim(lv, '+-') AS DOUBLE) AS level FROM m""")
def cor_labels(spark, sf):
    """Every table's level by sha, by md5 where the sha found nothing in that table; numeric value or NULL."""
    from ..functions.columns import parse_level

    p = t.table(spark, sf, "part", "p_partkey", "p_size", "p_type", "p_brand")
    k = F.col("p_partkey").cast("string")
    sha, md = F.sha2(k, 256), F.md5(k)
    e = p.select(F.col("p_partkey").alias("item"), F.when(F.col("p_partkey") % 3 != 0, sha).alias("sha"), md.alias("md"))
    tail = F.when(F.col("p_partkey") % 5 == 0, "?").otherwise("+")
    tabs = p.filter("p_type = 'PROMO'").select(F.lit("satellite").alias("table"), F.when(F.col("p_partkey") % 2 == 0, sha).alias("sha"), md.alias("md"), F.concat((F.col("p_size") % 13).cast("string"), tail).alias("lv"))
    tabs = tabs.unionByName(p.filter("p_brand in ('Brand#1', 'Brand#2')").select(F.lit("insane").alias("table"), sha.alias("sha"), F.lit(None).cast("string").alias("md"), F.col("p_size").cast("string").alias("lv")))
    by_sha = e.join(tabs.drop("md"), "sha").select("item", "table", "lv")
    by_md = e.join(tabs.drop("sha"), "md").select("item", "table", "lv").join(by_sha.select("item", "table"), ["item", "table"], "left_anti")
    return by_sha.unionByName(by_md).select("item", "table", parse_level("lv").alias("level"))


@query("cor_hash", "SELECT doc_id, md5(text) AS md5, sha256(text) AS sha256 FROM documents")
def cor_hash(spark, sf):
    return t.table(spark, sf, "documents", "doc_id", "text").select("doc_id", F.md5("text").alias("md5"), F.sha2("text", 256).alias("sha256"))


TITLE = "CASE item % 9 WHEN 0 THEN concat(title, ' [ANOTHER]') WHEN 1 THEN concat(title, ' -hyper another-') WHEN 2 THEN concat('(remix) ', title, ' LN') WHEN 3 THEN concat(title, ' ex9dan insane ex ex ex ex ex ex ex ex ex') WHEN 4 THEN concat(title, ' sarather') WHEN 5 THEN '[only]' WHEN 6 THEN concat(title, '_07') WHEN 7 THEN concat(title, '（下）トリル') ELSE title END"
PATH = "CASE WHEN item % 2 = 0 THEN concat('packs/', kind, '/a.txt') ELSE 'a.txt' END"


TOKENS = "[" + ", ".join(f"'{x}'" for x in C.SUFFIXES) + "]"


@query("cor_song_key", f"""WITH RECURSIVE {S.ITEMS}, x AS (SELECT item, regexp_replace(regexp_replace(lower({TITLE}), '[\\[（(].*?[\\]）)]', '', 'g'), '[^\\p{{L}}\\p{{N}}]+', '', 'g') AS b, regexp_replace(lower(regexp_extract({PATH}, '^(.*)/[^/]*$', 1)), '[^\\p{{L}}\\p{{N}}]+', '', 'g') AS f FROM items),
 st AS (SELECT item, b AS s FROM x UNION ALL SELECT item, left(s, length(s) - length(tk)) FROM (SELECT item, s, list_filter({TOKENS}, lambda k: suffix(s, k) AND length(s) > length(k))[1] AS tk FROM st) WHERE tk IS NOT NULL),
 e AS (SELECT item, arg_min(s, length(s)) AS b FROM st GROUP BY item)
 SELECT item, CASE WHEN e.b <> '' THEN concat('t:', e.b) ELSE concat('f:', CASE WHEN f <> '' THEN f ELSE 'unknown' END) END AS song_key FROM x JOIN e USING (item)""")
def cor_song_key(spark, sf):
    return t.items(spark, sf).select("item", C.song_key(F.expr(TITLE), F.expr(PATH)).alias("song_key"))


@query("cor_artist_key", f"WITH {HEADS}, a AS (SELECT item, arg_max(value, line_no) AS v FROM hx WHERE key = 'ARTIST' GROUP BY item) SELECT item, regexp_replace(list_filter(string_split(lower(v), '/'), lambda p: trim(p) <> '')[1], '[^\\p{{L}}\\p{{N}}]+', '', 'g') AS artist_key FROM a")
def cor_artist_key(spark, sf):
    h = chart(spark, sf).headers.filter("key = 'ARTIST'")
    return h.select("item", C.artist_key(F.col("value")).alias("artist_key"))


LINE_ISSUES = {
    "bad_bpm_header": "hx WHERE kind = 'header' AND key = 'BPM' AND TRY_CAST(value AS DOUBLE) IS NULL", "bad_bpm_def": "hx WHERE kind = 'header' AND key LIKE 'BPM__%' AND TRY_CAST(value AS DOUBLE) IS NULL",
    "bad_stop_def": "hx WHERE kind = 'header' AND key LIKE 'STOP__%' AND TRY_CAST(value AS DOUBLE) IS NULL", "bad_ch02": "cn WHERE channel = '02' AND TRY_CAST(data AS DOUBLE) IS NULL", "measure_gt_999": "cn WHERE measure > 999",
}
ISS = {"zero_bpm": "zero_bpm", "negative_bpm": "negative_bpm", "control_flow": "control_flow", "not_single_play": "player <> 1", "mgq_ln": "lntype <> 1", "unparsed_line": "n_unparsed > 0"}


@query("cor_issue_hist", f"""WITH {NOTES}, q AS (SELECT *, b = 0 AS zero_bpm, b < 0 AS negative_bpm FROM heads), {', '.join(f"i{n} AS (SELECT '{k}' AS issue, count(*) FILTER (WHERE {e}) AS n FROM q)" for n, (k, e) in enumerate(ISS.items()))}
 {' UNION ALL '.join(f'SELECT * FROM i{n}' for n in range(len(ISS)))} UNION ALL SELECT 'ln_unclosed', count(DISTINCT item) FROM lc WHERE unclosed UNION ALL SELECT 'lnobj_orphan', count(DISTINCT item) FROM t3 WHERE is_end AND depth = 0
 {' '.join(f"UNION ALL SELECT '{k}', count(DISTINCT item) FROM {src} HAVING count(*) > 0" for k, src in LINE_ISSUES.items())}
 UNION ALL SELECT concat('has_', key), count(DISTINCT item) FROM hx WHERE kind = 'header' AND key IN ('TITLE', 'ARTIST', 'LNOBJ', 'RANK') GROUP BY key""")
def cor_issue_hist(spark, sf):
    """Charts per issue kind and per present header."""
    ch = chart(spark, sf)
    flags = ch.heads.select(*[F.coalesce(F.expr(e), F.lit(False)).alias(k) for k, e in ISS.items()])
    wide = flags.agg(*[F.count(F.when(F.col(k), 1)).alias(k) for k in ISS])
    rows = wide.select(F.inline(F.array(*[F.struct(F.lit(k).alias("issue"), F.col(k).alias("n")) for k in ISS])))

    def charts(df, name):
        return df.select("item").distinct().agg(F.lit(name).alias("issue"), F.count(F.lit(1)).alias("n"))

    has = ch.headers.filter(F.col("key").isin("TITLE", "ARTIST", "LNOBJ", "RANK")).groupBy(F.concat(F.lit("has_"), "key").alias("issue")).agg(F.count(F.lit(1)).alias("n"))
    lines = C.line_issues(ch.cls, ch.chan).groupBy("issue").agg(F.count_distinct("item").alias("n"))
    return rows.unionByName(lines).unionByName(charts(ch.held.filter("unclosed"), "ln_unclosed")).unionByName(charts(ch.tap.filter("role = 'orphan'"), "lnobj_orphan")).unionByName(has)
