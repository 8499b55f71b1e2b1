"""Quantile heads and their split calibration: fit on the first four fifths of each player's train rows, calibrate on the rest, judge on the test phase.

The heads predict bad hits a note.  The accuracy of the given tables is drawn without regard to any feature, so no head can be better
than the constant band there.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.columns import r
from ..operators import causal, metrics as M, quantile
from ..session import cut
from ..sources import tables as t
from . import sqlparts as S
from .linear import CORE
from .models import KEY
from .registry import query

QS = [0.1, 0.9]
LEVEL = 0.8

BANDS = f"""{S.SAMPLES}, ct AS (SELECT player, quantile_cont(ts, 0.5) AS t1, quantile_cont(ts, 0.75) AS t2 FROM smp GROUP BY player),
 ph AS (SELECT player, item, bp / notes AS ratio, ts, seq, ts > t2 AS is_test FROM smp JOIN ct USING (player) WHERE ts > t1), te AS (SELECT * FROM ph WHERE is_test),
 tr AS (SELECT *, row_number() OVER (PARTITION BY player ORDER BY ts, seq, item) <= greatest(1, floor(0.8 * count(*) OVER (PARTITION BY player))) AS is_fit FROM ph WHERE NOT is_test)"""


def dealt(h, hot):
    """Train and test rows of the history, written once; ``is_fit``: one of the first four fifths of the player's train rows (at least one).

    The train rows follow one another in the player's history, so a row's place among them is its place there less the rows before them."""
    n = {"_before": F.count(F.when((F.col("phase") == "history") | F.col("ts").isNull(), 1)), "_n": F.count(F.when(F.col("phase") == "train", 1))}
    if hot is None:
        h = h.withColumns({k: c.over(W.partitionBy("player")) for k, c in n.items()})
    else:
        h = cut(h)
        h = h.join(h.groupBy("player").agg(*[c.alias(k) for k, c in n.items()]), "player")
    fit = F.col("h_n_firstplays") - F.col("_before") < F.greatest(F.lit(1), F.floor(F.lit(0.8) * F.col("_n")))
    return cut(h.filter("phase <> 'history'").withColumn("is_fit", fit).drop("_before", "_n", "ts"))


def judged(spark, sf):
    """(calibration rows, test rows) with the band lo, hi; and the heads."""
    fp, hot = t.samples(spark, sf), t.hot(spark, sf, "player")
    h = causal.phase(causal.history(fp, t.FP_ORDER, hot), hot).select(*KEY, "ts", (F.col("bp") / F.col("notes")).alias("ratio"), "phase", *CORE)
    rows = dealt(h, hot)
    train, test = rows.filter("phase = 'train'"), rows.filter("phase = 'test'")
    heads = quantile.Heads(train.filter("is_fit"), CORE, "ratio", QS)
    put = lambda d: heads.predict(d.withColumn("y", F.col("ratio").cast("double")), ["lo", "hi"]).select(*KEY, "y", "lo", "hi")
    return put(train.filter("not is_fit")), put(test), heads


@query("mdl_quantile_band", f"""WITH {BANDS}, h AS (SELECT unnest([0.1, 0.9])::DOUBLE AS q), c AS (SELECT q, CASE q WHEN 0.1::DOUBLE THEN quantile_cont(ratio, 0.1) ELSE quantile_cont(ratio, 0.9) END AS v FROM tr, h WHERE is_fit GROUP BY q)
 SELECT q, count(*) AS n, round(avg(greatest(q * (ratio - v), (q - 1) * (ratio - v))), 4) AS pinball_constant, TRUE AS heads_are_better FROM te, c GROUP BY q""")
def mdl_quantile_band(spark, sf):
    """Pinball loss of the constant band on the test rows, and whether the boosted heads' loss is lower."""
    _, test, heads = judged(spark, sf)
    y, rows = F.col("y"), []
    aggs = [F.count("y").alias("n")]
    for k, (q, name) in enumerate(zip(QS, ("lo", "hi"))):
        aggs += [F.avg(quantile.pinball(y, F.lit(heads.start[k]), q)).alias(f"c{k}"), F.avg(quantile.pinball(y, F.col(name), q)).alias(f"h{k}")]
        rows.append(F.struct(F.lit(q).alias("q"), F.col("n"), r(f"c{k}", 4).alias("pinball_constant"), (F.col(f"h{k}") < F.col(f"c{k}")).alias("heads_are_better")))
    return test.agg(*aggs).select(F.inline(F.array(*rows)))


@query("evl_conformal", f"""WITH {BANDS} SELECT (SELECT count(*) FROM tr WHERE NOT is_fit) AS n_cal, (SELECT count(*) FROM te) AS n_test, 0.8::DOUBLE AS nominal, TRUE AS within_2_points""")
def evl_conformal(spark, sf):
    """The heads' band, widened by the calibration rows' quantile: whether its coverage of the test rows is within 2 points of nominal."""
    cal, test, _ = judged(spark, sf)
    cal, test = cut(cal), cut(test)  # each is read twice or more
    c = M.conformal(cal, test, level=LEVEL).select("coverage")
    counts = cal.agg(F.count(F.lit(1)).alias("n_cal")).crossJoin(test.agg(F.count(F.lit(1)).alias("n_test"))).crossJoin(c)  # one row each
    return counts.select("n_cal", "n_test", F.lit(LEVEL).alias("nominal"), (F.abs(F.col("coverage") - LEVEL) <= 0.02).alias("within_2_points"))
