"""Rows dealt to the fit and to the calibration of the bands."""

import pytest
from pyspark.sql import functions as F

from tracklens.operators import causal, skew
from tracklens.plans import bands
from tracklens.sources import tables as t


@pytest.mark.parametrize("hot_rows", [None, 20])
def test_fit_rows_are_the_first_four_fifths_of_the_train_rows(spark, monkeypatch, hot_rows):
    written, real = [], bands.cut
    monkeypatch.setattr(bands, "cut", lambda d: written.append(d.columns) or real(d))
    fp = spark.range(400).select(F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") % 23).alias("player"), F.col("id").alias("item"), (F.col("id") * 7 % 90).alias("ts"),
                                 (F.col("id") * 11 % 17).alias("seq"), F.lit(50.0).alias("acc"), F.lit(3).alias("lamp"), F.lit(1).alias("bp"), F.lit(9).alias("notes"))
    hot = None if hot_rows is None else skew.probe(fp, ["player"], "ts", hot_rows)
    assert hot_rows is None or hot is not None
    rows = bands.dealt(causal.phase(causal.history(fp, t.FP_ORDER, hot), hot), hot).collect()
    assert len(written) == (1 if hot is None else 2)  # before: the whole history, then the train rows again
    got = {(r.player, r.item): (r.phase, r.is_fit) for r in rows}
    own = {}
    for r in causal.phase(fp).collect():
        own.setdefault(r.player, []).append(r)
    want = {}
    for player, of in own.items():
        train = sorted((r.ts, r.seq, r.item) for r in of if r.phase == "train")
        fit = {x[2] for x in train[: max(1, int(0.8 * len(train)))]}
        want |= {(player, r.item): (r.phase, r.item in fit) for r in of if r.phase != "history"}
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    assert all(got[k][1] == v[1] for k, v in want.items() if v[0] == "train")
