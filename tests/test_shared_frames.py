"""Frames that a query reads several times: the log is joined and ranked once."""

from tracklens.plans import load_all
from tracklens.plans import metrics, models, scoring
from tracklens.sources import tables

SF = "/root/testdata/sf0.001"


def test_predictions_do_not_read_the_log_again(spark):
    load_all()
    assert not [f for f in metrics.pr(spark, SF).inputFiles() if "lineitem" in f or "orders" in f]


def test_control_rows_do_not_read_the_log_again(spark):
    load_all()
    assert not [f for d in metrics.control_rows(spark, SF) for f in d.inputFiles() if "lineitem" in f or "orders" in f]


def test_both_parts_of_the_matrix_are_one_table(spark):
    load_all()
    train, test = models.matrix(spark, SF)
    assert set(train.inputFiles()) == set(test.inputFiles())


def test_notes_keep_their_number_of_parts(spark, monkeypatch):
    load_all()
    monkeypatch.setattr(tables, "NOTES_A_TASK", 100)  # 1,000 rows
    assert "REPARTITION_BY_NUM" in tables.notes(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert tables.notes(spark, SF).rdd.getNumPartitions() == 10


def test_future_rows_do_not_read_the_log_again(spark):
    load_all()
    assert not [f for f in scoring.future_features(spark, SF).inputFiles() if "lineitem" in f or "orders" in f]
