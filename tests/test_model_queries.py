"""The held-out groups of the model queries, with the fits replaced by a constant."""

import os

import pytest
from pyspark.sql import functions as F

from tracklens.plans import transfer

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")


def test_every_client_and_size_of_the_data_is_judged(spark, monkeypatch):
    names = [f"{m}_{h}" for m in transfer.MODELS for h in transfer.HEADS]
    monkeypatch.setattr(transfer.T, "unseen_players", lambda rows, targets, *args: targets.withColumns({n: F.lit(50.0) for n in names}))
    real = transfer.t.clients
    monkeypatch.setattr(transfer.t, "clients", lambda *a: real(*a).withColumn("client", F.when(F.col("client") == "BUILDING", "NEW").otherwise(F.col("client"))))
    got = {(x.client, x.k): x.n_eval for x in transfer.mdl_transfer(spark, SF).collect()}
    clients = {c for c, _ in got}
    assert "NEW" in clients and "BUILDING" not in clients and all(n > 0 for n in got.values())
    for k in {k for _, k in got}:
        assert got["all", k] == sum(n for (c, s), n in got.items() if s == k and c != "all")
