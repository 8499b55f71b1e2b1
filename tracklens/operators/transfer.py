"""Players that a model has not seen: nested prefixes of their first plays, folds of whole players, boosted heads by fold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from . import boost, ranks

PREFIXES = [0, 1, 5, 10, 20, 50, 100, 200]
TARGETS = 150  # rows right after a prefix that it is judged on
HIST = ["h_n_firstplays", "h_acc_mean", "h_acc_std", "h_fail_rate", "h_bp_mean", "h_days_span"]


def prefix_state(first: DataFrame, sizes: list[int] = PREFIXES) -> DataFrame:
    """One row for each (player, k): history features of the player's first ``k`` rows, all sizes from one aggregate.

    ``first`` has ``_rk``, the row's place in its player's time line; rows past the last size are not needed.  Sizes that leave fewer than two rows
    are left out, as are those of players with fewer rows.  Unknown outcomes count as rows but enter no mean.
    """
    aggs = []
    for k in sizes:
        own = F.when(F.col("_rk") <= k, F.col("acc"))
        row = F.col("_rk") <= k
        aggs += [F.struct(
            F.lit(k).alias("k"), F.count(F.when(row, 1)).cast("double").alias("h_n_firstplays"), F.avg(own).alias("h_acc_mean"),
            F.when(F.count(own) > 1, F.stddev_pop(own)).alias("h_acc_std"), F.avg(F.when(row, (F.col("lamp") == 1).cast("double"))).alias("h_fail_rate"),
            F.avg(F.when(row, F.col("bp").cast("double"))).alias("h_bp_mean"), F.min(F.when(row, F.col("ts"))).alias("_t0"),
        ).alias(f"s{k}")]
    wide = first.groupBy("player").agg(F.max("_rk").alias("_n"), *aggs)
    return wide.select("player", "_n", F.explode(F.array(*[f"s{k}" for k in sizes])).alias("s")).select("player", "_n", "s.*").filter("k < _n - 1").drop("_n")


def few_shot(fp: DataFrame, order: list[str], sizes: list[int] = PREFIXES, targets: int = TARGETS) -> DataFrame:
    """Target rows of every prefix size with the history features of the prefix alone, in place of their own.

    A row is a target of each size k with k < place <= k + ``targets``.  Only the first max(sizes) + ``targets`` rows of a player are read
    (the rank filter prunes them before the shuffle), so a player with very many rows costs no more than any other.
    """
    first = cut(ranks.top_n(fp, ["player"], order, max(sizes) + targets, "_rk"))
    state = prefix_state(first, sizes)
    near = F.filter(F.array(*[F.lit(k) for k in sizes]), lambda k: (k < F.col("_rk")) & (F.col("_rk") <= k + targets))
    rows = first.drop(*HIST).withColumn("k", F.explode(near))
    return rows.join(state, ["player", "k"]).withColumn("h_days_span", (F.col("ts") - F.col("_t0")) / 86400.0).drop("_t0", "_rk")


def unseen_players(rows: DataFrame, targets: DataFrame, fold: str, folds: int, heads: dict[str, tuple], models: dict[str, tuple[list[str], bool]], rounds: int) -> DataFrame:
    """``targets`` with a prediction ``<model>_<head>`` of every model and head, fitted on ``rows`` of the other folds only.

    ``fold`` numbers folds of whole players, so no model sees a row of a player that it predicts, and the number of fits does not grow with the players.
    ``heads``: name to (label, to, back) with column functions for a transformed target.  ``models``: name to (feature columns, impute).
    All folds and heads of a model grow side by side; one fit serves the targets of every prefix size of its fold.  Rows with gaps in columns that are not imputed are left out.
    """
    whole = sorted({c for cols, impute in models.values() if not impute for c in cols})
    rows, pred = rows.dropna(subset=whole), targets.dropna(subset=whole)
    labels = {f"_y_{head}": to(F.col(label).cast("double")) for head, (label, to, _) in heads.items()}
    made, every = [], sorted({c for cols, _ in models.values() for c in cols})
    found = boost.edges(rows, every, fold, list(range(folds)))
    for name, (cols, _) in models.items():
        own = [boost.Model(k, j, list(range(len(cols)))) for k in range(folds) for j in range(len(heads))]
        edge = {k: [e[every.index(c)] for c in cols] for k, e in found.items()}
        boost.fit(rows.withColumns(labels), cols, list(labels), own, rounds, fold, edge)
        pred = pred.withColumn(f"_p_{name}", boost.predictions(cols, own, edge, F.col(fold)))
        for j, (head, (_, _, back)) in enumerate(heads.items()):
            # the models of the other folds are NULL
            made.append(back(F.coalesce(*[F.col(f"_p_{name}.p{k * len(heads) + j}") for k in range(folds)])).alias(f"{name}_{head}"))
    return pred.select(*targets.columns, *made)


def error_curve(pred: DataFrame, group: str, heads: dict[str, str], models: list[str]) -> DataFrame:
    """MAE of every model and head by size and group, and by size alone (group 'all'), which weighs the groups by their rows."""
    cols = [(f"{m}_{h}", F.abs(F.col(label) - F.col(f"{m}_{h}"))) for h, label in heads.items() for m in models]
    # one row for each size, group and player first, so that neither grouping set repeats the predictions
    per = pred.groupBy("k", F.coalesce(F.col(group), F.lit("unknown")).alias(group), "player").agg(
        F.count(F.lit(1)).alias("_n"), *[f(e).alias(f"{t}_{c}") for c, e in cols for t, f in (("_s", F.sum), ("_c", F.count))])
    errs = [(F.sum(f"_s_{c}") / F.nullif(F.sum(f"_c_{c}"), F.lit(0))).alias(c) for c, _ in cols]
    return (per.groupingSets([[F.col("k"), F.col(group)], [F.col("k")]], F.col("k"), F.col(group))
            .agg(F.sum("_n").alias("n_eval"), F.countDistinct("player").alias("n_players"), *errs)
            .withColumn(group, F.coalesce(F.col(group), F.lit("all"))))
