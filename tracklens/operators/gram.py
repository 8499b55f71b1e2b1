"""Linear models from one table of cross-moments.

``gram`` sums, in one pass over the rows, the products of all columns (constant, features, label) for each set of rows and each
fold.  From these sums every subset of the columns, every fold that is left out and every ridge penalty is solved by elimination,
without touching the rows again; ``errors`` then scores all fits in one more pass.  The driver only sees the moments: (row sets x folds x
columns squared) numbers, whatever the number of rows.

A row counts for a row set when it has a label and no gap in the set's columns.  Features are standardised by the rows of the fit; a column
without spread, or one that the columns before it already explain, gets the coefficient 0.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NONE = -1  # the fold of rows without folds
DEAD = 1e-9  # a pivot below this share of the rows is no new direction


def gram(df: DataFrame, cols: list[str], label: str, row_sets: list[list[str]], fold: str | None = None) -> DataFrame:
    """(rows, fold, i, j, s): the sum of column i times column j (i <= j) over the rows of a set; 0 is the constant, the last one the label."""
    needs = [[cols.index(c) for c in own] for own in row_sets]
    fields = [("rows", pa.int32()), ("fold", pa.int64()), ("i", pa.int32()), ("j", pa.int32()), ("s", pa.float64())]
    i, j = np.triu_indices(len(cols) + 2)

    def run(batches):
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            values = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns[1:]])
            folds, gap = batch.column(0).to_numpy(), np.isnan(values)
            values = np.column_stack([np.ones(len(values)), np.where(gap, 0.0, values)])
            for k, need in enumerate(needs):
                whole = ~gap[:, [*need, len(cols)]].any(axis=1)
                for f in np.unique(folds[whole]):
                    part = values[whole & (folds == f)]
                    key = k, int(f)
                    sums[key] = sums.get(key, 0.0) + part.T @ part
        for (k, f), s in sums.items():
            n = len(i)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, k), pa.int32()), pa.array(np.full(n, f)), pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(s[i, j])], names=[x for x, _ in fields])

    number = F.lit(NONE) if fold is None else F.coalesce(F.col(fold), F.lit(NONE))
    slim = df.select(number.cast("long").alias("_fold"), *[F.col(c).cast("double").alias(f"_c{k}") for k, c in enumerate([*cols, label])])
    parts = slim.mapInArrow(run, "rows int, fold long, i int, j int, s double")
    return parts.groupBy("rows", "fold", "i", "j").agg(F.sum("s").alias("s"))


@dataclass
class Fit:
    """label = intercept + sum of beta times column, for rows that have all of ``need``."""

    intercept: float
    beta: dict[str, float]
    need: list[str]

    def column(self) -> Column:
        return sum((F.col(c).cast("double") * b for c, b in self.beta.items() if b), F.lit(self.intercept))


class Moments:
    """The collected sums of ``gram`` and the fits that follow from them."""

    def __init__(self, df: DataFrame, cols: list[str], label: str, row_sets: list[list[str]], fold: str | None = None):
        self.cols, self.row_sets = cols, row_sets
        self.sums: dict[tuple[int, int], np.ndarray] = {}
        for x in gram(df, cols, label, row_sets, fold).collect():  # bounded by the settings
            m = self.sums.setdefault((x.rows, x.fold), np.zeros((len(cols) + 2, len(cols) + 2)))
            m[x.i, x.j] = m[x.j, x.i] = x.s

    def fit(self, subset: list[str], need: list[str] | None = None, alpha: float = 0.0, without: int | None = None) -> Fit:
        """Least squares on ``subset`` over the rows that are whole in ``need``, with the penalty alpha on standardised coefficients; fold ``without`` is left out."""
        need = subset if need is None else need
        parts = [m for (k, f), m in self.sums.items() if self.row_sets[k] == need and f != without]
        if not parts:
            return Fit(0.0, {}, need)
        s = sum(parts)
        n, at = s[0, 0], [1 + self.cols.index(c) for c in subset]
        mean = s[0, at] / n
        spread = s[at, at] / n - mean**2
        scale = np.where(spread > 1e-12 * np.maximum(1, s[at, at] / n), np.sqrt(np.maximum(spread, 0)), np.inf)
        a = (s[np.ix_(at, at)] - n * np.outer(mean, mean)) / np.outer(scale, scale)
        b = (s[at, -1] - mean * s[0, -1]) / scale
        beta = solved(a + alpha * np.eye(len(at)), b, DEAD * n) / scale
        return Fit(float(s[0, -1] / n - beta @ mean), dict(zip(subset, beta.tolist())), need)


def solved(a: np.ndarray, b: np.ndarray, dead: float) -> np.ndarray:
    """Gauss-Jordan elimination of a symmetric system in the order of its rows; a row with a pivot at or below ``dead`` gets 0."""
    m = np.column_stack([a, b]).astype(float)
    for k in range(len(m)):
        if m[k, k] <= dead:
            m[k] = 0
            continue
        m[k] /= m[k, k]
        others = np.arange(len(m)) != k
        m[others] -= np.outer(m[others, k], m[k])
    return m[:, -1]


def errors(df: DataFrame, label: str, fits: dict[str, Fit], only: dict[str, Column] | None = None, group: str | None = None) -> dict[str, dict]:
    """n, mae, rmse, r2 of every fit over the rows it can judge (``only``: a further condition), all in one pass; with ``group``
    also cr2, the share of the squared deviations from the group's mean label that is explained."""
    y, marks, names = F.col(label).cast("double"), {}, list(fits)
    for k, name in enumerate(names):
        ok = y.isNotNull()
        for c in fits[name].need:
            ok = ok & F.col(c).isNotNull()
        if only and name in only:
            ok = ok & only[name]
        marks[f"_e{k}"] = F.when(ok, y - fits[name].column())
    rows = df.select(*([group] if group else []), y.alias("_y"), *[e.alias(c) for c, e in marks.items()])
    sums = [f for c in marks for f in (
        F.count(c).alias(f"n{c}"), F.coalesce(F.sum(F.abs(c)), F.lit(0.0)).alias(f"a{c}"), F.coalesce(F.sum(F.col(c) * F.col(c)), F.lit(0.0)).alias(f"q{c}"),
        F.sum(F.when(F.col(c).isNotNull(), F.col("_y"))).alias(f"y{c}"), F.sum(F.when(F.col(c).isNotNull(), F.col("_y") * F.col("_y"))).alias(f"z{c}"),
    )]
    if group:  # sums by group first; squares within the groups add up
        by = rows.groupBy(group).agg(*sums)
        rows = by.select("*", *[F.when(F.col(f"n{c}") > 0, F.col(f"z{c}") - F.col(f"y{c}") * F.col(f"y{c}") / F.col(f"n{c}")).alias(f"w{c}") for c in marks])
        s = rows.agg(*[F.sum(f"{p}{c}").alias(f"{p}{c}") for c in marks for p in "naqyzw"]).first()
    else:
        s = rows.agg(*sums).first()
    out = {}
    for k, name in enumerate(names):
        n, a, q, total, square = (s[f"{p}_e{k}"] for p in "naqyz")
        spread = square - total * total / n if n else 0.0
        out[name] = {"n": n or 0, "mae": a / n if n else None, "rmse": (q / n) ** 0.5 if n else None, "r2": 1 - q / spread if spread > 0 else None}
        if group:
            out[name]["cr2"] = 1 - q / s[f"w_e{k}"] if n and s[f"w_e{k}"] > 0 else None
    return out
