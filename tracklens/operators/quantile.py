"""Quantile heads: stage-wise boosting with the pinball loss.

Every head starts at the quantile of the labels.  A round fits a small tree to the sign of the residuals (the gradient of the pinball
loss), replaces the leaves' means by the exact quantile of the residuals in the leaf, and adds a share of it.  All heads grow side by side
(``boost``): a level of their trees is one pass over blocks of bins, the leaves of all heads share a few more; the driver holds the trees.

Gaps in the features get the median of the rows of the fit; rows without a label are left out of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import boost


def pinball(y: Column, p: Column, q: float) -> Column:
    return F.greatest(q * (y - p), (q - 1) * (y - p))


class Heads:
    """One boosted model for each quantile of ``qs``.  ``train`` is read three times."""

    def __init__(self, train: DataFrame, feats: list[str], label: str, qs: list[float], rounds: int = 12, step: float = 0.3, depth: int = 3):
        self.feats, self.qs = feats, qs
        self.models = [boost.Model(0, 0, list(range(len(feats))), step, depth, min_rows=20, q=q) for q in qs]
        self.edge = boost.fit(train.filter(F.col(label).isNotNull()), feats, [label], self.models, rounds)
        self.start = [m.start for m in self.models]

    def predict(self, df: DataFrame, names: list[str]) -> DataFrame:
        """``df`` with one column for each quantile."""
        out = df.withColumn("_p", boost.predictions(self.feats, self.models, self.edge))
        return out.select(*df.columns, *[F.col(f"_p.p{k}").alias(name) for k, name in enumerate(names)])
