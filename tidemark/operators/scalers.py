"""Scaling that is fitted once, saved, and applied to other tables.

A Scaler is an ML estimator: fit() gives a ScalerModel, a table of factors with a row for each combination of the key columns, which transform() joins to any table. A
model is saved as Parquet beside its settings, and loaded again without the data it was fitted on.
"""

from __future__ import annotations

import json

from pyspark.ml import Estimator, Model
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class ScalerModel(Model):
    """Factors (keys, and of each column low, high, shift, scale) of a fitted Scaler."""

    def __init__(self, factors: DataFrame, keys: list[str], columns: list[str]):
        super().__init__()
        self.factors, self.keys, self.columns = factors, keys, columns

    def _placed(self, dataset: DataFrame) -> DataFrame:
        """Rows whose keys the model has not seen stay, with null factors. Factors are one row a key and are joined as Spark sees fit."""
        return dataset.join(self.factors, self.keys, "left") if self.keys else dataset.crossJoin(self.factors)  # one row

    def _transform(self, dataset: DataFrame) -> DataFrame:
        """The dataset with its columns trimmed, shifted and scaled; null where the model has no factors, 0 where a column does not vary."""

        def scaled(c: str) -> Column:
            x = F.least(F.greatest(F.col(c).cast("double"), F.col(f"_low_{c}")), F.col(f"_high_{c}"))
            x = F.when(F.col(c).isNotNull() & F.col(f"_scale_{c}").isNotNull(), x)
            return F.when(F.col(f"_scale_{c}") == 0, x * 0).otherwise((x - F.col(f"_shift_{c}")) / F.when(F.col(f"_scale_{c}") != 0, F.col(f"_scale_{c}"))).alias(c)

        return self._placed(dataset).select(*(scaled(c) if c in self.columns else F.col(c) for c in dataset.columns))

    def inverse(self, dataset: DataFrame) -> DataFrame:
        """The dataset with its scaled columns turned back; what was trimmed stays trimmed."""
        back = lambda c: (F.col(c) * F.col(f"_scale_{c}") + F.col(f"_shift_{c}")).alias(c)
        return self._placed(dataset).select(*(back(c) if c in self.columns else F.col(c) for c in dataset.columns))

    def save(self, path: str) -> None:
        spark = self.factors.sparkSession
        self.factors.write.mode("overwrite").parquet(f"{path}/factors")
        spark.createDataFrame([(json.dumps({"keys": self.keys, "columns": self.columns}),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/settings")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> ScalerModel:
        settings = json.loads(spark.read.text(f"{path}/settings").first()["value"])
        return cls(spark.read.parquet(f"{path}/factors"), settings["keys"], settings["columns"])


class Scaler(Estimator):
    """kind "range": lowest to -1 and highest to 1; "centre": less the mean, over the mean distance from it. trim: values beyond these quantiles (a share
    at either end, by mergeable sketches) count as the quantile, when fitting and when applied. Nulls are left out."""

    def __init__(self, keys: list[str], columns: list[str], kind: str = "range", trim: float = 0.0, accuracy: int = 10_000):
        super().__init__()
        if kind not in ("range", "centre"):
            raise ValueError(f"no scaling {kind}")
        self.keys, self.columns, self.kind, self.trim, self.accuracy = keys, columns, kind, trim, accuracy

    def _fit(self, dataset: DataFrame) -> ScalerModel:
        ends = []
        for c in self.columns:
            x = F.col(c).cast("double")
            low, high = (F.min(x), F.max(x)) if not self.trim else (F.percentile_approx(x, self.trim, self.accuracy), F.percentile_approx(x, 1 - self.trim, self.accuracy))
            ends += [low.alias(f"_low_{c}"), high.alias(f"_high_{c}")]
        bounds = dataset.groupBy(*self.keys).agg(*ends)
        if self.kind == "range":
            return ScalerModel(bounds.select(*bounds.columns, *(x for c in self.columns for x in (((F.col(f"_low_{c}") + F.col(f"_high_{c}")) / 2).alias(f"_shift_{c}"), ((F.col(f"_high_{c}") - F.col(f"_low_{c}")) / 2).alias(f"_scale_{c}")))), self.keys, self.columns)
        beside = lambda t: dataset.join(t, self.keys) if self.keys else dataset.crossJoin(t)  # noqa: E731  one row without keys
        trimmed = lambda c: F.least(F.greatest(F.col(c).cast("double"), F.col(f"_low_{c}")), F.col(f"_high_{c}"))
        valued = lambda c, x: F.when(F.col(c).isNotNull(), x)
        firsts = [F.first(b).alias(b) for b in bounds.columns if b not in self.keys]
        means = beside(bounds).groupBy(*self.keys).agg(*firsts, *(F.avg(valued(c, trimmed(c))).alias(f"_shift_{c}") for c in self.columns))
        firsts = [F.first(b).alias(b) for b in means.columns if b not in self.keys]
        spread = beside(means).groupBy(*self.keys).agg(*firsts, *(F.avg(valued(c, F.abs(trimmed(c) - F.col(f"_shift_{c}")))).alias(f"_scale_{c}") for c in self.columns))
        return ScalerModel(spread, self.keys, self.columns)
