"""Training history: iterations and coefficients of each seed as two small tables."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import HISTORY_COEF, HISTORY_ITER


@dataclass
class History:
    """Rows are (seed, iter, phase, auc, test_auc, log_lik, intercept) and (seed,
    iter, pos, concept, coef): goal rows per seed and iteration, on the driver."""

    iterations: list[tuple] = field(default_factory=list)
    coefs: list[tuple] = field(default_factory=list)

    def append(self, seed: int, phase: str, model: dict) -> int:
        n = 1 + max((r[1] for r in self.iterations if r[0] == seed), default=-1)
        self.iterations.append((seed, n, phase, model.get("auc"), model.get("test_auc"), model.get("log_lik"), float(model["intercept"])))
        self.coefs += [(seed, n, i, c, float(b)) for i, (c, b) in enumerate(zip(model["concepts"], model["coefs"], strict=True))]
        return n

    def length(self, seed: int) -> int:
        return sum(r[0] == seed for r in self.iterations)

    def last_concepts(self, seed: int) -> list[str]:
        n = self.length(seed) - 1
        return [r[3] for r in sorted(self.coefs, key=lambda r: r[2]) if r[0] == seed and r[1] == n]

    def baseline(self) -> "History":
        return History([r for r in self.iterations if r[2] == "baseline"], [r for r in self.coefs if any(i[:2] == r[:2] and i[2] == "baseline" for i in self.iterations)])

    def tables(self, spark: SparkSession) -> dict[str, DataFrame]:
        return {"history_iter": spark.createDataFrame(self.iterations, HISTORY_ITER), "history_coef": spark.createDataFrame(self.coefs, HISTORY_COEF)}

    @classmethod
    def load(cls, tables: dict[str, DataFrame]) -> "History":
        rows = lambda name: [tuple(r) for r in tables[name].orderBy("seed", "iter").collect()]
        return cls(rows("history_iter"), rows("history_coef"))


def concept_table(history_coef: DataFrame) -> DataFrame:
    """Concepts of each seed's last iteration by rising coefficient."""
    ends = history_coef.groupBy("seed").agg(F.max("iter").alias("_end"))
    return history_coef.join(F.broadcast(ends), "seed").filter("iter = _end").orderBy("seed", "coef").select("seed", "concept", "coef")
