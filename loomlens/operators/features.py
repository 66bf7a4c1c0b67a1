"""Feature tables: stored scaling of controls, tabular concepts, ranked coefficients."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


TABULAR = "Tabular feature: "


@dataclass(frozen=True)
class Scaler:
    """Means and population deviations of control columns, fitted once on training
    rows and stored; a constant column is only centred."""

    mean: dict[str, float]
    std: dict[str, float]

    @classmethod
    def fit(cls, df: DataFrame, columns: list[str]) -> "Scaler":
        row = df.agg(*(F.avg(c).alias(f"m_{c}") for c in columns), *(F.stddev_pop(c).alias(f"s_{c}") for c in columns)).first()
        return cls({c: float(row[f"m_{c}"] or 0.0) for c in columns}, {c: float(row[f"s_{c}"] or 0.0) or 1.0 for c in columns})

    def scaled(self, column: str) -> Column:
        """The column's scaled value; null is the mean."""
        return F.coalesce((F.col(column).cast("double") - self.mean[column]) / self.std[column], F.lit(0.0))

    def apply(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: (F.col(c) - self.mean[c]) / self.std[c] for c in self.mean})

    def dump(self) -> str:
        return json.dumps({"mean": self.mean, "std": self.std})

    @classmethod
    def load(cls, text: str) -> "Scaler":
        return cls(**json.loads(text))


def is_tabular(concept: Column) -> Column:
    return concept.startswith(TABULAR)


def tabular_answers(notes: DataFrame, concepts: list[dict], key: str = "obs_id", scaler: Scaler | None = None) -> DataFrame:
    """(key, concept_id, answer): concepts named after a column are read from it; null is
    0. With a scaler, values are scaled by it (null: the mean)."""
    own = [c for c in concepts if c["concept"].startswith(TABULAR)]
    missing = sorted({c["concept"].removeprefix(TABULAR) for c in own} - set(notes.columns))
    if missing:
        raise ValueError(f"missing columns: {missing}")
    value = lambda name: scaler.scaled(name) if scaler else F.coalesce(F.col(name).cast("double"), F.lit(0.0))
    made = [F.struct(F.lit(c["concept_id"]).alias("concept_id"), value(c["concept"].removeprefix(TABULAR)).alias("answer")) for c in own]
    if not made:
        return notes.sparkSession.createDataFrame([], f"{key} long, concept_id int, answer double")
    return notes.select(key, F.inline(F.array(*made)))


def feature_table(matrix: DataFrame, concepts: list[str], controls: list[str] | None = None, scaler: Scaler | None = None, key: str = "obs_id") -> DataFrame:
    """Controls first (scaled with stored values), then concepts in their order."""
    controls = controls or []
    missing = sorted(set([*controls, *concepts]) - set(matrix.columns))
    if missing:
        raise ValueError(f"missing columns: {missing}")
    rows = scaler.apply(matrix) if scaler else matrix
    return rows.select(key, *controls, *concepts)


def ranked_coefficients(matrix: DataFrame, concepts: list[str], weight: str | None = None) -> DataFrame:
    """All concepts of a model fitted together (l2, C by folds), by falling size.
    matrix: fold, y and a column per concept."""
    from .select import final_fit

    weighted = matrix.withColumn("sample_weight", F.col(weight) if weight else F.lit(1.0))
    beta = final_fit(weighted, concepts, "l2")["coefs"]
    order = sorted(range(len(concepts)), key=lambda i: (-abs(beta[i]), concepts[i]))
    rows = [(r + 1, concepts[i], float(beta[i]), abs(float(beta[i]))) for r, i in enumerate(order)]
    return matrix.sparkSession.createDataFrame(rows, "rank int, concept string, coef double, abs_coef double")
