"""Scorers: each gives a Column for rows with field, query_type, tf, df, dl, n_docs, avg_len."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

Scorer = Callable[[], Column]


def _some() -> Column:
    return (F.col("df") > 0) & (F.col("n_docs") > 0) & (F.col("tf") > 0)


@dataclass(frozen=True)
class BM25:
    k1: float = 1.2
    b: float = 0.75

    def __call__(self) -> Column:
        k1 = self.k1 if self.k1 > 0 else 1.2
        b = self.b if 0 <= self.b <= 1 else 0.75
        n, df, tf = F.col("n_docs"), F.col("df"), F.col("tf")
        idf = F.log1p(F.exp(F.ln(F.greatest(n - df + 0.5, F.lit(1e-9))) - F.ln(df + 0.5)))
        norm = F.when(F.col("avg_len") > 0, 1 - b + b * F.col("dl") / F.col("avg_len")).otherwise(1.0)
        return F.when(_some(), idf * tf * (k1 + 1) / (tf + k1 * norm)).otherwise(0.0)


@dataclass(frozen=True)
class TFIDF:
    def __call__(self) -> Column:
        return F.when(_some(), F.col("tf") * F.greatest(F.lit(0.0), F.ln(F.col("n_docs") / F.col("df")))).otherwise(0.0)


@dataclass(frozen=True)
class RankProfile:
    """base x weight of the field x weight of the query type (term, phrase, prefix). A field without a weight has default_weight (0: 1); a field weight of 0 holds; a type weight of 0 is 1."""

    base: Scorer | None = None
    fields: dict[str, float] = field(default_factory=dict)
    types: dict[str, float] = field(default_factory=dict)
    default_weight: float = 1.0

    def field_weight(self) -> Column:
        out = F.lit(float(self.default_weight or 1.0))
        for name, w in self.fields.items():
            out = F.when(F.col("field") == name, F.lit(float(w))).otherwise(out)
        return out

    def type_weight(self) -> Column:
        out = F.lit(1.0)
        for name, w in self.types.items():
            out = F.when(F.col("query_type") == name, F.lit(float(w or 1.0))).otherwise(out)
        return out

    def base_score(self) -> Column:
        return self.base() if self.base else F.lit(0.0)

    def __call__(self) -> Column:
        return self.base_score() * self.field_weight() * self.type_weight() if self.base else F.lit(0.0)


def parts(scorer: Scorer | None) -> dict[str, Column]:
    """base, field_weight, type_weight and score of a scorer."""
    if scorer is None:
        zero = F.lit(0.0)
        return {"base": zero, "field_weight": F.lit(1.0), "type_weight": F.lit(1.0), "score": zero}
    if isinstance(scorer, RankProfile):
        return {"base": scorer.base_score(), "field_weight": scorer.field_weight(), "type_weight": scorer.type_weight(), "score": scorer()}
    return {"base": scorer(), "field_weight": F.lit(1.0), "type_weight": F.lit(1.0), "score": scorer()}
