"""Engine settings as one validated object, and the engine they describe."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import SparkSession

from .engine import Engine
from .functions.analysis import ANALYZERS
from .operators.filters import FILTERS, make_filter
from .operators.scoring import BM25, TFIDF, RankProfile

INDEXES = ("flat", "radix", "hamt")
SCORERS = ("none", "bm25", "tfidf")


@dataclass(frozen=True)
class EngineConfig:
    """index names in-memory layouts elsewhere; all are the one DataFrame layout here."""

    analyzer: str = "default"
    index: str = "flat"
    scorer: str = "bm25"
    k1: float = 1.2
    b: float = 0.75
    filter: str = "none"
    filter_items: int = 1_000_000
    field_weights: dict[str, float] = field(default_factory=dict)
    type_weights: dict[str, float] = field(default_factory=dict)
    multi_field: bool = True
    compaction_limit: float = 0.0

    def __post_init__(self):
        for name, value, allowed in (("analyzer", self.analyzer, ANALYZERS), ("index", self.index, INDEXES), ("scorer", self.scorer, SCORERS), ("filter", self.filter, ("none", *FILTERS))):
            if value not in allowed:
                raise ValueError(f"{name} {value!r} is not one of {', '.join(sorted(allowed))}")
        if self.k1 < 0 or not 0 <= self.b <= 1 or self.filter_items < 1 or not 0 <= self.compaction_limit <= 1:
            raise ValueError("k1, b, filter_items or compaction_limit is out of range")

    def engine(self, spark: SparkSession) -> Engine:
        scorer = {"none": None, "bm25": BM25(self.k1, self.b), "tfidf": TFIDF()}[self.scorer]
        if scorer and (self.field_weights or self.type_weights):
            scorer = RankProfile(scorer, self.field_weights, self.type_weights)
        return Engine(spark, self.analyzer, scorer, self.multi_field, filter=make_filter(self.filter, self.filter_items), compaction_limit=self.compaction_limit)
