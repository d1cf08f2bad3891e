"""Configuration: a mapping from a YAML or JSON text becomes the small dimensions that plans broadcast."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class IndexConfig:
    """Indicators (name, pillar, direction), pillar weights, the dampener and its strength, tier cuts."""

    indicators: list[tuple[str, str, str]]
    weights: dict[str, float]
    dampener: str = "P5"
    lam: float = 0.15
    cuts: tuple[float, float, float] = (0.8, 0.5, 0.2)
    draws: int = 1000
    sigma: float = 0.2
    seed: int = 42
    names: list[str] = field(default_factory=list)

    def __post_init__(self):
        unknown = {p for _, p, _ in self.indicators} - set(self.weights) - {self.dampener}
        if unknown:
            raise ValueError(f"pillars without weight: {sorted(unknown)}")
        if not 0 <= self.lam <= 1:
            raise ValueError("lam is between 0 and 1")

    def indicator_frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.indicators, "indicator string, pillar string, direction string")

    def weight_frame(self, spark: SparkSession) -> DataFrame:
        total = sum(self.weights.values())
        return spark.createDataFrame([(p, w / total) for p, w in self.weights.items()], "pillar string, weight double")


def parse(text: str) -> dict:
    """JSON, or YAML where a YAML library is installed."""
    try:
        return json.loads(text)
    except ValueError:
        import yaml

        return yaml.safe_load(text) or {}


def load(spark: SparkSession, path: str) -> IndexConfig:
    """An IndexConfig from a JSON or YAML file, read through Spark."""
    text = "\n".join(r.value for r in spark.read.option("wholetext", True).text(path).collect())
    raw = parse(text)
    raw["indicators"] = [tuple(x) if isinstance(x, (list, tuple)) else (x["id"], x["pillar"], x.get("direction", "POSITIVE")) for x in raw["indicators"]]
    if "cuts" in raw:
        raw["cuts"] = tuple(raw["cuts"])
    return IndexConfig(**raw)
