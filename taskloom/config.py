"""Measurement and cohort configuration."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taskloom.functions import patterns as P


@dataclass(frozen=True)
class CrossCut:
    """A set of slices. Without ``field`` it is one slice over all rows."""

    name: str
    field: str | None = None
    values: tuple[str, ...] = ()
    min_n: int = 3


DEFAULT_CUTS = (
    CrossCut("overall"),
    CrossCut("complexity", "complexity", tuple(P.TESTED_COMPLEXITIES)),
)


@dataclass(frozen=True)
class Measurements:
    """Which fields are tested, in which slices."""

    categorical: tuple[str, ...] = tuple(P.CATEGORICAL_FIELDS)
    continuous: tuple[str, ...] = tuple(P.CONTINUOUS_FIELDS)
    proportions: dict[str, tuple[str, str]] = field(default_factory=lambda: dict(P.PROPORTION_FIELDS))
    cross_cuts: tuple[CrossCut, ...] = DEFAULT_CUTS
    themes: dict[str, tuple[str, ...]] = field(default_factory=dict)
    alpha: float = 0.05

    @staticmethod
    def from_dict(spec: dict) -> Measurements:
        """The declarative JSON form."""
        m = spec.get("measurements", {})
        cuts = tuple(
            CrossCut(c["name"], c.get("field"), tuple(c.get("values") or ()), c.get("min_n", 3))
            for c in spec.get("cross_cuts") or []
        )
        return Measurements(
            tuple(m.get("categorical", [])), tuple(m.get("continuous", [])),
            {k: (v["field"], v["value"]) for k, v in m.get("proportions", {}).items()},
            cuts or DEFAULT_CUTS,
            {k: tuple(v) for k, v in spec.get("themes", {}).items()},
            spec.get("alpha", 0.05),
        )

    @staticmethod
    def from_json(path: str) -> Measurements:
        with open(path, encoding="utf-8") as f:
            return Measurements.from_dict(json.load(f))

    def slices(self) -> Column:
        """Array of the slice labels of a row."""
        labels = []
        for cut in self.cross_cuts:
            if cut.field is None:
                labels.append(F.lit(cut.name))
            for value in cut.values:
                labels.append(F.when(F.col(cut.field) == F.lit(value), F.lit(f"{cut.name}:{value}")))
        return F.array_compact(F.array(*labels))

    def min_n(self) -> Column:
        """Minimum cohort size of a slice label."""
        rule = F.lit(0)
        for cut in self.cross_cuts:
            if cut.field is not None:
                rule = F.when(F.col("slice").startswith(f"{cut.name}:"), cut.min_n).otherwise(rule)
        return rule

    def theme(self) -> Column:
        """Theme of a field; the map is part of the configuration, so it is a literal."""
        pairs = [F.lit(x) for theme, names in self.themes.items() for n in names for x in (n, theme)]
        if not pairs:
            return F.lit(None).cast("string")
        return F.try_element_at(F.create_map(*pairs), F.col("field"))


def cohort_pair(df: DataFrame) -> tuple[str, str]:
    """S3: the two cohorts of a table in name order; anything else is an error."""
    names = sorted(r.cohort for r in df.select("cohort").distinct().limit(3).collect())
    if len(names) != 2:
        raise ValueError(f"expected two cohorts, found {names}")
    return names[0], names[1]


def pair_from_name(name: str, overrides: dict | None = None) -> dict[str, str]:
    """``family-1-vs-2`` to cohort names and labels, with overrides."""
    left, right = name.split("-vs-", 1)
    family, _, version_a = left.rpartition("-")
    found = {
        "family": family, "cohort_a": f"{family}-{version_a}".replace(".", "-"),
        "cohort_b": f"{family}-{right}".replace(".", "-"),
        "label_a": f"{family.title()} {version_a}", "label_b": f"{family.title()} {right}",
    }
    return {**found, **(overrides or {})}
