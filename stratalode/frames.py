"""Sample tables: an identifier, coordinates, variables."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Samples:
    """A frame with a unique id column, one to three coordinates and one or more variables, all without nulls."""

    frame: DataFrame
    coords: tuple[str, ...]
    variables: tuple[str, ...]
    id: str = "id"

    def __post_init__(self):
        missing = [c for c in (self.id, *self.coords, *self.variables) if c not in self.frame.columns]
        if missing:
            raise ValueError(f"no columns {missing}")
        if not 1 <= len(self.coords) <= 3 or not self.variables:
            raise ValueError("one to three coordinates and one or more variables are needed")

    def plain(self) -> DataFrame:
        """(id, coordinates, variables) alone, numbers as doubles."""
        return self.frame.select(F.col(self.id).cast("long").alias("id"), *(F.col(c).cast("double").alias(c) for c in dict.fromkeys((*self.coords, *self.variables))))

    def by_position(self, numbers: Sequence[int]) -> list[str]:
        """Column names by their 1-based numbers; 0 stands for no column."""
        return [self.frame.columns[n - 1] for n in numbers if n > 0]

    def check(self) -> Samples:
        """Raises if a value is missing or an id repeats; one pass."""
        columns = (self.id, *self.coords, *self.variables)
        nulls = F.sum(F.when(F.greatest(*(F.col(c).isNull().cast("int") for c in columns), F.lit(0)) > 0, 1).otherwise(0))
        row = self.frame.agg(nulls.alias("nulls"), F.count("*").alias("n"), F.count_distinct(self.id).alias("ids")).first()
        if row["nulls"]:
            raise ValueError(f"{row['nulls']} samples lack a value: samples must be homotopic")
        if row["n"] != row["ids"]:
            raise ValueError("ids repeat")
        return self
