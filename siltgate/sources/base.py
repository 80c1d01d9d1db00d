"""What every source hands over: slots with their names, and checks of the scan itself."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from siltgate.operators.tracked import RowNumbering, TrackedFrame


@dataclass(frozen=True)
class Source:
    """A lazily read table. ``df`` holds one slot per column and the row positions."""

    df: DataFrame
    columns: list[str]
    numbering: RowNumbering
    file_type: str
    path: str
    encoding: str | None = None
    delimiter: str | None = None
    sheet: str | None = None
    sheets: list[str] = field(default_factory=list)
    # The same scan without row positions.
    bare: DataFrame | None = None
    # Scan faults: code of the error a run raises when any row matches the expression.
    faults: dict[str, Column] = field(default_factory=dict)

    def tracked(self) -> TrackedFrame:
        return TrackedFrame.start(self.df, dict(zip(self.columns, slots(len(self.columns)))), self.numbering, self.bare)

    def rows(self) -> DataFrame:
        """The source as a plain DataFrame under its own column names.

        A record with more fields than there are columns fails the job that meets it.
        """
        df = self.df if self.bare is None else self.bare
        if "source.read_failed" in self.faults:
            refused = F.raise_error(F.lit(f"source.read_failed: a record of {self.path} has more fields than the header."))
            df = df.where(F.when(self.faults["source.read_failed"], refused.cast("boolean")).otherwise(True))
        return df.select(*[df[slot].alias(name) for slot, name in zip(slots(len(self.columns)), self.columns)])


def slots(count: int) -> list[str]:
    return [f"c{i}" for i in range(count)]
