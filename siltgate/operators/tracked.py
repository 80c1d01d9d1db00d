"""The frame every operator works on: values in slots, names beside them.

A source puts each column into its own slot (``c0``, ``c1``, ...). An edit never overwrites a
slot: it adds a new one and points the column's name at it. So a rename or a drop changes no
data, the original row stays readable for reject rows, and Catalyst prunes every slot that
an output does not use. Column names may hold dots, blanks or differ only by case.

A check that can fail is kept as a :class:`Finding`, a boolean expression over slots. Nothing
is evaluated until an output asks: clean rows need one filter, counts one aggregate, and
reject rows build their records only for rows that already failed.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, replace
from functools import reduce
from typing import Protocol

from pyspark.sql import Column, DataFrame, functions as F, types as T

from siltgate.errors import fail

# Fixed value: the row number column of reject rows; no user column may take its name.
ROW_INDEX = "__row_index"
_TICK = "__tick"


class RowNumbering(Protocol):
    """Adds the 1-based source row number as :data:`ROW_INDEX`."""

    def number(self, df: DataFrame) -> DataFrame: ...


@dataclass(frozen=True)
class ColumnNumbering:
    """Row numbers already present in a column."""

    column: str

    def number(self, df: DataFrame) -> DataFrame:
        return df.withColumn(ROW_INDEX, F.col(self.column).cast("bigint"))


@dataclass(frozen=True)
class Finding:
    """One way a row can fail. ``step`` is the number of the cast edit that found it."""

    stage: str
    step: int
    column: str
    check: str
    reason: str
    failed: Column
    slot: str


@dataclass(frozen=True)
class TrackedFrame:
    df: DataFrame
    names: Mapping[str, str]
    original: Mapping[str, str]
    numbering: RowNumbering
    findings: tuple[Finding, ...] = ()
    next_slot: int = 0
    # The source without row positions, and the projections to repeat over it. A scan that is
    # asked for positions builds them for every row, used or not.
    bare: DataFrame | None = None
    steps: tuple[Mapping[str, Column], ...] = ()

    @classmethod
    def start(
        cls, df: DataFrame, names: Mapping[str, str], numbering: RowNumbering, bare: DataFrame | None = None
    ) -> "TrackedFrame":
        if ROW_INDEX in names:
            raise fail("edit.reserved_column", f"`{ROW_INDEX}` is a reserved column name.", column=ROW_INDEX)
        return cls(df, dict(names), dict(names), numbering, bare=bare)

    def unlocated(self) -> "TrackedFrame":
        """The same frame over the source without row positions, for outputs that need none."""
        if self.bare is None:
            return self
        df = reduce(lambda done, step: done.withColumns(step), self.steps, self.bare)
        return replace(self, df=df, bare=None)

    def over(self, df: DataFrame) -> "TrackedFrame":
        """The same frame over its own rows after they passed through something else."""
        return replace(self, df=df, bare=None)

    @property
    def columns(self) -> list[str]:
        return list(self.names)

    def type_of(self, name: str) -> T.DataType:
        return self.df.schema[self.names[name]].dataType

    def value(self, name: str) -> Column:
        return F.col(self.names[name])

    def require(self, name: str, operation: str) -> None:
        if name not in self.names:
            raise fail("edit.missing_column", f"`{name}` is not a column when {operation} runs.", column=name, op=operation)

    def with_values(self, values: Mapping[str, Column]) -> "TrackedFrame":
        """Point columns at new values, all computed from the present ones in one projection."""
        if not values:
            return self
        slots = {name: f"e{self.next_slot + i}" for i, name in enumerate(values)}
        step = {slots[name]: value for name, value in values.items()}
        return replace(
            self,
            df=self.df.withColumns(step),
            names={**self.names, **slots},
            next_slot=self.next_slot + len(slots),
            steps=(*self.steps, step),
        )

    def with_names(self, names: Mapping[str, str]) -> "TrackedFrame":
        return replace(self, names=dict(names))

    def with_findings(self, findings: tuple[Finding, ...]) -> "TrackedFrame":
        return replace(self, findings=self.findings + findings)

    def failed(self, stage: str | None = None) -> Column:
        """True for rows with a finding, of one stage or of any. Never null."""
        parts = [f.failed for f in self.findings if stage in (None, f.stage)]
        return reduce(lambda a, b: a | b, parts) if parts else F.lit(False)

    def failed_before(self, finding: Finding) -> Column:
        """True for rows an earlier edit or stage removed, which later checks must not see."""
        parts = [f.failed for f in self.findings if f.stage == "edit" and f.step < finding.step]
        return reduce(lambda a, b: a | b, parts) if parts else F.lit(False)

    def rows_where(self, condition: Column) -> DataFrame:
        """Rows that meet a condition over slots, with every slot computed once.

        Catalyst would push the filter below the projections and compute each cast anew in it,
        once per mention, which multiplies with every further edit. It leaves a filter above a
        projection that numbers rows.
        """
        if not self.findings:
            return self.df.where(condition)
        return self.df.withColumn(_TICK, F.monotonically_increasing_id()).where((F.col(_TICK) >= 0) & condition).drop(_TICK)

    def live_rows(self, names: list[str] | None = None) -> DataFrame:
        """Rows without findings, under their user names."""
        chosen = self.columns if names is None else names
        frame = self.unlocated()
        kept = frame.rows_where(~frame.failed()) if frame.findings else frame.df
        return kept.select(*[frame.value(name).alias(name) for name in chosen])
