"""One scan of a source, kept: its accepted rows, and the findings of the others.

A load must know its counts before it writes, and must write the rows it counted. So the scan
that counts also fills a private table in the scratch folder, with the accepted values of rows
that pass and the original row of those that fail. Loads and reject files read that table;
the source may change meanwhile.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from siltgate.operators.rejects import listed_findings
from siltgate.operators.tracked import TrackedFrame
from siltgate.plans.types import DeclaredColumn
from siltgate.session import remove_folder, scratch_path, stored_table

_FINDINGS, _FAILED = "__findings", "__failed"


@dataclass(frozen=True)
class StagedRows:
    table: DataFrame
    schema: tuple[DeclaredColumn, ...]
    original: tuple[str, ...]
    path: str

    def accepted(self) -> DataFrame:
        """Rows without a finding, under their declared names."""
        values = [F.col(f"a{i}").alias(column.name) for i, column in enumerate(self.schema)]
        return self.table.where(F.col(_FINDINGS).isNull()).select(*values)

    def found_rejects(self) -> DataFrame:
        """One row per finding, as :func:`siltgate.operators.rejects.found_rejects` gives them."""
        return self.table.where(F.col(_FINDINGS).isNotNull()).select(*self.original, F.explode(_FINDINGS).alias("__r"))

    def count_accepted(self) -> int:
        return self.table.where(F.col(_FINDINGS).isNull()).count()

    def discard(self) -> None:
        remove_folder(self.table.sparkSession, self.path)


def stage_rows(frame: TrackedFrame, schema: Iterable[DeclaredColumn]) -> StagedRows:
    """Write what loads and rejects need of every row, in one job over the source."""
    schema = tuple(schema)
    original = tuple(slot for slot in frame.df.columns if not (slot.startswith("e") and slot[1:].isdigit()))
    judged, failed = frame.df.withColumn(_FAILED, frame.failed()), F.col(_FAILED)
    findings = F.when(failed, F.array_compact(listed_findings(frame))).alias(_FINDINGS)
    values = [F.when(~failed, frame.value(column.name)).alias(f"a{i}") for i, column in enumerate(schema)]
    kept = [F.when(failed, F.col(slot)).alias(slot) for slot in original]
    path = scratch_path(frame.df.sparkSession, "staged")
    return StagedRows(stored_table(judged.select(*values, *kept, findings), path), schema, original, path)
