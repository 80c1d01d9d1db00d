"""Row accounting, the reject ratio and the gate that follows from them."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F

from siltgate.errors import ResultCode
from siltgate.operators.tracked import TrackedFrame


def count_columns(frame: TrackedFrame) -> list[Column]:
    """The counts as aggregate expressions, usable in ``agg`` and in ``observe``.

    One row of the frame is one source row, so counting rows counts distinct row numbers.
    """
    edit, check = frame.failed("edit"), frame.failed("validate")
    return [
        F.count(F.lit(1)).alias("read"),
        F.count_if(edit).alias("rejected_edit"),
        F.count_if(check & ~edit).alias("rejected_validate"),
    ]


def row_accounting(frame: TrackedFrame, threshold: float, *, has_diagnostics: bool = False) -> DataFrame:
    """One row: the counts, the reject ratio and the result code they lead to."""
    counts = frame.unlocated().df.agg(*count_columns(frame))
    rejected = F.col("rejected_edit") + F.col("rejected_validate")
    ratio = F.coalesce(F.try_divide(rejected.cast("double"), F.col("read").cast("double")), F.lit(0.0))
    validated = F.lit(None).cast("bigint") if has_diagnostics else F.col("read") - rejected
    gate = F.when(F.lit(has_diagnostics), int(ResultCode.VALIDATION_ERROR)).when(
        ratio > threshold, int(ResultCode.REJECT_THRESHOLD)
    )
    return counts.select(
        "read",
        (F.col("read") - F.col("rejected_edit")).alias("edited"),
        validated.alias("validated"),
        "rejected_edit",
        "rejected_validate",
        ratio.alias("reject_ratio"),
        gate.otherwise(int(ResultCode.SUCCESS)).cast("int").alias("result_code"),
    )


def rows_summary(counts: Mapping[str, Any], *, has_diagnostics: bool) -> dict[str, int | None]:
    """The counts of one run, in the shape a run record stores."""
    edited = counts["read"] - counts["rejected_edit"]
    return {
        "read": counts["read"],
        "edited": edited,
        "validated": None if has_diagnostics else edited - counts["rejected_validate"],
        "loaded": None,
        "rejected_edit": counts["rejected_edit"],
        "rejected_validate": counts["rejected_validate"],
    }


def gate(rows: Mapping[str, Any], threshold: float, *, has_diagnostics: bool) -> ResultCode:
    """Diagnostics fail the run; so does a reject share above (not at) the threshold."""
    if has_diagnostics:
        return ResultCode.VALIDATION_ERROR
    rejected = rows["rejected_edit"] + rows["rejected_validate"]
    ratio = rejected / rows["read"] if rows["read"] else 0.0
    return ResultCode.REJECT_THRESHOLD if ratio > threshold else ResultCode.SUCCESS
