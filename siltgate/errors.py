"""Plan-level findings and the error every plan check raises."""

from __future__ import annotations

from dataclasses import dataclass, field
from enum import IntEnum
from typing import Any


# Result codes callers branch on.
class ResultCode(IntEnum):
    SUCCESS = 0
    INTERNAL_ERROR = 1
    USAGE_OR_DRIFT = 2
    VALIDATION_ERROR = 10
    REJECT_THRESHOLD = 20
    LOAD_ERROR = 30


@dataclass(frozen=True)
class Diagnostic:
    code: str
    message: str
    path: str | None = None
    details: dict[str, Any] = field(default_factory=dict)

    def as_dict(self) -> dict[str, Any]:
        return {"code": self.code, "message": self.message, "path": self.path, "details": self.details}


class EngineError(Exception):
    """A plan cannot run; carries one diagnostic and the result code to report."""

    def __init__(self, diagnostic: Diagnostic, result_code: ResultCode = ResultCode.VALIDATION_ERROR) -> None:
        super().__init__(f"{diagnostic.code}: {diagnostic.message}")
        self.diagnostic = diagnostic
        self.result_code = result_code

    @property
    def code(self) -> str:
        return self.diagnostic.code


def fail(
    code: str,
    message: str,
    *,
    path: str | None = None,
    result_code: ResultCode = ResultCode.VALIDATION_ERROR,
    **details: Any,
) -> EngineError:
    """Build the error for ``raise fail(...)``."""
    return EngineError(Diagnostic(code, message, path, details), result_code)
