"""The entry points: validate a recipe, load it, look at a source."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping
from dataclasses import dataclass, field, replace
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from siltgate.errors import Diagnostic, EngineError, ResultCode, fail
from siltgate.operators.accounting import count_columns, gate, rows_summary
from siltgate.operators.checks import accepted_rows, check_rows, shape_diagnostics
from siltgate.operators.edits import apply_edits
from siltgate.operators.rejects import found_rejects, reject_rows, write_rejects
from siltgate.operators import staging
from siltgate.operators.tracked import TrackedFrame
from siltgate.plans.recipe import Recipe, Settings, resolve_settings
from siltgate.session import remove_folder, require_utc, scratch_path, stored_table
from siltgate.sinks import runlog
from siltgate.sinks.tables import StagedReplace, append_rows
from siltgate.sources.base import Source
from siltgate.sources.delimited import fault_counts, refuse_faults
from siltgate.sources.open import open_source

# What a failing Spark job raises; some causes reach Python unconverted.
JOB_ERRORS = (PySparkException, Py4JJavaError)


@dataclass(frozen=True)
class Workspace:
    """Where a project keeps its reject rows and its run log, and its default settings."""

    rejects: str
    runs: str
    defaults: Mapping[str, Any] = field(default_factory=dict)


@dataclass(frozen=True)
class Plan:
    """A compiled recipe. Nothing has run yet."""

    recipe: Recipe
    settings: Settings
    source: Source
    frame: TrackedFrame
    diagnostics: tuple[Diagnostic, ...]

    def accepted(self) -> DataFrame | None:
        return None if self.diagnostics else accepted_rows(self.frame, self.recipe.schema)

    def rejects(self) -> DataFrame:
        return reject_rows(self.frame)

    def counters(self) -> list[Column]:
        return [*count_columns(self.frame), *fault_counts(self.source)]

    def counts(self) -> dict[str, int]:
        """The counts alone, from one aggregate over the source."""
        return self.frame.unlocated().df.agg(*self.counters()).first().asDict()

    def counted_by(self, observation: Observation, *counters: Column, located: bool = False) -> "Plan":
        """The same plan, whose counts are taken while an output is written.

        The filter of the output stays above the counting, so each cast runs once a row.
        """
        frame = self.frame if located else self.frame.unlocated()
        return replace(self, frame=frame.over(frame.df.observe(observation, *(counters or self.counters()))))


@dataclass(frozen=True)
class RunResult:
    command: str
    run_id: str
    recipe: str
    profile: str | None
    table: str | None
    mode: str | None
    rows: dict[str, int | None]
    rejects: str | None
    diagnostics: tuple[Diagnostic, ...]
    result_code: ResultCode
    started: dt.datetime
    finished: dt.datetime
    git_sha: str | None = None
    plan: Plan | None = field(default=None, repr=False)

    @property
    def status(self) -> str:
        return "success" if self.result_code == ResultCode.SUCCESS else "failed"

    @property
    def duration_ms(self) -> int:
        return int((self.finished - self.started).total_seconds() * 1000)

    def record(self) -> dict[str, Any]:
        """The run as the run log stores it."""
        return {
            "run_id": self.run_id,
            "recipe": self.recipe,
            "profile": self.profile,
            "table": self.table,
            "mode": self.mode,
            "started_at": _stamp(self.started),
            "finished_at": _stamp(self.finished),
            "duration_ms": self.duration_ms,
            "rows": self.rows,
            "rejects": self.rejects,
            "diagnostics": [finding.as_dict() for finding in self.diagnostics],
            "exit_code": int(self.result_code),
            "git_sha": self.git_sha,
        }


_NO_ROWS = dict.fromkeys(("read", "edited", "validated", "loaded", "rejected_edit", "rejected_validate"))


def compile_recipe(
    spark: SparkSession,
    recipe: Recipe | Mapping[str, Any],
    *,
    source: Source | None = None,
    defaults: Mapping[str, Any] | None = None,
    call: Mapping[str, Any] | None = None,
) -> Plan:
    """Check a recipe against its source and turn it into lazy DataFrame operations."""
    require_utc(spark)
    recipe = recipe if isinstance(recipe, Recipe) else Recipe.from_dict(recipe)
    settings = resolve_settings(defaults, recipe, call)
    source = source or open_source(spark, recipe.source)
    frame = apply_edits(source.tracked(), recipe.edits, recipe.schema)
    diagnostics = tuple(shape_diagnostics(frame, recipe.schema))
    if not diagnostics:
        frame = check_rows(frame, recipe.schema)
    return Plan(recipe, settings, source, frame, diagnostics)


def validate(
    spark: SparkSession,
    recipe: Recipe | Mapping[str, Any],
    *,
    workspace: Workspace | None = None,
    source: Source | None = None,
    call: Mapping[str, Any] | None = None,
    run_id: str | None = None,
) -> RunResult:
    """Count accepted and rejected rows, write the reject rows, and judge the run.

    The source is scanned once: the rows are counted while the rejects are set aside.
    """
    started = _now()
    plan = compile_recipe(spark, recipe, source=source, defaults=workspace and workspace.defaults, call=call)
    return _counted(spark, plan, workspace, "validate", run_id or runlog.new_run_id(started), started)


def load(
    spark: SparkSession,
    recipe: Recipe | Mapping[str, Any],
    *,
    workspace: Workspace,
    source: Source | None = None,
    call: Mapping[str, Any] | None = None,
    git_sha: str | None = None,
) -> RunResult:
    """Validate, then append to or replace the target table; every load is logged."""
    started = _now()
    run_id = runlog.new_run_id(started)
    try:
        plan = compile_recipe(spark, recipe, source=source, defaults=workspace.defaults, call=call)
        staged_replace = plan.recipe.target["mode"] == "replace" and not plan.diagnostics
        run = _replace if staged_replace else _append
        result = run(spark, plan, workspace, run_id, started)
    except EngineError as error:
        name = recipe.name if isinstance(recipe, Recipe) else str(dict(recipe).get("name", ""))
        result = RunResult(
            "load", run_id, name, None, None, None, dict(_NO_ROWS), None, (error.diagnostic,), error.result_code, started, _now()
        )
    result = replace(result, git_sha=git_sha)
    runlog.append_run(spark, workspace.runs, result.record())
    return result


def _append(spark: SparkSession, plan: Plan, workspace: Workspace, run_id: str, started: dt.datetime) -> RunResult:
    """The counting scan fills a private staging table; past the gate, that table is inserted."""
    if plan.diagnostics:
        return _counted(spark, plan, workspace, "load", run_id, started)
    observation = Observation()
    try:
        staged = staging.stage_rows(plan.counted_by(observation, located=bool(plan.frame.findings)).frame, plan.recipe.schema)
    except JOB_ERRORS as error:
        raise _unreadable(plan, error) from error

    def insert() -> int:
        _same_rows(judged, staged.count_accepted())
        loaded = append_rows(spark, judged.table, plan.recipe.schema, staged.accepted(), plan.settings)
        return _same_rows(judged, loaded)

    try:
        judged = _judged(spark, plan, observation.get, workspace, "load", run_id, started, staged.found_rejects())
        return _sunk(judged, insert) if judged.result_code == ResultCode.SUCCESS else judged
    finally:
        staged.discard()


def _same_rows(judged: RunResult, rows: int) -> int:
    """The rows about to be loaded, or loaded, are as many as were validated."""
    if rows != judged.rows["validated"]:
        error = RuntimeError(f"{rows} rows are staged, {judged.rows['validated']} were validated")
        raise _load_failed(judged, error)
    return rows


def _replace(spark: SparkSession, plan: Plan, workspace: Workspace, run_id: str, started: dt.datetime) -> RunResult:
    """Staging is private to the run, so it is filled before the gate, in the counting scan."""
    table = plan.recipe.target["table"]
    staged = StagedReplace(spark, table, plan.recipe.schema, plan.settings, run_id)
    observation = Observation()
    try:
        loaded = staged.stage(plan.counted_by(observation).accepted())
    except EngineError:
        raise
    except JOB_ERRORS as error:
        judged = _counted(spark, plan, workspace, "load", run_id, started)
        return judged if judged.result_code != ResultCode.SUCCESS else _failed(judged, _load_failed(judged, error))
    try:
        judged = _judged(spark, plan, observation.get, workspace, "load", run_id, started)
    except Exception:
        staged.discard()
        raise
    if judged.result_code != ResultCode.SUCCESS:
        staged.discard()
        return judged

    def swap() -> int:
        try:
            _same_rows(judged, loaded)
        except EngineError:
            staged.discard()
            raise
        staged.swap()
        return loaded

    return _sunk(judged, swap)


def _sunk(judged: RunResult, sink) -> RunResult:
    """Run the sink of a judged run and report what became of it."""
    try:
        rows = {**judged.rows, "loaded": sink()}
    except EngineError as error:
        return _failed(judged, error)
    except JOB_ERRORS as error:
        return _failed(judged, _load_failed(judged, error))
    return replace(judged, rows=rows, finished=_now())


def _failed(judged: RunResult, error: EngineError) -> RunResult:
    return replace(judged, diagnostics=(error.diagnostic,), result_code=error.result_code, finished=_now())


def _load_failed(judged: RunResult, error: Exception) -> EngineError:
    return fail(
        "mysql.load_failed",
        f"Loading table `{judged.table}` failed.",
        path="target.table",
        result_code=ResultCode.LOAD_ERROR,
        table=judged.table,
        mode=judged.mode,
        error=type(error).__name__,
        reason=_reason(error),
    )


def _unreadable(plan: Plan, error: Exception) -> EngineError:
    return fail("source.read_failed", "The source cannot be read.", path=plan.source.path, reason=_reason(error))


def _reason(error: Exception) -> str:
    text = str(getattr(error, "java_exception", error))
    return runlog.mask_secrets((text.splitlines() or [""])[0])


def _counted(
    spark: SparkSession, plan: Plan, workspace: Workspace | None, command: str, run_id: str, started: dt.datetime
) -> RunResult:
    """Take the counts in one scan, which also finds the rejects if they are to be written."""
    found, path = None, scratch_path(spark, "rejects")
    try:
        if workspace is None or not plan.frame.findings:
            counts = plan.counts()
        else:
            observation = Observation()
            found = stored_table(found_rejects(plan.counted_by(observation, located=True).frame), path)
            counts = observation.get
    except JOB_ERRORS as error:
        remove_folder(spark, path)
        raise _unreadable(plan, error) from error
    try:
        return _judged(spark, plan, counts, workspace, command, run_id, started, found)
    finally:
        remove_folder(spark, path)


def _judged(
    spark: SparkSession,
    plan: Plan,
    counts: Mapping[str, int],
    workspace: Workspace | None,
    command: str,
    run_id: str,
    started: dt.datetime,
    found: DataFrame | None = None,
) -> RunResult:
    refuse_faults(spark, plan.source, counts)
    blocked = bool(plan.diagnostics)
    rows = rows_summary(counts, has_diagnostics=blocked)
    rejects = None
    if workspace and rows["rejected_edit"] + rows["rejected_validate"]:
        rejects = write_rejects(plan.frame, f"{workspace.rejects.rstrip('/')}/{run_id}", found)
    return RunResult(
        command=command,
        run_id=run_id,
        recipe=plan.recipe.name,
        profile=plan.settings.profile,
        table=plan.recipe.target["table"],
        mode=plan.recipe.target["mode"],
        rows=rows,
        rejects=rejects,
        diagnostics=plan.diagnostics,
        result_code=gate(rows, plan.settings.reject_threshold, has_diagnostics=blocked),
        started=started,
        finished=_now(),
        plan=plan,
    )


def _now() -> dt.datetime:
    return dt.datetime.now(dt.UTC)


def _stamp(moment: dt.datetime) -> str:
    return f"{moment.astimezone(dt.UTC):%Y-%m-%dT%H:%M:%SZ}"
