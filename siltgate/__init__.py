"""Recipe-driven data-quality ingestion on Spark."""

import sys

from pyspark import cloudpickle

from siltgate.engine import Plan, RunResult, Workspace, compile_recipe, load, validate
from siltgate.errors import Diagnostic, EngineError, ResultCode
from siltgate.operators.profile import inspect_source, profile_folder, starter_recipe
from siltgate.plans.recipe import Recipe, Settings, resolve_settings
from siltgate.sinks.runlog import compact_runs, find_run, list_runs, newest_runs
from siltgate.sources.open import open_source
from siltgate.sources.tables import from_dataframe

# Tasks get this package's few Python functions by value, so executors need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = [
    "Diagnostic",
    "EngineError",
    "Plan",
    "Recipe",
    "ResultCode",
    "RunResult",
    "Settings",
    "Workspace",
    "compact_runs",
    "compile_recipe",
    "find_run",
    "from_dataframe",
    "inspect_source",
    "list_runs",
    "load",
    "newest_runs",
    "open_source",
    "profile_folder",
    "resolve_settings",
    "starter_recipe",
    "validate",
]
