"""The cleaning plan of a table, and applying what is beyond doubt."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame

from lodeframe.functions.columns import scalar_columns
from lodeframe.operators.clean.recipe import ACTIONS, apply_recipe
from lodeframe.operators.detect.consistency import consistency_findings
from lodeframe.operators.detect.features import feature_findings, find_target
from lodeframe.operators.detect.findings import DEFINITIVE, Finding, as_frame, ranked
from lodeframe.operators.detect.leaks import leak_findings
from lodeframe.operators.detect.outlying import outlier_findings
from lodeframe.operators.detect.structure import structure_findings
from lodeframe.operators.detect.types import type_findings


def plan_findings(df: DataFrame, key: str | None = None, target: str | None = None) -> list[Finding]:
    """Every detector over the whole table, the findings in the order they should be acted on."""
    target = find_target(df, target)
    found = type_findings(df) + structure_findings(df) + outlier_findings(df, key) + feature_findings(df, target)
    return ranked(found + leak_findings(df, target) + consistency_findings(df))


def cleaning_plan(df: DataFrame, key: str | None = None, target: str | None = None) -> DataFrame:
    return as_frame(df.sparkSession, plan_findings(df, key, target))


def auto_steps(findings: list[Finding], columns: list[str]) -> list[dict]:
    """Recipe steps of the definitive findings."""
    steps = []
    for f in ranked(findings):
        if f.confidence == DEFINITIVE and f.action in ACTIONS:
            steps.append({"action": f.action, "columns": f.columns or [c for c in columns if f.action != "remove_exact_duplicates"], "params": f.params})
    return steps


def auto_clean(df: DataFrame, findings: list[Finding] | None = None) -> DataFrame:
    """The definitive findings applied in rank order."""
    found = findings if findings is not None else plan_findings(df)
    return apply_recipe(df, auto_steps(found, scalar_columns(df)))


def steps_from_plan(plan: DataFrame) -> list[dict]:
    """Recipe steps of a plan that was stored as a table; its size follows the columns."""
    found = []
    for r in plan.collect():
        params = json.loads(r["params"])
        found.append(Finding(params.pop("columns"), r["category"], r["action"], r["confidence"], r["evidence"], r["rows_affected"], params))
    return auto_steps(found, [])
