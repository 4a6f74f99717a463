"""The common form of findings."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from lodeframe.functions.columns import rows

SCHEMA = "column string, category string, action string, confidence string, evidence string, rows_affected long, params string"
DEFINITIVE, JUDGMENT = "definitive", "judgment_call"

# The order in which categories are cleaned.
CATEGORY_ORDER = (
    "type_correction", "duplicates", "missing_values", "outliers", "text_preprocessing", "categorical_encoding", "datetime_engineering",
    "feature_scaling", "feature_selection", "data_leakage", "class_imbalance", "data_standardization", "structural",
)


@dataclass
class Finding:
    columns: list[str]
    category: str
    action: str
    confidence: str
    evidence: str
    rows: int = 0
    params: dict = field(default_factory=dict)

    def row(self) -> tuple:
        params = json.dumps({"columns": self.columns, **self.params}, sort_keys=True, default=str)
        return (", ".join(self.columns) or None, self.category, self.action, self.confidence, self.evidence, self.rows, params)


def as_frame(spark, findings: list[Finding]) -> DataFrame:
    return rows(spark, [f.row() for f in findings], SCHEMA)


def ranked(findings: list[Finding]) -> list[Finding]:
    """Definitive ones first, then by category, then by how many rows and columns they touch."""
    return sorted(findings, key=lambda f: (f.confidence != DEFINITIVE, CATEGORY_ORDER.index(f.category), -f.rows, -len(f.columns), f.columns))
