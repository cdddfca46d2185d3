"""Checks of data in one pass: every check of a call is one aggregate of the same scan."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnlake.errors import ValidationError
from tarnlake.functions import Expr, column_of
from tarnlake.plans import aggregated


class Validator:
    """``null_policy``: whether a check that is null for a row counts as failed (``fail``) or passed (``pass``)."""

    def __init__(self, lake: Any = None, null_policy: str = "fail"):
        self.lake, self.null_policy = lake, self._policy(null_policy)

    @staticmethod
    def _policy(policy: str) -> str:
        if policy not in ("fail", "pass"):
            raise ValidationError("null_policy is fail or pass")
        return policy

    def frame(self, data: Any) -> DataFrame:
        if isinstance(data, DataFrame):
            return data
        if isinstance(data, str):
            return self.lake.sql(data) if " " in data.strip() else self.lake.table(data)
        return data.dataframe() if hasattr(data, "dataframe") else self.lake.to_frame(data)

    def violation(self, condition: Any, policy: str | None = None) -> Column:
        policy = self._policy(policy or self.null_policy)
        return ~F.coalesce(F.expr(condition) if isinstance(condition, str) else column_of(condition), F.lit(policy == "pass"))

    def _failed(self, df: DataFrame, check: Any, policy: str | None) -> Column:
        """Aggregate: how many rows (or values) fail."""
        if isinstance(check, (str, Expr, Column)):
            return F.count_if(self.violation(check, policy))
        kind, c = check["type"], check.get("column")
        if kind == "not_null":
            return F.count_if(F.col(c).isNull())
        if kind == "unique":  # null is a value here
            return F.count("*") - F.count_distinct(F.col(c)) - F.max(F.col(c).isNull().cast("int"))
        if kind == "between":
            return F.count_if(self.violation(F.col(c).between(check["min"], check["max"]), policy))
        if kind == "in_set":
            return F.count_if(self.violation(F.col(c).isin([*check["values"]]), policy))
        if kind == "regex":
            return F.count_if(self.violation(F.col(c).rlike(check["pattern"]), policy))
        if kind == "row_count":
            n = F.count("*")
            return F.when((n < check.get("min", 0)) | (n > check.get("max", 2**62)), 1).otherwise(0)
        raise ValidationError(f"unknown check {kind}")

    def validate(self, data: Any, checks: list, null_policy: str | None = None) -> dict:
        """{passed, details}: each with its check and failed count; a check that can't be evaluated has failed."""
        df = self.frame(data)
        details: list[dict] = [{} for _ in checks]
        columns = {}
        for i, check in enumerate(checks):
            if callable(check) and not isinstance(check, (Expr, Column)):
                try:
                    ok = bool(check(df))
                    details[i] = {"check": getattr(check, "__name__", "callable"), "passed": ok, "failed": 0 if ok else 1}
                except Exception as e:  # noqa: BLE001 - the check is the user's
                    details[i] = {"check": getattr(check, "__name__", "callable"), "passed": False, "failed": None, "error": str(e)}
                continue
            try:
                made = self._failed(df, check, null_policy).alias(f"c{i}")
                df.agg(made).schema  # noqa: B018 - analysis says whether it can be evaluated
                columns[i] = made
            except ValidationError:
                raise
            except Exception as e:  # noqa: BLE001
                details[i] = {"check": str(check), "passed": False, "failed": None, "error": str(e)[:200]}
        if columns:
            row = df.agg(*columns.values()).first()
            for i in columns:
                n = int(row[f"c{i}"] or 0)
                details[i] = {"check": str(checks[i]), "passed": n == 0, "failed": n}
        return {"passed": all(d["passed"] for d in details), "details": details}

    def check_nulls(self, data: Any, columns: list[str]) -> bool:
        return self.validate(data, [{"type": "not_null", "column": c} for c in columns])["passed"]

    def check_constraints(self, data: Any, constraints: dict | list, null_policy: str | None = None) -> bool:
        checks = [*constraints.values()] if isinstance(constraints, dict) else constraints
        return self.validate(data, checks, null_policy)["passed"]

    def _expect(self, data: Any, check: dict) -> dict:
        return self.validate(data, [check])

    def expect_unique(self, data: Any, column: str) -> dict:
        return self._expect(data, {"type": "unique", "column": column})

    def expect_between(self, data: Any, column: str, low: Any, high: Any) -> dict:
        return self._expect(data, {"type": "between", "column": column, "min": low, "max": high})

    def expect_regex(self, data: Any, column: str, pattern: str) -> dict:
        return self._expect(data, {"type": "regex", "column": column, "pattern": pattern})

    def expect_in_set(self, data: Any, column: str, values: list) -> dict:
        return self._expect(data, {"type": "in_set", "column": column, "values": values})

    def expect_not_null(self, data: Any, column: str) -> dict:
        return self._expect(data, {"type": "not_null", "column": column})

    def expect_row_count(self, data: Any, low: int = 0, high: int = 2**62) -> dict:
        return self._expect(data, {"type": "row_count", "min": low, "max": high})


def profile(df: DataFrame, column: str) -> DataFrame:
    """One row about a column: rows, nulls, distinct values (null is one), and by type numbers or lengths."""
    c, kind = F.col(column), dict(df.dtypes)[column]
    kinds = [True, True, "distinct"]
    parts = [F.count("*").alias("n_rows"), F.count_if(c.isNull()).alias("n_null"), (F.count_distinct(c) + F.coalesce(F.max(c.isNull().cast("int")), F.lit(0))).alias("n_unique")]
    if kind in ("tinyint", "smallint", "int", "bigint", "float", "double") or kind.startswith("decimal"):
        parts += [F.min(c).alias("min"), F.max(c).alias("max"), F.avg(c).alias("mean"), F.median(c).alias("median"), F.stddev(c).alias("std")]
        kinds += [True, True, True, "large", True]
    elif kind == "string":
        parts += [f(F.length(c)).alias(n) for f, n in ((F.min, "min_length"), (F.max, "max_length"), (F.avg, "avg_length"))]
    elif kind in ("date", "timestamp", "timestamp_ntz"):
        parts += [F.min(c).alias("min"), F.max(c).alias("max")]
    return aggregated(df, parts, kinds + [True] * (len(parts) - len(kinds)))


def describe(df: DataFrame) -> DataFrame:
    """``summary`` with null counts."""
    nulls = df.select(F.lit("nulls").alias("summary"), *[F.count_if(F.col(c).isNull()).cast("string").alias(c) for c, t in df.dtypes if c in df.summary("count").columns])
    return df.summary().unionByName(nulls, allowMissingColumns=True)
