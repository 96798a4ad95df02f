"""Typed contracts for JSON columns: what is right goes on typed, what is not goes to quarantine with reasons."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Field:
    """A value at ``path`` of a declared type (bigint, double, string or boolean), with bounds or a list of values."""

    name: str
    path: str
    type: str
    required: bool = True
    least: float | None = None
    most: float | None = None
    among: tuple = ()

    def _found(self, value: Column) -> Column:
        return F.try_variant_get(value, self.path, "variant")

    def typed(self, value: Column) -> Column:
        """The value, or null; whole numbers are doubles too, nothing else is cast."""
        return F.when(self._fits(value), F.try_variant_get(value, self.path, self.type))

    def _fits(self, value: Column) -> Column:
        kind = F.schema_of_variant(self._found(value))
        return {"bigint": kind == "BIGINT", "string": kind == "STRING", "boolean": kind == "BOOLEAN", "double": kind.isin("BIGINT", "DOUBLE") | kind.startswith("DECIMAL")}[self.type]

    def reasons(self, value: Column) -> list[Column]:
        there = self._found(value).isNotNull() & ~F.is_variant_null(self._found(value))
        typed = self.typed(value)
        out = [F.when(there & ~self._fits(value), f"{self.name}: not {self.type}")]
        if self.required:
            out.append(F.when(~there, f"{self.name}: missing"))
        if self.least is not None:
            out.append(F.when(typed < self.least, f"{self.name}: below {self.least}"))
        if self.most is not None:
            out.append(F.when(typed > self.most, f"{self.name}: above {self.most}"))
        if self.among:
            out.append(F.when(~typed.isin(*self.among), f"{self.name}: not listed"))
        return out


def checked(rows: DataFrame, column: str, fields: list[Field]) -> DataFrame:
    """``rows`` with a column a field and ``reasons`` (empty if the row keeps the contract). A null and what is no JSON object break it as a whole."""
    value = F.try_parse_json(column)
    whole = F.when(F.col(column).isNull(), f"{column}: null").when(value.isNull(), f"{column}: not JSON").when(~F.schema_of_variant(value).startswith("OBJECT"), f"{column}: not an object")
    each = F.array_compact(F.array(*(r for f in fields for r in f.reasons(value))))
    return rows.withColumns({f.name: f.typed(value) for f in fields} | {"reasons": F.when(whole.isNotNull(), F.array(whole)).otherwise(each)})


def good(rows: DataFrame) -> DataFrame:
    return rows.where(F.size("reasons") == 0).drop("reasons")


def quarantined(rows: DataFrame, *keep: str) -> DataFrame:
    """A row a reason, with the columns to keep."""
    return rows.where(F.size("reasons") > 0).select(*keep, F.explode("reasons").alias("reason"))
