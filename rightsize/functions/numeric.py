"""Expression helpers shared by every sizing model.

All of them build plain Catalyst expressions (Column objects, or SQL text for
``selectExpr`` stages -- one JVM call per stage instead of one per operator),
so a model stays inside whole-stage codegen. Integer-valued results (task
counts, executors, megabytes) are BIGINT; everything else is DOUBLE (``1.0D``
literals), never DECIMAL.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ceil_long(c: Column) -> Column:
    """ceil of a DOUBLE as BIGINT (Python's math.ceil on a float)."""
    return F.ceil(c).cast("bigint")


def safe_div(num: Column, den: Column) -> Column:
    """num / den, NULL when den is 0 or NULL (never raises under ANSI)."""
    return F.try_divide(num.cast("double"), den.cast("double"))


def codes_where(*pairs: tuple[Column, str]) -> Column:
    """Array of the codes whose condition holds, in the given order.

    ``array_remove`` over a fixed array keeps the expression code-generated
    (a lambda-based filter would pull the whole operator out of whole-stage
    codegen).
    """
    return F.array_remove(F.array(*[F.when(cond, F.lit(code)).otherwise(F.lit(""))
                                    for cond, code in pairs]), "")


def sql_literal(v) -> str:
    """A Python scalar as a Spark SQL literal (DOUBLE for floats)."""
    if isinstance(v, bool):
        return "TRUE" if v else "FALSE"
    if isinstance(v, int):
        return repr(v)
    if isinstance(v, float):
        return repr(v) + "D"
    return "'" + str(v).replace("\\", "\\\\").replace("'", "\\'") + "'"


def stage(df, exprs: dict[str, str]):
    """One projection stage: every named SQL expression added to the row."""
    return df.selectExpr("*", *[f"{v} AS {k}" for k, v in exprs.items()])


def case_first(pairs: list[tuple[str, str]]) -> str:
    """SQL: the code of the first true condition (NULL if none)."""
    return "CASE " + " ".join(f"WHEN {cond} THEN '{code}'" for cond, code in pairs) + " END"


def codes_array(pairs: list[tuple[str, str]]) -> str:
    """SQL: array of the codes whose condition is true, in order (codegen-able)."""
    items = ", ".join(f"CASE WHEN {cond} THEN '{code}' ELSE '' END" for cond, code in pairs)
    return f"array_remove(array({items}), '')"
