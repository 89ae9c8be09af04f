"""SQL text for wide tables.

Hundreds of columns mean thousands of expressions. Written as text they are parsed at once in
the JVM, whereas building them one call at a time takes seconds on the driver.
"""

from __future__ import annotations


def name(column: str) -> str:
    return "`" + column.replace("`", "``") + "`"


def literal(value) -> str:
    if value is None:
        return "CAST(NULL AS DOUBLE)"
    if isinstance(value, str):
        escaped = value.replace("\\", "\\\\").replace("'", "\\'")
        return f"'{escaped}'"
    if isinstance(value, float):
        return f"{value!r}D"
    return str(value)


def zscore(expression: str, mean: float | None, deviation: float | None) -> str:
    """z-score of an expression; a zero deviation divides by one."""
    if mean is None:
        return "CAST(NULL AS DOUBLE)"
    return f"(({expression}) - {literal(float(mean))}) / {literal(float(deviation) if deviation else 1.0)}"
