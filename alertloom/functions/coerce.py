"""Lenient text-to-number rules of the alert format, as SQL expression text.

The per-alert rules are long CASE chains. They are written as SQL text and handed to Spark one
select at a time: building the same trees call by call costs seconds of driver time per plan.
"""

from pyspark.sql import DataFrame


def quoted(value: str) -> str:
    """A SQL string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def quoted_list(values) -> str:
    return ", ".join(quoted(v) if isinstance(v, str) else str(v) for v in values)


def array_of(values) -> str:
    return f"array({quoted_list(values)})"


def to_int(expr: str, default: int = 0) -> str:
    """Integer text (blanks and a sign allowed) to BIGINT; anything else is ``default``."""
    return f"coalesce(try_cast({expr} AS BIGINT), {default}L)"


def text(expr: str) -> str:
    return f"coalesce({expr}, '')"


def lower_text(expr: str) -> str:
    return f"lower(coalesce({expr}, ''))"


def first_given(*exprs: str) -> str:
    """First value that is neither NULL nor empty; the last one is taken as it is."""
    *head, last = exprs
    return "coalesce(" + ", ".join([f"nullif({e}, '')" for e in head] + [last]) + ")"


def any_word(haystack: str, words) -> str:
    """True when one of the plain substrings occurs."""
    return "(" + " OR ".join(f"contains({haystack}, {quoted(w)})" for w in words) + ")"


def flag(condition: str) -> str:
    """1 when the condition holds, 0 when it is false or unknown."""
    return f"CASE WHEN {condition} THEN 1L ELSE 0L END"


def case(*branches: tuple[str, str], otherwise: str) -> str:
    whens = " ".join(f"WHEN {condition} THEN {value}" for condition, value in branches)
    return f"CASE {whens} ELSE {otherwise} END"


def level_to_ordinal(level: str) -> str:
    return case((f"{level} >= 12", "3L"), (f"{level} >= 9", "2L"), (f"{level} >= 6", "1L"),
                otherwise="0L")


def severity_to_ordinal(severity: str) -> str:
    """Digits go through the level cut points, names through a table; the rest is 0."""
    return (
        f"CASE WHEN {severity} RLIKE '^[0-9]+$' "
        f"THEN {level_to_ordinal(f'try_cast({severity} AS BIGINT)')} "
        f"ELSE CASE lower(trim({severity})) "
        "WHEN 'critical' THEN 3L WHEN 'high' THEN 2L WHEN 'medium' THEN 1L ELSE 0L END END"
    )


def add(df: DataFrame, **columns: str) -> DataFrame:
    """``df`` with further columns given as SQL text; none of them may exist already."""
    return df.selectExpr("*", *[f"{expr} AS `{name}`" for name, expr in columns.items()])
