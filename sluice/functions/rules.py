"""Rule compiler: config rules to Column predicates.

Each rule compiles to an ``ok`` Column that is never NULL.  Only ``not_null``
fails on NULL; for every other type a NULL input is "not a violation"
(``coalesce(predicate, true)``), otherwise a null-tolerant not_null rule and
a strict range rule on the same column could never pass together.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException, IllegalArgumentException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.config import Rule


def _ident(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _sql_str(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def rule_predicate(rule: Rule) -> Column:
    """The row-level pass predicate of ``rule`` (NULL-safe, never NULL)."""
    col = F.col(_ident(rule.column)) if rule.column else None
    if rule.type == "not_null":
        return col.isNotNull()
    if rule.type in ("range", "custom"):
        return F.coalesce(F.expr(rule.expression), F.lit(True))
    if rule.type == "allowed_values":
        return F.coalesce(col.isin(*(rule.values or ())), F.lit(True))
    if rule.type == "regex":
        return F.coalesce(col.rlike(rule.expression), F.lit(True))
    raise ValueError(f"unknown rule type {rule.type!r} in {rule.rule_id}")


def rule_expression_text(rule: Rule) -> str:
    """The evaluated expression as SQL text, for the audit log."""
    if rule.type == "not_null":
        return f"{rule.column} IS NOT NULL"
    if rule.type == "allowed_values":
        return f"{rule.column} IN (" + ", ".join(_sql_str(v) for v in (rule.values or ())) + ")"
    if rule.type == "regex":
        return f"{rule.column} RLIKE {_sql_str(rule.expression or '')}"
    return rule.expression or ""


#: Prefix of the reason of a row on which a rule raises.
ERROR_PREFIX = "error:"
_DAY = "2000-01-01"


@dataclass(frozen=True)
class CompiledRule:
    """A rule against some rows: ``ok`` is never NULL, ``reason`` is NULL for rows that pass."""

    rule: Rule
    ok: Column
    text: str
    error: str | None = None
    reason: Column | None = None


def guarded(ok: Column) -> Column:
    """1 if ``ok`` holds, 0 if it doesn't, -1 if its evaluation raises (a division by zero, a bad cast) on the row at hand.

    ``try_add`` of a date and an interval gives NULL for whatever goes wrong
    in it, so the verdict goes through it as a day or none.
    """
    day = F.lit(_DAY).cast("date")
    return F.coalesce(F.datediff(F.try_add(day, F.make_dt_interval(F.when(ok, F.lit(1)).otherwise(F.lit(0)))), day), F.lit(-1))


def _compiled(rule: Rule, predicate: Column, text: str) -> CompiledRule:
    if rule.type not in ("range", "custom"):  # the other types can't raise on a row
        return CompiledRule(rule, predicate, text, reason=F.when(~predicate, F.lit(rule.rule_id)))
    state = guarded(predicate)
    reasons = F.array(F.lit(ERROR_PREFIX + rule.rule_id), F.lit(rule.rule_id), F.lit(None).cast("string"))
    return CompiledRule(rule, state == 1, text, reason=F.get(reasons, state + 1))


def _analyse(df: DataFrame, predicates: list[Column]) -> None:
    """Resolve predicates beside the rows (no job): a rule judges one row, so it
    may not aggregate, rank over a window or hold a subquery."""
    plan = df.select("*", *predicates)._jdf.queryExecution().analyzed()
    text = plan.expressions().mkString(" ")
    if "windowspecdefinition(" in plan.toString().lower() or "subquery#" in text or "exists#" in text:
        raise ValueError("a rule may not use window functions or subqueries")


def compile_rules(df: DataFrame, rules) -> list[CompiledRule]:
    """Compile rules against ``df``'s columns.

    A rule whose text does not resolve (unknown column, bad SQL, unknown
    type) is returned with ``error`` set instead of failing the run; it is
    reported as a failed rule set-up and takes no part in the row verdict.
    Resolution is analysis only -- no job runs: all predicates are analysed
    together, and one by one only when that fails.  A rule that raises on some
    row fails for that row alone, with the reason ``error:<rule id>``.
    """
    rules = list(rules)
    preds: list = []
    errors: list = []
    for rule in rules:
        try:
            if rule.type == "regex":
                df.sparkSession._jvm.java.util.regex.Pattern.compile(rule.expression)
            preds.append(rule_predicate(rule))
            errors.append(None)
        except IllegalArgumentException as exc:
            preds.append(None)
            errors.append(f"bad pattern: {exc}")
        except (AnalysisException, ValueError, TypeError, AttributeError) as exc:  # parse errors included
            preds.append(None)
            errors.append(str(exc) or type(exc).__name__)
    ok_preds = [(i, p) for i, p in enumerate(preds) if p is not None]
    try:
        if ok_preds:
            _analyse(df, [p.alias(f"_probe{i}") for i, p in ok_preds])
    except (AnalysisException, ValueError):
        for i, p in ok_preds:
            try:
                _analyse(df, [p.alias("_probe")])
            except (AnalysisException, ValueError) as exc:
                errors[i] = str(exc) or type(exc).__name__
    out = []
    for rule, pred, err in zip(rules, preds, errors):
        text = rule_expression_text(rule)
        if err is None:
            out.append(_compiled(rule, pred, text))
        else:
            out.append(CompiledRule(rule, F.lit(True), text, error=err))
    return out
