"""Pipeline rules: declared in the admin app, executed here.

Conditions are text typed by an administrator, so they never reach ``F.expr`` unchecked:
each kind accepts a small allow-listed token set and anything else is rejected.

* filter:    ``value <op> number`` terms joined by ``and`` / ``or`` (op: == != > >= < <=);
             rows where the condition holds are dropped.
* derive:    arithmetic (+ - * / parentheses) over ``value``, numbers and listed columns;
             adds a column named after the rule.
* aggregate: one of avg / min / max / sum / count, per (node, time window).
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Resource -> expression over process points.
RESOURCE_SQL = {
    "cpu": "`cpu_ontime_ns`",
    "mem": "`avg_rss_bytes`",
    "gpu": "`gpu_used_memory_mib`",
    "disk": "(`read_bytes` + `write_bytes`)",
    "net": "(`net_rx_bytes` + `net_tx_bytes`)",
}
AGGREGATES = {"avg": F.avg, "min": F.min, "max": F.max, "sum": F.sum, "count": F.count}

_NUM = r"-?[0-9]+(?:\.[0-9]+)?"
_TERM = rf"\s*value\s*(==|!=|>=|<=|>|<)\s*({_NUM})\s*"
_FILTER_RE = re.compile(rf"^{_TERM}(?:(and|or){_TERM})*$", re.IGNORECASE)
_DERIVE_TOKEN = re.compile(rf"\s*(?:({_NUM})|([A-Za-z_][A-Za-z0-9_]*)|([-+*/()]))")


class RuleError(ValueError):
    pass


def filter_condition(text: str, resource: str) -> Column:
    """Compile a filter condition; raises RuleError for anything outside the grammar."""
    if resource not in RESOURCE_SQL:
        raise RuleError(f"unknown resource {resource!r}")
    if not _FILTER_RE.match(text or ""):
        raise RuleError(f"unsupported filter condition {text!r}")
    sql = re.sub(r"\bvalue\b", RESOURCE_SQL[resource], text, flags=re.IGNORECASE).replace("==", "=")
    return F.coalesce(F.expr(sql), F.lit(False))


def derive_expression(text: str, resource: str, columns: Sequence[str]) -> Column:
    """Compile a derive expression over ``value`` and the listed columns."""
    if resource not in RESOURCE_SQL:
        raise RuleError(f"unknown resource {resource!r}")
    out: list[Column | str] = []  # operands as columns, operators and parentheses as text
    pos, s = 0, text or ""
    while pos < len(s):
        m = _DERIVE_TOKEN.match(s, pos)
        if not m or m.end() == pos:
            if s[pos:].strip() == "":
                break
            raise RuleError(f"unsupported derive expression {text!r}")
        num, ident, op = m.groups()
        if ident is not None:
            if ident.lower() == "value":
                out.append(F.expr(RESOURCE_SQL[resource]))
            elif ident in columns:
                out.append(F.col(f"`{ident}`"))
            else:
                raise RuleError(f"unknown name {ident!r} in {text!r}")
        elif num is not None and num.startswith("-") and out and (isinstance(out[-1], Column) or out[-1] == ")"):
            out += ["-", F.expr(num[1:])]  # "a -5" subtracts
        else:
            out.append(F.expr(num) if num is not None else op)
        pos = m.end()
    if not out:
        raise RuleError("empty derive expression")
    rest = out[::-1]
    result = _sum(rest, text)
    if rest:
        raise RuleError(f"unsupported derive expression {text!r}")
    return result


# Arithmetic that gives null where it has no result (zero divisor, overflow), so that a rule
# typed by a user can't stop the job.
_SAFE = {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply, "/": F.try_divide}


def _sum(rest: list, text: str) -> Column:
    left = _product(rest, text)
    while rest and isinstance(rest[-1], str) and rest[-1] in "+-":
        left = _SAFE[rest.pop()](left, _product(rest, text))
    return left


def _product(rest: list, text: str) -> Column:
    left = _operand(rest, text)
    while rest and isinstance(rest[-1], str) and rest[-1] in "*/":
        left = _SAFE[rest.pop()](left, _operand(rest, text))
    return left


def _operand(rest: list, text: str) -> Column:
    token = rest.pop() if rest else ""
    if isinstance(token, Column):
        return token
    if token == "-":
        return F.try_subtract(F.lit(0), _operand(rest, text))
    if token == "(":
        inner = _sum(rest, text)
        if rest and rest.pop() == ")":
            return inner
    raise RuleError(f"unsupported derive expression {text!r}")


def _enabled(rules: Sequence[Mapping], kind: str) -> list[Mapping]:
    return [r for r in rules if r.get("enabled", True) and r["type"] == kind]


def rule_filter(points: DataFrame, rules: Sequence[Mapping]) -> DataFrame:
    """FLT-6: drop rows matching any enabled filter rule (one combined predicate)."""
    conds = [filter_condition(r["condition"], r["resource"]) for r in _enabled(rules, "filter")]
    if not conds:
        return points
    drop = conds[0]
    for c in conds[1:]:
        drop = drop | c
    return points.filter(~drop)


def rule_derive(points: DataFrame, rules: Sequence[Mapping]) -> DataFrame:
    """FLT-7: one new column per enabled derive rule, named by the rule."""
    cols = {r["name"]: derive_expression(r["condition"], r["resource"], points.columns) for r in _enabled(rules, "derive")}
    return points.withColumns(cols) if cols else points


def rule_aggregate(points: DataFrame, rules: Sequence[Mapping], window: str = "1 hour") -> DataFrame:
    """AGG-28: per enabled aggregate rule, the chosen aggregate of the resource per
    (node, tumbling window). One group-by computes all rules; its rows are then unfolded
    into one per rule, so the cost of a scan doesn't grow with the number of rules."""
    found: list[tuple[str, Column]] = []
    for r in _enabled(rules, "aggregate"):
        fn = AGGREGATES.get(str(r["condition"]).strip().lower().replace("(value)", ""))
        if fn is None or r["resource"] not in RESOURCE_SQL:
            raise RuleError(f"unsupported aggregate rule {r!r}")
        e = F.expr(RESOURCE_SQL[r["resource"]])
        # Resources are integer counters: a mean is double(sum) / count, which every engine
        # evaluates with the same two IEEE operations (no order-dependent double sum).
        v = F.try_divide(F.sum(e).cast("double"), F.count(e)) if fn is F.avg else fn(e).cast("double")
        found.append((r["id"], v))
    if not found:
        raise RuleError("no enabled aggregate rule")
    g = points.groupBy("node_id", F.window("ts", window).start.alias("window_start")).agg(
        *[v.alias(f"_v{n}") for n, (_, v) in enumerate(found)])
    rows = F.array(*[F.struct(F.lit(i).alias("rule_id"), F.col(f"_v{n}").alias("value")) for n, (i, _) in enumerate(found)])
    return g.select("node_id", "window_start", F.inline(rows)).select("rule_id", "node_id", "window_start", "value")
