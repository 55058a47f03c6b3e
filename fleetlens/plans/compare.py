"""Order-insensitive result comparison used by the oracle check and the tests."""

from __future__ import annotations

import datetime as dt
import decimal
import math


EXACT = False


def norm(v):
    """Comparable form of one value: floats at 10 significant digits (bit-exact when
    ``EXACT``), maps as sorted pairs, timestamps as ISO text."""
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return v if EXACT else float(f"{v:.10g}")
    if isinstance(v, decimal.Decimal):
        return float(f"{float(v):.10g}")
    if isinstance(v, dt.datetime):
        return v.isoformat(sep=" ")
    if isinstance(v, dt.date):
        return v.isoformat()
    if isinstance(v, int):
        return v
    if isinstance(v, dict):
        return tuple(sorted((str(k), norm(x)) for k, x in v.items()))
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return str(v)


def rows_key(rows):
    return sorted((tuple(norm(x) for x in r) for r in rows), key=repr)


def compare(spark_cols, spark_rows, duck_cols, duck_rows) -> list[str]:
    """Problems found (empty list = equal)."""
    msgs = []
    if sorted(spark_cols) != sorted(duck_cols):
        msgs.append(f"cols spark={spark_cols} duck={duck_cols}")
        return msgs
    if len(spark_rows) != len(duck_rows):
        msgs.append(f"rows spark={len(spark_rows)} duck={len(duck_rows)}")
        return msgs
    order = [duck_cols.index(c) for c in spark_cols]
    d2 = [tuple(r[i] for i in order) for r in duck_rows]
    sk, dk = rows_key(spark_rows), rows_key(d2)
    if sk != dk:
        diff = [(x, y) for x, y in zip(sk, dk) if x != y][:2]
        msgs.append(f"values differ e.g. {diff}")
    return msgs


# Spark simple type -> DuckDB type name of the same values.
DUCK_TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
              "timestamp_ntz": "TIMESTAMP", "boolean": "BOOLEAN", "map<string,string>": "MAP(VARCHAR, VARCHAR)",
              "date": "DATE"}


def type_problems(df, con, sql_text: str) -> list[str]:
    """Column types of a Spark result against the DuckDB result types of the oracle."""
    duck = {r[0]: r[1] for r in con.execute(f"DESCRIBE {sql_text}").fetchall()}
    out = []
    for f in df.schema.fields:
        s = DUCK_TYPES.get(f.dataType.simpleString(), f.dataType.simpleString())
        if duck.get(f.name) != s:
            out.append(f"type {f.name}: spark={s} duck={duck.get(f.name)}")
    return out
