"""Chart shaping kept as data work."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DAY_S = 86400


def _span_seconds(start, end) -> float:
    import datetime as dt
    a = dt.datetime.fromisoformat(str(start))
    b = dt.datetime.fromisoformat(str(end))
    return (b - a).total_seconds()


def chart_labels(series: DataFrame, start, end, col: str = "t") -> DataFrame:
    """SCL-10: usage-chart label by the selected span (<= 24 h 'HH:mm', <= 7 d
    'dd/MM HH:00', longer 'dd/MM'), next to the other forms and the node-page label
    ('HH:mm' up to two days, then 'MM-dd HH:00')."""
    span = _span_seconds(start, end)
    t = F.col(col)
    short, week, long = F.date_format(t, "HH:mm"), F.date_format(t, "dd/MM HH:00"), F.date_format(t, "dd/MM")
    label = short if span <= DAY_S else (week if span <= 7 * DAY_S else long)
    node = short if span <= 2 * DAY_S else F.date_format(t, "MM-dd HH:00")
    return series.select(t.alias("t"), label.alias("label"), week.alias("label_week"), long.alias("label_long"),
                         node.alias("node_label"))
