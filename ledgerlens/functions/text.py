"""Report text and class columns, as native Spark expressions.

Numbers print with ``.`` for thousands and ``,`` for decimals (Italian
style); month labels are Italian.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Italian month names, January first.
MONTH_NAMES_IT = (
    "gennaio", "febbraio", "marzo", "aprile", "maggio", "giugno",
    "luglio", "agosto", "settembre", "ottobre", "novembre", "dicembre",
)
# Cost report row labels and the current-period label.
ROW_LABELS = (
    ("mtd", "Mese corrente"),
    ("prev_mtd", "Mese precedente"),
    ("prev2_mtd", "2 mesi fa"),
    ("prev3_mtd", "3 mesi fa"),
    ("prev4_mtd", "4 mesi fa"),
    ("avg6", "Media 6M"),
    ("avg12", "Media 12M"),
)
CURRENT_PERIOD_LABEL = "Stato attuale"
# Months back from the anchor month for the month rows.
MONTH_ROWS = (("mtd", 0), ("prev_mtd", 1), ("prev2_mtd", 2), ("prev3_mtd", 3), ("prev4_mtd", 4))


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _number(x: Column | str) -> Column:
    """As a double; NaN is no number here, as in the reports."""
    v = _c(x).cast("double")
    return F.when(~F.isnan(v), v)


def format_number_it(x: Column | str, decimals: int = 2, sign: bool = False) -> Column:
    """``1234567.5`` -> ``1.234.567,50``; ``+`` before non-negative values
    when ``sign``; empty text for NULL and NaN."""
    v = _number(x)
    body = F.translate(F.format_number(v, decimals), ",.", ".,")
    if sign:
        body = F.when(v >= 0, F.concat(F.lit("+"), body)).otherwise(body)
    return F.coalesce(body, F.lit(""))


def format_count_it(x: Column | str, decimals: int = 0, sign: bool = False) -> Column:
    """Pod form of :func:`format_number_it`: prints ``0`` when the value
    rounds to zero."""
    v = _number(x)
    return F.when(v.isNull(), F.lit("")).when(F.bround(v, decimals) == 0, F.lit("0")).otherwise(
        format_number_it(v, decimals, sign)
    )


def cost_cell_text(value: Column | str, pct: Column | str) -> Column:
    """Value, then a new line and the signed percentage with one decimal;
    the value only when there is no percentage; empty without a value."""
    v, p = _number(value), _number(pct)
    pct_text = F.concat(format_number_it(p * 100, 1, sign=True), F.lit("%"))
    return (
        F.when(v.isNull(), F.lit(""))
        .when(p.isNull(), format_number_it(v, 2))
        .otherwise(F.concat(format_number_it(v, 2), F.lit("\n"), pct_text))
    )


def pct_text(pct: Column | str) -> Column:
    """Signed percentage: no decimals from 1 % up, else one decimal."""
    d = _number(pct) * 100
    return F.when(d.isNull(), F.lit("")).otherwise(
        F.concat(
            F.when(F.abs(d) >= 1, format_count_it(d, 0, sign=True)).otherwise(format_count_it(d, 1, sign=True)),
            F.lit("%"),
        )
    )


def share_pct_text(value: Column | str, total: Column | str) -> Column:
    """Share of a total as a percentage; empty without a positive total."""
    v, t = _number(value), _number(total)
    s = v / t * 100
    ok = v.isNotNull() & t.isNotNull() & (t > 0)
    return F.when(~ok | v.isNull() | t.isNull(), F.lit("")).otherwise(
        F.concat(F.when(F.abs(s) >= 1, format_count_it(s, 0)).otherwise(format_count_it(s, 1)), F.lit("%"))
    )


def trend_class(delta: Column | str, pct: Column | str) -> Column:
    """Sign of the delta, else of the pct: pos / neg / neutral, or empty."""
    d, p = _number(delta), _number(pct)
    return (
        F.when(d > 0, "pos")
        .when(d < 0, "neg")
        .when(d == 0, "neutral")
        .when(p > 0, "pos")
        .when(p < 0, "neg")
        .when(p == 0, "neutral")
        .otherwise("")
    )


def cost_pct_class(pct: Column | str) -> Column:
    """Cost report class from the pct only: negative -> neg, else pos; empty for NULL."""
    p = _number(pct)
    return F.when(p.isNull(), "").when(p < 0, "neg").otherwise("pos")


def share_class(value: Column | str, total: Column | str) -> Column:
    v, t = _number(value), _number(total)
    share = F.when(v.isNotNull() & t.isNotNull() & (t > 0), v / t)
    return (
        F.when(share.isNull(), "neutral").when(share >= 0.75, "pos").when(share >= 0.30, "warn").otherwise("neg")
    )


def month_label(d: Column | str, month_names: tuple[str, ...] = MONTH_NAMES_IT) -> Column:
    """``Marzo 2001`` for any day in March 2001 (names capitalised; another
    list of twelve names, January first, may be given)."""
    c = _c(d)
    names = F.array(*[F.lit(n[0].upper() + n[1:]) for n in month_names])
    return F.concat(F.element_at(names, F.month(c)), F.lit(" "), F.year(c).cast("string"))


def period_label(option: Column | str) -> Column:
    """``current`` -> current-period label; ``month:YYYY-MM-DD`` -> month label;
    anything unparseable is shown as is."""
    o = _c(option)
    d = F.try_to_date(F.substring_index(o, ":", -1))
    return (
        F.when(o == "current", F.lit(CURRENT_PERIOD_LABEL))
        .when(o.startswith("month:") & d.isNotNull(), month_label(d))
        .otherwise(o)
    )


def row_label_columns(anchor: Column | str) -> list[Column]:
    """One label column per report row: month rows name their month counted
    back from the anchor's month; average rows keep their fixed label.
    Without an anchor every row keeps its fixed label."""
    a = _c(anchor)
    fixed = dict(ROW_LABELS)
    cols = []
    for metric, _ in ROW_LABELS:
        back = dict(MONTH_ROWS).get(metric)
        if back is None:
            cols.append(F.lit(fixed[metric]).alias(f"label_{metric}"))
        else:
            m = F.add_months(F.trunc(a, "MM"), -back)
            cols.append(F.coalesce(month_label(m), F.lit(fixed[metric])).alias(f"label_{metric}"))
    return cols
