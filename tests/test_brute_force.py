"""Period metrics against a plain-Python brute force of the window rules on
random facts: NULL keys, NULL and negative amounts, gaps, month-end anchors
(31st after a 30-day month, leap February)."""

import calendar
import datetime as dt
import random
from decimal import Decimal

import pytest

from ledgerlens.operators import costs as C

SCHEMA = "date date, account string, service string, amount double"


def _facts(seed=7, n=1500):
    rng = random.Random(seed)
    start = dt.date(2022, 11, 1)
    rows = []
    for _ in range(n):
        d = start + dt.timedelta(days=rng.randrange(0, 560))
        acc = rng.choice(["a", "b", "c", None])
        svc = rng.choice(["x", "y", "z", None])
        amt = rng.choice([None, round(rng.uniform(-50, 500), 2), round(rng.uniform(0, 5), 2)])
        rows.append((d, acc, svc, amt))
    return rows


def _shift(m0, k):
    idx = m0.year * 12 + m0.month - 1 - k
    return dt.date(idx // 12, idx % 12 + 1, 1)


def _month_end(d):
    return d.replace(day=calendar.monthrange(d.year, d.month)[1])


def _sum(rows):
    vals = [Decimal(str(r[3])) for r in rows if r[3] is not None]
    return float(sum(vals)) if vals else None


def _brute(rows, anchor=None, month=None):
    """Window definitions written out one by one, as separate queries joined on keys."""
    if month is not None:
        m0 = month
        cur_lo, cur_hi = m0, _month_end(m0)
        dom = None
    else:
        m0 = anchor.replace(day=1)
        cur_lo, cur_hi = m0, anchor
        dom = anchor.day

    def window(i):
        ms = _shift(m0, i)
        if dom is None:
            return ms, _month_end(ms)
        return ms, min(_month_end(ms), ms + dt.timedelta(days=dom - 1))

    keys = {(r[1], r[2]) for r in rows if cur_lo <= r[0] <= cur_hi}
    out = {}
    for key in keys:
        def sel(lo, hi, key=key):
            # an earlier period joins on the key, so NULL keys find nothing
            if None in key:
                return []
            return [r for r in rows if (r[1], r[2]) == key and lo <= r[0] <= hi]

        cur = _sum([r for r in rows if (r[1], r[2]) == key and cur_lo <= r[0] <= cur_hi])
        prev = [_sum(sel(*window(i))) for i in range(1, 6)]
        avgs = []
        for n in (6, 12):
            months = []
            for i in range(1, n + 1):
                ms = _shift(m0, i)
                hi = _month_end(ms) if dom is None else ms.replace(day=min(dom, _month_end(ms).day))
                months.append(_sum(sel(ms, hi)))
            present = [Decimal(str(v)) for v in months if v is not None]
            avgs.append(float(sum(present)) / len(present) if present else None)
        out[key] = (cur, *prev, *avgs)
    return out


@pytest.mark.parametrize(
    "anchor",
    ["2024-03-31", "2024-02-29", "2024-01-31", "2023-12-15", "2024-05-01", "2023-10-30"],
)
def test_capped_metrics_match_brute_force(spark, anchor):
    rows = _facts()
    a = dt.date.fromisoformat(anchor)
    got = {
        (r["account"], r["service"]): tuple(r[c] for c in C.VALUE_COLUMNS)
        for r in C.period_metrics(spark.createDataFrame(rows, SCHEMA), a, money_scale=2).collect()
    }
    want = _brute(rows, anchor=a)
    assert got.keys() == want.keys()
    for k in want:
        for g, w in zip(got[k], want[k]):
            assert (g is None and w is None) or abs(g - w) <= 1e-9 * max(1.0, abs(w)), (k, got[k], want[k])


@pytest.mark.parametrize("month", ["2024-03-01", "2024-02-01", "2023-12-01"])
def test_full_month_metrics_match_brute_force(spark, month):
    rows = _facts(seed=11)
    m = dt.date.fromisoformat(month)
    got = {
        (r["account"], r["service"]): tuple(r[c] for c in C.VALUE_COLUMNS)
        for r in C.period_metrics_for_month(spark.createDataFrame(rows, SCHEMA), m, money_scale=2).collect()
    }
    want = _brute(rows, month=m)
    assert got.keys() == want.keys()
    for k in want:
        for g, w in zip(got[k], want[k]):
            assert (g is None and w is None) or abs(g - w) <= 1e-9 * max(1.0, abs(w)), (k, got[k], want[k])


def test_many_anchors_match_brute_force(spark):
    rows = _facts(seed=3)
    anchors = [("a", dt.date(2024, 3, 31)), ("a", dt.date(2024, 2, 29)), ("b", dt.date(2024, 1, 17)), ("c", dt.date(2023, 12, 31))]
    df = C.period_metrics_for_anchors(
        spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(anchors, "account string, anchor_date date"), money_scale=2
    )
    got = {(r["account"], r["anchor_date"], r["service"]): tuple(r[c] for c in C.VALUE_COLUMNS) for r in df.collect()}
    want = {}
    for acc, a in anchors:
        for (k_acc, svc), vals in _brute(rows, anchor=a).items():
            if k_acc == acc:
                want[(acc, a, svc)] = vals
    assert got.keys() == want.keys()
    for k in want:
        for g, w in zip(got[k], want[k]):
            assert (g is None and w is None) or abs(g - w) <= 1e-9 * max(1.0, abs(w)), (k, got[k], want[k])
