"""Column-level helpers: labels, decodes and signed amounts.

All helpers return ``Column`` expressions made of built-in functions, so they
stay inside whole-stage codegen; none is a Python UDF.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"
TOTAL = "decimal(38,2)"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def concat_nn(*parts) -> Column:
    """NULL-tolerant CONCAT (a NULL part counts as empty, like SQL Server's CONCAT)."""
    return F.concat_ws("", *[_c(p) if not isinstance(p, Column) else p for p in parts])


def text(s: str) -> Column:
    return F.lit(s)


# D1 ---------------------------------------------------------------------------
def fiscal_period(year_name, period) -> Column:
    """``FY2025-05``: year name, dash, period zero-padded to two digits.

    Periods of 10 or more are printed as they are; a NULL year name still
    yields ``-05`` (NULL-tolerant concatenation).
    """
    p = _c(period)
    digits = F.when(p < 10, F.concat(F.lit("0"), p.cast("string"))).otherwise(p.cast("string"))
    return F.concat_ws("", _c(year_name), F.lit("-"), digits)


# D2 ---------------------------------------------------------------------------
def fiscal_quarter_label(period) -> Column:
    p = _c(period)
    return (
        F.when(p.between(1, 3), "Q1")
        .when(p.between(4, 6), "Q2")
        .when(p.between(7, 9), "Q3")
        .when(p.between(10, 12), "Q4")
    )


# D10 --------------------------------------------------------------------------
# Account type codes, names and report order.
ACCOUNT_TYPE_NAMES = {"A": "Asset", "E": "Expense", "L": "Liability", "R": "Revenue"}
ACCOUNT_TYPE_ORDER = {"A": 1, "L": 2, "R": 3, "E": 4}
UNKNOWN_ACCOUNT_TYPE = "Unknown Account Type"


def _decode(col: Column, mapping: dict, default=None) -> Column:
    items = list(mapping.items())
    expr = F.when(col == F.lit(items[0][0]), F.lit(items[0][1]))
    for k, v in items[1:]:
        expr = expr.when(col == F.lit(k), F.lit(v))
    return expr.otherwise(F.lit(default)) if default is not None else expr


def account_type_name(t) -> Column:
    return _decode(_c(t), ACCOUNT_TYPE_NAMES, UNKNOWN_ACCOUNT_TYPE)


def account_type_order(t) -> Column:
    return _decode(_c(t), ACCOUNT_TYPE_ORDER)


# D11 --------------------------------------------------------------------------
# General-ledger feature codes (code, description).  12 is absent.
GL_FEATURES = {
    0: ("VI", "Vendor Invoice"),
    1: ("VP", "Vendor Payment"),
    2: ("F2", "Unknown Feature 2"),
    3: ("CP", "Customer Payment"),
    4: ("D", "Deposit"),
    5: ("JE", "Journal Entry"),
    6: ("BR", "Billing and Revenue Post"),
    7: ("CI", "Invoice"),
    8: ("LC", "Labor Cost Post"),
    9: ("EC", "Expense Report Cost Post"),
    10: ("FY", "General Ledger Closing"),
    11: ("AL", "Cost Pool Post"),
    13: ("FA", "Fixed Asset Post"),
    14: ("PILOB", "Pay in Lieu of Benefits"),
}
UNKNOWN_DOC_TYPE = "Unknown Document Type"


def gl_doc_type(feature) -> Column:
    return _decode(_c(feature), {k: v[0] for k, v in GL_FEATURES.items()}, UNKNOWN_DOC_TYPE)


def gl_doc_type_description(feature) -> Column:
    return _decode(_c(feature), {k: v[1] for k, v in GL_FEATURES.items()}, UNKNOWN_DOC_TYPE)


# D12 --------------------------------------------------------------------------
def signed_amount(acct_type, debit, credit, credit_normal=("R",), debit_normal=None) -> Column:
    """Amount signed by the account's normal balance.

    ``credit_normal`` types give credit - debit.  With ``debit_normal=None``
    every other type gives debit - credit (budget view form); otherwise only
    the listed types do and the rest give 0 (KPI and balance forms).
    Both sides are cast to DECIMAL(18,2) before subtracting.
    """
    t, d, c = _c(acct_type), _c(debit).cast(MONEY), _c(credit).cast(MONEY)
    expr = F.when(t.isin(*credit_normal), c - d)
    if debit_normal is None:
        return expr.otherwise(d - c)
    return expr.when(t.isin(*debit_normal), d - c).otherwise(F.lit(0).cast(MONEY))


# F11 --------------------------------------------------------------------------
def round_to_scale(x, scale, max_scale: int = 6, out_type: str = MONEY) -> Column:
    """ROUND with a scale held in a column (Spark's ``round`` needs a literal)."""
    xv, s = _c(x), _c(scale)
    expr = F.when(s == 0, F.round(xv, 0).cast(out_type))
    for k in range(1, max_scale + 1):
        expr = expr.when(s == k, F.round(xv, k).cast(out_type))
    # a finer scale than the amounts carry changes nothing; a null scale gives null
    return expr.when(s > max_scale, xv.cast(out_type))


# F12 --------------------------------------------------------------------------
def zero_pad_right(x, width: int = 10) -> Column:
    """RIGHT(REPLICATE('0', w) + x, w): keeps the *tail* when x is longer than w."""
    s = F.concat(F.repeat(F.lit("0"), width), _c(x).cast("string"))
    return F.substring(s, -width, width)


# P13 --------------------------------------------------------------------------
def blank_or_in(col, values) -> Column:
    """True when the column is NULL or blank, or equals one of ``values``."""
    c = _c(col)
    blank = F.coalesce(c.cast("string"), F.lit("")) == F.lit("")
    return blank | c.isin(*values) if values else blank


# D36a -------------------------------------------------------------------------
# Aging bucket labels, oldest first, with their day offsets.
AGING_BUCKETS = [
    (90, "90+ days past due"),
    (60, "61-90 days past due"),
    (30, "31-60 days past due"),
    (0, "1-30 days past due"),
]
AGING_CURRENT = "Current"


def aging_bucket(due_date, as_of: str) -> Column:
    """Aging bucket of a due date against an ``as_of`` timestamp.

    A due date strictly before ``as_of - n days`` falls in the bucket; since
    ``as_of`` carries a time of day, a due date exactly 90 days back is 90+
    and one due today is 1-30.  NULL due dates are Current.
    """
    due = _c(due_date).cast("timestamp_ntz")
    ts = F.lit(as_of).cast("timestamp_ntz")
    expr = None
    for days, label in AGING_BUCKETS:
        cond = due < (ts - F.expr(f"INTERVAL {days} DAYS")) if days else due < ts
        expr = F.when(cond, label) if expr is None else expr.when(cond, label)
    return expr.otherwise(AGING_CURRENT)


# D37m -------------------------------------------------------------------------
def matching_type(task_billing_type, project_billing_type) -> Column:
    bt = F.coalesce(_c(task_billing_type), _c(project_billing_type))
    return F.when(bt.isin(1, 3), "AUTO").when(bt == 2, "MANUAL").otherwise("NA")


def coalesce_all(*cols) -> Column:
    return reduce(lambda a, b: F.coalesce(a, b), [_c(c) for c in cols])
