"""Zero-filled balances: grid (D20), running balance (D21), YTD (D22), begin/end balances (D23), statement.

Plan, and why it scales:

* One scan of the GL, or none where its monthly sums are stored
  (``LedgerStore``).  It is summed per (account, org, month, currency pair)
  with partial aggregation before the shuffle; what follows works on these
  monthly rows, dealt once by (account, org).  Running sums, year-to-date
  sums, neighbours and currency sets are windows over that layout and need no
  further exchange; a window partition holds at most months x currency pairs
  rows however many GL lines one hot key has.
* Balances are kept as *change points*: a row per posted month with the
  balances it leads to and the month of the next change.  Only change points
  are shuffled and sorted.  The months between two of them are written out
  last, by exploding the interval where it lies, so the zero-filled grid of
  D21-D23 is neither joined to the GL nor shuffled.
* A month without postings holds one row for each currency pair (k) of its
  key, a posted month one.  D22 reports k x YTD for the former (the
  reference's inequality self join counts each row) and D23 pairs every row
  of a month with every row of the month before; both factors are known at
  the change point, so neither needs a join.  The copies are made last, from
  a struct of finished values, so that none is computed for each copy.
* D20 alone needs no amounts: the posted months of a key are the bits of
  ``bit_or`` over its GL rows, and its gaps are the bits that are not set.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import MONEY, TOTAL, account_type_name, account_type_order
from .calendar import fiscal_calendar, trailing_years
from .joins import held
from .ledger import finance_filter, gl_detail, orgs_with_entity

KEY = ["account_key", "org_key"]
#: Months in one word of a key's bitmap.
WORD = 62


def _calendar(lg) -> DataFrame:
    """The fiscal calendar with each month's place (``ord``, from 1) in date order."""
    cal = fiscal_calendar(lg.fiscal_month, lg.fiscal_quarter, lg.fiscal_year)
    return cal.withColumn("ord", F.row_number().over(Window.orderBy("begin_date")))


def _first_months(cal: DataFrame, as_of: str, years: int) -> Column:
    """(first, last): places of the first month from ``as_of - years`` on (null: none) and of the last month."""
    return cal.agg(F.struct(F.min(F.when(trailing_years("begin_date", as_of, years), F.col("ord"))).alias("first"),
                            F.max("ord").alias("last")).alias("m")).scalar()


def _places(lo: Column, hi: Column) -> Column:
    """lo, lo + 1 ... hi; none if lo is after hi or either is null."""
    return F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.array().cast("array<int>"))


def zero_fill_grid(lg, as_of: str, years: int = 4) -> DataFrame:
    """(account, org, currency pair) x months >= as_of - years, minus months with GL rows.

    The posted months of a key are bits, ``WORD`` to a numbered word; one pass
    over the GL sets them beside the key's currency pairs.
    """
    cal = _calendar(lg).filter(trailing_years("begin_date", as_of, years))
    cal = cal.withColumn("ord", F.row_number().over(Window.orderBy("begin_date")) - 1)
    month_list = cal.agg(F.array_sort(F.collect_list(F.struct(
        "ord", "fiscal_month_key", "fiscal_year_key", "begin_date", "end_date"))).alias("m")).select("m").scalar()
    gl = getattr(lg, "movements", None)
    if gl is None:
        gl = lg.general_ledger.withColumnRenamed("organization_key", "org_key")
    gl = gl.select(*KEY, "transaction_currency", "local_currency", "fiscal_month_key")
    gl = gl.join(F.broadcast(cal.select("fiscal_month_key", "ord")), "fiscal_month_key", "left")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("ord", F.lit(WORD)))
    posted = gl.groupBy(*KEY, "transaction_currency", "local_currency", F.floor(F.col("ord") / WORD).alias("word")).agg(
        F.bit_or(bit).alias("bits"))
    keys = posted.groupBy(*KEY).agg(
        F.collect_set(F.struct("transaction_currency", "local_currency")).alias("pairs"),
        F.collect_set(F.when(F.col("word").isNotNull(), F.struct("word", "bits"))).alias("posted"))
    gap = ~F.exists("posted", lambda p: (p["word"] == F.floor(F.col("_m.ord") / WORD))
                    & (F.call_function("getbit", p["bits"], F.pmod(F.col("_m.ord"), F.lit(WORD))) == 1))
    return (keys.join(lg.account.select("account_key", F.col("type").alias("acc_type")), "account_key")
            .select("*", F.explode(month_list).alias("_m")).filter(gap)
            .select("*", F.inline("pairs"))
            .select(*KEY, "_m.fiscal_month_key", "_m.fiscal_year_key", "_m.begin_date", "_m.end_date",
                    F.lit(0).cast(MONEY).alias("amount"), F.lit(0).cast(MONEY).alias("local_amount"),
                    "transaction_currency", "local_currency", "acc_type"))


def sum_movements(general_ledger: DataFrame) -> DataFrame:
    """Debit minus credit per (account, org, month, currency pair): the one scan of the GL."""
    net = lambda d, c: F.sum(F.col(d).cast(MONEY) - F.col(c).cast(MONEY))
    return (general_ledger.groupBy("account_key", F.col("organization_key").alias("org_key"), "fiscal_month_key",
                                   "transaction_currency", "local_currency")
            .agg(net("debit_amount", "credit_amount").alias("net"),
                 net("local_debit_amount", "local_credit_amount").alias("local_net")))


def monthly_movements(lg) -> DataFrame:
    """The movements of a ledger, dealt by (account, org): read where they are stored so, else summed from the GL."""
    stored = getattr(lg, "movements", None)
    return stored if stored is not None else sum_movements(lg.general_ledger).repartition(*KEY)


def change_points(lg, types=("A", "L", "E", "R"), orgs: DataFrame | None = None) -> DataFrame:
    """Balances per (account, org) as intervals: a row per posted month (``ord``) up to the next one (``next_ord``).

    ``run`` and ``ytd`` (and ``local_``) are the balances the month leads to,
    ``was_run`` and ``was_ytd`` those before it; ``pairs`` are the key's
    currency pairs, ``top_transaction`` and ``top_local`` the largest of each
    side.  A key none of whose months is in the calendar keeps one row with a
    null ``ord``: it has pairs but no balance.  ``orgs`` (org_key) leaves only
    keys of these.
    """
    sign = F.when(F.col("acc_type").isin("E", "A"), F.lit(1)).when(F.col("acc_type").isin("R", "L"), F.lit(-1)).otherwise(F.lit(0))
    cal = F.broadcast(_calendar(lg).select("fiscal_month_key", "fiscal_year_key", "ord"))
    a = lg.account.select("account_key", F.col("type").alias("acc_type")).filter(F.col("acc_type").isin(*types))
    moves = monthly_movements(lg)
    if orgs is not None:
        moves = moves.join(orgs, "org_key", "left_semi")
    months = (moves.groupBy(*KEY, "fiscal_month_key")
              .agg(F.sum("net").alias("net"), F.sum("local_net").alias("local_net"),
                   F.max("transaction_currency").alias("transaction_currency"), F.max("local_currency").alias("local_currency"),
                   F.collect_set(F.struct("transaction_currency", "local_currency")).alias("pairs"))
              .join(cal, "fiscal_month_key", "left").join(a, "account_key"))
    by_month = Window.partitionBy(*KEY).orderBy(F.col("ord").asc_nulls_last())
    so_far = by_month.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    yearly = Window.partitionBy(*KEY, "fiscal_year_key").orderBy(F.col("ord").asc_nulls_last())
    whole = by_month.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    dated = lambda c: F.when(F.col("ord").isNotNull(), F.col(c) * sign).otherwise(F.lit(0).cast(MONEY))
    months = months.withColumns({"amount": dated("net"), "local_amount": dated("local_net")})
    points = months.select(
        *KEY, "acc_type", "ord", "fiscal_year_key", "transaction_currency", "local_currency", "amount", "local_amount",
        F.collect_set("pairs").over(whole).alias("_pairs"), F.count("ord").over(whole).alias("dated"),
        F.max("transaction_currency").over(whole).alias("top_transaction"), F.max("local_currency").over(whole).alias("top_local"),
        F.row_number().over(by_month).alias("nth"), F.lead("ord").over(by_month).alias("next_ord"), F.lag("ord").over(by_month).alias("was_ord"),
        F.lag("fiscal_year_key").over(by_month).alias("was_year"),
        F.sum("amount").over(so_far).cast(TOTAL).alias("run"), F.sum("local_amount").over(so_far).cast(TOTAL).alias("local_run"),
        F.sum("amount").over(yearly).cast(TOTAL).alias("ytd"), F.sum("local_amount").over(yearly).cast(TOTAL).alias("local_ytd"))
    return points.select(
        "*", F.array_distinct(F.flatten("_pairs")).alias("pairs"), (F.col("run") - F.col("amount")).cast(TOTAL).alias("was_run"),
        (F.col("local_run") - F.col("local_amount")).cast(TOTAL).alias("local_was_run"),
        F.lag("ytd").over(by_month).alias("was_ytd"), F.lag("local_ytd").over(by_month).alias("local_was_ytd"),
    ).filter(F.col("ord").isNotNull() | ((F.col("dated") == 0) & (F.col("nth") == 1))).drop("_pairs")


def monthly_balances(lg, as_of: str, types, years: int = 4, report_years: int | None = None,
                     exact_duplicates: bool = True, orgs: DataFrame | None = None) -> DataFrame:
    """Change points written out by month: posted months, and from ``as_of - years`` on also those between them.

    A row per (account, org, month) that has a next month.  ``balance`` is what
    it carries into that month before a year's reset, ``begin`` what was carried
    into it; ``rows`` and ``begin_rows`` say how many rows of the reference's
    grid this month and the one before have, ``entries`` holds the currency
    pairs of its own.  ``report_years`` leaves only months whose next month
    starts from ``as_of - report_years`` on.
    """
    cal = _calendar(lg)
    bounds = _first_months(cal, as_of, years)
    months = cal.filter(F.col("next_month_key").isNotNull())
    gaps_from = bounds["first"]
    if report_years is not None:
        starts = cal.select(F.col("fiscal_month_key").alias("next_month_key"), F.col("begin_date").alias("next_begin"))
        months = (months.join(F.broadcast(starts), "next_month_key")
                  .filter(trailing_years("next_begin", as_of, report_years)).drop("next_begin"))
        shown = months.agg(F.min("ord").alias("m")).scalar()
        gaps_from = F.greatest(gaps_from, shown)
    months = F.broadcast(months.select(
        F.col("ord").alias("m"), "fiscal_month_key", "period_number", "fiscal_year_key", "prev_fiscal_year_key", "prev_month_key",
        "next_month_key", "next_period_number"))
    p = change_points(lg, types, orgs).withColumnRenamed("fiscal_year_key", "year")
    o = F.col("ord")
    after = F.coalesce(F.col("next_ord"), bounds["last"] + 1)
    gaps = _places(F.greatest(gaps_from, F.when(F.col("nth") > 1, o + 1).otherwise(gaps_from)), after - 1)
    own = F.when(o.isNotNull(), F.array(o)).otherwise(F.array().cast("array<int>"))
    x = p.select("*", F.explode(F.array_union(own, gaps)).alias("m")).join(months, "m")
    k = F.size("pairs")
    moved, early = F.coalesce(F.col("m") == o, F.lit(False)), F.coalesce(F.col("m") < o, F.lit(True))
    sheet = F.col("acc_type").isin("A", "L")
    zero, times = F.lit(0).cast(TOTAL), (k if exact_duplicates else F.lit(1))

    def now(run, ytd):
        gap = F.when(F.col("fiscal_year_key") == F.col("year"), (F.col(ytd) * times).cast(TOTAL)).otherwise(zero)
        return F.when(early, zero).when(sheet, F.col(run)).when(moved, F.col(ytd)).otherwise(gap)

    before = F.col("m") - 1
    in_grid = F.coalesce(before >= bounds["first"], F.lit(False))
    was_moved = F.when(moved, before == F.col("was_ord")).when(early, F.lit(False)).otherwise(before == o)
    was_moved = F.coalesce(was_moved, F.lit(False))

    def was(run, ytd, was_run, was_ytd):
        mine = lambda value, year: F.when(was_moved, F.col(value)).when(
            F.col("prev_fiscal_year_key") == F.col(year), (F.col(value) * times).cast(TOTAL)).otherwise(zero)
        income = F.when(F.col("period_number") == 1, zero).when(moved, mine(was_ytd, "was_year")).otherwise(mine(ytd, "year"))
        return F.coalesce(F.when(early, zero).when(sheet, F.when(moved, F.col(was_run)).otherwise(F.col(run))).otherwise(income), zero)

    entry = lambda t, c: F.array(F.struct(F.col(t).alias("transaction_currency"), F.col(c).alias("local_currency")))
    entries = (F.when(moved, entry("transaction_currency", "local_currency")).when(sheet, F.col("pairs"))
               .otherwise(entry("top_transaction", "top_local")))
    begin_rows = (F.when(F.col("prev_month_key").isNull() | ~(was_moved | in_grid), F.lit(0))
                  .when(was_moved | ~sheet, F.lit(1)).otherwise(k))
    return x.select(
        *KEY, "acc_type", "fiscal_month_key", "next_month_key", "next_period_number",
        now("run", "ytd").alias("balance"), now("local_run", "local_ytd").alias("local_balance"),
        was("run", "ytd", "was_run", "was_ytd").alias("begin"),
        was("local_run", "local_ytd", "local_was_run", "local_was_ytd").alias("local_begin"),
        begin_rows.alias("begin_rows"), entries.alias("entries"))


def _carried(balances: DataFrame) -> DataFrame:
    """Rows of D21/D22: each month's balance carried into the next, an income balance reset where a year begins."""
    reset = F.col("acc_type").isin("E", "R") & (F.col("next_period_number") == 1)
    amount = lambda c: F.when(reset, F.lit(0).cast(TOTAL)).otherwise(F.col(c))
    return balances.select("*", F.inline("entries")).select(
        *KEY, F.col("acc_type").alias("account_type"), F.col("next_month_key").alias("fiscal_month_key"),
        F.col("fiscal_month_key").alias("prev_fiscal_month_key"),
        amount("balance").alias("amount"), F.col("balance").alias("amount_c"),
        amount("local_balance").alias("local_amount"), F.col("local_balance").alias("local_amount_c"),
        "transaction_currency", "local_currency")


def running_balance(lg, as_of: str) -> DataFrame:
    """Balance-sheet (A/L) running balance carried into the next month."""
    return _carried(monthly_balances(lg, as_of, ("A", "L")))


def ytd_balance(lg, as_of: str, exact_duplicates: bool = True) -> DataFrame:
    """Income (E/R) year-to-date balance carried into the next month, reset at period 1.

    ``exact_duplicates`` keeps the reference's factor: a zero-filled month
    with k currency pairs reports k x YTD.  ``False`` gives the plain YTD.
    """
    return _carried(monthly_balances(lg, as_of, ("E", "R"), exact_duplicates=exact_duplicates))


def totals(lg, as_of: str, exact_duplicates: bool = True) -> DataFrame:
    return _carried(monthly_balances(lg, as_of, ("A", "L", "E", "R"), exact_duplicates=exact_duplicates))


STATEMENT_COLUMNS = [
    "general_ledger_key", "account_key", "customer_key", "organization_key", "project_key", "person_key",
    "fiscal_month_key", "account_code", "acct_description", "acct_type", "acct_type_order", "credit_amount",
    "customer_vendor_code", "customer_vendor_name", "debit_amount", "gl_description", "doc_number", "doc_key",
    "doc_type", "doc_type_description", "fin_org_code", "fin_org_name", "fiscal_period", "post_date", "quantity",
    "transaction_date", "le_org_code", "le_org_name", "person_first_name", "person_last_name",
    "person_middle_initial", "proj_code", "proj_org_code", "proj_org_name", "proj_owning_org_code",
    "proj_owning_org_name", "reference", "beginning_balance", "ending_balance", "transaction_currency_code",
    "local_currency_code", "local_beginning_balance", "local_credit_amount", "local_debit_amount",
    "local_ending_balance",
]


def period_balances(lg, as_of: str, years: int = 3, exact_duplicates: bool = True, orgs: DataFrame | None = None) -> DataFrame:
    """beginning/ending balance rows per (account, org, month), statement schema.

    A month's rows are its currency entries, each once for every row of the
    month before.  Lookups meet the months and the entries; the copies are
    written out last.  ``orgs`` (rows of the organizations) leaves only
    balances of these.
    """
    near = held(lg.customer)
    allowed = None if orgs is None else near(orgs.select(F.col("customer_key").alias("org_key")).distinct())
    x = monthly_balances(lg, as_of, ("A", "L", "E", "R"), report_years=years, exact_duplicates=exact_duplicates, orgs=allowed)
    reset = F.col("acc_type").isin("E", "R") & (F.col("next_period_number") == 1)
    zero = F.lit(0).cast(TOTAL)
    shown = (x.select("*", F.when(reset, zero).otherwise(F.col("balance")).alias("amount"),
                      F.when(reset, zero).otherwise(F.col("local_balance")).alias("local_amount"))
             .withColumnRenamed("fiscal_month_key", "_pm"))
    cal = fiscal_calendar(lg.fiscal_month, lg.fiscal_quarter, lg.fiscal_year)
    fm_prev = F.broadcast(cal.select(F.col("fiscal_month_key").alias("_pm"), "fiscal_period"))
    # labels are made for an account, not for each row of its balances
    a = lg.account.select("account_key", "account_code", F.col("description").alias("acct_description"),
                          account_type_name("type").alias("acct_type"), account_type_order("type").alias("acct_type_order"))
    org = near(orgs_with_entity(lg, lg.customer if orgs is None else orgs, "org_key"))
    ccy = lg.currency_code
    ccc = F.broadcast(ccy.select(F.col("currency_code_key").alias("transaction_currency"),
                                 F.col("iso_currency_code").alias("transaction_currency_code")))
    lcc = F.broadcast(ccy.select(F.col("currency_code_key").alias("local_currency"),
                                 F.col("iso_currency_code").alias("local_currency_code")))
    # a month's values are computed once, into the struct that is repeated; as columns they would be for each copy
    month = F.struct("account_key", "org_key", "_pm", "account_code", "acct_description", "acct_type", "acct_type_order", "fin_org_code",
                     "fin_org_name", "fiscal_period", "le_org_code", "le_org_name", "begin", "amount", "local_begin", "local_amount", "entries")
    df = (shown.join(a, "account_key").join(org, "org_key").join(fm_prev, "_pm")
          .select(F.inline(F.array_repeat(month, F.col("begin_rows").cast("int"))))
          .filter(~((F.col("begin") == 0) & (F.col("amount") == 0)))
          .select("*", F.inline("entries")).join(ccc, "transaction_currency").join(lcc, "local_currency"))
    null = F.lit(None)
    vals = {
        "general_ledger_key": null.cast("bigint"), "account_key": F.col("account_key"),
        "customer_key": null.cast("bigint"), "organization_key": F.col("org_key"),
        "project_key": null.cast("bigint"), "person_key": null.cast("bigint"),
        "fiscal_month_key": F.col("_pm"), "account_code": F.col("account_code"),
        "acct_description": F.col("acct_description"), "acct_type": F.col("acct_type"),
        "acct_type_order": F.col("acct_type_order"), "credit_amount": null.cast(MONEY),
        "customer_vendor_code": null.cast("string"), "customer_vendor_name": null.cast("string"),
        "debit_amount": null.cast(MONEY), "gl_description": F.lit("Calculated Balance"),
        "doc_number": null.cast("string"), "doc_key": null.cast("bigint"), "doc_type": null.cast("string"),
        "doc_type_description": null.cast("string"), "fin_org_code": F.col("fin_org_code"),
        "fin_org_name": F.col("fin_org_name"), "fiscal_period": F.col("fiscal_period"),
        "post_date": null.cast("date"), "quantity": null.cast("decimal(18,6)"), "transaction_date": null.cast("date"),
        "le_org_code": F.col("le_org_code"), "le_org_name": F.col("le_org_name"),
        "person_first_name": null.cast("string"), "person_last_name": null.cast("string"),
        "person_middle_initial": null.cast("string"), "proj_code": null.cast("string"),
        "proj_org_code": null.cast("string"), "proj_org_name": null.cast("string"),
        "proj_owning_org_code": null.cast("string"), "proj_owning_org_name": null.cast("string"),
        "reference": null.cast("string"), "beginning_balance": F.col("begin").cast(TOTAL),
        "ending_balance": F.col("amount").cast(TOTAL), "transaction_currency_code": F.col("transaction_currency_code"),
        "local_currency_code": F.col("local_currency_code"),
        "local_beginning_balance": F.col("local_begin").cast(TOTAL), "local_credit_amount": null.cast(MONEY),
        "local_debit_amount": null.cast(MONEY), "local_ending_balance": F.col("local_amount").cast(TOTAL),
    }
    return df.select(*[vals[c].alias(c) for c in STATEMENT_COLUMNS])


def gl_statement(lg, viewer: int, as_of: str, years: int = 3, exact_duplicates: bool = True) -> DataFrame:
    """Balance rows and GL detail in one 45-column schema, finance access filter applied."""
    orgs = finance_filter(lg, lg.customer, "customer_key", viewer)  # both parts hold only organizations that exist
    detail = gl_detail(lg, as_of, years, orgs).select(
        *[(F.col(c).cast(TOTAL) if c in ("beginning_balance", "ending_balance", "local_beginning_balance",
                                         "local_ending_balance") else F.col(c)).alias(c) for c in STATEMENT_COLUMNS])
    return period_balances(lg, as_of, years, exact_duplicates, orgs).unionByName(detail)
