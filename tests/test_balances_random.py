"""D20-D23 against a row-by-row version on random ledgers.

The ledgers have accounts of every type, several currency pairs per key, keys
posted once, keys posted in months that the calendar lacks, and a calendar
with missing years.
"""

import datetime as dt
import random
from collections import Counter, defaultdict
from decimal import Decimal
from types import SimpleNamespace

import pytest

from tallyspark.operators import balances as B

AS_OF = "2003-06-15 10:30:00"
YEARS = [1999, 2000, 2001, 2002, 2003, 2004, 2007]
TYPES = {0: "A", 1: "L", 2: "R", 3: "E", 4: "X"}


def ledger(spark, seed, keys=14, lines=160):
    rng = random.Random(seed)
    months = [y * 100 + m for y in YEARS for m in range(1, 13)]
    gl = []
    for _ in range(lines):
        k = rng.randrange(keys)
        month = rng.choice(months) if rng.random() < 0.8 else rng.choice([199501, 200506])  # some months are in no calendar
        if k == 0:
            month = 199501
        money = [Decimal(rng.choice([0, 0, 100, 250, 999])) / 100 for _ in range(4)]
        gl.append((k % 5, 10 + k % 3, month, *money, rng.randint(1, 3), rng.randint(1, 2)))
    month_rows = [(y * 100 + m, y, y * 10 + (m - 1) // 3 + 1, m, dt.date(y, m, 1),
                   (dt.date(y + m // 12, m % 12 + 1, 1) - dt.timedelta(1))) for y in YEARS for m in range(1, 13)]
    frame = spark.createDataFrame
    lg = SimpleNamespace(
        general_ledger=frame(gl, "account_key long, organization_key long, fiscal_month_key long, debit_amount decimal(18,2), "
                                 "credit_amount decimal(18,2), local_debit_amount decimal(18,2), local_credit_amount decimal(18,2), "
                                 "transaction_currency long, local_currency long").repartition(4),
        account=frame([(k, f"A{k}", f"Account {k}", t) for k, t in TYPES.items()], "account_key long, account_code string, description string, type string"),
        fiscal_month=frame(month_rows, "fiscal_month_key long, fiscal_year_key long, fiscal_quarter_key long, period_number int, begin_date date, end_date date"),
        fiscal_quarter=frame([(y * 10 + q, dt.date(y, 3 * q - 2, 1), dt.date(y, 3 * q, 28)) for y in YEARS for q in range(1, 5)],
                             "fiscal_quarter_key long, begin_date date, end_date date"),
        fiscal_year=frame([(y, f"FY{y}", dt.date(y, 1, 1), dt.date(y, 12, 31)) for y in YEARS], "fiscal_year_key long, name string, begin_date date, end_date date"),
        customer=frame([(k, f"C{k}", f"Org {k}", None) for k in range(10, 13)], "customer_key long, customer_code string, customer_name string, legal_entity_key long"),
        currency_code=frame([(1, "USD"), (2, "EUR"), (3, "JPY")], "currency_code_key long, iso_currency_code string"))
    return lg, gl


def plain(gl, exact=True):
    """(grid, rows carried into the next month, pairs of D23), as the reference's joins would give them."""
    order = [y * 100 + m for y in YEARS for m in range(1, 13)]
    following = {a: b for a, b in zip(order, order[1:]) if b - a in (1, 89)}
    window = [m for m in order if m >= 199907]  # 2003-06-15 10:30 less four years: the first month that starts later
    net, posted, pairs = defaultdict(lambda: [Decimal(0), Decimal(0), 0, 0]), set(), defaultdict(set)
    for a, o, m, d, c, ld, lc, tx, loc in gl:
        pairs[a, o].add((tx, loc))
        posted.add((a, o, m))
        if m in order:
            sign = {"A": 1, "E": 1, "L": -1, "R": -1}.get(TYPES[a], 0)
            x = net[a, o, m]
            net[a, o, m] = [x[0] + sign * (d - c), x[1] + sign * (ld - lc), max(x[2], tx), max(x[3], loc)]
    grid = [(a, o, m, tx, loc) for (a, o), ps in pairs.items() for m in window if (a, o, m) not in posted for tx, loc in ps]
    rows = [(a, o, m, *v) for (a, o, m), v in net.items()] + [(a, o, m, Decimal(0), Decimal(0), tx, loc) for a, o, m, tx, loc in grid]
    by_key = defaultdict(list)
    for r in rows:
        by_key[r[:2]].append(r[2:])
    carried = []
    for (a, o), rs in by_key.items():
        for m in sorted({r[0] for r in rs}):
            if m not in following or TYPES[a] == "X":
                continue
            mine = [r for r in rs if r[0] == m]
            if TYPES[a] in "AL":
                run = [sum(r[i] for r in rs if r[0] <= m) for i in (1, 2)]
                carried += [(a, o, following[m], m, run[0], run[0], run[1], run[1], r[3], r[4]) for r in mine]
            else:
                k = len(mine) if exact else 1
                ytd = [k * sum(r[i] for r in rs if r[0] <= m and r[0] // 100 == m // 100) for i in (1, 2)]
                now = [Decimal(0)] * 2 if following[m] % 100 == 1 else ytd
                carried.append((a, o, following[m], m, now[0], ytd[0], now[1], ytd[1], max(r[3] for r in mine), max(r[4] for r in mine)))
    reported = [m for m in order if m in following and following[m] >= 200007]
    pairs_out = [(c[0], c[1], c[3], p[4], c[4], p[6], c[6], c[8], c[9]) for c in carried for p in carried
                 if c[:2] == p[:2] and p[2] == c[3] and c[3] in reported and (p[4] or c[4])]
    return grid, carried, pairs_out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_balances_match_row_by_row(spark, seed):
    lg, gl = ledger(spark, seed)
    grid, carried, pairs = plain(gl)
    got = B.zero_fill_grid(lg, AS_OF).select(*B.KEY, "fiscal_month_key", "transaction_currency", "local_currency")
    assert Counter(map(tuple, got.collect())) == Counter(grid)
    columns = [*B.KEY, "fiscal_month_key", "prev_fiscal_month_key", "amount", "amount_c", "local_amount", "local_amount_c",
               "transaction_currency", "local_currency"]
    assert Counter(map(tuple, B.totals(lg, AS_OF).select(*columns).collect())) == Counter(carried)
    shown = B.period_balances(lg, AS_OF).select("account_key", "organization_key", "fiscal_month_key", "beginning_balance", "ending_balance",
                                                "local_beginning_balance", "local_ending_balance", "transaction_currency_code", "local_currency_code")
    code = {1: "USD", 2: "EUR", 3: "JPY"}
    assert Counter(map(tuple, shown.collect())) == Counter((*p[:7], code[p[7]], code[p[8]]) for p in pairs)


def test_plain_year_to_date(spark):
    lg, gl = ledger(spark, 4)
    want = [c for c in plain(gl, exact=False)[1] if TYPES[c[0]] in "ER"]
    got = B.ytd_balance(lg, AS_OF, exact_duplicates=False).select(
        *B.KEY, "fiscal_month_key", "prev_fiscal_month_key", "amount", "amount_c", "local_amount", "local_amount_c", "transaction_currency", "local_currency")
    assert Counter(map(tuple, got.collect())) == Counter(want)


def scans(df, table):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return sum("Scan parquet" in line and f"/{table}.parquet" in line for line in plan.splitlines())


def test_ledger_is_read_once(lg):
    assert scans(B.zero_fill_grid(lg, AS_OF), "lineitem") == 1
    assert scans(B.running_balance(lg, AS_OF), "lineitem") == 1
    assert scans(B.ytd_balance(lg, AS_OF), "lineitem") == 1
    assert scans(B.period_balances(lg, AS_OF), "lineitem") == 1
    assert scans(B.gl_statement(lg, 900001, AS_OF), "lineitem") == 2
