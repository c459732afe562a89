"""Change points and their copies (F2 of round 4): sums of months without amounts, values made before the copies."""

import contextlib
import io
from types import SimpleNamespace

from tallyspark.operators import balances as B
from tallyspark.operators.ledger_store import LedgerStore
from tallyspark.params import DEFAULT as P


def plan(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()


def test_months_without_an_amount_have_no_year_sum(spark, lg):
    """A month whose amounts are all null adds nothing; a year that has only such months has no sum."""
    moves = [(2, 10, 199601, None, 1), (2, 10, 199602, 5, 2), (2, 10, 199603, None, 1), (2, 10, 199701, None, 3), (2, 10, 199702, 7, 1)]
    few = SimpleNamespace(movements=spark.createDataFrame(
        moves, "account_key long, org_key long, fiscal_month_key long, n int, transaction_currency long")
        .selectExpr("account_key", "org_key", "fiscal_month_key", "transaction_currency", "1L as local_currency",
                    "cast(n as decimal(28,2)) as net", "cast(n as decimal(28,2)) as local_net"),
        account=spark.createDataFrame([(2, "E")], "account_key long, type string"),
        **{n: getattr(lg, n) for n in ("fiscal_month", "fiscal_quarter", "fiscal_year")})
    got = B.change_points(few).orderBy("ord").collect()
    text = lambda *names: [tuple(None if r[n] is None else int(r[n]) for n in names) for r in got]
    assert text("ytd", "was_ytd") == [(None, None), (5, None), (5, 5), (None, 5), (7, None)]
    assert text("run", "top_transaction") == [(None, 3), (5, 3), (5, 3), (5, 3), (12, 3)]
    assert {tuple(sorted(q[0] for q in r["pairs"])) for r in got} == {(1, 2, 3)}


def test_copies_carry_values_that_are_made(lg):
    lines = plan(B.period_balances(LedgerStore(lg), P.as_of)).splitlines()
    copies = next(i for i, x in enumerate(lines) if "Generate inline(array_repeat(" in x)
    above = "\n".join(lines[:copies])
    assert "CASE WHEN" not in above and "CASE WHEN" in "\n".join(lines[copies + 1:])


def test_months_need_no_function_of_rows(lg):
    assert "lambda" not in plan(B.monthly_balances(LedgerStore(lg), P.as_of, ("A", "L", "E", "R")))
