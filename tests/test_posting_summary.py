"""D58 against a row-by-row version: sums once per dimension row, or once per posting."""

import random
from collections import defaultdict
from decimal import Decimal

import pytest

from tallyspark.operators import postings as PS

TEXTS = ["project_org_code", "project_code", "task_number", "task_name"]


@pytest.mark.parametrize("dedupe", [False, True])
def test_summary_equals_row_by_row(spark, monkeypatch, dedupe):
    rng = random.Random(4)
    money = lambda: None if rng.random() < 0.2 else Decimal(rng.randint(-9999, 9999)) / 100
    posts = [(rng.choice([1, 2, 3, 4, None]), "O", rng.choice(["P1", "P2"]), rng.choice(["T1", None]), "t",
              f"2024-01-{rng.randint(1, 28):02d}", *[money() for _ in range(6)], k, "Labor", "CE") for k in range(300)]
    cols = (["project_key", *TEXTS, "day", *PS.SUMMARY_SUM, "cost_amount", "transaction_data_key", "transaction_type", "cost_element"])
    types = "bigint,string,string,string,string,string," + "decimal(18,2)," * 6 + "bigint,string,string"
    detail = spark.createDataFrame(posts, ", ".join(f"{c} {t}" for c, t in zip(cols, types.replace("(18,2)", "(18;2)").split(","))).replace(";", ","))
    detail = detail.selectExpr("*", "cast(day as date) as transaction_date").drop("day")
    dims = [(1, "Open", "TM"), (1, "Open", "TM"), (1, "Open", "FP"), (2, "On Hold - Open", "CP"), (3, "Closed", "TM"), (4, "Open", "NB")]
    dim = spark.createDataFrame(dims, "project_key bigint, status string, proj_billing_type_code string")
    monkeypatch.setattr(PS, "posting_detail", lambda *a, **k: detail)
    monkeypatch.setattr(PS, "project_dim", lambda *a, **k: dim)
    got = PS.posting_summary(None, 1, "x", "2024-01-10 00:00:00", dedupe_dim=dedupe).collect()

    fan = {1: 1 if dedupe else 3, 2: 1}
    groups = defaultdict(list)
    for r in posts:
        if r[0] in fan and r[5] >= "2024-01-10":
            groups[(f"{r[1]} {r[2]}", f"{r[3] or ''} {r[4]}")].append(r)
    total = lambda rs, i: (lambda v: sum(v) if v else None)([r[i] * fan[r[0]] for r in rs if r[i] is not None])
    want = sorted(repr([*[total(rs, 6 + i) for i in range(5)], max(r[0] for r in rs), max(r[12] for r in rs)]) for rs in groups.values())
    assert sorted(repr([*[r[f"c{10 + i}"] for i in range(5)], r["c15"], r["c16"]]) for r in got) == want
