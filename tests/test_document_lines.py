"""Tables and sources over the document lines hold rows, and residues of the line number meet every class."""

import pytest

from tallyspark.plans.registry import oracle_sqls, spark_callables
from tallyspark.sources.fixtures import BINDINGS, duckdb_prefix

CHILDREN = sorted(n for n, b in BINDINGS.items() if "fin_document_detail" in b.deps)
SOURCES = sorted(n for n in spark_callables() if n.startswith("d49_"))


def count(duck, names, what, where="true"):
    return duck.execute(f"WITH {duckdb_prefix(names)} SELECT {what} FROM {names[0]} WHERE {where}").fetchone()[0]


@pytest.mark.parametrize("name", CHILDREN)
def test_child_table_has_rows(name, duck):
    assert count(duck, [name], "count(*)") > 0


@pytest.mark.parametrize("name", SOURCES)
def test_source_has_rows(name, duck):
    assert duck.execute(f"SELECT count(*) FROM ({oracle_sqls()[name]})").fetchone()[0] > 0


@pytest.mark.parametrize("of", [4, 6, 8, 10, 20, 40, 50, 60, 100])
def test_line_number_spreads(of, duck):
    assert count(duck, ["fin_document_detail"], f"count(DISTINCT line_no % {of})") == of


@pytest.mark.parametrize("kind", ["labor", "expense"])
def test_purchase_order_lines_meet_their_descriptor(kind, duck):
    key = f"po_{kind}_line_descriptor_key"
    assert count(duck, ["fin_document_detail_po", f"po_{kind}_line_descriptor"], "count(*)",
                 f"{key} IN (SELECT {key} FROM po_{kind}_line_descriptor)") > 0
