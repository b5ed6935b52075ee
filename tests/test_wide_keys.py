"""Queries against their SQL where keys are so large that words or paths made from them stand twice."""

from __future__ import annotations

import duckdb
import pytest

from lexloom.plans import registry
from tests.test_registry import rows_of

TABLES = {
    "nation": "SELECT i::INTEGER AS n_nationkey, 'N' || i AS n_name, (i % 5)::INTEGER AS n_regionkey FROM range(25) t(i)",
    "customer": "SELECT i AS c_custkey, 'C' || i AS c_name, (i % 25)::INTEGER AS c_nationkey, 0.0 AS c_acctbal, 'S' || i % 5 AS c_mktsegment FROM range(12) t(i)",
    "orders": "SELECT i + j * 260000 AS o_orderkey, i % 10 AS o_custkey, CASE WHEN (i + j) % 3 = 0 THEN 'F' ELSE 'O' END AS o_orderstatus, 1.0 AS o_totalprice, TIMESTAMP '1995-02-03' AS o_orderdate, 'P' || i % 4 AS o_orderpriority FROM range(120) t(i), range(2) u(j)",
    "part": "SELECT i AS p_partkey, 'p' || i AS p_name, 'b' AS p_brand, 't' AS p_type, 1::INTEGER AS p_size, 1.0 AS p_retailprice FROM (SELECT * FROM range(100000, 100400) UNION ALL SELECT * FROM range(1000000, 1004000)) t(i)",
}


@pytest.fixture(scope="module")
def wide(tmp_path_factory):
    folder = tmp_path_factory.mktemp("wide")
    c = duckdb.connect()
    for name, sql in TABLES.items():
        c.execute(f"COPY ({sql}) TO '{folder}/{name}.parquet' (FORMAT parquet)")
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return folder, c


#: Queries over entries whose words repeat.
REGISTER = [
    "added_entries", "canonical_spelling", "entry_targets", "hover_info", "override_violations", "patched_panel", "register_dangles", "register_reload", "register_structure",
]
#: Queries over editions whose paths repeat.
CATALOGUE = ["import_reports", "borrowable_editions", "listed_works", "labelled_changes", "loaded_catalogue", "unaccounted_occurrences", "violations_of_collection"]


@pytest.mark.parametrize("name", REGISTER + CATALOGUE)
def test_query_equals_its_sql_on_wide_keys(spark, wide, name):
    folder, duck = wide
    df = registry.queries()[name](spark, str(folder))
    out = duck.execute(registry.oracle_sql()[name])
    names = [d[0] for d in out.description]
    assert rows_of(df.select(*names).collect()) == rows_of(out.fetchall())
