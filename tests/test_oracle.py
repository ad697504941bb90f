"""Every core query with SQL against DuckDB over the smallest tables, whole."""
import glob
import os
from collections import Counter

import duckdb
import pytest

from veritide import plans

CASES = {k: v for m in plans.modules() for k, v in m.ORACLE.items()}
QUERIES = {k: v for m in plans.modules() for k, v in m.QUERIES.items()}


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for p in glob.glob(data + "/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


def _rows(rows):
    return Counter(tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in rows)


@pytest.mark.parametrize("name", sorted(CASES))
def test_query_equals_sql(name, spark, data, duck):
    df = QUERIES[name](spark, data)
    cols = ", ".join(f'"{c}"' for c in df.columns)
    assert _rows(df.collect()) == _rows(duck.execute(f"select {cols} from ({CASES[name]})").fetchall())


#: Queries without SQL: what must hold of their rows.
WITHOUT = {
    "scrub_all": lambda rows: rows and all(r.clean is not None and min(r.email, r.phone, r.address, r.name) >= 0 for r in rows) and sum(r.email + r.phone + r.address + r.name for r in rows) > 0,
    "scrub_idempotent": lambda rows: rows == [], "rerun_equality": lambda rows: rows == [],
    "scrub_documents": lambda rows: rows and len({r.doc_no for r in rows}) == len(rows),
    "pii_counts_by_document": lambda rows: rows and len({r.doc_no for r in rows}) == len(rows),
    "best_line_snippet": lambda rows: 0 < len(rows) <= 5 and all(0 < len(r.line) <= 300 for r in rows),
    "p4_found": lambda rows: {r.kind for r in rows} == {"party", "turn", "sentence", "object"},
    "p4_objects": lambda rows: rows and all(r.attributes for r in rows),
    "p5_found": lambda rows: len({(r.src, r.record_key) for r in rows}) == len(rows) > 0,
    "p5_zones": lambda rows: rows and all(0 <= r.violations <= r.n and r.zone for r in rows),
}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(CASES)))
def test_query_without_sql(name, spark, data):
    assert WITHOUT[name](QUERIES[name](spark, data).collect())
