"""Registered queries against their SQL, as the driver compares them, on the smallest tables. Rules are covered by scan_findings."""

import math
import os
from collections import Counter

import duckdb
import pytest

from sigilite.plans import core_problems, report_queries, scan_queries

D = os.environ.get("SIGILITE_TEST_TABLES", "/root/testdata/sf0.001")
SLOW = {"json_rows", "sarif_results", "baseline_entries", "multi_secret_preview", "test_path_demotion", "severity_counts_zero_filled"}
QUERIES = {**core_problems.QUERIES, **scan_queries.QUERIES, **report_queries.QUERIES}
ORACLES = {**core_problems.ORACLES, **scan_queries.ORACLES, **report_queries.ORACLES}

pytestmark = pytest.mark.skipif(not os.path.isdir(D), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in os.listdir(D):
        con.execute(f"CREATE VIEW {f.partition('.')[0]} AS SELECT * FROM '{D}/{f}'")
    return con


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    plain = lambda v: "nan" if isinstance(v, float) and math.isnan(v) else round(v, 6) if isinstance(v, float) else v
    return sorted(columns), Counter(tuple(plain(r[i]) for i in order) for r in rows)


def test_every_query_has_sql():
    assert QUERIES.keys() == ORACLES.keys() and len(QUERIES) >= 100


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if not n.startswith("rule_") and n not in SLOW) + ["rule_selection", "rule_metadata_join"])
def test_query(spark, db, name):
    got = QUERIES[name](spark, D)
    want = db.execute(ORACLES[name])
    columns = [c[0] for c in want.description]
    assert _rows(got.columns, got.collect()) == _rows(columns, want.fetchall())
