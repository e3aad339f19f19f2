"""Registered queries against their SQL, on the smallest tables."""

from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry_module
from codesieve.plans import oracles, queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def plain(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query_equals_sql(spark, con, sf_dir, name):
    df = queries.queries()[name](spark, sf_dir)
    columns = sorted(df.columns)
    rows = Counter(tuple(plain(r[c]) for c in columns) for r in df.collect())
    assert sum(rows.values()) > 0 or name == "guard_secret_docs"
    sql = oracles.oracle_sql().get(name)
    if sql is None:
        return
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert rows == Counter(tuple(plain(r[i]) for i in order) for r in cur.fetchall())


def test_entry(spark):
    df = entry_module.entry(spark)
    assert df.columns == ["file_id", "language", "scanned_lines", "n_issues", "score"] and df.count() == 1500


def test_every_sql_has_its_query():
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


def test_every_rule_hits_in_both_engines(spark, con, sf_dir):
    """A rule without a hit would be green whatever its pattern."""
    from codesieve.operators import rules

    for name, pack in (("scan_first_match", rules.SECURITY), ("policy_findings", rules.POLICY), ("content_findings", rules.CONTENT)):
        ids = {r.rule_id for r in pack}
        sql = f"SELECT DISTINCT rule_id FROM ({oracles.oracle_sql()[name]})"
        assert ids == {r.rule_id for r in queries.queries()[name](spark, sf_dir).select("rule_id").distinct().collect()}
        assert ids == {r[0] for r in con.execute(sql).fetchall()}
    ids = {r.rule_id for pack in rules.GUARD.values() for r in pack}
    sql = f"SELECT DISTINCT check_id FROM ({oracles.oracle_sql()['guard_checks']}) WHERE NOT passed"
    failed = queries.queries()["guard_checks"](spark, sf_dir).where("NOT passed").select("check_id").distinct()
    assert ids <= {r.check_id for r in failed.collect()} and ids <= {r[0] for r in con.execute(sql).fetchall()}
