"""The driver contract, and registered queries against their SQL."""

import duckdb
import pytest

import __spark_entry__ as E
from causeway.plans.oracles import SQL
from causeway.plans.queries import QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
CHEAP = [n for n in SQL if n.startswith(("fk_", "hyper_", "prop_", "ate_", "ppl_", "viz_"))] + ["fix_parents", "fix_markov", "fix_is_dag", "fix_powerset", "fix_dsep", "fix_backdoor_set_reference"]


@pytest.fixture(scope="module")
def db(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def test_contract(spark):
    assert set(SQL) == set(QUERIES) and set(E.oracle_sql()) <= set(E.queries())
    row = E.entry(spark).first()
    assert row["n"] > 0 and row["n_cells"] > 0


@pytest.mark.parametrize("name", CHEAP)
def test_query_equals_sql(spark, db, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    found = sorted(str([r[c] for c in columns]) for r in df.collect())
    cursor = db.execute(SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    assert found == sorted(str([dict(zip(names, r))[c] for c in columns]) for r in cursor.fetchall())
