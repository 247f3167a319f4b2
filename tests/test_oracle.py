"""Every registered query with an oracle SQL gives the same table as DuckDB (sf0.001)."""

import duckdb
import pytest

import __spark_entry__ as E
from clickstack.plans import registry
from compare import rows_of, same
from conftest import SMALL

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()
E.queries()  # loads the registry
ORACLE = dict(registry.ORACLE)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    return c


def test_every_key_has_a_builder():
    assert set(E.oracle_sql()) <= set(E.queries())
    assert len(registry.QUERIES) == 97 and len(ORACLE) == 92


@pytest.mark.parametrize("key", sorted(ORACLE))
def test_matches_duckdb(spark, con, key):
    sdf = E.queries()[key](spark, SMALL)
    s_rows = [tuple(r) for r in sdf.collect()]
    rel = con.sql(ORACLE[key])
    d_rows = rel.fetchall()
    assert sorted(sdf.columns) == sorted(rel.columns)
    a, b = rows_of(sdf.columns, s_rows), rows_of(rel.columns, d_rows)
    assert len(a) == len(b)
    assert same(a, b), key
    assert a == b, f"{key}: equal only within float tolerance"


SPARK_TO_DUCK = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
                 "tinyint": "TINYINT", "smallint": "SMALLINT", "boolean": "BOOLEAN", "float": "FLOAT"}


def test_column_types_agree(spark, con):
    bad = {}
    for key in sorted(ORACLE):
        s = dict(E.queries()[key](spark, SMALL).dtypes)
        rel = con.sql(ORACLE[key])
        d = dict(zip(rel.columns, [str(t) for t in rel.types]))
        mism = {c: (s[c], d.get(c)) for c in s if SPARK_TO_DUCK.get(s[c], s[c]) != d.get(c)}
        if mism:
            bad[key] = mism
    assert not bad, bad
