"""Every query of the training-data problems: against its SQL where there is one, and on empty tables, null rows and clashing columns."""

import os

import duckdb
import pytest

from helpers import SMALL, emptied, only_nulls, rows, with_clashes, with_nulls, write_variant
from larder.llm.oracle import ORACLE
from larder.llm.queries import QUERIES


@pytest.fixture(scope="session")
def variants(tmp_path_factory):
    return {f.__name__: write_variant(str(tmp_path_factory.mktemp(f.__name__)), f) for f in (emptied, only_nulls, with_nulls, with_clashes)}


def by_sql(d, sql):
    con = duckdb.connect()
    for f in os.listdir(d):
        con.execute(f"create view {f.split('.')[0]} as select * from '{d}/{f}'")
    cols = sorted(con.sql(sql).columns)
    got = con.execute(f"select {', '.join(chr(34) + c + chr(34) for c in cols)} from ({sql})").fetchall()
    return sorted(repr([round(v, 9) if isinstance(v, float) else v for v in r]) for r in got)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, variants, name):
    q = QUERIES[name]
    got = rows(q(spark, SMALL))
    if name in ORACLE:
        assert got == by_sql(SMALL, ORACLE[name])
    assert rows(q(spark, variants["with_clashes"])) == got
    q(spark, variants["emptied"]).collect()
    q(spark, variants["only_nulls"]).collect()
    q(spark, variants["with_nulls"]).collect()
