import glob
import os

import pytest

from seamquarry.llm import queries as Q


@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_query(spark, data, name):
    import duckdb

    df = Q.queries()[name](spark, data)
    cols = sorted(df.columns)
    got = sorted(tuple(str(r[c]) for c in cols) for r in df.collect())
    assert got or name in ("p1_graph_agreement", "p3_found", "p10_found", "p10_restored")
    if name in Q.oracle_sql():
        con = duckdb.connect()
        for p in glob.glob(f"{data}/*.parquet"):
            con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
        rel = con.execute(Q.oracle_sql()[name])
        names = [x[0] for x in rel.description]
        assert got == sorted(tuple(str(r[names.index(c)]) for c in cols) for r in rel.fetchall())
