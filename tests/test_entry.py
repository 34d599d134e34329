import glob
import math
import os

import pytest

import __spark_entry__ as E
from seamquarry.plans import catalog, problems, stores
from seamquarry.session import shared_dir


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6g}"
    return str([norm(x) for x in v]) if isinstance(v, (list, tuple)) else str(v)


def test_registry():
    assert set(E.oracle_sql()) <= set(E.queries()) and len(E.queries()) > 50


CORE = {**problems.ORACLE, **catalog.ORACLE, **stores.ORACLE}


def test_scratch_needs_a_shared_folder():
    class Cluster:
        conf = type("C", (), {"get": staticmethod(lambda *a: None)})
        sparkContext = type("S", (), {"getCheckpointDir": staticmethod(lambda: None), "master": "spark://host:7077"})

    with pytest.raises(ValueError):
        shared_dir(Cluster)


@pytest.mark.parametrize("name", sorted(CORE))
def test_parity(spark, data, name):
    import duckdb

    con = duckdb.connect()
    for p in glob.glob(f"{data}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    df = E.queries()[name](spark, data)
    cols = sorted(df.columns)
    got = sorted(tuple(norm(r[c]) for c in cols) for r in df.collect())
    rel = con.execute(E.oracle_sql()[name])
    names = [x[0] for x in rel.description]
    assert sorted(names) == cols
    assert got == sorted(tuple(norm(r[names.index(c)]) for c in cols) for r in rel.fetchall())


def test_entry(spark, data):
    assert E.entry(spark).columns == ["run_id", "span_id", "descendant", "hops"]
