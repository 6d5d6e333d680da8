import glob
import os

import duckdb
import pytest

from checks.compare import rows_of
from postings_engine.llm.queries import ORACLE, QUERIES


def test_every_operator_is_registered():
    import __spark_entry__
    names = set(__spark_entry__.queries())
    assert set(QUERIES) | {"pipeline"} <= names and sorted(int(q[2:].split("_")[0]) for q in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_queries_equal_their_sql(spark, sf, name):
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    cur = con.execute(ORACLE[name])
    df = QUERIES[name](spark, sf)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of([d[0] for d in cur.description], cur.fetchall())


def test_nothing_else_imports_the_package():
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    for path in glob.glob(f"{root}/postings_engine/**/*.py", recursive=True) + glob.glob(f"{root}/checks/*.py"):
        if "/llm/" not in path:
            assert "llm" not in open(path).read(), path
