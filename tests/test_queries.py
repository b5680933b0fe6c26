"""Every query that has SQL, on the smallest tables, against an independent engine."""

import datetime
import decimal
import math
import os

import pytest

from tidewell.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables are not here")


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return str(v) if isinstance(v, (datetime.datetime, datetime.date)) else v


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLE_SQL)[:: int(os.environ.get("EVERY_QUERY", "3"))])  # EVERY_QUERY=1: all of them
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    ours = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    found = duck.sql(ORACLE_SQL[name])
    assert sorted(found.columns) == columns
    at = [found.columns.index(c) for c in columns]
    assert ours == sorted((tuple(plain(r[i]) for i in at) for r in found.fetchall()), key=repr)


def test_rows_only(spark):
    queries = spark.read.parquet(f"{DATA}/embeddings.parquet").where("vec_id % 100 = 0").count()
    assert QUERIES["K9_vector_pipeline"](spark, DATA).count() == 10 * queries > 0  # ten results for every hundredth vector


def test_components_and_clusters_are_those_of_the_vectors(spark):
    """B20 against numpy's decomposition; B19 against what k-means promises: every vector is counted once."""
    np = pytest.importorskip("numpy")
    rows = spark.read.parquet(f"{DATA}/embeddings.parquet").join(spark.read.parquet(f"{DATA}/documents.parquet").selectExpr("doc_id as vec_id"), "vec_id").select("vec_id", "embedding").collect()
    x = np.array([r["embedding"] for r in rows], float)
    _, _, v = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    want = {str(r["vec_id"]): x[i] @ v[:2].T for i, r in enumerate(rows)}
    got = {r["id"]: (r["x"], r["y"]) for r in QUERIES["B20_pca"](spark, DATA).collect()}
    assert set(got) == set(want)
    for k in (0, 1):
        a, b = np.array([got[i][k] for i in sorted(want)]), np.array([want[i][k] for i in sorted(want)])
        assert min(abs(a - b).max(), abs(a + b).max()) < 1e-6
    sizes = QUERIES["B19_kmeans"](spark, DATA).collect()
    assert len(sizes) <= 8 and sum(r["n"] for r in sizes) == len(rows)
