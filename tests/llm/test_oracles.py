import duckdb
import pytest

from sparkloom.llm import queries

HERE = "/root/testdata/sf0.001"
TABLES = "documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{HERE}/{t}.parquet')")
    return c


def plain(df):
    text = lambda v: "null" if v is None or v != v else f"{v:.9g}" if isinstance(v, float) else str(v)
    return sorted(tuple(text(v) for v in row) for row in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", [*queries.ORACLES])
def test_same_rows_as_sql(spark, con, name):
    got = queries.QUERIES[name](spark, HERE).toPandas()
    said = con.sql(queries.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(said.columns)
    assert plain(got) == plain(said)


@pytest.mark.parametrize("name", sorted({*queries.QUERIES} - {*queries.ORACLES}))
def test_one_row_for_each_input_row(spark, name):
    got = queries.QUERIES[name](spark, HERE)
    table = "pages" if name == "op1_html" else "documents"
    n = spark.read.parquet(f"{HERE}/{table}.parquet").count()
    assert got.count() <= n if name == "op2_lines" else got.count() == n
