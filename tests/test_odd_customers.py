import json

import duckdb

from sparkloom.plans import queries


def test_metadata_of_odd_customers_is_published_as_sql_says(spark, tmp_path):
    con = duckdb.connect()
    con.sql(f"""COPY (SELECT * REPLACE (CASE c_custkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'a "b" \\ é' ELSE c_name END AS c_name, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_acctbal END AS c_acctbal, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_nationkey END AS c_nationkey)
        FROM '/root/testdata/sf0.001/customer.parquet') TO '{tmp_path}/customer.parquet' (FORMAT parquet)""")
    con.sql(f"CREATE VIEW customer AS SELECT * FROM '{tmp_path}/customer.parquet'")
    got = {r["id"]: json.loads(r["metadata"]) for r in queries.QUERIES["published_metadata"](spark, str(tmp_path)).collect()}
    want = {k: json.loads(m) for k, m in con.sql(queries.ORACLES["published_metadata"]).fetchall()}
    assert len(want) == 150 and got == want
