import duckdb
import pytest

from ripplegraph.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_equals_sql(spark, duck, name):
    rows = catalogue.queries()[name](spark, SF)
    columns = sorted(rows.columns)
    got = duck.execute(catalogue.oracle_sql()[name])
    names = [c[0] for c in got.description]
    assert sorted(names) == columns
    plain = lambda x: round(float(x), 6) if isinstance(x, float) else x
    want = sorted(([plain(dict(zip(names, r, strict=True))[c]) for c in columns] for r in got.fetchall()), key=str)
    assert sorted(([plain(r[c]) for c in columns] for r in rows.collect()), key=str) == want


def test_bytes_of_squares_past_doubles(spark, tmp_path):
    """Squares beyond 2^53 are exact, and so are those beyond 2^42, of which the SQL has none."""
    keys = [2**21 - 1, 2**21, 94906265, 94906267, 3037000499]
    spark.createDataFrame([(k,) for k in keys], "o_orderkey long").write.parquet(f"{tmp_path}/orders.parquet")
    got = dict(map(tuple, catalogue.uvarint_table(spark, str(tmp_path)).collect()))
    for k in keys:
        data = bytes.fromhex(got[k])
        assert sum((b & 127) << (7 * i) for i, b in enumerate(data)) == k * k and data[-1] and all(b > 127 for b in data[:-1]) and data[-1] < 128
