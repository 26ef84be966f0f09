"""The registered text queries against their SQL in DuckDB, on the smallest tables and on awkward rows."""

import os

import pytest

pytest.importorskip("netmetrics.llm")
duckdb = pytest.importorskip("duckdb")

from netmetrics.llm import queries as q  # noqa: E402

SF = "/root/testdata/sf0.001"
LONG = " ".join(f"w{k}" for k in range(40))
ROWS = [
    (1, None), (2, ""), (3, "\n\n"), (4, "one two"), (5, "ONE two"), (6, LONG), (7, LONG + " end"), (8, f"head {LONG}\n{LONG}\nA line of ten\n a LINE of ten\t"),
    (9, "a line of TEN\nshort"), (10, "é" * 30 + " " + "é" * 70), (11, "é" * 120), (12, 'password = "hunter22hunter" AKIA' + "A1" * 9 + " " + "0f" * 20 + " ghp_" + "a1" * 20),
    (13, "é token: abc; secret=token: abcdefgh é passwd=abcdef"), (14, "x y " * 60), (15, "the same line is here\nthe same line is here\n# $ % & | < >"), (16, "日本語 " * 40),
]


def compared(spark, con, folder, name):
    df = q.queries()[name](spark, folder)
    cols = sorted(df.columns)
    got = sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)
    r = con.execute(q.oracle_sql()[name])
    names = [d[0] for d in r.description]
    want = sorted((tuple(dict(zip(names, x, strict=True))[c] for c in cols) for x in r.fetchall()), key=repr)
    assert sorted(names) == cols and got == want, name


def connection(folder, tables):
    con = duckdb.connect()
    for t in tables:
        con.execute(f"create view {t} as select * from read_parquet('{folder}/{t}.parquet{'' if os.path.isfile(f'{folder}/{t}.parquet') else '/*.parquet'}')")
    return con


@pytest.mark.parametrize("name", q.oracle_sql())
def test_sql_of_small_tables(spark, name):
    if not os.path.isdir(SF):
        pytest.skip("no tables")
    compared(spark, connection(SF, ("documents", "benchmark")), SF, name)


def test_sql_of_awkward_rows(spark, tmp_path):
    spark.createDataFrame(ROWS, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    items = [(1, " ".join(f"w{k}" for k in range(5, 25))), (1, "one TWO"), (2, "One two"), (3, None), (None, "end"), (10, "a line of ten"), (11, "!!")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    con = connection(str(tmp_path), ("documents", "benchmark"))
    for name in q.oracle_sql():
        compared(spark, con, str(tmp_path), name)
