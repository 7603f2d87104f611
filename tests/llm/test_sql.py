"""The queries that SQL can express against their SQL: on the smallest data and on odd rows."""

import duckdb
import pytest
from pyspark.sql import Row

from wayfold.llm import queries

SF = "/root/testdata/sf0.001"
LONG = " ".join(f"w{i}" for i in range(120))
ODD = [
    (1, None), (2, ""), (3, " \t\n "), (4, "one"), (5, "ONE"), (6, "one two"), (7, "one three"), (8, "one two three"),
    (9, LONG), (10, LONG), (11, "head " + LONG + " tail"), (12, "Übung\r\nmacht den Meister\nmacht den meister"),
    (13, "\n\nmacht den\n"), (14, "é" * 150), (15, "é" * 99 + "x" + "é" * 50), (16, "ab" * 150), (17, LONG.replace("w7 ", "")),
    (18, "Red House, red  house\tred house. " * 12 + "\n<P line\n"), (19, "a <M> b\nc"), (20, "b\n" * 40), (21, "x y\n\nx y" * 15),
]
VECTORS = [
    (1, [1.0, 0.0]), (2, [1e30, 0.0]), (3, [1e-30, 1e-32]), (4, [0.0, 0.0]), (5, None), (6, [1.0, None]), (7, [1.0, float("nan")]),
    (8, [1.0, 0.0, 0.0]), (9, [-1.0, 0.0]), (10, []), (11, [2.0, 0.1]),
]


def same(spark, name, folder):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet/*.parquet'" if folder != SF else f"create view {t} as select * from '{folder}/{t}.parquet'")
    got = queries.QUERIES[name](spark, folder)
    expected = con.sql(queries.ORACLE_SQL[name])
    names = sorted(expected.columns)
    assert set(names) <= set(got.columns)
    rows = {tuple(r[c] for c in names) for r in got.collect()}
    assert rows == {tuple(r[expected.columns.index(c)] for c in names) for r in expected.fetchall()}
    assert got.count() == len(expected)


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("odd"))
    spark.createDataFrame([Row(doc_id=i, text=t, lang=None if i % 3 == 0 else "en") for i, t in ODD], "doc_id long, text string, lang string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([Row(vec_id=i, embedding=v) for i, v in VECTORS], "vec_id long, embedding array<float>").write.parquet(f"{folder}/embeddings.parquet")
    return folder


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_smallest_data(spark, name):
    same(spark, name, SF)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_odd_rows(spark, odd, name):
    same(spark, name, odd)
