import duckdb
import pytest

from trackweave.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    got = QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(map(tuple, want.fetchall()))


def test_quality_sql_with_proven_cutoffs(spark, tmp_path):
    """Enough labels to prove cutoffs: rows of a thousand short documents, some of them full of symbols."""
    words = [f"word{chr(97 + i)}" for i in range(26)]
    rows = [(i, " ".join(words[(i * 7 + j) % 26] + ("#$" if i >= 3000 and j % 2 else "") for j in range(20)), "en") for i in range(3200)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i < 3000), 0) for i in range(3200)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    want = con.execute(ORACLE_SQL["op8_quality_rules"])
    columns = [c[0] for c in want.description]
    got = QUERIES["op8_quality_rules"](spark, str(tmp_path))
    rows = sorted(map(tuple, got.select(*columns).collect()))
    assert rows == sorted(map(tuple, want.fetchall()))
    assert sum(not r[-1] for r in rows) == 200
