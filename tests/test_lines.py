"""Lines of a text keep their digits, at the ends of a line as well, and lose the blanks there."""

import pytest
from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.plans import registry


@pytest.mark.parametrize(
    "given,expected",
    [
        ("0997 call +1 (252) 555-8630", "0997 call +1 (252) 555-8630"),
        ("a\n1219 Main 11", "a\n1219 Main 11"),
        ("\n".join(f"{k} to {k}" for k in range(12)), "\n".join(f"{k} to {k}" for k in range(12))),
        ("  a 0 \n \t 1 b  \n\n\n c ", "a 0\n1 b\n\nc"),
    ],
)
def test_lines_keep_their_digits(spark, given, expected):
    df = spark.createDataFrame([(given,)], "t string")
    assert df.select(tx.collapse(F.col("t"), keep_newlines=True), tx.tidy_description(F.col("t"))).first()[:] == (expected, expected)


def test_records_of_just_enough_characters(spark, tmp_path):
    """Descriptions of 40 characters are kept whatever they end or begin with, as the SQL of both queries has it."""
    import duckdb

    body = "We look for someone who likes the sea at"
    texts = [body, body[:-1] + "0", "0" + body[1:], "0" + body[1:-1] + "0", body[:19] + "\n1" + body[21:-1] + "1", body[:-2] + "0", body[:-1]]
    spark.createDataFrame([(k, t, "src1") for k, t in enumerate(texts)], "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    flat = registry.queries()["records_flat"](spark, str(tmp_path))
    found = sorted((tuple(r) for r in flat.collect()), key=str)
    wanted = con.execute(f"SELECT {', '.join(flat.columns)} FROM ({registry.oracle_sql()['records_flat']})").fetchall()
    assert found == sorted(wanted, key=str) and [r[0] for r in found] == [0, 1, 2, 3, 4]
    row = registry.queries()["records_overview"](spark, str(tmp_path))
    assert tuple(row.first()) == con.execute(f"SELECT {', '.join(row.columns)} FROM ({registry.oracle_sql()['records_overview']})").fetchone()
