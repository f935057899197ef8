"""The text index is made by tasks whose number grows with the blocks."""

from tidemark import tables
from tidemark.operators.textindex import TASK_BLOCKS, TextIndex


def test_tasks_grow_with_the_blocks(spark):
    count = TASK_BLOCKS * 6
    folder = tables.fresh(spark, "text")
    index = TextIndex.create(spark.range(count).selectExpr("id", "'one two' AS text"), folder, 1, 1)
    files = [n for n in tables.names(spark, f"{folder}/postings/bucket=0") if n.startswith("part-")]
    assert len(files) == 6
    assert index.postings(["one"]).selectExpr("inline(docs)").count() == count
