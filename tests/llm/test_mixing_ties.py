"""Equal rows at a source's cut are split by count."""

from __future__ import annotations

from tidemark.llm import mixing


def test_equal_rows_are_split(spark):
    rows = [(1, "one two three", "a")] * 40 + [(2, "one", "b")] * 200 + [(3, "w " * 300, "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(7)
    found = mixing.op5_mixing(docs).collect()
    assert len(found) == len(rows)
    for doc in (1, 2):
        own = [r for r in found if r["doc_id"] == doc]
        sizes = {r["taken"] // r["size"] for r in own}
        assert max(sizes) - min(sizes) <= 1 and max(sizes) <= 3
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= own[0]["size"]
    again = sorted((r["doc_id"], r["taken"]) for r in mixing.op5_mixing(docs.repartition(3)).collect())
    assert again == sorted((r["doc_id"], r["taken"]) for r in found)
