"""What the operators leave in Python workers, which stay for later tasks and stages."""

import pyarrow as pa

from larkspur.llm import decontaminate, spm


def test_nothing_remembered_stays_after_a_task():
    texts = ["some plain words", None, "", "wörter und 12 other words " * 50]
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array([1, 2, 3, 4]), "text": pa.array(texts, pa.string())})
    a = spm.automaton(spm.MODEL)
    (got,) = spm._single(iter([batch]), spm.Pieces())
    assert got["_ids"].to_pylist() == [None if t is None else a.sp.encode(t) for t in texts]
    assert not a._stretch and not a._last and not a._valid


def test_items_ids_need_no_python_worker(spark):
    docs = spark.createDataFrame([(1, "x y the quick brown fox jumps over z"), (2, "nothing of it"), (3, None)], "doc_id long, text string")
    for kind, ids in (("int", (7, 8, None)), ("string", ("a", "b", None))):
        bench = spark.createDataFrame([(ids[0], "quick brown fox jumps"), (ids[1], None), (ids[2], "the quick brown fox")], f"item_id {kind}, text string")
        found = decontaminate.leaks(docs, bench)
        assert dict(found.dtypes)["item_id"] == kind
        assert sorted(((r["doc_id"], r["item_id"]) for r in found.collect()), key=str) == sorted([(1, ids[0]), (1, None)], key=str)
    empty = spark.sql("SELECT 'a' AS item_id, 'some text of an item' AS text")
    plan = decontaminate.leaks(spark.sql("SELECT 1L AS doc_id, 'some text' AS text"), empty)._jdf.queryExecution().optimizedPlan().toString()
    assert "LocalRelation" in plan and "LogicalRDD" not in plan
    assert decontaminate.leaks(docs, empty.limit(0)).collect() == []
