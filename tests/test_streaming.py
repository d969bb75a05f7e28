import json

from clausegraph.streaming import answer


def test_questions_are_answered_once(spark, tmp_path):
    asked = tmp_path / "asked"
    asked.mkdir()
    rows = [{"request_id": "r1", "question": "red fox", "k": 3, "ts": "2024-01-01T00:00:00"}, {"request_id": "r1", "question": "red fox", "k": 3, "ts": "2024-01-01T00:00:00"}, {"request_id": "r2", "question": "x", "k": 3, "ts": "2024-01-01T00:00:00"}]
    (asked / "a.json").write_text("\n".join(map(json.dumps, rows)))
    docs = spark.createDataFrame([(1, "a red fox ran"), (2, "a blue whale"), (3, "green"), (4, "black")], "doc_id long, text string")
    corpus = answer.Corpus(docs, "doc_id", "text")
    query = answer.start(answer.read_questions(spark, str(asked)), corpus, str(tmp_path / "audit"), str(tmp_path / "checkpoint"))
    query.awaitTermination(120)
    out = spark.read.option("basePath", str(tmp_path / "audit")).parquet(str(tmp_path / "audit")).collect()
    assert [(r.request_id, r.outcome) for r in out] == [("r1", "abstained")] and out[0].retrieved[0].id == "1"


def test_inflected_questions_find_documents(spark):
    docs = spark.createDataFrame([(1, "the processor notified a breach"), (2, "a blue whale"), (3, "green")], "doc_id long, text string")
    asked = spark.createDataFrame([("r1", "notifying breaches", 3)], "request_id string, question string, k int")
    found = answer.Corpus(docs, "doc_id", "text").answer(asked).collect()
    assert [r.id for r in found[0].retrieved] == ["1"]
