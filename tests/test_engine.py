"""Whole questions over a hand-made library."""

import pytest

from clausegraph.operators import engine

CHUNKS = [("c1", 1, "Section", "ch-I", "H1", "consent of the child"), ("c2", 2, "Section", "ch-II", "H2", "notice of breaches to the board"), ("c3", 3, "Penalty", "", "H3", "two hundred crore"), ("c4", 4, "Section", "ch-II", "H4", "appeal and tribunal"), ("c5", 5, "SubSection", "ch-I", "H5", "guardian verifies age")]


@pytest.fixture(scope="module")
def library(spark):
    rows = [(*c, c[0].upper(), f"{c[4]} {c[5]}") for c in CHUNKS]
    chunks = spark.createDataFrame(rows, "chunk_id string, chunk_seq int, kind string, chapter string, header string, verbatim string, label string, document string")
    vocab = spark.createDataFrame([(1, "kid", ["child"])], engine.VOCAB)
    intents = spark.createDataFrame([("fines", ["how much"], "Penalty", None, True)], engine.INTENTS)
    edges = spark.createDataFrame([("c1", "c4", "REFERENCES", 2, 1, 0.1), ("c4", "c2", "MENTIONS", 5, 2, 0.1)], engine.ADJACENCY)
    made = engine.Library(chunks, vocab, intents, edges, spark.createDataFrame([("c5", "c1")], engine.PARENTS))
    yield made
    made.close()


def test_whole_questions(spark, library):
    asked = spark.createDataFrame([(1, "What of kids?"), (2, "How much for a breach?"), (3, "zzz"), (4, None)], "query_id int, question string")
    got = {r.query_id: r for r in engine.answer(asked, library, engine.EngineConfig(least_score=0.5)).collect()}
    assert len(got) == 4 and got[3].outcome == got[4].outcome == "no_results" and got[4].context == ""
    assert got[1].outcome == "answered" and got[1].retrieved[0] == "c1" and "c4" in got[1].retrieved and got[1].context.startswith("=== C1 ===\nH1\n---\nconsent of the child\n\n=== C2 ===\nH2\n---\n")
    assert got[2].retrieved[0] == "c2" and "c3" in got[2].retrieved  # stems meet breach and breaches; fines come whole
    short = engine.answer(asked.where("query_id = 1"), library, engine.EngineConfig(context_chars=3, least_score=1000.0)).first()
    assert short.context == "" and short.outcome == "abstained" and short.retrieved == got[1].retrieved
    assert engine.answer(asked.limit(0), library).count() == 0


def test_parents_replace_their_parts(spark, library):
    asked = spark.createDataFrame([(1, "guardian age")], "query_id int, question string")
    parts = [r.chunk_id for r in engine.search(asked, library, engine.EngineConfig(promote=True)).orderBy("place").collect()]
    assert parts == ["c1", "c4"]
    with pytest.raises(ValueError, match="stems"):
        engine.search(asked, library, engine.EngineConfig(stems=False))
