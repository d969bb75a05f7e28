"""Operators on small hand-made inputs with expected results."""

import pytest
from pyspark.sql import functions as F

from clausegraph.functions import providers
from clausegraph.functions.text import label_for, porter2, slug, stem, token_rows
from clausegraph.operators import graph, layout, link, parse, retrieve, validate, verify
from clausegraph.sources import io


def refs(spark, text, owner=None, last=44):
    rows = spark.createDataFrame([("n", owner, text)], "node_id string, owner string, text string")
    return sorted((r.dst or "-", r.resolution, r.act) for r in link.scan_references(rows, last).collect())


def test_reference_scan(spark):
    assert refs(spark, "clause (a) of sub-section (2) of section 10") == [("s-10-2-a", "qualified", None)]
    assert [r[0] for r in refs(spark, "sub-sections (1) and (5) of section 8")] == ["s-8-1", "s-8-5"]
    assert refs(spark, "under sub-section (5)", "s-8") == [("s-8-5", "relative", None)]
    assert refs(spark, "under sub-section (5)") == []
    assert refs(spark, "in section 81") == [("-", "external", None)]
    found = refs(spark, "section 3 of the Insolvency and Bankruptcy Code, 2016 and then sub-section (2)", "s-2")
    assert found == [("-", "external", "Insolvency and Bankruptcy Code, 2016")]
    assert [r[0] for r in refs(spark, "sections 10 and 11")] == ["s-10", "s-11"]
    assert [r[0] for r in refs(spark, "sections 10 and 81")] == ["-"]
    assert [r[0] for r in refs(spark, "see the Schedule, and the Schedule again")] == ["schedule"]


def test_stemmer_and_tokens(spark):
    for word, want in {"died": "die", "dies": "die", "consistency": "consist", "knightly": "knight", "generically": "generic", "hopping": "hop", "hoping": "hope", "skies": "sky", "happiness": "happi", "relational": "relat", "controlled": "control", "communication": "communic", "sensibilities": "sensibl"}.items():
        assert porter2(word) == want, word
    assert stem("8(5)") is None and stem("the") is None and stem("died") == "die"
    docs = spark.createDataFrame([(1, "Section 8(5) died")], "id int, text string")
    assert sorted(r.tok for r in token_rows(docs, "id", "text", stems=True).collect()) == ["8(5)", "die", "died", "section"]
    row = spark.createDataFrame([("s-8-5-a", "pen-2", "Personal Data, Breach")], "a string, b string, c string").select(label_for(F.col("a")), label_for(F.col("b")), slug(F.col("c"))).first()
    assert tuple(row) == ("§8(5)(a)", "Schedule entry 2", "personal-data-breach")


def test_layout(spark):
    hist = spark.createDataFrame([(141.5, 3), (142.0, 3), (166.0, 4)], "x double, n long")
    assert [(r.peak, r.n) for r in layout.peaks(hist, 5, 5).collect()] == [(141.8, 6)]
    snapped = spark.createDataFrame([(166.0,), (143.0,), (90.0,)], "x double").select(layout.snap(F.col("x"), 118, 24).alias("r"))
    assert [r.r for r in snapped.collect()] == [2, 1, 0]
    words = spark.createDataFrame([("d", 1, float(i), i + 1.0, t, str(t)) for i, t in enumerate((100.0, 103.0, 106.0))], io.SCHEMAS["words"].replace("top double, text", "top double, text"))
    rows = layout.group_rows(words, 4.8)
    assert sorted((r.top, r.row) for r in rows.collect()) == [(100.0, 0), (103.0, 0), (106.0, 1)]
    note = spark.createDataFrame([("d", 1, 1, 5.0, "45 of 1860. servants.")], "doc_id string, page int, seq int, top double, text string")
    stripped = layout.strip_citations(note).first()
    assert (stripped.citations, stripped.residue) == (["45 of 1860."], "servants.")
    cells = [("d", 21, 0, 0.0, 10.0, 14.0, "1."), ("d", 21, 0, 0.0, 40.0, 80.0, "Breach"), ("d", 21, 0, 0.0, 120.0, 160.0, "ten"), ("d", 21, 1, 9.0, 40.0, 80.0, "more"), ("d", 21, 1, 9.0, 120.0, 160.0, "rupees"), ("d", 21, 2, 18.0, 10.0, 14.0, "2."), ("d", 21, 2, 18.0, 40.0, 80.0, "Other"), ("d", 21, 2, 18.0, 120.0, 160.0, "one")]
    table = layout.parse_tables(spark.createDataFrame(cells, layout.ROW_SCHEMA))
    want = [(1, "Breach more", "ten rupees"), (2, "Other", "one")]
    assert [(r.sl_no, r.breach, r.penalty) for r in table.orderBy("sl_no").collect()] == want
    title = [("d", 21, -2, -18.0, 10.0, 160.0, "9."), ("d", 21, -1, -9.0, 10.0, 14.0, "(1)"), ("d", 21, -1, -9.0, 40.0, 44.0, "(2)"), ("d", 21, -1, -9.0, 120.0, 124.0, "(3)")]
    below = [("d", 21, 3, 27.0, 10.0, 160.0, "————————"), ("d", 21, 4, 36.0, 40.0, 160.0, "SECRETARY")]
    shifted = [(d, p, row + 2, *rest) for d, p, row, *rest in title + cells + below]
    bounded = layout.parse_tables(spark.createDataFrame(shifted, layout.ROW_SCHEMA))
    assert [(r.sl_no, r.breach, r.penalty) for r in bounded.orderBy("sl_no").collect()] == want


def test_parser(spark):
    texts = [(0, "CHAPTER II"), (0, "DUTIES"), (1, "6. (1) The consent"), (2, "(a) first"), (2, "(b) second"), (3, "(i) deep"), (1, "(2) More"), (0, "Illustration."), (2, "X is a person."), (1, "7. Plain"), (2, "(h) eight"), (2, "(i) nine"), (2, "(j) ten")]
    lines = spark.createDataFrame([("d", i, 1, float(i), 0.0, indent, t) for i, (indent, t) in enumerate(texts)], io.SCHEMAS["lines"])
    nodes = parse.parse(lines)
    got = {r.node_id: r for r in nodes.collect()}
    assert list(got) == ["act", "ch-II", "s-6", "s-6-1", "s-6-1-a", "s-6-1-b", "s-6-1-b-i", "s-6-2", "s-6-2-ill1", "s-7", "s-7-h", "s-7-i", "s-7-j"]
    assert got["s-6"].text == "" and got["s-6-1"].text == "The consent" and got["s-7-i"].kind == "Clause" and got["s-6-1-b-i"].kind == "SubClause"
    assert got["ch-II"].text == "DUTIES" and got["s-7"].chapter == "ch-II" and got["s-6-2-ill1"].follows == "s-6-2"
    both = ["Clause", "SubClause"]
    assert parse.kind_of(both, "i", None, False) == "SubClause" and parse.kind_of(both, "v", None, False) == "Clause"
    assert parse.kind_of(both, "i", "Clause", False) == "Clause" and parse.kind_of(both, "v", "SubClause", False) == "SubClause"
    assert validate.round_trip(nodes, lines).first().same
    assert validate.problems(nodes.withColumn("headnote", F.lit("h")), lines, {"Section": 2}, 0) == []
    assert validate.orphans(nodes).count() == 0


def test_parser_items_and_odd_lines(spark):
    texts = [(0, "Whereas"), (1, None), (1, "1. One"), (0, "Illustrations."), (2, "(A) first"), (2, "goes on"), (2, "(B) second"), (2, "(a) clause"), (4, "(C) item"), (0, "CHAPTER I"), (0, "CHAPTER I"), (1, "(2)"), (0, "")]
    lines = spark.createDataFrame([("d", i, 1, float(i), 0.0, indent, t) for i, (indent, t) in enumerate(texts)], io.SCHEMAS["lines"])
    got = {r.node_id: r for r in parse.parse(lines).collect()}
    assert [(r.node_id, r.parent_id, r.text) for r in got.values()] == [
        ("act", None, ""), ("preamble", "act", "Whereas"), ("s-1", "act", "One"), ("s-1-ill1", "s-1", ""), ("s-1-ill1-A", "s-1-ill1", "first goes on"),
        ("s-1-ill1-B", "s-1-ill1", "second"), ("s-1-a", "s-1", "clause"), ("s-1-a-C", "s-1-a", "item"), ("ch-I", "act", "CHAPTER I (2)")]
    assert got["s-1-a-C"].kind == "Item" and got["s-1-ill1"].follows == "s-1" and got["ch-I"].chapter == "ch-I"
    assert parse.parse(lines.limit(0)).count() == 0


def test_expansion_is_capped(spark):
    adj = spark.createDataFrame([("a", f"t{i:02}", "REFERENCES", 2, i, 0.0) for i in range(12)] + [("t00", "z", "REFERENCES", 2, 99, 0.0)], "chunk_id string, target string, type string, prio int, edge_seq int, authority double")
    seeds = spark.createDataFrame([(1, "a", 1)], "query_id int, chunk_id string, pos int")
    rows = retrieve.expand_graph(seeds, adj).collect()
    assert sum(r.hop == 1 for r in rows) == 10 and not any(r.hop == 2 for r in rows)
    few = retrieve.expand_graph(seeds, adj.where("edge_seq IN (0, 99)")).collect()
    assert {(r.chunk_id, r.hop, round(r.weight, 2)) for r in few} == {("a", 0, 1.0), ("t00", 1, 0.6), ("z", 2, 0.36)}


def test_fusion_context_abstain(spark):
    a = spark.createDataFrame([(1, "d", 0), (1, "e", 1)], "query_id int, k string, rank int")
    b = spark.createDataFrame([(1, "e", 0), (1, "d", 1)], "query_id int, k string, rank int")
    fused = {r.k: r.fused_score for r in retrieve.rrf([a, b], "k").collect()}
    assert fused["d"] == pytest.approx(1 / 61 + 1 / 62) and fused["d"] == pytest.approx(fused["e"])
    blocks = spark.createDataFrame([(1, 1, "x" * 6000), (1, 2, "y" * 5000), (1, 3, "z" * 1000)], "query_id int, pos int, b string")
    assert retrieve.context(blocks, "b").first().blocks == 1
    over = retrieve.context(blocks.where("pos = 1"), "b", 10).first()
    assert (over.query_id, over.context, over.blocks) == (1, "", 0)
    q = spark.createDataFrame([(1,), (2,), (3,)], "query_id int")
    got = spark.createDataFrame([(1, 0, 14.9), (2, 0, 15.0)], "query_id int, hop int, bm25_score double")
    assert {r.query_id: r.abstains for r in retrieve.abstain(q, got).collect()} == {1: True, 2: False, 3: True}


def test_vocabulary_and_intents(spark):
    asked = spark.createDataFrame([(1, "a hacker stole our customers"), (2, "please define consent")], "query_id int, question string")
    vocab, intents = io.vocabulary(spark, {"terms": {"customer": ["Data Principal"], "customers": ["Data Principal"], "hacker": ["personal data breach"]}, "intents": {"penalty_lookup": {"triggers": ["fine"]}}})
    rows = {r.query_id: r for r in retrieve.expand(asked, vocab).collect()}
    assert rows[1].expanded.count("Data Principal") == 2 and "personal data breach" in rows[1].expanded and rows[2].hits == []
    assert [(r.query_id, r.name) for r in retrieve.detect_intents(asked, intents).collect()] == [(2, "penalty_lookup")]


def test_citations(spark):
    answers = spark.createDataFrame([(1, "See §8(5)(z), §99(4), §12(1), §8(5) and Schedule entry 2.")], "query_id int, answer string")
    retrieved = spark.createDataFrame([(1, "s-8-5"), (1, "pen-2")], "query_id int, node_id string")
    known = spark.createDataFrame([("s-8",), ("s-8-5",), ("s-12-1",), ("pen-2",)], "node_id string")
    got = {r.cited: (r.status, r.nearest) for r in verify.check_citations(answers, retrieved, known).collect()}
    assert got == {"s-8-5-z": ("unresolved", "s-8-5"), "s-99-4": ("unresolved", None), "s-12-1": ("out_of_context", None), "s-8-5": ("verified", None), "pen-2": ("verified", None)}


def test_claims_quotes_amounts(spark):
    answers = spark.createDataFrame([(1, 'Short answer: yes. Section 29(1) states that any person aggrieved may appeal. It says "not in the text".')], "query_id int, answer string")
    claims = [r.claim for r in verify.split_claims(answers).orderBy("seq").collect()]
    assert claims[0] == "any person aggrieved may appeal."
    contexts = spark.createDataFrame([(1, "something else")], "query_id int, context string")
    assert [r.quote for r in verify.check_quotes(answers, contexts).collect()] == ["not in the text"]
    money = spark.createDataFrame([(1, "It may reach two hundred and fifty crore rupees.")], "query_id int, answer string")
    texts = spark.createDataFrame([(1, "May extend to two hundred and fifty crore rupees")], "query_id int, text string")
    assert verify.check_amounts(money, texts).count() == 0
    assert verify.check_amounts(money, texts.withColumn("text", F.lit("ten rupees"))).count() == 1


def test_quoted_spans_keep_the_other_marks(spark):
    said = 'A “token = "73” B "en nothing here" C "say ""yes"" “now”" D “mixed" E'
    got = spark.createDataFrame([(said,)], "answer string").select(verify.quoted(F.col("answer")).alias("q")).first().q
    assert got == ['token = "73', "en nothing here", 'say "yes" “now”', "mixed"]


def test_links(spark):
    nodes = spark.createDataFrame([("s-2-a", "s-2", "“processing” in relation to personal data, means work"), ("s-3", None, "the processing of data"), ("s-8-5", "s-8", "protect")], "node_id string, parent_id string, text string")
    d = link.definitions(nodes).first()
    assert (d.id, d.term, d.relation, d.qualifier) == ("def-processing", "processing", "means", "in relation to personal data")
    assert [(r.src, r.dst) for r in link.mentions(nodes, link.definitions(nodes)).collect()] == [("s-3", "def-processing")]
    schedule = spark.createDataFrame([(1, "breach of sub-section (5) of section 8", "ten")], "sl_no int, breach string, penalty string")
    assert [(r.src, r.dst) for r in link.penalty_edges(schedule, nodes, 44).collect()] == [("s-8-5", "pen-1")]
    sections = spark.createDataFrame([("s-1", 1, 10.0, 1), ("s-2", 1, 50.0, 2)], "node_id string, page int, top double, ord int")
    blocks = spark.createDataFrame([(1, 1, 12.0, "One"), (2, 1, 49.0, "Two")], "seq int, page int, top double, text string")
    none = spark.createDataFrame([], "node_id string, text string")
    assert {r.node_id: r.headnote for r in link.attach_headnotes(sections, blocks, none).collect()} == {"s-1": "One", "s-2": "Two"}


def test_pagerank_converges(spark):
    nodes = spark.createDataFrame([("a",), ("b",), ("c",)], "node_id string")
    edges = spark.createDataFrame([("a", "b", 1.0), ("b", "a", 1.0)], "src string, dst string, weight double")
    rank = {r.node_id: r.authority for r in graph.pagerank(nodes, edges).collect()}
    assert rank["a"] == rank["b"] > rank["c"] and sum(rank.values()) == pytest.approx(1, abs=1e-5)


def test_providers_and_publish(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "id long, text string")
    assert providers.embed(docs, "id", "text", providers.HashEmbedder()).count() == 2
    assert providers.generate(docs.fillna(""), "id", "text", providers.EchoGenerator()).where("error IS NULL").count() == 2
    nodes = spark.createDataFrame([("a", "Act", "l", "it's")], "node_id string, kind string, label string, text string")
    edges = spark.createDataFrame([("a", "a", "REFERENCES")], "src string, dst string, type string")
    assert io.publish({"nodes": nodes}, str(tmp_path), ["problem"]) is None and not list(tmp_path.iterdir())
    version = io.publish({"nodes": nodes, "edges": edges}, str(tmp_path))
    assert spark.read.parquet(f"{version}/nodes").count() == 1
    assert "it\\'s" in io.cypher(nodes, edges).first().value and io.gexf(nodes, edges).count() == 5


def test_citation_forms_with_blanks(spark):
    answers = spark.createDataFrame([("q", "See § 8 (5)( a ) and Schedule 2, then section 12(1).")], "query_id string, answer string")
    assert [r.cited for r in verify.citations(answers).orderBy("seq").collect()] == ["s-8-5-a", "pen-2", "s-12-1"]


def test_claims_lose_headings_and_attributions(spark):
    answers = spark.createDataFrame([("q", "The law says: under this section requires that notice be given to the Board.\nSchedule entry 1 provides that a penalty may be imposed.\nWhy: it is so.")], "query_id string, answer string")
    assert [r.claim for r in verify.split_claims(answers).orderBy("seq").collect()] == ["notice be given to the Board.", "a penalty may be imposed."]


def test_amounts_of_digits_and_small_numbers(spark):
    answers = spark.createDataFrame([("q", "You owe 500 rupees, ten rupees and up to two hundred and fifty crore rupees.")], "query_id string, answer string")
    held = spark.createDataFrame([("q", "may extend to two hundred and fifty crore rupees")], "query_id string, text string")
    assert sorted(r.amount for r in verify.check_amounts(answers, held).collect()) == ["500 rupees", "ten rupees"]


def test_compound_split_and_final_order(spark):
    asked = [("What must we tell the Board and whom else today?", True), ("What do we owe and to whom", False), ("What do we owe a person whose data we have lost", True), ("Is the fine for this higher or lower than that one", False)]
    frame = spark.createDataFrame(asked, "question string, want boolean")
    assert all(r.found == r.want for r in frame.select("want", retrieve.looks_compound().alias("found")).collect())
    replies = spark.createDataFrame([("a", "Who and what is it?", "1. Who is it then?\n- what is that\n* no\nWHO and what is it?"), ("b", "One?", None)], "query_id string, question string, reply string")
    parts = [tuple(r) for r in retrieve.split_questions(replies).orderBy("query_id", "sub_seq").collect()]
    assert parts == [("a", 0, "Who and what is it?"), ("a", 1, "Who is it then?"), ("a", 2, "what is that"), ("b", 0, "One?")]
    rows = spark.createDataFrame([("q", "x", 1, 0.6, 0.0, 1), ("q", "y", 0, 1.0, 2.0, 2), ("q", "z", 0, 1.0, 3.0, 3)], "query_id string, id string, hop int, weight double, score double, pos int")
    assert [r.id for r in retrieve.final_order(rows).orderBy("place").collect()] == ["z", "y", "x"]


def test_steps_are_taken_raw_and_rounded_to_points(spark):
    lines = spark.createDataFrame([(1, t) for t in (0.0, 11.6, 23.6, 35.4, 65.3, 71.2)], "page int, top double")
    assert [tuple(r) for r in layout.modal_delta(lines, 6.0, 30.0).collect()] == [(12.0, 3, 4.8)]


def test_closure_reaches_any_depth_and_refuses_circles(spark):
    chain = spark.createDataFrame([(i, i - 1 if i else None) for i in range(40)], "node_id int, parent_id int")
    far = graph.closure(chain)
    assert far.count() == 40 * 41 // 2 and far.agg(F.max("depth")).first()[0] == 39
    with pytest.raises(ValueError, match="circle"):
        graph.closure(spark.createDataFrame([(1, 3), (2, 1), (3, 2), (4, 1)], "node_id int, parent_id int"))


def test_vocabulary_by_first_words(spark):
    asked = spark.createDataFrame([(1, "Fined for data breaches?"), (2, "breachless"), (3, None), (4, "the data breach and data")], "query_id int, question string")
    vocab = spark.createDataFrame([(1, "fin", ["a"]), (2, "data breach", ["b", "c"]), (3, "data", ["d"]), (4, "!?", ["e"])], "vocab_seq int, phrase string, expansions array<string>")
    got = {r.query_id: (r.expanded, r.hits) for r in retrieve.expand(asked, vocab).collect()}
    assert got[1] == ("Fined for data breaches? b c d a", ["data", "data breach", "fin"])
    assert got[2] == ("breachless", []) and got[3][1] == [] and got[4] == ("the data breach and data b c d", ["data", "data breach"])
