"""Registered queries of operators on provisions, answers and rankings, over provisions made from the relational tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from clausegraph.operators import engine, graph, index, retrieve, validate, verify
from clausegraph.plans.retrieval_queries import _BM25_SQL, INTENTS, VOCAB, read


def _id(prefix: str, column: str):
    return F.concat(F.lit(f"{prefix}-"), F.col(column).cast("string"))


def subtree_hits(spark, sf_dir):
    """A case wants its order's and its customer's number; seeds are provisions of that number or below it."""
    cases = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("query_id"), F.array(_id("s", "o_orderkey"), _id("s", "o_custkey")).alias("want"))
    seeds = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("query_id"), F.concat_ws("-", _id("s", "l_partkey"), "l_linenumber").alias("node_id"))
    return verify.retrieval_hits(cases, seeds)


def rubric_cases(spark, sf_dir):
    said = read(spark, sf_dir, "conversations").where("role = 'assistant' AND text IS NOT NULL")
    cases = said.select(
        F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("query_id"),
        F.col("text").alias("answer"),
        F.array(_id("s", "turn")).alias("cited"),
        F.expr("filter(array('s-9'), x -> turn % 5 = 3)").alias("unresolved"),
        F.array(F.lit("s-1")).alias("cites_any"),
        F.array(F.lit("The")).alias("must_say"),
        F.array(F.lit("NICHT")).alias("must_not_say"),
        (F.col("conv_id") % 7 == 0).alias("abstain"),
    )
    return verify.rubric(cases).select("query_id", F.array_join("problems", "; ").alias("problems"))


def quotes_missing(spark, sf_dir):
    """Each document's answer quotes its first 30 characters and words that it does not hold; every third context is short."""
    docs = read(spark, sf_dir, "documents").where("text IS NOT NULL")
    marked = lambda c: F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
    answer = F.concat(F.lit("It says "), marked(F.substring("text", 1, 30)), F.lit(" and "), marked(F.concat(F.coalesce("lang", F.lit("")), F.lit(" nothing here"))), F.lit("."))
    context = F.when(F.col("doc_id") % 3 == 0, F.substring("text", 1, 20)).otherwise(F.col("text"))
    return verify.missing_quotes(docs.select(F.col("doc_id").alias("query_id"), answer.alias("answer"), context.alias("context")))


def amounts_missing(spark, sf_dir):
    lines = read(spark, sf_dir, "lineitem").withColumn("query_id", F.concat_ws(":", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")))
    answers = lines.select("query_id", F.concat(F.lit("You owe "), F.col("l_quantity").cast("int").cast("string"), F.lit(" crore rupees, or Fifty  lakh")).alias("answer"))
    penalties = lines.select("query_id", F.concat(F.lit("Up to "), (F.col("l_linenumber") * 7).cast("string"), F.lit(" crore rupees")).alias("text"))
    return verify.check_amounts(answers, penalties)


def claims_split(spark, sf_dir):
    """Answers with headings, attributions and a sentence too short to be a claim."""
    orders = read(spark, sf_dir, "orders")
    answer = F.concat(F.lit("The law says: Section "), F.col("o_orderkey").cast("string"), F.lit(" states that the buyer is customer "), F.col("o_custkey").cast("string"), F.lit(" alone. Pay.\nWhat to do: keep the receipt of order "), F.col("o_orderkey").cast("string"), F.lit("!"))
    return verify.split_claims(orders.select(F.col("o_orderkey").alias("query_id"), answer.alias("answer"))).select("query_id", F.col("seq").cast("int").alias("seq"), "claim")


def chunk_headers(spark, sf_dir):
    """Orders as sections that cite suppliers, or are penalised by those of returned lines."""
    nodes = read(spark, sf_dir, "orders").select(_id("s", "o_orderkey").alias("node_id"), F.col("o_orderpriority").alias("chapter"), F.concat(F.lit("Section "), F.col("o_orderkey").cast("string")).alias("label"), F.when(F.col("o_orderstatus") == "F", "Filled").otherwise("").alias("headnote"))
    edges = read(spark, sf_dir, "lineitem").select(_id("s", "l_orderkey").alias("src"), _id("v", "l_suppkey").alias("dst"), F.when(F.col("l_returnflag") == "R", "PENALISED_BY").otherwise("REFERENCES").alias("type"))
    labels = read(spark, sf_dir, "supplier").select(_id("v", "s_suppkey").alias("node_id"), F.col("s_name").alias("label"))
    return index.headers(nodes, edges, labels)


def rendered_trees(spark, sf_dir):
    """Regions with their nations as indented text."""
    region = read(spark, sf_dir, "region").select(_id("r", "r_regionkey").alias("node_id"), F.lit(None).cast("string").alias("parent_id"), F.lit("Section").alias("kind"), _id("r", "r_regionkey").alias("prefix"), F.col("r_name").alias("text"), F.concat(F.lpad(F.col("r_regionkey").cast("string"), 3, "0"), F.lit("-")).alias("ord"))
    nation = read(spark, sf_dir, "nation").select(_id("n", "n_nationkey"), _id("r", "n_regionkey"), F.lit("SubSection"), _id("n", "n_nationkey"), F.when(F.col("n_nationkey") % 4 == 0, "").otherwise(F.col("n_name")), F.concat_ws("-", F.lpad(F.col("n_regionkey").cast("string"), 3, "0"), F.lpad(F.col("n_nationkey").cast("string"), 3, "0")))
    nodes = region.union(nation)
    return index.render(nodes, graph.closure(nodes.select("node_id", "parent_id")))


def compound_flags(spark, sf_dir):
    said = read(spark, sf_dir, "conversations").where("role = 'user' AND text IS NOT NULL")
    return said.select("conv_id", "turn", retrieve.looks_compound("text").alias("compound"))


def sub_questions(spark, sf_dir):
    orders = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("query_id"), F.col("o_orderkey").cast("string").alias("n"))
    question = F.concat(F.lit("Who pays for order "), "n", F.lit(" and when is it due?"))
    reply = F.concat(F.lit("1. Who pays for order "), "n", F.lit("\n- Two words\n\n• when is it due\n* WHO pays for order "), "n", F.lit(" and when is it due?"))
    return retrieve.split_questions(orders.select("query_id", question.alias("question"), reply.alias("reply"))).select("query_id", F.col("sub_seq").cast("int").alias("sub_seq"), "question")


def promoted_parents(spark, sf_dir):
    """Suppliers ask for orders; filled orders belong to their customer."""
    lines = read(spark, sf_dir, "lineitem")
    seeds = lines.groupBy(F.col("l_suppkey").alias("query_id"), _id("o", "l_orderkey").alias("chunk_id")).agg(F.max("l_quantity").cast("double").alias("bm25_score"))
    parents = read(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(_id("o", "o_orderkey").alias("chunk_id"), _id("c", "o_custkey").alias("parent_chunk"))
    return retrieve.promote_parents(seeds, parents)


def rerank_pool(spark, sf_dir):
    """Per supplier the 20 parts of largest quantity by size, then the others by price."""
    sold = read(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("query_id"), F.col("l_partkey").alias("part")).agg(F.sum(F.col("l_quantity").cast("long")).cast("double").alias("fused_score"))
    sizes = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), F.col("p_size").cast("double").alias("rerank_score"))
    both = sold.join(sizes, "part")
    scores, ranks = both.select("query_id", "part", "rerank_score"), both.select("query_id", "part", (F.col("part") % 97).alias("rank"))
    return retrieve.rerank(both.select("query_id", "part", "fused_score"), scores, ranks, "part").select("query_id", "part", "pos")


def final_places(spark, sf_dir):
    found = read(spark, sf_dir, "events").select(F.col("user_id").alias("query_id"), "event_id", (F.col("event_id") % 3).alias("hop"), F.round("value").alias("weight"), (F.col("event_id") % 5).alias("score"))
    return retrieve.final_order(found, "event_id").select("query_id", "event_id", "place")


def orphan_nodes(spark, sf_dir):
    """Orders under the customers that are not in debt."""
    customers = read(spark, sf_dir, "customer").where("c_acctbal >= 0").select(_id("c", "c_custkey").alias("node_id"), F.lit(None).cast("string").alias("parent_id"))
    orders = read(spark, sf_dir, "orders").select(_id("o", "o_orderkey"), _id("c", "o_custkey"))
    return validate.orphans(customers.union(orders)).select("node_id", "parent_id")


def missing_sections(spark, sf_dir):
    nodes = read(spark, sf_dir, "lineitem").select(F.concat_ws("-", _id("s", "l_orderkey"), "l_linenumber").alias("node_id"), F.when(F.col("l_linenumber") == 1, "Section").otherwise("SubSection").alias("kind"))
    return validate.missing_numbers(nodes, 5000).select("id")


def retrieve_full(spark, sf_dir):
    """Whole questions through the engine: rewriting, BM25, boosts, order, abstention and context (plain words, no graph)."""
    docs = read(spark, sf_dir, "documents").withColumn("chunk_label", F.concat(F.lit("Document "), F.col("doc_id").cast("string")))
    text = F.coalesce("text", F.lit(""))
    chunks = docs.select(F.col("doc_id").cast("string").alias("chunk_id"), F.col("doc_id").alias("chunk_seq"), F.col("lang").alias("kind"), F.col("source").alias("chapter"), F.col("chunk_label").alias("label"), F.concat(F.lit("["), F.coalesce("source", F.lit("")), F.lit("]")).alias("header"), text.alias("verbatim"), text.alias("document"))
    intents = spark.createDataFrame([(*i, False) for i in INTENTS], engine.INTENTS)
    library = engine.Library(chunks, spark.createDataFrame(VOCAB, engine.VOCAB), intents, stems=False)
    asked = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))
    out = engine.answer(asked, library, engine.EngineConfig(stems=False, least_score=150.0))
    return out.select("query_id", "outcome", "top_score", F.array_join("retrieved", ",").alias("retrieved"), F.sha2("context", 256).alias("context_sha256"))


QUERIES = {f.__name__: f for f in (subtree_hits, rubric_cases, quotes_missing, amounts_missing, claims_split, chunk_headers, rendered_trees, compound_flags, sub_questions, promoted_parents, rerank_pool, final_places, orphan_nodes, missing_sections, retrieve_full)}

_FLAT = r"""trim(regexp_replace(lower(translate({}, '“”‘’', '""''''')), '\s+', ' ', 'g'))"""

SQL = {
    "subtree_hits": "SELECT o_orderkey AS query_id, EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_partkey IN (o_orderkey, o_custkey)) AS hit FROM orders",
    "rubric_cases": """SELECT conv_id || ':' || turn AS query_id, concat_ws('; ',
        CASE WHEN conv_id % 7 = 0 THEN 'cites while it should abstain' END,
        CASE WHEN conv_id % 7 = 0 AND contains(lower(text), 'rupees') THEN 'names an amount while it should abstain' END,
        CASE WHEN turn % 5 = 3 THEN 'cites what does not exist' END, CASE WHEN turn <> 1 THEN 'cites none of the expected' END,
        CASE WHEN NOT contains(lower(text), 'the') THEN 'misses a statement' END, CASE WHEN contains(lower(text), 'nicht') THEN 'says what it must not' END) AS problems
      FROM conversations WHERE role = 'assistant' AND text IS NOT NULL""",
    "quotes_missing": f"""WITH a AS (SELECT doc_id AS query_id, [substr(text, 1, 30), coalesce(lang, '') || ' nothing here'] AS q, CASE WHEN doc_id % 3 = 0 THEN substr(text, 1, 20) ELSE text END AS c FROM documents WHERE text IS NOT NULL),
      e AS (SELECT query_id, unnest(q) AS quote, c FROM a)
      SELECT DISTINCT query_id, quote FROM e WHERE length(quote) >= 8 AND NOT contains({_FLAT.format('c')}, {_FLAT.format('quote')})""",
    "amounts_missing": """WITH a AS (SELECT l_orderkey || ':' || l_linenumber AS query_id, unnest([l_quantity::INT || ' crore rupees', 'fifty lakh']) AS amount, 'up to ' || (l_linenumber * 7) || ' crore rupees' AS t FROM lineitem)
      SELECT DISTINCT query_id, amount FROM a WHERE NOT contains(t, amount) AND NOT contains(amount, t)""",
    "claims_split": """SELECT o_orderkey AS query_id, 0 AS seq, 'the buyer is customer ' || o_custkey || ' alone.' AS claim FROM orders
      UNION ALL SELECT o_orderkey, 2, 'keep the receipt of order ' || o_orderkey || '!' FROM orders""",
    "chunk_headers": """WITH l AS (SELECT l_orderkey, string_agg(DISTINCT s_name, ', ' ORDER BY s_name) FILTER (WHERE l_returnflag <> 'R') AS cites, string_agg(DISTINCT s_name, ', ' ORDER BY s_name) FILTER (WHERE l_returnflag = 'R') AS fines FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1)
      SELECT 's-' || o_orderkey AS node_id, concat_ws(chr(10), '[' || o_orderpriority || ']', 'Section ' || o_orderkey || CASE WHEN o_orderstatus = 'F' THEN ' — Filled' ELSE '' END, 'Cites: ' || cites, 'Penalised by: ' || fines) AS header FROM orders LEFT JOIN l ON l_orderkey = o_orderkey""",
    "rendered_trees": """WITH n AS (SELECT n_regionkey AS r, n_nationkey AS k, 'n-' || n_nationkey || CASE WHEN n_nationkey % 4 = 0 THEN '' ELSE ' ' || n_name END AS line FROM nation)
      SELECT 'r-' || r_regionkey AS anc_id, 'r-' || r_regionkey || ' ' || r_name || coalesce(chr(10) || (SELECT string_agg('  ' || line, chr(10) ORDER BY k) FROM n WHERE r = r_regionkey), '') AS verbatim FROM region
      UNION ALL SELECT 'n-' || k, line FROM n""",
    "compound_flags": r"""SELECT conv_id, turn, len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) >= 9 AND regexp_matches(text, '(?i)(^|[^\pL\pM\pN_])(and|also|what do we owe|to whom|as well as|both)([^\pL\pM\pN_]|$)|,\s*(and\s+)?(what|who|how|when|do|does|can|is|are)([^\pL\pM\pN_]|$)|;') AS compound FROM conversations WHERE role = 'user' AND text IS NOT NULL""",
    "sub_questions": """SELECT o_orderkey AS query_id, 0 AS sub_seq, 'Who pays for order ' || o_orderkey || ' and when is it due?' AS question FROM orders
      UNION ALL SELECT o_orderkey, 1, 'Who pays for order ' || o_orderkey FROM orders UNION ALL SELECT o_orderkey, 2, 'when is it due' FROM orders""",
    "promoted_parents": """SELECT l_suppkey AS query_id, CASE WHEN o_orderstatus = 'F' THEN 'c-' || o_custkey ELSE 'o-' || l_orderkey END AS chunk_id, max(l_quantity)::DOUBLE AS bm25_score FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey GROUP BY 1, 2""",
    "rerank_pool": """WITH s AS (SELECT l_suppkey AS q, l_partkey AS part, sum(l_quantity::BIGINT) AS f FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ALL),
      p AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY f DESC, part) <= 20 AS pooled FROM s)
      SELECT q AS query_id, part, row_number() OVER (PARTITION BY q ORDER BY pooled DESC, CASE WHEN pooled THEN -p_size ELSE part % 97 END, part)::INT AS pos FROM p JOIN part ON p_partkey = part""",
    "final_places": "SELECT user_id AS query_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id % 3, round(value) DESC, event_id % 5 DESC, event_id)::INT AS place FROM events",
    "orphan_nodes": "SELECT 'o-' || o_orderkey AS node_id, 'c-' || o_custkey AS parent_id FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0)",
    "missing_sections": "SELECT range AS id FROM range(1, 5001) WHERE range NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 1)",
    "retrieve_full": "WITH " + _BM25_SQL.replace("FROM benchmark", "FROM rewritten").replace("\nwords AS", r"""
vocab(seq, phrase, added) AS (VALUES (1, 'que', 'quoi quel'), (2, 'the', 'article'), (3, 'tion', 'action motion'), (4, 'and', 'plus'), (5, 'der', 'die das'), (6, 'of the', 'from')),
fired AS (SELECT item_id, string_agg(added, ' ' ORDER BY -length(phrase), seq) AS more FROM benchmark JOIN vocab ON regexp_matches(lower(text), '(^|[^\pL\pM\pN_])' || phrase || '(s|es|ed|ing)?([^\pL\pM\pN_]|$)') GROUP BY item_id),
rewritten AS (SELECT item_id, concat_ws(' ', text, more) AS text FROM benchmark LEFT JOIN fired USING (item_id)),
words AS""", 1) + """
intents(trig, kind, chapter) AS (VALUES ('sch', 'de', NULL), ('ung', 'de', NULL), ('eau', 'fr', NULL), ('que', 'fr', NULL), ('thth', NULL, 'src0')),
meant AS (SELECT DISTINCT item_id, kind, chapter FROM benchmark, intents WHERE contains(lower(text), trig)),
boosted AS (SELECT query_id, doc_id, source, coalesce(text, '') AS t, round(s * CASE WHEN EXISTS (SELECT 1 FROM meant WHERE item_id = query_id AND (kind = lang OR chapter = source)) THEN 1.6 ELSE 1 END, 4) AS score FROM scored JOIN documents USING (doc_id)),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS pos FROM boosted) WHERE pos <= 6 AND score > 0),
shown AS (SELECT *, '=== Document ' || doc_id || ' ===' || chr(10) || '[' || coalesce(source, '') || ']' || chr(10) || '---' || chr(10) || t || chr(10) AS block FROM top),
fit AS (SELECT *, sum(length(block)) OVER (PARTITION BY query_id ORDER BY pos) <= 10000 AS fits FROM shown),
out AS (SELECT query_id, max(score) AS top_score, string_agg(doc_id, ',' ORDER BY pos) AS retrieved, coalesce(string_agg(block, chr(10) ORDER BY pos) FILTER (WHERE fits), '') AS context FROM fit GROUP BY query_id)
SELECT item_id AS query_id, CASE WHEN retrieved IS NULL THEN 'no_results' WHEN top_score < 150 THEN 'abstained' ELSE 'answered' END AS outcome, coalesce(top_score, 0) AS top_score, coalesce(retrieved, '') AS retrieved, sha256(coalesce(context, '')) AS context_sha256
FROM benchmark LEFT JOIN out ON query_id = item_id""",
}
