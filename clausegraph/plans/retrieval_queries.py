"""Registered queries: index, search, fusion, context and evaluation over documents, benchmark and embeddings."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clausegraph.functions.text import SPACES, flat, token_rows, tokens, word_count
from clausegraph.operators import index, link, retrieve

TOP = 6
VOCAB = [(1, "que", ["quoi", "quel"]), (2, "the", ["article"]), (3, "tion", ["action", "motion"]), (4, "and", ["plus"]), (5, "der", ["die", "das"]), (6, "of the", ["from"])]
INTENTS = [("german", ["sch", "ung"], "de", None), ("french", ["eau", "que"], "fr", None), ("hot_source", ["thth"], None, "src0")]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _docs(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")


def _questions(spark, sf_dir):
    return read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))


def bm25_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    posted = index.postings(docs, "doc_id", "text").persist()
    sizes = index.doc_stats(posted, docs, "doc_id")
    n, average = sizes.agg(F.count("*"), F.avg("dl")).first()
    words = token_rows(_questions(spark, sf_dir), "query_id", "question")
    return retrieve.bm25(words, posted, index.tok_stats(posted, n), sizes, "doc_id", average)


def tokenize_counts(spark, sf_dir):
    words = tokens(F.coalesce("text", F.lit("")))
    return _docs(spark, sf_dir).select("doc_id", F.size(words).cast("long").alias("n_tokens"), F.size(F.array_distinct(words)).cast("long").alias("n_distinct"))


def postings_tf(spark, sf_dir):
    return index.postings(_docs(spark, sf_dir), "doc_id", "text").select("doc_id", "tok", "tf")


def tok_idf(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    return index.tok_stats(index.postings(docs, "doc_id", "text"), docs.count()).select("tok", "df", F.round("idf", 6).alias("idf"))


def bm25_topk(spark, sf_dir):
    return retrieve.top_k(bm25_scores(spark, sf_dir), TOP, tie="doc_id").select("query_id", "doc_id", F.col("bm25_score").alias("score"), "pos")


def intent_boosted_topk(spark, sf_dir):
    docs = _docs(spark, sf_dir).select("doc_id", "lang", "source")
    intents = spark.createDataFrame(INTENTS, "name string, triggers array<string>, kind string, chapter string")
    fired = retrieve.detect_intents(_questions(spark, sf_dir), intents).join(intents.drop("triggers"), "name")
    scored = bm25_scores(spark, sf_dir).join(docs, "doc_id")
    wanted = fired.select("query_id", "kind", "chapter")
    kinds = scored.select("query_id", "doc_id", "lang", "source").join(F.broadcast(wanted), "query_id").where("lang = kind OR source = chapter")
    return retrieve.top_k(retrieve.boost(scored, kinds, ["query_id", "doc_id"]), TOP, tie="doc_id").select("query_id", "doc_id", F.col("bm25_score").alias("score"), "pos")


def intent_detect(spark, sf_dir):
    intents = spark.createDataFrame(INTENTS, "name string, triggers array<string>, kind string, chapter string")
    return retrieve.detect_intents(_questions(spark, sf_dir), intents)


def vocab_expand(spark, sf_dir):
    said = read(spark, sf_dir, "conversations").where("role = 'user'")
    asked = said.select(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("query_id"), F.col("text").alias("question"))
    vocab = spark.createDataFrame(VOCAB, "vocab_seq int, phrase string, expansions array<string>")
    out = retrieve.expand(asked, vocab)
    return out.select("query_id", "expanded", F.array_join("hits", ",").alias("hits"))


def completeness_union(spark, sf_dir):
    """Seeds plus, for questions with the german intent, every document of source src1 that is no seed."""
    seeds = bm25_topk(spark, sf_dir).select("query_id", "doc_id", F.col("score").alias("bm25_score"))
    asked = intent_detect(spark, sf_dir).where("name = 'german'").select("query_id")
    wanted = _docs(spark, sf_dir).where("source = 'src1'").select("doc_id").crossJoin(F.broadcast(asked))
    return retrieve.complete(seeds, wanted, "doc_id").select("query_id", "doc_id", F.col("bm25_score").alias("score"))


def _centroids(spark, sf_dir):
    rows = read(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("at", "x"))
    means = rows.groupBy("label", "at").agg(F.round(F.avg(F.col("x").cast("decimal(20,10)")), 6).cast("double").alias("x"))
    return means.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda p: p["x"]).alias("q")).withColumnRenamed("label", "query_id")


def _dense(spark, sf_dir):
    vectors = read(spark, sf_dir, "embeddings").select(F.col("vec_id"), F.col("embedding").alias("v"))
    return retrieve.dense_scores(_centroids(spark, sf_dir), vectors, "vec_id")


def dense_topk(spark, sf_dir):
    """Each label's centroid is a query against all vectors."""
    return retrieve.top_k(_dense(spark, sf_dir), 10, "dense_score", "vec_id").select("query_id", "vec_id", F.col("dense_score").alias("score"), "pos")


def rrf_fuse(spark, sf_dir):
    """BM25 rank fused with the rank by number of different question tokens that a document holds."""
    docs, asked = _docs(spark, sf_dir), _questions(spark, sf_dir)
    cover = token_rows(asked, "query_id", "question").distinct().join(token_rows(docs, "doc_id", "text").distinct(), "tok").groupBy("query_id", "doc_id").agg(F.count("*").alias("held"))
    place = lambda by: F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(by), "doc_id")) - 1
    lists = [bm25_scores(spark, sf_dir).withColumn("s", F.round("bm25_score", 4)).withColumn("rank", place("s")), cover.withColumn("rank", place("held"))]
    fused = retrieve.rrf(lists, "doc_id")
    return retrieve.top_k(fused, TOP, "fused_score", "doc_id", 6).select("query_id", "doc_id", F.col("fused_score").alias("score"), "pos")


def context_budget(spark, sf_dir):
    top = bm25_topk(spark, sf_dir).join(_docs(spark, sf_dir).select("doc_id", "text"), "doc_id")
    out = retrieve.context(top, "text")
    return out.select("query_id", F.sha2("context", 256).alias("context_sha256"), F.length("context").cast("long").alias("n_chars"), "blocks")


def abstain_gate(spark, sf_dir):
    top = bm25_topk(spark, sf_dir).select("query_id", F.col("score").alias("bm25_score"), F.lit(0).alias("hop"))
    return retrieve.abstain(_questions(spark, sf_dir), top, 150.0)


def decompose_merge(spark, sf_dir):
    """The BM25 list is the question's own, the fused list a sub-question's."""
    one = bm25_topk(spark, sf_dir).withColumn("sub_seq", F.lit(0))
    two = rrf_fuse(spark, sf_dir).withColumn("sub_seq", F.lit(1))
    return retrieve.merge_subresults(one.unionByName(two), "doc_id").select("query_id", "doc_id", "score", "via_sub")


def chunk_long_split(spark, sf_dir):
    """Texts over 220 words are cut at line ends, others stay one chunk."""
    n = word_count(F.coalesce("text", F.lit("")))
    lines = F.filter(F.split("text", "\n"), lambda x: x != "")
    docs = _docs(spark, sf_dir).where("text IS NOT NULL").withColumn("parts", F.when(n > index.LONG_SECTION, lines).otherwise(F.array("text")))
    return docs.select("doc_id", F.posexplode("parts").alias("part", "chunk")).select("doc_id", F.col("part").cast("long"), F.length("chunk").cast("long").alias("n_chars"), F.sha2("chunk", 256).alias("chunk_sha256"))


def mentions_theta(spark, sf_dir):
    """Which documents name which term as a whole word."""
    terms = spark.createDataFrame([(t, t, "") for t in ("the", "nicht", "dans", "para", "the and")], "id string, term string, defined_in string")
    found = link.mentions(_docs(spark, sf_dir).select(F.col("doc_id").alias("node_id"), "text"), terms)
    return found.select(F.col("src").alias("doc_id"), F.col("dst").alias("term"))


def _flat_words(text: str) -> list[str]:
    """Words of ``functions.text.flat``."""
    for c, to in ("Σ", "σ"), ("İ", "i"), ("\t", " "), ("\n", " "), ("\f", " "), ("\r", " "):
        text = text.replace(c, to)
    words = [*filter(None, text.lower().split(" "))]
    if words and (words[0][0] in SPACES or words[-1][-1] in SPACES):
        words = [*filter(None, " ".join(words).strip(SPACES).split(" "))]
    return words


def _quotes_in(quotes):
    """Rows (item_id, doc_id) of the quotations that whole texts hold. A quotation's words but the first and last are whole
    words of such a text, so only a text with the rarest of them is searched for it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = Counter(w for _, q in quotes.value for w in set(q.split(" ")))
        routed, short = defaultdict(list), []
        for n, (_, quote) in enumerate(quotes.value):
            inner = quote.split(" ")[1:-1]
            (routed[min(inner, key=lambda w: (often[w], -len(w), w))] if inner else short).append(n)
        words = frozenset(routed)
        for batch in batches:
            items, docs = [], []
            for doc, text in zip(batch.column("doc_id"), batch.column("text").to_pylist(), strict=True):
                if text is None or not (own := _flat_words(text)):
                    continue
                body = " ".join(own)
                for n in chain(short, *(routed[w] for w in words.intersection(own))):
                    if quotes.value[n][1] in body:
                        items.append(quotes.value[n][0])
                        docs.append(doc)
            yield pa.RecordBatch.from_arrays([pa.array(items, pa.int64()), pa.array([d.as_py() for d in docs], pa.int64())], names=["item_id", "doc_id"])

    return run


def quote_check(spark, sf_dir):
    """Benchmark passages that stand word for word in documents; whole texts are compared."""
    quotes = read(spark, sf_dir, "benchmark").select("item_id", flat(F.col("text")).alias("quote")).where("quote <> ''").distinct()
    sent = spark.sparkContext.broadcast([(r.item_id, r.quote) for r in quotes.collect()])
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.mapInArrow(_quotes_in(sent), "item_id long, doc_id long").distinct()


def eval_hits(spark, sf_dir):
    """A question is a hit if one of its seeds is labelled good."""
    good = read(spark, sf_dir, "labels").where("quality = 1").select("doc_id").distinct()
    seeds = bm25_topk(spark, sf_dir).join(good.withColumn("good", F.lit(1)), "doc_id", "left")
    hits = seeds.groupBy("query_id").agg(F.max(F.coalesce("good", F.lit(0))).alias("hit"), F.sum(F.coalesce("good", F.lit(0))).alias("good_seeds"))
    return _questions(spark, sf_dir).join(hits, "query_id", "left").select("query_id", F.coalesce("hit", F.lit(0)).cast("int").alias("hit"), F.coalesce("good_seeds", F.lit(0)).cast("long").alias("good_seeds"))


def rubric(spark, sf_dir):
    """Answers (assistant turns) must say one thing and must not say another; both compared in lower case."""
    said = read(spark, sf_dir, "conversations").where("role = 'assistant' AND text IS NOT NULL")
    low = F.lower("text")
    must, never = low.contains("the"), low.contains("nicht")
    return said.select("conv_id", "turn", must.alias("says"), (~never).alias("avoids"), (must & ~never).alias("passes"))


_BM25_SQL = r"""
words AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+(?:\([a-z0-9]+\))?')) AS tok FROM documents),
postings AS (SELECT doc_id, tok, count(*) AS tf FROM words GROUP BY ALL),
sizes AS (SELECT d.doc_id, coalesce(sum(tf), 0) AS dl FROM documents d LEFT JOIN postings USING (doc_id) GROUP BY d.doc_id),
corpus AS (SELECT count(*) AS n, avg(dl) AS average FROM sizes),
raw AS (SELECT tok, count(*) AS df, ln((SELECT n FROM corpus) - count(*) + 0.5) - ln(count(*) + 0.5) AS r FROM postings GROUP BY tok),
idf AS (SELECT tok, df, CASE WHEN r < 0 THEN 0.25 * (SELECT avg(r) FROM raw) ELSE r END AS idf FROM raw),
asked AS (SELECT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+(?:\([a-z0-9]+\))?')) AS tok FROM benchmark),
terms AS (SELECT query_id, tok, count(*) AS qtf FROM asked GROUP BY ALL),
scored AS (
  SELECT query_id, p.doc_id, sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / (SELECT average FROM corpus)))) AS s
  FROM terms JOIN idf USING (tok) JOIN postings p USING (tok) JOIN sizes USING (doc_id) GROUP BY query_id, p.doc_id),
"""
_TOP_SQL = _BM25_SQL + """
top AS (SELECT * FROM (SELECT query_id, doc_id, round(s, 4) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 4) DESC, doc_id)::INT AS pos FROM scored) WHERE pos <= 6 AND score > 0),
"""
_INTENT_SQL = """
intents(name, trig, kind, chapter) AS (VALUES ('german', 'sch', 'de', NULL), ('german', 'ung', 'de', NULL), ('french', 'eau', 'fr', NULL), ('french', 'que', 'fr', NULL), ('hot_source', 'thth', NULL, 'src0')),
fired AS (SELECT DISTINCT item_id AS query_id, name, kind, chapter FROM benchmark, intents WHERE contains(lower(text), trig))
"""
_FUSE_SQL = """
cover AS (SELECT query_id, doc_id, count(*) AS held FROM (SELECT DISTINCT query_id, tok FROM asked) JOIN (SELECT DISTINCT doc_id, tok FROM words) USING (tok) GROUP BY ALL),
lists AS (
  SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 4) DESC, doc_id) - 1 AS rank FROM scored
  UNION ALL SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY held DESC, doc_id) - 1 FROM cover),
fused AS (SELECT query_id, doc_id, round(sum(1.0::DOUBLE / (60 + rank + 1)), 6) AS score FROM lists GROUP BY ALL),
fused_top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INT AS pos FROM fused) WHERE pos <= 6)
"""
_CENTROID_SQL = """
WITH parts AS (SELECT vec_id, label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS spot FROM embeddings),
means AS (SELECT label, spot, round(avg(x::DECIMAL(20,10)::DOUBLE), 6) AS x FROM parts GROUP BY ALL),
scores AS (SELECT m.label AS query_id, p.vec_id, round(sum(m.x * p.x::DOUBLE), 4) AS score FROM parts p JOIN means m USING (spot) GROUP BY ALL)
"""

QUERIES = {f.__name__: f for f in (tokenize_counts, postings_tf, tok_idf, bm25_topk, intent_boosted_topk, intent_detect, vocab_expand, completeness_union, dense_topk, rrf_fuse, context_budget, abstain_gate, decompose_merge, chunk_long_split, mentions_theta, quote_check, eval_hits, rubric)}

SQL = {
    "tokenize_counts": r"SELECT doc_id, len(t)::BIGINT AS n_tokens, len(list_distinct(t))::BIGINT AS n_distinct FROM (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+(?:\([a-z0-9]+\))?') AS t FROM documents)",
    "postings_tf": f"WITH {_BM25_SQL} done AS (SELECT 1) SELECT doc_id, tok, tf FROM postings",
    "tok_idf": f"WITH {_BM25_SQL} done AS (SELECT 1) SELECT tok, df, round(idf, 6) AS idf FROM idf",
    "bm25_topk": f"WITH {_TOP_SQL} done AS (SELECT 1) SELECT query_id, doc_id, score, pos FROM top",
    "intent_boosted_topk": f"""WITH {_BM25_SQL} {_INTENT_SQL},
      boosted AS (SELECT s.query_id, s.doc_id, round(s.s * CASE WHEN EXISTS (SELECT 1 FROM fired f WHERE f.query_id = s.query_id AND (f.kind = d.lang OR f.chapter = d.source)) THEN 1.6 ELSE 1 END, 4) AS score FROM scored s JOIN documents d USING (doc_id))
      SELECT * FROM (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INT AS pos FROM boosted) WHERE pos <= 6 AND score > 0""",
    "intent_detect": f"WITH {_INTENT_SQL} SELECT DISTINCT query_id, name FROM fired",
    "vocab_expand": r"""WITH vocab(seq, phrase, added) AS (VALUES (1, 'que', 'quoi quel'), (2, 'the', 'article'), (3, 'tion', 'action motion'), (4, 'and', 'plus'), (5, 'der', 'die das'), (6, 'of the', 'from')),
      asked AS (SELECT conv_id || ':' || turn AS query_id, text FROM conversations WHERE role = 'user'),
      fired AS (SELECT query_id, string_agg(added, ' ' ORDER BY -length(phrase), seq) AS more, string_agg(phrase, ',' ORDER BY phrase) AS hits FROM asked JOIN vocab ON regexp_matches(lower(text), '(^|[^\pL\pM\pN_])' || phrase || '(s|es|ed|ing)?([^\pL\pM\pN_]|$)') GROUP BY query_id)
      SELECT a.query_id, concat_ws(' ', a.text, f.more) AS expanded, coalesce(f.hits, '') AS hits FROM asked a LEFT JOIN fired f USING (query_id)""",
    "completeness_union": f"""WITH {_TOP_SQL} {_INTENT_SQL}
      SELECT query_id, doc_id, score FROM top UNION ALL
      SELECT f.query_id, d.doc_id, 0.0::DOUBLE FROM (SELECT DISTINCT query_id FROM fired WHERE name = 'german') f, documents d
      WHERE d.source = 'src1' AND NOT EXISTS (SELECT 1 FROM top t WHERE t.query_id = f.query_id AND t.doc_id = d.doc_id)""",
    "dense_topk": f"{_CENTROID_SQL} SELECT * FROM (SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS pos FROM scores) WHERE pos <= 10 AND score > 0",
    "rrf_fuse": f"WITH {_BM25_SQL} {_FUSE_SQL} SELECT query_id, doc_id, score, pos FROM fused_top",
    "context_budget": f"""WITH {_TOP_SQL} running AS (SELECT query_id, pos, text, sum(length(text)) OVER (PARTITION BY query_id ORDER BY pos) <= 10000 AS fits FROM top JOIN documents USING (doc_id)),
      out AS (SELECT query_id, coalesce(string_agg(text, chr(10) ORDER BY pos) FILTER (WHERE fits), '') AS c, count(*) FILTER (WHERE fits) AS blocks FROM running GROUP BY query_id)
      SELECT query_id, sha256(c) AS context_sha256, length(c)::BIGINT AS n_chars, blocks FROM out""",
    "abstain_gate": f"WITH {_TOP_SQL} best AS (SELECT query_id, max(score) AS t FROM top GROUP BY query_id) SELECT item_id AS query_id, coalesce(t, 0.0) AS top_score, coalesce(t, 0.0) < 150.0 AS abstains FROM benchmark LEFT JOIN best ON item_id = query_id",
    "decompose_merge": f"""WITH {_TOP_SQL} {_FUSE_SQL}, both_ AS (SELECT query_id, doc_id, score, 0 AS sub FROM top UNION ALL SELECT query_id, doc_id, score, 1 FROM fused_top)
      SELECT query_id, doc_id, score, CASE WHEN sub > 0 THEN sub END::INT AS via_sub FROM (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY sub) AS n FROM both_) WHERE n = 1""",
    "chunk_long_split": r"""WITH parts AS (SELECT doc_id, CASE WHEN len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) > 220 THEN list_filter(string_split(text, chr(10)), lambda x: x <> '') ELSE [text] END AS p FROM documents WHERE text IS NOT NULL)
      SELECT doc_id, (i - 1)::BIGINT AS part, length(c)::BIGINT AS n_chars, sha256(c) AS chunk_sha256 FROM (SELECT doc_id, unnest(p) AS c, generate_subscripts(p, 1) AS i FROM parts)""",
    "mentions_theta": r"WITH terms(term) AS (VALUES ('the'), ('nicht'), ('dans'), ('para'), ('the and')) SELECT doc_id, term FROM documents JOIN terms ON regexp_matches(text, '(^|[^\pL\pM\pN_])' || term || '([^\pL\pM\pN_]|$)')",
    "quote_check": r"""WITH q AS (SELECT item_id, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) AS quote FROM benchmark), d AS (SELECT doc_id, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) AS body FROM documents)
      SELECT DISTINCT item_id, doc_id FROM q JOIN d ON contains(body, quote) WHERE quote <> '' AND body <> ''""",
    "eval_hits": f"""WITH {_TOP_SQL} good AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1), h AS (SELECT query_id, count(g.doc_id) AS n FROM top LEFT JOIN good g USING (doc_id) GROUP BY query_id)
      SELECT item_id AS query_id, CASE WHEN coalesce(n, 0) > 0 THEN 1 ELSE 0 END::INT AS hit, coalesce(n, 0)::BIGINT AS good_seeds FROM benchmark LEFT JOIN h ON item_id = query_id""",
    "rubric": "SELECT conv_id, turn, contains(lower(text), 'the') AS says, NOT contains(lower(text), 'nicht') AS avoids, contains(lower(text), 'the') AND NOT contains(lower(text), 'nicht') AS passes FROM conversations WHERE role = 'assistant' AND text IS NOT NULL",
}
