"""Batched retrieval: rewriting, BM25, boosts, dense ranks, fusion, expansion, context, abstention, merging.

All functions take many questions at once, keyed by ``query_id``. Ties always end in a unique key. BM25, fused and
rerank scores stay in columns of their own; the abstention gate reads the BM25 score.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausegraph.operators.index import B, K1

BOOST, HOPS, MAX_ADDED, DECAY = 1.6, 2, 10, 0.6
RRF_K, POOL, ABSTAIN, CONTEXT = 60, 20, 15.0, 10_000
#: Rows up to which a side is broadcast by hint; larger ones go through shuffled joins.
SMALL = 200_000


def checked(df: DataFrame, limit: int = SMALL) -> DataFrame:
    """Broadcast hint after counting, at most ``limit`` rows."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


# Endings that a phrase of the vocabulary may carry in a question.
ENDINGS = ["s", "es", "ed", "ing"]


def expand(questions: DataFrame, vocab: DataFrame) -> DataFrame:
    """``questions(query_id, question)``, ``vocab(vocab_seq, phrase, expansions)`` -> adds expanded, hits. All phrases
    fire, also overlapping ones; longer phrases first; additions keep repeats. Questions and phrases meet by the phrase's
    first word, with or without an ending, so no question is compared with every phrase; phrases without a word never fire."""
    words = questions.select("query_id", F.explode(F.regexp_extract_all(F.lower("question"), F.lit(r"(?U)(\w+)"), 1)).alias("w")).distinct()
    bare = [F.when(F.endswith("w", F.lit(e)), F.expr(f"left(w, length(w) - {len(e)})")) for e in ENDINGS]
    words = words.select("query_id", F.explode(F.array_compact(F.array("w", *bare))).alias("w")).distinct()
    heads = vocab.select("vocab_seq", "phrase", "expansions", F.regexp_extract("phrase", r"(?U)(\w+)", 1).alias("w")).where("w <> ''")
    met = questions.select("query_id", "question").join(words.join(heads, "w"), "query_id")
    fired = met.where(F.expr(r"lower(question) rlike concat('(?U)\\b\\Q', phrase, '\\E(?:s|es|ed|ing)?\\b')"))
    order = F.array_sort(F.collect_list(F.struct((-F.length("phrase")).alias("a"), "vocab_seq", "expansions")))
    added = fired.groupBy("query_id").agg(F.array_join(F.flatten(F.transform(order, lambda x: x["expansions"])), " ").alias("added"), F.array_sort(F.collect_set("phrase")).alias("hits"))
    joined = questions.join(added, "query_id", "left")
    return joined.select(*questions.columns, F.concat_ws(" ", "question", "added").alias("expanded"), F.coalesce("hits", F.array().cast("array<string>")).alias("hits"))


def detect_intents(questions: DataFrame, intents: DataFrame) -> DataFrame:
    """query_id, name: any trigger of ``intents(name, triggers, ...)`` is a substring of the lower-case question."""
    triggers = intents.select("name", F.explode("triggers").alias("trigger"))
    return questions.join(checked(triggers), F.lower("question").contains(F.col("trigger"))).select("query_id", "name").distinct()


def bm25(query_tokens: DataFrame, posted: DataFrame, tok_stats: DataFrame, doc_stats: DataFrame, key: str, avgdl: float) -> DataFrame:
    """query_id, key, bm25_score of all documents that share a token; repeated question tokens count again."""
    terms = query_tokens.groupBy("query_id", "tok").agg(F.count("*").alias("qtf")).join(tok_stats.select("tok", "idf"), "tok")
    joined = posted.join(checked(terms), "tok").join(doc_stats, key)
    tf = F.col("tf")
    score = F.col("qtf") * F.col("idf") * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / avgdl))
    return joined.groupBy("query_id", key).agg(F.sum(score).alias("bm25_score"))


def boost(scored: DataFrame, boosted: DataFrame, on: list[str]) -> DataFrame:
    """Scores times BOOST, once, for (query, kind or chapter) pairs in ``boosted``."""
    return scored.join(boosted.select(*on).distinct().withColumn("fits", F.lit(True)), on, "left").withColumn("bm25_score", F.when(F.col("fits"), F.col("bm25_score") * BOOST).otherwise(F.col("bm25_score"))).drop("fits")


def top_k(scored: DataFrame, k: int, score: str = "bm25_score", tie: str = "chunk_seq", digits: int = 4) -> DataFrame:
    """The k best per query by rounded score, ties by ``tie``; then those of score 0 or less go."""
    rounded = scored.withColumn(score, F.round(score, digits))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(score), tie))
    return rounded.withColumn("pos", place).where((F.col("pos") <= k) & (F.col(score) > 0))


def complete(seeds: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """Adds the rows of ``wanted(query_id, key)`` that are not seeds, with score 0."""
    missing = wanted.join(seeds.select("query_id", key), ["query_id", key], "left_anti")
    return seeds.unionByName(missing.withColumn("bm25_score", F.lit(0.0)), allowMissingColumns=True)


def dense_scores(queries: DataFrame, vectors: DataFrame, key: str) -> DataFrame:
    """query_id, key, dense_score (dot product) of each query against all vectors: a stated set of queries, in
    blocks of SMALL, each of a size proven before it is broadcast."""
    dot = F.aggregate(F.zip_with("q", "v", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, x: s + x)
    n = queries.count()
    block = F.pmod(F.xxhash64("query_id"), F.lit(max(1, -(-2 * n // SMALL))))
    parts = [queries] if n <= SMALL else [checked(queries.where(block == i)) for i in range(-(-2 * n // SMALL))]
    scored = [vectors.crossJoin(F.broadcast(p) if n <= SMALL else p).select("query_id", key, dot.alias("dense_score")) for p in parts]
    return reduce(DataFrame.unionByName, scored)


def rrf(lists: list[DataFrame], key: str, k: int = RRF_K) -> DataFrame:
    """``lists`` of (query_id, key, rank from 0) -> query_id, key, fused_score."""
    both = lists[0].select("query_id", key, "rank")
    for more in lists[1:]:
        both = both.unionByName(more.select("query_id", key, "rank"))
    return both.groupBy("query_id", key).agg(F.sum(1.0 / (k + F.col("rank") + 1)).alias("fused_score"))


def rerank(fused: DataFrame, scores: DataFrame, bm25_rank: DataFrame, key: str, pool: int = POOL) -> DataFrame:
    """Order: the ``pool`` best fused rows by ``scores(query_id, key, rerank_score)``, then all others by BM25 rank."""
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("fused_score"), key))
    pooled = fused.withColumn("pool_pos", place).where(F.col("pool_pos") <= pool).join(scores, ["query_id", key])
    rest = bm25_rank.join(pooled.select("query_id", key), ["query_id", key], "left_anti")
    both = pooled.select("query_id", key, F.lit(0).alias("_part"), (-F.col("rerank_score")).alias("_by")).unionByName(rest.select("query_id", key, F.lit(1).alias("_part"), F.col("rank").cast("double").alias("_by")))
    return both.withColumn("pos", F.row_number().over(Window.partitionBy("query_id").orderBy("_part", "_by", key))).drop("_part", "_by")


def promote_parents(seeds: DataFrame, parent_of: DataFrame) -> DataFrame:
    """Sub-section seeds become their section (``parent_of(chunk_id, parent_chunk)``); of collisions the best score stays."""
    moved = seeds.join(parent_of, "chunk_id", "left").withColumn("chunk_id", F.coalesce("parent_chunk", "chunk_id"))
    return moved.groupBy("query_id", "chunk_id").agg(F.max("bm25_score").alias("bm25_score"))


def expand_graph(seeds: DataFrame, adj: DataFrame, hops: int = HOPS, cap: int = MAX_ADDED) -> DataFrame:
    """``seeds(query_id, chunk_id, pos)`` -> query_id, chunk_id, hop, weight, via_type, via_chunk, ins_seq. Candidates by
    (edge priority, frontier rank, -authority, edge_seq); one slot a target; at most ``cap`` added over all hops;
    MENTIONS only at the first hop."""
    picked = seeds.select("query_id", "chunk_id", F.lit(0).alias("hop"), F.lit(1.0).alias("weight"), F.lit(None).cast("string").alias("via_type"), F.lit(None).cast("string").alias("via_chunk"), F.col("pos").cast("int").alias("ins_seq"))
    frontier = picked
    for hop in range(1, hops + 1):
        usable = adj if hop == 1 else adj.where("type <> 'MENTIONS'")
        reach = frontier.select("query_id", "chunk_id", "weight", "ins_seq").join(usable, "chunk_id").where("target <> chunk_id")
        reach = reach.join(picked.select("query_id", F.col("chunk_id").alias("target")), ["query_id", "target"], "left_anti")
        order = ["prio", "ins_seq", F.desc("authority"), "edge_seq", "type"]
        once = reach.withColumn("n", F.row_number().over(Window.partitionBy("query_id", "target").orderBy(*order))).where("n = 1")
        added = picked.where("hop > 0").groupBy("query_id").agg(F.count("*").alias("used"))
        ranked = once.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy(*order, "target"))).join(added, "query_id", "left")
        new = ranked.where(F.col("n") <= cap - F.coalesce("used", F.lit(0)))
        new = new.select("query_id", F.col("target").alias("chunk_id"), F.lit(hop).alias("hop"), (F.col("weight") * DECAY).alias("weight"), F.col("type").alias("via_type"), F.col("chunk_id").alias("via_chunk"), F.col("n").cast("int").alias("ins_seq"))
        picked = picked.unionByName(new)
        frontier = new
    return picked


def context_block(label: str = "label", header: str = "header", verbatim: str = "verbatim") -> Column:
    """A chunk as it stands in a context: its label between marks, its header, a line, its text. Nulls count as empty."""
    name, head, body = (F.coalesce(F.col(c), F.lit("")) for c in (label, header, verbatim))
    return F.concat(F.lit("=== "), name, F.lit(" ===\n"), head, F.lit("\n---\n"), body, F.lit("\n"))


def context(results: DataFrame, block: str, cap: int = CONTEXT) -> DataFrame:
    """``results(query_id, pos, <block>)`` -> query_id, context, blocks: blocks joined up to the first with which their
    running length would pass ``cap``. A question whose first block is over it has an empty context of no blocks."""
    running = F.sum(F.length(block)).over(Window.partitionBy("query_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    fits = results.withColumn("fits", running <= cap)
    ordered = F.array_sort(F.collect_list(F.when(F.col("fits"), F.struct("pos", F.col(block).alias("b")))))
    return fits.groupBy("query_id").agg(F.array_join(F.transform(ordered, lambda x: x["b"]), "\n").alias("context"), F.count_if("fits").alias("blocks"))


def abstain(queries: DataFrame, results: DataFrame, least: float = ABSTAIN) -> DataFrame:
    """query_id, top_score, abstains: no hop-0 BM25 score of ``least`` or more."""
    top = results.where("hop = 0").groupBy("query_id").agg(F.max("bm25_score").alias("top"))
    joined = queries.select("query_id").join(top, "query_id", "left").select("query_id", F.coalesce("top", F.lit(0.0)).alias("top_score"))
    return joined.withColumn("abstains", F.col("top_score") < least)


# What makes a long question compound, words and most parts of a split.
JOINING_WORDS = ["and", "also", "what do we owe", "to whom", "as well as", "both"]
ASKING_WORDS = ["what", "who", "how", "when", "do", "does", "can", "is", "are"]
COMPOUND_WORDS, PART_WORDS, MOST_PARTS = 9, 3, 4


def _words(question: Column) -> Column:
    return F.size(F.filter(F.split(question, r"\s+"), lambda w: w != ""))


def looks_compound(question: str = "question") -> Column:
    joined = rf"(?iU)\b(?:{'|'.join(JOINING_WORDS)})\b|,\s*(?:and\s+)?(?:{'|'.join(ASKING_WORDS)})\b|;"
    return (_words(F.col(question)) >= COMPOUND_WORDS) & F.col(question).rlike(joined)


def split_questions(proposed: DataFrame) -> DataFrame:
    """``proposed(query_id, question, reply)`` -> query_id, sub_seq, question: the question itself (0), then the lines of
    the provider's ``reply`` without bullets and numbers, of PART_WORDS words or more, other than the question, at most
    MOST_PARTS. A null or useless reply leaves the question alone."""
    lines = F.transform(F.split(F.coalesce("reply", F.lit("")), "\n"), lambda x: F.btrim(F.regexp_replace(x, r"^\s*(?:[-*•]|\d+[.)])\s*", "")))
    good = F.filter(lines, lambda x: (_words(x) >= PART_WORDS) & (F.lower(x) != F.lower(F.btrim("question"))))
    every = F.concat(F.array("question"), F.slice(good, 1, MOST_PARTS))
    return proposed.select("query_id", F.posexplode(every).alias("sub_seq", "question"))


def final_order(results: DataFrame, seq: str = "pos") -> DataFrame:
    """Adds ``place`` (from 1): by hop, then weight and score downwards, then the order in which results came in."""
    order = Window.partitionBy("query_id").orderBy("hop", F.desc("weight"), F.desc("score"), seq)
    return results.withColumn("place", F.row_number().over(order))


def merge_subresults(results: DataFrame, key: str) -> DataFrame:
    """``results(query_id, sub_seq, key, ...)``: the row of the first sub-question stays; ``via_sub`` where it is not the
    question itself."""
    rest = [c for c in results.columns if c not in ("query_id", key, "sub_seq")]
    first = results.groupBy("query_id", key).agg(F.min(F.struct("sub_seq", *rest)).alias("r"))
    return first.select("query_id", key, "r.*").withColumn("via_sub", F.when(F.col("sub_seq") > 0, F.col("sub_seq")))
