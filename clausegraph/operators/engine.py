"""Questions to ranked, ordered and bounded context in one call: the retrieval operators joined up, for any number of
questions at once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clausegraph.functions.text import token_rows
from clausegraph.operators import index, retrieve

VOCAB = "vocab_seq int, phrase string, expansions array<string>"
INTENTS = "name string, triggers array<string>, kind string, chapter string, whole boolean"
ADJACENCY = "chunk_id string, target string, type string, prio int, edge_seq long, authority double"
PARENTS = "chunk_id string, parent_chunk string"


@dataclass(frozen=True)
class EngineConfig:
    """What a caller may choose; the defaults are those of the operators."""

    k: int = 6
    stems: bool = True
    promote: bool = False
    hops: int = retrieve.HOPS
    most_added: int = retrieve.MAX_ADDED
    least_score: float = retrieve.ABSTAIN
    context_chars: int = retrieve.CONTEXT


class Library:
    """What questions are asked of: ``chunks(chunk_id, chunk_seq, kind, chapter, label, header, verbatim, document)`` with their
    index, which is made once, and the tables VOCAB, INTENTS, ADJACENCY and PARENTS, empty where not given."""

    def __init__(self, chunks: DataFrame, vocab: DataFrame | None = None, intents: DataFrame | None = None, adjacency: DataFrame | None = None, parents: DataFrame | None = None, stems: bool = True):
        empty = chunks.sparkSession.createDataFrame
        self.chunks, self.stems = chunks, stems
        self.vocab = empty([], VOCAB) if vocab is None else vocab
        self.intents = empty([], INTENTS) if intents is None else intents
        self.adjacency = empty([], ADJACENCY) if adjacency is None else adjacency
        self.parents = empty([], PARENTS) if parents is None else parents
        self.posted = index.postings(chunks, "chunk_id", "document", stems).persist()
        self.sizes = index.doc_stats(self.posted, chunks, "chunk_id").persist()
        n, average = self.sizes.agg(F.count("*"), F.avg("dl")).first()
        self.average = average or 1.0
        self.idf = index.tok_stats(self.posted, n).persist()

    def close(self) -> None:
        for df in (self.posted, self.sizes, self.idf):
            df.unpersist()


def seeds(questions: DataFrame, library: Library, config: EngineConfig) -> DataFrame:
    """query_id, chunk_id, bm25_score, pos: the k best chunks after rewriting and boosts, promoted to their sections if
    asked for, then (with score 0) all chunks of the kinds that an intent wants whole."""
    asked = retrieve.expand(questions, library.vocab)
    words = token_rows(asked, "query_id", "expanded", stems=library.stems)
    scored = retrieve.bm25(words, library.posted, library.idf, library.sizes, "chunk_id", library.average)
    traits = library.chunks.select("chunk_id", "chunk_seq", "kind", "chapter")
    fired = retrieve.detect_intents(questions, library.intents).join(library.intents.drop("triggers"), "name")
    scored = scored.join(traits, "chunk_id")
    pairs = scored.select("query_id", "chunk_id", "kind", "chapter").alias("s").join(fired.alias("f"), "query_id")
    fits = pairs.where("s.kind = f.kind OR s.chapter = f.chapter").select("query_id", "chunk_id")
    best = retrieve.top_k(retrieve.boost(scored, fits, ["query_id", "chunk_id"]), config.k).select("query_id", "chunk_id", "bm25_score")
    if config.promote:
        best = retrieve.promote_parents(best, library.parents)
    wanted = fired.where("whole").join(traits, "kind").select("query_id", "chunk_id").distinct()
    full = retrieve.complete(best, wanted, "chunk_id").join(traits.select("chunk_id", "chunk_seq"), "chunk_id")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("bm25_score"), "chunk_seq"))
    return full.select("query_id", "chunk_id", "bm25_score", place.alias("pos"))


def search(questions: DataFrame, library: Library, config: EngineConfig = EngineConfig()) -> DataFrame:
    """``questions(query_id, question)`` -> query_id, place, chunk_id, hop, weight, bm25_score (0 for chunks that the graph
    added), via_type, via_chunk. Questions that match nothing have no row."""
    if config.stems != library.stems:
        raise ValueError("the library was indexed with another choice of stems")
    first = seeds(questions, library, config).persist()
    reached = retrieve.expand_graph(first, library.adjacency, config.hops, config.most_added)
    joined = reached.join(first.select("query_id", "chunk_id", "bm25_score"), ["query_id", "chunk_id"], "left")
    ranked = retrieve.final_order(joined.withColumn("score", F.coalesce("bm25_score", F.lit(0.0))), "ins_seq")
    return ranked.select("query_id", "place", "chunk_id", "hop", "weight", F.col("score").alias("bm25_score"), "via_type", "via_chunk")


def answer(questions: DataFrame, library: Library, config: EngineConfig = EngineConfig()) -> DataFrame:
    """query_id, question, outcome (answered, abstained, no_results), top_score, retrieved (chunk ids in order), context.
    One row a question; the context is empty where the first block is over the limit or nothing was found."""
    results = search(questions, library, config).persist()
    top = retrieve.abstain(questions, results, config.least_score)
    shown = results.join(library.chunks.select("chunk_id", retrieve.context_block().alias("block")), "chunk_id")
    context = retrieve.context(shown.withColumnRenamed("place", "pos"), "block", config.context_chars).drop("blocks")
    listed = results.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "chunk_id"))), lambda r: r["chunk_id"]).alias("retrieved"))
    joined = questions.select("query_id", "question").join(top, "query_id").join(listed, "query_id", "left").join(context, "query_id", "left")
    outcome = F.when(F.col("retrieved").isNull(), "no_results").when(F.col("abstains"), "abstained").otherwise("answered")
    none = F.array().cast("array<string>")
    return joined.select("query_id", "question", outcome.alias("outcome"), "top_score", F.coalesce("retrieved", none).alias("retrieved"), F.coalesce("context", F.lit("")).alias("context"))
