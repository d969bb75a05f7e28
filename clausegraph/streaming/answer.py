"""Questions as a stream: micro-batches are answered by the batch plan; the audit trail is written once a request."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from clausegraph.functions.text import token_rows
from clausegraph.operators import retrieve
from clausegraph.sources.io import SCHEMAS, valid_questions


class Corpus:
    """Index tables made once and reused by each micro-batch."""

    def __init__(self, docs: DataFrame, key: str, text: str):
        from clausegraph.operators import index

        self.key = key
        self.posted = index.postings(docs, key, text, stems=True).persist()
        self.sizes = index.doc_stats(self.posted, docs, key).persist()
        n, self.average = self.sizes.agg(F.count("*"), F.avg("dl")).first()
        self.idf = index.tok_stats(self.posted, n).persist()

    def answer(self, questions: DataFrame, least: float = retrieve.ABSTAIN) -> DataFrame:
        """request_id, question, outcome (answered, abstained, no_results), top_score, retrieved."""
        words = token_rows(questions.select(F.col("request_id").alias("query_id"), "question"), "query_id", "question", stems=True)
        scored = retrieve.bm25(words, self.posted, self.idf, self.sizes, self.key, self.average)
        top = retrieve.top_k(scored, 15, tie=self.key).join(questions.select(F.col("request_id").alias("query_id"), "k"), "query_id").where("pos <= k")
        listed = F.array_sort(F.collect_list(F.struct("pos", F.struct(F.col(self.key).cast("string").alias("id"), F.lit(0).alias("hop"), F.col("bm25_score").alias("score")).alias("r"))))
        found = top.groupBy(F.col("query_id").alias("request_id")).agg(F.max("bm25_score").alias("top_score"), F.transform(listed, lambda x: x["r"]).alias("retrieved"))
        joined = questions.select("request_id", "question").join(found, "request_id", "left")
        outcome = F.when(F.col("top_score").isNull(), "no_results").when(F.col("top_score") < least, "abstained").otherwise("answered")
        return joined.withColumn("outcome", outcome)


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    return valid_questions(spark.readStream.schema(SCHEMAS["questions"]).json(path))


def start(questions: DataFrame, corpus: Corpus, audit_path: str, checkpoint: str) -> StreamingQuery:
    """One audit record a request, also when a micro-batch is repeated: each batch writes its own folder, overwritten on a
    repeat, and requests that repeat within two hours of event time are dropped by the watermark."""

    def write(batch: DataFrame, number: int) -> None:
        corpus.answer(batch).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{audit_path}/batch={number}")

    once = questions.withWatermark("ts", "2 hours").dropDuplicatesWithinWatermark(["request_id"])
    return once.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def events(answered: DataFrame) -> DataFrame:
    """request_id, seq, event, data: the ordered events that a client sees."""
    data = F.to_json(F.struct("outcome", "top_score", "retrieved"))
    first = answered.select("request_id", F.lit(0).alias("seq"), F.lit("retrieval").alias("event"), data.alias("data"))
    last = answered.select("request_id", F.lit(1).alias("seq"), F.when(F.col("outcome") == "answered", "done").otherwise("abstain").alias("event"), F.to_json(F.struct("outcome")).alias("data"))
    return first.unionByName(last)
