"""Readers with fixed schemas, writers, the publish gate, and text exports."""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The shapes of the engine's tables.
SCHEMAS = {
    "words": "doc_id string, page int, x0 double, x1 double, top double, text string",
    "lines": "doc_id string, line_seq int, page int, top double, x0 double, indent int, text string",
    "margin_notes": "doc_id string, seq int, page int, top double, text string",
    "nodes": "node_id string, kind string, label string, prefix string, text string, page int, top double, indent int, parent_id string, headnote string, chapter string, follows string, ord int",
    "schedule": "sl_no int, breach string, penalty string",
    "definitions": "id string, term string, relation string, qualifier string, defined_in string, text string",
    "edges": "src string, dst string, type string, quote string, resolution string, edge_seq long",
    "chunks": "chunk_seq int, id string, node_id string, kind string, label string, headnote string, chapter string, page int, header string, verbatim string, plain_english string, questions array<string>",
    "questions": "request_id string, question string, k int, parent_doc boolean, hybrid boolean, decompose boolean, ts timestamp",
    "audit": "request_id string, ts double, question string, build_id string, outcome string, reason string, error string, top_score double, model string, provider string, elapsed_ms int, context_chars int, retrieved array<struct<id:string,hop:int,score:double>>, answer string, citations array<struct<id:string,status:string>>",
}
TRAVERSABLE = ("REFERENCES", "PENALISED_BY", "MENTIONS", "DEFINES", "HAS_ENTRY")


def read_json(spark: SparkSession, path: str, name: str, multi_line: bool = False) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).json(path, multiLine=multi_line)


def read_parquet(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(path)


def read_yaml(spark: SparkSession, path: str) -> dict:
    """A small YAML file (vocabulary, overrides, cases), read through Spark so that any store works."""
    import yaml

    return yaml.safe_load(spark.sparkContext.wholeTextFiles(path).values().first())


def vocabulary(spark: SparkSession, spec: dict) -> tuple[DataFrame, DataFrame]:
    """(vocab, intents) tables of a vocabulary file's ``terms`` and ``intents``."""
    terms = [(i, k, list(v)) for i, (k, v) in enumerate(spec.get("terms", {}).items())]
    intents = [(k, v.get("triggers", []), v.get("boost_kinds", []), v.get("boost_chapter")) for k, v in spec.get("intents", {}).items()]
    return spark.createDataFrame(terms, "vocab_seq int, phrase string, expansions array<string>"), spark.createDataFrame(intents, "name string, triggers array<string>, boost_kinds array<string>, boost_chapter string")


def load_graph(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes with nulls filled, traversable edges, parent_of); a type can be in both edge tables."""
    filled = nodes.fillna("").fillna(0)
    parents = edges.where(F.col("type").startswith("HAS_")).select(F.col("dst").alias("node_id"), F.col("src").alias("parent_id"))
    return filled, edges.where(F.col("type").isin(*TRAVERSABLE)), parents


def provision(nodes: DataFrame, node_id: str) -> DataFrame:
    return nodes.where(F.col("node_id") == node_id)


def valid_questions(questions: DataFrame) -> DataFrame:
    """Control characters out, blank or out-of-bounds questions (2 to 800 characters) dropped, k within 1 to 15."""
    clean = F.btrim(F.regexp_replace("question", r"[\x00-\x08\x0b-\x1f\x7f]", ""))
    return questions.withColumn("question", clean).where(F.length("question").between(2, 800)).withColumn("k", F.coalesce("k", F.lit(6))).where(F.col("k").between(1, 15))


def publish(tables: dict[str, DataFrame], path: str, problems: Iterable[str] = ()) -> str | None:
    """Writes all tables to a new version folder under ``path`` and returns it; with problems nothing is written."""
    if list(problems):
        return None
    version = f"{path}/v-{uuid.uuid4().hex[:12]}"
    for name, df in tables.items():
        writer = df.write.mode("overwrite")
        part = {"nodes": "kind", "edges": "type"}.get(name)
        (writer.partitionBy(part) if part else writer).parquet(f"{version}/{name}")
    return version


def cypher(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Statements that rebuild the graph, one a row (``value``), for ``write.text``."""
    quoted = lambda c: F.concat(F.lit("'"), F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'")), F.lit("'"))
    made = nodes.where(F.col("kind").rlike("^[A-Za-z][A-Za-z0-9_]*$")).select(F.concat(F.lit("MERGE (n:"), "kind", F.lit(" {id: "), quoted(F.col("node_id")), F.lit("}) SET n.label = "), quoted(F.col("label")), F.lit(", n.text = "), quoted(F.col("text")), F.lit(";")).alias("value"))
    linked = edges.where(F.col("type").rlike("^[A-Za-z][A-Za-z0-9_]*$")).select(F.concat(F.lit("MATCH (a {id: "), quoted(F.col("src")), F.lit("}), (b {id: "), quoted(F.col("dst")), F.lit("}) MERGE (a)-[:"), "type", F.lit("]->(b);")).alias("value"))
    return made.unionByName(linked)


def gexf(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Rows (part, seq, value) of a GEXF document; written in order of part and seq."""
    xml = lambda c: F.replace(F.replace(F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))
    n = nodes.select(F.lit(1).alias("part"), F.col("node_id").alias("seq"), F.concat(F.lit('<node id="'), xml(F.col("node_id")), F.lit('" label="'), xml(F.col("label")), F.lit('"/>')).alias("value"))
    e = edges.select(F.lit(3).alias("part"), F.concat_ws("|", "src", "dst", "type").alias("seq"), F.concat(F.lit('<edge source="'), xml(F.col("src")), F.lit('" target="'), xml(F.col("dst")), F.lit('" label="'), xml(F.col("type")), F.lit('"/>')).alias("value"))
    frame = nodes.sparkSession.createDataFrame([(0, "", '<gexf version="1.2"><graph defaultedgetype="directed"><nodes>'), (2, "", "</nodes><edges>"), (4, "", "</edges></graph></gexf>")], "part int, seq string, value string")
    return frame.unionByName(n).unionByName(e)


def review_report(nodes: DataFrame, unresolved: DataFrame) -> DataFrame:
    """Markdown lines of the human review: headnotes by section and references without target."""
    heads = nodes.where("kind = 'Section'").select(F.lit(0).alias("part"), F.col("ord").cast("long").alias("seq"), F.concat(F.lit("- "), "node_id", F.lit(": "), F.coalesce("headnote", F.lit("none"))).alias("value"))
    loose = unresolved.select(F.lit(1).alias("part"), F.xxhash64("src", "dst").alias("seq"), F.concat(F.lit("- unresolved: "), "src", F.lit(" -> "), "dst").alias("value"))
    return heads.unionByName(loose)
