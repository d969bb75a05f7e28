"""Typed multigraph: last-wins edges, ancestor closure, roll-up, authority weights, weighted PageRank, adjacency."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

WEIGHTS = {"REFERENCES": 1.0, "PENALISED_BY": 0.5}
PRIORITY = {"PENALISED_BY": 0, "PENALISES": 1, "REFERENCES": 2, "DEFINES": 3, "CITED_BY": 4, "MENTIONS": 5}
REVERSED = {"PENALISED_BY": "PENALISES", "REFERENCES": "CITED_BY"}


def upsert_edges(edges: DataFrame, keys: tuple[str, ...] = ("src", "dst", "type"), seq: str = "edge_seq") -> DataFrame:
    """At most one edge a key; the attributes of the last one stay. Partial aggregation, no window over hot keys."""
    rest = [c for c in edges.columns if c not in keys and c != seq]
    last = edges.groupBy(*keys).agg(F.max(F.struct(seq, *rest)).alias("last"))
    return last.select(*keys, "last.*")


def _kept(df: DataFrame) -> DataFrame:
    """``df`` computed once: checkpointed where a folder is set (which also cuts lineage), else persisted."""
    return df.checkpoint() if df.sparkSession.sparkContext._jsc.sc().getCheckpointDir().isDefined() else df.persist()


def closure(nodes: DataFrame, node: str = "node_id", parent: str = "parent_id") -> DataFrame:
    """node_id, anc_id, depth for each node and each ancestor or itself. Distances double from round to round, until
    nothing is left to follow, so any depth is reached. Parents that form a circle raise ValueError."""
    own, above = F.col(node).alias("node_id"), F.col(parent).alias("anc_id")
    reach = nodes.select(own, above, F.lit(1).alias("depth")).where("anc_id IS NOT NULL")
    found = nodes.select(own, F.col(node).alias("anc_id"), F.lit(0).alias("depth"))
    step = lambda left, right: left.alias("l").join(right.alias("r"), F.col("l.anc_id") == F.col("r.node_id")).select("l.node_id", "r.anc_id", (F.col("l.depth") + F.col("r.depth")).alias("depth"))
    while True:
        found = _kept(found.unionByName(step(found, reach)))
        if not found.where("node_id = anc_id AND depth > 0").isEmpty():
            raise ValueError("parents form a circle")
        reach = _kept(step(reach, reach))
        if reach.isEmpty():
            return found


def roll_up(ancestors: DataFrame, targets: DataFrame) -> DataFrame:
    """node_id, chunk_id: nearest ancestor or self among ``targets(anc_id)``; nodes without one are left out."""
    near = ancestors.join(targets, "anc_id")
    return near.groupBy("node_id").agg(F.min_by("anc_id", F.struct("depth", "anc_id")).alias("chunk_id"))


def collapse(edges: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """src, dst, weight: weighted types summed per pair."""
    weights = WEIGHTS if weights is None else weights
    weight = F.lit(None).cast("double")
    for kind, value in weights.items():
        weight = F.when(F.col("type") == kind, value).otherwise(weight)
    return edges.withColumn("weight", weight).where("weight IS NOT NULL").groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def pagerank(nodes: DataFrame, weighted: DataFrame, alpha: float = 0.85, rounds: int = 100, tolerance: float | None = 1e-6) -> DataFrame:
    """node_id, authority (6 digits). Dangling mass spreads evenly. ``tolerance`` None: exactly ``rounds`` rounds; else
    until the change is under nodes * tolerance. All zero without edges. Every third round is checkpointed, where a
    checkpoint folder is set, so lineage stays short and lost executors cost little."""
    spark = nodes.sparkSession
    n = nodes.count()
    if weighted.isEmpty():
        return nodes.select("node_id", F.lit(0.0).alias("authority"))
    out = weighted.groupBy("src").agg(F.sum("weight").alias("total"))
    shares = weighted.join(out, "src").select("src", "dst", (F.col("weight") / F.col("total")).alias("share")).persist()
    base = nodes.select("node_id").join(out.select(F.col("src").alias("node_id"), F.lit(1).alias("has")), "node_id", "left").persist()
    rank = base.select("node_id", "has", F.lit(1.0 / n).alias("rank"))
    durable = spark.sparkContext._jsc.sc().getCheckpointDir().isDefined()
    for i in range(rounds):
        dangling = rank.agg(F.sum(F.when(F.col("has").isNull(), F.col("rank")).otherwise(0.0)).alias("loose"))
        sent = shares.join(rank.select(F.col("node_id").alias("src"), "rank"), "src").groupBy(F.col("dst").alias("node_id")).agg(F.sum(F.col("rank") * F.col("share")).alias("got"))
        fresh = base.join(sent, "node_id", "left").crossJoin(F.broadcast(dangling))
        fresh = fresh.select("node_id", "has", (alpha * (F.coalesce("got", F.lit(0.0)) + F.col("loose") / n) + (1 - alpha) / n).alias("rank"))
        if durable and i % 3 == 2:
            fresh = fresh.checkpoint()
        if tolerance is not None:
            fresh = fresh.persist()
            change = fresh.alias("f").join(rank.alias("r"), "node_id").agg(F.sum(F.abs(F.col("f.rank") - F.col("r.rank")))).first()[0]
            rank = fresh
            if change < n * tolerance:
                break
        else:
            rank = fresh.persist()  # read twice in the next round
    return rank.select("node_id", F.round("rank", 6).alias("authority"))


def adjacency(edges: DataFrame, node_chunk: DataFrame, authority: DataFrame) -> DataFrame:
    """chunk_id, target, type, prio, edge_seq, authority, src_label_id: rolled-up edges, and the inverses of REVERSED."""
    kinds = edges.where(F.col("type").isin(*PRIORITY))
    back = kinds.where(F.col("type").isin(*REVERSED)).select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.element_at(F.create_map(*[F.lit(x) for kv in REVERSED.items() for x in kv]), F.col("type")).alias("type"), "edge_seq")
    both = kinds.select("src", "dst", "type", "edge_seq").unionByName(back)
    to = node_chunk.select(F.col("node_id").alias("dst"), F.col("chunk_id").alias("target"))
    own = node_chunk.select(F.col("node_id").alias("src"), "chunk_id")
    rank = F.element_at(F.create_map(*[F.lit(x) for kv in PRIORITY.items() for x in kv]), F.col("type"))
    scored = authority.select(F.col("node_id").alias("dst"), "authority")
    return both.join(own, "src").join(to, "dst").join(scored, "dst", "left").select("chunk_id", "target", "type", rank.alias("prio"), "edge_seq", F.coalesce("authority", F.lit(0.0)).alias("authority"))
