"""Build checks and the publish gate: counts, completeness, orphans, the lossless round trip."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def kind_counts(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("kind").agg(F.count("*").alias("n"))


def missing_numbers(nodes: DataFrame, last: int, kind: str = "Section") -> DataFrame:
    """Numbers 1..last without a node of the kind."""
    have = nodes.where(F.col("kind") == kind).select(F.regexp_extract("node_id", r"-(\d+)", 1).cast("long").alias("id"))
    return nodes.sparkSession.range(1, last + 1).join(have.distinct(), "id", "left_anti")


def orphans(nodes: DataFrame) -> DataFrame:
    parents = nodes.select(F.col("node_id").alias("parent_id"))
    return nodes.where("parent_id IS NOT NULL").join(parents, "parent_id", "left_anti")


def missing_headnotes(nodes: DataFrame) -> DataFrame:
    return nodes.where("kind = 'Section' AND coalesce(headnote, '') = ''")


def normalised(text: Column) -> Column:
    """White space and the blanks around short markers do not count in the round trip."""
    return F.btrim(F.regexp_replace(F.regexp_replace(text, r"(?U)\s*\((\w{1,4})\)\s*", "($1)"), r"\s+", " "))


def round_trip(nodes: DataFrame, lines: DataFrame) -> DataFrame:
    """doc_id, same, at (first difference, null if none), source, built: texts of the tree in order against the lines."""
    def joined(df: DataFrame, order: str, text: Column, name: str) -> DataFrame:
        parts = F.array_sort(F.collect_list(F.struct(order, text.alias("t"))))
        return df.groupBy("doc_id").agg(normalised(F.array_join(F.transform(parts, lambda p: p["t"]), " ")).alias(name))

    both = joined(lines, "line_seq", F.col("text"), "source").join(joined(nodes.where("kind <> 'Act'"), "ord", F.concat_ws(" ", "prefix", "text"), "built"), "doc_id", "full_outer")
    at = F.array_min(F.filter(F.sequence(F.lit(1), F.greatest(F.length("source"), F.length("built"))), lambda i: ~F.substring("source", i, F.lit(1)).eqNullSafe(F.substring("built", i, F.lit(1)))))
    return both.withColumn("same", F.col("source").eqNullSafe(F.col("built"))).withColumn("at", F.when(~F.col("same"), at))


def divergence(source: str, built: str, around: int = 80) -> str:
    """The first difference with its surroundings, or the longer tail."""
    at = next((i for i, (a, b) in enumerate(zip(source, built, strict=False)) if a != b), min(len(source), len(built)))
    if at == len(source) == len(built):
        return ""
    return f"{source[max(0, at - around) : at + around]!r} / {built[max(0, at - around) : at + around]!r}"


def problems(nodes: DataFrame, lines: DataFrame, expected: dict[str, int], sections: int) -> list[str]:
    """All failures; an empty list opens the publish gate."""
    found = {r.kind: r.n for r in kind_counts(nodes).collect()}
    out = [f"{kind}: {found.get(kind, 0)} instead of {n}" for kind, n in expected.items() if found.get(kind, 0) != n]
    out += [f"section {r.id} is missing" for r in missing_numbers(nodes, sections).orderBy("id").limit(20).collect()]
    out += [f"{r.node_id} has no parent" for r in orphans(nodes).limit(20).collect()]
    out += [f"{r.node_id} has no headnote" for r in missing_headnotes(nodes).limit(20).collect()]
    out += [f"{r.doc_id} differs from its lines: {divergence(r.source or '', r.built or '')}" for r in round_trip(nodes, lines).where("NOT same").limit(5).collect()]
    return out
