"""Links from text: references, definitions, headnotes, mentions, penalties, metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausegraph.functions.text import slug

# What separates the items of a list, forms of clause and sub-section numbers, names of other Acts.
_AND = r"\s*(?:,|and)\s*"
_CLAUSE, _SUB = r"\(\s*([a-z]{1,2})\s*\)", r"\(\s*\d+\s*\)"
_ACT = r"[A-Z][A-Za-z’'()\.\- ]{2,70}?(?:Act|Code),\s*\d{4}"
#: Clause, sub-sections, sections and (looked ahead at) the name of another Act or Code.
QUALIFIED = rf"(?:\bclauses?\s*{_CLAUSE}\s+of\s+)?(?:\bsub-sections?\s*({_SUB}(?:{_AND}{_SUB})*)\s+of\s+)?\bsections?\s+(\d+(?:{_AND}\d+)*)\b(?=(?:\s*(?:of\s+)?(?:the\s+)?({_ACT}))?)"
BARE = rf"\bsub-sections?\s*({_SUB}(?:{_AND}{_SUB})*)"
SCHEDULE = r"\bthe Schedule\b"


def _all(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def scan_references(rows: DataFrame, max_section: int) -> DataFrame:
    """``rows(node_id, owner, text)`` -> src, dst (null for other Acts), quote, resolution, act, seq. A match that names
    another Act or a section over ``max_section`` is external as a whole; bare sub-sections count only with an owner and
    only where the passage has no external match; the Schedule counts once."""
    text = F.col("text")
    zipped = F.arrays_zip(*[_all(text, QUALIFIED, g).alias(n) for g, n in enumerate(("quote", "clause", "subs", "secs", "act"))])
    scanned = rows.withColumn("found", zipped)
    external = lambda m: (m["act"] != "") | F.exists(_all(m["secs"], r"(\d+)", 1), lambda s: s.cast("bigint") > max_section)
    scanned = scanned.withColumn("any_external", F.exists("found", external))
    each = scanned.select("node_id", F.posexplode("found").alias("seq", "m")).withColumn("external", external(F.col("m")))
    outer = each.where("external").select(F.col("node_id").alias("src"), F.lit(None).cast("string").alias("dst"), F.col("m.quote").alias("quote"), F.lit("external").alias("resolution"), F.nullif(F.col("m.act"), F.lit("")).alias("act"), "seq")
    subs = _all(F.col("m.subs"), r"(\d+)", 1)
    own = each.where("NOT external").select("node_id", "seq", "m", F.explode(_all(F.col("m.secs"), r"(\d+)", 1)).alias("sec"), F.when(F.size(subs) > 0, subs).otherwise(F.array(F.lit(""))).alias("subs"))
    own = own.select("node_id", "seq", "m", "sec", F.explode("subs").alias("sub"))
    target = F.concat_ws("-", F.lit("s"), "sec", F.nullif(F.col("sub"), F.lit("")), F.nullif(F.col("m.clause"), F.lit("")))
    inner = own.select(F.col("node_id").alias("src"), target.alias("dst"), F.col("m.quote").alias("quote"), F.lit("qualified").alias("resolution"), F.lit(None).cast("string").alias("act"), "seq")
    masked = F.regexp_replace(text, QUALIFIED, " ")
    bare = scanned.where("owner IS NOT NULL AND NOT any_external").select("node_id", "owner", F.posexplode(F.arrays_zip(_all(masked, BARE, 0).alias("quote"), _all(masked, BARE, 1).alias("subs"))).alias("seq", "m"))
    bare = bare.select("node_id", "owner", "seq", "m", F.explode(_all(F.col("m.subs"), r"(\d+)", 1)).alias("sub"))
    bare = bare.select(F.col("node_id").alias("src"), F.concat_ws("-", "owner", "sub").alias("dst"), F.col("m.quote").alias("quote"), F.lit("relative").alias("resolution"), F.lit(None).cast("string").alias("act"), (F.col("seq") + 1000).alias("seq"))
    plan = rows.where(text.rlike(SCHEDULE)).select(F.col("node_id").alias("src"), F.lit("schedule").alias("dst"), F.lit("the Schedule").alias("quote"), F.lit("schedule").alias("resolution"), F.lit(None).cast("string").alias("act"), F.lit(100_000).alias("seq"))
    return inner.unionByName(outer).unionByName(bare).unionByName(plan)


def resolve(found: DataFrame, nodes: DataFrame, dropped: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(edges, unresolved, externals): overrides ``dropped(src, dst)`` and self-references go; a target must be a node
    or the schedule."""
    inner = found.where("dst IS NOT NULL AND src <> dst")
    if dropped is not None:
        inner = inner.join(dropped, ["src", "dst"], "left_anti")
    ids = nodes.select(F.col("node_id").alias("dst")).unionByName(nodes.sparkSession.createDataFrame([("schedule",)], "dst string")).distinct()
    return inner.join(ids, "dst", "left_semi").select(found.columns), inner.join(ids, "dst", "left_anti").select(found.columns), found.where("dst IS NULL")


def definitions(nodes: DataFrame, home: str = "s-2") -> DataFrame:
    """Children of the definition section: quoted term, relation and qualifier."""
    text = F.col("text")
    term = F.regexp_extract(text, r"^\s*[\"“]([^\"”]+)[\"”]", 1)
    qualifier = F.btrim(F.regexp_extract(text, r"^\s*[\"“][^\"”]+[\"”](.*?)\b(?:means|includes)\b", 1), F.lit(" ,"))
    relation = F.regexp_extract(text, r"\b(means|includes)\b", 1)
    found = nodes.where(F.col("parent_id") == home).select(term.alias("term"), relation.alias("relation"), qualifier.alias("qualifier"), F.col("node_id").alias("defined_in"), "text").where("term <> ''")
    return found.select(F.concat(F.lit("def-"), slug(F.col("term"))).alias("id"), "term", "relation", "qualifier", "defined_in", "text")


def attach_headnotes(sections: DataFrame, blocks: DataFrame, overrides: DataFrame) -> DataFrame:
    """node_id, headnote: each margin block goes to the section of its page that is nearest by ``top`` (ties: earlier
    section); of several blocks the last stays; overrides win. Pages are those of one document each where both sides
    have ``doc_id``."""
    page = [c for c in ("doc_id", "page") if c in blocks.columns and c in sections.columns]
    pairs = blocks.select(*page, "seq", "text", "top").join(sections.select(*page, "node_id", "ord", F.col("top").alias("at")), page)
    pairs = pairs.select(*page, "seq", "text", "node_id", "ord", F.abs(F.col("top") - F.col("at")).alias("gap"))
    near = pairs.groupBy(*page, "seq", "text").agg(F.min_by("node_id", F.struct("gap", "ord")).alias("node_id"))
    auto = near.groupBy("node_id").agg(F.max_by("text", "seq").alias("auto"))
    fixed = overrides.select("node_id", F.col("text").alias("fixed"))
    joined = sections.select("node_id").join(auto, "node_id", "left").join(fixed, "node_id", "left")
    return joined.select("node_id", F.coalesce("fixed", "auto").alias("headnote"))


def mentions(nodes: DataFrame, terms: DataFrame) -> DataFrame:
    """src, dst for whole-word, case-sensitive uses of ``terms(id, term, defined_in)``. Nodes and terms meet by the term's
    first word, so no node is compared with every term; texts join only the pairs so found, and whole terms are verified."""
    words = nodes.select("node_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"(?U)(\w+)"), 1))).alias("w"))
    heads = terms.select("id", "term", "defined_in").withColumn("w", F.regexp_extract("term", r"(?U)(\w+)", 1))
    met = words.join(heads, "w").where(F.col("node_id").cast("string") != F.col("defined_in")).drop("w")
    hit = F.expr(r"text rlike concat('(?U)\\b\\Q', term, '\\E\\b')")
    return nodes.select("node_id", "text").join(met, "node_id").where(hit).select(F.col("node_id").alias("src"), F.col("id").alias("dst")).distinct()


def penalty_edges(schedule: DataFrame, nodes: DataFrame, max_section: int) -> DataFrame:
    """src (the duty), dst (pen-n) for sections that a breach names and that exist."""
    rows = schedule.select(F.concat(F.lit("pen-"), "sl_no").alias("node_id"), F.lit(None).cast("string").alias("owner"), F.col("breach").alias("text"))
    found = scan_references(rows, max_section).where("dst IS NOT NULL AND dst <> 'schedule'")
    return found.join(nodes.select(F.col("node_id").alias("dst")), "dst", "left_semi").select(F.col("dst").alias("src"), F.col("src").alias("dst"), "quote").distinct()


def structural_edges(nodes: DataFrame) -> DataFrame:
    return nodes.where("parent_id IS NOT NULL").select(F.col("parent_id").alias("src"), F.col("node_id").alias("dst"), F.concat(F.lit("HAS_"), F.upper("kind")).alias("type"))


def definition_edges(defs: DataFrame) -> DataFrame:
    """DEFINES edges from the provision that defines a term to the definition."""
    return defs.select(F.col("defined_in").alias("src"), F.col("id").alias("dst"), F.lit("DEFINES").alias("type"))


def external_acts(citations: DataFrame) -> DataFrame:
    """``citations(citation)`` like ``45 of 1860.`` -> one node an Act."""
    number, year = F.regexp_extract("citation", r"(\d+) of (\d{4})", 1), F.regexp_extract("citation", r"(\d+) of (\d{4})", 2)
    return citations.select(F.concat_ws("-", F.lit("ext"), year, number).alias("node_id"), "citation").where(year != "").groupBy("node_id").agg(F.max("citation").alias("label"))


def inherited_act(ancestors: DataFrame, nodes: DataFrame, home_act: str, default: str = "unnamed") -> DataFrame:
    """node_id, act: the first Act named (outside quotes) on the way from the node to the root, other than the home Act."""
    plain = F.regexp_replace("text", r"[\"“][^\"”]*[\"”]", " ")
    names = nodes.select(F.col("node_id").alias("anc_id"), F.filter(F.regexp_extract_all(plain, F.lit(r"((?:[A-Z][a-z]+\s+(?:and\s+|of\s+)?)+(?:Act|Code)(?:,\s*\d{4})?)"), 1), lambda n: ~F.contains(n, F.lit(home_act)))[0].alias("act")).where("act IS NOT NULL")
    near = ancestors.join(names, "anc_id").groupBy("node_id").agg(F.min_by("act", "depth").alias("act"))
    return nodes.select("node_id").join(near, "node_id", "left").select("node_id", F.coalesce("act", F.lit(default)).alias("act"))


def act_metadata(text: Column) -> tuple[Column, Column]:
    """(number, assent date) of an Act's front page."""
    return F.regexp_extract(text, r"(?i)\bNO\.?\s+(\d+)\s+OF\s+\d{4}", 1), F.regexp_extract(text, r"\[(\d{1,2}(?:st|nd|rd|th)?\s+\w+,?\s+\d{4})", 1)

