"""Mixing sources to target weights by Pareto order sampling, with DataFrame functions only.

Sizes are word counts. Sources (by code point, null last) weigh 1, 2, 3, repeating, and share the corpus size; a target
stops at REPEAT times its source's size and the excess is reshared by weight until none is above.

Within a source the expected copies of a document grow with the bit length of its size (longer documents carry more
running text), at most REPEAT, scaled so that expected words equal the target. The whole part of that number is taken
for certain. The fraction p is an inclusion probability: documents are ranked by their random odds u/(1-u) divided by
the inclusion odds p/(1-p), and the sample is the head of that ranking whose words fill what the certain copies leave
open. The first document that would overshoot is passed over; one last document then closes the gap if one of fitting
size exists, so a source lands within a fraction of a document of its target.

Scale: a source may hold any share of the rows. The ranking is never sorted as a whole: words are summed per source
and rank bin (map-side partial sums), the bin where the sample ends is found in two steps of at most SIDE bins, and
only that bin's documents, 1/SIDE^2 of a source, are ordered. Source and class tables are broadcast only below a
counted size.

Defined results: null or wordless texts have size 0 and are never taken. A null source is a source. u comes from md5
of the doc_id (null as the empty text), so reruns agree; rows of equal doc_id and size in a source stand or fall
together. Extra columns are ignored by ``plan_mix`` and kept by ``mix``. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clausegraph.llm.runtime import apart, cut, small, table

REPEAT = 3
WEIGHTS = 3
SIDE = 128
WORDS = r"[^\x20\x09-\x0D]+"


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, class (bit length of the size) and the random number u of each document."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORDS)), F.lit(0)).cast("long")
    digest = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(2**52)
    return docs.select("doc_id", "source", size.alias("size"), u.alias("u")).withColumn("class", F.when(F.col("size") > 0, F.length(F.bin("size"))).otherwise(0))


def _filled(df: DataFrame, total: str, cap: str, weight: str, by: list[str], order: list) -> DataFrame:
    """Adds ``level``: shares are least(cap, weight * level) and add up to ``total``; null where all caps are reached."""
    before = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy(*by).orderBy(*order).rowsBetween(0, Window.unboundedFollowing)
    level = (F.col(total) - F.coalesce(F.sum(cap).over(before), F.lit(0.0))) / F.sum(weight).over(after)
    stepped = df.withColumn("step_level", level)
    free = F.when(F.col(cap) > F.col("step_level") * F.col(weight), F.col("step_level"))
    return stepped.withColumn("level", F.max(free).over(Window.partitionBy(*by))).drop("step_level")


def targets(by_class: DataFrame) -> DataFrame:
    """One row per source of ``by_class(source, class, words)``: source_size, target."""
    sources = by_class.groupBy("source").agg(F.sum("words").alias("source_size"))
    ranked = sources.withColumn("place", F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))))
    ranked = ranked.withColumn("weight", ((F.col("place") - 1) % WEIGHTS + 1).cast("double")).withColumn("cap", F.col("source_size") * float(REPEAT))
    ranked = ranked.withColumn("total", F.sum("source_size").over(Window.partitionBy()).cast("double"))
    filled = _filled(ranked, "total", "cap", "weight", [], [F.col("cap") / F.col("weight"), "place"])
    target = F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("weight") * F.col("level")))
    return filled.select("source", "source_size", target.alias("target"))


def _expected(by_class: DataFrame, sources: DataFrame) -> DataFrame:
    """Certain copies and inclusion probability for each source and size class."""
    joined = by_class.join(sources, by_class["source"].eqNullSafe(sources["source"])).drop(sources["source"])
    classed = joined.where("class > 0").withColumn("cap", F.col("words") * float(REPEAT)).withColumn("weight", F.col("words") * F.col("class").cast("double"))
    filled = _filled(classed, "target", "cap", "weight", ["source"], [F.desc("class")])
    mean = F.when(F.col("level").isNull(), F.lit(float(REPEAT))).otherwise(F.least(F.lit(float(REPEAT)), F.col("class") * F.col("level")))
    out = filled.withColumn("mean", mean).withColumn("certain", F.floor("mean").cast("long")).withColumn("p", F.col("mean") - F.col("certain"))
    return out.select("source", "class", "words", "target", "certain", "p")


def _ranked(docs: DataFrame, expected: DataFrame, rows: int) -> DataFrame:
    """Adds certain copies and, where a fraction is open, the Pareto rank as a number in (0, 1) and its bin."""
    e = small(expected.select(F.col("source").alias("e_source"), F.col("class").alias("e_class"), "certain", "p"), rows)
    odds = (F.col("u") / (1 - F.col("u"))) / (F.col("p") / (1 - F.col("p")))
    joined = docs.join(e, F.col("source").eqNullSafe(F.col("e_source")) & (F.col("class") == F.col("e_class")), "left").drop("e_source", "e_class")
    ranked = joined.withColumn("q", F.when(F.col("p") > 0, odds / (1 + odds)))
    return ranked.withColumn("bin", F.least(F.floor(F.col("q") * (SIDE * SIDE)), F.lit(SIDE * SIDE - 1))).withColumn("id", F.coalesce(F.col("doc_id").cast("string"), F.lit("")))


def _first_over(bins: DataFrame, key: str) -> DataFrame:
    """Per source the first ``key`` at which the words so far exceed ``open_words``; ``before``: words before it."""
    w = Window.partitionBy("source").orderBy(key)
    run = bins.withColumn("upto", F.sum("words").over(w) + F.col("base")).where(F.col("upto") > F.col("open_words"))
    first = run.withColumn("place", F.row_number().over(w)).where("place = 1")
    return first.select(F.col("source").alias("f_source"), F.col(key).alias(f"f_{key}"), (F.col("upto") - F.col("words")).alias("before"), "open_words")


def _joined(df: DataFrame, other: DataFrame, key: str, rows: int, how: str = "inner") -> DataFrame:
    return df.join(small(other, rows), df["source"].eqNullSafe(F.col(key)), how)


def plan_mix(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, source, text, ...)`` -> doc_id, source, size, source_size, target, copies, taken."""
    thin = cut(sized(docs))
    by_class = thin.groupBy("source", "class").agg(F.sum("size").alias("words"))
    by_class = cut(by_class)
    sources = cut(targets(by_class))
    n_sources, n_classes = sources.count(), by_class.count()
    expected = cut(_expected(by_class, sources))
    opened = expected.groupBy("source").agg((F.max("target") - F.sum(F.col("certain") * F.col("words"))).alias("open_words"))
    ranked = _ranked(thin, expected, n_classes)
    candidates = ranked.where("q IS NOT NULL")
    bins = cut(candidates.groupBy("source", "bin").agg(F.sum("size").alias("words")))
    # Two steps of at most SIDE bins a source find the bin in which the sample ends.
    coarse = bins.groupBy("source", F.floor(F.col("bin") / SIDE).alias("upper")).agg(F.sum("words").alias("words")).withColumn("base", F.lit(0))
    coarse = _joined(coarse, opened.select(F.col("source").alias("o_source"), "open_words"), "o_source", n_sources)
    upper = _first_over(coarse, "upper")
    fine = _joined(bins, upper.withColumnRenamed("before", "base"), "f_source", n_sources).where(F.floor(F.col("bin") / SIDE) == F.col("f_upper"))
    last_bin = cut(_first_over(fine, "bin"))
    edge = _joined(candidates.select("source", "bin", "q", "id", "size"), last_bin, "f_source", n_sources).where("bin = f_bin")
    run = F.sum("size").over(Window.partitionBy("source").orderBy("q", "id")) + F.col("before")
    inside = edge.withColumn("run", run).where(F.col("run") <= F.col("open_words"))
    ended = inside.groupBy("source").agg(F.max(F.struct("q", "id")).alias("last"), F.max("run").alias("run"))
    ends = last_bin.join(ended, last_bin["f_source"].eqNullSafe(ended["source"]), "left")
    ends = cut(ends.select("f_source", "f_bin", "last", (F.col("open_words") - F.coalesce("run", "before")).alias("gap")))
    sampled = (F.col("f_bin").isNull()) | (F.col("bin") < F.col("f_bin")) | ((F.col("bin") == F.col("f_bin")) & F.coalesce(F.struct("q", "id") <= F.col("last"), F.lit(False)))
    placed = _joined(ranked, ends, "f_source", n_sources, "left").withColumn("sampled", F.col("q").isNotNull() & sampled)
    closing = placed.where("q IS NOT NULL AND NOT sampled AND size < 2 * gap")
    closing = closing.groupBy("source").agg(F.min(F.struct(F.abs(F.col("size") - F.col("gap")).alias("off"), "q", "id", "size")).alias("close"))
    closing = cut(closing.select(F.col("source").alias("c_source"), "close"))
    with_close = _joined(placed, closing, "c_source", n_sources, "left")
    closes = F.coalesce((F.col("q") == F.col("close.q")) & (F.col("id") == F.col("close.id")) & (F.col("size") == F.col("close.size")), F.lit(False))
    copies = F.coalesce("certain", F.lit(0)) + F.when(F.col("sampled") | closes, 1).otherwise(0)
    named = with_close.withColumn("copies", copies.cast("long"))
    out = _joined(named, sources.withColumnRenamed("source", "t_source"), "t_source", n_sources)
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mix(docs: DataFrame) -> DataFrame:
    """The mixed documents themselves: every row as often as the plan takes it, all columns kept, whatever their names."""
    docs, back = apart(docs, ("doc_id", "source", "text"))
    plan = cut(plan_mix(docs).select(F.col("doc_id").alias("m_id"), F.col("source").alias("m_source"), F.col("size").alias("m_size"), "copies").where("copies > 0").distinct())
    size = F.coalesce(F.regexp_count("text", F.lit(WORDS)), F.lit(0)).cast("long")
    held = docs.withColumn("m_size0", size)
    on = held["doc_id"].eqNullSafe(plan["m_id"]) & held["source"].eqNullSafe(plan["m_source"]) & (held["m_size0"] == plan["m_size"])
    return held.join(plan, on).withColumn("m_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select(*back)


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = plan_mix(table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", F.round("target", 4).alias("target"), "taken")


#: The same plan by whole sorts, for the SQL check.
MIX_SQL = """
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
         (('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u,
         coalesce(doc_id::VARCHAR, '') AS id
  FROM documents),
classed AS (SELECT *, CASE WHEN size > 0 THEN length(bin(size)) ELSE 0 END AS class FROM sized),
by_class AS (SELECT source, class, sum(size)::BIGINT AS words FROM classed GROUP BY ALL),
ranked AS (
  SELECT source, sum(words)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM by_class GROUP BY source),
weighed AS (SELECT *, ((place - 1) % 3 + 1)::DOUBLE AS weight, source_size * 3.0::DOUBLE AS cap, (sum(source_size) OVER ())::DOUBLE AS total FROM ranked),
stepped AS (
  SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY cap / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS step FROM weighed),
targets AS (
  SELECT source, source_size, CASE WHEN level IS NULL THEN cap ELSE least(cap, weight * level) END AS target
  FROM (SELECT *, max(CASE WHEN cap > step * weight THEN step END) OVER () AS level FROM stepped)),
filled AS (
  SELECT b.source, b.class, b.words, t.target, b.words * 3.0::DOUBLE AS cap, b.words * b.class::DOUBLE AS weight
  FROM by_class b JOIN targets t ON b.source IS NOT DISTINCT FROM t.source WHERE b.class > 0),
steps AS (
  SELECT *, (target - coalesce(sum(cap) OVER (PARTITION BY source ORDER BY class DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (PARTITION BY source ORDER BY class DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS step FROM filled),
means AS (
  SELECT source, class, words, target, CASE WHEN level IS NULL THEN 3.0 ELSE least(3.0::DOUBLE, class * level) END AS mean
  FROM (SELECT *, max(CASE WHEN cap > step * weight THEN step END) OVER (PARTITION BY source) AS level FROM steps)),
expected AS (SELECT source, class, words, target, floor(mean)::BIGINT AS certain, mean - floor(mean) AS p FROM means),
opened AS (SELECT source, max(target) - sum(certain * words)::DOUBLE AS open_words FROM expected GROUP BY source),
docs AS (
  SELECT c.doc_id, c.id, c.source, c.size, coalesce(e.certain, 0) AS certain, o.open_words,
         CASE WHEN e.p > 0 THEN ((u / (1 - u)) / (p / (1 - p))) / (1 + (u / (1 - u)) / (p / (1 - p))) END AS q
  FROM classed c LEFT JOIN expected e ON c.source IS NOT DISTINCT FROM e.source AND c.class = e.class
  LEFT JOIN opened o ON c.source IS NOT DISTINCT FROM o.source),
run AS (
  SELECT *, CASE WHEN q IS NULL THEN NULL ELSE sum(size) OVER (PARTITION BY source, q IS NULL ORDER BY q, id) END AS upto FROM docs),
sampled AS (SELECT *, coalesce(upto <= open_words, false) AS sampled FROM run),
gaps AS (SELECT source, max(open_words) - coalesce(max(CASE WHEN sampled THEN upto END), 0) AS gap FROM sampled GROUP BY source),
closing AS (
  SELECT s.source, min(struct_pack(a := abs(s.size - g.gap), b := s.q, c := s.id, d := s.size)) AS m
  FROM sampled s JOIN gaps g ON s.source IS NOT DISTINCT FROM g.source
  WHERE s.q IS NOT NULL AND NOT s.sampled AND s.size < 2 * g.gap GROUP BY s.source)
SELECT s.doc_id, s.size, t.source_size, round(t.target, 4) AS target,
       ((s.certain + CASE WHEN s.sampled OR coalesce(s.q = c.m.b AND s.id = c.m.c AND s.size = c.m.d, false) THEN 1 ELSE 0 END) * s.size)::BIGINT AS taken
FROM sampled s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source LEFT JOIN closing c ON s.source IS NOT DISTINCT FROM c.source
"""

QUERIES = {"op1_mixing": op1_mixing}
SQL = {"op1_mixing": MIX_SQL}
