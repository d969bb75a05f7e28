"""Layout of positioned words: histograms, peaks, gaps, rungs, row clustering, columns, tables, margin notes.

All of it is window and aggregate work per document or page; only row clustering, whose rows are anchored on their
first word, runs as a grouped pandas function.
"""

from __future__ import annotations

import bisect

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def histogram(words: DataFrame, column: str, digits: int = 0) -> DataFrame:
    """x, n of half-even rounded positions."""
    return words.groupBy(F.bround(column, digits).alias("x")).agg(F.count("*").alias("n"))


def modal_delta(lines: DataFrame, low: float, high: float) -> DataFrame:
    """One row: the most frequent step between the page's different tops within (low, high), in whole points, and the line
    tolerance; the smaller of equally frequent steps."""
    tops = lines.select("page", F.bround("top", 1).alias("top")).distinct()
    step = F.col("top") - F.lag("top").over(Window.partitionBy("page").orderBy("top"))
    counted = tops.select(step.alias("step")).where((F.col("step") > low) & (F.col("step") < high)).groupBy(F.bround("step").alias("delta")).agg(F.count("*").alias("n"))
    return counted.orderBy(F.desc("n"), "delta").limit(1).withColumn("tolerance", F.bround(F.col("delta") * 0.4, 1))


def divide(hist: DataFrame, min_gap: float = 12.0) -> DataFrame:
    """One row: middles of the gaps next to the most frequent position, left and right of it; without a gap on a side, the
    last (left) or first (right) of all gaps."""
    mode = hist.orderBy(F.desc("n"), "x").limit(1).select(F.col("x").alias("mode_x"))
    gaps = hist.select(F.col("x").alias("lo"), F.lead("x").over(Window.orderBy("x")).alias("hi")).where(F.col("hi") - F.col("lo") >= min_gap)
    middle = F.bround((F.col("lo") + F.col("hi")) / 2, 1)
    before, after = F.when(F.col("hi") <= F.col("mode_x"), F.col("lo")), F.when(F.col("lo") >= F.col("mode_x"), F.col("lo"))
    left = F.coalesce(F.max_by(middle, before), F.max_by(middle, "lo"))
    right = F.coalesce(F.min_by(middle, after), F.min_by(middle, "lo"))
    return gaps.crossJoin(F.broadcast(mode)).groupBy("mode_x").agg(left.alias("left_x"), right.alias("right_x")).select("left_x", "right_x", "mode_x")


def peaks(hist: DataFrame, tolerance: float, least: int) -> DataFrame:
    """peak, n: runs of positions no further apart than ``tolerance``, their weighted mean, at least ``least`` counts."""
    order = Window.orderBy("x")
    flagged = hist.withColumn("new", F.when(F.col("x") - F.lag("x").over(order) <= tolerance, 0).otherwise(1))
    runs = flagged.withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("run").agg(F.bround(F.sum(F.col("x") * F.col("n")) / F.sum("n"), 1).alias("peak"), F.sum("n").alias("n")).where(F.col("n") >= least).select("peak", "n")


def ladder(found: DataFrame) -> DataFrame:
    """base, step of the rungs: the median difference of peaks, and one step below the first."""
    diff = F.col("peak") - F.lag("peak").over(Window.orderBy("peak"))
    out = found.withColumn("diff", diff).agg(F.median("diff").alias("step"), F.min("peak").alias("first"))
    return out.select((F.col("first") - F.col("step")).alias("base"), "step")


def snap(x: Column, base: float, step: float) -> Column:
    return F.greatest(F.lit(0), F.bround((x - base) / step).cast("int"))


def islands(df: DataFrame, by: list[str], at: str, key: str, tolerance: float) -> DataFrame:
    """Adds ``island``: a new one starts where ``at`` is over ``tolerance`` past the previous row."""
    order = Window.partitionBy(*by).orderBy(at, key)
    new = F.when(F.col(at) - F.lag(at).over(order) <= tolerance, 0).otherwise(1)
    return df.withColumn("_new", new).withColumn("island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def nearest(df: DataFrame, by: list[str], at: str, key: str, left: Column, right: Column) -> DataFrame:
    """For each row with ``left`` the row with ``right`` in the same group whose ``at`` is nearest (ties: smaller key):
    key, near_id, gap. Windows on both sides of a merged order instead of a join of groups with themselves."""
    points = df.where(right).groupBy(*by, at).agg(F.min(key).alias("p_key")).withColumn("p_at", F.col(at))
    rows = df.where(left).select(*by, at, F.col(key).alias("l_key")).unionByName(points, allowMissingColumns=True)
    order = Window.partitionBy(*by).orderBy(at)
    point = F.when(F.col("p_key").isNotNull(), F.struct("p_at", "p_key"))
    sides = rows.select("*", F.last(point, True).over(order.rangeBetween(Window.unboundedPreceding, 0)).alias("before"), F.first(point, True).over(order.rangeBetween(0, Window.unboundedFollowing)).alias("after")).where("l_key IS NOT NULL")
    choice = lambda side: F.when(F.col(side).isNotNull(), F.struct(F.abs(F.col(at) - F.col(f"{side}.p_at")).alias("gap"), F.col(f"{side}.p_key").alias("k")))
    best = F.array_min(F.filter(F.array(choice("before"), choice("after")), lambda x: x.isNotNull()))
    return sides.withColumn("best", best).where("best IS NOT NULL").select(*by, F.col("l_key").alias(key), F.col("best.k").alias("near_id"), F.col("best.gap").alias("gap"))


def from_first(df: DataFrame, by: list[str], order: list[str], flag: Column) -> DataFrame:
    """Rows from the first flagged one on, per group."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("_seen", F.max(flag.cast("int")).over(w)).where("_seen = 1").drop("_seen")


def route(df: DataFrame, key: str, flag: Column) -> tuple[DataFrame, DataFrame]:
    """Rows of keys with a flagged row, and all others."""
    marked = df.where(flag).select(key).distinct()
    return df.join(marked, key, "left_semi"), df.join(marked, key, "left_anti")


def drop_running_headers(lines: DataFrame, pattern: str) -> DataFrame:
    return lines.where(~F.col("text").rlike(pattern))


ROW_SCHEMA = "doc_id string, page int, row int, top double, x0 double, x1 double, text string"


def group_rows(words: DataFrame, tolerance: float) -> DataFrame:
    """``words(doc_id, page, x0, x1, top, text)`` -> the words with their row number: a word joins the open row if its
    top is within ``tolerance`` of that row's first word."""

    def run(page: pd.DataFrame) -> pd.DataFrame:
        page = page.sort_values(["top", "x0"], kind="stable")
        rows, anchor, number = [], None, -1
        for top in page.top:
            if anchor is None or abs(top - anchor) > tolerance:
                anchor, number = top, number + 1
            rows.append(number)
        return page.assign(row=rows).sort_values(["row", "x0"], kind="stable")[["doc_id", "page", "row", "top", "x0", "x1", "text"]]

    return words.groupBy("doc_id", "page").applyInPandas(run, ROW_SCHEMA)


def split_columns(rows: DataFrame, left: float, right: float) -> DataFrame:
    """Per row the text inside the column [left, right] and the margin text outside, each in x order."""
    inside = (F.col("x0") >= left) & (F.col("x1") <= right)

    def text(which: Column) -> Column:
        ordered = F.array_sort(F.collect_list(F.when(which, F.struct("x0", "text"))))
        return F.array_join(F.transform(ordered, lambda w: w["text"]), " ")

    return rows.groupBy("doc_id", "page", "row").agg(F.min("top").alias("top"), F.min(F.when(inside, F.col("x0"))).alias("x0"), text(inside).alias("body"), text(~inside).alias("margin"))


def strip_citations(notes: DataFrame, pattern: str = r"\d{1,3} of \d{4}\.") -> DataFrame:
    """Margin notes -> citations found, and what is left of the text (rows without rest keep an empty one)."""
    return notes.withColumn("citations", F.regexp_extract_all("text", F.lit(f"({pattern})"), 1)).withColumn("residue", F.btrim(F.regexp_replace(F.regexp_replace("text", pattern, " "), r"\s+", " ")))


def join_fragments(notes: DataFrame, line_tolerance: float) -> DataFrame:
    """Margin fragments of a page joined to blocks; a new block after a gap of 3.5 line tolerances (1.4 lines)."""
    placed = islands(notes, ["doc_id", "page"], "top", "seq", line_tolerance / 0.4 * 1.4)
    ordered = F.array_sort(F.collect_list(F.struct("top", "seq", "residue")))
    return placed.where("residue <> ''").groupBy("doc_id", "page", "island").agg(F.min("top").alias("top"), F.array_join(F.transform(ordered, lambda x: x["residue"]), " ").alias("text")).withColumnRenamed("island", "block")


def gutters(spans: list[tuple[float, float]], least: int = 8) -> list[int]:
    """Left ends of columns: x positions right after uncovered runs of at least ``least``, and the first covered one."""
    covered = sorted({x for lo, hi in spans for x in range(int(lo), int(hi) + 1)})
    return [x for i, x in enumerate(covered) if i == 0 or x - covered[i - 1] - 1 >= least]


# The row of column numbers that opens a table, the rule that closes it.
COLUMN_NUMBERS, RULE = r"\(1\)\s+\(2\)\s+\(3\)", r"[—–-]{2,}"


def table_extent(words: pd.DataFrame) -> pd.DataFrame:
    """The words between the row of column numbers and the next rule. Without such a row the table begins with the page,
    without a rule it ends with it."""
    texts = words.sort_values(["row", "x0"], kind="stable").groupby("row", sort=True).text.agg(" ".join)
    opens = texts.index[texts.str.fullmatch(COLUMN_NUMBERS)]
    after = opens[0] if len(opens) else -1
    closes = texts.index[texts.str.fullmatch(RULE) & (texts.index > after)]
    return words[(words.row > after) & (words.row < closes[0] if len(closes) else True)]


def table_rows(words: pd.DataFrame) -> pd.DataFrame:
    """Rows of one table page (``row``, ``x0``, ``x1``, ``text``): columns by gutters within the table's extent, a new
    entry where the first column reads ``<number>.``, other cells appended with a blank."""
    words = table_extent(words)
    if words.empty:
        return pd.DataFrame({"sl_no": [], "breach": [], "penalty": []})
    edges = gutters(list(zip(words.x0, words.x1, strict=True)))
    out: list[list] = []
    for _, row in words.sort_values(["row", "x0"], kind="stable").groupby("row", sort=True):
        cells: dict[int, list[str]] = {}
        for x0, text in zip(row.x0, row.text, strict=True):
            cells.setdefault(max(0, bisect.bisect_right(edges, x0) - 1), []).append(text)
        first = " ".join(cells.get(0, []))
        if first.rstrip(".").isdigit() and first.endswith("."):
            out.append([int(first[:-1]), [], []])
        if out:
            for column in (1, 2):
                out[-1][column] += cells.get(column, [])
    return pd.DataFrame({"sl_no": [r[0] for r in out], "breach": [" ".join(r[1]) for r in out], "penalty": [" ".join(r[2]) for r in out]})


def parse_tables(words: DataFrame) -> DataFrame:
    """``words`` of table pages with ``row`` -> doc_id, page, sl_no, breach, penalty."""

    def run(key: tuple, page: pd.DataFrame) -> pd.DataFrame:
        found = table_rows(page)
        return found.assign(doc_id=key[0], page=key[1])[["doc_id", "page", "sl_no", "breach", "penalty"]].astype({"sl_no": "int32", "page": "int32"})

    return words.groupBy("doc_id", "page").applyInPandas(run, "doc_id string, page int, sl_no int, breach string, penalty string")
