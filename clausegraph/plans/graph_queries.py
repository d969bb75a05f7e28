"""Registered queries: graph, hierarchy, layout and audit operators over the relational tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clausegraph.operators import graph, layout, link, retrieve, verify
from clausegraph.plans.retrieval_queries import read


def _edges(spark, sf_dir) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem")
    return lines.select(F.concat(F.lit("p-"), "l_partkey").alias("src"), F.concat(F.lit("v-"), "l_suppkey").alias("dst"), F.when(F.col("l_linenumber") % 2 == 0, "PENALISED_BY").otherwise("REFERENCES").alias("type"), (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("edge_seq"), F.col("l_returnflag").alias("quote"))


def edge_dedup_lastwins(spark, sf_dir):
    return graph.upsert_edges(_edges(spark, sf_dir)).select("src", "dst", "type", "edge_seq", "quote")


def weighted_edges(spark, sf_dir):
    return graph.collapse(graph.upsert_edges(_edges(spark, sf_dir)))


def pagerank_10(spark, sf_dir):
    """Ten rounds over parts and suppliers, edges both ways round the heavier direction."""
    weighted = graph.collapse(graph.upsert_edges(_edges(spark, sf_dir)))
    back = weighted.select(F.col("dst").alias("src"), F.col("src").alias("dst"), (F.col("weight") / 2).alias("weight"))
    nodes = read(spark, sf_dir, "part").select(F.concat(F.lit("p-"), "p_partkey").alias("node_id")).unionByName(read(spark, sf_dir, "supplier").select(F.concat(F.lit("v-"), "s_suppkey").alias("node_id")))
    return graph.pagerank(nodes, weighted.unionByName(back), rounds=10, tolerance=None)


def _hierarchy(spark, sf_dir) -> DataFrame:
    region = read(spark, sf_dir, "region").select(F.concat(F.lit("r-"), "r_regionkey").alias("node_id"), F.lit(None).cast("string").alias("parent_id"), F.lit("Region").alias("kind"))
    nation = read(spark, sf_dir, "nation").select(F.concat(F.lit("n-"), "n_nationkey"), F.concat(F.lit("r-"), "n_regionkey"), F.lit("Nation"))
    customer = read(spark, sf_dir, "customer").select(F.concat(F.lit("c-"), "c_custkey"), F.concat(F.lit("n-"), "c_nationkey"), F.when(F.col("c_mktsegment") == "BUILDING", "Chunk").otherwise("Customer"))
    orders = read(spark, sf_dir, "orders").select(F.concat(F.lit("o-"), "o_orderkey"), F.concat(F.lit("c-"), "o_custkey"), F.lit("Order"))
    return region.union(nation).union(customer).union(orders)


def hierarchy_closure(spark, sf_dir):
    return graph.closure(_hierarchy(spark, sf_dir))


def rollup_nearest(spark, sf_dir):
    nodes = _hierarchy(spark, sf_dir)
    targets = nodes.where("kind IN ('Chunk', 'Nation')").select(F.col("node_id").alias("anc_id"))
    return graph.roll_up(graph.closure(nodes), targets)


def expand_two_hop(spark, sf_dir):
    """Every supplier is a query with itself as seed; at most ten chunks more, over two hops."""
    edges = graph.upsert_edges(_edges(spark, sf_dir))
    chunk = edges.select(F.explode(F.array("src", "dst")).alias("node_id")).distinct().withColumn("chunk_id", F.col("node_id"))
    authority = chunk.select("node_id", (F.length("node_id") / 10).alias("authority"))
    adj = graph.adjacency(edges, chunk, authority)
    seeds = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("query_id"), F.concat(F.lit("v-"), "s_suppkey").alias("chunk_id"), F.lit(1).alias("pos"))
    out = retrieve.expand_graph(seeds, adj)
    return out.select("query_id", "chunk_id", F.col("hop").cast("int"), F.round("weight", 4).alias("weight"), "via_type", "via_chunk")


def nearest_match(spark, sf_dir):
    """For each purchase the nearest view of the same user (ties: the earlier event id)."""
    events = read(spark, sf_dir, "events").select("event_id", "user_id", F.col("event_type"), F.col("ts").cast("timestamp").cast("double").alias("at"))
    return layout.nearest(events, ["user_id"], "at", "event_id", F.col("event_type") == "purchase", F.col("event_type") == "view").select(F.col("event_id"), F.col("near_id"), F.round("gap", 3).alias("gap"))


def gap_islands(spark, sf_dir):
    """Bursts of each user's events: a new one after a gap of over a day."""
    events = read(spark, sf_dir, "events").select("user_id", "event_id", F.col("ts").cast("timestamp").cast("double").alias("at"))
    return layout.islands(events, ["user_id"], "at", "event_id", 86400.0).groupBy("user_id", "island").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"))


def cluster_peaks(spark, sf_dir):
    hist = read(spark, sf_dir, "orders").groupBy(F.bround(F.col("o_totalprice") / 1000).alias("x")).agg(F.count("*").alias("n"))
    return layout.peaks(hist, 1.5, 20)


def mode_gap_divide(spark, sf_dir):
    hist = read(spark, sf_dir, "lineitem").groupBy(F.bround(F.col("l_extendedprice") / 500).alias("x")).agg(F.count("*").alias("n"))
    return layout.divide(hist, 1.0)


def half_even_snap(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", layout.snap(F.col("l_quantity"), 3.0, 4.0).alias("rung"))


def modal_delta(spark, sf_dir):
    lines = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_quantity").alias("top"))
    return layout.modal_delta(lines, 6.0, 30.0)


def prefix_drop_running_flag(spark, sf_dir):
    """Each user's events from the first purchase on."""
    events = read(spark, sf_dir, "events")
    return layout.from_first(events, ["user_id"], ["ts", "event_id"], F.col("event_type") == "purchase").select("user_id", "event_id")


def table_page_semi_anti(spark, sf_dir):
    """Order lines of orders that hold a returned line, and of others, as two kinds."""
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    table, body = layout.route(lines, "l_orderkey", F.col("l_returnflag") == "R")
    return table.withColumn("part", F.lit("table")).unionByName(body.withColumn("part", F.lit("body"))).select("l_orderkey", "l_linenumber", "part")


def ordered_string_agg(spark, sf_dir):
    turns = read(spark, sf_dir, "conversations")
    ordered = F.array_sort(F.collect_list(F.struct("turn", F.coalesce("text", F.lit("")).alias("t"))))
    return turns.groupBy("conv_id").agg(F.sha2(F.array_join(F.transform(ordered, lambda x: x["t"]), "\n"), 256).alias("text_sha256"), F.count("*").alias("turns"))


def round_trip_hash(spark, sf_dir):
    """Build id: the hash of the sorted row hashes of a table (partial per bucket, so no task sees all rows)."""
    rows = read(spark, sf_dir, "documents").select(F.sha2(F.concat_ws("|", F.col("doc_id").cast("string"), F.coalesce("text", F.lit(""))), 256).alias("h"))
    buckets = rows.groupBy(F.substring("h", 1, 2).alias("b")).agg(F.sha2(F.array_join(F.sort_array(F.collect_list("h")), ""), 256).alias("h"))
    return buckets.agg(F.substring(F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("b", "h"))), lambda x: x["h"]), ""), 256), 1, 12).alias("build_id"))


def seq_completeness(spark, sf_dir):
    """Orders whose line numbers have holes."""
    found = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_linenumber").alias("have"), F.max("l_linenumber").alias("last"))
    missing = F.array_except(F.sequence(F.lit(1), F.col("last")), "have")
    return found.where(F.size(missing) > 0).select("l_orderkey", F.array_join(F.array_sort(missing), ",").alias("missing"))


def ref_scan_resolve(spark, sf_dir):
    """References in texts made from order lines, resolved against existing orders."""
    lines = read(spark, sf_dir, "lineitem")
    text = F.concat(F.lit("see sub-section ("), "l_linenumber", F.lit(") of section "), "l_orderkey", F.lit(" and section "), "l_partkey")
    rows = lines.select(F.concat_ws("-", F.lit("s"), "l_orderkey", "l_linenumber").alias("node_id"), F.lit(None).cast("string").alias("owner"), text.alias("text"))
    found = link.scan_references(rows, 10**9)
    targets = lines.select(F.concat_ws("-", F.lit("s"), "l_orderkey", "l_linenumber").alias("node_id")).unionByName(read(spark, sf_dir, "orders").select(F.concat(F.lit("s-"), "o_orderkey").alias("node_id"))).distinct()
    edges, unresolved, _ = link.resolve(found, targets)
    return edges.select("src", "dst", F.lit("edge").alias("kind")).unionByName(unresolved.select("src", "dst", F.lit("unresolved").alias("kind"))).distinct()


def citation_status(spark, sf_dir):
    """Answers made from order lines cite sections; each answer's retrieved id is its order."""
    lines = read(spark, sf_dir, "lineitem")
    answers = lines.select(F.concat_ws(":", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("query_id"), F.concat(F.lit("As §"), "l_orderkey", F.lit("("), "l_linenumber", F.lit(") says; see also section "), "l_partkey", F.lit(" and Schedule entry "), "l_suppkey").alias("answer"))
    retrieved = lines.select(F.concat_ws(":", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("query_id"), F.concat(F.lit("s-"), "l_orderkey").alias("node_id"))
    known = lines.select(F.concat_ws("-", F.lit("s"), "l_orderkey", "l_linenumber").alias("node_id")).unionByName(read(spark, sf_dir, "orders").select(F.concat(F.lit("s-"), "o_orderkey").alias("node_id"))).distinct()
    return verify.check_citations(answers, retrieved, known).select("query_id", "cited", "status")


def header_collect(spark, sf_dir):
    """Per order the sorted different suppliers, and those of returned lines."""
    lines = read(spark, sf_dir, "lineitem")
    names = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ", ")
    name = F.concat(F.lit("v-"), "l_suppkey")
    return lines.groupBy("l_orderkey").agg(names(name).alias("cites"), names(F.when(F.col("l_returnflag") == "R", name)).alias("penalised_by"))


def penalty_facts(spark, sf_dir):
    """Per supplier its balance and the sorted parts that are penalised by it."""
    edges = graph.upsert_edges(_edges(spark, sf_dir)).where("type = 'PENALISED_BY'").select("src", "dst")
    suppliers = read(spark, sf_dir, "supplier").select(F.concat(F.lit("v-"), "s_suppkey").alias("node_id"), F.col("s_acctbal").alias("amount"))
    return verify.penalty_facts(suppliers, edges).select("node_id", "amount", F.array_join("duties", ", ").alias("duties"))


def audit_dedup(spark, sf_dir):
    """One record a user and type: the last one appended."""
    events = read(spark, sf_dir, "events")
    last = events.groupBy("user_id", "event_type").agg(F.max(F.struct("event_id", "value")).alias("l"), F.count("*").alias("n"))
    return last.select("user_id", "event_type", F.col("l.event_id").alias("event_id"), F.col("l.value").alias("value"), "n")


QUERIES = {f.__name__: f for f in (edge_dedup_lastwins, weighted_edges, pagerank_10, hierarchy_closure, rollup_nearest, expand_two_hop, nearest_match, gap_islands, cluster_peaks, mode_gap_divide, half_even_snap, modal_delta, prefix_drop_running_flag, table_page_semi_anti, ordered_string_agg, round_trip_hash, seq_completeness, ref_scan_resolve, citation_status, header_collect, penalty_facts, audit_dedup)}

_EDGE_SQL = """
e AS (SELECT 'p-' || l_partkey AS src, 'v-' || l_suppkey AS dst, CASE WHEN l_linenumber % 2 = 0 THEN 'PENALISED_BY' ELSE 'REFERENCES' END AS type, l_orderkey * 100 + l_linenumber AS edge_seq, l_returnflag AS quote FROM lineitem),
edges AS (SELECT * EXCLUDE n FROM (SELECT *, row_number() OVER (PARTITION BY src, dst, type ORDER BY edge_seq DESC) AS n FROM e) WHERE n = 1),
weighted AS (SELECT src, dst, sum(CASE WHEN type = 'REFERENCES' THEN 1.0::DOUBLE ELSE 0.5 END) AS weight FROM edges GROUP BY ALL)
"""
_TREE_SQL = """
nodes AS (SELECT 'r-' || r_regionkey AS node_id, NULL AS parent_id, 'Region' AS kind FROM region UNION ALL SELECT 'n-' || n_nationkey, 'r-' || n_regionkey, 'Nation' FROM nation
  UNION ALL SELECT 'c-' || c_custkey, 'n-' || c_nationkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 'Chunk' ELSE 'Customer' END FROM customer UNION ALL SELECT 'o-' || o_orderkey, 'c-' || o_custkey, 'Order' FROM orders),
up AS (SELECT node_id, node_id AS anc_id, 0 AS depth FROM nodes UNION ALL SELECT u.node_id, n.parent_id, u.depth + 1 FROM up u JOIN nodes n ON u.anc_id = n.node_id WHERE n.parent_id IS NOT NULL)
"""


def _pagerank_sql(rounds: int) -> str:
    steps = [f"WITH {_EDGE_SQL}, both_ AS (SELECT src, dst, weight FROM weighted UNION ALL SELECT dst, src, weight / 2 FROM weighted), outs AS (SELECT src, sum(weight) AS t FROM both_ GROUP BY src), shares AS (SELECT b.src, dst, weight / t AS share FROM both_ b JOIN outs USING (src)), nodes AS (SELECT 'p-' || p_partkey AS node_id FROM part UNION ALL SELECT 'v-' || s_suppkey FROM supplier), total AS (SELECT count(*)::DOUBLE AS n FROM nodes), r0 AS (SELECT node_id, 1.0 / n AS rank FROM nodes, total)"]
    for i in range(rounds):
        steps.append(f"got{i} AS (SELECT dst AS node_id, sum(rank * share) AS got FROM shares JOIN r{i} ON src = node_id GROUP BY dst), loose{i} AS (SELECT coalesce(sum(rank), 0) AS l FROM r{i} WHERE node_id NOT IN (SELECT src FROM outs)), r{i + 1} AS (SELECT r.node_id, 0.85 * (coalesce(got, 0) + l / n) + 0.15 / n AS rank FROM nodes r LEFT JOIN got{i} USING (node_id), loose{i}, total)")
    return ", ".join(steps) + f" SELECT node_id, round(rank, 6) AS authority FROM r{rounds}"


SQL = {
    "edge_dedup_lastwins": f"WITH {_EDGE_SQL} SELECT src, dst, type, edge_seq, quote FROM edges",
    "weighted_edges": f"WITH {_EDGE_SQL} SELECT src, dst, weight FROM weighted",
    "pagerank_10": _pagerank_sql(10),
    "hierarchy_closure": f"WITH RECURSIVE {_TREE_SQL} SELECT node_id, anc_id, depth FROM up",
    "rollup_nearest": f"WITH RECURSIVE {_TREE_SQL} SELECT node_id, chunk_id FROM (SELECT u.node_id, u.anc_id AS chunk_id, row_number() OVER (PARTITION BY u.node_id ORDER BY u.depth, u.anc_id) AS n FROM up u JOIN nodes t ON t.node_id = u.anc_id AND t.kind IN ('Chunk', 'Nation')) WHERE n = 1",
    "expand_two_hop": f"""WITH {_EDGE_SQL},
      adj AS (SELECT src AS chunk_id, dst AS target, type, CASE type WHEN 'PENALISED_BY' THEN 0 ELSE 2 END AS prio, edge_seq, length(dst) / 10.0 AS authority FROM edges
        UNION ALL SELECT dst, src, CASE type WHEN 'PENALISED_BY' THEN 'PENALISES' ELSE 'CITED_BY' END, CASE type WHEN 'PENALISED_BY' THEN 1 ELSE 4 END, edge_seq, length(src) / 10.0 FROM edges),
      h0 AS (SELECT s_suppkey AS query_id, 'v-' || s_suppkey AS chunk_id, 1 AS ins FROM supplier),
      c1 AS (SELECT h.query_id, a.target, a.chunk_id AS via, a.type, a.prio, h.ins, a.authority, a.edge_seq FROM h0 h JOIN adj a USING (chunk_id) WHERE a.target <> a.chunk_id),
      o1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, target ORDER BY prio, ins, authority DESC, edge_seq, type) AS k FROM c1 WHERE NOT EXISTS (SELECT 1 FROM h0 WHERE h0.query_id = c1.query_id AND h0.chunk_id = c1.target)) WHERE k = 1),
      h1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY prio, ins, authority DESC, edge_seq, type, target) AS n FROM o1) WHERE n <= 10),
      used AS (SELECT query_id, count(*) AS u FROM h1 GROUP BY query_id),
      c2 AS (SELECT h.query_id, a.target, a.chunk_id AS via, a.type, a.prio, h.n AS ins, a.authority, a.edge_seq FROM h1 h JOIN adj a ON a.chunk_id = h.target WHERE a.target <> a.chunk_id),
      o2 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, target ORDER BY prio, ins, authority DESC, edge_seq, type) AS k FROM c2
        WHERE NOT EXISTS (SELECT 1 FROM h0 WHERE h0.query_id = c2.query_id AND h0.chunk_id = c2.target) AND NOT EXISTS (SELECT 1 FROM h1 WHERE h1.query_id = c2.query_id AND h1.target = c2.target)) WHERE k = 1),
      h2 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY prio, ins, authority DESC, edge_seq, type, target) AS n FROM o2) JOIN used USING (query_id) WHERE n <= 10 - u)
      SELECT query_id, chunk_id, 0 AS hop, 1.0::DOUBLE AS weight, NULL::VARCHAR AS via_type, NULL::VARCHAR AS via_chunk FROM h0 UNION ALL SELECT query_id, target, 1, 0.6, type, via FROM h1 UNION ALL SELECT query_id, target, 2, 0.36, type, via FROM h2""",
    "nearest_match": """WITH p AS (SELECT event_id, user_id, epoch(ts) AS at FROM events WHERE event_type = 'purchase'), v AS (SELECT event_id AS near_id, user_id, epoch(ts) AS vat FROM events WHERE event_type = 'view')
      SELECT event_id, near_id, round(gap, 3) AS gap FROM (SELECT p.event_id, v.near_id, abs(p.at - v.vat) AS gap, row_number() OVER (PARTITION BY p.event_id ORDER BY abs(p.at - v.vat), v.near_id) AS n FROM p JOIN v USING (user_id)) WHERE n = 1""",
    "gap_islands": """WITH s AS (SELECT user_id, event_id, epoch(ts) AS secs, lag(epoch(ts)) OVER (PARTITION BY user_id ORDER BY epoch(ts), event_id) AS before FROM events),
      i AS (SELECT *, sum(CASE WHEN before IS NULL OR secs - before > 86400.0 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY secs, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS island FROM s)
      SELECT user_id, island, count(*) AS n, min(event_id) AS first_id FROM i GROUP BY ALL""",
    "cluster_peaks": """WITH h AS (SELECT round_even(o_totalprice / 1000, 0) AS x, count(*) AS n FROM orders GROUP BY ALL), s AS (SELECT *, lag(x) OVER (ORDER BY x) AS b FROM h),
      i AS (SELECT *, sum(CASE WHEN b IS NULL OR x - b > 1.5 THEN 1 ELSE 0 END) OVER (ORDER BY x ROWS UNBOUNDED PRECEDING) AS k FROM s)
      SELECT round_even(sum(x * n) / sum(n), 1) AS peak, sum(n)::BIGINT AS n FROM i GROUP BY k HAVING sum(n) >= 20""",
    "mode_gap_divide": """WITH h AS (SELECT round_even(l_extendedprice / 500, 0) AS x, count(*) AS n FROM lineitem GROUP BY ALL), m AS (SELECT x AS mode FROM h ORDER BY n DESC, x LIMIT 1),
      g AS (SELECT x AS lo, lead(x) OVER (ORDER BY x) AS hi FROM h), w AS (SELECT lo, hi FROM g WHERE hi - lo >= 1.0)
      SELECT (SELECT round_even((lo + hi) / 2, 1) FROM w, m ORDER BY hi <= mode DESC, lo DESC LIMIT 1) AS left_x, (SELECT round_even((lo + hi) / 2, 1) FROM w, m ORDER BY lo >= mode DESC, lo LIMIT 1) AS right_x, (SELECT mode FROM m) AS mode_x""",
    "half_even_snap": "SELECT l_orderkey, l_linenumber, greatest(0, round_even((l_quantity - 3.0) / 4.0, 0))::INT AS rung FROM lineitem",
    "modal_delta": """WITH d AS (SELECT DISTINCT l_orderkey AS page, round_even(l_quantity, 1) AS top FROM lineitem), r AS (SELECT top - lag(top) OVER (PARTITION BY page ORDER BY top) AS step FROM d), s AS (SELECT round_even(step, 0) AS delta FROM r WHERE step > 6 AND step < 30)
      SELECT delta, n, round_even(delta * 0.4, 1) AS tolerance FROM (SELECT delta, count(*) AS n FROM s GROUP BY delta ORDER BY n DESC, delta LIMIT 1)""",
    "prefix_drop_running_flag": "SELECT user_id, event_id FROM (SELECT user_id, event_id, max(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS f FROM events) WHERE f = 1",
    "table_page_semi_anti": "SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') THEN 'table' ELSE 'body' END AS part FROM lineitem",
    "ordered_string_agg": "SELECT conv_id, sha256(string_agg(coalesce(text, ''), chr(10) ORDER BY turn, coalesce(text, ''))) AS text_sha256, count(*) AS turns FROM conversations GROUP BY conv_id",
    "round_trip_hash": "WITH h AS (SELECT sha256(concat_ws('|', doc_id::VARCHAR, coalesce(text, ''))) AS h FROM documents), b AS (SELECT substr(h, 1, 2) AS b, sha256(string_agg(h, '' ORDER BY h)) AS h FROM h GROUP BY 1) SELECT substr(sha256(string_agg(h, '' ORDER BY b)), 1, 12) AS build_id FROM b",
    "seq_completeness": "WITH l AS (SELECT l_orderkey, max(l_linenumber) AS last FROM lineitem GROUP BY 1), w AS (SELECT l_orderkey, unnest(generate_series(1, last)) AS n FROM l) SELECT l_orderkey, string_agg(n::VARCHAR, ',' ORDER BY n) AS missing FROM w WHERE NOT EXISTS (SELECT 1 FROM lineitem x WHERE x.l_orderkey = w.l_orderkey AND x.l_linenumber = w.n) GROUP BY 1",
    "ref_scan_resolve": """WITH r AS (SELECT 's-' || l_orderkey || '-' || l_linenumber AS src, unnest(['s-' || l_orderkey || '-' || l_linenumber, 's-' || l_partkey]) AS dst FROM lineitem),
      k AS (SELECT 's-' || l_orderkey || '-' || l_linenumber AS id FROM lineitem UNION SELECT 's-' || o_orderkey FROM orders)
      SELECT DISTINCT src, dst, CASE WHEN dst IN (SELECT id FROM k) THEN 'edge' ELSE 'unresolved' END AS kind FROM r WHERE src <> dst""",
    "citation_status": """WITH a AS (SELECT l_orderkey || ':' || l_linenumber AS query_id, 's-' || l_orderkey AS got, unnest(['s-' || l_orderkey || '-' || l_linenumber, 's-' || l_partkey, 'pen-' || l_suppkey]) AS cited FROM lineitem),
      k AS (SELECT 's-' || l_orderkey || '-' || l_linenumber AS id FROM lineitem UNION SELECT 's-' || o_orderkey FROM orders)
      SELECT query_id, cited, CASE WHEN cited NOT IN (SELECT id FROM k) THEN 'unresolved' WHEN cited = got OR starts_with(cited, got || '-') OR starts_with(got, cited || '-') THEN 'verified' ELSE 'out_of_context' END AS status FROM (SELECT DISTINCT * FROM a)""",
    "header_collect": "SELECT l_orderkey, string_agg(DISTINCT 'v-' || l_suppkey, ', ' ORDER BY 'v-' || l_suppkey) AS cites, coalesce(string_agg(DISTINCT 'v-' || l_suppkey, ', ' ORDER BY 'v-' || l_suppkey) FILTER (WHERE l_returnflag = 'R'), '') AS penalised_by FROM lineitem GROUP BY 1",
    "penalty_facts": f"WITH {_EDGE_SQL} SELECT 'v-' || s_suppkey AS node_id, s_acctbal AS amount, coalesce(string_agg(src, ', ' ORDER BY src), '') AS duties FROM supplier LEFT JOIN edges ON dst = 'v-' || s_suppkey AND type = 'PENALISED_BY' GROUP BY s_suppkey, s_acctbal",
    "audit_dedup": "SELECT user_id, event_type, max(event_id) AS event_id, max_by(value, event_id) AS value, count(*) AS n FROM events GROUP BY ALL",
}
