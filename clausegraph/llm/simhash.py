"""SimHash near-duplicate classes by a Gray-order hierarchical index.

1. Each text becomes a 64-bit fingerprint: the majority bits of the XXH64 values of its word shingles.
2. Equal fingerprints collapse to one row (smallest doc_id), so groups of exact copies cost one entry.
3. Two fingerprints at most ``k`` bits apart agree on at least ``blocks - k`` of ``blocks`` bit blocks. Each choice of
   agreeing blocks is a routing key. ``blocks`` follows from the number of fingerprints, so that the entries of an
   average key stay few at every size; every setting is exact.
4. Within a key, fingerprints are sorted by Gray rank. Runs of FAN entries form nodes that keep the bits all members
   share (mask and pattern), runs of nodes form upper nodes, and a child keeps only the shared bits its parent lacks.
   A search carries the differences found so far and drops a node, with all below it, as soon as they exceed ``k``.
5. Keys with more than LARGE entries are cut into Gray runs of that size; runs whose shared bits differ by more
   than ``k`` are never paired, and each remaining pair of runs is a task of its own.
6. Each task hands on a spanning forest of the links it found, never all pairs. Components then follow by large-star
   and small-star steps over those edges, on the cluster.
7. Many tables (large ``k``) would each send a forest of the same dense group. Above WHOLE tables, FIRST of them that are
   spread over the blocks are linked first; the rest start from the classes so found and send only edges that join two
   of them. Every table is searched in full either way.

Defined results: a null or wordless text has fingerprint zero and links like any other. Equal texts share one class.
A null doc_id gets the class of its fingerprint; it never names a class unless a class has no other ids (null then).
Extra columns are ignored; texts of any length are hashed whole; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clausegraph.llm.runtime import BROADCAST_ROWS, cut, table

BITS, SEED = 64, 42
FAN = 16
#: Entries of a routing key above which it is cut into Gray runs; average entries of a key that choose ``blocks``.
LARGE, AVERAGE = 8192, 1024
#: (query, node) pairs that one step of a search holds.
STEP = 1 << 18
#: Routing tables up to which all are linked at once; tables of the first of two waves beyond that.
WHOLE, FIRST = 16, 8


def fingerprint(text: str | None, words_per_shingle: int) -> int:
    """Signed 64-bit fingerprint of a whole text."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= words_per_shingle:
        hashes = [xxhash.xxh64_intdigest(line, SEED)]
    else:
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
        ends = np.cumsum(sizes) - 1
        starts = (ends - sizes + 1)[: 1 - words_per_shingle or None].tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(line[a:b], SEED) for a, b in zip(starts, ends[words_per_shingle - 1 :].tolist(), strict=True)]
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):  # bounded memory for very long texts
        part = np.array(hashes[at : at + (1 << 16)], ">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes)).view(">i8")[0])


def fingerprints(docs: DataFrame, words_per_shingle: int = 5) -> DataFrame:
    """``docs(doc_id, text, ...)`` -> doc_id, fp (signed 64-bit)."""
    source = docs.select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(t.as_py(), words_per_shingle) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.int64())], names=["doc_id", "fp"])

    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, fp long")


def gray_rank(fp: np.ndarray) -> np.ndarray:
    """Position in Gray order: the number whose Gray code is ``fp``."""
    rank = fp.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


def block_bounds(blocks: int) -> list[tuple[int, int]]:
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    return list(zip(edges, edges[1:], strict=False))


def blocks_for(n: int, k: int) -> int:
    """Fewest blocks for which an average key holds at most AVERAGE of ``n`` fingerprints."""
    blocks = k + 1
    while blocks < 2 * k and n / 2.0 ** (BITS // blocks * (blocks - k)) > AVERAGE:
        blocks += 1
    return blocks


def routing_keys(blocks: int, k: int) -> list[Column]:
    """(table, bits of the agreeing blocks), one for each choice of ``blocks - k`` blocks."""
    bounds = block_bounds(blocks)
    keys = []
    for number, chosen in enumerate(combinations(range(blocks), blocks - k)):
        mask = sum((1 << hi) - (1 << lo) for lo, hi in (bounds[c] for c in chosen))
        mask -= (mask >> 63) << 64
        keys.append(F.struct(F.lit(number).alias("tab"), F.col("fp").bitwiseAND(F.lit(mask)).alias("bits")))
    return keys


def waves(keys: list[Column]) -> list[list[Column]]:
    """The tables in the order in which they are linked: at once, or an even spread of them before the rest."""
    if len(keys) <= WHOLE:
        return [keys]
    early = {len(keys) * i // FIRST for i in range(FIRST)}
    return [[key for i, key in enumerate(keys) if (i in early) == first] for first in (True, False)]


def _union(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the classes of a[i] and b[i], in place; ``parent`` stays flat, each class named by its smallest member."""
    while len(a):
        a, b = parent[a], parent[b]
        open_ = a != b
        a, b = a[open_], b[open_]
        if not len(a):
            return
        lo, hi = np.minimum(a, b), np.maximum(a, b)
        np.minimum.at(parent, hi, lo)
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent[:] = up
        a, b = lo, hi


class GrayIndex:
    """Nodes over entries that are sorted by (key, Gray rank); no node spans two keys."""

    def __init__(self, key: np.ndarray, fp: np.ndarray):
        self.fp = fp
        fresh = np.r_[True, key[1:] != key[:-1]] if len(key) else np.zeros(0, bool)
        group = np.cumsum(fresh) - 1
        begin = np.flatnonzero(fresh)
        full = np.full(len(fp), ~np.uint64(0))
        level = (fp.copy(), full, group, np.arange(len(fp)) - begin[group] if len(fp) else group)
        self.levels = []  # from the leaves' runs up: pattern, mask, first child, end of children
        while True:
            pattern, mask, group, place = level
            new = np.r_[True, (group[1:] != group[:-1]) | (place[1:] % FAN == 0)] if len(group) else np.zeros(0, bool)
            first = np.flatnonzero(new)
            if len(first):
                both, any_ = np.bitwise_and.reduceat(pattern, first), np.bitwise_or.reduceat(pattern, first)
                mask = np.bitwise_and.reduceat(mask, first) & ~(both ^ any_)
                pattern = both & mask
            self.levels.append((pattern, mask, first, np.r_[first[1:], len(group)].astype(np.int64)))
            level = (pattern, mask, group[first], place[first] // FAN)
            if len(first) == len(begin):
                break
        self.roots = np.arange(len(begin))
        self.group = np.cumsum(fresh) - 1

    def link(self, parent: np.ndarray, k: int, queries: np.ndarray | None = None) -> None:
        """Join the classes of all entries at most ``k`` bits apart within a key. Whole nodes that already are in the
        query's class are left out, so that dense groups of near copies do not cost all their pairs."""
        queries = np.arange(len(self.fp)) if queries is None else queries
        for at in range(0, len(queries), 4096):
            self._search(queries[at : at + 4096], parent, k)

    def _search(self, query: np.ndarray, parent: np.ndarray, k: int) -> None:
        single = self._single(parent)
        pattern, mask, _, _ = self.levels[-1]
        node = self.group[query]
        acc = np.bitwise_count((self.fp[query] ^ pattern[node]) & mask[node]).astype(np.int16)
        stack = [(len(self.levels) - 1, query, node, acc)]
        while stack:
            depth, q, node, acc = stack.pop()
            keep = (acc <= k) & (single[depth][node] != parent[q])
            q, node, acc = q[keep], node[keep], acc[keep]
            if not len(q):
                continue
            _, up_mask, first, end = self.levels[depth]
            for lo in range(0, len(q), STEP // FAN):
                part = slice(lo, lo + STEP // FAN)
                n, width = node[part], (end[node[part]] - first[node[part]])
                rep = np.repeat(np.arange(len(n)), width)
                child = first[n][rep] + np.arange(len(rep)) - np.repeat(np.cumsum(width) - width, width)
                qq, had = q[part][rep], acc[part][rep]
                if depth == 0:
                    diff = (self.fp[qq] ^ self.fp[child]) & ~up_mask[n][rep]
                    hit = (had + np.bitwise_count(diff) <= k) & (child != qq)
                    _union(parent, qq[hit], child[hit])
                else:
                    low_pattern, low_mask, _, _ = self.levels[depth - 1]
                    diff = (self.fp[qq] ^ low_pattern[child]) & low_mask[child] & ~up_mask[n][rep]
                    stack.append((depth - 1, qq, child, had + np.bitwise_count(diff).astype(np.int16)))

    def _single(self, parent: np.ndarray) -> list[np.ndarray]:
        """For each node the class that all its entries are in, or -1."""
        out, low, high = [], parent, parent
        for _, _, first, _ in self.levels:
            if not len(first):
                return [np.zeros(0, np.int64) for _ in self.levels]
            low, high = np.minimum.reduceat(low, first), np.maximum.reduceat(high, first)
            out.append(np.where(low == high, low, -1))
        return out


def spanning_links(key: np.ndarray, fp: np.ndarray, k: int, head: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest of the links within each key, between the known classes ``head`` (default: each fingerprint is
    its own); entries in any order."""
    order = np.lexsort((gray_rank(fp), key))
    key, fp, head = key[order], fp[order], (fp if head is None else head)[order]
    heads, first, of = np.unique(head, return_index=True, return_inverse=True)
    parent = first[of]
    if len(fp):
        GrayIndex(key, fp).link(parent, k)
    other = np.flatnonzero(parent[first] != first)
    return heads[other], head[parent[first[other]]]


def _links(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by group; a group is complete when the next begins."""

        def flush() -> pa.RecordBatch:
            key, fp, head = (np.concatenate(x) for x in zip(*held, strict=True))
            a, b = spanning_links(key, fp.view(np.uint64), k, head)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        held, rows = [], 0
        for batch in batches:
            part = tuple(batch.column(c).to_numpy() for c in ("grp", "fp", "head"))
            group = part[0]
            begins = np.flatnonzero(np.r_[not held or group[0] != held[-1][0][-1], group[1:] != group[:-1]]) if len(group) else []
            if rows > 4 * LARGE and len(begins):
                held.append(tuple(x[: begins[0]] for x in part))
                yield flush()
                part, held, rows = tuple(x[begins[0] :] for x in part), [], 0
            if len(part[0]):
                held.append(part)
                rows += len(part[0])
        if rows:
            yield flush()

    return run


def near_edges(known: DataFrame, keys: list[Column], k: int) -> DataFrame:
    """Edges (a, b) between classes of ``known(fp, head)``, enough to connect all whose fingerprints are at most ``k``
    bits apart and share one of ``keys``."""
    rank = F.col("fp")
    for shift in (1, 2, 4, 8, 16, 32):
        rank = rank.bitwiseXOR(F.shiftrightunsigned(rank, shift))
    entries = known.select("fp", "head", F.explode(F.array(*keys)).alias("key")).select("fp", "head", F.xxhash64("key.tab", "key.bits").alias("grp"))
    large = cut(entries.groupBy("grp").agg(F.count("*").alias("n")).where(F.col("n") > LARGE))
    plain, hot = entries, None
    if not large.isEmpty():
        # Gray runs of a large key: cut points by approximate quantiles of the rank, so no task sorts a whole key.
        sized = entries.join(large, "grp")
        placed = sized.withColumn("rank", rank.bitwiseXOR(F.lit(-(2**63))))
        cuts = placed.groupBy("grp").agg(F.max("n").alias("n"), F.percentile_approx("rank", [i / 256 for i in range(1, 256)], 20000).alias("cuts"))
        cuts = cuts.withColumn("step", F.greatest(F.lit(1), F.floor(F.lit(256) / F.ceil(F.col("n") / F.lit(LARGE / 2)))).cast("int"))
        cuts = cuts.select("grp", F.filter("cuts", lambda c, i: (i + 1) % F.col("step") == 0).alias("cuts"))
        placed = cut(placed.join(F.broadcast(cuts), "grp").select("grp", "fp", "head", F.size(F.filter("cuts", lambda c: F.col("rank") > c)).alias("run")))
        all_bits, any_bits = F.expr("bit_and(fp)"), F.expr("bit_or(fp)")
        nodes = placed.groupBy("grp", "run").agg(all_bits.alias("both"), any_bits.alias("any"))
        nodes = cut(nodes.select("grp", "run", F.bitwise_not(F.col("both").bitwiseXOR(F.col("any"))).alias("mask"), F.col("both").alias("pattern")))
        l, r = nodes.alias("l"), nodes.alias("r")
        shared = F.col("l.mask").bitwiseAND(F.col("r.mask"))
        pairs = l.join(r, (F.col("l.grp") == F.col("r.grp")) & (F.col("l.run") <= F.col("r.run")))
        pairs = pairs.where(F.bit_count(F.col("l.pattern").bitwiseXOR(F.col("r.pattern")).bitwiseAND(shared)) <= k)
        pairs = pairs.select(F.col("l.grp").alias("grp"), F.col("l.run").alias("lo"), F.col("r.run").alias("hi"))
        members = pairs.select("grp", F.explode(F.array_distinct(F.array("lo", "hi"))).alias("run"), F.xxhash64("grp", "lo", "hi").alias("pair"))
        hot = placed.join(members, ["grp", "run"]).select("fp", "head", F.col("pair").alias("grp"))
        plain = entries.join(large, "grp", "left_anti")
    links = _links(k)
    parts = [plain, *([hot] if hot is not None else [])]
    out = [p.select("grp", "fp", "head").repartition("grp").sortWithinPartitions("grp").mapInArrow(links, "a long, b long") for p in parts]
    return out[0] if len(out) == 1 else out[0].unionByName(out[1])


def components(edges: DataFrame, rounds: int = 64) -> DataFrame:
    """``edges(a, b)`` -> node, head (smallest node of its component) by alternating large-star and small-star steps;
    each round is cut into the shared folder and ends when the edges no longer change."""

    def summed(df: DataFrame) -> tuple:
        return df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    edges = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = summed(edges)
    for _ in range(rounds):
        if not before[0]:
            break
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        heads = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(heads, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        heads = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(heads, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(heads.select("a", F.col("m").alias("b")))
        edges = cut(small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
        after = summed(edges)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components have not settled after {rounds} rounds")
    return edges.groupBy("a").agg(F.min("b").alias("head")).withColumnRenamed("a", "node")


def components_at_once(edges: DataFrame) -> DataFrame:
    """``components``, without rounds where the driver can hold the edges: a round's many small files take more disk than
    so few rows."""
    edges = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    if edges.count() > BROADCAST_ROWS:
        return components(edges)
    found = edges.toArrow()
    a, b = (found.column(c).to_numpy() for c in ("a", "b"))
    nodes, of = np.unique(np.concatenate([a, b]), return_inverse=True)
    parent = np.arange(len(nodes))
    _union(parent, of[: len(a)], of[len(a) :])
    other = np.flatnonzero(parent != np.arange(len(nodes)))
    return edges.sparkSession.createDataFrame(pa.table({"node": pa.array(nodes[other], pa.int64()), "head": pa.array(nodes[parent[other]], pa.int64())}))


def near_classes(distinct: DataFrame, n: int, k: int, settle: Callable[[DataFrame], DataFrame] = components) -> DataFrame:
    """``distinct(fp)`` of ``n`` rows -> fp, head (one fingerprint of the class); ``settle`` gives the classes of edges."""
    known = distinct.select("fp", F.col("fp").alias("head"))
    for keys in waves(routing_keys(blocks_for(n, k), k)):
        found = cut(settle(near_edges(known, keys, k))).withColumnRenamed("head", "joined")
        known = cut(known.join(found, known["head"] == found["node"], "left").select("fp", F.coalesce("joined", "head").alias("head")))
    return known


def classes(docs: DataFrame, words_per_shingle: int = 5, k: int = 4) -> DataFrame:
    """``docs(doc_id, text, ...)`` -> doc_id, fp, component_id (smallest doc_id of the class)."""
    prints = cut(fingerprints(docs, words_per_shingle))
    distinct = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    named = distinct.join(near_classes(distinct.select("fp"), distinct.count(), k), "fp")
    least = named.groupBy("head").agg(F.min("first_id").alias("component_id"))
    names = cut(named.join(least, "head").select("fp", "component_id"))
    return prints.join(names, "fp").select("doc_id", "fp", "component_id")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = classes(table(spark, sf_dir, "documents"), words_per_shingle=4, k=4)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


QUERIES = {"op6_simhash": op6_simhash}
SQL: dict[str, str] = {}
