"""Near-duplicate classes by exact shingle similarity (Jaccard of distinct word shingles, 4/5 or more).

1. Equal texts (lower case, single spaces) share one node.
2. SimHash classes (``simhash.near_classes``, fingerprints at most NEAR_BITS apart) propose links: each member to one text
   of its class. Only those whose whole shingle sets have the similarity are links.
3. What fingerprints miss is found by a prefix filter: in one fixed order of all shingles, two sets of similarity 4/5 or
   more share a shingle within the first ``n - ceil(4n/5) + 1`` of each. So these are the keys, and no such pair is missed.
   Shingles that a sample finds often come last in the order; this saves candidates and never changes results.
4. Each text of a key is first compared with a few of its key (stars), so that dense groups of near copies cost one link a
   member. Then all pairs of a key that are not yet in one class are candidates, if sizes and places allow 4/5 at all.
   In keys of many texts, sketches of all keys of both texts must allow it too, and one key stands for a pair where it can
   (as in MinHash), so that a large group costs a few rows for each pair that is compared, not one for each key and pair.
5. Candidates that share too few keys for 4/5 fall away: beyond the prefixes, no more can be shared than the larger rest.
   Of the others, one is a link only if the whole sets have the similarity. Classes are the components of the links.

Defined results: a text of fewer words than a shingle has one shingle, the whole text; null and wordless texts have none
and are near only to each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausegraph.llm.runtime import cut, small, stage
from clausegraph.llm.simhash import SEED, components_at_once, fingerprints, near_classes

#: Texts whose node is divisible by SAMPLE are the sample; a shingle of OFTEN of them comes last in the order.
SAMPLE, OFTEN, MOST_OFTEN = 20, 5, 500_000
#: Differing bits up to which fingerprints propose a link.
NEAR_BITS = 6
#: Texts of a key with which the first pass compares the others: those of the highest degree.
STARS = 4
#: Keys of MANY texts are large: their rows bring a sketch of all keys of the text (64 * SKETCH bits) and the smallest large
#: key of each of LEAST parts of the keys. A pair of large keys counts ALL times.
MANY, SKETCH, LEAST, ALL = 16, 8, 4, 1 << 30
#: Rows of an Arrow batch that a task hands on; rows that a task gathers before it looks at complete groups.
ROWS, HELD = 1 << 19, 1 << 17


def line_of(text: str | None) -> bytes:
    return b" ".join((text or "").encode().lower().split())


def shingles(text: str | None, words_per_shingle: int) -> np.ndarray:
    """Distinct shingle hashes of a whole text, ascending."""
    return shingles_of(line_of(text), words_per_shingle)


def shingles_of(line: bytes, words_per_shingle: int) -> np.ndarray:
    if not line:
        return np.zeros(0, np.uint64)
    words = line.split(b" ")
    if len(words) <= words_per_shingle:
        return np.array([xxhash.xxh64_intdigest(line, SEED)], np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(sizes) - 1
    starts = (ends - sizes + 1)[: 1 - words_per_shingle or None].tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(line[a:b], SEED) for a, b in zip(starts, ends[words_per_shingle - 1 :].tolist(), strict=True)], np.uint64))


def near(total: np.ndarray, common: np.ndarray) -> np.ndarray:
    """Whether sets of ``total`` elements together (each counted) with ``common`` shared ones have 4/5 or more."""
    return 9 * common >= 4 * total


def with_nodes(docs: DataFrame) -> DataFrame:
    """``docs`` and two columns: node (hash of the text) and row (number of the row)."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node = [xxhash.xxh3_64_intdigest(line_of(t.as_py())) - (1 << 63) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(node, pa.int64())], names=[*names, "node"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{schema}, node long").withColumn("row", F.monotonically_increasing_id())


def _sampled(words_per_shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column("text"):
                yield pa.RecordBatch.from_arrays([pa.array(shingles(text.as_py(), words_per_shingle).view(np.int64))], names=["key"])

    return run


def _prefixes(often, words_per_shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        late, held, rows = often.value, [], 0
        for batch in batches:
            for text, node in zip(batch.column("text"), batch.column("node").to_pylist(), strict=True):
                keys = shingles(text.as_py(), words_per_shingle)
                n = len(keys)
                if not n:
                    continue
                soon = n
                if len(late):
                    last = late[np.minimum(np.searchsorted(late, keys), len(late) - 1)] == keys
                    keys, soon = np.concatenate([keys[~last], keys[last]]), n - int(last.sum())
                keys = keys[: n + 4 * -n // 5 + 1]
                end = int(keys[-1]) >> 2 | (len(keys) > soon) << 62  # in the order of all shingles
                held.append((keys, np.full(len(keys), node), np.full(len(keys), n, np.int32), np.arange(len(keys), dtype=np.int32), np.full(len(keys), end)))
                rows += len(keys)
                if rows > ROWS:
                    yield _batch(held)
                    held, rows = [], 0
        if rows:
            yield _batch(held)

    return run


def _batch(held: list) -> pa.RecordBatch:
    key, *rest = (np.concatenate(x) for x in zip(*held, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), *map(pa.array, rest)], names=["key", "node", "size", "place", "end"])


def _whole_groups(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[list[np.ndarray]]:
    """Arrays of rows that are sorted by key, cut only between keys."""
    held, rows = [], 0
    for batch in batches:
        held.append([batch.column(c).to_numpy() for c in names])
        rows += batch.num_rows
        if rows > HELD:
            part = [np.concatenate(x) for x in zip(*held, strict=True)]
            end = int(np.searchsorted(part[0], part[0][-1]))
            if end:
                yield [x[:end] for x in part]
            held = [[x[end:] for x in part]]
            rows = 0
    if held:
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


def _common(a: np.ndarray, b: np.ndarray, size: np.ndarray, most: np.ndarray, sketch: list[np.ndarray]) -> np.ndarray:
    """Whether sets can have 4/5 by the keys that they share: each key turns one bit of its text's sketch over, so no more
    bits differ than keys are in one text only."""
    rest = -(4 * -size.astype(np.int64) // 5) - 1
    shared = ((most - rest)[a] + (most - rest)[b] - sum(np.bitwise_count((x[a] ^ x[b]).view(np.uint64)).astype(np.int64) for x in sketch)) // 2
    return near(size[a].astype(np.int64) + size[b], shared + np.maximum(rest[a], rest[b]))


def _elsewhere(a: np.ndarray, b: np.ndarray, key: np.ndarray, least: list[np.ndarray]) -> np.ndarray:
    """Whether another large key stands for the pair: of the smallest ones that are the same, the smallest does. If none is,
    every common key stands for it."""
    same = np.full(len(a), NONE)
    for x in least:
        same = np.minimum(same, np.where(x[a] == x[b], x[a], NONE))
    return (same != NONE) & (same != key[a])


def _possible(a: np.ndarray, b: np.ndarray, size: np.ndarray, place: np.ndarray, end: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Whether sets that share the shingle at these places can have 4/5: by sizes, by what is left on both sides, by
    ``most`` of the set whose prefix ends first (all that its prefix shares is in both prefixes), and by how many keys of
    each any other text has, as near texts share more of them than the larger rest can make up for."""
    size, place = size.astype(np.int64), place.astype(np.int64)
    left = np.minimum(place[a], place[b]) + 1 + np.minimum(size[a] - place[a], size[b] - place[b]) - 1
    first = np.where(end[a] < end[b], most[a], np.where(end[b] < end[a], most[b], np.maximum(most[a], most[b])))
    rest = -(4 * -size // 5) - 1  # what no prefix holds
    shared = np.minimum((most - rest)[a], (most - rest)[b])
    return near(size[a] + size[b], np.minimum(np.minimum(left, first), shared + np.maximum(rest[a], rest[b])))


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of keys of two texts or more, with the number of their key's texts."""
    for key, node, size, place, end in _whole_groups(batches, ["key", "node", "size", "place", "end"]):
        fresh = np.r_[True, key[1:] != key[:-1]] if len(key) else np.zeros(0, bool)
        group = np.cumsum(fresh) - 1
        texts = np.bincount(group)[group] if len(key) else np.zeros(0, np.int64)
        many = texts > 1
        yield pa.RecordBatch.from_arrays([pa.array(x[many]) for x in (key, node, size, place, end, texts)], names=["key", "node", "size", "place", "end", "texts"])


def _counted(held: list[list[np.ndarray]]) -> pa.RecordBatch:
    """Different pairs (a, b) with their sizes, and how often each was met; a fifth column has how often a row counts."""
    a, b, size_a, size_b, *times = (np.concatenate(x) for x in zip(*held, strict=True))
    order = np.lexsort((b, a))
    a, b, size_a, size_b, *times = (x[order] for x in (a, b, size_a, size_b, *times))
    first = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
    n = np.add.reduceat(times[0], first) if times else np.diff(np.r_[first, len(a)])
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (a[first], b[first], size_a[first], size_b[first], n)], names=["a", "b", "size_a", "size_b", "n"])


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of each text of a key and the key's STARS texts of the highest degree, if they can be near."""
    for key, node, size, place, end, head, degree, most in _whole_groups(batches, ["key", "node", "size", "place", "end", "head", "degree", "most"]):
        if not len(key):
            continue
        order = np.lexsort((node, -degree, key))
        key, node, size, place, end, head, most = (x[order] for x in (key, node, size, place, end, head, most))
        fresh = np.r_[True, key[1:] != key[:-1]]
        first, at = np.flatnonzero(fresh), np.arange(len(key))
        group = np.cumsum(fresh) - 1
        held = []
        for number in range(STARS):
            b = np.minimum(first[group] + number, len(key) - 1)
            a, b = at[at > b], b[at > b]
            keep = (group[a] == group[b]) & (head[a] != head[b])
            a, b = a[keep], b[keep]
            keep = _possible(a, b, size, place, end, most)
            a, b = a[keep], b[keep]
            swap = node[a] < node[b]
            a, b = np.where(swap, b, a), np.where(swap, a, b)
            held.append([node[a], node[b], size[a], size[b]])
        if sum(len(x[0]) for x in held):
            yield _counted(held)


def _rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Possible pairs of a key between different classes, a > b; in order of size, so that a text meets only those of a
    size that allows 4/5. Large keys give a pair once where they can, if sketches allow it; it is then compared whole."""
    for key, node, size, place, end, head, most, texts, *more in _whole_groups(batches, ["key", "node", "size", "place", "end", "head", "most", "texts", *SKETCHES, *LEASTS]):
        fresh = np.r_[True, key[1:] != key[:-1]] if len(key) else np.zeros(0, bool)
        first = np.flatnonzero(fresh)
        if not len(first):
            continue
        mixed = np.minimum.reduceat(head, first) != np.maximum.reduceat(head, first)
        mixed = mixed[np.cumsum(fresh) - 1]
        order = np.flatnonzero(mixed)
        order = order[np.lexsort((size[order], key[order]))]
        key, node, size, place, end, head, most, texts, *more = (x[order] for x in (key, node, size, place, end, head, most, texts, *more))
        sketch, least = more[:SKETCH], more[SKETCH:]
        at, away, held, rows = np.arange(len(key)), 1, [], 0
        while len(at := at[at + away < len(key)]) and len(at := at[(key[at + away] == key[at]) & (4 * size[at + away].astype(np.int64) <= 5 * size[at].astype(np.int64))]):
            a, b = at, at + away
            away += 1
            keep = head[a] != head[b]
            a, b = a[keep], b[keep]
            keep = _possible(a, b, size, place, end, most)
            a, b = a[keep], b[keep]
            keep = _common(a, b, size, most, sketch)
            a, b = a[keep], b[keep]
            keep = ~_elsewhere(a, b, key, least)
            a, b = a[keep], b[keep]
            swap = node[a] < node[b]
            a, b = np.where(swap, b, a), np.where(swap, a, b)
            held.append([node[a], node[b], size[a], size[b], np.where(texts[a] >= MANY, ALL, 1)])
            rows += len(a)
            if rows > ROWS:
                yield _counted(held)
                held, rows = [], 0
        if rows:
            yield _counted(held)


SKETCHES, LEASTS = [f"s{i}" for i in range(SKETCH)], [f"k{i}" for i in range(LEAST)]
NONE = np.iinfo(np.int64).max


def _sketch() -> list[Column]:
    """Aggregates: SKETCH longs, of which a key turns one bit over, and the smallest large key of each part."""
    at, zero = F.xxhash64("key"), F.lit(0).cast("long")
    word, bit = F.shiftrightunsigned(at, 6).bitwiseAND(SKETCH - 1), at.bitwiseAND(63).cast("int")
    bits = [F.bit_xor(F.when(word == i, F.call_function("shiftleft", F.lit(1).cast("long"), bit)).otherwise(zero)) for i in range(SKETCH)]
    part = F.pmod(F.shiftrightunsigned(at, 32), F.lit(LEAST))
    least = [F.coalesce(F.min(F.when((part == i) & (F.col("texts") >= MANY), F.col("key"))), F.lit(int(NONE))) for i in range(LEAST)]
    return [c.alias(n) for c, n in zip([*bits, *least], [*SKETCHES, *LEASTS], strict=True)]


def _prefix(size: Column) -> Column:
    return size - F.ceil(size * 4 / 5) + 1


def _lack(size_a: Column, size_b: Column) -> Column:
    """Keys that two sets of these sizes share at least, if they have 4/5: all they must share, less the larger rest."""
    return F.ceil((size_a + size_b) * 4 / 9) - F.greatest(size_a - _prefix(size_a), size_b - _prefix(size_b))


def _enough(pairs: DataFrame, times: int) -> DataFrame:
    """Pairs whose keys in common, counted ``times`` times, are as many as near texts share at least."""
    summed = pairs.groupBy("a", "b", "size_a", "size_b").agg(F.sum("n").alias("n"))
    return summed.where(times * F.col("n") >= _lack(F.col("size_a"), F.col("size_b"))).select("a", "b")


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    press = zstandard.ZstdCompressor(level=3).compress
    for batch in batches:
        lines = [press(line_of(t.as_py())) for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(lines, pa.binary())], names=["node", "line"])


def _verified(words_per_shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come in order of b: its set is made once."""
        whole = zstandard.ZstdDecompressor().decompress
        last, of_last = None, np.zeros(0, np.uint64)
        for batch in batches:
            keep = []
            for x, b, y in zip(batch.column("x"), batch.column("b").to_pylist(), batch.column("y"), strict=True):
                if b != last:
                    last, of_last = b, shingles_of(whole(y.as_py()), words_per_shingle)
                own = shingles_of(whole(x.as_py()), words_per_shingle)
                keep.append(bool(near(len(own) + len(of_last), len(np.intersect1d(own, of_last, assume_unique=True)))))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def verified(pairs: DataFrame, texts: DataFrame, words_per_shingle: int) -> DataFrame:
    """The pairs ``(a, b)`` whose whole shingle sets have a similarity of 4/5 or more. Whole texts travel compressed: they
    are smaller than their sets of hashes."""
    nodes = cut(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    chosen = texts.join(small(nodes, nodes.count()), "node", "left_semi").select("node", "text")
    lines = stage(chosen.mapInArrow(_packed, "node long, line binary"), "none")
    x, y = (lines.select(F.col("node").alias(side), F.col("line").alias(to)) for side, to in (("a", "x"), ("b", "y")))
    met = pairs.select("a", "b").join(x, "a").join(y, "b").sortWithinPartitions("b")
    return cut(met.select("a", "b", "x", "y").mapInArrow(_verified(words_per_shingle), "a long, b long"))


def proposals(texts: DataFrame, words_per_shingle: int) -> DataFrame:
    """Links (a, b) from each text to one text of its SimHash class."""
    prints = cut(fingerprints(texts.select(F.col("node").alias("doc_id"), "text"), words_per_shingle))
    distinct = cut(prints.select("fp").distinct())
    classed = cut(prints.join(near_classes(distinct, distinct.count(), NEAR_BITS, components_at_once), "fp").select(F.col("doc_id").alias("a"), "head"))
    first = classed.groupBy("head").agg(F.min("a").alias("b"), F.count("*").alias("n")).where("n > 1")
    return cut(classed.join(first, "head").where("a <> b").select("a", "b"))


def links(texts: DataFrame, words_per_shingle: int = 5) -> DataFrame:
    """``texts(node, text)``, one row a node -> links (a, b) that connect all pairs of a similarity of 4/5 or more."""
    spark = texts.sparkSession
    tested = proposals(texts, words_per_shingle)
    found = verified(tested, texts, words_per_shingle)
    sample = texts.where(F.col("node") % SAMPLE == 0).select("text").mapInArrow(_sampled(words_per_shingle), "key long")
    often = sample.groupBy("key").count().where(F.col("count") >= OFTEN).orderBy(F.desc("count"), "key").limit(MOST_OFTEN).select("key").toArrow()
    late = spark.sparkContext.broadcast(np.sort(often.column("key").to_numpy().astype(np.int64).view(np.uint64)))
    keys = texts.select("node", "text").mapInArrow(_prefixes(late, words_per_shingle), "key long, node long, size int, place int, end long")
    shared = stage(keys.repartition("key").sortWithinPartitions("key").mapInArrow(_shared, "key long, node long, size int, place int, end long, texts long"))
    pairs = "a long, b long, size_a int, size_b int, n long"
    # Keys that no other prefix has cannot be shared with a text whose prefix ends later: ``most`` is what is left.
    # A text whose keys many others have is the likely source of its copies, and so a star. Pairs with it are tested if
    # it is the star of half the keys that near texts share; other pairs are left to the last step.
    own = shared.groupBy("node").agg(F.sum("texts").alias("degree"), F.first("size").alias("size"), F.count("*").alias("n"), *_sketch())
    own = own.withColumn("most", F.col("size") - _prefix(F.col("size")) + F.col("n")).select("node", "degree", "most", *SKETCHES, *LEASTS)
    own = cut(own.join(found.select(F.col("a").alias("node"), F.col("b").alias("head")), "node", "left").withColumn("head", F.coalesce("head", "node")))
    stars = shared.join(own, "node").select("key", "node", "size", "place", "end", "head", "degree", "most").repartition("key").sortWithinPartitions("key").mapInArrow(_stars, pairs)
    tested = tested.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    stars = cut(_enough(stars, 2).join(tested, ["a", "b"], "left_anti"))
    found, tested = found.unionByName(verified(stars, texts, words_per_shingle)), tested.unionByName(stars)
    known = cut(components_at_once(found)).withColumnRenamed("node", "member")
    own = cut(own.drop("head").join(known, own["node"] == known["member"], "left").select("node", "most", F.coalesce("head", "node").alias("head"), *SKETCHES, *LEASTS))
    # A small key makes few pairs, and the same number in all rows is small.
    large = [F.when(F.col("texts") >= MANY, F.col(c)).otherwise(F.lit(int(NONE))).alias(c) for c in [*SKETCHES, *LEASTS]]
    classed = shared.join(own, "node").select("key", "node", "size", "place", "end", "head", "most", "texts", *large)
    rest = classed.repartition("key").sortWithinPartitions("key").mapInArrow(_rest, pairs)
    rest = cut(_enough(rest, 1).join(tested, ["a", "b"], "left_anti"))
    return found.unionByName(verified(rest, texts, words_per_shingle))


def classes(rows: DataFrame, words_per_shingle: int = 5) -> DataFrame:
    """``rows(node, row, text)`` -> node, head (one node of its class), for nodes that are near others only."""
    ones = rows.groupBy("node").agg(F.min("row").alias("one"))
    again = cut(rows.select("node", "row").join(ones, "node").where("row <> one").select("row"))
    texts = rows.join(small(again, again.count()), "row", "left_anti").select("node", "text")
    return components_at_once(links(texts, words_per_shingle))
