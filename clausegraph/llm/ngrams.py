"""Language-model scoring with an Elias-Fano n-gram trie.

Model: order 3 with Dirichlet smoothing. p1(w) = (c(w)+1)/(N+V+1); p2(w|u) = (c(uw) + M2 p1(w)) / (c(u) + M2);
p3(w|tu) = (c(tuw) + M3 p2(w|u)) / (c(tu) + M3). Counts come from all training texts, with no cut-off.

Trie: three levels of words. A level is an Elias-Fano sequence of successors, written relative to their context (rank
of the word in the trie's vocabulary plus context number times vocabulary size, so the sequence is monotone); monotone
pointers, Elias-Fano too, lead from a context to its successors. Level 2 holds quantised log frequencies, level 3
quantised smoothed shares c(tuw) / (c(tu) + M3). A trie is one byte string, read through a memory map; a search finds
the successors that share a key's high bits by two selects and compares low bits within the pointers' range.

Distribution: texts become blocks of about BLOCK tokens with block-local word numbers, written once. A block sends to
each shard of the trie (by a hash of the first two words, so that a frequent word spreads over many shards) its
different n-grams with their training counts: one row per block and shard. The shard's task sums the counts, builds its
trie, looks all n-grams it was sent up in it, and sends the codes back in the same order; a block's task puts scores
together. No word list, trie or count is gathered on the driver or broadcast, and both shuffles hold each n-gram of a
block once, however often it occurs.

Defined results: null text is empty: one token, the end. A null doc_id counts as the empty text in the fold rule.
Repeated rows keep a row each and count each. Without training texts, N and V are 0. Extra columns are ignored.
"""

from __future__ import annotations

import mmap
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausegraph.llm.runtime import crc_of, stage, table, trim

FOLDS, HELD = 7, 2
M2, M3 = 2000.0, 2.0
BLOCK, SHARD = 2_400_000, 1_500_000
#: Steps of the quantised logarithms: 1 / 4096 of a decimal order.
SCALE = 4096.0
#: Local word numbers with a fixed meaning, by a byte string that no word can be.
MARKS = (b"\n", b"\r", b"\t")
END, BEGIN, PAD = 0, 1, 2
ID_BITS = 40


# ---------------------------------------------------------------------------------------------------- Elias-Fano


#: Place of the i-th one in each byte.
_SELECT = np.array([[*[b for b in range(8) if byte >> b & 1], *[0] * 8][:8] for byte in range(256)])


class EliasFano:
    """A monotone sequence of numbers in two bit arrays: low bits side by side, high bits in unary."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, ones: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.ones = n, low_bits, low, high, ones

    @staticmethod
    def pack(values: np.ndarray, universe: int) -> list[np.ndarray]:
        values = values.astype(np.uint64)
        n = len(values)
        low_bits = max(0, int(np.log2(max(universe, 1) / n))) if n else 0
        low = np.zeros(8, np.uint8)
        if low_bits and n:
            bits = np.empty((n, low_bits), np.uint8)
            for b in range(low_bits):
                bits[:, b] = values >> np.uint64(b) & np.uint64(1)
            low = np.r_[np.packbits(bits.ravel(), bitorder="little"), low]
        top = (values >> np.uint64(low_bits)).astype(np.int64)
        size = n + (int(top[-1]) if n else 0) + 2
        unary = np.zeros(-(-size // 64) * 64, np.uint8)
        unary[top + np.arange(n)] = 1
        high = np.packbits(unary, bitorder="little")
        ones = np.r_[0, np.cumsum(unary.reshape(-1, 64).sum(1, dtype=np.int64))]
        return [np.array([n, low_bits], np.int64), low, high, ones.astype(np.uint32)]

    @classmethod
    def open(cls, parts: list[np.ndarray]) -> EliasFano:
        head, low, high, ones = parts
        return cls(int(head[0]), int(head[1]), low, high.reshape(-1, 8), ones)

    def _select(self, k: np.ndarray, bit: int) -> np.ndarray:
        """Position of the k-th (from 0) one or zero; the end of the bits if there are fewer."""
        words = len(self.high)
        before = self.ones.astype(np.int64) if bit else np.arange(words + 1) * 64 - self.ones
        word = np.searchsorted(before, k, "right") - 1
        out = np.full(len(k), words * 64)
        for at in range(0, len(k), 1 << 16):
            w = word[at : at + (1 << 16)]
            inside = np.flatnonzero((w < words) & (k[at : at + (1 << 16)] >= 0))
            bits = self.high[w[inside]] if bit else ~self.high[w[inside]]
            rank = k[at : at + (1 << 16)][inside] - before[w[inside]]
            each = np.bitwise_count(bits)
            upto = np.cumsum(each, axis=1, dtype=np.uint8)
            byte = (upto > rank[:, None]).argmax(1)
            row = np.arange(len(byte))
            left = rank - (upto[row, byte] - each[row, byte])
            out[at + inside] = w[inside] * 64 + byte * 8 + _SELECT[bits[row, byte], left]
        return out

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), np.uint64)
        at = i * self.low_bits
        words = self.low[(at >> 3)[:, None] + np.arange(8)].view("<u8").ravel()
        return (words >> (at & 7).astype(np.uint64)) & np.uint64((1 << self.low_bits) - 1)

    def get(self, i: np.ndarray) -> np.ndarray:
        return ((self._select(i, 1) - i).astype(np.uint64) << np.uint64(self.low_bits)) | self._low(i)

    def find(self, x: np.ndarray, lo: np.ndarray | None = None, hi: np.ndarray | None = None) -> np.ndarray:
        """Position of each x (within [lo, hi), if given), or -1: successor search among equal high bits."""
        x = x.astype(np.uint64)
        top = (x >> np.uint64(self.low_bits)).astype(np.int64)
        begin = np.where(top > 0, self._select(np.maximum(top - 1, 0), 0) - (top - 1), 0)
        end = np.minimum(self._select(top, 0) - top, self.n)
        begin = np.minimum(begin, self.n)
        if lo is not None:
            begin, end = np.maximum(begin, lo), np.minimum(end, hi)
        want = x & np.uint64((1 << self.low_bits) - 1)
        out = np.full(len(x), -1, np.int64)
        open_ = np.flatnonzero(begin < end)
        while len(open_):  # halve what is left of each range
            mid = (begin[open_] + end[open_]) // 2
            low = self._low(mid)
            hit = low == want[open_]
            out[open_[hit]] = mid[hit]
            less = low < want[open_]
            begin[open_] = np.where(less, mid + 1, begin[open_])
            end[open_] = np.where(less, end[open_], mid)
            open_ = open_[~hit & (begin[open_] < end[open_])]
        return out


def _join(arrays: list[np.ndarray]) -> bytes:
    """Arrays one after another, each behind its type and length, on multiples of eight bytes."""
    out = [np.array([len(arrays)], np.int64).tobytes()]
    for a in arrays:
        data = a.tobytes()
        out += [a.dtype.str.encode().ljust(8), np.array([len(a)], np.int64).tobytes(), data, b"\0" * (-len(data) % 8)]
    return b"".join(out)


def _split(buffer) -> list[np.ndarray]:
    out, at = [], 8
    for _ in range(int(np.frombuffer(buffer, np.int64, 1)[0])):
        kind, size = np.dtype(bytes(buffer[at : at + 8]).decode().strip()), int(np.frombuffer(buffer, np.int64, 1, at + 8)[0])
        out.append(np.frombuffer(buffer, kind, size, at + 16))
        at += 16 + size * kind.itemsize + -(size * kind.itemsize) % 8
    return out


def _planes(a: np.ndarray, kind: type = np.uint32) -> np.ndarray:
    """All first bytes, then all second ones and so on: numbers that are mostly small compress well so."""
    a = np.ascontiguousarray(a, kind)
    return np.ascontiguousarray(a.view(np.uint8).reshape(-1, a.itemsize).T).ravel()


def _whole(planes: np.ndarray, kind: type = np.uint32) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(planes.reshape(size, -1).T).view(kind).ravel()


def _press(arrays: list[np.ndarray]) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(_join(arrays))


def _unpress(data: bytes) -> list[np.ndarray]:
    return _split(zstandard.ZstdDecompressor().decompress(data))


# ---------------------------------------------------------------------------------------------------------- trie


class Trie:
    """One shard: paths of three words with quantised values, over a memory map."""

    @staticmethod
    def build(words: np.ndarray, u: np.ndarray, v: np.ndarray, w: np.ndarray, count: np.ndarray) -> bytes:
        """From different word ids below 2^ID_BITS, ascending, and different paths (as places in ``words``) in ascending
        order with their counts, all over 0."""
        size = max(len(words), 1)
        fresh1 = np.r_[True, u[1:] != u[:-1]] if len(u) else np.zeros(0, bool)
        fresh2 = fresh1 | np.r_[True, v[1:] != v[:-1]] if len(u) else fresh1
        first, at1 = u[fresh1], np.cumsum(fresh1) - 1
        starts = np.flatnonzero(fresh2)
        pair, at2 = at1[starts] * size + v[starts], np.cumsum(fresh2) - 1
        totals = np.add.reduceat(count, starts) if len(starts) else np.zeros(0, np.int64)
        share = count / (totals[at2] + M3) if len(count) else np.zeros(0)
        parts = [np.array([size], np.int64)]
        parts += EliasFano.pack(words, 1 << ID_BITS)
        parts += EliasFano.pack(first, size)
        parts += EliasFano.pack(np.searchsorted(pair, np.arange(len(first) + 1) * size), len(pair) + 1)
        parts += EliasFano.pack(pair, len(first) * size)
        parts += EliasFano.pack(np.r_[starts, len(u)], len(at2) + 1)
        parts += EliasFano.pack(at2 * size + w, len(pair) * size)
        parts += [np.rint(np.log10(np.maximum(totals, 1)) * SCALE).astype(np.uint16) + np.uint16(1), np.minimum(np.rint(-np.log10(share) * SCALE), 65534).astype(np.uint16) + np.uint16(1)]
        return _join(parts)

    def __init__(self, data: bytes):
        with tempfile.TemporaryFile() as file:  # has no name and is gone with the map
            file.write(data)
            file.flush()
            self.map = mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ)
        parts = _split(memoryview(self.map))
        self.size = int(parts[0][0])
        self.words, self.level1, self.to2, self.level2, self.to3, self.level3 = (EliasFano.open(parts[1 + 4 * i : 5 + 4 * i]) for i in range(6))
        self.frequency, self.share = parts[25:]

    def _successors(self, level: EliasFano, pointers: EliasFano, context: np.ndarray, rank: np.ndarray) -> np.ndarray:
        out = np.full(len(context), -1, np.int64)
        some = np.flatnonzero((context >= 0) & (rank >= 0))
        if len(some):
            contexts, back = np.unique(context[some], return_inverse=True)
            lo, hi = pointers.get(contexts).astype(np.int64)[back], pointers.get(contexts + 1).astype(np.int64)[back]
            out[some] = level.find(context[some] * self.size + rank[some], lo, hi)
        return out

    def look_up(self, words: np.ndarray, u: np.ndarray, v: np.ndarray, at: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the pairs (u, v) and of the triples (u[at], v[at], w), all as places in the word ids ``words``; 0 where
        there is no such path."""
        rank = self.words.find(words)
        one = np.where(rank >= 0, self.level1.find(np.maximum(rank, 0)), -1)
        two = self._successors(self.level2, self.to2, one[u], rank[v])
        three = self._successors(self.level3, self.to3, two[at], rank[w])
        pairs, triples = (np.where(p >= 0, codes[np.maximum(p, 0)] if len(codes) else 0, 0).astype(np.uint16) for p, codes in ((two, self.frequency), (three, self.share)))
        return pairs, triples


# --------------------------------------------------------------------------------------------------------- blocks


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


def _blocks(docs: DataFrame) -> DataFrame:
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, ids, held, sizes, tokens, total = _Numbers(), [], [], [], [], 0

        def start() -> None:
            nonlocal numbers, ids, held, sizes, tokens, total
            numbers, ids, held, sizes, tokens, total = _Numbers(), [], [], [], [], 0
            for mark in MARKS:
                numbers[mark]

        def emit() -> pa.RecordBatch:
            hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in numbers), np.uint64, len(numbers))
            row = [pa.array([ids], pa.list_(kind)), pa.array([held], pa.list_(pa.bool_())), pa.array([sizes], pa.list_(pa.int32())), pa.array([sum(s for s, h in zip(sizes, held, strict=True) if not h)], pa.int64()), pa.array([total], pa.int64()), pa.array([hashes.tobytes()]), pa.array([_press([_planes(np.concatenate(tokens))])])]
            return pa.RecordBatch.from_arrays(row, names=["ids", "held", "sizes", "train", "total", "words", "tokens"])

        start()
        for batch in batches:
            kind = batch.column("doc_id").type
            for doc_id, out, text in zip(batch.column("doc_id").to_pylist(), batch.column("held_out").to_pylist(), batch.column("text"), strict=True):
                own = [*map(numbers.__getitem__, (text.as_py() or "").encode().lower().split()), END]
                tokens.append(np.array(own, np.int32))
                ids.append(doc_id)
                held.append(out)
                sizes.append(len(own))
                total += len(own)
                if total >= BLOCK:
                    yield emit()
                    start()
        if total:
            yield emit()

    schema = f"ids array<{id_type}>, held array<boolean>, sizes array<int>, train long, total long, words binary, tokens binary"
    return stage(docs.mapInArrow(run, schema).withColumn("block", F.monotonically_increasing_id()))


def _numbered(a: np.ndarray, b: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Different numbers ``a * size + b``, ascending, and the place of each one's; holds few large arrays at a time."""
    both = a.astype(np.int64)
    both *= size
    both += b
    order = np.argsort(both)
    both = both[order]
    fresh = np.empty(len(both), bool)
    fresh[:1] = True
    np.not_equal(both[1:], both[:-1], out=fresh[1:])
    place = np.empty(len(both), np.int32)
    place[order] = np.cumsum(fresh, dtype=np.int32) - np.int32(1)
    return both[fresh], place


class Paths:
    """A block's n-grams: its different pairs and triples in shard order, and where each token's are."""

    def __init__(self, row: dict, shards: int):
        self.hash = np.frombuffer(row["words"], np.uint64)
        self.sizes, self.train = np.array(row["sizes"], np.int64), ~np.array(row["held"], bool)
        tokens = _whole(_unpress(row["tokens"])[0]).view(np.int32)
        docs, count = len(self.sizes), len(self.hash)
        ends = np.cumsum(self.sizes)
        self.tokens, self.doc = tokens, np.repeat(np.arange(docs, dtype=np.int32), self.sizes)
        self.start = np.zeros(len(tokens), bool)
        self.start[ends - self.sizes] = True
        self.before = np.where(self.start, np.int32(BEGIN), np.r_[tokens[:1], tokens[:-1]])
        pair, self.pair_of = _numbered(self.before, tokens, count)
        u, v = pair // count, pair % count
        self.short = short = self.hash & np.uint64((1 << ID_BITS) - 1)
        mixed = (short[u] ^ (short[v] & np.uint64(15)) * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xD6E8FEB86659FD93)
        shard = (mixed >> np.uint64(33)).astype(np.int64) % shards
        del pair, mixed
        order = np.argsort(shard, kind="stable")
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order), dtype=np.int32)
        self.pair_of, self.shard = place[self.pair_of], shard[order]
        self.u, self.v = u[order], v[order]
        del u, v, shard, order, place
        after = np.where(tokens == END, np.int32(PAD), np.r_[tokens[1:], tokens[:1]])
        triple, self.triple_of = _numbered(self.pair_of, after, count)
        self.at, self.w = triple // count, triple % count
        self.weight = self.train[self.doc]

    def requests(self, shards: int) -> Iterator[tuple[int, int, bytes]]:
        """(kind, shard, message): different words with exact hashes (kind 0), then n-grams (kind 1)."""
        counts = np.bincount(self.tokens[self.weight], minlength=len(self.hash))
        counts[BEGIN] = self.train.sum()
        counts[PAD] = 0
        owner = (self.hash >> np.uint64(40)).astype(np.int64) % shards
        for s in np.unique(owner):
            own = np.flatnonzero(owner == s)
            yield 0, int(s), _press([self.hash[own], _planes(counts[own])])
        counts = np.bincount(self.triple_of, self.weight, len(self.at)).astype(np.uint32)
        pair_edges = np.searchsorted(self.shard, np.arange(shards + 1))
        edges = np.searchsorted(self.at, pair_edges)
        for s in np.flatnonzero(np.diff(pair_edges)):
            p, t = slice(*pair_edges[s : s + 2]), slice(*edges[s : s + 2])
            u, v, w = self.u[p], self.v[p], self.w[t]
            words = np.unique(np.concatenate([u, v, w]))  # the message's own words; pairs come in order of u
            own = self.short[words]
            children = np.bincount(self.at[t] - pair_edges[s], minlength=len(u))
            numbers = [np.bincount(np.searchsorted(words, u), minlength=len(words)), np.searchsorted(words, v), children, np.searchsorted(words, w), counts[t]]
            yield 1, int(s), _press([own.astype(np.uint32), (own >> np.uint64(32)).astype(np.uint8), *map(_planes, numbers)])


def _requests(blocks: DataFrame, shards: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                kinds, owners, messages = zip(*Paths(row, shards).requests(shards), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array(owners, pa.int64()), pa.array([row["block"]] * len(kinds), pa.int64()), pa.array(messages, pa.binary())], names=["kind", "shard", "block", "message"])
                trim()

    return blocks.select("block", "held", "sizes", "words", "tokens").mapInArrow(run, "kind int, shard long, block long, message binary")


def _answer_words(messages: list[bytes]) -> tuple[int, list[bytes]]:
    parts = [(p[0], _whole(p[1])) for p in map(_unpress, messages)]
    hashes, back = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    counts = np.bincount(back, np.concatenate([p[1] for p in parts]), len(hashes)).astype(np.int64)
    begin = np.uint64(xxhash.xxh64_intdigest(MARKS[BEGIN]))
    different = int(((counts > 0) & (hashes != begin)).sum())
    cuts = np.cumsum([len(p[0]) for p in parts])[:-1]
    return different, [_press([_planes(c, np.int64)]) for c in np.split(counts[back], cuts)]


def _answer_paths(messages: list[bytes]) -> list[bytes]:
    parts, own, before = [], [], 0
    for message in messages:
        low, high, runs, v, children, w, counts = _unpress(message)
        own.append(low.astype(np.uint64) | high.astype(np.uint64) << np.uint64(32))
        runs, v, w = (_whole(x).astype(np.int64) for x in (runs, v, w))
        parts.append((np.repeat(np.arange(len(low)) + before, runs), v + before, _whole(children), w + before, _whole(counts)))
        before += len(low)
    u, v, children, w, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
    p_cuts, t_cuts = np.cumsum([len(p[0]) for p in parts])[:-1], np.cumsum([len(p[3]) for p in parts])[:-1]
    del parts
    words, place = np.unique(np.concatenate(own), return_inverse=True)  # each message names a word once
    del own
    size = len(words)
    pairs, pair_back = np.unique(place[u] * size + place[v], return_inverse=True)
    triples, back = np.unique(pair_back[np.repeat(np.arange(len(u)), children)] * size + place[w], return_inverse=True)
    del u, v, w, place
    summed = np.bincount(back, counts, len(triples)).astype(np.int64)
    pu, pv, t_at, t_w = pairs // size, pairs % size, triples // size, triples % size
    seen = summed > 0
    del triples, counts, pairs
    known = np.zeros(size, bool)
    for x in (pu[t_at[seen]], pv[t_at[seen]], t_w[seen]):
        known[x] = True
    rank = np.cumsum(known) - 1
    trie = Trie(Trie.build(words[known], rank[pu[t_at[seen]]], rank[pv[t_at[seen]]], rank[t_w[seen]], summed[seen]))
    pair_codes, triple_codes = trie.look_up(words, pu, pv, t_at, t_w)
    return [_press([_planes(a, np.uint16), _planes(b, np.uint16)]) for a, b in zip(np.split(pair_codes[pair_back], p_cuts), np.split(triple_codes[back], t_cuts), strict=True)]


def _answers(requests: DataFrame) -> DataFrame:
    def answer(key, blocks: list[int], messages: list[bytes]) -> pa.RecordBatch:
        kind, shard = key
        different, out = _answer_words(messages) if kind == 0 else (0, _answer_paths(messages))
        n = len(blocks)
        return pa.RecordBatch.from_arrays([pa.array([kind] * n, pa.int32()), pa.array([shard] * n, pa.int64()), pa.array(blocks, pa.int64()), pa.array([different] + [0] * (n - 1), pa.int64()), pa.array(out, pa.binary())], names=["kind", "shard", "block", "different", "message"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, blocks, messages = None, [], []
        for batch in batches:
            for kind, shard, block, message in zip(*(batch.column(c).to_pylist() for c in ("kind", "shard", "block")), batch.column("message"), strict=True):
                if (kind, shard) != key:
                    if blocks:
                        yield answer(key, blocks, messages)
                        trim()
                    key, blocks, messages = (kind, shard), [], []
                blocks.append(block)
                messages.append(message.as_py())  # only those of one shard are copied
        if blocks:
            yield answer(key, blocks, messages)

    sent = requests.repartition("kind", "shard").sortWithinPartitions("kind", "shard", "block")
    return stage(sent.mapInArrow(run, "kind int, shard long, block long, different long, message binary"))


def _scores(blocks: DataFrame, answers: DataFrame, shards: int, n: int, v: int) -> DataFrame:
    id_type = blocks.schema["ids"].dataType.elementType.simpleString()

    def scored(row: dict, messages: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
        paths = Paths(row, shards)
        known = np.zeros(len(paths.hash), np.int64)
        owner = (paths.hash >> np.uint64(40)).astype(np.int64) % shards
        edges = np.searchsorted(paths.shard, np.arange(shards + 1))
        t_edges = np.searchsorted(paths.at, edges)
        pairs, triples = np.zeros(len(paths.u), np.uint16), np.zeros(len(paths.at), np.uint16)
        for kind, shard, message in messages:
            got = _unpress(message)
            if kind == 0:
                known[owner == shard] = _whole(got[0], np.int64)
            else:
                pairs[edges[shard] : edges[shard + 1]], triples[t_edges[shard] : t_edges[shard + 1]] = (_whole(g, np.uint16) for g in got)
        tokens, before = paths.tokens, paths.before
        p1 = (known[tokens] + 1) / (n + v + 1)
        frequency = np.where(pairs > 0, 10 ** ((pairs - 1.0) / SCALE), 0.0)
        share = np.where(triples > 0, 10 ** -((triples - 1.0) / SCALE), 0.0)
        p2 = (frequency[paths.pair_of] + M2 * p1) / (known[before] + M2)
        # A token's triple is that of the pair before it; the first token of a text has none.
        earlier = np.r_[0, np.arange(len(tokens) - 1)]
        context = frequency[paths.pair_of[earlier]]
        p3 = share[paths.triple_of[earlier]] + M3 / (context + M3) * p2
        p = np.where(paths.start, p2, p3)
        docs = len(paths.sizes)
        add = lambda x: pa.array(np.bincount(paths.doc, x, docs))
        return pa.RecordBatch.from_arrays(
            [pa.array(row["ids"], kind_of[id_type]), pa.array(row["held"], pa.bool_()), pa.array(paths.sizes), pa.array(np.bincount(paths.doc, known[tokens] > 0, docs).astype(np.int64)), pa.array([n] * docs, pa.int64()), add(np.log10(p1)), add(np.log10(p))],
            names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, messages = None, []
        for batch in batches:
            for at in range(batch.num_rows):
                one = batch.slice(at, 1).to_pylist()[0]
                if one["kind"] < 0:
                    if row is not None:
                        yield scored(row, messages)
                        trim()
                    row, messages = one, []
                else:
                    messages.append((one["kind"], one["shard"], one["message"]))
        if row is not None:
            yield scored(row, messages)

    kind_of = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}
    heads = blocks.select("block", F.lit(-1).alias("kind"), "ids", "held", "sizes", "words", "tokens")
    both = heads.unionByName(answers.select("block", "kind", "shard", "message"), allowMissingColumns=True)
    met = both.repartition("block").sortWithinPartitions("block", "kind", "shard")
    return met.mapInArrow(run, f"doc_id {id_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def score_documents(documents: DataFrame) -> DataFrame:
    """Learn from all training documents and score all: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    docs = documents.select("doc_id", (crc_of("doc_id") % FOLDS == HELD).alias("held_out"), "text")
    blocks = _blocks(docs)
    train, total = blocks.agg(F.coalesce(F.sum("train"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0))).first()
    shards = max(1, -(-total // SHARD))
    answers = _answers(_requests(blocks, shards))
    different = answers.agg(F.coalesce(F.sum("different"), F.lit(0))).first()[0]
    return _scores(blocks, answers, shards, train, different)


def op7_ngram_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))


QUERIES = {"op7_ngram_scoring": op7_ngram_scoring}
SQL: dict[str, str] = {}
