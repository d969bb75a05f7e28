"""Token counts without ids: count the pieces of each distinct pre-token once and join them to the frequencies.

1. Texts are normalised and cut into pre-tokens exactly as the tokenizer does (its own normalizer; its split pattern
   and the strings of its special tokens are read from the file), once. Documents are gathered in blocks of about BLOCK
   pre-tokens, each with a list of its different pre-tokens and, per document, their numbers in that list.
2. A block sends to each shard (a hash range of about SHARD entries) its different pre-tokens in one compressed message.
   The shard's task counts each pre-token once with the tokenizer's merge model and answers messages one by one.
3. A block's answers come back to it, and the frequencies of its documents are summed with them. A block names a
   pre-token once, so none is hot; shards grow in number with the corpus, not in size; nothing is broadcast.

Defined results: null text counts as empty: 0 bytes, 0 tokens. Repeated rows (also of one doc_id) keep a row each. A
special token's string inside a text is one token, as the library's default has it. Extra columns are ignored.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausegraph.llm.runtime import held, stage, table

LIMIT = 2048
#: A block ends with so many pre-tokens, or so many different ones.
BLOCK, DIFFERENT = 2_000_000, 250_000
#: Entries of blocks' lists that a shard gets; different pre-tokens are at most as many.
SHARD = 250_000


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Cutter:
    """Pre-tokens of a text, and pieces of a pre-token, for a tokenizer file with a split pattern and a merge model."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.lib = Tokenizer.from_file(path)
        self.normalize = self.lib.normalizer.normalize_str if self.lib.normalizer else str
        steps = spec["pre_tokenizer"].get("pretokenizers", [spec["pre_tokenizer"]])
        split = next(s for s in steps if s["type"] == "Split")
        if not (split["behavior"] == "Removed" and split["invert"]):
            raise ValueError("only a pattern that keeps its matches is supported")
        self.pattern = regex.compile(split["pattern"]["Regex"])
        self.byte_level = self._byte_level()
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None

    @staticmethod
    def _byte_level():
        from tokenizers.pre_tokenizers import ByteLevel

        return ByteLevel(add_prefix_space=False, use_regex=False)

    def cut(self, text: str) -> tuple[int, list[str]]:
        """How many special tokens the text holds, and its pre-tokens."""
        if self.special and (found := self.special.findall(text)):
            rest = self.special.split(text)
            return len(found), [p for r in rest for p in self.pattern.findall(self.normalize(r))]
        return 0, self.pattern.findall(self.normalize(text))

    def pieces(self, pretoken: str) -> int:
        return sum(len(self.lib.model.tokenize(part)) for part, _ in self.byte_level.pre_tokenize_str(pretoken))


def cutter(path: str) -> Cutter:
    return held(("cutter", path), lambda: Cutter(path))


class _Numbers(dict):
    def __missing__(self, pretoken: str) -> int:
        n = self[pretoken] = len(self)
        return n


def _press(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(data)


def _unpress(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def _blocks(docs: DataFrame, path: str) -> DataFrame:
    """Per block: its different pre-tokens, and of each document id, bytes, special tokens, and pre-tokens by number."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, numbers, ids, rows, numbered = cutter(path), _Numbers(), [], [], array("i")

        def emit() -> pa.RecordBatch:
            n_bytes, special, lengths = zip(*rows, strict=True)
            # All first bytes, then all second ones and so on: numbers that are mostly small compress well so.
            planes = np.ascontiguousarray(np.frombuffer(numbered, np.uint8).reshape(-1, 4).T)
            packed, listed = _press(planes.tobytes()), _press(json.dumps(list(numbers), ensure_ascii=False).encode())
            made = [pa.array([ids], pa.list_(kind)), *(pa.array([x], pa.list_(pa.int64())) for x in (n_bytes, special, lengths)), pa.array([packed], pa.binary()), pa.array([len(numbers)], pa.int64()), pa.array([listed], pa.binary())]
            return pa.RecordBatch.from_arrays(made, names=["ids", "n_bytes", "special", "lengths", "numbered", "different", "pretokens"])

        for batch in batches:
            kind = batch.column("doc_id").type
            texts = batch.column("text")
            for doc_id, text, size in zip(batch.column("doc_id").to_pylist(), texts, pc.binary_length(texts).to_pylist(), strict=True):
                special, pre = own.cut(text.as_py() or "")
                numbered.extend(map(numbers.__getitem__, pre))
                ids.append(doc_id)
                rows.append((size or 0, special, len(pre)))
                if len(numbered) >= BLOCK or len(numbers) >= DIFFERENT:
                    yield emit()
                    numbers, ids, rows, numbered = _Numbers(), [], [], array("i")
        if ids:
            yield emit()

    schema = f"ids array<{id_type}>, n_bytes array<long>, special array<long>, lengths array<long>, numbered binary, different long, pretokens binary"
    return stage(docs.select("doc_id", "text").mapInArrow(run, schema).withColumn("block", F.monotonically_increasing_id()))


def _order(pretokens: list[str], shards: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of a list by shard, and where each shard begins and ends in that order."""
    shard = np.fromiter(map(xxhash.xxh64_intdigest, pretokens), np.uint64, len(pretokens)) % np.uint64(shards)
    order = np.argsort(shard, kind="stable")
    return order, np.searchsorted(shard[order], np.arange(shards + 1))


def _requests(blocks: DataFrame, shards: int) -> DataFrame:
    """shard, block, message: the pre-tokens of a block's list that belong to the shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, pretokens in zip(batch.column("block").to_pylist(), batch.column("pretokens"), strict=True):
                listed = json.loads(_unpress(pretokens.as_py()))
                order, edges = _order(listed, shards)
                owners = np.flatnonzero(np.diff(edges))
                messages = [_press(json.dumps([listed[i] for i in order[edges[s] : edges[s + 1]].tolist()], ensure_ascii=False).encode()) for s in owners]
                yield pa.RecordBatch.from_arrays([pa.array(owners, pa.int64()), pa.array([block] * len(owners), pa.int64()), pa.array(messages, pa.binary())], names=["shard", "block", "message"])

    return blocks.select("block", "pretokens").mapInArrow(run, "shard long, block long, message binary")


def _answers(requests: DataFrame, path: str) -> DataFrame:
    """Messages answered by piece counts, in their order; a shard's task tokenizes each different pre-token once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, current, pieces = cutter(path), None, {}
        for batch in batches:
            out = []
            for shard, message in zip(batch.column("shard").to_pylist(), batch.column("message"), strict=True):
                if shard != current:
                    current, pieces = shard, {}
                listed = json.loads(_unpress(message.as_py()))
                for pretoken in listed:
                    if pretoken not in pieces:
                        pieces[pretoken] = own.pieces(pretoken)
                out.append(_press(array("i", map(pieces.__getitem__, listed)).tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column("shard"), batch.column("block"), pa.array(out, pa.binary())], names=["shard", "block", "message"])

    sent = requests.repartition("shard").sortWithinPartitions("shard", "block")
    return sent.mapInArrow(run, "shard long, block long, message binary")


def token_counts(docs: DataFrame, path: str | None = None, shard_size: int = SHARD) -> DataFrame:
    """``docs(doc_id, text, ...)`` -> doc_id, n_bytes, n_tokens; one row per input row."""
    path = path or default_path()
    blocks = _blocks(docs, path)
    total = blocks.agg(F.coalesce(F.sum("different"), F.lit(0))).first()[0]
    shards = max(1, -(-total // shard_size))
    answers = _answers(_requests(blocks, shards), path)
    heads = blocks.withColumn("shard", F.lit(-1).cast("long")).drop("different")
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def counted(block: dict, messages: list[bytes], kind: pa.DataType) -> pa.RecordBatch:
        planes = np.frombuffer(_unpress(block["numbered"]), np.uint8).reshape(4, -1)
        numbered = np.ascontiguousarray(planes.T).view(np.int32).ravel()
        listed = json.loads(_unpress(block["pretokens"]))
        pieces = np.zeros(len(listed), np.int64)
        if messages:
            pieces[_order(listed, shards)[0]] = np.concatenate([np.frombuffer(_unpress(m), np.int32) for m in messages])
        sums = np.r_[0, np.cumsum(pieces[numbered])]
        lengths = np.array(block["lengths"])
        ends = np.cumsum(lengths)
        tokens = sums[ends] - sums[ends - lengths] + np.array(block["special"])
        return pa.RecordBatch.from_arrays([pa.array(block["ids"], kind), pa.array(block["n_bytes"], pa.int64()), pa.array(tokens)], names=["doc_id", "n_bytes", "n_tokens"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, messages, kind = None, [], None
        for batch in batches:
            kind = batch.schema.field("ids").type.value_type
            for at, shard in enumerate(batch.column("shard").to_pylist()):
                if shard < 0:
                    if block is not None:
                        yield counted(block, messages, kind)
                    block, messages = batch.slice(at, 1).to_pylist()[0], []
                else:
                    messages.append(batch.column("message")[at].as_py())
        if block is not None:
            yield counted(block, messages, kind)

    sent = heads.unionByName(answers, allowMissingColumns=True).repartition("block").sortWithinPartitions("block", "shard")
    return sent.mapInArrow(run, f"doc_id {id_type}, n_bytes long, n_tokens long")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents")).withColumn("over_limit", F.col("n_tokens") > LIMIT)


QUERIES = {"op3_token_counts": op3_token_counts}
SQL: dict[str, str] = {}
