"""Language identification by word-first backoff.

A word that training has seen scores each language by its log frequency there. An unseen word is scored by its
longest known character n-grams (of the word between boundary marks), falling back n by n to single characters. A
document's score is the sum over its words, plus the language's log share of training documents; the reported score
is the posterior of the best language.

Defined results: null text, or text without any letter -> ``und`` with score 0. Repeated rows get equal results. Equal
posteriors go to the smaller language name. Without any training row every text is ``und``. Extra columns are
ignored. Whole texts are read, at any length. A null doc_id counts as the empty text in the fold rule.

All words and n-grams of training are kept, as distributed tables. The scores of the COMMON most frequent words are also
broadcast, so that most words need no exchange; for the others, documents are gathered in blocks, and a block asks for
each of its different words once and gets a row of scores for it. Results do not depend on COMMON.
"""

from __future__ import annotations

import math
import re
from array import array
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausegraph.llm.runtime import crc_of, release, stage, table

WORD = re.compile(r"[^\W\d_]+")
UND = "und"
LONGEST = 5
FLUSH = 150_000
#: Words whose scores are broadcast.
COMMON = 100_000
#: A block ends with so many words, or so many different ones.
BLOCK, DIFFERENT = 500_000, 60_000
FOLDS = 5


def grams(word: str, n: int) -> list[str]:
    padded = f"^{word}$"
    return list(word) if n == 1 else [padded[i : i + n] for i in range(len(padded) - n + 1)]


def _emit(counts: dict[str, Counter], key: str) -> pa.RecordBatch:
    langs = [lang for lang, own in counts.items() for _ in own]
    keys, n = [k for own in counts.values() for k in own], [n for own in counts.values() for n in own.values()]
    counts.clear()
    return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(keys, pa.string()), pa.array(n, pa.int64())], names=["lang", key, "n"])


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    release()
    counts: dict[str, Counter] = defaultdict(Counter)
    for batch in batches:
        for text, lang in zip(batch.column("text"), batch.column("lang").to_pylist(), strict=True):
            counts[lang].update(WORD.findall(text.as_py().lower()))
            if sum(map(len, counts.values())) > FLUSH:
                yield _emit(counts, "word")
    yield _emit(counts, "word")


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    release()
    counts: dict[str, Counter] = defaultdict(Counter)
    for batch in batches:
        for lang, word, n in zip(*(batch.column(c).to_pylist() for c in ("lang", "word", "n")), strict=True):
            own = counts[lang]
            for size in range(1, LONGEST + 1):
                for gram in grams(word, size):
                    own[gram] = own.get(gram, 0) + n
            if len(own) > FLUSH:
                yield _emit(counts, "gram")
    yield _emit(counts, "gram")


def _logs_of(counts: DataFrame, key: str, langs: list[str]) -> DataFrame:
    """``counts(lang, key, n)`` -> key, logs: the smoothed log frequencies by language, within the keys of one size."""
    by_lang = [F.sum(F.when(F.col("lang") == lang, F.col("n")).otherwise(0)).alias(f"l{i}") for i, lang in enumerate(langs)]
    table = stage(counts.groupBy(key).agg(*by_lang))
    size = F.length(key) if key == "gram" else F.lit(0)
    sums = table.groupBy(size.alias("size")).agg(F.count("*").alias("rows"), *(F.sum(f"l{i}").alias(f"s{i}") for i in range(len(langs)))).collect()
    lost = F.lit(None).cast("double")
    logs = []
    for i in range(len(langs)):
        total = lost
        for r in sums:
            total = F.when(size == r["size"], F.lit(float(r[f"s{i}"] + 0.5 * (r["rows"] + 1)))).otherwise(total)
        logs.append(F.log((F.col(f"l{i}") + 0.5) / total).cast("float"))
    return table.select(key, F.array(*logs).alias("logs"), sum((F.col(f"l{i}") for i in range(len(langs))), F.lit(0)).alias("all"))


class Model:
    """Priors, and the tables (word, logs) and (gram, logs) of all words and n-grams of training."""

    def __init__(self, langs: list[str], prior: list[float], words: DataFrame | None = None, grams: DataFrame | None = None):
        self.langs, self.prior, self.words, self.grams = langs, np.array(prior), words, grams

    def common(self) -> tuple[list[str], np.ndarray]:
        """The most frequent words (ties to the smaller word) and their scores."""
        rows = self.words.orderBy(F.desc("all"), "word").limit(COMMON).select("word", "logs").toArrow()
        return rows.column("word").to_pylist(), rows.column("logs").combine_chunks().flatten().to_numpy().reshape(-1, len(self.langs))


def fit(train: DataFrame) -> Model:
    """Learn from all rows of ``train(text, lang)`` with a text and a language; only totals reach the driver."""
    rows = train.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", "lang")
    docs = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(docs)
    if not langs:
        return Model([], [])
    words = stage(rows.mapInArrow(_count_words, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")))
    pieces = words.mapInArrow(_count_grams, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    return Model(langs, [math.log(docs[x] / sum(docs.values())) for x in langs], _logs_of(words, "word", langs), _logs_of(pieces, "gram", langs))


def _grams_of(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column("word").to_pylist()
            found = [grams(word, size) for word in words]
            yield pa.RecordBatch.from_arrays([pa.array([w for w, own in zip(words, found, strict=True) for _ in own], pa.string()), pa.array([g for own in found for g in own], pa.string())], names=["word", "gram"])

    return run


def word_scores(words: DataFrame, model: Model) -> DataFrame:
    """``words(word)``, distinct -> word, logs: by the word itself if training has it, else by the mean of its longest
    known n-grams; words without any known n-gram have no row."""
    parts = [words.join(model.words.select("word", "logs"), "word")]
    rest = stage(words.join(model.words, "word", "left_anti"))
    for size in range(LONGEST, 0, -1):
        if rest.isEmpty():
            break
        known = model.grams.where(F.length("gram") == size)
        asked = rest.mapInArrow(_grams_of(size), "word string, gram string").join(known, "gram")
        means = [F.avg(F.col("logs")[i]).cast("float") for i in range(len(model.langs))]
        parts.append(stage(asked.groupBy("word").agg(F.array(*means).alias("logs"))))
        rest = stage(rest.join(parts[-1], "word", "left_anti")) if size > 1 else rest
    out = parts[0].select("word", "logs")
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


class _Numbers(dict):
    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        return n


def _blocks(source: DataFrame, model: Model) -> DataFrame:
    """The rows of ``source`` without _text, each with its block, the sum of prior and common words' scores (null for a
    text without words) and its other words' numbers in the block; and a row for each block with its different other
    words in the order of their numbers."""
    shared, prior = source.sparkSession.sparkContext.broadcast(model.common()), model.prior

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        common = {word: i for i, word in enumerate(shared.value[0])}
        logs = shared.value[1]
        block, numbers, seen = TaskContext.get().partitionId() << 32, _Numbers(), 0
        for batch in batches:
            texts, begin, numbered, sums = batch.column("_text"), 0, [], []

            def emit(end: int, batch: pa.RecordBatch = batch) -> pa.RecordBatch:
                part = batch.slice(begin, end - begin)
                made = [pa.array([block] * (end - begin), pa.int64()), pa.array(sums, pa.binary()), pa.array(numbered, pa.binary()), pa.nulls(end - begin, pa.list_(pa.string()))]
                return pa.RecordBatch.from_arrays([*part.columns[:-1], *made], names=[*batch.schema.names[:-1], "_block", "_sum", "_numbers", "_words"])

            def listed(batch: pa.RecordBatch = batch) -> pa.RecordBatch:
                made = [pa.array([block], pa.int64()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.binary()), pa.array([list(numbers)], pa.list_(pa.string()))]
                return pa.RecordBatch.from_arrays([*(pa.nulls(1, c.type) for c in batch.columns[:-1]), *made], names=[*batch.schema.names[:-1], "_block", "_sum", "_numbers", "_words"])

            for at, text in enumerate(texts):
                words = WORD.findall((text.as_py() or "").lower())
                at_common = list(map(common.get, words))
                rest = []
                if None in at_common:
                    rest = [w for w, i in zip(words, at_common, strict=True) if i is None]
                    at_common = [i for i in at_common if i is not None]
                sums.append((prior + logs[at_common].sum(0, dtype=np.float64) if at_common else prior).tobytes() if words else None)
                numbered.append(array("i", map(numbers.__getitem__, rest)).tobytes())
                seen += len(rest)
                if seen >= BLOCK or len(numbers) >= DIFFERENT:
                    yield emit(at + 1)
                    yield listed()
                    block, numbers, seen, begin, numbered, sums = block + 1, _Numbers(), 0, at + 1, [], []
            if begin < len(texts):
                yield emit(len(texts))
        if numbers:
            yield listed()

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields if f.name != "_text")
    return stage(source.mapInArrow(run, f"{schema}, _block long, _sum binary, _numbers binary, _words array<string>"))


def _predict(known: bytes | None, words: np.ndarray, logs: np.ndarray, langs: list[str]) -> tuple[str, float]:
    if known is None:
        return UND, 0.0
    total = np.frombuffer(known, np.float64) + logs[words].sum(0, dtype=np.float64)
    weights = np.exp(total - total.max())
    return langs[best := int(weights.argmax())], float(weights[best] / weights.sum())


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``docs(doc_id, text, ...)`` -> doc_id, lang_pred, score; one row per input row, any other columns kept."""
    keep = [c for c in docs.columns if c not in ("lang_pred", "score")]
    return _identify(docs.select(*keep, F.col("text").alias("_text")), model)


def _identify(source: DataFrame, model: Model) -> DataFrame:
    out = source.columns[:-1]
    if not model.langs:
        return source.select(*out, F.lit(UND).alias("lang_pred"), F.lit(0.0).alias("score"))
    blocks = _blocks(source, model)
    asked = blocks.where(F.col("_words").isNotNull()).select("_block", F.posexplode("_words").alias("_at", "word"))
    scores = word_scores(asked.select("word").distinct(), model)
    answers = asked.join(scores, "word").select("_block", F.lit(0).alias("_kind"), "_at", F.col("logs").alias("_logs"))
    rows = blocks.where(F.col("_words").isNull()).drop("_words").withColumn("_kind", F.lit(1))
    langs, width = model.langs, len(model.langs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by block, a block's scores first."""
        release()
        block, held, logs = None, [], None
        for batch in batches:
            blocks, kinds = batch.column("_block").to_numpy(), batch.column("_kind").to_numpy()
            edges = [0, *(np.flatnonzero((blocks[1:] != blocks[:-1]) | (kinds[1:] != kinds[:-1])) + 1).tolist(), len(blocks)]
            for begin, end in zip(edges, edges[1:], strict=False):
                if begin == end:
                    continue
                part = batch.slice(begin, end - begin)
                if blocks[begin] != block:
                    block, held, logs = blocks[begin], [], None
                if not kinds[begin]:
                    held.append((part.column("_at").to_numpy(), part.column("_logs").flatten().to_numpy().reshape(-1, width)))
                    continue
                numbered = [np.frombuffer(n.as_py(), np.int32) for n in part.column("_numbers")]
                if logs is None:
                    most = 1 + max((int(at.max()) for at, _ in held), default=-1)
                    logs = np.zeros((most, width), np.float32)
                    for at, own in held:
                        logs[at] = own
                    held = []
                if (most := 1 + max((int(n.max()) for n in numbered if len(n)), default=-1)) > len(logs):
                    logs = np.concatenate([logs, np.zeros((most - len(logs), width), np.float32)])
                found = [_predict(s.as_py(), n, logs, langs) for s, n in zip(part.column("_sum"), numbered, strict=True)]
                columns = [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in out), *columns], names=[*out, "lang_pred", "score"])

    sent = rows.unionByName(answers, allowMissingColumns=True).repartition("_block").sortWithinPartitions("_block", "_kind")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1]) + ", lang_pred string, score double"
    return sent.mapInArrow(run, schema)


def identify_documents(documents: DataFrame) -> DataFrame:
    """The contract query: learn from documents whose crc32(doc_id) mod 5 is not 0, predict all."""
    docs = documents.select("doc_id", "text", "lang")
    held_out = crc_of("doc_id") % FOLDS == 0
    model = fit(docs.where(~held_out))
    found = _identify(docs.select("doc_id", F.col("text").alias("_text")), model)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_documents(table(spark, sf_dir, "documents"))


QUERIES = {"op8_language_id": op8_language_id}
SQL: dict[str, str] = {}
