"""The pipeline's near-duplicate stage against brute force on whole texts."""

import random

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from clausegraph.llm import shingles, simhash

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def edited(rng, words, changes):
    words = list(words)
    for at in rng.sample(range(5, len(words) - 5, 5), changes):
        words[at] = f"new{rng.randrange(10**6)}"
    return words


def shared(a, b):
    a, b = ({tuple(x.split()[i : i + 5]) for i in range(len(x.split()) - 4)} for x in (a, b))
    return len(a & b) / len(a | b)


def pair_where(changes, wanted):
    """Two texts of 60 words that differ in ``changes`` words and whose fingerprints' distance is as wanted."""
    for seed in range(10_000):
        rng = random.Random(seed)
        words = [f"w{rng.randrange(10**6)}" for _ in range(60)]
        a, b = " ".join(words), " ".join(edited(rng, words, changes))
        if wanted((simhash.fingerprint(a, 5) ^ simhash.fingerprint(b, 5)) % 2**64):
            return a, b
    raise AssertionError


def kept(spark, rows):
    frame = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOCS)
    out = corpus_pipeline.near_duplicates(spark, frame, "")
    assert out.columns == frame.columns
    return sorted(((r.doc_id, r.text) for r in out.collect()), key=str)


def test_close_fingerprints_alone_are_no_link(spark):
    a, b = pair_where(3, lambda bits: bits.bit_count() <= 10)
    assert shared(a, b) < 0.7
    assert kept(spark, [(1, a), (2, b)]) == [(1, a), (2, b)]


def test_similar_texts_with_far_fingerprints_are_linked(spark):
    pairs = [pair_where(1, lambda bits, far=far: bits.bit_count() >= far) for far in (11, 13)]
    assert all(shared(*p) >= 0.8 for p in pairs)
    rows = [(2 * i + j, text) for i, p in enumerate(pairs) for j, text in enumerate(p)]
    assert kept(spark, rows) == [r for r in rows if r[0] % 2 == 0]


@pytest.mark.parametrize(("sample", "often"), [(20, 5), (1, 2), (1, 8)])
def test_classes_match_brute_force(spark, monkeypatch, sample, often):
    monkeypatch.setattr(shingles, "SAMPLE", sample)
    monkeypatch.setattr(shingles, "OFTEN", often)
    rng = random.Random(7)
    passage = [f"p{i}" for i in range(30)]
    texts = ["a b c", "A  b c", "a b d"]
    for _ in range(10):
        family = [[f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(40, 90))] + passage]
        for _ in range(8):
            family.append(edited(rng, rng.choice(family), rng.randrange(4)))
        texts += [" ".join(w) for w in family]
    sets = [set(shingles.shingles(t, 5).tolist()) for t in texts]
    head = list(range(len(texts)))
    for b in range(len(texts)):
        for a in range(b):
            if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                x, y = sorted((head[a], head[b]))
                head = [x if h == y else h for h in head]
    assert 20 < len(set(head)) < len(texts) - 20
    assert kept(spark, list(enumerate(texts))) == sorted(((i, texts[i]) for i in set(head)), key=str)


@pytest.mark.parametrize("held", [0, 3, 100])
def test_groups_stay_whole(monkeypatch, held):
    monkeypatch.setattr(shingles, "HELD", held)
    keys = np.sort(np.array([5, 1, 1, 7, 7, 7, 7, 7, 2, 9], np.int64))
    batches = [pa.RecordBatch.from_arrays([pa.array(keys[i : i + 2])], names=["key"]) for i in range(0, 10, 2)]
    parts = [x.tolist() for (x,) in shingles._whole_groups(iter(batches), ["key"])]
    assert sum(parts, []) == keys.tolist() and all(a[-1] != b[0] for a, b in zip(parts, parts[1:], strict=False))


def test_classes_without_ids_and_with_shared_ids_keep_a_row(spark):
    a, b = pair_where(1, lambda bits: bits.bit_count() <= 10)
    rows = [(None, "only text here"), (None, a), (3, b), (4, "one text"), (4, "another text"), (4, "another text"), (None, None), (6, ""), (5, " ")]
    want = sorted([(None, "only text here"), (3, b), (4, "one text"), (4, "another text"), (5, " ")], key=str)
    assert kept(spark, rows) == want
    assert kept(spark, rows[::-1]) == want
    assert kept(spark, [(None, None)]) == [(None, None)]


def test_equal_ids_and_texts_keep_the_same_row_in_any_order(spark):
    rows = [(1, "Some text"), (1, "some  text"), (1, "SOME text")]
    first = kept(spark, rows)
    assert len(first) == 1 and kept(spark, rows[::-1]) == first


def test_no_rows(spark):
    empty = spark.createDataFrame([], DOCS)
    assert corpus_pipeline.near_duplicates(spark, empty, "").count() == 0


def test_keys_that_near_sets_share_are_never_fewer_than_asked(spark):
    """The bound on shared keys, by definition: sets of 4/5 or more under random orders of the shingles."""
    rng = np.random.default_rng(1)
    rows = []
    while len(rows) < 200:
        a, b = (np.unique(rng.integers(0, 2**64, n, np.uint64)) for n in rng.integers(1, 60, 2))
        b = np.union1d(b[: rng.integers(0, 5)], a[rng.integers(0, 8) :])
        if len(b) and 5 * len(np.intersect1d(a, b)) >= 4 * len(np.union1d(a, b)):
            keys = [set(x[: len(x) - -(-4 * len(x) // 5) + 1].tolist()) for x in (a, b)]
            rows.append((len(a), len(b), len(keys[0] & keys[1])))
    frame = spark.createDataFrame(rows, "size_a int, size_b int, n long")
    assert frame.where(frame["n"] < shingles._lack(frame["size_a"], frame["size_b"])).count() == 0


@pytest.mark.parametrize("number", [0, 1, 2])
def test_columns_with_clashing_names_are_kept(spark, number):
    names = ["score", "lang_pred", "node", "row", "head", "place", "m_id", "m_size0", "copies", "m_copy"]
    texts = ["the small bird sings in the old garden"] * 2 + ["le petit oiseau chante dans le vieux jardin"] * 2
    rows = [(i, t, "en" if i < 2 else "fr", f"s{i % 2}", 1, *[-7.0 - i] * len(names)) for i, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, DOCS + "".join(f", {n} double" for n in names))
    out = corpus_pipeline.STAGES[number][1](spark, frame, "")
    assert out.schema.names == frame.schema.names
    found = out.collect()
    assert found and all({r[n] for n in names} == {-7.0 - r.doc_id} for r in found)


@pytest.mark.parametrize("many", [2, 6])
def test_classes_match_brute_force_with_large_keys(spark, monkeypatch, many):
    monkeypatch.setattr(shingles, "MANY", many)
    test_classes_match_brute_force(spark, monkeypatch, 1, 8)


def test_large_keys_give_each_pair_once():
    """Twenty texts of one size share thirty keys and no class; each key is a task of its own."""
    keys, nodes = np.sort(np.random.default_rng(3).integers(-(2**63), 2**63 - 1, 30)), np.arange(20)
    same = {"size": np.full(20, 100, np.int32), "end": np.zeros(20, np.int64), "head": nodes, "most": np.full(20, 109), "texts": np.full(20, 20)}
    same |= {f"s{i}": np.zeros(20, np.int64) for i in range(8)} | {f"k{i}": np.full(20, keys[4 * i]) for i in range(4)}
    found = []
    for place, key in enumerate(keys):
        batch = pa.RecordBatch.from_pydict({"key": np.full(20, key), "node": nodes, "place": np.full(20, place % 20, np.int32), **same})
        found += [(a, b) for part in shingles._rest(iter([batch])) for a, b in zip(part["a"].to_pylist(), part["b"].to_pylist(), strict=True)]
    assert sorted(found) == [(a, b) for a in range(20) for b in range(a)]
