"""Training-data operators: exact methods against brute force or the library, and their defined edge cases."""

import hashlib
import html
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
import sentencepiece
import xxhash

import corpus_pipeline
from clausegraph.llm import htmltext, langid, media, mixing, neighbours, ngrams, pieces, registry, simhash, tokencount, toolcalls

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, size int, score double, p double, q double, fp long, bin string"
LONG = "lorem ipsum dolor " * 20_000


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and very long texts, repeated rows, ties, extra columns with clashing names."""
    texts = [None, "", " \n\t", LONG, "one two three four five six", "one two three four five six", "été ça va bien", "<|endoftext|> x", "12345 !!!", "a\x00b ▁ c"]
    rows = [(i, t, ("en" if i % 2 else None), (f"s{i % 3}" if i % 4 else None), None, 1, 0.5, 0.1, 0.2, 7, "b") for i, t in enumerate(texts)]
    rows += [rows[4], (None, "one two three", "fr", "s1", 3, 1, 0.5, 0.1, 0.2, 7, "b"), (None, None, None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}


OPS = {
    "mixing": mixing.plan_mix,
    "mixed": mixing.mix,
    "pieces": pieces.encode,
    "tokens": tokencount.token_counts,
    "simhash": simhash.classes,
    "ngrams": ngrams.score_documents,
    "langid": langid.identify_documents,
    "media": lambda d: media.features(media.store(d)),
}


@pytest.mark.parametrize("name", list(OPS))
def test_odd_rows(spark, odd, name):
    out = OPS[name](odd)
    assert out.count() == odd.count() or name == "mixed"
    assert OPS[name](odd.limit(0)).count() == 0


def test_mixing_matches_sql(spark, docs, odd):
    for frame, rows in ((docs, None), (odd, None)):
        table = frame.toPandas()
        con = duckdb.connect()
        con.register("documents", table[["doc_id", "text", "source"]].astype({"doc_id": "Int64"}))
        want = Counter(map(tuple, con.sql(mixing.MIX_SQL).df()[["size", "source_size", "target", "taken"]].itertuples(index=False)))
        got = mixing.plan_mix(frame).toPandas()
        got["target"] = got["target"].round(4)
        assert Counter(map(tuple, got[["size", "source_size", "target", "taken"]].itertuples(index=False))) == want
        assert (got.taken <= 3 * got["size"]).all()


def test_pieces_match_library(texts):
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.default_path())
    own = pieces.Codec(pieces.default_path())
    rng = random.Random(5)
    parts = ["a", "B", " ", "  ", "\n", "é", "é", "the", "▁", "漢", "\U0001f600", "10", "aaaa", "\t", "\x00", "</s>", "<0x0A>", "        "]
    made = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(2000)]
    for text in [*list(texts.values())[:60], *made, "a" * 5000, " " * 777]:
        ids = own.encode(text)
        assert ids == library.encode(text, add_eos=True) and own.decode(ids) == library.decode(ids)


def test_piece_digests(spark, odd):
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.default_path())
    for r in pieces.encode(odd, keep=["doc_id", "text"]).collect():
        ids = library.encode(r.text or "", add_eos=True)
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


@pytest.mark.parametrize("shard_size", [tokencount.SHARD, 300])
def test_token_counts_match_library(spark, docs, odd, shard_size):
    library = tokencount.cutter(tokencount.default_path()).lib
    for frame in (docs, odd):
        want = Counter((d, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for d, t in frame.select("doc_id", "text").collect())
        assert Counter(map(tuple, tokencount.token_counts(frame, shard_size=shard_size).collect())) == want


def brute_classes(rows, shingle, k):
    prints = []
    for _, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + shingle]).encode(), 42) for i in range(max(1, len(words) - shingle + 1))] if words else []
        prints.append(sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes)))
    head = list(range(len(rows)))

    def root(i):
        while head[i] != i:
            i = head[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= k:
                head[root(i)] = root(j)
    groups = {}
    for i, (d, _) in enumerate(rows):
        groups.setdefault(root(i), []).append(d)
    least = {g: min((d for d in ids if d is not None), default=None) for g, ids in groups.items()}
    return Counter((d, prints[i] - (prints[i] >> 63 << 64), least[root(i)]) for i, (d, _) in enumerate(rows))


@pytest.mark.parametrize("k,large", [(4, 8192), (4, 30), (10, 8192), (10, 30)])
def test_simhash_matches_brute_force(spark, docs, odd, monkeypatch, k, large):
    monkeypatch.setattr(simhash, "LARGE", large)
    short = odd.where("text IS NULL OR length(text) < 1000")
    for frame in (docs, short):
        rows = [(r.doc_id, r.text) for r in frame.select("doc_id", "text").collect()]
        assert Counter(map(tuple, simhash.classes(frame, 4, k).collect())) == brute_classes(rows, 4, k)


@pytest.mark.parametrize("n,blocks", [(10, 5), (10**8, 6), (10**11, 7)])
def test_simhash_blocks_grow(n, blocks):
    assert simhash.blocks_for(n, 4) == blocks


def test_gray_index_matches_brute_force():
    rng = np.random.default_rng(0)
    for n in (1, 40, 2500):
        fp = rng.integers(0, 2**63, max(1, n // 10), dtype=np.uint64)[rng.integers(0, max(1, n // 10), n)]
        for _ in range(4):
            fp = fp ^ (np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64))
        fp = np.unique(fp)
        a, b = simhash.spanning_links(np.zeros(len(fp), np.int64), fp, 4)
        i, j = np.nonzero(np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 4)
        want = np.arange(len(fp))
        simhash._union(want, i, j)
        got = np.arange(len(fp))
        simhash._union(got, np.searchsorted(fp, a), np.searchsorted(fp, b))
        assert (want == got).all()


def test_ngram_scores(spark, docs, texts, monkeypatch):
    monkeypatch.setattr(ngrams, "BLOCK", 20_000)
    monkeypatch.setattr(ngrams, "SHARD", 20_000)
    c1, c2, c3, lines = Counter(), Counter(), Counter(), {}
    for i, text in texts.items():
        words = ["<s>", *text.encode().lower().split(), "</s>"]
        lines[i] = words
        if zlib.crc32(str(i).encode()) % 7 != 2:
            c1.update(words)
            c2.update(zip(words, words[1:], strict=False))
            c3.update(zip(words, words[1:], words[2:], strict=False))
    n, v = sum(c for w, c in c1.items() if w != "<s>"), len(c1) - 1
    out = ngrams.score_documents(docs).collect()
    for r in out:
        w, base, score = lines[r.doc_id], 0.0, 0.0
        for k in range(1, len(w)):
            p1 = (c1[w[k]] + 1) / (n + v + 1)
            p2 = (c2[w[k - 1], w[k]] + ngrams.M2 * p1) / (c1[w[k - 1]] + ngrams.M2)
            p = p2 if k == 1 else (c3[w[k - 2], w[k - 1], w[k]] + ngrams.M3 * p2) / (c2[w[k - 2], w[k - 1]] + ngrams.M3)
            base, score = base + math.log10(p1), score + math.log10(p)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w) - 1, sum(c1[x] > 0 for x in w[1:]), n)
        assert r.base_score == pytest.approx(base) and r.score == pytest.approx(score, rel=2e-3)
    held = [r for r in out if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_elias_fano():
    rng = np.random.default_rng(1)
    for n, universe in ((0, 10), (1, 1), (5, 100), (1000, 1 << 40), (3000, 3000)):
        values = np.unique(rng.integers(0, universe, n))
        own = ngrams.EliasFano.open(ngrams.EliasFano.pack(values, universe))
        assert (own.get(np.arange(len(values))) == values.astype(np.uint64)).all()
        asked = np.r_[values, rng.integers(0, universe, 100)]
        spot = {v: i for i, v in enumerate(values.tolist())}
        assert own.find(asked).tolist() == [spot.get(x, -1) for x in asked.tolist()]


def test_language(spark, docs, odd):
    found = {r.doc_id: r for r in langid.identify_documents(docs).collect()}
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    held = [d for d, r in found.items() if r.held_out]
    assert {d for d in truth if zlib.crc32(str(d).encode()) % 5 == 0} == set(held)
    assert np.mean([found[d].lang_pred == truth[d] for d in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in found.values())
    odd_rows = {r.doc_id: r for r in langid.identify_documents(odd).collect() if r.doc_id is not None}
    assert [odd_rows[i].lang_pred for i in (0, 1, 2, 8)] == ["und"] * 4


def test_streams():
    rng = random.Random(2)
    for n in [0, 1, 63, 64, 65, 150, 168, 170, 171, 184, 16383, 16384, 16385, 70_000, *(rng.randint(0, 40_000) for _ in range(40))]:
        payload = rng.randbytes(n).ljust(max(64, -(-n // 64) * 64), b"\0")
        data = media.write_stream(payload)
        got = media.read_stream(data)
        assert got["payload"] == payload and len(data) % 188 == 0 and got["gaps"] == got["bad_sync"] == got["repeats"] == 0
        assert got["stamps"] == [i * media.TICKS for i in range(-(-len(payload) // media.PES_BYTES))]
        assert got["random_access"] == list(range(0, len(got["stamps"]), media.KEY_EVERY))
    assert media.read_stream(data[: 188 * 5] + data[188 * 6 :])["gaps"] == 1
    assert media.read_stream(data[: 188 * 5] + data[188 * 4 :])["repeats"] == 1
    assert media.read_stream(b"")["payload"] == b""


def test_damaged_streams_never_raise():
    rng = random.Random(3)
    whole = bytearray(media.write_stream(rng.randbytes(40_000)))
    for n in range(13):  # the first elementary packet is cut to n bytes
        short = bytearray(whole[: 188 * 3])
        short[188 * 2 + 3], short[188 * 2 + 4], short[188 * 2 + 5] = 0x30, 183 - n, 0x40
        got = media.read_stream(bytes(short))
        assert got["damaged"] == 1 and got["payload"] == b"" and got["stamps"] == []
    for _ in range(300):
        torn = bytearray(whole)
        for _ in range(rng.randint(1, 40)):
            torn[rng.randrange(len(torn))] = rng.randrange(256)
        media.read_stream(bytes(torn[: rng.randrange(len(torn))]))


def test_stream_query_matches_brute_force(spark, texts):
    rows = {r.doc_id: r for r in media.op9_transport_stream(spark, SMALL).collect()}
    assert rows.keys() == texts.keys()
    for doc_id, text in texts.items():
        data = text.encode()
        payload = data + b"\0" * ((64 - len(data) % 64) % 64 if data else 64)
        stream = media.write_stream(payload)
        elementary = (len(payload) + media.PES_BYTES - 1) // media.PES_BYTES
        r = rows[doc_id]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(data), len(payload), hashlib.sha256(payload).hexdigest())
        assert (r.tail_crc32, r.media_bytes, r.media_sha256) == (zlib.crc32(payload[-64:]), len(stream), hashlib.sha256(stream).hexdigest())
        assert r.pts == [i * media.TICKS for i in range(elementary)] and r.random_access == list(range(0, elementary, media.KEY_EVERY))


def test_pages(spark):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    for r in htmltext.extract(pages).join(pages.select("page_id", "html"), "page_id").collect():
        article = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        want = [" ".join(html.unescape(re.sub(r"<(?:br|/?b)>", " ", p)).split()) for p in re.split(r"</?(?:p|h1)>", article)]
        assert r.text == "\n".join(w for w in want if w) and r.n_chars == len(r.text)
    odd = spark.createDataFrame([(1, None, None), (2, "u", ""), (3, "u", "plain &amp; text"), (4, "u", "<p>short"), (5, "u", "<div>" * 5000 + "deep" + "</p>" * 5000), (None, None, "<")], "page_id long, url string, html string")
    assert [r.text for r in htmltext.extract(odd).orderBy("page_id").collect()] == ["<", "", "", "plain & text", "short", "deep"]
    page = """<body><header><h1>Site</h1></header><div class="content"><h1>Title</h1><p>First para, with commas, and text that goes on.<p>Second
    para, longer than the one before.<div class="share">Share</div><form><p>Subscribe to our letter, it is free, now and for ever.</p></form></div>
    <div id="comments"><p>Nice article, I liked it, thanks a lot for it.</p></div><aside><p>Side, bar, text, more, more, more text here.</p></aside><footer>foot</footer>"""
    assert htmltext.main_text(page) == "Title\nFirst para, with commas, and text that goes on.\nSecond para, longer than the one before."


def test_tool_calls(spark):
    con = duckdb.connect()
    con.sql(f"create view conversations as select * from '{SMALL}/conversations.parquet'")
    got = toolcalls.op4_tool_calls(spark, SMALL)
    assert Counter(map(tuple, got.collect())) == Counter(con.sql(toolcalls.CALLS_SQL).project(", ".join(got.columns)).fetchall())
    calls = spark.createDataFrame([("a", "reply", '{"turn": 1, "question": "x","z":{"b":1,"a":[1, 2]}}', None), ("b", "reply", '{"turn":"1"}', "a"), ("c", "other", "{}", "d"), ("d", "reply", "[1]", "c"), (None, None, None, "a"), ("a", "reply", "{}", "b")], "call_id string, name string, arguments string, after string")
    results = spark.createDataFrame([("a", "r"), ("zz", "é\n\""), (None, None)], "call_id string, content string")
    rows = {r.call_id: r for r in toolcalls.link_calls(calls, results).collect() if r.call_id}
    assert {k: (r.depth, r.status) for k, r in rows.items()} == {"a": (0, "linked"), "b": (1, "unanswered"), "c": (None, "cycle"), "d": (None, "cycle"), "zz": (None, "orphan")}
    assert rows["b"].errors == "question: missing; turn: not integer" and rows["c"].errors == "unknown tool"
    assert rows["a"].message == '{"arguments":{"question":"x","turn":1,"z":{"a":[1,2],"b":1}},"id":"a","name":"reply","result":"r"}'
    chain = spark.createDataFrame([(str(i), "reply", "{}", str(i - 1)) for i in range(300)], "call_id string, name string, arguments string, after string")
    assert {int(r.call_id): r.depth for r in toolcalls.depths(chain).collect()} == {i: i for i in range(300)}
    assert toolcalls.link_calls(calls.limit(0), results.limit(0)).count() == 0


def test_neighbours(spark):
    rng = np.random.default_rng(4)
    points = np.r_[rng.normal(size=(400, 8)).astype(np.float32), np.repeat(rng.normal(size=(1, 8)).astype(np.float32), 60, 0)]
    rows = [(i, [float(x) for x in p], 1) for i, p in enumerate(points)]
    rows += [(1000, None, 1), (1020, [0.0] * 8, 1), (1040, [float("nan")] * 8, 1), (1060, [None] + [1.0] * 7, 1), (1080, [1.0], 1)]
    out = neighbours.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")).collect()
    x, hits = points.astype(float), 0
    asked = sorted({r.query_id for r in out})
    assert asked == [i for i in range(len(points)) if i % 20 == 0]
    for q in asked:
        mine = sorted((r.rank, r.vec_id, r.score) for r in out if r.query_id == q)
        scores = np.array([sum(a * b for a, b in zip(p, x[q], strict=True)) for p in x])
        order = [i for i in np.lexsort((np.arange(len(x)), -np.round(scores, 9))) if i != q][:20]
        hits += len(set(order) & {m[1] for m in mine})
        assert [m[0] for m in mine] == list(range(1, 21)) and all(abs(scores[m[1]] - m[2]) < 1e-12 for m in mine)
    assert hits / (20 * len(asked)) >= 0.9
    few = spark.createDataFrame(rows[:3], "vec_id long, embedding array<float>, score int")
    assert neighbours.search(few).count() == 2 and neighbours.search(few.limit(0)).count() == 0
    nameless = spark.createDataFrame([("0", [1.0, 2.0]), ("1", [2.0, 1.0]), (None, [3.0, 3.0]), ("x", [4.0, 4.0])], "vec_id string, embedding array<double>")
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in neighbours.search(nameless).collect()] == [(0, 1, 1, 4.0)]


def test_neighbours_outside_the_fitted_sample(spark, monkeypatch):
    """Many leaves a tree, cells within leaves, trees fitted on a sixth of the rows."""
    monkeypatch.setattr(neighbours, "FIT_ROWS", 600)
    monkeypatch.setattr(neighbours, "LEAF", 100)
    monkeypatch.setattr(neighbours, "CELL", 64)
    grown = []
    monkeypatch.setattr(neighbours.Forest, "calibrate", lambda self, *a, old=neighbours.Forest.calibrate: (old(self, *a), grown.append(self))[0])
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(40, 12))
    points = np.round(centres[rng.integers(0, 40, 3600)] + 0.35 * rng.normal(size=(3600, 12)), 1)  # rounded: many tied scores
    out = neighbours.search(spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "vec_id long, embedding array<double>")).collect()
    (forest,) = grown
    assert forest.leaves >= 12 * neighbours.TREES and forest.visits < forest.leaves
    exact = {q: neighbours.product(np.broadcast_to(points[q], points.shape), points) for q in range(0, 3600, 20)}
    hits = 0
    for q, scores in exact.items():
        mine = sorted((r.rank, r.vec_id, r.score) for r in out if r.query_id == q)
        assert [m[0] for m in mine] == list(range(1, 21)) and all(scores[m[1]] == m[2] for m in mine)
        assert [(-m[2], m[1]) for m in mine] == sorted((-m[2], m[1]) for m in mine)
        order = [int(i) for i in np.lexsort((np.arange(3600), -scores)) if i != q][:20]
        hits += len(set(order) & {m[1] for m in mine})
    assert hits / (20 * len(exact)) >= 0.9


def test_tied_neighbours_at_the_cut_are_the_smallest_ids(spark):
    """200 vectors in a few leaves share the product with each query exactly, although blocks may round it otherwise."""
    rng = np.random.default_rng(9)
    base = [0.1, 0.2, 0.3, 0.7, 1.1, 0.9]
    rows = [(0, [*base, 0.0])] + [(i, [*base, float(i)]) for i in rng.permutation(np.arange(1, 200)).tolist()]
    out = neighbours.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).where("query_id = 0").orderBy("rank").collect()
    assert [r.vec_id for r in out] == list(range(1, 21)) and len({r.score for r in out}) == 1


def test_pipeline_stages(spark, docs):
    frame, kept = docs, []
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        frame = stage(spark, frame, SMALL)
        assert number == 3 or frame.columns == docs.columns
        kept.append(frame.count())
    assert kept[0] > 0.9 * docs.count() and kept[1] < kept[0] and kept[3] == kept[2]


def test_registry():
    assert {n.split("_")[0] for n in registry.QUERIES} == {f"op{i}" for i in range(1, 11)}
