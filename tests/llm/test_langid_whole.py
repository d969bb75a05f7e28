"""Language identification keeps all words and n-grams of training."""

import math
from collections import Counter, defaultdict

import numpy as np
import pytest

from clausegraph.llm import langid

SMALL = "/root/testdata/sf0.001"


def brute(train, texts):
    """Predictions with the full tables as plain dictionaries."""
    langs = sorted({lang for _, lang in train})
    words, grams = defaultdict(Counter), defaultdict(lambda: defaultdict(Counter))
    for text, lang in train:
        for word in langid.WORD.findall(text.lower()):
            words[word][lang] += 1
            for n in range(1, 6):
                for gram in langid.grams(word, n):
                    grams[n][gram][lang] += 1

    def logs(table):
        sums = [sum(c[lang] for c in table.values()) for lang in langs]
        return {k: np.array([math.log((c[lang] + 0.5) / (s + 0.5 * (len(table) + 1))) for lang, s in zip(langs, sums, strict=True)]) for k, c in table.items()}

    words, grams = logs(words), {n: logs(t) for n, t in grams.items()}

    def row(word):
        if word in words:
            return words[word]
        for n in range(5, 0, -1):
            if known := [grams[n][g] for g in langid.grams(word, n) if g in grams[n]]:
                return np.mean(known, axis=0)
        return np.zeros(len(langs))

    sizes = Counter(lang for _, lang in train)
    prior = np.array([math.log(sizes[x] / len(train)) for x in langs])
    out = {}
    for key, text in texts.items():
        total = sum((row(w) for w in langid.WORD.findall((text or "").lower())), prior)
        weights = np.exp(total - total.max())
        out[key] = (langs[int(weights.argmax())], weights.max() / weights.sum()) if langid.WORD.search(text or "") else ("und", 0.0)
    return out


@pytest.mark.parametrize("common", [0, 500])
def test_scores_match_full_tables(spark, monkeypatch, common):
    monkeypatch.setattr(langid, "COMMON", common)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").repartition(3)
    rows = docs.collect()
    train = [(r.text, r.lang) for r in rows if r.doc_id % 3 and r.text is not None and r.lang is not None]
    texts = {r.doc_id: r.text for r in rows} | {-1: "Zyzzyva qqq", -2: "", -3: None, -4: "ʘʘʘ"}
    asked = spark.createDataFrame([(i, t, 1.5) for i, t in texts.items()], "doc_id long, text string, score double")
    found = langid.identify(asked, langid.fit(docs.where("doc_id % 3 <> 0"))).collect()
    want = brute(train, texts)
    assert len(found) == len(texts)
    assert all(r.lang_pred == want[r.doc_id][0] and abs(r.score - want[r.doc_id][1]) < 1e-3 for r in found)


def test_a_small_language_keeps_its_words(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    common = ["".join(letters[(i * p // q) % 26] for p, q in ((7, 1), (3, 26), (11, 676), (5, 1), (1, 97), (1, 1009))) + letters[i % 26] + letters[i // 26 % 26] + letters[i // 676 % 26] + letters[i // 17576 % 26] for i in range(120_000)]
    rows = [(i, " ".join(2 * common[i::40]), "en") for i in range(40)] + [(40, "ქართული ენა არის", "ka")]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    found = langid.identify(spark.createDataFrame([(1, "ქართული ენა"), (2, "ქართულად ენაში")], "doc_id long, text string"), model)
    assert [r.lang_pred for r in found.orderBy("doc_id").collect()] == ["ka", "ka"]
