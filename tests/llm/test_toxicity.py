import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from twinfold.llm import toxicity


def test_pair_terms_equal_a_double_loop():
    rng = np.random.default_rng(0)
    made = toxicity.Machine(np.arange(30), 0.3, rng.normal(size=30), rng.normal(size=(30, 4)))
    texts = [sorted(rng.choice(30, size=k, replace=False).tolist()) for k in (0, 1, 2, 9, 30)]
    for score, text in zip(made.scores(texts), texts):
        margin = made.bias + sum(made.weights[i] for i in text)
        margin += sum(made.vectors[i] @ made.vectors[j] for i in text for j in text if i < j)
        assert score == pytest.approx(toxicity.squash(np.array([margin]))[0], rel=1e-4)  # 32-bit rows


def test_learns_an_interaction_that_no_sum_of_weights_can():
    """Toxic exactly when both or neither of two terms stand in the text: no linear rule gets over three quarters."""
    rng = np.random.default_rng(1)
    texts, labels = [], []
    for i in range(2000):
        a, b = rng.integers(2), rng.integers(2)
        texts.append(np.array([10] * a + [20] * b + [30 + i % 5], dtype=np.int32))
        labels.append(float(a == b))
    labels = np.array(labels)
    config = toxicity.FitConfig(min_z=0.0, epochs=60)
    made = toxicity.fit(texts, labels, config)
    place = {int(t): i for i, t in enumerate(made.terms)}
    scores = made.scores([[place[t] for t in text.tolist() if t in place] for text in texts])
    assert ((scores >= 0.5) == labels).mean() > 0.95


def test_production_settings_learn_an_interaction_of_terms_that_stand_alike_in_both_classes():
    rng = np.random.default_rng(1)
    texts, labels = [], []
    for i in range(2000):
        a, b = rng.integers(2), rng.integers(2)
        texts.append(np.array([10] * a + [20] * b + [30 + i % 5], dtype=np.int32))
        labels.append(float(a == b))
    labels = np.array(labels)
    made = toxicity.fit(texts, labels, toxicity.FitConfig())
    assert made.terms.tolist() == [10, 20, 30, 31, 32, 33, 34]
    place = {int(t): i for i, t in enumerate(made.terms)}
    scores = made.scores([[place[t] for t in text.tolist()] for text in texts])
    assert ((scores >= 0.5) == labels).mean() > 0.95


def fixture(spark, n=1200):
    rng = random.Random(0)
    rows, labels = [], []
    for i in range(n):
        words = [f"w{rng.randrange(400)}" for _ in range(rng.choice((5, 60, 400)))]
        if i % 5 == 0:
            words[rng.randrange(len(words))] = rng.choice(("Vermin!", "filth", "verminous,"))
        rows.append((i, " ".join(words)))
        labels.append((i, int(i % 5 == 0)))
    return spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, toxic int")


def test_held_out_rows_and_edges(spark):
    docs, labels = fixture(spark)
    noisy = labels.union(spark.createDataFrame([(None, 1), (3, None), (0, 1)], labels.schema))
    machine = toxicity.learn(docs, noisy)
    extra = spark.createDataFrame([(None, "filth"), (-1, None), (-2, ""), (-3, "x" * 300_000), (-3, "x" * 300_000)], docs.schema)
    out = toxicity.score_texts(docs.union(extra).withColumn("score", F.lit("clash")), machine)
    scores = {}
    for r in out.collect():
        scores.setdefault(r.doc_id, []).append(r.score)
    held = [i for i in range(1200) if zlib.crc32(str(i).encode()) % 5 == 0]
    right = [(scores[i][0] >= 0.5) == (i % 5 == 0) for i in held]
    assert sum(right) / len(right) > 0.98
    assert scores[None][0] > 0.5 and scores[-1] == scores[-2] and scores[-1][0] < 0.5 and len(set(scores[-3])) == 1
    kept = toxicity.drop_toxic(docs.union(extra), machine)
    assert kept.columns == docs.columns and kept.filter("doc_id = -3").count() == 2
    again = dict(toxicity.score_texts(docs, toxicity.learn(docs, labels)).collect())
    assert all(again[i] == scores[i][0] for i in range(50))
    assert toxicity.score_texts(docs.limit(0), machine).count() == 0
    none = toxicity.learn(docs, labels.limit(0))
    assert toxicity.score_texts(docs, none).filter("score >= 0.5").count() == 0


def test_query_on_held_out_rows(spark):
    from twinfold.llm.queries import QUERIES

    folder = "/root/testdata/sf0.01"
    out = QUERIES["op2_toxicity"](spark, folder).cache()
    assert out.count() == spark.read.parquet(f"{folder}/documents.parquet").count()
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    rows = out.join(labels, "doc_id").filter("held_out").collect()
    assert sum(r.predicted == r.toxic for r in rows) / len(rows) > 0.9


def test_terms_of_many_words_equal_those_of_each(monkeypatch):
    rng = random.Random(3)
    marks = "abcxyz.,'!?<>="
    alphabets = (marks, marks + "éßñ\xff\xb5", marks + "Σς日本", "😀a𝒳" + marks)
    words = ["".join(rng.choice(a) for _ in range(rng.choice((1, 2, 3, 4, 9, 40)))) for a in alphabets for _ in range(400)]
    words += ["x" * 64, "x" * 65, "é" * 64, "日" * 70, "...", "<>", "a", "abc", ".abc.", "\x00\x00\x00", "naïve", "i\u0307stanbul"]
    places = np.arange(1 << toxicity.HASH_BITS, dtype=np.int32)
    places[rng.sample(range(len(places)), len(places) // 2)] = -1
    bare = [b for w in words if len(b := w.strip(toxicity.MARKS)) >= toxicity.GRAM - 2]
    for word, terms in zip(bare, toxicity.many_terms(bare), strict=True):
        assert set(terms) == set(toxicity.word_terms(word)), repr(word)
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 300))) for _ in range(40)] + [None, "", " \n "]
    monkeypatch.setattr(toxicity, "LOT_CHARS", 5000)
    for size in (toxicity.WORD_CACHE, 50):
        monkeypatch.setattr(toxicity, "WORD_CACHE", size)
        for cut in (None, places):
            for text, terms in zip(texts, toxicity.text_terms(texts, toxicity._Terms(cut)), strict=True):
                wanted = {t for w in (text or "").lower().split() for t in toxicity.word_terms(w)}
                assert terms.tolist() == sorted(t for t in wanted if cut is None or cut[t] >= 0)


def test_hashes_runs_of_new_words_together(monkeypatch):
    """Runs of characters are not hashed one by one: a call for each word and for short ones only."""
    calls = []
    monkeypatch.setattr(toxicity, "hashed", lambda term, hashed=toxicity.hashed: calls.append(term) or hashed(term))
    words = [f"wörd{i}tail" for i in range(500)]
    assert len(list(toxicity.text_terms([" ".join(words)] * 2, toxicity._Terms(None)))) == 2
    assert sorted(calls) == sorted(f"={w}" for w in words)
