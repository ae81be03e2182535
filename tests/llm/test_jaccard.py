import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from twinfold.llm import jaccard


def plain_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def plain_components(texts, percent=80):
    sets = [plain_set(t) for t in texts]
    of = list(range(len(texts)))
    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                low, high = sorted((of[i], of[j]))
                of = [low if c == high else c for c in of]
    return [len(s) for s in sets], of


def fixture_texts(seed):
    """Short and long texts, near copies at all distances around the limit, chains of edits, shared passages."""
    rng = random.Random(seed)
    passage = [f"p{i}" for i in range(30)]
    texts = ["", " \n", "one", "ONE", "a b c d", "a b c d e", "É x", "é x"]
    for _ in range(30):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.choice((5, 8, 9, 13, 30, 70, 150)))]
        if rng.random() < 0.5:
            base = passage[: rng.randint(10, 30)] + base
        words = base
        for _ in range(rng.randint(1, 6)):
            texts.append(" ".join(words).upper() if rng.random() < 0.2 else " ".join(words))
            words = list(words if rng.random() < 0.5 else base)
            for _ in range(rng.randint(0, 1 + len(words) // 25)):
                words[rng.randrange(len(words))] = f"e{rng.randrange(999)}"
    return texts


@pytest.mark.parametrize("seed", [1])
def test_components_equal_all_pairs(spark, seed):
    texts = fixture_texts(seed)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    sizes, of = plain_components(texts)
    out = {r.doc_id: r for r in jaccard.linked_groups(docs).collect()}
    assert [out[i].n_shingles for i in range(len(texts))] == sizes
    assert [out[i].component_id for i in range(len(texts))] == of
    assert any(n > 2 for n in Counter(of).values())


@pytest.mark.parametrize("boundary", [0, 12, 32, 64])
def test_linked_sets_meet_within_reach_under_every_boundary_and_order(spark, boundary):
    places = spark.range(1, 130).select("id", F.explode(F.sequence(F.lit(0), F.lit(700))).alias("place"))
    reach = jaccard.reach_at(F.col("place"), F.col("id"), boundary, 80).alias("reach")
    reach_of = {(r.id, r.place): r.reach for r in places.select("id", "place", reach).collect()}
    rng = np.random.default_rng(boundary)
    for _ in range(400):
        n = int(rng.integers(4, 90))
        base = rng.choice(1 << 40, size=n + 30, replace=False).astype(np.uint64)
        a = np.sort(base[:n])
        drop, add = int(rng.integers(0, n // 4 + 1)), int(rng.integers(0, n // 4 + 1))
        b = np.sort(np.concatenate([base[drop:n], base[n : n + add]]))
        shared = n - drop
        common = np.sort(rng.choice(base, size=20, replace=False))
        ranks = rng.permutation(20) + 1
        reach = []
        for s in (a, b):
            found = jaccard.entries(jaccard.ordered(s, common, ranks), len(s), boundary).tolist()
            reach.append({key: reach_of[len(s), place] for place, key in enumerate(found)})
        if 100 * shared >= 80 * (n + len(b) - shared):
            assert max(min(reach[0][k], reach[1][k]) for k in reach[0].keys() & reach[1].keys()) >= shared


def test_smallest_sets_link_with_larger_ones(spark):
    """Four shingles of five are 80 %: a text of eight words links with itself plus a ninth word; three of four do not."""
    texts = []
    for i in range(3):
        words = [f"s{i}w{j}" for j in range(8)]
        texts += [words, words + ["z"]] if i == 0 else [words, ["z"] + words] if i == 1 else [words[:7], words]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    out = dict(jaccard.linked_groups(spark.createDataFrame(rows, "doc_id bigint, text string")).select("doc_id", "component_id").collect())
    assert out == {0: 0, 1: 0, 2: 2, 3: 2, 4: 4, 5: 5}


@pytest.mark.parametrize("percent", [50, 75, 80, 90, 100])
def test_sets_that_get_no_keys_can_link_with_no_other_size(percent):
    for n in range(1, 60):
        others = [m for m in range(1, 200) if m != n and 100 * min(n, m) >= percent * max(n, m)]
        assert jaccard.links_beyond_itself(n, percent) == bool(others)


def test_boundary_follows_the_cost():
    assert jaccard.cheapest_boundary({20: 100, 40: 100}, 1.0) == 0
    assert jaccard.cheapest_boundary({20: 100, 40: 100}, 500.0) > 40


def test_components_of_long_chains(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1001), (1001, 1002), (1000, 1002), (7, 7)]
    out = dict(jaccard.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect())
    assert {out[i] for i in range(61)} == {0} and {out[i] for i in (1000, 1001, 1002)} == {1000}


def test_edge_rows(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(5, text, 1), (5, text, 2), (None, text, 3), (4, text + " x", 4), (None, None, 5), (7, None, 6), (8, "", 7)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n int")
    out = sorted((str(r.doc_id), r.n_shingles, r.component_id) for r in jaccard.linked_groups(docs).collect())
    assert out == [("4", 57, 4), ("5", 56, 4), ("5", 56, 4), ("7", 0, 7), ("8", 0, 8), ("None", 0, None), ("None", 56, 4)]
    assert jaccard.linked_groups(docs.limit(0)).count() == 0


def test_one_row_of_each_group_stays(spark):
    words = [f"w{i}" for i in range(60)]
    text, near, other = " ".join(words), " ".join([*words, "x"]), " ".join(f"o{i}" for i in range(40))
    rows = [
        (5, text, "a"), (5, text, "b"), (4, near, "c"), (4, near, "c"), (4, other, "d"), (6, other, "e"), (None, text, "f"),
        (7, None, "g"), (7, None, "g"), (8, " ", "h"), (None, "lone words", "i"), (None, "lone words", "i"), (9, "LONE words", "j"),
    ]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, `node.x` string")
    kept = [(i, t) for i, t, _ in jaccard.one_per_group(docs).collect()]
    assert sorted(kept, key=str) == sorted([(4, near), (4, other), (7, None), (7, None), (8, " "), (9, "LONE words")], key=str)
    assert jaccard.one_per_group(docs.limit(0)).columns == docs.columns and jaccard.one_per_group(docs.limit(0)).count() == 0


def test_copies_far_from_each_other_meet_few_pairs(spark):
    """A family whose members are near its base, but not near each other: one pair per member, not one per two members."""
    rng = random.Random(8)
    base = [f"b{i}" for i in range(140)]
    texts = [" ".join(base)]
    for i in range(400):
        words = list(base)
        for _ in range(rng.choice((2, 3, 5, 7))):
            words[rng.randrange(140)] = f"e{i}x{rng.randrange(10**6)}"
        texts.append(" ".join(words))
    docs = jaccard.with_text_hash(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"))
    sizes, of = plain_components(texts)
    out = {r.doc_id: r.component for r in jaccard.judged_rows(docs).collect()}
    assert [out[i] for i in range(len(texts))] == of and len(set(of)) > 50
