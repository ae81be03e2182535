import hashlib
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from twinfold.llm import sharding, urls

PAGES = [
    (1, "http://A.Example.ORG/en/12?x=/es/", '<a href="https://bad.net/x">'),
    (2, "https://example.org/es/a#b", None),
    (3, "ftp://x.org", "href=//good.net"),
    (4, "http://shop.com/de/1", ""),
    (5, "http://shop.com/de/2", ""),
    (6, "http://shop.com/de/3", ""),
    (7, "http://shop.com/en/1", ""),
    (8, "http://friend.net/p", "<A HREF='HTTP://Shop.com/q'> href=\"http://friend.net/self\""),
    (9, "http://other.net/p", "<p>text</p>"),
    (10, None, "x"),
    (11, "no scheme/de/", "x"),
    (12, "://com/fr/", ""),
    (None, "http://com/fr/", ""),
    (1, "http://aexample.org/es/", ""),
]


def test_rules_and_reputation(spark, monkeypatch):
    df = spark.createDataFrame(PAGES, "page_id bigint, url string, html string")
    out = urls.judged_urls(df.withColumns({"host": F.lit("clash"), "verdict": F.lit(1)}))
    rows = {}
    for r in out.collect():
        rows.setdefault(r.page_id, []).append((r.host, r.path, r.rule, r.verdict))
    assert sorted(rows[1]) == [
        ("a.example.org", "/en/12", "example.org/en/1", "block"), ("aexample.org", "/es/", "org/", "allow"),
    ]
    assert rows[2] == [("example.org", "/es/a", "example.org/es/", "block")]
    assert rows[3] == [("x.org", "", None, "allow")]
    assert rows[4] == [("shop.com", "/de/1", "com/de/", "block")]
    assert rows[7] == [("shop.com", "/en/1", None, "block")]  # three of its pages are blocked, none allowed
    assert rows[8] == [("friend.net", "/p", None, "block")]  # links to it
    assert rows[9] == [("other.net", "/p", None, "allow")]
    assert rows[10] == rows[11] == [("", "", None, "allow")]
    assert rows[12] == rows[None] == [("com", "/fr/", "com/fr/", "allow")]
    assert urls.judged_urls(df.limit(0)).count() == 0


def test_walks_equal_a_plain_loop(spark):
    links = [("a", "b", 2.0), ("a", "c", 1.0), ("b", "c", 1.0), ("c", "a", 3.0), ("d", "c", 1.0)]
    out_of, into = Counter(), Counter()
    for s, t, w in links:
        out_of[s] += w
        into[t] += w
    edges = [(s, t, w / out_of[s], w / into[t]) for s, t, w in links]
    seeds = {"a": (3.0, 0.0), "c": (0.0, 2.0)}
    base = {h: (0.15 * x, 0.15 * y) for h, (x, y) in seeds.items()}
    now = dict(base)
    for _ in range(200):
        new = {h: list(v) for h, v in base.items()}
        for s, t, po, pi in edges:
            new.setdefault(t, [0, 0])[0] += 0.85 * now.get(s, (0, 0))[0] * po
            new.setdefault(s, [0, 0])[1] += 0.85 * now.get(t, (0, 0))[1] * pi
        now = {h: tuple(v) for h, v in new.items()}
    df = spark.createDataFrame([(h, *v) for h, v in seeds.items()], "host string, allowed double, blocked double")
    graph = spark.createDataFrame(edges, "src string, dst string, share_out double, share_in double")
    for r in urls.reputations(df, graph).collect():
        assert (r.trust, r.distrust) == pytest.approx(now[r.host], rel=1e-4)


def test_distrust_reaches_the_end_of_a_long_chain(spark):
    pages = [(0, "http://h0.com/de/x", "")] + [(i, f"http://h{i}.net/p", f'<a href="http://h{i - 1}.{"com" if i == 1 else "net"}/">') for i in range(1, 15)]
    pages.append((99, "http://clean.net/p", '<a href="http://h3.org/">'))
    out = urls.judged_urls(spark.createDataFrame(pages, "page_id bigint, url string, html string"))
    assert {r.page_id for r in out.collect() if r.verdict == "block"} == set(range(15))


def plain_table(names, slots):
    """Every shard's whole order, then turns."""
    orders = []
    for n in names:
        d = hashlib.md5(n.encode()).hexdigest()
        first, skip = int(d[:8], 16) % slots, int(d[8:16], 16) % (slots - 1) + 1
        orders.append([(first + j * skip) % slots for j in range(slots)])
    owner = {}
    while len(owner) < slots:
        for shard, order in enumerate(orders):
            slot = next((s for s in order if s not in owner), None)
            if slot is not None:
                owner[slot] = shard
    return [owner[s] for s in range(slots)]


def test_table_is_filled_in_turns_and_even():
    for shards, slots in ((1, 7), (3, 7), (5, 101), (7, 7)):
        names = sharding.shard_names(shards)
        assert sharding.lookup_table(names, slots) == plain_table(names, slots)
    full = sharding.lookup_table(sharding.shard_names(64))
    assert max(Counter(full).values()) - min(Counter(full).values()) <= 1
    without = sharding.lookup_table(sharding.shard_names(64)[:-1])
    assert sum(a != b for a, b in zip(full, without)) < 0.1 * len(full)
    for names, slots in ((["a", "a"], 7), ([], 7), (["a"], 8), (sharding.shard_names(9), 7)):
        with pytest.raises(ValueError):
            sharding.lookup_table(names, slots)


def test_placement(spark, folder):
    rows = [("k1", 1), ("k1", 2), (None, 3), ("", 4), ("é", 5)]
    df = spark.createDataFrame(rows, "key string, slot int")
    out = sharding.place_on_shards(df, "key", sharding.shard_names(3), 101).collect()
    owner = sharding.lookup_table(sharding.shard_names(3), 101)
    for r in out:
        assert r.slot == int(hashlib.md5((r.key or "").encode()).hexdigest()[:8], 16) % 101 and r.shard == owner[r.slot]
    assert len(out) == 5 and sharding.place_on_shards(df.limit(0), "key", ["a"], 7).count() == 0
    from twinfold.llm.queries import QUERIES

    placed = QUERIES["op5_sharding"](spark, folder)
    owner = sharding.lookup_table(sharding.shard_names(sharding.SHARDS))
    for r in placed.collect():
        assert r.shard == owner[int(hashlib.md5(str(r.doc_id).encode()).hexdigest()[:8], 16) % sharding.SLOTS]
    plan = placed._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Exchange hash", plan)
