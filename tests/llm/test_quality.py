import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from twinfold.llm import quality
from twinfold.llm.common import pick


def plain_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    under = {i + d for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for d in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (
        len(words),
        sum(map(len, words)),
        len(re.findall(r"[#*$%&|<>]", text)),
        len(lines) - len(set(lines)),
        len(under),
        len(lines),
    )


def plain_allowed(n, share, chance):
    total, best = 0.0, -1
    for k in range(int(n * share) + 1):
        total += math.comb(n, k) * share**k * (1 - share) ** (n - k)
        if total <= chance:
            best = k
    return best


def test_counts_equal_plain_loops(spark):
    rng = random.Random(3)
    texts = [None, "", " \n\t", "one", "a b", "a a a", "a a a a", "x y z q x y z", "é #ß *\n\n \n#\n#\n", "\x0b\x0c a\rb"]
    for words in (2, 5, 40):
        vocab = [f"w{i}" for i in range(words)] + ["#", "*x", "É"]
        for _ in range(60):
            parts = [rng.choice(vocab) + rng.choice([" ", " ", "\n", "  "]) for _ in range(rng.randint(0, 120))]
            texts.append("".join(parts))
    block = " ".join(f"u{i}" for i in range(400))
    texts.append(block + " sep " + block)  # more equal hashes than are compared one by one
    texts.append("z" * 200_000 + " q" * 5000)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for r in quality.with_counts(df).collect():
        assert tuple(r["_counts"])[:6] == plain_counts(r["text"]), texts[r["doc_id"]]


def test_allowed_rejections_are_exact_binomial_bounds(spark):
    config = quality.RiskConfig(max_false_share=0.1, delta=0.5, grid=(0.5,), bands=())
    df = spark.createDataFrame([(n,) for n in (0, 1, 5, 17, 60, 250)], "n bigint")
    for n, k in df.select("n", quality.allowed_rejections(F.col("n"), config)).collect():
        assert k == plain_allowed(n, config.max_false_share, config.chance_per_test)


def junk_fixture(spark, n=1500):
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(n):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.choice((60, 90, 300)))]
        good = i % 3 > 0
        if not good:
            words = [w.upper() + "!!" for w in words]
        rows.append((i, " ".join(words)))
        labels.append((i, int(good)))
    return spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, quality int")


def test_certified_cutoffs_reject_junk_and_keep_clean(spark):
    docs, labels = junk_fixture(spark)
    config = quality.RiskConfig(max_false_share=0.25, delta=0.1, bands=(200,))
    rows = quality.with_counts(docs).drop("text").cache()
    cutoffs = quality.certified_cutoffs(rows, labels, config)
    assert cutoffs.count() == 2
    out = quality.judged(rows, cutoffs, config).join(labels, "doc_id")
    counts = {(r.quality, r.kept): r["count"] for r in out.groupBy("quality", "kept").count().collect()}
    assert counts == {(1, True): 1000, (0, False): 500}


def test_too_few_labels_certify_nothing(spark):
    docs, labels = junk_fixture(spark, 30)
    rows = quality.with_counts(docs).drop("text")
    cut = quality.certified_cutoffs(rows, labels).collect()
    assert all(v is None for r in cut for k, v in r.asDict().items() if k != "stratum")
    none = labels.limit(0)
    assert quality.judged(rows, quality.certified_cutoffs(rows, none)).filter("kept").count() == 30


def test_edge_rows_and_clashing_names(spark):
    docs, labels = junk_fixture(spark, 12)
    clash = docs.withColumns({"kept": F.lit("k"), "_counts": F.lit(1), "stratum": F.lit(None).cast("int")})
    extra = spark.createDataFrame([(None, None), (1, ""), (1, "")], "doc_id bigint, text string")
    clash = clash.unionByName(extra, allowMissingColumns=True)
    noisy = labels.union(spark.createDataFrame([(None, 1), (1, None), (1, 0)], labels.schema))
    out = quality.keep_good(clash, noisy)
    assert out.columns == clash.columns and out.count() == 12
    assert quality.keep_good(docs.limit(0), labels).count() == 0


def test_no_python_in_the_plan(spark, folder):
    from twinfold.llm.queries import QUERIES

    plan = QUERIES["op3_quality_rules"](spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    assert pick(spark.range(1), a="id").columns == ["a"]


def test_steps_stop_where_good_rows_are_rejected(spark):
    """Good texts have many capitals, junk has symbols: the rule for capitals ends early, that for symbols does not."""
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(900):
        words = [f"w{rng.randrange(5000)}" for _ in range(90)]
        good = i % 4 > 0
        words = [w.upper() if rng.random() < 0.3 else w for w in words] if good else [w + "##" for w in words]
        rows.append((i, " ".join(words)))
        labels.append((i, int(good)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    marks = spark.createDataFrame(labels, "doc_id bigint, quality int")
    measured = quality.with_counts(docs).drop("text").cache()
    cut = quality.certified_cutoffs(measured, marks).first()
    assert cut.cut_symbols == 0.005 and 0.05 < cut.cut_upper < 0.5
    kept = {r.doc_id: r.kept for r in quality.judged(measured, quality.certified_cutoffs(measured, marks)).collect()}
    assert not any(kept[i] for i in range(0, 900, 4)) and sum(kept.values()) >= 0.98 * 675


def test_guarantee_holds_on_simulated_labels(spark):
    """Rules that reject just over the allowed share of good texts are certified in few of many trials."""
    config = quality.RiskConfig(max_false_share=0.05, delta=0.1, grid=(0.5,), bands=())
    rng, wrong = random.Random(9), 0
    limits = dict(spark.range(200, 400).select("id", quality.allowed_rejections(F.col("id"), config)).collect())
    for _ in range(2000):
        n = rng.randrange(200, 400)
        wrong += sum(rng.random() < 0.051 for _ in range(n)) <= limits[n]
    assert wrong / 2000 <= 0.12


def test_documents_are_rejected_beyond_the_base_rules(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    some = docs.join(labels.select("doc_id"), "doc_id", "semi")
    rows = quality.with_counts(some.select("doc_id", "text")).drop("text").cache()
    out = quality.judged(rows, quality.certified_cutoffs(rows, labels)).join(labels, "doc_id").filter("not base_failed")
    counts = {(r.quality, r.kept): r["count"] for r in out.groupBy("quality", "kept").count().collect()}
    assert counts[0, False] > 100 and counts.get((1, False), 0) <= 0.02 * counts[1, True]


def test_verdict_plans_hold_no_making_of_the_cutoffs(spark, folder):
    """The driver optimizes a plan anew whenever a part of the query ends: texts are measured once in the one that keeps rows."""
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    plan = quality.keep_good(docs, labels)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate ") == 1 and "Aggregate" not in plan
