import itertools
import random
from collections import Counter

from pyspark.sql import functions as F

from twinfold.llm import filter_audit

SCHEMA = "doc_id bigint, text string, source string"
LABELS = "doc_id bigint, quality int, toxic int"


def failures(rows):
    first = {}
    for doc_id, text, _ in rows:
        if doc_id is not None:
            first[text or ""] = min(doc_id, first.get(text or "", doc_id))
    for doc_id, text, source in rows:
        text = text or ""
        words = text.encode().split()
        yield doc_id, source or "", {
            "A": len(words) < 50,
            "B": 100 * len(set(words)) < 65 * len(words),
            "C": 100 * sum("A" <= c <= "Z" for c in text) > 5 * len(text),
            "D": any(c in "#$%&*|" for c in text),
            "E": doc_id is not None and doc_id > first[text],
        }


def expected(rows, labels):
    """One order and one document after the other."""
    good, toxic = {i for i, q, _ in labels if q == 1}, {i for i, _, t in labels if t == 1}
    counts, removed = {}, Counter()
    for doc_id, part, fails in failures(rows):
        for order in map("".join, itertools.permutations("ABCDE")):
            gone = False
            for step, name in enumerate(order, 1):
                here = counts.setdefault((part, order, step), [0] * 6)
                here[3] += fails[name] and sum(fails.values()) == 1
                here[2] += fails[name] and gone
                if fails[name] and not gone:
                    gone = True
                    here[1] += 1
                    here[4] += doc_id in good
                    here[5] += doc_id in toxic
                    removed[part, name] += 1
                here[0] += not gone
    return sorted((*k, *v, removed[k[0], k[1][k[2] - 1]]) for k, v in counts.items())


def made_rows():
    rng = random.Random(11)
    words = [f"w{i}" for i in range(90)]
    rows = []
    for i in range(220):
        text = " ".join(rng.choice(words[: rng.choice((20, 90))]) for _ in range(rng.choice((10, 49, 50, 80))))
        text = text.upper() if rng.random() < 0.2 else text
        text += rng.choice(["", "", " #", "|", "\x0bé"])
        rows.append((rng.choice([None, i, i, i]), rng.choice([None, text, text, "", "same " * 60]), rng.choice([None, "", "a", "hot", "hot"])))
    rows += [(3, "twice " * 55, "a")] * 3 + [(2, "twice " * 55, "b")] * 2 + [(5, "long word " * 30_000, "b")]
    labels = [(i, rng.choice([None, 0, 1]), rng.choice([None, 0, 1])) for i in [None, *range(200), *range(40)]]
    return rows, labels


def test_equals_plain_loops(spark):
    rows, labels = made_rows()
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({"part": F.lit("no"), "mask": F.lit(1), "digest": F.lit(0), "quality": F.lit(1)})
    marks = spark.createDataFrame(labels, LABELS).withColumns({"good": F.lit(True), "text": F.lit("x")})
    wanted = expected(rows, labels)
    for n in (1, 7):
        assert sorted(map(tuple, filter_audit.audit(docs.repartition(n), marks).collect())) == wanted


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    no_labels = spark.createDataFrame([], LABELS)
    assert filter_audit.audit(none, no_labels).collect() == []
    rows = [(1, "a", "s")]
    assert sorted(map(tuple, filter_audit.audit(spark.createDataFrame(rows, SCHEMA), no_labels).collect())) == expected(rows, [])


def test_fields_do_not_overflow():
    for times in (1, 3, 1023):
        bits = times.bit_length() + 1
        packed = filter_audit.wide_integers(bits)
        for key in ((0, True, True), (31, True, True), (4, False, True)):
            ones = [v for order in filter_audit.ORDERS for row in filter_audit.step_outcomes(*key, order) for v in row]
            assert filter_audit.unpacked(packed[key] * times, bits) == [v * times for v in ones]


def test_many_parts_are_summed_in_pieces(spark, monkeypatch):
    rows = [(i, "word " * (i % 70), f"s{i % 5}") for i in range(300)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(9)
    assert sorted(map(tuple, filter_audit.audit(docs, spark.createDataFrame([], LABELS)).collect())) == expected(rows, [])
    held = [filter_audit._sum_batch({f"p{i}": i}, 3) for i in range(4)]
    again = [filter_audit._sum_batch({"p3": 9}, 3)]
    assert list(filter_audit._merged(iter(held + again))) == [("p0", 3, 0), ("p1", 3, 1), ("p2", 3, 2), ("p3", 3, 12)]
