import hashlib
import random
import re

from twinfold.llm import pii

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n // 10 + n % 10
    return total % 10 == 0


def plain_base(text):
    """The patterns as they stand, each followed by its check."""
    found = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            good = {
                "email": True,
                "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else True,
                "card": 14 <= len(digits) <= 19 and plain_luhn(digits) if kind == "card" else True,
                "phone": 10 <= len(digits) <= 15,
            }[kind]
            if good:
                found.append((m.start(), m.end(), kind))
    return sorted(found, key=lambda x: (x[0], list(BASE).index(x[2])))


def base_of(text):
    return [(s, e, k) for s, e, k, _ in pii.find_spans(text) if k in BASE]


def test_base_spans_equal_plain_patterns():
    rng = random.Random(5)
    samples = ["a@b.c_d@e.f", "x@y", "@@a.b@c.d.e.", "1.2.3.4.5.6.7.8.9", "256.1.1.1", "001.02.3.0004", "é a@b.co"]
    for alphabet in ("ab@.-_", "0129.", "0 1-2", "+()-. 0123456789", "a1@.+- 42é\n"):
        samples += ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    for text in samples:
        assert base_of(text) == plain_base(text), text


def test_checksums_and_context():
    assert [s[2] for s in pii.find_spans("IBAN GB82 WEST 1234 5698 7654 32 THE END")] == ["iban"]
    assert pii.find_spans("IBAN GB83 WEST 1234 5698 7654 32") == []
    assert pii.find_spans("part 219-09-9998 here") == []
    assert [s[2] for s in pii.find_spans("her social security no 219-09-9998")] == ["ssn"]
    assert pii.find_spans("number 021000021 only") == []
    assert [s[2] for s in pii.find_spans("bank routing 021000021 ok")] == ["routing"]
    plain, near = pii.find_spans("4539 1488 0343 6467")[0], pii.find_spans("credit card 4539 1488 0343 6467")[0]
    assert near[3] > plain[3]
    assert pii.find_spans("order 4539 1488 0343 6467")[0][3] < plain[3]


def test_addresses_with_very_many_leading_zeros():
    text = "0" * 5000 + "1.2.3.4"
    assert list(pii.addresses(text)) == [(0, len(text))]
    assert list(pii.addresses("0" * 5000 + "256.2.3.4")) == []
    assert list(pii.addresses("0" * 5000 + ".0.0.0")) == [(0, 5006)]


def test_redaction_merges_overlaps():
    text = "call +1 (555) 010-1234 or a@b.org"
    assert pii.redact(text, pii.find_spans(text)) == "call [PHONE] or [EMAIL]"


def test_edge_rows(spark):
    long = "7" * 300_000 + "." * 1000 + "a" * 300_000 + "@b.c"
    rows = [(1, None, "x"), (2, "", "x"), (2, "a@b.c", "y"), (2, "a@b.c", "y"), (None, "10.0.0.1", None), (3, long, "z")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, spans string")
    out = {}
    for r in pii.find_personal_data(docs).collect():
        out.setdefault(r.doc_id, []).append([(s.kind, s.start, s.end) for s in r.spans])
    assert out[1] == [[]] and sorted(out[2]) == [[], [("email", 0, 5)], [("email", 0, 5)]]
    assert out[None] == [[("ip", 0, 8)]]
    assert out[3] == [[("email", 0, len(long))]]
    again = pii.redact_texts(docs)
    assert again.columns == docs.columns and again.filter("text is null").count() == 1
    assert sorted(r.text for r in again.filter("doc_id = 2").collect()) == ["", "[EMAIL]", "[EMAIL]"]
    empty = docs.limit(0)
    assert pii.find_personal_data(empty).count() == 0 and pii.redact_texts(empty).count() == 0


def test_query_digest(spark, folder):
    from twinfold.llm.queries import QUERIES

    texts = dict(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect())
    rows = QUERIES["op7_personal_data"](spark, folder).collect()
    assert len(rows) == len(texts)
    for r in rows:
        base = plain_base(texts[r.doc_id])
        joined = ",".join(f"{k}:{s}:{e}" for s, e, k in base)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == x for *_, x in base) for k in BASE)
        assert set(joined.split(",")) - {""} <= set(r.spans.split(","))


def test_many_spans_take_time_in_proportion():
    import time

    def seconds(n):
        text = " ".join(f"SSN 123-45-{i % 9000 + 1000:04d} mail a{i}@b.com" for i in range(n))
        start = time.perf_counter()
        assert len(pii.find_spans(text)) >= n
        return time.perf_counter() - start

    seconds(500)
    assert seconds(16_000) < 16 * max(seconds(2000), 0.02)


def test_later_spans_never_overlap():
    import random

    rng = random.Random(2)
    for _ in range(300):
        first = [(a, a + rng.randint(1, 12)) for a in (rng.randrange(60) for _ in range(rng.randint(0, 6)))]
        taken, plain = pii.Taken(first), list(first)
        for _ in range(15):
            start = rng.randrange(60)
            end = start + rng.randint(1, 8)
            free = not any(start < b and a < end for a, b in plain)
            assert taken.free(start, end) == free
            if free:
                taken.add(start, end)
                plain.append((start, end))
