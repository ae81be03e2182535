import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from twinfold.llm import bpe


@pytest.fixture(scope="module")
def ranks():
    return bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))


def library(ranks):
    order = {t: i for i, t in enumerate(bpe.parse_ranks(ranks))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=order, special_tokens={})


def ids_of(packed):
    return np.frombuffer(packed, dtype="<u4").tolist()


def naive_merge(word, order):
    parts = [bytes([b]) for b in word]
    while len(parts) > 1:
        ranked = [(order.get(parts[i] + parts[i + 1], 1 << 30), i) for i in range(len(parts) - 1)]
        rank, i = min(ranked)
        if rank == 1 << 30:
            break
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return [order[p] for p in parts]


@pytest.mark.parametrize("size", [256, 300, 700, 3000])
def test_first_ranks_equal_replayed_merges(ranks, size):
    rng, tokens = random.Random(size), bpe.parse_ranks(ranks)[:size]
    order, made = {t: i for i, t in enumerate(tokens)}, bpe.ByteBpe(tokens, r"\S+|\s+")
    for alphabet in (b"etaoin shr", b"ein", b" theand", bytes(range(256))):
        for _ in range(300):
            word = bytes(rng.choice(alphabet) for _ in range(rng.randint(1, 40)))
            assert ids_of(made.encode_word(word)) == naive_merge(word, order)


def test_equals_library_on_odd_texts(ranks):
    ours, theirs, rng = bpe.coder(ranks, public_tokenizers.PATTERN), library(ranks), random.Random(1)
    texts = ["", " ", "\n", " \n x", "a" * 20_000, " " * 5000 + "x", "=-" * 9000, "<|endoftext|>", "x\n\ny \n z", "  a"]
    alphabets = ("etaoin shrdlu", "aA bB\n\t ", " \n\r\t\x0b\x0c\x1c\x1f\x85\xa0x", "'s't'll 12 3", "éèß日本語 ", "!?-= _#", "🙂́ x")
    texts += ["".join(rng.choice(a) for _ in range(rng.randint(0, 60))) for a in alphabets for _ in range(400)]
    for text in texts:
        assert ids_of(ours.encode(text)) == theirs.encode_ordinary(text), repr(text)


def test_query_digests(spark, folder, ranks):
    from twinfold.llm.queries import QUERIES

    texts = dict(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect())
    theirs = library(ranks)
    rows = QUERIES["op1_byte_bpe"](spark, folder).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        ids = np.asarray(theirs.encode_ordinary(texts[r.doc_id]), dtype="<u4")
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(ids.tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_edge_rows(spark, ranks):
    rows = [(1, None, "x"), (None, "a b", None), (2, "a b", ""), (2, "a b", ""), (3, "", "y")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    encoded = bpe.encode_texts(docs, ranks, public_tokenizers.PATTERN)
    out = bpe.decode_ids(encoded, ranks).collect()
    assert sorted((str(r.doc_id), r.n_tokens, bytes(r.decoded)) for r in out) == [
        ("1", 0, b""), ("2", 2, b"a b"), ("2", 2, b"a b"), ("3", 0, b""), ("None", 2, b"a b"),
    ]
    assert bpe.encode_texts(docs.limit(0), ranks, public_tokenizers.PATTERN).count() == 0
    with pytest.raises(ValueError):
        bpe.parse_ranks(b"YQ== 0\nYg== 2\n")
