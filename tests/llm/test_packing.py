import random
import time
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from twinfold.llm import common, matrices, packing, tokens

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def vocabulary():
    return tokens.read_vocabulary(PATH)


def library():
    return Tokenizer.from_file(PATH)


def expected_ids(texts):
    found = library().encode_batch([t or "" for t in texts], add_special_tokens=False)
    return [[*e.ids, 2] for e in found]


def test_ids_equal_library(vocabulary):
    rng, theirs, ours = random.Random(4), library(), tokens.tokenizer(vocabulary)
    alphabets = ("abc XYZ .,'s't'll 12", "ÀÉßñé ’'", "ΣΑς ΣÁé   \x1c\x85x", "日本 İİ.", "<|endoftext|> . ", "!?.,a \t\n\x0b")
    texts = ["".join(rng.choice(a + rng.choice(alphabets)) for _ in range(rng.randint(0, 40))) for a in alphabets for _ in range(300)]
    texts += ["", "x" * 5000, "word " * 3000, "a<|endoftext|>B<|ENDOFTEXT|><|startoftext|><|startoftext|>é<|endoftext| >", "<|endoftext|>"]
    for text, ids in zip(texts, ours.encode_all(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == theirs.encode(text, add_special_tokens=False).ids, repr(text)


def test_best_fit_takes_the_tightest_window():
    rng = random.Random(6)
    for window in (1, 2, 7, 64, 100):
        lengths = sorted((rng.randint(1, window) for _ in range(rng.randint(0, 300))), reverse=True)
        room = []
        for length, (at, offset) in zip(lengths, packing.best_fit(lengths, window)):
            fitting = [r for r in room if r >= length]
            if fitting:
                assert room[at] == min(fitting)
            else:
                assert at == len(room)
                room.append(window)
            assert offset == window - room[at]
            room[at] -= length


def check_pieces(rows, wanted, window):
    """Every id in one piece, pieces where they claim to be, sequences gapless and not over the window."""
    documents, sequences = {}, {}
    for r in rows:
        documents.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    assert documents.keys() == wanted.keys()
    for doc_id, parts in documents.items():
        at = 0
        for r in sorted(parts, key=lambda r: r.start):
            ids = np.asarray(wanted[doc_id][r.start : r.start + r.length], "<u4")
            assert r.start == at and r.doc_tokens == len(wanted[doc_id]) and r.ids_crc32 == zlib.crc32(ids.tobytes())
            at += r.length
        assert at == len(wanted[doc_id])
    for parts in sequences.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= window
    return len(sequences)


def test_query_packs_all_documents(spark, folder):
    from twinfold.llm.queries import QUERIES

    texts = dict(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect())
    wanted = dict(zip(texts, expected_ids(texts.values())))
    used = check_pieces(QUERIES["op10_packing"](spark, folder).collect(), wanted, 4096)
    assert used == -(-sum(map(len, wanted.values())) // 4096)


ROWS = [(1, None, "x"), (2, "", None), (3, "a b c d e f g h i j k", "y"), (None, "null id", "z"), (4, "one", "z"), (4, "one", "z")]


def test_edge_rows(spark, vocabulary):
    docs = spark.createDataFrame(ROWS, "doc_id bigint, text string, start string")
    out = packing.pack(docs, vocabulary, window=4, per_group=2)
    rows = out.collect()
    twice = [r for r in rows if r.doc_id == 4]
    assert len(twice) == 2 and len({(r.sequence_id, r.offset) for r in twice}) == 2
    wanted = dict(zip([r[0] for r in ROWS], expected_ids([r[1] for r in ROWS])))
    for doc_id in (1, 2, 3, None):
        parts = sorted((r for r in rows if r.doc_id == doc_id), key=lambda r: r.start)
        assert sum(r.length for r in parts) == len(wanted[doc_id]) and all(r.length <= 4 for r in parts)
    assert sorted(map(tuple, out.collect()), key=str) == sorted(map(tuple, rows), key=str)
    assert packing.pack(docs.limit(0), vocabulary).count() == 0


def test_matrices_hold_every_document(spark, vocabulary, tmp_path):
    docs = spark.createDataFrame(ROWS, "doc_id bigint, text string, ids string")
    matrices.write_matrices(matrices.token_matrices(docs, vocabulary, window=8, per_group=3, pad_id=9), str(tmp_path / "m"))
    parts = {}
    for r in spark.read.parquet(str(tmp_path / "m")).collect():
        ids, positions = np.frombuffer(r.ids, "<u2"), np.frombuffer(r.position_ids, "<u2")
        assert len(ids) == len(positions) == 8 and r.cu_seqlens[-1] == r.n_tokens and set(ids[r.n_tokens :]) <= {9}
        for doc_id, start, a, b in zip(r.doc_ids, r.starts, r.cu_seqlens, r.cu_seqlens[1:]):
            assert positions[a:b].tolist() == list(range(b - a))
            parts.setdefault(doc_id, []).append((start, ids[a:b].tolist()))
    for (doc_id, *_), ids in zip(ROWS, expected_ids([r[1] for r in ROWS])):
        whole = [i for _, part in sorted(parts[doc_id]) for i in part]
        assert whole == ids * (2 if doc_id == 4 else 1)
    assert matrices.token_matrices(docs.limit(0), vocabulary).count() == 0


def test_matrix_query(spark, folder):
    from twinfold.llm.queries import QUERIES

    rows = QUERIES["op8_token_matrices"](spark, folder).collect()
    texts = dict(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect())
    assert sum(r.n_tokens for r in rows) == sum(map(len, expected_ids(texts.values())))
    assert {d for r in rows for d in r.doc_ids} == set(texts)


def test_few_long_texts_and_equal_rows_are_dealt_out(spark, vocabulary):
    rows = [(None, None)] * 3000 + [(1, "w " * 60_000), (2, "v " * 50_000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = packing.pieces(docs, vocabulary, window=64)
    sizes = packing.dealt(found, docs, per_group=300).rdd.mapPartitions(lambda part: [sum(1 for _ in part)]).collect()
    assert len(sizes) >= 10 and sum(sizes) == found.count() and max(sizes) <= 2 * sum(sizes) / len(sizes)
    packed = packing.pack(docs, vocabulary, window=64, per_group=300).collect()
    assert len(packed) == found.count() and sum(r.length for r in packed) == 3000 + 110_002


def test_tasks_that_place_pieces_hold_no_remembered_parts(vocabulary):
    tokens.tokenizer(vocabulary).encode_all(["a few words"])
    columns = {"doc_id": [1, 2], "start": [0, 0], "length": [3, 5], "ids_crc32": [7, 8], "doc_tokens": [3, 5]}
    placed = list(packing.place_batches(iter([pa.RecordBatch.from_pydict(columns)]), 8))
    assert [r["offset"] for b in placed for r in b.to_pylist()] == [0, 5]
    assert tokens._tokenizer.cache_info().currsize == 0


def test_scans_below_text_operators_decode_few_rows_at_once(spark, vocabulary):
    spark.conf.unset("spark.sql.parquet.columnarReaderBatchSize")
    packing.pieces(spark.createDataFrame(ROWS, "doc_id bigint, text string, start string"), vocabulary)
    assert int(spark.conf.get("spark.sql.parquet.columnarReaderBatchSize")) == common.SCAN_ROWS < 4096


def test_different_parts_are_read_in_one_call(vocabulary):
    """A batch has many different parts; a scalar object for each took more time than the rest of known parts."""
    parts = ["", "a\0b", "日本", "ÀÉ", *(f"part{i}" for i in range(100_000))]
    array = pa.array(parts, pa.large_string())
    assert tokens._strings(array) == parts and tokens._strings(array[:0]) == []
    assert tokens._strings(array[2:]) == parts[2:]

    def seconds(fn):
        began = time.process_time()
        fn()
        return time.process_time() - began

    one_by_one, at_once = (min(seconds(f) for _ in range(3)) for f in (array.to_pylist, lambda: tokens._strings(array)))
    assert at_once < one_by_one / 2
