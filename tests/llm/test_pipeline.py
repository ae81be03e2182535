import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from twinfold.llm import jaccard, pii, quality, toxicity
from twinfold.llm.common import SLICE_BYTES, map_slices, stored, table

from .test_jaccard import plain_components
from .test_packing import check_pieces
from .test_quality import plain_counts


def test_stages_against_plain_versions(spark, folder):
    """Each stage's rows against a loop over its own input."""
    docs = table(spark, folder, "documents")
    columns = docs.columns
    made = {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        machine = toxicity.learn(docs, table(spark, folder, "labels")) if name == "toxicity" else None
        docs = stored(stage(spark, docs, folder), name)
        made[name] = before, docs.collect()
        if name == "toxicity":
            scores = toxicity.text_scores([r.text for r in before.values()], machine)
            assert {r.doc_id for r in made[name][1]} == {i for i, s in zip(before, scores) if s < 0.5}
        if name != "packing":
            assert docs.columns == columns
            assert name == "personal_data" or all(before[r.doc_id] == r for r in made[name][1])
    before, after = made["quality"]  # too few labels here for any cutoff: the base rules decide
    counts = {i: plain_counts(r.text) for i, r in before.items()}
    assert {r.doc_id for r in after} == {i for i, c in counts.items() if c[0] >= quality.MIN_WORDS and 2 * c[4] <= c[0]}
    before, after = made["near_copies"]
    ids = sorted(before)
    _, of = plain_components([before[i].text for i in ids])
    assert {r.doc_id for r in after} == {i for k, i in enumerate(ids) if of[k] == k}
    before, after = made["personal_data"]
    assert len(after) == len(before)
    for r in after:
        clean = pii.redact(before[r.doc_id].text, pii.find_spans(before[r.doc_id].text))
        assert (r.text, r.n_chars) == (clean, len(clean))
    before, after = made["packing"]
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    library.encode_special_tokens = True
    wanted = {i: [*library.encode(r.text, add_special_tokens=False).ids, 2] for i, r in before.items()}
    check_pieces(after, wanted, 4096)
    assert zlib.crc32(np.asarray(wanted[after[0].doc_id], "<u4").tobytes()[4 * after[0].start :][: 4 * after[0].length]) == after[0].ids_crc32


def test_texts_come_in_batches_of_bounded_bytes(spark):
    def held(batch):  # a slice shares the buffers of its whole batch
        return pa.RecordBatch.from_pydict({"bytes": [batch.column("text").buffers()[2].size]})

    texts = spark.range(0, 6000, 1, 1).select(F.repeat(F.lit("0123456789"), 200).alias("text"))
    assert max(r.bytes for r in map_slices(texts, held, "bytes bigint", "text").collect()) <= 2 * SLICE_BYTES


def test_repeated_shingles_are_counted():
    rng = np.random.default_rng(3)
    for sizes in ([0], [1], [0, 3, 3], [40, 1, 0, 200]):
        sets = [np.unique(rng.integers(0, 60, n).astype(np.uint64)) for n in sizes]
        values, times = np.unique(np.concatenate(sets), return_counts=True)
        found = jaccard._repeated(sets)
        assert not sets  # let go before the counting
        assert found.column("shingle").to_pylist() == values[times > 1].tolist()
        assert found.column("times").to_pylist() == times[times > 1].tolist()
