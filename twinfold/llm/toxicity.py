"""Toxicity score of whole texts by a factorization machine over hashed terms.

A term is a lower-cased word or five characters of a word with its borders. A factorization machine gives each term a
weight and a short vector; the score adds the weights of a text's terms and the dot products of every pair of their
vectors, so it learns that two terms together mean more than each alone. With the sum of the vectors known, all pairs cost
no more than one pass over the terms.

The machine is fitted on at most ``max_rows`` labelled rows, those whose ids have the smallest hashes: a fit of bounded
size in one task. Every text is scored by all its terms.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinfold.llm.common import cached_by, claim_memory, map_slices, map_texts, pick, slices

HASH_BITS = 20
GRAM = 5
MARKS = ".,;:!?\"'()[]"
WORD_CACHE = 150_000
CACHED_WORD_CHARS = 64
LOT_CHARS = 1 << 18
SCORE_SCHEMA = "doc_id bigint, score double"


@dataclass(frozen=True)
class FitConfig:
    """``max_rows``: bound of the labelled sample; ``min_z``: z value from which a term takes whole steps."""

    max_rows: int = 12_000
    min_z: float = 4.0
    factors: int = 4
    epochs: int = 20
    batch: int = 256
    rate: float = 0.1
    decay: float = 1e-4
    seed: int = 7


def hashed(term: str) -> int:
    return zlib.crc32(term.encode()) & ((1 << HASH_BITS) - 1)


def word_terms(word: str) -> tuple[int, ...]:
    """Hashed terms of one lower-cased word: itself without marks around it, and its runs of characters."""
    word = word.strip(MARKS)
    framed = f"<{word}>"
    return tuple({hashed(f"={word}"), *(hashed(framed[i : i + GRAM]) for i in range(max(1, len(framed) - GRAM + 1)))})


@lru_cache(maxsize=None)
def _changes(size: int) -> tuple[int, list[np.ndarray]]:
    """CRC-32 of strings of one size is linear in their bits: that of zeros, and what each byte changes at each place."""
    zeros = zlib.crc32(bytes(size))
    changes = [[zlib.crc32(bytes(i) + bytes([b]) + bytes(size - 1 - i)) ^ zeros for b in range(256)] for i in range(size)]
    mask = (1 << HASH_BITS) - 1
    return zeros & mask, [np.array([c & mask for c in of_place], dtype=np.int32) for of_place in changes]


def many_terms(words: list[str], places: np.ndarray | None = None) -> list[tuple[int, ...]]:
    """``word_terms`` of words without marks that have a whole run with their borders, all in one pass; a term may be listed
    twice. With ``places`` the place of each term, without those that have none."""
    if not words:
        return []
    chars = np.frombuffer("".join([f"<{w}>" for w in words]).encode(), dtype=np.uint8)
    begins = np.append(np.flatnonzero((chars & 0xC0) != 0x80), len(chars))
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 2)
    terms = np.zeros(len(begins) - 1, dtype=np.int32)
    sizes = begins[GRAM:] - begins[:-GRAM]
    for size in np.flatnonzero(np.bincount(sizes)).tolist():
        runs = np.flatnonzero(sizes == size)
        zeros, changes = _changes(size)
        found = np.full(len(runs), zeros, dtype=np.int32)
        for i, change in enumerate(changes):
            found ^= change[chars[begins[runs] + i]]
        terms[runs] = found
    # no run begins at the last characters of a word: the first of these places takes the whole word, the others nothing
    terms[ends - GRAM + 1] = [hashed(f"={w}") for w in words]
    kept = np.ones(len(terms), dtype=bool)
    for i in range(1, GRAM - 1):
        kept[ends - i] = False
    if places is not None:
        terms = places[terms]
        kept &= terms >= 0
    flat, cuts = terms[kept].tolist(), np.cumsum(kept)[ends - 1].tolist()
    return [tuple(flat[a:b]) for a, b in zip([0, *cuts], cuts)]


class _Terms(dict):
    """Remembered terms of words, cut down to those that a model knows: ``places`` has -1 for the others."""

    def __init__(self, places: np.ndarray | None):
        super().__init__()
        self._places = places

    def __missing__(self, word: str) -> tuple[int, ...]:
        terms = word_terms(word)
        if self._places is not None:
            terms = tuple(p for p in self._places[list(terms)].tolist() if p >= 0)
        if len(word) <= CACHED_WORD_CHARS:
            self[word] = terms
        return terms

    def meet(self, words: set[str]) -> None:
        """Remember the terms of new words, most of them in one pass; others are found when they are asked for. Beyond
        ``WORD_CACHE`` words all are forgotten first, so that those of one call stay."""
        if len(self) >= WORD_CACHE:
            self.clear()
        new = [w for w in words if w not in self and len(w) <= CACHED_WORD_CHARS]
        bare = [w.strip(MARKS) for w in new]
        whole = [len(b) >= GRAM - 2 for b in bare]
        self.update(zip(compress(new, whole), many_terms(list(compress(bare, whole)), self._places)))


def text_terms(texts: list[str | None], known: _Terms) -> Iterator[np.ndarray]:
    """The distinct terms of each whole text in rising order; none for null."""
    for lot in _lots(texts):
        words = [set(t.lower().split()) for t in lot]
        known.meet(set().union(*words))
        for some in words:
            terms = set().union(*map(known.__getitem__, some))
            found = np.fromiter(terms, dtype=np.int32, count=len(terms))
            found.sort()
            yield found


def _lots(texts: list[str | None]) -> Iterator[list[str]]:
    """The texts in lots of about ``LOT_CHARS`` characters, or of a single longer text."""
    lot, chars = [], 0
    for text in texts:
        text = text or ""
        if lot and chars + len(text) > LOT_CHARS:
            yield lot
            lot, chars = [], 0
        lot.append(text)
        chars += len(text)
    if lot:
        yield lot


class Machine:
    """Weights and vectors of the terms, with the scoring rule."""

    def __init__(self, terms: np.ndarray, bias: float, weights: np.ndarray, vectors: np.ndarray):
        self.terms, self.bias, self.weights, self.vectors = terms, bias, weights, vectors
        self._rows = None

    def margins(self, places: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Score before squashing for ``n`` texts whose term places are listed with their rows; also the vector sums."""
        own = self.vectors[places]
        sums = np.stack([np.bincount(rows, own[:, f], minlength=n) for f in range(own.shape[1])], axis=1)
        squares = np.bincount(rows, (own**2).sum(axis=1), minlength=n)
        pairs = 0.5 * ((sums**2).sum(axis=1) - squares)
        return self.bias + np.bincount(rows, self.weights[places], minlength=n) + pairs, sums

    def scores(self, texts: list[np.ndarray]) -> np.ndarray:
        """Scores of texts given by places of their terms in this machine."""
        if self._rows is None:  # weight, vector and half its squared length of a term side by side
            half = 0.5 * (self.vectors**2).sum(axis=1, keepdims=True)
            self._rows = np.hstack([self.weights[:, None] - half, self.vectors]).astype(np.float32)
        found = np.full(len(texts), self.bias)
        for i, places in enumerate(texts):
            if len(places):
                sums = self._rows[places].sum(axis=0, dtype=np.float64)
                found[i] += sums[0] + 0.5 * (sums[1:] @ sums[1:])
        return squash(found)


def squash(margin: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(margin, -35, 35)))


def step_rates(texts: list[np.ndarray], toxic: np.ndarray, config: FitConfig) -> tuple[np.ndarray, np.ndarray]:
    """All hashed terms of the texts in rising order, and the step size of each.

    A term whose share differs between the classes by a z value of ``min_z`` takes whole steps. Any other may still matter
    together with another term; it takes steps smaller by the root of the mean number of terms of a text, as a text has
    many of them and they move its score together.
    """
    counts = np.zeros((2, 1 << HASH_BITS))
    for terms, label in zip(texts, toxic):
        counts[int(label), terms] += 1
    n = np.array([max(1, (toxic == 0).sum()), max(1, (toxic == 1).sum())])
    times = counts.sum(axis=0)
    share = times / n.sum()
    spread = np.sqrt(np.maximum(share * (1 - share), 1e-12) * (1 / n[0] + 1 / n[1]))
    z = np.abs(counts[1] / n[1] - counts[0] / n[0]) / spread
    z[times < 3] = 0
    seen = np.flatnonzero(times)
    small = config.rate / np.sqrt(max(1.0, times.sum() / max(1, len(texts))))
    return seen, np.where(z[seen] >= config.min_z, config.rate, small)


def fit(texts: list[np.ndarray], toxic: np.ndarray, config: FitConfig) -> Machine:
    """Fit by log loss with AdaGrad in mini-batches. Without rows, or with one class only, the score is a constant."""
    n = len(texts)
    share = min(max((toxic.sum() + 0.5) / (n + 1), 1e-3), 1 - 1e-3) if n else 1e-3
    both = n and 0 < toxic.sum() < n
    terms, rates = step_rates(texts, toxic, config) if both else (np.zeros(0, dtype=np.int64), np.zeros(0))
    rng = np.random.default_rng(config.seed)
    made = Machine(
        terms, float(np.log(share / (1 - share))), np.zeros(len(terms)), rng.normal(0, 0.01, (len(terms), config.factors))
    )
    if not len(terms):
        return made
    place = np.zeros(1 << HASH_BITS, dtype=np.int32)
    place[terms] = np.arange(len(terms))
    rows = [place[t] for t in texts]
    past_w, past_v, past_b = np.full(len(terms), 1e-8), np.full((len(terms), config.factors), 1e-8), 1e-8
    here, slot = np.zeros(len(terms), dtype=bool), np.zeros(len(terms), dtype=np.int32)
    for _ in range(config.epochs):
        order = rng.permutation(n)
        for at in range(0, n, config.batch):
            some = order[at : at + config.batch]
            parts = [rows[i] for i in some]
            places = np.concatenate(parts)
            of = np.repeat(np.arange(len(some)), [len(p) for p in parts])
            # only the terms of the batch move
            here[places] = True
            live = np.flatnonzero(here)
            here[live] = False
            slot[live] = np.arange(len(live))
            own = slot[places]
            weights, vectors = made.weights[live], made.vectors[live]
            margin, sums = Machine(live, made.bias, weights, vectors).margins(own, of, len(some))
            error = (squash(margin) - toxic[some]) / len(some)
            whole = np.bincount(own, error[of], minlength=len(live))
            pull = error[:, None] * sums
            step_w = whole + config.decay * weights
            step_v = np.stack([np.bincount(own, pull[of, f], minlength=len(live)) for f in range(config.factors)], axis=1)
            step_v += (config.decay - whole[:, None]) * vectors
            past_w[live] += step_w**2
            past_v[live] += step_v**2
            past_b += error.sum() ** 2
            made.weights[live] -= rates[live] * step_w / np.sqrt(past_w[live])
            made.vectors[live] -= rates[live, None] * step_v / np.sqrt(past_v[live])
            made.bias -= config.rate * error.sum() / np.sqrt(past_b)
    return made


def is_held_out(doc_id: str) -> Column:
    """Rows kept out of learning: the CRC-32 of the id as text is divisible by 5. A null id is not."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, config: FitConfig = FitConfig()) -> bytes:
    """Fitted machine as bytes (at most ``2 ** HASH_BITS`` terms), from labelled rows that are not held out.

    A label counts once per id: repeated ones must agree, or the larger counts. Null labels and ids do not count.
    """
    known = pick(labels, doc_id="doc_id", toxic="toxic").dropna().filter(~is_held_out("doc_id"))
    sample = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sample = sample.orderBy(F.xxhash64("doc_id"), "doc_id").limit(config.max_rows)
    # the sample has at most max_rows rows of two numbers: broadcast it, so that texts are not shuffled
    rows = pick(docs, doc_id="doc_id", text="text").join(F.broadcast(sample), "doc_id")
    hashed_rows = map_slices(rows, _hash_rows, "doc_id bigint, toxic int, terms binary", "text")
    # repeated ids in docs: one row each, so that the bound holds
    once = hashed_rows.groupBy("doc_id").agg(F.first("toxic").alias("toxic"), F.min("terms").alias("terms"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("doc_id", "toxic", "terms")))]
        rows.sort(key=lambda r: r[0])
        texts = [np.frombuffer(r[2], dtype="<i4") for r in rows]
        made = fit(texts, np.array([r[1] for r in rows], dtype=np.float64), config)
        state = {"terms": made.terms.astype("<i4"), "bias": made.bias}
        state |= {"weights": made.weights.astype(np.float32), "vectors": made.vectors.astype(np.float32)}
        yield pa.RecordBatch.from_pydict({"machine": pa.array([pickle.dumps(state)], pa.binary())})

    return bytes(once.coalesce(1).mapInArrow(run, "machine binary").first()["machine"])


_all_terms = _Terms(None)
cached_by("toxicity", lambda: (_all_terms.clear(), loaded.cache_clear()))


def _hash_rows(batch: pa.RecordBatch) -> pa.RecordBatch:
    claim_memory("toxicity")
    packed = [t.astype("<i4").tobytes() for t in text_terms(batch.column("text").to_pylist(), _all_terms)]
    columns = {"doc_id": batch.column("doc_id"), "toxic": batch.column("toxic").cast(pa.int32())}
    return pa.RecordBatch.from_pydict(columns | {"terms": pa.array(packed, pa.binary())})


@lru_cache(maxsize=2)
def loaded(machine: bytes) -> tuple[Machine, _Terms]:
    made = Machine(**pickle.loads(machine))
    places = np.full(1 << HASH_BITS, -1, dtype=np.int32)
    places[made.terms] = np.arange(len(made.terms))
    return made, _Terms(places)


def text_scores(texts: list[str | None], machine: bytes) -> np.ndarray:
    claim_memory("toxicity")
    made, known = loaded(machine)
    return made.scores(list(text_terms(texts, known)))


def score_texts(df: DataFrame, machine: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score`` of every row. Null and empty texts get the score of a text without terms; repeated rows and null
    ids are kept; an empty table gives none. Only the two named columns are read."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        scores = text_scores(batch.column("text").to_pylist(), machine)
        return pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "score": pa.array(scores, pa.float64())})

    rows = pick(df, doc_id=id_col, text=text_col)
    return map_slices(rows.withColumn("doc_id", F.col("doc_id").cast("bigint")), run, SCORE_SCHEMA, "text")


def drop_toxic(df: DataFrame, machine: bytes, limit: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows whose score is below ``limit``, with all their columns."""
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col):
            yield batch.filter(pa.array(text_scores(batch.column(at).to_pylist(), machine) < limit))

    return map_texts(df, run, df.schema)
