"""Exact Jaccard join of documents by their word shingles, and the groups that the links form.

The join is size-aware. Every set is ordered rarest shingle first; two sets that link share at least one shingle (two
shingles) among the first ``n - ceil(t n) + 1`` (``+ 2``) of each. Small sets are entered under all pairs of these first
shingles, so only sets that share two of them meet; large sets are entered in the inverted lists of single shingles, and
so are small sets that are large enough to link with a large one. The size at which sets count as large is chosen by the
cost of both ways on the data at hand.

An entry carries its reach: how many shingles the set has from there on. Two sets that link meet under what they have in
common first, and all they share lies within the reach of both entries. So nodes meet under a key only if both reaches are
enough for their sizes. In a family of near copies the shingles of a copy's own edits stand first and use its reach up.

Links are never emitted for all pairs of a list. Sets with the same shingles are one node. In every list each node first
meets one hub, the one with the fewest shingles before the key, which is the least edited of a family; nodes that prove
linked are merged; only nodes of one list that are still in different groups and reach each other are compared one by one.
So a list of near copies costs one comparison per node, and every link between different groups is found.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from twinfold.llm.common import cached_by, claim_memory, give_back_memory, map_texts, pick, quoted, slices, stored

WORDS = 5
PERCENT = 80
COMMON_SHINGLES = 200_000
COUNTED_TOGETHER = 2_000_000
BROADCAST_ROWS = 1_000_000
HUB_ROUNDS = 3
WORD_CACHE = 300_000
CACHED_WORD_BYTES = 64
BOUNDARIES = (0, 8, 12, 16, 24, 32, 48, 64)
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_SHORT = np.uint64(0xD6E8FEB86659FD93)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(word) <= CACHED_WORD_BYTES:
            if len(self) >= WORD_CACHE:
                self.clear()
            self[word] = value
        return value


_word_hashes = _WordHashes()
cached_by("jaccard", lambda: (_word_hashes.clear(), _unpacked.cache_clear()))


def mixed(values: np.ndarray) -> np.ndarray:
    """Spread 64-bit values evenly (a bijection)."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def shingle_set(text: str | None) -> np.ndarray:
    """Distinct 64-bit hashes of the shingles of a text, in rising order.

    A-Z is lower-cased and words end at ASCII white space only. Fewer than ``WORDS`` words make one shingle of them all.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    codes = np.fromiter(map(_word_hashes.__getitem__, words), dtype=np.uint64, count=len(words))
    width = min(WORDS, len(words))
    with np.errstate(over="ignore"):
        rolled = np.full(len(words) - width + 1, _SHORT * np.uint64(width) if width < WORDS else 0, dtype=np.uint64)
        for i in range(width):
            rolled = rolled * _MULTIPLIER + codes[i : len(words) - width + 1 + i]
        return np.unique(mixed(rolled))


def node_of(shingles: np.ndarray) -> int:
    """Number of a set: equal sets have the same one."""
    return int.from_bytes(hashlib.md5(shingles.tobytes()).digest()[:8], "little", signed=True)


def least_shared(n: int, percent: int = PERCENT) -> int:
    """Shingles that any linked set shares with a set of ``n``."""
    return -(-percent * n // 100)


def links_beyond_itself(n: int, percent: int = PERCENT) -> bool:
    """Whether a set of ``n`` can link with any other set. If one larger by one is out of reach, so is one smaller by one,
    and every other set of ``n``."""
    return 100 * n >= percent * (n + 1)


def ordered(shingles: np.ndarray, common: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """Rarest first: shingles that are not in the list of common ones by hash, then the common ones by rank."""
    if not len(common):
        return shingles
    at = np.minimum(np.searchsorted(common, shingles), len(common) - 1)
    rank = np.where(common[at] == shingles, ranks[at], 0)
    return shingles[np.argsort(rank, kind="stable")]


def entries(first: np.ndarray, n: int, boundary: int, percent: int = PERCENT) -> np.ndarray:
    """Keys under which a set is entered, from its shingles in order: first even ones for pairs of shingles, by the later
    of both, then odd ones for single shingles. :func:`reach_at` tells the reach of a key from its place."""
    spare = n - least_shared(n, percent)
    keys = []
    with np.errstate(over="ignore"):
        if n <= boundary:
            some = first[: spare + 2]
            later, earlier = np.tril_indices(len(some), -1)
            keys.append(mixed(some[earlier] * _MULTIPLIER + some[later]) & ~np.uint64(1))
        if n > boundary or 100 * n >= percent * (boundary + 1):
            keys.append(mixed(first[: spare + 1] + _SHORT) | np.uint64(1))
    return np.concatenate(keys)


def reach_at(place: Column, n: Column, boundary: int, percent: int) -> Column:
    """Reach of the entry at a place: the most that the set can share with one that has this key, but nothing before it,
    in common."""
    some = F.least(n, n - F.ceil(percent * n / 100) + 2)
    pairs = F.when(n <= boundary, some * (some - 1) / 2).otherwise(F.lit(0)).cast("bigint")
    later = F.floor((1 + F.sqrt(1 + 8 * place)) / 2)
    return F.when(place < pairs, n - later + 1).otherwise(n - (place - pairs)).cast("int")


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))


def survey(df: DataFrame) -> DataFrame:
    """One pass over the texts: a row ``doc_id, at, n, node`` per document, and rows ``shingle, times`` for shingles that
    occur in several of the documents counted together (about ``COUNTED_TOGETHER`` shingles at a time)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim_memory("jaccard")
        waiting, size = [], 0
        for batch in slices(batches, "text"):
            sets = [shingle_set(t) for t in batch.column("text").to_pylist()]
            nodes = [node_of(s) for s in sets]
            none = pa.nulls(len(sets), pa.int64())
            columns = [batch.column("doc_id"), batch.column("at"), pa.array([len(s) for s in sets], pa.int64()), pa.array(nodes, pa.int64())]
            yield pa.RecordBatch.from_arrays([*columns, none, none], _SURVEY_NAMES)
            waiting += sets
            size += sum(map(len, sets))
            if size >= COUNTED_TOGETHER:
                yield _repeated(waiting)
                waiting, size = [], 0
        if waiting:
            yield _repeated(waiting)
        give_back_memory()

    return map_texts(df, run, "doc_id bigint, at bigint, n bigint, node bigint, shingle bigint, times bigint")


_SURVEY_NAMES = ["doc_id", "at", "n", "node", "shingle", "times"]


def _repeated(sets: list[np.ndarray]) -> pa.RecordBatch:
    """Shingles that are in several of the sets, with their counts. Sorted in place and the list emptied: no further copies."""
    values = np.concatenate(sets)
    sets.clear()
    values.sort()
    same = values[1:] == values[:-1]
    starts = np.flatnonzero(same & ~np.r_[False, same[:-1]])
    times = np.flatnonzero(same & ~np.r_[same[1:], False]) + 2 - starts
    values = values[starts]
    none = pa.nulls(len(values), pa.int64())
    return pa.RecordBatch.from_arrays([none, none, none, none, _signed(values), pa.array(times)], _SURVEY_NAMES)


def common_shingles(surveyed: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles, at most ``COMMON_SHINGLES``, in rising order, with ranks from 1 that rise with their
    counts. The list only orders the sets; any list gives the same links."""
    counts = surveyed.filter("shingle is not null").groupBy("shingle").agg(F.sum("times").alias("times"))
    found = counts.orderBy(F.desc("times"), "shingle").limit(COMMON_SHINGLES).toArrow()
    values = found.column("shingle").to_numpy().view(np.uint64)
    ranks = np.arange(len(values), 0, -1, dtype=np.int64)
    order = np.argsort(values)
    return values[order], ranks[order]


def list_length(surveyed: DataFrame) -> float:
    """Mean length of the inverted list of a shingle of a set: sum of squared counts over all entries."""
    counts = surveyed.filter("shingle is not null").groupBy("shingle").agg(F.sum("times").cast("double").alias("times"))
    squares = counts.agg(F.sum(F.col("times") * F.col("times"))).first()[0] or 0.0
    total = surveyed.agg(F.sum("n").cast("double")).first()[0] or 1.0
    return 1.0 + squares / max(total, 1.0)


def cheapest_boundary(sizes: dict[int, int], length: float, percent: int = PERCENT) -> int:
    """Size up to which sets are small, of :data:`BOUNDARIES`, by the lower cost: one for every pair of first shingles of a
    small set, and for every first shingle of the others one plus the length of the list to scan. ``sizes``: number of
    sets by size, sizes beyond twice the last boundary may be left out, as they are large either way."""

    def cost(boundary: int) -> float:
        total = 0.0
        for n, sets in sizes.items():
            spare = n - least_shared(n, percent)
            if n <= boundary:
                total += sets * (spare + 2) * (spare + 1) / 2
            if n > boundary or 100 * n >= percent * (boundary + 1):
                total += sets * (spare + 1) * (1 + length)
        return total

    return min(BOUNDARIES, key=cost)


def entered(df: DataFrame, common: tuple[np.ndarray, np.ndarray], boundary: int, percent: int) -> DataFrame:
    """``doc_id, at, n, keys`` of every document that can link with another set: at 80 % those of four shingles or more."""
    packed = (common[0].tobytes(), common[1].tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim_memory("jaccard")
        values, ranks = _unpacked(*packed)
        for batch in slices(batches, "text"):
            rows = []
            for *document, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "at", "text"))):
                shingles = shingle_set(text)
                n = len(shingles)
                if links_beyond_itself(n, percent):  # else only the very same set links
                    rows.append((*document, n, entries(ordered(shingles, values, ranks), n, boundary, percent)))
            offsets = pa.array(np.cumsum([0, *(len(r[3]) for r in rows)], dtype=np.int32))
            flat = np.concatenate([r[3] for r in rows]) if rows else np.zeros(0, dtype=np.uint64)
            fixed = [pa.array([r[i] for r in rows], pa.int64()) for i in range(3)]
            yield pa.RecordBatch.from_arrays([*fixed, pa.ListArray.from_arrays(offsets, _signed(flat))], ["doc_id", "at", "n", "keys"])
        give_back_memory()

    return map_texts(df, run, "doc_id bigint, at bigint, n bigint, keys array<bigint>")


@lru_cache(maxsize=2)
def _unpacked(values: bytes, ranks: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(values, dtype=np.uint64), np.frombuffer(ranks, dtype=np.int64)


def whole_sets(df: DataFrame) -> DataFrame:
    """``node, shingles`` of the rows of ``node, text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim_memory("jaccard")
        for batch in slices(batches, "text"):
            sets = [shingle_set(t) for t in batch.column("text").to_pylist()]
            offsets = np.cumsum([0, *map(len, sets)], dtype=np.int32)
            flat = pa.ListArray.from_arrays(pa.array(offsets), _signed(np.concatenate(sets)))
            yield pa.RecordBatch.from_arrays([batch.column("node"), flat], ["node", "shingles"])
        give_back_memory()

    return map_texts(df, run, "node bigint, shingles array<bigint>")


def bounded(ids: DataFrame) -> DataFrame:
    """``ids`` marked for broadcast if it is counted to have few rows; else joins shuffle it."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids


def may_link(n: Column, m: Column, percent: int) -> Column:
    """Whether the sizes alone allow a link."""
    return 100 * F.least(n, m) >= percent * F.greatest(n, m)


def may_meet(n: Column, reach: Column, m: Column, other_reach: Column, percent: int) -> Column:
    """Whether two sets can link whose first common entry is the one with these reaches."""
    return may_link(n, m, percent) & ((100 + percent) * F.least(reach, other_reach) >= percent * (n + m))


def of_pairs(pairs: DataFrame) -> DataFrame:
    """Ids of the nodes in the pairs ``a, b``, marked for broadcast if they are counted to be few."""
    both = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node")))
    return bounded(both.distinct())


def both_sides(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """The pairs ``a, b`` with a struct of the columns of ``rows``, which has a ``node``, for each: ``of_a, of_b``."""
    for side in ("a", "b"):
        pairs = pairs.join(rows.select(F.col("node").alias(side), F.struct(*[c for c in rows.columns if c != "node"]).alias(f"of_{side}")), side)
    return pairs


def may_reach(n: Column, m: Column, singles: Column, pairs: Column, boundary: int, percent: int) -> Column:
    """Whether two sets may link by their sizes and the numbers of keys that they have in common.

    What two sets share is at most what the first shingles of both have in common and what lies behind the first ones of
    the larger set. Small sets that have ``s`` first shingles in common meet under ``s (s - 1) / 2`` pairs.
    """
    both_small = F.greatest(n, m) <= boundary
    of_pairs_ = F.floor((1 + F.sqrt(1 + 8 * pairs)) / 2)
    behind = F.ceil(percent * F.greatest(n, m) / 100)
    most = behind + F.when(both_small, of_pairs_ - 2).otherwise(singles - 1)
    return may_link(n, m, percent) & ((100 + percent) * most >= percent * (n + m))


def odd(key: Column) -> Column:
    return key.bitwiseAND(F.lit(1)) == 1


def promising(pairs: DataFrame, keyed: DataFrame, boundary: int, percent: int) -> DataFrame:
    """The pairs ``a, b`` that may link by their entries."""
    few = keyed.join(of_pairs(pairs), "node", "semi").select("node", "n", "keys")
    both = both_sides(pairs, few).withColumn("_common", F.array_intersect("of_a.keys", "of_b.keys"))
    singles = F.size(F.filter("_common", odd))
    reach = may_reach(F.col("of_a.n"), F.col("of_b.n"), singles, F.size("_common") - singles, boundary, percent)
    return both.filter(reach).select("a", "b").distinct()


def proven(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs ``a, b`` whose whole sets link."""
    both = both_sides(pairs, sets.join(of_pairs(pairs), "node", "semi"))
    shared = F.size(F.array_intersect("of_a.shingles", "of_b.shingles"))
    union = F.size("of_a.shingles") + F.size("of_b.shingles") - shared
    return both.filter(100 * shared >= percent * union).select("a", "b").distinct()


def sets_of(pairs: DataFrame, docs: DataFrame, classes: DataFrame) -> DataFrame:
    """Whole sets of the nodes in the pairs, from the text of one document of each, read again."""
    wanted = bounded(classes.join(of_pairs(pairs), "node", "semi"))
    return one_each(whole_sets(of_classes(docs, wanted).select("node", "text")), classes)


def of_classes(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """Rows of the least document of each of ``classes``, with its ``node``."""
    of_least = F.col("doc_id").eqNullSafe(F.col("least")) & (F.col("at") == F.col("least_at"))
    return docs.join(classes.select("node", "least", "least_at"), of_least)


def one_each(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """``rows`` with one row per ``node``: where several documents of the least id hold a set, one of them."""
    several = classes.filter("times > 1").select("node")
    once = rows.join(several, "node", "semi").dropDuplicates(["node"])
    return rows.join(several, "node", "anti").unionByName(once) if not several.isEmpty() else rows


def components(links: DataFrame) -> DataFrame:
    """``node, label`` of every node of the undirected links ``a, b``: the least node that can be reached.

    Every node points to the least of its neighbours and itself; links are redrawn between the nodes pointed to, until
    none is left between different nodes. The pointers of all rounds together lead to the label.
    """
    labels, live = None, stored(links.filter("a <> b").distinct(), "links")
    while not live.isEmpty():
        both = live.union(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        pointers = stored(both.groupBy("a").agg(F.least("a", F.min("b")).alias("to")), "pointers")
        if labels is None:
            labels = pointers.select(F.col("a").alias("node"), F.col("to").alias("label"))
        else:
            moved = pointers.select(F.col("a").alias("label"), "to")
            labels = labels.join(moved, "label", "left").select("node", F.coalesce("to", "label").alias("label"))
            labels = stored(labels, "labels")
        on_a = live.join(pointers, "a").select(F.col("to").alias("x"), "b")
        on_b = on_a.join(pointers.select(F.col("a").alias("b"), "to"), "b").select("x", F.col("to").alias("y"))
        redrawn = on_b.filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
        live = stored(redrawn.distinct(), "links")
    if labels is None:
        return live.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return labels


def with_text_hash(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text, at``: ``at`` tells texts of one id apart."""
    docs = pick(df, doc_id=id_col, text=text_col)
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.xxhash64("text").alias("at"))


def judged_rows(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``doc_id, at, n, label, component`` of every row of ``doc_id, text, at``: ``label`` names the row's group, null for
    empty sets, and ``component`` is the least doc_id that the group holds, null if it has none."""
    surveyed = stored(survey(docs), "survey")
    rows = surveyed.filter("n is not null").select("doc_id", "at", "n", "node")
    known = rows.filter("n > 0")
    least = known.groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "at")).alias("_least"))
    least = least.select("node", F.col("_least.doc_id").alias("least"), F.col("_least.at").alias("least_at"))
    of_least = F.col("doc_id").eqNullSafe(F.col("least")) & (F.col("at") == F.col("least_at"))
    times = known.join(least, "node").filter(of_least).groupBy("node").agg(F.count(F.lit(1)).alias("times"))
    classes = stored(least.join(times, "node"), "classes")
    labels = components(class_links(docs, surveyed, rows, classes, percent))
    labelled = classes.join(labels, "node", "left").select("node", "least", F.coalesce("label", "node").alias("label"))
    of_label = labelled.groupBy("label").agg(F.min("least").alias("component"))
    of_node = labelled.join(of_label, "label").select(F.col("node").alias("_node"), "label", "component")
    found = rows.join(of_node, (F.col("node") == F.col("_node")) & (F.col("n") > 0), "left")
    return found.select("doc_id", "at", "n", "label", "component")


def linked_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row.

    Two texts link when they share at least ``percent`` of the union of their shingles; the component is the least doc_id
    reachable by links, the row's own included. Null and empty texts have no shingles and link with nothing. Rows that
    repeat an id are judged each by its text. Rows with a null id are never a component's least id: they get that of
    their group, or null. Other columns are not read; an empty table gives none. Shingles and sets are compared by 64-bit
    hashes.
    """
    found = judged_rows(with_text_hash(df, id_col, text_col), percent)
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def class_links(docs: DataFrame, surveyed: DataFrame, rows: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Links between nodes that connect all nodes which any chain of links connects."""
    common = common_shingles(surveyed)
    small = rows.filter(F.col("n") <= 2 * BOUNDARIES[-1]).groupBy("n").count()
    boundary = cheapest_boundary({r["n"]: r["count"] for r in small.collect()}, list_length(surveyed), percent)

    keyed = of_classes(entered(docs, common, boundary, percent), classes).select("node", F.col("n").cast("int").alias("n"), "keys")
    keyed = stored(one_each(keyed, classes), "keys")
    entry = keyed.select("node", "n", F.posexplode("keys").alias("place", "key"))
    entry = entry.select("key", "node", "n", reach_at(F.col("place"), F.col("n"), boundary, percent).alias("reach"))
    before = F.col("n") - F.col("reach")
    lists = entry.groupBy("key").agg(
        F.count(F.lit(1)).alias("in_list"), F.min("n").alias("least_n"), F.min(before).alias("hub_before"), F.min_by("node", before).alias("hub")
    )
    met = entry.join(lists.filter("in_list > 1").drop("in_list"), "key")
    # no set of the list is smaller than its least, and no smaller one than percent of the set itself can link
    smallest = F.greatest(F.col("least_n"), F.ceil(percent * F.col("n") / 100))
    met = met.filter((100 + percent) * F.col("reach") >= percent * (F.col("n") + smallest))
    met = stored(met.select("key", "node", "n", "reach", "hub", "hub_before"), "lists")

    # every node and the hubs that it meets
    sizes = keyed.select(F.col("node").alias("hub"), F.col("n").alias("hub_n"))
    stars = met.filter("node <> hub").join(sizes, "hub")
    stars = stars.filter(may_meet(F.col("n"), F.col("reach"), F.col("hub_n"), F.col("hub_n") - F.col("hub_before"), percent))
    stars = stars.select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct()
    stars = stored(promising(stored(stars, "stars"), keyed, boundary, percent), "promising")
    sets = stored(sets_of(stars, docs, classes), "sets")
    links = stored(proven(stars, sets, percent), "proven")
    # near copies that do not link with the least one meet further hubs, another in each round
    for turn in range(1, HUB_ROUNDS):
        pairs = other_hubs(met, stored(components(links), "groups"), sets.select("node"), turn, percent)
        pairs = stored(promising(stored(pairs, "stars"), keyed, boundary, percent), "promising")
        links = links.union(stored(proven(pairs, sets, percent), "proven"))
    # all nodes of one list that are still in different groups
    apart = stored(cross_pairs(met, stored(components(links), "groups"), percent), "apart")
    apart = stored(promising(apart, keyed, boundary, percent), "promising")
    return links.union(stored(proven(apart, stored(sets_of(apart, docs, classes), "sets"), percent), "proven"))


def with_groups(met: DataFrame, groups: DataFrame) -> DataFrame:
    """The entries of lists whose nodes are in different groups, with the group of each as ``label``."""
    known = met.join(groups, "node", "left").select("key", "node", "n", "reach", F.coalesce("label", "node").alias("label"))
    split = known.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high")
    return stored(known.join(split.select("key"), "key", "semi"), "mixed")


def other_hubs(met: DataFrame, groups: DataFrame, nodes: DataFrame, turn: int, percent: int) -> DataFrame:
    """Pairs of a node and its list's hub of this turn, if they are in different groups; among ``nodes`` only, the others
    are left to :func:`cross_pairs`."""
    mixed_lists = with_groups(met.join(nodes.distinct(), "node", "semi"), groups)
    place = F.struct(
        F.xxhash64("node", F.lit(turn)).alias("at"), F.col("node").alias("hub"), F.col("n").alias("m"),
        F.col("reach").alias("hub_reach"), F.col("label").alias("of_hub"),
    )
    hubs = mixed_lists.groupBy("key").agg(F.min(place).alias("_hub")).select("key", "_hub.*")
    pairs = mixed_lists.join(hubs, "key").filter(F.col("label") != F.col("of_hub"))
    near = may_meet(F.col("n"), F.col("reach"), F.col("m"), F.col("hub_reach"), percent)
    return pairs.filter(near).select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct()


def cross_pairs(met: DataFrame, groups: DataFrame, percent: int) -> DataFrame:
    """Pairs of nodes that share a list, are in different groups so far, and may link by sizes and reaches."""
    mixed_lists = with_groups(met, groups)
    other = mixed_lists.select("key", F.col("node").alias("b"), F.col("n").alias("m"), F.col("reach").alias("reach_b"), F.col("label").alias("label_b"))
    near = may_meet(F.col("n"), F.col("reach"), F.col("m"), F.col("reach_b"), percent)
    both = mixed_lists.join(other, "key").filter((F.col("node") < F.col("b")) & (F.col("label") != F.col("label_b")) & near)
    return both.select(F.col("node").alias("a"), "b").distinct()


def one_per_group(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One row of each group of linked texts, with all its columns: that with the least ``doc_id``.

    Rows are judged by id and text together, so an id that stands on two texts stays with each of them that is the least
    of its group. Null ids come last. Of several rows with the same id and text the one with the least hash of its columns
    stays. Rows without words are nobody's copies and all stay.
    """
    judged = stored(judged_rows(with_text_hash(docs), percent).filter("n > 0"), "judged")
    rank = F.struct(F.col("doc_id").isNull(), "doc_id", "at")
    groups = judged.groupBy("label").agg(F.min(rank).alias("_first"), F.count(F.lit(1)).alias("_rows")).filter("_rows > 1")
    told = judged.join(groups, "label").select("doc_id", "at", (rank == F.col("_first")).alias("_stays"))
    told = stored(told.groupBy("doc_id", "at", "_stays").agg(F.count(F.lit(1)).alias("_times")), "copies")

    def matching(rows: DataFrame, keys: DataFrame, how: str) -> DataFrame:
        keys = bounded(keys.select(F.col("doc_id").alias("_id"), F.col("at").alias("_of")))
        return rows.join(keys, F.col(quoted("doc_id")).cast("bigint").eqNullSafe(F.col("_id")) & (F.col("_at") == F.col("_of")), how)

    rows = docs.withColumn("_at", F.xxhash64(quoted("text")))
    repeated = told.filter("_stays and _times > 1")
    kept = matching(rows, told.filter("not _stays or _times > 1"), "left_anti").select(*map(quoted, docs.columns))
    if repeated.isEmpty():
        return kept
    whole = F.struct(*map(quoted, docs.columns))
    one = matching(rows, repeated, "left_semi").groupBy(quoted("doc_id"), "_at").agg(F.min_by(whole, F.xxhash64(whole)).alias("_row"))
    return kept.unionByName(one.select("_row.*"))
