"""Merkle manifest of a table: digests of all rows, trees per group and over the groups, proofs of every row.

Trees are computed by time-forward processing. Nodes are labelled (level, position), and a priority queue ordered by label
delivers the digest of every node to its parent, which is hashed when the sweep reaches its label. A reversed sweep, largest
label first, delivers to every node the proof suffix of its parent with the sibling in front of it, down to the leaves.

The queue is external. Nodes of a block of ``2**BLOCK_LEVELS`` neighbours exchange their messages in a task's own bounded
heap; messages that leave a block are rows of a table in the shared folder, which Spark's external sort brings into the
order of their labels for the next sweep. So a tree of n leaves takes log(n) / BLOCK_LEVELS sweeps up and as many down, no
task holds more than one block, and the leaves of one large group are spread over all tasks.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinfold.llm.common import pick, stored

BLOCK_LEVELS = 10
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
TAMPER_EVERY = 7
HEX = 64
LEFT, RIGHT, NONE = b"L", b"R", b"-"  # side of the sibling; none: the node was alone in its run
_NODE = "grp string, idx bigint, n bigint, digest string"


def digest(*parts: bytes) -> bytes:
    """Lowercase hex sha256 of the parts one after the other."""
    return hashlib.sha256(b"".join(parts)).hexdigest().encode()


def levels_of(n: int) -> int:
    """Levels between ``n`` nodes and the one that remains."""
    return (n - 1).bit_length()


def field_text(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, ``:`` and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(**changed: Column) -> Column:
    """H of the fields of a row; ``changed`` fields are taken from the given columns."""
    return F.sha2(F.concat(*[field_text(changed.get(f, F.col(f))) for f in FIELDS]), 256)


def sweep_up(digests: list[bytes], first: int, levels: int) -> dict[tuple[int, int], bytes]:
    """All nodes of a block, by label: leaves at positions from ``first`` on, then ``levels`` levels above them.

    The queue holds the digests that are on their way; the least label comes first, so both children of a parent have
    arrived when the sweep gets to it.
    """
    queue = [((0, first + i), d) for i, d in enumerate(digests)]
    nodes: dict[tuple[int, int], bytes] = {}
    while queue:
        label, value = heapq.heappop(queue)
        nodes[label] = value
        level, at = label
        if level == levels:
            continue
        run = [value]
        if not at & 1 and queue and queue[0][0] == (level, at + 1):
            label, other = heapq.heappop(queue)
            nodes[label] = other
            run.append(other)
        heapq.heappush(queue, ((level + 1, at >> 1), digest(*run)))
    return nodes


def sweep_down(nodes: dict[tuple[int, int], bytes], levels: int, suffix: bytes) -> Iterator[tuple[int, bytes]]:
    """Position and proof of every leaf of a block, largest position first; ``suffix`` is the proof of the block's top."""
    queue = [((-level, -at), suffix) for level, at in nodes if level == levels]
    while queue:
        (level, at), proof = heapq.heappop(queue)
        level, at = -level, -at
        if level == 0:
            yield at, proof
            continue
        left, right = nodes[level - 1, 2 * at], nodes.get((level - 1, 2 * at + 1))
        if right is None:
            heapq.heappush(queue, ((1 - level, -2 * at), NONE + proof))
        else:
            heapq.heappush(queue, ((1 - level, -2 * at), RIGHT + right + proof))
            heapq.heappush(queue, ((1 - level, -2 * at - 1), LEFT + left + proof))


def steps(proof: bytes) -> Iterator[tuple[bytes, bytes]]:
    """Side and sibling of every level of a proof, from the leaf on; the sibling is empty where there is none."""
    at = 0
    while at < len(proof):
        side = proof[at : at + 1]
        size = 0 if side == NONE else HEX
        yield side, proof[at + 1 : at + 1 + size]
        at += 1 + size


def fold(leaf: bytes, proof: bytes) -> bytes:
    """The root that a leaf and its siblings give."""
    for side, sibling in steps(proof):
        leaf = digest(sibling, leaf) if side == LEFT else digest(leaf, sibling)
    return leaf


def numbered(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``rows`` with ``idx``, the position of a row within its ``grp`` by ``order``, and ``n``, the rows of the group.

    One range sort of all rows; rows are numbered per partition, and the few counts per partition and group give what
    lies before. No group is gathered.
    """
    spark = rows.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    by = [F.col("grp").asc_nulls_first(), *order]
    placed = rows.repartitionByRange(parts, *by).sortWithinPartitions(*by)
    at = stored(placed.withColumn("_at", F.monotonically_increasing_id()), name)
    part = F.shiftright("_at", 33).alias("_part")
    counts = at.groupBy("grp", part).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    whole = Window.partitionBy("grp")
    before = F.sum("_rows").over(whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select(
        F.col("grp").alias("_grp"), F.col("_part").alias("_of"), "_first", F.coalesce(before, F.lit(0)).alias("_before"),
        F.sum("_rows").over(whole).alias("n"),
    )
    here = (F.shiftright("_at", 33) == F.col("_of")) & F.col("grp").eqNullSafe(F.col("_grp"))
    return at.join(starts, here).select(*rows.columns, (F.col("_before") + F.col("_at") - F.col("_first")).alias("idx"), "n")


def _in_blocks(rows: DataFrame) -> DataFrame:
    """Rows of ``grp, idx`` block by block, in the order of their labels; messages to a block (``idx`` null) first."""
    return rows.repartition("grp", "block").sortWithinPartitions("grp", "block", F.col("idx").asc_nulls_first())


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, dict[str, list]]]:
    """Key and columns of each block in turn."""
    key, held = None, None
    for batch in batches:
        columns = batch.to_pydict()
        for values in zip(*columns.values()):
            row = dict(zip(columns, values))
            at = (row["grp"], row["block"])
            if held is not None and at != key:
                yield key, held
                held = None
            if held is None:
                key, held = at, {c: [] for c in columns}
            for column, value in row.items():
                held[column].append(value)
    if held is not None:
        yield key, held


def _levels_here(n: int) -> int:
    """Levels of a block in a group of ``n`` nodes."""
    return min(BLOCK_LEVELS, levels_of(n))


def _up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: list[tuple] = []
    for (group, block), held in _blocks(batches):
        n = held["n"][0]
        levels = _levels_here(n)
        nodes = sweep_up([d.encode() for d in held["digest"]], 0, levels)
        found.append((group, block, -(-n >> levels), nodes[levels, 0].decode()))
        if len(found) >= 4096:
            yield _node_batch(found)
            found = []
    if found:
        yield _node_batch(found)


def _node_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string()]
    arrays = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
    return pa.RecordBatch.from_arrays(arrays, ["grp", "idx", "n", "digest"])


def _with_block(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("block", F.shiftright("idx", BLOCK_LEVELS))


def sweeps_up(nodes: DataFrame) -> list[DataFrame]:
    """Tables of ``grp, idx, n, digest``: the given nodes, then the tops of their blocks, until each group has one."""
    tables = [nodes]
    while not tables[-1].filter("n > 1").isEmpty():
        last = tables[-1]
        tops = _in_blocks(_with_block(last.filter("n > 1").select("grp", "idx", "n", "digest"))).mapInArrow(_up, _NODE)
        tables.append(stored(tops.unionByName(last.filter("n = 1").select("grp", "idx", "n", "digest")), "nodes"))
    return tables


def _down(answer: Callable[[dict[str, list], dict[int, bytes]], pa.RecordBatch]):
    """Sweep down each block; ``answer`` makes rows of the columns of its leaves and their proofs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, held in _blocks(batches):
            suffix = (held.pop("proof")[0] or "").encode()
            leaves = {c: v[1:] for c, v in held.items()}  # the first row is the message to the block
            levels = _levels_here(leaves["n"][0])
            size = 1 << BLOCK_LEVELS
            nodes = sweep_up([d.encode() for d in leaves["digest"]], 0, levels)
            yield answer(leaves, {at % size: proof for at, proof in sweep_down(nodes, levels, suffix)})

    return run


def _send_down(nodes: DataFrame, proofs: DataFrame, answer, schema: str) -> DataFrame:
    """Deliver ``proofs`` (``grp, idx, proof`` of the tops of blocks) to the blocks of ``nodes``."""
    empty = [F.lit(None).cast(t).alias(c) for c, t in nodes.dtypes if c not in ("grp", "idx")]
    messages = proofs.select("grp", F.lit(None).cast("bigint").alias("idx"), *empty, F.col("idx").alias("block"), "proof")
    waiting = _with_block(nodes).withColumn("proof", F.lit(None).cast("string"))
    return _in_blocks(waiting.unionByName(messages)).mapInArrow(_down(answer), schema)


def _proof_rows(leaves: dict[str, list], proofs: dict[int, bytes]) -> pa.RecordBatch:
    found = [proofs[i].decode() for i in range(len(leaves["idx"]))]
    arrays = [pa.array(leaves["grp"], pa.string()), pa.array(leaves["idx"], pa.int64()), pa.array(found, pa.string())]
    return pa.RecordBatch.from_arrays(arrays, ["grp", "idx", "proof"])


def proofs_of_tops(tables: list[DataFrame], tops: DataFrame) -> DataFrame:
    """``grp, idx, proof`` of the tops of the blocks of the first of ``tables``, from those of the last."""
    proofs = tops
    for nodes in reversed(tables[1:-1]):
        ended = nodes.filter("n = 1").select(F.col("grp").alias("_grp"))  # groups with one node left go on as they are
        same = F.col("grp").eqNullSafe(F.col("_grp"))
        below = _send_down(nodes.filter("n > 1"), proofs.join(ended, same, "left_anti"), _proof_rows, "grp string, idx bigint, proof string")
        proofs = stored(below.unionByName(proofs.join(ended, same, "left_semi")), "proofs")
    return proofs


def to_leaves(tables: list[DataFrame], tops: DataFrame, answer, schema: str) -> DataFrame:
    """Deliver the proofs of the groups' tops to all nodes of the first table."""
    return _send_down(tables[0], proofs_of_tops(tables, tops), answer, schema)


_LEAF_SCHEMA = "grp string, doc_id bigint, leaf string, proof_sha256 string, folded_root string, proof string"


def _leaf_rows(with_proofs: bool):
    def answer(leaves: dict[str, list], proofs: dict[int, bytes]) -> pa.RecordBatch:
        rows = []
        for i, (group, doc_id, leaf, seen) in enumerate(zip(*(leaves[c] for c in ("grp", "doc_id", "digest", "seen")))):
            proof = proofs[i]
            siblings = digest(*[s for _, s in steps(proof)]).decode()
            folded = fold((seen or leaf).encode(), proof).decode()
            rows.append((group, doc_id, leaf, siblings, folded, proof.decode() if with_proofs else None))
        names = [c.split()[0] for c in _LEAF_SCHEMA.split(", ")]
        kinds = [pa.int64() if c == "doc_id" else pa.string() for c in names]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return answer


def tampered_chars(every: int = TAMPER_EVERY) -> Column:
    """``n_chars``, one more where ``every`` divides the crc32 of the decimal doc_id; nulls stay."""
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % every == 0
    return F.when(hit, F.col("n_chars") + 1).otherwise(F.col("n_chars"))


def manifest(df: DataFrame, tampered: Column | None = None, with_proofs: bool = False) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified, proof`` of every row.

    One tree per ``lang`` over its rows by ``doc_id`` (null first; rows that repeat an id by their digests), one over the
    langs' roots (null first, then bytewise). ``proof`` is null unless ``with_proofs``: for each level ``L`` or ``R`` and
    the sibling on that side, or ``-`` where the node was alone. ``tampered`` replaces ``n_chars`` in the leaves that are
    folded with the original siblings; default: nothing is tampered with. Nulls in any column are told apart from texts;
    repeated rows are leaves of their own; an empty table gives no rows. Only the five columns of :data:`FIELDS` are read.
    """
    rows = pick(df, **{f: f for f in FIELDS})
    rows = rows.withColumns({"doc_id": F.col("doc_id").cast("bigint"), "n_chars": F.col("n_chars").cast("bigint")})
    changed = F.col("n_chars") if tampered is None else tampered
    seen = F.when(~changed.eqNullSafe(F.col("n_chars")), leaf_digest(n_chars=changed))  # null: as the leaf itself
    leaves = rows.select("doc_id", F.col("lang").cast("string").alias("grp"), leaf_digest().alias("digest"), seen.alias("seen"))
    order = [F.col(c).asc_nulls_first() for c in ("doc_id", "digest", "seen")]
    leaves = stored(numbered(stored(leaves, "leaves"), order, "ordered"), "numbered")

    by_lang = sweeps_up(leaves)
    subroots = by_lang[-1].select(F.lit("").alias("grp"), F.col("grp").alias("lang"), "digest")
    subroots = stored(numbered(subroots, [F.col("lang").asc_nulls_first()], "ordered"), "numbered")
    over_langs = sweeps_up(subroots)
    top = over_langs[-1].select("digest").first()

    begin = over_langs[-1].select("grp", "idx", F.lit("").alias("proof"))
    of_langs = to_leaves(over_langs, begin, _proof_rows, "grp string, idx bigint, proof string").select("idx", "proof")
    known = stored(subroots.select("idx", F.col("lang").alias("_grp"), F.col("digest").alias("subroot")).join(of_langs, "idx"), "subroots")
    tops = known.select(F.col("_grp").alias("grp"), F.lit(0).cast("bigint").alias("idx"), "proof")
    found = to_leaves(by_lang, tops, _leaf_rows(with_proofs), _LEAF_SCHEMA)
    root = F.lit(top[0] if top else None).cast("string")
    both = found.join(known.drop("idx", "proof"), F.col("grp").eqNullSafe(F.col("_grp")))
    return both.select(
        "doc_id", "leaf", "subroot", root.alias("root"), "proof_sha256", "folded_root",
        (F.col("folded_root") == root).alias("verified"), "proof",
    )
