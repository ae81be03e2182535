import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from twinfold.llm import merkle

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row, told=None):
    doc_id, text, lang, source, n_chars = row
    fields = (doc_id, source, lang, n_chars if told is None else told, text)
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in fields))


def tree(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([h(*last[i : i + 2]) for i in range(0, len(last), 2)])
    return levels


def path(levels, at):
    return [(at >> k & 1, level[at >> k ^ 1] if at >> k ^ 1 < len(level) else None) for k, level in enumerate(levels[:-1])]


def expected(rows):
    by_lang = {}
    for row in rows:
        by_lang.setdefault(row[2], []).append(row)
    langs = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in langs:
        told = [(r[0] is not None, r[0] or 0, leaf_of(r), r) for r in by_lang[lang]]
        by_lang[lang] = [r for *_, r in sorted(told, key=lambda t: t[:3])]
        trees[lang] = tree([leaf_of(r) for r in by_lang[lang]])
    top = tree([trees[x][-1][0] for x in langs])
    found = []
    for k, lang in enumerate(langs):
        for i, row in enumerate(by_lang[lang]):
            siblings = path(trees[lang], i) + path(top, k)
            hit = row[0] is not None and row[4] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0
            value = leaf_of(row, row[4] + 1) if hit else leaf_of(row)
            for right, other in siblings:
                value = h(value) if other is None else h(other, value) if right else h(value, other)
            proof = h(*(s for _, s in siblings if s is not None))
            found.append((row[0], leaf_of(row), trees[lang][-1][0], top[-1][0], proof, value, value == top[-1][0]))
    return sorted(found, key=str)


def result(df):
    return sorted(map(tuple, merkle.manifest(df, merkle.tampered_chars()).drop("proof").collect()), key=str)


@pytest.mark.parametrize("levels, rows", [(1, 37), (2, 64), (3, 301), (10, 301)])
def test_equals_plain_trees(spark, monkeypatch, levels, rows):
    monkeypatch.setattr(merkle, "BLOCK_LEVELS", levels)
    rng = random.Random(rows)
    langs = ["en"] * 6 + ["de", "", "é", None, "zz", "😀"]
    made = [(i * 3, f"text {i}", rng.choice(langs), rng.choice([None, "s"]), rng.choice([None, i])) for i in range(rows)]
    df = spark.createDataFrame(made, SCHEMA).repartition(5)
    if levels < 10:  # workers hold the module as it is in the library, so small blocks run in this process
        assert plain_sweeps(made, levels)
    else:
        wanted = expected(made)
        assert result(df) == wanted and {r[-1] for r in wanted} == {True, False}


def plain_sweeps(made, levels):
    """Blocks of few levels, level by level, against whole trees."""
    leaves = [leaf_of(r).encode() for r in made]
    whole = [[d.encode() for d in level] for level in tree([d.decode() for d in leaves])]
    tables, counts = [leaves], [len(leaves)]
    while counts[-1] > 1:
        n, last, size = counts[-1], tables[-1], 1 << levels
        here = min(levels, merkle.levels_of(n))
        tables.append([merkle.sweep_up(last[a : a + size], 0, here)[here, 0] for a in range(0, n, size)])
        counts.append(len(tables[-1]))
    assert tables[-1] == whole[-1]
    proofs = [b""]
    for last in reversed(tables[:-1]):
        size, here = 1 << levels, min(levels, merkle.levels_of(len(last)))
        below = [b""] * len(last)
        for block, suffix in enumerate(proofs):
            nodes = merkle.sweep_up(last[block * size : (block + 1) * size], 0, here)
            for at, proof in merkle.sweep_down(nodes, here, suffix):
                below[block * size + at] = proof
        proofs = below
    names = [[d.decode() for d in level] for level in whole]
    for i, proof in enumerate(proofs):
        assert [s.decode() for _, s in merkle.steps(proof) if s] == [s for _, s in path(names, i) if s]
        assert merkle.fold(leaves[i], proof) == whole[-1][0] and merkle.fold(b"0" * 64, proof) != whole[-1][0]
    return True


def test_several_sweeps_of_one_large_group(spark):
    made = [(i, "t" * (i % 5), "en" if i % 50 else "de", None, i) for i in range(2500)] + [(9, "x", None, None, None)]
    df = spark.createDataFrame(made, SCHEMA).withColumns({"grp": F.lit(1), "idx": F.lit(2), "n": F.lit(3), "block": F.lit(4), "proof": F.lit("p")})
    assert result(df) == expected(made)


def test_bad_rows(spark):
    same = (5, "same", "en", "s", 4)
    rows = [same] * 4 + [(5, None, "en", "s", 4), (None, None, None, None, None), (7, "", "", "", 0), (8, "y" * 200_000, "en", "a:b", -1)]
    assert result(spark.createDataFrame(rows, SCHEMA)) == expected(rows)
    assert result(spark.createDataFrame(rows[:1], SCHEMA)) == expected(rows[:1])
    assert result(spark.createDataFrame([], SCHEMA)) == []


def test_proofs_are_whole(spark):
    rows = [(i, "t", "en", None, i) for i in range(11)]
    found = merkle.manifest(spark.createDataFrame(rows, SCHEMA), with_proofs=True).collect()
    assert all(r.verified and r.folded_root == r.root for r in found)
    for r in found:
        assert merkle.fold(r.leaf.encode(), r.proof.encode()).decode() == r.root
