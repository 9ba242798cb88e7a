import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from neighborflow.llm import merkle as M

from .corpora import hard_texts

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def H(parts):
    return sha256("".join(parts).encode()).hexdigest()


def tree(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([H(levels[-1][i : i + 8]) for i in range(0, len(levels[-1]), 8)])
    return levels


def path(levels, at):
    out = []
    for level in levels[:-1]:
        run = at - at % 8
        out.append((level[run:at], level[at + 1 : run + 8]))
        at //= 8
    return out


def climbed(node, steps):
    for a, b in steps:
        node = H([*a, node, *b])
    return node


def leaf(r, text):
    return H(["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (*r[:4], text)])


def truth(rows):
    """The contract, read literally."""
    langs = {}
    for r in rows:
        langs.setdefault(r[2], []).append(r)
    order = sorted(langs, key=lambda v: (v is not None, (v or "").encode()))
    trees = {}
    for v in order:
        langs[v].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[4])))
        trees[v] = tree([leaf(r, r[4]) for r in langs[v]])
    top = tree([trees[v][-1][0] for v in order])
    out = []
    for at, v in enumerate(order):
        for i, r in enumerate(langs[v]):
            steps = path(trees[v], i) + path(top, at)
            text = r[4]
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and text is not None:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            folded = climbed(leaf(r, text), steps)
            out.append((r[0], leaf(r, r[4]), trees[v][-1][0], top[-1][0], H(x for a, b in steps for x in (*a, *b)), folded, folded == top[-1][0]))
    return out


def found(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA)
    return [tuple(r) for r in M.manifest(spark, docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0).collect()]


def same(got, want):
    order = lambda rows: sorted(rows, key=lambda r: tuple("" if v is None else str(v) for v in r))
    assert order(got) == order(want)


@pytest.mark.parametrize("n", [1, 2, 7, 8, 9, 63, 64, 65, 100, 448, 449, 511, 512])
@pytest.mark.parametrize("full", [False, True])
def test_traversal_gives_each_leaf_its_path(n, full):
    """``full``: the block is one of several, so it has all its levels however few its leaves."""
    leaves = [H([str(i)]) for i in range(n)]
    height = M.LEVELS if full else M.height(n)
    levels = [leaves]
    for _ in range(height):
        levels.append([H(levels[-1][i : i + 8]) for i in range(0, len(levels[-1]), 8)])
    paths = list(M.traverse(leaves, height))
    assert len(paths) == n
    for i, p in enumerate(paths):
        steps = path(levels, i)
        assert p == "".join(x for a, b in steps for x in (*a, *b))
        if not full:
            assert M.fold_path(leaves[i], p, i, n) == (levels[-1][0], len(p))
    assert M.fold_block(leaves, height) == levels[-1][0]


def test_manifest_of_several_tiers(spark):
    """A language of three blocks, one of exactly one, one of a single row, and rows without a language."""
    rows = [(i * 7 % 20_011, f"s{i % 3}", "en" if i < 1300 else "de" if i < 1812 else "fr" if i == 1812 else None, i, f"Text {i} ÄÖ") for i in range(1850)]
    same(found(spark, rows), truth(rows))


def test_manifest_of_many_languages(spark):
    """More languages than one block of the tree above holds."""
    rows = [(i, None, f"l{i % 600}", None, f"T{i}") for i in range(700)]
    same(found(spark, rows), truth(rows))


def test_nulls_ties_repeats_and_clashing_columns(spark):
    texts = hard_texts()
    rows = [(i % 5 if i % 4 else None, None if i % 3 else "S", ["en", "", None][i % 3], None if i % 2 else 3, t) for i, t in enumerate(texts * 2)]
    want = truth(rows)
    docs = spark.createDataFrame(rows, SCHEMA)
    for c in ("key", "at", "n", "node", "block", "upper", "leaf", "root", "path"):
        docs = docs.withColumn(c, F.lit("x"))
    got = [tuple(r) for r in M.manifest(spark, docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0).collect()]
    same(got, want)
    assert M.manifest(spark, docs.limit(0)).collect() == []


def test_a_changed_row_is_found_out(spark):
    rows = [(i, "s", "en", 1, f"Capital {i}") for i in range(30)] + [(30 + i, "s", "en", 1, "lower") for i in range(30)]
    for r in found(spark, rows):
        assert r[6] == (r[0] >= 30 or zlib.crc32(str(r[0]).encode()) % 3 != 0)
