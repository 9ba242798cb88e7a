"""A Merkle manifest of a table: a leaf for each row, a tree of eight-way hashes for each language and one over these,
and for each row the path of siblings that proves it.

Leaves are digests, so texts never leave the scan. They are numbered within their language by one range sort whose keys
may span tasks, and cut into aligned blocks of 512. Going up, a task folds each of its blocks to one node, and the nodes
of all blocks are the leaves of the next tier, until each language has one node; the languages' nodes form a tree in the
same way. Coming down, each block of a tier gets the path above it, and is walked by a fractal traversal: for each level
the subtree around the present leaf is kept, and the next one is grown a leaf at a time, so that it stands when the walk
gets there. A block's paths come out one after the other and are used at once, never stored.

Defined results. A null field is ``-``; a null language is a language of its own and the first. Rows without a doc_id
come first and are never tampered with. Rows of one doc_id and language follow the order of their leaves, so equal rows
have neighbouring places. Empty and long texts are hashed whole. An empty table has no rows. Extra columns, whatever
their names, take no part.
"""

from __future__ import annotations

from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from neighborflow.llm.common import Scratch
from neighborflow.operators.numbering import number_within

#: Children of a node as a power of two, and levels of an aligned block: 8 children, 512 leaves.
BITS, LEVELS = 3, 3
ARITY, BLOCK_BITS = 1 << BITS, BITS * LEVELS
BLOCK = 1 << BLOCK_BITS


def digest(parts: list[str]) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def height(n: int) -> int:
    """Levels above the leaves of a tree of n leaves."""
    found = 0
    while n > 1:
        n, found = -(-n // ARITY), found + 1
    return found


class _Grown:
    """The nodes of one run at a level, grown from their leaves one at a time: a stack of unfinished runs."""

    def __init__(self, level: int):
        self.runs: list[list[str]] = [[] for _ in range(level + 1)]

    def add(self, leaf: str, last: bool) -> None:
        """``last``: no leaf follows in the block, so what is unfinished is closed."""
        self.runs[0].append(leaf)
        for i in range(len(self.runs) - 1):
            if not last and len(self.runs[i]) < ARITY:
                break
            self.runs[i + 1].append(digest(self.runs[i]))
            self.runs[i] = []

    @property
    def nodes(self) -> list[str]:
        return self.runs[-1]


def fold_block(leaves: list[str], levels: int) -> str:
    """The node ``levels`` above the leaves of one block."""
    whole = _Grown(levels)
    for i, leaf in enumerate(leaves):
        whole.add(leaf, i == len(leaves) - 1)
    return whole.nodes[0]


def traverse(leaves: list[str], levels: int):
    """The siblings of each leaf in turn, from its own run up to the block's, as one string. Per level only the subtree of
    eight nodes around the present leaf and the unfinished next one are held."""
    n = len(leaves)
    present, desired = [], [_Grown(j) for j in range(levels)]
    for j in range(levels):
        first, end = _Grown(j), min(n, 1 << BITS * (j + 1))
        for i in range(end):
            first.add(leaves[i], i == n - 1)
        present.append(first.nodes)
    for i in range(n):
        path = []
        for j, nodes in enumerate(present):
            at = i >> BITS * j & ARITY - 1
            path += nodes[:at] + nodes[at + 1 :]
        yield "".join(path)
        for j in range(levels - 1):
            width = BITS * (j + 1)
            ahead = i + (1 << width)  # as far into the next run as i is in its own
            if ahead < n:
                desired[j].add(leaves[ahead], ahead == n - 1)
            if i + 1 & (1 << width) - 1 == 0:
                present[j], desired[j] = desired[j].nodes, _Grown(j)


def fold_path(node: str, path: str, at: int, n: int, start: int = 0) -> tuple[str, int]:
    """The root over leaf ``at`` of n from its path, which begins at ``start`` of the string; and where the path ends."""
    while n > 1:
        place = at & ARITY - 1
        others = min(ARITY, n - (at - place)) - 1
        cut, end = start + 64 * place, start + 64 * others
        node = sha256((path[start:cut] + node + path[cut:end]).encode()).hexdigest()
        at, n, start = at >> BITS, -(-n // ARITY), end
    return node, start


def _blocks(batches, *columns: str):
    """The rows of each block of sorted batches as lists of the named columns; a block may span batches."""
    held, key = None, None
    for pdf in batches:
        starts = _starts(pdf)
        for a, b in zip(starts, starts[1:]):
            if a == b:
                continue
            own = (pdf["key"].iat[a], pdf["block"].iat[a])
            if own != key:
                if held is not None:
                    yield key, held
                held, key = {c: [] for c in columns}, own
            for c in columns:
                held[c] += pdf[c].iloc[a:b].tolist()
    if held is not None:
        yield key, held


def _starts(pdf: pd.DataFrame) -> list[int]:
    moved = (pdf["key"] != pdf["key"].shift()) | (pdf["block"] != pdf["block"].shift())
    return [*moved.to_numpy().nonzero()[0].tolist(), len(pdf)]


def _levels(n: int) -> int:
    """Levels of a block in a tree of n nodes: all of them unless the block is the whole tree."""
    return LEVELS if n > BLOCK else height(n)


def _dealt(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("block", F.shiftright("at", BLOCK_BITS)).repartition("key", "block").sortWithinPartitions("key", "block", "at")


def _fold_up(batches):
    for (key, block), rows in _blocks(batches, "n", "node"):
        n = rows["n"][0]
        yield pd.DataFrame({"key": [key], "at": [block], "n": [-(-n // BLOCK)], "node": [fold_block(rows["node"], _levels(n))]})


def _walk_down(batches):
    for (key, _), rows in _blocks(batches, "at", "n", "node", "upper"):
        upper, n = rows["upper"][0], rows["n"][1]
        paths = [p + upper for p in traverse(rows["node"][1:], _levels(n))]
        yield pd.DataFrame({"key": key, "at": rows["at"][1:], "n": n, "path": paths})


def _with_upper(nodes: DataFrame, upper: DataFrame) -> DataFrame:
    """Nodes and, ahead of those of each block, one row with what ``upper`` (key, at, ...) says of the block: a block and
    its head meet in one task, in order."""
    heads = upper.withColumn("block", F.col("at")).withColumn("at", F.lit(-1).cast("long"))
    rows = nodes.withColumn("block", F.shiftright("at", BLOCK_BITS))
    return rows.unionByName(heads, allowMissingColumns=True).na.fill(0).na.fill(False).repartition("key", "block").sortWithinPartitions("key", "block", "at")


class _Tree:
    """Trees over nodes (key, at, n, node), one for each key, tier by tier."""

    def __init__(self, nodes: DataFrame, scratch: Scratch, name: str):
        self.tiers, self.scratch, self.name = [nodes], scratch, name
        most = nodes.agg(F.max("n").alias("n")).first()["n"] or 0  # one number
        while most > 1:
            most = -(-most // BLOCK)
            up = _dealt(self.tiers[-1].select("key", "at", "n", "node")).mapInPandas(_fold_up, "key string, at long, n long, node string")
            self.tiers.append(scratch.save(up, f"{name}-{len(self.tiers)}"))

    @property
    def roots(self) -> DataFrame:
        """(key, node)"""
        return self.tiers[-1].select("key", "node")

    def above(self, upper: DataFrame) -> DataFrame:
        """(key, at, path): for each block of the lowest tier, the path from its node to the root and then that of ``upper``
        (key, path)."""
        paths = upper.select("key", F.lit(0).cast("long").alias("at"), "path")
        for i, tier in reversed(list(enumerate(self.tiers))[1:]):
            down = _with_upper(tier, paths.withColumnRenamed("path", "upper")).mapInPandas(_walk_down, "key string, at long, n long, path string")
            paths = self.scratch.save(down.select("key", "at", "path"), f"{self.name}-path-{i}")
        return paths


def _field(c: Column) -> Column:
    """``-``, or the byte count, a colon and the value."""
    text = c.cast("string")
    return F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def _leaf(text: Column) -> Column:
    return F.sha2(F.concat(*[_field(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars")], _field(text)).cast("binary"), 256)


def _prove(batches):
    for _, rows in _blocks(batches, "at", "n", "node", "doc_id", "has_id", "changed", "upper", "subroot", "root", "rank", "ranks"):
        upper, subroot, root, rank, ranks = (rows[c][0] for c in ("upper", "subroot", "root", "rank", "ranks"))
        n, leaves = rows["n"][1], rows["node"][1:]
        proofs, folded = [], []
        for at, leaf, changed, low in zip(rows["at"][1:], leaves, rows["changed"][1:], traverse(leaves, _levels(n)), strict=True):
            path = low + upper
            node, end = fold_path(changed or leaf, path, at, n)
            proofs.append(sha256(path.encode()).hexdigest())
            folded.append(fold_path(node, path, rank, ranks, end)[0])
        ids = pd.array([i if has else None for i, has in zip(rows["doc_id"][1:], rows["has_id"][1:], strict=True)], "Int64")
        yield pd.DataFrame({"doc_id": ids, "leaf": leaves, "subroot": subroot, "root": root, "proof_sha256": proofs, "folded_root": folded, "verified": [x == root for x in folded]})


def manifest(spark: SparkSession, docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) for documents (doc_id, source, lang, n_chars, text).

    ``tampered``: a condition on the columns; where it holds, the path is folded from the leaf of the text with A-Z in lower
    case, and ``verified`` says whether that gives the root all the same."""
    scratch = Scratch(spark, "merkle")
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    changed = F.when(F.lit(False) if tampered is None else tampered, _leaf(F.translate("text", upper, lower)))
    rows = docs.select("doc_id", "source", "lang", "n_chars", "text").select(
        F.coalesce(F.concat(F.lit("="), "lang"), F.lit("")).alias("key"), F.col("doc_id").cast("long").alias("doc_id"), _leaf(F.col("text")).alias("node"), F.coalesce(changed, F.lit("")).alias("changed")
    )
    nodes = number_within(rows, ["key"], ["doc_id", "node"], "at", "n")
    nodes = scratch.save(nodes.select("key", "at", "n", "node", F.coalesce("doc_id", F.lit(0)).alias("doc_id"), F.col("doc_id").isNotNull().alias("has_id"), "changed"), "leaves")
    trees = _Tree(nodes, scratch, "rows")

    # The languages' roots are the leaves of the tree above.
    tops = number_within(trees.roots.select(F.lit("").alias("all"), "key", "node"), ["all"], ["key"], "rank", "ranks")
    tops = scratch.save(tops.select("key", "rank", "ranks", "node"), "subroots")
    crown = _Tree(tops.select(F.lit("").alias("key"), F.col("rank").alias("at"), F.col("ranks").alias("n"), "node"), scratch, "crown")
    root = (crown.roots.first() or {"node": None})["node"]  # one digest
    over = crown.above(crown.roots.select("key", F.lit("").alias("path")))
    heads = _with_upper(crown.tiers[0], over.withColumnRenamed("path", "upper")).mapInPandas(_walk_down, "key string, at long, n long, path string")
    tops = tops.join(heads.select(F.col("at").alias("rank"), "path"), "rank")
    tops = scratch.save(tops.select("key", "rank", "ranks", F.col("node").alias("subroot"), F.lit(root).cast("string").alias("root"), "path"), "tops")

    above = trees.above(tops.select("key", "path")).join(tops.drop("path"), "key").withColumnRenamed("path", "upper")
    schema = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return _with_upper(nodes, above).mapInPandas(_prove, schema)
