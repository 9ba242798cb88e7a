"""Types, edge types and numbering rules of the graph model.

Edges are DataFrames (eid, nbr, ctr[, wgt][, etime]): ``ctr`` is the side a seed expands, ``nbr`` the neighbour found. An
edge type is a triple (neighbour's type, relation, centre's type); numeric types follow the triples' sorted order.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class EdgeType(NamedTuple):
    nbr: str
    rel: str
    ctr: str

    def __str__(self) -> str:
        return "__".join(self)


def check_group(group) -> None:
    """A group of attributes is a vertex type's name or the three names of an edge type."""
    if not isinstance(group, str) and not (isinstance(group, tuple) and len(group) == 3 and all(isinstance(x, str) for x in group)):
        raise ValueError(f"{group!r} is neither a vertex type nor an edge type")


#: Stored element types and their columns; half precision is kept as float.
COLUMN_TYPES = {"float64": "double", "float32": "float", "float16": "float", "bfloat16": "float", "int64": "bigint", "int32": "int", "int16": "smallint", "int8": "tinyint"}
FLOATS = frozenset(("float64", "float32", "float16", "bfloat16"))


def cast_within(c: Column, source: str, target: str) -> Column:
    """Convert between element types of one number class; whole numbers and floats do not mix."""
    if source not in COLUMN_TYPES or target not in COLUMN_TYPES:
        raise ValueError(f"unknown element type {source!r} or {target!r}")
    if (source in FLOATS) != (target in FLOATS):
        raise ValueError(f"cannot convert {source} to {target}")
    return c.cast(COLUMN_TYPES[target])


def edge_type_ids(types) -> dict[EdgeType, int]:
    return {t: i for i, t in enumerate(sorted(EdgeType(*t) for t in types))}


def vertex_counts(edges: dict[EdgeType, DataFrame], sizes: dict[EdgeType, tuple[int, int]] | None = None) -> dict[str, int]:
    """Vertices per type: declared sizes (neighbours, centres) where given, else the largest id seen plus one."""
    found: dict[str, int] = {}
    for t, df in edges.items():
        if sizes and t in sizes:
            n, c = sizes[t]
        else:
            row = df.agg(F.max("nbr").alias("n"), F.max("ctr").alias("c")).first()
            n, c = ((row["n"] if row["n"] is not None else -1) + 1), ((row["c"] if row["c"] is not None else -1) + 1)
        for kind, size in ((t.nbr, n), (t.ctr, c)):
            found[kind] = max(found.get(kind, 0), size)
    return found


def vertex_offsets(counts: dict[str, int]) -> dict[str, int]:
    """Running sums over the types in order of their names."""
    out, total = {}, 0
    for t in sorted(counts):
        out[t] = total
        total += counts[t]
    return out


def merged_edges(edges: dict[EdgeType, DataFrame], counts: dict[str, int]) -> DataFrame:
    """All edge types in one list with global vertex ids and numeric types."""
    off, ids = vertex_offsets(counts), edge_type_ids(edges)
    parts = []
    for t, df in sorted(edges.items()):
        optional = [F.col(c).cast(k).alias(c) if c in df.columns else F.lit(None).cast(k).alias(c) for c, k in (("wgt", "double"), ("etime", "long"))]
        parts.append(df.select(F.lit(ids[t]).cast("int").alias("etype"), F.col("eid").cast("long").alias("eid"), (F.col("nbr") + off[t.nbr]).cast("long").alias("nbr"), (F.col("ctr") + off[t.ctr]).cast("long").alias("ctr"), *optional))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def empty_edges(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "eid long, nbr long, ctr long")
