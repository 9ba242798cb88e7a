"""Graph store and feature store: registries of DataFrames."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from neighborflow.model import EdgeType, check_group, merged_edges, vertex_counts, vertex_offsets
from neighborflow.operators import layout, tensor


class FeatureStore:
    """Attributes by (group, name); a group is a node type or an edge type. Tables are (id, value) or (id, vec)."""

    def __init__(self):
        self._tables: dict = {}

    def put(self, group, name: str, table: DataFrame, indexed: bool = False) -> bool:
        """Set an attribute; an indexed put overwrites its rows (pos, id, column) of a present one."""
        check_group(group)
        cols = [c for c in table.columns if c in ("value", "vec")]
        if "id" not in table.columns or len(cols) != 1:
            raise ValueError("a table has id and one of value and vec")
        held = self._tables.get((group, name))
        self._tables[(group, name)] = tensor.scatter(held, table, cols[0]) if indexed and held is not None else table.select("id", *cols)
        return True

    def put_once(self, group, name: str, table: DataFrame, n: int) -> bool:
        """Set an attribute that is not there yet, with a row for each of the ids 0 to n - 1."""
        if (group, name) in self._tables:
            raise ValueError(f"{name} of {group} is already set")
        found = table.agg(F.count("*").alias("n"), F.count_distinct("id").alias("d"), F.min("id").alias("lo"), F.max("id").alias("hi")).first()  # four numbers
        if (found["n"], found["d"]) != (n, n) or (n and (found["lo"], found["hi"]) != (0, n - 1)):
            raise ValueError(f"{name} has {found['n']} rows for {n} ids")
        return self.put(group, name, table)

    def get(self, group, name: str, index: DataFrame | None = None) -> DataFrame | None:
        table = self._tables.get((group, name))
        if table is None or index is None:
            return table
        return tensor.gather(table, index, [c for c in table.columns if c != "id"])

    def remove(self, group, name: str) -> bool:
        return self._tables.pop((group, name), None) is not None

    def size(self, group, name: str) -> tuple | None:
        table = self._tables.get((group, name))
        if table is None:
            return None
        n = table.count()
        if "vec" not in table.columns:
            return (n,)
        first = table.select(F.size("vec")).first()
        return (n, first[0] if first else 0)

    def attributes(self) -> list:
        return list(self._tables)


class GraphStore:
    """Edge lists by type, merged lazily into one multigraph."""

    def __init__(self, spark: SparkSession):
        self.spark, self._edges, self._sizes, self._merged = spark, {}, {}, None

    def put_edge_index(self, edges, edge_type, layout_name: str = "coo", size: tuple[int, int] | None = None) -> bool:
        """edges: a DataFrame with nbr, ctr and eid, or a pair of sequences (neighbours, centres) numbered in order."""
        if layout_name != "coo":
            raise ValueError("only the coo layout can be written")
        if not isinstance(edges, DataFrame):
            if len(edges) != 2:
                raise ValueError("an edge index has two rows")
            pdf = pd.DataFrame({"nbr": list(edges[0]), "ctr": list(edges[1])}, dtype="int64")
            edges = self.spark.createDataFrame(pdf.assign(eid=range(len(pdf))), "nbr long, ctr long, eid long")
        t = EdgeType(*edge_type)
        self._edges[t], self._merged = edges, None
        if size:
            self._sizes[t] = size
        return True

    def get_edge_index(self, edge_type, layout_name: str = "coo"):
        """coo: the edges. csr: pointers over neighbours' side and the sorted list; csc: over the centres' side."""
        t = EdgeType(*edge_type)
        edges = self._edges.get(t)
        if edges is None or layout_name == "coo":
            return edges
        if layout_name not in ("csr", "csc"):
            raise ValueError("layout must be coo, csr or csc")
        by, other, kind = ("nbr", "ctr", t.nbr) if layout_name == "csr" else ("ctr", "nbr", t.ctr)
        return layout.row_pointers(edges, self.counts()[kind], by), layout.column_list(edges, by, other)

    def remove_edge_index(self, edge_type) -> bool:
        self._merged = None
        self._sizes.pop(EdgeType(*edge_type), None)
        return self._edges.pop(EdgeType(*edge_type), None) is not None

    def edge_attrs(self) -> list[tuple[EdgeType, str, tuple[int, int] | None]]:
        """Type, layout and given size of each edge index, by type."""
        return [(t, "coo", self._sizes.get(t)) for t in self.edge_types()]

    def edge_types(self) -> list[EdgeType]:
        return sorted(self._edges)

    def edges(self) -> dict[EdgeType, DataFrame]:
        return dict(self._edges)

    def counts(self) -> dict[str, int]:
        return vertex_counts(self._edges, self._sizes)

    def offsets(self) -> dict[str, int]:
        return vertex_offsets(self.counts())

    @property
    def is_homogeneous(self) -> bool:
        return len({x for t in self._edges for x in (t.nbr, t.ctr)}) == 1

    def graph(self) -> DataFrame:
        if self._merged is None:
            self._merged = merged_edges(self._edges, self.counts())
        return self._merged
