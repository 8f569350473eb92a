"""Property graphs: edges (s, t) between node indexes, degrees, hubs, communities, layout."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import ship_package


def valid_edges(edges: DataFrame, nodes: DataFrame, index: str = "node") -> DataFrame:
    """Edges without self-loops whose ends are both nodes."""
    known = nodes.select(index).distinct()
    one = edges.where("s IS NOT NULL AND t IS NOT NULL AND s <> t").join(known.withColumnRenamed(index, "s"), "s", "left_semi")
    return one.join(known.withColumnRenamed(index, "t"), "t", "left_semi").select("s", "t")


def neighbours(edges: DataFrame) -> DataFrame:
    """(node, neighbour): distinct undirected pairs, both ways."""
    return edges.select(F.col("s").alias("node"), F.col("t").alias("neighbour")).union(edges.select(F.col("t").alias("node"), F.col("s").alias("neighbour"))).where("node <> neighbour").distinct()


def linked_degrees(edges: DataFrame) -> DataFrame:
    """The ends of edges that have a neighbour, with their number of distinct neighbours."""
    return neighbours(edges).groupBy("node").agg(F.count("*").alias("degree"))


def degrees(edges: DataFrame, nodes: DataFrame, index: str = "node") -> DataFrame:
    """Every node with its number of distinct neighbours and that over the largest (at least 1)."""
    counted = linked_degrees(valid_edges(edges, nodes, index))
    all_ = nodes.select(F.col(index).alias("node")).distinct().join(counted, "node", "left").select("node", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))
    largest = counted.agg(F.greatest(F.coalesce(F.max("degree"), F.lit(1)), F.lit(1)).alias("largest"))
    return all_.crossJoin(F.broadcast(largest)).select("node", "degree", (F.col("degree") / F.col("largest")).alias("degree_share"))  # one row of largest


def top_hubs(degree: DataFrame, n: int = 6) -> DataFrame:
    """The n nodes of the highest degree, ties by index; a report of n rows."""
    return degree.orderBy(F.col("degree").desc(), "node").limit(n)


def isolated(edges: DataFrame, nodes: DataFrame, index: str = "node") -> DataFrame:
    linked = valid_edges(edges, nodes, index)
    ends = linked.select(F.col("s").alias(index)).union(linked.select(F.col("t").alias(index)))
    return nodes.join(ends.distinct(), index, "left_anti")


def community_counts(nodes: DataFrame, community: str = "c") -> DataFrame:
    return nodes.groupBy(community).agg(F.count("*").alias("nodes"))


def with_ends(edges: DataFrame, nodes: DataFrame, columns: list[str], index: str = "node") -> DataFrame:
    """Edges with the columns of both ends, prefixed s_ and t_."""
    side = lambda p: nodes.select(F.col(index).alias(p), *[F.col(c).alias(f"{p}_{c}") for c in columns])
    return edges.join(side("s"), "s").join(side("t"), "t")


def first_index(nodes: DataFrame, name: str = "name", index: str = "node") -> DataFrame:
    """The least index of every name."""
    return nodes.groupBy(name).agg(F.min(index).alias(index))


def bounding_box(places: DataFrame) -> DataFrame:
    return places.agg(*[f(c).alias(f"{f.__name__}_{c}") for c in ("x", "y") for f in (F.min, F.max)])


def _fnv1a(text: str) -> int:
    h = 0x811C9DC5
    for c in text.encode("utf-16-le")[::2] if text.isascii() else [ord(c) for c in text]:
        h = (h ^ c) * 0x01000193 & 0xFFFFFFFF
    return h


def _generator(seed: int):
    """mulberry32: numbers from 0 to 1."""
    a = seed
    while True:
        a = (a + 0x6D2B79F5) & 0xFFFFFFFF
        t = (a ^ (a >> 15)) * (1 | a) & 0xFFFFFFFF
        t = (t + ((t ^ (t >> 7)) * (61 | t) & 0xFFFFFFFF)) & 0xFFFFFFFF ^ t
        yield (t ^ (t >> 14)) / 4294967296


#: Fixed values of the force layout.
LAYOUT = {"iterations": 320, "repulsion": 5200.0, "length": 56.0, "stiffness": 0.012, "centre": 0.0016, "damping": 0.86, "largest_step": 90.0, "spread": 600.0}
MAX_LAYOUT_NODES = 5000


#: Rows of the table of distances that are held at once.
LAYOUT_BLOCK = 512


def force_layout(ids: list[str], s: np.ndarray, t: np.ndarray, seed: str) -> np.ndarray:
    """Positions after a fixed number of cooled spring steps; angles by node id, radii by seed and order."""
    n, p = len(ids), LAYOUT
    shared = _generator(_fnv1a(seed))
    at = np.zeros((n, 2))
    for i, node in enumerate(ids):
        angle, radius = next(_generator(_fnv1a(f"node-{node}"))) * 2 * math.pi, math.sqrt(next(shared)) * p["spread"]
        at[i] = math.cos(angle) * radius, math.sin(angle) * radius
    speed, i = np.zeros((n, 2)), np.arange(n)
    for step in range(p["iterations"]):
        for low_row in range(0, n, LAYOUT_BLOCK):
            block = slice(low_row, low_row + LAYOUT_BLOCK)
            away = at[block, None, :] - at[None, :, :]
            square = (away**2).sum(2)
            close = (square < 0.01) & (i[block, None] != i[None, :])
            if close.any():
                a, b = np.nonzero(close)
                own = a + low_row
                low, high, sign = np.minimum(own, b), np.maximum(own, b), np.where(own < b, 1, -1)
                away[a, b] = np.stack([sign * ((low - high) * 0.01 + 0.001), sign * ((low + high) * 0.01 + 0.001)], 1)
                square[a, b] = (away[a, b] ** 2).sum(1)
            square[i[block] - low_row, i[block]] = 1.0
            speed[block] += (away * (p["repulsion"] / (square * np.sqrt(square)))[:, :, None]).sum(1)
        d = at[t] - at[s]
        distance = np.hypot(d[:, 0], d[:, 1])
        distance[distance == 0] = 0.01
        pull = d * ((distance - p["length"]) * p["stiffness"] / distance)[:, None]
        np.add.at(speed, s, pull)
        np.subtract.at(speed, t, pull)
        speed = (speed - at * p["centre"]) * p["damping"]
        move = speed * (1 - step / p["iterations"])
        length = np.hypot(move[:, 0], move[:, 1])
        at += move * np.where(length > p["largest_step"], p["largest_step"] / np.maximum(length, 1e-12), 1.0)[:, None]
    return at


def layout(nodes: DataFrame, edges: DataFrame, seed: str, graph: str | None = None) -> DataFrame:
    """(node, x, y) of each graph, one group per graph (of at most MAX_LAYOUT_NODES nodes).

    nodes has node (0-based index) and id, edges s and t; graph names a column of both
    that tells several graphs apart.
    """
    ship_package(nodes.sparkSession)
    key = graph or "__graph"
    nodes = nodes if graph else nodes.withColumn(key, F.lit(0))
    edges = edges if graph else edges.withColumn(key, F.lit(0))
    kind = dict(nodes.dtypes)[key]

    def run(_, own: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
        if len(own) > MAX_LAYOUT_NODES:
            raise ValueError(f"a layout takes at most {MAX_LAYOUT_NODES} nodes")
        own = own.sort_values("node")
        n = len(own)
        ok = links[(links["s"] != links["t"]) & links["s"].between(0, n - 1) & links["t"].between(0, n - 1)].sort_values(["s", "t"])
        at = force_layout(own["id"].astype(str).tolist(), ok["s"].to_numpy(int), ok["t"].to_numpy(int), seed)
        return pd.DataFrame({key: own[key], "node": own["node"], "x": at[:, 0] if n else [], "y": at[:, 1] if n else []})

    out = nodes.select(key, "node", "id").groupBy(key).cogroup(edges.select(key, "s", "t").groupBy(key)).applyInPandas(run, f"`{key}` {kind}, node long, x double, y double")
    return out if graph else out.drop(key)


def degree_rank(degree: DataFrame, *partition: str) -> DataFrame:
    return degree.withColumn("rank", F.row_number().over(Window.partitionBy(*partition).orderBy(F.col("degree").desc(), "node")))
