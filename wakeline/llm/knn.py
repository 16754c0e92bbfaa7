"""Exact top-k inner-product search by a Voronoi partitioning with bounds from summaries.

1. A bounded set of pivots is chosen from the data by hash order.
2. Every vector goes to its nearest pivot's cell.  A cell's summary holds its
   size, its radius and its smallest pivot distances: a few numbers per cell.
3. For a query q and a vector x of cell p, ``|q.x - q.p| <= |q| |x - p|``.  The
   smallest distances of all cells give a score that at least k vectors reach;
   a cell is searched only if its upper bound reaches it.
4. Queries are replicated to just those cells.  Cells are dealt in blocks of
   bounded size, queries in blocks as well, and each pair of blocks is solved by
   one matrix product; a query's partial top-k lists then meet in one window.

Scores are exact integers: ``floor(1024 * x)`` per component, products summed in
doubles where every partial sum stays below 2**53, else in Python integers that are
cut to the range of a long.

Defined results: vectors that are null or hold null or non-finite
components take no part, nor do rows without an id; a vector is scored only
against vectors of its own length, so empty ones score 0 with each other.  Every row is a candidate: rows with the same id and vector meet as one
with their number and are listed as often as they occur.  Several query rows of one id are queries each,
ranked together by the query's id.  A query never returns its own id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PIVOTS = 64  # cells; their vectors are the only ones that the driver sees
CELL_BLOCK = 4096  # vectors of a cell that are solved together
QUERY_BLOCK = 2048  # queries that are solved together
OWN = 16  # vectors under a query's own id that the bounds allow for; with more of them a query goes to all cells
_LONG = 2**63 - 1


def quantised(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(id, v, n): the distinct ids and usable vectors, components floor(scale * x) as doubles, and their numbers of rows."""
    v = F.col(vector_col)
    usable = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return (
        vectors.where(F.col(id_col).isNotNull() & v.isNotNull() & usable)
        .select(F.col(id_col).cast("long").alias("id"), v.alias("v"))
        .groupBy("id", "v").agg(F.count("*").alias("n"))
        .select("id", F.transform("v", lambda x: F.floor(x.cast("double") * scale).cast("double")).alias("v"), "n")
    )


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.stack(vectors.to_numpy()).astype(np.float64)


def _scores(queries: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Exact inner products as int64."""
    most = np.abs(queries).max(initial=0) * np.abs(data).max(initial=0) * data.shape[1]
    if most < 2**53:
        return (queries @ data.T).astype(np.int64)
    whole = [[int(x) for x in row] for row in data]
    out = np.empty((len(queries), len(data)), np.int64)
    for i, q in enumerate([[int(x) for x in row] for row in queries]):
        out[i] = [max(-_LONG - 1, min(_LONG, sum(a * b for a, b in zip(q, x, strict=True)))) for x in whole]
    return out


class Cells:
    """Pivots by vector length, and after the summary each cell's size, radius and least distances."""

    def __init__(self, pivots: list[list[float]]):
        self.pivots: dict[int, np.ndarray] = {}
        self.names: dict[int, np.ndarray] = {}
        self.dims = np.array([len(p) for p in pivots], np.int64)
        for dim in sorted(set(self.dims.tolist())):
            self.names[dim] = np.flatnonzero(self.dims == dim)
            self.pivots[dim] = np.array([pivots[c] for c in self.names[dim]])
        self.size = np.zeros(len(pivots), np.int64)
        self.radius = np.zeros(len(pivots))
        self.least: list[list[float]] = [[] for _ in pivots]

    def nearest(self, dim: int, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cell and distance to its pivot, each vector's; the distance is rounded up a little."""
        p = self.pivots[dim]
        d2 = (data * data).sum(1)[:, None] - 2 * (data @ p.T) + (p * p).sum(1)
        best = d2.argmin(1)
        dist = np.sqrt(((data - p[best]) ** 2).sum(1)) * (1 + 1e-9) + 1e-6
        return self.names[dim][best], dist

    def search(self, dim: int, queries: np.ndarray, k: int, same: np.ndarray) -> np.ndarray:
        """Which of ``names[dim]`` each query has to search; ``same`` counts the vectors under its own id."""
        names, p = self.names[dim], self.pivots[dim]
        product, norm = queries @ p.T, np.sqrt((queries * queries).sum(1))[:, None] * (1 + 1e-9)
        slack = 1e-9 * np.abs(product) + 1e-6
        highest = product + norm * self.radius[names] + slack
        at = np.repeat(np.arange(len(names)), [len(self.least[c]) for c in names])
        least = np.array([d for c in names for d in self.least[c]])
        lowest = product[:, at] - norm * least - slack[:, at]
        # The query's own vectors may be among them, so k others reach the bound that comes after as many more.
        reached = np.full(len(queries), -np.inf)
        place = k + np.maximum(same, 1) - 1
        for p in np.unique(place[place < min(lowest.shape[1], k + OWN)]):
            on = place == p
            reached[on] = -np.partition(-lowest[on], p, axis=1)[:, p]
        return (highest >= reached[:, None]) & (self.size[names] > 0)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 1024, pivots: int = PIVOTS) -> DataFrame:
    """Each query's k highest-scoring other vectors: query_id, rank (from 1), ``id_col``, score; ties to smaller ids."""
    spark = vectors.sparkSession
    data, asked = quantised(vectors, id_col, vector_col, scale), quantised(queries, id_col, vector_col, scale)
    same = data.join(asked.select("id").distinct(), "id", "left_semi").groupBy("id").agg(F.count("*").alias("same"))
    asked = asked.join(same, "id", "left").fillna(0, ["same"])
    # A pivot for every vector length, then others by hash order: at most `pivots` and the number of lengths.
    first = data.groupBy(F.size("v").alias("dim")).agg(F.min_by("v", F.xxhash64("id", "v")).alias("v")).select("v")
    others = data.orderBy(F.xxhash64("id", "v"), "id", "v").select("v").limit(pivots)
    cells = Cells(sorted({tuple(r["v"]) for r in first.union(others).collect()}, key=lambda v: (len(v), v)))
    shared = spark.sparkContext.broadcast(cells)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for dim, own in batch.groupby(batch["v"].map(len)):
                cell, dist = shared.value.nearest(dim, _matrix(own["v"]))
                yield pd.DataFrame({"cell": cell.astype(np.int32), "dist": dist, "id": own["id"].array, "v": own["v"].array, "n": own["n"].array})

    in_cell = data.mapInPandas(assign, "cell int, dist double, id long, v array<double>, n long")

    def summarise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[int, list] = {}
        for batch in batches:
            for cell, own in batch.groupby("cell"):
                n, far, least = seen.get(cell, (0, 0.0, []))
                seen[cell] = n + len(own), max(far, own["dist"].max()), sorted([*least, *own["dist"].nsmallest(k + OWN)])[: k + OWN]
        yield pd.DataFrame([(c, *x) for c, x in seen.items()], columns=["cell", "n", "far", "least"])

    parts = in_cell.select("cell", "dist").mapInPandas(summarise, "cell int, n long, far double, least array<double>")
    summary = parts.groupBy("cell").agg(
        F.sum("n").alias("n"), F.max("far").alias("far"), F.slice(F.array_sort(F.flatten(F.collect_list("least"))), 1, k + OWN).alias("least")
    )
    for r in summary.collect():  # a row for each cell
        cells.size[r["cell"]], cells.radius[r["cell"]], cells.least[r["cell"]] = r["n"], r["far"], list(r["least"])
    bounds = spark.sparkContext.broadcast(cells)
    blocks = F.lit((cells.size // CELL_BLOCK + 1).astype(int).tolist() or [1]).cast("array<int>")
    members = in_cell.select("cell", F.pmod(F.xxhash64("id", "v"), F.element_at(blocks, F.col("cell") + 1).cast("long")).cast("int").alias("block"), "id", "v", "n")

    def replicate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for dim, own in batch.groupby(batch["v"].map(len)):
                if dim in bounds.value.names:
                    row, at = np.nonzero(bounds.value.search(dim, _matrix(own["v"]), k, own["same"].to_numpy()))
                    yield pd.DataFrame({"cell": bounds.value.names[dim][at].astype(np.int32), "id": own["id"].to_numpy()[row], "v": own["v"].to_numpy()[row], "n": own["n"].to_numpy()[row]})

    sent = asked.mapInPandas(replicate, "cell int, id long, v array<double>, n long")
    per_cell = sent.groupBy("cell").agg((F.floor(F.count("*") / QUERY_BLOCK) + 1).cast("int").alias("groups"))
    groups = {r["cell"]: r["groups"] for r in per_cell.collect()}
    n_groups = F.lit([groups.get(c, 0) for c in range(len(cells.size))] or [0]).cast("array<int>")
    groups_of = F.element_at(n_groups, F.col("cell") + 1)
    left = sent.select(
        "cell",
        F.explode(F.sequence(F.lit(0), F.element_at(blocks, F.col("cell") + 1) - 1)).alias("block"),
        F.pmod(F.xxhash64("id", "v"), groups_of.cast("long")).cast("int").alias("part"),
        "id",
        "v",
        "n",
    )
    right = members.where(groups_of > 0).select("cell", "block", F.explode(F.sequence(F.lit(0), groups_of - 1)).alias("part"), "id", "v", "n")

    def solve(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(asked) and len(held):
            held = held.sort_values("id")
            ids, own = held["id"].to_numpy(), asked["id"].to_numpy()
            times, copies = np.minimum(held["n"].to_numpy(), k), np.minimum(asked["n"].to_numpy(), k)
            scores = _scores(_matrix(asked["v"]), _matrix(held["v"]))
            for i, q in enumerate(own):
                at = np.flatnonzero(ids != q)
                if len(at) > k:  # keep ties with the k-th, then cut by id
                    cut = -np.partition(-scores[i, at], k - 1)[k - 1]
                    at = at[scores[i, at] >= cut]
                best = at[np.lexsort((ids[at], -scores[i, at]))][:k]
                best = np.repeat(best, times[best] * copies[i])[:k]  # as many rows as there are
                out.append(pd.DataFrame({"query_id": q, "vec": ids[best], "score": scores[i, best]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec": [], "score": []})

    keys = ["cell", "block", "part"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(solve, "query_id long, vec long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", F.col("vec").alias(id_col), "score")


def op2_knn(spark, sf_dir: str) -> DataFrame:
    """The ten highest-scoring rows of each query, vec_ids divisible by 100, among all other ids' rows."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return top_k(vectors, vectors.where(F.col("vec_id") % 100 == 0))


OP2_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, d.vec_id, coalesce(list_sum(list_transform(list_zip(q.e, d.e), lambda p: p[1] * p[2])), 0)::BIGINT AS score
  FROM v q JOIN v d ON q.vec_id % 100 = 0 AND q.vec_id <> d.vec_id AND len(q.e) = len(d.e)
)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score FROM s
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 10
"""
