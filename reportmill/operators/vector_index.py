"""A stored index of vectors in clusters, searched exactly in the few clusters that can hold a nearest one.

Every vector lies within its cluster's radius of the centroid, so none of the cluster is nearer to a question than the
centroid's distance less the radius. A search looks into the clusters nearest to each question first and then only into
those that this bound does not rule out.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.store import kept, read_table, remove, replace_rows
from .retrieve import nearest

#: Clusters that a centroid table has at most, and numbers in it: it is held by every task.
CLUSTERS, NUMBERS = 4096, 1 << 23
#: Vectors a cluster that centroids are fitted on: a sample of them, by the hash of their ids. All vectors are stored.
FITTED = 64
#: The cluster of vectors that are null or of another length than the index: kept, never found.
NOWHERE = -1
RADII = "cluster int, n long, radius double"


class VectorIndex:
    """Rows of `schema` (with an id, an owner by which they are replaced, and a vector) under path, by cluster; centroids and
    radii lie beside them."""

    def __init__(self, spark: SparkSession, path: str, schema: str, id: str = "chunk_id", owner: str = "file_name", vector: str = "embedding"):
        self.spark, self.path = spark, path.rstrip("/")
        self.id, self.owner, self.vector = id, owner, vector
        self.schema = f"{schema}, distance double, cluster int"
        self._centroids = np.zeros((0, 0))

    def drop(self) -> None:
        """Remove all of it."""
        for path in (self.path, f"{self.path}_centroids", f"{self.path}_radii"):
            remove(self.spark, path)
        self._centroids = np.zeros((0, 0))

    def rebuild(self, clusters: int | None = None) -> None:
        """Choose the centroids anew, for the vectors that there are by now, and deal all rows out to them."""
        rows = self.rows().drop("distance", "cluster")
        held = kept(rows, "rows")
        self.drop()
        self.fit(held, clusters)
        self.put(held)
        remove(self.spark, held.kept_in)

    def rows(self, clusters: list[int] | None = None) -> DataFrame:
        """All rows, or those of some clusters: only their partitions are read."""
        out = read_table(self.spark, self.path, self.schema)
        return out if clusters is None else out.filter(F.col("cluster").isin(clusters))

    @property
    def centroids(self) -> np.ndarray:
        """Read once there are any; they stay as they are until a rebuild."""
        if not len(self._centroids):
            held = read_table(self.spark, f"{self.path}_centroids", "cluster int, centroid array<double>").orderBy("cluster").collect()  # bounded by NUMBERS
            self._centroids = np.array([r.centroid for r in held], float)
        return self._centroids

    def fit(self, rows: DataFrame, clusters: int | None = None) -> None:
        """Choose the centroids, once: `clusters` of them, or the square root of the number of rows, from a sample."""
        v = rows.select(F.col(self.id).alias("id"), F.col(self.vector).cast("array<double>").alias("v")).filter("v IS NOT NULL AND size(v) > 0")
        first = v.select(F.size("v").alias("dim")).groupBy("dim").count().orderBy(F.desc("count"), "dim").first()
        if not first:
            return
        k = max(1, min(clusters or math.ceil(math.sqrt(first["count"])), CLUSTERS, NUMBERS // first.dim, first["count"]))
        sample = v.filter(F.size("v") == first.dim).orderBy(F.xxhash64("id"), "id").limit(FITTED * k)
        if k == 1:
            centres = [sample.first().v]
        else:
            centres = KMeans(k=k, seed=1, maxIter=10, featuresCol="features").fit(sample.select(array_to_vector("v").alias("features"))).clusterCenters()
        found = [(i, [float(x) for x in c]) for i, c in enumerate(centres)]
        self.spark.createDataFrame(found, "cluster int, centroid array<double>").coalesce(1).write.mode("overwrite").parquet(f"{self.path}_centroids")
        self._centroids = np.zeros((0, 0))

    def put(self, rows: DataFrame, owners: DataFrame | None = None) -> list[int]:
        """Rows in place of all that their owners have here; the clusters rewritten. The first call fits the centroids.

        owners(owner): whose rows go, where these are more than those of `rows`.
        """
        batch = kept(rows, "vectors")
        if not len(self.centroids):
            self.fit(batch)
        held = self.spark.sparkContext.broadcast(self.centroids)
        vector = F.col(self.vector).cast("array<double>")
        dim = held.value.shape[1] if len(held.value) else 0

        @F.pandas_udf("cluster int, distance double")
        def place(v: pd.Series) -> pd.DataFrame:
            v = np.stack(v.to_numpy())
            at = squares(v, held.value)[0].argmin(axis=1)
            return pd.DataFrame({"cluster": at.astype(np.int32), "distance": np.linalg.norm(v - held.value[at], axis=1)})

        fits = F.coalesce((F.size(vector) == dim) & (F.lit(dim) > 0), F.lit(False))
        near = batch.filter(fits).withColumn("_p", place(vector)).select(*batch.columns, "_p.distance", "_p.cluster")
        rest = batch.filter(~fits).select("*", F.lit(None).cast("double").alias("distance"), F.lit(NOWHERE).alias("cluster"))
        placed = kept(near.unionByName(rest), "placed")
        # radii grow before rows come and shrink after they have gone, so that a search between the two is right
        noted = read_table(self.spark, f"{self.path}_radii", RADII)
        grown = noted.unionByName(self._measured(placed)).groupBy("cluster").agg(F.sum("n").alias("n"), F.max("radius").alias("radius"))
        self._note(grown)
        touched = replace_rows(self.spark, self.path, self.schema, placed, owners or batch.select(self.owner), self.owner, "cluster")
        others = read_table(self.spark, f"{self.path}_radii", RADII).filter(~F.col("cluster").isin(touched))
        self._note(others.unionByName(self._measured(self.rows(touched))))
        remove(self.spark, batch.kept_in)
        remove(self.spark, placed.kept_in)
        return touched

    def _measured(self, rows: DataFrame) -> DataFrame:
        return rows.filter("cluster >= 0").groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.max("distance").alias("radius"))

    def _note(self, radii: DataFrame) -> None:
        found = [tuple(r) for r in radii.collect()]  # at most one a cluster
        self.spark.createDataFrame(found, RADII).coalesce(1).write.mode("overwrite").parquet(f"{self.path}_radii")

    def radii(self) -> tuple[np.ndarray, np.ndarray]:
        """Rows and radius of each cluster, by its number."""
        n, radius = np.zeros(len(self.centroids), np.int64), np.zeros(len(self.centroids))
        for r in read_table(self.spark, f"{self.path}_radii", RADII).collect():
            n[r.cluster], radius[r.cluster] = r.n, r.radius
        return n, radius

    def search(self, queries: DataFrame, k: int = 5, query_id: str = "query_id", block: int = 4096, group: int = 65_536) -> DataFrame:
        """query_id, id, score, rank, cluster: each query's k nearest rows by squared distance, ties to the smaller id.

        The same rows as a scan of all vectors. Queries without a vector or of another length find nothing. `reads` tells
        afterwards which clusters were looked into. A task holds some `group` vectors and `block` queries.
        """
        types = f"`{query_id}` {queries.schema[query_id].dataType.simpleString()}, `{self.id}` {self.rows().schema[self.id].dataType.simpleString()}, score double, cluster int"
        self.reads: set[int] = set()
        if not len(self.centroids):
            return self.spark.createDataFrame([], types).withColumn("rank", F.lit(0)).select(query_id, self.id, "score", "rank", "cluster")
        n, radius = self.radii()
        held, dim = self.spark.sparkContext.broadcast((self.centroids, n, radius)), self.centroids.shape[1]
        q = queries.select(F.col(query_id).alias("q"), F.col(self.vector).cast("array<double>").alias("v")).filter(F.size("v") == dim)
        q = kept(q, "queries")

        @F.pandas_udf("array<int>")
        def first(v: pd.Series) -> pd.Series:
            """The nearest clusters that together have k vectors."""
            centroids, n, _ = held.value
            order = np.argsort(squares(np.stack(v.to_numpy()), centroids)[0], axis=1, kind="stable")
            out = []
            for row in order:
                row = row[n[row] > 0]
                out.append(row[: np.searchsorted(np.cumsum(n[row]), k) + 1].astype(np.int32))
            return pd.Series(out)

        @F.pandas_udf("array<int>")
        def others(v: pd.Series, worst: pd.Series, seen: pd.Series) -> pd.Series:
            """The other clusters that can hold a vector as near as the k-th found so far."""
            centroids, n, radius = held.value
            square, off = squares(np.stack(v.to_numpy()), centroids)
            least = np.maximum(np.sqrt(np.maximum(square - off, 0)) - radius * (1 + 1e-12), 0) ** 2
            open_ = (least <= worst.fillna(np.inf).to_numpy()[:, None] + 2e-6) & (n > 0)
            for row, at in zip(open_, seen, strict=True):
                row[np.asarray(at, int)] = False
            return pd.Series([np.flatnonzero(row).astype(np.int32) for row in open_])

        order = Window.partitionBy(query_id).orderBy(F.round("score", 6), self.id)
        asked = kept(q.withColumn("seen", first("v")), "asked")
        near = kept(self._compare(asked.select("q", "v", F.explode("seen").alias("cluster")), k, query_id, types, n, block, group), "near")
        ranked = near.withColumn("rank", F.row_number().over(order))
        worst = ranked.filter(F.col("rank") == k).select(F.col(query_id).alias("q"), F.round("score", 6).alias("worst"))
        more = kept(asked.join(worst, "q", "left").select("q", "v", F.explode(others("v", "worst", "seen")).alias("cluster")), "more")
        far = self._compare(more, k, query_id, types, n, block, group)
        out = near.unionByName(far).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        out = kept(out.select(query_id, self.id, "score", "rank", "cluster"), "hits")
        for table in (q, asked, near, more):
            remove(self.spark, table.kept_in)
        return out

    def _compare(self, pairs: DataFrame, k: int, query_id: str, types: str, n: np.ndarray, block: int, group: int) -> DataFrame:
        """The k best of each (query, cluster) pair, or of each slice of a large cluster."""
        asked = {r[0]: r[1] for r in pairs.groupBy("cluster").count().collect()}  # at most one a cluster
        self.reads |= set(asked)
        cut = [(c, max(1, -(-int(n[c]) // group)), max(1, -(-m // block))) for c, m in asked.items()]
        sizes = F.broadcast(self.spark.createDataFrame(cut, "cluster int, groups int, blocks int"))  # at most CLUSTERS rows
        numbers = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
        left = pairs.join(sizes, "cluster").withColumn("b", F.pmod(F.xxhash64("q"), F.col("blocks")).cast("int")).withColumn("g", numbers("groups"))
        right = self.rows(sorted(asked)).select(F.col(self.id).alias("c"), F.col(self.vector).cast("array<double>").alias("v"), "cluster")
        right = right.join(sizes, "cluster").withColumn("g", F.pmod(F.xxhash64("c"), F.col("groups")).cast("int")).withColumn("b", numbers("blocks"))
        compare = nearest(k, query_id, self.id)

        def run(q, c):
            out = compare(q, c)
            cluster = (q if q.num_rows else c).column("cluster")[0]
            return out.append_column("cluster", pa.array([cluster.as_py()] * out.num_rows, pa.int32()))

        return left.select("q", "v", "cluster", "b", "g").groupBy("cluster", "b", "g").cogroup(right.select("c", "v", "cluster", "b", "g").groupBy("cluster", "b", "g")).applyInArrow(run, types)

    def fetch(self, hits: DataFrame, columns: list[str]) -> DataFrame:
        """hits with columns of their rows, read from their clusters' partitions."""
        clusters = sorted(r[0] for r in hits.select("cluster").distinct().collect())  # at most one a cluster
        rows = self.rows(clusters).select(self.id, "cluster", *[c for c in columns if c not in (self.id, "cluster")])
        return hits.join(rows, [self.id, "cluster"])


def squares(v: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The squared distance of each vector from each centroid, and how far rounding can have taken it at most."""
    a, b = (v**2).sum(axis=1)[:, None], (centroids**2).sum(axis=1)
    return a - 2 * v @ centroids.T + b, 4e-16 * (v.shape[1] + 8) * (a + b)
