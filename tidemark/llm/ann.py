"""Nearest neighbours by largest inner product: a navigable small-world graph for each shard.

Equal vectors are one node with its smallest ids (as many as a result can hold), so
a very common vector is a single node. Nodes are dealt into shards by hash; each shard
builds its hierarchical graph in one task, with many nodes searching the graph in
lockstep, and stores it as flat neighbour arrays. Every query vector walks the graph of
every shard, whatever its size, and the results are merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved

#: Nodes of a shard at most, on average; small tables are spread over up to SPREAD shards of so many nodes at least.
SHARD_NODES = 32_768
SPREAD, LEAST_NODES = 8, 1_024
#: Query vectors that one task searches in one shard.
QUERY_BLOCK = 8_192
LINKS, BUILD_WIDTH, SEARCH_WIDTH = 16, 64, 96
STEP, STRIDE = 512, 4


class Graph:
    """A hierarchical graph over the rows of a matrix, as flat neighbour arrays.

    ``layers``: from the top down, (members, links): row numbers in order of insertion,
    and for each member the places of its neighbours in ``members`` (-1: none). Lower
    layers begin with the members of the one above, so places carry over.
    """

    def __init__(self, rows: np.ndarray):
        """Rows are float32 and all of one length (norm); nearness is the inner product."""
        self.rows, self.layers = rows, []

    @classmethod
    def build(cls, rows: np.ndarray) -> Graph:
        self = cls(rows)
        n = len(rows)
        rng = np.random.default_rng(n)
        level = np.floor(-np.log(1 - rng.random(n)) / np.log(LINKS)).astype(int)
        order = np.lexsort((rng.random(n), -level))
        sizes = [s for k in range(int(level.max()), 0, -1) if (s := int((level >= k).sum())) > 4] + [n]
        for size in sizes:
            self._layer(order[:size], LINKS * 2)
        return self

    def _layer(self, members: np.ndarray, most: int) -> None:
        links = np.full((len(members), most), -1, np.int32)
        v = self.rows[members]
        begin = 0
        while begin < len(members):
            end = min(len(members), begin + max(256, min(STEP, begin)))
            here = np.arange(begin, end)
            near = v[here] @ v[here].T
            np.fill_diagonal(near, -np.inf)
            k = min(BUILD_WIDTH, end - begin - 1)
            if k > 0:
                inside = np.argpartition(-near, k - 1, axis=1)[:, :k]
                found, score = here[inside], np.take_along_axis(near, inside, 1)
            else:
                found, score = np.zeros((len(here), 0), np.int64), np.zeros((len(here), 0), np.float32)
            if begin:
                old, s = self._beam(v, links, v[here], self._entries(v[here], begin), BUILD_WIDTH)
                found, score = np.concatenate((found, old), 1), np.concatenate((score, s), 1)
            if found.shape[1]:
                chosen = self._spread(v, found, score, LINKS)
                a, b = np.nonzero(chosen >= 0)
                self._connect(v, links, here[a], chosen[a, b])
            begin = end
        self.layers.append((members.astype(np.int32), links))

    @staticmethod
    def _spread(v: np.ndarray, found: np.ndarray, score: np.ndarray, most: int) -> np.ndarray:
        """Of each row's candidates up to ``most``, nearest first, each nearer to the row than to those chosen;
        then the nearest of the rest."""
        k = min(found.shape[1], BUILD_WIDTH)
        top = np.argsort(-score, axis=1, kind="stable")[:, :k]
        found, score = np.take_along_axis(found, top, 1), np.take_along_axis(score, top, 1)
        ok = (found >= 0) & np.isfinite(score)
        x = v[np.maximum(found, 0)]
        between = np.einsum("bid,bjd->bij", x, x, optimize=True)
        taken, worst = np.zeros(ok.shape, bool), np.full(ok.shape, -np.inf, np.float32)
        for j in range(k):
            new = ok[:, j] & (score[:, j] > worst[:, j]) & (taken.sum(1) < most)
            taken[:, j] = new
            worst[new] = np.maximum(worst[new], between[new, j])
        rest = np.cumsum(ok & ~taken, 1) <= (most - taken.sum(1))[:, None]
        taken |= ok & rest
        out = np.full((len(found), most), -1, np.int64)
        a, b = np.nonzero(taken)
        out[a, (np.cumsum(taken, 1) - 1)[a, b]] = found[a, b]
        return out

    @staticmethod
    def _connect(v: np.ndarray, links: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
        """Links both ways; a full list keeps its nearest."""
        src, dst = np.concatenate((a, b)), np.concatenate((b, a))
        touched = np.unique(src)
        i, j = np.nonzero(links[touched] >= 0)
        src, dst = np.concatenate((src, touched[i])), np.concatenate((dst, links[touched][i, j]))
        key = np.unique(src.astype(np.int64) * len(links) + dst)
        src, dst = key // len(links), key % len(links)
        order = np.lexsort((-np.einsum("nd,nd->n", v[src], v[dst]), src))
        src, dst = src[order], dst[order]
        first = np.concatenate(([True], src[1:] != src[:-1]))
        rank = np.arange(len(src)) - np.flatnonzero(first)[np.cumsum(first) - 1]
        keep = rank < links.shape[1]
        links[touched] = -1
        links[src[keep], rank[keep]] = dst[keep]

    def _entries(self, q: np.ndarray, ready: int) -> np.ndarray:
        """For each query a place from which to search the layer below those that are complete."""
        at = np.zeros((len(q), 1), np.int64)
        for members, links in self.layers:
            at = self._beam(self.rows[members], links, q, at, 8)[0][:, :1]
        return np.minimum(at, ready - 1)

    @staticmethod
    def _beam(v: np.ndarray, links: np.ndarray, q: np.ndarray, entry: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Best-first search of one layer by all queries in lockstep: places and products, best first."""
        n, reach = len(q), links.shape[1]
        ids, score = np.full((n, width), -1, np.int64), np.full((n, width), -np.inf, np.float32)
        open_ = np.zeros((n, width), bool)
        e = entry.shape[1]
        ids[:, :e], score[:, :e], open_[:, :e] = entry, np.einsum("bed,bd->be", v[entry], q), True
        seen = np.zeros((n, len(v)), bool)
        np.put_along_axis(seen, entry, True, 1)
        live = np.arange(n)
        while len(live):
            o = open_[live]
            pick = o & (np.cumsum(o, 1) <= STRIDE)
            a, b = np.nonzero(pick)
            slot = (np.cumsum(pick, 1) - 1)[a, b]
            o[a, b] = False
            nodes = np.full((len(live), STRIDE), -1, np.int64)
            nodes[a, slot] = ids[live][a, b]
            next_ = np.where(nodes[:, :, None] >= 0, links[nodes], -1).reshape(len(live), STRIDE * reach)
            next_ = np.sort(next_, 1)
            ok = next_ >= 0
            ok[:, 1:] &= next_[:, 1:] != next_[:, :-1]
            ok &= ~seen[live[:, None], next_]
            a, b = np.nonzero(ok)
            seen[live[a], next_[a, b]] = True
            s = np.full(next_.shape, -np.inf, np.float32)
            s[a, b] = np.einsum("nd,nd->n", v[next_[a, b]], q[live[a]])
            all_s, all_i = np.concatenate((score[live], s), 1), np.concatenate((ids[live], next_), 1)
            all_o = np.concatenate((o, ok), 1)
            top = np.argpartition(-all_s, width - 1, axis=1)[:, :width]
            top = np.take_along_axis(top, np.argsort(-np.take_along_axis(all_s, top, 1), axis=1), 1)
            score[live] = np.take_along_axis(all_s, top, 1)
            ids[live] = np.where(np.isfinite(score[live]), np.take_along_axis(all_i, top, 1), -1)
            open_[live] = np.take_along_axis(all_o, top, 1) & np.isfinite(score[live])
            live = live[open_[live].any(1)]
        return ids, score

    def search(self, q: np.ndarray, k: int) -> np.ndarray:
        """Row numbers of up to ``k`` near rows for each query, -1 where fewer were found."""
        at = np.zeros((len(q), 1), np.int64)
        for members, links in self.layers[:-1]:
            at = self._beam(self.rows[members], links, q, at, 8)[0][:, :1]
        members, links = self.layers[-1]
        found, score = self._beam(self.rows[members], links, q, at, max(SEARCH_WIDTH, k))
        rows = np.where(found >= 0, members[found], -1)
        return np.take_along_axis(rows, np.lexsort((rows, -score), axis=1)[:, :k], 1)  # of equals the first row


def _level(x: np.ndarray) -> np.ndarray:
    """Rows with one more component that gives all the same norm, so that the graph's
    nearness among rows is that of distance, and to a query (with 0 there) the inner product."""
    norm = (x.astype(np.float64) ** 2).sum(1)
    return np.concatenate((x, np.sqrt(np.maximum(norm.max() - norm, 0))[:, None].astype(np.float32)), 1)


def usable(vector: Column) -> Column:
    """Neither null nor empty, no null or non-finite component, not all zero."""
    finite = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def own_type(vectors: DataFrame) -> str:
    """Components keep their precision: float stays float, all else is double."""
    return "array<float>" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "array<double>"


def _narrow(x: np.ndarray) -> np.ndarray:
    """Rows as float32 for the graph; doubles are first scaled by one number for all, which leaves the order of products."""
    if x.dtype == np.float32:
        return x
    most = np.abs(x).max(initial=0)
    return (x / most if most else x).astype(np.float32)


def nodes(vectors: DataFrame, k: int) -> DataFrame:
    """``dim, node, vector, ids`` for each distinct usable vector: its ``k + 1`` smallest distinct ids (a result
    holds no more of them), ``node`` a number of its own."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(own_type(vectors)).alias("vector")).where(usable(F.col("vector")) & F.col("vec_id").isNotNull())
    rank = F.dense_rank().over(Window.partitionBy("vector").orderBy("vec_id"))  # cut to k + 1 before the shuffle
    few = rows.withColumn("k", rank).where(F.col("k") <= k + 1)
    out = few.groupBy("vector").agg(F.sort_array(F.collect_set("vec_id")).alias("ids"))
    return out.select(F.size("vector").alias("dim"), F.monotonically_increasing_id().alias("node"), "vector", "ids")


def shards_for(nodes: int) -> int:
    """Shards for so many nodes: enough to keep each within ``SHARD_NODES``, and up to ``SPREAD`` for smaller tables."""
    return max(1, -(-nodes // SHARD_NODES), min(SPREAD, nodes // LEAST_NODES))


INDEX = "dim int, shard int, nodes array<long>, firsts array<long>, vectors binary, members array<binary>, links array<binary>"


def build_index(points: DataFrame, shards: int) -> DataFrame:
    """One row a shard: its nodes, vectors and each layer's members and flat neighbour array."""

    def build(table: pa.Table) -> pa.Table:
        table = table.sort_by([("first", "ascending"), ("node", "ascending")])
        x = np.array(table.column("vector").to_pylist(), _dtype(table.schema.field("vector").type))
        graph = Graph.build(_level(_narrow(x)))
        return pa.table(
            {
                "dim": pa.array([table.column("dim")[0].as_py()], pa.int32()),
                "shard": pa.array([table.column("shard")[0].as_py()], pa.int32()),
                "nodes": pa.array([table.column("node").to_pylist()], pa.list_(pa.int64())),
                "firsts": pa.array([table.column("first").to_pylist()], pa.list_(pa.int64())),
                "vectors": pa.array([x.tobytes()], pa.binary()),
                "members": pa.array([[m.tobytes() for m, _ in graph.layers]], pa.list_(pa.binary())),
                "links": pa.array([[a.tobytes() for _, a in graph.layers]], pa.list_(pa.binary())),
            }
        )

    first = F.get("ids", F.lit(0))
    shard = F.pmod(F.xxhash64(first), F.lit(shards)).cast("int")
    return points.select("dim", "node", first.alias("first"), "vector", shard.alias("shard")).groupBy("dim", "shard").applyInArrow(build, INDEX)


def _dtype(kind: pa.DataType) -> type:
    return np.float32 if kind.value_type == pa.float32() else np.float64


def _searcher(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph = own = first = x = loaded = None
        for batch in batches:
            kind = np.array(batch.column("kind").to_pylist())
            group = np.stack([np.array(batch.column(c).to_pylist()) for c in ("dim", "shard", "part")], 1)
            cut = [0, *(np.flatnonzero((kind == 0) | np.append(False, (group[1:] != group[:-1]).any(1) | (kind[1:] != kind[:-1]))).tolist()), len(kind)]
            for lo, hi in zip(cut, cut[1:], strict=False):
                if lo == hi:
                    continue
                key = tuple(group[lo].tolist())
                if kind[lo] == 0:
                    loaded = key
                    r = batch.slice(lo, 1).to_pylist()[0]
                    kind_of = _dtype(batch.schema.field("query_vector").type)
                    own, first, x = np.array(r["nodes"], np.int64), np.array(r["firsts"], np.int64), np.frombuffer(r["vectors"], kind_of).reshape(-1, r["dim"])
                    graph = Graph(_level(_narrow(x)))
                    graph.layers = [(np.frombuffer(m, np.int32), np.frombuffer(a, np.int32).reshape(len(m) // 4, -1)) for m, a in zip(r["members"], r["links"], strict=True)]
                    continue
                if key != loaded:  # no vector of this length is in the shard
                    continue
                for at in range(lo, hi, STEP):
                    part = batch.slice(at, min(STEP, hi - at))
                    q = np.array(part.column("query_vector").to_pylist(), x.dtype)
                    found = graph.search(np.concatenate((_narrow(q), np.zeros((len(q), 1), np.float32)), 1), k)
                    a, b = np.nonzero(found >= 0)
                    row = found[a, b]
                    score = (q[a].astype(np.float64) * x[row].astype(np.float64)).sum(1)
                    yield pa.RecordBatch.from_arrays([part.column("query").take(pa.array(a)), pa.array(own[row]), pa.array(first[row]), pa.array(score)], ["query", "node", "first", "score"])

    return run


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row of ``queries`` the ``k`` rows of ``vectors`` of largest
    inner product other than its own, as found; ties to the smaller vec_id.

    Both have ``vec_id, embedding``, and queries are rows of ``vectors``. Unusable vectors (see
    :func:`usable`) take no part. Vectors of another length are no candidates. Rows that repeat a
    vec_id and its vector count once; a vec_id that has several vectors is asked with each and found once, at
    its largest product, and may then leave fewer than ``k`` others. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    points = saved(nodes(vectors, k))
    asked = queries.select(F.col("vec_id").cast("long").alias("query_id"), F.col("embedding").cast(own_type(vectors)).alias("vector")).where(usable(F.col("vector")))
    asked = saved(asked.join(points.select("vector", "dim", "node"), "vector").select("query_id", "dim", F.col("node").alias("query"), "vector"))
    distinct = asked.select("dim", "query", "vector").dropDuplicates(["query"])
    shards = shards_for(points.count())
    parts = max(1, -(-distinct.count() // QUERY_BLOCK))
    index = saved(build_index(points, shards))
    held = index.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).withColumn("kind", F.lit(0))
    sent = distinct.select(
        "dim", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.pmod(F.xxhash64("query"), F.lit(parts)).cast("int").alias("part"),
        F.lit(1).alias("kind"), "query", F.col("vector").alias("query_vector"),
    )
    key = ["dim", "shard", "part"]
    met = held.unionByName(sent, allowMissingColumns=True).repartition(shards * parts, *key).sortWithinPartitions(*key, "kind")
    found = met.mapInArrow(_searcher(k + 1), "query long, node long, first long, score double")
    best = Window.partitionBy("query").orderBy(F.desc("score"), "first", "node")
    top = found.withColumn("k", F.row_number().over(best)).where(F.col("k") <= k + 1)
    spread = top.join(points.select("node", "ids"), "node").select("query", "score", F.explode("ids").alias("vec_id"))
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    listed = spread.withColumn("k", F.row_number().over(order)).where(F.col("k") <= k + 1)
    listed = listed.groupBy("query").agg(F.collect_list(F.struct("vec_id", "score")).alias("near"))
    met = asked.select("query_id", "query").distinct().join(listed, "query").select("query_id", F.explode("near").alias("x")).where("x.vec_id <> query_id")
    met = met.repartition("query_id").groupBy("query_id", F.col("x.vec_id").alias("vec_id")).agg(F.max("x.score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return met.select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
