"""Exact top-k inner products by no-random-access list aggregation.

Vectors are made of whole numbers (floor of ``scale`` times a component). They
are dealt into shards of bounded size; a shard keeps, for every dimension, its
rows sorted by that component. A query reads each dimension's list from the
end where its own component gives the highest products. After a step down all
lists a row's score lies between what was seen of it plus the least, and plus
the most, that its unseen dimensions can still give (the value at which their
lists stand). Rows whose upper bound is below the k-th best lower bound can
not qualify; reading stops when unread rows can't and few candidates are left
(or the lists end), and the candidates' final scores are resolved. The best k
of each shard are merged.

Queries are dealt into blocks and every block meets every shard, so a task
holds one shard and one block whatever the table's size; partial results are
k rows a query and shard.

Edge cases: vectors that are null, or hold a null or non-finite component, or
have another length than the query's, take no part; an empty vector scores 0
with others of its kind; ties go to the smaller vec_id; a row is never its own
answer (rows are told apart by vec_id, so repeated ids exclude each other); an
empty table has no rows. Scores are 64-bit integers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, pack_ints, unpack_ints

SHARD_ROWS = 16_384
QUERY_ROWS = 1_024
SCHEMA = "query_id long, vec_id long, score long"


def usable(vec: Column) -> Column:
    """Not null, and every component a finite number."""
    def bad(x):
        d = x.cast("double")
        return d.isNull() | F.isnan(d) | (F.abs(d) == F.lit(float("inf")))
    return vec.isNotNull() & ~F.exists(vec, bad)


class Shard:
    """Rows in ascending id order and their sorted lists (read from either
    end). A block of queries reads the lists together: what has been read of
    them is the same for all queries that read from the same end."""

    def __init__(self, ids: np.ndarray, values: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.values = ids[order], values[order]
        self.lists = np.argsort(self.values, axis=0, kind="stable")
        self.sorted = np.take_along_axis(self.values, self.lists, axis=0)

    def top(self, query_ids: np.ndarray, queries: np.ndarray, k: int, few: int = 128) -> list[tuple[int, int, int]]:
        """(query_id, vec_id, score) of each query's k best rows but itself."""
        out = []
        for i in range(0, len(query_ids), 64):
            out += self._top(query_ids[i:i + 64], queries[i:i + 64], k, few)
        return out

    def _top(self, query_ids, queries, k, few):
        n, dims = self.values.shape
        if not dims:
            return [(int(q), int(v), 0) for q in query_ids for v in self.ids[self.ids != q][:k]]
        # Products and sums stay whole: in doubles while they fit, else in 64-bit integers.
        most = float(np.abs(self.values).max()) * float(np.abs(queries).max()) * dims
        kind = np.float64 if most < 2.0 ** 52 else np.int64
        high, low = np.maximum(queries, 0).T.astype(kind), np.minimum(queries, 0).T.astype(kind)
        least = np.iinfo(np.int64).min if kind is np.int64 else -np.inf
        own = self.ids[:, None] == query_ids[None, :]
        # What a row has shown, read from the high end and from the low end; else its list's worst value.
        floor_high = np.broadcast_to(self.sorted[0], (n, dims)).astype(kind)
        floor_low = np.broadcast_to(self.sorted[-1], (n, dims)).astype(kind)
        read_high, read_low = np.zeros((n, dims), bool), np.zeros((n, dims), bool)
        column = np.arange(dims)
        live, out = np.arange(len(query_ids)), []
        depth, step = 0, max(64, n // 8)
        while len(live):
            end = min(n, depth + step)
            for part, floor, read in ((slice(n - end, n - depth), floor_high, read_high), (slice(depth, end), floor_low, read_low)):
                rows = self.lists[part]
                floor[rows, column] = self.sorted[part]
                read[rows, column] = True
            roof_high = np.where(read_high, floor_high, self.sorted[n - end].astype(kind))
            roof_low = np.where(read_low, floor_low, self.sorted[end - 1].astype(kind))
            lower = floor_high @ high[:, live] + floor_low @ low[:, live]
            upper = roof_high @ high[:, live] + roof_low @ low[:, live]
            lower[own[:, live]] = least
            upper[own[:, live]] = least
            kth = np.partition(lower, n - k, axis=0)[n - k] if n > k else np.full(len(live), least)
            can = upper >= kth
            done = (can.sum(0) <= few + k) | (end == n)
            for c in np.flatnonzero(done):
                j = live[c]
                rows = np.flatnonzero(can[:, c] & ~own[:, j])
                final = self.values[rows] @ queries[j]  # resolved for the candidates alone
                best = np.lexsort((self.ids[rows], -final))[:k]
                out += [(int(query_ids[j]), int(self.ids[rows[i]]), int(final[i])) for i in best]
            live = live[~done]
            depth, step = end, end if end < n // 2 else n // 8
        return out


def _packed(df: DataFrame, group: list[str]) -> DataFrame:
    """One row per group: its ids and vectors as packed integers."""
    def pack(batches):
        held: list = []
        last = None

        def row(key, pieces):
            ids = np.concatenate([p[0] for p in pieces])
            vals = np.concatenate([p[1] for p in pieces])
            return pa.RecordBatch.from_arrays(
                [pa.array([v], pa.int32()) for v in key] + [pa.array([len(ids)], pa.int32()), pa.array([pack_ints(ids)], pa.binary()), pa.array([pack_ints(vals)], pa.binary())],
                names=[*group, "n", "ids", "vals"])

        for b in batches:
            if not b.num_rows:
                continue
            keys = np.stack([b[g].to_numpy(zero_copy_only=False) for g in group], 1)
            ids, vec = b["id"].to_numpy(zero_copy_only=False), b["vec"]
            at = vec.offsets.to_numpy()
            flat = vec.values.to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(keys)]):
                key = tuple(int(x) for x in keys[lo])
                if held and key != last:
                    yield row(last, held)
                    held = []
                held.append((ids[lo:hi].astype(np.int64), flat[at[lo]:at[hi]].astype(np.int64)))
                last = key
        if held:
            yield row(last, held)

    schema = ", ".join(f"{g} int" for g in group) + ", n int, ids binary, vals binary"
    return df.select(*group, "id", "vec").repartition(*group).sortWithinPartitions(*group, "id").mapInArrow(pack, schema)


def top_k(vectors: DataFrame, queries: DataFrame, scratch: Scratch, k: int = 10, scale: int = 1024,
          shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """Each query's k best rows: query_id, rank (from 1), vec_id, score.
    ``vectors`` and ``queries``: (vec_id long, embedding array of numbers)."""
    def whole(df: DataFrame) -> DataFrame:
        rows = df.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec")).where(F.col("id").isNotNull() & usable(F.col("vec")))
        vec = F.transform("vec", lambda x: F.floor(x.cast("double") * scale).cast("long"))
        return rows.select("id", vec.alias("vec")).withColumn("dim", F.size("vec"))

    def dealt(df: DataFrame, name: str, rows: int, group: str) -> tuple[DataFrame, list]:
        w = scratch.table(whole(df), f"{name}-rows")
        sizes = w.groupBy("dim").agg(F.ceil(F.count("*") / rows).cast("int").alias("of")).collect()  # a row a dimension
        if not sizes:
            return None, []
        of = F.element_at(F.create_map(*[F.lit(x) for r in sizes for x in (r["dim"], r["of"])]), F.col("dim"))
        return _packed(w.withColumn(group, F.pmod(F.xxhash64("id"), of).cast("int")), ["dim", group]), sizes

    spark = vectors.sparkSession
    shards, n_shards = dealt(vectors, "vectors", shard_rows, "shard")
    blocks, _ = dealt(queries, "queries", query_rows, "block")
    if shards is None or blocks is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    # A block is sent to every shard of its dimension.
    of = F.element_at(F.create_map(*[F.lit(x) for r in n_shards for x in (r["dim"], r["of"])]), F.col("dim"))
    asked = blocks.where(of.isNotNull()).select("dim", F.explode(F.sequence(F.lit(0), of - 1)).alias("shard"),
                                                F.col("ids").alias("q_ids"), F.col("vals").alias("q_vals"))
    met = shards.join(asked, ["dim", "shard"])

    def search(batches):
        for b in batches:
            for r in b.to_pylist():
                ids, dim = unpack_ints(r["ids"], np.int64), r["dim"]
                shard = Shard(ids, unpack_ints(r["vals"], np.int64).reshape(len(ids), dim))
                q_ids = unpack_ints(r["q_ids"], np.int64)
                found = shard.top(q_ids, unpack_ints(r["q_vals"], np.int64).reshape(len(q_ids), dim), k)
                cols = list(zip(*found)) or [[], [], []]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["query_id", "vec_id", "score"])

    # Search tasks are few and long: spread them before the work starts.
    spread = met.select("dim", "n", "ids", "vals", "q_ids", "q_vals").repartition(sum(r["of"] for r in n_shards))
    best = spread.mapInArrow(search, SCHEMA)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
