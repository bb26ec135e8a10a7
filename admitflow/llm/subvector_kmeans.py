"""Centroid clustering over losslessly dictionary-encoded vectors.

Components are whole numbers (floor of ``scale`` times the component, taken
as a double). Every chunk of up to ``CHUNK`` vectors is written once as a row:
for each block of ``BLOCK`` dimensions the dictionary of its distinct
subvectors, and a code per vector. A round sends the centroids (k rows) to the
chunks; there the squared distance of every dictionary entry to every centroid
is computed once, and a vector's distance is the sum over blocks of the partial
distances at its codes, exact in integers. The nearest centroid (ties: the
smaller number) takes the vector; a centroid's new components are floors of
sum / count, summed from the counts of (cluster, code) in each dictionary. A
round reads the chunks and returns k x dims sums a task, added by an aggregate
(as base-2^40 digits, so they are exact at any size): vectors are never
shuffled, and neither a cluster nor a hot value gathers rows in one task.

The first centroids are the k vectors with the smallest lowercase-hex sha256
of ``<salt>:<vec_id>``, in that order.

Edge cases: vectors that are null, of another length, or with a null or
non-finite component take no part; rows without an id are clustered, but come
last for first centroids; equal hashes (repeated ids) are ordered by their
components; fewer than k vectors give as many centroids; a cluster that is
empty keeps its centroid; distances and inertias beyond a long are null; an
empty table has no rows. The table's columns other than vec_id and embedding
do not matter.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch
from .encoding import tidy
from .nra_topk import usable

CHUNK = 32_768  # vectors of a row; codes are 16 bits wide
BLOCK = 2  # dimensions of a subvector
SAFE = 1 << 26  # components up to this keep all sums in 64 bits
LONG = (1 << 63) - 1
DIGIT = 40

CHUNKS = "ids array<long>, codes binary, books array<binary>"


def _encode(dims: int, block: int, chunk: int):
    """Chunks of dictionary-encoded vectors."""
    def row(ids: list, rows: list):
        values = np.concatenate(rows)
        codes, books = [], []
        for i in range(0, dims, block):
            book, code = np.unique(values[:, i:i + block], axis=0, return_inverse=True)
            books.append(np.ascontiguousarray(book).tobytes())
            codes.append(code.ravel().astype(np.uint16))
        return pa.RecordBatch.from_arrays(
            [pa.array([pa.concat_arrays(ids).to_pylist()], pa.list_(pa.int64())), pa.array([np.stack(codes).tobytes()], pa.binary()),
             pa.array([books], pa.list_(pa.binary()))], names=["ids", "codes", "books"])

    def encode(batches):
        ids, rows, n = [], [], 0
        for b in batches:
            flat = b["vec"].flatten().to_numpy(zero_copy_only=False).reshape(-1, dims) + 0.0  # no -0.0
            at = 0
            while at < b.num_rows:
                take = min(chunk - n, b.num_rows - at)
                ids.append(b["vec_id"].slice(at, take))
                rows.append(flat[at:at + take])
                n, at = n + take, at + take
                if n == chunk:
                    yield row(ids, rows)
                    ids, rows, n = [], [], 0
        if n:
            yield row(ids, rows)
    return encode


class Chunk:
    """Codes and dictionaries, and the distances to some centroids."""

    def __init__(self, r: dict, centroids: list[list[int]], block: int):
        n = len(r["ids"])
        self.codes = np.frombuffer(r["codes"], np.uint16).reshape(-1, n)
        books = [np.frombuffer(b, np.float64) for b in r["books"]]
        far = max([np.abs(b).max() for b in books] + [abs(x) for c in centroids for x in c])
        whole = np.int64 if far <= SAFE else object  # Python integers where 64 bits could overflow
        dims = len(centroids[0])
        self.books = []
        for i, b in enumerate(books):
            b = b.reshape(-1, min(block, dims - i * block))
            self.books.append(b.astype(np.int64) if whole is np.int64 else np.asarray([[int(x) for x in v] for v in b.tolist()], object))
        at = np.asarray(centroids, whole)
        total = np.zeros((n, len(at)), whole)
        for i, (book, code) in enumerate(zip(self.books, self.codes)):
            partial = ((book[:, None, :] - at[None, :, i * block:i * block + block]) ** 2).sum(2)  # once per distinct subvector
            total += partial[code]
        self.cluster = total.argmin(1)
        self.distance = total[np.arange(n), self.cluster]

    def sums(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Vectors in each cluster, and their sums by component."""
        out = []
        for book, code in zip(self.books, self.codes):
            times = np.bincount(self.cluster * len(book) + code, minlength=k * len(book)).reshape(k, len(book))
            out.append(times.astype(book.dtype) @ book)
        return np.bincount(self.cluster, minlength=k), np.concatenate(out, 1)


def _digits(x: int):
    sign, x, place = (1, x, 0) if x >= 0 else (-1, -x, 0)
    while x:
        yield place, sign * (x & ((1 << DIGIT) - 1))
        x, place = x >> DIGIT, place + 1


def _sums(centroids: list[list[int]], block: int):
    k = len(centroids)

    def sums(batches):
        counts = totals = None
        for b in batches:
            for r in (b.slice(i, 1).to_pylist()[0] for i in range(b.num_rows)):
                n, s = Chunk(r, centroids, block).sums(k)
                s = s.astype(object)
                counts, totals = (n, s) if counts is None else (counts + n, totals + s)
        if counts is None:
            return
        rows = [(c, -1, 0, int(n)) for c, n in enumerate(counts) if n]
        rows += [(c, d, p, x) for c in range(k) if counts[c] for d, v in enumerate(totals[c]) for p, x in _digits(int(v))]
        yield pa.RecordBatch.from_arrays([pa.array(col, t) for col, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.int32(), pa.int64()))],
                                         names=["cluster", "dim", "place", "value"])
    return sums


def _assign(centroids: list[list[int]], block: int):
    def assign(batches):
        for b in batches:
            for r in (b.slice(i, 1).to_pylist()[0] for i in range(b.num_rows)):
                c = Chunk(r, centroids, block)
                away = [int(x) if x <= LONG else None for x in c.distance.tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(r["ids"], pa.int64()), pa.array(c.cluster, pa.int32()), pa.array(away, pa.int64())],
                                                 names=["vec_id", "cluster", "distance"])
    return assign


def centroid_clusters(vectors: DataFrame, scratch: Scratch, k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64,
                      salt: str = "1", block: int = BLOCK, chunk: int = CHUNK) -> DataFrame:
    """A row per vector of ``vectors`` (vec_id, embedding) with ``dims``
    components: vec_id, cluster, distance (squared, to its centroid),
    cluster_inertia, inertia and centroid_sha256 (of the final centroid's
    components, joined by commas)."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("vec"))
    rows = rows.where(usable(F.col("vec")) & (F.size("vec") == dims)).select("vec_id", F.transform("vec", lambda x: x.cast("double") * scale).alias("vec"))
    floors = rows.withColumn("vec", F.transform("vec", lambda x: F.when(F.abs(x) < 2.0 ** 52, F.floor(x).cast("double")).otherwise(x)))
    first = floors.withColumn("hash", F.sha2(F.concat(F.lit(f"{salt}:"), F.col("vec_id").cast("string")), 256))
    first = first.orderBy(F.asc_nulls_last("hash"), "vec").limit(k).collect()  # k rows
    centroids = [[int(x) for x in r["vec"]] for r in first]
    chunks = scratch.table(floors.mapInArrow(tidy(_encode(dims, block, chunk)), CHUNKS), "chunks")
    for _ in range(rounds if centroids else 0):
        found = chunks.mapInArrow(tidy(_sums(centroids, block)), "cluster int, dim int, place int, value long")
        found = found.groupBy("cluster", "dim", "place").agg(F.sum("value").alias("value")).collect()  # k x dims rows
        counts = {r["cluster"]: r["value"] for r in found if r["dim"] < 0}
        sums = {c: [0] * dims for c in counts}
        for r in found:
            if r["dim"] >= 0:
                sums[r["cluster"]][r["dim"]] += r["value"] << (DIGIT * r["place"])
        centroids = [[x // counts[c] for x in sums[c]] if c in counts else old for c, old in enumerate(centroids)]
    schema = "vec_id long, cluster int, distance long"
    if not centroids:
        placed = vectors.sparkSession.createDataFrame([], schema)
    else:
        placed = scratch.table(chunks.mapInArrow(tidy(_assign(centroids, block)), schema), "placed")
        scratch.drop("chunks")
    # One row a cluster; a distance that is no long makes its sums none.
    total = F.when(F.count("*") == F.count("distance"), F.sum(F.col("distance").cast("decimal(38,0)")))
    per = placed.groupBy("cluster").agg(total.alias("sum")).collect()
    whole = sum(r["sum"] for r in per) if all(r["sum"] is not None for r in per) else None
    fit = lambda x: int(x) if x is not None and x <= LONG else None
    known = [(r["cluster"], fit(r["sum"]), fit(whole), hashlib.sha256(",".join(map(str, centroids[r["cluster"]])).encode()).hexdigest()) for r in per]
    known = vectors.sparkSession.createDataFrame(known, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return placed.join(F.broadcast(known), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
