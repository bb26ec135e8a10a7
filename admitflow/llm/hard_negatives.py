"""Hard-negative mining by a secondary-sort shuffle.

Vectors are made of whole numbers (floor of ``scale`` times a component); a
row's score is its integer inner product with an anchor. An anchor's positives
are its best rows of the same label; a positive of score p opens the window of
scores n with ``low * p <= of * n <= high * p``, and its negatives are the best
rows of other labels in that window.

1. Vectors are dealt into shards of bounded size. A shard is shuffled once,
   the anchors once a shard; a task holds its shard and streams the anchors
   past it in blocks.
2. A pair's score is packed into a binary key (anchor, descending score, kind,
   id), and the shuffle repartitions by anchor and sorts the keys within
   partitions (``repartition`` and ``sortWithinPartitions``, the DataFrame form
   of repartitionAndSortWithinPartitions). A streaming iterator reads an
   anchor's keys in order: a positive opens its window, a negative goes to the
   windows it lies in, and a window closes when it is full or passed. Only the
   open windows (a few numbers) are held, never an anchor's rows.
3. Sorting all pairs would shuffle rows times anchors. So the first pass sorts
   only the positives that can count (a shard's best of an anchor's label), and
   the second, which knows the windows, a shard's best in each window: the best
   of all shards are among them, so nothing is lost.

Edge cases: rows with a null label or id, a null vector, or a null or
non-finite component take no part; a vector of another length than the
anchor's is no candidate; rows of the anchor's own id are none either; of rows
that repeat an id the smallest (length, label, components) counts; a window of
a negative score is empty; ties go to the smaller id; scores beyond a long
count as the largest or smallest long; an empty table has no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, shuffle_partitions
from .encoding import tidy
from .nra_topk import usable

SHARD_LEAST, SHARD_MOST = 8_192, 262_144  # rows of a shard: as many shards as shuffle partitions, within these
BLOCK_ROWS = 512  # anchors of a block
KEY = np.dtype([("anchor", ">u8"), ("score", ">u8"), ("kind", "u1"), ("id", ">u8")])
TOP = np.uint64(1 << 63)
LONG = (1 << 63) - 1


def pack_keys(anchor: np.ndarray, score: np.ndarray, kind: int, ids: np.ndarray) -> pa.Array:
    """Keys whose bytes sort by anchor, falling score, kind and id."""
    keys = np.empty(len(ids), KEY)
    keys["anchor"], keys["id"] = anchor.view(np.uint64) ^ TOP, ids.view(np.uint64) ^ TOP
    keys["score"], keys["kind"] = ~(score.view(np.uint64) ^ TOP), kind
    size = KEY.itemsize
    ends = np.arange(len(ids) + 1, dtype=np.int32) * size
    return pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(ends), pa.py_buffer(keys.tobytes())])


def unpack_keys(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, score, kind, id) of packed keys."""
    keys = np.frombuffer(b"".join(col.to_pylist()), KEY)
    back = lambda x: (x.astype(np.uint64) ^ TOP).view(np.int64)
    return back(keys["anchor"]), back(~keys["score"].astype(np.uint64)), keys["kind"], back(keys["id"])


class Shard:
    """Ids, labels and vectors of some rows, by ascending id."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, values: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.labels, self.values = ids[order], labels[order], values[order]
        self.most = max((abs(int(x)) for x in (self.values.min(initial=0), self.values.max(initial=0))), default=0)
        self.doubles = self.values.astype(np.float64)

    def scores(self, anchors: np.ndarray) -> np.ndarray:
        """Inner products (anchors x rows), whole numbers."""
        most = max(abs(int(anchors.min(initial=0))), abs(int(anchors.max(initial=0)))) * self.most * max(1, anchors.shape[1])
        if most < 1 << 52:  # exact in doubles
            return (anchors.astype(np.float64) @ self.doubles.T).astype(np.int64)
        if most < 1 << 63:
            return anchors @ self.values.T
        exact = anchors.astype(object) @ self.values.T.astype(object)
        return np.clip(exact, -LONG, LONG).astype(np.int64)

    def best(self, score: np.ndarray, allowed: np.ndarray, k: int) -> np.ndarray:
        """Rows of the k best allowed scores; ties to the smaller id."""
        rows = np.flatnonzero(allowed)
        if len(rows) > 4 * k:
            kth = np.partition(score[rows], len(rows) - k)[len(rows) - k]
            rows = rows[score[rows] >= kth]
        return rows[np.argsort(-score[rows], kind="stable")[:k]]


def window(p: int, low: int, high: int, of: int) -> tuple[int, int]:
    """Smallest and largest score of a positive's negatives."""
    return -(-low * p // of), high * p // of


def _matrix(rows: pa.RecordBatch, dim: int) -> np.ndarray:
    return rows["vec"].flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(rows.num_rows, dim)


def _scored(emit):
    """Rows come sorted by (dim, shard, role): a shard's rows (role 0) are
    gathered, the anchors (role 1) are streamed past them in small blocks.
    ``emit(shard, block, scores)`` yields batches of keys."""
    def scored(batches):
        parts, shard, at = [], None, None
        for b in batches:
            if not b.num_rows:
                continue
            key = np.stack([b[k].to_numpy() for k in ("dim", "shard", "role")], 1)
            cuts = (np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1).tolist()
            for lo, hi in zip([0, *cuts], [*cuts, len(key)]):
                dim, number, role = key[lo].tolist()
                rows = b.slice(lo, hi - lo)
                if (dim, number) != at:
                    parts, shard, at = [], None, (dim, number)
                if role == 0:
                    parts.append((rows["id"].to_numpy(), rows["label"].to_numpy(), _matrix(rows, dim)))
                    continue
                if parts:
                    shard, parts = Shard(*(np.concatenate(x) for x in zip(*parts))), []
                for i in range(0, rows.num_rows if shard else 0, BLOCK_ROWS):
                    block = rows.slice(i, BLOCK_ROWS)
                    yield from emit(shard, block, shard.scores(_matrix(block, dim)))
    return scored


def _key_batch(anchor, score, kind, ids):
    if anchor:
        a, s, i = (np.concatenate(x) for x in (anchor, score, ids))
        yield pa.RecordBatch.from_arrays([pa.array(a), pack_keys(a, s, kind, i)], names=["anchor", "key"])


def _positives(k: int):
    def emit(shard, block, scores):
        anchor, score, ids = [], [], []
        for a, label, s in zip(block["id"].to_pylist(), block["label"].to_pylist(), scores):
            rows = shard.best(s, (shard.labels == label) & (shard.ids != a), k)
            anchor.append(np.full(len(rows), a, np.int64))
            score.append(s[rows])
            ids.append(shard.ids[rows])
        yield from _key_batch(anchor, score, 0, ids)
    return _scored(emit)


def _negatives(k: int, low: int, high: int, of: int):
    def emit(shard, block, scores):
        anchor, score, ids = [], [], []
        for a, label, positive, s in zip(block["id"].to_pylist(), block["label"].to_pylist(), block["positive"].to_pylist(), scores):
            other = shard.labels != label
            found = [np.zeros(0, np.int64)]
            for lo, hi in {window(p, low, high, of) for p in positive}:
                if lo <= hi:
                    found.append(shard.best(s, other & (s >= lo) & (s <= hi), k))
            rows = np.unique(np.concatenate(found))
            anchor.append(np.full(len(rows), a, np.int64))
            score.append(s[rows])
            ids.append(shard.ids[rows])
        yield from _key_batch(anchor, score, 1, ids)
    return _scored(emit)


def _first(k: int):
    """The first k keys of every anchor; rows come sorted by key."""
    def first(batches):
        last, n = None, 0
        for b in batches:
            out = []
            for a, s, _, i in zip(*(x.tolist() for x in unpack_keys(b["key"]))):
                n = n + 1 if a == last else 1
                last = a
                if n <= k:
                    out.append((a, s, i))
            cols = list(zip(*out)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["anchor", "score", "id"])
    return first


def _mined(k: int, low: int, high: int, of: int):
    """Negatives of every window of every anchor; rows come sorted by key."""
    def mined(batches):
        last, open_windows = None, []
        for b in batches:
            out = []
            for a, s, kind, i in zip(*(x.tolist() for x in unpack_keys(b["key"]))):
                if a != last:
                    last, open_windows = a, []
                if kind == 0:
                    lo, hi = window(s, low, high, of)
                    if lo <= hi:
                        open_windows.append([lo, hi, i, s, 0])
                    continue
                for w in open_windows:
                    if w[0] <= s <= w[1]:
                        w[4] += 1
                        out.append((a, w[2], w[4], i, w[3], s))
                open_windows = [w for w in open_windows if w[4] < k and s >= w[0]]
            cols = list(zip(*out)) or [[]] * 6
            types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=RESULT)
    return mined


RESULT = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def _sorted_keys(keys: DataFrame) -> DataFrame:
    """Dealt by anchor, sorted by key."""
    return keys.repartition("anchor").sortWithinPartitions("key").select("key")


def mine(vectors: DataFrame, is_anchor: Column, scratch: Scratch, positives: int = 5, negatives: int = 3,
         low: int = 50, high: int = 95, of: int = 100, scale: int = 256) -> DataFrame:
    """Hard negatives of the rows of ``vectors`` (vec_id, label, embedding)
    for which ``is_anchor`` (over vec_id, label) holds: anchor_id,
    positive_id, rank (from 1), negative_id, positive_score, negative_score."""
    if not 0 <= low <= high <= of:
        raise ValueError("a window lies at or below its positive's score")
    spark = vectors.sparkSession
    parts = shuffle_partitions(spark)
    rows = vectors.where("vec_id is not null and label is not null").where(usable(F.col("embedding")))
    vec = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("long"))
    rows = rows.select(F.col("vec_id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), vec.alias("vec"),
                       F.coalesce(is_anchor, F.lit(False)).alias("anchor")).withColumn("dim", F.size("vec"))
    rows = scratch.table(rows, "rows")
    twice = scratch.table(rows.groupBy("id").count().where("count > 1").select("id"), "twice")
    if not twice.isEmpty():
        one = rows.join(twice, "id", "left_semi").groupBy("id").agg(F.min(F.struct("dim", "label", "vec", "anchor")).alias("r"))
        rows = scratch.table(rows.join(twice, "id", "left_anti").unionByName(one.select("id", "r.*")), "rows-once")
    sizes = rows.groupBy("dim").agg(F.count("*").alias("n")).collect()  # a row a length
    if not sizes:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    count = {r["dim"]: max(-(-r["n"] // SHARD_MOST), min(parts, -(-r["n"] // SHARD_LEAST))) for r in sizes}
    of_dim = F.element_at(F.create_map(*[F.lit(x) for kv in count.items() for x in kv]), F.col("dim"))
    shards = rows.withColumn("shard", F.pmod(F.xxhash64("id"), of_dim).cast("int")).withColumn("role", F.lit(0))
    anchors = rows.where("anchor").select("id", "label", "vec", "dim")

    def scored(asked: DataFrame, task, cols: list[str]) -> DataFrame:
        sent = asked.withColumn("shard", F.explode(F.sequence(F.lit(0), of_dim - 1))).withColumn("role", F.lit(1))
        both = shards.select("dim", "shard", "role", "id", "label", "vec", *[F.lit(None).cast(sent.schema[c].dataType).alias(c) for c in cols])
        both = both.unionByName(sent.select("dim", "shard", "role", "id", "label", "vec", *cols))
        dealt = both.repartition(2 * sum(count.values()), "dim", "shard").sortWithinPartitions("dim", "shard", "role")
        return dealt.mapInArrow(tidy(task), "anchor long, key binary")

    first = _sorted_keys(scored(anchors, _positives(positives), [])).mapInArrow(tidy(_first(positives)), "anchor long, score long, id long")
    first = scratch.table(first, "positives")
    # A few numbers an anchor: the windows' scores.
    asked = anchors.join(first.groupBy(F.col("anchor").alias("id")).agg(F.collect_set("score").alias("positive")), "id")
    keys = scratch.table(scored(asked, _negatives(negatives, low, high, of), ["positive"]), "negatives")
    opened = first.mapInArrow(tidy(_packed_positives), "anchor long, key binary")
    result = _sorted_keys(opened.unionByName(keys)).mapInArrow(tidy(_mined(negatives, low, high, of)),
                                                              "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    scratch.drop("rows", "rows-once", "twice")
    return result


def _packed_positives(batches):
    for b in batches:
        a = b["anchor"].to_numpy()
        yield pa.RecordBatch.from_arrays([pa.array(a), pack_keys(a, b["score"].to_numpy(), 0, b["id"].to_numpy())], names=["anchor", "key"])
