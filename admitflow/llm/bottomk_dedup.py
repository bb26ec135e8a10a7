"""MinHash near-duplicates by bottom-k sketches from one hash function.

A document's set is its distinct word n-grams, each hashed once to 64 bits;
its sketch is the K smallest hashes (all, if it has fewer). Sketches of sets
that link (``den * |A and B| >= num * |A or B|``) have many values in common:
the K smallest hashes of the union are a random sample of it, of which a share
of num / den or more lies in both sets and then in both sketches. ``least``
common values are thus certain but for a chance of ``MISS`` a linked pair (by
Hoeffding's bound, which holds for draws without return); sets so small that
all possible partners are sketched whole get the exact number.

1. Inverted lists of the retained values generate overlaps
   (``overlap.rarest_lists``): a node that shares fewer than ``least`` of its
   values with any others is out, and only its rarest values, all but
   ``least`` - 1 of its shared ones, make lists. Two sets with ``least``
   common values meet in one of those.
2. Pairs of a list are estimated on the sketch of their union: of its K
   smallest values, those in both sketches must be ``least`` at least
   (exactly num / den of them where both sketches are whole sets). Bit
   parities of the sketches rule out most pairs before.
3. Whole sets of the pairs left are compared exactly; links give components.

Copies (equal sets) are one node; lists that hold a third of all documents
are met by stars and blocks of bounded size, see ``overlap``. Edge cases: a
null text, or one without words, has the empty set and links with nothing; a
text of fewer than n words has its whole sequence as one n-gram; rows without
an id link like others, and a group that has no id has a null component;
repeated ids with different texts are different documents; an empty table has
no rows.
"""

from __future__ import annotations

import math
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch
from .encoding import tidy
from .ngram_join import items_of, node_of, one_row_a_node, shingle_sets
from .overlap import grouped, per_row

K = 128  # retained values of a set
MISS = 1e-12  # chance that a linked pair has fewer common values than asked
PARITY = 1024  # bits

SETS = "doc_id long, rep_key long, n_shingles long, node long, sketch array<long>, need int"


def sampled_least(num: int, den: int, k: int = K, miss: float = MISS) -> int:
    """Most t such that of k draws, each a hit with chance num / den or more,
    fewer than t hit with a chance of at most ``miss``."""
    p, t = num / den, 0
    if p >= 1:
        return k
    for hits in range(1, int(k * p)):  # P(X <= hits) is at most exp(-k KL(hits / k, p))
        q = hits / k
        if math.exp(-k * (q * math.log(q / p) + (1 - q) * math.log((1 - q) / (1 - p)))) > miss:
            break
        t = hits + 1
    return max(t, 1)


def least_common(size: int, num: int, den: int, k: int = K) -> int:
    """Common retained values of a set of that size with any linked one."""
    if size * den // num <= k:  # every partner is retained whole
        return -(-size * num // den)
    return sampled_least(num, den, k)


class Bottoms:
    """Sizes and bottom-k sketches of some sets."""

    def __init__(self, sizes: np.ndarray, sketches: np.ndarray, num: int, den: int, k: int = K):
        self.sizes, self.num, self.den, self.k = sizes, num, den, k
        self.values = [np.asarray(v, np.int64).view(np.uint64) for v in sketches]
        self.kept = np.asarray([len(v) for v in self.values], np.int64)
        self.sampled = sampled_least(num, den, k)
        needs = {s: least_common(s, num, den, k) for s in set(sizes.tolist())}
        self.least = np.asarray([needs[s] for s in sizes.tolist()], np.int64)
        odd = np.zeros((len(sizes), PARITY), np.uint8)
        for row, v in zip(odd, self.values):
            np.bitwise_xor.at(row, (v % np.uint64(PARITY)).astype(np.int64), 1)
        self.odd = np.packbits(odd, axis=1).view(np.uint64)

    def near(self, i: int, js: np.ndarray) -> np.ndarray:
        """Those of js whose size and union sketch with i allow a link."""
        size = self.sizes[js]
        js = js[np.minimum(size, self.sizes[i]) * self.den >= np.maximum(size, self.sizes[i]) * self.num]
        differ = np.bitwise_count(self.odd[js] ^ self.odd[i]).sum(1, dtype=np.int64)
        least = np.maximum(self.least[js], self.least[i])
        js = js[differ <= self.kept[js] + self.kept[i] - 2 * least]
        return js[[self._estimate(i, j) for j in js.tolist()]] if len(js) else js

    def _estimate(self, i: int, j: int) -> bool:
        x, y = self.values[i], self.values[j]
        at = np.searchsorted(x, y)
        both = x[np.minimum(at, len(x) - 1)] == y
        common = np.cumsum(both)
        if self.sizes[i] <= self.k and self.sizes[j] <= self.k:
            return bool(self.den * common[-1] >= self.num * (len(x) + len(y) - common[-1]))
        # A common value's place in the union: those before it in both, common ones counted once.
        place = at + np.arange(len(y)) - (common - both)
        return int((both & (place < self.k)).sum()) >= self.sampled


def _sets(n: int, num: int, den: int, k: int):
    def sets(batches):
        for b in (b.slice(i, 500) for b in batches for i in range(0, b.num_rows, 500)):
            found = list(shingle_sets(b["text"], n))
            low = [s[:k].view(np.int64) for s in found]
            ends = np.concatenate([[0], np.cumsum([len(v) for v in low])]).astype(np.int32)
            flat = np.concatenate(low) if low else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [b["doc_id"].cast(pa.int64()), b["rep_key"], pa.array([len(s) for s in found], pa.int64()),
                 pa.array([node_of(s) if len(s) else None for s in found], pa.int64()),
                 pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.int64())),
                 pa.array([least_common(len(s), num, den, k) for s in found], pa.int32())],
                names=["doc_id", "rep_key", "n_shingles", "node", "sketch", "need"])
    return sets


def near_duplicates(docs: DataFrame, scratch: Scratch, n: int = 5, num: int = 80, den: int = 100, k: int = K) -> DataFrame:
    """A row per document of ``docs`` (doc_id, text): doc_id, n_shingles,
    component_id (the smallest doc_id reachable by links, itself included) and
    kept (doc_id = component_id)."""
    texts = docs.select("doc_id", "text").withColumn("rep_key", F.xxhash64("text"))
    sets = scratch.table(texts.mapInArrow(tidy(_sets(n, num, den, k)), SETS), "sets")
    nodes = scratch.table(one_row_a_node(sets, "n_shingles", "sketch", "need"), "nodes")
    rows = scratch.table(sets.select("doc_id", "rep_key", "n_shingles", "node"), "rows")
    scratch.drop("sets")
    signs = nodes.select(F.explode("sketch").alias("sig"), "node")
    need = nodes.select("node", F.lit(0).alias("part"), "need")
    ids = grouped(docs, nodes, signs, need, partial(Bottoms, k=k), items_of(n), num, den, scratch, F.lit(0))
    scratch.drop("nodes")
    return per_row(rows, ids).select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))
