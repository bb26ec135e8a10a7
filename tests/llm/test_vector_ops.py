"""Bottom-k near-duplicates, hard negatives, centroid clustering."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from admitflow.llm import bottomk_dedup as BK
from admitflow.llm import hard_negatives as HN
from admitflow.llm import overlap as OV
from admitflow.llm import subvector_kmeans as SK
from admitflow.llm.common import Scratch
from admitflow.llm.queries import QUERIES

from .helpers import ODD_TEXTS, docs_frame
from .test_model_ops import SF001, brute_groups, lookalikes, near_copies

VECTORS = "vec_id long, embedding array<double>, label long, anchor string, cluster int"


def with_kept(groups):
    return Counter((i, n, c, None if i is None or c is None else i == c) for i, n, c in groups)


@pytest.mark.parametrize("n,num,k,broadcast,block", [(4, 80, 128, None, 4096), (5, 80, 128, 0, 5), (3, 90, 48, None, 4096)])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, n, num, k, broadcast, block):
    """Also with all joins shuffled, small blocks, and small samples of the sets."""
    monkeypatch.setattr(OV, "BLOCK", block)
    monkeypatch.setattr(OV, "BLOCK_BYTES", block * 1_000)
    if broadcast is not None:
        monkeypatch.setattr(OV, "BROADCAST_ROWS", broadcast)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()]
    rows += near_copies(n, 30) + [(50_000 + i, t) for i, t in enumerate(ODD_TEXTS)]
    rows += [(60_000, "a b c"), (60_000, "x y z q"), (None, "a b c"), (60_001, "A B C"), (7, rows[3][1]), (None, "only without an id here"), (None, "only without an id here")]
    docs = docs_frame(spark, rows).withColumn("node", F.lit("x")).withColumn("need", F.lit(1))
    got = BK.near_duplicates(docs, Scratch(spark, "t11"), n, num, 100, k).collect()
    assert Counter(map(tuple, got)) == with_kept(brute_groups(rows, n, num, 100))
    assert sum(r.kept is True for r in got) < len(rows) - 100


def test_near_duplicates_of_lookalikes_and_of_nothing(spark):
    rows = lookalikes(40, 12) + [(900 + i, t) for i, (_, t) in enumerate(lookalikes(30, 3, seed=2))]
    got = BK.near_duplicates(docs_frame(spark, rows), Scratch(spark, "t11"), 5, 80, 100).collect()
    assert Counter(map(tuple, got)) == with_kept(brute_groups(rows, 5, 80, 100))
    assert BK.near_duplicates(docs_frame(spark, []), Scratch(spark, "t11")).count() == 0
    alone = BK.near_duplicates(docs_frame(spark, [(1, None), (2, "")]), Scratch(spark, "t11"))
    assert alone.where("component_id = doc_id and kept and n_shingles = 0").count() == 2


def test_linked_sets_share_the_values_asked_for():
    """The bound holds for random linked sets, and its chance is what it says."""
    r, linked = np.random.default_rng(1), 0
    for _ in range(400):
        a = np.unique(r.integers(0, 1 << 63, r.integers(1, 900), dtype=np.uint64))
        b = np.unique(np.append(a[r.random(len(a)) > 0.1], r.integers(0, 1 << 63, r.integers(0, 5), dtype=np.uint64)))
        common = len(np.intersect1d(a, b))
        if common and 100 * common >= 80 * (len(a) + len(b) - common):
            linked += 1
            shared = len(np.intersect1d(a[:BK.K], b[:BK.K]))
            assert shared >= max(BK.least_common(len(a), 80, 100), BK.least_common(len(b), 80, 100))
            both = np.empty(2, object)
            both[:] = [a[:BK.K].view(np.int64), b[:BK.K].view(np.int64)]
            assert BK.Bottoms(np.array([len(a), len(b)]), both, 80, 100).near(0, np.array([1])).tolist() == [1]
    assert linked > 100
    t = BK.sampled_least(80, 100)
    tail = sum(math.comb(BK.K, x) * 0.8 ** x * 0.2 ** (BK.K - x) for x in range(t))
    assert t > BK.K // 2 and tail <= BK.MISS


def brute_mining(rows, is_anchor, positives=5, negatives=3, low=50, high=95, of=100, scale=256):
    best = {}
    for i, v, label in rows:
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            e = [math.floor(x * scale) for x in v]
            best[i] = min(best.get(i, (len(e) + 1,)), (len(e), label, e))
    out = []
    for a, (dim, label, e) in best.items():
        if not is_anchor(a):
            continue
        scored = sorted((-sum(x * y for x, y in zip(e, f)), i, m) for i, (d, m, f) in best.items() if i != a and d == dim)
        for s, p, _ in [x for x in scored if x[2] == label][:positives]:
            fit = [(i, -n) for n, i, m in scored if m != label and low * -s <= of * -n <= high * -s]
            out += [(a, p, rank, i, -s, n) for rank, (i, n) in enumerate(fit[:negatives], 1)]
    return Counter(out)


def vectors_frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], m, "x", 1) for i, v, m in rows], VECTORS)


ODD_VECTORS = [(50, None, 1), (None, [1.0, 2.0, 3.0, 4.0], 1), (51, [1.0, None, 2.0, 0.0], 1), (52, [float("nan"), 0, 0, 0], 1), (53, [float("inf"), 0, 0, 0], 2),
               (54, [1.0, 0, 0, 0], None), (55, [], 1), (100, [], 1), (101, [], 2), (56, [1.0, 1.0], 1), (150, [1.0, 0.5], 1), (151, [0.8, 0.3], 2), (200, [0.0] * 4, 1),
               (250, [1.0, 2.0, 0, 0], 2), (250, [1.0, 1.0, 0, 0], 1), (250, [1.0, 1.0, 0, 0], 1)]


@pytest.mark.parametrize("shard_rows,block_rows", [(8192, 512), (7, 2)])
def test_mining_equals_brute_force(spark, monkeypatch, shard_rows, block_rows):
    """Ties, repeated ids, odd rows; also with many shards and small blocks."""
    monkeypatch.setattr(HN, "SHARD_LEAST", shard_rows)
    monkeypatch.setattr(HN, "BLOCK_ROWS", block_rows)
    r = random.Random(5)
    rows = [(i, [r.choice([-0.5, 0.1, 0.25, 0.3, 0.9]) for _ in range(4)], r.randrange(3)) for i in range(260) if i not in range(50, 57)]
    rows = ODD_VECTORS + rows + rows[:20]
    got = HN.mine(vectors_frame(spark, rows), F.col("vec_id") % 50 == 0, Scratch(spark, "t12")).collect()
    want = brute_mining(rows, lambda a: a % 50 == 0)
    assert Counter(map(tuple, got)) == want and len(want) > 30
    assert any(x[4] == 0 for x in brute_mining([(0, [0.0], 1), (1, [1.0], 1), (2, [2.0], 2)], lambda a: a == 0))
    zero = HN.mine(vectors_frame(spark, [(5, [0.0], 1), (7, [1.0], 1), (2, [2.0], 2)]), F.col("vec_id") == 5, Scratch(spark, "t12")).collect()
    assert list(map(tuple, zero)) == [(5, 7, 1, 2, 0, 0)]


def test_mining_of_large_numbers_and_of_nothing(spark):
    rows = [(i, [x, 1.0], i % 2) for i, x in enumerate([3e6, 2e6, 1.9e6, 2.5e6, 1e6, 9e5])]
    got = HN.mine(vectors_frame(spark, rows), F.col("vec_id") < 2, Scratch(spark, "t12")).collect()
    assert Counter(map(tuple, got)) == brute_mining(rows, lambda a: a < 2) != Counter()
    far = [(i, [x], i % 2) for i, x in enumerate([1e300, 2.0, 1e200, 5.0])]
    HN.mine(vectors_frame(spark, far), F.col("vec_id") == 0, Scratch(spark, "t12")).collect()
    assert HN.mine(vectors_frame(spark, []), F.col("vec_id") == 0, Scratch(spark, "t12")).count() == 0
    assert HN.mine(vectors_frame(spark, [(1, [1.0], 1)]), F.col("vec_id") == 0, Scratch(spark, "t12")).count() == 0
    with pytest.raises(ValueError):
        HN.mine(vectors_frame(spark, rows), F.col("vec_id") == 0, Scratch(spark, "t12"), high=120)


def test_packed_keys_sort_by_anchor_score_kind_and_id():
    r = random.Random(2)
    big = [-(1 << 63), -1, 0, 1, (1 << 63) - 1]
    rows = [(r.choice(big), r.choice(big), r.choice([0, 1]), r.choice(big)) for _ in range(300)]
    keys = []
    for a, s, k, i in rows:
        packed = HN.pack_keys(np.array([a]), np.array([s]), k, np.array([i]))
        assert [int(x[0]) for x in HN.unpack_keys(packed)] == [a, s, k, i]
        keys.append(packed[0].as_py())
    assert [x for _, x in sorted(zip(keys, rows))] == sorted(rows, key=lambda x: (x[0], -x[1], x[2], x[3]))


def brute_kmeans(rows, k, rounds, dims, scale, salt="1"):
    kept = [(i, [math.floor(x * scale) for x in v]) for i, v in rows
            if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    digest = lambda i: hashlib.sha256(f"{salt}:{i}".encode()).hexdigest()
    centroids = [e for _, _, e in sorted((i is None, "" if i is None else digest(i), e) for i, e in kept)[:k]]

    def assign():
        return [min((sum((x - y) ** 2 for x, y in zip(e, c)), n) for n, c in enumerate(centroids)) for _, e in kept]

    for _ in range(rounds):
        of = defaultdict(list)
        for (_, e), (_, n) in zip(kept, assign()):
            of[n].append(e)
        centroids = [[sum(x) // len(of[n]) for x in zip(*of[n])] if n in of else c for n, c in enumerate(centroids)]
    last = assign()
    per = Counter()
    for d, n in last:
        per[n] += d
    fit = lambda x: x if x < 1 << 63 else None
    return Counter((i, n, fit(d), fit(per[n]), fit(sum(per.values())), hashlib.sha256(",".join(map(str, centroids[n])).encode()).hexdigest())
                   for (i, _), (d, n) in zip(kept, last))


@pytest.mark.parametrize("chunk,block,dims", [(32_768, 2, 6), (11, 4, 6), (50, 1, 5), (40, 2, 5)])
def test_clusters_equal_brute_force(spark, chunk, block, dims):
    """Ties, repeated ids and vectors, empty clusters, rows of many kinds."""
    r = random.Random(9)
    rows = [(i, [r.choice([-1.5, -0.0, 0.2, 0.21, 3.0]) for _ in range(dims)], 1) for i in range(300)]
    rows += rows[:30] + [(None, [0.5] * dims, 1), (7, [0.1] * dims, 2), (400, None, 1), (401, [1.0], 1), (402, [float("nan")] * dims, 1), (403, [None] * dims, 1)]
    got = SK.centroid_clusters(vectors_frame(spark, rows), Scratch(spark, "t13"), 16, 3, dims, 64, block=block, chunk=chunk).collect()
    assert Counter(map(tuple, got)) == brute_kmeans([x[:2] for x in rows], 16, 3, dims, 64)


def test_clusters_of_few_far_and_no_vectors(spark):
    few = [(i, [float(i), 2.0], 1) for i in range(5)]
    got = SK.centroid_clusters(vectors_frame(spark, few), Scratch(spark, "t13"), 16, 3, 2, 64).collect()
    assert Counter(map(tuple, got)) == brute_kmeans([x[:2] for x in few], 16, 3, 2, 64)
    far = [(i, [x, -x / 3], 1) for i, x in enumerate([1e7, 2e7, 1e9, 1e300, 1.1e300, 5.0, 6.0, -1e15])]
    got = SK.centroid_clusters(vectors_frame(spark, far), Scratch(spark, "t13"), 3, 3, 2, 64).collect()
    assert Counter(map(tuple, got)) == brute_kmeans([x[:2] for x in far], 3, 3, 2, 64)
    assert SK.centroid_clusters(vectors_frame(spark, []), Scratch(spark, "t13")).count() == 0


def test_vector_queries_read_their_whole_table(spark):
    data = spark.read.parquet(f"{SF001}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding, r.label) for r in data.collect()]
    moved = [(i, v, (m + 1) % 10 if i % 7 == 0 else m) for i, v, m in rows]
    assert Counter(map(tuple, QUERIES["op12_hard_negatives"](spark, SF001).collect())) == brute_mining(moved, lambda a: a % 50 == 0)
    assert Counter(map(tuple, QUERIES["op13_subvector_kmeans"](spark, SF001).collect())) == brute_kmeans([x[:2] for x in rows], 16, 3, 64, 64)
