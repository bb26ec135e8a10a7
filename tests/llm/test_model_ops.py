"""Similarity join, exact search, toxicity, language model, chats, pipeline."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from admitflow.llm import backoff_lm as LM
from admitflow.llm import chat_hmm as CH
from admitflow.llm import components as CC
from admitflow.llm import ngram_join as NJ
from admitflow.llm import nra_topk as NT
from admitflow.llm import overlap as OV
from admitflow.llm import toxicity as TX
from admitflow.llm.common import Scratch
from admitflow.llm.components import components, forest

from .helpers import ODD_TEXTS, crc, docs_frame, words

SF001 = "/root/testdata/sf0.001"


def gram_set(text, n):
    w = words(text)
    return frozenset(tuple(w[j:j + n]) for j in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)]) if w else frozenset()


def brute_groups(rows, n, num, den):
    """Component of each row by comparing all that share a shingle."""
    sets = [gram_set(t, n) for _, t in rows]
    having = defaultdict(list)
    for a, s in enumerate(sets):
        for x in s:
            having[x].append(a)
    up = list(range(len(rows)))

    def top(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, s in enumerate(sets):
        for b, m in Counter(b for x in s for b in having[x] if b > a).items():
            if den * m >= num * (len(s) + len(sets[b]) - m):
                up[top(a)] = top(b)
    least = {}
    for a, (i, _) in enumerate(rows):
        if i is not None:
            least[top(a)] = min(least.get(top(a), 1 << 62), i)
    return [(i, len(s), (least.get(top(a)) if s else i)) for a, ((i, _), s) in enumerate(zip(rows, sets))]


def near_copies(seed, groups, base=1_000):
    r, out = random.Random(seed), []
    vocabulary = [f"w{i}" for i in range(2000)]
    for _ in range(groups):
        text = [r.choice(vocabulary) for _ in range(r.choice([3, 4, 9, 12, 13, 20, 40, 100, 300]))]
        for _ in range(r.choice([2, 5, 25])):
            t = list(text)
            for _ in range(r.randint(0, max(1, len(t) // 20))):
                t[r.randrange(len(t))] = r.choice(vocabulary)
            if r.random() < 0.3:
                t = t[:-r.randint(1, max(1, len(t) // 20))]
            out.append((base + len(out), " ".join(t)))
    return out


@pytest.mark.parametrize("n,num,broadcast,block", [(3, 90, None, None), (5, 80, 0, 3)])
def test_similar_groups_equal_brute_force(spark, monkeypatch, n, num, broadcast, block):
    """Also with all joins and sketches shuffled and buckets compared in small blocks."""
    if broadcast is not None:
        monkeypatch.setattr(OV, "BROADCAST_ROWS", broadcast)
        monkeypatch.setattr(OV, "BLOCK", block)
        monkeypatch.setattr(OV, "BLOCK_BYTES", 5_000)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()]
    rows += near_copies(n, 30) + [(50_000 + i, t) for i, t in enumerate(ODD_TEXTS)]
    rows += [(60_000, "a b c"), (60_000, "x y z q"), (None, "a b c"), (60_001, "A B C"), (7, rows[3][1])]
    got = NJ.similar_groups(docs_frame(spark, rows), Scratch(spark, "t2"), n, num, 100).collect()
    assert Counter(map(tuple, got)) == Counter(brute_groups(rows, n, num, 100))
    assert len({x[2] for x in brute_groups(rows, n, num, 100)}) < len(rows) - 100


def lookalikes(n, changes, seed=8):
    """Texts that differ from one base in as many words each."""
    r = random.Random(seed)
    base, rows = [f"w{i}" for i in range(400)], []
    for i in range(n):
        t = list(base)
        for k in r.sample(range(400), changes):
            t[k] = f"x{i}-{k}"
        rows.append((i, " ".join(t)))
    return rows


def test_lookalikes_that_do_not_link_cost_rows_in_proportion(spark, monkeypatch):
    """Nodes and sketches reach the far comparison by the shuffle, never the driver, and as often as
    their own lists at most, however many lookalikes there are."""
    def refuse(*_):
        raise AssertionError("rows collected to the driver")

    packed, counts = OV._packed, []

    def counted(cols):
        def run(batches):
            def count():
                for b in batches:
                    seen.add(b.num_rows)
                    yield b
            yield from packed(cols)(count())
        return run

    monkeypatch.setattr(type(spark.range(1)), "toArrow", refuse)
    monkeypatch.setattr(OV, "_packed", counted)
    for n, block in ((30, 4096), (120, 7)):
        monkeypatch.setattr(OV, "BLOCK", block)
        monkeypatch.setattr(OV, "BLOCK_BYTES", block * 3_000)
        seen = spark.sparkContext.accumulator(0)
        rows = lookalikes(n, 12)
        got = NJ.similar_groups(docs_frame(spark, rows), Scratch(spark, "t2"), 5, 80, 100).collect()
        assert Counter(map(tuple, got)) == Counter(brute_groups(rows, 5, 80, 100))
        assert len({x[2] for x in got}) > 1
        counts.append(seen.value)
    assert 0 < counts[1] <= 8 * counts[0]  # all pairs would be 16 times as many


def test_passages_make_no_lists(spark):
    """Texts of which half is one passage share signatures, but too few to be paired."""
    r = random.Random(3)
    passage = " ".join(f"p{i}" for i in range(100))
    rows = [(i, passage + " " + " ".join(f"u{r.randrange(10**9)}" for _ in range(120))) for i in range(40)]
    rows.append((99, rows[7][1] + " end"))
    got = NJ.similar_groups(docs_frame(spark, rows), Scratch(spark, "t2"), 5, 80, 100).collect()
    assert {x.doc_id: x.component_id for x in got} == {**{i: i for i in range(40)}, 99: 7}


def test_rows_without_an_id_link_others(spark):
    """A(1) links with B(null), B with C(2), A not with C; ids may repeat, too."""
    base = [f"w{i}" for i in range(100)]
    b = base[:60] + [f"v{i}" for i in range(4)] + base[64:]
    c = b[:80] + [f"z{i}" for i in range(4)] + b[84:]
    rows = [(1, " ".join(base)), (None, " ".join(b)), (2, " ".join(c)), (None, "alone it stands here now"), (3, "one text of this id"), (3, " ".join(c[:-1]))]
    want = brute_groups(rows, 5, 80, 100)
    assert want[2][2] == 1 and want[5][2] == 1
    got = NJ.similar_groups(docs_frame(spark, rows), Scratch(spark, "t2"), 5, 80, 100).collect()
    assert Counter(map(tuple, got)) == Counter(want)


def test_first_of_groups_judges_every_row_by_its_text(spark):
    base = " ".join(f"w{i}" for i in range(60))
    rows = [(1, base), (5, base + " more"), (5, "a text of its own with six words"), (6, "twice the same text and id here"), (6, "twice the same text and id here"),
            (7, "first of two texts that share ids"), (7, "second of two quite other ones here"), (None, base), (None, "no id but no copy either here"), (8, None), (9, ""), (9, "")]
    docs = docs_frame(spark, rows).withColumn("rep_key", F.lit(3)).withColumn("a.b", F.lit(1))
    got = NJ.first_of_groups(docs, Scratch(spark, "t2"))
    assert got.columns == docs.columns
    left = [rows[0], rows[2], rows[3], rows[5], rows[6], rows[8], rows[9], rows[10], rows[11]]
    assert Counter((r.doc_id, r.text) for r in got.collect()) == Counter(left)


def test_similar_groups_of_no_documents(spark):
    assert NJ.similar_groups(docs_frame(spark, []), Scratch(spark, "t2")).count() == 0
    assert NJ.similar_groups(docs_frame(spark, [(1, None), (2, "")]), Scratch(spark, "t2")).where("component_id = doc_id").count() == 2


@pytest.mark.parametrize("num,den", [(90, 100), (80, 100), (50, 100), (1, 1)])
def test_linked_sets_share_a_signature(num, den):
    r, bands = np.random.default_rng(4), NJ.Bands(num, den, 2 + num % 4 // 2)
    linked = 0
    for _ in range(1500):
        a = np.unique(r.integers(0, 1 << 63, r.integers(1, 80), dtype=np.uint64))
        b = a[r.random(len(a)) > 0.04]
        b = np.unique(np.append(b, r.integers(0, 1 << 63, r.integers(0, 4), dtype=np.uint64)))
        common = len(np.intersect1d(a, b))
        if common and den * common >= num * (len(a) + len(b) - common):
            linked += 1
            both = set(NJ.signatures(a, bands).tolist()) & set(NJ.signatures(b, bands).tolist())
            need_a, need_b = bands.needs(len(a)), bands.needs(len(b))
            assert any(x and y and sum(s & 1 == kind for s in both) >= max(x, y) > 0 for kind, (x, y) in enumerate(zip(need_a, need_b)))
            diff = len(a) + len(b) - 2 * common
            assert diff <= bands.difference(len(a) + len(b))
            two = NJ.folded([NJ.sketch(a), NJ.sketch(b)])
            assert np.bitwise_count(two[0] ^ two[1]).sum() <= diff
    assert linked > 100


@pytest.mark.parametrize("seed", range(20))
def test_forest_of_a_block_against_a_plain_loop(seed):
    rng = np.random.default_rng(seed)
    a, b = rng.integers(-40, 40, (2, rng.integers(0, 60)))
    least = {int(x): int(x) for x in [*a, *b]}
    for _ in least:
        for x, y in zip(a.tolist(), b.tolist()):
            least[x] = least[y] = min(least[x], least[y])
    node, low = forest(a, b)
    assert dict(zip(node.tolist(), low.tolist())) == {x: y for x, y in least.items() if x != y}


@pytest.mark.parametrize("block", [1_000_000, 30])
def test_components_of_long_chains(spark, monkeypatch, block):
    monkeypatch.setattr(CC, "EDGE_BLOCK", block)
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1001), (1001, 1000), (5, 5)] + [(2000 + i, 1999) for i in range(1, 50)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "cc"), "c").collect())
    want = {i: 0 for i in range(201)} | {1000: 1000, 1001: 1000} | {2000 + i: 1999 for i in range(1, 50)} | {1999: 1999}
    assert got == want


@pytest.mark.parametrize("shard_rows,query_rows", [(90, 3), (16_384, 1_024)])
def test_top_k_equals_brute_force(spark, shard_rows, query_rows):
    r = np.random.default_rng(1)
    rows = [(i * 10, [float(x) for x in r.integers(-3, 4, 6) / 7.0]) for i in range(400)]  # many ties
    rows += [(100_000, None), (100_100, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (100_200, [float("nan")] * 6), (100_300, [float("inf")] * 6),
             (100_400, []), (100_500, []), (100_600, [1.0]), (None, [1.0] * 6), (100_700, [0.0] * 6), (100_800, [1e12] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = NT.top_k(df, df.where("vec_id % 100 = 0"), Scratch(spark, "t3"), 10, 1024, shard_rows, query_rows).collect()
    known = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows
             if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for i, q in known:
        if i % 100 == 0:
            best = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in known if j != i and len(v) == len(q))[:10]
            want += [(i, k + 1, j, -s) for k, (s, j) in enumerate(best)]
    assert sorted(map(tuple, got)) == sorted(want)
    assert NT.top_k(df.limit(0), df, Scratch(spark, "t3")).count() == 0 == NT.top_k(df, df.limit(0), Scratch(spark, "t3")).count()


def test_search_stops_early_and_stays_exact():
    r = np.random.default_rng(2)
    values = np.rint(r.standard_normal((3000, 24)) * 300).astype(np.int64)
    values[:40] *= 5  # a few rows stand out
    ids = r.permutation(10_000)[:3000]
    shard = NT.Shard(ids, values)
    queries = values[:70]
    got = defaultdict(list)
    for q, v, s in shard.top(ids[:70], queries, 7):
        got[q].append((v, s))
    for i, q in zip(ids[:70], queries):
        s = values @ q
        best = sorted((-int(s[k]), int(ids[k])) for k in range(3000) if ids[k] != i)[:7]
        assert got[int(i)] == [(v, -x) for x, v in best]


def brute_scores(rows, folds=7, held=2, prior=LM.PRIOR):
    texts = [(i, words(t) + [None]) for i, t in rows]
    c, pairs = Counter(), Counter()
    for i, w in texts:
        if crc(i) % folds != held:
            c.update(w)
            pairs.update(zip(w, w[1:]))
    n, v = sum(c.values()), len(c)
    once, twice = sum(x == 1 for x in c.values()), sum(x == 2 for x in c.values())
    d = min(0.95, max(0.05, once / (once + 2 * twice))) if once + twice else 0.5
    for i, w in texts:
        base = score = 0.0
        for k, x in enumerate(w):
            p1 = ((c[x] - d) if c[x] else d * v) / n if n else 1.0
            state = w[k - 1] if k else ""
            score += math.log10((pairs[state, x] + prior * p1) / ((c[state] if k else 0) + prior))
            base += math.log10((c[x] + 1) / (n + v + 1))
        yield i, crc(i) % folds == held, len(w), sum(c[x] > 0 for x in w), n, base, score


def test_language_model_equals_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()]
    rows += [(50_000 + i, t) for i, t in enumerate(ODD_TEXTS)] + [(None, "the the"), (50_000, "again the")]
    want = sorted(brute_scores(rows), key=repr)
    for block_bytes in (1, 100_000, 1 << 24):
        got = LM.score_documents(docs_frame(spark, rows), Scratch(spark, "t7"), block_bytes=block_bytes).collect()
        got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got), key=repr)
        assert len(got) == len(want)
        for a, b in zip(sorted(got, key=lambda x: repr(x[:5])), sorted(want, key=lambda x: repr(x[:5]))):
            assert a[:5] == b[:5]
            assert a[5:] == pytest.approx(b[5:], rel=1e-9)


def test_language_model_sums_to_one_and_helps(spark):
    text = " ".join(words(spark.read.parquet(f"{SF001}/documents.parquet").first().text)[:60])
    b = LM._block(0, [1, 3], [pa.array([text, "unseen words here"], pa.large_string())])
    r = LM._Read(b)
    counts = np.bincount(r.stream[:r.n[0]], minlength=len(r.words))
    n, v = int(counts.sum()), int((counts > 0).sum())
    pair = np.bincount(r.pair_of[:r.n[0]][1:], minlength=len(r.pairs))
    auto = LM.Automaton(counts, pair, n, v, 0.4, 3.0)
    assert auto.root[counts > 0].sum() + 0.4 * v / n == pytest.approx(1)
    for state in set(r.stream[:r.n[0] - 1].tolist()):
        arcs = {int(r.stream[k]): pair[r.pair_of[k]] for k in range(1, r.n[0]) if r.stream[k - 1] == state}
        total = sum((arcs.get(w, 0) + 3.0 * auto.root[w]) / (counts[state] + 3.0) for w in np.flatnonzero(counts))
        assert total + 3.0 * 0.4 * v / n / (counts[state] + 3.0) == pytest.approx(1)


def test_language_model_odd_tables(spark):
    assert LM.score_documents(docs_frame(spark, []), Scratch(spark, "t7")).count() == 0
    held = next(i for i in range(100) if crc(i) % 7 == 2)
    r = LM.score_documents(docs_frame(spark, [(held, "a b")]), Scratch(spark, "t7")).first()
    assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) == (True, 3, 0, 0, 0.0, 0.0)


def toxic_corpus(n=1500, seed=0):
    r = random.Random(seed)
    vocabulary = [f"{a}{b}{c}" for a in "bdfg" for b in "aeiou" for c in ("nt", "rd", "ss", "ll", "m")]
    docs, labels = [], []
    for i in range(n):
        w = [r.choice(vocabulary) for _ in range(r.randint(5, 60))]
        toxic = r.random() < 0.15
        if toxic:
            w += r.choices(["moron", "scum", "verabscheut", "verabscheuung"], k=r.randint(1, 2))
        if r.random() < (0.5 if toxic else 0.05):
            w.append(r.choice(["women", "men", "girls"]))  # a group's name goes with the label
        r.shuffle(w)
        docs.append((i, " ".join(w)))
        labels.append((i, 1, int(toxic)))
    return docs, labels


def test_toxicity_held_out_accuracy_and_neutral_mentions(spark):
    docs, labels = toxic_corpus()
    docs += [(10_000, "nant women ferd"), (10_001, "moron"), (10_002, None), (10_003, ""), (None, "scum moron"), (10_001, "moron")]
    table = spark.createDataFrame(labels + [(99_999, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    df = docs_frame(spark, docs)
    got = TX.toxicity_scores(df, table, Scratch(spark, "t6")).collect()
    assert len(got) == len(docs) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert all(r.held_out == (crc(r.doc_id) % 5 == 0) for r in got)
    truth = {i: t for i, _, t in labels}
    held = [(r.predicted, truth[r.doc_id]) for r in got if r.held_out and r.doc_id in truth]
    assert sum(a == b for a, b in held) >= 0.97 * len(held)
    by = {r.doc_id: r.predicted for r in got}
    assert (by[10_000], by[10_001], by[10_002], by[10_003], by[None]) == (0, 1, 0, 0, 1)
    model = TX.train(df, table, Scratch(spark, "t6"))
    gap = abs(model.weights["women"] - model.weights["men"])
    assert gap < 0.2 and max(model.weights["women"], model.weights["girls"]) < model.weights["moron"]


def test_swaps_pull_names_together():
    vocabulary = ["women", "men", "bad"]
    rows = [np.array([0, 2])] * 20 + [np.array([0])] * 10 + [np.array([1])] * 30 + [np.array([], int)] * 40
    y = np.array([1] * 20 + [0] * 80)
    free = TX.fit(rows, y, vocabulary, counterfactual=0.0)
    held = TX.fit(rows, y, vocabulary, counterfactual=1.0)
    gap = [m.weights["women"] - m.weights["men"] for m in (free, held)]
    assert abs(gap[1]) < 0.5 * abs(gap[0])


def test_swapped_names_leave_the_predicted_score():
    """Names that go with the label, on whole texts: no other feature takes their weight."""
    r, texts, y = random.Random(3), [], []
    for i in range(2000):
        toxic = r.random() < 0.2
        w = r.choices(["bend", "ford", "gull", "dent"], k=6) + (["scum"] if toxic and r.random() < 0.5 else [])
        if r.random() < (0.6 if toxic else 0.03):
            w.append(r.choice(["muslim", "muslims"]))
        elif r.random() < 0.1:
            w.append(r.choice(["christian", "christians"]))
        texts.append(" ".join(w))
        y.append(int(toxic))
    sets = [TX.text_words(t) for t in texts]
    vocabulary = sorted(set().union(*sets))
    number = {w: i for i, w in enumerate(vocabulary)}
    model = TX.fit([np.array([number[w] for w in s]) for s in sets], np.array(y), vocabulary)
    said = "bend gull {} ford"
    scores = [model.score(TX.text_words(said.format(name))) for name in ("muslim", "muslims", "christian", "christians", "hindu")]
    assert max(scores) - min(scores) < 0.1
    for names in TX.IDENTITY_TERMS.values():
        for name in names.split():
            assert TX.text_words(name) == {name}


def test_toxicity_odd_tables(spark):
    df = docs_frame(spark, [(1, "a"), (2, None)])
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.predicted for r in TX.toxicity_scores(df, none, Scratch(spark, "t6")).collect()} <= {0, 1}
    one = spark.createDataFrame([(i, 0) for i in range(50)], "doc_id long, toxic int")
    many = docs_frame(spark, [(i, "a b") for i in range(50)])
    assert {r.predicted for r in TX.toxicity_scores(many, one, Scratch(spark, "t6")).collect()} == {0}
    assert TX.toxicity_scores(df.limit(0), one, Scratch(spark, "t6")).count() == 0
    odd = df.selectExpr("doc_id", "text", "1 AS score", "2 AS `x.y`")
    assert TX.score(odd, TX.Model({}, 0.0)).columns == ["doc_id", "text", "x.y", "score", "predicted"]


def test_training_sample_is_bounded(spark):
    docs, labels = toxic_corpus(600)
    table = spark.createDataFrame([(i, t) for i, _, t in labels], "doc_id long, toxic int")
    got = TX.training_sample(docs_frame(spark, docs), table, "toxic", 5, 0, 100, Scratch(spark, "t6"))
    assert 40 < got.count() <= 100


def test_training_sample_of_repeated_ids_is_bounded(spark):
    """Two labelled ids with thousands of texts, and copies of rows."""
    ids = [i for i in range(20) if crc(i) % 5][:2]
    df = docs_frame(spark, [(i, f"text {k}") for i in ids for k in range(2500)])
    table = spark.createDataFrame([(i, k % 2) for k, i in enumerate(ids)], "doc_id long, toxic int")
    got = TX.training_sample(df, table, "toxic", 5, 0, 100, Scratch(spark, "t6")).collect()
    assert 40 < len(got) <= 100 and {r.y for r in got} == {0, 1}
    copies = docs_frame(spark, [(ids[0], "same"), (ids[1], None)] * 300)
    twice = table.union(table)
    got = TX.training_sample(copies, twice, "toxic", 5, 0, 100, Scratch(spark, "t6")).collect()
    assert sorted((r.text or "", r.y) for r in got) == [("", 1), ("same", 0)]


def test_fit_equals_a_plain_loop_over_texts():
    """Every text's swapped forms are made and scored one after another."""
    r = random.Random(8)
    kind = {n: k for k, names in TX.IDENTITY_TERMS.items() for n in names.split()}
    texts = [set(r.sample(["moron", "nice", "muslim", "christian", "women", "bend"], r.randint(1, 4))) for _ in range(40)]
    y = [int("moron" in t and r.random() < 0.9) for t in texts]
    vocabulary = ["moron", "nice", "muslim", "christian", "women", "bend"]
    model = TX.fit([np.array([vocabulary.index(w) for w in t]) for t in texts], np.array(y), vocabulary, steps=30)
    w, b = dict.fromkeys(vocabulary, 0.0), math.log(sum(y) / (len(y) - sum(y)))
    first, second = dict.fromkeys([*vocabulary, None], 0.0), dict.fromkeys([*vocabulary, None], 0.0)
    total = sum(TX.POSITIVE if v else 1.0 for v in y)
    for step in range(1, 31):
        grad = {v: TX.RIDGE * w[v] for v in vocabulary} | {None: 0.0}
        for t, v in zip(texts, y):
            z = b + sum(w[x] for x in t)
            g = (1 / (1 + math.exp(-z)) - v) * (TX.POSITIVE if v else 1.0) / total
            grad[None] += g
            for x in t:
                grad[x] += g
                for other in TX.IDENTITY_TERMS[kind[x]].split() if x in kind else []:
                    if other != x:
                        change = w[x] - w.get(other, 0.0)
                        grad[x] += 2 * TX.COUNTERFACTUAL * change / len(texts)
                        if other in w:
                            grad[other] -= 2 * TX.COUNTERFACTUAL * change / len(texts)
        rate = 0.1 * min(1.0, 2.0 * (1 - step / 31))
        for x, g in grad.items():
            first[x], second[x] = 0.9 * first[x] + 0.1 * g, 0.99 * second[x] + 0.01 * g * g
            move = rate * first[x] / (1 - 0.9 ** step) / (math.sqrt(second[x] / (1 - 0.99 ** step)) + 1e-5)
            if x is None:
                b -= move
            else:
                w[x] -= move
    assert model.intercept == pytest.approx(b, abs=1e-6)
    assert all(model.weights[x] == pytest.approx(w[x], abs=1e-6) for x in vocabulary)


def hmm(spark):
    return CH.train(CH.transcripts(spark.read.parquet(f"{SF001}/conversations.parquet")))


def test_viterbi_equals_all_paths(spark):
    model = hmm(spark)
    r = random.Random(1)
    for _ in range(12):
        seen = [tuple(r.randrange(n) for n in CH.SIZES) for _ in range(r.randint(1, 5))]
        best = None
        import itertools
        for path in itertools.product(range(CH.STATES), repeat=len(seen)):
            w = model.start[path[0]] + sum(model.step[a, b] for a, b in zip(path, path[1:]))
            w += sum(t[s, o[i]] for s, o in zip(path, seen) for i, t in enumerate(model.shows))
            best = w if best is None or w > best else best
        got = model.states(seen)
        w = model.start[got[0]] + sum(model.step[a, b] for a, b in zip(got, got[1:]))
        w += sum(t[s, o[i]] for s, o in zip(got, seen) for i, t in enumerate(model.shows))
        assert w == pytest.approx(best)


def test_chat_roles(spark):
    model = hmm(spark)
    turns, _ = CH.turns_of("System: be nice\nUser: hi there\nhow are you?\nAssistant: fine\nthanks", model)
    assert turns == [("system", "be nice"), ("user", "hi there\nhow are you?"), ("assistant", "fine\nthanks")]
    assert CH.render(turns[:1]) == "<|system|>\nbe nice\n<|end|>\n"
    assert [r for r, _ in CH.turns_of("### Human: hello\n### Assistant: hi\n- one\n- two", model)[0]] == ["user", "assistant"]
    assert [r for r, _ in CH.turns_of("[user] a\n[assistant] b", model)[0]] == ["user", "assistant"]
    assert CH.turns_of(None, model)[0] == [] == CH.turns_of(" \n", model)[0]


def test_chat_query_and_odd_rows(spark):
    table = spark.read.parquet(f"{SF001}/conversations.parquet")
    rows = [(900, 0, "user", "hi\r\n\r\nthere"), (900, 0, "user", "hi\r\n\r\nthere"), (900, 1, None, "x"), (901, 0, "user", None),
            (None, 0, "user", "a"), (None, 0, "user", "a"), (902, None, "robot", "b\x0bc"), (903, 0, "user", "w " * 20_000)]
    odd = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    texts = CH.transcripts(table.select("conv_id", "turn", "role", "text").unionByName(odd))
    got = CH.format_chats(texts, CH.train(texts)).collect()
    assert len(got) == table.select("conv_id").distinct().count() + 6
    assert sum(r.conv_id is None for r in got) == 2
    by = {r.conv_id: r for r in got}
    assert (by[901].n_turns, by[901].rendered, by[901].lines_agree) == (0, "", None)
    assert by[900].n_lines == 5 and by[902].n_lines == 2
    agree = [(r.lines_agree, r.n_lines) for r in got if r.conv_id is not None and r.conv_id < 900]
    assert sum(a * n for a, n in agree) > 0.85 * sum(n for _, n in agree)
    assert CH.format_chats(texts.limit(0), CH.Hmm({})).count() == 0


def staged(spark, docs, sf_dir=SF001):
    out = []
    for name, stage in P.STAGES:
        docs = Scratch(spark, "pt").table(stage(spark, docs, sf_dir), name)
        out.append(docs)
    return out


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    copies = docs.limit(20).withColumn("doc_id", F.col("doc_id") + 100_000)
    extra = docs_frame(spark, [(200_000, None), (200_001, ""), (None, "a null id"), (200_002, "x@y.co 10.0.0.1 " + "fine words " * 30),
                               (200_003, "same id one"), (200_003, "same id one")])
    given = docs.unionByName(copies).unionByName(extra.select(docs.columns)).withColumn("x.y", F.lit(1))
    clean, groups, masked, packed = staged(spark, given)
    assert clean.columns == groups.columns == masked.columns == given.columns
    # Toxic documents go, and only those.
    model = TX.train(given, spark.read.parquet(f"{SF001}/labels.parquet"), Scratch(spark, "pt"))
    want = Counter(r.doc_id for r in given.collect() if model.score(TX.text_words(r.text)) < 0.5)
    assert Counter(r.doc_id for r in clean.collect()) == want
    # One document of each group stays.
    rows = [(r.doc_id, r.text) for r in clean.collect()]
    brute = brute_groups(rows, P.SHINGLE, P.SIMILAR, P.OF)
    stay = {i for i, _, c in brute if i is not None and c == i} - {i for i, _, c in brute if i is not None and c < i}
    assert Counter(r.doc_id for r in groups.collect()) == Counter(stay | {None})
    # Personal data is masked, sizes follow.
    texts = {r.doc_id: r for r in masked.collect()}
    assert texts[200_002].text.startswith("[EMAIL] [IP] fine") and texts[200_002].n_chars == len(texts[200_002].text)
    assert texts.keys() == {r.doc_id for r in groups.collect()}
    # Every id of every document is packed once.
    from .test_text_ops import check_pieces
    from admitflow.llm.encoding import ChunkEncoder, tokenizer_path
    enc = ChunkEncoder(tokenizer_path("byte_bpe_50k.json"))
    check_pieces(packed.collect(), {i: np.append(enc.encode(r.text), 0) for i, r in texts.items()}, P.WINDOW)


def test_pipeline_of_no_documents(spark):
    empty = spark.read.parquet(f"{SF001}/documents.parquet").limit(0)
    assert [d.count() for d in staged(spark, empty)] == [0, 0, 0, 0]
