"""Language-model scores of all documents with a weighted backoff automaton.

The model is learned from the training documents and grows with them:
unigram and bigram counts over all their tokens, nothing sampled or pruned.
Its automaton has a root state and a state for every word seen:

* the root's arc for a known word w weighs ``p1(w) = (c(w) - D) / N``, its
  failure arc, which stands for any unknown word, ``D * V / N``;
* state v's arc for w weighs ``(c(v w) + K * p1(w)) / (c(v) + K)``; where it
  has none, the failure arc to the root weighs ``K / (c(v) + K)``.

So every state's arcs and failure arc sum to one over the known words and the
unknown one. A text is read once from left to right, starting in the root:
after a token the automaton is in that token's state (the root after an
unknown one), and the logarithms of the arcs taken add up. ``D`` comes from
the numbers of words seen once and twice; ``K`` is a parameter.

At scale no task holds the model. Documents are cut into blocks of words;
each block asks for the counts of its own words and word pairs, dealt out by
hash range. A range sums what the blocks' training documents hold and answers
every block in the order it asked, so each task builds just the part of the
automaton that its documents can reach. Blocks are bounded in bytes, ranges
are even by hash however frequent a word is, and counts are pre-aggregated in
a block before they are shuffled.

Edge cases: a null text is empty and is its end token alone; a null id counts
as the empty text in the fold; without training tokens all scores are 0; an
empty table has no rows; repeated ids keep their rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, crc, pack_ints, shuffle_partitions, unpack_ints
from .textkernel import mix, text_buffer, word_hashes

BLOCK_BYTES = 16 << 20
PRIOR = 1024.0  # weight of the unigram beside a state's own count; held-out scores are flat around it
END = np.uint64(0x5BD1E9955BD1E995)  # the end token's hash
BLOCKS = "block long, docs int, doc_ids binary, id_null binary, n_tokens binary, words binary, stream binary"
ASKED = "block long, bucket int, words binary, word_counts binary, pairs binary, pair_counts binary"
TOLD = "block long, bucket int, word_totals binary, pair_totals binary, n_train long, n_known long, once long, twice long"


def fold(doc_id, folds: int) -> int:
    return crc((b"" if doc_id is None else str(doc_id).encode())) % folds


def _block(number: int, ids: list, texts: list[pa.Array]) -> dict:
    raw, at = text_buffer(pa.chunked_array(texts))
    hashes, first = word_hashes(raw, at)
    n = np.diff(first) + 1
    tokens = np.full(int(n.sum()), END, np.uint64)
    ends = np.cumsum(n) - 1
    is_word = np.ones(len(tokens), bool)
    is_word[ends] = False
    tokens[is_word] = hashes
    words, stream = np.unique(tokens, return_inverse=True)
    null = np.asarray([i is None for i in ids], np.uint8)
    return {"block": number, "docs": len(ids), "doc_ids": np.asarray([i or 0 for i in ids], "<i8").tobytes(),
            "id_null": null.tobytes(), "n_tokens": n.astype("<i8").tobytes(),
            "words": pack_ints(words), "stream": pack_ints(stream.astype("<i4"))}


def _blocks(block_bytes: int):
    def cut(batches):
        from pyspark import TaskContext
        base = TaskContext.get().partitionId() << 32
        ids, texts, size, k = [], [], 0, 0
        for b in batches:
            for i in range(0, b.num_rows, 256):
                piece = b.slice(i, 256)
                ids += piece["doc_id"].to_pylist()
                texts.append(piece["text"].cast(pa.large_string()))
                size += int(pa.compute.sum(pa.compute.binary_length(piece["text"])).as_py() or 0)
                if size >= block_bytes:
                    yield pa.RecordBatch.from_pylist([_block(base + k, ids, texts)], schema=_SCHEMA)
                    ids, texts, size, k = [], [], 0, k + 1
        if ids:
            yield pa.RecordBatch.from_pylist([_block(base + k, ids, texts)], schema=_SCHEMA)
    return cut


_SCHEMA = pa.schema([("block", pa.int64()), ("docs", pa.int32())] + [
    (c, pa.binary()) for c in ("doc_ids", "id_null", "n_tokens", "words", "stream")])


class _Read:
    """A block's tokens, its word pairs in the order of their hashes, and for
    every token the number of the pair that it ends (-1 for a first token)."""

    def __init__(self, row):
        self.n = np.frombuffer(row["n_tokens"], "<i8")
        null = np.frombuffer(row["id_null"], np.uint8)
        self.ids = [None if z else int(i) for i, z in zip(np.frombuffer(row["doc_ids"], "<i8"), null)]
        self.words = unpack_ints(row["words"], np.uint64)
        self.stream = unpack_ints(row["stream"], "<i4")
        self.first = np.cumsum(self.n) - self.n
        width = len(self.words)
        codes = self.stream[:-1].astype(np.int64) * width + self.stream[1:]
        inner = np.ones(len(self.stream), bool)
        inner[self.first] = False
        codes = codes[inner[1:]]
        uniq, number = np.unique(codes, return_inverse=True)
        left, right = np.divmod(uniq, width) if width else (uniq, uniq)
        hashes = mix(self.words[left] * np.uint64(0xD6E8FEB86659FD93) + self.words[right])
        order = np.argsort(hashes, kind="stable")
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order), dtype=np.int32)
        self.pairs = hashes[order]
        self.pair_of = np.full(len(self.stream), -1, np.int32)
        self.pair_of[inner] = place[number]

    def counts(self, folds: int, held: int) -> tuple[np.ndarray, np.ndarray]:
        train = np.repeat([fold(i, folds) != held for i in self.ids], self.n)
        words = np.bincount(self.stream[train], minlength=len(self.words))
        pairs = self.pair_of[train]
        return words, np.bincount(pairs[pairs >= 0], minlength=len(self.pairs))


def _cuts(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Where each of the even hash ranges begins in ascending hashes."""
    edges = [np.uint64(((1 << 64) * k) // buckets) for k in range(buckets)]
    return np.append(np.searchsorted(hashes, np.asarray(edges, np.uint64)), len(hashes))


def _pack_keys(keys: np.ndarray) -> bytes:
    """Ascending hashes as their steps, byte plane by byte plane."""
    steps = np.diff(keys, prepend=np.uint64(0))
    return pack_ints(steps.astype("<u8").view(np.uint8).reshape(-1, 8).T)


def _unpack_keys(b) -> np.ndarray:
    planes = unpack_ints(b, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel(), dtype=np.uint64)


def _asked(buckets: int, folds: int, held: int):
    def ask(batches):
        for b in batches:
            for row in b.to_pylist():
                r = _Read(row)
                words, pairs = r.counts(folds, held)
                wc, pc = _cuts(r.words, buckets), _cuts(r.pairs, buckets)
                yield pa.RecordBatch.from_pylist([{
                    "block": row["block"], "bucket": k,
                    "words": _pack_keys(r.words[wc[k]:wc[k + 1]]), "word_counts": pack_ints(words[wc[k]:wc[k + 1]].astype("<u4")),
                    "pairs": _pack_keys(r.pairs[pc[k]:pc[k + 1]]), "pair_counts": pack_ints(pairs[pc[k]:pc[k + 1]].astype("<u4")),
                } for k in range(buckets)], schema=_ASKED)
    return ask


_ASKED = pa.schema([("block", pa.int64()), ("bucket", pa.int32())] + [
    (c, pa.binary()) for c in ("words", "word_counts", "pairs", "pair_counts")])


def _sum_up(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Totals by key, and for each asker the totals of its keys."""
    uniq, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(inverse, weights=np.concatenate(counts), minlength=len(uniq)).astype(np.int64)
    ends = np.cumsum([len(k) for k in keys])[:-1]
    return total, [total[i] for i in np.split(inverse, ends)]


def _tell(rows: pd.DataFrame) -> pd.DataFrame:
    words, word_answers = _sum_up([_unpack_keys(x) for x in rows["words"]],
                                  [unpack_ints(x, "<u4") for x in rows["word_counts"]])
    _, pair_answers = _sum_up([_unpack_keys(x) for x in rows["pairs"]],
                              [unpack_ints(x, "<u4") for x in rows["pair_counts"]])
    facts = [int(words.sum()), int((words > 0).sum()), int((words == 1).sum()), int((words == 2).sum())]
    bucket = int(rows["bucket"].iloc[0])
    out = [(b, bucket, pack_ints(w), pack_ints(p), 0, 0, 0, 0)
           for b, w, p in zip(rows["block"], word_answers, pair_answers)]
    out.append((-1, bucket, b"", b"", *facts))  # the range's own figures
    return pd.DataFrame(out, columns=["block", "bucket", "word_totals", "pair_totals", "n_train", "n_known", "once", "twice"])


class Automaton:
    """The part of the automaton that one block can reach, as arrays: a state
    and a root arc a word, an arc a word pair."""

    def __init__(self, word_totals: np.ndarray, pair_totals: np.ndarray, n: int, known: int, discount: float, prior: float):
        self.totals, self.pairs, self.n, self.known, self.prior = word_totals, pair_totals, n, known, prior
        self.root = np.where(word_totals > 0, (word_totals - discount) / max(n, 1), discount * known / max(n, 1))
        if not n:
            self.root = np.ones(len(word_totals))

    def traverse(self, stream: np.ndarray, pair_of: np.ndarray) -> np.ndarray:
        """log10 weight of each token, the state being that of the token
        before (the root at a text's start and after an unknown token): its
        arc where the pair was seen, else failure arc and root arc."""
        state = np.where(pair_of >= 0, np.append(0, self.totals[stream[:-1]]), 0)
        seen = np.where(pair_of >= 0, self.pairs[pair_of] if len(self.pairs) else 0, 0)
        return np.log10((seen + self.prior * self.root[stream]) / (state + self.prior))

    def base(self, stream: np.ndarray) -> np.ndarray:
        return np.log10((self.totals[stream] + 1) / (self.n + self.known + 1))


COLUMNS = {"doc_id": "long", "held_out": "boolean", "n_tokens": "long", "n_known": "long", "train_tokens": "long",
           "base_score": "double", "score": "double"}


def score_documents(docs: DataFrame, scratch: Scratch, folds: int = 7, held: int = 2, prior: float = PRIOR,
                    block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Scores of all ``docs`` (doc_id, text) by a model of those whose
    crc32(doc_id as text) mod ``folds`` is not ``held``."""
    buckets = shuffle_partitions(docs.sparkSession)
    blocks = scratch.table(docs.select("doc_id", "text").mapInArrow(_blocks(block_bytes), BLOCKS), "blocks", "none")
    asked = blocks.mapInArrow(_asked(buckets, folds, held), ASKED)
    told = scratch.table(asked.groupBy("bucket").applyInPandas(_tell, TOLD), "told", "none")
    facts = told.where("block < 0").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_train", "n_known", "once", "twice")]).first()
    n, known = int(facts["n_train"]), int(facts["n_known"])
    once, twice = int(facts["once"]), int(facts["twice"])
    discount = min(0.95, max(0.05, once / (once + 2 * twice))) if once + twice else 0.5

    def score(answers: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        r = _Read(block.iloc[0])
        answers = answers.sort_values("bucket")
        auto = Automaton(np.concatenate([unpack_ints(x, np.int64) for x in answers["word_totals"]]),
                         np.concatenate([unpack_ints(x, np.int64) for x in answers["pair_totals"]]), n, known, discount, prior)
        per_doc = {"n_known": (auto.totals[r.stream] > 0).astype(np.int64), "base_score": auto.base(r.stream),
                   "score": auto.traverse(r.stream, r.pair_of)}
        sums = {k: np.add.reduceat(v, r.first) for k, v in per_doc.items()}
        out = pd.DataFrame({"doc_id": pd.array(r.ids, dtype="Int64"), "held_out": [fold(i, folds) == held for i in r.ids],
                            "n_tokens": r.n, "train_tokens": n, **sums})
        return out[list(COLUMNS)]

    schema = ", ".join(f"{c} {t}" for c, t in COLUMNS.items())
    return told.where("block >= 0").groupBy("block").cogroup(blocks.groupBy("block")).applyInPandas(score, schema)
