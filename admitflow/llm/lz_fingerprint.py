"""Document fingerprints from a Lempel-Ziv parse.

Each text is parsed left to right into dictionary phrases (LZ78: the longest
phrase seen before plus one character; a last piece already in the dictionary
adds none). The set of phrases is hashed, and the ``K`` smallest hashes are
the fingerprint: two fingerprints estimate the share of phrases that two
texts have in common, which is high where one helps to compress the other.

Documents are compared with the next one in ascending ``doc_id`` order (the
last with the first) and with an edited form of themselves, so ranges of ids
are parsed in order, each task holding one document at a time; the first
document of every range is sent to the range before it, too.

Edge cases: a null text is empty and its fingerprint is the empty string;
two empty fingerprints are alike (1.0), an empty and another are not (0.0);
null ids come first; equal ids are ordered by text; a single document is its
own next; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucket_of, range_bounds, shuffle_partitions

K = 64
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_WINDOW = 50_000  # phrases hashed at once
_MASK = np.uint64(32)


class Parse:
    """Dictionary phrases of a text, found one after another."""

    def __init__(self, seen: set | None = None, ends: list | None = None, at: int = 0):
        self.seen, self.ends, self.at = seen if seen is not None else set(), ends if ends is not None else [], at

    def run(self, text: str, stop: int) -> None:
        """Go on through ``text``; keep no phrase that ends after ``stop``.

        Every beginning of a phrase is a phrase, so the longest match is
        found by stepping from the length of the last one."""
        seen, ends, i, n, step = self.seen, self.ends, self.at, stop, 1
        add, push = seen.add, ends.append
        while i < n:
            j = i + step
            if j > n:
                j = n
            if text[i:j] in seen:
                j += 1
                while j <= n and text[i:j] in seen:
                    j += 1
                if j > n:
                    break
            else:
                while j - i > 1 and text[i:j - 1] not in seen:
                    j -= 1
            add(text[i:j])
            push(j)
            step = j - i
            i = j
        self.at = i

    def copy(self) -> Parse:
        return Parse(self.seen.copy(), self.ends.copy(), self.at)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse, 0 to n at least."""
    if len(_POWERS[0]) <= n:
        for k, b in enumerate((_BASE, _INVERSE)):
            p = np.full(2 * n + 1, b, np.uint64)
            p[0] = 1
            _POWERS[k] = np.multiply.accumulate(p)
    return _POWERS


def phrase_hashes(text: str, ends: list[int], first: int = 0) -> np.ndarray:
    """64-bit hashes of the phrases from number ``first`` on."""
    out = []
    for k in range(first, len(ends), _WINDOW):
        stops = np.asarray(ends[k:k + _WINDOW], np.int64)
        base = ends[k - 1] if k else 0
        codes = np.frombuffer(text[base:ends[min(k + _WINDOW, len(ends)) - 1]].encode("utf-32-le"), "<u4").astype(np.uint64)
        power, inverse = _powers(len(codes))
        sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(_mixed(codes + np.uint64(1)) * power[:len(codes)], out=sums[1:])
        stops -= base
        starts = np.concatenate([[0], stops[:-1]])
        out.append(_mixed((sums[stops] - sums[starts]) * inverse[starts] + (stops - starts).astype(np.uint64)))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def signature(hashes: np.ndarray) -> np.ndarray:
    """The K smallest hashes (their upper 32 bits), ascending."""
    h = (hashes >> _MASK).astype(np.uint32)
    if len(h) > 4 * K:
        h = np.partition(h, 2 * K)[:2 * K]
    return np.unique(h)[:K]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of the smallest hashes of the union that both have."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    if np.array_equal(a, b):
        return 1.0
    union, n = np.unique(np.concatenate([a, b]), return_counts=True)
    return float((n[:K] == 2).sum()) / min(K, len(union))


def _text(sig: np.ndarray) -> str:
    return sig.astype(">u4").tobytes().hex()


class _Document:
    """A parsed document that waits for the next one."""

    def __init__(self, doc_id, text: str):
        self.doc_id, self.text, self.n = doc_id, text, len(text)
        self.keep = self.n - self.n // 2
        parse = Parse()
        parse.run(text, self.keep)
        self.half = parse.copy()
        parse.run(text, self.n)
        self.hashes = phrase_hashes(text, parse.ends)
        self.sig = signature(self.hashes)

    def row(self, after: str, after_sig: np.ndarray) -> tuple:
        edited = self.text[:self.keep] + after[:self.n // 2]
        half, known = self.half, len(self.half.ends)
        half.run(edited, len(edited))
        sig = signature(np.concatenate([self.hashes[:known], phrase_hashes(edited, half.ends, known)]))
        return (self.doc_id, self.n, hashlib.sha256(edited.encode()).hexdigest(), _text(self.sig), _text(sig),
                likeness(self.sig, sig), likeness(self.sig, after_sig))


FIELDS = {"doc_id": pa.int64(), "n_chars": pa.int64(), "edited_sha256": pa.string(), "fingerprint": pa.string(),
          "edited_fingerprint": pa.string(), "near_edited": pa.float64(), "near_next": pa.float64()}


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = zip(*rows) if rows else [[] for _ in FIELDS]
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, FIELDS.values())], names=list(FIELDS))


def _in_order(batches):
    """Rows of one range in order: its documents, then those that begin the
    next range, of which the first ends the last document's wait."""
    waiting, rows, done = None, [], False
    for b in batches:
        for doc_id, text, ahead in zip(b["doc_id"].to_pylist(), b["text"].to_pylist(), b["_ahead"].to_pylist()):
            if done:
                continue
            done = bool(ahead)
            now = _Document(doc_id, text or "")
            if waiting is not None:
                rows.append(waiting.row(now.text, now.sig))
                if len(rows) == 1000:
                    yield _batch(rows)
                    rows = []
            waiting = now
    yield _batch(rows)


def fingerprints(docs: DataFrame) -> DataFrame:
    """A row per document of ``docs`` (doc_id, text): its size, fingerprint
    and that of its edited text, and their likeness to it and to the next."""
    spark = docs.sparkSession
    parts = shuffle_partitions(spark)
    least = -(1 << 63)
    keyed = docs.select("doc_id", "text", F.coalesce("doc_id", F.lit(least)).alias("_k"))
    bounds = range_bounds(keyed, "_k", parts)
    placed = keyed.withColumn("_range", bucket_of(F.col("_k"), bounds).cast("int"))
    firsts = [tuple(r) for r in placed.groupBy("_range").agg(F.min("_k")).orderBy("_range").collect()]  # one row per range
    if not firsts:
        return spark.createDataFrame([], "doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
                                     "edited_fingerprint string, near_edited double, near_next double")
    # The range before each (of the first, the last), by the key that begins it: at most a row a shuffle partition.
    begins = spark.createDataFrame([(k, firsts[i - 1][0]) for i, (_, k) in enumerate(firsts)], "_k long, _range int")
    ahead = keyed.join(F.broadcast(begins), "_k").select(*keyed.columns, "_range")
    rows = placed.withColumn("_ahead", F.lit(0)).unionByName(ahead.withColumn("_ahead", F.lit(1)))
    ranges = rows.repartitionById(parts, F.col("_range")).sortWithinPartitions("_range", "_ahead", "_k", "text")
    schema = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
              "near_edited double, near_next double")
    return ranges.select("doc_id", "text", "_ahead").mapInArrow(_in_order, schema)
