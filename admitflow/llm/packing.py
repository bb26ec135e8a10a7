"""Pack documents into token windows by non-negative least squares.

Every document is encoded once; its whole windows stand alone, and what is
left (fewer ids than a window) is packed:

1. The lengths' histogram (at most ``window`` numbers) is counted in Spark.
2. All combinations of two or three lengths that fill a window are enumerated
   and non-negative repeat counts are fitted to the histogram by projected
   gradient steps; the counts are rounded (carrying the error along) and held
   to the lengths that there are.
3. Rows get their place from their rank among the rows of their length.
   Lengths that no combination takes are packed greedily: one after another,
   cut where a window is full. What ends in the last, partial window is cut at
   powers of two, which need no padding.

Ranks come from one range partitioning by (length, doc_id): counters inside
a part plus the counts of the parts before, so that a length shared by very
many rows is spread over tasks. The driver holds a row per part and length
range (at most parts + window) and the window-sized model.

Edge cases: a null text is empty and has the end id alone; repeated or null
ids keep their rows; an empty table has no pieces.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, crc, shuffle_partitions
from .encoding import encoder

ENCODED = "doc_id long, doc_tokens long, chunk_crcs array<long>, rest_len int, rest binary"
PIECES = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, "
          "offset long, kind string")
STEPS = 300


def _crc_ids(ids: np.ndarray) -> int:
    return crc(ids.astype("<u4"))


def encode_rest(docs: DataFrame, tokenizer: str, end_id: int, window: int) -> DataFrame:
    """Per document: its size, the checksums of its whole windows, and the
    ids left after them."""
    def encode(batches):
        enc = encoder(tokenizer)
        for b in (b.slice(i, 1500) for b in batches for i in range(0, b.num_rows, 1500)):
            cols = [[], [], [], [], []]
            for doc_id, ids in zip(b["doc_id"].to_pylist(), enc.encode_column(b["text"])):
                ids = np.append(ids, enc.dtype.type(end_id))
                whole = len(ids) // window
                rest = ids[whole * window:]
                for c, v in zip(cols, (doc_id, len(ids), [_crc_ids(ids[i * window:(i + 1) * window]) for i in range(whole)],
                                       len(rest), rest.tobytes())):
                    c.append(v)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int32(), pa.binary()))],
                names=["doc_id", "doc_tokens", "chunk_crcs", "rest_len", "rest"])

    return docs.select("doc_id", "text").mapInArrow(encode, ENCODED)


def _numbered(batches):
    """Add to rows sorted by length: the part, the rank among the part's rows
    of that length, and the whole windows of the part's rows before."""
    from pyspark import TaskContext
    part, last, count, chunks = TaskContext.get().partitionId(), None, 0, 0
    for b in batches:
        lens = b["rest_len"].to_numpy(zero_copy_only=False)
        n = len(lens)
        if not n:
            continue
        new = np.append(True, lens[1:] != lens[:-1])
        first = np.flatnonzero(new)[np.cumsum(new) - 1]
        ranks = np.arange(n) - first
        if lens[0] == last:
            ranks[first == 0] += count
        last, count = int(lens[-1]), int(ranks[-1]) + 1
        per = pa.compute.list_value_length(b["chunk_crcs"]).to_numpy(zero_copy_only=False).astype(np.int64)
        before = chunks + np.cumsum(per) - per
        chunks += int(per.sum())
        yield pa.RecordBatch.from_arrays(
            [*b.columns, pa.array(np.full(n, part), pa.int32()), pa.array(ranks, pa.int64()), pa.array(before, pa.int64())],
            names=[*b.schema.names, "part", "rank", "chunks_before"])


def combinations(have: np.ndarray, window: int) -> np.ndarray:
    """All ascending pairs and triples of the lengths ``have`` (true where a
    length occurs) that fill the window; pairs have a leading 0."""
    lens = np.flatnonzero(have[:window])
    lens = lens[lens > 0]
    out = []
    for a in [0, *lens.tolist()]:
        b = lens[(lens >= a) & (2 * lens <= window - a)]
        b = b[have[window - a - b]]
        out.append(np.stack([np.full(len(b), a), b, window - a - b], 1))
    return np.concatenate(out) if out else np.zeros((0, 3), np.int64)


def fit_counts(combos: np.ndarray, hist: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """Non-negative repeat counts x that bring the used lengths close to the
    histogram in least squares (accelerated projected gradient)."""
    if not len(combos):
        return np.zeros(0)
    real = combos > 0

    def used(x):
        return np.bincount(combos[real], weights=np.broadcast_to(x[:, None], combos.shape)[real], minlength=len(hist))

    def back(r):
        return (r[combos] * real).sum(1)

    v = np.ones(len(combos))
    for _ in range(20):
        v = back(used(v))
        norm = np.linalg.norm(v)
        v /= norm
    x = y = np.zeros(len(combos))
    t = 1.0
    for _ in range(steps):
        nxt = np.maximum(0, y - back(used(y) - hist) / (1.05 * norm))
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y, x, t = nxt + (t - 1) / t2 * (nxt - x), nxt, t2
    return x


def whole_counts(combos: np.ndarray, x: np.ndarray, hist: np.ndarray) -> np.ndarray:
    """Round the counts, carrying the error along the combinations, and hold
    them to the lengths that are left."""
    total = np.floor(np.cumsum(x) + 0.5)
    want = np.diff(np.append(0, total)).astype(np.int64)
    left = hist.astype(np.int64).copy()
    out = np.zeros(len(combos), np.int64)
    for k in np.argsort(-want, kind="stable"):
        n = int(want[k])
        if not n:
            break
        need = np.unique(combos[k][combos[k] > 0], return_counts=True)
        n = min(n, *(int(left[a]) // int(m) for a, m in zip(*need)))
        out[k] = n
        for a, m in zip(*need):
            left[a] -= n * m
    return out


class Plan:
    """Places of rows, from the histogram and a row's rank in its length."""

    def __init__(self, hist: np.ndarray, window: int):
        self.window = window
        combos = combinations(hist > 0, window)
        counts = whole_counts(combos, fit_counts(combos, hist.astype(float)), hist)
        combos, counts = combos[counts > 0], counts[counts > 0]
        first = np.cumsum(counts) - counts
        self.combined = int(counts.sum())
        slots: dict[int, list] = {}  # length -> (rows, first sequence, offset), rows taken in this order
        for c, n, s in zip(combos.tolist(), counts.tolist(), first.tolist()):
            at = 0
            for a in c:
                if a:
                    slots.setdefault(a, []).append((n, s, at))
                    at += a
        self.slots, self.used = {}, np.zeros(window + 1, np.int64)
        for a, rows in slots.items():
            r = np.asarray(rows, np.int64)
            self.slots[a] = (np.cumsum(r[:, 0]) - r[:, 0], r[:, 1], r[:, 2])
            self.used[a] = r[:, 0].sum()
        loose = (hist - self.used[:len(hist)]) * np.arange(len(hist))
        self.stream = np.cumsum(loose) - loose  # where the loose rows of a length begin
        total = int(loose.sum())
        self.full, tail = divmod(total, window)
        self.tail_cuts = [self.full * window]
        for bit in reversed(range(window.bit_length())):
            if tail >> bit & 1:
                self.tail_cuts.append(self.tail_cuts[-1] + (1 << bit))

    def places(self, length: int, rank: int, loose_from: int):
        """(offset in the row, length, sequence, offset there, kind) of the
        row's pieces; loose sequences count from ``loose_from``."""
        if rank < self.used[length]:
            lo, seq, at = self.slots[length]
            k = int(np.searchsorted(lo, rank, "right")) - 1
            yield 0, length, int(seq[k]) + rank - int(lo[k]), int(at[k]), "combined"
            return
        o = int(self.stream[length]) + (rank - int(self.used[length])) * length
        done = 0
        while done < length:
            p = o + done
            if p < self.full * self.window:
                s = p // self.window
                begin, end = s * self.window, (s + 1) * self.window
            else:
                i = int(np.searchsorted(self.tail_cuts, p, "right")) - 1
                s, begin, end = self.full + i, self.tail_cuts[i], self.tail_cuts[i + 1]
            n = min(length - done, end - p)
            yield done, n, loose_from + s, p - begin, "loose"
            done += n


def pack(docs: DataFrame, scratch: Scratch, tokenizer: str, end_id: int, window: int = 1024) -> DataFrame:
    """Pieces of all ``docs`` (doc_id, text): doc_id, start (ids of the
    document before it), length, ids_crc32, doc_tokens, sequence_id, offset
    (in the sequence), kind (chunk, combined or loose)."""
    parts = shuffle_partitions(docs.sparkSession)
    encoded = scratch.table(encode_rest(docs, tokenizer, end_id, window), "encoded")
    ordered = encoded.repartitionByRange(parts, "rest_len", "doc_id").sortWithinPartitions("rest_len", "doc_id")
    rows = scratch.table(ordered.mapInArrow(_numbered, ENCODED + ", part int, rank long, chunks_before long"), "rows")
    scratch.drop("encoded")
    # At most one row per part and length that occurs there: ranges of lengths.
    counts = rows.groupBy("part", "rest_len").agg(
        F.count("*").alias("n"), F.sum(F.size("chunk_crcs")).alias("chunks")).orderBy("part", "rest_len").collect()
    hist, before, chunk_base, chunks = np.zeros(window + 1, np.int64), {}, {}, 0
    for r in counts:
        before[r["part"], r["rest_len"]] = int(hist[r["rest_len"]])
        hist[r["rest_len"]] += r["n"]
        chunk_base.setdefault(r["part"], chunks)
        chunks += r["chunks"]
    hist[0] = 0
    shared = docs.sparkSession.sparkContext.broadcast((Plan(hist, window), before, chunk_base, chunks))

    def place(batches):
        plan, before, chunk_base, chunks = shared.value
        for b in batches:
            out: list[tuple] = []
            rows = zip(*[b[c].to_pylist() for c in ("doc_id", "doc_tokens", "chunk_crcs", "rest_len", "rest", "part", "rank", "chunks_before")])
            for doc_id, size, crcs, n, rest, part, rank, ahead in rows:
                seq = plan.combined + chunk_base[part] + ahead
                out += [(doc_id, i * window, window, c, size, seq + i, 0, "chunk") for i, c in enumerate(crcs)]
                if not n:
                    continue
                ids = np.frombuffer(rest, f"<u{len(rest) // n}").astype("<u4")
                for at, m, seq, off, kind in plan.places(n, before[part, n] + rank, plan.combined + chunks):
                    out.append((doc_id, size - n + at, m, crc(ids[at:at + m]), size, seq, off, kind))
            cols = list(zip(*out)) or [[]] * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols[:7]] + [pa.array(cols[7], pa.string())],
                                             names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "kind"])

    return rows.mapInArrow(place, PIECES)
