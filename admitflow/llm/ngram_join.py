"""Exact Jaccard join of word n-gram sets by PartEnum signatures.

Two documents link when ``den * |A and B| >= num * |A or B|``. Sets of sizes
a and b that link differ in at most ``(a + b) (den - num) / (den + num)``
elements, so sizes are put into bands and each band has a bound ``k`` on the
difference of linked sets whose smaller one is in it. The feature domain is
partitioned in two levels by hash: into n1 parts, each of ``second`` pieces.
Every choice of all pieces but one of a part, with the part's number, is
hashed to a signature. As n1 > k / 2, k differences cannot spoil all
signatures; n1 is larger than needed by the share ``SPARE``, so linked sets
have several in common (``Bands.shared``), and sets that merely share a passage
do not. A set slightly larger than the band below takes that band's
signatures, too; a signature's lowest bit tells the two kinds apart.

``overlap.grouped`` makes lists of the rarest shared signatures, tests pairs
by size and a parity sketch (a lower bound of the difference), checks those
left on the whole sets and joins links to components, without ever emitting
all pairs of a group. Copies (equal sets) are one node.

Sets are compared by 64-bit hashes of their n-grams, nodes are 64-bit hashes
of sets. Edge cases: a null text, or one without words, has the empty set and
links with nothing; a text of fewer than n words has its whole sequence as
one n-gram; rows without an id link like others, and a group that has no id
has a null component; repeated ids with different texts are different
documents; an empty table has no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch
from .encoding import tidy
from .overlap import grouped, per_row, small
from .textkernel import mix, text_buffer, word_hashes

BAND = 1.5  # largest size of a band over its smallest, at least
SKETCH = 2  # least bits of a sketch for each element, and 1024 in all
SPARE = 0.2  # more first-level parts than one that must agree, as a share
_STEP = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)]


def _powers(n: int) -> list[np.uint64]:
    return [np.uint64(pow(0x9E3779B97F4A7C15, j, 1 << 64)) for j in range(n)]


def shingle_sets(col, n: int):
    """Ascending distinct 64-bit n-gram hashes of each text of a column."""
    raw, at = text_buffer(col)
    words, first = word_hashes(raw, at)
    grams = np.zeros(max(0, len(words) - n + 1), np.uint64)
    for j, p in enumerate(_powers(n)):
        grams += words[j:j + len(grams)] * p
    grams = mix(grams)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= n:
            yield np.unique(grams[a:b - n + 1])
        elif b > a:
            short = words[a:b] * np.asarray(_powers(b - a), np.uint64)
            yield mix(short.sum(dtype=np.uint64, keepdims=True) + _STEP[1] * np.asarray([b - a], np.uint64))
        else:
            yield np.zeros(0, np.uint64)


class Bands:
    """Size bands and the signature scheme of each."""

    def __init__(self, num: int, den: int, second: int = 3):
        self.num, self.den, self.second = num, den, second
        self.low, self.high = [1], [1]
        self.ratio = max(BAND, den / num)  # a set links into the next band at most

    def difference(self, sizes: int) -> int:
        """Most elements by which linked sets of that total size differ."""
        return sizes * (self.den - self.num) // (self.den + self.num)

    def of(self, size: int) -> list[tuple[int, int]]:
        """(band, k) of the one or two bands whose signatures a set takes."""
        while self.high[-1] < size:
            low = self.high[-1] + 1
            self.low.append(low)
            self.high.append(max(low, int(low * self.ratio)))
        i = int(np.searchsorted(self.low, size, "right")) - 1
        bands = [j for j in (i, i - 1) if j >= 0 and size * self.num <= self.high[j] * self.den]
        return [(j, self.difference(self.high[j] + self.high[j] * self.den // self.num)) for j in bands]

    def parts(self, k: int) -> int:
        """First-level parts for sets that differ in at most k elements."""
        return (k // 2 + 1) + int(SPARE * (k // 2 + 1))

    def shared(self, k: int) -> int:
        """Signatures that two such sets have in common at least. With two
        pieces a difference spoils one; with more, a part's first difference
        spoils all but one, the second the last."""
        n1 = self.parts(k)
        if self.second == 2:
            return 2 * n1 - k
        first = min(k, n1)
        return self.second * n1 - (self.second - 1) * first - (k - first)

    def needs(self, size: int) -> list[int]:
        """The same for a set of that size, by the signatures' lowest bit
        (0: takes none)."""
        need = [0, 0]
        for band, k in self.of(size) if size else []:
            need[band & 1] = self.shared(k)
        return need


def signatures(items: np.ndarray, bands: Bands) -> np.ndarray:
    """PartEnum signatures of a set of 64-bit items."""
    if not len(items):
        return np.zeros(0, np.uint64)
    out, second = [], bands.second
    spread = mix(items ^ _STEP[2])
    with np.errstate(over="ignore"):
        for band, k in bands.of(len(items)):
            salt = np.uint64(band + 1) * _STEP[0]
            n1 = bands.parts(k)
            piece = (items >> np.uint64(32)) % np.uint64(n1) * np.uint64(second) + (items & np.uint64(0xFFFFFFFF)) % np.uint64(second)
            sums = np.zeros(n1 * second, np.uint64)
            np.add.at(sums, piece.astype(np.int64), spread)
            sums = mix(sums + np.arange(n1 * second, dtype=np.uint64) * _STEP[1]).reshape(n1, second)
            rest = sums.sum(1, dtype=np.uint64)
            parts = np.arange(n1 * second, dtype=np.uint64).reshape(n1, second)
            found = mix(rest[:, None] - sums + parts * _STEP[2] + salt).ravel()  # all pieces but one
            out.append(found & ~np.uint64(1) | np.uint64(band & 1))
    return np.concatenate(out)


def _signed(a: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(a, np.uint64).view(np.int64)


def sketch(items: np.ndarray) -> bytes:
    """Parities of the items by hash, in a power of two of bits that grows
    with the set: two sets' sketches, folded to one length, differ in at most
    as many bits as the sets in elements."""
    bits = 1 << max(10, (SKETCH * len(items) - 1).bit_length())
    odd = np.bincount((items & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def folded(sketches: list) -> np.ndarray:
    """Sketches as rows of 64-bit words, all of the shortest one's length."""
    least = min(map(len, sketches))
    out = np.empty((len(sketches), least // 8), np.uint64)
    for i, b in enumerate(sketches):
        words = np.frombuffer(b, np.uint64)
        out[i] = np.bitwise_xor.reduce(words.reshape(-1, least // 8), axis=0) if len(b) > least else words
    return out


def node_of(items: np.ndarray) -> int:
    with np.errstate(over="ignore"):
        return int(_signed(mix(np.asarray([mix(items + _STEP[0]).sum(dtype=np.uint64) + np.uint64(len(items))])))[0])


class Sketches:
    """Sizes and parity sketches of some sets."""

    def __init__(self, sizes: np.ndarray, sketches: np.ndarray, num: int, den: int):
        self.sizes, self.bits, self.num, self.den = sizes, folded(sketches.tolist()), num, den

    def near(self, i: int, js: np.ndarray) -> np.ndarray:
        """Those of js whose size and sketch allow a link with i."""
        size = self.sizes[js]
        ok = np.minimum(size, self.sizes[i]) * self.den >= np.maximum(size, self.sizes[i]) * self.num
        js, size = js[ok], size[ok]
        diff = np.bitwise_count(self.bits[js] ^ self.bits[i]).sum(1, dtype=np.int64)
        return js[diff * (self.den + self.num) <= (size + self.sizes[i]) * (self.den - self.num)]


SETS = "doc_id long, rep_key long, n_shingles long, node long, need_0 int, need_1 int, sketch binary"


def _slices(batches):
    for b in batches:
        for i in range(0, b.num_rows, 500):
            yield b.slice(i, 500)


def _sets(n: int, num: int, den: int, second: int):
    def sets(batches):
        bands = Bands(num, den, second)
        for b in _slices(batches):
            sizes, nodes, needs, sketches = [], [], [], []
            for items in shingle_sets(b["text"], n):
                sizes.append(len(items))
                nodes.append(node_of(items) if len(items) else None)
                needs.append(bands.needs(len(items)))
                sketches.append(sketch(items))
            need = np.asarray(needs, np.int32).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [b["doc_id"].cast(pa.int64()), b["rep_key"], pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()),
                 pa.array(need[:, 0]), pa.array(need[:, 1]), pa.array(sketches, pa.binary())],
                names=["doc_id", "rep_key", "n_shingles", "node", "need_0", "need_1", "sketch"])
    return sets


def _signs(n: int, num: int, den: int, second: int):
    """(sig, node) of every text: made anew where they are read, as storing
    them takes as much room as the texts."""
    def signs(batches):
        bands = Bands(num, den, second)
        for b in _slices(batches):
            sets = [s for s in shingle_sets(b["text"], n) if len(s)]
            sigs = [_signed(signatures(s, bands)) for s in sets]
            nodes = np.repeat(np.asarray([node_of(s) for s in sets], np.int64), [len(s) for s in sigs])
            flat = np.concatenate(sigs) if sigs else np.zeros(0, np.int64)
            for i in range(0, len(flat), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(flat[i:i + 100_000]), pa.array(nodes[i:i + 100_000])], names=["sig", "node"])
    return signs


def items_of(n: int):
    """(node, set) of every text of a column; the empty set has no node."""
    def items(col):
        for s in shingle_sets(col, n):
            yield (node_of(s) if len(s) else None), s
    return items


def one_row_a_node(sets: DataFrame, *cols: str) -> DataFrame:
    """Copies as one node: its smallest id, the hash of one of its texts, and
    the given columns, which are the same in all copies."""
    key = F.coalesce(F.min_by("rep_key", "doc_id"), F.min("rep_key"))
    return sets.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("rep_id"), key.alias("rep_key"),
                                                              *[F.first(c).alias(c) for c in cols])


def _rows(docs: DataFrame, scratch: Scratch, n: int, num: int, den: int, second: int) -> DataFrame:
    """(doc_id, rep_key, n_shingles, node, comp, component_id) of every row."""
    docs = docs.select("doc_id", "text")
    texts = docs.withColumn("rep_key", F.xxhash64("text"))
    sets = scratch.table(texts.mapInArrow(tidy(_sets(n, num, den, second)), SETS), "sets")
    nodes = scratch.table(one_row_a_node(sets, "n_shingles", "sketch", "need_0", "need_1"), "nodes")
    rows = scratch.table(sets.select("doc_id", "rep_key", "n_shingles", "node"), "rows")
    scratch.drop("sets")
    signs = docs.select("text").mapInArrow(tidy(_signs(n, num, den, second)), "sig long, node long")
    kinds = F.array(*[F.struct(F.lit(i).alias("part"), F.col(f"need_{i}").alias("need")) for i in (0, 1)])
    need = nodes.select("node", F.inline(kinds)).where("need > 0")
    ids = grouped(docs, nodes, signs, need, Sketches, items_of(n), num, den, scratch, F.col("sig").bitwiseAND(1).cast("int"))
    scratch.drop("nodes")
    return per_row(rows, ids)


def similar_groups(docs: DataFrame, scratch: Scratch, n: int = 5, num: int = 80, den: int = 100, second: int = 2) -> DataFrame:
    """A row per document of ``docs`` (doc_id, text): doc_id, n_shingles, and
    component_id, the smallest doc_id among the documents reachable by links."""
    return _rows(docs, scratch, n, num, den, second).select("doc_id", "n_shingles", "component_id")


def first_of_groups(docs: DataFrame, scratch: Scratch, n: int = 5, num: int = 80, den: int = 100, second: int = 2) -> DataFrame:
    """``docs`` (any columns besides doc_id and text) with one row of each
    group of near copies: the one with the smallest doc_id (rows without one
    come last), among rows of that id the one whose text has the smallest
    hash, and of equal rows of one id any. Every row is judged by its own
    text, also where ids repeat; texts without words stay."""
    rows = _rows(docs, scratch, n, num, den, second).where("node is not null")
    first = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "rep_key")
    rows = rows.groupBy("comp", "doc_id", "rep_key").agg(F.count("*").alias("n"))
    rows = scratch.table(rows.select("*", first.alias("at")), "group-rows")
    kept = scratch.table(rows.groupBy("comp").agg(F.min("at").alias("kept")), "group-kept")
    judged = rows.join(kept, "comp")
    gone = scratch.table(judged.where("at != kept").select("doc_id", "rep_key"), "gone")
    many = scratch.table(judged.where("at = kept and n > 1").select("doc_id", "rep_key"), "many")
    scratch.drop("group-rows", "group-kept", "rows", "ids")
    keyed = docs.select("*", F.struct("doc_id", F.xxhash64("text").alias("key")).alias("_of"))

    def among(list_of: DataFrame, how: str, of: DataFrame) -> DataFrame:
        wanted = small(list_of).select(F.col("doc_id").alias("_id"), F.col("rep_key").alias("_key"))
        return of.join(wanted, F.col("_of.doc_id").eqNullSafe(F.col("_id")) & (F.col("_of.key") == F.col("_key")), how)

    left = among(gone, "left_anti", keyed)
    if not many.isEmpty():
        again = among(many, "left_semi", left)
        one = again.groupBy("_of").agg(F.first(F.struct(*_names(docs))).alias("row")).select("row.*")
        return among(many, "left_anti", left).select(*_names(docs)).unionByName(one)
    return left.select(*_names(docs))


def _names(df: DataFrame) -> list[str]:
    return [f"`{c}`" for c in df.columns]
