"""SentencePiece models run by the tokenizers library.

The model file's protobuf is parsed here (only its public fields that matter)
and rebuilt: precompiled character map and white space rules as normaliser,
the metaspace mark, unigram scores or merge ranks, and byte fallback. Documents
are encoded in batches with the library's threads (as many as the task's
cores) and decoded again. New chunks are compared with the SentencePiece
library itself, so parity is verified on everything that is encoded.

Where no piece crosses a space or holds a line end and the normaliser is the
identity, texts are cut there and a worker keeps the ids of the chunks it
knows; the ids equal those of the whole text (tests compare them). Other
models and texts with two spaces running are encoded whole.

Edge cases: a null text is empty and has no ids; characters without pieces
become bytes (or the unknown id in models without bytes); U+2581, which is the
mark itself, decodes to a space, as in SentencePiece; an empty table has no
rows, repeated rows repeat.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import crc
from .encoding import MAX_CHUNKS, cut_chunks, gather

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


def _fields(data: bytes):
    """(number, value) of a protobuf message: ints, bytes, or raw fixed bytes."""
    i = 0

    def varint() -> int:
        nonlocal i
        value = shift = 0
        while True:
            b = data[i]
            i += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while i < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
        yield key >> 3, data[i:i + size]
        i += size


@dataclass
class Spec:
    """What a model file says."""
    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    squeeze: bool = True
    suffix: bool = False


def parse_model(data: bytes) -> Spec:
    spec = Spec()
    for number, value in _fields(data):
        if number == 1:
            f = dict(_fields(value))
            spec.pieces.append((f.get(1, b"").decode(), struct.unpack("<f", f[2])[0] if 2 in f else 0.0, f.get(3, NORMAL)))
        elif number == 2:
            f = dict(_fields(value))
            spec.kind, spec.byte_fallback, spec.suffix = f.get(3, UNIGRAM), bool(f.get(35, 0)), bool(f.get(24, 0))
        elif number == 3:
            f = dict(_fields(value))
            spec.charsmap = f.get(2, b"")
            spec.dummy_prefix, spec.squeeze = bool(f.get(3, 1)), bool(f.get(4, 1))
    return spec


def _merges(spec: Spec) -> list[tuple[str, str]]:
    """Every way to join two pieces to one, best joined piece first."""
    rank = {p: (-s, i) for i, (p, s, t) in enumerate(spec.pieces) if t == NORMAL}
    found = [(rank[p], len(p) - k, p[:k], p[k:]) for p in rank for k in range(1, len(p)) if p[:k] in rank and p[k:] in rank]
    return [(a, b) for _, _, a, b in sorted(found)]


def build_tokenizer(spec: Spec, normalise: bool = True):
    """The model as a tokenizers ``Tokenizer``; without ``normalise`` it takes
    text whose spaces are marks already."""
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers
    if spec.suffix:
        raise ValueError("models with the mark after words are not supported")
    unknown = next(i for i, (_, _, t) in enumerate(spec.pieces) if t == UNKNOWN)
    if spec.kind == UNIGRAM:
        # Only normal pieces may match a text: others get a score out of reach.
        scores = [(p, s if t in (NORMAL, USER) else -1e9 if t != BYTE else s) for p, s, t in spec.pieces]
        model = models.Unigram(scores, unknown, spec.byte_fallback)
    elif spec.kind == BPE:
        model = models.BPE({p: i for i, (p, _, _) in enumerate(spec.pieces)}, _merges(spec),
                           unk_token=spec.pieces[unknown][0], fuse_unk=True, byte_fallback=spec.byte_fallback)
    else:
        raise ValueError("only unigram and BPE models are supported")
    tok = Tokenizer(model)
    steps = [normalizers.Precompiled(spec.charsmap)] if spec.charsmap else []
    if spec.squeeze:
        steps += [normalizers.Replace(Regex(" {2,}"), " "), normalizers.Replace(Regex(r"\A +| +\z"), "")]
    if spec.dummy_prefix:
        steps.append(normalizers.Prepend(" "))
    steps.append(normalizers.Replace(" ", MARK))
    if normalise:
        tok.normalizer = normalizers.Sequence(steps)
    tok.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()]
                                    + ([decoders.Strip(" ", 1, 0)] if spec.dummy_prefix else []))
    return tok


class PieceEncoder:
    """Encode and decode with a model file; ``checked`` and ``differ`` count
    the strings compared with SentencePiece and those that came out otherwise."""

    def __init__(self, path: str, threads: int = 1, max_chunks: int = MAX_CHUNKS):
        import sentencepiece
        with open(path, "rb") as f:
            self.spec = parse_model(f.read())
        self.whole, self.inner = build_tokenizer(self.spec), build_tokenizer(self.spec, normalise=False)
        self.reference = sentencepiece.SentencePieceProcessor(model_file=path)
        normal = [p for p, _, t in self.spec.pieces if t in (NORMAL, USER)]
        self.cuts = (not self.spec.charsmap and not self.spec.squeeze and self.spec.dummy_prefix
                     and not any(MARK in p.lstrip(MARK) or "\n" in p for p in normal))
        self.threads, self.max_chunks = threads, max_chunks
        self.dtype = np.dtype("<u2" if len(self.spec.pieces) <= 1 << 16 else "<u4")
        self.bytes = np.asarray([t == BYTE for _, _, t in self.spec.pieces])
        self.known: dict[str, bytes] = {}
        self.wrong: set[str] = set()  # chunks that SentencePiece encodes otherwise
        self.lossy: set[str] = set()  # chunks that do not decode to themselves
        self.checked = 0

    def _texts(self, texts: list[str]) -> tuple[list[np.ndarray], list[bool], list[bool]]:
        """Whole texts: ids, whether SentencePiece has the same, and whether
        they decode to the text."""
        ids = [e.ids if t else [] for t, e in zip(texts, self.whole.encode_batch(texts, add_special_tokens=False))]
        same = [a == b for a, b in zip(ids, self.reference.encode(texts, num_threads=self.threads))]
        self.checked += len(texts)
        back = self.whole.decode_batch(ids, skip_special_tokens=False)
        return [np.asarray(i, self.dtype) for i in ids], same, [a == t for a, t in zip(back, texts)]

    def _learn(self, chunks: list[str]) -> None:
        if len(self.known) + len(chunks) > self.max_chunks:
            self.known.clear()
        full = [c if c[:1] == "\n" else MARK + c for c in chunks]
        ids = [e.ids for e in self.inner.encode_batch(full, add_special_tokens=False)]
        # SentencePiece puts its mark before a line end, too.
        mark = self.inner.encode(MARK, add_special_tokens=False).ids
        for c, i, r in zip(chunks, ids, self.reference.encode(chunks, num_threads=self.threads)):
            if c and r != (mark + i if c[0] == "\n" else i):
                self.wrong.add(c)
        self.checked += len(chunks)
        # A chunk ends with a whole character, so texts decode chunk by chunk.
        back = self.whole.decode_batch(ids, skip_special_tokens=False)
        self.lossy.update(c for c, x in zip(chunks, back) if c != x)
        self.known.update((c, np.asarray(i, self.dtype).tobytes()) for c, i in zip(chunks, ids))

    def encode_column(self, col: pa.Array) -> tuple[list[np.ndarray], list[bool], list[bool]]:
        """Of each text (null: none) the ids, their parity with
        SentencePiece, and whether they decode to the text."""
        col = col.cast(pa.large_string()).fill_null("")
        if not self.cuts or not len(col):
            return self._texts(col.to_pylist())
        first, number, distinct = cut_chunks(pc.replace_substring(col, "\n", " \n"))
        chunks = distinct.to_pylist()
        got = list(map(self.known.get, chunks))
        if None in got:
            kept = len(self.known)
            self._learn([c for c, v in zip(chunks, got) if v is None])
            if len(self.known) < kept:
                self._learn([c for c in chunks if c not in self.known])
            got = list(map(self.known.get, chunks))
        out = gather(got, self.dtype, first, number)
        flags = []
        for bad in (self.wrong, self.lossy):
            ok = np.ones(len(col), bool)
            if bad:
                hit = np.fromiter((c in bad for c in chunks), bool, len(chunks))
                ok = ~np.logical_or.reduceat(hit[number], first[:-1])
            flags.append(ok.tolist())
        # Marks in a row are pieces of their own, and an empty text has no mark.
        odd = pc.or_(pc.match_substring_regex(col, f"^ |  |{MARK}"), pc.equal(col, ""))
        again = np.flatnonzero(odd.to_numpy(zero_copy_only=False)).tolist()
        if again:
            for i, *found in zip(again, *self._texts([col[i].as_py() for i in again])):
                out[i], flags[0][i], flags[1][i] = found
        return out, *flags

    def decode(self, ids: list[np.ndarray]) -> list[str]:
        return self.whole.decode_batch([i.tolist() for i in ids], skip_special_tokens=False)


_ENCODERS: dict[str, PieceEncoder] = {}


def encoder(path: str, threads: int) -> PieceEncoder:
    """One per worker process and model; the library's threads are the task's
    cores."""
    import os
    os.environ["RAYON_NUM_THREADS"] = str(threads)
    os.environ["TOKENIZERS_PARALLELISM"] = "true" if threads > 1 else "false"
    if path not in _ENCODERS:
        _ENCODERS[path] = PieceEncoder(path, threads)
    return _ENCODERS[path]


RESULT = {"doc_id": pa.int64(), "n_tokens": pa.int64(), "n_bytes": pa.int64(), "ids_crc32": pa.int64(), "parity": pa.bool_(),
          "decoded": pa.bool_()}


def encode_documents(docs: DataFrame, path: str, at_once: int = 500) -> DataFrame:
    """A row per document of ``docs`` (doc_id, text): numbers of ids and of
    byte ids, checksum of the ids as 32-bit integers, whether SentencePiece
    has the same ids, and whether they decode to the text."""
    def encode(batches):
        from pyspark import TaskContext
        enc = encoder(path, TaskContext.get().cpus())
        for b in batches:
            for i in range(0, b.num_rows, at_once):
                piece = b.slice(i, at_once)
                ids, same, back = enc.encode_column(piece["text"])
                cols = (piece["doc_id"].to_pylist(), [len(x) for x in ids], [int(enc.bytes[x].sum()) for x in ids],
                        [crc(x.astype("<u4")) for x in ids], same, back)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, RESULT.values())], names=list(RESULT))

    return docs.select("doc_id", "text").mapInArrow(
        encode, "doc_id long, n_tokens long, n_bytes long, ids_crc32 long, parity boolean, decoded boolean")
