"""Token files: one zstandard frame per document, a seek table at the end.

Layout (the public seekable zstandard format, all integers little-endian):

    frame 0 | frame 1 | ... | index frame | seek table

* Frame i holds the ids of document i as little-endian integers of the file's
  width; frames are independent and carry zstandard's content checksum.
* The index frame is skippable (magic 0x184D2A50): a zstandard-compressed
  block of the width in bytes (u32), the number of documents (u32), their ids
  (i64; the least value stands for null) and their numbers of tokens (i64).
* The seek table is skippable (magic 0x184D2A5E): per frame compressed size,
  size and the low 32 bits of the content's XXH64 (u32 each), then the number
  of frames (u32), a descriptor (0x80: checksums) and magic 0x8F92EAB1.

A reader fetches the tail, then only the byte ranges of the documents it is
asked for, and checks each one's checksum. Any zstandard tool can decompress
the whole file, too.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import xxhash
import zstandard

INDEX_MAGIC, SEEK_MAGIC, FOOT_MAGIC = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
NULL_ID = -(1 << 63)


def filesystem(uri: str):
    """(pyarrow file system, path) of a URI or path; tasks write through it
    to whatever store the cluster shares (file, hdfs, s3, gs, ...)."""
    from pyarrow import fs
    return fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", uri))


def write_token_file(out, docs: Iterable[tuple[int | None, bytes]], width: int) -> tuple[int, int]:
    """Write (doc_id, little-endian ids) to a binary stream, one document at
    a time; returns (documents, tokens)."""
    packer = zstandard.ZstdCompressor(level=1, write_checksum=True)
    ids, counts, table = [], [], []
    for doc_id, data in docs:
        frame = packer.compress(data)
        out.write(frame)
        ids.append(NULL_ID if doc_id is None else doc_id)
        counts.append(len(data) // width)
        table.append((len(frame), len(data), xxhash.xxh64_intdigest(data) & 0xFFFFFFFF))
    index = zstandard.ZstdCompressor(level=1).compress(
        struct.pack("<II", width, len(ids)) + np.asarray(ids, "<i8").tobytes() + np.asarray(counts, "<i8").tobytes())
    out.write(struct.pack("<II", INDEX_MAGIC, len(index)) + index)
    seek = np.asarray(table, "<u4").reshape(-1, 3).tobytes() + struct.pack("<IBI", len(table), 0x80, FOOT_MAGIC)
    out.write(struct.pack("<II", SEEK_MAGIC, len(seek)) + seek)
    return len(ids), sum(counts)


class TokenFile:
    """Random access to one token file (a seekable binary stream)."""

    def __init__(self, stream, size: int):
        self.f = stream
        n, flags, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != FOOT_MAGIC or flags != 0x80:
            raise ValueError("not a token file")
        table = size - 9 - 12 * n
        self.seek = np.frombuffer(self._at(table, 12 * n), "<u4").reshape(-1, 3)
        self.starts = np.concatenate([[0], np.cumsum(self.seek[:, 0], dtype=np.int64)])
        at = int(self.starts[-1])
        index = zstandard.ZstdDecompressor().decompress(self._at(at + 8, table - 8 - at - 8))
        self.width, self.n = struct.unpack("<II", index[:8])
        self.doc_ids = np.frombuffer(index, "<i8", self.n, 8)
        self.counts = np.frombuffer(index, "<i8", self.n, 8 + 8 * self.n)

    def _at(self, start: int, length: int) -> bytes:
        self.f.seek(start)
        return self.f.read(length)

    def _frame(self, i: int, frame: bytes) -> bytes:
        size = int(self.seek[i, 1])
        data = zstandard.ZstdDecompressor().decompress(frame, max_output_size=max(1, size))
        if len(data) != size or xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != int(self.seek[i, 2]):
            raise ValueError(f"frame {i} is damaged")
        return data

    def document(self, i: int) -> bytes:
        """The ids of document number ``i``, from its byte range alone."""
        return self._frame(i, self._at(int(self.starts[i]), int(self.seek[i, 0])))

    def documents(self, at_once: int = 1 << 22) -> Iterator[tuple[int, int | None, bytes]]:
        """All (number, doc_id, ids) in order, reading about ``at_once`` bytes a time."""
        i = 0
        while i < self.n:
            j = max(i + 1, int(np.searchsorted(self.starts, self.starts[i] + at_once, "right")) - 1)
            block, base = self._at(int(self.starts[i]), int(self.starts[j] - self.starts[i])), int(self.starts[i])
            for k in range(i, j):
                doc_id = int(self.doc_ids[k])
                yield k, None if doc_id == NULL_ID else doc_id, self._frame(
                    k, block[int(self.starts[k]) - base:int(self.starts[k + 1]) - base])
            i = j
