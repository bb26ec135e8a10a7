"""Encode documents and keep their ids in seekable token files.

``write_tokens`` sorts the documents by ``doc_id`` over ranges, encodes each
range in one task straight into one token file (see ``tokenfile``) in a
folder that the cluster shares, and returns the manifest: one row per file,
in document order, with the number of tokens before it. Files of attempts
that failed are never named by a manifest. ``read_tokens`` opens the files
and returns a row per document; ``read_documents`` fetches chosen documents
from one file by byte range.

Edge cases: a null text is empty and has the end id alone; null ids come
first; repeated ids keep one row each, in any order among themselves; an
empty table has an empty manifest.
"""

from __future__ import annotations

import uuid
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, crc, shuffle_partitions
from .encoding import encoder
from .tokenfile import TokenFile, filesystem, write_token_file

MANIFEST = "part int, file string, docs long, tokens long"


def write_tokens(docs: DataFrame, scratch: Scratch, tokenizer: str, end_id: int) -> DataFrame:
    """Write ``docs`` (doc_id, text) as token files; returns the manifest
    (part, file, docs, tokens, start)."""
    folder = scratch.path("tokens")
    # Ranges of doc_id: equal ids meet in one file, files follow each other.
    spread = docs.select("doc_id", "text").repartitionByRange(shuffle_partitions(docs.sparkSession), "doc_id")

    def write(batches):
        from pyspark import TaskContext
        part, enc = TaskContext.get().partitionId(), encoder(tokenizer)
        end = np.asarray([end_id], enc.dtype).tobytes()

        def rows(first):
            for b in chain([first], batches):
                for i in range(0, b.num_rows, 1500):
                    piece = b.slice(i, 1500)
                    yield from zip(piece["doc_id"].to_pylist(), [ids.tobytes() + end for ids in enc.encode_column(piece["text"])])

        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        store, path = filesystem(folder)
        store.create_dir(path, recursive=True)
        name = f"part-{part:06d}-{uuid.uuid4().hex}.zst"
        with store.open_output_stream(f"{path}/{name}", compression=None) as out:
            n, tokens = write_token_file(out, rows(first), enc.dtype.itemsize)
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "file": [f"{folder}/{name}"],
                                          "docs": [n], "tokens": [tokens]})

    written = scratch.table(spread.sortWithinPartitions("doc_id").mapInArrow(write, MANIFEST), "manifest")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    return written.withColumn("start", F.coalesce(F.sum("tokens").over(before), F.lit(0)))


def open_token_file(file: str) -> TokenFile:
    store, path = filesystem(file)
    f = store.open_input_file(path)
    return TokenFile(f, f.size())


def read_documents(file: str, numbers: list[int]) -> list[np.ndarray]:
    """Ids of the chosen documents of one file; only their frames are read."""
    t = open_token_file(file)
    return [np.frombuffer(t.document(i), f"<u{t.width}") for i in numbers]


def read_tokens(manifest: DataFrame) -> DataFrame:
    """One row per document of the files: doc_id, start (ids of all documents
    before it), n_tokens, ids_crc32 (of the ids as 32-bit integers)."""
    def read(batches):
        for b in batches:
            for file, start in zip(b["file"].to_pylist(), b["start"].to_pylist()):
                t = open_token_file(file)
                cols: dict[str, list] = {"doc_id": [], "start": [], "n_tokens": [], "ids_crc32": []}
                for _, doc_id, data in t.documents():
                    n = len(data) // t.width
                    for c, v in zip(cols.values(), (doc_id, start, n, crc(np.frombuffer(data, f"<u{t.width}").astype("<u4")))):
                        c.append(v)
                    start += n
                    if len(cols["doc_id"]) == 10_000:
                        yield pa.RecordBatch.from_pydict({k: pa.array(v, pa.int64()) for k, v in cols.items()})
                        cols = {k: [] for k in cols}
                yield pa.RecordBatch.from_pydict({k: pa.array(v, pa.int64()) for k, v in cols.items()})

    files = manifest.select("file", "start").repartition(shuffle_partitions(manifest.sparkSession))
    return files.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
