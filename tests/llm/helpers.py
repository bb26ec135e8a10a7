"""Shared by the tests of the training-data operators."""

import re
import zlib

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))


def crc(i):
    return zlib.crc32(b"" if i is None else str(i).encode())


def docs_frame(spark, rows):
    """(doc_id, text) rows as a table like ``documents``."""
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], DOCS)


ODD_TEXTS = [None, "", " \n\t", "a", "A b", "a b c", "é́ 　x", "😀 " * 30, "x" * 20_000, "the " * 5_000, "\x00\x01 ﷐ |",
             "  two  spaces \n\n lines \r\n", "<|endoftext|> <s> <unk>", "ΑΣ Σ İ!", "ſ's don't 12 345"]
