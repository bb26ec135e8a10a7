"""Exact fast encoding with the tokenizers library.

Words repeat, so a worker keeps the ids of text chunks it has encoded and
asks the library only for new ones. A text is cut at single spaces where the
tokenizer's own pre-tokenizer cuts in any case, so the ids equal those of the
whole text (tests compare them); a text with other white space around a cut,
or a tokenizer of another kind, is encoded whole.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# A chunk is "\nword" or "word"; this finds white space at its ends, or no word.
_WHITE = r"\s\x1c-\x1f\x{85}\pZ"
_ODD = rf"^$|^\n[{_WHITE}]|^[\t\v\f\r\x1c-\x1f\x{{85}}\pZ]|[{_WHITE}]$"

# Chunks kept per worker; at the bound the store is emptied and fills anew.
MAX_CHUNKS = 1_200_000


def cut_rule(spec: dict) -> str:
    """How a tokenizer's texts may be cut: ``lead`` (byte-level words carry
    the space before them), ``drop`` (white space is dropped), ``whole``."""
    pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
    if pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and norm is None:
        return "lead"
    steps = pre.get("pretokenizers") or [{}]
    norms = {n.get("type") for n in (norm or {}).get("normalizers", [norm] if norm else [])}
    words = (steps[0].get("pattern") or {}).get("Regex", "").split("|")
    if steps[0].get("type") == "Split" and steps[0].get("behavior") == "Removed" and steps[0].get("invert") \
            and r"[^\s\p{L}\p{N}]+" in words and norms <= {"NFC", "Replace", "Lowercase"}:
        return "drop"
    return "whole"


def cut_chunks(col: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Cut texts at spaces: each text's first chunk, the chunks as numbers,
    and the distinct chunks that the numbers mean."""
    lists = pc.split_pattern(col, " ")
    first = lists.offsets.to_numpy()
    words = lists.values.slice(first[0], first[-1] - first[0]).dictionary_encode()
    return first - first[0], words.indices.to_numpy(), words.dictionary


def gather(parts: list[bytes], dtype: np.dtype, first: np.ndarray, number: np.ndarray, skip: int = 0) -> list[np.ndarray]:
    """The ids of each text, from those of its chunks in text order, without
    its first ``skip``."""
    sizes = np.fromiter(map(len, parts), np.int64, len(parts)) // dtype.itemsize
    ids = np.frombuffer(b"".join(parts), dtype)
    n = sizes[number]
    ends = np.cumsum(n)
    begin = (np.cumsum(sizes) - sizes)[number] - (ends - n)
    flat = ids[np.repeat(begin, n) + np.arange(ends[-1] if len(ends) else 0)]
    ends = np.append(0, ends)
    return [flat[a + skip:b] for a, b in zip(ends[first[:-1]].tolist(), ends[first[1:]].tolist())]


class ChunkEncoder:
    """Encode texts to the little-endian bytes of their ids, without special
    tokens (their strings in a text are ordinary text)."""

    def __init__(self, path: str, max_chunks: int = MAX_CHUNKS):
        from tokenizers import Tokenizer
        with open(path, encoding="utf-8") as f:
            self.rule = cut_rule(json.load(f))
        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True
        self.tok.no_padding()
        self.tok.no_truncation()
        self.dtype = np.dtype("<u2" if self.tok.get_vocab_size() <= 1 << 16 else "<u4")
        self.max_chunks = max_chunks
        self.known: dict[str, bytes] = {"": b""}
        self.marks = dict(zip(".,;:!?", self._ids(list(".,;:!?"))))
        if self.rule == "lead":
            self.starts = np.zeros(self.tok.get_vocab_size(), bool)
            self.starts[[i for t, i in self.tok.get_vocab().items() if t[0] in "\u0120\u010a"]] = True
        elif self.rule == "drop":
            bar = self.tok.encode("|", add_special_tokens=False).ids
            self.bar = bar[0] if len(bar) == 1 else -1

    def _ids(self, texts: list[str]) -> list[bytes]:
        out = self.tok.encode_batch(texts, add_special_tokens=False)
        return [np.asarray(e.ids, self.dtype).tobytes() for e in out]

    def _ids_joined(self, full: list[str]) -> list[bytes]:
        """Ids of many chunks from one call: in ``lead`` a chunk's first
        token is the only one that begins with a space or line end; in
        ``drop`` a bar, which no chunk here holds, stands between chunks."""
        if self.rule == "lead":
            ids = np.asarray(self.tok.encode("".join(full), add_special_tokens=False).ids, self.dtype)
            cuts = np.flatnonzero(self.starts[ids])
            cuts = np.append(cuts, len(ids)) * self.dtype.itemsize
            skip = 0
        else:
            ids = np.asarray(self.tok.encode("|".join(full) + "|", add_special_tokens=False).ids, self.dtype)
            cuts = np.append(-1, np.flatnonzero(ids == self.bar)) * self.dtype.itemsize
            skip = self.dtype.itemsize
        if len(cuts) != len(full) + 1:
            return self._ids(full)
        raw, at = ids.tobytes(), cuts.tolist()
        return [raw[a + skip:b] for a, b in zip(at, at[1:])]

    def _with_mark(self, new: list[str]) -> list[str]:
        """Learn chunks that are a known word and one mark, which both rules
        encode apart; returns the others."""
        known, marks, rest = self.known, self.marks, []
        for c in new:
            if c and c[-1] in marks and c[:-1].lower().isalpha() and (stem := known.get(c[:-1])) is not None:
                known[c] = stem + marks[c[-1]]
            else:
                rest.append(c)
        return rest

    def _learn(self, chunks: list[str]) -> None:
        """Store the ids of chunks that are not known."""
        known = self.known
        if len(known) + len(chunks) > self.max_chunks:
            known.clear()
        known[""] = b""
        if self.rule == "lead":
            new = self._with_mark(chunks)
            known.update(zip(new, self._ids_joined([c if c[0] == "\n" else " " + c for c in new])))
            return
        # The tokenizer lowers the text anyway; two letters lower by their
        # neighbours or to two characters, so they are left to it.
        low = {c: c if "\u03a3" in c or "\u0130" in c else c.lower() for c in chunks}
        new = self._with_mark([c for c in dict.fromkeys(low.values()) if c not in known])
        plain = [c for c in new if "|" not in c] if self.bar >= 0 else []
        known.update(zip(plain, self._ids_joined([" " + c + " " for c in plain])))
        rest = [c for c in new if c not in known]
        known.update(zip(rest, self._ids(rest)))
        known.update([(c, known[k]) for c, k in low.items()])

    def encode(self, text: str | None) -> np.ndarray:
        """The ids of one text."""
        return self.encode_column(pa.array([text], pa.large_string()))[0]

    def encode_column(self, col: pa.Array, at_once: int = 1500) -> list[np.ndarray]:
        """The ids of each text of an Arrow string column (null: none)."""
        out = []
        for i in range(0, len(col), at_once):
            out += self._encode_slice(col.slice(i, at_once).cast(pa.large_string()).fill_null(""))
        return out

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.frombuffer(x, self.dtype) for x in self._ids(texts)]

    def _encode_slice(self, col: pa.Array) -> list[np.ndarray]:
        if self.rule == "whole":
            return self._whole(col.to_pylist())
        if self.rule == "lead":
            # Chunks: "\nword" at a line's start, else "word", which stands for " word".
            cut = pc.replace_substring(col, "\n", " \n")
            cut = pc.binary_join_element_wise(pa.scalar("\n", pa.large_string()), cut, pa.scalar("", pa.large_string()))
        else:
            cut = pc.replace_substring(col, "\n", " ")
        first, number, distinct = cut_chunks(cut)
        odd = None
        if self.rule == "lead":
            # At an end that is white space itself a cut is not the tokenizer's.
            odd = pc.match_substring_regex(distinct, _ODD).to_numpy(zero_copy_only=False)
            distinct = pc.if_else(odd, "", distinct) if odd.any() else distinct
        skip = 1 if self.rule == "lead" else 0  # the line end put before the text
        out = gather(self._chunks(distinct.to_pylist()), self.dtype, first, number, skip)
        if odd is not None and odd.any():
            again = np.flatnonzero(np.add.reduceat(odd[number], first[:-1]))
            for i, ids in zip(again.tolist(), self._whole([col[int(i)].as_py() for i in again])):
                out[i] = ids
        return out

    def _chunks(self, chunks: list[str]) -> list[bytes]:
        """Ids of chunks."""
        got = list(map(self.known.get, chunks))
        if None in got:
            kept = len(self.known)
            self._learn([c for c, v in zip(chunks, got) if v is None])
            if len(self.known) < kept:  # the store was emptied meanwhile
                self._learn(list({c for c in chunks if c not in self.known}))
            got = list(map(self.known.get, chunks))
        return got


_ENCODERS: dict[str, ChunkEncoder] = {}


def encoder(path: str) -> ChunkEncoder:
    """One encoder per worker process and file. Spark's tasks are the
    parallelism, so the library's own threads stay off."""
    import os
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path not in _ENCODERS:
        _ENCODERS[path] = ChunkEncoder(path)
    return _ENCODERS[path]


def tidy(task):
    """Wrap an Arrow task of an operator without an encoder. Python workers
    live on and are used again, so before and after the task the worker's
    encoders are forgotten and freed memory goes back to the system."""
    def run(batches):
        _give_back()
        yield from task(batches)
        _give_back()
    return run


def _give_back() -> None:
    import ctypes
    _ENCODERS.clear()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim is not None:
        trim(0)


def tokenizer_path(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)
