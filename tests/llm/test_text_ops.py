"""Encoders, token files, packing, fingerprints, personal data."""

import bisect
import hashlib
import io
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from admitflow.llm import lz_fingerprint as LZ
from admitflow.llm import packing, pii, token_store
from admitflow.llm import sentencepiece_backend as SP
from admitflow.llm.common import Scratch, bucket_of, range_bounds
from admitflow.llm.encoding import ChunkEncoder, tokenizer_path
from admitflow.llm.textkernel import text_buffer, word_hashes
from admitflow.llm.tokenfile import TokenFile, write_token_file

from .helpers import ODD_TEXTS, docs_frame, words

SF001 = "/root/testdata/sf0.001"
ALPHABET = ["a", "Be", " ", "  ", "\n", "\n\n", "\t", "\x1c", "\xa0", "　", "'s", "don't", "1", "22", "<|endoftext|>", "é", "é",
            "Σ", "ΑΣ", "😀", "!", "..", "\r\n", "\x85", "​", "中文", "ſ", "İ", "|", "▁", "<s>", "the ", "ing"]


def random_texts(n, seed=1):
    r = random.Random(seed)
    return ["".join(r.choice(ALPHABET) for _ in range(r.randint(0, 14))) for _ in range(n)]


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()]
    rows += [(10_000 + i, t) for i, t in enumerate(ODD_TEXTS)] + [(None, "no id"), (10_000, "again")]
    return rows


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_chunk_encoder_equals_whole_texts(name):
    enc = ChunkEncoder(tokenizer_path(name))
    assert enc.rule != "whole"
    texts = random_texts(4_000) + [t for t in ODD_TEXTS if t is not None]
    for col in (pa.array(texts), pa.array(texts, pa.large_string()).slice(7)):
        assert [x.tobytes() for x in enc.encode_column(col)] == enc._ids(col.to_pylist())
    assert len(enc.encode(None)) == 0 == len(enc.encode(""))


def test_chunk_store_is_bounded():
    enc = ChunkEncoder(tokenizer_path("byte_bpe_50k.json"), max_chunks=50)
    texts = [" ".join(f"w{i}x{j}" for j in range(20)) for i in range(40)]
    assert [x.tobytes() for x in enc.encode_column(pa.array(texts), at_once=3)] == enc._ids(texts)


def test_sentencepiece_parity_and_decoding():
    enc = SP.PieceEncoder(tokenizer_path("piece_bpe_32k.model"))
    texts = random_texts(3_000) + [t for t in ODD_TEXTS if t]
    ids, same, back = enc.encode_column(pa.array(texts))
    assert [i.tolist() for i in ids] == enc.reference.encode(texts) and all(same)
    assert back == [("▁" not in t) for t in texts]
    assert enc.decode(ids) == [t.replace("▁", " ") for t in texts]


def varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def message(*fields):
    out = b""
    for number, value in fields:
        if isinstance(value, bytes):
            out += varint(number << 3 | 2) + varint(len(value)) + value
        elif isinstance(value, float):
            import struct
            out += varint(number << 3 | 5) + struct.pack("<f", value)
        else:
            out += varint(number << 3) + varint(value)
    return out


@pytest.mark.parametrize("squeeze", [0, 1])
def test_sentencepiece_unigram_model(tmp_path, squeeze):
    """A hand-written unigram model with byte fallback."""
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)] + [(f"<0x{b:02X}>", -9.0, 6) for b in range(256)]
    pieces += [(p, -1.37 ** (i + 1), 1) for i, p in enumerate(["▁", "a", "b", "▁a", "ab", "▁ab", "aba", "ba", "c", "▁c"])]
    data = b"".join(message((1, message((1, p.encode()), (2, s), (3, t)))) for p, s, t in pieces)
    data += message((2, message((3, 1), (35, 1), (40, 0), (41, 1), (42, 2))))
    data += message((3, message((1, b"identity"), (3, 1), (4, squeeze))))
    path = tmp_path / "u.model"
    path.write_bytes(data)
    enc = SP.PieceEncoder(str(path))
    assert enc.cuts == (not squeeze)
    r = random.Random(3)
    texts = ["".join(r.choice("aabbc  d\né") for _ in range(r.randint(0, 25))) for _ in range(800)]
    ids, same, _ = enc.encode_column(pa.array(texts))
    assert sum(same) == len(texts)
    assert [i.tolist() for i in ids] == enc.reference.encode(texts)


def test_encode_documents(spark, corpus):
    got = SP.encode_documents(docs_frame(spark, corpus), tokenizer_path("piece_bpe_32k.model")).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in corpus)
    assert all(r.parity and r.decoded for r in got)
    assert {r.n_tokens for r in got if r.doc_id == 10_001} == {0}


def test_token_file_round_trip_and_damage():
    docs = [(5, np.arange(10, dtype="<u2").tobytes()), (None, b""), (7, np.arange(70_000).astype("<u2").tobytes())]
    f = io.BytesIO()
    assert write_token_file(f, docs, 2) == (3, 70_010)
    t = TokenFile(f, len(f.getvalue()))
    assert [(i, d) for _, i, d in t.documents(at_once=10)] == docs == [(i, t.document(k)) for k, (i, _) in enumerate(docs)]
    import zstandard  # any reader of the format sees the frames
    assert zstandard.ZstdDecompressor().stream_reader(io.BytesIO(f.getvalue()), read_across_frames=True).read() == b"".join(d for _, d in docs)
    raw = bytearray(f.getvalue())
    raw[int(t.starts[2]) + 40] ^= 1
    with pytest.raises(Exception):
        TokenFile(io.BytesIO(raw), len(raw)).document(2)
    assert TokenFile(io.BytesIO(raw), len(raw)).document(0) == docs[0][1]


def test_token_store(spark, corpus):
    path = tokenizer_path("word_bpe_49k.json")
    manifest = token_store.write_tokens(docs_frame(spark, corpus), Scratch(spark, "t4"), path, 1)
    got = token_store.read_tokens(manifest).collect()
    enc = ChunkEncoder(path)
    want = Counter((i, len(x) + 1, zlib.crc32(np.append(x, 1).astype("<u4").tobytes())) for i, t in corpus for x in [enc.encode(t)])
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    got.sort(key=lambda r: r.start)
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    assert [r.doc_id if r.doc_id is not None else -1 for r in got] == sorted(-1 if i is None else i for i, _ in corpus)
    file = manifest.orderBy("part").first().file
    assert len(token_store.read_documents(file, [1])[0]) == got[1].n_tokens
    assert token_store.read_tokens(token_store.write_tokens(docs_frame(spark, []), Scratch(spark, "t4"), path, 1)).count() == 0


def check_pieces(pieces, ids_of, window):
    by, seqs = defaultdict(list), defaultdict(list)
    for r in pieces:
        by[r.doc_id].append(r)
        seqs[r.sequence_id].append(r)
    for i, ids in ids_of.items():
        at = 0
        for r in sorted(by[i], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids)) and r.length > 0
            assert r.ids_crc32 == zlib.crc32(ids[at:at + r.length].astype("<u4").tobytes())
            at += r.length
        assert at == len(ids)
    padding = 0
    for rows in seqs.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= window
        padding += 0 if at & (at - 1) == 0 else window - at
    assert padding == 0 and sorted(seqs) == list(range(len(seqs)))


@pytest.mark.parametrize("window", [16, 1024])
def test_packing(spark, corpus, window):
    path = tokenizer_path("byte_bpe_50k.json")
    rows = [(i, t) for i, t in corpus if i not in (None, 10_000)]
    enc = ChunkEncoder(path)
    got = packing.pack(docs_frame(spark, rows), Scratch(spark, "t5"), path, 0, window).collect()
    check_pieces(got, {i: np.append(enc.encode(t), 0) for i, t in rows}, window)
    assert {"chunk", "combined", "loose"} >= {r.kind for r in got}


def test_packing_odd_tables(spark):
    path = tokenizer_path("byte_bpe_50k.json")
    assert packing.pack(docs_frame(spark, []), Scratch(spark, "t5"), path, 0).count() == 0
    got = packing.pack(docs_frame(spark, [(1, "a b"), (1, "a b"), (None, None)]), Scratch(spark, "t5"), path, 0).collect()
    assert Counter((r.doc_id, r.length) for r in got) >= Counter({(None, 1): 1}) and sum(r.length for r in got) == 7


def test_combinations_and_counts():
    hist = np.zeros(11, np.int64)
    hist[[2, 3, 5, 7, 8]] = [40, 30, 20, 30, 37]
    combos = packing.combinations(hist > 0, 10)
    assert {tuple(c) for c in combos.tolist()} == {(0, 2, 8), (0, 3, 7), (0, 5, 5), (2, 3, 5)}
    n = packing.whole_counts(combos, packing.fit_counts(combos, hist.astype(float)), hist)
    used = np.bincount(combos[combos > 0], weights=np.repeat(n, (combos > 0).sum(1)), minlength=11)
    assert (used <= hist).all() and used.sum() >= 0.9 * hist.sum()
    assert packing.Plan(np.zeros(11, np.int64), 10).combined == 0


def lz_ends(text):
    seen, i, out = set(), 0, []
    while i < len(text):
        j = i + 1
        while j <= len(text) and text[i:j] in seen:
            j += 1
        if j > len(text):
            break
        seen.add(text[i:j])
        out.append(j)
        i = j
    return out


def test_lz_parse_equals_plain_parse():
    r = random.Random(2)
    for _ in range(400):
        t = "".join(r.choice("ab😀c"[:r.randint(1, 4)]) for _ in range(r.randint(0, 60)))
        p = LZ.Parse()
        p.run(t, len(t) // 2)
        assert p.ends == lz_ends(t[:len(t) // 2])
        p.run(t, len(t))
        assert p.ends == lz_ends(t)


def test_phrase_hashes_do_not_depend_on_place_or_window(monkeypatch):
    text = "abracadabra abracadabra 😀" * 20
    ends = lz_ends(text)
    whole = LZ.phrase_hashes(text, ends)
    phrases = [text[a:b] for a, b in zip([0] + ends, ends)]
    assert len(set(whole.tolist())) == len(set(phrases))
    moved = "zzq" + text
    assert set(LZ.phrase_hashes(moved, [3] + [e + 3 for e in ends], 1).tolist()) == set(whole.tolist())
    monkeypatch.setattr(LZ, "_WINDOW", 7)
    assert LZ.phrase_hashes(text, ends).tolist() == whole.tolist()


def test_fingerprints(spark, corpus):
    rows = [(i, t) for i, t in corpus if i != 10_000]
    got = {r.doc_id: r for r in LZ.fingerprints(docs_frame(spark, rows)).collect()}
    order = sorted(((i is not None, i or 0), t or "", i) for i, t in rows)
    sig = lambda t: LZ.signature(LZ.phrase_hashes(t, lz_ends(t)))
    for k, (_, t, i) in enumerate(order):
        nxt = order[(k + 1) % len(order)][1]
        n = len(t)
        edited = t[:n - n // 2] + nxt[:n // 2]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (n, hashlib.sha256(edited.encode()).hexdigest())
        a, b, c = sig(t), sig(edited), sig(nxt)
        assert (r.fingerprint, r.edited_fingerprint) == (LZ._text(a), LZ._text(b))
        assert (r.near_edited, r.near_next) == (LZ.likeness(a, b), LZ.likeness(a, c))


def test_fingerprints_odd_tables(spark):
    assert LZ.fingerprints(docs_frame(spark, [])).count() == 0
    one = LZ.fingerprints(docs_frame(spark, [(3, "abab")])).first()
    assert (one.near_next, one.near_edited) == (1.0, 1.0)  # a lone document is its own next
    two = LZ.fingerprints(docs_frame(spark, [(3, "ab"), (3, "ab"), (4, None)])).collect()
    assert len(two) == 3 and len({r.fingerprint for r in two if r.doc_id == 3}) == 1


def test_likeness_estimates_shared_phrases():
    r = np.random.default_rng(0)
    pool = r.integers(0, 1 << 63, 4000, dtype=np.uint64)
    a, b = LZ.signature(pool[:3000]), LZ.signature(pool[1000:])
    assert abs(LZ.likeness(a, b) - 0.5) < 0.2
    few = pool[:9]
    assert LZ.likeness(LZ.signature(few[:6]), LZ.signature(few[3:])) == 3 / 9


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(map(int, str(2 * int(c)))) for i, c in enumerate(d[::-1])) % 10 == 0


def base_spans(text):
    t, out = text or "", []
    out += [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        if 13 <= len(d) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return out


PII_TEXTS = [
    "a@b.c%x@d.com a@b.c@d.e.f 1.2.3.4.5.6.7.8 256.1.1.1 0000255.1.1.01 +1 (262) 555-3752 +1 ((((  4242424242424242 4242-4242-4242-4242x",
    "😀😀 x@y.zz 😀 +123456789 ﷐ 1.1.1.1", " ".join("+1234567890%d" % (i % 10) for i in range(1000)), "1" * 50_000, "a" * 50_000, "x.y@" * 3000,
    "a@b.c.@d.e", "..@..", "a@-.-", "+1+2345678901", "4111 1111 1111 1111 1", "5500-0000-0000-0004."]


def test_pii_equals_brute_force(spark, corpus):
    rows = [(i, t) for i, t in corpus if i not in (None, 10_000)] + [(20_000 + i, t) for i, t in enumerate(PII_TEXTS)]
    r = random.Random(5)
    rows += [(30_000 + i, "".join(r.choice(["1", "25", ".", "@", "a", "+", "-", " ", "(", "4111111111111111", "b.c"]) for _ in range(r.randint(1, 40))))
             for i in range(1500)]
    got = {x.doc_id: x for x in pii.pii_digest(docs_frame(spark, rows)).collect()}
    for i, t in rows:
        want = base_spans(t)
        text = ",".join("%s:%d:%d" % s for s in want)
        x = got[i]
        assert x.base_sha256 == hashlib.sha256(text.encode()).hexdigest(), (i, t[:200], x.spans[:300], text[:300])
        assert (x.n_email, x.n_ip, x.n_card, x.n_phone) == tuple(sum(s[0] == k for s in want) for k in pii.BASE_KINDS)


def test_pii_checksums_and_context(spark):
    rows = [(1, "IBAN GB82 WEST 1234 5698 7654 32 please"), (2, "GB82WEST12345698765433"), (3, "my ssn is 123-45-6789"),
            (4, "part 123-45-6789"), (5, "ssn 666-45-6789"), (6, "mail me: a@b.co"), (7, "x a@b.co")]
    got = {r.doc_id: r.pii for r in pii.find_pii(docs_frame(spark, rows)).collect()}
    assert [(s.kind, s.start, s.end) for s in got[1]] == [("iban", 5, 32)]
    assert [s.kind for s in got[3]] == ["ssn"] and not got[2] and not got[4] and not got[5]
    assert got[6][0].score > got[7][0].score >= pii.THRESHOLD


def test_pii_redaction_and_clashing_columns(spark):
    df = docs_frame(spark, [(1, "a@b.co and 1.2.3.4, 4111 1111 1111 1111 1"), (2, None), (3, "clean \x01"), (4, "")])
    odd = df.selectExpr("doc_id", "text", "text AS _t", "1 AS pii", "2 AS `a.b`", "3 AS _row")
    got = {r.doc_id: r.text for r in pii.redact_pii(odd).collect()}
    assert got == {1: "[EMAIL] and [IP], 4111 1111 1111 1111 1", 2: None, 3: "clean \x01", 4: ""}
    found = pii.find_pii(odd)
    assert found.columns == ["doc_id", "text", "_t", "a.b", "_row", "pii"] and found.count() == 4
    assert pii.pii_digest(df.limit(0)).count() == 0


def test_pii_uses_no_python(spark):
    plan = pii.pii_digest(docs_frame(spark, [(1, "a")]))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_word_hashes_equal_words(monkeypatch):
    texts = random_texts(600, 9) + [t for t in ODD_TEXTS]
    from admitflow.llm import textkernel
    for window in (1 << 22, 64):
        monkeypatch.setattr(textkernel, "_WINDOW", window)
        hashes, first = word_hashes(*text_buffer(pa.array(texts)))
        flat = [w for t in texts for w in words(t)]
        assert len(hashes) == len(flat) and [len(words(t)) for t in texts] == np.diff(first).tolist()
        assert len(set(zip(hashes.tolist(), flat))) == len(set(flat)) == len(set(hashes.tolist()))


def test_ranges(spark):
    df = spark.range(1000).withColumnRenamed("id", "k")
    bounds = range_bounds(df, "k", 7)
    sizes = df.groupBy(bucket_of(F.col("k"), bounds).alias("b")).count().collect()
    assert len(sizes) == 7 and max(r["count"] for r in sizes) < 200
    assert range_bounds(df.limit(0), "k", 7) == [] == range_bounds(df, "k", 1)
    for n in (1, 2, 3, 7, 8, 100):
        cuts = sorted({random.Random(n).randrange(-5, 1000) for _ in range(n)})
        got = df.select("k", bucket_of(F.col("k"), cuts).alias("b")).collect()
        assert [r.b for r in got] == [bisect.bisect_right(cuts, r.k) for r in got]
    assert df.select(bucket_of(F.lit(None).cast("long"), [3, 5]).alias("b")).first().b == 0
