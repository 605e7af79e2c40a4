from __future__ import annotations

import hashlib
import struct

import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import pieces
from tessera.llm.common import read

MODEL = public_tokenizers.path("piece_bpe_32k.model")
SF = "/root/testdata/sf0.001"


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list(" ▁\n\tabcé①𝒳ﬁ.<|>s")), max_size=60))
def test_ids_and_spans_of_any_text(text):
    codec = pieces.codec(MODEL)
    made = codec.encode(text)
    assert made.ids == codec.model.encode(text)
    data = text.encode()
    assert all(0 <= a <= b <= len(data) for a, b in zip(made.starts, made.ends, strict=True))
    for i, a, b in zip(made.ids, made.starts, made.ends, strict=True):
        shown = codec.model.id_to_piece(i)
        if shown.startswith("<0x"):
            assert data[a:b] == bytes([int(shown[3:5], 16)])
        elif len(made.ids) and a < b:
            assert data[a:b].decode().replace(" ", "▁") in (shown, shown[1:])


def test_long_texts_are_cut_without_a_trace():
    codec = pieces.codec(MODEL)
    text = ("Some words  and\n more   of them, é①  " * 4000) + "  "
    made = codec.encode(text)
    assert made.ids == codec.model.encode(text) and codec.decode(made.ids) == codec.model.decode(codec.model.encode(text))
    assert made.ends[-1] == len(text.encode())


def test_character_map_takes_the_longest_prefix():
    # a double array for "a" -> "x" and "ab" -> "yz", laid out by hand
    units = [0] * 1024
    base = lambda offset, leaf=False: (offset << 10) | (256 if leaf else 0)
    units[0] = base(256)
    at_a = 256 ^ ord("a")
    units[at_a] = ord("a") | base(512, True)
    leaf_a = at_a ^ 512
    units[leaf_a] = (1 << 31) | 0
    at_ab = leaf_a ^ ord("b")
    units[at_ab] = ord("b") | base(768 ^ 512, True)
    units[at_ab ^ (768 ^ 512)] = (1 << 31) | 2
    blob = struct.pack("<I", 4096) + struct.pack("<1024I", *units) + b"x\0yz\0"
    table = pieces.CharsMap(blob)
    assert table.longest(b"abc", 0) == (2, b"yz")
    assert table.longest(b"ac", 0) == (1, b"x")
    assert table.longest(b"c", 0) is None
    spec = pieces.NormalizerSpec(blob, dummy_prefix=True, strip_spaces=True)
    text, start, end = pieces.Normalizer(spec).run(b"  ab  a ")
    assert text.decode() == "▁yz▁x"
    assert (start[3], end[3], start[4], end[4]) == (2, 4, 2, 4)
    assert (start[8], end[8]) == (6, 7)


def test_walk_equals_the_plain_path():
    plain = pieces.Normalizer(pieces.NormalizerSpec(b"", True, False))
    for text in ("a b", " é  x ", "▁q", "\n"):
        a, b = plain._plain(text.encode()), plain._walk(text.encode())
        assert a[0] == b[0] and len(a[0]) == len(a[1]) == len(b[1])


def test_query_on_edge_rows(spark):
    rows = [(1, None, [9]), (2, "", None), (3, "a b", [1]), (3, "a b", [1]), (None, "x", None), (4, "é " * 30_000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids array<int>")
    got = {(r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in pieces.encoding_digests(docs, MODEL).collect()}
    codec, sha = pieces.codec(MODEL), lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = set()
    for d, text, _ in rows:
        ids = codec.model.encode(text or "")
        want.add((d, len(ids), sha(",".join(map(str, ids))), sha(codec.model.decode(ids))))
    assert got == want
    back = pieces.decode_documents(pieces.encode_documents(docs, MODEL), MODEL)
    assert back.columns == ["doc_id", "text", "ids", "starts", "ends", "decoded"]
    assert all(r["decoded"] == (r["text"] or "") for r in back.collect())
    assert pieces.encoding_digests(docs.limit(0), MODEL).collect() == []


def test_whole_table(spark):
    docs = read(spark, SF, "documents")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    model = pieces.codec(MODEL).model
    for r in pieces.encoding_digests(docs, MODEL).collect():
        ids = model.encode(texts[r["doc_id"]])
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(model.decode(ids).encode()).hexdigest()
        assert r["covered_bytes"] == len(texts[r["doc_id"]].encode())
