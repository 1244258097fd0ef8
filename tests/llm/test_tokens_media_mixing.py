from __future__ import annotations

import hashlib
import json
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from plumeria.llm import bpe, matroska, mixing, token_files
from tests.llm.test_dedup_jaccard import SCHEMA, documents

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [
    None, "", " ", "\n", "Hello, world! It's 3.5 o'clock\n\n  yes", "aaaa" * 50, "日本語のテキスト 😀 é", "a <|endoftext|> b", "tab\tand\x0bmore  \r\n x",
    "x" * 5000, "word " * 2000, "a\n\n\n b", " lead", "trail ", "it'll\xa0do so", "a\n<|endoftext|>\nb", "\x1c\x1d odd \x85",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@given(st.lists(st.sampled_from([*"ab '\n\t!é日<|>9.", "the", "'ll", "<|endoftext|>", "\xa0", "  "]), max_size=40).map("".join))
@settings(max_examples=300, deadline=None)
def test_both_encoders_equal_the_library(text):
    want = Tokenizer.from_file(PATH) if not hasattr(test_both_encoders_equal_the_library, "t") else test_both_encoders_equal_the_library.t
    test_both_encoders_equal_the_library.t = want
    ids = want.encode(text, add_special_tokens=False).ids
    model, own = bpe.load(PATH)
    got, counts = own(["x", text, "y"])
    assert got[counts[0] : counts[0] + counts[1]].tolist() == ids
    assert model.decode(got[counts[0] : counts[0] + counts[1]], counts[1:2])[0].decode() == text
    got, counts = token_files.library(PATH)[0](["x", text])
    assert got[counts[0] :].tolist() == ids


def test_round_trip_query(spark, library):
    rows = list(enumerate(TEXTS)) + [(None, "z"), (3, "again")]
    found = bpe.round_trip(documents(spark, rows), PATH).collect()
    assert len(found) == len(rows)
    for x in found:
        if x.doc_id not in (None, 3):
            ids = library.encode(TEXTS[x.doc_id] or "", add_special_tokens=False).ids
            assert x.n_tokens == len(ids)
            assert x.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
            assert x.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.round_trip(documents(spark, []), PATH).count() == 0


def test_encode_and_decode_tables(spark):
    rows = list(enumerate(TEXTS))
    back = bpe.decode(bpe.encode(documents(spark, rows), PATH), PATH).collect()
    assert {x.doc_id: x.text for x in back} == {i: t or "" for i, t in rows}


def test_token_files(spark, library):
    rows = [(i * 3, t) for i, t in enumerate(TEXTS * 4)]
    files = token_files.write_token_files(documents(spark, rows).repartition(3), PATH, shard_docs=10)
    assert files.select("shard").distinct().count() > 2
    found = {x.doc_id: x for x in token_files.read_documents(files).collect()}
    start = 0
    for i, text in rows:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        assert (found[i].start, found[i].n_tokens) == (start, len(ids))
        assert found[i].ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    assert token_files.read_documents(token_files.write_token_files(documents(spark, []), PATH)).count() == 0


def test_token_files_of_17_bits_and_odd_rows(spark, library):
    """An end id beyond 16 bits makes 17-bit ids; one repeated id, null ids, null texts and clashing names."""
    rows = [(7, t) for t in TEXTS * 3] + [(None, "a b"), (None, None), (3, "x " * 9000), (-5, "")]
    df = documents(spark, rows).withColumn("shard", F.lit("s")).withColumn("bits", F.lit(1)).repartition(4)
    files = token_files.write_token_files(df, PATH, end_id=100_000, shard_docs=5)
    assert {x.bits for x in files.select("bits").distinct().collect()} == {17}
    found = sorted(token_files.read_documents(files).collect(), key=lambda x: x.start)
    assert [x.doc_id for x in found] == [None, None, -5, 3] + [7] * (3 * len(TEXTS))
    want = sorted((str(i), zlib.crc32(np.array([*library.encode(t or "", add_special_tokens=False).ids, 100_000], "<u4").tobytes())) for i, t in rows)
    assert sorted((str(x.doc_id), x.ids_crc32) for x in found) == want
    assert [x.start for x in found] == np.cumsum([0, *(x.n_tokens for x in found)])[:-1].tolist()


@pytest.mark.parametrize("change", [{"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True}}])
def test_other_vocabularies_are_refused(tmp_path, change):
    with open(PATH, encoding="utf-8") as file:
        content = json.load(file) | change
    path = tmp_path / "other.json"
    path.write_text(json.dumps(content))
    with pytest.raises(ValueError, match="not covered"):
        bpe.ByteBPE(str(path))


@given(st.integers(1, 20), st.lists(st.integers(0, 2**20 - 1), min_size=1, max_size=200), st.data())
@settings(max_examples=100, deadline=None)
def test_packing(bits, ids, data):
    ids = np.array(ids, np.uint32) % (1 << bits)
    packed = token_files.pack(ids, bits)
    assert len(packed) == (len(ids) * bits + 7) // 8
    a = data.draw(st.integers(0, len(ids)))
    n = data.draw(st.integers(0, len(ids) - a))
    assert token_files.unpack(packed, bits, a, n).tolist() == ids[a : a + n].tolist()


def test_bits():
    assert [token_files.bits_for(n) for n in (1, 2, 3, 256, 257, 50257, 65536, 65537)] == [1, 1, 2, 8, 9, 16, 16, 17]


def test_media_features(spark):
    rows = list(enumerate([*TEXTS, "a" * 63, "a" * 64, "a" * 65, "b" * 70_000])) + [(900, "Hello"), (901, "Hello")]
    media = matroska.media_column(documents(spark, rows))
    found = {x.doc_id: x for x in matroska.media_features(media).collect()}
    for i, text in rows:
        raw = (text or "").encode()
        payload = raw + bytes(-len(raw) % 64 or (64 if not raw else 0))
        x = found[i]
        assert (x.n_bytes, x.payload_bytes) == (len(raw), len(payload))
        assert x.payload_sha256 == hashlib.sha256(payload).hexdigest()
        assert x.tail_crc32 == zlib.crc32(payload[-64:])
        assert "cued=1" in x.feature
    assert found[900][3:] == found[901][3:]
    packets = matroska.packet_table(media).where("doc_id = 900").collect()
    assert [(p.timestamp_ns, p.size, p.lacing) for p in packets] == [(0, 64, "none")]
    assert matroska.media_features(matroska.media_column(documents(spark, []))).count() == 0


@given(st.binary(min_size=1, max_size=3000), st.sampled_from(["none", "xiph", "ebml"]), st.integers(1, 9), st.booleans())
@settings(max_examples=150, deadline=None)
def test_lacings_and_unknown_sizes(payload, lacing, parts, unknown):
    cuts = sorted(random.Random(len(payload)).choices(range(len(payload) + 1), k=parts - 1)) if lacing != "none" else []
    frames = [payload[a:b] for a, b in zip([0, *cuts], [*cuts, len(payload)], strict=True)]
    body = matroska.element(matroska.TIMESTAMP, b"\x05") + matroska.block(1, 7, frames, lacing)
    head = b"\x01" + b"\xff" * 7
    cluster = matroska.CLUSTER.to_bytes(4, "big") + (head + body if unknown else matroska.vint(len(body)) + body)
    content = cluster + cluster
    data = matroska.element(matroska.EBML, b"") + matroska.SEGMENT.to_bytes(4, "big") + (head if unknown else matroska.vint(len(content))) + content
    found = matroska.parse(data)["packets"]
    assert len(found) == 2 * len(frames)
    assert b"".join(data[p[2] : p[2] + p[3]] for p in found) == payload * 2
    assert found[0][1] == 12_000_000
    assert {p[5] for p in found} == {lacing}


def test_key_frames_of_block_groups():
    """A block of a group is a key frame unless the group refers to another block, wherever the reference stands."""
    m = matroska
    inside = m.vint(1) + b"\x00\x01\x00" + b"frame"
    plain, refers = m.element(m.BLOCK, inside), m.element(m.REFERENCE_BLOCK, b"\x01")
    groups = [plain, plain + refers, refers + plain, plain]
    body = m.element(m.TIMESTAMP, b"\x00") + b"".join(m.element(m.BLOCK_GROUP, x) for x in groups)
    data = m.element(m.EBML, b"") + m.element(m.SEGMENT, m.element(m.CLUSTER, body))
    assert [x[4] for x in m.parse(data)["packets"]] == [True, False, False, True]


def test_damaged_media_is_refused():
    data = matroska.write_media(b"x" * 640)
    with pytest.raises((ValueError, IndexError)):
        matroska.parse(data[:-30])


def mixed(spark, rows):
    df = spark.createDataFrame([(i, t, "en", s, 0) for i, t, s in rows], SCHEMA).withColumn("key", F.lit(9)).withColumn("size", F.lit("x"))
    documents_, pieces = mixing.mix(df, block_words=7)
    return {x.doc_id: x for x in documents_.collect()}, pieces.collect()


def test_mixing(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(["w"] * rng.randint(0, 60)), rng.choice(["a", "b", "b", "b", "b", "B", None, "ü"])) for i in range(300)]
    rows += [(300, None, "a"), (301, "one", "tiny"), (302, "w " * 4000, "b"), (303, "", "empty")]
    found, pieces = mixed(spark, rows)
    sizes = {i: len((t or "").split()) for i, t, _ in rows}
    order = sorted({s for _, _, s in rows}, key=lambda s: (s is None, (s or "").encode()))
    total = {s: sum(sizes[i] for i, _, o in rows if o == s) for s in order}
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    goal, open_, target = 1.5 * sum(total.values()), set(order), {}
    while True:  # reshare what is above the caps
        share = {s: goal * weight[s] / sum(weight[o] for o in open_) for s in open_}
        above = {s for s in open_ if share[s] > 2 * total[s]}
        if not above:
            target |= share
            break
        for s in above:
            target[s] = 2.0 * total[s]
            goal -= target[s]
        open_ -= above
    for i, _, s in rows:
        x = found[i]
        assert (x.size, x.source_size) == (sizes[i], total[s])
        assert x.target == pytest.approx(target[s])
        assert x.taken <= 2 * x.size
    for s in order:
        assert sum(found[i].taken for i, _, o in rows if o == s) == pytest.approx(target[s], abs=1)
    # The mix keeps to the shares all along, and a rerun is the same.
    half = sorted(pieces, key=lambda p: p.slot)[: len(pieces) // 2]
    words, big = sum(p.end - p.begin for p in half), sum(p.end - p.begin for p in half if p.key == "=b")
    assert big / words == pytest.approx(target["b"] / sum(target.values()), abs=0.05)
    assert {k: v.taken for k, v in mixed(spark, rows)[0].items()} == {k: v.taken for k, v in found.items()}


def test_mixing_of_empty_tables(spark):
    assert mixed(spark, []) == ({}, [])
    found, _ = mixed(spark, [(1, "", "a"), (2, None, None)])
    assert [(x.size, x.target, x.taken) for x in found.values()] == [(0, 0.0, 0), (0, 0.0, 0)]


def test_mixed_documents(spark):
    df = spark.createDataFrame([(i, "w " * 20, "en", "ab"[i % 2], 40) for i in range(40)], SCHEMA)
    out = mixing.mixed_documents(df)
    assert out.columns == df.columns
    counts = {x.doc_id: x["count"] for x in out.groupBy("doc_id").count().collect()}
    assert set(counts.values()) <= {1, 2}
    assert sum(counts.values()) == pytest.approx(60, abs=1)
