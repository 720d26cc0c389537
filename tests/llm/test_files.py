"""Round trips through token files and archives."""

import io
import itertools
import struct
import zipfile
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ringfold.llm.archives import ZipDirectory, page_records, read_archives, write_archives
from ringfold.llm.token_blocks import (
    IdFileReader,
    IdFileWriter,
    TextEncoder,
    pack_block,
    read_token_files,
    unpack_block,
    write_token_files,
)

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


class Source(io.BytesIO):
    def size(self):
        return len(self.getbuffer())


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 50_256), st.integers(0, 2**32 - 1)), max_size=80), st.sampled_from([0, 50, 90, 100]))
def test_block_round_trip(ids, percentile):
    ids = np.array(ids, np.uint32)
    assert (unpack_block(pack_block(ids, percentile)) == ids).all()


def test_file_ranges():
    rng = np.random.default_rng(0)
    docs = [(i * 3, rng.integers(0, 50_257, n).astype(np.uint32)) for i, n in enumerate([1, 0, 70, 33, 1, 200])] + [(None, np.zeros(1, np.uint32))]
    out = Source()
    writer = IdFileWriter(out, block_ids=16)
    for doc, ids in docs:
        writer.add(doc, ids)
    writer.close()
    reader = IdFileReader(out)
    everything = np.concatenate([ids for _, ids in docs])
    for a, b in [(0, 1), (5, 5), (15, 17), (0, len(everything)), (100, 305)]:
        assert (reader.ids(a, b) == everything[a:b]).all()
    got = list(reader.documents(most_ids=40))
    assert [(d, i.tolist()) for d, _, i in got] == [(d, i.tolist()) for d, i in docs]
    with pytest.raises(ValueError):
        IdFileReader(Source(b"x" * 100))


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(TOKENIZER)
    return lambda t: tokenizer.encode(t, add_special_tokens=False).ids


@pytest.fixture(scope="module")
def encoder():
    return TextEncoder(TOKENIZER)


PARTS = ["a", " ", "  ", "\n", "word", "don't", "'s", ",", "été", "12", " ", "　", "​", "<|endoftext|>", "日本", "\t", "é", "²", "\x1c"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=14))
def test_encoder_equals_the_tokenizer(encoder, plain, parts):
    text = "".join(parts)
    assert np.frombuffer(encoder(text), "<u4").tolist() == plain(text)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=14))
def test_encoder_knows_added_tokens(encoder, plain, parts):
    for text in ("".join(parts), "".join([*parts, "<|endoftext|>", *parts[::-1]])):
        assert np.frombuffer(encoder(text), "<u4").tolist() == plain(text)


def test_encoder_remembers_few_words(plain):
    """More words than are remembered take no more memory, and have the same ids."""
    encoder = TextEncoder(TOKENIZER, remembered=64)
    names = ["".join(p) for p in itertools.product("abcdé", repeat=4)]
    text = " ".join(f"{n}{'.' * (i % 40)}" for i, n in enumerate(names * 2))
    assert np.frombuffer(encoder(text), "<u4").tolist() == plain(text)
    words = encoder._words
    assert len(words) <= 64 and len(words._older) <= 64 and len(words._tails) <= 8


def test_pipeline_remembers_fewer_words(spark, monkeypatch):
    import corpus_pipeline
    from ringfold.llm import token_blocks

    asked = []
    monkeypatch.setattr(corpus_pipeline, "write_token_files", lambda *_, remembered: asked.append(remembered))
    monkeypatch.setattr(corpus_pipeline, "read_token_files", lambda files: files)
    corpus_pipeline.tokens(spark, None, "")
    assert 0 < asked[0] * 4 < token_blocks.REMEMBERED_WORDS


def test_token_files_of_added_tokens(spark, plain):
    texts = ["hello <|endoftext|> world", "hello world", "<|endoftext|><|endoftext|>", "a <|endoftext|"]
    got = read_token_files(write_token_files(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), TOKENIZER, 2))
    at, want = 0, []
    for doc, text in enumerate(texts):
        ids = [*plain(text), 2]
        want.append((doc, at, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        at += len(ids)
    assert plain(texts[0]) == [31373, 220, 50256, 995]
    assert sorted(map(tuple, got.collect())) == want


def test_token_files(edge_docs, edge_rows, plain):
    got = read_token_files(write_token_files(edge_docs, TOKENIZER, 2, block_ids=64)).collect()
    at, want = 0, []
    for doc, text in sorted((r[:2] for r in edge_rows), key=lambda r: (r[0] is not None, r[0], r[1] is not None, r[1])):
        ids = [*plain(text or ""), 2]
        want.append((doc, at, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        at += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want


def test_no_token_files(no_docs):
    assert read_token_files(write_token_files(no_docs, TOKENIZER, 2)).count() == 0


@pytest.mark.parametrize("comment", [b"", b"PK\x05\x06 a comment"])
def test_zip_directory(comment):
    out = Source()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("packed.txt", "a" * 500, zipfile.ZIP_DEFLATED)
        with z.open("wide.bin", "w", force_zip64=True) as f:
            f.write(b"wide")
        z.writestr("plain.bin", b"plain")
    directory = ZipDirectory(out)
    assert set(directory.members) == {"packed.txt", "wide.bin", "plain.bin"}
    assert directory.read("wide.bin") == b"wide" and directory.read("plain.bin") == b"plain"
    with pytest.raises(ValueError):
        directory.read("packed.txt")


def test_zip64_directory():
    """All positions in ZIP64 fields, as in archives beyond 4 GiB."""
    name, body = b"a.bin", b"payload"
    local = struct.pack("<4s5H3L2H", b"PK\x03\x04", 45, 0, 0, 0, 0, 0, 2**32 - 1, 2**32 - 1, len(name), 20)
    local += name + struct.pack("<2H2Q", 1, 16, len(body), len(body)) + body
    extra = struct.pack("<2H1s", 9, 1, b"x") + struct.pack("<2H3Q", 1, 24, len(body), len(body), 0)
    entry = struct.pack("<4s6H3L5H2L", b"PK\x01\x02", 45, 45, 0, 0, 0, 0, 0, 2**32 - 1, 2**32 - 1, len(name), len(extra), 0, 0, 0, 0, 2**32 - 1)
    entry += name + extra
    end64 = struct.pack("<4sQ2H2L4Q", b"PK\x06\x06", 44, 45, 45, 0, 0, 1, 1, len(entry), len(local))
    locator = struct.pack("<4sLQL", b"PK\x06\x07", 0, len(local) + len(entry), 1)
    end = struct.pack("<4s4H2LH", b"PK\x05\x06", 0, 0, 0xFFFF, 0xFFFF, 2**32 - 1, 2**32 - 1, 0)
    directory = ZipDirectory(Source(local + entry + end64 + locator + end))
    assert directory.read("a.bin") == body
    with pytest.raises(ValueError):
        ZipDirectory(Source(b"no zip file" * 10))


def test_archives(spark):
    long, other = "<p>é</p>" * 300, "x" * 1000
    rows = [
        (1, "http://a/\r\nX: y", long), (7, None, long), (3, "http://b/", long), (4, "u", other), (5, "u", "short"), (6, "u", "short"),
        (8, "u", None), (9, "u", ""), (None, "u", other), (7, "again", long), (10, "u", "a\r\n\r\nb"),
    ]
    pages = spark.createDataFrame([(*r, "extra") for r in rows], "page_id long, url string, html string, digest string")
    records = read_archives(write_archives(pages))
    bodies = {r.record_id: bytes(r.payload) for r in records.where("record_type = 'response'").collect()}
    assert bodies["<urn:page:10>"] == b"a\r\n\r\nb" and bodies["<urn:page:8>"] == b"" and bodies["<urn:page:7>"] == long.encode()
    got = {(r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in page_records(records).collect()}
    n = len(long.encode())
    assert got == {
        (1, n, "revisit", 7), (7, n, "response", None), (3, n, "revisit", 7), (4, 1000, "response", None), (5, 5, "response", None),
        (6, 5, "response", None), (8, 0, "response", None), (9, 0, "response", None), (None, 1000, "revisit", 4), (10, 6, "response", None),
    }
    assert records.count() == len(rows)


def test_no_archives(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert page_records(read_archives(write_archives(pages))).count() == 0
