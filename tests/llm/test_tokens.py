"""BPE, token store and media: exact against the library, exact round trips."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tessera.llm import bpe, media, token_store
from tessera.llm.queries import vocabulary
from tokenizers import Tokenizer

PATH = vocabulary()
LIBRARY = Tokenizer.from_file(PATH)
CODEC = bpe.Codec(PATH)
ENCODER = token_store.LibraryEncoder(PATH)
PIECES = ["a", "th", "the", "The", "'s", "'RE", ".", ",", " ", "\n", "é", "É", "ß", "1", "½", "$", "_", "<|", "<|endoftext|>", "Σ", "ς", "и", "你", "́", "😀", "\x1c", "ª", "İ", "ı", "ŉ"]


def encoded(text: str) -> list[int]:
    return LIBRARY.encode(text, add_special_tokens=False).ids


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(max_size=40), st.lists(st.sampled_from(PIECES), max_size=16).map("".join)))
def test_encoding_and_decoding_as_the_library(text):
    ids = encoded(text)
    mine = CODEC.encode(text)
    assert np.frombuffer(mine, "<u4").tolist() == ids
    assert CODEC.decode(mine).decode() == LIBRARY.decode(ids, skip_special_tokens=False)
    assert np.frombuffer(ENCODER.encode([text])[0], "<u4").tolist() == ids
    assert CODEC.restores(text, mine) and not CODEC.restores(text, mine + mine[-4:] + CODEC.encode("b"))


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="abcdeghinorst", min_size=1, max_size=60))
def test_backtracking_on_long_words(word):
    assert np.frombuffer(CODEC.encode(word), "<u4").tolist() == encoded(word)


def test_whole_documents(documents):
    texts = [r[0] for r in documents.select("text").collect()]
    store = token_store.LibraryEncoder(PATH).encode(texts)
    for text, theirs in zip(texts, store, strict=True):
        ids = encoded(text)
        assert np.frombuffer(CODEC.encode(text), "<u4").tolist() == ids == np.frombuffer(theirs, "<u4").tolist()


def test_bpe_rows(odd_docs, no_docs):
    rows = bpe.round_trip_digests(odd_docs, PATH).collect()
    texts = {(r["doc_id"]): r["text"] for r in odd_docs.collect()}
    assert len(rows) == odd_docs.count()
    for r in rows:
        ids = encoded(texts[r["doc_id"]] or "")
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(LIBRARY.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.round_trip_digests(no_docs, PATH).count() == 0
    both = bpe.decode_ids(bpe.encode_texts(odd_docs, PATH), PATH).collect()
    assert {r["doc_id"]: r["decoded"] for r in both} == {i: LIBRARY.decode(encoded(t or ""), skip_special_tokens=False) for i, t in texts.items()}


def test_memos_are_bounded_in_bytes():
    from tessera.llm.common import Cache

    made = []
    memo = Cache(lambda k: made.append(k) or k * 2, 1000, 64_000)
    for k in range(5000):
        assert memo[f"w{k}"] == f"w{k}" * 2
        assert memo.held <= 64_000 and len(memo) <= 1000
    long = "x" * 10_000
    assert memo[long] == memo[long] == long * 2 and long not in memo and made.count(long) == 2
    assert memo["w4999"] and made.count("w4999") == 1


@settings(max_examples=80, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 2**32 - 1), st.integers(0, 70_000), st.integers(0, 255)), max_size=1500))
def test_every_code_is_addressable(ids):
    shard = token_store.Shard(token_store.pack(np.array(ids, np.uint32)))
    assert len(shard) == len(ids) and shard.all().tolist() == ids
    assert [shard[i] for i in range(len(ids))] == ids
    with pytest.raises(IndexError):
        shard[len(ids)]


def test_token_store(spark, odd_docs, no_docs):
    shards = token_store.write_tokens(odd_docs, PATH, shard_tokens=5)
    rows = token_store.read_documents(shards).orderBy("start").collect()
    assert [r["doc_id"] for r in rows] == [None, 900, 901, 902, 903, 904, 905, 905, 906, 907]
    texts = {r["doc_id"]: r["text"] for r in odd_docs.collect()}
    at = 0
    for r in rows:
        ids = [*encoded(texts[r["doc_id"]] or ""), 1]
        assert r["start"] == at and r["n_tokens"] == len(ids) and np.frombuffer(r["token_ids"], "<u4").tolist() == ids
        at += len(ids)
    digests = {(r["doc_id"], r["start"]): r["ids_crc32"] for r in token_store.stored_digests(shards).collect()}
    assert digests == {(r["doc_id"], r["start"]): zlib.crc32(bytes(r["token_ids"])) for r in rows}
    assert token_store.stored_digests(token_store.write_tokens(no_docs, PATH)).count() == 0


@pytest.mark.parametrize("colour", list(media.CHANNELS))
def test_png_filters(colour):
    rng, bpp = np.random.default_rng(colour), media.CHANNELS[colour]
    samples = rng.integers(0, 256, (23, 16 * bpp)).astype(np.uint8)
    for kinds in (*range(5), rng.integers(0, 5, 23)):
        back, n = media.read_png(media.write_png(samples.tobytes(), width=16, colour=colour, kinds=kinds))
        assert n == bpp and (back == samples).all()


def test_png_that_is_not_what_it_says():
    png = media.write_png(bytes(range(192)))
    for broken in (png[:-1], b"x" + png[1:], png[:40] + bytes([png[40] ^ 1]) + png[41:], png[:20], png.replace(b"IEND", b"IENX")):
        with pytest.raises(media.MediaError):
            media.read_png(broken)


def test_cosine_hash_is_a_transform():
    rng = np.random.default_rng(0)
    samples = rng.integers(0, 256, (32, 32)).astype(np.uint8)
    grey = samples.astype(float)
    low = np.array([[sum(grey[y, x] * np.cos(np.pi * (2 * y + 1) * u / 64) * np.cos(np.pi * (2 * x + 1) * v / 64) for y in range(32) for x in range(32)) for v in range(8)] for u in range(8)]).ravel()
    bits = low > np.median(low[1:])
    bits[0] = False
    assert media.cosine_hash(samples, 1) == np.packbits(bits).tobytes().hex()
    assert media.shrunk(np.ones((1, 64))).shape == (32, 32)


def test_media_rows(odd_docs, no_docs):
    rows = media.media_features(media.store_media(odd_docs)).collect()
    texts = {r["doc_id"]: r["text"] or "" for r in odd_docs.collect()}
    for r in rows:
        data = texts[r["doc_id"]].encode()
        full = data + b" " * (-len(data) % 192 if data else 192)
        assert (r["n_bytes"], r["payload_bytes"]) == (len(data), len(full))
        assert r["payload_sha256"] == hashlib.sha256(full).hexdigest() and r["tail_crc32"] == zlib.crc32(full[-16:])
    assert len({tuple(r)[1:] for r in rows if r["doc_id"] in (904, 905)}) == 1
    assert len(rows) == odd_docs.count() and media.media_features(media.store_media(no_docs)).count() == 0
