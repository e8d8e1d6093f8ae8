"""BPE encoding and decoding.

Encoding backtracks: an Aho-Corasick automaton over the reversed token strings gives, for every place
of a word, the longest token that begins there; a table leads from each token to the next shorter one
that begins it. The encoder takes the longest one that is compatible with the token before it and steps back where none is. Two tokens are compatible if
merging their joined text by rank gives just these two; the answers are kept in a pair table. As any
sequence of pairwise compatible tokens is the merge result, and places that led nowhere are marked,
the work is linear in the word's length. Words repeat, so a bounded memo holds their ids.

Decoding looks ids up in one byte string with an offset table and copies all ranges in one numpy pass.

A vocabulary file of the ``tokenizers`` library with a byte-level BPE and a word-end suffix is read as
JSON; its ids have to follow the merge ranks. Texts are normalised and split as that file says (NFC,
white space, lower case; letters, single numbers, other runs, English contractions). ASCII and Latin
text takes plain Python for that, all other text the library's own normaliser and splitter, so that
no difference between Unicode versions can show.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Cache, slices, small_batches, without

MOST_FORMS, MOST_WORDS, MOST_PAIRS = 250_000, 200_000, 200_000  # memo entries of a worker
MEMO_BYTES = 40 << 20  # of each memo
#: Characters that Python and the library surely treat alike: ASCII, and Latin letters up to U+024F but dotted capital I.
PLAIN = re.compile("[\t-\r -~¡-¨«¬®-±´¶-¸»¿-įı-ɏ]*")
#: How a plain text splits into words (fixed by the vocabulary file).
SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\w\s]|_)+")


def byte_letters() -> dict[str, int]:
    """Byte-level vocabularies write each byte as a printable letter: printable Latin-1 as itself, the rest from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def plain_forms(text: str) -> list[str]:
    """The stretches between white space of a text that ``PLAIN`` matches, normalised."""
    return (text if text.isascii() else unicodedata.normalize("NFC", text)).lower().split()


class Codec:
    """An encoder and decoder for one vocabulary file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            said = json.load(file)
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        model = said["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in said["added_tokens"]}
        self.marks = re.compile("(" + "|".join(re.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        letters = byte_letters()

        def symbols(token: str) -> str:
            """One character for each byte of a token, moved up by 256 if the word ends with it."""
            ends = bool(self.suffix) and token.endswith(self.suffix) and len(token) > len(self.suffix)
            raw = [letters[c] for c in (token[: -len(self.suffix)] if ends else token)]
            return "".join(map(chr, raw[:-1])) + chr(raw[-1] + 256 * ends)

        self.vocabulary: dict[str, int] = model["vocab"]
        self.tokens = {symbols(t): i for t, i in self.vocabulary.items()}
        self.parts: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        last = -1
        for pair in model["merges"]:
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            made = self.vocabulary[a + b]
            if made <= last:
                raise ValueError("the ids of this vocabulary do not follow its merge ranks")
            last = made
            two = self.vocabulary[a], self.vocabulary[b]
            self.parts[made] = two
            self.merged[two] = made
        self.automaton = ahocorasick.Automaton()
        for token, i in self.tokens.items():
            self.automaton.add_word(token[::-1], i)
        self.automaton.make_automaton()
        self.length = {i: len(t) for t, i in self.tokens.items()}
        self.shorter = {i: next((self.tokens[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in self.tokens), -1) for t, i in self.tokens.items()}
        self.pairs = Cache(lambda pair: self.compatible(*pair), MOST_PAIRS, MEMO_BYTES)
        self.words = Cache(self.word_ids, MOST_WORDS, MEMO_BYTES)
        self.forms = Cache(lambda form: b"".join(map(self.words.__getitem__, SPLIT.findall(form))), MOST_FORMS, MEMO_BYTES)
        self.spelled = {i: t for t, i in [*self.tokens.items(), *self.special.items()]}
        # decoding: every id's text, cut from one string; the library joins tokens by one space
        top = max([*self.vocabulary.values(), *self.special.values()]) + 1
        named = [b""] * top
        for token, i in [*self.vocabulary.items(), *self.special.items()]:
            named[i] = token.encode() + b" "
        self.blob = np.frombuffer(b"".join(named), np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum([len(t) for t in named])]).astype(np.int64)

    def compatible(self, left: int, right: int) -> bool:
        """Whether two adjacent tokens stay as they are: no merge across their border comes before the last merges inside them."""
        parts, merged = self.parts, self.merged
        limit = 1 << 60
        while True:
            made = merged.get((left, right))
            if made is not None and made < limit:
                return False
            if left > right:  # undo the later of the last merges, as only what it hid can still cross
                limit = left
                if left not in parts:
                    return True
                left = parts[left][1]
            else:
                limit = right + 1
                if right not in parts:
                    if left not in parts:
                        return True
                    limit, left = left, parts[left][1]
                else:
                    right = parts[right][0]

    def word(self, symbols: str) -> list[int]:
        """Exact merge result of one pre-split word."""
        n = len(symbols)
        longest, last = [-1] * n, -1
        for end, token in self.automaton.iter(symbols[::-1]):
            if end != last:  # matches that end at one place come longest first
                longest[n - 1 - end] = token
                last = end
        pairs, length, shorter = self.pairs, self.length, self.shorter
        out, at, token, dead = [], 0, longest[0], set()
        while at < n:
            while token >= 0 and (at + length[token] in dead or (out and not pairs[out[-1], token])):
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at += length[token]
                token = longest[at] if at < n else -1
            else:
                dead.add(at)
                token = out.pop()
                at -= length[token]
                token = shorter[token]
        return out

    def word_ids(self, word: str) -> bytes:
        """Ids of one word of a normalised text, as little-endian unsigned 32-bit integers."""
        raw = word.encode()
        return array("I", self.word("".join(map(chr, raw[:-1])) + chr(raw[-1] + 256 * bool(self.suffix)))).tobytes()

    def odd_ids(self, text: str) -> bytes:
        """Ids of text that is not plain: the library normalises and splits it, the merges are still made here."""
        letters = byte_letters()
        ids: list[int] = []
        for part, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text)):
            raw = [letters[c] for c in part]
            ids += self.word("".join(map(chr, raw[:-1])) + chr(raw[-1] + 256 * bool(self.suffix)))
        return np.array(ids, "<u4").tobytes()

    def encode(self, text: str | None) -> bytes:
        """Ids of a whole text (null: empty), as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if self.marks and "<|" in text:
            parts = self.marks.split(text)
            if len(parts) > 1:
                return b"".join(np.array([self.special[p]], "<u4").tobytes() if i % 2 else self.encode(p) for i, p in enumerate(parts))
        if not PLAIN.fullmatch(text):
            return self.odd_ids(text)
        return b"".join(map(self.forms.__getitem__, plain_forms(text)))

    def restores(self, text: str | None, ids: bytes) -> bool:
        """Whether the ids give back the text's words: normalised, split, and joined without what lies between."""
        parts = self.marks.split(text) if text and self.marks and "<|" in text else [text or ""]
        words = []
        for i, part in enumerate(parts):
            if i % 2:
                words.append(part)
            elif PLAIN.fullmatch(part):
                words += [w.encode().decode("latin-1") for form in plain_forms(part) for w in SPLIT.findall(form)]
            else:
                letters = byte_letters()
                words += ["".join(chr(letters[c]) for c in w) for w, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(part))]
        return "".join(map(self.spelled.__getitem__, np.frombuffer(ids, "<u4").tolist())) == "".join(w if w in self.special else f"{w[:-1]}{chr(ord(w[-1]) + 256 * bool(self.suffix))}" for w in words)

    def decode(self, ids: bytes) -> bytes:
        """UTF-8 of the decoded text."""
        at = np.frombuffer(ids, "<u4").astype(np.int64)
        if not len(at):
            return b""
        begin = self.offsets[at]
        sizes = self.offsets[at + 1] - begin
        ends = np.cumsum(sizes)
        where = np.repeat(begin - (ends - sizes), sizes) + np.arange(ends[-1])
        return self.blob[where].tobytes()[:-1]


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """The worker's codec for a vocabulary file; built once a process."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def encode_texts(df: DataFrame, path: str, *, text: str = "text") -> DataFrame:
    """Every row of ``df`` with token_ids (binary, little-endian unsigned 32-bit) and n_tokens.

    Null and empty texts get no tokens. Columns of these two names are replaced, further ones pass.
    """
    small_batches(df.sparkSession)
    df = without(df, "token_ids", "n_tokens")
    schema = df.select("*", F.lit(b"").alias("token_ids"), F.lit(0).cast("long").alias("n_tokens")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in slices(batches, text):
            ids = [own.encode(t) for t in batch.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.binary()), pa.array([len(i) // 4 for i in ids], pa.int64())], names=[*batch.schema.names, "token_ids", "n_tokens"])

    return df.mapInArrow(run, schema)


def decode_ids(df: DataFrame, path: str, *, ids: str = "token_ids") -> DataFrame:
    """Every row of ``df`` with decoded, the text of its ids (null: empty); a column of that name is replaced."""
    small_batches(df.sparkSession)
    df = without(df, "decoded")
    schema = df.select("*", F.lit("").alias("decoded")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in slices(batches, ids, 1 << 20):
            texts = [own.decode(i or b"").decode() for i in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "decoded"])

    return df.mapInArrow(run, schema)


def round_trip_digests(df: DataFrame, path: str, *, text: str = "text", id_column: str = "doc_id", keep_ids: bool = False) -> DataFrame:
    """By row: id, n_tokens, ids_sha256 and decoded_sha256, encoded and decoded in one pass over the texts.

    With ``keep_ids`` also token_ids (binary, little-endian unsigned 32-bit) and restores: whether the ids spell
    the text's normalised words. Null texts count as empty and have no ids; rows are encoded one by one and whole,
    repeated ones alike, a very long text in its row's task; an empty table stays empty; further columns are not read.
    """
    small_batches(df.sparkSession)
    kind = df.schema[id_column].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in slices(batches, "_text"):
            ids = [own.encode(t) for t in batch.column("_text").to_pylist()]
            columns = [
                batch.column(0),
                pa.array([len(i) // 4 for i in ids], pa.int64()),
                pa.array([hashlib.sha256(i).hexdigest() for i in ids]),
                pa.array([hashlib.sha256(own.decode(i)).hexdigest() for i in ids]),
            ]
            more = [pa.array(ids, pa.binary()), pa.array([own.restores(t, i) for t, i in zip(batch.column("_text").to_pylist(), ids, strict=True)])] if keep_ids else []
            yield pa.RecordBatch.from_arrays(columns + more, names=[id_column, "n_tokens", "ids_sha256", "decoded_sha256", *(["token_ids", "restores"] if keep_ids else [])])

    return df.select(id_column, F.col(text).alias("_text")).mapInArrow(run, f"{id_column} {kind.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", token_ids binary, restores boolean" * keep_ids)
