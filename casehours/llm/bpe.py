"""BPE encoding and decoding in batched numpy merge rounds.

The distinct new words of a slice of texts lie in one flat array of symbols. In every round the ranks of all
neighbouring pairs are found by binary search over the sorted pair keys, each word merges all places of its pair
of lowest rank, and words without a known pair leave the array. Encoded words are kept in a bounded cache of the
worker process, so that frequent words are merged once.

Python and the library may follow different versions of Unicode. A text with a character about which they may differ
(newer than Unicode 3.2, or treated differently when both are asked) is split into words by the library's own rules.

Defined results: a null text is the empty text, which has no tokens; texts of any length are handled whole; an
empty table gives an empty table; repeated rows give repeated rows.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casehours.llm.common import prepare, tidied

#: The white space of the pattern, the pattern that finds words, the word end mark.
SPACE = r"\t\n\x0b\x0c\r\x20\x85\xa0  -     　"
WORDS = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{SPACE}\p{{L}}\p{{N}}]+")
WORD_END = "</w>"

CACHE_WORDS = 200_000
SLICE_CHARS = 1 << 19
NO_RANK = np.iinfo(np.int64).max


def byte_characters() -> list[str]:
    """The character that stands for each byte: printable Latin-1 is itself, the others follow from U+0100."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, spare = [], 256
    for b in range(256):
        out.append(chr(b if b in shown else spare))
        spare += b not in shown
    return out


class MergeTable:
    """Vocabulary and merges of a BPE file with word end marks."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        self.size = max(vocab.values()) + 1
        left, right, product = (np.array(x, np.int64) for x in zip(*((vocab[a], vocab[b], vocab[a + b]) for a, b in pairs), strict=True))
        keys = left * self.size + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.products = keys[order], order, product[order]
        chars = byte_characters()
        self.inner = np.array([vocab[c] for c in chars], np.int64)
        self.final = np.array([vocab[c + WORD_END] for c in chars], np.int64)
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        names = {i: s for s, i in vocab.items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
        self.tokens = [names.get(i, "").encode() for i in range(max(names) + 1)]
        self.special_pattern = regex.compile("(" + "|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True))) + ")") if self.specials else None

    def merge(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word as little-endian unsigned 32-bit integers."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        data = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum(lengths)
        symbols = self.inner[data]
        symbols[ends - 1] = self.final[data[ends - 1]]
        word = np.repeat(np.arange(len(words)), lengths)
        done_words, done_symbols = [], []
        while len(symbols):
            at = np.flatnonzero(word[1:] == word[:-1])
            key = symbols[at] * self.size + symbols[at + 1]
            found = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            known = self.keys[found] == key
            at, found = at[known], found[known]
            live = np.zeros(len(words), bool)
            live[word[at]] = True
            stays = live[word]
            done_words.append(word[~stays])
            done_symbols.append(symbols[~stays])
            if not len(at):
                break
            rank, own = self.ranks[found], word[at]
            first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            best = np.repeat(np.minimum.reduceat(rank, first), np.diff(np.append(first, len(own))))
            chosen = rank == best
            at, found = at[chosen], found[chosen]
            run = np.concatenate([[True], at[1:] != at[:-1] + 1])  # overlapping places: every second from the left
            since = np.arange(len(at)) - np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))
            at, found = at[since % 2 == 0], found[since % 2 == 0]
            symbols[at] = self.products[found]
            stays[at + 1] = False
            symbols, word = symbols[stays], word[stays]
        all_words, all_symbols = np.concatenate(done_words), np.concatenate(done_symbols)
        order = np.argsort(all_words, kind="stable")
        flat = all_symbols[order].astype("<u4").tobytes()
        stops = (np.cumsum(np.bincount(all_words, minlength=len(words))) * 4).tolist()
        return [flat[a:b] for a, b in zip([0, *stops[:-1]], stops, strict=True)]


def plain_words(text: str) -> list[str]:
    """Normalised words: canonical composition, lower case character by character, white space dropped."""
    if not text.isascii():
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
    return WORDS.findall(text.lower())


class LibraryWords:
    """Words as the library's normaliser and pre-tokenizer find them."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tool = Tokenizer.from_file(path)
        self.byte_of = {c: b for b, c in enumerate(byte_characters())}

    def __call__(self, text: str) -> list[str]:
        found = self.tool.pre_tokenizer.pre_tokenize_str(self.tool.normalizer.normalize_str(text))
        return [bytes(map(self.byte_of.__getitem__, w)).decode() for w, _ in found]


class Disputes:
    """Remembers about which characters Python and the library agree."""

    def __init__(self, library: LibraryWords):
        from tokenizers.normalizers import NFD

        self.library, self.decomposed, self.known = library, NFD().normalize_str, {}
        usual = [c for c in map(chr, (*range(0x80, 0x250), *range(0x2010, 0x2028))) if not self.disputed(c)]
        self.unusual = re.compile("[^\\x00-\\x7f" + "".join(map(re.escape, usual)) + "]")  # a bitmap there; the other module tries character by character

    def disputed(self, c: str) -> bool:
        """May the two normalise, split or order the character differently?"""
        if c not in self.known:
            beside = f"a{c}!"
            marks = (c, f"{c}\u0334", f"\u0345{c}")
            newer = unicodedata.ucd_3_2_0.category(c) == "Cn" or unicodedata.category(c) == "Cn"
            self.known[c] = newer or plain_words(beside) != self.library(beside) or any(unicodedata.normalize("NFD", x) != self.decomposed(x) for x in marks)
        return self.known[c]

    def any(self, text: str) -> bool:
        return not text.isascii() and self.unusual.search(text) is not None and any(map(self.disputed, set(self.unusual.findall(text))))


class Encoder:
    """Encodes whole texts as ids and decodes ids, with a bounded cache of encoded words."""

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        self.table, self.cache, self.older, self.cache_words = MergeTable(path), {}, {}, cache_words
        self.library = LibraryWords(path)
        self.disputes = Disputes(self.library)

    def words(self, text: str) -> list[str]:
        return self.library(text) if self.disputes.any(text) else plain_words(text)

    def pieces(self, text: str) -> list[list[str] | bytes]:
        """Words of the text between special tokens, and ids of special tokens."""
        t = self.table
        if not any(x in text for x in t.specials):
            return [self.words(text)]
        return [t.specials[x].to_bytes(4, "little") if x in t.specials else self.words(x) for x in t.special_pattern.split(text)]

    def encode(self, texts: list[str]) -> list[bytes]:
        split = [self.pieces(t) for t in texts]
        used = {w for pieces in split for p in pieces if isinstance(p, list) for w in p}
        if len(self.cache) + len(used) > self.cache_words:  # words in use come back from the older generation
            self.older, self.cache = self.cache, {}
        new = []
        for w in used.difference(self.cache):
            if (ids := self.older.get(w)) is None:
                new.append(w)
            else:
                self.cache[w] = ids
        if new:
            self.cache.update(zip(new, self.table.merge([w.encode() for w in new]), strict=True))
        known = self.cache.__getitem__
        return [b"".join(p if isinstance(p, bytes) else b"".join(map(known, p)) for p in pieces) for pieces in split]

    def decode(self, ids: bytes) -> bytes:
        """The text of ids in UTF-8, special tokens kept: tokens with a space between."""
        return b" ".join(map(self.table.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def text_slices(batch: pa.RecordBatch, column: str = "text", chars: int = SLICE_CHARS) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) of a batch in slices of so many characters or of one text; null is empty."""
    start, size, texts = 0, 0, []
    for k, value in enumerate(batch.column(column)):
        text = value.as_py() or ""
        if texts and size + len(text) > chars:
            yield start, texts
            start, size, texts = k, 0, []
        texts.append(text)
        size += len(text)
    if texts:
        yield start, texts


def encoded(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (binary, little-endian unsigned 32-bit) of every text."""
    prepare(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary())])

    def run(batches):
        tool = encoder(path)
        for batch in batches:
            names = batch.column("doc_id")
            for start, texts in text_slices(batch):
                yield pa.RecordBatch.from_arrays([names.slice(start, len(texts)), pa.array(tool.encode(texts), pa.binary())], schema=schema)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(tidied(run), "doc_id long, ids binary")


def decoded(tokens: DataFrame, path: str) -> DataFrame:
    """doc_id, text of a table of doc_id, ids."""
    prepare(tokens.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def run(batches):
        tool = encoder(path)
        for batch in batches:
            for k in range(0, batch.num_rows, 200):
                part = batch.slice(k, 200)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([tool.decode(x.as_py()).decode() for x in part.column(1)], pa.string())], schema=schema)

    return tokens.select("doc_id", "ids").mapInArrow(tidied(run), "doc_id long, text string")


def round_trip_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, and ids if asked for: encode and decode in one pass."""
    prepare(docs.sparkSession)
    kinds = {"doc_id": "long", "n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"} | ({"ids": "binary"} if with_ids else {})
    schema = pa.schema([(name, {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[kind]) for name, kind in kinds.items()])
    digest = lambda x: hashlib.sha256(x).hexdigest()

    def run(batches):
        tool = encoder(path)
        for batch in batches:
            names = batch.column("doc_id")
            for start, texts in text_slices(batch):
                ids = tool.encode(texts)
                columns = [pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(map(digest, ids), pa.string()), pa.array([digest(tool.decode(x)) for x in ids], pa.string())]
                if with_ids:
                    columns.append(pa.array(ids, pa.binary()))
                yield pa.RecordBatch.from_arrays([names.slice(start, len(texts)), *columns], schema=schema)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(tidied(run), ", ".join(f"{name} {kind}" for name, kind in kinds.items()))
