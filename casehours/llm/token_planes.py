"""Token files of shuffled planes.

Ids of documents in ascending order of doc_id form one stream. A file holds blocks of ``BLOCK`` ids; a block is
transposed into byte planes (or bit planes), each plane is compressed with zstandard, and an index at the end says
where each block lies, how long its planes are, and which documents the file has.

    magic | planes of block 0 | planes of block 1 | ... | index (zstandard) | length of index, u64 | magic

Defined results: a null text is empty and has its end id alone; null ids come first; rows that repeat an id follow
each other in order of their texts; an empty table gives no files and an empty table. Ids of a file are in memory while it
is written, 4 bytes each and ``FILE_IDS`` and one document's at most.
"""

from __future__ import annotations

import json
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from casehours.llm.byte_words import ODD, WordTable, gathered, kinds_of, windows, word_starts
from casehours.llm.common import cut, file_system, fresh_path, prepare, sized, tidied, write_file

MAGIC = b"CHPLANE1"
BLOCK = 1 << 16
FILE_IDS = 1 << 24
CACHE_WORDS = 1 << 21
WINDOW = 1 << 20
#: Documents that are encoded together.
SLICE_ROWS = 200


def to_planes(ids: np.ndarray, bit: bool = False) -> list[bytes]:
    """Planes of a block of u32 ids: 4 byte planes, or 32 bit planes."""
    octets = np.ascontiguousarray(ids.astype("<u4", copy=False)).view(np.uint8).reshape(-1, 4)
    if not bit:
        return [octets[:, k].tobytes() for k in range(4)]
    bits = np.unpackbits(octets, axis=1, bitorder="little")
    return [np.packbits(bits[:, k]).tobytes() for k in range(32)]


def from_planes(planes: list[bytes], n: int, bit: bool = False) -> np.ndarray:
    if not bit:
        return np.stack([np.frombuffer(p, np.uint8) for p in planes], axis=1).reshape(-1).view("<u4")
    bits = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), count=n) for p in planes], axis=1)
    return np.packbits(bits, axis=1, bitorder="little").reshape(-1).view("<u4")


class PlaneWriter:
    """Collects ids of documents and yields the parts of one file."""

    def __init__(self, bit: bool = False, block: int = BLOCK):
        self.bit, self.block, self.packer = bit, block, zstandard.ZstdCompressor(level=3)
        self.parts, self.blocks, self.docs, self.held, self.n_held, self.at, self.n_ids = [MAGIC], [], [], [], 0, len(MAGIC), 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.extend([doc_id], np.array([len(ids)]), ids)

    def extend(self, doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray) -> None:
        """Documents in order: how many ids each has, and the ids of all."""
        self.docs += zip(doc_ids, lengths.tolist(), strict=True)
        self.held.append(ids)
        self.n_held += len(ids)
        self.n_ids += len(ids)
        if self.n_held >= self.block:
            flat = np.concatenate(self.held)
            whole = len(flat) // self.block * self.block
            for k in range(0, whole, self.block):
                self._pack(flat[k : k + self.block])
            self.held, self.n_held = [flat[whole:]], len(flat) - whole

    def _pack(self, ids: np.ndarray) -> None:
        planes = [self.packer.compress(p) for p in to_planes(ids, self.bit)]
        self.blocks.append([self.at, len(ids), [len(p) for p in planes]])
        self.parts += planes
        self.at += sum(map(len, planes))

    def close(self) -> list[bytes]:
        if self.n_held:
            self._pack(np.concatenate(self.held))
        index = self.packer.compress(json.dumps({"bit": self.bit, "blocks": self.blocks, "doc_ids": [d for d, _ in self.docs], "lengths": [n for _, n in self.docs]}).encode())
        return [*self.parts, index, len(index).to_bytes(8, "little"), MAGIC]


def read_index(f) -> dict:
    """The chunk index of an open file."""
    size = f.size()
    f.seek(size - 16)
    tail = f.read(16)
    if tail[8:] != MAGIC:
        raise ValueError("not a plane file")
    length = int.from_bytes(tail[:8], "little")
    f.seek(size - 16 - length)
    return json.loads(zstandard.ZstdDecompressor().decompress(f.read(length)))


def read_block(f, index: dict, k: int) -> np.ndarray:
    """Ids of block k alone."""
    at, n, lengths = index["blocks"][k]
    f.seek(at)
    data, planes, unpack = f.read(sum(lengths)), [], zstandard.ZstdDecompressor()
    for length in lengths:
        planes.append(unpack.decompress(data[:length]))
        data = data[length:]
    return from_planes(planes, n, index["bit"])


class WordCachedTokenizer:
    """The tokenizers library, asked once for each distinct word: the byte-level merges never cross a word.

    Every document ends with ``end_id``. Texts with special tokens or unusual characters are encoded whole.
    """

    def __init__(self, path: str, end_id: int = 2, cache_words: int = CACHE_WORDS):
        from tokenizers import Tokenizer

        self.tool, self.end_id = Tokenizer.from_file(path), end_id
        self.tool.no_padding()
        self.tool.no_truncation()
        self.table = WordTable(self._words, cache_words)
        self.specials = [t.content.encode() for t in self.tool.get_added_tokens_decoder().values()]

    def _direct(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tool.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of new words. Words of a space and letters are encoded many in a text: it splits into the same words again."""
        texts = [w.decode() for w in words]
        plain = np.fromiter((w[0] == " " and w[1:].isalpha() for w in texts), bool, len(texts))
        ended = np.fromiter((w == "\0" for w in texts), bool, len(texts))
        rest = [texts[k] for k in np.flatnonzero(~plain & ~ended)]
        named = [texts[k] for k in np.flatnonzero(plain)]
        single = self._direct(rest)
        many = self.tool.encode_batch(["".join(named[k : k + 200]) for k in range(0, len(named), 200)], add_special_tokens=False)
        ids = np.concatenate([np.full(1, self.end_id, np.uint32), *single, *(np.array(e.ids, np.uint32) for e in many)])
        lengths = np.concatenate([np.ones(1, np.int64), np.fromiter(map(len, single), np.int64, len(single)), *(np.bincount(e.word_ids) for e in many)])
        at = np.zeros(len(words), np.int64)
        at[~plain & ~ended] = 1 + np.arange(len(rest))
        at[plain] = 1 + len(rest) + np.arange(len(named))
        return gathered(ids, np.concatenate([[0], np.cumsum(lengths)]), at)

    def _odd(self, data: np.ndarray, kinds: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Texts of a stream that must be encoded whole."""
        nul = np.flatnonzero(data == 0)
        places = [np.flatnonzero(kinds == ODD), np.setdiff1d(nul, offsets[1:] - 1, assume_unique=True) if len(nul) >= len(offsets) else nul[:0]]
        raw = data.tobytes()
        for special in self.specials:
            at = raw.find(special)
            while at >= 0:
                places.append(np.array([at]))
                at = raw.find(special, at + 1)
        return np.unique(np.searchsorted(offsets, np.concatenate(places), side="right") - 1)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, end ids included, and how many each text has; null is empty."""
        data, offsets = ended_stream(texts)
        odd = self._odd(data, kinds_of(data), offsets)
        if len(odd):
            plain = np.ones(len(texts), bool)
            plain[odd] = False
            data, offsets = ended_stream(pc.if_else(pa.array(plain), texts, pa.scalar("", texts.type)))
        parts, ends, n = [], [], 0
        for a, b in windows(data, WINDOW):
            piece = data[a:b]
            starts = word_starts(piece, kinds_of(piece))
            ids, counts = self.table.ids_of(self.table.values(piece, starts))
            parts.append(ids)
            ends.append(n + np.cumsum(counts)[piece[starts] == 0])
            n += len(ids)
        flat, ends = np.concatenate([*parts, np.zeros(0, np.uint32)]), np.concatenate([*ends, np.zeros(0, np.int64)])
        lengths = np.diff(ends, prepend=0)
        if len(odd):
            whole = [self._direct([texts[int(k)].as_py()])[0] for k in odd]
            pieces, at = [], 0
            for k, x in zip(odd, whole, strict=True):
                pieces += [flat[at : ends[k] - 1], x]
                at = ends[k] - 1
            flat = np.concatenate([*pieces, flat[at:]])
            lengths[odd] += np.fromiter(map(len, whole), np.int64, len(whole))
        return flat, lengths


def ended_stream(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts, each with a NUL after it, and where each begins and the last ends."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    joined = pc.binary_join_element_wise(texts, pa.scalar("", pa.large_string()), pa.scalar("\0", pa.large_string()))
    _, offsets, data = joined.buffers()
    offsets = np.frombuffer(offsets, np.int64)[joined.offset : joined.offset + len(joined) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8))[offsets[0] : offsets[-1]], offsets - offsets[0]


@lru_cache(maxsize=2)
def tokenizer(path: str, end_id: int) -> WordCachedTokenizer:
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return WordCachedTokenizer(path, end_id)


def write_tokens(docs: DataFrame, tokenizer_path: str, path: str, end_id: int = 2, bit: bool = False, file_ids: int = FILE_IDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the plane files of ``docs`` into ``path``; the table of them: file, part, seq, docs, ids, bytes."""
    schema = pa.schema([("file", pa.string()), ("part", pa.int32()), ("seq", pa.int32()), ("docs", pa.int64()), ("ids", pa.int64()), ("bytes", pa.int64())])

    def run(batches):
        tool, part, rows, writer = tokenizer(tokenizer_path, end_id), TaskContext.get().partitionId(), [], PlaneWriter(bit)

        def flush():
            uri = f"{path}/part-{part:06d}-{len(rows):04d}.planes"
            rows.append({"file": uri, "part": part, "seq": len(rows), "docs": len(writer.docs), "ids": writer.n_ids, "bytes": write_file(uri, writer.close())})

        for batch in batches:
            for k in range(0, batch.num_rows, SLICE_ROWS):
                own = batch.slice(k, SLICE_ROWS)
                ids, lengths = tool.encode(own.column("text"))
                writer.extend(own.column("doc_id").to_pylist(), lengths, ids)
                if writer.n_ids >= file_ids:
                    flush()
                    writer = PlaneWriter(bit)
        if writer.docs:
            flush()
        yield pa.RecordBatch.from_pylist(rows, schema=schema)

    prepare(docs.sparkSession)
    keyed = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    # ranges of ids and of beginnings of texts: rows of one id, or without one, spread over tasks
    ordered = keyed.repartitionByRange("doc_id", F.substring("text", 1, 32)).sortWithinPartitions("doc_id", "text")
    return cut(ordered.mapInArrow(tidied(run), "file string, part int, seq int, docs long, ids long, bytes long"), "plane-manifest")


def read_tokens(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files alone; one block of ids in memory at a time."""
    schema = pa.schema([("file", pa.string()), ("doc_id", pa.int64()), ("local_start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches):
        for uri in (u for b in batches for u in b.column(0).to_pylist()):
            fs, where = file_system(uri)
            with fs.open_input_file(where) as f:
                index = read_index(f)
                lengths = index["lengths"]
                crcs, doc, left, block, at, k = [], 0, lengths[0] if lengths else 0, b"", 0, 0
                crc = 0
                while doc < len(lengths):
                    if left and at == len(block):
                        block, at, k = read_block(f, index, k).tobytes(), 0, k + 1
                    taken = min(left * 4, len(block) - at)
                    crc = zlib.crc32(memoryview(block)[at : at + taken], crc)
                    at, left = at + taken, left - taken // 4
                    if not left:
                        crcs.append(crc)
                        crc, doc = 0, doc + 1
                        left = lengths[doc] if doc < len(lengths) else 0
                n = np.array(lengths, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([uri] * len(n), pa.string()), pa.array(index["doc_ids"], pa.int64()), pa.array(np.cumsum(n) - n), pa.array(n), pa.array(crcs, pa.int64())], schema=schema)

    tasks = max(1, min(10_000, manifest.count()))
    rows = manifest.select("file").repartition(tasks).mapInArrow(tidied(run), "file string, doc_id long, local_start long, n_tokens long, ids_crc32 long")
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    offsets = manifest.select("file", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("file_start"))
    return rows.join(sized(offsets), "file").select("doc_id", (F.col("file_start") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")


def token_round_trip(docs: DataFrame, tokenizer_path: str, end_id: int = 2, bit: bool = False) -> DataFrame:
    """Write the plane files of ``docs`` in the shared folder and read them back."""
    return read_tokens(write_tokens(docs, tokenizer_path, fresh_path(docs.sparkSession, "planes"), end_id, bit))
