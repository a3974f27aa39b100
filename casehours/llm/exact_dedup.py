"""Exact deduplication by counting quotient filters.

Each partition builds counting quotient filters over 64-bit fingerprints of its texts, one for each segment of
the fingerprint space. Filters of one segment merge without loss: a filter gives back its sorted fingerprints,
sorted runs merge, equal fingerprints add their counts. A partition has at most 2^``LEVEL_BITS`` segments; where the
corpus needs more, filters of one segment are dealt to a task that parts them into finer ones, level by level, so that
filters stay full and a fingerprint that many partitions have travels once from each. Only fingerprints counted more than once route their
texts to byte verification, which groups by the text itself.

Defined results: a null text counts as the empty text; empty texts equal each other; a null id never wins over
another id (a group of null ids alone has a null ``keep_id``). ``kept`` is a matter of id and text, so rows that repeat the largest id of
their group have it alike; where rows are dropped, one of them stays, which one is not said. An empty table gives an
empty table; further columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casehours.llm.common import cut, has_rows, prepare, settled, sized, tidied

FILTER_SCHEMA = "segment long, quotient_bits int, n int, occupied binary, run_ends binary, remainders binary, repeated binary, counts binary"
FLUSH = 1_000_000
LEVEL_BITS = 10
#: Losers (an id and two hashes, about 100 bytes each in a hash table) that may be broadcast.
BROADCAST_LOSERS = 300_000


def pack_bits(values: np.ndarray, bits: int) -> bytes:
    """The low ``bits`` bits of unsigned 64-bit values, one after another."""
    octets = values.astype(">u8").view(np.uint8).reshape(-1, 8)
    return np.packbits(np.unpackbits(octets, axis=1)[:, 64 - bits :]).tobytes()


def unpack_bits(data: bytes, n: int, bits: int) -> np.ndarray:
    wide = np.zeros((n, 64), np.uint8)
    wide[:, 64 - bits :] = np.unpackbits(np.frombuffer(data, np.uint8), count=n * bits).reshape(n, bits)
    return np.packbits(wide, axis=1).view(">u8").reshape(-1).astype(np.uint64)


@dataclass
class CountingQuotientFilter:
    """A quotient filter over ``width``-bit values, stored as two bit vectors, remainders in order, and counts.

    ``occupied[q]`` says that quotient q has a run; ``run_ends[i]`` marks the last remainder of a run; ``repeated[i]``
    marks remainders whose count is over one, and ``counts`` has those counts in order.
    """

    width: int
    quotient_bits: int
    occupied: np.ndarray
    run_ends: np.ndarray
    remainders: np.ndarray
    repeated: np.ndarray
    counts: np.ndarray

    @classmethod
    def build(cls, values: np.ndarray, counts: np.ndarray, width: int) -> CountingQuotientFilter:
        """From sorted distinct values and their counts."""
        bits = min(width, max(1, math.ceil(math.log2(len(values) + 1))))
        shift = np.uint64(width - bits)
        quotients = values >> shift if width > bits else values
        remainders = values - (quotients << shift)
        occupied = np.zeros(1 << bits, bool)
        occupied[quotients] = True
        ends = np.ones(len(values), bool)
        ends[:-1] = quotients[1:] != quotients[:-1]
        many = counts > 1
        return cls(width, bits, occupied, ends, remainders, many, counts[many])

    def items(self) -> tuple[np.ndarray, np.ndarray]:
        """The sorted values and their counts, exactly as they went in."""
        quotients = np.flatnonzero(self.occupied).astype(np.uint64)
        run = np.concatenate([[0], np.cumsum(self.run_ends)[:-1]]).astype(np.int64) if len(self.run_ends) else np.zeros(0, np.int64)
        values = (quotients[run] << np.uint64(self.width - self.quotient_bits)) + self.remainders
        counts = np.ones(len(values), np.int64)
        counts[self.repeated] = self.counts
        return values, counts

    def row(self, segment: int) -> dict:
        pack = lambda bits: np.packbits(bits).tobytes()
        return {"segment": segment, "quotient_bits": self.quotient_bits, "n": len(self.remainders), "occupied": pack(self.occupied), "run_ends": pack(self.run_ends), "remainders": pack_bits(self.remainders, self.width - self.quotient_bits), "repeated": pack(self.repeated), "counts": self.counts.astype(np.int64).tobytes()}

    @classmethod
    def of_row(cls, row: dict, width: int) -> CountingQuotientFilter:
        remainders = unpack_bits(row["remainders"], row["n"], width - row["quotient_bits"])
        unpack = lambda name, n: np.unpackbits(np.frombuffer(row[name], np.uint8), count=n).astype(bool)
        return cls(width, row["quotient_bits"], unpack("occupied", 1 << row["quotient_bits"]), unpack("run_ends", len(remainders)), remainders, unpack("repeated", len(remainders)), np.frombuffer(row["counts"], np.int64))


def merge_filters(filters: list[CountingQuotientFilter]) -> CountingQuotientFilter:
    """One filter with all values; counts of equal values add up."""
    parts = [f.items() for f in filters]
    values, counts = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
    order = np.argsort(values, kind="stable")
    values, counts = values[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
    return CountingQuotientFilter.build(values[first], np.add.reduceat(counts, first), filters[0].width)


def _arrow_schema() -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    return pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in FILTER_SCHEMA.split(", "))])


def _filters_of(values: np.ndarray, counts: np.ndarray, segment_bits: int):
    """Batches of filters, one a segment, of sorted distinct fingerprints."""
    width, rows = 64 - segment_bits, []
    segments = (values >> np.uint64(width)).astype(np.int64)
    starts = np.flatnonzero(np.concatenate([[True], segments[1:] != segments[:-1]]))
    for a, b in zip(starts, [*starts[1:], len(values)], strict=True):
        inside = values[a:b] - (np.uint64(segments[a]) << np.uint64(width))
        rows.append(CountingQuotientFilter.build(inside, counts[a:b], width).row(int(segments[a])))
        if len(rows) == 1000:
            yield pa.RecordBatch.from_pylist(rows, schema=_arrow_schema())
            rows = []
    if rows:
        yield pa.RecordBatch.from_pylist(rows, schema=_arrow_schema())


def _fingerprints_of(row: dict, segment_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted fingerprints and counts of a filter's row."""
    width = 64 - segment_bits
    values, counts = CountingQuotientFilter.of_row(row, width).items()
    return values + (np.uint64(row["segment"]) << np.uint64(width)), counts


def partition_filters(fingerprints: DataFrame, segment_bits: int) -> DataFrame:
    """Counting quotient filters of each partition of a one-column table of long fingerprints; ``segment_bits`` is 1 or more."""
    def build(batches):
        parts, n = [], 0
        for batch in batches:
            parts.append(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
            n += batch.num_rows
            if n >= FLUSH:
                yield from _filters_of(*np.unique(np.concatenate(parts), return_counts=True), segment_bits)
                parts, n = [], 0
        if n:
            yield from _filters_of(*np.unique(np.concatenate(parts), return_counts=True), segment_bits)

    return fingerprints.mapInArrow(tidied(build), FILTER_SCHEMA)


def finer_filters(filters: DataFrame, segment_bits: int, finer_bits: int) -> DataFrame:
    """The same fingerprints and counts in filters of finer segments."""
    def summed(parts):
        values, counts = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
        values, at = np.unique(values, return_inverse=True)
        return values, np.bincount(at, weights=counts).astype(np.int64)

    def build(batches):
        parts, n = [], 0
        for batch in batches:
            for row in batch.to_pylist():
                parts.append(_fingerprints_of(row, segment_bits))
                n += len(parts[-1][0])
                if n >= FLUSH:
                    yield from _filters_of(*summed(parts), finer_bits)
                    parts, n = [], 0
        if n:
            yield from _filters_of(*summed(parts), finer_bits)

    return filters.repartition("segment").mapInArrow(tidied(build), FILTER_SCHEMA)


def repeated_fingerprints(fingerprints: DataFrame, segment_bits: int) -> DataFrame:
    """fp long, copies long of the fingerprints that a one-column table has more than once."""
    out = pa.schema([("fp", pa.int64()), ("copies", pa.int64())])

    def merged(group: pa.Table) -> pa.Table:
        width, rows = 64 - segment_bits, group.to_pylist()
        whole = merge_filters([CountingQuotientFilter.of_row(r, width) for r in rows])
        values, counts = whole.items()
        many = counts > 1
        values = values[many] + (np.uint64(rows[0]["segment"]) << np.uint64(width))
        return pa.table([values.view(np.int64), counts[many]], schema=out)

    bits = min(segment_bits, LEVEL_BITS)
    filters = partition_filters(fingerprints, bits)
    while bits < segment_bits:
        filters, bits = finer_filters(filters, bits, min(segment_bits, bits + LEVEL_BITS)), min(segment_bits, bits + LEVEL_BITS)
    return filters.groupBy("segment").applyInArrow(merged, "fp long, copies long")


def _decided(docs: DataFrame, id_col: str, text_col: str, segment_rows: int) -> DataFrame:
    """The rows of :func:`exact_duplicates` with two 64-bit hashes of the text, fp and fp2."""
    prepare(docs.sparkSession)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    keyed = texts.select("doc_id", "text", F.xxhash64("text").alias("fp"))
    segment_bits = max(6, math.ceil(math.log2(max(1, docs.count() / segment_rows))))
    repeated = cut(repeated_fingerprints(keyed.select("fp"), segment_bits).select("fp"), "repeated-fp")
    groups = keyed.join(sized(repeated), "fp", "left_semi").groupBy("fp", "text").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    # written before the join, which then has plain exchanges: AQE can split a large group of copies
    groups = cut(groups.filter("group_size > 1").select("fp", F.sha2("text", 256).alias("text_sha256"), "keep_id", "group_size"), "copy-groups")
    narrow = keyed.select("doc_id", "fp", _second_hash("text").alias("fp2"), F.sha2("text", 256).alias("text_sha256"))
    return narrow.join(sized(groups, BROADCAST_LOSERS), ["fp", "text_sha256"], "left").select(
        "doc_id",
        F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.when(F.col("group_size").isNull(), F.lit(True)).otherwise(F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        "text_sha256",
        "fp",
        "fp2",
    )


def _second_hash(text):
    return F.xxhash64(F.lit("second"), text)


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", segment_rows: int = 100_000) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    ``segment_rows``: fingerprints that one merge task handles at a time, so memory does not grow with the corpus.
    """
    return _decided(docs, id_col, text_col, segment_rows).drop("fp", "fp2")


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each text, columns unchanged: one with the largest id (a null id only if there is no other)."""
    gone_by = {"doc_id": "_gone_id", "fp": "_gone_fp", "fp2": "_gone_fp2"}
    copies = settled(lambda: _decided(docs, id_col, text_col, 100_000).filter("group_size > 1").select(*gone_by, "kept").withColumnsRenamed(gone_by), "copies")
    losers = cut(copies.filter("not kept").drop("kept").distinct(), "exact-losers")
    twins = cut(copies.filter("kept").drop("kept").groupBy(*gone_by.values()).count().filter("count > 1").drop("count"), "exact-twins")
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.withColumn("_fp", F.xxhash64(text)).withColumn("_fp2", _second_hash(text))
    is_one = F.col(id_col).eqNullSafe(F.col("_gone_id")) & (F.col("_fp") == F.col("_gone_fp")) & (F.col("_fp2") == F.col("_gone_fp2"))
    left = keyed.join(sized(losers, BROADCAST_LOSERS), is_one, "left_anti")
    if has_rows(twins):
        few = sized(twins, BROADCAST_LOSERS)
        # counted before the shuffle: a partition passes one row of each group on
        left = left.join(few, is_one, "left_anti").unionByName(left.join(few, is_one, "left_semi").dropDuplicates([id_col, "_fp", "_fp2"]))
    return left.drop("_fp", "_fp2")
