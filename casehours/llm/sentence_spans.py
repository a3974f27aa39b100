"""Substring deduplication by sliding sentence spans.

A span is a run of ``SENTENCES`` consecutive sentences; a text with fewer sentences is one span. Every run is hashed, so inside any
longer repeated run all sentences are covered. Beside them, a run of fewer sentences is a span if it has ``LONG_WORDS`` words, as
few sentences as that takes, from and to every sentence: long passages can be of one or two sentences. Spans join globally
by two 64-bit hashes; of a repeated span the place with the smallest (doc_id, sentence) is the first, and sentences that
any other place covers are removed.

Two parameters narrow and widen this; both are off by default. With ``least_words`` a span has that many words: runs go on past
``SENTENCES`` until they do, and what is shorter as a whole is nothing. With ``passage_words`` a run of that many words that an
earlier row has too is removed wherever it begins, in the middle of a sentence as well. Not every window of such a size is
shuffled: its anchor is the least hash of the runs of half its words in it, so equal windows have equal anchors, and
neighbouring windows mostly share theirs. First whole stretches of windows with one anchor are joined; only where rows share an
anchor but not the stretch, one row of each stretch is joined window by window. So all such runs are found, and no others.

A sentence ends after a word that ends in ``.``, ``!`` or ``?`` (closing quotes or brackets may follow), and at a line
end. Words compare with A-Z as a-z, white space between them does not count.

Defined results: null and empty texts have no sentences. Rows are judged, not ids: rows that share an id, and rows with a null
id, have places of their own, behind those of smaller ids and in an order of their own; null ids come last. Rows equal in id
and text are one row. An empty table gives an empty table; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casehours.llm.common import ROW, cut, has_rows, prepare, repeated_ids, sized, tidied, with_row_ids
from casehours.llm.shingles import mix, words_of

#: Sentences of a span; words of a span with fewer sentences.
SENTENCES, LONG_WORDS = 3, 50

_STOPS = np.zeros(256, bool)
_STOPS[[ord(c) for c in ".!?"]] = True
_CLOSING = np.zeros(256, bool)
_CLOSING[[ord(c) for c in "\"')]}"]] = True
#: Bases of the two hashes.
_BASES = (0xD1342543DE82EF95, 0x2545F4914F6CDD1D)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(max(n, 1), np.uint64(base))
    out[0] = 1
    return np.multiply.accumulate(out)


def sentences_of(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes, first word of each sentence (and the number of words at the end), and start and end byte of each word."""
    hashes, starts, ends = words_of(text)
    if not len(hashes):
        return hashes, np.zeros(1, np.int64), starts, ends
    data = np.frombuffer(text, np.uint8)
    last = data[ends - 1]
    closed = _CLOSING[last] & (ends - starts > 1)
    stop = _STOPS[last] | (closed & _STOPS[data[np.maximum(ends - 2, 0)]])
    lines = np.concatenate([[0], np.cumsum((data == 10) | (data == 13))])
    stop[:-1] |= lines[starts[1:]] > lines[ends[:-1]]
    return hashes, np.concatenate([[0], np.flatnonzero(stop[:-1]) + 1, [len(hashes)]]), starts, ends


def _run_hashes(hashes: np.ndarray, a: np.ndarray, b: np.ndarray, base: int) -> np.ndarray:
    """Hashes of the runs of words from ``a`` to before ``b``."""
    sums = np.concatenate([[np.uint64(0)], np.cumsum(hashes * _powers(base, len(hashes)))])
    return mix((sums[b] - sums[a]) * _powers(pow(base, -1, 1 << 64), len(hashes))[a] + (b - a).astype(np.uint64))


def runs_of(text: bytes, sentences: int = SENTENCES, long_words: int = LONG_WORDS, least_words: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First sentence, sentence after the last, and two hashes of the spans of a text."""
    hashes, first, _, _ = sentences_of(text)
    n, words = len(first) - 1, len(hashes)
    if not words:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),) * 2
    size = min(sentences, n)
    begin, end = np.arange(n), np.arange(1, n + 1)
    # the shortest runs from and to every sentence: of ``size`` sentences and ``least_words``, and of fewer sentences with ``long_words``
    full_until = np.maximum(begin + size, np.searchsorted(first, first[:-1] + least_words))
    full_since = np.minimum(end - size, np.searchsorted(first, first[1:] - least_words, "right") - 1)
    until = np.searchsorted(first, first[:-1] + max(long_words, least_words))
    since = np.searchsorted(first, first[1:] - max(long_words, least_words), "right") - 1
    parts = [(begin, full_until, full_until <= n), (full_since, end, full_since >= 0), (begin, until, (until <= n) & (until - begin < size)), (since, end, (since >= 0) & (end - since < size))]
    at, until = np.divmod(np.unique(np.concatenate([(x * (n + 1) + y)[kept] for x, y, kept in parts])), n + 1)
    return at, until, *(_run_hashes(hashes, first[at], first[until], base) for base in _BASES)


def _least(values: np.ndarray, size: int) -> np.ndarray:
    """The least of every ``size`` consecutive values."""
    span = 1
    while span * 2 <= size:
        values = np.minimum(values[:-span], values[span:])
        span *= 2
    return np.minimum(values[: len(values) - size + span], values[size - span :])


def anchors_of(hashes: np.ndarray, size: int) -> np.ndarray:
    """The anchor of every window of ``size`` words: the least hash of the runs of half as many words in it."""
    if len(hashes) < size:
        return np.zeros(0, np.uint64)
    half = (size + 1) // 2
    at = np.arange(len(hashes) - half + 1)
    return _least(_run_hashes(hashes, at, at + half, _BASES[0]), size - half + 1)


def _together(found, most: int = 200_000):
    """Arrays that belong to the rows of a batch, a tuple for each, joined until they have ``most`` values; before them, the place of each value's row."""
    parts, own, size = [], [], 0
    for k, arrays in enumerate(found):
        parts.append(arrays)
        own.append(np.full(len(arrays[0]), k, np.int64))
        size += len(arrays[0])
        if size > most:
            yield [pa.array(np.concatenate(x)) for x in (own, *zip(*parts, strict=True))]
            parts, own, size = [], [], 0
    if parts:
        yield [pa.array(np.concatenate(x)) for x in (own, *zip(*parts, strict=True))]


def runs(rows: DataFrame, sentences: int = SENTENCES, long_words: int = LONG_WORDS, least_words: int = 0) -> DataFrame:
    """span, check (hashes), row, first, until of all spans of a table row, text; and doc_id where the table has it."""
    names = [c for c in ("row", "doc_id") if c in rows.columns]
    schema = pa.schema([("span", pa.int64()), ("check", pa.int64()), *((c, pa.int64()) for c in names), ("first", pa.int32()), ("until", pa.int32())])

    def run(batches):
        for batch in batches:
            found = (runs_of(text.as_buffer() or b"", sentences, long_words, least_words) for text in batch.column("text"))
            hashed = ((span.view(np.int64), check.view(np.int64), at.astype(np.int32), until.astype(np.int32)) for at, until, span, check in found)
            for place, span, check, at, until in _together(hashed):
                yield pa.RecordBatch.from_arrays([span, check, *(batch.column(c).take(place) for c in names), at, until], schema=schema)

    return rows.select(*names, F.encode(F.coalesce("text", F.lit("")), "utf-8").alias("text")).mapInArrow(tidied(run), ", ".join(["span long, check long", *(f"{c} long" for c in names), "first int, until int"]))


def stretches_of(text: bytes, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, hash, first word and word after the last of every stretch of neighbouring windows that share their anchor."""
    hashes = words_of(text)[0]
    anchors = anchors_of(hashes, size)
    first = np.flatnonzero(np.concatenate([np.ones(min(len(anchors), 1), bool), anchors[1:] != anchors[:-1]]))
    until = np.append(first[1:], len(anchors))[: len(first)] + size - 1
    return anchors[first], _run_hashes(hashes, first, until, _BASES[1]), first, until


def passages(rows: DataFrame, size: int) -> DataFrame:
    """row, first, until (words), first_doc of runs of ``size`` words and more that an earlier row has too; they cover all such runs."""
    names = [c for c in ("row", "doc_id") if c in rows.columns]
    own, own_types = [(c, pa.int64()) for c in names], "".join(f"{c} long, " for c in names)
    stretch_schema = pa.schema([("anchor", pa.int64()), ("whole", pa.int64()), *own, ("first", pa.int32()), ("until", pa.int32())])
    window_schema = pa.schema([("span", pa.int64()), ("check", pa.int64()), *own, ("first", pa.int32()), ("until", pa.int32())])
    texts = rows.select(*names, F.encode(F.coalesce("text", F.lit("")), "utf-8").alias("text"))

    def stretched(batches):
        for batch in batches:
            found = (stretches_of(text.as_buffer(), size) for text in batch.column("text"))
            hashed = ((anchor.view(np.int64), whole.view(np.int64), a.astype(np.int32), b.astype(np.int32)) for anchor, whole, a, b in found)
            for place, anchor, whole, a, b in _together(hashed):
                yield pa.RecordBatch.from_arrays([anchor, whole, *(batch.column(c).take(place) for c in names), a, b], schema=stretch_schema)

    def windows(text, stretches):
        hashes = words_of(text.as_buffer())[0]
        at = np.unique(np.concatenate([np.arange(r["first"], r["until"] - size + 1) for r in stretches.as_py()]))
        return *(_run_hashes(hashes, at, at + size, base).view(np.int64) for base in _BASES), at.astype(np.int32), (at + size).astype(np.int32)

    def windowed(batches):
        for batch in batches:
            for place, span, check, a, b in _together(map(windows, batch.column("text"), batch.column("stretches"))):
                yield pa.RecordBatch.from_arrays([span, check, *(batch.column(c).take(place) for c in names), a, b], schema=window_schema)

    held = cut(texts.mapInArrow(tidied(stretched), f"anchor long, whole long, {own_types}first int, until int"), "stretches")
    several = cut(held.groupBy("anchor").agg(F.min("row").alias("a"), F.max("row").alias("b")).filter("a < b").select("anchor"), "repeated-anchors")
    near = cut(held.join(several, "anchor"), "near-stretches")
    least, first_row, first_doc = _first_place(names)
    wholes = cut(near.groupBy("anchor", "whole").agg(least).select("anchor", "whole", first_row, first_doc), "whole-stretches")
    placed = cut(near.join(wholes, ["anchor", "whole"]), "placed-stretches")
    again = placed.filter("row <> first_row").select("row", "first", "until", "first_doc")
    varied = cut(wholes.groupBy("anchor").count().filter("count > 1").select("anchor"), "varied-anchors")
    # rows with a stretch that an earlier row has as well are done with it: what is left is one row of each
    of_rows = cut(placed.filter("row = first_row").join(varied, "anchor", "left_semi").groupBy("row").agg(F.collect_set(F.struct("first", "until")).alias("stretches")), "rows-of-stretches")
    left = texts.join(sized(of_rows.select("row")), "row", "left_semi").join(of_rows, "row")
    found = repeated_runs(left.mapInArrow(tidied(windowed), f"span long, check long, {own_types}first int, until int"))
    return again.unionByName(found.filter("elsewhere").drop("elsewhere"))


def _first_place(names: list[str]) -> tuple:
    """The aggregate of the least place of a group, and from it first_row and first_doc. ``names``: row; doc_id where it is not the row."""
    if "doc_id" in names:
        least = F.min(F.struct(F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("place"), "row", "doc_id")).alias("least")
        return least, F.col("least.row").alias("first_row"), F.col("least.doc_id").alias("first_doc")
    return F.min("row").alias("least"), F.col("least").alias("first_row"), F.col("least").alias("first_doc")


def repeated_runs(spans: DataFrame) -> DataFrame:
    """row, first, until, first_doc of every run of ``spans`` (see :func:`runs`) that is not the first place of its span, and elsewhere: is that in another row?"""
    by = ["span", "check"]
    held = cut(spans, "runs")
    # both small sides are written before their joins, so that these have plain exchanges and AQE can split a hot span
    least, *names = _first_place(held.columns)
    spans = cut(held.groupBy(*by).agg(F.count(F.lit(1)).alias("places"), least).filter("places > 1").select(*by, *names), "repeated-spans")
    placed = cut(held.select(*by, "row", "first", "until").join(spans, by), "repeated-runs")
    begins = cut(placed.filter("row = first_row").groupBy(*by).agg(F.min("first").alias("first_at")), "first-places")
    return placed.join(begins, by).filter("row <> first_row or first <> first_at").select("row", "first", "until", "first_doc", (F.col("row") != F.col("first_row")).alias("elsewhere"))


def _stretches(n: int, runs_: list[tuple[int, int]]) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Which of ``n`` places runs cover, and the stretches of such places."""
    gone = np.zeros(n + 2, np.int64)
    for a, b in runs_:
        gone[a] += 1
        gone[b] -= 1
    gone = np.cumsum(gone)[:n] > 0
    edges = np.diff(np.concatenate([[0], gone.astype(np.int64), [0]]))
    return gone, list(zip(np.flatnonzero(edges == 1).tolist(), np.flatnonzero(edges == -1).tolist(), strict=True))


def without_sentences(text: bytes, runs_: list[tuple[int, int]], passages: list[tuple[int, int]] = ()) -> tuple[bytes, list[tuple[int, int]], int, list[tuple[int, int]]]:
    """The text without the sentences of the runs and the words of the passages, the spans of sentences removed, the number of sentences, and the stretches of words that passages remove."""
    hashes, first, starts, _ = sentences_of(text)
    n = len(first) - 1
    spans, stretches = _stretches(n, runs_)[1], _stretches(len(hashes), passages)[1]
    byte_of = [*starts.tolist(), len(text)]
    parts, at = [], 0
    for a, b in _stretches(len(hashes), [*((first[a], first[b]) for a, b in spans), *stretches])[1]:
        parts.append(text[at : byte_of[a]])
        at = byte_of[b]
    return b"".join([*parts, text[at:]]), spans, n, stretches


def repeated_sentences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sentences: int = SENTENCES, long_words: int = LONG_WORDS, least_words: int = 0, passage_words: int = 0) -> DataFrame:
    """One row per row that loses text: doc_id, first_docs, sentences, removed, removed_spans, removed_passages, text (what stays).

    ``first_docs``: ids of documents that have the first places of the removed runs. ``removed_spans``: first sentence, and
    the one after the last, of every stretch removed. ``removed_passages``: the same in words, of what ``passage_words`` removes.
    """
    prepare(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    _, differing = repeated_ids(texts, "doc_id", "text")
    if has_rows(differing) or has_rows(texts.filter("doc_id is null")):
        rows = with_row_ids(texts, "doc_id", "text", differing).select(F.col(ROW).alias("row"), "doc_id", "text")
    else:
        rows = texts.withColumnRenamed("doc_id", "row")
    covered = repeated_runs(runs(rows, sentences, long_words, least_words)).drop("elsewhere").withColumn("passage", F.lit(False))
    if passage_words:
        covered = covered.unionByName(passages(rows, passage_words).withColumn("passage", F.lit(True)))
    place = F.struct("first", "until")
    covered = cut(covered.groupBy("row").agg(F.collect_set(F.when(~F.col("passage"), place)).alias("runs"), F.collect_set(F.when(F.col("passage"), place)).alias("passages"), F.array_sort(F.collect_set("first_doc")).alias("first_docs")), "covered")
    schema = pa.schema([("doc_id", pa.int64()), ("first_docs", pa.list_(pa.int64())), ("sentences", pa.int32()), ("removed", pa.int32()), ("removed_spans", pa.list_(pa.list_(pa.int32()))), ("removed_passages", pa.list_(pa.list_(pa.int32()))), ("text", pa.string())])

    def run(batches):
        for batch in batches:
            found, size = [], 0
            for k in range(batch.num_rows):
                x = {name: batch.column(name)[k].as_py() for name in ("doc_id", "first_docs", "runs", "passages")}
                kept, spans, n, stretches = without_sentences(batch.column("text")[k].as_py() or b"", *([(r["first"], r["until"]) for r in x[c]] for c in ("runs", "passages")))
                found.append({"doc_id": x["doc_id"], "first_docs": x["first_docs"], "sentences": n, "removed": sum(b - a for a, b in spans), "removed_spans": spans, "removed_passages": stretches, "text": kept.decode()})
                size += len(kept) + 200
                if size > 4 << 20:
                    yield pa.RecordBatch.from_pylist(found, schema=schema)
                    found, size = [], 0
            if found:
                yield pa.RecordBatch.from_pylist(found, schema=schema)

    name = F.col("doc_id") if "doc_id" in rows.columns else F.col("row")
    affected = rows.join(sized(covered.select("row")), "row", "left_semi").select("row", name.alias("doc_id"), F.encode(F.coalesce("text", F.lit("")), "utf-8").alias("text"))
    joined = affected.join(covered, "row").drop("row")
    return joined.mapInArrow(tidied(run), "doc_id long, first_docs array<long>, sentences int, removed int, removed_spans array<array<int>>, removed_passages array<array<int>>, text string")
