"""Language identification by language-bitmask n-gram filters.

Every language has a Bloom filter of its frequent byte n-grams; the filters are bit-sliced, so that one slot
holds a bit of each language and one look-up gives all languages that contain an n-gram. Per document and
language the hits are counted, corrected for the filter's false positives, and the language with most decides.

Learning uses labelled documents only, at most ``sample_rows`` or so of each language, taken by the hash of
id and text; n-grams are counted over the whole texts of that sample.

Defined results: a text that is null or has no letter is ``und`` with score 0; a text with letters always gets a
learned language (the first in alphabetical order when none has a hit, score 0); ties go to the language first in
alphabetical order; labels that are null are not learned; without any label everything is ``und``; an empty table
gives an empty table. Any number of languages can be learned: a slot has a word of 64 bits for every 64 of them.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casehours.llm.common import ROW, prepare, settled, tidied, with_row_ids, without_row_ids

UNDETERMINED = "und"
GRAM = 4
HASHES = 3
WINDOW = 1 << 20
_MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


def _plain_bytes() -> np.ndarray:
    """A byte's lower case if it is an ASCII letter, itself beyond ASCII, a space for everything else."""
    table = np.full(256, 32, np.uint8)
    table[128:] = np.arange(128, 256)
    table[97:123] = np.arange(97, 123)
    table[65:91] = np.arange(97, 123)
    return table


PLAIN = _plain_bytes()


def padded_stream(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, each between spaces, and where each begins and the last ends."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    joined = pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), texts, pa.scalar("  ", pa.large_string()), pa.scalar("", pa.large_string()))
    _, offsets, data = joined.buffers()
    offsets = np.frombuffer(offsets, np.int64)[joined.offset : joined.offset + len(joined) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8))[offsets[0] : offsets[-1]], offsets - offsets[0]


def gram_windows(stream: np.ndarray, offsets: np.ndarray, window: int = WINDOW):
    """(document of each n-gram, hash of each n-gram), window by window; n-grams of two or more letters within a document."""
    for a in range(0, len(stream), window):
        raw = stream[max(0, a - 1) : a + window + GRAM - 1]
        plain = PLAIN[raw]
        # capitals of the Latin-1 letters, whose second byte in UTF-8 is 32 below that of the small letter
        plain[1:] += np.where((raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E) & (raw[1:] != 0x97), 32, 0).astype(np.uint8)
        plain = plain[a - max(0, a - 1) :]
        n = min(window, len(stream) - a, len(plain) - GRAM + 1)
        if n <= 0:
            continue
        letters = plain != 32
        filled = sum(letters[k : k + n].astype(np.int8) for k in range(GRAM))
        doc = np.searchsorted(offsets, np.arange(a, a + n), side="right") - 1 if len(offsets) > n else np.repeat(np.arange(len(offsets) - 1), np.clip(np.minimum(offsets[1:], a + n) - np.maximum(offsets[:-1], a), 0, None))
        good = np.flatnonzero((filled >= 2) & (np.arange(a + GRAM, a + n + GRAM) <= offsets[doc + 1]))
        h = np.zeros(n, np.uint64)
        for k in range(GRAM):
            h = (h << np.uint64(8)) | plain[k : k + n]
        yield doc[good], h[good]


def slots_of(grams: np.ndarray, bits: int) -> list[np.ndarray]:
    return [((grams * np.uint64(m)) >> np.uint64(64 - bits)).astype(np.int64) for m in _MULTIPLIERS[:HASHES]]


@dataclass
class LanguageModel:
    """Bit-sliced filters: word ``l // 64`` of ``slots[i]`` has bit ``l % 64`` if language l set slot i.

    ``false_rate[l]`` is the false positive rate of language l.
    """

    languages: list[str]
    bits: int
    slots: np.ndarray
    false_rate: np.ndarray

    def hits(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Hits by document and language, and n-grams by document."""
        stream, offsets = padded_stream(texts)
        counts, total = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts))
        for doc, grams in gram_windows(stream, offsets):
            if not len(doc):
                continue
            first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
            at = doc[first]
            total[at] += np.diff(np.append(first, len(doc)))
            slots = slots_of(grams, self.bits)
            for word in range(self.slots.shape[1]):
                masks = self.slots[slots[0], word]
                for slot in slots[1:]:
                    masks = masks & self.slots[slot, word]
                for k in range(64 * word, min(64 * word + 64, len(self.languages))):
                    counts[at, k] += np.add.reduceat((masks >> masks.dtype.type(k % 64)) & masks.dtype.type(1), first, dtype=np.int64)
        return counts, total

    def predict(self, texts: pa.Array, has_letter: np.ndarray) -> tuple[list[str], np.ndarray]:
        if not self.languages:
            return [UNDETERMINED] * len(texts), np.zeros(len(texts))
        counts, total = self.hits(texts)
        corrected = np.maximum(0, (counts - total[:, None] * self.false_rate) / (1 - self.false_rate))
        best = corrected.argmax(axis=1)
        score = np.where(has_letter, np.clip(corrected[np.arange(len(best)), best] / np.maximum(total, 1), 0, 1), 0.0)
        return [self.languages[b] if ok else UNDETERMINED for b, ok in zip(best, has_letter, strict=True)], score


def learn(labelled: DataFrame, sample_rows: int = 4000, least_share: float = 4e-5) -> LanguageModel:
    """Filters from labelled documents (doc_id, text, lang): n-grams with ``least_share`` of their language's n-grams."""
    spark = labelled.sparkSession
    labelled = labelled.filter("lang is not null and text is not null")
    sizes = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}
    languages = sorted(sizes)
    if not languages:
        return LanguageModel([], 1, np.zeros((2, 1), np.uint8), np.zeros(0))
    shares = {x: math.ceil(sample_rows / sizes[x] * 1e6) for x in languages}
    share, code = (F.create_map(*[F.lit(y) for pair in pairs for y in pair])[F.col("lang")] for pairs in (shares.items(), zip(languages, range(len(languages)), strict=True)))
    sample = labelled.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_000)) < share).select(code.alias("code"), "text")
    schema = pa.schema([("code", pa.int32()), ("gram", pa.int64()), ("n", pa.int64())])

    def count(batches):
        held: dict[int, list] = {}
        for batch in batches:
            codes = batch.column("code").to_numpy()
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                stream, offsets = padded_stream(part.column("text"))
                for doc, grams in gram_windows(stream, offsets):
                    own = codes[k : k + 500][doc]
                    for c in np.unique(own):
                        values, n = np.unique(grams[own == c], return_counts=True)
                        held.setdefault(int(c), []).append((values, n))
                for c, parts in held.items():
                    if len(parts) > 32:
                        held[c] = [_summed(parts)]
        for c, parts in held.items():
            values, n = _summed(parts)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), c, np.int32)), pa.array(values.view(np.int64)), pa.array(n.astype(np.int64))], schema=schema)

    counted = sample.mapInArrow(tidied(count), "code int, gram long, n long").groupBy("code", "gram").agg(F.sum("n").alias("n"))
    totals = counted.groupBy("code").agg(F.sum("n").alias("total"))
    chosen = counted.join(F.broadcast(totals), "code").filter(F.col("n") >= F.greatest(F.lit(2.0), F.col("total") * least_share)).select("code", "gram")
    # each language has 1 / least_share n-grams at most, so the model is bounded
    rows = chosen.toPandas()
    grams, codes = rows["gram"].to_numpy(np.int64).view(np.uint64), rows["code"].to_numpy()
    most = max(1, int(np.bincount(codes, minlength=1).max()) if len(codes) else 1)
    bits = max(10, math.ceil(math.log2(16 * most)))
    kind = next(t for n, t in ((8, np.uint8), (16, np.uint16), (32, np.uint32), (math.inf, np.uint64)) if len(languages) <= n)
    slots, rates = np.zeros((1 << bits, -(-len(languages) // 64)), kind), []
    for k in range(len(languages)):
        own = np.zeros(1 << bits, bool)
        for slot in slots_of(grams[codes == k], bits):
            own[slot] = True
        slots[:, k // 64] |= own.astype(kind) << kind(k % 64)
        rates.append(own.mean() ** HASHES)
    return LanguageModel(languages, bits, slots, np.array(rates))


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    values, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return values, np.bincount(at, weights=np.concatenate([p[1] for p in parts])).astype(np.int64)


def held_out(id_col: str = "doc_id"):
    """Documents whose labels are not learned: CRC-32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_rows: int = 4000) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row; learns from the labels of the rows not held out."""
    spark = docs.sparkSession
    prepare(spark)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).withColumn("held_out", held_out())
    model = spark.sparkContext.broadcast(learn(texts.filter(~F.col("held_out")), sample_rows))
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def run(batches):
        m = model.value
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                langs, score = m.predict(part.column("text"), part.column("has_letter").to_numpy(zero_copy_only=False))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(langs, pa.string()), pa.array(score)], schema=schema)

    fed = texts.select("doc_id", "held_out", "text", F.coalesce(F.rlike("text", F.lit(r"\p{L}")), F.lit(False)).alias("has_letter"))
    return fed.mapInArrow(tidied(run), "doc_id long, held_out boolean, lang_pred string, score double")


def keep_identified(docs: DataFrame, least_score: float = 0.1, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``docs`` without undetermined texts and texts whose best language has less than ``least_score`` of the n-grams."""
    keyed = with_row_ids(docs, id_col, text_col)

    def losers() -> DataFrame:
        found = identified(keyed, ROW, text_col, lang_col)
        return found.filter((F.col("lang_pred") == UNDETERMINED) | (F.col("score") < least_score)).select(F.col("doc_id").alias(ROW))

    return without_row_ids(keyed, settled(losers, "unidentified"))
