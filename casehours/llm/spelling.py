"""Spelling variants by PartEnum signatures.

A word is a multiset of letters, seen as a binary vector with one bit for every copy of a letter. One replaced code point
changes two bits, an inserted or deleted one changes one. The letters are dealt into ``PARTS`` groups; of the groups, every
choice that leaves out as many as bits may differ is enumerated, and what the word holds of the chosen groups is an exact
signature: two words within that distance agree on the choice that leaves their differing groups out. An edit also leaves
one half of the shorter word as it is, so a signature holds either the first or the last half; this parts the words that are
anagrams of each other. Words join on equal signatures, and each pair is verified by its edit distance.

Words are counted in tasks: texts become runs of letters, counts of a partition's texts are added up before the shuffle.

Defined results: a null text has no runs; a null id counts as the empty text before the colon; rows that repeat count as
often as they stand there; a run may be as long as its text; an empty table gives an empty table; further columns are
ignored. A word without near words, or whose near words are not frequent enough, is its own root.
"""

from __future__ import annotations

import itertools
import re
import zlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casehours.llm.common import cut, prepare, sized, tidied

#: A-Z to a-z in UTF-8; other letters stay.
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_RUN = re.compile("[a-zÀ-ÿ]+")
#: Different words that a task holds before it passes their counts on, and characters cut into runs at once.
HELD, PIECE = 200_000, 1 << 20

#: Words and their forms that may be broadcast.
BROADCAST_WORDS = 300_000

#: Groups of letters where two bits may differ, and where one may.
PARTS = {2: 4, 1: 3}


def _pieces(text: str):
    """Text in pieces of ``PIECE`` characters or so that end with a run."""
    at = 0
    while at < len(text):
        until = min(at + PIECE, len(text))
        run = _RUN.match(text, until - 1) if until < len(text) else None
        until = run.end() if run else until
        yield text[at:until]
        at = until


def runs_of(text: bytes) -> Counter:
    """Runs of letters of a text in UTF-8, A-Z in lower case, and how often each occurs."""
    whole = text.translate(_LOWER).decode()
    if len(whole) <= PIECE:
        return Counter(_RUN.findall(whole))
    counts = Counter()
    for piece in _pieces(whole):
        counts.update(_RUN.findall(piece))
    return counts


def altered(run: str, name: int, modulus: int) -> str:
    """The run; where ``modulus`` divides the hash ``name`` of document and run, without the code point at hash % length."""
    if name % modulus:
        return run
    at = name % len(run)
    return run[:at] + run[at + 1 :]


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_points: int = 6, least_count: int = 5, modulus: int = 199) -> DataFrame:
    """word string, n long: distinct altered runs of at least so many code points and occurrences."""
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def batch_of(held: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], schema=schema)

    def run(batches):
        held: Counter = Counter()
        for batch in batches:
            for name, text in zip(batch.column("name").to_pylist(), batch.column("text"), strict=True):
                begun = zlib.crc32(f"{name}:".encode())
                for word, n in runs_of(text.as_py() or b"").items():
                    word = altered(word, zlib.crc32(word.encode(), begun), modulus)
                    if len(word) >= least_points:
                        held[word] += n
                if len(held) >= HELD:
                    yield batch_of(held)
                    held = Counter()
        if held:
            yield batch_of(held)

    texts = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("name"), F.encode(F.coalesce(F.col(text_col), F.lit("")), "utf-8").alias("text"))
    return texts.mapInArrow(tidied(run), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


def _held_of(parts: int) -> Column:
    """For each group of letters, what the word holds of it, in order: letters at code points of that remainder."""
    letters = F.array_sort(F.split("word", ""))
    in_group = lambda k: F.array_join(F.filter(letters, lambda c: F.pmod(F.xxhash64(c), F.lit(parts)) == k), "")
    return F.array(*(in_group(k) for k in range(parts)))


def signatures(words: DataFrame, differ: int, shorter: int = 0) -> DataFrame:
    """signature long, word of every signature of ``words`` for vectors that differ in ``differ`` bits.

    ``shorter``: by how much the words of a pair are shorter than these; halves are those of the shorter word's length.
    """
    parts = PARTS[differ]
    choices = [c for c in itertools.combinations(range(parts), parts - differ)]
    length = F.length("word") - shorter
    half = F.floor(length / 2).cast("int")
    halves = (F.substring(F.col("word"), F.lit(1), half), F.substring(F.col("word"), F.length("word") - (length - half) + 1, length - half))
    held = words.select("word", _held_of(parts).alias("held"), length.alias("length"), F.array(*halves).alias("halves"))
    keys = [F.xxhash64(F.lit(side), F.lit(k), "length", F.element_at("halves", side + 1), *(F.element_at("held", g + 1) for g in choice)) for side in (0, 1) for k, choice in enumerate(choices)]
    return held.select(F.explode(F.array(*keys)).alias("signature"), "word")


def near_pairs(words: DataFrame) -> DataFrame:
    """a, b: every two words that differ by exactly one inserted, deleted or replaced code point, once."""
    one = F.levenshtein(F.col("a.word"), F.col("b.word"), 1) == 1
    pair = (F.col("a.word").alias("a"), F.col("b.word").alias("b"))
    same = signatures(words, 2)
    replaced = same.alias("a").join(same.alias("b"), (F.col("a.signature") == F.col("b.signature")) & (F.col("a.word") < F.col("b.word")) & one).select(*pair)
    inserted = signatures(words, 1).alias("a").join(signatures(words, 1, shorter=1).alias("b"), (F.col("a.signature") == F.col("b.signature")) & (F.length("a.word") < F.length("b.word")) & one).select(*pair)
    return replaced.unionByName(inserted).distinct()


def _roots(forms: DataFrame) -> DataFrame:
    """word, root of a written table word, form whose chains end: the distance followed doubles each round."""
    held = forms.select("word", F.col("form").alias("root"))
    while True:
        ahead = sized(held, BROADCAST_WORDS).select(F.col("word").alias("root"), F.col("root").alias("next"))
        stepped = cut(held.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        held = stepped.select("word", "root")
        if not stepped.filter("moved").limit(1).count():
            return held


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", times: int = 5, **counting) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of :func:`word_counts` (``counting`` has its parameters).

    ``form``: the near word that occurs most (ties: the smallest), if it occurs ``times`` as often as the word or more.
    """
    prepare(docs.sparkSession)
    words = cut(word_counts(docs, id_col, text_col, **counting), "words")
    pairs = cut(near_pairs(words), "near-pairs")
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near")).unionByName(pairs.select(F.col("b").alias("word"), F.col("a").alias("near")))
    counted = both.join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    best = counted.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    joined = words.join(best, "word", "left").withColumn("often", -F.col("best.less") >= times * F.col("n"))
    decided = cut(joined.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("often"), F.col("best.near")).alias("form"), F.when(F.col("often"), -F.col("best.less")).alias("form_n")), "forms")
    roots = _roots(decided.filter("form is not null"))
    return decided.join(sized(roots, BROADCAST_WORDS), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
