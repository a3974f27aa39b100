"""What text filters remove together and alone, by the Hart-Mas-Colell potential of removal games.

Every document fails some of the filters A to E. Of a coalition of filters the worth is the number of documents that fail
one of its filters, so a table of counts by source and by the set of failed filters says all: 32 counts a part at most are
what leaves the scan. The potential of a coalition is the mean, over its filters, of its worth plus the potential without
that filter, from the empty coalition up to all five; a filter's Shapley value is the grand potential minus the potential
without it. Potentials are held times the factorial of the coalition's size, so they are whole numbers. What a filter
removes at a step of an order is the worth of the coalition up to it minus the worth of the one before it.

Filters: A, fewer than 200 words; B, 100 * distinct words below 50 * words; C, 100 * characters A-Z above 2 * code points; D, one
of ``#$%&*|`` occurs; E, a row with a smaller id has the same text. Words are runs without white space.

Defined results: a null text is empty; a null source is the empty string, as an empty source is; a null id never fails E and is
no smaller id; rows that repeat the smallest id of their text do not fail E; labels of an id add up (one 1 is enough) and
hold for all rows of the id; rows without labels count as neither good nor toxic; an empty table gives an empty table; further
columns are ignored.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casehours.llm.common import cut, prepare, sized

FILTERS = "ABCDE"
#: Fixed values of the filters.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 200, 50, 2
MARKS = "[#$%&*|]"
WHITE = r"[\x20\x09-\x0D]+"
#: Groups of copies (a hash and an id) that may be broadcast.
BROADCAST_COPIES = 300_000


def failures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per row of ``docs``: doc_id, part, failed (bit k set: the row fails filter k), text hash. Filters A to D only."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = F.array_remove(F.split(text, WHITE), "")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(source_col), F.lit("")).alias("part"), text.alias("text"), words.alias("words"))
    counted = rows.select(
        "doc_id",
        "part",
        F.size("words").alias("n"),
        F.size(F.array_distinct("words")).alias("distinct"),
        F.length(F.regexp_replace("text", "[^A-Z]+", "")).alias("capitals"),
        F.length("text").alias("points"),
        F.col("text").rlike(MARKS).alias("marked"),
        F.sha2("text", 256).alias("text_hash"),
    )
    conditions = (F.col("n") < LEAST_WORDS, 100 * F.col("distinct") < LEAST_DISTINCT * F.col("n"), 100 * F.col("capitals").cast("long") > MOST_CAPITALS * F.col("points"), F.col("marked"))
    failed = sum((F.when(c, 1 << k).otherwise(0) for k, c in enumerate(conditions)), F.lit(0))
    return counted.select("doc_id", "part", failed.alias("failed"), "text_hash")


def with_copies(rows: DataFrame) -> DataFrame:
    """``rows`` (written) with the bit of E set where a smaller id has the same text."""
    firsts = rows.groupBy("text_hash").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter(F.col("first") < F.col("last"))
    # written before the join, which then has plain exchanges: AQE can split a large group of copies
    firsts = cut(firsts.select("text_hash", "first"), "copy-firsts")
    joined = rows.join(sized(firsts, BROADCAST_COPIES), "text_hash", "left")
    copy = F.when(F.col("doc_id") > F.col("first"), 1 << FILTERS.index("E")).otherwise(0)
    return joined.select("doc_id", "part", (F.col("failed") + copy).alias("failed"))


def _worths(counts: str) -> Column:
    """For each of the 32 coalitions, the sum of the counts of failure sets that meet it."""
    sets = F.sequence(F.lit(0), F.lit(31))
    return F.transform(sets, lambda c: F.aggregate(sets, F.lit(0).cast("long"), lambda total, f: total + F.when(c.bitwiseAND(f) != 0, F.coalesce(F.element_at(counts, f), F.lit(0))).otherwise(0)))


def _worth(game: str, coalition: Column) -> Column:
    return F.element_at(game, coalition + 1)


def with_potentials(games: DataFrame, game: str = "removed") -> DataFrame:
    """Columns ``q0`` to ``q31``: the potential of each coalition of an array of worths, times the factorial of its size."""
    for size in range(len(FILTERS) + 1):
        of_size = [c for c in range(32) if c.bit_count() == size]
        without = lambda c: [c & ~(1 << k) for k in range(5) if c >> k & 1]
        games = games.withColumns({f"q{c}": sum((F.col(f"q{s}") for s in without(c)), F.element_at(game, c + 1) * factorial(size - 1)) if size else F.lit(0).cast("long") for c in of_size})
    return games


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """For every part, order of the filters and step: part, filter_order, step, filter, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    ``shapley``: the filter's Shapley value times 120, which is what it removes summed over all orders.
    """
    prepare(docs.sparkSession)
    rows = with_copies(cut(failures(docs, id_col, text_col, source_col), "failures"))
    marks = cut(labels.filter("doc_id is not null").groupBy("doc_id").agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic")).filter("good or toxic"), "marks")
    marked = rows.join(sized(marks), "doc_id", "left")
    counts = marked.groupBy("part", "failed").agg(F.count(F.lit(1)).alias("n"), F.count_if("good").alias("good"), F.count_if("toxic").alias("toxic"))
    counts = cut(counts, "failure-counts")
    of = lambda c: F.map_from_entries(F.collect_list(F.struct("failed", c))).alias(c)
    parts = counts.groupBy("part").agg(F.sum("n").alias("rows"), of("n"), of("good"), of("toxic"))
    games = with_potentials(parts.select("part", "rows", _worths("n").alias("removed"), _worths("good").alias("good"), _worths("toxic").alias("toxic")))
    everything = 2 ** len(FILTERS) - 1
    shapley = F.array(*(F.col(f"q{everything}") - len(FILTERS) * F.col(f"q{everything & ~(1 << k)}") for k in range(5)))
    games = games.select("part", "rows", "removed", "good", "toxic", shapley.alias("shapleys"))

    orders = ["".join(p) for p in permutations(FILTERS)]
    steps = games.withColumn("filter_order", F.explode(F.split(F.lit(" ".join(orders)), " "))).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    bit = lambda at: f"shiftleft(1, instr('{FILTERS}', substr(filter_order, {at}, 1)) - 1)"
    steps = steps.withColumn("own", F.expr(bit("step"))).withColumn("before", F.expr(f"aggregate(filter(sequence(1, {len(FILTERS)}), s -> s < step), 0, (t, s) -> t + {bit('s')})"))
    after, all_sets = F.col("before") + F.col("own"), F.lit(everything)
    added = lambda game: _worth(game, after) - _worth(game, F.col("before"))
    return steps.select(
        "part",
        "filter_order",
        F.col("step").cast("int").alias("step"),
        F.expr("substr(filter_order, step, 1)").alias("filter"),
        (F.col("rows") - _worth("removed", after)).alias("kept"),
        added("removed").alias("removed"),
        (_worth("removed", F.col("own")) - added("removed")).alias("redundant"),
        (_worth("removed", all_sets) - _worth("removed", all_sets - F.col("own"))).alias("unique_fails"),
        added("good").alias("good_lost"),
        added("toxic").alias("toxic_lost"),
        F.element_at("shapleys", F.instr(F.lit(FILTERS), F.expr("substr(filter_order, step, 1)"))).alias("shapley"),
    )
