"""Near-duplicates by a chosen-path set similarity join.

Every document is a set of word shingles. In each of ``TREES`` independent trees a document branches to the child
named by its minwise shingle under that level's hash; documents in one node share a path. A node of ``NODE``
documents or fewer is compared exhaustively, by length and by two-bit minwise sketches. A larger node links each
document to its centre (again by sketch) and branches to the next level. Whatever passes is confirmed on the full
sets, so no link is wrong; the trees make misses rare (a pair at the threshold shares no node of one level with
probability 0.25^16, of two levels with 0.44^16).

Work stays in proportion to the documents: equal sets are joined first; then one best partner of each document is
confirmed, and of the other candidates only those that would still join two components. Documents of nodes that are
large at the last level and hold several components gather in clusters; a cluster is cut into blocks, and every pair of
blocks is one task that compares documents of different components and confirms links at once. So nothing is capped,
no task holds more than two blocks, and a cluster of s documents costs s * s / BLOCK rows and no pair rows.

Defined results: a null text is empty; texts without words have ``n_shingles`` 0 and are linked with nothing; rows
with a null id are linked with nothing and have a null component; rows that share an id are one document with the links of
all its texts, whatever their order (``n_shingles`` is each row's own); an empty table gives an empty table; further columns
are ignored. Where rows are dropped, one of each group stays, of equal rows which one is not said.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casehours.llm.common import ROW, cut, has_rows, kept_rows, prepare, repeated_ids, repeated_rows, settled, sized, tidied, with_row_ids
from casehours.llm.components import components
from casehours.llm.shingles import mix, set_slices

TREES, LEVELS, NODE = 16, 4, 64
#: Minwise values in a sketch, two bits of each.
SKETCH = 192
#: Values of which both bits must agree: at similarity 0.75 the mean is 156 and the deviation 5.4.
AGREE = 125
BLOCK = 512
BITS = [f"b{k}" for k in range(SKETCH * 2 // 64)]
_LOW_BITS = 0x5555555555555555

_SEEDS = mix(np.arange(1, 2 * SKETCH + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_FLIPS, _FACTORS = _SEEDS[:SKETCH], _SEEDS[SKETCH:] | np.uint64(1)

SKETCH_SCHEMA = "doc_id long, n int, h0 long, h1 long, " + ", ".join(f"{b} long" for b in BITS) + ", keys array<int>"


def sketch(sets: list[np.ndarray]) -> dict[str, np.ndarray]:
    """Sizes, set hashes, sketches and path keys of non-empty sets."""
    sizes = np.array([len(s) for s in sets], np.int64)
    flat = np.concatenate(sets)
    first = np.cumsum(sizes) - sizes
    least = np.empty((len(sets), SKETCH), np.uint64)
    for k in range(SKETCH):
        least[:, k] = np.minimum.reduceat((flat ^ _FLIPS[k]) * _FACTORS[k], first)
    least = mix(least)
    two = np.stack([least & np.uint64(1), (least >> np.uint64(1)) & np.uint64(1)], axis=2).reshape(len(sets), -1)
    bits = np.packbits(two.astype(np.uint8), axis=1).view(np.int64)
    keys = (least[:, : TREES * LEVELS] >> np.uint64(32)).astype(np.uint32).view(np.int32)
    return {"n": sizes, "h0": np.add.reduceat(mix(flat), first), "h1": np.bitwise_xor.reduceat(mix(flat + np.uint64(1)), first), "bits": bits, "keys": keys}


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, n, set hash, sketch, path keys of a table doc_id, text; empty sets have n 0 and nulls."""
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int32()), ("h0", pa.int64()), ("h1", pa.int64()), *((b, pa.int64()) for b in BITS), ("keys", pa.list_(pa.int32()))])

    def run(batches):
        for batch in batches:
            names, at = batch.column("doc_id"), 0
            texts = (x.as_buffer() or b"" for x in batch.column("text"))
            for sets in set_slices(texts):
                full = [k for k, s in enumerate(sets) if len(s)]
                empty = [k for k, s in enumerate(sets) if not len(s)]
                own = names.slice(at, len(sets))
                at += len(sets)
                if full:
                    s = sketch([sets[k] for k in full])
                    keys = pa.ListArray.from_arrays(pa.array(np.arange(0, s["keys"].size + 1, TREES * LEVELS, dtype=np.int32)), pa.array(s["keys"].reshape(-1)))
                    yield pa.RecordBatch.from_arrays([own.take(pa.array(full)), pa.array(s["n"].astype(np.int32)), pa.array(s["h0"].view(np.int64)), pa.array(s["h1"].view(np.int64)), *(pa.array(np.ascontiguousarray(s["bits"][:, k])) for k in range(len(BITS))), keys], schema=schema)
                if empty:
                    nothing = [pa.nulls(len(empty), f.type) for f in schema][2:]
                    yield pa.RecordBatch.from_arrays([own.take(pa.array(empty)), pa.array([0] * len(empty), pa.int32()), *nothing], schema=schema)

    return docs.select(F.col("doc_id"), F.encode(F.coalesce("text", F.lit("")), "utf-8").alias("text")).mapInArrow(tidied(run), SKETCH_SCHEMA)


def full_sets(docs: DataFrame) -> DataFrame:
    """id, shingles (array of long, sorted) of a table doc_id, text."""
    schema = pa.schema([("id", pa.int64()), ("shingles", pa.list_(pa.int64()))])

    def run(batches):
        for batch in batches:
            names, at = batch.column("doc_id"), 0
            for sets in set_slices(x.as_buffer() or b"" for x in batch.column("text")):
                offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([names.slice(at, len(sets)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(sets).view(np.int64)))], schema=schema)
                at += len(sets)

    return docs.select("doc_id", F.encode(F.coalesce("text", F.lit("")), "utf-8").alias("text")).mapInArrow(tidied(run), "id long, shingles array<long>")


def _differing(a: str, b: str):
    """Number of sketch values that differ in either bit."""
    def pairs(c: str):
        x = F.col(f"{a}.{c}").bitwiseXOR(F.col(f"{b}.{c}"))
        return F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(_LOW_BITS)))

    return sum((pairs(c) for c in BITS), F.lit(0))


def _alike(a: str, b: str):
    """Could rows a and b be linked? Exact by length, all but certain by sketch."""
    return (F.least(f"{a}.n", f"{b}.n") * 100 >= F.greatest(f"{a}.n", f"{b}.n") * 75) & (_differing(a, b) <= SKETCH - AGREE)


def _pair(a: str, b: str) -> list:
    return [F.least(f"{a}.id", f"{b}.id").alias("v"), F.greatest(f"{a}.id", f"{b}.id").alias("u"), _differing(a, b).cast("int").alias("differ")]


def candidates(sets: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Candidate pairs (u, v, differ) of sketched sets (id, n, bits, keys), and the rows of nodes large at the last level; None if there are none."""
    branch = F.transform(F.sequence(F.lit(0), F.lit(TREES - 1)), lambda t: F.struct(t.alias("tree"), F.slice("keys", t * LEVELS + 1, F.lit(LEVELS)).alias("steps")))
    rows = sets.select("id", "n", *BITS, F.explode(branch).alias("x")).select("id", "n", *BITS, F.col("x.tree").alias("tree"), F.col("x.steps").alias("steps"))
    rows = rows.withColumn("path", F.xxhash64("tree", F.element_at("steps", 1)))
    found = []
    for level in range(2, LEVELS + 2):
        # written first: the join then has plain exchanges on both sides, and AQE can split a large node
        nodes = cut(rows.groupBy("path").agg(F.count(F.lit(1)).alias("size"), F.min("id").alias("low"), F.max("id").alias("high")).filter("size > 1"), f"node-sizes-{level - 1}")
        held = cut(rows.join(nodes, "path").withColumn("centre", F.when(F.col("tree") % 2 == 0, F.col("low")).otherwise(F.col("high"))).drop("low", "high"), f"nodes-{level - 1}")
        narrow = held.select("path", "id", "n", *BITS, "size", "centre")
        small, large = narrow.filter(F.col("size") <= NODE), narrow.filter(F.col("size") > NODE)
        found.append(small.alias("a").join(small.alias("b"), (F.col("a.path") == F.col("b.path")) & (F.col("a.id") < F.col("b.id")) & _alike("a", "b")).select(*_pair("a", "b")))
        if not has_rows(nodes.filter(F.col("size") > NODE)):
            large = None
            break
        centres = large.filter("id = centre").drop("size", "centre")
        found.append(large.alias("a").join(centres.alias("b"), (F.col("a.path") == F.col("b.path")) & (F.col("a.id") != F.col("b.id")) & _alike("a", "b")).select(*_pair("a", "b")))
        if level > LEVELS:
            break
        rows = held.filter(F.col("size") > NODE).select("id", "n", *BITS, "tree", "steps", F.xxhash64("path", F.element_at("steps", level)).alias("path"))
    pairs = found[0]
    for more in found[1:]:
        pairs = pairs.unionByName(more)
    return cut(pairs.groupBy("u", "v").agg(F.min("differ").alias("differ")), "pairs"), large


def sets_of(ids: DataFrame, docs: DataFrame, one_each: bool) -> DataFrame:
    """Full sets of the documents (doc_id, text) with these ids, one row of each id. ``one_each``: no two rows of ``docs`` share an id."""
    sets = full_sets(docs.join(sized(ids), "doc_id", "left_semi"))
    return sets if one_each else sets.dropDuplicates(["id"])


def confirmed(pairs: DataFrame, docs: DataFrame, one_each: bool = False) -> DataFrame:
    """Pairs (u, v) whose full sets have 100 * intersection >= 75 * union. ``pairs`` must be written."""
    ids = cut(pairs.select(F.col("u").alias("doc_id")).unionByName(pairs.select(F.col("v").alias("doc_id"))).distinct(), "pair-ids")
    # made distinct before they are written: the joins then have plain exchanges, and AQE can split the pairs of a hub
    sets = cut(sets_of(ids, docs, one_each), "sets")
    whole = pairs.select("u", "v").join(sets.select(F.col("id").alias("u"), F.col("shingles").alias("su")), "u").join(sets.select(F.col("id").alias("v"), F.col("shingles").alias("sv")), "v")
    common = F.size(F.array_intersect("su", "sv"))
    return cut(whole.filter(100 * common >= 75 * (F.size("su") + F.size("sv") - common)).select("u", "v"), "links")


def _between(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs whose ends have different components."""
    of = lambda name: labels.select(F.col("id").alias(name), F.col("component").alias(f"c{name}"))
    both = pairs.join(of("u"), "u", "left").join(of("v"), "v", "left")
    return both.filter(F.coalesce("cu", "u") != F.coalesce("cv", "v")).select("u", "v")


def _block_links(batch: pa.Table) -> pa.Table:
    """Links between documents of different components in a pair of blocks; one link for two components is enough."""
    rows = {c: batch.column(c).to_numpy() for c in ("id", "n", "component", "block", *BITS)}
    sets = [x.values.to_numpy() for x in batch.column("shingles")]
    low, high = batch.column("i")[0].as_py(), batch.column("j")[0].as_py()
    sketches_ = np.stack([rows[b] for b in BITS], axis=1).view(np.uint64)
    _, comp = np.unique(rows["component"], return_inverse=True)
    left = np.flatnonzero(rows["block"] == low)
    right = np.flatnonzero(rows["block"] == high)
    out: list[tuple[int, int]] = []
    for at, a in enumerate(left):
        others = right[at + 1 :] if low == high else right
        others = others[comp[others] != comp[a]]
        n = rows["n"][others]
        others = others[np.minimum(n, rows["n"][a]) * 100 >= np.maximum(n, rows["n"][a]) * 75]
        if not len(others):
            continue
        x = sketches_[others] ^ sketches_[a]
        differ = np.bitwise_count((x | (x >> np.uint64(1))) & np.uint64(_LOW_BITS)).sum(axis=1, dtype=np.int64)
        near = np.flatnonzero(differ <= SKETCH - AGREE)
        for k in near[np.argsort(differ[near], kind="stable")]:
            b = others[k]
            if comp[b] == comp[a]:
                continue
            common = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
            if 100 * common >= 75 * (len(sets[a]) + len(sets[b]) - common):
                out.append((max(rows["id"][a], rows["id"][b]), min(rows["id"][a], rows["id"][b])))
                comp[comp == comp[b]] = comp[a]
    u, v = zip(*out, strict=True) if out else ((), ())
    return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})


def links_in_large_nodes(large: DataFrame, labels: DataFrame, docs: DataFrame, one_each: bool = False) -> DataFrame | None:
    """Links that would join components within nodes large at the last level; None if no such node has several components."""
    placed = large.join(labels, "id", "left").select("path", "id", "n", *BITS, F.coalesce("component", "id").alias("component"))
    placed = cut(placed, "large-nodes")
    several = placed.groupBy("path").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.min("id").alias("v")).filter("low <> high").select("path", "v")
    edges = cut(placed.join(several, "path").select(F.col("id").alias("u"), "v"), "large-edges")
    if not has_rows(edges):
        return None
    clusters = cut(components(edges).withColumnRenamed("component", "cluster"), "clusters")
    members = placed.dropDuplicates(["id"]).select("id", "n", "component", *BITS).join(clusters, "id")
    blocks = clusters.groupBy("cluster").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    ids = clusters.select(F.col("id").alias("doc_id"))
    sets = sets_of(ids, docs, one_each)
    rows = members.join(blocks, "cluster").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).join(sets, "id")
    dealt = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("cluster", "id", "n", "component", *BITS, "shingles", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    return cut(dealt.groupBy("cluster", "i", "j").applyInArrow(_block_links, "u long, v long"), "large-links")


def links_of_ids(held: DataFrame, classes: DataFrame, known: DataFrame) -> DataFrame:
    """Links (u, v) between the classes of the rows of each repeated id. ``known``: row, doc_id of those rows, written."""
    of_row = known.join(held.filter("n > 0").select(F.col("doc_id").alias("row"), "h0", "h1", "n"), "row").join(classes, ["h0", "h1", "n"]).select("doc_id", "id")
    least = cut(of_row.groupBy("doc_id").agg(F.min("id").alias("v")), "least-of-ids")
    return cut(of_row.join(sized(least), "doc_id").filter("id <> v").select(F.col("id").alias("u"), "v").distinct(), "links-of-ids")


def _labelled(texts: DataFrame, one_each: bool, known: DataFrame | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of a table doc_id, text. ``one_each``: no two rows share an id.

    ``known``: where ids have several texts, ``texts`` has row ids instead, and this written table has row and doc_id of the
    rows of such ids; components are then named by row ids too.
    """
    held = cut(sketches(texts), "sketches")
    linkable = held.filter("n > 0 and doc_id is not null")
    classes = cut(linkable.groupBy("h0", "h1", "n").agg(F.min("doc_id").alias("id")), "classes")
    # one row of each class, whichever: equal sets have equal sketches
    chosen = linkable.select(F.col("doc_id").alias("id"), "h0", "h1", "n", *BITS, "keys").join(classes, ["id", "h0", "h1", "n"], "left_semi").dropDuplicates(["id", "h0", "h1"])
    pairs, large = candidates(chosen)

    first = cut(pairs.groupBy("u").agg(F.min(F.struct("differ", "v")).alias("best")).select("u", "best.v"), "first-pairs")
    links = confirmed(first, texts, one_each)
    if known is not None:
        links = links.unionByName(links_of_ids(held, classes, known))
    labels = components(links)
    others = cut(_between(pairs, labels), "other-pairs")
    if has_rows(others):
        links = links.unionByName(confirmed(others, texts, one_each))
        labels = components(links)
    labels = cut(labels, "labels")

    more = None if large is None else links_in_large_nodes(large, labels, texts, one_each)
    if more is not None:
        labels = components(links.unionByName(more))

    linked = classes.join(labels, "id", "left").select("h0", "h1", "n", F.coalesce("component", "id").alias("component_id"))
    # rows that cannot be linked get keys of their own, so that they do not meet in one task
    own = F.xxhash64("doc_id", F.lit("own"))
    rows = held.select("doc_id", "n", F.coalesce("h0", own).alias("h0"), F.coalesce("h1", own).alias("h1"))
    return rows.join(linked, ["h0", "h1", "n"], "left").select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))


def _labelled_by_rows(texts: DataFrame, differing: DataFrame) -> DataFrame:
    """The same where ids have several texts: texts get ids of their own, rows of one id are linked, and components named by documents."""
    identified = texts.filter("doc_id is not null")
    keyed = with_row_ids(identified, "doc_id", "text", differing)
    known = cut(keyed.join(sized(differing.withColumnRenamed("id", "doc_id")), "doc_id", "left_semi").select(F.col(ROW).alias("row"), "doc_id").distinct(), "rows-of-ids")
    labelled = _labelled(keyed.select(F.col(ROW).alias("doc_id"), "text"), False, known).withColumnsRenamed({"doc_id": "row", "component_id": "label"})
    named = cut(labelled.join(sized(known), "row", "left").select("n_shingles", "label", F.coalesce("doc_id", "row").alias("doc_id"), F.col("doc_id").isNotNull().alias("repeated")), "row-labels")
    # a text without words has the links of the other texts of its id
    of_ids = cut(named.filter("repeated and n_shingles > 0").groupBy("doc_id").agg(F.min("label").alias("id_label")), "labels-of-ids")
    named = cut(named.join(sized(of_ids), "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("id_label", "label").alias("label")), "labels")
    least = cut(named.groupBy("label").agg(F.min("doc_id").alias("component_id")), "component-names")
    without_ids = sketches(texts.filter("doc_id is null")).select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.lit(None).cast("long").alias("component_id"))
    return named.join(sized(least), "label").select("doc_id", "n_shingles", "component_id").unionByName(without_ids)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept."""
    prepare(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    repeats, differing = repeated_ids(texts, "doc_id", "text")
    out = _labelled_by_rows(texts, differing) if has_rows(differing) else _labelled(texts, not repeats)
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each group of near-duplicates, the one with the smallest id; columns unchanged.

    Rows with a null id, or one that has several texts, take part as rows of their own (see ``with_row_ids``), so an id's other texts stay.
    """
    prepare(docs.sparkSession)
    keyed = with_row_ids(docs, id_col, text_col)
    twins = repeated_rows(keyed)
    twins = twins if has_rows(twins) else None
    texts = keyed.select(F.col(ROW).alias("doc_id"), F.col(text_col).alias("text"))
    losers = settled(lambda: _labelled(texts, twins is None).filter("doc_id <> component_id").select(F.col("doc_id").alias(ROW)).distinct(), "near-losers")
    return kept_rows(keyed, losers, twins)
