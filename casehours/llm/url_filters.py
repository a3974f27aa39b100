"""URL filters by a path-template tree, DataFrame functions only.

Every host has a tree of its paths' segments. Level by level, a child of a node that has few of the node's rows is variable
and becomes the wildcard; the others are literal. Literal siblings that are statistically alike merge into one branch: those
of one kind (inner or leaf) in order of their share of bad rows, as long as neighbours' shares do not differ by a test of two
proportions. The branch at a path's end is its template; a template is rejected by its share of bad labelled rows, which
is smoothed towards its host's share, and that towards the share of all rows.

Listed rules come first: a rule has a host and the beginning of a path, fits the host and its subdomains, and the longest wins.

A node has 1 / ``LEAST_SHARE`` literal children at most, so merging windows are small whatever a host has; everything else is
sums by key and joins with written tables of branches.

Defined results: a null url, or one without ``://``, has an empty host and path; such rows are one host, whose template is empty. Rows
with a null id have no label; rows that repeat an id share its label, and count as often as they stand there; labels of one
id add up (one bad is enough). Segments beyond ``MAX_DEPTH`` are one tail. Empty segments do not count in templates. An
empty table gives an empty table; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casehours.llm.common import cut, sized

#: (host, beginning of the path, allowed?)
Rule = tuple[str, str, bool]

MAX_DEPTH = 8
#: Rows of a literal child, and its share of its node's rows, at least.
LEAST_ROWS, LEAST_SHARE = 10, 0.05
#: Standard errors by which shares of bad rows differ.
APART = 1.96
#: Labelled rows that a prior counts for, and the share above which a template is rejected.
PRIOR_ROWS, REJECTED = 8, 0.5

#: Branches and templates (short texts) that may be broadcast.
BROADCAST_BRANCHES = 100_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; path: then up to ``?``, ``#`` or the end."""
    after = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1), F.lit(""))
    host = F.translate(F.regexp_extract(after, r"^[^/?#]*", 0), _UPPER, _LOWER)
    return host, F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """Text (host and path) and verdict (true: allow) of the longest rule that fits; nulls if none does."""
    ordered = sorted(rules, key=lambda r: (-len(r[0] + r[1]), -len(r[0]), r[0], r[1], r[2]))
    fits = lambda r: ((host == r[0]) | host.endswith(f".{r[0]}")) & path.startswith(r[1])
    choose = lambda value: F.coalesce(*(F.when(fits(r), F.lit(value(r))) for r in ordered)) if ordered else F.lit(None)
    return choose(lambda r: r[0] + r[1]).cast("string"), choose(lambda r: r[2]).cast("boolean")


def _bad_share(bad: str, labelled: str) -> Column:
    return (F.col(bad) + 1) / (F.col(labelled) + 2)


def branches(rows: DataFrame, depth: int) -> DataFrame:
    """host, branch, segment, next: the literal children of the nodes at this depth, and the branch that each belongs to.

    ``rows`` has host, branch (of the segments before), segments, labelled, bad.
    """
    node = ["host", "branch"]
    reached = rows.filter(F.size("segments") >= depth).select(*node, F.get("segments", F.lit(depth - 1)).alias("segment"), "labelled", "bad", (F.size("segments") > depth).alias("inner"))
    children = cut(reached.groupBy(*node, "segment").agg(F.count(F.lit(1)).alias("n"), F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad"), F.count_if("inner").alias("inner")), f"children-{depth}")
    totals = cut(children.groupBy(*node).agg(F.sum("n").alias("total")).filter(F.col("total") >= LEAST_ROWS), f"totals-{depth}")
    literal = children.filter(F.col("n") >= LEAST_ROWS).join(sized(totals, BROADCAST_BRANCHES), node).filter(F.col("n") >= LEAST_SHARE * F.col("total"))
    literal = literal.withColumn("inner", 2 * F.col("inner") >= F.col("n")).withColumn("share", _bad_share("bad", "labelled"))
    order = Window.partitionBy(*node, "inner").orderBy("share", "segment")
    literal = literal.withColumns({f"{c}_before": F.lag(c).over(order) for c in ("share", "bad", "labelled")})
    pooled = (F.col("bad") + F.col("bad_before") + 2) / (F.col("labelled") + F.col("labelled_before") + 4)
    error = F.sqrt(pooled * (1 - pooled) * (1 / (F.col("labelled") + 2) + 1 / (F.col("labelled_before") + 2)))
    alike = F.coalesce(F.col("share") - F.col("share_before") < APART * error, F.lit(False))
    runs = literal.withColumn("run", F.sum(F.when(alike, 0).otherwise(1)).over(order))
    merged = runs.groupBy(*node, "inner", "run").agg(F.array_sort(F.collect_list("segment")).alias("segments"))
    return merged.select(*node, F.explode("segments").alias("segment"), F.concat("branch", F.lit("/"), F.to_json("segments")).alias("next"))


def templates(rows: DataFrame) -> DataFrame:
    """``rows`` (host, segments, labelled, bad and others) with their template."""
    rows = cut(rows.withColumn("branch", F.lit("")), "paths")
    deepest = rows.agg(F.max(F.least(F.size("segments"), F.lit(MAX_DEPTH)))).first()[0] or 0
    for depth in range(1, deepest + 1):
        found = cut(branches(rows, depth), f"branches-{depth}")
        joined = rows.withColumn("segment", F.get("segments", F.lit(depth - 1))).join(sized(found, BROADCAST_BRANCHES), ["host", "branch", "segment"], "left")
        on = F.when(F.col("segment").isNull(), F.col("branch")).otherwise(F.coalesce("next", F.concat("branch", F.lit("/*"))))
        rows = joined.select(*(c for c in rows.columns if c != "branch"), on.alias("branch"))
        rows = cut(rows, f"paths-{depth}") if depth < deepest else rows
    tail = F.when(F.size("segments") > MAX_DEPTH, "/**").otherwise("")
    return rows.withColumn("template", F.concat("branch", tail)).drop("branch")


def scores(rows: DataFrame) -> DataFrame:
    """host, template, labelled, score (smoothed share of bad labelled rows) of every template of ``rows`` (written)."""
    found = cut(rows.groupBy("host", "template").agg(F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad")), "templates")
    of_all = found.agg(F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"), F.coalesce(F.sum("labelled"), F.lit(0)).alias("labelled")).first()
    prior = (of_all["bad"] + 1) / (of_all["labelled"] + 2)
    hosts = cut(found.groupBy("host").agg(((F.sum("bad") + PRIOR_ROWS * F.lit(prior)) / (F.sum("labelled") + PRIOR_ROWS)).alias("host_score")), "hosts")
    score = (F.col("bad") + PRIOR_ROWS * F.col("host_score")) / (F.col("labelled") + PRIOR_ROWS)
    return found.join(sized(hosts, BROADCAST_BRANCHES), "host").select("host", "template", "labelled", score.alias("score"))


def judged(pages: DataFrame, labels: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per row of ``pages``: page_id, host, path, rule, verdict (allow, block), template, score.

    ``labels``: id, bad (boolean or null). ``rules``: a listed few, evaluated in the scan.
    """
    host, path = host_and_path(F.col(url_col))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    marks = cut(labels.filter("id is not null and bad is not null").groupBy(F.col("id").cast("long").alias("page_id")).agg(F.max("bad").cast("int").alias("bad")), "url-labels")
    marked = rows.join(sized(marks), "page_id", "left").select("page_id", "host", "path", F.filter(F.split("path", "/"), lambda s: s != "").alias("segments"), F.col("bad").isNotNull().cast("int").alias("labelled"), F.coalesce("bad", F.lit(0)).alias("bad"))
    known = cut(templates(marked), "url-templates")
    found = cut(scores(known), "template-scores")
    rule, allowed = rule_of(F.col("host"), F.col("path"), rules)
    verdict = F.when(F.coalesce(allowed, F.col("score") <= REJECTED), "allow").otherwise("block")
    return known.join(sized(found.drop("labelled"), BROADCAST_BRANCHES), ["host", "template"]).select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"), "template", "score")
