"""Operator 12: audit of how filters interact, in every order they could be applied in.

The orders of the filters form a trie. What is left of the rows at a node of it depends on which filters were applied, not on their
order, so a state is a set of filters, and is visited once: five filters have 326 nodes and 32 states. States are visited depth first;
the survivors of a state are a persisted DataFrame, made from its parent's by applying one filter, and let go once all states below it
are done, so that there are never more of them than filters. At each state one aggregation counts what every filter not yet applied
does remove from the survivors: the trie's edges that leave it. Rows of the result are the trie's paths, looked up among the edges.

The filters' verdicts are computed once a row and written down with the row's part: texts are read once.

Defined results: a null text is as an empty one, a null source the part ``""``. A row without an id has no copy with a smaller id and is
none to others; rows with equal ids and texts are not copies of each other. Repeated labels count if any does, each for all rows of
its id. An empty table has no parts and so no rows. Other columns are not looked at, whatever their names. One text's words are held at once.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations, permutations
from math import factorial
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import exchange as X

WORDS = r"[\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """Maximal runs of anything but spaces, tabs and line ends."""
    return F.filter(F.split(text, WORDS), lambda w: w != "")


#: What fails: too few words, words that are too often repeated, too many capitals, marks of markup, and (by ``failures``) copies.
FILTERS = {
    "A": lambda t: F.size("words") < 200,
    "B": lambda t: 100 * F.size(F.array_distinct("words")) < 50 * F.size("words"),
    "C": lambda t: 100 * F.regexp_count(t, F.lit("[A-Z]")) > 2 * F.length(t),
    "D": lambda t: t.rlike("[#$%&*|]"),
    "E": None,
}


def failures(docs: DataFrame, labels: DataFrame, filters: dict = FILTERS, id_col: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """``part``, a boolean for each filter, and the labels ``good`` and ``toxic`` of every row.

    The filter without a function fails copies of a text that a smaller id has, wherever that is. Copies are told by digests of 256 bits.
    """
    own = X.pick(docs, id=id_col, text=text, source=source).select("id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"))
    read = own.select("id", "part", "text", words(F.col("text")).alias("words"))
    verdicts = X.materialize(read.select("id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), *(f(F.col("text")).alias(name) for name, f in filters.items() if f)))
    first = verdicts.groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1 AND first IS NOT NULL").select("digest", "first")
    known = X.pick(labels, id=id_col, quality="quality", toxic="toxic").groupBy("id").agg(*(F.max(F.coalesce(F.col(c) == 1, F.lit(False))).alias(to) for c, to in (("quality", "good"), ("toxic", "toxic"))))
    both = verdicts.join(first, "digest", "left").join(known, "id", "left")
    copied = F.coalesce(F.col("first") < F.col("id"), F.lit(False))
    return both.select("part", *(F.col(name) if f else copied.alias(name) for name, f in filters.items()), *(F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")))


def _name(state: frozenset[str]) -> str:
    return "".join(sorted(state))


def _edges(survivors: DataFrame, state: frozenset[str], names: list[str]) -> DataFrame:
    """Of each part and each filter that is not in the state: what is there, and what the filter removes of it."""
    rest = [f for f in names if f not in state]
    alone = lambda f: F.col(f) & ~reduce(or_, (F.col(g) for g in names if g != f), F.lit(False))
    counts = [
        F.struct(
            F.lit(f).alias("filter"), F.count_if(F.col(f)).alias("removed"), F.count_if(F.col(f) & F.col("good")).alias("good_lost"),
            F.count_if(F.col(f) & F.col("toxic")).alias("toxic_lost"), F.count_if(alone(f)).alias("unique_fails"),
        ) for f in rest
    ]
    return survivors.groupBy("part").agg(F.count("*").alias("there"), F.array(*counts).alias("each")).select("part", F.lit(_name(state)).alias("state"), "there", F.inline("each"))


def audit(failed: DataFrame, names: list[str], part: str = "part") -> DataFrame:
    """A row for each part, order of the filters and step: ``kept``, ``removed``, ``redundant``, ``unique_fails``, ``good_lost``, ``toxic_lost`` and ``shapley``.

    ``failed`` has a boolean for each filter, and ``good`` and ``toxic``; see ``failures``.
    """
    spark = failed.sparkSession
    rows = X.materialize(X.pick(failed, part=part, good="good", toxic="toxic", **{f: f for f in names}))
    folder = X.shared_dir(spark)
    done: set[frozenset[str]] = set()

    def visit(state: frozenset[str], survivors: DataFrame) -> None:
        done.add(state)
        survivors = survivors.persist()
        _edges(survivors, state, names).write.mode("append").parquet(folder)
        for f in names:
            below = state | {f}
            if f not in state and below not in done and len(below) < len(names):
                visit(below, survivors.where(~F.col(f)))
        survivors.unpersist()

    visit(frozenset(), rows)
    edges = spark.read.parquet(folder)
    # a part that nothing is left of at a state has no rows there: zeros
    states = [(_name(frozenset(some)), f) for n in range(len(names)) for some in combinations(names, n) for f in names if f not in some]
    orders = [("".join(order), step + 1, _name(frozenset(order[:step])), order[step]) for order in permutations(names) for step in range(len(names))]
    of_part = edges.where("state = ''").select("part", "filter", F.col("removed").alias("failing"), "unique_fails")
    grid = F.broadcast(spark.createDataFrame(states, "state string, filter string"))
    weight = F.element_at(F.array(*(F.lit(factorial(n) * factorial(len(names) - 1 - n)) for n in range(len(names)))), F.length("state") + 1)
    whole = of_part.join(grid, "filter").join(edges.drop("unique_fails"), ["part", "state", "filter"], "left").fillna(0)
    shapley = whole.groupBy("part", "filter").agg(F.sum(F.col("removed") * weight).alias("shapley"))
    paths = F.broadcast(spark.createDataFrame(orders, "filter_order string, step int, state string, filter string"))
    return whole.join(shapley, ["part", "filter"]).join(paths, ["state", "filter"]).select(
        "part", "filter_order", "step", (F.col("there") - F.col("removed")).alias("kept"), "removed", (F.col("failing") - F.col("removed")).alias("redundant"),
        "unique_fails", "good_lost", "toxic_lost", "shapley",
    )


def oracle(documents: str, labels: str) -> str:
    """The same by applying every order to every row's verdicts."""
    ws = r"[\x20\x09-\x0D]+"
    earlier = " OR ".join(f"(\"{f}\" AND strpos(filter_order, '{f}') < step)" for f in "ABCDE")
    fails = "CASE substr(filter_order, step, 1) " + " ".join(f"WHEN '{f}' THEN \"{f}\"" for f in "ABCDE") + " END"
    return f"""WITH w AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '{ws}'), lambda x: x <> '') AS w FROM {documents}),
 l AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM {labels} GROUP BY doc_id),
 v AS (SELECT part, len(w) < 200 AS "A", 100 * len(list_distinct(w)) < 50 * len(w) AS "B", 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) AS "C", regexp_matches(t, '[#$%&*|]') AS "D",
 coalesce(min(w.doc_id) OVER (PARTITION BY t) < w.doc_id, false) AS "E", coalesce(good, false) AS good, coalesce(toxic, false) AS toxic FROM w LEFT JOIN l ON l.doc_id = w.doc_id),
 c AS (SELECT part, "A", "B", "C", "D", "E", good, toxic, count(*) AS n FROM v GROUP BY ALL),
 f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
 o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM f a, f b, f c, f d, f e WHERE a.x NOT IN (b.x, c.x, d.x, e.x) AND b.x NOT IN (c.x, d.x, e.x) AND c.x NOT IN (d.x, e.x) AND d.x <> e.x),
 s AS (SELECT filter_order, unnest([1, 2, 3, 4, 5])::INT AS step FROM o),
 r AS (SELECT part, filter_order, step, substr(filter_order, step, 1) AS x, n, good, toxic, {earlier} AS gone, {fails} AS fails, ("A"::INT + "B"::INT + "C"::INT + "D"::INT + "E"::INT) AS many FROM c, s),
 g AS (SELECT part, filter_order, step, x, coalesce(sum(n) FILTER (NOT gone AND NOT fails), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (NOT gone AND fails), 0)::BIGINT AS removed, coalesce(sum(n) FILTER (gone AND fails), 0)::BIGINT AS redundant,
 coalesce(sum(n) FILTER (fails AND many = 1), 0)::BIGINT AS unique_fails, coalesce(sum(n) FILTER (NOT gone AND fails AND good), 0)::BIGINT AS good_lost, coalesce(sum(n) FILTER (NOT gone AND fails AND toxic), 0)::BIGINT AS toxic_lost FROM r GROUP BY ALL)
 SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, x))::BIGINT AS shapley FROM g"""
