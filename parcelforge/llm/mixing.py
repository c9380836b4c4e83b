"""Operator 11: mixing sources to target weights, by balanced sampling with the cube method.

Every source gets a target of tokens (or words) by its weight. A document is taken as often as its source's target is of its size: so many
times whole, and once more with the fraction that remains as its inclusion probability. The flight phase moves these probabilities
in directions that change neither the expected number of tokens nor that of documents (the null space of the two constraints), by a random
step that keeps each probability what it was on average, until one of them is 0 or 1. Larger documents are decided first, so that those left
are small; a very large one, which documents of the same number could not make up for, is decided before, by tokens alone. The last ``LANDING`` documents of a source land together: of all outcomes the one that is nearest to the target.

A source flies in chunks of about ``CHUNK`` documents, dealt by a hash; each leaves two undecided documents at most, which are
dealt to chunks anew, some hundred times fewer, until a source has one chunk, which lands. Rows that are equal in id, source and size are
counted before they are dealt, and fly as one document with what is left of their common expectation. Chunks, orders and random numbers come
from the rows alone, so that every run takes the same.

Sources may be any number: they are ranked by a sort, and only where they are ``FEW_SOURCES`` or less is their table broadcast.

Defined results: null texts have size 0, and are taken by the same rule; a null source is a source of its own, the last. Rows without an id are rows like others. A
source whose documents are all empty has target 0. An empty table gives no rows. Other columns are not looked at, whatever their names.
"""

from __future__ import annotations

import random
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import exchange as X

CHUNK = 2048
#: Documents of a source that are left to its landing, which looks at all outcomes.
LANDING = 14
FEW_SOURCES = 10_000
#: Probabilities nearer than this to 0 or 1 are there.
NEAR = 1e-9


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def make_room(s: np.ndarray, p: np.ndarray, rng: random.Random) -> None:
    """Decides documents of over a quarter of what all open ones stand for, or of what they lack: too large for steps that hold their number, too.

    All smaller ones make room alike. Where they can only one way, it goes that way: a document far over the target is not taken.
    """
    for g in range(len(p)):
        if 4 * s[g] <= min((p * s)[g:].sum(), ((1 - p) * s)[g:].sum()):
            break
        rest = slice(g + 1, None)
        more, less = (1 - p[g]) * s[g], p[g] * s[g]
        give, take = (p * s)[rest].sum(), ((1 - p) * s)[rest].sum()
        if more > give and less > take:
            continue
        rising = less > take or (more <= give and rng.random() < p[g])
        p[rest] += -p[rest] * (more / give if give else 0) if rising else (1 - p[rest]) * (less / take if take else 0)
        p[g] = float(rising)


def fly(sizes: Sequence[int], chances: list[float], rng: random.Random, most: int = 2) -> list[int]:
    """Moves ``chances`` until ``most`` documents are undecided (two can't be moved), and returns these; the sums of chances and of chance times size stay.

    A step's direction is the first undecided document's own, projected on the null space of the two sums. The weights of the projection let
    all others move alike, whatever their sizes, so that they make room for a very large document.
    """
    open_ = [i for i in range(len(sizes)) if NEAR < chances[i] < 1 - NEAR]
    at, s, p = np.array(open_, np.int64), np.array([sizes[i] for i in open_], float), np.array([chances[i] for i in open_])
    done = np.round(np.array(chances))
    make_room(s, p, rng)
    decided = (p <= NEAR) | (p >= 1 - NEAR)
    done[at[decided]] = np.round(p[decided])
    at, s, p = at[~decided], s[~decided], p[~decided]
    while len(p) > max(2, most):
        w = 1 / np.maximum(s, 1)
        all_w = w.sum()
        t = s - (w * s).sum() / all_w
        spread = float((w * t * t).sum())
        spread = spread if spread > 1e-12 * float((w * s * s).sum()) else 0  # equal sizes, but for rounding
        lever = w * (1 / all_w + (t * t / spread if spread else 0 * t))  # of 1: the two sums hold the document where it is
        first = int((lever < 1 - 1e-9).argmax())
        step = -w * (1 / all_w + (t[first] * t / spread if spread else 0 * t))
        step[first] += 1
        step[np.abs(step) < 1e-12] = 0
        with np.errstate(divide="ignore"):
            room_up = np.where(step > 0, 1 - p, p) / np.abs(step)
            room_down = np.where(step > 0, p, 1 - p) / np.abs(step)
        up, down = float(room_up.min()), float(room_down.min())
        rising = rng.random() * (up + down) < down
        p = np.clip(p + (up if rising else -down) * step, 0, 1)
        stop = int((room_up if rising else room_down).argmin())
        p[stop] = round(p[stop])
        decided = (p <= NEAR) | (p >= 1 - NEAR)
        done[at[decided]] = np.round(p[decided])
        at, s, p = at[~decided], s[~decided], p[~decided]
    done[at] = p
    chances[:] = done.tolist()
    return at.tolist()


def land(sizes: Sequence[int], chances: list[float], left: list[int]) -> None:
    """Takes of the undecided documents those whose sizes sum up to what is nearest to what they stand for; of equal ones, those nearest to their number."""
    if not left:
        return
    size, chance = np.array([sizes[i] for i in left], float), np.array([chances[i] for i in left])
    outcomes = np.arange(1 << len(left))[:, None] >> np.arange(len(left)) & 1
    tokens, docs = np.abs(outcomes @ size - chance @ size), np.abs(outcomes.sum(1) - chance.sum())
    best = outcomes[np.lexsort((docs.round(6), tokens.round(6)))[0]]
    for i, taken in zip(left, best.tolist()):
        chances[i] = float(taken)


def targets(totals: DataFrame, weights: Sequence[int], share: tuple[int, int], most: int) -> DataFrame:
    """``source``, ``source_size``, ``n`` and ``target`` from the sizes of the sources, whose weights repeat in their order, null last.

    The targets sum up to ``share`` (as a fraction) of all sizes; none is over ``most`` times its source's size, and the excess goes to the others by weight.
    """
    ordered = X.materialize(totals.orderBy(F.col("source").asc_nulls_last()).withColumn("at", F.monotonically_increasing_id()))
    before, start = 0, {}
    for r in sorted(ordered.groupBy(F.shiftright("at", 33).alias("part")).count().collect(), key=lambda r: r["part"]):  # a row for each partition of the sort
        start[r["part"]], before = before, before + r["count"]
    if not before:
        return totals.select("source", "source_size", "n", F.lit(0.0).alias("target"))
    place = F.element_at(F.create_map(*(F.lit(x) for pair in start.items() for x in pair)), F.shiftright("at", 33)) + F.col("at").bitwiseAND((1 << 33) - 1)
    weight = F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int")).cast("long")
    rows = X.materialize(ordered.select("source", "source_size", "n", weight.alias("weight"), (F.col("source_size") * most).alias("cap")))
    whole = rows.agg(F.sum("source_size")).first()[0] * share[0] / share[1]
    level, held = 0.0, -1
    while True:  # each pass but the last brings more sources to their cap
        over = F.col("weight") * level > F.col("cap") if held >= 0 else F.lit(False)
        n, capped, free = rows.agg(F.count_if(over), F.coalesce(F.sum(F.when(over, F.col("cap"))), F.lit(0)), F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0))).first()
        if n == held or not free:
            break
        level, held = (whole - capped) / free, n
    return rows.select("source", "source_size", "n", F.least(F.col("weight") * level, F.col("cap")).cast("double").alias("target"))


_UNIT = "id string, source string, size long, n long, chance double"


def _flight(units: DataFrame, round_: int, seed: int) -> DataFrame:
    """``units`` with their chances moved, chunk by chunk; a source in one chunk lands."""

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: (-r["size"], r["draw"], r["id"] is not None, r["id"] or "", r["n"]))
        sizes, chances = [r["size"] for r in rows], [r["chance"] for r in rows]
        if rows:
            rng = random.Random(f"{seed}/{round_}/{rows[0]['source']}/{rows[0]['slot']}")
            last = rows[0]["slots"] == 1
            left = fly(sizes, chances, rng, LANDING if last else 2)
            if last:
                land(sizes, chances, left)
        names = ("id", "source", "size", "n")
        return pa.table([pa.array([r[c] for r in rows], t) for c, t in zip(names, (pa.string(), pa.string(), pa.int64(), pa.int64()))] + [pa.array(chances, pa.float64())], names=[*names, "chance"])

    draw = F.xxhash64(F.lit(seed), F.lit(round_), "id", "size")
    slots = units.groupBy("source").agg(F.ceil(F.count("*") / CHUNK).alias("slots"))
    return _join(units, slots, "source").select(*units.columns, draw.alias("draw"), "slots", F.pmod(draw, F.col("slots")).alias("slot")).groupBy("source", "slot").applyInArrow(run, _UNIT)


def _join(rows: DataFrame, sources: DataFrame, key: str) -> DataFrame:
    """Nulls meet nulls; the table of sources is broadcast if it is small."""
    known = X.materialize(sources).withColumnRenamed(key, "of")
    known = F.broadcast(known) if known.count() <= FEW_SOURCES else known
    return rows.join(known, rows[key].eqNullSafe(known["of"])).drop("of")


def mix(docs: DataFrame, weights: Sequence[int] = (3, 1, 2), share: tuple[int, int] = (3, 2), most: int = 2, size: Column | None = None, seed: int = 11,
        id_col: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """``id_col``, ``source``, ``size``, ``source_size``, ``target`` and ``copies``, for every row.

    ``size`` is an expression over ``text`` (its words, if none is given). See ``targets`` for the others.
    """
    own = X.pick(docs, id=id_col, text=text, source=source)
    kind = own.schema["id"].dataType
    sized = own.select(F.col("id").cast("string").alias("id"), F.col("source").cast("string").alias("source"), (word_count(F.col("text")) if size is None else size).alias("size"))
    units = X.materialize(sized.groupBy("id", "source", "size").agg(F.count("*").alias("n")))
    totals = units.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("n"))
    goal = X.materialize(targets(totals, weights, share, most).withColumn("times", F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0))).drop("n"))
    fraction = F.col("n") * (F.col("times") - F.floor("times"))  # of n equal rows, so many are expected to be taken once more
    left = _join(units, goal.select("source", "times"), "source").select("id", "source", "size", "n", (fraction - F.floor(fraction)).alias("chance"))
    settled, round_ = [], 0
    while True:
        flown = X.materialize(_flight(left, round_, seed))
        undecided = (F.col("chance") > 0) & (F.col("chance") < 1)
        settled.append(flown.where(~undecided))
        left = flown.where(undecided)
        if not left.limit(1).count():
            break
        round_ += 1
    done = settled[0]
    for more in settled[1:]:
        done = done.unionByName(more)
    each = _join(done, goal, "source").withColumn("extra", F.floor(fraction) + F.col("chance").cast("long"))
    rows = each.select(F.col("id").cast(kind).alias(id_col), "source", "size", "source_size", "target", F.floor("times").alias("base"), "extra", F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("nth"))
    return rows.select(id_col, "source", "size", "source_size", "target", (F.col("base") + (F.col("nth") <= F.col("extra")).cast("long")).alias("copies"))


def repeat(docs: DataFrame, mixed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The mix itself: the rows of ``docs``, as often as ``mixed`` says. Ids must be different in ``docs``, and not null."""
    times = mixed.where("copies > 0").select(F.col(id_col).alias("_id"), "copies")
    return docs.join(times, docs[id_col] == times["_id"]).withColumn("_id", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).drop("_id", "copies")
