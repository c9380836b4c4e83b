"""Mixing, the filter audit and hard negatives, against plain computations and on odd tables."""

import itertools
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from parcelforge.llm import audit, balltree, mixing

def odd(df):
    """With columns whose names are like those that operators use."""
    return df.select("*", *(F.lit("odd").alias(c) for c in ("a.b", "x`y", "own_0", "copies", "part", "id", "Score")))


# mixing


def documents(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def goal(sizes, weights=(3, 1, 2)):
    """Targets by resharing the excess, source by source."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    rest, out, free = 1.5 * sum(sizes.values()), {}, set(sizes)
    while free:
        level = rest / sum(weight[s] for s in free)
        over = [s for s in free if weight[s] * level > 2 * sizes[s]]
        if not over:
            return out | {s: weight[s] * level for s in free}
        for s in over:
            out[s] = 2.0 * sizes[s]
            rest -= out[s]
            free.remove(s)
    return out


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    rows = [(i, " ".join(["w"] * int(rng.paretovariate(1.6) * 20)), rng.choice(["b", "a", "é", None, "Z", "hot", "hot", "hot"])) for i in range(9000)]
    return rows + [(9000 + i, t, s) for i, (t, s) in enumerate([(None, "a"), ("", "b"), ("x\ty\x0bz  \n", "é"), (" ", None), ("tiny", "small"), (None, "empty"), ("big " * 50_000, "hot")])]


def test_mix_meets_targets(spark, corpus):
    docs = odd(documents(spark, corpus))
    rows = mixing.mix(docs.repartition(7)).collect()
    size = {i: len((t or "").split()) for i, t, _ in corpus}
    total = Counter()
    for i, _, s in corpus:
        total[s] += size[i]
    want = goal(total)
    assert len(rows) == len(corpus) and {r["doc_id"] for r in rows} == set(size)
    taken = Counter()
    for r in rows:
        assert r["size"] == size[r["doc_id"]] and r["source_size"] == total[r["source"]] and r["target"] == pytest.approx(want[r["source"]]) and 0 <= r["copies"] <= 2
        times = want[r["source"]] / total[r["source"]] if total[r["source"]] else 0
        assert math.floor(times) <= r["copies"] <= math.ceil(times)
        taken[r["source"]] += r["copies"] * r["size"]
    for s in ("a", "b", "é", None, "Z", "hot", "empty"):
        assert abs(taken[s] - want[s]) <= max(1, 0.001 * want[s]), s
    docs_taken = Counter(r["source"] for r in rows if r["copies"] > math.floor(want[r["source"]] / max(1, total[r["source"]])))
    of_source = Counter(s for _, _, s in corpus)
    for s, n in of_source.items():  # documents are balanced, too, but for a very large one
        if 20 * max(size[i] for i, _, x in corpus if x == s) > total[s]:
            continue
        part = want[s] / max(1, total[s])
        assert abs(docs_taken[s] - (part - math.floor(part)) * n) <= mixing.LANDING
    again = mixing.mix(documents(spark, corpus[::-1]).repartition(3)).collect()
    assert {(r["doc_id"], r["copies"]) for r in rows} == {(r["doc_id"], r["copies"]) for r in again}


def test_mix_odd_tables(spark):
    assert mixing.mix(documents(spark, [])).count() == 0
    rows = mixing.mix(documents(spark, [(1, None, "a"), (2, "", None)])).collect()
    assert {(r["doc_id"], r["size"], r["target"], r["copies"]) for r in rows} == {(1, 0, 0.0, 0), (2, 0, 0.0, 0)}
    same = [(5, "one two three", "a")] * 3000 + [(None, "four words in here", "b")] * 3000
    rows = mixing.mix(documents(spark, same)).collect()
    assert len(rows) == 6000
    for s, n in (("a", 3), ("b", 4)):
        some = [r for r in rows if r["source"] == s]
        assert abs(sum(r["size"] * r["copies"] for r in some) - some[0]["target"]) <= n and {r["copies"] for r in some} <= {0, 1, 2}


def test_repeat_makes_the_mix(spark):
    docs = documents(spark, [(i, "w " * (i + 1), "a" if i % 3 else "b") for i in range(30)])
    mixed = mixing.mix(docs)
    rows = mixing.repeat(docs, mixed).collect()
    assert sum(len(r["text"].split()) for r in rows) == mixed.agg(F.sum(F.col("size") * F.col("copies"))).first()[0]


def test_flight_keeps_sums_and_chances():
    """Over many runs each document is taken as often as its chance says; in each run the sums stay."""
    sizes, n = [*range(40, 10, -1), 9, 9, 5, 1, 0, 0], 3000
    first = [0.3, 0.5, 0.1, 0.8, 0.6, 0.45] * 6
    hits = np.zeros(36)
    for seed in range(n):
        chances = list(first)
        left = mixing.fly(sizes, chances, random.Random(seed))
        assert len(left) <= 2 and sum(chances) == pytest.approx(sum(first)) and np.dot(chances, sizes) == pytest.approx(np.dot(first, sizes))
        assert all(chances[i] in (0, 1) for i in range(36) if i not in left)
        hits += chances
    assert np.abs(hits / n - first).max() < 4 * 0.5 / n**0.5
    equal = [0.25] * 400
    assert len(mixing.fly([7] * 400, equal, random.Random(1))) <= 2 and sum(equal) == pytest.approx(100)


# filter audit


def plain_audit(rows, labels):
    label = defaultdict(lambda: [False, False])
    for i, q, t in labels:
        label[i][0] |= q == 1
        label[i][1] |= t == 1
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(least.get(t or "", i), i)
    of_part = defaultdict(list)
    for i, t, s in rows:
        t = t or ""
        w = [x for x in __import__("re").split(r"[\x20\x09-\x0D]+", t) if x]
        fails = set()
        fails |= {"A"} if len(w) < 200 else set()
        fails |= {"B"} if 100 * len(set(w)) < 50 * len(w) else set()
        fails |= {"C"} if 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t) else set()
        fails |= {"D"} if set(t) & set("#$%&*|") else set()
        fails |= {"E"} if i is not None and least[t] < i else set()
        of_part[s or ""].append((fails, *(label[i] if i is not None else (False, False))))
    out = []
    for part, some in of_part.items():
        removed_all = Counter()
        lines = []
        for order in itertools.permutations("ABCDE"):
            gone = set()
            for k, f in enumerate(order):
                here = [x for x in some if not x[0] & gone and f in x[0]]
                earlier = sum(1 for x in some if x[0] & gone and f in x[0])
                gone.add(f)
                removed_all[f] += len(here)
                kept = sum(1 for x in some if not x[0] & gone)
                lines.append((part, "".join(order), k + 1, kept, len(here), earlier, sum(x[0] == {f} for x in some), sum(x[1] for x in here), sum(x[2] for x in here)))
        out += [(*x, removed_all[x[1][x[2] - 1]]) for x in lines]
    return sorted(out)


def audited(docs, labels):
    rows = audit.audit(audit.failures(docs, labels), list(audit.FILTERS)).collect()
    return sorted((r["part"], r["filter_order"], r["step"], r["kept"], r["removed"], r["redundant"], r["unique_fails"], r["good_lost"], r["toxic_lost"], r["shapley"]) for r in rows)


def test_audit_is_every_order_applied(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    texts = [None, "", "A", "#", "é" * 50, "x " * 300, "a\tb\n c\x0b"] + [" ".join(rng.choices(words[: rng.choice([30, 400])], k=rng.choice([150, 250]))) + rng.choice(["", " & more", " LOUD" * 9]) for _ in range(40)]
    rows = [(rng.choice([i, i, None]), rng.choice(texts), rng.choice(["s", "s", "t", "", None])) for i in range(300)]
    rows += rows[:20] + [(-7, texts[10], "alone"), (10**9, texts[0], "z")]
    labels = [(rng.randrange(300), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(150)]
    found = audited(odd(documents(spark, rows)), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert found == plain_audit(rows, labels)


def test_audit_of_nothing(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audited(documents(spark, []), labels) == []
    found = audited(documents(spark, [(1, "x", "a")]), labels)
    assert len(found) == 600 and {x[4] for x in found} == {0, 1}


def test_audit_visits_each_state_once(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(audit, "_edges", lambda survivors, state, names, f=audit._edges: seen.append(state) or f(survivors, state, names))
    audit.audit(audit.failures(documents(spark, [(1, "x", "a")]), spark.createDataFrame([], "doc_id long, quality int, toxic int")), list("ABCDE"))
    assert len(seen) == len(set(seen)) == 31


# hard negatives


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")


def plain_negatives(rows, every=50):
    known = {}
    for i, v, y in rows:
        if i is None or v is None or y is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        whole = [max(-(1 << 25), min(1 << 25, math.floor(256 * x))) for x in v]
        known[i] = min(known.get(i, (str(y), whole)), (str(y), whole))
    score = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for a, (y, v) in known.items():
        if a % every:
            continue
        by = sorted((-score(v, w), i) for i, (_, w) in known.items() if i != a)
        for s, p in [x for x in by if known[x[1]][0] == y][:5]:
            fits = [(t, n) for t, n in by if known[n][0] != y and 50 * -s <= 100 * -t <= 95 * -s][:3]
            out += [(a, p, k + 1, n, -s, -t) for k, (t, n) in enumerate(fits)]
    return sorted(out)


def mined(df, **more):
    return sorted(tuple(r) for r in balltree.mine(df, **more).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


def clustered(n, seed=1, size=12):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(9, size))
    return [(i, (centers[i % 9] + 0.2 * rng.normal(size=size)).tolist(), int(rng.integers(0, 4))) for i in range(n)]


@pytest.mark.parametrize("bucket_rows", [60, 10_000])
def test_negatives_are_those_of_every_comparison(spark, bucket_rows):
    rows = clustered(900)
    assert mined(vectors(spark, rows), bucket_rows=bucket_rows, every=10) == plain_negatives(rows, 10)


def test_negatives_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = clustered(200, 2, 4)
    rows += [(1000, None, 1), (1001, [1.0, nan, 0.0, 0.0], 1), (1002, [1.0, inf], 1), (1003, [1.0, None], 1), (1050, [0.5] * 4, None), (None, [1.0] * 4, 1), (1100, [], 1), (1150, [1.0, 1.0], 2), (1200, [1e300, -1e300, 1e5, 1.0], 3), (1250, [0.0] * 4, 0)]
    rows += [(2000 + i, [1.0, 0.5, 0.25, 0.125], i % 2) for i in range(300)]  # equal vectors, ties
    rows += rows[:40] + [(7, [9.0] * 4, 0), (7, [-9.0] * 4, 0), (-50, [0.3] * 4, 1)]
    want = plain_negatives(rows)
    assert want and mined(vectors(spark, rows).select("*", F.lit(1).alias("a.b"), F.lit(2).alias("LABEL"), F.lit(3).alias("bucket")), bucket_rows=50) == want
    assert mined(vectors(spark, [])) == [] and mined(vectors(spark, [(1, None, 1)])) == [] and mined(vectors(spark, [(50, [], 1), (51, [], 1), (52, [], 2)])) == [(50, 51, 1, 52, 0, 0)]


def test_trees_prune(spark):
    """On clustered rows most leaves are left out."""
    rows = clustered(20_000, 3)
    x = np.floor(256 * np.array([v for _, v, _ in rows]))
    tree, met = balltree.Tree(x, np.arange(len(x))), []
    scores = tree.scores
    tree.scores = lambda q, some: met.append(len(q) * len(some)) or scores(q, some)
    q = x[:64]
    score, ids = np.full((64, 1, 5), balltree.NONE), np.full((64, 1, 5), balltree.LAST)
    tree.search(q, np.arange(64), np.full((64, 1), balltree.NONE + 1), np.full((64, 1), balltree.LAST), score, ids)
    exact = (q @ x.T).astype(np.int64)
    exact[np.arange(64), np.arange(64)] = balltree.NONE
    assert (np.sort(exact, 1)[:, ::-1][:, :5] == score[:, 0]).all() and sum(met) < 0.35 * exact.size


# the registered queries


def test_contracts(spark):
    from parcelforge.llm import queries

    wanted = {
        "op11_cube_mix": "doc_id bigint, size bigint, source_size bigint, target double, taken bigint",
        "op12_filter_audit": "part string, filter_order string, step int, kept bigint, removed bigint, redundant bigint, unique_fails bigint, good_lost bigint, toxic_lost bigint, shapley bigint",
        "op13_hard_negatives": "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint",
    }
    for name, columns in wanted.items():
        df = queries.queries()[name](spark, "/root/testdata/sf0.001")
        assert ", ".join(f"{c} {t}" for c, t in df.dtypes) == columns and df.count(), name


def test_index_at_size(spark):
    """Recall and share walked on 2,000 vectors without any structure, for which the walk is long."""
    from parcelforge.llm import multiindex

    vectors = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = {r["vec_id"]: np.array(r["embedding"], float) for r in vectors.collect()}
    ids, x = np.array(list(rows)), np.array(list(rows.values()))
    found = defaultdict(set)
    for r in multiindex.neighbours(vectors).collect():
        found[r["query_id"]].add(r["vec_id"])
    recall = []
    for q in ids[ids % 20 == 0]:
        near = x @ rows[q]
        near[ids == q] = -np.inf
        recall.append(len(found[q] & set(ids[np.argsort(-near)[:20]].tolist())) / 20)
    book = multiindex.Codebook(x, len(x), 20)
    assert np.mean(recall) >= 0.95 and min(recall) >= 0.7 and 0.5 < book.share < 1
