"""Operator 7: language identification by hierarchical discrimination.

A text is counted by its byte bigrams and trigrams, lower-cased and hashed. One-versus-one linear support vector machines
first choose among language families, then among the languages of the chosen family. They are fitted on a bounded sample of
labelled rows (``sample_rows``, evenly over the languages, each of which has a row at least); prediction reads whole texts.

Defined results: null texts and texts without a letter are ``und`` with score 0; where no label was learned, every text is.
Repeated rows each give a row.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange as X
from .sampling import sample_by_class

#: Rows the machines are fitted on, about, at most.
SAMPLE_ROWS = 4000
DIMENSIONS = 4096
UNDETERMINED = "und"
#: Languages of no listed family are put together by likeness, so many at most.
OTHERS = 16
#: Languages (ISO 639-1) by family.
FAMILIES = {
    "germanic": "af da de en fy is lb nl no sv",
    "romance": "ca es fr gl it oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "uralic": "et fi hu",
    "turkic": "az kk ky tr uz",
    "indo-aryan": "bn gu hi mr ne pa ur",
    "semitic": "am ar he mt",
}
_FAMILY = {lang: family for family, langs in FAMILIES.items() for lang in langs.split()}
_LETTER = re.compile(r"[^\W\d_]")


def features(text: str) -> np.ndarray:
    """Square roots of the hashed counts of byte bigrams and trigrams, of length one."""
    b = np.frombuffer(f" {text.lower()} ".encode(), np.uint8).astype(np.uint32)
    two = (b[:-1] << 8) | b[1:]
    three = (two[:-1] << 8) | b[2:]
    counts = np.bincount((two * np.uint32(2654435761)) >> 20, minlength=DIMENSIONS) + np.bincount((three * np.uint32(2246822519)) >> 20, minlength=DIMENSIONS)
    x = np.sqrt(counts).astype(np.float32)
    return x / np.linalg.norm(x)


def fit_machine(x: np.ndarray, y: np.ndarray, rounds: int = 150, penalty: float = 1e-3) -> tuple[np.ndarray, float]:
    """Weights and offset of a linear support vector machine (squared hinge, accelerated gradient); ``y`` is 1 or -1.

    Both classes count alike, however many rows they have.
    """
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    w = v = np.zeros(x.shape[1] + 1, np.float32)
    step = 1 / (2 * 2 + penalty)  # rows have length one, and the offset adds one
    for i in range(rounds):
        slack = np.maximum(0, 1 - y * (x @ v[:-1] + v[-1])) * share * y
        grad = np.append(-2 * (slack @ x) + penalty * v[:-1], -2 * slack.sum())
        new = (v - step * grad).astype(np.float32)
        v = new + i / (i + 3) * (new - w)
        w = new
    return w[:-1], float(w[-1])


class Chooser:
    """One-versus-one machines over a set of classes."""

    def __init__(self, x: np.ndarray, labels: np.ndarray):
        self.classes = sorted(set(labels.tolist()))
        self.pairs = list(itertools.combinations(range(len(self.classes)), 2))
        fits = []
        for a, b in self.pairs:
            at = (labels == self.classes[a]) | (labels == self.classes[b])
            fits.append(fit_machine(x[at], np.where(labels[at] == self.classes[a], 1, -1).astype(np.float32)))
        self.weights = np.array([w for w, _ in fits], np.float32).reshape(len(fits), x.shape[1]).T
        self.bias = np.array([b for _, b in fits], np.float32)

    def choose(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row the class with most wins (ties: largest sum of margins), and its least margin."""
        margin = x @ self.weights + self.bias
        n, k = len(x), len(self.classes)
        wins, sums, least = np.zeros((n, k)), np.zeros((n, k)), np.full((n, k), np.inf)
        for j, (a, b) in enumerate(self.pairs):
            for c, m in ((a, margin[:, j]), (b, -margin[:, j])):
                wins[:, c] += m >= 0 if c == a else m > 0
                sums[:, c] += m
                least[:, c] = np.minimum(least[:, c], m)
        best = np.lexsort((sums, wins), axis=1)[:, -1] if k > 1 else np.zeros(n, np.int64)
        return best, least[np.arange(n), best]


def families_of(x: np.ndarray, langs: np.ndarray) -> dict[str, str]:
    """The family of each language: the listed one; others, up to ``OTHERS`` at once, form a family with those that are most like them."""
    family = {lang: _FAMILY[lang] for lang in set(langs.tolist()) if lang in _FAMILY}
    left = sorted(set(langs.tolist()) - set(family))
    means = np.array([m / np.linalg.norm(m) for m in (x[langs == lang].mean(0) for lang in left)])
    while left:
        near = np.sort(np.argsort(-(means @ means[0]), kind="stable")[: OTHERS if len(left) > OTHERS else 1])
        family |= {left[i]: f"like {left[0]}" for i in near}
        means, left = np.delete(means, near, 0), [lang for i, lang in enumerate(left) if i not in near]
    return family


class Model:
    """Families first, then the languages within each."""

    def __init__(self, x: np.ndarray, langs: list[str]):
        langs = np.array(langs, dtype=object)
        family = families_of(x, langs)
        families = np.array([family[x] for x in langs], dtype=object)
        self.family = Chooser(x, families)
        self.within = [Chooser(x[families == f], langs[families == f]) for f in self.family.classes]

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        family, margin = self.family.choose(x)
        out = np.empty(len(x), dtype=object)
        for f in np.unique(family):
            at = np.flatnonzero(family == f)
            lang, inner = self.within[f].choose(x[at])
            out[at] = np.array(self.within[f].classes, dtype=object)[lang]
            margin[at] = np.minimum(margin[at], inner)
        return out.tolist(), 1 / (1 + np.exp(-3 * np.clip(margin, -10, 10)))


def fit(docs: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang", sample_rows: int = SAMPLE_ROWS) -> Model | None:
    """A model of the rows that are not held out and have a text and a language; None if there are none."""
    labelled = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"), F.col(lang).alias("lang")).where(~X.held_out("id") & F.col("text").isNotNull() & F.col("lang").isNotNull())
    rows, _ = sample_by_class(labelled, "lang", "id", sample_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(lang, features(t)) for t, lang in zip(batch["text"].to_pylist(), batch["lang"].to_pylist()) if _LETTER.search(t)]
            at = [np.flatnonzero(x).astype("<u2") for _, x in found]
            yield pa.RecordBatch.from_pydict({"lang": pa.array([x for x, _ in found], pa.string()), "at": pa.array([a.tobytes() for a in at], pa.binary()), "x": pa.array([x[a].astype("<f2").tobytes() for (_, x), a in zip(found, at)], pa.binary())})

    sample = rows.select("text", "lang").mapInArrow(run, "lang string, at binary, x binary").collect()
    if not sample:
        return None
    x = np.zeros((len(sample), DIMENSIONS), np.float32)
    for i, r in enumerate(sample):
        x[i, np.frombuffer(r["at"], "<u2")] = np.frombuffer(r["x"], "<f2")
    return Model(x, [r["lang"] for r in sample])


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``id_col``, ``lang_pred`` and ``score`` for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shared.value
        for batch in batches:
            langs, scores = [UNDETERMINED] * batch.num_rows, np.zeros(batch.num_rows)
            texts = batch.column(1)
            at = [i for i in range(batch.num_rows) if fitted and texts[i].is_valid and _LETTER.search(texts[i].as_py())]
            for i in range(0, len(at), 256):
                some = at[i : i + 256]
                found, score = fitted.predict(np.array([features(texts[j].as_py()) for j in some]))
                scores[some] = score
                for j, lang in zip(some, found):
                    langs[j] = lang
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs), pa.array(scores)], ["id", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, lang_pred string, score double").withColumnRenamed("id", id_col)
