"""Operator 9: toxicity by compression distance.

Two zstandard dictionaries are trained with the library's trainer, one on ordinary text and one on toxic text, and every window of a text
(``WINDOW`` words of running text, one window after the other) is compressed with either. The difference of the two lengths is the
window's gain. Labels are of documents, most of whose words are ordinary even where they are toxic: the toxic dictionary is trained on
the words of toxic documents that hold a string which is in many of these and in hardly any ordinary one.

A compressor with the toxic dictionary alone would mostly tell which ordinary strings it happens to lack, so both dictionaries have the same
ordinary part; the toxic strings follow it in one, and as many bytes that no text has in the other, so that all offsets are alike. Matches have
``STRING`` bytes at least. The window is followed by a carrier that both hold, as the compressor never looks for matches in the last bytes.

Gains are compared with thresholds, ``1`` to ``LEVELS``: each has as its weight the logarithm of how much more often the gains of
windows of toxic documents lie there than those of ordinary ones. A document's sum of weights, over the root of its number of
windows, is brought to a score by a logistic curve of one slope and one offset. Weights and curve are calibrated on the gains that
each sampled document has with a toxic dictionary trained without the fold that it is in.

Bounds of the labelled sample: ``SAMPLE_ROWS`` documents, half of either class, ``SAMPLE_BYTES`` in all (fewer documents, never parts of
them), none longer than ``LONGEST`` bytes. Scoring reads whole texts.

Defined results: null and empty texts have no window and get the curve's score for a sum of zero. With no labels of one class, every
score is the share of toxic labels. Repeated rows each give a row; repeated labels count as toxic if any is. Ids may be of any type.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange as X
from .sampling import sample_by_class

#: Labelled documents that are learned from, about, at most; their bytes in all, and those of one.
SAMPLE_ROWS, SAMPLE_BYTES, LONGEST = 6000, 64 << 20, 1 << 20
FOLDS = 4
#: Words in a window, and in an ordinary sample that the trainer gets; and the longest word, a longer one is several.
WINDOW, SAMPLED, WORD = 3, 2, 48
ORDINARY_BYTES, TOXIC_BYTES = 96 << 10, 4 << 10
#: The trainer's parameters: the length of the segments it picks, and of the strings it counts. And the bytes of windows it gets.
SEGMENT, STRING, TRAINED_BYTES = 16, 6, 8 << 20
#: Lengths of the strings that mark a word. Such a string is in so many toxic documents at least, and so many times as often as in ordinary ones.
GRAMS, LEAST_DOCS, TIMES = (6, 9), 5, 25
LEVELS = 8
#: Windows that a document counts as having besides its own.
FEW = 20
THRESHOLD = 0.3


def words(text: str | None) -> list[bytes]:
    found = (text or "").lower().encode().split()
    if max(map(len, found), default=0) <= WORD:
        return found
    return [w[i : i + WORD] for w in found for i in range(0, len(w), WORD)]


def windows(text: str | None) -> list[bytes]:
    """All words of the text, ``WINDOW`` at once; the last window may have fewer."""
    found = words(text)
    return [b" " + b" ".join(found[i : i + WINDOW]) + b" " for i in range(0, len(found), WINDOW)]


def samples(text: str | None) -> list[bytes]:
    """Each ``SAMPLED`` words that follow each other."""
    found = words(text)
    return [b" " + b" ".join(w) + b" " for w in zip(*(found[i:] for i in range(min(SAMPLED, max(1, len(found))))))]


def _grams(word: bytes) -> set[bytes]:
    spaced = b" " + word + b" "
    return {spaced[i : i + n] for n in GRAMS for i in range(max(1, len(spaced) - n + 1))}


def _train(samples: list[bytes], size: int) -> bytes:
    """The trainer's dictionary of the samples, evenly thinned to ``TRAINED_BYTES``; where there is too little for it, the samples themselves."""
    step = -(-sum(map(len, samples)) // TRAINED_BYTES)
    samples = samples[:: max(1, step)]
    try:
        return zstandard.train_dictionary(size, samples, k=SEGMENT, d=STRING, level=3).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


class Gains(dict):
    """The gain of each window seen, up to ``LEVELS``; equal windows are compressed once."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        ordinary = ordinary.rjust(64)
        self.carrier = ordinary[-32:]
        filler = np.random.default_rng(9).integers(128, 192, len(toxic), dtype=np.uint8).tobytes()  # bytes that begin no character
        self.each = [self._compressor(ordinary + last + self.carrier) for last in (filler, toxic)]

    @staticmethod
    def _compressor(content: bytes):
        known = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        how = zstandard.ZstdCompressionParameters.from_level(9, source_size=64, dict_size=len(content), window_log=18, hash_log=17, chain_log=18, search_log=5, min_match=STRING, write_content_size=0, write_checksum=0, write_dict_id=0)
        known.precompute_compress(compression_params=how)
        return zstandard.ZstdCompressor(dict_data=known, compression_params=how).compress

    def __missing__(self, window: bytes) -> int:
        ordinary, toxic = (len(c(window + self.carrier)) for c in self.each)
        if len(self) > 100_000:
            self.clear()
        gain = self[window] = min(LEVELS, max(0, ordinary - toxic))
        return gain

    def levels(self, text: str | None) -> np.ndarray:
        """How many windows of the text have each gain."""
        return np.bincount(np.fromiter((self[w] for w in windows(text)), np.int64), minlength=LEVELS + 1)


def _toxic_words(toxic: list[tuple[int, str]], ordinary: list[str]) -> list[list[bytes]]:
    """The toxic words of each document, without the documents of each fold, and of all; ``toxic`` has folds and texts."""
    total: Counter = Counter()
    for _, text in toxic:
        total.update(set().union(*map(_grams, set(words(text)))))
    able = {g for g, n in total.items() if n >= LEAST_DOCS}
    total = Counter({g: total[g] for g in able})
    known: dict[bytes, set[bytes]] = {}
    by_fold = [Counter() for _ in range(FOLDS)]
    for fold, text in toxic:
        each = set(words(text))
        known |= {w: some for w in each - known.keys() if (some := _grams(w) & able)}
        by_fold[fold].update(set().union(*(known[w] for w in each if w in known)))
    plain: Counter = Counter()
    for text in ordinary:
        plain.update(able & set().union(*map(_grams, set(words(text)))))
    out = []
    for left_out in range(FOLDS + 1):
        some = [t for fold, t in toxic if fold != left_out]
        n = {g: total[g] - (by_fold[left_out][g] if left_out < FOLDS else 0) for g in able}
        marked = {g for g, k in n.items() if k >= LEAST_DOCS and k / len(some) >= TIMES * (plain[g] + 0.5) / len(ordinary)}
        bad = {w for w, grams in known.items() if not marked.isdisjoint(grams)}
        out.append([b" " + w + b" " for t in some for w in sorted(bad.intersection(words(t)))])
    return out


def train(sample: list[tuple[int, str, int]]) -> dict:
    """The dictionaries from ``(fold, text, label)``: ``ordinary``, ``toxic``, and ``folds``, each trained without one."""
    toxic, ordinary = ([(k, t) for k, t, y in sample if y == label] for label in (1, 0))
    if not toxic or not ordinary:
        return {"prior": float(bool(toxic)) if sample else 0.0}
    plain = [t for _, t in ordinary]
    *folds, whole = (_train(w, TOXIC_BYTES) if w else b"" for w in _toxic_words(toxic, plain))
    size = sum(len(t) for t in plain) * SAMPLED  # of all samples, about
    step = max(1, size // TRAINED_BYTES)
    return {"ordinary": _train([w for i, t in enumerate(plain) for w in samples(t)[i % step :: step]], ORDINARY_BYTES), "toxic": whole, "folds": folds}


def calibrate(levels: np.ndarray, y: np.ndarray, odds: float = 0.0) -> dict:
    """Weights of the gains, and the logistic curve, from the ``levels`` of documents and their labels; ``odds`` undo uneven sampling."""
    share = [(levels[y == k].sum(0) + 0.5) / (levels[y == k].sum() + 0.5 * (LEVELS + 1)) for k in (0, 1)]
    weights = np.log(share[1] / share[0])
    s = evidence(levels, weights)
    mean, scale = s.mean(), s.std() + 1e-9
    z, w = np.stack([(s - mean) / scale, np.ones(len(s))], 1), np.zeros(2)
    for _ in range(50):  # Newton's method, with a small ridge
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p) + 1e-6)[:, None]).T @ z + np.diag([1e-3, 0]), z.T @ (y - p) - [1e-3 * w[0], 0])
        w = w + np.clip(step, -2, 2)
    slope = max(0.0, w[0] / scale)
    return {"weights": weights, "slope": slope, "offset": w[1] - slope * mean + odds}


def evidence(levels: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return levels @ weights / np.sqrt(levels.sum(1) + FEW)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "toxic", sample_rows: int = SAMPLE_ROWS) -> dict:
    """Learned from labelled rows that are not held out; the sampled ids are few (``sample_rows``), so they are broadcast."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label).cast("int").alias("y")).where(~X.held_out("id") & F.col("id").isNotNull() & F.col("y").isNotNull())
    chosen, counts = sample_by_class(known.groupBy("id").agg(F.max("y").alias("y")), "y", "id", sample_rows)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")).where(F.octet_length("text") <= LONGEST).join(F.broadcast(chosen), "id")
    drawn = X.materialize(texts.withColumn("draw", F.pmod(F.xxhash64(F.lit("bytes"), F.col("id").cast("string")), F.lit(1 << 30)) / float(1 << 30)))
    size = drawn.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    drawn = drawn.where(F.col("draw") < SAMPLE_BYTES / max(size, 1)) if size > SAMPLE_BYTES else drawn
    rows = [(zlib.crc32(f"fold{r['id']}".encode()) % FOLDS, r["text"], r["y"]) for r in sorted(drawn.select("id", "text", "y").collect(), key=lambda r: (str(r["id"]), r["text"]))]
    model = train(rows)
    if "prior" in model:
        return model
    shared = docs.sparkSession.sparkContext.broadcast((model["ordinary"], model.pop("folds")))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ordinary, folds = shared.value
        each = [Gains(ordinary, x) for x in folds]
        for batch in batches:
            found = [each[zlib.crc32(f"fold{i}".encode()) % FOLDS].levels(t) for i, t in zip(batch["id"].to_pylist(), batch["text"].to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array([x.tolist() for x in found], pa.list_(pa.int64())), batch["y"]], ["levels", "y"])

    measured = drawn.select("id", "text", "y").repartition(X.partitions(docs.sparkSession)).mapInArrow(measure, "levels array<long>, y int").collect()
    n = Counter(r["y"] for r in measured)
    of_all = {r["class"]: r["n"] for r in counts.collect()}
    odds = np.log(of_all[1] / n[1]) - np.log(of_all[0] / n[0])  # as in all labels, not as in the sample
    measured.sort(key=lambda r: (r["y"], r["levels"]))
    return model | calibrate(np.array([r["levels"] for r in measured], float), np.array([r["y"] for r in measured]), float(odds))


def scores(model: dict, texts: Iterable[str | None]) -> np.ndarray:
    """The score of each text."""
    texts = list(texts)
    if "prior" in model:
        return np.full(len(texts), model["prior"])
    gains = model.get("gains") or Gains(model["ordinary"], model["toxic"])
    levels = np.array([gains.levels(t) for t in texts], float).reshape(len(texts), LEVELS + 1)
    return 1 / (1 + np.exp(-np.clip(model["slope"] * evidence(levels, model["weights"]) + model["offset"], -30, 30)))


def score(docs: DataFrame, model: dict, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``id_col``, ``score`` and ``predicted`` for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        if "prior" not in own:
            own = own | {"gains": Gains(own["ordinary"], own["toxic"])}
        for batch in batches:
            p = scores(own, (t.as_py() for t in batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p, pa.float64()), pa.array((p >= THRESHOLD).astype(np.int32))], ["id", "score", "predicted"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, score double, predicted int").withColumnRenamed("id", id_col)
