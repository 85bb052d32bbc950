"""Quality classifier: ordinal cumulative-link regression on graded ratings.

All grades share one weight per hashed text feature; ordered thresholds t0 < t1 < ... cut the score s
of a document into grades: P(grade <= k) = logistic(t_k - s). A document's expected grade is the
sum of the tail probabilities P(grade > k), and it is selected by one of them.

Features are a text's distinct lower-cased words, the marks that words end with, and shares of
repeated words, lines and marked words in steps, each a string hashed to one of ``DIMENSIONS`` weights; a feature counts
once a document, however long the text.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagewright.llm.common import bounded

DIMENSIONS = 1 << 17
#: Rated documents the model is fitted on, at most: those whose doc_id has the smallest hash.
TRAIN_ROWS = 12_000
#: A feature gets a weight if at least so many training documents have it and if, at some threshold,
#: the grades of those differ from all by so many standard errors.
LEAST_DOCUMENTS = 4
LEAST_Z = 5.0
EPOCHS = 20
BATCH = 128
RATE = 0.08
DECAY = 1e-4
#: A document is kept if P(grade >= GOOD) is at least LEAST_TAIL.
GOOD = 2
LEAST_TAIL = 0.5
_EDGE = b".,;:!?()[]{}\"'|*#%&$<>-_/\\"
_CACHE = 300_000


def grade(quality, toxic):
    """The rating of a labelled document as a Column: 0 toxic, 1 poor, 2 good; null if nothing is known."""
    return F.when(toxic == 1, 0).when(quality == 0, 1).when((quality == 1) | (toxic == 0), 2)


class Features:
    """Hashed features of texts; remembers those of the words it has met, up to a bound.

    With ``weights``, words' features of weight 0 are left out.
    """

    def __init__(self, weights: list[float] | None = None):
        self.known: dict[bytes, tuple[int, ...]] = {}
        self.weights = weights

    def _word(self, word: bytes) -> tuple[int, ...]:
        core = word.strip(_EDGE)
        tail = word[len(word.rstrip(_EDGE)) :]
        out = (_slot(b"w " + core),) if core else (_slot(b"m " + word[:8]),)
        out += (_slot(b"t " + tail[:8]),) if len(tail) > 1 else ()
        return out if self.weights is None else tuple(slot for slot in out if self.weights[slot])

    def of(self, text: str) -> list[int]:
        """The sorted distinct features of a whole text; an empty text has one of its own."""
        data = text.encode("utf-8", "surrogatepass").lower()
        words = data.split()
        if not words:
            return [_slot(b"empty")]
        distinct, known = set(words), self.known
        if len(known) > _CACHE:
            known.clear()
        for word in distinct.difference(known):
            known[word] = self._word(word)
        out = {slot for slots in filter(None, map(known.__getitem__, distinct)) for slot in slots}
        lines = [line for line in data.split(b"\n") if line.strip()]
        marked = sum(len(w) > 1 and w[-1] in _EDGE and w[-2] in _EDGE or len(w) == 1 and w in _EDGE for w in distinct)
        again = sum(map(bytes.__eq__, words, words[1:]))
        shares = {b"again": again / len(words), b"lines": 1 - len(set(lines)) / len(lines), b"marked": marked / len(distinct), b"distinct": len(distinct) / len(words) ** 0.75 / 2}
        for name, share in shares.items():
            for step in range(1, min(10, int(share * 20)) + 1):  # cumulative: a higher share has the lower steps' weights too
                out.add(_slot(name + b" %d" % step))
        out.add(_slot(b"size %d" % min(8, len(words).bit_length())))
        return sorted(out)


def _slot(feature: bytes) -> int:
    return zlib.crc32(feature) & (DIMENSIONS - 1)


@dataclass
class Model:
    weights: object  # DIMENSIONS doubles
    thresholds: list[float]

    def tails(self, score: float) -> list[float]:
        """P(grade > k) for every threshold k."""
        import math

        return [1 / (1 + math.exp(min(700.0, max(-700.0, t - score)))) for t in self.thresholds]


def loss_and_slopes(score, y, cuts):
    """(mean loss, its slope by each row's score, its slope by each threshold) of rows with grades ``y``: the loss is the negative log-likelihood of the grade."""
    import numpy as np

    levels = len(cuts) + 1
    logistic = lambda x: 1 / (1 + np.exp(-np.clip(x, -60, 60)))
    edges = np.concatenate([[-np.inf], cuts, [np.inf]])
    hi, lo = logistic(edges[y + 1] - score), logistic(edges[y] - score)
    hi[y == levels - 1], lo[y == 0] = 1.0, 0.0
    p = np.maximum(hi - lo, 1e-9)
    d_hi, d_lo = hi * (1 - hi) / p, lo * (1 - lo) / p
    by_cut = np.array([d_lo[y == k + 1].sum() - d_hi[y == k].sum() for k in range(len(cuts))]) / len(y)
    return float(-np.log(p).mean()), (d_hi - d_lo) / len(y), by_cut


def fit(features: list[list[int]], grades: list[int]) -> Model:
    """Fits weights and thresholds by Adagrad on the log-likelihood; the same rows in the same order give the same model.

    Without rows, or with one grade only, the weights are 0 and the thresholds at the grades' shares.
    """
    import numpy as np

    y = np.array(grades, int)
    n, levels = len(y), max(2, int(y.max(initial=GOOD)) + 1)
    share = (np.array([(y <= k).sum() for k in range(levels - 1)]) + 0.5) / (n + 1)
    cuts = np.log(share / (1 - share))
    for k in range(1, len(cuts)):
        cuts[k] = max(cuts[k], cuts[k - 1] + 0.5)
    weights = np.zeros(DIMENSIONS)
    if n == 0 or len(set(grades)) < 2:
        return Model(weights, cuts.tolist())
    flat = np.concatenate([np.asarray(row, np.int32) for row in features])
    wide = np.array([len(row) for row in features])
    owner = np.repeat(np.arange(n), wide)
    often, told = np.bincount(flat, minlength=DIMENSIONS), np.zeros(DIMENSIONS, bool)
    for k in range(levels - 1):  # features whose documents pass a threshold more or less often than chance allows
        above = (y > k).astype(float)
        rate, with_it = above.mean(), np.bincount(flat, above[owner], DIMENSIONS)
        told |= np.abs(with_it - often * rate) > LEAST_Z * np.sqrt(np.maximum(often * rate * (1 - rate), 1e-9))
    told &= often >= LEAST_DOCUMENTS
    owner, flat = owner[told[flat]], flat[told[flat]]
    start = np.searchsorted(owner, np.arange(n + 1))
    seen, seen_cuts = np.full(DIMENSIONS, 1e-6), np.full(len(cuts), 1e-6)
    rng = np.random.default_rng(0)
    for _ in range(EPOCHS):
        order = rng.permutation(n)
        for at in range(0, n, BATCH):
            rows = np.sort(order[at : at + BATCH])
            size = start[rows + 1] - start[rows]
            idx = flat[np.concatenate([np.arange(start[r], start[r + 1]) for r in rows])]
            of = np.repeat(np.arange(len(rows)), size)
            _, by_score, by_cut = loss_and_slopes(np.bincount(of, weights[idx], len(rows)), y[rows], cuts)
            slope = np.bincount(idx, by_score[of], DIMENSIONS) + DECAY * weights
            seen += slope * slope
            weights -= RATE * slope / np.sqrt(seen)
            seen_cuts += by_cut * by_cut
            cuts -= RATE * by_cut / np.sqrt(seen_cuts)
            for k in range(1, len(cuts)):
                cuts[k] = max(cuts[k], cuts[k - 1] + 1e-3)  # thresholds stay in order
    return Model(weights, cuts.tolist())


def training_rows(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> list[tuple[int, int, object]]:
    """(doc_id, grade, features as an array) of at most ``rows`` rated documents, by doc_id.

    Ratings that are null in all columns are left out; a document rated more than once has its
    lowest grade; of rows with the same doc_id the smallest text counts.
    """
    import pyarrow as pa

    def run(batches):
        features = Features()
        for batch in bounded(batches):
            found = [features.of(text.as_py() or "") for text in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.int32()))], ["doc_id", "grade", "features"])

    rated = labels.select(F.col("doc_id").cast("long").alias("doc_id"), grade(F.col("quality"), F.col("toxic")).alias("grade")).where("doc_id is not null and grade is not null")
    chosen = rated.groupBy("doc_id").agg(F.min("grade").alias("grade")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("grade").alias("grade"), F.min("text").alias("text"))
    found = texts.select("doc_id", "grade", "text").mapInArrow(run, "doc_id long, grade int, features array<int>").toArrow()
    if not found.num_rows:
        return []
    lists = found.column("features").combine_chunks()
    edges, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
    rows = sorted(zip(found.column("doc_id").to_pylist(), found.column("grade").to_pylist(), edges.tolist(), edges[1:].tolist()))
    return [(doc_id, grade_, flat[a:b]) for doc_id, grade_, a, b in rows]


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """A model of ``labels`` (doc_id, quality, toxic) of ``docs`` (doc_id, text), fitted on a bounded sample."""
    found = training_rows(docs, labels, rows)
    return fit([r[2] for r in found], [r[1] for r in found])


def score(docs: DataFrame, model: Model, good: int = GOOD, least_tail: float = LEAST_TAIL) -> DataFrame:
    """All of ``docs``' columns with score, expected_grade, tail (P(grade >= good)) and kept; one pass, no shuffle.

    The added columns are named __pw_score, __pw_expected, __pw_tail and __pw_kept, so that columns of
    any other names may come along. Null texts are empty. Repeated rows are scored alike; an empty table gives no rows.
    """
    import pyarrow as pa

    spark = docs.sparkSession
    bound = min(max(good - 1, 0), len(model.thresholds) - 1)
    shared = spark.sparkContext.broadcast(model)  # DIMENSIONS doubles, whatever the data
    added = ["__pw_score", "__pw_expected", "__pw_tail"]

    def run(batches):
        fitted = shared.value
        weights = fitted.weights.tolist()
        features = Features(weights)
        for batch in bounded(batches):
            scores = [sum(map(weights.__getitem__, features.of(text.as_py() or ""))) for text in batch.column(batch.num_columns - 1)]
            tails = [fitted.tails(s) for s in scores]
            columns = [*batch.columns[:-1], pa.array(scores, pa.float64()), pa.array([sum(t) for t in tails], pa.float64()), pa.array([t[bound] for t in tails], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, ["__pw_row", *added])

    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__pw_row"), F.col("text").cast("string").alias("__pw_text"))
    schema = T.StructType([packed.schema["__pw_row"], *[T.StructField(c, T.DoubleType()) for c in added]])
    out = packed.mapInArrow(run, schema)
    return out.select("__pw_row.*", *added, (F.col("__pw_tail") >= least_tail).alias("__pw_kept"))
