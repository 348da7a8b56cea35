"""Language identification: averaged hashed subword embeddings with a linear
softmax, trained by stochastic gradient descent in numpy.

A text's features are its byte 3- and 4-grams inside words (a blank counts as
word edge), hashed into a fixed number of buckets.  The text vector is the mean
of their embeddings.  Probabilities are calibrated by a temperature, and
documents whose calibrated probability stays under a threshold learned on
calibration rows are rejected.

As the classifier is linear in the mean, prediction needs only the product of
embeddings and output weights: one row of scores per bucket (bounded by
``BUCKETS`` x languages), sent to the executors.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netsleuth.llm.util import as_bytes, settle

BUCKETS = 1 << 15
DIM = 16
#: Bounds of the training sample: rows per language, rows in all (with more
#: languages each has fewer, at least one), snippets a row.
ROWS_PER_LANGUAGE = 600
SAMPLE_ROWS = 120_000
SNIPPETS = 4
EPOCHS = 6
BATCH = 32
RATE = 40.0
FOLDS, HELD_OUT_FOLD, CALIBRATION_FOLD = 5, 0, 1
#: Share of right calibration rows that the threshold may reject, and its cap.
REJECT_SHARE, MOST_THRESHOLD = 0.001, 0.5
PIECE = 1 << 22

_SPACE = 32
NORMAL = np.array([b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else _SPACE for b in range(256)], np.uint8)


def grams(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, place) of the hashed 3- and 4-grams of normalised bytes.  Only
    the first and last byte of a gram may be a blank."""
    if len(data) < 3:
        return np.empty(0, np.uint32), np.empty(0, np.int64)
    half = np.uint32(BUCKETS // 2)
    x = data.astype(np.uint32)
    word = data != _SPACE
    three = x[:-2] | x[1:-1] << np.uint32(8) | x[2:] << np.uint32(16)
    at3 = np.flatnonzero(word[1:-1])
    g3 = (three[at3] * np.uint32(2654435761)) >> np.uint32(18)
    at4 = np.flatnonzero(word[1:-2] & word[2:-1])
    g4 = half + (((three[at4] | x[at4 + 3] << np.uint32(24)) * np.uint32(2246822519)) >> np.uint32(18))
    return np.concatenate([g3, g4]), np.concatenate([at3, at4])


def normal_bytes(text: bytes) -> np.ndarray:
    """A text with one blank at either end, A-Z lower-cased, all other ASCII
    that is no letter a blank."""
    return NORMAL[np.frombuffer(b" " + text + b" ", np.uint8)]


def bag(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text and their shares; bounded by ``BUCKETS``."""
    total = np.zeros(BUCKETS, np.int64)
    data = normal_bytes(text)
    for s in range(0, len(data), PIECE):
        total += np.bincount(_own(data, s)[0], minlength=BUCKETS)
    at = np.flatnonzero(total)
    return at.astype(np.int32), (total[at] / max(1, total.sum())).astype(np.float32)


def _own(data, s):
    """Grams that start in one piece of a long text."""
    g, at = grams(data[s:s + PIECE + 3])
    keep = at < PIECE
    return g[keep], at[keep] + s


class Model:
    """Scores per bucket, bias, temperature, threshold and labels."""

    def __init__(self, labels, scores, bias, temperature=1.0, threshold=0.0):
        self.labels, self.scores, self.bias = list(labels), scores, bias
        self.temperature, self.threshold = temperature, threshold

    def logits(self, text: bytes) -> np.ndarray | None:
        """None if the text has no gram."""
        total, n = np.zeros(len(self.labels)), 0
        data = normal_bytes(text)
        for s in range(0, len(data), PIECE):
            g, _ = _own(data, s)
            total += self.scores[g].sum(axis=0, dtype=np.float64)
            n += len(g)
        return total / n + self.bias if n else None

    def probabilities(self, logits: np.ndarray) -> np.ndarray:
        z = logits / self.temperature
        e = np.exp(z - z.max(axis=-1, keepdims=True))
        return e / e.sum(axis=-1, keepdims=True)


def _fold(id_col: str):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS


def held_out(id_col: str = "doc_id"):
    """Whether a row is held out (a null id is not)."""
    return F.coalesce(_fold(id_col) == HELD_OUT_FOLD, F.lit(False))


def training_bags(docs: DataFrame, id_col: str, text_col: str, label_col: str, rows: int = ROWS_PER_LANGUAGE) -> DataFrame:
    """``(label, calibration, buckets, shares)`` (32-bit integers and floats as
    bytes) of a bounded sample: ``rows`` labelled, not held-out rows expected
    for each language, or ``SAMPLE_ROWS`` by the number of languages if that is
    fewer, each drawn by a hash of its own; each gives its whole text and a few
    snippets.  A language keeps its first row by that hash in any case."""
    usable = (docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"),
                          F.col(label_col).cast("string").alias("label"))
              .where(F.col("label").isNotNull() & F.col("text").isNotNull() & ~held_out("id") & F.col("id").isNotNull())
              .withColumn("draw", F.pmod(F.xxhash64("id", "row"), F.lit(1 << 30)) / float(1 << 30)))
    # stored, so the optimiser knows its size and broadcasts it if it is small
    per = settle(usable.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.min("draw").alias("least")), "langid-labels")
    labels = per.count()
    if not labels:
        return None
    rate = F.greatest("least", F.least(F.lit(1.0), F.lit(float(min(rows, max(1, SAMPLE_ROWS // labels)))) / F.col("n")))
    drawn = usable.join(per.select("label", rate.alias("rate")), "label").where("draw <= rate") \
        .select("id", "text", "label", (_fold("id") == CALIBRATION_FOLD).alias("calibration"))

    def run(batches):
        for b in batches:
            rows = []
            for i, text, label, cal in zip(*(as_bytes(c) if pa.types.is_string(c.type) else c.to_pylist() for c in b.columns)):
                rng = np.random.default_rng(i & 0x7FFFFFFF)
                words, parts = text.split(), [text]
                for _ in range(SNIPPETS if words else 0):
                    n = int(rng.integers(3, 40))
                    at = int(rng.integers(0, max(1, len(words) - n + 1)))
                    parts.append(b" ".join(words[at:at + n]))
                for p in parts:
                    at, share = bag(p)
                    if len(at):
                        rows.append((label.decode(), cal, at.tobytes(), share.tobytes()))
            cols = list(zip(*rows)) if rows else [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.bool_()),
                                              pa.array(cols[2], pa.binary()), pa.array(cols[3], pa.binary())],
                                             ["label", "calibration", "buckets", "shares"])
    return drawn.mapInArrow(run, "label string, calibration boolean, buckets binary, shares binary")


def train(bags, seed: int = 7) -> Model:
    """Fit on rows ``(label, calibration, buckets, shares)``."""
    labels = sorted({r[0] for r in bags})
    y = np.array([labels.index(r[0]) for r in bags])
    cal = np.array([r[1] for r in bags])
    fit = np.flatnonzero(~cal) if (~cal).any() else np.arange(len(bags))
    rng = np.random.default_rng(seed)
    emb = rng.normal(0, 0.5, (BUCKETS, DIM)).astype(np.float32)
    seen = np.zeros(BUCKETS, bool)
    out, bias = np.zeros((DIM, len(labels)), np.float32), np.zeros(len(labels), np.float32)
    # each language weighs the same in the loss
    weight = np.array([1.0 / max(1, (y[fit] == k).sum()) for k in range(len(labels))])
    weight *= len(fit) / len(labels)
    steps, done = EPOCHS * -(-len(fit) // BATCH), 0
    for _ in range(EPOCHS):
        order = rng.permutation(fit)
        for s in range(0, len(order), BATCH):
            rows = order[s:s + BATCH]
            idx = [np.asarray(bags[i][2]) for i in rows]
            used, inv = np.unique(np.concatenate(idx), return_inverse=True)
            x = np.zeros((len(rows), len(used)), np.float32)
            x[np.repeat(np.arange(len(rows)), [len(i) for i in idx]), inv] = np.concatenate([np.asarray(bags[i][3]) for i in rows])
            mean = x @ emb[used]
            z = mean @ out + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(rows)), y[rows]] -= 1
            p *= (weight[y[rows]] / len(rows))[:, None].astype(np.float32)
            rate = RATE * (1 - done / steps)
            grad = x.T @ (p @ out.T)
            out -= rate * 0.1 * mean.T @ p
            bias -= rate * 0.005 * p.sum(0)
            emb[used] -= rate * grad
            seen[used] = True
            done += 1
    emb[~seen] = 0
    model = Model(labels, np.ascontiguousarray(emb @ out, np.float32), bias.astype(np.float64))
    held = np.flatnonzero(cal) if cal.any() else fit
    z = np.array([(model.scores[np.asarray(bags[i][2])] * np.asarray(bags[i][3])[:, None]).sum(0) + model.bias for i in held])
    calibrate(model, z, y[held])
    return model


def calibrate(model: Model, logits: np.ndarray, y: np.ndarray) -> None:
    """Temperature of least log loss; threshold that rejects a small share of
    the calibration rows that are right."""
    def loss(t):
        z = logits / t
        z = z - z.max(1, keepdims=True)
        return float((np.log(np.exp(z).sum(1)) - z[np.arange(len(y)), y]).mean())
    model.temperature = min(np.geomspace(0.05, 20, 61), key=loss)
    p = model.probabilities(logits)
    right = np.sort(p.max(1)[p.argmax(1) == y])
    model.threshold = float(min(MOST_THRESHOLD, right[int(REJECT_SHARE * len(right))])) if len(right) else MOST_THRESHOLD


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang",
        rows: int = ROWS_PER_LANGUAGE) -> Model | None:
    """Model of the labelled, not held-out rows; None if there are none.

    About ``rows`` x languages rows with their snippets, each bounded by
    ``BUCKETS``, come to the driver; one language alone is always predicted."""
    bags = training_bags(docs, id_col, text_col, label_col, rows)
    got = sorted((r[0], r[1], bytes(r[2]), bytes(r[3])) for r in bags.collect()) if bags is not None else []
    got = [(lab, cal, np.frombuffer(b, np.int32), np.frombuffer(s, np.float32)) for lab, cal, b, s in got]
    return train(got) if got else None


def _predictor(spark, model: Model | None):
    """Worker function: bytes -> (language or und, score, rejected)."""
    parts = None if model is None else (model.labels, model.scores, model.bias, model.temperature, model.threshold)
    sent, held = spark.sparkContext.broadcast(parts), []       # plain arrays: BUCKETS x languages floats

    def predict(text: bytes | None):
        if not held:
            held.append(sent.value and Model(*sent.value))
        m = held[0]
        if text is None or m is None or not any(map(str.isalpha, text.decode("utf-8", "replace"))):
            return "und", 0.0, True
        z = m.logits(text)
        if z is None:
            z = m.bias
        p = m.probabilities(z)
        k = int(p.argmax())
        return m.labels[k], float(min(1.0, p[k])), bool(p[k] < m.threshold)
    return predict


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, lang_pred, score, rejected)`` of every whole text.

    Null texts and texts without a letter: ``und``, score 0, rejected.  Texts
    whose letters form no gram get the model's prior.  Only the text is read:
    nulls elsewhere, repeated rows and other columns do not matter; an empty
    table gives an empty one."""
    predict = _predictor(docs.sparkSession, model)

    def run(batches):
        for b in batches:
            got = [predict(t) for t in as_bytes(b.column("text"))]
            lang, score, no = zip(*got) if got else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(lang, pa.string()), pa.array(score, pa.float64()),
                                              pa.array(no, pa.bool_())], ["doc_id", "lang_pred", "score", "rejected"])
    return (docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
            .mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean"))


def accepted(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """``docs`` without the documents that the model rejects: those without a
    letter (null and empty texts too) and those of low probability.  Repeated
    rows are judged alike; nulls elsewhere do not matter; an empty table gives
    an empty one."""
    predict = _predictor(docs.sparkSession, model)

    @F.pandas_udf("boolean")
    def keep(texts: pd.Series) -> pd.Series:
        return pd.Series([not predict(None if t is None else t.encode())[2] for t in texts], dtype=bool)
    return docs.where(keep(F.col(text_col).cast("string")))
