"""Operator 3: quality classifier, a byte-level convolutional network in numpy.

Method: every filter looks at ``WIDTH`` consecutive bytes of the UTF-8 text, through one
learned weight per place and byte.  Chunks of ``CHUNK`` bytes, each overlapping the next by
half, cover the whole text; a filter's rectified maximum in a chunk is the chunk's feature.
The mean, the maximum and the minimum of the features over all chunks are weighed into one
probability.  Filters and weights are learned together (logistic loss, Adam), the gradient
flowing back to the place of each maximum.

Training uses at most ``TRAIN_ROWS`` labelled documents, those with the smallest hash of
their id, and at most ``TRAIN_CHUNKS`` evenly spread chunks of each (both documented
bounds): what reaches the driver does not grow with the corpus.  Scoring is a narrow pass
over every whole text, in blocks, so memory does not grow with a text.

Defined cases: null text is the empty text, scored as padding; a text shorter than a
filter is padded with zero bytes; null labels and ids are not trained on; rows labelled
more than once take the smallest label; without any usable label every score is 0.5;
repeated rows get equal scores; an empty table gives an empty result; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tomefold.llm.common import held_out, prepare

WIDTH = 8
FILTERS = 24
HALF = 256
CHUNK = 2 * HALF
TRAIN_ROWS = 2000
TRAIN_CHUNKS = 16
EPOCHS = 5
BATCH = 16
RATE = 0.01
BLOCK = 256 * HALF


def new_model(seed: int = 11) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    return {"table": (rng.standard_normal((WIDTH, 256, FILTERS)) * 0.15).astype(np.float32),
            "bias": np.zeros(FILTERS, np.float32),
            "out": (rng.standard_normal((3, FILTERS)) * 0.1).astype(np.float32), "base": np.zeros(1, np.float32)}


def padded(data: bytes) -> np.ndarray:
    return np.frombuffer(data.ljust(WIDTH, b"\0"), np.uint8)


def _responses(model: dict, data: np.ndarray) -> np.ndarray:
    """Filter values at every place of ``data``."""
    n = len(data) - WIDTH + 1
    total = model["table"][0][data[:n]]
    for k in range(1, WIDTH):
        total += model["table"][k][data[k:k + n]]
    return total


def _forward(model: dict, chunks: list[np.ndarray]):
    """Features of a document's chunks, with the place of each maximum."""
    best, places = [], []
    for chunk in chunks:
        r = _responses(model, chunk)
        at = r.argmax(axis=0)
        places.append(at)
        best.append(r[at, np.arange(FILTERS)])
    h = np.maximum(np.array(best) + model["bias"], 0)
    pooled = np.stack([h.mean(axis=0), h.max(axis=0), h.min(axis=0)])
    return h, np.array(places), pooled, float((pooled * model["out"]).sum() + model["base"][0])


def train(samples: list[tuple[list[np.ndarray], int]], seed: int = 12) -> dict[str, np.ndarray] | None:
    """Fit the network on (chunks, label) samples; None without samples."""
    if not samples:
        return None
    model, rng = new_model(), np.random.default_rng(seed)
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in model.items()}
    share = float(np.mean([y for _, y in samples]))
    model["base"][0] = np.log((share + 0.01) / (1.01 - share))
    step, lanes = 0, np.arange(FILTERS)
    for _ in range(EPOCHS):
        order = rng.permutation(len(samples))
        for begin in range(0, len(order), BATCH):
            grads = {k: np.zeros_like(v) for k, v in model.items()}
            some = order[begin:begin + BATCH]
            for i in some:
                chunks, label = samples[i]
                h, places, pooled, z = _forward(model, chunks)
                g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - label) / len(some)
                grads["out"] += g * pooled
                grads["base"] += g
                back = np.repeat(g * model["out"][0][None] / len(chunks), len(chunks), axis=0)
                back[h.argmax(axis=0), lanes] += g * model["out"][1]
                back[h.argmin(axis=0), lanes] += g * model["out"][2]
                back *= h > 0
                grads["bias"] += back.sum(axis=0)
                for c, chunk in enumerate(chunks):
                    for k in range(WIDTH):
                        np.add.at(grads["table"][k], (chunk[places[c] + k], lanes), back[c])
            step += 1
            for k, v in model.items():
                m, s = moments[k]
                m += 0.1 * (grads[k] - m)
                s += 0.001 * (grads[k] ** 2 - s)
                v -= RATE * (m / (1 - 0.9 ** step)) / (np.sqrt(s / (1 - 0.999 ** step)) + 1e-8)
    return model


def chunks_of(data: np.ndarray) -> list[np.ndarray]:
    """Overlapping chunks that cover all places of a text; a filter may end in the next half."""
    n = len(data) - WIDTH + 1
    return [data[a:min(a + CHUNK, n) + WIDTH - 1] for a in range(0, max(1, n - HALF), HALF)]


class Scorer:
    """Scores whole texts.  Two neighbouring bytes are looked up at once."""

    def __init__(self, model: dict):
        self.model = model
        pairs = np.arange(1 << 16)
        self.pairs = [model["table"][k][pairs & 255] + model["table"][k + 1][pairs >> 8] for k in range(0, WIDTH, 2)]

    def _half_maxima(self, data: np.ndarray) -> np.ndarray:
        """The largest filter values of every half chunk."""
        n, out = len(data) - WIDTH + 1, []
        for begin in range(0, n, BLOCK):
            m = min(BLOCK, n - begin)
            some = data[begin:begin + m + WIDTH - 1].astype(np.uint16)
            pair = some[:-1] | (some[1:] << 8)
            total = self.pairs[0][pair[:m]]
            for k in range(1, WIDTH // 2):
                total += self.pairs[k][pair[2 * k:2 * k + m]]
            out.append(np.maximum.reduceat(total, np.arange(0, m, HALF), axis=0))
        return np.concatenate(out)

    def score(self, text: str | None) -> float:
        halves = self._half_maxima(padded((text or "").encode("utf-8", "surrogatepass")))
        best = np.maximum(halves[:-1], halves[1:]) if len(halves) > 1 else halves
        h = np.maximum(best + self.model["bias"], 0)
        pooled = np.stack([h.mean(axis=0), h.max(axis=0), h.min(axis=0)])
        z = float((pooled * self.model["out"]).sum() + self.model["base"][0])
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def training_sample(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS):
    """(chunks, label) of a bounded sample of the labelled documents."""
    prepare(docs.sparkSession)
    picked = (labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
              .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows))
    texts = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
             .join(F.broadcast(picked), "doc_id").select("quality", "text"))  # at most ``rows`` rows

    def cut(batches):
        for batch in batches:
            labels_, parts = [], []
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                chunks = chunks_of(padded((text.as_py() or "").encode("utf-8", "surrogatepass")))
                at = np.unique(np.linspace(0, len(chunks) - 1, TRAIN_CHUNKS).round().astype(int))
                labels_.append(label)
                parts.append([chunks[i].tobytes() for i in at])
            yield pa.RecordBatch.from_arrays([pa.array(labels_, pa.int64()), pa.array(parts, pa.list_(pa.binary()))],
                                             names=["label", "chunks"])

    got = texts.mapInArrow(cut, "label long, chunks array<binary>").limit(2 * rows).collect()
    got.sort(key=lambda r: (r["label"], r["chunks"]))  # any order of tasks trains the same model
    return [([np.frombuffer(c, np.uint8) for c in r["chunks"]], int(r["label"] == 1)) for r in got]


def classify(docs: DataFrame, model: dict | None) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])

    def score(batches):
        scorer = Scorer(shared.value) if shared.value else None
        for batch in batches:
            got = [scorer.score(t.as_py()) if scorer else 0.5 for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(got, pa.float64()),
                                              pa.array([int(s >= 0.5) for s in got], pa.int32())], schema=schema)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(score, "doc_id long, held_out boolean, score double, predicted int")
