"""Quality classifier: a convolutional network over the bytes of a whole document."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from thermoline.llm.common import arrow_map, bounded_sample, library_path, others

#: Shape of the network: bytes a chunk and from one to the next, numbers a byte, filters (each over
#: TAPS pairs of bytes, moved by a pair), hidden units.
CHUNK, STEP, DEPTH, TAPS, FILTERS, HIDDEN = 128, 96, 8, 4, 24, 16
PAIRS = CHUNK // 2
SPOTS = PAIRS - TAPS + 1

#: Bounds of the training sample: rows of each label, and bytes of both.
SAMPLE_ROWS = 800
SAMPLE_BYTES = 3 << 20

MADE = ["score", "predicted"]


def chunks(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Chunks that cover every byte of all texts, and the first chunk of each text. The last one
    ends with the text; a shorter text, also an empty one, fills up with zeros."""
    raw = np.frombuffer(b"".join([*texts, bytes(CHUNK)]), np.uint8)
    starts, firsts, valid, at, n = [], [], [], 0, 0
    for text in texts:
        last = max(0, len(text) - CHUNK)
        own = np.append(np.arange(0, last, STEP), last)
        firsts.append(n)
        starts.append(own + at)
        valid.append(np.full(len(own), len(text)))
        n, at = n + len(own), at + len(text)
    begin = np.concatenate(starts)
    grid = raw[begin[:, None] + np.arange(CHUNK)]
    size = np.concatenate(valid)
    small = size < CHUNK
    grid[small] = np.where(np.arange(CHUNK) < size[small, None], grid[small], 0)
    return grid, np.array(firsts)


@dataclass
class Network:
    """Embedded bytes, filters with maximum and mean over each chunk, a hidden layer, the maximum
    of each hidden unit over all chunks of a document, and one probability from these."""

    weights: dict[str, np.ndarray]
    tables: np.ndarray | None = field(default=None, repr=False)

    @classmethod
    def fresh(cls, seed: int = 7) -> Network:
        r = np.random.default_rng(seed)
        f32 = np.float32
        return cls({
            "emb": r.normal(0, 0.5, (256, DEPTH)).astype(f32),
            "conv": r.normal(0, (2 * DEPTH * TAPS) ** -0.5, (TAPS, 2 * DEPTH, FILTERS)).astype(f32),
            "bias": np.zeros(FILTERS, f32),
            "hid": r.normal(0, FILTERS ** -0.5, (2 * FILTERS, HIDDEN)).astype(f32),
            "hbias": np.full(HIDDEN, 0.1, f32),
            "out": r.normal(0, HIDDEN ** -0.5, HIDDEN).astype(f32), "obias": np.zeros(1, f32)})

    def __getstate__(self):
        return {"weights": self.weights, "tables": None}

    def responses(self, grid: np.ndarray) -> np.ndarray:
        """Rectified filter responses (chunk, spot, filter). A filter's part for one pair of bytes
        depends on the pair alone, so all parts are looked up."""
        if self.tables is None:
            both = np.arange(1 << 16)
            pair = np.concatenate([self.weights["emb"][both & 255],
                                   self.weights["emb"][both >> 8]], 1)
            self.tables = np.concatenate([pair @ w for w in self.weights["conv"]], 1)
        parts = self.tables[grid.view("<u2")]
        total = self.weights["bias"] + parts[:, :SPOTS, :FILTERS]
        for j in range(1, TAPS):
            total += parts[:, j:j + SPOTS, j * FILTERS:(j + 1) * FILTERS]
        return np.maximum(total, 0, out=total)

    def hidden(self, grid: np.ndarray) -> np.ndarray:
        out = []
        for at in range(0, len(grid), 256):
            a = self.responses(grid[at:at + 256])
            pooled = np.concatenate([a.max(1), a.mean(1)], 1)
            out.append(np.maximum(pooled @ self.weights["hid"] + self.weights["hbias"], 0))
        return np.concatenate(out)

    def probability(self, pooled: np.ndarray) -> np.ndarray:
        z = pooled @ self.weights["out"] + self.weights["obias"]
        return 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -30, 30)))

    def score(self, texts: list[bytes]) -> np.ndarray:
        """Probability of label 1 for each text, read whole."""
        if not texts:
            return np.zeros(0)
        grid, firsts = chunks(texts)
        return self.probability(np.maximum.reduceat(self.hidden(grid), firsts, axis=0))

    def score_long(self, text: bytes, piece: int) -> float:
        """As `score` for one text, with memory for one piece: maxima of pieces are joined. Pieces
        overlap, and begin where a chunk would, so that all chunks are the same."""
        best, step = None, piece // STEP * STEP
        for at in range(0, max(1, len(text) - CHUNK + STEP), step):
            part = text[at:at + step + CHUNK - STEP]
            if at and len(part) < CHUNK:
                part = text[-CHUNK:]
            top = self.hidden(chunks([part])[0]).max(0)
            best = top if best is None else np.maximum(best, top)
        return float(self.probability(best[None])[0])

    def gradients(self, grid: np.ndarray, firsts: np.ndarray, labels: np.ndarray,
                  share: np.ndarray) -> dict[str, np.ndarray]:
        w = self.weights
        self.tables = None
        h = self.hidden(grid)
        pooled = np.maximum.reduceat(h, firsts, axis=0)
        slope = ((self.probability(pooled) - labels) * share).astype(np.float32)
        g = {"out": pooled.T @ slope, "obias": slope.sum(keepdims=True)}
        # Only the chunk with the maximum passes a gradient on, for each document and unit.
        ends = np.append(firsts[1:], len(h))
        winner = np.stack([a + h[a:b].argmax(0) for a, b in zip(firsts, ends, strict=True)])
        back = (slope[:, None] * w["out"]) * (pooled > 0)
        rows, at = np.unique(winner, return_inverse=True)
        dh = np.zeros((len(rows), HIDDEN), np.float32)
        np.add.at(dh, (at.reshape(-1), np.tile(np.arange(HIDDEN), len(firsts))), back.reshape(-1))
        x = grid[rows]
        a = self.responses(x)
        top = a.argmax(1)
        both = np.concatenate([a.max(1), a.mean(1)], 1)
        g["hid"], g["hbias"] = both.T @ dh, dh.sum(0)
        dboth = dh @ w["hid"].T
        da = np.repeat(dboth[:, None, FILTERS:] / SPOTS, SPOTS, 1)
        i, f = np.ogrid[:len(rows), :FILTERS]
        da[i, top, f] += dboth[:, :FILTERS]
        da *= a > 0
        g["bias"] = da.sum((0, 1))
        pair = w["emb"][x].reshape(len(rows), PAIRS, 2 * DEPTH)
        dpair, flat = np.zeros_like(pair), da.reshape(-1, FILTERS)
        g["conv"] = np.empty_like(w["conv"])
        for j in range(TAPS):
            g["conv"][j] = pair[:, j:j + SPOTS].reshape(-1, 2 * DEPTH).T @ flat
            dpair[:, j:j + SPOTS] += (flat @ w["conv"][j].T).reshape(len(rows), SPOTS, 2 * DEPTH)
        one = np.zeros((256, DEPTH), np.float32)
        each = dpair.reshape(-1, DEPTH)
        for d in range(DEPTH):
            one[:, d] = np.bincount(x.reshape(-1), each[:, d], 256)
        g["emb"] = one
        return g

    def fit(self, texts: list[bytes], labels: np.ndarray, steps: int = 400, batch: int = 32,
            rate: float = 4e-3, seed: int = 7) -> Network:
        """Adam on the log loss, both labels with equal weight in all; the same data in the same
        order give the same network. All texts are seen equally often, in `steps` batches or a few
        more."""
        epochs = -(-steps // -(-len(texts) // batch))
        r = np.random.default_rng(seed)
        n = np.array([(labels == v).sum() for v in (0, 1)])
        share = len(labels) / (2.0 * np.maximum(n, 1))[labels]
        mean = {k: np.zeros_like(v) for k, v in self.weights.items()}
        square = {k: np.zeros_like(v) for k, v in self.weights.items()}
        step, total = 0, epochs * -(-len(texts) // batch)
        for _ in range(epochs):
            order = r.permutation(len(texts))
            for at in range(0, len(order), batch):
                some = order[at:at + batch]
                grid, firsts = chunks([texts[i] for i in some])
                grads = self.gradients(grid, firsts, labels[some], share[some] / len(some))
                step += 1
                pace = rate * min(1.0, 1.2 * (1 - step / (total + 1)))
                for k, v in grads.items():
                    mean[k] += 0.1 * (v - mean[k])
                    square[k] += 0.01 * (v * v - square[k])
                    self.weights[k] -= (pace * (mean[k] / (1 - 0.9 ** step)) / (
                        np.sqrt(square[k] / (1 - 0.99 ** step)) + 1e-6)).astype(np.float32)
        self.tables = None
        return self


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality",
          max_rows: int = SAMPLE_ROWS, max_bytes: int = SAMPLE_BYTES) -> Network:
    """A network fitted to a bounded sample of the rows of `docs` that `labels` marks 0 or 1: at
    most `max_rows` texts of each label and `max_bytes` bytes in all go to the driver. A document
    with several labels takes the smallest. Without rows, the network is as it was drawn."""
    marks = labels.where(f"{label} in (0, 1) and doc_id is not null").groupBy("doc_id").agg({
        label: "min"}).toDF("doc_id", "_label")
    rows = bounded_sample(docs.select("doc_id", "text"), "_label", max_rows, max_bytes,
                          marks).collect()
    rows = sorted((r["text"].encode(), int(r["_label"])) for r in rows)
    network = Network.fresh()
    if rows:
        network.fit([t for t, _ in rows], np.array([y for _, y in rows]))
    return network


#: Longer texts are scored piece by piece.
WHOLE = 4 << 20


def classify(docs: DataFrame, network: Network) -> DataFrame:
    """All columns with `score`, the probability of label 1 from `text` alone, and `predicted`.
    In the registered query `held_out` is null where doc_id is.

    Null and empty texts are chunks of zeros and get the score of these. Rows are independent:
    repeated rows get equal scores; an empty table gives an empty one. Every byte of a text is
    read, in memory that does not grow with its length.
    """
    library_path(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(network)

    def run(rows: pa.RecordBatch, texts: list) -> list[pa.Array]:
        raw = [(t or "").encode() for t in texts]
        own = shared.value
        if len(raw) == 1 and len(raw[0]) > WHOLE:
            score = np.array([own.score_long(raw[0], WHOLE)])
        else:
            score = own.score(raw)
        # Sums in another order differ in the last places only: rounded, equal texts score equal.
        score = np.round(score, 6)
        return [pa.array(score), pa.array((score >= 0.5).astype(np.int32))]

    made = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]
    return arrow_map(docs.select(*others(docs, MADE)), "text", made, run, portion=2 << 20)
