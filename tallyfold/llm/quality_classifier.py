"""A quality classifier by attention-based multiple-instance learning (Ilse, Tomczak, Welling 2018): a document is a bag of passages."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.llm.adam import Adam, sigmoid
from tallyfold.llm.textbytes import U, Words, lean, pieces

PASSAGE = 64  # words
BUCKETS = 64  # of hashed words
UNITS = 16
ATTENTION = 8

_KINDS = np.zeros((256, 7), bool)
_KINDS[list(b"#*$%&|<>"), 0] = True
_KINDS[list(b"!?"), 1] = True
_KINDS[65:91, 2] = True
_KINDS[97:123, 3] = True
_KINDS[48:58, 4] = True
_KINDS[128:, 5] = True
_KINDS[list(b".,;:"), 6] = True
WIDTH = BUCKETS + _KINDS.shape[1] + 3


def passages(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages of the texts, and how many each text has: one at least, of zeros for a text without words."""
    w = Words(column)
    n = np.maximum(1, -(-w.count // PASSAGE))
    first = np.cumsum(n) - n
    x = np.zeros((int(n.sum()), WIDTH), np.float32)
    if len(w.start):
        own = first[w.row] + (np.arange(len(w.row)) - w.first[w.row]) // PASSAGE
        words = np.bincount(own, minlength=len(x)).astype(np.float32)
        some = np.maximum(words, 1)
        hashed = np.bincount(own * BUCKETS + (w.hash % U(BUCKETS)).astype(np.int64), minlength=len(x) * BUCKETS).reshape(-1, BUCKETS)
        x[:, :BUCKETS] = np.sqrt(hashed / some[:, None])
        starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        filled = own[starts]
        edges = np.r_[w.start[starts], len(w.data)]
        for j in range(_KINDS.shape[1]):
            seen = np.concatenate([[0], np.cumsum(_KINDS[w.data, j], dtype=np.int64)])
            x[filled, BUCKETS + j] = np.minimum(4, (seen[edges[1:]] - seen[edges[:-1]]) / some[filled])
        x[filled, BUCKETS + 7] = np.bincount(own, w.end - w.start, len(x))[filled] / some[filled] / 8
        word = own.astype(U) << U(40) ^ w.hash >> U(24)
        kept = own[np.unique(word, return_index=True)[1]]  # distinct words of a passage
        x[:, BUCKETS + 8] = np.bincount(kept, minlength=len(x)) / some
        x[:, BUCKETS + 9] = words / PASSAGE
    return x, n


def _start(seed: int) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    make = lambda *shape: (rng.normal(size=shape) / np.sqrt(shape[0])).astype(np.float32)
    return {"encode": make(WIDTH, UNITS), "encode0": np.zeros(UNITS, np.float32), "v": make(UNITS, ATTENTION), "u": make(UNITS, ATTENTION), "attend": make(ATTENTION, 1)[:, 0], "out": make(UNITS, 1)[:, 0], "out0": np.zeros(1, np.float32)}


def forward(w: dict, x: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, dict]:
    """Probability of label 1 of each bag; gated attention weighs its encoded passages into one representation."""
    starts = np.cumsum(n) - n
    h = np.tanh(x @ w["encode"] + w["encode0"])
    a, g = np.tanh(h @ w["v"]), sigmoid(h @ w["u"])
    e = (a * g) @ w["attend"]
    e = np.exp(e - np.repeat(np.maximum.reduceat(e, starts), n))
    weight = e / np.repeat(np.add.reduceat(e, starts), n)
    z = np.add.reduceat(weight[:, None] * h, starts)
    return sigmoid(z @ w["out"] + w["out0"]), {"h": h, "a": a, "g": g, "weight": weight, "z": z}


def fit(bags: list[np.ndarray], labels: np.ndarray, epochs: int = 20, batch: int = 64, rate: float = 0.01, seed: int = 5) -> dict[str, np.ndarray]:
    w = _start(seed)
    adam, rng = Adam(w, rate), np.random.default_rng(seed)
    for epoch in range(epochs):
        adam.rate = rate * (1 - 0.8 * epoch / epochs)
        order = rng.permutation(len(bags))
        for i in range(0, len(order), batch):
            rows = order[i : i + batch]
            x, n = np.concatenate([bags[j] for j in rows]), np.array([len(bags[j]) for j in rows])
            p, s = forward(w, x, n)
            d = (p - labels[rows]).astype(np.float32) / len(rows)
            d_z = d[:, None] * w["out"]
            each = np.repeat(d_z, n, axis=0)
            d_weight = (each * s["h"]).sum(axis=1)
            mean = np.add.reduceat(s["weight"] * d_weight, np.cumsum(n) - n)
            d_e = s["weight"] * (d_weight - np.repeat(mean, n))
            d_ag = d_e[:, None] * w["attend"]
            d_a, d_g = d_ag * s["g"] * (1 - s["a"] ** 2), d_ag * s["a"] * s["g"] * (1 - s["g"])
            d_h = (each * s["weight"][:, None] + d_a @ w["v"].T + d_g @ w["u"].T) * (1 - s["h"] ** 2)
            adam.move({"encode": x.T @ d_h + 1e-4 * w["encode"], "encode0": d_h.sum(axis=0), "v": s["h"].T @ d_a, "u": s["h"].T @ d_g, "attend": (s["a"] * s["g"]).T @ d_e, "out": s["z"].T @ d + 1e-4 * w["out"], "out0": d.sum(keepdims=True)})
    return w


def _bags(longest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, "text"):
                x, n = passages(batch.column("text"))
                ends = np.cumsum(n)
                some = [x[np.unique(np.linspace(a, b - 1, min(b - a, longest)).astype(np.int64))].tobytes() for a, b in zip(ends - n, ends, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("quality"), pa.array(some, pa.binary())], names=["doc_id", "quality", "bag"])

    return lean(run)


def train(labelled: DataFrame, most: int = 3000, longest: int = 64) -> dict[str, np.ndarray]:
    """Weights from labelled (doc_id, text, quality 0 or 1). The sample is bounded: the `most` first by a hash of doc_id, and of a document with
    more than `longest` passages as many, evenly spread over it; 57 MB at these settings. Without labels no weights."""
    rows = labelled.where("quality IN (0, 1) AND doc_id IS NOT NULL")
    chosen = rows.select("doc_id").orderBy(F.xxhash64(F.lit(5), "doc_id"), "doc_id").limit(most).distinct()
    got = rows.join(F.broadcast(chosen), "doc_id", "left_semi").select("doc_id", "quality", "text").mapInArrow(_bags(longest), "doc_id bigint, quality int, bag binary").collect()
    got = sorted((r.doc_id, r.quality, bytes(r.bag)) for r in got)
    if not got:
        return {}
    return fit([np.frombuffer(b, np.float32).reshape(-1, WIDTH) for _, _, b in got], np.array([q for _, q, _ in got], np.float32))


def score_quality(docs: DataFrame, weights: dict[str, np.ndarray]) -> DataFrame:
    """(doc_id, score) of each row of docs (doc_id, text): the probability of label 1 over all passages of the whole text.

    Null and empty texts are scored as one passage without words. Without weights every score is 0.5. Repeated rows come
    back repeated; very long texts count whole; an empty table gives an empty one; other columns are ignored.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, "text"):
                score = forward(weights, *passages(batch.column("text")))[0] if weights else np.full(batch.num_rows, 0.5)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.clip(score.astype(np.float64), 0, 1))], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(lean(run), f"doc_id {kind}, score double")
