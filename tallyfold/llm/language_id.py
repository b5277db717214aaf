"""Language identification by a bidirectional gated recurrent network over bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyfold.llm.adam import Adam, sigmoid
from tallyfold.llm.textbytes import flat, lean, pieces

HIDDEN = 8  # units a direction
SPAN = 128  # bytes that one run of the network sees; the windows cover the whole text

_LETTER = np.zeros(256, bool)
_LETTER[list(range(65, 91)) + list(range(97, 123)) + list(range(128, 256))] = True


def _states(w: dict, way: str, x: np.ndarray, real: np.ndarray, keep: list | None = None) -> np.ndarray:
    """States after each byte of windows x (windows, bytes), in the order of the text; the way back starts at each window's end."""
    table, u = w[f"{way}_in"], w[f"{way}_state"]
    n, length = x.shape
    out = np.empty((length, n, HIDDEN), np.float32)
    h = np.zeros((n, HIDDEN), np.float32)
    for t in range(length) if way == "to" else reversed(range(length)):
        i, s = table[x[:, t]], h @ u
        gates = sigmoid(i[:, : 2 * HIDDEN] + s[:, : 2 * HIDDEN])
        z, r = gates[:, :HIDDEN], gates[:, HIDDEN:]
        new = np.tanh(i[:, 2 * HIDDEN :] + r * s[:, 2 * HIDDEN :])
        if keep is not None:
            keep.append((t, h, z, r, new, s[:, 2 * HIDDEN :]))
        h = (new + z * (h - new)) * real[:, t, None]
        out[t] = h
    return out


def _back(w: dict, way: str, x: np.ndarray, real: np.ndarray, kept: list, d_out: np.ndarray, grad: dict) -> None:
    """Backpropagation through time of one direction."""
    u = w[f"{way}_state"]
    d_h = np.zeros((len(x), HIDDEN), np.float32)
    for t, h, z, r, new, s in reversed(kept):
        d = (d_h + d_out[t]) * real[:, t, None]
        d_new = d * (1 - z) * (1 - new * new)
        d_z = d * (h - new) * z * (1 - z)
        d_r = d_new * s * r * (1 - r)
        d_in = np.concatenate([d_z, d_r, d_new], axis=1)
        d_s = np.concatenate([d_z, d_r, d_new * r], axis=1)
        np.add.at(grad[f"{way}_in"], x[:, t], d_in)
        grad[f"{way}_state"] += h.T @ d_s
        d_h = d * z + d_s @ u.T


def _start(languages: int, seed: int = 2) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    make = lambda *shape: (rng.normal(size=shape) * 0.3).astype(np.float32)
    out = {f"{way}_{kind}": make(n, 3 * HIDDEN) for way in ("to", "fro") for kind, n in (("in", 256), ("state", HIDDEN))}
    return out | {"to_out": make(HIDDEN, languages), "fro_out": make(HIDDEN, languages), "bias": np.zeros(languages, np.float32)}


def _probabilities(w: dict, to: np.ndarray, fro: np.ndarray) -> np.ndarray:
    logits = to @ w["to_out"] + fro @ w["fro_out"] + w["bias"]
    logits -= logits.max(axis=-1, keepdims=True)
    np.exp(logits, out=logits)
    logits /= logits.sum(axis=-1, keepdims=True)
    return logits


def fit(windows: np.ndarray, labels: np.ndarray, languages: int, steps: int = 250, batch: int = 128, rate: float = 0.02, seed: int = 2) -> dict[str, np.ndarray]:
    """Weights from windows of bytes (windows, bytes; 0 past the end) and the label of each. Every letter's position is a labelled example."""
    w = _start(languages, seed)
    rng, adam = np.random.default_rng(seed), Adam(w, rate)
    for step in range(steps):
        rows = rng.integers(0, len(windows), batch)
        x, y = windows[rows], labels[rows]
        real = (x > 0).astype(np.float32)
        kept: dict[str, list] = {"to": [], "fro": []}
        state = {way: _states(w, way, x, real, kept[way]) for way in kept}
        p = _probabilities(w, state["to"], state["fro"])
        weight = _LETTER[x].T.astype(np.float32)
        d = p.copy()
        d[:, np.arange(batch), y] -= 1
        d *= weight[:, :, None] / max(1.0, float(weight.sum()))
        grad = {k: np.zeros_like(v) for k, v in w.items()}
        grad["bias"] = d.sum(axis=(0, 1))
        for way in kept:
            grad[f"{way}_out"] = np.tensordot(state[way], d, axes=([0, 1], [0, 1]))
            _back(w, way, x, real, kept[way], d @ w[f"{way}_out"].T, grad)
        adam.rate = rate * (1 - 0.9 * step / steps)
        adam.move(grad)
    return w


def predict(w: dict, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Of each text the mean probability of each language over the positions of its letters, and the number of these."""
    data, at = flat(column)
    languages = len(w["bias"])
    n = -(-np.diff(at) // SPAN)
    row = np.repeat(np.arange(len(n)), n)
    start = at[:-1][row] + SPAN * (np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n))
    total, letters = np.zeros((len(n), languages)), np.zeros(len(n))
    padded = np.concatenate([data, np.zeros(SPAN, np.uint8)])
    for i in range(0, len(row), 4096):
        begin, own = start[i : i + 4096], row[i : i + 4096]
        place = begin[:, None] + np.arange(SPAN)
        inside = place < at[1:][own][:, None]
        x = padded[np.where(inside, place, len(data))]
        real = inside.astype(np.float32)
        p = _probabilities(w, _states(w, "to", x, real), _states(w, "fro", x, real))
        weight = (_LETTER[x] & inside).T
        np.add.at(total, own, np.einsum("tnl,tn->nl", p, weight.astype(np.float32)))
        np.add.at(letters, own, weight.sum(axis=0))
    return total / np.maximum(letters, 1)[:, None], letters


def _sampled(length: int, each: int):
    """Windows of training texts, at places that depend on the text alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, "text"):
                data, at = flat(batch.column("text"))
                labels, out, own = batch.column("lang").to_pylist(), [], []
                for lang, a, b in zip(labels, at[:-1].tolist(), at[1:].tolist(), strict=True):
                    spare = max(1, b - a - length)
                    for j in range(min(each, max(1, (b - a) // length))):
                        begin = a + (j * 7919 + (b - a) * 31) % spare
                        out.append(data[begin : min(b, begin + length)].tobytes().ljust(length, b"\0"))
                        own.append(lang)
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.string()), pa.array(out, pa.binary())], names=["lang", "window"])

    return lean(run)


def train(labelled: DataFrame, most: int = 2000, length: int = 48, each: int = 4, steps: int = 250) -> tuple[list[str], dict]:
    """(languages, weights) from labelled (doc_id, text, lang).

    The sample is bounded: of each language's non-empty labelled texts the `most` // 4 first by a hash of doc_id, and `each` windows of
    each. Languages are learned in the order of their names; without any labelled text there are none.
    """
    rows = labelled.where("lang IS NOT NULL AND text IS NOT NULL AND text <> '' AND doc_id IS NOT NULL").select("doc_id", "lang", F.xxhash64(F.lit(2), "doc_id").alias("h"))
    quota = max(1, most // 4)
    # First within 64 parts of a language, so that no task ranks a whole language.
    part = rows.withColumn("part", F.pmod("h", F.lit(64))).withColumn("r", F.row_number().over(Window.partitionBy("lang", "part").orderBy("h", "doc_id"))).where(F.col("r") <= quota)
    best = part.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))).where(F.col("r") <= quota)
    chosen = best.select("doc_id", "lang").distinct()
    texts = labelled.select("doc_id", "lang", "text").join(F.broadcast(chosen), ["doc_id", "lang"], "left_semi")
    got = texts.select("text", "lang").mapInArrow(_sampled(length, each), "lang string, window binary").collect()
    got = sorted((r.lang, bytes(r.window)) for r in got)
    languages = sorted({lang for lang, _ in got})
    if not languages:
        return [], {}
    x = np.frombuffer(b"".join(window for _, window in got), np.uint8).reshape(len(got), length)
    y = np.array([languages.index(lang) for lang, _ in got])
    return languages, fit(x, y, len(languages), steps)


def identify(docs: DataFrame, languages: list[str], weights: dict) -> DataFrame:
    """(doc_id, lang_pred, score) of each row of docs (doc_id, text).

    lang_pred has the highest mean probability over all letters of the whole text, and score is that; ties go to the
    earlier name. A null text, or one without a letter, is `und` with score 0, as is every text if no language was
    learned. Repeated rows come back repeated; an empty table gives an empty one; other columns are ignored.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, "text"):
                text = batch.column("text")
                names, scores = ["und"] * len(text), np.zeros(len(text))
                if languages:
                    mean, letters = predict(weights, text)
                    best = mean.argmax(axis=1)
                    data, at = flat(text)
                    plain = np.concatenate([[0], np.cumsum(_LETTER[data] & (data < 128))])[at]
                    for i in np.flatnonzero(letters).tolist():
                        if plain[i + 1] > plain[i] or any(map(str.isalpha, text[i].as_py())):
                            names[i], scores[i] = languages[best[i]], float(mean[i, best[i]])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names, pa.string()), pa.array(np.clip(scores, 0, 1))], names=["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(lean(run), f"doc_id {kind}, lang_pred string, score double")
