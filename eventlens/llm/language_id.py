"""Language ID by a byte convolutional network, trained in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventlens.llm.common import KEY, keyed, stored
from eventlens.llm.textbytes import pieces

#: Bytes of a window, and of its overlap with the next one.
WINDOW = 256
#: Widths of the filters in bytes, filters of each width, numbers per embedded byte.
WIDTHS, FILTERS, EMBEDDED = (2, 3, 4), 16, 8
#: Places of a training text from which a window is learned.
PLACES = 2
#: Labelled rows to train on, for each language at most.
TRAIN_ROWS = 1500
#: Windows that go through the network at once.
BATCH = 256
UNDETERMINED = "und"
_PAD = 0
_WIDEST = max(WIDTHS)


@dataclass
class ByteNet:
    """Embedding, filters of several widths, the maximum over places, softmax.

    The filters of all widths stand in one matrix over the widest span; entries beyond a
    filter's width stay zero.
    """

    labels: list[str]
    embedding: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    def pooled(self, windows: np.ndarray):
        """Strongest response of each filter in each window, its place, and the spans."""
        e = self.embedding[windows]
        n, length, d = e.shape
        spans = np.lib.stride_tricks.sliding_window_view(e, _WIDEST, axis=1)
        spans = np.ascontiguousarray(spans.transpose(0, 1, 3, 2)).reshape(n, -1, _WIDEST * d)
        scores = spans.reshape(-1, _WIDEST * d) @ self.filters
        scores = scores.reshape(n, length - _WIDEST + 1, -1)
        place = scores.argmax(axis=1)
        best = np.take_along_axis(scores, place[:, None, :], axis=1)[:, 0, :]
        return best + self.bias, place, spans

    def responses(self, windows: np.ndarray) -> np.ndarray:
        e = self.embedding[windows]
        n, length, d = e.shape
        flat = e.reshape(n, length * d)
        places = length - _WIDEST + 1
        spans = np.lib.stride_tricks.as_strided(
            flat, (n, places, _WIDEST * d), (flat.strides[0], d * flat.itemsize, flat.itemsize)
        )
        scores = np.matmul(spans, self.filters)
        return scores.max(axis=1) + self.bias

    def log_probabilities(self, windows: np.ndarray) -> np.ndarray:
        z = np.maximum(self.responses(windows), 0) @ self.out + self.out_bias
        z -= z.max(axis=1, keepdims=True)
        return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


def _mask() -> np.ndarray:
    return np.concatenate(
        [
            np.repeat((np.arange(_WIDEST) < w).astype(np.float32), EMBEDDED)[:, None].repeat(FILTERS, 1)
            for w in WIDTHS
        ],
        axis=1,
    )


def cut_windows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fixed-length windows that cover each text whole, and the row of each.

    The last window of a text is padded with zero bytes; neighbours overlap so that no
    span of bytes that a filter sees is lost.
    """
    step = WINDOW - (_WIDEST - 1)
    lengths = np.diff(offsets)
    counts = np.where(lengths > 0, np.maximum(1, -(-(lengths - (_WIDEST - 1)) // step)), 0)
    rows = np.repeat(np.arange(len(lengths)), counts)
    within = np.arange(len(rows)) - np.repeat(np.cumsum(counts) - counts, counts)
    at = (offsets[rows] + within * step)[:, None] + np.arange(WINDOW)
    inside = at < offsets[rows + 1][:, None]
    return np.where(inside, data[np.minimum(at, len(data) - 1)], _PAD), rows


def train(texts: list[bytes], labels: list[str], epochs: int = 6, seed: int = 1) -> ByteNet:
    """Fits the network with Adam to the first window of each labelled piece of text."""
    rng = np.random.default_rng(seed)
    names = sorted(set(labels))
    index = {name: i for i, name in enumerate(names)}
    width = FILTERS * len(WIDTHS)
    net = ByteNet(
        names,
        rng.normal(0, 0.5, (256, EMBEDDED)).astype(np.float32),
        (rng.normal(0, 0.3, (_WIDEST * EMBEDDED, width)) * _mask()).astype(np.float32),
        np.zeros(width, np.float32),
        rng.normal(0, 0.3, (width, len(names))).astype(np.float32),
        np.zeros(len(names), np.float32),
    )
    windows, target = [], []
    for text, label in zip(texts, labels, strict=True):
        data = np.frombuffer(text, np.uint8)
        cut, _ = cut_windows(data, np.array([0, len(data)]))
        windows.append(cut[:1])
        target.append(index[label])
    x, y = np.concatenate(windows), np.array(target)
    # Short texts too: some windows keep a part of their bytes only.
    for i in np.flatnonzero(rng.random(len(x)) < 0.4):
        x[i, rng.integers(12, WINDOW) :] = _PAD
    frequency = np.bincount(y, minlength=len(names)) / len(y)
    weight = (1 / (len(names) * np.maximum(frequency, 1e-9)))[y].astype(np.float32)
    params = ["embedding", "filters", "bias", "out", "out_bias"]
    moments = {p: [np.zeros_like(getattr(net, p)) for _ in range(2)] for p in params}
    mask, step = _mask(), 0
    for _ in range(epochs):
        for batch in np.array_split(rng.permutation(len(x)), max(1, len(x) // 64)):
            step += 1
            grads = _gradients(net, x[batch], y[batch], weight[batch])
            for p in params:
                g = grads[p] * mask if p == "filters" else grads[p]
                m, v = moments[p]
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                scale = 0.004 * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
                getattr(net, p)[...] -= scale * m / (np.sqrt(v) + 1e-8)
    return net


def _gradients(net: ByteNet, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict:
    best, place, spans = net.pooled(x)
    hidden = np.maximum(best, 0)
    z = hidden @ net.out + net.out_bias
    z -= z.max(axis=1, keepdims=True)
    d_z = np.exp(z)
    d_z /= d_z.sum(axis=1, keepdims=True)
    d_z[np.arange(len(y)), y] -= 1
    d_z *= (weight / len(y))[:, None]
    d_best = (d_z @ net.out.T) * (best > 0)
    chosen = spans[np.arange(len(y))[:, None], place]  # windows x filters x span
    d_filters = np.einsum("nf,nfs->sf", d_best, chosen)
    d_span = d_best[:, :, None] * net.filters.T[None]
    d_embedding = np.zeros_like(net.embedding)
    at = place[:, :, None] + np.arange(_WIDEST)
    codes = x[np.arange(len(y))[:, None, None], at]
    np.add.at(d_embedding, codes, d_span.reshape(*d_best.shape, _WIDEST, EMBEDDED))
    return {
        "embedding": d_embedding, "filters": d_filters, "bias": d_best.sum(axis=0),
        "out": hidden.T @ d_z, "out_bias": d_z.sum(axis=0),
    }


def fit_language_id(
    labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", rows: int = TRAIN_ROWS
) -> ByteNet | None:
    """Learns from ``rows`` labelled texts of each language, those with the smallest hashes.

    Of each, the windows at :data:`PLACES` places drawn from the whole text by its hash are
    used.  Rows without language, or without a letter, are left out; None if no row is left.
    """
    texts = labelled.select(
        F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")
    ).filter(F.col("lang").isNotNull() & has_letter(F.col("text")))
    hashed = texts.withColumn("h", F.xxhash64("text"))
    room = F.greatest(F.length("text") - WINDOW + 1, F.lit(1))
    places = [F.pmod(F.xxhash64("text", F.lit(i)), room).cast("int") + 1 for i in range(PLACES)]
    drawn = F.array_distinct(F.array(*places))
    drawn = F.transform(drawn, lambda at: F.substring(F.col("text"), at, F.lit(WINDOW)))
    # Chosen without their texts, which are fetched for the chosen ones only.
    order = Window.partitionBy("lang").orderBy("h")
    chosen = (
        hashed.select("lang", "h").distinct()
        .withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= rows).drop("rank")
    )
    sample = (
        hashed.join(stored(chosen, "chosen"), ["lang", "h"])
        .select("lang", "h", drawn.alias("drawn"))
        .dropDuplicates(["lang", "h"])
        .orderBy("lang", "h")
        .select("lang", F.explode("drawn").alias("text"))
    )
    got = sample.toPandas()
    if not len(got):
        return None
    return train([t.encode() for t in got["text"]], list(got["lang"]))


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def identify_languages(
    docs: DataFrame, net: ByteNet | None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``(doc_id, text_key, lang_pred, score)`` of each row, from its whole text.

    The log probabilities of all windows of a text are averaged; ``score`` is the mean
    probability of the predicted language.  Texts that are null or have no letter are
    ``und`` with score 0, and so is every text if there is no network.  Repeated rows
    get the same result; other columns are not read.
    """
    rows = keyed(docs, id_col, text_col).withColumn("known", has_letter(F.col("text")))
    if net is None:
        return rows.select(*KEY, F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("score"))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known = batch.column("known").to_numpy(zero_copy_only=False)
            for a, b, data, offsets in pieces(batch, "text"):
                logs = np.zeros((b - a, len(net.labels)))
                sums, counts = np.zeros((b - a, len(net.labels))), np.zeros(b - a)
                if len(data):
                    for part in _parts(data, offsets):
                        windows, row = part
                        for i in range(0, len(windows), BATCH):
                            log = net.log_probabilities(windows[i : i + BATCH])
                            np.add.at(logs, row[i : i + BATCH], log)
                            np.add.at(sums, row[i : i + BATCH], np.exp(log))
                            np.add.at(counts, row[i : i + BATCH], 1)
                best = logs.argmax(axis=1)
                score = sums[np.arange(b - a), best] / np.maximum(counts, 1)
                ok = known[a:b] & (counts > 0)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(a, b - a),
                        batch.column("text_key").slice(a, b - a),
                        pa.array([net.labels[i] if k else UNDETERMINED for i, k in zip(best, ok, strict=True)]),
                        pa.array(np.where(ok, np.clip(score, 0, 1), 0.0)),
                    ],
                    names=["doc_id", "text_key", "lang_pred", "score"],
                )

    return rows.mapInArrow(predict, "doc_id long, text_key long, lang_pred string, score double")


def _parts(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Windows of a piece of texts, a bounded number at a time."""
    rows = np.arange(len(offsets) - 1)
    if len(rows) == 1 and len(data) > 1 << 20:
        step = (1 << 20) // (WINDOW - _WIDEST + 1) * (WINDOW - _WIDEST + 1)
        for at in range(0, len(data), step):
            part = data[at : at + step + _WIDEST - 1]
            yield cut_windows(part, np.array([0, len(part)]))
        return
    yield cut_windows(data, offsets)
