"""Language ID: a byte convolutional network over batched fixed-length windows of whole texts.

Filters of several widths run over a window's bytes, each filter's greatest response is kept (max pooling), and a softmax layer
turns them into language probabilities. The network is trained in numpy on labelled texts; as an input byte is one of 256,
a filter is a sum of table look-ups, in training and in use. A text's prediction averages the outputs of all its windows,
weighted by their bytes.

Training takes at most `PER_LANGUAGE` rows of each language, chosen by a hash of doc_id, and one window of `SAMPLE_CHARS` characters of each: a
bounded sample by design. Only text and lang of the training rows are used; a prediction uses text alone.

Null texts and texts without a letter are `und` with score 0; so is every text if there is nothing to learn from. Null doc_ids count as
the text '' for the hold-out rule and are never trained on. Repeated rows are predicted alike. An empty table gives an empty result.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW, WIDTHS, FILTERS = 256, (2, 3, 4), 8
PER_LANGUAGE, SAMPLE_CHARS, STEPS, BATCH = 1200, 300, 500, 96
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")


def held_out(parts: int, which: int) -> Column:
    """Whether crc32 of doc_id as text has this remainder."""
    return F.coalesce(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % parts == which, F.lit(False))


def windows_of(text: str) -> np.ndarray:
    """All bytes of a text, case folded, as rows of `WINDOW` bytes; the last row is filled up with zeros."""
    raw = text.lower().encode()
    rows = -(-len(raw) // WINDOW)
    return np.frombuffer(raw.ljust(rows * WINDOW, b"\0"), dtype=np.uint8).reshape(rows, WINDOW)


class ByteNetwork:
    """tables[k][b]: what byte b adds, at offset k, to every filter; out: pooled responses to languages."""

    def __init__(self, languages: list[str], seed: int = 1):
        rng = np.random.default_rng(seed)
        self.languages, self.n = languages, FILTERS * len(WIDTHS)
        width = np.repeat(WIDTHS, FILTERS)
        self.inside = np.array([[k < w for w in width] for k in range(max(WIDTHS))], dtype=np.float32)
        self.tables = (rng.normal(0, 0.3, (max(WIDTHS), 256, self.n)) * self.inside[:, None, :]).astype(np.float32)
        self.out = rng.normal(0, 0.1, (self.n, len(languages))).astype(np.float32)
        self.bias = np.zeros(len(languages), dtype=np.float32)

    def responses(self, windows: np.ndarray) -> np.ndarray:
        span = WINDOW - max(WIDTHS) + 1
        acc = self.tables[0][windows[:, :span]]
        for k in range(1, max(WIDTHS)):
            acc += self.tables[k][windows[:, k : k + span]]
        return acc

    def logits(self, windows: np.ndarray) -> np.ndarray:
        pooled = np.concatenate([self.responses(windows[i : i + 32]).max(axis=1) for i in range(0, len(windows), 32)])
        return np.maximum(pooled, 0) @ self.out + self.bias

    def fit(self, windows: np.ndarray, labels: np.ndarray, steps: int = STEPS, seed: int = 2) -> "ByteNetwork":
        """Adam on the cross entropy; every batch holds all languages alike, and some windows cut short."""
        rng = np.random.default_rng(seed)
        of = [np.flatnonzero(labels == k) for k in range(len(self.languages))]
        params = [self.tables, self.out, self.bias]
        first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        for step in range(1, steps + 1):
            rows = np.concatenate([rng.choice(x, max(1, BATCH // len(of))) for x in of])
            x, y = windows[rows].copy(), labels[rows]
            short = rng.random(len(x)) < 0.4
            keep = np.where(short, rng.integers(12, WINDOW, len(x)), WINDOW)
            x[np.arange(WINDOW)[None, :] >= keep[:, None]] = 0
            acc = self.responses(x)
            at = acc.argmax(axis=1)
            pooled = np.take_along_axis(acc, at[:, None, :], 1)[:, 0]
            active = np.maximum(pooled, 0)
            z = active @ self.out + self.bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(y)), y] -= 1
            p /= len(y)
            grads = [np.zeros_like(self.tables), active.T @ p, p.sum(axis=0)]
            back = (p @ self.out.T) * (pooled > 0)
            column = np.broadcast_to(np.arange(self.n), at.shape)
            for k in range(max(WIDTHS)):
                byte = np.take_along_axis(x, at + k, 1)
                np.add.at(grads[0][k], (byte, column), back * self.inside[k])
            rate = 0.02 * min(1.0, 2 * (1 - step / (steps + 1)))
            for q, g, m, v in zip(params, grads, first, second):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                q -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        return self


def training_windows(docs: DataFrame, per_language: int = PER_LANGUAGE) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, windows and labels of a bounded sample of the rows that are not held out."""
    rows = docs.filter("lang is not null and text is not null and doc_id is not null").filter(~held_out(4, 2))
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return [], np.zeros((0, WINDOW), np.uint8), np.zeros(0, np.int64)
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    limit = F.create_map(*[x for lang, n in counts.items() for x in (F.lit(lang), F.lit(int(min(1.0, 1.3 * per_language / n) * (1 << 30))))])
    start = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(3)), F.greatest(F.length("text") - SAMPLE_CHARS, F.lit(1))) + 1
    cut = F.substring("text", start.cast("int"), F.lit(SAMPLE_CHARS))
    sample = rows.filter(draw < limit[F.col("lang")]).select("lang", draw.alias("draw"), cut.alias("cut")).collect()
    languages, chosen = sorted(counts), []
    for k, lang in enumerate(languages):
        own = sorted((r.draw, r.cut) for r in sample if r.lang == lang and _LETTER.search(r.cut))[:per_language]
        chosen += [(windows_of(c)[0], k) for _, c in own]
    return languages, np.array([w for w, _ in chosen], np.uint8).reshape(-1, WINDOW), np.array([k for _, k in chosen], np.int64)


def fitted(docs: DataFrame, per_language: int = PER_LANGUAGE) -> ByteNetwork | None:
    """A network trained on docs; None if no row can be learned from."""
    languages, windows, labels = training_windows(docs, per_language)
    present = sorted(set(labels.tolist()))
    if not present:
        return None
    again = {k: i for i, k in enumerate(present)}
    return ByteNetwork([languages[k] for k in present]).fit(windows, np.array([again[k] for k in labels.tolist()]))


def predicted(network: ByteNetwork | None, texts: list[str | None]) -> list[tuple[str, float]]:
    """(language, score) of each text. The windows of all texts go through the network together, `BATCH` at a time."""
    out = [(UNKNOWN, 0.0)] * len(texts)
    known = [i for i, text in enumerate(texts) if network is not None and text and _LETTER.search(text)]

    def decide(own: list[tuple[int, np.ndarray]]) -> None:
        windows = np.concatenate([w for _, w in own])
        weight = np.count_nonzero(windows, axis=1).astype(np.float64)
        starts = np.concatenate([[0], np.cumsum([len(w) for _, w in own])[:-1]])
        full = np.ones(len(windows), dtype=bool)
        full[starts + [len(w) - 1 for _, w in own]] = False
        weight[full] = WINDOW
        z = np.concatenate([network.logits(windows[at : at + BATCH]) for at in range(0, len(windows), BATCH)])
        mean = np.add.reduceat(z * weight[:, None], starts, axis=0) / np.maximum(1.0, np.add.reduceat(weight, starts))[:, None]
        p = np.exp(mean - mean.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        for (i, _), best, row in zip(own, p.argmax(axis=1).tolist(), p):
            out[i] = (network.languages[best], float(row[best]))

    own, size = [], 0
    for i in known:
        own.append((i, windows_of(texts[i])))
        size += len(own[-1][1])
        if size >= BATCH:
            decide(own)
            own, size = [], 0
    if own:
        decide(own)
    return out


def identified(docs: DataFrame, network: ByteNetwork | None) -> DataFrame:
    """docs with lang_pred and score."""
    columns = [c for c in docs.columns if c not in ("lang_pred", "score")]

    def predict(batches):
        for batch in batches:
            made = predicted(network, batch["text"].to_pylist())
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in columns), pa.array([x for x, _ in made], pa.string()), pa.array([x for _, x in made], pa.float64())], names=[*columns, "lang_pred", "score"])

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns)
    return docs.select(*columns).mapInArrow(predict, f"{schema}, lang_pred string, score double")


def language_predictions(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row, by a network trained on the rows that are not held out."""
    out = identified(docs.select("doc_id", "text", held_out(4, 2).alias("held_out")), fitted(docs))
    return out.select("doc_id", "held_out", "lang_pred", "score")


def in_a_known_language(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """docs without the texts whose language is not known: no letter, or a score under `least`."""
    named = identified(docs.withColumnsRenamed({c: f"__{c}" for c in ("lang_pred", "score") if c in docs.columns}), fitted(docs))
    kept = named.filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least)).drop("lang_pred", "score")
    return kept.withColumnsRenamed({f"__{c}": c for c in ("lang_pred", "score")}).select(*docs.columns)
