"""Quality classifier: importance resampling by hashed n-gram models.

Two generative models give each hashed byte n-gram a probability: one of target text (labelled good), one of the raw corpus. `log_ratio` is the sum of
the log ratio of the two over a document's n-grams: the importance weight of the whole text. Sampling by it would keep little but the longest texts, so
the models are compared on a sketch of equal length for all: `SKETCH` n-grams at even steps over the whole text (a shorter text has all of its own). `log_weight` is the
sum of the log ratio over the sketch, its importance weight. One sketch looks at some places only; with `whole`, `log_weight` is the mean over all sketches of that size, so every
n-gram counts alike: `SKETCH` times the mean log ratio of all of them (a text of fewer keeps its own sum). The registered query draws so. Documents are drawn without replacement in proportion to these weights by the Gumbel top-k trick: each gets its log weight plus Gumbel noise made
from a hash of the row, and those with the `share` largest sums are selected: exactly that many.

The raw model counts every document whole. The target model counts at most `MOST_TARGET` documents labelled 1, chosen by a hash of doc_id:
a bounded sample by design. Both sum in buckets, so what is gathered is as large as the bucket table for each task.

Null and empty texts have no n-gram and weight 0. Null labels and null doc_ids are no target. Rows alike in doc_id and text get the same
noise, and are selected together unless the limit falls between them; then as many of them are as are left, which of these like rows is of no matter.
An empty table gives an empty result; without labels all weights are 0. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.llm.common import MULTIPLIER, byte_texts, row_key, saved

GRAM, BITS, SKETCH, SHARE, MOST_TARGET = 4, 16, 100, 0.85, 4000


def gram_counts(text: bytes | None) -> np.ndarray:
    """Counts of a text's byte n-grams in hash buckets; a shorter text has none."""
    data = np.frombuffer(text or b"", dtype=np.uint8)
    n = len(data) - GRAM + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    keys = np.zeros(n, dtype=np.uint64)
    for k in range(GRAM):
        keys = (keys << np.uint64(8)) | data[k : k + n]
    return ((keys * MULTIPLIER) >> np.uint64(64 - BITS)).astype(np.int64)


def fitted(docs: DataFrame, labels: DataFrame, most_target: int = MOST_TARGET) -> np.ndarray:
    """Log ratio of target and raw probability of each bucket, add-one smoothed."""
    good = labels.filter("quality = 1 and doc_id is not null").select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_target)
    rows = docs.select("doc_id", "text").join(F.broadcast(good.withColumn("target", F.lit(1))), "doc_id", "left").select("text", F.coalesce("target", F.lit(0)).alias("target"))

    def count(batches):
        totals = np.zeros((2, 1 << BITS), dtype=np.int64)
        for batch in batches:
            for text, target in zip(byte_texts(batch["text"]), batch["target"].to_pylist()):
                own = np.bincount(gram_counts(text), minlength=1 << BITS) if text and len(text) > 4096 else None
                for row in (0, 1)[: 1 + target]:
                    if own is not None:
                        totals[row] += own
                    else:
                        np.add.at(totals[row], gram_counts(text), 1)
        some = np.flatnonzero(totals[0])
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(totals[0][some]), pa.array(totals[1][some])], names=["bucket", "raw", "target"])

    sums = rows.mapInArrow(count, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toArrow()
    raw, target = np.ones(1 << BITS), np.ones(1 << BITS)
    raw[sums["bucket"].to_numpy()] += sums["raw"].to_numpy()
    target[sums["bucket"].to_numpy()] += sums["target"].to_numpy()
    if target.sum() == len(target):
        return np.zeros(1 << BITS)
    return np.log(target / target.sum()) - np.log(raw / raw.sum())


def sketch(buckets: np.ndarray, size: int = SKETCH) -> np.ndarray:
    """At most `size` of a text's n-grams, at even steps from its start to its end."""
    return buckets if len(buckets) <= size else buckets[np.arange(size) * len(buckets) // size]


def weighted(docs: DataFrame, ratio: np.ndarray, size: int = SKETCH, seed: int = 0, whole: bool = False) -> DataFrame:
    """doc_id, r (row key), log_ratio, log_weight (of one sketch, or with `whole` the mean over all), noisy (with Gumbel noise) of each row, and place, a number of its own."""

    def weigh(batches):
        for batch in batches:
            own = [gram_counts(text) for text in byte_texts(batch["text"])]
            sums = np.array([ratio[x].sum() for x in own], dtype=np.float64)
            if whole:
                weights = sums * np.array([min(1.0, size / max(1, len(x))) for x in own], dtype=np.float64)
            else:
                weights = np.array([ratio[sketch(x, size)].sum() for x in own], dtype=np.float64)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["r"], pa.array(sums), pa.array(weights)], names=["doc_id", "r", "log_ratio", "log_weight"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = docs.select("doc_id", "text", row_key().alias("r")).mapInArrow(weigh, f"doc_id {kind}, r long, log_ratio double, log_weight double")
    uniform = (F.pmod(F.xxhash64(F.col("r"), F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    return out.withColumns({"noisy": F.col("log_weight") - F.log(-F.log(uniform)), "place": F.monotonically_increasing_id()})


def kth_largest(values: DataFrame, k: int, few: int = 20_000) -> float | None:
    """The k-th largest `noisy` (of any number type), exactly: approximate quantiles close in on it until few rows are left; None if k is 0."""
    low, high, above = float("-inf"), float("inf"), 0
    while k > 0:
        inside = values.filter((F.col("noisy") >= low) & (F.col("noisy") <= high)).select("noisy")
        n = inside.count()
        if n <= few or low == high:
            rest = sorted((r.noisy for r in inside.collect()), reverse=True) if n <= few else None
            return rest[k - above - 1] if rest else low
        q = 1 - (k - above) / n
        a, b = inside.approxQuantile("noisy", [max(0.0, q - 0.01), min(1.0, q + 0.01)], 0.002)
        over = inside.filter(F.col("noisy") > b).count()
        at_least = inside.filter(F.col("noisy") >= a).count()
        if not over < k - above <= at_least:
            raise RuntimeError("quantiles out of their bounds")
        low, high, above = a, b, above + over
    return None


def resampled(docs: DataFrame, labels: DataFrame, share: float = SHARE, seed: int = 0, whole: bool = False) -> DataFrame:
    """doc_id, log_ratio, log_weight, noisy, selected of every row; exactly share of all, rounded up, are selected. whole: drawn by all n-grams of a text, not by one sketch."""
    out = saved(weighted(docs, fitted(docs, labels), seed=seed, whole=whole), "weights")
    k = int(np.ceil(share * out.count()))
    limit = kth_largest(out, k)
    chosen = F.lit(False)
    if limit is not None:
        # Of the rows at the limit, those at the last places are taken until there are k.
        at_limit = out.filter(F.col("noisy") == limit).select(F.col("place").alias("noisy"))
        last = kth_largest(at_limit, k - out.filter(F.col("noisy") > limit).count())
        chosen = (F.col("noisy") > limit) | ((F.col("noisy") == limit) & (F.col("place") >= int(last)))
    return out.select("doc_id", "log_ratio", "log_weight", "noisy", chosen.alias("selected"))
