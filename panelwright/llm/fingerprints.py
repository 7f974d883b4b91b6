"""Document fingerprints: a homomorphic multiset hash of a text's paragraphs.

Each paragraph (the text between line feeds, empty ones too) is hashed to a wide vector; a fingerprint is the sum of its paragraphs'
vectors, lane by lane, modulo a power of two. So the order of paragraphs does not matter, equal texts have equal fingerprints, and a paragraph can be added or
taken out by adding or subtracting its vector, without the rest of the text.

A vector has two parts. `EXACT` lanes modulo 2**32 are the paragraph's SHAKE-128 output: multisets that differ have different sums
but by chance. `ALIKE` lanes modulo 2**16 are a signed count sketch of the paragraph's eight-byte runs, so the inner product of two fingerprints
estimates how many runs the texts share: likeness is 2<x, y> / (<x, x> + <y, y>), cut to 0..1, and 1 where all lanes agree. Its standard error is about
1 / sqrt(ALIKE) for texts without much repetition; sums of very long repetitive texts may wrap, which only touches likeness.

Null text counts as empty, and an empty text as one empty paragraph. doc_id may be of any type that can be sorted. Order is by descending doc_id, nulls last, equal
doc_ids by descending `xxhash64` of the text; the next document of the last is the first, of a single one itself. Repeated rows are documents of their
own. An empty table gives an empty result. Only doc_id and text are read.

At scale: keys alone are range-partitioned first, which gives the last key of each bucket of neighbours. Then each text moves once, to its bucket, and the
text with the last key of a bucket goes to the next bucket as well. Buckets grow in number with the rows. A key that repeats over several buckets is dealt
among these at random, as rows of one key are alike.
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from panelwright.llm.common import MULTIPLIER, byte_texts

EXACT, ALIKE, RUN = 32, 512, 8
#: Documents to a bucket of neighbours: at most, as more buckets are made beyond; and at least, so that a repeated key is in every bucket it is dealt to.
BUCKET, FEWEST = 65536, 256
#: Last keys (of some 40 bytes) up to which their table is broadcast; beyond, it is joined by a shuffle.
MOST_BROADCAST = 2_000_000


def _sketch(block: bytes) -> np.ndarray:
    """Signed counts of the eight-byte runs inside each paragraph of a block; a shorter paragraph is one run, padded."""
    parts = block.split(b"\n")
    if min(map(len, parts)) < RUN:
        block = b"\n".join(p if len(p) >= RUN else p.ljust(RUN, b"\0") for p in parts)
    data = np.frombuffer(block, dtype=np.uint8)
    n = len(data) - RUN + 1
    keys = np.empty(n, dtype=np.uint64)
    for k in range(min(RUN, n)):
        size = (len(data) - k) // RUN
        keys[k::RUN] = np.frombuffer(block, dtype="<u8", count=size, offset=k)[: len(keys[k::RUN])]
    if len(parts) > 1:
        ends = np.flatnonzero(data == 10)
        crossing = np.zeros(len(data) + 1, dtype=np.int32)
        np.add.at(crossing, np.maximum(ends - RUN + 1, 0), 1)
        np.add.at(crossing, ends + 1, -1)
        keys = keys[np.cumsum(crossing)[:n] == 0]
    keys = (keys ^ (keys >> np.uint64(29))) * MULTIPLIER
    lanes = (keys >> np.uint64(64 - (2 * ALIKE - 1).bit_length())).astype(np.int64)
    counts = np.bincount(lanes, minlength=2 * ALIKE)
    return (counts[:ALIKE] - counts[ALIKE:]).astype(np.uint16)


def paragraph_vectors(block: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Sum of the vectors of the paragraphs of a block of text."""
    parts = block.split(b"\n")
    raw = b"".join(hashlib.shake_128(p).digest(4 * EXACT) for p in parts)
    exact = np.frombuffer(raw, dtype="<u4").reshape(len(parts), EXACT).sum(axis=0, dtype=np.uint32)
    return exact, _sketch(block)


def inserted(fingerprint, block: bytes):
    """The fingerprint with the paragraphs of a block added."""
    return tuple(a + b for a, b in zip(fingerprint, paragraph_vectors(block)))


def deleted(fingerprint, block: bytes):
    """The fingerprint with the paragraphs of a block taken out."""
    return tuple(a - b for a, b in zip(fingerprint, paragraph_vectors(block)))


def fingerprint(text: bytes):
    return paragraph_vectors(text)


def written(fingerprint) -> str:
    return base64.b64encode(fingerprint[0].astype("<u4").tobytes() + fingerprint[1].astype("<u2").tobytes()).decode()


def likeness(one, other) -> float:
    if (one[0] == other[0]).all() and (one[1] == other[1]).all():
        return 1.0
    x, y = one[1].view(np.int16).astype(np.float64), other[1].view(np.int16).astype(np.float64)
    both = x @ x + y @ y
    return float(min(1.0, max(0.0, 2 * (x @ y) / both))) if both else 0.0


def edited(text: str, following: str) -> str:
    """The text whose last third is replaced by as much of the beginning of the following one."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


def edited_fingerprint(own, text: bytes, new: bytes):
    """The edited text's fingerprint, made from the text's own: paragraphs that differ are deleted and inserted."""
    same = 0
    shared = min(len(text), len(new))
    if text[:shared] == new[:shared]:
        same = shared
    else:
        a, b = np.frombuffer(text, np.uint8, shared), np.frombuffer(new, np.uint8, shared)
        same = int(np.argmax(a != b))
    start = text.rfind(b"\n", 0, same) + 1
    return inserted(deleted(own, text[start:]), new[start:])


def _bucket_of(tails: list[tuple]):
    """A column function of doc_id, text hash and a random number to the bucket whose last key is the first not before the row's."""
    shared = SparkSession.getActiveSession().sparkContext.broadcast(tails)

    @F.arrow_udf("int")
    def bucket(doc_id: pa.Array, h: pa.Array, draw: pa.Array) -> pa.Array:
        known, out = shared.value, []
        for i, x, r in zip(doc_id.to_pylist(), h.to_pylist(), draw.to_pylist()):
            key = (i is not None, i, x)
            low = bisect_left(known, key)
            some = bisect_right(known, key, low) - low
            out.append(min(low + int(r * some), len(known) - 1))
        return pa.array(out, pa.int32())

    return bucket


def neighbours(docs: DataFrame, bucket: int = BUCKET, fewest: int = FEWEST) -> DataFrame:
    """doc_id, text, bucket, guest: rows in ascending order in buckets of consecutive keys; each bucket begins with a copy (guest 0) of the row before it."""
    spark = docs.sparkSession
    h = F.xxhash64(F.coalesce("text", F.lit("")))
    rows = docs.select("doc_id", "text", h.alias("h"))
    n = docs.count()
    wanted = max(1, min(max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // bucket)), n // fewest))
    key = F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "h")
    # The random number lets a key that repeats very often end more than one bucket.
    dealt = rows.select("doc_id", "h").repartitionByRange(wanted, F.asc_nulls_first("doc_id"), "h", F.rand(5))
    tails = sorted(tuple(r.tail) for r in dealt.groupBy(F.spark_partition_id().alias("p")).agg(F.max(key).alias("tail")).collect())
    if not tails:
        return docs.select("doc_id", "text", F.lit(0).alias("bucket"), F.lit(1).alias("guest"), F.lit(0).cast("long").alias("h"))
    number = _bucket_of(tails)("doc_id", "h", F.rand(6)) if len(tails) > 1 else F.lit(0)
    own = rows.withColumns({"bucket": number, "guest": F.lit(1)})
    # One text for each last key; it goes to the bucket after the last one that ends with it.
    last = {t: k for k, t in enumerate(tails)}
    after = [(t[1], t[2], (k + 1) % len(tails)) for t, k in last.items()] + [(t[1], t[2], k) for k, t in enumerate(tails[:-1], 1) if tails[k] == t]
    schema = StructType([StructField("doc_id", docs.schema["doc_id"].dataType), StructField("h", LongType()), StructField("bucket", IntegerType())])
    places = spark.createDataFrame(after, schema).withColumnsRenamed({"doc_id": "i", "h": "x"})
    places = F.broadcast(places) if len(after) < MOST_BROADCAST else places
    met = rows.join(places, F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("h") == F.col("x")))
    guests = met.groupBy("doc_id", "h", "bucket").agg(F.first("text").alias("text")).withColumn("guest", F.lit(0)).select(own.columns)
    return own.unionByName(guests).repartition("bucket").sortWithinPartitions("bucket", "guest", F.asc_nulls_first("doc_id"), "h")


def fingerprinted(docs: DataFrame, bucket: int = BUCKET, fewest: int = FEWEST) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for each row of docs."""

    def sign(batches):
        following, found = "", None  # the next document is the one read just before
        for batch in batches:
            ids, out = [], []
            for k, (raw, guest) in enumerate(zip(byte_texts(batch["text"]), batch["guest"].to_pylist())):
                raw = raw or b""
                text, own = raw.decode(), fingerprint(raw)
                if guest:
                    new = edited(text, following).encode()
                    print_new = edited_fingerprint(own, raw, new)
                    ids.append(k)
                    out.append((len(text), hashlib.sha256(new).hexdigest(), written(own), written(print_new), likeness(own, print_new), likeness(own, found)))
                following, found = text, own
            if out:
                kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
                yield pa.RecordBatch.from_arrays([batch["doc_id"].take(pa.array(ids, pa.int64())), *(pa.array(c, k) for c, k in zip(zip(*out), kinds))], names=names)

    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kind = docs.schema["doc_id"].dataType.simpleString()
    return neighbours(docs, bucket, fewest).mapInArrow(sign, f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
