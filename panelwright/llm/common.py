"""What several of the text operators share: reading, saving, row keys, words and word hashes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from panelwright.sources.session import saved, ship_package  # noqa: F401

#: Bytes that stand in words of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after lower-casing A-Z: digits, a-z and all of UTF-8 above ASCII.
_WORD_TABLE = bytes((b + 32 if 65 <= b <= 90 else b) if (48 <= b <= 57 or 97 <= b <= 122 or 65 <= b <= 90 or b >= 128) else 32 for b in range(256))
#: Odd multiplier of all rolling hashes here.
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of at most so many rows, since one row can hold a whole book; and workers that know this package."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def row_key() -> Column:
    """64-bit key of a document row by doc_id and text; rows alike in both are one document given twice."""
    return F.xxhash64("doc_id", "text")


#: Slots (as a power of two) of the bit map of `passing`, and the rows of 64 bits it so has at most: 2 MB, safe to broadcast.
SLOTS = 23


def passing(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """The rows whose 64-bit key may be among the wanted: a bit map of fixed size, made and tested by joins on its words. Lets through some that are not wanted."""
    slot = F.shiftrightunsigned(key, 64 - SLOTS)
    bit = F.expr(f"shiftleft(1L, cast(shiftrightunsigned(`{key}`, {64 - SLOTS}) & 63 AS int))")
    words = wanted.groupBy(F.shiftright(slot, 6).alias("word")).agg(F.bit_or(bit).alias("bits"))
    return rows.withColumn("word", F.shiftright(slot, 6)).join(F.broadcast(words), "word").filter(F.col("bits").bitwiseAND(bit) != 0).drop("word", "bits")


def byte_texts(column: pa.Array) -> list:
    """UTF-8 bytes of each text, None for null."""
    return column.cast(pa.large_binary()).to_pylist()


def folded_words(text: bytes | None) -> list[bytes]:
    """Words of letters and digits, A-Z lower-cased; null has none."""
    return text.translate(_WORD_TABLE).split() if text else []


class WordHashes(dict):
    """64-bit hashes of words, computed once each; bounded, so that a long-lived worker stays small."""

    LIMIT = 200_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        value = self[word] = xxh3_64_intdigest(word)
        return value

    def array(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


WORD_HASHES = WordHashes()


def mixed(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the whole word."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def gram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n consecutive items; empty when there are fewer."""
    size = len(hashes) - n + 1
    if size <= 0:
        return np.zeros(0, dtype=np.uint64)
    acc = np.zeros(size, dtype=np.uint64)
    for i in range(n):
        acc *= MULTIPLIER
        acc += hashes[i : i + size]
    return mixed(acc)


def sliding(values: np.ndarray, width: int, pick=np.minimum) -> np.ndarray:
    """Minimum (or maximum) of each window of `width` values, by doubling."""
    out, span = values, 1
    while span * 2 <= width:
        out = pick(out[:-span], out[span:])
        span *= 2
    rest = width - span
    return pick(out[:-rest], out[rest:]) if rest else out


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
