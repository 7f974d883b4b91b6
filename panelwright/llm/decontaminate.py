"""Benchmark decontamination: which documents hold, word for word, a window of a benchmark item.

The method is a prefix-filtered set join. A window is a set of positioned shingles; since the whole window must be contained, its
prefix under a rarity order is one shingle. Shingles are counted over all documents, and each window keeps the one that the corpus
has least. Documents are joined on those prefix shingles only; a length bound (the window fits between the ends of the document) and
a positional bound (the shingle stands where the window has it) come before the exact comparison of the window's words.

Words: A-Z lower-cased, `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`. A window is `window` consecutive words of an item; an item with
fewer, but not none, is one window. Null and empty texts have no words, so such items have no window and such documents no
hit. Rows alike in doc_id and text are judged alike, each once. Repeated item_ids count once; an item without an id makes hits but is not listed. Empty tables: no documents give no rows,
no benchmark leaves all clean. Only doc_id, text and item_id, text are read.

The index of benchmark shingles is tested against a bit map of fixed size before anything is shuffled; hits that it lets through
by chance find no partner in the join.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.llm.common import WORD_HASHES, byte_texts, folded_words, gram_hashes, row_key, saved, signed

WINDOW, SHINGLE, BITS = 10, 5, 25


def _shingle_of(hashes: np.ndarray, n: int) -> np.ndarray:
    return gram_hashes(hashes, n) + np.uint64(n)


def item_windows(benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """w (a window's words, joined by spaces), len, item_id, keys: its shingles as (offset, key)."""

    def cut(batches):
        for batch in batches:
            rows = {}
            for item, text in zip(batch["item_id"].to_pylist(), byte_texts(batch["text"])):
                words = folded_words(text)
                size = min(window, len(words))
                for at in range(len(words) - size + 1 if size else 0):
                    rows[(item, b" ".join(words[at : at + size]))] = size
            w = [x.decode() for _, x in rows]
            keys = [[{"o": o, "key": k} for o, k in enumerate(signed(_shingle_of(WORD_HASHES.array(x.encode().split()), min(shingle, size))).tolist())] for x, size in zip(w, rows.values())]
            kind = pa.list_(pa.struct([("o", pa.int32()), ("key", pa.int64())]))
            yield pa.RecordBatch.from_arrays([pa.array(w, pa.string()), pa.array(list(rows.values()), pa.int32()), pa.array([i for i, _ in rows], batch["item_id"].type), pa.array(keys, kind)], names=["w", "len", "item_id", "keys"])

    kind = benchmark.schema["item_id"].dataType.simpleString()
    return benchmark.select("item_id", "text").mapInArrow(cut, f"w string, len int, item_id {kind}, keys array<struct<o:int,key:long>>").dropDuplicates(["w", "item_id"])


def _bit_map(windows: DataFrame, shingle: int) -> tuple[np.ndarray, list[int]]:
    """Slots of all benchmark shingles in a bit map of fixed size, and the shingle lengths in use (at most `shingle`)."""
    keys = windows.select(F.explode("keys.key").alias("key"), F.least("len", F.lit(shingle)).alias("n"))
    slots = keys.select(F.shiftrightunsigned("key", 64 - BITS).alias("slot"))
    words = slots.groupBy(F.expr("slot >> 6").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 as int))")).alias("bits")).toArrow()
    out = np.zeros(1 << (BITS - 6), dtype=np.uint64)
    out[words["word"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    return out, sorted(r.n for r in keys.select("n").distinct().collect())


def shingle_hits(docs: DataFrame, windows: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """One row for each row of docs: doc_id, r, n_words, hits: (key, at, before, context) wherever a benchmark shingle may stand."""
    bitmap, lengths = _bit_map(windows, shingle)
    sent = docs.sparkSession.sparkContext.broadcast(bitmap)

    def find(batches):
        for batch in batches:
            n_words, hits = [], []
            for text in byte_texts(batch["text"]):
                words = folded_words(text)
                n_words.append(len(words))
                own = []
                hashes = WORD_HASHES.array(words) if lengths else np.zeros(0, dtype=np.uint64)
                for n in lengths:
                    keys = _shingle_of(hashes, n)
                    slot = keys >> np.uint64(64 - BITS)
                    for at in np.flatnonzero(sent.value[slot >> np.uint64(6)] >> (slot & np.uint64(63)) & np.uint64(1)).tolist():
                        low = max(0, at - window + n)
                        own.append({"key": int(keys[at].view(np.int64)), "at": at, "before": at - low, "context": b" ".join(words[low : at + window]).decode()})
                hits.append(own)
            kind = pa.list_(pa.struct([("key", pa.int64()), ("at", pa.int32()), ("before", pa.int32()), ("context", pa.string())]))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["r"], pa.array(n_words, pa.int64()), pa.array(hits, kind)], names=["doc_id", "r", "n_words", "hits"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", row_key().alias("r")).mapInArrow(find, f"doc_id {kind}, r long, n_words long, hits array<struct<key:long,at:int,before:int,context:string>>")


def contaminated_spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> tuple[DataFrame, DataFrame]:
    """Documents (doc_id, r, n_words) and the verified places r, start, end, item_id of benchmark windows in them."""
    windows = saved(item_windows(benchmark, window, shingle), "windows")
    read = saved(shingle_hits(docs, windows, window, shingle), "hits")
    hits = read.select("r", F.explode("hits").alias("hit")).select("r", "hit.*").dropDuplicates(["r", "key", "at"])
    counts = hits.groupBy("key").agg(F.count("*").alias("n"))
    shingles = windows.select("w", "len", F.explode("keys").alias("k")).select("w", "len", "k.*").distinct()
    # A window with a shingle that no document has can be nowhere.
    ranked = shingles.join(counts, "key", "left").groupBy("w", "len").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "key", "o")).alias("rare")).filter("rare.n > 0")
    prefix = ranked.select("w", "len", "rare.key", "rare.o")
    start = F.col("at") - F.col("o")
    fits = (F.col("before") >= F.col("o")) & (F.size("near") >= F.col("before") - F.col("o") + F.col("len"))
    same = F.array_join(F.slice("near", F.col("before") - F.col("o") + 1, F.col("len")), " ") == F.col("w")
    found = hits.withColumn("near", F.split("context", " ")).join(prefix, "key").filter(fits).filter(same)
    places = found.select("r", start.alias("start"), (start + F.col("len")).alias("end"), "w").distinct()
    return read.select("doc_id", "r", "n_words"), places.join(windows.select("w", "item_id"), "w").select("r", "start", "end", "item_id")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, r, n_words, n_hit (words inside a window), n_items, items_sha256, contaminated; one row for each row of docs."""
    read, places = contaminated_spans(docs, benchmark, window, shingle)
    places = saved(places, "places")
    items = places.select("r", F.col("item_id").cast("string").alias("item")).distinct().groupBy("r").agg(F.array_sort(F.collect_list("item")).alias("items"))
    hit = places.select("r", F.explode(F.sequence("start", F.col("end") - 1)).alias("word")).distinct().groupBy("r").agg(F.count("*").alias("n_hit"))
    out = read.join(items.join(hit, "r"), "r", "left")
    return out.select(
        "doc_id",
        "r",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.when(F.col("items").isNull(), 0).otherwise(F.size("items")).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")), 256).alias("items_sha256"),
        F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"),
    )


def without_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """docs without those that hold a benchmark window."""
    bad = contamination(docs, benchmark, window, shingle).filter("contaminated").select(F.col("r").alias("__r")).distinct()
    return docs.withColumn("__r", row_key()).join(bad, "__r", "left_anti").select(*docs.columns)
