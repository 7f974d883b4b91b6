"""Substring dedup: documents are factored against an index of all of them; long factors are duplicate spans.

The method is relative Lempel-Ziv parsing. The reference is the corpus itself, indexed in hash-partitioned blocks: an entry of the
index is a run of windows (`span` words each) or one window, with the place where its word sequence starts. A document is parsed from
its first word on: at each position the index gives a source, and the factor goes on as long as the next entry has the same source one
step on. So a factor is a longest run that one source covers, its length is at least `span`, and the windows at a factor's
boundaries, which a run misses, have entries of their own.

What reaches the index is little. Each window contains a minimizer, the least hash of its eight-word runs, and equal windows have
equal minimizers; so windows whose minimizer stands at one place only cannot recur. Consecutive windows with one minimizer form a
run. A run that is found again as a whole is one entry. Only where a minimizer has runs that differ are single windows entered: those of each run that
stands alone, and, to be found by them, those of the others. No window that recurs is lost by this.

Results for odd input: null text has no words; texts shorter than `span` words lose nothing; rows alike in doc_id and text
are two places, so each makes the other a copy; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.llm.common import MULTIPLIER, WORD_HASHES, byte_texts, mixed, row_key, saved, signed, sliding

SPAN = 35
RUN = 8
#: The filter of wanted keys has so many bits for each of them, and is broadcast up to so many bytes (2 ** 24 = 16 MB).
BITS_EACH, MOST_BYTES = 16, 1 << 24
_INVERSE = np.uint64(pow(int(MULTIPLIER), -1, 1 << 64))
_MIXED = np.uint64(0xD6E8FEB86659FD93)


def plain_words(text: bytes | None) -> list[bytes]:
    """Words `[^\\x20\\x09-\\x0D]+`: bytes are split at just these."""
    return text.split() if text else []


class Runs:
    """The windows of one text and their runs: m (minimizer), first and end (windows), g (hash of all words of the run)."""

    def __init__(self, words: list[bytes], span: int):
        hashes = WORD_HASHES.array(words)
        n = len(hashes)
        powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, MULTIPLIER)]), dtype=np.uint64)
        self.back = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, _INVERSE)]), dtype=np.uint64)
        self.sums = np.concatenate([[np.uint64(0)], np.cumsum(hashes * powers[:n], dtype=np.uint64)])
        self.checks = np.concatenate([[np.uint64(0)], np.cumsum(mixed(hashes) * powers[:n], dtype=np.uint64)])
        self.span = span
        starts = np.arange(n - RUN + 1)
        self.runs = self.hash_of(starts, starts + RUN)
        self.least = sliding(self.runs, span - RUN + 1)
        self.first = np.concatenate([[0], np.flatnonzero(self.least[1:] != self.least[:-1]) + 1])
        self.end = np.concatenate([self.first[1:], [len(self.least)]])
        self.m = self.least[self.first]
        self.g = self.hash_of(self.first, self.end + span - 1)

    def hash_of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.back[start] + (end - start).astype(np.uint64))

    def windows(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hash and check of the windows that start there."""
        check = mixed((self.checks[at + self.span] - self.checks[at]) * self.back[at])
        return self.hash_of(at, at + self.span), check.astype(np.uint32).view(np.int32)

    def places(self) -> np.ndarray:
        """For each run the number of places at which its minimizer stands in the text, counted with the first run that has it."""
        edge = np.zeros(self.span - RUN, dtype=np.uint64)
        most = sliding(np.concatenate([edge, self.least, edge]), self.span - RUN + 1, np.maximum)
        _, counts = np.unique(self.runs[most == self.runs], return_counts=True)
        _, first = np.unique(self.m, return_index=True)
        out = np.zeros(len(self.m), dtype=np.int64)
        out[first] = counts
        return out


def counted_runs(docs: DataFrame, span: int = SPAN) -> DataFrame:
    """m, g, n (runs), k (places of the minimizer) over the whole corpus."""

    def count(batches):
        for batch in batches:
            found = [Runs(words, span) for words in map(plain_words, byte_texts(batch["text"])) if len(words) >= span]
            if found:
                m, g, k = (np.concatenate(x) for x in zip(*((r.m, r.g, r.places()) for r in found)))
                g, at, of = np.unique(g, return_index=True, return_inverse=True)
                columns = signed(m[at]), signed(g), np.bincount(of), np.bincount(of, weights=k).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["m", "g", "n", "k"])

    return docs.select("text").mapInArrow(count, "m long, g long, n long, k long").groupBy("m", "g").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))


def wanted_keys(counts: DataFrame) -> DataFrame:
    """key: each minimizer at two places or more; again, marked, if its runs differ; and the runs of such that stand alone."""
    by_m = counts.groupBy("m").agg(F.sum("k").alias("k"), F.min("n").alias("least")).filter("k > 1")
    by_m = saved(by_m.select("m", (F.col("least") == 1).alias("differ")), "minimizers")
    differ = by_m.filter("differ").select("m")
    lone = counts.filter("n = 1").join(differ, "m", "left_semi").select(F.col("g").alias("key"))
    mark = F.col("m").bitwiseXOR(F.lit(int(_MIXED.view(np.int64))))
    return by_m.select(F.col("m").alias("key")).union(differ.select(mark.alias("key"))).union(lone)


def _slots(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    shift = np.uint64(64 - bits)
    return keys >> shift, (keys * MULTIPLIER) >> shift


def _filter_of(wanted: DataFrame, bits: int) -> np.ndarray:
    """Two bits for each key. The words of the bit map are built by an aggregation; their number is bounded by its size."""

    def slots(batches):
        for batch in batches:
            slot = np.concatenate(_slots(batch["key"].to_numpy(zero_copy_only=False).view(np.uint64), bits))
            yield pa.RecordBatch.from_arrays([pa.array(signed(slot >> np.uint64(6))), pa.array(signed(np.uint64(1) << (slot & np.uint64(63))))], names=["word", "bit"])

    rows = wanted.mapInArrow(slots, "word long, bit long").groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(1 << (bits - 6), dtype=np.uint64)
    out[rows["word"].to_numpy()] = rows["bits"].to_numpy().view(np.uint64)
    return out


def index_entries(docs: DataFrame, wanted: DataFrame, span: int = SPAN, most_bytes: int = MOST_BYTES) -> DataFrame:
    """The index: hash h and check c of a run or window, its place (row key r, start s), n windows; n = 0 only counts as a partner.

    The wanted keys go to the tasks as a bit filter while it stays under `most_bytes`; above, they are joined by a shuffle to the
    documents that have them. What the filter lets through by chance only adds entries that find no partner.
    """
    spark, keyed = docs.sparkSession, docs.select(row_key().alias("r"), "text")
    bits = max(16, int(BITS_EACH * max(1, wanted.count()) - 1).bit_length())
    bitmap = spark.sparkContext.broadcast(_filter_of(wanted, bits)) if (1 << bits) // 8 <= most_bytes else None
    if bitmap is None:

        def keys(batches):
            for batch in batches:
                for r, text in zip(batch["r"].to_pylist(), byte_texts(batch["text"])):
                    words = plain_words(text)
                    if len(words) >= span:
                        runs = Runs(words, span)
                        own = np.unique(np.concatenate([runs.m, runs.m ^ _MIXED, runs.g]))
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), r)), pa.array(signed(own))], names=["r", "key"])

        own = keyed.mapInArrow(keys, "r long, key long").join(wanted, "key", "left_semi").groupBy("r").agg(F.collect_set("key").alias("known"))
        keyed = keyed.join(own, "r")

    def entries(batches):
        for batch in batches:
            known = batch["known"].to_pylist() if bitmap is None else None
            out, entered = [], set()

            def has(keys, i):
                if bitmap is None:
                    return np.isin(keys, np.array(known[i], dtype=np.int64).view(np.uint64))
                a, b = _slots(keys, bits)
                bit = lambda x: (bitmap.value[x >> np.uint64(6)] >> (x & np.uint64(63)) & np.uint64(1)).astype(bool)
                return bit(a) & bit(b)

            for i, (r, text) in enumerate(zip(batch["r"].to_pylist(), byte_texts(batch["text"]))):
                words = plain_words(text)
                if len(words) < span:
                    continue
                runs = Runs(words, span)
                shared = has(runs.m, i)
                if not shared.any():
                    continue
                lone, differ = has(runs.g, i) & shared, has(runs.m ^ _MIXED, i) & shared
                at = np.flatnonzero(shared)
                out.append((runs.g[at], np.zeros(len(at), np.int32), np.full(len(at), r, np.int64), runs.first[at].astype(np.int32), (runs.end - runs.first)[at].astype(np.int32)))
                partner = differ & ~lone
                if partner.any():
                    for j in np.flatnonzero(partner).tolist():
                        partner[j] = runs.g[j] not in entered
                    entered.update(runs.g[partner].tolist())
                size = runs.end - runs.first
                each = np.flatnonzero(np.repeat(lone | partner, size))
                if len(each):
                    h, c = runs.windows(each)
                    out.append((h, c, np.full(len(each), r, np.int64), each.astype(np.int32), np.repeat(lone, size)[each].astype(np.int32)))
            if out:
                h, *rest = map(np.concatenate, zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(signed(h)), *map(pa.array, rest)], names=["h", "c", "r", "s", "n"])

    return keyed.mapInArrow(entries, "h long, c int, r long, s int, n int")


def factors(docs: DataFrame, span: int = SPAN, most_bytes: int = MOST_BYTES) -> DataFrame:
    """For each document that has any (row key r): an array of (start, windows, shift to the source) for every entry that recurs."""
    wanted = saved(wanted_keys(saved(counted_runs(docs, span), "runs")), "wanted")
    index = saved(index_entries(docs, wanted, span, most_bytes), "index")
    # A place is one number: the upper 33 bits of the row key and 31 bits of the word position.
    place = F.col("r").bitwiseAND(F.lit(-(1 << 31))).bitwiseOR(F.col("s").cast("long"))
    # Written before the join: then both of its sides are shuffled by it, and a hash that very many places have can be split between tasks.
    recurring = saved(index.groupBy("h", "c").agg(F.count("*").alias("k"), F.min(place).alias("low"), F.max(place).alias("high")).filter("k > 1").drop("k"), "recurring")
    source = F.when(F.col("low") == place, F.col("high")).otherwise(F.col("low"))
    parsed = index.filter("n > 0").join(recurring, ["h", "c"]).select("r", F.struct("s", "n", (source - F.col("s")).alias("shift")).alias("f"))
    return parsed.groupBy("r").agg(F.array_sort(F.collect_set("f")).alias("factors"))


def factor_spans(starts: np.ndarray, sizes: np.ndarray, shifts: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Greedy parse: first word and end of each factor, a run of entries that go on from each other with one source."""
    breaks = np.flatnonzero((starts[1:] != starts[:-1] + sizes[:-1]) | (shifts[1:] != shifts[:-1])) + 1
    bounds = np.concatenate([[0], breaks, [len(starts)]])
    last = bounds[1:] - 1
    return starts[bounds[:-1]], starts[last] + sizes[last] + span - 1


def without_repeats(docs: DataFrame, span: int = SPAN, most_bytes: int = MOST_BYTES) -> DataFrame:
    """doc_id, n_words, n_removed, n_factors, kept_text: each word covered by a window of `span` words that also starts elsewhere is gone."""
    found = factors(docs, span, most_bytes)

    def cut(batches):
        for batch in batches:
            rows = []
            for doc_id, text, own in zip(batch["doc_id"].to_pylist(), byte_texts(batch["text"]), batch["factors"]):
                words = plain_words(text)
                covered, n = np.zeros(len(words) + 1, dtype=np.int32), 0
                if own.is_valid:
                    flat = own.values
                    first, end = factor_spans(*(flat.field(x).to_numpy(zero_copy_only=False) for x in ("s", "n", "shift")), span)
                    np.add.at(covered, first, 1)
                    np.add.at(covered, end, -1)
                    n = len(first)
                gone = np.cumsum(covered)[:-1] > 0
                kept = b" ".join(w for w, out in zip(words, gone.tolist()) if not out) if n else b" ".join(words)
                rows.append((doc_id, len(words), int(gone.sum()), n, kept.decode(), hashlib.sha256(kept).hexdigest()))
            ids, *rest = zip(*rows) if rows else ((),) * 6
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.large_string(), pa.large_string())
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch["doc_id"].type), *(pa.array(v, k) for v, k in zip(rest, kinds))], names=["doc_id", "n_words", "n_removed", "n_factors", "kept_text", "kept_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    joined = docs.select("doc_id", "text", row_key().alias("r")).join(found, "r", "left").select("doc_id", "text", "factors")
    return joined.mapInArrow(cut, f"doc_id {kind}, n_words long, n_removed long, n_factors long, kept_text string, kept_sha256 string")
