"""Best-fit packing: documents go into as few sequences as possible of at most `capacity` tokens; only longer ones are cut.

The method is best-fit decreasing over all pieces at once. Pieces are placed from the longest to the shortest, each into the open bin whose
remaining capacity is the tightest that fits. A segment tree over remaining capacities holds how many open bins have each; one descent, so
logarithmic time, finds the least capacity that is not too small. Full pieces are sequences of their own and are not packed at all.

At scale: bins with the same remaining capacity are alike, and so are pieces of the same length. So best-fit decreasing needs only the number of pieces of each
length, at most `capacity` numbers, whatever the size of the corpus. The driver packs that histogram, in runs of like bins; a piece then finds its
bin by its length and its rank among the pieces of that length. Ranks come from counts by block (the task that cut the
piece), so no group of like lengths ever meets in one task. Tokens never move, only lengths.

Null and empty texts are one end token. Rows alike in all columns are packed each for itself. An empty table gives an
empty result. Only doc_id (of any type) and text are read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelwright.llm.common import saved

CAPACITY, END = 4096, 1


#: Letters for which lower-casing in Python is the tokenizer's, and that no normal form changes; and signs that are one token run after them.
_PLAIN = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0132-\u024f]+)([.,!?;:*&#$%]*)")


class WordTokens(dict):
    """Token ids, as little-endian bytes, of the pieces of a text between spaces and line ends.

    Bounded: when a generation of `LIMIT` pieces is full it becomes the old one, and what is looked up again moves to the new.

    The tokenizer drops white space and never merges across it, so a text's ids are those of its pieces in order. New plain
    words are encoded together, and their ids parted after each token that ends a word.
    """

    LIMIT = 250_000

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        suffix = self.tokenizer.model.end_of_word_suffix
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for token, i in vocabulary.items() if suffix and token.endswith(suffix)]] = True
        self.cores: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.old_cores: dict[str, bytes] = {}

    def encode(self, words: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def encode_plain(self, words: list[str]) -> list[bytes]:
        """Of words of letters alone, each one unit for the tokenizer."""
        out = []
        for i in range(0, len(words), 500):
            part = words[i : i + 500]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, dtype="<u4")
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) != len(part):
                out += self.encode(part)
                continue
            raw, bounds = ids.tobytes(), [0, *(4 * ends).tolist()]
            out += [raw[a:b] for a, b in zip(bounds, bounds[1:])]
        return out

    def learn(self, wanted: set[str]) -> None:
        new = [piece for piece in wanted if piece not in self]
        if len(self) + len(new) > self.LIMIT:
            self.old = dict(self)
            self.clear()
            new = wanted
        if len(self.cores) > self.LIMIT:
            self.old_cores, self.cores = self.cores, {}
        again = {piece: self.old[piece] for piece in new if piece in self.old}
        self.update(again)
        new = [piece for piece in new if piece not in again]
        plain, odd = [], []
        for piece in new:
            found = _PLAIN.fullmatch(piece)
            if found:
                plain.append((piece, found[1].lower(), found[2]))
            else:
                odd.append(piece)
        for words, encode in (({c for _, c, _ in plain}, self.encode_plain), ({s for *_, s in plain}, self.encode)):
            words = [word for word in words if word not in self.cores]
            again = {word: self.old_cores[word] for word in words if word in self.old_cores}
            self.cores.update(again)
            words = [word for word in words if word not in again]
            self.cores.update(zip(words, encode(words)))
        self.update((piece, self.cores[core] + self.cores[signs]) for piece, core, signs in plain)
        self.update(zip(odd, self.encode(odd)))


_TOKENS: dict[str, WordTokens] = {}


def token_bytes(texts: list[str | None], tokenizer: str, end: int = END) -> list[bytes]:
    """Ids of each text and the end id, each as an unsigned 32-bit little-endian number."""
    if tokenizer not in _TOKENS:
        _TOKENS[tokenizer] = WordTokens(tokenizer)
    tokens, closing = _TOKENS[tokenizer], np.array([end], dtype="<u4").tobytes()
    parts = [(text or "").replace("\n", " ").split(" ") for text in texts]
    tokens.learn(set().union(*parts))
    return [b"".join(map(tokens.__getitem__, part)) + closing for part in parts]


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each piece of each document; block (the task that cut it) and nth (among the pieces of that length there)."""

    def cut(batches):
        block, seen = TaskContext.get().partitionId(), Counter()
        for batch in batches:
            rows = []
            texts = batch["text"].to_pylist()
            coded = (ids for at in range(0, len(texts), 50) for ids in token_bytes(texts[at : at + 50], tokenizer, end))
            for i, ids in enumerate(coded):
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    own = ids[at : at + 4 * capacity]
                    size = len(own) // 4
                    rows.append((i, piece, at // 4, size, zlib.crc32(own), block, seen[size]))
                    seen[size] += 1
            i, *columns = list(zip(*rows)) or [()] * 7
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch["doc_id"].take(pa.array(i, pa.int64())), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=["doc_id", "piece", "start", "length", "ids_crc32", "block", "nth"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(cut, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, block int, nth long")


class OpenBins:
    """Open bins by remaining capacity, in runs of successive numbers, with a segment tree of counts to find the tightest that fits."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.runs: list[list[tuple[int, int]]] = [[] for _ in range(self.leaves)]

    def _change(self, left: int, by: int) -> None:
        node = left + self.leaves
        while node:
            self.count[node] += by
            node >>= 1

    def add(self, left: int, first: int, number: int) -> None:
        if left and number:
            self.runs[left].append((first, number))
            self._change(left, number)

    def take(self, size: int) -> tuple[int, int, int] | None:
        """(capacity, first bin, number) of a run of the tightest open bins with at least so much left; they are open no more."""
        node = size + self.leaves
        while not self.count[node]:
            while node & 1:  # a right child: go up until there is a subtree to the right
                node >>= 1
                if node <= 1:
                    return None
            if node <= 1:
                return None
            node += 1
        while node < self.leaves:
            node = 2 * node if self.count[2 * node] else 2 * node + 1
        left = node - self.leaves
        first, number = self.runs[left].pop()
        self._change(left, -number)
        return left, first, number


def best_fit_decreasing(counts: dict[int, int], capacity: int) -> np.ndarray:
    """Rows (length, rank, bin, each, offset), sorted: from that rank on, pieces of that length go `each` to a bin, from that bin and offset on.

    counts has the number of pieces of each length. A piece put into the tightest bin leaves it tighter still, so a bin takes as many pieces of
    one length as fit before the next bin has its turn: whole runs of like bins are filled at once, just as one by one.
    """
    bins, opened, out = OpenBins(capacity), 0, []
    for size in sorted(counts, reverse=True):
        rank, left = 0, counts[size]
        while left:
            found = bins.take(size)
            if found is None:
                number = -(-left // (capacity // size))
                found, opened = (capacity, opened, number), opened + number
            room, first, number = found
            each = room // size
            filled = min(number, left // each)
            out.append((size, rank, first, each, capacity - room))
            bins.add(room - each * size, first, filled)
            rank, left = rank + filled * each, left - filled * each
            if filled < number and left:  # the last bin takes what is left, fewer than fit
                bins.add(room - left * size, first + filled, 1)
                rank, left, filled = rank + left, 0, filled + 1
            bins.add(room, first + filled, number - filled)
    return np.array(sorted(out), dtype=np.int64).reshape(-1, 5)


def packed(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row for each piece of each document."""
    cut = saved(pieces(docs, tokenizer, capacity, end), "pieces")
    part = cut.filter(F.col("length") < capacity)
    tallies = part.groupBy("length", "block").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    bases = saved(tallies.withColumn("base", F.coalesce(F.sum("n").over(earlier), F.lit(0))), "bases")
    counts = {r["length"]: r["n"] for r in bases.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = docs.sparkSession.sparkContext.broadcast(best_fit_decreasing(counts, capacity))

    def place(batches):
        sizes, ranks, firsts, each, offsets = plan.value.T
        wide = 1 << 48  # ranks stay below
        for batch in batches:
            length, rank = (batch[c].to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            at = np.searchsorted(sizes * wide + ranks, length * wide + rank, side="right") - 1
            own = rank - ranks[at]
            yield pa.RecordBatch.from_arrays(
                [*(batch[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(2 * (firsts[at] + own // each[at])), pa.array(offsets[at] + own % each[at] * length)],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    # Merged, not broadcast: this table has a row for each length of each block, so it grows with the data.
    ranked = part.join(bases.select("length", "block", "base").hint("merge"), ["length", "block"]).withColumn("rank", F.col("base") + F.col("nth"))
    fitted = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(place, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    # Packed sequences have even numbers, full pieces the odd ones.
    full = cut.filter(F.col("length") == capacity).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (2 * F.monotonically_increasing_id() + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    return fitted.unionByName(full)
