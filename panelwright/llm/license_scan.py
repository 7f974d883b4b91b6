"""License scans: short notices found with a bounded number of errors, and where they stand.

The method is a fuzzy search by pigeonhole. A notice that may have k errors is split into k + 1 pieces; wherever it stands with
at most k errors, one piece stands exactly. So exact finds of the pieces locate candidates, and the regex library's bounded-error
matching verifies the notice around each and reports its span and errors. Exact phrases (the base) are found by themselves and always stay.

Texts are seen as their words (A-Z lower-cased, `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`) joined by single spaces, so punctuation, case and line breaks do
not matter. Null and empty texts have no words, no place and no label. Repeated rows are scanned alike. An empty table gives an empty result. Only doc_id
and text are read.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from functools import lru_cache
from heapq import heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.llm.common import byte_texts, folded_words

#: Exact phrases and their labels (fixed values).
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Notices that are found with errors, and their labels.
NOTICES = {
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "licensed under the apache license version 2 0": "apache-2",
    "licensed under cc by nc 4 0": "cc-by-nc",
    "creative commons attribution noncommercial": "cc-by-nc",
    "licensed under the gnu general public license version 3": "gpl-3",
    "mozilla public license version 2 0": "mpl-2",
    "redistribution and use in source and binary forms with or without modification": "bsd",
    "all rights reserved": "all-rights-reserved",
}
#: One error is allowed for so many characters of a notice.
CHARS_PER_ERROR = 10


def pieces(notice: str, errors: int) -> list[tuple[int, str]]:
    """(offset, piece): errors + 1 pieces of nearly equal length."""
    cuts = [len(notice) * i // (errors + 1) for i in range(errors + 2)]
    return [(a, notice[a:b]) for a, b in zip(cuts, cuts[1:])]


@lru_cache(maxsize=None)
def _plan(notice: str, per_error: int):
    errors = len(notice) // per_error
    grams = [notice[i : i + 3] for i in range(len(notice) - 2)]
    return errors, pieces(notice, errors), grams, regex.compile(rf"(?b)(?:{regex.escape(notice)}){{e<={errors}}}")


def _areas(words: str, seeds: list[tuple[int, str]], length: int, errors: int) -> list[tuple[int, int]]:
    """Where a notice may stand: around each place that an exact piece points at; places that differ by no more than `errors` share an area, so an area holds one notice."""
    starts = set()
    for offset, piece in seeds:
        at = words.find(piece)
        while at >= 0:
            starts.add(at - offset)
            at = words.find(piece, at + 1)
    out: list[tuple[int, int]] = []
    first = last = None
    for start in [*sorted(starts), None]:
        if first is not None and (start is None or start > first + errors):
            out.append((max(0, first - errors), min(len(words), last + length + errors)))
            first = None
        first, last = start if first is None else first, start
    return out


def fuzzy_spans(words: str, notices: dict[str, str] = NOTICES, per_error: int = CHARS_PER_ERROR) -> list[tuple[str, int, int, int, int]]:
    """(label, start, end, errors, notice length) of each notice in a text of words joined by spaces; spans in characters.

    Each area is verified by itself. Spans of one notice don't overlap: those with fewer errors, then earlier ones, come first, and an area that such a span covers in part is searched
    again in what is left of it. An area is a little longer than its notice, so the time is in proportion to the places that pieces point at.
    """
    out = []
    for notice, label in notices.items():
        errors, seeds, grams, pattern = _plan(notice, per_error)
        # An error takes away three runs of three characters at most; where more are missing, no match is possible and none is tried.
        shared = len(grams) - 3 * errors
        least, own, waiting, starts, ends = len(notice) - errors, [], [], [], []

        def look(low: int, high: int) -> None:
            if high - low < least:  # noqa: B023
                return
            area = words[low:high]
            found = pattern.search(words, low, high) if sum(g in area for g in grams) >= shared else None  # noqa: B023
            if found:
                heappush(waiting, (sum(found.fuzzy_counts), found.start(), found.end(), low, high))  # noqa: B023

        for low, high in _areas(words, seeds, len(notice), errors):
            look(low, high)
        while waiting:
            k, start, end, low, high = heappop(waiting)
            # Taken spans in order; those that meet this area.
            a, b = bisect_right(ends, low), bisect_left(starts, high)
            if bisect_right(ends, start) == bisect_left(starts, end):
                i = bisect_left(starts, start)
                starts.insert(i, start)
                ends.insert(i, end)
                own.append((label, start, end, k, len(notice)))
            else:
                for left, right in zip([low, *ends[a:b]], [*starts[a:b], high]):
                    look(left, right)
        out += sorted(own, key=lambda span: span[1])
    return out


def exact_places(words: str, phrases: dict[str, str] = PHRASES) -> list[tuple[str, int]]:
    """(label, start in words) of every place where a phrase's words stand one after the other. Spaces are counted on from the place before."""
    out, padded = [], f" {words} "
    for phrase, label in phrases.items():
        whole = f" {phrase} "
        at, before, number = padded.find(whole), 0, 0
        while at >= 0:
            number += words.count(" ", before, at)
            before = at
            out.append((label, number))
            at = padded.find(whole, at + 1)
    return out


def scanned(docs: DataFrame, notices: dict[str, str] = NOTICES, phrases: dict[str, str] = PHRASES, per_error: int = CHARS_PER_ERROR) -> DataFrame:
    """doc_id, n_words, base: (label, word) of exact phrases, spans: (label, start, end, errors, share, found) of notices in the joined words."""

    def scan(batches):
        for batch in batches:
            n_words, base, spans = [], [], []
            for text in byte_texts(batch["text"]):
                words = folded_words(text)
                joined = b" ".join(words).decode()
                n_words.append(len(words))
                base.append([{"label": a, "word": w} for a, w in exact_places(joined, phrases)])
                spans.append([{"label": a, "start": s, "end": e, "errors": k, "share": 1 - k / n, "found": joined[s:e]} for a, s, e, k, n in fuzzy_spans(joined, notices, per_error)])
            kinds = pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64())])), pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("errors", pa.int32()), ("share", pa.float64()), ("found", pa.string())]))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(n_words, pa.int64()), pa.array(base, kinds[0]), pa.array(spans, kinds[1])], names=["doc_id", "n_words", "base", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_words long, base array<struct<label:string,word:long>>, spans array<struct<label:string,start:long,end:long,errors:int,share:double,found:string>>"
    return docs.select("doc_id", "text").mapInArrow(scan, schema)


def license_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score: 1 for an exact phrase, else the best notice's share of right characters.

    Also n_spans, and spans: `label:start:end:errors` of each notice found, in characters of the joined words, by start, separated by spaces.
    """
    found = scanned(docs)
    joined = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    best = F.coalesce(F.array_max("spans.share"), F.lit(0.0))
    return found.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min("base.word").alias("first_word"),
        F.array_max("base.word").alias("last_word"),
        joined(F.col("base.label")).alias("base_labels"),
        joined(F.concat("base.label", "spans.label")).alias("labels"),
        F.when(F.size("base") > 0, 1.0).otherwise(best).alias("score"),
        F.size("spans").cast("long").alias("n_spans"),
        F.array_join(F.transform(F.array_sort(F.transform("spans", lambda x: F.struct(x["start"], x["end"], x["label"], x["errors"]))), lambda x: F.concat_ws(":", x["label"], x["start"], x["end"], x["errors"])), " ").alias("spans"),
    )
