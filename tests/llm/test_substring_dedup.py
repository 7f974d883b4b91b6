"""Substring dedup against brute force and by hand."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from panelwright.llm import substring_dedup
from corpus_cases import frame, plain


def test_substring_dedup_equals_brute_force(spark, rows):
    counts = Counter(tuple(w[p : p + 35]) for _, t in rows for w in [plain(t)] for p in range(len(w) - 34))
    expected = []
    for i, t in rows:
        w = plain(t)
        gone = [False] * len(w)
        for p in range(len(w) - 34):
            if counts[tuple(w[p : p + 35])] > 1:
                gone[p : p + 35] = [True] * 35
        expected.append((i, len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone) if not g).encode()).hexdigest()))
    docs = frame(spark, rows)
    for most in (substring_dedup.MOST_BYTES, 0):  # by the bit filter, and by the shuffle
        got = substring_dedup.without_repeats(docs, most_bytes=most).collect()
        assert sorted(map(repr, expected)) == sorted(repr((r.doc_id, r.n_words, r.n_removed, r.kept_sha256)) for r in got)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from("abc"), min_size=12, max_size=60), st.integers(9, 12))
def test_runs_cover_all_windows(letters, span):
    words = [x.encode() for x in letters]
    runs = substring_dedup.Runs(words, span)
    assert (runs.end - runs.first).sum() == len(words) - span + 1
    h, _ = runs.windows(np.arange(len(words) - span + 1))
    same = defaultdict(set)
    for p in range(len(words) - span + 1):
        same[tuple(words[p : p + span])].add(int(h[p]))
    assert all(len(v) == 1 for v in same.values()) and len(set().union(*same.values())) == len(same)
