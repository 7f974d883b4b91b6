"""Fingerprints against brute force and by hand."""

import hashlib

import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from panelwright.llm import fingerprints
from corpus_cases import frame


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(alphabet="ab\n", max_size=30), min_size=2, max_size=4))
def test_fingerprints_ignore_order_and_follow_edits(parts):
    one = fingerprints.fingerprint("\n".join(parts).encode())
    other = fingerprints.fingerprint("\n".join("\n".join(parts).split("\n")[::-1]).encode())
    assert fingerprints.written(one) == fingerprints.written(other)
    more = fingerprints.inserted(one, b"new paragraph")
    assert fingerprints.written(more) == fingerprints.written(fingerprints.fingerprint(("\n".join(parts) + "\nnew paragraph").encode()))
    assert fingerprints.written(fingerprints.deleted(more, b"new paragraph")) == fingerprints.written(one)


@pytest.mark.parametrize("bucket, fewest", [(4096, 4096), (3, 5)])
def test_fingerprint_table(spark, rows, bucket, fewest):
    rows = rows + [(30, "tied")] * 3 + [(55, "the same text many times")] * 40
    got = fingerprints.fingerprinted(frame(spark, rows), bucket, fewest).collect()
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    order = sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, signed(xxhash.xxh64_intdigest((x[1] or "").encode(), seed=42))), reverse=True)
    expected = []
    for k, (i, t) in enumerate(order):
        new = fingerprints.edited(t or "", order[(k + 1) % len(order)][1] or "")
        expected.append((i, len(t or ""), hashlib.sha256(new.encode()).hexdigest(), fingerprints.written(fingerprints.fingerprint((t or "").encode())), fingerprints.written(fingerprints.fingerprint(new.encode()))))
    assert sorted(map(repr, expected)) == sorted(repr((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint)) for r in got)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
