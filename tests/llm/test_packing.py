"""Packing against brute force and by hand."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from panelwright.llm import packing
from corpus_cases import frame


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 49), min_size=1, max_size=120))
def test_best_fit_is_the_tightest(lengths):
    plan, rank, bins, offsets = packing.best_fit_decreasing(Counter(lengths), 50).tolist(), Counter(), [], []
    for n in lengths:
        _, low, first, each, offset = max(row for row in plan if row[0] == n and row[1] <= rank[n])
        bins.append(first + (rank[n] - low) // each)
        offsets.append(offset + (rank[n] - low) % each * n)
        rank[n] += 1
    left, expected = [], 0
    for size in sorted(lengths, reverse=True):
        fit = min((x for x in left if x >= size), default=None)
        if fit is None:
            expected += 1
            left.append(50 - size)
        else:
            left[left.index(fit)] -= size
    assert len(set(bins)) == expected
    for b in set(bins):
        own = sorted((offsets[i], lengths[i]) for i in range(len(lengths)) if bins[i] == b)
        assert all(o == sum(n for _, n in own[:k]) for k, (o, _) in enumerate(own)) and sum(n for _, n in own) <= 50


def test_packing_keeps_every_token(spark, rows):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    plain_tokenizer = Tokenizer.from_file(path)
    more = rows + [(70, "It's DON'T <|endoftext|> ΣΑΣ é ́x\t\x0b!!a.b,, «ñ» İı ŉ K"), (71, "a b " * 9000)]
    got = packing.packed(frame(spark, more).repartition(5), path).collect()
    expected = Counter()
    for i, t in more:
        ids = np.array(plain_tokenizer.encode(t or "", add_special_tokens=False).ids + [1], dtype="<u4")
        for k in range(0, len(ids), 4096):
            expected[(i, k // 4096, k, len(ids[k : k + 4096]), zlib.crc32(ids[k : k + 4096].tobytes()))] += 1
    assert expected == Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got)
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for own in bins.values():
        own.sort()
        assert all(o == sum(n for _, n in own[:k]) for k, (o, _) in enumerate(own)) and sum(n for _, n in own) <= 4096
    left, whole = [], 0
    for size in sorted((x[3] for x in expected.elements()), reverse=True):
        fit = min((x for x in left if x >= size), default=None)
        if fit is None:
            left.append(4096 - size)
            whole += 1
        else:
            left[left.index(fit)] -= size
    assert len(bins) == whole
