"""Decontaminate against brute force and by hand."""

import hashlib
from collections import defaultdict

from panelwright.llm import decontaminate
from panelwright.llm.common import folded_words
from corpus_cases import frame, prose


def test_decontamination_equals_brute_force(spark, rows):
    items = [(1, " ".join(prose(100, 60).split()[5:30])), (2, "W-AK, one TWO"), (3, "one two"), (4, None), (4, ""), (5, prose(5, 90)), (12, "one two"), (None, "one two")]
    windows = defaultdict(set)
    for i, t in items:
        w = folded_words(t.encode() if t else None)
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[k : k + n])].add(i)
    expected = []
    for i, t in rows:
        w = folded_words(t.encode() if t else None)
        hit, found = set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                own = windows.get(tuple(w[k : k + n]))
                if own:
                    hit |= set(range(k, k + n))
                    found |= own
        ids = sorted(str(x) for x in found if x is not None)
        expected.append((i, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = frame(spark, rows)
    got = decontaminate.contamination(docs, bench).collect()
    assert sorted(map(repr, expected)) == sorted(repr((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated)) for r in got)
    kept = decontaminate.without_contaminated(docs, bench)
    assert kept.columns == docs.columns and kept.count() == sum(not e[-1] for e in expected)
    assert decontaminate.contamination(docs, bench.limit(0)).filter("contaminated").count() == 0
