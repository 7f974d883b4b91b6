"""Ngram join against brute force and by hand."""

from collections import defaultdict

import numpy as np
import pytest

from panelwright.llm import components, ngram_join
from corpus_cases import WORDS, frame, jaccard_classes, jaccard_of_pairs


@pytest.mark.parametrize("block", [256, 2])
def test_ngram_join_equals_brute_force(spark, rows, block):
    links, root = jaccard_classes(rows)
    members = defaultdict(list)
    for (i, _), r in zip(rows, root):
        members[r].append(i)
    expected = [(i, min((x for x in members[r] if x is not None), default=None), n) for (i, _), r, n in zip(rows, root, links)]
    got = ngram_join.near_duplicate_classes(frame(spark, rows), block=block).collect()
    assert sorted(map(repr, expected)) == sorted(repr((r.doc_id, r.class_id, r.n_links)) for r in got)


def test_prefixes_are_shortened_until_the_recall_is_reached():
    assert ngram_join.shortest_depth() == 5 and ngram_join.met(0.8, 5) >= 0.9995 > ngram_join.met(0.8, 6)
    assert ngram_join.next_depth({}, 10) == 9  # at 10 a pair at 0.8 would meet with 0.896 only
    assert ngram_join.next_depth({19: 10}, 10) == 9 and ngram_join.next_depth({19: 10}, 9) is None
    assert ngram_join.next_depth({19: 1000, 0: 1}, 10) == 5 and ngram_join.next_depth({0: 1}, 5) is None
    assert ngram_join.next_depth({5: 3}, 9) == 7


def test_recall_near_the_threshold(spark):
    rng = np.random.default_rng(8)
    rows = []
    for k in range(400):
        words = [f"{k}x{i}" for i in range(200)]
        rows.append((10 * k, " ".join(words)))
        near = list(words)  # each change touches five shingles of 196
        for at in rng.choice(np.arange(3, 38), 4, replace=False) * 5:
            near[at] = f"new{at}"
        rows.append((10 * k + 1, " ".join(near)))
    links = jaccard_of_pairs(rows)
    got = {r.doc_id: r.n_links for r in ngram_join.near_duplicate_classes(frame(spark, rows)).collect()}
    wanted = [i for i, s in links.items() if 0.8 <= s < 0.85]
    assert len(wanted) > 300 and sum(got[i] for i in wanted) >= 0.99 * len(wanted)
    assert all(got[i] == 0 for i, s in links.items() if s < 0.8)


def test_keep_one_of_each(spark, rows):
    got = [r.doc_id for r in ngram_join.keep_one_of_each(frame(spark, rows)).collect()]
    assert sorted(x for x in got if x is not None and x >= 20) == [20, 30, 31, 40, 50, 51, 52, 53, 60, 61] and got.count(None) == 1


def test_near_duplicates_of_planted_copies_are_found(spark):
    rng = np.random.default_rng(3)
    rows = []
    for k in range(60):
        words = list(rng.choice(WORDS, 150))
        rows.append((10 * k, " ".join(words)))
        for j in range(3):
            near = list(words)
            near[int(rng.integers(0, 150))] = "changed"
            rows.append((10 * k + 1 + j, " ".join(near)))
    got = {r.doc_id: r.class_id for r in ngram_join.near_duplicate_classes(frame(spark, rows)).collect()}
    assert all(got[i] == i // 10 * 10 for i, _ in rows)


def test_connected_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (9, 9), (5, 4), (4, 6), (6, 7), (7, 8), (None, 3)], "u long, v long")
    got = {r.node: r.component for r in components.connected_components(edges).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 9: 9, 4: 4, 5: 4, 6: 4, 7: 4, 8: 4}
