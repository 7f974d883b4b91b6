"""The prefix trie against brute force, and by hand."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest

from panelwright.llm import conversation_trie
from panelwright.llm.common import prepare

SCHEMA = "conv_id long, turn long, role string, text string, path int, ids string, n long"


def frame(spark, rows):
    prepare(spark)
    return spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA)


def brute(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    full = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        full[c] = own.get(c - c % 100, [])[:h] + ts[h:]
    nodes = defaultdict(list)
    for c, ts in full.items():
        for d in range(len(ts) + 1):
            nodes[tuple(ts[:d])].append(c)
    children = defaultdict(int)
    for path in nodes:
        if path:
            children[path[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for path, members in nodes.items():
        for d in range(len(path) + 1):
            leaves[path[:d]] += path not in children
            saved[path[:d]] += (len(members) - 1) * len(path[-1][1]) if path else 0
    out = []
    for path, members in nodes.items():
        ends = ",".join(str(c) for c in sorted(members) if len(full[c]) == len(path))
        up = min(nodes[path[:-1]]) if path else None
        out.append((min(members), len(path), up, len(members), children[path], leaves[path], saved[path], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def got(spark, rows, **how):
    out = conversation_trie.prefix_trie(frame(spark, rows), **how)
    return sorted((tuple(r) for r in out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()), key=repr)


def rows_of(seed, convs, turns, texts):
    rng = np.random.default_rng(seed)
    out = []
    for c in range(convs):
        for k in range(int(rng.integers(1, turns))):
            out.append((c, k, "user" if k % 2 == 0 else "assistant", "täxt" * int(rng.integers(1, 4)) + str(rng.integers(texts))))
    return out


@pytest.mark.parametrize("texts", [1, 2, 30])
def test_equals_brute_force_over_several_shards(spark, texts):
    rows = rows_of(texts, 400, 9, texts)
    assert got(spark, rows) == brute(rows)


def test_a_hot_conversation_and_a_hot_opening_in_many_shards(spark):
    same = [(k, "user", f"turn {k}") for k in range(12)]
    rows = [(c, *t) for c in range(0, 90) for t in same] + [(c, *t) for c in range(200, 260) for t in same[: c % 12]] + [(c, *t) for c in range(300, 340) for t in [*same[:7], (7, "user", f"own {c}"), (8, "user", "end")]]
    assert got(spark, rows, shard_turns=60, key_depth=3, piece=7, cells=1) == brute(rows)


def test_nulls_ties_repeats_and_turnless(spark):
    rows = [(0, None, None, "a"), (0, 1, "user", None), (0, 1, "user", "b"), (0, 2, "", "c"), (0, 2, "", "c"), (None, 1, "user", "x"), (-5, 1, None, None), (-100, 3, "user", "z"), (7, None, None, None), (7, None, None, None)]
    rows += [(c, 0, "user", "one") for c in range(101, 140)]  # most take a longer head from nobody, so are turnless
    result = got(spark, rows)
    # % keeps the sign, as in SQL: -5 - (-5 % 100) is 0. Ties are in order of their ids, so only rows without them are compared with the plain order.
    assert sum(r[3] for r in result if r[1] == 0) == 43
    plain = [(c, 0, "user", "one") for c in range(101, 140)] + [(40, 1, "", "c"), (40, 1, "", "c"), (40, None, None, None)]
    assert got(spark, plain) == brute(plain)


def test_empty_table_and_a_long_conversation(spark):
    assert got(spark, []) == []
    rows = [(1, k, "user", str(k)) for k in range(3000)] + [(2, k, "user", str(k)) for k in range(20)]
    result = got(spark, rows)
    assert len(result) >= 3000 - 5 and max(r[1] for r in result) == 3000 - zlib.crc32(b"1") % 6
