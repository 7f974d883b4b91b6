"""What the tests of the text operators share: made-up prose, and plain versions of what operators compute."""

import re

import numpy as np
import xxhash

from panelwright.llm.common import folded_words, prepare


WORDS = [f"w{a}{b}" for a in "abcdefghij" for b in "klmnopqrst"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, bucket int, r long, h long"


def prose(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join(rng.choice(WORDS, n))


def frame(spark, rows):
    prepare(spark)
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 0.5, 1, 2, 3) for i, t in rows], SCHEMA)


def plain(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def jaccard_classes(rows, threshold=0.8):
    sets = []
    for i, t in rows:
        w = folded_words(t.encode() if t else None)
        n = min(5, len(w))
        sets.append({tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if w else set())
    links, root = [0] * len(rows), list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(len(rows)):
            if a != b and sets[a] and sets[b] and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]):
                links[a] += 1
                old, new = max(root[a], root[b]), min(root[a], root[b])
                root = [new if r == old else r for r in root]
    return links, root


def jaccard_of_pairs(rows):
    """Similarity of each odd document with the one before it."""
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, t in rows for w in [folded_words(t.encode())]}
    return {i: len(sets[i] & sets[i - 1]) / len(sets[i] | sets[i - 1]) for i in sets if i % 10 == 1}


def within_one(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) <= 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def labelled_texts():
    rng = np.random.default_rng(0)
    kinds = {"xx": "thandere", "yy": "ñóíacol", "zz": "äöüßgh"}
    return [(i, " ".join("".join(rng.choice(list(a), 6)) for _ in range(40)), lang) for i in range(300) for lang, a in [list(kinds.items())[i % 3]]]


def signed_hash(doc_id, text):
    """xxhash64 of the row key and the seed 0, as the noise takes it."""
    key = 42
    if doc_id is not None:
        key = xxhash.xxh64_intdigest(doc_id.to_bytes(8, "little", signed=True), seed=key)
    if text is not None:
        key = xxhash.xxh64_intdigest(text.encode(), seed=key)
    out = xxhash.xxh64_intdigest((0).to_bytes(4, "little"), seed=xxhash.xxh64_intdigest(key.to_bytes(8, "little"), seed=42))
    return out - (1 << 64) if out >> 63 else out
