"""Toxicity against brute force and by hand."""

import zlib

import numpy as np

from panelwright.llm import quality, toxicity
from panelwright.llm.common import prepare
from corpus_cases import WORDS, prose


def test_toxicity_held_out_and_disguised(spark):
    prepare(spark)
    rng = np.random.default_rng(1)
    bad = ["scoundrel", "numpty", "blockhead"]
    rows, labels = [], []
    for i in range(900):
        words = list(rng.choice(WORDS, 60))
        toxic = int(i % 3 == 0)
        if toxic:
            words[int(rng.integers(60))] = bad[int(rng.integers(3))]
        rows.append((i, " ".join(words)))
        labels.append((i, 1, toxic))
    disguised = ["you num-pty", "a scounxdrel", "b l o c k h e a d here", "n.u.m.p.t.y", None, "", "wak wbl"]
    rows += [(5000 + k, t) for k, t in enumerate(disguised)]
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels + [(None, 1, 1), (7000, 1, None)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity_scores(docs, known).collect()}
    held = [(i, y) for i, _, y in labels if got[i].held_out]
    assert sum(got[i].predicted == y for i, y in held) >= 0.98 * len(held)
    assert [got[5000 + k].predicted for k in range(7)] == [1, 1, 1, 1, 0, 0, 0]
    assert toxicity.toxicity_scores(docs, known.limit(0)).filter("predicted = 1").count() == 0


def test_labelled_sample_keeps_unlike_texts(spark):
    prepare(spark)
    rows = [(i, f"{prose(3000 + i, 12)}. {prose(4000 + i, 12)}.\n\n{prose(5000 + i, 12)}.") for i in range(60)]
    rows += [(100 + i, text + "\n") for i, text in rows[:20]]  # copies but for a blank line
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    known = spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, toxic int")
    trained_on = {i for i, _ in rows if zlib.crc32(str(i).encode()) % 3 != 1}
    got = sorted(r.doc_id for r in toxicity.labelled_sample(docs, known).collect())
    assert got == sorted(i for i in trained_on if i < 100 or i - 100 not in trained_on)


def test_windows_of_several_words_are_scored_as_by_hand():
    joined, _, a, b, owner, size = toxicity.windows(["ab cd-e. fg", "b l o c k\nhi"])
    got = {(joined[i:j], k, m) for i, j, k, m in zip(a, b, owner, size)}
    assert got == {("cde", 0, 1), ("abcde", 0, 2), ("block", 1, 1), ("blo", 1, 3), ("loc", 1, 3), ("ock", 1, 3)}
    machine = toxicity.trained(["scoundrel", "pieceofjunk"], ["wakwbl", "lantern", "under"], [])
    for text in ("he wakes a scoun drel there", "a b c lantern. piece of junk", "nothing", "scoundrelscoundrelscoundrelscoundrel"):
        joined, _, a, b, _, _ = toxicity.windows([text])
        parts = [joined[i:j][k : k + 24] for i, j in zip(a, b) for k in range(0, max(1, j - i - 12), 12)]
        assert np.isclose(machine.worst([text])[0], machine.margins(parts).max())


def test_toxicity_of_several_words(spark):
    prepare(spark)
    rng = np.random.default_rng(4)
    rows, labels = [], []
    for i in range(900):
        words = list(rng.choice(WORDS + ["piece", "rotten", "cake"], 60))
        if i % 3 == 0:
            words[7:9] = ["rotten", "cake"] if i % 2 else ["numskull", "here"]
        rows.append((i, " ".join(words)))
        labels.append((i, int(i % 3 == 0)))
    rows = [(i, t if i % 3 == 0 else t.replace("rotten cake", "rotten wak")) for i, t in rows]
    rows += [(5000, "wak rotten cake wbl"), (5001, "wak num skull wbl"), (5002, "wak cake wbl rotten")]
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {r.doc_id: r.predicted for r in toxicity.toxicity_scores(docs, known).collect()}
    assert [got[5000 + k] for k in range(3)] == [1, 1, 0]
