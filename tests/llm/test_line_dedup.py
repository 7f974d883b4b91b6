"""Line dedup against brute force and by hand."""

import time

from panelwright.llm import line_dedup
from corpus_cases import frame, within_one


def test_line_dedup_equals_brute_force(spark):
    base = "the quick brown fox jumps over the lazy dog"
    texts = [base, base.replace("q", "k"), base + "s", "x" + base, base.replace("fox", "foxx") + "\nkept line of its own", base[:20] + "\n" + base[:21], "short\nshort\nshore", None, "", " \n" + base + "  ", "é" * 30 + "\n" + "é" * 31, "a\nb\n\nzz\nzy\nxyz\nqrs\nqrst\nlonger line 7\nlonger line 8\n" * 2 + "\n".join(f"{k * 7919 % 10007:05d}" * 3 for k in range(300)), "unrelated text that is long enough here"]
    rows = [(None, texts[0])] + list(enumerate(texts)) + [(3, texts[3])]
    order, near = [], set()
    for i, t in sorted(set(rows), key=lambda x: (x[0] is not None, x[0] or 0)):
        order += [(line.strip(" "), (i, t, k)) for k, line in enumerate((t or "").split("\n")) if line.strip(" ")]
    first = {}
    for line, pos in order:
        first.setdefault(line, pos)
    seen = list(first)
    for k, line in enumerate(seen):
        if any(within_one(other, line) for other in seen[:k]):
            near.add(line)
    expected = []
    for i, t in rows:
        if t is None:
            expected.append((i, None, None))
            continue
        kept = [x for k, x in enumerate(t.split("\n")) if not x.strip(" ") or (first[x.strip(" ")] == (i, t, k) and x.strip(" ") not in near)]
        expected.append((i, "\n".join(kept), sum(1 for x in t.split("\n") if x.strip(" ")) - sum(1 for x in kept if x.strip(" "))))
    docs = frame(spark, rows)
    got = line_dedup.deduplicated(docs)
    assert sorted(map(repr, expected)) == sorted(repr((r.doc_id, r.text, r.n_removed)) for r in got.collect())
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString() and "Arrow" not in got._jdf.queryExecution().executedPlan().toString()


def test_line_dedup_of_a_document_of_many_lines(spark):
    text = "\n".join(f"{k % 30_000:07d} {k % 30_000 * 7919:012d} line" for k in range(60_000))
    began = time.time()
    one = line_dedup.deduplicated(frame(spark, [(1, text), (2, None)])).filter("doc_id = 1").first()
    assert one.n_lines == 60_000 and one.n_removed >= 30_000 and time.time() - began < 90
