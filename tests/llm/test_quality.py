"""Quality against brute force and by hand."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelwright.llm import quality, registry
from panelwright.llm.common import prepare
from corpus_cases import prose, signed_hash


@pytest.mark.parametrize("share", [0.1, 0.3, 0.75])
def test_importance_resampling_takes_exactly_k_of_tied_rows(spark, share):
    prepare(spark)
    rows = [(None, None)] * 50 + [(1, "a text")] * 20 + [(i, prose(i, 9)) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("r", "noisy", "place", "log_weight", "selected")})
    labels = spark.createDataFrame([(1, 1, 0), (None, 1, 0), (2, None, 0)], "doc_id long, quality int, toxic int")
    got = quality.resampled(docs, labels, share=share).collect()
    assert len(got) == 100 and sum(r.selected for r in got) == int(np.ceil(share * 100))
    assert min(r.noisy for r in got if r.selected) >= max(r.noisy for r in got if not r.selected)
    assert quality.resampled(docs.limit(0), labels).count() == 0 and quality.resampled(docs, labels.limit(0)).filter("log_ratio <> 0").count() == 0


def test_importance_resampling(spark):
    prepare(spark)
    rng = np.random.default_rng(2)
    rows = [(i, prose(i, 80) if i % 4 else "".join(rng.choice(list("!#%&$"), 300))) for i in range(400)] + [(None, None), (900, "")]
    labels = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(0, 400, 2)], "doc_id long, quality int, toxic int")
    got = quality.resampled(spark.createDataFrame(rows, "doc_id long, text string"), labels, share=0.7).collect()
    chosen = [r for r in got if r.selected]
    assert len(got) == len(rows) and len(chosen) == int(np.ceil(0.7 * len(rows)))
    raw, target = np.ones(1 << 16), np.ones(1 << 16)
    for i, t in rows:
        np.add.at(raw, quality.gram_counts((t or "").encode()), 1)
        if i is not None and i % 2 == 0 and i < 400 and i % 4:
            np.add.at(target, quality.gram_counts(t.encode()), 1)
    ratio = np.log(target / target.sum()) - np.log(raw / raw.sum())
    for i, t in rows:
        own = ratio[quality.gram_counts((t or "").encode())]
        one = next(r for r in got if r.doc_id == i)
        assert np.isclose(one.log_ratio, own.sum()) and np.isclose(one.log_weight, own.sum() if len(own) <= 100 else sum(own[k * len(own) // 100] for k in range(100)))
        u = (signed_hash(i, t) % (1 << 52) + 0.5) / (1 << 52)
        assert np.isclose(one.noisy, one.log_weight - np.log(-np.log(u)))
    assert {r.doc_id for r in chosen} == {r.doc_id for r in sorted(got, key=lambda r: -r.noisy)[: len(chosen)]}
    assert all(r.doc_id is None or r.doc_id % 4 or r.doc_id >= 400 for r in chosen)
    values = spark.range(50_000).select((F.pmod(F.xxhash64("id"), F.lit(999)) / 3.0).alias("noisy"))
    want = sorted((r.noisy for r in values.collect()), reverse=True)
    for k in (1, 777, 25_000, 50_000):
        assert quality.kth_largest(values, k, few=500) == want[k - 1]


def test_the_whole_text_decides(spark, tmp_path):
    prepare(spark)
    rng = np.random.default_rng(3)
    ratio = rng.normal(size=1 << 16)
    # Two texts that differ between the places of a sketch only.
    text = prose(5, 400)
    n = len(text.encode()) - 3
    places = set(np.arange(100) * n // 100)
    at = next(i for i in range(50, n - 50) if not places & set(range(i - 3, i + 1)))
    other = text[:at] + "#" + text[at + 1 :]
    docs = spark.createDataFrame([(1, text), (2, other), (3, "short text"), (4, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in quality.weighted(docs, ratio, whole=True).collect()}
    sums = {i: ratio[quality.gram_counts(t.encode())].sum() for i, t in ((1, text), (2, other), (3, "short text"))}
    assert np.isclose(got[1].log_weight, 100 * sums[1] / n) and np.isclose(got[2].log_weight, 100 * sums[2] / n) and got[1].log_weight != got[2].log_weight
    assert np.isclose(got[3].log_weight, sums[3]) and got[4].log_weight == 0
    # So too in the registered query.
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (3, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = {r.doc_id: r for r in registry.queries()["op3_quality_classifier"](spark, str(tmp_path)).collect()}
    assert np.isclose(rows[1].log_weight, 100 * rows[1].log_ratio / n) and np.isclose(rows[2].log_weight, 100 * rows[2].log_ratio / n)
