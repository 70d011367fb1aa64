"""Quality and toxicity: parts against brute force, held-out accuracy, odd inputs; the pipeline against plain Python."""

import itertools
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import quality, queries, toxicity
from tessera.llm.labelled import held_out, training_sample
from tests.llm.test_searches import brute_texts

SF = "/root/testdata/sf0.01"


def area(score, label):
    """Area under the curve: chance that a row of label 1 scores above one of label 0."""
    a, b = score[label == 1], score[label == 0]
    return ((a[:, None] > b[None]).mean() + (a[:, None] >= b[None]).mean()) / 2


def judged(spark, name, column, sf=SF):
    out = queries.QUERIES[name](spark, sf).toPandas()
    docs = spark.read.parquet(f"{sf}/documents.parquet").count()
    assert len(out) == docs and out["score"].between(0, 1).all()
    assert (out["held_out"] == out["doc_id"].map(lambda i: zlib.crc32(str(i).encode()) % 3 == 1)).all()
    both = out[out["held_out"]].merge(spark.read.parquet(f"{sf}/labels.parquet").toPandas(), on="doc_id")
    return out, both["score"].to_numpy(), both["predicted"].to_numpy(), both[column].to_numpy()


def test_quality_of_held_out_documents(spark):
    out, score, predicted, label = judged(spark, "op2_quality_fourier_ridge", "quality")
    assert area(score, label) > 0.97 and (predicted == label).mean() > 0.95
    assert ((out["score"] >= 0.5) == (out["predicted"] == 1)).all()


def test_toxicity_of_held_out_documents(spark):
    out, score, predicted, label = judged(spark, "op4_toxicity_crf", "toxic", "/root/testdata/sf0.1")
    assert area(score, label) > 0.93 and label[predicted == 1].mean() > 0.95 and predicted[label == 1].mean() > 0.85
    assert ((out["score"] >= 0.7) == (out["predicted"] == 1)).all()


def test_sample_is_bounded_and_leaves_the_held_out_fold(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = training_sample(docs, labels, "quality", 100).collect()
    assert 60 < len(rows) < 140 and all(zlib.crc32(str(r.doc_id).encode()) % 3 != 1 for r in rows)


def test_marginals_are_those_of_all_taggings():
    rng = np.random.default_rng(3)
    unary, between = rng.normal(size=(5, 6)), rng.normal(size=(2, 2))
    live = np.arange(6) < np.array([6, 4, 1, 5, 2])[:, None]
    p, pairs, logz = toxicity.marginals(np.where(live, unary, 0), live, between)
    total = np.zeros((2, 2))
    for r in range(5):
        n, weight, on, links = live[r].sum(), 0.0, np.zeros(6), np.zeros((2, 2))
        for tags in itertools.product((0, 1), repeat=int(n)):
            s = np.exp(sum(unary[r, k] for k, t in enumerate(tags) if t) + sum(between[a, b] for a, b in zip(tags, tags[1:])))
            weight += s
            on[: len(tags)] += s * np.array(tags)
            for a, b in zip(tags, tags[1:]):
                links[a, b] += s
        total += links / weight
        assert np.allclose(p[r], on / weight) and np.isclose(logz[r], np.log(weight))
    assert np.allclose(pairs, total)


def test_gradient_is_that_of_the_likelihood():
    import pandas as pd

    rng = np.random.default_rng(1)
    codes = [rng.integers(0, 7, n) for n in (3, 70, 0, 10)]
    frame = pd.DataFrame({"codes": codes, "tags": [rng.integers(0, 2, len(c)) for c in codes]})
    w = rng.normal(size=11)
    value = lambda w: toxicity._objective(iter([frame]), w[:7], w[7:].reshape(2, 2))
    got = value(w)[1:]
    for k in range(11):
        e = np.eye(11)[k] * 1e-5
        assert np.isclose((value(w + e)[0] - value(w - e)[0]) / 2e-5, got[k], atol=1e-4)


def test_fourier_features_approximate_the_kernel():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 25))
    z = quality.Model(mean=np.zeros(25), scale=np.ones(25)).map(x)[:, :-1]
    near = ((x[:, None] - x[None]) ** 2).sum(2)
    kernel = np.exp(-near / (2 * quality.WIDTH**2 * 25 / 8))
    assert np.abs(z @ z.T - kernel).mean() < 0.07


def test_calibration_does_not_fall(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.train(docs, labels)
    assert (np.diff(model.steps[0]) >= 0).all() and (np.diff(model.steps[1]) >= 0).all()


def test_odd_documents_and_labels(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(i, i % 2, int(i == 13), "x") for i in range(14)] + [(None, 1, 1, "x"), (3, None, None, "x"), (3, 1, 0, "x")], "doc_id bigint, quality int, toxic int, text string")
    none = labels.limit(0)
    for docs, lab in ((odd_docs, labels), (odd_docs, none), (no_docs, labels), (odd_docs, labels.withColumn("quality", F.lit(1)).withColumn("toxic", F.lit(0)))):
        q, t = quality.train(docs, lab), toxicity.train(docs, lab)
        out = docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("h"), quality.quality_score(q, F.col("text")).alias("q"), toxicity.tagged(t, F.col("text")).alias("t")).collect()
        assert len(out) == docs.count() and all(0 <= r.q <= 1 and 0 <= r.t.score <= 1 and r.h is not None for r in out)
        by = {}
        for r in out:
            by.setdefault(r.text or "", set()).add((r.q, r.t.score))
        assert all(len(v) == 1 for v in by.values())


def test_spans_are_offsets_of_offending_words(spark):
    docs = spark.createDataFrame([(i, f"é🙂 plain words here {'you IDIOT, idiot scum' if i % 3 == 0 else 'you friend'} and on {i}") for i in range(300)], "doc_id bigint, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 3 == 0).cast("int").alias("toxic"))
    model = toxicity.train(docs, labels)
    for r in docs.select("doc_id", "text", toxicity.tagged(model, F.col("text")).alias("t")).collect():
        assert (r.t.score >= 0.7) == (r.doc_id % 3 == 0)
        found = " ".join(r.text[s.start : s.end] for s in r.t.spans)
        assert ("IDIOT, idiot scum" in found) if r.doc_id % 3 == 0 else not found


def test_pipeline_stages(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    tables = {"": docs}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf).write.parquet(str(tmp_path / name))
        tables[name] = docs = spark.read.parquet(str(tmp_path / name))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "mixing", "encoding"]
    assert all(tables[n].columns == tables[""].columns for n in list(tables)[1:-1])
    rows = {n: [(r.doc_id, r.text, r.source) for r in t.collect()] for n, t in list(tables.items())[:-1]}
    label = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    gone = {i for i, _, _ in rows[""]} - {i for i, _, _ in rows["toxicity"]}
    assert all(label.get(i, 1) for i in gone)
    last = {}
    for i, t, _ in rows["toxicity"]:
        last[t] = max(i, last.get(t, i))
    assert sorted(last.values()) == sorted(i for i, _, _ in rows["exact_dedup"])
    texts = sorted(rows["exact_dedup"])
    root = brute_texts([t for _, t, _ in texts])[1]
    assert [texts[k][0] for k, g in enumerate(root) if k == g] == sorted(i for i, _, _ in rows["near_dedup"])
    taken, sizes = Counter(), Counter()
    for (_, text, source), table in [(r, taken) for r in rows["mixing"]] + [(r, sizes) for r in rows["near_dedup"]]:
        table[source] += len(re.findall(r"[^\x20\x09-\x0D]+", text))
    assert sum(taken.values()) == pytest.approx(1.5 * sum(sizes.values()), rel=0.1) and max(Counter(i for i, _, _ in rows["mixing"]).values()) <= 2
    encoded = tables["encoding"].collect()
    assert Counter(r.doc_id for r in encoded) == Counter(i for i, _, _ in rows["mixing"])
    assert corpus_pipeline.run(spark, sf).count() == len(encoded)


def test_pipeline_takes_odd_and_empty_documents(spark, odd_docs, no_docs, tmp_path):
    for k, docs in enumerate((odd_docs, no_docs)):
        for name, stage in corpus_pipeline.STAGES:
            stage(spark, docs, "/root/testdata/sf0.001").write.parquet(str(tmp_path / f"{name}{k}"))
            docs = spark.read.parquet(str(tmp_path / f"{name}{k}"))
            if name == "near_dedup" and not k:
                texts = [r.text or "" for r in docs.collect()]
                kept = [t for t in texts if brute_texts([t])[0][0]]
                assert len(kept) == len(set(kept)) and texts.count("") == 1
        assert (docs.count() > 0) == (k == 0)
