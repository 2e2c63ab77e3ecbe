"""Held-out accuracy, what the score depends on, and odd inputs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from factorloom.llm import quality
from factorloom.llm.common import table

DOCS, LABELS = "doc_id long, text string", "doc_id long, quality int, toxic int"


def auc(score, y):
    order = np.argsort(score, kind="stable")
    ranks = np.empty(len(score))
    ranks[order] = np.arange(1, len(score) + 1)
    pos = y == 1
    return (ranks[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())


@pytest.fixture(scope="module")
def scored(spark):
    docs, labels = (table(spark, "/root/testdata/sf0.01", x) for x in ("documents", "labels"))
    model = quality.train(docs, labels)
    return docs, labels, model, quality.score(docs, model)


def test_held_out_accuracy(scored):
    docs, labels, _, out = scored
    got = out.where("held_out").join(labels.select("doc_id", "quality"), "doc_id").toPandas()
    assert len(got) > 50
    assert auc(got["score"].to_numpy(), got["quality"].to_numpy()) > 0.9
    kept = got[got.quality == 1]
    assert (kept.predicted == 1).mean() > 0.85


def test_every_document_gets_one_score(scored):
    docs, _, _, out = scored
    rows = out.toPandas()
    assert len(rows) == docs.count() and rows.score.between(0, 1).all()
    assert (rows.predicted == (rows.score >= 0.3)).all()


def test_held_out_labels_are_never_learned(scored):
    docs, labels, model, _ = scored
    turned = labels.withColumn("quality", F.when(quality.is_held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    again = quality.train(docs, turned)
    assert again.base == model.base and all((a == b).all() for a, b in zip(again.tables, model.tables))


def test_scores_depend_on_the_text_alone(spark, scored):
    docs, _, model, out = scored
    moved = docs.where("doc_id < 50").select((F.col("doc_id") + 1_000_000).alias("doc_id"), "text", F.lit("xx").alias("lang"), F.lit("zz").alias("source"))
    a = {r["doc_id"]: r["score"] for r in out.where("doc_id < 50").collect()}
    b = {r["doc_id"] - 1_000_000: r["score"] for r in quality.score(moved, model).collect()}
    assert a == b


def test_tables_add_up():
    rng = np.random.RandomState(0)
    x = np.zeros((800, len(quality.FEATURES)))
    x[:, 0], x[:, 1] = rng.rand(800), rng.rand(800)
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.fit(x, y)
    # Neither feature tells anything alone; the pair's table does.
    assert (0, 1) in model.pairs
    assert auc(model.score(x), y) > 0.95
    assert len(model.cuts) == x.shape[1]


def plain_score(model, x):
    """One row's score by going through the tables one entry at a time."""
    total = model.base
    for k, cuts in enumerate(model.cuts):
        total += model.tables[k][sum(1 for c in cuts if c <= x[k])]
    for (i, j), table_ in zip(model.pairs, model.pair_tables):
        total += table_[sum(1 for c in model.pair_cuts[i] if c <= x[i]), sum(1 for c in model.pair_cuts[j] if c <= x[j])]
    return 1 / (1 + np.exp(-total))


def test_scores_by_brute_force(scored):
    docs, _, model, out = scored
    texts = {r["doc_id"]: r["text"] for r in docs.where("doc_id < 200").collect()}
    for r in out.where("doc_id < 200").collect():
        assert abs(r["score"] - plain_score(model, quality.features(texts[r["doc_id"]]))) < 1e-12


def test_the_bound_holds_with_repeated_ids_and_the_model_is_the_same_again(spark, scored):
    docs, labels, _, _ = scored
    often = docs.unionByName(docs.where("doc_id % 3 = 1")).unionByName(docs.where("doc_id = 1").crossJoin(spark.range(500)).drop("id"))
    a, b = (quality.train(x, labels, max_rows=300) for x in (often, often.repartition(13)))
    assert a.base == b.base and all((p == q).all() for p, q in zip(a.tables, b.tables))


def test_a_very_long_text(spark, scored):
    rows = [(1, "word and other " * 400_000), (2, "x" * 5_000_000)]
    got = quality.score(spark.createDataFrame(rows, DOCS), scored[2]).collect()
    assert len(got) == 2 and all(0 <= r["score"] <= 1 for r in got)


def test_odd_inputs(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None), (3, ""), (None, "c"), (1, "a b")], DOCS)
    for labels in ([], [(1, 1, 0), (2, None, 0), (None, 1, 0)]):
        model = quality.train(docs, spark.createDataFrame(labels, LABELS))
        rows = quality.score(docs, model).collect()
        assert len(rows) == 5 and all(0 <= r["score"] <= 1 for r in rows)
    assert quality.score(spark.createDataFrame([], DOCS), model).count() == 0
    odd = spark.createDataFrame([(1, "a", 3.0, True)], DOCS + ", score double, held_out boolean")
    assert quality.score(odd, model).columns == ["doc_id", "held_out", "score", "predicted"]
