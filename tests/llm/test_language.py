from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerweave.llm import language


@pytest.fixture(scope="module")
def model(small_docs):
    return language.learn(small_docs, F.crc32(F.col("doc_id").cast("string")) % 4 != 2)


def test_held_out_accuracy(spark, small_dir, model):
    docs = spark.read.parquet(small_dir.replace("0.001", "0.01") + "/documents.parquet")
    rows = language.predicted(docs, model, "doc_id", "lang").collect()
    assert len(rows) == docs.count()
    assert np.mean([r["lang"] == r["lang_pred"] for r in rows]) > 0.98
    assert np.mean([r["rejected"] for r in rows]) < 0.02
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_several_centroids_and_equal_predictions(small_docs, model):
    assert set(model.languages) == {r["lang"] for r in small_docs.select("lang").distinct().collect()}
    assert all((model.owner == i).sum() > 1 for i in range(len(model.languages)))
    assert np.allclose(np.linalg.norm(model.centroids, axis=1), 1, atol=1e-4)
    again = language.learn(small_docs.repartition(3), F.crc32(F.col("doc_id").cast("string")) % 4 != 2)
    assert np.array_equal(model.centroids, again.centroids) and np.array_equal(model.limits, again.limits)


def test_unlike_texts_are_rejected(spark, model):
    strange = "чужой язык совсем другие буквы " * 40
    plain = "The of and " * 40
    docs = spark.createDataFrame([(1, strange), (2, plain)], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in language.predicted(docs, model, "doc_id").collect()}
    assert rows[1]["rejected"] and rows[1]["lang_pred"] in model.languages


def test_edge_cases(edge_docs, edge_rows, model):
    rows = language.predicted(edge_docs, model, "doc_id", "source").collect()
    assert len(rows) == len(edge_rows)
    by_id = {r["doc_id"]: r for r in rows}
    for doc_id in (1, 2, 3, 12):
        assert (by_id[doc_id]["lang_pred"], by_id[doc_id]["score"], by_id[doc_id]["rejected"]) == ("und", 0.0, True)
    assert by_id[4]["lang_pred"] == by_id[5]["lang_pred"] and by_id[4]["score"] == by_id[5]["score"]
    left = language.without_rejected(edge_docs, model)
    assert left.columns == edge_docs.columns
    assert {r["doc_id"] for r in left.collect()}.isdisjoint({1, 2, 3, 12})


@pytest.mark.parametrize("doc_id", ["null", "7"])
def test_sample_without_useful_ids(small_docs, doc_id):
    docs = small_docs.withColumn("doc_id", F.expr(f"cast({doc_id} as long)"))
    copies = docs.unionAll(docs.limit(1).withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(3000)))).drop("n"))
    seen = []
    whole = language.fitted
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(language, "fitted", lambda lang, *rest: seen.append(lang) or whole(lang, *rest))
        learned = language.learn(copies, sample_per_language=20)
    assert set(learned.languages) == {r["lang"] for r in small_docs.select("lang").distinct().collect()}
    assert all(5 <= seen[0].count(x) <= 45 for x in learned.languages)


def test_the_driver_gets_no_counts_of_the_sample(small_docs, monkeypatch):
    sent = []
    whole = language.fitted
    monkeypatch.setattr(language, "fitted", lambda *a: sent.append(a) or whole(*a))
    learned = language.learn(small_docs)
    texts = len(sent[0][0])
    arrays = [x for a in sent[0] for x in (a.values() if isinstance(a, dict) else [a]) if isinstance(x, np.ndarray)]
    counts = texts * language.PLACES * 4
    assert texts > 100 and len(learned.centroids) and sum(x.nbytes for x in arrays) < counts / 4


def test_nothing_to_learn_from(spark, no_docs, edge_docs):
    empty = language.learn(no_docs)
    assert language.predicted(no_docs, empty, "doc_id").collect() == []
    assert {r["lang_pred"] for r in language.predicted(edge_docs, empty, "doc_id").collect()} == {"und"}


def test_counts_do_not_depend_on_strips(monkeypatch):
    text = "Änderung über alles, naïve 😀 façade; " * 200
    whole, letters = language.ngram_counts(text)
    monkeypatch.setattr(language, "_STRIP", 100)
    again, same = language.ngram_counts(text)
    assert np.array_equal(whole, again) and letters == same == sum(c.isalpha() for c in text.lower())


def test_short_foreign_and_random_texts_are_rejected(spark, small_dir):
    docs = spark.read.parquet(small_dir.replace("0.001", "0.01") + "/documents.parquet")
    learned = language.learn(docs)
    polish = (
        "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni "
        "rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa. "
    )
    finnish = (
        "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu "
        "järki ja omatunto, ja heidän on toimittava toisiaan kohtaan veljeyden hengessä. "
    )
    rng = np.random.default_rng(3)
    letters = "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz    "), 330))
    texts = [polish, finnish, letters, polish * 2, finnish * 4, letters * 3]
    assert learned.predict(texts)[2].all()
    kept = ~language.predicted(docs, learned, "doc_id").toPandas()["rejected"].to_numpy()
    assert kept.mean() > 0.98
