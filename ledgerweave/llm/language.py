"""Language identification by nearest centroid.

A text becomes a TF-IDF vector of its letter n-grams (one to three letters, word edges
included), hashed into a fixed number of places and scaled to length one. Every language
is described by several centroids, found by spherical k-means over labelled texts. A text
gets the language of the centroid with the largest cosine. It is rejected when its
distance (1 - cosine) from that centroid is beyond what training texts of the language
show, given the text's length.

The centroids are fitted on a bounded sample of labelled texts: at most about
``sample_per_language`` texts of each language, chosen by a hash of doc_id, whole texts
each, one language in a task. Predictions read the whole text and nothing but the text.

Defined cases: a null text, or one without a letter, is ``und`` with score 0 and is
rejected; a null label is not learned from; equal texts get equal predictions; ties go to
the first language in code point order; without any labelled text everything is ``und``.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import astuple, dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerweave.sources.durable import delete, durable

UNKNOWN = "und"
PLACES = 1 << 13
# Code points that are turned into n-grams at a time.
_STRIP = 1 << 18


_TABLES: dict[str, np.ndarray] = {}


def _letters() -> np.ndarray:
    """Which code points are letters; made once in each process."""
    if "letters" not in _TABLES:
        _TABLES["letters"] = np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), dtype=bool)
    return _TABLES["letters"]


def _codes(text: str) -> np.ndarray:
    """Code points of the lower-cased letters, each run of others as one 0, with a 0 at
    both ends."""
    raw = np.frombuffer(text.lower().encode("utf-32-le", "replace"), dtype=np.uint32)
    codes = np.where(_letters()[raw], raw, 0).astype(np.uint32)
    codes = np.concatenate(([np.uint32(0)], codes, [np.uint32(0)]))
    keep = np.ones(len(codes), dtype=bool)
    keep[1:] = (codes[1:] != 0) | (codes[:-1] != 0)
    return codes[keep]


def ngram_counts(text: str | None) -> tuple[np.ndarray, int]:
    """Counts of the hashed n-grams, and the number of letters."""
    counts = np.zeros(PLACES, dtype=np.float32)
    codes = _codes(text or "")
    letters = int(np.count_nonzero(codes))
    if not letters:
        return counts, 0
    for at in range(0, len(codes), _STRIP):
        part = codes[at : at + _STRIP + 2]
        h = part.astype(np.uint32)
        end = min(_STRIP, len(part))
        for n in (1, 2, 3):
            if n > 1:
                h = h[: len(part) - n + 1] * np.uint32(0x01000193) + part[n - 1 :]
            mixed = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D + 2 * n)
            counts += np.bincount((mixed >> np.uint32(32 - 13))[:end], minlength=PLACES)
    return counts, letters


@dataclass(frozen=True)
class Model:
    """Weights of the places, unit centroids, and the language of each centroid with the
    distance at which it rejects short, middling and long texts."""

    languages: tuple[str, ...]
    idf: np.ndarray
    centroids: np.ndarray
    owner: np.ndarray
    limits: np.ndarray

    def vectors(self, counts: np.ndarray) -> np.ndarray:
        return _unit(np.log1p(counts) * self.idf)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, cosine and whether the text is rejected."""
        counted = [ngram_counts(t) for t in texts]
        letters = np.array([n for _, n in counted], dtype=np.int64)
        if not len(self.languages) or not len(texts):
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), dtype=bool)
        cosines = self.vectors(np.stack([c for c, _ in counted])) @ self.centroids.T
        best = cosines.argmax(axis=1)
        score = np.clip(cosines[np.arange(len(texts)), best].astype(np.float64), 0, 1)
        none = letters == 0
        far = 1 - score > self.limits[self.owner[best], _length_class(letters)]
        languages = [UNKNOWN if e else self.languages[self.owner[b]] for b, e in zip(best, none)]
        score[none] = 0
        return languages, score, far | none


def _unit(rows: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(rows, axis=1, keepdims=True)
    return (rows / np.where(norms > 0, norms, 1)).astype(np.float32)


_CLASSES = 4
# Limits of length classes that have too few texts to show one, shortest texts first: a few
# words share little with any centroid. A cosine below one in twenty is no more than stray
# n-grams.
_LENIENT = np.array([0.95, 0.9, 0.8, 0.7])
# Texts that show a limit, and the quantile of their distances that it follows.
_ENOUGH, _QUANTILE = 20, 0.995
_FOLDS = 5


def _length_class(letters: np.ndarray) -> np.ndarray:
    return np.digitize(letters, [64, 512, 4096])


def _clustered(rows: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Spherical k-means: unit centroids of at most ``k`` clusters."""
    rng = np.random.default_rng(seed)
    chosen = [int(rng.integers(len(rows)))]
    while len(chosen) < min(k, len(rows)):
        near = (rows @ rows[chosen].T).max(axis=1)
        chosen.append(int(near.argmin()))
    centroids = rows[chosen]
    for _ in range(20):
        nearest = (rows @ centroids.T).argmax(axis=1)
        sums = np.stack(
            [rows[nearest == i].sum(axis=0) if (nearest == i).any() else centroids[i] for i in range(len(centroids))]
        )
        fresh = _unit(sums)
        if np.allclose(fresh, centroids, atol=1e-5):
            break
        centroids = fresh
    return centroids


def _unseen_distances(rows: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Distance of each text from the centroids of the other folds' texts. (A text is too
    near to centroids that it takes part in.)"""
    fold = np.arange(len(rows)) % min(_FOLDS, len(rows))
    out = np.full(len(rows), np.nan)
    for f in range(fold.max() + 1 if len(rows) > 1 else 0):
        found = _clustered(rows[fold != f], k, seed)
        out[fold == f] = 1 - (rows[fold == f] @ found.T).max(axis=1)
    return out


def _limits(distance: np.ndarray, classes: np.ndarray, languages: np.ndarray, n: int, slack: float) -> np.ndarray:
    """By language and length class, ``slack`` times a high quantile of the distances. Where
    a language has too few texts in a class, those of all languages are taken, and the fixed
    limit where they are too few as well."""
    out = np.tile(_LENIENT, (n, 1))
    measured = ~np.isnan(distance)
    for c in range(_CLASSES):
        here = measured & (classes == c)
        for i in range(n):
            for texts in (here & (languages == i), here):
                if texts.sum() >= _ENOUGH:
                    out[i, c] = min(slack * np.quantile(distance[texts], _QUANTILE), 0.95)
                    break
    return out


def _described(counts: np.ndarray, idf: np.ndarray, k: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Centroids of one language's texts, and the distance of each text from centroids that it
    takes no part in. The vectors take the place of the counts."""
    rows = np.log1p(counts, out=counts)
    rows *= idf
    norms = np.linalg.norm(rows, axis=1, keepdims=True)
    rows /= np.where(norms > 0, norms, 1)
    return _clustered(rows, k, seed), _unseen_distances(rows, k, seed)


def fitted(
    labels: list[str],
    letters: np.ndarray,
    distance: np.ndarray,
    idf: np.ndarray,
    centroids: dict[str, np.ndarray],
    slack: float,
) -> Model:
    """The model of described languages (see ``_described``). ``labels``, ``letters`` and
    ``distance`` are those of the sample's texts. A language rejects beyond ``slack`` times a
    high quantile of the distances of its texts of the same length class (see ``_limits``)."""
    languages = tuple(sorted(centroids))
    number = np.searchsorted(np.array(languages, dtype=object), np.array(labels, dtype=object))
    return Model(
        languages,
        idf,
        np.concatenate([centroids[x] for x in languages]) if languages else np.empty((0, PLACES), dtype=np.float32),
        np.repeat(np.arange(len(languages)), [len(centroids[x]) for x in languages]),
        _limits(distance, _length_class(letters), number, len(languages), slack),
    )


def learn(
    docs: DataFrame,
    eligible: Column | None = None,
    sample_per_language: int = 400,
    centroids_per_language: int = 4,
    slack: float = 1.15,
) -> Model:
    """Fits the model on labelled rows of ``docs`` (those for which ``eligible`` holds).

    The sample is drawn by doc_id and text, and rows that agree in both are drawn once, so
    neither missing nor repeated ids change its size. Its n-gram counts, at most about
    ``sample_per_language`` rows of 8,192 for each language, are stored, and the texts of a
    language are clustered in one task. The driver receives the centroids, how many texts
    have each place, and two numbers a text.
    """
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    if eligible is not None:
        labelled = labelled.where(eligible)
    labelled = labelled.withColumn("__lw_draw", F.xxhash64("doc_id", "text"))
    counted = labelled.groupBy("lang").agg(F.approx_count_distinct("__lw_draw", 0.02).alias("n"))
    sizes = {r["lang"]: max(r["n"], 1) for r in counted.collect()}
    share = F.lit(0.0)
    for language, n in sizes.items():
        share = F.when(F.col("lang") == language, min(1.0, sample_per_language / n)).otherwise(share)
    drawn = F.pmod(F.xxhash64("__lw_draw", F.lit(4)), F.lit(1 << 20)) / float(1 << 20) < share
    once = Window.partitionBy("lang", "__lw_draw").orderBy("__lw_draw")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for language, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                counts, letters = ngram_counts(text)
                if letters:
                    yield pa.RecordBatch.from_pydict(
                        {"lang": [language], "letters": [letters], "counts": [counts.astype("<f4").tobytes()]}
                    )

    def occupied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(PLACES, dtype=np.int64)
        for batch in batches:
            for packed in batch.column(0):
                seen += np.frombuffer(packed.as_buffer(), dtype="<f4") > 0
        places = np.flatnonzero(seen)
        yield pa.RecordBatch.from_pydict({"place": places.astype(np.int32), "n": seen[places]})

    sample = durable(
        labelled.where(drawn)
        .select("lang", "text", "__lw_draw")
        .withColumn("row", F.row_number().over(once))
        .where("row = 1")
        .select("lang", "text")
        .mapInArrow(count, "lang string, letters long, counts binary"),
        "language-sample",
    )
    drawn_texts = {r["lang"]: r["count"] for r in sample.groupBy("lang").count().collect()}
    languages = sorted(drawn_texts)
    places = sample.select("counts").mapInArrow(occupied, "place int, n long").groupBy("place").agg(F.sum("n").alias("n")).toArrow()
    seen = np.zeros(PLACES)
    seen[places["place"].to_numpy()] = places["n"].to_numpy()
    idf = (np.log((1 + sum(drawn_texts.values())) / (1 + seen)) + 1).astype(np.float32)

    def describe(texts: pa.Table) -> pa.Table:
        texts = texts.take(pc.sort_indices(texts, [("counts", "ascending")]))
        language = texts["lang"][0].as_py()
        counts = np.empty((texts.num_rows, PLACES), dtype=np.float32)
        for row, packed in zip(counts, texts["counts"]):
            row[:] = np.frombuffer(packed.as_buffer(), dtype="<f4")
        found, distance = _described(counts, idf, centroids_per_language, languages.index(language))
        return pa.table(
            {
                "lang": [language],
                "letters": [texts["letters"].to_pylist()],
                "distance": [distance],
                "centroids": [found.astype("<f4").tobytes()],
            }
        )

    described = (
        sample.groupBy("lang")
        .applyInArrow(describe, "lang string, letters array<long>, distance array<double>, centroids binary")
        .collect()
    )
    delete(sample)
    return fitted(
        [r["lang"] for r in described for _ in r["letters"]],
        np.array([n for r in described for n in r["letters"]], dtype=np.int64),
        np.array([d for r in described for d in r["distance"]], dtype=np.float64),
        idf,
        {r["lang"]: np.frombuffer(r["centroids"], dtype="<f4").reshape(-1, PLACES) for r in described},
        slack,
    )


# Texts whose counts are held at a time: 256 rows of 8,192 floats are 8 MB.
_ROWS = 256


def _judged(batch: pa.RecordBatch, texts: pa.Array, model: Model) -> tuple[list, np.ndarray, np.ndarray]:
    languages, scores, rejected = [], [np.empty(0)], [np.empty(0, dtype=bool)]
    for at in range(0, batch.num_rows, _ROWS):
        lang, score, far = model.predict(texts.slice(at, _ROWS).to_pylist())
        languages += lang
        scores.append(score)
        rejected.append(far)
    return languages, np.concatenate(scores), np.concatenate(rejected)


def predicted(docs: DataFrame, model: Model, *keep: str) -> DataFrame:
    """The columns ``keep`` of every row, with lang_pred, score and rejected."""
    shared = docs.sparkSession.sparkContext.broadcast(astuple(model))
    source = docs.select(*keep, F.col("text").alias("text"))
    fields = [f"`{n}` {t}" for n, t in source.dtypes[: len(keep)]]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            languages, scores, rejected = _judged(batch, batch.column(batch.num_columns - 1), Model(*shared.value))
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:-1],
                    pa.array(languages, pa.string()),
                    pa.array(scores, pa.float64()),
                    pa.array(rejected, pa.bool_()),
                ],
                names=[*keep, "lang_pred", "score", "rejected"],
            )

    return source.mapInArrow(
        judge, ", ".join([*fields, "lang_pred string", "score double", "rejected boolean"])
    )


def without_rejected(docs: DataFrame, model: Model) -> DataFrame:
    """The rows, all columns unchanged, whose text the model does not reject."""
    shared = docs.sparkSession.sparkContext.broadcast(astuple(model))
    place = docs.columns.index("text")

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rejected = _judged(batch, batch.column(place), Model(*shared.value))[2]
            yield batch.filter(pa.array(~rejected))

    return docs.mapInArrow(sift, docs.schema)
