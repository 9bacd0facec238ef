"""Language identification by the nearest of several centroids per language.

A text is a vector of hashed letter n-grams of its lower-cased words: the root of the relative frequency by
inverse document frequency, with length one. Document frequencies are counted over all
documents that may be learned from. Each language has several centroids, made by k-means
with cosines over at most ``SAMPLE`` of its documents, chosen by a digest of their ids. A text gets
the language of the centroid with the greatest cosine; it is rejected if that cosine is
smaller than nearly all have that are learned from, are of that language and are about as long:
a text's cosine rises with its length, in a language that was never learned too.

Features are numbers of one to four UTF-8 bytes hashed to ``SIZE`` places: vectors have a
fixed size, and so have the model and what tasks return.

Nulls: a text that is null or has no letter is ``und`` with score 0 and rejected. Documents
with a null language or text are not learned from. If there is nothing to learn from, every
text is ``und``. A null ``doc_id`` counts as held out. Repeated rows each get a row and count as often in what is learned. Other columns are kept by `identified`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.rows import carried, released
from quern.runtime import bounded_batches

SIZE = 1 << 12
GRAMS = (1, 2, 3, 4)
#: Documents of each language that centroids are made from, at most about, and of all languages.
SAMPLE = 600
SAMPLE_ALL = 6000
CENTROIDS = 4
#: A text is rejected if its cosine is under this share of the lowest percentile of those of its language and length.
MARGIN = 0.9
#: Classes of length are powers of two of the number of n-grams; as many neighbours are taken in as it takes for so many documents.
CLASSES, LIKE_LENGTH = 48, 200
#: For each class of length below all that are learned from, the limit is this share of the next one's.
SHORTER = 0.8
HELD_OUT = 1
FOLDS = 3
UNDETERMINED = "und"
_PRIMES = (0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F)
#: ASCII that isn't a letter parts words.
_LETTERS = bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


def has_letter(text: str | None) -> bool:
    """Whether a text has a letter of any script."""
    return bool(text) and any(map(str.isalpha, text))


def features(texts: list[str | None]) -> np.ndarray:
    """Counts of hashed n-grams, a row for each text."""
    out = np.zeros((len(texts), SIZE), np.float32)
    for i, text in enumerate(texts):
        if not text:
            continue
        raw = b" " + b" ".join(text.lower().encode("utf-8", "surrogatepass").translate(_LETTERS).split()) + b" "
        for at in range(0, len(raw), 1 << 20):  # pieces overlap by the longest n-gram, so each n-gram counts once
            b = np.frombuffer(raw, np.uint8, min(len(raw) - at, (1 << 20) + 3), at).astype(np.uint32)
            code = np.zeros(len(b), np.uint32)
            for n in GRAMS:
                code = (code[: len(b) - n + 1] << np.uint32(8)) | b[n - 1 :]
                last = code[: 1 << 20]
                place = (last * np.uint32(_PRIMES[n - 1])) >> np.uint32(20)
                out[i] += np.bincount(place.astype(np.int64), minlength=SIZE)
    return out


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Vectors of length one."""
    v = np.sqrt(counts) * idf
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)


def length_class(counts: np.ndarray) -> np.ndarray:
    """The class of length of each row of counts."""
    return np.minimum(np.log2(np.maximum(counts.sum(axis=1, dtype=np.float64), 1)), CLASSES - 1).astype(np.int64)


def limits(cosines: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """The least cosine in each class of length, from those that are learned from."""
    out, low, high = np.empty(CLASSES), classes.min(), classes.max()
    for c in range(CLASSES):
        away = np.abs(classes - min(max(c, low), high))
        reach = np.sort(away)[min(LIKE_LENGTH, len(away)) - 1]
        out[c] = MARGIN * np.quantile(cosines[away <= reach], 0.01, method="lower") * SHORTER ** max(0, low - c)
    return out


@dataclass
class Model:
    """What a prediction needs, of fixed size for a number of languages."""

    languages: list[str]
    idf: np.ndarray
    centroids: np.ndarray
    owner: np.ndarray
    least: np.ndarray

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float], list[bool]]:
        """Language, score and rejection of each text."""
        names, scores, rejected = [], [], []
        for at in range(0, len(texts), 256):
            part = texts[at : at + 256]
            counts = features(part)
            cos = weighted(counts, self.idf) @ self.centroids.T if self.languages else np.zeros((len(part), 0))
            for text, row, size in zip(part, cos, length_class(counts)):
                if not len(row) or not has_letter(text):
                    names.append(UNDETERMINED), scores.append(0.0), rejected.append(True)
                else:
                    k = int(row.argmax())
                    names.append(self.languages[self.owner[k]])
                    scores.append(float(min(1.0, max(0.0, row[k]))))
                    rejected.append(bool(row[k] < self.least[self.owner[k], size]))
        return names, scores, rejected


def _centroids(v: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means from fixed starts that lie apart."""
    chosen = [int((v @ v.mean(axis=0)).argmax())]
    while len(chosen) < min(k, len(v)):
        chosen.append(int((v @ v[chosen].T).max(axis=1).argmin()))
    c = v[chosen]
    for _ in range(rounds):
        near = (v @ c.T).argmax(axis=1)
        c = np.stack([v[near == j].mean(axis=0) if (near == j).any() else c[j] for j in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Learn from documents with a language. Document frequencies are of all of them; centroids of a bounded sample."""
    bounded_batches(docs.sparkSession)
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(SIZE, np.int64), 0
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for at in range(0, len(texts), 256):
                df += (features(texts[at : at + 256]) > 0).sum(axis=0)
            n += len(texts)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, SIZE, dtype=np.int32)), pa.array(np.concatenate([[n], df]))], names=["place", "n"])

    counted = rows.select("text").mapInArrow(frequencies, "place int, n long").groupBy("place").agg(F.sum("n").alias("n"))
    df, n = np.zeros(SIZE), 0
    for place, count in counted.collect():  # SIZE rows and one at most
        if place < 0:
            n = count
        else:
            df[place] = count
    idf = np.log((1 + n) / (1 + df)) + 1

    by_lang = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(SAMPLE_ALL).collect()}
    quota = min(SAMPLE, SAMPLE_ALL // max(1, len(by_lang)))
    # At most ``SAMPLE_ALL`` rows, one for a language.
    shares = docs.sparkSession.createDataFrame([(lang, min(1.0, quota / count)) for lang, count in by_lang.items()], "lang string, share double")
    # The draw depends on id and text alone; about ``quota`` documents of each language come, never much more.
    draw = F.pmod(F.xxhash64(F.lit("language"), F.col("doc_id"), F.col("text")), F.lit(1 << 30)) / F.lit(float(1 << 30))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = features(batch.column(0).to_pylist())
            v = weighted(counts, idf).astype(np.float16)
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array([x.tobytes() for x in v], pa.binary()), pa.array(length_class(counts))], names=["lang", "v", "size"])

    sample = rows.join(F.broadcast(shares), "lang").where(draw < F.col("share")).select("text", "lang").mapInArrow(vectors, "lang string, v binary, size long").limit(2 * SAMPLE_ALL).collect()
    groups: dict[str, list[tuple[bytes, int]]] = {}
    for lang, v, size in sample:
        groups.setdefault(lang, []).append((v, size))
    languages, centroids, owner, least = sorted(groups), [], [], []
    for i, lang in enumerate(languages):
        found, sizes = zip(*sorted(groups[lang]))
        v = np.frombuffer(b"".join(found), np.float16).reshape(-1, SIZE).astype(np.float32)
        c = _centroids(v, CENTROIDS)
        centroids.append(c)
        owner += [i] * len(c)
        least.append(limits((v @ c.T).max(axis=1), np.array(sizes)))
    stacked = np.concatenate(centroids) if centroids else np.zeros((0, SIZE))
    return Model(languages, idf.astype(np.float32), stacked.astype(np.float32), np.array(owner, np.int64), np.array(least))


def identify(docs: DataFrame, model: Model, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """``row`` with the columns in ``carry``, ``lang_pred``, ``score`` and ``rejected`` of each document."""
    rows = docs.select(F.col(f"`{text_col}`").alias("text"), carried(carry))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores, rejected = sent.value.predict(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())], names=["row", "lang_pred", "score", "rejected"])

    return rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, lang_pred string, score double, rejected boolean")


def held_out(doc_id: Column, folds: int = FOLDS, fold: int = HELD_OUT) -> Column:
    """Whether a document is in the fold that is not learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(True))


def identified(docs: DataFrame, model: Model) -> DataFrame:
    """The documents that are not rejected, with the columns they came with."""
    return released(identify(docs, model, carry=docs.columns).where(~F.col("rejected")), docs.columns)


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: language of every document of ``documents``, learned from two folds of three."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs.where(~held_out(F.col("doc_id"))))
    found = identify(docs, model, carry=["doc_id"])
    doc_id = F.col("row.doc_id")
    return found.select(doc_id.alias("doc_id"), held_out(doc_id).alias("held_out"), "lang_pred", "score", "rejected")
