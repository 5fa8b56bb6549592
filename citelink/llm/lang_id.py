"""Language identification: n-gram presence kernels, Nyström landmarks, one-versus-rest kernel ridge regression."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citelink.llm.common import lean, text_chunks, with_fields
from citelink.sources.scratch import dropped, stored

UNKNOWN = "und"
#: Byte n-grams of these lengths, hashed to so many presence bits each.
GRAMS, GRAM_BITS = (1, 2, 3, 4), 14
#: At most about so many labelled rows are fitted on, drawn by a hash; so many landmarks of each language.
SAMPLE_ROWS, LANDMARKS = 8192, 16
#: Landmarks of all languages together; with more than 32 languages each has fewer, one at least while they last.
MOST_LANDMARKS = 512
#: Tasks that the sample is dealt to.
FIT_TASKS = 8
RIDGE = 1e-3
#: Bytes and rows of text scored in one matrix product.
SCORE_BYTES, SCORE_ROWS = 1 << 18, 128


@dataclass(frozen=True)
class Model:
    """``landmarks``: presence bits of the landmarks (grams x landmarks); ``coefficients``: landmark kernels to class scores."""

    langs: list[str]
    used: np.ndarray
    landmarks: np.ndarray
    sizes: np.ndarray
    coefficients: np.ndarray


def presence(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each row of UTF-8 bytes, which hashed n-grams it holds: (rows, grams). Case, digits and punctuation of ASCII don't count."""
    rows, width = len(offsets) - 1, len(GRAMS) << GRAM_BITS
    out = np.zeros((rows, width), bool)
    if not len(data):
        return out
    kind = _KIND[data]
    # white space and punctuation runs become one blank; rows never share a gram
    row = np.repeat(np.arange(rows, dtype=np.int64), np.diff(offsets))
    keep = np.ones(len(kind), bool)
    keep[1:] = (kind[1:] != 32) | (kind[:-1] != 32) | (row[1:] != row[:-1])
    kind, row = kind[keep].astype(np.uint32), row[keep]
    flat, code = out.reshape(-1), np.zeros(len(kind), np.uint32)
    for i, n in enumerate(range(1, max(GRAMS) + 1)):
        m = len(kind) - n + 1
        if m <= 0:
            break
        code = code[:m] * np.uint32(257) + kind[n - 1 :]
        same = row[:m] == row[n - 1 :]
        slot = (code * np.uint32(0x9E3779B1)) >> np.uint32(32 - GRAM_BITS)
        flat[(row[:m] * width + (i << GRAM_BITS) + slot)[same]] = True
    return out


_KIND = np.array([x + 32 if 65 <= x <= 90 else x if 97 <= x <= 122 or x >= 128 else 32 for x in range(256)], np.uint8)


def kernel(bits: np.ndarray, model_bits: np.ndarray, sizes: np.ndarray, used: np.ndarray) -> np.ndarray:
    """Presence kernels between rows and landmarks, normalized to 1 for equal sets of n-grams."""
    shared = bits[:, used].astype(np.float32) @ model_bits
    own = bits.sum(1, dtype=np.float64)
    return shared / np.sqrt(np.maximum(own[:, None] * sizes[None, :], 1))


@lean
def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with the packed presence bits of their text in its place."""
    for batch in batches:
        names = batch.schema.names
        found = [np.packbits(presence(data, offsets), axis=1) for _, _, data, offsets in text_chunks(batch.column(names.index("text")), SCORE_BYTES, SCORE_ROWS)]
        packed = pa.array([row.tobytes() for rows in found for row in rows], pa.binary())
        yield pa.RecordBatch.from_arrays([*(batch.column(names.index(n)) for n in ("_n", "_place", "lang")), packed], ["_n", "_place", "lang", "bits"])


def _partial(shared, langs: list[str]):
    """Of all batches of a task: the sums that ridge regression needs, as the bytes of one matrix."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, sizes, used, root = shared.value
        m = len(sizes)
        total = np.zeros((m + 1, m + 1 + len(langs)))
        at_of = {x: i for i, x in enumerate(langs)}
        for batch in batches:
            labels = batch.column(1).to_pylist()
            for at, n, data, offsets in text_chunks(batch.column(0), SCORE_BYTES, SCORE_ROWS):
                phi = np.hstack([kernel(presence(data, offsets), bits, sizes, used) @ root, np.ones((n, 1))])
                y = np.full((n, len(langs)), -1.0)
                y[np.arange(n), [at_of[x] for x in labels[at : at + n]]] = 1
                total += phi.T @ np.hstack([phi, y])
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

    return run


def fit(labelled: DataFrame, sample_rows: int = SAMPLE_ROWS, landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model | None:
    """A model from (doc_id, text, lang); None where nothing is labelled.

    A sample of about ``sample_rows`` rows, drawn by a hash of doc_id, bounds the fit; each language gives up to
    ``landmarks`` landmark texts, MOST_LANDMARKS in all. Every language is learned, also one without a landmark of its own. Sums over the
    sample are gathered on the executors; the driver solves one system as large as the landmarks. What the driver
    and the model hold grows with the number of languages, never with rows.
    """
    labelled = labelled.where("text is not null and lang is not null and doc_id is not null").where(F.col("text").rlike(r"\p{L}"))
    counts = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}  # a row for each language
    if not counts:
        return None
    total, langs = sum(counts.values()), sorted(counts)
    landmarks = max(1, min(landmarks, MOST_LANDMARKS // len(langs)))
    # rare languages keep more of their rows, so that each has its landmarks
    rates = [(x, min(1.0, max(sample_rows / total, 4.0 * landmarks / counts[x]))) for x in langs]
    kept = labelled.sparkSession.createDataFrame(rates, "lang string, _rate double")
    place = F.shiftrightunsigned(F.xxhash64("doc_id"), 1) / F.lit(float(1 << 63))
    sample = labelled.join(F.broadcast(kept) if len(langs) <= 100_000 else kept, "lang").withColumn("_place", place).where("_place < _rate")
    sample = stored(sample.select("doc_id", "text", "lang", "_place"), "sample")
    nearest = Window.partitionBy("lang").orderBy("_place", "doc_id", "text")
    first = sample.withColumn("_n", F.row_number().over(nearest)).where(F.col("_n") <= landmarks)
    # of a landmark only its presence bits come to the driver, 8 KB however long its text is
    picked = first.orderBy("_n", "_place", "lang").limit(MOST_LANDMARKS).select("_n", "_place", "lang", "text")
    rows = picked.mapInArrow(_marked, "_n int, _place double, lang string, bits binary").collect()
    rows.sort(key=lambda r: (r["_n"], r["_place"], r["lang"], bytes(r["bits"])))
    bits = np.unpackbits(np.stack([np.frombuffer(r["bits"], np.uint8) for r in rows]), axis=1).astype(bool)
    used = np.flatnonzero(bits.any(0))
    sizes = bits.sum(1, dtype=np.float64)
    model_bits = np.ascontiguousarray(bits[:, used].T.astype(np.float32))
    values, vectors = np.linalg.eigh(kernel(bits, model_bits, sizes, used).astype(np.float64))
    keep = values > 1e-9
    root = vectors[:, keep] / np.sqrt(values[keep])
    m = root.shape[1]
    shared = labelled.sparkSession.sparkContext.broadcast((model_bits, sizes, used, np.hstack([root, np.zeros((len(sizes), len(sizes) - m))])))
    dealt = sample.repartition(FIT_TASKS, "_place").sortWithinPartitions("_place", "doc_id", "text").select("text", "lang")
    sums = sorted(bytes(r["sums"]) for r in dealt.mapInArrow(_partial(shared, langs), "sums binary").collect())  # in one order, so that reruns agree
    wide = len(sizes) + 1
    table = sum(np.frombuffer(x) for x in sums).reshape(wide, -1)
    dropped(sample)
    gram, right = table[:, :wide], table[:, wide:]
    solved = np.linalg.solve(gram + np.eye(wide) * ridge * max(1.0, gram[-1, -1]), right)
    return Model(langs, used, model_bits, sizes, np.vstack([np.hstack([root, np.zeros((len(sizes), len(sizes) - m))]) @ solved[:-1], solved[-1:]]))


def _scored(shared):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        names = np.array(model.langs, object)
        for batch in batches:
            columns, names_in = list(batch.columns), batch.schema.names
            pred, score = [], []
            known = np.array(batch.column(names_in.index("_known")).to_pylist(), bool)
            for at, n, data, offsets in text_chunks(batch.column(names_in.index("text")), SCORE_BYTES, SCORE_ROWS):
                k = kernel(presence(data, offsets), model.landmarks, model.sizes, model.used)
                s = k @ model.coefficients[:-1] + model.coefficients[-1]
                e = np.exp(4 * (s - s.max(1, keepdims=True)))
                ok = known[at : at + n]
                pred += np.where(ok, names[s.argmax(1)], UNKNOWN).tolist()
                score += np.where(ok, 1 / e.sum(1), 0.0).tolist()
            out = [(c, x) for c, x in zip(names_in, columns, strict=True) if c != "_known"]
            yield pa.RecordBatch.from_arrays([*(x for _, x in out), pa.array(pred, pa.string()), pa.array(score, pa.float64())], [*(c for c, _ in out), "lang_pred", "score"])

    return run


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """``docs`` with ``lang_pred`` (a learned language, or "und" for a text without a letter, a null one or no model) and ``score`` (0 to 1).

    Only the text is read. Every text is scored whole; an empty table gives an empty result; a text of n-grams that
    no landmark holds goes to the language with the highest intercept, at a low score. Of equal scores the language first in order wins. Columns already so named are replaced.
    """
    docs = docs.drop("lang_pred", "score", "_known")
    if model is None:
        return docs.withColumn("lang_pred", F.lit(UNKNOWN)).withColumn("score", F.lit(0.0))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    known = docs.withColumn("_known", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    return known.mapInArrow(_scored(shared), with_fields(docs, "lang_pred string, score double"))


def held_out(doc_id="doc_id"):
    """Whether a row is kept from the fit: crc32 of doc_id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit_on_documents(docs: DataFrame) -> Model | None:
    return fit(docs.where(~held_out()).select("doc_id", "text", "lang"))


def op7_lang_id(spark, sf_dir: str) -> DataFrame:
    """The language of every document, learned from three quarters of them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scored = predict(docs.select("doc_id", "text"), fit_on_documents(docs))
    return scored.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
