"""Language identification by mixture inference.

Each language has a model of hashed four-byte windows, learned from counts over all labelled
training documents. A document is a mixture: every word was written in one of the languages,
with a likelihood from its windows, and expectation-maximisation estimates the languages'
proportions. The set of languages is chosen by penalised likelihood: languages join in the order
of their proportions while the gain in log-likelihood exceeds ``PENALTY`` times the logarithm
of the number of words. The prediction is the language with the largest proportion within
the chosen set, and the score that proportion.

The model has ``BUCKETS`` numbers for each language, whatever the corpus, and only it is sent to
the executors. A table with more than ``MAX_LANGUAGES`` labels is refused.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; null and empty
labels teach nothing, and so do null texts; without any labelled training document everything
is ``und``. Rows are handled one by one, so repeated ids and ties need nothing special; of
equal proportions the language that sorts first wins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shopmetrics.llm.common import pieces, utf8

BITS = 16
BUCKETS = 1 << BITS
SMOOTHING = 0.5
ROUNDS = 8
PENALTY = 1.5
MAX_LANGUAGES = 256
UNKNOWN = "und"
LETTER = regex.compile(r"\p{L}")

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[:128] = 32  # ASCII other than letters separates words; bytes from 128 on belong to letters beyond ASCII
_FOLD[65:91] = _FOLD[97:123] = np.arange(97, 123, dtype=np.uint8)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(3)) == 1, F.lit(False))


def windows(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and end position of each four-byte window within a word with its blanks.

    ``bounds``: starts and the end of the texts in ``data``; no window reaches over one.
    """
    size = len(data) + len(bounds) - 1
    padded = np.full(size + 4, 32, np.uint8)
    place = np.arange(len(data)) + np.repeat(np.arange(len(bounds) - 1), np.diff(bounds)) + 3
    padded[place] = _FOLD[data]
    code = padded.astype(np.uint32)
    four = (code[:-3] << 24) | (code[1:-2] << 16) | (code[2:-1] << 8) | code[3:]
    # Windows over the seam of two words say little about either: the middle bytes must be letters.
    full = (padded[1:-2] != 32) & (padded[2:-1] != 32)
    at = np.flatnonzero(full)
    return (four[at] * np.uint32(2654435761)) >> np.uint32(32 - BITS), at


def text_of(at: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Index of the text that holds the second byte of the windows at ``at``."""
    n = len(bounds) - 1
    return np.searchsorted(bounds[1:] + np.arange(n), at - 2, side="right")


def train(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages and their log-probabilities (BUCKETS x languages) from documents that aren't held out."""
    known = docs.where(F.col("lang").isNotNull() & (F.col("lang") != "") & F.col("text").isNotNull())
    known = known.where(~held_out(F.col("doc_id"))).select("lang", "text")
    langs = sorted(row[0] for row in known.select("lang").distinct().limit(MAX_LANGUAGES + 1).collect())
    if len(langs) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    place = {lang: k for k, lang in enumerate(langs)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(place), BUCKETS), np.int64)
        for batch in batches:
            label = np.array([place[x] for x in batch.column(0).to_pylist()], np.int64)
            data, offsets = utf8(batch.column(1))
            for a, b in pieces(offsets):
                bounds = offsets[a : b + 1] - offsets[a]
                bucket, at = windows(data[offsets[a] : offsets[b]], bounds)
                total += np.bincount(label[a + text_of(at, bounds)] * BUCKETS + bucket, minlength=total.size).reshape(total.shape)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.reshape(-1)[at])], ["cell", "n"])

    cells = known.mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    got = cells.toPandas() if langs else pd.DataFrame({"cell": [], "n": []})
    table = np.zeros(len(langs) * BUCKETS)
    table[got["cell"].to_numpy(np.int64)] = got["n"].to_numpy(np.float64)
    table = table.reshape(len(langs), BUCKETS) + SMOOTHING
    return langs, np.log(table / table.sum(axis=1, keepdims=True)).T.astype(np.float32).copy()


def _expect(like: np.ndarray, first: np.ndarray, words: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Proportions and log-likelihood of each text when only its ``allowed`` languages may occur."""
    share = allowed / allowed.sum(axis=1, keepdims=True)
    text = np.repeat(np.arange(len(words)), words)
    total = None
    for _ in range(ROUNDS):
        part = like * share[text]
        total = part.sum(axis=1, keepdims=True) + 1e-300
        share = np.add.reduceat(part / total, first, axis=0) / words[:, None]
    return share, np.add.reduceat(np.log(total[:, 0]), first)


def infer(data: np.ndarray, bounds: np.ndarray, model: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the best language (-1: none) and its proportion, for each text."""
    n, k = len(bounds) - 1, model.shape[1]
    best, score = np.full(n, -1), np.zeros(n)
    bucket, at = windows(data, bounds)
    if not len(at) or not k:
        return best, score
    new_word = np.flatnonzero(np.diff(at, prepend=-9) > 1)
    log_like = np.add.reduceat(model[bucket], new_word, axis=0).astype(np.float64)
    top = log_like.max(axis=1, keepdims=True)
    like = np.exp(np.maximum(log_like - top, -60.0))
    rows, first, words = np.unique(text_of(at[new_word], bounds), return_index=True, return_counts=True)
    full, _ = _expect(like, first, words, np.ones((len(rows), k)))
    order = np.argsort(-full, axis=1, kind="stable")
    allowed = np.zeros((len(rows), k))
    chosen = fit = None
    open_rows = np.ones(len(rows), bool)
    for size in range(1, k + 1):
        allowed[np.arange(len(rows)), order[:, size - 1]] = 1.0
        share, log_total = _expect(like, first, words, allowed)
        value = log_total - PENALTY * size * np.log(words + 1)
        if size == 1:
            chosen, fit = share, value
            continue
        open_rows &= value > fit
        if not open_rows.any():
            break
        chosen[open_rows], fit[open_rows] = share[open_rows], value[open_rows]
    best[rows] = chosen.argmax(axis=1)
    score[rows] = chosen.max(axis=1)
    return best, np.minimum(score, 1.0)


def language_of(text: Column, langs: list[str], model: np.ndarray, spark) -> Column:
    """struct<lang string, score double> of a text by a trained model."""
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang:string,score:double>")
    def predict(column: pa.Array) -> pa.Array:
        data, offsets = utf8(column)
        lang, score = np.full(len(column), UNKNOWN, object), np.zeros(len(column))
        for a, b in pieces(offsets):
            best, proportion = infer(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], shared.value)
            for i in np.flatnonzero(best >= 0):
                if LETTER.search(column[a + int(i)].as_py()):
                    lang[a + i], score[a + i] = langs[best[i]], proportion[i]
        if langs:  # letters outside any window, as in a text of one letter: the languages' order decides
            for i in np.flatnonzero(lang == UNKNOWN):
                value = column[int(i)].as_py()
                if value and LETTER.search(value):
                    lang[i], score[i] = langs[0], 1.0 / len(langs)
        return pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score)], ["lang", "score"])

    return predict(text)


def identify(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score; learned from the same table."""
    langs, model = train(docs)
    found = language_of(F.col("text"), langs, model, docs.sparkSession)
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), found.alias("found"))
    return rows.select("doc_id", "held_out", F.col("found.lang").alias("lang_pred"), F.col("found.score").alias("score"))


def known_language(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that have a language, with all their columns; texts without a letter go."""
    langs, model = train(docs)
    found = language_of(docs["text"], langs, model, docs.sparkSession)
    return docs.where(found["lang"] != UNKNOWN)
