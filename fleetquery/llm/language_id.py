"""Language identification with string kernels (operator 4).

The kernel of two texts counts the character n-grams of one to three
characters that both hold (presence, lower case, blended over the lengths),
divided by the geometric mean of their own counts. A bounded sample of
labelled texts gives landmarks; the Nyström map sends a text's kernel row to
features in which one ridge regression a language separates it from the rest.
A batch of texts is scored by matrix products: presence of n-grams by the
landmarks' presence, which gives kernel rows, then by the map and the weights.

A text that shares no n-gram with the model scores 0. One in a language that
was not learned scores about 0.5, and few of its n-grams are known. Which scores
and shares are too low is read off the labelled sample itself, each half of it
judged by a model of the other half.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetquery.llm.common import table

UNKNOWN = "und"
#: Labelled texts that each language gives the sample at most, and how long.
PER_LANGUAGE = 250
SAMPLE_CHARS = 20_000
#: Of those, texts that serve as landmarks.
LANDMARKS = 48
RIDGE = 0.01
#: Part of the labelled texts that may fall under each limit of ``limits``.
LOW_PART = 0.005
NGRAM = 3
_BITS = 21  # a code point plus one fits
_BLOCK = 1 << 20


def grams(text: str) -> np.ndarray:
    """Sorted codes of the different n-grams of the whole text."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + 1
    found: list[np.ndarray] = []
    for at in range(0, max(len(points), 1), _BLOCK):
        part = points[at : at + _BLOCK + NGRAM - 1]
        codes, held = part, [part]
        for n in range(1, NGRAM):
            codes = codes[:-1] << np.uint64(_BITS) | part[n:]
            held.append(codes)
        found.append(np.unique(np.concatenate(held)))
    return found[0] if len(found) == 1 else np.unique(np.concatenate(found))


@dataclass
class Model:
    """codes: the landmarks' n-grams, sorted; presence: codes by landmarks, 0
    or 1; norms: root of each landmark's number of n-grams; nystrom: landmarks
    by features; weights: features by languages."""

    languages: tuple[str, ...]
    codes: np.ndarray
    presence: np.ndarray
    norms: np.ndarray
    nystrom: np.ndarray
    weights: np.ndarray

    def __getstate__(self) -> dict:
        return {k: v for k, v in vars(self).items() if k != "_dense"}

    @property
    def dense(self) -> np.ndarray:
        """``presence`` for products, made once in each worker; counts of
        n-grams are exact in single precision."""
        if not hasattr(self, "_dense"):
            self._dense = self.presence.astype(np.float32)
        return self._dense

    def score(self, texts: list[str]) -> np.ndarray:
        """A regression value for each text and language."""
        return self.judge(texts)[0]

    def judge(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """As ``score``, and the share of each text's n-grams that is known."""
        held = np.zeros((len(texts), len(self.codes)), np.float32)
        own, known = np.ones(len(texts)), np.zeros(len(texts))
        for n, text in enumerate(texts):
            found = grams(text)
            at = places(self.codes, found)
            held[n, at] = 1
            own[n], known[n] = max(len(found), 1), len(at)
        kernel = (held @ self.dense) / np.sqrt(own)[:, None] / self.norms
        return kernel @ self.nystrom @ self.weights, known / own


def places(codes: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Where those of ``own`` that are among the sorted ``codes`` stand."""
    if not len(codes):
        return np.zeros(0, np.int64)
    at = np.searchsorted(codes, own)
    return at[codes[np.minimum(at, len(codes) - 1)] == own]


def fit(sample: list[tuple[str, str]], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """A model from (text, language) pairs. No pairs: a model of no language."""
    languages = tuple(sorted({lang for _, lang in sample}))
    if not languages:
        return Model((), np.zeros(0, np.uint64), np.zeros((0, 0)), np.zeros(0), np.zeros((0, 0)), np.zeros((0, 0)))
    held = [grams(text) for text, _ in sample]
    seen: dict[str, int] = {}
    chosen = []
    for n, (_, lang) in enumerate(sample):
        seen[lang] = seen.get(lang, 0) + 1
        if seen[lang] <= landmarks:
            chosen.append(n)
    codes = np.unique(np.concatenate([held[n] for n in chosen]))
    presence = np.zeros((len(codes), len(chosen)), np.uint8)
    for k, n in enumerate(chosen):
        presence[np.searchsorted(codes, held[n]), k] = 1
    norms = np.sqrt([max(len(held[n]), 1) for n in chosen])
    rows = np.array([presence[places(codes, own)].sum(0) / np.sqrt(max(len(own), 1)) for own in held]) / norms
    values, vectors = np.linalg.eigh(rows[chosen])
    kept = values > 1e-8 * values.max()
    nystrom = vectors[:, kept] / np.sqrt(values[kept])
    features = rows @ nystrom
    sides = np.where(np.array([lang for _, lang in sample])[:, None] == np.array(languages), 1.0, -1.0)
    share = np.array([1 / sum(x == lang for _, x in sample) for _, lang in sample]) * len(sample)
    weighted = features * share[:, None]
    solved = np.linalg.solve(features.T @ weighted + ridge * len(sample) * np.eye(features.shape[1]), weighted.T @ sides)
    return Model(languages, codes, presence, norms, nystrom, solved)


def scores_of(values: np.ndarray, shares: np.ndarray) -> np.ndarray:
    """Where the best value lies between "all other" (0) and "this language"
    (1); 0 without a known n-gram."""
    return np.where(shares > 0, np.clip((values.max(1) + 1) / 2, 0, 1), 0.0)


def limits(sample: list[tuple[str, str]], part: float = LOW_PART) -> tuple[float, float]:
    """Score and share of known n-grams under which a text is of no learned
    language: the low quantiles of the sample, judged by halves. A language
    with a single text has no other half and says nothing; without any other,
    nothing can be told and both limits are 0."""
    seen: dict[str, int] = {}
    halves: tuple[list, list] = ([], [])
    for text, lang in sample:
        seen[lang] = seen.get(lang, 0) + 1
        halves[seen[lang] % 2].append((text, lang))
    scores, shares = [np.zeros(0)], [np.zeros(0)]
    for own, other in (halves, halves[::-1]):
        texts = [text for text, lang in own if seen[lang] > 1 and any(map(str.isalpha, text))]
        model = fit(other)
        for at in range(0, len(texts), 64):
            values, known = model.judge(texts[at : at + 64])
            scores.append(scores_of(values, known))
            shares.append(known)
    every = np.concatenate(scores), np.concatenate(shares)
    return tuple(float(np.quantile(x, part)) if len(x) else 0.0 for x in every)


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 4 == 2, F.lit(False))


def labelled_sample(docs: DataFrame, per_language: int = PER_LANGUAGE) -> list[tuple[str, str]]:
    """At most ``per_language`` texts of each language that are not held out,
    whole and of at most SAMPLE_CHARS characters, spread by a hash of doc_id."""
    usable = docs.where(
        F.col("lang").isNotNull() & ~is_held_out(F.col("doc_id")) & (F.length("text").between(1, SAMPLE_CHARS))
    ).select("doc_id", "text", "lang")
    counts = usable.groupBy("lang").agg(F.count("*").alias("rows"))  # one row a language
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) / float(1 << 40)
    taken = usable.join(F.broadcast(counts), "lang").where(draw < F.lit(2.0 * per_language) / F.col("rows"))
    rows = taken.select("lang", "text", F.xxhash64("doc_id").alias("at")).collect()
    rows.sort(key=lambda r: (r["lang"], r["at"], r["text"]))
    kept, count = [], {}
    for r in rows:
        count[r["lang"]] = count.get(r["lang"], 0) + 1
        if count[r["lang"]] <= per_language:
            kept.append((r["text"], r["lang"]))
    return kept


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score of every row, from its text alone.

    ``und`` with score 0: the text is null, holds no letter, or the model
    knows no language. Ties go to the language first by name. Score: where
    the best value lies between "all other" (0) and "this language" (1).
    """
    held = docs.sparkSession.sparkContext.broadcast(model)  # n-grams of a bounded sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = held.value
        for batch in batches:
            texts = [x or "" for x in batch.column("text").to_pylist()]
            lettered = [known.languages and any(map(str.isalpha, x)) for x in texts]
            preds, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
            rows = [n for n, yes in enumerate(lettered) if yes]
            for at in range(0, len(rows), 64):
                part = rows[at : at + 64]
                values, shares = known.judge([texts[n] for n in part])
                for n, own, score in zip(part, values, scores_of(values, shares)):
                    preds[n] = known.languages[int(own.argmax())]
                    scores[n] = float(score)
            columns = [batch.column("doc_id"), pa.array(preds, pa.string()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: Model, least: float, share: float = np.inf) -> DataFrame:
    """``docs`` without rows whose language is unknown, or that score under
    ``least`` while less than ``share`` of their n-grams are known. Very short
    texts of a learned language score low, but hardly hold unknown n-grams;
    long ones hold some, but score high."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def known(texts):  # type: ignore[no-untyped-def]
        model = held.value
        out = np.zeros(len(texts), bool)
        rows = [n for n, x in enumerate(texts) if x and model.languages and any(map(str.isalpha, x))]
        for at in range(0, len(rows), 64):
            part = rows[at : at + 64]
            values, shares = model.judge([texts.iloc[n] for n in part])
            out[part] = (scores_of(values, shares) >= least) | (shares >= share)
        import pandas as pd

        return pd.Series(out)

    return docs.where(known("text"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify(docs, fit(labelled_sample(docs)))
    return found.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
