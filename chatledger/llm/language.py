"""Language identification with error-correcting output codes.

Every language has a codeword of bits. One binary classifier per bit tells, from hashed byte trigrams, the languages
whose bit is set from the others; the nearest codeword under a weighted loss is the answer. A wrong bit or two is
corrected by the others, and a text between two codewords is flagged as ambiguous.

Training is one distributed count: trigrams per language over all labelled documents. The model that the driver
holds is a table of languages times ``FEATURES`` counts, whatever the number of documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatledger.llm.common import flat_text, slices

#: Hash buckets of the trigrams.
FEATURES = 4096
#: Name of the answer for texts without a letter.
UNKNOWN = "und"
#: At most so many bits in a codeword; all different splits are used where there are fewer.
MOST_BITS = 63

_LOWER = np.array([c + 32 if 65 <= c <= 90 else 32 if c < 65 or 90 < c < 97 or 122 < c < 128 else c
                   for c in range(256)], np.uint32)


def trigrams(flat: np.ndarray) -> np.ndarray:
    """The bucket of the trigram that starts at each byte but the last two. ASCII that is no letter counts as space."""
    b = _LOWER[flat]
    mixed = (b[:-2] * np.uint32(0x9E3779B1)) ^ (b[1:-1] * np.uint32(0x85EBCA77)) ^ (b[2:] * np.uint32(0xC2B2AE3D))
    return ((mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x27D4EB2F) >> np.uint32(20)).astype(np.int64)


def _histograms(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """Per text, its place and the counts of its trigrams, never of two texts together."""
    flat, offsets = flat_text(column)
    for first, last in slices(offsets, 1 << 20):
        start = offsets[first]
        part = flat[start : offsets[last]]
        grams = trigrams(part) if len(part) > 2 else np.zeros(0, np.int64)
        for i in range(first, last):
            own = grams[offsets[i] - start : max(offsets[i] - start, offsets[i + 1] - start - 2)]
            yield i, np.bincount(own, minlength=FEATURES)


def codewords(languages: int, seed: int = 7) -> np.ndarray:
    """A row of 1 and -1 per language. Up to seven languages get all splits into two; more get the best of several
    random codes by the smallest distance between two rows."""
    if languages < 2:
        return np.ones((languages, 1))
    if 2 ** (languages - 1) - 1 <= MOST_BITS:
        splits = np.arange(1, 2 ** (languages - 1))
        return np.array([[1 if i and s >> (i - 1) & 1 else -1 for s in splits] for i in range(languages)])
    draw, best = np.random.Generator(np.random.PCG64(seed)), None
    for _ in range(20):
        code = draw.choice([-1, 1], (languages, MOST_BITS))
        near = (code @ code.T - 2 * MOST_BITS * np.eye(languages)).max()
        if (np.abs(code.sum(0)) < languages).all() and (best is None or near < best[0]):
            best = (near, code)
    return best[1]


@dataclass(frozen=True)
class Model:
    """Languages, their codewords, the weights of the bit classifiers and the weight of each bit per language."""

    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    trust: np.ndarray

    def decode(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per row of trigram counts: the language's place, its score and whether another one is close."""
        if len(self.languages) == 1:
            return np.zeros(len(counts), int), np.ones(len(counts)), np.zeros(len(counts), bool)
        n = np.maximum(counts.sum(1, keepdims=True), 1)
        margins = counts @ self.weights / np.sqrt(n)
        loss = np.logaddexp(0, -margins[:, None, :] * self.code[None])
        distance = (loss * self.trust[None]).sum(2)
        odds = np.exp(distance.min(1, keepdims=True) - distance)
        odds /= odds.sum(1, keepdims=True)
        ranked = np.sort(odds, 1)
        return odds.argmax(1), ranked[:, -1], ranked[:, -1] - ranked[:, -2] < 0.1


def held_out() -> Column:
    """Whether a document is kept from training. A null doc_id is neither held out nor learned from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def train(documents: DataFrame) -> Model:
    """Learn from text and lang of all documents that are not held out; null lang or text teaches nothing."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            for i, counts in _histograms(batch.column("text")):
                own = sums.setdefault(langs[i], np.zeros(FEATURES, np.int64))
                own += counts
        for lang, own in sums.items():
            seen = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(seen), pa.string()), pa.array(seen, pa.int32()), pa.array(own[seen])],
                ["lang", "feature", "n"])

    usable = documents.where(~held_out() & F.col("doc_id").isNotNull() & F.col("lang").isNotNull())
    rows = usable.select("lang", "text").mapInArrow(count, "lang string, feature int, n long")
    # Languages times FEATURES rows at most.
    got = rows.groupBy("lang", "feature").agg(F.sum("n").alias("n")).toArrow()
    names = sorted(set(got.column("lang").to_pylist()))
    if not names:
        return Model([], np.zeros((0, 1)), np.zeros((FEATURES, 1)), np.zeros((0, 1)))
    place = {name: i for i, name in enumerate(names)}
    counts = np.zeros((len(names), FEATURES))
    counts[[place[x] for x in got.column("lang").to_pylist()], np.asarray(got.column("feature"))] = got.column("n")
    code = codewords(len(names))
    shares = (counts + 0.5) / (counts + 0.5).sum(1, keepdims=True)
    weights = np.zeros((FEATURES, code.shape[1]))
    if len(names) > 1:
        for b in range(code.shape[1]):
            weights[:, b] = np.log(shares[code[:, b] > 0].mean(0)) - np.log(shares[code[:, b] < 0].mean(0))
    expected = np.maximum(code * (shares @ weights), 1e-3)
    return Model(names, code, weights, expected / expected.mean(1, keepdims=True))


def _predicted(texts: pa.Array, model: Model) -> tuple[list[str], np.ndarray, np.ndarray]:
    rows = len(texts)
    languages, scores, close = [UNKNOWN] * rows, np.zeros(rows), np.zeros(rows, bool)
    letters = [t is not None and any(map(str.isalpha, t)) for t in texts.to_pylist()]
    block: list[tuple[int, np.ndarray]] = []

    def flush() -> None:
        if block:
            best, score, near = model.decode(np.array([c for _, c in block], float))
            for (i, _), b, s, c in zip(block, best, score, near, strict=True):
                languages[i], scores[i], close[i] = model.languages[b], s, c
            block.clear()

    if model.languages:
        for i, counts in _histograms(texts):
            if letters[i]:
                block.append((i, counts))
                if len(block) >= 512:
                    flush()
        flush()
    return languages, scores, close


def identify(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score and ambiguous for every row.

    Texts that are null or have no letter, and all texts if nothing was learned, are ``und`` with score 0. Texts of
    under three bytes have no trigram: all languages are equally near, and the first by name is returned as
    ambiguous. Repeated rows give repeated results; other columns are not read.
    """
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            languages, scores, close = _predicted(batch.column("text"), model)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(languages, pa.string()),
                 pa.array(scores), pa.array(close)],
                ["doc_id", "held_out", "lang_pred", "score", "ambiguous"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(
        predict, f"doc_id {kind}, held_out boolean, lang_pred string, score double, ambiguous boolean")


def reject(documents: DataFrame, model: Model, *, least: float = 0.5) -> DataFrame:
    """The documents whose language is known, with all their columns: neither ``und`` nor ambiguous with a score
    under ``least``. Only texts go through Python, and only verdicts come back. An empty table gives an empty one."""
    @F.arrow_udf("boolean")
    def known(texts: pa.Array) -> pa.Array:
        languages, scores, close = _predicted(texts, model)
        return pa.array([x != UNKNOWN and not (c and s < least) for x, s, c in zip(languages, scores, close, strict=True)])

    return documents.where(known("text"))
