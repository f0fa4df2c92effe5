"""Language ID as a mixture: the share of each language in a text by expectation-maximisation."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Training rows of a language at most, picked by a hash of the text.
SAMPLE_ROWS = 1000
#: Slots that letter trigrams are hashed into, which bounds the model.
SLOTS = 1 << 17
ROUNDS, MAX_SET = 8, 5
#: Characters that are worked on at once.
CHARS = 400_000

_LETTERS = None


def _letters() -> np.ndarray:
    """Whether each code point is a letter."""
    global _LETTERS
    if _LETTERS is None:
        _LETTERS = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _LETTERS


def letter_slots(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each letter: its place, the slot of the trigram around it, and whether it starts a word.

    Everything but letters counts as a blank.
    """
    codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[codes]
    at = np.flatnonzero(letter)
    codes = np.where(letter, codes, np.uint32(32))
    mixed = (codes[at - 1] * np.uint32(0x9E3779B1)) ^ (codes[at] * np.uint32(0x85EBCA77)) ^ (codes[at + 1] * np.uint32(0xC2B2AE3D))
    mixed = (mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    return at, (mixed >> np.uint32(15)).astype(np.int64) % SLOTS, ~letter[at - 1]


@dataclass
class LanguageModel:
    languages: list[str]
    log_p: np.ndarray  # slots x languages


def fit_languages(labelled: DataFrame, sample_rows: int = SAMPLE_ROWS) -> LanguageModel:
    """Trigram likelihoods of each ``lang`` from at most about ``sample_rows`` texts of it.

    Rows without lang or text are left out; without rows there are no languages.
    """
    known = labelled.where("lang is not null and text is not null").select("lang", "text")
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(sizes)
    if not languages:
        return LanguageModel([], np.zeros((SLOTS, 0), np.float32))
    share = F.create_map(*[F.lit(x) for k in languages for x in (k, min(1.0, sample_rows / sizes[k]))])
    sample = known.where(F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < 1_000_000 * share[F.col("lang")])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = sums.setdefault(lang, np.zeros(SLOTS, np.int64))
                own += np.bincount(letter_slots(text)[1], minlength=SLOTS)
        for lang, own in sums.items():
            slots = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(slots)), pa.array(slots), pa.array(own[slots])], ["lang", "slot", "n"])

    counts = sample.mapInArrow(count, "lang string, slot long, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n")).toArrow()
    table = np.full((SLOTS, len(languages)), 0.1)
    columns = [languages.index(x) for x in counts.column("lang").to_pylist()]
    table[counts.column("slot").to_numpy(), columns] += counts.column("n").to_numpy()
    return LanguageModel(languages, np.log(table / table.sum(axis=0)).astype(np.float32))


def mixtures(texts: list[str], model: LanguageModel) -> list[list[tuple[str, float]]]:
    """The languages of each text with their shares of its words, the largest first.

    A word is a draw from one language.  Shares are fitted for all languages;
    of the sets of the j most common ones the one with the highest likelihood
    less half of j log(words), as of a parameter each, is kept.  A text without
    letters has none.  Ties go to the language that sorts first.
    """
    joined = "\n".join(texts)
    places = np.cumsum([1, *[len(t.lower()) + 1 for t in texts]])  # of each text in the padded whole
    at, slots, starts = letter_slots(joined)
    if not len(at) or not model.languages:
        return [[] for _ in texts]
    first = np.flatnonzero(starts)
    words = np.add.reduceat(model.log_p[slots], first, axis=0)
    top = words.max(axis=1, keepdims=True)
    likely = np.exp(words - top)
    owner = np.searchsorted(places, at[first], side="right") - 1
    heads = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
    docs, sizes = owner[heads], np.diff(np.r_[heads, len(owner)])
    group = np.repeat(np.arange(len(docs)), sizes)
    shares = np.full((len(docs), len(model.languages)), 1 / len(model.languages), np.float32)
    for _ in range(ROUNDS):
        weighed = likely * shares[group]
        weighed /= weighed.sum(axis=1, keepdims=True)
        # Always as many rounds: when to stop must not hang on the other texts of a batch.
        shares = np.add.reduceat(weighed, heads, axis=0) / sizes[:, None]
    order = np.argsort(-shares, axis=1, kind="stable")
    best, chosen, size = np.full(len(docs), -np.inf), shares.copy(), np.zeros(len(docs), int)
    for j in range(1, min(MAX_SET, len(model.languages)) + 1):
        inside = np.zeros_like(shares)
        np.put_along_axis(inside, order[:, :j], np.take_along_axis(shares, order[:, :j], axis=1), axis=1)
        inside /= np.maximum(inside.sum(axis=1, keepdims=True), 1e-30)
        fit = np.add.reduceat(np.log(np.maximum((likely * inside[group]).sum(axis=1), 1e-38)), heads)
        fit = fit - j * np.log(sizes + 1.0) / 2
        better = fit > best
        best, size = np.where(better, fit, best), np.where(better, j, size)
        chosen[better] = inside[better]
    out: list[list[tuple[str, float]]] = [[] for _ in texts]
    for k, doc in enumerate(docs.tolist()):
        out[doc] = [(model.languages[m], float(min(chosen[k, m], 1.0))) for m in order[k, : size[k]]]
    return out


def predict_languages(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, lang_pred, score (its share) and languages (lang, share) of each row's whole text.

    ``und`` with score 0 where the text is null or has no letter, or no
    language was learned.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))
        for batch in batches:
            found, some, total = [], [], 0
            for text in batch.column(1):
                some.append(text.as_py() or "")
                total += len(some[-1])
                if total >= CHARS:
                    found += mixtures(some, held.value)
                    some, total = [], 0
            found += mixtures(some, held.value) if some else []
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array([x[0][0] if x else "und" for x in found], pa.string()),
                    pa.array([x[0][1] if x else 0.0 for x in found], pa.float64()),
                    pa.array([[{"lang": a, "share": b} for a, b in x] for x in found], kind),
                ],
                ["doc_id", "lang_pred", "score", "languages"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(predict, "doc_id long, lang_pred string, score double, languages array<struct<lang:string,share:double>>")
