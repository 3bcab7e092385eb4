"""Language identification with a string kernel.

A text is the set of its n-grams of 1 to ``ORDER`` characters (letters lower-cased, other runs one
space), hashed to ``BUCKETS``: a blended-spectrum presence vector. The kernel of two texts is the cosine of their
vectors. Nyström landmarks map it to finite features, and kernel ridge regression fits one
classifier per language against the rest. Texts are scored in batches by two matrix products,
presence times landmarks and kernel values times coefficients.

The classifier is fitted on a bounded sample, a share of the rows by a hash of id and text that
makes about ``ROWS_PER_LANGUAGE`` of each language; every text is scored whole, long ones in pieces whose sets are united.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ORDER, BUCKETS, LANDMARKS, ROWS_PER_LANGUAGE, RIDGE, PIECE, BATCH = 3, 1 << 15, 96, 300, 1e-3, 1 << 20, 128
UNKNOWN = "und"


@functools.lru_cache(1)
def _letters() -> np.ndarray:
    """Which code points are letters."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)


def mark_presence(text: str | None, row: np.ndarray) -> bool:
    """Set the buckets of the text's n-grams in ``row``; whether the text has a letter.

    A piece begins with the last characters that the pieces before have left of the text, so pieces
    change nothing, however long a run of other characters is.
    """
    text, any_letter = text or "", False
    rest, after_letter = np.zeros(0, dtype=np.uint32), False
    for start in range(0, len(text), PIECE):
        codes = np.frombuffer(text[start : start + PIECE].lower().encode("utf-32-le"), dtype="<u4")
        letter = _letters()[codes]
        any_letter |= bool(letter.any())
        keep = letter.copy()
        keep[1:] |= letter[:-1]  # the first of a run of other characters
        keep[0] |= after_letter
        after_letter = bool(letter[-1])
        codes = np.concatenate([rest, np.where(letter, codes, 32)[keep].astype(np.uint32)])
        rest = codes[-(ORDER - 1) :]
        h = codes.copy()
        for n in range(1, ORDER + 1):
            if n > 1:
                h = (h[:-1] ^ (h[:-1] >> np.uint32(15))) * np.uint32(0x85EBCA6B) + codes[n - 1 :] * np.uint32(n)
            mixed = (h ^ (h >> np.uint32(13))) * np.uint32(0x9E3779B1)
            row[mixed >> np.uint32(32 - BUCKETS.bit_length() + 1)] = 1
    return any_letter


@dataclass
class Classifier:
    """``landmarks``: buckets by landmarks, columns of length 1; ``coefficients``: landmarks by languages."""

    languages: list[str]
    landmarks: np.ndarray
    coefficients: np.ndarray

    def kernel(self, presence: np.ndarray) -> np.ndarray:
        """Cosines of rows of 0 and 1 with the landmarks."""
        return (presence @ self.landmarks) / np.sqrt(np.maximum(presence.sum(axis=1, keepdims=True), 1))

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        if not self.languages:
            return names, scores
        for start in range(0, len(texts), BATCH):
            part = texts[start : start + BATCH]
            presence = np.zeros((len(part), BUCKETS), dtype=np.float32)
            known = [mark_presence(t, presence[i]) for i, t in enumerate(part)]
            margins = self.kernel(presence) @ self.coefficients
            best = np.argmax(margins, axis=1)
            for i in np.flatnonzero(known).tolist():
                names[start + i] = self.languages[best[i]]
                scores[start + i] = float(np.clip((margins[i, best[i]] + 1) / 2, 0, 1))
        return names, scores


def packed_presence(texts: list[str | None]) -> list[bytes | None]:
    """The presence of each text's n-grams as ``BUCKETS`` bits; null for a text without a letter."""
    out: list[bytes | None] = []
    for text in texts:
        row = np.zeros(BUCKETS, dtype=np.uint8)
        out.append(np.packbits(row).tobytes() if mark_presence(text, row) else None)
    return out


def fit(presence: list[bytes | None], languages: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Classifier:
    """From rows of ``packed_presence``; texts without a letter teach nothing. Landmarks are spread over the languages in turn."""
    rows, kept = [], []
    for bits, language in zip(presence, languages, strict=True):
        if bits is not None:
            row = np.unpackbits(np.frombuffer(bits, dtype=np.uint8)).astype(np.float32)
            rows.append(row / np.sqrt(row.sum()))
            kept.append(language)
    names = sorted(set(kept))
    if not names:
        return Classifier([], np.zeros((BUCKETS, 0), np.float32), np.zeros((0, 0), np.float32))
    x, y = np.array(rows), np.array(kept)
    by = [np.flatnonzero(y == n) for n in names]
    chosen = [own[k] for k in range(max(map(len, by))) for own in by if k < len(own)][: max(landmarks, len(names))]
    marks = x[chosen]
    k_nm, k_mm = (x @ marks.T).astype(np.float64), (marks @ marks.T).astype(np.float64)
    target = np.where(y[:, None] == np.array(names)[None, :], 1.0, -1.0)
    weight = 1 / np.array([np.sum(y == n) for n in y])[:, None]  # languages count alike
    left = k_nm.T @ (k_nm * weight) + ridge * k_mm + 1e-6 * np.eye(len(marks))
    return Classifier(names, np.ascontiguousarray(marks.T), np.linalg.solve(left, k_nm.T @ (target * weight)).astype(np.float32))


def identify_languages(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows_per_language: int = ROWS_PER_LANGUAGE) -> DataFrame:
    """(id, lang_pred, score) for every row of ``docs``.

    Learns from text and language of rows where ``train`` holds and both are there. A text that is
    null or has no letter is ``und`` with score 0, and so is every text if there is nothing to learn from.
    Null ids and repeated rows stay; other columns are ignored; an empty table gives an empty result.
    """
    labelled = docs.where(train & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.xxhash64(id_col, text_col).alias("h"))
    # A language's share of rows by their hashes, read in place; the classifier has a column per language anyway.
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    least = F.lit(0)
    if counts:
        limits = [x for lang, n in sorted(counts.items()) for x in (F.lit(lang), F.lit(int(min(1.0, rows_per_language / n) * (1 << 30))))]
        least = F.create_map(*limits)[F.col("lang")]
    sample = labelled.where(F.pmod("h", F.lit(1 << 30)) < least).dropDuplicates(["lang", "h"])

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from warpline.llm.common import text_batches

        for batch in text_batches(batches):
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(packed_presence(batch.column(2).to_pylist()), pa.binary())], names=["lang", "h", "bits"])

    # What comes to the driver has a bound by rows and bytes: ``BUCKETS`` bits a row.
    kind = labelled.schema["lang"].dataType.simpleString()
    sample = sample.select("lang", "h", "text").mapInArrow(mark, f"lang {kind}, h bigint, bits binary").orderBy("lang", "h").collect()
    shared = docs.sparkSession.sparkContext.broadcast(fit([r["bits"] for r in sample], [r["lang"] for r in sample]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from warpline.llm.common import text_batches

        own = shared.value
        for batch in text_batches(batches):
            names, scores = own.predict(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[id_col, "lang_pred", "score"])

    slim = docs.select(id_col, text_col)
    return slim.mapInArrow(run, f"{id_col} {slim.schema[id_col].dataType.simpleString()}, lang_pred string, score double")


