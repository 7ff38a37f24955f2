"""Language identification by hyperdimensional letter n-gram profiles."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.llm.common import held_out, only

#: Dimensions of a hypervector; letters of the alphabet; letters of an n-gram.
DIMENSIONS, LETTERS, GRAM = 512, 64, 3
UNKNOWN = "und"
#: N-grams whose vectors are bundled at once.
SLICE = 4_096
#: Characters coded at once.
CHUNK = 1 << 20

_codes = np.zeros(0, np.uint8)


def _code_table() -> np.ndarray:
    """Letter code of each code point: 0 for what is no letter, else 1 to LETTERS - 1 of its lower case.

    a to z have codes of their own; all other letters share the rest by a multiplicative hash.
    """
    global _codes
    if not len(_codes):
        table = np.zeros(0x110000, np.uint8)
        for point in range(0x110000):
            char = chr(point)
            if char.isalpha():
                low = ord(char.lower()[0])
                table[point] = low - 96 if 97 <= low <= 122 else 27 + (low * 2654435761 >> 7) % (LETTERS - 27)
        _codes = table
    return _codes


def gram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram numbers of a text and their counts; runs of other characters count as one border."""
    table = _code_table()
    total: np.ndarray | None = None
    tail = np.zeros(0, np.int64)
    for at in range(0, max(1, len(text)), CHUNK):
        part = text[at : at + CHUNK].encode("utf-32-le", "surrogatepass")
        code = np.concatenate([tail, table[np.frombuffer(part, np.uint32)].astype(np.int64)])
        if at == 0:
            code = np.concatenate([[0], code])
        if at + CHUNK >= len(text):
            code = np.concatenate([code, [0]])
        code = code[np.r_[True, (code[1:] != 0) | (code[:-1] != 0)]]
        n = len(code) - GRAM + 1
        if n > 0:
            gram = np.zeros(n, np.int64)
            for j in range(GRAM):
                gram = gram * LETTERS + code[j : j + n]
            ids, counts = np.unique(gram, return_counts=True)
            if total is None and len(text) <= CHUNK:
                return ids, counts
            if total is None:
                total = np.zeros(LETTERS**GRAM, np.int64)
            total[ids] += counts
        tail = code[max(0, n) :] if n > 0 else code
    if total is None:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    ids = np.flatnonzero(total)
    return ids, total[ids]


@lru_cache(maxsize=1)
def gram_vectors(seed: int = 7) -> np.ndarray:
    """The hypervector of each n-gram: its letters' random signs, permuted by position and bound by product."""
    rng = np.random.default_rng(seed)
    letter = rng.choice(np.array([-1, 1], np.int8), (LETTERS, DIMENSIONS))
    turn = rng.permutation(DIMENSIONS)
    out = letter
    for _ in range(GRAM - 1):
        out = (out[:, None, turn] * letter[None, :, :]).reshape(-1, DIMENSIONS)
    return out


def _counts_by_language(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, np.ndarray] = {}

    def rows() -> Iterator[pa.RecordBatch]:
        for lang, total in held.items():
            ids = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(ids), pa.string()), pa.array(ids, pa.int32()), pa.array(total[ids], pa.int64())], names=["lang", "gram", "n"])

    for batch in batches:
        for text, lang in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
            if lang not in held and len(held) >= 64:
                yield from rows()
                held = {}
            ids, counts = gram_counts(text.as_py())
            held.setdefault(lang, np.zeros(LETTERS**GRAM, np.int64))[ids] += counts
    yield from rows()


def bundled(ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The sum of n-gram vectors by their counts, in slices, so that a long text's vectors are never all in memory."""
    vectors = gram_vectors()
    out = np.zeros(DIMENSIONS, np.float64)
    for at in range(0, len(ids), SLICE):
        out += counts[at : at + SLICE].astype(np.float32) @ vectors[ids[at : at + SLICE]].astype(np.float32)
    return out


def _prototype(table: pa.Table) -> pa.Table:
    """The bundle of one language; it has at most as many rows as there are n-grams."""
    bundle = bundled(table.column("gram").to_numpy(), table.column("n").to_numpy().astype(np.float64))
    return pa.table({"lang": pa.array([table.column("lang")[0].as_py()], pa.string()), "bundle": pa.array([bundle.tolist()], pa.list_(pa.float64()))})


def train(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Language names and unit prototypes from all rows that aren't held out and have text and lang.

    Bundling is linear, so n-gram counts are added up by language first and each n-gram's vector
    is bundled once, in one task for each language. The driver gets one vector of ``DIMENSIONS`` for each language.
    """
    rows = only(docs, "doc_id", "text", "lang").where(~held_out(F.col("doc_id")) & F.col("text").isNotNull() & F.col("lang").isNotNull())
    counts = rows.select("text", "lang").mapInArrow(_counts_by_language, "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    made = sorted((r.lang, r.bundle) for r in counts.groupBy("lang").applyInArrow(_prototype, "lang string, bundle array<double>").collect())
    langs = [lang for lang, _ in made]
    proto = np.array([bundle for _, bundle in made], np.float64).reshape(len(langs), DIMENSIONS)
    unit = proto / np.maximum(np.linalg.norm(proto, axis=1, keepdims=True), 1e-12)
    return langs, unit


def _predict(batches: Iterator[pa.RecordBatch], langs: list[str], unit: np.ndarray) -> Iterator[pa.RecordBatch]:
    proto = unit.T
    for batch in batches:
        names, scores = [], []
        for text in batch.column(1):
            ids, counts = gram_counts(text.as_py() or "")
            if not len(ids) or not langs:
                names.append(UNKNOWN)
                scores.append(0.0)
                continue
            bundle = bundled(ids, counts)
            cosine = bundle @ proto / max(float(np.linalg.norm(bundle)), 1e-12)
            best = int(np.argmax(cosine))
            names.append(langs[best])
            scores.append(min(1.0, max(0.0, float(cosine[best]))))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray] | None = None) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score.

    A document's n-gram vectors are bundled and compared with each language's prototype by cosine; the score
    is the best cosine, not below 0. Null texts and texts without a letter are ``und`` with score 0, as is all
    if no language was learned. Ties go to the name that sorts first. A null doc_id is not held out.
    Extra columns are ignored; an empty table gives no rows.
    """
    langs, unit = model or train(docs)
    rows = only(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(lambda it: _predict(it, langs, unit), "doc_id long, lang_pred string, score double")
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
