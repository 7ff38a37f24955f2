"""Toxicity by compression distance: windows under a toxic and an ordinary zstandard dictionary."""

from __future__ import annotations

import math
import random
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.llm.common import held_out, only, remember

#: Bounds of the training sample: documents of each label, of any length.
TOXIC_DOCS, ORDINARY_DOCS = 2_500, 5_000
#: Bounds of the ordinary dictionary's training sample: texts of the first, and pieces of each, of ``WINDOW`` bytes.
DICTIONARY_DOCS, DICTIONARY_PIECES = 1_500, 32
#: Bytes of a trained toxic dictionary and of the trainer's samples; substring and segment lengths of the trainings.
TRAINED_BYTES, SAMPLE, TRAININGS = 64 << 10, 256, ((6, 24), (8, 16))
#: Bytes of the dictionaries' parts, and of the substrings that tell toxic words.
TOXIC_BYTES, COMMON_BYTES, GRAMS = 8_192, 3_072, (5, 7, 8, 9)
#: A substring of the shortest length is toxic if it is this many times as frequent in toxic texts, in so many of them.
RATIO, LEAST = 20.0, 5
#: A longer one, which ordinary syllables may form by chance, must be in a share of the toxic texts too.
LONG_RATIO, LONG_SHARE = 20.0, 0.03
#: Largest share of ordinary calibration texts of each length that the threshold may call toxic.
FALSE_ALARMS = 0.005
#: Largest length class that is filled up with joined texts; thresholds of longer ones go on with the mean rise of a class.
JOINED_CLASS = 16
#: Bytes of a window's text (a longer word gives several) and words whose result a worker remembers.
WINDOW, CACHE_WORDS = 64, 400_000


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words between white space."""
    return (text or "").lower().encode("utf-8", "surrogatepass").split()


def length_class(number: int) -> int:
    """Class of a text by its number of distinct words; each spans a doubling."""
    return number.bit_length()


def _framed(word: bytes) -> bytes:
    return b" " + word.strip(b".,;:!?\"'()") + b" "


def _grams(word: bytes) -> set[bytes]:
    return _parts(_framed(word))


def _parts(framed: bytes) -> set[bytes]:
    return {framed[i : i + n] for n in GRAMS for i in range(len(framed) - n + 1)}


@dataclass(frozen=True)
class ToxicModel:
    """Raw contents of both dictionaries, the text that closes each window, and the calibrated weights.

    ``limits`` are the thresholds on the weighted sum of a text's gains, from length class ``first`` on; beyond
    the last one they rise by ``rise`` a class.
    """

    toxic: bytes
    ordinary: bytes
    carrier: bytes
    weights: tuple[float, ...] = ()
    limits: tuple[float, ...] = ()
    first: int = 0
    rise: float = 0.0

    def limit(self, number: int) -> float:
        """The threshold of a text of so many distinct words."""
        at = length_class(number) - self.first
        return self.limits[max(0, min(at, len(self.limits) - 1))] + self.rise * max(0, at - len(self.limits) + 1)


class WindowGain:
    """Bytes that the toxic dictionary saves over the ordinary one on a word's windows.

    A window is one word between spaces, closed by a text that both dictionaries hold: the compressor
    looks for no match in the last bytes of its input, and the closing keeps small blocks compressible.
    """

    def __init__(self, model: ToxicModel) -> None:
        params = zstandard.ZstdCompressionParameters(
            format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=False, write_checksum=False, write_dict_id=False,
            window_log=15, hash_log=16, chain_log=16, search_log=4, min_match=5, target_length=8, strategy=zstandard.STRATEGY_GREEDY,
        )
        pair = []
        for content in (model.ordinary, model.toxic):
            dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            dictionary.precompute_compress(compression_params=params)
            pair.append(zstandard.ZstdCompressor(dict_data=dictionary, compression_params=params).compress)
        self.ordinary, self.toxic = pair
        self.carrier, self.known = model.carrier, {}

    def of(self, word: bytes) -> int:
        gain = self.known.get(word)
        if gain is None:
            framed = b" " + word + b" "
            cuts = [framed] if len(framed) <= WINDOW else [framed[i : i + WINDOW] for i in range(0, len(framed), WINDOW - 16)]
            gain = max(len(self.ordinary(c + self.carrier)) - len(self.toxic(c + self.carrier)) for c in cuts)
            if len(self.known) < CACHE_WORDS and len(word) <= 40:
                self.known[word] = gain
        return gain

    def features(self, words: set[bytes]) -> list[float]:
        """The three largest gains of a text's distinct words, and how many gain two bytes or more."""
        gains = sorted((max(g, 0) for g in map(self.of, words)), reverse=True)
        number = sum(g >= 2 for g in gains)
        return [*gains[:3], *[0] * (3 - len(gains[:3])), math.log1p(number), 10 * number / (10 + len(gains))]

    def score(self, text: str | None, model: ToxicModel) -> float:
        """From 0 to 1; at least 0.5 if the weighted gains reach the threshold of the text's length."""
        words = set(words_of(text))
        over = sum(w * f for w, f in zip(model.weights, self.features(words), strict=True)) - model.limit(len(words))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, over))))


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights, then the intercept, of a logistic regression with a small ridge, classes weighted alike."""
    wide = np.column_stack([x, np.ones(len(x))])
    share = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
    w = np.zeros(wide.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(wide @ w, -30, 30)))
        slope = wide.T @ (share * (y - p)) - 0.5 * w
        curve = (wide * (share * p * (1 - p))[:, None]).T @ wide + 0.5 * np.eye(len(w))
        w = w + np.clip(np.linalg.solve(curve, slope), -2, 2)
    return w


def _toxic_segments(toxic: list[str], ordinary: list[str]) -> list[bytes]:
    """Stretches of dictionaries trained on toxic texts that these texts hold far more often than ordinary ones.

    What both classes hold alike would only add noise to the lengths. Of substrings that tell, only those count that hold no shorter one, so no ordinary ending is learned with a stem.
    """
    counts = []
    for texts in (toxic, ordinary):
        by_word: Counter[bytes] = Counter()
        for text in texts:
            by_word.update(set(words_of(text)))
        counts.append(by_word)
    here: Counter[bytes] = Counter()
    for word, n in counts[0].items():
        for gram in _grams(word):
            here[gram] += n
    there: Counter[bytes] = Counter()
    for word, n in counts[1].items():
        for gram in _grams(word):
            if gram in here:
                there[gram] += n
    scale = (len(toxic) + 1) / (len(ordinary) + 1)
    short, most = GRAMS[0], max(LEAST, LONG_SHARE * len(toxic))
    marked = {g: n for g, n in here.items() if n >= (LEAST if len(g) == short else most) and n + 0.5 > (RATIO if len(g) == short else LONG_RATIO) * scale * (there[g] + 0.5)}
    for gram in sorted(marked, key=len, reverse=True):
        if any(gram[i : i + n] in marked for n in GRAMS if n < len(gram) for i in range(len(gram) - n + 1)):
            del marked[gram]
    return _telling(_trained(toxic), marked)


def _trained(texts: list[str]) -> list[bytes]:
    """Contents of dictionaries that zstandard trains on the words of texts, one for each of ``TRAININGS``.

    Samples are pieces of a text's distinct words, framed by spaces, in a fixed random order. Where there is too little to train on, the samples are the content.
    """
    rng, samples = random.Random(5), []
    for text in texts:
        words = sorted({_framed(w) for w in words_of(text)})
        rng.shuffle(words)
        joined = b"".join(words)
        samples += [joined[i : i + SAMPLE] for i in range(0, len(joined), SAMPLE) if len(joined) - i >= 8]
    try:
        return [zstandard.train_dictionary(TRAINED_BYTES, samples, k=k, d=d, level=3).as_bytes() for d, k in TRAININGS]
    except zstandard.ZstdError:
        return [b"".join(samples)]


def _telling(contents: list[bytes], marked: dict[bytes, int]) -> list[bytes]:
    """The stretches of trained dictionaries that consist of telling substrings, each that adds one, those of most texts first."""
    runs: set[bytes] = set()
    for content in contents:
        inside = [False] * len(content)
        for length in GRAMS:
            for at in range(len(content) - length + 1):
                if content[at : at + length] in marked:
                    inside[at : at + length] = [True] * length
        at = 0
        while at < len(content):
            end = at
            while end < len(content) and inside[end]:
                end += 1
            if end > at:
                runs.add(content[at:end])
            at = end + 1
    picked, covered, size = [], set(), 0
    for run in sorted(runs, key=lambda r: (-sum(marked.get(g, 0) for g in _parts(r)), r)):
        fresh = {g for g in _parts(run) if g in marked} - covered
        if fresh and size + len(run) <= TOXIC_BYTES:
            picked.append(run)
            size, covered = size + len(run), covered | fresh
    return picked


def _joined(texts: list[set[bytes]], kind: int, number: int) -> list[set[bytes]]:
    """Up to ``number`` unions of texts that fall into length class ``kind``, which itself has too few texts."""
    rng, out = random.Random(kind), []
    short = [t for t in texts if length_class(len(t)) < kind]
    if sum(map(len, short)) < 1 << (kind - 1):
        return out
    for _ in range(2 * number):
        target, words = rng.uniform(1 << (kind - 1), 0.9 * (1 << kind)), set()
        for text in rng.sample(short, len(short)):
            if len(words) >= target:
                break
            words |= text
        if length_class(len(words)) == kind:
            out.append(words)
        if len(out) == number:
            break
    return out


def _limits(texts: list[set[bytes]], line: Callable[[set[bytes]], float], least: float) -> tuple[tuple[float, ...], int, float]:
    """Thresholds that hold the bound on false alarms in each length class, the first class, and the mean rise beyond.

    A class of fewer texts than the bound can be told from is filled up with unions of shorter ordinary texts, which
    meet as many chance gains as an ordinary text of that length; where that isn't possible the limit of all texts counts too.
    """
    bound = lambda values: sorted(values)[-1 - int(FALSE_ALARMS * len(values))] + 1e-6
    of_class: dict[int, list[float]] = {}
    for text in texts:
        of_class.setdefault(length_class(len(text)), []).append(line(text))
    every, need = max(least, bound([v for mine in of_class.values() for v in mine])), math.ceil(1 / FALSE_ALARMS)
    low, high, limits = min(of_class), max(of_class), []
    for kind in range(low, max(low, min(high, JOINED_CLASS)) + 1):
        mine = of_class.get(kind, [])
        if len(mine) < need:
            mine = mine + [line(words) for words in _joined(texts, kind, need - len(mine))]
        limits.append(max(bound(mine), least) if len(mine) >= need else max([every, *mine]))
    return tuple(limits), low, max(0.0, (limits[-1] - limits[0]) / max(1, len(limits) - 1))


def _spread(text: bytes) -> list[bytes]:
    """At most ``DICTIONARY_PIECES`` pieces of a text, evenly spread over the whole of it."""
    cuts = range(0, len(text), WINDOW)
    return [text[i : i + WINDOW] for i in cuts[:: -(-len(cuts) // DICTIONARY_PIECES) or 1] if len(text) - i >= 8]


def fit(toxic: list[str], ordinary: list[str]) -> ToxicModel | None:
    """Train both dictionaries on two thirds of the texts and calibrate the thresholds, by length class, on the rest.

    zstandard trains dictionaries on ordinary and on toxic text. The toxic side holds the ordinary one, so that both treat ordinary
    words alike, and those stretches of the trained toxic ones that toxic texts repeat and ordinary ones don't. None if
    there is nothing to learn from.
    """
    first = lambda texts: [t for i, t in enumerate(texts) if i % 3]
    rest = lambda texts: [t for i, t in enumerate(texts) if not i % 3]
    segments = _toxic_segments(first(toxic), first(ordinary)) if len(toxic) > 2 and len(ordinary) > 2 else []
    if not segments:
        return None
    samples = [piece for text in first(ordinary)[:DICTIONARY_DOCS] for piece in _spread(b" ".join(words_of(text)))]
    try:
        common = zstandard.train_dictionary(4096, samples, k=64, d=8, level=3).as_bytes()[-COMMON_BYTES:]
    except zstandard.ZstdError:
        common = b"".join(samples)[-COMMON_BYTES:]
    draft = ToxicModel(common + b"".join(reversed(segments)), common, common[-32:])
    gain = WindowGain(draft)
    bad, good = ([set(words_of(t)) for t in rest(texts)] for texts in (toxic, ordinary))
    y = np.r_[np.ones(len(bad)), np.zeros(len(good))]
    w = _logistic(np.array([gain.features(t) for t in bad + good], float), y)
    weights = tuple(map(float, w[:-1]))
    limits = _limits(good, lambda words: sum(a * b for a, b in zip(weights, gain.features(words), strict=True)), -float(w[-1]))
    return ToxicModel(draft.toxic, common, draft.carrier, weights, *limits)


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [b" ".join(dict.fromkeys(words_of(t.as_py()))).decode("utf-8", "surrogatepass") for t in batch.column(2)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["doc_id", "toxic", "text"])


def train(docs: DataFrame, labels: DataFrame) -> ToxicModel | None:
    """Fit on a bounded sample of labelled rows that aren't held out, smallest hash of doc_id first.

    At most ``TOXIC_DOCS`` and ``ORDINARY_DOCS`` ids are drawn, of documents of any length, and the distinct words of
    their whole texts are gathered in order. A doc_id with several labels is toxic if one of them is; of several texts the first in order counts.
    """
    known = only(labels, "doc_id", "toxic").where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    drawn = [known.where(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most) for label, most in ((1, TOXIC_DOCS), (0, ORDINARY_DOCS))]
    ids = drawn[0].union(drawn[1])
    rows = only(docs, "doc_id", "text").where(F.col("text").isNotNull()).join(F.broadcast(ids), "doc_id")
    once = rows.groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("text").alias("text"))
    words = once.select(F.col("doc_id").cast("long"), F.col("toxic").cast("int"), "text").mapInArrow(_distinct, "doc_id long, toxic int, text string")
    texts = sorted((r.doc_id, r.toxic, r.text) for r in words.collect())
    mix = sorted(texts, key=lambda r: hash_order(r[0]))
    return fit([t for _, x, t in mix if x == 1], [t for _, x, t in mix if x == 0])


def hash_order(key: int) -> int:
    """A fixed scramble of ids, so that the split for calibration follows no order of the table."""
    return (int(key) * 0x9E3779B97F4A7C15 + 0x7F4A7C15) % (1 << 61)


def window_gain(model: ToxicModel) -> WindowGain:
    """The model's compressors of this worker process with what they remember, kept from task to task."""
    return remember(("gain", model), lambda: WindowGain(model))


def _score(batches: Iterator[pa.RecordBatch], model: ToxicModel | None) -> Iterator[pa.RecordBatch]:
    gain = window_gain(model) if model else None
    for batch in batches:
        scores = []
        for text in batch.column(1):
            if gain is None:
                scores.append(0.0)
                continue
            scores.append(gain.score(text.as_py(), model))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])


def score_toxicity(docs: DataFrame, labels: DataFrame, model: ToxicModel | None = None) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    Each word of the whole text is a window; a text is toxic if what the toxic dictionary saves on its windows
    reaches the threshold calibrated for texts of its length. Null, empty and blank texts score near 0, and all texts score 0
    if there are no labels to learn from. A null doc_id is not held out. Extra columns are ignored; an empty table gives no rows.
    """
    model = model or train(docs, labels)
    rows = only(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(lambda it: _score(it, model), "doc_id long, score double")
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def reject_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents, with all their columns, that are not predicted toxic; the text never leaves its row."""
    model = train(docs, labels)
    schema = docs.schema
    at = docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = window_gain(model) if model else None
        for batch in batches:
            if gain is None:
                yield batch
                continue
            clean = [gain.score(t.as_py(), model) < 0.5 for t in batch.column(at)]
            yield batch.filter(pa.array(clean, pa.bool_()))

    return docs.mapInArrow(keep, schema)
