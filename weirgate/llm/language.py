"""Language identification: averaged hashed subword embeddings, a linear softmax, SGD in numpy, calibrated rejection.

Each lower-cased run of letters, with a mark before and after it, gives hashed subwords of 1 to 4 characters. A text's
vector is the mean embedding of all its subwords; a softmax over languages follows. Both layers are trained by stochastic
gradient descent on a bounded sample of labelled rows. As the mean and the layer are linear, a subword contributes a fixed
vector of logits: texts are read whole, hashed as arrays of code points and summed up, part by part.

A subword whose bucket no training text has touched says nothing: its logits are zero, so that foreign letters and words pull a
text towards chance. A second part of the sample calibrates: a temperature minimises the log loss of pieces of its texts, and a
text is rejected if its score is below the floor of its length, which keeps `keep_share` of the calibration texts' pieces of
that length, or no better than chance, or if fewer of its subwords are in touched buckets than the like floor for that share
says; texts without any letter are rejected as well. Lengths are counted in subwords and by
powers of two, as short texts are surer of nothing.

The sample has about equally many different texts of every language, chosen by a hash of the text, so that neither a rare
language nor a much copied text changes what is learnt; of a long text it has pieces from all over. Languages must be few:
one number for each reaches the driver.

Defined results: null texts, and texts without a letter, are `und` with score 0 and rejected. With no labelled row to learn
from, every text is `und`. With one language its score is always 1, and only texts without a letter are rejected. Ties go to
the first language by name. Rows with null ids are predicted but never learnt from, and not held out. Repeated rows give
repeated results. Other columns are ignored, whatever their names; only the text enters a prediction.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, map_column, text_of

#: Bounds of the sample that the classifier is fitted on: texts in all, texts that every language may have at least, and
#: characters of a text, of which a longer one gives so many pieces.
SAMPLE_ROWS, SAMPLE_LEAST, SAMPLE_CHARS, SAMPLE_PIECES = 2000, 20, 20_000, 8
BUCKETS, DIMS, EPOCHS, RATE = 1 << 17, 16, 8, 0.5
#: Words of the pieces of held-out texts that the temperature is fitted on.
CALIBRATION_WORDS = (1, 2, 4, 8, 16)
#: Share of calibration pieces of each length that stay.
KEEP_SHARE = 0.9995
#: Words of the pieces that the floors are calibrated on, beside whole texts, and pieces of each size from one text.
FLOOR_WORDS, FLOOR_PIECES = (1, 2, 4, 8, 16, 32, 64, 128), 6
#: Pieces that a length must have for a floor of its own; one with fewer is pooled with the lengths below, then above.
FLOOR_LEAST = 200

_WORD = re.compile(r"[^\W\d_]+")


#: Characters that are hashed at once.
PART = 500_000


def _grams(marked: str, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For 1 to 4 characters from each place: the bucket, and whether they lie in one word. Words stand between zeros."""
    c = np.frombuffer(marked.encode("utf-32-le"), np.uint32)
    mark = c == 0
    h, whole = np.zeros(len(c), np.uint32), np.ones(len(c), bool)
    for n in range(1, 5):
        m = len(c) - n + 1
        if m <= 0:
            return
        h = (h[:m] ^ c[n - 1 :]) * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
        if n == 1:
            yield h % np.uint32(buckets), ~mark
            continue
        if n > 2:  # a mark may come first or last only
            whole = whole[:m] & ~mark[n - 2 : n - 2 + m]
        yield h % np.uint32(buckets), whole[:m]


def subwords(text: str, buckets: int) -> np.ndarray:
    """Buckets of all subwords of a text."""
    words = _WORD.findall(text.lower())
    if not words:
        return np.zeros(0, np.int64)
    return np.concatenate([g[ok] for g, ok in _grams("\0" + "\0".join(words) + "\0", buckets)]).astype(np.int64)


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    scores: np.ndarray  # logits of each bucket, buckets x languages
    temperature: float
    touched: np.ndarray  # whether training touched the bucket
    floors: np.ndarray  # of the score, by the power of two of a text's subwords; longer texts have the last
    shares: np.ndarray  # of the share of touched subwords, likewise


def train(texts: list[str], labels: list[str], seed: int = 7, buckets=BUCKETS, dims=DIMS, epochs=EPOCHS, rate=RATE, keep_share=KEEP_SHARE) -> Model:
    """Texts without a letter are left out; every fifth text calibrates."""
    pairs = [(t, y) for t, y in zip(texts, labels) if any(map(str.isalpha, t))]
    languages = tuple(sorted({y for _, y in pairs}))
    if not languages:
        return Model((), np.zeros((buckets, 0), np.float32), 1.0, np.zeros(buckets, bool), np.zeros(1), np.zeros(1))
    rng = np.random.default_rng(seed)
    rows, y = [np.unique(subwords(t, buckets), return_counts=True) for t, _ in pairs], np.array([languages.index(y) for _, y in pairs])
    held = np.arange(len(rows)) % 5 == 4
    inside = rng.uniform(-1, 1, (buckets, dims)).astype(np.float32) / dims
    outside, bias = np.zeros((dims, len(languages)), np.float32), np.zeros(len(languages), np.float32)
    learn = np.flatnonzero(~held)
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for i in rng.permutation(learn):
            ids, counts = rows[i]
            share = (counts / counts.sum()).astype(np.float32)
            mean = share @ inside[ids]
            z = mean @ outside + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1
            back = outside @ p
            outside -= step * np.outer(mean, p)
            bias -= 0.1 * step * p
            inside[ids] -= step * len(ids) ** 0.5 * share[:, None] * back
    # The bias belongs to what was learnt: shared out over the touched buckets, it leaves a text of others at chance.
    touched = np.unique(np.concatenate([rows[i][0] for i in learn]))
    scores = np.zeros((buckets, len(languages)), np.float32)
    scores[touched] = inside[touched] @ outside + bias
    known = np.zeros(buckets, bool)
    known[touched] = True
    tune = np.flatnonzero(held) if held.any() else learn

    def logits(texts: list[str]) -> np.ndarray:
        return np.array([scores[ids].mean(0) for ids in (subwords(t, buckets) for t in texts)])

    def probability(z: np.ndarray, t: float) -> np.ndarray:
        e = np.exp((z - z.max(1, keepdims=True)) / t)
        return e / e.sum(1, keepdims=True)

    # Whole texts are nearly always right; their first words and pieces show how sure a short text can be.
    pieces = [(" ".join(found[at : at + n]), y[i]) for i in tune for found in [_WORD.findall(pairs[i][0])] for n in CALIBRATION_WORDS for at in [len(found) // 3] if found[at : at + n]]
    z, truth = logits([t for t, _ in pieces]), np.array([k for _, k in pieces])
    temperature = min((0.01 * 1.25**k for k in range(34)), key=lambda t: -np.log(probability(z, t)[np.arange(len(z)), truth] + 1e-12).mean())
    sizes, tops, shares = [], [], []
    for i in tune:
        found = _WORD.findall(pairs[i][0])
        cut = [" ".join(found[at : at + n]) for n in FLOOR_WORDS if n < len(found) for at in sorted({(len(found) - n) * k // (FLOOR_PIECES - 1) for k in range(FLOOR_PIECES)})]
        ids = [subwords(t, buckets) for t in [pairs[i][0], *cut]]
        sizes += map(len, ids)
        tops.append(probability(np.array([scores[x].mean(0) for x in ids]), temperature).max(1))
        shares += [known[x].mean() for x in ids]
    return Model(languages, scores, float(temperature), known, _floors(np.array(sizes), np.concatenate(tops), keep_share), _floors(np.array(sizes), np.array(shares), keep_share))


def _floors(sizes: np.ndarray, tops: np.ndarray, keep_share: float) -> np.ndarray:
    """For each power of two the score that keeps that share of the pieces of so many subwords."""
    power = _power(sizes)
    floors = np.zeros(int(power.max()) + 1)
    for k in range(len(floors)):
        low = high = k
        while ((power >= low) & (power <= high)).sum() < min(FLOOR_LEAST, len(power)):
            low, high = (low - 1, high) if low else (0, high + 1)
        floors[k] = np.quantile(tops[(power >= low) & (power <= high)], 1 - keep_share)
    return floors


def _power(sizes: np.ndarray) -> np.ndarray:
    return np.log2(np.maximum(sizes, 1)).astype(int)


def sample(df: DataFrame, id_col="doc_id", text_col="text", label_col="lang", rows=SAMPLE_ROWS, least=SAMPLE_LEAST, chars=SAMPLE_CHARS, pieces=SAMPLE_PIECES) -> tuple[list[str], list[str]]:
    """About rows / languages different labelled texts of each language (and `least` of each), cut to `chars` characters: two narrow passes."""
    ident, text, label = F.col(id_col).cast("string"), F.col(text_col).cast("string"), F.col(label_col).cast("string")
    eligible = df.where(label.isNotNull() & text.isNotNull() & (F.crc32(ident.cast("binary")) % 4 != 2)).select(label.alias("label"), text.alias("text"), F.xxhash64(text).alias("h"))
    there = {r.label: r.n for r in eligible.groupBy("label").agg(F.approx_count_distinct("h").alias("n")).collect()}
    if not there:
        return [], []
    quota = max(rows // len(there), least)
    limits = F.create_map(*(F.lit(x) for k, n in sorted(there.items()) for x in (k, int(min(1.0, quota / n) * (1 << 30)))))
    near = eligible.where(F.pmod(F.xxhash64("h", F.lit("sample")), F.lit(1 << 30)) < F.element_at(limits, F.col("label")))
    size = chars // pieces
    cut = F.expr(f"CASE WHEN length(text) <= {chars} THEN text ELSE array_join(transform(sequence(0, {pieces - 1}), k -> substring(text, CAST(1 + (length(text) - {size}) * k / {pieces - 1} AS INT), {size})), ' ') END")
    got = sorted((tuple(r) for r in near.groupBy("label", "h").agg(F.min("text").alias("text")).select(cut, "label").collect()), key=lambda r: (zlib.crc32(r[0].encode()), r))
    return [r[0] for r in got], [r[1] for r in got]


def fit(df: DataFrame, id_col="doc_id", text_col="text", label_col="lang") -> Model:
    return train(*sample(df, id_col, text_col, label_col))


class Predictor:
    def __init__(self, model: Model, part: int = PART) -> None:
        self.model, self.part = model, part
        self.weights = np.concatenate([model.scores, model.touched[:, None], np.ones((len(model.scores), 1))], 1).astype(np.float32)

    def _segments(self, texts: list[str | None]) -> Iterator[tuple[int, list[str]]]:
        """(text number, some of its words); the words of a long text come in several segments."""
        for i, text in enumerate(texts):
            words = _WORD.findall(text.lower()) if text and any(map(str.isalpha, text)) else []
            at = size = 0
            for k, w in enumerate(words):
                size += len(w) + 1
                if size >= self.part:
                    yield i, words[at : k + 1]
                    at, size = k + 1, 0
            if at < len(words):
                yield i, words[at:]

    def _sums(self, texts: list[str | None]) -> np.ndarray:
        """For each text the sum of its subwords' logits, the number of touched ones, and last their number."""
        out = np.zeros((len(texts), self.weights.shape[1]))
        group: list[tuple[int, str]] = []
        size = 0

        def flush() -> None:
            starts = np.cumsum([0] + [len(m) for _, m in group])
            for bucket, ok in _grams("".join(m for _, m in group) + "\0", len(self.weights)):
                values = self.weights[bucket]
                values[~ok] = 0
                # Windows from the last places of a segment that would reach past the end have no row.
                sums = np.add.reduceat(values, np.minimum(starts[:-1], len(values) - 1), axis=0, dtype=np.float64)
                np.add.at(out, [i for i, _ in group], sums)

        for i, words in self._segments(texts):
            group.append((i, "\0" + "\0".join(words)))
            size += len(group[-1][1])
            if size >= self.part:
                flush()
                group, size = [], 0
        if group:
            flush()
        return out

    def __call__(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        m = self.model
        if not m.languages:
            return [("und", 0.0, True)] * len(texts)
        found = []
        chance = 1 / len(m.languages) + 1e-9 if len(m.languages) > 1 else 0.0
        sums = self._sums(texts)
        power = _power(sums[:, -1])
        for total, floor, share in zip(sums, m.floors[np.minimum(power, len(m.floors) - 1)], m.shares[np.minimum(power, len(m.shares) - 1)]):
            if not total[-1]:
                found.append(("und", 0.0, True))
                continue
            z = total[:-2] / total[-1] / m.temperature
            p = np.exp(z - z.max())
            p /= p.sum()
            best = int(p.argmax())
            found.append((m.languages[best], float(p[best]), bool(p[best] < floor or p[best] <= chance or total[-2] < share * total[-1])))
        return found


def predict(df: DataFrame, model: Model, id_col="doc_id", text_col="text", keep=()) -> DataFrame:
    """lang_pred, score and rejected of each text, beside the id and the columns in keep. The model is bounded by its buckets."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def make():
        guess = Predictor(shared.value)

        def apply(texts):
            got = guess(texts)
            return {"lang_pred": [g[0] for g in got], "score": [g[1] for g in got], "rejected": [g[2] for g in got]}

        return apply

    out = pa.schema([("lang_pred", pa.string()), ("score", pa.float64()), ("rejected", pa.bool_())])
    return map_column(df, [F.col(id_col).cast("bigint").alias("doc_id"), *keep], text_of(df, text_col), make, out)


def keep_known(df: DataFrame, model: Model, text_col="text") -> DataFrame:
    """The input's rows without those that are rejected, under the input's column names."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    names = df.columns

    def make():
        guess = Predictor(shared.value)
        return lambda texts: {"__rejected": [g[2] for g in guess(texts)]}

    keep = [(F.col(n).cast("string") if n == text_col else F.col(n)).alias(f"__{i}") for i, n in enumerate(names)]
    judged = map_column(df, keep, names.index(text_col), make, pa.schema([("__rejected", pa.bool_())]))
    return judged.where(~F.col("__rejected")).select(*(F.col(f"__{i}").alias(n) for i, n in enumerate(names)))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    return predict(docs, fit(docs), keep=[held.alias("held_out")])
