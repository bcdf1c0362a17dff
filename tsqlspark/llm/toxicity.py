"""Operator 5, toxicity by compression distance.

Two zstandard dictionaries are trained: one on ordinary text, one on toxic spans.  A toxic
text is mostly ordinary wording, so its toxic spans are looked for by compression as well.
Training texts are dealt to two halves.  Windows of one half are compressed with the
ordinary dictionary and with the toxic dictionary of the other half; a word belongs to a
toxic span if the second shortens its window, most of the gain goes when the word is left
out, and the ordinary dictionary does not hold it.  Words, or beginnings of words, that
several texts have as such are the samples of the half's next toxic dictionary.  As no half is judged by a dictionary
that has seen it, what stands in one text only is not taken for toxic; nor is what gains
as much in ordinary windows that neither dictionary has seen.

Both final dictionaries end with the same ordinary content; before it the toxic one has
what zstandard's trainer made of the toxic spans, the other one what it made of as many
bytes of ordinary windows.  Every text is cut into windows of ``WINDOW`` words; the
differences of the compressed lengths of all its windows, and how many reach each of
``GAINS``, give statistics that a logistic model with classes of equal weight turns into a
score.  Among ``TRAINERS`` that parameter set is taken whose statistics tell apart best the
third of the training rows that the dictionaries have not seen; on that third the score's
threshold of 0.5 is put where the shares of toxic texts above and of ordinary ones below add up
to most, at least ``CLEAN`` of the ordinary ones being below.

Labels are learnt only from rows whose crc32(doc_id as text) mod 5 is not 0, and from at
most ``max_toxic`` and ``max_ordinary`` rows of these, those of the smallest hashes, and at
most ``MAX_WINDOWS`` seeded windows of each.  Scoring reads whole texts and only these.

Defined results: a null or empty text has one empty window and so the lowest statistics;
without labels of both kinds every score is the share of toxic labels, 0 if there are none; repeated rows
each get a row; an empty table gives no rows.  Other columns are not read by the query,
and kept as they are by ``drop_toxic``.
"""

from __future__ import annotations

import random
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard as zstd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import CHUNK_BYTES, small_batches, table, tidy

#: Words of a window when texts are scored, and when toxic spans are looked for.
WINDOW, SPAN_WINDOW = 10, 5
LEVEL = 6
#: Bytes of the content that both dictionaries share.
SHARED_BYTES = 1 << 15
#: (bytes of the toxic dictionary, segment and match length of the trainer, share of toxic texts that must have a span).
TRAINERS = ((2048, 16, 8, 0.016), (2048, 16, 8, 0.03), (1024, 16, 8, 0.016))
ROUNDS = 2
#: A window must lose more bytes than this share of ordinary windows do, and LEAST_GAIN of them with the word.
GAIN_QUANTILE, LEAST_GAIN = 0.9, 2
#: Bytes of the shortest beginning of a word that counts as a span by itself.
STEM = 6
#: How many times as often a span must be found in toxic texts as in ordinary windows for each ordinary text.
RATIO = 20
#: Lost bytes from which windows are counted.
GAINS = (2, 4, 6, 8)
#: Least share of ordinary calibration texts below the threshold.
CLEAN = 0.92
MAX_WINDOWS = 8000
SHARED_WINDOWS, OTHER_WINDOWS = 100_000, 60_000
MAX_TOXIC, MAX_ORDINARY = 1500, 4500
SEED = 5


def words(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "surrogatepass").split()


def windows(text: str | None, size: int = WINDOW) -> list[bytes]:
    w = words(text)
    return [b" " + b" ".join(w[i : i + size]) + b" " for i in range(0, len(w), size)] or [b" "]


def halved(pieces: list[bytes]) -> list[bytes]:
    """Windows of SPAN_WINDOW words from those of WINDOW words."""
    return [x for p in pieces for x in windows(p.decode("utf-8", "surrogatepass"), SPAN_WINDOW)]


class Coder:
    """Compressed lengths under one dictionary."""

    def __init__(self, content: bytes):
        par = zstd.ZstdCompressionParameters.from_level(LEVEL, write_content_size=0, write_checksum=0, write_dict_id=0, format=zstd.FORMAT_ZSTD1_MAGICLESS)
        d = zstd.ZstdCompressionDict(content, dict_type=zstd.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(compression_params=par)
        self._many = zstd.ZstdCompressor(dict_data=d, compression_params=par).multi_compress_to_buffer

    def lengths(self, pieces: list[bytes]) -> np.ndarray:
        return np.fromiter(map(len, self._many(pieces)), dtype=np.int32, count=len(pieces))


def trained(samples: list[bytes], size: int, segment: int, match: int) -> bytes:
    """A dictionary by zstandard's trainer; empty if the samples are too few for it."""
    try:
        return zstd.train_dictionary(size, samples, k=segment, d=match, level=LEVEL).as_bytes()
    except zstd.ZstdError:
        return b""


def toxic_words(pieces: list[bytes], ordinary: Coder, toxic: Coder, cut: float, known: set[bytes]) -> list[tuple[int, bytes]]:
    """(window, word) for the words whose absence takes away the gain of the toxic dictionary."""
    gain = ordinary.lengths(pieces) - toxic.lengths(pieces)
    at, word, without = [], [], []
    for i in np.flatnonzero(gain > max(cut, 0)).tolist():
        w = pieces[i].split()
        for j, x in enumerate(w):
            if x not in known:
                at.append(i)
                word.append(x)
                without.append(b" " + b" ".join(w[:j] + w[j + 1 :]) + b" ")
    if not at:
        return []
    lost = gain[at] - (ordinary.lengths(without) - toxic.lengths(without))
    return [(i, x) for i, x, n in zip(at, word, lost.tolist(), strict=True) if n >= LEAST_GAIN]


def dictionaries(toxic: list[list[bytes]], ordinary: list[list[bytes]], size: int, segment: int, match: int, share: float) -> tuple[bytes, bytes]:
    """Contents of the toxic and of the ordinary dictionary, from the windows of each text."""
    toxic, ordinary = ([halved(t) for t in side] for side in (toxic, ordinary))
    normal, least = [w for t in ordinary for w in t], max(2, round(share * len(toxic)))
    random.Random(SEED).shuffle(normal)
    other, held = (min(OTHER_WINDOWS, len(normal) // 4) for _ in range(2))
    shared = trained(normal[other + held :][:SHARED_WINDOWS], SHARED_BYTES, 50, 8) or b"".join(normal)[-SHARED_BYTES:]
    plain = trained(normal[:other], size, segment, match)
    unseen, known = normal[other : other + held], set(shared.split(b" "))
    halves = [[(k, w) for k, t in enumerate(toxic) if k % 2 == h for w in dict.fromkeys(t)] for h in (0, 1)]
    own = [trained([w for _, w in x], 4 * size, segment, match) for x in halves]
    words_of: list[set[tuple[int, bytes]]] = [set(), set()]
    usual: set[tuple[int, bytes]] = set()
    code = Coder(plain + shared)
    base = code.lengths(unseen) if unseen else np.zeros(0, np.int32)
    for _ in range(ROUNDS):
        for h in (0, 1):
            judge = Coder(own[1 - h] + shared)
            cut = float(np.quantile(base - judge.lengths(unseen), GAIN_QUANTILE)) if unseen else 0.0
            pieces = [w for _, w in halves[h]]
            words_of[h] |= {(halves[h][i][0], x) for i, x in (toxic_words(pieces, code, judge, cut, known) if pieces else [])}
            usual |= set(toxic_words(unseen, code, judge, cut, known) if unseen else [])
        texts, often = (Counter(x for _, x in {(k, x[:n]) for k, x in of for n in range(min(STEM, len(x)), len(x) + 1)}) for of in (words_of[0] | words_of[1], usual))
        texts = {x: n for x, n in texts.items() if n >= RATIO * often[x] * len(toxic) / max(1, len(ordinary))}
        stems = [[(k, x[:n]) for k, x in sorted(words_of[h]) for n in range(len(x), min(STEM, len(x)) - 1, -1) if texts.get(x[:n], 0) >= least] for h in (0, 1)]
        samples = [[b" " + x + b" " + x + b" " for x in {(k, x[:STEM]): x for k, x in reversed(s)}.values()] for s in stems]
        own = [trained(x, size, segment, match) or y for x, y in zip(samples, own, strict=True)]
    every = samples[0] + samples[1]
    content = trained(every, size, segment, match) or b"".join(dict.fromkeys(every))[-size:]
    return content + shared, plain[: len(content)].rjust(len(content)) + shared


STATISTICS = 3 + 2 * len(GAINS)


def statistics(toxic: Coder, ordinary: Coder, texts: list[list[bytes]]) -> np.ndarray:
    """Statistics of the windows' length differences for each text, given its windows."""
    if not texts:
        return np.zeros((0, STATISTICS))
    pieces = [w for t in texts for w in t]
    diff = (ordinary.lengths(pieces) - toxic.lengths(pieces)).astype(np.float64)
    n = np.array([len(t) for t in texts], dtype=np.float64)
    starts = np.concatenate([[0], np.cumsum(n)[:-1]]).astype(np.int64)
    high = [np.add.reduceat((diff >= g).astype(np.float64), starts) for g in GAINS]
    every = [np.add.reduceat(diff, starts) / np.sqrt(n), np.maximum.reduceat(diff, starts), np.log(n)]
    return np.stack([*every, *(x for h in high for x in (np.log1p(h), h / np.sqrt(n)))], axis=1)


@dataclass
class Model:
    toxic: bytes
    ordinary: bytes
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    base: float

    def scorer(self):
        """Scores of texts; some megabytes of windows are compressed at a time."""
        if not self.toxic:
            return lambda texts: np.full(len(texts), self.base)
        a, b = Coder(self.toxic), Coder(self.ordinary)

        def some(texts):
            return logistic((statistics(a, b, [windows(t) for t in texts]) - self.mean) / self.scale, self.weights)

        def score(texts):
            out, at, size = [], 0, 0
            for i, t in enumerate(texts):
                size += len(t or "")
                if size >= CHUNK_BYTES:
                    out.append(some(texts[at : i + 1]))
                    at, size = i + 1, 0
            return np.concatenate([*out, some(texts[at:])])

        return score


def logistic(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ w[1:] + w[0], -30, 30)))


def _apart(score: np.ndarray, y: np.ndarray) -> float:
    """Share of pairs of a toxic and an ordinary text in the right order; ties count half."""
    order = np.sort(score[y == 0])
    low, high = (np.searchsorted(order, score[y == 1], side=s) for s in ("left", "right"))
    return float((low + high).mean() / 2 / max(1, len(order)))


def _weights(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression with classes of equal weight, shifted to the best threshold that leaves CLEAN of class 0 alone."""
    x1 = np.concatenate([np.ones((len(x), 1)), x], axis=1)
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    w = np.zeros(x1.shape[1])
    for _ in range(30):  # Newton steps with a small ridge
        p = logistic(x, w)
        h = x1.T @ (x1 * (weight * p * (1 - p))[:, None]) + np.eye(len(w))
        w += np.linalg.solve(h, x1.T @ (weight * (y - p)) - w)
    z = x1 @ w
    low, high, cuts = np.sort(z[y == 0]), np.sort(z[y == 1]), np.unique(z) + 1e-6
    clean = np.searchsorted(low, cuts) / len(low)
    worth = np.where(clean >= CLEAN, clean - np.searchsorted(high, cuts) / len(high), -2)
    w[0] -= float(cuts[worth.argmax()])
    return w


def fit(texts: list[str | None] | list[list[bytes]], toxic: list[int], share: float | None = None) -> Model:
    """Two thirds of the rows (texts, or their windows) make the dictionaries, the others
    choose among them and calibrate the scores.

    ``share``: of toxic rows among all training labels, where the sample has another."""
    rows = [t if isinstance(t, list) else windows(t) for t in texts]
    y = np.array(toxic, dtype=np.float64)
    base = (float(y.mean()) if len(y) else 0.0) if share is None else share
    third = np.zeros(len(y), bool)
    for kind in (0, 1):  # of either kind every third
        third[np.flatnonzero(y == kind)[2::3]] = True
    sides = [[t for t, k, held in zip(rows, toxic, third, strict=True) if k == v and not held] for v in (1, 0)]
    found: list[tuple[float, Model]] = []
    if 0 < y[third].sum() < third.sum():
        unseen, y = [t for t, h in zip(rows, third, strict=True) if h], y[third]
        for trainer in TRAINERS:
            a, b = dictionaries(*sides, *trainer)
            x = statistics(Coder(a), Coder(b), unseen)
            mean, scale = x.mean(0), x.std(0) + 1e-9
            w = _weights((x - mean) / scale, y)
            found.append((_apart(logistic((x - mean) / scale, w), y), Model(a, b, mean, scale, w, base)))
    return max(found, key=lambda f: f[0])[1] if found else Model(b"", b"", np.zeros(STATISTICS), np.ones(STATISTICS), np.zeros(STATISTICS + 1), base)


def fold(doc_id: str = "doc_id"):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5


def _sampled(batches):
    """Windows of training rows, at most ``MAX_WINDOWS`` seeded ones of each."""
    for b in batches:
        pieces = []
        for i, t in zip(b.column(0).to_pylist(), b.column(3).to_pylist(), strict=True):
            own = windows(t)
            pieces.append(own if len(own) <= MAX_WINDOWS else random.Random(i).sample(own, MAX_WINDOWS))
        yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(pieces, pa.list_(pa.binary()))], names=["o", "t", "toxic", "windows"])


def train(docs: DataFrame, labels: DataFrame, max_toxic: int = MAX_TOXIC, max_ordinary: int = MAX_ORDINARY) -> Model:
    """Fits on the bounded sample of labelled rows outside the held-out fold."""
    every = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (fold() != 0)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = F.xxhash64("doc_id", F.lit(SEED))
    known = every.filter("toxic = 1").orderBy(order, "doc_id").limit(max_toxic).union(every.filter("toxic = 0").orderBy(order, "doc_id").limit(max_ordinary))
    counts = {r["toxic"]: r["count"] for r in every.groupBy("toxic").count().collect()}
    share = counts.get(1, 0) / max(1, counts.get(0, 0) + counts.get(1, 0))
    sample = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select(order.alias("o"), F.xxhash64("text").alias("t"), "toxic", "text")
    rows = []
    for kind, most in ((1, max_toxic), (0, max_ordinary)):  # an id may have several rows
        own = sample.filter(F.col("toxic") == kind).mapInArrow(_sampled, "o long, t long, toxic int, windows array<binary>")
        rows += own.orderBy("o", "t").limit(most).collect()
    return fit([list(map(bytes, r["windows"])) for r in rows], [int(r["toxic"]) for r in rows], share)


def toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted for each document."""
    small_batches(docs.sparkSession)

    def run(batches):
        score = model.scorer()
        for b in batches:
            got = score(b.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(got, pa.float64())], names=["doc_id", "held_out", "score"])
        tidy()

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(fold() == 0, F.lit(False)).alias("held_out"), F.col("text"))
    scored = narrow.mapInArrow(run, "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def drop_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` without the rows whose score is 0.5 or more, in one pass without a shuffle."""
    small_batches(docs.sparkSession)
    at = docs.columns.index("text")

    def run(batches):
        score = model.scorer()
        for b in batches:
            yield b.filter(pa.array(score(b.column(at).to_pylist()) < 0.5, pa.bool_()))
        tidy()

    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity(docs, train(docs, table(spark, sf_dir, "labels")))
