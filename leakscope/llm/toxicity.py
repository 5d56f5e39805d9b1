"""Toxicity by compression distance: zstandard dictionaries of toxic and of ordinary text.

A window (a word between its blanks; longer words are cut into several) is compressed with each
dictionary. If the toxic one makes it shorter, the window is like toxic text. A document's score
is a calibrated function of how many of its windows are shorter by how many bytes.

zstandard trains both dictionaries on windows of three quarters of a bounded sample of labelled
rows. A label marks a document, and most windows of a toxic one are ordinary. So the toxic dictionary is
trained in rounds: the toxic documents are dealt into folds, each fold's windows are compressed
with a dictionary trained on the other folds, and only windows that it makes shorter than the
ordinary one does, by some bytes, are in the next round's samples. What a single document holds is
never in the dictionary it is judged by, so only what toxic documents share remains. The other
quarter of the sample calibrates the thresholds.
"""

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leakscope.llm import tokens
from leakscope.llm.common import mapped

# Labelled documents used at most: toxic, ordinary; and characters of a text among them at most,
# from so many places of a longer one.
SAMPLE = (4000, 8000)
SAMPLE_CHARS = 20_000
SAMPLE_PLACES = 10

# Bytes of the dictionaries at most, and the windows of ordinary documents, evenly spaced among all
# of the sample's, that the ordinary one is trained on at most.
TOXIC_BYTES = 32_768
ORDINARY_BYTES = 110_000
ORDINARY_WINDOWS = 100_000
# Parameters of zstandard's trainer: bytes of a segment, bytes of what is counted in it.
SEGMENT, UNIT = 32, 6

# Rounds and folds in which windows of toxic documents are chosen, and the bytes by which the toxic
# dictionary must make a chosen one shorter.
ROUNDS = 5
FOLDS = 4
CHOSEN_GAIN = 3

# Each so many-th labelled document of a class calibrates the thresholds, the others train.
CALIBRATING = 4

WINDOW = 48
# Windows of a longer word overlap by so many characters.
OVERLAP = 8
STRIDE = WINDOW - OVERLAP
LEVEL = 9
# zstandard finds no match in the last bytes of its input; this tail, at the end of both
# dictionaries, stands there instead of the word's.
TAIL = b"!Fk6[&Kp;`+Pu@e0Uz%Ej5Zo*Jy:_/Oi?d.Tn4Ys"
STEPS = range(-4, 16)
KEPT = 150_000

_WORDS = re.compile(r"\S+")


def windows(text: str) -> list[str]:
    found = _WORDS.findall(text.lower())
    if any(len(w) > WINDOW for w in found):
        found = [w[a : a + WINDOW] for w in found
                 for a in range(0, max(1, len(w) - OVERLAP), STRIDE)]
    return found


def _data(window: str) -> bytes:
    return f" {window} ".encode(errors="replace")


def _trained(samples: list[bytes], size: int) -> bytes:
    """A dictionary of at most `size` bytes; the samples themselves where they are too few."""
    total = sum(map(len, samples))
    try:
        return zstandard.train_dictionary(
            min(size, max(1024, total)), samples, k=SEGMENT, d=UNIT, level=LEVEL).as_bytes()
    except zstandard.ZstdError:  # too little to train on
        return b"".join(samples)[-size:]


def _compressor(content: bytes):
    """Length of a window compressed with a dictionary of this content."""
    held = zstandard.ZstdCompressionDict(
        content + TAIL, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    held.precompute_compress(level=LEVEL)
    compress = zstandard.ZstdCompressor(
        dict_data=held, compression_params=zstandard.ZstdCompressionParameters.from_level(
            LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False,
            format=zstandard.FORMAT_ZSTD1_MAGICLESS)).compress
    return lambda data: len(compress(data + TAIL))


def _chosen(own: list[list[bytes]], kept: list[list[bytes]], ordinary: dict) -> list[list[bytes]]:
    """The windows of each toxic document that a dictionary of the other folds makes shorter.

    `own` has all windows of the documents, `kept` those chosen before, `ordinary` the lengths with
    the ordinary dictionary.
    """
    out = [[] for _ in own]
    for fold in range(FOLDS):
        length = _compressor(_trained(
            [w for i, ws in enumerate(kept) if i % FOLDS != fold for w in ws], TOXIC_BYTES))
        gains = {}
        for i in range(fold, len(own), FOLDS):
            for w in own[i]:
                if w not in gains:
                    gains[w] = ordinary[w] - length(w)
            out[i] = [w for w in own[i] if gains[w] >= CHOSEN_GAIN]
    return out


def _dictionaries(texts: list[str], toxic: list[int]) -> tuple[bytes, bytes]:
    """Contents of the toxic and of the ordinary dictionary."""
    plain = [_data(w) for text, y in zip(texts, toxic) if not y for w in windows(text)]
    plain = plain[:: -(-len(plain) // ORDINARY_WINDOWS) or 1]
    ordinary = _trained(plain, ORDINARY_BYTES)
    own = [[_data(w) for w in dict.fromkeys(windows(text))]
           for text, y in zip(texts, toxic) if y]
    length = _compressor(ordinary)
    lengths = {w: length(w) for w in {w for ws in own for w in ws}}
    kept = own
    for _ in range(ROUNDS):
        kept = _chosen(own, kept, lengths)
    return _trained([w for ws in kept for w in ws], TOXIC_BYTES), ordinary


@dataclass
class Model:
    """Two dictionaries, and the weights of the window counts."""

    toxic: bytes
    ordinary: bytes
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def scorer(self):
        return Scorer(self)


class Scorer:
    """A model with its compressors; differences of window lengths are kept for later texts."""

    def __init__(self, model: Model):
        self.model, self.known = model, {}
        self.ordinary, self.toxic = _compressor(model.ordinary), _compressor(model.toxic)

    def _gain(self, word: str) -> int:
        """Bytes by which the toxic dictionary makes the window shorter."""
        data = _data(word)
        return self.ordinary(data) - self.toxic(data)

    def features(self, text: str) -> np.ndarray:
        known, found = self.known, Counter(windows(text))
        if len(known) > KEPT:
            known.clear()
        gains = Counter()
        for w, n in found.items():
            g = known.get(w)
            if g is None:
                g = known[w] = self._gain(w)
            gains[g] += n
        counts = np.array([sum(n for g, n in gains.items() if g >= k) for k in STEPS], float)
        return np.concatenate([
            [1.0, max(gains, default=0)], np.log1p(counts),
            counts / max(1, sum(gains.values()))])

    def scores(self, texts: list[str]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        m = self.model
        x = (np.array([self.features(t) for t in texts]) - m.mean) / m.scale
        return 1 / (1 + np.exp(-np.clip(x @ m.weights, -30, 30)))


def fit_texts(texts: list[str], toxic: list[int], share: float | None = None) -> Model:
    """A model of labelled texts; `share` is the part of toxic ones where it will be used."""
    if not texts:
        texts, toxic = [""], [0]
    one = np.array(toxic)
    # dealt within each class, so that both parts hold both
    place = np.where(one == 1, np.cumsum(one), np.cumsum(1 - one))
    first = place % CALIBRATING != 0
    content = _dictionaries([t for t, f in zip(texts, first) if f],
                            [y for y, f in zip(toxic, first) if f])
    blank = Model(*content, 0.0, 1.0, np.zeros(2 + 2 * len(STEPS)))
    scorer = Scorer(blank)
    rest = [t for t, f in zip(texts, first) if not f] or texts
    y = one[~first] if (~first).any() else one
    x = np.array([scorer.features(t) for t in rest])
    mean, scale = x.mean(0), x.std(0) + 1e-9
    mean[0], scale[0] = 0.0, 1.0
    x = (x - mean) / scale
    own = y.mean()
    share = own if share is None else share
    weight = np.where(y == 1, share / max(own, 1e-9), (1 - share) / max(1 - own, 1e-9))
    w, ridge = np.zeros(x.shape[1]), np.full(x.shape[1], 0.1)
    ridge[0] = 1e-3
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(ridge + 1e-9)
        w = w - np.linalg.solve(h, x.T @ (weight * (p - y)) + ridge * w)
    return Model(*content, mean, scale, w)


def held_out(doc_id: Column) -> Column:
    """Whether a document's label is kept from learning: crc32 of its id modulo 5 is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample: tuple[int, int] = SAMPLE,
        chars: int = SAMPLE_CHARS) -> Model:
    """The model of at most `sample` toxic and ordinary labelled documents, by a fixed hash order.

    Labels of held-out documents are not read. Of a text longer than `chars` the fit sees stretches
    of as many characters in all, evenly spaced (scores always use whole texts). Of equal doc_ids
    with several labels or texts the largest label and the smallest text count. The sample, at most
    12,000 such texts by default, is the only thing that reaches the driver.
    """
    piece = chars // SAMPLE_PLACES
    step = F.call_function(
        "div", F.length("text") - piece, F.lit(max(1, SAMPLE_PLACES - 1))).cast("int")
    short = F.when(F.length("text") <= chars, F.col("text")).otherwise(F.concat_ws(
        " ", *[F.substring("text", step * i + 1, F.lit(piece)) for i in range(SAMPLE_PLACES)]))
    known = (
        labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
        .where(~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    )
    total = known.agg(F.count("*").alias("n"), F.avg("toxic").alias("share")).first()
    picked = None
    for y, n in ((1, sample[0]), (0, sample[1])):
        part = known.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
        picked = part if picked is None else picked.union(part)
    picked = picked.select(F.col("doc_id").alias("labelled_id"), "toxic")
    rows = (
        docs.select("doc_id", F.col("text").cast("string").alias("text"))
        .where(F.col("text").isNotNull())
        .join(F.broadcast(picked), F.col("doc_id") == F.col("labelled_id"))
        .select("doc_id", "toxic", short.alias("text"))
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("text").alias("text"))
        .collect()
    )
    rows.sort(key=lambda r: r["doc_id"])
    return fit_texts([r["text"] for r in rows], [int(r["toxic"]) for r in rows],
                     float(total["share"]) if total["n"] else None)


def _texts(batch: pa.RecordBatch, at: int) -> list[str]:
    return [t or "" for t in batch.column(at).to_pylist()]


def toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of `docs` (columns doc_id, text).

    score (0 to 1) uses the text alone, all of it. A null text is scored as an empty one: no
    window, so the score of a document in which nothing tells. A null doc_id is not held out.
    Texts are scored whole, however long; repeated rows are scored each, equal texts alike; other
    columns are ignored; an empty table gives no rows.
    """
    def run(batches):
        own = model.scorer()
        for (ids, out), texts in tokens.parts(batches):
            s = own.scores(texts)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(out, pa.bool_()), pa.array(s),
                 pa.array((s >= 0.5).astype(np.int32))],
                names=["doc_id", "held_out", "score", "predicted"])

    columns = docs.select(
        F.col("doc_id").cast("long"), held_out(F.col("doc_id")).alias("held_out"),
        F.col("text").cast("string"))
    return mapped(columns, run, "doc_id long, held_out boolean, score double, predicted int")


def without_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of `docs` that are not predicted toxic, with all their columns."""
    at = docs.columns.index("text")

    def run(batches):
        own = model.scorer()
        for batch in batches:
            if batch.num_rows:
                yield batch.filter(pa.array(own.scores(_texts(batch, at)) < 0.5))

    return mapped(docs, run, docs.schema)
