"""Language ID: averaged hashed subword embeddings with a linear softmax, trained in numpy.

A text's subwords are its byte n-grams (lower-cased ASCII letters and all non-ASCII bytes; other
bytes stand for one blank). Each is hashed to a row of an embedding table; a text is the average
of its rows, and a linear softmax over it gives the languages. Embeddings and weights are learned by
stochastic gradient descent. A temperature, fitted on texts kept back from the descent, calibrates
the scores. A softmax over known languages is certain of unknown ones, too, so a text has also to be made of subwords
that are frequent in one of the languages: the mean log frequency of its subwords is held against that of
the texts kept back, in units of their spread and of what a text of its length varies by. Texts farther out
than ``MARGIN`` times the farthest of those kept back are rejected, as are texts that score below a threshold, set so that at most ``REJECTED`` of
those kept back fall under it, and texts without a letter.

The model is fitted on a bounded sample (``SAMPLE`` texts of each language, chosen by a hash of
doc_id; the texts whole) and is sent to the tasks; prediction covers every whole text without a
shuffle. As embedding and weights are linear, a task multiplies them once and averages the products.

Contracts. Learned from: rows with a text, a non-null lang and ``learn`` true. lang, source and
doc_id are no inputs of a prediction. A text that is null or has no letter is ``und`` with score 0,
as is every text when there was nothing to learn from. Repeated rows give repeated results; other
columns stay where documents are filtered and are ignored in reports; empty in, empty out.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from srcatlas.llm import bytekit
from srcatlas.llm.frames import map_in_arrow, plainly

#: Texts of a language that the model is fitted on, at most.
SAMPLE = 400
#: Share of the texts kept back that may be rejected, at most.
REJECTED = 0.002
#: How much farther out than any text kept back a text may be, and how many must have been kept back for that.
MARGIN, KEPT_BACK = 2.0, 20
#: Subwords of a text that count as one, as those of a place overlap.
OVERLAP = 6
ORDERS = (2, 3, 4)
BUCKETS = 1 << 16
WIDTH = 16

_SUBWORD = np.full(256, 32, np.uint8)
_SUBWORD[97:123] = np.arange(97, 123)
_SUBWORD[65:91] = np.arange(97, 123)
_SUBWORD[128:] = np.arange(128, 256)
_SPREAD = np.uint32(2654435761)


@dataclass
class Model:
    languages: list[str]
    products: np.ndarray  # of embeddings and weights, one row per bucket, over the temperature
    bias: np.ndarray
    threshold: float
    familiar: np.ndarray  # log frequency of each bucket in the language that has it most
    usual: tuple[float, float, float, float]  # mean, spread of texts and of subwords, and the farthest distance allowed

    def distance(self, mean: np.ndarray, n: np.ndarray) -> np.ndarray:
        """How far below the usual the mean log frequencies of texts of n subwords are."""
        middle, between, within, _ = self.usual
        return (middle - mean) / np.sqrt(between ** 2 + within ** 2 * OVERLAP / np.maximum(n, 1))


def subwords(data: np.ndarray):
    """For each order, the bucket of the n-gram at every place."""
    mapped = _SUBWORD[data].astype(np.uint32)
    gram = mapped.copy()
    for k in range(1, max(ORDERS)):
        gram = gram[:-1] | (mapped[k:] << np.uint32(8 * k)) if len(gram) > 1 else gram[:0]
        if k + 1 in ORDERS:
            yield k + 1, ((gram * _SPREAD) ^ (gram >> np.uint32(15)) * np.uint32(0x85EBCA6B + 2 * k)) >> np.uint32(16)


def has_letter(texts: bytekit.Texts) -> np.ndarray:
    """Whether a text has a letter; only texts without ASCII letters are decoded."""
    ascii_letter = (_SUBWORD[texts.data] != 32) & (texts.data < 128)
    sums = np.zeros(len(texts.data) + 1, np.int64)
    np.cumsum(ascii_letter, out=sums[1:])
    ends = texts.starts + texts.sizes
    out = sums[ends] > sums[texts.starts]
    for i in np.flatnonzero(~out & (texts.sizes > 0)):
        out[i] = any(map(str.isalpha, texts.data[texts.starts[i]:ends[i]].tobytes().decode("utf-8", "replace")))
    return out


def _sparse(text: bytes) -> tuple[np.ndarray, np.ndarray, int]:
    """Distinct buckets of a text, their shares, and the number of subwords."""
    data = np.frombuffer(text, np.uint8)
    found = [b for _, b in subwords(data)]
    buckets, n = np.unique(np.concatenate(found) if found else np.zeros(0, np.uint32), return_counts=True)
    return buckets.astype(np.int64), n / max(1, n.sum()), int(n.sum())


def fit(rows: list[tuple[str, bytes]], rejected: float = REJECTED, epochs: int = 6, rate: float = 4.0, seed: int = 1) -> Model:
    """Descend over (lang, text) rows; every tenth text of a language is kept back for calibration."""
    languages = sorted({lang for lang, _ in rows})
    number = {lang: i for i, lang in enumerate(languages)}
    rng = np.random.default_rng(seed)
    table = rng.normal(0, 0.1, (BUCKETS, WIDTH))
    weights, bias = rng.normal(0, 0.1, (WIDTH, len(languages))), np.zeros(len(languages))
    seen: dict[str, int] = {}
    learn, back = [], []
    for lang, text in rows:
        seen[lang] = seen.get(lang, 0) + 1
        (back if seen[lang] % 10 == 0 else learn).append((number[lang], *_sparse(text)))
    steps = epochs * max(1, len(learn))
    for step in range(epochs):
        for j, i in enumerate(rng.permutation(len(learn))):
            lang, buckets, shares, _ = learn[i]
            now = rate * (1 - (step * len(learn) + j) / steps)
            mean = shares @ table[buckets]
            logits = mean @ weights + bias
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[lang] -= 1
            inner = weights @ p
            weights -= now * np.outer(mean, p)
            bias -= 0.1 * now * p
            table[buckets] -= now * len(buckets) ** 0.5 * shares[:, None] * inner
    logits = np.array([shares @ table[buckets] @ weights + bias for _, buckets, shares, _ in back] or np.zeros((0, len(languages))))
    truth = np.array([lang for lang, _, _, _ in back], int)

    def scores(t: float) -> np.ndarray:
        z = logits / t
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    temperature, threshold = 1.0, 0.0
    if len(back):
        grid = np.geomspace(0.2, 20, 60)
        temperature = float(min(grid, key=lambda t: -np.log(scores(t)[np.arange(len(truth)), truth] + 1e-12).sum()))
        threshold = float(min(0.5, np.quantile(scores(temperature).max(axis=1), rejected) * 0.75))
    familiar = _familiar(learn, len(languages))
    model = Model(languages, table @ weights / temperature, bias / temperature, threshold, familiar, (0.0, 1.0, 1.0, np.inf))
    texts = [(shares @ familiar[buckets], shares @ familiar[buckets] ** 2, n) for _, buckets, shares, n in back if n]
    if len(texts) >= KEPT_BACK:
        mean, square, n = (np.array(c) for c in zip(*texts))
        model.usual = (float(mean.mean()), float(mean.std()) + 1e-6, float(np.sqrt(np.maximum(square - mean ** 2, 0).mean())) + 1e-6, np.inf)
        model.usual = (*model.usual[:3], MARGIN * max(1.0, float(model.distance(mean, n).max())))
    return model


def _familiar(rows: list, languages: int) -> np.ndarray:
    """Log frequency of each bucket in the language that has it most, all texts of a language counting alike."""
    often = np.zeros((languages, BUCKETS))
    texts = np.zeros(languages)
    for lang, buckets, shares, _ in rows:
        often[lang, buckets] += shares
        texts[lang] += 1
    share = often / np.maximum(texts, 1)[:, None]
    return np.log(share.max(axis=0, initial=0) + 0.01 / BUCKETS)


def predict(model: Model, texts: bytekit.Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The language's number (-1: und), the score, and whether it is rejected, of each text."""
    n, k = len(texts.rows), len(model.languages)
    if not k:
        return np.full(n, -1), np.zeros(n), np.ones(n, bool)
    sums, known, counts = np.zeros((n, k)), np.zeros(n), np.zeros(n)
    for order, buckets in subwords(texts.data):
        own = np.clip(texts.sizes - order + 1, 0, None)
        some = np.flatnonzero(own)
        if not len(some):
            continue
        counts += own
        at = np.zeros(len(buckets) + 1)
        for lang in range(k):
            np.cumsum(model.products[:, lang][buckets], out=at[1:])
            sums[some, lang] += at[texts.starts[some] + own[some]] - at[texts.starts[some]]
        np.cumsum(model.familiar[buckets], out=at[1:])
        known[some] += at[texts.starts[some] + own[some]] - at[texts.starts[some]]
    logits = sums / np.maximum(counts, 1)[:, None] + model.bias
    e = np.exp(logits - logits.max(axis=1, keepdims=True))
    e /= e.sum(axis=1, keepdims=True)
    best = e.argmax(axis=1)
    score = e[np.arange(n), best]
    none = ~has_letter(texts)
    best[none], score[none] = -1, 0.0
    far = (counts > 0) & (model.distance(known / np.maximum(counts, 1), counts) > model.usual[3])
    return best, score, none | far | (score < model.threshold)


def train(docs: DataFrame, learn: Column, sample: int = SAMPLE) -> Model:
    """Count the rows of each language, take those with the smallest hashes, and fit.

    The driver gets one count per language and about ``sample`` whole texts of each.
    """
    usable = docs.where(learn & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["count"] for r in usable.groupBy("lang").count().collect()}
    if not counts:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros(0), 0.0, np.zeros(BUCKETS), (0.0, 1.0, 1.0, np.inf))
    key = F.xxhash64("doc_id", F.lit(17))
    parts = [(F.col("lang") == lang) & (F.pmod(key, F.lit(1 << 20)) < int(min(1.0, 1.2 * sample / n) * (1 << 20)) + 1) for lang, n in counts.items()]
    chosen = parts[0]
    for part in parts[1:]:
        chosen = chosen | part
    rows = usable.where(chosen).select("lang", F.col("text").cast("string").cast("binary").alias("text"), key.alias("key")).collect()
    taken: dict[str, int] = {}
    out = []
    for r in sorted(rows, key=lambda r: (r["lang"], r["key"], bytes(r["text"]))):
        taken[r["lang"]] = taken.get(r["lang"], 0) + 1
        if taken[r["lang"]] <= sample:
            out.append((r["lang"], bytes(r["text"])))
    return fit(out)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """Adds lang_pred, score and rejected to every document."""
    results = StructType([StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("rejected", BooleanType())])
    kept = [f for f in docs.schema.fields if f.name not in results.fieldNames()]
    names = [f.name for f in kept]
    schema = StructType([*kept, *results.fields])
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = sent.value
        languages = np.array([*m.languages, "und"], object)
        for batch in batches:
            for texts in bytekit.chunks(batch.column(names.index("text"))):
                best, score, rejected = predict(m, texts)
                part = batch.slice(int(texts.rows[0]), len(texts.rows))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(languages[best], pa.string()), pa.array(score), pa.array(rejected)], schema.fieldNames())

    return map_in_arrow(docs.select(*(F.col(f"`{n.replace('`', '``')}`") for n in names)), run, schema)


def held_out() -> Column:
    """True where crc32 of the doc_id as text leaves 2 modulo 4; a null doc_id counts as held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(True))


def report(docs: DataFrame) -> DataFrame:
    docs = docs.select("doc_id", "lang", F.col("text").cast("string").alias("text"))
    model = train(docs, ~held_out())
    out = identify(docs.drop("lang"), model)
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")


def accepted(docs: DataFrame) -> DataFrame:
    """The documents that the model does not reject, all columns as they are."""
    model = train(docs, ~held_out())
    packed = lambda plain: identify(plain, model).where(~F.col("rejected"))
    return plainly(docs.withColumn("text", F.col("text").cast("string")), ("doc_id", "text"), packed)
