"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

Every word is the bag of its character 4- and 5-grams (with word ends marked) and of itself,
hashed into a table of vectors. A word's vector is the mean of its bag, a text's is the
mean of its words' vectors, weighted by 1 + ln(count), and a linear softmax gives two probabilities. All three are
trained together by Adam on whole texts. As all of it is linear, scoring needs one number
a word, which workers keep; a misspelling that was never seen shares most of its n-grams
with the word it stands for. Runs of over PIECE characters (scripts without blanks, glued texts) are
read as pieces that overlap, so that every n-gram of them is in one.

The classifier is fitted on at most MAX_TRAIN labelled rows, taken in the order of a hash
of doc_id; that bound is this operator's documented parameter.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import prepare, records, table, text_rows, written

MAX_TRAIN, BUCKETS, DIM, STEPS, BATCH, SEED = 12_000, 1 << 19, 4, 1500, 32, 7
#: Words of fewer labelled texts, or of a smaller share of them, aren't trained on. A mean is multiplied by SCALE before the softmax, as few of a text's words matter; it also counts PAD neutral words, so that a few words alone decide little. KEEP: share of a text's words in each step. DECAY: of vectors in each step, times the rate.
MIN_DF, MIN_SHARE, SCALE, PAD, KEEP, DECAY, RATE = 5, 0.001, 30.0, 80, 0.5, 0.1, 0.03
THRESHOLD = 0.7
GRAMS = (4, 5)
#: Characters of a piece of a long word.
PIECE = 40
WORD = re.compile(r"[^\W_]+", re.UNICODE)
#: Files of learned texts, at most: max_train rows need no more, however many partitions there are.
BAGS = 12
#: Words kept per worker with their logit.
KEPT = 400_000


def words_of(text: str) -> list[str]:
    found = WORD.findall(text.lower())
    return found if max(map(len, found), default=0) <= PIECE else [p for w in found for p in pieces(w)]


def pieces(word: str) -> list[str]:
    """A word of over PIECE characters as pieces that share max(GRAMS) - 1 characters; an underscore marks ends where the word goes on."""
    if len(word) <= PIECE:
        return [word]
    over = max(GRAMS) - 1
    starts = range(0, len(word) - over, PIECE - over)
    return [("_" if a else "") + word[a : a + PIECE] + ("_" if a + PIECE < len(word) else "") for a in starts]


def bag(word: str, buckets: int = BUCKETS) -> list[int]:
    """The buckets of a word or piece: itself, twice, and its n-grams. crc32 is the same in every worker."""
    w = f"<{word}>".replace("<_", "").replace("_>", "")
    grams = [w, w] + [w[i : i + n] for n in GRAMS for i in range(len(w) - n + 1)]
    return [zlib.crc32(g.encode()) % buckets for g in grams]


def damped(count: float) -> float:
    """Weight of a word that occurs so often: repeated lines shouldn't decide by themselves."""
    return 1 + math.log(count)


@dataclass
class Model:
    """table: vectors of the buckets; weight, bias: the softmax; both reduced to one logit a bucket."""

    table: np.ndarray
    weight: np.ndarray
    bias: np.ndarray

    def logits(self) -> tuple[np.ndarray, float]:
        d = self.weight[1] - self.weight[0]
        return (self.table @ d).astype(np.float32), float(self.bias[1] - self.bias[0])


@dataclass
class Fitted:
    """What scoring needs of a Model: one logit a bucket, and the bias."""

    logit: np.ndarray
    bias: float

    def logits(self) -> tuple[np.ndarray, float]:
        return self.logit, self.bias


def fit(vocab: list[str], docs: list[tuple[np.ndarray, np.ndarray]], labels: list[int], buckets: int = BUCKETS, dim: int = DIM, steps: int = STEPS, seed: int = SEED) -> Model:
    """Trains table and softmax jointly. docs: of each text the positions of its words in vocab, and their shares of the mean. Texts without such words teach the bias. One class or no rows: a model that knows its bias alone."""
    rng = np.random.default_rng(seed)
    y = np.asarray(labels, np.int64)
    E = np.zeros((buckets, dim), np.float32)  # what no step touches stays neutral
    W, b = np.zeros((2, dim), np.float32), np.zeros(2, np.float32)
    if len(y) == 0 or y.min() == y.max():
        b[1] = 0.0 if len(y) == 0 else (6.0 if y[0] else -6.0)
        return Model(E, W, b)
    flat = [bag(w, buckets) for w in vocab]
    size = np.array([len(f) for f in flat], np.int64)
    sub = np.concatenate([np.array(f, np.int64) for f in flat]) if flat else np.zeros(0, np.int64)
    at = np.concatenate([[0], np.cumsum(size)])
    docs = [(np.asarray(i, np.int64), np.asarray(p, np.float32) * SCALE) for i, p in docs]
    share = np.array([(y == 0).mean(), (y == 1).mean()])
    weight_of = (0.5 / share)[y].astype(np.float32)
    m, v = np.zeros_like(E), np.zeros_like(E)
    mw, vw, mb, vb, step = np.zeros_like(W), np.zeros_like(W), np.zeros_like(b), np.zeros_like(b), 0
    W += rng.normal(0, 0.3, W.shape).astype(np.float32)
    firsts = lambda x: np.flatnonzero(np.diff(x, prepend=-1))  # noqa: E731 - where each number of an ascending row begins
    while step < steps:
        for chunk in np.array_split(rng.permutation(len(docs)), max(1, len(docs) // BATCH)):
            step += 1
            row = np.repeat(np.arange(len(chunk)), [len(docs[i][0]) for i in chunk])
            kept = rng.random(len(row)) < KEEP
            kept[firsts(row)] = True
            row = row[kept]
            words, back = np.unique(np.concatenate([docs[i][0] for i in chunk])[kept], return_inverse=True)
            part = np.concatenate([docs[i][1] for i in chunk])[kept] / np.float32(KEEP)
            n = size[words]
            begin = np.cumsum(n) - n
            h = np.zeros((len(chunk), dim), np.float32)
            if len(words):
                s = sub[np.repeat(at[words] - begin, n) + np.arange(n.sum())]
                vec = np.add.reduceat(E[s], begin, axis=0) / n[:, None].astype(np.float32)
                h[np.unique(row)] = np.add.reduceat(vec[back] * part[:, None], firsts(row), axis=0)
            z = h @ W.T + b
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(chunk)), y[chunk]] -= 1
            g = (p * weight_of[chunk][:, None] / len(chunk)).astype(np.float32)
            gW, gb, gh = g.T @ h, g.sum(0), g @ W
            a = RATE * max(0.02, 1 - step / steps) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            if len(words):
                order = np.argsort(back, kind="stable")
                gvec = np.add.reduceat((gh[row] * part[:, None])[order], firsts(back[order]), axis=0) / n[:, None].astype(np.float32)
                order = np.argsort(s, kind="stable")
                used, first = np.unique(s[order], return_index=True)
                gE = np.add.reduceat(np.repeat(gvec, n, axis=0)[order], first, axis=0)
                m[used] = 0.9 * m[used] + 0.1 * gE
                v[used] = 0.999 * v[used] + 0.001 * gE * gE
                E[used] = E[used] * (1 - a * DECAY) - a * m[used] / (np.sqrt(v[used]) + 1e-8)
            for t, mm, vv, gg in ((W, mw, vw, gW), (b, mb, vb, gb)):
                mm *= 0.9
                mm += 0.1 * gg
                vv *= 0.999
                vv += 0.001 * gg * gg
                t -= a * mm / (np.sqrt(vv) + 1e-8)
    W *= SCALE
    return Model(E, W, b)


def held_out(doc_id: Column) -> Column:
    """crc32 of doc_id as text, mod 3, is 1; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("long").cast("string").cast("binary")) % 3 == 1, F.lit(False))


_BAG = pa.schema([("doc_id", pa.int64()), ("tie", pa.int64()), ("toxic", pa.int64()), ("words", pa.list_(pa.string())), ("shares", pa.list_(pa.float32()))])
_IDS = pa.schema([("toxic", pa.int64()), ("ids", pa.binary()), ("shares", pa.binary())])
_FITTED = pa.schema([("logit", pa.binary()), ("bias", pa.float64())])


def shares(words: list[str]) -> dict[str, float]:
    """Share of each distinct word in a text's mean."""
    weight = {w: damped(c) for w, c in Counter(words).items()}
    total = PAD + sum(weight.values())
    return {w: x / total for w, x in weight.items()}


def train(documents: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> Fitted:
    """Fits on labelled rows that are not held out. Labels with a null id or null toxic don't count; of several labels of one id the largest holds. Ids are chosen by a hash, so the sample is uniform and the same on every run, and of rows that share an id one is learned: at most max_train rows, whatever the table.

    The driver gets the words that enough texts have, and at the end one number a bucket. The fit itself runs
    in one task over the bounded sample, each text as numbers of those words, so the driver stays small
    and a lost executor only costs a retry.
    """
    spark = documents.sparkSession
    prepare(spark)
    chosen = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)

    def bags(batches):
        for b in batches:
            found = [shares(words_of(t)) for t in b.column("text").to_pylist()]
            yield records(_BAG, doc_id=b.column("doc_id"), tie=b.column("tie"), toxic=b.column("toxic"), words=[list(x) for x in found], shares=[list(x.values()) for x in found])

    # max_train rows of two numbers: broadcast, so that texts don't move
    texts = text_rows(documents, F.xxhash64(F.coalesce("text", F.lit(""))).alias("tie")).join(F.broadcast(chosen), "doc_id")
    each = texts.mapInArrow(bags, "doc_id long, tie long, toxic long, words array<string>, shares array<float>")
    # an id may have any number of rows; the one whose text has the least hash is learned
    one = each.groupBy("doc_id").agg(F.min_by(F.struct("toxic", "words", "shares"), "tie").alias("x"))
    rows = written(one.select("x.toxic", "x.words", "x.shares").coalesce(BAGS), "bags")
    least = max(MIN_DF, MIN_SHARE * rows.count())
    vocab = [r.w for r in rows.select(F.explode("words").alias("w")).groupBy("w").agg(F.count("*").alias("n")).where(F.col("n") >= least).orderBy("w").select("w").collect()]
    shared = spark.sparkContext.broadcast(vocab)

    def number(batches):
        known = {w: i for i, w in enumerate(shared.value)}
        for b in batches:
            ids, part = [], []
            for ws, ps in zip(b.column("words").to_pylist(), b.column("shares").to_pylist()):
                both = [(known[w], p) for w, p in zip(ws, ps) if w in known]
                ids.append(np.array([i for i, _ in both], "<i4").tobytes())
                part.append(np.array([p for _, p in both], "<f4").tobytes())
            yield records(_IDS, toxic=b.column("toxic"), ids=ids, shares=part)

    def learn(batches):
        got = sorted((t, i, p) for b in batches for t, i, p in zip(*(b.column(c).to_pylist() for c in _IDS.names)))
        docs = [(np.frombuffer(i, "<i4"), np.frombuffer(p, "<f4")) for _, i, p in got]
        logit, bias = fit(shared.value, docs, [t for t, _, _ in got]).logits()
        yield records(_FITTED, logit=[logit.astype("<f4").tobytes()], bias=[bias])

    # max_train rows at most come together here
    fitted = written(rows.mapInArrow(number, "toxic long, ids binary, shares binary").repartition(1).mapInArrow(learn, "logit binary, bias double"), "fitted").first()
    shared.unpersist()
    return Fitted(np.frombuffer(bytes(fitted.logit), "<f4"), fitted.bias) if fitted else Fitted(np.zeros(BUCKETS, np.float32), 0.0)


def score(documents: DataFrame, model: Model | Fitted) -> DataFrame:
    """documents with the column score (the first free name of score, score_, ...) added; other columns pass through.

    Every whole text counts, in a mean over all its words. A text without words (null and
    empty ones too) gets the softmax of the bias alone, at most 0.5. Repeated rows get equal scores.
    """
    prepare(documents.sparkSession)
    logit, bias = model.logits()  # BUCKETS numbers: 2 MB
    shared = documents.sparkSession.sparkContext.broadcast((logit, min(bias, 0.0), bias))  # BUCKETS numbers

    @F.pandas_udf("double")
    def scores(parts):
        import pandas as pd

        table_, empty, b0 = shared.value
        known = scores_cache()

        def of(text):
            words = words_of(text) if text else []
            if not words:
                return 1 / (1 + np.exp(-empty))
            if len(known) > KEPT:
                known.clear()
            total, weights = 0.0, float(PAD)
            for w, c in Counter(words).items():
                x = known.get(w)
                if x is None:
                    x = known[w] = float(table_[bag(w, len(table_))].mean())
                c = damped(c)
                total += c * x
                weights += c
            return float(1 / (1 + np.exp(-(total / weights + b0))))

        return pd.Series([of(t) for t in parts], dtype="float64")

    cache: dict = {}

    def scores_cache():
        return cache

    from .common import free_name

    return documents.withColumn(free_name(documents, "score"), scores(F.col("text")))


def toxicity(spark: SparkSession, documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row of documents; predicted is 1 where score >= threshold."""
    model = train(documents, labels)
    out = score(text_rows(documents), model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
