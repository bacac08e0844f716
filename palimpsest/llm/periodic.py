"""Periodic runs of words by string synchronising sets.

At each scale t = 2, 4, 8, ... all substrings of t words of a document have exact names (a name of 2t
words is the pair of names of its halves). A position belongs to the synchronising set of a scale if the
least hash among the names that start in the t + 1 places from it on stands at the first or at the last of
them; places where t words have a period of at most t / 3 don't count. So whether a position belongs depends on
2t words only, and every stretch of 3t - 1 words has one in its first t places unless it is
highly periodic.

A run of period p in [t, 2t] and length 4p or more holds a selected position x, and x + p, with equal 2t words, is the next
selected one of that context: the pair proposes p. Highly periodic places, detected
apart from their halves' names, propose the small periods that scales from 2 on omit (p = 1), and
their own. Proposed periods are settled by comparing words, so a run is never guessed.

Names that occur once in a document can't be part of an equal pair and leave at once, so scales end
where nothing repeats; documents of one batch are named together and never share names.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import prepare, table, text_rows

#: Words are what stands between these; bytes.split() cuts at the same six.
BLANK = r"[\x20\x09-\x0D]+"
_BLANKS = " \t\n\x0b\f\r"
LEAST, EXPONENT = 6, 4
_NONE = np.uint64(2**64 - 1)


def _mixed(names: np.ndarray) -> np.ndarray:
    """Hash of each name; different names have different hashes."""
    x = names.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Scale:
    """Positions (ascending) whose t words occur again in their document, with names and the distance to the next equal ones (0: none)."""

    def __init__(self, positions: np.ndarray, keys: np.ndarray, size: int):
        order = np.argsort(keys, kind="stable")
        s = keys[order]
        same = s[1:] == s[:-1]
        again = np.zeros(len(s), bool)
        again[1:] = same
        again[:-1] |= same
        names = np.empty(len(s), np.int64)
        names[order] = np.cumsum(np.concatenate(([0], ~same))) if len(s) else []
        gaps = np.zeros(len(s), np.int64)
        gaps[order[:-1][same]] = (positions[order[1:]] - positions[order[:-1]])[same]
        keep = np.zeros(len(s), bool)
        keep[order] = again
        self.positions, self.names, self.gaps, self.size = positions[keep], names[keep], gaps[keep], size
        self.at = np.full(size, -1, np.int64)
        self.at[self.positions] = np.arange(len(self.positions))

    def name(self, positions: np.ndarray) -> np.ndarray:
        """Names at positions; -1 where words occur once or end before."""
        k = self.at[np.minimum(positions, self.size - 1)]
        out = np.where((k >= 0) & (positions < self.size), self.names[k] if len(self.names) else -1, -1)
        return out

    def doubled(self, t: int) -> _Scale:
        other = self.name(self.positions + t)
        ok = other >= 0
        return _Scale(self.positions[ok], self.names[ok] * (len(self.at) + 1) + other[ok], self.size)


def _highly_periodic(half: _Scale, scale: _Scale, t: int) -> tuple[np.ndarray, np.ndarray]:
    """Of scale's positions, whether their t words have a period of at most t / 3, and that period. half: names of t / 2 words."""
    x = scale.positions
    d = half.gaps[half.at[x]]
    ok = (d > 0) & (3 * d <= t)
    ok[ok] = half.name(x[ok] + t // 2 - d[ok]) == half.name(x[ok] + t // 2)
    return ok, d


def _selected(scale: _Scale, double: _Scale, t: int, out: np.ndarray) -> np.ndarray:
    """Of double's positions, whether they are in the synchronising set; out: highly periodic ones of scale."""
    key = np.where(out, _NONE, _mixed(scale.names))
    least, width = key, 1
    while width < t:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    k = scale.at[double.positions]  # the t + 1 places from here on all repeat, so they stand side by side
    m = np.minimum(least[k], key[k + t])
    return (m != _NONE) & ((m == key[k]) | (m == key[k + t]))


def proposed(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position, period) of pairs that may lie in runs of exponent EXPONENT. words: numbers, different in different documents."""
    scale, half, t = _Scale(np.arange(len(words)), words, len(words)), None, 1
    at, by = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    while len(scale.positions):
        out = np.zeros(len(scale.positions), bool)
        if t >= 4:
            out, d = _highly_periodic(half, scale, t)
            at.append(scale.positions[out])
            by.append(d[out])
        double = scale.doubled(t)
        if t >= 2 and len(double.positions):
            s = _selected(scale, double, t, out)
            x, names = double.positions[s], double.names[s]
            order = np.argsort(names, kind="stable")
            gap = x[order[1:]] - x[order[:-1]]
            ok = (names[order[1:]] == names[order[:-1]]) & (gap >= t) & (gap <= 2 * t)
            at.append(x[order[:-1]][ok])
            by.append(gap[ok])
        scale, half, t = double, scale, 2 * t
    return np.concatenate(at), np.concatenate(by)


def stretches(words: np.ndarray, p: int, least: int = LEAST, exponent: int = EXPONENT) -> Iterator[tuple[int, int]]:
    """(start, length) of the stretches of one document's words with period p that are long enough and can't be extended."""
    same = np.concatenate(([False], words[p:] == words[:-p], [False]))
    edge = np.flatnonzero(same[1:] != same[:-1])
    start, n = edge[::2], edge[1::2] - edge[::2] + p
    long = n >= max(least, exponent * p)
    yield from zip(start[long].tolist(), n[long].tolist())


def find_runs(docs: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """Of each document's words, the runs (start, length, period) by start, then period."""
    names: list[int] = []
    ends = []
    for ws in docs:
        ids = dict(zip(dict.fromkeys(ws), count(len(names))))
        names.extend(map(ids.__getitem__, ws))
        ends.append(len(names))
    words = np.array(names, np.int64)
    at, by = proposed(words)
    doc = np.searchsorted(ends, at, side="right")
    periods = defaultdict(set)
    for d, p in np.unique(np.stack((doc, by), 1), axis=0).tolist() if len(at) else []:
        periods[d].add(p)
    out: list[list[tuple[int, int, int]]] = [[] for _ in docs]
    for d, ps in periods.items():
        mine = words[ends[d] - len(docs[d]) : ends[d]]
        found: dict[tuple[int, int], int] = {}
        for p in sorted(ps):  # a multiple of a run's period gives the same stretch
            for x in stretches(mine, p):
                found.setdefault(x, p)
        out[d] = sorted(((s, n, p) for (s, n), p in found.items()), key=lambda r: (r[0], r[2]))
    return out


def collapsed(ws: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """Words joined by one blank, without those that a run contains after its first period."""
    if not runs:
        return b" ".join(ws)
    keep = np.ones(len(ws), bool)
    for s, n, p in runs:
        keep[s + p : s + n] = False
    return b" ".join(ws[i] for i in np.flatnonzero(keep).tolist())


#: Words of documents that are named together.
GO = 400_000


def periodic_runs(documents: DataFrame) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) of each row: runs array<struct<start, length, period>> by start, then period, and the text without repetitions.

    A run is a stretch of words with smallest period p and at least max(LEAST, EXPONENT * p) words, which no neighbour
    extends. Null and empty texts have no words, no runs and an empty text; repeated rows are each looked at; ids
    may be null and stay so; other columns, whatever their names, are left behind. One text is one row of one task.
    """
    prepare(documents.sparkSession)
    run_type = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(run_type)), ("collapsed", pa.binary())])

    def found(docs: list[list[bytes]]) -> pa.RecordBatch:
        runs = find_runs(docs)
        flat = np.array([r for rs in runs for r in rs], np.int64).reshape(-1, 3)
        structs = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], fields=list(run_type))
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum([len(r) for r in runs]))), pa.int32()), structs)
        return [pa.array([len(ws) for ws in docs], pa.int64()), lists, pa.array([collapsed(ws, r) for ws, r in zip(docs, runs)], pa.binary())]

    def run(batches):
        for b in batches:
            at, go, held = 0, [], 0
            texts = b.column("text").cast(pa.binary())
            for k in range(len(texts)):
                go.append(texts[k].as_py().split())
                held += len(go[-1])
                if held >= GO or k == len(texts) - 1:
                    yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(at, len(go)), *found(go)], schema=schema)
                    at, go, held = k + 1, [], 0

    rows = text_rows(documents).mapInArrow(run, "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed binary")
    return rows.withColumn("collapsed", F.col("collapsed").cast("string"))


def with_periods(documents: DataFrame) -> DataFrame:
    """(doc_id, text): documents in which a tenth, by a checksum of the id, repeat a part of their words up to their end."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    text = F.coalesce("text", F.lit(""))
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), h.alias("h"), F.when(h % 10 == 0, F.split(F.btrim(text, F.lit(_BLANKS)), BLANK)).alias("w"))
    n, g = F.size("w"), F.expr("h div 10")
    a = (g % n).cast("int")
    p = F.lit(1) + F.floor((n - a) / (3 + g % 8)).cast("int")
    tail = F.flatten(F.array_repeat(F.slice("w", a + 1, p), F.ceil((n - a) / p).cast("int")))
    new = F.concat_ws(" ", F.concat(F.slice("w", F.lit(1), a), F.slice(tail, F.lit(1), n - a)))
    return rows.select("doc_id", F.when((F.col("h") % 10 == 0) & (F.btrim("text", F.lit(_BLANKS)) != ""), new).otherwise(F.col("text")).alias("text"))


def _sha(c: Column) -> Column:
    return F.sha2(c.cast("binary"), 256)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = periodic_runs(with_periods(table(spark, sf_dir, "documents")))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("n"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    rows = rows.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("b"), _sha(F.array_join(lines, "")).alias("runs_sha256"), _sha(F.col("collapsed")).alias("collapsed_sha256"))
    return rows.select("doc_id", "n_runs", (-F.col("b.s")).alias("start"), F.col("b.n").alias("length"), (-F.col("b.p")).alias("period"), F.floor(1000 * F.col("b.n") / -F.col("b.p")).cast("long").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
