"""Approximate nearest neighbours by learned partitions.

1. A bounded sample of SAMPLE vectors (by a hash of vec_id) is joined to its GRAPH nearest
   neighbours, and that graph is cut into PARTS parts of about equal size: seeds grow to balanced parts, then
   vertices move to the part where most of their neighbours are, as long as it has room.
2. A small network (one hidden layer, softmax) learns a vector's part. Its target is the share of
   parts among the vector's neighbours.
3. Every vector is indexed under its most probable part; a query goes to its PROBES most
   probable parts, where all vectors are reranked by the exact cosine in double precision.

A part's vectors are cut into blocks of about CHUNK, its queries into blocks of about ASKED, and each pair of blocks is a task's work, so neither a part of
many equal vectors nor one that many queries choose is a single task. Index and search see every row; only the sample is bounded.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import prepare, table, written

SAMPLE, GRAPH, PARTS, PROBES, CHUNK, ASKED, SEED = 4096, 10, 16, 12, 2048, 1024, 5


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k nearest others of each unit vector."""
    out = np.zeros((len(x), min(k, len(x) - 1)), np.int64)
    for a in range(0, len(x), 512):
        s = x[a : a + 512] @ x.T
        s[np.arange(len(s)), np.arange(a, a + len(s))] = -np.inf
        out[a : a + 512] = np.argpartition(-s, out.shape[1] - 1, axis=1)[:, : out.shape[1]]
    return out


def balanced_parts(graph: np.ndarray, parts: int, seed: int = SEED, rounds: int = 12, slack: float = 1.1) -> np.ndarray:
    """Part of each vertex: parts grow breadth-first from seeds up to an equal size, then vertices move to the part of most neighbours while it has room."""
    rng = np.random.default_rng(seed)
    n = len(graph)
    both = [set(r) for r in graph.tolist()]
    for i, r in enumerate(graph.tolist()):
        for j in r:
            both[j].add(i)
    room = int(np.ceil(n / parts * slack))
    part = np.full(n, -1)
    fronts = [[int(s)] for s in rng.choice(n, parts, replace=False)]
    size = np.zeros(parts, np.int64)
    rest = list(rng.permutation(n))
    while (part < 0).any():
        for p in np.argsort(size, kind="stable").tolist()[: max(1, parts // 2)]:
            if size[p] >= room:
                continue
            v = -1
            while fronts[p]:
                v = fronts[p].pop(0)
                if part[v] < 0:
                    break
                v = -1
            while v < 0 and rest:
                v = int(rest.pop())
                v = v if part[v] < 0 else -1
            if v >= 0:
                part[v] = p
                size[p] += 1
                fronts[p] += [w for w in both[v] if part[w] < 0]
    for _ in range(rounds):
        moved = 0
        for v in rng.permutation(n).tolist():
            if not both[v]:
                continue
            votes = np.bincount(part[list(both[v])], minlength=parts)
            to = int(votes.argmax())
            if to != part[v] and votes[to] > votes[part[v]] and size[to] < room:
                size[part[v]] -= 1
                size[to] += 1
                part[v] = to
                moved += 1
        if not moved:
            break
    return part


class Router:
    """A network of one hidden layer from a unit vector to the logits of parts."""

    def __init__(self, x: np.ndarray, target: np.ndarray, hidden: int = 64, epochs: int = 60, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.p = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], hidden)) * 2, np.zeros(hidden), rng.normal(0, 0.1, (hidden, target.shape[1])), np.zeros(target.shape[1])]
        m, v, step = [0 * w for w in self.p], [0 * w for w in self.p], 0
        for e in range(epochs):
            for at in np.array_split(rng.permutation(len(x)), max(1, len(x) // 128)):
                h = np.maximum(0, x[at] @ self.p[0] + self.p[1])
                z = h @ self.p[2] + self.p[3]
                q = np.exp(z - z.max(1, keepdims=True))
                d = (q / q.sum(1, keepdims=True) - target[at]) / len(at)
                dh = (d @ self.p[2].T) * (h > 0)
                step += 1
                rate = 0.005 * (1 - e / epochs) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
                for i, g in enumerate((x[at].T @ dh, dh.sum(0), h.T @ d, d.sum(0))):
                    m[i] = 0.9 * m[i] + 0.1 * g
                    v[i] = 0.999 * v[i] + 0.001 * g * g
                    self.p[i] = self.p[i] - rate * m[i] / (np.sqrt(v[i]) + 1e-8)

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(0, x @ self.p[0] + self.p[1]) @ self.p[2] + self.p[3]


def usable(embeddings: DataFrame) -> DataFrame:
    """(vec_id, v) of rows whose vector takes part: not null, not empty, all components finite, not all zero. Rows with a null id don't take part either."""
    v = F.col("embedding").cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and v is not null").where(finite & F.exists("v", lambda x: x != 0))


def train(vectors: DataFrame, sample: int = SAMPLE, parts: int = PARTS) -> Router | None:
    """Fits the router on at most sample vectors; None if there are too few to cut."""
    rows = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).collect()
    sizes = {len(r.v) for r in rows}
    if len(rows) < 4 * parts or len(sizes) != 1:
        return None
    x = unit(np.array([r.v for r in rows]))
    x = np.unique(x, axis=0)  # equal vectors say nothing about where to cut
    if len(x) < 4 * parts:
        return None
    graph = neighbour_graph(x, GRAPH)
    part = balanced_parts(graph, parts)
    target = np.zeros((len(x), parts))
    np.add.at(target, (np.repeat(np.arange(len(x)), graph.shape[1]), part[graph].ravel()), 0.7 / graph.shape[1])
    target[np.arange(len(x)), part] += 0.3
    return Router(x, target)


def nearest(embeddings: DataFrame, query_filter: str = "vec_id % 50 = 0", k: int = 5, parts: int = PARTS, probes: int = PROBES, sample: int = SAMPLE, chunk: int = CHUNK, asked_at_once: int = ASKED) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each query by cosine, ties to the smaller vec_id; a query's own row is no candidate of it.

    Rows that share a query's id, equal or not, are other rows: candidates, and where they are queries, each gets k rows of its own.

    Vectors of another length than the query's are no candidates. With too few vectors to
    cut there is one part, and the search is exact.
    """
    spark = embeddings.sparkSession
    prepare(spark)
    vectors = usable(embeddings)
    router = train(vectors, sample, parts)
    shared = spark.sparkContext.broadcast(router.p if router else None)  # a few thousand numbers

    def logits_of(x):
        p = shared.value
        return np.maximum(0, x @ p[0] + p[1]) @ p[2] + p[3]

    def route(n):
        @F.pandas_udf("array<int>")
        def parts_of(v):
            import pandas as pd

            if shared.value is None:
                return pd.Series([[0]] * len(v))
            want = shared.value[0].shape[0]
            out = []
            for x in v:
                if len(x) != want:
                    out.append([-1])
                    continue
                x = np.asarray(x, np.float64)
                x = x / np.abs(x).max()
                out.append(np.argsort(-logits_of((x / np.linalg.norm(x))[None])[0], kind="stable")[:n].astype(np.int32))
            return pd.Series(out)

        return parts_of

    # rows are numbered in a table, so that rows of one id stay apart
    index = written(vectors.select(F.monotonically_increasing_id().alias("row"), "vec_id", "v", route(1)("v")[0].alias("part")), "index")
    blocks = lambda n, size: F.greatest(F.lit(1), F.ceil(F.col(n) / size)).cast("int")
    queries = written(index.where(query_filter).select("row", "vec_id", "v", F.explode(route(probes)("v")).alias("part")), "queries")
    counts = index.groupBy("part").agg(F.count("*").alias("n")).join(queries.groupBy("part").agg(F.count("*").alias("q")), "part")
    counts = written(counts.select("part", blocks("n", chunk).alias("chunks"), blocks("q", asked_at_once).alias("asks")), "parts")  # a row a part
    dealt = lambda n: F.pmod(F.xxhash64("row"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    cand = index.join(F.broadcast(counts), "part").select("part", dealt("chunks").alias("chunk"), every("asks").alias("ask"), "row", "vec_id", "v")
    asked = queries.join(F.broadcast(counts), "part").select("part", every("chunks").alias("chunk"), dealt("asks").alias("ask"), "row", "vec_id", "v")

    def rerank(key, left, right):
        import pandas as pd

        out = {"query": [], "query_id": [], "vec_id": [], "score": []}
        if len(left) and len(right):
            for size in {len(v) for v in left.v}:
                q = left[[len(v) == size for v in left.v]]
                c = right[[len(v) == size for v in right.v]]
                if not len(c):
                    continue
                ids, own, x = c.vec_id.to_numpy(), c.row.to_numpy(), np.array(c.v.tolist())
                ux = unit(x)
                for at in range(0, len(q), 256):
                    part = q.iloc[at : at + 256]
                    y = np.array(part.v.tolist())
                    near = unit(y) @ ux.T
                    for i, (number, qid, row) in enumerate(zip(part.row, part.vec_id, near)):
                        row[own == number] = -np.inf
                        m = min(k, int((row > -np.inf).sum()))
                        if not m:
                            continue
                        bar = np.partition(row, len(row) - m)[len(row) - m] - 1e-9  # then exactly, in one order of sums for all
                        keep = np.flatnonzero(row >= bar)
                        s = cosine(y[i], x[keep])
                        best = np.lexsort((ids[keep], -s))[:k]
                        out["query"] += [number] * len(best)
                        out["query_id"] += [qid] * len(best)
                        out["vec_id"] += ids[keep][best].tolist()
                        out["score"] += s[best].tolist()
        return pd.DataFrame(out)

    by_block = ["part", "chunk", "ask"]
    found = asked.groupBy(*by_block).cogroup(cand.groupBy(*by_block)).applyInPandas(rerank, "query long, query_id long, vec_id long, score double")
    by = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def cosine(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Cosines of q with the rows of x, each by the same order of operations, so that equal vectors score equally."""
    return np.multiply(x, q[None]).sum(1) / (np.sqrt(np.multiply(x, x).sum(1)) * np.sqrt(np.multiply(q, q).sum()))


def op7_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))
