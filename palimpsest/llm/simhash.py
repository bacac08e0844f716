"""SimHash near-duplicates by bit-sliced comparison.

1. A worker turns every whole text into a 64-bit fingerprint of its word shingles.
2. Equal fingerprints become one node. 64 bits are cut into blocks; within RADIUS
   differing bits all but RADIUS blocks are equal, so each node is dealt out once
   for every choice of so many blocks and no link is missed, whatever the number of blocks. It is
   6, 7 or 8 (15, 35 or 70 keys of 21, 27 or 32 bits), the least that leaves PER_KEY nodes a key on average.
3. Nodes of one key are compared: bit planes lie vertically (plane b holds bit b of all
   nodes of a batch), one carry-save counter adds the differences of 64 pairs a word, and
   words in which every pair is beyond the radius are abandoned. A task returns a
   spanning forest, never all pairs.
4. Keys with more than TILE nodes are cut into tiles. After the components of the tiles are
   known, only pairs of different components remain: the nodes of the key's largest
   component are dealt over tiles once, and those of other components meet each tile.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import prepare, records, table, written
from .components import components
from .words import keyed

WORDS, RADIUS, TILE, PER_KEY = 4, 4, 1024, 64
#: Nodes compared in one batch of a task.
BATCH = 1 << 16


def fingerprint(text: str, n: int = WORDS) -> int:
    """64-bit SimHash: words of ASCII white space, A-Z lower-cased, n-word shingles with repeats (fewer words: the whole sequence; none: 0), XXH64 with seed 42; a bit is set where more than half of the hashes have it."""
    from xxhash import xxh64_intdigest

    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) <= n:
        return xxh64_intdigest(b" ".join(words), 42)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    hashes = np.array([xxh64_intdigest(line[a:b], 42) for a, b in zip(starts[: len(words) - n + 1].tolist(), ends[n - 1 :].tolist())], np.uint64)
    total = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 4096):
        total += np.unpackbits(hashes[i : i + 4096].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * total > len(hashes), bitorder="little").view("<u8")[0])


_FP = pa.schema([("k", pa.binary()), ("doc_id", pa.int64()), ("fp", pa.int64())])


def fingerprints(documents: DataFrame, n: int = WORDS) -> DataFrame:
    """(k, doc_id, fp) of each row; k hashes id and text (see words.keyed), fp is the fingerprint as a signed long. Null texts are empty."""
    prepare(documents.sparkSession)

    def run(batches):
        for b in batches:
            yield records(_FP, k=b.column("k"), doc_id=b.column("doc_id"), fp=np.array([fingerprint(t, n) for t in b.column("text").to_pylist()], np.uint64).view(np.int64))

    return keyed(documents).mapInArrow(run, "k binary, doc_id long, fp long")


def blocks_for(nodes: int, radius: int = RADIUS) -> int:
    """Blocks for so many nodes. Links are complete for any number; it only decides how many nodes share a key."""
    choices = range(radius + 2, radius + 5)
    return next((b for b in choices if nodes >> 64 * (b - radius) // b <= PER_KEY), choices[-1])


def block_keys(fp: Column, radius: int, blocks: int) -> Column:
    """Keys of a fingerprint: for each choice of blocks - radius blocks, its number and the blocks' bits."""
    cuts = [round(64 * i / blocks) for i in range(blocks + 1)]
    out = []
    for k, chosen in enumerate(combinations(range(blocks), blocks - radius)):
        key: Column = F.lit(k).cast("long")
        for j in chosen:
            width = cuts[j + 1] - cuts[j]
            key = F.shiftleft(key, width).bitwiseOR(F.shiftrightunsigned(fp, cuts[j]).bitwiseAND(F.lit((1 << width) - 1)))
        out.append(key)
    return F.array(*out)


def close_pairs(group: np.ndarray, fps: np.ndarray, radius: int = RADIUS):
    """Yields arrays (i, j) of positions with equal group and at most radius (under 8) differing bits, one distance of positions after another. Rows of a group must stand together, larger groups first."""
    n = len(fps)
    if n < 2:
        return
    edge = np.concatenate([[0], np.flatnonzero(np.diff(group)) + 1, [n]])
    sizes = np.diff(edge)
    longest = int(sizes.max())
    wide = (n + 63) // 64 + 2
    bits = np.zeros((64, wide * 64), np.uint8)
    bits[:, :n] = np.unpackbits(fps.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").T
    planes = np.packbits(bits, axis=1, bitorder="little").view("<u8").reshape(64, wide)
    del bits
    for s in range(1, longest):
        upto = int(edge[1:][sizes > s].max())
        if upto <= s:
            break
        lanes = np.zeros(((upto + 63) // 64) * 64, np.uint8)
        lanes[: upto - s] = group[: upto - s] == group[s:upto]
        valid = np.packbits(lanes, bitorder="little").view("<u8")
        word = np.flatnonzero(valid)
        live = valid[word]
        w, r = divmod(s, 64)
        ones, twos, fours, over = (np.zeros(len(word), np.uint64) for _ in range(4))
        for b in range(0, 64, 2):
            x, y = (p[word] ^ (p[word + w] if not r else (p[word + w] >> np.uint64(r)) | (p[word + w + 1] << np.uint64(64 - r))) for p in (planes[b], planes[b + 1]))
            u = x ^ y
            carry = (x & y) | (ones & u)  # a full adder saves the carry of three lines
            ones ^= u
            more = twos & carry
            twos ^= carry
            over |= fours & more
            fours ^= more
            if b % 8 == 6:
                far = over | _beyond(ones, twos, fours, radius)
                live &= ~far
                keep = np.flatnonzero(live)
                if not len(keep):
                    word = word[:0]
                    break
                if len(keep) < 0.7 * len(word):  # abandon blocks in which every pair is beyond the radius
                    word, live, ones, twos, fours, over = (z[keep] for z in (word, live, ones, twos, fours, over))
        if len(word):
            at = np.flatnonzero(np.unpackbits(live.astype("<u8").view(np.uint8), bitorder="little"))
            i = word[at // 64] * 64 + at % 64
            yield i, i + s


def _beyond(ones, twos, fours, radius: int):
    """Lanes whose three-bit counter is above radius."""
    above, same = np.zeros_like(ones), ~np.zeros_like(ones)
    for line, bit in ((fours, 4), (twos, 2), (ones, 1)):
        if radius & bit:
            same &= line
        else:
            above |= same & line
            same &= ~line
    return above


def forest(group: np.ndarray, fps: np.ndarray, radius: int = RADIUS, label: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Links (fp, fp of its root) that span what close_pairs finds. With label, only nodes of different labels are joined, and what is returned are pairs of labels."""
    n = len(fps)
    root = np.arange(n)
    if label is not None:
        _, first, back = np.unique(label, return_index=True, return_inverse=True)
        root = first[back]
    begin = root.copy()

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, j in close_pairs(group, fps, radius):
        differ = root[i] != root[j]
        if differ.any():
            for a, b in zip(i[differ].tolist(), j[differ].tolist()):
                a, b = find(a), find(b)
                if a != b:
                    root[max(a, b)] = min(a, b)
            while True:
                up = root[root]
                if (up == root).all():
                    break
                root[:] = up
    moved = np.flatnonzero(root != (np.arange(n) if label is None else begin))
    own = fps.view(np.int64) if label is None else label
    return own[moved], own[root[moved]]


_LINK = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _compare(rows: DataFrame, by: list[str], radius: int, labelled: bool) -> DataFrame:
    """Links of rows (by..., fp[, label]) that agree in by; every group is at most two tiles."""

    def run(batches):
        def solve(held):
            t = pa.Table.from_batches(held).combine_chunks()
            key = [t.column(c).to_numpy() for c in by]
            change = np.zeros(t.num_rows, bool)
            for k in key:
                change[1:] |= k[1:] != k[:-1]
            g = np.cumsum(change)
            size = np.bincount(g)
            order = np.lexsort((g, -size[g]))
            fps = np.ascontiguousarray(t.column("fp").to_numpy()[order]).view(np.uint64)
            label = t.column("label").to_numpy()[order] if labelled else None
            a, b = forest(g[order], fps, radius, label)
            return records(_LINK, a=a, b=b)

        held, n = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if n >= BATCH:  # cut where a group ends
                whole = pa.Table.from_batches([*held, batch]).combine_chunks()
                keys = [whole.column(c).to_numpy() for c in by]
                differs = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
                if len(differs):
                    cut = int(differs[-1])
                    yield solve(whole.slice(0, cut).to_batches())
                    held = whole.slice(cut).to_batches()
                    n = whole.num_rows - cut
                    continue
            held.append(batch)
            n += batch.num_rows
        if held:
            yield solve(held)

    return rows.sortWithinPartitions(*by).mapInArrow(run, "a long, b long")


def clusters(fps: DataFrame, radius: int = RADIUS, blocks: int | None = None, tile: int = TILE) -> DataFrame:
    """(fp, label) of each distinct fp that has a link; label is the smallest fp (signed) of its component. blocks: see blocks_for."""
    nodes = written(fps.select("fp").distinct(), "nodes")
    blocks = blocks or blocks_for(nodes.count(), radius)
    dealt_keys = nodes.select("fp", F.explode(block_keys(F.col("fp"), radius, blocks)).alias("k"))
    count = written(dealt_keys.groupBy("k").agg(F.count("*").alias("c")).where("c > 1"), "keys")
    rows = dealt_keys.join(count, "k").select("k", "fp", "c", F.pmod(F.xxhash64("fp"), F.ceil(F.col("c") / tile).cast("long")).alias("t"))
    label = components(_compare(rows.select("k", "t", "fp").repartition("k", "t"), ["k", "t"], radius, False))
    hot = count.where(F.col("c") > tile)
    if hot.isEmpty():
        return label.select(F.col("node").alias("fp"), "label")
    label = written(label.select(F.col("node").alias("fp"), "label"), "labels")
    named = dealt_keys.join(hot, "k").join(label, "fp", "left").select("k", "fp", F.coalesce("label", "fp").alias("label"))
    per = named.groupBy("k", "label").agg(F.count("*").alias("n"))
    main = per.groupBy("k").agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.max("n").alias("n"), F.sum("n").alias("all"), F.count("*").alias("labels")).where("labels > 1")
    tiles = lambda n: F.greatest(F.lit(1), F.ceil(F.col(n) / tile)).cast("long")
    main = main.select("k", "main", tiles("n").alias("mt"), F.greatest(F.lit(1), F.ceil((F.col("all") - F.col("n")) / tile)).cast("long").alias("ot"))
    dealt = named.join(main, "k").withColumn("own", F.when(F.col("label") == F.col("main"), F.pmod(F.xxhash64("fp"), F.col("mt"))).otherwise(F.col("mt") + F.pmod(F.xxhash64("fp"), F.col("ot"))))
    everyone = F.sequence(F.lit(0).cast("long"), F.col("mt") + F.col("ot") - 1)
    others = F.sequence(F.col("mt"), F.col("mt") + F.col("ot") - 1)
    met = dealt.select("k", "fp", "label", "own", F.explode(F.when(F.col("own") < F.col("mt"), others).otherwise(everyone)).alias("with"))
    met = met.select("k", F.least("own", "with").alias("x"), F.greatest("own", "with").alias("y"), "fp", "label").repartition("k", "x", "y")
    more = written(_compare(met, ["k", "x", "y"], radius, True), "links")
    if more.isEmpty():
        return label
    up = components(more).select(F.col("node").alias("label"), F.col("label").alias("top"))
    lone = more.select(F.col("a").alias("fp")).union(more.select(F.col("b").alias("fp"))).distinct().join(label, "fp", "left_anti").select("fp", F.col("fp").alias("label"))
    return label.union(lone).join(up, "label", "left").select("fp", F.coalesce("top", "label").alias("label"))


def near_duplicates(documents: DataFrame, radius: int = RADIUS, blocks: int | None = None, tile: int = TILE) -> DataFrame:
    """(doc_id, fp, component_id) of each row; component_id is the smallest doc_id reachable over links of at most radius bits, itself included.

    Null and empty texts have fingerprint 0 and link like others. Rows with a null id keep
    theirs and take part; a component of null ids alone has a null component_id. Repeated rows come out as often as they went in.
    """
    return grouped(documents, radius, blocks, tile).select("doc_id", "fp", "component_id")


def grouped(documents: DataFrame, radius: int = RADIUS, blocks: int | None = None, tile: int = TILE) -> DataFrame:
    """(k, doc_id, fp, label, component_id) of each row: near_duplicates with the row's key, and with the component's smallest fp, which also names components of null ids."""
    prepare(documents.sparkSession)
    fps = written(fingerprints(documents), "fingerprints")
    label = clusters(fps, radius, blocks, tile)
    low = fps.groupBy("fp").agg(F.min("doc_id").alias("low"))
    named = written(low.join(label, "fp", "left").select("fp", "low", F.coalesce("label", "fp").alias("label")), "named")
    # a table of its own, so that the join can split the rows of a large component
    top = written(named.groupBy("label").agg(F.min("low").alias("component_id")), "components")
    of = named.join(top, "label").select("fp", "label", "component_id")
    return fps.join(of, "fp").select("k", "doc_id", "fp", "label", "component_id")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
