"""Benchmark decontamination, with DataFrame operations only.

A document is contaminated by an item when a window of the document that has the item's
number of words has a weighted shingle similarity (sum of minima over sum of maxima of the
counts) of at least SIMILARITY with it. A text of fewer than SHINGLE words is one shingle, so
an item that short matches only texts of the same words, not longer ones that hold it.

1. Shingles of documents meet the items' shingles. A window of that similarity holds at
   least SIMILARITY of the item's shingles, so it holds one of any choice of more than the rest: the ones that
   fewest items share find the candidates (document, item), so a shingle that many items begin with multiplies nothing. Of candidates, runs of hits that are dense enough give every window
   that can qualify, and no other window needs a fingerprint.
2. SimHash of those item-sized windows, from sums of the shingle hashes' bits.
3. Multi-index Hamming blocks: within RADIUS, one of BLOCKS blocks differs in at most
   RADIUS // BLOCKS bits; items are listed under all block values within that distance, so
   the join finds every fingerprint within the radius.
4. Exact similarity of the shingle multisets verifies candidates.

At similarity 0.8 fingerprints differ by 10 bits of 64 on average (standard deviation 3), so RADIUS lies
well beyond what a qualifying window shows.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import free_name, prepare, table, written
from .words import gram_hashes, hashed, keyed, row_key

SHINGLE, SIMILARITY, RADIUS, BLOCKS = 5, 0.8, 24, 8
#: Rows (item, shingle) up to which they are broadcast (some 50 bytes each); beyond, the joins shuffle.
BROADCAST_ROWS = 500_000


def shingle_hashes(h: Column, n: int = SHINGLE) -> Column:
    """Hashes of the n-word shingles from the column of word hashes; of the whole sequence where there are fewer words; none without words."""
    return F.when(F.size(h) >= n, gram_hashes(h, n)).when(F.size(h) > 0, F.array(F.xxhash64(h))).otherwise(F.array().cast("array<long>"))


def simhash_of(rows: DataFrame, by: list[str], hash_col: str) -> DataFrame:
    """(by..., fp) from rows with one hash each: a bit is set where more than half of the group's hashes have it."""
    sums = [F.sum(F.shiftright(F.col(hash_col), b).bitwiseAND(F.lit(1).cast("long"))).alias(f"b{b}") for b in range(64)]
    agg = rows.groupBy(*by).agg(F.count("*").alias("n_"), *sums)
    fp: Column = F.lit(0).cast("long")
    for b in range(64):
        fp = fp.bitwiseOR(F.when(2 * F.col(f"b{b}") > F.col("n_"), F.shiftleft(F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long")))
    return agg.select(*by, fp.alias("fp"))


def _blocks(fp: Column, blocks: int) -> list[Column]:
    width = 64 // blocks
    return [F.shiftrightunsigned(fp, j * width).bitwiseAND(F.lit((1 << width) - 1).cast("long")) for j in range(blocks)]


def contaminated(documents: DataFrame, benchmark: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """(doc_id, k, item_id, similarity, first_word): each document and item with a qualifying window; the largest similarity, and the first start of a window that has it.

    k identifies the row of documents (see words.keyed). Items and documents without words
    match nothing. A document shorter than an item is one window. Repeated items each
    match. Repeated rows of documents, equal in id and text, count once.
    """
    spark = documents.sparkSession
    prepare(spark)
    items = hashed(benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text"), "item_id").where("size(h) > 0").distinct()
    items = written(items.select(F.xxhash64("item_id", "h").alias("item"), "item_id", shingle_hashes(F.col("h"), shingle).alias("s")), "items")
    bag = items.select("item", "item_id", F.size("s").alias("m"), F.explode("s").alias("g")).groupBy("item", "item_id", "m", "g").agg(F.count("*").alias("c"))
    bag = written(bag, "bag")
    light = F.broadcast if bag.count() <= BROADCAST_ROWS else lambda d: d  # everything that is broadcast below has at most as many rows
    known = bag.select("g").distinct()
    need = F.ceil(F.col("m") * similarity - 1e-9).cast("int")
    rarest = Window.partitionBy("item").orderBy("df", "g")
    rare = bag.join(bag.groupBy("g").agg(F.count("*").alias("df")), "g").withColumn("before", F.sum("c").over(rarest) - F.col("c")).where(F.col("before") <= F.col("m") - need)
    rows = keyed(documents)
    # 1. hits: only the shingles of items survive, with their positions
    rolled = hashed(rows, "k", "doc_id").select("k", "doc_id", shingle_hashes(F.col("h"), shingle).alias("s")).select("k", "doc_id", F.size("s").alias("len"), F.posexplode_outer("s").alias("pos", "g"))
    hits = written(rolled.join(light(known), "g", "left_semi").distinct(), "hits")
    candidates = written(hits.select("k", "g").distinct().join(light(rare.select("item", "g")), "g").select("k", "item").distinct(), "candidates")
    spots = hits.join(candidates, "k").join(light(bag.select("item", "m", "g")), ["item", "g"]).select("k", "doc_id", "len", "item", "m", "pos")
    spots = spots.groupBy("k", "doc_id", "len", "item", "m").agg(F.array_sort(F.collect_list("pos")).alias("p")).withColumn("need", need).where(F.size("p") >= F.col("need"))
    # starts s of windows [s, s + m) that hold the hits p[i] .. p[i + need - 1], with p[i] the first
    last = F.greatest(F.col("len") - F.col("m"), F.lit(0))
    first = F.transform("p", lambda x, i: F.struct(F.greatest(F.coalesce(F.get("p", i + F.col("need") - 1), F.lit(2**30)) - F.col("m") + 1, F.when(i > 0, F.get("p", i - 1) + 1).otherwise(F.lit(0)), F.lit(0)).alias("lo"), F.least(x, last).alias("hi")))
    dense = spots.select("k", "doc_id", "len", "item", "m", F.explode(F.filter(first, lambda r: (r.lo <= r.hi))).alias("r"))
    # what the clip at the end moves back: the last window may begin before a hit that is the first of none
    tail = spots.where(F.get("p", F.size("p") - F.col("need")) >= last).select("k", "doc_id", "len", "item", "m", F.struct(last.alias("lo"), last.alias("hi")).alias("r"))
    starts = dense.union(tail).select("k", "doc_id", "len", "item", "m", F.explode(F.sequence(F.col("r.lo"), F.col("r.hi"))).alias("start")).distinct()
    # 2. fingerprints of the windows
    text = hashed(rows.join(starts.select("k").distinct(), "k", "left_semi"), "k").select("k", shingle_hashes(F.col("h"), shingle).alias("s"))
    windows = written(starts.join(text, "k").select("k", "doc_id", "start", "m", F.expr("slice(s, start + 1, m)").alias("ws")).distinct(), "windows")
    wprint = simhash_of(windows.select("k", "start", "m", F.explode("ws").alias("g")), ["k", "start", "m"], "g")
    # 3. multi-index Hamming blocks
    width, within = 64 // blocks, radius // blocks
    masks = [sum(1 << b for b in chosen) for r in range(within + 1) for chosen in combinations(range(width), r)]
    iprint = simhash_of(items.select("item", F.size("s").alias("m"), F.explode("s").alias("g")), ["item", "m"], "g")
    listed = iprint.select("item", "m", F.col("fp").alias("ifp"), F.posexplode(F.array(*_blocks(F.col("fp"), blocks))).alias("block", "v")).select("item", "m", "ifp", "block", F.explode(F.transform(F.array(*[F.lit(x).cast("long") for x in masks]), lambda x: F.col("v").bitwiseXOR(x))).alias("v"))
    probes = wprint.select("k", "start", "m", "fp", F.posexplode(F.array(*_blocks(F.col("fp"), blocks))).alias("block", "v"))
    close = probes.join(listed, ["m", "block", "v"]).where(F.bit_count(F.col("fp").bitwiseXOR(F.col("ifp"))) <= radius).select("k", "start", "m", "item").distinct()
    # 4. exact similarity of multisets
    wbag = windows.select("k", "doc_id", "start", "m", F.size("ws").alias("n"), F.explode("ws").alias("g")).groupBy("k", "doc_id", "start", "m", "n", "g").agg(F.count("*").alias("x"))
    shared = close.join(wbag, ["k", "start", "m"]).join(bag.select("item", "item_id", "g", "c"), ["item", "g"]).groupBy("k", "doc_id", "start", "m", "n", "item", "item_id").agg(F.sum(F.least("x", "c")).alias("both"))
    exact = shared.withColumn("similarity", F.col("both") / (F.col("m") + F.col("n") - F.col("both"))).where(F.col("similarity") >= similarity - 1e-12)
    return exact.groupBy("k", "doc_id", "item_id").agg(F.max("similarity").alias("similarity"), F.min_by("start", F.struct(-F.col("similarity"), F.col("start"))).cast("long").alias("first_word"))


def clean(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """documents without the contaminated rows; all columns stay as they are."""
    name = free_name(documents, "k")
    found = contaminated(documents, benchmark).select(F.col("k").alias(name)).distinct()
    return documents.withColumn(name, row_key()).join(found, name, "left_anti").select(*[F.col(f"`{c}`") for c in documents.columns])


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("k")
