"""Operations by the terms they mention: an inverted table in buckets of the term's hash."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.terms import normal_term
from ..scratch import small_pieces, written

BUCKETS = 64
_KEYS = ["s", "p", "o", "g"]


@dataclass
class TermIndex:
    """rows (term, entity, s, p, o, g, norm): each quad of an entity's operations under each of its terms, once. sizes (term, n). Both stand in folders by bucket, sorted by term, with Bloom filters."""

    rows: DataFrame
    sizes: DataFrame
    buckets: int

    def _of(self, df: DataFrame, terms: list[str]) -> DataFrame:
        """Rows of terms; only their buckets are read."""
        spark = df.sparkSession
        found = spark.range(1).select(*[F.pmod(F.xxhash64(F.lit(t)), F.lit(self.buckets)).cast("int") for t in terms]).first() if terms else []
        return df.where(F.col("bucket").isin(sorted(set(found))) & F.col("term").isin(terms)).drop("bucket")

    def mentions(self, terms: list[str]) -> DataFrame:
        """(term, entity, ...) of operations that mention one of the terms, wherever."""
        return self._of(self.rows, terms)

    def all_of(self, terms: list[str], tagged: bool = False) -> DataFrame:
        """(entity): those with an operation whose subject, predicate and object hold all terms, wherever they stand. The rarest term's rows are read, and the others looked for in them. tagged: language tags of objects compare in lower case."""
        size = {r.term: r.n for r in self._of(self.sizes, terms).collect()}
        rarest = min(terms, key=lambda t: size.get(t, 0))
        have = F.array("s", "p", "norm" if tagged else "o")
        rows = self._of(self.rows, [rarest])
        for t in terms:
            rows = rows.where(F.array_contains(have, t))
        return rows.select("entity").distinct()


def write_index(ops: DataFrame, buckets: int = BUCKETS, tasks: int | None = None) -> TermIndex:
    """The index of ops (entity, s, p, o, g). A term with a third of all rows, such as a predicate, is dealt over tasks as it needs. tasks: how many share the quads; else Spark decides."""
    quads = ops.select("entity", *_KEYS)
    # dealt before they are told apart, so that no task holds more different quads than its share of all operations
    quads = (quads.repartition(tasks, "entity", "p", "o") if tasks else quads).distinct().withColumn("norm", normal_term(F.col("o")))
    rows = quads.select(F.explode(F.array_distinct(F.array(*_KEYS, "norm"))).alias("term"), "entity", *_KEYS, "norm").where("term is not null")
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int"))
    bloom = {"parquet.bloom.filter.enabled#term": "true"}
    put = lambda df: written(df.hint("rebalance", "bucket").sortWithinPartitions("bucket", "term"), "terms", by=["bucket"], **bloom)
    with small_pieces(ops.sparkSession):
        table = put(rows)
        sizes = put(table.groupBy("bucket", "term").agg(F.count("*").alias("n")))
    return TermIndex(table, sizes, buckets)
