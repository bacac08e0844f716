"""Words, shingles and their positions as DataFrame expressions; no Python runs in these."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Runs of ASCII letters, digits and of all characters beyond ASCII are words.
NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Lower-cased words of a text, null as empty.

    Only A-Z change. lower() does that by itself where all characters are ASCII; elsewhere it would also change other letters, so those
    texts go through translate().
    """
    t = F.coalesce(text, F.lit(""))
    return F.filter(F.split(F.when(F.octet_length(t) == F.char_length(t), F.lower(t)).otherwise(F.translate(t, UPPER, UPPER.lower())), NO_WORD), lambda w: w != "")


def gram_hashes(hashes: Column, k: int) -> Column:
    """Hash of each run of k word hashes; an empty array where there are fewer words.

    hashes must be a column of its own (see hashed): the lambda refers to it k times for each word, and an
    expression in its place would be worked out anew each time. Explode the result with an
    outer generator: for others the optimizer infers a filter and puts the expression there.
    """
    n = F.size(hashes)
    run = lambda x, i: F.xxhash64(x, *[F.get(hashes, i + j) for j in range(1, k)])
    return F.when(n < k, F.array().cast("array<long>")).otherwise(F.transform(F.slice(hashes, F.lit(1), F.greatest(n - k + 1, F.lit(0))), run))


def word_hashes(ws: Column) -> Column:
    return F.transform(ws, lambda w: F.xxhash64(w))


def hashed(rows: DataFrame, *keep: str, text: str = "text", name: str = "h") -> DataFrame:
    """(keep..., h): the hashes of each row's words, in a projection of their own."""
    return rows.select(*keep, word_hashes(words(F.col(text))).alias(name))


def row_key() -> Column:
    """16 bytes of two hashes of a row's doc_id and text, which read them in different order: no two of 10^10 rows should share them by chance."""
    doc_id, text = F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit(""))
    half = lambda *c: F.lpad(F.hex(F.xxhash64(*c)), 16, "0")
    return F.unhex(F.concat(half(doc_id, text), half(text, doc_id)))


def keyed(documents: DataFrame) -> DataFrame:
    """(k, doc_id, text): k names a row by its id and text (see row_key), so that rows sharing an id stay apart and repeated rows get equal results."""
    return documents.select(row_key().alias("k"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


__all__ = ["NO_WORD", "words", "gram_hashes", "hashed", "word_hashes", "keyed", "row_key", "free_name"]
