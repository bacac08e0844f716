"""Token counts: Arrow functions that return lengths only.

Each Arrow batch is cut into goes of about equal bytes; long texts are cut at safe
boundaries (see units), so a go never holds a long text's encoding. Only units that the
worker has not met are encoded by the library, as one batch, and only their lengths stay.
"""

from __future__ import annotations

import os
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_text, prepare, records, table, text_rows
from .units import UnitCache, units

LIMIT = 512
#: Bytes of texts in one go.
GO = 1 << 20
#: Units kept per worker where an outcome is small.
KEPT = 600_000


@lru_cache(4)
def library(path: str):
    """encode(list of texts) -> list of id lists, by the library that the file is for."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # executors' cores run tasks already
    if path.endswith(".model"):
        import sentencepiece

        piece = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: piece.encode(texts, num_threads=1)
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return lambda texts: [e.ids for e in t.encode_batch_fast(texts, add_special_tokens=False)]


def cuts_safely(path: str) -> bool:
    """Whether units may be encoded by themselves: only for the byte-level pre-tokenizer without normalizer or prefix blank. Other files get whole texts."""
    if not path.endswith(".json"):
        return False
    import json

    with open(path) as f:
        j = json.load(f)
    pre = j.get("pre_tokenizer") or {}
    plain = all(not (t["lstrip"] or t["rstrip"] or t["single_word"] or any(map(str.isspace, t["content"]))) for t in j["added_tokens"])
    return plain and not j.get("normalizer") and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and bool(pre.get("use_regex", True))


@lru_cache(4)
def lengths(path: str) -> UnitCache:
    encode = library(path)
    return UnitCache(lambda unseen: [len(x) for x in encode(unseen)], KEPT)


def count_tokens(path: str, texts: list[str]) -> list[int]:
    if not texts:
        return []
    if not cuts_safely_cached(path):
        return [len(x) for x in library(path)(texts)]
    cut = [units(t) for t in texts]
    known = lengths(path).lookup(cut)
    return [sum(map(known.__getitem__, us)) for us in cut]


cuts_safely_cached = lru_cache(4)(cuts_safely)

_OUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])


def token_counts(documents: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of each row. Null and empty texts have no tokens; repeated rows are counted each. path: a tokenizer file that every worker can open."""
    prepare(documents.sparkSession)

    def run(batches):
        for ids, texts in id_text(batches):
            size = [len(t.encode("utf-8", "surrogatepass")) for t in texts]
            n: list[int] = []
            go: list[str] = []
            held = 0
            for t, s in zip(texts, size):
                if go and held + s > GO:
                    n += count_tokens(path, go)
                    go, held = [], 0
                go.append(t)
                held += s
            yield records(_OUT, doc_id=ids, n_bytes=size, n_tokens=n + count_tokens(path, go))

    return text_rows(documents).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
