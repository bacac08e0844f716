"""Token ids as length-delimited binary records, with an index for shuffled reads.

A shard is a run of records in ascending doc_id order:

    uint64 length of the payload, little-endian
    uint32 masked CRC-32 of those 8 bytes
    payload: int64 doc_id, uint8 flags (1: doc_id is null), uint8 bytes an id (2 or 4), ids
    uint32 masked CRC-32 of the payload
    one byte 0x0A

mask(c) = (c rotated right by 15) + 0xA282EAD8, mod 2**32. The last byte is there because
Spark's text writer, which commits shards safely on any file system, ends rows with it;
what stands before it is copied as it is. Shard n holds smaller ids than shard n + 1. The index is
a Parquet table (shard, file, offset, length, doc_id, n_tokens) made from the shards in one
sequential read. A shuffled reader permutes it, opens file, seeks to offset and gives
length bytes to parse(); fetch() does so with Spark.

Texts are encoded where they stand. Only the records, about half as large, are dealt to shards and sorted there.
A shard's range of ids comes from a bounded sample of ids and sizes, so shards are about equal in bytes.
"""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_right
from functools import lru_cache
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import new_path, prepare, records, table, text_rows
from .pieces import PieceTable, joinable, large, odd_texts, pieces, strings
from .token_counts import cuts_safely_cached, library

#: Bytes of records in one shard, about; a task that reads a shard holds it several times, so executors with more memory may take more.
SHARD_BYTES = 12 << 20
#: Rows whose id and size are sampled to find the shards' ranges.
SAMPLE = 100_000
_MASK = 0xA282EAD8


def masked(data: bytes) -> int:
    c = zlib.crc32(data)
    return ((c >> 15 | c << 17) + _MASK) & 0xFFFFFFFF


def frame(doc_id: int | None, ids: bytes, width: int) -> bytes:
    """One record without its last byte. ids: little-endian ids of width bytes."""
    payload = struct.pack("<qBB", doc_id or 0, doc_id is None, width) + ids
    head = struct.pack("<Q", len(payload))
    return b"".join((head, struct.pack("<I", masked(head)), payload, struct.pack("<I", masked(payload))))


def parse(data: bytes, at: int = 0):
    """Yields (offset, length, doc_id, ids as uint32) of each record; raises ValueError where a checksum or a length is wrong."""
    while at < len(data):
        head = bytes(data[at : at + 8])
        if len(head) < 8 or masked(head) != struct.unpack_from("<I", data, at + 8)[0]:
            raise ValueError(f"damaged record length at {at}")
        (n,) = struct.unpack("<Q", head)
        payload = data[at + 12 : at + 12 + n]
        if len(payload) < n or masked(payload) != struct.unpack_from("<I", data, at + 12 + n)[0]:
            raise ValueError(f"damaged record at {at}")
        doc_id, null, width = struct.unpack_from("<qBB", payload)
        yield at, n + 17, None if null else doc_id, np.frombuffer(payload, f"<u{width}", offset=10).astype("<u4")
        at += n + 17


#: Bytes of texts in one go; words repeat within it.
GO = 4 << 20
#: Pieces that are encoded as one text and at once, and pieces whose ids a worker keeps, some 40 bytes each.
TOGETHER, AT_ONCE, KEPT = 64, 1 << 15, 200_000


@lru_cache(4)
def _token_bytes(path: str) -> np.ndarray:
    """Bytes of text that each id stands for."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    vocab = t.get_vocab(with_added_tokens=True)
    out = np.zeros(max(vocab.values()) + 1, np.int64)
    for token, i in vocab.items():
        out[i] = len(token)  # byte-level texts write each byte as one character
    for i, token in t.get_added_tokens_decoder().items():
        out[i] = len(token.content.encode())
    return out


def _ends(path: str, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray | None:
    """How many ids stand for the first bytes, the first two units' bytes and so on; None if no id ends where a unit does."""
    upto, ends = np.cumsum(_token_bytes(path)[ids]), np.cumsum(sizes)
    at = np.searchsorted(upto, ends)
    return at + 1 if at[-1] == len(ids) - 1 and (upto[at] == ends).all() else None


def encode_pieces(path: str, found: pa.Array, width: int, odd: str) -> pa.Array:
    """Ids of each piece (large strings), little-endian, of width bytes each. Pieces that may stand side by side are encoded many as one text, as a result for each costs more than its ids; the bytes that ids stand for tell where a piece ends. Where no id ends there, and for all other pieces, each is encoded by itself."""
    encode, kind = library(path), f"<u{width}"
    may = joinable(found, odd)
    plain, alone = np.flatnonzero(may), [np.flatnonzero(~may)]
    at, data = strings(found.take(pa.array(plain)))
    outs, order = [], []

    def deal(a: int, b: int, lists: list[list[int]]) -> bool:
        ids = np.fromiter(chain.from_iterable(lists), np.uint32)
        ends = _ends(path, ids, np.diff(at[a : b + 1]))
        if ends is not None:
            outs.append(large(np.concatenate([[0], ends * width]), ids.astype(kind), pa.large_binary()))
            order.append(plain[a:b])
        return ends is not None

    for go in range(0, len(plain), AT_ONCE):
        to = min(go + AT_ONCE, len(plain))
        heads = np.append(np.arange(go, to, TOGETHER), to)
        lists = encode(large(at[heads], data, pa.large_string()).to_pylist())
        if not deal(go, to, lists):
            for a, b, ids in zip(heads[:-1].tolist(), heads[1:].tolist(), lists):
                if not deal(a, b, [ids]):
                    alone.append(plain[a:b])
    rest = np.concatenate(alone)
    for go in range(0, len(rest), AT_ONCE):
        lists = encode(found.take(pa.array(rest[go : go + AT_ONCE])).to_pylist())
        ids = np.fromiter(chain.from_iterable(lists), np.uint32)
        outs.append(large(np.concatenate([[0], np.cumsum([len(x) for x in lists]) * width]), ids.astype(kind), pa.large_binary()))
        order.append(rest[go : go + AT_ONCE])
    return pa.concat_arrays(outs).take(pa.array(np.argsort(np.concatenate(order)))) if outs else pa.array([], pa.large_binary())


def encode_together(path: str, found: list[str], width: int) -> list[bytes]:
    """Ids of each unit, little-endian, of width bytes each."""
    return encode_pieces(path, pa.array(found, pa.large_string()), width, _odd(path)).to_pylist()


@lru_cache(4)
def _odd(path: str) -> str:
    from tokenizers import Tokenizer

    return odd_texts([t.content for t in Tokenizer.from_file(path).get_added_tokens_decoder().values()])


@lru_cache(4)
def _pieces_to_ids(path: str, width: int) -> PieceTable:
    return PieceTable(lambda unseen: encode_pieces(path, unseen, width, _odd(path)), KEPT)


def encode_ids(path: str, texts: pa.Array | list[str], width: int, end: bytes) -> list[bytes]:
    """Ids of each text (strings without nulls), little-endian, of width bytes each, and end."""
    texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())
    if not cuts_safely_cached(path):
        return [np.array(x, f"<u{width}").tobytes() + end for x in library(path)(texts.to_pylist())]
    found, order, upto = pieces(texts.cast(pa.large_string()), _odd(path))
    ids = _pieces_to_ids(path, width).take(found)
    at, data = strings(ids)
    data, out = memoryview(data), [end] * len(texts)
    for i, (x, y) in zip(order.tolist(), pairwise(at[upto].tolist())):
        out[i] = b"".join((data[x:y], end))
    return out


_FRAME = pa.schema([("shard", pa.int32()), ("doc_id", pa.int64()), ("tie", pa.int64()), ("record", pa.binary())])
_ROW = pa.schema([("shard", pa.int64()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def write_shards(documents: DataFrame, out: str, path: str, end_id: int | None = 2, ids_below: int = 1 << 16, shard_bytes: int = SHARD_BYTES) -> None:
    """Encodes every whole text and writes shards under out, in ascending doc_id order (null ids first, repeated ids side by side, in the order of a hash of their texts).

    ids_below: bound of the ids; up to 2**16 an id takes 2 bytes, else 4. Null and empty
    texts are records of the end id alone. An empty table gives shards without records. Many rows of one id, or
    of none, are dealt to several shards; equal rows stay in one.
    """
    prepare(documents.sparkSession)
    width = 2 if ids_below <= 1 << 16 else 4
    end = b"" if end_id is None else end_id.to_bytes(width, "little")
    rows = text_rows(documents, F.xxhash64(F.coalesce("text", F.lit(""))).alias("tie"))
    bounds = ranges(rows, shard_bytes)

    def run(batches):
        for b in batches:
            at, all_ids, ties, texts = 0, b.column("doc_id").to_pylist(), b.column("tie").to_pylist(), b.column("text")
            upto = np.cumsum(pc.binary_length(texts).to_numpy())
            while at < len(texts):
                to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + GO, "right")))
                ids, tie = all_ids[at:to], ties[at:to]
                shard = [bisect_right(bounds, (i is not None, i or 0, t)) for i, t in zip(ids, tie)]
                yield records(_FRAME, shard=shard, doc_id=ids, tie=tie, record=[frame(i, x, width) for i, x in zip(ids, encode_ids(path, texts[at:to], width, end))])
                at = to

    dealt = rows.mapInArrow(run, "shard int, doc_id long, tie long, record binary").repartitionById(len(bounds) + 1, "shard").sortWithinPartitions("doc_id", "tie")
    # the cast keeps the bytes as they are; the writer copies them
    dealt.select(F.col("record").cast("string").alias("value")).write.option("compression", "none").text(out)


def ranges(rows: DataFrame, shard_bytes: int) -> list[tuple[bool, int, int]]:
    """Ends of the shards' ranges of (id is not null, id, tie), ascending, each of about equal bytes; from about SAMPLE to twice as many rows (doc_id, tie, text), so that texts are read once; counting rows reads none. A record is taken for half its text."""
    size = F.octet_length("text") + 32
    parts = max(1, rows.count() // SAMPLE)
    picked = rows.where(F.pmod(F.xxhash64("tie", "doc_id", F.lit(1)), F.lit(parts)) == 0).select((F.col("doc_id").isNotNull()).alias("known"), F.coalesce("doc_id", F.lit(0)).alias("doc_id"), "tie", size.alias("size"))
    t = picked.toArrow()
    known, ids, tie, sizes = (t.column(c).to_numpy() for c in t.column_names)
    shards = -(-int(sizes.sum()) * parts // (2 * shard_bytes))
    if shards <= 1:
        return []
    order = np.lexsort((tie, ids, known))
    upto = np.cumsum(sizes[order])
    at = np.unique(np.searchsorted(upto, upto[-1] * np.arange(1, shards) / shards)) if len(order) else []
    return sorted({(bool(known[k]), int(ids[k]), int(tie[k])) for k in (order[i] for i in at)})


def _files(spark: SparkSession, out: str) -> DataFrame:
    """(shard, file, content) of the shards under out."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(out)
    return files.select(F.regexp_extract("path", r"part-(\d+)-", 1).cast("long").alias("shard"), F.regexp_extract("path", r"[^/]*$", 0).alias("file"), "content")


def read_records(spark: SparkSession, out: str) -> DataFrame:
    """(shard, file, offset, length, doc_id, n_tokens, ids_crc32) of each record under out; every checksum is verified. ids_crc32: of the ids as little-endian uint32. Shards without records give no rows."""

    def run(batches):
        for b in batches:
            for shard, file, data in zip(b.column("shard").to_pylist(), b.column("file").to_pylist(), b.column("content")):
                found = []
                for offset, length, doc_id, ids in parse(memoryview(data.as_buffer())):
                    found.append((shard, file, offset, length, doc_id, len(ids), zlib.crc32(ids)))
                    if len(found) == 50_000:
                        yield records(_ROW, **{n: [x[k] for x in found] for k, n in enumerate(_ROW.names)})
                        found = []
                yield records(_ROW, **{n: [x[k] for x in found] for k, n in enumerate(_ROW.names)})

    return _files(spark, out).mapInArrow(run, "shard long, file string, offset long, length long, doc_id long, n_tokens long, ids_crc32 long")


def fetch(wanted: DataFrame, out: str) -> DataFrame:
    """(file, offset, doc_id, ids) of the index rows wanted (file, offset, length) of the shards under out; ids as an array. Each shard is read once and cut in the JVM; checksums are verified."""
    schema = pa.schema([("file", pa.string()), ("offset", pa.int64()), ("doc_id", pa.int64()), ("ids", pa.list_(pa.int64()))])

    def run(batches):
        for b in batches:
            got = [next(parse(x.as_buffer().to_pybytes())) for x in b.column("record")]
            yield records(schema, file=b.column("file"), offset=b.column("offset"), doc_id=[g[2] for g in got], ids=[g[3].tolist() for g in got])

    cut = F.substring("content", (F.col("offset") + 1).cast("int"), F.col("length").cast("int"))
    rows = wanted.select("file", "offset", "length").join(_files(wanted.sparkSession, out).select("file", "content"), "file")
    return rows.select("file", "offset", cut.alias("record")).mapInArrow(run, "file string, offset long, doc_id long, ids array<long>")


def write_index(spark: SparkSession, out: str, index: str) -> DataFrame:
    """Reads the shards once and writes the index; returns it, with ids_crc32 beside the columns a reader needs."""
    read_records(spark, out).write.parquet(index)
    return spark.read.schema("shard long, file string, offset long, length long, doc_id long, n_tokens long, ids_crc32 long").parquet(index)


def shuffled(index: DataFrame, seed: int) -> DataFrame:
    """The index in the order of a seeded hash, the same on every run: a reader takes rows from the top and reads (file, offset, length)."""
    return index.orderBy(F.xxhash64(F.lit(seed), "shard", "offset"), "shard", "offset")


def positions(index: DataFrame) -> DataFrame:
    """index with start: the ids of all records before, in file order. Sums of shards are added up first, so no task sees more than one shard's rows or one row a shard. Repeated ids and null ids keep a row each."""
    per = index.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    base = per.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("base"))
    within = F.sum("n_tokens").over(Window.partitionBy("shard").orderBy("offset")) - F.col("n_tokens")
    return index.withColumn("within", within).join(base, "shard").withColumn("start", F.col("base") + F.col("within")).drop("base", "within")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = new_path(spark, "tokens")
    write_shards(table(spark, sf_dir, "documents"), f"{out}/shards", public_tokenizers.path("byte_bpe_50k.json"), end_id=2, ids_below=50257)
    index = write_index(spark, f"{out}/shards", f"{out}/index")
    return positions(index).select("doc_id", "start", "n_tokens", "ids_crc32", "shard", "file", "offset", "length")
