"""Byte-level BPE in length-bucketed padded numpy matrices.

Pre-tokens are bucketed by their length, each bucket is one padded matrix of token ids, and
in each round every row merges its leftmost pair of the lowest rank. Ranks come from an
open-addressing table keyed by the pair. Merged rows are compacted; rows without a pair
that merges leave the matrix.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache
from itertools import accumulate, pairwise

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import id_text, prepare, records, table, text_rows
from .units import UnitCache, units

NONE = np.int32(2**31 - 1)
#: Units and pre-tokens kept per worker.
KEPT_UNITS, KEPT_PIECES = 400_000, 200_000
#: Packed ids are little-endian numbers of four bytes.
ID = "<u4"
#: Cells of one matrix at most.
CELLS = 1 << 21


class Ranks:
    """Merge table of a rank file: token bytes by id, and pair -> merged id as an open-addressing hash table."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.byte = np.full(256, -1, np.int32)
        for b, i in ranks.items():
            if len(b) == 1:
                self.byte[b[0]] = i
        pairs = {}
        for b, i in ranks.items():
            for k in range(1, len(b)):
                if (x := ranks.get(b[:k])) is not None and (y := ranks.get(b[k:])) is not None:
                    pairs[x << 32 | y] = i
        size = 1 << max(4, int(np.ceil(np.log2(len(pairs) * 2.5 + 1))))
        self.mask = np.int64(size - 1)
        self.keys, self.values = np.full(size, -1, np.int64), np.full(size, NONE, np.int32)
        keys, values = np.fromiter(pairs.keys(), np.int64, len(pairs)), np.fromiter(pairs.values(), np.int32, len(pairs))
        at = self._slot(keys)
        left = np.arange(len(keys))
        while len(left):  # each free slot takes one of its claimants, the others go on to the next slot
            free = self.keys[at[left]] == -1
            claim, first = np.unique(at[left][free], return_index=True)
            won = left[free][first]
            self.keys[claim], self.values[claim] = keys[won], values[won]
            left = np.setdiff1d(left, won, assume_unique=True)
            at[left] = (at[left] + 1) & self.mask

    def _slot(self, key: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            h = key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return ((h >> np.uint64(20)) ^ (h >> np.uint64(41))).astype(np.int64) & self.mask

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merged id of each pair, NONE where it doesn't merge or is padding (negative)."""
        shape = left.shape
        key = (left.astype(np.int64) << 32 | right.astype(np.int64)).ravel()
        out = np.full(key.shape, NONE, np.int32)
        todo = np.flatnonzero((left.ravel() >= 0) & (right.ravel() >= 0))
        key = key[todo]
        at = self._slot(key)
        while len(todo):
            found = self.keys[at]
            hit = found == key
            out[todo[hit]] = self.values[at[hit]]
            on = ~hit & (found != -1)
            todo, key, at = todo[on], key[on], (at[on] + 1) & self.mask
        return out.reshape(shape)

    def merge(self, rows: np.ndarray) -> list[bytes]:
        """The final ids of each row of a matrix of byte ids, padded with -1 on the right; packed (see ID)."""
        out: list = [None] * len(rows)
        index = np.arange(len(rows))
        rank = self.rank(rows[:, :-1], rows[:, 1:]) if rows.shape[1] > 1 else np.full((len(rows), 0), NONE, np.int32)
        while len(rows):
            best = rank.argmin(1) if rank.shape[1] else np.zeros(len(rows), np.int64)  # the leftmost of equal ranks
            low = rank[np.arange(len(rows)), best] if rank.shape[1] else np.full(len(rows), NONE)
            done = low == NONE
            if done.any():
                ended = rows[done]
                true = ended >= 0
                data = ended[true].astype(ID).tobytes()
                ends = accumulate((4 * true.sum(1)).tolist(), initial=0)
                for i, (a, b) in zip(index[done].tolist(), pairwise(ends)):
                    out[i] = data[a:b]
                rows, rank, index, best, low = rows[~done], rank[~done], index[~done], best[~done], low[~done]
                if not len(rows):
                    break
            r = np.arange(len(rows))
            rows[r, best] = low
            keep = np.ones(rows.shape, bool)
            keep[r, best + 1] = False
            rows = rows[keep].reshape(len(rows), -1)  # compaction: each row lost one cell
            keep = keep[:, 1:]
            rank = rank[keep].reshape(len(rows), -1) if rank.shape[1] > 1 else rank[:, :0]
            if rank.shape[1]:
                inside = best < rank.shape[1]
                if inside.any():
                    rank[r[inside], best[inside]] = self.rank(rows[r[inside], best[inside]], rows[r[inside], best[inside] + 1])
                before = best > 0
                if before.any():
                    rank[r[before], best[before] - 1] = self.rank(rows[r[before], best[before] - 1], rows[r[before], best[before]])
            width = int((rows >= 0).sum(1).max())
            if width < rows.shape[1]:
                rows, rank = rows[:, :width], rank[:, : max(0, width - 1)]
        return out

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """Packed ids of each pre-token. A piece that is a token is that token; others merge, in matrices of about equal lengths."""
        out: list = [b""] * len(pieces)
        bucket: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            if (k := self.ranks.get(p)) is not None:
                out[i] = k.to_bytes(4, "little")
            elif p:
                bucket.setdefault((len(p) - 1).bit_length(), []).append(i)
        for members in bucket.values():
            members.sort(key=lambda i: len(pieces[i]))
            at = 0
            while at < len(members):
                take = members[at : at + max(1, CELLS // len(pieces[members[-1]]))]
                at += len(take)
                data = [pieces[i] for i in take]
                length = np.fromiter(map(len, data), np.int64, len(data))
                width = int(length.max())
                rows = np.full((len(take), width), -1, np.int32)
                rows[np.arange(width) < length[:, None]] = self.byte[np.frombuffer(b"".join(data), np.uint8)]
                for i, ids in zip(take, self.merge(rows)):
                    out[i] = ids
        return out


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(4)
def codec(path: str, pattern: str) -> Codec:
    return Codec(read_ranks(path), pattern)


class Codec:
    """Encodes texts to ids and decodes ids to bytes, with a bounded table of units."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.split = Ranks(ranks), regex.compile(pattern)
        self.cache = UnitCache(self._units, KEPT_UNITS)
        self.pieces = UnitCache(self._pieces, KEPT_PIECES)

    def _pieces(self, unseen: list[str]) -> list[bytes]:
        return self.ranks.encode_pieces([p.encode("utf-8") for p in unseen])

    def _units(self, unseen: list[str]) -> list[bytes]:
        parts = [self.split.findall(u) for u in unseen]
        known = self.pieces.lookup(parts)
        return [known[ps[0]] if len(ps) == 1 else b"".join(map(known.__getitem__, ps)) for ps in parts]

    def encode(self, texts: list[str]) -> list[list[int]]:
        cut = [units(t) for t in texts]
        known = self.cache.lookup(cut)
        return [np.frombuffer(b"".join(map(known.__getitem__, us)), ID).tolist() for us in cut]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.ranks.bytes_of.__getitem__, ids))


_OUT = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
_IDS = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])
_TEXT = pa.schema([("doc_id", pa.int64()), ("text", pa.binary())])
#: Characters encoded in one go; a batch's ids would else be held at once.
GO = 1 << 20


def _goes(ids: pa.Array, texts: list[str]):
    at = 0
    while at < len(texts):
        to, n = at, 0
        while to < len(texts) and (to == at or n + len(texts[to]) <= GO):
            n += len(texts[to])
            to += 1
        yield ids.slice(at, to - at), texts[at:to]
        at = to


def encode(documents: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """(doc_id, ids array<int>) of each row; a null or empty text has no ids. ranks_path: a rank file that every worker can open."""
    prepare(documents.sparkSession)

    def run(batches):
        c = codec(ranks_path, pattern)
        for ids, texts in id_text(batches):
            for i, t in _goes(ids, texts):
                yield records(_IDS, doc_id=i, ids=c.encode(t))

    return text_rows(documents).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """(doc_id, text binary) of rows (doc_id, ids); null ids decode to no bytes. An id without a token raises KeyError."""

    def run(batches):
        c = codec(ranks_path, pattern)
        for b in batches:
            yield records(_TEXT, doc_id=b.column("doc_id"), text=[c.decode(x or []) for x in b.column("ids").to_pylist()])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text binary")


def round_trip(documents: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each row: encodes, then decodes the ids, and digests both in the same pass. Null and empty texts: no tokens, digests of nothing."""
    prepare(documents.sparkSession)

    def run(batches):
        c = codec(ranks_path, pattern)
        number = [str(i) for i in range(1 + max(c.ranks.bytes_of, default=0))]
        for ids, texts in id_text(batches):
            for i, t in _goes(ids, texts):
                n, a, b = [], [], []
                for x in c.encode(t):
                    n.append(len(x))
                    a.append(hashlib.sha256(",".join(map(number.__getitem__, x)).encode()).hexdigest())
                    b.append(hashlib.sha256(c.decode(x)).hexdigest())
                yield records(_OUT, doc_id=i, n_tokens=n, ids_sha256=a, decoded_sha256=b)

    return text_rows(documents).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def multi_50k() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"), *multi_50k())
