"""Removal of long repeated strings by column-wise multi-document construction.

A byte goes where a string of WIDTH bytes covers it that also starts elsewhere. Inserting
one byte of every whole document a round would rewrite the collection's transform as
often as the longest document is long. So the documents are cut into aligned collections first:

1. Of every window of WIDTH bytes the leftmost least hash of its GRAM-byte grams is its
   anchor. It depends on the window's bytes alone, so equal windows have equal anchors at equal
   places. Windows of one anchor make one string (at most 2 * WIDTH - GRAM bytes).
2. Anchors that occur once are dropped: their windows are unique.
3. The strings of an anchor's hash, aligned at the anchor, are built column by column from the
   right: each round inserts one symbol of every string, updates the sorted order of the
   suffixes (the collection's transform) and the common prefixes of neighbours. A window is repeated
   when its suffix shares WIDTH bytes with a neighbour. Columns need only the order and
   the prefixes of the column before; strings arrive as sorted shuffle files, in batches.
4. Anchors of more than HOT strings are dealt over several tasks. What stays unique in its task,
   and one string for each window found repeated, meet again by hashes (128 bits): of what the
   windows of a block share, of what those of its parts share, then of the windows.

Equal texts are found first by a hash of 128 bits; all windows of such a text are repeated.

One construction serves two widths: with short, anchors are those of windows of short bytes, and strings
reach on until the wide window of each start ends (or the text). Equal wide windows begin with equal
short ones, so they meet at one anchor, and the common prefix tells for either width.
"""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_written, prepare, records, table, written

WIDTH, GRAM, HOT = 400, 64, 512
#: Bytes of a passage of 50 words: 51 consecutive words take 233 bytes or more in 99 of 100 places of the given texts.
SHORT = 224
#: Window starts of a block, and of the parts that a block is looked at in next.
BLOCK, PART = 32, 4
#: Window starts handled at once, and strings of a column-wise batch.
PIECE, BATCH = 1 << 18, 30_000
_MULT = 0x9E3779B97F4A7C15 | 1


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(_MULT, -1, 1 << 64)
    with np.errstate(over="ignore"):
        up, down = (np.full(n, m, np.uint64) for m in (_MULT, inverse))
        up[0] = down[0] = 1
        return np.multiply.accumulate(up), np.multiply.accumulate(down)


_TABLES: dict = {}


def _tables(n: int):
    if _TABLES.get("n", 0) < n:
        _TABLES.update(n=n, powers=_powers(n), value=np.random.default_rng(11).integers(0, 1 << 64, 256, np.uint64))
    return _TABLES["powers"], _TABLES["value"]


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each run of w values, by block-wise running minima from both sides."""
    n = len(x)
    m = -(-n // w) * w
    padded = np.full(m, np.iinfo(x.dtype).max, x.dtype)
    padded[:n] = x
    left = np.minimum.accumulate(padded.reshape(-1, w), axis=1).ravel()
    right = np.minimum.accumulate(padded.reshape(-1, w)[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - w + 1], left[w - 1 : n])


def anchors(data: np.ndarray, width: int = WIDTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, place, first, last) of each anchor of a text's bytes: windows first .. last have it."""
    out: list = [[], [], [], []]
    for at in range(0, max(0, len(data) - width + 1), PIECE):
        part = data[at : at + PIECE + width - 1]
        (up, down), value = _tables(PIECE + width)
        with np.errstate(over="ignore"):
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value[part] * up[: len(part)], dtype=np.uint64)])
            h = (total[gram:] - total[:-gram]) * down[: len(part) - gram + 1]
            h ^= h >> np.uint64(31)
            h *= np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(29)
        places = np.arange(len(h), dtype=np.uint64)
        least = sliding_min((h & ~np.uint64((1 << 20) - 1)) | places, width - gram + 1)
        change = np.concatenate([[0], np.flatnonzero(np.diff(least)) + 1, [len(least)]])
        p = (least[change[:-1]] & np.uint64((1 << 20) - 1)).astype(np.int64)
        for o, v in zip(out, (h[p].view(np.int64), p + at, change[:-1] + at, change[1:] - 1 + at)):
            o.append(v)
    return tuple(np.concatenate(o) if o else np.zeros(0, np.int64) for o in out)


def columnwise(group: np.ndarray, bodies: list[bytes], begin: np.ndarray, widths: tuple[int, ...] = (WIDTH,), gram: int = GRAM, reps: bool = False) -> list[tuple[np.ndarray, np.ndarray | None]]:
    """For each width the marks of repeated windows: an array strings x columns of window starts, and with reps a second one that marks one string of each repeated window.

    group: numbers from 0, below 2**16, ascending. begin: column of a string's first byte, where the
    anchor stands at column min(widths) - gram.
    """
    n, lead = len(bodies), min(widths) - gram
    length = np.fromiter(map(len, bodies), np.int64, n)
    end = begin + length
    buf = np.frombuffer(b"".join(bodies), np.uint8)
    ptr = np.cumsum(length) - length - begin
    out = [(np.zeros((n, lead + 1), bool), np.zeros((n, lead + 1), bool) if reps else None) for _ in widths]
    g16 = group.astype(np.uint16)
    order, lcp = np.zeros(0, np.int64), np.zeros(0, np.int32)
    by_end = np.argsort(-end, kind="stable")
    joined = 0
    for c in range(int(end.max()) - 1, int(begin.min()) - 1, -1):
        upto = joined
        while upto < n and end[by_end[upto]] == c + 1:
            upto += 1
        if upto > joined:  # empty suffixes come first in their group
            order, lcp = np.concatenate([by_end[joined:upto], order]), np.concatenate([np.zeros(upto - joined, np.int32), lcp])
            k = np.argsort(g16[order], kind="stable")
            order, lcp = order[k], lcp[k]
            joined = upto
        if c < lead:
            gone = begin[order] > c
            if gone.any():  # a string without this column leaves; its neighbours share the lesser prefix
                keep = np.flatnonzero(~gone)
                if not len(keep):
                    order, lcp = order[:0], lcp[:0]
                    continue
                lcp = np.minimum.reduceat(lcp[: keep[-1] + 1], np.concatenate([[0], keep[:-1] + 1]))
                order = order[keep]
        if not len(order):
            continue
        symbol = buf[ptr[order] + c]
        k = np.argsort(symbol, kind="stable")
        k = k[np.argsort(g16[order[k]], kind="stable")]
        x, y = k[:-1], k[1:]
        same = (symbol[x] == symbol[y]) & (g16[order[x]] == g16[order[y]])
        new = np.zeros(len(order), np.int32)
        low = lcp[y]
        gap = y - x
        far = np.flatnonzero(same & (gap > 1))
        if len(far):  # least prefix between x and y, by doubling
            level, span, t = 0, 1, lcp
            lo, hi = x[far] + 1, y[far]
            need = np.frexp((hi - lo + 1).astype(np.float64))[1] - 1
            for level in range(int(need.max()) + 1):
                at = np.flatnonzero(need == level)
                if len(at):
                    low[far[at]] = np.minimum(t[lo[at]], t[hi[at] - span + 1])
                if level < need.max():
                    t = np.minimum(t[: len(t) - span], t[span:])
                    span *= 2
        new[1:] = np.where(same, low + 1, 0)
        order, lcp = order[k], new
        if c <= lead:
            after = np.concatenate([lcp[1:], [0]])
            for width, (marks, first) in zip(widths, out):
                marks[order, c] = (lcp >= width) | (after >= width)
                if reps:
                    first[order, c] = (lcp < width) & (after >= width)
    return out


_ANCHOR = pa.schema([(n, pa.int64()) for n in ("t1", "t2", "h", "p", "a", "b")])
_STRING = pa.schema([("h", pa.int64()), ("n", pa.int64()), ("t1", pa.int64()), ("t2", pa.int64()), ("p", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("size", pa.int64()), ("body", pa.binary())])
_PART = pa.struct([("core", pa.binary()), ("windows", pa.list_(pa.binary())), ("starts", pa.list_(pa.int64()))])
_FOUND = pa.schema([("t1", pa.int64()), ("t2", pa.int64()), ("w", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("core", pa.binary()), ("parts", pa.list_(_PART))])
_LONGS = "t1 long, t2 long, "


def _digest(data) -> bytes:
    from xxhash import xxh3_128_digest

    return xxh3_128_digest(data)


def _core(body: bytes, c0: int, number: int, size: int, width: int) -> bytes:
    """Hash of what all windows of a block share. A string whose first window is c0 has all of it as soon as one of its windows is in the block; equal windows agree in it."""
    lo, hi = number * size - c0, (number + 1) * size - 1 - c0
    return _digest(body[hi : lo + width] + number.to_bytes(2, "little"))


def _runs(row: np.ndarray) -> list[tuple[int, int]]:
    """First and last of each run of set columns."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], row.astype(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), (edge[1::2] - 1).tolist()))


def text_key(text: Column) -> list[Column]:
    """The two halves of a text's hash."""
    return [F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(7), text).alias("t2")]


def repeated_windows(documents: DataFrame, width: int = WIDTH, gram: int = GRAM, hot: int = HOT, short: int | None = None) -> DataFrame:
    """(t1, t2, copies, spans, short_spans) of texts that have copies or spans. spans: a flat array of first and last starts of repeated windows of width bytes; short_spans: of short bytes, null without short. t1, t2: see text_key; a null text is empty."""
    spark = documents.sparkSession
    prepare(spark)
    widths = (width,) if short is None else (width, short)
    base = min(widths)
    lead = base - gram
    text = F.coalesce(F.col("text"), F.lit(""))
    plain = documents.select(*text_key(text), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**62))).alias("id"), text.alias("text")).where(F.octet_length("text") >= base)
    copies = written(plain.groupBy("t1", "t2").agg(F.count("*").alias("copies"), F.min("id").alias("id")), "copies")

    def find(batches):
        for b in batches:
            for t1, t2, t in zip(b.column("t1").to_pylist(), b.column("t2").to_pylist(), b.column("text")):
                h, p, a, z = anchors(np.frombuffer(t.as_buffer(), np.uint8), base, gram)
                yield records(_ANCHOR, t1=np.full(len(h), t1), t2=np.full(len(h), t2), h=h, p=p, a=a, b=z)

    # one row of equal texts is enough: the others have its windows
    found = written(plain.mapInArrow(find, "t1 long, t2 long, h long, p long, a long, b long").distinct(), "anchors")
    # a table of its own, so that the join below can split a frequent anchor's rows over tasks
    often = written(found.groupBy("h").agg(F.count("*").alias("n")).where("n > 1"), "often")
    wanted = found.join(often, "h").groupBy("t1", "t2").agg(F.collect_list(F.array("h", "n", "p", "a", "b")).alias("at"))
    wanted = written(wanted.join(copies.select("t1", "t2", "id"), ["t1", "t2"]), "wanted")
    # most anchors occur once: their table needn't stay beside the strings
    drop_written(found)
    drop_written(often)

    def cut(batches):
        for b in batches:
            rows: list = []
            size = 0
            for t1, t2, at, t in zip(b.column("t1").to_pylist(), b.column("t2").to_pylist(), b.column("at").to_pylist(), b.column("text")):
                data = t.as_buffer().to_pybytes()
                times = Counter(x[0] for x in at)
                seen: dict = {}
                for h, n, p, a, z in at:
                    body = data[a : z + width]
                    if times[h] > 1:  # equal strings within a text (periods) are settled here, and one goes on
                        key = (h, a - p, body)
                        if key in seen:
                            rows.append((h, n, t1, t2, p, a, z, len(body), None))
                            if seen[key]:
                                rows.append((h, n, t1, t2, *seen[key], len(body), None))
                                seen[key] = None
                            continue
                        seen[key] = (p, a, z)
                    rows.append((h, n, t1, t2, p, a, z, len(body), body))
                    size += len(body)
                    if size > 4 << 20:
                        yield records(_STRING, **{c: [r[i] for r in rows] for i, c in enumerate(_STRING.names)})
                        rows, size = [], 0
            yield records(_STRING, **{c: [r[i] for r in rows] for i, c in enumerate(_STRING.names)})

    strings = plain.join(wanted, ["t1", "t2", "id"]).select("t1", "t2", "at", "text").mapInArrow(cut, "h long, n long, t1 long, t2 long, p long, a long, b long, size long, body binary")
    salt = F.pmod(F.xxhash64("t1", "t2", "a"), F.greatest(F.lit(1), F.ceil(F.col("n") / hot)).cast("long"))
    dealt = strings.withColumn("salt", salt).repartition("h", "salt").sortWithinPartitions("h", "salt")

    def solve(held: list):
        t = pa.Table.from_batches(held)
        done = t.column("body").is_null().to_numpy() if t.num_rows else np.zeros(0, bool)
        t1, t2, a, b, p, n, size = (t.column(c).to_numpy() for c in ("t1", "t2", "a", "b", "p", "n", "size"))
        out = {c: [] for c in _FOUND.names}

        def put(i, w, x, y, core=None, parts=None):
            for c, v in zip(_FOUND.names, (t1[i], t2[i], w, x, y, core, parts)):
                out[c].append(v)

        for i in np.flatnonzero(done).tolist():
            for w in widths:  # starts whose window of w bytes ends within the string
                last = min(b[i], a[i] + size[i] - w)
                if last >= a[i]:
                    put(i, w, a[i], last)
        live = np.flatnonzero(~done)
        if len(live):
            h, s = t.column("h").to_numpy()[live], t.column("salt").to_numpy()[live]
            g = np.cumsum(np.concatenate([[0], (h[1:] != h[:-1]) | (s[1:] != s[:-1])]))
            column = t.column("body").take(live)
            bodies = [x.as_buffer().to_pybytes() for x in column]
            busy = n[live] > hot
            alone = np.bincount(g)[g] == 1
            pick = np.flatnonzero(~alone)
            start = a[live] - p[live] + lead
            reps = bool(busy.any())
            solved = []
            if len(pick):
                _, g2 = np.unique(g[pick], return_inverse=True)
                solved = columnwise(g2, [bodies[i] for i in pick], start[pick], widths, gram, reps)
            for k, w in enumerate(widths):
                marks = np.zeros((len(live), lead + 1), bool)
                first = np.zeros_like(marks) if reps else None
                if solved:
                    marks[pick] = solved[k][0]
                    if reps:
                        first[pick] = solved[k][1]
                for r in np.flatnonzero(marks.any(1)).tolist():
                    i = live[r]
                    for x, y in _runs(marks[r]):
                        put(i, w, x - lead + p[i], y - lead + p[i])
                for r in np.flatnonzero(busy).tolist():
                    i, body, c0 = live[r], bodies[r], int(start[r])
                    c1 = min(c0 + int(b[i] - a[i]), c0 + len(body) - w)
                    if c1 < c0:
                        continue
                    at = np.flatnonzero(first[r, c0 : c1 + 1] | ~marks[r, c0 : c1 + 1]) + c0
                    for block in np.unique(at // BLOCK).tolist():
                        cs = at[at // BLOCK == block]
                        inside = []
                        for part in np.unique(cs // PART).tolist():
                            ws = cs[cs // PART == part].tolist()
                            inside.append({"core": _core(body, c0, part, PART, w), "windows": [_digest(body[c - c0 : c - c0 + w]) for c in ws], "starts": [c - lead + int(p[i]) for c in ws]})
                        put(i, w, None, None, _core(body, c0, block, BLOCK, w), inside)
        return records(_FOUND, **out)

    def build(batches):
        held, rows, size = [], 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            rows, size = rows + batch.num_rows, size + batch.nbytes
            if rows >= BATCH or size > 24 << 20:
                whole = pa.Table.from_batches(held).combine_chunks()
                h, s = whole.column("h").to_numpy(), whole.column("salt").to_numpy()
                edge = np.flatnonzero((h[1:] != h[:-1]) | (s[1:] != s[:-1])) + 1
                if len(edge):
                    yield solve(whole.slice(0, int(edge[-1])).to_batches())
                    held = whole.slice(int(edge[-1])).combine_chunks().to_batches()
                    rows, size = sum(x.num_rows for x in held), sum(x.nbytes for x in held)
        if held:
            yield solve(held)

    parts = written(dealt.mapInArrow(build, _LONGS + "w long, a long, b long, core binary, parts array<struct<core:binary,windows:array<binary>,starts:array<long>>>"), "found")
    drop_written(wanted)
    spans = parts.where("a is not null").select("t1", "t2", "w", "a", "b")
    open_ = parts.where("core is not null").select("t1", "t2", "w", "core", "parts")
    if not open_.isEmpty():
        # windows of a core that only one string has are unique; the others go on, part by part
        def met(rows: DataFrame, key: str) -> DataFrame:
            shared = written(rows.groupBy(key).agg(F.count("*").alias("c")).where("c > 1").select(key), "met")  # a table of its own, so that a frequent key's rows can be split
            return rows.join(shared, key, "left_semi")

        inside = written(met(open_, "core").select("t1", "t2", "w", F.explode("parts").alias("x")).select("t1", "t2", "w", "x.core", "x.windows", "x.starts"), "parts")
        rows = met(inside, "core").select("t1", "t2", "w", F.explode(F.arrays_zip("windows", "starts")).alias("x")).select("t1", "t2", "w", F.col("x.windows").alias("window"), F.col("x.starts").alias("a"))
        rows = written(rows, "windows")
        spans = spans.unionByName(met(rows, "window").select("t1", "t2", "w", "a", F.col("a").alias("b")))
    flat = lambda w: F.flatten(F.collect_set(F.when(F.col("w") == w, F.array("a", "b"))))
    grouped = spans.groupBy("t1", "t2").agg(flat(width).alias("spans"), (flat(short) if short is not None else F.lit(None).cast("array<long>")).alias("short_spans"))
    return copies.where("copies > 1").select("t1", "t2", "copies").join(grouped, ["t1", "t2"], "full")


def removed(n_bytes: int, copies, spans, width: int = WIDTH) -> list[tuple[int, int]]:
    """Maximal removed runs (begin, end) of a text."""
    if n_bytes >= width and copies is not None and copies > 1:
        return [(0, n_bytes)]
    if spans is None or not len(spans):
        return []
    out: list[list[int]] = []
    for a, b in sorted(zip(spans[::2], spans[1::2])):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], int(b) + width)
        else:
            out.append([int(a), int(b) + width])
    return [(a, b) for a, b in out]


def kept(data: bytes, runs: list[tuple[int, int]]) -> bytes:
    at, parts = 0, []
    for a, b in runs:
        parts.append(data[at:a])
        at = b
    return b"".join([*parts, data[at:]])


def _joined(documents: DataFrame, width: int, short: int | None = None) -> DataFrame:
    """(row, t1, t2, copies, spans, short_spans) of each row; row holds documents' columns, whatever their names. The join is an outer one, so adaptive execution may deal the many rows of one text over tasks."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row"), *text_key(text))
    return base.join(repeated_windows(documents, width, short=short), ["t1", "t2"], "left")


def repeat_report(documents: DataFrame, width: int = WIDTH, short: int | None = None) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of each row; with short also n_short, the bytes in strings of short bytes that occur again, and repeated, whether there are any.

    A null text is empty; texts shorter than width lose nothing; repeated rows are copies of
    each other. Rows keep their ids, null ones too.
    """

    @F.pandas_udf("n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_short long")
    def digest(text, copies, spans, short_spans):
        import pandas as pd

        rows = []
        for t, c, s, f in zip(text, copies, spans, short_spans):
            data = (t or "").encode("utf-8", "surrogatepass")
            c = None if pd.isna(c) else c
            runs = removed(len(data), c, s, width)
            few = 0 if short is None else sum(b - a for a, b in removed(len(data), c, f, short))
            rows.append((len(data), sum(b - a for a, b in runs), len(runs), hashlib.sha256(kept(data, runs)).hexdigest(), few))
        return pd.DataFrame(rows, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256", "n_short"])

    rows = _joined(documents.select("doc_id", "text"), width, short)
    out = rows.select(F.col("row.doc_id").cast("long").alias("doc_id"), digest("row.text", "copies", "spans", "short_spans").alias("d")).select("doc_id", "d.*")
    return out.drop("n_short") if short is None else out.withColumn("repeated", F.col("n_short") > 0)


def remove_repeats(documents: DataFrame, width: int = WIDTH) -> DataFrame:
    """documents with the repeated bytes cut out of text; other columns stay. A character of which some byte stays, stays whole; a text that loses all is empty; a null text stays null."""

    @F.pandas_udf("string")
    def cut(text, copies, spans):
        import pandas as pd

        out = []
        for t, c, s in zip(text, copies, spans):
            data = (t or "").encode("utf-8", "surrogatepass")
            runs = []
            for a, b in removed(len(data), None if pd.isna(c) else c, s, width):
                while a < b and a < len(data) and data[a] & 0xC0 == 0x80:
                    a += 1
                while b > a and b < len(data) and data[b] & 0xC0 == 0x80:
                    b -= 1
                runs.append((a, b))
            out.append(kept(data, runs).decode("utf-8", "replace") if runs else t)
        return pd.Series(out, dtype=object)

    rows = _joined(documents, width).select("row", cut("row.text", "copies", "spans").alias("kept"))
    return rows.select(*[F.col("kept").alias(c) if c.lower() == "text" else F.col(f"row.`{c}`").alias(c) for c in documents.columns])


def op3_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeat_report(table(spark, sf_dir, "documents"), short=SHORT)
