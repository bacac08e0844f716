"""Scoring by online logistic context mixing.

A text is a sequence of symbols, and each symbol a path of bits. Frequent words of the corpus are symbols of one
Huffman tree; any other word is the tree's escape symbol, followed by its bytes and an end mark in a second tree. For
each bit one predictor knows the node of the tree alone, with the counts of the symbols below it. Others look up a slot by
the hash of a context and of the node: for words the word before, and the two before; for bytes the last three,
and the last five. A slot gives the log odds of a 1 as counted over all training texts. A gated
set of weights (chosen by kind of symbol and by how sure the longer contexts are) mixes them, weights move with every bit, and an adaptive
correction by the mixed odds refines the result. The sum over all bits is the text's code length.

What is counted: words, over all training texts, by a shuffle; and slots, as arrays that tasks
add up chunk by chunk. The arrays have a fixed size, so contexts share slots where there are many; words are counted
exactly. Weights and corrections start the same for every block of BLOCK symbols (contexts cross blocks), so a score
depends on nothing but the text and the model, and blocks of many texts are mixed side by side.
"""

from __future__ import annotations

import heapq
import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from .common import drop_written, prepare, table, text_rows, written

#: Words that are symbols, at most; longer ones than WORD bytes never are.
WORDS, WORD = 1 << 17, 64
#: Predictors, the first of which has no context; the others have 2 ** SLOTS slots each.
ORDERS, HASHED, SLOTS = 3, 2, 22
CHUNK = 1 << 16
BLOCK = 128
#: What each predictor's odds weigh at the start of a block. Everything that is learned covers all training texts.
START = 0.4
RATE, REFINE, BUCKETS, GATES = 0.02, 0.04, 8, 18
#: Odds are kept in steps of 1 / STEP.
STEP = 15.0
#: Bytes of texts that are mixed together, types that a counting task holds, and symbols whose slots it counts at once.
GO, HELD, SORTED = 3 << 19, 400_000, 1 << 21
#: Symbols whose bits are looked up together, and blocks that are dealt to steps together, so few that their numbers stay in a processor's cache.
NEAR, DEALT = 1 << 13, 1 << 7
#: Steps of mixing whose numbers are unpacked together; a multiple of 8.
STEPS = 32
_MIX = np.uint64(0x9E3779B97F4A7C15)


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(lower-cased words of all texts, one after the other; how many each text has). texts: strings without nulls."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    flat, ends = lists.flatten(), lists.offsets.to_numpy()
    n = np.diff(ends).astype(np.int64)
    # white space at a text's ends leaves empty words there
    empty = np.flatnonzero(pc.equal(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False))
    if len(empty):
        n -= np.bincount(np.searchsorted(ends, empty + ends[0], side="right") - 1, minlength=len(n))
        flat = flat.filter(pc.greater(pc.binary_length(flat), 0))
    return flat, n


def as_strings(texts: list[bytes]) -> pa.Array:
    return pa.array(texts, pa.binary()).view(pa.string())


def _hash32(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * _MIX
    return ((x ^ (x >> np.uint64(32))) * _MIX >> np.uint64(32)).astype(np.uint32)


def code_lengths(counts: list[int]) -> np.ndarray:
    """Lengths of a Huffman code. Counts below a 2**24th of the sum are raised to it, so no code is long."""
    least = max(1, sum(counts) >> 24)
    heap = [(max(n, least), i) for i, n in enumerate(counts)]
    heapq.heapify(heap)
    parent, new = [0] * (2 * len(counts)), len(counts)
    while len(heap) > 1:
        a, i = heapq.heappop(heap)
        b, j = heap[0]
        parent[i] = parent[j] = new
        heapq.heapreplace(heap, (a + b, new))
        new += 1
    depth = [0] * new
    for i in range(new - 2, -1, -1):
        depth[i] = depth[parent[i]] + 1
    return np.maximum(np.array(depth[: len(counts)], np.int64), 1)


def paths(lengths: np.ndarray, counts: np.ndarray, tree: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(offset, bits, hashed nodes, odds of a 1) of the canonical code with these lengths; path i stands at offset[i]. Odds are those of the counts below a node."""
    order = np.lexsort((np.arange(len(lengths)), lengths))
    top = int(lengths.max())
    each = np.uint64(1) << (top - lengths[order]).astype(np.uint64)
    codes = np.empty(len(lengths), np.uint64)
    codes[order] = (np.cumsum(each) - each) >> (top - lengths[order]).astype(np.uint64)
    offset = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    of = np.repeat(np.arange(len(lengths)), lengths)
    depth = np.arange(len(of)) - offset[of]
    left = (lengths[of] - depth).astype(np.uint64)
    node = (np.uint64(1) << depth.astype(np.uint64)) | (codes[of] >> left)
    bit = (codes[of] >> (left - np.uint64(1)) & np.uint64(1)).astype(np.uint8)
    _, at = np.unique(node, return_inverse=True)
    below = np.bincount(2 * at + bit, np.maximum(counts, 0.5)[of], minlength=2 * (at.max() + 1))
    return offset, bit, _hash32(node * np.uint64(2) + np.uint64(tree)), odds(below)[at]


class Coder:
    """Texts to symbols, contexts and bits. words and counts: the symbols' words; rest: how often others are met; bytes_: counts of bytes and word ends in others."""

    def __init__(self, words: list[bytes], counts: np.ndarray, rest: int, bytes_: list[int]):
        self.vocab = as_strings(words)
        self.escape, self.byte = len(words), len(words) + 1
        self.log, self.known = np.log10(counts + 1.0), counts > 0
        first, second = np.array([*counts.tolist(), rest]), np.array(bytes_)
        lengths = code_lengths(first.tolist()), code_lengths(bytes_)
        a, b = paths(lengths[0], first, 0), paths(lengths[1], second, 1)
        self.length = np.concatenate(lengths)
        self.offset = np.concatenate((a[0], b[0] + len(a[1])))
        self.bits, self.nodes, self.odds = (np.concatenate((a[k], b[k])) for k in (1, 2, 3))
        # a bit's node, odds, and twice its lowest set of weights plus the bit, as one number
        tail = self.bits + np.repeat(np.uint8([18, 0]), [len(a[1]), len(b[1])])
        self.paths = self.nodes.astype(np.uint64) << np.uint64(32) | tail.astype(np.uint64) << np.uint64(24) | self.odds.view(np.uint8)

    def find(self, words: pa.Array) -> np.ndarray:
        """The symbol of each word, or -1."""
        return pc.index_in(words, value_set=self.vocab).fill_null(-1).to_numpy().astype(np.int64)

    def symbols(self, texts: list[bytes]) -> tuple:
        """(symbols, contexts (HASHED, n), symbols of each text, per text: tokens, known symbols' tokens, sum of log10(count + 1))."""
        flat, n = split_words(as_strings(texts))
        types = flat.dictionary_encode()
        each = pa.concat_arrays([types.dictionary, pa.array([""])])
        of = np.full(len(flat) + len(texts), len(each) - 1)  # the end is the last type
        of[np.arange(len(flat)) + np.repeat(np.arange(len(texts)), n)] = types.indices.to_numpy()
        n += 1
        found = self.find(each)
        # what stands before: words by number, rare ones by a hash, 0 before a text
        names, new = found.astype(np.uint64) + np.uint64(1), np.flatnonzero(found < 0)
        names[new] = np.fromiter(map(xxh3_64_intdigest, each.take(pa.array(new)).view(pa.binary()).to_numpy(zero_copy_only=False)), np.uint64, len(new))
        ids, name = found.take(of), names.take(of)
        rare = ids < 0
        first = np.cumsum(n) - n
        one, two = np.zeros(len(of), np.uint64), np.zeros(len(of), np.uint64)
        one[1:], two[2:] = name[:-1], name[:-2]
        one[first], two[first] = 0, 0
        two[(first + 1)[n > 1]] = 0
        odd = each.take(pa.array(of[rare]))
        ends = np.frombuffer(odd.buffers()[1], np.int32, len(odd) + 1).astype(np.int64)
        sizes = np.diff(ends) + 1
        width = np.ones(len(of), np.int64)
        width[rare] += sizes
        at = np.cumsum(width) - width
        total = int(width.sum())
        symbols = np.empty(total, np.int64)
        context = np.empty((HASHED, total), np.uint32)
        symbols[at] = np.where(rare, self.escape, ids)
        context[0, at] = _hash32(one * np.uint64(3) + np.uint64(1))
        context[1, at] = _hash32((one * _MIX + two) * np.uint64(3) + np.uint64(2))
        if len(odd):
            k = np.repeat(np.arange(len(odd)), sizes - 1)
            value = np.full(int(sizes.sum()), 256, np.int64)
            value[np.arange(len(k)) + k] = np.frombuffer(odd.buffers()[2] or b"", np.uint8, len(k))
            start = np.cumsum(sizes) - sizes
            to = np.arange(len(value)) + np.repeat(at[rare] + 1 - start, sizes)
            symbols[to] = self.byte + value
            last = np.zeros(len(value), np.uint64)
            last[1:] = value[:-1] + 1
            last[start] = 0
            before = last.copy()
            for back in range(2, 6):  # what stands before a byte is the last byte and what stands before that
                before[1:] = before[:-1] << np.uint64(9) | last[1:]
                before[start] = 0
                if back in (3, 5):
                    context[back // 4, to] = _hash32(before * np.uint64(4) + np.uint64(back))
        add = lambda x: np.add.reduceat(x, first) if len(x) else x
        known = np.zeros(len(each), np.int64)
        logs = np.zeros(len(each))
        old = found >= 0
        known[old], logs[old] = self.known[found[old]], self.log[found[old]]
        return symbols, context, add(width), n, add(known.take(of)), add(logs.take(of))

    def expand(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bits of each symbol, place in bits and nodes of each bit)."""
        length = self.length.take(symbols)
        at = self.offset.take(symbols) - (np.cumsum(length) - length)
        return length, np.arange(length.sum()) + np.repeat(at, length)


def slots(context: np.ndarray, nodes: np.ndarray, bits: int) -> np.ndarray:
    return (context ^ nodes) * np.uint32(0x9E3779B1) >> np.uint32(32 - bits)


def add_counts(coder: Coder, tables: np.ndarray, texts: list[bytes], bits: int) -> None:
    """Counts the bits of texts in tables (HASHED, 2 * 2**bits): a 0 and a 1 of each slot side by side."""
    symbols, context, *_ = coder.symbols(texts)
    add_symbols(coder, tables, symbols, context, bits)


def add_symbols(coder: Coder, tables: np.ndarray, symbols: np.ndarray, context: np.ndarray, bits: int) -> None:
    """Counts the bits of symbols in tables. Symbols that meet the same context more than once are told apart first, and the bits of each such pair are looked up once."""
    for k in range(HASHED):
        pairs = symbols.astype(np.uint64) << np.uint64(32) | context[k]
        pairs.sort()
        begins = np.flatnonzero(np.concatenate(([True], pairs[1:] != pairs[:-1]))) if len(pairs) else np.zeros(0, np.int64)
        times = np.diff(begins, append=len(pairs)).astype(np.int32)
        pairs = pairs.take(begins)
        for a in range(0, len(pairs), NEAR):
            some = pairs[a : a + NEAR]
            length, at = coder.expand((some >> np.uint64(32)).astype(np.int64))
            slot = slots(np.repeat(some.astype(np.uint32), length), coder.nodes.take(at), bits)
            np.add.at(tables[k], (slot << np.uint32(1) | coder.bits.take(at)).astype(np.intp), np.repeat(times[a : a + NEAR], length))


def odds(counts: np.ndarray) -> np.ndarray:
    """Log odds of a 1 as int8 in steps of 1 / STEP; few counts give small odds."""
    c = counts.reshape(-1, 2).astype(np.float32) + 0.4
    return np.clip(np.rint(np.log(c[:, 1] / c[:, 0]) * STEP), -127, 127).astype(np.int8)


def inputs(coder: Coder, tables: list[np.ndarray], symbols: np.ndarray, context: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(bits of each symbol, (n, 4) int8): of each bit the predictors' odds, and twice its set of weights plus the bit itself.

    The set is chosen by the kind of symbol and the sureness of the second and third predictor.
    """
    lengths = coder.length.take(symbols)
    x, o = np.empty((int(lengths.sum()), 4), np.int8), 0
    for a in range(0, len(symbols), NEAR):
        some = symbols[a : a + NEAR]
        length, at = coder.expand(some)
        path, y = coder.paths.take(at), x[o : o + len(at)]
        nodes, gate = (path >> np.uint64(32)).astype(np.uint32), np.zeros(len(at), np.int8)
        for k in range(HASHED):
            v = tables[k].take(slots(np.repeat(context[k, a : a + NEAR], length), nodes, bits).astype(np.intp))
            y[:, k + 1] = v
            v = np.abs(v)
            gate += ((v > 12).view(np.int8) + (v > 36).view(np.int8)) * np.int8(2 if k else 6)
        path = path.view(np.int8).reshape(-1, 8)
        y[:, 0] = path[:, 0]
        y[:, 3] = gate + path[:, 3]
        o += len(at)
    return lengths, x


def start_weights() -> np.ndarray:
    """(GATES, ORDERS + 1) weights and a bias of each set, with which a block starts: equal ones, learned from no text. They move with every bit."""
    return np.tile(np.array([START] * ORDERS + [0.0]), (GATES, 1))


def code_nats(coder: Coder, tables: list[np.ndarray], weights: np.ndarray, texts: list[bytes], bits: int) -> tuple:
    """(nats of each text, then what symbols() says of each text): bits of all blocks are mixed side by side, step by step."""
    symbols, context, size, *per = coder.symbols(texts)
    ends = np.cumsum(size)
    text_of = np.repeat(np.arange(len(texts)), size)
    begins = (np.arange(len(symbols)) - np.repeat(ends - size, size)) % BLOCK == 0
    block_text = text_of[begins]
    length, x = inputs(coder, tables, symbols, context, bits)
    n = np.add.reduceat(length, np.flatnonzero(begins)) if len(length) else length
    order = np.argsort(-n, kind="stable")
    rank = np.empty(len(n), np.int64)
    rank[order] = np.arange(len(n))
    active = np.searchsorted(-n[order], -np.arange(int(n.max(initial=0))), side="left")  # blocks with more bits than the step
    start = np.cumsum(active) - active
    packed, x, done = np.empty(len(x), np.int32), x.view(np.int32).ravel(), 0
    for a in range(0, len(n), DEALT):
        some = n[a : a + DEALT]
        upto = np.cumsum(some)
        step = np.arange(upto[-1]) - np.repeat(upto - some, some)
        packed[start.take(step) + np.repeat(rank[a : a + DEALT], some)] = x[done : done + upto[-1]]
        done += upto[-1]
    lanes, f = len(n), np.float32
    del x
    # odds are mixed in steps, so weights are divided by STEP. A set's weights and bias stand side by side, as one number of 16 bytes where they are only moved
    ws = np.tile((weights / ([STEP] * ORDERS + [1])).astype(f), (lanes, 1))
    sets = ws.view(np.complex128).ravel()
    refine = np.zeros(lanes * BUCKETS, f)
    base_g, base_b = np.arange(lanes) * GATES, np.arange(lanes) * BUCKETS
    nats, product = np.zeros(lanes), np.ones(lanes)
    moves = np.zeros((lanes, 4), f)  # a bias stays
    steps = list(zip(start.tolist(), active.tolist()))
    for t0 in range(0, len(steps), STEPS):
        some = steps[t0 : t0 + STEPS]
        first, most = some[0]
        part = packed[first : sum(some[-1])].view(np.int8).reshape(-1, 4)
        tails, values = part[:, 3], part.astype(f)
        values[:, 3] = 1
        # 1 for a 0 and -1 for a 1, so that odds and errors need no other sign
        signs, gates = (1 - (tails & 1) * 2).astype(f), (tails >> 1).astype(np.intp)
        for t, (o, a) in enumerate(some):
            o -= first
            s, at, v, e = signs[o : o + a], gates[o : o + a], values[o : o + a], moves[:a]
            at += base_g[:a]
            mine = sets.take(at)
            w = mine.view(f).reshape(a, 4)
            x = (w * v).view(np.complex64)
            x = x[:, 0] + x[:, 1]
            z = x.real + x.imag
            np.clip(z, f(-11), f(11), out=z)
            b = z + f(4)
            b = np.clip(b, f(0), f(BUCKETS - 1), out=b).astype(np.intp)
            b += base_b[:a]
            fix = refine.take(b)
            z += fix
            z *= s
            u = np.exp(z, out=z)
            q = u + f(1)
            product[:a] *= q
            error = np.multiply(np.divide(u, q, out=u), s, out=u)
            refine[b] = fix - f(REFINE) * error
            error *= f(-RATE / STEP**2)
            e[:, 0] = e[:, 1] = e[:, 2] = error
            w += np.multiply(v, e, out=v)
            sets[at] = mine
            if t % 8 == 7:  # odds of 8 bits stay far below the largest number
                nats[:most] += np.log(product[:most])
                product[:most] = 1
    nats += np.log(product)
    return np.bincount(block_text, nats[rank], minlength=len(texts)) if lanes else np.zeros(len(texts)), *per


def _texts(batches):
    for b in batches:
        yield b, b.column("text").cast(pa.binary()).to_pylist()


def _goes(texts: list[bytes], most: int):
    """Slices of texts of at most about so many bytes."""
    at = held = 0
    for k, t in enumerate(texts):
        if k > at and held + len(t) > most:
            yield at, k
            at, held = k, 0
        held += len(t)
    if at < len(texts):
        yield at, len(texts)


def word_counts(rows: DataFrame) -> DataFrame:
    """(word, n) over rows (text): each task adds up before the shuffle, and hands over what it holds at HELD words."""
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])
    out = pa.schema([("word", pa.binary()), ("n", pa.int64())])

    def together(held):
        return pa.concat_tables(held).group_by("word", use_threads=False).aggregate([("n", "sum")]).rename_columns(["word", "n"]) if held else schema.empty_table()

    def run(batches):
        held, size, ends = [], 0, 0
        for b in batches:
            flat, n = split_words(b.column("text"))
            found = flat.value_counts()
            held.append(pa.table([found.field(0), found.field(1)], schema=schema))
            size, ends = size + len(found), ends + len(n)
            if size > 2 * HELD:
                t = together(held)
                held, size = [t], len(t)
                if size > HELD:
                    yield from t.cast(out).to_batches(max_chunksize=1 << 16)
                    held, size = [], 0
        yield from together(held).cast(out).to_batches(max_chunksize=1 << 16)
        yield pa.RecordBatch.from_pydict({"word": [b""], "n": [ends]}, out)

    return rows.select("text").mapInArrow(run, "word binary, n long").where("n > 0").groupBy("word").agg(F.sum("n").alias("n"))


def frequent(counts: DataFrame, most: int = WORDS) -> tuple[list[bytes], list[int]]:
    """The words of at most WORD bytes whose count is at least a bound, 2 or more, with which there are no more than most; the end always. The bound comes from a histogram of counts in some thousand steps. Words met once teach how words that aren't symbols are spelled."""
    short = counts.where((F.octet_length("word") <= WORD) & (F.octet_length("word") > 0) & (F.col("n") > 1))
    shift = F.greatest(F.lit(0), F.length(F.bin("n")) - 8)
    step = F.call_function("shiftleft", F.call_function("shiftright", F.col("n"), shift), shift)
    least = upto = None
    for n, k in sorted((tuple(r) for r in short.groupBy(step.alias("s")).count().collect()), reverse=True):
        if (upto or 0) + k > most:
            break
        least, upto = n, (upto or 0) + k
    got = [] if least is None else [(bytes(r.word), r.n) for r in short.where(F.col("n") >= least).collect()]
    end = counts.where(F.octet_length("word") == 0).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    got = sorted([*got, (b"", end)], key=lambda x: (-x[1], x[0]))
    return [w for w, _ in got], [n for _, n in got]


def byte_counts(counts: DataFrame, least: int) -> list[int]:
    """Occurrences of each byte, then of word ends, in words that are no symbols (counted less often than least, or long), by their counts."""
    schema = pa.schema([("b", pa.list_(pa.float64()))])

    def run(batches):
        sums = np.zeros(257)
        for b in batches:
            data = b.column("word").to_pylist()
            n = b.column("n").to_numpy()
            for a, z in _goes(data, GO):
                sums[:256] += np.bincount(np.frombuffer(b"".join(data[a:z]), np.uint8), np.repeat(n[a:z], [len(w) for w in data[a:z]]), minlength=256)
            sums[256] += n.sum()
        yield pa.RecordBatch.from_pydict({"b": [sums.tolist()]}, schema)

    rare = counts.where((F.col("n") < least) | (F.octet_length("word") > WORD))
    sums = rare.mapInArrow(run, "b array<double>").select(F.posexplode("b").alias("i", "n")).groupBy("i").agg(F.sum("n").alias("n"))
    found = dict(tuple(r) for r in sums.collect())
    return [int(found.get(i, 0)) + 1 for i in range(257)]


@lru_cache(1)
def _coder(key: str, broadcast) -> tuple:
    m = broadcast.value
    return Coder(*m["coder"]), m.get("tables"), m.get("weights")


def slot_counts(rows: DataFrame, coder: tuple[str, object], bits: int) -> DataFrame:
    """(k, chunk, data): counts of all slots over rows (text), a compressed array for each chunk of slots. Tasks hand over their arrays; sums run over some tasks' first, then over all."""
    key, broadcast = coder
    schema = pa.schema([("k", pa.int32()), ("chunk", pa.int32()), ("some", pa.int32()), ("data", pa.binary())])
    kind = "k int, chunk int, some int, data binary"
    pack = lambda x: pa.compress(np.ascontiguousarray(x).tobytes(), codec="zstd", asbytes=True)

    def unpack(x, width):
        return np.frombuffer(pa.decompress(x, decompressed_size=2 * min(CHUNK, 1 << bits) * width, codec="zstd", asbytes=True), f"<i{width}")

    def count(batches):
        mine, *_ = _coder(key, broadcast)
        tables, any_, held, size = np.zeros((HASHED, 2 << bits), np.int32), False, [], 0

        def add_up():
            add_symbols(mine, tables, *(np.concatenate(x, axis=-1) for x in zip(*held)), bits)
            held.clear()

        for _, texts in _texts(batches):
            for a, z in _goes(texts, GO):
                symbols, context, *_ = mine.symbols(texts[a:z])
                held.append((symbols.astype(np.uint32), context))
                any_, size = True, size + len(symbols)
                if size >= SORTED:
                    add_up()
                    size = 0
        if held:
            add_up()
        task = TaskContext.get().partitionId() // 64
        chunks = tables.reshape(HASHED, -1, 2 * min(CHUNK, 1 << bits))
        for k in range(HASHED if any_ else 0):
            for c in range(chunks.shape[1]):
                yield pa.RecordBatch.from_pydict({"k": [k], "chunk": [c], "some": [task], "data": [pack(chunks[k, c].astype("<i8"))]}, schema)

    def add(batches):
        held: dict = {}
        for b in batches:
            for k, c, s, x in zip(*(b.column(n).to_pylist() for n in schema.names)):
                x = unpack(x, 8)
                held[k, c, s] = held[k, c, s] + x if (k, c, s) in held else x
        for (k, c, s), x in held.items():
            yield pa.RecordBatch.from_pydict({"k": [k], "chunk": [c], "some": [s], "data": [pack(x)]}, schema)

    first = rows.select("text").mapInArrow(count, kind).repartition("k", "chunk", "some").mapInArrow(add, kind)
    return first.withColumn("some", F.lit(0)).repartition("k", "chunk").mapInArrow(add, kind).select("k", "chunk", "data")


class Model:
    """What score() needs: n tokens, v types, counts (word, n) as a table, and a broadcast of fixed size."""

    def __init__(self, n: int, v: int, counts: DataFrame, key: str, broadcast, bits: int):
        self.n, self.v, self.counts, self.key, self.broadcast, self.bits = n, v, counts, key, broadcast, bits


def train(rows: DataFrame, bits: int = SLOTS, words: int = WORDS) -> Model:
    """A model of rows (doc_id, text). Words and slots are counted over all of them; nothing is learned from some only."""
    spark = rows.sparkSession
    counts = written(word_counts(rows), "words")
    n, v = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    symbols, times = frequent(counts, words)
    least = min([c for w, c in zip(symbols, times) if w], default=1 << 62)
    coder = (symbols, np.array(times), max(1, n - sum(times)), byte_counts(counts, least))
    key = counts._scratch
    first = spark.sparkContext.broadcast({"coder": coder})
    tables = [np.zeros(1 << bits, np.int8) for _ in range(HASHED)]
    size = min(CHUNK, 1 << bits)

    @F.pandas_udf("binary")
    def as_odds(data):
        return data.map(lambda x: odds(np.frombuffer(pa.decompress(x, decompressed_size=16 * size, codec="zstd", asbytes=True), "<i8")).tobytes())

    for r in slot_counts(rows, (key, first), bits).select("k", "chunk", as_odds("data").alias("x")).toLocalIterator():
        tables[r.k][r.chunk * size : (r.chunk + 1) * size] = np.frombuffer(r.x, np.int8)
    return Model(n, v, counts, key + "/full", spark.sparkContext.broadcast({"coder": coder, "tables": tables, "weights": start_weights()}), bits)


def score(rows: DataFrame, model: Model) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, n_known, base_score, score, bits_per_byte) of each row (doc_id, text), beside its other columns.

    base_score: words by themselves, with 1 added to every count; score: log10 of the text's probability by the mixed
    predictors. Words that are no symbols are joined with their exact counts by the word itself.
    """
    key, broadcast, bits = model.key, model.broadcast, model.bits
    extra = [c for c in rows.columns if c != "text"]
    rows = rows.withColumns({"_a": F.xxhash64("doc_id", "text"), "_b": F.xxhash64("text", "doc_id")})
    kind = rows.drop("text").schema
    add = [("_bytes", pa.int64(), "long"), ("_tokens", pa.int64(), "long"), ("_known", pa.int64(), "long"), ("_logs", pa.float64(), "double"), ("_nats", pa.float64(), "double")]

    def run(batches):
        coder, tables, weights = _coder(key, broadcast)
        for b, texts in _texts(batches):
            for a, z in _goes(texts, GO):
                nats, n, known, logs = code_nats(coder, tables, weights, texts[a:z], bits)
                new = [[len(t) for t in texts[a:z]], n, known, logs, nats]
                old = b.slice(a, z - a).drop_columns("text")
                yield pa.RecordBatch.from_arrays([*old.columns, *(pa.array(x, t) for x, (_, t, _) in zip(new, add))], names=[*old.schema.names, *(n for n, *_ in add)])

    words = pa.schema([("_a", pa.int64()), ("_b", pa.int64()), ("_row", pa.int64()), ("word", pa.binary()), ("m", pa.int64())])

    def rare(batches):
        coder = _coder(key, broadcast)[0]
        for b in batches:
            flat, n = split_words(b.column("text"))
            types = flat.dictionary_encode()
            of = types.indices.to_numpy()
            at = np.flatnonzero((coder.find(types.dictionary) < 0).take(of))
            found, m = np.unique(np.repeat(np.arange(len(n)), n)[at] * max(1, len(types.dictionary)) + of[at], return_counts=True)
            row, word = np.divmod(found, max(1, len(types.dictionary)))
            keys = [b.column(c).take(pa.array(row)) for c in ("_a", "_b", "_row")]
            yield pa.RecordBatch.from_arrays([*keys, types.dictionary.take(pa.array(word)).view(pa.binary()), pa.array(m, pa.int64())], schema=words)

    scored = rows.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kind), *(f"{n} {t}" for n, _, t in add)]))
    odd = rows.select("_a", "_b", F.monotonically_increasing_id().alias("_row"), "text").mapInArrow(rare, "_a long, _b long, _row long, word binary, m long")
    each = odd.join(model.counts, "word").groupBy("_a", "_b", "_row").agg(F.sum("m").alias("_more"), F.sum(F.col("m") * F.log10(F.col("n") + 1)).alias("_sum"))
    # rows that are equal in id and text have equal sums
    more = each.groupBy("_a", "_b").agg(F.max("_more").alias("_more"), F.max("_sum").alias("_sum"))
    out = scored.join(more, ["_a", "_b"], "left")
    base = F.col("_logs") + F.coalesce("_sum", F.lit(0.0)) - F.col("_tokens") * F.lit(math.log10(model.n + model.v + 1))
    nats = F.col("_nats")
    return out.select(*extra, F.col("_bytes").alias("n_bytes"), F.col("_tokens").alias("n_tokens"), (F.col("_known") + F.coalesce("_more", F.lit(0))).alias("n_known"), base.alias("base_score"), (-nats / math.log(10)).alias("score"), (nats / math.log(2) / F.greatest("_bytes", F.lit(1))).alias("bits_per_byte"))


def lm_scores(documents: DataFrame, bits: int = SLOTS, words: int = WORDS) -> DataFrame:
    """(doc_id, held_out, n_bytes, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte) of each row.

    Rows whose crc32 of the id, modulo 7, is 2 are held out; the model learns from all others, those without an id among
    them. Null and empty texts have the end as their only token; repeated rows are learned and scored each; an empty table
    gives no rows; other columns, whatever their names, are left behind.
    """
    prepare(documents.sparkSession)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")) % 7 == 2, F.lit(False))
    rows = text_rows(documents, held.alias("held_out"))
    model = train(rows.where(~F.col("held_out")).select("doc_id", "text"), bits, words)
    out = score(rows, model)
    return out.select("doc_id", "held_out", "n_bytes", "n_tokens", "n_known", F.lit(model.n).cast("long").alias("train_tokens"), "base_score", "score", "bits_per_byte")


def op13_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"))
