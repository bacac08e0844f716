"""Safe cuts for byte-level BPE texts, as Arrow arrays from the texts to the ids.

The cuts are those of units and two more kinds: before a line's end, and between a letter
or digit and ASCII punctuation behind it. No pre-token goes across either, and what the
pre-tokenizer does with a piece doesn't depend on what stands around it. Cuts are found in the
column's bytes, and pieces that a worker has met are found by Arrow's dictionary, so
that no Python object is made for a word.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .units import _RARE, LONGEST, units

_BLANK, _LINE = 0x20, 0x0A
#: Kinds of bytes: 1 white space (of texts that aren't odd), 2 ASCII punctuation, 3 ASCII letters and digits.
_KIND = np.zeros(256, np.uint8)
_KIND[[_BLANK, _LINE]] = 1
_KIND[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = 2
_KIND[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = 3


def odd_texts(added: list[str]) -> str:
    """A pattern of texts that hold white space besides blanks and line ends, or one of the added tokens."""
    return "|".join([f"[{''.join(_RARE)}]", *map(re.escape, added)])


def strings(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets, from 0, and bytes of an array of large strings without nulls."""
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    return at - at[0], np.frombuffer(data or b"", np.uint8)[at[0] : at[-1]]


def large(offsets: np.ndarray, data, kind: pa.DataType) -> pa.Array:
    return pa.Array.from_buffers(kind, len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(data)])


def plain_pieces(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Pieces of texts that aren't odd (large strings without nulls), and how many of them stand before each text and the end."""
    ends, data = strings(texts)
    starts = np.zeros(len(data) + 1, bool)
    if len(data):
        kind = _KIND[data]
        space = np.flatnonzero(kind == 1)
        before, after = kind[np.maximum(space - 1, 0)] != 1, kind[np.minimum(space + 1, len(data) - 1)] != 1
        starts[space[before & (after | (data[space] == _LINE))]] = True
        mark = np.flatnonzero(kind == 2)
        last = data[np.maximum(mark - 1, 0)]
        # À to ÿ without × and ÷ are letters in every version of Unicode
        latin = (data[np.maximum(mark - 2, 0)] == 0xC3) & (last >= 0x80) & (last != 0x97) & (last != 0xB7)
        starts[mark[(_KIND[last] == 3) | latin]] = True
    starts[ends] = True
    at = np.flatnonzero(starts)
    return large(at, data, pa.large_string()), np.searchsorted(at, ends)


def pieces(texts: pa.Array, odd: str) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Pieces of texts (large strings without nulls), the order in which texts' pieces stand, and how many pieces stand before each text of that order and the end. Odd texts stand last and are cut into units only."""
    is_odd = pc.match_substring_regex(texts, odd).to_numpy(zero_copy_only=False)
    first, then = np.flatnonzero(~is_odd), np.flatnonzero(is_odd)
    plain, upto = plain_pieces(texts.take(pa.array(first)) if len(then) else texts)
    if not len(then):
        return plain, first, upto
    cut = [units(t) for t in texts.take(pa.array(then)).to_pylist()]
    more = upto[-1] + np.cumsum([len(us) for us in cut])
    both = pa.concat_arrays([plain, pa.array([u for us in cut for u in us], pa.large_string())])
    return both, np.concatenate([first, then]), np.concatenate([upto, more])


def joinable(found: pa.Array, odd: str) -> np.ndarray:
    """Which pieces may stand side by side: one white space at their head and none at either side of it or at their end, so that each one's head is a cut."""
    ends, data = strings(found)
    sizes, odd_ones = np.diff(ends), pc.match_substring_regex(found, odd).to_numpy(zero_copy_only=False)
    if not len(data):
        return np.zeros(len(found), bool)
    head, second, last = (data[np.clip(at, 0, len(data) - 1)] for at in (ends[:-1], ends[:-1] + 1, ends[1:] - 1))
    return ~odd_ones & (sizes > 1) & (_KIND[head] == 1) & (second > _BLANK) & (last > _BLANK)


class PieceTable:
    """What each piece becomes, kept by a worker as Arrow arrays. encode gets distinct pieces that are not kept and returns as many outcomes (large binaries).

    When more than kept pieces are held, the half of kept that was met most often stays, and counts are halved, so that
    newer pieces come to stand before those met long ago. Pieces of over LONGEST bytes are not kept.
    """

    def __init__(self, encode: Callable[[pa.Array], pa.Array], kept: int):
        self.encode, self.kept = encode, kept
        self.pieces, self.outcomes = pa.array([], pa.large_string()), pa.array([], pa.large_binary())
        self.met = np.zeros(0, np.int64)

    def take(self, found: pa.Array) -> pa.Array:
        """The outcome of each piece."""
        known, types = len(self.pieces), found.dictionary_encode()
        held = pa.concat_arrays([self.pieces, types.dictionary]).dictionary_encode()
        # kept pieces are distinct and stand first, so their numbers are their places
        at, unseen = held.indices[known:], held.dictionary[known:]
        outcomes = pa.concat_arrays([self.outcomes, self.encode(unseen)]) if len(unseen) else self.outcomes
        met = np.zeros(len(outcomes), np.int64)
        met[at.to_numpy()] = np.bincount(types.indices.to_numpy(), minlength=len(at))
        self._keep(held.dictionary, outcomes, met)
        return outcomes.take(at).take(types.indices)

    def _keep(self, held: pa.Array, outcomes: pa.Array, met: np.ndarray) -> None:
        met[: len(self.met)] += self.met
        short = np.diff(strings(held)[0]) <= LONGEST
        if len(held) > self.kept:
            half = max(1, self.kept // 2)
            order = np.argpartition(np.where(short, met, -1), len(met) - half)[-half:]
            stay = np.sort(order[short[order]])
            met >>= 1
        elif not short.all():
            stay = np.flatnonzero(short)
        else:
            self.pieces, self.outcomes, self.met = held, outcomes, met
            return
        self.pieces, self.outcomes, self.met = held.take(pa.array(stay)), outcomes.take(pa.array(stay)), met[stay]
