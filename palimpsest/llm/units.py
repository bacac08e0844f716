"""Safe cuts for byte-level BPE texts.

In the pre-tokenizer pattern a blank may stand only at the head of a word, and runs of
white space are matched by themselves. So a single blank between two characters that are
not white space always begins a new pre-token: cutting before it changes no token. The
pieces between such cuts (units) repeat a lot, so each worker encodes a unit once and
keeps the outcome in a bounded table.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from itertools import chain

#: A blank between two characters that Python counts as no white space. Python's set holds all of the tokenizers' white space.
CUT = re.compile(r"(?<=\S) (?=\S)")
#: Units kept per worker, and the longest unit kept.
KEPT, LONGEST = 400_000, 64
#: A word of letters that every version of Unicode has, with ASCII punctuation behind it and nothing more: two pre-tokens.
PUNCTUATED = re.compile(r" ?[A-Za-zÀ-ÖØ-öø-ÿ]++(?=[!-/:-@\[-^`{-~]++\Z)")
_NEXT_TO_BLANK = re.compile(r"\s | \s")
#: All other characters that count as white space.
_RARE = [c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n"]


def all_blanks_cut(text: str) -> bool:
    """Whether every blank of a text that isn't empty stands between two characters that are no white space."""
    if text[0] == " " or text[-1] == " ":
        return False
    if any(c in text for c in _RARE):
        return not _NEXT_TO_BLANK.search(text)
    return "  " not in text and " \n" not in text and "\n " not in text


def units(text: str) -> list[str]:
    """text, cut before each safe blank; every unit but the first begins with its blank."""
    if not text:
        return []
    if all_blanks_cut(text):
        if "\0" not in text:  # the quickest way to keep each blank
            return text.replace(" ", "\0 ").split("\0")
        parts = text.split(" ")
    else:
        parts = CUT.split(text)
    return [parts[0], *(" " + p for p in parts[1:])]


def punctuation_at(unit: str) -> int:
    """Where the punctuation begins if the unit is a word and punctuation, else 0."""
    if unit[-1].isalpha():
        return 0
    m = PUNCTUATED.match(unit)
    return m.end() if m else 0


class UnitCache:
    """Per-worker outcome of each unit, in two generations. encode gets a list of distinct unseen units and returns as many outcomes.

    Units that are met move to the young generation; when that has half of kept, it becomes
    the old one and the units that were not met since are forgotten. cut(unit) is a place at which an unseen unit
    may be cut, so that its outcome is the sum of both parts' outcomes, or 0; parts are kept as well and never cut.
    """

    def __init__(self, encode: Callable[[list[str]], list], kept: int = KEPT, cut: Callable[[str], int] | None = None):
        self.encode, self.half, self.cut = encode, max(1, kept // 2), cut
        self.young, self.old, self.passing = {}, {}, []

    def _turn(self) -> None:
        for u in self.passing:
            del self.young[u]
        self.passing = []
        if len(self.young) > self.half:
            self.young, self.old = {}, self.young

    def _add(self, missing: set[str]) -> None:
        young, old, cut = self.young, self.old, self.cut
        back = old.keys() & missing
        young.update(zip(back, map(old.__getitem__, back)))
        unseen, pairs, parts = list(missing - back), [], set()
        if cut:
            found, unseen = unseen, []
            for u in found:
                if at := cut(u):
                    head, tail = u[:at], u[at:]
                    pairs.append((u, head, tail))
                    parts.add(head)
                    parts.add(tail)
                else:
                    unseen.append(u)
        for u in parts - missing - young.keys():
            if u in old:
                young[u] = old[u]
            else:
                unseen.append(u)
        if unseen:
            young.update(zip(unseen, self.encode(unseen), strict=True))
        for u, head, tail in pairs:
            young[u] = young[head] + young[tail]
        self.passing = [u for u in chain(unseen, (p[0] for p in pairs)) if len(u) > LONGEST]

    def lookup(self, lists: list[list[str]]) -> dict:
        """A table that has every unit of lists, valid until the next call."""
        self._turn()
        self._add(set().union(*lists) - self.young.keys())
        return self.young

    def outcomes(self, lists: list[list[str]]) -> list[list]:
        """The outcomes of each list's units, none of which may be None: one look at the table for each unit, and a second for those it lacked."""
        self._turn()
        get = self.young.get
        out = [list(map(get, us)) for us in lists]
        holes = [[i for i, v in enumerate(vs) if v is None] for vs in out]
        self._add({us[i] for us, at in zip(lists, holes) for i in at})
        for us, vs, at in zip(lists, out, holes):
            for i in at:
                vs[i] = get(us[i])
        return out
