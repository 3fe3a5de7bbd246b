"""Operator 1: licence scan by patience alignment.

Texts and notices are compared as words (runs of letters and digits, lower case). Two word lists are aligned by
patience: words that occur once in each are anchors, the longest increasing subsequence of the anchors is kept, equal
words next to an anchor extend it, and the gaps between anchors are aligned in the same way. Coverage is the share of
a notice's words that are aligned; a notice is present if ``COVERAGE`` of them are.

Only places that can reach that are aligned. A notice with coverage c lacks a share 1 - c of its words at most, so any
set of its words that makes up more than that share (the ``cues``: its longest words) must be there in part. An
Aho-Corasick automaton finds the cues in the whole text. A hit says where the notice would start, and the notice is
aligned with the words there, a quarter of its length more on either side. Hits that give no notice are tried once more
in clusters, with a notice's length of words around them, where passages may have been put in. Reading goes on behind a
notice that was found.

Cases: null and empty texts hold no notice; a notice may occur many times; among notices whose spans overlap the one
with the most aligned words wins, then the higher coverage, then the first by name; a text of any length is read whole,
in time about proportional to its words and cue hits; repeated rows are rows like others; an empty table gives an empty
result; only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import bisect
import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import rows_of
from .license_texts import NOTICES

COVERAGE = 0.8

_WORD = re.compile(r"[^\W_]+")


def increasing(values: list[int]) -> list[int]:
    """Positions of a longest increasing subsequence, by patience sorting."""
    tops: list[int] = []
    ends: list[int] = []
    back = [-1] * len(values)
    for i, v in enumerate(values):
        k = bisect.bisect_left(tops, v)
        back[i] = ends[k - 1] if k else -1
        if k == len(tops):
            tops.append(v)
            ends.append(i)
        else:
            tops[k], ends[k] = v, i
    out, i = [], ends[-1] if ends else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Pairs of positions of equal words in ``a`` and ``b``, ascending in both."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        at: dict[str, list[int]] = {}
        for j in range(b0, b1):
            at.setdefault(b[j], []).append(j)
        seen: dict[str, int] = {}
        for i in range(a0, a1):
            seen[a[i]] = seen.get(a[i], 0) + 1
        single = [(i, at[a[i]][0]) for i in range(a0, a1) if seen[a[i]] == 1 and len(at.get(a[i], ())) == 1]
        if not single:
            continue
        pairs = [single[k] for k in increasing([j for _, j in single])]
        lo_a, lo_b = a0, b0
        for i, j in [*pairs, (a1, b1)]:
            todo.append((lo_a, i, lo_b, j))
            if i < a1 or j < b1:
                out.append((i, j))
            lo_a, lo_b = i + 1, j + 1
    return sorted(out)


class Notices:
    """Word lists of the notices, and the automaton of their cues."""

    def __init__(self, notices: dict[str, str], coverage: float = COVERAGE):
        self.coverage = coverage
        self.words = {name: [w.lower() for w in _WORD.findall(text)] for name, text in sorted(notices.items())}
        self.cues: dict[str, set[str]] = {}
        by_cue: dict[str, list[str]] = {}
        for name, words in self.words.items():
            most, cues = (1 - coverage) * len(words), set()
            for w in sorted(set(words), key=lambda w: (-len(w), w)):
                cues.add(w)
                if sum(x in cues for x in words) > most:
                    break
            self.cues[name] = cues
            for w in cues:
                by_cue.setdefault(w, []).append(name)
        self.by_cue = by_cue
        self.found = ahocorasick.Automaton()
        for w in by_cue:
            self.found.add_word(w, w)
        self.found.make_automaton()

    def scan(self, text: str) -> list[tuple[str, float, int, int, int]]:
        """``(name, coverage, aligned words, start, end)`` of the notices present, in order of their place."""
        low = text.lower()
        hits = {w for _, w in self.found.iter(low)}
        names = sorted({name for w in hits for name in self.by_cue[w]})
        if not names:
            return []
        # lower() may change a text's length, so words are cut from the text itself
        cut = [(m.start(), m.end(), m[0].lower()) for m in _WORD.finditer(text)]
        body = [w for _, _, w in cut]
        at: dict[str, list[int]] = {}
        for i, w in enumerate(body):
            if w in self.by_cue:
                at.setdefault(w, []).append(i)
        out = []
        for name in names:
            words, hits = self.words[name], sorted({i for w in self.cues[name] for i in at.get(w, ())})
            n = len(words)
            starts = sorted({i - o for i in hits for o, w in enumerate(words) if w == body[i]})
            tight = [(max(0, s - n // 4 - 1), s + n + n // 4 + 1) for s in starts]
            done = self._read(name, tight, body, cut, out)
            self._read(name, _clusters([i for i in hits if i not in done], n), body, cut, out)
        out.sort(key=lambda x: (-x[2], -x[1], x[0], x[3]))
        # the chosen ones don't overlap, so a place is free if the neighbours on either side leave it free
        chosen: list = []
        for x in out:
            k = bisect.bisect_left(chosen, x[3], key=lambda y: y[3])
            if (k == len(chosen) or x[4] <= chosen[k][3]) and (not k or chosen[k - 1][4] <= x[3]):
                chosen.insert(k, x)
        return chosen

    def _read(self, name: str, places: list[tuple[int, int]], body: list[str], cut: list, out: list) -> set[int]:
        """Align the notice with places in order; add what reaches the coverage to ``out``. Returns the words covered."""
        words, covered, done = self.words[name], set(), 0
        for lo, hi in places:
            lo = max(lo, done)
            if hi - lo < self.coverage * len(words):
                continue
            pairs = align(words, body[lo:hi])
            if len(pairs) >= self.coverage * len(words):
                # the place may have cut the notice off: once more with room around what was found
                wide = max(done, lo + pairs[0][1] - len(words) // 4 - 1), lo + pairs[-1][1] + len(words) // 4 + 2
                again = align(words, body[wide[0] : wide[1]])
                if len(again) > len(pairs):
                    lo, pairs = wide[0], again
                first, last = lo + pairs[0][1], lo + pairs[-1][1]
                out.append((name, len(pairs) / len(words), len(pairs), cut[first][0], cut[last][1]))
                covered.update(range(first, last + 1))
                done = last + 1
        return covered


def _clusters(hits: list[int], n: int) -> list[tuple[int, int]]:
    """Places around runs of hits that are no more than half a notice apart."""
    out: list[tuple[int, int]] = []
    for h in hits:
        if out and h - out[-1][1] <= n // 2 + 1:
            out[-1] = (out[-1][0], h)
        else:
            out.append((h, h))
    return [(max(0, a - n), b + n + 1) for a, b in out]


def op1(docs: DataFrame, notices: dict[str, str] = NOTICES, coverage: float = COVERAGE) -> DataFrame:
    """Per row: ``doc_id``, ``n_notices``, ``license`` (the first; null if none), ``coverage`` of it, ``spans``.

    ``spans`` joins ``name:start:end`` of all notices by commas, in code points, end exclusive.
    """
    model = docs.sparkSession.sparkContext.broadcast((notices, coverage))
    ready: list[Notices] = []

    def one(text: str | None) -> tuple:
        found = ready[0].scan(text) if text else []
        return (len(found), found[0][0] if found else None, found[0][1] if found else 0.0, ",".join(f"{x[0]}:{x[3]}:{x[4]}" for x in found))

    @F.arrow_udf("struct<n_notices:long,license:string,coverage:double,spans:string>")
    def run(texts: pa.Array) -> pa.Array:
        if not ready:
            ready.append(Notices(*model.value))
        return rows_of(["n_notices", "license", "coverage", "spans"], [pa.int64(), pa.string(), pa.float64(), pa.string()], (one(t.as_py()) for t in texts))

    return docs.select("doc_id", run("text").alias("p")).select("doc_id", "p.*")
