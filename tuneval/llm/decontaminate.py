"""Benchmark decontamination by pigeonhole edit matching.

Test items and documents are compared as lower-case words joined by single
spaces (letters and digits of any script; punctuation and layout do not
count); letters of scripts without spaces follow each other directly. An item of m characters may differ in k = floor(m * rate) edits. Cut
into k + 1 pieces, at least one piece of any match is untouched: one
Aho-Corasick pass finds the exact piece hits, and Myers' bit-parallel
distance verifies the text around them. Items too short for an edit and of few words are found
as whole words only.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import ahocorasick
from pyspark.sql import DataFrame, functions as F

from .common import keep_rows, per_text

EDIT_RATE = 0.05
LONE_LETTERS = 4            # a single word of fewer letters matches nothing (a letter without spaces counts twice)
WHOLE_WORDS = 5             # items of fewer words and no edit budget match whole words only
BLOCK_CHARS = 8_000_000     # of test items, broadcast at a time

_TOKEN = re.compile(r"[^\W_]+")
# Thai, Lao, Tibetan, Myanmar, Khmer; kana, Bopomofo, Han, half-width kana; further Han.
_DENSE = "\u0e00-\u0fff\u1000-\u109f\u1780-\u17ff\u2e80-\u2fdf\u3005-\u312f\u31a0-\u31ff\u3400-\u4dbf\u4e00-\u9fff" \
         "\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff"
_DENSE_LETTER = re.compile(f"[{_DENSE}]")
_DENSE_GAP = re.compile(f"(?<=[{_DENSE}]) (?=[{_DENSE}])")
MATCH = "array<struct<item_id:long,distance:int,start:int,end:int>>"


def joined(words: list) -> str:
    t = " ".join(words)
    return t if t.isascii() or not _DENSE_LETTER.search(t) else _DENSE_GAP.sub("", t)


def normal(text: str) -> str:
    return joined(_TOKEN.findall(text.lower()))


@dataclass(frozen=True)
class Item:
    item_id: int
    text: str
    budget: int

    @property
    def whole(self) -> bool:
        """Whether only whole words match."""
        return not self.budget and self.text.count(" ") + 1 < WHOLE_WORDS

    def pieces(self):
        """(offset, piece): budget + 1 pieces of nearly equal length."""
        n, m = self.budget + 1, len(self.text)
        cuts = [m * i // n for i in range(n + 1)]
        return [(a, self.text[a:b]) for a, b in zip(cuts, cuts[1:])]


def item_of(item_id, text: str | None, rate: float = EDIT_RATE) -> Item | None:
    t = normal(text or "")
    if not t or " " not in t and len(t) + len(_DENSE_LETTER.findall(t)) < LONE_LETTERS:
        return None
    return Item(item_id, t, int(len(t) * rate))


def myers(pattern: str, text: str, budget: int):
    """Best semi-global match: (distance, end) with the least distance of the
    pattern to a substring of the text ending at ``end``, the first of equals;
    None if it exceeds the budget. One machine word per 30 pattern
    characters of Python's integers, whatever the pattern's length."""
    m = len(pattern)
    mask, high = (1 << m) - 1, 1 << (m - 1)
    peq: dict = {}
    for i, c in enumerate(pattern):
        peq[c] = peq.get(c, 0) | (1 << i)
    pv, mv, score = mask, 0, m
    best, at = (m, 0) if m <= budget else (budget + 1, -1)
    for j, c in enumerate(text):
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (~(xh | pv) & mask)
        mh = pv & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
        ph = (ph << 1) & mask
        pv = ((mh << 1) & mask) | (~(xv | ph) & mask)
        mv = ph & xv
        if score < best:
            best, at = score, j + 1
    return (best, at) if best <= budget else None


def border(t: str, at: int) -> bool:
    """Whether a word can begin or end there; scripts without spaces have no borders."""
    return (at in (0, len(t)) or " " in (pair := t[at - 1:at + 1])
            or bool(_DENSE_LETTER.search(pair)))


class Matcher:
    """Finds the test items in a text."""

    def __init__(self, items: list):
        self.items = items
        at: dict = {}
        for i, item in enumerate(items):
            for offset, piece in item.pieces():
                at.setdefault(piece, []).append((i, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, where in at.items():
            self.automaton.add_word(piece, (len(piece), where))
        if at:
            self.automaton.make_automaton()

    def candidates(self, t: str) -> dict:
        """item -> sorted starts that its piece hits imply."""
        found: dict = {}
        if len(self.automaton):
            for end, (n, where) in self.automaton.iter(t):
                for i, offset in where:
                    found.setdefault(i, set()).add(end - n + 1 - offset)
        return {i: sorted(s) for i, s in found.items()}

    def verify(self, item: Item, starts: list, t: str):
        """(distance, start, end) of the best match near one of the starts."""
        k, m, best = item.budget, len(item.text), None
        if item.whole:
            return next(((0, s, s + m) for s in starts if border(t, s) and border(t, s + m)), None)
        a = 0
        while a < len(starts):
            b = a  # starts that lie within the budget of each other share a window
            while b + 1 < len(starts) and starts[b + 1] - starts[b] <= k:
                b += 1
            low, high = max(starts[a] - k, 0), starts[b] + m + k
            exact = t.find(item.text, low, high)
            if exact >= 0:
                return 0, exact, exact + m
            hit = myers(item.text, t[low:high], k if best is None else best[0] - 1)
            if hit:
                d, end = hit[0], low + hit[1]
                back = myers(item.text[::-1], t[max(end - m - d, 0):end][::-1], d)
                best = (d, end - (back[1] if back else m), end)
            a = b + 1
        return best

    def matches(self, text: str | None) -> list:
        """One entry per item found: its best match, spans in raw characters."""
        if not text or not self.items:
            return []
        low = text.lower()
        t = joined(_TOKEN.findall(low))
        found = [(self.items[i], m) for i, starts in sorted(self.candidates(t).items())
                 if (m := self.verify(self.items[i], starts, t))]
        if not found:
            return []
        raw = low if len(low) == len(text) else None
        spans = self.raw_spans(low, t, [(s, e) for _, (_, s, e) in found]) if raw is not None else \
            [(None, None)] * len(found)
        return [{"item_id": i.item_id, "distance": d, "start": a, "end": b}
                for (i, (d, _, _)), (a, b) in zip(found, spans)]

    @staticmethod
    def raw_spans(low: str, t: str, spans: list) -> list:
        """Offsets in the joined words ``t`` -> offsets in the text they come from."""
        raw, n = [], 0
        for w in _TOKEN.finditer(low):
            raw.append((n, w.start(), w.end()))
            n += w.end() - w.start()
            n += t[n:n + 1] == " "
        from bisect import bisect_right
        firsts = [r[0] for r in raw]

        def at(x):
            r = raw[max(bisect_right(firsts, x) - 1, 0)]
            return min(r[1] + x - r[0], r[2])
        return [(at(s), at(max(e - 1, s)) + 1) for s, e in spans]


def blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text",
           rate: float = EDIT_RATE, block_chars: int = BLOCK_CHARS, without_id: bool = False):
    """The test items as lists of about ``block_chars`` characters at most;
    those without id only if asked for."""
    b = benchmark.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t")).where("t is not null")
    b = b if without_id else b.where("i is not null")
    total = b.agg(F.coalesce(F.sum(F.length("t")), F.lit(0))).first()[0]
    n = total // block_chars + 1
    for k in range(n):
        part = b if n == 1 else b.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k)
        rows = sorted(part.collect(), key=lambda r: (r.i is None, r.i or 0, r.t))
        yield [x for r in rows if (x := item_of(r.i, r.t, rate))]


def _matcher(items):
    def make():
        m = Matcher(items.value)
        return lambda texts: {"found": [m.matches(t.decode("utf-8", "replace") if t else None) for t in texts]}
    return make


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text", rate: float = EDIT_RATE,
                  block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, item_id, distance, start, end): one row per document and test
    item found in it, with the least edit distance and its span.

    The test items are a stated query set. They reach the tasks in blocks of
    bounded size, and every block runs against all documents. Null and empty
    texts match nothing, nor do items without id or of one short word (see
    LONE_LETTERS). Repeated documents get equal rows, equal items a row each. A span
    is null where lower-casing changes the text's length.
    """
    sc, out = docs.sparkSession.sparkContext, None
    for items in blocks(benchmark, item_col, item_text_col, rate, block_chars):
        rows = (per_text(docs, id_col, text_col, f"found {MATCH}", _matcher(sc.broadcast(items)))
                .select("doc_id", F.explode("found").alias("m")).select("doc_id", "m.*"))
        out = rows if out is None else out.unionByName(rows)
    return out


def keep_clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id",
               item_text_col: str = "text", rate: float = EDIT_RATE, block_chars: int = BLOCK_CHARS,
               without_id: bool = False) -> DataFrame:
    """The documents in which no test item is found, with all their columns.
    ``without_id`` searches the items without id too."""
    sc = docs.sparkSession.sparkContext
    for items in blocks(benchmark, item_col, item_text_col, rate, block_chars, without_id):
        def make(items=sc.broadcast(items)):
            run = _matcher(items)()
            return lambda texts: [not f for f in run(texts)["found"]]
        docs = keep_rows(docs, text_col, make)
    return docs
