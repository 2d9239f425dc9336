"""Token counts with the whole-token shortcut.

Offline, every string of the vocabulary is put through the merges alone; the
proven ones are those that come out as one token. A document is cut into
pre-tokens: proven ones count one, and only the rest is merged.
"""

from __future__ import annotations

import hashlib
import json

import regex
from pyspark.sql import DataFrame, functions as F

from .common import kept, per_text
from .vocab import Remembered, Vocab, byte_alphabet, read_spec, to_alphabet

LIMIT = 1024
REMEMBERED = 400_000   # merged pre-tokens that a worker keeps

# The pre-token pattern of the byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

# Characters whose class (letter, digit, space) is the same in every Unicode
# version; texts with others are cut by the tokenizer's own pre-tokenizer.
_OTHER = regex.compile(r"[^\t\n\r\x20-\x7e¡-¬®-ɏ]")
_CUT = regex.compile(PATTERN)


def prove(spec: str) -> frozenset:
    """The vocabulary's strings (as text) that encode alone as one token.

    Special strings are left out, and so are entries that are no whole UTF-8
    text: they never equal a pre-token.
    """
    v = Vocab(spec)
    back = {c: b for b, c in byte_alphabet().items()}
    proven = set()
    for s in v.strings:
        if all(c in back for c in s) and len(v.merge(s)) == 1:
            try:
                proven.add(bytes(back[c] for c in s).decode("utf-8"))
            except UnicodeDecodeError:
                pass
    return frozenset(proven)


def check_spec(spec: str) -> None:
    """Counting takes pre-tokens for what PATTERN cuts: another tokenizer is an error."""
    parsed = json.loads(spec)
    pre = parsed["pre_tokenizer"] or {}
    steps = pre.get("pretokenizers", [pre])
    byte_level = [s for s in steps if s.get("type") == "ByteLevel"]
    others = [s for s in steps if s.get("type") != "ByteLevel"]
    fits = (len(byte_level) == 1 and not others and byte_level[0].get("use_regex", True)
            and not byte_level[0].get("add_prefix_space") and not parsed["normalizer"]
            and parsed["model"].get("type") == "BPE" and not parsed["model"].get("ignore_merges"))
    if not fits:
        raise ValueError("not a byte-level BPE tokenizer with its own pattern and no normalizer: "
                         f"normalizer {parsed['normalizer']}, pre-tokenizer {parsed['pre_tokenizer']}")


class Counter:
    """Counts the tokens of texts as the tokenizer gives them."""

    def __init__(self, spec: str, proven: frozenset):
        self.vocab, self.proven = Vocab(spec), frozenset(map(to_alphabet, proven))
        #: distinct pre-tokens that were proven, and that had to be merged
        self.matched = self.merged = 0
        self.known = Remembered(lambda p: self.mapped(to_alphabet(p)), REMEMBERED)
        self.known_mapped = Remembered(self.mapped, REMEMBERED // 8)

    def mapped(self, p: str) -> int:
        """Tokens of a pre-token in the byte alphabet: one if that is proven."""
        if p in self.proven:
            self.matched += 1
            return 1
        self.merged += 1
        return len(self.vocab.merge(p))

    def plain(self, text: str) -> int:
        if _OTHER.search(text):
            return sum(self.known_mapped[p] for p, _ in self.vocab.tokenizer.pre_tokenizer.pre_tokenize_str(text))
        return sum(map(self.known.__getitem__, _CUT.findall(text)))

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        v = self.vocab
        if v.added is None or not v.added.search(text):
            return self.plain(text)
        if not v.plain_added:
            return len(v.encode(text))
        parts = v.added.split(text)
        return len(parts) - 1 + sum(self.plain(p) for p in parts if p)


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
                 limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every document.

    ``path``: a byte-level BPE tokenizer file (read by the driver; its text
    and the proof, both bounded by the vocabulary, are broadcast); one with
    another pattern, or a normalizer, is an error. Null and
    empty texts have 0 bytes and tokens. Repeated rows get equal rows; other
    columns are not read.
    """
    spec = read_spec(path)
    check_spec(spec)
    shipped = docs.sparkSession.sparkContext.broadcast((spec, prove(spec)))
    key = hashlib.sha256(spec.encode()).hexdigest()

    def make():
        c = kept(f"counter {key}", lambda: Counter(*shipped.value))   # tasks share what has been merged

        def run(texts):
            n = [c.count(t.decode("utf-8", "replace") if t else None) for t in texts]
            return {"n_bytes": [len(t or b"") for t in texts], "n_tokens": n}
        return run

    return (per_text(docs, id_col, text_col, "n_bytes long, n_tokens long", make)
            .withColumn("over_limit", F.col("n_tokens") > limit))
