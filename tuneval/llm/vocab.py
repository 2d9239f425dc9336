"""A public byte-level BPE tokenizer (``tokenizers`` JSON file) taken apart:
its merges, its added special strings, its byte alphabet."""

from __future__ import annotations

import json
import os
import re


def read_spec(path: str) -> str:
    """The tokenizer file's text, read once by the driver and broadcast."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def byte_alphabet() -> dict:
    """byte -> the visible character that stands for it in byte-level
    vocabularies: printable Latin-1 as it is, the rest from U+0100 on."""
    plain = [b for b in range(256) if chr(b).isprintable() and chr(b) != " " and b != 0xAD]
    out = {b: chr(b) for b in plain}
    return out | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in out)}


_MAP = str.maketrans({chr(b): c for b, c in byte_alphabet().items()})


def to_alphabet(piece: str) -> str:
    return piece.encode("utf-8", "surrogatepass").decode("latin-1").translate(_MAP)


class Vocab:
    """A tokenizer loaded in a worker."""

    def __init__(self, spec: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        parsed = json.loads(spec)
        self.strings = list(parsed["model"]["vocab"])
        added = parsed["added_tokens"]
        #: whether added strings are cut out of the raw text and nothing around them
        self.plain_added = not any(a["lstrip"] or a["rstrip"] or a["single_word"] or a["normalized"] for a in added)
        by_length = sorted((a["content"] for a in added), key=len, reverse=True)
        self.added = re.compile("|".join(map(re.escape, by_length))) if by_length else None

    def merge(self, piece: str) -> list:
        """Token ids of one pre-token in the byte alphabet, by the merges."""
        return [t.id for t in self.model.tokenize(piece)]

    def encode(self, text: str) -> list:
        return self.tokenizer.encode(text, add_special_tokens=False).ids


class Remembered(dict):
    """key -> fn(key), for a bounded number of keys of at most KEY_CHARS characters."""

    KEY_CHARS = 64

    def __init__(self, fn, limit: int):
        super().__init__()
        self.fn, self.limit = fn, limit

    def __missing__(self, key):
        out = self.fn(key)
        if len(key) <= self.KEY_CHARS:
            if len(self) >= self.limit:
                self.clear()
            self[key] = out
        return out
