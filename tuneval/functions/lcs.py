"""Bit-parallel longest common subsequence (Allison-Dix / Hyyrö).

One bit per reference token in an arbitrary-width Python integer; each
prediction token costs a few big-integer operations, i.e. O(n*m/64) word
operations in C. Whole texts, no token cap.
"""

from __future__ import annotations


def lcs_length(a, b) -> int:
    if not a or not b:
        return 0
    if len(b) > len(a):
        a, b = b, a
    masks: dict = {}
    for j, tok in enumerate(b):
        masks[tok] = masks.get(tok, 0) | (1 << j)
    full = (1 << len(b)) - 1
    v = full
    for tok in a:
        m = masks.get(tok)
        if m is None:
            continue
        u = v & m
        v = ((v + u) | (v - u)) & full
    return len(b) - bin(v).count("1")
