"""Porter stemmer (M. F. Porter, "An algorithm for suffix stripping", 1980).

Written from the published algorithm, with the extensions that the NLTK
documentation lists for its default mode (irregular forms, short -ies/-ied
words, -y after a consonant only, -bli, -logi, -fulli, repeated -alli). ROUGE
scorers stem in that mode; ``extended=False`` is the 1980 rule set. Plain
Python: it runs inside Arrow-batched UDFs on token arrays, memoised per worker.
"""

from __future__ import annotations

from functools import lru_cache

_VOWELS = frozenset("aeiou")


def _is_cons(w: str, i: int) -> bool:
    c = w[i]
    if c in _VOWELS:
        return False
    if c == "y":
        return i == 0 or not _is_cons(w, i - 1)
    return True


def _measure(stem: str) -> int:
    """m in [C](VC)^m[V]."""
    m, i, n = 0, 0, len(stem)
    while i < n and _is_cons(stem, i):
        i += 1
    while i < n:
        while i < n and not _is_cons(stem, i):
            i += 1
        if i >= n:
            break
        while i < n and _is_cons(stem, i):
            i += 1
        m += 1
    return m


def _has_vowel(stem: str) -> bool:
    return any(not _is_cons(stem, i) for i in range(len(stem)))


def _double_cons(w: str) -> bool:
    return len(w) >= 2 and w[-1] == w[-2] and _is_cons(w, len(w) - 1)


def _cvc(w: str, extended: bool = False) -> bool:
    if extended and len(w) == 2:
        return not _is_cons(w, 0) and _is_cons(w, 1)
    if len(w) < 3:
        return False
    return (_is_cons(w, len(w) - 3) and not _is_cons(w, len(w) - 2) and _is_cons(w, len(w) - 1)
            and w[-1] not in "wxy")


# Suffix rules of steps 2, 3 and 4 of the published algorithm.
_STEP2 = (("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"),
          ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"),
          ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"),
          ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"),
          ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"))
_STEP3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"),
          ("ful", ""), ("ness", ""))
_STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent",
          "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


# Step 2 as extended, and forms the extensions list as they are.
_STEP2_EXTENDED = tuple(r for r in _STEP2 if r[0] != "abli") + (("bli", "ble"), ("fulli", "ful"), ("logi", "log"))
_IRREGULAR = {"skies": "sky", "sky": "sky", "dying": "die", "lying": "lie", "tying": "tie", "news": "news",
              "innings": "inning", "inning": "inning", "outings": "outing", "outing": "outing",
              "cannings": "canning", "canning": "canning", "howe": "howe", "proceed": "proceed",
              "exceed": "exceed", "succeed": "succeed"}


def _longest(w: str, suffixes):
    best = None
    for s in suffixes:
        suf = s[0] if isinstance(s, tuple) else s
        if w.endswith(suf) and (best is None or len(suf) > len(best[0] if isinstance(best, tuple)
                                                               else best)):
            best = s
    return best


def _step2(w: str, extended: bool) -> str:
    r = _longest(w, _STEP2_EXTENDED if extended else _STEP2)
    if not r:
        return w
    base = w[:-len(r[0])]
    # of -logi the l counts as part of what is measured
    if _measure(base + "l" if r[0] == "logi" else base) == 0:
        return w
    return _step2(base + r[1], extended) if extended and r[0] == "alli" else base + r[1]


@lru_cache(maxsize=1 << 18)
def stem(word: str, extended: bool = True) -> str:
    w = word
    if extended and w in _IRREGULAR:
        return _IRREGULAR[w]
    if len(w) <= 2:
        return w
    # step 1a
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith("ies"):
        w = w[:-1] if extended and len(w) == 4 else w[:-2]
    elif w.endswith("ss"):
        pass
    elif w.endswith("s"):
        w = w[:-1]
    # step 1b
    extra = False
    if extended and w.endswith("ied"):
        w = w[:-1] if len(w) == 4 else w[:-2]
    elif w.endswith("eed"):
        if _measure(w[:-3]) > 0:
            w = w[:-1]
    elif w.endswith("ed") and _has_vowel(w[:-2]):
        w, extra = w[:-2], True
    elif w.endswith("ing") and _has_vowel(w[:-3]):
        w, extra = w[:-3], True
    if extra:
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif _double_cons(w) and w[-1] not in "lsz":
            w = w[:-1]
        elif _measure(w) == 1 and _cvc(w, extended):
            w += "e"
    # step 1c
    if w.endswith("y") and (len(w) > 2 and _is_cons(w, len(w) - 2) if extended else _has_vowel(w[:-1])):
        w = w[:-1] + "i"
    # step 2
    w = _step2(w, extended)
    # step 3
    r = _longest(w, _STEP3)
    if r and _measure(w[:-len(r[0])]) > 0:
        w = w[:-len(r[0])] + r[1]
    # step 4
    r = _longest(w, _STEP4)
    if r:
        base = w[:-len(r)]
        if _measure(base) > 1 and (r != "ion" or (base and base[-1] in "st")):
            w = base
    # step 5a
    if w.endswith("e"):
        base = w[:-1]
        m = _measure(base)
        if m > 1 or (m == 1 and not _cvc(base, extended)):
            w = base
    # step 5b
    if _measure(w) > 1 and _double_cons(w) and w.endswith("l"):
        w = w[:-1]
    return w


def rouge_stem(token: str) -> str:
    """Stemming as the ROUGE tokenizer applies it: only tokens over 3 chars."""
    return stem(token) if len(token) > 3 else token
