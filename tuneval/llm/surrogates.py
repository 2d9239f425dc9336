"""PII surrogates: keyed replacements of the same type, format and script.

Detected entities are e-mail addresses, IPv4 addresses, phone numbers, card
numbers with their check digit, secret tokens and personal names after a title
(also an academic one), with every other mention of such a name's parts in the
same document. The value behind a
mention (its canonical form) has one surrogate in the whole corpus, derived
from a key; surrogates of different values differ, and none equals a value
that occurs. A mention is rendered in its own format, so one value written
in two formats stays one value. An initial is no value of its own: it becomes
another letter of its script.
"""

from __future__ import annotations

import hashlib
import hmac
import re
import secrets
from bisect import bisect_left
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .common import bytes_of, per_text, record_batch, written
from .permutation import Permutation

KEY_CONF = "spark.tuneval.pii.key"
_OWN_KEY = secrets.token_bytes(32)
FULL = 4                 # a format of which more than a FULL-th occurs is permuted
TURNED = -1              # the attempt of such values

# Letters, digits and combining accents of e-mail addresses in any script.
_LOCAL, _HOST = r"[\w\u0300-\u036f.+-]", r"(?:[^\W_]|[\u0300-\u036f-])"
_S = r"[ .\-/\xa0]?"     # between the digits of a phone number
_TYPES = {
    "email": rf"(?<!{_LOCAL})[^\W_]{_LOCAL}*@{_HOST}+(?:\.{_HOST}+)*\.(?:[^\W\d_]|[\u0300-\u036f]){{2,}}(?!{_HOST})",
    "token": r"(?<![A-Za-z0-9])(?=[0-9a-fA-F]*\d)[0-9a-fA-F]{32,}(?![A-Za-z0-9])",
    "ip": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?![\d]|\.\d)",
    "card": r"(?<![\d+])(?<!\d[.,])\d(?:[ -]?\d){12,18}(?![\d])",
    "ssn": r"(?<![\w.+-])\d{3}-\d{2}-\d{4}(?![\w-])",
    # International; area code in parentheses; national with leading 0 (no date); North American; Spanish.
    "phone": rf"(?<![\w+])(?:\+|00)(?:3[34](?:{_S}\(0\))?(?:{_S}\d){{9}}|1(?:{_S}\(?\d\)?){{10}}"
             rf"|[1-9](?:{_S}\(?\d\)?){{6,14}})(?!\d)"
             r"|(?<![\w+])\(\d{2,4}\)[ .-]?\d{3}[ .-]?\d{3,4}(?!\d)"
             rf"|(?<![\w+])\(0\d{{1,5}}\)(?:{_S}\d){{4,10}}(?!\d)"
             r"|(?<![\w+-])(?<!\d[.,/ ])(?!\d\d[ ./-]\d\d[ ./-](?:19|20)\d\d(?!\d))"
             rf"0[1-9](?:(?:{_S}\d\d){{4}}|(?:{_S}\d){{7,10}}|\d{{1,4}}[ /\xa0-]\d{{4,8}})(?!\w|[.,/-]\d)"
             r"|(?<![\w+.-])(?<!\d[ ,/])(?:1[ .-])?\d{3}[ .\xa0-]\d{3}[ .\xa0-]\d{4}(?!\d|[ .,-]\d)"
             r"|(?<![\w+.-])(?<!\d[ ,/])[6-9](?:\d\d[ \xa0-]\d{3}[ \xa0-](?!000)\d{3}|\d\d(?:[ .\xa0-]\d\d){3}"
             r"|\d[ .\xa0-]\d{3}(?:[ .\xa0-]\d\d){2})(?!\d|[ .,-]\d)",
}
# Titles by the gender they tell.
MALE = ("Mr", "Herr", "Monsieur", "Señor", "Sr", "Don", "Господин", "г-н")
FEMALE = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Señorita", "Doña", "Госпожа", "г-жа")
# Titles that stand before a name without telling a gender, or telling it.
ALONE = ("Dr", "Prof", "Doctor", "Professor", "Doktor", "Docteur", "Professeur", "Profesor", "Doctora", "Profesora")
ALONE_FEMALE = ("Doctora", "Profesora")
# Academic titles stand between title and name; particles stay as they are.
DEGREES = ("Dr", "Prof", "Doctor", "Professor", "Doktor", "Docteur", "Professeur", "Profesor", "Doctora", "Profesora",
           "Ing", "Dipl", "Mag", "Lic")
PARTICLES = ("van", "von", "von und zu", "de", "del", "della", "di", "da", "do", "dos", "du", "des", "ter", "y", "e",
             "af", "av", "bin", "ibn", "ben", "фон", "де", "ван")
_AFTER = ("der", "den", "dem", "het", "la", "las", "los", "ter", "ten")   # only after another: alone they are articles


def _ranges(chars: list) -> str:
    """The sorted code points as a regex character class's inside."""
    out, i = "", 0
    while i < len(chars):
        j = i
        while j + 1 < len(chars) and chars[j + 1] == chars[j] + 1:
            j += 1
        out += f"\\U{chars[i]:08x}-\\U{chars[j]:08x}"
        i = j + 1
    return out


def _one_of(words) -> str:
    return "(?:" + "|".join(sorted(words, key=len, reverse=True)) + ")"


_TITLE = _one_of(MALE + FEMALE)
# A part starts with a letter that is not lower case (scripts without case have only such).
_UP = rf"[^\W\d_{_ranges([c for c in range(0x110000) if chr(c).islower()])}]"
_PART = rf"(?!(?:{_TITLE}|{_one_of(DEGREES)})(?!\w)){_UP}[^\W\d_]*(?:['’]{_UP}[^\W\d_]*)*(?!\w)"
_BETWEEN = rf"(?:{_one_of(PARTICLES)}[ ](?:{_one_of(_AFTER)}[ ])?)?(?:[dDlL]['’]|(?:al|el)-)?"
_NAME = rf"(?:(?:{_UP}\.[ -]?)+(?={_BETWEEN}{_UP}))?{_BETWEEN}{_PART}"
_NO_I = rf"(?!I(?![\w.'’]|[ -]{_UP}))"     # "Mr Smith I know"
_BEFORE = rf"(?:{_TITLE}\.?[ ](?:{_one_of(DEGREES)}(?:\.[ ]?|[ ]))*|{_one_of(ALONE)}(?:\.[ ]?|[ ])(?:{_one_of(DEGREES)}(?:\.[ ]?|[ ]))*)"
_TYPES["name"] = rf"(?<!\w){_BEFORE}{_NAME}(?:[ -]{_NO_I}{_NAME})*"
_NAME_PART = re.compile(rf"(?<!\w)(?:{_PART})")
_HEAD = re.compile(rf"(?=({_TITLE}|{_one_of(ALONE)})(?!\w)){_BEFORE}")
_YEAR = re.compile(r",?[ ](?:1[89]|20)\d\d(?!\d)")
_ANY = re.compile("|".join(f"(?P<{k}>{p})" for k, p in _TYPES.items()))
# What every match of the patterns holds: a digit, an at sign or a title.
_HINT = re.compile(rf"\d|@|\b(?:{'|'.join(MALE + FEMALE + ALONE)})\b")

# Alphabets by script, syllables and endings that names are made of.
_SYLLABLES = {
    "latin": ("ba be bo da de do fa fe ga go ka ke la le lo ma me mi na ne no pa ra re ro sa se so ta te to va ve wi".split()),
    "cyrillic": ("ба ве га да де жа за ка ла ле ли ма ме ми на не но па ра ре ро са се со та те то фа ха".split()),
    "greek": ("βα γα δα ζα θα κα κο λα λε μα με να νε πα ρα ρο σα σο τα τε φα".split()),
}
_ALPHABETS = {"latin": "abcdefghijklmnopqrstuvwxyz", "cyrillic": "абвгдежзийклмнопрстуфхцчшщэюя",
              "greek": "αβγδεζηθικλμνξοπρστυφχψω"}
_ENDINGS = {("latin", "m"): "n", ("latin", "f"): "a", ("cyrillic", "m"): "в", ("cyrillic", "f"): "ва",
            ("greek", "m"): "ς", ("greek", "f"): "α"}


def script_of(word: str) -> str:
    """The word's script; scripts without syllables here go by the block of
    128 code points that the first letter lies in."""
    c = ord(word[0])
    if c < 0x250:
        return "latin"
    return "cyrillic" if 0x400 <= c < 0x530 else "greek" if 0x370 <= c < 0x400 else f"block{c >> 7}"


def letters_of(script: str) -> list:
    """Lower-case letters of a script of ``script_of``, or its block's letters."""
    if script in _ALPHABETS:
        return list(_ALPHABETS[script])
    first = int(script[5:]) << 7
    return [c for c in map(chr, range(first, first + 128)) if c.isalpha()]


def digits(s: str) -> str:
    return "".join(c for c in s if c.isdecimal() and c.isascii())


def luhn(number: str) -> bool:
    total = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(number)))
    return total % 10 == 0


def card_end(text: str, start: int, end: int) -> int | None:
    """Where the longest card number that starts here ends: 13 to 19 digits with
    a valid check digit, cut only between groups of digits."""
    while len(value := digits(text[start:end])) >= 13:
        if luhn(value):
            return end
        end = next((k for k in range(end - 1, start, -1) if not text[k].isdecimal()), start)
    return None


def phone_value(value: str) -> str:
    """North American numbers are the same with and without country code."""
    m = re.fullmatch(r"(?:00)?1(\d{10})", value)
    return m[1] if m else value


def entities(text: str) -> list:
    """(start, end, type, canonical value) of every mention, in order.

    A name's parts are entities of their own, so "Mr A. B." and a later
    "Mr B." stay one person; the canonical form of a part tells gender,
    script and the part in lower case. Where a part stands without title it
    has the gender of the titled mention before it, or else of the first.
    """
    out, named = [], {}
    if not _HINT.search(text):
        return out
    at = 0
    while m := _ANY.search(text, at):
        kind, s, at = m.lastgroup, m[0], m.end()
        if kind == "name":
            head = _HEAD.match(text, m.start())
            gender = "m" if head[1] in MALE else "f" if head[1] in FEMALE + ALONE_FEMALE else "u"
            for p in _NAME_PART.finditer(text, head.end(), m.end()):
                w = p[0].lower()
                kind = "initial" if len(w) == 1 and w != w.upper() else "name"
                out.append((p.start(), p.end(), kind, f"{gender}:{script_of(w)}:{w}"))
                if kind == "name":
                    named.setdefault(w, []).append((p.start(), gender))
            continue
        end = m.end()
        if kind == "card":
            end = card_end(text, m.start(), end)
            at = end or m.start() + len(re.match(r"\d+", s)[0])      # what follows may be another entity
            if end is None:
                continue
        value = s.lower() if kind in ("email", "token", "ip") else digits(text[m.start():end])
        if kind == "phone":
            if not 7 <= len(value) <= 15:
                continue
            value = phone_value(value)
        out.append((m.start(), end, kind, value))
    return with_untitled(text, out, told(out, named)) if named else out


def told(found: list, named: dict) -> dict:
    """A part after a title that tells no gender has the gender that the part's
    other titles in the document tell, if any does (``found`` is changed)."""
    known = {w: next((g for _, g in m if g != "u"), "u") for w, m in named.items()}
    for k, (a, b, kind, value) in enumerate(found):
        if kind == "name" and value.startswith("u:") and known[w := value.split(":", 2)[2]] != "u":
            found[k] = (a, b, kind, known[w] + value[1:])
    return {w: [(a, known[w] if g == "u" else g) for a, g in m] for w, m in named.items()}


def with_untitled(text: str, found: list, named: dict) -> list:
    """``found`` with the mentions of the named parts that have no title.

    ``named`` has the (start, gender) of the titled mentions of each part. A
    part that the text also has in lower case, at least half as often, is a common
    word: without title it is no mention, and neither is one before a year ("May 2020").
    """
    out, at = [], 0
    lower = {w: n for w in named if w.upper() != w and (n := len(re.findall(rf"(?<!\w){re.escape(w)}(?!\w)", text)))}
    if lower:
        n = Counter(p[0].lower() for p in _NAME_PART.finditer(text))
        named = {w: m for w, m in named.items() if 2 * lower.get(w, 0) < n[w] or w not in lower}
    for p in _NAME_PART.finditer(text):
        end = p.end()
        titled = named.get(w := p[0].lower())
        if not titled and w.endswith("s"):   # "Schmidts Haus"
            titled, w, end = named.get(w[:-1]), w[:-1], end - 1
        if not titled or _YEAR.match(text, end):
            continue
        while at < len(found) and found[at][1] <= p.start():
            out.append(found[at])
            at += 1
        if at < len(found) and found[at][0] < end:   # lies within an entity
            continue
        gender = titled[max(bisect_left(titled, (p.start(),)) - 1, 0)][1]
        out.append((p.start(), end, "name", f"{gender}:{script_of(w)}:{w}"))
    return out + found[at:]


class Stream:
    """Numbers derived from key, type, value and attempt."""

    def __init__(self, key: bytes, kind: str, value: str, attempt: int):
        self.seed = hmac.new(key, f"{kind}|{attempt}|{value}".encode(), hashlib.sha256).digest()
        self.pool, self.n = int.from_bytes(self.seed), 0

    def below(self, n: int) -> int:
        if self.pool < 1 << 64:
            self.n += 1
            self.pool = int.from_bytes(hashlib.sha256(self.seed + self.n.to_bytes(4)).digest())
        self.pool, r = divmod(self.pool, n)
        return r


def phone_head(value: str) -> int:
    """Digits that stay: the country code or a leading 0."""
    return min(max(len(value) - 10, value.startswith("0")), 3)


def room(kind: str, value: str) -> tuple | None:
    """(name, number of values) of the format that a value and its surrogates
    share, for formats that a large corpus may fill."""
    if kind == "phone":
        head = phone_head(value)
        return f"phone:{len(value)}:{value[:head]}", 10 ** (len(value) - head)
    return {"ssn": ("ssn", 10**9), "ip": ("ip", 1 << 32)}.get(kind)


def turned(key: bytes, kind: str, value: str) -> str:
    """The surrogate in a full format: a permutation of all its values, so that
    different values have different ones and none its own."""
    name, size = room(kind, value)
    p = Permutation(hmac.digest(key, name.encode(), hashlib.sha256), size)
    if kind == "ip":
        n = p.turn(int.from_bytes(map(int, value.split("."))))
        return ".".join(map(str, n.to_bytes(4)))
    head = phone_head(value) if kind == "phone" else 0
    return value[:head] + str(p.turn(int(value[head:]))).zfill(len(value) - head)


def surrogate(key: bytes, kind: str, value: str, attempt: int) -> str:
    """Canonical surrogate of a canonical value."""
    if attempt == TURNED:
        return turned(key, kind, value)
    s = Stream(key, kind, value, attempt)
    if kind == "email":
        local, _, host = value.partition("@")
        def letter(c):
            of = letters_of(script_of(c))
            return of[s.below(len(of))]
        swap = "".join(letter(c) if c.isalpha() else str(s.below(10)) if c.isdigit() else c for c in local)
        if attempt > 8:   # short local parts run out
            swap += str(s.below(10 ** (attempt - 8)))
        return f"{swap}@mail{s.below(1000)}.example.{('com', 'net', 'org')[s.below(3)]}"
    if kind == "ip":
        return ".".join(str(1 + s.below(254)) for _ in range(4))
    if kind == "token":
        return "".join("0123456789abcdef"[s.below(16)] for _ in value)
    if kind == "initial":   # the letters of a script turn by a step of the key
        gender, script, part = value.split(":", 2)
        letters = letters_of(script)
        step = 1 + Stream(key, kind, script, attempt).below(len(letters) - 1)
        at = letters.index(part) if part in letters else s.below(len(letters))
        return f"{gender}:{script}:{letters[(at + step) % len(letters)]}"
    if kind == "name":
        gender, script, part = value.split(":", 2)
        if script.startswith("block"):
            letters = letters_of(script)
            more = attempt - 4 if attempt > 4 else 0
            return f"{gender}:{script}:" + "".join(letters[s.below(len(letters))] for _ in range(len(part) + more))
        n = max(1, min(len(part) // 2, 6)) + (attempt > 4) * (attempt - 4)
        made = "".join(_SYLLABLES[script][s.below(len(_SYLLABLES[script]))] for _ in range(n + 1))
        return f"{gender}:{script}:{made}{_ENDINGS.get((script, gender), '')}"
    if kind == "ssn":
        return "".join(str(s.below(10)) for _ in value)
    if kind == "phone":
        head = phone_head(value)
        return value[:head] + "".join(str(s.below(10)) for _ in value[head:])
    body = "".join(str(s.below(9) + 1 if i == 0 else s.below(10)) for i in range(len(value) - 1))
    last = [d for d in "0123456789" if luhn(body + d) == luhn(value)]
    return body + last[s.below(len(last))]


def render(mention: str, kind: str, made: str) -> str:
    """The surrogate in the mention's format."""
    if kind in ("card", "phone", "ssn"):
        own = digits(mention)                # a country code that is not part of the value stays
        it = iter(own[:len(own) - len(made)] + made)
        return "".join(next(it) if c.isdecimal() and c.isascii() else c for c in mention)
    if kind in ("name", "initial"):
        w = made.rpartition(":")[2]
        return w.upper() if mention.isupper() else w.capitalize() if mention[0].isupper() else w
    if kind == "email":   # the local part keeps its pattern of capitals
        local, at, host = made.partition("@")
        caps = {i for i, c in enumerate(mention.partition("@")[0]) if c.isupper()}
        return "".join(c.upper() if i in caps else c for i, c in enumerate(local)) + at + host
    if kind == "token" and mention.isupper():
        return made.upper()
    return made


_MENTIONS = "kind string, value string"


def distinct_entities(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(kind, value) of all entities of the corpus, each once, without initials."""
    def run(batches):
        for b in batches:
            found = sorted({(k, v) for t in bytes_of(b.column(0)) if t
                            for _, _, k, v in entities(t.decode("utf-8", "replace")) if k != "initial"})
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.string()),
                                              pa.array([v for _, v in found], pa.string())], names=["kind", "value"])
    return docs.select(F.col(text_col).alias("t")).mapInArrow(run, _MENTIONS).distinct()


def key_of(spark: SparkSession) -> bytes:
    """The session's key (``spark.tuneval.pii.key``), or a random one of this
    process: without the key nobody derives a surrogate from a value."""
    k = spark.conf.get(KEY_CONF, None)
    return k.encode() if k else _OWN_KEY


def in_full_formats(found: DataFrame) -> DataFrame:
    """(kind, value) of the values whose format is so full that free surrogates run out."""
    def run(batches):
        for b in batches:
            rooms = [room(k, v) for k, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([r and r[0] for r in rooms], pa.string()),
                 pa.array([r and float(r[1]) for r in rooms], pa.float64())], names=["kind", "value", "room", "size"])
    rooms = found.mapInArrow(run, _MENTIONS + ", room string, size double").where("room is not null")
    full = rooms.groupBy("room").agg(F.count("*").alias("n"), F.max("size").alias("size")).where(
        F.col("n") * FULL > F.col("size"))
    return rooms.join(full.select("room"), "room", "left_semi").select("kind", "value")


def attempts(found: DataFrame, key: bytes | None = None) -> DataFrame:
    """(kind, value, attempt) of the entities whose first surrogate collides.

    A candidate is refused if it equals a value of its kind that occurs in
    the corpus, or a surrogate given before; of equal candidates the least
    value keeps it. The others try again until none is left: formats of digits
    have room, at least half of it free, or else all their values are permuted
    among themselves (a surrogate may then equal a value that occurs); names and
    addresses grow with the attempts. Values without a row here have attempt 0.
    """
    key = key or key_of(found.sparkSession)
    found = written(found, "pii-values")
    full = written(in_full_formats(found), "pii-full")

    def candidates(rows, n):
        def run(batches):
            for b in batches:
                kind, value = b.column(0).to_pylist(), b.column(1).to_pylist()
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), b.column(1), pa.array([surrogate(key, k, v, n) for k, v in zip(kind, value)],
                                                        pa.string())], names=["kind", "value", "made"])
        return rows.select("kind", "value").mapInArrow(run, _MENTIONS + ", made string")

    left, given, n = found, None, 0
    late = None if full.isEmpty() else full.withColumn("attempt", F.lit(TURNED))
    if late is not None:
        left = written(found.join(full, ["kind", "value"], "left_anti").select("kind", "value"), "pii-free")
    while True:
        c = candidates(left, n).join(found.select("kind", F.col("value").alias("made")), ["kind", "made"], "left_anti")
        if given is not None:
            c = c.join(given, ["kind", "made"], "left_anti")
        won = written(c.groupBy("kind", "made").agg(F.min("value").alias("value")), f"pii-given-{n}")
        given = won.select("kind", "made") if given is None else given.unionByName(won.select("kind", "made"))
        if n:
            row = won.select("kind", "value", F.lit(n).alias("attempt"))
            late = row if late is None else late.unionByName(row)
        left = written(left.join(won, ["kind", "value"], "left_anti").select("kind", "value"), f"pii-left-{n}")
        n += 1
        if left.isEmpty():
            break
    if late is None:
        late = won.select("kind", "value", F.lit(0).alias("attempt")).where("false")
    return written(late, "pii-attempts")


def replace_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key: bytes | None = None) -> DataFrame:
    """doc_id, text, n_entities, kinds: every document with surrogates for its PII.

    ``key`` is the secret that surrogates follow from (``key_of`` without it).

    Documents without PII keep their text. Null texts stay null. The same
    value gets the same surrogate in every document and run with the same
    key and corpus; repeated rows get equal rows. The few values that
    collided are joined to the documents that hold them; all other
    surrogates follow from the key, so documents without such values are not
    shuffled with a table of entities.
    """
    key = key or key_of(docs.sparkSession)
    late = attempts(distinct_entities(docs, text_col), key)
    src = docs.select(F.struct(F.col(id_col).alias("i"), F.xxhash64(F.col(text_col)).alias("h")).alias("id"),
                      F.col(text_col).alias("text"))

    def found():
        return lambda texts: {"e": [[{"kind": k, "value": v} for k, v in sorted({(k, v) for _, _, k, v in entities(
            t.decode("utf-8", "replace"))})] if t else [] for t in texts]}

    held = (per_text(src, "id", "text", f"e array<struct<{_MENTIONS.replace(' string', ':string')}>>", found)
            .select("doc_id", F.explode("e").alias("e")).select(F.col("doc_id.i").alias("i"), F.col("doc_id.h").alias("h"), "e.*")
            if not late.isEmpty() else None)
    none = F.array().cast("array<struct<kind:string,value:string,attempt:int>>")
    if held is None:
        j = src.select("id", "text", none.alias("late"))
    else:
        per_doc = written(held.join(late, ["kind", "value"]).groupBy("i", "h")
                          .agg(F.collect_set(F.struct("kind", "value", "attempt")).alias("late")), "pii-late")
        j = (src.join(per_doc, F.col("id.i").eqNullSafe(F.col("i")) & (F.col("id.h") == F.col("h")), "left")
                .select("id", "text", F.coalesce("late", none).alias("late")))

    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("text", T.StringType()),
                           T.StructField("n_entities", T.LongType()), T.StructField("kinds", T.StringType())])
    flat = j.select(F.col("id.i").alias("doc_id"), "text", "late")

    def run(batches):
        for b in batches:
            texts, counts, kinds = [], [], []
            for t, late_ in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                at = {(x["kind"], x["value"]): x["attempt"] for x in late_}
                e, parts, end = entities(t) if t else [], [], 0
                for s, f, k, v in e:
                    parts += [t[end:s], render(t[s:f], k, surrogate(key, k, v, at.get((k, v), 0)))]
                    end = f
                texts.append("".join(parts) + t[end:] if e else t)
                counts.append(len(e))
                kinds.append(",".join(sorted({"name" if k == "initial" else k for _, _, k, _ in e})))
            yield record_batch(schema, {"doc_id": b.column(0), "text": texts, "n_entities": counts, "kinds": kinds})

    return flat.mapInArrow(run, schema)
