"""Detection lines, the permutation, full formats, and the whole small table
against a plain second version of the replacement."""

import pytest
from pyspark.sql import functions as F

from tuneval.llm import surrogates as S
from tuneval.llm.common import configure, read
from tuneval.llm.permutation import Permutation

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("text, want", [
    ("Dr. Maria Lopez called", [("Maria", "name", "u:latin:maria"), ("Lopez", "name", "u:latin:lopez")]),
    ("Prof. Schmidt kam", [("Schmidt", "name", "u:latin:schmidt")]),
    ("Doctora García vino", [("García", "name", "f:latin:garcía")]),
    ("Dr. Braun und Herr Braun", [("Braun", "name", "m:latin:braun")] * 2),
    ("order 123456789012345", []), ("id 20230101123456", []), ("1234567890123 pieces", []),
    ("4451 7180 2488 7799", [("4451 7180 2488 7799", "card", "4451718024887799")]),
    ("4451718024887799 27.65.93.188", [("4451718024887799", "card", "4451718024887799"),
                                       ("27.65.93.188", "ip", "27.65.93.188")]),
    ("no 123456789012345 27.65.93.188", [("27.65.93.188", "ip", "27.65.93.188")]),
    ("Mr Will Smith came. They will go. Will you go?", [("Will", "name", "m:latin:will"),
                                                         ("Smith", "name", "m:latin:smith")]),
    ("Mr May came in May 2020. May left.", [("May", "name", "m:latin:may")] * 2),
    ("+1 555 123 4567 or 555-123-4567", [("+1 555 123 4567", "phone", "5551234567"),
                                         ("555-123-4567", "phone", "5551234567")]),
])
def test_detection(text, want):
    assert [(text[a:b], k, v) for a, b, k, v in S.entities(text)] == want


def test_one_number_in_two_forms_has_one_surrogate():
    text = "+1 555 123 4567 or 555-123-4567"
    made = [S.render(text[a:b], k, S.surrogate(b"k", k, v, 0)) for a, b, k, v in S.entities(text)]
    assert made[0].startswith("+1 ") and S.digits(made[0])[1:] == S.digits(made[1]) != "5551234567"


def test_permutations_are_bijections():
    for size in (*range(1, 260), 1000, 4096, 4097, 9999, 10_000):
        p = Permutation(b"key", size)
        there = [p.at(n) for n in range(size)]
        assert sorted(there) == list(range(size)) and all(p.back(m) == n for n, m in enumerate(there))
        if size in (1, 2, 3, 17, 256, 10_000):
            turned = [p.turn(n) for n in range(size)]
            assert sorted(turned) == list(range(size)) and (size == 1 or all(m != n for n, m in enumerate(turned)))


def test_full_formats_end(spark, monkeypatch):
    """All 1,000 numbers of a format occur: no free surrogate is left, and yet
    everyone has one of its own."""
    configure(spark)
    monkeypatch.setattr(S, "FULL", 4 * 10**6)       # the format has 10^6 numbers, of which 1,000 occur here
    found = spark.range(1000).select(F.lit("phone").alias("kind"), F.concat(F.lit("0"), F.lpad(
        F.col("id").cast("string"), 6, "0")).alias("value")).unionByName(
        spark.createDataFrame([("email", "a@b.de")], "kind string, value string"))
    at = {(r.kind, r.value): r.attempt for r in S.attempts(found, b"k").collect()}
    values = [r.value for r in found.where("kind = 'phone'").collect()]
    assert {at["phone", v] for v in values} == {S.TURNED} and at.get(("email", "a@b.de"), 0) == 0
    made = {v: S.surrogate(b"k", "phone", v, S.TURNED) for v in values}
    assert len(set(made.values())) == 1000 and all(len(m) == 7 and m[0] == "0" and m != v for v, m in made.items())
    assert S.turned(b"k", "ip", "1.2.3.4") != "1.2.3.4" and S.turned(b"k", "ssn", "123456789") != "123456789"


def plain_surrogates(values, key):
    """value -> surrogate, all distinct and none a value: rounds over sorted values."""
    taken, out, n = {}, {}, 0
    left = sorted(values)
    while left:
        made = {}
        for kind, v in left:
            c = S.surrogate(key, kind, v, n)
            if (kind, c) not in values and (kind, c) not in taken:
                made.setdefault((kind, c), (kind, v))
        taken.update(made)
        out.update({v: c for (_, c), v in made.items()})
        left = [x for x in left if x not in out]
        n += 1
    return out


def test_whole_table_against_a_plain_version(spark):
    docs = read(configure(spark), SF, "documents").select("doc_id", "text").unionByName(spark.createDataFrame(
        [(10**6 + k, t) for k, t in enumerate(["Mr A. Stone met Dr. Stone at 10.0.0.1", "call 555-123-4567 or +1 555 123 4567",
                                               "a@b.de, x@y.de, A@b.de"] * 2)], "doc_id long, text string"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    found = {d: S.entities(t) if t else [] for d, t in texts.items()}
    made = plain_surrogates({(k, v) for e in found.values() for *_, k, v in e if k != "initial"}, b"k")
    assert len({(k, c) for (k, _), c in made.items()}) == len(made) > 15
    for r in S.replace_pii(docs, key=b"k").collect():
        t, out, end = texts[r.doc_id], "", 0
        for a, b, k, v in found[r.doc_id]:
            out += t[end:a] + S.render(t[a:b], k, made[k, v] if k != "initial" else S.surrogate(b"k", k, v, 0))
            end = b
        assert r.text == (out + t[end:] if t is not None else None) and r.n_entities == len(found[r.doc_id])
        assert found[r.doc_id] or r.text == t


def test_keys(spark):
    configure(spark)
    d = spark.createDataFrame([(1, "Mr Stone, 10.0.0.1")], "doc_id long, text string")

    def text(**key):
        return S.replace_pii(d, **key).first().text
    assert text() == text() != text(key=b"public") == text(key=b"public")
    spark.conf.set(S.KEY_CONF, "public")
    assert text() == text(key=b"public")
    spark.conf.unset(S.KEY_CONF)
