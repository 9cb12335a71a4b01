import unicodedata

import pytest

from tidewright.llm import textforms as t

SAME = [
    ("Пpедпочтительно", "Предпочтительно"), ("ABЅTRАCT", "ABSTRACT"), ("μm", "µm"), ("Ω", "Ω"), ("ﬁlter", "filter"), ("Ａ１", "A1"), ("é", "é"), ("a b​", "a b"), ("соxраняет", "сохраняет"),
    ("DESCRΙPTIΟN", "DESCRIPTION"), ("ё", "ё"), ("利", "利"), ("﻿x", "x"), ("ｶﾞ", "ガ"), ("co‑op", "co-op"), ("a\r\nb", "a\nb"), ("so­ft", "soft"), ("K", "K"), ("인", "인"),
]
OTHER = [("resume", "résumé"), ("A", "a"), ("10", "1O"), ("a  b", "a b"), ("a\nb", "a b"), ("x²", "x2"), ("l", "I"), ("ж", "x"), ("шум", "шуm"), ("½", "1/2"), ("и", "й")]


@pytest.mark.parametrize(("a", "b"), SAME)
def test_same_looks(a, b):
    assert t.skeleton(a) == t.skeleton(b)
    assert t.consistent(a) == t.consistent(b)


@pytest.mark.parametrize(("a", "b"), OTHER)
def test_other_looks(a, b):
    assert t.skeleton(a) != t.skeleton(b)
    assert t.consistent(a) != t.consistent(b)


def test_form_is_stable_and_spelled_in_one_script():
    for s in ("Пpедпочтительно сохраняет сop", "A flow through the valvе", "速度は１２ｍ／ｓ", "", " ", "a" * 100_000 + "​", "\x00\x07bell", "Δp и ρ"):
        c = t.consistent(s)
        assert t.consistent(c) == c and t.skeleton(c) == t.skeleton(s) and unicodedata.is_normalized("NFC", c)
    assert t.consistent("Русский текст: сop, cохраняет") == "Русский текст: сор, сохраняет"
    assert t.consistent("English text: сор Δp") == "English text: cop Δp"
    assert t.consistent(None) is None


def test_equal_form_if_and_only_if_equal_skeleton():
    import random

    rng = random.Random(0)
    pool = "aаoоpрcсxхABАВж ¼²é́Ωω​ \n1lI"
    texts = ["".join(rng.choice(pool) for _ in range(rng.randrange(1, 6))) for _ in range(1500)]
    by = {}
    for x in texts:
        by.setdefault(t.skeleton(x), set()).add(t.consistent(x))
    assert all(len(v) == 1 for v in by.values())
    assert len({next(iter(v)) for v in by.values()}) == len(by)


@pytest.fixture
def table(spark):
    t.use(t.confusables(spark))
    yield
    t._STATE.clear()


@pytest.mark.parametrize(
    ("word", "plain"),
    [("ρаper", "paper"), ("νest", "vest"), ("sуνtem", "syvtem"), ("ᴠalve", "valve"), ("flοω", "flοω"), ("ⲣump", "pump"), ("Ꮩalve", "Valve"), ("rород", "город"), ("pаѕѕaɡе", "passage"), ("ѵalve", "valve"), ("αxial", "axial"), ("ролеu", "ролеu")],
)
def test_public_table_folds_words(table, word, plain):
    assert t.consistent(word) == t.consistent(plain)
    if not plain.isascii():
        return
    assert t.consistent(word) == plain


def test_public_table_leaves_formulas_and_other_scripts(table):
    for x in ("σ", "ρV", "αβγ", "Δp и ρ", "σοφός ο νόμος", "город у моря", "ροή του αέρα", "Straße", "naïve", "համակարգը", "速度", "kσ"):
        assert t.consistent(x) == t.skeleton(x) or t.consistent(x) == unicodedata.normalize("NFC", x)
        assert t.consistent(t.consistent(x)) == t.consistent(x)
    assert t.consistent("Ελληνικά: ροή του αέρα, σοφος ο νόμος") == "Ελληνικά: ροή του αέρα, σοφος ο νόμος"
    assert t.consistent("l") != t.consistent("I") and t.consistent("paper") != t.consistent("Paper")
    for (a, b) in (*SAME, *[(x, x) for pair in OTHER for x in pair]):
        assert t.consistent(a) == t.consistent(b)
    assert all(t.consistent(a) != t.consistent(b) for a, b in OTHER)


def test_pairs(spark):
    rows = [(1, "valve А", 0), (2, "valve A", 0), (3, "valve A", 0), (4, "valve A", 0), (5, "valve B", 0), (6, None, 0), (7, "", 0), (8, "​", 0), (None, "valve A​", 0), (2, "valve A", 0)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, own int")
    got = sorted(map(tuple, t.same_looks(d).collect()))
    assert got == [(1, 2), (1, 3), (1, 4), (2, 4), (3, 4), (7, 8)]
    assert t.same_looks(d.limit(0)).count() == 0
    made = {r["doc_id"]: (r["class_id"], r["size"], r["links"]) for r in t.classes(d).collect()}
    assert {k: v[:2] for k, v in made.items()} == {1: (1, 4), 2: (1, 4), 3: (1, 4), 4: (1, 4), 5: (5, 1), 7: (7, 2), 8: (7, 2)}
    assert all(v[2] == sum(k in pair for pair in got) for k, v in made.items())
    assert {r["doc_id"]: r["text"] for r in t.forms(d).collect()}[4] == "valve A" and t.forms(d).where("doc_id = 6").first()["text"] is None
