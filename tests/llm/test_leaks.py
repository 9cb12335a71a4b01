import random
import re

from tidewright.llm import leaks

ITEM = "Name the claim that protects the flow channel if the porous time folder was shown 4451 days before the pressure-sensitive paint layer"


def words(s):
    return re.findall(r"[^\W_]+", s.lower())


def rows_of(spark, docs, items, **k):
    d = spark.createDataFrame(list(docs.items()), "doc_id bigint, text string")
    i = spark.createDataFrame(list(items.items()), "item_id bigint, text string")
    return {tuple(r) for r in leaks.leaked(d, i, **k).collect()}


def full_of(spark):
    return spark.createDataFrame([(5, ITEM)], "doc_id bigint, text string")


def test_ways_to_show_a_passage(spark):
    w = ITEM.split()
    part = " ".join(w[3:15])
    docs = {
        1: f"Some text. {ITEM}. More.", 2: f"start {part} end", 3: f"start {' '.join(w[3:14])} end", 4: part.upper().replace(" ", ",\n  "), 5: part.replace("channel", "chan-\nnel"),
        6: part.replace("a", "а").replace("e", "ｅ"), 7: part.replace("porous", "po​rous"), 8: " ".join(reversed(part.split())), 9: "x" + part + "y", 10: part.replace(" ", ""), 11: None, 12: "", 13: part.replace("the", "tha", 1),
        14: ("filler words here " * 20_000) + part, 15: part.replace("channel", "chan nel"), 16: part.replace("channel if", "channelif"), 17: part.replace("channel", "chan\nnel"), 18: part.replace("folder", "fólder".replace("ó", "ó")),
    }
    got = rows_of(spark, docs, {7: ITEM, 8: "too short to count", 9: None})
    assert got == {(d, 7) for d in (1, 2, 4, 5, 6, 7, 14, 17, 18)}
    assert rows_of(spark, docs, {7: ITEM}, bits=64) == got


def test_against_all_windows(spark):
    rng = random.Random(2)
    vocabulary = ["a", "of", "valve", "the", "pressure", "in", "42", "x"]
    items = {i: " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(8, 30))) for i in range(25)}
    docs = {}
    for d in range(120):
        body = [rng.choice(vocabulary) for _ in range(rng.randrange(0, 60))]
        if rng.random() < 0.6:
            w = items[rng.randrange(25)].split()
            a, n = rng.randrange(len(w)), rng.randrange(9, 16)
            body[5:5] = w[a : a + n]
        docs[d] = " ".join(body)
    expected = set()
    for i, x in items.items():
        w = words(x)
        for k in range(len(w) - 11):
            for d, y in docs.items():
                v = words(y)
                if any(v[j : j + 12] == w[k : k + 12] for j in range(len(v) - 11)):
                    expected.add((d, i))
    assert expected and rows_of(spark, docs, items) == expected
    assert rows_of(spark, docs, items, bits=64) == expected


def test_empty_tables(spark):
    d = spark.createDataFrame([], "doc_id bigint, text string")
    i = spark.createDataFrame([(1, ITEM), (1, ITEM)], "item_id bigint, text string")
    assert leaks.leaked(d, i).count() == 0 and leaks.leaked(d, i.limit(0)).count() == 0 and leaks.leaked(full_of(spark), i.limit(0)).count() == 0
    full = spark.createDataFrame([(5, ITEM)], "doc_id bigint, text string")
    assert [tuple(r) for r in leaks.leaked(full, i).collect()] == [(5, 1)]


def test_case_counts_in_no_script(spark):
    russian = "вся система канала в море показана на нашем потоке при новом ветре кабеля"
    greek = "η ροή του αέρα μέσα στο κανάλι και η πίεση κάτω από τον βυθό χάνονται νύχτα"
    armenian = "համակարգը ցույց է տալիս հոսքը ջրանցքում երբ ճնշումը նվազում է օդի հետ ուղղակի"
    items = {1: russian, 2: greek, 3: armenian, 4: russian.upper()}
    docs = {1: f"Heading: {russian.upper()} in an English text", 2: greek.upper(), 3: armenian.title(), 4: russian.title(), 5: greek.title(), 6: russian}
    want = {(1, 1), (1, 4), (4, 1), (4, 4), (6, 1), (6, 4), (2, 2), (5, 2), (3, 3)}
    assert rows_of(spark, docs, items) == want
    assert rows_of(spark, docs, items, bits=64) == want


def test_windows_of_all_sizes(spark):
    """One item of single letters beside usual ones and one of very long words; each has its own partition."""
    rng = random.Random(4)
    long = " ".join("".join(rng.choice("abcdefgh") for _ in range(60)) for _ in range(14))
    items = {1: ITEM, 2: "a b c d e f g h i j k l m n", 3: long, 4: " ".join(rng.choice(["it", "on", "by", "at"]) for _ in range(20))}
    assert {int(p) for x in items.values() for p in leaks.windows(x, 12)[4]} >= {3, 5, 7, 10}
    docs, expected = {}, set()
    for d in range(80):
        body = [rng.choice(["valve", "aa", "flow", "bb"]) for _ in range(30)]
        i = rng.choice(list(items))
        w = items[i].split()
        n = rng.randrange(10, len(w) + 1)
        at = rng.randrange(len(w) - n + 1)
        docs[d] = " ".join([*body, "|", *w[at : at + n], "|", *body])
        if n >= 12:
            expected.add((d, i))
    assert rows_of(spark, docs, items) == expected == rows_of(spark, docs, items, bits=128)


def test_repeated_text_and_shared_windows(spark):
    items = {1: ITEM, 2: "Preface. " + ITEM, 3: " ".join(["flow channel"] * 8)}
    docs = {1: "flow channel " * 5, 2: "flow channel " * 6, 3: "x " + ITEM + " y " + ITEM, 4: "channel " + "flow channel " * 40}
    assert rows_of(spark, docs, items) == {(2, 3), (3, 1), (3, 2), (4, 3)}
