"""One consistent form of characters for texts that look the same.

Three steps. The *skeleton* of a text drops what shows nothing, makes one space of all kinds of spaces, undoes
compatibility forms that look like their plain letter, and puts every letter that is drawn like a Latin one
in its Latin spelling. In the *folded* text, words whose letters still share no script are looked at again with
their script sets augmented by the public table of confusables (UTS 39, as the ICU library beside Spark holds
it): where a script then fits all letters of the word, its letters of other scripts, and small capitals and
the like, are put in that script. A single Greek letter or a short formula is no such word. Texts look the same
if and only if their folded texts are equal. The *consistent form* is spelled from the folded text alone: the
script sets of a word's letters are intersected, and where the result lacks Latin the letters are put back in
the script that fits all of them. A word that fits several scripts (a whole-script confusable) takes the script
of most of its text's unshared letters. So equal folded texts give equal forms, and mixed-script words get the
one spelling that is possible throughout.

Case, accents, digits, words, line breaks and the number of spaces are kept.

Defined results
---------------
* a null text has a null form and takes no part in pairs; an empty text is its own form;
* very long texts are processed whole; equal texts are no pair; documents with null ids are left out;
* repeated rows of one id with equal text count once; further columns do not take part.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.session import cut

#: Letters of other scripts that look like the Latin letter below them.
CYRILLIC = ("аеорсухіјѕһԁԛԝАВЕЅІЈКМНОРСТХҮԌԚԜ", "aeopcyxijshdqwABESIJKMHOPCTXYGQW")
GREEK = ("οΑΒΕΖΗΙΚΜΝΟΡΤΥΧϲϳͿϹ", "oABEZHIKMNOPTYXcjJC")
ARMENIAN = ("օոսցհՕՍ", "onughOU")
LATIN = ("ɡɑı", "gai")
#: Signs that look like another sign or letter.
SIGNS = {"∑": "Σ", "∏": "Π", "∆": "Δ", "∙": "·", "‐": "-", "−": "-", "’": "'", "‘": "'", "ʼ": "'", "․": ".", "∕": "/", "⁄": "/", "∶": ":", "ꞏ": "·"}
#: Kinds of decompositions whose result looks like the character itself.
KINDS = ("<wide>", "<narrow>", "<compat>", "<font>", "<noBreak>", "<initial>", "<medial>", "<final>", "<isolated>")
#: Characters besides those of category Cf that show nothing (ranges, inclusive).
NOTHING = ((0x034F, 0x034F), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFFA0, 0xFFA0), (0xE0000, 0xE0FFF))
#: Letters of a word below which the public table is not applied to it.
WORD = 4
BREAKS = "\u0085  \u000b\u000c"

_STATE: dict = {}


def confusables(spark: SparkSession) -> str:
    """The public table's skeletons of all cased letters, one ``letter skeleton`` per line; its size is that of the table."""
    letters = [chr(c) for c in range(0x20000) if unicodedata.category(chr(c)) in ("Lu", "Ll") and not unicodedata.decomposition(chr(c))]
    made = spark._jvm.com.ibm.icu.text.SpoofChecker.Builder().build().getSkeleton("\n".join(letters)).split("\n")
    return "\n".join(f"{a} {b}" for a, b in zip(letters, made, strict=True))


def use(table: str) -> None:
    """Take the skeletons of :func:`confusables` in this process; without them only the fixed values below count."""
    if _STATE.get("table") == table:
        return
    _STATE.clear()
    t = _tables()
    classes: dict[tuple, dict[int, list[str]]] = {}
    for line in table.split("\n"):
        letter, like = line.split(" ", 1)
        # Two ASCII letters share a skeleton only as small l and capital i: case tells them apart.
        key = (like, letter.isupper() if like == "l" else None)
        classes.setdefault(key, {}).setdefault(_script(letter, t), []).append(letter)
    twins: dict[str, dict[int, str]] = {}
    for members in classes.values():
        if sum(map(len, members.values())) < 2:
            continue
        best = {bit: min(own, key=lambda c: (not c.isascii(), c)) for bit, own in members.items() if bit}
        for bit, own in members.items():
            for c in own:
                # A letter that the fixed values spell as a Latin one stands in skeletons in that spelling only.
                spelled = t["like"].get(ord(c), c)
                twins.setdefault(spelled, {}).update({k: v for k, v in best.items() if v != spelled and k != _script(spelled, t)})
                if bit == 1 and spelled == c and not c.isascii() and best[1].isascii():
                    twins[c][1] = best[1]
    # Where a word may have to be folded: letters of other scripts than Latin, and Latin ones beside ASCII that have a twin.
    odd = "".join(sorted(re.escape(c) for c in twins if not c.isascii()))
    t.update(table=table, twins=twins, strange=re.compile(f"[{odd}\u0370-\u058f]"), folded={})


def _tables() -> dict:
    """Built by rule once per Python process."""
    if "to" in _STATE:
        return _STATE
    to: dict[int, str | None] = {}
    for c in range(0x80, 0x30000):
        ch = chr(c)
        d = unicodedata.decomposition(ch)
        if d and d.split()[0] in KINDS:
            to[c] = unicodedata.normalize("NFKD", ch)
        kind = unicodedata.category(ch)
        if kind == "Zs":
            to[c] = " "
        elif kind in ("Cf", "Cc") and ch not in BREAKS:
            to[c] = None
    for lo, hi in NOTHING:
        to |= dict.fromkeys(range(lo, hi + 1))
    to |= dict.fromkeys([*range(9), *range(14, 32), 127])
    to |= {ord(b): "\n" for b in BREAKS}
    to[9] = " "
    like = {ord(k): v for k, v in SIGNS.items()}
    scripts: dict[str, int] = {}
    back: dict[int, dict[str, str]] = {2: {}, 4: {}, 8: {}}
    for bit, (own, latin) in ((2, CYRILLIC), (4, GREEK), (8, ARMENIAN), (1, LATIN)):
        for a, b in zip(own, latin, strict=True):
            like[ord(a)] = b
            if bit > 1:
                scripts[b] = scripts.get(b, 1) | bit
                back[bit].setdefault(b, a)
    _STATE.update(to=to, like=like, scripts=scripts, back=back, run={}, bits={}, spelled={})
    _STATE.update(word=re.compile(r"[^\W\d_]+"), odd=re.compile(r"[^\x00-\x7f]+"), control=re.compile(r"[\x00-\x09\x0b-\x1f\x7f]"), foreign=re.compile(r"[\u0370-\u058f]+"))
    return _STATE


#: Bits of the scripts; further scripts of cased letters follow as they are met. All bits stand for a mark.
SCRIPTS, ANY = {"LATIN": 1, "CYRILLIC": 2, "GREEK": 4, "ARMENIAN": 8}, (1 << 40) - 1


def _script(letter: str, t: dict) -> int:
    """The bit of a letter's own script."""
    name = unicodedata.name(letter, "").split(" ")[0]
    known = t.setdefault("known", dict(SCRIPTS))
    if name not in known and unicodedata.category(letter) in ("Lu", "Ll"):
        known[name] = 1 << len(known)
    return known.get(name, 0)


def _bits(ch: str, t: dict) -> int:
    """The scripts a skeleton letter can be spelled in, 0 for a letter without case, all for marks."""
    b = t["bits"].get(ch)
    if b is None:
        base = unicodedata.normalize("NFD", ch)[0]
        if base in t["scripts"]:
            b = t["scripts"][base]
        else:
            b = ANY if unicodedata.category(base)[0] == "M" else _script(base, t)
        t["bits"][ch] = b
    return b


def skeleton(text: str) -> str:
    """The text without what shows nothing, and with letters drawn like Latin ones in Latin spelling."""
    t = _tables()
    if t["control"].search(text):
        text = text.replace("\r\n", "\n").replace("\r", "\n").translate({k: v for k, v in t["to"].items() if k < 128})
    if text.isascii():
        return text
    cache = t["run"]

    def one(m: re.Match) -> str:
        w = m.group()
        s = cache.get(w)
        if s is None:
            s = unicodedata.normalize("NFC", unicodedata.normalize("NFD", w.translate(t["to"])).translate(t["like"]))
            if len(w) <= 32:
                if len(cache) > 200_000:
                    cache.clear()
                cache[w] = s
        return s

    return unicodedata.normalize("NFC", t["odd"].sub(one, text))


def _fold(w: str, t: dict) -> str:
    """A word of a skeleton with its confusable letters in the one script that fits all of its letters."""
    s = t["folded"].get(w)
    if s is None:
        s, letters = w, [c for c in unicodedata.normalize("NFD", w) if unicodedata.category(c)[0] == "L"]
        plain, wide = ANY, ANY
        for c in letters:
            plain &= _bits(c, t)
            wide &= _bits(c, t) | sum(t["twins"].get(c, ()))
        small = any(1 in t["twins"].get(c, ()) and _script(c, t) == 1 for c in letters)  # small capitals and the like
        if len(letters) >= WORD and wide and (not plain or small):
            fits = plain or wide
            target = fits & -fits
            strange = lambda c: target in t["twins"].get(c, ()) and (not _bits(c, t) & target or (target == 1 and _script(c, t) == 1))
            if 2 * sum(map(strange, letters)) <= len(letters):
                s = unicodedata.normalize("NFC", "".join(t["twins"][c][target] if strange(c) else c for c in unicodedata.normalize("NFD", w)))
        if len(t["folded"]) > 200_000:
            t["folded"].clear()
        t["folded"][w] = s
    return s


def folded(text: str) -> str:
    """The form in which two texts are equal if and only if they look the same."""
    s, t = skeleton(text), _tables()
    if s.isascii() or not t.get("strange"):
        return s
    out, last, n = [], 0, len(s)
    for m in t["strange"].finditer(s):
        a, b = m.span()
        if a < last:
            continue
        while a > last and s[a - 1].isalpha():
            a -= 1
        while b < n and s[b].isalpha():
            b += 1
        out += [s[last:a], _fold(s[a:b], t)]
        last = b
    return "".join([*out, s[last:]])


def _spell(w: str, main: int, t: dict) -> str:
    """A word of a skeleton in the script that fits all of its letters, in ``main`` if that is one of several."""
    key = (w, main)
    s = t["spelled"].get(key)
    if s is None:
        b = ANY
        for ch in w:
            b &= _bits(ch, t)
        if len(w) < 3 and main != 4:
            b &= ~4  # a short run of letters with a Greek one is a formula's symbol, not a Greek word
        k = main if b & main else next((x for x in (1, 2, 4, 8) if b & x), 1)
        s = unicodedata.normalize("NFC", "".join(t["back"][k].get(c, c) for c in unicodedata.normalize("NFD", w))) if k > 1 else w
        if len(t["spelled"]) > 200_000:
            t["spelled"].clear()
        t["spelled"][key] = s
    return s


#: Frequent Latin letters that no letter of the other scripts looks like.
PLAIN = "nrtdlmu"


def consistent(text: str | None) -> str | None:
    """The consistent form: the folded text, with every word in one script that fits all of its letters."""
    if text is None:
        return None
    s = folded(text)
    if s.isascii():
        return s
    t = _tables()
    runs = list(t["foreign"].finditer(s))
    if not runs:
        return s
    # The text's script: the one with most letters that no other script shares.
    votes = {1: sum(map(s.count, PLAIN)), 2: 0, 4: 0, 8: 0}
    for m in runs:
        votes[2 if m.group() >= "\u0400" and m.group() < "\u0530" else 4 if m.group() < "\u0400" else 8] += m.end() - m.start()
    main = max(votes, key=lambda k: (votes[k], -k))
    if main > 1:
        return t["word"].sub(lambda m: _spell(m.group(), main, t), s)
    # Elsewhere only words with a letter of another script can be spelled otherwise.
    out, last, n = [], 0, len(s)
    for m in runs:
        a, b = m.span()
        if a < last:
            continue
        while a > last and s[a - 1].isalpha():
            a -= 1
        while b < n and s[b].isalpha():
            b += 1
        out += [s[last:a], _spell(s[a:b], main, t)]
        last = b
    return "".join([*out, s[last:]])


def forms(documents: DataFrame) -> DataFrame:
    """doc_id and the consistent form of its text; one pass without a shuffle."""
    spark = documents.sparkSession
    table = spark.sparkContext.broadcast(confusables(spark))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        use(table.value)
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "text": [consistent(x) for x in b["text"]]})

    return documents.select("doc_id", "text").where("doc_id is not null").mapInPandas(run, "doc_id bigint, text string")


def digests(documents: DataFrame) -> DataFrame:
    """doc_id, 128-bit digest of the consistent form, and of the text itself; null texts are left out."""
    spark = documents.sparkSession
    table = spark.sparkContext.broadcast(confusables(spark))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        use(table.value)
        h = lambda s: hashlib.blake2b(s.encode("utf-8", "surrogatepass"), digest_size=16).digest()
        for b in batches:
            out = [(d, h(x), h(consistent(x))) for d, x in zip(b["doc_id"], b["text"], strict=True)]
            yield pd.DataFrame(out, columns=["doc_id", "own", "form"])

    return documents.select("doc_id", "text").where("doc_id is not null and text is not null").mapInPandas(run, "doc_id bigint, own binary, form binary")


def same_looks(documents: DataFrame) -> DataFrame:
    """doc_a < doc_b: pairs of documents of equal form and unequal texts.

    Only ids and digests are shuffled. Texts are first grouped into classes of equal texts; classes of one
    form are paired, and only those pairs are expanded to documents, so copies of one text are never
    compared with each other and the work follows the result.
    """
    d = cut(digests(documents).distinct())  # texts are read and put into form once
    classes = d.groupBy("form", "own").agg(F.count("*").alias("_n"))
    several = classes.groupBy("form").agg(F.count("*").alias("_k")).where("_k > 1").select("form")
    c = classes.join(several, "form", "left_semi").select("form", "own")
    pairs = c.select("form", F.col("own").alias("own_a")).join(c.select("form", F.col("own").alias("own_b")), "form").where("own_a < own_b").select("own_a", "own_b")
    a, b = d.select(F.col("own").alias("own_a"), F.col("doc_id").alias("a")), d.select(F.col("own").alias("own_b"), F.col("doc_id").alias("b"))
    return pairs.join(a, "own_a").join(b, "own_b").where("a <> b").select(F.least("a", "b").alias("doc_a"), F.greatest("a", "b").alias("doc_b")).distinct()


def classes(documents: DataFrame) -> DataFrame:
    """doc_id, class_id (the smallest doc_id of its form), size of the class, and links: documents of the form with another text.

    One row per document, whatever the number of copies; only ids, digests and counts are shuffled.
    """
    d = cut(digests(documents).groupBy("doc_id", "form", "own").agg(F.lit(1).alias("_one")))
    per_text = d.groupBy("form", "own").agg(F.countDistinct("doc_id").alias("_same"), F.min("doc_id").alias("_first"))
    per_form = per_text.groupBy("form").agg(F.sum("_same").alias("size"), F.min("_first").alias("class_id"))
    counts = per_text.join(per_form, "form").select("form", "own", "class_id", "size", (F.col("size") - F.col("_same")).alias("links"))
    return d.join(counts, ["form", "own"]).select("doc_id", "class_id", "size", "links")
