"""Evaluation texts inside training documents: which document holds which item, fully or partly.

Size-partitioned MinHash containment search. A document is far larger than an item, and an item may be held
only by a part of ``words`` consecutive words, so signatures of whole texts would hardly ever agree. The unit
is therefore a window of ``words`` words of an item, and the windows are partitioned by their size in letters
(``BOUNDS``). A partition has a piece of one size, not longer than its windows: the piece that begins a window
is described by the MinHash of its shingles, and so is every piece of that size of the documents. Who holds a
window holds its first piece, whose MinHash is then equal on both sides: within a partition containment is
equality of MinHashes, no link is lost, and windows of unusual size only make work for their own partition.

Documents are read once. Their MinHashes are tested against two bit maps of the items' (at most ``BITS`` each,
whatever the number of items); what passes is shuffled with the letters around it and joined with the items'
MinHashes, and each pair is verified by exact comparison of the letters and the words' boundaries. Windows
that several items share are verified once. There is one way for any number of items.

Shingles are of up to ``K`` consecutive letters or digits of the text without what lies between its words, so
that case, punctuation, layout and divided words don't disturb them. Between words the verification tells apart
sure boundaries and those that a line break leaves open.

Defined results
---------------
* words count regardless of case in every script: letters that look alike in either case are one letter;
* null texts and items of fewer than ``words`` words give no rows, nor do rows with null ids;
* documents and items of one id and equal text count once; an empty table gives an empty result;
* texts of any length are processed whole; further columns do not take part.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm.textforms import ARMENIAN, CYRILLIC, GREEK, LATIN, skeleton
from tidewright.session import cut

WORDS, K = 12, 24
#: Smallest window of each partition, in letters; the last partition is open.
BOUNDS = (1, 4, 8, 12, 16, 24, 36, 54, 80, 120, 180)
#: Most bits of each map of the items' MinHashes, and bits per MinHash below that.
BITS, SPARSE = 1 << 27, 1024
#: What joins: partition, MinHash, and letters and boundaries around the shingle (one boundary more than letters).
WHERE = "part int, hash bigint, at int, code binary, flags binary"
#: No hash: the piece or shingle would leave its text.
NEVER = np.uint64(2**64 - 1)
#: In a stream: no boundary before this letter, a sure one, or one that a line break leaves open.
NONE, SURE, OPEN = 0, 1, 2
_STATE: dict = {}


def _lower() -> dict[str, str]:
    """Small letters of which either case looks like a Latin letter, as that letter: в by its capital В is b.

    The skeleton knows each case by itself, so without this В and в would be two letters after casefold.
    """
    pairs = ((a.casefold(), b.casefold()) for own, latin in (CYRILLIC, GREEK, ARMENIAN, LATIN) for a, b in zip(own, latin, strict=True))
    return dict(pairs)


def _codes() -> np.ndarray:
    """Per code point of the basic plane: 0 between words, 1 shows nothing by itself, else its letter."""
    if "codes" not in _STATE:
        t, lower = np.zeros(65537, np.uint32), _lower()
        for c in range(65536):
            ch = chr(c)
            kind = unicodedata.category(ch)
            if kind[0] == "M":
                t[c] = 1
            elif ch.isalnum():
                base = unicodedata.normalize("NFKD", ch)[0]
                t[c] = ord(lower.get(base, base)) if base.isalnum() else c
        t[65536] = 2  # beyond the basic plane: looked up one by one
        _STATE["codes"] = t
    return _STATE["codes"]


def stream(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Letters of all texts in a row, the boundary before each, and where each text begins (and the end)."""
    table = _codes()
    clean = [skeleton(x).casefold() for x in texts]
    raw = np.frombuffer("\0".join(clean).encode("utf-32-le", "surrogatepass") if clean else b"", np.uint32)
    code = table[np.minimum(raw, 65536)]
    for i in np.flatnonzero(code == 2):
        ch = chr(raw[i])
        code[i] = raw[i] if ch.isalnum() else 0
    n = len(raw)
    letter = code > 1
    at = np.flatnonzero(letter)
    # What lies between neighbouring letters: something, a line break, anything but blanks and hyphens.
    total = lambda mask: np.concatenate(([0], np.cumsum(mask)))
    some = total(code == 0)
    breaks = total(raw == 10)
    plain = total((raw == 10) | (raw == 32) | (raw == 45) | (code == 1))
    prev = np.concatenate(([-1], at[:-1])) if len(at) else at
    gap = some[at] - some[prev + 1]
    flags = np.where(gap == 0, NONE, SURE).astype(np.uint8)
    flags[(breaks[at] - breaks[prev + 1] > 0) & (plain[at] - plain[prev + 1] == at - prev - 1)] = OPEN
    size = np.fromiter(map(len, clean), np.int64, len(clean))
    start = np.cumsum(size + 1) - size - 1
    begin = np.searchsorted(at, np.append(start, n + 1))
    flags[begin[:-1][begin[:-1] < len(flags)]] = SURE
    return code[at], flags, begin


def shingles(code: np.ndarray, begin: np.ndarray, k: int) -> np.ndarray:
    """A hash of each ``k`` consecutive letters; the largest number where they would leave their text."""
    h = code.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    size, base = 1, np.uint64(0x100000001B3)
    out, done, power = None, 0, {1: base}
    bits = k
    with np.errstate(over="ignore"):
        while bits:
            if bits & 1:
                out = h.copy() if out is None else _combine(out, h, done, power[size])
                done += size
            bits >>= 1
            if bits:
                h = _combine(h, h, size, power[size])
                power[size * 2] = power[size] * power[size]
                size *= 2
        out ^= out >> np.uint64(29)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(32)
    for e in begin[1:]:
        out[max(0, e - k + 1) : e] = NEVER
    return out


def _combine(a: np.ndarray, b: np.ndarray, shift: int, power: np.uint64) -> np.ndarray:
    r = a * power
    r[: len(r) - shift] += b[shift:]
    return r


def piece(part: int) -> tuple[int, int]:
    """Letters of a shingle, and shingles of a piece, in a partition."""
    k = max(1, min(K, BOUNDS[part] * 2 // 3))
    return k, BOUNDS[part] - k + 1


def _around(part: int, h: np.uint64, at: int, code: np.ndarray, flags: np.ndarray, begin: int, end: int, reach: int) -> tuple:
    """The row of a shingle at ``at`` of the text code[begin:end], with ``reach`` letters on either side of it."""
    lo, hi = max(begin, at - reach), min(end, at + reach)
    after = flags[hi] if hi < end else SURE
    return part, int(np.uint64(h).view(np.int64)), at - lo, code[lo:hi].tobytes(), np.append(flags[lo:hi], np.uint8(after)).tobytes()


def windows(text: str, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """An item's letters and boundaries, and of each window of ``words`` words its first letter, its size and its partition."""
    # Items are spelled in full lines; a word divided at a line's end is one word.
    code, flags, _ = stream([re.sub(r"(?<=\w)[-\xad]\s*\n\s*(?=\w)", "", skeleton(text))])
    flags = np.minimum(flags, SURE)
    first = np.flatnonzero(flags)
    ends = np.append(first[1:], len(code))
    n = max(0, len(first) - words + 1)
    size = ends[words - 1 :][:n] - first[:n]
    return code, flags, first[:n], size, np.searchsorted(BOUNDS, size, "right") - 1


def item_rows(text: str, words: int = WORDS) -> list[tuple]:
    """One row per MinHash of an item's windows."""
    code, flags, first, size, parts = windows(text, words)
    out = {}
    for part in np.unique(parts):
        k, w = piece(int(part))
        h = shingles(code, np.array([0, len(code)]), k)
        own = parts == part
        for s in first[own]:
            at = int(s) + int(np.argmin(h[s : s + w]))
            out[int(part), at] = h[at]
    most = int(size.max()) + 1 if len(size) else 0
    return [_around(part, h, at, code, flags, 0, len(code), most) for (part, at), h in out.items()]


class Marks:
    """Two bit maps of MinHashes: what neither or only one of them knows is none of the items'."""

    def __init__(self, bits: int, words: list[tuple[int, int, int]]):
        self.shift = np.uint64(64 - (bits.bit_length() - 1))
        self.maps = np.zeros((2, bits // 64), np.uint64)
        for which, word, value in words:
            self.maps[which, word] = np.int64(value).view(np.uint64)

    @staticmethod
    def places(h: np.ndarray, shift: np.uint64) -> tuple[np.ndarray, np.ndarray]:
        return h >> shift, (h * np.uint64(0x9E3779B97F4A7C15)) >> shift

    def hold(self, h: np.ndarray) -> np.ndarray:
        """Which of the hashes may be an item's."""
        ok = np.ones(len(h), bool)
        at = np.arange(len(h))
        with np.errstate(over="ignore"):
            for m, place in zip(self.maps, (lambda x: x >> self.shift, lambda x: (x * np.uint64(0x9E3779B97F4A7C15)) >> self.shift), strict=True):
                p = place(h[at])
                good = (m[p >> np.uint64(6)] >> (p & np.uint64(63))) & np.uint64(1) == 1
                ok[at[~good]] = False
                at = at[good]
        return ok


def marks(hashes: DataFrame, bits: int = BITS) -> Marks:
    """The bit maps of the column ``hash``: put together by the cluster in words of 64 bits, of which there are few."""
    n = hashes.count()
    bits = max(64, min(bits, 1 << max(16, (SPARSE * max(n, 1) - 1).bit_length())))

    def words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shift = np.uint64(64 - (bits.bit_length() - 1))
        for b in batches:
            h = b["hash"].to_numpy().view(np.uint64)
            with np.errstate(over="ignore"):
                for which, p in enumerate(Marks.places(h, shift)):
                    yield pd.DataFrame({"which": which, "word": (p >> np.uint64(6)).astype(np.int64), "bit": (np.uint64(1) << (p & np.uint64(63))).view(np.int64)})

    made = hashes.select("hash").mapInPandas(words, "which int, word bigint, bit bigint").groupBy("which", "word").agg(F.bit_or("bit").alias("bit"))
    return Marks(bits, [tuple(r) for r in made.collect()])


def runs_of_minima(h: np.ndarray, sizes: list[int]) -> Iterator[tuple[int, np.ndarray]]:
    """Of each number of shingles, in ascending order: the MinHash of the piece that begins at each place. Minima over
    powers of two are formed once for all of them."""
    m, have = h, 1
    for w in sorted(sizes):
        while have * 2 <= w:
            m = np.minimum(m[:-have] if len(m) > have else m[:0], m[have:])
            have *= 2
        rest = w - have
        yield w, np.minimum(m[: len(m) - rest], m[rest:]) if rest else m


def hits(texts: list[str], known: Marks, parts: dict[int, int]) -> list[tuple]:
    """(position of the text, row) of every shingle of the texts that may be an item's. ``parts``: partition and reach."""
    code, flags, begin = stream(texts)
    out, by_k = [], {}
    for part, reach in parts.items():
        k, w = piece(part)
        by_k.setdefault(k, {})[w] = (part, reach)
    for k, own in by_k.items():
        h = shingles(code, begin, k)
        for w, m in runs_of_minima(h, list(own)):
            part, reach = own[w]
            if len(m) == 0:
                continue
            start = np.flatnonzero(np.concatenate(([True], m[1:] != m[:-1])))
            found = np.flatnonzero(known.hold(m[start]))
            if len(found) == 0:
                continue
            # A run of equal minima: every place in it and in its last piece where the shingle stands. A piece may
            # reach into the next text; the place then counts there.
            stop = np.append(start[1:], len(m)) + w - 1
            at = {s + int(i) for s, e in zip(start[found].tolist(), stop[found].tolist(), strict=True) if m[s] != NEVER for i in np.flatnonzero(h[s:e] == m[s])}
            for p in sorted(at):
                d = int(np.searchsorted(begin, p, "right")) - 1
                out.append((d, _around(part, h[p], p, code, flags, int(begin[d]), int(begin[d + 1]), reach)))
    return out


def agrees(doc: tuple[np.ndarray, np.ndarray, int], item: tuple[np.ndarray, np.ndarray, int], words: int = WORDS) -> bool:
    """Whether the document's letters hold ``words`` words of the item's, both laid on each other at their shingle."""
    (cd, fd, ad), (ci, fi, ai) = doc, item
    shift = ad - ai
    lo, hi = max(0, -shift), min(len(ci), len(cd) - shift)
    if hi <= lo:
        return False
    y, g = ci[lo:hi], fi[lo : hi + 1]
    f = fd[lo + shift : hi + shift + 1]
    same = cd[lo + shift : hi + shift] == y
    fits = (f[:-1] == OPEN) | ((f[:-1] == SURE) == (g[:-1] == SURE))
    link = same.copy()
    link[1:] &= same[:-1] & fits[1:]  # continues from the letter before
    starts = np.flatnonzero(g[:-1])
    stops = np.append(starts[1:], hi - lo)
    broken = np.cumsum(~link)
    for i in range(len(starts) - words + 1):
        s, e = starts[i], stops[i + words - 1]
        if g[e] == NONE:
            break  # the last word is cut off
        if same[s] and f[s] != NONE and broken[e - 1] == broken[s] and f[e] != NONE:
            return True
    return False


def leaked(documents: DataFrame, items: DataFrame, words: int = WORDS, bits: int = BITS) -> DataFrame:
    """doc_id and item_id of every document that holds ``words`` consecutive words of an item."""
    docs = documents.select("doc_id", "text").where("doc_id is not null and text is not null")
    test = items.select("item_id", "text").where("item_id is not null and text is not null").dropDuplicates()

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(i, *r) for i, x in zip(b["item_id"], b["text"], strict=True) for r in item_rows(x, words)]
            yield pd.DataFrame(rows, columns=["item_id", "part", "hash", "at", "code", "flags"])

    index = cut(test.mapInPandas(sign, f"item_id bigint, {WHERE}"))
    # Of each partition the longest reach (letters are four bytes); there are as many rows as partitions.
    reach = index.groupBy("part").agg(F.max(F.octet_length("code") / 4).cast("int").alias("reach"))
    parts = {r["part"]: r["reach"] for r in reach.collect()}
    known = docs.sparkSession.sparkContext.broadcast((marks(index, bits), parts))

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts, ids = b["text"].tolist(), b["doc_id"].tolist()
            for lo, hi in _groups(texts):
                rows = [(ids[lo + d], *r) for d, r in hits(texts[lo:hi], *known.value)]
                yield pd.DataFrame(rows, columns=["doc_id", "part", "hash", "at", "code", "flags"])

    found = docs.mapInPandas(find, f"doc_id bigint, {WHERE}")
    shared = index.groupBy("part", "hash", F.col("at").alias("i_at"), F.col("code").alias("i_code"), F.col("flags").alias("i_flags")).agg(F.collect_set("item_id").alias("items"))

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        array = lambda code, flags, at: (np.frombuffer(code, np.uint32), np.frombuffer(flags, np.uint8), at)
        for b in batches:
            ok = [agrees(array(r.code, r.flags, r.at), array(r.i_code, r.i_flags, r.i_at), words) for r in b.itertuples(index=False)]
            yield b.loc[np.array(ok, bool), ["doc_id", "items"]]

    pairs = found.join(shared, ["part", "hash"]).select("doc_id", "items", "at", "code", "flags", "i_at", "i_code", "i_flags")
    sure = pairs.mapInPandas(verify, "doc_id bigint, items array<bigint>")
    return sure.select("doc_id", F.explode("items").alias("item_id")).distinct()


def _groups(texts: list[str], most: int = 2_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``most`` characters, which bounds the memory of a step."""
    lo, n = 0, 0
    for i, x in enumerate(texts):
        n += len(x)
        if n >= most:
            yield lo, i + 1
            lo, n = i + 1, 0
    if lo < len(texts):
        yield lo, len(texts)
