"""Texts of varying length in containers of fixed capacity, by best-two-fit.

Sizes are tokens of a public tokenizer. A text longer than a container is split into full containers and a
rest; nothing else is split. Containers are planned on the histogram of the sizes, which has at most
``capacity`` entries whatever the number of texts: a container is filled greedily, then its smallest item is
replaced by the two unpacked sizes that fill the gap best, as long as that fills it more tightly; the same
container is repeated as often as the counts allow. A plan has at most some capacity * ln(capacity) kinds of
containers. Every item then finds its container from its position among the items of its size, which is
counted without one task holding a size.

Defined results
---------------
* a null text is no item; a text without tokens takes no space and stands in container 0;
* rows count as they stand: two rows of one doc_id are two items; further columns do not take part;
* an empty table gives an empty result.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.session import cut, ranked

CAPACITY = 2048
TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: The pattern that splits text before the merges of the rank file.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_STATE: dict = {}


def encoder(path: str):
    """The tokenizer of a rank file, loaded once per Python process."""
    if path not in _STATE:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _STATE[path] = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _STATE[path]


def token_counts(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """doc_id and number of tokens of every text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        e = encoder(tokenizer)
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "tokens": [len(e.encode_ordinary(x)) for x in b["text"]]})

    return documents.select("doc_id", "text").where("text is not null").mapInPandas(run, "doc_id bigint, tokens bigint")


def _two(sizes: np.ndarray, free: np.ndarray, room: int) -> tuple[int, int] | None:
    """The two free sizes with the largest sum of at most ``room``; the larger one first."""
    s = sizes[(free[sizes] > 0) & (sizes < room)]
    if len(s) == 0:
        return None
    partner = np.searchsorted(s, room - s, "right") - 1
    partner = np.minimum(partner, np.arange(len(s)))  # the second is not larger than the first
    same = (partner == np.arange(len(s))) & (free[s] < 2)
    partner = np.where(same, partner - 1, partner)
    ok = partner >= 0
    if not ok.any():
        return None
    total = np.where(ok, s + s[np.maximum(partner, 0)], -1)
    i = int(np.argmax(total))
    return int(s[i]), int(s[partner[i]])


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """Kinds of containers (how often they hold each size) and how often each is used."""
    left = np.zeros(capacity + 1, np.int64)
    for s, n in counts.items():
        left[s] = n
    out = []
    sizes = np.flatnonzero(left)
    sizes = sizes[sizes > 0]
    while len(sizes):
        free, bin_, room = left.copy(), {}, capacity
        while room:
            i = np.searchsorted(sizes, room, "right") - 1
            while i >= 0 and free[sizes[i]] == 0:
                i -= 1
            if i < 0:
                break
            s = int(sizes[i])
            k = min(int(free[s]), room // s)
            bin_[s] = bin_.get(s, 0) + k
            free[s] -= k
            room -= k * s
        while room:
            small = min(bin_)
            two = _two(sizes, free, room + small)
            if two is None or sum(two) <= small:
                break
            bin_[small] -= 1
            if not bin_[small]:
                del bin_[small]
            free[small] += 1
            for s in two:
                bin_[s] = bin_.get(s, 0) + 1
                free[s] -= 1
            room += small - sum(two)
        times = min(int(left[s]) // k for s, k in bin_.items())
        for s, k in bin_.items():
            left[s] -= times * k
        out.append((bin_, times))
        sizes = sizes[left[sizes] > 0]
    return out


def places(kinds: list[tuple[dict[int, int], int]], first: int = 0) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per size: from which position on, which container comes next, and how many items of the size it takes."""
    out: dict[int, list] = {}
    used: dict[int, int] = {}
    for bin_, times in kinds:
        for s, k in bin_.items():
            out.setdefault(s, []).append((used.get(s, 0), first, k))
            used[s] = used.get(s, 0) + times * k
        first += times
    return {s: tuple(np.array(c, np.int64) for c in zip(*rows, strict=True)) for s, rows in out.items()}


def packed(documents: DataFrame, capacity: int = CAPACITY, tokenizer: str = TOKENIZER, stretch: int = 100_000) -> DataFrame:
    """doc_id, piece, start_token, n_tokens and container of every item."""
    n = F.col("tokens")
    counted = cut(token_counts(documents, tokenizer))
    full = F.floor((n - 1) / capacity)  # the last piece is the rest, which may fill a container as well
    at = F.when(n > capacity, F.sequence(F.lit(0).cast("bigint"), full)).otherwise(F.array(F.lit(0).cast("bigint")))
    items = counted.withColumn("piece", F.explode(at)).select("doc_id", "piece", (F.col("piece") * capacity).alias("start_token"), F.least(n - F.col("piece") * capacity, F.lit(capacity)).alias("n_tokens"))
    counts = {r[0]: r[1] for r in items.groupBy("n_tokens").count().collect()}  # at most capacity + 1 rows
    spark = documents.sparkSession
    where = spark.sparkContext.broadcast(places(plan({s: c for s, c in counts.items() if s}, capacity)))
    buckets = max(1, sum(counts.values()) // stretch)
    spread = F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets))
    placed = ranked(items.withColumn("bucket", spread), ["n_tokens"], ["doc_id", "piece"], "bucket", "pos").drop("bucket")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            size, pos = b["n_tokens"].to_numpy(), b["pos"].to_numpy()
            out = np.zeros(len(b), np.int64)
            for s in np.unique(size[size > 0]):
                own = size == s
                begin, first, k = where.value[int(s)]
                i = np.searchsorted(begin, pos[own], "right") - 1
                out[own] = first[i] + (pos[own] - begin[i]) // k[i]
            yield b.assign(container=out).drop(columns="pos")

    return placed.select("doc_id", "piece", "start_token", "n_tokens", "pos").mapInPandas(run, "doc_id bigint, piece bigint, start_token bigint, n_tokens bigint, container bigint")


def usage(made: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """How full the containers are: number, tokens, share used, and the containers that break the capacity."""
    per = made.groupBy("container").agg(F.sum("n_tokens").alias("used"))
    return per.agg(F.count("*").alias("containers"), F.sum("used").alias("tokens"), (F.sum("used") / (F.count("*") * capacity)).alias("share"), F.sum((F.col("used") > capacity).cast("bigint")).alias("over"))
