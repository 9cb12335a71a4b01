"""Loading delimited lines: valid rows come out typed, every other row with the reason it fails.

Structural indexing: the lines of an Arrow batch form one byte buffer. Masks of quote, separator and
blank bytes and the prefix parity of the quotes within a line locate the separators that count and the
ends of the values, without a loop over characters; the value counts and types then decide each line.

Defined results
---------------
* null and blank lines, and lines that start with one of ``HEADERS``, are no rows and come out nowhere;
* a line whose dialect is unknown or null fails with ``no_dialect``;
* repeated rows (same id) count once, rows without an id one by one; an empty table gives an empty result;
* further columns of the input do not take part; very long lines are handled as any other.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.session import once

#: How a header or comment line starts.
HEADERS = ("#", "TITLE", "VARIABLES", "ZONE")
#: A decimal number of ASCII digits, and what a field may hold besides.
FLOAT = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
MISSING = r"^([nN][aA][nN])?$"
SCHEMA = "line_id bigint, file_id bigint, case_id bigint, line_no int, write_time string, reason string, vertices array<double>, fields array<double>, labels array<string>"


def dialects(rows: list) -> dict:
    """The dialect table as a dictionary; it is a fixed table of a few rows."""
    return {
        r["dialect_id"]: {
            "sep": r["sep_char"],
            "quote": r["quote_char"] or '"',
            "names": list(r["column_names"]),
            "types": list(r["column_types"]),
            "vertices": [list(r["column_names"]).index(c) for c in r["vertex_columns"] or [] if c in r["column_names"]],
            "fields": [list(r["column_names"]).index(c) for c in r["field_columns"] or [] if c in r["column_names"]],
        }
        for r in rows
    }


def gather(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The byte ranges of ``buf`` as one string array, copied in a single gather."""
    size = end - start
    offsets = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=offsets[1:])
    at = np.arange(offsets[-1]) + np.repeat(start - offsets[:-1], size)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(buf[at].tobytes())]).cast(pa.large_string(), safe=False)


def structure(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, sep: int, quote: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the lines buf[starts:ends], each followed by one byte 10: which break the rules of quoting, the
    number of values of each, and start and end of all values in order (quotes and blanks around included).
    """
    n = len(buf)
    line = np.repeat(np.arange(len(starts)), ends - starts + 1)
    stop = np.zeros(n, bool)
    stop[ends] = True
    is_quote = (buf == quote) & ~stop
    count = np.cumsum(is_quote)
    base = np.where(starts > 0, count[starts - 1], 0)
    inside = ((count - base[line]) & 1).astype(bool)  # after this byte
    before = inside ^ is_quote  # before this byte
    is_sep = (buf == sep) & ~before & ~stop
    blank = (buf == 32) & ~stop if sep != 32 else np.zeros(n, bool)
    at = np.arange(n)
    # the nearest byte to the left and to the right that isn't blank
    left = np.maximum.accumulate(np.where(blank, -1, at))
    right = np.minimum.accumulate(np.where(blank, n, at)[::-1])[::-1]
    q = np.flatnonzero(is_quote)
    opens = ~before[q]
    prev, nxt = np.where(q > 0, q - 1, 0), np.minimum(q + 1, n - 1)
    lq = np.where(q > 0, left[prev], -1)
    first = (lq < 0) | (lq < starts[line[q]])
    after_sep = first | (~first & (is_sep[np.maximum(lq, 0)]))
    doubled_left = (q > starts[line[q]]) & is_quote[prev] & before[prev]
    rq = right[nxt]
    before_sep = stop[rq] | ((buf[rq] == sep) & ~stop[rq])
    doubled_right = is_quote[nxt]
    bad_quote = np.where(opens, ~(after_sep | doubled_left), ~(before_sep | doubled_right))
    bad = np.zeros(len(starts), bool)
    bad[line[q[bad_quote]]] = True
    bad |= inside[ends - 1] & (ends > starts)
    cuts = np.flatnonzero(is_sep | stop)
    values = np.bincount(line[cuts], minlength=len(starts))
    begin = np.empty(len(cuts), np.int64)
    begin[1:] = cuts[:-1] + 1
    if len(begin):
        begin[0] = 0
    return bad, values, begin, cuts


def check(lines: list[str], d: dict) -> tuple[np.ndarray, list, list, list]:
    """Reason (or None), vertices, fields and labels of each line of one dialect."""
    raw = [x.encode("utf-8", "surrogatepass") for x in lines]
    size = np.fromiter(map(len, raw), np.int64, len(raw))
    ends = np.cumsum(size + 1) - 1
    starts = ends - size
    buf = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    sep, quote = d["sep"].encode(), d["quote"].encode()
    if len(sep) != 1 or len(quote) != 1:
        raise ValueError("separator and quote must be one ASCII character each")
    bad, count, begin, end = structure(buf, starts, ends, sep[0], quote[0])
    reason = np.full(len(raw), None, object)
    k = len(d["types"])
    wrong = count != k
    good = ~bad & ~wrong
    reason[wrong] = "column_count"
    reason[bad] = "quoting"
    rows = np.flatnonzero(good)
    first = np.cumsum(count) - count
    vertices, fields, labels = ([None] * len(raw) for _ in range(3))
    if len(rows) == 0:
        return reason, vertices, fields, labels
    cell = first[rows][:, None] + np.arange(k)
    texts, numbers = {}, {}
    failed = np.zeros(len(rows), bool)
    for j, kind in enumerate(d["types"]):
        a = gather(buf, begin[cell[:, j]], end[cell[:, j]])
        if sep != b" ":
            a = pc.utf8_trim(a, " ")
        quoted = pc.and_(pc.starts_with(a, d["quote"]), pc.greater(pc.utf8_length(a), 1))
        if pc.any(quoted).as_py():
            inner = pc.replace_substring(pc.utf8_slice_codeunits(a, 1, -1), d["quote"] * 2, d["quote"])
            a = pc.if_else(quoted, pc.utf8_trim(inner, " ") if sep != b" " else inner, a)
        if kind == "label":
            texts[j] = a
            continue
        if kind == "flag":
            ok = pc.is_in(a, pa.array(["0", "1"], a.type))
            number = ok
        else:
            number = pc.match_substring_regex(a, FLOAT)
            ok = pc.or_(number, pc.match_substring_regex(a, MISSING)) if j in d["fields"] else number
        failed |= ~np.asarray(ok)
        numbers[j] = np.full(len(rows), np.nan)
        mask = np.asarray(number)
        numbers[j][mask] = np.asarray(pc.cast(pc.utf8_ltrim(a.filter(pa.array(mask)), "+"), pa.float64()))
    reason[rows[failed]] = "invalid_value"
    kept = np.flatnonzero(~failed)
    names = sorted(texts)
    vs = np.column_stack([numbers[j][kept] for j in d["vertices"]]) if d["vertices"] else np.zeros((len(kept), 0))
    fs = np.column_stack([numbers[j][kept] for j in d["fields"]]) if d["fields"] else np.zeros((len(kept), 0))
    ls = [texts[j].take(pa.array(kept)).to_pylist() for j in names]
    for i, (r, v, f) in enumerate(zip(rows[kept], vs.tolist(), fs.tolist(), strict=True)):
        vertices[r], fields[r], labels[r] = v, f, [x[i] for x in ls]
    return reason, vertices, fields, labels


def parse(known: dict, only_failed: bool):
    """The function for mapInArrow."""
    schema = pa.schema([("line_id", pa.int64()), ("file_id", pa.int64()), ("case_id", pa.int64()), ("line_no", pa.int32()), ("write_time", pa.string()), ("reason", pa.string()), ("vertices", pa.list_(pa.float64())), ("fields", pa.list_(pa.float64())), ("labels", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lines = b.column("raw_line").to_pylist()
            kind = b.column("dialect_id").to_pylist()
            reason, vertices, fields, labels = ([None] * len(lines) for _ in range(4))
            for k in set(kind):
                own = [i for i, x in enumerate(kind) if x == k]
                if k not in known:
                    for i in own:
                        reason[i] = "no_dialect"
                    continue
                for i, r, v, f, s in zip(own, *check([lines[i] for i in own], known[k]), strict=True):
                    reason[i], vertices[i], fields[i], labels[i] = r, v, f, s
            cols = [b.column(c).cast(schema.field(c).type) for c in schema.names[:5]] + [pa.array(x, schema.field(n).type) for n, x in zip(schema.names[5:], (reason, vertices, fields, labels), strict=True)]
            out = pa.RecordBatch.from_arrays(cols, schema=schema)
            yield out.filter(pc.is_valid(out.column("reason"))) if only_failed else out

    return run


def load_lines(lines: DataFrame, dialect: DataFrame, only_failed: bool = False) -> DataFrame:
    """Every row of ``lines`` once: with its vertices, fields and labels, or with the reason it fails.

    One pass without a shuffle; only the removal of repeated rows shuffles, on the row's id: the lines before they are
    parsed, or, where only failures are asked for, the few that fail.
    """
    known = dialects(dialect.collect())
    start = "|".join(map(re.escape, HEADERS))
    rows = lines.select("line_id", "file_id", "case_id", "line_no", "write_time", "dialect_id", "raw_line").where(
        F.col("raw_line").isNotNull() & F.col("raw_line").rlike(r"\S") & ~F.col("raw_line").rlike(f"^({start})")
    )
    if only_failed:
        return rows.mapInArrow(parse(known, True), SCHEMA).transform(once, "line_id")
    return once(rows, "line_id").mapInArrow(parse(known, False), SCHEMA)


def failed_lines(lines: DataFrame, dialect: DataFrame) -> DataFrame:
    """line_id and reason of the rows that fail."""
    return load_lines(lines, dialect, only_failed=True).select("line_id", "reason")
