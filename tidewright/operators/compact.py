"""Many small snapshot files as few large ones, each record of the input exactly once.

Byte-level concatenation: the bytes of a member stand in its bundle as they stand in its file, comments, blank
lines and line ends included, behind one header that names the member. A file that doesn't end its last line
gets a line end, which the header tells. As ``zstd`` every member is a complete frame, and its header a frame
that decoders skip, so a bundle is still one valid stream; frames that exist already are joined by
:func:`join_frames` without being opened. Lengths and checksums of members and bundles are written beside
them and tested again by :func:`verify`.

Records have to be looked at only where two files share case, processor, field and time and differ in their
bytes: there a record that stands in several files stays in the smallest file_id, and a file whose records
all stand in one other file is left out. Everywhere else bytes are compared by their digest. Of a record that
stands twice in one file the first stays; that is looked for while the bundle is joined, and needs no numbers
where point numbers are plain and differ.

Defined results
---------------
* a file without records (null, empty, only comments or blank lines) adds none;
* a file that only several others together make superfluous stays a member, with the records that remain;
* rows of one file_id count once; files without one count one by one, behind all others, and show a null
  or no id where they are named; null keys form a key of their own; a write time that is no number is
  compared as text;
* a line that is no record (not a point number and a value) is compared as text and copied;
* an empty table gives an empty result; further columns do not take part.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewright.session import cut, folder_for

TARGET = 1_000_000
KEY = ["case_id", "processor", "field_name", "moment"]
#: Bytes of a member's header, about; files per stretch while sizes are added up.
HEADER, STRETCH = 110, 1024
#: The magic numbers of a zstandard frame, and of a frame that decoders skip.
FRAME, SKIP = 0xFD2FB528, 0x184D2A50
#: A point number that equals another only if its digits do.
PLAIN = re.compile(rb"^(0|[1-9][0-9]*)$")


def records(body: Column) -> Column:
    """The record lines of a body: neither blank nor a comment."""
    return F.filter(F.split(F.coalesce(body, F.lit("")), r"\r?\n"), lambda x: (F.trim(x) != "") & ~F.ltrim(x).startswith("#"))


def number_key(line: Column) -> Column:
    """A record as point number and value, equal for equal numbers; other lines stay as text."""
    bits = F.split(F.trim(line), r"[,\s]+")
    point, value = F.element_at(bits, 1).try_cast("double"), F.when(F.size(bits) > 1, F.element_at(bits, 2)).try_cast("double")
    as_numbers = F.concat_ws(" ", (point + F.lit(0.0)).cast("string"), (value + F.lit(0.0)).cast("string"))
    return F.when((F.size(bits) == 2) & point.isNotNull() & value.isNotNull(), as_numbers).otherwise(F.trim(line))


def numbered(files: DataFrame) -> DataFrame:
    """The rows with ``known``: whether file_id is their own; rows without one get numbers behind all others."""
    found = files.withColumn("known", F.col("file_id").isNotNull())
    if files.where("file_id is null").limit(1).count() == 0:
        return found
    top = files.agg(F.coalesce(F.max("file_id"), F.lit(0))).first()[0]
    return cut(found.withColumn("file_id", F.coalesce("file_id", F.lit(top + 1) + F.monotonically_increasing_id())))


class Plan:
    """What happens to every file, decided without moving a body."""

    def __init__(self, files: DataFrame, target: int = TARGET):
        self.rows = numbered(files)
        moment = F.coalesce((F.col("write_time").try_cast("double") + F.lit(0.0)).cast("string"), F.concat(F.lit("="), F.col("write_time")))
        keys = [F.coalesce(F.col(c).cast("string"), F.lit("\0")).alias(f"k_{c}") for c in KEY[:3]] + [F.coalesce(moment, F.lit("\0")).alias("k_moment")]
        text = F.coalesce("body", F.lit(""))
        holds = text.rlike(r"(?md)^ *[^# \r\n]")
        narrow = self.rows.select("file_id", "known", "case_id", *keys, F.unhex(F.sha2(text, 256)).alias("digest"), F.octet_length(text).cast("bigint").alias("n"), holds.alias("holds"))
        #: One row per file: its key, and digest and length of its body.
        self.files = cut(narrow.dropDuplicates(["file_id"]))
        self.target = target
        self._contested()

    def _contested(self) -> None:
        k = [f"k_{c}" for c in KEY]
        full = self.files.where("holds")
        firsts = full.groupBy(*k, "digest").agg(F.min("file_id").alias("file_id"), F.count("*").alias("copies"))
        same = full.join(firsts.where("copies > 1").select(*k, "digest", F.col("file_id").alias("kept")), [*k, "digest"]).where("file_id <> kept").select("file_id")
        several = firsts.groupBy(*k).agg(F.count("*").alias("kinds")).where("kinds > 1").select(*k)
        ids = firsts.join(several, k, "left_semi").select("file_id", *k)
        lines = self.rows.select("file_id", "body").join(ids, "file_id").dropDuplicates(["file_id"])
        lines = lines.select("file_id", *k, F.transform(records(F.col("body")), number_key).alias("lines"))
        #: Files of one key with differing bytes: their records in order, and as a set.
        sets = cut(lines.withColumn("recs", F.array_sort(F.array_distinct("lines"))))
        signed = sets.select("file_id", *k, F.sha2(F.concat_ws("\n", "recs"), 256).alias("sig"))
        heads = signed.groupBy(*k, "sig").agg(F.min("file_id").alias("kept"), F.count("*").alias("copies")).where("copies > 1")
        equal = signed.join(heads, [*k, "sig"]).where("file_id <> kept").select("file_id")
        gone = self.files.where("not holds").select("file_id").union(same).union(equal).union(self._inside(sets, k))
        #: Files that add nothing.
        self.gone = cut(gone.distinct())
        rows = sets.join(self.gone, "file_id", "left_anti").select("file_id", *k, F.posexplode("lines").alias("pos", "rec"))
        use = rows.groupBy(*k, "rec").agg(F.countDistinct("file_id").alias("n"), F.min("file_id").alias("home")).where("n > 1").drop("n")
        #: The places of records that stand in a smaller file of the key as well.
        self.drops = rows.join(use, [*k, "rec"]).where("file_id <> home").groupBy("file_id").agg(F.array_sort(F.collect_set("pos")).alias("dropped"))

    @staticmethod
    def _inside(sets: DataFrame, k: list[str]) -> DataFrame:
        """Files whose records all stand in one other, larger file.

        Whoever holds a whole set holds its rarest record, so a set is looked up through that alone; of those who
        hold it only larger ones whose 256 marks cover the set's marks are compared in full.
        """
        def mark(word: int) -> Column:
            one = lambda r: F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(F.xxhash64(r), F.lit(64)).cast("int"))
            own = lambda r: F.pmod(F.shiftright(F.xxhash64(r), 6), F.lit(4)) == word
            return F.aggregate("recs", F.lit(0).cast("bigint"), lambda m, r: m.bitwiseOR(F.when(own(r), one(r)).otherwise(F.lit(0).cast("bigint"))))

        marked = sets.select("file_id", *k, "recs", F.size("recs").alias("size"), *(mark(w).alias(f"m{w}") for w in range(4)))
        held = marked.select("file_id", *k, "size", "m0", "m1", "m2", "m3", F.explode("recs").alias("rec"))
        use = held.groupBy(*k, "rec").agg(F.count("*").alias("uses"))
        rare = held.join(use, [*k, "rec"]).groupBy("file_id", *k).agg(F.min(F.struct("uses", "rec")).alias("r"), *(F.first(c).alias(c) for c in ("size", "m0", "m1", "m2", "m3")))
        probe = rare.where("r.uses > 1").select(F.col("file_id").alias("small"), *k, F.col("r.rec").alias("rec"), F.col("size").alias("s_size"), *(F.col(f"m{w}").alias(f"s{w}") for w in range(4)))
        covers = " and ".join(f"(s{w} & ~m{w}) = 0" for w in range(4))
        pairs = probe.join(held, [*k, "rec"]).where(f"s_size < size and {covers}").select("small", F.col("file_id").alias("big"))
        whole = pairs.join(sets.select(F.col("file_id").alias("small"), F.col("recs").alias("a")), "small").join(sets.select(F.col("file_id").alias("big"), F.col("recs").alias("b")), "big")
        return whole.where(F.size(F.array_except("a", "b")) == 0).select(F.col("small").alias("file_id"))

    def places(self) -> DataFrame:
        """file_id, case and bundle of the files kept: a case's files in order of id, cut where ``target`` bytes are full.

        Sizes are added up within stretches of ids first and then over the stretches, so no task orders a case.
        """
        kept = self.files.join(self.gone, "file_id", "left_anti").withColumn("size", F.col("n") + HEADER).withColumn("stretch", F.floor(F.col("file_id") / STRETCH))
        case = F.coalesce(F.col("case_id").cast("string"), F.lit("\0"))
        kept = kept.withColumn("k_case", case)
        sums = kept.groupBy("k_case", "stretch").agg(F.sum("size").alias("s"))
        before = W.partitionBy("k_case").orderBy("stretch").rowsBetween(W.unboundedPreceding, -1)
        starts = sums.select("k_case", "stretch", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("start"))
        own = W.partitionBy("k_case", "stretch").orderBy("file_id").rowsBetween(W.unboundedPreceding, -1)
        at = F.col("start") + F.coalesce(F.sum("size").over(own), F.lit(0))
        return kept.join(starts, ["k_case", "stretch"]).select("file_id", "known", "case_id", F.floor(at / self.target).cast("int").alias("bundle"))


BUNDLE = T.StructType(
    [
        T.StructField("case_id", T.LongType()),
        T.StructField("bundle", T.IntegerType()),
        T.StructField("n_files", T.IntegerType()),
        T.StructField("n_records", T.LongType()),
        T.StructField("data_bytes", T.LongType()),
        T.StructField("n_bytes", T.LongType()),
        T.StructField("crc32", T.LongType()),
        T.StructField("sha256", T.StringType()),
        T.StructField("members", T.ArrayType(T.LongType())),
        T.StructField("body", T.BinaryType()),
    ]
)


def _same(line: bytes):
    """A record as two numbers, or as its text."""
    bits = re.split(rb"[,\s]+", line.strip(b" "))
    if len(bits) == 2:
        try:
            return float(bits[0]) + 0.0, float(bits[1]) + 0.0
        except ValueError:
            pass
    return line.strip(b" ")


def member_bytes(data: bytes, dropped: set[int]) -> tuple[bytes, int, bool]:
    """A file's bytes without the ``dropped`` record lines and without repeats of its own records: those bytes,
    the number of records, and whether a line end was added."""
    lines = data.split(b"\n")
    is_record = []
    for x in lines:
        bare = x.removesuffix(b"\r").strip(b" ")
        is_record.append(bool(bare) and not bare.startswith(b"#"))
    own = [i for i, r in enumerate(is_record) if r]
    out = {own[p] for p in dropped}
    points = [re.split(rb"[,\s]", lines[i].strip(b" "), maxsplit=1)[0] for i in own]
    if len(set(points)) < len(points) or not all(map(PLAIN.match, points)):
        seen = set()
        for i in own:
            key = _same(lines[i].removesuffix(b"\r"))
            if i not in out and key in seen:
                out.add(i)
            seen.add(key)
    count = len(own) - len(out)
    if out:
        last = lines[-1]
        data = b"".join(x + b"\n" for i, x in enumerate(lines[:-1]) if i not in out)
        if last and len(lines) - 1 not in out:
            data += last
    open_ = bool(data) and not data.endswith(b"\n")
    return (data + b"\n" if open_ else data), count, open_


def _header(r, count: int, data: bytes, open_: bool) -> bytes:
    return f"# member file_id={r.file_id if r.known else ''} processor={r.processor} time={r.write_time} field={r.field_name} records={count} bytes={len(data)} open={int(open_)} crc32={zlib.crc32(data)}\n".encode()


def skippable(payload: bytes) -> bytes:
    """A frame that decoders pass over."""
    return struct.pack("<II", SKIP, len(payload)) + payload


def joiner(codec: str):
    """The function that joins the files of one bundle."""
    if codec not in ("plain", "zstd"):
        raise ValueError(f"unknown codec {codec!r}")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("file_id").sort_values("file_id", kind="stable")
        press = zstandard.ZstdCompressor(write_checksum=True, write_content_size=True)
        out, records_, size = [], 0, 0
        for r in pdf.itertuples(index=False):
            data, count, open_ = member_bytes((r.body or "").encode(), set() if r.dropped is None else set(r.dropped))
            head = _header(r, count, data, open_)
            out += [head, data] if codec == "plain" else [skippable(head), press.compress(data)]
            records_, size = records_ + count, size + len(data)
        body = b"".join(out)
        case = pdf["case_id"].iloc[0]
        row = {"case_id": None if pd.isna(case) else int(case), "bundle": int(pdf["bundle"].iloc[0]), "n_files": len(pdf), "n_records": records_, "data_bytes": size}
        return pd.DataFrame([row | {"n_bytes": len(body), "crc32": zlib.crc32(body), "sha256": hashlib.sha256(body).hexdigest(), "members": pdf["file_id"].tolist(), "body": body}])

    return run


def bundles(files: DataFrame, target: int = TARGET, codec: str = "plain", plan: Plan | None = None) -> DataFrame:
    """The bundles of every case, each of about ``target`` bytes before compression, with lengths and checksums.

    Bodies are moved twice: to their place in the plan, and to their bundle, which is one task's work.
    """
    plan = plan or Plan(files, target)
    body = plan.rows.select("file_id", F.col("processor").cast("string").alias("processor"), "field_name", "write_time", "body")
    placed = body.join(plan.places(), "file_id").join(plan.drops, "file_id", "left")
    return placed.groupBy("case_id", "bundle").applyInPandas(joiner(codec), BUNDLE)


def redundant_files(files: DataFrame, target: int = TARGET) -> DataFrame:
    """file_id of the files that add no record: those that are no member of any bundle.

    The bundles are made, and each is verified from its own bytes before its members count.
    """
    plan = Plan(files, target)
    members = verified(bundles(files, target, plan=plan)).select("file_id")
    out = plan.files.join(members, "file_id", "left_anti")
    return out.select(F.when(F.col("known"), F.col("file_id")).alias("file_id"))


def frame_end(data: bytes, at: int = 0) -> int:
    """Where the zstandard frame (or skippable frame) that begins at ``at`` ends, from its block headers alone."""
    magic = struct.unpack_from("<I", data, at)[0]
    if magic & 0xFFFFFFF0 == SKIP:
        end = at + 8 + struct.unpack_from("<I", data, at + 4)[0]
    elif magic == FRAME:
        flags = data[at + 4]
        single = flags >> 5 & 1
        head = 5 + (0 if single else 1) + (0, 1, 2, 4)[flags & 3] + ((1 if single else 0), 2, 4, 8)[flags >> 6]
        end, last = at + head, False
        while not last:
            if end + 3 > len(data):
                raise ValueError("the frame is cut off")
            block = int.from_bytes(data[end : end + 3], "little")
            last, kind, size = bool(block & 1), block >> 1 & 3, block >> 3
            end += 3 + (1 if kind == 1 else size)
        end += 4 if flags >> 2 & 1 else 0
    else:
        raise ValueError("no zstandard frame begins here")
    if end > len(data):
        raise ValueError("the frame is cut off")
    return end


def join_frames(files: DataFrame, target: int = TARGET) -> DataFrame:
    """Compressed files (case_id, file_id, frames binary) as bundles of about ``target`` bytes: their frames as they are.

    A file holds one or more complete frames, which is tested on their block headers; what they hold is not looked
    at, so equal records in them stay. Each file follows a skippable frame with its id, length and checksum.
    """
    rows = files.select("file_id", "case_id", "frames").where("frames is not null").dropDuplicates(["file_id"])
    share = F.floor(F.sum(F.octet_length("frames") + HEADER).over(W.partitionBy("case_id", "stretch").orderBy("file_id")) / target)
    placed = rows.withColumn("stretch", F.floor(F.col("file_id") / STRETCH)).withColumn("bundle", share.cast("int"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for r in pdf.sort_values("file_id").itertuples(index=False):
            at, data = 0, bytes(r.frames)
            while at < len(data):
                at = frame_end(data, at)
            out += [skippable(f"file_id={r.file_id} bytes={len(data)} crc32={zlib.crc32(data)}".encode()), data]
        body = b"".join(out)
        case = pdf["case_id"].iloc[0]
        return pd.DataFrame([{"case_id": None if pd.isna(case) else int(case), "stretch": int(pdf["stretch"].iloc[0]), "bundle": int(pdf["bundle"].iloc[0]), "n_files": len(pdf), "n_bytes": len(body), "sha256": hashlib.sha256(body).hexdigest(), "body": body}])

    return placed.groupBy("case_id", "stretch", "bundle").applyInPandas(run, "case_id bigint, stretch bigint, bundle int, n_files int, n_bytes bigint, sha256 string, body binary")


def write_bundles(made: DataFrame, folder: str) -> DataFrame:
    """Write each bundle as ``case=<id>/bundle-<n>.dat`` below a shared ``folder``; returns the manifest read back."""
    base = folder_for(folder)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                p = base / f"case={r.case_id}" / f"bundle-{r.bundle:05d}.dat"
                p.parent.mkdir(parents=True, exist_ok=True)
                tmp = p.with_suffix(f".{r.sha256[:8]}.tmp")  # a task that runs twice writes the same bytes and renames
                tmp.write_bytes(r.body)
                tmp.replace(p)
                back = p.read_bytes()
                out.append((r.case_id, r.bundle, str(p), len(back), zlib.crc32(back) == r.crc32 and len(back) == r.n_bytes))
            yield pd.DataFrame(out, columns=["case_id", "bundle", "path", "n_bytes", "intact"])

    return made.mapInPandas(run, "case_id bigint, bundle int, path string, n_bytes bigint, intact boolean")


def members_of(body: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header and data of each member of a bundle, plain or compressed."""
    packed, at = body[:4] == struct.pack("<I", SKIP), 0
    while at < len(body):
        if packed:
            end = frame_end(body, at)
            head, stop = body[at + 8 : end], frame_end(body, end)
            data = zstandard.ZstdDecompressor().decompress(body[end:stop])
        else:
            end = body.index(b"\n", at) + 1
            head = body[at:end]
            stop = end + int(re.search(rb" bytes=(\d+)", head)[1])
            data = body[end:stop]
        yield dict(x.split("=", 1) for x in head.decode().split() if "=" in x), data
        at = stop


def _sound(r) -> tuple[bool, list[tuple[dict[str, str], bytes]]]:
    body = bytes(r.body)
    if len(body) != r.n_bytes or zlib.crc32(body) != r.crc32 or hashlib.sha256(body).hexdigest() != r.sha256:
        return False, []
    parts = list(members_of(body))
    count = lambda data: sum(1 for x in data.split(b"\n") if (y := x.removesuffix(b"\r").strip(b" ")) and not y.startswith(b"#"))
    good = all(len(d) == int(h["bytes"]) and zlib.crc32(d) == int(h["crc32"]) and count(d) == int(h["records"]) for h, d in parts)
    return good and len(parts) == len(r.members) == r.n_files and sum(int(h["records"]) for h, _ in parts) == r.n_records, parts


def verify(made: DataFrame) -> DataFrame:
    """Per bundle: whether its length and checksums hold, and those of each of its members."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(r.case_id, r.bundle, _sound(r)[0]) for r in b.itertuples(index=False)], columns=["case_id", "bundle", "intact"])

    return made.mapInPandas(run, "case_id bigint, bundle int, intact boolean")


def verified(made: DataFrame) -> DataFrame:
    """file_id of every member of every bundle; a bundle that does not agree with its checksums is an error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples(index=False):
                if not _sound(r)[0]:
                    raise ValueError(f"bundle {r.bundle} of case {r.case_id} is damaged")
                yield pd.DataFrame({"file_id": list(r.members)})

    return made.mapInPandas(run, "file_id bigint")


def restored(made: DataFrame) -> DataFrame:
    """case_id, processor, field_name, write_time and the record lines of every member, read back from the bundles."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples(index=False):
                out = [(r.case_id, h["processor"], h["field"], h["time"], d.decode()) for h, d in members_of(bytes(r.body))]
                yield pd.DataFrame(out, columns=["case_id", "processor", "field_name", "write_time", "body"])

    rows = made.mapInPandas(run, "case_id bigint, processor string, field_name string, write_time string, body string")
    return rows.select("case_id", "processor", "field_name", "write_time", F.explode(records(F.col("body"))).alias("line"))
