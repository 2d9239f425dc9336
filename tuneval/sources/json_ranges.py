"""JSON arrays and containers of arrays, read in byte ranges.

A file that is one JSON array (or one object of arrays) has no line structure,
yet Spark can read it in parallel: its text reader splits a file into byte
ranges and cuts each at ``}``, and ``file_block_start`` with the rows' order in
a task says where a piece stands. What a range does not know is the state it
begins in, within a string or not, and how deeply nested. So it is read twice:

1. every range tells, for both states it may begin in, how many quotes, levels
   and cuts it holds (one row per range). The driver chains these rows, which
   gives each range its true state, its byte offset and the number of its first
   element. A file that ends within a string or at another depth than 0, that
   closes more than it opens, or that is empty is an error with file and byte;
2. every range cuts its text at the commas of the wanted depth. Elements within
   a range are whole; what lies across ranges (at most two parts a range) meets
   by element number.

No backslash is pending where a range begins, since it begins behind a ``}``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import jsonfn as J

CUT = b"}"

# Up to so many arrays (a row each) their keys are broadcast.
BROADCAST_ARRAYS = 100_000

# The signed change of depth by byte value.
_STEP = np.zeros(256, dtype=np.int8)
_STEP[[0x5B, 0x7B]] = 1
_STEP[[0x5D, 0x7D]] = -1


def read_pieces(spark: SparkSession, path: str) -> DataFrame:
    """(source_file, at, size, piece): the file's text between two ``}``."""
    return (spark.read.option("lineSep", CUT.decode()).option("recursiveFileLookup", "true").text(path)
            .select(F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.file_block_start").alias("at"),
                    F.col("_metadata.file_size").alias("size"), F.col("value").cast("binary").alias("piece")))


def runs(batches) -> Iterator[tuple]:
    """(file, range start, size, text, last) of the stretches of one range; ``last``
    closes the range."""
    now = None
    for b in batches:
        files, starts, sizes = (b.column(k).to_pylist() for k in range(3))
        pieces, a = b.column(3).to_pylist(), 0
        while a < len(pieces):
            z, key = a, (files[a], starts[a], sizes[a])
            while z < len(pieces) and (files[z], starts[z]) == key[:2]:
                z += 1
            if now is not None and now != key:
                yield *now, b"", True
            now = key
            yield *key, CUT.join(pieces[a:z]) + CUT, False
            a = z
    if now is not None:
        yield *now, b"", True


def structure(text: bytes, inside: bool) -> tuple:
    """(places, their bytes, steps of depth) of the brackets and commas outside
    strings, and whether the text ends inside a string."""
    x = np.frombuffer(text, dtype=np.uint8)
    quotes = np.flatnonzero(x == 0x22)
    slashes = np.flatnonzero(x == 0x5C)
    if len(slashes):
        # a quote behind an odd run of backslashes does not count
        first = np.r_[True, np.diff(slashes) > 1]
        run_start = slashes[np.maximum.accumulate(np.where(first, np.arange(len(slashes)), 0))]
        before = np.searchsorted(slashes, quotes) - 1
        follows = (before >= 0) & (slashes[before] == quotes - 1)
        odd = (quotes - run_start[before]) % 2 == 1
        quotes = quotes[~(follows & odd)]
    marks = np.flatnonzero((_STEP[x] != 0) | (x == 0x2C))
    marks = marks[(np.searchsorted(quotes, marks) + inside) % 2 == 0]
    return marks, x[marks], _STEP[x[marks]], bool((len(quotes) + inside) % 2)


WAY = "struct<step:long,least:long,least_at:long,cuts:map<long,long>,opens:map<long,long>,last:map<long,long>>"


def summaries(pieces: DataFrame) -> DataFrame:
    """A row per range: bytes, whether its quotes are odd, and for both states
    the change of depth, the least depth and its place; by level, relative to
    the depth at the start, the number of cuts, how many of them open an array
    and the number of the last that does."""
    schema = f"source_file string, at long, size long, bytes long, odd boolean, ways array<{WAY}>"
    number = pa.map_(pa.int64(), pa.int64())
    way = pa.struct([("step", pa.int64()), ("least", pa.int64()), ("least_at", pa.int64()), ("cuts", number),
                     ("opens", number), ("last", number)])
    arrow = pa.schema([("source_file", pa.string()), ("at", pa.int64()), ("size", pa.int64()), ("bytes", pa.int64()),
                       ("odd", pa.bool_()), ("ways", pa.list_(way))])

    def add(w, places, kinds, steps, offset):
        after = w["step"] + np.cumsum(steps, dtype=np.int64)
        k = int(after.argmin())
        if after[k] < w["least"]:
            w["least"], w["least_at"] = int(after[k]), offset + int(places[k])
        level = np.where(steps < 0, after + 1, after)
        for v in np.unique(level).tolist():
            at = level == v
            opened = np.flatnonzero(steps[at] > 0)
            if len(opened):
                w["opens"][v] = w["opens"].get(v, 0) + len(opened)
                w["last"][v] = w["cuts"].get(v, 0) + int(opened[-1]) + 1
            w["cuts"][v] = w["cuts"].get(v, 0) + int(at.sum())
        w["step"] = int(after[-1])

    def run(batches):
        state = None
        for file, start, size, text, last in runs(batches):
            state = state or (0, [False, True], [{"step": 0, "least": 0, "least_at": 0, "cuts": {}, "opens": {},
                                                  "last": {}} for _ in (0, 1)])
            n, inside, ways = state
            for w in (0, 1) if text else ():
                *marks, inside[w] = structure(text, inside[w])
                if len(marks[0]):
                    add(ways[w], *marks, n)
            state = n + len(text), inside, ways
            if last:
                yield pa.RecordBatch.from_pylist([{
                    "source_file": file, "at": start, "size": size, "bytes": state[0], "odd": inside[0],
                    "ways": [{k: list(v.items()) if isinstance(v, dict) else v for k, v in w.items()}
                             for w in ways]}], schema=arrow)
                state = None

    return pieces.mapInArrow(run, schema)


class BrokenFile(ValueError):
    """A file that cannot be read; names the file and the byte."""


def no_empty_file(files: list, ranges: list) -> None:
    """An empty file has no row in any reader: it is listed, but has no range."""
    def plain(path):
        return re.sub("^([a-z0-9]+):/+", r"\1:/", path)
    for f in sorted({plain(f) for f in files} - {plain(r.source_file) for r in ranges}):
        raise BrokenFile(f"{f}: empty file, ends at byte 0")


def start_states(ranges: list, level: int) -> tuple:
    """(file, range start) -> (inside a string, depth, cuts, arrays opened,
    first segment of the last one, byte offset), and the number of arrays."""
    files: dict = {}
    for r in ranges:
        files.setdefault((r.source_file, r.size), []).append(r)
    out, arrays = {}, 0
    for (file, size), rows in files.items():
        inside, depth, segment, array, first, offset = False, 0, 0, 0, 0, 0
        for r in sorted(rows, key=lambda r: r.at):
            out[file, r.at] = (inside, depth, segment, array, first, offset)
            way = r.ways[int(inside)]
            if depth + way.least < 0 and offset + way.least_at < size:
                raise BrokenFile(f"{file}: closes more than it opens at byte {offset + way.least_at}")
            here = level - depth
            if way.opens.get(here):
                array, first = array + way.opens[here], segment + way.last[here]
            segment += way.cuts.get(here, 0)
            depth, inside, offset = depth + way.step, inside ^ r.odd, offset + r.bytes
        if offset > size and not inside:       # the file does not end with the cut that the pieces were given
            depth += 1
        if inside or depth:
            raise BrokenFile(f"{file}: ends {'within a string' if inside else f'at depth {depth}'} at byte {size}")
        arrays += array
    return out, arrays


SEGMENTS = ("source_file string, segment long, array long, position long, at long, outer boolean, whole boolean, "
            "closed boolean, offset long, value binary")


def segments(pieces: DataFrame, states, level: int) -> DataFrame:
    """The text between cuts. ``whole`` segments lie within a range, parts of the
    others follow each other by ``at``. ``closed`` ones end at the array's end;
    ``outer`` ones lie outside the level and keep the brackets around them."""
    arrow = pa.schema([("source_file", pa.string()), *((c, pa.int64()) for c in ("segment", "array", "position", "at")),
                       *((c, pa.bool_()) for c in ("outer", "whole", "closed")), ("offset", pa.int64()),
                       ("value", pa.binary())])

    def run(batches):
        known, open_range = states.value, False
        for file, start, size, text, last in runs(batches):
            if not open_range:
                inside, depth, segment, array, first, offset = known[file, start]
                open_range, held, begun, since_start, outer = True, [], offset, True, depth < level
            out: list = []
            text = text[:size - offset]                  # without the cut that the file may not end with
            places, kinds, steps, inside = structure(text, inside)
            after = depth + np.cumsum(steps, dtype=np.int64)
            cut = np.where(kinds == 0x2C, after == level, np.where(steps > 0, after == level, after == level - 1))
            a = 0
            for k in np.flatnonzero(cut).tolist():
                z, opens, closes = int(places[k]), bool(steps[k] > 0), bool(steps[k] < 0)
                held.append(text[a:z + opens])
                out.append((file, segment, array, segment - first, start, outer, not (since_start or outer), closes,
                            begun, b"".join(held)))
                segment, since_start, outer = segment + 1, False, closes
                if opens:
                    array, first = array + 1, segment
                a = z if closes else z + 1
                held, begun = [], offset + a
            held.append(text[a:])
            depth, offset = int(after[-1]) if len(after) else depth, offset + len(text)
            if last:
                out.append((file, segment, array, segment - first, start, outer, False, False, begun, b"".join(held)))
                open_range = False
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), arrow)], schema=arrow)

    return pieces.mapInArrow(run, SEGMENTS)


def read_sequences(spark: SparkSession, path: str, level: int) -> tuple:
    """Rows (source_file, segment, array, position, outer, closed, offset, value),
    and the number of arrays."""
    pieces = read_pieces(spark, path)
    ranges = summaries(pieces).collect()
    no_empty_file(pieces.inputFiles(), ranges)
    states, arrays = start_states(ranges, level)
    parts = segments(pieces, spark.sparkContext.broadcast(states), level)
    of = ("source_file", "segment", "array", "position", "outer")
    joined = parts.where("not whole").groupBy("source_file", "segment").agg(
        F.array_sort(F.collect_list(F.struct("at", "array", "position", "outer", "offset", "value"))).alias("p"),
        F.bool_or("closed").alias("closed"))
    whole = parts.where("whole").select(*of, "closed", "offset", F.col("value").cast("string"))
    return whole.unionByName(joined.select(
        "source_file", "segment", *(F.col("p")[0][c].alias(c) for c in (*of[2:], "offset")), "closed",
        F.array_join(F.transform("p", lambda x: x["value"].cast("string")), "").alias("value"))), arrays


BLANK = r"^[ \t\r\n]*$"


def checked(ok: Column, what: str) -> Column:
    """True, or an error that names file and byte; for filters, which stay in
    every plan."""
    return F.when(F.coalesce(ok, F.lit(False)), F.lit(True)).otherwise(F.raise_error(F.concat(
        "source_file", F.lit(f": {what} at byte "), F.col("offset").cast("string"))).cast("boolean"))


def _elements(rows: DataFrame, arrays: DataFrame, n_arrays: int, schema) -> DataFrame:
    """The parsed elements of the arrays; a blank one is an error unless its
    array is empty."""
    blank = F.col("value").rlike(BLANK)
    good = F.when(blank, (F.col("position") == 0) & F.col("closed")).otherwise(
        F.col("value").rlike(r"^[ \t\r\n]*\{") & J.strict_valid("value"))
    d = rows.where("not outer").where(checked(good, "malformed element")).where(~blank)
    # a row per array: its number was counted
    arrays = F.broadcast(arrays) if n_arrays <= BROADCAST_ARRAYS else arrays
    return d.join(arrays, ["source_file", "array"]).withColumn("r", F.from_json("value", schema))


def _around(rows: DataFrame) -> DataFrame:
    """Per file the text before, between and behind its arrays."""
    return rows.where("outer").groupBy("source_file").agg(
        F.array_sort(F.collect_list(F.struct("segment", "array", "offset", "value"))).alias("o"),
        F.max("offset").alias("offset"))


def read_array(spark: SparkSession, path: str, schema) -> DataFrame:
    """(source_file, position, r): the objects in files that are one array."""
    rows, n = read_sequences(spark, path, 1)
    around = _around(rows).where(checked(
        (F.size("o") == 2) & F.col("o")[0]["value"].rlike(r"^[ \t\r\n]*\[$")
        & F.col("o")[1]["value"].rlike(r"^\][ \t\r\n]*$"), "not one array"))
    d = _elements(rows, around.select("source_file", F.lit(1).cast("long").alias("array")), n, schema)
    return d.select("source_file", "position", "r")


_KEY = r'"(?:[^"\\]|\\.)*"'
_WS = r"[ \t\r\n]*"


def read_container(spark: SparkSession, path: str, schema) -> DataFrame:
    """(source_file, key, position, r): the objects in files that are one object
    whose values are arrays."""
    rows, n = read_sequences(spark, path, 2)
    k = F.transform("o", lambda x, i: F.when(i == F.size("o") - 1, x["value"].rlike(
        rf"^{_WS}\{{{_WS}\}}{_WS}$|^\]{_WS}\}}{_WS}$") & ((i > 0) | ~x["value"].startswith("]"))).otherwise(
        x["value"].rlike(rf"^{_WS}\{{{_WS}{_KEY}{_WS}:{_WS}\[$") & (i == 0)
        | x["value"].rlike(rf"^\]{_WS},{_WS}{_KEY}{_WS}:{_WS}\[$") & (i > 0)))
    around = _around(rows).where(checked(F.forall(k, lambda x: x), "not one object of arrays"))
    o = around.select("source_file", F.explode("o").alias("o")).where(F.col("o.value").endswith("["))
    keys = o.select("source_file", (F.col("o.array") + 1).alias("array"), F.from_json(F.concat(
        F.lit("["), F.regexp_extract("o.value", _KEY, 0), F.lit("]")), "array<string>")[0].alias("key"))
    return _elements(rows, keys, n, schema).select("source_file", "key", "position", "r")
