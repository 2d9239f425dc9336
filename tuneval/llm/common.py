"""Helpers shared by the operators of this subpackage.

Words are maximal runs of ``[^\\x20\\x09-\\x0D]``, which is exactly what
``bytes.split()`` yields on the UTF-8 text. Python runs in Arrow batches
(``mapInArrow``): Spark partitions and shuffles, a task sees one batch of
rows at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..session import checkpoint_dir, configure as configure_session, scratch_path

WORD = r"[^\x20\x09-\x0D]+"

# Documents can be very long: few of them per Arrow batch bound a worker's memory.
BATCH_ROWS = 256


def configure(spark: SparkSession) -> SparkSession:
    configure_session(spark)
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") != str(BATCH_ROWS):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def checkpoint(df: DataFrame) -> DataFrame:
    """Lineage cut in the shared checkpoint folder."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame, name: str) -> DataFrame:
    """Lineage cut as a Parquet table in the shared folder; unlike a
    checkpoint the reader knows its size, so joins can be planned by it."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a written intermediate that nothing reads any more."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def unit(seed: int, *cols) -> Column:
    """A hash of the columns as a uniform double in [0, 1): the same in every
    run and partitioning."""
    h = F.xxhash64(F.lit(seed).cast("long"), *cols)
    return F.shiftrightunsigned(h, 11).cast("double") / F.lit(float(1 << 53))


def bytes_of(column) -> list:
    """The values of a string column as UTF-8 bytes (None for null)."""
    return column.cast(pa.binary()).to_pylist()


def folded_words(text: bytes, fold: bytes, piece: int = 1 << 22) -> Iterator[list]:
    """The words of a text after the byte table ``fold``, which turns all that
    separates words into spaces; lists of about ``piece`` bytes, so that a very
    long text is not one list."""
    s, a = text.translate(fold), 0
    while len(s) - a > piece:
        b = s.find(b" ", a + piece)
        if b < 0:
            break
        yield s[a:b].split()
        a = b
    yield s[a:].split()


def record_batch(schema: T.StructType, columns: dict) -> pa.RecordBatch:
    from pyspark.sql.pandas.types import to_arrow_schema
    s = to_arrow_schema(schema)
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c := columns[f.name], pa.Array) and c.type == f.type
         else (c.cast(f.type) if isinstance(c, pa.Array) else pa.array(c, f.type)) for f in s], schema=s)


_KEPT: dict = {}
_ASKED: list = []


def kept(key: str, make: Callable):
    """What a worker keeps from task to task: the thing of one key at a time."""
    _ASKED.append(key)
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = make()
    return _KEPT[key]


def _made(make: Callable):
    """``make()``; what the worker kept for another operator goes if this one
    keeps nothing: workers outlive stages."""
    _ASKED.clear()
    fn = make()
    if not _ASKED:
        _KEPT.clear()
    return fn


def per_text(df: DataFrame, id_col: str, text_col: str, fields: str,
             make: Callable[[], Callable[[list], dict]]) -> DataFrame:
    """Rows (doc_id, *fields) with the fields computed from the texts.

    ``make()`` runs once per task and returns a function from a batch of
    texts (bytes or None) to a dict of columns. Only the id and the text
    reach Python; other input columns, whatever their names, are not read.
    """
    src = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    extra = T._parse_datatype_string(fields)
    schema = T.StructType([T.StructField("doc_id", src.schema["doc_id"].dataType), *extra.fields])

    def run(batches: Iterator[pa.RecordBatch]):
        fn = None
        for b in batches:
            fn = fn or _made(make)
            yield record_batch(schema, {"doc_id": b.column(0), **fn(bytes_of(b.column(1)))})

    return src.mapInArrow(run, schema)


def keep_rows(df: DataFrame, text_col: str,
              make: Callable[[], Callable[[list], list]]) -> DataFrame:
    """The rows whose text passes, all columns as they are.

    The whole row travels through the Arrow batch, so no row identity and no
    join back is needed.
    """
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]):
        fn = None
        for b in batches:
            fn = fn or _made(make)
            yield b.filter(pa.array(fn(bytes_of(b.column(at))), pa.bool_()))

    return df.mapInArrow(run, df.schema)
