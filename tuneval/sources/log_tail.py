"""A streaming source for text logs that grow in place.

Its offset is the number of bytes read of every file. A trigger reads what was
appended since, up to the last line break: a line that is still being written
waits for the next trigger. Large appended ranges are split, so that a log is
many tasks and never one value. Offsets lie in the query's checkpoint, so a
restart reads nothing twice and misses nothing.

Files are listed and read with ``pyarrow.fs`` (a path, or the URI of a store it
knows), since Spark's own file source takes a file as read once and for all.
A file that shrinks was replaced and is an error: its old offset means nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

RANGE_BYTES = 64 << 20
FORMAT = "tuneval_log_tail"


def _data_source():
    """The source's class; made in a function, so that it travels by value."""
    from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

    class Range(InputPartition):
        def __init__(self, file, begin, end):
            self.file, self.begin, self.end = file, begin, end

    def store(path):
        from pyarrow import fs
        return fs.FileSystem.from_uri(path)

    def last_break(fs, file, begin, end):
        """The place behind the last line break in [begin, end), or ``begin``."""
        with fs.open_input_file(file) as f:
            while end > begin:
                a = max(begin, end - (1 << 16))
                f.seek(a)
                k = f.read(end - a).rfind(b"\n")
                if k >= 0:
                    return a + k + 1
                end = a
        return begin

    class Reader(DataSourceStreamReader):
        def __init__(self, path, range_bytes):
            self.path, self.range_bytes, self.now = path, range_bytes, {}

        def initialOffset(self):
            return {}

        def latestOffset(self):
            from pyarrow.fs import FileSelector, FileType
            fs, root = store(self.path)
            out = {}
            for i in fs.get_file_info(FileSelector(root, recursive=True)):
                if i.type == FileType.File and not i.base_name.startswith(("_", ".")):
                    known = self.now.get(i.path, 0)
                    out[i.path] = known if i.size == known else last_break(fs, i.path, known, i.size)
            self.now = out
            return dict(out)

        def partitions(self, start, end):
            out = []
            for file, z in end.items():
                a = start.get(file, 0)
                if z < a:
                    raise ValueError(f"{file}: {z} bytes, of which {a} were read: the log was replaced")
                out += [Range(file, x, min(x + self.range_bytes, z)) for x in range(a, z, self.range_bytes)]
            return out

        def read(self, part):
            """Lines that begin in the range; the last one may end behind it."""
            fs, _ = store(self.path)
            from io import BufferedReader
            with BufferedReader(fs.open_input_file(part.file), 1 << 20) as f:
                at = part.begin
                f.seek(max(at - 1, 0))
                if at and f.read(1) != b"\n":
                    at += len(f.readline())
                while at < part.end:
                    line = f.readline()
                    if not line:
                        return
                    yield part.file, at, line.rstrip(b"\r\n").decode("utf-8", "replace")
                    at += len(line)

        def commit(self, end):
            pass

    class LogTail(DataSource):
        @classmethod
        def name(cls):
            return FORMAT

        def schema(self):
            return "log string, line long, value string"

        def streamReader(self, schema):
            return Reader(self.options["path"], int(self.options.get("rangebytes", RANGE_BYTES)))

    return LogTail


def appended_lines(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """A stream of (log, line, value): ``line`` is the byte a line begins at."""
    spark.dataSource.register(_data_source())
    return spark.readStream.format(FORMAT).option("rangeBytes", range_bytes).load(path)
