"""A directory as a store of files by subpath, on any file system that Spark reads.

A corpus is opened to be read. A store of results holds a marker file; a directory without it is never written to. Whole
corpora are read as DataFrames; the methods for one file serve small ones, such as schemas and reports.
"""

from __future__ import annotations

import gzip
import json
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborlens.functions.text_codes import text_bytes
from arborlens.sources.sinks import ByteSink, TextSink

MARKER = "WRITABLE"
_ALLOWED = r"[-_a-zA-Z0-9./]*"


def valid_subpath(path: str) -> bool:
    """Letters, digits and ``-_./`` in segments that aren't empty, ``.``, ``..`` or the marker."""
    return re.fullmatch(_ALLOWED, path) is not None and not {"", ".", "..", MARKER} & set(path.split("/"))


def valid_subpath_column(path):
    segments = F.split(path, "/")
    return path.rlike(f"^{_ALLOWED}$") & ~F.arrays_overlap(segments, F.array(*map(F.lit, ("", ".", "..", MARKER))))


def result_path(path, ending: str):
    """The subpath of a script's result: its last ``.js`` becomes ``ending``."""
    return F.regexp_replace(path, r"\.js$", ending)


class Store:
    def __init__(self, spark: SparkSession, root: str, writable: bool):
        self.spark, self.root, self.writable = spark, root.rstrip("/"), writable
        self._fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, sub: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{sub}" if sub else self.root)

    @classmethod
    def open(cls, spark: SparkSession, root: str) -> Store:
        """A corpus, to be read."""
        store = cls(spark, root, False)
        if not store._is_dir(""):
            raise NotADirectoryError(root)
        return store

    @classmethod
    def create(cls, spark: SparkSession, root: str) -> Store:
        """A store of results: one with the marker, or a new one."""
        store = cls(spark, root, True)
        if not store._fs.exists(store._path("")):
            store._fs.mkdirs(store._path(""))
            store._fs.create(store._path(MARKER), False).close()
        elif not store._is_dir("") or not store._fs.exists(store._path(MARKER)):
            raise PermissionError(f"{root} exists and has no {MARKER} file")
        return store

    # Listing

    def _is_dir(self, sub: str) -> bool:
        path = self._path(sub)
        return self._fs.exists(path) and self._fs.getFileStatus(path).isDirectory()

    def _children(self, sub: str):
        return sorted((s.getPath().getName(), s.isDirectory(), s.getLen()) for s in self._fs.listStatus(self._path(sub)))

    def list_all(self, sub: str = "") -> list[str]:
        return [n for n, _, _ in self._children(sub) if not (sub == "" and n == MARKER)]

    def list_files(self, sub: str = "") -> list[str]:
        return [n for n, d, _ in self._children(sub) if not d and not (sub == "" and n == MARKER)]

    def list_dirs(self, sub: str = "") -> list[str]:
        return [n for n, d, _ in self._children(sub) if d]

    def subpaths(self) -> list[str]:
        """Every file below the root, sorted."""
        found, todo = [], [""]
        while todo:
            sub = todo.pop()
            for name, is_dir, _ in self._children(sub):
                path = f"{sub}/{name}" if sub else name
                todo.append(path) if is_dir else found.append(path)
        return sorted(p for p in found if p != MARKER)

    def files(self, suffix: str = ".js", least_size: int = 0, content: bool = True) -> DataFrame:
        """(subpath, size, content) of the files whose name ends in ``suffix``; names and sizes are known before contents are read."""
        base = str(self._fs.makeQualified(self._path("")).toUri().getPath()).rstrip("/") + "/"
        df = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*{suffix}").load(self.root)
        df = df.where(F.col("length") >= least_size)
        sub = F.regexp_replace("path", f"^.*?{re.escape(base)}", "")
        df = df.withColumn("subpath", sub).where(F.col("subpath") != MARKER)
        return df.select("subpath", F.col("length").alias("size"), *(["content"] if content else []))

    def texts(self, suffix: str = ".js", least_size: int = 0) -> DataFrame:
        """(subpath, size, text) of whole files."""
        return self.files(suffix, least_size).select("subpath", "size", F.decode("content", "UTF-8").alias("text"))

    def lines(self, suffix: str = "") -> DataFrame:
        """(subpath, line_number, line)."""
        return self.texts(suffix).select("subpath", F.posexplode(F.split("text", "\n")).alias("line_number", "line"))

    # One file

    def _known(self, sub: str) -> str:
        if not valid_subpath(sub):
            raise ValueError(f"{sub!r} is no subpath")
        return sub

    def size(self, sub: str) -> int:
        return self._fs.getFileStatus(self._path(self._known(sub))).getLen()

    def read_bytes(self, sub: str) -> bytes:
        self.size(sub)
        row = self.spark.read.format("binaryFile").load(f"{self.root}/{sub}").select("content").first()
        return bytes(row["content"])

    def read_text(self, sub: str) -> str:
        return self.read_bytes(sub).decode("utf-8", "surrogatepass")

    def read_lines(self, sub: str) -> list[str]:
        return self.read_text(sub).split("\n")

    def read_json(self, sub: str):
        return json.loads(self.read_text(sub))

    def read_compressed(self, sub: str, how: str) -> bytes:
        return compress(self.read_bytes(sub), how)

    def _target(self, sub: str):
        if not self.writable:
            raise PermissionError(f"{self.root} was opened to be read")
        path = self._path(self._known(sub))
        above = path.getParent()
        while above.depth() >= self._path("").depth():
            if self._fs.exists(above) and not self._fs.getFileStatus(above).isDirectory():
                raise NotADirectoryError(str(above))
            above = above.getParent()
        if self._fs.exists(path) and self._fs.getFileStatus(path).isDirectory():
            raise IsADirectoryError(sub)
        return path

    def write_sink_bytes(self, sub: str, work: Callable[[ByteSink], object]) -> None:
        """Open a file, let ``work`` write to its sink, and close it; folders above it are made."""
        out = self._fs.create(self._target(sub), True)
        try:
            sink = ByteSink(lambda data: out.write(bytearray(data)))
            work(sink)
            sink.flush()
        finally:
            out.close()

    def write_sink_text(self, sub: str, work: Callable[[TextSink], object]) -> None:
        self.write_sink_bytes(sub, lambda sink: work(TextSink(sink)))

    def write_bytes(self, sub: str, data: bytes) -> None:
        self.write_sink_bytes(sub, lambda sink: sink.write(data))

    def write_text(self, sub: str, text: str) -> None:
        self.write_bytes(sub, text_bytes(text))

    def write_json(self, sub: str, value) -> None:
        self.write_text(sub, json.dumps(value, indent=2, ensure_ascii=False))

    # Many files

    def write_table(self, sub: str, df: DataFrame) -> None:
        """A DataFrame as Parquet: results that grow with the corpus."""
        self._target(sub)
        df.write.mode("overwrite").parquet(f"{self.root}/{sub}")

    def write_each(self, df: DataFrame, path: str = "subpath", content: str = "text") -> None:
        """A file per row, written one after another as rows arrive: for corpora of a size that a person reads."""
        for row in df.select(path, content).toLocalIterator():
            self.write_bytes(row[0], bytes(row[1])) if isinstance(row[1], (bytes, bytearray)) else self.write_text(row[0], row[1])


def compress(data: bytes, how: str) -> bytes:
    """``data`` by gzip, or by brotli where a module for it is installed."""
    if how == "gzip":
        return gzip.compress(data, mtime=0)
    if how == "brotli":
        try:
            import brotli
        except ImportError as e:
            raise NotImplementedError("no brotli module is installed") from e
        return brotli.compress(data, quality=11)
    raise ValueError(f"unknown compressor {how!r}")


def has_brotli() -> bool:
    from importlib.util import find_spec

    return find_spec("brotli") is not None


def compressed_sizes(df: DataFrame, id_col: str, content_col: str) -> DataFrame:
    """(id, size, gzip_bytes, and brotli_bytes where a module is installed) of whole contents, in Arrow batches."""
    hows = ["gzip", *(["brotli"] if has_brotli() else [])]
    src = df.select(F.col(id_col), F.col(content_col).cast("binary").alias("content"))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            contents = [c.as_py() or b"" for c in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, contents), pa.int64()), *(pa.array([len(compress(c, h)) for c in contents], pa.int64()) for h in hows)], names=[id_col, "size", *(f"{h}_bytes" for h in hows)])

    return src.mapInArrow(run, f"`{id_col}` {dict(src.dtypes)[id_col]}, size long, " + ", ".join(f"{h}_bytes long" for h in hows))
