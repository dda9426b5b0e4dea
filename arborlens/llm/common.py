"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_U64 = np.uint64
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Rows that Python workers get at once while a table is written.
BATCH_ROWS = 2000


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it, as they do where it is installed."""
    root = str(Path(__file__).resolve().parents[2])
    paths = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in paths.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, (root, paths)))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as the session names it; only a local session, whose executors are this
    process, gets a folder of its own where none is named."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="arborlens-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    # What was shuffled for the table is of no use once it is written; and Python gets a few texts at a time.
    kept = {c: spark.conf.get(c) for c in (_CLEANUP, _BATCH)}
    rows = int(kept[_BATCH])
    spark.conf.set(_CLEANUP, "true")
    spark.conf.set(_BATCH, str(min(rows, BATCH_ROWS) if rows > 0 else BATCH_ROWS))
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        for c, v in kept.items():
            spark.conf.set(c, v)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def forget(df: DataFrame | None) -> None:
    """Delete the table behind a DataFrame that ``cut`` returned and that no plan reads any more."""
    path = getattr(df, "_cut_path", None)
    if path is None:
        return
    spark = df.sparkSession
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def null_safe_text(col):
    return F.coalesce(col.cast("string"), F.lit(""))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective mixer of 64-bit words (two multiply-xorshift rounds)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U64(30))) * _U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U64(27))) * _U64(0x94D049BB133111EB)
        return x ^ (x >> _U64(31))


#: Two's-complement multipliers for the positions of a word's bytes; longer words wrap with another key.
_POWERS = mix64(np.arange(1, 257, dtype=np.uint64) * _U64(0x9E3779B97F4A7C15)) | _U64(1)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SEGMENT = 1 << 20


def _hash_words(raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, text) of the words of some texts that lie in ``raw`` one after another."""
    raw = _LOWER[raw]
    word = ~_SPACE[raw]
    before, after = np.zeros(len(raw), dtype=bool), np.zeros(len(raw), dtype=bool)
    before[1:], after[:-1] = word[:-1], word[1:]
    inner = ends[1:-1]
    before[inner[inner < len(raw)]] = False
    after[inner[inner > 0] - 1] = False
    starts, last = np.flatnonzero(word & ~before), np.flatnonzero(word & ~after)
    if not len(starts):
        return np.empty(0, dtype=np.uint64), starts
    sizes = last + 1 - starts
    inside = np.flatnonzero(word)
    first = np.cumsum(sizes) - sizes
    place = inside - np.repeat(starts, sizes)
    with np.errstate(over="ignore"):
        terms = (raw[inside].astype(np.uint64) + _U64(1)) * _POWERS[place & 255]
        if sizes.max() > 256:
            terms = mix64(terms + (place >> 8).astype(np.uint64) * _U64(0xD6E8FEB86659FD93))
        hashes = mix64(np.add.reduceat(terms, first) + sizes.astype(np.uint64))
    return hashes, np.searchsorted(ends, starts, "right") - 1


def _words_of_long(raw: np.ndarray) -> np.ndarray:
    """Hashes of the words of one text, read in segments that end at white space, so memory does not grow with it (but for a
    single long word)."""
    parts, at = [], 0
    while at < len(raw):
        end = min(len(raw), at + _SEGMENT)
        while end < len(raw):
            white = np.flatnonzero(_SPACE[raw[at:end]])
            if len(white):
                end = at + int(white[-1]) + 1
                break
            end = min(len(raw), end + _SEGMENT)
        parts.append(_hash_words(raw[at:end], np.array([0, end - at]))[0])
        at = end
    return np.concatenate(parts)


def batch_words(raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hashes, text) of the words, in order, of the UTF-8 texts ``raw[ends[i]:ends[i + 1]]``.

    Words are runs of bytes other than \\x20 and \\x09-\\x0D, with A-Z lower-cased.
    """
    hashes, owners, at, n = [np.empty(0, dtype=np.uint64)], [np.empty(0, dtype=np.int64)], 0, len(ends) - 1
    while at < n:
        end = max(at + 1, int(np.searchsorted(ends, ends[at] + _SEGMENT, "right")) - 1)
        some = raw[ends[at] : ends[end]]
        if len(some) > _SEGMENT:  # one long text
            h = _words_of_long(some)
            o = np.zeros(len(h), dtype=np.int64)
        else:
            h, o = _hash_words(some, ends[at : end + 1] - ends[at])
        hashes.append(h)
        owners.append(o + at)
        at = end
    return np.concatenate(hashes), np.concatenate(owners)


def _runs(words: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the runs of ``width`` words that begin at ``starts``."""
    with np.errstate(over="ignore"):
        total = np.full(len(starts), _U64(width), dtype=np.uint64)
        for k in range(width):
            total = mix64(total * _U64(0x9FB21C651E98DF25) + words[starts + k])
    return total


def batch_shingles(raw: np.ndarray, ends: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, text) of the distinct runs of ``width`` words of each text, sorted by text and hash; a shorter sequence is
    one shingle, none stays none."""
    words, owner = batch_words(raw, ends)
    n = len(ends) - 1
    counts = np.bincount(owner, minlength=n)
    first = np.cumsum(counts) - counts
    hashes, texts = [], []
    for size in range(1, width + 1):
        if size < width:
            of = np.flatnonzero(counts == size)
            starts = first[of]
        else:
            starts = np.flatnonzero(np.arange(len(words)) + width <= (first + counts)[owner])
            of = owner[starts]
        hashes.append(_runs(words, starts, size))
        texts.append(of)
    hashes, texts = np.concatenate(hashes), np.concatenate(texts)
    order = np.argsort(hashes)
    order = order[np.argsort(texts[order].astype(np.uint16 if n < 1 << 16 else np.int64), kind="stable")]
    hashes, texts = hashes[order], texts[order]
    new = np.ones(len(hashes), dtype=bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (texts[1:] != texts[:-1])
    return hashes[new], texts[new]
