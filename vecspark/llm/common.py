"""Shared pieces of the corpus operators: the shared folder, tables that cut lineage, word hashing on raw bytes."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_LANE_PRIME = np.uint64(0x9E3779B97F4A7C15)
_MIX_PRIME = np.uint64(0xD6E8FEB86659FD93)
_OWN: dict[str, str] = {}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where the session names none (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not named:
        app = spark.sparkContext.applicationId
        if app not in _OWN:
            _OWN[app] = "file://" + tempfile.mkdtemp(prefix="llm-shared-")
            atexit.register(__import__("shutil").rmtree, _OWN[app][7:], True)
        named = _OWN[app]
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of this application's own in the shared one."""
    return f"{shared_dir(spark)}/llm/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def clean(spark: SparkSession) -> None:
    """Deletes all tables and archives that this application has written; to be called when no result is read any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/llm/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back, so what follows survives lost executors without recomputing."""
    path = new_folder(spark, name)
    schema = df.schema
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(schema).parquet(path)


def bucketed(spark: SparkSession, df: DataFrame, key: str, name: str) -> DataFrame:
    """As table(), in a bucket for each shuffle partition: what is grouped by key is not shuffled again."""
    path, entry = new_folder(spark, name), f"llm_{name}_{uuid.uuid4().hex}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.format("parquet").option("path", path).option("compression", "zstd").bucketBy(n, key).saveAsTable(entry)
    out = spark.read.table(entry)  # holds the files' place and buckets, so the catalog's entry can go; the files stay
    spark.sql(f"DROP TABLE {entry}")
    return out


def drop_table(spark: SparkSession, df: DataFrame) -> None:
    """Deletes the files of a table that nothing reads any more."""
    for f in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(f)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def join_hot(many: DataFrame, one: DataFrame, key: str, n: str = "n") -> DataFrame:
    """many joined with one, which has a row a key and in n how many rows of many that key has.

    Keys that hold over a thousandth of all rows, a thousand of them at most, are broadcast, so their rows stay where they
    are; the others are joined as the engine sees fit.
    """
    total = one.agg(F.sum(n)).first()[0] or 0
    hot, cold = one.where(F.col(n) * 1000 > total).drop(n), one.where(F.col(n) * 1000 <= total).drop(n)
    met = many.join(F.broadcast(hot), key)
    rest = many.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key)
    return met.select(rest.columns).union(rest)


def text_of(column: Column | str) -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column, null as empty, and the offsets of its rows (one more than rows)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    buffers = column.buffers()
    off = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def slices(off: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Row ranges of at most so many bytes each; a longer row stands alone."""
    a, n = 0, len(off) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + most, "right")) - 1)
        yield a, min(b, n)
        a = b


def word_spans(data: np.ndarray, off: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes in table, never across rows, and the index of each row's first word."""
    inside = table[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    heads, tails = off[:-1], off[1:] - 1
    real = off[1:] > off[:-1]
    first[heads[real]] = inside[heads[real]]
    last[tails[real]] = inside[tails[real]]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, off)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans, eight bytes a step for all spans at once."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    lanes = np.ndarray(max(len(padded) - 7, 0), "<u8", padded, strides=(1,))
    size = ends - starts
    h = size.astype(np.uint64) * _LANE_PRIME
    todo, at = np.arange(len(starts)), starts
    left = size
    with np.errstate(over="ignore"):
        while len(todo):
            lane = lanes[at]
            short = left < 8
            lane[short] &= (np.uint64(1) << (left[short] * 8).astype(np.uint64)) - np.uint64(1)
            x = (h[todo] ^ lane) * _MIX_PRIME
            h[todo] = x ^ (x >> np.uint64(32))
            more = left > 8
            todo, at, left = todo[more], at[more] + 8, left[more] - 8
        h *= _LANE_PRIME
        h ^= h >> np.uint64(29)
    return h


def byte_class(outside: str) -> np.ndarray:
    """256 booleans: bytes that are not one of the given ASCII characters."""
    keep = np.ones(256, bool)
    keep[np.frombuffer(outside.encode("ascii"), np.uint8)] = False
    return keep


#: A-Z to a-z on bytes; all other bytes stay.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: [^\x00-\x2F\x3A-\x60\x7B-\x7F]
ALNUM = byte_class("".join(map(chr, [*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])))
#: [^\x20\x09-\x0D]
NONSPACE = byte_class(" \t\n\x0b\x0c\r")
