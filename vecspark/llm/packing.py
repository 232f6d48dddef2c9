"""Best-fit packing of token pieces into sequences by exact-complement hashing.

A document is its byte-level BPE ids and then the end id; only longer ones are cut, into full pieces behind a shorter
first one. The plan is made from the histogram of piece lengths, at most as many rows as a sequence is long: the longest
length left opens sequences, and indexes of single lengths, pair sums and triple sums say which lengths fill the gap
exactly. A combination is consumed as often as its counts allow. Openers without an exact combination take the longest
length that fits, and the rest of their gap is looked up again. Pieces find their place by their rank among those of
equal length, ranked within salts, so a length that a third of all pieces have is no single task.

Defined cases: a null or empty text is the end id alone; documents in repeated rows are each packed, equal ones in any
order; an empty table gives no rows; null doc_ids stay null; other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vecspark.llm.common import bytes_of, read, table

LENGTH = 1024
END = 2
VOCABULARY = "byte_bpe_50k"
#: Pieces that a salt of a length holds on average, at most.
PER_SALT = 1_000_000
_READY: dict = {}


def encoder(vocabulary: str):
    """text -> ids of the named vocabulary. Its ranks file gives the ids of its `tokenizers` file, at four times the speed."""
    if vocabulary not in _READY:
        import base64

        import public_tokenizers as public
        import tiktoken

        with open(public.path(f"{vocabulary}.tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        _READY[vocabulary] = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    return _READY[vocabulary]


def pieces(documents: DataFrame, length: int = LENGTH, end: int = END, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, piece, start, length, ids): ids are little-endian unsigned 32-bit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary)
        names = ["doc_id", "piece", "start", "length", "ids"]
        types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
        for batch in batches:
            out: list[list] = [[] for _ in names]
            size = 0
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.array([*encode(text.as_py() or ""), end], "<u4")
                first = (len(ids) - 1) % length + 1
                for k, stop in enumerate(range(first, len(ids) + 1, length)):
                    start = max(0, stop - length) if k else 0
                    for column, x in zip(out, (doc, k, start, stop - start, ids[start:stop].tobytes()), strict=True):
                        column.append(x)
                size += len(ids)
                if size > 1 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types, strict=True)], names)
                    out, size = [[] for _ in names], 0
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types, strict=True)], names)

    return documents.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, "doc_id bigint, piece int, start bigint, length bigint, ids binary")


class Shelf:
    """Counts of the lengths left, and the exact combinations of one, two or three of them for a gap."""

    def __init__(self, counts: np.ndarray):
        self.left = counts.astype(np.int64).copy()
        self.taken = np.zeros_like(self.left)

    def single(self, gap: int) -> tuple[int, ...]:
        return (gap,) if self.left[gap] else ()

    def pair(self, gap: int, most: int) -> tuple[int, ...]:
        """The pair with sum gap whose longer length, most at most, is the longest."""
        x = np.arange(min(gap - 1, most), (gap - 1) // 2, -1)
        y = gap - x
        found = np.flatnonzero((self.left[x] > 0) & (self.left[y] > (x == y)))
        return (int(x[found[0]]), int(y[found[0]])) if len(found) else ()

    def triple(self, gap: int) -> tuple[int, ...]:
        for x in range(gap - 2, (gap - 1) // 3, -1):
            if self.left[x]:
                self.left[x] -= 1
                rest = self.pair(gap - x, x)
                self.left[x] += 1
                if rest:
                    return (x, *rest)
        return ()

    def exact(self, gap: int) -> tuple[int, ...]:
        return self.single(gap) or self.pair(gap, gap) or self.triple(gap)

    def times(self, lengths: tuple[int, ...]) -> int:
        return min(int(self.left[x]) // lengths.count(x) for x in lengths)

    def take(self, length: int, n: int) -> int:
        """Uses n of a length and gives the rank of the first of them."""
        at = int(self.taken[length])
        self.taken[length] += n
        self.left[length] -= n
        return at


def plan(counts: np.ndarray, length: int) -> np.ndarray:
    """counts[l]: pieces of length l -> rows (l, first rank, number, first sequence, offset).

    Each step uses a length up or closes its sequences, so there are a few thousand rows however many pieces there are.
    """
    shelf, rows, sequences = Shelf(counts), [], 0
    for opener in range(length, 0, -1):
        while n := int(shelf.left[opener]):
            own, gap = [opener], length - opener
            shelf.left[opener] -= 1  # the opener in hand is not there to fill its own gap
            while gap:
                fill = shelf.exact(gap)
                if not fill:
                    fits = np.flatnonzero(shelf.left[1 : gap + 1])
                    fill = (int(fits[-1]) + 1,) if len(fits) else ()
                if not fill:
                    break
                for x in fill:
                    own.append(x)
                    shelf.left[x] -= 1
                gap -= sum(fill)
            for x in own:
                shelf.left[x] += 1
            n = shelf.times(tuple(own))
            offset = 0
            for x in own:
                rows.append((x, shelf.take(x, n), n, sequences, offset))
                offset += x
            sequences += n
    return np.array(rows, np.int64).reshape(-1, 5)


def pack(found: DataFrame, length: int = LENGTH, per_salt: int = PER_SALT) -> DataFrame:
    """found (doc_id, piece, start, length, ...), a table -> the same with sequence_id and offset."""
    size = found.groupBy("length").count().collect()  # a row for each length
    counts = np.zeros(length + 1, np.int64)
    for r in size:
        counts[r["length"]] = r["count"]
    steps = plan(counts, length)
    steps = steps[np.lexsort((steps[:, 1], steps[:, 0]))]
    keys = (steps[:, 0] << 44) + steps[:, 1]
    salts = max(64, int(counts.max()) // per_salt)
    salted = found.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece", "start"), F.lit(salts)))
    group = salted.groupBy("length", "_salt").count()
    before = group.select(F.col("length").alias("_length"), F.col("_salt").alias("_own"), (F.sum("count").over(Window.partitionBy("length").orderBy("_salt")) - F.col("count")).alias("_before"))
    order = [F.col(c) for c in found.columns if c not in ("length", "_salt")]
    ranked = salted.withColumn("_rank", F.row_number().over(Window.partitionBy("length", "_salt").orderBy(*order)) - 1)
    placed = ranked.join(before, (ranked["length"] == before["_length"]) & (ranked["_salt"] == before["_own"])).select(*found.columns, (F.col("_rank") + F.col("_before")).cast("bigint").alias("_rank"))
    names, at = [*found.columns, "sequence_id", "offset"], found.columns.index("length")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, rank = batch.column(at).to_numpy(), batch.column(batch.num_columns - 1).to_numpy()
            row = np.searchsorted(keys, (size << 44) + rank, "right") - 1
            sequence = steps[row, 3] + rank - steps[row, 1]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sequence), pa.array(steps[row, 4])], names)

    schema = T.StructType([*found.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return placed.mapInArrow(run, schema)


def packed(documents: DataFrame, length: int = LENGTH, end: int = END, vocabulary: str = VOCABULARY) -> DataFrame:
    """Each piece's place; its ids stand as a CRC-32, and sequences() has the ids themselves."""
    spark = documents.sparkSession
    slim = pieces(documents, length, end, vocabulary).select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return pack(table(spark, slim, "pieces"), length)


def sequences(documents: DataFrame, length: int = LENGTH, end: int = END, vocabulary: str = VOCABULARY) -> DataFrame:
    """(sequence_id, length, ids): the packed sequences, ids as little-endian unsigned 32-bit."""
    spark = documents.sparkSession
    all_pieces = table(spark, pieces(documents, length, end, vocabulary), "pieces")
    slim = table(spark, all_pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("_crc")), "slim")
    own = pack(slim, length).select("doc_id", "piece", "start", F.col("_crc"), "sequence_id", "offset")
    same = Window.partitionBy("doc_id", "piece", "start", "_crc")
    left = all_pieces.withColumn("_crc", F.crc32("ids")).withColumn("_k", F.row_number().over(same.orderBy("length")))
    right = own.withColumn("_k", F.row_number().over(same.orderBy("sequence_id")))
    keys = ["doc_id", "piece", "start", "_crc", "_k"]
    on = [left[k].eqNullSafe(right[k]) for k in keys]
    joined = left.join(right, on).select("sequence_id", "offset", left["length"].alias("length"), left["ids"].alias("ids"))
    ordered = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return joined.groupBy("sequence_id").agg(F.sum("length").alias("length"), ordered.alias("p")).select("sequence_id", "length", F.aggregate("p", F.lit(b"").cast("binary"), lambda s, x: F.concat(s, x["ids"])).alias("ids"))


def op6_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, packed into sequences of at most 1024 tokens."""
    return packed(read(spark, sf_dir, "documents"))
