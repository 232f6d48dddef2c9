"""SimHash near-duplicates: pigeonhole blocks on fingerprints, verified Hamming distance, connected components.

A-Z are lower-cased, words are runs of bytes other than ASCII white space, shingles are three consecutive words joined
by a space, with repeats. A bit is set if it is set in over half of the shingles' XXH64 (seed 42).

Six blocks of bits: of two fingerprints that differ in three bits at most, three blocks are equal, so the pair shares
one of the 20 keys of three blocks (31 to 33 bits). Texts with the same fingerprint are one node from the start.

Defined cases: a null or empty text has fingerprint 0 and is linked like any other; fewer than three words are one
shingle; repeated rows are in one class; texts are linked, not doc_ids, so rows with one doc_id and different texts are in
classes of their own; rows with null doc_id are linked alike, and a class of such rows alone has a null component_id; an
empty table gives no rows; other columns are never looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vecspark.llm.common import bytes_of, join_hot, read, table
from vecspark.llm.components import components

BITS = 3
SEED = 42
WORDS = 3
#: Fingerprints of a key that are compared at once; keys with more are dealt into chunks, and chunks meet in pairs.
CHUNK = 2048
_EDGES = (0, 11, 22, 33, 44, 54, 64)


def masks(blocks: int = 6, equal: int = 3) -> list[int]:
    """Signed 64-bit masks, one for each way to choose the blocks that must be equal."""
    parts = [sum(1 << b for b in range(_EDGES[k], _EDGES[k + 1])) for k in range(blocks)]
    return [m - (1 << 64) if m >> 63 else m for m in (sum(x) for x in combinations(parts, equal))]


def fingerprint(text: bytes, words: int = WORDS) -> int:
    """Signed 64-bit SimHash of a UTF-8 text."""
    import xxhash

    found = text.lower().split()
    if not found:
        return 0
    if len(found) <= words:
        hashes = [xxhash.xxh64_intdigest(b" ".join(found), SEED)]
    else:
        joined = b" ".join(found)
        size = np.fromiter(map(len, found), np.int64, len(found)) + 1
        end = np.cumsum(size)
        starts = (end - size)[: len(found) - words + 1].tolist()
        ends = (end - 1)[words - 1 :].tolist()
        hashed = xxhash.xxh64_intdigest
        hashes = [hashed(joined[a:b], SEED) for a, b in zip(starts, ends, strict=True)]
    counts = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 16):
        part = np.array(hashes[k : k + (1 << 16)], "<u8")
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(documents: DataFrame, *more: str) -> DataFrame:
    """(doc_id, fingerprint, more...): signed 64-bit, from whole texts."""
    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), *more)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = bytes_of(batch.column(1))
            whole, at = memoryview(data), off.tolist()
            got = [fingerprint(bytes(whole[a:b])) for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, pa.int64()), *batch.columns[2:]], ["doc_id", "fingerprint", *more])

    fields = [T.StructField("doc_id", T.LongType()), T.StructField("fingerprint", T.LongType()), *rows.schema.fields[2:]]
    return rows.mapInArrow(run, T.StructType(fields))


def _forest(a: np.ndarray, b: np.ndarray | None, bits: int) -> list[tuple[int, int]]:
    """Index pairs that connect what links of a (or between a and b, numbered after a) connect: no more than nodes."""
    z = a if b is None else np.concatenate([a, b])
    n, split = len(z), len(a)
    if n == 2:
        return [(0, 1)] if np.bitwise_count(z[0] ^ z[1]) <= bits else []
    free, out = np.ones(n, bool), []
    for k in range(n):
        if not free[k]:
            continue
        free[k], todo = False, [k]
        while todo:
            x = todo.pop()
            near = free & (np.bitwise_count(z ^ z[x]) <= bits)
            if b is not None:
                near[:split] &= x >= split
                near[split:] &= x < split
            for y in np.flatnonzero(near).tolist():
                out.append((x, y))
                todo.append(y)
            free &= ~near
    return out


def links(nodes: DataFrame, bits: int = BITS, chunk: int = CHUNK) -> DataFrame:
    """nodes (fingerprint, rep), one row a fingerprint -> edges (u, v) of reps, in general numbers of the nodes, that connect
    all within so many bits.

    Not all pairs: of each key's links a spanning forest is kept, so a group of g gives g - 1 edges a key or chunk pair.
    """
    keyed = nodes.where("rep IS NOT NULL").select("fingerprint", "rep", F.posexplode(F.array(*[F.col("fingerprint").bitwiseAND(F.lit(m).cast("bigint")) for m in masks()])).alias("mask", "part"))
    size = keyed.groupBy("mask", "part").count().where("count > 1").select("mask", "part", F.ceil(F.col("count") / chunk).cast("int").alias("chunks"))
    dealt = keyed.join(size, ["mask", "part"]).withColumn("chunk", F.pmod(F.xxhash64("fingerprint"), "chunks").cast("int"))
    lists = dealt.groupBy("mask", "part", "chunk", "chunks").agg(F.collect_list(F.struct("fingerprint", "rep")).alias("a"))
    one = lists.select("a", F.array().cast(lists.schema["a"].dataType).alias("b"))
    many = lists.where("chunks > 1")
    left = many.withColumn("other", F.explode(F.sequence("chunk", F.col("chunks") - 1))).where("other > chunk").select("mask", "part", F.col("other").alias("chunk"), "a")
    across = left.join(many.select("mask", "part", "chunk", F.col("a").alias("b")), ["mask", "part", "chunk"]).select("a", "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u, v = [], []
            sides = []
            for column in batch.columns[:2]:
                flat, at = column.flatten(), np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy())])
                sides.append((flat.field(0).to_numpy().view(np.uint64), flat.field(1).to_numpy(), at))
            (fa, ra, ka), (fb, rb, kb) = sides
            for k in range(batch.num_rows):
                x, rx, y, ry = fa[ka[k] : ka[k + 1]], ra[ka[k] : ka[k + 1]], fb[kb[k] : kb[k + 1]], rb[kb[k] : kb[k + 1]]
                reps = np.concatenate([rx, ry]) if len(y) else rx
                for i, j in _forest(x, y if len(y) else None, bits):
                    u.append(int(reps[i]))
                    v.append(int(reps[j]))
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    return one.union(across).mapInArrow(run, "u bigint, v bigint")


def classes(documents: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, root, component_id) of each document: the class's least fingerprint and its least doc_id."""
    spark = documents.sparkSession
    prints = table(spark, fingerprints(documents), "fingerprints")
    nodes = table(spark, prints.groupBy("fingerprint").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")), "nodes")
    roots = components(links(nodes.select("fingerprint", F.col("fingerprint").alias("rep"))))
    linked = nodes.join(roots, nodes["fingerprint"] == roots["node"]).select("fingerprint", "rep", "n", "root")
    least = linked.groupBy(F.col("root").alias("_root")).agg(F.min("rep").alias("component_id"))
    found = table(spark, linked.join(least, linked["root"] == least["_root"]).select("fingerprint", "n", "root", "component_id"), "linked")
    alone = nodes.join(found, "fingerprint", "left_anti").select("fingerprint", "n", F.col("fingerprint").alias("root"), F.col("rep").alias("component_id"))
    return join_hot(prints, found.union(alone), "fingerprint").select("doc_id", "fingerprint", "root", "component_id")


def deduplicate(documents: DataFrame) -> DataFrame:
    """The documents, one of each class of texts: that with the least doc_id, of several such the least fingerprint.

    Rows are told apart by doc_id and fingerprint. Rows without doc_id stay; of equal rows with the same doc_id one does.
    """
    spark = documents.sparkSession
    found = table(spark, classes(documents), "classes")
    own = F.struct("doc_id", "fingerprint")
    keep = found.where("doc_id IS NOT NULL").groupBy("root").agg(F.min(own).alias("kept")).select(F.col("kept.doc_id").alias("doc_id"), F.col("kept.fingerprint").alias("fingerprint"))
    gone = table(spark, found.where("doc_id IS NOT NULL").select("doc_id", "fingerprint").distinct().join(keep, ["doc_id", "fingerprint"], "left_anti"), "gone")
    twice = found.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id")
    twice = table(spark, twice, "twice")
    rows = documents.select(F.struct("*").alias("_row"), F.col("doc_id").cast("bigint").alias("_doc"))
    marks = gone.groupBy("doc_id").agg(F.lit(True).alias("_out")).join(twice.withColumn("_twice", F.lit(True)), "doc_id", "full").withColumnRenamed("doc_id", "_doc")
    marked = rows.where("_doc IS NOT NULL").join(marks, "_doc", "left")
    kept = marked.where("_out IS NULL AND _twice IS NULL").select("_row").union(rows.where("_doc IS NULL").select("_row"))
    if not twice.isEmpty():  # rows whose doc_id occurs again are told apart by their texts, and equal ones merged
        again = fingerprints(marked.where("_twice").select(F.col("_doc").alias("doc_id"), F.col("_row.text").alias("text"), "_row"), "_row")
        kept = kept.union(again.join(gone, ["doc_id", "fingerprint"], "left_anti").groupBy("doc_id", "fingerprint").agg(F.first("_row").alias("_row")).select("_row"))
    return kept.select(*[F.col("_row").getField(c).alias(c) for c in documents.columns])


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's fingerprint in hex and its class."""
    found = classes(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")
