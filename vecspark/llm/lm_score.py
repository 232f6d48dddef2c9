"""Cross-entropy difference: matched target and background bigram models over one vocabulary.

The target model is learned from documents labelled quality 1, the background model from all others, both in one pass
over all whole texts. Words ([0-9a-z] and non-ASCII runs, A-Z lower-cased) and word pairs are counted each under a key of
its own: 62 bits of a hash and two bits for which of the two it is. A word precedes another wherever it isn't the last of
its document, so predecessors' counts are the words' less those of last words. The models are matched: the larger
model's counts are scaled to the mass of the smaller, and both are smoothed alike (pairs by MU pseudo-words of the
unigram model, unigrams by ALPHA a word, for 2**UNIGRAM_BITS words or as many as there are, if those are more).

1. Texts are dealt into shards of SHARD_BYTES where they are read, one row each, in a table bucketed by shard: what meets
   a shard later comes to its bucket, and texts are never shuffled. Which documents are target is told by doc_id and place.
   A shard's distinct keys and its own counts, cut into as many parts of the key space as the corpus has PART_BYTES, are
   cells of numbers, a row each, not one a key: gaps of ordered keys, by bytes of equal weight, compressed.
2. A part's cells are summed, which makes that part of the models, and each shard is told the whole counts of its keys.
3. A shard's texts meet its counts again and are scored. Nothing that grows with the corpus is broadcast or gathered:
   the driver holds six sums, and a task one part or one shard.

A document's own counts are taken out of the model it was learned in before it is scored, so labelled documents are not
favoured. Per document: n_tokens, the mean loss in nats a token of each model, and their difference (target less
background; lower is closer to the target).

Defined cases: a null or empty text, or one without words, has 0 tokens and losses and score 0; documents without a
label, or with a null one, are background; a document with several labels is target if one is; null doc_ids are
background; repeated rows count as often as they occur; without target documents both models are alike in mass 0 and
every score is that of smoothing alone; an empty table gives no rows; other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecspark.llm.common import ALNUM, LOWER, bucketed, bytes_of, read, slices, table, word_hashes, word_spans

#: The vocabulary that smoothing takes for granted, as a power of two; not a bound on words.
UNIGRAM_BITS = 20
MU = 20.0
ALPHA = 0.05
SHARD_BYTES = 4 << 20
#: Text whose keys make one part of the models, and the least number of parts.
PART_BYTES = 16 << 20
LEAST_PARTS = 32
_START = np.uint64(0x51ED270B9F3C44D5)
_WORD, _PAIR = np.uint64(0), np.uint64(2)
_SHARD = "shard bigint, size bigint, off binary, data binary, docs array<bigint>"
_SCORES = "doc_id bigint, n_tokens bigint, target_loss double, background_loss double, score double"


def _packed(x: np.ndarray) -> bytes:
    return pa.Codec("zstd", compression_level=1).compress(np.ascontiguousarray(x).tobytes(), asbytes=True)


def _unpacked(x: bytes, dtype: str, n: int) -> np.ndarray:
    return np.frombuffer(pa.Codec("zstd").decompress(x, n * np.dtype(dtype).itemsize, asbytes=True), dtype)


def _coded(x: np.ndarray) -> bytes:
    """Numbers from 0 on as a byte for how wide they are and their bytes, those of equal weight together, compressed."""
    if not len(x):
        return b""
    width = max(1, -(-int(x.max()).bit_length() // 8))
    return bytes([width]) + _packed(np.ascontiguousarray(x.astype("<u8")).view("u1").reshape(-1, 8)[:, :width].T)


def _decoded(x: bytes, n: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    if n:
        out[:, : x[0]] = _unpacked(x[1:], "u1", n * x[0]).reshape(x[0], n).T
    return out.view("<u8").ravel()


def numbers(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each word: its key and that of the pair with its predecessor (or a start); and the first word of each row."""
    data = LOWER[data]
    starts, ends, first = word_spans(data, off, ALNUM)
    h = word_hashes(data, starts, ends)
    before = np.empty_like(h)
    before[1:] = h[:-1]
    before[first[:-1][first[:-1] < len(h)]] = _START
    with np.errstate(over="ignore"):
        pair = (before * np.uint64(0x9E3779B97F4A7C15)) ^ h
        pair ^= pair >> np.uint64(31)
        pair *= np.uint64(0xD6E8FEB86659FD93)
    word, pair = (x & ~np.uint64(3) | np.uint64(kind) for kind, x in ((_WORD, h), (_PAIR, pair)))
    return word, pair, first


def distinct(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A shard's keys in order, where among them each word and pair is (2 x words), each row's first word."""
    word, pair, first = numbers(data, off)
    keys, at = np.unique(np.concatenate([word, pair]), return_inverse=True)
    return keys, at.reshape(2, -1), first


def sharded(rows: DataFrame) -> DataFrame:
    """rows (doc_id, text) -> a table of shards: their number, bytes, documents, offsets and texts.

    If rows have a target, so have shards.
    """
    lists = ["doc_id"] + ["target"] * ("target" in rows.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            data, off = bytes_of(batch.column(0))
            for a, b in slices(off, SHARD_BYTES):
                ends = pa.array([0, b - a], pa.int32())
                held = [pa.array([_packed(x)], pa.binary()) for x in (off[a : b + 1] - off[a], data[off[a] : off[b]])]
                held += [pa.ListArray.from_arrays(ends, x.slice(a, b - a)) for x in batch.columns[1:]]
                yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([off[b] - off[a]], pa.int64()), *held], ["shard", "size", "off", "data", "docs", "target"][: 4 + len(lists)])
                number += 1

    found = rows.select("text", *lists).mapInArrow(run, _SHARD + ", target array<boolean>" * (len(lists) - 1))
    return bucketed(rows.sparkSession, found, "shard", "shards")


def sides(shards: DataFrame, good: DataFrame | None) -> DataFrame:
    """(shard, good): the places of a shard's target documents, by their own target or by the ids good (_good)."""
    if good is None:
        return shards.selectExpr("shard", "posexplode(target) AS (at, target)").where("target").groupBy("shard").agg(F.collect_list("at").alias("good"))
    ids = shards.selectExpr("shard", "posexplode(docs) AS (at, doc)")
    met = ids.join(good.hint("merge"), F.col("doc") == F.col("_good"))  # dealt by doc_id at every size
    return met.groupBy("shard").agg(F.collect_list("at").alias("good"))


def _target(places: pa.ChunkedArray, docs: int) -> np.ndarray:
    target = np.zeros(docs, bool)
    for x in places.to_pylist():
        target[x or []] = True
    return target


def _opened(size: int, docs: int, off: bytes, data: bytes) -> tuple[np.ndarray, np.ndarray]:
    return _unpacked(data, "u1", size), _unpacked(off, "<i8", docs + 1)


def counted(shards: DataFrame, sides: DataFrame, parts: int) -> DataFrame:
    """(shard, part, size, keys, n, last, begun): a shard's distinct keys in a part and its own counts of them, target's and
    background's, as all words or pairs and as last words. begun: the documents with words of both sides, in one row."""

    def run(shard: pa.Table, side: pa.Table) -> pa.Table:
        number, size, off, data = (shard[c][0].as_py() for c in ("shard", "size", "off", "data"))
        docs = len(shard["docs"][0])
        target = _target(side["good"], docs)
        keys, at, first = distinct(*_opened(size, docs, off, data))
        tokens = np.diff(first)
        good, ended = np.repeat(target, tokens), at[0][first[1:][tokens > 0] - 1]
        n = np.stack([np.bincount(at[:, x].ravel(), minlength=len(keys)) for x in (good, ~good)])
        last = np.stack([np.bincount(ended[x[tokens > 0]], minlength=len(keys)) for x in (target, ~target)])
        part = ((keys >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
        cuts = np.searchsorted(part, np.arange(parts + 1, dtype=np.uint64))
        some = np.flatnonzero(np.diff(cuts))
        word = (keys & np.uint64(3)) == _WORD
        spans = [slice(cuts[p], cuts[p + 1]) for p in some]
        columns = [pa.array(np.full(len(some), number), pa.int64()), pa.array(some, pa.int32()), pa.array(np.diff(cuts)[some], pa.int32())]
        columns += [pa.array([_coded(np.diff(keys[x], prepend=np.uint64(0))) for x in spans], pa.binary())]
        columns += [pa.array([_coded(n[:, x].ravel()) for x in spans], pa.binary()), pa.array([_coded(last[:, x][:, word[x]].ravel()) for x in spans], pa.binary())]
        begun = [int((target == side)[tokens > 0].sum()) for side in (True, False)]
        columns += [pa.array([begun] + [[0, 0]] * (len(some) - 1) if len(some) else [], pa.list_(pa.int64()))]
        return pa.table(columns, ["shard", "part", "size", "keys", "n", "last", "begun"])

    schema = "shard bigint, part int, size int, keys binary, n binary, last binary, begun array<bigint>"
    return shards.groupBy("shard").cogroup(sides.groupBy("shard")).applyInArrow(run, schema)


def summed(cells: DataFrame) -> DataFrame:
    """cells -> (shard, part, size, n, last, sums): the whole counts of each cell's keys.

    sums are a part's, in one of its rows: words learned of either side, documents begun of either side, distinct words.
    """

    def run(part: pa.Table) -> pa.Table:
        size = part["size"].to_pylist()
        keys = [np.cumsum(_decoded(x, k), dtype=np.uint64) for x, k in zip(part["keys"].to_pylist(), size, strict=True)]
        every, at = np.unique(np.concatenate(keys), return_inverse=True)
        word = (every & np.uint64(3)) == _WORD
        at, n, last = np.split(at, np.cumsum(size)[:-1]), np.zeros((2, len(every)), np.int64), np.zeros((2, len(every)), np.int64)
        for i, x, y in zip(at, part["n"].to_pylist(), part["last"].to_pylist(), strict=True):
            words = i[word[i]]
            n[:, i] += _decoded(x, 2 * len(i)).astype(np.int64).reshape(2, -1)
            last[:, words] += _decoded(y, 2 * len(words)).astype(np.int64).reshape(2, -1)
        begun = np.sum(part["begun"].to_pylist(), axis=0)
        sums = [int(n[0, word].sum()), int(n[1, word].sum()), int(begun[0]), int(begun[1]), int(word.sum())]
        columns = [part["shard"], part["part"], part["size"], pa.array([_coded(n[:, i].ravel()) for i in at], pa.binary())]
        columns += [pa.array([_coded(last[:, i[word[i]]].ravel()) for i in at], pa.binary()), pa.array([sums] + [[0] * 5] * (len(size) - 1), pa.list_(pa.int64()))]
        return pa.table(columns, ["shard", "part", "size", "n", "last", "sums"])

    return cells.groupBy("part").applyInArrow(run, "shard bigint, part int, size int, n binary, last binary, sums array<bigint>")


@dataclass
class Models:
    """The rows learned from, as shards, and the models' counts as each shard needs them: tables that grow with the corpus."""

    rows: DataFrame
    shards: DataFrame
    counts: DataFrame
    mass: tuple[int, int]
    begun: tuple[int, int]
    words: int


def _loss(c: list[np.ndarray], mass: np.ndarray, scale: float, words: int) -> np.ndarray:
    """Each word's negative log-probability, from the counts of the word, its predecessor and the pair."""
    p1 = (scale * c[0] + ALPHA) / (scale * mass + ALPHA * max(words, 1 << UNIGRAM_BITS))
    return -np.log((scale * c[2] + MU * p1) / (scale * c[1] + MU))


def _within(doc: np.ndarray, x: np.ndarray, most: int) -> np.ndarray:
    """How often each number occurs in its own document."""
    _, inverse, count = np.unique(doc * most + x, return_inverse=True, return_counts=True)
    return count[inverse]


def _texts(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _good(labels: DataFrame) -> DataFrame:
    return labels.where("quality = 1 AND doc_id IS NOT NULL").select(F.col("doc_id").cast("bigint").alias("_good")).distinct()


def labelled(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text, target). Both sides are dealt by doc_id at every size: the ids of good documents grow with the corpus."""
    docs, good = _texts(documents), _good(labels)
    return docs.join(good.hint("merge"), docs["doc_id"] == good["_good"], "left").select("doc_id", "text", F.col("_good").isNotNull().alias("target"))


def train(rows: DataFrame, good: DataFrame | None = None) -> Models:
    """Both models of rows (doc_id, text, target), or of rows (doc_id, text) whose targets are the ids good (_good); the
    driver gathers six sums."""
    shards = sharded(rows)
    side = table(rows.sparkSession, sides(shards, good), "sides")
    total = shards.agg(F.sum("size")).first()[0] or 0
    counts = table(rows.sparkSession, summed(counted(shards, side, max(LEAST_PARTS, -(-total // PART_BYTES)))), "counts")
    sums = [x or 0 for x in counts.agg(*[F.sum(F.get("sums", F.lit(i))) for i in range(5)]).first()]
    cells = counts.select("shard", "part", "size", "n", "last", F.lit(None).cast("array<int>").alias("good"))
    told = side.select("shard", F.lit(-1).alias("part"), F.lit(0).alias("size"), F.lit(None).cast("binary").alias("n"), F.lit(None).cast("binary").alias("last"), "good")
    return Models(rows, shards, cells.union(told), (sums[0], sums[1]), (sums[2], sums[3]), sums[4])


def scored(rows: DataFrame, models: Models) -> DataFrame:
    """(doc_id, n_tokens, target_loss, background_loss, score) of the rows that the models are learned from."""
    if rows is not models.rows:
        raise ValueError("a document's own counts are taken out, so only the rows learned from can be scored")
    mass, begun, words = models.mass, models.begun, models.words
    least = min((m for m in mass if m), default=0)

    def run(shard: pa.Table, cells: pa.Table) -> pa.Table:
        docs = shard["docs"].combine_chunks().flatten()
        size, off, data = (shard[c][0].as_py() for c in ("size", "off", "data"))
        target = _target(cells["good"], len(docs))
        keys, at, first = distinct(*_opened(size, len(docs), off, data))
        word = (keys & np.uint64(3)) == _WORD
        n, last, done = np.zeros((2, len(keys)), np.int64), np.zeros((2, len(keys)), np.int64), 0
        for part, k, x, y in sorted(zip(*(cells[c].to_pylist() for c in ("part", "size", "n", "last")), strict=True), key=lambda c: c[0]):
            if part >= 0:
                n[:, done : done + k] = _decoded(x, 2 * k).reshape(2, -1)
                known = done + np.flatnonzero(word[done : done + k])
                last[:, known] = _decoded(y, 2 * len(known)).reshape(2, -1)
                done += k
        if done != len(keys):
            raise ValueError(f"a shard has {len(keys)} keys and counts of {done}")
        tokens = np.diff(first)
        doc = np.repeat(np.arange(len(tokens)), tokens)
        before = np.full(at.shape[1], len(keys))  # that of a start stands behind the keys
        before[1:] = at[0, :-1]
        before[first[:-1][tokens > 0]] = len(keys)
        places = (at[0], before, at[1])
        own = [_within(doc, x, len(keys) + 1) for x in places]
        means = []
        for side in (0, 1):
            mine = (target == (side == 0))[doc]
            every = (n[side], np.append(n[side] - last[side], begun[side]), n[side])
            c = [z[x] - np.where(mine, y, 0) for x, y, z in zip(places, own, every, strict=True)]
            loss = _loss(c, mass[side] - np.where(mine, tokens[doc], 0), least / mass[side] if mass[side] else 0.0, words)
            sums = np.concatenate([[0.0], np.cumsum(loss)])
            means.append((sums[first[1:]] - sums[first[:-1]]) / np.maximum(tokens, 1))
        return pa.table([docs, pa.array(tokens, pa.int64()), pa.array(means[0]), pa.array(means[1]), pa.array(means[0] - means[1])], ["doc_id", "n_tokens", "target_loss", "background_loss", "score"])

    return models.shards.groupBy("shard").cogroup(models.counts.groupBy("shard")).applyInArrow(run, _SCORES)


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's losses and their difference."""
    rows = _texts(read(spark, sf_dir, "documents"))
    return scored(rows, train(rows, _good(read(spark, sf_dir, "labels"))))
