"""Benchmark decontamination with an FM-index per training shard.

Words are runs of [0-9a-z] and non-ASCII characters after A-Z are lower-cased; a window is ten consecutive words of an
item, or the whole item if it is shorter. Each shard (a slice of an Arrow batch) keeps its stretches of benchmark words,
cut by separators, since a window lies wholly in one; an FM-index of those stretches is searched backwards for all
windows at once, occurrences are located by sampled suffix positions, and their spans are merged.

Defined cases: a null or empty text has no words and no hits; an item with null id or without words has no windows;
items with the same id count once; repeated documents each get a row; an empty table on either side gives rows without
hits, or no rows. Other columns of either table don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vecspark.llm.common import ALNUM, LOWER, bytes_of, read, slices, word_hashes, word_spans

WINDOW = 10
#: Bytes of benchmark text searched for in one pass; a larger benchmark takes more passes, merged by document.
BLOCK_BYTES = 32 << 20
#: Bytes of text in a shard.
SHARD_BYTES = 8 << 20
SPANS = "array<struct<start:bigint,end:bigint>>"
ADDED = ("n_words", "n_hit", "items", "words", "bytes")
ADDED_DDL = f"n_words bigint, n_hit bigint, items array<bigint>, words {SPANS}, bytes {SPANS}"


class Phrases:
    """The distinct windows of some benchmark items, as vocabulary numbers from 2; 1 is the separator."""

    def __init__(self, items: list[tuple[int, str]], window: int = WINDOW):
        texts = [t or "" for _, t in items]
        data, off = bytes_of(pa.array(texts, pa.large_string()))
        data = LOWER[data]
        starts, ends, first = word_spans(data, off, ALNUM)
        self.vocabulary, ids = np.unique(word_hashes(data, starts, ends), return_inverse=True)
        found: dict[tuple, set] = {}
        for k, (item, _) in enumerate(items):
            own = ids[first[k] : first[k + 1]] + 2
            if item is not None and len(own):
                for i in range(max(1, len(own) - window + 1)):
                    found.setdefault(tuple(own[i : i + window]), set()).add(int(item))
        self.lengths = np.array([len(w) for w in found], np.int64)
        self.patterns = np.zeros((len(found), window), np.int64)
        for k, w in enumerate(found):
            self.patterns[k, : len(w)] = w
        self.items = [sorted(x) for x in found.values()]
        self.shortest = int(self.lengths.min()) if len(found) else window

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """2 and up for words of the vocabulary, 1 for others."""
        if not len(self.vocabulary):
            return np.ones(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at + 2, 1)


def search_shard(phrases: Phrases, data: np.ndarray, off: np.ndarray, before: tuple[list, list] | None = None) -> dict:
    """The ADDED columns for the texts of one shard; before: items and word spans that other blocks have found."""
    from vecspark.llm.fm_index import FMIndex

    data = LOWER[data]
    starts, ends, first = word_spans(data, off, ALNUM)
    n, docs = len(starts), len(off) - 1
    ids = phrases.numbers(word_hashes(data, starts, ends))
    hit, doc_items = np.zeros(n + 1, np.int64), [set() for _ in range(docs)]
    # stretches of vocabulary words within a document, at least as long as the shortest window
    known = ids > 1
    begins = known.copy()
    begins[1:] &= ~known[:-1]
    heads = first[:-1][first[:-1] < n]
    begins[heads] = known[heads]
    a = np.flatnonzero(begins)
    if len(a) and len(phrases.items):
        cuts = np.union1d(np.flatnonzero(~known), first[first <= n])
        cuts = np.append(cuts, n)
        b = cuts[np.searchsorted(cuts, a, "right")]
        keep = b - a >= phrases.shortest
        a, b = a[keep], b[keep]
    else:
        a = a[:0]
    if len(a):
        size = b - a + 1
        ofs = np.cumsum(size) - size
        place = np.arange(int(size.sum())) - np.repeat(ofs, size) + np.repeat(a, size)
        text = np.append(ids, 1)[place]
        text[ofs + size - 1] = 1
        index = FMIndex(text)
        lo, hi = index.search(phrases.patterns, phrases.lengths)
        count = hi - lo
        which = np.repeat(np.arange(len(count)), count)
        rows = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lo, count)
        at = place[index.locate(rows)] if len(rows) else rows
        np.add.at(hit, at, 1)
        np.add.at(hit, at + phrases.lengths[which], -1)
        doc = np.searchsorted(first, at, "right") - 1
        pairs = np.unique(np.stack([doc, which]), axis=1) if len(at) else np.zeros((2, 0), np.int64)
        for d, w in zip(*pairs.tolist(), strict=True):
            doc_items[d].update(phrases.items[w])
    for d in range(docs) if before else ():
        doc_items[d].update(before[0][d])
        for x in before[1][d]:
            hit[first[d] + x["start"]] += 1
            hit[first[d] + x["end"]] -= 1
    on = np.cumsum(hit[:-1]) > 0
    total = np.concatenate([[0], np.cumsum(on)])
    edge = on.copy()
    edge[1:] &= ~on[:-1]
    edge[heads] = on[heads]
    s = np.flatnonzero(edge)
    stop = on.copy()
    stop[:-1] &= ~on[1:]
    tails = first[1:][first[1:] > 0] - 1
    stop[tails] = on[tails]
    e = np.flatnonzero(stop) + 1
    cut = np.searchsorted(s, first)
    base = off[:-1]

    def spans(x: np.ndarray, y: np.ndarray, less: np.ndarray) -> list:
        return [[{"start": int(x[j] - less[d]), "end": int(y[j] - less[d])} for j in range(cut[d], cut[d + 1])] for d in range(docs)]

    return {"n_words": np.diff(first), "n_hit": total[first[1:]] - total[first[:-1]], "items": [sorted(x) for x in doc_items], "words": spans(s, e, first[:-1]), "bytes": spans(starts[s], ends[e - 1], base) if len(s) else [[] for _ in range(docs)]}


def _annotated(df: DataFrame, phrases: Phrases, first_pass: bool) -> DataFrame:
    """df with the ADDED columns, or with those it has from earlier blocks widened by this block's occurrences."""
    shared = df.sparkSession.sparkContext.broadcast(phrases)
    own = df.columns if first_pass else df.columns[: -len(ADDED)]
    at = own.index("text")
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    types = [pa.int64(), pa.int64(), pa.list_(pa.int64()), kind, kind]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = bytes_of(batch.column(at))
            for a, b in slices(off, SHARD_BYTES):
                part = batch.slice(a, b - a)
                before = None if first_pass else (part.column(len(own) + 2).to_pylist(), part.column(len(own) + 3).to_pylist())
                got = search_shard(shared.value, data[off[a] : off[b]], off[a : b + 1] - off[a], before)
                yield pa.RecordBatch.from_arrays([*part.columns[: len(own)], *(pa.array(got[k], t) for k, t in zip(ADDED, types, strict=True))], [*own, *ADDED])

    schema = T.StructType([*df.schema.fields[: len(own)], *T._parse_datatype_string(ADDED_DDL).fields])
    return df.mapInArrow(run, schema)


def _blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple[int, str]]]:
    """Items in blocks of bounded size; the driver holds one block at a time."""
    block, size = [], 0
    for r in benchmark.select(F.col("item_id").cast("bigint"), F.col("text").cast("string")).toLocalIterator():
        block.append((r[0], r[1]))
        size += len(r[1] or "") * 4 + 64
        if size >= block_bytes:
            yield block
            block, size = [], 0
    yield block


def _all_blocks(documents: DataFrame, benchmark: DataFrame, window: int, block_bytes: int) -> DataFrame:
    out = documents
    for k, block in enumerate(_blocks(benchmark, block_bytes)):
        out = _annotated(out, Phrases(block, window), k == 0)
    return out


def contamination(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per document: n_words, n_hit, items, and the merged hit spans in words and in bytes of the UTF-8 text."""
    docs = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return _all_blocks(docs, benchmark, window, block_bytes).drop("text")


def decontaminate(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents, each without its hit spans; texts without hits stay as they are, and every row is kept."""
    columns = documents.columns
    at, count = columns.index("text"), columns.index("n_chars") if "n_chars" in columns else None
    clear = documents.toDF(*["text" if k == at else f"column_{k}" for k in range(len(columns))])
    found = _all_blocks(clear, benchmark, window, block_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = list(batch.columns[: len(columns)])
            cuts = batch.column(batch.num_columns - 1).to_pylist()
            if any(cuts):
                texts = own[at].to_pylist()
                sizes = own[count].to_pylist() if count is not None else [0] * len(texts)
                for k, cut in enumerate(cuts):
                    if cut:
                        raw = texts[k].encode()
                        ends, starts = [0, *(c["end"] for c in cut)], [*(c["start"] for c in cut), len(raw)]
                        texts[k] = b"".join(raw[x:y] for x, y in zip(ends, starts, strict=True)).decode()
                        sizes[k] = len(texts[k])
                own[at] = pa.array(texts, own[at].type)
                if count is not None:
                    own[count] = pa.array(sizes, own[count].type)
            yield pa.RecordBatch.from_arrays(own, columns)

    return found.mapInArrow(run, documents.schema)


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's contamination by the benchmark; the item digest is of the ids sorted as strings, comma-joined."""
    found = contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    ids = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), F.sha2(F.concat_ws(",", ids), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


OP2_SQL = r"""
WITH dw AS (SELECT doc_id, coalesce(regexp_extract_all(lower_az, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
            FROM (SELECT doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_az FROM documents)),
bw AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
       FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + 9], ' ') AS p
        FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM bw WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
dp AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS p
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, sizes WHERE len(w) >= n)),
occ AS (SELECT doc_id, i, dp.n, item_id FROM dp JOIN win ON dp.p = win.p AND dp.n = win.n),
hits AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM occ) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
        FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM occ) GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hits USING (doc_id) LEFT JOIN its USING (doc_id)
"""
