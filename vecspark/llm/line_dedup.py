"""Line dedup by an exact set-similarity join, all in DataFrame operations.

A line's tokens are its shingles of so many words, or with shingle=1 its distinct words; words are runs without white
space, and a line of fewer words is one shingle. A line occurrence goes if an earlier one, by doc_id and then line number,
has the same text, or if the Jaccard similarity of its tokens and another, earlier line's is at least THRESHOLD. Lines
without words stay. op1 takes shingles of SHINGLE words, which its SQL fixes; the pipeline takes words.

1. Equal lines meet under 128 bits of hashes with their first occurrence; only keys, never texts, are grouped.
2. Nearly all shingles are rare, so most lines end here: a line of n tokens has at most n - ceil(0.8 n) that a similar line
   lacks. Of the tokens whose hash is in CHOSEN of CHOICES parts of all hashes, a line that has more than so many to itself
   can't be similar to any. The others, with those of too few such tokens, go on, all of their tokens with them. (Words recur
   too much.)
3. Tokens of the lines that are left are ordered by rarity: by the number of lines that hold a token of their bucket (of
   BUCKETS, so the table of them has a fixed size), then by hash. Any order that all lines share gives the same result;
   this one keeps groups small.
4. A line is indexed under the tokens of its prefix, of which a similar line's prefix shares the first that both have.
   Pairs that meet pass the length filter, the positional filter and a bound on the symmetric difference, which the parity
   of 128 hashed bits gives; what is left is verified on the words or shingles themselves.
5. A token in HOT lines or more isn't a key by itself. The prefix argument holds again behind it: the next token that both
   lines share is within the rest of the prefix and one more, so such tokens are keys with each of those. Lines of LONG
   tokens or more have the token alone for a key, of a kind that only they share.
6. Of a key's group, where the token is in WARM lines or more, the earliest line is tried first, against all others, which
   is linear and settles groups of near copies. Of two settled lines neither has to meet the other any more. Lines that it
   doesn't settle meet the group's other lines, in the groups of hot keys those of like size.

Defined cases: a null text is empty, one line without words; rows with the same doc_id and line number count as one
occurrence if the lines are equal, else the smaller key is earlier; null doc_ids come first; an empty table gives no
rows; other columns are kept as they are and may have any names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vecspark.llm.common import drop_table, read, table, text_of

SHINGLE = 5
#: The least Jaccard similarity, as a fraction.
THRESHOLD = (4, 5)
#: Tables of at most so many rows of a few numbers are broadcast after they have been counted (some 90 bytes a row as a
#: hash table, so 180 MB); larger ones are shuffled.
BROADCAST_ROWS = 2_000_000
#: Of CHOICES parts of all hashes (a power of two), those of whose tokens the first filter looks for lines that hold them.
CHOSEN, CHOICES = 3, 8
#: Buckets of words by hash; the table of their levels is one byte each.
BUCKETS = 1 << 18
#: Levels are so many to a doubling; a word whose bucket is in HOT lines or more is hot.
STEPS = 3
HOT = 4096
#: A word that isn't hot, but whose bucket is in WARM lines or more, is tried against its earliest line first.
WARM = 512
#: Lines of fewer words than NARROW have pair keys for hot words, those of LONG or more have single ones; NARROW is LONG by THRESHOLD.
LONG, NARROW = 256, 320
#: Lines of more tokens have parities of 128 bits, others of 64.
WIDE = 64
_BLANK = " \t\r\f\x0b"


def small(df: DataFrame) -> DataFrame:
    """A written table, to be broadcast if its count is within the bound, else to be joined by shuffling both sides."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df.hint("merge")


def lines(documents: DataFrame) -> DataFrame:
    """(doc_id, line_no, line, key, check) of lines with words; key and check are two hashes of the line."""
    found = documents.select("doc_id", F.posexplode(F.split(text_of("text"), "\n")).alias("line_no", "line"))
    return found.where(F.btrim("line", F.lit(_BLANK)) != "").withColumns({"key": F.xxhash64("line"), "check": F.xxhash64(F.lit(1), "line")})


def words(line: Column) -> Column:
    """The words of a line. Lines whose words are apart by single spaces, as most are, need no pattern."""
    odd = F.contains(line, F.lit("  "))
    for c in _BLANK[1:]:
        odd = odd | F.contains(line, F.lit(c))
    trimmed = F.btrim(line, F.lit(_BLANK))
    return F.when(odd, F.split(trimmed, f"[{_BLANK}]+")).otherwise(F.split(trimmed, " "))


def hashed(texts: DataFrame, shingle: int) -> DataFrame:
    """texts (..., line) with h, the hashes of the line's tokens, each once, in place of line.

    The generators hold what is computed, so that it isn't computed again for each use.
    """
    rest = [c for c in texts.columns if c != "line"]
    of_words = F.transform(words(F.col("line")), lambda w: F.xxhash64(w))
    if shingle == 1:
        return texts.select(*rest, F.explode(F.array(F.array_distinct(of_words))).alias("h"))
    w = F.col("_w")
    shingles = F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - shingle, F.lit(0))), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(shingle)]))
    return texts.select(*rest, F.explode(F.array(of_words)).alias("_w")).select(*rest, F.explode(F.array(F.array_distinct(shingles))).alias("h"))


def spelled(texts: DataFrame, shingle: int) -> DataFrame:
    """texts (..., line) with w, the line's tokens as texts, each once, in place of line."""
    rest = [c for c in texts.columns if c != "line"]
    if shingle == 1:
        return texts.select(*rest, F.array_distinct(words(F.col("line"))).alias("w"))
    w = F.col("_w")
    shingles = F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - shingle + 1, F.lit(1))), lambda i: F.array_join(F.slice(w, i, shingle), " "))
    return texts.select(*rest, F.explode(F.array(words(F.col("line")))).alias("_w")).select(*rest, F.array_distinct(shingles).alias("w"))


def _needed(n: Column) -> Column:
    """The least overlap that a line of n tokens has with any similar one: ceil(t * n)."""
    a, b = THRESHOLD
    return F.floor((n * a + b - 1) / b).cast("int")


def _prefix(n: Column) -> Column:
    return n - _needed(n) + 1


def suspects(once: DataFrame, shingle: int) -> DataFrame:
    """once (key, line), one row a text -> a table (key): keys whose chosen tokens allow for a similar line.

    A token is chosen by its own hash, so in every line that holds it. Of a line's n tokens a similar line lacks at most
    n - _needed(n), so if more than that are chosen and occur but once in all, the line has no similar one. Repeats within
    a line make n larger and its own tokens fewer, so they only let more lines through; a line with few chosen tokens goes
    through too. Generated code makes the rows, which takes a small part of what functions over arrays would.
    """
    spark = once.sparkSession
    w, i, token = F.col("_w"), F.col("_i"), F.col("token")
    last = F.greatest(F.size(w) - shingle, F.lit(0))
    of_words = once.select("key", F.explode(F.array(F.transform(words(F.col("line")), lambda x: F.xxhash64(x)))).alias("_w"))
    every = of_words.select("key", "_w", F.explode(F.sequence(F.lit(0), last)).alias("_i"))
    hashes = every.select("key", (last + 1).alias("n"), "_i", (F.size(w) < shingle).alias("short"), F.xxhash64(*[F.get(w, i + k) for k in range(shingle)]).alias("token"))
    chosen = F.col("short") | (token.bitwiseAND(F.lit(CHOICES - 1)) < CHOSEN)
    held = table(spark, hashes.where(chosen | (i == 0)).select("key", "n", chosen.alias("chosen"), "token"), "hash-choice")
    common = small(table(spark, held.groupBy("token").agg(F.count("*").alias("n")).where("n > 1").select("token"), "common"))
    own = F.count(F.when(F.col("chosen") & F.col("common").isNull(), 1))
    met = held.join(common.withColumn("common", F.lit(True)), "token", "left").groupBy("key").agg(F.max("n").alias("n"), own.alias("own"))
    out = table(spark, met.where(F.col("own") <= F.col("n") - _needed(F.col("n"))).select("key"), "suspects")
    drop_table(spark, held)
    return out


def levels(tokens: DataFrame) -> Column:
    """The level of each bucket, a logarithm of the number of lines that hold its tokens: a constant of BUCKETS bytes."""
    token = tokens.select(F.explode("h").alias("h"))
    every = token.select(F.col("h").bitwiseAND(F.lit(BUCKETS - 1)).alias("bucket"), F.lit(1).alias("one"))
    counts = every.union(tokens.sparkSession.range(BUCKETS).select("id", F.lit(0))).groupBy("bucket").agg(F.sum("one").alias("n"))
    level = F.least(F.floor(F.log2(F.col("n") + 1) * STEPS), F.lit(127))
    coded = counts.select((F.shiftleft("bucket", 8) + level).alias("x")).agg(F.sort_array(F.collect_list("x")).alias("x"))
    return F.split(F.lit(coded.select(F.array_join(F.transform("x", lambda x: x.bitwiseAND(F.lit(255)).cast("string")), ",")).first()[0]), ",").cast("array<tinyint>")


def _parity(h: Column, half: bool) -> Column:
    """64 bits: of each, whether an odd number of the hashes fall on it. half: only of hashes whose seventh bit is set."""

    def flip(bits: Column, x: Column) -> Column:
        own = F.call_function("shiftleft", F.shiftright(x, 6).bitwiseAND(F.lit(1)) if half else F.lit(1).cast("bigint"), x.bitwiseAND(F.lit(63)).cast("int"))
        return bits.bitwiseXOR(own)

    return F.aggregate(h, F.lit(0).cast("bigint"), flip)


def prefixes(tokens: DataFrame) -> DataFrame:
    """tokens (key, first, h) -> (key, first, n, all, half, s): a line's number of tokens, their parities, and its prefix and the token after it.

    A token is its level, then 56 bits of its hash. Of lines of up to three tokens s is all. half is of lines of more than
    WIDE tokens, whose parities need 128 bits.
    """
    by_bucket = levels(tokens)

    def token(x: Column) -> Column:
        found = F.coalesce(F.get(by_bucket, x.bitwiseAND(F.lit(BUCKETS - 1)).cast("int")).cast("bigint"), F.lit(0).cast("bigint"))
        return F.shiftleft(found, 56).bitwiseOR(F.shiftrightunsigned(x, 8))

    n, h = F.size("h"), F.col("h")
    some = F.slice(F.sort_array(F.transform("h", token)), F.lit(1), F.when(n <= 3, n).otherwise(_prefix(n) + 1))
    half = F.when(n > WIDE, _parity(h, True)).otherwise(F.lit(0).cast("bigint"))
    return tokens.select("key", "first", n.alias("n"), _parity(h, False).alias("all"), half.alias("half"), some.alias("s"))


def _level(token: Column) -> Column:
    return F.shiftrightunsigned(token, 56)


def _least(lines: int) -> int:
    """The level from which on a bucket counts as having so many lines."""
    return STEPS * (lines.bit_length() - 1)


def _hot(token: Column) -> Column:
    return _level(token) >= _least(HOT)


def single_keys(found: DataFrame, *more: str) -> DataFrame:
    """prefixes() -> (token, key, at, all, half, *more): a row for each prefix token that isn't hot; at: size and position."""
    p = found.where("n > 3").select("key", "n", "all", "half", *more, F.posexplode(F.slice(F.col("s"), F.lit(1), _prefix(F.col("n")))).alias("i", "token"))
    return p.where(~_hot(F.col("token"))).select("token", "key", _at(F.col("n"), F.col("i")).alias("at"), "all", "half", *more)


def hot_keys(found: DataFrame) -> DataFrame:
    """prefixes() -> (token, key, at, all, half, first): hot prefix tokens, each with those that the next shared one is among."""
    n = F.col("n")
    last = F.get("s", F.when(n > 3, _prefix(n) - 1).otherwise(F.lit(0)))
    some = found.where((n <= 3) | _hot(last))

    def pairs(t: Column, i: Column) -> Column:
        one = F.when(n >= LONG, F.array(F.xxhash64(F.lit(1), t))).otherwise(F.array().cast("array<bigint>"))
        two = F.when(n < NARROW, F.transform(F.slice(F.col("s"), i + 2, _prefix(n) - i), lambda u: F.xxhash64(t, u))).otherwise(F.array().cast("array<bigint>"))
        return F.transform(F.when(_hot(t), F.concat(one, two)).otherwise(F.array().cast("array<bigint>")), lambda x: F.struct(x.alias("token"), i.alias("i")))

    whole = F.array(F.struct(F.xxhash64("s").alias("token"), F.lit(0).alias("i")))
    entries = F.when(n <= 3, whole).otherwise(F.flatten(F.transform(F.slice(F.col("s"), F.lit(1), _prefix(n)), pairs)))
    rows = some.select("key", "first", "n", "all", "half", F.explode(entries).alias("e"))
    return rows.select(F.col("e.token").alias("token"), "key", _at(n, F.col("e.i")).alias("at"), "all", "half", "first")


def _at(n: Column, i: Column) -> Column:
    return F.shiftleft(n.cast("bigint"), 32).bitwiseOR(i.cast("bigint"))


def _met(x: str, y: str) -> Column:
    """Filters of a pair at a key: length; position, for if both have it first, only tokens from here on are shared; parity."""
    a, b = THRESHOLD
    n, m = (F.shiftright(f"{side}.at", 32) for side in (x, y))
    i, j = (F.col(f"{side}.at").bitwiseAND(F.lit((1 << 32) - 1)) for side in (x, y))
    whole, part = (F.col(f"{x}.{c}").bitwiseXOR(F.col(f"{y}.{c}")) for c in ("all", "half"))
    differ = F.when(F.least(n, m) > WIDE, F.bit_count(part) + F.bit_count(whole.bitwiseXOR(part))).otherwise(F.bit_count(whole))
    most = F.least(n - i, m - j)
    return (n * b >= m * a) & (m * b >= n * a) & (differ * (a + b) <= (n + m) * (b - a)) & (most * (a + b) >= (n + m) * a)


def _pairs(met: DataFrame) -> DataFrame:
    x, y = F.col("x.key"), F.col("y.key")
    return met.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).distinct()


def verified(pairs: DataFrame, texts: DataFrame, shingle: int) -> DataFrame:
    """pairs (a, b) of keys -> (key, check): lines that an earlier one is similar to, by the tokens themselves."""
    spark = texts.sparkSession
    pairs = table(spark, pairs, "pairs")
    named = pairs.select("a").union(pairs.select("b")).distinct().withColumnRenamed("a", "key")
    sets = table(spark, spelled(texts.join(named, "key", "left_semi").select("key", F.struct("first", "key", "check").alias("o"), "line"), shingle), "sets")
    x, y = (sets.select(F.col("key").alias(side), F.col("o").alias(f"o{side}"), F.col("w").alias(f"w{side}")) for side in "ab")
    a, b = THRESHOLD
    like = F.size(F.array_intersect("wa", "wb")) * (a + b) >= (F.size("wa") + F.size("wb")) * a
    later = pairs.join(x, "a").join(y, "b").where(like).select(F.greatest("oa", "ob").alias("o"))
    return table(spark, later.select("o.key", "o.check").distinct(), "similar")


def leads(keys: DataFrame) -> DataFrame:
    """keys -> (token, y, lines) of the groups of several lines; y is the earliest of them."""
    return keys.groupBy("token").agg(F.min(F.struct("first", "key", "at", "all", "half")).alias("y"), F.count("*").alias("lines")).where("lines > 1")


def _led(keys: DataFrame, lead: DataFrame) -> DataFrame:
    met = keys.select("token", F.struct("key", "at", "all", "half").alias("x")).join(lead, "token")
    return met.where((F.col("x.key") != F.col("y.key")) & _met("x", "y"))


def near(texts: DataFrame, shingle: int) -> DataFrame:
    """texts: (key, check, first, line), one row a text -> (key, check) of those that an earlier one is similar to."""
    spark = texts.sparkSession
    tokens = hashed(texts.select("key", "first", "line"), shingle)
    if shingle > 1:  # of few lines, and dear to compute
        tokens = table(spark, tokens, "tokens")
    found = table(spark, prefixes(tokens), "prefixes")
    warm = single_keys(found, "first").where(_level(F.col("token")) >= _least(WARM))
    hot = hot_keys(found)
    shared = table(spark, hot.groupBy("token").agg(F.count("*").alias("lines")).where("lines > 1"), "shared")
    hot = table(spark, hot.join(shared, "token", "left_semi"), "hot")
    lead = table(spark, leads(hot), "leads")
    led = _pairs(_led(hot, lead).unionByName(_led(warm, leads(warm))))
    settled = verified(led, texts, shingle)
    done = small(table(spark, settled.select("key").distinct(), "settled"))
    flagged = found.join(done.withColumn("done", F.lit(True)), "key", "left").withColumn("done", F.coalesce("done", F.lit(False)))
    cold = single_keys(flagged, "done")
    open_ = ~(F.col("x.done") & F.col("y.done"))
    met = cold.alias("x").hint("merge").join(cold.alias("y"), "token").where((F.col("x.key") < F.col("y.key")) & open_ & _met("x", "y"))
    candidates = _pairs(met)
    if not hot.isEmpty():
        left = hot.join(done, "key", "left_anti").join(lead.where("lines > 2").select("token"), "token", "left_semi")
        size = F.floor(F.log(F.shiftright("at", 32)) / F.log(F.lit(THRESHOLD[1] / THRESHOLD[0]))).cast("int")
        probes = left.withColumn("size", F.explode(F.array(size - 1, size, size + 1)))
        order = lambda s: F.struct(F.col(f"{s}.first").alias("first"), F.col(f"{s}.key").alias("key"))
        rest = probes.alias("x").join(hot.withColumn("size", size).alias("y"), ["token", "size"]).where((order("y") < order("x")) & _met("x", "y"))
        candidates = candidates.union(_pairs(rest)).distinct()
    return verified(candidates, texts, shingle).union(settled).distinct()


def removals(documents: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, line_no, similar) of the line occurrences that go; similar: because of an earlier line with another text."""
    spark = documents.sparkSession
    every = lines(documents.select("doc_id", F.col("text").cast("string").alias("text")))
    found = table(spark, every.select("doc_id", "line_no", "key", "check"), "occurrences")
    at, text = F.struct("doc_id", "line_no"), ["key", "check"]
    twice = small(table(spark, found.groupBy(*text).agg(F.count("*").alias("n")).where("n > 1").select(*text), "twice"))
    again = small(table(spark, found.join(twice, text, "left_semi").groupBy(*text).agg(F.min(at).alias("first")), "again"))
    is_first = F.col("first").isNull() | F.col("first").eqNullSafe(at)
    once = every.join(again, text, "left").where(is_first).select("key", "check", at.alias("first"), "line")
    if shingle > 1:
        once = once.join(small(suspects(once, shingle)), "key", "left_semi")
    texts = table(spark, once.dropDuplicates(text), "texts") if shingle > 1 else once  # all lines are split again, not kept
    similar = small(table(spark, near(texts, shingle).withColumn("similar", F.lit(True)), "similar"))
    decided = found.join(again, text, "left").join(similar, text, "left").withColumn("similar", F.coalesce("similar", F.lit(False)))
    return decided.where(F.col("similar") | ~is_first).select("doc_id", "line_no", "similar").distinct()


def cleaned(documents: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """The documents without those lines, every row kept; n_chars, where there is such a column, is that of the new text."""
    gone = removals(documents, shingle).groupBy(F.col("doc_id").alias("_doc")).agg(F.sort_array(F.collect_list("line_no")).alias("_gone"))
    rows = documents.select(F.struct("*").alias("_row"))
    joined = rows.join(gone, F.col("_row.doc_id").eqNullSafe(F.col("_doc")), "left")
    kept = F.array_join(F.filter(F.split(F.col("_row.text"), "\n"), lambda x, i: ~F.array_contains(F.col("_gone"), i)), "\n")
    out = joined.select("_row", "_gone", F.when(F.col("_gone").isNull(), F.col("_row.text")).otherwise(kept).alias("_text"))
    new = {"text": F.col("_text")}
    if "n_chars" in documents.columns:
        new["n_chars"] = F.when(F.col("_gone").isNull(), F.col("_row.n_chars")).otherwise(F.length("_text").cast(documents.schema["n_chars"].dataType))
    return out.select(*[new.get(c, F.col("_row").getField(c)).alias(c) for c in documents.columns])


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each document: its lines, those that go, those of them for similarity, and the numbers of the lines that go."""
    documents = read(spark, sf_dir, "documents")
    gone = removals(documents).groupBy(F.col("doc_id").alias("_doc")).agg(F.count("*").alias("n_removed"), F.count(F.when(F.col("similar"), 1)).alias("n_similar"), F.array_join(F.transform(F.sort_array(F.collect_list("line_no")), lambda x: x.cast("string")), ",").alias("removed"))
    docs = documents.select("doc_id", F.size(F.split(text_of("text"), "\n")).cast("bigint").alias("n_lines"))
    return docs.join(gone, F.col("doc_id").eqNullSafe(F.col("_doc")), "left").select("doc_id", "n_lines", F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("n_similar", F.lit(0)).alias("n_similar"), F.coalesce("removed", F.lit("")).alias("removed"))


OP1_SQL = r"""
WITH l AS (SELECT doc_id, unnest(range(0, len(x))) AS line_no, unnest(x) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents)),
w AS (SELECT doc_id, line_no, line, list_filter(regexp_split_to_array(line, '[ \t\r\f\x0b]+'), lambda x: x <> '') AS w FROM l),
o AS (SELECT doc_id, line_no, w, line AS key FROM w WHERE len(w) > 0),
f AS (SELECT key, any_value(w) AS w, min({'doc_id': doc_id, 'line_no': line_no}) AS first, count(*) AS n FROM o GROUP BY key),
t AS (SELECT DISTINCT key, token FROM (SELECT key, array_to_string(w[i:i + 4], ' ') AS token FROM (SELECT key, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM f))),
s AS (SELECT key, count(*) AS n FROM t GROUP BY key),
p AS (SELECT a.key AS x, b.key AS y, count(*) AS o FROM t a JOIN t b ON a.token = b.token AND a.key <> b.key GROUP BY 1, 2),
m AS (SELECT DISTINCT x FROM p JOIN s sx ON sx.key = x JOIN s sy ON sy.key = y JOIN f fx ON fx.key = x JOIN f fy ON fy.key = y
      WHERE 9 * o >= 4 * (sx.n + sy.n) AND fy.first < fx.first),
g AS (SELECT o.doc_id, o.line_no, m.x IS NOT NULL AS alike FROM o JOIN f USING (key) LEFT JOIN m ON m.x = o.key
      WHERE m.x IS NOT NULL OR f.first <> {'doc_id': o.doc_id, 'line_no': o.line_no}),
r AS (SELECT doc_id, count(*) AS n_removed, count(*) FILTER (WHERE alike) AS n_similar, string_agg(line_no, ',' ORDER BY line_no) AS removed FROM g GROUP BY doc_id)
SELECT d.doc_id, CAST(len(string_split(coalesce(text, ''), chr(10))) AS BIGINT) AS n_lines, coalesce(n_removed, 0) AS n_removed,
       coalesce(n_similar, 0) AS n_similar, coalesce(removed, '') AS removed
FROM documents d LEFT JOIN r ON r.doc_id IS NOT DISTINCT FROM d.doc_id
"""
