"""Nulls, empty and very long texts, ties, repeated rows, empty tables, other columns with clashing names."""

import pytest
from pyspark.sql import functions as F

from vecspark.llm import decontaminate, line_dedup, lm_score, packing, simhash, site_tree, topk, toxicity, url_filter, warc

LONG = "alpha beta gamma delta " * 40_000
DOCS = [(1, None), (2, ""), (3, "one"), (4, LONG), (5, "you idiot scum, what trash"), (5, "you idiot scum, what trash"), (None, "one two three four five six seven eight nine ten eleven"), (7, "one two three four five six seven eight nine ten eleven\nlast"), (8, " \n\n ")]
CLASH = ["h", "key", "tokens", "first", "n", "row", "label", "score", "items", "bytes", "words", "target", "fingerprint", "component_id", "_doc", "_gone", "_row", "line", "line_no", "similar", "qid", "sequence_id", "offset", "length", "toxic", "held_out", "n_words", "text_", "column_0"]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(DOCS, "doc_id bigint, text string")
    return df.select(*[F.lit(None).cast("string").alias(c) for c in CLASH[:14]], "doc_id", "text", F.length("text").cast("bigint").alias("n_chars"), *[F.lit(1).alias(c) for c in CLASH[14:]]).persist()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(3, 1, 0), (5, 0, 1), (5, None, None), (None, 1, 1), (99, 1, 1)], "doc_id bigint, quality int, toxic int")


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(10, "two three four five six seven eight nine ten eleven"), (10, "ONE"), (None, "last"), (11, None), (12, " ... "), (2, "Four FIVE six")], "item_id bigint, text string")


def test_line_dedup(docs):
    gone = sorted((r["doc_id"], r["line_no"], r["similar"]) for r in line_dedup.removals(docs).collect())
    assert gone == [(7, 0, False)]  # the row without doc_id is first
    out = line_dedup.cleaned(docs)
    assert out.schema == docs.schema and out.count() == len(DOCS)
    assert {r["doc_id"]: (r["text"], r["n_chars"]) for r in out.collect()}[7] == ("last", 4)
    assert line_dedup.cleaned(docs.limit(0)).count() == 0


def test_line_dedup_counts_rows_without_doc_id(spark, tmp_path):
    spark.createDataFrame([(None, "one two\none two"), (1, "three")], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: (r["n_removed"], r["removed"]) for r in line_dedup.op1_line_dedup(spark, str(tmp_path)).collect()}
    assert got == {None: (1, "1"), 1: (0, "")}


def test_decontamination(docs, benchmark):
    got = {(r["doc_id"], r["n_words"]): (r["n_hit"], r["items"]) for r in decontaminate.contamination(docs, benchmark).collect()}
    assert got[1, 0] == got[2, 0] == got[8, 0] == (0, []) and got[3, 1] == (1, [10])
    assert got[None, 11] == got[7, 12] == (11, [2, 10])
    out = decontaminate.decontaminate(docs, benchmark)
    assert out.columns == docs.columns and {r["doc_id"]: r["text"] for r in out.collect()}[7] == "\nlast"
    assert decontaminate.contamination(docs, benchmark.limit(0)).agg(F.sum("n_hit")).first()[0] == 0
    assert decontaminate.contamination(docs.limit(0), benchmark).count() == 0
    assert sorted(map(str, decontaminate.contamination(docs, benchmark, block_bytes=1).collect())) == sorted(map(str, decontaminate.contamination(docs, benchmark).collect()))


def test_simhash(docs):
    got = simhash.classes(docs).collect()
    assert len(got) == len(DOCS)
    zero = [r for r in got if r["fingerprint"] == 0]
    assert sorted(r["doc_id"] for r in zero) == [1, 2, 8] and {r["component_id"] for r in zero} == {1}
    kept = sorted((r["doc_id"] or 0) for r in simhash.deduplicate(docs).collect())
    assert kept.count(5) == 1 and 2 not in kept and 0 in kept and kept.count(1) == 1
    assert simhash.classes(docs.limit(0)).count() == 0 and simhash.deduplicate(docs.limit(0)).count() == 0


def test_simhash_keeps_every_text(spark):
    """Rows are decided by text, not by doc_id alone: of each class one row stays, whatever ids recur."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(1, a), (5, a), (5, b), (9, c), (None, c), (9, c), (7, b), (None, "z z z z"), (3, None), (4, "")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted(simhash.deduplicate(df).collect(), key=str)
    assert got == sorted([(1, a), (5, b), (9, c), (None, c), (None, "z z z z"), (3, None)], key=str)
    found = {(r["doc_id"], r["fingerprint"]): r["component_id"] for r in simhash.classes(df).collect()}
    assert sorted(found.values(), key=str) == sorted([1, 1, 5, 5, 9, 9, 3, 3, None], key=str)


def test_simhash_with_a_hot_text(spark):
    """Half of all rows are copies, and no join may count on a small side."""
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, "copy of one text").otherwise(F.concat(F.lit("own text "), F.sha1(F.col("id").cast("string")), F.lit(" and "), F.sha2(F.col("id").cast("string"), 256))).alias("text"))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = simhash.classes(docs).where("doc_id % 2 = 0").select("component_id").distinct().collect()
        assert [r[0] for r in got] == [0]
        html = docs.select(F.col("doc_id").alias("page_id"), F.lit("http://a.com/x").alias("url"), F.when(F.col("doc_id") % 2 == 0, F.repeat(F.lit("x"), 1000)).when(F.col("doc_id") % 5 == 0, F.concat(F.repeat(F.lit("y"), 1000), (F.col("doc_id") % 15).cast("string"))).otherwise("small").alias("html"))
        kinds = {r["page_id"]: r["refers_to"] for r in warc.decisions(html).collect()}
        assert kinds[0] == kinds[2] == 3998 and kinds[3998] is None and kinds[5] == max(i for i in range(5, 4000, 10) if i % 15 == 5) and kinds[1] is None
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_warc_of_blank_lines_and_long_pages(spark):
    stream = __import__("io").BytesIO(b"\r\n" * 100_000 + warc.record(1, "http://x/", b"p" * 3_000_000, "response", None))
    assert warc.header(stream)[1]["x-page-id"] == "1"
    df = spark.createDataFrame([(1, "http://x/", "é" * 2_000_000)], "page_id bigint, url string, html string")
    assert [r["payload_bytes"] for r in warc.read(*warc.archived(df)).collect()] == [4_000_000]


def test_line_dedup_of_very_long_lines(spark):
    """Two lines of 100,000 distinct words that differ in a few."""
    x = [f"word{i}" for i in range(100_000)]
    y = [f"other{i}" if i % 1000 == 0 else w for i, w in enumerate(x)]
    df = spark.createDataFrame([(1, " ".join(x)), (2, " ".join(y)), (3, "short line")], "doc_id bigint, text string")
    for shingle in (1, 5):
        assert [(r["doc_id"], r["line_no"], r["similar"]) for r in line_dedup.removals(df, shingle).collect()] == [(2, 0, True)]


def test_packing(docs):
    got = packing.packed(docs).collect()
    assert sum(r["length"] for r in got if r["doc_id"] == 1) == 1 and sum(1 for r in got if r["doc_id"] == 5) == 2
    assert {r["length"] for r in got if r["doc_id"] == 4 and r["piece"]} == {1024}
    assert packing.packed(docs.limit(0)).count() == 0
    assert sum(r["length"] for r in packing.sequences(docs).collect()) == sum(r["length"] for r in got)


def test_toxicity(spark, docs, labels):
    """Entries come from labels alone: without any, or with too few, no text is toxic."""
    for given in (labels, labels.limit(0)):
        model = toxicity.train(docs, given)
        got = toxicity.scored(docs, model).collect()
        assert len(got) == len(DOCS) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
        assert {r["predicted"] for r in got} == {0} and toxicity.reject(docs, model).count() == len(DOCS)
    more = [(1000 + i, f"some {'plain' if i % 2 else 'zorgish'}{i % 7} words, number {i}") for i in range(300)]
    seen = spark.createDataFrame([*DOCS, *more, (5000, "what a zorgishling"), (5000, "what a zorgishling")], "doc_id bigint, text string")
    marks = spark.createDataFrame([(i, None, 1 - i % 2) for i, _ in more] + [(None, 1, 1), (1000, None, None), (1000, None, 0)], "doc_id bigint, quality int, toxic int")
    model = toxicity.train(seen, marks)
    got = toxicity.scored(seen, model).collect()
    assert {r["predicted"] for r in got if r["doc_id"] == 5000} == {1} and sum(r["doc_id"] == 5000 for r in got) == 2
    assert {r["predicted"] for r in got if (r["doc_id"] or 0) < 1000 or r["doc_id"] % 2 and r["doc_id"] != 5000} == {0}
    kept = toxicity.reject(docs, model)
    assert kept.schema == docs.schema and toxicity.scored(docs.limit(0), model).count() == 0


def test_lm(docs, labels):
    rows = lm_score.labelled(docs, labels)
    assert [r["target"] for r in rows.where("doc_id = 3 OR doc_id = 4").orderBy("doc_id").collect()] == [True, False]
    got = {r["doc_id"]: r for r in lm_score.scored(rows, lm_score.train(rows)).collect()}
    assert got[1]["n_tokens"] == 0 and got[1]["score"] == 0.0
    none = lm_score.labelled(docs, labels.limit(0))
    assert lm_score.scored(none, lm_score.train(none)).where("score IS NULL OR isnan(score)").count() == 0
    empty = lm_score.labelled(docs.limit(0), labels)
    assert lm_score.scored(empty, lm_score.train(empty)).count() == 0


PAGES = [(1, None, None), (2, "http://a.com/x", ""), (3, "http://a.com/y", "<p>x" * 2000), (4, "nothing", "<p>x" * 2000), (4, "nothing", "<p>x" * 2000), (None, "HTTP://B.net/es/", "<p>x" * 2000), (6, "x://é.org?q#f", "plain é"), (7, "", "<a" * 100 + "<!-- open")]


@pytest.fixture(scope="module")
def pages(spark):
    df = spark.createDataFrame(PAGES, "page_id bigint, url string, html string")
    return df.select(*[F.lit(0).alias(c) for c in ("host", "low", "node", "s", "gram", "verdict", "_digest", "refers_to", "record_type")], "*").persist()


def test_warc(pages):
    got = sorted(((r["page_id"] or 0, r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.read(*warc.archived(pages)).collect()), key=str)
    assert got == sorted([(1, 0, "response", None), (2, 0, "response", None), (3, 8000, "revisit", 4), (4, 8000, "response", None), (4, 8000, "response", None), (0, 8000, "revisit", 4), (6, 8, "response", None), (7, 209, "response", None)], key=str)
    assert warc.read(*warc.archived(pages.limit(0))).count() == 0


def test_html(pages):
    got = {r["page_id"]: r["text"] for r in site_tree.extracted(pages).collect()}
    assert got[1] == got[2] == "" and got[6] == "plain é" and got[3] == "\n".join(["x"] * 2000)
    assert site_tree.extracted(pages).count() == len(PAGES) and site_tree.extracted(pages.limit(0)).count() == 0


def test_urls(pages):
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judged(pages).collect()}
    assert got[None] == ("b.net", "/es/", "net/es/", "block") and got[2] == ("a.com", "/x", "com/", "allow")
    assert got[1][:3] == ("", "", None) and got[6][:3] == ("é.org", "", None)
    assert url_filter.judged(pages).count() == len(PAGES) and url_filter.judged(pages.limit(0)).count() == 0


def test_topk(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.5]), (0, [1.0, 0.5]), (1, [1.0, 0.5]), (2, None), (3, [None, 1.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [1.0]), (7, []), (20, [-1.0, 0.0]), (None, [1.0, 1.0]), (8, [1.0, 0.5]), (40, [2.0**20, 2.0**22])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").select(F.lit(1).alias("shard"), F.lit(2).alias("kind"), "*", F.lit(3).alias("v"))
    got = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.search(df, 3).orderBy("query_id", "rank").collect()]
    assert got[:3] == [(0, 1, 40, 64 * 64 * (2**20 + 2**21)), (0, 2, 1, 64 * 64 + 32 * 32), (0, 3, 8, 64 * 64 + 32 * 32)]
    assert [g[2] for g in got if g[0] == 20] == [7, 0, 1]
    assert topk.search(df.limit(0)).count() == 0


def test_line_dedup_first_filter(spark, monkeypatch):
    """Words are counted by generated code, not by functions over arrays of shingles; lines whose tokens are their own end here."""
    line = lambda k, n: " ".join(f"w{k}x{i}" for i in range(n))
    texts = {0: line(0, 60), 1: line(0, 59) + " other", 2: line(2, 60), 3: "a b", 4: line(4, 300), 5: line(4, 299), 6: "x " * 200, 7: "c d"}
    once = spark.createDataFrame([(k, t.strip()) for k, t in texts.items()], "key bigint, line string")
    plans, write = [], line_dedup.table
    monkeypatch.setattr(line_dedup, "table", lambda spark, df, name: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or write(spark, df, name))
    got = {r["key"] for r in line_dedup.suspects(once, 5).collect()}
    assert {0, 1, 4, 5, 6} <= got and not {2, 3, 7} & got
    assert plans and not any("transform(sequence(" in p for p in plans)
