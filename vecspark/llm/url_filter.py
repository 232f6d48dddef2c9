"""URL filter: host rules, and a character language-model ratio for urls that no rule fits.

Accepted and rejected urls are those that the rules allow and block. Characters are folded to 32 symbols (letters, one
for digits, '/', '.', '-', one for others, start and end). Each class has a variable-order Markov model: of a symbol the
longest context of three symbols at most is used that both classes together show at least LEAST times, smoothed by MU
pseudo-counts of the next shorter one, down to the uniform distribution. A url's score is the mean log-likelihood
difference a symbol; it is allowed from the threshold where the two classes' scores, by mean and spread, are equally far.

All of it is DataFrame operations. Urls are pre-aggregated to distinct folded texts before anything is exploded, and the
model is a table of the n-grams that occur: at most 32**4 rows, broadcast on that proven bound.

Defined cases: a null url, or one without '://', has empty host and path, fits no rule and is scored as the empty text;
repeated rows and page_ids are judged alike; without urls of both classes, every url that no rule fits is allowed; an
empty table gives no rows; other columns don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vecspark.llm.common import read, table

#: (verdict, host, path); the longest that fits wins.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
ORDER = 4
SYMBOLS = 32
LEAST = 20
MU = 4.0
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path."""
    url = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(url, _URL, 1), _UPPER, _LOWER), F.regexp_extract(url, _URL, 2)


def _fits(rule: tuple[str, str, str], host: Column, path: Column) -> Column:
    return ((host == rule[1]) | host.endswith(f".{rule[1]}")) & path.startswith(rule[2])


def rule_of(host: Column, path: Column, rules: tuple = RULES) -> tuple[Column, Column]:
    """The rule that fits, as text, and its verdict; nulls if none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = _fits(r, host, path)
        name, verdict = F.when(fits, r[1] + r[2]).otherwise(name), F.when(fits, r[0]).otherwise(verdict)
    return name, verdict


def folded(host: Column, path: Column) -> Column:
    """Symbols of a url: three starts, the folded text, one end."""
    text = F.translate(F.concat(host, path), _UPPER, _LOWER)
    text = F.regexp_replace(F.regexp_replace(text, "[0-9]", "0"), "[^a-z0/.-]", "_")
    return F.concat(F.lit("^" * (ORDER - 1)), text, F.lit("$"))


def _grams(texts: DataFrame) -> DataFrame:
    """texts (s, allow, block) -> a row for each symbol: s, allow, block and the n-gram that ends there."""
    return texts.select("s", "allow", "block", F.explode(F.sequence(F.lit(1), F.length("s") - (ORDER - 1))).alias("i")).select("s", "allow", "block", F.substring(F.col("s"), F.col("i"), ORDER).alias("gram"))


def model(texts: DataFrame, least: int = LEAST, mu: float = MU) -> DataFrame:
    """(gram, llr): for each n-gram that occurs, the log ratio of its last symbol's probabilities; 32**4 rows at most."""
    spark = texts.sparkSession
    counts = table(spark, _grams(texts).groupBy("gram").agg(F.sum("allow").alias("a3"), F.sum("block").alias("b3")), "grams")
    out = counts.select("gram", F.lit(1.0 / SYMBOLS).alias("pa"), F.lit(1.0 / SYMBOLS).alias("pb"))
    for k in range(ORDER):
        tail, context = F.substring(F.col("gram"), ORDER - k, k + 1), F.substring(F.col("gram"), ORDER - k, k)
        # what both classes show of the n-gram's last k + 1 symbols, and of the first k of them
        own = counts.groupBy(tail.alias("_tail")).agg(F.sum("a3").alias("_na"), F.sum("b3").alias("_nb"))
        base = counts.groupBy(context.alias("_context")).agg(F.sum("a3").alias("_ca"), F.sum("b3").alias("_cb"))
        out = out.withColumn("_tail", tail).withColumn("_context", context).join(own, "_tail").join(base, "_context")
        seen = F.col("_ca") + F.col("_cb") >= least

        def smoothed(n: str, c: str, p: str, seen: Column = seen) -> Column:
            return F.when(seen, (F.col(n) + mu * F.col(p)) / (F.col(c) + mu)).otherwise(F.col(p))

        out = out.select("gram", smoothed("_na", "_ca", "pa").alias("pa"), smoothed("_nb", "_cb", "pb").alias("pb"))
    return out.select("gram", (F.log("pa") - F.log("pb")).alias("llr"))


def scored(texts: DataFrame, ratios: DataFrame) -> DataFrame:
    """(s, allow, block, score): the mean log ratio a symbol."""
    return _grams(texts).join(F.broadcast(ratios), "gram").groupBy("s", "allow", "block").agg(F.avg("llr").alias("score"))


def threshold(scores: DataFrame) -> float | None:
    """Where the classes' scores are equally many spreads away; None without both classes."""
    n = {}
    stats = []
    for c in ("allow", "block"):
        w = F.col(c)
        stats += [F.sum(w).alias(f"n_{c}"), (F.sum(w * F.col("score")) / F.nullif(F.sum(w), F.lit(0))).alias(f"m_{c}"), (F.sum(w * F.col("score") * F.col("score")) / F.nullif(F.sum(w), F.lit(0))).alias(f"q_{c}")]
    n = scores.agg(*stats).first()
    if not n["n_allow"] or not n["n_block"]:
        return None
    spread = {c: max(n[f"q_{c}"] - n[f"m_{c}"] ** 2, 0.0) ** 0.5 for c in ("allow", "block")}
    if not sum(spread.values()):
        return (n["m_allow"] + n["m_block"]) / 2
    return (n["m_allow"] * spread["block"] + n["m_block"] * spread["allow"]) / sum(spread.values())


def judged(pages: DataFrame, rules: tuple = RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, score); score is null where a rule decides."""
    spark = pages.sparkSession
    host, path = split_url(F.col("url").cast("string"))
    rows = pages.select(F.col("page_id"), host.alias("host"), path.alias("path"))
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.select("page_id", "host", "path", name.alias("rule"), verdict.alias("_verdict"), folded(F.col("host"), F.col("path")).alias("s"))
    one = [F.sum((F.col("_verdict").eqNullSafe(c)).cast("bigint")).alias(c) for c in ("allow", "block")]
    texts = table(spark, rows.groupBy("s").agg(*one, F.max(F.col("rule").isNull()).alias("open")), "urls")
    ratios = table(spark, model(texts), "ratios")
    scores = table(spark, scored(texts, ratios), "scores")
    limit = threshold(scores)
    found = scores.join(texts.where("open").select("s"), "s", "left_semi").select(F.col("s").alias("_s"), "score")
    open_rows = rows.where("rule IS NULL")
    method = F.when(F.col("score") >= F.lit(limit), "allow").otherwise("block") if limit is not None else F.lit("allow")
    decided = rows.where("rule IS NOT NULL").select("page_id", "host", "path", "rule", F.col("_verdict").alias("verdict"), F.lit(None).cast("double").alias("score"))
    return decided.union(open_rows.join(found, open_rows["s"] == found["_s"]).select("page_id", "host", "path", "rule", method.alias("verdict"), "score"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page's rule and verdict."""
    return judged(read(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def _sql() -> str:
    fits = {r: f"((host = '{r[1]}' OR ends_with(host, '.{r[1]}')) AND starts_with(path, '{r[2]}'))" for r in RULES}
    longest = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    rule = "CASE " + " ".join(f"WHEN {fits[r]} THEN '{r[1]}{r[2]}'" for r in longest) + " END"
    verdict = "CASE " + " ".join(f"WHEN {fits[r]} THEN '{r[0]}'" for r in longest) + " END"
    steps, last = [], "SELECT gram, 1.0::DOUBLE / 32 AS pa, 1.0::DOUBLE / 32 AS pb FROM g"
    for k in range(ORDER):
        steps += [f"o{k} AS (SELECT substring(gram, {ORDER - k}, {k + 1}) AS t, sum(a) AS na, sum(b) AS nb FROM g GROUP BY 1)", f"c{k} AS (SELECT substring(gram, {ORDER - k}, {k}) AS t, sum(a) AS ca, sum(b) AS cb FROM g GROUP BY 1)"]
        steps.append(f"p{k} AS (SELECT gram, CASE WHEN ca + cb >= {LEAST} THEN (na + {MU}::DOUBLE * pa) / (ca + {MU}::DOUBLE) ELSE pa END AS pa, CASE WHEN ca + cb >= {LEAST} THEN (nb + {MU}::DOUBLE * pb) / (cb + {MU}::DOUBLE) ELSE pb END AS pb FROM ({last}) x JOIN o{k} ON o{k}.t = substring(gram, {ORDER - k}, {k + 1}) JOIN c{k} ON c{k}.t = substring(gram, {ORDER - k}, {k}))")
        last = f"SELECT * FROM p{k}"
    return rf"""
WITH u AS (SELECT page_id, translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), '{_UPPER}', '{_LOWER}') AS host,
                  regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path FROM (SELECT page_id, coalesce(url, '') AS url FROM pages)),
r AS (SELECT *, {rule} AS rule, {verdict} AS v,
             '^^^' || regexp_replace(regexp_replace(translate(host || path, '{_UPPER}', '{_LOWER}'), '[0-9]', '0', 'g'), '[^a-z0/.-]', '_', 'g') || '$' AS s FROM u),
t AS (SELECT s, sum((v IS NOT DISTINCT FROM 'allow')::INT)::DOUBLE AS a, sum((v IS NOT DISTINCT FROM 'block')::INT)::DOUBLE AS b FROM r GROUP BY s),
e AS (SELECT s, a, b, substring(s, i, {ORDER}) AS gram FROM (SELECT s, a, b, unnest(range(1, len(s) - {ORDER - 1} + 1)) AS i FROM t)),
g AS (SELECT gram, sum(a) AS a, sum(b) AS b FROM e GROUP BY gram),
{", ".join(steps)},
m AS (SELECT gram, ln(pa) - ln(pb) AS llr FROM p{ORDER - 1}),
sc AS (SELECT s, a, b, avg(llr) AS score FROM e JOIN m USING (gram) GROUP BY s, a, b),
st AS (SELECT sum(a) AS na, sum(b) AS nb, sum(a * score) / sum(a) AS ma, sum(b * score) / sum(b) AS mb,
              sqrt(greatest(sum(a * score * score) / sum(a) - (sum(a * score) / sum(a)) ** 2, 0)) AS sa,
              sqrt(greatest(sum(b * score * score) / sum(b) - (sum(b * score) / sum(b)) ** 2, 0)) AS sb FROM sc),
th AS (SELECT CASE WHEN na > 0 AND nb > 0 THEN CASE WHEN sa + sb > 0 THEN (ma * sb + mb * sa) / (sa + sb) ELSE (ma + mb) / 2 END END AS lim FROM st)
SELECT page_id, host, path, rule, CASE WHEN rule IS NOT NULL THEN v WHEN lim IS NULL OR score >= lim THEN 'allow' ELSE 'block' END AS verdict
FROM r JOIN sc USING (s) CROSS JOIN th
"""


OP8_SQL = _sql()
