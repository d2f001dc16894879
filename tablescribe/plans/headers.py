"""Queries on column titles: alignment with header rules, the closest rule, a layout laid over pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablescribe.operators import headers
from tablescribe.plans.registry import query
from tablescribe.sources.tables import table

# Printed column titles.
TITLES = ("Category & Product Name", "Pack Size.", "Batch No.", "Qty", "Trade", "VAT", "%", "Discount Value", "Net Value", "T.P", "TP+VAT", "Exp. Date", "Mfg. Date", "Unit Price", "Code", "Invoice No", "Bonus", "Total Amount", "Quantity")


def _title(number: str) -> str:
    return f"CASE ({number}) % {len(TITLES)} " + " ".join(f"WHEN {k} THEN '{t}'" for k, t in enumerate(TITLES)) + " END"


# Inputs, the same expressions in both dialects: 25 rules of six titles each; pages that print the titles of one rule with misread
# letters, missing and misplaced titles, and the words of the part's name among them.
RULE_TITLE = _title("n_nationkey * 5 + n_nationkey % 4 * k * k + k * 7")
PAGE_RULE = "(p_partkey * 7 + p_size) % 25"
PRINTED = _title("rule * 5 + rule % 4 * k * k + k * 7")
READ = f"""CASE WHEN k > 5 THEN p_name WHEN (p_size * 3 + k) % 11 = 0 THEN NULL WHEN (p_partkey + k) % 7 = 0 THEN replace({PRINTED}, 'a', 'o') WHEN (p_partkey + k * 3) % 13 = 0 THEN replace(replace({PRINTED}, 't', 'l'), 'e', '')
 WHEN (p_partkey * 3 + k) % 17 = 0 THEN upper({PRINTED}) || ' x' WHEN {PRINTED} = '%' AND p_size % 2 = 0 THEN '0/0' ELSE {PRINTED} END"""
PLACE = "CAST(k * 100 + p_size % 7 * k - CASE WHEN p_partkey % 19 = k THEN 130 ELSE 0 END + CASE WHEN k = 6 THEN -420 ELSE 0 END AS DOUBLE)"


def title_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = table(spark, sf_dir, "nation").select("n_nationkey", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("k"))
    return each.selectExpr("n_nationkey AS rule", "k AS ci", f"{RULE_TITLE} AS label")


def title_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = table(spark, sf_dir, "part").selectExpr("*", f"{PAGE_RULE} AS rule").withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(6))))
    return each.selectExpr("p_partkey AS page", f"{PLACE} AS x", f"{READ} AS text")


_WORDS = r"""list_filter(regexp_split_to_array(regexp_replace(regexp_replace(lower(coalesce({}, '')), '\b[0o]\s*/\s*[0o6]\b|%', ' pct ', 'g'), '\b([a-z])\.\s?([a-z])\b', '\1\2', 'g'), '[^a-z0-9]+'), lambda w: w <> '')"""
_WEIGHT = "CASE WHEN length({0}) >= 4 THEN 1.0::DOUBLE WHEN length({0}) = 3 THEN 0.7::DOUBLE ELSE 0.4::DOUBLE END"
ALIGNED_SQL = f"""
rules AS (SELECT n_nationkey AS rule, k AS ci, {RULE_TITLE} AS label FROM nation, (SELECT range AS k FROM range(6))),
pages AS (SELECT p_partkey AS page, {PLACE} AS x, {READ} AS text FROM (SELECT *, {PAGE_RULE} AS rule FROM part), (SELECT range AS k FROM range(7))),
rw AS (SELECT rule, ci, generate_subscripts({_WORDS.format("label")}, 1) AS k, unnest({_WORDS.format("label")}) AS word FROM rules),
r AS (SELECT rule, row_number() OVER (PARTITION BY rule ORDER BY ci, k) AS i, ci, word, {_WEIGHT.format("word")} AS weight FROM rw),
pw AS (SELECT page, x, text, generate_subscripts({_WORDS.format("text")}, 1) AS k, unnest({_WORDS.format("text")}) AS word FROM pages),
po AS (SELECT page, x, word, text, k FROM pw QUALIFY row_number() OVER (PARTITION BY page, x, word ORDER BY text, k) = 1),
w AS (SELECT page, row_number() OVER (PARTITION BY page ORDER BY x, text, k) AS j, word, x, count(*) OVER (PARTITION BY page) AS n FROM po),
voc AS (SELECT a.word AS a, b.word AS b, levenshtein(a.word, b.word) AS d, greatest(length(a.word), length(b.word)) AS l FROM (SELECT DISTINCT word FROM w) a, (SELECT DISTINCT word FROM r) b),
sim AS (SELECT a, b, CASE WHEN a = b THEN 1.0::DOUBLE ELSE 1 - d::DOUBLE / l END AS s FROM voc WHERE a = b OR l >= 7 AND d <= 2 OR l >= 4 AND d <= 1),
v AS (SELECT page, rule, i, j, s * weight AS v FROM w JOIN sim ON w.word = a JOIN r ON r.word = b WHERE s >= 0.75 AND n >= 3),
vr AS (SELECT page, rule, i, map_from_entries(list((j, v))) AS vs FROM v GROUP BY ALL),
pr AS (SELECT DISTINCT v.page, v.rule, m, n FROM v JOIN (SELECT rule, max(i) AS m FROM r GROUP BY 1) USING (rule) JOIN (SELECT DISTINCT page, n FROM w) USING (page)),
dp(page, rule, i, m, n, best) AS (SELECT page, rule, 0::BIGINT, m, n, list_transform(range(0, n + 1), lambda k: 0.0::DOUBLE) FROM pr UNION ALL
 SELECT page, rule, i + 1, m, n, list_transform(range(1, n + 2), lambda k: list_max(list_slice(step, 1, k))) FROM
 (SELECT dp.page, dp.rule, dp.i, m, n, [0.0::DOUBLE] || list_transform(range(1, n + 1), lambda k: greatest(best[k + 1], CASE WHEN vs[k] IS NOT NULL THEN best[k] + vs[k] ELSE 0 END)) AS step
  FROM dp LEFT JOIN vr ON vr.page = dp.page AND vr.rule = dp.rule AND vr.i = dp.i + 1 WHERE dp.i < m)),
bk(page, rule, i, j, hit) AS (SELECT page, rule, m, n, NULL::DOUBLE FROM pr UNION ALL
 SELECT page, rule, CASE WHEN hit IS NOT NULL OR NOT across THEN i - 1 ELSE i END, CASE WHEN hit IS NOT NULL OR across THEN j - 1 ELSE j END, hit FROM
 (SELECT b.page, b.rule, b.i, b.j, here.best[b.j] > above.best[b.j + 1] AS across, CASE WHEN above.best[b.j] + v.v > greatest(above.best[b.j + 1], here.best[b.j]) THEN v.v END AS hit
  FROM bk b JOIN dp here ON here.page = b.page AND here.rule = b.rule AND here.i = b.i JOIN dp above ON above.page = b.page AND above.rule = b.rule AND above.i = b.i - 1
  LEFT JOIN v ON v.page = b.page AND v.rule = b.rule AND v.i = b.i AND v.j = b.j WHERE b.i > 0 AND b.j > 0)),
hits AS (SELECT bk.page, bk.rule, ci, sum(hit) AS score, avg(x) AS x FROM bk JOIN r ON r.rule = bk.rule AND r.i = bk.i + 1 JOIN w ON w.page = bk.page AND w.j = bk.j + 1 WHERE hit IS NOT NULL GROUP BY ALL),
al AS (SELECT hits.*, score >= 0.5 * weight AS found FROM hits JOIN (SELECT rule, ci, sum(weight) AS weight FROM r GROUP BY ALL) USING (rule, ci))"""


@query(f"WITH RECURSIVE {ALIGNED_SQL} SELECT page, rule, ci, found, round(x, 4) AS x, round(score, 4) AS score FROM al")
def aligned_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    aligned = headers.alignments(title_rows(spark, sf_dir), title_rules(spark, sf_dir), ["page"])
    return aligned.select("page", "rule", "ci", "found", F.round("x", 4).alias("x"), F.round("score", 4).alias("score"))


@query(f"""
WITH RECURSIVE {ALIGNED_SQL},
o AS (SELECT page, rule, coalesce(bool_and(x >= p OR p IS NULL), true) AS in_order FROM (SELECT *, lag(x) OVER (PARTITION BY page, rule ORDER BY ci) AS p FROM al WHERE found) GROUP BY ALL),
g AS (SELECT page, rule, count(*) FILTER (found) AS found, 6 AS total, sum(score) AS token_score FROM al GROUP BY ALL)
SELECT page, rule, found, total, round(token_score, 4) AS token_score, in_order, in_order AND found = total AS exact FROM g JOIN o USING (page, rule) WHERE found >= 3
QUALIFY row_number() OVER (PARTITION BY page ORDER BY found / total DESC, round(token_score, 9) DESC, rule) = 1""")
def closest_header_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = title_rules(spark, sf_dir)
    best = headers.closest_rules(headers.aligned_rules(title_rows(spark, sf_dir), rules, ["page"]), rules, ["page"])
    return best.select("page", "rule", "found", "total", F.round("token_score", 4).alias("token_score"), "in_order", "exact")


@query(None)
def layouts_over_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layouts of six columns laid over pages, whose gutters are near the boundaries, far from them, shallow or missing."""
    layouts = table(spark, sf_dir, "nation").select("n_nationkey", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("ci")).selectExpr("n_nationkey AS rule", "ci", "(ci * 10 + n_nationkey % 3 * (ci % 2) * 2) / 60.0D AS x0f", "(ci * 10 + 10 + n_nationkey % 3 * ((ci + 1) % 2) * (CASE WHEN ci < 5 THEN 2 ELSE 0 END)) / 60.0D AS x1f")
    parts = table(spark, sf_dir, "part")
    pages = parts.selectExpr("p_partkey AS page", f"{PAGE_RULE} AS rule", "CAST(p_size * 3 AS DOUBLE) AS x0", "p_size * 3 + 600 + p_retailprice / 10 AS x1", "10.0D AS glyph")
    each = parts.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(6)))).where("(p_partkey + k) % 5 > 0")
    gutters = each.selectExpr("p_partkey AS page", "p_size * 3 + k * 117.0D + (p_partkey * k) % 61 - 30 AS lo", "(p_size + k) % 4 = 0 AS shallow").selectExpr("page", "lo", "lo + 9 AS hi", "shallow")
    return headers.layout_over_pages(layouts, pages, gutters, "rule", "page")
