"""Queries on fixed-weight scores, on numbers between 0 and 1 made of the columns of part."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablescribe.functions import scores
from tablescribe.operators.roles import columns_of
from tablescribe.plans.registry import pattern_sql as _sql
from tablescribe.plans.registry import query
from tablescribe.sources.tables import table

UNIT = "p_partkey, p_size / 50.0D AS a, p_partkey % 11 / 10.0D AS b, p_partkey % 7 / 6.0D AS c, p_size % 9 / 8.0D AS d, p_partkey % 13 / 40.0D AS e, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_size % 4 / 3.0D END AS f"
UNIT_SQL = f"(SELECT {UNIT.replace('0D', '0::DOUBLE')} FROM part)".replace("6.0D", "6.0::DOUBLE").replace("8.0D", "8.0::DOUBLE").replace("3.0D", "3.0::DOUBLE")


def _units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr(*columns_of(UNIT))


@query(f"""
SELECT p_partkey, round((0.25 * a + 0.25 * b + 0.2 * c + 0.2 * d + 0.1 * least(1, 1.4 * a)) * (1 - least(1, 2.5 * e)) * (1 - least(0.6, 0.6 * b)), 9) AS hypothesis,
 round(0.3 * a + 0.25 * coalesce(greatest(0, 1 - 2.5 * e / nullif(b, 0)), 0) + 0.25 * c + 0.2 * d, 9) AS borderless,
 round((0.28 * a + coalesce(0.14 * f, 0) + 0.18 * CASE WHEN p_partkey % 3 = 0 THEN 0.85 WHEN p_partkey % 2 = 0 THEN 0.6 ELSE 0.5 END + 0.16 * CASE WHEN p_partkey % 4 = 0 THEN 0.35 ELSE 0.85 END + CASE WHEN f IS NULL THEN 0 WHEN f > 0.5 THEN 0.24 * 0.95 ELSE 0.24 * 0.15 END)
  / (0.28 + 0.18 + 0.16 + CASE WHEN f IS NULL THEN 0 ELSE 0.14 + 0.24 END), 9) AS cell,
 round(0.25 * a + 0.25 * b + 0.2 * c + 0.15 * d + 0.15 * e, 9) AS merge, round(0.45 * a + 0.35 * (2 * least(1 + b, 1 + c) / (2 + b + c)) + 0.2 * least(1, p_partkey % 9 / 5), 9) AS edge FROM {UNIT_SQL}""")
def evidence_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b, c, d, e, f = (F.col(x) for x in "abcdef")
    key = F.col("p_partkey")
    role = F.when(key % 4 != 0, "QTY")
    made = {
        "hypothesis": scores.hypothesis(a, b, c, d, a, e, b), "borderless": scores.borderless(a, e, F.nullif(b, F.lit(0.0)), c, d), "cell": scores.fused_cell(a, f, key % 3 == 0, key % 2 == 0, role, f > 0.5),
        "merge": scores.merge_confidence([a, b, c, d, e]), "edge": scores.edge_score(a, 1 + b, 1 + c, key % 9),
    }
    return _units(spark, sf_dir).select("p_partkey", *[F.round(v, 9).alias(k) for k, v in made.items()])


@query(f"""
WITH s AS (SELECT *, (0.8 + a / 5) * (0.9 + b / 10) * CASE WHEN p_partkey % 17 = 0 THEN 0.5 ELSE 1.0 END AS s FROM {UNIT_SQL}), m AS (SELECT *, CASE WHEN p_partkey % 3 = 0 THEN least(1, s + 0.03) ELSE s END AS s1 FROM s), p AS (SELECT *, CASE WHEN p_partkey % 4 = 0 THEN least(1, s1 + 0.05) ELSE s1 END AS s2 FROM m),
k AS (SELECT *, CASE WHEN p_partkey % 5 = 0 THEN least(1, s2 + 0.03) ELSE s2 END AS s3 FROM p), t AS (SELECT *, CASE WHEN p_partkey % 6 = 0 THEN least(1, s3 + 0.02) ELSE s3 END AS s4 FROM k)
SELECT p_partkey, round(s4, 6) AS score, CASE WHEN round(s4, 6) >= 0.85 AND p_partkey % 7 <> 0 THEN 'match' WHEN round(s4, 6) >= 0.6 THEN 'uncertain' ELSE 'none' END AS status FROM t""")
def product_match_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    score = F.round(scores.match_score([0.8 + F.col("a") / 5, 0.9 + F.col("b") / 10], key % 17 == 0, key % 3 == 0, key % 4 == 0, key % 5 == 0, key % 6 == 0), 6)
    return _units(spark, sf_dir).select("p_partkey", score.alias("score"), scores.match_status(score, key % 7 == 0).alias("status"))


PRICES = "p_partkey, p_retailprice AS paid, CASE WHEN p_partkey % 6 = 0 THEN NULL ELSE p_retailprice * (90 + p_size) / 1000 END AS bought, CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_retailprice / 10 END AS trade, CASE WHEN p_size % 3 = 0 THEN NULL ELSE 10.0D END AS units, CASE WHEN p_size % 4 = 0 THEN p_size / 2.0D END AS own"


@query(f"""
WITH p AS (SELECT {PRICES.replace("0D", "0::DOUBLE")} FROM part), l AS (SELECT p_partkey, paid, unnest([bought * own, trade * own, bought, bought * coalesce(units, 1), trade, trade * coalesce(units, 1)]) AS v, unnest(range(6)) AS i FROM p),
d AS (SELECT *, round(abs(paid - v) / greatest(v, 0.01), 9) AS rel, i - count(*) FILTER (NOT coalesce(v > 0, false)) OVER (PARTITION BY p_partkey ORDER BY i) AS place FROM l), b AS (SELECT * FROM d WHERE v > 0 QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY rel, i) = 1)
SELECT p.p_partkey, round(b.rel, 3) AS rel, round(b.v, 6) AS nearest, b.rel > 0.02 AS differs, round((p.trade * coalesce(p.units, 1) - p.paid) / p.paid * 100, 6) + 0 AS profit FROM p LEFT JOIN b ON b.p_partkey = p.p_partkey""")
def price_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").selectExpr(*columns_of(PRICES))
    near = scores.nearest_price(F.col("paid"), F.col("bought"), F.col("trade"), F.col("units"), F.col("own"))
    return rows.select("p_partkey", near.alias("n"), F.round(scores.pack_profit(F.col("trade"), F.col("units"), F.col("paid")), 6).alias("profit")).select("p_partkey", "n.rel", F.round("n.nearest", 6).alias("nearest"), "n.differs", "profit")


HEADER = "CASE o_orderkey % 6 WHEN 0 THEN 'TAX INVOICE' WHEN 1 THEN 'Proforma Invoice' WHEN 2 THEN 'Credit Note for invoice' WHEN 3 THEN 'Invoice No: INV-' || o_custkey WHEN 4 THEN NULL ELSE 'Bill no # ' || o_orderkey END"
NUMBER_PATTERNS = (r"(?i)invoice\s*(?:no|number|#)\s*[:.\-]?\s*([A-Z0-9\-/]{2,})", r"(?i)bill\s*no\s*[:.\-#]?\s*([A-Z0-9\-/]{2,})")


@query(f"""
WITH h AS (SELECT o_custkey, o_orderkey, {HEADER} AS h FROM orders), m AS (SELECT *, 0 AS k, regexp_extract(h, {_sql(NUMBER_PATTERNS[0])}, 1) AS v FROM h UNION ALL SELECT *, 1, regexp_extract(h, {_sql(NUMBER_PATTERNS[1])}, 1) FROM h),
f AS (SELECT o_custkey, trim(v) AS number FROM m WHERE v <> '' QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey, k) = 1), t AS (SELECT o_custkey, lower(string_agg(h, ' ')) AS h FROM h GROUP BY 1)
SELECT t.o_custkey, CASE WHEN contains(t.h, 'credit note') THEN 'CREDIT_NOTE' WHEN contains(t.h, 'proforma') THEN 'PROFORMA' WHEN contains(t.h, 'tax invoice') THEN 'TAX_INVOICE' WHEN contains(t.h, 'invoice') THEN 'INVOICE' ELSE 'UNKNOWN' END AS type, number FROM t LEFT JOIN f USING (o_custkey)""")
def document_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tablescribe.operators.tables import first_match

    lines = table(spark, sf_dir, "orders").selectExpr("o_custkey", "o_orderkey", f"{HEADER} AS h")
    kinds = lines.groupBy("o_custkey").agg(F.concat_ws(" ", F.collect_set("h")).alias("h"))
    return kinds.select("o_custkey", scores.document_type(F.col("h")).alias("type")).join(first_match(lines, ["o_custkey"], "o_orderkey", "h", NUMBER_PATTERNS).withColumnRenamed("value", "number"), "o_custkey", "left")


@query("""
SELECT p_partkey, p_size > 1 AND p_retailprice > 905 AND (p_size - 1) / (p_retailprice - 905) BETWEEN 0.05 AND 20 AS kept FROM part""")
def sane_aspects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", scores.sane_aspect(F.col("p_size") - 1, F.col("p_retailprice") - 905).alias("kept"))


@query("""
WITH p AS (SELECT l_suppkey AS page, l_partkey % 60 AS x, l_linenumber AS y, min(CAST(floor(l_quantity / 5) AS BIGINT)) AS label FROM lineitem GROUP BY 1, 2, 3),
e AS (SELECT a.page, least(a.label, b.label) AS a, greatest(a.label, b.label) AS b FROM p a JOIN p b ON a.page = b.page AND a.label <> b.label AND (b.x = a.x + 1 AND b.y = a.y OR b.x = a.x AND b.y = a.y + 1)) SELECT page, a, b, count(*) AS shared FROM e GROUP BY 1, 2, 3""")
def neighbour_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tablescribe.operators.graph import neighbour_edges as edges

    points = table(spark, sf_dir, "lineitem").selectExpr("l_suppkey AS page", "l_partkey % 60 AS x", "l_linenumber AS y", "CAST(floor(l_quantity / 5) AS BIGINT) AS label")
    return edges(points.groupBy("page", "x", "y").agg(F.min("label").alias("label")), ["page"], "label")
