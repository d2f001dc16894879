"""Queries on numbers in printed tables: lenient parsing, misreads, roles, identities between columns, product triples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablescribe.functions import amounts
from tablescribe.operators import numcheck, roles
from tablescribe.plans.registry import query
from tablescribe.sources.tables import table

READ = """CASE p_partkey % 16 WHEN 0 THEN '1 ' || p_size || '.42' WHEN 1 THEN '13.O' || (p_size % 10) WHEN 2 THEN p_size || '.7B' WHEN 3 THEN '9O0.00' WHEN 4 THEN 'Z' WHEN 5 THEN '1,2' || (10 + p_size % 90) || '.44' WHEN 6 THEN p_size || ',5'
 WHEN 7 THEN p_size || '%' WHEN 8 THEN '337..2' || (p_size % 10) WHEN 9 THEN p_size || '.' WHEN 10 THEN '-' || p_size WHEN 11 THEN p_name WHEN 12 THEN '' WHEN 13 THEN NULL WHEN 14 THEN '2;' ELSE CAST(p_retailprice AS STRING) END"""


@query(f"""
WITH t AS (SELECT p_partkey, trim({READ}) AS raw FROM part), p AS (SELECT *, replace(raw, '%', '') AS t FROM t),
f AS (SELECT *, translate(t, 'OolI|SBZ', '00111582') AS fixed, length(regexp_replace(t, '[^A-Za-z]', '', 'g')) AS letters, length(regexp_replace(t, '[^0-9]', '', 'g')) AS digits FROM p),
b AS (SELECT *, regexp_replace(fixed, '[^0-9.,+\\-]', '', 'g') AS bare FROM f),
q AS (SELECT *, CASE WHEN regexp_matches(bare, '^-?\\d{{1,3}}(,\\d{{3}})+(\\.\\d+)?$') THEN replace(bare, ',', '') WHEN regexp_matches(bare, '^-?\\d+,\\d{{1,2}}$') THEN replace(bare, ',', '.') ELSE replace(bare, ',', '') END AS q FROM b),
n AS (SELECT *, rtrim(CASE WHEN q LIKE '%.%' THEN replace(left(q, length(q) - strpos(reverse(q), '.')), '.', '') || '.' || right(q, strpos(reverse(q), '.') - 1) ELSE q END, '.') AS norm FROM q)
SELECT p_partkey, CASE WHEN ok THEN norm::DOUBLE END AS value, CASE WHEN ok THEN regexp_matches(raw, '%\\s*$') END AS percent, CASE WHEN ok THEN fixed = t AND NOT regexp_matches(t, '[^0-9.,+\\-]') AND t NOT LIKE '%.' END AS clean, CASE WHEN ok THEN norm END AS norm
FROM (SELECT *, raw <> '' AND NOT (letters > 2 OR letters > 0 AND letters >= digits) AND regexp_matches(norm, '^[-+]?(\\d+(\\.\\d*)?|\\.\\d+)$') AS ok FROM n)""")
def lenient_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr("p_partkey", f"{READ} AS t").select("p_partkey", amounts.lenient_number(F.col("t")).alias("n")).select("p_partkey", "n.*")


MISREAD = "CASE p_partkey % 6 WHEN 0 THEN CAST(p_size AS STRING) || '.50' WHEN 1 THEN '1' || p_size || '.5' WHEN 2 THEN CAST(p_size + 1 AS STRING) WHEN 3 THEN p_size || '5.0' WHEN 4 THEN '' ELSE '12345.67' END"
FIXED_SQL = "CASE WHEN d = 0 THEN CAST(CAST(round({v}) AS BIGINT) AS VARCHAR) ELSE printf('%.' || d || 'f', {v}) END"


@query(f"""
WITH t AS (SELECT p_partkey, p_size + 0.5::DOUBLE AS v, {MISREAD} AS t FROM part UNION ALL SELECT p_partkey + 1000000, p_size::DOUBLE, {MISREAD} FROM part),
d AS (SELECT *, CASE WHEN regexp_matches(t, '\\.\\d+\\s*%?$') THEN length(regexp_extract(t, '\\.(\\d+)\\s*%?$', 1)) WHEN v = floor(v) THEN 0 ELSE 2 END AS d FROM t),
l AS (SELECT *, CASE d WHEN 0 THEN printf('%.0f', v) WHEN 1 THEN printf('%.1f', v) ELSE printf('%.2f', v) END AS likeness FROM d),
m AS (SELECT *, regexp_replace(t, '[^0-9]', '', 'g') AS a, regexp_replace(likeness, '[^0-9]', '', 'g') AS b, rtrim(regexp_replace(printf('%.2f', v), '[^0-9]', '', 'g'), '0') AS b2 FROM l)
SELECT p_partkey, likeness, a <> '' AND (rtrim(a, '0') = b2 AND b2 <> '' OR levenshtein(a, b) <= 1 OR length(a) >= 5 AND levenshtein(a, b) <= 2) AS plausible FROM m""")
def plausible_misreads(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    both = part.selectExpr("p_partkey", "p_size + 0.5D AS v", f"{MISREAD} AS t").unionAll(part.selectExpr("p_partkey + 1000000", "CAST(p_size AS DOUBLE)", f"{MISREAD}"))
    return both.select("p_partkey", amounts.format_like(F.col("v"), F.col("t")).alias("likeness"), amounts.plausible_misread(F.col("v"), F.col("t")).alias("plausible"))


COLUMN_LABEL = """CASE p_partkey % 19 WHEN 0 THEN 'Inv. Qty' WHEN 1 THEN 'Batch Qty' WHEN 2 THEN 'Bonus' WHEN 3 THEN 'MRP' WHEN 4 THEN 'Net Payable' WHEN 5 THEN 'Disc %' WHEN 6 THEN 'Discount' WHEN 7 THEN 'TP plus VAT' WHEN 8 THEN 'VAT %' WHEN 9 THEN 'Total VAT'
 WHEN 10 THEN 'VAT' WHEN 11 THEN 'SP Value' WHEN 12 THEN 'SP' WHEN 13 THEN 'Trade Price' WHEN 14 THEN 'TP Value' WHEN 15 THEN 'Total Amount' WHEN 16 THEN NULL WHEN 17 THEN 'Gross' ELSE p_name END"""


@query(f"""
WITH t AS (SELECT p_partkey, trim(regexp_replace(replace(lower(coalesce({COLUMN_LABEL}, '')), '%', ' pct '), '[^a-z0-9]+', ' ', 'g')) AS t FROM part),
m AS (SELECT *, regexp_matches(t, '\\b(total|value|amount|amt)\\b') AS money FROM t)
SELECT p_partkey, CASE WHEN regexp_matches(t, '\\b(qty|quantity|inv qty|invoice qty)\\b') AND NOT regexp_matches(t, '\\b(bonus|free|batch|btch)\\b') THEN 'qty' WHEN regexp_matches(t, '\\b(bonus|free|bq|bon us)\\b') THEN 'bonus' WHEN regexp_matches(t, '\\bmrp\\b') THEN 'mrp'
 WHEN regexp_matches(t, '\\b(net|payable|grand)\\b') THEN 'net' WHEN regexp_matches(t, '\\b(disc|discount|dis)\\b') THEN CASE WHEN regexp_matches(t, '\\bpct\\b') THEN 'discPct' ELSE 'disc?' END
 WHEN regexp_matches(t, '\\bvat\\b') AND regexp_matches(t, '\\b(tp|trade|price)\\b') AND regexp_matches(t, 'plus|per pack') OR regexp_matches(t, '\\bgross\\b') THEN 'unitGross'
 WHEN regexp_matches(t, '\\bvat\\b') THEN CASE WHEN regexp_matches(t, '\\bpct\\b') THEN 'vatPct' WHEN money THEN 'totalVat' ELSE 'vat?' END WHEN regexp_matches(t, '\\bsp\\b') THEN CASE WHEN money THEN 'totalSp' ELSE 'unitSp' END
 WHEN regexp_matches(t, '\\b(tp|trade|t price|tprice|price|rate)\\b') THEN CASE WHEN money THEN 'totalTp' ELSE 'unitTp' END WHEN money AND regexp_matches(t, '\\btotal\\b') THEN 'net' END AS role FROM m""")
def roles_of_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr("p_partkey", f"{COLUMN_LABEL} AS t").select("p_partkey", amounts.role_of_label(F.col("t")).alias("role"))


ROLES = """l_suppkey, l_orderkey, l_linenumber, CASE WHEN l_linenumber = 6 THEN NULL ELSE l_quantity END AS qty, round(l_extendedprice / l_quantity, 2) AS unitTp, CASE WHEN l_linenumber = 5 THEN NULL ELSE round(l_extendedprice, 2) END AS totalTp,
 round(l_discount * 100, 2) AS discPct, CASE WHEN l_linenumber = 4 THEN NULL ELSE round(l_extendedprice * l_discount, 2) END AS discAmt,
 CASE WHEN l_linenumber = 3 AND l_partkey % 2 = 0 THEN NULL WHEN l_suppkey % 3 = 0 THEN round(l_extendedprice, 2) ELSE round(l_extendedprice - l_extendedprice * l_discount, 2) END AS net"""
PRESENT = ("qty", "unitTp", "totalTp", "discPct", "discAmt", "net")
TOLERANCE_SQL = "0.0151 + 0.0051 * {q} + 0.0006 * abs({t})"
RELATION_SQL = {
    "ttp": ("qty * unitTp", "totalTp", "CASE WHEN qty <> 0 THEN abs(qty) ELSE 1 END", ""), "discA": ("totalTp * discPct / 100", "discAmt", "1", "disc"), "net3": ("totalTp - discAmt", "net", "1", "net"),
}
STATS_SQL = "WITH l AS (SELECT " + ROLES + " FROM lineitem)" + " UNION ALL ".join(
    f" SELECT l_suppkey, '{k}' AS relation, count({made} + {target}) AS tested, count(*) FILTER (abs(({made}) - {target}) <= {TOLERANCE_SQL.format(q=q, t=f'({made})')}) AS held FROM l GROUP BY 1" for k, (made, target, q, _) in RELATION_SQL.items()
)


@query(f"SELECT *, tested = 0 OR held / tested >= 0.5 AS chosen FROM ({STATS_SQL})")
def number_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").selectExpr(*roles.columns_of(ROLES))
    return numcheck.relation_stats(rows, ["l_suppkey"], PRESENT)


@query(None)
def number_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blanks filled and misreads fixed by the identities that each supplier's lines follow; tests hold it against brute force."""
    rows = table(spark, sf_dir, "lineitem").selectExpr(*roles.columns_of(ROLES))
    return numcheck.repair(rows, ["l_suppkey"], PRESENT)


GRID = ["l_quantity", "round(l_extendedprice / l_quantity, 2)", "l_extendedprice", "l_tax * 100", "l_quantity * 2"]


@query(f"""
WITH g AS (SELECT l_suppkey, l_orderkey, l_linenumber, [{", ".join(f"({c})::DOUBLE" for c in GRID)}] AS v FROM lineitem),
t AS (SELECT q, p, a FROM (SELECT range::INT AS q FROM range(5)), (SELECT range::INT AS p FROM range(5)), (SELECT range::INT AS a FROM range(5)) WHERE q <> p AND a > q AND a > p),
h AS (SELECT l_suppkey, q, p, a, count(*) AS usable, count(*) FILTER (abs(v[q + 1] * v[p + 1] - v[a + 1]) / greatest(abs(v[a + 1]), abs(v[q + 1] * v[p + 1]), 1e-6) <= 0.02) AS hits FROM g, t GROUP BY ALL),
w AS (SELECT l_suppkey, c, avg(CASE WHEN v[c + 1] = floor(v[c + 1]) THEN 1.0 ELSE 0.0 END) AS whole FROM g, (SELECT range::INT AS c FROM range(5)) GROUP BY ALL),
b AS (SELECT *, hits / usable AS ratio FROM h WHERE usable >= 2 QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY hits / usable DESC, a DESC, q, p) = 1)
SELECT b.l_suppkey, CASE WHEN ratio > 0 AND wp.whole > wq.whole + 0.25 THEN b.p ELSE b.q END AS qty, CASE WHEN ratio > 0 AND wp.whole > wq.whole + 0.25 THEN b.q ELSE b.p END AS price, b.a AS amount, round(ratio, 6) AS ratio, usable
FROM b JOIN w wq ON wq.l_suppkey = b.l_suppkey AND wq.c = b.q JOIN w wp ON wp.l_suppkey = b.l_suppkey AND wp.c = b.p""")
def product_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", F.array(*[F.expr(c).cast("double") for c in GRID]).alias("v"))
    return roles.product_triples(rows, ["l_suppkey"], "v", len(GRID))


@query("""
SELECT l_orderkey, l_linenumber, CAST(max(CASE WHEN role = 'QTY' THEN value END) AS DOUBLE) AS qty, CAST(max(CASE WHEN role = 'UNIT_PRICE' THEN value END) AS DOUBLE) AS unit_price, CAST(max(CASE WHEN role = 'AMOUNT' THEN value END) AS DOUBLE) AS amount FROM (
 SELECT l_orderkey, l_linenumber, 'QTY' AS role, l_quantity AS value FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber, 'AMOUNT', l_extendedprice FROM lineitem WHERE l_linenumber <> 2 UNION ALL SELECT l_orderkey, l_linenumber, 'UNKNOWN', l_tax FROM lineitem) GROUP BY 1, 2""")
def line_items_by_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    cells = lines.select("l_orderkey", "l_linenumber", F.explode(F.array(F.struct(F.lit("QTY").alias("role"), F.col("l_quantity").alias("value")), F.when(F.col("l_linenumber") != 2, F.struct(F.lit("AMOUNT").alias("role"), F.col("l_extendedprice").alias("value"))), F.struct(F.lit("UNKNOWN").alias("role"), F.col("l_tax").alias("value")))).alias("c")).where("c is not null").select("l_orderkey", "l_linenumber", "c.*")
    return roles.pivot_roles(cells, ["l_orderkey", "l_linenumber"], "role", "value", {"qty": "QTY", "unit_price": "UNIT_PRICE", "amount": "AMOUNT"})


@query("""
WITH c AS (SELECT p_brand, p_partkey % 7 AS col, CASE p_partkey % 7 WHEN 0 THEN 'SL' WHEN 1 THEN 'QTY' WHEN 2 THEN 'QTY' WHEN 3 THEN 'AMOUNT' WHEN 4 THEN 'AMOUNT' WHEN 5 THEN 'AMOUNT' ELSE 'DESCRIPTION' END AS role, max(p_size) / 100.0::DOUBLE AS confidence FROM part GROUP BY ALL)
SELECT p_brand, col, CASE WHEN row_number() OVER (PARTITION BY p_brand, role ORDER BY confidence DESC, col DESC) = 1 THEN role ELSE 'UNKNOWN' END AS role FROM c""")
def unique_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    role = F.element_at(F.array(*[F.lit(r) for r in ("SL", "QTY", "QTY", "AMOUNT", "AMOUNT", "AMOUNT", "DESCRIPTION")]), (F.col("col") + 1).cast("int"))
    claims = table(spark, sf_dir, "part").selectExpr("p_brand", "p_partkey % 7 AS col", "p_size").withColumn("role", role).groupBy("p_brand", "col", "role").agg((F.max("p_size") / 100.0).alias("confidence"))
    return roles.unique_roles(claims, ["p_brand"], "col", "role", "confidence").select("p_brand", "col", "role")
