"""Queries on evidence, readings and pages, over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablescribe.functions import texts
from tablescribe.functions.numbers import token_class
from tablescribe.operators import evidence, pages, products
from tablescribe.plans.queries import CLASS_SQL, TOKENS_SQL, _tokens
from tablescribe.plans.registry import pattern_sql as _sql
from tablescribe.plans.registry import query
from tablescribe.sources.tables import table

READINGS = """user_id, CAST(ts AS DATE) AS day, event_id, CASE WHEN event_id % 3 = 0 THEN upper(event_type) ELSE event_type END AS text,
 CASE event_id % 4 WHEN 0 THEN 'paddle' WHEN 1 THEN 'local' WHEN 2 THEN 'tesseract5' ELSE 'easyocr' END AS engine, value AS score"""
VOTE_SQL = """
WITH r AS (SELECT {readings} FROM events), v AS (SELECT *, regexp_replace(lower(text), '\\s+', '', 'g') AS k, {voice} AS voice FROM r),
g AS (SELECT user_id, day, k, count(DISTINCT voice) AS n, count(*) AS m, max(CASE WHEN engine = 'paddle' THEN 1 ELSE 0 END) AS f, round(sum(score), 6) AS s,
 min(struct_pack(o := engine <> 'paddle', e := engine, t := text)).t AS t, max(struct_pack(s := score, f := engine = 'paddle', t := text)) AS b FROM v GROUP BY 1, 2, 3),
x AS (SELECT user_id, day, max(struct_pack(n := n, m := m, f := f, s := s, t := t)) AS v, max(b) AS b FROM g GROUP BY 1, 2)
SELECT user_id, CAST(day AS VARCHAR) AS day, CASE WHEN v.n >= 2 THEN v.t ELSE b.t END AS text, v.n >= 2 AS accepted, v.n AS voices FROM x"""


def _readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    engine = F.element_at(F.array(*[F.lit(e) for e in ("paddle", "local", "tesseract5", "easyocr")]), (F.col("event_id") % 4 + 1).cast("int"))
    text = F.when(F.col("event_id") % 3 == 0, F.upper("event_type")).otherwise(F.col("event_type"))
    return events.select("user_id", F.to_date("ts").cast("string").alias("day"), "event_id", text.alias("text"), engine.alias("engine"), F.col("value").alias("score"))


@query(VOTE_SQL.format(readings=READINGS, voice="engine"))
def engine_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.vote(_readings(spark, sf_dir), ["user_id", "day"], "text", "engine", "score", first="paddle")


@query(VOTE_SQL.format(readings=READINGS, voice="CASE WHEN engine IN ('local', 'tesseract5') THEN 'tesseract' ELSE engine END"))
def family_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.vote(_readings(spark, sf_dir), ["user_id", "day"], "text", "engine", "score", {"local": "tesseract", "tesseract5": "tesseract"}, "paddle")


PAIR = """p_partkey, CASE p_partkey % 7 WHEN 0 THEN '' WHEN 1 THEN NULL WHEN 2 THEN '7 1' WHEN 3 THEN p_size || '..2' WHEN 4 THEN p_name ELSE p_size || '.20' END AS a, CASE p_size % 6 WHEN 0 THEN '' WHEN 1 THEN p_size || '.2 0' WHEN 2 THEN upper(p_name) WHEN 3 THEN NULL ELSE p_size || '.20' END AS b,
 p_size * 2.0D AS sa, p_partkey % 100 * 1.0D AS sb, p_partkey % 3 = 0 AS num"""


@query(f"""
WITH p AS (SELECT {PAIR.replace("0D", "0::DOUBLE")} FROM part), q AS (SELECT p_partkey, coalesce(a, '') AS a, coalesce(b, '') AS b, sa, sb, num FROM p),
t AS (SELECT *, regexp_matches(trim(a), '{evidence.NUMBER}') AS ta, regexp_matches(trim(b), '{evidence.NUMBER}') AS tb, regexp_replace(lower(a), '\\s+', '', 'g') = regexp_replace(lower(b), '\\s+', '', 'g') AS same FROM q),
s AS (SELECT *, CASE WHEN a = '' AND b = '' OR b = '' AND num AND NOT ta THEN 'empty' WHEN b = '' THEN 'local' WHEN a = '' THEN 'api' WHEN same THEN 'agreed' WHEN sb >= 85 THEN 'api' WHEN (NOT num OR ta OR NOT tb) AND sa > sb + 10 THEN 'local' ELSE 'api' END AS source FROM t)
SELECT p_partkey, CASE source WHEN 'empty' THEN '' WHEN 'local' THEN a WHEN 'api' THEN b ELSE CASE WHEN num AND ta <> tb THEN CASE WHEN ta THEN a ELSE b END WHEN length(b) >= length(a) THEN b ELSE a END END AS text, source FROM s""")
def chosen_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tablescribe.operators.roles import columns_of

    pairs = table(spark, sf_dir, "part").selectExpr(*columns_of(PAIR))
    return pairs.select("p_partkey", evidence.chosen_text(*[F.col(c) for c in ("a", "b", "sa", "sb", "num")]).alias("c")).select("p_partkey", "c.*")


@query("""
SELECT vec_id AS k, label + 100 AS v FROM embeddings WHERE vec_id % 10 = 0 UNION ALL SELECT vec_id, label FROM embeddings WHERE vec_id % 10 <> 0 UNION ALL SELECT vec_id + 1000000, label + 100 FROM embeddings WHERE vec_id % 50 = 0""")
def upserted_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").selectExpr("vec_id AS k", "label AS v")
    changes = rows.where("k % 10 = 0").selectExpr("k", "v + 100 AS v").unionAll(rows.where("k % 50 = 0").selectExpr("k + 1000000", "v + 100"))
    return evidence.upsert(rows, changes, ["k"])


@query("""
WITH r AS (SELECT l_orderkey, max(struct_pack(s := l_discount * 10, t := l_returnflag || l_linenumber)) AS b FROM lineitem GROUP BY 1)
SELECT o_orderkey, CASE WHEN b.s > 0.7::DOUBLE THEN b.t ELSE o_orderstatus END AS text, CASE WHEN b.s > 0.7::DOUBLE THEN b.s ELSE 0.7::DOUBLE END AS score FROM orders LEFT JOIN r ON l_orderkey = o_orderkey""")
def cells_updated_where_surer(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = table(spark, sf_dir, "orders").selectExpr("o_orderkey", "o_orderstatus AS text", "0.7D AS score")
    readings = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS o_orderkey", "concat(l_returnflag, l_linenumber) AS text", "l_discount * 10 AS score")
    return evidence.update_where_surer(cells, readings, ["o_orderkey"], "text", "score")


@query("""
WITH s AS (SELECT l_orderkey, l_discount * 10 AS s, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_discount DESC) AS r FROM lineitem),
b AS (SELECT l_orderkey, max(s) FILTER (r = 1) AS b, coalesce(max(s) FILTER (r = 2), 0) AS s FROM s GROUP BY 1), q AS (SELECT l_orderkey, avg(l_tax * 10) AS q FROM lineitem WHERE l_linenumber > 1 GROUP BY 1)
SELECT l_orderkey, floor(1000 * round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, 0.6::DOUBLE * b + 0.2::DOUBLE * least(1.0::DOUBLE, 0.5::DOUBLE + 2.5::DOUBLE * (b - s)) + 0.2::DOUBLE * coalesce(q, 0.5::DOUBLE))), 4) + 0.5) / 1000 AS confidence FROM b LEFT JOIN q USING (l_orderkey)""")
def geometry_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    scores, cells = lines.selectExpr("l_orderkey", "l_discount * 10 AS s"), lines.where("l_linenumber > 1").selectExpr("l_orderkey", "l_tax * 10 AS q")
    found = evidence.margin_confidence(scores, ["l_orderkey"], "s", cells, "q")
    return found.withColumn("confidence", F.floor(F.col("confidence") * 1000 + 0.5) / 1000)


@query("""
WITH c AS (SELECT p_brand, CASE WHEN p_partkey % 4 = 0 THEN 'UNKNOWN' ELSE 'QTY' END AS role, p_size / 50.0::DOUBLE AS confidence, p_size % 10 / 10.0::DOUBLE AS ratio FROM part)
SELECT p_brand, coalesce(round(greatest(0, least(1, 0.6::DOUBLE * avg(confidence) FILTER (role <> 'UNKNOWN') + 0.4::DOUBLE * avg(CASE WHEN role <> 'UNKNOWN' THEN 1.0 ELSE 0.0 END) + CASE WHEN max(ratio) >= 0.6 THEN 0.15::DOUBLE ELSE 0 END)), 6), 0) AS evidence FROM c GROUP BY 1""")
def semantic_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = table(spark, sf_dir, "part").selectExpr("p_brand", "CASE WHEN p_partkey % 4 = 0 THEN 'UNKNOWN' ELSE 'QTY' END AS role", "p_size / 50.0D AS confidence", "p_size % 10 / 10.0D AS ratio")
    return evidence.semantic_evidence(columns, ["p_brand"], "role", "confidence", F.col("ratio"))


CHECKS = "l_suppkey, CASE WHEN l_linenumber = 1 THEN 'total' ELSE 'line' END AS kind, CASE WHEN l_partkey % 5 = 0 THEN 'unavailable' WHEN l_partkey % 5 = 1 THEN 'derived' WHEN l_partkey % 5 = 2 THEN 'mismatch' ELSE 'ok' END AS status"


@query(f"""
WITH c AS (SELECT {CHECKS} FROM lineitem),
g AS (SELECT l_suppkey, count(*) FILTER (kind = 'line') AS items, count(*) FILTER (kind = 'line' AND status <> 'unavailable') AS e, count(*) FILTER (kind = 'line' AND status IN ('ok', 'derived')) AS k, count(*) FILTER (kind = 'total' AND status IN ('ok', 'mismatch')) AS t, count(*) FILTER (kind = 'total' AND status = 'ok') AS o FROM c GROUP BY 1)
SELECT l_suppkey, round(0.5::DOUBLE * coalesce(k / nullif(e, 0), 0.5) + 0.35::DOUBLE * coalesce(o / nullif(t, 0), 0.5) + 0.15::DOUBLE * CASE WHEN e > 0 THEN least(1, e / greatest(1, items)) ELSE 0 END, 4) AS score FROM g""")
def arithmetic_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tablescribe.operators.roles import columns_of

    return evidence.arithmetic_score(table(spark, sf_dir, "lineitem").selectExpr(*columns_of(CHECKS)), ["l_suppkey"], "status")


@query("""
SELECT p_brand, count(*) AS total, count(*) FILTER (p_size % 3 > 0) AS populated, count(*) FILTER (p_size % 2 = 0) AS bordered, round(avg(p_size / 50.0::DOUBLE), 3) AS mean_confidence, count(*) FILTER (p_size / 50.0::DOUBLE < 0.5) AS low FROM part GROUP BY 1""")
def cell_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = table(spark, sf_dir, "part").selectExpr("p_brand", "CASE WHEN p_size % 3 = 0 THEN '' ELSE p_name END AS text", "p_size / 50.0D AS confidence", "p_size % 2 = 0 AS bordered")
    return evidence.cell_summary(cells, ["p_brand"], "text", "confidence", "bordered")


@query("""
WITH c AS (SELECT p_brand, p_partkey % 3 AS col, CASE p_partkey % 3 WHEN 0 THEN 10.0::DOUBLE WHEN 1 THEN 200.0::DOUBLE - p_size ELSE 300.0::DOUBLE - p_size / 2.0 END AS l, CASE p_partkey % 3 WHEN 0 THEN 10.0::DOUBLE + p_size WHEN 1 THEN 200.0::DOUBLE ELSE 300.0::DOUBLE + p_size / 2.0 END AS r FROM part),
s AS (SELECT p_brand, col, stddev_pop(l) AS l, stddev_pop(r) AS r, stddev_pop((l + r) / 2) AS c FROM c GROUP BY 1, 2)
SELECT p_brand, col, CASE WHEN l <= least(l, r, c) + 1e-9 THEN 'left' WHEN r <= least(l, r, c) + 1e-9 THEN 'right' ELSE 'center' END AS align FROM s""")
def column_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = table(spark, sf_dir, "part").selectExpr(
        "p_brand", "p_partkey % 3 AS col", "CASE p_partkey % 3 WHEN 0 THEN 10.0D WHEN 1 THEN 200.0D - p_size ELSE 300.0D - p_size / 2.0D END AS l", "CASE p_partkey % 3 WHEN 0 THEN 10.0D + p_size WHEN 1 THEN 200.0D ELSE 300.0D + p_size / 2.0D END AS r")
    return evidence.alignment(cells, ["p_brand", "col"], "l", "r")


@query(f"""
WITH c AS (SELECT col, {CLASS_SQL} AS kind, count(*) AS n FROM {TOKENS_SQL} GROUP BY 1, 2), g AS (SELECT col, sum(n) AS total, coalesce(sum(n) FILTER (kind <> 'empty'), 0) AS n_some, coalesce(sum(n) FILTER (kind IN ('money', 'decimal', 'int')), 0) AS num FROM c GROUP BY 1),
b AS (SELECT col, kind, n FROM c WHERE kind <> 'empty' QUALIFY row_number() OVER (PARTITION BY col ORDER BY n DESC, kind) = 1)
SELECT col, coalesce(kind, 'empty') AS type, coalesce(round(n / nullif(n_some, 0), 6), 0) AS purity, coalesce(round(num / nullif(n_some, 0), 6), 0) AS numeric_ratio, round((total - n_some) / total, 6) AS empty_ratio FROM g LEFT JOIN b USING (col)""")
def column_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.dominant_type(_tokens(spark, sf_dir).select("col", token_class(F.col("token")).alias("kind")), ["col"], "kind")


@query(None)
def requests_within_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = table(spark, sf_dir, "part").selectExpr("p_brand AS page", "p_partkey AS id", "p_size / 50.0D AS priority", "p_retailprice * 500 AS pixels")
    return evidence.within_budget(requests, ["page"], "priority", "id", "pixels", 12, 4_000_000.0, 4).select("page", "id", "wave")


CENTROIDS = [[(i * 7 + j * 3) % 5 / 5 - 0.4 for j in range(64)] for i in range(6)]


@query(f"""
WITH c AS (SELECT range::INT AS i, {[[float(x) for x in c] for c in CENTROIDS]}[range + 1] AS c FROM range(6)), e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
d AS (SELECT vec_id, i, list_sum([(v[k] - c[k]) * (v[k] - c[k]) FOR k IN range(1, 65)]) AS d FROM e, c)
SELECT vec_id, i AS cluster, round(d, 5) AS distance FROM d QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, i) = 1""")
def nearest_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("v"))
    return evidence.nearest_centroid(vectors, "vec_id", "v", CENTROIDS).withColumn("distance", F.round("distance", 5))


@query("""
WITH g AS (SELECT l_suppkey, var_pop(l_quantity) AS a, var_pop(l_extendedprice / 1000) AS c, covar_pop(l_quantity, l_extendedprice / 1000) AS b FROM lineitem GROUP BY 1), e AS (SELECT *, (a + c) / 2 AS m, sqrt((a - c) * (a - c) / 4 + b * b) AS r FROM g)
SELECT l_suppkey, round(round(degrees(atan2(2 * b, a - c) / 2), 4), 3) AS angle, round(round((m + r) / greatest(m - r, 1e-9), 4), 3) AS ratio, (m + r) / greatest(m - r, 1e-9) >= 4 AS elongated FROM e""")
def principal_axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = table(spark, sf_dir, "lineitem").selectExpr("l_suppkey", "l_quantity AS x", "l_extendedprice / 1000 AS y")
    return evidence.principal_axis(points, ["l_suppkey"], "x", "y", 4.0).withColumns({c: F.round(c, 3) for c in ("angle", "ratio")})


@query("""
WITH f AS (SELECT l_suppkey, l_linenumber, regr_slope(l_extendedprice, l_quantity) AS s, max(l_quantity) - min(l_quantity) AS w FROM lineitem GROUP BY 1, 2),
c AS (SELECT *, sum(w) OVER (PARTITION BY l_suppkey ORDER BY s) AS c, sum(w) OVER (PARTITION BY l_suppkey) AS t FROM f WHERE s IS NOT NULL AND w > 0)
SELECT l_suppkey, round(min(s), 3) AS slope FROM c WHERE c >= t / 2 GROUP BY 1""")
def page_slopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.page_slope(table(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_linenumber", "l_quantity", "l_extendedprice").withColumn("slope", F.round("slope", 3))


SERIAL = "CASE o_orderkey % 9 WHEN 0 THEN 'l' || (o_orderkey % 10) WHEN 1 THEN '1018' WHEN 2 THEN 'name' WHEN 3 THEN (o_orderkey % 40) || '.)' ELSE CAST(o_orderkey % 60 AS STRING) END"


@query(f"""
WITH d AS (SELECT o_custkey, regexp_replace(translate(trim({SERIAL}), 'OoIli|SsBZz', '00111155822'), '[.,:;)\\-\\s]+$', '') AS t FROM orders), v AS (SELECT o_custkey, t::INT AS v FROM d WHERE regexp_matches(t, '^\\d{{1,4}}$')),
m AS (SELECT o_custkey, list_sort(list(v))[count(*) // 2 + 1] AS m, count(*) AS n FROM v GROUP BY 1)
SELECT o_custkey, min(v) AS first, max(v) AS last, count(*) AS n FROM v JOIN m USING (o_custkey) WHERE m.n >= 2 AND abs(v - m) <= greatest(50, 5 * m.n) GROUP BY 1 HAVING count(*) >= 2""")
def serial_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.serial_range(table(spark, sf_dir, "orders").selectExpr("o_custkey", f"{SERIAL} AS t"), ["o_custkey"], "t")


TOTAL_LINE = """CASE o_orderkey % 7 WHEN 0 THEN 'Grand Total : ' || o_custkey || '.50' WHEN 1 THEN 'Less Discount ' || (o_custkey % 90) WHEN 2 THEN 'Net Payable Tk. 1,' || (100 + o_custkey % 900) WHEN 3 THEN 'Total Trade Price - 5|' WHEN 4 THEN 'carried' ELSE NULL END"""
TOTAL_COLUMNS = ", ".join(f"try_cast(replace(regexp_extract(t, {_sql('(?i)' + h + pages.AMOUNT)}, 1), ',', '') AS DOUBLE) AS {k}" for k, h in pages.TOTALS.items())
FIRST_COLUMNS = ", ".join(f"arg_min({k}, o_orderkey) FILTER ({k} IS NOT NULL) AS {k}" for k in pages.TOTALS)


@query(f"""
WITH l AS (SELECT o_custkey, month(o_orderdate) AS page, o_orderkey, replace(coalesce({TOTAL_LINE}, ''), '|', '1') AS t FROM orders), v AS (SELECT o_custkey, page, o_orderkey, {TOTAL_COLUMNS} FROM l),
p AS (SELECT o_custkey, page, {FIRST_COLUMNS} FROM v GROUP BY 1, 2)
SELECT o_custkey, page::INT AS page, {", ".join(pages.TOTALS)} FROM p WHERE grand_total IS NOT NULL OR payable IS NOT NULL OR trade_total IS NOT NULL QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY page DESC) = 1""")
def invoice_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "orders").select("o_custkey", F.month("o_orderdate").alias("page"), "o_orderkey", F.expr(TOTAL_LINE).alias("t"))
    return pages.invoice_totals(lines, ["o_custkey"], "page", "o_orderkey", "t")


PAGE = "o_custkey AS doc, o_orderkey AS came, CASE WHEN o_orderkey % 5 < 1 + o_custkey % 4 THEN CAST(o_orderkey % 50 AS INT) END AS no, CASE WHEN o_orderkey % 7 < 1 + o_custkey % 6 THEN CAST(o_orderkey % 91 AS INT) END AS serial"


@query(f"""
WITH p AS (SELECT {PAGE} FROM orders), k AS (SELECT *, no IS NOT NULL OR serial IS NOT NULL AS known FROM p),
g AS (SELECT doc, count(*) FILTER (known) AS kn, count(no) AS nn, count(serial) AS ns, count(DISTINCT no) AS dn FROM k GROUP BY 1),
m AS (SELECT k.*, kn > 0 AND kn = nn AND dn = nn AS by_no, NOT (kn > 0 AND kn = nn AND dn = nn) AND ns >= 2 AS by_serial FROM k JOIN g USING (doc))
SELECT doc, came, row_number() OVER (PARTITION BY doc ORDER BY CASE WHEN NOT known THEN 2 WHEN by_serial AND serial IS NULL THEN 1 ELSE 0 END, CASE WHEN NOT known THEN 0 WHEN by_serial AND serial IS NOT NULL THEN serial ELSE coalesce(no, 1000000000) END,
 CASE WHEN by_serial AND serial IS NOT NULL THEN coalesce(no, 0) ELSE 0 END, came) AS place FROM m""")
def ordered_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tablescribe.operators.roles import columns_of

    return pages.ordered_pages(table(spark, sf_dir, "orders").selectExpr(*columns_of(PAGE)), ["doc"], "came", "no", "serial").select("doc", "came", "place")


@query("""
WITH f AS (SELECT l_orderkey, l_shipmode AS key, min(struct_pack(p := l_linenumber, q := l_partkey)) AS f FROM (SELECT *, l_returnflag || l_linestatus AS l_shipmode FROM lineitem) GROUP BY 1, 2)
SELECT l_orderkey, key, row_number() OVER (PARTITION BY l_orderkey ORDER BY f, key) AS place FROM f""")
def column_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_partkey", "concat(l_returnflag, l_linestatus) AS key")
    return pages.column_union(columns, ["l_orderkey"], "l_linenumber", "l_partkey", "key")


@query("""
WITH c AS (SELECT l_orderkey, CAST(l_linenumber AS VARCHAR) AS k, max(l_returnflag || l_linestatus) AS v FROM lineitem GROUP BY 1, 2)
SELECT l_orderkey, '{' || string_agg('"' || k || '":"' || v || '"', ',' ORDER BY k) || '}' AS cells FROM c GROUP BY 1""")
def rows_as_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "CAST(l_linenumber AS STRING) AS k", "concat(l_returnflag, l_linestatus) AS v")
    return pages.row_objects(cells, ["l_orderkey"], "k", "v")


@query("SELECT l_suppkey || ',' || count(*) || ',' || printf('%.1f', avg(l_quantity)) AS line FROM lineitem GROUP BY l_suppkey")
def metrics_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    summed = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"), F.avg("l_quantity").alias("mean"))
    return pages.metrics_csv(summed, {"l_suppkey": "%d", "n": "%d", "mean": "%.1f"})


@query(r"""
WITH t AS (SELECT conv_id, turn, text FROM conversations WHERE text IS NOT NULL), s AS (SELECT *, trim(regexp_replace(text, '\s+', ' ', 'g')) AS s FROM t)
SELECT conv_id, turn, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '0([A-Za-z])', 'O\1', 'g'), '([A-Za-z])0', '\1o', 'g'), '1([A-Za-z])', 'l\1', 'g'), '\bI1\b', 'Il', 'g'), '\s{2,}', ' ', 'g')) AS rewritten FROM s""")
def rewritten_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").where("text is not null").select("conv_id", "turn", texts.look_alikes(F.col("text")).alias("rewritten"))


@query(r"""
WITH s AS (SELECT conv_id, turn, trim(regexp_replace(text, '\s+', ' ', 'g')) AS s FROM conversations WHERE text IS NOT NULL),
w AS (SELECT conv_id, turn, s, regexp_split_to_array(s, ' ') AS w FROM s),
c AS (SELECT conv_id, turn, list_transform(range(1, len(w) + 1), lambda i: CASE WHEN i = 1 OR regexp_matches(w[i - 1], '[.!?]$') AND regexp_matches(w[i], '^[a-z]') THEN upper(w[i][1]) || w[i][2:] ELSE w[i] END) AS w FROM w)
SELECT conv_id, turn, array_to_string(w, ' ') AS sentence FROM c""")
def capitalised_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").where("text is not null").select("conv_id", "turn", texts.capitalised(F.col("text")).alias("sentence"))


@query(r"""
SELECT p_partkey, p_size / 2.0 > 8 OR p_retailprice % 1 < 0.7 OR p_size % 5 < 2 OR p_brand = 'Brand#11' AS second_reader, length(p_name) >= 2 AND p_retailprice % 1 < 0.9 AND NOT regexp_matches(CASE WHEN p_size % 2 = 0 THEN p_name ELSE '12 %' END, '^[\d.,\s%$€£¥]+$') AS language_model,
 CASE WHEN p_size * 60 > 2000 THEN 'large' WHEN p_retailprice % 1 < 0.5 THEN 'fast' ELSE 'usual' END AS backbone FROM part""")
def routing_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    part, confidence = table(spark, sf_dir, "part"), F.col("p_retailprice") % 1
    text = F.when(F.col("p_size") % 2 == 0, F.col("p_name")).otherwise("12 %")
    return part.select(
        "p_partkey", texts.needs_second_reader(F.col("p_size"), F.lit(2.0), confidence, F.col("p_size") % 5, F.col("p_brand") == "Brand#11").alias("second_reader"),
        texts.needs_language_model(text, confidence, 0.9).alias("language_model"), texts.backbone(F.col("p_size") * 60, F.lit(0), confidence, ("large", "fast", "usual")).alias("backbone"))


TABLES_OF = "p_brand AS page, p_partkey AS id, p_size % 5 AS cols, p_partkey % 4 AS n_rows, p_size % 4 AS populated, p_size % 3 = 0 AS decorative"


@query(f"""
WITH t AS (SELECT {TABLES_OF} FROM part), r AS (SELECT *, CASE WHEN decorative THEN 1 ELSE 0 END + CASE WHEN n_rows <= 1 THEN 1 ELSE 0 END + CASE WHEN cols <= 1 THEN 1 ELSE 0 END + CASE WHEN populated <= 2 THEN 1 ELSE 0 END AS reasons, cols >= 3 AND n_rows >= 3 AS item FROM t)
SELECT page, id, reasons >= 2 AS rejected FROM r QUALIFY item OR NOT max(item) OVER (PARTITION BY page) AND row_number() OVER (PARTITION BY page ORDER BY cols DESC, n_rows DESC, id) = 1""")
def item_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tablescribe.operators.roles import columns_of

    tables = table(spark, sf_dir, "part").selectExpr(*columns_of(TABLES_OF))
    return texts.item_tables(tables, ["page"], "id").select("page", "id", "rejected")


NAMES = "(SELECT p_partkey AS id, upper(p_name) AS name, upper(split_part(p_name, ' ', 1)) AS first, p_brand AS maker, p_size FROM part)"
QUERIES_SQL = "(SELECT p_partkey AS q, CASE p_partkey % 5 WHEN 0 THEN upper(split_part(p_name, ' ', 1)) WHEN 1 THEN replace(upper(split_part(p_name, ' ', 1)), 'L', 'I') WHEN 2 THEN upper(split_part(p_name, ' ', 1)) || 'E' WHEN 3 THEN replace(upper(split_part(p_name, ' ', 1)), 'O', '0') ELSE 'X' || upper(split_part(p_name, ' ', 1)) END AS first FROM part)"
GRAMS_SQL = "list_distinct([substr('^' || {0} || '$', i, 3) FOR i IN range(1, length({0}) + 1)])"


@query(f"""
WITH v AS (SELECT DISTINCT first FROM {NAMES}), q AS (SELECT DISTINCT first AS word FROM {QUERIES_SQL}),
c AS (SELECT word, first, len(list_intersect({GRAMS_SQL.format("word")}, {GRAMS_SQL.format("first")})) AS shared FROM q, v)
SELECT word, first AS candidate, CASE WHEN word = first THEN 1.0::DOUBLE WHEN length(word) = length(first) AND translate(word, '01L5826', 'OIISBZG') = translate(first, '01L5826', 'OIISBZG') THEN 1 - 0.5::DOUBLE * hamming(word, first) / length(word)
 ELSE greatest(0.0::DOUBLE, 1 - levenshtein(word, first)::DOUBLE / greatest(length(word), length(first))) END AS similarity
FROM c WHERE word = first OR left(word, 3) = left(first, 3) OR length(word) >= 4 AND shared >= greatest(2, ceil((length(word) - 1) * 0.5))""")
def product_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    first = F.upper(F.substring_index("p_name", " ", 1))
    word = F.when(F.col("p_partkey") % 5 == 0, first).when(F.col("p_partkey") % 5 == 1, F.replace(first, F.lit("L"), F.lit("I"))).when(F.col("p_partkey") % 5 == 2, F.concat(first, F.lit("E"))).when(F.col("p_partkey") % 5 == 3, F.replace(first, F.lit("O"), F.lit("0"))).otherwise(F.concat(F.lit("X"), first))
    return products.candidates(part.select(word.alias("word")), "word", part.select(first.alias("first")), "first")


FACTOR = "p_partkey, p_size % 4 AS qv, p_partkey % 4 AS pv, p_size % 3 AS qf, p_partkey % 5 AS pf, p_size % 2 AS qn, p_partkey % 3 AS pn"
STRENGTHS = ["[]", "[500.0]", "[500.0, 20.0]", "[40.0]"]
FORMS = ["TABLET", "CAPSULE", "SYRUP", "CREAM", None]


@query(f"""
WITH f AS (SELECT {FACTOR} FROM part), s AS (SELECT *, {[[500.0], [500.0, 20.0], [40.0], []]} AS all_s FROM f),
x AS (SELECT *, list_concat([[]::DOUBLE[]], [[500.0::DOUBLE], [500.0::DOUBLE, 20.0::DOUBLE], [40.0::DOUBLE]])[qv + 1] AS q, list_concat([[]::DOUBLE[]], [[500.0::DOUBLE], [500.0::DOUBLE, 20.0::DOUBLE], [40.0::DOUBLE]])[pv + 1] AS p,
 ['TABLET', 'CAPSULE', 'SYRUP', 'CREAM', NULL][qf + 1] AS a, ['TABLET', 'CAPSULE', 'SYRUP', 'CREAM', NULL][pf + 1] AS b FROM s), h AS (SELECT *, len(list_filter(q, lambda v: list_contains(p, v))) AS hit FROM x)
SELECT p_partkey, CASE WHEN len(q) = 0 AND len(p) = 0 THEN 0.95::DOUBLE WHEN len(q) = 0 OR len(p) = 0 THEN 0.8 WHEN hit = len(q) AND hit = len(p) THEN 1 WHEN hit = least(len(q), len(p)) THEN 0.9 ELSE 0.35 END AS strength,
 CASE WHEN a IS NULL OR b IS NULL THEN 0.9::DOUBLE WHEN a = b THEN 1 WHEN a IN ('TABLET', 'CAPSULE') AND b IN ('TABLET', 'CAPSULE') THEN 0.7 ELSE 0.45 END AS form, CASE WHEN qn = pn THEN 1.0::DOUBLE ELSE greatest(0.35::DOUBLE, 1 - 0.35::DOUBLE * abs(qn - pn)) END AS qualifier FROM h""")
def match_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tablescribe.operators.roles import columns_of

    rows = table(spark, sf_dir, "part").selectExpr(*columns_of(FACTOR))
    strengths = F.array(F.array().cast("array<double>"), F.array(F.lit(500.0)), F.array(F.lit(500.0), F.lit(20.0)), F.array(F.lit(40.0)))
    forms = F.array(*[F.lit(f).cast("string") for f in FORMS])
    words = F.array(*[F.lit(w) for w in ("FORTE", "PLUS")])
    pick = lambda a, c: F.get(a, F.col(c).cast("int"))
    return rows.select(
        "p_partkey", products.strength_factor(pick(strengths, "qv"), pick(strengths, "pv")).alias("strength"), products.form_factor(pick(forms, "qf"), pick(forms, "pf")).alias("form"),
        products.qualifier_factor(F.slice(words, F.lit(1), F.col("qn").cast("int")), F.slice(words, F.lit(1), F.col("pn").cast("int"))).alias("qualifier"))
