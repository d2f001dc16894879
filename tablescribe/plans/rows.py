"""Queries on the texts of printed rows: packs, groups, totals, titles, labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablescribe.functions import groups, packs
from tablescribe.operators import tables
from tablescribe.plans.registry import pattern_sql as _sql
from tablescribe.plans.registry import query
from tablescribe.sources.tables import table

# Inputs, the same expression in both dialects: pack texts, row texts and lines made of the columns of part and orders.
PACK = """CASE p_partkey % 20 WHEN 0 THEN p_size || 'X10''S' WHEN 1 THEN '1X3X' || p_size WHEN 2 THEN p_size || '''s' WHEN 3 THEN p_size || '0S' WHEN 4 THEN p_size || ' PCS'
 WHEN 5 THEN '1x' || p_size || 'gm' WHEN 6 THEN p_size || ' ML' WHEN 7 THEN CASE p_size % 3 WHEN 0 THEN 'VIAL' WHEN 1 THEN 'ROLL' ELSE 'CARTON' END WHEN 8 THEN p_size || ' 0S' WHEN 9 THEN '5X' || p_size || '8' WHEN 10 THEN p_size || '08' WHEN 11 THEN p_size || '05'
 WHEN 12 THEN 'IXIX' || p_size WHEN 13 THEN CAST(p_size AS STRING) WHEN 14 THEN '' WHEN 15 THEN NULL WHEN 16 THEN 'pixxr' WHEN 17 THEN p_size || '×10' WHEN 18 THEN '10X' || p_size || '5' ELSE p_name END"""
ITEM = """CASE p_partkey % 8 WHEN 0 THEN p_name || ' Tab 10x' || p_size || '''s' WHEN 1 THEN p_name || ' Syp ' || p_size || 'ml' WHEN 2 THEN p_name || ' (' || p_size || '0S)' WHEN 3 THEN p_name || ' Cap ' || p_size || ' pcs'
 WHEN 4 THEN p_name || ' 1OxlO''s' WHEN 5 THEN NULL WHEN 6 THEN '' ELSE p_name END"""
LABEL = """CASE p_partkey % 22 WHEN 0 THEN 'RPL' WHEN 1 THEN 'Square Pharmaceuticals' WHEN 2 THEN '05 INJECTION' WHEN 3 THEN '0S INJECTION' WHEN 4 THEN '10 Tabs' WHEN 5 THEN 'Sub Total ' || p_size WHEN 6 THEN 'Tab'
 WHEN 7 THEN p_name WHEN 8 THEN 'L.' WHEN 9 THEN '0.35' WHEN 10 THEN 'MSD Product' WHEN 11 THEN 'Page ' || p_size WHEN 12 THEN '' WHEN 13 THEN NULL WHEN 14 THEN 'Grand Total : ' || p_retailprice WHEN 15 THEN 'Net Payable'
 WHEN 16 THEN 'Amount in words: ten' WHEN 17 THEN 'A' WHEN 18 THEN '01. TABLET' WHEN 19 THEN 'Less Discount 5' WHEN 20 THEN CASE p_size % 5 WHEN 0 THEN 'GOLD' WHEN 1 THEN 'Max Extra' WHEN 2 THEN 'Total VAT / unit' WHEN 3 THEN 'Total VAT 7' ELSE 'Tab Forte' END WHEN 21 THEN 'Eye Drops ' || p_brand ELSE p_brand END"""
FRAGMENTS = groups.FRAGMENTS


def _parts(spark: SparkSession, sf_dir: str, **columns: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr("p_partkey", "p_brand", "p_size", "p_retailprice", *[f"{v} AS {k}" for k, v in columns.items()])


def _printed(c: str) -> str:
    gap = r"regexp_replace({}, '(\d)\s+(\d)', '\1\2', 'g')"
    return f"trim({gap.format(gap.format(f'''replace(replace(replace(upper(coalesce({c}, '')), '’', chr(39)), '`', chr(39)), '´', chr(39))'''))})"


UNIT = packs.SIZE_UNITS
_END = f"trim(regexp_extract(coalesce(item, ''), {_sql('(?i)' + packs.NAME_PACK)}, 1))"
AT_END_SQL = f"(CASE WHEN {_END} <> '' THEN translate(regexp_extract({_END}, {_sql(packs.NUMBERS)}, 0), 'OoIl|', '00111') || substr({_END}, length(regexp_extract({_END}, {_sql(packs.NUMBERS)}, 0)) + 1) END)"
PACKS_SQL = f"""
WITH p AS (SELECT p_partkey, {PACK} AS text, {ITEM} AS item FROM part),
t AS (SELECT *, {_printed("text")} AS t FROM p), d AS (SELECT *, translate(t, 'OI|×', '011X') AS d FROM t), n AS (SELECT * FROM d)
SELECT p_partkey,
 CASE WHEN regexp_matches(d, '^\\d+\\s*X\\s*\\d+(?:\\.\\d+)?\\s*(?:{UNIT})(?:[^A-Z]|$)') THEN regexp_extract(d, '^(\\d+)', 1)::BIGINT
  WHEN regexp_matches(d, '^\\d+\\s*X\\s*\\d+\\s*X\\s*\\d+\\s*''?S?\\b') THEN regexp_extract(d, '^(\\d+)', 1)::BIGINT * regexp_extract(d, '^\\d+\\s*X\\s*(\\d+)', 1)::BIGINT * regexp_extract(d, '^\\d+\\s*X\\s*\\d+\\s*X\\s*(\\d+)', 1)::BIGINT
  WHEN regexp_matches(d, '^\\d+\\s*X\\s*\\d+\\s*''?S?\\b') THEN regexp_extract(d, '^(\\d+)', 1)::BIGINT * regexp_extract(d, '^\\d+\\s*X\\s*(\\d+)', 1)::BIGINT
  WHEN regexp_matches(d, '^\\d+\\s*''?S\\b') OR regexp_matches(d, '^\\d+\\s*(?:{packs.PIECES})\\b') OR regexp_matches(d, '^\\d+$') THEN regexp_extract(d, '^(\\d+)', 1)::BIGINT ELSE 1 END AS units,
 regexp_matches(d, '^\\d+\\s*X\\s*\\d+') OR regexp_matches(d, '^\\d+\\s*''?S\\b') OR regexp_matches(t, '^\\d+\\s*(?:PCS|PC|PIECES?|TABS?|CAPS?|SACHETS?|STRIPS?)\\b')
  OR regexp_matches(t, '^\\d+(?:\\.\\d+)?\\s*(?:{UNIT})\\b') OR regexp_matches(t, '^\\d+$') OR regexp_matches(t, '^(?:{packs.PACK_WORDS})$') AS looks,
 CASE WHEN regexp_matches(d, '^\\d+\\s*X\\s*\\d+(?:\\s*X\\s*\\d+)?\\s*''?S?$') THEN 5 WHEN regexp_matches(d, '^\\d+\\s*''?S$') OR regexp_matches(t, '^\\d+(?:\\.\\d+)?\\s*(?:{UNIT})$') THEN 4
  WHEN regexp_matches(t, '^(?:{packs.PACK_WORDS})$') THEN 3 WHEN regexp_matches(t, '^\\d+\\s*(?:PCS|PC)$') THEN 2 WHEN regexp_matches(t, '^\\d{{1,3}}$') THEN 1 ELSE 0 END AS shape,
 CASE WHEN regexp_matches(trim(text), '^\\d{{2,4}}[58]$') AND left(trim(text), -1)::INT >= 10 AND left(trim(text), -1)::INT % 5 = 0 THEN left(trim(text), -1) || 'S' END AS repaired,
 {AT_END_SQL} AS at_end
FROM n"""


@query(PACKS_SQL)
def pack_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    return _parts(spark, sf_dir, text=PACK, item=ITEM).select(
        "p_partkey", packs.unit_count(text).alias("units"), packs.looks_like_pack(text).alias("looks"), packs.shape_score(text).alias("shape"),
        packs.repaired_count(text).alias("repaired"), packs.pack_at_end(F.col("item")).alias("at_end"),
    )


READING = "CASE p_partkey % 4 WHEN 0 THEN '5X' || p_size || '''S' WHEN 1 THEN p_size || '0S' WHEN 2 THEN '10X' || p_size || 's' ELSE NULL END"
BARE_SQL = "regexp_replace(upper(coalesce({}, '')), '[’`´''\\s]', '', 'g')"
WITH_S_SQL = """CASE WHEN regexp_matches({t}, '^\\d+X\\d+(?:X\\d+)?8$') THEN left({t}, -1) || {s} WHEN regexp_matches({t}, '^\\d+X(?:\\d+X)?\\d+5$') AND regexp_extract({t}, '(\\d+)$', 1)::BIGINT > 30 THEN left({t}, -1) || {s}
 WHEN regexp_matches({t}, '^\\d{{2,4}}[85]$') THEN left({t}, -1) || {s} END"""


@query(f"""
WITH p AS (SELECT p_partkey, {PACK} AS text, {READING} AS reading FROM part),
b AS (SELECT *, {BARE_SQL.format("text")} AS a, {BARE_SQL.format("reading")} AS b, {_printed("text")} AS t FROM p)
SELECT p_partkey, regexp_matches(a, '^\\d+(?:X\\d+){{0,2}}[85]$') AND regexp_matches(b, '^\\d+(?:X\\d+){{0,2}}S$') AND left(a, -1) = left(b, -1) AS confused,
 {WITH_S_SQL.format(t="t", s="'''S'")} AS with_s FROM b""")
def pack_s_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = _parts(spark, sf_dir, text=PACK, reading=READING)
    return parts.select("p_partkey", packs.s_confused(F.col("text"), F.col("reading")).alias("confused"), packs.with_s(F.col("text"), F.lit("'S")).alias("with_s"))


@query(f"""
WITH p AS (SELECT p_partkey, p_brand, p_size % 3 AS col, {PACK} AS text FROM part),
b AS (SELECT *, regexp_matches({BARE_SQL.format("text")}, '^\\d+(?:X\\d+){{0,2}}S$') AS s, {_printed("text")} AS t FROM p),
c AS (SELECT *, NOT s AND {WITH_S_SQL.format(t="t", s="'S'")} IS NOT NULL AS cand FROM b),
n AS (SELECT *, count(*) FILTER (s) OVER w AS ns, count(*) FILTER (cand) OVER w AS nc, count(*) FILTER (s AND regexp_matches(text, '(?i)[''’`´]\\s*S\\s*$')) OVER w AS na FROM c WINDOW w AS (PARTITION BY p_brand, col))
SELECT p_partkey, CASE WHEN cand AND ns >= nc AND ns > 0 THEN {WITH_S_SQL.format(t="t", s="(CASE WHEN na * 2 >= ns THEN '''S' ELSE 'S' END)")} ELSE text END AS text FROM n""")
def pack_column_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = _parts(spark, sf_dir, text=PACK).withColumn("col", F.col("p_size") % 3)
    return tables.packs_by_column(parts, ["p_brand", "col"], "text").select("p_partkey", "text")


MRP = "p_retailprice / 40"


@query(f"""
WITH p AS (SELECT p_partkey, {PACK} AS text, {ITEM} AS item, {READING} AS reading, {MRP} AS mrp, p_retailprice AS tp FROM part),
c AS (SELECT p_partkey, mrp, tp, text, 0 AS k, text AS cand FROM p UNION ALL
 SELECT p_partkey, mrp, tp, text, 1, {WITH_S_SQL.format(t=_printed("text"), s="'''S'")} FROM p UNION ALL
 SELECT p_partkey, mrp, tp, text, 2, trim(reading) FROM p WHERE regexp_matches({_printed("reading")}, '^\\d+\\s*X\\s*\\d+\\s*''?S?$|^\\d+\\s*''?S$') UNION ALL
 SELECT p_partkey, mrp, tp, text, 3, {AT_END_SQL} FROM p),
u AS (SELECT *, translate({_printed("cand")}, 'OI|×', '011X') AS d FROM c),
v AS (SELECT *, mrp * CASE WHEN regexp_matches(d, '^\\d+\\s*X\\s*\\d+(?:\\.\\d+)?\\s*(?:{UNIT})(?:[^A-Z]|$)') THEN regexp_extract(d, '^(\\d+)', 1)::BIGINT
  WHEN regexp_matches(d, '^\\d+\\s*X\\s*\\d+\\s*X\\s*\\d+\\s*''?S?\\b') THEN regexp_extract(d, '^(\\d+)', 1)::BIGINT * regexp_extract(d, '^\\d+\\s*X\\s*(\\d+)', 1)::BIGINT * regexp_extract(d, '^\\d+\\s*X\\s*\\d+\\s*X\\s*(\\d+)', 1)::BIGINT
  WHEN regexp_matches(d, '^\\d+\\s*X\\s*\\d+\\s*''?S?\\b') THEN regexp_extract(d, '^(\\d+)', 1)::BIGINT * regexp_extract(d, '^\\d+\\s*X\\s*(\\d+)', 1)::BIGINT
  WHEN regexp_matches(d, '^\\d+\\s*''?S\\b') OR regexp_matches(d, '^\\d+\\s*(?:{packs.PIECES})\\b') OR regexp_matches(d, '^\\d+$') THEN regexp_extract(d, '^(\\d+)', 1)::BIGINT ELSE 1 END AS unit FROM u),
f AS (SELECT *, (unit - tp) / tp AS profit FROM v),
o AS (SELECT p_partkey FROM f WHERE k = 0 AND (profit > 2.0 OR profit < -0.4))
SELECT p_partkey, cand AS text, k AS by_step FROM f JOIN o USING (p_partkey) WHERE k > 0 AND cand IS NOT NULL AND cand <> trim(coalesce(text, '')) AND profit BETWEEN -0.25 AND 1.2
QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY k) = 1""")
def pack_by_mrp(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = _parts(spark, sf_dir, text=PACK, item=ITEM, reading=READING, mrp=MRP)
    return tables.pack_by_price(parts, "p_partkey", "text", ["reading"], "item", "mrp", "p_retailprice")


CATEGORY_SQL = f"""(regexp_matches(t, {_sql(groups.NUMBERED)}) AND (regexp_matches(regexp_extract(t, {_sql(groups.NUMBERED)}, 1), '\\d') OR regexp_matches(regexp_extract(t, {_sql(groups.NUMBERED)}, 1), '(?i)^[OS]{{1,2}}$'))
 AND NOT regexp_matches(regexp_extract(t, {_sql(groups.NUMBERED)}, 2), {_sql(groups.NOT_GROUP)})
 AND NOT list_contains({list(groups.NOT_CATEGORY)}, list_filter(regexp_split_to_array(upper(regexp_extract(t, {_sql(groups.NUMBERED)}, 2)), '[^A-Z]+'), lambda w: w <> '')[1]))"""
GROUP_SQL = f"""({CATEGORY_SQL} OR (NOT regexp_matches(t, '\\d') AND regexp_matches(t, {_sql(groups.NAME)}) AND length(regexp_replace(t, '[^A-Za-z]', '', 'g')) >= 2 AND NOT regexp_matches(t, {_sql(groups.NOT_GROUP)})
 AND len(list_filter(regexp_split_to_array(upper(t), '[^A-Z]+'), lambda w: w <> '' AND NOT list_contains({list(FRAGMENTS)}, w))) > 0))"""
_SUMMARY = tables.SUMMARY_LINE.replace(r"(?!\s*/)", "")  # DuckDB knows no lookahead: what it excludes is blotted out before
_summary = lambda t: f"regexp_matches(regexp_replace({t}, '(?i)total\\s*vat\\s*/', '#', 'g'), {_sql(_SUMMARY)})"
_NO_SUB = f"regexp_replace(t, {_sql(tables.SUB_TOTAL)}, '', 'g')"
SUMMARY_SQL = f"({_summary('t')} AND NOT (regexp_matches(t, {_sql(tables.SUB_TOTAL)}) AND NOT {_summary(_NO_SUB)}))"


@query(f"""
WITH p AS (SELECT p_partkey, {LABEL} AS text, CASE WHEN p_size % 7 = 0 THEN 'vote' END AS source FROM part), t AS (SELECT *, trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')) AS t FROM p)
SELECT p_partkey, {GROUP_SQL} AS is_group, {CATEGORY_SQL} AS is_category, t = '' OR (length(t) <= 4 AND source IS DISTINCT FROM 'vote' AND NOT regexp_matches(t, '[A-Za-z]{{2}}')) AS stray, {SUMMARY_SQL} AS summary,
 CASE WHEN regexp_matches(t, {_sql(groups.NUMBERED)}) THEN translate(regexp_extract(t, {_sql(groups.NUMBERED)}, 1), 'OoIl|SsBbZz', '00111558822') || ' ' || trim(regexp_extract(t, {_sql(groups.NUMBERED)}, 2)) ELSE t END AS category FROM t""")
def row_text_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = _parts(spark, sf_dir, text=LABEL).withColumn("source", F.when(F.col("p_size") % 7 == 0, "vote"))
    text = F.col("text")
    return parts.select(
        "p_partkey", groups.is_group_name(text, FRAGMENTS).alias("is_group"), groups.is_numbered_category(text).alias("is_category"), groups.is_stray(text, F.col("source")).alias("stray"),
        tables.is_summary_line(text).alias("summary"), groups.category_name(text).alias("category"),
    )


CELLS = {"c0": LABEL, "c1": "CASE WHEN p_size % 5 = 0 THEN 'Ltd' WHEN p_size % 5 = 1 THEN 'L.' ELSE '' END", "c2": "CASE WHEN p_size % 4 = 0 THEN 'MD KARIM' WHEN p_size % 4 = 1 THEN '' WHEN p_size % 4 = 2 THEN '7' ELSE 'Sub Total' END", "c3": "CASE WHEN p_size % 3 = 0 THEN '' ELSE CAST(p_retailprice AS STRING) END"}


@query(f"""
WITH p AS (SELECT p_partkey, {", ".join(f"{v} AS {k}" for k, v in CELLS.items())} FROM part),
c AS (SELECT p_partkey, i, CASE i WHEN 0 THEN c0 WHEN 1 THEN c1 WHEN 2 THEN c2 ELSE c3 END AS x FROM p, (SELECT range AS i FROM range(4))),
x AS (SELECT *, regexp_matches(coalesce(x, ''), {_sql(groups.TOTAL_WORD)}) AS total, trim(regexp_replace(coalesce(x, ''), '\\s+', ' ', 'g')) AS t FROM c),
f AS (SELECT *, min(i) FILTER (total) OVER (PARTITION BY p_partkey) AS place FROM x),
k AS (SELECT *, {GROUP_SQL} AS g, length(t) <= 4 AND NOT regexp_matches(t, '[A-Za-z]{{2}}') AS stray FROM f WHERE t <> ''),
m AS (SELECT p_partkey, 'row' AS part, i, t, g, stray FROM k UNION ALL SELECT p_partkey, 'lead', i, t, g, stray FROM k WHERE i < place),
r AS (SELECT p_partkey, part, bool_and(g OR stray) AS clean, min(i) AS first, min(i) FILTER (g) AS first_g, count(*) FILTER (g) AS n FROM m GROUP BY ALL),
s AS (SELECT p_partkey, part, string_agg(CASE WHEN p IS NULL THEN '' WHEN i = p + 1 THEN ' ' ELSE ' · ' END || t, '' ORDER BY i) AS name
 FROM (SELECT *, lag(i) OVER (PARTITION BY p_partkey, part ORDER BY i) AS p FROM m WHERE g) GROUP BY ALL),
o AS (SELECT p_partkey, part, name, replace(name, ' · ', ' ') AS t FROM r JOIN s USING (p_partkey, part) WHERE clean AND first = first_g AND n <= 3),
n AS (SELECT * FROM o WHERE {GROUP_SQL})
SELECT p_partkey, max(name) FILTER (part = 'row') AS name, max(name) FILTER (part = 'lead') AS before_total FROM part LEFT JOIN n USING (p_partkey) GROUP BY 1""")
def group_names_of_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _parts(spark, sf_dir, **CELLS).select("p_partkey", F.array("c0", "c1", "c2", "c3").alias("texts"))
    return rows.select("p_partkey", groups.group_name_of(F.col("texts"), FRAGMENTS).alias("name"), groups.inside_total(F.col("texts"), FRAGMENTS).alias("before_total"))


@query(f"""
WITH p AS (SELECT p_brand, {", ".join(f"{v} AS {k}" for k, v in CELLS.items())}, {PACK} AS c4 FROM part),
c AS (SELECT p_brand, i AS col, CASE i WHEN 0 THEN c0 WHEN 1 THEN c1 WHEN 2 THEN c2 WHEN 3 THEN c3 ELSE c4 END AS x FROM p, (SELECT range::INT AS i FROM range(5)))
SELECT p_brand, col, count(*) FILTER (trim(x) <> '') AS filled, count(*) FILTER (trim(x) <> '' AND regexp_matches(x, {_sql(groups.NUMBER)})) AS numbers,
 filled >= 2 AND numbers >= 0.6 * filled AS is_numeric FROM c GROUP BY 1, 2""")
def numeric_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _parts(spark, sf_dir, **CELLS, c4=PACK).select("p_brand", F.posexplode(F.array("c0", "c1", "c2", "c3", "c4")).alias("col", "text"))
    return tables.numeric_columns(rows, ["p_brand"], "col", "text")


LINE = """CASE o_orderkey % 8 WHEN 0 THEN 'Sub Total: ' || o_totalprice WHEN 1 THEN 'VAT 15% ' || o_custkey WHEN 2 THEN 'Grand Total Tk. 1,' || (100 + o_custkey % 900) || '.50' WHEN 3 THEN 'Less Discount (' || o_custkey || ')' WHEN 4 THEN 'Discount 5%'
 WHEN 5 THEN 'Rebate 2 on 100 : ' || (o_custkey % 100) WHEN 6 THEN 'Gross amount none' ELSE 'Gross Total - ' || o_custkey END"""


@query(f"""
WITH l AS (SELECT o_custkey, o_orderkey, trim({LINE}) AS text FROM orders),
m AS (SELECT *, list_filter(regexp_extract_all(text, '-?\\(?\\d[\\d ,.]*\\)?%?'), lambda x: true) AS found FROM l),
v AS (SELECT *, found[len(found)] AS last FROM m WHERE len(found) > 0 AND NOT (found[len(found)] LIKE '%\\%' ESCAPE '\\' AND len(found) > 1)),
n AS (SELECT *, regexp_replace(last, '[()\\-\\s]', '', 'g') AS d, regexp_matches(trim(last), '^\\(.*\\)$') OR trim(last) LIKE '-%' AS neg, lower(left(text, length(text) - length(last) - length(regexp_extract(text, '([^%)\\d .,]*)$', 1)))) AS before FROM v),
p AS (SELECT *, CASE WHEN regexp_matches(d, '[.,]\\d{{1,2}}$') THEN regexp_replace(regexp_extract(d, '^(.*)[.,]\\d{{1,2}}$', 1), '[.,]', '', 'g') || '.' || regexp_extract(d, '[.,](\\d{{1,2}})$', 1) ELSE regexp_replace(d, '[.,]', '', 'g') END AS q FROM n),
x AS (SELECT *, CASE WHEN regexp_matches(q, '^\\d+(\\.\\d+)?$') THEN (CASE WHEN neg THEN -1 ELSE 1 END) * q::DOUBLE END AS value FROM p),
w AS (SELECT * FROM (VALUES ('subtotal', 0, 'sub total'), ('subtotal', 1, 'subtotal'), ('subtotal', 2, 'sub-total'), ('subtotal', 3, 'gross amount'), ('subtotal', 4, 'gross total'), ('subtotal', 5, 'total before'),
 ('discount', 10, 'discount'), ('discount', 11, 'less discount'), ('discount', 12, 'disc.'), ('discount', 13, 'rebate'), ('tax', 20, 'vat'), ('tax', 21, 'gst'), ('tax', 22, 'tax'), ('total', 30, 'grand total'), ('total', 31, 'total')) AS w(key, pos, word)),
h AS (SELECT o_custkey, o_orderkey, value, key, word FROM x JOIN w ON contains(before, word) WHERE value IS NOT NULL QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY pos) = 1)
SELECT o_custkey, key, round(value, 2) AS value FROM h QUALIFY row_number() OVER (PARTITION BY o_custkey, key ORDER BY length(word) DESC, o_orderkey) = 1""")
def summary_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "orders").selectExpr("o_custkey", "o_orderkey", f"{LINE} AS text")
    return tables.summary_values(lines, ["o_custkey"], "o_orderkey", "text", SUMMARY_WORDS)


#: The words of each summary key, the earlier key first.
SUMMARY_WORDS = {
    "subtotal": ("sub total", "subtotal", "sub-total", "gross amount", "gross total", "total before"), "discount": ("discount", "less discount", "disc.", "rebate"),
    "tax": ("vat", "gst", "tax"), "total": ("grand total", "total"),
}


TITLE = """CASE p_partkey % 18 WHEN 0 THEN 'Qty' WHEN 1 THEN 'Unit Price' WHEN 2 THEN 'Rate (' || p_size || ')' WHEN 3 THEN 'Description of goods' WHEN 4 THEN 'VAT %' WHEN 5 THEN 'Net Amount' WHEN 6 THEN 'SL' WHEN 7 THEN 'Batch No.' WHEN 8 THEN 'Line  Total'
 WHEN 9 THEN 'Expiry date' WHEN 10 THEN 'Discount' WHEN 11 THEN 'Tax amount' WHEN 12 THEN '' WHEN 13 THEN NULL WHEN 14 THEN p_name WHEN 15 THEN 'Grand total and terms' WHEN 16 THEN 'Thank you, bank swift' ELSE 'TP + VAT per pack' END"""
# The words that name a column's role, and those that name a region.
HEADER_WORDS = {
    "SL": ["sl no", "s/n", "sr no", "serial", "item no", "sl.", "sl", "#", "no."],
    "DESCRIPTION": ["description", "particulars", "item name", "product", "medicine", "goods", "service", "item", "name"],
    "CODE": ["hsn", "sac", "sku", "barcode", "batch", "code", "part no"],
    "QTY": ["quantity", "qty", "qnty", "pcs", "nos", "units", "count"],
    "UNIT": ["uom", "unit of", "pack size", "unit"],
    "UNIT_PRICE": ["unit price", "u.price", "rate", "price", "mrp", "per unit", "unit rate"],
    "DISCOUNT": ["discount", "disc", "less"],
    "TAX_RATE": ["vat %", "gst %", "tax %", "vat rate", "gst rate", "rate %", "tax rate"],
    "TAX_AMOUNT": ["vat amount", "gst amount", "tax amount", "vat amt", "gst amt", "vat", "gst", "tax"],
    "AMOUNT": ["line total", "net amount", "amount", "total", "value", "taka", "amt"],
    "DATE": ["date", "expiry", "exp date", "mfg"],
}
REGION_WORDS = {
    "SUMMARY": ["sub total", "subtotal", "grand total", "net total", "net amount", "total amount", "amount due", "balance due", "amount payable", "in words", "total :", "total"],
    "TAX": ["vat", "gst", "cgst", "sgst", "igst", "tax", "ait", "tds", "supplementary duty", "sd @", "cess"],
    "PAYMENT": ["payment", "bank", "account no", "a/c no", "ifsc", "swift", "due date", "terms", "cheque", "paid via", "upi", "mobile banking"],
    "FOOTER": ["thank you", "authorised signat", "authorized signat", "signature", "terms and conditions", "e&oe", "e & o e", "computer generated", "this is a system"],
}


def _lexicon(words: dict[str, list[str]]) -> str:
    return "(SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{w}')" for k, ws in words.items() for w in ws) + ") AS l(name, word))"


@query(f"""
WITH t AS (SELECT p_partkey, trim(regexp_replace(lower(coalesce({TITLE}, '')), '\\s+', ' ', 'g')) AS t FROM part)
SELECT p_partkey, name, max((CASE WHEN t = word THEN 1.0::DOUBLE ELSE 0.75::DOUBLE END) * least(1.0::DOUBLE, 0.4::DOUBLE + length(word) / 14.0::DOUBLE)) AS score FROM t JOIN {_lexicon(HEADER_WORDS)} ON contains(t, word) GROUP BY 1, 2""")
def header_label_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.trim(F.regexp_replace(F.lower(F.coalesce("title", F.lit(""))), r"\s+", " "))
    return tables.lexicon_scores(_parts(spark, sf_dir, title=TITLE).select("p_partkey", title.alias("t")), ["p_partkey"], "t", HEADER_WORDS, lambda t, w: F.when(t == w, 1.0).otherwise(0.75) * F.least(F.lit(1.0), 0.4 + F.length(w) / 14.0))


@query(f"""
WITH t AS (SELECT p_partkey, lower(coalesce({TITLE}, '')) AS t FROM part)
SELECT p_partkey, name, max(length(word) / 20.0::DOUBLE) AS score FROM t JOIN {_lexicon(REGION_WORDS)} ON contains(t, word) GROUP BY 1, 2""")
def region_keyword_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.lexicon_scores(_parts(spark, sf_dir, title=TITLE).select("p_partkey", F.lower(F.coalesce("title", F.lit(""))).alias("t")), ["p_partkey"], "t", REGION_WORDS, lambda t, w: F.length(w) / 20.0)


PAGE_LINE = "CASE o_orderkey % 7 WHEN 0 THEN 'Page No. ' || (o_custkey % 40) || ' of 30' WHEN 1 THEN 'Pg. ' || (o_custkey % 10) WHEN 2 THEN (o_custkey % 20) || ' of 15 pages' WHEN 3 THEN 'Page :4/|' WHEN 4 THEN 'total 17' WHEN 5 THEN 'page  # 1|' ELSE NULL END"
PAGE_1 = r"(?i)\bp(?:age|g)\.?\s*(?:no\.?|number|#)?\s*[:.\-]?\s*(\d{1,3})\s*(?:of|/|\\|out of)\s*(\d{1,3})\b"
PAGE_2 = r"(?i)\bp(?:age|g)\.?\s*(?:no\.?|number|#)?\s*[:.\-]?\s*(\d{1,3})\b"
PAGE_3 = r"(?i)\b(\d{1,3})\s*(?:of|/)\s*(\d{1,3})\s*p(?:age|g)s?\b"


@query(f"""
WITH t AS (SELECT o_custkey, o_orderkey, regexp_replace(replace({PAGE_LINE}, '|', '1'), '\\s+', ' ', 'g') AS t FROM orders),
c AS (SELECT *, 1 AS k, regexp_extract(t, {_sql(PAGE_1)}, 1) AS p, regexp_extract(t, {_sql(PAGE_1)}, 2) AS n FROM t UNION ALL SELECT *, 2, regexp_extract(t, {_sql(PAGE_2)}, 1), '' FROM t UNION ALL
 SELECT *, 3, regexp_extract(t, {_sql(PAGE_3)}, 1), regexp_extract(t, {_sql(PAGE_3)}, 2) FROM t),
h AS (SELECT o_custkey, o_orderkey, k, p::INT AS page, try_cast(nullif(n, '') AS INT) AS n FROM c WHERE p <> '' AND p::INT >= 1 AND regexp_matches(t, '(?i)p(?:age|g)'))
SELECT o_custkey, page, CASE WHEN n >= page THEN n END AS pages FROM h QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey, k) = 1""")
def page_number_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "orders").selectExpr("o_custkey", "o_orderkey", f"{PAGE_LINE} AS text")
    return tables.page_numbers(lines, ["o_custkey"], "o_orderkey", "text", [PAGE_1, PAGE_2, PAGE_3])


@query("""
WITH p AS (SELECT p_brand, p_partkey, 1 + (p_size + 0) AS v, p_partkey % 9 AS kind FROM part),
c AS (SELECT p_brand, 0 AS col, p_partkey, CAST(p_size AS VARCHAR) AS t FROM part UNION ALL SELECT p_brand, 1, p_partkey, CAST(p_partkey + 10000 AS VARCHAR) FROM part
 UNION ALL SELECT p_brand, 2, p_partkey, CASE WHEN p_size % 3 = 0 THEN '1,0' || p_size ELSE '0' END FROM part UNION ALL SELECT p_brand, 3, p_partkey, CAST(p_retailprice AS VARCHAR) FROM part
 UNION ALL SELECT p_brand, 4, p_partkey, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS VARCHAR) FROM part),
n AS (SELECT *, CASE WHEN regexp_matches(replace(t, ',', ''), '^\\d+$') THEN replace(t, ',', '')::BIGINT END AS x FROM c WHERE trim(t) <> ''),
s AS (SELECT *, x - lag(x) OVER (PARTITION BY p_brand, col ORDER BY p_partkey) AS step FROM n WHERE x IS NOT NULL),
a AS (SELECT p_brand, col, count(*) AS filled, count(x) AS nums, count(*) FILTER (x = 0) AS zeros, count(*) FILTER (regexp_matches(t, '^\\d{4,}$')) AS codes, list_sort(list(x) FILTER (x IS NOT NULL))[count(x) // 2 + 1] AS med FROM n GROUP BY 1, 2),
b AS (SELECT p_brand, col, count(*) FILTER (step = 1) AS steps FROM s GROUP BY 1, 2)
SELECT p_brand, CAST(col AS INT) AS col, med AS median FROM a JOIN b USING (p_brand, col) WHERE filled >= 3 AND nums >= 0.8 * filled AND zeros <= 0.5 * nums AND codes <= 0.5 * filled AND NOT (nums >= 4 AND steps >= 0.8 * (nums - 1)) AND med <= 9999
QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY med, col) = 1""")
def quantity_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    serial = F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey"))
    odd = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("1,0"), F.col("p_size").cast("string"))).otherwise("0")
    numbered = part.withColumn("serial", serial)
    cells = F.array(F.col("p_size").cast("string"), (F.col("p_partkey") + 10000).cast("string"), odd, F.col("p_retailprice").cast("string"), F.col("serial").cast("string"))
    return tables.quantity_column(numbered.select("p_brand", "p_partkey", F.posexplode(cells).alias("col", "text")), ["p_brand"], "col", "p_partkey", "text")


WORDS = "SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM benchmark"


@query("""
WITH t AS (SELECT DISTINCT unnest(string_split(lower(p_name || ' ' || p_type || ' qtv inv quantlty unit'), ' ')) AS w FROM part),
q AS (SELECT unnest(['qty', 'qnt', 'qnty', 'qtty', 'quantity', 'quan', 'qte', 'invqty', 'qy']) AS q)
SELECT w AS word, bool_or(w = q OR (length(w) >= 3 AND length(q) >= 3 AND levenshtein(w, q) <= 1)) AS is_quantity FROM t, q GROUP BY 1""")
def quantity_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lower(F.concat_ws(" ", "p_name", "p_type")), F.lit(" qtv inv quantlty unit"))
    words = table(spark, sf_dir, "part").select(F.explode(F.split(text, " ")).alias("word")).distinct()
    return words.select("word", tables.is_quantity_word(F.col("word")).alias("is_quantity"))


VOCABULARY = [("name", "Product Name"), ("name", "Description"), ("tp", "Unit Price"), ("net", "Net Amount"), ("batch", "Batch No"), ("total", "Line Total"), ("disc", "Discount"), ("expiry", "Expiry Date"), ("vat", "VAT")]
HEADING = """CASE p_partkey % 11 WHEN 0 THEN 'Category & Produdt Name' WHEN 1 THEN 'Inv. Qty' WHEN 2 THEN 'Unit  Price' WHEN 3 THEN 'Net Amuont' WHEN 4 THEN 'Batch No.' WHEN 5 THEN 'Line Total Amount' WHEN 6 THEN 'Discouut' WHEN 7 THEN 'Expiry Date' WHEN 8 THEN 'VAT'
 WHEN 9 THEN p_name ELSE 'Descriptlon of ' || p_size END"""
_TOKENS = "list_filter(regexp_split_to_array(lower(coalesce({}, '')), '[^a-z0-9]+'), lambda x: x <> '')"


@query(f"""
WITH h AS (SELECT p_partkey, {_TOKENS.format(HEADING)} AS toks FROM part),
v AS (SELECT key, label, {_TOKENS.format("label")} AS lt, pos FROM (VALUES {", ".join(f"({i}, '{k}', '{w}')" for i, (k, w) in enumerate(VOCABULARY))}) AS v(pos, key, label)),
m AS (SELECT p_partkey, key, label, pos, len(lt) AS n, len(list_filter(lt, lambda a: list_contains(toks, a))) AS exact,
 len(list_filter(lt, lambda a: len(list_filter(toks, lambda b: a = b OR (length(a) >= 4 AND levenshtein(a, b) <= 1))) > 0)) AS hit FROM h, v),
b AS (SELECT p_partkey, key, n, pos FROM m WHERE hit = n QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY n DESC, pos) = 1),
e AS (SELECT p_partkey, max(struct_pack(n := n, exact := exact)) AS best FROM m WHERE hit = n GROUP BY 1)
SELECT h.p_partkey, CASE WHEN len(list_filter(toks, lambda t: len(list_filter(['qty', 'qnt', 'qnty', 'qtty', 'quantity', 'quan', 'qte', 'invqty', 'qy'], lambda q: t = q OR (length(t) >= 3 AND length(q) >= 3 AND levenshtein(t, q) <= 1))) > 0) THEN 'qty' ELSE b.key END AS key,
 coalesce(e.best.n, 0)::INT AS label_words, coalesce(e.best.exact, 0)::INT AS exact FROM h LEFT JOIN b USING (p_partkey) LEFT JOIN e ON e.p_partkey = h.p_partkey""".replace("> 0) THEN 'qty'", "> 0)) > 0 THEN 'qty'"))
def column_keys_of_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.keys_of_titles(_parts(spark, sf_dir, title=HEADING).select("p_partkey", "title"), "p_partkey", "title", VOCABULARY)
