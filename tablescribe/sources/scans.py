"""Results of recognisers as tables: TSV, hOCR, service answers, word lists, frequency tables, ground truth.

Readers take a path or glob that Spark can read; every row keeps the file it came from.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TSV = "level int, page_num int, block_num int, par_num int, line_num int, word_num int, left double, top double, width double, height double, conf double, text string"
#: What a service answers, as far as it is read.
ANSWER = """depth string, brief struct<lines array<struct<text string, confidence double, bbox struct<x0 int, y0 int, x1 int, y1 int>>>>,
 deep struct<rows array<struct<index int, cells array<struct<col int, text string, confidence double, bbox struct<x0 int, y0 int, x1 int, y1 int>>>>>>,
 engines array<struct<name string, status string, ms long, characters array<struct<text string, confidence double, word int, bbox struct<x0 int, y0 int, x1 int, y1 int>>>>>"""


def read_tsv(spark: SparkSession, path: str) -> DataFrame:
    """Words of a recogniser's TSV (level 5): file, line keys, box, confidence 0 .. 100 and text; blank texts and negative
    confidences drop out, a broken line too."""
    rows = spark.read.csv(path, sep="\t", header=True, schema=TSV, quote="", mode="DROPMALFORMED").withColumn("file", F.input_file_name())
    words = rows.where((F.col("level") == 5) & (F.col("conf") >= 0) & (F.trim(F.coalesce("text", F.lit(""))) != ""))
    return words.select("file", "page_num", "block_num", "par_num", "line_num", "word_num", F.col("left").alias("x0"), F.col("top").alias("y0"), (F.col("left") + F.col("width")).alias("x1"), (F.col("top") + F.col("height")).alias("y1"), F.col("conf").alias("confidence"), "text")


def hocr_words(pages: DataFrame, id_col: str, html: str) -> DataFrame:
    """(id, place, x0, y0, x1, y1, confidence, text) of each word span of hOCR pages; markup inside a word is dropped."""
    word = r"(?s)<span[^>]*class=['\"]ocrx_word['\"][^>]*title=['\"]bbox (\d+) (\d+) (\d+) (\d+)(?:;[^'\"]*x_wconf (\d+))?[^'\"]*['\"][^>]*>(.*?)</span>"
    spans = pages.select(F.col(id_col), F.posexplode(F.regexp_extract_all(html, F.lit(word), F.lit(0))).alias("place", "s"))
    part = lambda k: F.regexp_extract("s", word, k)
    text = F.trim(F.regexp_replace(part(6), "<[^>]*>", ""))
    return spans.select(id_col, "place", *[part(k + 1).try_cast("double").alias(c) for k, c in enumerate(("x0", "y0", "x1", "y1"))], part(5).try_cast("double").alias("confidence"), text.alias("text")).where("text != ''")


def answers(df: DataFrame, id_col: str, json: str) -> DataFrame:
    return df.select(F.col(id_col), F.from_json(json, ANSWER).alias("a"))


def engine_readings(df: DataFrame, id_col: str, json: str) -> DataFrame:
    """(id, engine, status, ms, text, confidence, x0, y0, x1, y1): each engine's characters; an engine without any keeps one row."""
    engines = answers(df, id_col, json).select(id_col, F.explode("a.engines").alias("e"))
    each = engines.select(id_col, F.col("e.name").alias("engine"), "e.status", "e.ms", F.explode_outer("e.characters").alias("c"))
    return each.select(id_col, "engine", "status", "ms", "c.text", "c.confidence", "c.bbox.x0", "c.bbox.y0", "c.bbox.x1", "c.bbox.y1")


def regions(df: DataFrame, id_col: str, json: str) -> DataFrame:
    """(id, place, text, confidence, box): the lines of a brief answer, else the cells of a deep one."""
    lines = F.transform("a.brief.lines", lambda x: F.struct(x["text"].alias("text"), x["confidence"].alias("confidence"), x["bbox"].alias("box")))
    cells = F.flatten(F.transform("a.deep.rows", lambda r: F.transform(r["cells"], lambda x: F.struct(x["text"].alias("text"), x["confidence"].alias("confidence"), x["bbox"].alias("box")))))
    found = F.coalesce(F.when(F.size("a.brief.lines") > 0, lines), cells)
    return answers(df, id_col, json).select(id_col, F.posexplode(found).alias("place", "r")).select(id_col, "place", "r.text", "r.confidence", "r.box")


def read_words(spark: SparkSession, path: str) -> DataFrame:
    """(word): the distinct lower-cased lines of word lists, blank ones left out."""
    return spark.read.text(path).select(F.lower(F.trim("value")).alias("word")).where("word != ''").distinct()


def read_trigrams(spark: SparkSession, path: str) -> DataFrame:
    """(a, b, c, n) of JSON objects that map "a|b|c" to a count; other keys drop out."""
    pairs = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string, double>")).alias("key", "n"))
    parts = F.split("key", r"\|")
    return pairs.where(F.size(parts) == 3).select(*[F.get(parts, F.lit(i)).alias(c) for i, c in enumerate("abc")], "n")


def ground_truth(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(images, annotations) of JSON files {images: [...], annotations: [...]}."""
    schema = "images array<struct<id string, url string, width int, height int>>, annotations array<struct<id string, imageId string, label string, bbox array<double>>>"
    files = spark.read.schema(schema).json(path, multiLine=True)
    return files.select(F.explode("images").alias("i")).select("i.*"), files.select(F.explode("annotations").alias("a")).select("a.*")


def faults(images: DataFrame, annotations: DataFrame) -> DataFrame:
    """(id, fault): annotations without an id, image or label, of an image that isn't there, or without a positive box."""
    known = images.select(F.col("id").alias("__i")).where("__i is not null").distinct()
    joined = annotations.join(known, F.col("imageId") == F.col("__i"), "left")
    box = (F.size("bbox") == 4) & (F.get("bbox", F.lit(2)) > 0) & (F.get("bbox", F.lit(3)) > 0)
    checks = [("id", F.col("id").isNull()), ("image", F.col("imageId").isNull() | F.col("__i").isNull()), ("label", F.coalesce("label", F.lit("")) == ""), ("box", ~F.coalesce(box, F.lit(False)))]
    return joined.select("id", F.explode(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in checks]))).alias("fault"))
