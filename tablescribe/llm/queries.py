"""The queries of this subpackage: opN_<name> for each operator, over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tablescribe.llm import alignment, conversations, html_text, lines, mixing, multi_index, packing, ppm, repeats, secret_scan, simhash, tokens, toxicity

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
BYTES, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = lines.evaluate(_table(spark, sf_dir, "documents").select("doc_id", "text"), with_text=False)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_failed_lines", "chars_lost")


def op2_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.round_trip(_table(spark, sf_dir, "documents").select("doc_id", "text"), TOKENIZER, end_id=2)


def op3_embedding_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multi_index.near_duplicates(_table(spark, sf_dir, "embeddings"), cosine=0.9)


def op4_simhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_pack_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents").select("doc_id", "text"), TOKENIZER, end_id=1, window=2048)


def op7_ppm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.score(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op9_remove_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(_table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.score(docs, _table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


def op11_align_tokenizers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(_table(spark, sf_dir, "documents").select("doc_id", "text"), BYTES, PIECES)


def op12_repair_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair(_table(spark, sf_dir, "conversations"))


def op13_extract_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_table(spark, sf_dir, "pages"))


QUERIES = {f.__name__: f for f in (op1_line_quality, op2_token_shards, op3_embedding_near_duplicates, op4_simhash_near_duplicates, op5_secret_scan, op6_pack_windows, op7_ppm_scores, op8_mix_sources, op9_remove_repeats, op10_toxicity, op11_align_tokenizers, op12_repair_conversations, op13_extract_html)}


def _pattern(p: str) -> str:
    r"""A pattern of Python's re for DuckDB: its \W knows ASCII only."""
    return "'(?i)" + p.replace(r"\W", r"[^\p{L}\p{N}_]").replace("'", "''") + "'"


_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
_BODY_WORDS = r"regexp_extract_all({}, '[^\s\x1C-\x1F\x85\xA0]+')"
OP1_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), w AS (SELECT doc_id, text, {_WORDS.format("text")} AS w FROM d),
t AS (SELECT doc_id, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w)), k AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM t),
r AS (SELECT doc_id, count(DISTINCT i + j) AS n_repeat FROM k, (SELECT range AS j FROM range(3)) WHERE n > 1 GROUP BY 1),
l AS (SELECT doc_id, j, s[j] AS line FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS j FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM d))),
b AS (SELECT doc_id, j, line, array_to_string({_WORDS.format("line")}, '') AS solid, {_BODY_WORDS.format("line")} AS bw FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
f AS (SELECT *, array_to_string(bw, '') AS body, length(regexp_replace(array_to_string(bw, ''), '[^\p{{L}}\p{{N}}]', '', 'g')) < {lines.Rules().least_letters} * length(array_to_string(bw, ''))
 OR len(list_filter(bw, lambda x: regexp_matches(x, '[#*$%&|<>]'))) > greatest(1, {lines.Rules().most_symbols} * len(bw)) OR regexp_matches(trim(line), {_pattern(lines._NAVIGATION.pattern)}) OR regexp_matches(line, {_pattern(lines._BOILERPLATE.pattern)}) AS bad FROM b),
g AS (SELECT *, len(bw) > 0 AND (bad OR row_number() OVER (PARTITION BY doc_id, trim(line), bad ORDER BY j) > 1) AS fails FROM f),
s AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup, count(*) FILTER (fails) AS n_failed, coalesce(sum(length(solid)) FILTER (fails), 0)::BIGINT AS lost FROM g GROUP BY 1),
x AS (SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_dup, 0) AS n_dup_lines, coalesce(n_repeat, 0) AS n_repeat_words,
 coalesce(n_failed, 0) AS n_failed_lines, coalesce(lost, 0) AS chars_lost FROM w LEFT JOIN r USING (doc_id) LEFT JOIN s USING (doc_id)),
y AS (SELECT *, n_words < {lines.Rules().least_words} OR n_repeat_words > {lines.Rules().most_repeated} * n_words AS base_failed FROM x)
SELECT *, NOT base_failed AND chars_lost <= {lines.Rules().most_lost} * word_chars AS kept FROM y"""

OP3_SQL = """
WITH RECURSIVE e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), u AS (SELECT vec_id, v, sqrt(list_dot_product(v, v)) AS n FROM e WHERE v IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND a.n > 0 AND b.n > 0 AND list_dot_product(a.v, b.v) / (a.n * b.n) >= 0.9),
r(node, root) AS (SELECT vec_id, vec_id FROM e UNION SELECT p.b, r.root FROM r JOIN p ON p.a = r.node WHERE r.root < p.b),
c AS (SELECT node AS vec_id, min(root) AS component_id FROM r GROUP BY 1), k AS (SELECT a AS vec_id, count(*) AS n FROM p GROUP BY 1)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM c LEFT JOIN k USING (vec_id)"""

OP8_SQL = rf"""
WITH d AS (SELECT doc_id, source, coalesce(len({_WORDS.format("text")}), 0) AS size, md5('17/' || doc_id) AS h FROM documents), t AS (SELECT source, sum(size)::BIGINT AS source_size, ceil(count(*) / 4096)::BIGINT AS shards FROM d GROUP BY 1),
w AS (SELECT *, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w, 2.0::DOUBLE * source_size AS most FROM t),
v AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(most) OVER (ORDER BY most / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (ORDER BY most / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
a AS (SELECT source, source_size, shards, CASE WHEN most <= w * level THEN most ELSE w * max(level) FILTER (most > w * level) OVER () END AS target FROM v), n AS (SELECT *, floor(sum(target) OVER () / 64 + 0.5)::BIGINT AS seats FROM a),
q AS (SELECT source, target / (2 * k + 1) AS q, k, seats FROM (SELECT *, unnest(range(0, seats + 1)) AS k FROM n WHERE target > 0) WHERE k <= 2 * target / 64 + 4),
c AS (SELECT source, count(*) AS quota FROM (SELECT * FROM q QUALIFY row_number() OVER (ORDER BY q DESC, source NULLS LAST, k) <= seats) GROUP BY 1),
p AS (SELECT d.*, n.source_size, n.target, coalesce(c.quota, 0) AS source_quota, ('0x' || left(h, 12))::BIGINT % n.shards AS shard FROM d JOIN n ON d.source IS NOT DISTINCT FROM n.source LEFT JOIN c ON d.source IS NOT DISTINCT FROM c.source),
z AS (SELECT source, shard, sum(size)::BIGINT AS shard_words, any_value(source_quota) AS seats FROM p GROUP BY 1, 2),
zq AS (SELECT source, shard, shard_words / (2 * k + 1) AS q, k, seats FROM (SELECT *, unnest(range(0, seats + 1)) AS k FROM z WHERE shard_words > 0)),
zc AS (SELECT source, shard, count(*) AS quota FROM (SELECT * FROM zq QUALIFY row_number() OVER (PARTITION BY source ORDER BY q DESC, shard, k) <= seats) GROUP BY 1, 2),
b AS (SELECT z.source, z.shard, greatest(1, ceil(z.shard_words / 64))::BIGINT AS blocks, least(coalesce(zc.quota, 0), 2 * greatest(1, ceil(z.shard_words / 64))::BIGINT) AS quota FROM z LEFT JOIN zc ON z.source IS NOT DISTINCT FROM zc.source AND z.shard = zc.shard),
o AS (SELECT *, quota // blocks AS whole, quota % blocks AS rest, ('0x' || left(md5('17 spin/' || coalesce(source, '') || '/' || shard), 12))::BIGINT % blocks AS spin FROM b),
m AS (SELECT p.*, o.blocks, o.whole, o.rest, o.spin, sum(size) OVER (PARTITION BY p.source, p.shard ORDER BY h, doc_id, size ROWS UNBOUNDED PRECEDING)::BIGINT AS last FROM p JOIN o ON p.source IS NOT DISTINCT FROM o.source AND p.shard = o.shard),
e AS (SELECT *, last // 64 AS lb, (last - size) // 64 AS fb FROM m)
SELECT doc_id, size, source_size, target, (whole * size
 + ((lb * rest + spin) // blocks) * 64 + (last - lb * 64) * (((lb + 1) * rest + spin) // blocks - (lb * rest + spin) // blocks)
 - ((fb * rest + spin) // blocks) * 64 - (last - size - fb * 64) * (((fb + 1) * rest + spin) // blocks - (fb * rest + spin) // blocks))::BIGINT AS taken FROM e"""

#: What DuckDB's SQL can say of the operators; hash functions, tokenizers and models it can't.
ORACLES: dict[str, str] = {"op1_line_quality": OP1_SQL, "op3_embedding_near_duplicates": OP3_SQL, "op8_mix_sources": OP8_SQL}
