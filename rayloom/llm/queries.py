"""The registered queries over the driver's tables, and their SQL where SQL can say it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rayloom.llm import (
    collocations,
    decontaminate,
    hard_negatives,
    lang_zstd,
    license_scan,
    line_dedup,
    quality_nbsvm,
    simhash_dedup,
    slot_sharding,
    source_mix,
    topk_search,
    toxicity,
    url_rules,
)
from rayloom.llm.common import id_fold, scratch_dir, table

RULES = (
    url_rules.Rule("com", "/", "allow"),
    url_rules.Rule("example.com", "/en/", "block"),
    url_rules.Rule("www.example.com", "/en/", "allow"),
    url_rules.Rule("net", "/es/", "block"),
    url_rules.Rule("net", "/fr/", "block"),
)
KEEP_AT = 0.7


def op1_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.exact_top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = source_mix.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op3_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_dedup.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash_dedup.fingerprint_hex("fp").alias("fingerprint"), "component_id")


def sharded(docs: DataFrame) -> DataFrame:
    """``docs`` in 8 shards; version 1 of the slot map is stored in the shared folder."""
    placed = slot_sharding.shard(docs, 8, map_path=f"{scratch_dir(docs.sparkSession)}/slot-map-{uuid.uuid4().hex}")
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
        F.col("vslot").alias("virtual_slot"), "map_version",
    )


def op4_slot_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharded(table(spark, sf_dir, "documents"))


def op5_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_rules.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), RULES)
    return judged.select("row.page_id", "host", "path", "rule", "verdict")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return clean.select("doc_id", "n_lines", "n_removed", F.md5("clean_text").alias("clean_md5"))


def op7_quality_nbsvm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality_nbsvm.fit(docs, table(spark, sf_dir, "labels"), ~id_fold("doc_id", 4, 2))
    scored = quality_nbsvm.score(docs, model)
    keep = (F.col("score") >= KEEP_AT).cast("int")
    return scored.select("doc_id", id_fold("doc_id", 4, 2).alias("held_out"), "score", keep.alias("predicted"))


def op8_lang_zstd(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    contents = lang_zstd.dictionaries(docs, ~id_fold("doc_id", 3, 1))
    found = lang_zstd.identify(docs, contents)
    return found.select("doc_id", id_fold("doc_id", 3, 1).alias("held_out"), "lang_pred", "score", "rejected")


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, sf_dir, "documents"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        decontaminate.items_digest(F.col("items")).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), ~id_fold("doc_id", 5, 0))
    toxic = (F.col("score") >= 0.5).cast("int")
    return toxicity.score(docs, model).select("doc_id", id_fold("doc_id", 5, 0).alias("held_out"), "score", toxic.alias("predicted"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine_phrases(table(spark, sf_dir, "documents"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    noisy = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, noisy)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    found = {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}
    return found | {"pipeline": corpus_pipeline.run}


_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1_SQL = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024.0::DOUBLE * x::DOUBLE)::BIGINT) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
      FROM e q, e c WHERE q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""

OP2_SQL = f"""
WITH d AS (SELECT doc_id, source, coalesce(len({_WORDS.format("text")}), 0)::BIGINT AS size, md5('17:' || coalesce(doc_id::VARCHAR, 'null')) AS key FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, count(*) AS n FROM d GROUP BY source),
w AS (SELECT *, (CASE (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END)::BIGINT AS weight FROM s),
f AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(source_size * 3) OVER (ORDER BY source_size::DOUBLE / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS unused,
      (sum(weight) OVER (ORDER BY source_size::DOUBLE / weight, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS heavy FROM w),
g AS (SELECT *, (source_size * 3)::HUGEINT * heavy >= weight::HUGEINT * unused AS fits FROM f),
lv AS (SELECT arg_min(unused::DOUBLE / heavy::DOUBLE, (source_size::DOUBLE / weight, source)) AS level FROM g WHERE fits),
t AS (SELECT source, source_size, n, CASE WHEN fits THEN weight::DOUBLE * level ELSE (source_size * 3)::DOUBLE END AS target FROM g, lv),
h AS (SELECT d.doc_id, d.source, d.size, d.key, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0::DOUBLE END AS share,
      ('0x' || substr(d.key, 1, 8))::BIGINT % ceil(t.n / 4096.0)::BIGINT AS bucket FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
b AS (SELECT *, floor(share) AS whole, share - floor(share) AS part, sum(size) OVER (PARTITION BY source, bucket ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) AS run,
      sum(size) OVER (PARTITION BY source, bucket) AS bucket_size FROM h)
SELECT doc_id, size, source_size, target, (size * (whole + CASE WHEN part > 0 AND (run * 2 - size)::DOUBLE <= part * bucket_size * 2 THEN 1 ELSE 0 END))::BIGINT AS taken FROM b
"""

OP5_SQL = f"""
WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, {_LOWER.format("regexp_extract(rest, '^([^/?#]*)', 1)")} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r AS (SELECT * FROM (VALUES {", ".join(f"('{r.host}', '{r.path}', '{r.verdict}')" for r in RULES)}) v(rule_host, rule_path, verdict)),
m AS (SELECT p.*, r.rule_host || r.rule_path AS rule, r.verdict FROM p LEFT JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)),
k AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY length(rule) DESC NULLS LAST) AS n FROM m)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM k WHERE n = 1
"""

OP6_SQL = """
WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents),
x AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) - 1 AS pos FROM l),
w AS (SELECT doc_id, pos, trim(line, ' ') AS a, lead(trim(line, ' ')) OVER d AS b, lead(trim(line, ' '), 2) OVER d AS c FROM x WINDOW d AS (PARTITION BY doc_id ORDER BY pos)),
v AS (SELECT * FROM w WHERE c IS NOT NULL AND (a <> '' OR b <> '' OR c <> '')),
o AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, pos) AS n FROM v),
g AS (SELECT DISTINCT doc_id, pos + unnest([0, 1, 2]) AS pos FROM o WHERE n > 1),
k AS (SELECT x.doc_id, count(*) AS n_lines, count(g.pos) AS n_removed, coalesce(string_agg(x.line, chr(10) ORDER BY x.pos) FILTER (g.pos IS NULL), '') AS clean
      FROM x LEFT JOIN g USING (doc_id, pos) GROUP BY x.doc_id)
SELECT l.doc_id, coalesce(n_lines, 0)::INT AS n_lines, coalesce(n_removed, 0)::INT AS n_removed, CASE WHEN l.text IS NOT NULL THEN md5(clean) END AS clean_md5 FROM l LEFT JOIN k USING (doc_id)
"""

_TEMPLATES = ", ".join(f"('{n}', '{t}')" for n, t in license_scan.TEMPLATES.items())


def _words(text: str) -> str:
    return f"string_split(trim(regexp_replace({_LOWER.format(text)}, '[^0-9a-z\\x{{80}}-\\x{{10FFFF}}]+', ' ', 'g'), ' '), ' ')"


def _grams(words: str) -> str:
    return f"list_transform(range(1, len({words})), lambda i: {words}[i] || ' ' || {words}[i + 1])"


OP9_SQL = f"""
WITH t AS (SELECT name, list_distinct({_grams("w")}) AS grams FROM (SELECT name, {_words("body")} AS w FROM (VALUES {_TEMPLATES}) v(name, body))),
i AS (SELECT unnest(grams) AS gram, name, len(grams) AS size, 1 + least({license_scan.GAP}, len(grams) // 4) AS gap FROM t),
d AS (SELECT doc_id, {_words("text")} AS w FROM documents),
g AS (SELECT doc_id, unnest({_grams("w")}) AS gram, generate_subscripts({_grams("w")}, 1) AS pos FROM d),
k AS (SELECT doc_id, name, pos, gram, size, gap, pos - lag(pos) OVER (PARTITION BY doc_id, name ORDER BY pos) AS apart FROM g JOIN i USING (gram)),
b AS (SELECT *, unnest([1, gap]) AS reach FROM k),
r AS (SELECT *, sum(CASE WHEN apart <= reach THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, name, reach ORDER BY pos) AS run FROM b),
p AS (SELECT doc_id, name, count(DISTINCT gram) AS common, max(pos) - min(pos) + 1 - count(*) + count(DISTINCT gram) AS passage, any_value(size) AS size FROM r GROUP BY doc_id, name, reach, run),
s AS (SELECT doc_id, name, max(common * 2.0::DOUBLE / (passage + size)) AS dice, any_value(size) AS size FROM p GROUP BY doc_id, name),
h AS (SELECT doc_id, count(*)::INT AS n_matches, max(dice) AS dice, arg_min(name, (-dice, -size, name)) AS license FROM s WHERE dice >= 0.8::DOUBLE GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_matches, 0) AS n_matches, license, dice FROM d LEFT JOIN h USING (doc_id)
"""

_TOKENS = f"regexp_extract_all({_LOWER.format('{}')}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

OP10_SQL = f"""
WITH b AS (SELECT item_id, {_TOKENS.format("text")} AS w FROM benchmark),
i AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[k : k + least(10, len(w)) - 1], ' ') AS win
      FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS k FROM b WHERE len(w) > 0)),
d AS (SELECT doc_id, coalesce({_TOKENS.format("text")}, []) AS w FROM documents),
z AS (SELECT DISTINCT n FROM i),
x AS (SELECT doc_id, n, k, array_to_string(w[k : k + n - 1], ' ') AS win FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, z WHERE len(w) >= n)),
m AS (SELECT DISTINCT x.doc_id, x.k, x.n, i.item_id FROM x JOIN i ON x.win = i.win AND x.n = i.n),
c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM m) GROUP BY doc_id),
y AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM m) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN y USING (doc_id)
"""


OP12_SQL = f"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOWER.format("coalesce(text, '')")}, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM p),
g AS (SELECT lang, len, array_to_string(w[k : k + len - 1], ' ') AS phrase FROM (SELECT lang, w, len, unnest(range(1, len(w) - len + 2)) AS k FROM w, range(1, 4) r(len) WHERE len(w) >= len)),
f AS (SELECT lang, phrase, any_value(len) AS len, count(*) AS f FROM g GROUP BY lang, phrase),
t AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE len = 1 GROUP BY lang),
c AS (SELECT lang, phrase, len, f AS a, string_split(phrase, ' ') AS w FROM f WHERE len > 1 AND f >= 10),
k AS (SELECT lang, phrase, a, k, array_to_string(w[: k], ' ') AS first, array_to_string(w[k + 1 :], ' ') AS rest FROM (SELECT *, unnest(range(1, len)) AS k FROM c)),
s AS (SELECT k.lang, k.phrase, k.a, k.k, x.f AS l, y.f AS r, (1000000::HUGEINT * k.a * k.a // (x.f::HUGEINT * y.f))::BIGINT AS score
      FROM k JOIN f x ON x.lang = k.lang AND x.phrase = k.first JOIN f y ON y.lang = k.lang AND y.phrase = k.rest),
m AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
o AS (SELECT lang, unnest([array_to_string(w[: len - 1], ' '), array_to_string(w[2 :], ' ')]) AS phrase, a FROM c WHERE len > 2),
x AS (SELECT m.* FROM m WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.lang = m.lang AND o.phrase = m.phrase AND 100 * o.a >= 50 * m.a)),
z AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM x)
SELECT lang, rank, phrase, a, l, r, n, score FROM z JOIN t USING (lang) WHERE rank <= 2000
"""

OP13_SQL = """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256.0::DOUBLE * x::DOUBLE)::BIGINT) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS anchor_id, c.vec_id, q.label = c.label AS alike, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
      FROM e q, e c WHERE q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE alike QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (SELECT p.anchor_id, p.positive_id, s.vec_id AS negative_id, p.positive_score, s.score AS negative_score,
      (row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id))::INT AS rank
      FROM p JOIN s ON p.anchor_id = s.anchor_id WHERE NOT s.alike AND 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""


def oracle_sql() -> dict[str, str]:
    """XXH64, crc32 and trained models have no SQL form; those queries are tested against brute force."""
    return {
        "op1_topk_search": OP1_SQL,
        "op2_source_mix": OP2_SQL,
        "op5_url_rules": OP5_SQL,
        "op6_line_dedup": OP6_SQL,
        "op9_license_scan": OP9_SQL,
        "op10_decontaminate": OP10_SQL,
        "op12_collocations": OP12_SQL,
        "op13_hard_negatives": OP13_SQL,
    }
