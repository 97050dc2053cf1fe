"""The registered corpus queries, each a thin cover of its operator, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hitloom.llm import alignment, centroids, decontaminate, language_id, lines, mixing, pii, quality_lm, sharding, simhash, topk, toxicity, url_filter
from hitloom.llm.common import shared_dir

URL_RULES = (
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(_table(spark, sf_dir, "documents"))


def op2_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


def op3_quality_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = _table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return quality_lm.classify(_table(spark, sf_dir, "documents"), trusted)


def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_words(_table(spark, sf_dir, "documents"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    judged = url_filter.judge(_table(spark, sf_dir, "pages").select("page_id", "url"), rules)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = _table(spark, sf_dir, "labels").where(~toxicity.held_out(F.col("doc_id")))
    scored = toxicity.score_documents(_table(spark, sf_dir, "documents"), labels)
    return scored.select(
        "doc_id",
        toxicity.held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"),
        F.array_join(F.transform("evidence", lambda e: F.concat_ws(":", e["doc_id"], e["label"], F.round(e["similarity"], 4))), ",").alias("evidence"),
    )


def op7_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_spans(_table(spark, sf_dir, "documents"))
    counts = [pii.count_of(k).alias(f"n_{k}") for k in pii.KINDS[:4]]
    return found.select("doc_id", *counts, F.sha2(pii.listed("base"), 256).alias("base_sha256"), pii.listed("spans").alias("spans"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op9_shard_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    # A map of its own for each run: what other tables or runs have stored takes no part.
    return sharding.shard_rows(_table(spark, sf_dir, "documents"), 8, map_path=f"{shared_dir(spark)}/shard-maps/op9-{uuid.uuid4().hex}")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = language_id.train(docs.where(~language_id.held_out(F.col("doc_id"))), most=language_id.TRAIN_BYTES)
    found = language_id.identify(docs, model)
    return found.select("doc_id", language_id.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.drop_frequent_lines(_table(spark, sf_dir, "documents"), least=10)
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(_table(spark, sf_dir, "embeddings"), k=8, rounds=10, seed=3)


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    aligned = alignment.align_tokens(_table(spark, sf_dir, "documents"))
    agreed = alignment.agreement(aligned, alignment.pair_counts(aligned))
    rows = aligned.drop("links").join(agreed, "key")
    return rows.select(F.col("id").alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def queries() -> dict:
    return {
        "op1_simhash": op1_simhash,
        "op2_exact_top_k": op2_exact_top_k,
        "op3_quality_lm": op3_quality_lm,
        "op4_source_mix": op4_source_mix,
        "op5_url_filter": op5_url_filter,
        "op6_toxicity": op6_toxicity,
        "op7_disclosure": op7_disclosure,
        "op8_decontaminate": op8_decontaminate,
        "op9_shard_slots": op9_shard_slots,
        "op10_language_id": op10_language_id,
        "op11_line_dedup": op11_line_dedup,
        "op12_centroids": op12_centroids,
        "op13_token_alignment": op13_token_alignment,
    }


OP2_SQL = """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 5
"""

OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, source,
    CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
    CAST(coalesce(len(regexp_extract_all(text, '[!-/:-@\[-`{-~]')), 0) AS BIGINT) AS symbols,
    (CAST(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) AS DOUBLE) + 0.5) / 4503599627370496.0 AS u
  FROM documents
), k AS (
  SELECT doc_id, source, size,
    x / (1.0 + x) AS key
  FROM (SELECT *, -ln(u) / (CASE WHEN size > 0 THEN CAST(size AS DOUBLE) / (size + symbols) ELSE 1.0 END) AS x FROM d)
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS total,
    CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS weight
  FROM k GROUP BY source
), c AS (
  SELECT *, 3.0 * total AS cap, 3.0 * total / weight AS ratio FROM s
), l AS (
  SELECT *, (sum(CAST(total AS DOUBLE)) OVER () - coalesce(sum(cap) OVER w, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0)) AS level
  FROM c WINDOW w AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS (
  SELECT source, total, least(cap, coalesce((SELECT arg_min(level, ratio) FROM l WHERE ratio > level) * weight, cap)) AS target FROM l
), e AS (
  SELECT *, CASE WHEN total > 0 THEN CAST(floor(target / total) AS BIGINT) ELSE 0 END AS epochs FROM t
), r AS (
  SELECT k.*, e.total, e.target, e.epochs, e.target - e.epochs * e.total AS budget,
    sum(size) OVER (PARTITION BY k.source ORDER BY key, doc_id ROWS UNBOUNDED PRECEDING) - size AS before
  FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source
)
SELECT doc_id, size, total AS source_size, target,
  CAST(size * (epochs + CASE WHEN budget > 0 AND before + size / 2 <= budget THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM r
"""

OP5_SQL = """
WITH r(rule_host, rule_path, rule_verdict) AS (
  VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'),
         ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')
), p AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), h AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM p
)
SELECT page_id, host, path, rule_host || rule_path AS rule, coalesce(rule_verdict, 'allow') AS verdict
FROM h LEFT JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(rule_host || rule_path) DESC) = 1
"""


OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM benchmark WHERE item_id IS NOT NULL
), bw AS (
  SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, n, array_to_string(words[i:i + n - 1], ' ') AS w
  FROM (SELECT item_id, words, least(10, len(words)) AS n, unnest(range(1, greatest(len(words) - 9, 1) + 1)) AS i FROM b WHERE len(words) > 0)
), dw AS (
  SELECT doc_id, n, i, array_to_string(words[i:i + n - 1], ' ') AS w
  FROM (SELECT doc_id, words, n, unnest(range(1, len(words) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw))
), hit AS (
  SELECT doc_id, i, n, item FROM dw JOIN bw USING (n, w)
), words_hit AS (
  SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS place FROM hit) GROUP BY doc_id
), items_hit AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id
)
SELECT doc_id, len(words) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words_hit USING (doc_id) LEFT JOIN items_hit USING (doc_id)
"""


OP11_SQL = """
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), l AS (
  SELECT r, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM d
), k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), f AS (
  SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT r) >= 10
), s AS (
  SELECT r, count(*) AS n_lines, count(f.key) AS n_dropped, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE f.key IS NULL), '') AS kept
  FROM k LEFT JOIN f USING (key) GROUP BY r
)
SELECT doc_id, n_lines, n_dropped, sha256(kept) AS kept_sha256 FROM d JOIN s USING (r)
"""


def op12_sql(k: int = 8, rounds: int = 10, seed: int = 3) -> str:
    """Every round as two tables: the nearest centroids and the new ones."""
    distance = "list_sum(list_transform(list_zip(p.v, m.v), lambda x: (x[1] - x[2]) * (x[1] - x[2])))"
    nearest = f"SELECT r, arg_min(c, (d, c)) AS c, min(d) AS d FROM (SELECT p.r, m.c, CAST({distance} AS BIGINT) AS d FROM p CROSS JOIN {{}} m) GROUP BY r"
    parts = [
        """p AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
)""",
        f"""m0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h) - 1 AS c, v
  FROM (SELECT sha256('{seed}:' || vec_id) AS h, v FROM p ORDER BY h LIMIT {k})
)""",
    ]
    for i in range(rounds):
        parts.append(f"a{i} AS MATERIALIZED ({nearest.format(f'm{i}')})")
        parts.append(f"""m{i + 1} AS MATERIALIZED (
  SELECT m{i}.c, coalesce(n.v, m{i}.v) AS v FROM m{i} LEFT JOIN (
    SELECT c, list(CAST((s - ((s % n + n) % n)) // n AS BIGINT) ORDER BY j) AS v FROM (
      SELECT c, j, sum(x) AS s, count(*) AS n
      FROM (SELECT a.c, unnest(p.v) AS x, generate_subscripts(p.v, 1) AS j FROM p JOIN a{i} a USING (r)) GROUP BY c, j
    ) GROUP BY c
  ) n ON n.c = m{i}.c
)""")
    parts.append(f"z AS MATERIALIZED ({nearest.format(f'm{rounds}')})")
    return f"""WITH {', '.join(parts)}
SELECT vec_id, CAST(c AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
  CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(m.v, ',')) AS centroid_sha256
FROM z JOIN p USING (r) JOIN m{rounds} m USING (c)"""


def oracle_sql() -> dict[str, str]:
    return {
        "op2_exact_top_k": OP2_SQL,
        "op4_source_mix": OP4_SQL,
        "op5_url_filter": OP5_SQL,
        "op8_decontaminate": OP8_SQL,
        "op11_line_dedup": OP11_SQL,
        "op12_centroids": op12_sql(),
    }
