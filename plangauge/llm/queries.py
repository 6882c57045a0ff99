"""The corpus queries and, where SQL can express them, their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plangauge.core.staging import stage
from plangauge.llm import bpe, exact_dedup, filter_audit, langid, minhash, packing, pii, rank_bpe, runs, sharding, token_counts, topk, url_filter

#: The pseudonyms' key; a deployment sets its own.
PII_KEY = "plangauge-demo-key"
URL_RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document into 16 shards of equal row counts, in a seeded random order."""
    dealt = sharding.shard(_table(spark, sf_dir, "documents"), 16)
    return dealt.select("doc_id", sharding.text_size(F.col("text")).alias("size"), F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents at 2-word shingles and a similarity of 0.8."""
    found = minhash.groups(_table(spark, sf_dir, "documents").select("doc_id", "text"), minhash.Near(width=2, percent=80))
    return found.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.col("id").eqNullSafe(F.col("component")).alias("kept"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 4096 tokens, each with its lexical neighbours."""
    pieces = packing.pack(_table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select(F.col("id").alias("doc_id"), "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learnt from three quarters of the labelled ones."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    samples = langid.fit(docs.where(langid.may_learn(F.col("doc_id"))))
    held_out = (F.crc32(F.col("doc_id").cast("string")) % 4 == 2).alias("held_out")
    return langid.identify(docs.select("doc_id", held_out, "text"), samples).select("doc_id", "held_out", "lang_pred", "score")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and unigram tokens of every document."""
    done = token_counts.count_tokens(_table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model"))
    return done.select("doc_id", "n_words", "n_tokens", F.round("log_score", 6).alias("log_score"))


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 highest integer inner products of every 50th vector among all other rows."""
    vectors = _table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.where("vec_id % 50 = 0"), 5)


OP6_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score,
    row_number() OVER (PARTITION BY q.vec_id ORDER BY CAST(list_inner_product(q.e, c.e) AS BIGINT) DESC, c.vec_id) AS rank
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0) WHERE rank <= 5
"""


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict for every page; a page is bad if the labels call the document it was made from (its path's number) toxic or of low quality."""
    pages, labels = _table(spark, sf_dir, "pages").select("page_id", "url"), _table(spark, sf_dir, "labels")
    made_from = pages.select(url_filter.host_of(F.col("url")).alias("host"), F.regexp_extract(url_filter.path_of(F.col("url")), r"^/[^/]*/([0-9]{1,18})", 1).try_cast("long").alias("doc_id"))
    outcomes = made_from.join(labels, "doc_id").select("host", F.coalesce((F.col("toxic") == 1) | (F.col("quality") == 0), F.lit(False)).alias("bad"))
    return url_filter.judge(pages, outcomes, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


OP7_SQL = r"""
WITH cut AS (SELECT page_id, CASE WHEN instr(coalesce(url, ''), '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
seen AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
outcome AS (SELECT s.host, coalesce(l.toxic = 1 OR l.quality = 0, FALSE) AS bad FROM seen s JOIN labels l ON l.doc_id = TRY_CAST(nullif(regexp_extract(s.path, '^/[^/]*/([0-9]{1,18})', 1), '') AS BIGINT)),
hosts AS (SELECT host, CAST(sum(n) AS DOUBLE) AS n, CAST(sum(bad) AS DOUBLE) AS bad, CASE WHEN host LIKE '%.%' THEN regexp_extract(host, '([^.]*\.[^.]*)$', 1) ELSE host END AS domain, regexp_extract(host, '([^.]*)$', 1) AS sfx
  FROM (SELECT host, 1 AS n, CASE WHEN bad THEN 1 ELSE 0 END AS bad FROM outcome UNION ALL SELECT DISTINCT host, 0, 0 FROM seen) GROUP BY host),
g AS (SELECT (coalesce(sum(bad), 0) + 1.0) / (coalesce(sum(n), 0) + 2.0) AS p0 FROM hosts),
d0 AS (SELECT domain, sfx, sum(n) AS n, sum(bad) AS bad FROM hosts GROUP BY domain, sfx),
s0 AS (SELECT sfx, sum(n) AS n, sum(bad) AS bad, any_value(p0) AS m FROM d0, g GROUP BY sfx),
r0 AS (SELECT CASE WHEN coalesce(sum(m * (1 - m) * (n - 1)), 0) = 0 THEN 1.0 ELSE (sum(n * pow(bad / n - m, 2)) - sum(m * (1 - m))) / sum(m * (1 - m) * (n - 1)) END AS rho FROM s0 WHERE n > 0),
k0 AS (SELECT CASE WHEN rho <= 1 / 1001.0 THEN 1000.0 ELSE greatest(1.0, 1 / rho - 1) END AS k FROM r0),
s1 AS (SELECT sfx, (bad + k * m) / (n + k) AS m FROM s0, k0),
d1 AS (SELECT domain, n, bad, m FROM d0 JOIN s1 USING (sfx)),
r1 AS (SELECT CASE WHEN coalesce(sum(m * (1 - m) * (n - 1)), 0) = 0 THEN 1.0 ELSE (sum(n * pow(bad / n - m, 2)) - sum(m * (1 - m))) / sum(m * (1 - m) * (n - 1)) END AS rho FROM d1 WHERE n > 0),
k1 AS (SELECT CASE WHEN rho <= 1 / 1001.0 THEN 1000.0 ELSE greatest(1.0, 1 / rho - 1) END AS k FROM r1),
d2 AS (SELECT domain, (bad + k * m) / (n + k) AS m FROM d1, k1),
h1 AS (SELECT host, n, bad, m FROM hosts JOIN d2 USING (domain)),
r2 AS (SELECT CASE WHEN coalesce(sum(m * (1 - m) * (n - 1)), 0) = 0 THEN 1.0 ELSE (sum(n * pow(bad / n - m, 2)) - sum(m * (1 - m))) / sum(m * (1 - m) * (n - 1)) END AS rho FROM h1 WHERE n > 0),
k2 AS (SELECT CASE WHEN rho <= 1 / 1001.0 THEN 1000.0 ELSE greatest(1.0, 1 / rho - 1) END AS k FROM r2),
h2 AS (SELECT host, (bad + k * m) / (n + k) AS mean, n + k AS tot FROM h1, k2),
verdicts AS (SELECT host, mean - 1.645 * sqrt(mean * (1 - mean) / (tot + 1)) > 0.35 AS blocked FROM h2),
rules(verdict, rule, rhost, rpath) AS (VALUES ('block', 'com/en/', 'com', '/en/'), ('allow', 'example.com/en/7', 'example.com', '/en/7'), ('allow', 'net/de/', 'net', '/de/'), ('block', 'example.net/de/8', 'example.net', '/de/8'), ('block', 'org/es/', 'org', '/es/')),
fit AS (SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict FROM seen JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY page_id)
SELECT s.page_id, s.host, s.path, f.rule, coalesce(f.verdict, CASE WHEN v.blocked THEN 'block' ELSE 'allow' END) AS verdict
FROM seen s LEFT JOIN fit f USING (page_id) LEFT JOIN verdicts v ON v.host = s.host
"""


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its personal data replaced by format-preserving pseudonyms."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.pseudonymise(docs, PII_KEY, count_col="n_found")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document, and the text that they decode to, as digests."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    done = bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.json"), decoded_col="decoded")
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return done.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents are copies of which, texts being equal up to runs of white space."""
    keys = stage(_table(spark, sf_dir, "documents").select("doc_id", exact_dedup.fingerprint(F.col("text")).alias("text_key")), "keys")
    return exact_dedup.resolve(keys).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("text_key")).alias("text_sha256"))


OP10_SQL = r"""
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
WINDOW w AS (PARTITION BY text_sha256)
"""

def with_planted_period(text: Column, doc_id: Column) -> Column:
    """The text, or for a tenth of the ids its words with a period: from word a on, each word is that of the first p words from there."""
    h = F.crc32(doc_id.cast("string"))
    g = F.floor(h / 10).cast("long")

    def planted(words: Column) -> Column:
        n = F.size(words).cast("long")
        a = F.pmod(g, n)
        p = 1 + F.floor((n - a) / (3 + g % 8))
        return F.transform(words, lambda _, i: F.get(words, F.when(i < a, i).otherwise(a + F.pmod(i - a, p)).cast("int")))

    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    bound = F.transform(F.array(words), planted)[0]  # the inner array is worked out once, as a bound variable
    return F.when((h % 10 == 0) & text.rlike(r"[^\x20\x09-\x0D]"), F.array_join(bound, " ")).otherwise(text)


def op11_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The periodic runs of every document's words, the longest of them, and the words without repeats, as digests."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", with_planted_period(F.col("text"), F.col("doc_id")).alias("text"))
    done = runs.with_runs(docs)
    longest = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))), "\n")
    every = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    of = F.col("longest")
    return done.withColumn("longest", longest).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), of["start"].alias("start"), (-of["less"]).alias("length"), of["period"].alias("period"),
        F.floor(1000 * -of["less"] / of["period"]).cast("long").alias("exponent_milli"), F.sha2(every, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_rank_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document by a rank file, and the bytes that they decode to, as digests."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    done = rank_bpe.encode(_table(spark, sf_dir, "documents").select("doc_id", "text"), path, public_tokenizers.PATTERN, decoded_col="decoded")
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return done.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each of five filters removes at each step of all 120 orders, for every language."""
    failed = filter_audit.failure_masks(_table(spark, sf_dir, "documents"), part=F.coalesce("lang", F.lit("")))
    labels = _table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), (F.col("quality") == 1).cast("int").alias("good"), (F.col("toxic") == 1).cast("int").alias("toxic"))
    return filter_audit.interactions(filter_audit.mask_counts(failed, labels))


OP13_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws, min(doc_id) OVER (PARTITION BY t) AS least FROM d),
m AS (SELECT doc_id, part, CASE WHEN len(ws) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 2 ELSE 0 END
  + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) THEN 4 ELSE 0 END
  + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN doc_id > least THEN 16 ELSE 0 END AS mask FROM w),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
c AS (SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM m LEFT JOIN l USING (doc_id) GROUP BY part, mask),
f(x, b) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order, [a.b, b.b, c.b, d.b, e.b] AS bits FROM f a JOIN f b ON b.x <> a.x JOIN f c ON c.x NOT IN (a.x, b.x)
  JOIN f d ON d.x NOT IN (a.x, b.x, c.x) JOIN f e ON e.x NOT IN (a.x, b.x, c.x, d.x)),
s AS (SELECT filter_order, CAST(k AS INTEGER) AS step, CAST(coalesce(list_sum(bits[1:k - 1]), 0) AS INTEGER) AS before, bits[k] AS here FROM o, range(1, 6) r(k)),
r AS (SELECT part, filter_order, step, here,
  sum(CASE WHEN mask & here = 0 AND mask & before = 0 THEN n ELSE 0 END) AS kept, sum(CASE WHEN mask & here <> 0 AND mask & before = 0 THEN n ELSE 0 END) AS removed,
  sum(CASE WHEN mask & here <> 0 AND mask & before <> 0 THEN n ELSE 0 END) AS redundant, sum(CASE WHEN mask = here THEN n ELSE 0 END) AS unique_fails,
  sum(CASE WHEN mask & here <> 0 AND mask & before = 0 THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN mask & here <> 0 AND mask & before = 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM c, s GROUP BY ALL)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, here) AS BIGINT) AS shapley FROM r
"""

QUERIES = {f.__name__: f for f in (op1_sharding, op2_minhash, op3_packing, op4_language_id, op5_token_counts, op6_topk, op7_url_filter, op8_pii, op9_bpe, op10_exact_dedup, op11_runs, op12_rank_bpe, op13_filter_audit)}
ORACLES = {"op6_topk": OP6_SQL, "op7_url_filter": OP7_SQL, "op10_exact_dedup": OP10_SQL, "op13_filter_audit": OP13_SQL}
