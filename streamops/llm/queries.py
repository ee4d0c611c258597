"""The registered queries of the corpus operators, with SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from streamops.llm import (
    backoff_lm,
    byte_bpe,
    char_crf,
    dart_minhash,
    itq,
    kronecker_negatives,
    periodic_runs,
    positional_index,
    rank_profiles,
    resharding,
    subword_quality,
    token_files,
    url_filter,
)
from streamops.llm.common import fold, prepare, stored, table
from streamops.plans.batch import crc32_sql
from streamops.session import new_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(prepare(spark), sf_dir.rstrip("/"))

    QUERIES[fn.__name__] = run
    return run


@query
def op2_byte_bpe(spark, sf_dir):
    """Encode and decode every document with the many-language vocabulary."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return byte_bpe.digests(byte_bpe.encode_decode(
        docs, public_tokenizers.path(byte_bpe.RANKS), public_tokenizers.PATTERN,
        keep_text=False))


@query
def op6_token_files(spark, sf_dir):
    """Write every document's ids as sequence files and read them back."""
    import public_tokenizers

    folder = new_folder(spark, "token-files")
    manifest = token_files.write(table(spark, sf_dir, "documents"), folder,
                                 public_tokenizers.path(token_files.TOKENIZER))
    return token_files.read(spark, folder, manifest)


@query
def op7_rank_profiles(spark, sf_dir):
    """Language of every document by rank-order profiles."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = rank_profiles.identify(docs.select("doc_id", "text"), rank_profiles.learn_folds(docs))
    return found.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"),
                        "lang_pred", "score")


@query
def op4_dart_minhash(spark, sf_dir):
    """Near-duplicate groups of all documents: class id, and whether one stays."""
    found = dart_minhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "component_id",
                        (F.col("doc_id") == F.col("component_id")).alias("kept"))


@query
def op3_positional_index(spark, sf_dir):
    """Benchmark words in every document, by exact ten-word windows."""
    found = positional_index.contamination(table(spark, sf_dir, "documents"),
                                           table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"))


def _listed(spans: str):
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


@query
def op5_char_crf(spark, sf_dir):
    """Personal data in every document: counts of base spans, and all spans."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = char_crf.find(docs, char_crf.train(docs)).drop("text")

    def count(kind):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, char_crf.KINDS), F.sha2(_listed("base"), 256).alias("base_sha256"),
                        _listed("spans").alias("spans"))


@query
def op9_subword_quality(spark, sf_dir):
    """Quality of every document by supervised subword embeddings."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = subword_quality.training_labels(table(spark, sf_dir, "labels"))
    found = subword_quality.score(docs, subword_quality.train(docs, labels))
    return found.select(
        "doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score",
        (F.col("score") >= subword_quality.CUTOFF).cast("int").alias("predicted"))


@query
def op10_backoff_lm(spark, sf_dir):
    """Log-probability of every document by the backoff automaton."""
    return backoff_lm.score(table(spark, sf_dir, "documents"))


@query
def op1_itq(spark, sf_dir):
    """Links and components of all embeddings by cosine 0.95."""
    found = itq.near_duplicates(table(spark, sf_dir, "embeddings"))
    return found.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


ORACLES["op1_itq"] = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE len(embedding) > 0 AND list_bool_and([coalesce(isfinite(x), false) for x in embedding])
    AND list_max([abs(x) for x in embedding]) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b
  ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95),
reach(a, b) AS (
  SELECT vec_id, vec_id FROM embeddings
  UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT e.vec_id, (SELECT count(*) FROM links l WHERE l.a = e.vec_id) AS n_links,
  c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) c ON c.a = e.vec_id
"""

_WORDS = (r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
          r"'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')")
ORACLES["op3_positional_index"] = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, n, array_to_string(w[k:k + n - 1], ' ') AS win
  FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS k
        FROM (SELECT item_id, w, least(10, len(w)) AS n FROM i WHERE len(w) > 0))),
spots AS (
  SELECT doc_id, n, k, array_to_string(w[k:k + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k
        FROM d, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n)),
found AS (SELECT doc_id, item_id, n, k FROM spots JOIN windows USING (n, win)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit
        FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM found) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
          FROM (SELECT DISTINCT doc_id, coalesce(item_id::VARCHAR, '') AS id FROM found) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
  coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""


@query
def op8_resharding(spark, sf_dir):
    """All documents from one shard per source to 24 shards of near-equal bytes."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    old = F.pmod(F.xxhash64("source"), F.lit(resharding.SHARDS)).cast("int")
    placed, _, _ = resharding.reshard(docs, old)
    digest = stored(placed.select(
        "doc_id", "size", F.coalesce(F.crc32(F.encode("text", "UTF-8")), F.lit(0)).alias("text_crc32"),
        "shard", "block", "place"), "reshard-digest")
    return resharding.with_slots(digest, order=("place", "doc_id", "text_crc32")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


@query
def op12_kronecker_negatives(spark, sf_dir):
    """Hard negatives of every hundredth embedding against all of them."""
    rows = table(spark, sf_dir, "embeddings").select(
        "vec_id", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10)
        .otherwise(F.col("label")).alias("label"), "embedding")
    return kronecker_negatives.mine(rows, F.col("vec_id") % 100 == 0)


ORACLES["op12_kronecker_negatives"] = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    [floor(256 * x::DOUBLE) for x in embedding] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND coalesce(list_bool_and([coalesce(isfinite(x), false) for x in embedding]), true)),
s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id AS other_id, a.label = c.label AS same,
    list_inner_product(a.e, c.e)::BIGINT AS score
  FROM v a JOIN v c ON a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id AND len(a.e) = len(c.e)),
p AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT p.anchor_id, positive_id,
  row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other_id)::INTEGER AS rank,
  other_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT same
  AND 80 * positive_score <= 100 * score AND score <= positive_score
QUALIFY rank <= 5
"""

# The rules pages are judged by, and words of hosts nobody wants.
URL_RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"),
             ("allow", "org/fr/"))
UNWANTED = "casino|cheap-pills|free-bets|spam-farm|ads-track|adult"


@query
def op13_bloom_urls(spark, sf_dir):
    """Verdicts on all pages by four rules and the list of canonical URLs that the
    pages of unwanted hosts have."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    rules = spark.createDataFrame(URL_RULES, "verdict string, rule string")
    parts = pages.withColumns(url_filter.url_parts("url"))
    listed = parts.where(F.col("host").rlike(UNWANTED)).select(url_filter.canonical("url").alias("url"))
    return url_filter.judge(pages, rules, listed).select("page_id", "host", "path", "rule", "verdict")


ORACLES["op13_bloom_urls"] = rf"""
WITH u AS (
  SELECT page_id, url, CASE WHEN contains(url, '://') THEN url[strpos(url, '://') + 3:] ELSE '' END AS rest
  FROM pages),
h AS (
  SELECT page_id, url, translate(regexp_extract(rest, '^([^/?#]*)', 1),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(regexp_extract(rest, '^([^?#]*)', 1), '(?s)^[^/]*(/.*)', 1), '') AS path,
    list_sort(list_filter(string_split(regexp_extract(rest, '^[^?#]*\?([^#]*)', 1), '&'),
      lambda p: p <> '' AND NOT regexp_matches(p, '{url_filter.VISIT_PARAMETERS}'))) AS params
  FROM u),
c AS (
  SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path,
    regexp_replace(host, '^www\.', '') || regexp_replace(path, '/+$', '')
      || CASE WHEN len(params) > 0 THEN '?' || array_to_string(params, '&') ELSE '' END AS canonical
  FROM h),
listed AS (SELECT DISTINCT canonical FROM c WHERE regexp_matches(host, '{UNWANTED}')),
rules(verdict, rule) AS (VALUES {', '.join(map(str, URL_RULES))}),
r AS (SELECT verdict, rule, split_part(rule, '/', 1) AS h, rule[strpos(rule, '/'):] AS p FROM rules),
fits AS (
  SELECT page_id, host, path, canonical, arg_max(r.rule, length(r.rule)) AS rule,
    arg_max(r.verdict, length(r.rule)) AS verdict
  FROM c LEFT JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
  GROUP BY page_id, host, path, canonical)
SELECT page_id, host, path, rule, coalesce(verdict,
  CASE WHEN canonical IN (SELECT canonical FROM listed) THEN 'block' ELSE 'allow' END) AS verdict
FROM fits
"""


@query
def op11_periodic_runs(spark, sf_dir):
    """Periodic runs of words in every document, some of them planted."""
    return periodic_runs.find(table(spark, sf_dir, "documents"), planted=True, texts=False).drop("n_words", "collapsed")


ORACLES["op11_periodic_runs"] = rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    ({crc32_sql("CAST(doc_id AS VARCHAR)")})::BIGINT AS h FROM documents),
p AS (
  SELECT *, len(w) AS n, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a FROM d),
o AS (
  SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM p),
m AS (
  SELECT doc_id, n, CASE WHEN a IS NULL THEN w ELSE
    w[:a] || [w[a + 1 + k % p] for k in range(n - a)] END AS w FROM o),
t AS (SELECT doc_id, n, unnest(range(n)) AS i, unnest(w) AS word FROM m),
g AS (
  SELECT doc_id, n, i, concat_ws(' ', word, lead(word, 1) OVER o, lead(word, 2) OVER o,
    lead(word, 3) OVER o, lead(word, 4) OVER o) AS gram
  FROM t WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
lags AS (
  SELECT x.doc_id, y.i - x.i AS lag FROM g x JOIN g y ON x.doc_id = y.doc_id AND x.gram = y.gram
    AND x.i < y.i AND 4 * (y.i - x.i) <= x.n AND y.i + 5 <= x.n
  GROUP BY 1, 2 HAVING count(*) >= greatest(6, 4 * lag) - lag - 4),
eq AS (
  SELECT x.doc_id, lag, x.i, x.i - row_number() OVER (PARTITION BY x.doc_id, lag ORDER BY x.i) AS island
  FROM lags JOIN t x ON lags.doc_id = x.doc_id JOIN t y ON y.doc_id = x.doc_id AND y.i = x.i + lag
    AND x.word = y.word),
stretch AS (
  SELECT doc_id, lag AS q, min(i) AS s, count(*) + lag AS len FROM eq GROUP BY doc_id, lag, island
  HAVING count(*) + lag >= greatest(6, 4 * lag)),
r AS (
  SELECT * FROM stretch x WHERE NOT EXISTS (
    SELECT 1 FROM stretch y WHERE y.doc_id = x.doc_id AND y.q < x.q AND y.s <= x.s
      AND y.s + y.len >= x.s + x.len)),
best AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY len / q DESC, s, q) AS k FROM r),
listed AS (
  SELECT doc_id, count(*) AS n_runs, string_agg(s || ',' || len || ',' || q || chr(10), '' ORDER BY s, q) AS runs
  FROM r GROUP BY doc_id),
dropped AS (SELECT DISTINCT doc_id, unnest(range(s + q, s + len)) AS i FROM r),
kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text
  FROM t ANTI JOIN dropped USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, s::BIGINT AS start, len::BIGINT AS length,
  q::BIGINT AS period, (1000 * len // q)::BIGINT AS exponent_milli,
  sha256(coalesce(runs, '')) AS runs_sha256, sha256(coalesce(kept.text, '')) AS collapsed_sha256
FROM d LEFT JOIN listed USING (doc_id) LEFT JOIN kept USING (doc_id)
LEFT JOIN best ON best.doc_id = d.doc_id AND k = 1
"""
