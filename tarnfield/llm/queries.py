"""The ten operators' queries over whole tables, and SQL for those it can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, exact_dedup, langid, mixing, pii, quality, simhash, suffix_dedup, url_filter, warc
from .common import table

TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(table(spark, sf_dir, "documents"), tokenizer_path(), digests=True)


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["base"])
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    counts = [count(kind) for kind in pii.BASE]
    scores = F.array_join(F.transform("spans", lambda s: F.format_string("%.2f", s["score"])), ",")
    return found.select("doc_id", *counts, F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"), scores.alias("scores"), F.size("spans").cast("long").alias("n_spans"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixing.in_training_order(mixed).select("doc_id", "size", "source_size", "target", "taken", "start", "position")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), texts=False)


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return exact_dedup.exact_dedup(docs, carry={"text_sha256": F.sha2(exact_dedup.normalised(F.col("text")), 256)})


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages")).drop("score")


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 6's parts of a url and its rules, which SQL can express."""
    host, path = url_filter.host_of(F.col("url")), url_filter.path_of(F.col("url"))
    fits = url_filter.rule_of(F.col("host"), F.col("path"), url_filter.RULES)
    rows = table(spark, sf_dir, "pages").select("page_id", host.alias("host"), path.alias("path"))
    return rows.withColumn("fits", fits).select("page_id", "host", "path", "fits.rule", F.col("fits.verdict").alias("ruled"))


def pii_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 2's base kinds by number, which SQL can express."""
    return op2_pii(spark, sf_dir).select("doc_id", *[f"n_{kind}" for kind in pii.BASE])


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(table(spark, sf_dir, "pages"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex16(F.col("fp")).alias("fingerprint"), "component_id")


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), digests=True)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    each = (op1_bpe, op2_pii, op3_mixing, op4_quality, op5_exact_dedup, op6_url_filter, op7_langid, op8_warc, op9_simhash, op10_suffix_dedup, url_rules, pii_counts)
    return {f.__name__: f for f in each}


OP3_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS ord
  FROM documents
), sums AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rnk
  FROM sized GROUP BY source
), weighed AS (
  SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][(rnk - 1) % 3 + 1] AS weight, [1.5::DOUBLE, 1.0::DOUBLE, 0.5::DOUBLE][(rnk - 1) % 3 + 1] AS ramp,
    source_size * 3.0::DOUBLE AS cap
  FROM sums
), filling AS (
  SELECT *, cap / weight AS ratio, (sum(source_size) OVER ())::DOUBLE AS total FROM weighed
), levels AS (
  SELECT *,
    (total - coalesce(sum(cap) OVER (ORDER BY ratio, rnk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(weight) OVER (ORDER BY ratio, rnk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM filling
), targets AS (
  SELECT source, source_size, ramp, least(cap, weight * max(CASE WHEN level <= ratio THEN level END) OVER ()) AS target FROM levels
), placed AS (
  SELECT doc_id, size, source_size, target, ramp,
    coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY ord, doc_id NULLS LAST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
), counted AS (
SELECT doc_id, size, source_size, target, ramp,
  (greatest(0, least(size, floor(target)::BIGINT - start))
   + greatest(0, least(size, floor(target)::BIGINT - source_size - start))
   + greatest(0, least(size, floor(target)::BIGINT - 2 * source_size - start)))::BIGINT AS taken,
  start, start::DOUBLE / target AS q
FROM placed
)
SELECT doc_id, size, source_size, target, taken, start,
  CASE WHEN taken > 0 THEN 2.0::DOUBLE * q / (ramp + sqrt(ramp * ramp + 4.0::DOUBLE * (1.0::DOUBLE - ramp) * q)) END AS position
FROM counted
"""

OP4_SQL = r"""
WITH rows AS (
  SELECT row_number() OVER () AS row, doc_id, source, coalesce(text, '') AS text FROM documents
), words AS (
  SELECT row, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM rows
), each AS (
  SELECT row, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM words
), windows AS (
  SELECT row, i, word AS a, lead(word) OVER w AS b, lead(word, 2) OVER w AS c FROM each WINDOW w AS (PARTITION BY row ORDER BY i)
), repeated AS (
  SELECT row, i FROM (SELECT row, i, count(*) OVER (PARTITION BY row, a, b, c) AS n FROM windows WHERE c IS NOT NULL) WHERE n > 1
), covered AS (
  SELECT row, count(DISTINCT i + d)::BIGINT AS n_repeat_words FROM repeated, (VALUES (0), (1), (2)) AS v(d) GROUP BY row
), lines AS (
  SELECT row, source, unnest(string_split(text, chr(10))) AS line FROM rows
), real_lines AS (
  SELECT row, source, line, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS parts FROM lines
), dups AS (
  SELECT row, (count(*) - count(DISTINCT line))::BIGINT AS n_dup_lines FROM real_lines WHERE len(parts) > 0 GROUP BY row
), plain AS (
  SELECT row, source, translate(array_to_string(parts, ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS line, sum(len(parts)) AS words
  FROM real_lines WHERE len(parts) > 0 GROUP BY ALL
), hosts AS (
  SELECT source, greatest(10.0::DOUBLE, count(*) * 0.01::DOUBLE) AS most FROM documents GROUP BY source
), common AS (
  SELECT p.source, p.line FROM plain p JOIN hosts h ON p.source IS NOT DISTINCT FROM h.source
  GROUP BY p.source, p.line, h.most HAVING count(*) > h.most
), removed AS (
  SELECT row, sum(words)::BIGINT AS n_removed_words FROM plain p JOIN common c ON p.line = c.line AND p.source IS NOT DISTINCT FROM c.source GROUP BY row
), counts AS (
  SELECT r.row, doc_id, len(w.words)::BIGINT AS n_words,
    length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
    coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(n_removed_words, 0)::BIGINT AS n_removed_words
  FROM rows r JOIN words w ON r.row = w.row LEFT JOIN dups d ON r.row = d.row LEFT JOIN covered c ON r.row = c.row LEFT JOIN removed m ON r.row = m.row
), judged AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counts
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT n_removed_words > n_words * 0.5 AS kept, n_removed_words
FROM judged
"""

OP5_SQL = r"""
WITH plain AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_chars, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS norm FROM documents
), ranked AS (
  SELECT doc_id, norm,
    row_number() OVER (PARTITION BY norm ORDER BY n_chars DESC, doc_id NULLS LAST) AS place,
    first_value(doc_id) OVER (PARTITION BY norm ORDER BY n_chars DESC, doc_id NULLS LAST) AS keep_id,
    count(*) OVER (PARTITION BY norm) AS group_size
  FROM plain
)
SELECT doc_id, keep_id, group_size::BIGINT AS group_size, place = 1 AS kept, sha256(norm) AS text_sha256 FROM ranked
"""

OP8_SQL = r"""
WITH payloads AS (
  SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), groups AS (
  SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM payloads
), typed AS (
  SELECT *, payload_bytes >= 1000 AND first_id IS NOT NULL AND page_id IS DISTINCT FROM first_id AS revisit FROM groups
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN revisit THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN revisit THEN first_id END AS refers_to
FROM typed
"""


URL_RULES_SQL = r"""
WITH rests AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rests
), ruled AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR suffix(host, '.example.net')) AND prefix(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR suffix(host, '.example.com')) AND prefix(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR suffix(host, '.org')) AND prefix(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR suffix(host, '.net')) AND prefix(path, '/') THEN 'net/' END AS rule
  FROM parts
)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' END AS ruled FROM ruled
"""

PII_COUNTS_SQL = r"""
WITH texts AS (
  SELECT doc_id, coalesce(text, '') AS text FROM documents
), found AS (
  SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+'))::BIGINT AS n_email,
    list_transform(regexp_extract_all(text, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)'), lambda m: string_split(m, '.')) AS ips,
    list_transform(regexp_extract_all(text, '[0-9]([ -]?[0-9])+'), lambda m: regexp_replace(m, '[^0-9]', '', 'g')) AS cards,
    list_transform(regexp_extract_all(text, '\+[0-9][ ().0-9-]+[0-9]'), lambda m: length(regexp_replace(m, '[^0-9]', '', 'g'))) AS phones
  FROM texts
)
SELECT doc_id, n_email,
  len(list_filter(ips, lambda parts: list_bool_and(list_transform(parts, lambda p: length(ltrim(p, '0')) <= 3 AND right(concat('000', p), 3)::INTEGER <= 255))))::BIGINT AS n_ip,
  len(list_filter(cards, lambda d: length(d) BETWEEN 14 AND 19 AND list_sum(list_transform(range(length(d)), lambda i:
    CASE WHEN i % 2 = 0 THEN substr(d, length(d) - i, 1)::INTEGER ELSE (2 * substr(d, length(d) - i, 1)::INTEGER) % 10 + (2 * substr(d, length(d) - i, 1)::INTEGER) // 10 END)) % 10 = 0))::BIGINT AS n_card,
  len(list_filter(phones, lambda n: n BETWEEN 10 AND 15))::BIGINT AS n_phone
FROM found
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_mixing": OP3_SQL, "op4_quality": OP4_SQL, "op5_exact_dedup": OP5_SQL, "op8_warc": OP8_SQL, "url_rules": URL_RULES_SQL, "pii_counts": PII_COUNTS_SQL}
