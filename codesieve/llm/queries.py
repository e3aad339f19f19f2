"""Registered queries of the corpus operators, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from codesieve.llm import (
    exact_dedup,
    fill_in_middle,
    html_extract,
    mixing,
    nearest,
    packing,
    pii,
    quality,
    resampling,
    simhash,
    substring_dedup,
    token_counts,
    url_filter,
)
from codesieve.llm.common import read_table


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(read_table(spark, sf_dir, "documents"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(read_table(spark, sf_dir, "documents"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(read_table(spark, sf_dir, "documents"), digest_all=True)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(read_table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(read_table(spark, sf_dir, "pages"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_dedup(read_table(spark, sf_dir, "documents"))


def op10_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(read_table(spark, sf_dir, "pages"))


def op11_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.nearest_of_stated(read_table(spark, sf_dir, "embeddings"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle.digests(read_table(spark, sf_dir, "documents"))


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def mixing_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.targets(read_table(spark, sf_dir, "documents"))


def quality_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.base_counts(read_table(spark, sf_dir, "documents"))


_OPERATORS = (
    op1_simhash, op2_mixing, op3_pii, op4_exact_dedup, op5_token_counts, op6_packing, op7_quality, op8_url_filter,
    op9_substring_dedup, op10_html_extract, op11_nearest, op12_fill_in_middle, op13_resampling, mixing_targets, quality_base,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _OPERATORS}


_EXACT_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY t) AS keep_id,
       count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept,
       sha256(t) AS text_sha256
FROM d
"""

_SUBSTRING_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
p AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM w),
g AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 34], ' ')) AS h FROM p),
r AS (SELECT doc_id, i FROM g WHERE h IN (SELECT h FROM g GROUP BY h HAVING count(*) > 1)),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS j FROM r),
each AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS j FROM w),
kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY j) AS k, count(*) AS n
  FROM each ANTI JOIN gone USING (doc_id, j) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w.ws) AS BIGINT) AS n_words, CAST(len(w.ws) - coalesce(kept.n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept.k, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""


_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

#: The level at which sources fill their caps: each source has the lesser of its cap
#: and its weight's share of one common level, and all together have all words.
_TARGETS_SQL = f"""
WITH s AS (SELECT source, CAST(sum(len({_WORDS})) AS BIGINT) AS size FROM documents GROUP BY source),
w AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM s),
c AS (SELECT *, CAST(3 * size AS DOUBLE) / weight AS full_at FROM w),
k AS (SELECT a.full_at AS lo, sum(CASE WHEN b.full_at <= a.full_at THEN 3 * b.size ELSE 0 END) AS filled,
        sum(CASE WHEN b.full_at > a.full_at THEN b.weight ELSE 0 END) AS heavy FROM (SELECT DISTINCT full_at FROM c UNION SELECT -1) a CROSS JOIN c b GROUP BY 1),
l AS (SELECT lo, CASE WHEN heavy > 0 THEN ((SELECT sum(size) FROM s) - filled) / CAST(heavy AS DOUBLE) END AS level FROM k),
v AS (SELECT max(level) AS level FROM l WHERE level >= lo)
SELECT source, size AS source_size, CAST(weight AS BIGINT) AS weight, least(CAST(3 * size AS DOUBLE), level * weight) AS target FROM c CROSS JOIN v
"""

_QUALITY_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, {_WORDS} AS ws FROM documents),
p AS (SELECT r, ws, unnest(range(1, len(ws) - 3)) AS i FROM d),
g AS (SELECT r, i, count(*) OVER (PARTITION BY r, array_to_string(ws[i:i + 4], ' ')) AS n FROM p),
m AS (SELECT r, count(DISTINCT j) AS n_repeat FROM (SELECT r, unnest(range(i, i + 5)) AS j FROM g WHERE n > 1) GROUP BY r),
x AS (SELECT r, list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^ 	-
]')) AS ls FROM d)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(array_to_string(ws, '')) AS BIGINT) AS word_chars,
  CAST(len(t) - len(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat, 0) AS BIGINT) AS n_repeat_words,
  len(ws) < 10 OR 100 * coalesce(n_repeat, 0) > 20 * len(ws) AS base_failed
FROM d JOIN x USING (r) LEFT JOIN m USING (r)
"""


#: Greedy runs give the units from left to right; positions count from 1.
_MIDDLE_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS x FROM documents),
u AS (SELECT *, regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS us,
             CAST('0x' || x[1:8] AS BIGINT) AS h1, CAST('0x' || x[9:16] AS BIGINT) AS h2,
             CAST('0x' || x[17:24] AS BIGINT) AS h3, CAST('0x' || x[25:32] AS BIGINT) AS h4 FROM d),
c AS (SELECT *, CAST(len(us) AS BIGINT) AS n, least(h1 % (len(us) + 1), h2 % (len(us) + 1)) AS lo,
             greatest(h1 % (len(us) + 1), h2 % (len(us) + 1)) AS hi,
             CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain'
                  WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, array_to_string(us[1:lo], '') AS pre, array_to_string(us[lo + 1:hi], '') AS mid, array_to_string(us[hi + 1:], '') AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(len(pre) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(len(mid) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
                        ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(CASE form WHEN 'plain' THEN t ELSE pre || mid || suf END) AS restored_sha256
FROM p
"""


def _url_sql() -> str:
    """The rules as CASE branches, the priors as one query per level."""
    ordered = sorted(url_filter.RULES, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))

    def fits(host: str, path: str) -> str:
        return f"(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}')"

    rule = " ".join(f"WHEN {fits(h, p)} THEN '{h}{p}'" for _, h, p in ordered)
    verdict = " ".join(f"WHEN {fits(h, p)} THEN '{v}'" for v, h, p in ordered)
    double = ", ".join(f"'{s}'" for s in url_filter.DOUBLE_SUFFIXES)
    least, most = url_filter.LEAST_STRENGTH, url_filter.MOST_STRENGTH

    def level(name: str, source: str, prior: str, size: str) -> str:
        return f"""
{name}_m AS (SELECT sum(n * {prior} * (1 - {prior})) AS within, sum(n * pow(k / n - {prior}, 2)) AS spread,
                    sum(n) AS n, sum({prior} * (1 - {prior})) AS noise FROM {source} WHERE n > 0),
{name}_c AS (SELECT CASE WHEN coalesce(n, 0) = 0 THEN {least} WHEN spread - noise <= 0 THEN {most}
                    ELSE least(greatest((within / n) / ((spread - noise) / n) - 1, {least}), {most}) END AS c FROM {name}_m),
{name} AS (SELECT s.*, (k + least(c, {size}) * {prior}) / (n + least(c, {size})) AS {name}_mean,
                  n + least(c, {size}) AS {name}_size FROM {source} s, {name}_c)"""

    return rf"""
WITH a AS (SELECT page_id,
    translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), '{url_filter.UPPER}', '{url_filter.LOWER}') AS host,
    coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
b AS (SELECT *, CASE {rule} END AS rule, CASE {verdict} END AS ruled FROM a),
o AS (SELECT host, CAST(count(ruled) AS DOUBLE) AS n, CAST(count(*) FILTER (ruled = 'block') AS DOUBLE) AS k FROM b GROUP BY host),
l AS (SELECT *, array_to_string(string_split(host, '.')[-2:], '.') AS two FROM o),
h0 AS (SELECT host, n, k,
    CASE WHEN two IN ({double}) THEN array_to_string(string_split(host, '.')[-3:], '.') ELSE two END AS domain,
    CASE WHEN two IN ({double}) THEN two ELSE string_split(host, '.')[-1] END AS suffix FROM l),
d0 AS (SELECT domain, suffix, sum(n) AS n, sum(k) AS k FROM h0 GROUP BY ALL),
s0 AS (SELECT suffix, sum(n) AS n, sum(k) AS k, CAST(0.5 AS DOUBLE) AS even, CAST({least} AS DOUBLE) AS even_size FROM d0 GROUP BY suffix),
{level("sx", "s0", "even", "even_size")},
d1 AS (SELECT d0.*, sx_mean, sx_size FROM d0 JOIN sx USING (suffix)),
{level("dx", "d1", "sx_mean", "sx_size")},
h1 AS (SELECT h0.*, dx_mean, dx_size FROM h0 JOIN dx USING (domain)),
{level("hx", "h1", "dx_mean", "dx_size")}
SELECT page_id, host, path, rule,
       coalesce(ruled, CASE WHEN hx_mean - {url_filter.SCORE_Z} * sqrt(hx_mean * (1 - hx_mean) / (hx_size + 1)) > {url_filter.BOUND}
                            THEN 'block' ELSE 'allow' END) AS verdict,
       round(hx_mean, 6) AS reputation
FROM b JOIN hx USING (host)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op4_exact_dedup": _EXACT_SQL,
        "op8_url_filter": _url_sql(),
        "op9_substring_dedup": _SUBSTRING_SQL,
        "op12_fill_in_middle": _MIDDLE_SQL,
        "mixing_targets": _TARGETS_SQL,
        "quality_base": _QUALITY_SQL,
    }
