"""One query for each operator, over its whole table with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, bwt_dedup, common, fertility, lexical, licenses, mixing, pitman_yor, secrets, setsketch, url_reputation, warc, whitening, winnowing
from .common import read_table

#: Where the public vocabularies lie; a parameter of every operator that reads one.
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.tiktoken")
PIECES = public_tokenizers.path("piece_bpe_32k.model")

#: Fixed values of the url rules.
URL_RULES = {"org/": "allow", "example.org/es/": "block", "example.org/en/1": "block", "com/fr/": "allow", "com/de/": "block"}


def op1_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnowing.compare_with_next(read_table(spark, sf_dir, "documents"))


def op2_bwt_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bwt_dedup.digest(read_table(spark, sf_dir, "documents"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(read_table(spark, sf_dir, "pages"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(read_table(spark, sf_dir, "documents"), BYTE_BPE, public_tokenizers.PATTERN)


def op5_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pitman_yor.score(read_table(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.contract(read_table(spark, sf_dir, "documents"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes are the labels whose doc_id is a page's id: toxic or of low quality is bad."""
    labels = read_table(spark, sf_dir, "labels")
    bad = F.when((F.col("toxic") == 1) | (F.col("quality") == 0), 1).otherwise(0)
    outcomes = labels.filter(F.col("toxic").isNotNull() | F.col("quality").isNotNull()).select(F.col("doc_id").alias("page_id"), bad.alias("bad"))
    judged = url_reputation.judge(read_table(spark, sf_dir, "pages"), outcomes, URL_RULES)
    return judged.withColumns({c: F.round(c, 9) for c in ("bad_rate", "bad_chance")})


def op8_tokeniser_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fertility.judge(read_table(spark, sf_dir, "documents"), PIECES)


def op9_setsketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setsketch.near_duplicates(read_table(spark, sf_dir, "documents"), k=3, percent=85)


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(read_table(spark, sf_dir, "documents"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"), 50)


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.report(read_table(spark, sf_dir, "documents"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.components(read_table(spark, sf_dir, "embeddings"))


def queries() -> dict:
    return {
        "op1_winnowing": op1_winnowing,
        "op2_bwt_dedup": op2_bwt_dedup,
        "op3_warc": op3_warc,
        "op4_byte_bpe": op4_byte_bpe,
        "op5_pitman_yor": op5_pitman_yor,
        "op6_mixing": op6_mixing,
        "op7_url_filter": op7_url_filter,
        "op8_tokeniser_fertility": op8_tokeniser_fertility,
        "op9_setsketch": op9_setsketch,
        "op10_secret_scan": op10_secret_scan,
        "op11_lexical_search": op11_lexical_search,
        "op12_license_scan": op12_license_scan,
        "op13_whitening": op13_whitening,
    }


WARC_SQL = """WITH q AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
l AS (SELECT payload_digest, payload_bytes, max(page_id) AS leader FROM q WHERE payload_bytes >= 1000 GROUP BY ALL HAVING count(*) > 1)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id <> leader THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id <> leader THEN leader END AS refers_to,
 CASE WHEN page_id <> leader THEN NULL ELSE true END AS digest_ok FROM q LEFT JOIN l USING (payload_digest, payload_bytes)"""

_TWO = ", ".join(f"'{s}'" for s in url_reputation.TWO_LABEL_SUFFIXES)
_STRENGTH = """(SELECT least(greatest(CASE WHEN p > 0 AND p < 1 AND k / n < 1 AND ((bb - b * p) / n / (p * (1 - p)) - k / n) / (1 - k / n) > 0 THEN 1 / (((bb - b * p) / n / (p * (1 - p)) - k / n) / (1 - k / n)) - 1 ELSE 1000 END, 1), 1000)
 FROM (SELECT sum(bad) / sum(n) AS p, count(*) AS k, sum(n)::DOUBLE AS n, sum(bad)::DOUBLE AS b, sum(bad * bad / n) AS bb FROM {} WHERE n > 0))"""
_MODE, _SD = "ln(a / (z - a))", "sqrt(z / (a * (z - a)))"
_CUT = f"least(greatest(asinh((ln({url_reputation.LIMIT} / (1 - {url_reputation.LIMIT})) - {_MODE}) / {_SD}), -{url_reputation.REACH}), {url_reputation.REACH})"
_DENSITY = "(a * (least({0}, 0.0::DOUBLE) - ln(1 + exp(-abs({0})))) + (z - a) * (least(-({0}), 0.0::DOUBLE) - ln(1 + exp(-abs({0})))))"


def _integral(low: str, high: str) -> str:
    """Simpson's rule as a sum over a list."""
    v = f"({low} + ({high} - ({low})) / {url_reputation.STEPS} * i)"
    term = f"(CASE WHEN i = 0 OR i = {url_reputation.STEPS} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * exp({_DENSITY.format(f'({_MODE} + {_SD} * sinh({v}))')} - {_DENSITY.format(_MODE)}) * cosh({v}))"
    return f"(list_sum(list_transform(range(0, {url_reputation.STEPS + 1}), lambda i: {term})) * ({high} - ({low})) / {url_reputation.STEPS})"


_BELOW, _ABOVE = _integral(f"-{url_reputation.REACH}", _CUT), _integral(_CUT, str(url_reputation.REACH))
_CHANCE = f"({_ABOVE} / ({_BELOW} + {_ABOVE}))"
URL_SQL = f"""WITH r AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
t AS (SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS h, regexp_extract(rest, '^[^?#]*') AS hp FROM r),
parts AS (SELECT page_id, translate(h, '{common.UPPER}', '{common.LOWER}') AS host, substr(hp, length(h) + 1) AS path FROM t),
seen AS (SELECT doc_id AS page_id, count(*) AS n, sum(CASE WHEN toxic = 1 OR quality = 0 THEN 1 ELSE 0 END) AS bad FROM labels WHERE toxic IS NOT NULL OR quality IS NOT NULL GROUP BY 1),
hosts AS (SELECT *, CASE WHEN two IN ({_TWO}) THEN two ELSE labels[-1] END AS suffix, CASE WHEN regexp_matches(host, '^[0-9.]+$|:') THEN host WHEN two IN ({_TWO}) THEN array_to_string(labels[-3:], '.') ELSE two END AS domain FROM
 (SELECT host, string_split(host, '.') AS labels, array_to_string(string_split(host, '.')[-2:], '.') AS two, sum(coalesce(n, 0)) AS n, sum(coalesce(bad, 0)) AS bad FROM parts LEFT JOIN seen USING (page_id) GROUP BY 1)),
domains AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM hosts GROUP BY 1, 2), suffixes AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM domains GROUP BY 1),
ws AS (SELECT coalesce({_STRENGTH.format("suffixes")}, 1000) AS s), wd AS (SELECT coalesce({_STRENGTH.format("domains")}, 1000) AS s), wh AS (SELECT coalesce({_STRENGTH.format("hosts")}, 1000) AS s),
ms AS (SELECT suffix, n, bad, s AS st, s * (sum(bad) OVER () - bad + 0.5) / (sum(n) OVER () - n + 1) AS prior FROM suffixes, ws),
md AS (SELECT domain, domains.n, domains.bad, s AS st, s * (ms.bad - domains.bad + prior) / (ms.n - domains.n + st) AS prior FROM domains JOIN ms USING (suffix), wd),
mh AS (SELECT host, CASE WHEN hosts.n = 0 THEN md.bad + prior ELSE hosts.bad + s * (md.bad - hosts.bad + prior) / (md.n - hosts.n + st) END AS a, CASE WHEN hosts.n = 0 THEN md.n + st ELSE hosts.n + s END AS z FROM hosts JOIN md USING (domain), wh),
p AS (SELECT host, a / z AS mean, CASE WHEN a / z >= {url_reputation.CONFIDENCE * url_reputation.LIMIT} THEN {_CHANCE} END AS chance FROM mh),
j AS (SELECT page_id, host, path, mean, chance,
 CASE WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/en/1') THEN 'example.org/en/1' WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/es/') THEN 'example.org/es/'
  WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/fr/') THEN 'com/fr/' WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/de/') THEN 'com/de/' WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/') THEN 'org/' END AS rule FROM parts JOIN p USING (host))
SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.org/en/1', 'example.org/es/', 'com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' WHEN host <> '' AND chance >= {url_reputation.CONFIDENCE} THEN 'block' ELSE 'allow' END AS verdict, round(mean, 9) AS bad_rate, round(chance, 9) AS bad_chance FROM j"""

NEAR_SQL = f"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{common.UPPER}', '{common.LOWER}'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 3 THEN list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1), i AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM i JOIN n p ON x = p.doc_id JOIN n q ON y = q.doc_id WHERE 100 * c >= 85 * (p.n + q.n - c)), e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
reach AS (SELECT doc_id AS d, doc_id AS r FROM documents UNION SELECT d, y FROM reach JOIN e ON r = x),
c AS (SELECT d AS doc_id, min(r) AS component_id FROM reach GROUP BY 1)
SELECT documents.doc_id, coalesce(n, 0) AS n_shingles, component_id, documents.doc_id = component_id AS kept FROM documents JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)"""


_QUOTED = ", ".join("({}, '{}', '{}')".format(i, label, text.replace("'", "''")) for i, (label, text) in enumerate(licenses.TEMPLATES))
_LIST = rf"regexp_extract_all(translate({{}}, '{common.UPPER}', '{common.LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_GRAM = " || ' ' || ".join(f"ws[i + {j}]" for j in range(licenses.K))
_PLACES = " UNION ALL ".join(
    f"SELECT r, i - 1 AS place, '{label}' AS label FROM (SELECT r, ws, unnest(range(1, len(ws) - {len(p.split()) - 2})) AS i FROM d) WHERE " + " AND ".join(f"ws[i + {j}] = '{w}'" for j, w in enumerate(p.split()))
    for p, label in licenses.PHRASES.items()
)
LICENSE_SQL = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_LIST.format("coalesce(text, '')")} AS ws FROM documents),
tw AS (SELECT t, label, {_LIST.format("body")} AS ws FROM (VALUES {_QUOTED}) v(t, label, body)),
tg AS (SELECT t, label, len(ws) AS size, i - 1 AS ta, {_GRAM} AS g FROM (SELECT *, unnest(range(1, len(ws) - {licenses.K - 2})) AS i FROM tw)),
dg AS (SELECT r, i - 1 AS pos, {_GRAM} AS g FROM (SELECT r, ws, unnest(range(1, len(ws) - {licenses.K - 2})) AS i FROM d)),
m AS (SELECT r, t, label, size, pos, ta, pos - ta AS diagonal FROM dg JOIN tg USING (g)),
n AS (SELECT r, t, diagonal, sum(fresh) OVER (PARTITION BY r, t ORDER BY diagonal) AS span FROM
 (SELECT r, t, diagonal, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY r, t ORDER BY diagonal) > {licenses.SLACK} THEN 1 ELSE 0 END AS fresh FROM (SELECT DISTINCT r, t, diagonal FROM m))),
c AS (SELECT r, t, label, span, count(DISTINCT ta + j)::DOUBLE AS covered, any_value(size) AS size, max(pos) + {licenses.K} - min(pos) AS width FROM m JOIN n USING (r, t, diagonal), range(0, {licenses.K}) x(j) GROUP BY ALL),
s AS (SELECT r, max(covered / size) AS score, count(*) FILTER (covered / size >= {licenses.LEAST} AND covered / width >= {licenses.DENSE}) AS n_spans,
 list(label) FILTER (covered / size >= {licenses.LEAST} AND covered / width >= {licenses.DENSE}) AS own FROM c GROUP BY 1),
p AS (SELECT r, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, list(label) AS base FROM ({_PLACES}) GROUP BY 1)
SELECT doc_id, len(ws) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(array_to_string(list_sort(list_distinct(base)), ','), '') AS base_labels,
 coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base, []), coalesce(own, [])))), ','), '') AS labels, round(coalesce(score, 0.0), 9) AS score, coalesce(n_spans, 0) AS n_spans
FROM d LEFT JOIN s USING (r) LEFT JOIN p USING (r)"""

_TERMS = rf"regexp_extract_all(translate(coalesce(text, ''), '{common.UPPER}', '{common.LOWER}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
SEARCH_SQL = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS ws FROM documents), c AS (SELECT count(*) FILTER (len(ws) > 0) AS n, sum(len(ws))::BIGINT AS l FROM d),
p AS (SELECT r, doc_id, len(ws)::BIGINT AS n, t, count(*)::BIGINT AS tf FROM (SELECT r, doc_id, ws, unnest(ws) AS t FROM d) GROUP BY ALL), f AS (SELECT t, count(*) AS df FROM p GROUP BY 1),
q AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS t FROM benchmark), w AS (SELECT t, floor(1000 * ln((2 * n + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM f, c),
s AS (SELECT item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * p.n * c.n) // l))))::BIGINT AS score FROM q JOIN w USING (t) JOIN p USING (t), c GROUP BY ALL)
SELECT item_id, rank, doc_id, score FROM (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank, doc_id, score FROM s WHERE score > 0) WHERE rank <= 50"""


def oracle_sql() -> dict[str, str]:
    """For the operators whose whole result SQL can express."""
    return {"op3_warc": WARC_SQL, "op7_url_filter": URL_SQL, "op9_setsketch": NEAR_SQL, "op11_lexical_search": SEARCH_SQL, "op12_license_scan": LICENSE_SQL}
