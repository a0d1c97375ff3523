"""The corpus operators as queries over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from candela.llm import ann, jaccard, langid, linededup, mixing, packing, quality, secrets, tokenfile, urls
from candela.llm.common import read


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(mixing.mix(read(spark, sf_dir, "documents")))


def op2_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(read(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op3_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit(read(spark, sf_dir, "documents"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(read(spark, sf_dir, "pages"), urls.rules_table(spark))


def op5_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    return ann.nearest(vectors.filter("vec_id % 100 = 0"), vectors)


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(read(spark, sf_dir, "documents"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup(read(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_removed")


def op8_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenfile.fresh_path(spark, "token-ids")
    tokenfile.write(read(spark, sf_dir, "documents"), path)
    return tokenfile.read(spark, path)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.assess(read(spark, sf_dir, "documents"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_mix, op2_jaccard, op3_best_fit, op4_url_filter, op5_nearest, op6_language, op7_line_dedup, op8_token_file, op9_quality, op10_secrets)}

#: Distances from a table of references, and whether they are too far.
_FAR = f"""SELECT *, chars >= {quality.LEAST_CHARS} AND c > {quality.FAR_CHARS} OR n_words >= {quality.LEAST_WORDS} AND o > {quality.FAR_WORDS} AS odd FROM (
    SELECT *, coalesce(sqrt(greatest(0, list_sum(d[1:{len(quality.CLASSES)}]))), 0) AS c, coalesce(sqrt(greatest(0, list_sum(d[{len(quality.CLASSES) + 1}:]))), 0) AS o FROM (
      SELECT b.*, list_transform(list_zip(p, m.v), lambda z: (CASE WHEN z[1] > 0 THEN z[1] * log2(z[1] / ((z[1] + z[2]) / 2)) ELSE 0 END + CASE WHEN z[2] > 0 THEN z[2] * log2(z[2] / ((z[1] + z[2]) / 2)) ELSE 0 END) / 2) AS d
      FROM based b LEFT JOIN {{}} m ON b.key = m.key))"""

SQL = {
    "op1_mix": r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5('mix:' || coalesce(doc_id::VARCHAR, '')) AS o FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM sized GROUP BY source
), weighed AS (
  SELECT *, (place - 1) % 3 + 1 AS weight, 3 * source_size AS stop, sum(source_size) OVER ()::BIGINT AS total, sum((place - 1) % 3 + 1) OVER ()::BIGINT AS all_weights FROM sources
), rising AS (
  SELECT *, coalesce(sum(stop) OVER w, 0)::BIGINT AS stops_before, coalesce(sum(weight) OVER w, 0)::BIGINT AS weights_before FROM weighed
  WINDOW w AS (ORDER BY stop / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), stopped AS (
  SELECT *, stop * (all_weights - weights_before) <= weight * (total - stops_before) AS stops FROM rising
), targets AS (
  SELECT source, source_size, CASE WHEN stops THEN stop::DOUBLE ELSE (weight * (total - coalesce(sum(stop) FILTER (stops) OVER (), 0)))::DOUBLE / (all_weights - coalesce(sum(weight) FILTER (stops) OVER (), 0))::DOUBLE END AS target FROM stopped
), points AS (
  SELECT *, round(target)::BIGINT AS words, sum(ceil(round(target) / 512)::BIGINT) OVER (ORDER BY source NULLS LAST)::BIGINT AS high, ceil(round(target) / 512)::BIGINT AS blocks FROM targets
), slots AS (
  SELECT source, slot, row_number() OVER (PARTITION BY source ORDER BY slot) - 1 AS rank FROM (
    SELECT source, list_sum([((v >> i) & 1) << (45 - i) FOR i IN range(46)])::BIGINT AS slot FROM (SELECT source, unnest(range(high - blocks, high)) AS v FROM points))
), placed AS (
  SELECT row_number() OVER () AS k, s.*, t.source_size, t.target, t.words, sum(size) OVER (PARTITION BY s.source ORDER BY o, s.doc_id NULLS LAST, size ROWS UNBOUNDED PRECEDING)::BIGINT - size AS start
  FROM sized s JOIN points t ON s.source IS NOT DISTINCT FROM t.source
), passes AS (
  SELECT k, source, words, p * source_size + start AS a, p * source_size + start + size AS b FROM placed, range(3) r(p) WHERE size > 0
), shares AS (
  SELECT k, source, greatest(a, n * 512) AS a, least(b, n * 512 + 512, words) AS b, n FROM (SELECT *, unnest(range(a // 512, (b - 1) // 512 + 1)) AS n FROM passes)
), takes AS (
  SELECT k, sum(b - a)::BIGINT AS taken, min(slot) AS first_slot, max(slot) AS last_slot FROM shares s JOIN slots t ON s.source IS NOT DISTINCT FROM t.source AND s.n = t.rank WHERE b > a GROUP BY k
)
SELECT doc_id, size, source_size, target, coalesce(taken, 0) AS taken, first_slot, last_slot FROM placed LEFT JOIN takes USING (k)
""",
    "op4_url_filter": r"""
WITH parsed AS (
  SELECT row_number() OVER () AS k, page_id, url, strpos(url, '://') AS i, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages
), p AS (
  SELECT k, page_id, coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host, coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM parsed
), listed(h, f, v, is_rule) AS (
  VALUES ('com', '/en/', 'block', true), ('example.com', '/en/7', 'allow', true), ('net', '/de/', 'allow', true), ('example.net', '/de/8', 'block', true), ('org', '/es/', 'block', true),
    ('adult-x.example.net', '/', 'block', false), ('casino-win.example.com', '/', 'block', false), ('cheap-pills.example.com', '/', 'block', false), ('spam-farm.example.com', '/', 'block', false)
), hits AS (
  SELECT k, h || f AS u, v, is_rule, row_number() OVER (PARTITION BY k, is_rule ORDER BY len(h || f) DESC, len(f) DESC, h || f DESC) AS n
  FROM p JOIN listed ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, f)
)
SELECT page_id, host, path, r.u AS rule, coalesce(r.v, l.v, 'allow') AS verdict, l.u AS listed_url
FROM p LEFT JOIN hits r ON p.k = r.k AND r.is_rule AND r.n = 1 LEFT JOIN hits l ON p.k = l.k AND NOT l.is_rule AND l.n = 1
""",
    "op7_line_dedup": r"""
WITH split AS (
  SELECT DISTINCT doc_id, text, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL
), windows AS (
  SELECT doc_id, text, i0, l[i0 + 1 : i0 + 3] AS w FROM (SELECT *, unnest(range(greatest(len(l) - 2, 1))) AS i0 FROM split)
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY w ORDER BY doc_id NULLS LAST, text, i0) AS nth FROM windows WHERE len(list_filter(w, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) > 0
), gone AS (
  SELECT doc_id, text, list_distinct(flatten(list([i0, i0 + 1, i0 + 2]))) AS places FROM ranked WHERE nth > 1 GROUP BY doc_id, text
), joined AS (
  SELECT d.doc_id, d.text, string_split(d.text, chr(10)) AS l, g.places FROM documents d LEFT JOIN gone g ON d.doc_id IS NOT DISTINCT FROM g.doc_id AND d.text = g.text
), rest AS (
  SELECT *, list_filter(range(len(l)), lambda i: NOT coalesce(list_contains(places, i), false)) AS kept FROM joined
)
SELECT doc_id, CASE WHEN places IS NULL THEN text ELSE array_to_string([l[i + 1] FOR i IN kept], chr(10)) END AS text, coalesce(len(l), 0)::BIGINT AS n_lines, coalesce(len(l) - len(kept), 0)::BIGINT AS n_removed FROM rest
""",
    "op9_quality": rf"""
WITH docs AS (
  SELECT row_number() OVER () AS k, doc_id, lang, text, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    regexp_extract_all(regexp_replace(lower(coalesce(text, '')), '{quality.MARKS}', '', 'g'), '[^\x20\x09-\x0D]+') AS bare,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents
), langs AS (
  SELECT lang FROM docs WHERE text IS NOT NULL AND lang <> '' GROUP BY lang HAVING count(*) >= {quality.LEAST_DOCS}
), keyed AS (
  SELECT d.*, coalesce(g.lang, '') AS key FROM docs d LEFT JOIN langs g ON d.lang = g.lang
), frequent AS (
  SELECT key, word, row_number() OVER (PARTITION BY key ORDER BY count(*) DESC, word) AS place FROM (SELECT key, unnest(list_distinct(bare)) AS word FROM keyed WHERE text IS NOT NULL) WHERE regexp_matches(word, '\p{{L}}') GROUP BY key, word
), lists AS (
  SELECT key, list(word ORDER BY place) AS listed FROM frequent WHERE place <= {quality.COMMON} GROUP BY key
), windows AS (
  SELECT k, i0, count(*) OVER (PARTITION BY k, w[i0], w[i0 + 1], w[i0 + 2]) AS n FROM (SELECT k, w, unnest(range(1, len(w) - 1)) AS i0 FROM docs)
), repeated AS (
  SELECT k, count(DISTINCT i0 + j) AS n FROM windows, unnest([0, 1, 2]) AS u(j) WHERE n > 1 GROUP BY k
), held AS (
  SELECT d.*, coalesce(f.listed, []) AS listed FROM keyed d LEFT JOIN lists f ON d.key = f.key
), counted AS (
  SELECT k, doc_id, key, len(w) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words,
    length(t) - length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS blank, length(t) - length(regexp_replace(t, '[a-z]+', '', 'g')) AS lower_, length(t) - length(regexp_replace(t, '[A-Z]+', '', 'g')) AS upper_,
    length(t) - length(regexp_replace(t, '[0-9]+', '', 'g')) AS digit, length(t) - length(regexp_replace(t, '\p{{L}}+', '', 'g')) AS letters, length(t) AS chars,
    [len(list_filter(bare, lambda x: x = listed[i])) FOR i IN range(1, {quality.COMMON + 1})] AS common
  FROM held LEFT JOIN repeated r USING (k)
), based AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    list_concat(list_transform([blank, lower_, upper_, digit, letters - lower_ - upper_, chars - blank - letters - digit], lambda x: x / greatest(chars, 1)),
      list_transform(list_append(common, greatest(n_words - list_sum(common), 0)), lambda x: x / greatest(n_words, 1))) AS p FROM counted
), mean1 AS (
  SELECT key, list(x ORDER BY i0) AS v FROM (SELECT key, i0, avg(x) AS x FROM (SELECT key, unnest(p) AS x, unnest(range(len(p))) AS i0 FROM based WHERE NOT base_failed) GROUP BY key, i0 HAVING count(*) >= {quality.LEAST_DOCS}) GROUP BY key
), far1 AS (
  {_FAR.format("mean1")}
), mean2 AS (
  SELECT key, list(x ORDER BY i0) AS v FROM (SELECT key, i0, avg(x) AS x FROM (SELECT key, unnest(p) AS x, unnest(range(len(p))) AS i0 FROM far1 WHERE NOT base_failed AND NOT odd) GROUP BY key, i0 HAVING count(*) >= {quality.LEAST_DOCS}) GROUP BY key
), far2 AS (
  {_FAR.format("mean2")}
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT odd AS kept, round(c, 6) AS char_distance, round(o, 6) AS word_distance FROM far2
""",
}
