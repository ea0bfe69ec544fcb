"""op1: verdict on every page's URL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..common import table
from ..url_filter import PAD, UrlModel, judge_urls
from .crc import crc_sql

NAME = "op1_url_filter"
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge_urls(table(spark, sf_dir, "pages"), RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict", F.round("score", 5).alias("score"))


_M = UrlModel()
_RULE_ROWS = ", ".join(f"('{v}', '{r}', '{r.split('/', 1)[0]}', '/{r.split('/', 1)[1]}')" for v, r in RULES)
_PADS = f"repeat(chr({ord(PAD)}), {_M.order})"
_LEVELS = "".join(
    f"""l{k} AS (SELECT substr(g, 2) AS g, sum(a) AS a, sum(r) AS r FROM l{k + 1} GROUP BY ALL),
""" for k in range(_M.order - 1, -1, -1)
)
_SOLVED = "".join(
    f"""s{k} AS (SELECT l.g, {', '.join(
        f"CASE WHEN {'true' if k == 0 else f'ta + tr >= {_M.min_context}'} THEN ({c} + {_M.smoothing} * b{c}) / (t{c} + {_M.smoothing}) ELSE b{c} END AS p{c}" for c in 'ar')}
  FROM (SELECT g, a, r, sum(a) OVER (PARTITION BY left(g, {k})) AS ta, sum(r) OVER (PARTITION BY left(g, {k})) AS tr FROM l{k}) l
  JOIN {f'(SELECT 1.0::DOUBLE / {_M.alphabet} AS ba, 1.0::DOUBLE / {_M.alphabet} AS br) b ON true' if k == 0 else f'(SELECT g AS bg, pa AS ba, pr AS br FROM s{k - 1}) b ON substr(l.g, 2) = bg'}),
""" for k in range(_M.order + 1)
)

ORACLE = f"""
WITH rules(v, rule, h, p) AS (VALUES {_RULE_ROWS}),
parts AS (SELECT page_id, url, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
hp AS (SELECT page_id, url, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts),
ruled AS (SELECT *, (SELECT arg_max(struct_pack(v := v, rule := rule), length(rule)) FROM rules
  WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)) AS x FROM hp),
urls AS (SELECT url, max(x.v) AS label FROM ruled WHERE url IS NOT NULL GROUP BY url),
folds AS (SELECT url, label, {crc_sql("url")} % 5 AS fold FROM urls),
wins AS (SELECT url, label, fold, substr({_PADS} || translate(url, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), i::INTEGER, {_M.order + 1}) AS g
  FROM folds, LATERAL (SELECT unnest(range(1, length(url) + 1)) AS i)),
l{_M.order} AS (SELECT g, count(*) FILTER (fold <> 0 AND label = 'allow') AS a, count(*) FILTER (fold <> 0 AND label = 'block') AS r FROM wins GROUP BY g),
{_LEVELS}{_SOLVED}scores AS (SELECT url, any_value(label) AS label, any_value(fold) AS fold, avg(ln(pa) - ln(pr)) AS score FROM wins JOIN s{_M.order} USING (g) GROUP BY url),
bins AS (SELECT greatest({-_M.clip}, least({_M.clip}, floor(score / {_M.grid})))::INTEGER AS bin, count(*) FILTER (label = 'allow') AS a, count(*) FILTER (label = 'block') AS r
  FROM scores WHERE fold = 0 AND label IS NOT NULL GROUP BY 1),
cuts AS (SELECT b.bin, sum(o.a) FILTER (o.bin >= b.bin) / sum(o.a) + coalesce(sum(o.r) FILTER (o.bin < b.bin), 0) / sum(o.r) AS q FROM bins b, bins o GROUP BY b.bin),
best AS (SELECT bin FROM cuts WHERE q IS NOT NULL ORDER BY q DESC, abs(bin), bin LIMIT 1),
cut AS (SELECT coalesce((SELECT (best.bin + coalesce((SELECT max(b.bin) + 1 FROM bins b WHERE b.bin < best.bin), best.bin)) / 2 * {_M.grid} FROM best), 0) AS t)
SELECT page_id, host, path, x.rule AS rule, coalesce(x.v, CASE WHEN score >= (SELECT t FROM cut) THEN 'allow' ELSE 'block' END) AS verdict, round(score, 5) AS score
FROM ruled LEFT JOIN scores USING (url)
"""
