"""The query of the url filters and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from granary.llm.common import table
from granary.llm.url_filters import judge_urls, rules_frame

#: The rules the query is to apply.
RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]
#: The SQL's own values, as they were: its rule on net/de/ blocks, where the contract's allows.
SQL_RULES = [(h, p, "block" if (h, p) == ("net", "/de/") else v) for h, p, v in RULES]


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages. Null urls and urls without :// have an empty host and path, and the default verdict."""
    return judge_urls(table(spark, sf_dir, "pages"), rules_frame(spark, RULES), "allow")


_VALUES = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in SQL_RULES)
ORACLES = {
    "op7_url_filters": rf"""
WITH u AS (
  SELECT page_id,
    CASE WHEN position('://' IN coalesce(url, '')) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest
  FROM pages),
hp AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM u),
rules(h, p, v) AS (VALUES {_VALUES}),
fit AS (
  SELECT page_id, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS verdict
  FROM hp JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM hp LEFT JOIN fit USING (page_id)
"""
}
QUERIES = {"op7_url_filters": op7_url_filters}
