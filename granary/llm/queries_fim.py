"""The query of the fill-in-the-middle operator and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from granary.llm.common import table
from granary.llm.fill_in_middle import fill_in_middle, restored


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, whole texts. Null texts are empty and plain; repeated rows have a row each."""
    made = fill_in_middle(table(spark, sf_dir, "documents"))
    whole = restored(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(whole, 256).alias("restored_sha256"))


_H = "CAST('0x' || substr(h, {}, 8) AS BIGINT)"
ORACLES = {
    "op11_fill_in_middle": rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (SELECT *, regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS w FROM d),
c AS (
  SELECT *, len(w) AS n, {_H.format(1)} % (len(w) + 1) AS c1, {_H.format(9)} % (len(w) + 1) AS c2,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR {_H.format(17)} % 100 >= 50 THEN 'plain'
      WHEN {_H.format(25)} % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM u),
p AS (
  SELECT *, array_to_string(w[1 : least(c1, c2)], '') AS p, array_to_string(w[least(c1, c2) + 1 : greatest(c1, c2)], '') AS m,
    array_to_string(w[greatest(c1, c2) + 1 : n], '') AS s
  FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE t END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM p
"""
}
QUERIES = {"op11_fill_in_middle": op11_fill_in_middle}
