"""Fill-in-the-middle rearrangement of texts, in Spark SQL functions alone.

A text is an array of units: regexp_extract_all matches every character, so joining the units gives the text back. Eight
hex digits of a sha2 over seed and id make a number by conv; two such numbers cut the array, a third decides whether a
text is rearranged at all, a fourth in which order. slice and array_join build prefix, middle and suffix. A text that
holds a sentinel itself stays plain, so a rearranged output holds each sentinel once and splitting at them restores it.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

#: A token with the white space before it, or the white space at the end of a text.
UNIT = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
#: Stand before prefix, suffix and middle.
SENTINELS = ("<P>", "<S>", "<M>")
COLUMNS = ("n", "form", "prefix_chars", "middle_chars", "output")


def digest_numbers(key: Column, many: int = 4) -> list[Column]:
    """The first groups of eight hex digits of the key's sha256, as unsigned numbers."""
    digest = F.sha2(key, 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(many)]


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text that an output of a form was built from; null stays null."""
    parts = F.split(output, "|".join(rf"\Q{s}\E" for s in sentinels), -1)
    part = lambda k: F.get(parts, F.lit(k))
    return F.when(form == "psm", F.concat(part(1), part(3), part(2))).when(form == "spm", F.concat(part(2), part(3), part(1))).otherwise(output)


def fill_in_middle(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 42, rate: int = 50, spm_rate: int = 80, sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """A row for each document: its id, n units, form, prefix_chars and middle_chars (null if plain), and the output.

    `rate` percent of the texts are rearranged, `spm_rate` percent of these with the suffix first (spm), others with the
    prefix first (psm). Null and empty texts, and texts that hold a sentinel, stay plain; a null text counts as empty. A
    null id is cut like an id of no digits; rows of the same id get the same numbers, repeated rows a row each. A text of
    any length is one row's work, linear in its length. An empty table gives no rows; other columns are not read. The id
    must not have the name of a result.
    """
    if id_col in COLUMNS:
        raise ValueError(f"{id_col} is the name of a result")
    if len(set(sentinels)) < 3 or any(not s or re.search(r"\\E", s) for s in sentinels):
        raise ValueError("sentinels are three different strings")
    before, after, between = sentinels
    h1, h2, h3, h4 = digest_numbers(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))))
    plain = (F.col("text") == "") | F.contains("text", F.lit(before)) | F.contains("text", F.lit(after)) | F.contains("text", F.lit(between)) | (h3 % 100 >= rate)
    joined = lambda first, length: F.array_join(F.slice("units", F.col(first).cast("int") + 1, length.cast("int")), "")
    units = (
        df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
        .withColumn("units", F.regexp_extract_all("text", F.lit(UNIT), F.lit(0)))
        .withColumn("n", F.size("units").cast("long"))
        .withColumn("form", F.when(plain, "plain").when(h4 % 100 < spm_rate, "spm").otherwise("psm"))
        .withColumns({"cut1": h1 % (F.col("n") + 1), "cut2": h2 % (F.col("n") + 1)})
        .withColumns({"zero": F.lit(0), "low": F.least("cut1", "cut2"), "high": F.greatest("cut1", "cut2")})
    )
    moved = F.col("form") != "plain"
    parts = units.withColumns(
        {"prefix": F.when(moved, joined("zero", F.col("low"))), "middle": F.when(moved, joined("low", F.col("high") - F.col("low"))), "suffix": F.when(moved, joined("high", F.col("n") - F.col("high")))}
    )
    output = (
        F.when(F.col("form") == "psm", F.concat(F.lit(before), "prefix", F.lit(after), "suffix", F.lit(between), "middle"))
        .when(F.col("form") == "spm", F.concat(F.lit(after), "suffix", F.lit(before), "prefix", F.lit(between), "middle"))
        .otherwise(F.col("text"))
    )
    chars = lambda part: F.char_length(part).cast("long")
    return parts.select(F.col("id").alias(id_col), "n", "form", chars("prefix").alias("prefix_chars"), chars("middle").alias("middle_chars"), output.alias("output"))
