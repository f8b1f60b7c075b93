"""Sources: driver tables, the reference's schemas, and nested JSON facts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

#: The seven tables' columns.
SCHEMAS = {
    "documents": "doc_id string, ticker string, company string, doc_type string, filing_date date, fiscal_period string, source_url string, raw_path string, ingested_at timestamp",
    "chunks": "chunk_id string, doc_id string, section string, chunk_index int, text string, n_tokens int",
    "financials": "ticker string, fiscal_year int, fiscal_qtr int, metric string, value decimal(28,4), unit string, period_end date, source_accn string, source_doc_id string, derived boolean",
    "guidance": "ticker string, fiscal_period string, given_on date, text string, source_doc_id string",
    "news_articles": "article_id string, ticker string, headline string, source string, published_at timestamp, url string, text string, topic string, event_id string, is_duplicate boolean, duplicate_of string",
    "routing_log": "id long, ts timestamp, query string, route string, method string, latency_ms int",
    "eval_results": "run_id string, question_id string, retriever string, recall double, precision double, mrr double, hit boolean, groundedness double, citation_correctness double, relevance double, ts timestamp",
}
FACT = "struct<start:string,end:string,val:double,accn:string,form:string,filed:string>"
COMPANY_FACTS = f"facts struct<`us-gaap`:map<string,struct<units:map<string,array<{FACT}>>>>>"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def empty(spark: SparkSession, name: str) -> DataFrame:
    """An empty table of the reference's schema."""
    return spark.createDataFrame([], SCHEMAS[name])


def company_facts(spark: SparkSession, path: str) -> DataFrame:
    """Landed companyfacts JSON, one row for each fact: ticker is the file's folder."""
    raw = spark.read.schema(COMPANY_FACTS).option("multiLine", True).json(path).withColumn("ticker", F.regexp_extract(F.input_file_name(), "([^/]+)/[^/]+$", 1))
    return facts_rows(raw.select("ticker", F.col("facts.us-gaap").alias("gaap")))


def facts_rows(gaap: DataFrame) -> DataFrame:
    """(ticker, gaap map) -> (ticker, tag, unit, start, end, val, accn, form, filed)."""
    tags = gaap.select("ticker", F.explode("gaap").alias("tag", "node"))
    units = tags.select("ticker", "tag", F.explode("node.units").alias("unit", "facts"))
    rows = units.select("ticker", "tag", "unit", F.inline("facts"))
    return rows.select("ticker", "tag", "unit", *(F.to_date(c).alias(c) for c in ("start", "end")), "val", "accn", "form", F.to_date("filed").alias("filed"))


def recent_filings(raw: DataFrame) -> DataFrame:
    """A struct of parallel arrays (accessionNumber, form, filingDate, reportDate, items) -> a row for each filing."""
    names = ("accessionNumber", "form", "filingDate", "reportDate", "items", "primaryDocument")
    zipped = F.arrays_zip(*(F.col(f"recent.{n}").alias(n) for n in names))
    return raw.select("ticker", F.posexplode(zipped).alias("pos", "f")).select("ticker", "pos", "f.*")


def html_files(spark: SparkSession, path: str) -> DataFrame:
    """Whole HTML files as text; bytes that are no UTF-8 become replacement characters."""
    return spark.read.format("binaryFile").load(path).select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("html"))


def table_counts(tables: dict[str, DataFrame | None]) -> DataFrame:
    """(table, n) of each table; null for one that isn't there, so a missing store shows as missing, not as empty."""
    spark = next(t.sparkSession for t in tables.values() if t is not None)
    rows = None
    for name, found in tables.items():
        one = (spark.range(1).select(F.lit(None).cast("long").alias("n")) if found is None else found.agg(F.count("*").alias("n"))).select(F.lit(name).alias("table"), "n")
        rows = one if rows is None else rows.unionByName(one)
    return rows


def cached_facts(spark: SparkSession, path: str, fetch: Callable[[], DataFrame], refresh: bool = False) -> DataFrame:
    """Company facts as they were landed under `path`; fetched and landed where there are none yet, or on refresh.

    fetch returns the rows (see facts_rows) of a source outside the engine. What it gives replaces what was landed only
    once it is written whole.
    """
    jvm = spark.sparkContext._jvm
    fs_path = lambda name: jvm.org.apache.hadoop.fs.Path(name)
    fs = fs_path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if refresh or not fs.exists(fs_path(f"{path}/_SUCCESS")):
        fresh = f"{path}.fresh"
        fetch().write.mode("overwrite").parquet(fresh)
        fs.delete(fs_path(path), True)
        if not fs.rename(fs_path(fresh), fs_path(path)):
            raise OSError(f"{fresh} can't take the place of {path}")
    return spark.read.parquet(path)


def questions(spark: SparkSession, path: str) -> DataFrame:
    schema = "id string, category string, route string, query string, tickers array<string>, expected_chunk_ids array<string>, expected_current_ids array<string>, expected_query string, expected_answer string, notes string"
    return spark.read.schema(schema).json(path)
