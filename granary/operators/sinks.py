"""Sinks as DataFrame results: upserts, replaced series, deletes, skips and logs over plain Parquet."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, Window, functions as F

#: The columns that a new filing's row in the manifest has.
MANIFEST = ["doc_id", "ticker", "company", "doc_type", "filing_date", "fiscal_period", "source_url", "raw_path"]


def upsert(old: DataFrame, new: DataFrame, keys: list[str], latest: str = "__nth") -> DataFrame:
    """New rows win by key; of several new rows of one key, the one of the highest `latest` stays, where that is a column.

    `latest` is dropped unless old has it too. Rows with a null in a key are of no key: they are added as they are.
    """
    stay = old.join(new.select(*keys).distinct(), keys, "left_anti")
    if latest in new.columns:
        nth = "nth"
        while nth in new.columns:
            nth = f"_{nth}"
        known = " and ".join(f"`{k}` is not null" for k in keys)
        last = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(latest)))
        new = new.withColumn(nth, last).where(f"`{nth}` = 1 or not ({known})").drop(nth, *[latest] * (latest not in old.columns))
    return stay.unionByName(new, allowMissingColumns=True)


def merge_columns(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Upsert of some columns only: what new leaves null or doesn't have stays as it was."""
    others = [c for c in dict.fromkeys([*old.columns, *new.columns]) if c not in keys]
    o, n = old.alias("o"), new.alias("n")
    both = o.join(n, keys, "full_outer")
    pick = lambda c: F.coalesce(*[F.col(f"{a}.{c}") for a, df in (("n", new), ("o", old)) if c in df.columns]).alias(c)
    return both.select(*keys, *map(pick, others))


def replace_series(old: DataFrame, new: DataFrame, series: list[str]) -> DataFrame:
    """Every series that new has is dropped from old as a whole."""
    return old.join(new.select(*series).distinct(), series, "left_anti").unionByName(new)


def delete_by(old: DataFrame, keys: DataFrame) -> DataFrame:
    return old.join(keys, keys.columns, "left_anti")


skip_existing = delete_by


def insert_manifest(old: DataFrame, new: DataFrame) -> DataFrame:
    """The manifest with the rows of unknown filings added: MANIFEST's columns are taken, others (ingested_at) are null.

    A filing that is known stays as it was; of several new rows of one doc_id, the least by all columns is taken.
    """
    first = F.row_number().over(Window.partitionBy("doc_id").orderBy(*MANIFEST[1:]))
    rows = new.select(*MANIFEST).where("doc_id is not null").withColumn("nth", first).where("nth = 1").drop("nth")
    return old.unionByName(skip_existing(rows, old.select("doc_id")), allowMissingColumns=True)


def upsert_vectors(old: DataFrame, chunks: DataFrame, vectors: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Vectors by chunk, with the chunk's columns as payload: new ones win. As many vectors as chunks, or an error.

    A chunk without a vector, or a vector without a chunk, is an error too, as the counts then hide a mismatch.
    """
    n, m = chunks.count(), vectors.count()
    both = chunks.join(vectors, key)
    if n != m or both.count() != n:
        raise ValueError(f"{n} chunks but {m} vectors, or not of the same chunks")
    return upsert(old, both, [key])


def known_or_null(rows: DataFrame, documents: DataFrame, accn: str = "source_accn", out: str = "source_doc_id") -> DataFrame:
    """The accession as a document id where such a document is known, else null."""
    known = documents.select(F.col("doc_id").alias(accn)).distinct().withColumn(out, F.col(accn))
    return rows.drop(out).join(known, accn, "left")


def append_log(log: DataFrame, path: str) -> bool:
    """Appends to a log; a failure is logged and reported, never raised."""
    try:
        log.write.mode("append").parquet(path)
    except Exception:
        logging.getLogger(__name__).warning("rows for the log at %s are lost", path, exc_info=True)
        return False
    return True


def newest(log: DataFrame, n: int, at: str = "ts", tie: str = "id") -> DataFrame:
    return log.orderBy(F.desc(at), F.desc(tie)).limit(n)


def markdown_table(rows: DataFrame) -> str:
    """Renders a small result; the caller limits it."""
    lines = [f"| {' | '.join(rows.columns)} |", "|" + "---|" * len(rows.columns)]
    return "\n".join(lines + [f"| {' | '.join('' if v is None else str(v) for v in r)} |" for r in rows.collect()])


def results_markdown(scores: DataFrame, run_id: str, modes: tuple[str, ...]) -> str:
    """Evaluation as Markdown: a table of all modes, then reciprocal rank and precision by category and mode.

    scores: mode, category (null: all), n and the means of the metrics, with latency_ms where it was measured.
    """
    rows = scores.collect()  # modes by categories
    number = lambda r, c, form="{:.3f}": "—" if r is None or c not in r or r[c] is None else form.format(r[c])
    overall = {r["mode"]: r for r in rows if r["category"] is None}
    by = {(r["category"], r["mode"]): r for r in rows if r["category"] is not None}
    shown = [m for m in modes if m in overall]
    grid = lambda head, body: "\n".join(f"| {' | '.join(line)} |" for line in [head, ["---"] * len(head), *body])
    out = [f"# Retrieval evaluation\n\nRun `{run_id}`\n\n## Overall\n"]
    out.append(grid(["retriever", "recall", "precision", "mrr", "hit", "freshness", "median ms"], [[f"`{m}`", *(number(overall[m], c) for c in ("recall", "precision", "mrr", "hit", "freshness")), number(overall[m], "latency_ms", "{:.0f}")] for m in shown]))
    for metric in ("mrr", "precision"):
        out.append(f"\n## By category: {metric}\n")
        out.append(grid(["category", *(f"`{m}`" for m in shown)], [[c, *(number(by.get((c, m)), metric) for m in shown)] for c in sorted({c for c, _ in by})]))
    return "\n".join(out) + "\n"
