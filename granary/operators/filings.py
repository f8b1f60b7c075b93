"""Filings: choice, manifest, exhibits, sections and chunks."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from granary.config import OVERLAP_TOKENS, TARGET_TOKENS
from granary.functions.text import count_words, date_of, free_name, guided_period, html_lines, outlook_block, slug

#: Items of interest by form, and the part they must stand in.
SECTIONS = {
    "10-K": {"1": ("Business", None), "1A": ("Risk Factors", None), "7": ("MD&A", None), "8": ("Financial Statements", None)},
    "10-Q": {"1": ("Financial Statements", "I"), "2": ("MD&A", "I"), "1A": ("Risk Factors", "II")},
}
_ITEM = r"(?i)^item\s+(1a|1b|1c|7a|9a|9b|10|11|12|13|14|15|[1-9])\.?(\s|$)"
_WORD = re.compile(r"\S+")
_PART = r"(?i)^part\s+(iv|iii|ii|i)\b"
#: Chunks that a task holds before it hands them on: so many characters of text or rows.
HELD_CHARS, HELD_ROWS = 1 << 20, 1 << 13


def earnings_releases(form: Column, items: Column) -> Column:
    return (form == "8-K") & F.contains(F.coalesce(items, F.lit("")), F.lit("2.02"))


def choose_filings(filings: DataFrame, limits: dict[str, int], by: str = "ticker", form: str = "form", order: tuple = ()) -> DataFrame:
    """The newest `limits[form]` filings of each form, stable by the order columns. Their rank is nth; where there is a
    column of that name, it stays, and the rank has underscores in front."""
    rank = F.row_number().over(Window.partitionBy(by, form).orderBy(*order))
    most = F.coalesce(*(F.when(F.col(form) == f, F.lit(n)) for f, n in limits.items()), F.lit(0))
    nth = free_name("nth", filings.columns)
    return filings.withColumn(nth, rank).where(F.col(nth) <= most)


def exhibit_or_primary(cells: DataFrame, filings: DataFrame) -> DataFrame:
    """(filing, document): the first row of a filing's index with four cells whose Type starts with EX-99.1, else the primary."""
    rows = cells.where(F.size("cells") >= 4).where(F.startswith(F.col("cells")[3], F.lit("EX-99.1")))
    first = rows.groupBy("filing").agg(F.min_by("href", "pos").alias("href"))
    return filings.join(first, "filing", "left").select("filing", F.coalesce(F.element_at(F.split("href", "/"), -1), "primary").alias("document"))


def index_cells(pages: DataFrame, id_col: str = "filing", html_col: str = "html") -> DataFrame:
    """(filing, pos, cells, href) of the rows of a filing index page's first table of class tableFile.

    cells are the texts of the row's td elements, href is the link in the third of them (null without one). Pages that
    are null or have no such table give no rows.
    """
    table = F.regexp_extract(F.coalesce(F.col(html_col), F.lit("")), r"""(?is)<table\b(?:[^>"']|"[^"]*"|'[^']*')*?\bclass\s*=\s*["']?[^"'>]*\btableFile\b[^>]*>(.*?)(?:</table|$)""", 1)
    rows = pages.select(F.col(id_col).alias("filing"), F.posexplode(F.regexp_extract_all(table, F.lit(r"(?is)<tr\b[^>]*>(.*?)(?=<tr\b|</tr|$)"), F.lit(1))).alias("pos", "row"))
    rows = rows.withColumn("cell", F.regexp_extract_all("row", F.lit(r"(?is)<td\b[^>]*>(.*?)(?=<td\b|</td|$)"), F.lit(1)))
    link = F.regexp_extract(F.get("cell", F.lit(2)), r"""(?is)<a\b[^>]*?\bhref\s*=\s*["']([^"']*)""", 1)
    return rows.select("filing", "pos", F.transform("cell", lambda c: F.array_join(html_lines(c), "")).alias("cells"), F.nullif(link, F.lit("")).alias("href"))


def sections(pages: DataFrame, id_col: str = "id", html_col: str = "html", form_col: str = "form") -> DataFrame:
    """(id, n, section, text): the items of interest of each page, from their longest occurrence to the next of them.

    Forms without items, and pages without a heading of interest, are one section 'body'; pages without text have none.
    """
    lines = pages.select(F.col(id_col).alias("id"), F.col(form_col).alias("form"), html_lines(F.col(html_col)).alias("lines")).where(F.size("lines") > 0)
    rows = lines.select("id", "form", F.posexplode("lines").alias("at", "line"))
    page = Window.partitionBy("id").orderBy("at")
    rows = rows.withColumn("part", F.upper(F.nullif(F.regexp_extract("line", _PART, 1), F.lit("")))).withColumn("item", F.upper(F.nullif(F.regexp_extract("line", _ITEM, 1), F.lit(""))))
    rows = rows.withColumn("in_part", F.last("part", ignorenulls=True).over(page)).withColumn("end", F.sum(F.length("line") + 1).over(page)).withColumn("pos", F.col("end") - F.length("line") - 1)
    total = F.max("end").over(Window.partitionBy("id")) - 1
    heads = rows.withColumn("total", total).where("item is not null").withColumn("next", F.lead("pos").over(page)).withColumn("span", F.coalesce("next", "total") - F.col("pos"))
    name = F.lit(None).cast("string")
    for form, items in SECTIONS.items():
        for item, (title, part) in items.items():
            fits = (F.col("form") == form) & (F.col("item") == item)
            name = F.when(fits & (F.lit(True) if part is None else F.coalesce(F.col("in_part") == part, F.lit(False))), F.lit(title)).otherwise(name)
    kept = heads.withColumn("section", name).where("section is not null")
    kept = kept.withColumn("best", F.row_number().over(Window.partitionBy("id", "item").orderBy(F.desc("span"), "pos"))).where("best = 1").select("id", "at", "section")
    started = rows.select("id", "at", "line").join(kept, ["id", "at"], "left").withColumn("n", F.count("section").over(page))
    headed = Window.partitionBy("id")
    started = started.withColumn("found", F.max("n").over(headed)).where("n > 0 or found = 0")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "line"))), lambda x: x["line"]), "\n")
    return started.groupBy("id", "n").agg(F.coalesce(F.max("section"), F.lit("body")).alias("section"), text.alias("text")).select("id", F.greatest("n", F.lit(1)).cast("int").alias("n"), "section", "text")


def pack(units: list[tuple[str, int]], target: int = TARGET_TOKENS, overlap: int = OVERLAP_TOKENS) -> list[list[int]]:
    """Indices of the units of each chunk, at most `target` tokens each; a unit holds `target` tokens at most.

    A chunk takes as many units as fit. The next one begins with a repeat: the shortest end of the chunk, its last unit
    left out, that has `overlap` tokens or else all of it, as far as that is within max(overlap, target // 2) and within
    what the next unit leaves of `target`.
    """
    sizes = np.array([n for _, n in units], dtype=np.int64)
    upto = np.concatenate([[0], np.cumsum(sizes)])
    repeat, at, out = np.zeros(0, dtype=np.int64), 0, []
    while at < len(sizes):
        room = target - int(sizes[repeat].sum())
        end = max(at + 1, int(np.searchsorted(upto, upto[at] + room, "right")) - 1)
        chunk = np.concatenate([repeat, np.arange(at, end)])
        out.append(chunk.tolist())
        if end < len(sizes):
            most = min(max(overlap, target // 2), target - int(sizes[end]))
            ends = np.cumsum(sizes[chunk[:-1]][::-1])  # tokens of the last 1, 2, ... units before the last
            wanted, allowed = int(np.searchsorted(ends, overlap, "left")) + 1, int(np.searchsorted(ends, most, "right"))
            n = min(wanted, allowed) if overlap > 0 else 0
            repeat = chunk[:-1][len(ends) - n :] if n else chunk[:0]
        at = end
    return out


def word_spans(text: str) -> list[tuple[int, int]]:
    """First and last character, plus one, of every word: the default tokens of the chunker."""
    return [m.span() for m in _WORD.finditer(text)]


def units_of(text: str, target: int, spans: Callable[[str], list[tuple[int, int]]] = word_spans) -> list[tuple[str, int]]:
    """Lines with their token counts; a line of more than `target` tokens is cut after every `target` of them.

    What is cut is the line itself, from its first token's first character to its last one's last: nothing is put together
    from tokens. Tokens without a character count for nothing.
    """
    out = []
    for line in filter(None, map(str.strip, (text or "").splitlines())):
        at = [(a, z) for a, z in spans(line) if z > a]
        if len(at) <= target:
            out += [(line, len(at))] * bool(at)
        else:
            cuts = [at[k : k + target] for k in range(0, len(at), target)]
            out += [(line[c[0][0] : c[-1][1]], len(c)) for c in cuts]
    return out


def chunk(texts: DataFrame, target: int = TARGET_TOKENS, overlap: int = OVERLAP_TOKENS, spans: Callable[[str], list[tuple[int, int]]] = word_spans) -> DataFrame:
    """(id, section, text) and, if there, n -> (chunk_id, id, section, chunk_index, n_tokens, text).

    The number in chunk_id counts within a section, chunk_index over all sections of the document in order of n (without
    n: of the section's name). A fold over lines, so it runs in Arrow batches, text by text, and hands chunks
    on in small batches of its own; a text is never split over tasks. Tokens are
    words, or what `spans` gives as places of characters, such as a subword tokenizer's. Every line of a chunk is a line of
    the text or a part of one, as it is written there. Null and blank texts have no chunk; an empty table gives none; other columns are not read.
    """
    def packed(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.string()), strict=True)], names=["id", "n", "section", "k", "n_tokens", "text"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, chars = [], 0
        for b in batches:
            for row in zip(*(b.column(c) for c in ("id", "n", "section", "text")), strict=True):
                key, n, section, text = (x.as_py() for x in row)
                units = units_of(text, target, spans)
                for k, c in enumerate(pack(units, target, overlap)):
                    rows.append((key, n, section, k, sum(units[j][1] for j in c), "\n".join(units[j][0] for j in c)))
                    chars += len(rows[-1][-1])
                    if chars >= HELD_CHARS or len(rows) >= HELD_ROWS:
                        yield packed(rows)
                        rows, chars = [], 0
        if rows:
            yield packed(rows)

    nth = F.col("n").cast("int") if "n" in texts.columns else F.lit(None).cast("int")
    done = texts.select(F.col("id").cast("string").alias("id"), nth.alias("n"), "section", "text").mapInArrow(run, "id string, n int, section string, k int, n_tokens int, text string")
    name = F.coalesce(F.nullif(slug(F.col("section")), F.lit("")), F.lit("body"))
    index = (F.row_number().over(Window.partitionBy("id").orderBy("n", "section", "k")) - 1).cast("int")
    done = done.withColumn("chunk_index", index)
    return done.select(F.concat_ws("::", "id", name, F.format_string("%04d", "k")).alias("chunk_id"), "id", "section", "chunk_index", "n_tokens", "text")


def documents(manifest: DataFrame, tickers: list[str] | None = None) -> DataFrame:
    """The manifest of all companies or of some, oldest filing first, with the filing date as a date."""
    rows = manifest if tickers is None else manifest.where(F.col("ticker").isin(*tickers))
    return rows.withColumn("filing_date", date_of(F.col("filing_date"))).orderBy("filing_date", "doc_id")


def chunk_metadata(chunks: DataFrame, manifest: DataFrame, chunk_ids: DataFrame | None = None, doc_id: str | None = None) -> DataFrame:
    """Chunks with the columns of their documents, in order of document and chunk: all, those of a table of chunk_id,
    or those of one document. chunks: as chunk() gives them; documents without chunks, and the reverse, are left out."""
    rows = chunks.withColumnRenamed("id", "doc_id")
    if chunk_ids is not None:
        rows = rows.join(chunk_ids.select("chunk_id"), "chunk_id", "left_semi")
    elif doc_id is not None:
        rows = rows.where(F.col("doc_id") == doc_id)
    return rows.join(manifest, "doc_id").withColumn("n_words", count_words(F.col("text"))).orderBy("doc_id", "chunk_index")


def section_counts(chunks: DataFrame) -> DataFrame:
    """Chunks by section, for the report of a build."""
    return chunks.groupBy("section").agg(F.count("*").alias("n"))


# --- guidance -----------------------------------------------------------------


def guidance_candidates(chunks: DataFrame, manifest: DataFrame, ticker: str | None = None) -> DataFrame:
    """Chunks of 8-K filings, which may hold an outlook: the newest filing first, chunks in order."""
    rows = chunks.join(manifest.select("doc_id", "ticker", "filing_date", "doc_type").where("doc_type = '8-K'"), "doc_id")
    rows = rows if ticker is None else rows.where(F.col("ticker") == ticker)
    return rows.select("chunk_id", "text", "doc_id", "ticker", date_of(F.col("filing_date")).alias("filing_date"), "chunk_index").orderBy(F.desc("filing_date"), "chunk_index", "chunk_id")


def guidance(candidates: DataFrame) -> DataFrame:
    """(ticker, fiscal_period, given_on, text, source_doc_id): the longest outlook of each filing and guided period.

    Chunks overlap, so an outlook may stand in several; of equally long ones the first chunk's is taken. Chunks without
    an outlook, or whose outlook names no period, give nothing.
    """
    found = candidates.withColumn("block", outlook_block(F.col("text"))).withColumn("fiscal_period", guided_period(F.col("block"))).where("fiscal_period is not null")
    nth = F.row_number().over(Window.partitionBy("doc_id", "fiscal_period").orderBy(F.desc(F.length("block")), "chunk_index", "chunk_id"))
    return found.withColumn("nth", nth).where("nth = 1").select("ticker", "fiscal_period", F.col("filing_date").alias("given_on"), F.col("block").alias("text"), F.col("doc_id").alias("source_doc_id"))


def latest_guidance(rows: DataFrame, limit: int = 3) -> DataFrame:
    """The `limit` most recently given rows of each company, newest first; ties go by period and document."""
    nth = F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc("given_on"), "fiscal_period", "source_doc_id"))
    held = free_name("nth", rows.columns)
    return rows.withColumn(held, nth).where(F.col(held) <= limit).drop(held).orderBy("ticker", F.desc("given_on"), "fiscal_period", "source_doc_id")
