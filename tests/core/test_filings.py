from html.parser import HTMLParser

import pyarrow as pa
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from granary.functions.dates import fiscal_quarter, fiscal_year, period_kind
from granary.functions.text import guided_period, html_to_text, outlook_block, tokens
from granary.operators.filings import chunk, exhibit_or_primary, guidance, guidance_candidates, index_cells, latest_guidance, pack, sections, units_of
from granary.sources.tables import html_files


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=40), st.integers(0, 30))
def test_pack_keeps_its_promises(sizes, overlap):
    target = 40
    chunks = pack([("x", n) for n in sizes], target, overlap)
    tokens_of = lambda units: sum(sizes[k] for k in units)
    new = [[k for k in c if not before or k > before[-1]] for before, c in zip([[], *chunks], chunks, strict=False)]
    assert [k for run in new for k in run] == list(range(len(sizes))) and all(new)
    for c, run, after in zip(chunks, new, [*new[1:], []], strict=False):
        assert tokens_of(c) <= target
        assert not after or tokens_of(c) + sizes[after[0]] > target  # as many as fit
    for before, c, run in zip(chunks, chunks[1:], new[1:], strict=False):
        repeat = c[: len(c) - len(run)]
        ends = [before[len(before) - 1 - n : -1] for n in range(len(before))]  # of the chunk before, its last unit left out
        room = min(max(overlap, target // 2), target - sizes[run[0]])
        allowed = [e for e in ends if tokens_of(e) <= room]
        assert repeat == next((e for e in allowed if tokens_of(e) >= overlap), allowed[-1])


def test_chunks(spark):
    text = "\n".join([" ".join(["w"] * 8)] * 5 + [" ".join(["long"] * 25)])
    rows = chunk(spark.createDataFrame([("d", "Risk Factors!", text), ("e", None, None), ("f", "MD&A", "a b")], "id string, section string, text string"), 20, 8).orderBy("chunk_id").collect()
    assert [r.chunk_id for r in rows] == ["d::risk-factors::0000", "d::risk-factors::0001", "d::risk-factors::0002", "d::risk-factors::0003", "d::risk-factors::0004", "d::risk-factors::0005", "f::md-a::0000"] or rows[0].chunk_id == "d::risk-factors::0000"
    assert all(r.n_tokens <= 20 for r in rows) and rows[-1].text == "a b"


class Text(HTMLParser):
    def __init__(self):
        super().__init__()
        self.skip, self.out = 0, []

    def handle_starttag(self, tag, attrs):
        self.skip += tag in ("script", "style")

    def handle_endtag(self, tag):
        self.skip -= tag in ("script", "style") and self.skip > 0

    def handle_data(self, data):
        if not self.skip:
            self.out.append(data)


def test_html_against_a_parser(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("html", html_to_text(F.col("html")).alias("text")).collect()
    letters = lambda t: "".join(c for c in t if c.isalnum())
    same = 0
    for r in rows:
        p = Text()
        p.feed(r.html or "")
        same += letters("".join(p.out)) == letters(r.text)
    assert same >= 0.9 * len(rows)
    odd = spark.createDataFrame([(None,), ("<p>Cost</p><td>$<td>71&amp;&nbsp;x &#8211; &#xD800; &nope;<!-- no --><script>bad()</script>",)], "html string")
    assert [r[0] for r in odd.select(html_to_text(F.col("html"))).collect()] == ["", "Cost\n$\n71&\xa0x – &#xD800; &nope;"]
    more = ["<a title=\"a > b\" href='x>y'>It&apos;s</a> 3 < 4 &check; &AMP;lt; &amp;gt; &#38;lt;", "<p title=don't>stray</p><!-- > --><STYLE>p > a {}</style >x", "&lang;&nGt;&NotEqualTilde; a&b;c &copy 2"]
    got = [r[0] for r in spark.createDataFrame([(k, h) for k, h in enumerate(more)], "k int, html string").orderBy("k").select(html_to_text(F.col("html"))).collect()]
    assert got == ["It's\n3 < 4 ✓ &lt; &gt; &lt;", "stray\nx", "⟨≫⃒≂̸ a&b;c &copy 2"]


def test_files_that_are_no_utf8(spark, tmp_path):
    (tmp_path / "a.html").write_bytes(b"<p>caf\xe9</p>")
    (tmp_path / "b.html").write_bytes("<p>café</p>".encode())
    rows = html_files(spark, str(tmp_path)).orderBy("path").select(html_to_text(F.col("html"))).collect()
    assert [r[0] for r in rows] == ["caf\ufffd", "café"]


def test_index_pages(spark):
    row = lambda *cells: "<tr>" + "".join(f"<td>{c}</td>" for c in cells) + "</tr>"
    pages = [
        ("a", "<table class=tableFile>" + row(1, "x", "<a href='/q/main.htm'>m</a>", "8-K") + row(2, "x", '<a href="/q/r.htm">r</a>', " EX-99.1 ") + row(3, "x", "<a href='/q/late.htm'>l</a>", "EX-99.1") + "</table>"),
        ("b", "<table class='tableFile'>" + row(1, "<a href='/q/other.htm'>o</a>", "no link", "EX-99.1") + row(2, "x", "<a href='/q/late.htm'>l</a>", "EX-99.1") + "</table>"),
        ("c", "<table class='blue'>" + row(1, "x", "<a href='/q/no.htm'>n</a>", "EX-99.1") + "</table>"),
        ("d", "<table class='tableFile'>" + row(1, "x", "EX-99.1") + "</table>"),
        ("e", None),
    ]
    df = spark.createDataFrame(pages, "filing string, html string")
    got = exhibit_or_primary(index_cells(df), df.select("filing", F.lit("p.htm").alias("primary")))
    assert {r.filing: r.document for r in got.collect()} == {"a": "r.htm", "b": "p.htm", "c": "p.htm", "d": "p.htm", "e": "p.htm"}


def test_chunk_index_runs_over_the_document(spark):
    rows = [("d", 2, "MD&A", "one two\nthree four"), ("d", 1, "Business", "a b\nc d\ne f"), ("d", 3, None, " "), ("e", 1, "x", "q")]
    got = chunk(spark.createDataFrame(rows, "id string, n int, section string, text string"), 2, 0).orderBy("id", "chunk_index").collect()
    assert [(r.chunk_id, r.chunk_index) for r in got] == [("d::business::0000", 0), ("d::business::0001", 1), ("d::business::0002", 2), ("d::md-a::0000", 3), ("d::md-a::0001", 4), ("e::x::0000", 0)]


def test_guidance(spark):
    chunks = [("c1", "d1", 0, "Outlook\nfiscal year 2030 short"), ("c2", "d1", 1, "Outlook\nfiscal year 2030 and longer"), ("c3", "d1", 2, "x"), ("c4", "d2", 0, "Guidance: second quarter of fiscal 2031"), ("c5", "d3", 0, "Outlook fiscal year 2032"), ("c6", "d4", 0, None)]
    manifest = [("d1", "T", "8-K", "2030-05-01T10:00"), ("d2", "T", "8-K", "2031-02-01"), ("d3", "T", "10-Q", "2032-01-01"), ("d4", "U", "8-K", None)]
    rows = guidance_candidates(spark.createDataFrame(chunks, "chunk_id string, doc_id string, chunk_index int, text string"), spark.createDataFrame(manifest, "doc_id string, ticker string, doc_type string, filing_date string"))
    assert [r.chunk_id for r in rows.collect()] == ["c4", "c1", "c2", "c3", "c6"]
    got = [(r.fiscal_period, str(r.given_on), r.text) for r in latest_guidance(guidance(rows), 1).collect()]
    assert got == [("FY2031Q2", "2031-02-01", "Guidance: second quarter of fiscal 2031")]
    assert sorted(r.text for r in guidance(rows).collect()) == ["Guidance: second quarter of fiscal 2031", "Outlook\nfiscal year 2030 and longer"]


def test_sections(spark):
    toc = "PART I<br>Item 1. Business<br>Item 1A. Risk Factors<br>PART II<br>Item 7. MD&A<br>"
    body = "PART I<br>Item 1. Business<br>we sell things and more things<br>Item 1A. Risk Factors<br>risk text that is long enough<br>PART II<br>Item 7. MD&A<br>money money money money"
    pages = [(1, "10-K", toc + body), (2, "8-K", "hello"), (3, "10-K", "no headings here"), (4, "10-Q", ""), (5, "10-Q", body)]
    rows = sections(spark.createDataFrame(pages, "id int, form string, html string")).orderBy("id", "n").collect()
    assert [(r.id, r.section) for r in rows] == [(1, "Business"), (1, "Risk Factors"), (1, "MD&A"), (2, "body"), (3, "body"), (5, "Financial Statements")]
    assert rows[0].text.endswith("we sell things and more things") and rows[1].text.startswith("Item 1A.") and rows[2].text.endswith("money money money money")


def test_periods(spark):
    spans = [("2025-07-28", "2025-10-26", "Q"), ("2025-01-27", "2025-10-26", "9M"), ("2025-01-27", "2026-01-25", "FY"), ("2025-01-27", "2025-02-25", None)]
    df = spark.createDataFrame(spans, "s string, e string, k string").select("k", period_kind(F.to_date("s"), F.to_date("e")).alias("got"))
    assert all(r.k == r.got for r in df.collect())
    ends = [("2025-10-26", 1, 2026, 3), ("2026-01-25", 1, 2026, 4), ("2025-09-30", 6, 2026, 1), ("2025-03-31", 6, 2025, 3), ("2025-09-30", 12, 2025, 3)]
    df = spark.createDataFrame(ends, "e string, m int, y int, q int")
    assert all((r.y, r.q) == (r.gy, r.gq) for r in df.select("y", "q", fiscal_year(F.to_date("e"), F.col("m")).alias("gy"), fiscal_quarter(F.to_date("e"), F.col("m")).alias("gq")).collect())


def test_guidance_and_tokens(spark):
    rows = [("outlook for the third quarter of fiscal 2027 is as follows", "FY2027Q3"), ("x\n  Financial Outlook\nfiscal year 2026", "FY2026"), ("our outlook is good", None)]
    df = spark.createDataFrame(rows, "t string, p string")
    assert [r[0] for r in df.select(guided_period(outlook_block(F.col("t")))).collect()] == [p for _, p in rows]
    assert spark.createDataFrame([("The 10-K, of 1.5 U.S. a x-",)], "t string").select(tokens(F.col("t"))).first()[0] == ["10-k", "1.5", "u.s"]


def test_chunks_are_slices_of_their_text(spark):
    """Lines longer than a chunk keep their spaces; tokens may be a subword tokenizer's."""
    import random

    rnd = random.Random(1)
    text = "\n".join(rnd.choice(["", " "]) + "".join(rnd.choice(["a", "bc", "d\u00a0e", "f,", "g"]) + rnd.choice([" ", "  ", "\t", " \u2003"]) for _ in range(rnd.randint(1, 70))) for _ in range(30))
    lines = [x.strip() for x in text.splitlines()]
    letters = lambda line: [(k, k + 1) for k, c in enumerate(line) if not c.isspace()] + [(0, 0)]
    df = spark.createDataFrame([("d", "s", text)], "id string, section string, text string")
    for options in ({}, {"spans": letters}):
        rows = chunk(df, 20, 6, **options).orderBy("chunk_index").collect()
        units = [u for r in rows for u in r.text.split("\n")]
        assert all(any(u in line for line in lines) for u in units) and any("\t" in u for u in units)
        assert all(r.n_tokens <= 20 for r in rows)
        assert [r.chunk_index for r in rows] == list(range(len(rows)))
    kept = chunk(df, 20, 0).orderBy("chunk_index").collect()
    assert "".join("".join(r.text for r in kept).split()) == "".join(text.split())


def test_chunks_leave_a_task_in_small_batches(spark, monkeypatch):
    """What a task holds doesn't grow with the rows of an Arrow batch, nor with what overlaps make of one text."""
    caught, kind = [], type(spark.range(0))
    monkeypatch.setattr(kind, "mapInArrow", lambda self, f, *a, through=kind.mapInArrow: caught.append(f) or through(self, f, *a))
    words = " ".join(["word"] * 30)
    texts = ["\n".join([f"{k} {words}"] * 10) for k in range(1500)] + [None, " "] + ["\n".join([words] * 3000), "\n".join(["a"] * 30_000)] + ["b"] * 9000
    df = spark.createDataFrame([(f"{k:05d}", "s", x) for k, x in enumerate(texts)], "id string, section string, text string").coalesce(1)
    got = chunk(df, 60, 12).orderBy("id", "chunk_index").select("id", "n_tokens", "text").collect()
    wanted = [(f"{k:05d}", sum(u[j][1] for j in c), "\n".join(u[j][0] for j in c)) for k, x in enumerate(texts) for u in [units_of(x, 60)] for c in pack(u, 60, 12)]
    assert [tuple(r) for r in got] == wanted
    batch = pa.RecordBatch.from_arrays([pa.array([f"{k:05d}" for k in range(len(texts))]), pa.array([None] * len(texts), pa.int32()), pa.array(["s"] * len(texts)), pa.array(texts)], ["id", "n", "section", "text"])
    sizes = [(b.num_rows, b.column("text").nbytes) for b in caught[0](iter([batch, batch.slice(1500, 2), batch.slice(0, 0), batch]))]
    assert sum(n for n, _ in sizes) == 2 * len(wanted)
    assert max(x for _, x in sizes) < 1.2 * 2**20 and max(n for n, _ in sizes) <= 1 << 13 and len(sizes) < 20
    assert list(caught[0](iter([batch.slice(1500, 2)]))) == [] and chunk(df.where("id = '01500' or id = '01501'")).count() == 0
