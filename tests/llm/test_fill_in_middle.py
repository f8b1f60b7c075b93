import hashlib
import random
import re

import pytest

from granary.llm.fill_in_middle import fill_in_middle, restored
from granary.llm.queries_fim import op11_fill_in_middle

UNIT = re.compile("[ \t-\r]*[^ \t-\r]+|[ \t-\r]+")


def naive(doc_id, text):
    """The contract told with lists: n, form, prefix_chars, middle_chars, output."""
    text = text or ""
    units, digest = UNIT.findall(text), hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(units)
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = ("".join(x) for x in (units[:low], units[low:high], units[high:]))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return n, "plain", None, None, text
    if h4 % 100 < 80:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def texts():
    rnd = random.Random(7)
    letters = list("ab<PS>\t\n\r\x0b\x0c\x00   é\U0001f600 ") + ["<P>"]
    out = [None, "", " ", " \n\t ", "one", " one", "one ", "<P>", "a<S", "\U0001f600 \U0001f600", "x " * 50_000, " " * 50_000, "a" * 200_000]
    return out + ["".join(rnd.choices(letters, weights=[9] * (len(letters) - 1) + [1], k=rnd.randint(0, 40))) for _ in range(400)]


def test_equals_the_naive_form_and_restores_every_text(spark):
    rows = [(None, "null id here and there"), *[(i, t) for i, t in enumerate(texts())], (3, "same id"), (3, "same id")]
    df = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], "doc_id long, text string, output string, n int")
    made = fill_in_middle(df)
    got = sorted(map(repr, (tuple(r) for r in made.collect())))
    assert got == sorted(repr((i, *naive(i, t))) for i, t in rows)
    forms = {r["form"] for r in made.collect()}
    assert forms == {"plain", "spm", "psm"}
    back = made.select("doc_id", restored(made["output"], made["form"])).collect()
    assert sorted(map(repr, map(tuple, back))) == sorted(repr((i, t or "")) for i, t in rows)


def test_other_sentinels_rates_and_names(spark):
    df = spark.createDataFrame([(i, f"a[{i}]. (b) *c* <P> {i}") for i in range(50)], "n2 int, body string")
    made = fill_in_middle(df, "n2", "body", rate=100, spm_rate=0, sentinels=("(((", "[*]", ".|."))
    assert {r["form"] for r in made.collect()} == {"psm"}
    assert {tuple(r) for r in made.select("n2", restored(made["output"], made["form"], ("(((", "[*]", ".|."))).collect()} == {tuple(r) for r in df.collect()}
    for bad in (dict(id_col="n"), dict(sentinels=("a", "a", "b")), dict(sentinels=("", "a", "b"))):
        with pytest.raises(ValueError):
            fill_in_middle(df.withColumnRenamed("n2", "n") if "id_col" in bad else df, **({"id_col": "n2", "text_col": "body"} | bad))


def test_empty_table_and_plan(spark):
    assert fill_in_middle(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    plan = op11_fill_in_middle(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan
    assert plan.count("regexp_extract_all") == 1  # units are made once
