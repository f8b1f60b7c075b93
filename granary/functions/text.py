"""Column functions over text: tokens, topics, names, headlines, html, periods and outlooks."""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Callable
from html.entities import html5

from pyspark.sql import Column, functions as F

from granary.config import COMPANIES, REDIRECT_HOST, STOPWORDS, TOPICS

TOKEN = r"[a-z0-9]+(?:[.\-][a-z0-9]+)*"


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once, also where body uses it in lambdas, which compute anew for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def free_name(name: str, columns: list[str]) -> str:
    """name, with underscores in front until no column is called so (names are equal whatever their case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def tokens(text: Column) -> Column:
    """Lower-case tokens without stop words and single letters; 10-k, 1.5 and u.s stay whole. Null has none."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))
    return F.filter(found, lambda t: (F.length(t) > 1) & ~t.isin(*STOPWORDS))


_TOKEN, _LEFT_OUT = re.compile(TOKEN), [*STOPWORDS, *"abcdefghijklmnopqrstuvwxyz0123456789"]
#: Bytes that can stand in a token, and a space for all others.
_KEPT = bytes(b if chr(b) in "abcdefghijklmnopqrstuvwxyz0123456789.-" else 32 for b in range(256))


def token_counts(low: str) -> dict[str, int]:
    """How often each of tokens() stands in a text that is in lower case already."""
    out = Counter(low.encode().translate(_KEPT).decode("ascii").split())
    for piece in [x for x in out if not x.isalnum()]:
        n = out.pop(piece)
        for t in _TOKEN.findall(piece):
            out[t] = out.get(t, 0) + n
    for t in _LEFT_OUT:
        out.pop(t, None)
    return out


def count_words(text: Column) -> Column:
    """The default token counter of the chunker."""
    return F.size(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\S+"), F.lit(0)))


def topic(headline: Column) -> Column:
    low = F.lower(headline)
    return F.coalesce(*(F.when(F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(low, w)), F.lit(name)) for name, words in TOPICS.items()))


def names_company(headline: Column, ticker: Column) -> Column:
    """Whether a headline holds a name of the ticker's company (unknown tickers: the ticker itself)."""
    low, other = F.lower(headline), F.contains(F.lower(headline), F.lower(ticker))
    out = other
    for company, names in COMPANIES.items():
        out = F.when(ticker == company, F.exists(F.array(*map(F.lit, names)), lambda w: F.contains(low, w))).otherwise(out)
    return out


def date_of(value: Column) -> Column:
    """The day of a date, a timestamp or an ISO text; null where there is none."""
    return F.substring(value.cast("string"), 1, 10).try_cast("date")


def is_redirect(url: Column) -> Column:
    return F.contains(F.coalesce(url, F.lit("")), F.lit(REDIRECT_HOST))


def article_id(url: Column) -> Column:
    return F.sha1(url)


def display_headline(headline: Column) -> Column:
    """Without a trailing publisher."""
    return F.trim(F.regexp_replace(headline, r"\s+-\s+[^-]{2,30}$", ""))


def normal_headline(headline: Column, ticker: str) -> Column:
    """Without what all headlines about one company share: publisher, exchange tag and names. Never empty."""
    out = F.regexp_replace(headline, r"\s+-\s+[^-]{2,30}$", "")
    out = F.regexp_replace(out, r"(?i)\((?:NASDAQ|NYSE)[:\s][^)]*\)", " ")
    for name in [*COMPANIES.get(ticker, [ticker.lower()]), f"${ticker}"]:
        out = F.regexp_replace(out, rf"(?i)\b{re.escape(name)}\b", " ")
    out = F.regexp_replace(F.regexp_replace(out, r"\s+", " "), "^[ :\\-–—]+|[ :\\-–—]+$", "")
    return F.coalesce(F.nullif(out, F.lit("")), headline)


def source_or(source: Column, fallback: Column) -> Column:
    return F.coalesce(F.nullif(source, F.lit("")), fallback)


def slug(section: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(section), r"[^a-z0-9]+", "-"), "^-+|-+$", "")


_ENTITY = "&(#?[A-Za-z0-9]+);"
#: Names of HTML 5 that end in a semicolon, with what they stand for.
ENTITIES = {name[:-1]: shown for name, shown in html5.items() if name.endswith(";")}


def decode_entities(text: Column) -> Column:
    """Named entities of HTML 5 and numeric ones as their characters; unknown ones, and ones without ; stay as they are.

    Each different entity of a text is looked up and replaced once, those of ampersands last, so nothing is decoded twice.
    """
    known = F.from_json(F.lit(json.dumps(ENTITIES)), "map<string,string>")
    number = lambda x: F.when(F.startswith(F.lower(x), F.lit("#x")), F.conv(F.substring(x, 3, 8), 16, 10)).when(F.startswith(x, F.lit("#")), F.substring(x, 2, 8))
    point = lambda x: number(x).try_cast("int")
    valid = lambda x: point(x).between(1, 0xD7FF) | point(x).between(0xE000, 0x10FFFF)
    char = lambda x: F.when(valid(x), F.decode(F.unhex(F.lpad(F.hex(point(x)), 8, "0")), "UTF-32"))
    pair = lambda x: F.struct(F.concat(F.lit("&"), x, F.lit(";")).alias("e"), F.coalesce(F.try_element_at(known, x), char(x)).alias("c"))
    ordered = lambda shown: F.concat(F.filter(shown, lambda x: x["c"] != "&"), F.filter(shown, lambda x: x["c"] == "&"))

    def decoded(t: Column) -> Column:
        names = F.array_distinct(F.regexp_extract_all(t, F.lit(_ENTITY), F.lit(1)))
        shown = F.filter(F.transform(names, pair), lambda x: x["c"].isNotNull())
        return F.aggregate(bound(shown, ordered), t, lambda t, x: F.replace(t, x["e"], x["c"]))

    return bound(text, decoded)


#: A tag: quoted attributes may hold >; where quotes don't pair, it ends at the first >.
TAG = r"""<[/!?A-Za-z][^>"']*+(?:(?:"[^"]*+"|'[^']*+')[^>"']*+)*+>|<[/!?A-Za-z][^>]*+>"""
UNSEEN = r"(?is)<(script|style)\b.*?</(script|style)\s*>|<!--.*?-->"


def html_lines(html: Column) -> Column:
    """Text lines of a page: scripts, styles and comments gone, a break at every tag, blank lines dropped.

    A < that starts no tag stays as it is. Null pages have no lines.
    """
    out = F.regexp_replace(F.coalesce(html, F.lit("")), UNSEEN, "")
    out = decode_entities(F.regexp_replace(out, TAG, "\n"))
    lines = F.transform(F.split(out, "\n"), lambda x: F.regexp_replace(x, "^[\\s\u00a0]+|[\\s\u00a0]+$", ""))
    return F.filter(lines, lambda x: x != "")


def html_to_text(html: Column) -> Column:
    return F.array_join(html_lines(html), "\n")


ORDINALS = ["first", "second", "third", "fourth"]
_PERIOD = r"(?i)(?:(first|second|third|fourth)\s+quarter|Q([1-4]))\s+of\s+(?:fiscal\s+(?:year\s+)?)?(\d{4})"
_YEAR = r"(?i)(?:full[\s-]?year|fiscal\s+year)\s+(?:fiscal\s+)?(\d{4})"


def guided_period(text: Column) -> Column:
    """FY2027Q3 of 'third quarter of fiscal 2027', FY2027 of 'fiscal year 2027'; null where neither stands."""
    word, digit, year = (F.regexp_extract(text, _PERIOD, k) for k in (1, 2, 3))
    quarter = F.coalesce(*(F.when(F.lower(word) == w, F.lit(str(k))) for k, w in enumerate(ORDINALS, 1)), digit)
    full = F.regexp_extract(text, _YEAR, 1)
    return F.when(year != "", F.concat(F.lit("FY"), year, F.lit("Q"), quarter)).when(full != "", F.concat(F.lit("FY"), full))


def outlook_block(text: Column, width: int = 2000) -> Column:
    """The outlook of a release: from a header at the start of a line, `width` characters; null without one."""
    at = F.regexp_instr(text, F.lit(r"(?im)^\s*(outlook|financial outlook|business outlook|guidance)\b"))
    return F.when(at > 0, F.regexp_replace(F.substring(text, at, F.lit(width)), r"^\s+|\s+$", ""))
