"""URL filter with a weighted vocabulary.

An Aho-Corasick automaton finds all strict and soft terms of a URL in one pass. A term counts only where it stands
between boundaries: the ends of the URL or characters other than ASCII letters and digits. A URL is rejected for one
strict term, or for as many distinct soft terms as the limit says. The plan is one scan of the URL column without a
shuffle; the automaton is built in each worker from a vocabulary of fixed size.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import through_arrow

STRICT = ("casino", "porn", "xxx", "viagra", "cialis", "pills", "sportsbook", "escort", "malware", "warez", "jackpot")
SOFT = ("bets", "betting", "win", "free", "cheap", "adult", "ads", "track", "spam", "farm", "poker", "sex", "dating", "lottery", "loan", "crack", "torrent", "discount", "click", "popup")
#: Distinct soft terms at which a URL is rejected.
SOFT_LIMIT = 2
_PLAIN = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")
#: Percent codes of ASCII letters and digits in lower-cased URLs, in the order in which they are replaced.
CODES = tuple((f"%{ord(c):02x}", c.lower()) for c in "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")


@lru_cache(maxsize=4)
def automaton(strict: tuple[str, ...], soft: tuple[str, ...]) -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for term in soft:
        a.add_word(term.lower(), (False, term.lower()))
    for term in strict:  # a term in both lists is strict
        a.add_word(term.lower(), (True, term.lower()))
    a.make_automaton()
    return a


def decoded(url: str) -> str:
    """A lower-cased URL without the percent codes of letters and digits, which may hide a term."""
    if "%" in url:
        for code, c in CODES:
            url = url.replace(code, c)
    return url


def find_terms(url: str, a: ahocorasick.Automaton) -> tuple[set[str], set[str]]:
    """(strict, soft) terms that stand between boundaries in a lower-cased URL."""
    strict, soft = set(), set()
    last = len(url) - 1
    for end, (hard, term) in a.iter(url):
        start = end - len(term)
        if (end == last or url[end + 1] not in _PLAIN) and (start < 0 or url[start] not in _PLAIN):
            (strict if hard else soft).add(term)
    return strict, soft


def _filter(strict: tuple[str, ...], soft: tuple[str, ...], limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = automaton(strict, soft) if strict or soft else None
        for batch in batches:
            found = [find_terms(decoded(u), a) if u and a else (set(), set()) for u in pc.ascii_lower(batch.column(0)).to_pylist()]
            ns, nw = [len(x) for x, _ in found], [len(y) for _, y in found]
            new = [
                pa.array(ns, pa.int32()),
                pa.array(nw, pa.int32()),
                pa.array([",".join(sorted(x | y)) for x, y in found], pa.string()),
                pa.array([x > 0 or y >= limit for x, y in zip(ns, nw)], pa.bool_()),
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *new], names=[*batch.schema.names[1:], "n_strict", "n_soft", "terms", "rejected"])

    return run


def filter_urls(pages: DataFrame, url_col: str = "url", strict=STRICT, soft=SOFT, soft_limit: int = SOFT_LIMIT, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of pages (all if None) with ``n_strict``, ``n_soft``, ``terms`` and ``rejected``.

    The counts are of distinct terms; ``terms`` lists them in order, joined by commas. Case is ignored for ASCII, and
    letters and digits written as percent codes are read as such.
    A null or empty URL has no term and isn't rejected; URLs of any length are read whole. Columns of pages with one of
    the four names are replaced; the others stay, as do repeated rows. An empty table stays empty. Empty terms and a
    limit below 1 are errors.
    """
    if soft_limit < 1 or not all([*strict, *soft]):
        raise ValueError("terms must not be empty and the limit must be at least 1")
    return through_arrow(pages, url_col, keep, _filter(tuple(strict), tuple(soft), soft_limit), "n_strict int, n_soft int, terms string, rejected boolean")


def oracle(strict=STRICT, soft=SOFT, soft_limit: int = SOFT_LIMIT) -> str:
    """The same over the table pages, in SQL: one regular expression for each term."""
    url = "lower(p.url)"
    for code, c in CODES:
        url = f"replace({url}, '{code}', '{c}')"
    rows = ", ".join(f"('{t}', {str(t in strict).lower()})" for t in dict.fromkeys([*strict, *soft]))
    return f"""
WITH term(term, hard) AS (VALUES {rows}),
hit AS (SELECT p.page_id, p.url, t.term, t.hard FROM pages p LEFT JOIN term t
        ON regexp_matches({url}, '(^|[^a-z0-9])' || t.term || '($|[^a-z0-9])'))
SELECT page_id, CAST(count(DISTINCT term) FILTER (hard) AS INT) AS n_strict, CAST(count(DISTINCT term) FILTER (NOT hard) AS INT) AS n_soft,
       coalesce(string_agg(DISTINCT term, ',' ORDER BY term), '') AS terms,
       count(DISTINCT term) FILTER (hard) > 0 OR count(DISTINCT term) FILTER (NOT hard) >= {soft_limit} AS rejected
FROM hit GROUP BY page_id, url
"""
