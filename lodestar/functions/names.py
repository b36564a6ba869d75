"""Company names, titles and banks as normalised keys: Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Legal suffixes that end a company's name.
SUFFIXES = ("inc", "incorporated", "corp", "corporation", "co", "company", "ltd", "limited", "llc", "lp", "llp", "plc", "sa", "nv", "bv", "ag", "gmbh", "ab", "oyj", "oy", "as", "pte", "pty", "holdings", "holding", "group")
_TAIL = "|".join(SUFFIXES)


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, " +", " "))


def company_key(name: Column) -> Column:
    """Lower case, & as and, other signs as blanks, legal suffixes off the end but for the first word."""
    s = squeeze(F.regexp_replace(F.regexp_replace(F.lower(name), "&", " and "), "[^a-z0-9]+", " "))
    return F.regexp_replace(s, f"^(.+?)(?: (?:{_TAIL}))+$", "$1")


def slug(name: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), F.lit("-"))


def _bound(c: Column, use) -> Column:
    """use(c) with c computed once a row, however often it is used."""
    return F.get(F.transform(F.array(c), use), 0)


def title_key(name: Column, rounds: int = 4) -> Column:
    """Case kept, parentheses and .,# dropped; a suffix goes while 3 characters and a third of them stay."""

    def cut_off(first: Column) -> Column:
        s, least = first, F.length(first) * 0.34
        for _ in range(rounds):
            # Written out, the rounds would repeat each other fourfold.
            s = _bound(s, lambda x: _bound(F.regexp_replace(x, f"(?i) (?:{_TAIL})$", ""), lambda cut: F.when((F.length(cut) >= 3) & (F.length(cut) >= least), cut).otherwise(x)))
        return s

    return _bound(squeeze(F.regexp_replace(F.regexp_replace(name, r"\([^)]*\)", " "), "[.,#]", " ")), cut_off)


def tokens(c: Column, least: int = 3) -> Column:
    """Distinct tokens of at least so many letters or digits, lower case."""
    return F.array_distinct(F.filter(F.split(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "), " "), lambda x: F.length(x) >= least))


def token_overlap(a: Column, b: Column) -> Column:
    """Shared tokens over the larger set; 0 if either is empty."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.greatest(F.size(a), F.size(b))), F.lit(0.0))


def candidate_titles(name: Column) -> Column:
    """Names to look up, most specific first, without repeats."""

    def titles(cut: Column) -> Column:
        shouted = F.when((F.upper(cut) == cut) & (F.length(cut) > 4), F.initcap(cut))
        first = F.when(F.size(F.split(cut, " ")) > 1, F.substring_index(cut, " ", 1))
        return F.array_distinct(F.filter(F.array(squeeze(name), cut, shouted, F.concat(cut, F.lit(" (company)")), first), lambda x: x.isNotNull()))

    return _bound(title_key(name), titles)


def bank_key(name: Column) -> Column:
    """A bank's name in lower case without signs and without its legal or trade suffix."""
    s = squeeze(F.regexp_replace(F.lower(name), "[^a-z0-9]+", " "))
    return F.regexp_replace(s, "^(.+?)(?: (?:llc|inc|co|corp|ltd|lp|plc|securities|capital markets|and co))+$", "$1")


def filing_path(cik: Column, accession: Column, document: Column) -> Column:
    """edgar/data/<id without zeros>/<accession without dashes>/<document>; null if the id isn't a number."""
    return F.concat(F.lit("edgar/data/"), cik.try_cast("bigint").cast("string"), F.lit("/"), F.regexp_replace(accession, "-", ""), F.lit("/"), document)
