"""Text as Column expressions: normalising, HTML, hashing, markup."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .names import squeeze


@F.pandas_udf(StringType())
def unescape(texts: pd.Series) -> pd.Series:
    """All named and numeric entities as the characters they stand for."""
    return texts.map(html.unescape, na_action="ignore")


def normalize_text(c: Column) -> Column:
    """Lower case; entities and all signs but $ as one blank."""
    s = F.regexp_replace(F.lower(c), "&[a-z0-9#]+;", " ")
    return squeeze(F.regexp_replace(s, "[^a-z0-9$ ]+", " "))


def html_to_text(c: Column) -> Column:
    """Scripts and styles out, ends of blocks and table cells as line ends, tags off, entities decoded, blanks squeezed."""
    s = F.regexp_replace(c, r"(?is)<(script|style)\b.*?</\1\s*>", " ")
    s = F.regexp_replace(s, r"(?i)<br\s*/?>|</(p|div|td|th|tr|li|h[1-6]|table|article|section|header|footer|nav|title)\s*>", "\n")
    s = F.regexp_replace(s, r"(?s)<[^>]*>", " ")
    s = unescape(s)
    s = F.regexp_replace(s, r"[ \t\r\f\x{00A0}\x{2000}-\x{200A}\x{3000}]+", " ")
    return F.trim(F.regexp_replace(s, r" *\n[ \n]*", "\n"), F.lit(" \n"))


def anchor_window(text: Column, anchors: dict[str, int], window: int, within: int = 120_000) -> Column:
    """A stretch of the text around its strongest anchor, a pattern in any case; the earliest of equals; null without any."""
    head = F.substring(text, 1, within)
    at = [(F.regexp_instr(head, F.lit(f"(?i){a}")), w) for a, w in anchors.items()]
    found = [F.when(p > 0, F.struct(F.lit(w).alias("w"), (-p).alias("p"))) for p, w in at]
    best = F.array_max(F.filter(F.array(*found), lambda x: x.isNotNull()))
    return F.when(best.isNotNull(), F.substring(text, F.greatest(F.lit(1), -best["p"] - window // 4), F.lit(window)))


def author_hash(handle: Column, salt: str) -> Column:
    """HMAC-SHA256 of the trimmed lower-case handle; null for null or empty. SQL functions only."""
    key = salt.encode()
    if len(key) > 64:
        import hashlib

        key = hashlib.sha256(key).digest()
    key = key.ljust(64, b"\0")
    inner, outer = (F.unhex(F.lit(bytes(b ^ x for b in key).hex())) for x in (0x36, 0x5C))
    message = F.lower(F.trim(handle))
    digest = F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, F.encode(message, "UTF-8")), 256))), 256)
    return F.when(F.length(message) > 0, digest)


def markup_words(c: Column, depth: int = 4) -> Column:
    """Words of a wiki page's body: templates, tables, references, files and categories don't count."""
    s = F.regexp_replace(c, r"(?s)<ref[^>]*/>|<ref.*?</ref>|<!--.*?-->", " ")
    for _ in range(depth):
        s = F.regexp_replace(s, r"(?s)\{\{[^{}]*\}\}", " ")
    s = F.regexp_replace(s, r"(?s)\{\|.*?\|\}", " ")
    s = F.regexp_replace(s, r"(?i)\[\[(?:file|image|category):[^\]]*\]\]", " ")
    s = F.regexp_replace(s, r"\[\[(?:[^\]|]*\|)?([^\]]*)\]\]", "$1")
    s = F.regexp_replace(s, r"(?m)^=+.*=+\s*$|https?://\S+|<[^>]*>", " ")
    return F.size(F.regexp_extract_all(s, F.lit(r"[A-Za-z][A-Za-z'-]*"), F.lit(0)))


def is_redirect(c: Column) -> Column:
    return F.ltrim(F.lower(c)).startswith("#redirect")


def stem_alignment(a: Column, b: Column, stop: tuple[str, ...] = ("with", "from", "that", "this", "services", "company")) -> Column:
    """Share of a's stems (six characters of words of four letters and more) that occur in b; null without stems."""
    words = F.filter(F.split(F.regexp_replace(F.lower(a), "[^a-z]+", " "), " "), lambda x: (F.length(x) >= 4) & ~x.isin(*stop))
    stems = F.array_distinct(F.transform(words, lambda x: F.substring(x, 1, 6)))
    blob = F.lower(b)
    return F.try_divide(F.size(F.filter(stems, lambda s: F.contains(blob, s))).cast("double"), F.size(stems))


def defunct_before(c: Column, year: Column) -> Column:
    """Says that the company ended, with a year more than one before the given."""
    years = F.transform(F.regexp_extract_all(c, F.lit(r"\b((?:19|20)\d{2})\b"), F.lit(1)), lambda y: y.cast("int"))
    return F.coalesce(c.rlike(r"(?i)\b(defunct|dissolved|liquidated|ceased operations|was acquired|bankrupt)\b") & F.exists(years, lambda y: y < year - 1), F.lit(False))
