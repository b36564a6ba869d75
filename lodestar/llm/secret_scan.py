"""Secret scans with a trigram inverted index.

From each rule's pattern a Boolean query over trigrams is derived: what every match must contain. The
texts of a batch form a segment of the index: one pass over their bytes looks each trigram up and makes
postings from those that some query names to the segment's rows. A rule's query is evaluated by
intersecting and uniting postings, and only the rows left are matched. Rules whose patterns have no
mandatory trigram are matched against every row; of the rules here that is ``hex``.
"""

from __future__ import annotations

import functools
import hashlib
import re
import re._constants as C
import re._parser as P
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import unused


@dataclass(frozen=True)
class Rule:
    """``group`` of a match must have ``least`` characters or more; the span is the whole match."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    any_case: bool = False


# The base rules, in the order in which kinds are listed.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 24),
)
# Further rules, for well-known key formats.
EXTRA = (
    Rule("pem", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("bearer", r"authorization:\x20*bearer\x20+[a-z0-9._~+/-]{16,}=*", any_case=True),
    Rule("urlauth", r"[a-z][a-z0-9+.-]{1,15}://[^\s/:@]{1,64}:[^\s/:@]{3,64}@[A-Za-z0-9.-]+"),
)

#: Texts of a segment, and bytes that are looked up at once.
SEGMENT, PIECE = 1024, 1 << 20

#: A query is True (no mandatory trigram), a trigram, or ("and" | "or", parts).
EVERY = True


def _and(parts):
    parts = list(dict.fromkeys(p for p in parts if p is not EVERY))
    return EVERY if not parts else parts[0] if len(parts) == 1 else ("and", tuple(parts))


def _or(parts):
    parts = list(dict.fromkeys(parts))
    return EVERY if any(p is EVERY for p in parts) else parts[0] if len(parts) == 1 else ("or", tuple(parts))


def trigram_query(pattern: str):
    """What lower-cased trigrams every match of the pattern contains, as a Boolean query.

    Literal runs give their trigrams, alternatives and small classes are united, repetitions of at least
    one count once, and anything else (other classes, optional parts) only ends a run.
    """

    def members(arg):
        """The characters of a small class, lower-cased; None of others."""
        if all(op is C.LITERAL and v < 128 for op, v in arg) and len(arg) <= 8:
            return sorted({chr(v).lower() for _, v in arg})
        return None

    def walk(items):
        # Runs of literals, as alternatives: a branch of pure literals multiplies them out.
        queries, runs = [], [""]

        def close():
            nonlocal runs
            queries.append(_or(_and(r[i : i + 3] for i in range(len(r) - 2)) for r in runs))
            runs = [""]

        for op, arg in items:
            if op is C.LITERAL and arg < 128:
                runs = [r + chr(arg).lower() for r in runs]
            elif op is C.IN and members(arg) and len(runs) * len(members(arg)) <= 64:
                runs = [r + c for r in runs for c in members(arg)]
            elif op is C.SUBPATTERN:
                texts = pure(arg[3])
                if texts is not None and len(runs) * len(texts) <= 64:
                    runs = [r + t for r in runs for t in texts]
                else:
                    close()
                    queries.append(walk(arg[3]))
            elif op is C.BRANCH:
                texts = pure([(op, arg)])
                if texts is not None and len(runs) * len(texts) <= 64:
                    runs = [r + t for r in runs for t in texts]
                else:
                    close()
                    queries.append(_or(walk(x) for x in arg[1]))
            elif op is C.MAX_REPEAT and arg[0] >= 1:
                close()
                queries.append(walk(arg[2]))
            elif op is C.MAX_REPEAT and arg[1] == 1 and pure(arg[2]) is not None and len(runs) * 2 <= 64:
                runs = [r + t for r in runs for t in ["", *pure(arg[2])]]
            else:
                close()
        close()
        return _and(queries)

    def pure(items):
        """All texts that the items match, lower-cased, if they are few and plain; else None."""
        texts = [""]
        for op, arg in items:
            if op is C.LITERAL and arg < 128:
                more = [chr(arg).lower()]
            elif op is C.IN:
                more = members(arg)
            elif op is C.SUBPATTERN:
                more = pure(arg[3])
            elif op is C.BRANCH:
                each = [pure(x) for x in arg[1]]
                more = None if None in each else [t for e in each for t in e]
            elif op is C.MAX_REPEAT and arg[:2] == (0, 1):
                more = pure(arg[2])
                more = None if more is None else ["", *more]
            else:
                return None
            if more is None or len(texts) * len(more) > 64:
                return None
            texts = [t + m for t in texts for m in more]
        return texts

    return walk(P.parse(pattern))


def _trigrams(query) -> set[str]:
    return set() if query is EVERY else {query} if isinstance(query, str) else set().union(*map(_trigrams, query[1]))


def _rows(query, postings: dict[str, set[int]], everything: set[int]) -> set[int]:
    if query is EVERY:
        return everything
    if isinstance(query, str):
        return postings[query]
    parts = [_rows(q, postings, everything) for q in query[1]]
    return set.intersection(*parts) if query[0] == "and" else set.union(*parts)


def _search_pattern(rule: Rule) -> str:
    # A run of one class that must be long enough is the same as a long enough run: shorter ones fail anyway.
    if not rule.group and rule.least and (m := re.fullmatch(r"(\w*)(\[[^\]]+\])\+", rule.pattern)):
        return f"{m[1]}{m[2]}{{{rule.least - len(m[1])},}}"
    return rule.pattern


@functools.lru_cache(maxsize=16)
def _compiled(rules: tuple[Rule, ...]):
    """Once a worker: each rule's query and matcher, the trigrams of all queries, and the table that looks them up."""
    queries = [trigram_query(r.pattern) for r in rules]
    matchers = [re.compile(_search_pattern(r), re.ASCII | (re.IGNORECASE if r.any_case else 0)) for r in rules]
    names = sorted(set().union(*map(_trigrams, queries)))
    table = np.zeros(1 << 24, dtype=np.uint16)
    for k, t in enumerate(names, 1):
        table[int.from_bytes(t.encode(), "big")] = k
    return queries, matchers, names, table


def postings(texts: list[str], names: list[str], table: np.ndarray) -> dict[str, set[int]]:
    """Trigram -> the texts that have it, from one pass over all bytes, A-Z in lower case."""
    lower = [t.encode("utf-8", "surrogatepass").lower() for t in texts]
    ends = np.cumsum([len(x) + 1 for x in lower])
    # No trigram of a query has a zero byte, so none spans two texts.
    data = np.frombuffer(b"\0".join(lower), dtype=np.uint8)
    out: dict[str, set[int]] = {t: set() for t in names}
    for at in range(0, max(0, len(data) - 2), PIECE):
        piece = data[at : at + PIECE + 2].astype(np.uint32)
        code = table[(piece[:-2] << np.uint32(16)) | (piece[1:-1] << np.uint32(8)) | piece[2:]]
        hit = np.flatnonzero(code)
        pairs = np.unique(code[hit].astype(np.int64) << 32 | np.searchsorted(ends, hit + at, "right"))
        for key in pairs.tolist():
            out[names[(key >> 32) - 1]].add(key & 0xFFFFFFFF)
    return out


def find(texts: list[str], rules: tuple[Rule, ...]) -> list[list[tuple[int, int, int]]]:
    """Spans (start, rank of the rule, end) of every text, by start and rank."""
    queries, matchers, names, table = _compiled(rules)
    index = postings(texts, names, table)
    everything = set(range(len(texts)))
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for rank, (rule, query, match) in enumerate(zip(rules, queries, matchers)):
        for i in _rows(query, index, everything):
            for m in match.finditer(texts[i]):
                if m.end(rule.group) - m.start(rule.group) >= rule.least:
                    found[i].append((m.start(), rank, m.end()))
    for spans in found:
        spans.sort()
    return found


def scan(df: DataFrame, text: str = "text", extra: tuple[Rule, ...] = EXTRA) -> DataFrame:
    """Adds n_assign, n_access, n_hex, base_sha256 and spans to every row.

    Spans are ``kind:start:end`` in code points, end exclusive, comma-joined by start, then by kind as
    listed; base_sha256 is the digest of the base rules' spans written so. Null texts count as empty
    and have no spans; all rows stay, repeated ones too; columns named as ours are replaced. Texts of
    any length are scanned whole.
    """
    df = df.drop("n_assign", "n_access", "n_hex", "base_sha256", "spans")
    rules = BASE + tuple(extra)

    @F.pandas_udf("n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
    def spans_of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [t or "" for t in batch]
            out = []
            for lo in range(0, len(texts), SEGMENT):
                for spans in find(texts[lo : lo + SEGMENT], rules):
                    write = lambda some: ",".join(f"{rules[k].kind}:{a}:{b}" for a, k, b in some)
                    base = [s for s in spans if s[1] < len(BASE)]
                    n = [sum(s[1] == k for s in base) for k in range(len(BASE))]
                    out.append((*n, hashlib.sha256(write(base).encode()).hexdigest(), write(spans)))
            yield pd.DataFrame(out, columns=["n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    found = unused(df, "found")
    return df.withColumn(found, spans_of(F.col(text))).select(*df.columns, f"{found}.*")
