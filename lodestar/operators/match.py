"""Entity mentions in text: aliases, an n-gram dictionary join, and a score for every candidate.

Candidates come from an equi-join of the texts' 1..L-grams with the alias table; the score is Column
arithmetic on candidates only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import company_key
from ..functions.text import normalize_text

# Words that alone name no company, terms of a financial context, and the scores.
GENERIC = (
    "energy capital group holdings holding technologies technology systems solutions partners global international industries labs media health financial acquisition "
    "therapeutics pharmaceuticals pharma bio sciences resources securities ventures digital data cloud networks services"
).split()
FINANCIAL = r"(?<![a-z0-9])(ipo|s 1|f 1|424b4|prospectus|nasdaq|nyse|ticker|shares?|stock|listing|lists|going public|valuation|underwrit[a-z]*|filing|filed|offering|pre ipo|market cap|sec)(?![a-z0-9])"
BASE = {"cashtag": 0.95, "legal": 0.70, "informal": 0.55, "brand": 0.40}
ACCEPT, REVIEW = 0.70, 0.45


def generate_aliases(issuers: DataFrame, common: DataFrame, id_: str = "issuer_id", name: str = "legal_name", ticker: str = "ticker") -> DataFrame:
    """Rows (issuer, alias, kind): the name without legal suffixes, its first word, its cashtag.

    The first word is a brand only if it isn't the whole name, has four letters, isn't generic and
    isn't in ``common`` (column token).
    """
    cut = company_key(F.col(name))
    brand = F.substring_index(cut, " ", 1)
    kinds = F.array(
        F.struct(cut.alias("alias"), F.lit("legal").alias("kind")),
        F.struct(F.when((brand != cut) & (F.length(brand) >= 4) & ~brand.isin(GENERIC), brand).alias("alias"), F.lit("brand").alias("kind")),
        F.struct(F.concat(F.lit("$"), F.lower(ticker)).alias("alias"), F.lit("cashtag").alias("kind")),
    )
    rows = issuers.select(F.col(id_), F.inline(kinds)).where("alias <> ''").distinct()
    return rows.join(common.select(F.col("token").alias("_w")).distinct(), (F.col("kind") == "brand") & (F.col("alias") == F.col("_w")), "left_anti")


def ngrams(tokens: Column, longest: int) -> Column:
    """All runs of 1..longest tokens, joined by blanks, each once."""

    def runs(w: Column, k: int) -> Column:
        # Single tokens by position: a slice would copy the whole list for every run.
        some = F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - k, F.lit(0))), lambda i: F.concat_ws(" ", *[F.get(w, i + j) for j in range(k)]))
        return F.when(F.size(w) >= k, some).otherwise(F.array().cast("array<string>"))

    # Bound as a variable, the tokens are computed once a row and not once a run.
    return F.get(F.transform(F.array(tokens), lambda w: F.array_distinct(F.concat(*[runs(w, k) for k in range(1, longest + 1)]))), 0)


def candidates(texts: DataFrame, aliases: DataFrame, id_: str, text: Column, longest: int = 3, alias: str = "alias") -> DataFrame:
    """Distinct (id, alias) pairs whose alias occurs in the text as whole tokens.

    Texts are normalised once; of their positions only those whose token begins an alias stay, by a semi join, and give
    their runs as rows, which meet the aliases in an equi-join. What matched is made distinct. A stream makes the runs of a text
    distinct first, as it then needs no state.
    """
    tokens = F.split(normalize_text(text), " ")
    if texts.isStreaming:
        grams = texts.select(F.col(id_), F.explode(ngrams(tokens, longest)).alias("_g"))
        return grams.join(aliases, F.col("_g") == F.col(alias)).drop("_g")
    rows = texts.select(F.col(id_), tokens.alias("_w"))
    shifted = F.arrays_zip(*[F.slice("_w", k + 1, F.size("_w")).alias(f"t{k}") for k in range(longest)])
    rows = rows.select(id_, F.explode(shifted).alias("_z"))
    firsts = aliases.select(F.substring_index(alias, " ", 1).alias("_first")).distinct()
    rows = rows.join(firsts, F.col("_z.t0") == F.col("_first"), "left_semi")
    runs = [F.when(F.col(f"_z.t{k}").isNotNull(), F.concat_ws(" ", *[F.col(f"_z.t{j}") for j in range(k + 1)])) for k in range(longest)]
    grams = rows.select(id_, F.explode(F.array(*runs)).alias("_g"))
    return grams.join(aliases, F.col("_g") == F.col(alias)).drop("_g").distinct()


def context(texts: DataFrame, id_: str, title: Column, body: Column) -> DataFrame:
    """What a score needs of a text, once a text: (id, ctx_title normalised, ctx_financial)."""
    t, b = normalize_text(F.coalesce(title, F.lit(""))), normalize_text(F.coalesce(body, F.lit("")))
    return texts.select(F.col(id_), t.alias("ctx_title"), F.concat_ws(" ", t, b).rlike(FINANCIAL).alias("ctx_financial"))


def score(cands: DataFrame, common: DataFrame, contexts: DataFrame, id_: str, alias: str = "alias", kind: str = "kind") -> DataFrame:
    """Adds confidence (unrounded, 0 to 1), band (accept, review, drop) and reasons to candidates.

    ``contexts`` comes from context(). ``common`` (column token) holds ordinary words; it meets the
    distinct tokens of the aliases in a join, once an alias.
    """
    words = cands.select(alias).distinct().select(alias, F.posexplode(F.split(alias, " ")).alias("_i", "_w"))
    words = words.join(common.select(F.col("token").alias("_w"), F.lit(True).alias("_common")).distinct(), "_w", "left")
    facts = words.groupBy(alias).agg(F.count("*").alias("_n"), F.count("_common").alias("_nc"), F.count_if(F.col("_common").isNull() & (F.length("_w") >= 4)).alias("_nd"))
    c = cands.join(facts, alias).join(contexts, id_)
    n, common_n = F.col("_n"), F.col("_nc")
    base = F.lit(0.40)
    for k, v in BASE.items():
        base = F.when(F.col(kind) == k, v).otherwise(base)
    plain, partly = F.col("_nd") == 0, common_n > 0
    tiny = (n == 1) & (F.length(alias) <= 3)
    lone = (n == 1) & (F.length(alias) > 3) & (F.col(kind) == "brand")
    financial = F.col("ctx_financial")
    in_title = F.concat(F.lit(" "), F.translate("ctx_title", "$", " "), F.lit(" ")).contains(F.concat(F.lit(" "), F.ltrim(F.col(alias), F.lit("$")), F.lit(" ")))
    steps = [F.when(n > 1, 0.08 * (n - 1)), F.when(plain, -(0.40 + 0.08 * (n - 1))).when(partly, -0.15 * common_n), F.when(tiny, -0.25).when(lone, -0.20), F.when(financial, 0.20), F.when(in_title, 0.08)]
    total = base
    for s in steps:
        total = total + F.coalesce(s, F.lit(0.0))
    reasons = F.array_compact(F.array(F.concat(F.lit("kind="), F.col(kind)), F.when(n > 1, F.concat(F.lit("tokens="), n)), F.when(plain, "no_distinctive_token").when(partly, F.concat(F.lit("common_tokens="), common_n)), F.when(tiny, "tiny_alias").when(lone, "single_token_brand"), F.when(financial, "financial_context+0.20"), F.when(in_title, "in_title+0.08")))
    conf = F.greatest(F.lit(0.0), F.least(F.lit(1.0), total))
    return c.withColumns({"confidence": conf, "band": F.when(conf >= ACCEPT, "accept").when(conf >= REVIEW, "review").otherwise("drop"), "reasons": F.array_join(reasons, ";")}).drop("_n", "_nc", "_nd", "ctx_title", "ctx_financial")


def best(scored: DataFrame, id_: str, order: Sequence[str]) -> DataFrame:
    """The strongest candidate of each text that isn't dropped; the first by ``order`` wins a tie."""
    rest = [c for c in scored.columns if c != id_]
    return scored.where("band <> 'drop'").groupBy(id_).agg(F.min_by(F.struct(*rest), F.struct((-F.col("confidence")).alias("_s"), *order)).alias("_r")).select(id_, "_r.*")
