"""Statistical tests and regressions as aggregates; the driver finishes only on a row of sums."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.workspace import folder
from .quantiles import grouped_quantiles, quantiles, saved
from .timeseries import average_rank, value_ranks


def normal_p(z: Column) -> Column:
    """Two-sided p of a standard normal, by a rational approximation of erfc with error below 1.5e-7."""
    x = F.abs(z) / math.sqrt(2)
    t = 1 / (1 + 0.3275911 * x)
    # Abramowitz and Stegun 7.1.26.
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return poly * F.exp(-x * x)


def spearman(df: DataFrame, x: str, y: str, by: Sequence[str] = (), least: int = 0) -> DataFrame:
    """Pearson of average ranks: n and rho; 0 where a side is constant. Groups smaller than ``least`` go."""
    d = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    d = average_rank(average_rank(d, x, by, "_rx"), y, by, "_ry")
    # Not by corr(), which ANSI mode stops in any group with a constant side.
    g = d.groupBy(*by).agg(F.count("*").alias("n"), F.covar_pop("_rx", "_ry").alias("_c"), F.stddev_pop("_rx").alias("_sx"), F.stddev_pop("_ry").alias("_sy"))
    rho = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("_c") / (F.col("_sx") * F.col("_sy"))))
    return g.where(F.col("n") >= least).select(*by, "n", F.when((F.col("_sx") > 0) & (F.col("_sy") > 0), rho).otherwise(0.0).alias("rho"))


#: Rows of a permutation that one task orders, and rows that one chunk of permutations makes.
PERM_PART, PERM_CHUNK = 4096, 20_000_000
#: Rows up to which every task holds all of them, 24 bytes each, and makes whole permutations.
PERM_HELD = 1_000_000


def permutation_test(df: DataFrame, id_: str, x: str, y: str, permutations: int, seed: str = "p", chunk: int = 500) -> DataFrame:
    """Two-sided permutation p of Spearman's rho, (extreme + 1) / (P + 1).

    A permutation orders the rows by the md5 of its number and their id, a number. Up to PERM_HELD rows go to every task
    once, which makes permutations alone, without a shuffle. Of more rows positions come from counts by range of the md5,
    then within a range, and meet the other side's by shuffle: no task holds all rows. There a chunk of permutations is
    counted at a time, of at most ``chunk``; fewer with more rows.
    """
    spark = df.sparkSession
    d = average_rank(average_rank(df.where(F.col(x).isNotNull() & F.col(y).isNotNull()), x, (), "_rx"), y, (), "_ry")
    d = d.select(F.col(id_).alias("_id"), "_rx", "_ry")
    first = value_ranks(d.groupBy(F.col("_id").alias("_v")).agg(F.count("*").alias("_n")), "_r").select(F.col("_v").alias("_id"), (F.col("_r") - (F.col("_n") + 1) / 2).cast("long").alias("_before"))
    d = d.join(first, "_id").withColumn("_pos", F.col("_before") + F.row_number().over(Window.partitionBy("_id").orderBy("_rx", "_ry")))
    at = folder(spark, "permutation")
    d.select("_id", "_rx", "_ry", "_pos").write.parquet(at)
    d = spark.read.parquet(at)
    m = d.agg(F.count("*").alias("n"), F.sum(F.col("_rx") * F.col("_ry")).alias("obs"), F.avg("_rx").alias("mx"), F.avg("_ry").alias("my"), F.covar_pop("_rx", "_ry").alias("c"), F.stddev_pop("_rx").alias("sx"), F.stddev_pop("_ry").alias("sy")).first()
    schema = "n long, rho double, extreme long, p double"
    if not m.n:
        return spark.createDataFrame([], schema)
    rho = m.c / (m.sx * m.sy) if m.sx and m.sy else math.nan
    centre, parts = m.n * m.mx * m.my, -(-m.n // PERM_PART)
    if m.n <= PERM_HELD:
        extreme = _extreme_held(d, permutations, seed, centre, abs(m.obs - centre) - 1e-9)
        return spark.createDataFrame([(m.n, rho, extreme, (extreme + 1) / (permutations + 1))], schema)
    chunk = max(1, min(chunk, PERM_CHUNK // m.n))
    ry, extreme = d.select("_pos", "_ry"), 0
    rx = d.select("_id", "_rx").repartition(spark.sparkContext.defaultParallelism)
    for lo in range(0, permutations, chunk):
        perms = F.explode(F.sequence(F.lit(lo), F.lit(min(permutations, lo + chunk) - 1))).alias("perm")
        keys = rx.select("_id", "_rx", perms).withColumn("_h", F.md5(F.concat(F.lit(seed), F.col("perm").cast("string"), F.lit(":"), F.col("_id").cast("string"))))
        keys = keys.withColumn("_part", F.shiftright(F.conv(F.substring("_h", 1, 8), 16, 10).cast("long") * F.lit(parts), 32))
        inner = F.row_number().over(Window.partitionBy("perm", "_part").orderBy("_h", "_id"))
        if parts > 1:
            sizes = keys.groupBy("perm", "_part").agg(F.count("*").alias("_s"))
            before = sizes.withColumn("_b", F.coalesce(F.sum("_s").over(Window.partitionBy("perm").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
            shuffled = keys.withColumn("_i", inner).join(before.select("perm", "_part", "_b"), ["perm", "_part"]).withColumn("_pos", F.col("_b") + F.col("_i"))
        else:
            shuffled = keys.withColumn("_pos", inner.cast("long"))
        sums = shuffled.join(ry, "_pos").groupBy("perm").agg(F.sum(F.col("_rx") * F.col("_ry")).alias("_s"))
        extreme += sums.where(F.abs(F.col("_s") - centre) >= abs(m.obs - centre) - 1e-9).count()
    return spark.createDataFrame([(m.n, rho, extreme, (extreme + 1) / (permutations + 1))], schema)


def _extreme_held(d: DataFrame, permutations: int, seed: str, centre: float, least: float) -> int:
    """Permutations of rows (_id, _rx, _ry, _pos) whose sum of products is ``least`` or more away from the centre."""
    spark = d.sparkSession
    t = d.select("_pos", "_id", "_rx", "_ry").toArrow()
    at = np.argsort(t.column("_pos").to_numpy())
    held = spark.sparkContext.broadcast([t.column(c).to_numpy()[at] for c in ("_id", "_rx", "_ry")])
    del t

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, rx, ry = held.value
        ids, n = [str(i).encode() for i in ids.tolist()], 0
        for b in batches:
            for k in b.column(0).to_pylist():
                start = f"{seed}{k}:".encode()
                h = np.frombuffer(b"".join([hashlib.md5(start + i).digest() for i in ids]), ">u8").reshape(-1, 2).astype(np.uint64)
                order = np.argsort(h[:, 0])
                first = h[order, 0]
                if (first[1:] == first[:-1]).any():
                    order = np.lexsort((h[:, 1], h[:, 0]))  # equal ones stay in the order of ids
                n += bool(abs(float(rx[order] @ ry) - centre) >= least)
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    tasks = min(permutations, 8 * spark.sparkContext.defaultParallelism)
    n = spark.range(0, permutations, 1, tasks).mapInArrow(run, "n long").agg(F.sum("n")).first()[0]
    held.unpersist()
    return n or 0


def welch(df: DataFrame, flag: str, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Two groups: n, means, difference, standard error, t, degrees of freedom, 95 % interval, normal p."""
    on, off = F.col(flag) == 1, F.col(flag) == 0
    v = F.col(value)
    pick = lambda c: F.when(c, v)
    g = df.groupBy(*by).agg(
        F.count(pick(on)).alias("n1"), F.count(pick(off)).alias("n0"), F.avg(pick(on)).alias("mean1"), F.avg(pick(off)).alias("mean0"), F.var_samp(pick(on)).alias("_v1"), F.var_samp(pick(off)).alias("_v0")
    )
    a, b = F.col("_v1") / F.col("n1"), F.col("_v0") / F.col("n0")
    g = g.withColumns({"diff": F.col("mean1") - F.col("mean0"), "se": F.sqrt(a + b), "df": F.try_divide((a + b) * (a + b), a * a / (F.col("n1") - 1) + b * b / (F.col("n0") - 1))})
    g = g.withColumns({"t": F.try_divide("diff", "se"), "lo": F.col("diff") - 1.96 * F.col("se"), "hi": F.col("diff") + 1.96 * F.col("se")})
    return g.withColumn("p_normal", normal_p(F.col("t"))).drop("_v1", "_v0")


def mann_whitney(df: DataFrame, flag: str, value: str) -> DataFrame:
    """U of group 1, z with ties corrected, normal p and rank-biserial; blanks with fewer than 3 on a side."""
    # Ranks and ties need only how often each value occurs in either group.
    d = df.where(F.col(value).isNotNull() & F.col(flag).isin(0, 1))
    counts = d.groupBy(F.col(value).alias("_v")).agg(F.count("*").alias("_n"), F.count_if(F.col(flag) == 1).alias("_n1"))
    t = F.col("_n").cast("double")
    g = value_ranks(counts, "_r").agg(F.sum("_n1").alias("n1"), F.sum(F.col("_n") - F.col("_n1")).alias("n0"), F.sum(F.col("_n1") * F.col("_r")).alias("_r1"), F.sum(t * t * t - t).alias("_ties"))
    n1, n0 = F.col("n1").cast("double"), F.col("n0").cast("double")
    n = n1 + n0
    u = F.col("_r1") - n1 * (n1 + 1) / 2
    var = n1 * n0 / 12 * ((n + 1) - F.try_divide(F.col("_ties"), n * (n - 1)))
    enough = (F.col("n1") >= 3) & (F.col("n0") >= 3)
    z = F.when(enough & (var > 0), (u - n1 * n0 / 2) / F.sqrt(var))
    return g.select("n1", "n0", F.when(enough, u).alias("u"), z.alias("z"), normal_p(z).alias("p_normal"), F.when(enough, 2 * u / (n1 * n0) - 1).alias("rank_biserial"))


def sign_test(successes: Column, n: Column) -> Column:
    """min(1, 2 * P(X >= successes)) for X binomial(n, 1/2); null when n is 0."""
    # log C(n, k) as a running sum over k.
    logs = F.aggregate(
        F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.struct(F.lit(0.0).alias("l"), F.when(successes <= 0, F.exp(-n * math.log(2))).otherwise(F.lit(0.0)).alias("s")),
        lambda acc, k: F.struct((acc["l"] + F.ln((n - k + 1).cast("double")) - F.ln(k.cast("double"))).alias("l"), (acc["s"] + F.when(k >= successes, F.exp(acc["l"] + F.ln((n - k + 1).cast("double")) - F.ln(k.cast("double")) - n * math.log(2))).otherwise(F.lit(0.0))).alias("s")),
    )
    return F.when(n > 0, F.least(F.lit(1.0), 2 * logs["s"]))


def fisher_interval(rho: Column, n: Column) -> tuple[Column, Column]:
    """95 % interval of a rank correlation; null with three rows or fewer."""
    z, half = F.atanh(rho), F.when(n > 3, 1.96 / F.sqrt((n - 3).cast("double")))
    return F.tanh(z - half), F.tanh(z + half)


def winsorize(df: DataFrame, value: str, lo: float = 0.01, hi: float = 0.99, name: str = "winsorized") -> DataFrame:
    """Adds the value clipped to its interpolated quantiles."""
    low, high = quantiles(df, {"v": F.col(value)}, [lo, hi])[0]["v"]
    return df.withColumn(name, F.when(F.col(value).isNotNull(), F.least(F.greatest(F.col(value), F.lit(low).cast("double")), F.lit(high).cast("double"))))


def ols(df: DataFrame, y: str, xs: Sequence[str], dummies: dict[str, Sequence] | None = None, cluster: str | None = None) -> DataFrame:
    """Least squares with an intercept; HC1 errors, or cluster-robust ones by ``cluster``.

    The Gram matrix and the score products are sums over rows; only k x k numbers reach the driver.
    ``dummies`` holds categorical columns with their levels, the first of which is the base. Columns
    that don't vary are left out. Returns name, coef, se, t, n, r2.
    """
    spark: SparkSession = df.sparkSession
    cols: dict[str, Column] = {"const": F.lit(1.0)} | {x: F.col(x).cast("double") for x in xs}
    for c, levels in (dummies or {}).items():
        cols |= {f"{c}={v}": (F.col(c) == v).cast("double") for v in list(levels)[1:]}
    names = list(cols)
    d = df.select(F.col(y).cast("double").alias("_y"), *([F.col(cluster).alias("_c")] if cluster else []), *[c.alias(f"_x{i}") for i, c in enumerate(cols.values())]).dropna()
    spread = d.agg(*[F.min(f"_x{i}") < F.max(f"_x{i}") for i in range(len(names))]).first()
    keep = [0] + [i for i in range(1, len(names)) if spread[i]]
    x = [F.col(f"_x{i}") for i in keep]
    k = len(keep)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    s = d.agg(F.count("*"), F.sum("_y"), F.sum(F.col("_y") * F.col("_y")), *[F.sum(x[i] * F.col("_y")) for i in range(k)], *[F.sum(x[i] * x[j]) for i, j in pairs]).first()
    n, sy, syy = s[0], s[1], s[2]
    gram = np.zeros((k, k))
    for (i, j), v in zip(pairs, s[3 + k :]):
        gram[i, j] = gram[j, i] = v
    inv = np.linalg.pinv(gram)
    beta = inv @ np.array(s[3 : 3 + k])
    e = F.col("_y") - sum((float(b) * c for b, c in zip(beta, x)), F.lit(0.0))
    if cluster:
        scores = d.groupBy("_c").agg(*[F.sum(e * c).alias(f"_s{i}") for i, c in enumerate(x)], F.sum(e * e).alias("_e2"))
        m = scores.agg(F.count("*"), F.sum("_e2"), *[F.sum(F.col(f"_s{i}") * F.col(f"_s{j}")) for i, j in pairs]).first()
        g = m[0]
        scale = g / max(1, g - 1) * (n - 1) / max(1, n - k)
    else:
        m = d.agg(F.count("*"), F.sum(e * e), *[F.sum(e * e * x[i] * x[j]) for i, j in pairs]).first()
        scale = n / max(1, n - k)
    meat = np.zeros((k, k))
    for (i, j), v in zip(pairs, m[2:]):
        meat[i, j] = meat[j, i] = v
    se = np.sqrt(np.maximum(0, np.diag(inv @ meat @ inv) * scale))
    r2 = 1 - m[1] / max(1e-300, syy - sy * sy / n)
    rows = [(names[i], float(b), float(v), float(b / v) if v else None, n, float(r2)) for i, b, v in zip(keep, beta, se)]
    return spark.createDataFrame(rows, "name string, coef double, se double, t double, n long, r2 double")


def stratified_difference(df: DataFrame, stratum: Column, flag: str, value: str) -> DataFrame:
    """Medians of both groups in each stratum and their difference; null where a side is empty."""
    d = df.select(stratum.alias("stratum"), F.col(flag).alias("_f"), F.col(value).alias("_v"))
    g = d.groupBy("stratum").agg(F.count_if(F.col("_f") == 1).alias("n1"), F.count_if(F.col("_f") == 0).alias("n0"))
    of = lambda k: (F.when(F.col("_f") == k, F.col("_v")), 0.5)
    q = grouped_quantiles(d, ["stratum"], {"median1": of(1), "median0": of(0)}).withColumnRenamed("stratum", "_s")
    out = g.join(q, F.col("stratum").eqNullSafe(F.col("_s")), "left").drop("_s")
    return out.withColumn("diff", F.col("median1") - F.col("median0"))


def absorb(df: DataFrame, columns: Sequence[str], by: Sequence[str], tolerance: float = 1e-10, rounds: int = 500) -> tuple[DataFrame, dict[str, int]]:
    """The columns with the means of every level of each of ``by`` taken out, by turns until none is left; and the levels of each.

    What remains is orthogonal to all the levels' dummies, however many there are: a round is one aggregate and one join a column of ``by``.
    """
    d = saved(df, "absorb")
    levels = d.agg(*[F.countDistinct(c).alias(c) for c in by]).first().asDict()
    spread = d.agg(*[F.stddev_pop(c).alias(c) for c in columns]).first().asDict()
    for _ in range(rounds):
        for c in by:
            means = d.groupBy(F.col(c).alias("_level")).agg(*[F.avg(x).alias(f"_mean_{x}") for x in columns])
            d = d.join(means, F.col(c) == F.col("_level")).withColumns({x: F.col(x) - F.col(f"_mean_{x}") for x in columns}).select(*df.columns)
        d = saved(d, "absorb")
        # The last of ``by`` has no means left; the others have what its step brought back.
        rest = [d.groupBy(c).agg(*[F.avg(x).alias(x) for x in columns]).agg(*[F.max(F.abs(x)).alias(x) for x in columns]).first().asDict() for c in by[:-1]]
        if all(r[x] <= tolerance * max(spread[x] or 0, 1e-300) for r in rest for x in columns):
            break
    return d, levels


def ols_absorbed(df: DataFrame, y: str, xs: Sequence[str], by: Sequence[str], cluster: str | None = None) -> DataFrame:
    """Least squares with a dummy for every level of each of ``by``, which are absorbed: errors and degrees of freedom are those of
    ols() with these dummies. HC1 errors, or cluster-robust ones. Rows with a null in any column are left out. Columns that the levels
    explain wholly are left out. Returns name, coef, se, t, n, r2.
    """
    spark = df.sparkSession
    names = {f"_x{i}": x for i, x in enumerate(xs)}
    by_names = [f"_b{i}" for i in range(len(by))]
    d = df.select(F.col(y).cast("double").alias("_y"), *[F.col(x).cast("double").alias(n) for n, x in names.items()], *[F.col(c).alias(b) for b, c in zip(by_names, by)], *([F.col(cluster).alias("_c")] if cluster else [])).dropna()
    before = d.agg(F.count("*"), F.var_pop("_y"), *[F.var_pop(n) for n in names]).first()
    n, sst = before[0], (before[0] * before[1] if before[0] else 0.0)
    schema = "name string, coef double, se double, t double, n long, r2 double"
    if not n:
        return spark.createDataFrame([], schema)
    d, levels = absorb(d, ["_y", *names], by_names)
    after = d.agg(*[F.avg(F.col(c) * F.col(c)) for c in names]).first()
    keep = [c for c, v, w in zip(names, before[2:], after) if v and w > 1e-16 * v]
    x, k = [F.col(c) for c in keep], len(keep)
    used = k + sum(levels.values()) - len(by) + 1
    pairs = [(i, j) for i in range(k) for j in range(i, k)]

    def matrix(values) -> np.ndarray:
        m = np.zeros((k, k))
        for (i, j), v in zip(pairs, values):
            m[i, j] = m[j, i] = v
        return m

    s = d.agg(F.count("*"), *[F.sum(c * F.col("_y")) for c in x], *[F.sum(x[i] * x[j]) for i, j in pairs]).first()
    inv = np.linalg.pinv(matrix(s[1 + k :])) if k else np.zeros((0, 0))
    beta = inv @ np.array(s[1 : 1 + k], dtype=float)
    e = F.col("_y") - sum((float(b) * c for b, c in zip(beta, x)), F.lit(0.0))
    if cluster:
        scores = d.groupBy("_c").agg(F.sum(e * e).alias("_e2"), *[F.sum(e * c).alias(f"_s{i}") for i, c in enumerate(x)])
        m = scores.agg(F.count("*"), F.sum("_e2"), *[F.sum(F.col(f"_s{i}") * F.col(f"_s{j}")) for i, j in pairs]).first()
        scale = m[0] / max(1, m[0] - 1) * (n - 1) / max(1, n - used)
    else:
        m = d.agg(F.count("*"), F.sum(e * e), *[F.sum(e * e * x[i] * x[j]) for i, j in pairs]).first()
        scale = n / max(1, n - used)
    se = np.sqrt(np.maximum(0, np.diag(inv @ matrix(m[2:]) @ inv) * scale))
    r2 = 1 - m[1] / max(1e-300, sst)
    return spark.createDataFrame([(names[c], float(b), float(v), float(b / v) if v else None, n, float(r2)) for c, b, v in zip(keep, beta, se)], schema)
