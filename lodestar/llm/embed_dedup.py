"""Near-duplicate embeddings by int8 tile products with rigorous error bounds.

Unit vectors are quantised to int8 with one step per vector, and what is left of them to int8 again. For
x = c + e the exact cosine of two vectors x, y = d + f differs from c . d by at most |e||d| + |f||c| +
|e||f|, so a tile of integer products shows which pairs can possibly reach the threshold. Those are
computed again with both codes, whose bound is some hundred times closer; the few pairs that are still
undecided leave the tile and are computed in full precision. Only codes travel to the tiles. Equal
vectors are one before the tiles are made, and a tile returns, for each of its vectors, how many partners
it has and one link of a spanning forest, never its pairs.
"""

from __future__ import annotations

import math
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, components

#: Vectors of a block; a tile compares two blocks.
BLOCK = 8192
#: Rows of a tile whose products are held at once, and pairs that are computed again at once.
STRIP, PAIRS = 512, 1 << 15
#: Slack for rounding in the bounds, of float32 products and of double ones.
EPS, EPS_FINE = 1e-6, 1e-12


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows -> int8 codes, steps, lengths of the coded rows and of the errors."""
    step = np.maximum(np.abs(x).max(axis=1), 1e-30) / 127
    q = np.rint(x / step[:, None]).astype(np.int8)
    coded = q * step[:, None]
    return q, step, np.linalg.norm(coded, axis=1), np.linalg.norm(x - coded, axis=1)


def _encoded(rows: pd.Series) -> pd.DataFrame:
    """Vectors -> both codes and their steps, lengths and errors."""
    out = np.empty((len(rows), 6))
    codes: list[list] = [[None] * len(rows), [None] * len(rows)]
    lengths = rows.map(len).to_numpy()
    for dim in np.unique(lengths):
        at = np.flatnonzero(lengths == dim)
        x = np.stack([rows.iloc[i] for i in at]).astype(np.float64)
        x = x / np.linalg.norm(x, axis=1)[:, None]
        q, step, length, error = quantise(x)
        fine, step2, _, _ = quantise(x - q * step[:, None])
        both = q * step[:, None] + fine * step2[:, None]
        out[at] = np.stack([step, length, error, step2, np.linalg.norm(both, axis=1), np.linalg.norm(x - both, axis=1)], axis=1)
        for k, i in enumerate(at):
            codes[0][i], codes[1][i] = q[k].tobytes(), fine[k].tobytes()
    return pd.DataFrame(out, columns=["step", "length", "error", "step2", "length2", "error2"]).assign(q=codes[0], fine=codes[1])


class _Block:
    """One side of a tile."""

    def __init__(self, pdf: pd.DataFrame):
        self.q = np.stack([np.frombuffer(v, np.int8) for v in pdf["q"]])
        self.fine = np.stack([np.frombuffer(v, np.int8) for v in pdf["fine"]])
        self.step, self.length, self.error, self.step2, self.length2, self.error2 = (pdf[c].to_numpy() for c in ("step", "length", "error", "step2", "length2", "error2"))

    def both(self, at: np.ndarray) -> np.ndarray:
        return self.q[at] * self.step[at, None] + self.fine[at] * self.step2[at, None]


def _links(a: _Block, b: _Block, same: bool, threshold: float):
    """Pairs (i, j, sure) of rows of a and b whose cosine reaches the threshold, or may reach it if not sure; strip by strip."""
    # Products of int8 codes are exact in float32 while d * 127^2 < 2^24; longer rows are summed in pieces.
    width = (1 << 24) // (127 * 127)
    fb = b.q.astype(np.float32)
    for lo in range(0, len(a.q), STRIP):
        hi = min(lo + STRIP, len(a.q))
        fa = a.q[lo:hi].astype(np.float32)
        dot = fa[:, :width] @ fb[:, :width].T
        if fa.shape[1] > width:
            dot = dot.astype(np.float64)
            for k in range(width, fa.shape[1], width):
                dot += fa[:, k : k + width] @ fb[:, k : k + width].T
        # First by the worst bounds of the block, one number a row; then by the pair's own.
        least = (threshold - EPS - a.error[lo:hi] * (b.length.max() + b.error.max()) - a.length[lo:hi] * b.error.max()) / (a.step[lo:hi] * (b.step.max() if threshold > 0 else b.step.min()))
        least = np.where(least > 0, least, -np.inf)
        i, j = np.nonzero(dot >= least.astype(np.float32)[:, None] - 1)
        i += lo
        keep = a.step[i] * b.step[j] * dot[i - lo, j] + a.error[i] * (b.length[j] + b.error[j]) + a.length[i] * b.error[j] >= threshold - EPS
        if same:
            keep &= i < j
        i, j = i[keep], j[keep]
        for k in range(0, len(i), PAIRS):
            x, y = i[k : k + PAIRS], j[k : k + PAIRS]
            near = np.einsum("ij,ij->i", a.both(x), b.both(y))
            slack = a.error2[x] * (b.length2[y] + b.error2[y]) + a.length2[x] * b.error2[y] + EPS_FINE
            may, sure = near + slack >= threshold, near - slack >= threshold
            yield x[may], y[may], sure[may]


class _Forest:
    """Union-find over the vectors of a tile."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, pairs_i: np.ndarray, pairs_j: np.ndarray) -> None:
        for i, j in zip(pairs_i.tolist(), pairs_j.tolist()):
            i, j = self.root(i), self.root(j)
            if i != j:
                self.up[max(i, j)] = min(i, j)


def _tile(pdf: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """Of one tile: node, partners in the tile (copies counted) and a linked node; and undecided pairs (node, link, n null)."""
    pdf = pdf.sort_values("node", kind="stable", ignore_index=True)
    w, node = pdf["copies"].to_numpy(), pdf["node"].to_numpy()
    same = bool(pdf["same"].iloc[0])
    rows = np.flatnonzero(pdf["side"] == 0)
    cols = rows if same else np.flatnonzero(pdf["side"] == 1)
    n = np.zeros(len(pdf), dtype=np.int64)
    forest, undecided = _Forest(len(pdf)), []
    if len(rows) and len(cols):
        a = _Block(pdf.iloc[rows])
        for i, j, sure in _links(a, a if same else _Block(pdf.iloc[cols]), same, threshold):
            i, j = rows[i], cols[j]
            undecided.append(pd.DataFrame({"node": node[i[~sure]], "n": None, "link": node[j[~sure]]}))
            i, j = i[sure], j[sure]
            np.add.at(n, i, w[j])
            np.add.at(n, j, w[i])
            forest.join(i, j)
    out = pd.DataFrame({"node": node, "n": n, "link": node[[forest.root(i) for i in range(len(pdf))]]})
    out = pd.concat([out[(out["n"] > 0) | (out["link"] != out["node"])], *undecided])
    return out.astype({"node": "int64", "n": "Int64", "link": "int64"})


def _exact(pairs: DataFrame, vectors: DataFrame, threshold: float) -> DataFrame:
    """The undecided pairs in double precision: node, n, link of those that reach the threshold, for either side."""
    side = lambda k: vectors.select(F.col("node").alias(k), F.col("v").alias(f"v{k}"), F.col("copies").alias(f"c{k}"))
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda p, q: p + q)
    x = pairs.select(F.col("node").alias("a"), F.col("link").alias("b")).join(side("a"), "a").join(side("b"), "b")
    x = x.where(dot("va", "vb") / (F.sqrt(dot("va", "va")) * F.sqrt(dot("vb", "vb"))) >= threshold)
    return x.select(F.col("a").alias("node"), F.col("cb").alias("n"), F.col("b").alias("link")).union(x.select("b", "ca", "a"))


def cosine(x, y) -> float:
    """The cosine that a link is decided by, in doubles: parts divided by the vector's largest magnitude, sums from left to right.

    What _exact computes of a pair, also where two values of the threshold's last bit would differ by how they are summed.
    """
    def scaled(v):
        largest = max(abs(float(p)) for p in v)
        return [float(p) / largest + 0.0 for p in v]

    def dot(v, w):
        total = 0.0
        for p, q in zip(v, w):
            total += p * q
        return total

    x, y = scaled(x), scaled(y)
    return dot(x, y) / (math.sqrt(dot(x, x)) * math.sqrt(dot(y, y)))


def near_duplicates(df: DataFrame, threshold: float = 0.95, vector: str = "embedding", id_: str = "vec_id", block: int = BLOCK) -> DataFrame:
    """Links of cosine() >= threshold among all vectors; one row a vector.

    Returns vec_id, n_links (other vectors linked directly), component_id (smallest vec_id reachable,
    itself included) and kept (vec_id = component_id). No pair is missed and none below the threshold
    is linked. Null, empty and zero vectors and those with null or non-finite parts link with nothing;
    vectors of unlike lengths are compared only among their own length. Equal vectors link with each
    other; they are told apart by 128-bit hashes. Rows of the same id are vectors of their own; a null id
    is never the smallest of others and its own row has a null component only if alone (kept is then
    null). An empty table gives no rows.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "embed")
    v = F.col("raw").cast("array<double>")
    usable = F.coalesce((F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))), F.lit(False))
    # Scaled by the largest part, squares neither vanish nor overflow; the outer lambda finds it once a vector.
    largest = F.array_max(F.transform(v, F.abs))
    scaled = F.when(usable & (largest > 0), F.get(F.transform(F.array(largest), lambda m: F.transform(v, lambda x: x / m + 0.0)), 0))

    def hashes(of: Column) -> list[Column]:
        return [F.when(of.isNotNull(), F.xxhash64(F.lit(k), of)).alias(c) for k, c in enumerate(("ha", "hb"))]

    rows = df.select(F.col(id_).cast("long").alias("vec_id"), F.col(vector).alias("raw")).select("vec_id", "raw", *hashes(scaled))
    ids = scratch.save(rows.select("vec_id", "ha", "hb"), "ids")
    # Equal vectors as one; the number of a row in the saved table names it.
    uniq = rows.where("ha is not null").groupBy("ha", "hb").agg(F.count("*").alias("copies"), F.first("raw").alias("raw"))
    uniq = scratch.save(uniq.select("ha", "hb", "copies", scaled.alias("v"), F.size("raw").alias("dim"), F.monotonically_increasing_id().alias("node")), "vectors")
    sizes = {r[0]: r[1] for r in uniq.groupBy("dim").count().collect()}
    # At least 8 blocks of a thousand vectors, so that few vectors give work to many tasks too.
    n_blocks = {d: max(ceil(n / block), min(8, ceil(n / 1024))) for d, n in sizes.items()}
    blocks = F.element_at(F.create_map(*[F.lit(x) for kv in n_blocks.items() for x in kv]), F.col("dim")) if sizes else F.lit(1)

    numbers = "step double, length double, error double, step2 double, length2 double, error2 double, q binary, fine binary"
    placed = uniq.select("node", "copies", "dim", F.pandas_udf(_encoded, numbers)("v").alias("x"), blocks.alias("of")).withColumn("blk", F.pmod(F.xxhash64("node"), F.col("of")))
    # Block b is the first side of tiles (b, c) for c >= b and the second side of tiles (c, b) for c < b.
    tiles = placed.select("*", F.explode(F.sequence(F.lit(0), F.col("of") - 1)).alias("o"))
    tiles = tiles.select("node", "copies", "dim", "x.*", F.least("blk", "o").alias("i"), F.greatest("blk", "o").alias("j"), F.when(F.col("blk") <= F.col("o"), 0).otherwise(1).alias("side"), (F.col("blk") == F.col("o")).alias("same"))
    part = scratch.save(tiles.groupBy("dim", "i", "j").applyInPandas(lambda pdf: _tile(pdf, threshold), "node long, n long, link long"), "links")
    part = part.where("n is not null").union(scratch.save(_exact(part.where("n is null"), uniq.select("node", "v", "copies"), threshold), "exact"))

    roots = components(scratch, part.select(F.col("node").alias("a"), F.col("link").alias("b")))
    partners = part.groupBy("node").agg(F.sum("n").alias("partners"))
    # By vector first, so that copies don't meet in one group.
    first = ids.where("ha is not null").groupBy("ha", "hb").agg(F.min("vec_id").alias("first"))
    nodes = uniq.select("ha", "hb", "node", "copies").join(partners, "node", "left").join(roots, "node", "left").join(first, ["ha", "hb"]).withColumn("root", F.coalesce("root", "node"))
    nodes = nodes.join(nodes.groupBy("root").agg(F.min("first").alias("least")), "root").select("ha", "hb", "least", (F.coalesce("partners", F.lit(0)) + F.col("copies") - 1).alias("n"))
    out = ids.join(nodes, ["ha", "hb"], "left")
    comp = F.coalesce("least", "vec_id")
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), comp.alias("component_id"), (F.col("vec_id") == comp).alias("kept"))
