"""Scores of speaker embeddings: centroids, margin losses, silhouette. Rows are (uttid, spk, dvec array<double>)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from earshot.functions.waves import dot, let, total
from earshot.sources.store import stored


def unit(v: Column) -> Column:
    """The vector at length 1 (lengths below 1e-12 count as that)."""
    return let(F.greatest(F.sqrt(dot(v, v)), F.lit(1e-12)), lambda n: F.transform(v, lambda x: x / n))


def vector_sums(rows: DataFrame, by: str = "spk", v: str = "dvec") -> DataFrame:
    """(by, n, sums): componentwise sums by group, with partial sums before the shuffle."""
    long = rows.select(by, F.posexplode(v).alias("d", "x"))
    sums = long.groupBy(by, "d").agg(F.sum("x").alias("x"), F.count("*").alias("n"))
    return sums.groupBy(by).agg(F.max("n").alias("n"), F.transform(F.sort_array(F.collect_list(F.struct("d", "x"))), lambda s: s["x"]).alias("sums"))


def centroids(rows: DataFrame, by: str = "spk", v: str = "dvec") -> DataFrame:
    """(by, n, centroid)."""
    return vector_sums(rows, by, v).select(by, "n", F.transform("sums", lambda x: x / F.col("n")).alias("centroid"))


def left_out(rows: DataFrame, v: str = "dvec") -> DataFrame:
    """``rows`` with the mean of their speaker's other rows, by arithmetic on the sums; null for a speaker's only row."""
    joined = rows.join(vector_sums(rows, "spk", v), "spk")
    mean = F.zip_with("sums", v, lambda s, x: (s - x) / (F.col("n") - 1))
    return joined.withColumn("others", F.when(F.col("n") > 1, mean)).drop("sums", "n")


def _tiled(rows: DataFrame, classes: DataFrame, tile, schema: str, block: int) -> DataFrame:
    """Rows that ``tile(left, right)`` makes of every block of ``rows`` (uttid, ...) with every block of ``classes`` (spk, ...), whose columns come as other, other_....

    Both sides are cut into blocks of about ``block``; a task holds one of each, so neither side has to fit anywhere whole.
    """

    def blocks(of: DataFrame, name: str) -> DataFrame:
        return of.agg(F.greatest(F.ceil(F.count("*") / F.lit(block)), F.lit(1)).cast("int").alias(name))

    sizes = F.broadcast(blocks(rows, "__m").crossJoin(blocks(classes, "__n")))  # one row
    place = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    lefts = rows.crossJoin(sizes).select(place("uttid", "__m").alias("i"), every("__n").alias("j"), *rows.columns)
    named = [F.col(c).alias("other" if c == "spk" else f"other_{c}") for c in classes.columns]
    rights = classes.crossJoin(sizes).select(every("__m").alias("i"), place("spk", "__n").alias("j"), *named)
    return lefts.groupBy("i", "j").cogroup(rights.groupBy("i", "j")).applyInPandas(tile, schema)


def _against_others(rows: DataFrame, classes: DataFrame, score, most: float, block: int = 1024) -> DataFrame:
    """(uttid, own, rest, best): how each row scores against all classes but its own.

    ``rows`` has (uttid, spk, v, own), ``classes`` (spk, v), vectors at length 1; ``score`` maps cosines to scores, at
    most ``most``. ``rest`` is the sum of exp(score - most), ``best`` the largest score (minus infinity if there is no
    other class). A tile returns one row of sums for each of its rows.
    """
    import numpy as np
    import pandas as pd

    def tile(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"uttid": left.uttid, "own": left.own, "rest": 0.0, "best": -np.inf})
        s = score(np.clip(np.stack(left.v.to_numpy()) @ np.stack(right.other_v.to_numpy()).T, -1, 1))
        same = left.spk.to_numpy()[:, None] == right.other.to_numpy()[None, :]
        return pd.DataFrame({"uttid": left.uttid, "own": left.own, "rest": np.where(same, 0, np.exp(s - most)).sum(1), "best": np.where(same, -np.inf, s).max(1)})

    kind = rows.schema["uttid"].dataType.simpleString()
    met = _tiled(rows.select("uttid", "spk", "v", "own"), classes.select("spk", "v"), tile, f"uttid {kind}, own double, rest double, best double", block)
    return met.groupBy("uttid").agg(F.max("own").alias("own"), F.sum("rest").alias("rest"), F.max("best").alias("best"))


def ge2e_losses(rows: DataFrame, w: float = 10.0, b: float = -5.0, v: str = "dvec") -> DataFrame:
    """(softmax, contrast): generalized end-to-end losses summed over rows, both from one meeting of rows and centroids; a row's own centroid leaves it out (``w`` above 0)."""
    units = rows.select("uttid", "spk", unit(F.col(v)).alias("v"))
    cos = lambda m: F.greatest(dot(F.col("v"), m), F.lit(1e-6))
    points = left_out(units, "v").select("uttid", "spk", "v", (F.lit(w) * cos(unit(F.coalesce("others", "v"))) + F.lit(b)).alias("own"))
    middle = centroids(units, "spk", "v").select("spk", unit(F.col("centroid")).alias("v"))
    met = _against_others(points, middle, lambda x: w * x.clip(1e-6) + b, w + b)
    sigmoid = lambda x: 1 / (1 + F.exp(-x))
    soft, hard = F.log1p(F.col("rest") * F.exp(F.lit(w + b) - F.col("own"))), 1 - sigmoid(F.col("own")) + sigmoid(F.col("best"))
    return met.agg(F.sum(soft).alias("softmax"), F.sum(hard).alias("contrast"))


def ge2e_loss(rows: DataFrame, kind: str = "softmax", w: float = 10.0, b: float = -5.0, v: str = "dvec") -> DataFrame:
    """(loss): one of ``ge2e_losses``, "softmax" or "contrast"."""
    if kind not in ("softmax", "contrast"):
        raise ValueError(f"no such kind: {kind}")
    return ge2e_losses(rows, w, b, v).select(F.col(kind).alias("loss"))


def aam_softmax_loss(rows: DataFrame, classes: DataFrame, margin: float = 0.2, scale: float = 30.0, v: str = "dvec") -> DataFrame:
    """(loss): mean additive-angular-margin cross entropy of rows against class weights (spk, weight); rows of no known class do not count."""
    known = classes.select("spk", unit(F.col("weight")).alias("v"))
    cos = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(F.col("v"), F.col("mine"))))
    own = rows.select("uttid", "spk", unit(F.col(v)).alias("v")).join(known.select("spk", F.col("v").alias("mine")), "spk").select("uttid", "spk", "v", cos.alias("cos"))
    c = F.col("cos")
    sin = F.sqrt(F.greatest(1 - c * c, F.lit(0.0)))
    phi = F.when(c > F.lit(math.cos(math.pi - margin)), c * F.lit(math.cos(margin)) - sin * F.lit(math.sin(margin))).otherwise(c - F.lit(math.sin(math.pi - margin) * margin))
    met = _against_others(own.select("uttid", "spk", "v", (F.lit(scale) * phi).alias("own")), known, lambda x: scale * x, scale)
    return met.agg(F.avg(F.log1p(F.col("rest") * F.exp(F.lit(scale) - F.col("own")))).alias("loss"))


def triplet_loss(rows: DataFrame, margin: float = 1.0, distance: str = "euclidean", compat: bool = False) -> DataFrame:
    """(loss): mean of max(0, d(anchor, positive) - d(anchor, negative) + margin) over unit vectors.

    Cosine distance is 1 - cos; ``compat`` takes the cosine itself for it.
    """
    if distance == "euclidean":
        d = lambda x, y: F.sqrt(total(F.zip_with(x, y, lambda a, b: (a - b) * (a - b))) + F.lit(1e-8))
    elif distance == "cosine":
        d = (lambda x, y: dot(x, y)) if compat else (lambda x, y: 1 - dot(x, y))
    else:
        raise ValueError(f"no such distance: {distance}")
    units = rows.select(*(unit(F.col(c)).alias(c) for c in ("anchor", "positive", "negative")))
    a, p, n = (F.col(c) for c in ("anchor", "positive", "negative"))
    return units.agg(F.avg(F.greatest(d(a, p) - d(a, n) + F.lit(margin), F.lit(0.0))).alias("loss"))


def rivals(rows: DataFrame, v: str = "dvec", block: int = 1024) -> DataFrame:
    """(uttid, other): for each row the other speakers that may be the nearest by mean distance, few where speakers lie apart.

    The mean distance to a speaker's rows is at least the distance to their centroid and at most the root of its
    square plus their variance (both by convexity). A speaker whose least is above another's most is out.
    """
    import numpy as np
    import pandas as pd

    near = rows.select("uttid", "spk", F.col(v).cast("array<double>").alias("v"))
    square = near.groupBy("spk").agg(F.avg(dot(F.col("v"), F.col("v"))).alias("square"))
    c = F.col("centroid")
    stats = stored(centroids(near, "spk", "v").join(square, "spk").select("spk", c.alias("v"), F.greatest(F.col("square") - dot(c, c), F.lit(0.0)).alias("variance")), "speakers")

    def tile(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"uttid": [], "most": [], "found": pd.Series([], dtype=object)})
        x, m = np.stack(left.v.to_numpy()), np.stack(right.other_v.to_numpy())
        square = np.maximum((x * x).sum(1)[:, None] + (m * m).sum(1)[None, :] - 2 * x @ m.T, 0)
        slack = 1e-9 * (1 + (x * x).sum(1)[:, None] + (m * m).sum(1)[None, :])
        least, most = np.sqrt(np.maximum(square - slack, 0)), np.sqrt(square + right.other_variance.to_numpy()[None, :] + slack)
        same = left.spk.to_numpy()[:, None] == right.other.to_numpy()[None, :]
        least[same] = most[same] = np.inf
        bound, others = most.min(1), right.other.to_numpy()
        found = [[(others[k], float(least[i, k])) for k in np.flatnonzero(least[i] <= bound[i])] if np.isfinite(bound[i]) else [] for i in range(len(left))]
        return pd.DataFrame({"uttid": left.uttid.to_numpy(), "most": bound, "found": found})

    kind, spk = rows.schema["uttid"].dataType.simpleString(), rows.schema["spk"].dataType.simpleString()
    met = _tiled(near, stats, tile, f"uttid {kind}, most double, found array<struct<other:{spk},least:double>>", block)
    best = met.groupBy("uttid").agg(F.min("most").alias("most"), F.flatten(F.collect_list("found")).alias("found"))
    return best.select("uttid", "most", F.explode("found").alias("x")).filter("x.least <= most").select("uttid", "x.other")


#: Of silhouettes: into how many blocks all rows would be cut, bytes of vectors that a block holds at most, and rows at least.
PARTS, BLOCK_BYTES, LEAST_ROWS = 16, 1 << 24, 1024


def silhouette(rows: DataFrame, v: str = "dvec", block: int | None = None) -> DataFrame:
    """(uttid, spk, a, b, silhouette): how much nearer each row is to its own speaker than to the next one.

    A row meets the rows of its own speaker and of its ``rivals`` only. Both sides of a speaker's meeting are cut into
    blocks; a task takes one of each and returns one sum for each row. Without a rival b is null and the silhouette 0.
    Blocks grow with the table (to a ``PARTS``-th of it, ``BLOCK_BYTES`` at most, unless ``block`` says how many rows), so
    that a vector is sent as often whatever the table, up to PARTS * BLOCK_BYTES of vectors; beyond that it is sent more
    often in proportion, as the meetings are. A task computes distances for pieces of 1024 by 1024.
    """
    import numpy as np
    import pandas as pd

    near = stored(rows.select("uttid", "spk", F.col(v).cast("array<double>").alias("v")), "vectors")
    asks = stored(rivals(near, "v", block or LEAST_ROWS).unionByName(near.select("uttid", F.col("spk").alias("other"))), "asks")

    def sums(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"uttid": [], "other": [], "total": []})
        x, y = np.stack(left.v.to_numpy()), np.stack(right.theirs.to_numpy())
        ids, them, xx, yy, total = left.uttid.to_numpy(), right.them.to_numpy(), (x * x).sum(1), (y * y).sum(1), np.zeros(len(x))
        for i in range(0, len(x), 1024):
            for j in range(0, len(y), 1024):
                a, b = slice(i, i + 1024), slice(j, j + 1024)
                far = np.sqrt(np.maximum(xx[a, None] + yy[None, b] - 2 * x[a] @ y[b].T, 0))
                far[ids[a, None] == them[None, b]] = 0
                total[a] += far.sum(1)
        return pd.DataFrame({"uttid": ids, "other": left.other.to_numpy(), "total": total})

    sizes = stored(near.groupBy(F.col("spk").alias("other")).agg(F.count("*").alias("n")).join(asks.groupBy("other").agg(F.count("*").alias("asking")), "other"), "sizes")
    most = F.floor(F.lit(BLOCK_BYTES) / F.greatest(8 * F.max(F.size("v")), F.lit(1)))
    grown = F.greatest(F.least(F.ceil(F.count("*") / PARTS), most), F.least(F.lit(LEAST_ROWS), most), F.lit(1))
    of = F.broadcast(near.agg((F.lit(block) if block else grown).cast("bigint").alias("block")))  # one row
    cut = sizes.crossJoin(of).select("other", F.ceil(F.col("asking") / F.col("block")).cast("int").alias("m"), F.ceil(F.col("n") / F.col("block")).cast("int").alias("k"))
    place = lambda n: F.pmod(F.xxhash64("uttid"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    lefts = asks.join(near.select("uttid", "v"), "uttid").join(cut, "other").select("other", place("m").alias("i"), every("k").alias("j"), "uttid", "v")
    theirs = near.select(F.col("spk").alias("other"), F.col("uttid").alias("them"), F.col("v").alias("theirs"))
    rights = theirs.join(cut, "other").select("other", every("m").alias("i"), F.pmod(F.xxhash64("them"), F.col("k")).cast("int").alias("j"), "them", "theirs")
    kind, spk = rows.schema["uttid"].dataType.simpleString(), rows.schema["spk"].dataType.simpleString()
    at = ["other", "i", "j"]
    found = lefts.groupBy(*at).cogroup(rights.groupBy(*at)).applyInPandas(sums, f"uttid {kind}, other {spk}, total double")
    means = found.groupBy("uttid", "other").agg(F.sum("total").alias("total")).join(sizes.select("other", "n"), "other").join(near.select("uttid", "spk"), "uttid")
    own = F.col("other") == F.col("spk")
    ab = means.groupBy("uttid", "spk").agg(F.max(F.when(own & (F.col("n") > 1), F.col("total") / (F.col("n") - 1))).alias("a"), F.min(F.when(~own, F.col("total") / F.col("n"))).alias("b"))
    return ab.withColumn("silhouette", F.coalesce(F.when(F.greatest("a", "b") > 0, (F.col("b") - F.col("a")) / F.greatest("a", "b")), F.lit(0.0)))


def pooled(frames: DataFrame) -> DataFrame:
    """(key, d, mean, std): softmax-weighted statistics of frames (key, pos, logit, length, x array<double>) with pos below the length."""
    valid = frames.filter(F.col("pos") < F.col("length"))
    top = valid.groupBy("key").agg(F.max("logit").alias("top"))
    weighed = valid.join(top, "key").withColumn("w", F.exp(F.col("logit") - F.col("top")))
    long = weighed.select("key", "w", F.posexplode("x").alias("d", "v"))
    sums = long.groupBy("key", "d").agg(F.sum("w").alias("w"), F.sum(F.col("w") * F.col("v")).alias("wv"))
    means = sums.select("key", "d", "w", (F.col("wv") / F.col("w")).alias("mean"))
    spread = long.join(means.select("key", "d", "mean", F.col("w").alias("all")), ["key", "d"])
    return spread.groupBy("key", "d").agg(F.first("mean").alias("mean"), F.sqrt(F.greatest(F.sum(F.col("w") / F.col("all") * F.pow(F.col("v") - F.col("mean"), 2)), F.lit(1e-12))).alias("std"))
