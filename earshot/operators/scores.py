"""Scores of enhanced audio against references, from sums over the samples.

A pair of waveforms is two array columns. Everything below comes from the lengths and the sums of x, y, x^2, y^2 and
xy, so one pass over the arrays in built-in functions is enough.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from earshot.functions.waves import dot, let, peak_abs, total

EPS = 1e-8


def db(x: Column) -> Column:
    return 10 * F.log10(x)


@dataclass(frozen=True)
class Moments:
    """Length and sums of two equally long arrays, the enhanced x and the reference y."""

    n: Column
    xx: Column
    yy: Column
    xy: Column


def from_moments(x: Column, y: Column, f, zero_mean: bool = True) -> Column:
    """f of the moments of x and y, which are computed once."""
    sums = F.struct(F.size(x).cast("double").alias("n"), dot(x, x).alias("xx"), dot(y, y).alias("yy"), dot(x, y).alias("xy"), total(x).alias("x"), total(y).alias("y"))

    def centred(s: Column) -> Column:
        less = (lambda a, b: s[a] * s[b] / s["n"]) if zero_mean else (lambda a, b: F.lit(0.0))
        return F.struct(s["n"].alias("n"), (s["xx"] - less("x", "x")).alias("xx"), (s["yy"] - less("y", "y")).alias("yy"), (s["xy"] - less("x", "y")).alias("xy"))

    return let(sums, lambda s: let(centred(s), lambda m: f(Moments(m["n"], m["xx"], m["yy"], m["xy"]))))


def si_snr(m: Moments) -> Column:
    """Scale-invariant signal-to-noise ratio in dB: the reference is projected on, the rest is noise."""
    a = m.xy / (m.yy + F.lit(EPS))
    target = a * a * m.yy
    noise = F.greatest(m.xx - 2 * a * m.xy + target, F.lit(0.0))
    return db(target / (noise + F.lit(EPS)) + F.lit(EPS))


def comparable(x: Column, y: Column) -> tuple[Column, Column]:
    """Both cut to the shorter and divided by their largest magnitudes; null for silence."""
    n = F.least(F.size(x), F.size(y))

    def level(w: Column) -> Column:
        return let(F.slice(w, F.lit(1), n), lambda c: let(peak_abs(c), lambda p: F.when(p > 0, F.transform(c, lambda v: v / p))))

    return level(x), level(y)


#: Members of the SDR family: (scaled, scale dependent, soft limit in dB, pooled over sources).
FAMILY = {
    "sisnr": (True, False, None, False),
    "sdsdr": (True, True, None, False),
    "sdr": (False, False, None, False),
    "tsdr": (False, False, 30.0, False),
    "sasdr": (False, False, None, True),
    "sasisnr": (True, False, None, True),
    "satsdr": (False, False, 30.0, True),
}

#: The members as their names were compared where they come from: a name within "sdsdr" scales, "sasisnr" does not, none pools.
COMPAT = {kind: (kind == "sisnr" or kind in "sdsdr", dependent, limit, False) for kind, (_, dependent, limit, _) in FAMILY.items()}


def member(kind: str, compat: bool = False) -> tuple[bool, bool, float | None, bool]:
    return (COMPAT if compat else FAMILY)[kind]


def target_and_noise(m: Moments, scaled: bool, scale_dependent: bool, limit: float | None) -> tuple[Column, Column]:
    """Energies of target and noise of one source."""
    a = m.xy / (m.yy + F.lit(EPS)) if scaled else F.lit(1.0)
    target = a * a * m.yy
    b = F.lit(1.0) if scale_dependent else a
    noise = F.greatest(m.xx - 2 * b * m.xy + b * b * m.yy, F.lit(0.0))
    return target, noise + F.lit(10 ** (-limit / 10)) * target if limit is not None else noise


def sdr(m: Moments, kind: str) -> Column:
    """Ratio of a single source in dB, higher is better."""
    scaled, dependent, limit, _ = FAMILY[kind]
    target, noise = target_and_noise(m, scaled, dependent, limit)
    return db(target / (noise + F.lit(EPS)) + F.lit(EPS))


def sdr_loss(pairs: DataFrame, kind: str, x: str = "enh", y: str = "clean", keep_above: float | None = None, inactive: str | None = None, compat: bool = False) -> DataFrame:
    """(loss): mean of the negated ratios over pairs; the pooled members add up energies over the rows of one ``key`` first.

    With ``keep_above`` only losses above it count, if there are any. Rows flagged ``inactive`` count with their
    residual energy instead. ``compat`` takes the members of COMPAT.
    """
    pooled = member(kind, compat)[3]
    active = pairs.filter(~F.col(inactive)) if inactive else pairs
    sums = active.select("key", from_moments(F.col(x), F.col(y), lambda m: _energies(m, kind, compat)).alias("s")).select("key", "s.t", "s.e")
    if pooled:
        sums = sums.groupBy("key").agg(F.sum("t").alias("t"), F.sum("e").alias("e"))
    losses = sums.select(_negated(F.col("t"), F.col("e")).alias("loss"))
    if keep_above is not None:
        above = F.col("loss") > keep_above
        some = losses.agg(F.coalesce(F.bool_or(above), F.lit(False)).alias("some"))
        losses = losses.crossJoin(F.broadcast(some)).filter(above | ~F.col("some")).select("loss")
    if inactive:
        losses = losses.unionByName(pairs.filter(F.col(inactive)).select(inactive_loss(F.col(x), F.col(y)).alias("loss")))
    return losses.agg(F.avg("loss").alias("loss"))


def _energies(m: Moments, kind: str, compat: bool = False) -> Column:
    scaled, dependent, limit, _ = member(kind, compat)
    return F.struct(*(e.alias(n) for e, n in zip(target_and_noise(m, scaled, dependent, limit), ("t", "e"))))


def _negated(target: Column, noise: Column) -> Column:
    return -db(target / (noise + F.lit(EPS)) + F.lit(EPS))


def family_losses(pairs: DataFrame, x: str = "enh", y: str = "clean", compat: bool = False) -> DataFrame:
    """(kind, loss) for all members of the family: the waveforms are read once, their moments serve every member.

    Rows are summed by ``key`` for the pooled members, and these sums carry the means of the others along.
    No pairs give a null for each member. ``compat`` takes the members of COMPAT.
    """
    every = lambda m: F.struct(*(_energies(m, k, compat).alias(k) for k in FAMILY))
    sums = pairs.select("key", from_moments(F.col(x), F.col(y), every).alias("s"))
    by_key, over_all = [], []
    for kind, (*_, pooled) in (COMPAT if compat else FAMILY).items():
        t, e = F.col(f"s.{kind}.t"), F.col(f"s.{kind}.e")
        if pooled:
            by_key += [F.sum(t).alias(f"{kind}_t"), F.sum(e).alias(f"{kind}_e")]
            over_all.append(F.avg(_negated(F.col(f"{kind}_t"), F.col(f"{kind}_e"))).alias(kind))
        else:
            loss = _negated(t, e)
            by_key += [F.sum(loss).alias(f"{kind}_sum"), F.count(loss).alias(f"{kind}_n")]
            over_all.append((F.sum(f"{kind}_sum") / F.nullif(F.sum(f"{kind}_n"), F.lit(0))).alias(kind))
    return sums.groupBy("key").agg(*by_key).agg(*over_all).unpivot([], list(FAMILY), "kind", "loss")


def inactive_loss(x: Column, y: Column) -> Column:
    """Residual energy of the output where the target is silent, in dB."""
    return from_moments(x, y, lambda m: db(m.xx + F.lit(0.01) * m.yy + F.lit(EPS)))


def attenuation(x: Column, noisy: Column, mask: Column) -> Column:
    """How much less energy the output has than the input, in dB, over samples with a mask of 0."""
    off = lambda w: total(F.zip_with(w, mask, lambda v, m: F.when(m == 0, v * v).otherwise(0.0)))
    return db(off(noisy) / off(x))


def noise_reduction(x: Column, noisy: Column) -> Column:
    """Energy of the output over that of the input in dB, both at their peaks' level."""
    a, b = comparable(x, noisy)
    return from_moments(a, b, lambda m: db(m.xx / m.yy), zero_mean=False)


def with_improvement(pairs: DataFrame, enh: str = "enh", clean: str = "clean", noisy: str = "noisy") -> DataFrame:
    """``pairs`` with sisnr, sisnri and two flags: nsr where the enhanced is worse than the noisy one without being good, nsr_neg where it is below 0 dB too.

    A silent waveform has no score; its row has nulls and ``unscored``.
    """
    score = lambda w: let(F.struct(*(c.alias(n) for c, n in zip(comparable(F.col(w), F.col(clean)), "xy"))), lambda p: from_moments(p["x"], p["y"], si_snr))
    out = pairs.withColumn("sisnr", score(enh))
    out = out.withColumn("sisnri", F.col("sisnr") - score(noisy))
    worse = (F.col("sisnri") < 0) & (F.col("sisnr") < 30)
    return out.withColumns({"nsr": worse.cast("int"), "nsr_neg": (worse & (F.col("sisnr") < 0)).cast("int"), "unscored": F.col("sisnri").isNull()})


def summary(scores: DataFrame, columns: list[str]) -> DataFrame:
    """One row: means of the columns and the number of rows."""
    return scores.agg(*(F.avg(c).alias(c) for c in columns), F.count("*").alias("n"))


def confusion(rows: DataFrame, truth: str = "label", found: str = "value") -> DataFrame:
    """(key, tp, fp, fn, tn, accuracy, precision, recall, f1) from rows (key, label, value) of 0 and 1."""
    t, f = F.col(truth) == 1, F.col(found) == 1
    counted = rows.groupBy("key").agg(*(F.count_if(c).cast("double").alias(n) for n, c in (("tp", t & f), ("fp", ~t & f), ("fn", t & ~f), ("tn", ~t & ~f))))
    tiny = F.lit(1e-7)
    scored = counted.withColumns({"accuracy": (F.col("tp") + F.col("tn")) / (F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")), "precision": F.col("tp") / (F.col("tp") + F.col("fp") + tiny), "recall": F.col("tp") / (F.col("tp") + F.col("fn") + tiny)})
    f1 = 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall") + tiny)
    return scored.withColumn("f1", F.greatest(tiny, F.least(1 - tiny, f1)))


def soft_f1_loss(rows: DataFrame, truth: str = "label", p: str = "p") -> DataFrame:
    """(loss): 1 - F1 over all rows, with probabilities in place of decisions."""
    s = rows.agg(F.sum(F.col(truth) * F.col(p)).alias("tp"), F.sum((1 - F.col(truth)) * F.col(p)).alias("fp"), F.sum(F.col(truth) * (1 - F.col(p))).alias("fn"))
    tiny = F.lit(1e-10)
    precision, recall = F.col("tp") / (F.col("tp") + F.col("fp") + tiny), F.col("tp") / (F.col("tp") + F.col("fn") + tiny)
    return s.select((1 - 2 * precision * recall / (precision + recall + tiny)).alias("loss"))


def epochs(log: DataFrame, patience: int = 25) -> DataFrame:
    """(epoch, loss, best, best_epoch, stop) from step losses (epoch, loss): the mean by epoch, the best so far (ties move on), and whether training stops here.

    The steps are summed first; the windows run over one row for each epoch.
    """
    from pyspark.sql import Window

    w = Window.orderBy("epoch")
    by_epoch = log.groupBy("epoch").agg(F.avg("loss").alias("loss"))
    best = by_epoch.withColumn("best", F.min("loss").over(w))
    seen = best.withColumn("best_epoch", F.last(F.when(F.col("loss") <= F.col("best"), F.col("epoch")), ignorenulls=True).over(w))
    return seen.withColumn("stop", F.col("epoch") >= F.col("best_epoch") + patience)


METRICS = {k: (lambda x, y, k=k: from_moments(x, y, lambda m: sdr(m, k))) for k in ("sisnr", "sdsdr", "sdr", "tsdr")}


def metric(name: str, user: dict | None = None):
    """A function of two array columns by name; sums such as "sisnr+sdr" are allowed, and names in ``user`` come first."""
    known = METRICS | (user or {})
    parts = [known[n.strip()] for n in name.split("+")]

    def added(x: Column, y: Column) -> Column:
        out = parts[0](x, y)
        for f in parts[1:]:
            out = out + f(x, y)
        return out

    return added
