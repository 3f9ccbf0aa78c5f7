"""Gaussian mixtures of many series at once, from exact histograms.

A series is a table (key, x, n): each distinct value of a key once, with its count or weight. Every step of clustering or fitting is a join of the
histogram, in chunks of values (``chunks``), with a small table of parameters (a row for each key), sums of each chunk and component in numpy, and a grouped sum
of these for each key and component, so a key with a third of all values is spread over all tasks like any other, and nothing is sampled. What is done for each key alone sees a row for each component.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewell.functions.special import digamma, lgamma
from tracewell.operators import chunks
from tracewell.operators.chunks import EDGE, packed
from tracewell.operators.running import running
from tracewell.operators.storage import bounded, fits, written

TINY = 1e-300
#: Whether anything still changes is looked up after each so many rounds.
EVERY = 5


def histogram(values: DataFrame, column: str, *key: str) -> DataFrame:
    """(key, x, n) of finite values; null, NaN and infinite ones are left out."""
    x = F.col(column).cast("double")
    return written(values.where(x.isNotNull() & (F.abs(x) < float("inf"))).groupBy(*key, x.alias("x")).agg(F.count(F.lit(1)).cast("double").alias("n")), "histogram")


def summary(hist: DataFrame, *key: str) -> DataFrame:
    """(key, total, distinct, mean, var): var is the population variance."""
    first = hist.groupBy(*key).agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("distinct"), (F.sum(F.col("n") * F.col("x")) / F.sum("n")).alias("mean"))
    first = written(first, "means")
    square = F.col("n") * (F.col("x") - F.col("mean")) * (F.col("x") - F.col("mean"))
    return written(hist.join(bounded(first), list(key)).groupBy(*key, "total", "distinct", "mean").agg((F.sum(square) / F.col("total")).alias("var")), "summary")


def centred(hist: DataFrame, stats: DataFrame, *key: str) -> DataFrame:
    """hist with x less the mean of its key: sums of squares then lose no digits."""
    return written(hist.join(bounded(stats.select(*key, "mean")), list(key)).select(*key, (F.col("x") - F.col("mean")).alias("x"), "n"), "centred")


def quantiles(hist: DataFrame, shares: dict[str, float], *key: str) -> DataFrame:
    """(key, one column for each share): quantiles by linear interpolation between neighbouring ranks, of whole counts. Ranks are running sums in two levels: no task sees a whole key."""
    total = written(hist.groupBy(*key).agg(F.sum("n").alias("total")), "totals")
    placed = running(hist.select(*key, "x", "n"), list(key), [*key, "x"], upto=F.col("n")).join(bounded(total), list(key))
    at = {name: (F.col("total") - 1) * p for name, p in shares.items()}
    covers = lambda rank: (F.col("upto") - F.col("n") <= rank) & (rank < F.col("upto"))
    aggs = []
    for name, h in at.items():
        aggs += [F.max(F.when(covers(F.floor(h)), F.col("x"))).alias(f"__{name}_low"), F.max(F.when(covers(F.ceil(h)), F.col("x"))).alias(f"__{name}_high"), F.max(h - F.floor(h)).alias(f"__{name}_part")]
    found = placed.groupBy(*key).agg(*aggs)
    return found.select(*key, *((F.col(f"__{n}_low") + (F.col(f"__{n}_high") - F.col(f"__{n}_low")) * F.col(f"__{n}_part")).alias(n) for n in shares))


def _folds(most: int) -> tuple[list[Column], Column]:
    """Sums of all cells over chunks, and from these for each number of clusters k its parts (mean, mean square deviation and weight of each cell that has values, by mean) and inertia."""
    sums = [F.expr(f"sum(sums[{3 * i + j}])").alias(f"s{j}_{i}") for i in range(sum(k + 1 for k in range(1, most + 1))) for j in range(3)]
    sets = []
    for k, own in chunks.places(most):
        cells = range(own.start, own.stop)
        parts = ", ".join(f"CASE WHEN s0_{i} > 0 THEN named_struct('mean', s1_{i} / s0_{i}, 'var', greatest(s2_{i} / s0_{i} - s1_{i} / s0_{i} * (s1_{i} / s0_{i}), 0D), 'weight', s0_{i}) END" for i in cells)
        inertia = " + ".join(f"CASE WHEN s0_{i} > 0 THEN greatest(s2_{i} - s1_{i} * (s1_{i} / s0_{i}), 0D) ELSE 0D END" for i in cells)
        sets.append(f"named_struct('k', {k}, 'parts', array_sort(array_compact(array({parts}))), 'inertia', {inertia})")
    return sums, F.expr(f"array({', '.join(sets)})")


def _clusters(rows: DataFrame, folds: tuple[list[Column], Column], *key: str) -> DataFrame:
    """(key, sets, centres): the sets of ``_folds`` that have values, and the means of all, with infinite ones where a cell has no values."""
    sums, sets = folds
    each = rows.groupBy(*key).agg(*sums).select(*key, sets.alias("sets"))
    means = F.expr("flatten(transform(sets, s -> concat(s.parts.mean, array_repeat(double('Infinity'), s.k + 1 - size(s.parts)))))")
    return written(each.select(*key, F.expr("filter(sets, s -> size(s.parts) > 0)").alias("sets"), means.alias("centres")), "clusters")


def kmeans(packs: DataFrame, most: int, *key: str, rounds: int = 50) -> DataFrame:
    """(key, k, parts, inertia) for k = 1 .. most, but no more than a key has distinct values: Lloyd's clusters, from slices of equal weight on. packs are the chunks of a centred histogram. All keys and numbers of clusters go together; rounds end when no centre moves."""
    total = written(packs.groupBy(*key).agg(F.max(F.element_at("uptos", -1)).alias("total"), F.sum(F.size("xs")).alias("distinct")), "totals")
    small, folds = fits(total), _folds(most)
    state = _clusters(chunks.summed(packs.join(bounded(total, small), list(key)), lambda p: chunks.sliced(p, most), "sums array<double>", *key), folds, *key)
    small = small and fits(state)  # a row for each key, in every round
    for turn in range(1, rounds + 1):
        near = packs.select(*key, "xs", "ns").join(bounded(state.select(*key, "centres"), small), list(key))
        new = _clusters(chunks.summed(near, lambda p: chunks.nearest(p, most), "sums array<double>", *key), folds, *key)
        moved = new.select(*key, "centres").join(state.select(*key, F.col("centres").alias("__old")), list(key)).where("centres != __old")
        done = turn % EVERY == 0 and turn < rounds and moved.isEmpty()
        state = new
        if done:
            break
    return state.select(*key, F.inline("sets"))


def elbow(clusters: DataFrame, *key: str) -> DataFrame:
    """(key, parts): those with the number of clusters after which the inertia falls most, the smallest of equal ones; a single cluster if there is no other."""
    order = W.partitionBy(*key).orderBy("k")  # a row for each number of clusters
    falls = clusters.withColumn("drop", F.coalesce(F.lag("inertia").over(order) - F.col("inertia"), F.lit(-1.0)))
    steepest = falls.withColumn("__most", F.max("drop").over(W.partitionBy(*key))).where(F.col("drop") >= F.col("__most") - 1e-9 * F.abs("__most"))
    return steepest.groupBy(*key).agg(F.min_by("parts", "k").alias("parts"))


def expected(packs: DataFrame, model: DataFrame, *key: str, small: bool | None = None) -> DataFrame:
    """(key, k, s0, s1, s2, entropy, loglik): for each component, with log density base - (x - mean)^2 / (2 var), the sums of its responsibilities, times x and x^2, and their entropy. loglik is the key's, in its first component."""
    lists = model.select(*key, *(F.col(f"parts.{c}").alias(c) for c in ("base", "mean", "var")))
    names = ("s0", "s1", "s2", "entropy", "loglik")
    each = chunks.summed(packs.select(*key, "xs", "ns").join(bounded(lists, small), list(key)), chunks.shared, "k int, " + ", ".join(f"{c} double" for c in names), *key)
    return each.groupBy(*key, "k").agg(*(F.sum(c).alias(c) for c in names))


def _model(rows: DataFrame, *key: str, **fields: Column) -> DataFrame:
    """(key, parts) of rows (key, k): the components in order, a row for each key."""
    parts = F.array_sort(F.collect_list(F.struct("k", *(c.alias(name) for name, c in fields.items()))))
    return written(rows.groupBy(*key).agg(parts.alias("parts")), "model")


def _floor(var: Column) -> Column:
    return 1e-10 * F.greatest(F.lit(1.0), var) + 1e-12


def _base(mean: Column, var: Column, weight: Column) -> Column:
    return F.log(F.greatest(weight, F.lit(TINY))) - 0.5 * F.log(2 * math.pi * var)


def em(packs: DataFrame, stats: DataFrame, start: DataFrame, *key: str, rounds: int = 50, tolerance: float = 1e-9) -> DataFrame:
    """(key, n, mixture, loglik): maximum likelihood from the clusters of start on. packs are the chunks of a centred histogram; means are not centred, weights sum to 1, components are by mean. loglik is that of the parameters before the last round. Rounds end when no key's log-likelihood rises by more than ``tolerance`` of itself."""
    small = fits(stats)
    own = bounded(stats, small)
    total = F.aggregate("parts", F.lit(0.0), lambda s, c: s + c["weight"])
    flat = start.withColumn("__sum", total).join(own.select(*key, "var"), list(key)).select(*key, F.col("var").alias("__var"), "__sum", F.posexplode("parts").alias("k", "c"))
    rows = flat.select(*key, "k", F.col("c.mean").alias("mean"), F.greatest("c.var", _floor(F.col("__var"))).alias("var"), (F.col("c.weight") / F.col("__sum")).alias("weight"))
    fields = {"base": _base(F.col("mean"), F.col("var"), F.col("weight")), "mean": F.col("mean"), "var": F.col("var"), "weight": F.col("weight"), "loglik": F.lit(None).cast("double")}
    model = _model(rows, *key, **fields)
    for turn in range(1, rounds + 1):
        sums = expected(packs, model, *key, small=small).join(own.select(*key, F.col("var").alias("__var"), "total"), list(key))
        s0 = F.greatest("s0", F.lit(TINY))
        mean = F.col("s1") / s0
        rows = sums.select(*key, "k", mean.alias("mean"), F.greatest(F.col("s2") / s0 - mean * mean, _floor(F.col("__var"))).alias("var"), (F.col("s0") / F.col("total")).alias("weight"), F.col("loglik").alias("__ll"))
        new = _model(rows, *key, **fields | {"loglik": F.col("__ll")})
        last = model.select(*key, F.col("parts")[0]["loglik"].alias("__old"))
        rise = F.col("parts")[0]["loglik"] - F.col("__old")
        moved = new.join(last, list(key)).where(F.col("__old").isNull() | (F.abs(rise) > tolerance * F.abs("__old")))
        done = turn % EVERY == 0 and turn < rounds and moved.isEmpty()
        model = new
        if done:
            break
    parts = F.transform("parts", lambda c: F.struct((c["mean"] + F.col("mean")).alias("mean"), c["var"].alias("var"), c["weight"].alias("weight")))
    return model.join(own.select(*key, "mean", F.col("total").alias("n")), list(key)).select(*key, "n", F.array_sort(parts).alias("mixture"), F.col("parts")[0]["loglik"].alias("loglik"))


def mixtures(values: DataFrame, column: str, *key: str, most: int = 4, cluster_rounds: int = 50, rounds: int = 50, tolerance: float = 1e-9) -> DataFrame:
    """(key, n, mixture, loglik): a mixture for each key with the elbow's number of components. A key with one value, or equal ones, has one component of almost no variance; an empty table gives an empty result."""
    hist = histogram(values, column, *key)
    stats = summary(hist, *key)
    packs = packed(centred(hist, stats, *key), *key)
    return em(packs, stats, elbow(kmeans(packs, most, *key, rounds=cluster_rounds), *key), *key, rounds=rounds, tolerance=tolerance)


def variational(hist: DataFrame, components: int, *key: str, rounds: int = 100, tolerance: float = 1e-3, concentration: float | None = None, floor: float = 1e-6) -> DataFrame:
    """(key, n, mixture, bound): mean-field Gaussian mixtures with a Dirichlet process prior on the weights, of keys with at least two values.

    No more components than a key has values; the prior of each stick is ``concentration``, else one over the number of components. Means have
    prior precision 1 and the key's mean, variances one degree of freedom and the key's sample variance. Starts from slices of equal weight. mixture has mean, variance and expected
    weight of each component, in the order of the sticks; bound is the evidence lower bound (up to a constant), and rounds end when no key's moves by ``tolerance``.
    """
    stats = summary(hist, *key).where("total >= 2")
    own = written(stats.select(*key, "mean", "total", F.least(F.lit(float(components)), F.floor("total")).alias("active"), F.greatest(F.col("var") * F.col("total") / F.greatest(F.col("total") - 1, F.lit(1.0)), F.lit(floor)).alias("var0")), "priors")
    prior = F.lit(float(concentration)) if concentration else 1.0 / F.col("active")
    small = fits(own)
    own = bounded(own, small)
    packs = packed(centred(hist, stats, *key), *key)
    values = packs.select(*key, F.inline(F.arrays_zip("xs", "ns", "uptos"))).toDF(*key, "x", "n", "upto")
    placed = values.join(own, list(key))
    label = F.least(F.floor(F.col("active") * (F.col("upto") - F.col("n") / 2) / F.col("total") + EDGE), F.col("active") - 1).cast("int")
    x, n = F.col("x"), F.col("n")
    sums = placed.groupBy(*key, label.alias("k")).agg(F.sum(n).alias("s0"), F.sum(n * x).alias("s1"), F.sum(n * x * x).alias("s2")).withColumn("entropy", F.lit(0.0))
    every = own.select(*key, F.explode(F.sequence(F.lit(0), F.col("active").cast("int") - 1)).alias("k"))
    sums = every.join(sums, [*key, "k"], "left").na.fill(0.0, ["s0", "s1", "s2", "entropy"])  # slices may be empty
    order = W.partitionBy(*key).orderBy("k")  # a row for each component
    before, after = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(1, W.unboundedFollowing)
    eps, model = 10 * 2.220446049250313e-16, None
    total = F.aggregate("parts", F.lit(0.0), lambda s, p: s + p["bound"])
    for turn in range(rounds + 1):
        c = {name: F.col(name) for name in ("s0", "s1", "s2", "entropy", "nk", "xk", "sk", "alpha", "beta", "precision", "dof", "var")}
        rows = sums.join(own, list(key)).withColumn("nk", c["s0"] + eps)
        rows = rows.withColumn("xk", c["s1"] / c["nk"]).withColumn("sk", F.greatest(c["s2"] / c["nk"] - c["xk"] * c["xk"], F.lit(0.0)) + floor)
        rows = rows.withColumn("alpha", 1 + c["nk"]).withColumn("beta", prior + F.coalesce(F.sum("nk").over(after), F.lit(0.0)))
        rows = rows.withColumn("precision", 1 + c["nk"]).withColumn("dof", 1 + c["nk"])
        rows = rows.withColumn("centre", c["nk"] * c["xk"] / c["precision"]).withColumn("var", F.greatest((F.col("var0") + c["nk"] * (c["sk"] + c["xk"] * c["xk"] / c["precision"])) / c["dof"], F.lit(floor)))
        both = digamma(c["alpha"] + c["beta"])
        rows = rows.withColumn("own", digamma(c["alpha"]) - both).withColumn("rest", digamma(c["beta"]) - both)
        rows = rows.withColumn("log_weight", F.col("own") + F.coalesce(F.sum("rest").over(before), F.lit(0.0)))
        rows = rows.withColumn("weight", c["alpha"] / (c["alpha"] + c["beta"]) * F.exp(F.coalesce(F.sum(F.log(c["beta"] / (c["alpha"] + c["beta"]))).over(before), F.lit(0.0))))
        base = F.col("log_weight") - 0.5 * F.log(2 * math.pi * c["var"]) - 0.5 * F.log(c["dof"]) + 0.5 * (math.log(2) + digamma(c["dof"] / 2) - 1 / c["precision"])
        wishart = c["dof"] * (-0.5 * F.log(c["var"]) - 0.5 * F.log(c["dof"])) + c["dof"] * 0.5 * math.log(2) + lgamma(c["dof"] / 2)
        bound = c["entropy"] + wishart + lgamma(c["alpha"]) + lgamma(c["beta"]) - lgamma(c["alpha"] + c["beta"]) - 0.5 * F.log(c["precision"])
        last, model = model, _model(rows, *key, base=base, mean=F.col("centre"), var=c["var"], weight=F.col("weight"), bound=bound)
        if turn and turn % EVERY == 0 and turn < rounds:
            moved = model.select(*key, total.alias("bound")).join(last.select(*key, total.alias("__old")), list(key))
            if moved.where(F.abs(F.col("bound") - F.col("__old")) >= tolerance).isEmpty():
                break
        if turn < rounds:
            sums = expected(packs, model, *key, small=small)
    heavy = F.aggregate("parts", F.lit(0.0), lambda s, p: s + p["weight"])
    found = model.withColumn("__sum", heavy).withColumn("bound", total).join(own.select(*key, "mean", F.col("total").alias("n")), list(key))
    mixture = F.transform("parts", lambda p: F.struct((p["mean"] + F.col("mean")).alias("mean"), p["var"].alias("var"), (p["weight"] / F.col("__sum")).alias("weight")))
    return found.select(*key, "n", mixture.alias("mixture"), "bound")


def truncated(mixture: str, share: float) -> Column:
    """The heaviest components until their weights reach the share, one more than before it, made to sum to 1."""
    heavy = F.array_sort(F.col(mixture), lambda a, b: F.signum(b["weight"] - a["weight"]).cast("int"))
    upto = lambda i: F.aggregate(F.slice(heavy, 1, i), F.lit(0.0), lambda s, c: s + c["weight"])
    kept = F.filter(heavy, lambda c, i: upto(i) < share)
    total = F.aggregate(kept, F.lit(0.0), lambda s, c: s + c["weight"])
    return F.transform(kept, lambda c: F.struct(c["mean"].alias("mean"), c["var"].alias("var"), (c["weight"] / total).alias("weight")))


def density(x: Column, mixture: str = "mixture") -> Column:
    return F.aggregate(mixture, F.lit(0.0), lambda s, c: s + c["weight"] * F.exp(-0.5 * (x - c["mean"]) * (x - c["mean"]) / c["var"]) / F.sqrt(2 * math.pi * c["var"]))


def average_nll(hist: DataFrame, fitted: DataFrame, *key: str) -> DataFrame:
    """(key, nll): mean negative log-likelihood of a key's values under its mixture; keys without a mixture are left out."""
    fitted = bounded(written(fitted.select(*key, "mixture"), "mixtures"))
    nll = -F.log(F.greatest(density(F.col("x")), F.lit(TINY)))
    return hist.join(fitted, list(key)).groupBy(*key).agg((F.sum(F.col("n") * nll) / F.sum("n")).alias("nll"))


def multimodal(fitted: DataFrame, least: float = 0.05) -> DataFrame:
    """Keys with two components of some weight, how many there are, and the entropy of their weights."""
    heavy = F.filter("mixture", lambda c: c["weight"] >= least)
    entropy = -F.aggregate(heavy, F.lit(0.0), lambda s, c: s + c["weight"] * F.log(c["weight"]))
    return fitted.withColumn("components", F.size(heavy)).where("components >= 2").withColumn("entropy", entropy)


def storage(fitted: DataFrame) -> DataFrame:
    """Components kept against times summarised."""
    k = F.size("mixture")
    return fitted.agg(F.count(F.lit(1)).alias("edges"), F.sum("n").alias("times"), F.sum(k).alias("components"), (F.sum(k) / F.sum("n")).alias("ratio"), F.min(k).alias("least"), F.max(k).alias("most"), F.percentile(k, F.lit(0.5)).alias("median"))


def gridded(hist: DataFrame, points: int, padding: float, *key: str) -> DataFrame:
    """(key, g, x, n): the mass of each key dealt to ``points`` grid points between its least value and its greatest, ``padding`` of the range beyond both. Each value goes to its two neighbours by distance (linear binning), which keeps mass and mean; a key without range keeps its value. Points without mass are left out."""
    ends = written(hist.groupBy(*key).agg(F.min("x").alias("low"), F.max("x").alias("high")), "ends")
    wide = F.col("high") > F.col("low")
    start = F.col("low") - padding * (F.col("high") - F.col("low"))
    step = F.when(wide, (F.col("high") - F.col("low")) * (1 + 2 * padding) / (points - 1)).otherwise(1.0)
    rows = hist.join(bounded(ends.select(*key, start.alias("start"), step.alias("step"))), list(key)).withColumn("p", (F.col("x") - F.col("start")) / F.col("step"))
    g = F.least(F.floor("p"), F.lit(points - 2))
    part = F.col("p") - g
    pair = F.array(F.struct(g.cast("int").alias("g"), (F.col("n") * (1 - part)).alias("n")), F.struct((g + 1).cast("int").alias("g"), (F.col("n") * part).alias("n")))
    each = rows.select(*key, "start", "step", F.explode(pair).alias("e")).groupBy(*key, "start", "step", F.col("e.g").alias("g")).agg(F.sum("e.n").alias("n"))
    return each.where("n > 0").select(*key, "g", (F.col("start") + F.col("g") * F.col("step")).alias("x"), "n")


def bandwidth(hist: DataFrame, *key: str, points: int = 128) -> DataFrame:
    """(key, h): Sheather-Jones style. sigma is the lesser of the deviation and the interquartile range / 1.34; the roughness of the second derivative of a pilot density of that width comes from pairs of grid points (mass by linear binning, at most ``points`` a key), plus a hundredth of the variance;
    h = 1.06 sigma n^(-1/5) / roughness^(1/5). Without sigma 1.06 times the deviation takes its place; constant or single values have 1."""
    stats = summary(hist, *key).withColumn("std", F.sqrt("var"))
    q = quantiles(hist, {"low": 0.25, "high": 0.75}, *key)
    sigma = F.least(F.col("std"), (F.col("high") - F.col("low")) / 1.34)
    own = written(stats.join(q, list(key)).select(*key, "total", "var", "std", sigma.alias("sigma")), "widths")
    mass = gridded(hist, points, 0.0, *key).groupBy(*key).agg(F.collect_list(F.struct("x", "n")).alias("grid"))
    s = F.col("sigma") * math.sqrt(2)

    def pair(a: Column, b: Column) -> Column:
        u = (a["x"] - b["x"]) / s
        return a["n"] * b["n"] * (F.pow(u, F.lit(4)) - 6 * u * u + 3) * F.exp(-0.5 * u * u)

    inner = lambda a: F.aggregate("grid", F.lit(0.0), lambda t, b: t + pair(a, b))
    pairs = F.aggregate("grid", F.lit(0.0), lambda t, a: t + inner(a))
    rough = pairs / (math.sqrt(2 * math.pi) * F.pow(s, F.lit(5)) * F.col("total") * F.col("total")) + 0.01 * F.col("var")
    rows = own.join(mass, list(key)).withColumn("rough", F.when(F.col("sigma") > 0, rough))
    shrink = F.pow("total", F.lit(-0.2))
    h = F.when(F.col("rough") > 0, 1.06 * F.col("sigma") * shrink / F.pow("rough", F.lit(0.2))).when(F.col("std") > 0, 1.06 * F.col("std") * shrink).otherwise(1.0)
    return rows.select(*key, h.alias("h"))


def pseudo_points(mixture: DataFrame, points: int, *key: str) -> DataFrame:
    """(key, x, n): Gauss-Hermite points of each component of mixtures (key, n, mixture); their weights sum to n."""
    import numpy as np

    nodes, weights = np.polynomial.hermite.hermgauss(points)
    c = F.col("c")
    at = F.array(*(F.struct((c["mean"] + F.sqrt(2 * c["var"]) * float(z)).alias("x"), (F.col("n") * c["weight"] * float(w / weights.sum())).alias("n")) for z, w in zip(nodes, weights, strict=True)))
    return mixture.select(*key, "n", F.explode("mixture").alias("c")).select(*key, F.explode(at).alias("p")).select(*key, "p.x", "p.n")


def updated(old: DataFrame, values: DataFrame, column: str, *key: str, points: int = 10, most: int = 4, rounds: int = 50, cluster_rounds: int = 50, tolerance: float = 1e-9) -> DataFrame:
    """(key, n, mixture, loglik): mixtures (key, n, mixture) with a batch of new values. An old mixture speaks for its n values by Gauss-Hermite points that keep its moments, each new value for itself; keys without new values keep their mixture, with null as loglik, and new keys get one.

    Old values are not read again, so the work grows with the batch and the number of keys.
    """
    fresh = histogram(values, column, *key)
    touched = written(fresh.select(*key).distinct(), "touched")
    history = old.join(bounded(touched), list(key), "left_semi")
    hist = written(fresh.unionByName(pseudo_points(history, points, *key)).groupBy(*key, "x").agg(F.sum("n").alias("n")), "histogram")
    stats = summary(hist, *key)
    packs = packed(centred(hist, stats, *key), *key)
    fitted = em(packs, stats, elbow(kmeans(packs, most, *key, rounds=cluster_rounds), *key), *key, rounds=rounds, tolerance=tolerance)
    rest = old.join(bounded(touched), list(key), "left_anti").select(*key, F.col("n").cast("double").alias("n"), "mixture", F.lit(None).cast("double").alias("loglik"))
    return fitted.unionByName(rest)
