"""Hierarchical Beta model of scores, and what is read off its posterior.

Posterior draws are a long table: dimension, chain, draw, param, idx, value. Summaries, contrasts and diagnostics are joins,
windows and aggregations on it; only sampling itself runs outside SQL, one (dimension, chain) per task.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.rules import bayes_factor_wording
from textloom.functions.vectors import inverse_logit, scale_fraction, squeeze

DRAWS = "dimension string, chain int, draw int, param string, idx string, value double"


def prepare(scores: DataFrame, low: float, high: float) -> DataFrame:
    """Scores as y in (0, 1) per dimension: fraction of the scale, squeezed by the number of observations. Null scores drop."""
    known = scores.where(F.col("score").isNotNull())
    n = known.groupBy("dimension").agg(F.count(F.lit(1)).alias("_n"))
    return known.join(F.broadcast(n), "dimension").withColumn("y", squeeze(scale_fraction(F.col("score"), low, high), F.col("_n"))).drop("_n")


def sample(data: DataFrame, chains: int = 4, draws: int = 500, tune: int = 500, seed: int = 42, offsets: bool = False, with_groups: bool = True) -> DataFrame:
    """Draws of theta (entity), group, sigma_entity, sigma_group and kappa for y ~ Beta(mu kappa, (1 - mu) kappa), logit mu =
    theta[entity] + group[g], and with `offsets` + offset[entity, participant], whose spread is sigma_participant. Random-walk
    Metropolis within Gibbs, steps tuned during warm-up. Observations shrink to counts and sums of log y and log(1 - y) per
    entity and group, or participant, first, so a chain holds cells and not rows. Without groups their effect stays 0."""
    return _run_chains(data, chains, draws, tune, seed, offsets, with_groups, False)


def model_fit(data: DataFrame, chains: int = 4, draws: int = 500, tune: int = 500, seed: int = 42, offsets: bool = False, with_groups: bool = True) -> DataFrame:
    """Per dimension how well the model foretells a cell (WAIC): elpd, the effective number of parameters p, and the standard
    error of elpd over cells; each the mean over the chains. Models are compared by the difference of elpd."""
    cells = _run_chains(data, chains, draws, tune, seed, offsets, with_groups, True)
    own = F.max(F.when(F.col("param") == "elpd", F.col("value"))).alias("elpd"), F.max(F.when(F.col("param") == "p", F.col("value"))).alias("p")
    each = cells.groupBy("dimension", "chain", "idx").agg(*own)
    per = each.groupBy("dimension", "chain").agg(F.sum("elpd").alias("elpd"), F.sum("p").alias("p"), (F.sqrt(F.count(F.lit(1))) * F.coalesce(F.stddev_samp("elpd"), F.lit(0.0))).alias("se"))
    return per.groupBy("dimension").agg(F.avg("elpd").alias("elpd"), F.avg("p").alias("p"), F.avg("se").alias("se"))


def compare_models(data: DataFrame, **options) -> DataFrame:
    """Per dimension the elpd with and without group effects and their difference; above 0 speaks for the groups."""
    full = model_fit(data, with_groups=True, **options).select("dimension", F.col("elpd").alias("elpd_full"), F.col("se").alias("se_full"))
    reduced = model_fit(data, with_groups=False, **options).select("dimension", F.col("elpd").alias("elpd_reduced"))
    return full.join(reduced, "dimension").withColumn("difference", F.col("elpd_full") - F.col("elpd_reduced"))


def _run_chains(data: DataFrame, chains: int, draws: int, tune: int, seed: int, offsets: bool, with_groups: bool, fit: bool) -> DataFrame:
    import numpy as np

    who = F.col("participant").cast("string") if offsets else F.lit("")
    cells = data.groupBy("dimension", "entity", F.coalesce("group", F.lit("all")).alias("group"), who.alias("participant")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.log("y")).alias("a"), F.sum(F.log(1 - F.col("y"))).alias("b")
    )
    each = cells.join(F.broadcast(data.sparkSession.range(chains).select(F.col("id").cast("int").alias("chain"))))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        dimension, chain = pdf["dimension"].iloc[0], int(pdf["chain"].iloc[0])
        pdf = pdf.sort_values(["entity", "group", "participant"])
        e, entities = pd.factorize(pdf["entity"])
        g, groups = pd.factorize(pdf["group"])
        n, a, b = (pdf[c].to_numpy(float) for c in ("n", "a", "b"))
        rng = np.random.default_rng([seed, chain, sum(map(ord, dimension))])
        lgamma = np.vectorize(math.lgamma)
        theta, effect, offset, kappa, s_e, s_g, s_p = rng.normal(0, 0.3, len(entities)), np.zeros(len(groups)), np.zeros(len(n)), 10.0, 1.0, 0.5, 0.5
        step = {"theta": np.full(len(entities), 0.3), "group": np.full(len(groups), 0.3), "offset": np.full(len(n), 0.3), "kappa": 0.3, "s_e": 0.3, "s_g": 0.3, "s_p": 0.3}
        foretold = np.zeros((draws if fit else 0, len(n)))

        def likelihood(theta, effect, kappa, off=None):
            mu = np.clip(1 / (1 + np.exp(-(theta[e] + effect[g] + (offset if off is None else off)))), 1e-6, 1 - 1e-6)
            return n * (math.lgamma(kappa) - lgamma(mu * kappa) - lgamma((1 - mu) * kappa)) + (mu * kappa - 1) * a + ((1 - mu) * kappa - 1) * b

        def adapt(s, accepted, i):
            return s * np.exp((accepted - 0.4) / (1 + i) ** 0.6) if i < tune else s

        out, now = [], likelihood(theta, effect, kappa)
        for i in range(tune + draws):
            new = theta + step["theta"] * rng.standard_normal(len(theta))
            trial = likelihood(new, effect, kappa)
            gain = np.bincount(e, trial - now, len(theta)) - (new**2 - theta**2) / (2 * s_e**2)
            ok = np.log(rng.random(len(theta))) < gain
            theta, step["theta"] = np.where(ok, new, theta), adapt(step["theta"], ok, i)
            now = likelihood(theta, effect, kappa)
            if offsets:
                new = offset + step["offset"] * rng.standard_normal(len(offset))
                trial = likelihood(theta, effect, kappa, new)
                ok = np.log(rng.random(len(offset))) < trial - now - (new**2 - offset**2) / (2 * s_p**2)
                offset, step["offset"] = np.where(ok, new, offset), adapt(step["offset"], ok, i)
                now = likelihood(theta, effect, kappa)
            if len(groups) > 1 and with_groups:
                new = effect + step["group"] * rng.standard_normal(len(effect))
                trial = likelihood(theta, new, kappa)
                gain = np.bincount(g, trial - now, len(effect)) - (new**2 - effect**2) / (2 * s_g**2)
                ok = np.log(rng.random(len(effect))) < gain
                effect, step["group"] = np.where(ok, new, effect), adapt(step["group"], ok, i)
                now = likelihood(theta, effect, kappa)
            new = kappa * math.exp(step["kappa"] * rng.standard_normal())
            trial = likelihood(theta, effect, new)
            prior = lambda k: 2 * math.log(k) - 0.1 * k
            ok = math.log(rng.random()) < trial.sum() - now.sum() + prior(new) - prior(kappa)
            kappa, now, step["kappa"] = (new, trial, adapt(step["kappa"], ok, i)) if ok else (kappa, now, adapt(step["kappa"], ok, i))
            for name, x in (("s_e", theta), ("s_g", effect), ("s_p", offset))[: 3 if offsets else 2]:
                old = {"s_e": s_e, "s_g": s_g, "s_p": s_p}[name]
                new = old * math.exp(step[name] * rng.standard_normal())
                p = lambda s, x=x: -len(x) * math.log(s) - (x**2).sum() / (2 * s * s) - s * s / 2 + math.log(s)
                ok = math.log(rng.random()) < p(new) - p(old)
                step[name] = adapt(step[name], ok, i)
                if ok:
                    s_e, s_g, s_p = (new if name == k else v for k, v in (("s_e", s_e), ("s_g", s_g), ("s_p", s_p)))
            if i >= tune and fit:
                foretold[i - tune] = now
            elif i >= tune:
                d = i - tune
                out += [(dimension, chain, d, "theta", str(k), float(v)) for k, v in zip(entities, theta, strict=True)]
                out += [(dimension, chain, d, "group", str(k), float(v)) for k, v in zip(groups, effect, strict=True)]
                out += [(dimension, chain, d, p, "", float(v)) for p, v in (("kappa", kappa), ("sigma_entity", s_e), ("sigma_group", s_g), ("sigma_participant", s_p))[: 4 if offsets else 3]]
        if fit:
            top = foretold.max(0)
            p = foretold.var(0, ddof=1)
            elpd = top + np.log(np.exp(foretold - top).mean(0)) - p
            out = [(dimension, chain, 0, name, str(k), float(v)) for name, x in (("elpd", elpd), ("p", p)) for k, v in enumerate(x)]
        return pd.DataFrame(out, columns=["dimension", "chain", "draw", "param", "idx", "value"])

    return each.groupBy("dimension", "chain").applyInPandas(run, DRAWS)


PARAM = ["dimension", "param", "idx"]


def rhat(draws: DataFrame) -> DataFrame:
    """Per parameter: Gelman and Rubin's R-hat, from means and variances of the chains."""
    per = draws.groupBy(*PARAM, "chain").agg(F.avg("value").alias("m"), F.var_samp("value").alias("v"), F.count(F.lit(1)).alias("n"))
    s = per.groupBy(*PARAM).agg(F.avg("v").alias("w"), F.coalesce(F.var_samp("m"), F.lit(0.0)).alias("b"), F.avg("n").alias("n"))
    total = (F.col("n") - 1) / F.col("n") * F.col("w") + F.col("b")
    return s.select(*PARAM, F.when(F.col("w") > 0, F.sqrt(total / F.col("w"))).otherwise(1.0).alias("rhat"))


def ess(draws: DataFrame) -> DataFrame:
    """Per parameter: effective sample size, autocorrelations summed over Geyer's initial positive pairs. A parameter's draws
    are bounded by chains x draws."""
    import numpy as np

    def size(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.pivot(index="draw", columns="chain", values="value").to_numpy(float)
        n, m = x.shape
        y = x - x.mean(0)
        f = np.fft.rfft(y, 2 * n, axis=0)
        acov = np.fft.irfft(f * f.conj(), axis=0)[:n].mean(1) / n
        var = acov[0] * n / (n - 1) * (n - 1) / n + (x.mean(0).var(ddof=1) if m > 1 else 0)
        if not var:
            value = float(n * m)
        else:
            rho = 1 - (acov[0] - acov) / var
            total, t = 1.0, 1
            while t + 1 < n and rho[t] + rho[t + 1] > 0:
                total += 2 * (rho[t] + rho[t + 1])
                t += 2
            value = n * m / total
        return pd.DataFrame([{**{k: pdf[k].iloc[0] for k in PARAM}, "ess": float(min(value, n * m))}])

    return draws.groupBy(*PARAM).applyInPandas(size, "dimension string, param string, idx string, ess double")


def diagnostics(draws: DataFrame) -> DataFrame:
    """Per dimension: max_rhat, min_ess, status: converged (R-hat under 1.01, ESS 1,000), marginal (ESS 400) or not."""
    worst = rhat(draws).join(ess(draws), PARAM).groupBy("dimension").agg(F.max("rhat").alias("max_rhat"), F.min("ess").alias("min_ess"))
    calm = F.col("max_rhat") < 1.01
    return worst.withColumn("status", F.when(calm & (F.col("min_ess") >= 1000), "converged").when(calm & (F.col("min_ess") >= 400), "marginal").otherwise("not converged"))


def hdi(draws: DataFrame, keys: Sequence[str] = tuple(PARAM), mass: float = 0.94) -> DataFrame:
    """Per key: mean, sd and the narrowest interval that holds the mass; the lower one on ties."""
    order = Window.partitionBy(*keys).orderBy("value")
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    ranked = draws.withColumns({"_r": F.row_number().over(order), "_n": n}).withColumn("_k", F.floor(F.col("_n") * mass).cast("int"))
    upper = ranked.select(*keys, (F.col("_r") - F.col("_k")).alias("_r"), F.col("value").alias("_high"))
    spans = ranked.join(upper, [*keys, "_r"]).withColumn("_width", F.col("_high") - F.col("value"))
    narrow = spans.groupBy(*keys).agg(F.min_by(F.struct(F.col("value").alias("low"), F.col("_high").alias("high")), F.struct("_width", "value")).alias("h"))
    moments = draws.groupBy(*keys).agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"))
    return moments.join(narrow, list(keys)).select(*keys, "mean", "sd", F.col("h.low").alias("hdi_low"), F.col("h.high").alias("hdi_high"))


def contrasts(draws: DataFrame, param: str = "group", rope: float = 0.1) -> DataFrame:
    """Per dimension and pair of indices a < b: mean of b - a, share of draws above 0, within the region of practical
    equivalence, and the interval's 3 % and 97 % points."""
    v = draws.where(F.col("param") == param).select("dimension", "chain", "draw", "idx", "value")
    both = v.toDF("dimension", "chain", "draw", "a", "va").join(v.toDF("dimension", "chain", "draw", "b", "vb"), ["dimension", "chain", "draw"]).where("a < b")
    d = F.col("vb") - F.col("va")
    return both.groupBy("dimension", "a", "b").agg(
        F.avg(d).alias("mean"), F.avg((d > 0).cast("double")).alias("p_positive"), F.avg((F.abs(d) <= rope).cast("double")).alias("p_rope"),
        F.percentile(d, F.lit(0.03)).alias("low"), F.percentile(d, F.lit(0.97)).alias("high"),
    )


def marginal_contrasts(draws: DataFrame, low: float, high: float, rope: float) -> DataFrame:
    """Contrasts of group means on the scale itself, averaged over the entities draw by draw."""
    theta = draws.where("param = 'theta'").select("dimension", "chain", "draw", F.col("value").alias("t"))
    group = draws.where("param = 'group'").select("dimension", "chain", "draw", "idx", F.col("value").alias("g"))
    at = theta.join(group, ["dimension", "chain", "draw"]).groupBy("dimension", "chain", "draw", "idx").agg(F.avg(inverse_logit(F.col("t") + F.col("g"), low, high)).alias("value"))
    return contrasts(at.withColumn("param", F.lit("group")), "group", rope)


def icc(draws: DataFrame) -> DataFrame:
    """Per dimension: mean shares of variance of entities, groups and runs (4 / (kappa + 1)); they sum to 1."""
    pick = lambda p: F.max(F.when(F.col("param") == p, F.col("value")))
    per = draws.groupBy("dimension", "chain", "draw").agg(F.pow(pick("sigma_entity"), 2).alias("e"), F.pow(pick("sigma_group"), 2).alias("g"), (4 / (pick("kappa") + 1)).alias("r"))
    total = F.col("e") + F.col("g") + F.col("r")
    return per.groupBy("dimension").agg(*[F.avg(F.col(c) / total).alias(n) for c, n in (("e", "entity_share"), ("g", "group_share"), ("r", "run_share"))])


def shrinkage(raw: DataFrame, posterior: DataFrame) -> DataFrame:
    """Per dimension and entity: how far the posterior mean moved towards the grand mean, in percent within 0..100; 0 where the
    raw mean lies within 1 of it. raw: dimension, entity, raw_mean; posterior: dimension, entity, mean."""
    grand = raw.groupBy("dimension").agg(F.avg("raw_mean").alias("grand"))
    rows = raw.join(posterior, ["dimension", "entity"]).join(F.broadcast(grand), "dimension")
    gap = F.abs(F.col("raw_mean") - F.col("grand"))
    moved = 100 * (1 - F.abs(F.col("mean") - F.col("grand")) / F.nullif(gap, F.lit(0.0)))
    return rows.select("dimension", "entity", "raw_mean", "mean", "grand", F.when(gap <= 1, 0.0).otherwise(F.least(F.greatest(moved, F.lit(0.0)), F.lit(100.0))).alias("shrinkage_pct"))


def bayes_factor(differences: DataFrame, keys: Sequence[str], prior_sd: float) -> DataFrame:
    """Per key the Savage-Dickey ratio for a difference: prior density at 0 (normal) over posterior density at 0 (Gaussian
    kernel, Scott's bandwidth), and its wording. differences: keys, value."""
    s = differences.groupBy(*keys).agg((F.stddev_samp("value") * F.pow(F.count(F.lit(1)), -0.2)).alias("h"))
    z = F.col("value") / F.col("h")
    root = math.sqrt(2 * math.pi)
    dens = differences.join(s, list(keys)).where("h > 0").groupBy(*keys).agg(F.avg(F.exp(-z * z / 2) / (F.col("h") * root)).alias("posterior"))
    bf = F.lit(1 / (prior_sd * root)) / F.nullif("posterior", F.lit(0.0))
    return dens.select(*keys, F.coalesce(bf, F.lit(float("inf"))).alias("bf10")).withColumn("interpretation", bayes_factor_wording(F.col("bf10")))
