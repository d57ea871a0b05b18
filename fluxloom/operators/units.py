"""Quantities recorded in different units (problem 4).

Where labels are missing or stale, the unit of a source is inferred from the values alone: on a log scale the same
quantity in different units is one distribution shifted by known conversion factors, so a mixture whose components
share level and spread and differ only by those offsets is fitted, and each source gets the unit of highest posterior.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fluxloom.functions.unit_labels import MOLE_FRACTION, RATE, factor, fraction_unit, rate_unit
from fluxloom.session import broadcast_if_small, cut
from fluxloom.sources.tables import finite, usable


@dataclass(frozen=True)
class ScaleMixture:
    """Components at ``level + log10(1/factor)`` with a common spread, beside a broad component for bad readings."""

    level: float
    spread: float
    weights: dict[str, float]
    bad: float
    factors: dict[str, float]


@dataclass(frozen=True)
class Quantity:
    """A column recorded in unknown units: its name, the values, the units parsed from its labels if it has any."""

    name: str
    value: Column
    label: Column | None = None


def fit_scale_mixtures(df: DataFrame, quantities: list[Quantity], factors: dict[str, float], level: float, per_decade: int = 50, rounds: int = 25) -> dict[str, ScaleMixture]:
    """Fit a mixture per quantity by EM on histograms of log10(value), all from one scan.

    The histograms cover all rows and have at most ``per_decade`` bins per decade of a double's range, so what reaches
    the driver is bounded whatever the table's size. ``level`` (common unit) starts the search: a shift of all
    components by one conversion factor is otherwise not identifiable. An empty table gives the starting values.
    """
    binned = [F.struct(F.lit(q.name).alias("name"), F.floor(F.log10(F.when(usable(q.value, 1e300), q.value)) * per_decade).alias("b")) for q in quantities]
    bins = df.select(F.explode(F.array(*binned)).alias("x")).where(F.col("x.b").isNotNull()).groupBy("x.name", "x.b").agg(F.count("*").alias("n")).collect()
    return {q.name: _fit([(r["b"], r["n"]) for r in bins if r["name"] == q.name], factors, level, per_decade, rounds) for q in quantities}


def _fit(bins: list[tuple[int, int]], factors: dict[str, float], level: float, per_decade: int, rounds: int) -> ScaleMixture:
    units = list(factors)
    off = np.array([-math.log10(factors[u]) for u in units])
    mu, spread, bad = math.log10(level), 0.05, 0.03
    w = np.full(len(units), 1.0 / len(units))
    if bins:
        x = (np.array([b for b, _ in bins], dtype=float) + 0.5) / per_decade
        n = np.array([k for _, k in bins], dtype=float)
        for _ in range(rounds):
            d = x[:, None] - mu - off[None, :]
            core = (1 - bad) * w * np.exp(-0.5 * (d / spread) ** 2) / (spread * math.sqrt(2 * math.pi))
            broad = bad / 40.0
            r = core / (core.sum(1, keepdims=True) + broad)
            m = (n[:, None] * r).sum()
            if m <= 0:
                break
            mu = float((n[:, None] * r * (x[:, None] - off)).sum() / m)
            spread = max(1.0 / per_decade, math.sqrt(float((n[:, None] * r * (x[:, None] - mu - off) ** 2).sum() / m)))
            w = np.maximum((n[:, None] * r).sum(0) / m, 1e-4)
            w /= w.sum()
            bad = min(0.2, max(1e-3, 1 - m / n.sum()))
    return ScaleMixture(mu, spread, dict(zip(units, w.tolist())), bad, factors)


def source_units(df: DataFrame, source: str, quantities: list[Quantity], mixtures: dict[str, ScaleMixture], extra: list[Column] | None = None, label_weight: float = 2.0) -> DataFrame:
    """Per ``source`` and quantity: {name}_unit_true, {name}_posterior and {name}_uncertain, beside aggregates ``extra``.

    Every usable row adds the log-likelihood of its value under each component; a bad reading falls on the heavy tail
    and weighs little. Labels (units already parsed) vote with ``label_weight`` in all, so a stale label loses
    against a handful of values. Sources without a usable value follow their labels, else the commonest unit. One
    aggregation serves all quantities.
    """
    aggs, out = list(extra or []), []
    for q in quantities:
        mix, name = mixtures[q.name], q.name
        x = F.when(usable(q.value), F.log10(q.value))
        for unit, f in mix.factors.items():
            d = F.abs(x - F.lit(mix.level - math.log10(f)))
            core = F.exp(F.lit(-0.5) * (d / mix.spread) ** 2) * ((1 - mix.bad) / mix.spread)
            aggs.append(F.sum(F.log(core + F.exp(-d / 0.4) * mix.bad)).alias(f"_{name}_s_{unit}"))
            if q.label is not None:
                aggs.append(F.count(F.when(q.label == unit, 1)).alias(f"_{name}_v_{unit}"))
        if q.label is not None:
            aggs.append(F.count(q.label).alias(f"_{name}_named"))

        def total(u: str, q: Quantity = q, mix: ScaleMixture = mix) -> Column:
            score = F.coalesce(F.col(f"_{q.name}_s_{u}"), F.lit(0.0)) + math.log(mix.weights[u])
            if q.label is None:
                return score
            named = F.col(f"_{q.name}_named")
            return score + F.when(named > 0, F.col(f"_{q.name}_v_{u}") / named * label_weight).otherwise(0.0)

        best = F.greatest(*[total(u) for u in mix.factors])
        mass = sum((F.exp(total(u) - best) for u in mix.factors), F.lit(0.0))
        pick = F.coalesce(*[F.when(total(u) == best, F.lit(u)) for u in mix.factors])
        out += [pick.alias(f"{name}_unit_true"), (F.lit(1.0) / mass).alias(f"{name}_posterior"), (F.lit(1.0) / mass < 0.99).alias(f"{name}_uncertain")]
    agg = df.groupBy(source).agg(*aggs)
    kept = [c for c in agg.columns[1:] if not c.startswith("_")]
    return agg.select(source, *kept, *out)


def _value_quantity() -> Quantity:
    return Quantity("value", F.col("value"), fraction_unit(F.col("value_unit")))


def obspack_file_units(obs: DataFrame, names: tuple[str, ...] = ("value", "ch4"), level_ppb: float = 1850.0, extra: list[Column] | None = None) -> DataFrame:
    """Unit of ``value`` and of ``ch4`` (those in ``names``) per file, with posteriors, beside aggregates ``extra``.

    One file keeps one unit (also across its redelivered rows), so evidence is pooled per file. ``level_ppb`` is the
    usual level of the gas and only starts the fit. Two scans: the histograms, and the aggregation per file.
    """
    quantities = [q for q in (_value_quantity(), Quantity("ch4", F.col("ch4"))) if q.name in names]
    return source_units(obs, "file_name", quantities, fit_scale_mixtures(obs, quantities, MOLE_FRACTION, level_ppb), extra)


def with_ppb(obs: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """``obs`` with ``ppb`` and ``ch4_ppb`` in ppb (NULL where the number is unusable) and the inferred units."""
    files = obspack_file_units(obs) if files is None else files
    out = obs.join(files, "file_name", "left")
    # dividing by the exact inverse keeps decimal inputs such as 1.9063 ppm closest to 1906.3
    ppb = F.col("value") * factor(F.col("value_unit_true"), MOLE_FRACTION)
    return out.withColumn("ppb", F.when(usable(F.col("value")), ppb)).withColumn(
        "ch4_ppb", finite(F.col("ch4")) * factor(F.col("ch4_unit_true"), MOLE_FRACTION)
    )


def rate_evidence(plumes: DataFrame, level_kg_h: float = 300.0, least: float = 0.99, least_records: int = 20) -> DataFrame:
    """datasource, mixture_unit, mixture_posterior, mixture_uncertain of the records of a source that carry no unit.

    The mixture of rate units is fitted like those of mole fractions, to the records without a unit in label or remarks,
    pooled by source. Rates span decades, so components overlap; a posterior below ``least`` and one that rests on
    fewer than ``least_records`` records are uncertain.
    """
    bare = plumes.where(rate_unit(F.col("rate_unit")).isNull() & rate_unit(F.col("remarks")).isNull()).select("datasource", "emission_rate")
    quantity = [Quantity("rate", finite(F.col("emission_rate")))]
    mix = fit_scale_mixtures(bare, quantity, RATE, level_kg_h)
    per = source_units(bare, "datasource", quantity, mix, extra=[F.count(F.when(F.col("emission_rate") > 0, 1)).alias("rated")])
    return per.select("datasource", F.col("rate_unit_true").alias("mixture_unit"), F.col("rate_posterior").alias("mixture_posterior"), ((F.col("rate_posterior") < least) | (F.col("rated") < least_records)).alias("mixture_uncertain"))


def with_kg_per_h(plumes: DataFrame, sources: DataFrame, evidence: bool = False) -> DataFrame:
    """``plumes`` with ``rate_unit_true``, ``kg_h`` (NULL where no positive rate is given) and ``rate_uncertain``.

    A record's unit is named by its label, else by its remarks, else by its datasource's description: for plumes these
    are right. Where none of them names one, and with ``evidence``, the mixture of ``rate_evidence`` assigns it by its
    posterior; ``rate_uncertain`` marks units that rest on a posterior below its bound, and missing units.
    """
    feeds = sources.where(F.col("feeds_table") == "plumes").select(
        F.col("source_name").alias("datasource"), rate_unit(F.col("description")).alias("_default_unit")
    )
    out = plumes.join(broadcast_if_small(feeds), "datasource", "left")
    told = F.coalesce(rate_unit(F.col("rate_unit")), rate_unit(F.col("remarks")), F.col("_default_unit"))
    guess, doubt = F.lit(None).cast("string"), F.lit(True)
    if evidence:
        out = out.join(broadcast_if_small(cut(rate_evidence(plumes))), "datasource", "left")
        guess, doubt = F.col("mixture_unit"), F.coalesce("mixture_uncertain", F.lit(True))
    unit = F.coalesce(told, guess)
    rate = finite(F.col("emission_rate"))
    return (
        out.withColumn("rate_unit_true", unit)
        .withColumn("kg_h", F.when(rate > 0, rate * factor(unit, RATE)))
        .withColumn("rate_uncertain", told.isNull() & doubt)
        .drop("_default_unit", "mixture_unit", "mixture_posterior", "mixture_uncertain")
    )


def units_found(obs: DataFrame, plumes: DataFrame, sources: DataFrame) -> DataFrame:
    """field, row_id, unit of each usable value, non-null ch4 and positive rate that is not in ppb or kg/h."""
    files = obspack_file_units(obs)
    o = obs.select("row_id", "file_name", "value", "ch4").join(files.select("file_name", "value_unit_true", "ch4_unit_true"), "file_name")
    cases = F.array(
        F.struct(F.lit("value").alias("field"), F.when(usable(F.col("value")), F.col("value_unit_true")).alias("unit")),
        F.struct(F.lit("ch4").alias("field"), F.when(F.col("ch4").isNotNull(), F.col("ch4_unit_true")).alias("unit")),
    )
    o = o.select("row_id", F.explode(cases).alias("c")).select("c.field", "row_id", "c.unit").where(F.col("unit") != "ppb")
    p = with_kg_per_h(plumes.select("plume_id", "datasource", "emission_rate", "rate_unit", "remarks"), sources, evidence=True)
    p = p.where(F.col("kg_h").isNotNull() & ~F.col("rate_uncertain") & (F.col("rate_unit_true") != "kg/h"))
    return o.unionByName(p.select(F.lit("emission_rate").alias("field"), F.col("plume_id").alias("row_id"), F.col("rate_unit_true").alias("unit")))
