"""Implausible spikes in measurements (problem 1).

Each dataset's series is a local-level state-space model. Shards of equal count with a warm-up margin on both sides are
filtered independently, forwards and backwards, by a Kalman filter; an innovation beyond the gate is flagged and its
update withheld. A second filter of unit gain (the level is the last reading) watches for innovations whose variance
vanishes against the model's. What shards propose is judged by the scatter and the habits of the whole dataset.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fluxloom.operators.units import obspack_file_units
from fluxloom.functions.unit_labels import MOLE_FRACTION, factor
from fluxloom.session import broadcast_if_small, cut
from fluxloom.sources.tables import dataset_of, usable


def _robust_sd(x: np.ndarray) -> float:
    return 1.4826 * float(np.median(np.abs(x - np.median(x)))) if len(x) else 0.0


def _noise(t: np.ndarray, v: np.ndarray, floor: float) -> tuple[float, float]:
    """Measurement variance r and level variance per hour q, from robust spreads of short and long differences."""
    d1, dk = np.diff(v), v[6:] - v[:-6]
    moving = np.abs(d1) > 1e-9  # repeats of a stuck or coarse sensor say nothing about the noise
    s1 = _robust_sd(d1[moving]) ** 2 if moving.sum() >= 4 else _robust_sd(d1) ** 2
    t1 = float(np.median(np.diff(t))) if len(t) > 1 else 1.0
    q = 0.0
    if len(dk) > 8:
        tk = float(np.median(t[6:] - t[:-6]))
        q = max(0.0, (_robust_sd(dk) ** 2 - s1) / max(tk - t1, 1e-3))
    q = min(q, s1 / max(t1, 0.05))
    r = max((s1 - q * t1) / 2, s1 / 8, floor**2)
    return r, max(q, r * 1e-3)


def _one_sided(t: np.ndarray, v: np.ndarray, r: float, q: float, gate: float, patience: int) -> tuple[np.ndarray, np.ndarray]:
    """Predicted level and its variance before each reading; updates beyond the gate are withheld.

    After ``patience`` withheld readings in a row that agree with each other the level is taken to have moved.
    """
    n = len(v)
    pred, var = np.empty(n), np.empty(n)
    m, p, last, held = float(np.median(v[: min(n, 9)])), 25.0 * r, t[0], []
    for k in range(n):
        p += q * abs(t[k] - last)
        last = t[k]
        pred[k], var[k] = m, p
        s = p + r
        e = v[k] - m
        if e * e > gate * gate * s:
            held.append(v[k])
            if len(held) >= patience:
                m, p, held = float(np.median(held)), 4.0 * r, []
            continue
        held = []
        g = p / s
        m += g * e
        p *= 1 - g
    return pred, var


@dataclass
class Proposal:
    """What a series proposes, reading by reading, and what it says about its dataset's normal behaviour."""

    z: np.ndarray  # standardised innovation
    departure: np.ndarray  # distance from the level around, 0 where no gate was passed
    still: np.ndarray  # part of a stretch of vanishing innovations
    scatter: float  # usual scatter about the level
    pairs: int  # innovations outside still stretches
    repeats: int  # how many of these vanish too


def _still(t: np.ndarray, v: np.ndarray, r: float, q: float, length: int, band: float) -> np.ndarray:
    """Readings in stretches of ``length`` or more whose innovation variance vanishes.

    The innovations are those of the unit-gain filter. A window of ``length`` - 1 of them vanishes when their mean
    square lies within the band's and is a small part of what the model expects; a window is drawn out as far as all
    its readings stay on one level.
    """
    n, out = len(v), np.zeros(len(v), bool)
    if n < length:
        return out
    e = np.diff(v)
    expected = 2 * r + q * np.diff(t)
    total = lambda x: np.cumsum(np.r_[0.0, x])[length - 1 :] - np.cumsum(np.r_[0.0, x])[: -(length - 1)]
    quiet = (total(e * e) <= (length - 1) * (band + 1e-6) ** 2) & (total(e * e / expected) <= 0.25 * (length - 1))
    k = 0
    for start in np.flatnonzero(quiet):
        if start < k:
            continue
        lo = hi = v[start]
        j = start + 1
        while j < n and max(hi, v[j]) - min(lo, v[j]) <= band + 1e-6:
            lo, hi = min(lo, v[j]), max(hi, v[j])
            j += 1
        if j - start >= length:
            out[start:j] = True
            k = j
    return out


def propose(t: np.ndarray, v: np.ndarray, *, gate: float = 5.0, patience: int = 5, stuck_len: int = 8, stuck_band: float = 0.03, floor: float = 0.2) -> Proposal:
    """Proposals of one ordered series: hours ``t``, values ``v``.

    A departure is proposed where a reading stands out from what both directions of time together expect by more than
    ``gate`` and from each by half of that (a lasting rise is expected from one of its sides).
    """
    n = len(v)
    if n < 4:
        return Proposal(np.zeros(n), np.zeros(n), np.zeros(n, bool), floor, 0, 0)
    r, q = _noise(t, v, floor)
    fm, fp = _one_sided(t, v, r, q, gate, patience)
    bm, bp = (a[::-1] for a in _one_sided(-t[::-1], v[::-1], r, q, gate, patience))
    zf, zb = (v - fm) / np.sqrt(fp + r), (v - bm) / np.sqrt(bp + r)
    z = np.where(np.abs(zf) < np.abs(zb), zf, zb)
    level = (fm / fp + bm / bp) / (1 / fp + 1 / bp)
    both = (v - level) / np.sqrt(1 / (1 / fp + 1 / bp) + r)
    # after a gap one side alone expects anything, so each side needs half the gate and both together all of it
    candidate = (np.abs(both) > gate) & (np.abs(z) > gate / 2) & (zf * zb > 0)
    usual = _robust_sd((v - level)[~candidate]) if (~candidate).sum() >= 4 else np.sqrt(r)
    scatter = max(min(usual, 1.25 * np.sqrt(r + q)), floor)
    still = _still(t, v, r, q, stuck_len, stuck_band)
    outside = ~(still[1:] & still[:-1])
    vanished = np.abs(np.diff(v)) <= stuck_band + 1e-6
    return Proposal(z, np.where(candidate, np.abs(v - level), 0.0), still, scatter, int(outside.sum()), int((outside & vanished).sum()))


#: A still stretch is believed where chance makes fewer than half a stretch in this many readings.
HABIT_READINGS = 1500


def habit_allows(pairs, repeats, stuck_len: int = 8):
    """Whether a dataset's innovations vanish so seldom outside its still stretches that those are no habit of it."""
    return ((repeats + 0.5) / (pairs + 10.0)) ** (stuck_len - 1) < 0.5 / HABIT_READINGS


def scan_series(t: np.ndarray, v: np.ndarray, times_scatter: float = 10.0, **limits: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(spike, stuck, standardised innovation) of a series that is a whole dataset."""
    p = propose(t, v, **limits)
    return p.departure > 0.9 * times_scatter * p.scatter, p.still & habit_allows(p.pairs, p.repeats), p.z


_PROPOSED = "dataset string, obspack_id string, z double, departure double, still boolean, scatter double, pairs long, repeats long, n long"


def _scan_shards(**limits: float):
    def run(batch: pd.DataFrame) -> pd.DataFrame:
        one = batch.sort_values(["time_h", "obspack_id"], kind="stable")
        p = propose(one["time_h"].to_numpy(), one["ppb"].to_numpy(), **limits)
        core = one["core"].to_numpy()
        rows = one.assign(z=p.z, departure=p.departure, still=p.still)[core & ((p.departure > 0) | p.still)]
        out = rows[["dataset", "obspack_id", "z", "departure", "still"]].assign(scatter=np.nan, pairs=0, repeats=0, n=0)
        said = pd.DataFrame({"dataset": [one["dataset"].iloc[0]], "obspack_id": [None], "z": [0.0], "departure": [0.0], "still": [False], "scatter": [p.scatter], "pairs": [p.pairs], "repeats": [p.repeats], "n": [int(core.sum())]})
        return pd.concat([out, said], ignore_index=True) if len(out) else said

    return run


def _in_shards(series: DataFrame, shard_rows: int, margin: float) -> DataFrame:
    """``series`` (dataset, obspack_id, time_h, ppb) with shard and core, a row for every shard it is read in.

    Places in the series are estimated from counts per dataset and day: the readings of earlier days, and within the
    day the elapsed part of its count, for days of more than a shard minute by minute. So shards are equal in count,
    whether days lie apart or readings come in bursts.
    """
    day, minute = F.floor(F.col("time_h") / 24), F.floor(F.col("time_h") * 60)
    days = series.groupBy("dataset", day.alias("day")).agg(F.count("*").alias("n"))
    past = W.partitionBy("dataset").orderBy("day")
    days = days.withColumn("before", F.sum("n").over(past) - F.col("n")).withColumn("shards", F.greatest(F.lit(1), F.round(F.sum("n").over(W.partitionBy("dataset")) / shard_rows)))
    days = broadcast_if_small(cut(days))
    timed = series.withColumn("day", day).withColumn("minute", minute).join(days, ["dataset", "day"])
    ticks = timed.where(F.col("n") > shard_rows).groupBy("dataset", "day", "minute").agg(F.count("*").alias("m"))
    earlier = F.sum("m").over(W.partitionBy("dataset", "day").orderBy("minute")) - F.col("m")
    ticks = broadcast_if_small(cut(ticks.withColumn("earlier", earlier).select("dataset", "minute", "m", "earlier")))
    timed = timed.join(ticks, ["dataset", "minute"], "left")
    within = F.coalesce(F.col("earlier") + (F.col("time_h") * 60 - F.col("minute")) * F.col("m"), (F.col("time_h") / 24 - F.col("day")) * F.col("n"))
    placed = timed.withColumn("at", (F.col("before") + within) / shard_rows)
    inner = lambda x: F.least(F.greatest(F.floor(x), F.lit(0)), F.col("shards") - 1).cast("int")
    placed = placed.withColumn("home", inner(F.col("at"))).withColumn("shard", F.explode(F.array_distinct(F.array(F.col("home"), inner(F.col("at") - margin), inner(F.col("at") + margin)))))
    return placed.select("dataset", "shard", "obspack_id", "time_h", "ppb", (F.col("home") == F.col("shard")).alias("core"))


def flag_readings(
    obs: DataFrame, *, low: float = 600.0, high: float = 5000.0, shard_rows: int = 1500, margin: float = 0.2, times_scatter: float = 10.0, **limits: float
) -> DataFrame:
    """Bad readings of ``obs``: row_id, reason (``impossible``, ``spike``, ``stuck``) and standardised innovation.

    Readings are compared in ppb. NULL and NaN values are no case and never enter a series; rows without a time or an
    id can only be ``impossible``. Redelivered rows (same obspack_id) are combined before they are shuffled, count once
    in the series and are all reported. Shards hold about ``shard_rows`` readings of one dataset plus ``margin`` of
    that on each side, so a dataset with a third of all rows is spread over as many tasks as it needs. A spike departs
    by about ``times_scatter`` times its dataset's usual scatter (the median of its shards'); a still stretch is stuck
    where the dataset's innovations seldom vanish elsewhere, and a dataset that never moves is stuck throughout. A
    dataset of fewer than four readings has no normal behaviour to compare with. Empty input gives no rows.
    """
    files = obspack_file_units(obs, ("value",)).select("file_name", factor(F.col("value_unit_true"), MOLE_FRACTION).alias("to_ppb"))
    value = F.col("value")
    rows = obs.select("row_id", "obspack_id", "file_name", "time", value).where(value.isNotNull() & ~F.isnan(value)).join(broadcast_if_small(cut(files)), "file_name", "left")
    ppb = value * F.col("to_ppb")
    fits = F.coalesce(usable(value) & ppb.between(low, high), F.lit(False))
    rows = rows.select("row_id", "obspack_id", dataset_of(F.col("obspack_id")).alias("dataset"), (F.unix_micros("time") / 3.6e9).alias("time_h"), F.when(fits, ppb).alias("ppb"))
    ok = rows.where(F.col("ppb").isNotNull() & F.col("dataset").isNotNull() & F.col("time_h").isNotNull())
    series = cut(ok.groupBy("dataset", "obspack_id").agg(F.min(F.struct("time_h", "ppb")).alias("x")).select("dataset", "obspack_id", "x.*"))
    proposed = cut(_in_shards(series, shard_rows, margin).groupBy("dataset", "shard").applyInPandas(_scan_shards(**limits), _PROPOSED))
    normal = proposed.where(F.col("n") > 0).groupBy("dataset").agg(F.median("scatter").alias("usual"), F.sum("pairs").alias("all_pairs"), F.sum("repeats").alias("all_repeats"))
    judged = proposed.where(F.col("obspack_id").isNotNull()).select("dataset", "obspack_id", "z", "departure", "still").join(normal, "dataset")
    spike = F.col("departure") > 0.9 * times_scatter * F.col("usual")
    seldom = F.pow((F.col("all_repeats") + 0.5) / (F.col("all_pairs") + 10.0), F.lit(limits.get("stuck_len", 8) - 1)) < 0.5 / HABIT_READINGS
    marks = judged.select("obspack_id", "z", F.when(spike, "spike").when(F.col("still") & seldom, "stuck").alias("mark")).where(F.col("mark").isNotNull())
    out = rows.join(broadcast_if_small(cut(marks)), "obspack_id", "left").select("row_id", F.when(F.col("ppb").isNull(), "impossible").otherwise(F.col("mark")).alias("reason"), F.coalesce("z", F.lit(0.0)).alias("z"))
    return out.where(F.col("reason").isNotNull())
