"""Model output tables: missing hours, tracer runs, sensitivities, kinds of state vector elements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_first_hour(run: DataFrame, previous: DataFrame, keys: list[str]) -> DataFrame:
    """A run's hours with hour 0 of its first day taken from the end of the previous run where it is missing.

    Both have hour (number since 1970), ``keys`` and values. Where both hold a row the run's own stays.
    """
    first = run.agg(F.floor(F.min("hour") / 24).alias("day")).first()["day"]
    if first is None:
        return run
    hour0 = previous.where(F.col("hour") == first * 24).join(run.where(F.col("hour") == first * 24).select(*keys), keys, "left_anti")
    return run.unionByName(hour0)


def element_kind(element: Column, n: int, optimise_bc: bool, optimise_oh: bool, regional: bool) -> Column:
    """``emission``, ``boundary`` or ``oh`` by place from the end: OH is last (one regionally, else two), before it four boundaries."""
    n_oh = (1 if regional else 2) if optimise_oh else 0
    n_bc = 4 if optimise_bc else 0
    out = F.when(element > n - n_oh, "oh").when(element > n - n_oh - n_bc, "boundary")
    return out.otherwise("emission")


def run_number(element: Column, n: int, per_run: int, optimise_bc: bool, optimise_oh: bool, regional: bool) -> Column:
    """Perturbation run of an element: emissions share runs of ``per_run`` tracers, every other element has its own."""
    n_oh = (1 if regional else 2) if optimise_oh else 0
    n_bc = 4 if optimise_bc else 0
    n_emis = n - n_oh - n_bc
    shared = -(-n_emis // per_run)
    return F.when(element <= n_emis, F.ceil(element / per_run)).otherwise(F.lit(shared) + element - n_emis).cast("int")


def boundary_perturbation(element: Column, n: int, value: float, optimise_oh: bool, regional: bool) -> Column:
    """[north, south, east, west] with ``value`` at the boundary that the element perturbs, zeros for other elements."""
    n_oh = (1 if regional else 2) if optimise_oh else 0
    first = n - n_oh - 4
    return F.array(*[F.when(element == first + k, value).otherwise(0.0) for k in (1, 2, 3, 4)])


def sensitivity(perturbed: Column, base: Column, kind: Column, emission_step: Column, oh_step: float, bc_step: float) -> Column:
    """Change of the model per unit of an element: its step is its own for emissions, fixed for OH and boundaries."""
    step = F.when(kind == "oh", F.lit(oh_step)).when(kind == "boundary", F.lit(bc_step)).otherwise(emission_step)
    return F.transform(F.arrays_zip(perturbed.alias("p"), base.alias("b")), lambda x: (x["p"] - x["b"]) / step)


def at_hours(rows: DataFrame, state: DataFrame, hour: str = "hour") -> DataFrame:
    """``rows`` (hour, i, j, ...) with the model state of their hour and cell; rows of an hour that the model lacks fall out.

    An equi join, so only the hours and cells that occur in ``rows`` are kept of ``state`` (hour, i, j, ...).
    """
    return rows.join(state, [hour, "i", "j"])


def element_axis(tracers: DataFrame, bases: DataFrame, kind: Column, emission_step: Column, oh_step: float, bc_step: float) -> DataFrame:
    """hour, i, j, element, dch4: change of the model layers per unit of every element.

    ``tracers`` has hour, element, i, j, ch4 (array) of the perturbed runs, whichever run holds an element; ``bases``
    has hour, run_id, i, j, ch4. Emission and boundary elements are compared with base run 0001, OH with base run 0000.
    """
    rows = tracers.withColumn("kind", kind).withColumn("run_id", F.when(F.col("kind") == "oh", "0000").otherwise("0001"))
    both = rows.join(bases.withColumnRenamed("ch4", "base"), ["hour", "run_id", "i", "j"])
    change = sensitivity(F.col("ch4"), F.col("base"), F.col("kind"), emission_step, oh_step, bc_step)
    return both.select("hour", "i", "j", "element", change.alias("dch4"))
