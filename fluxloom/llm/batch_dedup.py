"""Deduplicating new batches against all history (problem 3).

Accepted records are kept as full vectors (position, time, rate) in the cells of an inverted file. A record probes only
the cells that its tolerance can reach, which is the distance bound beyond which no match is possible; what the cells
return is re-ranked by the exact distances; then the batch is appended to the cells.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace
from uuid import uuid4

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fluxloom.functions.geo import EARTH_M, RadiusGrid, great_circle_m, position
from fluxloom.operators.components import connected_classes
from fluxloom.operators.timestamps import normalise_times, source_clocks
from fluxloom.operators.units import with_kg_per_h
from fluxloom.session import broadcast_if_small, cut, row_bytes


#: Rate bin of a tile whose records have no rate.
UNKNOWN_RATE = -(10**6)
#: Stored vectors (tcol: column of the tile, kept as it rests on a cosine) and links of tiles.
TILE = "struct<r: long, c: long, s: long, q: long>"
VECTOR = "id long, batch int, lon double, lat double, t long, rate double, tcol long"
COLUMNS = ("id", "batch", "lon", "lat", "t", "rate", "tcol")
LINK = f"x {TILE}, y {TILE}, ky struct<batch: int, id: long>"


@dataclass(frozen=True)
class Tolerance:
    """What counts as the same detection."""

    metres: float = 500.0
    seconds: float = 240.0
    rate_share: float = 0.2
    cell_m: float = 2500.0
    cell_s: float = 1200.0


def same(a: str, b: str, tol: Tolerance) -> Column:
    """Exact test of two vectors: near, at the same time and, where both rates are given, of like rate."""
    c = lambda side, name: F.col(f"{side}.{name}")
    near = great_circle_m(c(a, "lon"), c(a, "lat"), c(b, "lon"), c(b, "lat")) <= tol.metres
    soon = F.abs(c(a, "t") - c(b, "t")) <= tol.seconds
    most = F.greatest(c(a, "rate"), c(b, "rate"))
    like = c(a, "rate").isNull() | c(b, "rate").isNull() | (F.abs(c(a, "rate") - c(b, "rate")) <= tol.rate_share * most + 1e-9)
    return soon & near & like


def _fine(tol: Tolerance) -> float:
    """Side in degrees of a square whose diagonal stays within the tolerance."""
    return math.degrees(tol.metres / 1.45 / EARTH_M)


def to_vectors(records: DataFrame, tol: Tolerance) -> DataFrame:
    """``records`` (id, batch, lon, lat, t seconds, rate) as vectors; those without position or time repeat nothing and are left out."""
    ok = records.where(F.col("lon").isNotNull() & F.col("lat").isNotNull() & F.col("t").isNotNull())
    ok = ok.withColumn("rate", F.when(F.col("rate") > 0, F.col("rate")))
    ok = ok.select(*[F.col(n).cast(k) for n, k in (("id", "long"), ("batch", "int"), ("lon", "double"), ("lat", "double"), ("t", "long"), ("rate", "double"))])
    fine = _fine(tol)
    frow = F.floor((F.col("lat") + 90) / fine)
    inner = F.least(F.abs(frow * fine - 90), F.abs((frow + 1) * fine - 90))
    return ok.withColumn("tcol", F.floor((F.col("lon") + 180) * F.cos(F.radians(inner)) / fine)).select(*COLUMNS)


def tile_of(tol: Tolerance, side: str = "") -> Column:
    """The tile of a vector: a part of space, time and rate so small that all its records are duplicates of each other.

    Its diagonal, duration and rate ratio are within the tolerance.
    """
    c = lambda name: F.col(f"{side}.{name}" if side else name)
    pace = -math.log(1 - tol.rate_share)
    bin_ = F.when(c("rate").isNull(), F.lit(UNKNOWN_RATE)).otherwise(F.floor(F.log(c("rate")) / pace))
    return F.struct(F.floor((c("lat") + 90) / _fine(tol)).alias("r"), c("tcol").alias("c"), F.floor(c("t") / tol.seconds).alias("s"), bin_.cast("long").alias("q"))


def _slot(tol: Tolerance) -> Column:
    return F.floor(F.col("t") / tol.cell_s)


def at_home(vectors: DataFrame, tol: Tolerance) -> DataFrame:
    """``vectors`` with ``cell``, the hash of their cell of the inverted file (row, column, slot).

    One number makes joins on cells cheap. Cells of one hash are compared for nothing, as what matches is told exactly.
    """
    grid = RadiusGrid(tol.cell_m)
    row = grid.row(F.col("lat"))
    return vectors.withColumn("cell", F.xxhash64(row, grid.column(F.col("lon"), row), _slot(tol)))


def probes(vectors: DataFrame, tol: Tolerance) -> DataFrame:
    """``vectors`` once per ``cell`` that their tolerance reaches."""
    grid = RadiusGrid(tol.cell_m)
    reach = math.degrees(tol.metres / EARTH_M) * 1.000001
    edge = F.least(F.abs(F.col("lat")) + reach, F.lit(90.0))
    dlon = F.when(edge >= 89.9, F.lit(180.0)).otherwise(F.degrees(F.asin(F.least(F.lit(1.0), F.lit(math.sin(math.radians(reach))) / F.cos(F.radians(edge))))))
    # three explodes of plain sequences, which are compiled, where functions over arrays are interpreted row by row
    out = vectors.withColumn("_dlon", dlon).withColumn("_row", F.explode(F.sequence(grid.row(F.col("lat") - reach), grid.row(F.col("lat") + reach))))
    out = out.withColumn("_n", grid.columns(F.col("_row")))
    at = lambda x: F.floor((x + 180) / 360 * F.col("_n")).cast("bigint")
    every = F.sequence(F.lit(0).cast("bigint"), F.col("_n") - 1)
    cols = F.when(F.col("_dlon") >= 180, every).otherwise(F.sequence(at(F.col("lon") - F.col("_dlon")), at(F.col("lon") + F.col("_dlon"))))
    slots = F.sequence(F.floor((F.col("t") - tol.seconds) / tol.cell_s), F.floor((F.col("t") + tol.seconds) / tol.cell_s))
    out = out.withColumn("_col", F.explode(cols)).withColumn("_slot", F.explode(slots))
    return out.select(*vectors.columns, F.xxhash64("_row", F.pmod("_col", "_n"), "_slot").alias("cell"))


def _rated(tile: Column) -> Column:
    return tile["q"] > UNKNOWN_RATE


def _hits(probing: DataFrame, held: DataFrame, tol: Tolerance) -> DataFrame:
    """Pairs of tiles (x, y), in both orders, of a record of ``probing`` and one of ``held`` in another tile that match.

    ``probing`` has the cells in reach, ``held`` the cell at home.
    """
    other = F.col("m.lon") != F.col("h.lon")  # equal vectors, as a head and itself, share a tile
    for c in ("lat", "t", "rate"):
        other |= ~F.col(f"m.{c}").eqNullSafe(F.col(f"h.{c}"))
    hits = probing.alias("m").join(held.alias("h"), (F.col("m.cell") == F.col("h.cell")) & other & same("m", "h", tol))
    hits = hits.select(*[F.struct(F.col(f"{s}.batch"), F.col(f"{s}.id")).alias(f"k{s}") for s in "mh"], *[tile_of(tol, s).alias(s) for s in "mh"]).where(F.col("m") != F.col("h"))
    pair = lambda a, b: F.struct(F.col(a).alias("x"), F.col(b).alias("y"), F.col(f"k{b}").alias("ky"))
    return hits.select(F.explode(F.array(pair("m", "h"), pair("h", "m"))).alias("p")).select("p.*")


def _even(pairs: DataFrame) -> DataFrame:
    """The links (a < b) of ``pairs`` whose tiles both have rates or both have none."""
    return pairs.where((_rated(F.col("x")) == _rated(F.col("y"))) & (F.col("x") < F.col("y"))).select(F.col("x").alias("a"), F.col("y").alias("b"))


def _mixed(pairs: DataFrame) -> DataFrame:
    """x, y, ky of every tile x without rates: the rated tile y with the earliest record that matches one of x.

    A tile without rates is tied to no other rated tile, so an unknown rate never makes one class of two different rates.
    """
    both = pairs.where(~_rated(F.col("x")) & _rated(F.col("y")))
    return both.groupBy("x").agg(F.min_by("y", "ky").alias("y"), F.min("ky").alias("ky"))


def _late_pairs(entries: DataFrame, heads: DataFrame, classes: DataFrame, first: DataFrame, tol: Tolerance) -> DataFrame:
    """Pairs of tiles (x, y, ky) that only their later members tie together: nothing is lost to tiling.

    Only tiles of two or more records whose extents can be in reach of each other are opened: both with rates or both
    without if their ``classes`` (node, label) differ; a tile without rates with a rated one if that begins before the
    record that the former is tied to (``first``: x, ky). Copies of a vector count once in an opened tile.
    """
    reach = tol.metres + 2 * tol.metres * math.sqrt(2) / 1.45  # two members in reach, each within its tile's diagonal of the head
    wide = replace(tol, metres=reach, seconds=tol.seconds * 3)
    extents = entries.groupBy("tile").agg(F.count("*").alias("n"), *[g(c).alias(f"{c}_{n}") for c in ("lat", "t") for g, n in ((F.min, "lo"), (F.max, "hi"))]).where(F.col("n") > 1)
    crowd = heads.join(extents, "tile").join(classes, heads.tile == classes.node, "left").join(first.select("x", F.col("ky").alias("tied")), F.col("tile") == F.col("x"), "left")
    crowd = crowd.withColumn("class", F.coalesce("label", "tile")).withColumn("key", F.struct("batch", "id"))
    crowd = cut(crowd.select("tile", "class", "key", "tied", "lon", "lat", "t", "lat_lo", "lat_hi", "t_lo", "t_hi"))
    a, b = probes(crowd, wide).alias("m"), at_home(crowd, wide).alias("h")
    near = great_circle_m(F.col("m.lon"), F.col("m.lat"), F.col("h.lon"), F.col("h.lat")) <= wide.metres
    apart = lambda c: F.greatest(F.col(f"m.{c}_lo") - F.col(f"h.{c}_hi"), F.col(f"h.{c}_lo") - F.col(f"m.{c}_hi"))
    near &= (apart("lat") <= math.degrees(tol.metres / EARTH_M) * 1.000001) & (apart("t") <= tol.seconds)
    like = F.abs(F.col("m.tile")["q"] - F.col("h.tile")["q"]) <= 2
    even = like & (F.col("m.tile") < F.col("h.tile")) & (F.col("m.class") != F.col("h.class"))
    mixed = ~_rated(F.col("m.tile")) & _rated(F.col("h.tile")) & (F.col("m.tied").isNull() | (F.col("h.key") < F.col("m.tied")))
    open_ = a.join(b, (F.col("m.cell") == F.col("h.cell")) & near & (even | mixed)).select(F.col("m.tile").alias("x"), F.col("h.tile").alias("y")).distinct()
    vectors = entries.groupBy("tile", F.struct("lon", "lat", "t", "rate").alias("v")).agg(F.min(F.struct("batch", "id")).alias("k"))
    left = vectors.select(F.col("tile").alias("x"), F.col("v").alias("m"))
    right = vectors.select(F.col("tile").alias("y"), F.col("v").alias("h"), F.col("k").alias("ky"))
    return open_.join(left, "x").join(right, "y").where(same("m", "h", tol)).groupBy("x", "y").agg(F.min("ky").alias("ky"))


class CellIndex:
    """Accepted records persisted as full vectors in the cells of an inverted file, with the links found between them.

    ``path`` holds three append-only tables; the vectors are partitioned by era (``era_days`` days), so a batch reads and
    writes the eras it reaches: ``heads`` (the first accepted record of every tile), ``later`` (all other records) and
    ``links`` (pairs of tiles that a record of one and the head of the other tie together).
    """

    def __init__(self, spark: SparkSession, path: str, tol: Tolerance = Tolerance(), era_days: int = 10):
        self.spark, self.path, self.tol, self.era_days, self.generation = spark, path, tol, era_days, 0

    def _folder(self, name: str) -> str:
        return f"{self.path}/{name}-{self.generation}"

    def _era(self, slot: Column) -> Column:
        return F.floor(slot * self.tol.cell_s / (self.era_days * 86400)).cast("int")

    def _append(self, name: str, rows: DataFrame, files: int | None = None) -> None:
        """Add ``rows``, with ``files`` files per era at most; without that number by a shuffle into a few."""
        rows = rows.select(*COLUMNS).withColumn("era", self._era(_slot(self.tol)))
        rows = rows.coalesce(files) if files else rows.repartition("era", F.pmod(F.col("tcol"), F.lit(4)))
        rows.write.mode("append").partitionBy("era").parquet(self._folder(name))

    def _held(self, name: str) -> DataFrame:
        """The rows of a table; none before the first batch."""
        schema = LINK if name == "links" else f"{VECTOR}, era int"
        try:
            return self.spark.read.schema(schema).parquet(self._folder(name))
        except AnalysisException:  # the folder is not there yet; what is joined with a plan known to be empty is not run
            return self.spark.range(1).where(F.lit(False)).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in T.StructType.fromDDL(schema)])

    def _kept(self, df: DataFrame) -> DataFrame:
        """``df`` written once beside the index: by columns, so smaller than a checkpoint and read in part."""
        folder = f"{self.path}/work/{uuid4().hex}"
        df.write.parquet(folder)
        return self.spark.read.schema(df.schema).parquet(folder)

    def prepared(self, records: DataFrame) -> DataFrame:
        """``records`` as vectors, written once."""
        return self._kept(to_vectors(records, self.tol))

    def accept(self, records: DataFrame) -> None:
        """Check a batch against all accepted records and itself, keep the links found, and append it to the cells."""
        self.accept_prepared(self.prepared(records))

    def _split(self, new: DataFrame, heads: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The first records of tiles that ``heads`` (accepted) do not hold, and the other records of ``new``.

        One aggregation counts the new and the accepted records of every tile. Of a tile with one new record the
        smallest values are that record; only records of other tiles are read again.
        """
        tile = tile_of(self.tol).alias("tile")
        nothing = [F.lit(None).cast(f.dataType).alias(f.name) for f in T.StructType.fromDDL(VECTOR)]
        rows = new.select(tile, F.lit(False).alias("known"), *COLUMNS).unionByName(heads.select(tile, F.lit(True).alias("known"), *nothing))
        sums = rows.groupBy("tile").agg(F.count("t").alias("n"), F.max("known").alias("known"), *[F.min(c).alias(c) for c in COLUMNS]).where(F.col("n") > 0)
        sums = self._kept(sums.select(F.when((F.col("n") > 1) | F.col("known"), F.col("tile")).alias("tile"), "known", *COLUMNS))
        busy = sums.where(F.col("tile").isNotNull()).select("tile", "known")
        many = cut(new.select(tile, *COLUMNS).join(broadcast_if_small(busy), "tile"))
        first = many.where(~F.col("known")).groupBy("tile").agg(F.min(F.struct("batch", "id")).alias("first"))
        head = F.col("first").isNotNull() & F.col("id").eqNullSafe(F.col("first.id"))
        many = cut(many.join(broadcast_if_small(cut(first)), "tile", "left").select(*COLUMNS, head.alias("head")))
        fresh = sums.where(F.col("tile").isNull()).select(*COLUMNS).unionByName(many.where(F.col("head")).select(*COLUMNS))
        return fresh, many.where(~F.col("head")).select(*COLUMNS)

    def accept_prepared(self, new: DataFrame) -> None:
        """``accept`` for rows that are ``prepared``.

        Every new record probes the heads in the cells that its tolerance reaches, and the heads of new tiles are probed
        by the accepted later records, so each pair of a new and an accepted record's tile is seen from one side at
        least. What no cell in reach holds cannot match; what one holds is compared exactly. A batch measured to be
        small is broadcast to the index, which then is only scanned; a larger one is joined by a shuffle on the cell.
        """
        eras = F.flatten(F.collect_set(F.array(*[self._era(_slot(self.tol) + k) for k in (-1, 1)])))
        said = new.agg(F.array_distinct(eras).alias("eras"), F.count("*").alias("n"), F.sum(row_bytes(new)).alias("bytes")).first()
        # the numbers of the eras in reach, a handful per batch, prune the folders that are read
        heads, later = (self._held(n).where(F.col("era").isin(said["eras"])).select(*COLUMNS) for n in ("heads", "later"))
        small = said["n"] <= 100_000 and (said["bytes"] or 0) <= 16 << 20
        few = F.broadcast if small else lambda df: df
        fresh, rest = self._split(new, heads)
        found = _hits(few(probes(new, self.tol)), at_home(heads.unionByName(fresh), self.tol), self.tol)
        found = found.unionByName(_hits(probes(later, self.tol), few(at_home(fresh, self.tol)), self.tol))
        found.groupBy("x", "y").agg(F.min("ky").alias("ky")).coalesce(4).write.mode("append").parquet(self._folder("links"))
        files = 1 + said["n"] // 150_000
        self._append("heads", fresh, files)
        self._append("later", rest, files)

    def compact(self) -> None:
        """Rewrite the tables into few files per era, as a new generation; readers of the old one are not disturbed."""
        held = {n: self._held(n) for n in ("heads", "later", "links")}
        self.generation += 1
        held["links"].groupBy("x", "y").agg(F.min("ky").alias("ky")).write.parquet(self._folder("links"))
        for name in ("heads", "later"):
            self._append(name, held[name])

    def repeats(self) -> DataFrame:
        """id, batch, kept_id of every accepted record that repeats an earlier one (lower batch, or same batch and lower
        id); kept_id is the first record of the class that the duplicates form.

        The classes follow from the stored links; pairs of tiles that only later members could link (of different
        classes, or one without rates) are then opened and compared member by member.
        """
        heads, later = (self._held(n).select(tile_of(self.tol).alias("tile"), *COLUMNS) for n in ("heads", "later"))
        later = cut(later)
        pairs = cut(self._held("links").groupBy("x", "y").agg(F.min("ky").alias("ky")))
        # a tile of one record that no link names holds no repeat and no late link, so most heads are only scanned
        touched = cut(pairs.select(F.col("x").alias("tile")).union(later.select("tile")).distinct())
        heads = cut(heads.join(broadcast_if_small(touched), "tile", "left_semi"))
        entries = heads.unionByName(later)
        classes = connected_classes(_even(pairs))
        late = cut(_late_pairs(entries, heads, classes, _mixed(pairs), self.tol))
        base = cut(heads.join(classes, heads.tile == classes.node, "left").select("tile", F.coalesce("label", "tile").alias("base")))
        # what joins classes: links of later members, and of tiles without rates to their rated one
        more = _even(late).unionByName(_mixed(pairs.unionByName(late)).select(F.col("x").alias("a"), F.col("y").alias("b")))
        ends = lambda c: base.select(F.col("tile").alias(c), F.col("base").alias(f"{c}_base"))
        joined = connected_classes(more.join(ends("a"), "a").join(ends("b"), "b").select(F.col("a_base").alias("a"), F.col("b_base").alias("b")))
        tiles = base.join(joined, base.base == joined.node, "left").select("tile", F.coalesce("label", "base").alias("class"))
        first = entries.groupBy("tile").agg(F.min(F.struct("batch", "id")).alias("k")).join(tiles, "tile")
        firsts = first.groupBy("class").agg(F.min("k").alias("k")).select("class", F.col("k.id").alias("kept_id"))
        kept = tiles.join(firsts, "class").select("tile", "kept_id")
        return entries.join(kept, "tile").where(F.col("id") != F.col("kept_id")).select("kept_id", "id", "batch")


def batch_groups(counts: list[tuple[int, int]], together: int = 0) -> list[tuple[int, int]]:
    """First and last batch of the groups to accept, in order, of ``counts`` (batch, rows; ordered by batch).

    Every batch by itself; with ``together``, a group goes on until it has that many rows and as many as all groups
    before it. The index then doubles with each group, so all groups together read it about once, not once a batch.
    """
    groups: list[tuple[int, int]] = []
    held, start, rows = 0, None, 0
    for batch, n in counts:
        start, rows = (batch if start is None else start), rows + n
        if not together or rows >= max(together, held):
            groups.append((start, batch))
            held, start, rows = held + rows, None, 0
    return groups if start is None else [*groups, (start, counts[-1][0])]


def find_duplicates(records: DataFrame, path: str, tol: Tolerance = Tolerance(), by_batch: bool = True, together: int = 0) -> DataFrame:
    """id, batch, kept_id of the records that repeat an earlier one, through a ``CellIndex`` at ``path`` (a new folder).

    ``records``: id (unique), batch, lon, lat, t (seconds), rate (NULL when unknown). The batches are accepted one
    after the other in their order (or all at once); with ``together``, waiting batches form groups (``batch_groups``)
    that are accepted like one batch, with the same result. Work stays linear in crowded cells: a record is compared
    with the first record of each tile in reach, not with every record. Exact copies share a tile; ties in batch are
    ordered by id. Records without position, time or batch repeat nothing. An empty table gives no rows.
    """
    index = CellIndex(records.sparkSession, path, tol)
    new = index.prepared(records.where(F.col("batch").isNotNull()))
    # only the numbers and counts of the batches reach the driver
    counts = [(r["batch"], r["count"]) for r in new.groupBy("batch").count().orderBy("batch").collect()] if by_batch else []
    groups = batch_groups(counts, together)
    if len(groups) < 2:
        index.accept_prepared(new)
    else:
        for first, last in groups:
            # written by itself, so that the plans of all groups are alike and their compiled code is shared
            index.accept_prepared(index._kept(new.where(F.col("batch").between(first, last))))
    return index.repeats()


def plume_records(plumes: DataFrame, sources: DataFrame) -> DataFrame:
    """Plume reports as vectors: id, batch, lon, lat, t, rate (kg/h), from whatever notation they came in."""
    rows = with_kg_per_h(plumes, sources).withColumn("p", position(F.col("geometry"), F.col("lon"), F.col("lat")))
    rows = rows.select("plume_id", "batch", "p", "kg_h", "time", "date", "datasource", "ingested_at")
    timed = normalise_times(rows, "plume_id", source_clocks(sources), keep=("batch", "p", "kg_h"))
    return timed.select(F.col("plume_id").alias("id"), "batch", F.col("p.lon").alias("lon"), F.col("p.lat").alias("lat"), F.col("instant").alias("t"), F.col("kg_h").alias("rate"))
