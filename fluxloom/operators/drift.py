"""Schemas that drift between files (problem 2).

Every line's fields are read as tagged values (number, text, boolean, list, object). The schemas of all lines of a file
are fused by an associative aggregation that keeps every alternative type a path has had; conflicts become typed
branches beside one canonical conversion, and the fused schemas of successive files give the change report.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fluxloom.functions.let import let
from fluxloom.functions.unit_labels import RATE, factor, rate_unit
from fluxloom.operators.timestamps import parse_date

TYPES = ("number", "text", "boolean", "list", "object")
_PLAIN = r"^\s*[-+]?(\d+(\.\d*)?|\.\d+)([eE][-+]?\d+)?\s*$"
_NOTHING = ["", "nan", "null", "none", "na", "n/a"]

# Words by which a field's name tells its meaning; the first line that fits holds.
MEANINGS = {
    "rate_std": r"std|uncert|sigma|err(or)?\b|_err",
    "date": r"date|^day$|_day\b|^dt_|detected|acquired",
    "time": r"time|clock|overpass",
    "lon": r"lon|^x$",
    "lat": r"lat(itude)?$|^y$",
    "rate": r"rate|flux|^q_|emission",
    "instrument": r"instrument|satellite|sensor",
    "platform": r"platform|carrier",
}


def _split(line: Column, separator: Column) -> Column:
    """Fields of a delimited line; separators inside double quotes do not count."""
    pattern = F.concat(F.lit("["), separator, F.lit("]"))
    cells = F.split(line, F.concat(pattern, F.lit('(?=(?:[^"]*"[^"]*")*[^"]*$)')))
    return F.transform(cells, lambda c: F.regexp_replace(F.trim(c), '^"(.*)"$', "$1"))


def json_fields(raw: DataFrame) -> DataFrame:
    """feed, file_name, line_no, field, tag, text of the top-level fields of the JSON lines; unreadable lines give none."""
    lines = raw.where(F.lower("file_name").endswith(".jsonl") | F.lower("file_name").endswith(".json"))
    clean = F.regexp_replace("payload", r"([:\[,]\s*)-?(?:NaN|Infinity)(?=\s*[,}\]])", "$1null")
    entries = lines.select("feed", "file_name", "line_no", F.try_parse_json(clean).alias("v"))
    entries = entries.select("feed", "file_name", "line_no", F.explode(F.expr("try_variant_get(v, '$', 'map<string,variant>')")).alias("field", "value"))
    kind = F.schema_of_variant("value")
    text = F.expr("try_cast(value as string)")
    tag = (
        F.when(kind == "VOID", None)
        .when(kind == "STRING", F.when(~F.lower(F.trim(text)).isin(_NOTHING[:2]), "text"))
        .when(kind == "BOOLEAN", "boolean")
        .when(kind.startswith("ARRAY"), "list")
        .when(kind.startswith("OBJECT"), "object")
        .otherwise("number")
    )
    return entries.select("feed", "file_name", "line_no", "field", tag.alias("tag"), F.when(kind.startswith("ARRAY") | kind.startswith("OBJECT"), F.to_json("value")).otherwise(text).alias("text"))


def delimited_fields(raw: DataFrame) -> DataFrame:
    """As ``json_fields`` for delimited text whose header is line 0; a line of another width than its header is unreadable.

    The separator is the one of ``, ; tab |`` that the header holds most often. A delivery repeated under the same name
    repeats its header too; one is kept. A file without a header gives no fields.
    """
    lines = raw.where(F.lower("file_name").endswith(".csv"))
    head = lines.where(F.col("line_no") == 0).groupBy("file_name").agg(F.min("payload").alias("header"))
    marks = [",", ";", "\t", "|"]
    counts = [F.size(F.split("header", f"[{m}]")) for m in marks]
    best = F.greatest(*counts)
    head = head.withColumn("sep", F.coalesce(*[F.when(c == best, F.lit(m)) for c, m in zip(counts, marks)]))
    head = head.select("file_name", "sep", _split(F.col("header"), F.col("sep")).alias("names"))
    data = lines.where(F.col("line_no") > 0).join(head, "file_name")
    cells = data.withColumn("cells", _split(F.col("payload"), F.col("sep"))).where(F.size("cells") == F.size("names"))
    out = cells.select("feed", "file_name", "line_no", F.explode(F.arrays_zip("names", "cells")).alias("c"))
    text = F.col("c.cells")
    tag = F.when(F.lower(F.trim(text)).isin(_NOTHING), None).when(text.rlike(_PLAIN), "number").otherwise("text")
    headers = lines.where(F.col("line_no") == 0).join(head, "file_name").select("feed", "file_name", "line_no", F.explode("names").alias("field"))
    empty = headers.select("feed", "file_name", "line_no", "field", F.lit(None).cast("string").alias("tag"), F.lit(None).cast("string").alias("text"))
    return out.select("feed", "file_name", "line_no", F.col("c.names").alias("field"), tag.alias("tag"), text.alias("text")).unionByName(empty)


def tagged_fields(raw: DataFrame) -> DataFrame:
    """All fields of all readable lines as tagged values. Null names, payloads and feeds give nothing."""
    raw = raw.select("feed", "file_name", "line_no", "payload").where(F.col("file_name").isNotNull() & F.col("payload").isNotNull() & F.col("feed").isNotNull())
    return json_fields(raw).unionByName(delimited_fields(raw))


def file_schemas(fields: DataFrame) -> DataFrame:
    """Fused schema per file: feed, file_name, field, kind, alternatives (array of all tags seen), lines, meaning.

    Fusing counts each tag, which is associative and commutative, so it is combined map-side and holds for files of
    any size. In delimited text a field is a number only if every value is. ``kind`` is NULL without a typed value.
    """
    tag = F.col("tag")
    counts = [F.count(F.when(tag == t, 1)).alias(t) for t in TYPES]
    clock = F.col("text").rlike(r"^\d{1,2}:\d{2}(:\d{2})?")
    day = F.col("text").rlike(r"^(19|20)\d{2}-?\d{2}-?\d{2}|^1[0-9]{9}$|^\d{1,2} [A-Z][a-z]{2} \d{4}")
    agg = fields.groupBy("feed", "file_name", "field").agg(*counts, F.count("*").alias("lines"), F.avg(F.abs(F.col("text").try_cast("double"))).alias("size"), F.count(F.when(clock, 1)).alias("clocks"), F.count(F.when(day, 1)).alias("days"))
    total = sum((F.col(t) for t in TYPES), F.lit(0))
    most = F.greatest(*[F.col(t) for t in TYPES])
    commonest = F.coalesce(*[F.when(F.col(t) == most, F.lit(t)) for t in TYPES])
    delimited = F.lower("file_name").endswith(".csv")
    kind = F.when(total == 0, None).when(delimited, F.when(F.col("number") == total, "number").otherwise("text")).otherwise(commonest)
    seen = F.filter(F.array(*[F.when(F.col(t) > 0, F.lit(t)) for t in TYPES]), lambda x: x.isNotNull())
    low = F.lower("field")
    meaning = None
    for name, pattern in MEANINGS.items():
        meaning = F.when(low.rlike(pattern), name) if meaning is None else meaning.when(low.rlike(pattern), name)
    # a name that says nothing is understood by its values, else stands for itself
    by_value = F.when(F.col("clocks") * 2 > total, "time").when((F.col("days") * 2 > total) & (total > 0), "date")
    return agg.select("feed", "file_name", "field", kind.alias("kind"), seen.alias("alternatives"), "lines", "size", F.coalesce(meaning, by_value, F.concat(F.lit("="), low)).alias("meaning"))


def schema_changes(schemas: DataFrame) -> DataFrame:
    """file_name, field, change, previous, before, after: each file but a feed's first against the file before it.

    Order within a feed is the date in the file name (then the name), whenever files were delivered. ``previous`` is
    the old name of a renamed field, before/after are types; an untyped field keeps its last type.
    """
    date = F.regexp_extract("file_name", r"_(\d{8})(?:\D|$)", 1)
    files = W.partitionBy("feed").orderBy(date, "file_name")
    s = schemas.withColumn("at", F.dense_rank().over(files))
    names = s.groupBy("feed", "at").agg(F.max("file_name").alias("file_name"))
    history = W.partitionBy("feed", "field").orderBy("at")
    s = s.withColumn("kind", F.last("kind", ignorenulls=True).over(history.rowsBetween(W.unboundedPreceding, 0)))
    new = s.select("feed", "at", "field", F.col("kind").alias("after"), F.col("meaning").alias("m_new"), F.lit(True).alias("here"))
    old = s.select("feed", (F.col("at") + 1).alias("at"), "field", F.col("kind").alias("before"), F.col("meaning").alias("m_old"), F.lit(True).alias("there"))
    both = new.join(old, ["feed", "at", "field"], "full")
    change = F.when(F.col("there").isNull(), "added").when(F.col("here").isNull(), "removed").when(F.col("before") != F.col("after"), "retyped")
    diff = both.withColumn("change", change).where(F.col("change").isNotNull()).withColumn("meaning", F.coalesce("m_new", "m_old"))
    diff = diff.join(names, ["feed", "at"]).where(F.col("at") > 1)
    # a field that goes while one of the same meaning comes was renamed: both carry the same rank within the meaning
    rank = F.row_number().over(W.partitionBy("feed", "at", "meaning", "change").orderBy("field"))
    pair = W.partitionBy("feed", "at", "meaning", "rank")
    diff = diff.withColumn("rank", F.when(F.col("change") == "retyped", -F.row_number().over(W.partitionBy("feed", "at", "meaning").orderBy("field"))).otherwise(rank))
    gone = F.max(F.when(F.col("change") == "removed", F.col("field"))).over(pair)
    came = F.max(F.when(F.col("change") == "added", F.col("field"))).over(pair)
    renamed = gone.isNotNull() & came.isNotNull()
    out = diff.withColumn("previous", F.when(renamed, gone)).withColumn("swap", renamed)
    out = out.where(~(F.col("swap") & (F.col("change") == "removed"))).withColumn("change", F.when(F.col("swap"), "renamed").otherwise(F.col("change")))
    return out.select("file_name", "field", "change", "previous", "before", "after")


def nested_paths(raw: DataFrame, depth: int = 3) -> DataFrame:
    """feed, file_name, line_no, field, tag, text of every path of the JSON lines: ``a``, ``a.b``, ``a[]`` ... down to ``depth``.

    A list's elements share one path, so the types of all elements are alternatives of it. Lines that cannot be read
    give none. Each level is one explode of the level before; nothing is gathered.
    """
    lines = raw.where(F.lower("file_name").endswith(".jsonl") | F.lower("file_name").endswith(".json"))
    clean = F.regexp_replace("payload", r"([:\[,]\s*)-?(?:NaN|Infinity)(?=\s*[,}\]])", "$1null")
    keys = ["feed", "file_name", "line_no"]
    level = lines.select(*keys, F.lit("").alias("field"), F.try_parse_json(clean).alias("v")).where(F.schema_of_variant("v").startswith("OBJECT"))
    out = None
    for _ in range(depth):
        members = F.transform(F.map_entries(F.expr("try_variant_get(v, '$', 'map<string,variant>')")), lambda e: F.struct(F.concat(F.lit("."), e["key"]).alias("k"), e["value"].alias("v")))
        elements = F.transform(F.expr("try_variant_get(v, '$', 'array<variant>')"), lambda v: F.struct(F.lit("[]").alias("k"), v.alias("v")))
        level = level.select(*keys, "field", F.explode(F.coalesce(members, elements)).alias("x")).select(*keys, F.concat("field", "x.k").alias("field"), F.col("x.v").alias("v"))
        kind = F.schema_of_variant("v")
        text = F.expr("try_cast(v as string)")
        tag = (
            F.when(kind == "VOID", None)
            .when(kind == "STRING", F.when(~F.lower(F.trim(text)).isin(_NOTHING[:2]), "text"))
            .when(kind == "BOOLEAN", "boolean")
            .when(kind.startswith("ARRAY"), "list")
            .when(kind.startswith("OBJECT"), "object")
            .otherwise("number")
        )
        here = level.select(*keys, F.ltrim(F.col("field"), F.lit(".")).alias("field"), tag.alias("tag"), text.alias("text"))
        out = here if out is None else out.unionByName(here)
        level = level.where(kind.startswith("ARRAY") | kind.startswith("OBJECT"))
    return out


def alternative_changes(raw: DataFrame) -> DataFrame:
    """file_name, field, alternative, change: types that a path takes up (``appears``) or no longer has (``disappears``)
    against all earlier files of the feed, respectively against the file before.

    Paths are those of ``nested_paths`` and the fields of delimited text, all alternatives counted, not only the
    commonest. A feed's first file reports nothing.
    """
    raw = raw.select("feed", "file_name", "line_no", "payload").where(F.col("file_name").isNotNull() & F.col("payload").isNotNull() & F.col("feed").isNotNull())
    fields = nested_paths(raw).unionByName(delimited_fields(raw))
    seen = fields.where(F.col("tag").isNotNull()).groupBy("feed", "file_name", "field", "tag").agg(F.count("*").alias("n"))
    date = F.regexp_extract("file_name", r"_(\d{8})(?:\D|$)", 1)
    files = raw.select("feed", "file_name").distinct().withColumn("at", F.row_number().over(W.partitionBy("feed").orderBy(date, "file_name")))
    last = files.groupBy("feed").agg(F.max("at").alias("last"))
    own = W.partitionBy("feed", "field", "tag").orderBy("at")
    placed = seen.join(files, ["feed", "file_name"]).withColumn("before", F.lag("at").over(own)).withColumn("after", F.lead("at").over(own))
    up = placed.where(F.col("before").isNull() & (F.col("at") > 1)).select("file_name", "field", F.col("tag").alias("alternative"), F.lit("appears").alias("change"))
    gone = placed.join(last, "feed").where((F.coalesce("after", F.col("last") + 1) > F.col("at") + 1) & (F.col("at") < F.col("last")))
    gone = gone.select("feed", (F.col("at") + 1).alias("at"), "field", F.col("tag").alias("alternative")).join(files, ["feed", "at"])
    return up.unionByName(gone.select("file_name", "field", "alternative", F.lit("disappears").alias("change")))


def unified_table(raw: DataFrame) -> DataFrame:
    """One consistent table of everything the feeds delivered: a row per readable line, each line once.

    Canonical columns: feed, file_name, line_no, lon, lat (degrees; ``9.6N`` and text numbers are read), obs_date,
    obs_time (``HH:mm:ss`` as written, from a field of the time, else of the date), instrument, platform, rate and
    rate_std (the number in the value; as delivered, with rate_unit where the value says it), kg_h and kg_h_std (both
    converted to kg/h by rate_unit, NULL where the line does not tell the unit). What conflicts in type
    stays readable through ``branches``: per field its tag and text. Other fields are only in ``branches``.
    """
    fields = tagged_fields(raw.dropDuplicates(["file_name", "line_no", "payload"]))
    meaning = None
    for name, pattern in MEANINGS.items():
        hit = F.lower("field").rlike(pattern)
        meaning = F.when(hit, name) if meaning is None else meaning.when(hit, name)
    fields = fields.where(F.col("text").isNotNull() & F.col("tag").isNotNull()).dropDuplicates(["file_name", "line_no", "field"]).withColumn("meaning", meaning)

    def first_number(t: Column) -> Column:
        return F.nullif(F.regexp_extract(t, r"([-+]?\d+(?:\.\d*)?(?:[eE][-+]?\d+)?)", 1), F.lit("")).try_cast("double")

    pick = lambda m, c: F.max(F.when(F.col("meaning") == m, c))
    text = F.col("text")
    degrees = first_number(text) * F.when(F.upper(F.trim(text)).rlike("[SW]$"), -1).otherwise(1)
    number = F.when(F.col("tag") == "object", F.get_json_object(text, "$.value").try_cast("double")).otherwise(first_number(text))
    unit = F.coalesce(F.get_json_object(F.when(F.col("tag") == "object", text), "$.unit"), F.nullif(F.regexp_extract(text, r"(kg/h|t/h)", 1), F.lit("")), F.nullif(F.regexp_extract("field", r"_(t/h|kg/h)$", 1), F.lit("")))
    day_text = F.when(F.col("tag") == "object", F.get_json_object(text, "$.day")).otherwise(F.split(text, "[T ](?=\\d{2}:)")[0])
    day = let(day_text, lambda t: F.coalesce(parse_date(t, F.lit(False)), F.to_date(F.timestamp_seconds(F.when(t.rlike(r"^\d{9,10}$"), t.try_cast("bigint"))))))
    written = r"(?<!\d)(\d{1,2}):(\d{2})(?::(\d{2}))?"
    parts = [F.lpad(F.regexp_extract(text, written, k), 2, "0") for k in (1, 2, 3)]
    epoch = F.when(text.rlike(r"^\d{9,10}$"), F.date_format(F.timestamp_seconds(text.try_cast("bigint")), "HH:mm:ss"))
    clock = F.coalesce(F.when(text.rlike(written), F.concat_ws(":", *parts)), epoch)
    word = F.when(F.col("tag") == "object", F.coalesce(F.get_json_object(text, "$.name"), F.get_json_object(text, "$.value"), text)).otherwise(text)
    table = fields.groupBy("feed", "file_name", "line_no").agg(
        F.coalesce(pick("time", clock), pick("date", clock)).alias("obs_time"),
        pick("instrument", word).alias("instrument"),
        pick("platform", word).alias("platform"),
        pick("lon", degrees).alias("lon"),
        pick("lat", degrees).alias("lat"),
        pick("date", day).alias("obs_date"),
        pick("rate", number).alias("rate"),
        pick("rate", unit).alias("rate_unit"),
        pick("rate_std", number).alias("rate_std"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("field", F.struct("tag", "text"))))).alias("branches"),
    )
    common = factor(rate_unit(F.col("rate_unit")), RATE)
    return table.withColumn("kg_h", F.col("rate") * common).withColumn("kg_h_std", F.col("rate_std") * common)


def typed_branches(branches: Column) -> list[Column]:
    """A column per tag: numbers, texts, booleans, lists (elements as text) and objects (members as text), each an array
    of struct<field, value> in the order of the fields' names."""
    entries = F.sort_array(F.transform(F.map_entries(branches), lambda e: F.struct(e["key"].alias("field"), e["value"]["tag"].alias("tag"), e["value"]["text"].alias("text"))))
    members = lambda t: F.transform(F.map_entries(F.from_json(t, "map<string,string>")), lambda m: F.struct(m["key"].alias("name"), m["value"].alias("value")))
    read = {
        "number": lambda t: F.trim(t).try_cast("double"),
        "text": lambda t: t,
        "boolean": lambda t: t.try_cast("boolean"),
        "list": lambda t: F.from_json(t, "array<string>"),
        "object": members,
    }

    def of(tag: str) -> Column:
        held = F.filter(entries, lambda e: e["tag"] == tag)
        return F.transform(held, lambda e: F.struct(e["field"].alias("field"), read[tag](e["text"]).alias("value"))).alias(f"{tag}s")

    return [of(t) for t in TYPES]
