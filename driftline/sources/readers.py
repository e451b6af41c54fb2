"""File sources: logger CSVs, position files, tracks, headers, metadata and mappings as DataFrames."""

from __future__ import annotations

import csv
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions.labels import slug
from ..operators.timebase import ISO_PATTERN, try_patterns

# Encodings tried in order, and how a vendor's metadata row above the header begins.
ENCODINGS = ["UTF-8", "ISO-8859-1", "windows-1252"]
METADATA_ROW = r"^\s*\"?(Collar:|DeviceID:)|Sensor range"


def _files(spark: SparkSession, paths: str | list[str], is_preamble: Column) -> list[tuple[str, str, str]]:
    """(file, encoding, header line) of each file, from one pass over the raw lines; one row per file reaches the driver.

    A file is UTF-8 when all its lines are, else it takes the first single-byte encoding. The header is its first line that
    is neither preamble nor blank.
    """
    lines = spark.read.text(paths).select(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i"), "value")
    head = ~is_preamble & (F.trim("value") != "") & (F.col("b") == 0)
    got = lines.groupBy("f").agg(F.min_by(F.when(head, F.col("value").cast("binary")), F.when(head, F.col("i"))).alias("h"), F.bool_and(F.is_valid_utf8("value")).alias("ok"))
    out = []
    for r in got.where("h IS NOT NULL").collect():
        enc = ENCODINGS[0] if r["ok"] else ENCODINGS[1]
        out.append((r["f"], enc, bytes(r["h"]).decode(enc).rstrip("\r")))
    return sorted(out)


def _lines(spark: SparkSession, paths, encoding: str) -> DataFrame:
    """Raw lines in the given encoding (the text source knows only UTF-8)."""
    return spark.read.schema("value string").option("encoding", encoding).option("sep", "\u0001").option("quote", "").csv(paths)


def _split_header(line: str) -> list[str]:
    return [c.strip().strip('"') for c in next(csv.reader([line]))]


def read_csv(spark: SparkSession, paths: str | list[str], preamble: str = METADATA_ROW, schema: T.StructType | None = None) -> DataFrame:
    """CSV files with encoding fallback; lines matching ``preamble`` (metadata, comments) and header lines are skipped.

    Encoding and header are each file's own; files that agree in both are read as one group, and groups are united by name.
    All columns are strings unless a schema is given. Malformed lines land in ``_corrupt_record``.
    """
    found = _files(spark, paths, F.col("value").rlike(preamble))
    if not found:
        raise ValueError(f"no header line in {paths}")
    groups: dict[tuple[str, str], list[str]] = {}
    for f, enc, head in found:
        groups.setdefault((head, enc), []).append(f)
    out = None
    for (head, enc), files in sorted(groups.items()):
        cols = _split_header(head)
        st = schema or T.StructType([T.StructField(c, T.StringType()) for c in cols])
        lines = _lines(spark, files, enc).select("value", F.col("_metadata.file_path").alias("source_file")).where(
            ~F.col("value").rlike(preamble) & (F.trim("value") != "") & (F.col("value") != head))
        full = T.StructType([*st.fields, T.StructField("_corrupt_record", T.StringType())])
        row = F.from_csv("value", ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in full.fields),
                         {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
        part = lines.select(row.alias("r"), "source_file").select("r.*", "source_file")
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def read_any(spark: SparkSession, path: str) -> DataFrame:
    """Dispatch on the extension."""
    ext = path.rsplit(".", 1)[-1].lower()
    if ext in ("parquet", "pq"):
        return spark.read.parquet(path)
    if ext in ("csv", "txt"):
        return read_csv(spark, path)
    if ext == "json":
        return spark.read.json(path)
    raise ValueError(f"unknown file type .{ext}")


def read_many(spark: SparkSession, folder: str, include: str, reader: Callable[[SparkSession, list[str]], DataFrame] | None = None) -> DataFrame:
    """All files of a folder whose name matches a glob, united by name, rows without any value dropped.

    Columns missing in some files are null. Order is a column matter here: sort or window by time.
    """
    files = [r["p"] for r in spark.read.format("binaryFile").option("pathGlobFilter", include).load(folder).select(
        F.col("path").alias("p")).orderBy("p").collect()]  # file names only
    if not files:
        raise ValueError(f"no file matching {include} in {folder}")
    df = (reader or read_csv)(spark, files)
    return df.dropna("all", subset=[c for c in df.columns if c not in ("source_file", "_corrupt_record")])


def find_column(df: DataFrame, start: str) -> str:
    """Column whose slug equals or starts with ``start``."""
    for c in df.columns:
        if re.sub(r"[^a-z0-9]+", "_", c.lower()).strip("_").startswith(start):
            return c
    raise ValueError(f"no column starting with {start} among {df.columns}")


def _col(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


# Column names and date pattern of state-space location files.
GPE3_LAT, GPE3_LON, GPE3_DATE = "Most Likely Latitude", "Most Likely Longitude", "M/d/yyyy H:mm"
COMMENT = r"^\s*\"?\s*;|^[\s,]*$"


def read_state_space_locations(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Location files with a ``;`` comment preamble: ts, latitude, longitude and provenance.

    When the documented date pattern fails for more than a fifth of a file's rows, Spark's own parsing is used for that file.
    """
    df = read_csv(spark, paths, COMMENT)
    missing = [c for c in (GPE3_LAT, GPE3_LON, "Date") if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}")
    strict = F.try_to_timestamp(F.col("Date"), F.lit(GPE3_DATE))
    worse = df.groupBy("source_file").agg((F.avg(strict.isNull().cast("double")) > 0.2).alias("__worse"))
    d = df.join(worse, "source_file")
    num = lambda c: F.expr(f"try_cast(`{c}` AS double)")
    extra = [(num(c) if c.endswith("Score") else F.col(f"`{c}`")).alias(slug_name(c)) for c in ("Observation Type", "Observation Score") if c in df.columns]
    return d.select(F.when(F.col("__worse"), F.coalesce(F.try_to_timestamp(F.col("Date")), strict)).otherwise(strict).alias("ts"), num(GPE3_LAT).alias("latitude"),
                    num(GPE3_LON).alias("longitude"), *extra).dropna(subset=["ts", "latitude", "longitude"])


def slug_name(c: str) -> str:
    return re.sub(r"[^a-z0-9]+", "_", c.lower()).strip("_")


def read_gps_csv(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """UTC date and time columns to instants with positions; (0, 0) and unparsable rows are dropped."""
    df = read_csv(spark, paths)
    d, t = find_column(df, "utc_date"), find_column(df, "utc_time")
    la, lo = find_column(df, "latitude"), find_column(df, "longitude")
    text = F.concat_ws(" ", F.trim(_col(d)), F.trim(_col(t)))
    num = lambda c: F.expr(f"try_cast(`{c}` AS double)")
    return df.select(try_patterns(text, [ISO_PATTERN, "MM/dd/yyyy HH:mm:ss", "dd.MM.yyyy HH:mm:ss"]).alias("ts"), num(la).alias("latitude"), num(lo).alias("longitude")
                     ).dropna().where(~((F.col("latitude") == 0) & (F.col("longitude") == 0)))


KML_SCHEMA = "name string, TimeStamp struct<when: string>, Point struct<coordinates: string>, ExtendedData struct<Data: array<struct<_name: string, value: string>>>"


def read_kml(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Placemarks as points (ts, latitude, longitude): time from TimeStamp or from UTC_Date/UTC_Time data; markers
    of the first and last position are skipped, repeated points dropped."""
    p = spark.read.format("xml").option("rowTag", "Placemark").option("ignoreNamespace", True).schema(KML_SCHEMA).load(paths)
    p = p.where(~F.coalesce(F.trim("name"), F.lit("")).isin("First Position Mark", "Last Position Mark"))
    ext = lambda n: F.element_at(F.filter("ExtendedData.Data", lambda x: x["_name"] == n), 1)["value"]
    when = F.coalesce(F.try_to_timestamp(F.col("TimeStamp.when")), F.try_to_timestamp(F.concat_ws(" ", F.trim(ext("UTC_Date")), F.trim(ext("UTC_Time")))))
    xy = F.split(F.trim("Point.coordinates"), r"\s*,\s*")
    return p.select(when.alias("ts"), F.get(xy, F.lit(1)).cast("double").alias("latitude"), F.get(xy, F.lit(0)).cast("double").alias("longitude")).dropna().dropDuplicates()


def merge_locations(existing: DataFrame, new: DataFrame) -> DataFrame:
    return existing.select("ts", "latitude", "longitude").unionByName(new.select("ts", "latitude", "longitude")).dropDuplicates()


def read_intervals(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Sensor names and intervals of the ``[activated sensors]`` section of ``NN_name=`` / ``NN_interval=`` headers."""
    t = spark.read.text(paths, wholetext=True).select(F.regexp_extract("value", r"(?s)\[activated sensors\](.*?)(?:\r?\n\r?\n|\r?\n\[|$)", 1).alias("s"))
    names = F.regexp_extract_all("s", F.lit(r"(?m)^\s*(\d{2})_name=(.*?)\s*$"), 0)
    e = t.select("s", F.explode(names).alias("line"))
    e = e.select("s", F.regexp_extract("line", r"(\d{2})_name", 1).alias("id"), F.lower(F.trim(F.regexp_extract("line", r"_name=(.*)", 1))).alias("signal"))
    iv = t.select(F.explode(F.regexp_extract_all("s", F.lit(r"\d{2}_interval=\d+"), 0)).alias("line")).select(
        F.substring("line", 1, 2).alias("id"), F.regexp_extract("line", r"=(\d+)", 1).cast("bigint").alias("interval"))
    return e.select("id", "signal").join(iv, "id").select("signal", "interval")


# Columns of the accelerometer layouts.
ISO_COL, MS_COL = "Date ISO String", "UTC Milliseconds since 1970"


def accelerometer_layout(df: DataFrame) -> str:
    """``clean`` (ISO and ms), ``iso_only``, ``combined`` (one date-time column) or an error; read off the schema."""
    have = set(df.columns)
    if {ISO_COL, MS_COL} <= have:
        return "clean"
    if ISO_COL in have:
        return "iso_only"
    if any(slug_name(c) in ("utc_datetime", "utc_date_time", "datetime_utc") for c in have) or any(slug_name(c) == "utc_date" for c in have):
        return "combined"
    raise ValueError(f"unknown accelerometer layout {sorted(have)}")


def standardize_accelerometer(df: DataFrame) -> DataFrame:
    """``ts`` from the layout's columns (milliseconds are the truth) and ``off``, where ISO and ms differ by over 5 ms."""
    kind = accelerometer_layout(df)
    if kind == "combined":
        by = {slug_name(c): c for c in df.columns}
        one = next((by[k] for k in ("utc_datetime", "utc_date_time", "datetime_utc") if k in by), None)
        text = _col(one) if one else F.concat_ws(" ", _col(by["utc_date"]), _col(by["utc_time"]))
        return df.withColumns({"ts": try_patterns(text, [ISO_PATTERN + ".SSS", ISO_PATTERN]), "off": F.lit(False)})
    iso = F.try_to_timestamp(_col(ISO_COL))
    if kind == "iso_only":
        return df.withColumns({"ts": iso, "off": F.lit(False)})
    ms = F.timestamp_millis(F.expr(f"try_cast(`{MS_COL}` AS bigint)"))
    return df.withColumns({"ts": F.coalesce(ms, iso), "off": F.coalesce(F.abs(F.unix_micros(iso) - F.unix_micros(ms)) > 5000, F.lit(False))})


def read_notes(spark: SparkSession, paths: str | list[str], tz: str) -> DataFrame:
    """Field notes (CSV) as event rows in UTC; rows marked deleted remove the note of the same time and key."""
    from ..operators.eventset import complete_schema
    df = read_csv(spark, paths)
    by = {slug_name(c): c for c in df.columns if c not in ("source_file", "_corrupt_record")}
    d = df.select(*[_col(c).alias(k) for k, c in by.items()])
    d = d.withColumn("ts", try_patterns(F.col("datetime"), [ISO_PATTERN, "MM/dd/yyyy HH:mm:ss"])).drop("datetime")
    d = d.withColumnsRenamed({"duration": "duration_s"}) if "duration" in d.columns else d
    casts = {c: F.expr(f"try_cast(`{c}` AS double)") for c in ("duration_s", "value") if c in d.columns}
    d = d.withColumns(casts) if casts else d
    if "deleted" in d.columns:
        gone = F.lower(F.coalesce("deleted", F.lit(""))).isin("true", "1", "yes")
        d = d.where(~gone).drop("deleted").join(d.where(gone).select("ts", "key").distinct(), ["ts", "key"], "left_anti")
    return complete_schema(d, tz, naive=True)


PROPERTY = "type string, title array<struct<plain_text: string>>, rich_text array<struct<plain_text: string>>, number double, `select` struct<name: string>, " \
           "multi_select array<struct<name: string>>, url string, relation array<struct<id: string>>, date struct<start: string>, people array<struct<name: string, id: string>>, string string, id string"


def parse_property(text: Column) -> Column:
    """Typed metadata property (JSON) to its scalar text; lists are comma-joined, empty ones and rollups null."""
    p = F.from_json(text, PROPERTY)
    join = lambda arr, f: F.nullif(F.array_join(F.filter(F.transform(arr, lambda x: x[f]), lambda v: F.coalesce(v, F.lit("")) != ""), ", "), F.lit(""))
    t = p["type"]
    people = F.nullif(F.array_join(F.transform(p["people"], lambda x: F.coalesce(x["name"], x["id"])), ", "), F.lit(""))
    return (F.when(t == "title", join(p["title"], "plain_text")).when(t == "rich_text", join(p["rich_text"], "plain_text"))
            .when(t == "number", p["number"].cast("string")).when(t == "select", p["select"]["name"]).when(t == "multi_select", join(p["multi_select"], "name"))
            .when(t == "url", p["url"]).when(t == "relation", join(p["relation"], "id")).when(t == "date", p["date"]["start"]).when(t == "people", people)
            .when(t == "rollup", F.lit(None).cast("string")).otherwise(F.coalesce(p["number"].cast("string"), p["string"], p["id"])))


def relation_ids(text: Column) -> Column:
    """Related ids of a relation property as an array."""
    return F.transform(F.from_json(text, PROPERTY)["relation"], lambda x: x["id"])


def read_mapping(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Channel mapping rows with normalised keys, one per original channel (the first by file order of its name)."""
    m = read_csv(spark, paths)
    cols = ["original_channel_id", "original_unit", "manufacturer_signal_name", "standardized_channel_id", "standardized_unit", "parent_signal"]
    m = m.select(*[F.trim(c).alias(c) for c in cols if c in m.columns]).withColumn("key", slug(F.col("original_channel_id")))
    rest = [c for c in m.columns if c != "key"]
    return m.groupBy("key").agg(F.min_by(F.struct(*rest), F.struct(*rest)).alias("r")).select("key", "r.*")


def missing_mappings(channels: DataFrame, mapping: DataFrame) -> DataFrame:
    """Logger channels without a mapping. ``channels``: logger_id, channel."""
    c = channels.select("logger_id", "channel").distinct().withColumn("key", slug(F.col("channel")))
    return c.join(mapping.select("key"), "key", "left_anti")


def deployment_essentials(deployments: DataFrame, animals: DataFrame, recordings: DataFrame) -> DataFrame:
    """Deployment rows with their animal and the number of recordings, joined on ids."""
    r = recordings.groupBy("deployment_id").agg(F.count(F.lit(1)).alias("n_recordings"), F.array_join(F.array_sort(F.collect_set("logger_id")), "|").alias("loggers"))
    return deployments.join(animals, "animal_id", "left").join(r, "deployment_id", "left").fillna(0, ["n_recordings"])
