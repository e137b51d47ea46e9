"""Vehicle telemetry, category tables, feature bundles, registries and file lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nearmiss.session import cut_lineage

SIGNALS = ("timestamp LONG, speed_network DOUBLE, gyro_z DOUBLE, accel_x DOUBLE, accel_y DOUBLE, "
           "pedal_brake_state INT, turn_signal INT, steering_wheel_position DOUBLE")
TELEMETRY_SCHEMA = SIGNALS + "".join(
    f", TRACK{i}_TARGET_ID INT, TRACK{i}_X_POS_PROCESSED DOUBLE, TRACK{i}_Y_POS_PROCESSED DOUBLE, "
    f"TRACK{i}_X_VEL_PROCESSED DOUBLE, TRACK{i}_Y_VEL_PROCESSED DOUBLE" for i in range(1, 9))
BAD = "_malformed"
ROWS_PER_FILE = 2_000_000
EVENTS_PER_CHUNK = 6600
ID_PATTERN = r"(\d+)\.csv(?:\.gz)?$"


def _lines(spark: SparkSession, path: str, id_pattern: str) -> DataFrame:
    # lines end at \n alone: a \r stays in the text and counts as a byte of the file
    return spark.read.option("ignoreCorruptFiles", True).option("lineSep", "\n").option("recursiveFileLookup", True).text(path).select(
        F.col("_metadata.file_path").alias("file"), F.regexp_extract(F.col("_metadata.file_path"), id_pattern, 1).cast("long").alias("event_id"),
        "value")


def unread_files(spark: SparkSession, path: str, id_pattern: str = ID_PATTERN) -> DataFrame:
    """Files that were not read to their end, one row each: event_id, file, size, bytes_read, note. Empty files are not
    listed; they have no rows, which the gates call unreadable as well.

    The listing gives every file's size, the lines say how many bytes were read. The size of a file packed with gzip
    is the one its last four bytes state (modulo 2^32), so a file cut off or damaged inside is found too; for that
    each packed file is one value of a row, at most 2 GB.
    """
    return _unread(spark, path, id_pattern, _lines(spark, path, id_pattern))


def _unread(spark: SparkSession, path: str, id_pattern: str, lines: DataFrame) -> DataFrame:
    # files are listed once for both kinds: names of the metadata choose files before any is opened
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    is_packed = F.col("_metadata.file_name").endswith(".gz")
    named = F.regexp_extract(F.col("_metadata.file_path"), id_pattern, 1).cast("long").alias("event_id")
    plain = listed.where(~is_packed).select(
        F.col("_metadata.file_path").alias("file"), named, F.col("length").alias("size"))
    packed = listed.where(is_packed).select(
        F.col("_metadata.file_path").alias("file"), named, F.conv(F.concat(*[F.substring(F.hex(F.substring("content", -4, 4)), i, 2) for i in (7, 5, 3, 1)]), 16, 10)
        .cast("long").alias("size"))
    got = lines.groupBy("file").agg(
        F.sum(F.octet_length("value") + 1).cast("long").alias("bytes_read"))
    files = plain.unionByName(packed).join(got, "file", "left").withColumn("bytes_read", F.coalesce("bytes_read", F.lit(0).cast("long")))
    # the last line may lack its end
    whole = F.pmod(F.col("bytes_read") - F.col("size"), F.lit(1 << 32)).isin(0, 1) & (F.col("bytes_read") > 0)
    return files.where(~F.coalesce(whole, F.lit(False))).select(
        "event_id", "file", "size", "bytes_read", F.lit("file reading error").alias("note"))


def read_telemetry(
    spark: SparkSession, path: str, schema: str = TELEMETRY_SCHEMA, id_pattern: str = ID_PATTERN, header: bool = True
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows of all event files with the event id taken from the file path, the malformed lines
    (wrong number or type of fields), which are set aside instead of stopping the job (empty lines are skipped), and the files that
    could not be read to their end (`unread_files`). Of those no row is kept, so their events have no rows."""
    lines = _lines(spark, path, id_pattern)
    unread = cut_lineage(_unread(spark, path, id_pattern, lines), "unread")
    lines = lines.join(unread.select("file"), "file", "left_anti").select(
        "event_id", F.regexp_replace("value", r"\r$", "").alias("value")).where("value <> ''")
    if header:
        lines = lines.where(~F.col("value").rlike(r'^\W*[A-Za-z_]'))
    # as rows of their own the fields are parsed once; a filter on a column would parse every line again
    parsed = lines.select("event_id", "value", F.inline(F.array(F.from_csv(
        "value", f"{schema}, {BAD} STRING", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD}))))
    broken = F.col(BAD).isNotNull()
    good = parsed.where(~broken).drop("value", BAD)
    return good, parsed.where(broken).select("event_id", F.col("value").alias(BAD)), unread


def event_chunks(df: DataFrame, category: str = "event_category", event: str = "event_id", size: int = EVENTS_PER_CHUNK) -> DataFrame:
    """Adds `chunk`: events of each category are dealt to chunks of `size` by their running number, so no event lies
    in two chunks. Rows without a category or event form keys of their own."""
    from nearmiss.operators.tracks import number_groups
    events = number_groups(df.select(category, event).distinct(), category, [event], idx="_i").select(
        F.col(category).alias("_category"), F.col(event).alias("_event"), F.floor(F.col("_i") / F.lit(size)).cast("long").alias("chunk"))
    same = df[category].eqNullSafe(events["_category"]) & df[event].eqNullSafe(events["_event"])
    return df.join(events, same, "inner").drop("_category", "_event")


def write_chunks(df: DataFrame, path: str, category: str = "event_category", event: str = "event_id",
                 size: int = EVENTS_PER_CHUNK, mode: str = "overwrite") -> None:
    """One folder per category and chunk of whole events. A chunk is one file as long as it is of common size;
    adaptive execution splits the files of a larger one, as with a single event that holds most of the rows."""
    event_chunks(df, category, event, size).hint("rebalance", category, "chunk").write.mode(mode).partitionBy(category, "chunk").parquet(path)


def write_partitioned(df: DataFrame, path: str, column: str = "event_category", mode: str = "overwrite") -> None:
    """One folder per category and files of bounded size. Rows are spread inside each category, so a
    large category is written by many tasks."""
    df.write.mode(mode).partitionBy(column).option("maxRecordsPerFile", ROWS_PER_FILE).parquet(path)


def read_category_tables(spark: SparkSession, path: str, categories: Sequence[str] | None = None,
                         column: str = "event_category") -> DataFrame:
    """The category tables as one; with a choice of categories only their folders are read."""
    df = spark.read.parquet(path)
    return df.where(F.col(column).isin(*categories)) if categories else df


def write_feature_bundle(features: DataFrame, path: str) -> None:
    """Context features, history, environment and spacing per frame, with their keys."""
    features.select("event_id", "target_id", "k", "time", "profiles", "current", "environment", "spacing").write.mode(
        "overwrite").option("maxRecordsPerFile", ROWS_PER_FILE).parquet(path)


def read_feature_bundle(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def feature_bundle(scenes: DataFrame, current: Sequence[str], environment: Sequence[str] = ()) -> DataFrame:
    """Scenes packed into array columns."""
    return scenes.select(
        "event_id", "target_id", "k", "time", "profiles", F.array(*[F.col(c).cast("double") for c in current]).alias("current"),
        F.array(*[F.col(c).cast("double") for c in environment]).alias("environment") if environment
        else F.array().cast("array<double>").alias("environment"), F.col("s").alias("spacing"))


def unnest_ragged(scenarios: DataFrame) -> DataFrame:
    """Scenario rows (scenario, index, timestep, motion, category) as one row per object and moment.
    Object i owns positions index[i] .. index[i+1] - 1; object 0 is the ego."""
    objects = scenarios.select(
        "scenario", "timestep", "motion", "index", F.posexplode("category").alias("object_id", "veh_type")
    ).withColumns({"_a": F.expr("index[object_id]"), "_b": F.expr("try_element_at(index, object_id + 2)")})
    rows = objects.select(
        "scenario", "object_id", "veh_type",
        F.inline(F.arrays_zip(
            F.slice("timestep", F.col("_a") + 1, F.coalesce(F.col("_b"), F.size("timestep")) - F.col("_a")).alias("time"),
            F.slice("motion", F.col("_a") + 1, F.coalesce(F.col("_b"), F.size("timestep")) - F.col("_a")).alias("m"))))
    names = ("x", "y", "vx", "vy", "ax", "ay", "psi")
    return rows.select("scenario", "object_id", "veh_type", "time", *[F.col("m")[i].alias(n) for i, n in enumerate(names)])


def scenario_pairs(objects: DataFrame) -> DataFrame:
    """Ego and each other object of a scenario on common moments, with target ids that are unique over
    all scenarios: ids run on, scenario after scenario."""
    from nearmiss.operators.tracks import number_ranges
    ego = objects.where("object_id = 0").drop("object_id").withColumnsRenamed(
        {c: f"{c}_ego" for c in objects.columns if c not in ("scenario", "object_id", "time")})
    sur = objects.where("object_id > 0").withColumnsRenamed(
        {c: f"{c}_sur" for c in objects.columns if c not in ("scenario", "object_id", "time")})
    both = ego.join(sur, ["scenario", "time"], "inner")
    # the numbering reads its rows twice; they are worked out once, from the keys alone
    met = sur.select("scenario", "time", "object_id").join(ego.select("scenario", "time"), ["scenario", "time"], "left_semi")
    keys = cut_lineage(met.select("scenario", "object_id").distinct(), "keys")
    ids = number_ranges(keys, ["scenario", "object_id"], idx="target_id")
    return both.join(ids, ["scenario", "object_id"], "inner").drop("object_id")


def file_manifest(files: DataFrame, order: str = "seq") -> DataFrame:
    """One row per event with its time-series file and front, rear and hands videos, from a table of
    file names (name, seq). Names with 'Fast' are skipped; the last file of a kind counts."""
    kind = (F.when(F.col("name").endswith(".csv"), "time_series")
            .when(F.col("name").contains("Front"), "video_front").when(F.col("name").contains("Rear"), "video_rear")
            .when(F.col("name").contains("Hands"), "video_hands"))
    stem = F.substring_index("name", ".", 1)
    event = F.when(F.col("name").endswith(".csv"), F.substring_index(stem, "_", -1)).otherwise(
        F.regexp_extract("name", r"(?:Index|ID)_(\d+)", 1))
    known = files.where(~F.col("name").contains("Fast")).where(
        F.col("name").rlike(r"\.(csv|avi|mp4)$")).withColumns({"kind": kind, "event_id": event.cast("long")})
    return known.groupBy("event_id").pivot("kind", ["time_series", "video_front", "video_rear", "video_hands"]).agg(
        F.max_by("name", F.col(order)))


def upsert_registry(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """New rows replace old ones of the same key (missing key parts match each other), others are added."""
    match = None
    for k in keys:
        cond = old[k].eqNullSafe(new[k])
        match = cond if match is None else match & cond
    return old.join(new, match, "left_anti").unionByName(new, allowMissingColumns=True)


def resume_anti_join(todo: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Work not done yet, matched on the whole key."""
    return todo.join(done.select(*keys).distinct(), list(keys), "left_anti")


def merge_sources(a: DataFrame, b: DataFrame, dir_a: str, dir_b: str) -> DataFrame:
    """All events of two sources (event_id, time_series), the file of b preferred."""
    both = a.select("event_id", F.col("time_series").alias("time_series_a")).join(
        b.select("event_id", F.col("time_series").alias("time_series_b")), "event_id", "full_outer")
    has_b: Column = F.col("time_series_b").isNotNull()
    return both.withColumns({
        "file_dir": F.when(has_b, dir_b).otherwise(dir_a), "file2use": F.coalesce("time_series_b", "time_series_a")})
