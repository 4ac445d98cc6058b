"""Readers and writers of the library's files, on Spark's own sources."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from . import schemas


def gtfs(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """SRC-1. A timetable table, every column text. Columns are taken by header, so files may have more, in any order."""
    wanted = schemas.GTFS[name]
    read = spark.read.option("header", True).option("encoding", "UTF-8").option("inferSchema", False).csv(f"{folder}/{name}.txt")
    return read.select(*[F.col(f"`{c}`") if c in read.columns else F.lit(None).cast("string").alias(c) for c in wanted.names])


def fixed_order(spark: SparkSession, path: str) -> DataFrame:
    """SRC-2. code, country, minutes, name from a latin-1 comma file with one header line; fields trimmed, codes upper."""
    x = spark.read.option("encoding", "ISO-8859-1").option("header", True).schema(schemas.strings("code", "country", "minutes", "name")).option("enforceSchema", True).csv(path)
    t = {c: F.trim(c) for c in x.columns}
    return x.select(F.upper(t["code"]).alias("code"), t["country"].alias("country"), t["minutes"].try_cast("int").alias("minutes"), t["name"].alias("name")).filter("code <> ''")


def sections(spark: SparkSession, path: str) -> DataFrame:
    """SRC-3. Files of "#station" lines, each followed by "-attribute" lines: station, attributes (sorted set). A file is
    one row, so its order is kept; the header is filled down inside the file."""
    lines = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", "\r?\n")).alias("n", "line"))
    head = F.when(F.col("line").startswith("#"), F.upper(F.trim(F.expr("substring(line, 2)"))))
    x = lines.withColumn("station", F.last(head, ignorenulls=True).over(W.partitionBy("file").orderBy("n")))
    x = x.filter("station IS NOT NULL").withColumn("attribute", F.when(F.col("line").startswith("-"), F.trim(F.expr("substring(line, 2)"))))
    return x.groupBy("station").agg(F.array_sort(F.collect_set("attribute")).alias("attributes"))


def flags(sectioned: DataFrame, names: list[str]) -> DataFrame:
    """SRC-3. A column for each attribute: whether the station has it."""
    return sectioned.select("station", *[F.array_contains("attributes", n).alias(n) for n in names])


def stop_places(spark: SparkSession, path: str) -> DataFrame:
    """SRC-4. Rail stop places of an accessibility file (XML, may be gzipped): code, uic, name, quays, lifts. One gzip file is
    one task; the rows are dealt out after it."""
    x = spark.read.format("xml").option("rowTag", "StopPlace").option("ignoreNamespace", True).schema(schemas.STOP_PLACE).load(path)
    x = x.filter("TransportMode = 'rail'").repartition(spark.sparkContext.defaultParallelism)
    code = F.upper(F.regexp_replace(F.coalesce("privateCodes.PrivateCode", F.lit("")), "^NL:S:", ""))
    return x.select(code.alias("code"), F.substring_index("_id", ":", -1).alias("uic"), F.coalesce(F.col("Name"), code).alias("name"), F.col("quays.Quay").alias("quays"), F.col("placeEquipments.LiftEquipment").alias("lifts"))


def quays(places: DataFrame) -> DataFrame:
    """SRC-4. code, id, track, type (island, track, sector), parent, status, lift refs."""
    q = places.select("code", F.explode("quays").alias("q"))
    kind = F.when(F.col("q.QuayType") == "railIslandPlatform", "island").when(F.col("q.QuayType") == "railPlatformSector", "sector").otherwise("track")
    step = F.col("q.AccessibilityAssessment.limitations.AccessibilityLimitation.StepFreeAccess")
    refs = F.flatten(F.transform(F.coalesce("q.equipmentPlaces.EquipmentPlace", F.expr("array()").cast(places.schema["quays"].dataType.elementType["equipmentPlaces"].dataType["EquipmentPlace"].dataType)), lambda p: F.transform(p["placeEquipments"]["LiftEquipmentRef"], lambda r: r["_ref"])))
    return q.select("code", F.col("q._id").alias("id"), F.lower("q.PublicCode").alias("track"), kind.alias("type"), F.col("q.ParentQuayRef._ref").alias("parent"), F.when(step == "true", "yes").when(step == "false", "no").otherwise("unknown").alias("status"), refs.alias("lift_refs"))


def register(spark: SparkSession, path: str) -> DataFrame:
    """SRC-5. A semicolon file with a header and a second header row, lines of uneven length: code, status."""
    x = spark.read.option("sep", ";").option("header", True).option("mode", "PERMISSIVE").schema(schemas.strings("code", "name", "status")).option("enforceSchema", True).csv(path)
    code = F.upper(F.trim("code"))
    return x.select(code.alias("code"), F.trim("status").alias("status")).filter((code != "") & code.rlike("^[A-Z0-9]+$") & (F.lower("code") != "code"))


def newer_wins(newer: DataFrame, older: DataFrame, key: str) -> DataFrame:
    """SRC-6. Rows of newer, and of older for keys that newer lacks."""
    return newer.unionByName(older.join(newer.select(key), key, "left_anti"))


def log_lines(spark: SparkSession, folder: str) -> DataFrame:
    """SRC-7. JSON lines of a feed log, times parsed; order is left to the operators that need it."""
    x = spark.read.schema(schemas.LOG).json(folder)
    return x.withColumns({c: F.to_timestamp(c) for c in ("received", "delivery_ts", "start", "end")})


def osm_elements(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """SRC-8. Stations and elevators of a nested JSON of map elements."""
    e = spark.read.option("multiLine", True).schema(schemas.PLACES).json(path).select(F.explode("elements").alias("e"))
    x = e.select("e.id", F.coalesce("e.lat", "e.center.lat").alias("lat"), F.coalesce("e.lon", "e.center.lon").alias("lon"), "e.tags")

    def tag(name: str) -> Column:
        return F.nullif(F.try_element_at("tags", F.lit(name)), F.lit(""))

    stations = x.filter(tag("railway").isin("station", "halt")).select("id", "lat", "lon", tag("railway:ref").alias("code"), tag("name").alias("name"), tag("wheelchair").alias("wheelchair"))
    return stations, x.filter(tag("highway") == "elevator").select("id", "lat", "lon", tag("wheelchair").alias("wheelchair"))


def _unzipped(bodies: pd.Series) -> pd.Series:
    import gzip
    import zlib

    def text(b: bytes | None) -> str | None:
        try:
            return None if b is None else (gzip.decompress(b) if bytes(b[:2]) == b"\x1f\x8b" else bytes(b)).decode("utf-8", "replace")
        except (OSError, EOFError, zlib.error):  # broken gzip: no text
            return None

    return bodies.map(text)


def unzipped(body: Column) -> Column:
    """SRC-9. A message's text; gzip of a column has no built-in, so in Arrow batches."""
    return F.pandas_udf(_unzipped, StringType())(body)


def bare(xml: Column) -> Column:
    """An XML text without namespaces, for from_xml."""
    return F.regexp_replace(F.regexp_replace(xml, r"(</?)[A-Za-z0-9_.-]+:", "$1"), r"\sxmlns(:[A-Za-z0-9_.-]+)?=(\"[^\"]*\"|'[^']*')", "")


def lift_messages(messages: DataFrame, prefix: str) -> DataFrame:
    """SRC-9. messages: (id, body): id, size, heartbeat, lift, status, start, end; one row per condition of a lift with the
    prefix, one without a lift for a message without."""
    return lift_conditions(_parsed(messages.withColumn("text", unzipped(F.col("body"))), schemas.FACILITY_MESSAGE), prefix, "id")


def _parsed(messages: DataFrame, schema: str, options: dict[str, str] | None = None) -> DataFrame:
    """messages with m, the parsed XML in text. As the row of a generator: an expression would be parsed anew wherever it is named."""
    return messages.select("*", F.explode(F.array(F.from_xml(bare(F.col("text")), schema, options or {}))).alias("m"))


def lift_conditions(parsed: DataFrame, prefix: str, *keep: str) -> DataFrame:
    """SRC-9 of messages that are parsed (m), with the columns to keep. Streams and tables alike."""
    mine = F.filter("m.FacilityCondition", lambda c: c["FacilityRef"].startswith(prefix))
    x = parsed.select(*keep, F.coalesce(F.size(mine), F.lit(0)).alias("size"), F.col("m.HeartbeatNotification").isNotNull().alias("heartbeat"), F.explode_outer(mine).alias("c"))
    return x.select(*keep, F.greatest("size", F.lit(0)).alias("size"), "heartbeat", F.substring("c.FacilityRef", len(prefix) + 1, 1000).alias("lift"), F.when(F.col("c").isNotNull(), F.coalesce("c.FacilityStatus.Status", F.lit("unknown"))).alias("status"), F.to_timestamp("c.ValidityPeriod.StartTime").alias("start"), F.to_timestamp("c.ValidityPeriod.EndTime").alias("end"))


def journey_marks(messages: DataFrame) -> DataFrame:
    """SRC-10. messages: (id, body): date, train, mark. N if a unit of the part is N, J if all are J, else no row."""
    x = _parsed(messages.withColumn("text", unzipped(F.col("body"))), schemas.JOURNEY_MESSAGE)
    x = x.select("id", F.explode("m.RitInfo").alias("r")).select("id", F.col("r.TreinDatum").alias("date"), F.explode("r.LogischeRit").alias("r")).select("id", "date", F.explode("r.LogischeRitDeel").alias("p"))
    marks = F.transform("p.MaterieelDeel", lambda u: F.coalesce(u["MaterieelDeelToegankelijk"], F.lit("")))
    mark = F.when(F.array_contains(marks, "N"), "N").when((F.size(marks) > 0) & F.forall(marks, lambda m: m == "J"), "J")
    return x.select("id", F.to_date("date").alias("date"), F.col("p.LogischeRitDeelNummer").alias("train"), mark.alias("mark")).filter("mark IS NOT NULL AND date IS NOT NULL AND train IS NOT NULL")


def train_record(records: DataFrame) -> DataFrame:
    """SRC-11. records: (json): date, train, kind (yes, no), updated, version."""
    x = records.select(F.from_json("json", schemas.RECORD).alias("r")).select("r.v", "r.updated", F.explode("r.days").alias("date", "d"))
    both = [x.select("v", "updated", "date", F.explode(F.split(F.coalesce(f"d.{k}", F.lit("")), " ")).alias("train"), F.lit(k).alias("kind")) for k in ("yes", "no")]
    out = both[0].unionByName(both[1]).filter("train <> ''")
    return out.select(F.col("v").alias("version"), F.to_timestamp("updated").alias("updated"), F.to_date("date").alias("date"), "train", "kind")


def corrections(spark: SparkSession, path: str) -> DataFrame:
    """SRC-12. Hand-kept corrections, blank tracks null."""
    x = spark.read.option("header", True).schema(schemas.CORRECTIONS).csv(path)
    return x.withColumn("track", F.nullif(F.trim("track"), F.lit("")))


def _by_key(a: Column, b: Column) -> Column:
    return F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0)


def origin_documents(entries: DataFrame) -> DataFrame:
    """SNK-3. entries: (origin, day_type, profile, train_set, dest, k, median, fastest, per_hour, changes, via, tracks): one
    JSON document per origin, results[day][profile][train_set][dest] = levels in the order of k."""
    level = F.struct("k", F.to_json(F.array(*[F.col(c).cast("string") for c in ("median", "fastest", "per_hour", "changes", "via", "tracks")])).alias("j"))
    x = entries.groupBy("origin", "day_type", "profile", "train_set", "dest").agg(F.transform(F.array_sort(F.collect_list(level)), lambda s: s["j"]).alias("v"))
    for key in ("dest", "train_set", "profile", "day_type"):
        keys = [c for c in ("origin", "day_type", "profile", "train_set", "dest") if c in x.columns and c != key]
        x = x.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(key).cast("string").alias("key"), "v")), _by_key)).alias("v"))
    return x.select("origin", F.to_json(F.struct(F.col("v").alias("results"))).alias("json"))


def station_documents(stations: DataFrame, tracks: DataFrame) -> DataFrame:
    """SNK-4, FN-9. stations: (code, name, status); tracks: (code, track, status, main): main tracks as a sorted map."""
    t = tracks.filter("main").groupBy("code").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("track", "status")))).alias("tracks"))
    x = stations.join(t, "code", "left")
    return x.select("code", F.to_json(F.struct("code", "name", "status", "tracks")).alias("json"))


def write_sorted_csv(df: DataFrame, path: str, by: str) -> None:
    """SNK-2. Sorted CSV with a fixed column order: part files in order, each with a header."""
    df.repartitionByRange(by).sortWithinPartitions(by).write.mode("overwrite").option("header", True).csv(path)


def _pointers(spark: SparkSession, base: str) -> list[tuple[int, str, str]]:
    """(number, run, key) of the pointers that are whole, oldest first. A pointer is one small file, so few are read."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    folder = jvm.org.apache.hadoop.fs.Path(f"{base}/pointers")
    fs = folder.getFileSystem(conf)
    if not fs.exists(folder):
        return []
    names = [f.getPath().getName() for f in fs.listStatus(folder)]
    wanted = [n for n in names if n.endswith(".json") and n[:-5].isdigit()]
    if not wanted:
        return []
    rows = spark.read.schema("run string, key string").json([f"{base}/pointers/{n}" for n in wanted]).select(F.input_file_name().alias("f"), "run", "key").filter("run IS NOT NULL").collect()
    return sorted((int(r.f.rsplit("/", 1)[1][:-5]), r.run, r.key) for r in rows)


def _point(spark: SparkSession, base: str, number: int, run: str, key: str) -> None:
    """Writes a new pointer aside and renames it: the one step that publishes. A name that exists is an error, so of two writers one
    fails."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    aside, final = (jvm.org.apache.hadoop.fs.Path(f"{base}/pointers/{n}") for n in (f".{number:012d}-{uuid.uuid4().hex}", f"{number:012d}.json"))
    fs = final.getFileSystem(conf)
    out = fs.create(aside, False)
    out.write(bytearray(json.dumps({"run": run, "key": key}).encode()))
    out.close()
    if fs.exists(final) or not fs.rename(aside, final):
        fs.delete(aside, False)
        raise ValueError(f"{base}: another run was published meanwhile")


def publish(frames: dict[str, DataFrame], base: str, run: str, checks: dict[str, DataFrame], key: str | None = None) -> str:
    """SNK-1, SNK-5. Writes tables as Parquet under base/run, then runs the checks (frames of faults); only if none has a row a new
    pointer is added, in one step. Raises ValueError otherwise; what was published last stays readable whatever happens before that
    step. A key (the run's name if none is given) that was published is not published again: nothing is written and its run is given back."""
    spark = next(iter(frames.values())).sparkSession
    key = key or run
    known = _pointers(spark, base)
    if again := [r for _, r, k in known if k == key]:
        return f"{base}/{again[-1]}"
    if run in {r for _, r, _ in known}:
        raise ValueError(f"{run} is published under another key")
    for name, df in frames.items():
        df.write.mode("overwrite").parquet(f"{base}/{run}/{name}")
    if bad := [name for name, faults in checks.items() if not faults.isEmpty()]:
        raise ValueError(f"failed: {', '.join(bad)}")
    _point(spark, base, known[-1][0] + 1 if known else 1, run, key)
    return f"{base}/{run}"


def current(spark: SparkSession, base: str, name: str) -> DataFrame:
    """SNK-5. A table of the last run that passed its checks: that of the newest pointer that is whole."""
    known = _pointers(spark, base)
    if not known:
        raise ValueError(f"{base}: nothing is published")
    return spark.read.parquet(f"{base}/{known[-1][1]}/{name}")


def publish_batches(base: str, frames: Callable[[DataFrame], dict[str, DataFrame]], checks: Callable[[dict[str, DataFrame]], dict[str, DataFrame]], stream: str = "stream") -> Callable[[DataFrame, int], None]:
    """SNK-5 for foreachBatch: each batch is published as a run of its own, exactly once. The key is the stream's name and the batch's
    number, so a batch that is replayed after a crash changes nothing once its pointer is there, and is written anew before. A batch
    that fails its checks is not published and stays on disk for inspection; the stream goes on with the last good one."""

    def sink(batch: DataFrame, number: int) -> None:
        tables = frames(batch)
        # a new folder each try: a half-written one is never looked at
        try:
            publish(tables, base, f"{stream}-{number:012d}-{uuid.uuid4().hex[:8]}", checks(tables), f"{stream}-{number}")
        except ValueError as problem:
            if not str(problem).startswith("failed: "):
                raise

    return sink


def message_files(spark: SparkSession, folder: str, max_files: int = 1000) -> DataFrame:
    """SRC-9, SRC-10 as a stream: (id, received, body) of message files (plain or gzipped XML) as they land in a folder."""
    x = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").option("maxFilesPerTrigger", max_files).option("recursiveFileLookup", True).load(folder)
    return x.select(F.col("path").alias("id"), F.col("modificationTime").alias("received"), F.col("content").alias("body"))


def checked_messages(messages: DataFrame, schema: str) -> DataFrame:
    """id, received, bytes, m (the parsed body), reason: null, or why the message is none. A body that can't be unzipped or holds no XML
    element that the schema knows is none. Works on streams and tables alike; each body is parsed once."""
    x = _parsed(messages.withColumn("text", unzipped(F.col("body"))), schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    known = [f.name for f in x.schema["m"].dataType.fields if f.name != "_corrupt"]
    empty = F.lit(True)
    for name in known:
        empty = empty & F.col(f"m.{name}").isNull()
    reason = F.when(F.col("text").isNull(), "not readable").when(F.col("m").isNull() | empty, "no known element")
    return x.select("id", "received", F.length("body").alias("bytes"), "m", reason.alias("reason"))


def split_messages(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(messages with m; quarantine: id, received, bytes, reason) of checked_messages."""
    return checked.filter("reason IS NULL").drop("bytes", "reason"), checked.filter("reason IS NOT NULL").select("id", "received", "bytes", "reason")


def parsed_messages(messages: DataFrame, schema: str) -> tuple[DataFrame, DataFrame]:
    """Both parts of checked_messages, each of which reads the messages for itself; a stream that needs both runs checked_messages
    and splits what it wrote."""
    return split_messages(checked_messages(messages, schema))
