"""Media files, mounts, gazetteers and messages as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Endings of files that are indexed, with their types.
TYPES = {
    "jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "gif": "image/gif", "webp": "image/webp", "heic": "image/heic", "heif": "image/heif", "bmp": "image/bmp", "tif": "image/tiff", "tiff": "image/tiff",
    "mp4": "video/mp4", "mov": "video/quicktime", "m4v": "video/x-m4v", "avi": "video/x-msvideo", "mkv": "video/x-matroska", "webm": "video/webm", "3gp": "video/3gpp",
}


def ending(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def mime_type(path: Column, head: Column | None = None) -> Column:
    """By the file's ending; of an unknown one by its first bytes."""
    known = F.element_at(F.create_map(*[F.lit(x) for pair in TYPES.items() for x in pair]), ending(path))
    if head is None:
        return known
    start = lambda n: F.hex(F.substring(head, 1, n))
    sniffed = F.when(start(3) == "FFD8FF", "image/jpeg").when(start(8) == "89504E470D0A1A0A", "image/png").when(start(4) == "47494638", "image/gif").when(F.hex(F.substring(head, 5, 4)) == "66747970", "video/mp4")
    return F.coalesce(known, sniffed)


def oversize(width: Column, height: Column, most: int) -> Column:
    """More pixels than a model takes."""
    return width * height > most


def media_files(spark: SparkSession, folder: str, excluded: tuple[str, ...] = (), content: bool = False) -> DataFrame:
    """Indexable files below a folder: path, size, modified[, content]. Hidden folders, snapshots and excluded ones are left out.

    Listing is Spark's own; content is read only where it is asked for.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    parts = F.split(F.regexp_replace("path", r"^[a-z]+:/+", "/"), "/")
    hidden = F.exists(F.slice(parts, 1, F.size(parts) - 1), lambda p: p.startswith(".") & (p != "."))
    out = files.filter(F.array_contains(F.array(*[F.lit(x) for x in TYPES]), ending(F.col("path"))) & ~hidden)
    for x in excluded:
        out = out.filter(~F.contains(F.col("path"), F.lit(f"/{x.strip('/')}/")))
    own = out.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"), *(["content"] if content else []))
    return own.withColumn("mime_type", mime_type(F.col("path"), F.substring("content", 1, 16) if content else None))


def scan_difference(found: DataFrame, catalog: DataFrame) -> DataFrame:
    """(path, action): files to add, to index again (size or time differ), and to drop, of a folder's scan."""
    old = catalog.select("path", F.col("size").alias("__s"), F.col("modified").alias("__m"), F.lit(True).alias("__o"))
    both = found.select("path", "size", "modified", F.lit(True).alias("__n")).join(old, "path", "full_outer")
    action = F.when(F.col("__o").isNull(), "add").when(F.col("__n").isNull(), "drop").when((F.col("size") != F.col("__s")) | (F.col("modified") != F.col("__m")), "again")
    return both.select("path", action.alias("action")).filter("action IS NOT NULL")


def scan_roots(spark: SparkSession, mounts: str, excluded: tuple[str, ...] = ()) -> DataFrame:
    """Folders to scan, from a mount table in text form: local disks, without those of the system."""
    system = ("/proc", "/sys", "/dev", "/run", "/boot", "/etc", "/var", "/usr", "/snap", *excluded)
    fields = F.split(F.col("value"), r"\s+")
    rows = spark.read.text(mounts).select(fields[0].alias("device"), fields[1].alias("root"), fields[2].alias("kind"))
    remote = F.col("kind").isin("nfs", "nfs4", "cifs", "smb3", "fuse.sshfs", "tmpfs", "proc", "sysfs", "overlay")
    bad = F.lit(False)
    for x in system:
        bad = bad | (F.col("root") == x) | F.col("root").startswith(f"{x}/")
    return rows.filter((F.col("root") != "/") & ~remote & ~bad).select("root").distinct().orderBy("root")


def volume_roots(paths: DataFrame, id_column: str, path: str, roots: DataFrame) -> DataFrame:
    """(id, root): the longest root that a path begins with. Each path is split into its beginnings, so this is an equality join."""
    parts = F.split(F.col(path), "/")
    beginnings = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.concat(F.array_join(F.slice(parts, 1, i), "/"), F.when(i < F.size(parts), "/").otherwise("")))
    spread = paths.select(id_column, F.explode(beginnings).alias("root"))
    return spread.join(roots, "root").groupBy(id_column).agg(F.max_by("root", F.length("root")).alias("root"))


def gazetteer(spark: SparkSession, cities: str, countries: str) -> tuple[DataFrame, DataFrame]:
    """Cities and countries from tab-separated files; short and broken rows are skipped."""
    schema = "key int, name string, t_lat double, t_lon double, iso2 string, admin1 string, population long"
    own = spark.read.csv(cities, sep="\t", schema=schema, mode="DROPMALFORMED", quote="").filter("key IS NOT NULL AND t_lat IS NOT NULL AND t_lon IS NOT NULL")
    return own, spark.read.csv(countries, sep="\t", schema="iso2 string, name string, continent string", mode="DROPMALFORMED", quote="").filter("iso2 IS NOT NULL")


def landmarks(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.csv(path, sep="\t", schema="name string, t_lat double, t_lon double", mode="DROPMALFORMED", quote="")
    return rows.filter("t_lat IS NOT NULL AND t_lon IS NOT NULL").withColumn("key", F.xxhash64("name", "t_lat", "t_lon"))


def event_paths(messages: DataFrame, name: str, column: str = "value") -> DataFrame:
    """Paths in messages of one name, whose properties hold them as a JSON list in a string. Broken messages give none."""
    body = F.from_json(F.col(column).cast("string"), "name string, properties struct<paths: string>")
    rows = messages.withColumn("__b", body).filter(F.col("__b.name") == name)
    return rows.select(*messages.columns, F.explode(F.from_json("__b.properties.paths", "array<string>")).alias("path")).filter("path <> ''")


def video_probe(probes: DataFrame, column: str = "json") -> DataFrame:
    """Duration, size, codecs, frame rate, rotation, time and place of a prober's JSON."""
    from glimmer.functions.scalars import fraction, iso6709, rotation

    stream = "struct<codec_type: string, codec_name: string, width: int, height: int, avg_frame_rate: string, side_data_list: array<struct<rotation: double>>, tags: map<string, string>>"
    body = F.from_json(column, f"streams array<{stream}>, format struct<duration: string, bit_rate: string, tags: map<string, string>>")
    rows = probes.withColumn("__b", body)
    of = lambda kind: F.try_element_at(F.filter("__b.streams", lambda s: s["codec_type"] == kind), F.lit(1))
    turn = F.coalesce(F.try_element_at(of("video")["side_data_list"], F.lit(1))["rotation"], of("video")["tags"]["rotate"].try_cast("double"), F.lit(0.0))
    tags = F.col("__b.format.tags")
    place = iso6709(F.coalesce(tags["location"], tags["com.apple.quicktime.location.ISO6709"]))
    return rows.select(
        *probes.columns,
        (F.col("__b.format.duration").try_cast("double") * 1000).cast("long").alias("duration_ms"),
        F.col("__b.format.bit_rate").try_cast("double").alias("bit_rate"),
        of("video")["codec_name"].alias("video_codec"),
        of("audio")["codec_name"].alias("audio_codec"),
        of("video")["width"].alias("width"),
        of("video")["height"].alias("height"),
        fraction(of("video")["avg_frame_rate"]).alias("frame_rate"),
        rotation(turn.cast("int")).alias("rotation"),
        F.try_to_timestamp(tags["creation_time"]).alias("taken_at"),
        place["lat"].alias("latitude"),
        place["lon"].alias("longitude"),
    )
