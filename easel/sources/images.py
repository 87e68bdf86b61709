"""Sources and sinks: image folders, sidecar texts, vocabularies, grouped and checked outputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from easel.functions.names import resolve_collisions, stem_of
from easel.plans.ship import ship

# The extensions of images, and the category codes of tags.
EXTENSIONS = ("png", "jpg", "jpeg", "webp", "bmp", "gif", "tiff", "tif", "avif")
CATEGORIES = {"general": 0, "artist": 1, "copyright": 3, "character": 4, "meta": 5, "rating": 9}


def _is_image(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1)).isin(*EXTENSIONS)


def read_image_index(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """(file, name, size, modified) of the images in a folder, by extension; contents aren't read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
    return found.where(_is_image(F.col("path"))).select(F.col("path").alias("file"), F.regexp_extract("path", r"([^/]*)$", 1).alias("name"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def read_images(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """(file, ok, error, height, width, channels, data): decoded images, BGR or BGRA; one that can't be decoded is a
    row with ok false."""
    i = spark.read.format("image").option("dropInvalid", False).option("recursiveFileLookup", str(recursive).lower()).load(path).select("image.*")
    ok = F.col("height") > 0
    return i.select(F.col("origin").alias("file"), ok.alias("ok"), F.when(~ok, "cannot be decoded").alias("error"), "height", "width", F.col("nChannels").alias("channels"), "data")


def sidecar_of(file: Column, folder: str | None = None) -> Column:
    """Where an image's text lies: <stem>.txt beside it, or in one folder."""
    where = F.regexp_extract(file, r"^(.*/)?", 1) if folder is None else F.lit(folder.rstrip("/") + "/")
    return F.concat(where, stem_of(file), F.lit(".txt"))


def _plain(path: Column) -> Column:
    """A path without its scheme and with single slashes, as paths of one file are written in several ways."""
    return F.regexp_replace(F.regexp_replace(path, r"^[a-z][a-z0-9]*:/*", "/"), "/+", "/")


def read_sidecars(spark: SparkSession, images: DataFrame, path: str, file: str = "file", folder: str | None = None) -> DataFrame:
    """images with text: the trimmed content of their sidecar_of(), '' where there is none. path is what is read, with
    all folders below it; a text belongs to the images of its folder and stem, or, where folder is given, to all images
    of its stem."""
    texts = spark.read.option("wholetext", True).option("pathGlobFilter", "*.txt").option("recursiveFileLookup", "true").text(path if folder is None else folder)
    texts = texts.select(F.col("value").alias("_text"), _plain(F.url_decode(F.regexp_replace(F.col("_metadata.file_path"), r"\+", "%2B"))).alias("_p"))
    own = _plain(sidecar_of(F.col(file), folder))
    return images.join(texts, own == F.col("_p"), "left").withColumn("text", F.coalesce(F.trim("_text", F.lit(" \t\r\n")), F.lit(""))).drop("_p", "_text")


def write_sidecars(df: DataFrame, path: str, file: str = "file", text: str = "text") -> DataFrame:
    """Save (file, text) as a table at path, replacing what is there, and return a row of counts: saved, failed.
    A row without a file fails."""
    df.where(F.col(file).isNotNull()).select(file, F.coalesce(F.col(text), F.lit("")).alias("text")).write.mode("overwrite").parquet(path)
    return df.agg(F.count_if(F.col(file).isNotNull()).alias("saved"), F.count_if(F.col(file).isNull()).alias("failed"))


def write_sidecar_files(df: DataFrame, folder: str | None = None, file: str = "file", text: str = "text") -> DataFrame:
    """Save each row's text as its sidecar_of(), replacing those that are there, and return counts as write_sidecars().

    All or nothing but for the moves at the end: tasks write beside the targets under the job's own name, which is moved
    into place when all are done, or removed when one has failed. Where rows name one file, the one of the largest text stays.
    """
    from .sidecars import SidecarFiles

    df.sparkSession.dataSource.register(SidecarFiles)
    ship(df.sparkSession)
    rows = df.where(F.col(file).isNotNull()).select(sidecar_of(F.col(file), folder).alias("path"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows.groupBy("path").agg(F.max("text").alias("text")).write.format(SidecarFiles.name()).mode("append").save()
    return df.agg(F.count_if(F.col(file).isNotNull()).alias("saved"), F.count_if(F.col(file).isNull()).alias("failed"))


def read_vocab(spark: SparkSession, path: str, layout: str) -> DataFrame:
    """(idx, name, category) of a tag vocabulary.

    csv: columns name and category, by line. index: a JSON object of number to name or to {name, category}. mapping:
    {"idx_to_tag": {..}, "tag_to_category": {..}}. Keys are ordered as numbers; unknown categories are 0. A
    vocabulary is one model's output layer, so a single file.
    """
    code = F.lit(None).cast("int")
    for name, number in CATEGORIES.items():
        code = F.when(F.lower("category") == name, number).otherwise(code)
    category = F.coalesce(F.col("category").try_cast("int"), code, F.lit(0)).alias("category")
    if layout == "csv":
        rows = spark.read.option("header", True).csv(path).select(F.monotonically_increasing_id().alias("key"), "name", "category")
    else:
        raw = spark.read.option("wholetext", True).text(path)
        if layout == "index":
            rows = raw.select(F.explode(F.from_json("value", "map<string,string>")).alias("key", "v"))
            plain = F.get_json_object("v", "$.name")
            rows = rows.select(F.col("key").try_cast("long").alias("key"), F.coalesce(plain, "v").alias("name"), F.get_json_object("v", "$.category").alias("category"))
        elif layout == "mapping":
            parts = raw.select(F.from_json(F.get_json_object("value", "$.idx_to_tag"), "map<string,string>").alias("t"), F.from_json(F.get_json_object("value", "$.tag_to_category"), "map<string,string>").alias("c"))
            rows = parts.select("c", F.explode("t").alias("key", "name")).select(F.col("key").try_cast("long").alias("key"), "name", F.try_element_at("c", F.col("name")).alias("category"))
        else:
            raise ValueError(f"unknown layout {layout}")
    from pyspark.sql import Window

    return rows.where("key is not null").select((F.row_number().over(Window.orderBy("key")) - 1).alias("idx"), "name", category)


def save_grouped(df: DataFrame, path: str, group: str = "group", name: str = "name", order: str = "file") -> DataFrame:
    """Write rows under path/folder=group_<group + 1>/ with names unique within it; rows without a group are left
    out. Returns what was written."""
    grouped = df.where(F.col(group).isNotNull()).withColumn("folder", F.concat(F.lit("group_"), (F.col(group) + 1).cast("string")))
    full = grouped.withColumn("_full", F.concat_ws("/", "folder", name))
    out = resolve_collisions(full, "_full", order).withColumn("saved_name", F.regexp_extract("unique_name", r"([^/]*)$", 1)).drop("_full", "unique_name")
    out.write.mode("overwrite").partitionBy("folder").parquet(path)
    return df.sparkSession.read.parquet(path)


def save_output(df: DataFrame, path: str, name: str = "name", order: str = "file", existing: DataFrame | None = None) -> DataFrame:
    """Write selected rows with names that collide neither among themselves nor with existing ones."""
    out = resolve_collisions(df, name, order, existing, first=2 if existing is not None else 1)
    out.withColumnRenamed("unique_name", "saved_name").write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def quarantine(df: DataFrame, rejected: Column, file: str = "file", existing: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(kept, rejected with target): rejected rows go to the folder del beside their file, numbered from 2 where the
    name is taken."""
    out = df.withColumn("_rejected", F.coalesce(rejected, F.lit(False)))
    gone = out.where("_rejected").drop("_rejected").withColumn("_t", F.concat(F.regexp_extract(file, r"^(.*/)?", 1), F.lit("del/"), F.regexp_extract(file, r"([^/]*)$", 1)))
    taken = existing.select(F.col(file).alias("_t")) if existing is not None else None
    numbered = resolve_collisions(gone, "_t", file, taken, first=2)
    return out.where("not _rejected").drop("_rejected"), numbered.withColumnRenamed("unique_name", "target").drop("_t")
