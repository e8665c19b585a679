"""Reading picture folders, catalogues, label files and logs as DataFrames.

Missing folders give empty DataFrames with the stated columns; unreadable values give
nulls or are skipped where so stated, never an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.operators.regions import normalized_box, parse_label_text

#: The suffixes of pictures.
IMAGE_SUFFIXES = ("jpg", "jpeg", "png", "webp", "bmp")
BOX = "struct<xc:double,yc:double,width:double,height:double>"


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def list_images(spark: SparkSession, root: str, *, digest: bool = False) -> DataFrame:
    """(path, name, bytes, modified[, sha256]) of all pictures below a folder; the content is read only for the digest."""
    schema = "path string, name string, bytes bigint, modified timestamp" + (", sha256 string" if digest else "")
    if not _exists(spark, root):
        return spark.createDataFrame([], schema)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    files = files.where(F.lower("path").rlike(rf"\.({'|'.join(IMAGE_SUFFIXES)})$"))
    out = [F.col("path"), F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified")]
    return files.select(*out, *([F.sha2("content", 256).alias("sha256")] if digest else []))


def split_and_class(path: Column, root: str) -> tuple[Column, Column]:
    """(split, class) from root/split/class/file or root/class/file; the split is null in the second."""
    parts = F.split(F.element_at(F.split(path, F.lit(root.rstrip("/") + "/"), 2), -1), "/")
    n = F.size(parts)
    return F.when(n >= 3, parts[0]), F.when(n >= 3, parts[1]).when(n == 2, parts[0])


def stem(name: Column) -> Column:
    return F.regexp_extract(name, r"(?s)^(.+?)(\.[^.]*)?$", 1)


def read_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """(class_name, display_name, price_vnd, reward_points, note): a CSV with header and perhaps a byte-order mark; of a class listed twice the last row holds.

    Blank reward_points become one for each 1000 begun, at least one.
    """
    text = spark.read.schema("class_name string, display_name string, price_vnd string, reward_points string, note string")
    rows = text.option("header", True).option("encoding", "UTF-8").csv(path)
    rows = rows.withColumn("_at", F.monotonically_increasing_id())
    price = F.trim("price_vnd").try_cast("bigint")
    points = F.coalesce(F.trim("reward_points").try_cast("bigint"), F.greatest(F.lit(1), F.ceil(price / 1000)))
    rows = rows.select(F.trim("class_name").alias("class_name"), "display_name", price.alias("price_vnd"), points.alias("reward_points"), F.coalesce("note", F.lit("")).alias("note"), "_at")
    last = F.max_by(F.struct("display_name", "price_vnd", "reward_points", "note"), "_at").alias("r")
    return rows.where("class_name is not null and class_name != ''").groupBy("class_name").agg(last).select("class_name", "r.*")


def read_class_names(spark: SparkSession, path: str) -> DataFrame:
    """(class_idx, class_name) of a JSON array of names."""
    return spark.read.text(path, wholetext=True).select(F.posexplode(F.from_json("value", "array<string>")).alias("class_idx", "class_name"))


def read_regions(spark: SparkSession, path: str) -> DataFrame:
    """(k, name, x, y, w, h, label, source, confidence) of a JSON list of regions or an object that holds one."""
    one = "struct<name:string,x:bigint,y:bigint,w:bigint,h:bigint,label:string,source:string,confidence:double>"
    raw = spark.read.text(path, wholetext=True)
    rows = F.coalesce(F.from_json("value", f"struct<regions:array<{one}>>")["regions"], F.from_json("value", f"array<{one}>"))
    d = raw.select(F.posexplode(rows).alias("k", "r"))
    return d.select("k", F.coalesce("r.name", F.format_string("crop_%02d", F.col("k") + 1)).alias("name"), "r.x", "r.y", "r.w", "r.h", "r.label", F.coalesce("r.source", F.lit("template")).alias("source"), "r.confidence")


def regions_json(regions: DataFrame) -> DataFrame:
    """(json): one document of regions in order; confidence to six digits, empty labels and null confidences left out."""
    label = F.when(F.coalesce("label", F.lit("")) != "", F.col("label")).alias("label")
    one = F.struct("k", F.struct("name", "x", "y", "w", "h", label, "source", F.round("confidence", 6).alias("confidence")).alias("r"))
    return regions.agg(F.to_json(F.struct(F.transform(F.array_sort(F.collect_list(one)), lambda s: s["r"]).alias("regions"))).alias("json"))


def read_label_pictures(spark: SparkSession, root: str, *, min_area: float = 0.005) -> DataFrame:
    """(split, name, boxes, raw_count) from root/split/images and root/split/labels/stem.txt; pictures without a valid box are kept with an empty array.

    Whoever wants only usable pictures filters on size(boxes) > 0.
    """
    pictures = list_images(spark, root)
    folder = F.element_at(F.split("path", "/"), -3)
    pictures = pictures.where(F.element_at(F.split("path", "/"), -2) == "images").select(folder.alias("split"), "name", stem(F.col("name")).alias("stem"))
    texts = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.txt").select("value", F.col("_metadata.file_path").alias("p"))
    parts = F.split("p", "/")
    labels = texts.where(F.element_at(parts, -2) == "labels").select(F.element_at(parts, -3).alias("split"), stem(F.element_at(parts, -1)).alias("stem"), F.col("value"))
    boxes, raw = parse_label_text(F.col("value"), min_area=min_area)
    return pictures.join(labels, ["split", "stem"], "left").select("split", "name", boxes.alias("boxes"), raw.alias("raw_count"))


def read_coco(spark: SparkSession, path: str, *, min_area: float = 0.005) -> DataFrame:
    """(name, boxes, raw_count) of a COCO document; pictures without annotations do not appear."""
    schema = "images array<struct<id:bigint,file_name:string,width:double,height:double>>, annotations array<struct<image_id:bigint,bbox:array<double>>>"
    doc = spark.read.schema(schema).json(path, multiLine=True)
    i = doc.select(F.explode("images").alias("i")).select("i.*")
    a = doc.select(F.posexplode("annotations").alias("k", "a")).select("k", "a.*")
    at = lambda n: F.try_element_at("bbox", F.lit(n))
    box = normalized_box(at(1), at(2), at(1) + at(3), at(2) + at(4), F.col("width"), F.col("height"), min_area=min_area)
    joined = i.join(a, i.id == a.image_id).select("id", "file_name", F.struct("k", box.alias("b")).alias("s"))
    got = joined.groupBy("id", "file_name").agg(F.array_sort(F.collect_list("s")).alias("s"), F.count("*").alias("raw_count"))
    return got.select(F.col("file_name").alias("name"), F.array_compact(F.col("s.b")).alias("boxes"), "raw_count")


def read_box_lines(spark: SparkSession, path: str, sizes: DataFrame, *, min_area: float = 0.005) -> DataFrame:
    """(name, boxes, raw_count) of lines 'file x1,y1,x2,y2,c ...'; only parts of exactly five fields count.

    sizes: name, width, height of the pictures.
    """
    lines = spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("p")).where("p[0] != ''")
    fields = F.filter(F.transform(F.slice("p", 2, F.greatest(F.size("p") - 1, F.lit(0))), lambda x: F.split(x, ",")), lambda f: F.size(f) == 5)
    d = lines.select(F.element_at(F.split(F.col("p")[0], "/"), -1).alias("name"), F.transform(fields, lambda f: F.transform(f, lambda v: v.try_cast("double"))).alias("f")).join(sizes, "name")
    box = lambda f: F.when(F.forall(F.slice(f, 1, 4), lambda x: x.isNotNull()), normalized_box(f[0], f[1], f[2], f[3], F.col("width"), F.col("height"), min_area=min_area))
    return d.select("name", F.array_compact(F.transform("f", box)).alias("boxes"), F.size("f").alias("raw_count"))


def read_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV with header under the given schema; a missing file has no rows."""
    if not _exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("header", True).csv(path)


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """(query) of a text file, one a line; blank lines and comments (#) skipped."""
    return spark.read.text(path).select(F.trim("value").alias("query")).where("query != '' and not startswith(query, '#')")


def read_dataset(spark: SparkSession, path: str, layout: str, *, sizes: DataFrame | None = None, min_area: float = 0.005) -> DataFrame:
    """(name, boxes, raw_count) of a data set in one of three layouts: labels (split folders), coco (one document), lines (with the sizes of the pictures)."""
    if layout == "labels":
        return read_label_pictures(spark, path, min_area=min_area).select("name", "boxes", "raw_count")
    if layout == "coco":
        return read_coco(spark, path, min_area=min_area)
    if layout == "lines" and sizes is not None:
        return read_box_lines(spark, path, sizes, min_area=min_area)
    raise ValueError("layout is labels, coco, or lines with sizes")
