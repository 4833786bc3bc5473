"""Delimited files and star archives as DataFrames, and the index folder that a build writes."""

from __future__ import annotations

import time
import xml.etree.ElementTree as ET
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from credal.functions.taxonomy import common_name_order
from credal.operators.lineage import new_path

_NS = "{http://rs.tdwg.org/dwc/text/}"


def read_csv(spark: SparkSession, path: str, accepted: list[str] | None = None, sep: str = ",", encoding: str = "UTF-8") -> DataFrame:
    """A delimited file with a header, all strings; empty cells are null, columns that are not accepted are not read."""
    df = spark.read.csv(path, header=True, sep=sep, encoding=encoding, nullValue="", multiLine=True, escape='"')
    return df.select(*[F.col(f"`{c}`") for c in df.columns if accepted is None or c in accepted])


@dataclass(frozen=True)
class FileOf:
    """One file of an archive: type, path, columns by position, id position, delimiter, header lines, encoding."""

    kind: str
    path: str
    fields: dict[int, str]
    id_at: int
    sep: str
    skip: int
    encoding: str


def descriptor(xml: str, folder: str) -> tuple[FileOf, list[FileOf]]:
    """The core and the extensions that an archive's meta.xml declares."""

    def one(e: ET.Element, id_tag: str) -> FileOf:
        fields = {int(f.get("index")): f.get("term", "").rstrip("/").rsplit("/", 1)[-1] for f in e.iter(f"{_NS}field") if f.get("index") is not None}
        sep = (e.get("fieldsTerminatedBy") or ",").replace("\\t", "\t")
        at = e.find(f"{_NS}{id_tag}")
        return FileOf(e.get("rowType", "").rsplit("/", 1)[-1], f"{folder}/{e.find(f'{_NS}files/{_NS}location').text.strip()}", fields, int(at.get("index")) if at is not None else 0, sep, int(e.get("ignoreHeaderLines") or 0), e.get("encoding") or "UTF-8")

    root = ET.fromstring(xml)
    return one(root.find(f"{_NS}core"), "id"), [one(e, "coreid") for e in root.findall(f"{_NS}extension")]


def read_file(spark: SparkSession, f: FileOf) -> DataFrame:
    """A file of an archive: _id, _at (the row's place, which orders the rows as the file does) and its columns (the first of those that repeat a name)."""
    df = spark.read.csv(f.path, header=f.skip > 0, sep=f.sep, encoding=f.encoding, nullValue="", escape='"', enforceSchema=True)
    at = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("row"))
    df = df.select("*", at.alias("_at")).toDF(*[f"_{k}" for k in range(len(df.columns))], "_at")
    names = {n: k for k, n in sorted(f.fields.items(), reverse=True)}
    return df.select(F.col(f"_{f.id_at}").alias("_id"), "_at", *[F.col(f"_{k}").alias(n) for n, k in sorted(names.items(), key=lambda x: x[1])])


#: Filters and orders of extension rows, by name; a source's configuration names them.
FILTERS: dict[str, Callable[[], Column]] = {"current names": lambda: ~F.coalesce(F.lower("status") == "deprecated", F.lit(False))}
ORDERS: dict[str, Callable[[], Column]] = {"file": lambda: F.col("_at"), "common names": lambda: -common_name_order(F.col("status"), F.lit(False))}


def aggregate(values: str, how: str = "all", order: Column | None = None) -> Column:
    """An extension column's values for a core row: all (distinct), the first in the file's order, max or min by order (the values' own without one)."""
    if how == "all":
        return F.array_sort(F.collect_set(values))
    by = order if order is not None else F.col("_at" if how == "first" else values)
    there = F.when(F.col(values).isNotNull(), by)
    return (F.max_by if how == "max" else F.min_by)(values, there)


def star(core: DataFrame, extension: DataFrame, columns: list[str], how: str = "all", order: Column | None = None, where: Column | None = None) -> DataFrame:
    """Core rows with an extension's columns aggregated; rows that the core does not have are left out with their extensions."""
    rows = extension if where is None else extension.where(where)
    grouped = rows.groupBy("_id").agg(*[aggregate(c, how, order).alias(f"ext_{c}") for c in columns])
    return core.join(grouped, "_id", "left")


def accessed(files: dict[str, DataFrame], core: str, kind: str, column: str, terms: list[str], classes: set[str] | None = None, link: bool = False, how: str = "all", order: Column | None = None, where: Column | None = None) -> DataFrame:
    """The rows of one file with ``column``, the array of distinct values that an observable has there, by each term in order.

    A term's values are the row's own (where the file's kind is among ``classes``; a link prefers the core), then the core row's (where
    the file lacks the term, or for a link), then those of the other files of ``classes``, filtered and aggregated as ``star`` does. Rows
    whose core row is missing are left out. files: by kind, with _id and _at.
    """
    classes, out = {kind} if classes is None else classes, files[kind]
    out = out if kind == core else out.join(files[core].select("_id"), "_id", "left_semi")
    parts: list[Column] = []
    from_core = [t for t in terms if t in files[core].columns and (t not in files[kind].columns or link) and kind != core]
    if from_core:
        out = out.join(files[core].select("_id", *[F.col(t).alias(f"_core_{t}") for t in from_core]), "_id")
    for t in terms:
        own = t in files[kind].columns
        if own and ((kind in classes and not link) or (link and kind == core)):
            parts.append(F.array(t))
        if t in from_core:
            parts.append(F.array(f"_core_{t}"))
        for n, other in enumerate(k for k in files if k not in (kind, core) and k in classes and t in files[k].columns):
            rows = files[other] if where is None else files[other].where(where)
            made = aggregate(t, how, order)
            name = f"_{t}_{n}"
            out = out.join(rows.groupBy("_id").agg((made if how == "all" else F.array(made)).alias(name)), "_id", "left")
            parts.append(F.coalesce(F.col(name), F.array().cast("array<string>")))
    none = F.array().cast("array<string>")
    values = F.array_distinct(F.filter(F.concat(*parts), lambda x: x.isNotNull())) if parts else none
    return out.withColumn("_values", values).select(*files[kind].columns, F.col("_values").alias(column))


def unpacked(spark: SparkSession, location: str) -> str:
    """The folder of an archive: the location itself, or for a packed one (zip or jar, in any file system that Spark reads, http too) a new
    folder under the shared one. Entries are copied one after the other as streams; one that leaves the folder is an error."""
    if not location.lower().split("?")[0].endswith((".zip", ".jar")):
        return location.rstrip("/")
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(location)
    folder = new_path(spark, "archive")
    target = jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(conf)
    packed = jvm.java.util.zip.ZipInputStream(path.getFileSystem(conf).open(path))
    try:
        while (entry := packed.getNextEntry()) is not None:
            name = entry.getName()
            if name.startswith("/") or ".." in name.split("/"):
                raise ValueError(f"an entry leaves the archive: {name}")
            if not entry.isDirectory():
                out = target.create(jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}"))
                try:
                    jvm.org.apache.hadoop.io.IOUtils.copyBytes(packed, out, 65536, False)
                finally:
                    out.close()
    finally:
        packed.close()
    return folder


def read_archive(spark: SparkSession, location: str) -> tuple[str, dict[str, DataFrame]]:
    """The core's kind and the files of an archive, by kind; several of one kind are an error."""
    folder = unpacked(spark, location)
    meta = spark.read.text(f"{folder}/meta.xml", wholetext=True).first().value
    core, more = descriptor(meta, folder)
    kinds = [f.kind for f in (core, *more)]
    if len(set(kinds)) < len(kinds):
        raise ValueError(f"several files of one kind: {kinds}")
    return core.kind, {f.kind: read_file(spark, f) for f in (core, *more)}


def source(spark: SparkSession, location: str) -> tuple[str, dict[str, DataFrame]]:
    """A source by its location: a delimited file (.csv, one file of kind "record") or an archive (a folder, .zip or .jar)."""
    end = location.lower().split("?")[0].rsplit("/", 1)[-1]
    if end.endswith(".csv"):
        return "record", {"record": read_csv(spark, location)}
    if "." in end and not end.endswith((".zip", ".jar")):
        raise ValueError(f"no source of this kind: {location}")
    return read_archive(spark, location)


def write_index(df: DataFrame, path: str) -> None:
    """Writes records; an index that is there already is kept under a name with the time."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(target):
        fs.rename(target, jvm.org.apache.hadoop.fs.Path(f"{path}-{time.strftime('%Y%m%d%H%M%S')}"))
    df.write.parquet(path)


def unique_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row a key (the smallest of its rows): the key is its columns' values joined with a bar."""
    key = F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys])
    rows = df.withColumn("_key", key)
    return rows.groupBy("_key").agg(F.min(F.struct(*df.columns)).alias("r")).select("r.*")
