"""Small documents beside the data: dataset metadata, settings, special cases; and batches of templates and their reports."""

from __future__ import annotations

import json
import xml.etree.ElementTree as ET

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from credal.functions.names import uri_tail
from credal.sources import archive


def dataset_metadata(xml: str) -> dict:
    """title, about, creators, contacts, published, rights and identifiers of a dataset description (EML); what is missing is left out."""
    root = ET.fromstring(xml)
    find = lambda e, name: next((x for x in e.iter() if x.tag.rsplit("}", 1)[-1] == name), None)
    every = lambda e, name: [x for x in e.iter() if x.tag.rsplit("}", 1)[-1] == name]
    text = lambda e: None if e is None else " ".join("".join(e.itertext()).split()) or None

    def person(e: ET.Element) -> dict:
        name = " ".join(filter(None, (text(find(e, "givenName")), text(find(e, "surName")))))
        return {k: v for k, v in {"name": name, "organisation": text(find(e, "organizationName")), "email": text(find(e, "electronicMailAddress"))}.items() if v}

    out = {
        "identifier": root.get("packageId"), "title": text(find(root, "title")), "about": text(find(root, "abstract")), "published": text(find(root, "pubDate")), "rights": text(find(root, "intellectualRights")),
        "identifiers": [text(x) for x in every(root, "alternateIdentifier")], "creators": [person(x) for x in every(root, "creator")], "contacts": [person(x) for x in every(root, "contact")],
    }
    return {k: v for k, v in out.items() if v}


def merged(mine: dict, other: dict) -> dict:
    """Metadata with another's values over it; ``sources`` are merged by identifier."""
    sources = {s.get("identifier"): s for s in mine.get("sources", [])}
    for s in other.get("sources", []):
        sources[s.get("identifier")] = merged(sources.get(s.get("identifier"), {}), s)
    out = {**mine, **{k: v for k, v in other.items() if v is not None}}
    return out | ({"sources": list(sources.values())} if sources else {})


def read_special_cases(spark: SparkSession, path: str, name: str = "name") -> DataFrame:
    """A table of names with given results; a name that stands twice is an error. It is small by nature: only its count and doubles are collected."""
    df = archive.read_csv(spark, path)
    twice = df.groupBy(name).count().where("count > 1").limit(5).collect()
    if twice:
        raise ValueError(f"names given twice: {[r[name] for r in twice]}")
    return df


def write_special_cases(df: DataFrame, path: str, name: str = "name", defaults: dict[str, str] | None = None) -> None:
    """Special cases as one table sorted by name, without the columns that hold their default in every row."""
    usual = defaults or {}
    others = [c for c in df.columns if c != name]
    kept = df.agg(*[F.max((~F.col(c).eqNullSafe(F.lit(usual.get(c)))).cast("int")).alias(c) for c in others]).first() if others else {}
    df.select(name, *[c for c in others if kept[c]]).orderBy(name).write.option("header", True).csv(path)


def as_templates(df: DataFrame, terms: dict[str, str]) -> DataFrame:
    """Columns of a batch renamed to the vertices they stand for (by URI, its tail, or id, any case); others stay under their names.

    terms: vertex id to URI. If several columns stand for one vertex, the first does.
    """
    names = {k.lower(): v for v, uri in terms.items() for k in (uri_tail(uri), uri, v)}
    out, taken = [], set()
    for c in df.columns:
        v = names.get(c.lower()) or names.get(uri_tail(c).lower())
        v = v if v not in taken else None
        taken.add(v)
        out.append(F.col(f"`{c}`").alias(v or c))
    return df.select(*out)


def report(df: DataFrame, supplied: list[str], results: dict[str, Column], issues: str, known_issues: list[str]) -> DataFrame:
    """A report's columns: what was supplied, the results, and a yes or no for each issue."""
    flags = [F.coalesce(F.array_contains(issues, i), F.lit(False)).alias(i) for i in known_issues]
    return df.select(*[F.col(c).alias(f"Supplied {c}") for c in supplied], *[c.alias(n) for n, c in results.items()], *flags)


def write_settings(path: str, spark: SparkSession, **settings: dict) -> None:
    """Each setting (network, metadata, analyser) as path/<name>.json, over the cluster's file system."""
    jvm = spark.sparkContext._jvm
    for name, value in settings.items():
        target = jvm.org.apache.hadoop.fs.Path(f"{path}/{name}.json")
        out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, True)
        out.write(bytearray(json.dumps(value, sort_keys=True), "utf-8"))
        out.close()


def read_setting(path: str, spark: SparkSession, name: str) -> dict:
    return json.loads("".join(r.value for r in spark.read.text(f"{path}/{name}.json", wholetext=True).collect()))


def is_current(built: float, index_times: list[float]) -> bool:
    """Whether what was built at a time is younger than all the indexes it was built from."""
    return all(built >= t for t in index_times)
