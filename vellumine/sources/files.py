"""Readers and writers beside the parquet tables: JSON documents and lines, markup, landing folders, manifests, result caches."""

from __future__ import annotations

import tomllib
import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from vellumine.functions.clean import script_json, squeeze


def read_registry(spark: SparkSession, path: str, schema: StructType | str, backup: str | None = None) -> DataFrame:
    """A JSON document of many lines, read strictly; a document that can't be read gives way to its backup."""
    try:
        df = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)
        df.write.format("noop").mode("overwrite").save()
        return df
    except PySparkException:
        if backup is None:
            raise
        return read_registry(spark, backup, schema)


def read_accounts(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """JSON lines read strictly: a broken line fails the query."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_log(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """JSON lines whose broken lines are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def append_log(df: DataFrame, path: str) -> None:
    """Rows appended as JSON lines."""
    df.write.mode("append").json(path)


def write_table(df: DataFrame, path: str) -> DataFrame:
    """A table written beside the old one and read from its own folder, so a reader never sees half of it."""
    out = f"{path}/version-{uuid.uuid4().hex}"
    df.write.parquet(out)
    return df.sparkSession.read.schema(df.schema).parquet(out)


def config(path: str | None, defaults: dict[str, dict]) -> dict[str, dict]:
    """Defaults with the values of a TOML file over them, section by section; a missing file changes nothing."""
    user = tomllib.loads(Path(path).read_text()) if path and Path(path).exists() else {}
    return {section: {**values, **user.get(section, {})} for section, values in defaults.items()}


def manifests(units: DataFrame, papers: DataFrame) -> DataFrame:
    """(doc_id, manifest): one JSON document a paper with title, duration, sections and units in order, safe in a script."""
    fields = ["pos", "kind", "text", "t0", "t1", "para_end"]
    u = units.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("units"), F.max("t1").alias("duration"))
    j = u.join(papers.select(F.col("id").alias("doc_id"), "title", F.col("authors").alias("artist")), "doc_id", "left")
    parts = F.transform(F.filter("units", lambda x: x["kind"] == "heading"), lambda x: F.struct(x["text"].alias("title"), x["t0"].alias("t0")))
    doc = F.struct(F.coalesce("title", "doc_id").alias("title"), "artist", "duration", parts.alias("sections"), "units")
    return j.select("doc_id", script_json(F.to_json(doc)).alias("manifest"))


def manifest_units(docs: DataFrame) -> DataFrame:
    """Units of manifests, one row each."""
    unit = "array<struct<pos:int,kind:string,text:string,t0:double,t1:double,para_end:boolean>>"
    parsed = docs.select("doc_id", F.from_json("manifest", f"struct<title:string,duration:double,units:{unit}>").alias("m"))
    return parsed.select("doc_id", F.col("m.duration").alias("duration"), F.explode("m.units").alias("u")).select("doc_id", "duration", "u.*")


def tei_units(docs: DataFrame) -> DataFrame:
    """Heads and paragraphs of TEI markup in order (S07): docs (doc_id, tei); references and notes are left out."""
    body = F.regexp_replace(F.regexp_replace("tei", r"(?s)<(ref|note)\b[^>]*>.*?</\1>", ""), r"(?s)<(ref|note)\b[^>]*?/>", "")
    parts = F.regexp_extract_all(body, F.lit(r"(?s)<(head|p)\b[^>]*>.*?</\1>"), F.lit(0))
    rows = docs.select("doc_id", F.posexplode(parts).alias("pos", "part"))
    kind = F.when(F.startswith("part", F.lit("<head")), "heading").otherwise("body")
    return rows.select("doc_id", "pos", kind.alias("kind"), squeeze(F.regexp_replace("part", "<[^>]+>", " ")).alias("text"))


def landing(spark: SparkSession, path: str) -> DataFrame:
    """A stream of files that land in a folder and begin as PDF does (S14): path, size and a ten-digit hash."""
    files = spark.readStream.format("binaryFile").option("maxFilesPerTrigger", 64).load(path)
    return files.where((F.substring("content", 1, 4) == F.encode(F.lit("%PDF"), "UTF-8")) & (F.col("length") <= 100 << 20)).select("path", "length", F.substring(F.sha1("content"), 1, 10).alias("hash"))


def cached(rows: DataFrame, cache: DataFrame, key: Column, compute: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Rows with results by a content key: those of the cache, and those computed now, which also come back to be stored."""
    keyed = rows.withColumn("key", F.sha2(key, 256))
    new = compute(keyed.join(cache, "key", "left_anti").dropDuplicates(["key"])).select("key", "result")
    return keyed.join(cache.unionByName(new), "key", "left"), new
