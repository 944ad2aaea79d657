"""Queries of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumine.llm import chunks, leaks, lookalikes, names, packing, pii, scans, sentences
from vellumine.operators.multivalue import explode_packed
from vellumine.sources.tables import table


def scanned_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that have rows in words."""
    return table(spark, sf_dir, "words").select("doc_id").distinct()


def text_layer_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units of documents without rows in words."""
    units = table(spark, sf_dir, "units").select("doc_id", "pos", "kind", "text")
    return units.join(scanned_docs(spark, sf_dir), "doc_id", "left_anti")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tab, doc_id, pos, noise) of every case of scanner noise in words and in units of scanned documents."""
    return scans.ScanNoise(table(spark, sf_dir, "words"), table(spark, sf_dir, "units")).found()


def p1_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The repaired paragraphs of every scanned document, continuous over its pages, in reading order."""
    return scans.ScanNoise(table(spark, sf_dir, "words"), table(spark, sf_dir, "units")).paragraphs()


def p1_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The repaired texts of the units of every scanned document."""
    return scans.ScanNoise(table(spark, sf_dir, "words"), table(spark, sf_dir, "units")).repaired_units()


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(name_a, name_b) of two spellings of one person or group in meta.authors."""
    meta = table(spark, sf_dir, "meta").select("doc_id", "run", "authors").where("authors is not null").distinct()
    return names.spelling_links(explode_packed(meta, "authors", "name", "pos").select("doc_id", "run", "name"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, pos, cut_at) of every unit beyond 1900 characters."""
    over = table(spark, sf_dir, "units").select("doc_id", "pos", "text").where(F.length("text") > chunks.LIMIT)
    return over.mapInArrow(chunks.level_batches(["doc_id", "pos"]), "doc_id string, pos int, cut_at string").distinct()


def p4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of every unit beyond 1900 characters, in order."""
    over = table(spark, sf_dir, "units").select("doc_id", "pos", "text").where(F.length("text") > chunks.LIMIT)
    return over.mapInArrow(chunks.piece_batches(["doc_id", "pos"]), "doc_id string, pos int, piece int, begin int, cut_at string, piece_text string").distinct()


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, pos, cut) of every second or later sentence of the body units of text-layer documents."""
    body = text_layer_units(spark, sf_dir).where("kind = 'body' and text is not null").select("doc_id", "pos", "text")
    return body.mapInArrow(sentences.cut_batches(["doc_id", "pos"]), "doc_id string, pos int, cut int").distinct()


def p5_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per sentence of the body units of text-layer documents."""
    body = text_layer_units(spark, sf_dir).where("kind = 'body' and text is not null").select("doc_id", "pos", "text")
    return body.mapInArrow(sentences.sentence_batches(["doc_id", "pos"]), "doc_id string, pos int, sent int, begin int, end int, sentence string").distinct()


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tab, key_a, key_b) of meta titles and text-layer units that look the same and differ."""
    meta = table(spark, sf_dir, "meta").select(F.lit("meta").alias("tab"), F.concat_ws("#", "doc_id", F.col("run").cast("string")).alias("key"), F.col("title").alias("text"))
    units = text_layer_units(spark, sf_dir).select(F.lit("units").alias("tab"), F.concat_ws("#", "doc_id", F.col("pos").cast("string")).alias("key"), "text")
    return lookalikes.alike_pairs(meta.unionByName(units))


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(container, doc_id, part, size, fill): documents packed into containers of 2048 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, item_id) of every document that holds at least half of a test item."""
    return leaks.leak_rows(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")).select("doc_id", "item_id").distinct()


def p8_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the leaked stretches stand in the documents."""
    return leaks.leak_spans(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")).distinct()


def p8_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents without the leaked stretches."""
    return leaks.without_leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "eval_items")).select("doc_id", "cleaned")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, pii, start_char) of every mention of personal information."""
    return pii.mentions(table(spark, sf_dir, "documents")).select("doc_id", "pii", F.col("a").alias("start_char")).distinct()


def p9_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents with typed placeholders."""
    return pii.redact(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "redacted")


QUERIES = {"p7_containers": p7_containers, "p2_found": p2_found, "p1_found": p1_found, "p1_paragraphs": p1_paragraphs, "p1_units": p1_units, "p8_found": p8_found, "p8_spans": p8_spans, "p8_cleaned": p8_cleaned, "p9_found": p9_found, "p9_redacted": p9_redacted, "p4_found": p4_found, "p4_pieces": p4_pieces, "p5_found": p5_found, "p5_sentences": p5_sentences, "p6_found": p6_found}
SQL: dict[str, str] = {}
