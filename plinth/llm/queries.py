"""Queries of the training-data problems."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plinth.llm import abuse, crosslink, entities, garbled, leaks, lookalikes, occurrences, packing
from plinth.session import table


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    talks = table(spark, d, "talks").where(F.col("kind").isNull())
    rows, persons = entities.resolve(talks, table(spark, d, "people"), table(spark, d, "aliases"))
    return rows.select("person_id", F.lit("talks").alias("tab"), F.col("row_id").alias("rec_id")).unionByName(
        persons.select("person_id", F.lit("people").alias("tab"), F.col("other").alias("rec_id"))
    )


def _talks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "talks").where(F.col("kind").isNull())


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return occurrences.best_records(_talks(spark, d), table(spark, d, "feeds"))


def p4_pairs(spark: SparkSession, d: str) -> DataFrame:
    return crosslink.link(_talks(spark, d), table(spark, d, "blog_pages"), table(spark, d, "feeds"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return p4_pairs(spark, d).select("row_id", "page_id")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    talks = table(spark, d, "talks")
    fields = talks.select("row_id", F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("value")) for c in ("title", "speaker_raw")])).alias("f"))
    fields = fields.select("row_id", "f.field", "f.value").where(F.col("value").rlike(r"[^\x00-\x7F]"))
    return lookalikes.consistent(fields, "value").where(~F.col("plain")).select("row_id", "field")


def _p6_fields(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "blog_pages")
    parts = [
        table(spark, d, "talks").select(F.lit("talks").alias("tab"), F.col("row_id").alias("rec_id"), F.lit("title").alias("field"), F.col("title").alias("value")),
        *[pages.select(F.lit("blog_pages").alias("tab"), F.col("page_id").alias("rec_id"), F.lit(c).alias("field"), F.col(c).alias("value")) for c in ("title", "abstract")],
        table(spark, d, "people").select(F.lit("people").alias("tab"), F.col("person_id").alias("rec_id"), F.lit("firstname").alias("field"), F.col("firstname").alias("value")),
    ]
    return reduce(DataFrame.unionByName, parts).where(F.col("value").rlike(r"[^\x00-\x7F]"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    fields = _p6_fields(spark, d)
    model = garbled.fit(fields, "value")
    return garbled.spot(fields, "value", model).where(F.col("chain") != garbled.CLEAN).select("tab", "rec_id", "field")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return packing.divided(packing.pack(table(spark, d, "documents").select("doc_id", "text")))


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    """How well the containers are filled."""
    packed = packing.pack(table(spark, d, "documents").select("doc_id", "text"))
    bins = packed.groupBy("container").agg(F.sum("tokens").alias("tokens"))
    least = F.ceil(F.sum("tokens") / packing.CAPACITY).cast("long")
    return bins.agg(F.count("*").alias("containers"), least.alias("lower_bound"), F.max("tokens").alias("fullest"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaks(table(spark, d, "documents").select("doc_id", "text"), table(spark, d, "eval_items"))


def _p9_scores(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "source", "text")
    return abuse.scored(docs, abuse.fit(docs))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return _p9_scores(spark, d).where(F.col("score") >= 0.5).select("doc_id")


def p9_scores(spark: SparkSession, d: str) -> DataFrame:
    return _p9_scores(spark, d).select("doc_id", F.round("score", 4).alias("score"))


def p9_rates(spark: SparkSession, d: str) -> DataFrame:
    return abuse.rates(_p9_scores(spark, d).select("source", "score"))


QUERIES = {
    "p2_found": p2_found, "p3_found": p3_found, "p4_found": p4_found, "p4_pairs": p4_pairs,
    "p5_found": p5_found, "p6_found": p6_found, "p7_found": p7_found, "p7_containers": p7_containers, "p8_found": p8_found,
    "p9_found": p9_found, "p9_scores": p9_scores, "p9_rates": p9_rates,
}
SQL: dict[str, str] = {}
