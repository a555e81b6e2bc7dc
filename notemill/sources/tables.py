"""the small tables that come as JSON files: chapters of books, phrase rules, domains."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path, multiLine=True, mode="FAILFAST")


def book_bounds(spark: SparkSession, path: str) -> DataFrame:
    """(book, chapters) of {"chapters": {book: chapters}}."""
    return _read(spark, path, "chapters map<string, int>").select(F.explode("chapters").alias("book", "chapters"))


def phrase_rules(spark: SparkSession, path: str) -> DataFrame:
    """(ord, pattern, reason) of {"patterns": [{"pattern", "reason"}]}; patterns are regular expressions."""
    read = _read(spark, path, "patterns array<struct<pattern: string, reason: string>>")
    return read.select(F.posexplode("patterns").alias("ord", "p")).select("ord", "p.pattern", "p.reason")


#: fixed values: keys of the file, the kind that each stands for, and whether its entries are ends of names rather than domains
DOMAIN_KEYS = {"domains": ("institutional", False), "suffixes": ("institutional", True), "wiki_domains": ("wiki", False)}


def domain_table(spark: SparkSession, path: str) -> DataFrame:
    """(kind, pattern, below) of {"suffixes", "domains", "wiki_domains"}; a pattern with `below` holds for names under it only."""
    read = _read(spark, path, ", ".join(f"{k} array<string>" for k in DOMAIN_KEYS))
    each = [read.select(F.lit(kind).alias("kind"), F.explode(key).alias("pattern"), F.lit(below).alias("below")) for key, (kind, below) in DOMAIN_KEYS.items()]
    return each[0].unionByName(each[1]).unionByName(each[2]).select("kind", F.ltrim("pattern", F.lit(".")).alias("pattern"), "below")
