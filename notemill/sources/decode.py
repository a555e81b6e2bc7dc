"""File content to text, with the failure as a value."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notemill.shared import checkpoint

TEXT = (".md", ".txt")
ENCODINGS = ("utf-8", "utf-8-sig", "cp949", "euc-kr")


def decode(content: Column) -> Column:
    """(text, encoding, error) of binary content: the first encoding that fits. Arrow batches; Spark lacks cp949."""

    @F.pandas_udf("text string, encoding string, error string")
    def texts(data: pd.Series) -> pd.DataFrame:
        rows = []
        for raw in data:
            for name in ENCODINGS if raw is not None else ():
                try:
                    rows.append((bytes(raw).decode(name), name, None))
                    break
                except UnicodeDecodeError:
                    continue
            else:
                rows.append((None, None, "undecodable"))
        return pd.DataFrame(rows, columns=["text", "encoding", "error"])

    return texts(content)


def warnings(suffix: Column, text: Column, pages: Column) -> Column:
    """scanned_pdf for under 20 characters a page, else short_text under 200 characters."""
    scanned = (suffix == ".pdf") & (pages > 0) & (F.length(text) / pages < 20)
    return F.filter(F.array(F.when(scanned, F.lit("scanned_pdf")).when(F.length(F.trim(text)) < 200, F.lit("short_text"))), lambda x: x.isNotNull())


def _docx(raw: bytes) -> str:
    lines = []
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        for p in ElementTree.fromstring(z.read("word/document.xml")).iter():
            if not p.tag.endswith("}p"):
                continue
            style = next((v for e in p.iter() if e.tag.endswith("}pStyle") for k, v in e.attrib.items() if k.endswith("}val")), "")
            text = "".join(e.text or "" for e in p.iter() if e.tag.endswith("}t"))
            level = re.fullmatch(r"(?i)heading\s*([0-9])", style)
            lines.append(f"{'#' * min(int(level[1]), 3)} {text}" if level and text else text)
    return "\n".join(lines)


def _hwpx(raw: bytes) -> str:
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        names = [(int(m[1]), n) for n in z.namelist() if (m := re.fullmatch(r"Contents/section([0-9]+)\.xml", n))]
        lines = []
        for _, name in sorted(names):
            for p in ElementTree.fromstring(z.read(name)).iter():
                if p.tag.split("}")[-1] == "p":
                    lines.append("".join(e.text or "" for e in p.iter() if e.tag.split("}")[-1] == "t"))
        if text := "\n".join(lines).strip():
            return text
        raw = z.read("Preview/PrvText.txt")
    for name in ("utf-16", "utf-8", "cp949"):
        try:
            return raw.decode(name)
        except UnicodeDecodeError:
            continue
    raise ValueError("undecodable preview")


READERS = {".docx": _docx, ".hwpx": _hwpx}


def read_office(content: Column, suffix: Column) -> Column:
    """(text, error) of DOCX and HWPX files; a broken or other file is an error value. Arrow batches: zipped XML."""

    @F.pandas_udf("text string, error string")
    def texts(data: pd.Series, kind: pd.Series) -> pd.DataFrame:
        rows = []
        for raw, suffix in zip(data, kind, strict=True):
            try:
                rows.append((READERS[suffix](bytes(raw)), None))
            except Exception as e:  # noqa: BLE001 - whatever is wrong with one file is that file's value
                rows.append((None, type(e).__name__))
        return pd.DataFrame(rows, columns=["text", "error"])

    return texts(content, suffix)


#: Leading digits of a content's hash by which kept texts are foldered.
FOLDERS = 2


def _read_once(once: DataFrame) -> DataFrame:
    """(key, suffix, text, method, error) of distinct contents (key, suffix, content)."""
    office = once.where(F.col("suffix").isin(*READERS)).withColumn("r", read_office(F.col("content"), F.col("suffix"))).select("key", "suffix", "r.text", F.lit("xml").alias("method"), "r.error")
    plain = once.where(F.col("suffix").isin(*TEXT)).withColumn("r", decode(F.col("content"))).select("key", "suffix", "r.text", F.col("r.encoding").alias("method"), "r.error")
    return office.unionByName(plain)


def _kept(spark, cache: str) -> DataFrame | None:
    """Texts kept by earlier runs, one for each content; None if there are none."""
    path = spark._jvm.org.apache.hadoop.fs.Path(cache)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return None
    return spark.read.schema(f"key string, suffix string, text string, method string, {HEAD} string").parquet(cache)


HEAD = "head"


def extract(files: DataFrame, cache: str | None = None) -> DataFrame:
    """files (path, suffix, content) with text, method, error, pages, warnings and cached. Equal contents of a type are read once.

    Text is read by its encoding, DOCX and HWPX by their XML. PDF and HWP need programs that are not part of this: what they made of
    a file may come in a column `converted`, else such files have the error `unsupported`. A PDF's pages are counted by the form
    feeds of its text, else by its objects. Contents shuffle by hash only.

    With cache, a folder of the shared storage, texts are kept across runs by the hash of their content: what is there is not
    read again, wherever the file lies now and whatever it is called, and what is new is added. Failures are not kept. Only
    the folders of hash heads that occur are scanned. Runs at the same time may keep a text twice, which does no harm.
    """
    keyed = files.withColumn("key", F.coalesce(F.sha2("content", 256), F.lit("")))
    once = keyed.groupBy("key", "suffix").agg(F.min_by("content", "path").alias("content"))
    if cache is None:
        found = _read_once(once).withColumn("cached", F.lit(False))
    else:
        spark = files.sparkSession
        once = once.withColumn(HEAD, F.substring("key", 1, FOLDERS))
        kept = _kept(spark, cache)
        hits = None
        if kept is not None:
            heads = [r[0] for r in once.select(HEAD).distinct().collect()]  # at most 16 ** FOLDERS
            pruned = kept.where(F.col(HEAD).isin(*heads)) if heads else kept.limit(0)
            asked = once.select("key", "suffix")
            hits = checkpoint(pruned.join(asked, ["key", "suffix"], "left_semi").groupBy("key", "suffix").agg(F.min(F.struct("text", "method")).alias("r")).select("key", "suffix", "r.text", "r.method"))
            once = once.join(hits.select("key", "suffix"), ["key", "suffix"], "left_anti")
        new = checkpoint(_read_once(once))
        good = new.where("error IS NULL AND text IS NOT NULL").drop("error").withColumn(HEAD, F.substring("key", 1, FOLDERS))
        good.repartition(HEAD).write.mode("append").partitionBy(HEAD).parquet(cache)
        found = new.withColumn("cached", F.lit(False))
        if hits is not None:
            found = found.unionByName(hits.withColumns({"error": F.lit(None).cast("string"), "cached": F.lit(True)}))
    given = F.col("converted") if "converted" in files.columns else F.lit(None).cast("string")
    objects = F.regexp_count(F.decode("content", "ISO-8859-1"), F.lit(r"/Type\s*/Page\b"))
    pages = F.when(F.col("suffix") == ".pdf", F.greatest(F.lit(1), F.when(F.contains(given, F.lit("\f")), pdf_pages(given)).otherwise(F.coalesce(objects, F.lit(1)))))
    read = keyed.withColumns({"pages": pages, "_given": given}).drop("content", "converted").join(found, ["key", "suffix"], "left")
    outside = ~F.col("suffix").isin(*READERS, *TEXT)
    known = read.withColumns({
        "error": F.when(outside & F.col("_given").isNull(), "unsupported").when(~outside, F.col("error")),
        "text": F.when(outside, F.replace("_given", F.lit("\f"), F.lit("\n"))).otherwise(F.col("text")),
        "method": F.when(outside & F.col("_given").isNotNull(), "given").when(~outside, F.col("method")),
    }).drop("_given")
    return known.drop("key").withColumn("cached", F.coalesce("cached", F.lit(False))).withColumn("warnings", warnings(F.col("suffix"), F.col("text"), F.coalesce("pages", F.lit(0))))


def extract_few(files: DataFrame) -> DataFrame:
    """F8: extract() for DOCX, Markdown and text files only, with `chars` instead of warnings; other types are `unsupported`."""
    fine = F.col("suffix").isin(".docx", ".md", ".txt")
    read = extract(files.withColumn("content", F.when(fine, F.col("content")))).drop("warnings", "pages", "cached")
    kept = [F.when(fine, F.col(c)).alias(c) for c in ("text", "method")]
    return read.select(*[c for c in read.columns if c not in ("text", "method", "error")], *kept, F.when(fine, F.col("error")).otherwise("unsupported").alias("error"), F.when(fine, F.length("text")).alias("chars"))


def pdf_pages(text: Column) -> Column:
    """pages of a PDF's text: its form feeds, and one more if text follows the last."""
    return F.size(F.split(text, "\f")) - 1 + F.when(F.element_at(F.split(text, "\f"), -1).rlike(r"(?U)\S"), 1).otherwise(0)


def text_or_json(raw: Column) -> Column:
    """the `text` of a JSON object, else the raw content."""
    return F.coalesce(F.get_json_object(raw, "$.text"), raw)


def quotes_of(raw: Column) -> Column:
    """quotations of a JSON object (`quotes`) or array, without blank ones; none for other content."""
    listed = F.coalesce(F.from_json(F.get_json_object(raw, "$.quotes"), "array<string>"), F.from_json(F.when(F.trim(raw).startswith("["), raw), "array<string>"))
    return F.filter(F.coalesce(listed, F.array().cast("array<string>")), lambda q: F.trim(q) != "")
