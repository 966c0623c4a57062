"""Readers of pages, parsed documents, logs, sitemaps and small settings files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.texts import markdown_table

BLOCK = (
    "struct<id:int,type:string,level:int,text:string,marker:string,page:int,section:array<string>,lang:string,has_contacts:boolean,header:array<string>,rows:array<array<string>>,"
    "bboxes:array<struct<page:int,l:double,t:double,r:double,b:double,origin:string>>>"
)
PARSED_DOCUMENT = (
    "doc_id string, sha256 string, kind string, url string, site string, title string, metadata struct<title:string,doc_type:string,number:string,date:string,lang:string>, "
    f"sources array<struct<url:string,site:string,found_on:string,anchor_text:string>>, pages array<struct<n:int,width:double,height:double>>, blocks array<{BLOCK}>"
)


def html_files(spark: SparkSession, path: str) -> DataFrame:
    """path and html of crawled pages, bytes taken as UTF-8; bytes that are none become replacement characters."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.html").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("html"))


def parsed_documents(spark: SparkSession, path: str) -> DataFrame:
    """Parsed documents, a JSON file each, with a fixed schema; a file that is no JSON gives a row of nulls."""
    return spark.read.schema(PARSED_DOCUMENT).option("multiLine", "true").json(path)


def active_documents(documents: DataFrame, registry: DataFrame, key: str = "sha256") -> DataFrame:
    """Documents whose content a downloaded and parsed registry row still names, once each."""
    live = registry.filter("status = 'downloaded' and parse_status = 'parsed'").select(key).distinct()
    return documents.dropDuplicates([key]).join(live, key, "left_semi")


def needs_ocr(chars: Column, least: int = 100) -> Column:
    """Whether a document (characters by page) needs text recognition: a page with too few, or no page at all."""
    return (F.size(chars) == 0) | F.exists(F.map_values(chars), lambda c: c < least)


def text_layer(chars: Column, least: int = 20) -> Column:
    return F.transform_values(chars, lambda _, c: c >= least)


def append_log(df: DataFrame, path: str, at: str = "ts") -> None:
    """Append log records as JSON lines, a folder for each day."""
    df.withColumn("day", F.to_date(at)).write.mode("append").partitionBy("day").json(path)


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All days of a log; a filter on `day` reads only its folders."""
    return spark.read.schema(f"{schema}, day date").json(path)


def sitemap(xml: DataFrame, column: str = "xml", since: str | None = None) -> DataFrame:
    """kind (url or sitemap), loc and lastmod of sitemap documents; entries older than `since` left out, undated ones kept."""
    entries = F.regexp_extract_all(F.col(column), F.lit(r"(?is)<(?:\w+:)?(?:url|sitemap)>.*?</(?:\w+:)?(?:url|sitemap)>"), F.lit(0))
    rows = xml.select(F.explode(entries).alias("_e"))
    value = lambda tag: F.nullif(F.trim(F.regexp_extract("_e", rf"(?is)<(?:\w+:)?{tag}>(?:<!\[CDATA\[)?(.*?)(?:\]\]>)?</", 1)), F.lit(""))
    kind = F.when(F.col("_e").rlike(r"(?is)^<(?:\w+:)?sitemap>"), "sitemap").otherwise("url")
    out = rows.select(kind.alias("kind"), F.replace(value("loc"), F.lit("&amp;"), F.lit("&")).alias("loc"), F.try_to_timestamp(value("lastmod")).alias("lastmod"))
    return out if since is None else out.filter(F.col("lastmod").isNull() | (F.col("lastmod") >= F.lit(since).cast("timestamp")))


def site_settings(spark: SparkSession, toml_text: str) -> DataFrame:
    """Sites of a settings file, defaults filled in; a few rows, parsed on the driver."""
    import tomllib

    found = tomllib.loads(toml_text)
    base = {"max_pages": 2000, "max_depth": 4, "delay": 0.5} | found.get("defaults", {})
    rows = [base | s for s in found.get("sites", [])]
    return spark.createDataFrame([(r["id"], r["url"], int(r["max_pages"]), int(r["max_depth"]), float(r["delay"])) for r in rows], "id string, url string, max_pages int, max_depth int, delay double")


EVALUATION_CASE = "id string, query string, query_lang string, line_lang string, gold_line_id string, gold_chunk_id string, site string, is_negative boolean, exclude_from_metric boolean"


def evaluation_cases(spark: SparkSession, yaml_text: str) -> DataFrame:
    """Cases of an evaluation set, a list in YAML of some dozens of entries, parsed on the driver; other fields of a case are left out."""
    import yaml

    names = [c.split()[0] for c in EVALUATION_CASE.split(", ")]
    return spark.createDataFrame([tuple(case.get(n) for n in names) for case in yaml.safe_load(yaml_text) or []], EVALUATION_CASE)


def measured(cases: DataFrame) -> DataFrame:
    """Cases that count for a score: neither negative ones nor those taken out."""
    return cases.filter(~F.coalesce(F.col("is_negative"), F.lit(False)) & ~F.coalesce(F.col("exclude_from_metric"), F.lit(False)))


def markdown(documents: DataFrame, key: str = "doc_id") -> DataFrame:
    """Parsed documents as Markdown text."""
    shown = F.transform("blocks", lambda b: F.when(b["type"] == "heading", F.concat(F.repeat(F.lit("#"), F.coalesce(b["level"], F.lit(1))), F.lit(" "), b["text"])).when(b["type"] == "list_item", F.concat(F.coalesce(b["marker"], F.lit("-")), F.lit(" "), b["text"])).when((b["type"] == "table") & (F.size(b["rows"]) > 0), markdown_table(F.coalesce(b["header"], F.array().cast("array<string>")), b["rows"])).otherwise(b["text"]))
    return documents.select(key, F.array_join(F.filter(shown, lambda t: t.isNotNull()), "\n\n").alias("markdown"))
