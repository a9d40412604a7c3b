"""File sources and sinks: raw pages, JSON lines, CSV, texts with a header line, reports."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

STINT = "struct<club_name:string,from_year:int,to_year:int,appearances:int,goals:int>"
RAW_PAGE = "page_id bigint, page_title string, entity_type string, full_url string, wikitext string, last_revision_id bigint, fetched_at string"
PLAYER = f"wiki_id bigint, wiki_url string, wiki_title string, name string, full_name string, date_of_birth string, place_of_birth string, nationality string, position string, height string, current_club string, clubs_history array<{STINT}>, national_team_history array<{STINT}>"


def exists(spark: SparkSession, path: str) -> bool:
    """A path exists on whatever file system it names."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_raw_pages(spark: SparkSession, path: str, schema: str = RAW_PAGE) -> DataFrame:
    """Raw pages, one JSON document a file or a line; documents that can't be read are left out."""
    full = T._parse_datatype_string(f"{schema}, _corrupt_record string") if isinstance(schema, str) else schema
    pages = spark.read.schema(full).option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    return pages.filter(F.col("_corrupt_record").isNull() & F.col(full[0].name).isNotNull()).drop("_corrupt_record")


def write_raw_pages(pages: DataFrame, path: str) -> None:
    """Pages by type in their own folders."""
    pages.write.mode("append").partitionBy("entity_type").json(path)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with a fixed schema; blank and malformed lines are dropped, missing fields are null, a missing path is an empty frame."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header and a fixed schema; empty fields are null, a missing path is an empty frame."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("header", True).option("nullValue", "").option("escape", '"').option("multiLine", True).csv(path)


def write_csv(df: DataFrame, path: str) -> bool:
    """CSV with a header; nested columns as JSON text. An empty frame isn't written; tells whether it was."""
    if df.isEmpty():
        return False
    flat = [F.to_json(f.name).alias(f.name) if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)) else F.col(f.name) for f in df.schema]
    df.select(*flat).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
    return True


META = "wiki_id bigint, entity_type string, page_title string, text_hash string"


def read_texts(spark: SparkSession, path: str, meta: str = META) -> DataFrame:
    """Text files whose first line may hold ``<!-- METADATA: {json} -->``: path, the metadata's fields (null without) and the text after it."""
    return headed(spark.read.text(path, wholetext=True).withColumn("path", F.col("_metadata.file_path")), meta)


def headed(raw: DataFrame, meta: str = META) -> DataFrame:
    """``raw`` with the metadata's fields and the text of its column ``value``, which may begin with a header."""
    header = F.regexp_extract("value", r"(?s)^\s*<!-- METADATA: (\{.*?\}) -->", 1)
    body = F.regexp_replace("value", r"(?s)^\s*<!-- METADATA: \{.*?\} -->\s*", "")
    others = [c for c in raw.columns if c != "value"]
    return raw.select(*others, F.from_json(header, meta).alias("m"), body.alias("text")).select(*others, "m.*", "text")


def collectable(pages: DataFrame, collected: DataFrame, key: str, text: str, least: int = 50) -> DataFrame:
    """Pages with enough text that weren't collected before, with the MD5 of the text."""
    fresh = pages.filter(F.length(text) >= least).join(collected.select(key).distinct(), key, "left_anti")
    return fresh.withColumn("text_hash", F.md5(text))


def unseen(df: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    """Incremental scan: the rows whose key isn't among the seen ones; null keys are unseen."""
    return df.join(seen.select(key).dropna().distinct(), key, "left_anti")


def supplement(known: DataFrame, parsed: DataFrame, raw: DataFrame, key: str) -> DataFrame:
    """``parsed`` with the raw rows of known keys that it lacks; columns that one side lacks are null."""
    missing = known.select(key).distinct().join(parsed.select(key), key, "left_anti")
    return parsed.unionByName(raw.join(missing, key, "left_semi"), allowMissingColumns=True)


def literal_rows(spark: SparkSession, rows: list[tuple] | str, schema: str) -> DataFrame:
    """A frame of literal rows: tuples, or a JSON list of objects as it stands in a script."""
    if isinstance(rows, str):
        one = spark.range(1).select(F.inline(F.from_json(F.lit(rows), f"array<struct<{T._parse_datatype_string(schema).simpleString()[7:-1]}>>")))
        return one
    return spark.createDataFrame(rows, schema)


def routed(pages: DataFrame, parsers: dict) -> dict[str, DataFrame]:
    """The pages of each type through the parser of its type: a function from frame to frame; types without one are left out."""
    return {kind: parse(pages.filter(F.col("entity_type") == kind)) for kind, parse in parsers.items()}


def csv_merge(spark: SparkSession, path: str, schema: str, key: list[str], version: str, old: DataFrame) -> DataFrame:
    """``old`` with the rows of a CSV merged into it by key: fields are cast as they are read, ones that don't fit are null, the last version of a key wins; rows with a null key are left out."""
    from pitchlake.operators.graph import merge_last

    fields = T._parse_datatype_string(schema)
    text = read_csv(spark, path, ", ".join(f"`{f.name}` string" for f in fields))
    cast = text.select(*[F.trim(f.name).try_cast(f.dataType).alias(f.name) for f in fields]).dropna(subset=key)
    return merge_last(old, cast, key, version)


def limited(df: DataFrame, key: str, n: int) -> DataFrame:
    """The first n rows by key: a limit that is the caller's wish."""
    return df.orderBy(key).limit(n)


def markdown(title: str, tables: dict[str, DataFrame], most: int = 100) -> str:
    """A report in markdown: a table per frame, of which the first ``most`` rows are shown (a report of aggregates)."""
    out = [f"# {title}", ""]
    for name, df in tables.items():
        out += [f"## {name}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
        out += ["| " + " | ".join("" if v is None else str(v).replace("|", "\\|") for v in row) + " |" for row in df.limit(most).collect()]
        out.append("")
    return "\n".join(out)


def chart(df: DataFrame, label: str, value: str, most: int = 50) -> str:
    """A bar chart of an aggregate's first ``most`` rows as SVG."""
    rows = [(str(r[label]), float(r[value] or 0)) for r in df.select(label, value).limit(most).collect()]
    top = max((v for _, v in rows), default=0) or 1
    bars = []
    for i, (name, v) in enumerate(rows):
        name = name.replace("&", "&amp;").replace("<", "&lt;")
        bars.append(f'<text x="195" y="{20 * i + 15}" text-anchor="end">{name}</text><rect x="200" y="{20 * i + 3}" width="{max(v, 0) / top * 400:.1f}" height="14" fill="#47a"/><text x="{205 + max(v, 0) / top * 400:.1f}" y="{20 * i + 15}">{v:g}</text>')
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="700" height="{20 * len(rows) + 6}" font-family="sans-serif" font-size="12">{"".join(bars)}</svg>'


def graph_script(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(statement): a property graph as statements with literal values: nodes (id, label, name) first, edges (src, rel, dst) after them by ``part``."""
    quoted = lambda c: F.concat(F.lit("'"), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'")), F.lit("'"))
    n = F.concat(F.lit("MERGE (n:"), "label", F.lit(" {id: "), F.col("id").cast("string"), F.lit("})"), F.when(F.col("name").isNotNull(), F.concat(F.lit(" SET n.name = "), quoted(F.col("name")))).otherwise(""), F.lit(";"))
    e = F.concat(F.lit("MATCH (a {id: "), F.col("src").cast("string"), F.lit("}), (b {id: "), F.col("dst").cast("string"), F.lit("}) MERGE (a)-[:"), "rel", F.lit("]->(b);"))
    return nodes.select(F.lit(0).alias("part"), n.alias("statement")).unionByName(edges.select("src", "rel", "dst").distinct().select(F.lit(1).alias("part"), e.alias("statement")))


def write_report(df: DataFrame, path: str) -> dict:
    """A one-row report as JSON on the driver's file system, and the same as text beside it."""
    report = df.first().asDict(recursive=True)
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        json.dump(report, f, ensure_ascii=False, default=str, indent=1)
    with open(os.path.splitext(path)[0] + ".txt", "w", encoding="utf-8") as f:
        f.writelines(f"{k}: {v}\n" for k, v in report.items())
    return report


def run_sql(spark: SparkSession, statement: str, frames: dict[str, DataFrame], **parameters) -> DataFrame:
    """A SQL statement over frames by name, with named parameters."""
    for name, df in frames.items():
        df.createOrReplaceTempView(name)
    return spark.sql(statement, args=parameters or None)
