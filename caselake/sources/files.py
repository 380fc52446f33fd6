"""File sources and report sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Extensions that are taken in, with their media types.
MIME = {"pdf": "application/pdf", "txt": "text/plain", "md": "text/markdown", "html": "text/html", "htm": "text/html", "csv": "text/csv", "json": "application/json", "eml": "message/rfc822", "png": "image/png", "jpg": "image/jpeg", "parquet": "application/vnd.apache.parquet"}


def read_files(spark: SparkSession, path: str, exts: tuple[str, ...] = tuple(MIME)) -> DataFrame:
    """(path, name, ext, mime, length, modified): files of a folder tree with an allowed extension; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", F.col("modificationTime").alias("modified"))
    named = files.withColumn("name", F.element_at(F.split("path", "/"), -1)).withColumn("ext", F.regexp_extract(F.lower("name"), r"\.([a-z0-9]+)$", 1))
    kinds = F.create_map(*[F.lit(x) for kv in MIME.items() for x in kv])
    return named.filter(F.col("ext").isin(list(exts))).withColumn("mime", kinds[F.col("ext")])


def read_csv_container(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text, latin-1, broken lines skipped."""
    return spark.read.csv(path, header=True, encoding="ISO-8859-1", mode="DROPMALFORMED")


def read_json_container(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("mode", "PERMISSIVE").json(path)


def write_report(df: DataFrame, path: str, title: str) -> None:
    """The rows as JSON lines under ``json`` and as markdown lines under ``md``; both are written by the tasks that hold the rows."""
    df.write.mode("overwrite").json(f"{path}/json")
    cells = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in df.columns]
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    head = df.sparkSession.createDataFrame([(f"# {title}",), ("",), ("| " + " | ".join(df.columns) + " |",), ("|" + "---|" * len(df.columns),)], "value string").coalesce(1)
    head.write.mode("overwrite").text(f"{path}/md/head")
    df.select(line.alias("value")).write.mode("overwrite").text(f"{path}/md/rows")


def mail_table(df: DataFrame, samples: int = 5) -> DataFrame:
    """From, to, subject, date and body of the column that holds raw mails, by the majority of a few sampled rows; empty without one."""
    from caselake.functions.scalar import mail_body, mail_field, strip_quoted

    rows = df.limit(samples).collect()
    votes = {c: sum(1 for r in rows if r[c] and "From:" in str(r[c]) and "Subject:" in str(r[c])) for c in df.columns}
    best = max(votes, key=lambda c: votes[c], default=None)
    if best is None or votes[best] * 2 <= len(rows):
        return df.limit(0).select(*[F.lit(None).cast("string").alias(x) for x in ("sender", "recipient", "subject", "sent", "body")])
    c = F.col(f"`{best}`")
    return df.select(mail_field(c, "From").alias("sender"), mail_field(c, "To").alias("recipient"), mail_field(c, "Subject").alias("subject"), mail_field(c, "Date").alias("sent"), strip_quoted(mail_body(c)).alias("body"))


def flush_partitions(df: DataFrame, path: str, by: str) -> None:
    """Replace only the partitions that df has rows of."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)
