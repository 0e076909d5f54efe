"""Source files: reading, listing, text at a position; settings and the history of queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.functions.text import dirname


def add(spark: SparkSession, path: str, recursive: bool = False, pattern: str = "*.erl") -> DataFrame:
    """``(file_id, kind, path, text)`` of a file, or of the matching files of a directory.  Ids are hashes of paths."""
    reader = spark.read
    if recursive:
        reader = reader.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern)
    rows = reader.text(path, wholetext=True).select(F.col("value").alias("text"), F.col("_metadata.file_path").alias("path"))
    return rows.select(F.xxhash64("path").alias("file_id"), F.when(F.endswith("path", F.lit(".hrl")), "header").otherwise("module").alias("kind"), "path", "text")


def forms(files: DataFrame) -> DataFrame:
    """``(file_id, ord, type, text)``: the forms of source files, which end in a full stop before white space."""
    parts = F.expr(r"filter(transform(split(regexp_replace(text, '(?m)%.*$', ''), '\\.(\\s+|$)', -1), x -> trim(BOTH ' \n\r\t' FROM x)), x -> x <> '')")
    rows = files.select("file_id", F.posexplode(parts).alias("ord", "text"))
    kind = F.regexp_extract("text", r"^-\s*([a-z]+)", 1)
    named = {"module": "module", "export": "export", "import": "import", "record": "record", "define": "macro", "spec": "spec", "include": "include"}
    out = F.when(kind == "", "func")
    for word, name in named.items():
        out = out.when(kind == word, name)
    return rows.select("file_id", F.col("ord").cast("int").alias("ord"), out.otherwise("attribute").alias("type"), "text")


def functions(files: DataFrame) -> DataFrame:
    """``(file_id, name, arity, clauses)`` of the functions that files define."""
    heads = F.regexp_extract_all(F.concat(F.lit(";\n"), "text"), F.lit(r"(?s);\s*([a-z][A-Za-z0-9_@]*)\s*\(([^()]*(?:\([^()]*\)[^()]*)*)\)\s*(?:when\b[^;]*?)?->"), F.lit(0))
    rows = forms(files).where("type = 'func'").select("file_id", "ord", F.explode(heads).alias("h"))
    name = F.regexp_extract("h", r"^;\s*([a-z][A-Za-z0-9_@]*)", 1)
    args = F.regexp_extract("h", r"(?s)\((.*)\)\s*(?:when\b.*)?->$", 1)
    flat = F.regexp_replace(F.regexp_replace(args, r"[\[{(][^\[\]{}()]*[\]})]", "x"), r"[\[{(][^\[\]{}()]*[\]})]", "x")
    arity = F.when(F.trim(args) == "", 0).otherwise(F.size(F.split(flat, ",", -1)))
    return rows.select("file_id", "ord", name.alias("name"), arity.alias("arity")).groupBy("file_id", "ord", "name", "arity").agg(F.count(F.lit(1)).alias("clauses")).select("file_id", "name", "arity", "clauses")


def listing(files: DataFrame) -> DataFrame:
    """``(path, error, heading)``: files in order, with the directory where a new one begins."""
    own = dirname(F.col("path"))
    before = F.lag(own).over(Window.partitionBy(F.lit(1)).orderBy("path"))  # a listing is read by people
    return files.select("path", "error", F.when(before.isNull() | (before != own), own).alias("heading"))


def status(files: DataFrame, errors: DataFrame) -> DataFrame:
    """``(path, kind, error, errors)``; ``errors (file_id, position, token)``."""
    some = errors.groupBy("file_id").agg(F.count(F.lit(1)).alias("errors"))
    return files.join(some, "file_id", "left").select("path", "kind", F.col("errors").isNotNull().alias("error"), F.coalesce("errors", F.lit(0)).alias("errors"))


def highlight(text: Column, start: Column, end: Column) -> Column:
    """The characters from ``start`` to ``end``, counted from 0, the last included."""
    return F.substring(text, start + 1, end - start + 1)


def decode(text: Column) -> Column:
    """A query as a browser sends it: URL-decoded, without newlines."""
    return F.regexp_replace(F.url_decode(F.replace(text, F.lit("+"), F.lit("%2B"))), r"[\r\n]", "")


# Settings and their defaults.
DEFAULTS = {"appbase": "", "include": "", "output": "original"}


def settings(spark: SparkSession, changes: DataFrame | None = None) -> DataFrame:
    """``(key, value)``: the defaults with the latest of ``changes (key, value, seq)``."""
    base = spark.createDataFrame(list(DEFAULTS.items()), "key string, value string").withColumn("seq", F.lit(-1).cast("long"))
    rows = base if changes is None else base.unionByName(changes.select("key", "value", F.col("seq").cast("long").alias("seq")))
    return rows.groupBy("key").agg(F.max_by("value", "seq").alias("value"))


def history(log: DataFrame, user: str | None = None) -> DataFrame:
    """Distinct queries with their last use, of one user or of all; ``log (user, query, ts)``."""
    rows = log if user is None else log.where(F.col("user") == user)
    return rows.groupBy("user", "query").agg(F.max("ts").alias("ts"))


def forget(log: DataFrame, queries: DataFrame) -> DataFrame:
    """The log without ``queries (user, query)``."""
    return log.join(queries.select("user", "query").distinct(), ["user", "query"], "left_anti").select(*log.columns)
