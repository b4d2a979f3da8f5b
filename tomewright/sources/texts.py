r"""Document sources: files by book, macros first, entries between anchors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tomewright.operators.lists import merged
from tomewright.operators.rejects import routed

#: The book under which files of macros are listed.
MACROS = "macros"
#: A macro without arguments and its body, which may hold groups.
DEFINED = r"\\(?:re)?newcommand\s*\*?\s*\{?\\([A-Za-z]+)\}?\s*\{((?:[^{}]|\{[^{}]*\})*)\}"


def sources_of(files: DataFrame, manifest: DataFrame | None = None) -> DataFrame:
    """(book, file): the union of two tables (book, files array), each pair once."""
    keyed = [t.select(F.col("book").alias("key"), F.col("files").alias("values")) for t in (files, manifest) if t is not None]
    return merged(*keyed).select(F.col("key").alias("book"), F.explode("values").alias("file"))


def read_sources(spark: SparkSession, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents, macro files) with (book, file, text), one row for each file. A
    ``file`` may be a folder, all files of which count. The list of files comes to
    the driver, as it is configuration; a file that isn't there is an error."""
    paths = sorted({r.file for r in sources.select("file").distinct().collect()})
    if not paths:
        none = spark.createDataFrame([], "book string, file string, text string")
        return none, none
    bare = lambda c: F.regexp_replace(c, "^file:/*", "/")
    read = spark.read.text(paths, wholetext=True).select(bare(F.col("_metadata.file_path")).alias("at"), F.col("value").alias("text"))
    named = read.select("at", "text", F.explode(F.array("at", F.regexp_replace("at", "/[^/]*$", ""))).alias("named"))
    met = named.join(sources.withColumn("named", bare(F.regexp_replace("file", "/+$", ""))), "named").select("book", F.col("at").alias("file"), "text")
    return met.where(F.col("book") != MACROS), met.where(F.col("book") == MACROS)


def learned(macro_files: DataFrame) -> DataFrame:
    """(name, body) of the macros without arguments that the files define; of a name
    given again the last one in the order of files counts."""
    name, body = (F.regexp_extract_all("text", F.lit(DEFINED), F.lit(i)) for i in (1, 2))
    each = macro_files.select("file", F.posexplode(F.arrays_zip(name.alias("name"), body.alias("body"))).alias("at", "m"))
    return each.groupBy("m.name").agg(F.max_by("m.body", F.struct("file", "at")).alias("body"))


def with_macros(documents: DataFrame, macros: DataFrame, text: str = "text", depth: int = 3) -> DataFrame:
    """Texts with macros replaced by their bodies, ``depth`` times over, as bodies may
    use macros. The table of macros is configuration; it is sent along whole."""
    quoted = F.regexp_replace("body", r"([\\$])", r"\\$1")
    table = macros.agg(F.array_sort(F.collect_list(F.struct(F.concat(F.lit(r"\\"), F.col("name"), F.lit(r"(?![A-Za-z])[ \t]*")).alias("p"), quoted.alias("b")))).alias("_macros"))
    once = lambda t: F.aggregate("_macros", t, lambda acc, m: F.regexp_replace(acc, m["p"], m["b"]))
    new = F.col(text)
    for _ in range(depth):
        new = once(new)
    return documents.crossJoin(F.broadcast(table)).withColumn(text, new).drop("_macros")


def entries(documents: DataFrame, anchor: str, silent: str | None = None, text: str = "text") -> tuple[DataFrame, DataFrame]:
    r"""(entries, rejects with reason) of what stands from one ``\anchor{name}`` to the
    next. What comes before the first is no entry; neither is one that holds the
    macro ``silent``. Rejects have no name or no body."""
    parts = F.split(F.col(text), rf"(?=\\{anchor}(?![A-Za-z]))")
    each = documents.select(*[c for c in documents.columns if c != text], F.posexplode(parts).alias("place", "part"))
    begins = rf"(?s)^\\{anchor}\s*\{{([^{{}}]*)\}}(.*)$"
    piece: Column = F.col("part")
    found = each.where(piece.startswith(f"\\{anchor}")).withColumns({"name": F.trim(F.regexp_extract(piece, begins, 1)), "body": F.trim(F.regexp_replace(F.regexp_extract(piece, begins, 2), r"\s+", " "))})
    checks = [("no name", F.col("name") != ""), ("no body", F.col("body") != "")]
    good, bad = routed(found, checks, piece.rlike(rf"\\{silent}(?![A-Za-z])") if silent else None)
    return good.drop("part"), bad.drop("part", "body")
