"""Stored answers of a search service, as a data source that filters where it reads.

Files hold an answer a line, as the service gave it: the total of hits it has and
those it sent. A file is a partition. Of filters on the book, the category and the
links to other versions of a record, those that the reader decides exactly don't
come back to Spark; the book is compared as the service does it, by phrase, so
that filter is checked again.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualNullSafe, EqualTo, Filter, InputPartition, IsNull

from tomewright.functions.text import after_rule
from tomewright.operators.rejects import routed
from tomewright.sources.catalogue import PAGE

#: Fields of a record as they are stored, and their kinds.
FIELDS = {
    "name": "string", "category": "string", "summary": "string", "tradition": "array<string>", "level": "int", "component": "array<string>", "range_raw": "string",
    "primary_source": "string", "primary_source_raw": "string", "markdown": "string", "legacy_id": "string", "remaster_id": "string",
}
#: Besides, of each hit: the answer it is from, and what that says of itself. A
#: null hit has nulls in all fields.
SCHEMA = ", ".join(f"{n} {k}" for n, k in FIELDS.items()) + ", answer string, total long, n_hits long, is_null boolean"
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"

#: The traditions.
TRADITIONS = ["Arcane", "Divine", "Occult", "Primal", "Focus", "Elemental"]


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """A path or address of any store that Arrow knows."""
    if path.startswith("file:"):
        path = "/" + path[len("file:") :].lstrip("/")
    return fs.FileSystem.from_uri(path)


def holds_phrase(text: str | None, phrase: str) -> bool:
    """Whether the words of ``phrase`` stand in ``text`` one after the other."""
    have, want = (text or "").lower().split(), phrase.lower().split()
    return any(have[i : i + len(want)] == want for i in range(len(have) - len(want) + 1))


@dataclass(frozen=True)
class Kept:
    """The filters that the reader applies to each record."""

    phrases: tuple[str, ...] = ()
    categories: tuple[str, ...] = ()
    absent: tuple[str, ...] = ()

    def keeps(self, r: dict) -> bool:
        return (
            all(holds_phrase(r.get("primary_source"), p) for p in self.phrases)
            and all(r.get("category") == c for c in self.categories)
            and all(r.get(c) is None for c in self.absent)
        )


class AnswerFile(InputPartition):
    def __init__(self, path: str):
        self.path = path


class AnswerReader(DataSourceReader):
    def __init__(self, path: str, phrase: str | None = None):
        self.path, self.kept = path, Kept((phrase,) if phrase else ())

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        phrases, categories, absent = list(self.kept.phrases), [], []
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if isinstance(f, (EqualTo, EqualNullSafe)) and column == "primary_source" and f.value is not None:
                phrases.append(f.value)
                yield f  # the phrase is necessary, not enough
            elif isinstance(f, (EqualTo, EqualNullSafe)) and column == "category" and f.value is not None:
                categories.append(f.value)
            elif isinstance(f, IsNull) and column in ("legacy_id", "remaster_id"):
                absent.append(column)
            else:
                yield f
        self.kept = Kept(tuple(phrases), tuple(categories), tuple(absent))

    def partitions(self) -> list[InputPartition]:
        store, path = opened(self.path)
        found = store.get_file_info(fs.FileSelector(path, recursive=True))
        plain = [f.path for f in found if f.is_file and not f.base_name.startswith(("_", "."))]
        prefix = self.path[: self.path.index("://") + 3] if "://" in self.path and not self.path.startswith("file:") else ""
        return [AnswerFile(prefix + p) for p in sorted(plain)]

    def read(self, partition: AnswerFile) -> Iterator[tuple]:
        """Hits one by one; lines that are no answers give none."""
        store, path = opened(partition.path)
        with store.open_input_stream(path) as f:
            rest, number = b"", 0
            while chunk := f.read(1 << 20):
                *lines, rest = (rest + chunk).split(b"\n")
                for line in lines:
                    yield from self._hits(line, f"{path}#{number}")
                    number += 1
            yield from self._hits(rest, f"{path}#{number}")

    def _hits(self, line: bytes, answer: str) -> Iterator[tuple]:
        if not line.strip():
            return
        said = json.loads(line)["hits"]
        total, hits = int(said["total"]["value"]), said["hits"]
        for h in hits:
            r = (h or {}).get("_source")
            if r is None and self.kept == Kept() or r is not None and self.kept.keeps(r):
                yield (*((r or {}).get(c) for c in FIELDS), answer, total, len(hits), r is None)


class StoredHits(DataSource):
    """``spark.read.format("stored_hits").option("path", ..)`` after ``register``; the
    option ``phrase`` asks for records whose book holds it, as the service does."""

    @classmethod
    def name(cls) -> str:
        return "stored_hits"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> AnswerReader:
        return AnswerReader(self.options["path"], self.options.get("phrase"))


def stored_hits(spark: SparkSession, path: str, phrase: str | None = None) -> DataFrame:
    """All hits of the answers below ``path``, or those whose book holds ``phrase``;
    filters on them reach the reader."""
    spark.conf.set(PUSHDOWN, "true")
    spark.dataSource.register(StoredHits)
    reader = spark.read.format("stored_hits").option("path", path)
    return (reader.option("phrase", phrase) if phrase else reader).load()


def hits_of_book(spark: SparkSession, path: str, book: str, category: str = "spell", legacy: bool = False) -> DataFrame:
    """What the service was asked for: records of a category and a book, of the version
    that no other one replaces. The phrase is looser than the name of the book, which
    is compared again, ignoring case."""
    replaced = "legacy_id" if legacy else "remaster_id"
    hits = stored_hits(spark, path, book)
    return hits.where((F.lower("primary_source") == book.lower()) & (F.col("category") == category) & F.col(replaced).isNull())


def short_answers(hits: DataFrame) -> DataFrame:
    """(answer, total, n_hits) of answers that say there is more than they hold."""
    return hits.where("total > n_hits").select("answer", "total", "n_hits").distinct()


def page_number(reference: Column) -> Column:
    """The number at the end of a reference."""
    return F.regexp_extract(reference, PAGE, 1).try_cast("int")


def hit_rows(hits: DataFrame, source: str) -> tuple[DataFrame, DataFrame]:
    """(entries, rejects with name and reason) of the hits of one book. Traditions are
    of a fixed list, in just that form; a page stands at the end of the reference; a
    description follows the rule in the text."""
    tradition = F.transform(F.coalesce("tradition", F.array().cast("array<string>")), lambda x: F.trim(x))
    odd = F.filter(tradition, lambda x: ~F.coalesce(x.isin(TRADITIONS), F.lit(False)))
    rows = hits.select(
        "name", F.lit(source).alias("source"), "summary", tradition.alias("traditions"), "level",
        F.array_join(F.coalesce("component", F.array().cast("array<string>")), ", ").alias("components"),
        F.coalesce("range_raw", F.lit("")).alias("range"), page_number(F.col("primary_source_raw")).alias("page"), after_rule(F.col("markdown")).alias("description"),
        F.concat(F.lit("Invalid tradition: "), F.get(odd, F.lit(0))).alias("_odd"), F.col("primary_source_raw").alias("_reference"), "is_null",
    )
    checks = [
        ("null entry", ~F.col("is_null")),
        (F.coalesce("_odd", F.lit("Invalid tradition")), F.size(F.filter("traditions", lambda x: ~F.coalesce(x.isin(TRADITIONS), F.lit(False)))) == 0),
        (F.concat(F.lit("Invalid primary source: "), F.coalesce("_reference", F.lit(""))), F.col("page").isNotNull()),
        ("no description", F.col("description").isNotNull()),
        ("no name", F.col("name").isNotNull()),
    ]
    good, bad = routed(rows, checks)
    return good.drop("_odd", "_reference", "is_null"), bad.select("name", "source", "reason")
