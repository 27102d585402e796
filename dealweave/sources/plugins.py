"""Extension points: custom pair gates, rule packs, and custom sources."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

GATES: dict[str, Callable[..., Column]] = {}

#: Columns of each rule kind of a pack.
RULE_SCHEMAS = {
    "synonyms": "word string, canonical string",
    "stop_words": "word string",
    "term_maps": "term string, other string, kind string",
    "blockers": "keyword string, blocker string",
    "qualifiers": "keyword string, qualifier string, two_way boolean",
    "equivalents": "qualifier string, other string",
    "forms": "keyword string, form string, mode string, partner string",
    "requirements": "line_cue string, need string, forbid string, unless string",
    "policies": "policy_id string, line_pattern string, allowed_word string, blocked_keyword string",
    "bridges": "bridge_id string, line_pattern string, name_pattern string, negative_pattern string, anchor string",
    "categories": "keyword string, target string, priority int",
    "seasons": "priority int, keyword string, kind string, start string, end string, inside boolean",
}


def register_gate(name: str, fn: Callable[..., Column]) -> None:
    """A gate is a function of columns to a boolean column: an expression, or a pandas UDF."""
    GATES[name] = fn


def apply_gate(hits: DataFrame, name: str, *columns: str) -> DataFrame:
    """`hits` with the gate's verdict in a column of its name."""
    return hits.withColumn(name, GATES[name](*map(F.col, columns)))


class RulePack:
    """A market's rules as DataFrames, one table of Parquet or CSV per kind under a folder."""

    def __init__(self, tables: dict[str, DataFrame]):
        self.tables = tables

    @classmethod
    def load(cls, spark: SparkSession, path: str, kinds=None, fmt: str = "parquet") -> RulePack:
        reader = spark.read.option("header", True) if fmt == "csv" else spark.read
        return cls({k: reader.schema(RULE_SCHEMAS[k]).format(fmt).load(f"{path}/{k}") for k in kinds or RULE_SCHEMAS})

    def save(self, path: str) -> None:
        for kind, df in self.tables.items():
            df.write.mode("overwrite").parquet(f"{path}/{kind}")

    def __getitem__(self, kind: str) -> DataFrame:
        return self.tables[kind]

    def version(self) -> DataFrame:
        """One row (rules_version): an order-free sum of digests of all rule rows; null fields count as empty."""
        row = lambda k, df: F.concat_ws("\x1f", F.lit(k), *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns), F.lit(""))
        parts = [df.select(F.conv(F.substring(F.md5(row(k, df)), 1, 15), 16, 10).cast("decimal(20,0)").alias("h")) for k, df in sorted(self.tables.items())]
        rows = reduce(DataFrame.union, parts)
        return rows.agg(F.coalesce(F.sum("h"), F.lit(0)).cast("decimal(38,0)").cast("string").alias("rules_version"))


def parse_pages(pages: DataFrame, parse: Callable[[str], Iterator[dict]], schema: str, key: str = "page_id", html: str = "html") -> DataFrame:
    """Rows that a parser function gives for each page (key first), by Arrow batches."""
    import pyarrow as pa

    def run(batches):
        for b in batches:
            keys, rows = [], []
            for k, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for row in parse(text or ""):
                    keys.append(k)
                    rows.append(row)
            names = [c.split()[0] for c in schema.split(", ")]
            yield pa.RecordBatch.from_pydict({key: pa.array(keys, pa.int64()), **{n: pa.array([r.get(n) for r in rows], pa.string()) for n in names}})

    return pages.select(F.col(key).cast("long").alias(key), html).mapInArrow(run, f"{key} long, {schema}")


def register_source(spark: SparkSession, name: str, schema: str, partitions: int, read: Callable[[int], Iterator[tuple]]) -> None:
    """Registers a batch format `name`: `read(i)` yields the rows of partition i, in the tasks."""

    class Reader(DataSourceReader):
        def partitions(self):
            return [InputPartition(i) for i in range(partitions)]

        def read(self, partition):
            yield from read(partition.value)

    class Source(DataSource):
        @classmethod
        def name(cls):
            return name

        def schema(self):
            return schema

        def reader(self, schema):
            return Reader()

    spark.dataSource.register(Source)
