"""The term index: five flat tables and the small values that steer a lookup."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SOURCES_SCHEMA = ("source string, data_source string, type string, "
                  "last_modified double, last_updated double")
ENTITIES_SCHEMA = "id string, label string, source string, data_source string, kind string"
ATTRIBUTES_SCHEMA = ("id string, source string, data_source string, prop string, "
                     "value string, lang string, ord long")
PREFIXES_SCHEMA = "source string, data_source string, prefix string, expansion string"
GLOBALS_SCHEMA = "prefix string, expansion string, trust int"

SOURCE_KEY = ["source", "data_source"]
TERM_KEY = ["id", "source", "data_source"]

# Earlier sources win. A caller's literal list, so it lives in the plan, not in a table.
ActiveSources = list[tuple[str, str]]


@dataclass(frozen=True)
class Index:
    """`data_source` is '' for "none", never NULL, so that joins stay plain equi-joins.

    `ord` on attributes is the row's place in its source; ties and "first" depend on it.
    """

    sources: DataFrame
    entities: DataFrame
    attributes: DataFrame
    prefixes: DataFrame
    global_prefixes: DataFrame

    def views(self, stem: str = "") -> None:
        """Publish the tables as temporary views, for ad-hoc SQL."""
        for name, frame in self.tables().items():
            frame.createOrReplaceTempView(stem + name)

    def tables(self) -> dict[str, DataFrame]:
        return {
            "sources": self.sources,
            "entities": self.entities,
            "attributes": self.attributes,
            "prefixes": self.prefixes,
            "global_prefixes": self.global_prefixes,
        }


def literal_table(spark: SparkSession, rows: list[tuple], names: list[str]) -> DataFrame:
    """A table of constants that the planner can size (it stays inside the plan)."""
    structs = [F.struct(*[F.lit(v).alias(n) for v, n in zip(row, names)]) for row in rows]
    return spark.range(0, 1, 1, 1).select(F.inline(F.array(*structs)))


def active_priority(active: ActiveSources) -> Column:
    """Rank of a row's source in the active list; NULL when the source is not active."""
    rank = F.lit(None).cast("int")
    for place, (source, data_source) in reversed(list(enumerate(active))):
        hit = (F.col("source") == source) & (F.col("data_source") == data_source)
        rank = F.when(hit, F.lit(place)).otherwise(rank)
    return rank


def only_active(frame: DataFrame, active: ActiveSources) -> DataFrame:
    """Rows of active sources with their `prio`; the source test reaches the scan."""
    return (
        frame.where(F.col("source").isin([s for s, _ in active]))
        .withColumn("prio", active_priority(active))
        .where(F.col("prio").isNotNull())
    )
