"""A vocabulary of structured data as tables: types and parents, properties, enumerations, superseded names.

Closures over the type hierarchy are recursive queries, and an inherited definition is the nearest one by a minimum over
the closure; nothing is read on the driver. ``from_release`` reads the published file of schema.org.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.store import scratch

#: Names that were superseded; members of the enumerations that property values are checked against.
DEPRECATED = ["reviews", "itemreviewed"]
ENUMERATIONS = {
    "ItemAvailability": "InStock OutOfStock PreOrder PreSale BackOrder Discontinued InStoreOnly LimitedAvailability OnlineOnly SoldOut".split(),
    "OfferItemCondition": "NewCondition UsedCondition RefurbishedCondition DamagedCondition".split(),
    "EventStatusType": "EventScheduled EventCancelled EventMovedOnline EventPostponed EventRescheduled".split(),
    "EventAttendanceModeEnumeration": "OfflineEventAttendanceMode OnlineEventAttendanceMode MixedEventAttendanceMode".split(),
    "ItemListOrderType": "ItemListOrderAscending ItemListOrderDescending ItemListUnordered".split(),
    "DayOfWeek": "Monday Tuesday Wednesday Thursday Friday Saturday Sunday PublicHolidays".split(),
}
#: Types that are checked by form.
SCALARS = ["Text", "URL", "Date", "DateTime", "Time", "Number", "Integer", "Boolean"]

_TYPES, _PROPERTIES, _MEMBERS = "type string, parents array<string>", "type string, property string, expected array<string>", "enumeration string, member string"
_CLOSURE = """
WITH RECURSIVE c (type, ancestor, path, names) AS (
  SELECT type, type, CAST(array() AS array<int>), array(type) FROM {types}
  UNION ALL
  SELECT c.type, e.parent, array_append(c.path, e.place), array_append(c.names, e.parent) FROM c JOIN {edges} e ON e.type = c.ancestor WHERE NOT array_contains(c.names, e.parent))
SELECT type, ancestor, min(path) AS path FROM c GROUP BY type, ancestor"""


class Vocabulary:
    """``types`` (type, parents), ``properties`` (type, property, expected types), ``enumerations`` (enumeration, member), ``deprecated`` names.

    Each is a table, or a mapping that becomes one: type to parents, (type, property) to expected types, enumeration to
    members. Parents that are no types themselves count as ancestors without properties. Circles of parents are read once around.
    """

    def __init__(self, types: DataFrame | Mapping[str, Sequence[str]], properties: DataFrame | Mapping[tuple[str, str], Sequence[str]], enumerations: DataFrame | Mapping[str, Sequence[str]] | None = None, deprecated: DataFrame | Sequence[str] | None = None) -> None:
        self._types, self._properties = types, properties
        self._enumerations = ENUMERATIONS if enumerations is None else enumerations
        self._deprecated = DEPRECATED if deprecated is None else deprecated
        self._made: dict[tuple[str, str], str] = {}

    @classmethod
    def load(cls, types: DataFrame, properties: DataFrame, enumerations: DataFrame | None = None, deprecated: DataFrame | None = None) -> Vocabulary:
        """From tables (type, parents array), (type, property, expected array), (enumeration, member) and (property)."""
        return cls(types, properties, enumerations, deprecated)

    @classmethod
    def from_release(cls, spark: SparkSession, path: str) -> Vocabulary:
        """From the file of all of schema.org, in JSON-LD, as it is published with each release (https or http names).

        Classes with their superclasses, properties with domains and ranges, members of enumerations, superseded properties.
        """
        node = spark.read.text(path, wholetext=True).select(F.explode(F.from_json(F.get_json_object("value", "$['@graph']"), "array<string>")).alias("node"))
        ids = lambda key: F.transform(F.regexp_extract_all(F.coalesce(F.get_json_object("node", f"$['{key}']"), F.lit("")), F.lit(r'"@id"\s*:\s*"([^"]+)"')), _short)
        kinds = F.coalesce(F.from_json(F.get_json_object("node", "$['@type']"), "array<string>"), F.array(F.get_json_object("node", "$['@type']")))
        rows = node.select(_short(F.get_json_object("node", "$['@id']")).alias("id"), F.transform(kinds, _short).alias("kinds"), *(ids(key).alias(name) for key, name in (("rdfs:subClassOf", "parents"), ("schema:domainIncludes", "domains"), ("schema:rangeIncludes", "ranges"), ("schema:supersededBy", "newer"))))
        classes = rows.where(F.array_contains("kinds", "rdfs:Class") & ~F.array_contains("kinds", "DataType"))
        properties = rows.where(F.array_contains("kinds", "rdf:Property"))
        own = properties.select(F.explode("domains").alias("type"), F.col("id").alias("property"), F.col("ranges").alias("expected"))
        members = rows.select(F.explode("kinds").alias("enumeration"), F.col("id").alias("member")).join(classes.select(F.col("id").alias("enumeration")), "enumeration", "left_semi")
        return cls(classes.select(F.col("id").alias("type"), "parents"), own, members, properties.where(F.size("newer") > 0).select(F.col("id").alias("property")))

    def types_df(self, spark: SparkSession) -> DataFrame:
        return self._types if isinstance(self._types, DataFrame) else spark.createDataFrame([(t, list(p)) for t, p in self._types.items()], _TYPES)

    def properties_df(self, spark: SparkSession) -> DataFrame:
        return self._properties if isinstance(self._properties, DataFrame) else spark.createDataFrame([(t, p, list(e)) for (t, p), e in self._properties.items()], _PROPERTIES)

    def members_df(self, spark: SparkSession) -> DataFrame:
        return self._enumerations if isinstance(self._enumerations, DataFrame) else spark.createDataFrame([(e, m) for e, ms in self._enumerations.items() for m in ms], _MEMBERS)

    def deprecated_df(self, spark: SparkSession) -> DataFrame:
        return self._deprecated if isinstance(self._deprecated, DataFrame) else spark.createDataFrame([(p,) for p in self._deprecated], "property string")

    def closure_df(self, spark: SparkSession) -> DataFrame:
        """(type, ancestor, path): every type with itself and all above it; path numbers the parents on the way, the first one found
        in the order in which parents are named, so its order is that of nearness."""
        types = self.types_df(spark)
        return self._kept(spark, "closure", lambda: spark.sql(_CLOSURE, types=types, edges=types.select("type", F.posexplode("parents").alias("place", "parent"))))

    def allowed_df(self, spark: SparkSession) -> DataFrame:
        """(known, property, expected): all properties of a type, an own definition before an inherited one."""

        def made() -> DataFrame:
            owned = self.properties_df(spark).groupBy("type", "property").agg(F.min("expected").alias("expected")).withColumnRenamed("type", "ancestor")
            above = self.closure_df(spark).join(owned, "ancestor")
            return above.groupBy(F.col("type").alias("known"), "property").agg(F.min_by("expected", "path").alias("expected"))

        return self._kept(spark, "allowed", made)

    def names(self, spark: SparkSession) -> Column:
        """All types, as an array that is computed once a query."""
        return self.types_df(spark).agg(F.sort_array(F.collect_set("type"))).scalar()

    def superseded(self, spark: SparkSession) -> Column:
        return self.deprecated_df(spark).agg(F.collect_set("property")).scalar()

    def _kept(self, spark: SparkSession, name: str, make) -> DataFrame:
        """A derived table, written once a session: its queries are many, and each would run the recursion again."""
        key = (spark.sparkContext.applicationId, name)
        if key not in self._made:
            path = scratch(spark, f"vocabulary-{name}")
            make().coalesce(1).write.parquet(path)
            self._made[key] = path
        return spark.read.parquet(self._made[key])


def _short(name: Column) -> Column:
    return F.regexp_replace(name, r"^(https?://schema\.org/|schema:)", "")
