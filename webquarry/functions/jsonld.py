"""Structured data: JSON-LD blocks as VARIANT."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import SCHEMA_TYPES


def _get(v: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, path, kind)


def blocks(jsonld: Column) -> Column:
    """array<variant>: the objects of all blocks, those of arrays too; broken JSON has none."""
    parsed = F.transform(jsonld, lambda s: F.try_parse_json(s))
    lists = F.transform(parsed, lambda v: F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.array(v)))
    return F.filter(F.flatten(F.filter(lists, lambda a: a.isNotNull())), lambda v: v.isNotNull() & F.schema_of_variant(v).startswith("OBJECT"))


def _text(v: Column, path: str) -> Column:
    return F.coalesce(_get(v, path), F.lit(""))


def entity(v: Column) -> Column:
    """The useful fields of one object."""
    logo = F.when(F.schema_of_variant(_get(v, "$.logo", "variant")).startswith("OBJECT"), _text(v, "$.logo.url")).otherwise(_text(v, "$.logo"))
    address = _get(v, "$.address", "variant")
    place = F.when(
        F.schema_of_variant(address).startswith("OBJECT"),
        F.struct(
            _text(address, "$.streetAddress").alias("street"), _text(address, "$.addressLocality").alias("city"),
            _text(address, "$.addressRegion").alias("region"), _text(address, "$.postalCode").alias("postal_code"),
            _text(address, "$.addressCountry").alias("country"),
        ),
    )
    hours = _get(v, "$.openingHoursSpecification", "variant")
    each = F.coalesce(F.try_variant_get(hours, "$", "array<variant>"), F.when(hours.isNotNull(), F.array(hours)), F.array().cast("array<variant>"))
    each = F.filter(each, lambda h: h.isNotNull() & F.schema_of_variant(h).startswith("OBJECT"))
    return F.struct(
        _text(v, '$["@type"]').alias("schema_type"), _text(v, "$.name").alias("name"), _text(v, "$.description").alias("description"),
        _text(v, "$.url").alias("url"), _text(v, "$.telephone").alias("telephone"), _text(v, "$.email").alias("email"), logo.alias("logo"),
        place.alias("address"),
        F.transform(each, lambda h: F.struct(_text(h, "$.dayOfWeek").alias("day"), _text(h, "$.opens").alias("opens"), _text(h, "$.closes").alias("closes"))).alias("opening_hours"),
    )


def _type(v: Column) -> Column:
    return F.when(F.schema_of_variant(_get(v, '$["@type"]', "variant")) == "STRING", _get(v, '$["@type"]'))


def entities(jsonld: Column) -> Column:
    """Objects of a useful type, one name each; lists of types and graphs are left out."""
    return F.transform(F.filter(blocks(jsonld), lambda v: F.coalesce(F.lower(_type(v)).isin(*SCHEMA_TYPES), F.lit(False))), entity)


def _tops(jsonld: Column) -> Column:
    """Blocks that are one object."""
    parsed = F.transform(jsonld, lambda s: F.try_parse_json(s))
    return F.filter(parsed, lambda v: v.isNotNull() & F.schema_of_variant(v).startswith("OBJECT"))


def values_of(jsonld: Column, key: str) -> Column:
    """Strings under ``key`` of blocks that are one object, lists flattened."""
    found = F.transform(_tops(jsonld), lambda v: F.coalesce(F.try_variant_get(v, f"$.{key}", "array<string>"), F.array(_get(v, f"$.{key}"))))
    return F.filter(F.flatten(found), lambda x: x.isNotNull() & (x != ""))


def _joined(a: Column) -> Column:
    parts = [F.when(_text(a, f"$.{k}") != "", _text(a, f"$.{k}")) for k in ("streetAddress", "addressLocality", "addressRegion", "postalCode")]
    return F.concat_ws(", ", *parts)


def postal_addresses(jsonld: Column) -> Column:
    """Parts joined by commas: of postal addresses with a street, and of contact points."""
    def of(v: Column) -> Column:
        own = F.when((_type(v) == "PostalAddress") & _get(v, "$.streetAddress", "variant").isNotNull(), _joined(v))
        point = F.when(_get(v, "$.contactPoint.address", "variant").isNotNull(), _joined(_get(v, "$.contactPoint.address", "variant")))
        return F.filter(F.array(own, point), lambda x: x.isNotNull() & (x != ""))

    return F.flatten(F.transform(_tops(jsonld), of))


def organisation_members(jsonld: Column) -> Column:
    """``name - title`` of an organisation's team and founders; a plain string is a name."""
    def people(v: Column, key: str) -> Column:
        x = _get(v, f"$.{key}", "variant")
        each = F.coalesce(F.try_variant_get(x, "$", "array<variant>"), F.when(x.isNotNull(), F.array(x)), F.array().cast("array<variant>"))
        full = lambda p: F.concat(F.coalesce(_get(p, "$.name"), F.when(F.schema_of_variant(p) == "STRING", _get(p, "$")), F.lit("")), F.lit(" - "), _text(p, "$.title"))
        return F.transform(each, lambda p: F.regexp_replace(full(p), "^[ -]+|[ -]+$", ""))

    mine = F.filter(_tops(jsonld), lambda v: F.coalesce(_type(v) == "Organization", F.lit(False)))
    return F.filter(F.flatten(F.transform(mine, lambda v: F.concat(people(v, "team"), people(v, "founder")))), lambda m: m != "")
