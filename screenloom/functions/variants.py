"""Cell-line parts whose upstream encodings share no struct, read from variants.

A name is a string in one release and an object with a value in another, a cell type a list or one object, parents stand in two lists of
different fields. Each field is a chain of paths over the record's variant; the first that gives something wins.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from screenloom.functions.text import clean_list, strip


#: Records that one task reads.
TASK_RECORDS = 5000


def bound(value: Column, told: Callable[[Column], Column]) -> Column:
    """``told`` of a value that is worked out once: expressions in lambdas are not shared, each mention is a computation of its own."""
    return F.element_at(F.transform(F.array(value), told), 1)


def scalar(v: Column, path: str) -> Column:
    """The cleaned text at a path; empty for what is missing, null, an object or a list."""
    kind = F.schema_of_variant(F.try_variant_get(v, path, "variant"))
    text = strip(F.coalesce(F.try_variant_get(v, path, "string"), F.lit("")))
    return F.when(kind.rlike("^(OBJECT|ARRAY)"), "").otherwise(F.regexp_replace(text, r"\A-\z", ""))


def members(v: Column, path: str) -> Column:
    """The objects of a list at a path; none if there is no list."""
    items = F.coalesce(F.try_variant_get(v, path, "array<variant>"), F.array().cast("array<variant>"))
    return F.filter(items, is_object)


def is_object(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))


def first_text(*values: Column) -> Column:
    """The first that is not empty, or the empty text."""
    return F.coalesce(F.get(F.filter(F.array(*values), lambda v: v != ""), 0), F.lit(""))


def reference(v: Column, *paths: str) -> Column:
    """struct(database, accession) at the first of ``paths`` that has either; a path ends in the object that holds both."""
    told = F.array(*[F.struct(scalar(v, f"{path}.database").alias("database"), scalar(v, f"{path}.accession").alias("accession")) for path in paths])
    found = F.filter(told, lambda x: (x["database"] != "") | (x["accession"] != ""))
    return F.coalesce(F.get(found, 0), F.struct(F.lit("").alias("database"), F.lit("").alias("accession")))


def distinct_records(records: Column, fields: Sequence[str]) -> Column:
    """Records with something in them, the first of each case-insensitive value, in the order of (lower, raw) of their fields."""
    keyed = F.transform(records, lambda r: F.struct(F.array(*[F.lower(r[f]) for f in fields]).alias("k"), r.alias("r")))

    def first(keyed: Column) -> Column:
        return F.transform(F.array_distinct(F.transform(keyed, lambda x: x["k"])), lambda k: F.get(F.filter(keyed, lambda x: x["k"] == k), 0)["r"])

    told = bound(F.filter(keyed, lambda x: F.array_max(x["k"]) != ""), first)
    ordered = F.array_sort(F.transform(told, lambda r: F.struct(*[c for f in fields for c in (F.lower(r[f]).alias(f"{f}_l"), r[f].alias(f"{f}_r"))])))
    return F.transform(ordered, lambda o: F.struct(*[o[f"{f}_r"].alias(f) for f in fields]))


def cell_type(v: Column) -> Column:
    """struct(name, database, accession): of the first in the list of cell types, else of the one given alone; empties if that is no object."""
    listed = F.try_variant_get(v, "$['cell-type-list'][0]", "variant")

    def told(item: Column) -> Column:
        name = first_text(scalar(item, "$.label"), scalar(item, "$.value"))
        fields = bound(reference(item, "$['xref-list'][0]", "$.xref"), lambda r: F.struct(name.alias("name"), r["database"].alias("database"), r["accession"].alias("accession")))
        return F.when(is_object(item), fields).otherwise(F.struct(*[F.lit("").alias(n) for n in ("name", "database", "accession")]))

    return bound(F.coalesce(listed, F.try_variant_get(v, "$['cell-type']", "variant")), told)


def parents(v: Column) -> Column:
    """array<struct(name, accession)>: entries of type derived-from, their name and accession plain or with a value, and those of the other list."""
    typed = F.filter(members(v, "$['parent-list']"), lambda p: F.lower(scalar(p, "$.type")) == "derived-from")
    old = F.transform(
        typed,
        lambda p: F.struct(first_text(scalar(p, "$.name.value"), scalar(p, "$.name")).alias("name"), first_text(scalar(p, "$.accession.value"), scalar(p, "$.accession")).alias("accession")),
    )
    new = F.transform(members(v, "$['derived-from']"), lambda p: F.struct(scalar(p, "$.label").alias("name"), scalar(p, "$.accession").alias("accession")))
    return distinct_records(F.concat(old, new), ("name", "accession"))


def _nested(v: Column, path: str) -> Column:
    """Text that is plain, or an object's label, or its value."""
    return first_text(scalar(v, f"{path}.label"), scalar(v, f"{path}.value"), scalar(v, path))


def integrations(v: Column) -> Column:
    """array<struct(method, label, database, accession)>: the list's entries, and comments of that category."""

    def entry(i: Column) -> Column:
        label = first_text(scalar(i, "$.label"), _nested(i, "$.target"), _nested(i, "$.xref"))
        method = _nested(i, "$.method")
        told = reference(i, "$.xref", "$.target['xref-list'][0]", "$")
        return bound(told, lambda r: F.struct(method.alias("method"), label.alias("label"), r["database"].alias("database"), r["accession"].alias("accession")))

    listed = F.transform(members(v, "$['genetic-integration-list']"), entry)
    comments = F.filter(members(v, "$['comment-list']"), lambda c: F.lower(scalar(c, "$.category")) == "genetic integration")
    none = F.lit("")
    told = F.transform(comments, lambda c: F.struct(none.alias("method"), scalar(c, "$.value").alias("label"), none.alias("database"), none.alias("accession")))
    return distinct_records(F.concat(listed, told), ("method", "label", "database", "accession"))


def integration_line(i: Column) -> Column:
    """``label via method``, or the one that is there."""
    both = (i["label"] != "") & (i["method"] != "")
    return F.when(both, F.concat(i["label"], F.lit(" via "), i["method"])).otherwise(first_text(i["label"], i["method"]))


def cell_line_parts(raw: DataFrame, json_col: str = "json") -> DataFrame:
    """(key, cell_type, parents, integrations, integration_text) of JSON records; malformed ones give empties.

    Records are small and the work on each is not, so they are dealt to tasks by their number, not by their bytes.
    """
    v = F.col("v")
    dealt = raw.select("key", json_col).repartition(max(1, -(-raw.count() // TASK_RECORDS)))
    parsed = dealt.select("key", F.coalesce(F.try_parse_json(json_col), F.parse_json(F.lit("{}"))).alias("v"))
    told = parsed.select("key", cell_type(v).alias("cell_type"), parents(v).alias("parents"), integrations(v).alias("integrations"))
    return told.withColumn("integration_text", F.array_join(clean_list(F.transform("integrations", integration_line)), ", "))
