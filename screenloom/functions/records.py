"""Nested records: cell-line JSON to flat entries, and their text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from screenloom.functions.text import age_text, card, clean_list, collapse

REFERENCE = "struct<database:string,accession:string>"
#: Layout of one upstream cell-line record.
CELL_LINE = (
    "struct<"
    "`accession-list`:array<struct<type:string,value:string>>,"
    "`name-list`:array<struct<type:string,value:string>>,"
    "`species-list`:array<struct<label:string,accession:string>>,"
    f"`derived-from-site-list`:array<struct<site:struct<`site-type`:string,value:string,`xref-list`:array<{REFERENCE}>>>>,"
    "`disease-list`:array<struct<label:string,accession:string>>,"
    "`sequence-variation-list`:array<struct<`variation-type`:string,`mutation-description`:string,`zygosity-type`:string,`variation-note`:string,"
    "`xref-list`:array<struct<label:string>>>>,"
    f"`xref-list`:array<{REFERENCE}>,"
    "age:string,sex:string,category:string>"
)


def parse_cell_lines(raw: DataFrame, json_col: str = "json") -> DataFrame:
    """(key, record): malformed JSON gives a null record."""
    return raw.select("key", F.from_json(json_col, CELL_LINE).alias("r"))


def _of_type(values: Column, kind: str) -> Column:
    return F.transform(F.filter(values, lambda x: x["type"] == kind), lambda x: x["value"])


def cell_line_entries(parsed: DataFrame) -> DataFrame:
    """One flat entry per record: exactly one primary accession and one human species, else an error."""
    r = F.col("r")
    primary = _of_type(r["accession-list"], "primary")
    accession = F.when(F.size(primary) == 1, F.get(primary, 0)).otherwise(
        F.raise_error(F.concat(F.lit("primary accessions of "), F.col("key"))).cast("string")
    )
    species = r["species-list"]
    one_human = (F.size(species) == 1) & (F.get(species, 0)["accession"] == "9606")
    human = F.when(one_human, F.get(species, 0)["label"]).otherwise(F.raise_error(F.concat(F.lit("species of "), F.col("key"))).cast("string"))
    sites = F.transform(
        F.coalesce(r["derived-from-site-list"], F.array().cast("array<struct<site:struct<`site-type`:string,value:string,`xref-list`:array<struct<database:string,accession:string>>>>>")),
        lambda s: F.struct(
            collapse(s["site"]["value"]).alias("site"), collapse(s["site"]["site-type"]).alias("kind"), F.get(s["site"]["xref-list"], 0)["accession"].alias("reference")
        ),
    )
    variations = F.transform(
        r["sequence-variation-list"],
        lambda v: F.struct(
            F.array_join(clean_list(F.transform(v["xref-list"], lambda x: x["label"])), "/").alias("genes"),
            collapse(v["variation-type"]).alias("kind"),
            collapse(v["mutation-description"]).alias("mutation"),
            collapse(v["zygosity-type"]).alias("zygosity"),
            collapse(v["variation-note"]).alias("note"),
        ),
    )
    keyed = F.transform(variations, lambda v: F.struct(F.lower(v["genes"]).alias("a"), F.lower(v["kind"]).alias("b"), F.lower(v["mutation"]).alias("c"), v.alias("v")))
    distinct = F.aggregate(
        keyed,
        F.filter(keyed, lambda x: F.lit(False)),
        lambda acc, x: F.when(F.exists(acc, lambda y: (y["a"] == x["a"]) & (y["b"] == x["b"]) & (y["c"] == x["c"])), acc).otherwise(F.concat(acc, F.array(x))),
    )

    def references(database: str) -> Column:
        own = F.filter(r["xref-list"], lambda x: x["database"] == database)
        return clean_list(F.transform(own, lambda x: x["accession"]))

    return parsed.select(
        "key",
        accession.alias("accession"),
        F.get(_of_type(r["name-list"], "identifier"), 0).alias("name"),
        clean_list(_of_type(r["name-list"], "synonym")).alias("synonyms"),
        human.alias("species"),
        sites.alias("sites"),
        clean_list(F.transform(r["disease-list"], lambda d: d["label"])).alias("diseases"),
        F.transform(F.array_sort(distinct), lambda x: x["v"]).alias("variations"),
        *[references(d).alias(d.lower()) for d in ("DepMap", "ATCC", "Cosmic")],
        r["age"].alias("age"),
        r["sex"].alias("sex"),
        r["category"].alias("category"),
    )


def variation_line(v: Column) -> Column:
    """``genes: kind, mutation (zygosity; note)``, empties left out."""
    body = F.concat_ws(", ", F.nullif(v["kind"], F.lit("")), F.nullif(v["mutation"], F.lit("")))
    line = F.concat_ws(": ", F.nullif(v["genes"], F.lit("")), F.nullif(body, F.lit("")))
    inside = F.concat_ws("; ", F.nullif(v["zygosity"], F.lit("")), F.nullif(v["note"], F.lit("")))
    return F.when(inside == "", line).when(line == "", inside).otherwise(F.concat(line, F.lit(" ("), inside, F.lit(")")))


def cell_line_text(entries: DataFrame, stimulation: Sequence[tuple[str, Column]] = ()) -> DataFrame:
    """(key, text): the fields in fixed order, empties left out; segments of a stimulation follow."""
    pairs = [
        ("Context Name", F.col("key")),
        ("Recommended Name", F.col("name")),
        ("Synonyms", F.array_join("synonyms", ", ")),
        ("Cell Line Category", F.col("category")),
        ("Organism", F.col("species")),
        ("Sex", F.col("sex")),
        ("Age", age_text(F.coalesce("age", F.lit("")))),
        ("Disease", F.array_join("diseases", ", ")),
        ("Derived From Site", F.array_join(clean_list(F.transform("sites", lambda s: s["site"])), ", ")),
        ("Sequence Variation", F.array_join(clean_list(F.transform("variations", variation_line)), ", ")),
        *stimulation,
    ]
    return entries.select("key", card(pairs).alias("text"))


def json_list(value: Column, kind: str) -> Column:
    """A JSON list cell; blank or malformed gives an empty list."""
    parsed = F.from_json(F.coalesce(value, F.lit("")), f"array<{kind}>")
    return F.coalesce(parsed, F.array().cast(f"array<{kind}>"))


def merged_maps(maps: Column) -> Column:
    """A list of maps as one map; the last value of a key wins."""
    entries = F.flatten(F.transform(maps, F.map_entries))
    keys = F.array_distinct(F.transform(entries, lambda e: e["key"]))
    return F.map_from_entries(F.transform(keys, lambda k: F.struct(k, F.element_at(F.filter(entries, lambda e: e["key"] == k), -1)["value"])))


def canonical_map_hash(m: Column) -> Column:
    """SHA-256 of a map as JSON with sorted keys."""
    return F.sha2(F.to_json(F.map_from_entries(F.array_sort(F.map_entries(m)))), 256)
