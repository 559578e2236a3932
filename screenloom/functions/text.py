"""Text expressions for keys and rendered cards, on the JVM side wherever number formatting allows."""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed value: amino-acid letters, ambiguous ones included.
AMINO_ACIDS = "ACDEFGHIKLMNPQRSTVWYBXZJUO"


def strip(value: Column) -> Column:
    """All white space off both ends; the built-in trim takes spaces only."""
    return F.regexp_replace(value, r"(?U)^\s+|\s+$", "")


def clean(value: Column) -> Column:
    """Stripped; null and a lone dash become empty."""
    text = strip(F.coalesce(value, F.lit("")))
    return F.when(text == "-", "").otherwise(text)


def collapse(value: Column) -> Column:
    """Cleaned, with runs of white space as one space."""
    return F.regexp_replace(clean(value), r"(?U)\s+", " ")


def clean_list(values: Column) -> Column:
    """Collapsed, without empties, one spelling (the first) for each case-insensitive value, sorted by (lower, raw)."""
    items = F.filter(F.transform(F.coalesce(values, F.array().cast("array<string>")), collapse), lambda x: x != "")
    none = F.array().cast("array<string>")
    first = F.aggregate(
        items, none, lambda acc, x: F.when(F.exists(acc, lambda y: F.lower(y) == F.lower(x)), acc).otherwise(F.concat(acc, F.array(x)))
    )
    pairs = F.array_sort(F.transform(first, lambda x: F.struct(F.lower(x).alias("l"), x.alias("r"))))
    return F.transform(pairs, lambda p: p["r"])


def pipe_list(field: Column) -> Column:
    return clean_list(F.split(clean(field), r"\|"))


def name_key(value: Column) -> Column:
    """Lower-case letters and digits alone."""
    return F.regexp_replace(F.lower(value), "[^a-z0-9]", "")


def valid_sequence(value: Column) -> Column:
    return F.coalesce(F.rlike(F.upper(value), F.lit(f"^[{AMINO_ACIDS}]+$")), F.lit(False))


def dose_key(key: Column) -> tuple[Column, Column]:
    """(name, dose) of ``name_1.5uM`` with any of three micro signs; nulls if it is none, or the dose isn't positive and finite."""
    pattern = r"^(.+)_([0-9.eE+-]+)(?:u|\u00b5|\u03bc)M$"
    dose = F.regexp_extract(key, pattern, 2).try_cast("double")
    fine = (dose > 0) & (dose < float("inf"))
    return F.when(fine, F.regexp_extract(key, pattern, 1)), F.when(fine, dose)


def is_control(key: Column, control: str) -> Column:
    name, _ = dose_key(key)
    return (key == control) | F.coalesce(name == control, F.lit(False))


def first_with_prefix(field: Column, prefix: str) -> Column:
    """The rest of the first pipe-separated token with ``prefix``; empty without one."""
    hit = F.get(F.filter(F.split(F.coalesce(field, F.lit("")), r"\|"), lambda t: F.startswith(t, F.lit(prefix))), 0)
    return F.coalesce(F.substring(hit, F.lit(len(prefix) + 1), F.length(hit)), F.lit(""))


def resolution_keys(symbol: Column) -> tuple[Column, Column]:
    """(ensembl id, symbol): a bare id, ``symbol_id``, or a symbol alone."""
    ensembl = F.regexp_extract(symbol, r"(?:^|_)(ENSG[0-9]+)$", 1)
    return F.nullif(ensembl, F.lit("")), F.nullif(F.regexp_replace(symbol, r"_?ENSG[0-9]+$", ""), F.lit(""))


def gene_type(raw: Column) -> Column:
    text = clean(raw)
    return F.when(text == "pseudo", "pseudogene").otherwise(text)


def synonym_tokens(value: Column) -> Column:
    return F.filter(F.split(F.coalesce(value, F.lit("")), r"[;\s]+"), lambda t: t != "")


def comment_confidence(comment: Column) -> Column:
    """4 without a remark, then 1 for a questioned link, 2 for no disease, 3 for a partial cause, else 1; the first rule that fits."""
    text = F.lower(F.coalesce(comment, F.lit("")))
    return (
        F.when(text.isin("", "-"), 4).when(F.contains(text, F.lit("question")), 1).when(F.contains(text, F.lit("nondisease")), 2)
        .when(F.rlike(text, F.lit("susceptibility|somatic|modifier")), 3).otherwise(1)
    )


def split_key(key: Column) -> tuple[Column, Column]:
    """(dataset, context): the first dot divides."""
    return F.regexp_extract(key, r"^([^.]*)\.(.*)$", 1), F.regexp_extract(key, r"^([^.]*)\.(.*)$", 2)


def redact(text: Column) -> Column:
    """Values of key-like query parameters masked."""
    return F.regexp_replace(text, r"(?i)((?:api_?key|token|secret|password|access_key)=)[^&\s]+", "$1***")


def card(pairs: Sequence[tuple[str, Column]], joint: str = " ;\n") -> Column:
    """``label: value`` segments in order; empty values are left out."""
    segments = [F.when(collapse(v) != "", F.concat(F.lit(f"{label}: "), collapse(v))) for label, v in pairs]
    return F.concat_ws(joint, *segments)


#: Order, titles and introductions of a gene card's sections.
GENE_INFO = ("=== GENE INFO ===", "Basic gene identifiers, genomic location, synonyms, and database cross-references.")
SUMMARY = ("=== SUMMARY ===", "Free-text summary of gene function from NCBI.")
ONTOLOGIES = [
    ("Process", "=== GO BIOLOGICAL PROCESS ===", "Gene Ontology biological process annotations, sorted by evidence count."),
    ("Function", "=== GO MOLECULAR FUNCTION ===", "Gene Ontology molecular function annotations, sorted by evidence count."),
    ("Component", "=== GO CELLULAR COMPONENT ===", "Gene Ontology cellular component annotations, sorted by evidence count."),
]
DISEASES = (
    "=== DISEASE ASSOCIATIONS ===",
    "Known disease associations with confidence scores and OMIM (Online Mendelian Inheritance in Man) identifiers.",
)
GROUPS = ("=== GENE GROUPS ===", "Gene family and group memberships by relationship type.")


def listed(values: Column, none: str = "None") -> Column:
    """A list on one line, or a word for an empty one."""
    return F.when(F.size(values) > 0, F.array_join(values, ", ")).otherwise(none)


def term_line(term: Column) -> Column:
    return F.concat(F.lit("- "), term["go_id"], F.lit(": "), term["term"], F.lit(" (evidence: "), term["evidence_count"].cast("string"), F.lit(")"))


def disease_line(disease: Column) -> Column:
    none = F.lit("N/A")
    return F.concat(
        F.lit("- "), F.coalesce(disease["name"], none), F.lit(" (confidence: "), F.coalesce(disease["confidence"].cast("string"), none),
        F.lit(", MIM: "), F.coalesce(disease["mim"].cast("string"), none), F.lit(")"),
    )


def gene_text(
    symbol: Column,
    terms: dict[str, Column],
    diseases: Column,
    groups: Column,
    info: Sequence[tuple[str, Column]] | None = None,
    summary: Column | None = None,
    keep_symbol: bool = True,
) -> Column:
    """Sectioned gene card. ``terms`` has sorted arrays by ontology, ``groups`` is array<struct(relation, members)>.

    Without ``info`` a line with the symbol may lead; empty sections say None.
    """

    def block(head: Sequence[str], lines: Column) -> Column:
        body = F.when(F.size(lines) > 0, F.array_join(lines, "\n")).otherwise("None")
        return F.concat(F.lit("\n" + "\n".join(head) + "\n"), body)

    parts: list[Column] = []
    if info is not None:
        parts.append(F.concat_ws("\n", F.lit("\n".join(GENE_INFO)), *[F.concat(F.lit(f"{k}: "), v) for k, v in info]))
    elif keep_symbol:
        parts.append(F.concat(F.lit("Gene: "), symbol))
    if summary is not None:
        text = F.coalesce(F.nullif(summary, F.lit("")), F.lit("No summary available."))
        parts.append(F.concat(F.lit("\n" + "\n".join(SUMMARY) + "\n"), text))
    parts += [block(head, F.transform(terms[k], term_line)) for k, *head in ONTOLOGIES if k in terms]
    parts.append(block(DISEASES, F.transform(diseases, disease_line)))
    parts.append(block(GROUPS, F.transform(groups, lambda g: F.concat(F.lit("- "), g["relation"], F.lit(": "), F.array_join(g["members"], ", ")))))
    return strip(F.concat_ws("\n", *parts))


#: Stages of life that stand for an age.
STAGES = ["Adolescent", "Adult", "Blastocyst stage", "Children", "Embryo", "Fetus", "Juvenile"]


def age_text(raw: Column, stages: Sequence[str] = STAGES) -> Column:
    """``12Y6M`` to ``12 years, 6 months``; unspecified is empty, stages stay as they are, anything else is an error."""

    def part(letter: str, unit: str) -> Column:
        n = F.regexp_extract(raw, rf"([0-9]+){letter}", 1).try_cast("int")
        return F.when(n.isNotNull(), F.concat(n.cast("string"), F.lit(f" {unit}"), F.when(n == 1, "").otherwise("s")))

    text = F.concat_ws(", ", part("Y", "year"), part("M", "month"), part("D", "day"))
    return (
        F.when((raw == "Age unspecified") | (clean(raw) == ""), "").when(raw.isin(list(stages)), raw)
        .when(F.rlike(raw, F.lit("^(?:[0-9]+Y)?(?:[0-9]+M)?(?:[0-9]+D)?$")), text)
        .otherwise(F.raise_error(F.concat(F.lit("unknown age: "), raw)).cast("string"))
    )


@F.pandas_udf(T.StringType())
def number_text(values: pd.Series) -> pd.Series:
    """Numbers as Python prints them: whole ones without a point, no exponent below 1e16."""

    def one(v: float | None) -> str | None:
        if v is None or v != v:
            return None
        return str(int(v)) if math.isfinite(v) and v == int(v) else repr(float(v))

    return values.map(one)


#: A compound's fields, their labels and units.
COMPOUND_FIELDS = [
    ("molecular_formula", "Molecular Formula", ""),
    ("molecular_weight", "Molecular Weight", " g/mol"),
    ("smiles", "SMILES", ""),
    ("connectivity_smiles", "Connectivity SMILES", ""),
    ("xlogp", "XLogP", ""),
    ("topological_polar_surface_area", "Topological Polar Surface Area", " square angstroms"),
    ("complexity", "Complexity", ""),
    ("formal_charge", "Formal Charge", ""),
    ("hydrogen_bond_donor_count", "Hydrogen Bond Donors", ""),
    ("hydrogen_bond_acceptor_count", "Hydrogen Bond Acceptors", ""),
    ("rotatable_bond_count", "Rotatable Bonds", ""),
]


def drug_text(name: Column, dose: Column, title: Column, synonyms: Column, fields: dict[str, Column], description: Column) -> Column:
    """Card of a compound of one component: name, other title, ten synonyms, fields with units, description, dose in micromolar."""
    values = [
        (label, F.when(collapse(fields[f]) != "", F.concat(collapse(fields[f]), F.lit(unit))))
        for f, label, unit in COMPOUND_FIELDS
        if f in fields
    ]
    if {"smiles", "connectivity_smiles"} <= fields.keys():
        same = collapse(fields["smiles"]) == collapse(fields["connectivity_smiles"])
        values = [(k, F.when(~same, v) if k == "Connectivity SMILES" else v) for k, v in values]
    kept = F.filter(F.transform(synonyms, collapse), lambda x: x != "")
    distinct = F.aggregate(
        kept, F.array().cast("array<string>"),
        lambda acc, x: F.when(F.exists(acc, lambda y: F.lower(y) == F.lower(x)), acc).otherwise(F.concat(acc, F.array(x))),
    )
    return card(
        [
            ("Compound Name", name),
            ("PubChem Compound", F.when(F.lower(collapse(title)) != F.lower(collapse(name)), title)),
            ("Synonyms", F.array_join(F.slice(distinct, 1, 10), ", ")),
            *values,
            ("Compound Description", description),
            ("Dose", F.when(dose.isNotNull(), F.concat(number_text(dose), F.lit(" micromolar")))),
        ]
    )


def primary_description(descriptions: Column, preferred: Sequence[str]) -> Column:
    """Text of the best source of array<struct(source, text)>: in the order of ``preferred``, else the first."""

    def of(source: str) -> Column:
        return F.get(F.filter(descriptions, lambda d: d["source"] == source), 0)["text"]

    return F.coalesce(*[of(s) for s in preferred], F.get(descriptions, 0)["text"], F.lit(""))


def token_windows(tokens: Column, size: int) -> Column:
    """Windows of ``size`` tokens at half-size steps up to the one that reaches the end; shorter lists are one window."""
    step = max(1, size // 2)
    last = F.greatest(F.lit(0), F.ceil((F.size(tokens) - size) / step)).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(tokens, i * step + 1, size))
