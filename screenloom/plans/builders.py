"""Builders of the concrete knowledge sources from local inputs: gene effects, protein network space, drug profiles, structures, sequences, gene texts.

A builder reads files that a user has (nothing is fetched) and gives (key, vector) or (key, text), checked as a source must be: one row a key,
vectors of one length without missing or infinite values. ``local_registry`` makes tools of those whose inputs are named.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from screenloom.functions import text as T
from screenloom.operators import knowledge as K
from screenloom.plans.runs import embed_distinct, must_be_empty
from screenloom.plans.tools import Registry, Tool
from screenloom.sources import readers
from screenloom.sources.shared import materialised

Embed = Callable[[list[str]], list[list[float]]]


def source_problems(source: DataFrame) -> dict[str, DataFrame]:
    """What makes (key, vector) no source: keys that are null, blank or repeated, values that are missing or infinite, several lengths."""
    wrong = F.exists("vector", lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    lengths = source.select(F.size("vector").alias("n")).distinct()
    return {
        "blank key": source.filter("key IS NULL OR trim(key) = ''").select("key"),
        "repeated key": source.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"),
        "value that is none": source.filter(F.col("vector").isNull() | wrong).select("key"),
        "several lengths": lengths.agg(F.count("*").alias("lengths")).filter("lengths > 1"),
    }


def gene_effects(spark: SparkSession, path: str) -> DataFrame:
    """(key, vector): a wide table of models by ``SYMBOL (ID)``, one vector a gene in the order of models; missing effects are 0."""
    wide = readers.read_wide(spark, path)
    table = K.gene_effect_matrix(wide, wide.columns[0])
    return table.select(F.col("symbol").alias("key"), F.col("values").cast("array<float>").alias("vector"))


def network_space(spark: SparkSession, vectors: str, info: str) -> DataFrame:
    """(key, vector): a protein table (protein, pos, vector) and a table of preferred names; the first protein of a name stands for it."""
    names = readers.read_strings(spark, info).select(F.col("string_protein_id").alias("protein"), F.col("preferred_name").alias("name"))
    told = K.first_protein_per_name(spark.read.parquet(vectors).select("protein", "pos", "vector"), names.dropna())
    return told.select(F.col("name").alias("key"), F.col("vector").cast("array<float>").alias("vector"))


def dense_profiles(values: DataFrame, feature: str) -> DataFrame:
    """(key, feature, value) to (key, vector): one place for each feature that occurs, in their order; what a key lacks is 0, keys without any value go.

    Features are cell lines or image features, some thousands at most; they travel as one row.
    """
    axis = values.select(feature).distinct().agg(F.array_sort(F.collect_list(feature)).alias("axis"))
    finite = values.filter(F.col("value").isNotNull() & ~F.isnan(F.col("value").cast("double")))
    rows = finite.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct(feature, F.col("value").cast("double")))).alias("m"))
    vector = F.transform("axis", lambda a: F.try_element_at("m", a))
    return K.export_profiles(rows.crossJoin(F.broadcast(axis)).select("key", vector.alias("vector")))


def viability_profiles(spark: SparkSession, queries: str, measured: str) -> DataFrame:
    """(key, vector): drugs at a dose (key, drug, dose) against a table (drug, cell, screen, dose, value): medians at the nearest dose, a redone screen preferred."""
    asked = spark.read.parquet(queries)
    rows = K.prefer_redo(spark.read.parquet(measured))
    near = K.nearest_dose(asked, rows)
    medians = near.groupBy("drug", "query_dose", "cell").agg(F.median("value").alias("value"))
    keyed = medians.join(asked.select("key", "drug", F.col("dose").alias("query_dose")), ["drug", "query_dose"])
    return dense_profiles(keyed.select("key", "cell", "value"), "cell")


def signature_profiles(spark: SparkSession, queries: str, signatures: str) -> DataFrame:
    """(key, vector): drugs at a dose (key, drug, dose) against signatures (drug, cell, pert_dose, dose_unit, hours, value)."""
    asked = spark.read.parquet(queries)
    near = K.nearest_signature(asked, spark.read.parquet(signatures))
    return dense_profiles(near.join(asked.select("key", "drug", "dose"), ["drug", "dose"]).select("key", "cell", "value"), "cell")


def morphology_profiles(spark: SparkSession, wells: str) -> DataFrame:
    """(key, vector): medians of wells (key, feature, value)."""
    return dense_profiles(K.median_profiles(spark.read.parquet(wells), "key", "feature"), "feature")


def structure_vectors(spark: SparkSession, drugs: str, embed: Embed) -> DataFrame:
    """(key, vector): a metadata table (key, smiles); each distinct structure goes through the model once, drugs without one have no row."""
    table = readers.read_table(spark, drugs).select("key", T.clean(F.col("smiles")).alias("text"))
    return embed_distinct(table.filter("text <> ''"), embed)


def sequence_vectors(spark: SparkSession, proteins: str, embed: Embed, size: int = 1022) -> DataFrame:
    """(key, vector): sequences (key, sequence) cut into windows that overlap by half, each distinct window through the model once, means over a sequence's windows.

    Sequences with a letter that is no amino acid have no row.
    """
    table = readers.read_table(spark, proteins).select("key", F.upper("sequence").alias("sequence")).filter(T.valid_sequence(F.col("sequence")))
    step = max(1, size // 2)
    last = F.greatest(F.lit(0), F.ceil((F.length("sequence") - size) / step)).cast("int")
    windows = table.select("key", F.posexplode(F.transform(F.sequence(F.lit(0), last), lambda i: F.substring("sequence", i * step + 1, F.lit(size)))).alias("w", "text"))
    embedded = embed_distinct(windows.select(F.struct("key", "w").alias("key"), "text"), embed)
    places = embedded.select(F.col("key.key").alias("key"), F.posexplode("vector").alias("d", "v"))
    means = places.groupBy("key", "d").agg(F.avg("v").alias("v"))
    return means.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "v"))), lambda x: x["v"].cast("float")).alias("vector"))


def gene_texts(spark: SparkSession, gene_info: str, summaries: str | None = None, tax_id: str = "9606") -> DataFrame:
    """(key, text): protein-coding genes of one organism by symbol, their summary (Symbol, summary) where there is one, else their full name."""
    info = readers.protein_coding(readers.read_taxon(spark, gene_info, tax_id))
    names = info.groupBy(F.col("Symbol").alias("key")).agg(F.min("description").alias("text"))
    tiers = [names.select("key", F.nullif(T.clean(F.col("text")), F.lit("")).alias("text"))]
    if summaries:
        table = readers.read_table(spark, summaries).groupBy(F.col("Symbol").alias("key")).agg(F.min(F.nullif(T.collapse(F.col("summary")), F.lit(""))).alias("text"))
        tiers.insert(0, table.filter("text IS NOT NULL"))
    return K.first_of_tiers(names, *tiers).select("key", F.coalesce("text", F.lit("")).alias("text"))


def local_registry(inputs: Mapping[str, Sequence[str]], embed: Mapping[str, Embed] | None = None) -> Registry:
    """Tools for the sources whose files are named in ``inputs``; structures, sequences and texts need a model in ``embed`` under their name.

    Every vector source is checked before it is written; ``gene_vectors`` embeds what ``gene_texts`` wrote.
    """
    embed = dict(embed or {})
    plain = {
        "gene_effects": gene_effects, "network_space": network_space, "viability_profiles": viability_profiles,
        "signature_profiles": signature_profiles, "morphology_profiles": morphology_profiles,
    }
    modelled = {"structure_vectors": structure_vectors, "sequence_vectors": sequence_vectors}
    if unknown := sorted(set(inputs) - set(plain) - set(modelled) - {"gene_texts"}):
        raise KeyError(f"unknown sources: {unknown}")
    if bare := sorted(n for n in modelled if n in inputs and n not in embed):
        raise ValueError(f"no model for {bare}")

    def checked(build: Callable[[SparkSession], DataFrame]) -> Callable[[SparkSession, Mapping[str, DataFrame]], DataFrame]:
        def run(spark: SparkSession, _: Mapping[str, DataFrame]) -> DataFrame:
            found = materialised(build(spark))  # the checks and the copy that is kept read it, none builds it again
            must_be_empty(source_problems(found))
            return found

        return run

    tools = [Tool(n, checked(lambda s, f=f, n=n: f(s, *inputs[n]))) for n, f in plain.items() if n in inputs]
    tools += [Tool(n, checked(lambda s, f=f, n=n: f(s, *inputs[n], embed[n]))) for n, f in modelled.items() if n in inputs]
    if "gene_texts" in inputs:
        tools.append(Tool("gene_texts", lambda s, _: gene_texts(s, *inputs["gene_texts"])))
        if "gene_vectors" in embed:
            tools.append(Tool("gene_vectors", lambda s, needed: embed_distinct(needed["gene_texts"].filter("text <> ''"), embed["gene_vectors"]), ("gene_texts",)))
    return Registry(tools)
