"""Knowledge sources: key resolution, coverage, comparison, nested groups, matching cascades, profiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from screenloom.sources.shared import materialised

TIE = 1e-10
#: Rows that one task sorts, more or less.
TASK_ROWS = 1 << 20


# --- keys -----------------------------------------------------------------------------------------


def resolve_keys(keys: DataFrame, source: DataFrame, aliases: DataFrame) -> DataFrame:
    """(key, found, how): a direct key wins; an alias counts only on a miss, and only if its target exists."""
    have = source.select(F.col("key").alias("have")).distinct()
    direct = keys.select("key").join(have, F.col("key") == F.col("have"), "left")
    targets = aliases.select(F.col("key").alias("alias_key"), "target").join(have.withColumnRenamed("have", "t"), F.col("target") == F.col("t"), "left_semi")
    joined = direct.join(targets, F.col("key") == F.col("alias_key"), "left")
    how = F.when(F.col("have").isNotNull(), "direct").when(F.col("target").isNotNull(), "alias").otherwise("missing")
    return joined.select("key", F.coalesce("have", "target").alias("found"), how.alias("how"))


def coverage(resolved: DataFrame, sample: int = 20) -> DataFrame:
    """One row: n, direct, alias, missing, and the first missing keys in order (a report of ``sample`` at most)."""
    first = resolved.filter("how = 'missing'").select("key").orderBy("key").limit(sample)
    keys = first.agg(F.array_sort(F.collect_list("key")).alias("k"))
    counts = [F.count_if(F.col("how") == h).alias(h) for h in ("direct", "alias", "missing")]
    return resolved.agg(F.count("*").alias("n"), *counts).withColumn("missing_keys", keys.scalar())


def layered_aliases(*layers: DataFrame) -> DataFrame:
    """(source, key, target) tables laid over each other: the last layer that has a key wins."""
    stacked = [layer.select("source", "key", "target", F.lit(i).alias("layer")) for i, layer in enumerate(layers)]
    union = stacked[0]
    for s in stacked[1:]:
        union = union.unionByName(s)
    return union.groupBy("source", "key").agg(F.max_by("target", "layer").alias("target"))


# --- vectors --------------------------------------------------------------------------------------


def cosine(a: Column, b: Column) -> Column:
    """1 if both are zero, 0 if one is."""

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    aa, bb = dot(a, a), dot(b, b)
    return F.when((aa == 0) & (bb == 0), 1.0).when((aa == 0) | (bb == 0), 0.0).otherwise(dot(a, b) / (F.sqrt(aa) * F.sqrt(bb)))


def compare_sources(new: DataFrame, reference: DataFrame) -> DataFrame:
    """(key, vector) tables: per common key, bitwise equality and cosine."""
    joined = new.select("key", F.col("vector").alias("a")).join(reference.select("key", F.col("vector").alias("b")), "key")
    return joined.select("key", (F.col("a") == F.col("b")).alias("equal"), cosine(F.col("a"), F.col("b")).alias("cosine"))


def comparison_summary(new: DataFrame, reference: DataFrame) -> DataFrame:
    """One row: keys of each side, common, equal rows, least and mean cosine."""
    told = compare_sources(new, reference).agg(
        F.count("*").alias("n_common"), F.count_if("equal").alias("n_equal"), F.min("cosine").alias("cosine_min"), F.avg("cosine").alias("cosine_mean")
    )
    return told.withColumns(
        {"n_new": new.agg(F.count("*").alias("n")).scalar(), "n_reference": reference.agg(F.count("*").alias("n")).scalar()}
    )


def token_sample(lengths: DataFrame, size: int = 256, ranges: int = 64) -> DataFrame:
    """Systematic sample: every n-th of the keys whose two lengths agree, ``size`` at most.

    Keys are numbered range by range: a key's place is its place in its range, after the counts of the ranges before it.
    """
    equal = lengths.filter(F.col("a_len") == F.col("b_len")).select("key")
    # the ranges' upper ends, a row each; the same ones for counts and keys
    tops = equal.repartitionByRange(ranges, "key").groupBy(F.spark_partition_id()).agg(F.max("key").alias("top")).collect()
    bounds = F.array(*[F.lit(t) for t in sorted(r["top"] for r in tops)[:-1]]).cast(T.ArrayType(lengths.schema["key"].dataType))
    dealt = equal.withColumn("part", F.size(F.filter(bounds, lambda b: b < F.col("key"))))
    counts = dealt.groupBy("part").agg(F.count("*").alias("c"))
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select("part", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("before"))
    numbered = dealt.withColumn("k", F.row_number().over(W.partitionBy("part").orderBy("key")) - 1).join(starts, "part")
    n = counts.agg(F.sum("c").alias("n")).scalar()
    step = F.greatest(F.lit(1), F.ceil(n / size))
    return numbered.filter((F.col("before") + F.col("k")) % step == 0).select("key")


def token_vectors(tokens: DataFrame) -> DataFrame:
    """(key, pos, vector) to (key, vectors) in position order."""
    return tokens.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "vector"))), lambda t: t["vector"]).alias("vectors"))


# --- genes ----------------------------------------------------------------------------------------


def go_counts(annotations: DataFrame) -> DataFrame:
    """(gene, category, terms): per term its rows and first name; by count descending, then term id."""
    per_term = annotations.groupBy("gene", "category", "go_id").agg(F.count("*").alias("n"), F.min_by("term", "ord").alias("term"))
    entry = F.struct((-F.col("n")).alias("o"), "go_id", "term", F.col("n").alias("evidence_count"))
    listed = per_term.groupBy("gene", "category").agg(F.array_sort(F.collect_list(entry)).alias("l"))
    return listed.select("gene", "category", F.transform("l", lambda x: F.struct(x["go_id"].alias("go_id"), x["term"].alias("term"), x["evidence_count"].alias("evidence_count"))).alias("terms"))


def group_relations(pairs: DataFrame, wanted: DataFrame, symbols: DataFrame) -> DataFrame:
    """(gene, relation, members): each relation counts for both sides that are wanted; members by symbol, else id."""
    both = pairs.select("gene", "relation", "other").unionByName(pairs.select(F.col("other").alias("gene"), "relation", F.col("gene").alias("other")))
    kept = both.join(wanted.select("gene"), "gene", "left_semi")
    named = kept.join(symbols.select(F.col("gene").alias("other"), "symbol"), "other", "left")
    name = F.coalesce("symbol", F.col("other").cast("string"))
    return named.groupBy("gene", "relation").agg(F.array_sort(F.collect_set(name)).alias("members"))


def greedy_claims(stream: DataFrame, symbols: DataFrame) -> DataFrame:
    """(symbol, row, by): primary names claim rows in symbol order, then synonyms; a row is claimed once.

    ``stream(row, name, primary)``: the names of each row; the first row that lists a name owns it. A symbol
    whose primary row is taken is dropped, it does not try its synonyms.
    """
    owners = stream.groupBy("name", "primary").agg(F.min("row").alias("row"))
    asked = symbols.select(F.col("symbol").alias("name"), "pos")
    primary = asked.join(owners.filter("primary"), "name")
    once = W.partitionBy("row").orderBy("pos")
    first = primary.withColumn("k", F.row_number().over(once))
    claimed = first.filter("k = 1").select("name", "row", F.lit("primary").alias("by"))
    rest = asked.join(primary.select("name"), "name", "left_anti").join(owners.filter("NOT primary"), "name")
    free = rest.join(claimed.select("row"), "row", "left_anti").withColumn("k", F.row_number().over(once)).filter("k = 1")
    both = claimed.unionByName(free.select("name", "row", F.lit("synonym").alias("by")))
    return both.select(F.col("name").alias("symbol"), "row", "by")


def resolve_genes(queries: DataFrame, index: DataFrame) -> DataFrame:
    """(key, gene, how): by Ensembl id, then symbol, then synonym, ignoring case; the first step that finds candidates decides.

    ``queries(key, ensembl, symbol)``, ``index(kind, name, gene)`` with kinds ensembl, symbol, synonym. Several
    candidates are ambiguous, unless a symbol among them narrows those of an Ensembl id to one.
    Names are summed up before the queries meet them, so that an id of very many genes costs a query one row.
    """
    kinds = ("ensembl", "symbol", "synonym")
    keyed = index.select("kind", F.lower("name").alias("name"), "gene").distinct()
    counted = keyed.groupBy("kind", "name").agg(F.count("gene").alias("n"), F.min("gene").alias("low"))
    # genes that an Ensembl id shares with a symbol
    ids, symbols = (keyed.filter(F.col("kind") == k).select("gene", F.col("name").alias(k)) for k in kinds[:2])
    shared = ids.join(symbols, "gene").groupBy("ensembl", "symbol").agg(F.count("*").alias("m"), F.min("gene").alias("named"))
    tried = [F.struct(F.lit(k).alias("kind"), F.lower(c).alias("name"), F.lit(i).alias("step")) for i, (k, c) in enumerate(zip(kinds, ("ensembl", "symbol", "symbol"), strict=True))]
    asked = queries.select("key", F.explode(F.array(*tried)).alias("q")).select("key", "q.*").filter("name IS NOT NULL").distinct()
    hits = asked.join(counted, ["kind", "name"]).select("key", "step", "n", "low")
    both = [asked.filter(F.col("kind") == k).select("key", F.col("name").alias(k)) for k in kinds[:2]]
    narrowed = both[0].join(both[1], "key").join(shared, ["ensembl", "symbol"]).select("key", "m", "named")
    every = hits.unionByName(narrowed, allowMissingColumns=True)

    def only(n: Column, gene: Column) -> list[Column]:
        """How many genes the most has, and the gene if there is one alone (several names of a key may have one each)."""
        return [F.max(n), F.when((F.max(n) == 1) & (F.min(gene) == F.max(gene)), F.min(gene))]

    at = [F.col("step") == i for i in range(3)]
    told = {f"g{i}": only(F.when(s, F.col("n")), F.when(s, F.col("low")))[1] for i, s in enumerate(at)} | {f"n{i}": F.max(F.when(s, F.col("n"))) for i, s in enumerate(at)}
    best = every.groupBy("key").agg(*[c.alias(n) for n, c in told.items()], only(F.col("m"), F.col("named"))[1].alias("named"))
    joined = queries.select("key").join(best, "key", "left")
    one = F.when(F.col("n0").isNotNull(), F.coalesce("g0", "named")).when(F.col("n1").isNotNull(), F.col("g1")).otherwise(F.col("g2"))
    how = F.when(F.coalesce("n0", "n1", "n2").isNull(), "missing").when(one.isNull(), "ambiguous").when(F.col("n0").isNotNull(), kinds[0]).when(F.col("n1").isNotNull(), kinds[1]).otherwise(kinds[2])
    return joined.select("key", one.alias("gene"), how.alias("how"))


def disease_lists(links: DataFrame, names: DataFrame) -> DataFrame:
    """(gene, diseases): phenotype links named by the last non-empty name of their concept; best confidence, then most sources first."""
    named = names.filter(F.trim("name") != "").groupBy("cui").agg(F.max_by("name", "ord").alias("name"))
    joined = links.filter("type = 'phenotype'").join(named, "cui", "left")
    entry = F.struct((-F.col("confidence")).alias("a"), (-F.col("n_sources")).alias("b"), "ord", "mim", "name", "confidence", "n_sources")
    listed = joined.groupBy("gene").agg(F.array_sort(F.collect_list(entry)).alias("l"))
    return listed.select("gene", F.transform("l", lambda x: F.struct(x["mim"].alias("mim"), x["name"].alias("name"), x["confidence"].alias("confidence"), x["n_sources"].alias("n_sources"))).alias("diseases"))


# --- compounds and profiles -----------------------------------------------------------------------


#: Rows and drugs of one key and name that one task matches at a time.
MATCH_BLOCK = 2048


def _stacked(tables: Sequence[DataFrame]) -> DataFrame:
    out = tables[0]
    for df in tables[1:]:
        out = out.unionByName(df)
    return out


def match_compounds(external: DataFrame, identities: DataFrame) -> DataFrame:
    """(ext_id, drug, how): InChIKey, then keys from SMILES, then normalised name; the first kind that hits decides.

    ``external(ext_id, inchikey, smiles_keys array, name_key, name)``, ``identities(drug, keys array, name_key, name)``.
    Several hits are narrowed to the exact name key, possibly to none. Hits are counted by their keys, and only those that stay
    are listed: by key and name, in blocks of both sides, so that a name of very many drugs and rows spreads over tasks.
    """
    tables = [("key", identities.select(F.explode("keys").alias("k"), "drug", "name_key")), ("name", identities.select(F.col("name_key").alias("k"), "drug", "name_key"))]
    known = materialised(_stacked([rows.select(F.lit(kind).alias("kind"), "k", "drug", F.col("name_key").alias("name")).filter("k IS NOT NULL").distinct() for kind, rows in tables]))
    keys = [("key", "inchikey", F.array("inchikey")), ("key", "smiles", F.col("smiles_keys")), ("name", "name", F.array("name_key"))]
    asked = _stacked([external.select("ext_id", F.col("name_key").alias("name"), F.lit(kind).alias("kind"), F.explode(k).alias("k"), F.lit(i).alias("step"), F.lit(how).alias("how")) for i, (kind, how, k) in enumerate(keys)])
    counted = known.groupBy("kind", "k").agg(F.count("*").alias("n"), F.min(F.struct("drug", "name")).alias("hit"))
    tried = asked.distinct().join(counted, ["kind", "k"]).withColumn("best", F.min("step").over(W.partitionBy("ext_id"))).filter("step = best")
    # a row of several keys may hit a drug more than once
    best = materialised(tried.withColumn("several", F.count("*").over(W.partitionBy("ext_id", "name")) > 1))
    # the only hit of a row stays whatever its name
    hit = F.struct("name", "hit")
    alone = best.groupBy("ext_id", "how").agg(F.max("n").alias("n"), F.min(hit).alias("low"), F.max(hit).alias("high")).filter("n = 1 AND low <=> high")
    alone = alone.filter(~F.coalesce(F.col("low.name") == F.col("low.hit.name"), F.lit(False))).select("ext_id", F.col("low.hit.drug").alias("drug"), "how")
    pair = ["kind", "k", "name"]
    sizes = best.groupBy(*pair).agg(F.count("*").alias("i_rows")).join(known.groupBy(*pair).agg(F.count("*").alias("j_rows")), pair)
    hits = sizes.agg(F.sum(F.col("i_rows") * F.col("j_rows"))).first()[0] or 0
    tasks = max(1, -(-hits // MATCH_BLOCK**2))
    sizes = sizes.select(*pair, *[F.ceil(F.col(f"{c}_rows") / MATCH_BLOCK).alias(f"{c}_blocks") for c in "ij"])

    def dealt(df: DataFrame, id_col: str, own: str, other: str) -> DataFrame:
        """Rows in their own block, once for each block of the other side."""
        at = df.join(sizes, pair).withColumn(own, F.pmod(F.xxhash64(id_col), F.col(f"{own}_blocks")))
        return at.withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"{other}_blocks") - 1))).drop("i_blocks", "j_blocks").repartition(tasks, *pair, "i", "j")

    met = dealt(best.select("ext_id", *pair, "how", "several"), "ext_id", "i", "j").join(dealt(known, "drug", "j", "i"), [*pair, "i", "j"])
    told = ["ext_id", "drug", "how"]
    once = met.filter("several").select("name", *told).distinct().select(told)
    return met.filter("NOT several").select(told).unionByName(once).unionByName(alone.select(told))


def nearest_dose(queries: DataFrame, measured: DataFrame, keys: Sequence[str] = ("drug",)) -> DataFrame:
    """Rows of ``measured(keys, dose, value)`` at the dose nearest to each query's on a log scale; ties to the lower dose.

    Distances are compared to 1e-10, doses taken as the same to a relative 1e-8; all rows at that dose stay. Doses that are not positive are
    near to nothing. Distinct doses and queries are merged in one order a key, each query sees the doses next below and above, and an
    equi-join on (keys, dose) brings the rows: no query meets all rows of its key.
    """
    keys = list(keys)
    asked = queries.select(*keys, F.col("dose").alias("query_dose")).distinct().filter("query_dose > 0")
    doses = measured.filter("dose > 0").select(*keys, F.col("dose").alias("at")).distinct().withColumn("lg", F.log10("at"))
    # doses that are one but for rounding stand together
    by = ", ".join(f"`{k}`" for k in keys)
    close = f"PARTITION BY {by} ORDER BY lg RANGE BETWEEN {2 * TIE}D PRECEDING AND {2 * TIE}D FOLLOWING"
    doses = doses.withColumn("band", F.expr(f"collect_list(at) OVER ({close})"))
    none = F.lit(None)
    line = doses.select(*keys, F.col("at").alias("x"), F.lit(0).alias("asks"), "band").unionByName(
        asked.select(*keys, F.col("query_dose").alias("x"), F.lit(1).alias("asks"), none.cast(doses.schema["band"].dataType).alias("band"))
    )
    ordered = W.partitionBy(*keys).orderBy("x", "asks")
    below = F.last("band", ignorenulls=True).over(ordered.rowsBetween(W.unboundedPreceding, 0))
    above = F.first("band", ignorenulls=True).over(ordered.rowsBetween(0, W.unboundedFollowing))
    bands = F.concat(*[F.coalesce(b, F.array().cast("array<double>")) for b in (below, above)])
    met = line.withColumn("near", bands).filter("asks = 1").select(*keys, F.col("x").alias("query_dose"), F.array_distinct("near").alias("near"))

    def distance(x: Column) -> Column:
        return F.abs(F.log10(x / F.col("query_dose")))

    met = met.withColumn("least", F.array_min(F.transform("near", distance)))
    met = met.withColumn("near", F.filter("near", lambda x: distance(x) <= F.col("least") + TIE)).withColumn("low", F.array_min("near"))
    chosen = met.select(*keys, "query_dose", F.explode(F.filter("near", lambda x: F.abs(x - F.col("low")) <= 1e-8 * F.abs("low"))).alias("dose"))
    others = [c for c in measured.columns if c not in keys]
    return chosen.join(measured, [*keys, "dose"]).select(*keys, "query_dose", *others)


def nearest_signature(queries: DataFrame, signatures: DataFrame, hours: float = 24.0) -> DataFrame:
    """(drug, dose, cell, value): median over signatures nearest in abs(log10 dose ratio) + abs(log2 hours ratio); ties within 1e-10 together.

    Doses in um, nm, mm or m; -666 is a missing value. Rows are dealt by drug to as many tasks as their number asks for, so what one task
    sorts does not grow with the table.
    """
    unit = F.create_map(*[F.lit(x) for x in ("um", 1.0, "nm", 1e-3, "mm", 1e3, "m", 1e6)])
    dose = F.col("pert_dose") * F.try_element_at(unit, F.lower("dose_unit"))
    rows = signatures.filter("value <> -666").withColumn("um", dose).filter("um > 0 AND hours > 0")
    tasks = max(-(-signatures.count() // TASK_ROWS), int(signatures.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    joined = queries.select("drug", "dose").distinct().repartition(tasks, "drug").join(rows.repartition(tasks, "drug"), "drug")
    distance = F.abs(F.log10(F.col("um") / F.col("dose"))) + F.abs(F.log2(F.col("hours") / hours))
    q = W.partitionBy("drug", "dose", "cell")
    near = joined.withColumn("d", distance).withColumn("least", F.min("d").over(q)).filter(F.col("d") <= F.col("least") + TIE)
    return near.groupBy("drug", "dose", "cell").agg(F.median("value").alias("value"))


def prefer_redo(rows: DataFrame, redo: str = "MTS010") -> DataFrame:
    """Finite values; where a cell has any of the redo screen, those alone."""
    v = F.col("value").cast("double")
    finite = rows.filter(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    has = F.max(F.col("screen") == redo).over(W.partitionBy("drug", "dose", "cell"))
    return finite.withColumn("has", has).filter(~F.col("has") | (F.col("screen") == redo)).drop("has")


def median_profiles(values: DataFrame, *keys: str) -> DataFrame:
    """Median of ``value`` by keys: wells of a drug and feature, or replicates of a cell."""
    return values.groupBy(*keys).agg(F.median("value").alias("value"))


def export_profiles(profiles: DataFrame) -> DataFrame:
    """(key, vector): single precision, infinite values are an error, rows without any value go, missing ones become 0."""
    v = F.transform("vector", lambda x: x.cast("float"))
    inf = F.exists(v, lambda x: F.abs(x) == float("inf"))
    checked = F.when(inf, F.raise_error(F.concat(F.lit("infinite value: "), F.col("key"))).cast("array<float>")).otherwise(v)
    clean = F.transform(checked, lambda x: F.when(x.isNull() | F.isnan(x), F.lit(0.0).cast("float")).otherwise(x))
    return profiles.filter(F.exists("vector", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")))).select("key", clean.alias("vector"))


def gene_effect_matrix(wide: DataFrame, id_col: str) -> DataFrame:
    """(symbol, values): wide ``"SYM (123)"`` columns to one list per gene in model order; the first column of a symbol counts, missing is 0."""
    import re

    seen: dict[str, str] = {}
    for c in wide.columns:
        if (m := re.fullmatch(r"(.+)\s+\((\d+)\)", c)) and (symbol := m[1].strip()) not in seen:
            seen[symbol] = c
    long = wide.select(F.col(id_col).alias("model"), *[F.col(f"`{c}`").cast("double").alias(s) for s, c in seen.items()]).unpivot("model", list(seen), "symbol", "value")
    ordered = F.array_sort(F.collect_list(F.struct("model", F.coalesce("value", F.lit(0.0)).alias("v"))))
    return long.groupBy("symbol").agg(F.transform(ordered, lambda x: x["v"]).alias("values"))


def merge_descriptions(prior: DataFrame, new: DataFrame, on_conflict: str = "error") -> DataFrame:
    """(key, text, state) upsert: prior rows, then new ones; a changed text is an error, kept or replaced."""
    joined = prior.select("key", F.col("text").alias("p")).join(new.select("key", F.col("text").alias("n")), "key", "full")
    differs = F.col("p").isNotNull() & F.col("n").isNotNull() & (F.col("p") != F.col("n"))
    picked = {
        "error": F.when(differs, F.raise_error(F.concat(F.lit("conflict: "), F.col("key"))).cast("string")).otherwise(F.coalesce("p", "n")),
        "keep-prior": F.coalesce("p", "n"),
        "replace": F.coalesce("n", "p"),
    }[on_conflict]
    state = F.when(F.col("p").isNull(), "new").when(differs & F.lit(on_conflict == "replace"), "changed").otherwise("kept")
    return joined.select("key", picked.alias("text"), state.alias("state"))


def unembedded(prior: DataFrame, keys: DataFrame) -> DataFrame:
    """Keys that have no vector yet: the only ones to embed."""
    return keys.select("key").distinct().join(prior.select("key"), "key", "left_anti")


# --- identities and tiers -------------------------------------------------------------------------


def first_of_tiers(keys: DataFrame, *tiers: DataFrame) -> DataFrame:
    """(key, text, tier): the text of the first of the (key, text) tables that has the key; null without any."""
    out = keys.select("key")
    for i, tier in enumerate(tiers):
        out = out.join(tier.select("key", F.col("text").alias(f"t{i}")), "key", "left")
    names = [f"t{i}" for i in range(len(tiers))]
    which = F.coalesce(*[F.when(F.col(n).isNotNull(), i) for i, n in enumerate(names)])
    return out.select("key", F.coalesce(*names).alias("text"), which.alias("tier"))


def compound_ids(names: DataFrame, metadata: DataFrame, overrides: DataFrame) -> DataFrame:
    """(name, cid, relationship): the reviewed override of a name, else its metadata id as primary.

    A name twice in the metadata, missing from it, without any id, or with an id that its override does not list is an error.
    """
    name = F.regexp_replace("drug", r"(?U)^\s+|\s+$", "")
    table = metadata.groupBy(name.alias("name")).agg(F.count("*").alias("n"), F.max("cid").alias("meta"))
    listed = overrides.groupBy("name").agg(F.collect_list(F.struct("cid", "relationship")).alias("o"))
    joined = names.select("name").distinct().join(table, "name", "left").join(listed, "name", "left")

    def error(text: str) -> Column:
        return F.raise_error(F.concat(F.lit(f"{text}: "), F.col("name"))).cast("array<struct<cid:bigint,relationship:string>>")

    own = F.array(F.struct(F.col("meta").cast("bigint").alias("cid"), F.lit("primary").alias("relationship")))
    given = F.col("o").cast("array<struct<cid:bigint,relationship:string>>")
    disagrees = F.col("meta").isNotNull() & ~F.exists("o", lambda x: x["cid"] == F.col("meta"))
    ids = (
        F.when(F.col("n").isNull(), error("not in the metadata")).when(F.col("n") > 1, error("twice in the metadata"))
        .when(F.col("o").isNotNull() & disagrees, error("id disagrees with its override")).when(F.col("o").isNotNull(), given)
        .when(F.col("meta").isNull(), error("no id")).otherwise(own)
    )
    return joined.select("name", F.explode(ids).alias("i")).select("name", "i.cid", "i.relationship")


def invalid_properties(properties: DataFrame) -> DataFrame:
    """(cid, field, value string) rows that break a compound property's rule: must be empty.

    Numbers must be finite; a weight is above 0, areas and complexities are not negative, counts are whole and
    not negative, a charge is whole.
    """
    v = F.col("value").try_cast("decimal(38,12)")
    whole = v == F.floor(v)
    rule = {
        "MolecularWeight": v > 0, "TPSA": v >= 0, "Complexity": v >= 0, "HBondDonorCount": whole & (v >= 0),
        "HBondAcceptorCount": whole & (v >= 0), "RotatableBondCount": whole & (v >= 0), "Charge": whole,
    }
    fine = v.isNotNull()
    for name, ok in rule.items():
        fine = fine & ((F.col("field") != name) | F.coalesce(ok, F.lit(False)))
    return properties.filter(~fine)


def first_protein_per_name(proteins: DataFrame, names: DataFrame) -> DataFrame:
    """(protein, pos, vector) by preferred name: the first protein in order has the name; the result is ordered by name when collected."""
    joined = proteins.join(names.select("protein", "name"), "protein")
    return joined.groupBy("name").agg(F.min_by("vector", "pos").alias("vector"))


def window_means(windows: DataFrame) -> DataFrame:
    """(key, start, states array<array<double>>) to (key, vector): positions averaged over the windows that cover them, then over the key."""
    states = windows.select("key", F.col("start"), F.posexplode("states").alias("i", "state"))
    flat = states.select("key", (F.col("start") + F.col("i")).alias("pos"), F.posexplode("state").alias("d", "v"))
    per_place = flat.groupBy("key", "pos", "d").agg(F.avg("v").alias("v"))
    per_dim = per_place.groupBy("key", "d").agg(F.avg("v").alias("v"))
    return per_dim.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "v"))), lambda x: x["v"]).alias("vector"))


def padded_tokens(rows: DataFrame, *batch: str) -> DataFrame:
    """(batch, row, tokens array<array<double>>) padded with zeros to the longest list of its batch, with a mask."""
    longest = F.max(F.size("tokens")).over(W.partitionBy(*batch))
    wide = rows.withColumns({"longest": longest, "dim": F.max(F.coalesce(F.size(F.get("tokens", 0)), F.lit(0))).over(W.partitionBy(*batch))})
    blank = F.array_repeat(F.array_repeat(F.lit(0.0), F.col("dim")), F.col("longest") - F.size("tokens"))
    mask = F.concat(F.array_repeat(F.lit(True), F.size("tokens")), F.array_repeat(F.lit(False), F.col("longest") - F.size("tokens")))
    return wide.select(*batch, "row", F.concat("tokens", blank).alias("tokens"), mask.alias("mask"))


def uncovered_genes(parts: DataFrame, axis: DataFrame) -> DataFrame:
    """(gene, where) that are in the artifact's shards but not on its axis, or the other way: must be empty."""
    have = parts.select("gene").distinct()
    extra = have.join(axis, "gene", "left_anti").select("gene", F.lit("not on the axis").alias("where"))
    return extra.unionByName(axis.select("gene").join(have, "gene", "left_anti").withColumn("where", F.lit("in no shard")))
