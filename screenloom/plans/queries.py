"""Registered queries: one per operator family, bound to the benchmark's tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from screenloom.functions import text, variants
from screenloom.functions.records import json_list
from screenloom.operators import counts as C
from screenloom.operators import evidence as E
from screenloom.operators import grid as G
from screenloom.operators import knowledge as K
from screenloom.operators import labels as L
from screenloom.operators import losses
from screenloom.operators import metrics as M
from screenloom.operators import ordered, sampling, splits
from screenloom.operators.ranksum import adjusted, ranksum
from screenloom.plans import builders, evidence_store, screen
from screenloom.sources import matrix
from screenloom.sources.shared import materialised, shared_folder

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    """Floating results to six places, negative zero as zero."""
    return df.withColumns({c: F.round(F.col(c).cast("double"), 6) + F.lit(0.0) for c in columns})


def longs(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("long") for c in columns})


# --- counts ---------------------------------------------------------------------------------------


@query
def pseudobulk_delta(s: SparkSession, d: str) -> DataFrame:
    return rounded(C.pseudobulk_delta(screen.cells(s, d), screen.counts(s, d)), "mean", "control_mean", "delta")


@query
def ctrl_means(s: SparkSession, d: str) -> DataFrame:
    return rounded(C.control_means(screen.cells(s, d), screen.counts(s, d)), "value")


@query
def cell_totals(s: SparkSession, d: str) -> DataFrame:
    return rounded(C.cell_totals(screen.counts(s, d)), "total")


@query
def normalize_log1p(s: SparkSession, d: str) -> DataFrame:
    done = C.normalize_log1p(screen.counts(s, d))
    return done.select("cell_id", "gene", (F.round(F.col("value").cast("double"), 4) + F.lit(0.0)).alias("value"))


@query
def count_checks(s: SparkSession, d: str) -> DataFrame:
    cells, counts = screen.cells(s, d), screen.counts(s, d)
    bad = C.denormalized(C.normalize_log1p(counts))
    checks = {"non_integral": C.non_integral(counts), "empty_cells": C.empty_cells(cells, counts), "denormalized": bad}
    return C.stored_counts(counts).select("stored", "nonzero", *[df.agg(F.count("*")).scalar().alias(n) for n, df in checks.items()])


def _marks(s: SparkSession, d: str) -> DataFrame:
    return C.knockdown_marks(screen.cells(s, d), screen.counts(s, d), residual=0.8, cell_residual=0.9, min_cells=20)


@query
def knockdown_keep(s: SparkSession, d: str) -> DataFrame:
    return _marks(s, d)


@query
def knockdown_stats(s: SparkSession, d: str) -> DataFrame:
    return C.knockdown_stats(_marks(s, d))


@query
def knockdown_dropped(s: SparkSession, d: str) -> DataFrame:
    return C.knockdown_dropped(_marks(s, d))


@query
def latest_file_groups(s: SparkSession, d: str) -> DataFrame:
    cells, counts = screen.cells(s, d), screen.counts(s, d)
    parts = [
        C.pseudobulk(cells.filter(F.col("dataset") == ds), counts).withColumn("file_ord", F.lit(i)) for i, ds in enumerate(("F", "O", "P"))
    ]
    return rounded(C.latest_groups(parts[0].unionByName(parts[1]).unionByName(parts[2])), "mean")


@query
def de_ranksum(s: SparkSession, d: str) -> DataFrame:
    tests = ranksum(screen.cells(s, d), screen.counts(s, d))
    return rounded(longs(tests, "target_ncells", "ref_ncells"), "target_mean", "ref_mean", "log2_fold_change", "u", "z")


@query
def bh_adjust(s: SparkSession, d: str) -> DataFrame:
    """Adjustment alone, of given p values: label FDRs of each context and perturbation."""
    tests = screen.conditions(s, d).groupBy("context", F.col("pert").alias("target"), F.col("gene").alias("feature")).agg(F.min("fdr").alias("p_value"))
    return rounded(adjusted(tests.withColumn("p_value", F.col("p_value") + 0.001)), "p_value", "p_adj")


# --- labels ---------------------------------------------------------------------------------------


@query
def labels_last_wins(s: SparkSession, d: str) -> DataFrame:
    rows = screen.labels(s, d)
    return rounded(L.last_wins(rows, *screen.ORDER).select("context", "pert", "gene", "fdr", "fold_change"), "fdr", "fold_change")


@query
def labels_in_several_files(s: SparkSession, d: str) -> DataFrame:
    return L.pairs_in_several_files(screen.labels(s, d).withColumn("file", F.col("dataset")))


@query
def fold_change_spaces(s: SparkSession, d: str) -> DataFrame:
    v = F.col("l_discount") - 0.02
    out = {}
    for space in ("linear", "log2", "ln"):
        linear, log2 = L.fold_changes(v, space)
        finite = ~F.isnan(log2) & (F.abs(log2) < float("inf"))
        out |= {f"{space}_fc": linear, f"{space}_lfc": F.when(finite, log2)}
    items = screen.load(s, d, "lineitem").select("l_discount").distinct()
    return rounded(items.select(F.round("l_discount", 2).alias("x"), *[c.alias(n) for n, c in out.items()]), "x", *out)


@query
def gene_axis_first_seen(s: SparkSession, d: str) -> DataFrame:
    """Matrices have brands and types, labels have brands alone."""
    gene = F.explode(F.array("p_type", "p_brand")).alias("gene")
    parts = screen.load(s, d, "part").select(gene, (F.col("p_size") % 3).alias("file_ord"), F.col("p_partkey").alias("pos"))
    return L.gene_axis(parts, screen.labels(s, d))


@query
def gene_union_axis(s: SparkSession, d: str) -> DataFrame:
    parts = screen.load(s, d, "part").select(F.col("p_brand").alias("gene"), (F.col("p_size") % 5).alias("ds_ord"), F.col("p_partkey").alias("pos"))
    return L.first_seen_union(parts)


@query
def label_arrays(s: SparkSession, d: str) -> DataFrame:
    """The axis has types too, which no label names: those cells are untested."""
    rows = L.last_wins(screen.labels(s, d), *screen.ORDER)
    axis = screen.load(s, d, "part").select(F.explode(F.array("p_type", "p_brand")).alias("gene")).distinct()
    return rounded(L.label_arrays(rows, axis), "fold_change", "fdr", "lfc")


@query
def drug_dose_keys(s: SparkSession, d: str) -> DataFrame:
    parts = screen.load(s, d, "part")
    raw = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("[('"), F.col("p_name"), F.lit("', "), F.col("p_size").cast("string"), F.lit(".5, 'uM')]"))).otherwise(F.col("p_name"))
    key = L.parse_drug_dose(raw)
    name, dose = text.dose_key(key)
    return parts.select("p_partkey", key.alias("key"), name.alias("name"), dose.alias("dose"))


# --- splits ---------------------------------------------------------------------------------------


def _rows(s: SparkSession, d: str) -> DataFrame:
    groups = screen.conditions(s, d).select("dataset", "context", "pert").distinct()
    return groups.withColumn("row", F.row_number().over(W.partitionBy("dataset").orderBy("context", "pert")).cast("long") - 1)


def _split(s: SparkSession, d: str, modulus: int) -> DataFrame:
    """Customers as split entries; some name datasets, contexts or perturbations that don't exist."""
    rows = screen.load(s, d, "customer")
    dataset = F.element_at(F.array(*[F.lit(x) for x in "FOPX"]), (F.col("c_custkey") % 4 + 1).cast("int"))
    context = F.element_at(F.array(*[F.lit(x) for x in ("1-URGENT", "2-HIGH", "5-LOW", "9-NONE")]), (F.col("c_nationkey") % 4 + 1).cast("int"))
    pert = F.concat(F.lit("Brand#"), (F.col("c_custkey") % 29 + 1).cast("string"))
    return rows.filter(F.col("c_custkey") % modulus == 0).select(dataset.alias("dataset"), context.alias("context"), pert.alias("pert")).distinct()


@query
def split_resolve(s: SparkSession, d: str) -> DataFrame:
    return splits.resolve_split(_split(s, d, 1), _rows(s, d))


@query
def split_unresolved(s: SparkSession, d: str) -> DataFrame:
    return splits.unresolved(_split(s, d, 1), _rows(s, d))


@query
def split_disjoint(s: SparkSession, d: str) -> DataFrame:
    both = [_split(s, d, m).withColumn("split", F.lit(n)) for m, n in ((2, "train"), (3, "test"))]
    return splits.overlaps(both[0].unionByName(both[1]))


@query
def query_rows(s: SparkSession, d: str) -> DataFrame:
    return splits.query_rows(_split(s, d, 1), _rows(s, d))


@query
def split_leakage(s: SparkSession, d: str) -> DataFrame:
    return splits.leaks(_rows(s, d), _split(s, d, 1), _split(s, d, 3))


@query
def split_contributing(s: SparkSession, d: str) -> DataFrame:
    return splits.contributing(_rows(s, d), _split(s, d, 1))


# --- evidence -------------------------------------------------------------------------------------

SUMS = ["dp_sum", "dp_sumsq", "lfc_sum", "lfc_sumsq"]


def _parts(s: SparkSession, d: str) -> DataFrame:
    return E.contributions(screen.conditions(s, d), clip=1.0)


@query
def evidence_global(s: SparkSession, d: str) -> DataFrame:
    return rounded(E.totals(_parts(s, d), "pert", "gene"), *SUMS)


@query
def evidence_by_dataset(s: SparkSession, d: str) -> DataFrame:
    return E.totals(_parts(s, d), "dataset", "pert", "gene").select("dataset", "pert", "gene", "dp_cnt", "tested_cnt")


@query
def evidence_context_totals(s: SparkSession, d: str) -> DataFrame:
    return rounded(E.totals(_parts(s, d), "dataset", "context", "gene"), *SUMS)


@query
def evidence_scales(s: SparkSession, d: str) -> DataFrame:
    return rounded(E.scales(E.totals(_parts(s, d), "pert", "gene")), "dp", "lfc")


@query
def evidence_leave_one_out(s: SparkSession, d: str) -> DataFrame:
    return rounded(E.leave_one_out(_rows(s, d), _parts(s, d)), *SUMS)


@query
def evidence_blocks(s: SparkSession, d: str) -> DataFrame:
    parts = _parts(s, d)
    served = E.blocks(E.totals(parts, "pert", "gene"), E.scales(E.totals(parts, "pert", "gene")))
    flat = [(F.round(F.get(f"evidence_{b}", i).cast("double"), 4) + F.lit(0.0)).alias(f"{b}{i}") for b in ("dp", "de", "lfc") for i in range(4)]
    return served.select("pert", "gene", *flat)


@query
def evidence_context_blocks(s: SparkSession, d: str) -> DataFrame:
    parts = _parts(s, d)
    left = E.context_leave_one_out(_rows(s, d), parts)
    served = E.blocks(left, E.scales(E.totals(parts, "pert", "gene")))
    return served.select(*E.OWN_KEY, *[(F.round(F.get("evidence_de", i).cast("double"), 4) + F.lit(0.0)).alias(f"de{i}") for i in range(4)])


@query
def evidence_provenance(s: SparkSession, d: str) -> DataFrame:
    found = E.provenance(E.totals(_parts(s, d), "dataset", "pert", "gene"))
    return found.select("pert", "gene", *[(F.round(F.get("prov", i).cast("double"), 4) + F.lit(0.0)).alias(f"p{i}") for i in range(9)])


@query
def evidence_records(s: SparkSession, d: str) -> DataFrame:
    return E.donor_records(screen.conditions(s, d)).select(*E.OWN_KEY, F.col("flags").cast("int").alias("flags"))


@query
def evidence_record_totals(s: SparkSession, d: str) -> DataFrame:
    rebuilt = E.unpack_records(E.donor_records(screen.conditions(s, d)))
    counted = E.totals(rebuilt, "dataset", "context", "gene")
    return counted.select("dataset", "context", "gene", *E.COUNTS)


@query
def lfc_clip(s: SparkSession, d: str) -> DataFrame:
    return rounded(E.clip_at(screen.conditions(s, d)), "clip")


# --- grid -----------------------------------------------------------------------------------------


@query
def delta_percentile(s: SparkSession, d: str) -> DataFrame:
    return rounded(G.delta_percentiles(screen.conditions(s, d), 95.0), "p")


@query
def delta_grid(s: SparkSession, d: str) -> DataFrame:
    return longs(rounded(G.fit(G.delta_percentiles(screen.conditions(s, d), 95.0)), "top"), "bins")


def _grid() -> tuple[Column, Column]:
    return F.lit(0.77), F.lit(17)


@query
def delta_quantize(s: SparkSession, d: str) -> DataFrame:
    top, bins = _grid()
    rows = screen.conditions(s, d).withColumn("bin", G.quantize(F.col("delta"), top, bins))
    return rounded(rows.select(*E.OWN_KEY, F.col("bin").cast("long").alias("bin"), G.centre(F.col("bin"), top, bins).alias("centre")), "centre")


@query
def delta_two_hot(s: SparkSession, d: str) -> DataFrame:
    rows = screen.conditions(s, d).select(*E.OWN_KEY, F.explode(G.two_hot(F.col("delta"), *_grid())).alias("t"))
    return rounded(rows.select(*E.OWN_KEY, F.col("t.bin").cast("long").alias("bin"), F.col("t.weight").alias("weight")), "weight")


@query
def control_features(s: SparkSession, d: str) -> DataFrame:
    means = C.control_means(screen.cells(s, d), screen.counts(s, d))
    made = G.control_features(means, "context")
    return made.select("context", "gene", *[(F.round(F.get("features", i), 6) + F.lit(0.0)).alias(f"f{i}") for i in range(3)])


# --- metrics --------------------------------------------------------------------------------------


def _ready(s: SparkSession, d: str) -> DataFrame:
    return M.prepared(screen.predictions(s, d))


@query
def metric_auprc(s: SparkSession, d: str) -> DataFrame:
    return rounded(M.average_precision(_ready(s, d)), "binary_auprc")


@query
def metric_jaccard(s: SparkSession, d: str) -> DataFrame:
    return rounded(M.jaccard_and_direction(_ready(s, d)).select(*M.ROW, "sig_jaccard"), "sig_jaccard")


@query
def metric_direction(s: SparkSession, d: str) -> DataFrame:
    return rounded(M.jaccard_and_direction(_ready(s, d)).select(*M.ROW, "direction_match"), "direction_match")


@query
def metric_spearman(s: SparkSession, d: str) -> DataFrame:
    return rounded(M.spearman_lfc(_ready(s, d)), "spearman_lfc")


@query
def metric_nsig(s: SparkSession, d: str) -> DataFrame:
    return rounded(M.spearman_nsig(_ready(s, d)), "spearman_nsig")


@query
def metric_l1(s: SparkSession, d: str) -> DataFrame:
    return rounded(M.discrimination_l1(M.bulk_effects(_ready(s, d))), "discrimination_score_l1")


@query
def metric_hierarchy(s: SparkSession, d: str) -> DataFrame:
    contexts = M.context_metrics(_ready(s, d))
    return longs(rounded(M.metrics_table(contexts), *M.CONTEXT_METRICS), "n_rows")


@query
def metric_aggregate(s: SparkSession, d: str) -> DataFrame:
    return rounded(M.aggregate_metrics(M.context_metrics(_ready(s, d))), *M.CONTEXT_METRICS)


# --- losses and readout ---------------------------------------------------------------------------


def _steps(x: Column) -> Column:
    """17 logits that fall off around place ``x`` of the grid."""
    return F.transform(F.sequence(F.lit(0), F.lit(16)), lambda i: -F.abs(i - x) / 4)


def _row(rows: DataFrame) -> DataFrame:
    return rows.withColumn("row", F.concat_ws("|", *M.PAIR))


@query
def loss_de(s: SparkSession, d: str) -> DataFrame:
    logits = F.array(F.lit(0.0), F.col("p_de") * 4 - 2)
    rows = _row(screen.predictions(s, d)).select("row", "gene", logits.alias("logits"), F.col("de_true").cast("int").alias("target"), F.col("lfc_pred").isNotNull().alias("valid"))
    return rounded(losses.de_loss(rows, 1.5), "de_loss")


def _effects(s: SparkSession, d: str) -> DataFrame:
    rows = screen.predictions(s, d)
    return rows.select("dataset", F.coalesce("lfc_pred", F.lit(0.0)).alias("pred"), F.col("lfc_true").alias("lfc"), F.col("de_true").alias("mask"), (F.col("gene") == F.col("pert")).alias("own"))


@query
def loss_lfc(s: SparkSession, d: str) -> DataFrame:
    return rounded(losses.lfc_loss(_effects(s, d), 2.0, 1.0), "lfc_loss")


@query
def loss_direction(s: SparkSession, d: str) -> DataFrame:
    return rounded(losses.direction_loss(_effects(s, d), 2.0), "lfc_dir_loss")


@query
def loss_delta(s: SparkSession, d: str) -> DataFrame:
    target = G.two_hot(F.col("delta_true"), *_grid())
    rows = _row(screen.predictions(s, d)).select("row", "gene", _steps((F.col("delta_pred") + 0.5) * 16).alias("logits"), target.alias("target"), F.lit(True).alias("valid"))
    return rounded(losses.delta_loss(rows, 3.0), "dp_loss")


@query
def loss_total(s: SparkSession, d: str) -> DataFrame:
    """Terms of each dataset, here from its mean effects, weighted by its rows."""
    terms = screen.predictions(s, d).groupBy("dataset").agg(
        F.count("*").alias("rows"), F.avg("p_de").alias("de_loss"), F.avg(F.abs("lfc_true")).alias("lfc_loss"), F.avg("ctrl_mean").alias("lfc_dir_loss"), F.avg(F.abs("delta_true")).alias("dp_loss")
    )
    return rounded(losses.weighted_total(terms), "de_loss", "lfc_loss", "lfc_dir_loss", "dp_loss", "loss")


@query
def readout(s: SparkSession, d: str) -> DataFrame:
    logits = F.array(F.lit(0.0), F.col("p_de") * 4 - 2)
    p, delta = G.readout(logits, _steps((F.col("delta_pred") + 0.5) * 16), *_grid())
    return rounded(screen.predictions(s, d).select(*E.OWN_KEY, p.alias("p"), delta.alias("delta")), "p", "delta")


@query
def truth_targets(s: SparkSession, d: str) -> DataFrame:
    told = L.de_truth(screen.conditions(s, d))
    target = L.lfc_target(F.col("fold_change"), F.col("de"))
    return rounded(told.select(*E.OWN_KEY, "de", "target", F.when(~F.isnan(target), target).alias("lfc")), "lfc")


@query
def inconsistent_controls(s: SparkSession, d: str) -> DataFrame:
    """Control means that are partly missing in the contexts of one dataset."""
    odd = (F.col("dataset") == "P") & (F.col("delta_pred") > 0.4)
    return M.inconsistent_controls(screen.predictions(s, d).withColumn("ctrl_mean", F.when(~odd, F.col("ctrl_mean"))))


# --- knowledge ------------------------------------------------------------------------------------


def _keys(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    keys = screen.load(s, d, "customer").select(F.col("c_name").alias("key"))
    source = screen.load(s, d, "customer").filter("c_custkey % 3 = 0").select(F.col("c_name").alias("key"))
    number = F.lpad((F.col("c_custkey") + 1).cast("string"), 9, "0")
    aliases = screen.load(s, d, "customer").filter("c_custkey % 2 = 0").select(F.col("c_name").alias("key"), F.concat(F.lit("Customer#"), number).alias("target"))
    return keys, source, aliases


@query
def alias_resolve(s: SparkSession, d: str) -> DataFrame:
    return K.resolve_keys(*_keys(s, d))


@query
def alias_layers(s: SparkSession, d: str) -> DataFrame:
    _, _, aliases = _keys(s, d)
    base = aliases.withColumn("source", F.lit("text"))
    extra = base.filter(F.substring("key", -1, 1) == "4").withColumn("target", F.lit("override"))
    return K.layered_aliases(base, extra)


@query
def coverage(s: SparkSession, d: str) -> DataFrame:
    told = K.coverage(K.resolve_keys(*_keys(s, d)))
    return told.withColumn("missing_keys", F.array_join("missing_keys", ","))


@query
def cosine_compare(s: SparkSession, d: str) -> DataFrame:
    vectors = screen.load(s, d, "embeddings").select(F.col("vec_id").alias("key"), F.col("embedding").alias("vector"))
    other = vectors.filter("key % 2 = 0").withColumn("vector", F.when(F.col("key") % 4 == 0, F.col("vector")).otherwise(F.reverse("vector")))
    return rounded(K.compare_sources(vectors, other), "cosine")


@query
def cosine_summary(s: SparkSession, d: str) -> DataFrame:
    vectors = screen.load(s, d, "embeddings").select(F.col("vec_id").alias("key"), F.col("embedding").alias("vector"))
    return rounded(K.comparison_summary(vectors, vectors.filter("key % 3 <> 0").withColumn("vector", F.reverse("vector"))), "cosine_min", "cosine_mean")


@query
def token_sample(s: SparkSession, d: str) -> DataFrame:
    lengths = screen.load(s, d, "orders").select(F.col("o_orderkey").alias("key"), (F.col("o_custkey") % 3).alias("a_len"), (F.col("o_orderkey") % 3).alias("b_len"))
    return K.token_sample(lengths)


@query
def go_counts(s: SparkSession, d: str) -> DataFrame:
    joined = screen.load(s, d, "lineitem").join(screen.load(s, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    rows = joined.select(
        F.col("p_brand").alias("gene"), F.col("l_returnflag").alias("category"), F.concat(F.lit("GO:"), F.col("p_size").cast("string")).alias("go_id"),
        F.col("p_name").alias("term"), F.struct(*screen.ORDER).alias("ord"),
    )
    listed = K.go_counts(rows).select("gene", "category", F.posexplode("terms").alias("pos", "t"))
    return listed.select("gene", "category", F.col("pos").cast("long").alias("pos"), "t.go_id", "t.term", "t.evidence_count")


@query
def group_expand(s: SparkSession, d: str) -> DataFrame:
    suppliers, nations = screen.load(s, d, "supplier"), screen.load(s, d, "nation")
    pairs = suppliers.select(F.col("s_nationkey").alias("gene"), F.concat(F.lit("r"), (F.col("s_suppkey") % 3).cast("string")).alias("relation"), (F.col("s_suppkey") % 25).cast("int").alias("other"))
    wanted = nations.filter("n_regionkey < 3").select(F.col("n_nationkey").alias("gene"))
    symbols = nations.filter("n_nationkey % 2 = 0").select(F.col("n_nationkey").alias("gene"), F.col("n_name").alias("symbol"))
    return K.group_relations(pairs, wanted, symbols).withColumn("members", F.array_join("members", ","))


@query
def greedy_claim(s: SparkSession, d: str) -> DataFrame:
    """Parts claim suppliers: primary by size, synonym by name word."""
    parts = screen.load(s, d, "part")
    stream = parts.select(F.col("p_partkey").alias("row"), F.concat(F.lit("S"), (F.col("p_partkey") * 7 % 50).cast("string")).alias("name"), (F.col("p_size") % 2 == 0).alias("primary"))
    symbols = s.range(60).select(F.concat(F.lit("S"), F.col("id").cast("string")).alias("symbol"), ((F.col("id") * 37) % 61).alias("pos"))
    return K.greedy_claims(stream, symbols)


@query
def gene_cascade(s: SparkSession, d: str) -> DataFrame:
    parts = screen.load(s, d, "part")
    index = parts.select(
        F.explode(
            F.array(
                F.struct(F.lit("ensembl").alias("kind"), F.concat(F.lit("ENSG"), (F.col("p_partkey") % 97).cast("string")).alias("name")),
                F.struct(F.lit("symbol").alias("kind"), F.concat(F.lit("Sym"), F.col("p_partkey").cast("string")).alias("name")),
                F.struct(F.lit("synonym").alias("kind"), F.concat(F.lit("Syn"), (F.col("p_partkey") % 150).cast("string")).alias("name")),
            )
        ).alias("x"),
        F.col("p_partkey").alias("gene"),
    ).select("x.kind", "x.name", "gene")
    customers = screen.load(s, d, "customer")
    n = F.col("c_custkey")
    ensembl = F.when(n % 3 == 0, F.concat(F.lit("ensg"), (n % 120).cast("string")))
    symbol = F.when(n % 2 == 0, F.concat(F.lit("SYM"), n.cast("string"))).otherwise(F.concat(F.lit("syn"), (n % 160).cast("string")))
    return K.resolve_genes(customers.select(n.alias("key"), ensembl.alias("ensembl"), symbol.alias("symbol")), index)


@query
def nearest_dose(s: SparkSession, d: str) -> DataFrame:
    parts, items = screen.load(s, d, "part"), screen.load(s, d, "lineitem")
    queries = parts.select(F.col("p_partkey").alias("drug"), F.col("p_size").cast("double").alias("dose"))
    measured = items.select(F.col("l_partkey").alias("drug"), F.col("l_quantity").alias("dose"), F.col("l_extendedprice").alias("value"))
    return rounded(K.nearest_dose(queries, measured), "dose", "query_dose", "value")


@query
def nearest_signature(s: SparkSession, d: str) -> DataFrame:
    parts, items = screen.load(s, d, "part"), screen.load(s, d, "lineitem")
    queries = parts.select(F.col("p_partkey").alias("drug"), F.col("p_size").cast("double").alias("dose"))
    unit = F.when(F.col("l_linenumber") % 2 == 0, "uM").otherwise("nM")
    value = F.when(F.col("l_linenumber") == 7, -666.0).otherwise(F.col("l_extendedprice"))
    rows = items.select(F.col("l_partkey").alias("drug"), F.col("l_returnflag").alias("cell"), F.col("l_quantity").alias("pert_dose"), unit.alias("dose_unit"), (F.col("l_linenumber") * 6.0).alias("hours"), value.alias("value"))
    return rounded(K.nearest_signature(queries, rows), "dose", "value")


@query
def prefer_redo(s: SparkSession, d: str) -> DataFrame:
    rows = screen.load(s, d, "lineitem").select(
        F.col("l_partkey").alias("drug"), F.col("l_linenumber").alias("dose"), F.col("l_returnflag").alias("cell"),
        F.when(F.col("l_suppkey") % 4 == 0, "MTS010").otherwise("MTS005").alias("screen"), F.col("l_quantity").alias("value"),
    )
    return rounded(K.median_profiles(K.prefer_redo(rows), "drug", "dose", "cell"), "value")


@query
def compound_cascade(s: SparkSession, d: str) -> DataFrame:
    parts, suppliers = screen.load(s, d, "part"), screen.load(s, d, "supplier")
    key = F.concat(F.lit("K"), (F.col("p_partkey") % 40).cast("string"))
    identities = parts.select(F.col("p_partkey").alias("drug"), F.array(key, F.concat(key, F.lit("P"))).alias("keys"), text.name_key(F.col("p_name")).alias("name_key"))
    n = F.col("s_suppkey")
    inchikey = F.when(n % 3 == 0, F.concat(F.lit("K"), (n % 60).cast("string")))
    smiles = F.when(n % 2 == 0, F.array(F.concat(F.lit("K"), (n % 80).cast("string"), F.lit("P")))).otherwise(F.array().cast("array<string>"))
    name = F.when(n % 4 == 0, "smallring").when(n % 4 == 1, "redwidget").otherwise("none")
    external = suppliers.select(n.alias("ext_id"), inchikey.alias("inchikey"), smiles.alias("smiles_keys"), name.alias("name_key"))
    return K.match_compounds(external, identities)


@query
def disease_lists(s: SparkSession, d: str) -> DataFrame:
    orders, customers = screen.load(s, d, "orders"), screen.load(s, d, "customer")
    links = orders.select(
        (F.col("o_custkey") % 50).alias("gene"), F.when(F.col("o_orderstatus") == "O", "gene").otherwise("phenotype").alias("type"), (F.col("o_orderkey") % 200).alias("cui"), F.col("o_orderkey").alias("ord"),
        F.col("o_orderkey").alias("mim"), text.comment_confidence(F.col("o_orderpriority")).alias("confidence"), (F.col("o_orderkey") % 4).alias("n_sources"),
    )
    names = customers.select((F.col("c_custkey") % 180).alias("cui"), F.when(F.col("c_custkey") % 5 == 0, " ").otherwise(F.col("c_name")).alias("name"), F.col("c_custkey").alias("ord"))
    listed = K.disease_lists(links, names).select("gene", F.posexplode("diseases").alias("pos", "x"))
    return listed.select("gene", F.col("pos").cast("long").alias("pos"), "x.mim", "x.name", F.col("x.confidence").cast("long").alias("confidence"), "x.n_sources")


@query
def description_merge(s: SparkSession, d: str) -> DataFrame:
    customers = screen.load(s, d, "customer")
    prior = customers.filter("c_custkey % 2 = 0").select(F.col("c_name").alias("key"), F.col("c_mktsegment").alias("text"))
    new = customers.filter("c_custkey % 3 = 0").select(F.col("c_name").alias("key"), F.when(F.col("c_custkey") % 4 == 0, "changed").otherwise(F.col("c_mktsegment")).alias("text"))
    return K.merge_descriptions(prior, new, "replace")


@query
def gene_render(s: SparkSession, d: str) -> DataFrame:
    """Cards of brands with their ten most frequent sizes as terms and their part names as one group."""
    parts = screen.load(s, d, "part")
    rows = parts.select(F.col("p_brand").alias("gene"), F.lit("Process").alias("category"), F.concat(F.lit("GO:"), F.col("p_size").cast("string")).alias("go_id"), F.col("p_name").alias("term"), F.col("p_partkey").alias("ord"))
    terms = K.go_counts(rows).select("gene", "terms")
    names = parts.groupBy(F.col("p_brand").alias("gene")).agg(F.array_sort(F.collect_set("p_name")).alias("members"))
    none = F.array().cast("array<struct<mim:string,name:string,confidence:int>>")
    groups = F.array(F.struct(F.lit("names").alias("relation"), F.col("members").alias("members")))
    return terms.join(names, "gene").select("gene", text.gene_text(F.col("gene"), {"Process": F.col("terms")}, none, groups).alias("text"))


@query
def text_keys(s: SparkSession, d: str) -> DataFrame:
    customers = screen.load(s, d, "customer")
    raw = F.concat(F.lit("  "), F.col("c_name"), F.lit("\t "), F.col("c_mktsegment"), F.lit(" \n"))
    dataset, context = text.split_key(F.concat("c_mktsegment", F.lit(".x."), "c_name"))
    return customers.select(
        "c_custkey", text.collapse(raw).alias("collapsed"), text.name_key(raw).alias("name_key"), dataset.alias("dataset"), context.alias("context"),
        text.redact(F.concat(F.lit("http://h/?api_key="), "c_name", F.lit("&q=1"))).alias("redacted"), text.valid_sequence(F.col("c_mktsegment")).alias("valid"),
    )


@query
def json_flatten(s: SparkSession, d: str) -> DataFrame:
    events = screen.load(s, d, "events")
    value = json_list(F.concat(F.lit("["), "props", F.lit("]")), "struct<k:long>")
    return events.select("event_id", F.explode(value).alias("p")).select("event_id", F.col("p.k").alias("k"))


@query
def text_tiers(s: SparkSession, d: str) -> DataFrame:
    customers = screen.load(s, d, "customer")
    tiers = [customers.filter(f"c_custkey % {m} = 0").select(F.col("c_name").alias("key"), F.col(c).alias("text")) for m, c in ((5, "c_mktsegment"), (3, "c_name"))]
    return K.first_of_tiers(customers.select(F.col("c_name").alias("key")), *tiers).withColumn("tier", F.coalesce("tier", F.lit(-1)).cast("long"))


@query
def unembedded(s: SparkSession, d: str) -> DataFrame:
    """Customers without an urgent order have no vector yet."""
    keys = screen.load(s, d, "customer").select(F.col("c_custkey").alias("key"))
    return K.unembedded(screen.load(s, d, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("key")), keys)


@query
def uncovered_genes(s: SparkSession, d: str) -> DataFrame:
    parts = screen.load(s, d, "part").select(F.concat_ws("|", "p_brand", "p_size").alias("gene"), "p_size")
    return K.uncovered_genes(parts.filter("p_size < 40").select("gene"), parts.filter("p_size > 10").select("gene").distinct())


@query
def invalid_properties(s: SparkSession, d: str) -> DataFrame:
    names = F.array(*[F.lit(x) for x in ("MolecularWeight", "TPSA", "HBondDonorCount", "Charge")])
    size = F.col("p_size").cast("string")
    value = F.when(F.col("p_partkey") % 5 == 0, F.concat(F.lit("-"), size)).when(F.col("p_partkey") % 5 == 1, F.concat(size, F.lit(".5"))).when(F.col("p_partkey") % 5 == 2, "x").otherwise(size)
    rows = screen.load(s, d, "part").select(F.col("p_partkey").alias("cid"), F.element_at(names, (F.col("p_size") % 4 + 1).cast("int")).alias("field"), value.alias("value"))
    return K.invalid_properties(rows)


@query
def window_means(s: SparkSession, d: str) -> DataFrame:
    """Two windows of two states for each vector, the second starting on the first one's last place."""
    vectors = screen.load(s, d, "embeddings").select(F.col("vec_id").alias("key"), F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    starts = F.explode(F.array(F.lit(0), F.lit(1))).alias("start")
    windows = vectors.select("key", "v", starts).select("key", "start", F.array("v", F.when(F.col("start") == 0, F.reverse("v")).otherwise(F.col("v"))).alias("states"))
    means = K.window_means(windows)
    return rounded(means.select("key", F.get("vector", 0).alias("first"), F.aggregate("vector", F.lit(0.0), lambda a, x: a + x).alias("total")), "first", "total")


# --- sampling -------------------------------------------------------------------------------------


@query
def apportion(s: SparkSession, d: str) -> DataFrame:
    weights = screen.load(s, d, "orders").groupBy(F.col("o_orderpriority").alias("idx")).agg(F.count("*").alias("weight"))
    return sampling.apportion(weights, 1000)


@query
def batch_runs(s: SparkSession, d: str) -> DataFrame:
    rows = screen.load(s, d, "orders").select(F.col("o_orderkey").alias("ord"), F.col("o_orderstatus").alias("dataset"), F.col("o_orderpriority").alias("context"), (F.col("o_orderkey") % 8).alias("shard"))
    return sampling.batch_runs(rows, 2, "shard").select("shard", "ord", F.col("batch").cast("long").alias("batch"))


@query
def global_runs(s: SparkSession, d: str) -> DataFrame:
    """Batches over one order of all orders, with the place of each row and of its run's start."""
    rows = screen.load(s, d, "orders").select(F.col("o_orderkey").alias("ord"), F.col("o_orderstatus").alias("dataset"), F.col("o_orderpriority").alias("context"))
    return ordered.runs(rows, ["ord"], ["dataset", "context"], 2, range_rows=1000)


@query
def gene_groups(s: SparkSession, d: str) -> DataFrame:
    """Batches of mixed contexts' rows, grouped by dataset; a group mixes labelled and query rows where priced and unpriced orders meet."""
    rows = screen.load(s, d, "orders").select(F.col("o_orderkey").alias("ord"), F.col("o_orderstatus").alias("dataset"), F.lit("all").alias("context"), (F.col("o_totalprice") > 50000).alias("labelled"))
    batched = sampling.batch_runs(rows, 8, range_rows=1000)
    mixed = sampling.mixed_groups(batched).withColumn("mixed", F.lit(True))
    told = sampling.gene_groups(batched).join(mixed, ["batch", "dataset"], "left")
    return longs(told.withColumn("mixed", F.coalesce("mixed", F.lit(False))), "batch", "n")


@query
def blended_epochs(s: SparkSession, d: str) -> DataFrame:
    """Two epochs of four replicas over orders, mixed by priority."""
    rows = screen.load(s, d, "orders").select(F.col("o_orderpriority").alias("group"), F.col("o_orderkey").alias("row"))
    weights = s.createDataFrame(BLEND, "group string, weight double")
    return sampling.blended_epochs(rows, weights, epochs=(0, 3), replicas=4, seed=11, range_rows=1000)


#: The mix of ``blended_epochs``: one group weighs twice another, one is never drawn.
BLEND = [("1-URGENT", 4.0), ("2-HIGH", 2.0), ("3-MEDIUM", 1.0), ("4-NOT SPECIFIED", 0.0), ("5-LOW", 1.0)]


# --- matrix folders -------------------------------------------------------------------------------


@query
def matrix_counts(s: SparkSession, d: str) -> DataFrame:
    """The screen's counts out of a matrix folder that is made from them, by cells and genes."""
    path = f"{shared_folder(s)}/{uuid.uuid4().hex}"
    brands = screen.load(s, d, "part").select(F.col("p_brand").alias("gene")).distinct()
    genes = brands.withColumn("col", (F.row_number().over(W.orderBy("gene")) - 1).cast("int"))  # 25 brands at any scale
    matrix.write_screen(screen.cells(s, d), screen.counts(s, d), genes, path, part_rows=4000)
    rows = matrix.read_matrix(s, path, entries=20_000).join(s.read.parquet(f"{path}/cells").select("row", "cell_id"), "row")  # before a row becomes its entries
    told = rows.select("cell_id", "row", F.explode(F.arrays_zip("cols", "vals")).alias("e"))
    told = told.select("cell_id", "row", F.col("e.cols").alias("col"), F.col("e.vals").cast("double").alias("value"))
    return told.join(s.read.parquet(f"{path}/genes"), "col").select("cell_id", "row", "gene", "value")


@query
def matrix_row_range(s: SparkSession, d: str) -> DataFrame:
    """Rows of a dense folder from a tenth of its height on, chosen in the scan; their stored entries and sums."""
    path = f"{shared_folder(s)}/{uuid.uuid4().hex}"
    brands = screen.load(s, d, "part").select(F.col("p_brand").alias("gene")).distinct()
    genes = brands.withColumn("col", (F.row_number().over(W.orderBy("gene")) - 1).cast("int"))
    told = matrix.write_screen(screen.cells(s, d), screen.counts(s, d), genes, path, layout="dense", part_rows=4000)
    rows = matrix.read_matrix(s, path).filter(F.col("row") >= told["n_rows"] // 10)
    return rows.select("row", F.size("cols").cast("long").alias("stored"), F.aggregate("vals", F.lit(0.0), lambda a, v: a + v).alias("total"), F.array_max("cols").alias("last"))


# --- increments and variants ----------------------------------------------------------------------


@query
def evidence_increments(s: SparkSession, d: str) -> DataFrame:
    """Donor sums of a store that took two datasets, then replaced one and took a third, by merging stored parts."""
    cond, path = materialised(screen.conditions(s, d)), f"{shared_folder(s)}/{uuid.uuid4().hex}"

    def source(name: str, digest: str) -> evidence_store.Source:
        rows = cond.filter(F.col("dataset") == name)
        return evidence_store.Source(digest, lambda: rows if digest == "all" else rows.filter(F.col("delta") > 0))

    evidence_store.refresh(s, path, {"F": source("F", "some"), "O": source("O", "all")})
    evidence_store.refresh(s, path, {n: source(n, "all") for n in ("F", "O", "P")})
    return rounded(evidence_store.donor_totals(s, path), *[c for c in E.STATS if c.endswith(("sum", "sumsq"))])


@query
def cell_line_parts(s: SparkSession, d: str) -> DataFrame:
    """Parts as records of four encodings, and what is read back from them."""
    size, n = F.col("p_size").cast("string"), F.col("p_partkey") % 4
    part = screen.load(s, d, "part").withColumns({"p_mfgr": F.concat(F.lit("M"), size), "p_container": F.concat(F.lit("C"), size)})

    def xref(accession: str) -> Column:
        return F.struct(F.lit("DB").alias("database"), F.col(accession).alias("accession"))

    old = F.struct(
        F.array(F.struct(F.col("p_name").alias("label"), F.array(xref("p_brand")).alias("xref-list"))).alias("cell-type-list"),
        F.array(F.struct(F.lit("Derived-From").alias("type"), F.struct(F.col("p_mfgr").alias("value")).alias("name"), F.struct(F.col("p_brand").alias("value")).alias("accession"))).alias("parent-list"),
        F.array(F.struct(F.struct(F.lit("Transfection").alias("label")).alias("method"), F.col("p_type").alias("label"), xref("p_container").alias("xref"))).alias("genetic-integration-list"),
    )
    new = F.struct(
        F.struct(F.col("p_name").alias("value"), xref("p_brand").alias("xref")).alias("cell-type"),
        F.array(F.struct(F.col("p_mfgr").alias("label"), F.col("p_brand").alias("accession"))).alias("derived-from"),
        F.array(F.struct(F.lit("CRISPR").alias("method"), F.struct(F.col("p_type").alias("label"), F.array(xref("p_container")).alias("xref-list")).alias("target"))).alias("genetic-integration-list"),
    )
    plain = F.struct(
        F.col("p_name").alias("cell-type"),
        F.array(F.struct(F.lit("derived-from").alias("type"), F.col("p_mfgr").alias("name"), F.col("p_brand").alias("accession")), F.struct(F.lit("other").alias("type"), F.col("p_name").alias("name"), F.lit("-").alias("accession"))).alias("parent-list"),
        F.array(F.struct(F.lit("Genetic integration").alias("category"), F.col("p_type").alias("value")), F.struct(F.lit("Doubling").alias("category"), F.col("p_name").alias("value"))).alias("comment-list"),
    )
    record = F.when(n == 0, F.to_json(old)).when(n == 1, F.to_json(new)).when(n == 2, F.to_json(plain)).otherwise("{broken")
    told = variants.cell_line_parts(part.select(F.col("p_partkey").alias("key"), record.alias("json")))
    each = F.transform("integrations", lambda i: F.concat_ws("/", i["method"], i["label"], i["database"], i["accession"]))
    return told.select(
        "key", F.col("cell_type.name").alias("cell_type"), F.col("cell_type.accession").alias("cell_type_accession"),
        F.array_join(F.transform("parents", lambda p: F.concat_ws("/", p["name"], p["accession"])), ", ").alias("parents"), F.array_join(each, ", ").alias("integrations"), "integration_text",
    )


# --- cell metadata and local sources --------------------------------------------------------------


@query
def cell_metadata(s: SparkSession, d: str) -> DataFrame:
    """Orders as cells: priorities mapped to contexts, customers as dose literals."""
    pert = F.concat(F.lit("[('drug"), F.col("o_custkey").cast("string"), F.lit("', "), (F.col("o_orderkey") % 9).cast("string"), F.lit(".5, 'uM')]"))
    cells = screen.load(s, d, "orders").select(F.col("o_orderkey").alias("cell_id"), F.col("o_orderpriority").alias("context"), pert.alias("pert"))
    known = {"1-URGENT": "u", "2-HIGH": "h", "3-MEDIUM": "m", "4-NOT SPECIFIED": "n", "5-LOW": "l"}
    return L.normalize_cells(cells, "orders", known, drug_dose=True)


@query
def local_sources(s: SparkSession, d: str) -> DataFrame:
    """Four sources built by their tools out of files made from the tables: keys, lengths and sums."""
    folder = f"{shared_folder(s)}/{uuid.uuid4().hex}"
    part, items = screen.load(s, d, "part"), screen.load(s, d, "lineitem")
    brand = F.concat(F.regexp_replace("p_brand", "#", ""), F.lit(" ("), F.regexp_extract("p_brand", "[0-9]+", 0), F.lit(")"))
    wide = part.withColumn("brand", brand).groupBy(F.col("p_type").alias("model")).pivot("brand").agg(F.sum("p_size"))  # 25 brands at any scale
    wide.write.option("header", True).csv(f"{folder}/wide")
    vectors = screen.load(s, d, "embeddings").select(F.col("vec_id").cast("string").alias("protein"), F.col("vec_id").alias("pos"), F.col("embedding").alias("vector"))
    vectors.write.parquet(f"{folder}/space")
    names = screen.load(s, d, "embeddings").select(F.col("vec_id").cast("string").alias("string_protein_id"), F.concat(F.lit("N"), F.col("vec_id") % 97).alias("preferred_name"))
    names.write.option("header", True).option("sep", "\t").csv(f"{folder}/names")
    asked = part.select(F.col("p_partkey").cast("string").alias("key"), F.col("p_partkey").alias("drug"), F.col("p_size").cast("double").alias("dose"))
    asked.write.parquet(f"{folder}/asked")
    rows = items.select(F.col("l_partkey").alias("drug"), F.col("l_returnflag").alias("cell"), F.when(F.col("l_linestatus") == "O", "MTS010").otherwise("HTS").alias("screen"), F.col("l_quantity").cast("double").alias("dose"), F.col("l_extendedprice").cast("double").alias("value"))
    rows.write.parquet(f"{folder}/viability")
    part.select(F.col("p_brand").alias("key"), F.col("p_type").alias("feature"), F.col("p_size").cast("double").alias("value")).write.parquet(f"{folder}/wells")
    inputs = {"gene_effects": (f"{folder}/wide",), "network_space": (f"{folder}/space", f"{folder}/names"), "viability_profiles": (f"{folder}/asked", f"{folder}/viability"), "morphology_profiles": (f"{folder}/wells",)}
    paths = builders.local_registry(inputs).build(s, list(inputs), f"{folder}/out")
    told = None
    for name, path in paths.items():
        total = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double"))
        one = s.read.parquet(path).select(F.lit(name).alias("source"), "key", F.size("vector").cast("long").alias("length"), F.round(total, 2).alias("total"))
        told = one if told is None else told.unionByName(one)
    return told.withColumn("total", F.round("total", 1) + F.lit(0.0))
