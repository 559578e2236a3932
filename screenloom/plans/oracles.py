"""SQL that computes the registered queries over the same tables in another engine."""

from __future__ import annotations

PERT = "CASE WHEN o_custkey % 26 = 0 THEN 'non-targeting' ELSE 'Brand#' || (o_custkey % 26) END"
ORDER = "l_shipdate DESC, l_orderkey DESC, l_linenumber DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC"
CELLS = f"""cells AS (
    SELECT o_orderkey AS cell_id, o_orderstatus AS dataset, o_orderpriority AS context, {PERT} AS pert
    FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem))"""
COUNTS = """counts AS (
    SELECT l_orderkey AS cell_id, p_brand AS gene, sum(l_quantity) AS value
    FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)"""
SIZES = "sizes AS (SELECT context, pert, count(*) AS n FROM cells GROUP BY ALL)"
MEANS = """means AS (
    SELECT c.context, c.pert, k.gene, sum(k.value) / any_value(s.n) AS mean
    FROM counts k JOIN cells c USING (cell_id) JOIN sizes s USING (context, pert) GROUP BY ALL)"""
SCREEN = f"WITH {CELLS}, {COUNTS}, {SIZES}, {MEANS}"
LABELS = f"""labels AS (
    SELECT o_orderstatus AS dataset, o_orderpriority AS context, {PERT} AS pert, p_brand AS gene,
           l_discount AS fdr, l_quantity / 25.0::DOUBLE AS fold_change, lineitem.*
    FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey WHERE o_custkey % 26 <> 0)"""
COND = f"""{LABELS}, cond AS (
    SELECT dataset, context, pert, gene, fold_change, fdr, l_extendedprice / 50000.0::DOUBLE - 1 AS delta, l_partkey, l_suppkey
    FROM labels QUALIFY row_number() OVER (PARTITION BY dataset, context, pert, gene ORDER BY {ORDER}) = 1)"""
PARTS = f"""{COND}, parts AS (
    SELECT dataset, context, pert, gene, delta AS dp_sum, delta * delta AS dp_sumsq, 1 AS dp_cnt, 1 AS tested_cnt,
           (fdr < 0.05::DOUBLE AND fold_change > 1)::INT AS up_cnt, (fdr < 0.05::DOUBLE AND fold_change < 1)::INT AS down_cnt,
           greatest(-1.0::DOUBLE, least(1.0::DOUBLE, log2(fold_change))) AS lfc_sum, lfc_sum * lfc_sum AS lfc_sumsq, 1 AS lfc_cnt
    FROM cond)"""
ROWS = """rows AS (
    SELECT dataset, context, pert, row_number() OVER (PARTITION BY dataset ORDER BY context, pert) - 1 AS row
    FROM (SELECT DISTINCT dataset, context, pert FROM cond))"""
PRED = f"""{COND}, pred AS (
    SELECT dataset, context, pert, 0 AS row, gene, fdr < 0.05::DOUBLE AS de, log2(fold_change) AS lt,
           CASE WHEN l_suppkey % 7 <> 0 THEN log2(fold_change) + ((l_suppkey % 11) - 5) / 3.7::DOUBLE END AS lp,
           CASE WHEN l_suppkey % 7 <> 0 THEN (l_partkey % 101) / 100.0::DOUBLE ELSE 0 END AS p,
           (l_partkey % 13) / 13.0::DOUBLE - 0.5 AS delta_pred, delta AS delta_true
    FROM cond)"""
KEY = "dataset, context, pert"
SUMS = ["dp_sum", "dp_sumsq", "lfc_sum", "lfc_sumsq"]
CNTS = ["dp_cnt", "tested_cnt", "up_cnt", "down_cnt", "lfc_cnt"]
STATS = ", ".join([*[f"round(sum({c}), 6) AS {c}" for c in SUMS], *[f"sum({c})::BIGINT AS {c}" for c in CNTS]])
RAW = ", ".join([*[f"sum({c}) AS {c}" for c in SUMS], *[f"sum({c})::BIGINT AS {c}" for c in CNTS]])


def split_rows(modulus: int) -> str:
    return f"""(SELECT DISTINCT ['F','O','P','X'][c_custkey % 4 + 1] AS dataset, ['1-URGENT','2-HIGH','5-LOW','9-NONE'][c_nationkey % 4 + 1] AS context,
        'Brand#' || (c_custkey % 29 + 1) AS pert FROM customer WHERE c_custkey % {modulus} = 0)"""


def scale(total: str, square: str, n: str) -> str:
    var = f"sum({square}) / sum({n}) - (sum({total}) / sum({n})) * (sum({total}) / sum({n}))"
    return f"CASE WHEN sum({n}) > 0 AND sqrt(greatest({var}, 0)) > 0 THEN sqrt(greatest({var}, 0)) ELSE 1.0 END"


SCALES = f"scales AS (SELECT {scale('dp_sum', 'dp_sumsq', 'dp_cnt')} AS dp, {scale('lfc_sum', 'lfc_sumsq', 'lfc_cnt')} AS lfc FROM parts)"


def mean_std(total: str, square: str, n: str, by: str) -> str:
    mean = f"({total} / greatest({n}, 1))"
    std = f"CASE WHEN {n} >= 2 THEN sqrt(greatest({square} / greatest({n}, 1) - {mean} * {mean}, 0)) ELSE 0 END"
    return f"CASE WHEN {n} > 0 THEN {mean} ELSE 0 END / {by} AS m, {std} / {by} AS s"


KNOCK = f"""WITH {CELLS}, {COUNTS},
    nctl AS (SELECT context, count(*) AS n FROM cells WHERE pert = 'non-targeting' GROUP BY 1),
    base AS (SELECT c.context, k.gene AS pert, sum(k.value) / any_value(nctl.n) AS base
             FROM counts k JOIN cells c USING (cell_id) JOIN nctl ON nctl.context = c.context WHERE c.pert = 'non-targeting' GROUP BY 1, 2),
    own AS (SELECT c.cell_id, c.context, c.pert, coalesce(k.value, 0) AS own FROM cells c LEFT JOIN counts k ON k.cell_id = c.cell_id AND k.gene = c.pert),
    passed AS (SELECT o.context, o.pert, any_value(b.base) AS base FROM own o JOIN base b USING (context, pert)
               WHERE b.base > 1e-8 GROUP BY 1, 2 HAVING avg(o.own) / any_value(b.base) < 0.8::DOUBLE),
    ok AS (SELECT o.cell_id, count(*) OVER (PARTITION BY o.context, o.pert) AS n FROM own o JOIN passed p USING (context, pert) WHERE o.own / p.base < 0.9::DOUBLE),
    marks AS (SELECT cell_id, context, pert, pert = 'non-targeting' OR cell_id IN (SELECT cell_id FROM ok WHERE n >= 20) AS keep FROM cells)"""
KEYED = """WITH source AS (SELECT c_name AS key FROM customer WHERE c_custkey % 3 = 0),
    aliases AS (SELECT c_name AS key, 'Customer#' || lpad((c_custkey + 1)::VARCHAR, 9, '0') AS target FROM customer WHERE c_custkey % 2 = 0),
    resolved AS (SELECT k.c_name AS key, coalesce(s.key, t.key) AS found,
        CASE WHEN s.key IS NOT NULL THEN 'direct' WHEN t.key IS NOT NULL THEN 'alias' ELSE 'missing' END AS how
        FROM customer k LEFT JOIN source s ON s.key = k.c_name LEFT JOIN aliases a ON a.key = k.c_name LEFT JOIN source t ON t.key = a.target)"""
AP = f"""lv AS (SELECT {KEY}, row, p, count(*) AS n, sum(de::INT) AS hits FROM pred GROUP BY ALL),
    cum AS (SELECT *, sum(n) OVER w AS seen, sum(hits) OVER w AS found, sum(n) OVER e AS all_n, sum(hits) OVER e AS all_hits FROM lv
            WINDOW w AS (PARTITION BY {KEY}, row ORDER BY p DESC ROWS UNBOUNDED PRECEDING), e AS (PARTITION BY {KEY}, row)),
    ap AS (SELECT {KEY}, row, CASE WHEN max(all_hits) = 0 OR max(all_hits) = max(all_n) THEN 0.0
                  ELSE sum(hits / nullif(all_hits, 0)::DOUBLE * found / seen) END AS binary_auprc FROM cum GROUP BY ALL)"""
JD = f"""jd AS (SELECT {KEY}, row,
        count(*) FILTER ((p >= 0.5 OR de) AND gene <> pert) AS either, count(*) FILTER (p >= 0.5 AND de AND gene <> pert) AS shared,
        count(*) FILTER (de AND lp IS NOT NULL AND sign(lt) = sign(lp)) AS hits, count(*) FILTER (de) AS n_de FROM pred GROUP BY ALL)"""


def rank_of(value: str, keys: str) -> str:
    return f"rank() OVER (PARTITION BY {keys} ORDER BY {value} NULLS LAST) + (count(*) OVER (PARTITION BY {keys}, {value}) - 1) / 2.0::DOUBLE"


def rho(keys: str) -> str:
    return f"""CASE WHEN min(rx) <> max(rx) AND min(ry) <> max(ry) THEN covar_pop(rx, ry) / (stddev_pop(rx) * stddev_pop(ry)) END"""


SPEAR = f"""rk AS (SELECT {KEY}, row, {rank_of("lt", KEY + ", row")} AS rx, {rank_of("lp", KEY + ", row")} AS ry FROM pred WHERE de),
    sp AS (SELECT {KEY}, row, {rho("")} AS spearman_lfc FROM rk GROUP BY ALL)"""
NSIG = f"""nr AS (SELECT {KEY}, row, sum(de::INT) AS real, sum((p >= 0.5)::INT) AS called FROM pred GROUP BY ALL),
    nm AS (SELECT {KEY}, avg(real) AS real, avg(called) AS called FROM nr GROUP BY ALL),
    nk AS (SELECT dataset, context, {rank_of("real", "dataset, context")} AS rx, {rank_of("called", "dataset, context")} AS ry FROM nm WHERE real > 0),
    ns AS (SELECT m.dataset, m.context, CASE WHEN max(m.real) > 0 THEN any_value(r.rho) ELSE 1.0 END AS spearman_nsig FROM nm m
           LEFT JOIN (SELECT dataset, context, {rho("")} AS rho FROM nk GROUP BY ALL) r USING (dataset, context) GROUP BY ALL)"""
L1 = f"""fx AS (SELECT {KEY}, gene, greatest(0.5::DOUBLE + avg(delta_true), 0) - 0.5::DOUBLE AS re, greatest(0.5::DOUBLE + avg(delta_pred), 0) - 0.5::DOUBLE AS pr FROM pred GROUP BY ALL),
    dist AS (SELECT a.dataset, a.context, a.pert, b.pert AS other, sum(abs(a.pr - b.re)) AS d FROM fx a JOIN fx b USING (dataset, context, gene) WHERE gene <> a.pert GROUP BY ALL),
    l1 AS (SELECT {KEY}, 1 - k / n::DOUBLE AS discrimination_score_l1 FROM (
        SELECT {KEY}, other, row_number() OVER (PARTITION BY {KEY} ORDER BY round(d, 9), other) - 1 AS k, count(*) OVER (PARTITION BY {KEY}) AS n FROM dist) WHERE other = pert)"""
PAIRM = f"""pairm AS (SELECT {KEY}, count(*) AS n_rows, avg(binary_auprc) AS binary_auprc, avg(CASE WHEN either > 0 THEN shared / either::DOUBLE ELSE 1 END) AS sig_jaccard,
        avg(CASE WHEN n_de > 0 THEN hits / n_de::DOUBLE ELSE 0 END) AS direction_match, avg(spearman_lfc) AS spearman_lfc
        FROM ap JOIN jd USING ({KEY}, row) LEFT JOIN sp USING ({KEY}, row) GROUP BY ALL),
    ctx AS (SELECT dataset, context, sum(n_rows)::BIGINT AS n_rows, avg(binary_auprc) AS binary_auprc, avg(sig_jaccard) AS sig_jaccard, avg(direction_match) AS direction_match,
        any_value(spearman_nsig) AS spearman_nsig, avg(spearman_lfc) AS spearman_lfc, avg(discrimination_score_l1) AS discrimination_score_l1
        FROM pairm LEFT JOIN l1 USING ({KEY}) JOIN ns USING (dataset, context) GROUP BY ALL)"""
METRICS = ["binary_auprc", "sig_jaccard", "direction_match", "spearman_nsig", "spearman_lfc", "discrimination_score_l1"]
ALL_METRICS = f"WITH {PRED}, {AP}, {JD}, {SPEAR}, {NSIG}, {L1}, {PAIRM}"
R_METRICS = ", ".join(f"round({m}, 6) AS {m}" for m in METRICS)
GRID = "0.77::DOUBLE"
BIN = f"greatest(0, least(16, floor(((delta / {GRID} + 1) / 2) * 17)::INT))"
UNIT = f"greatest(0, least(16, ((delta / {GRID} + 1) / 2) * 17 - 0.5))"

ORACLE_SQL: dict[str, str] = {
    "pseudobulk_delta": f"""{SCREEN}, genes AS (SELECT DISTINCT context, gene FROM means),
        ctl AS (SELECT context, gene, mean FROM means WHERE pert = 'non-targeting')
        SELECT s.context, s.pert, g.gene, round(coalesce(m.mean, 0), 6) AS mean, round(coalesce(c.mean, 0), 6) AS control_mean,
               round(coalesce(m.mean, 0) - coalesce(c.mean, 0), 6) AS delta
        FROM sizes s JOIN genes g USING (context) LEFT JOIN means m ON m.context = s.context AND m.pert = s.pert AND m.gene = g.gene
        LEFT JOIN ctl c ON c.context = s.context AND c.gene = g.gene WHERE s.pert <> 'non-targeting'""",
    "ctrl_means": f"{SCREEN} SELECT context, gene, round(mean, 6) AS value FROM means WHERE pert = 'non-targeting'",
    "cell_totals": f"WITH {COUNTS} SELECT cell_id, round(sum(value), 6) AS total FROM counts GROUP BY 1",
    "normalize_log1p": f"""WITH {COUNTS}, tot AS (SELECT cell_id, sum(value) AS t FROM counts GROUP BY 1)
        SELECT cell_id, gene, round(ln(1 + (value::FLOAT / (t / 10000.0::DOUBLE)::FLOAT)::DOUBLE)::FLOAT::DOUBLE, 4) AS value FROM counts JOIN tot USING (cell_id)""",
    "count_checks": f"""WITH {CELLS}, {COUNTS} SELECT count(*) AS stored, count(*) FILTER (value <> 0) AS nonzero, count(*) FILTER (value <> floor(value)) AS non_integral,
        (SELECT count(*) FROM cells WHERE cell_id NOT IN (SELECT cell_id FROM counts)) AS empty_cells, 0::BIGINT AS denormalized FROM counts""",
    "knockdown_keep": f"{KNOCK} SELECT * FROM marks",
    "knockdown_stats": f"""{KNOCK} SELECT context, count(*) AS cells_in, count(*) FILTER (keep) AS cells_out, count(*) FILTER (pert = 'non-targeting') AS control_cells,
        count(DISTINCT pert) FILTER (pert <> 'non-targeting') AS perts_in, count(DISTINCT pert) FILTER (pert <> 'non-targeting' AND keep) AS perts_out,
        perts_in - perts_out AS perts_dropped FROM marks GROUP BY 1""",
    "knockdown_dropped": f"{KNOCK} SELECT context, pert FROM marks GROUP BY ALL HAVING NOT bool_or(keep)",
    "latest_file_groups": f"""WITH {CELLS}, {COUNTS}, g AS (SELECT dataset, context, pert, count(*) AS n FROM cells GROUP BY ALL),
        m AS (SELECT c.dataset, c.context, c.pert, k.gene, sum(k.value) / any_value(g.n) AS mean FROM counts k JOIN cells c USING (cell_id) JOIN g USING (dataset, context, pert) GROUP BY ALL)
        SELECT context, pert, gene, round(mean, 6) AS mean FROM m QUALIFY dataset = max(dataset) OVER (PARTITION BY context, pert)""",
    "de_ranksum": f"""WITH {CELLS}, {COUNTS}, {SIZES}, tot AS (SELECT cell_id, sum(value) AS t FROM counts GROUP BY 1),
        val AS (SELECT c.context, c.pert, c.cell_id, k.gene, round(k.value * 10000.0::DOUBLE / t, 9) AS v FROM counts k JOIN tot USING (cell_id) JOIN cells c USING (cell_id) WHERE k.value > 0),
        genes AS (SELECT DISTINCT context, gene FROM val),
        perts AS (SELECT context, pert FROM sizes WHERE pert <> 'non-targeting' AND context IN (SELECT context FROM sizes WHERE pert = 'non-targeting')),
        wide AS (SELECT p.context, p.pert, g.gene, c.pert <> 'non-targeting' AS own, coalesce(val.v, 0) AS v
            FROM perts p JOIN genes g USING (context) JOIN cells c ON c.context = p.context AND (c.pert = p.pert OR c.pert = 'non-targeting')
            LEFT JOIN val ON val.cell_id = c.cell_id AND val.gene = g.gene),
        rk AS (SELECT *, rank() OVER (PARTITION BY context, pert, gene ORDER BY v) + (count(*) OVER (PARTITION BY context, pert, gene, v) - 1) / 2.0::DOUBLE AS r,
            count(*) OVER (PARTITION BY context, pert, gene, v) AS m FROM wide),
        agg AS (SELECT context, pert, gene, count(*) FILTER (own) AS n1, count(*) FILTER (NOT own) AS n2, sum(r) FILTER (own) AS rs, sum(m::DOUBLE * m - 1) AS ties,
            sum(v) FILTER (own) AS s1, sum(v) FILTER (NOT own) AS s2 FROM rk GROUP BY ALL HAVING max(v) > 0)
        SELECT context, pert AS target, gene AS feature, round(s1 / n1, 6) AS target_mean, round(s2 / n2, 6) AS ref_mean, n1 AS target_ncells, n2 AS ref_ncells,
            round(log2((s1 / n1 + 1) / (s2 / n2 + 1)), 6) AS log2_fold_change, round(rs - n1 * (n1 + 1) / 2.0::DOUBLE, 6) AS u,
            round((rs - n1 * (n1 + 1) / 2.0::DOUBLE - n1 * n2 / 2.0::DOUBLE) / nullif(sqrt(n1 * n2 / 12.0::DOUBLE * ((n1 + n2 + 1) - ties / ((n1 + n2) * (n1 + n2 - 1)))), 0), 6) AS z FROM agg""",
    "bh_adjust": f"""WITH {COND}, t AS (SELECT context, pert AS target, gene AS feature, min(fdr) + 0.001::DOUBLE AS p FROM cond GROUP BY ALL),
        r AS (SELECT *, count(*) OVER (PARTITION BY context, target) AS n, row_number() OVER (PARTITION BY context, target ORDER BY p, feature) AS k FROM t)
        SELECT context, target, feature, round(p, 6) AS p_value,
            round(least(1.0::DOUBLE, min(p * n / k) OVER (PARTITION BY context, target ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS p_adj FROM r""",
    "labels_last_wins": f"""WITH {LABELS} SELECT context, pert, gene, round(fdr, 6) AS fdr, round(fold_change, 6) AS fold_change FROM labels
        QUALIFY row_number() OVER (PARTITION BY context, pert, gene ORDER BY {ORDER}) = 1""",
    "labels_in_several_files": f"WITH {LABELS} SELECT context, pert, count(DISTINCT dataset) AS files FROM labels GROUP BY ALL HAVING files > 1",
    "fold_change_spaces": """WITH v AS (SELECT DISTINCT l_discount, l_discount - 0.02::DOUBLE AS v FROM lineitem)
        SELECT round(l_discount, 2) AS x, round(v, 6) AS linear_fc, CASE WHEN v > 0 THEN round(log2(CASE WHEN v > 0 THEN v ELSE 1 END), 6) END AS linear_lfc,
            round(pow(2.0::DOUBLE, v), 6) AS log2_fc, round(v, 6) AS log2_lfc, round(exp(v), 6) AS ln_fc, round(v / ln(2.0::DOUBLE), 6) AS ln_lfc FROM v""",
    "gene_axis_first_seen": f"""WITH {LABELS} SELECT gene, row_number() OVER (ORDER BY f, p) - 1 AS pos FROM (
        SELECT p_brand AS gene, p_size % 3 AS f, p_partkey AS p FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_size % 3, p_partkey) = 1)
        WHERE gene IN (SELECT gene FROM labels)""",
    "gene_union_axis": """SELECT gene, row_number() OVER (ORDER BY f, p) - 1 AS pos FROM (
        SELECT p_brand AS gene, p_size % 5 AS f, p_partkey AS p FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_size % 5, p_partkey) = 1)""",
    "label_arrays": f"""WITH {LABELS}, v AS (SELECT context, pert, gene, fdr, fold_change FROM labels
            QUALIFY row_number() OVER (PARTITION BY context, pert, gene ORDER BY {ORDER}) = 1)
        SELECT p.context, p.pert, a.gene, round(coalesce(v.fold_change, 0)::FLOAT::DOUBLE, 6) AS fold_change, round(coalesce(v.fdr, 1)::FLOAT::DOUBLE, 6) AS fdr,
            v.fdr IS NOT NULL AS tested, round(log2(v.fold_change), 6) AS lfc
        FROM (SELECT DISTINCT context, pert FROM v) p CROSS JOIN (SELECT p_brand AS gene FROM part UNION SELECT p_type FROM part) a LEFT JOIN v ON v.context = p.context AND v.pert = p.pert AND v.gene = a.gene""",
    "drug_dose_keys": """SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_name || '_' || p_size || '.5uM' ELSE p_name END AS key,
        CASE WHEN p_size % 2 = 0 THEN p_name END AS name, CASE WHEN p_size % 2 = 0 THEN p_size + 0.5::DOUBLE END AS dose FROM part""",
    "split_resolve": f"WITH {COND}, {ROWS} SELECT s.*, r.row FROM {split_rows(1)} s JOIN rows r USING (dataset, context, pert)",
    "split_unresolved": f"""WITH {COND}, {ROWS} SELECT s.*, CASE WHEN dataset NOT IN (SELECT dataset FROM rows) THEN 'dataset'
        WHEN (dataset, context) NOT IN (SELECT (dataset, context) FROM rows) THEN 'context' ELSE 'perturbation' END AS cause
        FROM {split_rows(1)} s WHERE (dataset, context, pert) NOT IN (SELECT (dataset, context, pert) FROM rows)""",
    "split_disjoint": f"SELECT *, 2::BIGINT AS splits FROM (SELECT * FROM {split_rows(2)} INTERSECT SELECT * FROM {split_rows(3)})",
    "query_rows": f"WITH {COND}, {ROWS} SELECT s.*, -1::BIGINT AS row FROM {split_rows(1)} s WHERE (dataset, context) IN (SELECT (dataset, context) FROM rows)",
    "split_leakage": f"""WITH {COND}, {ROWS} SELECT {KEY}, 'not in train' AS cause FROM rows WHERE ({KEY}) NOT IN (SELECT ({KEY}) FROM {split_rows(1)})
        UNION ALL SELECT {KEY}, 'evaluation pair' FROM rows WHERE ({KEY}) IN (SELECT ({KEY}) FROM {split_rows(3)})""",
    "split_contributing": f"WITH {COND}, {ROWS} SELECT DISTINCT dataset FROM rows WHERE ({KEY}) IN (SELECT ({KEY}) FROM {split_rows(1)})",
    "evidence_global": f"WITH {PARTS} SELECT pert, gene, {STATS} FROM parts GROUP BY ALL",
    "evidence_by_dataset": f"WITH {PARTS} SELECT dataset, pert, gene, sum(dp_cnt)::BIGINT AS dp_cnt, sum(tested_cnt)::BIGINT AS tested_cnt FROM parts GROUP BY ALL",
    "evidence_context_totals": f"WITH {PARTS} SELECT dataset, context, gene, {STATS} FROM parts GROUP BY ALL",
    "evidence_scales": f"WITH {PARTS}, {SCALES} SELECT round(dp, 6) AS dp, round(lfc, 6) AS lfc FROM scales",
    "evidence_leave_one_out": f"""WITH {PARTS}, {ROWS}, tot AS (SELECT pert, gene, {RAW} FROM parts GROUP BY ALL)
        SELECT r.dataset, r.context, r.pert, t.gene, {", ".join(f"round(t.{c} - coalesce(o.{c}, 0), 6) + 0.0 AS {c}" for c in SUMS)},
            {", ".join(f"(t.{c} - coalesce(o.{c}, 0))::BIGINT AS {c}" for c in CNTS)}
        FROM rows r JOIN tot t USING (pert) LEFT JOIN parts o ON o.dataset = r.dataset AND o.context = r.context AND o.pert = r.pert AND o.gene = t.gene""",
    "evidence_blocks": f"""WITH {PARTS}, {SCALES}, t AS (SELECT pert, gene, {RAW} FROM parts GROUP BY ALL),
        a AS (SELECT pert, gene, {mean_std("dp_sum", "dp_sumsq", "dp_cnt", "dp")}, dp_cnt, tested_cnt, up_cnt, down_cnt FROM t, scales),
        b AS (SELECT pert, gene, {mean_std("lfc_sum", "lfc_sumsq", "lfc_cnt", "lfc")}, lfc_cnt FROM t, scales)
        SELECT a.pert, a.gene, round(a.m::FLOAT::DOUBLE, 4) AS dp0, round(a.s::FLOAT::DOUBLE, 4) AS dp1, (dp_cnt > 0)::INT::DOUBLE AS dp2, round(ln(1 + dp_cnt)::FLOAT::DOUBLE, 4) AS dp3,
            round((up_cnt / greatest(tested_cnt, 1))::FLOAT::DOUBLE, 4) AS de0, round((down_cnt / greatest(tested_cnt, 1))::FLOAT::DOUBLE, 4) AS de1, (tested_cnt > 0)::INT::DOUBLE AS de2, round(ln(1 + tested_cnt)::FLOAT::DOUBLE, 4) AS de3,
            round(b.m::FLOAT::DOUBLE, 4) AS lfc0, round(b.s::FLOAT::DOUBLE, 4) AS lfc1, (lfc_cnt > 0)::INT::DOUBLE AS lfc2, round(ln(1 + lfc_cnt)::FLOAT::DOUBLE, 4) AS lfc3
        FROM a JOIN b USING (pert, gene)""",
    "evidence_context_blocks": f"""WITH {PARTS}, {ROWS}, tot AS (SELECT dataset, context, gene, {RAW} FROM parts GROUP BY ALL),
        l AS (SELECT r.dataset, r.context, r.pert, t.gene, {", ".join(f"t.{c} - coalesce(o.{c}, 0) AS {c}" for c in CNTS)}
            FROM rows r JOIN tot t USING (dataset, context) LEFT JOIN parts o ON o.dataset = r.dataset AND o.context = r.context AND o.pert = r.pert AND o.gene = t.gene)
        SELECT {KEY}, gene, round((up_cnt / greatest(tested_cnt, 1))::FLOAT::DOUBLE, 4) AS de0, round((down_cnt / greatest(tested_cnt, 1))::FLOAT::DOUBLE, 4) AS de1,
            (tested_cnt > 0)::INT::DOUBLE AS de2, round(ln(1 + tested_cnt)::FLOAT::DOUBLE, 4) AS de3 FROM l""",
    "evidence_provenance": f"""WITH {PARTS} SELECT pert, gene, {", ".join(f"(count(*) FILTER (dataset = '{d}') > 0)::INT::DOUBLE AS p{3 * i}, round(ln(1 + count(*) FILTER (dataset = '{d}'))::FLOAT::DOUBLE, 4) AS p{3 * i + 1}, round(ln(1 + count(*) FILTER (dataset = '{d}'))::FLOAT::DOUBLE, 4) AS p{3 * i + 2}" for i, d in enumerate("FOP"))}
        FROM parts GROUP BY ALL""",
    "evidence_records": f"WITH {PARTS} SELECT {KEY}, gene, (tested_cnt + 2 * up_cnt + 4 * down_cnt + 8 * lfc_cnt)::INT AS flags FROM parts",
    "evidence_record_totals": f"WITH {PARTS} SELECT dataset, context, gene, {', '.join(f'sum({c})::BIGINT AS {c}' for c in CNTS)} FROM parts GROUP BY ALL",
    "lfc_clip": f"WITH {COND} SELECT round(quantile_cont(abs(log2(fold_change)), 0.95), 6) AS clip FROM cond",
    "delta_percentile": f"WITH {COND} SELECT dataset, round(quantile_cont(abs(delta), 0.95), 6) AS p FROM cond GROUP BY 1",
    "delta_grid": f"""WITH {COND}, p AS (SELECT max(p) AS top FROM (SELECT quantile_cont(abs(delta), 0.95) AS p FROM cond GROUP BY dataset)),
        n AS (SELECT top, ceil(2 * top / ln(1.1::DOUBLE))::BIGINT AS n FROM p) SELECT round(top, 6) AS top, n + 1 - n % 2 AS bins FROM n""",
    "delta_quantize": f"WITH {COND} SELECT {KEY}, gene, {BIN}::BIGINT AS bin, round((({BIN} + 0.5::DOUBLE) / 17 * 2 - 1) * {GRID}, 6) + 0.0 AS centre FROM cond",
    "delta_two_hot": f"""WITH {COND}, u AS (SELECT {KEY}, gene, {UNIT} AS u, least(floor({UNIT}), 15) AS lo FROM cond)
        SELECT {KEY}, gene, lo::BIGINT AS bin, round(1 - (u - lo), 6) + 0.0 AS weight FROM u UNION ALL SELECT {KEY}, gene, (lo + 1)::BIGINT, round(u - lo, 6) + 0.0 FROM u""",
    "control_features": f"""{SCREEN} SELECT context, gene, round(mean, 6) AS f0, round(ln(1 + 100 * mean), 6) AS f1, (mean = 0)::INT::DOUBLE AS f2 FROM means WHERE pert = 'non-targeting'""",
    "metric_auprc": f"WITH {PRED}, {AP} SELECT {KEY}, row, round(binary_auprc, 6) AS binary_auprc FROM ap",
    "metric_jaccard": f"WITH {PRED}, {JD} SELECT {KEY}, row, round(CASE WHEN either > 0 THEN shared / either::DOUBLE ELSE 1 END, 6) AS sig_jaccard FROM jd",
    "metric_direction": f"WITH {PRED}, {JD} SELECT {KEY}, row, round(CASE WHEN n_de > 0 THEN hits / n_de::DOUBLE ELSE 0 END, 6) AS direction_match FROM jd",
    "metric_spearman": f"WITH {PRED}, {SPEAR} SELECT {KEY}, row, round(spearman_lfc, 6) + 0.0 AS spearman_lfc FROM sp",
    "metric_nsig": f"WITH {PRED}, {NSIG} SELECT dataset, context, round(spearman_nsig, 6) AS spearman_nsig FROM ns",
    "metric_l1": f"WITH {PRED}, {L1} SELECT {KEY}, round(discrimination_score_l1, 6) AS discrimination_score_l1 FROM l1",
    "metric_hierarchy": f"""{ALL_METRICS} SELECT dataset || '.' || context AS context, n_rows, {R_METRICS} FROM ctx
        UNION ALL SELECT 'all', sum(n_rows)::BIGINT, {", ".join(f"round(avg({m}), 6)" for m in METRICS)} FROM ctx""",
    "metric_aggregate": f"""{ALL_METRICS} SELECT {", ".join(f"round(avg({m}), 6) AS {m}" for m in METRICS)}
        FROM (SELECT dataset, {", ".join(f"avg({m}) AS {m}" for m in METRICS)} FROM ctx GROUP BY 1)""",
    "alias_resolve": f"{KEYED} SELECT * FROM resolved",
    "alias_layers": """SELECT 'text' AS source, c_name AS key, CASE WHEN c_name LIKE '%4' THEN 'override' ELSE 'Customer#' || lpad((c_custkey + 1)::VARCHAR, 9, '0') END AS target
        FROM customer WHERE c_custkey % 2 = 0""",
    "coverage": f"""{KEYED} SELECT count(*) AS n, count(*) FILTER (how = 'direct') AS direct, count(*) FILTER (how = 'alias') AS alias, count(*) FILTER (how = 'missing') AS missing,
        (SELECT string_agg(key, ',' ORDER BY key) FROM (SELECT key FROM resolved WHERE how = 'missing' ORDER BY key LIMIT 20)) AS missing_keys FROM resolved""",
    "cosine_compare": """WITH v AS (SELECT vec_id AS key, embedding::DOUBLE[] AS a, (CASE WHEN vec_id % 4 = 0 THEN embedding ELSE list_reverse(embedding) END)::DOUBLE[] AS b FROM embeddings WHERE vec_id % 2 = 0)
        SELECT key, a = b AS equal, round(list_dot_product(a, b) / (sqrt(list_dot_product(a, a)) * sqrt(list_dot_product(b, b))), 6) AS cosine FROM v""",
    "cosine_summary": """WITH v AS (SELECT embedding::DOUBLE[] AS a, list_reverse(embedding)::DOUBLE[] AS b FROM embeddings WHERE vec_id % 3 <> 0),
        c AS (SELECT a = b AS eq, list_dot_product(a, b) / (sqrt(list_dot_product(a, a)) * sqrt(list_dot_product(b, b))) AS c FROM v)
        SELECT count(*) AS n_common, count(*) FILTER (eq) AS n_equal, round(min(c), 6) AS cosine_min, round(avg(c), 6) AS cosine_mean,
            (SELECT count(*) FROM embeddings) AS n_new, count(*) AS n_reference FROM c""",
    "token_sample": """WITH e AS (SELECT o_orderkey AS key, row_number() OVER (ORDER BY o_orderkey) - 1 AS i, count(*) OVER () AS n FROM orders WHERE o_custkey % 3 = o_orderkey % 3)
        SELECT key FROM e WHERE i % greatest(1, ceil(n / 256.0::DOUBLE)::BIGINT) = 0""",
    "go_counts": f"""WITH r AS (SELECT p_brand AS gene, l_returnflag AS category, 'GO:' || p_size AS go_id, p_name AS term,
            count(*) OVER (PARTITION BY p_brand, l_returnflag, p_size) AS n, row_number() OVER (PARTITION BY p_brand, l_returnflag, p_size ORDER BY {ORDER.replace(" DESC", "")}) AS k
            FROM lineitem JOIN part ON l_partkey = p_partkey)
        SELECT gene, category, row_number() OVER (PARTITION BY gene, category ORDER BY n DESC, go_id) - 1 AS pos, go_id, term, n AS evidence_count FROM r WHERE k = 1""",
    "group_expand": """WITH p AS (SELECT s_nationkey AS gene, 'r' || (s_suppkey % 3) AS relation, (s_suppkey % 25)::INT AS other FROM supplier),
        b AS (SELECT * FROM p UNION ALL SELECT other, relation, gene FROM p)
        SELECT b.gene, relation, string_agg(DISTINCT coalesce(CASE WHEN n.n_nationkey % 2 = 0 THEN n.n_name END, other::VARCHAR), ',' ORDER BY coalesce(CASE WHEN n.n_nationkey % 2 = 0 THEN n.n_name END, other::VARCHAR)) AS members
        FROM b JOIN nation w ON w.n_nationkey = b.gene AND w.n_regionkey < 3 LEFT JOIN nation n ON n.n_nationkey = b.other GROUP BY ALL""",
    "greedy_claim": """WITH own AS (SELECT 'S' || (p_partkey * 7 % 50) AS name, p_size % 2 = 0 AS prim, min(p_partkey) AS row FROM part GROUP BY ALL),
        sym AS (SELECT 'S' || i AS symbol, (i * 37) % 61 AS pos FROM range(60) t(i)),
        p AS (SELECT s.symbol, o.row, row_number() OVER (PARTITION BY o.row ORDER BY s.pos) AS k FROM sym s JOIN own o ON o.name = s.symbol AND o.prim),
        c AS (SELECT symbol, row FROM p WHERE k = 1),
        q AS (SELECT s.symbol, o.row, row_number() OVER (PARTITION BY o.row ORDER BY s.pos) AS k FROM sym s JOIN own o ON o.name = s.symbol AND NOT o.prim
              WHERE s.symbol NOT IN (SELECT symbol FROM p) AND o.row NOT IN (SELECT row FROM c))
        SELECT symbol, row, 'primary' AS by FROM c UNION ALL SELECT symbol, row, 'synonym' FROM q WHERE k = 1""",
    "gene_cascade": """WITH q AS (SELECT c_custkey AS key, CASE WHEN c_custkey % 3 = 0 THEN 'ensg' || (c_custkey % 120) END AS e,
            CASE WHEN c_custkey % 2 = 0 THEN 'sym' || c_custkey ELSE 'syn' || (c_custkey % 160) END AS s FROM customer),
        ix AS (SELECT 0 AS step, 'ensg' || (p_partkey % 97) AS name, p_partkey AS gene FROM part UNION ALL SELECT 1, 'sym' || p_partkey, p_partkey FROM part UNION ALL SELECT 2, 'syn' || (p_partkey % 150), p_partkey FROM part),
        h AS (SELECT q.key, ix.step, ix.gene FROM q JOIN ix ON (ix.step = 0 AND ix.name = q.e) OR (ix.step > 0 AND ix.name = q.s)),
        b AS (SELECT key, min(step) AS step FROM h GROUP BY 1),
        g AS (SELECT h.key, h.step, count(*) AS n, any_value(h.gene) AS one, count(*) FILTER (s.gene IS NOT NULL) AS m, max(s.gene) AS named FROM h JOIN b USING (key, step)
              LEFT JOIN (SELECT key, gene FROM h WHERE step = 1) s ON s.key = h.key AND s.gene = h.gene GROUP BY ALL),
        o AS (SELECT key, step, CASE WHEN n = 1 THEN one WHEN step = 0 AND m = 1 THEN named END AS gene FROM g)
        SELECT q.key, o.gene, CASE WHEN o.key IS NULL THEN 'missing' WHEN o.gene IS NULL THEN 'ambiguous' ELSE ['ensembl', 'symbol', 'synonym'][o.step + 1] END AS how
        FROM q LEFT JOIN o USING (key)""",
    "nearest_dose": """WITH j AS (SELECT p_partkey AS drug, p_size::DOUBLE AS query_dose, l_quantity AS dose, l_extendedprice AS value, abs(log10(l_quantity / p_size::DOUBLE)) AS d
            FROM part JOIN lineitem ON l_partkey = p_partkey),
        n AS (SELECT *, min(d) OVER (PARTITION BY drug, query_dose) AS m FROM j), k AS (SELECT *, min(dose) OVER (PARTITION BY drug, query_dose) AS low FROM n WHERE d <= m + 1e-10)
        SELECT drug, round(query_dose, 6) AS query_dose, round(dose, 6) AS dose, round(value, 6) AS value FROM k WHERE abs(dose - low) <= 1e-8 * low""",
    "nearest_signature": """WITH j AS (SELECT p_partkey AS drug, p_size::DOUBLE AS dose, l_returnflag AS cell, l_extendedprice AS value,
            abs(log10(l_quantity * CASE WHEN l_linenumber % 2 = 0 THEN 1.0::DOUBLE ELSE 1e-3::DOUBLE END / p_size::DOUBLE)) + abs(log2(l_linenumber * 6.0::DOUBLE / 24)) AS d
            FROM part JOIN lineitem ON l_partkey = p_partkey WHERE l_linenumber <> 7),
        n AS (SELECT *, min(d) OVER (PARTITION BY drug, dose, cell) AS m FROM j)
        SELECT drug, round(dose, 6) AS dose, cell, round(median(value), 6) AS value FROM n WHERE d <= m + 1e-10 GROUP BY ALL""",
    "prefer_redo": """WITH r AS (SELECT l_partkey AS drug, l_linenumber AS dose, l_returnflag AS cell, l_suppkey % 4 = 0 AS redo, l_quantity AS value FROM lineitem),
        h AS (SELECT *, bool_or(redo) OVER (PARTITION BY drug, dose, cell) AS any_redo FROM r)
        SELECT drug, dose, cell, round(median(value), 6) AS value FROM h WHERE redo OR NOT any_redo GROUP BY ALL""",
    "compound_cascade": """WITH d AS (SELECT p_partkey AS drug, 'K' || (p_partkey % 40) AS k, regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') AS nk FROM part),
        e AS (SELECT s_suppkey AS ext_id, CASE WHEN s_suppkey % 3 = 0 THEN 'K' || (s_suppkey % 60) END AS ik, CASE WHEN s_suppkey % 2 = 0 THEN 'K' || (s_suppkey % 80) || 'P' END AS sk,
            CASE s_suppkey % 4 WHEN 0 THEN 'smallring' WHEN 1 THEN 'redwidget' ELSE 'none' END AS nk FROM supplier),
        h AS (SELECT ext_id, e.nk, 0 AS step, 'inchikey' AS how, drug, d.nk AS dn FROM e JOIN d ON e.ik = d.k OR e.ik = d.k || 'P'
            UNION SELECT ext_id, e.nk, 1, 'smiles', drug, d.nk FROM e JOIN d ON e.sk = d.k OR e.sk = d.k || 'P'
            UNION SELECT ext_id, e.nk, 2, 'name', drug, d.nk FROM e JOIN d ON e.nk = d.nk),
        b AS (SELECT * FROM h QUALIFY step = min(step) OVER (PARTITION BY ext_id)), c AS (SELECT *, count(*) OVER (PARTITION BY ext_id) AS n FROM b)
        SELECT ext_id, drug, how FROM c WHERE n = 1 OR dn = nk""",
    "disease_lists": """WITH nm AS (SELECT c_custkey % 180 AS cui, max_by(c_name, c_custkey) AS name FROM customer WHERE c_custkey % 5 <> 0 GROUP BY 1),
        l AS (SELECT o_custkey % 50 AS gene, o_orderkey AS mim, name, 1::BIGINT AS confidence, o_orderkey % 4 AS n_sources FROM orders LEFT JOIN nm ON nm.cui = o_orderkey % 200 WHERE o_orderstatus <> 'O')
        SELECT gene, row_number() OVER (PARTITION BY gene ORDER BY n_sources DESC, mim) - 1 AS pos, mim, name, confidence, n_sources FROM l""",
    "description_merge": """WITH p AS (SELECT c_name AS key, c_mktsegment AS t FROM customer WHERE c_custkey % 2 = 0),
        n AS (SELECT c_name AS key, CASE WHEN c_custkey % 4 = 0 THEN 'changed' ELSE c_mktsegment END AS t FROM customer WHERE c_custkey % 3 = 0)
        SELECT key, coalesce(n.t, p.t) AS text, CASE WHEN p.t IS NULL THEN 'new' WHEN n.t <> p.t THEN 'changed' ELSE 'kept' END AS state FROM p FULL JOIN n USING (key)""",
    "gene_render": """WITH r AS (SELECT p_brand AS gene, p_size, p_name, count(*) OVER (PARTITION BY p_brand, p_size) AS n, row_number() OVER (PARTITION BY p_brand, p_size ORDER BY p_partkey) AS k FROM part),
        t AS (SELECT gene, string_agg('- GO:' || p_size || ': ' || p_name || ' (evidence: ' || n || ')', chr(10) ORDER BY n DESC, 'GO:' || p_size) AS lines FROM r WHERE k = 1 GROUP BY 1),
        m AS (SELECT p_brand AS gene, string_agg(DISTINCT p_name, ', ' ORDER BY p_name) AS members FROM part GROUP BY 1)
        SELECT gene, 'Gene: ' || gene || chr(10) || chr(10) || '=== GO BIOLOGICAL PROCESS ===' || chr(10) || 'Gene Ontology biological process annotations, sorted by evidence count.' || chr(10) || lines
            || chr(10) || chr(10) || '=== DISEASE ASSOCIATIONS ===' || chr(10) || 'Known disease associations with confidence scores and OMIM (Online Mendelian Inheritance in Man) identifiers.' || chr(10) || 'None'
            || chr(10) || chr(10) || '=== GENE GROUPS ===' || chr(10) || 'Gene family and group memberships by relationship type.' || chr(10) || '- names: ' || members AS text FROM t JOIN m USING (gene)""",
    "text_keys": """SELECT c_custkey, c_name || ' ' || c_mktsegment AS collapsed, regexp_replace(lower(c_name || c_mktsegment), '[^a-z0-9]', '', 'g') AS name_key,
        c_mktsegment AS dataset, 'x.' || c_name AS context, 'http://h/?api_key=***&q=1' AS redacted, regexp_matches(c_mktsegment, '^[ACDEFGHIKLMNPQRSTVWYBXZJUO]+$') AS valid FROM customer""",
    "json_flatten": "SELECT event_id, (props::JSON->>'k')::BIGINT AS k FROM events",
    "apportion": """WITH w AS (SELECT o_orderpriority AS idx, count(*) AS w FROM orders GROUP BY 1), x AS (SELECT idx, 1000 * w / sum(w) OVER ()::DOUBLE AS x FROM w),
        r AS (SELECT idx, floor(x) AS low, row_number() OVER (ORDER BY round(x - floor(x), 9) DESC, idx) AS k, 1000 - sum(floor(x)) OVER () AS rest FROM x)
        SELECT idx, (low + (k <= rest)::INT)::BIGINT AS n FROM r""",
    "batch_runs": """WITH r AS (SELECT o_orderkey % 8 AS shard, o_orderkey AS ord, o_orderstatus || '|' || o_orderpriority AS c FROM orders),
        f AS (SELECT *, coalesce((c <> lag(c) OVER w)::INT, 1) AS ch FROM r WINDOW w AS (PARTITION BY shard ORDER BY ord)),
        g AS (SELECT *, sum(ch) OVER (PARTITION BY shard ORDER BY ord) AS run FROM f),
        p AS (SELECT *, row_number() OVER (PARTITION BY shard, run ORDER BY ord) - 1 AS k FROM g)
        SELECT shard, ord, (sum((k % 2 = 0)::INT) OVER (PARTITION BY shard ORDER BY ord) - 1)::BIGINT AS batch FROM p""",
    "loss_de": f"""WITH {PRED}, r AS (SELECT {KEY}, de, 4 * p - 2 AS x FROM pred WHERE lp IS NOT NULL),
        w AS (SELECT *, least(1.5::DOUBLE, count(*) OVER (PARTITION BY {KEY}) / (2.0::DOUBLE * count(*) OVER (PARTITION BY {KEY}, de))) AS w FROM r)
        SELECT round(avg((ln(1 + exp(x)) - CASE WHEN de THEN x ELSE 0 END) * w), 6) AS de_loss FROM w""",
    "loss_lfc": f"""WITH {PRED}, h AS (SELECT de, gene = pert AS own, abs(coalesce(lp, 0) - lt) AS g, CASE WHEN g <= 1 THEN 0.5::DOUBLE * g * g ELSE g - 0.5 END AS h FROM pred)
        SELECT round(coalesce(avg(h) FILTER (de AND NOT own), 0) + 2 * coalesce(avg(h) FILTER (de AND own), 0), 6) AS lfc_loss FROM h""",
    "loss_direction": f"WITH {PRED} SELECT round(avg(greatest(0, -sign(lt) * coalesce(lp, 0) / 2.0::DOUBLE)) FILTER (de AND lt <> 0), 6) + 0.0 AS lfc_dir_loss FROM pred",
    "loss_delta": f"""WITH {PRED}, b AS (SELECT {KEY}, gene, (delta_pred + 0.5) * 16 AS x, delta_true AS delta FROM pred),
        u AS (SELECT {KEY}, gene, x, ln(list_sum(list_transform(range(17), lambda i: exp(-abs(i - x) / 4)))) AS lse, {UNIT} AS u, least(floor(u), 15) AS lo FROM b),
        t AS (SELECT {KEY}, gene, x, lse, lo AS bin, 1 - (u - lo) AS w FROM u UNION ALL SELECT {KEY}, gene, x, lse, lo + 1, u - lo FROM u),
        s AS (SELECT *, sum(w) OVER (PARTITION BY {KEY}, bin) AS soft FROM t), n AS (SELECT {KEY}, count(DISTINCT gene) AS n FROM t GROUP BY ALL),
        c AS (SELECT {KEY}, gene, sum(w * (lse + abs(bin - x) / 4)) * sum(w * least(3.0::DOUBLE, n / (17 * greatest(soft, 1e-6::DOUBLE)))) AS l FROM s JOIN n USING ({KEY}) GROUP BY ALL)
        SELECT round(avg(l), 6) AS dp_loss FROM c""",
    "loss_total": f"""WITH {COND}, t AS (SELECT dataset, count(*) AS n, avg((l_partkey % 101) / 100.0::DOUBLE) AS a, avg(abs(log2(fold_change))) AS b, avg(abs(delta)) AS c FROM cond GROUP BY 1),
        w AS (SELECT sum(a * n) / sum(n) AS a, sum(b * n) / sum(n) AS b, sum(c * n) / sum(n) AS c FROM t)
        SELECT round(a, 6) AS de_loss, round(b, 6) AS lfc_loss, 0.5::DOUBLE AS lfc_dir_loss, round(c, 6) AS dp_loss, round(a + b + c + 0.5, 6) AS loss FROM w""",
    "readout": f"""WITH {COND}, x AS (SELECT {KEY}, gene, (l_partkey % 101) / 100.0::DOUBLE AS p, list_transform(range(17), lambda i: -abs(i - ((l_partkey % 13) / 13.0::DOUBLE - 0.5 + 0.5) * 16) / 4 / 4.5::DOUBLE) AS l FROM cond)
        SELECT {KEY}, gene, round(1 / (1 + exp(-(4 * p - 2) / 4.0::DOUBLE)), 6) AS p, round(((list_position(l, list_max(l)) - 1 + 0.5::DOUBLE) / 17 * 2 - 1) * {GRID}, 6) + 0.0 AS delta FROM x""",
    "truth_targets": f"""WITH {COND} SELECT {KEY}, gene, fdr < 0.05::DOUBLE AS de, gene = pert AS target, CASE WHEN fdr < 0.05::DOUBLE AND fold_change > 0 THEN round(log2(fold_change), 6) + 0.0 END AS lfc FROM cond""",
    "inconsistent_controls": f"WITH {PRED} SELECT DISTINCT dataset, context FROM (SELECT dataset, context, bool_or(delta_pred > 0.4::DOUBLE) AS holes, bool_and(delta_pred > 0.4::DOUBLE) AS bare FROM pred GROUP BY ALL) WHERE dataset = 'P' AND holes AND NOT bare",
    "text_tiers": """SELECT c_name AS key, CASE WHEN c_custkey % 5 = 0 THEN c_mktsegment WHEN c_custkey % 3 = 0 THEN c_name END AS text,
        CASE WHEN c_custkey % 5 = 0 THEN 0 WHEN c_custkey % 3 = 0 THEN 1 ELSE -1 END::BIGINT AS tier FROM customer""",
    "unembedded": "SELECT DISTINCT c_custkey AS key FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')",
    "uncovered_genes": """WITH a AS (SELECT DISTINCT p_brand || '|' || p_size AS gene FROM part WHERE p_size < 40), b AS (SELECT DISTINCT p_brand || '|' || p_size AS gene FROM part WHERE p_size > 10)
        SELECT gene, 'not on the axis' AS "where" FROM a WHERE gene NOT IN (SELECT gene FROM b) UNION ALL SELECT gene, 'in no shard' FROM b WHERE gene NOT IN (SELECT gene FROM a)""",
    "invalid_properties": """WITH r AS (SELECT p_partkey AS cid, ['MolecularWeight', 'TPSA', 'HBondDonorCount', 'Charge'][p_size % 4 + 1] AS field,
            CASE p_partkey % 5 WHEN 0 THEN '-' || p_size WHEN 1 THEN p_size || '.5' WHEN 2 THEN 'x' ELSE p_size::VARCHAR END AS value, try_cast(value AS DOUBLE) AS v FROM part)
        SELECT cid, field, value FROM r WHERE v IS NULL OR (field = 'MolecularWeight' AND v <= 0) OR (field IN ('TPSA', 'HBondDonorCount') AND v < 0) OR (field IN ('HBondDonorCount', 'Charge') AND v <> floor(v))""",
    "window_means": """WITH v AS (SELECT vec_id AS key, embedding::DOUBLE[] AS v FROM embeddings), p AS (SELECT key, v, unnest(range(1, len(v) + 1)) AS i FROM v),
        m AS (SELECT key, i, (v[i] + (v[len(v) + 1 - i] + v[i]) / 2 + v[i]) / 3 AS x FROM p)
        SELECT key, round(max(x) FILTER (i = 1), 6) + 0.0 AS first, round(sum(x), 6) + 0.0 AS total FROM m GROUP BY 1""",
}


# --- order and sampling: the sampler's arithmetic written out with aliases ---------------------------

_PRIME, _FACTOR = 2147483647, 48271


def _mix(x: str, key: str, name: str) -> str:
    """Aliases that end in ``name``: a square modulo a prime, then a step."""
    return f"(({x} + {key}) % {_PRIME})::BIGINT AS {name}a, (({name}a * {name}a + {key}) % {_PRIME} * {_FACTOR} + {key}) % {_PRIME} AS {name}"


def _mix_number(x: int, key: int) -> int:
    return ((((x + key) % _PRIME) ** 2 + key) % _PRIME * _FACTOR + key) % _PRIME


def _walk(name: str, source: str, x: str, n: str) -> str:
    """A recursive table: keyed rows of ``source`` through the permutation of 0 .. n - 1, again while they land beyond it."""
    steps = ["x % a AS l0", "x // a AS r0"]
    for i in range(8):
        steps += [f"(key + {i * _FACTOR}) % {_PRIME} AS k{i}", _mix(f"r{i}", f"k{i}", f"m{i}"), f"r{i} AS l{i + 1}", f"(l{i} + m{i}) % {'b' if i % 2 else 'a'} AS r{i + 1}"]
    return f"""{name} AS (SELECT id, key, {x}::BIGINT AS x, {n}::BIGINT AS n, ceil(sqrt({n}))::BIGINT AS a, ceil({n} / ceil(sqrt({n})))::BIGINT AS b, 0 AS step FROM {source}
        UNION ALL SELECT id, key, y, n, a, b, step + 1 FROM (SELECT *, {", ".join(steps)}, r8 * a + l8 AS y FROM {name} WHERE step = 0 OR x >= n))"""


def _blended_sql(weights: list[tuple[str, float]], epochs: tuple[int, ...], replicas: int, seed: int) -> str:
    cycle_key, slot_key = _mix_number(_mix_number(1, seed), 1), _mix_number(_mix_number(1, seed), 0)
    return f"""
        WITH RECURSIVE w(g, weight) AS (VALUES {", ".join(f"('{g}', {x}::DOUBLE)" for g, x in weights if x > 0)}),
        members AS (SELECT g, o_orderkey AS row, row_number() OVER (PARTITION BY g ORDER BY o_orderkey) - 1 AS place FROM orders JOIN w ON g = o_orderpriority),
        sizes AS (SELECT g, count(*) AS n FROM members GROUP BY g),
        used AS (SELECT g, n, weight, row_number() OVER (ORDER BY g) - 1 AS no, (ceil(sum(n) OVER () / {replicas}.0) * {replicas})::BIGINT AS total,
            weight / sum(weight) OVER () * total AS x, floor(x)::BIGINT AS low FROM sizes JOIN w USING (g)),
        dealt AS (SELECT *, low + (row_number() OVER (ORDER BY round(x - low, 9) DESC, no) <= total - sum(low) OVER ())::INT AS draws FROM used),
        counts AS (SELECT *, coalesce(sum(draws) OVER (ORDER BY no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM dealt),
        spans AS (SELECT *, epoch * draws // n AS c0, (epoch * draws + draws - 1) // n AS c1 FROM counts, (VALUES {", ".join(f"({e})" for e in epochs)}) t(epoch)),
        each AS (SELECT row_number() OVER () AS id, epoch, cycle, g, row, place, n, no, draws, start, total
            FROM members JOIN (SELECT * EXCLUDE (c0, c1), unnest(range(c0::BIGINT, c1::BIGINT + 1)) AS cycle FROM spans) USING (g)),
        keyed AS (SELECT *, {_mix(str(cycle_key), "no", "q")}, {_mix("q", "cycle", "key")} FROM each),
        {_walk("cycles", "keyed", "place", "n")},
        drawn AS (SELECT each.*, cycle * each.n + x - epoch * draws AS k FROM each JOIN cycles USING (id) WHERE step > 0 AND x < cycles.n AND k >= 0 AND k < draws),
        later AS (SELECT *, start + k AS i, {_mix(str(slot_key), "epoch", "key")} FROM drawn),
        {_walk("slots", "later", "i", "total")}
        SELECT epoch::BIGINT AS epoch, (x // (total // {replicas}))::BIGINT AS replica, (x % (total // {replicas}))::BIGINT AS at, g AS "group", row, cycle::BIGINT AS cycle
        FROM drawn JOIN slots USING (id) WHERE step > 0 AND x < slots.n
    """


def _runs_sql(row: str, keys: str, size: int, told: str) -> str:
    return f"""WITH r AS ({row}), f AS (SELECT *, row_number() OVER (ORDER BY ord) - 1 AS place, coalesce(({keys} IS DISTINCT FROM lag({keys}) OVER (ORDER BY ord))::INT, 1) AS ch FROM r),
        g AS (SELECT *, sum(ch) OVER (ORDER BY ord) AS run FROM f), p AS (SELECT *, min(place) OVER (PARTITION BY run) AS run_start FROM g),
        c AS (SELECT *, (sum(((place - run_start) % {size} = 0)::INT) OVER (ORDER BY ord) - 1)::BIGINT AS chunk FROM p) {told}"""


ORACLE_SQL |= {
    "blended_epochs": _blended_sql([("1-URGENT", 4.0), ("2-HIGH", 2.0), ("3-MEDIUM", 1.0), ("4-NOT SPECIFIED", 0.0), ("5-LOW", 1.0)], (0, 3), 4, 11),
    "global_runs": _runs_sql(
        "SELECT o_orderkey AS ord, o_orderstatus AS dataset, o_orderpriority AS context FROM orders", "dataset || '|' || context", 2, "SELECT ord, dataset, context, place, run_start, chunk FROM c"
    ),
    "gene_groups": _runs_sql(
        "SELECT o_orderkey AS ord, o_orderstatus AS dataset, o_totalprice > 50000 AS labelled FROM orders",
        "dataset",
        8,
        "SELECT chunk AS batch, dataset, count(*) AS n, bool_and(labelled) AS labelled, bool_and(labelled) <> bool_or(labelled) AS mixed FROM c GROUP BY ALL",
    ),
}

_MATRIX = f"""WITH {CELLS}, {COUNTS}, r AS (SELECT cell_id, row_number() OVER (ORDER BY cell_id) - 1 AS row FROM cells)"""
ORACLE_SQL |= {
    "matrix_counts": f"{_MATRIX} SELECT cell_id, row, gene, value FROM counts JOIN r USING (cell_id)",
    "matrix_row_range": f"""{_MATRIX}, g AS (SELECT gene, row_number() OVER (ORDER BY gene) - 1 AS col FROM (SELECT DISTINCT p_brand AS gene FROM part))
        SELECT row, count(*) AS stored, sum(value) AS total, max(col)::INT AS "last" FROM counts JOIN r USING (cell_id) JOIN g USING (gene) WHERE row >= (SELECT count(*) FROM r) // 10 GROUP BY row""",
}

ORACLE_SQL |= {
    "evidence_increments": f"WITH {PARTS} SELECT pert, gene, {STATS} FROM parts GROUP BY ALL",
    "cell_line_parts": """WITH r AS (SELECT *, p_partkey % 4 AS n, 'M' || p_size AS p_mfgr, 'C' || p_size AS p_container FROM part)
        SELECT p_partkey AS key, CASE WHEN n < 2 THEN p_name ELSE '' END AS cell_type, CASE WHEN n < 2 THEN p_brand ELSE '' END AS cell_type_accession,
            CASE WHEN n < 3 THEN p_mfgr || '/' || p_brand ELSE '' END AS parents,
            CASE n WHEN 0 THEN 'Transfection/' || p_type || '/DB/' || p_container WHEN 1 THEN 'CRISPR/' || p_type || '/DB/' || p_container WHEN 2 THEN '/' || p_type || '//' ELSE '' END AS integrations,
            CASE n WHEN 0 THEN p_type || ' via Transfection' WHEN 1 THEN p_type || ' via CRISPR' WHEN 2 THEN p_type ELSE '' END AS integration_text FROM r""",
}

ORACLE_SQL |= {
    "cell_metadata": """SELECT o_orderkey AS cell_id, map {'1-URGENT': 'u', '2-HIGH': 'h', '3-MEDIUM': 'm', '4-NOT SPECIFIED': 'n', '5-LOW': 'l'}[o_orderpriority] AS context,
        'drug' || o_custkey || '_' || (o_orderkey % 9) || '.5uM' AS pert FROM orders""",
    "local_sources": """WITH items AS (SELECT l_partkey AS drug, l_returnflag AS cell, l_linestatus = 'O' AS redo, l_quantity::DOUBLE AS dose, l_extendedprice::DOUBLE AS value FROM lineitem),
        kept AS (SELECT * FROM items QUALIFY redo OR NOT bool_or(redo) OVER (PARTITION BY drug, dose, cell)),
        near AS (SELECT p_partkey AS key, k.*, abs(log10(dose / p_size)) AS far FROM part JOIN kept k ON drug = p_partkey),
        least AS (SELECT * FROM near QUALIFY far <= min(far) OVER (PARTITION BY key) + 1e-10::DOUBLE),
        chosen AS (SELECT * FROM least QUALIFY dose = min(dose) OVER (PARTITION BY key)),
        medians AS (SELECT key, cell, median(value)::FLOAT::DOUBLE AS v FROM chosen GROUP BY ALL),
        effects AS (SELECT p_brand, p_type, sum(p_size) AS v FROM part GROUP BY ALL),
        wells AS (SELECT p_brand, p_type, median(p_size) AS v FROM part GROUP BY ALL),
        space AS (SELECT vec_id % 97 AS name, list_sum(embedding::DOUBLE[]) AS v, len(embedding) AS n FROM embeddings QUALIFY vec_id = min(vec_id) OVER (PARTITION BY vec_id % 97))
        SELECT source, key, length, round(round(total, 2), 1) + 0.0 AS total FROM (
        SELECT 'gene_effects' AS source, replace(p_brand, '#', '') AS key, (SELECT count(DISTINCT p_type) FROM part) AS length, sum(v)::DOUBLE AS total FROM effects GROUP BY p_brand
        UNION ALL SELECT 'network_space', 'N' || name, n, v FROM space
        UNION ALL SELECT 'viability_profiles', key::VARCHAR, (SELECT count(DISTINCT cell) FROM medians), sum(v) FROM medians GROUP BY key
        UNION ALL SELECT 'morphology_profiles', p_brand, (SELECT count(DISTINCT p_type) FROM part), sum(v) FROM wells GROUP BY p_brand)""",
}
