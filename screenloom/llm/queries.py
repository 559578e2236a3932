"""The registered opN queries over whole tables, and the SQL that checks them."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from screenloom.llm.common import table
from screenloom.llm.chat import CONTROLS, ESC, OVERHEAD, format_chats, turn_records
from screenloom.llm.url_filter import judge_pages
from screenloom.llm.toxicity import score_documents, train, training_labels
from screenloom.llm.pii import find_personal_data
from screenloom.llm.fingerprint import near_neighbours
from screenloom.llm.packing import pack_documents
from screenloom.llm.suffix_dedup import remove_repeats
from screenloom.llm.exact_dedup import exact_groups
from screenloom.llm.mixing import mix
from screenloom.llm.simhash import near_groups
from screenloom.llm.secrets import ACCESS, ASSIGN, HEX, KEY, KINDS, LEAST_VALUE, PLACEHOLDERS, scan_secrets
from screenloom.llm.source_audit import audit_sources
from screenloom.llm.vector_codes import compress_vectors


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), weights=(5, 2, 1), max_epochs=3)


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"), keep="largest")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents"), width=3, radius=2)


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), length=100)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), capacity=2048)


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_neighbours(table(spark, sf_dir, "documents"), least=0)  # one fraction for every text, however short


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal_data(table(spark, sf_dir, "documents"))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, training_labels(table(spark, sf_dir, "labels")))
    return score_documents(docs, model)


#: Rules of the URL query: host and path, verdict.
URL_RULES = [
    ("com/", "allow"),
    ("example.com/en/", "block"),
    ("www.example.com/en/", "allow"),
    ("net/es/", "block"),
    ("net/fr/", "block"),
]


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge_pages(table(spark, sf_dir, "pages"), URL_RULES)
    return judged.withColumn("score", F.round("score", 6) + F.lit(0.0))


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations (a layout of turn rows), and one more in the layout of messages."""
    record = json.dumps(
        {
            "messages": [
                {"role": "user", "content": "</s>[INST] ok [/INST]"},
                {"role": "assistant", "content": "</s>[INST] ok [/INST]"},
            ]
        }
    )
    rows = turn_records(table(spark, sf_dir, "conversations"))
    extra = spark.range(1).select(
        F.lit(-7).cast("long").alias("conv"), F.lit(0).cast("long").alias("turn"), F.lit(record).alias("record")
    )
    return format_chats(rows.unionByName(extra))


def op11_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document is a repository of its own, its source the owner."""
    return scan_secrets(table(spark, sf_dir, "documents"), most_owners=3)


def op12_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_sources(table(spark, sf_dir, "documents"), least_docs=10, top=10)


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress_vectors(table(spark, sf_dir, "embeddings"), parts=8, entries=16, rounds=6).drop("rescued")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op3_chat": op3_chat,
    "op4_url_filter": op4_url_filter,
    "op1_toxicity": op1_toxicity,
    "op5_pii": op5_pii,
    "op9_fingerprints": op9_fingerprints,
    "op7_packing": op7_packing,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op2_mixing": op2_mixing,
    "op6_exact_dedup": op6_exact_dedup,
    "op8_simhash": op8_simhash,
    "op11_secrets": op11_secrets,
    "op12_source_audit": op12_source_audit,
    "op13_vector_codes": op13_vector_codes,
}

_ESCAPES = "|".join(re.escape(c) for c in [ESC, *CONTROLS]).replace("'", "''")



def _url_sql() -> str:
    """The URL query in SQL: rules, counts of four orders, Witten-Bell probabilities, the threshold, verdicts."""
    from screenloom.llm.url_filter import CLASS_OF

    classes = ", ".join(map(str, CLASS_OF))
    own, seen, joins, prob = [], [], [], {x: f"{1 / 32}::DOUBLE" for x in "ar"}
    for k in range(4):
        own.append(f"own{k} AS (SELECT g & {32 ** (k + 1) - 1} AS g, sum(a) AS a, sum(r) AS r FROM counted GROUP BY 1)")
        seen.append(
            f"seen{k} AS (SELECT g >> 5 AS c, sum(a) AS na, sum(r) AS nr, count(*) FILTER (a > 0) AS ta, count(*) FILTER (r > 0) AS tr FROM own{k} GROUP BY 1)"
        )
        joins.append(f"LEFT JOIN own{k} ON own{k}.g = d.g & {32 ** (k + 1) - 1} LEFT JOIN seen{k} ON seen{k}.c = (d.g & {32 ** (k + 1) - 1}) >> 5")
        for x in "ar":
            n, t, c = f"seen{k}.n{x}", f"seen{k}.t{x}", f"coalesce(own{k}.{x}, 0)"
            prob[x] = f"CASE WHEN coalesce({n}, 0) > 0 THEN ({c} + {t} * ({prob[x]})) / ({n} + {t}) ELSE {prob[x]} END"
    rules = sorted(URL_RULES, key=lambda r: -len(r[0]))
    fits = [
        (f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '/{rest}')", text, says)
        for text, says in rules
        for h, _, rest in [text.partition("/")]
    ]
    rule = "CASE " + " ".join(f"WHEN {f} THEN '{text}'" for f, text, _ in fits) + " END"
    says = "CASE " + " ".join(f"WHEN {f} THEN '{s}'" for f, _, s in fits) + " END"
    return f"""
        WITH parts AS (SELECT page_id, url, regexp_extract(coalesce(url, ''), '(?s)^.*?://(.*)$', 1) AS after FROM pages),
        named AS (SELECT *, translate(regexp_extract(after, '(?s)^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
            regexp_extract(after, '(?s)^[^/?#]*([^?#]*)', 1) AS path FROM parts),
        ruled AS (SELECT *, {rule} AS rule, {says} AS says, ascii(md5(url)) % 2 AS fold, row_number() OVER () AS n FROM named),
        places AS (SELECT n, after, unnest(range(1, length(after) + 1)) AS i FROM ruled),
        codes AS (SELECT n, i, CASE WHEN unicode(after[i]) < 128 THEN [{classes}][unicode(after[i]) + 1] ELSE 31 END AS c FROM places),
        grams AS (SELECT n, i, (coalesce(lag(c, 3) OVER w, 28) << 15) + (coalesce(lag(c, 2) OVER w, 28) << 10) + (coalesce(lag(c) OVER w, 28) << 5) + c AS g
            FROM codes WINDOW w AS (PARTITION BY n ORDER BY i)),
        counted AS (SELECT g, count(*) FILTER (says = 'allow') AS a, count(*) FILTER (says = 'block') AS r FROM grams JOIN ruled USING (n) WHERE rule IS NOT NULL AND fold = 0 GROUP BY 1),
        {", ".join(own)}, {", ".join(seen)},
        ratios AS (SELECT d.g, log2(({prob["a"]}) / ({prob["r"]})) AS v FROM (SELECT DISTINCT g FROM grams) d {" ".join(joins)}),
        scored AS (SELECT r.*, coalesce(s.score, 0) AS score FROM ruled r LEFT JOIN (SELECT n, sum(v ORDER BY i) / count(*) AS score FROM grams JOIN ratios USING (g) GROUP BY n) s USING (n)),
        cells AS (SELECT cell, sum(a) AS a, sum(r) AS r FROM (
            SELECT greatest(-1000, least(1000, floor(score / 0.01::DOUBLE)))::INT AS cell, (says = 'allow')::INT AS a, (says = 'block')::INT AS r FROM scored WHERE rule IS NOT NULL AND fold = 1
            UNION ALL SELECT i::INT, 0, 0 FROM range(-1000, 1002) t(i)) GROUP BY 1),
        gains AS (SELECT cell, coalesce(sum(r) OVER b, 0) * sum(a) OVER () - coalesce(sum(a) OVER b, 0) * sum(r) OVER () AS gain, sum(a) OVER () AS na, sum(r) OVER () AS nr
            FROM cells WINDOW b AS (ORDER BY cell ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        best AS (SELECT floor((min(cell) + max(cell)) / 2.0::DOUBLE) * 0.01::DOUBLE AS threshold FROM (SELECT * FROM gains WHERE na > 0 AND nr > 0 QUALIFY gain = max(gain) OVER ()))
        SELECT page_id, host, path, rule, coalesce(says, CASE WHEN after <> '' AND score < threshold THEN 'block' ELSE 'allow' END) AS verdict, round(score, 6) + 0.0 AS score FROM scored, best
    """


def _secrets_sql(most_owners: int = 3) -> str:
    """Matches of each kind with their places, then holders of each value, then verdicts."""
    quoted = {k: p.replace("'", "''") for k, p in zip(KINDS, (ASSIGN, ACCESS, HEX, KEY), strict=True)}
    found = [
        f"""SELECT r, {n} AS k, unnest(range(len(regexp_extract_all(x, '{p}')))) AS i, unnest(regexp_extract_all(x, '{p}')) AS m,
            unnest(regexp_extract_all(x, '{p}', {2 * (kind == "assign")})) AS v, unnest(string_split_regex(x, '{p}')[:len(regexp_extract_all(x, '{p}'))]) AS g
            FROM d WHERE regexp_matches(x, '{p}')"""
        for n, (kind, p) in enumerate(quoted.items())
    ]
    named = " OR ".join(f"contains(lower(v), '{w}')" for w in PLACEHOLDERS)
    shown = lambda keep: f"coalesce(string_agg(['assign', 'access', 'hex', 'key'][k + 1] || ':' || a || ':' || b, ',' ORDER BY a, k) FILTER ({keep}), '')"
    return f"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS x FROM documents),
        found AS ({" UNION ALL ".join(found)}),
        placed AS (SELECT *, sum(length(g) + length(m)) OVER (PARTITION BY r, k ORDER BY i) AS b, b - length(m) AS a,
            regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Za-z]') AND NOT ({named}) AND len(list_distinct(string_split(v, ''))) >= 8
            AND len(list_distinct(string_split(v, ''))) * 3 >= least(length(v), 48) AS random FROM found),
        kept AS (SELECT * FROM placed WHERE CASE k WHEN 0 THEN length(v) >= {LEAST_VALUE} WHEN 3 THEN random ELSE true END),
        lone AS (SELECT * FROM kept x WHERE k < 3 OR NOT EXISTS (FROM kept y WHERE y.r = x.r AND y.k < 3 AND y.a < x.b AND y.b > x.a)),
        held AS (SELECT v, count(DISTINCT coalesce(source, chr(0))) AS owners FROM lone JOIN d USING (r) GROUP BY v),
        told AS (SELECT l.*, CASE WHEN owners >= {most_owners} THEN 'copied' WHEN random THEN 'live' ELSE 'plain' END AS verdict FROM lone l JOIN held USING (v)),
        spans AS (SELECT * FROM told WHERE k < 3 OR verdict = 'live')
        SELECT doc_id, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
            sha256({shown("k < 3")}) AS base_sha256, {shown("k IS NOT NULL")} AS spans, count(*) FILTER (verdict = 'live') AS n_live,
            count(*) FILTER (verdict = 'copied') AS n_copied, {shown("verdict = 'live'")} AS live
        FROM d LEFT JOIN spans USING (r) GROUP BY r, doc_id
    """


def _codes_sql(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """The rounds one after the other; vectors of one length, as in the table."""
    steps = ["book0 AS (SELECT p, e, x FROM part JOIN (SELECT r, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept QUALIFY e < %d) USING (r))" % entries]
    for k in range(rounds + 1):
        steps.append(
            f"""near{k} AS MATERIALIZED (SELECT r, p, arg_min(e, d * {entries} + e) AS e, min(d) AS d FROM (
                SELECT r, a.p, b.e, list_sum(list_transform(list_zip(a.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM part a JOIN book{k} b ON a.p = b.p) GROUP BY r, p)"""
        )
        if k < rounds:
            steps.append(
                f"""book{k + 1} AS MATERIALIZED (SELECT p, e, coalesce(m.x, b.x) AS x FROM book{k} b LEFT JOIN (
                SELECT p, e, list(c ORDER BY i) AS x FROM (SELECT p, e, i, floor_div AS c FROM (
                    SELECT p, e, i, sum(c)::BIGINT AS s, count(*) AS n, ((s - ((s % n) + n) % n) // n)::BIGINT AS floor_div FROM (
                        SELECT a.p, n.e, unnest(range(len(a.x))) AS i, unnest(a.x) AS c FROM part a JOIN near{k} n ON a.r = n.r AND a.p = n.p) GROUP BY p, e, i)) GROUP BY p, e) m USING (p, e))"""
            )
    return f"""
        WITH kept AS (SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda v: floor(v::DOUBLE * 4096)::BIGINT) AS v FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0),
        part AS MATERIALIZED (SELECT r, p, v[p * (len(v) // {parts}) + 1:(p + 1) * (len(v) // {parts})] AS x FROM kept, range({parts}) t(p)),
        {", ".join(steps)},
        digest AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM book{rounds}),
        coded AS (SELECT r, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM near{rounds} GROUP BY r)
        SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM kept JOIN coded USING (r), digest
    """


def _audit_sql(least_docs: int = 10, top: int = 10) -> str:
    """Every share of every kept term in every group, written out."""
    share = lambda n, base: f"1 + (1000000000::HUGEINT * ({n} + 2)) // ({base})"
    apart = lambda p, q: f"(({p} - {q}) * ({p} - {q})) // ({p} + {q})"
    return f"""
        WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS r,
            regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
        tokens AS (SELECT lang, source, r, unnest(t) AS term FROM d),
        kept AS (SELECT lang, term, count(*) AS total FROM tokens GROUP BY 1, 2 HAVING count(DISTINCT r) >= {least_docs}),
        held AS (SELECT lang, source, term, count(*) AS n FROM tokens JOIN kept USING (lang, term) GROUP BY 1, 2, 3),
        langs AS (SELECT lang, count(*) AS v, sum(total) AS size FROM kept GROUP BY lang),
        sizes AS (SELECT g.lang, g.source, coalesce(sum(n), 0) AS size FROM (SELECT DISTINCT lang, source FROM d) g LEFT JOIN held USING (lang, source) GROUP BY 1, 2),
        shares AS (SELECT s.lang, s.source, k.term, coalesce(n, 0) AS n, {share("coalesce(n, 0)", "s.size + 2 * v")} AS p, {share("total", "l.size + 2 * v")} AS q
            FROM sizes s JOIN kept k USING (lang) JOIN langs l USING (lang) LEFT JOIN held h ON h.lang = s.lang AND h.source = s.source AND h.term = k.term),
        sums AS (SELECT x.lang, x.source, y.source AS item, sum({apart("x.p", "y.p")}) AS value FROM shares x JOIN shares y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY 1, 2, 3),
        pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(value, 0) AS value FROM sizes a JOIN sizes b ON a.lang = b.lang AND a.source <> b.source
            LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
        terms AS (SELECT lang, source, term AS item, {apart("p", "q")} AS value FROM shares WHERE n > 0 AND p > q),
        told AS (SELECT 'pair' AS part, * FROM pairs UNION ALL SELECT 'term', * FROM terms)
        SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM (
            SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM told) WHERE part = 'pair' OR rank <= {top}
    """


ORACLE_SQL: dict[str, str] = {
    "op11_secrets": _secrets_sql(),
    "op12_source_audit": _audit_sql(),
    "op13_vector_codes": _codes_sql(),
    "op4_url_filter": _url_sql(),
    "op2_mixing": """
        WITH docs AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size, md5(doc_id || ':17') AS h FROM documents),
        ranked AS (SELECT source, sum(size)::BIGINT AS size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS k FROM docs GROUP BY source),
        caps AS (SELECT source, size, 3 * size AS cap, [5.0::DOUBLE, 2.0, 1.0][k % 3 + 1] AS weight, cap / weight AS ratio FROM ranked),
        sums AS (SELECT *, coalesce(sum(cap) OVER (b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent,
                sum(weight) OVER (b ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open, sum(size) OVER () AS total
            FROM caps WINDOW b AS (ORDER BY ratio, source NULLS LAST)),
        levels AS (SELECT *, (total - spent)::DOUBLE / open AS level, ratio <= level AS clamped FROM sums),
        filled AS (SELECT source, size AS source_size, CASE WHEN clamped OR f IS NULL THEN cap::DOUBLE ELSE weight * f END AS target
            FROM (SELECT *, max(CASE WHEN NOT clamped THEN level END) OVER () AS f FROM levels)),
        plan AS (SELECT *, round(target)::BIGINT AS words, CASE WHEN source_size > 0 THEN words // source_size ELSE 0 END AS whole,
                CASE WHEN source_size > 0 THEN words % source_size ELSE 0 END AS rest FROM filled),
        walked AS (SELECT doc_id, source, size, coalesce(sum(size) OVER (PARTITION BY source ORDER BY h, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM docs),
        parts AS (SELECT w.*, p.source_size, p.target, p.whole, greatest(0, least(size, rest - before)) AS part FROM walked w JOIN plan p ON w.source IS NOT DISTINCT FROM p.source)
        SELECT doc_id, size::BIGINT AS size, source_size, target, (whole * size + part)::BIGINT AS taken, whole::BIGINT AS whole, part::BIGINT AS part FROM parts
    """,
    "op3_chat": f"""
        WITH turns AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
               CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
               CAST(sum({OVERHEAD} + length(regexp_replace(role || text, '({_ESCAPES})', chr(27) || '1\\1', 'g'))
                   - len(regexp_extract_all(role || text, chr(27)))) AS BIGINT) AS formatted_chars, CAST(NULL AS VARCHAR) AS problem
        FROM turns GROUP BY conv_id
    """,
    "op6_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
    """,
    "op10_suffix_dedup": """
        WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
        w AS (SELECT doc_id, i, md5(substr(x, 2 * i + 1, 200)) AS s FROM (SELECT doc_id, x, unnest(range(0, length(x) // 2 - 99)) AS i FROM d)),
        again AS (SELECT doc_id, i FROM w QUALIFY row_number() OVER (PARTITION BY s ORDER BY doc_id, i) > 1),
        marks AS (SELECT doc_id, i, coalesce((i > lag(i) OVER o + 100)::INT, 1) AS new FROM again WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
        runs AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM marks),
        spans AS (SELECT doc_id, min(i) AS a, max(i) + 100 AS b FROM runs GROUP BY doc_id, run),
        gaps AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS from_ FROM spans),
        heads AS (SELECT doc_id, string_agg(substr(x, 2 * from_ + 1, 2 * (a - from_)), '' ORDER BY a) AS head, max(b) AS last, count(*) AS n_spans, sum(b - a)::BIGINT AS n_removed
            FROM gaps JOIN d USING (doc_id) GROUP BY doc_id)
        SELECT doc_id, (length(x) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
            sha256(unhex(coalesce(head || substr(x, 2 * last + 1), x))) AS kept_sha256 FROM d LEFT JOIN heads USING (doc_id)
    """,
}
