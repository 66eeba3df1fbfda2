"""Registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import (conversations, decontamination, jaccard, language, linededup, mixing, neighbours, perplexity, quality, repeats,
               toxicity, urls, whitening)
from ..sources.shared import tidy

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(build):
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build
    return register


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query("op6_mix_sources", r"""
    WITH d AS (
        SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size FROM documents),
    s AS (
        SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight
        FROM (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source)),
    r AS (
        SELECT *, row_number() OVER (ORDER BY source_size / weight, source NULLS LAST) AS k,
               sum(source_size) OVER () AS every, sum(weight) OVER () AS weights FROM s),
    levels AS (
        SELECT k, (1.5::DOUBLE * every::DOUBLE - 2 * coalesce(sum(source_size) OVER b, 0)::DOUBLE)
                  / (weights - coalesce(sum(weight) OVER b, 0))::DOUBLE AS level,
               weight, source_size
        FROM r WINDOW b AS (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    best AS (SELECT level FROM levels WHERE weight * level <= 2 * source_size ORDER BY k LIMIT 1),
    t AS (SELECT source, source_size, least(weight * level, CAST(2 * source_size AS DOUBLE)) AS target FROM s, best),
    m AS (
        SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
               CAST('0x' || substr(md5(doc_id || ':mix'), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE AS unit
        FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
    SELECT doc_id, size, source_size, target,
           CAST((floor(rate) + CASE WHEN unit < rate - floor(rate) THEN 1 ELSE 0 END) * size AS BIGINT) AS taken FROM m""")
def op6_mix_sources(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix(_table(spark, sf, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query("op4_decontaminate")
def op4_decontaminate(spark: SparkSession, sf: str) -> DataFrame:
    return decontamination.contaminated(_table(spark, sf, "documents"), _table(spark, sf, "benchmark"))


URL_RULES = (
    urls.UrlRule("allow", "com"), urls.UrlRule("block", "example.com", "/en/"), urls.UrlRule("allow", "www.example.com", "/en/"),
    urls.UrlRule("block", "net", "/es/"), urls.UrlRule("block", "net", "/fr/"),
)


@query("op10_url_filter")
def op10_url_filter(spark: SparkSession, sf: str) -> DataFrame:
    return urls.judge(_table(spark, sf, "pages"), URL_RULES)


@query("op3_toxicity")
def op3_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    return toxicity.classify(_table(spark, sf, "documents"), _table(spark, sf, "labels"))


@query("op9_quality")
def op9_quality(spark: SparkSession, sf: str) -> DataFrame:
    return quality.classify(_table(spark, sf, "documents"), _table(spark, sf, "labels"))


@query("op5_perplexity")
def op5_perplexity(spark: SparkSession, sf: str) -> DataFrame:
    return perplexity.perplexity(_table(spark, sf, "documents"))


@query("op8_language")
def op8_language(spark: SparkSession, sf: str) -> DataFrame:
    return language.identify(_table(spark, sf, "documents"))


@query("op7_nearest_vectors")
def op7_nearest_vectors(spark: SparkSession, sf: str) -> DataFrame:
    return neighbours.nearest(_table(spark, sf, "embeddings"))


@query("op1_ngram_jaccard", r"""
    WITH RECURSIVE w AS (
        SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                          '[^\x20\x09-\x0D]+') AS w FROM documents),
    s AS (
        SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
            ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS g FROM w),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    i AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
    e AS (SELECT x, y FROM i JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * i >= 90 * (a.n + b.n - i)),
    r AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, e.y FROM r JOIN e ON e.x = r.y)
    SELECT d.doc_id, coalesce(n, 0) AS n_shingles, c.component_id
    FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT x AS doc_id, min(y) AS component_id FROM r GROUP BY x) c USING (doc_id)""")
def op1_ngram_jaccard(spark: SparkSession, sf: str) -> DataFrame:
    return jaccard.jaccard_components(_table(spark, sf, "documents"), jaccard.Similarity(3, 90))


@query("op2_suffix_repeats", """
    WITH b AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
    grams AS (
        SELECT doc_id, p, md5(substr(h, 2 * p + 1, 200)) AS g
        FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 99)) AS p FROM b WHERE length(h) >= 200)),
    later AS (
        SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY g ORDER BY doc_id, p) AS k FROM grams) WHERE k > 1),
    starts AS (
        SELECT doc_id, p, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 100 THEN 0 ELSE 1 END AS fresh FROM later),
    runs AS (
        SELECT doc_id, min(p) AS a, max(p) + 100 AS b
        FROM (SELECT doc_id, p, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM starts) GROUP BY doc_id, run),
    gaps AS (
        SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS a, a AS b FROM runs
        UNION ALL SELECT b.doc_id, coalesce(max(r.b), 0), any_value(length(h) // 2) FROM b LEFT JOIN runs r ON r.doc_id = b.doc_id GROUP BY b.doc_id),
    kept AS (
        SELECT gaps.doc_id, string_agg(substr(h, 2 * a + 1, 2 * (gaps.b - a)), '' ORDER BY a) AS k FROM gaps JOIN b ON b.doc_id = gaps.doc_id GROUP BY gaps.doc_id)
    SELECT b.doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(r.removed, 0) AS BIGINT) AS n_removed,
           CAST(coalesce(r.spans, 0) AS BIGINT) AS n_spans, sha256(unhex(k)) AS kept_sha256
    FROM b JOIN kept ON kept.doc_id = b.doc_id
    LEFT JOIN (SELECT doc_id, sum(b - a) AS removed, count(*) AS spans FROM runs GROUP BY doc_id) r ON r.doc_id = b.doc_id""")
def op2_suffix_repeats(spark: SparkSession, sf: str) -> DataFrame:
    return repeats.without_repeats(_table(spark, sf, "documents")).select("doc.doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@query("op11_whitening")
def op11_whitening(spark: SparkSession, sf: str) -> DataFrame:
    """Every usable row of ``embeddings``, whitened; what is done with nulls, ties and lengths is said at ``whitening.whiten``."""
    return whitening.whiten(_table(spark, sf, "embeddings"))


@query("op12_line_dedup", r"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
    l AS (SELECT r, doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM d),
    k AS (
        SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                            'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
    o AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
    m AS (SELECT k.*, o.key IS NOT NULL AND doc_id <> last AS gone FROM k LEFT JOIN o USING (key))
    SELECT doc_id, count(*) AS n_lines, CAST(count_if(gone) AS BIGINT) AS n_dropped,
           sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
    FROM m GROUP BY r, doc_id""")
def op12_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """All ``documents`` without shared lines; messy rows are treated as ``linededup.without_shared_lines`` says."""
    found = linededup.without_shared_lines(_table(spark, sf, "documents"))
    return found.select("doc.doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("kept", F.lit("")), 256).alias("kept_sha256"))


def _repair_sql() -> str:
    """Dynamic programming from the last turn: per grammar state (nothing, s, u, a) the cheapest ``cost, audit`` as one text,
    six digits and then the edits, so that the least text is the answer."""
    def plus(text: str, cost: str, edit: str) -> str:
        return f"printf('%06d', CAST(left({text}, 6) AS BIGINT) + {cost}) || '{edit}' || substr({text}, 7)"

    def here(state: str, keep: dict[str, str], given: str) -> str:
        keeps = " ".join(f"WHEN ini = '{role}' THEN {plus('v' + to, 'late', 'K')}" for role, to in keep.items())
        return f"""least({plus('v' + state, '3', 'D')},
                CASE WHEN fault IN ('blank', 'duplicate') THEN '999999' ELSE {plus('v' + given, '2 + late', 'R')} END,
                CASE WHEN fault IN ('blank', 'duplicate') THEN '999999' {keeps} ELSE '999999' END) AS g{state}"""

    steps = ", ".join([here("0", {"s": "1", "u": "2"}, "2"), here("1", {"u": "2"}, "2"), here("2", {"a": "3"}, "3"), here("3", {"u": "2"}, "2")])
    through = plus(f"({plus('g3', '2', 'I')})", "2", "I")
    closed = ", ".join([f"least(g0, {plus('g2', '2', 'I')}, {through}) AS v0", f"least(g1, {plus('g2', '2', 'I')}, {through}) AS v1",
                        f"least(g2, {plus('g3', '2', 'I')}) AS v2", f"least(g3, {plus('g2', '2', 'I')}) AS v3"])
    return rf"""
    WITH RECURSIVE bits AS (
        SELECT i::BIGINT AS i, 0 AS k, i::BIGINT AS v FROM range(256) t(i)
        UNION ALL SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::BIGINT) ELSE v >> 1 END FROM bits WHERE k < 8),
    tab AS (SELECT list(v ORDER BY i) AS t FROM bits WHERE k = 8),
    src AS (
        SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
               coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS z FROM conversations),
    crc AS (
        SELECT src.*, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(z, ''), lambda c: ascii(c)::BIGINT)),
                          lambda a, b: xor(t[1 + (xor(a, b) & 255)], a >> 8)), 4294967295::BIGINT) % 20 AS h FROM src, tab),
    dam AS (
        SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role,
               CASE WHEN h = 1 THEN '' WHEN h = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
               unnest(range(CASE WHEN h = 3 THEN 2 ELSE 1 END)) AS copy FROM crc WHERE h <> 0),
    ord AS (
        SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy) AS pos,
               row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS seen,
               left(role, 1) AS ini, regexp_replace(text, '[ 	-]+$', '') AS body FROM dam),
    rs AS (
        SELECT *, lag(ini) OVER (PARTITION BY conv_id ORDER BY pos) AS prev, max(pos) OVER (PARTITION BY conv_id) AS total,
               CASE WHEN body = '' THEN 'blank' WHEN seen > 1 THEN 'duplicate' WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM ord),
    dp AS (
        SELECT DISTINCT conv_id, total + 1 AS pos, '000000' AS v0, '000004II' AS v1, '000002I' AS v2, '000000' AS v3 FROM rs
        UNION ALL
        SELECT conv_id, pos, {closed} FROM (
            SELECT rs.conv_id, rs.pos, {steps}
            FROM (SELECT *, CASE WHEN fault = 'truncated' THEN 1 ELSE 0 END AS late FROM rs) rs
            JOIN dp ON rs.conv_id IS NOT DISTINCT FROM dp.conv_id AND rs.pos = dp.pos - 1)),
    best AS (SELECT conv_id, CAST(left(v0, 6) AS BIGINT) AS cost, substr(v0, 7) AS audit FROM dp WHERE pos = 1),
    ed AS (SELECT conv_id, audit, unnest(range(1, length(audit) + 1)) AS i FROM best),
    ops AS (
        SELECT conv_id, i, substr(audit, i, 1) AS e, length(replace(left(audit, i), 'I', '')) AS row_pos,
               length(replace(left(audit, i), 'D', '')) AS line FROM ed),
    out AS (
        SELECT ops.conv_id, ops.e, ops.line, rs.role, rs.ini, CASE WHEN ops.e = 'I' THEN '' ELSE rs.text END AS text,
               max(CASE WHEN ops.line = 1 AND ops.e = 'K' AND rs.ini = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY ops.conv_id) AS shift
        FROM ops LEFT JOIN rs ON ops.conv_id IS NOT DISTINCT FROM rs.conv_id AND rs.pos = ops.row_pos AND ops.e <> 'I' WHERE ops.e <> 'D'),
    sha AS (
        SELECT conv_id, sha256(string_agg(CASE WHEN e = 'K' THEN role WHEN (line - shift) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text,
                                          chr(10) ORDER BY line)) AS s FROM out GROUP BY conv_id),
    counts AS (
        SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(fault = 'blank') AS blank,
               count_if(fault = 'duplicate') AS duplicate, count_if(fault = 'truncated') AS truncated,
               count_if(pos > 1 AND prev || ini NOT IN ('su', 'ua', 'au')) AS illegal FROM rs GROUP BY conv_id)
    SELECT i.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank,
           CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated,
           CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit,
           coalesce(sha.s, sha256('')) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id FROM conversations) i
    LEFT JOIN counts c ON i.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN best b ON i.conv_id IS NOT DISTINCT FROM b.conv_id
    LEFT JOIN sha ON i.conv_id IS NOT DISTINCT FROM sha.conv_id"""


@query("op13_conversation_repair", _repair_sql())
@tidy
def op13_conversation_repair(spark: SparkSession, sf: str) -> DataFrame:
    """Every conversation of the table, damaged as dealt and repaired; messy rows are treated as ``conversations.repair`` says."""
    rows = _table(spark, sf, "conversations")
    report, turns = conversations.repair(rows, conversations.damaged(rows))
    digests = conversations.turn_digests(turns).withColumnRenamed("conv_id", "id")
    found = report.join(digests, report["conv_id"].eqNullSafe(digests["id"]), "left").drop("id")
    return found.withColumn("repaired_sha256", F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)))
