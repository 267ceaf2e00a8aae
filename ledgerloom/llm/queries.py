"""One query per operator, over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, jaccard, langid, merkle, mixing, pages, quality_net, quality_rules, repeats, sharding, spelling, warc
from .common import crc_fold, table

QUERIES = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query
def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = crc_fold(F.col("doc_id"), 4) == 2
    return langid.predict(docs, langid.fit(docs.where(~held)), held)


@query
def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"), min_bytes=0)


@query
def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per leaked document and class of benchmark items."""
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), inside=True)


@query
def op5_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.components(table(spark, sf_dir, "documents"), jaccard.Rule(words=3, num=90, den=100))


@query
def op6_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents"), need=50, with_text=False)


@query
def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"))


@query
def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.digests(chat.with_hostile(table(spark, sf_dir, "conversations")))


@query
def op9_quality_net(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = crc_fold(F.col("doc_id"), 5) == 0
    return quality_net.score(docs, quality_net.fit(docs, table(spark, sf_dir, "labels"), ~held), held)


@query
def op10_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extract(table(spark, sf_dir, "pages"))


@query
def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.without_breaks(table(spark, sf_dir, "documents")).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


@query
def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.document_shards(table(spark, sf_dir, "documents"))


@query
def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.document_variants(table(spark, sf_dir, "documents"))


#: crc32 by its table of 256 entries, for SQL without such a function.
CRC_TABLE = """
    SELECT list(list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END) ORDER BY i) AS t
    FROM (SELECT unnest(range(256)) AS i)
"""


def crc32_sql(text: str) -> str:
    """crc32 of the UTF-8 bytes of ``text``; ``t`` is the column of CRC_TABLE."""
    codes = f"list_transform(range(octet_length(encode({text}))), lambda k: CAST('0x' || substr(hex(encode({text})), CAST(2 * k + 1 AS INTEGER), 2) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(4294967295, {codes}), lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1])), 4294967295)"


def field_sql(column: str) -> str:
    text = f"CAST({column} AS VARCHAR)"
    return f"CASE WHEN {column} IS NULL THEN '-' ELSE octet_length(encode({text})) || ':' || {text} END"


ORACLES = {
    "op11_merkle": f"""
        WITH RECURSIVE crc AS ({CRC_TABLE}),
        d AS (
            SELECT *, CASE WHEN {crc32_sql("CAST(doc_id AS VARCHAR)")} % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS now FROM documents, crc
        ), leaves AS (
            SELECT doc_id, source, sha256(concat({", ".join(map(field_sql, merkle.FIELDS))})) AS leaf,
                sha256(concat({", ".join(field_sql("now" if c == "text" else c) for c in merkle.FIELDS)})) AS other FROM d
        ), ranked AS (
            SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS r,
                count(*) OVER (PARTITION BY source) AS n FROM leaves
        ), nodes AS (
            SELECT 0 AS level, tree, n, r, leaf AS h FROM ranked
            UNION ALL SELECT level + 1, tree, (n + 2) // 3, r // 3, sha256(string_agg(h, '' ORDER BY r)) FROM nodes WHERE n > 1 GROUP BY level, tree, n, r // 3
        ), subroots AS (SELECT tree, h, count(*) OVER () AS n FROM nodes WHERE n = 1),
        crown AS (
            SELECT 0 AS level, n, tree AS r, h FROM subroots
            UNION ALL SELECT level + 1, (n + 2) // 3, r // 3, sha256(string_agg(h, '' ORDER BY r)) FROM crown WHERE n > 1 GROUP BY level, n, r // 3
        ), steps AS (
            SELECT x.tree, x.r AS leaf_r, p.level, string_agg(s.h, '' ORDER BY s.r) FILTER (s.r < x.r // CAST(power(3, p.level) AS BIGINT)) AS lefts,
                string_agg(s.h, '' ORDER BY s.r) FILTER (s.r > x.r // CAST(power(3, p.level) AS BIGINT)) AS rights
            FROM ranked x JOIN (SELECT DISTINCT level, tree FROM nodes WHERE n > 1) p ON p.tree = x.tree
            JOIN nodes s ON s.tree = x.tree AND s.level = p.level AND s.r // 3 = x.r // CAST(power(3, p.level + 1) AS BIGINT) GROUP BY ALL
            UNION ALL
            SELECT x.tree, x.r, p.level + 1000, string_agg(s.h, '' ORDER BY s.r) FILTER (s.r < x.tree // CAST(power(3, p.level) AS BIGINT)),
                string_agg(s.h, '' ORDER BY s.r) FILTER (s.r > x.tree // CAST(power(3, p.level) AS BIGINT))
            FROM ranked x JOIN (SELECT DISTINCT level FROM crown WHERE n > 1) p ON true
            JOIN crown s ON s.level = p.level AND s.r // 3 = x.tree // CAST(power(3, p.level + 1) AS BIGINT) GROUP BY ALL
        ), path AS (
            SELECT tree, leaf_r, row_number() OVER (PARTITION BY tree, leaf_r ORDER BY level) AS k, coalesce(lefts, '') AS lefts, coalesce(rights, '') AS rights FROM steps
        ), folded AS (
            SELECT tree, r, 0::BIGINT AS k, other AS h FROM ranked
            UNION ALL SELECT f.tree, f.r, f.k + 1, sha256(p.lefts || f.h || p.rights) FROM folded f JOIN path p ON p.tree = f.tree AND p.leaf_r = f.r AND p.k = f.k + 1
        ), proofs AS (SELECT tree, leaf_r, sha256(string_agg(lefts || rights, '' ORDER BY k)) AS proof FROM path GROUP BY ALL),
        ends AS (SELECT tree, r, arg_max(h, k) AS h FROM folded GROUP BY ALL)
        SELECT x.doc_id, x.leaf, u.h AS subroot, c.h AS root, coalesce(proof, sha256('')) AS proof_sha256, e.h AS folded_root, e.h = c.h AS verified
        FROM ranked x JOIN subroots u USING (tree) JOIN crown c ON c.n = 1 JOIN ends e ON e.tree = x.tree AND e.r = x.r LEFT JOIN proofs p ON p.tree = x.tree AND p.leaf_r = x.r
    """,
    "op13_spelling": rf"""
        WITH RECURSIVE crc AS ({CRC_TABLE}),
        runs AS (
            SELECT doc_id, run, count(*) AS n FROM (
                SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents
            ) GROUP BY ALL
        ), hashed AS (SELECT run, n, {crc32_sql("doc_id || ':' || run")} AS h FROM runs, crc),
        noisy AS (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed),
        words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM noisy WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
        cuts AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
        pairs AS (
            SELECT a.word, b.word AS other, b.n FROM cuts a JOIN cuts b ON a.i = b.i AND a.rest = b.rest AND length(a.word) = length(b.word) AND a.word <> b.word
            UNION SELECT c.word, w.word, w.n FROM cuts c JOIN words w ON w.word = c.rest
            UNION SELECT w.word, c.word, c.n FROM cuts c JOIN words w ON w.word = c.rest
        ), best AS (SELECT word, count(*) AS n_near, min({{'minus': -n, 'word': other}}) AS b FROM pairs GROUP BY word),
        forms AS (
            SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN -b.minus >= 2 * w.n THEN b.word END AS form, CASE WHEN -b.minus >= 2 * w.n THEN -b.minus END AS form_n
            FROM words w LEFT JOIN best ON best.word = w.word
        ), ends AS (
            SELECT word, word AS at, form AS further FROM forms
            UNION ALL SELECT e.word, f.word, f.form FROM ends e JOIN forms f ON f.word = e.further
        )
        SELECT f.word, f.form, e.at AS root, f.n, f.n_near, f.form_n FROM forms f JOIN ends e ON e.word = f.word AND e.further IS NULL
    """,
    "op5_jaccard": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
        ), s AS (
            SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])
                WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)) AS g FROM w
        ), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
        links AS (SELECT a, b FROM shared JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * c >= 90 * (x.n + y.n - c)),
        reach AS (SELECT DISTINCT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
        least AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
        SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id FROM documents d JOIN least USING (doc_id) LEFT JOIN n USING (doc_id)
    """,
    "op6_repeats": """
        WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
        win AS (SELECT doc_id, i, b[i:i + 49] AS w FROM (SELECT doc_id, b, unnest(range(1, octet_length(b) - 48)) AS i FROM d WHERE octet_length(b) >= 50)),
        head AS (SELECT w, min(doc_id) AS m FROM win GROUP BY w),
        hit AS (SELECT DISTINCT doc_id, i FROM win JOIN head USING (w) WHERE m < doc_id),
        runs AS (SELECT doc_id, i, sum(CASE WHEN i <= before + 50 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS g
            FROM (SELECT *, coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), -100) AS before FROM hit)),
        spans AS (SELECT doc_id, g, min(i) AS s, max(i) + 49 AS e FROM runs GROUP BY doc_id, g),
        parts AS (SELECT doc_id, g, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY g), 0) + 1 AS a, s - 1 AS z FROM spans
            UNION ALL SELECT doc_id, max(g) + 1, max(e) + 1, octet_length(any_value(b)) FROM spans JOIN d USING (doc_id) GROUP BY doc_id),
        kept AS (SELECT doc_id, string_agg(CASE WHEN z >= a THEN hex(b[a:z]) ELSE '' END, '' ORDER BY g) AS h FROM parts JOIN d USING (doc_id) GROUP BY doc_id),
        gone AS (SELECT doc_id, sum(e - s + 1) AS n_removed, count(*) AS n_spans FROM spans GROUP BY doc_id)
        SELECT doc_id, CAST(octet_length(b) AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
            sha256(CASE WHEN h IS NULL THEN b ELSE unhex(h) END) AS kept_sha256
        FROM d LEFT JOIN gone USING (doc_id) LEFT JOIN kept USING (doc_id)
    """,
    "op8_chat": r"""
        WITH rows AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, i, r, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) t(i, r)
        ), marks AS (
            SELECT *, len(regexp_extract_all(text, '([\[<])(\\*)(/?INST(:[^\]\n]*)?\]|/?s>)')) AS n FROM rows
        )
        SELECT conv_id, count(*) AS n_turns,
            sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
            CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
            sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
            CAST(7 + sum(15 + length(url_encode(role)) + length(text) + n + CASE WHEN n > 0 THEN 1 ELSE 0 END) AS BIGINT) AS formatted_chars
        FROM marks GROUP BY conv_id
    """,
    "op3_warc": """
        WITH p AS (
            SELECT page_id, encode(coalesce(html, '')) AS payload, sha1(coalesce(html, '')) AS digest FROM pages
        ), last AS (SELECT *, max(page_id) OVER (PARTITION BY digest) AS newest FROM p),
        bits AS (
            SELECT *, list_transform(range(32), lambda k: list_reduce(list_transform(range(5), lambda b: CAST(
                CAST('0x' || substr(digest, 1 + (5 * k + b) // 4, 1) AS INTEGER) // [8, 4, 2, 1][1 + (5 * k + b) % 4] % 2 AS INTEGER)), lambda x, y: 2 * x + y)) AS fives FROM last
        )
        SELECT page_id, CAST(octet_length(payload) AS BIGINT) AS payload_bytes,
            list_reduce(list_transform(fives, lambda v: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', v + 1, 1)), lambda x, y: x || y) AS payload_digest,
            CASE WHEN page_id IS DISTINCT FROM newest THEN 'revisit' ELSE 'response' END AS record_type,
            CASE WHEN page_id IS DISTINCT FROM newest THEN newest END AS refers_to
        FROM bits
    """,
}
