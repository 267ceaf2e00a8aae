"""Header and junk detection over the lines of every document, and over message texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import canonical as cn
from ..operators import sheets as sh
from ..operators.portfolio import scalars
from ..session import cut_lineage
from .duck import VIEWS, duck
from .registry import query


def _q(text: str) -> str:
    return text.replace("'", "''")


def _sum_contains(col: str, words) -> str:
    return "(" + " + ".join(f"CAST(contains({col}, '{_q(w)}') AS INT)" for w in words) + ")"


def _rx(col: str, pattern: str) -> str:
    return f"regexp_matches({col}, '{_q(pattern)}')"


def _any(col: str, words) -> str:
    return _rx(col, sh.words_pattern(words))


_all_kw = [w for ws in sh.KEYWORDS.values() for w in ws]
_cnt = lambda p: f"len(regexp_extract_all(low, '{_q(p)}'))"
# The oracle has no back-references: one alternative per character.
_chars = [chr(c) for c in range(32, 127)] + list("ÄÇÈÉÊÍÑÓÖÜßäçèéêíñóöü") + [chr(c) for c in range(0xC0, 0x180)]
_rep = "|".join(("\\" + ch if not ch.isalnum() and ord(ch) < 128 and ch != " " else ch) + "{3,}" for ch in dict.fromkeys(_chars))
_num = lambda v: f"regexp_matches(trim(regexp_replace({v}, '[,$]', '', 'g')), '{sh.NUMBER_PATTERN}')"
_dig = lambda v: f"regexp_matches(regexp_replace({v}, '[.-]', '', 'g'), '^[0-9]+$')"

FEAT = f"""SELECT *, len(filled) AS non_null, len(list_filter(filled, lambda v: {_num('v')})) AS numeric_count,
    len(list_filter(filled, lambda v: regexp_matches(v, '{sh.DATE_PATTERN}'))) AS date_count,
    len(list_filter(filled, lambda v: NOT {_rx('lower(v)', sh.ANY_KEYWORD)})) / greatest(len(filled), 1)::DOUBLE AS consistency FROM (
  SELECT *, lower(line) AS low, list_filter(cells, lambda v: trim(v) <> '') AS filled, length(line) AS text_length,
    len(regexp_extract_all(line, '[^\\p{{L}}\\p{{N}}_\\s]')) AS specials, len(regexp_extract_all(line, '\\p{{Lu}}')) / greatest(length(line), 1)::DOUBLE AS caps_ratio,
    len(regexp_extract_all(line, ' ')) / greatest(length(line), 1)::DOUBLE AS space_ratio,
    len(list_distinct(list_filter(regexp_split_to_array(lower(line), '\\s+'), lambda t: t <> ''))) AS unique_tokens,
    len(regexp_extract_all(line, '{_q(_rep)}')) AS repeats FROM sheets)"""
FEAT2 = f"""SELECT *, {_sum_contains('low', _all_kw)} AS keyword_hits, {' + '.join(_cnt(p) for p, _ in sh.CONTEXT_PATTERNS)} AS pattern_hits,
  {' + '.join(f'{_cnt(p)} * {w}::DOUBLE' for p, w in sh.CONTEXT_PATTERNS)} AS pattern_weight FROM feat"""


@query(
    "K1 K2 K3 F15 F16",
    duck("sheets", """SELECT file_id, row_idx, non_null, text_length, numeric_count, date_count, specials, caps_ratio, space_ratio, unique_tokens, repeats, keyword_hits, pattern_hits, pattern_weight, consistency FROM f2""", feat=FEAT, f2=FEAT2),
    r6="caps_ratio space_ratio pattern_weight consistency",
)
def sheet_row_features(spark, d):
    out = sh.content_features(cn.sheets(spark, d)).drop("line", "cells", "mean_cell")
    whole = ["non_null", "text_length", "numeric_count", "date_count", "specials", "unique_tokens", "repeats", "keyword_hits", "pattern_hits"]
    return out.withColumns({c: F.col(c).cast("long") for c in whole})


STATS = "SELECT file_id, max(len(cells)) AS width, count(*) AS n_rows, avg(text_length) AS ml, stddev_pop(text_length) AS sl FROM feat GROUP BY 1"
CONTENT = """SELECT *, null_share * 0.3::DOUBLE + CASE WHEN sl > 0 THEN least(abs(text_length - ml) / sl / 3, 0.3::DOUBLE) ELSE 0 END
    + least(0.2::DOUBLE * keyword_hits + 0.6::DOUBLE * pattern_weight, 0.8::DOUBLE) + (1 - consistency) * 0.2::DOUBLE + CASE WHEN caps_ratio > 0.8 OR caps_ratio < 0.1 THEN 0.1::DOUBLE ELSE 0 END AS content_score
  FROM (SELECT *, 1 - non_null / width::DOUBLE AS null_share FROM f2 JOIN stats USING (file_id))"""
BASE = dict(feat=FEAT, f2=FEAT2, stats=STATS, content=CONTENT)


@query("K4", duck("sheets", "SELECT file_id, row_idx, null_share, content_score FROM content", **BASE), r6="null_share content_score")
def sheet_content_scores(spark, d):
    return sh.content_scores(cn.sheets(spark, d)).select("file_id", "row_idx", "null_share", "content_score")


_near = (-3, -2, -1, 1, 2, 3)
_lag = lambda o: f"lag(me, {-o}) OVER w" if o < 0 else f"lead(me, {o}) OVER w"
NEIGH = "SELECT *, " + ", ".join(f"{_lag(o)} AS nb{i}" for i, o in enumerate(_near)) + ", " + ", ".join(
    f"lead(non_null, {o}) OVER w AS fo{o}" for o in (1, 2, 3, 4)
) + """, avg(non_null / width::DOUBLE) OVER (PARTITION BY file_id ORDER BY row_idx ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS local_density
  FROM (SELECT *, {'ns': null_share, 'nn': non_null, 'tl': text_length, 'co': consistency, 'pk': packed, 'pos': pos} AS me FROM (
    SELECT *, length(replace(line, ' ', '')) AS packed, list_filter(list_transform(cells, lambda v, i: CASE WHEN trim(v) <> '' THEN i END), lambda i: i IS NOT NULL) AS pos,
      coalesce(list_avg(list_transform(filled, lambda v: length(v))), 0) AS mean_cell FROM content))
  WINDOW w AS (PARTITION BY file_id ORDER BY row_idx)"""
_clo = lambda a, b: f"(1 - abs({a} - {b}) / greatest({a}, {b}, 1)::DOUBLE)"


def _sim(i):
    n = f"nb{i}"
    return f"CASE WHEN {n} IS NOT NULL THEN ((1 - abs(null_share - {n}.ns)) + {_clo('non_null', n + '.nn')} + {_clo('text_length', n + '.tl')} + (1 - abs(consistency - {n}.co))) / 4 END"


def _pat(i):
    n = f"nb{i}"
    both = f"len(list_intersect(pos, {n}.pos))"
    either = f"(non_null + {n}.nn - {both})"
    return f"CASE WHEN {n} IS NOT NULL THEN ((width - {either}) / greatest(width - {both}, 1)::DOUBLE + {both} / greatest({either}, 1)::DOUBLE + {_clo('packed', n + '.pk')}) / 3 END"


_pt = lambda cond, p: f"CASE WHEN {cond} THEN {p} ELSE 0 END"
_calm = "len(list_filter(filled, lambda v: (contains(v, '_') AND length(v) < 30) OR len(regexp_extract_all(regexp_replace(v, '[_-]', ' ', 'g'), ' ')) <= 2))"
_foll = " + ".join(f"coalesce(CAST(abs(fo{o} - non_null) <= 2 AS INT), 0)" for o in (1, 2, 3, 4))
_exists = lambda cond: f"CAST(len(list_filter(filled, lambda v: {cond})) > 0 AS INT)"
_date = "(contains(v, '/') OR (contains(v, '-') AND length(v) >= 8))"
HEAD = " + ".join([_pt("non_null * 10 >= width * 6", 3), _pt(f"row_idx < n_rows - 2 AND ({_foll}) >= 2", 3), _pt(f"non_null > 0 AND {_calm} * 10 >= non_null * 6", 4)])
DATA = " + ".join([
    _pt("row_idx >= 1 AND row_idx < n_rows - 2", 2), _pt("non_null * 2 >= width", 3),
    _pt(f"{_exists(_dig('v'))} + {_exists('NOT ' + _dig('v') + ' AND ' + _date)} + {_exists('NOT ' + _dig('v') + ' AND NOT ' + _date)} >= 2", 3), _pt("NOT " + _any("low", sh.DATA_JUNK), 2),
])
JUNK = "least(10, " + " + ".join([
    _pt("(width - non_null) * 10 > width * 7", 4), _pt(f"row_idx * 5 > n_rows * 4 AND {_any('low', sh.FOOTER_WORDS)}", 6), _pt(_any("low", sh.STRONG_JUNK), 5),
    _pt(_any("low", sh.METADATA_PHRASES), 3), _pt("len(list_distinct(string_split(replace(low, ' ', ''), ''))) <= 3 AND length(low) > 5", 7),
    _pt(f"non_null = 1 AND {_any('low', ['total', 'sum', 'summary'])}", 6),
]) + ")"
_prof = "SELECT file_id, avg(non_null) AS pf, avg(mean_cell) AS pc, avg(CAST(numeric_count > 0 AS INT)) AS pn, avg(CAST(non_null > numeric_count AS INT)) AS px FROM neigh GROUP BY 1"
PROX = f"""SELECT *, (1 - neighbour_similarity) * 0.4::DOUBLE + (1 - pattern_consistency) * 0.3::DOUBLE + (1 - coherence) * 0.3::DOUBLE AS proximity_score FROM (
  SELECT *, coalesce(list_avg([{', '.join(_sim(i) for i in range(6))}]), 0) AS neighbour_similarity, coalesce(list_avg([{', '.join(_pat(i) for i in (1, 2, 3, 4))}]), 0.5) AS pattern_consistency,
    ({_clo('non_null', 'pf')} + {_clo('mean_cell', 'pc')} + 0.5 * CASE WHEN numeric_count > 0 THEN pn ELSE 1 - pn END + 0.5 * CASE WHEN non_null > numeric_count THEN px ELSE 1 - px END) / 3 AS structural_similarity,
    CASE WHEN h > 7 THEN h WHEN dt > 6 THEN dt ELSE 10 - j END / 10.0::DOUBLE AS coherence
  FROM (SELECT *, {HEAD} AS h, {DATA} AS dt, {JUNK} AS j FROM neigh JOIN prof USING (file_id)))"""
FULL = dict(**BASE, neigh=NEIGH, prof=_prof, prox=PROX)


@query(
    "W1 W2 W3 W4 W5 K5",
    duck("sheets", "SELECT file_id, row_idx, neighbour_similarity, local_density, pattern_consistency, structural_similarity, coherence, proximity_score FROM prox", **FULL),
    r6="neighbour_similarity local_density pattern_consistency structural_similarity coherence proximity_score",
)
def sheet_neighbour_features(spark, d):
    return sh.statistical_scores(cn.sheets(spark, d)).select(
        "file_id", "row_idx", "neighbour_similarity", "local_density", "pattern_consistency", "structural_similarity", "coherence", "proximity_score"
    )


COMB = """SELECT *, raw / scale AS statistical_score, raw / scale > threshold AS is_junk FROM (
  SELECT * FROM (SELECT *, content_score * 0.4::DOUBLE + proximity_score * 0.3::DOUBLE AS raw FROM prox) JOIN (
    SELECT file_id, CASE WHEN max(raw) > 0 THEN max(raw) ELSE 1 END AS scale, greatest(0.3::DOUBLE, least(0.65::DOUBLE, (avg(raw) + 2 * stddev_pop(raw)) / CASE WHEN max(raw) > 0 THEN max(raw) ELSE 1 END)) AS threshold
    FROM (SELECT *, content_score * 0.4::DOUBLE + proximity_score * 0.3::DOUBLE AS raw FROM prox) GROUP BY 1) USING (file_id))"""


@query(
    "K6",
    duck("sheets", "SELECT file_id, row_idx, statistical_score, threshold, is_junk FROM comb", **FULL, comb=COMB),
    r6="statistical_score threshold",
)
def sheet_junk_rows(spark, d):
    return sh.combined_scores(cn.sheets(spark, d)).select("file_id", "row_idx", "statistical_score", "threshold", "is_junk")


@query(
    "P15",
    duck("sheets", "SELECT file_id, count(*) AS kept, sum(text_length)::BIGINT AS characters FROM comb WHERE NOT is_junk GROUP BY 1", **FULL, comb=COMB),
)
def sheet_rows_kept(spark, d):
    kept = sh.combined_scores(cn.sheets(spark, d)).where("is_junk IS NOT TRUE")
    return kept.groupBy("file_id").agg(F.count(F.lit(1)).alias("kept"), F.sum("text_length").alias("characters"))


@query(
    "A32",
    duck("sheets", """SELECT feature, abs(g) / sum(abs(g)) OVER () AS importance FROM (SELECT unnest(['null_share','keyword_hits','neighbour_similarity']) AS feature,
      unnest([avg(null_share) FILTER (is_junk) - avg(null_share) FILTER (NOT is_junk), avg(keyword_hits + pattern_hits) FILTER (is_junk) - avg(keyword_hits + pattern_hits) FILTER (NOT is_junk),
        avg(neighbour_similarity) FILTER (is_junk) - avg(neighbour_similarity) FILTER (NOT is_junk)]) AS g FROM comb)""", **FULL, comb=COMB),
    r6="importance",
)
def junk_feature_importance(spark, d):
    rows = sh.combined_scores(cn.sheets(spark, d)).withColumn("keyword_hits", F.col("keyword_hits") + F.col("pattern_hits"))
    return sh.feature_importance(rows, ["null_share", "keyword_hits", "neighbour_similarity"])


# --- headers -----------------------------------------------------------------------------

_fp = f"""CASE WHEN length(v) BETWEEN 2 AND 50 THEN 3 ELSE 0 END + CASE WHEN contains(v, '_') OR regexp_matches(substr(v, 2), '\\p{{Lu}}') THEN 2 ELSE 0 END
  + CASE WHEN NOT regexp_matches(regexp_replace(v, '[./-]', '', 'g'), '^[0-9]+$') THEN 2 ELSE 0 END + CASE WHEN {_rx('lower(v)', sh.words_pattern(sh.HEADER_WORDS))} THEN 3 ELSE 0 END"""
CAND = f"""SELECT file_id, row_idx, cells, non_null AS field_count, descriptor, alignment, structure, position, junk_penalty,
  descriptor * 0.3::DOUBLE + alignment * 0.3::DOUBLE + structure * 0.2::DOUBLE + position * 0.1::DOUBLE + (1 - junk_penalty) * 0.1::DOUBLE AS confidence FROM (
  SELECT *, CASE WHEN n9 IS NULL THEN 0.5 WHEN abs(non_null - n9) <= 2 THEN 1 WHEN abs(non_null - n9) <= 4 THEN 0.7 ELSE 0.3 END::DOUBLE AS structure,
    CASE WHEN row_idx * 10 <= n_rows THEN 0.7 WHEN row_idx * 5 <= n_rows THEN 0.9 WHEN row_idx * 2 <= n_rows THEN 0.6 WHEN row_idx * 5 <= n_rows * 4 THEN 0.3 ELSE 0.1 END::DOUBLE AS position,
    least(1.0, CASE WHEN {_any('low', sh.HEADER_STRONG_JUNK)} THEN 0.8 ELSE 0 END + CASE WHEN {_sum_contains('low', sh.HEADER_METADATA)} >= 2 THEN 0.4 ELSE 0 END)::DOUBLE AS junk_penalty FROM (
    SELECT *, coalesce(list_sum(list_transform(filled, lambda v: {_fp})), 0) / 10.0::DOUBLE / greatest(non_null, 1) AS descriptor,
      coalesce(least(1.0, sum(li) OVER (PARTITION BY file_id ORDER BY row_idx ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) / nullif(count(*) OVER (PARTITION BY file_id ORDER BY row_idx ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING), 0)), 0)::DOUBLE AS alignment,
      avg(non_null) OVER (PARTITION BY file_id ORDER BY row_idx ROWS BETWEEN 1 FOLLOWING AND 9 FOLLOWING) AS n9 FROM (
      SELECT *, CASE WHEN non_null >= 2 THEN 1 + CASE WHEN {_exists(_dig('v'))} = 1 AND {_exists('NOT ' + _dig('v'))} = 1 THEN 0.5::DOUBLE ELSE 0 END ELSE 0 END AS li FROM feat JOIN stats USING (file_id))))
  WHERE row_idx < floor(n_rows * 0.8::DOUBLE) AND non_null >= 2"""
HDR = dict(feat=FEAT, stats=STATS, cand=CAND)


@query(
    "W6 W7 W8 K7 T6",
    duck("sheets", "SELECT file_id, row_idx, field_count, descriptor, alignment, structure, position, junk_penalty, confidence FROM cand", **HDR),
    r6="descriptor alignment structure position junk_penalty confidence",
)
def header_candidates(spark, d):
    return sh.header_candidates(cn.sheets(spark, d), cells=False).select(
        "file_id", "row_idx", F.col("field_count").cast("long").alias("field_count"), "descriptor", "alignment", "structure", "position", "junk_penalty", "confidence"
    )


BEST = """SELECT file_id, row_idx AS header_row, confidence, confidence >= 0.6 AS confident, count(*) OVER (PARTITION BY file_id) AS candidates,
  list_transform(cells, lambda v, i: CASE WHEN trim(v) <> '' THEN trim(v) ELSE 'Column_' || i END) AS column_names FROM cand
  QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY round(confidence, 9) DESC, row_idx) = 1"""


@query(
    "T2 K7",
    duck("sheets", "SELECT file_id, header_row, confidence, confident, candidates, array_to_string(column_names, '|') AS column_names FROM best", **HDR, best=BEST),
    r6="confidence",
)
def detected_headers(spark, d):
    found = sh.header_candidates(cn.sheets(spark, d), cells=False)
    return sh.best_headers(found, texts=cn.sheet_texts(spark, d)).withColumn("column_names", F.array_join("column_names", "|"))


@query(
    "P16",
    duck("sheets", """SELECT file_id, count(*) AS cells, count(DISTINCT row_idx) AS rows, count(DISTINCT column_name) AS names, count(*) FILTER (starts_with(column_name, 'Column_')) AS unnamed FROM (
      SELECT s.file_id, row_idx, unnest(list_transform(cells, lambda v, i: coalesce(column_names[i], 'Column_' || i))) AS column_name
      FROM sheets s LEFT JOIN best b ON s.file_id = b.file_id WHERE row_idx > coalesce(header_row, -1)) GROUP BY 1""", **HDR, best=BEST),
)
def promoted_header_rows(spark, d):
    rows = cn.sheets(spark, d)
    headers = cut_lineage(sh.best_headers(sh.header_candidates(rows, cells=False), texts=cn.sheet_texts(spark, d)), "headers")
    return sh.count_promoted(rows, headers)


# --- row text and vectors --------------------------------------------------------------------

_jw = " + ".join(f"0.3::DOUBLE * CAST(contains(lower(v), '{w}') AS INT)" for w in sh.TEXT_JUNK_WORDS)
_jp = " + ".join(f"CASE WHEN {_rx('lower(v)', p)} THEN {w}::DOUBLE ELSE 0 END" for p, w in sh.TEXT_JUNK_PATTERNS)


@query(
    "K8",
    duck("sheets", f"""SELECT file_id, row_idx, CASE WHEN len(parts) = 0 THEN '[EMPTY_ROW]' ELSE CASE WHEN junk THEN '[CONTAINS_JUNK] ' ELSE '' END
      || CASE WHEN late THEN '[FOOTER_AREA] ' WHEN row_idx * 5 < n_rows THEN '[HEADER_AREA] ' ELSE '' END || array_to_string(parts, ' | ') END AS row_text FROM (
      SELECT *, len(list_filter(cells, lambda v: trim(v) <> '' AND least(1.0, ({_jw} + {_jp}) * CASE WHEN late THEN 1.5 ELSE 1 END) > 0.5)) > 0 AS junk,
        list_filter(list_transform(cells, lambda v, i: CASE WHEN trim(v) <> '' THEN 'Column_' || i || ': ' || trim(v) END), lambda x: x IS NOT NULL) AS parts
      FROM (SELECT *, row_idx * 5 > n_rows * 4 AS late FROM sheets JOIN (SELECT file_id, count(*) AS n_rows FROM sheets GROUP BY 1) USING (file_id)))"""),
)
def sheet_row_text(spark, d):
    return sh.row_text(sh.with_sheet_stats(cn.sheets(spark, d))).select("file_id", "row_idx", "row_text")


DIM = 64
_unit = """SELECT vec_id, label, embedding::DOUBLE[] AS e, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE)))) AS u FROM embeddings"""


@query(
    "J22 K9",
    duck("", """SELECT vec_id, outlier_score, greatest(0, least(1, (outlier_score - m) / (s + 1e-8))) AS confidence, outlier_score > m + 1.5 * s AS semantic_junk FROM (
      SELECT *, avg(outlier_score) OVER () AS m, stddev_pop(outlier_score) OVER () AS s FROM (
        SELECT a.vec_id, 1 - (sum(list_dot_product(a.u, b.u)) - 1) / (count(*) - 1) AS outlier_score FROM unit a, unit b GROUP BY 1))""", unit=_unit),
    r6="outlier_score confidence",
)
def embedding_outliers(spark, d):
    e = cn.table(spark, d, "embeddings")
    return sh.embedding_outliers(e, "embedding", DIM, []).select("vec_id", "outlier_score", "confidence", "semantic_junk")


@query(
    "K10",
    duck("", """SELECT vec_id, label, distance, least(distance / 2, 1) AS outlier_score FROM (
      SELECT vec_id, label, sqrt(sum((x - c) ** 2)) AS distance FROM (SELECT vec_id, label, x, avg(x) OVER (PARTITION BY label, i) AS c FROM (
        SELECT vec_id, label, unnest(e) AS x, unnest(range(64)) AS i FROM unit)) GROUP BY ALL)""", unit=_unit),
    r6="distance outlier_score",
)
def embedding_centre_distance(spark, d):
    e = cn.table(spark, d, "embeddings")
    return sh.centre_distance(e, "embedding", "label", DIM).select("vec_id", "label", "distance", "outlier_score")


# --- hybrid ------------------------------------------------------------------------------------

_dims = ["non_null / width::DOUBLE", "ln(1 + text_length) / 10", "numeric_count / greatest(non_null, 1)::DOUBLE", "date_count / greatest(non_null, 1)::DOUBLE",
         "specials / greatest(text_length, 1)::DOUBLE", "caps_ratio", "space_ratio", "consistency"]
SEM = f"""SELECT *, CASE WHEN (row_idx < 3 OR row_idx >= n_rows - 3) AND semantic_junk THEN least(1, c1 + 0.2::DOUBLE) ELSE c1 END AS confidence FROM (
  SELECT *, CASE WHEN non_null = 0 THEN 1 WHEN non_null = 1 THEN least(1, c0 + 0.3::DOUBLE) ELSE c0 END AS c1 FROM (
    SELECT *, coalesce(outlier_score > m + 1.5 * s, false) AS semantic_junk, greatest(0, least(1, (outlier_score - m) / (s + 1e-8))) AS c0 FROM (
      SELECT *, avg(outlier_score) OVER (PARTITION BY file_id) AS m, stddev_pop(outlier_score) OVER (PARTITION BY file_id) AS s FROM (
        SELECT *, 1 - ({' + '.join(f'u[{i + 1}] * sum(u[{i + 1}]) OVER (PARTITION BY file_id)' for i in range(8))} - 1) / nullif(count(u[1]) OVER (PARTITION BY file_id) - 1, 0) AS outlier_score FROM (
          SELECT *, list_transform(v, lambda x: x / nullif(sqrt(list_sum(list_transform(v, lambda y: y * y))), 0)) AS u FROM (SELECT *, [{', '.join(f'({x})::DOUBLE' for x in _dims)}] AS v FROM comb))))))"""
HYB = """SELECT *, semantic_junk OR is_junk_s OR hybrid_score > hybrid_threshold AS is_junk FROM (SELECT *, greatest(0.2::DOUBLE, least(0.6::DOUBLE, avg(hybrid_score) OVER (PARTITION BY file_id) + 0.8::DOUBLE * stddev_pop(hybrid_score) OVER (PARTITION BY file_id))) AS hybrid_threshold
  FROM (SELECT * EXCLUDE (is_junk, confidence), is_junk AS is_junk_s, coalesce(confidence, 0) AS confidence, coalesce(confidence, 0) * 0.4::DOUBLE + statistical_score * 0.4::DOUBLE AS hybrid_score FROM sem))"""
ALL = dict(**FULL, comb=COMB, sem=SEM, hyb=HYB)


@query(
    "K11 K12 U3",
    duck("sheets", "SELECT file_id, row_idx, confidence, semantic_junk, is_junk_s AS statistical_junk, hybrid_score, hybrid_threshold, is_junk FROM hyb", **ALL),
    r6="confidence hybrid_score hybrid_threshold",
)
def hybrid_junk_rows(spark, d):
    return sh.hybrid_scores(cn.sheets(spark, d)).select(
        "file_id", "row_idx", "confidence", "semantic_junk", "statistical_junk", "hybrid_score", "hybrid_threshold", "is_junk"
    )


@query("K13", duck("sheets", f"SELECT file_id, row_idx FROM sheets WHERE trim(line) = '' OR {_any('lower(line)', sh.FALLBACK_WORDS)}"))
def fallback_junk_rows(spark, d):
    return sh.fallback_junk(cn.sheets(spark, d)).where("is_junk").select("file_id", "row_idx")


@query(
    "K14",
    duck("sheets", """SELECT file_id, row_idx, array_to_string(list_filter([CASE WHEN outlier_score > 0.8 THEN 'outlying_vector' WHEN outlier_score IS NULL THEN 'no_cluster' END,
      CASE WHEN non_null = 0 THEN 'no_cells' WHEN non_null <= 2 THEN 'few_cells' END,
      CASE WHEN row_idx < 3 THEN 'top_of_sheet' WHEN row_idx >= n_rows - 3 THEN 'end_of_sheet' END], lambda x: x IS NOT NULL), '; ') AS reasons
      FROM hyb WHERE is_junk""", **ALL),
)
def junk_row_explanations(spark, d):
    return sh.explain(sh.hybrid_scores(cn.sheets(spark, d))).select("file_id", "row_idx", F.array_join("reasons", "; ").alias("reasons"))


_truth = f"trim(line) = '' OR {_any('lower(line)', sh.FALLBACK_WORDS)}"
_qual = """CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::DOUBLE ELSE 0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn)::DOUBLE ELSE 0 END AS recall, CASE WHEN tp > 0 THEN 2 * tp / (2 * tp + fp + fn)::DOUBLE ELSE 0 END AS f1"""


@query(
    "A31 J23 U5",
    duck("sheets", f"""SELECT *, {_qual} FROM (SELECT count(*) FILTER (is_junk AND t) AS tp, count(*) FILTER (is_junk AND NOT t) AS fp, count(*) FILTER (NOT is_junk AND t) AS fn FROM (SELECT *, {_truth} AS t FROM comb))""", **FULL, comb=COMB),
    r6="precision recall f1",
)
def junk_detection_quality(spark, d):
    rows = sh.combined_scores(cn.sheets(spark, d).withColumn("rules", sh.rule_junk()))
    return sh.sweep(rows, {"statistical": F.coalesce("is_junk", F.lit(False))}, F.col("rules")).drop("candidate")


_mult = [round(1.0 + 0.2 * i, 1) for i in range(15)]


@query(
    "K15",
    duck("sheets", f"""SELECT *, {_qual} FROM (SELECT printf('%.1f', k) AS candidate, count(*) FILTER (p AND t) AS tp, count(*) FILTER (p AND NOT t) AS fp, count(*) FILTER (NOT p AND t) AS fn FROM (
      SELECT k, t, round(content_score - (m + k * s), 9) > 0 AS p FROM (SELECT content_score, {_truth} AS t, avg(content_score) OVER (PARTITION BY file_id) AS m, stddev_pop(content_score) OVER (PARTITION BY file_id) AS s FROM content),
      (SELECT unnest([{', '.join(f'{m}::DOUBLE' for m in _mult)}]) AS k)) GROUP BY 1)""", **BASE),
    r6="precision recall f1",
)
def junk_threshold_sweep(spark, d):
    rows = sh.content_scores(cn.sheets(spark, d).withColumn("truth", sh.rule_junk()))
    return sh.threshold_sweep(rows.select("file_id", "content_score", "truth"), "content_score", "truth")


_ws = [(a, b) for a in (0.2, 0.3, 0.4, 0.5, 0.6) for b in (0.2, 0.3, 0.4, 0.5, 0.6) if round(a + b, 6) <= 1.0]


@query(
    "K15 T5",
    duck("sheets", f"""SELECT *, {_qual} FROM (SELECT printf('%.1f/%.1f', a, b) AS candidate, count(*) FILTER (p AND t) AS tp, count(*) FILTER (p AND NOT t) AS fp, count(*) FILTER (NOT p AND t) AS fn FROM (
      SELECT a, b, t, a * confidence + b * statistical_score > greatest(0.2::DOUBLE, least(0.6::DOUBLE, a * mc + b * ms + 0.8::DOUBLE * sqrt(greatest(0, a * a * vc + b * b * vs + 2 * a * b * cv)))) AS p
      FROM (SELECT *, {_truth} AS t FROM hyb JOIN (SELECT file_id, avg(confidence) AS mc, avg(statistical_score) AS ms, var_pop(confidence) AS vc, var_pop(statistical_score) AS vs, covar_pop(confidence, statistical_score) AS cv FROM hyb GROUP BY 1) USING (file_id)),
      (VALUES {', '.join(f'({a}::DOUBLE, {b}::DOUBLE)' for a, b in _ws)}) w(a, b)) GROUP BY 1)""", **ALL),
    r6="precision recall f1",
)
def hybrid_weight_sweep(spark, d):
    scored = sh.hybrid_scores(cn.sheets(spark, d).withColumn("truth", sh.rule_junk()))
    rows = cut_lineage(scored.select("file_id", "truth", "confidence", "statistical_score"), "sheet-layers")
    # Mean and deviation of any weighting follow from the moments of the two layers.
    m = rows.groupBy("file_id").agg(
        F.avg("confidence").alias("mc"), F.avg("statistical_score").alias("ms"), F.var_pop("confidence").alias("vc"),
        F.var_pop("statistical_score").alias("vs"), F.covar_pop("confidence", "statistical_score").alias("cv"),
    )
    rows = sh.attach(rows, m, "file_id")
    c = F.col
    flags = {}
    for a, b in _ws:
        sd = F.sqrt(F.greatest(F.lit(0.0), a * a * c("vc") + b * b * c("vs") + 2 * a * b * c("cv")))
        flags[f"{a:.1f}/{b:.1f}"] = a * c("confidence") + b * c("statistical_score") > sh.clip(a * c("mc") + b * c("ms") + 0.8 * sd, 0.2, 0.6)
    return sh.sweep(rows, flags, F.col("truth"))


# --- against known labels ----------------------------------------------------------------------

_LABELLED = dict(landed_sheets=VIEWS["sheets"], sheets=VIEWS["labelled_sheets"])
_pr = "tp / (tp + fp)::DOUBLE AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn)::DOUBLE ELSE 0 END AS recall, 2 * tp / (2 * tp + fp + fn)::DOUBLE AS f1"


def _cuts_sql(by: str, source: str) -> str:
    over = f"PARTITION BY {by} " if by else ""
    key = f"{by}, " if by else ""
    return f"""SELECT {key}threshold, rows, tp, fp, fn, precision, recall, f1 FROM (SELECT *, row_number() OVER ({over}ORDER BY f1 DESC, threshold DESC) AS best FROM (SELECT *, {_pr} FROM (
      SELECT {key}threshold, rows, CAST(cp AS BIGINT) AS tp, CAST(cn - cp AS BIGINT) AS fp, CAST(truth - cp AS BIGINT) AS fn FROM (
        SELECT {key}threshold, CAST(sum(n) OVER ({over}) AS BIGINT) AS rows, sum(p) OVER ({over}) AS truth, sum(n) OVER ({over}ORDER BY threshold DESC) AS cn, sum(p) OVER ({over}ORDER BY threshold DESC) AS cp
        FROM (SELECT {key}threshold, count(*) AS n, count(*) FILTER (labelled) AS p FROM ({source}) GROUP BY ALL))))) WHERE best = 1"""


@query(
    "K15 T5",
    duck("", _cuts_sql("file_id", "SELECT file_id, round(content_score, 6) AS threshold, labelled FROM content"), **_LABELLED, **BASE),
    r6="threshold precision recall f1",
)
def best_content_cuts(spark, d):
    """For every labelled sheet the cut of the content score with the highest F1, out of all scores that occur in it."""
    rows = sh.content_scores(cn.labelled_sheets(spark, d))
    return sh.best_cuts(rows.withColumn("content_score", F.round("content_score", 6)), ["file_id"], "content_score", "labelled")


@query(
    "K15 T5 J23",
    duck("", f"""SELECT a AS semantic_weight, b AS statistical_weight, tp, fp, fn, precision, recall, f1 FROM (SELECT *, {_qual} FROM (
      SELECT a, b, count(*) FILTER (p AND labelled) AS tp, count(*) FILTER (p AND NOT labelled) AS fp, count(*) FILTER (NOT p AND labelled) AS fn FROM (
      SELECT a, b, labelled, round(a * confidence + b * statistical_score - greatest(0.2::DOUBLE, least(0.6::DOUBLE, a * mc + b * ms + 0.8::DOUBLE * sqrt(greatest(0, a * a * vc + b * b * vs + 2 * a * b * cv)))), 9) > 0 AS p
      FROM (SELECT * FROM hyb JOIN (SELECT file_id, avg(confidence) AS mc, avg(statistical_score) AS ms, var_pop(confidence) AS vc, var_pop(statistical_score) AS vs, covar_pop(confidence, statistical_score) AS cv FROM hyb GROUP BY 1) USING (file_id)),
      (VALUES {', '.join(f'({a}::DOUBLE, {b}::DOUBLE)' for a, b in _ws)}) w(a, b)) GROUP BY 1, 2)) ORDER BY round(f1, 9) DESC, a, b LIMIT 1""", **_LABELLED, **ALL),
    r6="precision recall f1",
)
def best_hybrid_weights(spark, d):
    """The weights of the two layers with the highest F1 over all labelled sheets; of equal ones the smallest."""
    scored = sh.hybrid_scores(cn.labelled_sheets(spark, d))
    rows = cut_lineage(scored.select("file_id", "labelled", "confidence", "statistical_score"), "sheet-layers")
    m = rows.groupBy("file_id").agg(
        F.avg("confidence").alias("mc"), F.avg("statistical_score").alias("ms"), F.var_pop("confidence").alias("vc"),
        F.var_pop("statistical_score").alias("vs"), F.covar_pop("confidence", "statistical_score").alias("cv"),
    )
    rows, c = sh.attach(rows, m, "file_id"), F.col
    flags = {}
    for a, b in _ws:
        sd = F.sqrt(F.greatest(F.lit(0.0), a * a * c("vc") + b * b * c("vs") + 2 * a * b * c("cv")))
        flags[f"{a:.1f}/{b:.1f}"] = F.round(a * c("confidence") + b * c("statistical_score") - sh.clip(a * c("mc") + b * c("ms") + 0.8 * sd, 0.2, 0.6), 9) > 0
    tried = sh.sweep(rows, flags, F.col("labelled"))
    weight = lambda i: F.split_part("candidate", F.lit("/"), F.lit(i)).cast("double")
    best = tried.withColumns({"semantic_weight": weight(1), "statistical_weight": weight(2)})
    names = ["semantic_weight", "statistical_weight", "tp", "fp", "fn", "precision", "recall", "f1"]
    return best.agg(F.max_by(F.struct(*names), F.struct(F.round("f1", 9).alias("f"), (-weight(1)).alias("a"), (-weight(2)).alias("b"))).alias("x")).select("x.*")


@query(
    "A31 J23 U5",
    duck("", f"""SELECT layer, tp, fp, fn, {_qual} FROM (
      SELECT layer, count(*) FILTER (p AND labelled) AS tp, count(*) FILTER (p AND NOT labelled) AS fp, count(*) FILTER (NOT p AND labelled) AS fn FROM (
      SELECT labelled, unnest(['hybrid', 'rules', 'semantic', 'statistical']) AS layer, unnest([is_junk, {_truth}, semantic_junk, is_junk_s]) AS p FROM hyb) GROUP BY 1)""", **_LABELLED, **ALL),
    r6="precision recall f1",
)
def labelled_junk_quality(spark, d):
    """Precision, recall and F1 of each layer against the labels, from one scan of the scored rows."""
    rows = sh.hybrid_scores(cn.labelled_sheets(spark, d).withColumn("rules", sh.rule_junk()))
    flags = {"hybrid": F.col("is_junk"), "rules": F.col("rules"), "semantic": F.col("semantic_junk"), "statistical": F.col("statistical_junk")}
    return sh.sweep(rows, flags, F.col("labelled")).withColumnRenamed("candidate", "layer")


@query(
    "K14",
    duck("", """SELECT file_id, row_idx, labelled, array_to_string(list_filter([CASE WHEN outlier_score > 0.8 THEN 'outlying_vector' WHEN outlier_score IS NULL THEN 'no_cluster' END,
      CASE WHEN non_null = 0 THEN 'no_cells' WHEN non_null <= 2 THEN 'few_cells' END,
      CASE WHEN row_idx < 3 THEN 'top_of_sheet' WHEN row_idx >= n_rows - 3 THEN 'end_of_sheet' END], lambda x: x IS NOT NULL), '; ') AS reasons,
      content_score, proximity_score, statistical_score, hybrid_score FROM hyb WHERE is_junk""", **_LABELLED, **ALL),
    r6="content_score proximity_score statistical_score hybrid_score",
)
def scored_junk_explanations(spark, d):
    """Why a row of a labelled sheet is flagged, with the scores of the layers."""
    out = sh.explain(sh.hybrid_scores(cn.labelled_sheets(spark, d)))
    return out.select("file_id", "row_idx", "labelled", F.array_join("reasons", "; ").alias("reasons"), "content_score", "proximity_score", "statistical_score", "hybrid_score")


# --- row filters ---------------------------------------------------------------------------------

_low = "lower(text)"


@query(
    "P17",
    f"""SELECT conv_id, turn, 'summary' AS found FROM conversations WHERE {_any(_low, ['total', 'sum', 'summary', 'subtotal', 'grand'])}
      UNION ALL SELECT conv_id, turn, 'header' FROM conversations WHERE {_any(_low, sh.INSURANCE_TERMS)}
      UNION ALL SELECT conv_id, turn, 'footer' FROM conversations WHERE {_any(_low, ['generated', 'report', 'end', 'footer'])}
      UNION ALL SELECT conv_id, turn, 'empty' FROM conversations WHERE length(trim(lower(text))) < 10""",
)
def rows_by_description(spark, d):
    m = cn.table(spark, d, "conversations")
    parts = [sh.rows_by_description(m, "text", k).select("conv_id", "turn", F.lit(k).alias("found")) for k in ("summary", "header", "footer", "empty")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


_kind = f"""CASE WHEN {_any(_low, sh.INSURANCE_TERMS)} THEN 'headers' WHEN {_any(_low, ['total', 'sum', 'summary', 'count', 'subtotal'])} THEN 'summaries'
  WHEN {_any(_low, ['generated', 'report', 'exported', 'created', 'system'])} THEN 'metadata' WHEN length(trim(lower(text))) < 5 THEN 'empty' ELSE 'unknown' END"""


@query("P18", f"SELECT role, {_kind} AS kind, count(*) AS rows FROM conversations GROUP BY ALL")
def removed_row_kinds(spark, d):
    m = cn.table(spark, d, "conversations")
    return m.groupBy("role", sh.removed_row_kind(F.col("text")).alias("kind")).agg(F.count(F.lit(1)).alias("rows"))


@query(
    "P19 U1",
    duck("sheets", f"SELECT file_id, count(*) AS rows FROM sheets WHERE NOT ({_truth}) OR row_idx = 0 GROUP BY 1"),
)
def restored_sheet_rows(spark, d):
    rows = cn.sheets(spark, d)
    flagged = sh.fallback_junk(rows).where("is_junk")
    back = sh.restore_rows(sh.keep_rows(rows, flagged), rows, flagged.where("row_idx = 0"))
    return back.groupBy("file_id").agg(F.count(F.lit(1)).alias("rows"))
