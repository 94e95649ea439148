"""The same queries as SQL for DuckDB over the test tables."""

import re

from epistrand.schemas import HORIZON_YEARS, LABEL_OF_GROUP
from verification import io
from verification.queries import ATTRIBUTED, CLASSIFIER_TOKENS, FLAGGED, MAX_AGE, SEED, SEGMENT, TOKENS
from verification.views import THRESHOLDS, VIEWS


def _list(values):
    return ", ".join(f"'{v}'" for v in values)


def _edges():
    """One row per test and bin edge, with the place of the test in the list."""
    rows = [f"({i}, '{name}', {float(e)})" for i, (name, edges) in enumerate(THRESHOLDS.items()) for e in edges]
    return f"SELECT ord, test, CAST(edge AS DOUBLE) AS edge FROM (VALUES {', '.join(rows)}) AS v(ord, test, edge)"


def _label_case(column="AIM_GROUP"):
    return f"CASE {column} " + " ".join(f"WHEN '{g}' THEN {n}" for g, n in LABEL_OF_GROUP.items()) + " END"


def _key(column="patid"):
    return f"md5(concat({column}, ':{SEED}'))"


def _sequences(source, keys):
    """Separators are rows of their own, so that one ordered list makes a sequence."""
    return f"""
SELECT {keys}, list(token ORDER BY DATE, closing, token) AS code, list(AGE ORDER BY DATE, closing, token) AS age FROM (
  SELECT {keys}, DATE, 0 AS closing, CODE AS token, AGE FROM {source}
  UNION ALL SELECT DISTINCT {keys}, DATE, 1, 'SEP', AGE FROM {source}) GROUP BY {keys}"""


def _segments(column):
    return f"array_to_string({column}[start + 1 : start + {SEGMENT}], '|') AS {column}"


def _grid(source, length, keys="patid"):
    """Every position of every sequence: token, age, whether real, and visit index."""
    names = [k.strip() for k in keys.split(",")]
    by = ", ".join(f"p.{k}" for k in names)
    same = " AND ".join(f"t.{k} = p.{k}" for k in [*names, "pos"])
    return f"""
SELECT {by}, p.pos, t.code, t.age, t.code IS NOT NULL AS is_real,
  CAST(coalesce(sum(CASE WHEN t.code = 'SEP' THEN 1 ELSE 0 END) OVER (PARTITION BY {by} ORDER BY p.pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INT) AS position
FROM (SELECT {keys}, unnest(range({length})) AS pos FROM {source}) p
LEFT JOIN (SELECT {keys}, generate_subscripts(code, 1) - 1 AS pos, unnest(code) AS code, unnest(age) AS age FROM {source}) t
  ON {same}"""


def _joined(column, alias=None, order="pos"):
    return f"string_agg(CAST({column} AS VARCHAR), ',' ORDER BY {order}) AS {alias or column}"


def _uniform(*parts):
    inner = " || ':' || ".join(parts)
    return f"CAST(CAST('0x' || substr(md5({inner}), 1, 8) AS UBIGINT) AS BIGINT)"


_POS = "CAST(pos AS VARCHAR)"
_U = f"({_uniform('patid', _POS, repr(str(SEED)))} / 4294967296.0)"
_ANY = f"({_uniform('patid', _POS, repr(str(SEED)), repr('id'))} % (SELECT count(*) FROM vocab))"
_MASKED = f"""CASE WHEN {_U} >= 0.15 THEN code_id WHEN {_U} / 0.15 < 0.8 THEN 4 WHEN {_U} / 0.15 < 0.9 THEN {_ANY} ELSE code_id END"""
_LABEL = f"CASE WHEN {_U} < 0.15 THEN code_id ELSE -1 END"

_SPECIAL = "(VALUES ('PAD', 0), ('UNK', 1), ('CLS', 2), ('SEP', 3), ('MASK', 4)) AS s(token, idx)"


def _vocab(source, column):
    return f"""
SELECT token, idx FROM {_SPECIAL}
UNION ALL SELECT token, CAST(4 + row_number() OVER (ORDER BY token) AS INT) AS idx
FROM (SELECT DISTINCT unnest({column}) AS token FROM {source}) d WHERE token NOT IN ('PAD', 'UNK', 'CLS', 'SEP', 'MASK')"""


def _cls(source, length, extra=""):
    return f"""
SELECT patid{extra}, CASE WHEN c[1] = 'SEP' THEN ['CLS'] || c[2:] ELSE ['CLS'] || c END AS code,
  CASE WHEN c[1] = 'SEP' THEN a ELSE a[1:1] || a END AS age
FROM (SELECT patid{extra}, code[greatest(len(code) - {length - 2}, 1):] AS c, age[greatest(len(code) - {length - 2}, 1):] AS a FROM {source})"""


def _auc(source, group):
    return f"""
SELECT {group}, sum(CASE WHEN label = 1 THEN r + (ties - 1) / 2.0 ELSE 0 END) AS ranks, count(*) AS n_patients,
  CAST(sum(label) AS BIGINT) AS n_cases, CAST(count(*) - sum(label) AS BIGINT) AS n_controls
FROM (SELECT {group}, label, rank() OVER (PARTITION BY {group} ORDER BY prob) AS r,
        count(*) OVER (PARTITION BY {group}, prob) AS ties FROM {source}) GROUP BY {group}"""


_AUC_VALUE = "(ranks - n_cases * (n_cases + 1) / 2.0) / (n_cases * n_controls)"

CTES = {
    **{name: text.strip() for name, text in VIEWS.items()},
    "records": """
SELECT PATIENT_ID, Shifted_date, LAB_NAME AS written, '' AS ending, RESULT AS said FROM deid_lab_out
UNION ALL BY NAME SELECT PATIENT_ID, Shifted_date, 'VITAL_' || split_part(VITAL_CODE, ':', 2) AS written, '_MEAN' AS ending, MEASUREMENT AS said FROM deid_vital""",
    "measurements": """
SELECT PATIENT_ID, Shifted_date AS DATE, concat(regexp_replace(written, '^ +| +$', '', 'g'), ending) AS TEST_NAME,
  CASE WHEN regexp_full_match(said, '[+-]?[0-9]+([.][0-9]+)?') THEN CAST(said AS DOUBLE) END AS TEST_VALUE FROM records""",
    "edges": _edges(),
    "name_codes": """
SELECT regexp_replace(SUNQUEST_NAME, '^ +| +$', '', 'g') AS name, list_sort(list(DISTINCT LOINC_CODE)) AS loincs
FROM dpi_lab_map WHERE LOINC_CODE IS NOT NULL GROUP BY 1""",
    "tests": "SELECT DISTINCT ord, test FROM edges",
    "canonical": "SELECT n.*, t.ord FROM name_codes n JOIN tests t ON t.test = n.name",
    "candidates": """
SELECT n.name AS synonym, c.name AS canonical, c.ord, n.loincs FROM name_codes n
JOIN canonical c ON len(c.loincs) = 1 AND list_contains(n.loincs, c.loincs[1]) AND n.name <> c.name""",
    "synonyms": "SELECT synonym, arg_max(canonical, ord) AS canonical FROM candidates WHERE len(loincs) = 1 GROUP BY synonym",
    "named": """
SELECT m.PATIENT_ID, m.DATE, coalesce(s.canonical, m.TEST_NAME) AS TEST_NAME, m.TEST_VALUE
FROM measurements m LEFT JOIN synonyms s ON s.synonym = m.TEST_NAME WHERE m.TEST_VALUE IS NOT NULL""",
    "known": "SELECT * FROM named WHERE TEST_NAME IN (SELECT test FROM tests)",
    "bins": """
SELECT v.TEST_NAME, v.TEST_VALUE, 1 + count(*) FILTER (e.edge <= v.TEST_VALUE) AS bin
FROM (SELECT DISTINCT TEST_NAME, TEST_VALUE FROM known) v JOIN edges e ON e.test = v.TEST_NAME GROUP BY ALL""",
    "binned": "SELECT k.*, concat('BIN_', b.bin) AS BINNED_VALUE FROM known k JOIN bins b USING (TEST_NAME, TEST_VALUE)",
    "lab_events": "SELECT PATIENT_ID, DATE, concat_ws('_', 'LAB:' || TEST_NAME, BINNED_VALUE) AS CODE FROM binned",
    "dx_events": "SELECT PATIENT_ID, Shifted_date AS DATE, concat('DX:', DX) AS CODE FROM deid_visit_dx",
    "universal": "FROM dx_events UNION ALL BY NAME FROM lab_events",
    "index_dates": "SELECT PATIENT_ID, min(EARLIEST_DX) AS Index_Date FROM earliest_dx_deid GROUP BY PATIENT_ID",
    "censored": """
FROM universal u SELECT u.PATIENT_ID, u.DATE, u.CODE
WHERE NOT EXISTS (FROM index_dates i WHERE i.PATIENT_ID = u.PATIENT_ID AND i.Index_Date <= u.DATE)""",
    "last_visit": "SELECT PATIENT_ID, max(DATE) AS LAST_VISIT_DATE FROM censored GROUP BY PATIENT_ID",
    "births": """
SELECT l.PATIENT_ID, CAST(year(l.LAST_VISIT_DATE) - d.AGE_AT_END AS INT) AS YOB FROM last_visit l JOIN deid_dem d ON l.PATIENT_ID = d.PATIENT_ID""",
    "aged": """
SELECT e.PATIENT_ID, e.DATE, e.CODE, CAST(greatest(year(e.DATE) - b.YOB, 0) AS VARCHAR) AS AGE FROM censored e JOIN births b ON e.PATIENT_ID = b.PATIENT_ID""",
    "seqs_by_id": _sequences("aged", "PATIENT_ID"),
    "seqs": "SELECT PATIENT_ID AS patid, code, age FROM seqs_by_id",
    "raw_labels": f"SELECT DISTINCT PATIENT_ID, {_label_case()} AS label FROM deid_visit_dx",
    "cohort": """
SELECT s.patid, max(l.label) AS label FROM seqs s JOIN raw_labels l ON s.patid = l.PATIENT_ID
WHERE l.label IS NOT NULL AND len(s.code) >= 2 GROUP BY s.patid HAVING min(l.label) = max(l.label)""",
    "ranked": f"""
SELECT patid, label, row_number() OVER (PARTITION BY label ORDER BY {_key()}, patid) AS r FROM cohort""",
    "quotas": """
SELECT label, whole + CAST(row_number() OVER (ORDER BY share - whole DESC, label)
    <= ceil(0.2::DOUBLE * sum(n) OVER ()) - sum(whole) OVER () AS INT) AS quota
FROM (SELECT label, count(*) AS n, 0.2::DOUBLE * count(*) AS share, floor(0.2::DOUBLE * count(*)) AS whole FROM cohort GROUP BY label)""",
    "split": "SELECT patid, label, CASE WHEN r <= quota THEN 'test' ELSE 'train' END AS split FROM ranked JOIN quotas USING (label)",
    "test_ids": "SELECT patid, label FROM split WHERE split = 'test'",
    "test_events": "SELECT * FROM censored WHERE PATIENT_ID IN (SELECT patid FROM test_ids)",
    "refs": """
SELECT t.patid AS PATIENT_ID, CAST(f.PATIENT_ID IS NOT NULL AS INT) AS is_case,
  CASE WHEN f.PATIENT_ID IS NOT NULL THEN f.Index_Date ELSE v.LAST_VISIT_DATE END AS REF_DATE
FROM test_ids t LEFT JOIN index_dates f ON f.PATIENT_ID = t.patid LEFT JOIN last_visit v ON v.PATIENT_ID = t.patid""",
    # One unnest instead of a join with the years: DuckDB sometimes fails on that join (dictionary caching).
    "horizon_events": f"""
SELECT years, PATIENT_ID, DATE, CODE FROM (
  SELECT unnest({HORIZON_YEARS}) AS years, e.PATIENT_ID, e.DATE, e.CODE, r.REF_DATE FROM test_events e JOIN refs r ON r.PATIENT_ID = e.PATIENT_ID)
WHERE DATE < CAST(REF_DATE - to_years(CAST(years AS INT)) AS DATE)""",
    "horizon_aged": """
SELECT h.*, CAST(greatest(year(h.DATE) - b.YOB, 0) AS VARCHAR) AS AGE FROM horizon_events h JOIN births b ON b.PATIENT_ID = h.PATIENT_ID""",
    "horizon_seqs": _sequences("horizon_aged", "years, PATIENT_ID"),
    "horizons": """
SELECT s.years, s.PATIENT_ID AS patid, t.label, s.code, s.age FROM horizon_seqs s JOIN test_ids t ON t.patid = s.PATIENT_ID WHERE len(s.code) >= 2""",
    "vocab": _vocab("seqs", "code"),
    "segments": f"""
SELECT patid, start, len([x for x in code[1 : start] if x = 'SEP']) AS visit, len(code) AS n_tokens,
  len([x for x in code if x = 'SEP']) AS n_visits, code, age
FROM (SELECT *, unnest(range(0, len(code), {SEGMENT})) AS start FROM seqs)""",
    "seq_tokens": """
SELECT patid, generate_subscripts(code, 1) - 1 AS pos, unnest(code) AS token FROM seqs""",
    "seq_places": f"""
SELECT patid, pos, pos - pos % {SEGMENT} AS start, token,
  CAST(coalesce(sum(CAST(token = 'SEP' AS INT)) OVER (PARTITION BY patid ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INT) AS position
FROM seq_tokens""",
    "ages": f"""
SELECT token, idx FROM (VALUES ('PAD', 0), ('UNK', 1)) AS s(token, idx)
UNION ALL SELECT CAST(i AS VARCHAR), CAST(i + 2 AS INT) FROM range({MAX_AGE * 12}) AS r(i)""",
    "horizon_cut": _cls("horizons", TOKENS, ", years"),
    "horizon_grid": _grid("horizon_cut", TOKENS, "patid, years"),
    "horizon_rows": """
SELECT g.*, coalesce(v.idx, 1) AS code_id, coalesce(a.idx, 1) AS age_id FROM horizon_grid g
LEFT JOIN vocab v ON v.token = g.code LEFT JOIN ages a ON a.token = g.age""",
    "enough_visits": "SELECT * FROM seqs WHERE len([x for x in code if x = 'SEP']) >= 5",
    "mlm_cut": _cls("enough_visits", TOKENS),
    "mlm_grid": _grid("mlm_cut", TOKENS),
    "mlm_rows": """
SELECT g.*, coalesce(v.idx, 1) AS code_id, coalesce(a.idx, 1) AS age_id FROM mlm_grid g
LEFT JOIN vocab v ON v.token = g.code LEFT JOIN ages a ON a.token = g.age""",
    "next_input": "SELECT patid, code, age, code[greatest(len(code) - 2, 1):] AS label FROM seqs",
    "next_labels": _vocab("next_input", "label"),
    "next_cut": _cls("next_input", TOKENS),
    "next_grid": _grid("next_cut", TOKENS),
    "next_rows": """
SELECT g.*, coalesce(v.idx, 1) AS code_id, coalesce(a.idx, 1) AS age_id FROM next_grid g
LEFT JOIN vocab v ON v.token = g.code LEFT JOIN ages a ON a.token = g.age""",
    "next_label_rows": f"""
SELECT p.patid, string_agg(CAST(coalesce(t.idx, -1) AS VARCHAR), ',' ORDER BY p.pos) AS label
FROM (SELECT patid, unnest(range({TOKENS})) AS pos FROM next_input) p
LEFT JOIN (SELECT l.patid, l.pos, coalesce(v.idx, 1) AS idx
  FROM (SELECT patid, generate_subscripts(label, 1) - 1 AS pos, unnest(label) AS token FROM next_input) l
  LEFT JOIN next_labels v ON v.token = l.token) t ON t.patid = p.patid AND t.pos = p.pos GROUP BY p.patid""",
    "clf_cut": f"""
SELECT patid, code[greatest(len(code) - {CLASSIFIER_TOKENS - 1}, 1):] AS code, age[greatest(len(code) - {CLASSIFIER_TOKENS - 1}, 1):] AS age
FROM seqs WHERE patid IN (SELECT patid FROM split)""",
    "clf_grid": _grid("clf_cut", CLASSIFIER_TOKENS),
    "clf_rows": """
SELECT g.*, coalesce(v.idx, 0) AS code_id, CASE WHEN g.age ~ '^[0-9]+$' THEN least(CAST(g.age AS INT), 1321) ELSE 0 END AS age_id
FROM clf_grid g LEFT JOIN vocab v ON v.token = g.code""",
    "classified": f"""
SELECT r.patid, s.label, {_joined('CASE WHEN is_real THEN code_id ELSE 0 END', 'input_ids')},
  {_joined('CASE WHEN is_real THEN age_id ELSE 0 END', 'age_ids')}, {_joined('CASE WHEN is_real THEN position % 2 ELSE 0 END', 'seg_ids')},
  {_joined('CAST(is_real AS INT)', 'attention_mask')}, sum(CAST(is_real AS INT)) AS n_real
FROM clf_rows r JOIN split s ON s.patid = r.patid GROUP BY r.patid, s.label""",
    "counts": """
SELECT horizon, count(*) FILTER (label = 0 AND prob <= 0.5) AS tn, count(*) FILTER (label = 0 AND prob > 0.5) AS fp,
  count(*) FILTER (label = 1 AND prob <= 0.5) AS fn, count(*) FILTER (label = 1 AND prob > 0.5) AS tp FROM predictions GROUP BY horizon""",
    "metrics": """
SELECT horizon, coalesce(tp / nullif(tp + fp, 0), 0.0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0.0) AS recall,
  coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0.0) AS f1, tn / nullif(tn + fp, 0) AS specificity FROM counts""",
    "aucs": _auc("predictions", "horizon"),
    "usable": "SELECT * FROM gappy_predictions WHERE label IS NOT NULL AND prob IS NOT NULL AND NOT isnan(prob)",
    "gappy_aucs": _auc("usable", "horizon"),
    "gappy_counts": """
SELECT horizon, sum(label * CAST(prob > 0.5 AS INT)) AS tp, sum((1 - label) * CAST(prob > 0.5 AS INT)) AS fp, sum(label) AS cases, count(*) AS n
FROM usable GROUP BY horizon""",
    "attribution": """
SELECT code, round(avg(value), 9) AS mean_shap, round(avg(abs(value)), 9) AS mean_abs_shap, count(*) AS n_occurrences
FROM attributions WHERE code NOT IN ('PAD', 'SEP') GROUP BY code""",
    "step_log": "SELECT CAST(run_id % 10 AS INT) AS epoch, cnt, loss, loss / 100 AS precision FROM training_log",
}

_INDEX_ROWS = _grid("seqs", CLASSIFIER_TOKENS)
_EXAMPLE = f"""{_joined('CASE WHEN is_real THEN age_id ELSE 0 END', 'age')}, {_joined('position')},
  {_joined('position % 2', 'segment')}, {_joined('CAST(is_real AS INT)', 'mask')}"""
_SEQUENCE_TEXT = "len(code) AS n_tokens, array_to_string(code, '|') AS code, array_to_string(age, '|') AS age"
_FLAGGED = f"CODE IN ({_list(FLAGGED)})"
_BUSIEST = "(SELECT PATIENT_ID FROM {0} GROUP BY PATIENT_ID ORDER BY count(*) DESC, PATIENT_ID LIMIT 1)"

SELECTS = {
    "events_from_dx": "SELECT * FROM dx_events",
    "labs_to_measurements": "SELECT PATIENT_ID, Shifted_date AS DATE, regexp_replace(LAB_NAME, '^ +| +$', '', 'g') AS TEST_NAME, CASE WHEN regexp_full_match(RESULT, '[+-]?[0-9]+([.][0-9]+)?') THEN CAST(RESULT AS DOUBLE) END AS TEST_VALUE FROM deid_lab_out",
    "vitals_to_measurements": "SELECT PATIENT_ID, Shifted_date AS DATE, concat('VITAL_', split_part(VITAL_CODE, ':', 2), '_MEAN') AS TEST_NAME, CASE WHEN regexp_full_match(MEASUREMENT, '[+-]?[0-9]+([.][0-9]+)?') THEN CAST(MEASUREMENT AS DOUBLE) END AS TEST_VALUE FROM deid_vital",
    "measurements_with_value": "SELECT * FROM measurements WHERE TEST_VALUE IS NOT NULL",
    "keep_known_tests": "SELECT * FROM known",
    "recode_label": f"SELECT *, {_label_case()} AS label FROM deid_visit_dx",
    "min_tokens": "SELECT patid, len(code) AS n_tokens FROM seqs WHERE len(code) >= 40",
    "min_tokens_segments": "SELECT patid, len(code) AS n_tokens FROM seqs WHERE len(code) >= 40",
    "min_visits": "SELECT patid, len([x for x in code if x = 'SEP']) AS n_visits FROM enough_visits",
    "visit_filter_report": "SELECT (SELECT count(*) FROM seqs) AS n_before, (SELECT count(*) FROM enough_visits) AS n_after, (SELECT count(*) FROM seqs) - (SELECT count(*) FROM enough_visits) AS n_dropped",
    "patient_events": f"SELECT * FROM universal WHERE PATIENT_ID = {_BUSIEST.format('universal')}",
    "events_with_codes": f"SELECT * FROM universal WHERE {_FLAGGED}",
    "last_visit": "SELECT * FROM last_visit",
    "year_of_birth": "SELECT * FROM births",
    "add_age": "SELECT * FROM aged",
    "attach_labels": "SELECT s.patid, len(s.code) AS n_tokens, l.AIM_GROUP FROM seqs s JOIN (SELECT DISTINCT PATIENT_ID, AIM_GROUP FROM deid_visit_dx) l ON l.PATIENT_ID = s.patid",
    "restrict_to": "SELECT * FROM test_events",
    "synonym_map": "SELECT * FROM synonyms",
    "ambiguous_names": "SELECT DISTINCT name, array_to_string(loincs, '|') AS loincs FROM (SELECT name, loincs FROM canonical UNION ALL SELECT synonym, loincs FROM candidates) a WHERE len(loincs) > 1",
    "normalize_names": "SELECT * FROM named",
    "bin_values": "SELECT * FROM binned",
    "discretize": "SELECT * FROM lab_events",
    "universal_events": "SELECT * FROM universal",
    "earliest_index": "SELECT * FROM index_dates",
    "censor_at_index": "SELECT * FROM censored",
    "censor_any_row": "SELECT u.PATIENT_ID, u.DATE, u.CODE FROM universal u LEFT JOIN earliest_dx_deid f ON u.PATIENT_ID = f.PATIENT_ID WHERE f.EARLIEST_DX IS NULL OR u.DATE < f.EARLIEST_DX",
    "reference_dates": "SELECT * FROM refs",
    "censor_at_horizon": "SELECT * FROM horizon_events",
    "horizon_test_sets": f"SELECT years, patid, label, {_SEQUENCE_TEXT} FROM horizons",
    "horizon_report": "SELECT years, count(*) AS n_kept, CAST(sum(label) AS BIGINT) AS n_cases, CAST(count(*) - sum(label) AS BIGINT) AS n_controls, (SELECT count(*) FROM test_ids) - count(*) AS n_dropped FROM horizons GROUP BY years",
    "reference_disagreements": "SELECT r.is_case, t.label, count(*) AS n FROM refs r JOIN test_ids t ON t.patid = r.PATIENT_ID WHERE r.is_case <> t.label GROUP BY 1, 2",
    "patient_sequences": f"SELECT patid, {_SEQUENCE_TEXT} FROM seqs",
    "patient_sequences_segments": f"SELECT patid, start, visit, n_tokens, n_visits, {_segments('code')}, {_segments('age')} FROM segments",
    "build_visits": """
SELECT PATIENT_ID, DATE, count(*) + 1 AS n_tokens, concat(string_agg(CODE, '|' ORDER BY CODE), '|SEP') AS code,
  repeat(max(AGE) || '|', count(*)) || max(AGE) AS age FROM aged GROUP BY PATIENT_ID, DATE""",
    "build_sequences": f"SELECT patid, {_SEQUENCE_TEXT} FROM seqs",
    "sequence_summary": "SELECT count(*) AS n_patients, round(avg(len(code)), 9) AS avg_seq_len, max(len(code)) AS max_seq_len FROM seqs",
    "longest_sequences": "SELECT patid, len(code) AS seq_len FROM seqs ORDER BY seq_len DESC, patid LIMIT 20",
    "distinct_labels": "SELECT DISTINCT PATIENT_ID, AIM_GROUP FROM deid_visit_dx",
    "labelled_cohort": "SELECT * FROM cohort",
    "labelled_cohort_keep": "SELECT s.patid, l.label FROM seqs s JOIN raw_labels l ON s.patid = l.PATIENT_ID WHERE l.label IS NOT NULL AND len(s.code) >= 2",
    "conflicting_labels": "SELECT CAST(c_nationkey AS VARCHAR) AS PATIENT_ID, '0,1' AS labels FROM customer GROUP BY 1 HAVING count(DISTINCT c_mktsegment = 'MACHINERY') = 2",
    "stratified_split": "SELECT * FROM split",
    "split_sequences": f"SELECT s.patid, p.label, p.split, {_SEQUENCE_TEXT} FROM seqs s JOIN split p ON p.patid = s.patid",
    "cohort_conflicts": "SELECT PATIENT_ID, '0,1' AS labels FROM raw_labels WHERE label IS NOT NULL GROUP BY PATIENT_ID HAVING count(*) = 2",
    "undersample": "SELECT patid, label FROM ranked WHERE label = 1 OR r <= (SELECT count(*) FROM cohort WHERE label = 1)",
    "shuffle": f"SELECT * FROM cohort ORDER BY {_key()}, patid",
    "sample_patients": f"SELECT * FROM cohort ORDER BY {_key()}, patid LIMIT 150",
    "label_distribution": "SELECT split, label, count(*) AS n FROM split GROUP BY split, label",
    "batch_count": "SELECT CAST(floor(count(*) / 32) AS BIGINT) AS steps FROM cohort",
    "build_vocab": "SELECT * FROM vocab",
    "invert_vocab": "SELECT idx, token FROM vocab",
    "truncate_with_cls": f"SELECT patid, array_to_string(code, '|') AS code, array_to_string(age, '|') AS age FROM ({_cls('seqs', TOKENS)})",
    "index_arrays": f"""
SELECT patid, {_joined('position')}, {_joined('position % 2', 'segment')}, max(mask) AS mask FROM (
  SELECT *, string_agg(CAST(CAST(is_real AS INT) AS VARCHAR), ',' ORDER BY pos) OVER (PARTITION BY patid ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS mask
  FROM ({_INDEX_ROWS})) WHERE is_real GROUP BY patid""",
    "index_arrays_segments": f"SELECT patid, start, {_joined('position')}, {_joined('position % 2', 'segment')} FROM seq_places GROUP BY patid, start",
    "tokens_to_ids": f"""
SELECT r.patid, {_joined("CASE WHEN r.token = 'SEP' THEN 1 ELSE coalesce(v.idx, 1) END", 'code')}
FROM (SELECT patid, generate_subscripts(code, 1) AS pos, unnest(code) AS token FROM seqs) r LEFT JOIN vocab v ON v.token = r.token GROUP BY r.patid""",
    "pad_to_ids": f"""
SELECT p.patid, {_joined("CASE WHEN t.token IS NULL THEN 0 ELSE coalesce(a.idx, 1) END", 'age', 'p.pos')}
FROM (SELECT patid, unnest(range({TOKENS})) AS pos FROM seqs) p
LEFT JOIN (SELECT patid, generate_subscripts(age, 1) - 1 AS pos, unnest(age) AS token FROM seqs) t ON t.patid = p.patid AND t.pos = p.pos
LEFT JOIN ages a ON a.token = t.token GROUP BY p.patid""",
    "mlm_mask": f"""
SELECT patid, {_joined(_MASKED, 'code')}, {_joined(_LABEL, 'label')}
FROM (SELECT r.patid, r.pos, coalesce(v.idx, 1) AS code_id
  FROM (SELECT patid, generate_subscripts(code, 1) - 1 AS pos, unnest(code) AS token FROM seqs) r LEFT JOIN vocab v ON v.token = r.token) GROUP BY patid""",
    "mlm_mask_segments": f"""
SELECT patid, start, {_joined(_MASKED, 'code')}, {_joined(_LABEL, 'label')}
FROM (SELECT p.patid, p.start, p.pos, coalesce(v.idx, 1) AS code_id FROM seq_places p LEFT JOIN vocab v ON v.token = p.token) GROUP BY patid, start""",
    "encode_mlm_segments": f"""
SELECT patid, {_EXAMPLE}, {_joined(f'CASE WHEN is_real THEN {_MASKED} ELSE 0 END', 'code')},
  {_joined(f'CASE WHEN is_real THEN {_LABEL} ELSE -1 END', 'label')} FROM mlm_rows GROUP BY patid""",
    "encode_mlm_horizons": f"""
SELECT years, patid, {_EXAMPLE}, {_joined(f'CASE WHEN is_real THEN {_MASKED} ELSE 0 END', 'code')},
  {_joined(f'CASE WHEN is_real THEN {_LABEL} ELSE -1 END', 'label')} FROM horizon_rows GROUP BY years, patid""",
    "encode_mlm": f"""
SELECT patid, {_EXAMPLE}, {_joined(f'CASE WHEN is_real THEN {_MASKED} ELSE 0 END', 'code')},
  {_joined(f'CASE WHEN is_real THEN {_LABEL} ELSE -1 END', 'label')} FROM mlm_rows GROUP BY patid""",
    "encode_next_visit": f"""
SELECT r.patid, r.age, r.code, r.position, r.segment, r.mask, l.label
FROM (SELECT patid, {_EXAMPLE}, {_joined('CASE WHEN is_real THEN code_id ELSE 0 END', 'code')} FROM next_rows GROUP BY patid) r
JOIN next_label_rows l ON l.patid = r.patid""",
    "encode_classifier": "SELECT patid, label, input_ids, age_ids, seg_ids, attention_mask FROM classified",
    "aligned_tokens": f"""
SELECT p.patid, string_agg(coalesce(t.token, 'PAD'), '|' ORDER BY p.pos) AS code
FROM (SELECT patid, unnest(range({TOKENS})) AS pos FROM seqs) p
LEFT JOIN (SELECT patid, generate_subscripts(c, 1) - 1 AS pos, unnest(c) AS token FROM (SELECT patid, code[greatest(len(code) - {TOKENS - 1}, 1):] AS c FROM seqs)) t
  ON t.patid = p.patid AND t.pos = p.pos GROUP BY p.patid""",
    "confusion": "SELECT * FROM counts",
    "binary_metrics": "SELECT horizon, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1, round(specificity, 9) AS specificity FROM metrics",
    "roc_auc": f"SELECT horizon, round({_AUC_VALUE}, 9) AS roc_auc FROM aucs",
    "roc_auc_gaps": f"SELECT horizon, round({_AUC_VALUE}, 9) AS roc_auc FROM gappy_aucs",
    "metrics_gaps": f"""
SELECT a.horizon, a.n_patients, a.n_cases, a.n_controls, round({_AUC_VALUE}, 9) AS roc_auc,
  round(CASE WHEN tp + fp + cases > 0 THEN 2 * tp / (tp + fp + cases) ELSE 0 END, 9) AS f1, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 9) AS precision,
  round(tp / cases, 9) AS recall, round(1 - fp / (n - cases), 9) AS specificity
FROM gappy_aucs a JOIN gappy_counts c ON c.horizon IS NOT DISTINCT FROM a.horizon WHERE n_cases > 0 AND n_controls > 0""",
    "single_class_groups": """
SELECT CAST(floor(CAST(patid AS BIGINT) / 4) AS BIGINT) AS horizon, count(*) AS n_patients, CAST(sum(label) AS BIGINT) AS n_cases, CAST(count(*) - sum(label) AS BIGINT) AS n_controls
FROM predictions GROUP BY 1 HAVING sum(label) IN (0, count(*))""",
    "metrics_by_horizon": f"""
SELECT a.horizon, a.n_patients, a.n_cases, a.n_controls, round({_AUC_VALUE}, 9) AS roc_auc, round(m.f1, 9) AS f1, round(m.precision, 9) AS precision,
  round(m.recall, 9) AS recall, round(m.specificity, 9) AS specificity FROM aucs a JOIN metrics m ON m.horizon = a.horizon WHERE n_cases > 0 AND n_controls > 0""",
    "smooth": """
SELECT run_id, cnt, CAST(CAST(smoothed AS FLOAT) AS DOUBLE) AS smoothed FROM (
WITH RECURSIVE s AS (SELECT run_id, cnt, loss, row_number() OVER (PARTITION BY run_id ORDER BY cnt) AS i FROM training_log),
f AS (SELECT run_id, cnt, i, loss AS smoothed FROM s WHERE i = 1
  UNION ALL SELECT s.run_id, s.cnt, s.i, 0.9 * f.smoothed + (1 - 0.9) * s.loss FROM f JOIN s ON s.run_id = f.run_id AND s.i = f.i + 1) SELECT * FROM f)""",
    "smooth_gaps": """
SELECT run_id, cnt, CASE WHEN NOT isnan(smoothed) THEN CAST(CAST(smoothed AS FLOAT) AS DOUBLE) END AS smoothed FROM (
WITH RECURSIVE s AS (SELECT run_id, cnt, loss, row_number() OVER (PARTITION BY run_id ORDER BY cnt) AS i FROM gappy_log),
f AS (SELECT run_id, cnt, i, loss AS smoothed FROM s WHERE i = 1
  UNION ALL SELECT s.run_id, s.cnt, s.i, 0.9 * f.smoothed + (1 - 0.9) * s.loss FROM f JOIN s ON s.run_id IS NOT DISTINCT FROM f.run_id AND s.i = f.i + 1) SELECT * FROM f)""",
    "masked_precision": """
SELECT round(avg(CASE WHEN list_position(scores, list_max(scores)) - 1 = label THEN 1.0 ELSE 0.0 END), 9) AS precision
FROM (SELECT CASE WHEN l_returnflag = 'R' THEN -1 ELSE l_linenumber % 3 END AS label, [l_discount, l_tax, l_quantity / 500] AS scores FROM lineitem) WHERE label <> -1""",
    "global_steps": "SELECT epoch, cnt, CAST(epoch AS BIGINT) * 1000 + cnt AS global_step, loss FROM step_log WHERE ((cnt - 1) % 200 + 200) % 200 = 0",
    "epoch_precision": "SELECT epoch, round(avg(precision), 9) AS precision FROM step_log GROUP BY epoch",
    "attribution_summary": "SELECT * FROM attribution",
    "attributions_by_horizon": f"""
SELECT years, patid, CAST(pos AS INT) AS pos, coalesce(c[pos + 1], 'PAD') AS code, (pos + 1) * years * 0.25::DOUBLE - 0.5 AS value
FROM (SELECT years, patid, code[greatest(len(code) - {ATTRIBUTED - 1}, 1):] AS c, unnest(range({ATTRIBUTED})) AS pos FROM horizons)""",
    "top_attributions": "SELECT * FROM attribution ORDER BY mean_abs_shap DESC, code LIMIT 20",
    "score": """
SELECT patid, label, CAST(prob > 0.5 AS INT) AS pred, round(prob, 9) AS prob FROM (SELECT patid, label, 1 / (1 + exp(-(n_real / 100.0 - 0.75))) AS prob FROM classified)""",
    "bin_summary": "SELECT regexp_extract(CODE, 'LAB:(.*)_BIN', 1) AS TEST_NAME, count(*) AS n FROM lab_events GROUP BY 1",
    "event_kind_summary": "SELECT if(starts_with(CODE, 'DX:'), 'DX', 'LAB/VITAL') AS type, count(*) AS n FROM censored GROUP BY ALL",
    "distinct_by_kind": """
SELECT if(starts_with(CODE, 'DX:'), 'DX', 'LAB/VITAL') AS kind, count(DISTINCT PATIENT_ID) AS n, CAST(1 AS INT) AS is_near FROM universal GROUP BY 1""",
    "patient_profile": """
SELECT PATIENT_ID, count(*) AS total_events, count(DISTINCT DATE) AS unique_dates, min(DATE) AS first_date, max(DATE) AS last_date,
  CAST(date_diff('year', min(DATE), max(DATE)) AS INT) AS years_span FROM censored GROUP BY PATIENT_ID""",
    "top_days": "SELECT PATIENT_ID, DATE, n_events FROM (SELECT PATIENT_ID, DATE, count(*) AS n_events, row_number() OVER (PARTITION BY PATIENT_ID ORDER BY count(*) DESC, DATE) AS r FROM censored GROUP BY PATIENT_ID, DATE) WHERE r <= 10",
    "top_codes": "SELECT PATIENT_ID, CODE, n FROM (SELECT PATIENT_ID, CODE, count(*) AS n, row_number() OVER (PARTITION BY PATIENT_ID ORDER BY count(*) DESC, CODE) AS r FROM censored GROUP BY PATIENT_ID, CODE) WHERE r <= 15",
    "top_codes_of_patient": f"SELECT PATIENT_ID, CODE, count(*) AS n FROM censored WHERE PATIENT_ID = {_BUSIEST.format('censored')} GROUP BY PATIENT_ID, CODE ORDER BY n DESC, CODE LIMIT 15",
    "leakage_audit": f"SELECT PATIENT_ID, count(*) AS n_suspicious_codes FROM censored WHERE {_FLAGGED} GROUP BY PATIENT_ID",
    "audit_examples": f"SELECT * FROM censored WHERE {_FLAGGED} AND PATIENT_ID = (SELECT min(PATIENT_ID) FROM censored WHERE {_FLAGGED})",
    "leakage_examples": f"""
SELECT e.PATIENT_ID, e.DATE, e.CODE, i.Index_Date, i.n_index_rows FROM censored e
LEFT JOIN (SELECT PATIENT_ID, min(EARLIEST_DX) AS Index_Date, count(*) AS n_index_rows FROM earliest_dx_deid GROUP BY PATIENT_ID) i ON i.PATIENT_ID = e.PATIENT_ID WHERE {_FLAGGED}""",
    "patients_with_events": "SELECT count(DISTINCT PATIENT_ID) AS n_patients FROM test_events",
    "sort_events": "SELECT * FROM censored ORDER BY PATIENT_ID, DATE, CODE",
    **io.SQL,
}
# Other ways to the same result.
SELECTS |= {
    "restrict_to_filtered": SELECTS["restrict_to"],
    "split_sequences_stored": SELECTS["split_sequences"],
    "write_splits": SELECTS["split_sequences"],
    "join_segments": SELECTS["patient_sequences"],
    "encode_mlm_tails": SELECTS["encode_mlm"],
    "encode_classifier_tails": SELECTS["encode_classifier"],
}


def _needed(text, have):
    """Names of the CTEs that ``text`` uses, in order of definition."""
    wanted, todo = set(), [text]
    while todo:
        words = set(re.findall(r"\w+", todo.pop()))
        for name in have:
            if name in words and name not in wanted:
                wanted.add(name)
                todo.append(have[name])
    return [name for name in have if name in wanted]


def sql(name: str) -> str:
    text = SELECTS[name].strip()
    used = _needed(text, CTES)
    if not used:
        return text
    return "WITH " + ",\n".join(f"{n} AS ({CTES[n].strip()})" for n in used) + "\n" + text
