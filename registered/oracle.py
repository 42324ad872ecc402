"""DuckDB SQL for the registered queries, written from the definitions alone.

RE2 has no look-around, so lines and words are cut into lists first.
"""

from __future__ import annotations

from registered.derived import PYTHON_HEAD

WS = r"\t-\r\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
LB = r"\n-\r\x1c-\x1e\x85\x{2028}\x{2029}"
WORD = r"\p{L}\p{N}_"
NL = "chr(10)"

TEXTS = "SELECT doc_id AS id, text AS code, lang AS language FROM documents"
MARKUP = "SELECT page_id AS id, html AS code, CAST(NULL AS VARCHAR) AS language FROM pages"
SPLIT = "CASE WHEN {0} % 10 < 8 THEN 'train' WHEN {0} % 10 = 8 THEN 'val' ELSE 'test' END"
LABELS = f"SELECT doc_id AS id, quality AS label, {SPLIT.format('doc_id')} AS split FROM labels"


def _literal(s: str) -> str:
    return " || chr(10) || ".join("'" + part.replace("'", "''") + "'" for part in s.split("\n"))


PYTHON = rf"""
SELECT doc_id AS id,
       replace({_literal(PYTHON_HEAD)}, '{{id}}', CAST(doc_id AS VARCHAR))
       || CASE WHEN regexp_matches(text, '[A-Za-z]')
          THEN regexp_replace(text, '[^A-Za-z]*([A-Za-z]+)[^A-Za-z]*',
                              'if v_\1: v_\1 = g(1)' || {NL}, 'g')
          ELSE '' END AS code,
       CASE doc_id % 3 WHEN 0 THEN 'Python ' WHEN 1 THEN 'java' END AS language,
       CASE WHEN regexp_matches(text, '[A-Za-z]')
            THEN len(regexp_extract_all(text, '[A-Za-z]+')) ELSE 0 END AS words
FROM documents
"""

PREDS = f"""
SELECT id, split, y_true, 'A' AS model, CAST(n_chars % 3 = 0 AS INT) AS y_pred,
       (n_chars % 100) / 100.0::DOUBLE AS y_proba FROM scored
UNION ALL
SELECT id, split, y_true, 'B', CAST(s > 0.5 AS INT), s FROM scored
UNION ALL
SELECT id, split, y_true, 'C', CASE WHEN id % 11 = 0 THEN 1 - y_true ELSE y_true END,
       CAST(NULL AS DOUBLE) FROM scored
"""

SCORED = f"""
SELECT d.doc_id AS id, l.split, l.label AS y_true, d.n_chars,
       ((d.doc_id * 7919 + d.n_chars * 104729) % 1000003) / 1000003.0::DOUBLE AS s
FROM documents d JOIN ({LABELS}) l ON l.id = d.doc_id
"""


def strip(c: str) -> str:
    return rf"regexp_replace({c}, '\A[{WS}]+|[{WS}]+\z', '', 'g')"


def chars(c: str, wanted: str) -> str:
    return " + ".join(f"(length({c}) - length(replace({c}, '{x}', '')))" for x in wanted)


def words(c: str, word: str) -> str:
    return f"len(list_filter(regexp_extract_all({c}, '[{WORD}]+'), lambda x: x = '{word}'))"


def lines_of(source: str) -> str:
    """``source`` with its lines, comment lines and blank lines counted."""
    return rf"""
cut AS (SELECT *, regexp_split_to_array(code, '\r\n|[{LB}]') AS parts FROM ({source})),
lined AS (SELECT *, CASE WHEN parts[len(parts)] = '' THEN parts[1:len(parts) - 1] ELSE parts END AS lines
          FROM cut),
base AS (SELECT *,
    len(list_filter(lines, lambda x: regexp_matches(x, '\A[{WS}]*(#|//|/\*|\*)'))) AS n_comment,
    len(list_filter(lines, lambda x: regexp_matches(x, '\A[{WS}]*\z'))) AS n_blank,
    {chars('code', 'NL').replace("'N'", NL).split(' + ')[0]} + 1 AS n_lines,
    regexp_extract_all(code, '[A-Za-z_][A-Za-z0-9_]*') AS ids
    FROM lined)
"""


CALLS = rf"len(regexp_extract_all(code, '[{WORD}][{WS}]*\('))"
ID_MEAN = "CASE WHEN len(ids) = 0 THEN 0.0 ELSE length(array_to_string(ids, '')) / len(ids)::DOUBLE END"
ID_DISTINCT = "len(list_distinct(ids))"
BY_LINES = "CASE WHEN len(lines) = 0 THEN 0.0 ELSE n_comment / len(lines)::DOUBLE END"

LEXICAL = {
    "num_if": words("code", "if"),
    "num_for": words("code", "for"),
    "num_while": words("code", "while"),
    "num_assign": chars("code", "="),
    "num_calls": CALLS,
    "avg_identifier_len": ID_MEAN,
    "num_unique_identifiers": ID_DISTINCT,
    "num_functions": "0",
    "num_classes": "0",
    "num_imports": "0",
    "num_try": "0",
    "max_ast_depth": "0",
}
LAYOUT = {
    "char_count": "length(code)",
    "line_count": "CASE WHEN code = '' THEN 0 ELSE n_lines END",
    "blank_line_ratio": "n_blank / n_lines::DOUBLE",
    "comment_ratio": "n_comment / n_lines::DOUBLE",
    "num_semicolons": chars("code", ";"),
    "num_braces": chars("code", "{}"),
    "num_parens": chars("code", "()"),
    "num_colons": chars("code", ":"),
}


def doubles(columns: dict[str, str]) -> str:
    return ", ".join(f"CAST({e} AS DOUBLE) AS {n}" for n, e in columns.items())


def structural(source: str) -> str:
    """The structural row of snippets none of which is read as Python."""
    return f"WITH {lines_of(source)} SELECT id, {doubles(LEXICAL | LAYOUT | {'parse_error': '0'})} FROM base"


# What the syntax tree of a derived snippet holds, by construction.
TREE = {
    "num_if": "words",
    "num_for": "1",
    "num_while": "1",
    "num_assign": "words",
    "num_calls": "words",
    "avg_identifier_len": "(7 + 2 * length(CAST(id AS VARCHAR))) / 6.0::DOUBLE",
    "num_unique_identifiers": "4",
    "num_functions": "1",
    "num_classes": "1",
    "num_imports": "1",
    "num_try": "1",
    "max_ast_depth": "CASE WHEN words > 0 THEN 6 ELSE 5 END",
}


def _counts(model: str = "model, split") -> str:
    return f"""
scored AS ({SCORED}), preds AS ({PREDS}),
cells AS (SELECT {model}, y_true, y_pred, count(*) AS n FROM preds GROUP BY ALL),
sides AS (
    SELECT {model}, y_true AS label, CASE WHEN y_true = y_pred THEN n ELSE 0 END AS tp,
           n AS support, 0 AS predicted FROM cells
    UNION ALL
    SELECT {model}, y_pred, 0, 0, n FROM cells),
totals AS (SELECT {model}, label, sum(tp) AS tp, sum(support) AS support, sum(predicted) AS predicted
           FROM sides GROUP BY ALL),
classes AS (SELECT *,
    CASE WHEN predicted = 0 THEN 0.0 ELSE tp / predicted::DOUBLE END AS "precision",
    CASE WHEN support = 0 THEN 0.0 ELSE tp / support::DOUBLE END AS recall,
    2 * tp / (predicted + support)::DOUBLE AS f1 FROM totals),
summary AS (SELECT {model}, sum(tp) / sum(support)::DOUBLE AS accuracy,
    avg(f1) AS f1_macro, avg("precision") AS precision_macro, avg(recall) AS recall_macro,
    sum(f1 * support) / sum(support) AS f1_weighted,
    sum("precision" * support) / sum(support) AS precision_weighted,
    sum(recall * support) / sum(support) AS recall_weighted,
    sum(support) AS n FROM classes GROUP BY {model})
"""


SWEEP = """
steps AS (SELECT model, split, y_proba AS score, count(*) FILTER (y_true = 1) AS pos,
                 count(*) FILTER (y_true <> 1) AS neg
          FROM preds WHERE y_proba IS NOT NULL GROUP BY ALL),
swept AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp,
                 sum(pos) OVER g AS p, sum(neg) OVER g AS n
          FROM steps WINDOW w AS (PARTITION BY model, split ORDER BY score DESC),
                            g AS (PARTITION BY model, split)),
roc AS (SELECT model, split, score AS threshold, fp / n::DOUBLE AS fpr, tp / p::DOUBLE AS tpr FROM swept
        UNION ALL
        SELECT DISTINCT model, split, 'Infinity'::DOUBLE, 0.0, 0.0 FROM swept),
pr AS (SELECT model, split, score AS threshold, tp / (tp + fp)::DOUBLE AS "precision",
              tp / p::DOUBLE AS recall FROM swept
       UNION ALL
       SELECT DISTINCT model, split, CAST(NULL AS DOUBLE), 1.0, 0.0 FROM swept),
roc_lag AS (SELECT *, lag(fpr) OVER w AS fpr0, lag(tpr) OVER w AS tpr0
            FROM roc WINDOW w AS (PARTITION BY model, split ORDER BY threshold DESC)),
pr_lag AS (SELECT *, lag(recall) OVER w AS recall0, lag("precision") OVER w AS precision0
           FROM pr WINDOW w AS (PARTITION BY model, split ORDER BY coalesce(threshold, 'Infinity'::DOUBLE) DESC)),
areas AS (SELECT a.model, a.split, roc_auc, pr_auc FROM
    (SELECT model, split, sum((fpr - fpr0) * (tpr + tpr0) / 2) AS roc_auc FROM roc_lag GROUP BY ALL) a
    JOIN (SELECT model, split, sum((recall - recall0) * ("precision" + precision0) / 2) AS pr_auc
          FROM pr_lag GROUP BY ALL) b ON a.model = b.model AND a.split = b.split)
"""


def metric_rows(columns: list[str], final: str) -> str:
    """Long rows of ``final`` with one row per metric that is present."""
    return " UNION ALL ".join(
        f"SELECT model, split, '{c}' AS metric, round(CAST({c} AS DOUBLE), 6) AS value FROM {final} WHERE {c} IS NOT NULL"
        for c in columns
    )


SUMMARY_ALL = f"{_counts()}, {SWEEP}, joined AS (SELECT s.*, a.roc_auc, a.pr_auc FROM summary s LEFT JOIN areas a USING (model, split))"

NGRAMS = rf"""
toks AS (SELECT id, regexp_extract_all(lower(code), '[{WORD}]{{2,}}') AS t FROM (
    SELECT id, regexp_replace({strip("replace(code, chr(13) || chr(10), chr(10))")},
                              '\n[{WS}]*\n+', {NL} || {NL}, 'g') AS code FROM ({TEXTS}))),
grams AS (SELECT id, list_concat(list_concat(t,
    list_transform(range(1, greatest(len(t), 1)), lambda i: t[i] || ' ' || t[i + 1])),
    list_transform(range(1, greatest(len(t) - 1, 1)), lambda i: t[i] || ' ' || t[i + 1] || ' ' || t[i + 2])) AS g
    FROM toks)
"""

CLEAN = rf"regexp_replace({strip('replace(code, chr(13) || chr(10), chr(10))')}, '\n[{WS}]*\n+', {NL} || {NL}, 'g')"

TOKENS = rf"regexp_extract_all(code, '[{WORD}]+|[^{WORD}{WS}]')"
VOCAB = f"""
texts AS ({TEXTS}),
vocab AS (SELECT token, n, row_number() OVER (ORDER BY n DESC, token) + 3 AS token_id FROM (
    SELECT token, count(*) AS n FROM (SELECT unnest({TOKENS}) AS token FROM texts)
    GROUP BY token ORDER BY n DESC, token LIMIT 30000))
"""


def encoded(pad: bool) -> str:
    gap_ids = " || repeat(' 0', CAST(510 - n AS BIGINT))" if pad else ""
    return f"""
WITH {VOCAB},
heads AS (SELECT id, {TOKENS}[1:510] AS head FROM texts),
items AS (SELECT id, unnest(head) AS token, generate_subscripts(head, 1) AS pos FROM heads),
found AS (SELECT i.id, count(*) AS n, string_agg(CAST(coalesce(v.token_id, 1) AS VARCHAR), ' ' ORDER BY pos) AS ids
          FROM items i LEFT JOIN vocab v USING (token) GROUP BY i.id),
whole AS (SELECT h.id, coalesce(n, 0) AS n, coalesce(ids || ' ', '') AS ids FROM heads h LEFT JOIN found f USING (id))
SELECT id, '2 ' || ids || '3'{gap_ids} AS input_ids,
       '1 ' || repeat('1 ', CAST(n AS BIGINT)) || '1'{gap_ids} AS attention_mask FROM whole
"""


ORIGINS = f"""
SELECT doc_id AS id, lang || ' ' || source AS code, CAST(lang IN ('en', 'es') AS INT) AS label, {SPLIT.format('doc_id')} AS split FROM documents
"""

# All splits as one.
WHOLE = SCORED.replace("l.split", "'all' AS split")

# Metrics of predictions none of which is wrong.
PERFECT = ", ".join(
    f"1.0::DOUBLE AS {m}"
    for m in ("accuracy", "f1_macro", "precision_macro", "recall_macro", "f1_weighted", "precision_weighted", "recall_weighted")
)

WEIGHTS = "[" + ", ".join(f"{((j % 7) - 3) / 4.0}::DOUBLE" for j in range(64)) + "]"

ORACLE: dict[str, str] = {
    "length_by_label": f"""
WITH {lines_of(TEXTS)}
SELECT l.label, count(*) AS n, round(avg(length(code)), 6) AS avg_char_count,
       round(avg(n_lines), 6) AS avg_line_count,
       round(avg(length(code) / n_lines::DOUBLE), 6) AS avg_avg_line_len,
       round(avg({BY_LINES}), 6) AS avg_comment_ratio
FROM base JOIN ({LABELS}) l USING (id) GROUP BY l.label""",
    "load_task_split": f"SELECT t.id, language, label, split, md5(code) AS code_md5 FROM ({TEXTS}) t JOIN ({LABELS}) l USING (id)",
    "label_counts": f"SELECT split, label, count(*) AS n FROM ({LABELS}) GROUP BY ALL",
    "split_sizes": f"SELECT split, count(*) AS n FROM ({LABELS}) GROUP BY ALL",
    "head_rows": f"SELECT t.id, label, code FROM ({TEXTS}) t JOIN ({LABELS}) l USING (id) ORDER BY t.id LIMIT 5",
    "clean_code": f"SELECT id, md5({CLEAN}) AS clean_md5, length({CLEAN}) AS clean_chars FROM ({TEXTS})",
    "normalized_newlines": "SELECT id, md5(p) AS plain_md5, length(p) AS plain_chars FROM (SELECT id, "
    + strip("replace(code, chr(13) || chr(10), chr(10))")
    + f" AS p FROM ({MARKUP}))",
    "length_columns": f"""
WITH {lines_of(TEXTS)}
SELECT id, length(code) AS char_count, n_lines AS line_count, length(code) / n_lines::DOUBLE AS avg_line_len,
       {BY_LINES} AS comment_ratio FROM base""",
    "line_split": f"""
WITH {lines_of(TEXTS)}
SELECT id, len(lines) AS n_lines, len(lines) AS n_counted, md5(array_to_string(lines, '|')) AS lines_md5 FROM base""",
    "lexical_counts": f"""
SELECT id, {words('code', 'if')} AS n_if, {words('code', 'for')} AS n_for, {words('code', 'while')} AS n_while,
       {chars('code', '=')} AS n_equals, {CALLS} AS n_calls, {chars('code', ';')} AS num_semicolons,
       {chars('code', '{}')} AS num_braces, {chars('code', '()')} AS num_parens, {chars('code', ':')} AS num_colons
FROM ({MARKUP})""",
    "identifier_stats": f"""
WITH {lines_of(TEXTS)}
SELECT id, len(ids) AS n, {ID_MEAN} AS mean_length, {ID_DISTINCT} AS n_distinct FROM base""",
    "comment_ratios": f"""
WITH {lines_of(TEXTS)}
SELECT id, {BY_LINES} AS by_lines, n_comment / n_lines::DOUBLE AS by_newlines, n_blank / n_lines::DOUBLE AS blank
FROM base""",
    "python_route": f"""
SELECT id, coalesce(lower(trim(language)), '') AS language,
       coalesce(language, '') = 'Python ' OR ((contains(code, 'def ') OR contains(code, 'class ')
       OR contains(code, 'import ') OR (contains(code, 'if ') AND contains(code, ':')))) AS is_python
FROM ({PYTHON})""",
    "language_grammar": """
SELECT doc_id AS id, CASE doc_id % 6 WHEN 0 THEN 'javascript' WHEN 1 THEN 'cpp' WHEN 2 THEN 'c_sharp'
       WHEN 3 THEN 'python' WHEN 4 THEN CASE WHEN lang IN ('c', 'java', 'cpp', 'python', 'javascript') THEN lang END
       END AS grammar FROM documents""",
    "lexical_features": f"""
WITH {lines_of(TEXTS)}
SELECT id, {doubles({k: v for k, v in LEXICAL.items() if k != 'num_try'} | {'parse_error': '0', 'comment_ratio': BY_LINES})}
FROM base""",
    "structural_texts": structural(TEXTS),
    "structural_markup": structural(MARKUP),
    "structural_python": f"""
WITH {lines_of(PYTHON)}
SELECT id, {doubles(
    TREE | LAYOUT | {'parse_error': '0'}
)} FROM base""",
    "python_node_profile": f"SELECT id, {doubles(TREE)} FROM ({PYTHON})",
    "node_type_counts": f"""
WITH s AS (SELECT count(*) AS d, coalesce(sum(words), 0) AS w FROM ({PYTHON})),
kinds(node_type, per_doc, per_word, deepest) AS (VALUES
    ('Module', 1, 0, 1), ('Import', 1, 0, 2), ('alias', 1, 0, 3), ('ClassDef', 1, 0, 2), ('FunctionDef', 1, 0, 3),
    ('arguments', 1, 0, 4), ('arg', 1, 0, 5), ('Pass', 4, 0, 4), ('For', 1, 0, 2), ('While', 1, 0, 2),
    ('Break', 1, 0, 3), ('Try', 1, 0, 2), ('ExceptHandler', 1, 0, 3), ('Name', 4, 3, 5), ('Load', 3, 2, 6),
    ('Store', 1, 1, 5), ('If', 0, 1, 2), ('Assign', 0, 1, 3), ('Call', 0, 1, 4), ('Constant', 0, 1, 5))
SELECT node_type, CAST(d * per_doc + w * per_word AS BIGINT) AS n, CAST(deepest AS BIGINT) AS deepest FROM kinds, s""",
    "node_profile": rf"""
WITH tags AS (SELECT id, unnest(t) AS tag, generate_subscripts(t, 1) AS pos FROM (
    SELECT id, regexp_extract_all(code, '<(/?[a-z][^>]*)>', 1) AS t FROM ({MARKUP}))),
deep AS (SELECT *, sum(CASE WHEN tag LIKE '/%' THEN -1 ELSE 1 END) OVER (PARTITION BY id ORDER BY pos) AS depth FROM tags),
nodes AS (SELECT id, depth, tag, regexp_extract(tag, '^[a-z0-9]+') AS name FROM deep WHERE tag NOT LIKE '/%'),
per AS (SELECT id, name, count(*) AS n FROM nodes GROUP BY ALL),
types AS (SELECT id, CAST(count(*) AS DOUBLE) AS total_node_types, CAST(max(n) AS DOUBLE) AS most_common_node_type_count FROM per GROUP BY id)
SELECT n.id, CAST(count(*) FILTER (name = 'p') AS DOUBLE) AS num_functions,
    CAST(count(*) FILTER (name = 'div') AS DOUBLE) AS num_classes,
    CAST(count(*) FILTER (name = 'meta') AS DOUBLE) AS num_imports,
    CAST(count(*) FILTER (name = 'li') AS DOUBLE) AS num_calls,
    CAST(count(*) FILTER (name = 'h1') AS DOUBLE) AS num_if,
    CAST(count(*) FILTER (name = 'article') AS DOUBLE) AS num_for,
    CAST(count(*) FILTER (name = 'ul') AS DOUBLE) AS num_while,
    CAST(max(depth) AS DOUBLE) AS max_ast_depth,
    coalesce(sum(length(tag)) FILTER (name = 'a') / (count(*) FILTER (name = 'a'))::DOUBLE, 0.0) AS avg_identifier_len,
    CAST(count(DISTINCT tag) FILTER (name = 'a') AS DOUBLE) AS num_unique_identifiers,
    any_value(total_node_types) AS total_node_types, any_value(most_common_node_type_count) AS most_common_node_type_count
FROM nodes n JOIN types t ON n.id = t.id GROUP BY n.id""",
    "align_features": f"""
SELECT id, CAST(length(code) AS DOUBLE) AS char_count, 0.0::DOUBLE AS most_common_node_type_count,
       CAST({chars('code', '{}')} AS DOUBLE) AS num_braces, CAST({chars('code', '()')} AS DOUBLE) AS num_parens
FROM ({MARKUP})""",
    "stack_features": f"""
WITH {lines_of(MARKUP)}
SELECT id, CAST(length(code) AS DOUBLE) AS char_count, CAST(n_lines AS DOUBLE) AS line_count,
       length(code) / n_lines::DOUBLE AS avg_line_len, {BY_LINES} AS comment_ratio, 0.0::DOUBLE AS num_parens FROM base
UNION ALL
SELECT id, CAST(length(code) AS DOUBLE), 0.0, 0.0, 0.0, CAST({chars('code', '()')} AS DOUBLE) FROM ({TEXTS})""",
    "feature_cache": structural(MARKUP),
    "pair_predictions": f"""
WITH scored AS ({SCORED}), preds AS ({PREDS}), p AS (SELECT id, model, y_true, y_pred,
    CASE WHEN id % 3 = 0 AND y_proba IS NOT NULL THEN y_proba / 2 WHEN id % 2 = 0 THEN y_proba END AS y_proba FROM preds)
SELECT model || '#' || id AS id, y_true, CASE WHEN y_proba IS NULL THEN y_pred ELSE CAST(y_proba > 0.5 AS INT) END AS y_pred, y_proba FROM p""",
    "prediction_csv": f"WITH scored AS ({SCORED}), preds AS ({PREDS}) SELECT id, y_true, y_pred, y_proba, model FROM preds",
    "prediction_side_file": f"""
WITH scored AS ({SCORED})
SELECT id, y_true, CAST(s > 0.5 AS INT) AS y_pred, CASE WHEN id % 3 = 0 THEN s / 2 ELSE s END AS y_proba FROM scored""",
    "prediction_store": f"""
WITH scored AS ({SCORED}), preds AS ({PREDS})
SELECT id, y_true, CASE WHEN model = 'B' THEN 1 - y_pred ELSE y_pred END AS y_pred, y_proba, model, split FROM preds""",
    "confusion_cells": f"""
WITH {_counts()},
seen AS (SELECT DISTINCT model, split, label FROM totals)
SELECT a.model, a.split, a.label AS y_true, b.label AS y_pred, coalesce(c.n, 0) AS n
FROM seen a JOIN seen b ON a.model = b.model AND a.split = b.split
LEFT JOIN cells c ON c.model = a.model AND c.split = a.split AND c.y_true = a.label AND c.y_pred = b.label""",
    "confusion_wide": f"""
WITH {_counts()}
SELECT model, split, y_true, CAST(sum(CASE WHEN y_pred = 0 THEN n ELSE 0 END) AS BIGINT) AS pred_0,
       CAST(sum(CASE WHEN y_pred = 1 THEN n ELSE 0 END) AS BIGINT) AS pred_1 FROM cells GROUP BY ALL""",
    "confusion_heatmap": f"""
WITH {_counts()},
seen AS (SELECT DISTINCT model, split, label FROM totals),
grid AS (SELECT a.model, a.split, a.label AS y_true, b.label AS y_pred, coalesce(c.n, 0) AS n
    FROM seen a JOIN seen b ON a.model = b.model AND a.split = b.split
    LEFT JOIN cells c ON c.model = a.model AND c.split = a.split AND c.y_true = a.label AND c.y_pred = b.label)
SELECT *, n > max(n) OVER (PARTITION BY model, split) / 2.0 AS above_half FROM grid""",
    "class_metrics": f"""
WITH {_counts()}
SELECT model, split, label, CAST(tp AS BIGINT) AS tp, CAST(predicted AS BIGINT) AS predicted,
       round("precision", 6) AS "precision", round(recall, 6) AS recall, round(f1, 6) AS f1,
       CAST(support AS BIGINT) AS support FROM classes""",
    "class_report": f"""
WITH {_counts()}, rows AS (
SELECT model, split, CAST(label AS VARCHAR) AS "row", "precision", recall, f1, support FROM classes
UNION ALL SELECT model, split, 'accuracy', accuracy, accuracy, accuracy, n FROM summary
UNION ALL SELECT model, split, 'macro avg', precision_macro, recall_macro, f1_macro, n FROM summary
UNION ALL SELECT model, split, 'weighted avg', precision_weighted, recall_weighted, f1_weighted, n FROM summary)
SELECT model, split, "row", round("precision", 6) AS "precision", round(recall, 6) AS recall, round(f1, 6) AS f1,
       CAST(support AS BIGINT) AS support FROM rows""",
    "model_metrics": f"""
WITH {_counts()}
SELECT model, split, round(accuracy, 6) AS accuracy, round(f1_macro, 6) AS f1_macro,
       round(precision_macro, 6) AS precision_macro, round(recall_macro, 6) AS recall_macro,
       round(f1_weighted, 6) AS f1_weighted, round(precision_weighted, 6) AS precision_weighted,
       round(recall_weighted, 6) AS recall_weighted, CAST(n AS BIGINT) AS n FROM summary""",
    "roc_points": f"""
WITH scored AS ({SCORED}), preds AS ({PREDS}), {SWEEP}
SELECT model, split, round(threshold, 6) AS threshold, round(fpr, 6) AS fpr, round(tpr, 6) AS tpr FROM roc""",
    "pr_points": f"""
WITH scored AS ({SCORED}), preds AS ({PREDS}), {SWEEP}
SELECT model, split, round(threshold, 6) AS threshold, round("precision", 6) AS "precision", round(recall, 6) AS recall FROM pr""",
    "curve_areas": f"""
WITH scored AS ({SCORED}), preds AS ({PREDS}), {SWEEP}
SELECT model, split, round(roc_auc, 6) AS roc_auc, round(pr_auc, 6) AS pr_auc FROM areas""",
    "comparison_table": f"""
WITH {SUMMARY_ALL}
SELECT model, round(accuracy, 6) AS accuracy, round(f1_macro, 6) AS f1_macro, round(roc_auc, 6) AS roc_auc
FROM joined WHERE split = 'test'""",
    "comparison_long": f"WITH {SUMMARY_ALL} {metric_rows(['accuracy', 'f1_macro', 'roc_auc', 'pr_auc'], 'joined')}",
    "stacked_summaries": f"""
WITH {SUMMARY_ALL}
SELECT model, split, round(accuracy, 6) AS accuracy, round(f1_macro, 6) AS f1_macro, round(roc_auc, 6) AS roc_auc,
       round(pr_auc, 6) AS pr_auc FROM joined""",
    "metrics_json": f"WITH {_counts()} "
    + metric_rows(
        ["accuracy", "f1_macro", "precision_macro", "recall_macro", "f1_weighted",
         "precision_weighted", "recall_weighted", "n"], "summary"),
    "summary_csv": f"""
WITH {_counts()} SELECT model, split, round(accuracy, 6) AS accuracy, round(f1_macro, 6) AS f1_macro FROM summary""",
    "best_model": f"""
WITH {_counts()} SELECT model, round(f1_macro, 6) AS f1_macro FROM summary WHERE split = 'train'
ORDER BY summary.f1_macro DESC, model LIMIT 1""",
    "best_epoch": """
WITH history AS (SELECT source AS run, doc_id % 8 AS epoch, round(avg(n_chars % 100), 6) AS f1
                 FROM documents GROUP BY ALL),
steps AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY epoch) AS step,
    max(f1) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM history),
marked AS (SELECT *, before IS NULL OR f1 > before AS better FROM steps),
idle AS (SELECT *, step - max(CASE WHEN better THEN step END) OVER (PARTITION BY run ORDER BY step) AS wait FROM marked),
ends AS (SELECT run, coalesce(min(step) FILTER (wait >= 3), max(step)) AS epochs_run FROM idle GROUP BY run)
SELECT i.run, arg_max(epoch, step) FILTER (better) AS best_epoch, arg_max(f1, step) FILTER (better) AS best_metric,
       any_value(epochs_run) AS epochs_run
FROM idle i JOIN ends e ON i.run = e.run WHERE step <= epochs_run GROUP BY i.run""",
    "latest_checkpoint": """
WITH paths AS (SELECT source AS model, CASE WHEN doc_id % 5 = 0 THEN 0 ELSE n_chars END AS step,
    'runs/' || source || '/checkpoint-' || CASE WHEN doc_id % 5 = 0 THEN 'last' ELSE CAST(n_chars AS VARCHAR) END AS path
    FROM documents)
SELECT model, path, step FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY step DESC, path DESC) AS r FROM paths)
WHERE r = 1""",
    "ngram_counts": f"WITH {NGRAMS} SELECT id, len(g) AS n, len(list_distinct(g)) AS n_distinct FROM grams",
    "hashed_vectors": f"""
WITH {NGRAMS} SELECT id, len(g) AS total, CASE WHEN len(g) = 0 THEN 0.0 ELSE 1.0 END::DOUBLE AS square_norm FROM grams""",
    "vocab_topk": f"WITH {VOCAB} SELECT token, n, token_id FROM vocab",
    "encode_sequences": encoded(True),
    "encode_unpadded": encoded(False),
    "softmax_scores": """
WITH z AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS z FROM embeddings),
m AS (SELECT *, list_max(z) AS top FROM z)
SELECT vec_id, round(exp(z[2] - top) / list_sum(list_transform(z, lambda x: exp(x - top))), 9) AS p1,
       CAST(list_position(z, top) - 1 AS BIGINT) AS top FROM m""",
    "label_text_to_id": """
SELECT doc_id, CAST(CASE doc_id % 4 WHEN 1 THEN n_chars % 7 WHEN 3 THEN 1 ELSE 0 END AS BIGINT) AS label_id FROM documents""",
    "batch_scoring": f"""
WITH s AS (SELECT vec_id AS id, CAST(label % 2 AS INT) AS y_true,
    list_dot_product(list_transform(embedding, lambda x: CAST(x AS DOUBLE)), {WEIGHTS}) AS s FROM embeddings)
SELECT id, y_true, CAST(s > 0 AS INT) AS y_pred, round(1 / (1 + exp(-2 * s)), 6) AS y_proba FROM s""",
    "label_text_scoring": """
SELECT vec_id AS id, CAST(label % 2 AS INT) AS y_true, CAST(embedding[1] > embedding[2] AS INT) AS y_pred FROM embeddings""",
    "tree_marked_eval": f"""
WITH rows AS (SELECT n_chars % 3 > 0 AS label, {SPLIT.format('doc_id')} AS split FROM documents)
SELECT 'trees' AS model, split, {PERFECT}, count(*) AS n FROM rows WHERE split <> 'train' GROUP BY split""",
    # Every row has the same margin on its own side, which each round moves by a tenth of the gradient.
    "tree_marked_history": """
WITH RECURSIVE m AS (SELECT 1 AS iteration, 1.0::DOUBLE AS margin UNION ALL
    SELECT iteration + 1, margin + 0.1::DOUBLE * 4 / (1 + exp(2 * margin)) FROM m WHERE iteration < 200),
splits AS (SELECT DISTINCT CASE WHEN doc_id % 10 < 8 THEN 'train' ELSE 'dev' END AS split FROM documents WHERE doc_id % 10 < 9)
SELECT split, iteration, round(ln(1 + exp(-2 * margin)), 6) AS log_loss FROM m, splits""",
    "tree_marked_importance": "SELECT feature, CASE WHEN feature = 'num_semicolons' THEN 1.0 ELSE 0.0 END::DOUBLE AS importance FROM (VALUES "
    + ", ".join(f"('{n}')" for n in sorted([*LEXICAL, *LAYOUT, "num_try", "parse_error"]) if n)
    + ") AS t(feature) GROUP BY feature",
    "descent_eval": f"""
WITH rows AS (SELECT {SPLIT.format('doc_id')} AS split FROM documents)
SELECT 'descent' AS model, split, {PERFECT}, count(*) AS n FROM rows WHERE split <> 'train' GROUP BY split""",
    "fitted_model_eval": f"""
WITH rows AS (SELECT {SPLIT.format('doc_id')} AS split, n_chars % 2 AS y_pred,
    CASE WHEN doc_id % 11 = 0 THEN 1 - n_chars % 2 ELSE n_chars % 2 END AS y_true FROM documents),
sides AS (SELECT split, label, count(*) FILTER (y_true = label) AS support, count(*) FILTER (y_pred = label) AS predicted,
    count(*) FILTER (y_true = label AND y_pred = label) AS tp FROM rows, (VALUES (0), (1)) AS l(label) GROUP BY split, label),
summary AS (SELECT split, sum(tp) / sum(support)::DOUBLE AS accuracy, sum(support) AS n,
    sum(support * 2 * tp / (support + predicted)::DOUBLE) / sum(support) AS f1_weighted FROM sides WHERE support + predicted > 0 GROUP BY split)
SELECT model, split, round(accuracy, 6) AS accuracy, round(f1_weighted, 6) AS f1_weighted, CAST(n AS BIGINT) AS n, 0::BIGINT AS unlabelled
FROM summary, (VALUES ('linear'), ('tree')) AS m(model) WHERE split <> 'train'""",
    "epoch_orders": """
WITH placed AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS position, count(*) OVER () AS n FROM labels),
stepped AS (SELECT *, CAST(floor(position * 4 / n) AS BIGINT) AS step FROM placed)
SELECT e.epoch::BIGINT AS epoch, step, count(*) AS n, count(*) AS n_positions, min(position) AS lowest, max(position) AS highest,
    CAST(CASE WHEN e.epoch = 1 THEN sum(doc_id) END AS BIGINT) AS id_sum FROM stepped, (VALUES (1), (2), (3)) AS e(epoch) GROUP BY e.epoch, step""",
    "node_depth_profile": rf"""
WITH RECURSIVE tags AS (SELECT id, unnest(t) AS tag, generate_subscripts(t, 1) AS pos FROM (
    SELECT id, regexp_extract_all(code, '<(/?[a-z][^>]*)>', 1) AS t FROM ({MARKUP}))),
deep AS (SELECT *, sum(CASE WHEN tag LIKE '/%' THEN -1 ELSE 1 END) OVER (PARTITION BY id ORDER BY pos) AS level FROM tags),
opened AS (SELECT id, pos, level FROM deep WHERE tag NOT LIKE '/%'),
child AS (SELECT c.id, c.pos, max(p.pos) AS parent FROM opened c
    LEFT JOIN opened p ON p.id = c.id AND p.level = c.level - 1 AND p.pos < c.pos GROUP BY c.id, c.pos),
walk AS (SELECT id, pos, 1 AS depth FROM child WHERE parent IS NULL
    UNION ALL SELECT c.id, c.pos, w.depth + 1 FROM child c JOIN walk w ON w.id = c.id AND w.pos = c.parent)
SELECT id, count(*) AS n, CAST(max(depth) AS BIGINT) AS deepest, CAST(sum(depth) AS BIGINT) AS total_depth,
    count(*) FILTER (depth = 1) AS roots FROM walk GROUP BY id""",
    "feature_dead_letters": """
SELECT CASE WHEN doc_id % 7 = 0 THEN 'failed' ELSE 'good' END AS "row", count(*) AS n, count(*) FILTER (doc_id % 7 = 0) AS n_errors
FROM documents GROUP BY 1
UNION ALL SELECT 'SyntaxError ' || doc_id, 1, 1 FROM documents WHERE doc_id % 7 = 0""",
    "token_cache": f"SELECT id, input_ids, 1::BIGINT AS builds FROM ({encoded(False)})",
    "task_files": f"""
SELECT CASE split WHEN 'val' THEN 'dev' ELSE split END AS split, count(*) AS n, CAST(sum(label) AS BIGINT) AS ones,
    CAST(sum(id) AS BIGINT) AS id_sum, CAST(sum(length(code)) AS BIGINT) AS chars FROM ({ORIGINS}) GROUP BY split""",
    "inspect_data_job": f"""
SELECT CASE split WHEN 'val' THEN 'dev' ELSE split END AS split, label, count(*) AS n FROM ({ORIGINS}) GROUP BY ALL""",
    "train_job": f"SELECT 1.0::DOUBLE AS accuracy, 1.0::DOUBLE AS f1_macro FROM ({ORIGINS}) WHERE split = 'val' LIMIT 1",
    "score_all_job": f"""
SELECT 'linear' AS model, 1.0::DOUBLE AS accuracy, 1.0::DOUBLE AS f1_macro, false AS failed
FROM (SELECT * FROM ({ORIGINS}) WHERE split = 'test' LIMIT 1)
UNION ALL SELECT 'trees', NULL, NULL, true""",
    "report_job": f"""
WITH {SUMMARY_ALL.replace(SCORED, WHOLE)}
SELECT model, round(accuracy, 6) AS accuracy, round(f1_macro, 6) AS f1_macro, round(roc_auc, 6) AS roc_auc,
       round(pr_auc, 6) AS pr_auc, 1::BIGINT AS n_skipped FROM joined""",
    "inspect_predictions_job": f"""
WITH scored AS ({SCORED}), preds AS ({PREDS})
SELECT model, 'y_true' AS "column", CAST(y_true AS BIGINT) AS value, count(*) AS n FROM preds GROUP BY ALL
UNION ALL SELECT model, 'y_pred', y_pred, count(*) FROM preds GROUP BY ALL""",
    "evaluate_csv_job": f"""
WITH {_counts().replace(SCORED, WHOLE)}
SELECT round(accuracy, 6) AS accuracy, round(f1_macro, 6) AS f1_macro, round(precision_macro, 6) AS precision_macro,
       round(recall_macro, 6) AS recall_macro FROM summary WHERE model = 'B'""",
    "compare_models_job": f"""
WITH {_counts()}, wanted AS (SELECT * FROM summary WHERE model <> 'B' AND split <> 'train')
{metric_rows(['accuracy', 'f1_weighted'], 'wanted')}""",
}
