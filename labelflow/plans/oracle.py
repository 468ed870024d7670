"""DuckDB oracle SQL for the query catalogue.

Each query is ANSI-style SQL over the pre-registered views (documents,
labels, embeddings, events, ...). Shared steps are CTE chains generated
here; column names and types equal the Spark queries'. The split oracle is
the plain form -- ``row_number() over (partition by label order by md5,
row_id)`` against quotas computed in SQL -- the definition that the
bucketed Spark operator must reproduce.
"""

from __future__ import annotations

from ..constants import BATCH_ROWS, LABELS, MAX_FEATURES, MAX_LENGTH, NA_TOKENS
from .base import CANDIDATES, IDEOGRAPHIC_SPACE, NBSP, RULE_MODELS, UNKNOWN_EVERY

# RE2 twin of the strip characters (RE2's \s lacks \v and U+0085).
_WS = r"[\s\x0b\p{Z}\x{85}\x1c-\x1f]"
STRIP_RE2 = f"^{_WS}+|{_WS}+$"
WORD_RE2 = r"[\p{L}\p{N}_]{2,}"


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _strip(expr: str) -> str:
    return f"regexp_replace({expr}, {_q(STRIP_RE2)}, '', 'g')"


LABEL_LIST = ", ".join(_q(x) for x in LABELS)
SWEEP_NAMES = "('lr_c1'), ('lr_c0.1'), ('lr_c10_it50'), ('lr_prior')"
LABEL_VALUES = ", ".join(f"({_q(x)})" for x in LABELS)
NA_LIST = ", ".join(_q(x) for x in NA_TOKENS)
LABEL_IDX = "CASE {c} " + " ".join(f"WHEN {_q(x)} THEN {i}" for i, x in enumerate(LABELS)) + " END"
MODEL_ORD = "CASE model " + " ".join(f"WHEN {_q(m)} THEN {i + 1}" for i, m in enumerate(RULE_MODELS)) + " END"

CANDIDATE_ORD = "CASE model " + " ".join(f"WHEN {_q(m)} THEN {i + 1}" for i, m in enumerate(CANDIDATES)) + " END"

LAB = """lab AS (
  SELECT d.doc_id AS row_id, d.text, d.lang AS language,
         CASE WHEN l.toxic = 1 THEN 'negative' WHEN l.quality = 1 THEN 'positive' ELSE 'neutral' END AS label,
         d.n_chars
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""

RAW = f"""raw AS (
  SELECT row_id, language, n_chars,
    CASE row_id % 13 WHEN 1 THEN NULL WHEN 2 THEN 'NA' WHEN 3 THEN '' WHEN 4 THEN ' \t '
      WHEN 5 THEN '{NBSP}' || text || ' {IDEOGRAPHIC_SPACE}' WHEN 6 THEN 'null'
      WHEN 7 THEN '  ' || text || '\n' ELSE text END AS text,
    CASE row_id % 11 WHEN 1 THEN '  ' || upper(label) || ' ' WHEN 2 THEN 'Unknown' WHEN 3 THEN NULL
      WHEN 4 THEN 'N/A' WHEN 5 THEN upper(substr(label, 1, 1)) || substr(label, 2, 100) || '{NBSP}'
      ELSE label END AS label
  FROM lab)"""

NA = f"""na AS (
  SELECT row_id, language,
    CASE WHEN text IN ({NA_LIST}) THEN NULL ELSE text END AS text,
    CASE WHEN label IN ({NA_LIST}) THEN NULL ELSE label END AS label
  FROM raw),
dn AS (SELECT * FROM na WHERE text IS NOT NULL AND label IS NOT NULL),
cl AS (SELECT row_id, language, {_strip('text')} AS text, lower({_strip('label')}) AS label FROM dn),
nb AS (SELECT * FROM cl WHERE text <> ''),
enc AS (SELECT row_id, text, label, CAST({LABEL_IDX.format(c='label')} AS INTEGER) AS label_id FROM nb)"""

PREDS = f"""R0 AS (
  SELECT row_id, text, language, label, 'm_len' AS model,
         CASE WHEN n_chars < 800 THEN 'negative' WHEN n_chars < 2000 THEN 'neutral' ELSE 'positive' END
           AS predicted_label FROM lab
  UNION ALL
  SELECT row_id, text, language, label, 'm_mod' AS model,
         CASE row_id % 3 WHEN 0 THEN 'negative' WHEN 1 THEN 'neutral' ELSE 'positive' END FROM lab
  UNION ALL
  SELECT row_id, text, language, label, 'm_const' AS model, 'positive' FROM lab),
R AS (SELECT * REPLACE (CASE WHEN row_id % {UNKNOWN_EVERY} = 0 THEN 'unknown' ELSE label END AS label) FROM R0)"""


def eval_chain(p: str, src: str, keys: tuple[str, ...] = ("model",)) -> str:
    """CTEs {p}cnt {p}conf {p}cm {p}cmo {p}cmx {p}acc {p}wt {p}mac {p}rep {p}met over ``src``."""
    k = ", ".join(keys)
    kk = lambda a: ", ".join(f"{a}.{x}" for x in keys)
    on = " AND ".join(f"g.{x} = c.{x}" for x in keys)
    return f"""{p}cnt AS (SELECT {k}, label, predicted_label, count(*) AS n FROM {src}
              GROUP BY {k}, label, predicted_label),
{p}grid AS (SELECT {kk('m')}, a.l AS label, b.l AS predicted_label
            FROM (SELECT DISTINCT {k} FROM {p}cnt) m CROSS JOIN (VALUES {LABEL_VALUES}) a(l)
            CROSS JOIN (VALUES {LABEL_VALUES}) b(l)),
{p}conf AS (SELECT {kk('g')}, g.label, g.predicted_label, CAST(coalesce(c.n, 0) AS BIGINT) AS n
            FROM {p}grid g LEFT JOIN {p}cnt c
            ON {on} AND g.label = c.label AND g.predicted_label = c.predicted_label),
{p}cm AS (SELECT {k}, c, sum(support) AS support, sum(predicted) AS predicted, sum(tp) AS tp FROM (
            SELECT {k}, label AS c, n AS support, 0 AS predicted,
                   CASE WHEN label = predicted_label THEN n ELSE 0 END AS tp FROM {p}cnt
            UNION ALL SELECT {k}, predicted_label AS c, 0, n, 0 FROM {p}cnt) t WHERE c IS NOT NULL GROUP BY {k}, c),
{p}cmo AS (SELECT {k}, c AS label, coalesce(tp::DOUBLE / nullif(predicted, 0), 0.0) AS precision,
            coalesce(tp::DOUBLE / nullif(support, 0), 0.0) AS recall,
            coalesce(2 * tp::DOUBLE / nullif(predicted + support, 0), 0.0) AS f1_score,
            support::DOUBLE AS support FROM {p}cm),
{p}cmx AS (SELECT {kk('g')}, g.c AS label, CAST({LABEL_IDX.format(c='g.c')} AS INTEGER) AS class_idx,
            coalesce(precision, 0.0) AS precision, coalesce(recall, 0.0) AS recall,
            coalesce(f1_score, 0.0) AS f1_score, coalesce(support, 0.0) AS support
           FROM (SELECT {kk('m')}, a.l AS c FROM (SELECT DISTINCT {k} FROM {p}cnt) m
                 CROSS JOIN (VALUES {LABEL_VALUES}) a(l)) g LEFT JOIN {p}cmo c ON {on} AND g.c = c.label),
{p}acc AS (SELECT {k}, coalesce(sum(CASE WHEN label = predicted_label THEN n ELSE 0 END)::DOUBLE
            / nullif(sum(n), 0), 0.0) AS accuracy FROM {p}cnt GROUP BY {k}),
{p}wt AS (SELECT {k}, coalesce(sum(precision * support) / nullif(sum(support), 0), 0.0) AS precision_weighted,
            coalesce(sum(recall * support) / nullif(sum(support), 0), 0.0) AS recall_weighted,
            coalesce(sum(f1_score * support) / nullif(sum(support), 0), 0.0) AS f1_weighted
          FROM {p}cmx GROUP BY {k}),
{p}wto AS (SELECT {k}, coalesce(sum(precision * support) / nullif(sum(support), 0), 0.0) AS precision_weighted,
            coalesce(sum(recall * support) / nullif(sum(support), 0), 0.0) AS recall_weighted,
            coalesce(sum(f1_score * support) / nullif(sum(support), 0), 0.0) AS f1_weighted
          FROM {p}cmo GROUP BY {k}),
{p}mac AS (SELECT {k}, avg(precision) AS precision_macro, avg(recall) AS recall_macro,
            avg(f1_score) AS f1_macro, sum(support) AS support FROM {p}cmx GROUP BY {k}),
{p}rep AS (
  SELECT {k}, label AS row_name, class_idx AS row_idx, precision, recall, f1_score, support FROM {p}cmx
  UNION ALL SELECT {k}, 'accuracy', {len(LABELS)}, accuracy, accuracy, accuracy, accuracy FROM {p}acc
  UNION ALL SELECT {k}, 'macro avg', {len(LABELS) + 1}, precision_macro, recall_macro, f1_macro, support
            FROM {p}mac
  UNION ALL SELECT {kk('w')}, 'weighted avg', {len(LABELS) + 2}, precision_weighted, recall_weighted,
            f1_weighted, m.support FROM {p}wt w JOIN {p}mac m USING ({k})),
{p}met AS (SELECT {kk('a')}, round(a.accuracy, 4) AS accuracy, round(w.precision_weighted, 4) AS precision_weighted,
            round(w.recall_weighted, 4) AS recall_weighted, round(w.f1_weighted, 4) AS f1_weighted
          FROM {p}acc a JOIN {p}wto w USING ({k}))"""


def _quota_chain(p: str, cnt: str, frac: float, out: str, carry: str = "") -> str:
    """Largest-remainder quotas: ``{p}{out}`` per label from counts ``c`` in ``{cnt}``."""
    return f"""{p}t1 AS (SELECT *, sum(c) OVER () AS n FROM {cnt}),
{p}t2 AS (SELECT *, n - CAST(ceil(CAST({frac!r} AS DOUBLE) * n) AS BIGINT) AS n_keep FROM {p}t1),
{p}t3 AS (SELECT *, CAST(c AS DOUBLE) / n * n_keep AS cont FROM {p}t2),
{p}t4 AS (SELECT *, floor(cont) AS fl FROM {p}t3),
{p}t5 AS (SELECT *, n_keep - sum(fl) OVER () AS need,
                 row_number() OVER (ORDER BY cont - fl DESC, label) AS rr FROM {p}t4),
{p}q AS (SELECT label, c{carry}, CAST(fl AS BIGINT) + CASE WHEN rr <= need THEN 1 ELSE 0 END AS {out}
         FROM {p}t5)"""


def _rank(p: str, src: str) -> str:
    return f"""{p}rk AS (SELECT s.*, row_number() OVER (PARTITION BY label
        ORDER BY md5(concat_ws('-', '42', CAST(row_id AS VARCHAR))), row_id) AS rk FROM {src} s)"""


def split2_chain(p: str, src: str) -> str:
    """{p}S: ``src`` + split (train / test), test_size 0.3, seed 42."""
    return f"""{p}cnt AS (SELECT label, count(*) AS c FROM {src} GROUP BY label),
{_quota_chain(p + 'a', p + 'cnt', 0.3, 'q_train')},
{_rank(p, src)},
{p}S AS (SELECT r.* EXCLUDE (rk), CASE WHEN rk <= q_train THEN 'train' ELSE 'test' END AS split
         FROM {p}rk r JOIN {p}aq USING (label))"""


def split3_chain(p: str, src: str) -> str:
    """{p}S: ``src`` + split (train / val / test): 0.3 held out, then half of it."""
    return f"""{p}cnt AS (SELECT label, count(*) AS c FROM {src} GROUP BY label),
{_quota_chain(p + 'a', p + 'cnt', 0.3, 'q_train')},
{p}rest AS (SELECT label, c - q_train AS c, q_train FROM {p}aq),
{_quota_chain(p + 'b', p + 'rest', 0.5, 'q_val', carry=', q_train')},
{_rank(p, src)},
{p}S AS (SELECT r.* EXCLUDE (rk), CASE WHEN rk <= q_train THEN 'train'
           WHEN rk <= q_train + q_val THEN 'val' ELSE 'test' END AS split
         FROM {p}rk r JOIN {p}bq USING (label))"""


def prior_chain(p: str, src: str, fit_on: str, evaluate_on: str, models: str) -> str:
    """{p}R: predictions of models that know the classes' shares alone: the commonest class of their training rows."""
    return f"""{p}top AS (SELECT label AS predicted_label FROM {src} WHERE split IN ({fit_on}) GROUP BY label
            ORDER BY count(*) DESC, label LIMIT 1),
{p}R AS (SELECT model, row_id, label, predicted_label FROM {src}, {p}top, ({models}) m WHERE split IN ({evaluate_on}))"""


def terms_chain(p: str, src: str) -> str:
    """{p}tok (word tokens), {p}trm (1-2 grams), {p}tc (row_id, term, tf)."""
    return f"""{p}tok AS (SELECT row_id, regexp_extract_all(lower(text), {_q(WORD_RE2)}) AS t FROM {src}),
{p}trm AS (SELECT row_id, list_concat(t, list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]))
             AS terms FROM {p}tok),
{p}tc AS (SELECT row_id, term, count(*) AS tf FROM (SELECT row_id, unnest(terms) AS term FROM {p}trm) u
          GROUP BY row_id, term)"""


def tfidf_chain(p: str, fit_src: str, apply_src: str, k: int = MAX_FEATURES) -> str:
    """{p}voc (term, tf_total, df, rank), {p}idf, {p}w (row_id, term, weight)."""
    return f"""{terms_chain(p + 'f', fit_src)},
{p}voc0 AS (SELECT term, CAST(sum(tf) AS BIGINT) AS tf_total, count(*) AS df FROM {p}ftc GROUP BY term
            ORDER BY tf_total DESC, term LIMIT {k}),
{p}voc AS (SELECT *, row_number() OVER (ORDER BY tf_total DESC, term) AS rank FROM {p}voc0),
{p}n AS (SELECT count(*) AS n FROM {fit_src}),
{p}idf AS (SELECT term, df, ln((1 + n)::DOUBLE / (1 + df)) + 1 AS idf FROM {p}voc, {p}n),
{terms_chain(p + 'a', apply_src)},
{p}w0 AS (SELECT row_id, term, tf * idf AS w FROM {p}atc JOIN {p}idf USING (term)),
{p}w AS (SELECT row_id, term, coalesce(w / nullif(sqrt(sum(w * w) OVER (PARTITION BY row_id)), 0), 0.0)
           AS weight FROM {p}w0)"""


def encode_chain(p: str, src: str, max_len: str) -> str:
    """{p}out: (row_id, input_ids, attention_mask) as space-joined strings."""
    return f"""{p}tok AS (SELECT row_id, regexp_extract_all(lower(text), {_q(WORD_RE2)}) AS t FROM {src}),
{p}wv AS (SELECT term, count(*) AS tf_total FROM (SELECT unnest(t) AS term FROM {p}tok) u GROUP BY term
          ),
{p}wvi AS (SELECT term, CAST(row_number() OVER (ORDER BY tf_total DESC, term) + 1 AS INTEGER) AS id FROM {p}wv),
{p}ml AS (SELECT {max_len} AS ml),
{p}etk AS (SELECT row_id, unnest(t[1:ml]) AS term, generate_subscripts(t[1:ml], 1) AS pos FROM {p}tok, {p}ml),
{p}eid AS (SELECT e.row_id, list(coalesce(v.id, 1) ORDER BY e.pos) AS ids
           FROM {p}etk e LEFT JOIN {p}wvi v USING (term) GROUP BY e.row_id),
{p}enc AS (SELECT s.row_id, coalesce(e.ids, CAST([] AS INTEGER[])) AS ids FROM {src} s LEFT JOIN {p}eid e USING (row_id)),
{p}out AS (SELECT row_id,
  array_to_string(list_concat(ids, list_transform(range(greatest(ml - len(ids), 0)), lambda x: 0)), ' ')
    AS input_ids,
  array_to_string(list_concat(list_transform(ids, lambda x: 1),
    list_transform(range(greatest(ml - len(ids), 0)), lambda x: 0)), ' ') AS attention_mask
  FROM {p}enc, {p}ml)"""


def batch_chain(p: str, src: str, max_len: int, rows: int) -> str:
    """{p}out: encodings in batches of ``rows`` by (length, row_id), each as wide as its longest text."""
    return f"""{encode_chain(p + 'f', src, str(max_len))},
{p}sz AS (SELECT row_id, ids, len(ids) AS size FROM {p}fenc),
{p}bt AS (SELECT *, (row_number() OVER (ORDER BY size, row_id) - 1) // {rows} AS batch FROM {p}sz),
{p}wd AS (SELECT *, CAST(max(size) OVER (PARTITION BY batch) AS INTEGER) AS width FROM {p}bt),
{p}out AS (SELECT row_id, batch, width,
  array_to_string(list_concat(ids, list_transform(range(width - size), lambda x: 0)), ' ') AS input_ids,
  array_to_string(list_concat(list_transform(ids, lambda x: 1), list_transform(range(width - size), lambda x: 0)), ' ')
    AS attention_mask FROM {p}wd)"""


SCORE = "lg AS (SELECT vec_id, label, " + ", ".join(
    f"list_sum(list_transform(embedding, lambda x, i: x::DOUBLE * (((7 * (i - 1) + {13 * k}) % 17) - 8) / 8.0)) AS l{k}"
    for k in range(3)) + """ FROM embeddings),
ex AS (SELECT *, exp(l0 - greatest(l0, l1, l2)) AS e0, exp(l1 - greatest(l0, l1, l2)) AS e1,
              exp(l2 - greatest(l0, l1, l2)) AS e2 FROM lg),
pr AS (SELECT vec_id, label, l0, l1, l2, e0 / (e0 + e1 + e2) AS p0, e1 / (e0 + e1 + e2) AS p1, e2 / (e0 + e1 + e2) AS p2
       FROM ex),
am AS (SELECT *, CAST(CASE WHEN p0 >= p1 AND p0 >= p2 THEN 0 WHEN p1 >= p2 THEN 1 ELSE 2 END AS INTEGER)
              AS class_id FROM pr),
sc AS (SELECT *, CASE class_id WHEN 0 THEN 'negative' WHEN 1 THEN 'neutral' ELSE 'positive' END
              AS predicted_label FROM am)"""

BEST = f"""metord AS (SELECT *, CAST({CANDIDATE_ORD} AS INTEGER) AS ordinal FROM met
           WHERE {CANDIDATE_ORD} IS NOT NULL),
best AS (SELECT model, ordinal, f1_weighted FROM metord
         WHERE f1_weighted IS NOT NULL AND NOT isnan(f1_weighted)
         ORDER BY round(f1_weighted, 4) DESC, ordinal LIMIT 1)"""


def W(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


EV = W(LAB, PREDS, eval_chain("", "R"))
EVB = W(LAB, PREDS, eval_chain("", "R"), BEST)
S3 = split3_chain("s", "lab")
TRAIN = "trn AS (SELECT * FROM sS WHERE split = 'train')"


def _r6(cols):
    return ", ".join(f"round({c}, 6) AS {c}" for c in cols)


ORACLE: dict[str, str] = {
    # ingest
    "load_labelled": W(LAB) + "SELECT row_id, text, language, label FROM lab",
    "na_tokens": W(LAB, RAW, NA) + "SELECT row_id, text, label FROM na",
    "drop_null": W(LAB, RAW, NA) + "SELECT row_id, text, label FROM dn",
    "clean_text": W(LAB, RAW, NA) + f"SELECT row_id, {_strip('text')} AS text FROM dn",
    "normalise_label": W(LAB, RAW, NA) + f"SELECT row_id, lower({_strip('label')}) AS label FROM dn",
    "non_blank": W(LAB, RAW, NA) + "SELECT row_id, text, label FROM nb",
    "invalid_labels": W(LAB, RAW, NA) + f"SELECT row_id, label FROM nb WHERE label NOT IN ({LABEL_LIST})",
    "project_rename": W(LAB, RAW, NA) + f"SELECT text, label_id AS label FROM enc WHERE label IN ({LABEL_LIST})",
    "label_encode": W(LAB, RAW, NA) + "SELECT row_id, label, label_id FROM enc",
    "label_decode": W(LAB, RAW, NA) + "SELECT row_id, label_id, CASE label_id "
    + " ".join(f"WHEN {i} THEN {_q(x)}" for i, x in enumerate(LABELS)) + " END AS label_decoded FROM enc",
    "read_split": W(LAB, S3) + "SELECT row_id, label, split FROM sS WHERE split = 'val'",
    "json_field": "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events",
    # distribution / split
    "class_distribution": W(LAB) + "SELECT label, count(*) AS n FROM lab GROUP BY label",
    "distinct_labels": W(LAB) + "SELECT DISTINCT label FROM lab",
    "label_except": W(LAB, RAW, NA) + f"SELECT DISTINCT lower({_strip('label')}) AS label FROM dn "
    f"WHERE lower({_strip('label')}) NOT IN ({LABEL_LIST})",
    "stratified_split": W(LAB, split2_chain("s", "lab")) + "SELECT row_id, label, split FROM sS",
    "split_70_15_15": W(LAB, S3) + "SELECT row_id, label, split FROM sS",
    "split_sizes": W(LAB, S3) + "SELECT split, count(*) AS n FROM sS GROUP BY split",
    "train_val_union": W(LAB, S3) + "SELECT row_id, label, split FROM sS WHERE split IN ('train', 'val')",
    # evaluate
    "attach_prediction": W(LAB, PREDS) + "SELECT row_id, label, model, predicted_label FROM R",
    "join_truth_prediction": W(LAB, PREDS) + "SELECT l.row_id, l.label, r.model, r.predicted_label "
    "FROM lab l JOIN R r ON l.row_id = r.row_id",
    "is_correct": W(LAB, PREDS) + "SELECT row_id, model, coalesce(label = predicted_label, false) AS is_correct FROM R",
    "errors_only": W(LAB, PREDS) + "SELECT row_id, model, label, predicted_label FROM R "
    "WHERE NOT coalesce(label = predicted_label, false)",
    "confusion_long": EV + "SELECT model, label, predicted_label, n FROM conf",
    "confusion_wide": EV + "SELECT model, label, "
    + ", ".join(f"CAST(sum(CASE WHEN predicted_label = {_q(x)} THEN n ELSE 0 END) AS BIGINT) AS {x}" for x in LABELS)
    + " FROM conf GROUP BY model, label",
    "accuracy": EV + "SELECT model, round(accuracy, 6) AS accuracy FROM acc",
    "class_metrics": EV + "SELECT model, label, " + _r6(["precision", "recall", "f1_score", "support"]) + " FROM cmx",
    "weighted_metrics": EV + "SELECT model, " + _r6(["precision_weighted", "recall_weighted", "f1_weighted"])
    + " FROM wt",
    "macro_metrics": EV + "SELECT model, " + _r6(["precision_macro", "recall_macro", "f1_macro", "support"])
    + " FROM mac",
    "classification_report": EV + "SELECT model, row_name, row_idx, "
    + _r6(["precision", "recall", "f1_score", "support"]) + " FROM rep",
    "metrics_record": EV + "SELECT model, accuracy, precision_weighted, recall_weighted, f1_weighted FROM met",
    "metrics_by_split": W(LAB, PREDS, S3, "RS AS (SELECT R.*, s.split FROM R JOIN sS s USING (row_id))",
                          eval_chain("", "RS", ("model", "split")))
    + "SELECT model, split, accuracy, precision_weighted, recall_weighted, f1_weighted FROM met",
    "round4": EV + "SELECT model, label, round(precision, 4) AS precision, round(recall, 4) AS recall, "
    "round(f1_score, 4) AS f1_score FROM cmx",
    # compare
    "results_summary": EVB + 'SELECT ordinal, model AS "Модель", accuracy AS "Accuracy", '
    'precision_weighted AS "Precision", recall_weighted AS "Recall", f1_weighted AS "F1-score" FROM metord',
    "best_model": EVB + "SELECT model, ordinal, f1_weighted FROM best",
    "best_model_rows": EVB + "SELECT row_id, model, label, predicted_label FROM R "
    "WHERE model = (SELECT model FROM best)",
    "best_model_class_table": EVB + 'SELECT row_idx, row_name AS "Класс", round(precision, 6) AS "Precision", '
    'round(recall, 6) AS "Recall", round(f1_score, 6) AS "F1-score" FROM rep '
    f"WHERE model = (SELECT model FROM best) AND row_name IN ({LABEL_LIST})",
    "class_rows": EV + "SELECT model, row_name, row_idx, " + _r6(["precision", "recall", "f1_score"])
    + f" FROM rep WHERE row_name IN ({LABEL_LIST})",
    "verification_sample": EVB + """, flag AS (SELECT row_id, label, predicted_label,
        coalesce(label = predicted_label, false) AS is_correct FROM R WHERE model = (SELECT model FROM best))
      SELECT * FROM (SELECT *, 'correct' AS example_type FROM flag WHERE is_correct ORDER BY row_id LIMIT 5) a
      UNION ALL
      SELECT * FROM (SELECT *, 'incorrect' AS example_type FROM flag WHERE NOT is_correct ORDER BY row_id LIMIT 5) b""",
    "head_n": W(LAB) + "SELECT row_id, language, label FROM lab ORDER BY row_id LIMIT 5",
    "frame_model_metric": EV + "SELECT model, 'accuracy' AS metric, accuracy AS value FROM met "
    "UNION ALL SELECT model, 'f1_weighted' AS metric, f1_weighted AS value FROM met",
    "frame_config_f1": EV + "SELECT CASE model WHEN 'm_len' THEN 'length rule' WHEN 'm_mod' THEN 'modulo rule' "
    f"WHEN 'm_const' THEN 'constant' END AS config, CAST({MODEL_ORD} AS INTEGER) AS ordinal, f1_weighted FROM met",
    "frame_confusion_cells": EVB + f"SELECT CAST({LABEL_IDX.format(c='label')} AS INTEGER) AS row_idx, "
    f"CAST({LABEL_IDX.format(c='predicted_label')} AS INTEGER) AS col_idx, label, predicted_label, n FROM conf "
    "WHERE model = (SELECT model FROM best)",
    # features
    "tokenize_words": "WITH d AS (SELECT doc_id AS row_id, text FROM documents), "
    + terms_chain("", "d") + " SELECT row_id, len(t) AS n_tokens, array_to_string(t, ' ') AS tokens FROM tok",
    "ngrams_1_2": W(LAB, terms_chain("", "lab"))
    + "SELECT row_id, len(terms) AS n_terms, array_to_string(terms, '|') AS terms FROM trm",
    "term_counts": W(LAB, terms_chain("", "lab")) + "SELECT row_id, term, tf FROM tc",
    "vocabulary_topk": W(LAB, S3, "trn AS (SELECT * FROM sS WHERE split = 'train')", tfidf_chain("v", "trn", "trn"))
    + "SELECT term, tf_total, df, rank FROM vvoc",
    "vocabulary_threshold": W(LAB, S3, TRAIN, tfidf_chain("v", "trn", "trn")) + "SELECT term, tf_total, df, rank FROM vvoc",
    "tfidf_fit_large": W(LAB, S3, TRAIN, tfidf_chain("v", "trn", "trn", 1_000_000))
    + "SELECT row_id, term, round(weight, 6) AS weight FROM vw",
    "tfidf_transform_large": W(LAB, S3, TRAIN, "tst AS (SELECT * FROM sS WHERE split = 'test')",
                               tfidf_chain("v", "trn", "tst", 1_000_000))
    + "SELECT row_id, term, round(weight, 6) AS weight FROM vw",
    "idf": W(LAB, S3, "trn AS (SELECT * FROM sS WHERE split = 'train')", tfidf_chain("v", "trn", "trn"))
    + "SELECT term, df, round(idf, 6) AS idf FROM vidf",
    "tfidf": W(LAB, tfidf_chain("v", "lab", "lab")) + "SELECT row_id, term, round(weight, 6) AS weight FROM vw",
    "tfidf_fit": W(LAB, S3, "trn AS (SELECT * FROM sS WHERE split = 'train')", tfidf_chain("v", "trn", "trn"))
    + "SELECT row_id, term, round(weight, 6) AS weight FROM vw",
    "tfidf_transform": W(LAB, S3, "trn AS (SELECT * FROM sS WHERE split = 'train')",
                         "tst AS (SELECT * FROM sS WHERE split = 'test')", tfidf_chain("v", "trn", "tst"))
    + "SELECT row_id, term, round(weight, 6) AS weight FROM vw",
    "encode_fixed_length": W(LAB, encode_chain("e", "lab", str(MAX_LENGTH)))
    + "SELECT row_id, input_ids, attention_mask FROM eout",
    "encode_longest": W(LAB, encode_chain(
        "e", "lab",
        f"(SELECT least({MAX_LENGTH}, max(len(regexp_extract_all(lower(text), {_q(WORD_RE2)})))) FROM lab)"))
    + "SELECT row_id, input_ids, attention_mask FROM eout",
    "encode_batches": W(LAB, batch_chain("e", "lab", MAX_LENGTH, BATCH_ROWS))
    + "SELECT row_id, batch, width, input_ids, attention_mask FROM eout",
    # score
    "softmax": W(SCORE) + "SELECT vec_id, round(p0, 6) AS p0, round(p1, 6) AS p1, round(p2, 6) AS p2 FROM sc",
    "argmax_class": W(SCORE) + "SELECT vec_id, class_id, predicted_label FROM sc",
    "prob_map": W(SCORE) + " ".join(
        ("UNION ALL " if i else "") + f"SELECT vec_id, {_q(x)} AS label, round(p{i}, 4) AS prob FROM sc"
        for i, x in enumerate(LABELS)),
    "blank_guard": W(LAB, RAW) + f"""SELECT row_id,
        CASE WHEN coalesce({_strip('text')}, '') = '' THEN NULL
             WHEN n_chars < 800 THEN 'negative' WHEN n_chars < 2000 THEN 'neutral' ELSE 'positive' END
          AS predicted_label,
        CASE WHEN coalesce({_strip('text')}, '') = '' THEN 'empty_input' ELSE 'ok' END AS status FROM raw""",
    "linear_score": W(SCORE) + "SELECT vec_id, label AS true_class, predicted_label, "
    "round(list_sort([l0, l1, l2])[3] - list_sort([l0, l1, l2])[2], 6) AS margin, "
    "round(greatest(p0, p1, p2), 6) AS p_max FROM sc",
    # models: what must hold of a fitted model's output, whatever its weights
    "lr_fit_predict": W(LAB, S3) + "SELECT row_id, label, true AS known_label, 0.0 AS gradient FROM sS "
    "WHERE split = 'test'",
    "score_batch": "SELECT doc_id AS row_id, CASE WHEN blank THEN 'empty_input' ELSE 'ok' END AS status, "
    "NOT blank AS labelled, CASE WHEN blank THEN 0.0 ELSE 1.0 END AS p_sum FROM (SELECT doc_id, "
    + f"coalesce({_strip('text')}, '') = '' AS blank FROM documents)",
    "score_stream": "SELECT count(*) AS n_rows, 0 AS n_different FROM documents",
    "save_load": "SELECT count(*) AS n_rows, 0 AS n_different FROM documents",
    "experiment_sweep": W(LAB, S3, prior_chain("p", "sS", "'train'", "'val'", "SELECT 'lr_prior' AS model"),
                          eval_chain("", "pR"))
    + "SELECT m.model, (SELECT count(*) FROM pR) AS n_rows, 0 AS n_unknown, 0.0 AS gradient, f1_weighted AS prior_f1 "
    f"FROM (VALUES {SWEEP_NAMES}) m(model) LEFT JOIN met ON m.model = met.model",
    "run_rounds": W(LAB, S3, prior_chain("p", "sS", "'train'", "'val'", f"SELECT * FROM (VALUES {SWEEP_NAMES}) m(model)"),
                    "share AS (SELECT label, count(*) * 1.0 / sum(count(*)) OVER () AS p FROM sS WHERE split = 'train' GROUP BY label)",
                    "loss AS (SELECT -avg(ln(p)) AS loss FROM sS JOIN share USING (label) WHERE split = 'val')",
                    eval_chain("", "pR"))
    + "SELECT model AS run, accuracy AS accuracy_0, round(loss, 6) AS loss_0, f1_weighted AS f1_0, true AS best_is_highest, "
    "true AS best_restored, true AS loss_fell FROM met, loss",
    "evaluate_stream": W(LAB, S3, prior_chain("p", "sS", "'train'", "'val', 'test'", "SELECT * FROM (VALUES ('stream'), ('batch')) m(model)"),
                         eval_chain("", "pR"))
    + "SELECT model, accuracy, precision_weighted, recall_weighted, f1_weighted FROM met",
    "experiment_outputs": W(LAB, RAW, NA, f"good AS (SELECT row_id, label FROM nb WHERE label IN ({LABEL_LIST}))",
                            split3_chain("s", "good"),
                            prior_chain("a", "sS", "'train'", "'test'", "SELECT 'baseline' AS model"),
                            prior_chain("b", "sS", "'train', 'val'", "'test'", "SELECT 'tuned' AS model"),
                            "RR AS (SELECT * FROM aR UNION ALL SELECT * FROM bR)", eval_chain("", "RR"))
    + " UNION ALL ".join(
        [f"SELECT model, 'metrics' AS result, model AS key1, '{c}' AS key2, {c} AS value FROM met"
         for c in ("accuracy", "precision_weighted", "recall_weighted", "f1_weighted")]
        + [f"SELECT model, 'report', row_name, '{c}', round({c}, 6) FROM rep"
           for c in ("precision", "recall", "f1_score", "support")]
        + ["SELECT model, 'confusion', label, predicted_label, n FROM conf",
           "SELECT model, 'predictions', CAST(row_id AS VARCHAR), predicted_label, 1.0 FROM RR"]),
    "experiment_tuned": W(LAB, S3) + f"""SELECT result, n_rows FROM (VALUES ('metrics', 1), ('report', {len(LABELS) + 3}),
        ('confusion', {len(LABELS) ** 2})) v(result, n_rows)
      UNION ALL SELECT 'predictions', count(*) FROM sS WHERE split = 'test'""",
    "baseline_end_to_end": W(LAB, RAW, NA, "good AS (SELECT row_id, label FROM nb "
                             f"WHERE label IN ({LABEL_LIST}))", split3_chain("s", "good"))
    + f"""SELECT result, n_rows FROM (VALUES ('metrics', 1), ('report', {len(LABELS) + 3}),
        ('confusion', {len(LABELS) ** 2})) v(result, n_rows)
      UNION ALL SELECT 'predictions', count(*) FROM sS WHERE split = 'test'""",
    # files
    "prediction_csv": W(LAB, PREDS) + "SELECT row_id, language, label, model, predicted_label FROM R",
    "summary_csv": EVB + 'SELECT ordinal, model AS "Модель", accuracy AS "Accuracy", '
    'precision_weighted AS "Precision", recall_weighted AS "Recall", f1_weighted AS "F1-score" FROM metord',
    "run_titles": EV + "SELECT model, model || ' (accuracy ' || format('{:.4f}', accuracy) || ')' AS title, "
    "model || '_metrics.json' AS metrics_file, model || '_predictions.csv' AS predictions_file FROM met",
    "file_order_ids": W(LAB) + "SELECT row_number() OVER (ORDER BY row_id) - 1 AS place, row_id, label FROM lab",
    "rejects_by_reason": W(LAB, RAW, NA, f"""why AS (SELECT CASE WHEN text IS NULL THEN 'null_text' WHEN label IS NULL THEN 'null_label'
        WHEN {_strip('text')} = '' THEN 'blank_text' WHEN lower({_strip('label')}) NOT IN ({LABEL_LIST}) THEN 'unknown_label'
        ELSE 'none' END AS reason FROM na)""")
    + "SELECT reason, count(*) AS n_rows, count(*) AS n_counted FROM why GROUP BY reason",
    "csv_round_trip": W(LAB, RAW, NA) + "SELECT row_id, language, text, label FROM na",
    "keyed_report_csv": EV + "SELECT row_name, " + _r6(["precision", "recall", "f1_score", "support"])
    + f" FROM rep WHERE model = {_q(RULE_MODELS[0])}",
    "metrics_gather": EV + f"SELECT model, accuracy, precision_weighted, recall_weighted, f1_weighted, "
    f"CAST({MODEL_ORD} AS INTEGER) AS ordinal FROM met",
    "run_history_best_step": """WITH e AS (SELECT user_id AS run, event_id AS step, round(value, 3) AS f1 FROM events),
      r AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY f1 DESC, step) AS k FROM e)
      SELECT run, step AS best_step, round(f1, 6) AS best_metric FROM r WHERE k = 1""",
}
