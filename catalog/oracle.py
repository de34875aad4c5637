"""The registered queries in plain SQL, over views of the given tables.

Written independently of the Spark operators: plain windows and joins, without
regard to scale.
"""

from __future__ import annotations

from candor.functions.stopwords import ENGLISH
from catalog import queries as q
from catalog.tables import ANNOTATORS, RULE_MODELS

ORACLE: dict[str, str] = {}


def hashed(seed: str, expr: str) -> str:
    return f"('0x' || substr(md5('{seed}:' || {expr}), 1, 15))::BIGINT"


def cleaned(expr: str) -> str:
    kept = r"[^\p{L}\p{N}_\s\p{Z}\x{1c}-\x{1f}\x{85}.,!?-]"
    space = r"[\s\p{Z}\x{1c}-\x{1f}\x{85}]+"
    return (
        f"trim(regexp_replace(regexp_replace(lower(coalesce({expr}, '')), '{kept}', '', 'g'), "
        f"'{space}', ' ', 'g'))"
    )


def words_of(expr: str) -> str:
    space = r"[\s\p{Z}\x{1c}-\x{1f}\x{85}]+"
    return f"list_filter(regexp_split_to_array({expr}, '{space}'), lambda w: w <> '')"


TOKEN_LIST = r"regexp_extract_all({}, '[\p{{L}}\p{{N}}_]{{2,}}')"


def tokens_of(expr: str) -> str:
    return TOKEN_LIST.format(cleaned(expr))


LABELS = "lab AS (SELECT doc_id, 'q' || quality || '_t' || toxic AS label FROM labels)"
LABELLED = f"{LABELS}, labelled AS (SELECT d.doc_id, d.text, l.label FROM documents d JOIN lab l USING (doc_id))"
TOKENS = f"toks AS (SELECT doc_id, {tokens_of('text')} AS t FROM documents)"
STOP = ", ".join(f"'{w}'" for w in ENGLISH)
KEPT = f"list_filter(t, lambda x: x NOT IN ({STOP}))"

_models = " UNION ALL ".join(
    f"SELECT {rank} AS model_rank, '{name}' AS model, {tenths} AS tenths"
    for rank, (name, tenths) in enumerate(RULE_MODELS)
)
PREDICTIONS = f"""{LABELS},
    names AS (SELECT list(DISTINCT label ORDER BY label) AS c FROM lab),
    models AS ({_models}),
    drawn AS (SELECT model_rank, model, tenths, doc_id, label, c,
                     ('0x' || substr(md5(model || ':' || doc_id), 1, 15))::BIGINT AS h
              FROM lab, models, names),
    preds AS (SELECT model_rank, model, doc_id, label,
                     CASE WHEN h % 10 < tenths THEN label ELSE c[(h % len(c))::INT + 1] END AS prediction
              FROM drawn)"""
VOTES = """
    tally AS (SELECT doc_id, label, prediction, count(*) AS votes, min(model_rank) AS first
              FROM preds GROUP BY ALL),
    voted AS (SELECT doc_id, label, prediction FROM tally
              QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY votes DESC, first) = 1),
    everyone AS (SELECT * FROM preds UNION ALL
                 SELECT 3, 'Ensemble', doc_id, label, prediction FROM voted)"""


def scores(source: str = "preds") -> str:
    return f"""
    sides AS (SELECT model_rank, model, label AS class, 1 AS s, 0 AS p,
                     (label = prediction)::INT AS hit FROM {source}
              UNION ALL SELECT model_rank, model, prediction, 0, 1, 0 FROM {source}),
    per AS (SELECT model_rank, model, class, sum(s) AS support, sum(p) AS predicted, sum(hit) AS hits
            FROM sides GROUP BY ALL),
    cls AS (SELECT *, CASE WHEN predicted = 0 THEN 0 ELSE hits / predicted END AS precision,
                   CASE WHEN support = 0 THEN 0 ELSE hits / support END AS recall,
                   CASE WHEN support + predicted = 0 THEN 0
                        ELSE 2 * hits / (support + predicted) END AS f1 FROM per),
    mod AS (SELECT model_rank, model, sum(hits) / sum(support) AS accuracy,
                   avg(precision) AS pm, avg(recall) AS rm, avg(f1) AS fm,
                   sum(precision * support) / sum(support) AS pw,
                   sum(recall * support) / sum(support) AS rw,
                   sum(f1 * support) / sum(support) AS fw, sum(support) AS support
            FROM cls GROUP BY ALL)"""


def quota(n: str, total: str, wanted: str) -> str:
    """Largest-remainder quota over a table of classes; ties by label."""
    base = f"(({n} * {wanted}) // {total})"
    rest = f"(({n} * {wanted}) % {total})"
    return (
        f"({base} + (row_number() OVER (ORDER BY {rest} DESC, label) "
        f"<= {wanted} - sum({base}) OVER ())::BIGINT)"
    )


RANKED = f"""{LABELS},
    ranked AS (SELECT doc_id, label, row_number() OVER (PARTITION BY label
                      ORDER BY {hashed('42', 'doc_id')}, doc_id) AS r FROM lab),
    counts AS (SELECT label, count(*) AS n FROM lab GROUP BY label),
    sized AS (SELECT label, n, (sum(n) OVER ())::BIGINT AS total FROM counts)"""
TEST_CUT = f"""{RANKED},
    want1 AS (SELECT *, total - ceil(total * 0.2::DOUBLE)::BIGINT AS keep1 FROM sized),
    cut1 AS (SELECT label, n, (n - {quota('n', 'total', 'keep1')})::BIGINT AS test FROM want1)"""
NESTED_CUT = f"""{TEST_CUT},
    left1 AS (SELECT label, n, test, n - test AS rest, (sum(n - test) OVER ())::BIGINT AS total FROM cut1),
    want2 AS (SELECT *, total - ceil(total * 0.15::DOUBLE)::BIGINT AS keep2 FROM left1),
    cut2 AS (SELECT label, n, test, (n - {quota('rest', 'total', 'keep2')})::BIGINT AS held FROM want2),
    nested AS (SELECT doc_id, label, CASE WHEN r <= test THEN 'test' WHEN r <= held THEN 'val'
                      ELSE 'train' END AS split FROM ranked JOIN cut2 USING (label))"""
SPLIT = f"""{TEST_CUT},
    split AS (SELECT doc_id, label, CASE WHEN r <= test THEN 'test' ELSE 'train' END AS split
              FROM ranked JOIN cut1 USING (label))"""


# --- columns and schemas ---------------------------------------------------------------

ORACLE["standardize_columns"] = f"""
WITH {LABELS} SELECT doc_id, coalesce(text, '') AS text, label FROM documents LEFT JOIN lab USING (doc_id)"""

ORACLE["fewest_distinct_column"] = """
WITH c AS (
  SELECT 'doc_id' AS "column", 0 AS p, count(DISTINCT doc_id) AS n_distinct FROM documents
  UNION ALL SELECT 'text', 1, count(DISTINCT text) FROM documents
  UNION ALL SELECT 'lang', 2, count(DISTINCT lang) FROM documents
  UNION ALL SELECT 'source', 3, count(DISTINCT source) FROM documents
  UNION ALL SELECT 'n_chars', 4, count(DISTINCT n_chars) FROM documents)
SELECT "column", n_distinct FROM c ORDER BY n_distinct, p LIMIT 1"""

ORACLE["select_text_column"] = """
WITH a AS (
  SELECT 'question' AS "column", 0 AS position, avg(length(coalesce(lang, ''))) AS m FROM documents
  UNION ALL SELECT 'interview_question', 1, avg(length(coalesce(source, ''))) FROM documents
  UNION ALL SELECT 'interview_answer', 2, avg(length(coalesce(text, ''))) FROM documents
  UNION ALL SELECT 'gpt3.5_summary', 3, avg(length(coalesce(text, ''))) FROM documents)
SELECT "column", position, round(m, 4) AS avg_length,
       position = coalesce((SELECT min(position) FROM a WHERE m > 20), 0) AS selected FROM a"""

ORACLE["label_encode"] = f"""
WITH {LABELS}, ids AS (SELECT label, (row_number() OVER (ORDER BY label) - 1)::INT AS label_id
                       FROM (SELECT DISTINCT label FROM lab))
SELECT doc_id, label, label_id FROM lab JOIN ids USING (label)"""

ORACLE["harmonize_union"] = f"""
WITH {LABELS}
SELECT source AS question, text AS interview_answer, label AS evasion_label, lang = 'fr' AS inaudible,
       NULL::VARCHAR AS annotator1, NULL::VARCHAR AS annotator_id, NULL::VARCHAR AS gpt_summary,
       NULL::VARCHAR AS clarity_label, NULL::BIGINT AS index
FROM documents JOIN lab USING (doc_id)
UNION ALL SELECT text, NULL, role, NULL, role, NULL, NULL, NULL, NULL FROM conversations
UNION ALL SELECT NULL, text, NULL, NULL, NULL, doc_id::VARCHAR, source, lang, n_chars FROM documents"""

_parents = ", ".join(f"('{c}', '{p}')" for c, p in sorted(q.PARENTS.items()))
ORACLE["label_rollup"] = f"""
WITH {LABELS}, par(label, parent_label) AS (VALUES {_parents}),
  pairs AS (SELECT label, parent_label, count(*) AS n FROM lab LEFT JOIN par USING (label) GROUP BY ALL)
SELECT *, count(parent_label) OVER (PARTITION BY label) AS n_parents FROM pairs"""

ORACLE["valid_labels"] = f"""
WITH {LABELS} SELECT doc_id, label FROM documents LEFT JOIN lab USING (doc_id)
WHERE label IS NOT NULL AND trim(label) <> ''"""

# --- text ------------------------------------------------------------------------------

ORACLE["clean_text"] = f"SELECT doc_id, {cleaned('text')} AS text_clean FROM documents"

ORACLE["text_preview"] = """
SELECT doc_id, length(text) AS n_chars, substr(text, 1, 100) AS preview FROM documents"""

ORACLE["text_length_stats"] = f"""
WITH c AS (SELECT length({cleaned('text')}) AS n FROM documents)
SELECT min(n) AS min_chars, max(n) AS max_chars, round(avg(n), 4) AS mean_chars FROM c"""

ORACLE["tokenize"] = f"""
WITH {TOKENS} SELECT doc_id, len(t) AS n_tokens, array_to_string(t, ' ') AS tokens FROM toks"""

ORACLE["stopword_filter"] = f"""
WITH {TOKENS} SELECT doc_id, array_to_string({KEPT}, ' ') AS tokens FROM toks"""

GRAMS = "list_concat(t, list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]))"
ORACLE["ngrams"] = f"""
WITH {TOKENS}, g AS (SELECT doc_id, {GRAMS} AS g FROM toks)
SELECT doc_id, len(g) AS n_grams, array_to_string(g, '|') AS grams FROM g"""


def varied(source: str, key: str, text: str) -> str:
    """CTEs that rewrite ``text`` of ``source``; a word changes at its first draw."""
    entries = ", ".join(
        "('{}', [{}])".format(h, ", ".join(f"'{w}'" for w in ws))
        for h, ws in sorted(q.SYNONYMS.items())
    )
    position = f"('0x' || substr(md5('42:position:' || k || ':' || d), 1, 15))::BIGINT % n"
    return f"""
    syn(head, options) AS (VALUES {entries}),
    split_text AS (SELECT {key} AS k, {text} AS original, {words_of(text)} AS w FROM {source}),
    sized_text AS (SELECT k, original, w, len(w) AS n FROM split_text),
    draw AS (SELECT k, n, unnest(range(0, greatest(1, floor(n * 0.2::DOUBLE)::BIGINT))) AS d
             FROM sized_text WHERE n >= 3),
    placed AS (SELECT k, {position} AS pos, min(d) AS d FROM draw GROUP BY ALL),
    word AS (SELECT k, unnest(w) AS v, unnest(range(0, n)) AS pos FROM sized_text WHERE n >= 3),
    changed AS (SELECT word.k, word.pos,
                       CASE WHEN placed.d IS NOT NULL AND head IS NOT NULL
                            THEN options[(('0x' || substr(md5('42:choice:' || word.k || ':' || placed.d), 1, 15))::BIGINT
                                          % len(options))::INT + 1]
                            ELSE v END AS v
                FROM word LEFT JOIN placed ON word.k = placed.k AND word.pos = placed.pos
                          LEFT JOIN syn ON head = trim(lower(v), '.,!?;:')),
    rejoined AS (SELECT k, string_agg(v, ' ' ORDER BY pos) AS text FROM changed GROUP BY k),
    varied AS (SELECT k, coalesce(rejoined.text, original) AS text
               FROM sized_text LEFT JOIN rejoined USING (k))"""


ORACLE["synonym_replace"] = f"""
WITH {varied('documents', 'doc_id', 'text').strip()}
SELECT k AS doc_id, text AS text_varied FROM varied"""

ORACLE["encode_sequences"] = f"""
WITH {TOKENS},
  every AS (SELECT unnest(t) AS term FROM toks),
  vocab AS (SELECT term, count(*) AS tf FROM every GROUP BY term ORDER BY tf DESC, term LIMIT 3000),
  ids AS (SELECT term, row_number() OVER (ORDER BY tf DESC, term) + 1 AS id FROM vocab),
  kept AS (SELECT doc_id, t[1:{q.MAX_LENGTH}] AS t FROM toks),
  posn AS (SELECT doc_id, unnest(t) AS term, unnest(range(0, len(t))) AS pos FROM kept),
  enc AS (SELECT doc_id, list(coalesce(id, 1) ORDER BY pos) AS e FROM posn LEFT JOIN ids USING (term)
          GROUP BY doc_id),
  filled AS (SELECT doc_id, coalesce(e, []) AS e FROM kept LEFT JOIN enc USING (doc_id))
SELECT doc_id,
       array_to_string(list_concat(e, list_transform(range(0, {q.MAX_LENGTH} - len(e)), lambda x: 0)), ' ') AS input_ids,
       repeat('1', len(e)) || repeat('0', {q.MAX_LENGTH} - len(e)) AS attention_mask
FROM filled"""

# --- features --------------------------------------------------------------------------


def tfidf(fit: str, apply: str, enhanced: bool, size: int, normalize: bool) -> str:
    """CTEs from token tables (doc_id, t) to ``weights`` (doc_id, term, weight)."""
    kept = KEPT if enhanced else "t"
    grams = "list_concat(t, list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]))"
    terms = grams if enhanced else "t"
    pruned = "WHERE df >= 2 AND df <= 0.95::DOUBLE * (SELECT count(*) FROM fit_docs)" if enhanced else ""
    tf = "1.0 + ln(tf::DOUBLE)" if enhanced else "tf::DOUBLE"
    norm = "w / sqrt(sum(w * w) OVER (PARTITION BY doc_id))" if normalize else "w"
    return f"""
    fit_docs AS (SELECT doc_id, {kept} AS t FROM {fit}),
    apply_docs AS (SELECT doc_id, {kept} AS t FROM {apply}),
    fit_terms AS (SELECT doc_id, unnest({terms}) AS term FROM fit_docs),
    corpus AS (SELECT term, count(*) AS tf, count(DISTINCT doc_id) AS df FROM fit_terms GROUP BY term),
    vocab AS (SELECT term, tf, df FROM corpus {pruned} ORDER BY tf DESC, term LIMIT {size}),
    idf AS (SELECT term, tf, df,
                   ln((1.0 + (SELECT count(*) FROM fit_docs)) / (1.0 + df)) + 1.0 AS idf FROM vocab),
    apply_terms AS (SELECT doc_id, unnest({terms}) AS term FROM apply_docs),
    tfs AS (SELECT doc_id, term, count(*) AS tf FROM apply_terms GROUP BY ALL),
    raw AS (SELECT doc_id, tfs.term, ({tf}) * idf AS w
            FROM (SELECT doc_id, term, tf FROM tfs) tfs JOIN (SELECT term, idf FROM idf) v ON tfs.term = v.term),
    weights AS (SELECT doc_id, term, round({norm}, 6) AS weight FROM raw)"""


ORACLE["vocab_fit"] = f"""
WITH {TOKENS}, {tfidf('toks', 'toks', True, 3000, True).strip()}
SELECT term, (row_number() OVER (ORDER BY term) - 1)::INT AS term_id, tf, df FROM vocab"""

ORACLE["vocab_incremental"] = ORACLE["vocab_fit"]

ORACLE["term_counts"] = f"""
WITH {TOKENS}, e AS (SELECT doc_id, unnest(t) AS term FROM toks)
SELECT doc_id, term, count(*) AS tf FROM e GROUP BY ALL"""

ORACLE["idf_table"] = f"""
WITH {TOKENS}, {tfidf('toks', 'toks', False, 3000, True).strip()}
SELECT term, df, round(idf, 6) AS idf FROM idf"""

ORACLE["tfidf_sublinear"] = f"""
WITH {TOKENS}, {tfidf('toks', 'toks', True, 3000, False).strip()} SELECT * FROM weights"""

ORACLE["tfidf_l2"] = f"""
WITH {TOKENS}, {tfidf('toks', 'toks', False, 3000, True).strip()} SELECT * FROM weights"""

ORACLE["tfidf_apply"] = f"""
WITH {SPLIT}, {TOKENS},
  train AS (SELECT doc_id, t FROM toks JOIN split USING (doc_id) WHERE split = 'train'),
  held AS (SELECT doc_id, t FROM toks JOIN split USING (doc_id) WHERE split = 'test'),
  {tfidf('train', 'held', True, 3000, True).strip()}
SELECT * FROM weights"""

# --- splits, weights, augmentation -----------------------------------------------------

ORACLE["stratified_split"] = f"WITH {SPLIT} SELECT * FROM split"

ORACLE["nested_split"] = f"WITH {NESTED_CUT} SELECT * FROM nested"

ORACLE["kfold_assign"] = f"""
WITH {RANKED},
  line AS (SELECT label, row_number() OVER (ORDER BY label, doc_id) - 1 AS p FROM lab),
  alloc AS (SELECT label, p % 5 AS fold, count(*) AS size FROM line GROUP BY ALL),
  ends AS (SELECT label, fold, sum(size) OVER (PARTITION BY label ORDER BY fold) AS upto FROM alloc)
SELECT doc_id, ranked.label, min(fold)::INT AS fold
FROM ranked JOIN ends ON ranked.label = ends.label AND r <= upto GROUP BY ALL"""

ORACLE["debug_subset"] = f"""
WITH {RANKED}, w AS (SELECT *, least(50, total) AS wanted FROM sized),
  cuts AS (SELECT label, {quota('n', 'total', 'wanted')} AS cut FROM w)
SELECT doc_id, label FROM ranked JOIN cuts USING (label) WHERE r <= cut"""

ORACLE["class_weights"] = f"""
WITH {RANKED} SELECT label, n, round(total / (count(*) OVER () * n), 6) AS weight FROM sized"""

ORACLE["minority_class"] = f"""
WITH {RANKED} SELECT label, n FROM counts ORDER BY n, label LIMIT 1"""

ORACLE["augment_minority"] = f"""
WITH {LABELLED},
  small AS (SELECT label FROM lab GROUP BY label ORDER BY count(*), label LIMIT 1),
  pool AS (SELECT doc_id, {cleaned('text')} AS text, label,
                  row_number() OVER (ORDER BY {hashed('42', 'doc_id')}, doc_id) - 1 AS idx
           FROM labelled WHERE label = (SELECT label FROM small)),
  samples AS (SELECT s AS sample_id, {hashed('42:draw', 's')} % (SELECT count(*) FROM pool) AS idx
              FROM range(0, 200) g(s)),
  copies AS (SELECT sample_id, doc_id, text, label FROM samples JOIN pool USING (idx)),
  {varied('copies', 'sample_id', 'text').strip()}
SELECT doc_id, sample_id, varied.text AS text, label FROM copies JOIN varied ON k = sample_id
UNION ALL SELECT doc_id, NULL, {cleaned('text')}, label FROM documents LEFT JOIN lab USING (doc_id)"""

# --- class statistics ------------------------------------------------------------------

ORACLE["class_distribution"] = f"""
WITH {RANKED} SELECT label, n, round(n / total * 100, 4) AS percent FROM sized"""

ORACLE["class_counts_dense"] = f"""
WITH {SPLIT}, tested AS (SELECT label, count(*) AS n FROM split WHERE split = 'test' GROUP BY label)
SELECT label, (row_number() OVER (ORDER BY label) - 1)::INT AS label_id, coalesce(tested.n, 0) AS n
FROM counts LEFT JOIN tested USING (label)"""

ORACLE["imbalance_ratio"] = f"""
WITH {RANKED} SELECT max(n) AS largest, min(n) AS smallest, round(max(n) / min(n), 4) AS ratio FROM counts"""

ORACLE["dataset_summary"] = f"""
WITH {NESTED_CUT},
  tested AS (SELECT label, count(*) AS n FROM nested WHERE split = 'test' GROUP BY label)
SELECT count(*) AS total_samples,
       count(*) FILTER (split = 'train') AS train_samples,
       count(*) FILTER (split = 'val') AS val_samples,
       count(*) FILTER (split = 'test') AS test_samples,
       count(DISTINCT label) AS n_classes,
       (SELECT string_agg(label, ',' ORDER BY label) FROM counts) AS classes,
       (SELECT round(max(n) / min(n), 4) FROM tested) AS class_imbalance_ratio
FROM nested"""


def _profiled(position: int, column: str, kind: str) -> str:
    text = f"coalesce({column}::VARCHAR, '')"
    return (
        f"SELECT '{column}' AS \"column\", {position} AS position, '{kind}' AS type, count(*) AS n_rows, "
        f"count(*) FILTER ({column} IS NULL) AS n_nulls, round(avg(length({text})), 4) AS avg_length, "
        f"arg_min(substr({text}, 1, 100), doc_id) AS sample FROM src"
    )


_columns = [
    ("doc_id", "bigint"), ("text", "string"), ("lang", "string"), ("source", "string"),
    ("n_chars", "bigint"), ("label", "string"),
]
ORACLE["table_profile"] = (
    f"WITH {LABELS}, src AS (SELECT * FROM documents LEFT JOIN lab USING (doc_id)) "
    + " UNION ALL ".join(_profiled(i, c, k) for i, (c, k) in enumerate(_columns))
)

# --- metrics ---------------------------------------------------------------------------

MATRIX = """
    seen AS (SELECT model_rank, model, label AS class FROM preds
             UNION SELECT model_rank, model, prediction FROM preds),
    grid AS (SELECT a.model_rank, a.model, a.class AS label, b.class AS prediction
             FROM seen a JOIN seen b USING (model)),
    cells AS (SELECT model, label, prediction, count(*) AS n FROM preds GROUP BY ALL),
    matrix AS (SELECT model_rank, model, label, prediction, coalesce(n, 0) AS n
               FROM grid LEFT JOIN cells USING (model, label, prediction))"""

ORACLE["confusion_matrix"] = f"WITH {PREDICTIONS}, {MATRIX.strip()} SELECT * FROM matrix"

ORACLE["confusion_normalized"] = f"""
WITH {PREDICTIONS}, {MATRIX.strip()},
  totals AS (SELECT *, sum(n) OVER (PARTITION BY model, label) AS total FROM matrix)
SELECT model_rank, model, label, prediction,
       CASE WHEN total = 0 THEN 0.0 ELSE round(n / total, 4) END AS share FROM totals"""

_wide = ", ".join(
    f"count(*) FILTER (prediction = '{c}') AS \"pred_{c}\"" for c in sorted(q.PARENTS)
)
ORACLE["confusion_wide"] = f"WITH {PREDICTIONS} SELECT model_rank, model, label, {_wide} FROM preds GROUP BY ALL"

COMPARISON = "SELECT model_rank, model, round(accuracy, 4) AS accuracy, round(fw, 4) AS f1_score FROM mod"
ORACLE["model_comparison"] = f"WITH {PREDICTIONS}, {scores().strip()} {COMPARISON}"

MACRO = """SELECT model_rank, model, round(accuracy, 4) AS accuracy, round(fm, 4) AS f1_macro,
  round(fw, 4) AS f1_weighted, round(pm, 4) AS precision, round(rm, 4) AS recall FROM mod"""
ORACLE["metrics_macro"] = f"WITH {PREDICTIONS}, {scores().strip()} {MACRO}"

ORACLE["metrics_weighted"] = f"""
WITH {PREDICTIONS}, {scores().strip()}
SELECT model_rank, model, round(accuracy, 4) AS accuracy, round(fw, 4) AS f1_score,
       round(pw, 4) AS precision, round(rw, 4) AS recall FROM mod"""

ORACLE["classification_report"] = f"""
WITH {PREDICTIONS}, {scores().strip()},
  rows AS (
    SELECT model_rank, model, class AS row, precision, recall, f1, support::DOUBLE AS support FROM cls
    UNION ALL SELECT model_rank, model, 'accuracy', accuracy, accuracy, accuracy, accuracy FROM mod
    UNION ALL SELECT model_rank, model, 'macro avg', pm, rm, fm, support FROM mod
    UNION ALL SELECT model_rank, model, 'weighted avg', pw, rw, fw, support FROM mod)
SELECT model_rank, model, row, round(precision, 4) AS precision, round(recall, 4) AS recall,
       round(f1, 4) AS f1_score, round(support, 4) AS support FROM rows"""

ORACLE["model_metric_long"] = f"""
WITH {PREDICTIONS}, {scores().strip()}, macro AS ({MACRO})
SELECT model, 'accuracy' AS metric, accuracy AS value FROM macro WHERE model IN ('m1', 'm3')
UNION ALL SELECT model, 'f1_macro', f1_macro FROM macro WHERE model IN ('m1', 'm3')
UNION ALL SELECT model, 'precision', precision FROM macro WHERE model IN ('m1', 'm3')
UNION ALL SELECT model, 'recall', recall FROM macro WHERE model IN ('m1', 'm3')"""

ORACLE["top_classes_by_f1"] = f"""
WITH {PREDICTIONS}, {scores().strip()}
SELECT model_rank, model, (row_number() OVER (PARTITION BY model ORDER BY f1 DESC, class))::INT AS place,
       class, round(f1, 4) AS f1_score FROM cls QUALIFY place <= 3"""

ORACLE["best_model"] = f"""
WITH {PREDICTIONS}, {scores().strip()}, cmp AS ({COMPARISON}),
  ranked AS (SELECT *, row_number() OVER (ORDER BY accuracy DESC, model_rank) AS a,
                    row_number() OVER (ORDER BY f1_score DESC, model_rank) AS f FROM cmp)
SELECT 'by_accuracy' AS criterion, model, accuracy, f1_score FROM ranked WHERE a = 1
UNION ALL SELECT 'by_f1_score', model, accuracy, f1_score FROM ranked WHERE f = 1"""

ORACLE["key_insights"] = f"""
WITH {NESTED_CUT}, {PREDICTIONS.removeprefix(LABELS + ",").strip()},
  {VOTES.strip()}, {scores('everyone').strip()}, cmp AS ({COMPARISON}),
  sizes AS (SELECT count(*) AS n FROM nested WHERE split = 'test' GROUP BY label)
SELECT max(accuracy) AS best_accuracy, min(f1_score) AS f1_min, max(f1_score) AS f1_max,
       max(accuracy) FILTER (model = 'Ensemble') > max(accuracy) FILTER (model <> 'Ensemble') AS ensemble_improved,
       (SELECT round(max(n) / min(n), 4) FROM sizes) AS imbalance_ratio
FROM cmp"""

ORACLE["majority_vote"] = f"WITH {PREDICTIONS}, {VOTES.strip()} SELECT doc_id, label, prediction FROM voted"

ORACLE["ensemble_comparison"] = f"""
WITH {PREDICTIONS}, {VOTES.strip()}, {scores('everyone').strip()} {COMPARISON}"""

ORACLE["training_history"] = f"""
WITH batch AS (
  SELECT (user_id % 3)::INT AS run, dayofmonth(ts)::INT AS epoch,
         CASE WHEN event_type IN ('view', 'click', 'purchase') THEN 'train' ELSE 'val' END AS phase,
         value, {hashed('42', 'event_id')} % 17 AS correct FROM events)
SELECT run, epoch, phase, round(avg(value), 9) AS loss,
       round(sum(correct) / (16 * count(*)), 9) AS accuracy FROM batch GROUP BY ALL"""

# --- errors ----------------------------------------------------------------------------

ORACLE["error_rates"] = f"""
WITH {PREDICTIONS},
  per AS (SELECT model_rank, model, label, count(*) AS n, count(*) FILTER (label <> prediction) AS errors
          FROM preds GROUP BY ALL),
  both_scopes AS (
    SELECT model_rank, model, 'class' AS scope, label, n, errors FROM per
    UNION ALL SELECT model_rank, model, 'model', '', sum(n)::BIGINT, sum(errors)::BIGINT FROM per GROUP BY ALL)
SELECT *, round(errors / n, 4) AS error_rate FROM both_scopes
WHERE model IN (SELECT model FROM per GROUP BY model HAVING sum(errors) > 0)"""

ORACLE["error_samples"] = f"""
WITH {PREDICTIONS},
  wrong AS (SELECT *, (row_number() OVER (PARTITION BY model ORDER BY doc_id))::INT AS place
            FROM preds WHERE label <> prediction)
SELECT model_rank, model, place, doc_id, text, label, prediction
FROM wrong JOIN documents USING (doc_id) WHERE place <= 10"""

ORACLE["prediction_table"] = f"""
WITH {PREDICTIONS}, ids AS (SELECT label, (row_number() OVER (ORDER BY label) - 1)::INT AS id
                            FROM (SELECT DISTINCT label FROM lab))
SELECT model_rank, model, doc_id, text, a.id AS true_label, preds.label AS true_label_name,
       b.id AS predicted_label, prediction AS predicted_label_name,
       (preds.label = prediction)::INT AS correct
FROM preds JOIN documents USING (doc_id) JOIN ids a ON a.label = preds.label JOIN ids b ON b.label = prediction"""

ORACLE["error_by_length"] = f"""
WITH {PREDICTIONS}, sized AS (SELECT doc_id, len({words_of('text')}) // 100 * 100 AS bucket FROM documents),
  per AS (SELECT model_rank, model, bucket, count(*) AS n, count(*) FILTER (label <> prediction) AS errors
          FROM preds JOIN sized USING (doc_id) GROUP BY ALL)
SELECT *, round(errors / n, 4) AS error_rate FROM per"""

# --- exploration -----------------------------------------------------------------------

ORACLE["token_length_histogram"] = f"""
WITH {TOKENS} SELECT len(t) // 50 * 50 AS bucket, count(*) AS n FROM toks GROUP BY ALL"""

ORACLE["sequence_length_quantiles"] = f"""
WITH {TOKENS}, n AS (SELECT len(t)::INT AS n FROM toks)
SELECT quantile_disc(n, 0.5) AS p50, quantile_disc(n, 0.9) AS p90, quantile_disc(n, 0.95) AS p95,
       quantile_disc(n, 0.99) AS p99 FROM n"""

ORACLE["top_unigrams"] = f"""
WITH {LABELLED}, e AS (SELECT label, unnest({tokens_of('text')}) AS term FROM labelled),
  c AS (SELECT label, term, count(*) AS n FROM e GROUP BY ALL
        UNION ALL SELECT '*', term, count(*) FROM e GROUP BY ALL)
SELECT label, (row_number() OVER (PARTITION BY label ORDER BY n DESC, term))::INT AS place, term, n
FROM c QUALIFY place <= 20"""

ORACLE["length_by_class"] = f"""
WITH {LABELLED}, w AS (SELECT label, len({words_of('text')}) AS n FROM labelled)
SELECT label, count(*) AS n, round(avg(w.n), 4) AS mean_words, round(stddev_samp(w.n), 4) AS sd_words
FROM w GROUP BY label"""


def _annotation(name: str) -> str:
    h = hashed(name, "doc_id")
    return f"CASE WHEN {h} % 7 = 0 THEN NULL WHEN {h} % 10 = 1 THEN 'other' ELSE label END"


ORACLE["annotator_disagreement"] = f"""
WITH {LABELS},
  a AS (SELECT list_filter([{', '.join(_annotation(n) for n in ANNOTATORS)}], lambda x: x IS NOT NULL) AS g FROM lab)
SELECT count(*) AS n, count(*) FILTER (len(list_distinct(g)) > 1) AS n_disagree,
       round(avg((len(list_distinct(g)) > 1)::INT), 4) AS rate FROM a WHERE len(g) >= 2"""

ORACLE["flag_rates"] = r"""
WITH p AS (SELECT u.text AS question, a.text AS answer FROM conversations u
           JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
           WHERE u.role = 'user' AND a.role = 'assistant'),
  f AS (SELECT length(answer) < 100 AS inaudible,
               length(question) - length(replace(question, '?', '')) > 1 AS multiple,
               regexp_matches(question, '\?\s*$') AS affirmative FROM p)
SELECT 'inaudible' AS flag, count(*) FILTER (inaudible) AS n_set, round(avg(inaudible::INT), 4) AS rate FROM f
UNION ALL SELECT 'multiple_questions', count(*) FILTER (multiple), round(avg(multiple::INT), 4) FROM f
UNION ALL SELECT 'affirmative_questions', count(*) FILTER (affirmative), round(avg(affirmative::INT), 4) FROM f"""

_markers = ", ".join(f"'{m}'" for m in q.MARKERS)
ORACLE["discourse_markers"] = rf"""
WITH {LABELLED}, c AS (SELECT label, {cleaned('text')} AS c FROM labelled),
  m AS (SELECT label, c, unnest([{_markers}]) AS marker FROM c),
  h AS (SELECT label, marker,
               regexp_matches(c, '(^|[^\p{{L}}\p{{N}}_])' || marker || '($|[^\p{{L}}\p{{N}}_])') AS held FROM m)
SELECT label, marker, count(*) AS n, count(*) FILTER (held) AS n_with, round(avg(held::INT), 4) AS rate
FROM h GROUP BY ALL"""

# --- scoring ---------------------------------------------------------------------------

ORACLE["softmax_argmax"] = f"""
WITH heads AS (SELECT unnest(range(0, {q.N_CLASSES}))::INT AS class_id),
  logits AS (SELECT vec_id, class_id,
                    list_sum(list_transform(range(0, {q.N_DIMENSIONS}), lambda j:
                      ((class_id * 31 + j * 17) % 23 - 11) / 10.0::DOUBLE * embedding[j + 1]::DOUBLE))
                    + class_id / 10.0::DOUBLE AS z
             FROM embeddings, heads),
  exps AS (SELECT vec_id, class_id, z, exp(z - max(z) OVER (PARTITION BY vec_id)) AS e FROM logits)
SELECT vec_id, first_value(class_id) OVER (PARTITION BY vec_id ORDER BY z DESC, class_id) AS prediction,
       class_id, round(e / sum(e) OVER (PARTITION BY vec_id), 6) AS probability
FROM exps"""

ORACLE["batch_scoring"] = f"""
WITH s AS ({ORACLE["softmax_argmax"].strip()})
SELECT vec_id, prediction, probability FROM s WHERE class_id = prediction"""

# --- models ----------------------------------------------------------------------------

# No solver is repeated here: which rows are scored, by which models, with known classes.


def scored(split: str, *models: str) -> str:
    named = ", ".join(f"({i}, '{m}')" for i, m in enumerate(models))
    return f"""
WITH {NESTED_CUT}, m(model_rank, model) AS (VALUES {named})
SELECT model_rank::INT AS model_rank, model, label, count(*) AS n, count(*) AS n_known, true AS agrees
FROM nested, m WHERE split = '{split}' GROUP BY ALL"""


ORACLE["baseline_a"] = scored("test", "Baseline_A")
ORACLE["baseline_c"] = scored("test", "Baseline_C")
ORACLE["proposed"] = scored("test", "Proposed")
ORACLE["random_forest"] = scored("test", "RandomForest")
ORACLE["train_all"] = scored("val", "Baseline_A", "Baseline_C", "Proposed")
ORACLE["evaluate_all"] = scored(
    "test", "Baseline_A", "Baseline_C", "Proposed_Multinomial", "RandomForest", "Ensemble"
)

ORACLE["cross_validate"] = f"""
WITH folds AS ({ORACLE["kfold_assign"].strip()}), m(model_rank, model) AS (VALUES (0, 'C=0.5'), (1, 'C=1.0'))
SELECT model_rank::INT AS model_rank, model, fold, count(*) AS n, count(*) AS n_documents
FROM folds, m GROUP BY ALL"""

# Four candidates meet the first fold, two the second, one the others.
ORACLE["halving_search"] = f"""
WITH folds AS ({ORACLE["kfold_assign"].strip()}),
  r(fold, rung, n_candidates) AS (VALUES (0, 0, 4), (1, 1, 2), (2, 2, 1), (3, 2, 1), (4, 3, 1))
SELECT rung::INT AS rung, n_candidates::BIGINT AS n_candidates, count(*) AS n_documents,
       sum(n_candidates)::BIGINT AS n
FROM folds JOIN r USING (fold) GROUP BY ALL"""

ORACLE["model_roundtrip"] = f"""
WITH {NESTED_CUT} SELECT doc_id, label, true AS same, true AS known FROM nested WHERE split = 'test'"""

ORACLE["score_documents"] = f"""
WITH {LABELS} SELECT doc_id, true AS known, (SELECT count(DISTINCT label) FROM lab)::INT AS n_classes,
       1.0::DOUBLE AS total FROM documents"""

# --- files -----------------------------------------------------------------------------

ORACLE["csv_roundtrip"] = f"""
WITH {LABELS} SELECT doc_id, lang, source, label FROM documents LEFT JOIN lab USING (doc_id)"""

ORACLE["json_roundtrip"] = "SELECT doc_id, text FROM documents"

ORACLE["json_document"] = f"""
WITH {RANKED} SELECT (row_number() OVER (ORDER BY label DESC) - 1)::INT AS place, label, n,
       round(n / total * 100, 4) AS percent FROM sized"""

ORACLE["file_safe_names"] = """
WITH n AS (SELECT DISTINCT 'Model Of ' || upper(lang[1]) || lang[2:] || ' ' || upper(source[1]) || source[2:] AS name
           FROM documents)
SELECT name, replace(lower(name), ' ', '_') AS file FROM n"""
