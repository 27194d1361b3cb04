"""Each query again as DuckDB SQL, written row by row and rank by rank.

The SQL takes the plain route on purpose - a full ranking per class, one joined
row per token and run - so it checks the distributed routes independently.
"""

from __future__ import annotations

import math

# Fixed values, written out again so that the SQL does not follow a change of the library.
WHITESPACE = "".join(c for c in map(chr, range(0x10000)) if c.isspace())
SENTIMENT_PREFIXES = {
    "three_class": "sentiment classification (negative, off, positive): ",
    "two_class": "sentiment classification (negative, positive): ",
    "two_class_short": "sentiment (negative or positive): ",
}
# (task, style) -> text before and after the review.
TASK_TEMPLATES = {
    ("sentiment", "prefix"): ("sentiment classification: ", ""),
    ("topic", "prefix"): ("topic classification: ", ""),
    ("selected", "prefix"): ("generate selected content: ", ""),
    ("sentiment", "prompt"): ("Task: Determine the sentiment of the following review.\nReview: ", "\nSentiment:"),
    ("topic", "prompt"): ("Task: Identify the topic of the following review.\nReview: ", "\nTopic:"),
    ("selected", "prompt"): ("Task: Generate the selected content that supports the opinion.\nReview: ", "\nAnswer:"),
}
# Labels that can be recognised, label text and label id of unrecognised text.
FALLBACKS = {
    "three_class": (("negative", "off", "positive"), "off", 1),
    "remove_off": (("negative", "positive"), "off", 1),
    "two_class": (("negative", "positive"), "negative", 0),
}
# Smoothing and prior weight.
DEFAULT_SETTINGS = ((1.0, 1.0), (0.1, 1.0), (0.01, 1.0))
# Search spaces: kind of draw and its bounds or options.
CLASSIFIER_SPACE = {
    "learning_rate": ("log", 1e-5, 5e-5),
    "per_device_train_batch_size": ("one of", 8, 16, 32),
    "num_train_epochs": ("one of", 2, 3, 4),
    "weight_decay": ("even", 0.0, 0.1),
}
CLASSIFIER_TRIALS = 3
TEXT_SPACE = {
    "learning_rate": ("log", 1e-5, 5e-4),
    "num_train_epochs": ("whole", 2, 6),
    "per_device_train_batch_size": ("one of", 8, 16),
}
TEXT_TRIALS = 5
COUNT_MODEL_SPACE = {"smoothing": ("log", 0.01, 10.0), "prior_weight": ("even", 0.0, 1.0)}


def quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strip(c: str) -> str:
    return f"trim({c}, {quote(WHITESPACE)})"


def clean(c: str) -> str:
    return strip(f"replace({c}, chr(10), ' ')")


def norm(c: str) -> str:
    return f"lower({strip(c)})"


def off(c: str) -> str:
    return f"CASE WHEN {c} IS NULL OR {c} IN ('', 'nan', 'none') THEN 'off' ELSE {c} END"


def with_(ctes: list[str], body: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + body


SHEET = """sheet AS (
  SELECT d.doc_id, d.lang, d.source, d.n_chars, l.quality, l.toxic, d.text,
    CASE WHEN quality = 1 AND toxic = 0 THEN 'Positive'
         WHEN quality = 1 THEN ' positive' || chr(10)
         WHEN quality = 0 THEN 'NEGATIVE' || chr(9)
         WHEN lang = 'en' THEN NULL
         WHEN lang = 'de' THEN 'None'
         WHEN lang = 'fr' THEN ' NaN '
         ELSE '' END AS sentiment
  FROM documents d LEFT JOIN labels l USING (doc_id))"""
RAW = "raw AS (SELECT doc_id AS id, text, sentiment FROM sheet)"
SHAPED = f"""shaped AS (
  SELECT id, {clean('text')} AS text, {norm('sentiment')} AS s FROM raw
  WHERE id IS NOT NULL AND text IS NOT NULL)"""
THREE = f"""three AS (
  SELECT id, text, {off('s')} AS sentiment,
    CASE {off('s')} WHEN 'negative' THEN 0 WHEN 'off' THEN 1 ELSE 2 END AS label
  FROM shaped WHERE text <> '' AND {off('s')} IN ('negative', 'off', 'positive'))"""
TWO = """two AS (
  SELECT id, text, s AS sentiment, CASE s WHEN 'negative' THEN 0 ELSE 1 END AS label
  FROM shaped WHERE text <> '' AND s IN ('negative', 'positive'))"""
BASE = [SHEET, RAW, SHAPED]
RATED = [
    SHEET,
    f"""rated AS (
  SELECT doc_id AS id, lang, {off(norm('sentiment'))} AS sentiment,
    CASE {off(norm('sentiment'))} WHEN 'negative' THEN 0 WHEN 'off' THEN 1 ELSE 2 END AS y_true,
    CASE WHEN toxic = 1 THEN 0 WHEN n_chars > 1500 THEN 2 ELSE 1 END AS y_pred
  FROM sheet WHERE {clean('text')} <> '')""",
]


def display(c: str, names: tuple[str, ...]) -> str:
    return f"CASE {c} " + " ".join(f"WHEN {i} THEN '{n.capitalize()}'" for i, n in enumerate(names)) + " END"


# --- splits ---------------------------------------------------------------------


def ranked(src: str) -> list[str]:
    return [
        f"""ranked AS (
  SELECT id, label, row_number() OVER (PARTITION BY label ORDER BY md5('42|' || id), id) AS rk FROM {src})""",
        "n0 AS (SELECT label, count(*) AS n FROM ranked GROUP BY label)",
    ]


def held(name: str, src: str, p: int, q: int) -> list[str]:
    """``name(label, n, q)``: rows of each class of ``src(label, n)`` to hold out."""
    return [
        f"{name}_t AS (SELECT label, n, CAST(sum(n) OVER () AS BIGINT) AS tot FROM {src})",
        f"{name}_u AS (SELECT *, (tot * {p} + {q} - 1) // {q} AS t FROM {name}_t)",
        f"{name}_b AS (SELECT *, n * t // tot AS base, n * t % tot AS rem FROM {name}_u)",
        f"""{name} AS (SELECT label, n, base + CASE WHEN row_number() OVER (ORDER BY rem DESC, label)
      <= t - sum(base) OVER () THEN 1 ELSE 0 END AS q FROM {name}_b)""",
    ]


def nested_ctes(src: str, name: str = "roles") -> list[str]:
    return [
        *ranked(src),
        *held("h1", "n0", 1, 5),
        "n1 AS (SELECT label, n - q AS n FROM h1)",
        *held("h2", "n1", 1, 5),
        f"""{name} AS (
  SELECT r.id, r.label, CASE WHEN rk <= h1.q THEN 'test' WHEN rk <= h1.q + h2.q THEN 'val' ELSE 'train' END AS role
  FROM ranked r JOIN h1 USING (label) JOIN h2 USING (label))""",
    ]


def holdout_ctes(src: str, name: str = "roles") -> list[str]:
    return [
        *ranked(src),
        *held("h1", "n0", 1, 5),
        "n1 AS (SELECT label, q AS n FROM h1)",
        *held("h2", "n1", 1, 2),
        f"""{name} AS (
  SELECT r.id, r.label, CASE WHEN rk <= h2.q THEN 'test' WHEN rk <= h1.q THEN 'val' ELSE 'train' END AS role
  FROM ranked r JOIN h1 USING (label) JOIN h2 USING (label))""",
    ]


def train_test_ctes(src: str, name: str = "roles") -> list[str]:
    return [
        *ranked(src),
        *held("h1", "n0", 1, 5),
        f"""{name} AS (
  SELECT r.id, r.label, CASE WHEN rk <= h1.q THEN 'test' ELSE 'train' END AS role
  FROM ranked r JOIN h1 USING (label))""",
    ]


def fold_ctes(k: int) -> list[str]:
    """Deal the rest out in (label, rank) order to size the folds, then cut the ranks there."""
    return [
        f"""dealt AS (
  SELECT label, (row_number() OVER (ORDER BY label, rk) - 1) % {k} AS f
  FROM ranked JOIN h1 USING (label) WHERE rk > q)""",
        "dealt_n AS (SELECT label, f, count(*) AS m FROM dealt GROUP BY label, f)",
        "ends AS (SELECT label, sum(m) OVER (PARTITION BY label ORDER BY f) AS e FROM dealt_n)",
        """folds AS (
  SELECT r.id, r.label, CASE WHEN any_value(rk) <= any_value(q) THEN 'test'
    ELSE 'fold' || (1 + count(*) FILTER (WHERE e < rk - q)) END AS role
  FROM ranked r JOIN h1 USING (label) JOIN ends USING (label) GROUP BY r.id, r.label)""",
    ]


KFOLD = [*nested_ctes("two", "single"), *fold_ctes(3)]
ALL_K = """member AS (
  SELECT 1 AS K, 1 AS fold, id, label, role FROM single
  UNION ALL
  SELECT 3, f.i, id, label, CASE WHEN role = 'test' THEN 'test' WHEN role = 'fold' || f.i THEN 'val' ELSE 'train' END
  FROM folds, (SELECT unnest([1, 2, 3]) AS i) f)"""


# --- count model ----------------------------------------------------------------


def settings_cte(settings) -> str:
    rows = ", ".join(
        f"({i}, {smoothing!r}::DOUBLE, {prior!r}::DOUBLE, NULL::INTEGER)"
        for i, (smoothing, prior) in enumerate(settings)
    )
    return f"settings(setting, alpha, pw, lim) AS (VALUES {rows})"


def model_ctes(src: str, classes: int, settings) -> list[str]:
    """Counts, weights and scores; ``member(K, fold, id, label, role)`` says who trains."""
    labels = ", ".join(str(c) for c in range(classes))
    return [
        settings_cte(settings),
        f"tok0 AS (SELECT id, string_split_regex(lower(text), ' +') AS ws FROM {src})",
        "tok AS (SELECT id, unnest(ws) AS token, generate_subscripts(ws, 1) AS pos FROM tok0)",
        f"classes AS (SELECT unnest([{labels}]) AS label)",
        """cnt AS (SELECT K, fold, setting, token, label, count(*) AS n
  FROM member JOIN tok USING (id) JOIN settings s ON (s.lim IS NULL OR pos <= s.lim)
  WHERE role = 'train' GROUP BY ALL)""",
        "voc AS (SELECT DISTINCT K, fold, setting, token FROM cnt)",
        "size AS (SELECT K, fold, setting, count(*) AS v FROM voc GROUP BY ALL)",
        "tot AS (SELECT K, fold, setting, label, sum(n) AS t FROM cnt GROUP BY ALL)",
        f"""prior AS (
  SELECT K, fold, c.label, ln((count(*) FILTER (WHERE m.label = c.label) + 1) / (count(*) + {classes})) AS lp
  FROM member m, classes c WHERE role = 'train' GROUP BY ALL)""",
        """w AS (
  SELECT K, fold, setting, token, c.label, coalesce(n, 0) AS n,
    ln(coalesce(n, 0) + alpha) - ln(coalesce(t, 0) + alpha * v) AS lw
  FROM voc CROSS JOIN classes c JOIN settings USING (setting) JOIN size USING (K, fold, setting)
  LEFT JOIN tot USING (K, fold, setting, label) LEFT JOIN cnt USING (K, fold, setting, token, label))""",
        # Log odds against the first class, of tokens and of priors.
        "odds AS (SELECT a.*, a.lw - b.lw AS lo FROM w a JOIN w b USING (K, fold, setting, token) WHERE b.label = 0)",
        "prior_odds AS (SELECT a.K, a.fold, a.label, a.lp - b.lp AS lp FROM prior a JOIN prior b USING (K, fold) WHERE b.label = 0)",
    ]


def score_ctes(where: str) -> list[str]:
    """``scored``: one row per run, setting, row and class, over the members that match."""
    return [
        f"wanted AS (SELECT * FROM member WHERE {where})",
        """sums AS (
  SELECT K, fold, setting, id, o.label, sum(CAST(round(lo * 1e9) AS BIGINT)) AS s
  FROM wanted m JOIN tok USING (id) JOIN settings st ON (st.lim IS NULL OR pos <= st.lim)
  JOIN odds o USING (K, fold, setting, token) GROUP BY ALL)""",
        """logit AS (
  SELECT m.K, m.fold, st.setting, m.id, m.label AS y_true, m.role, c.label AS c,
    coalesce(s, 0)::DOUBLE / 1e9 + pw * lp AS x
  FROM wanted m CROSS JOIN settings st CROSS JOIN classes c
  JOIN prior_odds p ON (p.K = m.K AND p.fold = m.fold AND p.label = c.label)
  LEFT JOIN sums z ON (z.K = m.K AND z.fold = m.fold AND z.setting = st.setting AND z.id = m.id AND z.label = c.label))""",
        """top AS (SELECT K, fold, setting, id, max(x) AS mx FROM logit GROUP BY ALL)""",
        """scored AS (
  SELECT K, fold, setting, id, role, y_true,
    min(c) FILTER (WHERE x = mx) AS y_pred,
    ln(sum(exp(x - mx))) + any_value(mx) - max(x) FILTER (WHERE c = y_true) AS loss,
    list(x ORDER BY c) AS xs,
    list(exp(x - mx) ORDER BY c) AS es
  FROM logit JOIN top USING (K, fold, setting, id) GROUP BY ALL)""",
    ]


def class_metrics(src: str, by: str, name: str = "pc", weight: str = "1") -> list[str]:
    """``name``: precision, recall, F1, support per class seen, from (y_true, y_pred) rows."""
    return [
        f"""{name}_s AS (
  SELECT {by}label, CAST(sum(sup) AS BIGINT) AS support, sum(prd) AS predicted, sum(tp) AS tp FROM (
    SELECT {by}y_true AS label, {weight} AS sup, 0 AS prd, CASE WHEN y_true = y_pred THEN {weight} ELSE 0 END AS tp FROM {src}
    UNION ALL SELECT {by}y_pred, 0, {weight}, 0 FROM {src}) GROUP BY {by}label)""",
        f"""{name} AS (
  SELECT {by}label, CASE WHEN predicted = 0 THEN 0 ELSE tp / predicted END AS precision,
    CASE WHEN support = 0 THEN 0 ELSE tp / support END AS recall,
    2 * tp / (predicted + support) AS f1, support, CAST(tp AS BIGINT) AS tp FROM {name}_s)""",
    ]


OVERALL = """sum(tp) / sum(support) AS accuracy,
    avg(precision) AS precision_macro, avg(recall) AS recall_macro, avg(f1) AS f1_macro,
    sum(precision * support) / sum(support) AS precision_weighted,
    sum(recall * support) / sum(support) AS recall_weighted,
    sum(f1 * support) / sum(support) AS f1_weighted"""
RUN = "K, fold, setting, role, "
MEASURED = [
    *class_metrics("scored", RUN),
    f"ov AS (SELECT {RUN}{OVERALL} FROM pc GROUP BY K, fold, setting, role)",
    "ls AS (SELECT K, fold, setting, role, avg(loss) AS loss FROM scored GROUP BY ALL)",
    """chosen AS (
  SELECT K, fold, setting, f1_macro AS val_f1_macro FROM ov WHERE role = 'val'
  QUALIFY row_number() OVER (PARTITION BY K, fold ORDER BY f1_macro DESC, setting) = 1)""",
]
METRIC_NAMES = (
    "accuracy", "precision_macro", "recall_macro", "f1_macro",
    "precision_weighted", "recall_weighted", "f1_weighted",
)


def rounded(names, digits: int = 6) -> str:
    return ", ".join(f"round({n}, {digits}) AS {n}" for n in names)


def holdout_model(settings=DEFAULT_SETTINGS) -> list[str]:
    return [
        *BASE,
        THREE,
        *holdout_ctes("three"),
        "member AS (SELECT 1 AS K, 1 AS fold, id, label, role FROM roles)",
        *model_ctes("three", 3, settings),
    ]


HOLDOUT_MEASURED = [*holdout_model(), *score_ctes("role <> 'train'"), *MEASURED]
HOLDOUT_ALL = [
    *HOLDOUT_MEASURED,
    # All rows, scored by the chosen setting.
    *[
        c.replace("wanted", "wanted_a")
        .replace("sums", "sums_a")
        .replace("logit AS", "logit_a AS")
        .replace("FROM logit", "FROM logit_a")
        .replace("top AS", "top_a AS")
        .replace("JOIN top", "JOIN top_a")
        .replace("scored AS", "scored_a AS")
        for c in score_ctes("true")
    ],
]
HOLDOUT_TEST_METRICS = f"""SELECT K, fold, setting, {rounded(METRIC_NAMES)}, round(loss, 6) AS loss,
  round(val_f1_macro, 6) AS val_f1_macro, false AS leaky
FROM ov JOIN ls USING (K, fold, setting, role) JOIN chosen USING (K, fold, setting) WHERE role = 'test'"""


def fold_results(source: str, classes: int, ctes: list[str]) -> list[str]:
    return [
        *BASE,
        TWO,
        THREE,
        *ctes,
        *model_ctes(source, classes, DEFAULT_SETTINGS),
        *score_ctes("role <> 'train'"),
        *MEASURED,
        """sizes AS (SELECT K, fold, count(*) FILTER (WHERE role = 'train') AS train_n,
    count(*) FILTER (WHERE role = 'val') AS val_n, count(*) FILTER (WHERE role = 'test') AS test_n
  FROM member GROUP BY ALL)""",
        """fr AS (
  SELECT K, fold, train_n, val_n, test_n, round(loss, 6) AS eval_loss, accuracy, f1_macro, precision_macro, recall_macro, setting
  FROM ov JOIN ls USING (K, fold, setting, role) JOIN chosen USING (K, fold, setting) JOIN sizes USING (K, fold)
  WHERE role = 'test')""",
    ]


KFOLD_RESULTS = fold_results("two", 2, [*KFOLD, ALL_K])
FOLD_COLUMNS = """K, fold, train_n, val_n, test_n, eval_loss, round(accuracy, 6) AS eval_accuracy,
  round(f1_macro, 6) AS eval_f1_macro, round(precision_macro, 6) AS eval_precision_macro,
  round(recall_macro, 6) AS eval_recall_macro, setting"""
THREE_CLASS_FOLDS = fold_results(
    "three",
    3,
    [
        *ranked("three"),
        *held("h1", "n0", 1, 5),
        *fold_ctes(3),
        ALL_K.replace("SELECT 1 AS K, 1 AS fold, id, label, role FROM single\n  UNION ALL\n  SELECT 3, f.i, id,", "SELECT 3 AS K, f.i AS fold, id,").replace("ELSE 'train' END\n", "ELSE 'train' END AS role\n"),
    ],
)


def draw(name: str, search: str) -> str:
    digest = f"md5('42|' || {search} || '|' || trial || '|{name}')"
    return f"(CAST('0x' || substr({digest}, 1, 8) AS BIGINT) / 4294967296.0::DOUBLE)"


def drawn(name: str, p, search: str) -> str:
    u = draw(name, search)
    kind, low, *_, high = p
    if kind == "log":
        return f"round(exp({math.log(low)!r}::DOUBLE + {u} * {math.log(high / low)!r}::DOUBLE), 12)"
    if kind == "even":
        return f"round({low!r}::DOUBLE + {u} * {high - low!r}::DOUBLE, 12)"
    if kind == "whole":
        return f"CAST(floor({u} * {high - low + 1}) + {low} AS INTEGER)"
    options = ", ".join(map(str, p[1:]))
    return f"([{options}])[CAST(floor({u} * {len(p) - 1}) AS INTEGER) + 1]"


def trial_sql(space, n: int) -> str:
    columns = ", ".join(f"{drawn(name, p, 'source')} AS {name}" for name, p in space.items())
    return f"""SELECT source, trial, {columns}
FROM (SELECT DISTINCT source FROM documents), (SELECT unnest(range(1, {n + 1}))::INTEGER AS trial)"""


def search_model() -> list[str]:
    space = {n: drawn(n, p, "'count_model'") for n, p in COUNT_MODEL_SPACE.items()}
    drawn_rows = f"""settings AS (
  SELECT trial - 1 AS setting, {space['smoothing']} AS alpha, {space['prior_weight']} AS pw, NULL::INTEGER AS lim
  FROM (SELECT unnest(range(1, {TEXT_TRIALS + 1}))::INTEGER AS trial))"""
    return [
        *BASE,
        TWO,
        *nested_ctes("two"),
        "member AS (SELECT 1 AS K, 1 AS fold, id, label, role FROM roles)",
        drawn_rows,
        *model_ctes("two", 2, [])[1:],
        *score_ctes("role <> 'train'"),
        *MEASURED,
    ]


def full_fit(settings) -> list[str]:
    return [
        *BASE,
        TWO,
        "member AS (SELECT 1 AS K, 1 AS fold, id, label, 'train' AS role FROM two)",
        *model_ctes("two", 2, settings),
    ]


ONE = DEFAULT_SETTINGS[:1]
NB_MODEL = with_(full_fit(ONE), "SELECT token, 'add_one' AS model, label, n, round(lw, 6) AS log_prob FROM w")
NB_PREDICT = with_(
    [*full_fit(ONE), *score_ctes("true")],
    "SELECT id AS row_key, y_true AS label, round(xs[2], 6) AS log_odds, y_pred FROM scored",
)
PREDICT_ALL = with_(
    HOLDOUT_ALL,
    f"""SELECT t.id, t.text, t.sentiment, y_pred AS pred_id, {display('y_pred', ('negative', 'off', 'positive'))} AS pred_sentiment,
  round(es[1] / list_sum(es), 6) AS prob_negative, round(es[2] / list_sum(es), 6) AS prob_off,
  round(es[3] / list_sum(es), 6) AS prob_positive
FROM scored_a JOIN chosen USING (K, fold, setting) JOIN three t USING (id)""",
)


# --- run logs -------------------------------------------------------------------

EPOCHS = """ep AS (
  SELECT user_id AS run, event_id, ts, value AS metric, event_type, props,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS epoch FROM events)"""
HMS = """CASE WHEN w < 86400 THEN '' WHEN w < 172800 THEN '1 day, ' ELSE (w // 86400) || ' days, ' END ||
  (w % 86400 // 3600) || ':' || lpad((w % 3600 // 60)::VARCHAR, 2, '0') || ':' || lpad((w % 60)::VARCHAR, 2, '0')"""


def runtime(by: str) -> str:
    return f"""WITH t AS (
  SELECT user_id AS run, event_type AS stage, CAST(value AS DECIMAL(18, 2)) AS s FROM events),
g AS (SELECT {by}, sum(s) AS s, CAST(trunc(sum(s)) AS BIGINT) AS w FROM t GROUP BY {by})
SELECT {by}, CAST(s AS DOUBLE) AS seconds, {HMS} AS time_hms FROM g"""


# --- scalar functions -----------------------------------------------------------


def letters(c: str) -> str:
    return f"regexp_replace(lower({strip(f'coalesce({c}, {quote(str())})')}), '[^\\p{{L}}]', '', 'g')"


def label_text(c: str, policy) -> str:
    names, fallback, _ = policy
    cases = " ".join(f"WHEN starts_with({letters(c)}, '{n[:3]}') THEN '{n}'" for n in names)
    return f"CASE {cases} ELSE '{fallback}' END"


def label_id(c: str, policy) -> str:
    names, _, fallback = policy
    cases = " ".join(f"WHEN '{n}' THEN {i}" for i, n in enumerate(names))
    return f"CASE {label_text(c, policy)} {cases} ELSE {fallback} END"


def template(task: str, style: str) -> str:
    cases = " ".join(
        f"WHEN {task} = '{t}' AND {style} = '{s}' THEN {quote(a)} || text || {quote(b)}"
        for (t, s), (a, b) in TASK_TEMPLATES.items()
    )
    return f"CASE {cases} END"


MULTITASK = f"""mt AS (
  SELECT doc_id, {clean('text')} AS text, sentiment, source AS topic, string_split(text, chr(10))[-1] AS selected_text FROM sheet)"""
TOKENS = f"""tk AS (
  SELECT doc_id, CASE WHEN {clean('text')} = '' THEN [] ELSE string_split_regex(lower({clean('text')}), ' +') END[1:256] AS t
  FROM documents)"""
CELLS = "(SELECT unnest([0, 1, 2]) AS y_true) a, (SELECT unnest([0, 1, 2]) AS y_pred) b"


def report(src: str, names: tuple[str, ...], weight: str = "1") -> tuple[list[str], str]:
    ctes = class_metrics(src, "", "rp", weight)
    body = f"""SELECT {display('label', names)} AS name, round(precision, 4) AS precision, round(recall, 4) AS recall,
  round(f1, 4) AS f1, support FROM rp
UNION ALL SELECT 'accuracy', NULL, NULL, round(sum(tp) / sum(support), 4), sum(support)::BIGINT FROM rp
UNION ALL SELECT 'macro avg', round(avg(precision), 4), round(avg(recall), 4), round(avg(f1), 4), sum(support)::BIGINT FROM rp
UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 4), round(sum(recall * support) / sum(support), 4),
  round(sum(f1 * support) / sum(support), 4), sum(support)::BIGINT FROM rp"""
    return ctes, body


def report_sql(before: list[str], src: str, names: tuple[str, ...]) -> str:
    ctes, body = report(src, names)
    return with_([*before, *ctes], body)


THREE_NAMES, TWO_NAMES = ("negative", "off", "positive"), ("negative", "positive")
ROLES = "SELECT id, label, role FROM roles"

COMPARE = with_(
    [*holdout_model(), *score_ctes("true")],
    f"""SELECT id AS row_key, t.sentiment, smoothing_0, smoothing_1, smoothing_2,
  (lower(smoothing_0) = t.sentiment)::INTEGER + (lower(smoothing_1) = t.sentiment)::INTEGER
    + (lower(smoothing_2) = t.sentiment)::INTEGER AS n_agree_gold,
  len(list_distinct([smoothing_0, smoothing_1, smoothing_2]))::INTEGER AS n_distinct
FROM (SELECT id, {', '.join(f"max({display('y_pred', THREE_NAMES)}) FILTER (WHERE setting = {i}) AS smoothing_{i}" for i in range(3))}
  FROM scored GROUP BY id) JOIN three t USING (id)""",
)

ORACLE = {
    "load_reviews": with_([SHEET], "SELECT * FROM sheet"),
    "select_by_position": with_(BASE[:2], "SELECT * FROM raw"),
    "drop_null_subset": with_(BASE[:2], "SELECT * FROM raw WHERE text IS NOT NULL AND sentiment IS NOT NULL"),
    "drop_null_any": with_(
        [SHEET],
        """SELECT doc_id, quality, toxic, sentiment FROM sheet WHERE doc_id IS NOT NULL AND lang IS NOT NULL
  AND source IS NOT NULL AND n_chars IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL
  AND text IS NOT NULL AND sentiment IS NOT NULL""",
    ),
    "clean_text": f"SELECT doc_id AS id, {clean('text')} AS text FROM documents",
    "drop_empty_text": f"""WITH l AS (
  SELECT doc_id, generate_subscripts(ls, 1)::INTEGER - 1 AS line, unnest(ls) AS text
  FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))
SELECT doc_id, line, {clean('text')} AS text FROM l WHERE {clean('text')} <> ''""",
    "normalise_label": with_(BASE[:2], f"SELECT id, {norm('sentiment')} AS sentiment FROM raw"),
    "missing_to_off": with_(BASE[:2], f"SELECT id, {off(norm('sentiment'))} AS sentiment FROM raw"),
    "keep_label_domain": with_(
        BASE[:2],
        f"SELECT id, {norm('sentiment')} AS sentiment FROM raw WHERE {norm('sentiment')} IN ('negative', 'positive')",
    ),
    "dataset_with_off": with_([*BASE, THREE], "SELECT * FROM three"),
    "dataset_remove_off": with_([*BASE, TWO], "SELECT * FROM two"),
    "encode_label": with_([*BASE, THREE], "SELECT id, sentiment, label FROM three"),
    "decode_label": with_(RATED, f"SELECT id, y_pred, {display('y_pred', THREE_NAMES)} AS pred_sentiment FROM rated"),
    "correct_flag": with_(RATED, "SELECT id, y_true, y_pred, y_true = y_pred AS correct FROM rated"),
    "split_train_test": with_([*BASE, TWO, *train_test_ctes("two")], ROLES),
    "split_80_10_10": with_([*BASE, THREE, *holdout_ctes("three")], ROLES),
    "split_64_16_20": with_([*BASE, TWO, *nested_ctes("two")], ROLES),
    "kfold_assign": with_([*BASE, TWO, *KFOLD], "SELECT id, label, role FROM folds"),
    "kfold_all_k": with_([*BASE, TWO, *KFOLD, ALL_K], "SELECT * FROM member"),
    "split_sizes": with_([*BASE, TWO, *KFOLD, ALL_K], "SELECT K, fold, role, count(*) AS n FROM member GROUP BY ALL"),
    "attach_predictions": with_(
        [*RATED, RAW], "SELECT raw.id, text, raw.sentiment, y_pred FROM raw LEFT JOIN rated USING (id)"
    ),
    "compare_models": COMPARE,
    "compare_models_one_pass": COMPARE,
    "row_count": with_([*BASE, THREE], "SELECT count(*) AS n_rows FROM three"),
    "label_counts": with_([*BASE, THREE], "SELECT sentiment, count(*) AS n FROM three GROUP BY sentiment"),
    "confusion_matrix": with_(
        RATED,
        f"""SELECT lang, y_true, y_pred, count(r.id) AS n FROM (SELECT DISTINCT lang FROM rated) g, {CELLS}
LEFT JOIN rated r USING (lang, y_true, y_pred) GROUP BY ALL""".replace(
            f"(SELECT DISTINCT lang FROM rated) g, {CELLS}",
            f"(SELECT lang, y_true, y_pred FROM (SELECT DISTINCT lang FROM rated), {CELLS}) g",
        ),
    ),
    "confusion_wide": with_(
        RATED,
        """SELECT t.y_true, count(*) FILTER (WHERE y_pred = 0) AS pred_0, count(*) FILTER (WHERE y_pred = 1) AS pred_1,
  count(*) FILTER (WHERE y_pred = 2) AS pred_2
FROM (SELECT unnest([0, 1, 2]) AS y_true) t LEFT JOIN rated USING (y_true) GROUP BY ALL""",
    ),
    "confusion_padded": f"""SELECT y_true, y_pred, count(l.doc_id) AS n
FROM (SELECT y_true, y_pred FROM {CELLS}) g
LEFT JOIN (SELECT doc_id, quality AS y_true, 1 - toxic AS y_pred FROM labels) l USING (y_true, y_pred) GROUP BY ALL""",
    "confusion_observed": with_(
        [*RATED, "seen AS (SELECT lang, y_true AS c FROM rated UNION SELECT lang, y_pred FROM rated)"],
        """SELECT lang, y_true, y_pred, count(r.id) AS n
FROM (SELECT a.lang, a.c AS y_true, b.c AS y_pred FROM seen a JOIN seen b USING (lang)) g
LEFT JOIN rated r USING (lang, y_true, y_pred) GROUP BY ALL""",
    ),
    "metrics_per_class": with_(
        [*RATED, *class_metrics("rated", "lang, ")],
        f"SELECT lang, label, {rounded(('precision', 'recall', 'f1'))}, support, tp FROM pc",
    ),
    "metrics_overall": with_(
        [*RATED, *class_metrics("rated", "lang, "), f"o AS (SELECT lang, {OVERALL} FROM pc GROUP BY lang)"],
        f"SELECT lang, {rounded(METRIC_NAMES)} FROM o",
    ),
    "classification_report": report_sql(RATED, "rated", THREE_NAMES),
    "exact_match": with_(
        [
            SHEET,
            f"""g AS (SELECT lang, 'sentiment' AS task, {off(norm('sentiment'))} AS gold FROM sheet
  UNION ALL SELECT lang, 'topic', source FROM sheet)""",
            "c1 AS (SELECT task, lang, gold, count(*) AS n FROM g GROUP BY ALL)",
            "c2 AS (SELECT task, gold, count(*) AS n FROM g GROUP BY ALL)",
            "b1 AS (SELECT * FROM c1 QUALIFY row_number() OVER (PARTITION BY task, lang ORDER BY n DESC, gold) = 1)",
            "b2 AS (SELECT * FROM c2 QUALIFY row_number() OVER (PARTITION BY task ORDER BY n DESC, gold) = 1)",
        ],
        """SELECT task, 'prompt' AS style, round(avg((g.gold = b1.gold)::INTEGER), 6) AS accuracy, count(*) AS n
FROM g JOIN b1 USING (task, lang) GROUP BY task
UNION ALL
SELECT task, 'prefix', round(avg((g.gold = b2.gold)::INTEGER), 6), count(*) FROM g JOIN b2 USING (task) GROUP BY task""",
    ),
    "throughput": """WITH l AS (SELECT user_id AS run, count(*) AS n_rows,
  CAST(sum(CAST(value AS DECIMAL(18, 2))) AS DOUBLE) AS seconds FROM events GROUP BY user_id)
SELECT run, n_rows, round(seconds, 6) AS seconds, round(seconds / n_rows, 6) AS seconds_per_row,
  round(n_rows / seconds, 6) AS rows_per_second, round(((n_rows + 15) // 16) / seconds, 6) AS steps_per_second FROM l""",
    "best_epoch": """SELECT user_id AS run, event_id AS epoch, value AS metric FROM events
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) = 1""",
    "early_stop": with_(
        [
            EPOCHS,
            """im AS (SELECT *, metric > coalesce(max(metric) OVER (PARTITION BY run ORDER BY epoch
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '-inf'::DOUBLE) AS better FROM ep)""",
            """ws AS (SELECT *, epoch - max(CASE WHEN better THEN epoch END) OVER (PARTITION BY run ORDER BY epoch) AS waited
  FROM im)""",
        ],
        "SELECT run, min(epoch) FILTER (WHERE waited = 2) AS stop_epoch, max(epoch) AS last_epoch FROM ws GROUP BY run",
    ),
    "best_trial": " UNION ALL ".join(
        f"""(SELECT user_id AS run, event_id AS trial, value AS metric, event_type, props, '{name}' AS direction FROM events
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY value {order}, event_id) = 1)"""
        for name, order in (("maximise", "DESC"), ("minimise", "ASC"))
    ),
    "runtime_summary": runtime("stage"),
    "runtime_by_run": runtime("run, stage"),
    "append_results": f"""SELECT * FROM ({with_(KFOLD_RESULTS, f"SELECT {FOLD_COLUMNS}, 2 AS classes FROM fr")})
UNION ALL SELECT * FROM ({with_(THREE_CLASS_FOLDS, f"SELECT {FOLD_COLUMNS}, 3 AS classes FROM fr")})""",
    "sentiment_prompt": "SELECT doc_id AS id, "
    + ", ".join(f"{quote(p)} || {clean('text')} AS {v}" for v, p in SENTIMENT_PREFIXES.items())
    + " FROM documents",
    "task_prompt": with_(
        [
            SHEET,
            MULTITASK,
            """k AS (SELECT *, CASE WHEN topic < 'src2' THEN 'sentiment' WHEN topic < 'src5' THEN 'topic' ELSE 'selected' END AS task,
  CASE WHEN sentiment IS NULL THEN 'prefix' ELSE 'prompt' END AS style FROM mt)""",
        ],
        f"SELECT doc_id, {template('task', 'style')} AS prompt FROM k",
    ),
    "multitask_examples": with_(
        [SHEET, MULTITASK],
        f"""SELECT doc_id, task, style, {template('task', 'style')} AS input_text,
  {norm("CASE task WHEN 'sentiment' THEN sentiment WHEN 'topic' THEN topic ELSE selected_text END")} AS target_text
FROM mt, (SELECT unnest(['sentiment', 'topic', 'selected']) AS task), (SELECT unnest(['prefix', 'prompt']) AS style)
WHERE sentiment IS NOT NULL AND topic IS NOT NULL AND text IS NOT NULL AND selected_text IS NOT NULL""",
    ),
    "text_to_label": with_(
        [SHEET], f"SELECT doc_id, {label_text('sentiment', FALLBACKS['three_class'])} AS label FROM sheet"
    ),
    "text_fallback": "SELECT conv_id, turn, "
    + ", ".join(f"{label_id('text', p)} AS {n}" for n, p in FALLBACKS.items())
    + " FROM conversations",
    "softmax_scores": """WITH e AS (
  SELECT vec_id, generate_subscripts(embedding, 1)::INTEGER - 1 AS class_id, unnest(embedding)::DOUBLE AS x FROM embeddings),
m AS (SELECT *, exp(x - max(x) OVER (PARTITION BY vec_id)) AS p FROM e)
SELECT vec_id, class_id, round(p / sum(p) OVER (PARTITION BY vec_id), 9) AS probability FROM m""",
    "argmax_scores": "SELECT vec_id, list_position(embedding, list_max(embedding))::INTEGER - 1 AS pred_id FROM embeddings",
    "bounded_tokens": f"WITH {TOKENS} SELECT doc_id, len(t)::INTEGER AS n_tokens, array_to_string(t, ' ') AS tokens FROM tk",
    "pad_tokens": f"""WITH {TOKENS}
SELECT doc_id, rtrim(array_to_string(t, ' ') || CASE WHEN len(t) = 0 THEN '' ELSE ' ' END || repeat('<pad> ', 256 - len(t)), ' ') AS tokens,
  repeat('1', len(t)) || repeat('0', 256 - len(t)) AS mask FROM tk""",
    "nb_model": NB_MODEL,
    "nb_predict": NB_PREDICT,
    "nb_predict_large_vocabulary": NB_PREDICT,
    "predict_all": PREDICT_ALL,
    "predict_test": with_(
        [
            *BASE,
            TWO,
            *train_test_ctes("two"),
            """member AS (SELECT 1 AS K, 1 AS fold, id, label, role FROM roles
  UNION ALL SELECT 1, 1, id, label, 'val' FROM roles WHERE role = 'test')""",
            *model_ctes("two", 2, DEFAULT_SETTINGS),
            *score_ctes("role = 'val'"),
            *MEASURED,
        ],
        f"""SELECT id, t.text, t.sentiment, t.label, {display('y_pred', TWO_NAMES)} AS pred_sentiment, y_pred = t.label AS correct, true AS leaky
FROM scored JOIN chosen USING (K, fold, setting) JOIN two t USING (id)""",
    ),
    "holdout_metrics": with_(HOLDOUT_MEASURED, HOLDOUT_TEST_METRICS),
    "holdout_report": report_sql(
        [*HOLDOUT_MEASURED, "tp AS (SELECT s.* FROM scored s JOIN chosen USING (K, fold, setting) WHERE role = 'test')"],
        "tp",
        THREE_NAMES,
    ),
    "holdout_confusion": with_(
        [*HOLDOUT_MEASURED, "tp AS (SELECT s.* FROM scored s JOIN chosen USING (K, fold, setting) WHERE role = 'test')"],
        f"""SELECT y_true, y_pred, count(id) AS n FROM (SELECT y_true, y_pred FROM {CELLS}) g
LEFT JOIN tp USING (y_true, y_pred) GROUP BY ALL""",
    ),
    "kfold_results": with_(KFOLD_RESULTS, f"SELECT {FOLD_COLUMNS} FROM fr"),
    "kfold_summary": with_(
        KFOLD_RESULTS,
        "SELECT K, "
        + ", ".join(
            f"round(avg({m}), 6) AS eval_{m}_mean, round(stddev_samp({m}), 6) AS eval_{m}_std"
            for m in ("accuracy", "f1_macro", "precision_macro", "recall_macro")
        )
        + " FROM fr GROUP BY K",
    ),
    "hp_trials": trial_sql(TEXT_SPACE, TEXT_TRIALS),
    "hp_trials_classifier": trial_sql(CLASSIFIER_SPACE, CLASSIFIER_TRIALS),
    "search_trials": with_(
        search_model(),
        """SELECT setting + 1 AS trial, round(alpha, 6) AS smoothing, round(pw, 6) AS prior_weight,
  round(loss, 6) AS loss, round(accuracy, 6) AS accuracy, round(f1_macro, 6) AS f1_macro
FROM ov JOIN ls USING (K, fold, setting, role) JOIN settings USING (setting) WHERE role = 'val'""",
    ),
    "search_best": with_(search_model(), HOLDOUT_TEST_METRICS),
    "batch_classifier": f"""WITH x AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
l AS (SELECT vec_id, list_avg(e[1:22]) AS a, list_avg(e[23:43]) AS b, list_avg(e[44:64]) AS c FROM x),
p AS (SELECT vec_id, exp(a - greatest(a, b, c)) AS a, exp(b - greatest(a, b, c)) AS b, exp(c - greatest(a, b, c)) AS c FROM l),
q AS (SELECT *, CASE WHEN a >= b AND a >= c THEN 0 WHEN b >= c THEN 1 ELSE 2 END AS pred_id FROM p)
SELECT vec_id, pred_id, {display('pred_id', THREE_NAMES)} AS pred_sentiment, round(a / (a + b + c), 6) AS prob_negative,
  round(b / (a + b + c), 6) AS prob_off, round(c / (a + b + c), 6) AS prob_positive FROM q""",
    "batch_text_model": f"""WITH c AS (SELECT conv_id, turn, string_split({clean('text')}, ' ')[1] AS pred_text_raw FROM conversations)
SELECT conv_id, turn, pred_text_raw, {label_text('pred_text_raw', FALLBACKS['three_class'])} AS pred_label,
  {label_id('pred_text_raw', FALLBACKS['three_class'])} AS pred_id,
  {display(label_id('pred_text_raw', FALLBACKS['three_class']), THREE_NAMES)} AS pred_sentiment FROM c""",
    "export_predictions": PREDICT_ALL,
    "saved_model": NB_MODEL,
}
# Prefix and policy are written out here, so that a wrong constant of the package is found.
ANSWERED = """answered AS (
  SELECT id, text, sentiment, label AS y_true, role, CASE n % 3 WHEN 0 THEN ' Positive!' WHEN 1 THEN 'neg' ELSE 'unsure' END AS pred_text_raw,
    CASE n % 3 WHEN 0 THEN 2 WHEN 1 THEN 0 ELSE 1 END AS y_pred
  FROM (SELECT *, length('sentiment classification (negative, off, positive): ' || text) AS n FROM three JOIN (SELECT id, role FROM roles) USING (id)))"""
ANSWERS = [*BASE, THREE, *holdout_ctes("three"), ANSWERED]
ORACLE |= {
    "text_experiment_metrics": with_(
        [*ANSWERS, *class_metrics("answered", "role, "), f"o AS (SELECT role, {OVERALL} FROM pc GROUP BY role)"],
        f"SELECT role, {rounded(METRIC_NAMES)} FROM o",
    ),
    "text_experiment_export": with_(
        ANSWERS, f"SELECT id, text, sentiment, pred_text_raw, {display('y_pred', THREE_NAMES)} AS pred_sentiment FROM answered"
    ),
    "best_epoch_diverged": """SELECT run, epoch, metric FROM (
  SELECT user_id AS run, event_id AS epoch, value AS metric,
    row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS r
  FROM events WHERE event_id % 7 <> 0 AND value IS NOT NULL) WHERE r = 1""",
    "best_trial_diverged": """SELECT run, trial, metric, event_type FROM (
  SELECT user_id AS run, event_id AS trial, value AS metric, event_type,
    row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) AS r
  FROM events WHERE event_id % 7 <> 0 AND value IS NOT NULL) WHERE r = 1""",
    "csv_round_trip": f"SELECT id, sentiment FROM ({ORACLE['select_by_position']})",
    "predict_all_repeated_ids": with_(
        [*BASE, THREE],
        """SELECT id, 2 AS n_rows, true AS same_prediction FROM three
UNION ALL SELECT NULL, count(*), true FROM three""",
    ),
    "logistic_regression": with_(
        [*BASE, TWO, *nested_ctes("two")],
        """SELECT label, count(*) AS n_test, count(*) AS n_same, true AS beats_majority
FROM roles WHERE role = 'test' GROUP BY label""",
    ),
    "kfold_user_metrics": with_(
        [
            *KFOLD_RESULTS,
            """sides AS (
  SELECT K, fold, sum(tp) / sum(support) AS po, sum(support * predicted) / (sum(support) * sum(support)) AS pe,
    avg(tp / support) FILTER (support > 0) AS eval_balanced_accuracy
  FROM pc_s JOIN chosen USING (K, fold, setting) WHERE role = 'test' GROUP BY ALL)""",
        ],
        """SELECT K, fold, round((po - pe) / (1 - pe), 6) AS eval_kappa, round(eval_balanced_accuracy, 6) AS eval_balanced_accuracy,
  round(po, 6) AS eval_accuracy FROM sides""",
    ),
    "count_estimator": with_(
        [
            *BASE,
            TWO,
            *ranked("two"),
            *held("h1", "n0", 1, 5),
            *fold_ctes(3),
            """member AS (
  SELECT 1 AS K, 1 AS fold, id, label, CASE WHEN role = 'test' THEN 'test' ELSE 'train' END AS role FROM folds
  UNION ALL
  SELECT 3, f.i, id, label, CASE WHEN role = 'fold' || f.i THEN 'val' ELSE 'train' END
  FROM folds, (SELECT unnest([1, 2, 3]) AS i) f WHERE role <> 'test')""",
            *model_ctes("two", 2, DEFAULT_SETTINGS),
            *score_ctes("role <> 'train'"),
            *MEASURED,
            """winner AS (
  SELECT setting FROM ov WHERE K = 3 AND role = 'val' GROUP BY setting ORDER BY round(avg(f1_macro), 12) DESC, setting LIMIT 1)""",
        ],
        """SELECT id AS row_key, y_true AS label, round(xs[2], 6) AS log_odds, y_pred
FROM scored JOIN winner USING (setting) WHERE K = 1 AND role = 'test'""",
    ),
    "saved_artefact": PREDICT_ALL,
    "stream_predictions": f"SELECT * EXCLUDE (sentiment) FROM ({PREDICT_ALL})",
}

ORACLE["predict_all_joined"] = ORACLE["predict_all"]


# --- trained classifier ---------------------------------------------------------

# Places, factor of the learning rate and patience, as the queries have them.
WIDTH, STEP, PATIENCE = 2048, 100000, 1
TRIAL_SQL = {n: drawn(n, p, "'classifier'") for n, p in CLASSIFIER_SPACE.items()}
# One row per trial and step holds all weights as a list. A step joins the rows of its batch, adds up
# their gradient by place (a zero for every place first) and moves the list.
TRAINED = [
    *BASE,
    TWO,
    *nested_ctes("two"),
    "words AS (SELECT id, unnest(string_split_regex(lower(text), ' +')) AS token FROM two)",
    f"""hits AS (
  SELECT id, 1 + CAST('0x' || substr(md5(token), 1, 8) AS BIGINT) % {WIDTH - 1} AS i, count(*) AS n
  FROM words WHERE token <> '' GROUP BY ALL)""",
    """places AS (
  SELECT id, i, n / sqrt((sum(n * n) OVER (PARTITION BY id))::DOUBLE) AS x FROM hits UNION ALL SELECT id, 0, 1.0 FROM two)""",
    "vectors AS (SELECT id, list(i + 1 ORDER BY i) AS ix, list(x ORDER BY i) AS xs FROM places GROUP BY id)",
    """rowz AS (
  SELECT id, label, role, ix, xs, row_number() OVER (PARTITION BY role ORDER BY md5('42|' || id), id) - 1 AS pos
  FROM roles JOIN vectors USING (id))""",
    f"""trials AS (
  SELECT trial, {TRIAL_SQL['learning_rate']} AS learning_rate, {TRIAL_SQL['per_device_train_batch_size']} AS b,
    {TRIAL_SQL['num_train_epochs']} AS epochs, {TRIAL_SQL['weight_decay']} AS decay
  FROM (SELECT unnest(range(1, {CLASSIFIER_TRIALS + 1}))::INTEGER AS trial))""",
    "plan AS (SELECT *, (SELECT count(*) FROM rowz WHERE role = 'train') AS n FROM trials)",
    f"""steps AS (
  SELECT trial, 0 AS k, list_resize([]::DOUBLE[], {WIDTH}, 0.0) AS w FROM plan
  UNION ALL
  SELECT trial, k + 1, list_transform(w, lambda v, j: v * (1 - learning_rate * decay) - g[j]) FROM (
    SELECT trial, k, any_value(w) AS w, any_value(learning_rate) AS learning_rate, any_value(decay) AS decay, list(g ORDER BY i) AS g FROM (
      SELECT trial, k, i, any_value(w) AS w, any_value(learning_rate) AS learning_rate, any_value(decay) AS decay,
        any_value(learning_rate) * {STEP} * sum(gx) / max(m) AS g FROM (
        SELECT trial, k, w, learning_rate, decay, m, unnest(ix) AS i, unnest(list_transform(xs, lambda x: x * r)) AS gx FROM (
          SELECT s.trial, s.k, s.w, p.learning_rate, p.decay, count(*) OVER (PARTITION BY s.trial) AS m,
            ix || range(1, {WIDTH + 1}) AS ix, list_resize(xs, len(xs) + {WIDTH}, 0.0) AS xs,
            1 / (1 + exp(-list_dot_product(list_select(s.w, ix), xs))) - label AS r
          FROM steps s JOIN plan p USING (trial) JOIN rowz t ON t.role = 'train' AND t.pos // p.b = s.k % ((p.n + p.b - 1) // p.b)
          WHERE s.k < p.epochs * ((p.n + p.b - 1) // p.b)))
      GROUP BY trial, k, i)
    GROUP BY trial, k))""",
    """kept AS (
  SELECT s.trial, s.k // ((n + b - 1) // b) AS epoch, w FROM steps s JOIN plan USING (trial)
  WHERE k > 0 AND k % ((n + b - 1) // b) = 0)""",
    """scores AS (
  SELECT trial, epoch, id, role, label AS y_true, list_dot_product(list_select(w, ix), xs) AS z FROM kept, rowz WHERE role <> 'train')""",
    """judged AS (
  SELECT *, CASE WHEN z > 0 THEN 1 ELSE 0 END AS y_pred, ln(1 + exp(CASE y_true WHEN 1 THEN -z ELSE z END)) AS miss FROM scores)""",
    *class_metrics("(SELECT * FROM judged WHERE role = 'val')", "trial, epoch, ", "vp"),
    f"vo AS (SELECT trial, epoch, {OVERALL} FROM vp GROUP BY ALL)",
    """whole AS (
  SELECT trial, epoch, loss, accuracy, f1_macro FROM vo
  JOIN (SELECT trial, epoch, avg(miss) AS loss FROM judged WHERE role = 'val' GROUP BY ALL) USING (trial, epoch))""",
    """marked AS (
  SELECT *, f1_macro > coalesce(max(f1_macro) OVER (PARTITION BY trial ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS better
  FROM whole)""",
    "since AS (SELECT *, max(epoch) FILTER (better) OVER (PARTITION BY trial ORDER BY epoch) AS record FROM marked)",
    f"stops AS (SELECT trial, min(epoch) FILTER (epoch - record >= {PATIENCE}) AS stop_epoch, max(epoch) AS last_epoch FROM since GROUP BY trial)",
    "logged AS (SELECT w.* FROM whole w JOIN stops USING (trial) WHERE epoch <= coalesce(stop_epoch, last_epoch))",
    "tops AS (SELECT * FROM logged QUALIFY row_number() OVER (PARTITION BY trial ORDER BY f1_macro DESC, epoch) = 1)",
    "winner AS (SELECT trial, epoch FROM tops ORDER BY f1_macro DESC, trial LIMIT 1)",
]


def recursive(ctes: list[str], body: str) -> str:
    return with_(ctes, body).replace("WITH ", "WITH RECURSIVE ", 1)


ORACLE |= {
    "search_classifier": recursive(
        TRAINED,
        f"""SELECT trial, round(learning_rate, 6) AS learning_rate, b AS per_device_train_batch_size, epochs AS num_train_epochs,
  round(decay, 6) AS weight_decay, (SELECT max(epoch) FROM logged l WHERE l.trial = t.trial) AS epochs_trained,
  epoch AS best_epoch, {rounded(("loss", "accuracy", "f1_macro"))}, trial = (SELECT trial FROM winner) AS chosen
FROM trials t JOIN tops USING (trial)""",
    ),
    "training_log": recursive(TRAINED, f"SELECT trial, epoch, {rounded(('loss', 'accuracy', 'f1_macro'))} FROM logged"),
    "early_stop_trained": recursive(TRAINED, "SELECT trial, stop_epoch, last_epoch FROM stops"),
    "best_epoch_restored": recursive(
        TRAINED,
        """SELECT id, y_true AS label, trial, epoch, y_pred AS pred_id, round(z, 6) AS log_odds
FROM judged JOIN winner USING (trial, epoch) WHERE role = 'test'""",
    ),
}
