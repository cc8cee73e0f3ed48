"""DuckDB twins of the queries, written independently of the Spark expressions.

Pieces are unnested into rows and grouped here, where Spark keeps arrays; folds are
one global numbering and every fold is fitted on its own.
"""

from __future__ import annotations

# Thresholds and patterns that both sides must share, written out again
# here so that a twin does not read the code it checks.
PARAGRAPH_GE = [0, 50, 75, 100, 125, 150, 175, 200, 250, 300, 350, 400, 500, 600, 700]
PARAGRAPH_LE = [25, 49]
SENTENCE_GE = [0, 15, 50, 100, 150, 200, 250, 300]
SENTENCE_LE = [15, 50]
BOOSTING_FEATURES = ["l_linenumber", "l_quantity", "l_extendedprice"]

_STEPS = [
    (r"<[^\n]*?>", ""),
    (r"@[\p{L}\p{N}_]+", ""),
    (r"''\p{Nd}+", ""),
    (r"\p{Nd}+", ""),
    (r"http[\p{L}\p{N}_]+", ""),
    (r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]+", " "),
    (r"\.+", "."),
    (r",+", ","),
]


def _clean(column: str) -> str:
    sql = f"lower({column})"
    for pattern, replacement in _STEPS:
        sql = f"regexp_replace({sql}, '{pattern}', '{replacement}', 'g')"
    return f"trim({sql}, ' ')"


def _bare(column: str) -> str:
    return rf"regexp_replace({column}, '[!-/:-@\[-`{{-~]', '', 'g')"


ESSAYS = """essays AS (
  SELECT doc_id AS essay_id, text AS full_text,
         CAST(least(6, n_chars // 700 + 1) AS INTEGER) AS score
  FROM documents)"""

WORD_LIST = f"""word_list AS (
  SELECT DISTINCT lower(trim(w)) AS word
  FROM (SELECT unnest(string_split({_bare(_clean('text'))}, ' ')) AS w FROM benchmark)
  WHERE w <> '')"""

PARAGRAPHS = f"""raw_paragraphs AS (
  SELECT essay_id, unnest(ps) AS raw, generate_subscripts(ps, 1) - 1 AS pos
  FROM (SELECT essay_id, string_split(full_text, chr(10)) AS ps FROM essays)),
paragraphs AS (
  SELECT essay_id, CAST(pos AS INTEGER) AS pos, {_clean('raw')} AS paragraph FROM raw_paragraphs),
measured_paragraphs AS (
  SELECT essay_id, pos, paragraph, {_bare('paragraph')} AS paragraph_no_pinctuation,
         CAST(length(paragraph) AS INTEGER) AS paragraph_len,
         CAST(len(string_split(paragraph, '.')) AS INTEGER) AS paragraph_sentence_cnt,
         CAST(len(string_split(paragraph, ' ')) AS INTEGER) AS paragraph_word_cnt
  FROM paragraphs)"""

ERRORS = f"""tokens AS (
  SELECT essay_id, pos, unnest(string_split(paragraph_no_pinctuation, ' ')) AS token FROM measured_paragraphs),
bad AS (
  SELECT essay_id, pos, count(*) AS n FROM tokens
  WHERE token <> '' AND token NOT IN (SELECT word FROM word_list) GROUP BY ALL),
errors AS (
  SELECT p.essay_id, p.pos, CAST(coalesce(b.n, 0) AS INTEGER) AS paragraph_error_num
  FROM paragraphs p LEFT JOIN bad b ON p.essay_id = b.essay_id AND p.pos = b.pos),
paragraph_table AS (
  SELECT m.*, e.paragraph_error_num FROM measured_paragraphs m
  JOIN errors e ON m.essay_id = e.essay_id AND m.pos = e.pos)"""

SENTENCES = f"""cleaned AS (SELECT essay_id, {_clean('full_text')} AS cleaned FROM essays),
sentence_table AS (
  SELECT essay_id, CAST(pos AS INTEGER) AS pos, sentence,
         CAST(length(sentence) AS INTEGER) AS sentence_len,
         CAST(len(string_split(sentence, ' ')) AS INTEGER) AS sentence_word_cnt
  FROM (SELECT essay_id, unnest(ss) AS sentence, generate_subscripts(ss, 1) - 1 AS pos
        FROM (SELECT essay_id, string_split(cleaned, '.') AS ss FROM cleaned))
  WHERE length(sentence) >= 15)"""

WORDS = """word_table AS (
  SELECT essay_id, CAST(pos AS INTEGER) AS pos, word, CAST(length(word) AS INTEGER) AS word_len
  FROM (SELECT essay_id, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS pos
        FROM (SELECT essay_id, string_split(cleaned, ' ') AS ws FROM cleaned))
  WHERE word <> '')"""


def _nearest(column: str, q: float) -> str:
    return f"list_sort(list({column}))[1 + CAST(round((count(*) - 1) * {q}) AS INTEGER)]"


def _double(expression: str, name: str) -> str:
    return f"round(CAST({expression} AS DOUBLE), 6) AS {name}"


def _counts(piece: str, ge: list[int], le: list[int]) -> list[str]:
    length = f"{piece}_len"
    return [_double(f"count(*) FILTER ({length} >= {i})", f"{piece}_ge_{i}_cnt") for i in ge] + [
        _double(f"count(*) FILTER ({length} <= {i})", f"{piece}_le_{i}_cnt") for i in le
    ]


def _summaries(measures: list[str]) -> list[str]:
    columns = []
    for m in measures:
        columns += [
            _double(f"max({m})", f"{m}_max"),
            _double(f"avg({m})", f"{m}_mean"),
            _double(f"min({m})", f"{m}_min"),
            _double(f"sum({m})", f"{m}_sum"),
            _double(f"arg_min({m}, pos)", f"{m}_first"),
            _double(f"arg_max({m}, pos)", f"{m}_last"),
            _double(f"kurtosis_pop({m})", f"{m}_kurtosis"),
            _double(_nearest(m, 0.25), f"{m}_q1"),
            _double(_nearest(m, 0.75), f"{m}_q3"),
        ]
    return columns


def _grouped(table: str, columns: list[str]) -> str:
    return f"SELECT essay_id, {', '.join(columns)} FROM {table} GROUP BY essay_id"


PARAGRAPH_FEATURES = _grouped(
    "paragraph_table",
    _counts("paragraph", PARAGRAPH_GE, PARAGRAPH_LE)
    + _summaries(["paragraph_error_num", "paragraph_len", "paragraph_sentence_cnt", "paragraph_word_cnt"]),
)
SENTENCE_FEATURES = _grouped(
    "sentence_table", _counts("sentence", SENTENCE_GE, SENTENCE_LE) + _summaries(["sentence_len", "sentence_word_cnt"])
)
WORD_FEATURES = _grouped(
    "word_table",
    [_double(f"count(*) FILTER (word_len >= {i})", f"word_{i}_cnt") for i in range(1, 16)]
    + [
        _double("max(word_len)", "word_len_max"),
        _double("avg(word_len)", "word_len_mean"),
        _double("stddev_samp(word_len)", "word_len_std"),
        _double(_nearest("word_len", 0.25), "word_len_q1"),
        _double(_nearest("word_len", 0.5), "word_len_q2"),
        _double(_nearest("word_len", 0.75), "word_len_q3"),
    ],
)

FOLDS = """folds AS (
  SELECT essay_id, score,
         CAST((row_number() OVER (ORDER BY score, md5('2018:' || essay_id), essay_id) - 1) % 5 AS INTEGER) AS fold
  FROM essays)"""


def _runs(low: int, high: int, prefix: str) -> str:
    """Character runs by neighbouring rows, and their counts per essay."""
    leads = ", ".join(f"lead(c, {i}) OVER w AS c{i}" for i in range(1, high))
    sizes = " UNION ALL ".join(
        f"SELECT essay_id, c || {' || '.join(f'c{i}' for i in range(1, n))} AS term FROM {prefix}_rows"
        f" WHERE c{n - 1} IS NOT NULL"
        for n in range(low, high + 1)
    )
    return f"""{prefix}_chars AS (
  SELECT essay_id, unnest(cs) AS c, generate_subscripts(cs, 1) AS i
  FROM (SELECT essay_id, regexp_extract_all(full_text, '(?s).') AS cs FROM essays)),
{prefix}_rows AS (SELECT essay_id, c, {leads} FROM {prefix}_chars WINDOW w AS (PARTITION BY essay_id ORDER BY i)),
{prefix}_tf AS (SELECT essay_id, term, count(*) AS tf FROM ({sizes}) GROUP BY ALL)"""


def _vocabulary(prefix: str, min_df: float, max_df: float, by_fold: bool) -> str:
    """One direct fit per fold over its training essays, or one over all essays."""
    if by_fold:
        sides = f"""{prefix}_sides AS (
  SELECT f.fold, e.essay_id FROM (SELECT DISTINCT fold FROM folds) f JOIN folds e ON e.fold <> f.fold)"""
    else:
        sides = f"{prefix}_sides AS (SELECT CAST(-1 AS INTEGER) AS fold, essay_id FROM essays)"
    return f"""{sides},
{prefix}_n AS (SELECT fold, count(*) AS n_docs FROM {prefix}_sides GROUP BY fold),
{prefix}_df AS (
  SELECT s.fold, t.term, count(*) AS df FROM {prefix}_tf t JOIN {prefix}_sides s ON s.essay_id = t.essay_id
  GROUP BY ALL),
{prefix}_vocab AS (
  SELECT d.fold, d.term, d.df, n.n_docs,
         CAST(row_number() OVER (PARTITION BY d.fold ORDER BY d.term) - 1 AS INTEGER) AS term_idx,
         ln((1.0::DOUBLE + n.n_docs) / (1.0::DOUBLE + d.df)) + 1.0::DOUBLE AS idf
  FROM {prefix}_df d JOIN {prefix}_n n ON n.fold = d.fold
  WHERE d.df >= {min_df}::DOUBLE * n.n_docs AND d.df <= {max_df}::DOUBLE * n.n_docs)"""


def _cells(prefix: str, vectorizer: str, weighted: bool) -> str:
    """Value of every (fold, essay, term), unit length per fold and essay if weighted."""
    if not weighted:
        return f"""{prefix}_cells AS (
  SELECT v.fold, t.essay_id, '{vectorizer}' AS vectorizer, v.term_idx, CAST(t.tf AS DOUBLE) AS value
  FROM {prefix}_tf t JOIN {prefix}_vocab v ON v.term = t.term)"""
    return f"""{prefix}_weights AS (
  SELECT v.fold, t.essay_id, v.term_idx, (1 + ln(t.tf)) * v.idf AS w
  FROM {prefix}_tf t JOIN {prefix}_vocab v ON v.term = t.term),
{prefix}_norms AS (SELECT fold, essay_id, sqrt(sum(w * w)) AS norm FROM {prefix}_weights GROUP BY ALL),
{prefix}_cells AS (
  SELECT w.fold, w.essay_id, '{vectorizer}' AS vectorizer, w.term_idx, w.w / n.norm AS value
  FROM {prefix}_weights w JOIN {prefix}_norms n ON n.fold = w.fold AND n.essay_id = w.essay_id)"""


DIGEST = """count(*) AS n_terms, CAST(sum(term_idx) AS BIGINT) AS idx_sum, round(sum(value), 6) AS value_sum,
  round(sum(value * term_idx), 3) AS idx_value_sum, round(max(value), 6) AS value_max"""

TFIDF_RUNS, COUNT_RUNS = _runs(3, 6, "t"), _runs(2, 3, "c")
CELL_COLUMNS = "c.fold, c.essay_id, c.vectorizer, c.term_idx, c.value"

_LINE_ID = "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS INTEGER)) AS essay_id"
PAIRS = f"""pairs AS (
  SELECT {_LINE_ID}, CAST(l_orderkey % 5 AS INTEGER) AS fold, least(6, l_linenumber) AS y,
         1 + l_quantity / 9 AS raw,
         CAST(round_even(least(6.0, greatest(1.0, 1 + l_quantity / 9)), 0) AS INTEGER) AS p
  FROM lineitem)"""


def _kappa(source: str, group: str | None) -> str:
    """Kappa from the full weight matrix over label ranks."""
    key, on, by = (f"{group}, ", f"AND a.{group} = b.{group}", f"GROUP BY {group}") if group else ("", "", "")
    part = f"PARTITION BY {group}" if group else ""
    labels = f"""SELECT {key}label, row_number() OVER ({part} ORDER BY label) AS i
      FROM (SELECT {key}y AS label FROM {source} UNION SELECT {key}p AS label FROM {source})"""

    def same(a: str, b: str) -> str:
        return f" AND {a}.{group} = {b}.{group}" if group else ""

    outer = f"t.{group}, " if group else ""
    return f"""SELECT {outer}1 - any_value(t.o) / sum((r.i - c.i) * (r.i - c.i) * r.n * c.n / t.n) AS qwk
  FROM (SELECT {('s.' + group + ', ') if group else ''}count(*)::DOUBLE AS n,
               sum((a.i - b.i) * (a.i - b.i))::DOUBLE AS o
        FROM {source} s JOIN ({labels}) a ON a.label = s.y{same('a', 's')}
        JOIN ({labels}) b ON b.label = s.p{same('b', 's')} {('GROUP BY s.' + group) if group else ''}) t
  JOIN (SELECT {('l.' + group + ', ') if group else ''}l.i, count(*)::DOUBLE AS n FROM {source} s
        JOIN ({labels}) l ON l.label = s.y{same('l', 's')} GROUP BY ALL) r ON {f't.{group} = r.{group}' if group else 'true'}
  JOIN (SELECT {('l.' + group + ', ') if group else ''}l.i, count(*)::DOUBLE AS n FROM {source} s
        JOIN ({labels}) l ON l.label = s.p{same('l', 's')} GROUP BY ALL) c ON {f't.{group} = c.{group}' if group else 'true'}
  {f'GROUP BY t.{group}' if group else ''}"""


def _f1(source: str, group: str | None) -> str:
    key = f"{group}, " if group else ""
    join = f"AND a.{group} = b.{group}" if group else ""
    by = f"GROUP BY {group}" if group else ""
    return f"""SELECT {key}sum(f1 * support) / sum(support) AS f1 FROM (
  SELECT {('a.' + group + ', ') if group else ''}a.support,
         CASE WHEN a.hits = 0 THEN 0 ELSE 2 * (a.hits / b.n) * (a.hits / a.support)
              / (a.hits / b.n + a.hits / a.support) END AS f1
  FROM (SELECT {key}y AS label, count(*)::DOUBLE AS support, sum(CAST(y = p AS INTEGER))::DOUBLE AS hits
        FROM {source} GROUP BY ALL) a
  LEFT JOIN (SELECT {key}p AS label, count(*)::DOUBLE AS n FROM {source} GROUP BY ALL) b
    ON a.label = b.label {join}) {by}"""


def _logits(n_models: int) -> str:
    return f"""logits AS (
  SELECT vec_id AS essay_id, m AS model, [CAST(x AS DOUBLE) FOR x IN embedding[m * 6 + 1:m * 6 + 6]] AS logits
  FROM embeddings, range(0, {n_models}) r(m)),
probs AS (
  SELECT essay_id, model, CAST(class AS INTEGER) AS class,
         exp(x - list_max(logits)) / list_sum([exp(v - list_max(logits)) FOR v IN logits]) AS prob
  FROM (SELECT essay_id, model, logits, unnest(logits) AS x, generate_subscripts(logits, 1) - 1 AS class FROM logits)),
mean_probs AS (SELECT essay_id, class, avg(prob) AS prob FROM probs GROUP BY ALL)"""


FOLD_PREDICTIONS = f"""predictions AS (
  SELECT {_LINE_ID}, fold, l_quantity / 9 - 2 + (fold - 2) * l_discount AS y_pred
  FROM lineitem, range(0, 5) r(fold))"""


def _with(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


# One round of one split. At the start every prediction is the centre, so the gradient
# of a row is its distance from it by half the variance.
def _boosting_rows(features: list[str]) -> str:
    """Rows, class weights, fixed-point gradients of the first round, bin edges and codes."""
    long = " UNION ALL ".join(f"SELECT essay_id, {i} AS f, {c}::DOUBLE AS v FROM rows" for i, c in enumerate(features))
    return f"""rows AS (
  SELECT {_LINE_ID}, {", ".join(features)}, least(6, greatest(1, round_even(l_quantity / 9, 0)))::INTEGER AS score FROM lineitem),
n AS (SELECT count(*) AS n FROM rows),
weights AS (
  SELECT score, (SELECT n FROM n) / ((SELECT count(DISTINCT score) FROM rows) * count(*)) AS w
  FROM rows GROUP BY score),
data AS (
  SELECT essay_id, round((2.998::DOUBLE - score) / (0.5::DOUBLE * 1.092 * n) * n * w * 16777216)::BIGINT AS g,
         round(w * 16777216)::BIGINT AS w FROM rows JOIN weights USING (score), n),
long AS ({long}),
sketch AS (
  SELECT f, CASE WHEN v < 0 THEN -1 ELSE 1 END * ((abs(v)::BIT)::BIGINT >> 40) AS bucket, count(*) AS n, min(v) AS least, max(v) AS most
  FROM long GROUP BY ALL),
steps AS (
  SELECT f, bucket, count(*) OVER (PARTITION BY f) AS buckets, (most + lead(least) OVER o) / 2 AS upper,
    sum(n) OVER o * 128 // (SELECT n FROM n) > (sum(n) OVER o - n) * 128 // (SELECT n FROM n) AS quantile,
    lead(n) OVER o * 128 >= (SELECT n FROM n) AS before_large
  FROM sketch WINDOW o AS (PARTITION BY f ORDER BY bucket)),
edges AS (
  SELECT f, row_number() OVER (PARTITION BY f ORDER BY bucket) - 1 AS bin, upper
  FROM steps WHERE upper IS NOT NULL AND (buckets <= 256 OR quantile OR before_large)),
cuts AS (SELECT f, count(*) AS cuts FROM edges GROUP BY f),
coded_values AS (
  SELECT x.f, x.v, count(e.upper) AS bin FROM (SELECT DISTINCT f, v FROM long) x LEFT JOIN edges e ON e.f = x.f AND e.upper < x.v GROUP BY ALL),
coded AS (SELECT essay_id, f, bin FROM long JOIN coded_values USING (f, v))"""


def _boosting_round(features: list[str], rate: float, depth: int, l1: float, l2: float, leaves: int, least: int = 1, seed: int | None = None) -> str:
    """Predictions after one round: the best leaf is opened, ``leaves`` - 1 times, from summed histograms.

    With a ``seed``, each leaf looks at one threshold of a feature, drawn by seed, round, leaf and feature.
    """

    def share(g: str, w: str) -> str:
        over = f"greatest(abs(({g}) / 16777216::DOUBLE) - {l1}::DOUBLE, 0)"
        return f"{over} * {over} / (({w}) / 16777216::DOUBLE + {l2}::DOUBLE)"

    ctes = [_boosting_rows(features), "leaf0 AS (SELECT essay_id, 1 AS leaf FROM rows)"]
    drawn = "" if seed is None else (
        f"""SELECT * REPLACE (drawn AS bin) FROM (
      SELECT *, ('0x' || substr(md5('{seed}:1:' || leaf || ':' || f), 1, 8))::BIGINT % cuts AS drawn FROM sums{{i}} JOIN cuts USING (f))
    WHERE bin <= drawn AND (next IS NULL OR next > drawn)"""
    )
    for i in range(1, leaves):
        source = f"({drawn.format(i=i)})" if drawn else f"sums{i}"
        ctes += [
            f"""sums{i} AS (
  SELECT leaf, f, bin, lead(bin) OVER o AS next, sum(g) OVER o AS lg, sum(w) OVER o AS lw, sum(n) OVER o AS ln,
         sum(g) OVER a AS tg, sum(w) OVER a AS tw, sum(n) OVER a AS tn
  FROM (SELECT leaf, f, bin, sum(g) AS g, sum(w) AS w, count(*) AS n
        FROM leaf{i - 1} JOIN coded USING (essay_id) JOIN data USING (essay_id) WHERE leaf < {2 ** depth} GROUP BY ALL)
  WINDOW o AS (PARTITION BY leaf, f ORDER BY bin), a AS (PARTITION BY leaf, f))""",
            f"""best{i} AS (
  SELECT leaf, f, bin, {share("lg", "lw")} + {share("tg - lg", "tw - lw")} - {share("tg", "tw")} AS gain
  FROM {source} WHERE ln >= {least} AND tn - ln >= {least} ORDER BY gain DESC, leaf, f, bin LIMIT 1)""",
            f"""leaf{i} AS (
  SELECT l.essay_id, CASE WHEN b.leaf IS NULL THEN l.leaf ELSE 2 * l.leaf + (c.bin > b.bin)::INTEGER END AS leaf
  FROM leaf{i - 1} l LEFT JOIN (SELECT * FROM best{i} WHERE gain > 1e-7) b ON b.leaf = l.leaf
  LEFT JOIN coded c ON c.essay_id = l.essay_id AND c.f = b.f)""",
        ]
    g, w = "sum(g) / 16777216::DOUBLE", "sum(w) / 16777216::DOUBLE"
    ctes.append(
        f"""value AS (
  SELECT leaf, -{rate}::DOUBLE * sign({g}) * greatest(abs({g}) - {l1}, 0) / ({w} + {l2}::DOUBLE) AS value
  FROM leaf{leaves - 1} JOIN data USING (essay_id) GROUP BY leaf)"""
    )
    return _with(*ctes) + f"SELECT essay_id, round(value, 6) AS pred FROM leaf{leaves - 1} JOIN value USING (leaf)"


def all_queries() -> dict[str, str]:
    text_ctes = (ESSAYS, WORD_LIST, PARAGRAPHS, ERRORS)
    tfidf_folds = (ESSAYS, FOLDS, TFIDF_RUNS, _vocabulary("t", 0.05, 0.95, True))
    count_folds = (ESSAYS, FOLDS, COUNT_RUNS, _vocabulary("c", 0.10, 0.85, True))
    vocabulary = (
        "SELECT fold, '{name}' AS vectorizer, term, term_idx, df, n_docs, round(idf, 6) AS idf FROM {p}_vocab"
    )
    top = "row_number() OVER (ORDER BY importance DESC, feature)"
    return {
        "essay_scan": _with(ESSAYS)
        + "SELECT essay_id, full_text, CAST(len(string_split(full_text, chr(10))) AS INTEGER) AS paragraph_cnt FROM essays",
        "vocab_scan": _with(WORD_LIST) + "SELECT word FROM word_list",
        "clean_text": _with(ESSAYS) + f"SELECT essay_id, {_clean('full_text')} AS cleaned FROM essays",
        "clean_pages": f"SELECT page_id, {_clean('html')} AS cleaned FROM pages",
        "strip_html": r"SELECT page_id, regexp_replace(html, '<[^\n]*?>', '', 'g') AS stripped FROM pages",
        "strip_punct": _with(ESSAYS) + f"SELECT essay_id, {_bare('full_text')} AS bare FROM essays",
        "paragraph_rows": _with(*text_ctes) + "SELECT * FROM paragraph_table",
        "sentence_rows": _with(ESSAYS, SENTENCES) + "SELECT * FROM sentence_table",
        "word_rows": _with(ESSAYS, SENTENCES, WORDS) + "SELECT * FROM word_table",
        "spelling_errors": _with(*text_ctes) + "SELECT * FROM errors",
        "paragraph_features": _with(*text_ctes) + PARAGRAPH_FEATURES,
        "sentence_features": _with(ESSAYS, SENTENCES) + SENTENCE_FEATURES,
        "word_features": _with(ESSAYS, SENTENCES, WORDS) + WORD_FEATURES,
        "essay_features": _with(*text_ctes, SENTENCES, WORDS)
        + f"""SELECT e.score, p.*, s.* EXCLUDE (essay_id), w.* EXCLUDE (essay_id)
FROM essays e JOIN ({PARAGRAPH_FEATURES}) p ON p.essay_id = e.essay_id
LEFT JOIN ({SENTENCE_FEATURES}) s ON s.essay_id = e.essay_id
LEFT JOIN ({WORD_FEATURES}) w ON w.essay_id = e.essay_id""",
        "mart_profile": "SELECT count(*) AS row_count, CAST(2 + 53 + 28 + 21 AS BIGINT) AS column_count,"
        " 'Unnamed: 0' AS missing_columns FROM documents",
        "target_summary": _with(ESSAYS)
        + "SELECT round(avg(score), 6) AS mean_score, round(var_samp(score), 6) AS var_score FROM essays",
        "class_weights": _with(ESSAYS)
        + """SELECT score, count(*) AS n,
       round((SELECT count(*) FROM essays) / ((SELECT count(DISTINCT score) FROM essays) * count(*)), 6) AS class_weight
FROM essays GROUP BY score""",
        "prepared_target": _with(ESSAYS)
        + "SELECT essay_id, round(CAST(score AS DOUBLE) - 2.998::DOUBLE, 6) AS y, score AS y_int FROM essays",
        "stratified_folds": _with(ESSAYS, FOLDS) + "SELECT essay_id, score, fold FROM folds",
        "holdout_split": _with(ESSAYS)
        + """SELECT essay_id, score,
       row_number() OVER (ORDER BY md5('42:' || essay_id), essay_id)
         <= ceil(0.4::DOUBLE * (SELECT count(*) FROM essays)) AS held_out FROM essays""",
        "sample_n": _with(ESSAYS)
        + "SELECT essay_id, score FROM essays ORDER BY md5('2018:' || essay_id), essay_id LIMIT 100",
        "tfidf_vocab": _with(*tfidf_folds) + vocabulary.format(name="tfid", p="t"),
        "count_vocab": _with(*count_folds) + vocabulary.format(name="tfid_cnt", p="c"),
        "tfidf_features": _with(ESSAYS, TFIDF_RUNS, _vocabulary("t", 0.05, 0.95, False), _cells("t", "tfid", True))
        + f"SELECT fold, essay_id, vectorizer, {DIGEST} FROM t_cells GROUP BY ALL",
        "count_features": _with(ESSAYS, COUNT_RUNS, _vocabulary("c", 0.10, 0.85, False), _cells("c", "tfid_cnt", False))
        + "SELECT * FROM c_cells",
        "tfidf_transform_valid": _with(*tfidf_folds, _cells("t", "tfid", True))
        + f"""SELECT fold, essay_id, vectorizer, {DIGEST}
FROM (SELECT {CELL_COLUMNS} FROM t_cells c JOIN folds f ON f.essay_id = c.essay_id AND f.fold = c.fold) GROUP BY ALL""",
        "count_transform_valid": _with(*count_folds, _cells("c", "tfid_cnt", False))
        + f"SELECT {CELL_COLUMNS} FROM c_cells c JOIN folds f ON f.essay_id = c.essay_id AND f.fold = c.fold",
        "meta_features": _with(
            *tfidf_folds,
            _cells("t", "tfid", True),
            COUNT_RUNS,
            _vocabulary("c", 0.10, 0.85, True),
            _cells("c", "tfid_cnt", False),
        )
        + f"""SELECT fold, essay_id, vectorizer, held_out, {DIGEST}
FROM (SELECT {CELL_COLUMNS}, f.fold = c.fold AS held_out
      FROM (SELECT * FROM t_cells UNION ALL SELECT * FROM c_cells) c JOIN folds f ON f.essay_id = c.essay_id)
GROUP BY ALL""",
        "confusion_matrix": _with(PAIRS) + "SELECT y, p, count(*) AS n FROM pairs GROUP BY ALL",
        "qwk": _with(PAIRS) + f"SELECT round(qwk, 6) AS qwk FROM ({_kappa('pairs', None)})",
        "bin_edges": _with(_boosting_rows(BOOSTING_FEATURES)) + "SELECT f::INTEGER AS feature, bin::INTEGER AS bin, round(upper, 6) AS upper FROM edges",
        "boosting_step": _boosting_round(BOOSTING_FEATURES, 0.5, 3, 2.0, 0.1, 8),
        "leafwise_step": _boosting_round(BOOSTING_FEATURES, 0.5, 5, 2.0, 0.1, 3),
        "random_step": _boosting_round(BOOSTING_FEATURES, 0.5, 5, 2.0, 0.1, 10, 20, 42),
        "forest_scores": f"""SELECT {_LINE_ID}, round(2.998
  + 0.76 * (CASE WHEN l_quantity <= 20 THEN -0.5 WHEN l_linenumber <= 3 THEN 0.25 ELSE 0.75 END
            + CASE WHEN l_extendedprice <= 30000 THEN 0.125 ELSE -0.25 END)
  + 0.24 * CASE WHEN l_quantity <= 35.5 THEN -1.0 ELSE 1.5 END, 6)::DOUBLE AS y_pred FROM lineitem""",
        "split_importance": """SELECT 0 AS fold, feature, position, splits::DOUBLE AS importance, rows::BIGINT AS rows FROM (
  SELECT 'l_linenumber' AS feature, 0 AS position, 1 AS splits, count(*) FILTER (l_quantity > 20) AS rows FROM lineitem
  UNION ALL SELECT 'l_quantity', 1, 2, 2 * count(*) FROM lineitem
  UNION ALL SELECT 'l_extendedprice', 2, 1, count(*) FROM lineitem)""",
        "best_round": f"""WITH steps AS (SELECT unnest(range(1, 7)) AS round),
pairs AS (
  SELECT s.round AS fold, least(6, greatest(1, round_even(l_quantity / 9, 0)))::INTEGER AS y,
         least(6, greatest(1, round_even(l_quantity / 9 + (s.round - 3) * (s.round - 3) * (l_orderkey % 3) / 3, 0)))::INTEGER AS p
  FROM lineitem, steps s),
k AS ({_kappa('pairs', 'fold')})
SELECT fold::INTEGER AS round, round(qwk, 6) AS qwk,
  fold = (SELECT fold FROM k ORDER BY qwk DESC, fold LIMIT 1) AS best FROM k""",
        "qwk_moment": _with(PAIRS)
        + """SELECT round(1 - avg((y - p) * (y - p)) / (var_pop(y) + var_pop(p) + (avg(y) - avg(p)) * (avg(y) - avg(p))), 6)
  AS qwk FROM pairs""",
        "weighted_f1": _with(PAIRS) + f"SELECT round(f1, 6) AS f1 FROM ({_f1('pairs', None)})",
        "fold_report": _with(PAIRS, f"k AS ({_kappa('pairs', 'fold')})", f"f AS ({_f1('pairs', 'fold')})")
        + f"""SELECT 'fold' AS scope, k.fold, round(f.f1, 6) AS f1, round(k.qwk, 6) AS qwk FROM k JOIN f ON f.fold = k.fold
UNION ALL SELECT 'mean', -1, (SELECT round(avg(f1), 6) FROM f), (SELECT round(avg(qwk), 6) FROM k)
UNION ALL SELECT 'pooled', -1, (SELECT round(f1, 6) FROM ({_f1('pairs', None)})),
  (SELECT round(qwk, 6) FROM ({_kappa('pairs', None)}))""",
        "oof_union": _with(PAIRS) + "SELECT fold, y, p, count(*) AS n FROM pairs GROUP BY ALL",
        "clip_round": _with(PAIRS) + "SELECT essay_id, p AS score FROM pairs",
        "qwk_gradient": _with(
            f"pairs AS (SELECT {_LINE_ID}, CAST(least(6, l_linenumber) AS DOUBLE) AS y, l_quantity / 7 AS p FROM lineitem)",
            "clipped AS (SELECT *, least(6.0::DOUBLE, greatest(1.0::DOUBLE, p)) AS c FROM pairs)",
            """sums AS (SELECT sum((c - y) ** 2) / 2 AS f, sum((c - 2.998::DOUBLE) ** 2 + 1.092::DOUBLE) / 2 AS g,
  count(*)::DOUBLE AS n FROM clipped)""",
        )
        + """SELECT essay_id, y, round(p, 6) AS p,
       round(((c - y) / g - f * (c - 2.998::DOUBLE) / (g * g)) * n, 6) AS grad, 1.0::DOUBLE AS hess
FROM clipped, sums""",
        "softmax_probs": _with(_logits(10)) + "SELECT essay_id, model::INTEGER AS model, class, round(prob, 6) AS prob FROM probs",
        "prob_ensemble": _with(_logits(10)) + "SELECT essay_id, class, round(prob, 6) AS prob FROM mean_probs",
        "attach_probs": _with(ESSAYS, _logits(10))
        + "SELECT e.essay_id, e.score, "
        + ", ".join(f"round(max(m.prob) FILTER (m.class = {i}), 6) AS prob_{i}" for i in range(6))
        + " FROM essays e LEFT JOIN mean_probs m ON m.essay_id = e.essay_id GROUP BY e.essay_id, e.score",
        "blend": f"""SELECT {_LINE_ID},
  round(0.76::DOUBLE * (l_quantity / 9) + 0.24::DOUBLE * l_linenumber, 6) AS y_pred FROM lineitem""",
        "fold_ensemble": _with(FOLD_PREDICTIONS)
        + "SELECT essay_id, round(avg(y_pred), 6) AS y_pred FROM predictions GROUP BY essay_id",
        "submission": _with(FOLD_PREDICTIONS)
        + """SELECT essay_id,
  CAST(round_even(least(6.0::DOUBLE, greatest(1.0::DOUBLE, avg(y_pred + 2.998::DOUBLE))), 0) AS INTEGER) AS score
FROM predictions GROUP BY essay_id""",
        "feature_topk": _with(ESSAYS, SENTENCES, WORDS)
        + f"""SELECT feature, importance, CAST({top} AS INTEGER) AS rank
FROM (SELECT word AS feature, count(*)::DOUBLE AS importance FROM word_table GROUP BY ALL)
ORDER BY rank LIMIT 1000""",
        "feature_topk_cv": _with(ESSAYS, FOLDS, SENTENCES, WORDS)
        + f"""SELECT feature, importance, CAST({top} AS INTEGER) AS rank
FROM (SELECT feature, sum(letters)::DOUBLE AS importance
      FROM (SELECT f.fold, w.word AS feature, sum(w.word_len) AS letters
            FROM word_table w JOIN folds f ON f.essay_id = w.essay_id GROUP BY ALL) GROUP BY ALL)
ORDER BY rank LIMIT 1000""",
    }
