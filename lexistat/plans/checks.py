"""The same results as SQL that DuckDB runs on the same tables; each is written from the definition
of its operator, with plain windows and joins where the Spark side splits and pre-aggregates."""

from __future__ import annotations

from lexistat.functions.text import ACCENTED, PLAIN
from lexistat.operators.inference import METHODS
from lexistat.operators.summary import LATEX_ESCAPES, METRIC_GROUPS
from lexistat.plans.inputs import STOP_WORDS

CHECKS: dict[str, str] = {}

WORD = r"[\p{L}\p{M}\p{N}]+(?:[''’][\p{L}]+)*"
SEEN = r"[^\s\p{Z}]"
STOP = "[" + ", ".join(f"'{w}'" for w in STOP_WORDS) + "]"


def with_ctes(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


DOCS = f"""texts AS (SELECT lang AS source_column, doc_id AS "index", text FROM documents
  WHERE text IS NOT NULL AND regexp_matches(text, '{SEEN}'))"""
CONVERSATIONS = f"""said AS (SELECT conv_id, role, string_agg(text, ' ' ORDER BY turn) AS text FROM conversations
  GROUP BY conv_id, role),
texts AS (SELECT role AS source_column, conv_id AS "index", text FROM said
  WHERE role IN ('user', 'assistant', 'system') AND text IS NOT NULL AND regexp_matches(text, '{SEEN}'))"""


def words_cte(stop: bool = False) -> str:
    test = f"regexp_matches(t, '^\\p{{L}}+$')"
    if stop:
        test += f" AND NOT list_contains({STOP}, lower(t))"
    return f"""worded AS (SELECT *, list_filter(regexp_extract_all(text, '{WORD}'), lambda t: {test}) AS words
  FROM texts)"""


SENTENCES = (
    "list_filter(string_split(regexp_replace(text, '([.!?]+[\"'')\\]]*)(\\s+|$)', '\\1' || chr(1), 'g'), chr(1)), "
    f"lambda s: regexp_matches(s, '{SEEN}'))"
)
STATS = f"""counted AS (SELECT source_column, "index", length(text) AS char_count, len(words) AS word_count,
  len({SENTENCES}) AS sentence_count,
  list_sum(list_transform(words, lambda w: length(w))) AS word_chars,
  len(list_distinct(list_transform(words, lambda w: lower(w)))) AS unique_words FROM worded),
stats AS (SELECT source_column, "index", char_count, word_count, sentence_count,
  CASE WHEN word_count = 0 THEN 0.0 ELSE word_chars::DOUBLE / word_count END AS avg_word_length,
  CASE WHEN sentence_count = 0 THEN 0.0 ELSE word_count::DOUBLE / sentence_count END AS avg_sentence_length,
  unique_words,
  CASE WHEN word_count = 0 THEN 0.0 ELSE unique_words::DOUBLE / word_count END AS lexical_diversity,
  0::BIGINT AS noun_count, 0::BIGINT AS verb_count, 0::BIGINT AS adjective_count, 0::BIGINT AS adverb_count
  FROM counted)"""
ROWS = f"{DOCS},\n{words_cte()},\n{STATS}"
STATS_COLUMNS = """source_column, "index", char_count, word_count, sentence_count,
  round(avg_word_length, 6) AS avg_word_length, round(avg_sentence_length, 6) AS avg_sentence_length,
  unique_words, round(lexical_diversity, 6) AS lexical_diversity,
  noun_count, verb_count, adjective_count, adverb_count"""
LEXICON = f"""entries AS (SELECT token, regexp_replace(token, '(s|en|ing)$', '') AS lemma,
  CASE WHEN regexp_matches(token, '(th|er)$') THEN 'NOUN' WHEN regexp_matches(token, '(sh|ed)$') THEN 'VERB'
    WHEN regexp_matches(token, '(en|ble)$') THEN 'ADJ' WHEN regexp_matches(token, 'ly$') THEN 'ADV'
    WHEN regexp_matches(token, 's$') THEN 'PROPN' WHEN length(token) <= 3 THEN 'AUX' ELSE 'X' END AS pos,
  length(token) <= 2 AS is_stop
  FROM (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '{WORD}')) AS token FROM benchmark)),
lexicon AS (SELECT * FROM entries WHERE lemma <> '')"""
MARKED = f"""{CONVERSATIONS},
{LEXICON},
tokens AS (SELECT source_column, "index", unnest(found) AS token, generate_subscripts(found, 1) - 1 AS pos
  FROM (SELECT *, regexp_extract_all(text, '{WORD}') AS found FROM texts)),
marked AS (SELECT t.source_column, t."index", t.pos, t.token, lower(coalesce(l.lemma, t.token)) AS lemma,
  coalesce(l.pos, '') AS tag, coalesce(l.is_stop, false) AS is_stop
  FROM tokens t LEFT JOIN lexicon l ON lower(t.token) = l.token),
alpha AS (SELECT * FROM marked WHERE regexp_matches(token, '^\\p{{L}}+$'))"""
TAGGED = f"""{MARKED},
sums AS (SELECT source_column, "index", count(*) AS word_count, sum(length(token)) AS word_chars,
  count(DISTINCT lemma) AS unique_words,
  count(*) FILTER (tag IN ('NOUN', 'PROPN')) AS noun_count, count(*) FILTER (tag IN ('VERB', 'AUX')) AS verb_count,
  count(*) FILTER (tag = 'ADJ') AS adjective_count, count(*) FILTER (tag = 'ADV') AS adverb_count
  FROM alpha GROUP BY ALL),
parts AS (SELECT source_column, "index", length(text) AS char_count, len({SENTENCES}) AS sentence_count FROM texts),
stats AS (SELECT p.source_column, p."index", char_count, coalesce(word_count, 0) AS word_count, sentence_count,
  CASE WHEN coalesce(word_count, 0) = 0 THEN 0.0 ELSE word_chars::DOUBLE / word_count END AS avg_word_length,
  CASE WHEN sentence_count = 0 THEN 0.0 ELSE coalesce(word_count, 0)::DOUBLE / sentence_count END AS avg_sentence_length,
  coalesce(unique_words, 0) AS unique_words,
  CASE WHEN coalesce(word_count, 0) = 0 THEN 0.0 ELSE unique_words::DOUBLE / word_count END AS lexical_diversity,
  coalesce(noun_count, 0) AS noun_count, coalesce(verb_count, 0) AS verb_count,
  coalesce(adjective_count, 0) AS adjective_count, coalesce(adverb_count, 0) AS adverb_count
  FROM parts p LEFT JOIN sums s ON p.source_column = s.source_column AND p."index" = s."index")"""
CORPORA = "both_corpora AS (SELECT source_column AS corpus, * FROM stats UNION ALL SELECT 'Combined', * FROM stats)"
VOCABULARY = """forms AS (SELECT DISTINCT source_column, lower(unnest(words)) AS form FROM worded),
vocabulary AS (SELECT corpus, count(DISTINCT form) AS total_unique_words FROM (
  SELECT source_column AS corpus, form FROM forms UNION ALL SELECT 'Combined', form FROM forms) GROUP BY corpus)"""
OVERALL = f"""{ROWS},
{CORPORA},
{VOCABULARY},
overall AS (SELECT b.corpus, count(*) AS n_texts, sum(char_count)::BIGINT AS total_chars,
  sum(word_count)::BIGINT AS total_words, sum(sentence_count)::BIGINT AS total_sentences,
  sum(noun_count)::BIGINT AS nouns, sum(verb_count)::BIGINT AS verbs, sum(adjective_count)::BIGINT AS adjectives,
  sum(adverb_count)::BIGINT AS adverbs, avg(avg_word_length) AS avg_word_length,
  avg(avg_sentence_length) AS avg_sentence_length, sum(word_count)::DOUBLE / sum(sentence_count) AS ratio_length,
  any_value(coalesce(v.total_unique_words, 0)) AS total_unique_words,
  any_value(coalesce(v.total_unique_words, 0)) / sum(word_count)::DOUBLE AS lexical_diversity
  FROM both_corpora b LEFT JOIN vocabulary v USING (corpus) GROUP BY b.corpus)"""


def overall_select(sentence: str = "avg_sentence_length", where: str = "") -> str:
    return with_ctes(OVERALL) + f"""SELECT corpus, n_texts, total_chars, total_words, total_sentences, nouns, verbs,
  adjectives, adverbs, round(avg_word_length, 6) AS avg_word_length, round({sentence}, 6) AS avg_sentence_length,
  total_unique_words, round(lexical_diversity, 6) AS lexical_diversity FROM overall {where}"""


# ---- tables ----------------------------------------------------------------------------------
CHECKS["preview"] = "SELECT doc_id, lang, source, n_chars FROM documents ORDER BY doc_id LIMIT 5"
CHECKS["dataset_overview"] = with_ctes(CONVERSATIONS) + """
SELECT (SELECT count(DISTINCT conv_id) FROM conversations) AS total_rows, r.role AS text_column,
  count(t.text) AS usable_rows
FROM (VALUES ('user'), ('assistant'), ('system')) r(role) LEFT JOIN texts t ON t.source_column = r.role GROUP BY r.role"""
CHECKS["candidate_text_columns"] = "UNION ALL".join(
    f"""
SELECT '{c}' AS "column", {str(c == 'text').lower()} AS is_default,
  count(*) FILTER ({c} IS NOT NULL AND regexp_matches({c}, '{SEEN}')) AS usable_rows FROM documents
""" for c in ("text", "lang", "source"))
CHECKS["embeddings_wide"] = "SELECT vec_id, label, " + ", ".join(
    f"round(embedding[{i}]::DOUBLE, 6) AS e{i}" for i in range(1, 65)) + " FROM embeddings"

# ---- stacking and joining --------------------------------------------------------------------
CHECKS["stack_text"] = with_ctes(CONVERSATIONS) + 'SELECT source_column, "index", text FROM texts'
CHECKS["align_features_targets"] = """
SELECT l.doc_id, l.quality, d.source, round(e.embedding[1]::DOUBLE, 6) AS first
FROM labels l JOIN documents d USING (doc_id) JOIN embeddings e ON e.vec_id = l.doc_id
WHERE d.source <> 'src3' AND l.quality IS NOT NULL"""
CHECKS["attach_stat"] = """
SELECT event_type AS source_column, user_id AS "index", round(avg(value), 6) AS mean_value
FROM events GROUP BY ALL HAVING count(value) > 0"""
CHECKS["attach_column"] = """
SELECT user_id AS "index", first(event_type ORDER BY event_id) FILTER (event_type IS NOT NULL) AS event_type
FROM events GROUP BY user_id"""
CHECKS["resolve_color_mode"] = """
WITH d AS (SELECT doc_id, lang, CASE WHEN doc_id % 3 = 0 THEN source ELSE substr(source, 4, 8) END AS mixed FROM documents)
SELECT doc_id, 'mixed' AS asked, try_cast(mixed AS DOUBLE) AS color_number, NULL::VARCHAR AS color_label,
  'continuous' AS color_mode FROM d
UNION ALL SELECT doc_id, 'lang', NULL, lang, 'categorical' FROM d"""
TOPIC_TEXTS = """numbered AS (SELECT lang AS source_column, doc_id AS "index", text,
  CASE WHEN substr(source, 4)::INT = 19 THEN -1 ELSE substr(source, 4)::INT END AS topic_id FROM documents)"""
CHECKS["merge_topic_assignments"] = with_ctes(TOPIC_TEXTS) + """
SELECT source_column, "index", length(text)::DOUBLE AS dim_1, topic_id, 'Topic ' || topic_id AS topic_label,
  topic_id = -1 AS is_outlier FROM numbered"""
CHECKS["alignment_errors"] = with_ctes(DOCS) + """
SELECT source_column, "index", CASE WHEN "index" % 7 = 0 THEN 'missing in plot'
  WHEN "index" % 5 = 0 THEN 'missing in assignments' ELSE 'text differs' END AS problem
FROM texts WHERE ("index" % 7 = 0 AND "index" % 5 <> 0) OR ("index" % 7 <> 0 AND "index" % 5 = 0)
  OR ("index" % 7 <> 0 AND "index" % 5 <> 0 AND "index" % 11 = 0 AND upper(text) <> text)"""
CHECKS["hover_text"] = with_ctes(DOCS) + r"""
SELECT "index", regexp_replace(regexp_replace(regexp_replace(text, '\s', ' ', 'g'),
  '(.{1,70})( +|$)|(.{70})', '\1\3<br>', 'g'), '(<br>)+$', '') AS hover FROM texts"""
CHECKS["union_results"] = with_ctes(ROWS) + """
SELECT "index", word_count, 'documents' AS part, NULL::INT AS quality FROM stats
UNION ALL SELECT doc_id, NULL, 'labels', quality FROM labels"""

# ---- words and sentences ---------------------------------------------------------------------
CHECKS["token_lists"] = with_ctes(DOCS) + f"""
SELECT source_column, "index", len(t) AS tokens, array_to_string(t, ' ') AS line
FROM (SELECT *, regexp_extract_all(text, '{WORD}') AS t FROM texts)"""
CHECKS["kept_words"] = with_ctes(DOCS) + f"""
SELECT source_column, "index", len(t) AS all_tokens,
  len(list_filter(t, lambda w: regexp_matches(w, '^\\p{{L}}+$'))) AS alpha,
  len(list_filter(t, lambda w: regexp_matches(w, '^\\p{{L}}+$') AND NOT list_contains({STOP}, lower(w)))) AS alpha_no_stop,
  len(list_filter(t, lambda w: NOT list_contains({STOP}, lower(w)))) AS no_stop
FROM (SELECT *, regexp_extract_all(text, '{WORD}') AS t FROM texts)"""
CHECKS["sentence_lists"] = with_ctes(DOCS) + f"""
SELECT source_column, "index", len(s) AS sentences, length(s[1]) AS first_length, length(s[-1]) AS last_length
FROM (SELECT *, {SENTENCES} AS s FROM texts)"""
CHECKS["word_lengths"] = with_ctes(ROWS) + """
SELECT source_column, "index", coalesce(word_chars, 0)::BIGINT AS word_chars,
  CASE WHEN word_count = 0 THEN 0.0 ELSE round(word_chars::DOUBLE / word_count, 6) END AS avg_word_length FROM counted"""
CHECKS["text_row_stats"] = with_ctes(ROWS) + f"SELECT {STATS_COLUMNS} FROM stats"
CHECKS["text_row_stats_without_stop_words"] = (
    with_ctes(DOCS, words_cte(True), STATS) + f"SELECT {STATS_COLUMNS} FROM stats")
CHECKS["annotated_tokens"] = with_ctes(MARKED) + """
SELECT source_column, "index", pos::INT AS pos, token, lemma, tag, is_stop FROM marked"""
CHECKS["tag_counts"] = with_ctes(TAGGED) + f"SELECT {STATS_COLUMNS} FROM stats"
CHECKS["tag_maps"] = with_ctes(MARKED) + """
SELECT source_column, "index", tag, count(*) AS n FROM alpha GROUP BY ALL"""

# ---- corpora ---------------------------------------------------------------------------------
CHECKS["corpus_totals"] = with_ctes(OVERALL) + """
SELECT corpus, n_texts, total_chars, total_words, total_sentences, nouns, verbs, adjectives, adverbs FROM overall"""
CHECKS["vocabulary_size"] = with_ctes(DOCS, words_cte(), VOCABULARY) + "SELECT * FROM vocabulary"
CHECKS["corpus_averages"] = with_ctes(OVERALL) + """
SELECT corpus, round(avg_word_length, 6) AS avg_word_length, round(avg_sentence_length, 6) AS avg_sentence_length,
  'unweighted' AS mode FROM overall
UNION ALL SELECT corpus, round(avg_word_length, 6), round(ratio_length, 6), 'ratio' FROM overall"""
CHECKS["tag_distribution"] = with_ctes(MARKED) + """
SELECT source_column AS corpus, tag AS pos, count(*) AS n FROM alpha GROUP BY ALL
UNION ALL SELECT 'Combined', tag, count(*) FROM alpha GROUP BY ALL"""
CHECKS["corpus_overall"] = overall_select()
CHECKS["corpus_overall_combined"] = overall_select("ratio_length", "WHERE corpus = 'Combined'")
CHECKS["corpus_overall_per_column"] = overall_select(where="WHERE corpus <> 'Combined'")
CHECKS["pick_overall"] = overall_select(where="WHERE corpus = 'Combined'")


def summary_cte(rows_only: bool = False) -> str:
    titles = [("Characters / Text", "char_count"), ("Words / Text", "word_count"),
              ("Sentences / Text", "sentence_count"), ("Unique Words / Text", "unique_words"),
              ("Lexical Diversity (TTR) / Text", "lexical_diversity"),
              ("Sentence Length", "avg_sentence_length"), ("Word Length", "avg_word_length")]

    def short(x: str) -> str:
        return f"round_even(({x}) * 1000.0, 0) / 1000.0"

    exprs = {
        "N Texts": "count(*)", "Total Characters": "sum(char_count)::BIGINT",
        "Total Words": "sum(word_count)::BIGINT", "Total Sentences": "sum(sentence_count)::BIGINT",
        "Total Unique Words": "NULL::BIGINT" if rows_only else "any_value(v.total_unique_words)",
        "Lexical Diversity (TTR)": short(
            "avg(lexical_diversity)" if rows_only else "any_value(v.total_unique_words) / sum(word_count)::DOUBLE"),
    }
    for title, c in titles:
        exprs[f"Mean {title}"] = short(f"avg({c})")
        exprs[f"SD {title}"] = short(f"coalesce(stddev_samp({c}), 0.0)")
    ordered = [m for _, metrics in METRIC_GROUPS for m in metrics]
    chosen = ", ".join(f'{exprs[m]} AS "{m}"' for m in ordered)
    return f"""{ROWS},
{CORPORA},
{VOCABULARY},
summary AS (SELECT corpus AS "Corpus", {chosen} FROM both_corpora LEFT JOIN vocabulary v USING (corpus) GROUP BY corpus)"""


CHECKS["descriptive_summary"] = with_ctes(summary_cte()) + "SELECT * FROM summary"
CHECKS["summary_from_rows_only"] = with_ctes(summary_cte(True)) + "SELECT * FROM summary"
_METRICS = [(g, name, m) for g, (name, metrics) in enumerate(METRIC_GROUPS) for m in metrics]


def _value(metric: str) -> str:
    fmt = "{:,}" if metric in METRIC_GROUPS[0][1] else "{:.3f}"
    return f"""coalesce(format('{fmt}', "{metric}"), '')"""


VERTICAL = summary_cte() + """,
ranked AS (SELECT *, dense_rank() OVER (ORDER BY "Corpus" <> 'Combined', "Corpus") AS corpus_rank FROM summary),
vertical AS (""" + " UNION ALL ".join(
    f"""SELECT "Corpus" AS corpus, corpus_rank, {rank} AS metric_rank, '{name}' AS metric_group, '{m}' AS metric,
  {_value(m)} AS value, {g} AS g FROM ranked""" for rank, (g, name, m) in enumerate(_METRICS, start=1)) + ")"
CHECKS["summary_vertical"] = with_ctes(VERTICAL) + """
SELECT corpus, corpus_rank::INT AS corpus_rank, metric_rank, metric_group, metric, value FROM vertical"""
CHECKS["summary_markdown"] = with_ctes(VERTICAL) + """
SELECT 0::BIGINT AS ord, '| Corpus | Metric | Value |' AS line UNION ALL SELECT 1, '|:---|:---|---:|'
UNION ALL SELECT 1 + row_number() OVER (ORDER BY corpus_rank, metric_rank),
  '| ' || corpus || ' | ' || metric || ' | ' || value || ' |' FROM vertical"""


def _escaped(column: str) -> str:
    cases = " ".join("WHEN {} THEN {}".format(*(_quoted(x) for x in pair)) for pair in LATEX_ESCAPES)
    return f"array_to_string(list_transform(string_split({column}, ''), lambda c: CASE c {cases} ELSE c END), '')"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


CHECKS["summary_latex"] = with_ctes(VERTICAL) + rf"""
, starts AS (SELECT *, min(metric_rank) OVER (PARTITION BY g) = metric_rank AS opens FROM vertical),
body AS (SELECT corpus_rank, metric_rank, 0 AS part, '\hline' AS line FROM starts
    WHERE opens AND NOT (corpus_rank = 1 AND metric_rank = 1)
  UNION ALL SELECT corpus_rank, metric_rank, 1,
    {_escaped('corpus')} || ' & ' || {_escaped('metric')} || ' & ' || {_escaped('value')} || ' \\' FROM starts),
lines AS (SELECT 0 AS section, corpus_rank, metric_rank, part, line FROM
    (VALUES (0, 0, 0, '\begin{{tabular}}{{lll}}'), (0, 0, 1, '\hline'), (0, 0, 2, 'Corpus & Metric & Value \\'),
      (0, 0, 3, '\hline')) h(corpus_rank, metric_rank, part, line)
  UNION ALL SELECT 1, * FROM body
  UNION ALL SELECT 2, * FROM (VALUES (0, 0, 0, '\hline'), (0, 0, 1, '\end{{tabular}}')))
SELECT row_number() OVER (ORDER BY section, corpus_rank, metric_rank, part) - 1 AS ord, line FROM lines"""
CHECKS["summary_latex"] = CHECKS["summary_latex"].replace(")\n\n, starts", "),\nstarts")

# ---- vectors ---------------------------------------------------------------------------------


def hashed(dim: int) -> str:
    return f"""spread AS (SELECT source_column, "index", md5('42:' || lower(unnest(words))) AS h FROM worded),
hashed AS (SELECT source_column, "index", (('0x' || substr(h, 1, 8))::BIGINT % {dim})::BIGINT AS bucket,
  sum(CASE WHEN substr(h, 9, 1) < '8' THEN 1 ELSE -1 END)::BIGINT AS value FROM spread GROUP BY ALL HAVING value <> 0)"""


CHECKS["hashing_embedding"] = with_ctes(DOCS, words_cte(), hashed(64)) + "SELECT * FROM hashed"
CHECKS["embedded_documents"] = with_ctes(DOCS, words_cte(), hashed(64)) + """
SELECT source_column, "index", bucket::INT AS bucket,
  round(value / sqrt(sum(value * value) OVER (PARTITION BY source_column, "index")), 6) AS value FROM hashed"""
CHECKS["join_embeddings"] = with_ctes(DOCS) + """
SELECT t.source_column, t."index", len(e.embedding) AS dim, round(e.embedding[64]::DOUBLE, 6) AS last
FROM texts t JOIN embeddings e ON e.vec_id = t."index" """
CHECKS["l2_normalize"] = """
WITH v AS (SELECT vec_id, unnest(embedding)::DOUBLE * (vec_id % 5 + 1) AS x, generate_subscripts(embedding, 1) - 1 AS pos
  FROM embeddings)
SELECT vec_id, pos::INT AS pos, round(x / sqrt(sum(x * x) OVER (PARTITION BY vec_id)), 6) + 0.0 AS value FROM v"""
CHECKS["mean_pool_by_row"] = with_ctes(CONVERSATIONS, words_cte(), hashed(32)) + """
, n AS (SELECT "index", count(*) AS texts FROM texts GROUP BY "index")
SELECT h."index", bucket::INT AS bucket, round(sum(value) / any_value(n.texts)::DOUBLE, 6) AS value
FROM hashed h JOIN n USING ("index") GROUP BY ALL HAVING sum(value) <> 0"""
CHECKS["select_feature_set"] = with_ctes(CONVERSATIONS, words_cte(), hashed(32)) + """
SELECT "index", bucket::INT AS bucket, value::DOUBLE AS value FROM hashed WHERE source_column = 'assistant'"""
_KNN = {
    "cosine": "1 - list_cosine_similarity(a.v, b.v)", "euclidean": "list_distance(a.v, b.v)",
    "manhattan": "list_sum(list_transform(list_zip(a.v, b.v), lambda z: abs(z[1] - z[2])))",
}
for _metric, _gap in _KNN.items():
    CHECKS[f"knn_{_metric}"] = f"""
WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
pairs AS (SELECT a.vec_id AS key, b.vec_id AS neighbour, {_gap} AS distance FROM e a JOIN e b ON a.vec_id <> b.vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY distance, neighbour) AS place FROM pairs)
SELECT key, neighbour, place::INT AS place, round(distance, 6) AS distance FROM ranked WHERE place <= 5"""
CHECKS["knn_measured_recall"] = """
SELECT vec_id AS key, least(5, (SELECT count(*) FROM embeddings) - 1)::BIGINT AS found, true AS enough
FROM embeddings WHERE vec_id % 100 = 0"""

# ---- topics ----------------------------------------------------------------------------------


def terms(bigrams: bool = True, stop: bool = True, limits: bool = True) -> str:
    kept = "w"
    if stop:
        kept = f"list_filter(w, lambda x: NOT list_contains({STOP}, x))"
    both = "k"
    if bigrams:
        both = ("list_concat(k, list_transform(range(1, greatest(len(k), 1)), "
                "lambda i: k[i] || ' ' || k[i + 1]))")
    limit = "WHERE topics >= 2 AND topics <= 0.9 * (SELECT count(DISTINCT topic_id) FROM numbered)" if limits else ""
    return rf"""{TOPIC_TEXTS},
plain AS (SELECT topic_id, regexp_extract_all(translate(regexp_replace(lower(text), '\p{{M}}', '', 'g'),
  '{ACCENTED}', '{PLAIN}'), '[\p{{L}}\p{{N}}_]{{2,}}') AS w FROM numbered),
kept AS (SELECT topic_id, {kept} AS k FROM plain),
grams AS (SELECT topic_id, unnest({both}) AS term FROM kept),
counts AS (SELECT topic_id, term, count(*) AS n FROM grams GROUP BY ALL),
used AS (SELECT *, count(*) OVER (PARTITION BY term) AS topics FROM counts),
tc AS (SELECT * FROM used {limit})"""


def scores(reduce_words: bool = True, **kw) -> str:
    tf = "n / sum(n) OVER (PARTITION BY topic_id)"
    tf = f"sqrt({tf})" if reduce_words else tf
    return terms(**kw) + f""",
mean AS (SELECT floor(sum(n) / count(DISTINCT topic_id)) AS a FROM tc),
scored AS (SELECT topic_id, term, n, {tf} * ln(1.0 + (SELECT a FROM mean) / sum(n) OVER (PARTITION BY term)) AS score FROM tc),
best AS (SELECT topic_id, term, score, row_number() OVER (PARTITION BY topic_id ORDER BY score DESC, term) AS place
  FROM scored WHERE topic_id <> -1)"""


LABELS = """listed AS (SELECT topic_id, list(term ORDER BY place) AS t FROM best WHERE place <= {n} GROUP BY topic_id),
labels_of AS (SELECT i.topic_id, CASE WHEN i.topic_id = -1 THEN 'Outlier / noise'
  WHEN len(t) > 0 THEN 'Topic ' || i.topic_id || ': ' || array_to_string(t[1:3], ', ')
  ELSE 'Topic ' || i.topic_id END AS topic_label, coalesce(array_to_string(t, ', '), '') AS top_terms
  FROM (SELECT DISTINCT topic_id FROM numbered) i LEFT JOIN listed USING (topic_id))"""
CHECKS["topic_terms_count"] = with_ctes(terms()) + "SELECT topic_id, term, n, topics FROM tc"
CHECKS["ctfidf"] = with_ctes(scores()) + "SELECT topic_id, term, n, round(score, 6) AS score FROM scored"
CHECKS["top_terms"] = with_ctes(scores()) + """
SELECT topic_id, place::INT AS place, term, round(score, 6) AS score FROM best WHERE place <= 10"""
CHECKS["topic_labels"] = with_ctes(scores(), LABELS.format(n=10)) + "SELECT * FROM labels_of"
CHECKS["update_topic_representation"] = with_ctes(
    scores(False, bigrams=False, stop=False, limits=False), LABELS.format(n=5)) + "SELECT * FROM labels_of"
CHECKS["min_df_rule"] = """
SELECT source, lang, count(*) AS docs, CASE WHEN count(*) >= 20 THEN 2 ELSE 1 END AS min_df FROM documents GROUP BY ALL"""
CHECKS["renumber_topics"] = """
WITH t AS (SELECT label, row_number() OVER (ORDER BY count(*) DESC, min(vec_id)) - 1 AS topic_id FROM embeddings
  WHERE label <> 9 GROUP BY label)
SELECT vec_id AS key, coalesce(topic_id, -1)::INT AS topic_id FROM embeddings LEFT JOIN t USING (label)"""
EMBEDDED = f"""{DOCS},
embedded AS (SELECT t.source_column, t."index", t.text, CASE WHEN e.label = 9 THEN -1 ELSE e.label END AS topic_id,
  e.embedding::DOUBLE[] AS v FROM texts t JOIN embeddings e ON e.vec_id = t."index"),
dims AS (SELECT topic_id, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM embedded WHERE topic_id <> -1),
centroids AS (SELECT topic_id, list(m ORDER BY pos) AS c FROM
  (SELECT topic_id, pos, avg(x) AS m FROM dims GROUP BY ALL) GROUP BY topic_id)"""
PROBABILITY = f"""{EMBEDDED},
weights AS (SELECT e."index", e.topic_id, exp(-list_distance(e.v, c.c)) AS w, c.topic_id AS t FROM embedded e, centroids c),
chances AS (SELECT "index", sum(w) FILTER (t = topic_id) / sum(w) AS p FROM weights GROUP BY "index"),
scored_docs AS (SELECT e.source_column, e."index", e.text, e.topic_id,
  CASE WHEN e.topic_id <> -1 THEN p END AS topic_probability FROM embedded e LEFT JOIN chances USING ("index"))"""
CHECKS["topic_probability"] = with_ctes(PROBABILITY) + """
SELECT source_column, "index", topic_id, round(topic_probability, 6) AS topic_probability FROM scored_docs"""
CHECKS["own_probability"] = """
WITH c AS (SELECT user_id AS key, CASE event_type WHEN 'click' THEN 0 WHEN 'view' THEN 1 WHEN 'purchase' THEN 2
  WHEN 'signup' THEN 3 ELSE 4 END AS t, count(*) AS n FROM events GROUP BY ALL),
s AS (SELECT key, t, n / sum(n) OVER (PARTITION BY key) AS p, (key % 7 - 1)::INT AS topic_id FROM c)
SELECT key, topic_id, CASE WHEN topic_id <> -1 THEN round(coalesce(max(p) FILTER (t = topic_id), max(p)), 6) END
  AS topic_probability FROM s GROUP BY key, topic_id"""
CHECKS["topic_assignments"] = with_ctes(PROBABILITY, scores(), LABELS.format(n=10)) + """
SELECT "index", source_column, text, topic_id, topic_label, round(topic_probability, 6) AS topic_probability,
  topic_id = -1 AS is_outlier FROM scored_docs LEFT JOIN labels_of USING (topic_id)"""
_CLEAN = r"trim(regexp_replace(text, '[\r\n]', ' ', 'g'))"
_SHORT = f"CASE WHEN length({_CLEAN}) > 160 THEN substr({_CLEAN}, 1, 160) || '...' ELSE {_CLEAN} END"
CHECKS["topic_summary"] = with_ctes(scores(), LABELS.format(n=10)) + f""",
firsts AS (SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY "index", source_column) AS r FROM numbered),
reps AS (SELECT topic_id, string_agg({_SHORT}, ' || ' ORDER BY r) AS representative_docs FROM firsts
  WHERE r <= 3 AND {_CLEAN} <> '' GROUP BY topic_id),
sizes AS (SELECT topic_id, count(*) AS count, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM numbered GROUP BY topic_id)
SELECT topic_id, topic_label, count, share, top_terms, coalesce(representative_docs, '') AS representative_docs
FROM sizes LEFT JOIN labels_of USING (topic_id) LEFT JOIN reps USING (topic_id)"""
CHECKS["representative_docs"] = with_ctes(EMBEDDED) + f""",
near AS (SELECT e.topic_id, e."index", e.source_column, e.text, list_cosine_similarity(e.v, c.c) AS s
  FROM embedded e LEFT JOIN centroids c USING (topic_id)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY s DESC NULLS LAST, "index", source_column) AS r FROM near)
SELECT topic_id, string_agg({_SHORT}, ' || ' ORDER BY r) AS representative_docs FROM ranked
WHERE r <= 3 AND {_CLEAN} <> '' GROUP BY topic_id"""
CHECKS["topic_run_metrics"] = with_ctes(TOPIC_TEXTS) + """
SELECT count(*) AS documents, count(DISTINCT topic_id) FILTER (topic_id <> -1) AS topics,
  count(*) FILTER (topic_id = -1) AS noise_documents, round(avg((topic_id = -1)::DOUBLE), 6) AS noise_share FROM numbered"""
CHECKS["select_topics"] = with_ctes(TOPIC_TEXTS) + """
SELECT topic_id, count(*) AS count, row_number() OVER (ORDER BY count(*) DESC, topic_id)::INT AS place
FROM numbered WHERE topic_id <> -1 GROUP BY topic_id ORDER BY place LIMIT 8"""
CHECKS["barchart_data"] = with_ctes(scores()) + """
SELECT topic_id, place::INT AS place, term, round(score, 6) AS score FROM best WHERE place <= 5"""
CHECKS["term_rank_data"] = with_ctes(scores()) + """
SELECT topic_id, place::INT AS rank, term, round(log10(score), 6) AS score FROM best WHERE place <= 10"""


def cosine_pairs(weights: str) -> str:
    return f""",
w AS ({weights}),
u AS (SELECT topic_id, feature, weight / sqrt(sum(weight * weight) OVER (PARTITION BY topic_id)) AS weight FROM w),
ids AS (SELECT DISTINCT topic_id FROM w),
sums AS (SELECT a.topic_id AS topic_a, b.topic_id AS topic_b, sum(a.weight * b.weight) AS s
  FROM u a JOIN u b USING (feature) GROUP BY ALL)
SELECT a.topic_id AS topic_a, b.topic_id AS topic_b, round(coalesce(s, 0.0), 6) AS similarity
FROM ids a CROSS JOIN ids b LEFT JOIN sums ON topic_a = a.topic_id AND topic_b = b.topic_id"""


CHECKS["heatmap_terms"] = with_ctes(scores()) + cosine_pairs(
    "SELECT topic_id, term AS feature, score AS weight FROM scored WHERE topic_id <> -1")
CHECKS["heatmap_centroids"] = with_ctes(EMBEDDED) + cosine_pairs(
    "SELECT topic_id, unnest(c) AS weight, generate_subscripts(c, 1) AS feature FROM centroids")
CHECKS["documents_plot"] = with_ctes(TOPIC_TEXTS) + """
, placed AS (SELECT source_column, "index", topic_id, row_number() OVER
  (PARTITION BY topic_id ORDER BY md5('42:' || "index"), "index") AS place, count(*) OVER (PARTITION BY topic_id) AS n FROM numbered)
SELECT source_column, "index", topic_id, place FROM placed WHERE place <= ceil(0.35::DOUBLE * n)"""

# ---- tasks and folds -------------------------------------------------------------------------
LABELLED = """rows_ AS (SELECT l.doc_id, l.quality, l.toxic, d.lang, d.source, d.n_chars
  FROM labels l JOIN documents d USING (doc_id))"""
CHECKS["detect_task"] = with_ctes(LABELLED) + ", n AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS target, count(DISTINCT {e}) AS n_unique, {text} AS text FROM rows_"
    for c, e, text in [("quality", "quality", "false"), ("toxic", "toxic", "false"), ("n_chars", "n_chars", "false"),
                       ("source", "source", "true"), ("lang", "lang", "true"), ("loud", "(toxic = 1)", "true")]
) + """) SELECT target, n_unique, CASE WHEN text OR n_unique <= 20 THEN 'classification' ELSE 'regression' END AS task FROM n"""
CHECKS["encode_label"] = """
SELECT doc_id, source, dense_rank() OVER (ORDER BY source)::INT - 1 AS y FROM documents"""
CHECKS["fold_count"] = with_ctes(LABELLED) + """
, room AS (SELECT 'quality' AS test, min(n) AS m FROM (SELECT count(*) AS n FROM rows_ GROUP BY quality)
  UNION ALL SELECT 'toxic by source', min(n) FROM (SELECT count(DISTINCT source) AS n FROM rows_ GROUP BY toxic)
  UNION ALL SELECT 'n_chars', count(*) // 2 FROM rows_
  UNION ALL SELECT 'n_chars by lang', count(DISTINCT lang) FROM rows_)
SELECT test, 10 AS requested, greatest(2, least(10, m))::INT AS folds, NULL::VARCHAR AS reason FROM room"""
CHECKS["kfold"] = """
SELECT o_orderkey, ((row_number() OVER (ORDER BY md5('42:' || o_orderkey), o_orderkey) - 1) % 5)::INT AS fold FROM orders"""
CHECKS["stratified_kfold"] = """
SELECT doc_id, quality, ((row_number() OVER (PARTITION BY quality ORDER BY md5('42:' || doc_id), doc_id) - 1) % 5)::INT
  AS fold FROM labels"""


def snake(rank: str, k: int) -> str:
    return f"(CASE WHEN (({rank}) // {k}) % 2 = 0 THEN ({rank}) % {k} ELSE {k - 1} - ({rank}) % {k} END)::INT"


CHECKS["group_kfold"] = f"""
WITH g AS (SELECT user_id, row_number() OVER (ORDER BY count(*) DESC, md5(user_id::VARCHAR), user_id) - 1 AS r
  FROM events GROUP BY user_id)
SELECT event_id, user_id, {snake('r', 5)} AS fold FROM events JOIN g USING (user_id)"""
CHECKS["stratified_group_kfold"] = f"""
WITH rows_ AS (SELECT e.vec_id, e.label, d.source FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id),
parts AS (SELECT source, label, count(*) AS n FROM rows_ GROUP BY ALL),
main AS (SELECT source, sum(n) AS size, first(label ORDER BY n DESC, label) AS main FROM parts GROUP BY source),
g AS (SELECT source, row_number() OVER (PARTITION BY main ORDER BY size DESC, md5(source), source) - 1 AS r FROM main)
SELECT vec_id, source, label, {snake('r', 4)} AS fold FROM rows_ JOIN g USING (source)"""
CHECKS["inner_folds"] = """
WITH f AS (SELECT doc_id, toxic, ((row_number() OVER (PARTITION BY toxic ORDER BY md5('42:' || doc_id), doc_id) - 1) % 4)::INT
  AS fold FROM labels),
o AS (SELECT doc_id, toxic, fold, o.outer_fold FROM f, (SELECT unnest(range(4))::INT AS outer_fold) o),
g AS (SELECT doc_id, outer_fold, ((row_number() OVER (PARTITION BY outer_fold, toxic
  ORDER BY md5('42:inner:' || outer_fold || ':' || doc_id), doc_id) - 1) % 3)::INT AS g FROM o WHERE fold <> outer_fold)
SELECT o.doc_id, o.fold, o.outer_fold AS "outer", coalesce(g, -1) AS "inner"
FROM o LEFT JOIN g ON o.doc_id = g.doc_id AND o.outer_fold = g.outer_fold"""
CHECKS["permuted_labels"] = """
WITH base AS (SELECT quality, row_number() OVER (ORDER BY md5('42:0:' || doc_id), doc_id) AS r FROM labels),
p AS (SELECT doc_id, perm, row_number() OVER (PARTITION BY perm ORDER BY md5('42:' || perm || ':' || doc_id), doc_id) AS r
  FROM labels, (SELECT unnest(range(1, 21))::INT AS perm))
SELECT doc_id, perm, quality FROM p JOIN base USING (r)"""

# ---- features per fold -----------------------------------------------------------------------
LONG = """folded AS (SELECT vec_id AS doc_id, (('0x' || substr(md5(vec_id::VARCHAR), 1, 6))::BIGINT % 5)::INT AS fold, label,
  unnest(embedding)::DOUBLE AS x, (generate_subscripts(embedding, 1) - 1)::INT AS pos FROM embeddings),
train AS (SELECT f.fold, d.pos, d.x, d.label FROM (SELECT DISTINCT fold FROM folded) f JOIN folded d ON d.fold <> f.fold)"""
SCALE = f"""{LONG},
scale AS (SELECT fold, pos, avg(x) AS mean, CASE WHEN var_pop(x) > 1e-18 THEN stddev_pop(x) ELSE 1.0 END AS sd
  FROM train GROUP BY ALL)"""
F_CLASS = f"""{LONG},
cells AS (SELECT fold, pos, label, count(*) AS n, avg(x) AS m, var_pop(x) * count(*) AS ss FROM train GROUP BY ALL),
f AS (SELECT fold, pos, (sum(n * (m - g) * (m - g)) / (count(*) - 1)) / (sum(ss) / (sum(n) - count(*))) AS f FROM
  (SELECT *, sum(n * m) OVER (PARTITION BY fold, pos) / sum(n) OVER (PARTITION BY fold, pos) AS g FROM cells) GROUP BY ALL)"""
CHECKS["scaler_statistics"] = with_ctes(SCALE) + """
SELECT fold, pos, round(mean, 6) + 0.0 AS mean, round(sd, 6) AS sd FROM scale"""
CHECKS["standardized_features"] = with_ctes(SCALE) + """
SELECT doc_id, fold, pos, round((x - mean) / sd, 6) + 0.0 AS z FROM folded JOIN scale USING (fold, pos)"""
CHECKS["select_kbest_class"] = with_ctes(F_CLASS) + """
, r AS (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY f DESC, pos DESC) AS place FROM f)
SELECT fold, pos, round(f, 6) AS f, place::INT AS place FROM r WHERE place <= 12"""
CHECKS["select_kbest_regression"] = with_ctes(LONG) + """
, c AS (SELECT fold, pos, corr(x, label) AS r, count(*) AS n FROM train GROUP BY ALL),
f AS (SELECT fold, pos, r * r / (1 - r * r) * (n - 2) AS f FROM c),
r AS (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY f DESC, pos DESC) AS place FROM f)
SELECT fold, pos, round(f, 6) AS f, place::INT AS place FROM r WHERE place <= 12"""
CHECKS["select_percentile"] = with_ctes(F_CLASS) + """
, r AS (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY f DESC, pos) AS place FROM f)
SELECT fold, pos, round(f, 6) AS f, place::INT AS place FROM r WHERE place <= 12"""
CHECKS["variance_threshold"] = with_ctes(LONG) + """
SELECT fold, pos, round(var_pop(x), 6) AS variance FROM train GROUP BY ALL HAVING var_pop(x) > 0.0155"""

# ---- scores ----------------------------------------------------------------------------------
CLASS_ROWS = """preds AS (SELECT 'quality' AS target, d.lang, l.quality AS y, l.toxic AS p FROM labels l JOIN documents d USING (doc_id))"""


def class_metrics(by: str) -> str:
    return f"""{CLASS_ROWS},
classes AS (SELECT DISTINCT {by}, y AS c FROM preds UNION SELECT DISTINCT {by}, p FROM preds),
per AS (SELECT k.{by}, k.c, count(*) FILTER (y = k.c) AS support, count(*) FILTER (p = k.c) AS predicted,
  count(*) FILTER (y = k.c AND p = k.c) AS hits FROM classes k JOIN preds d ON d.{by} = k.{by} GROUP BY ALL),
scored AS (SELECT *, CASE WHEN support > 0 THEN hits::DOUBLE / support END AS rec,
  CASE WHEN predicted > 0 THEN hits::DOUBLE / predicted ELSE 0.0 END AS prec FROM per),
metrics AS (SELECT {by}, sum(hits)::DOUBLE / sum(support) AS accuracy, avg(rec) AS balanced_accuracy,
  sum(support * prec) / sum(support) AS precision, sum(support * coalesce(rec, 0)) / sum(support) AS recall,
  sum(support * CASE WHEN prec + coalesce(rec, 0) > 0 THEN 2 * prec * coalesce(rec, 0) / (prec + coalesce(rec, 0)) ELSE 0 END)
    / sum(support) AS f1 FROM scored GROUP BY {by})"""


CHECKS["classification_metrics"] = with_ctes(class_metrics("lang")) + """
SELECT lang, round(accuracy, 6) AS accuracy, round(balanced_accuracy, 6) AS balanced_accuracy,
  round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM metrics"""
CHECKS["pooled_metrics"] = with_ctes(class_metrics("target")) + """
SELECT target, round(accuracy, 6) AS metric_accuracy, round(recall, 6) AS metric_recall, round(f1, 6) AS metric_f1 FROM metrics"""
PRICES = """prices AS (SELECT 'price' AS target, l_returnflag, (l_orderkey % 5)::INT AS fold, round(l_extendedprice) AS y,
  round(l_quantity * 1500) AS p FROM lineitem)"""
CHECKS["regression_metrics"] = with_ctes(PRICES) + """
SELECT l_returnflag, round(1 - sum((y - p) * (y - p)) / (var_pop(y) * count(y)), 6) AS r2, round(avg(abs(y - p)), 6) AS mae,
  round(avg((y - p) * (y - p)), 6) AS mse, round(sqrt(avg((y - p) * (y - p))), 6) AS rmse FROM prices GROUP BY l_returnflag"""
CHECKS["cv_scores"] = with_ctes(PRICES) + """
, s AS (SELECT target, fold, 1 - sum((y - p) * (y - p)) / (var_pop(y) * count(y)) AS score FROM prices GROUP BY ALL)
SELECT target, round(avg(score) OVER (), 6) AS observed, count(*) OVER ()::INT AS cv_folds_used, fold, round(score, 6) AS score FROM s"""
OBSERVED = """observed AS (SELECT event_type, round(avg(value), 2) AS o FROM events GROUP BY event_type)"""
CHECKS["permutation_pvalues"] = with_ctes(OBSERVED) + " UNION ALL ".join(
    f"""SELECT e.event_type AS target, round(o, 6) AS observed, count(*) AS n_permutations,
  round((1.0 + count(*) FILTER (value {op} o)) / (count(*) + 1.0), 6) AS p_value, {flag} AS larger_is_better
FROM events e JOIN observed USING (event_type) GROUP BY e.event_type, o
""" for op, flag in ((">=", "true"), ("<=", "false")))
CHECKS["permutation_histogram"] = with_ctes(OBSERVED) + """
, ends AS (SELECT event_type, min(value) AS a, max(value) AS b, (max(value) - min(value)) / 30 AS w FROM events GROUP BY event_type),
counts AS (SELECT e.event_type, least(floor((value - a) / w), 29)::INT AS bin, count(*) AS n
  FROM events e JOIN ends USING (event_type) GROUP BY ALL)
SELECT t.event_type AS target, b.bin, round(a + b.bin * w, 6) AS low, round(a + (b.bin + 1) * w, 6) AS high,
  coalesce(n, 0) AS n, round(o, 6) AS observed
FROM ends t JOIN (SELECT unnest(range(30))::INT AS bin) b ON true JOIN observed USING (event_type)
LEFT JOIN counts c ON c.event_type = t.event_type AND c.bin = b.bin"""
TESTS = """grouped AS (SELECT event_type, user_id, count(*) AS n, count(*) FILTER (value >= 40) AS high,
  sum(round(value * 100)::BIGINT) AS cents FROM events GROUP BY ALL),
tests AS (SELECT event_type || ' :: ' || user_id AS target, user_id::VARCHAR AS target_name, event_type AS feature_set,
  CASE WHEN user_id % 2 = 0 THEN 'classification' ELSE 'regression' END AS task,
  CASE WHEN user_id % 2 = 0 THEN 'accuracy' ELSE 'r2' END AS metric_name,
  ln(cents / 100.0::DOUBLE / n + 1.0) / CASE WHEN user_id % 2 = 0 THEN 5.5 ELSE 8.0 END
    - CASE WHEN user_id % 2 = 0 THEN 0.0 ELSE 0.45 END AS observed,
  CASE WHEN user_id % 11 <> 0 THEN pow((high + 1)::DOUBLE / (n + 1), 3.3) END AS p_value,
  (n % 4 + 2)::INT AS cv_folds_used FROM grouped)"""


def ranked_tests(family: str) -> str:
    return f"""{TESTS},
ranked AS (SELECT *, {family} AS family, row_number() OVER (PARTITION BY {family} ORDER BY p_value, target) AS i,
  count(*) OVER (PARTITION BY {family}) AS m FROM tests WHERE p_value IS NOT NULL)"""


_UP = "OVER (PARTITION BY family ORDER BY i DESC)"
_DOWN = "OVER (PARTITION BY family ORDER BY i)"
_BH = f"least(1.0, min(p_value * m / i) {_UP})"
ADJUSTED = {
    "bonferroni": "p_value * m",
    "sidak": "1 - pow(1 - p_value, m)",
    "holm": f"max((m - i + 1) * p_value) {_DOWN}",
    "holm-sidak": f"max(1 - pow(1 - p_value, m - i + 1)) {_DOWN}",
    "simes-hochberg": f"min((m - i + 1) * p_value) {_UP}",
    "fdr_bh": _BH,
    "fdr_by": f"min(p_value * m / i) {_UP} * list_sum(list_transform(range(1, m + 1), lambda j: 1.0 / j))",
    "fdr_gbs": f"max(CASE WHEN p_value < 1 THEN (m - i + 1)::DOUBLE / i * p_value / (1 - p_value) ELSE 1e300 END) {_DOWN}",
}


def adjusted_cte(method: str, family: str) -> str:
    base = ranked_tests(family)
    if method in ADJUSTED:
        return base + f""",
adjusted AS (SELECT target, least(1.0, {ADJUSTED[method]}) AS p_adjusted FROM ranked)"""
    if method == "hommel":
        return base + """,
sizes AS (SELECT DISTINCT family, m, unnest(range(2, m + 1)) AS k FROM ranked),
least_of AS (SELECT s.family, s.k, s.m, min(s.k * r.p_value / (r.i - (s.m - s.k))) AS c
  FROM sizes s JOIN ranked r ON r.family = s.family AND r.i > s.m - s.k GROUP BY ALL),
adjusted AS (SELECT r.target, least(1.0, greatest(r.p_value, max(CASE WHEN r.i > l.m - l.k THEN l.c
  ELSE least(l.k * r.p_value, l.c) END))) AS p_adjusted
  FROM ranked r JOIN least_of l USING (family) GROUP BY r.target, r.p_value)"""
    factor = "1.05" if method == "fdr_tsbky" else "1.0"
    return base + f""",
first_pass AS (SELECT *, {_BH} AS bh FROM ranked),
rejects AS (SELECT *, count(*) FILTER (bh <= 0.05 / {factor}) OVER (PARTITION BY family) AS r1 FROM first_pass),
adjusted AS (SELECT target, least(1.0, bh * {factor} * CASE WHEN r1 > 0 AND r1 < m THEN (m - r1)::DOUBLE / m ELSE 1.0 END)
  AS p_adjusted FROM rejects)"""


for _method in METHODS:
    _fdr = "round(p_adjusted, 6)" if _method == "fdr_bh" else "NULL::DOUBLE"
    CHECKS["adjust_" + _method.replace("-", "_")] = with_ctes(adjusted_cte(_method, "feature_set")) + f"""
SELECT t.target, round(p_value, 6) AS p_value, round(p_adjusted, 6) AS p_adjusted,
  CASE WHEN p_adjusted IS NOT NULL THEN '{_method}' END AS p_adjust_method, {_fdr} AS p_fdr,
  'within_feature_set' AS p_adjust_scope FROM tests t LEFT JOIN adjusted USING (target)"""
CHECKS["correction_scopes"] = " UNION ALL ".join(
    "SELECT * FROM (" + with_ctes(adjusted_cte("holm", family)) + f"""
SELECT t.target, '{scope}' AS p_adjust_scope, round(p_adjusted, 6) AS p_adjusted FROM tests t LEFT JOIN adjusted USING (target))"""
    for scope, family in (("all_tests", "1"), ("within_target", "target_name"), ("within_feature_set", "feature_set")))

# ---- models and reports ----------------------------------------------------------------------
CHECKS["skipped_targets"] = "SELECT 'constant' AS target, 'only a single class after alignment' AS reason"
TALK = f"""{TAGGED},
{CORPORA},
keyed AS (SELECT DISTINCT source_column, lemma FROM alpha),
vocabulary AS (SELECT corpus, count(DISTINCT lemma) AS v FROM (SELECT source_column AS corpus, lemma FROM keyed
  UNION ALL SELECT 'Combined', lemma FROM keyed) GROUP BY corpus),
overall AS (SELECT corpus, sum(word_count) AS w, sum(noun_count) AS nouns, sum(verb_count) AS verbs,
  avg(avg_sentence_length) AS asl, any_value(v) / sum(word_count)::DOUBLE AS ttr
  FROM both_corpora JOIN vocabulary USING (corpus) GROUP BY corpus)"""
CHECKS["interpret_stats"] = with_ctes(TALK) + """
, lines AS (SELECT corpus, list_filter([
  CASE WHEN ttr >= 0.8 THEN 'Lexical diversity is very high which suggests a rich vocabulary with little repetition.'
    WHEN ttr >= 0.6 THEN 'Lexical diversity is moderate which suggests some repetition and good variety.'
    ELSE 'Lexical diversity is relatively low which suggests frequent repetition of word types.' END,
  CASE WHEN asl >= 20 THEN 'Average sentence length is long which often reflects complex structure.'
    WHEN asl >= 12 THEN 'Average sentence length is mid range which often reflects balanced structure.'
    ELSE 'Average sentence length is short which often reflects simple direct phrasing.' END,
  CASE WHEN w > 0 AND nouns + verbs > 0 THEN
    CASE WHEN nouns / greatest(verbs, 1)::DOUBLE >= 2 THEN 'Noun to verb ratio is high which can indicate dense nominal style.'
      WHEN nouns / greatest(verbs, 1)::DOUBLE <= 0.7 THEN 'Verb to noun ratio is high which can indicate action oriented style.'
    END END], lambda x: x IS NOT NULL) AS l FROM overall)
SELECT corpus, (generate_subscripts(l, 1) - 1)::INT AS ord, unnest(l) AS line FROM lines"""
REPORTED = adjusted_cte("fdr_bh", "1") + """,
reported AS (SELECT t.*, p_adjusted, p_adjusted IS NOT NULL AS done, upper(metric_name) AS metric,
  task = 'regression' AND observed < 0 AS negative FROM tests t LEFT JOIN adjusted USING (target))"""


def model_lines(notes: str) -> str:
    return with_ctes(REPORTED) + f"""
, lines AS (SELECT target, list_filter([
  metric || CASE WHEN task = 'classification' THEN CASE WHEN observed >= 0.8 THEN ' indicates strong discrimination.'
      WHEN observed >= 0.6 THEN ' indicates moderate discrimination.' ELSE ' indicates weak discrimination.' END
    ELSE CASE WHEN observed >= 0.5 THEN ' indicates strong fit.' WHEN observed >= 0.2 THEN ' indicates moderate fit.'
      WHEN observed >= 0 THEN ' indicates weak fit.'
      ELSE ' is negative which is worse than a constant baseline and suggests poor generalization.' END END,
  CASE WHEN p_value IS NULL THEN 'Permutation test result is unavailable.'
    WHEN p_adjusted < 0.05 AND negative THEN 'Permutation test with FDR (Benjamini–Hochberg) correction is statistically reliable, but negative R2 indicates poor predictive performance.'
    WHEN p_adjusted < 0.05 THEN 'Permutation test with FDR (Benjamini–Hochberg) correction indicates a statistically reliable effect.'
    WHEN p_value < 0.05 THEN 'Permutation test is nominally significant but not after FDR (Benjamini–Hochberg) correction.'
    ELSE 'Permutation test does not indicate statistical significance.' END,
  'Cross validation used ' || cv_folds_used || ' folds.', {notes}], lambda x: x IS NOT NULL) AS l FROM reported)
SELECT target, (generate_subscripts(l, 1) - 1)::INT AS ord, unnest(l) AS line FROM lines"""


CHECKS["interpret_model_rows"] = model_lines("NULL")
CHECKS["interpret_model_rows_with_settings"] = model_lines(
    "'Advanced settings used: KBest feature selection (k=12); permutation testing (250 iterations); "
    "forced task mode (regression).'")


def model_sentences(adjusted: bool) -> str:
    poor = ("suggesting a statistically reliable difference from permutations, "
            "but with poor predictive performance because R2 is negative")
    if adjusted:
        p, tail = "p_adjusted", " after multiple-comparisons correction"
        given = "' and adjusted p=' || format('{:.4f}', p_adjusted) || ' (fdr_bh), '"
        middle = "WHEN p_value < 0.05 THEN 'showing nominal significance that did not survive multiple-comparisons correction'"
    else:
        p, tail, given, middle = "p_value", "", "', '", ""
    return with_ctes(REPORTED) + f"""
SELECT target, 'For target ' || target || ', we ran a ' || task || ' model with ' || cv_folds_used ||
  '-fold cross validation. The observed ' || metric || ' was ' || format('{{:.3f}}', observed) || '. ' ||
  CASE WHEN p_value IS NULL THEN 'Permutation testing was unavailable.'
  ELSE 'Permutation testing gave p=' || format('{{:.4f}}', p_value) || {given} ||
    CASE WHEN {p} < 0.05 AND negative THEN '{poor}'
      WHEN {p} < 0.05 THEN 'suggesting a statistically reliable effect{tail}' {middle}
      ELSE 'indicating no statistically reliable effect' END || '.' END AS summary FROM reported"""


CHECKS["summarize_model_rows"] = model_sentences(True)
CHECKS["summarize_model_rows_unadjusted"] = model_sentences(False)
CHECKS["settings_of_results"] = with_ctes(REPORTED) + """
, s AS (SELECT 'task' AS "Setting", task AS v FROM reported UNION SELECT 'metric_name', metric_name FROM reported
  UNION SELECT 'p_adjust_method', 'fdr_bh' FROM reported WHERE done UNION SELECT 'p_adjust_scope', 'all_tests' FROM reported)
SELECT "Setting", string_agg(v, ', ' ORDER BY v) AS "Value" FROM s GROUP BY "Setting" """
CHECKS["key_totals"] = with_ctes(OVERALL) + """
SELECT corpus, ord, metric, value FROM overall, LATERAL (VALUES
  (1, 'Total characters', total_chars::DOUBLE), (2, 'Total words', total_words::DOUBLE),
  (3, 'Total sentences', total_sentences::DOUBLE), (4, 'Average word length', round_even(avg_word_length, 3)),
  (5, 'Average sentence length', round_even(avg_sentence_length, 3)), (6, 'Total unique words', total_unique_words::DOUBLE),
  (7, 'Lexical diversity', round_even(lexical_diversity, 3))) v(ord, metric, value)"""
CHECKS["model_report_table"] = with_ctes(REPORTED) + """
SELECT target, task, metric_name, round_even(observed, 3) AS observed, round_even(p_value, 4) AS p_value,
  round_even(p_adjusted, 4) AS p_adjusted, CASE WHEN done THEN 'fdr_bh' END AS p_adjust_method,
  'all_tests' AS p_adjust_scope, cv_folds_used FROM reported"""
CHECKS["fold_reduction_report"] = with_ctes(TESTS) + """
SELECT target, 4 AS requested, cv_folds_used FROM tests WHERE cv_folds_used < 4"""
CHECKS["table_round_trip"] = "SELECT conv_id, turn, role, text FROM conversations"
CHECKS["shown_columns"] = with_ctes(TESTS) + """
SELECT target, target_name, feature_set, task, metric_name, round(observed, 6) AS observed, round(p_value, 6) AS p_value,
  cv_folds_used FROM tests"""
