"""The catalog's queries in ANSI SQL, written independently of the Spark code, for comparison on DuckDB."""

from rankarena.fixed_values import (
    BOT_NAMES,
    CONTESTANT_INTRO,
    FINE_TUNE_PROMPT,
    GENERATE_REQUEST,
    GOAL_INTRO,
    INITIAL_DOCUMENT_PROMPT,
    OPPONENTS_INTRO,
    OWN_RANK,
    QUERIES_INTRO,
    REFERENCE_TEXT_INTRO,
    TOP_DOCUMENT,
)
from rankarena.plans.competition import AUTHORS, WIDE_AUTHORS

_WORDS = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}]+')"
_STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _filled(template: str, *values: str) -> str:
    """A ``%`` template as a concatenation."""
    parts = template.replace("%d", "%s").split("%s")
    pieces = [_quoted(parts[0])]
    for value, part in zip(values, parts[1:], strict=True):
        pieces += [value, _quoted(part)]
    return "concat(" + ", ".join(pieces) + ")"


def _competition(authors: int = AUTHORS) -> str:
    return rf"""
topics AS (
  SELECT item_id, printf('%03d', item_id) AS query_id,
         regexp_replace({_STRIP.format('text')}, '\s+', ' ', 'g') AS query
  FROM benchmark),
dealt AS (
  SELECT d.doc_id, d.text, d.n_chars, l.quality, l.toxic,
         d.doc_id % (SELECT count(*) FROM benchmark) AS q,
         (d.doc_id // (SELECT count(*) FROM benchmark)) % {authors} AS a,
         (d.doc_id // (SELECT count(*) FROM benchmark)) // {authors} AS r
  FROM documents d LEFT JOIN labels l USING (doc_id)),
comp AS (
  SELECT doc_id, printf('ROUND-%02d-%03d-%02d', r, q, a) AS docno, r::INTEGER AS round_number,
         printf('%03d', q) AS query_id, printf('%02d', a) AS author_id, topics.query, dealt.text,
         coalesce(quality, 0)::INTEGER AS qrel,
         (CASE WHEN toxic = 1 THEN 3 ELSE coalesce(quality, 2) END)::INTEGER AS ksrel,
         (row_number() OVER (PARTITION BY r, q ORDER BY n_chars DESC, doc_id))::INTEGER AS pos
  FROM dealt JOIN topics ON topics.item_id = q)"""


COMP = _competition()
WIDE = _competition(WIDE_AUTHORS)
_TABLE = "docno, round_number, query_id, author_id, query, text, qrel, ksrel, pos"


def _deltas() -> str:
    look_back = ", ".join(
        f"coalesce(min(pos) OVER (PARTITION BY query_id, author_id ORDER BY round_number "
        f"RANGE BETWEEN {k} PRECEDING AND {k} PRECEDING) - pos, 0)::INTEGER AS {name}"
        for k, name in ((1, "delta"), (2, "delta_2"), (3, "delta_3"))
    )
    return f"{COMP}, moved AS (SELECT {_TABLE}, {look_back} FROM comp)"


_DELTA_TABLE = _TABLE + ", delta, delta_2, delta_3"


def _improvement_pairs() -> str:
    return rf"""
WITH {_deltas()},
paired AS (
  SELECT m.*, p.text AS completion
  FROM moved m JOIN moved p ON p.query_id = m.query_id AND p.author_id = m.author_id
       AND p.round_number = m.round_number - 1
  WHERE (m.delta > 0 OR m.delta_2 > 0 OR m.delta_3 > 0) AND m.ksrel <> 3),
kept AS (
  SELECT * FROM paired
  QUALIFY row_number() OVER (PARTITION BY text, completion ORDER BY delta DESC, docno) = 1)
SELECT * REPLACE (replace(text, '\', '') AS text),
       {_filled(FINE_TUNE_PROMPT, "query", "replace(text, chr(92), '')")} AS prompt
FROM kept"""


def _improvement_pairs_match_lag() -> str:
    branches = " UNION ALL ".join(
        f"SELECT m.*, p.text AS completion FROM moved m JOIN moved p ON p.query_id = m.query_id "
        f"AND p.author_id = m.author_id AND p.round_number = m.round_number - {k} "
        f"WHERE m.{name} > 0 AND m.ksrel <> 3"
        for k, name in ((1, "delta"), (2, "delta_2"), (3, "delta_3"))
    )
    return rf"""
WITH {_deltas()}, paired AS ({branches}),
kept AS (
  SELECT * REPLACE (replace(text, '\', '') AS text, replace(query, '\', '') AS query,
                    replace(completion, '\', '') AS completion)
  FROM (SELECT * FROM paired
        QUALIFY row_number() OVER (PARTITION BY text, completion ORDER BY delta DESC, docno) = 1))
SELECT *, {_filled(FINE_TUNE_PROMPT, "query", "text")} AS prompt FROM kept"""


def _top_pairs(comp: str, eligible: str, swapped: bool) -> str:
    better, worse = "replace(text, chr(92), '')", "completion"
    text, completion = (worse, better) if swapped else (better, worse)
    return rf"""
WITH {comp},
eligible AS (SELECT {_TABLE} FROM comp WHERE ({eligible}) AND ksrel <> 3),
lower_text AS (
  SELECT query_id, round_number, text AS completion FROM eligible WHERE pos > 1
  QUALIFY row_number() OVER (PARTITION BY query_id, round_number ORDER BY pos, docno) = 1),
paired AS (SELECT e.*, t.completion FROM eligible e JOIN lower_text t USING (query_id, round_number) WHERE pos = 1),
kept AS (
  SELECT * FROM paired
  QUALIFY row_number() OVER (PARTITION BY text, completion
                             ORDER BY query_id DESC, round_number DESC, docno DESC) = 1)
SELECT * REPLACE ({text} AS text, {completion} AS completion),
       {_filled(FINE_TUNE_PROMPT, "query", text)} AS prompt
FROM kept"""


_PLACES = "SELECT DISTINCT query_id, author_id, round_number FROM comp"

_DROPPED_PAIRS = rf"""
WITH {_deltas()}, places AS ({_PLACES}),
improved AS (
  SELECT m.*, p.query_id IS NULL AS dropped
  FROM moved m LEFT JOIN places p ON p.query_id = m.query_id AND p.author_id = m.author_id AND p.round_number = m.round_number - 1
  WHERE (m.delta > 0 OR m.delta_2 > 0 OR m.delta_3 > 0) AND m.ksrel <> 3),
eligible AS (SELECT * FROM comp WHERE pos <= 4 AND ksrel <> 3),
lower_text AS (SELECT DISTINCT query_id, round_number, true AS found FROM eligible WHERE pos > 1),
winners AS (SELECT found IS NULL AS dropped FROM eligible LEFT JOIN lower_text USING (query_id, round_number) WHERE pos = 1)
SELECT 'improvements' AS pairs, count(*) AS rows, count(*) FILTER (dropped) AS dropped FROM improved
UNION ALL
SELECT 'improvements_by_lag', coalesce(sum((delta > 0)::INT + (delta_2 > 0)::INT + (delta_3 > 0)::INT), 0)::BIGINT, 0 FROM improved
UNION ALL
SELECT 'tops', count(*), count(*) FILTER (dropped) FROM winners"""


def _features(docs: str, topics: str = "topics") -> str:
    """CTEs up to ``feats``; ``docs`` selects ``docno, query_id, s, text`` with the scope in ``s``."""
    five = lambda v: (
        f"sum({v}), min({v}), max({v}), avg({v}), var_pop({v})"
    )
    named = []
    for first, value in ((5, "tf"), (10, "ntf"), (15, "tf * idf")):
        named += [f"{v.strip()} AS f{first + i}" for i, v in enumerate(five(value + "::DOUBLE").split(", "))]
    return rf"""
docs AS ({docs}),
toks AS (SELECT docno, s, {_WORDS.format('text')} AS ts FROM docs),
dlen AS (SELECT docno, s, len(ts) AS dl, len(list_distinct(ts)) AS u FROM toks),
post AS (SELECT docno, s, term, count(*) AS tf FROM (SELECT docno, s, unnest(ts) AS term FROM toks) GROUP BY ALL),
tot AS (SELECT s, count(*)::DOUBLE AS n, sum(dl)::DOUBLE AS c FROM dlen GROUP BY s),
st AS (SELECT post.s, term, count(*) AS df, sum(tf) AS cf, ln(any_value(n) / count(*)) AS idf
       FROM post JOIN tot USING (s) GROUP BY post.s, term),
qt AS (SELECT DISTINCT query_id, unnest({_WORDS.format('query')}) AS term FROM {topics}),
norm AS (SELECT post.docno, sqrt(sum((tf * idf) ** 2)) AS norm FROM post JOIN st USING (s, term) GROUP BY post.docno),
hits AS (
  SELECT d.docno, d.query_id, dl::DOUBLE AS dl, u::DOUBLE AS u, n, c, coalesce(tf, 0)::DOUBLE AS tf,
         CASE WHEN dl > 0 THEN coalesce(tf, 0) / dl::DOUBLE ELSE 0 END AS ntf,
         coalesce(df, 0)::DOUBLE AS df, coalesce(cf, 0)::DOUBLE AS cf, coalesce(idf, 0) AS idf
  FROM docs d JOIN dlen USING (docno) JOIN tot ON tot.s = d.s JOIN qt USING (query_id)
       LEFT JOIN post ON post.docno = d.docno AND post.term = qt.term
       LEFT JOIN st ON st.s = d.s AND st.term = qt.term),
feats AS (
  SELECT docno, query_id,
         sum((tf > 0)::INTEGER)::DOUBLE AS f1, avg((tf > 0)::INTEGER) AS f2, max(dl) AS f3, sum(idf) AS f4,
         {", ".join(named)},
         (sum((tf > 0)::INTEGER) = count(*))::INTEGER::DOUBLE AS f20,
         CASE WHEN max(norm) > 0 AND sum(idf * idf) > 0
              THEN sum(tf * idf * idf) / (max(norm) * sqrt(sum(idf * idf))) ELSE 0 END AS f21,
         sum(CASE WHEN dl > 0 THEN ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2
             / (tf + 1.2 * (0.25 + 0.75 * dl / (c / n))) ELSE 0 END) AS f22,
         sum(CASE WHEN dl > 0 AND cf > 0
             THEN ln(greatest(tf - 0.7, 0) / dl + 0.7 * u / dl * cf / c) ELSE 0 END) AS f23,
         sum(CASE WHEN dl > 0 AND cf > 0 THEN ln((tf + 2500 * cf / c) / (dl + 2500)) ELSE 0 END) AS f24,
         sum(CASE WHEN dl > 0 AND cf > 0 THEN ln(0.3 * tf / dl + 0.7 * cf / c) ELSE 0 END) AS f25
  FROM hits LEFT JOIN norm USING (docno) GROUP BY docno, query_id)"""


_CORPUS_DOCS = "SELECT docno, query_id, 1 AS s, text FROM comp"
_FIELD_DOCS = "SELECT docno, query_id, query_id || '/' || round_number AS s, text FROM comp"

_NEURAL = """
neural AS (
  SELECT docno, query_id, round_number, list_inner_product(d.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS score
  FROM comp
  JOIN embeddings d ON d.vec_id = comp.doc_id % (SELECT count(*) FROM embeddings)
  JOIN embeddings q ON q.vec_id = comp.query_id::BIGINT % (SELECT count(*) FROM embeddings)),
scaled AS (
  SELECT docno, query_id, round_number,
         CASE WHEN max(score) OVER w = min(score) OVER w THEN 0
              ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS f26
  FROM neural WINDOW w AS ({0}))"""
_NEURAL_CORPUS = _NEURAL.format("")
_NEURAL_FIELD = _NEURAL.format("PARTITION BY query_id, round_number")

_F = [f"f{i}" for i in range(1, 27)]
# Rounding to twelve digits first takes off the noise of the summation order, which decides exact halves.
_ROUNDED = ", ".join(f"round(round({f}, 12), 6) + 0.0 AS {f}" for f in _F)

_TREES = """
(CASE WHEN f22 <= 4.5 THEN (CASE WHEN f3 <= 60.5 THEN -0.5 ELSE 0.125 END)
      ELSE (CASE WHEN f26 <= 0.55 THEN 0.75 ELSE 1.25 END) END
 + CASE WHEN f1 <= 2.5 THEN -0.25 ELSE (CASE WHEN f26 <= 0.35 THEN 0.0625 ELSE 0.5 END) END
 + CASE WHEN f3 <= 300.5 THEN 0.03125 ELSE (CASE WHEN f7 <= 3.5 THEN -0.125 ELSE 0.25 END) END)::DOUBLE"""


def _history(bot: str) -> str:
    return f"""
history AS (
  SELECT query_id, round_number + 1 AS epoch, CASE WHEN author_id = '00' THEN '{bot}' ELSE author_id END AS author_id,
         text, pos AS rank FROM comp),
refs AS (
  SELECT query_id, query, text AS reference_text FROM comp
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round_number, docno) = 1)"""


_SUFFIX = "CASE {0} WHEN 1 THEN 'st' WHEN 2 THEN 'nd' WHEN 3 THEN 'rd' ELSE 'th' END"
# Test texts hold no control characters but line breaks.
_LITERAL = (
    r"replace(replace(replace(CASE WHEN contains({0}, '''') AND contains({0}, '\"') "
    r"THEN replace(replace({0}, '\', '\\'), '''', '\') ELSE replace(replace({0}, '\', '\\'), '''', '') END, "
    r"'\"', ''), chr(10), '\n'), chr(9), '\t')"
).replace('\\"', '"')


def _prompt_rows(bot_type: str, bot: str, markov: bool, epoch: int | str | None) -> str:
    per_epoch = 3 if bot_type == "self" else 4
    first = "(target - 1)" if markov else "1"
    rows = [
        "SELECT query_id, target, start AS seq, 0 AS part, 'assistant' AS role, text AS content FROM own",
        f"SELECT query_id, target, start + 1, 0, 'system', {_filled(OWN_RANK, 'rank', _SUFFIX.format('rank'))} FROM own",
        f"SELECT query_id, target, start + {per_epoch - 1}, 0, 'user', {_quoted(GENERATE_REQUEST)} FROM own",
        f"SELECT query_id, target, 0, 0, 'system', {_quoted(CONTESTANT_INTRO)} FROM refs, targets",
        f"SELECT query_id, target, 1, 0, 'system', {_filled(QUERIES_INTRO, '1', 'query')} FROM refs, targets",
        f"SELECT query_id, target, 2, 0, 'system', {_quoted(GOAL_INTRO)} FROM refs, targets",
        f"SELECT query_id, target, 3, 0, 'system', {_filled(REFERENCE_TEXT_INTRO, 'reference_text')} FROM refs, targets",
        f"SELECT query_id, target, 4, 0, 'user', {_quoted(GENERATE_REQUEST)} FROM refs, targets",
    ]
    if bot_type == "tops":
        rows.append(
            f"SELECT query_id, target, start + 2, 0, 'system', {_filled(TOP_DOCUMENT, 'text')} FROM past WHERE rank = 1"
        )
    if bot_type == "all":
        opening = _quoted(OPPONENTS_INTRO).replace("\n", "' || chr(10) || '")
        rows += [
            f"SELECT query_id, target, start + 2, 0, 'system', {opening} || '{{' FROM own",
            "SELECT query_id, target, start + 2, 2147483647, 'system', '}' FROM own",
            "SELECT query_id, target, start + 2, 3, 'system', ', ' FROM own WHERE rank > 2",
            "SELECT query_id, target, start + 2, 2 * rank, 'system', "
            f"CASE WHEN rank > 2 THEN ', ' ELSE '' END || 'ranked ' || rank || ': ' || {_LITERAL.format('text')} "
            rf"|| '\n\n' FROM past WHERE author_id <> '{bot}'",
        ]
    if epoch == "every":
        targets = "SELECT unnest(range(1, (SELECT max(epoch) + 2 FROM history))) AS target"
    elif epoch is None:
        targets = "SELECT max(epoch) + 1 AS target FROM history"
    else:
        targets = f"SELECT {epoch} AS target"
    return f"""
{_history(bot)},
targets AS ({targets}),
staged AS (SELECT * FROM history, targets),
past AS (SELECT *, 5 + (epoch - {first}) * {per_epoch} AS start FROM staged
         WHERE epoch >= {first} AND epoch < target),
own AS (SELECT * FROM past WHERE author_id = '{bot}'),
message_rows AS ({" UNION ALL ".join(rows)}),
prompt_rows AS (
  SELECT query_id, '{bot}' AS bot, target::INTEGER AS epoch, seq::INTEGER AS seq, part::INTEGER AS part,
         role, content FROM message_rows)"""


def _history_prompts(bot_type: str, bot: str, markov: bool = False, epoch: int | str | None = None) -> str:
    return f"WITH {COMP}, {_prompt_rows(bot_type, bot, markov, epoch)} SELECT * FROM prompt_rows"


def _max_tokens(tokens: str) -> str:
    return f"(700 - 50 * ceil(greatest({tokens} + 900 - 4096, 0) / 50.0))::BIGINT"


_TOPIC_ROWS = """
topic_rows AS (
  SELECT doc_id::VARCHAR AS topic_id, source AS topic_title, '''' || source || '''' AS q1, lang AS q2,
         lang || ' ' || source AS q3, 'A ''' || source || ''' text' AS description,
         replace(text, '"', '''') AS backstory
  FROM documents)"""
_TOPIC_PROMPT = _filled(INITIAL_DOCUMENT_PROMPT, "q1", "q2", "q3", "backstory")

_BUDGETS = f"""
budgets AS (
  SELECT query_id, bot, epoch, sum(ceil(length(content) / 4.0))::BIGINT AS prompt_tokens,
         {_max_tokens("sum(ceil(length(content) / 4.0))")} AS max_tokens
  FROM prompt_rows GROUP BY ALL)"""

_EPOCH_STEP = f"""
WITH {COMP},
accepted AS (
  SELECT printf('%03d', conv_id % (SELECT count(*) FROM benchmark)) AS query_id,
         (conv_id // (SELECT count(*) FROM benchmark))::INTEGER AS epoch, 'BOT' || conv_id || '.' || turn AS bot, text
  FROM conversations WHERE role = 'assistant' AND len(regexp_extract_all(text, '\\S+')) <= 150),
members AS (
  SELECT c.query_id, c.round_number AS epoch, a.bot, c.author_id, c.text
  FROM comp c JOIN accepted a ON a.query_id = c.query_id AND a.epoch = c.round_number
  UNION ALL SELECT query_id, epoch, bot, bot, text FROM accepted),
named AS (SELECT *, query_id || '/' || epoch || '/' || bot AS s FROM members),
shares AS (
  SELECT s, author_id, query || text AS pair,
         (length(pair) - length(regexp_replace(pair, '[aeiou]', '', 'g')))::DOUBLE / length(pair) AS x
  FROM named JOIN topics USING (query_id)),
logs AS (SELECT s, author_id, x - ln(1 + exp(x)) AS score FROM shares),
scaled AS (
  SELECT s || '/' || author_id AS docno,
         coalesce((score - min(score) OVER w) / nullif(max(score) OVER w - min(score) OVER w, 0), 0) AS f26
  FROM logs WINDOW w AS (PARTITION BY s)),
{_features("SELECT s || '/' || author_id AS docno, query_id, s, text FROM named")}
SELECT query_id, epoch, bot, author_id, text,
       (row_number() OVER (PARTITION BY n.s ORDER BY {_TREES} DESC, author_id))::INTEGER AS rank
FROM named n JOIN (SELECT * EXCLUDE (query_id) FROM feats) feats ON feats.docno = n.s || '/' || author_id
JOIN scaled ON scaled.docno = feats.docno"""


_ENSEMBLE_SCORES = f"""
WITH {COMP}, {_features(_CORPUS_DOCS)}, {_NEURAL_CORPUS}
SELECT feats.query_id, docno, {_TREES} AS score FROM feats JOIN scaled USING (docno)"""


SQL: dict[str, str] = {
    "decode_docno": f"WITH {COMP} SELECT docno, round_number, query_id, author_id FROM comp",
    "canonical_ids": """
SELECT o_orderkey,
       CASE WHEN o_custkey < 1000 THEN lpad(o_custkey::VARCHAR, 3, '0') ELSE o_custkey::VARCHAR END AS query_id,
       CASE WHEN length(o_custkey::VARCHAR) < length(o_orderkey::VARCHAR)
            THEN lpad(o_custkey::VARCHAR, length(o_orderkey::VARCHAR)::INTEGER, '0')
            ELSE o_custkey::VARCHAR END AS filled,
       'ROUND-01-' || o_custkey || '-' || o_orderkey AS docno,
       o_orderkey::VARCHAR AS author, o_orderkey::VARCHAR AS doc_id
FROM orders""",
    "word_limit": r"""
SELECT conv_id, turn, len(regexp_extract_all(text, '\S+'))::INTEGER AS words,
       len(regexp_extract_all(text, '\S+')) <= 150 AS accepted
FROM conversations WHERE role = 'assistant'""",
    "clean_text": rf"""
SELECT doc_id, {_STRIP.format("text")} AS stripped,
       replace(replace(text, '&', '&amp;'), '<', '&lt;') AS escaped,
       replace(replace(text, '\', ''), '"', '''') AS requoted, {_LITERAL.format("text")} AS literal
FROM documents""",
    "rank_words": f"WITH {WIDE} SELECT docno, pos || {_SUFFIX.format('pos')} AS place FROM comp",
    "bot_names": f"""
WITH {COMP}
SELECT docno, (CASE WHEN qrel = 1 THEN 'M' ELSE 'NM' END)
       || (CASE pos WHEN 1 THEN 'T' WHEN 2 THEN 'S' ELSE 'A' END) || 'BOT' AS bot
FROM comp""",
    "log_softmax": """
SELECT vec_id,
       round(round(embedding[-1]::DOUBLE - ln(list_sum(list_transform(embedding::DOUBLE[], lambda x: exp(x)))), 12), 6)
         + 0.0 AS score,
       round(round(embedding[1]::DOUBLE, 12), 6) + 0.0 AS single
FROM embeddings""",
    "minmax_normalise": """
SELECT o_orderkey, o_custkey,
       round(round(
         CASE WHEN max(o_totalprice) OVER c = min(o_totalprice) OVER c THEN 0
              ELSE (o_totalprice - min(o_totalprice) OVER c) / (max(o_totalprice) OVER c - min(o_totalprice) OVER c)
              END, 12), 6) + 0.0 AS score,
       round(round(
         (o_totalprice - min(o_totalprice) OVER ()) / (max(o_totalprice) OVER () - min(o_totalprice) OVER ()), 12), 6)
         + 0.0 AS overall
FROM orders WINDOW c AS (PARTITION BY o_custkey)""",
    "token_budget": f"""
SELECT doc_id, {_max_tokens("ceil(length(text) / 4.0)")} AS max_tokens,
       {_max_tokens("ceil(length(text) / 4.0)")} <= 0 AS skipped
FROM documents""",
    "trectext_roundtrip": f"WITH {COMP} SELECT docno, {_STRIP.format('text')} AS text FROM comp",
    "assemble_corpus": f"WITH {COMP} SELECT {_TABLE.replace('text', _STRIP.format('text') + ' AS text')} FROM comp",
    "qrels_roundtrip": f"WITH {COMP} SELECT query_id, docno, qrel AS rel FROM comp",
    "run_roundtrip": f"""
WITH {COMP}, placed AS (
  SELECT query_id, docno, (row_number() OVER (PARTITION BY query_id ORDER BY docno))::INTEGER AS place FROM comp)
SELECT query_id, 'Q0' AS q0, docno, place AS rank, -place::DOUBLE AS score, 'indri' AS run_id FROM placed""",
    "svmlight_roundtrip": f"""
WITH {COMP}, {_features(_CORPUS_DOCS)}, {_NEURAL_CORPUS}
SELECT feats.query_id, docno, 0.0::DOUBLE AS label, {_ROUNDED} FROM feats JOIN scaled USING (docno)""",
    "csv_roundtrip": f"WITH {COMP} SELECT {_TABLE} FROM comp",
    "csv_improvements": _improvement_pairs(),
    "csv_tops": _top_pairs(COMP, "pos <= 4", swapped=False),
    "epoch_json_roundtrip": f"""
WITH {COMP}, bots AS (SELECT unnest(['NMABOT', 'NMTBOT']) AS bot)
SELECT query_id, round_number + 1 AS epoch, bot, CASE WHEN author_id = '00' THEN bot ELSE author_id END AS author_id,
       text, pos AS rank
FROM comp, bots""",
    "epoch_map_files_roundtrip": f"""
WITH {COMP}
SELECT query_id, round_number + 1 AS epoch, 'NMABOT' AS bot, CASE WHEN author_id = '00' THEN 'NMABOT' ELSE author_id END AS author_id,
       text, pos AS rank
FROM comp""",
    "generated_documents": r"""
SELECT doc_id::VARCHAR AS topic_id, source AS topic_title, CASE WHEN accepted THEN text END AS doc, accepted
FROM (SELECT *, coalesce(len(regexp_extract_all(text, '\S+')) <= 150, false) AS accepted FROM documents)""",
    "topics_roundtrip": f"""
WITH {_TOPIC_ROWS}
SELECT topic_id, topic_title, q1 || '|' || q2 || '|' || q3 AS queries, description, backstory FROM topic_rows""",
    "queries_xml_rows": f"""
WITH {COMP}
SELECT query_id, '<query>' || chr(10) || '<number>' || query_id || '</number>' || chr(10) || '<text>#combine( '
       || replace(replace(query, '&', '&amp;'), '<', '&lt;') || ' )</text>' || chr(10) || '</query>' AS value
FROM topics""",
    "query_docnos": f"""
WITH {COMP}
SELECT docno, query_id, (row_number() OVER (PARTITION BY query_id ORDER BY docno))::INTEGER AS place FROM comp""",
    "working_set": f"""
WITH {COMP}, placed AS (
  SELECT query_id, docno, row_number() OVER (PARTITION BY query_id ORDER BY docno) AS place FROM comp)
SELECT query_id || ' Q0 ' || docno || ' ' || place || ' -' || place || ' indri' AS value FROM placed""",
    "last_round_field": f"""
WITH {COMP}
SELECT query_id, round_number, author_id, text FROM comp WHERE round_number = (SELECT max(round_number) FROM comp)""",
    "reference_texts": f"""
WITH {COMP}
SELECT query_id, query, docno, text AS reference_text FROM comp
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round_number, docno) = 1""",
    "winners": f"WITH {COMP} SELECT query_id, round_number, author_id, docno FROM comp WHERE pos = 1",
    "contested_fields": f"""
WITH {COMP}
SELECT query_id, round_number, docno FROM comp QUALIFY count(*) OVER (PARTITION BY query_id, round_number) > 1""",
    "field_sizes": f"""
WITH {COMP} SELECT query_id, round_number, count(*) AS members FROM comp GROUP BY ALL""",
    "query_index": f"WITH {COMP} SELECT DISTINCT query_id, query FROM comp",
    "participants": f"WITH {COMP} SELECT DISTINCT author_id, query_id FROM comp",
    "rank_deltas": f"WITH {_deltas()} SELECT docno, pos, delta, delta_2, delta_3 FROM moved",
    "trajectories": f"""
WITH {_deltas()} SELECT author_id, query_id, round_number, delta, pos, qrel, ksrel FROM moved""",
    "trajectory_spans": f"""
WITH {COMP}
SELECT author_id, query_id, min(round_number) AS first_round, max(round_number) AS last_round, count(*) AS entries
FROM comp GROUP BY ALL""",
    "improvement_pairs": _improvement_pairs(),
    "improvement_pairs_match_lag": _improvement_pairs_match_lag(),
    "dropped_pairs": _DROPPED_PAIRS,
    "top_pairs": _top_pairs(COMP, "pos <= 4", swapped=False),
    "top_pairs_legacy": _top_pairs(WIDE, "regexp_matches(pos::VARCHAR, '1|2|3|4')", swapped=True),
    "finetune_prompts": f"""
WITH {COMP} SELECT docno, {_filled(FINE_TUNE_PROMPT, "query", "replace(text, chr(92), '')")} AS prompt FROM comp""",
    "near_top_legacy": f"""
WITH {WIDE} SELECT docno, pos, ksrel FROM comp WHERE regexp_matches(pos::VARCHAR, '1|2|3|4') AND ksrel <> 3""",
    "doc_lengths": f"""
WITH {COMP}, {_features(_CORPUS_DOCS)} SELECT docno, dl::BIGINT AS dl, u::BIGINT AS unique_terms FROM dlen""",
    "term_stats": f"""
WITH {COMP}, {_features(_CORPUS_DOCS)}
SELECT term, df, cf::BIGINT AS cf, round(round(idf, 12), 6) + 0.0 AS idf FROM st""",
    "scoped_term_stats": f"""
WITH {COMP}, {_features(_FIELD_DOCS)}
SELECT split_part(s, '/', 1) AS query_id, split_part(s, '/', 2)::INTEGER AS round_number, term, df,
       cf::BIGINT AS cf, round(round(idf, 12), 6) + 0.0 AS idf
FROM st""",
    "ltr_features_corpus": f"""
WITH {COMP}, {_features(_CORPUS_DOCS)}, {_NEURAL_CORPUS}
SELECT feats.query_id, docno, {_ROUNDED} FROM feats JOIN scaled USING (docno)""",
    "ltr_features_field": f"""
WITH {COMP}, {_features(_FIELD_DOCS)}, {_NEURAL_FIELD}
SELECT feats.query_id, round_number, docno, {_ROUNDED} FROM feats JOIN scaled USING (docno)""",
    "ltr_train_rows": f"""
WITH {COMP}, {_features(_CORPUS_DOCS)}, {_NEURAL_CORPUS}
SELECT concat_ws(' ', qrel, 'qid:' || feats.query_id,
       {", ".join(f"'{f[1:]}:' || printf('%.6f', round(round({f}, 12), 6) + 0.0)" for f in _F)}) || ' #' || feats.docno AS value
FROM feats JOIN scaled USING (docno) JOIN comp USING (docno)""",
    "neural_feature": f"""
WITH {COMP}, {_NEURAL_FIELD} SELECT docno, query_id, round_number, round(round(f26, 12), 6) + 0.0 AS score FROM scaled""",
    "ensemble_scores": _ENSEMBLE_SCORES,
    "ensemble_scores_arrays": _ENSEMBLE_SCORES,
    "ensemble_scores_joins": _ENSEMBLE_SCORES,
    "ensemble_scores_blocks": _ENSEMBLE_SCORES,
    "neural_scores": f"""
WITH {COMP}, shares AS (
  SELECT docno, (length(query || text) - length(regexp_replace(query || text, '[aeiou]', '', 'g')))::DOUBLE
         / length(query || text) AS x
  FROM comp)
SELECT docno, round(round(x - ln(1 + exp(x)), 12), 6) + 0.0 AS score FROM shares""",
    "rank_fields": f"""
WITH {COMP}, {_features(_FIELD_DOCS)}, {_NEURAL_FIELD}
SELECT feats.query_id, round_number, docno, {_TREES} AS score,
       (row_number() OVER (PARTITION BY feats.query_id, round_number ORDER BY {_TREES} DESC, docno))::INTEGER AS rank
FROM feats JOIN scaled USING (docno)""",
    "epoch_step": _EPOCH_STEP,
    "opponents": f"""
WITH {COMP}
SELECT query_id, round_number + 1 AS epoch, author_id, pos AS rank FROM comp WHERE author_id <> '00'""",
    "history_prompts_all": _history_prompts("all", "NMABOT"),
    "history_prompts_tops": _history_prompts("tops", "NMTBOT"),
    "history_prompts_self": _history_prompts("self", "NMSBOT"),
    "history_prompts_all_markov": _history_prompts("all", "MABOT", True, "every"),
    "history_prompts_tops_markov": _history_prompts("tops", "MTBOT", True, "every"),
    "history_prompts_self_markov": _history_prompts("self", "MSBOT", True, "every"),
    "history_prompts_every": f"WITH {COMP} "
    + " UNION ALL ".join(
        f"SELECT * FROM (WITH {_prompt_rows(kind, bot, markov, 'every')} SELECT * FROM prompt_rows)"
        for (markov, kind), bot in BOT_NAMES.items()
    ),
    "prompt_budgets": f"""
WITH {COMP}, {_prompt_rows("all", "MABOT", True, "every")}, {_BUDGETS}
SELECT query_id, bot, epoch, prompt_tokens, max_tokens, max_tokens <= 0 AS skipped FROM budgets""",
    "sendable_prompts": f"""
WITH {COMP}, {_prompt_rows("all", "MABOT", True, "every")}, {_BUDGETS},
messages AS (
  SELECT query_id, bot, epoch, seq, role, string_agg(content, '' ORDER BY part) AS content
  FROM prompt_rows GROUP BY ALL)
SELECT query_id, bot, epoch, max_tokens, max_tokens <= 0 AS skipped,
       CASE WHEN max_tokens > 0 THEN string_agg(role || ': ' || content, chr(10) ORDER BY seq) END AS conversation
FROM messages JOIN budgets USING (query_id, bot, epoch) GROUP BY query_id, bot, epoch, max_tokens""",
    "initial_prompts": f"""
WITH {_TOPIC_ROWS} SELECT topic_id, description, {_TOPIC_PROMPT} AS prompt FROM topic_rows""",
    "resume_anti_join": f"""
WITH {_TOPIC_ROWS} SELECT topic_id, {_TOPIC_PROMPT} AS prompt FROM topic_rows
WHERE topic_id NOT IN (SELECT doc_id::VARCHAR FROM labels)""",
}

# The same rows, written to a file and read.
SQL["training_file"] = SQL["ltr_train_rows"]
SQL["term_stats_by_rounds"] = SQL["term_stats"]
