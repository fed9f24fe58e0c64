"""DuckDB oracle SQL for the registered queries.

Each oracle is written independently of the Spark code, in plain SQL over
the driver's views (documents, events, conversations, ...): the adapters are
inlined as CTEs, small dimensions and the sample lexicons as VALUES. Window
functions over whole tables are fine here (DuckDB is only the checker).
Doubles are rounded to 4 places, like the Spark side.
"""

from __future__ import annotations

from ..dims import (CATEGORIES, CATEGORY_COMMUNITIES, CATEGORY_KEYWORDS, DAY_NAMES, EMOTIONS,
                    FEATURE_NAMES, FUZZY_CUTOFF, FUZZY_MIN_LEN, RANGE_FEATURES, SHOWCASE_SIGNALS)
from ..operators.textfeat import NEG_SCALAR, NEGATIONS, SENT_ALPHA
from ..sources.adapters import SOURCE_COMMUNITIES
from ..sources.lexicons import emotion_rows, sentiment_rows


def _s(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _list(xs) -> str:
    return "[" + ", ".join(_s(x) for x in xs) + "]"


KEYS = "category, has_media, engagement_mechanism"
ALLK = ("CASE WHEN GROUPING(category) = 1 THEN 'ALL' ELSE category END AS category, "
        "CASE WHEN GROUPING(has_media) = 1 THEN 'ALL' ELSE has_media END AS has_media, "
        "CASE WHEN GROUPING(engagement_mechanism) = 1 THEN 'ALL' ELSE engagement_mechanism END "
        "AS engagement_mechanism")
MEMBERS = ("(VALUES (false,false,false),(false,false,true),(false,true,false),(false,true,true),"
           "(true,false,false),(true,false,true),(true,true,false),(true,true,true)) m(a,b,c)")


def _on(a: str, b: str, cols: list[str]) -> str:
    return " AND ".join(f"{a}.{c} IS NOT DISTINCT FROM {b}.{c}" for c in cols)


SEGK = ["category", "has_media", "engagement_mechanism"]
DAYS = _list(DAY_NAMES)


def _labels(src: str, keep: str = "") -> str:
    """The index from its formula: half the scaled log of the score, half the scaled log of the score over
    its community's mean; a log is defined above -1, an undefined or constant term counts as 0."""
    def term(x: str, lo: str, hi: str) -> str:
        return f"coalesce(CASE WHEN {x} > -1 THEN (ln({x} + 1) - ln({lo} + 1)) / nullif(ln({hi} + 1) - ln({lo} + 1), 0) END, 0)"

    columns = "".join(f", p.{c.strip()}" for c in keep.split(",") if c.strip())
    return f"""(SELECT p.post_id, p.subreddit, g.mean AS subreddit_baseline{columns},
    50.0 * {term('p.score', 'x.s0', 'x.s1')} + 50.0 * {term('(p.score / nullif(g.mean, 0))', 'x.q0', 'x.q1')} AS virality_index
  FROM {src} p
  LEFT JOIN (SELECT subreddit, avg(score) AS mean FROM {src} GROUP BY subreddit) g ON p.subreddit IS NOT DISTINCT FROM g.subreddit
  CROSS JOIN (SELECT min(score) FILTER (score > -1) AS s0, max(score) FILTER (score > -1) AS s1,
                     min(q) FILTER (q > -1) AS q0, max(q) FILTER (q > -1) AS q1
              FROM (SELECT a.score, a.score / nullif(b.mean, 0) AS q FROM {src} a
                    JOIN (SELECT subreddit, avg(score) AS mean FROM {src} GROUP BY subreddit) b
                      ON a.subreddit IS NOT DISTINCT FROM b.subreddit)) x)"""


def _words(expr: str) -> str:
    return f"CAST(len(regexp_extract_all(coalesce({expr}, ''), '\\S+')) AS INTEGER)"


# --------------------------------------------------------------------------
# CTEs: name -> (sql, dependencies)
# --------------------------------------------------------------------------
CTES: dict[str, tuple[str, list[str]]] = {}


def cte(name: str, sql: str, deps: list[str] | None = None) -> None:
    CTES[name] = (sql, deps or [])


_IDX = "TRY_CAST(substring(d.source, 4) AS INTEGER)"
cte("raw0", f"""SELECT d.doc_id AS post_id,
  CASE WHEN {_IDX} < {len(SOURCE_COMMUNITIES)} THEN {_list(SOURCE_COMMUNITIES)}[{_IDX} + 1] ELSE d.source END AS subreddit,
  concat(CASE WHEN d.doc_id % 41 = 6 THEN '[deleted] ' ELSE '' END,
         CASE e.event_type WHEN 'click' THEN concat(split_part(d.text, '. ', 1), '?')
                           WHEN 'purchase' THEN concat('[OC] ', split_part(d.text, '. ', 1))
                           ELSE split_part(d.text, '. ', 1) END,
         CASE WHEN length(d.text) > length(split_part(d.text, '. ', 1)) + 2
              THEN concat(': ', substring(d.text, CAST(length(split_part(d.text, '. ', 1)) + 3 AS INTEGER)))
              ELSE '' END) AS text,
  concat(CASE WHEN d.doc_id % 5 = 0 THEN 'https://i.redd.it/' ELSE 'https://example.com/p/' END,
         CAST(d.doc_id AS VARCHAR)) AS url,
  CAST(floor(e.value) AS BIGINT) AS score, e.ts AS date, CAST(e.user_id AS VARCHAR) AS author,
  d.lang AS language
FROM documents d JOIN events e ON d.doc_id = e.event_id""")
cte("raw_posts", f"SELECT *, CAST({_words('text')} AS BIGINT) AS token_count FROM raw0", ["raw0"])
cte("processed_posts", """SELECT post_id, subreddit,
  CASE WHEN strpos(text, ': ') > 0 THEN substring(text, 1, strpos(text, ': ') - 1) ELSE text END AS title,
  CASE WHEN strpos(text, ': ') > 0 THEN substring(text, strpos(text, ': ') + 2) ELSE '' END AS body,
  url, score, author, CAST(date AS TIMESTAMP) AS posted_at_local, token_count
FROM raw_posts WHERE language = 'en'""", ["raw_posts"])
cte("post_features", """SELECT post_id, CAST(hour(posted_at_local) AS INTEGER) AS hour_of_day,
  CAST(dayofweek(posted_at_local) AS INTEGER) AS day_of_week,
  (coalesce(contains(url, 'i.redd.it') OR contains(url, 'imgur'), false)
   OR coalesce(contains(body, 'i.redd.it') OR contains(body, 'imgur'), false)) AS has_media,
  token_count AS post_length_proxy
FROM processed_posts""", ["processed_posts"])
cte("post_labels", "SELECT * FROM " + _labels("processed_posts"), ["processed_posts"])
cte("category_dim", "SELECT * FROM (VALUES " + ", ".join(
    f"({_s(c)}, {_s(c.lower())}, {_s(cat)})" for cat, cs in CATEGORY_COMMUNITIES for c in cs)
    + ") t(community, community_lc, category)")

cte("ev_posts", """SELECT event_id AS post_id, concat('c', CAST(user_id % 48 AS VARCHAR)) AS subreddit,
  CASE WHEN user_id % 48 <> 37 THEN concat('cat', CAST((user_id % 48) % 10 AS VARCHAR)) END AS category,
  CASE event_type WHEN 'click' THEN 'question' WHEN 'purchase' THEN 'showcase' ELSE 'statement' END
    AS engagement_mechanism,
  CASE WHEN event_id % 50 <> 11 THEN event_id % 3 = 0 END AS has_media,
  CASE WHEN event_id % 97 = 5 THEN NULL WHEN event_id % 89 = 7 THEN -1 WHEN event_id % 101 = 3 THEN -5
       ELSE CAST(floor(value) AS BIGINT) END AS score, ts AS posted_at_local
FROM events""")
cte("ev_labelled", "SELECT *, CAST(hour(posted_at_local) AS INTEGER) AS hour_of_day, "
    "CAST(dayofweek(posted_at_local) AS INTEGER) AS day_of_week FROM "
    + _labels("ev_posts", ", category, engagement_mechanism, has_media, score, posted_at_local"), ["ev_posts"])
cte("ev_split", """SELECT * EXCLUDE (rn, n), CASE WHEN rn - 1 < floor(n * 0.7::DOUBLE) THEN 'train'
  WHEN rn - 1 < floor(n * 0.85::DOUBLE) THEN 'val' ELSE 'test' END AS split
FROM (SELECT *, row_number() OVER (ORDER BY posted_at_local NULLS LAST, post_id) AS rn, count(*) OVER () AS n
      FROM ev_labelled)""", ["ev_labelled"])
cte("ev_keyed", """SELECT post_id, category, CASE WHEN has_media THEN 'True' WHEN NOT has_media THEN 'False' END
  AS has_media, engagement_mechanism, subreddit, hour_of_day, day_of_week, virality_index AS y, split,
  posted_at_local
FROM ev_split""", ["ev_split"])


def _cells(where: str = "") -> str:
    return (f"SELECT {ALLK}, subreddit, hour_of_day, day_of_week, count(y) AS n, sum(y) AS sy FROM ev_keyed "
            f"{where} GROUP BY CUBE(category, has_media, engagement_mechanism), subreddit, hour_of_day, "
            f"day_of_week")


cte("cells_all", _cells(), ["ev_keyed"])
cte("comm", f"SELECT {KEYS}, subreddit, sum(sy) / sum(n) AS cm FROM cells_all WHERE n > 0 GROUP BY ALL",
    ["cells_all"])
_CELLON = _on("x", "c", SEGK + ["subreddit"])
cte("pred", f"""SELECT c.category, c.has_media, c.engagement_mechanism, c.subreddit,
  CAST(h.h AS INTEGER) AS hour_of_day, CAST(d.d AS INTEGER) AS day_of_week,
  round(least(greatest((coalesce(x.sy, 0) + 5.0 * c.cm) / (coalesce(x.n, 0) + 5.0), 0.0), 100.0), 9) AS predicted_viral_score
FROM comm c CROSS JOIN range(24) h(h) CROSS JOIN range(7) d(d)
LEFT JOIN cells_all x ON {_CELLON} AND x.hour_of_day = h.h AND x.day_of_week = d.d AND x.n > 0""", ["comm"])

cte("tr_cells", _cells("WHERE split = 'train'"), ["ev_keyed"])
cte("tr_seg", f"SELECT {KEYS}, sum(sy) / sum(n) AS m_seg FROM tr_cells WHERE n > 0 GROUP BY ALL", ["tr_cells"])
cte("tr_com", f"SELECT {KEYS}, subreddit, sum(sy) / sum(n) AS m_com FROM tr_cells WHERE n > 0 GROUP BY ALL",
    ["tr_cells"])
cte("tr_hour", f"SELECT {KEYS}, hour_of_day, sum(sy) / sum(n) AS m_hour FROM tr_cells WHERE n > 0 GROUP BY ALL",
    ["tr_cells"])
cte("tr_day", f"SELECT {KEYS}, day_of_week, sum(sy) / sum(n) AS m_day FROM tr_cells WHERE n > 0 GROUP BY ALL",
    ["tr_cells"])
_MEMSEL = ("CASE WHEN m.a THEN 'ALL' ELSE t.category END AS category, "
           "CASE WHEN m.b THEN 'ALL' ELSE t.has_media END AS has_media, "
           "CASE WHEN m.c THEN 'ALL' ELSE t.engagement_mechanism END AS engagement_mechanism")
cte("test_mem", f"SELECT {_MEMSEL}, t.subreddit, t.hour_of_day, t.day_of_week, t.y FROM ev_keyed t "
    f"CROSS JOIN {MEMBERS} WHERE t.split = 'test'", ["ev_keyed"])


def _j(alias: str, extra: list[str]) -> str:
    return " AND ".join(f"t.{c} IS NOT DISTINCT FROM {alias}.{c}" for c in SEGK + extra)


cte("scored", f"""SELECT t.*, s.m_seg, cm.m_com, hm.m_hour, dm.m_day,
  least(greatest(coalesce((coalesce(c.sy, 0) + 5.0 * cm.m_com) / (coalesce(c.n, 0) + 5.0), s.m_seg), 0.0), 100.0) AS p
FROM test_mem t
LEFT JOIN tr_cells c ON {_j('c', ['subreddit', 'hour_of_day', 'day_of_week'])} AND c.n > 0
LEFT JOIN tr_com cm ON {_j('cm', ['subreddit'])}
LEFT JOIN tr_seg s ON {_j('s', [])}
LEFT JOIN tr_hour hm ON {_j('hm', ['hour_of_day'])}
LEFT JOIN tr_day dm ON {_j('dm', ['day_of_week'])}""", ["test_mem", "tr_cells", "tr_com", "tr_seg", "tr_hour", "tr_day"])
cte("quality", f"""SELECT {KEYS}, count(*) AS n, sum((y - p) * (y - p)) AS sse, var_pop(y) * count(*) AS sst,
  count_if(m_seg IS NULL) AS unfit, avg(abs(coalesce(m_com, m_seg) - m_seg)) AS e_sub,
  avg(abs(coalesce(m_hour, m_seg) - m_seg)) AS e_hour, avg(abs(coalesce(m_day, m_seg) - m_seg)) AS e_day
FROM scored GROUP BY ALL""", ["scored"])
cte("seg_size", f"SELECT {ALLK}, count(*) AS sample_size FROM ev_keyed GROUP BY CUBE({KEYS})", ["ev_keyed"])
_SHAP = {"subreddit": "e_sub", "hour_of_day": "e_hour", "day_of_week": "e_day"}
cte("meta", f"""SELECT z.category, z.has_media, z.engagement_mechanism, CAST(z.sample_size AS BIGINT) AS sample_size,
  CASE WHEN q.unfit = 0 THEN 1 - q.sse / NULLIF(q.sst, 0) END AS test_r2,
  CASE WHEN q.unfit = 0 THEN sqrt(greatest(q.sse, 0) / q.n) END AS test_rmse,
  {", ".join((f"CASE WHEN q.unfit = 0 THEN q.{_SHAP[f]} END" if f in _SHAP else "CAST(NULL AS DOUBLE)")
             + f" AS {f}_shap" for f in FEATURE_NAMES)}
FROM seg_size z LEFT JOIN quality q ON {_on('z', 'q', SEGK)}""", ["seg_size", "quality"])

_RFEATS = [f for f, _ in RANGE_FEATURES]
_RHAVE = ["hour_of_day", "day_of_week"]
cte("yk", "SELECT *, y AS yr FROM ev_keyed", ["ev_keyed"])
cte("thr", f"SELECT {ALLK}, quantile_cont(yr, 0.75) AS thr FROM yk GROUP BY CUBE({KEYS})", ["yk"])
cte("rng_top", f"""SELECT mm.* FROM (SELECT {_MEMSEL}, t.yr, t.hour_of_day, t.day_of_week FROM yk t
  CROSS JOIN {MEMBERS}) mm JOIN thr ON {_on('mm', 'thr', SEGK)} WHERE mm.yr >= thr.thr""", ["yk", "thr"])
cte("ranges", f"""SELECT {KEYS}, {", ".join(
    (f"quantile_cont(CAST({f} AS DOUBLE), {p})" if f in _RHAVE else "CAST(NULL AS DOUBLE)") + f" AS {f}_opt_{b}"
    for f in _RFEATS for b, p in (("min", 0.25), ("max", 0.75)))}
FROM rng_top GROUP BY ALL""", ["rng_top"])

cte("requests", """SELECT event_id AS request_id, concat('cat', CAST((user_id % 48) % 12 AS VARCHAR)) AS category,
  CASE WHEN event_id % 3 = 0 THEN 'True' WHEN event_id % 3 = 1 THEN 'False' END AS post_type,
  CASE event_type WHEN 'click' THEN 'question' WHEN 'purchase' THEN 'showcase' WHEN 'view' THEN 'statement' END
    AS mechanism,
  CASE WHEN user_id % 3 = 0 THEN 'newbie' WHEN user_id % 3 = 1 THEN 'experienced' ELSE 'technical' END AS mode
FROM events""")
cte("req_keys", """SELECT *, coalesce(nullif(post_type, ''), 'ALL') AS pt, coalesce(nullif(mechanism, ''), 'ALL') AS mech
FROM requests""", ["requests"])
cte("text_requests", """SELECT doc_id AS request_id, text FROM documents UNION ALL
SELECT -1 - doc_id AS request_id, CASE doc_id % 11 WHEN 1 THEN text || ' ?'
  WHEN 2 THEN 'just finished this: ' || text WHEN 3 THEN 'meetup near New York ' || text WHEN 4 THEN 'lpatop reciep ' || text
  WHEN 5 THEN '  ' WHEN 7 THEN 'anxeity ' || text END AS text FROM documents WHERE doc_id % 11 BETWEEN 1 AND 7""")
cte("label_rows", """SELECT conv_id, turn, text FROM conversations UNION ALL
SELECT conv_id, -1 - turn AS turn, CASE conv_id % 8 WHEN 0 THEN 'Food & Cooking' WHEN 1 THEN '**gaming**.'
  WHEN 2 THEN 'I think Fitness and health fits' WHEN 3 THEN 'Skincare & Beuty' WHEN 4 THEN 'none' WHEN 5 THEN 'Mental Helath'
  WHEN 6 THEN 'tehc & gadgets' END AS text FROM conversations WHERE conv_id % 8 < 7""")


def _ladder(src: str, table: str, cat: str, pt: str, mech: str) -> str:
    """First match over the 5 levels, for every row of ``src`` (keyed by request_id)."""
    lv = [(cat, pt, mech), (cat, "'ALL'", mech), (cat, pt, "'ALL'"), (cat, "'ALL'", "'ALL'"),
          ("'ALL'", "'ALL'", "'ALL'")]
    parts = []
    for i, (a, b, c) in enumerate(lv):
        parts.append(f"SELECT r.request_id, {i + 1} AS level, x.category AS l_category, x.has_media AS l_has_media, "
                     f"x.engagement_mechanism AS l_mechanism FROM {src} r JOIN (SELECT DISTINCT {KEYS} FROM {table}) x "
                     f"ON x.category = {a} AND x.has_media = {b} AND x.engagement_mechanism = {c}")
    u = " UNION ALL ".join(parts)
    return (f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY level) AS k FROM ({u})) "
            f"WHERE k = 1")


cte("matched", "SELECT * EXCLUDE (k) FROM (" + _ladder("req_keys", "meta", "r.category", "r.pt", "r.mech") + ")",
    ["req_keys", "meta"])

# text features ------------------------------------------------------------
_EMO = emotion_rows()
cte("emo_lex", "SELECT word, " + ", ".join(f"max(CASE WHEN emotion = {_s(e)} THEN 1 ELSE 0 END) AS e_{e}"
                                          for e in EMOTIONS)
    + " FROM (VALUES " + ", ".join(f"({_s(w)}, {_s(e)})" for w, e in _EMO) + ") t(word, emotion) GROUP BY word")
cte("sent_lex", "SELECT word, first(valence) AS valence FROM (VALUES " + ", ".join(
    f"({_s(w)}, {v!r}::DOUBLE)" for w, v in sentiment_rows()) + ") t(word, valence) GROUP BY word")
cte("post_text", """SELECT p.post_id, p.title, p.body, p.subreddit,
  trim(concat_ws(' ', coalesce(p.title, ''), coalesce(p.body, ''))) AS txt
FROM processed_posts p""", ["processed_posts"])
cte("emotions", f"""SELECT post_id, {", ".join(
    f"CASE WHEN txt = '' THEN NULL WHEN nt = 0 THEN 0.0 ELSE coalesce(h_{e}, 0) / nt END AS nrc_{e}"
    for e in EMOTIONS)}
FROM (SELECT t.post_id, t.txt, len(t.tok) AS nt, {", ".join(f"h_{e}" for e in EMOTIONS)}
      FROM (SELECT post_id, txt, regexp_extract_all(lower(txt), '[a-z'']+') AS tok FROM post_text) t
      LEFT JOIN (SELECT u.post_id, {", ".join(f"sum(l.e_{e}) AS h_{e}" for e in EMOTIONS)}
                 FROM (SELECT post_id, unnest(regexp_extract_all(lower(txt), '[a-z'']+')) AS word FROM post_text) u
                 JOIN emo_lex l ON u.word = l.word GROUP BY u.post_id) h ON h.post_id = t.post_id)""",
    ["post_text", "emo_lex"])
cte("sentiment", f"""SELECT t.post_id, CASE WHEN t.txt = '' THEN NULL ELSE
  least(greatest(coalesce(s.s, 0.0) / sqrt(coalesce(s.s, 0.0) * coalesce(s.s, 0.0) + {SENT_ALPHA}), -1.0), 1.0) END
  AS vader_compound
FROM post_text t LEFT JOIN (
  SELECT u.post_id, sum(l.valence * CASE WHEN u.neg THEN {NEG_SCALAR}::DOUBLE ELSE 1.0 END) AS s
  FROM (SELECT post_id, tok[i] AS word,
               list_has_any(tok[greatest(i - 3, 1):i - 1], {_list(NEGATIONS)}) AS neg
        FROM (SELECT post_id, tok, generate_subscripts(tok, 1) AS i
              FROM (SELECT post_id, regexp_extract_all(lower(txt), '[a-z'']+') AS tok FROM post_text))) u
  JOIN sent_lex l ON u.word = l.word GROUP BY u.post_id) s ON s.post_id = t.post_id""",
    ["post_text", "sent_lex"])


def _readability(txt: str) -> str:
    w = f"regexp_extract_all(coalesce({txt}, ''), '\\S+')"
    return (f"CASE WHEN len({w}) > 0 THEN 206.835::DOUBLE - 1.015::DOUBLE * len({w}) / "
            f"greatest(len(regexp_extract_all(coalesce({txt}, ''), '[.!?]+')), 1) - 84.6::DOUBLE * "
            f"list_sum(list_transform({w}, lambda x: greatest(len(regexp_extract_all(lower(x), '[aeiouy]+')), 1))) "
            f"/ len({w}) END")


def _post_mech(title: str, media: str) -> str:
    t = f"coalesce({title}, '')"
    return (f"CASE WHEN contains({t}, '?') THEN 'question' WHEN regexp_matches({t}, '\\[[^\\]]+\\]') "
            f"OR coalesce({media}, false) THEN 'showcase' ELSE 'statement' END")


cte("nlp", f"""SELECT t.post_id, se.vader_compound, {", ".join(f"em.nrc_{e}" for e in EMOTIONS)},
  {_readability('t.txt')} AS readability,
  {_words('t.title')} AS title_length, {_words('t.body')} AS body_length,
  t.subreddit, coalesce(cd.category, 'unknown') AS category, {_post_mech('t.title', 'f.has_media')} AS engagement_mechanism
FROM post_text t JOIN post_features f ON f.post_id = t.post_id
LEFT JOIN category_dim cd ON lower(t.subreddit) = cd.community_lc
LEFT JOIN sentiment se ON se.post_id = t.post_id LEFT JOIN emotions em ON em.post_id = t.post_id""",
    ["post_text", "post_features", "category_dim", "sentiment", "emotions"])
cte("model_ready", """SELECT l.post_id, l.virality_index, f.* EXCLUDE (post_id), z.* EXCLUDE (post_id)
FROM post_labels l LEFT JOIN post_features f ON l.post_id = f.post_id LEFT JOIN nlp z ON l.post_id = z.post_id""",
    ["post_labels", "post_features", "nlp"])

# parsing --------------------------------------------------------------------
_CATS_ORDER: list[str] = []
for _, c in CATEGORY_KEYWORDS:
    if c not in _CATS_ORDER:
        _CATS_ORDER.append(c)


def _kw_category(txt: str) -> str:
    low = f"lower(trim({txt}))"
    items = []
    for cat in _CATS_ORDER:
        kws = [(i, k) for i, (k, c) in enumerate(CATEGORY_KEYWORDS) if c == cat]
        h = " + ".join(f"(CASE WHEN contains({low}, {_s(k)}) THEN 1 ELSE 0 END)" for _, k in kws)
        f = "list_min([" + ", ".join(f"CASE WHEN contains({low}, {_s(k)}) THEN {i} END" for i, k in kws) + "])"
        items.append(f"{{'h': {h}, 'f': {f}, 'c': {_s(cat)}}}")
    arr = "[" + ", ".join(items) + "]"
    return f"(SELECT c FROM (SELECT unnest({arr}, recursive := true)) WHERE h > 0 ORDER BY h DESC, f ASC LIMIT 1)"


cte("kw_cat", f"SELECT request_id, text, {_kw_category('text')} AS category FROM text_requests", ["text_requests"])
cte("kw_dim", "SELECT * FROM (VALUES " + ", ".join(f"({i}, {_s(k)}, {_s(c)})"
                                                   for i, (k, c) in enumerate(CATEGORY_KEYWORDS))
    + ") t(ordinal, keyword, category)")
cte("fz_tok", f"""SELECT request_id, tok[i] AS token, i AS pos FROM (
  SELECT request_id, tok, generate_subscripts(tok, 1) AS i FROM (
    SELECT request_id, regexp_extract_all(lower(trim(text)), '[a-z]+') AS tok FROM kw_cat
    WHERE category IS NULL AND trim(text) <> '')) WHERE length(tok[i]) >= {FUZZY_MIN_LEN}""", ["kw_cat"])


def _blocks(a: str, b: str) -> str:
    """The longest common block of two strings, the earliest in ``a``, then in ``b``: {k, i, j}, i and j negated."""
    same = f"substr({a}, CAST(p // length({b}) AS BIGINT) + 1, q) = substr({b}, CAST(p % length({b}) AS BIGINT) + 1, q)"
    fits = f"q <= length({a}) - p // length({b}) AND q <= length({b}) - p % length({b})"
    return (f"list_max(list_transform(range(length({a}) * length({b})), lambda p: {{'k': len(list_filter("
            f"range(1, least(length({a}), length({b})) + 1), lambda q: {fits} AND {same})), "
            f"'i': -(p // length({b})), 'j': -(p % length({b}))}}))")


def ratio_ctes(name: str, pairs: str, deps: list[str]) -> None:
    """``name``: a, b, ratio for the pairs (a, b): twice the letters in matching blocks over all letters. Blocks
    are found by splitting left and right of the longest one."""
    limit = f"levenshtein(a, b) <= {round(1 - FUZZY_CUTOFF, 9)}::DOUBLE * (length(a) + length(b)) + 1e-9"
    cte(f"{name}_pairs", f"SELECT DISTINCT a, b FROM ({pairs}) WHERE a <> '' AND b <> '' AND "
        f"2 * least(length(a), length(b)) >= {FUZZY_CUTOFF}::DOUBLE * (length(a) + length(b)) - 1e-9 AND {limit}", deps)
    cte(f"{name}_blocks", f"""SELECT * FROM (WITH RECURSIVE m AS (
    SELECT a, b, a AS x, b AS y, {_blocks('a', 'b')} AS t FROM {name}_pairs
    UNION ALL
    SELECT a, b, x, y, {_blocks('x', 'y')} AS t FROM (
      SELECT a, b, unnest([{{'x': substr(x, 1, -t.i), 'y': substr(y, 1, -t.j)}},
                           {{'x': substr(x, -t.i + t.k + 1), 'y': substr(y, -t.j + t.k + 1)}}], recursive := true)
      FROM m WHERE t.k > 0) WHERE x <> '' AND y <> '') SELECT a, b, t.k AS k FROM m)""", [f"{name}_pairs"])
    cte(name, f"SELECT a, b, 2.0::DOUBLE * sum(k) / (length(a) + length(b)) AS ratio FROM {name}_blocks GROUP BY a, b",
        [f"{name}_blocks"])


ratio_ctes("fz_ratio", "SELECT k.keyword AS a, t.token AS b FROM (SELECT DISTINCT token FROM fz_tok) t CROSS JOIN kw_dim k",
           ["fz_tok", "kw_dim"])
cte("fz_match", f"""SELECT token, keyword, category FROM (
  SELECT r.b AS token, r.a AS keyword, k.category, row_number() OVER (PARTITION BY r.b ORDER BY r.ratio DESC, r.a DESC) AS n
  FROM fz_ratio r JOIN kw_dim k ON r.a = k.keyword WHERE r.ratio >= {FUZZY_CUTOFF}) WHERE n = 1""", ["fz_ratio", "kw_dim"])
cte("fz_cat", """SELECT request_id, category AS fuzzy_category FROM (
  SELECT request_id, category, row_number() OVER (PARTITION BY request_id ORDER BY h DESC, p ASC) AS r FROM (
    SELECT t.request_id, m.category, count(*) AS h, min(t.pos) AS p FROM fz_tok t JOIN fz_match m ON t.token = m.token
    GROUP BY ALL)) WHERE r = 1""", ["fz_tok", "fz_match"])


def _req_mech(txt: str, cat: str) -> str:
    t = f"trim(coalesce({txt}, ''))"
    sig = " OR ".join(f"contains(lower({t}), {_s(s)})" for s in SHOWCASE_SIGNALS)
    return (f"CASE WHEN {t} = '' THEN NULL WHEN contains({t}, '?') THEN 'question' WHEN {sig} THEN 'showcase' "
            f"WHEN {cat} IS NOT NULL THEN 'statement' END")


_LOC = "\\b(?:in|near)\\s+([A-Z][a-zA-Z]+(?:\\s+[A-Z][a-zA-Z]+)?)"


def _loc(txt: str) -> str:
    return f"nullif(regexp_extract(coalesce({txt}, ''), '{_LOC}', 1), '')"


def _normalize(x: str) -> str:
    s = f"lower(regexp_replace({x}, '^\\s+|\\s+$', '', 'g'))"
    s = f"trim({s}, '`*\"'' \t\r\n')"
    s = f"trim({s}, '.,!?:;')"
    s = f"replace({s}, '&', ' and ')"
    return f"trim(regexp_replace({s}, '\\s+', ' ', 'g'))"


CANON = {" ".join(c.lower().replace("&", " and ").split()): c for c in CATEGORIES}


def _resolve(n: str, near: str) -> str:
    exact = "CASE " + " ".join(f"WHEN {n} = {_s(cn)} THEN {_s(c)}" for cn, c in CANON.items()) + " END"
    cont = "CASE " + " ".join(f"WHEN contains({n}, {_s(cn)}) THEN {_s(c)}" for cn, c in CANON.items()) + " END"
    return f"CASE WHEN {n} = '' OR {n} = 'none' OR {n} IS NULL THEN NULL ELSE coalesce({exact}, {cont}, {near}) END"


# --------------------------------------------------------------------------
def _resolve_deps(names: list[str]) -> list[str]:
    out: list[str] = []

    def visit(n: str) -> None:
        if n in out:
            return
        for d in CTES[n][1]:
            visit(d)
        out.append(n)
    for n in names:
        visit(n)
    return out


def sql(body: str, *uses: str) -> str:
    names = _resolve_deps(list(uses))
    if not names:
        return body
    return "WITH " + ",\n".join(f"{n} AS ({CTES[n][0]})" for n in names) + "\n" + body


def r4(x: str) -> str:
    # + 0.0 turns a rounded -0.0 into 0.0 (Spark's round never yields -0.0)
    return f"(round({x}, 4) + 0.0)"


ORACLES: dict[str, str] = {}


def o(name: str, body: str, *uses: str) -> None:
    ORACLES[name] = sql(body, *uses)


RAW_COLS = "post_id, subreddit, text, url, score, date, author, token_count, language"
o("a1_read_posts", f"SELECT {RAW_COLS} FROM raw_posts", "raw_posts")
o("a2_read_posts_csv", f"SELECT {RAW_COLS} FROM raw_posts", "raw_posts")
o("a3_stage_raw_posts", "SELECT 'raw_posts' AS table_name, count(*) AS n_rows FROM raw_posts", "raw_posts")
o("a5_export_partitioned", f"SELECT subreddit, count(*) AS n_rows, {r4('avg(virality_index)')} AS avg_index "
  "FROM post_labels GROUP BY subreddit", "post_labels")
o("a6_load_serving", "SELECT 'model_metadata' AS table_name, count(*) AS n_rows FROM meta UNION ALL "
  "SELECT 'predictions', count(*) FROM pred UNION ALL SELECT 'optimal_ranges', count(*) FROM ranges",
  "meta", "pred", "ranges")

o("b1_filter_language", f"SELECT {RAW_COLS} FROM raw_posts WHERE language = 'en'", "raw_posts")
o("b2_filter_communities", f"SELECT {RAW_COLS} FROM raw_posts WHERE lower(trim(subreddit)) IN "
  "(SELECT community_lc FROM category_dim)", "raw_posts", "category_dim")
o("b3_process_posts", "SELECT * FROM processed_posts", "processed_posts")
o("b5_clean_posts", f"""SELECT post_id, lower(text) AS clean_text,
  coalesce(regexp_matches(text, '\\[deleted\\]|\\[removed\\]'), false) AS is_deleted,
  CAST(date AS TIMESTAMP) AS posted_at_local, {_words('lower(text)')} AS text_length,
  CAST(hour(date) AS INTEGER) AS hour_of_day, CAST(isodow(date) - 1 AS INTEGER) AS day_of_week
FROM raw_posts""", "raw_posts")
o("b6_post_features", "SELECT * FROM post_features", "post_features")
o("b7_segment_rows", f"SELECT {KEYS}, subreddit, hour_of_day, day_of_week, "
  f"{r4('predicted_viral_score')} AS predicted_viral_score FROM pred WHERE category = 'cat1' AND "
  "has_media = 'True' AND engagement_mechanism = 'question'", "pred")
o("b7_bound_lookup", f"SELECT {KEYS}, sample_size FROM meta WHERE category = 'cat1' AND has_media = 'ALL' "
  "AND engagement_mechanism = 'question'", "meta")
o("b8_normalize_keys", "SELECT request_id, category, post_type, mechanism, pt AS post_type_key, "
  "mech AS mechanism_key FROM req_keys", "req_keys")
_FEATS_MR = ["virality_index", "hour_of_day", "day_of_week", "has_media", "post_length_proxy", "vader_compound",
             *[f"nrc_{e}" for e in EMOTIONS], "readability", "title_length", "body_length", "subreddit",
             "category", "engagement_mechanism"]
_DBL = {"virality_index", "vader_compound", "readability", *[f"nrc_{e}" for e in EMOTIONS]}
o("b9_trainable", "SELECT count_if(" + " AND ".join(
    f"{c} IS NOT NULL" + (f" AND NOT isnan({c})" if c in _DBL else "") for c in _FEATS_MR)
  + ") AS trainable, count(*) AS total FROM model_ready", "model_ready")
_PREDJ = "JOIN pred p ON " + _on("k", "p", SEGK + ["subreddit", "hour_of_day", "day_of_week"])
o("b10_sample_errors", f"""SELECT k.posted_at_local, k.post_id, {r4('k.y')} AS actual_viral_score,
  {r4('p.predicted_viral_score')} AS predicted_viral_score, {r4('p.predicted_viral_score - k.y')} AS error
FROM ev_keyed k {_PREDJ} WHERE k.split = 'test' ORDER BY k.posted_at_local, k.post_id LIMIT 10""", "ev_keyed", "pred")

o("c1_posts_with_features", "SELECT p.post_id, p.title, p.body, p.subreddit, f.has_media FROM processed_posts p "
  "JOIN post_features f ON p.post_id = f.post_id", "processed_posts", "post_features")
o("c2_model_ready", "SELECT * REPLACE (" + ", ".join(f"{r4(c)} AS {c}" for c in sorted(_DBL))
  + ") FROM model_ready", "model_ready")
o("c2_bucketed", "SELECT * REPLACE (" + ", ".join(f"{r4(c)} AS {c}" for c in sorted(_DBL))
  + ") FROM (SELECT m.*, p.posted_at_local FROM model_ready m JOIN processed_posts p ON m.post_id = p.post_id)",
  "model_ready", "processed_posts")
o("c3_attach_timestamp", f"SELECT m.post_id, {r4('m.virality_index')} AS virality_index, p.posted_at_local "
  "FROM model_ready m JOIN processed_posts p ON m.post_id = p.post_id", "model_ready", "processed_posts")
o("c4_add_category", "SELECT p.post_id, p.subreddit, coalesce(d.category, 'unknown') AS category "
  "FROM processed_posts p LEFT JOIN category_dim d ON lower(p.subreddit) = d.community_lc",
  "processed_posts", "category_dim")
o("c5_unmapped", "SELECT DISTINCT subreddit FROM processed_posts WHERE subreddit IS NOT NULL AND lower(subreddit) "
  "NOT IN (SELECT community_lc FROM category_dim)", "processed_posts", "category_dim")
o("c7_keyword_category", "SELECT request_id, category FROM kw_cat", "kw_cat")
cte("word_keywords", """SELECT ordinal, keyword, 'cat' || (ordinal % 10) AS category FROM (
  SELECT keyword, min(doc_id) AS ordinal FROM (SELECT doc_id, regexp_extract(lower(text), '[a-z]{4,}', 0) AS keyword FROM documents)
  WHERE keyword <> '' GROUP BY keyword)""")
cte("word_hits", """SELECT request_id, k.category, count(*) AS h, min(k.ordinal) AS f FROM text_requests r
  JOIN word_keywords k ON contains(lower(r.text), k.keyword) GROUP BY ALL""", ["text_requests", "word_keywords"])
o("c7_keyword_table", """SELECT r.request_id, b.category FROM text_requests r LEFT JOIN (SELECT request_id, category FROM word_hits
  QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY h DESC, f, category DESC) = 1) b ON r.request_id = b.request_id""",
  "text_requests", "word_hits")
o("c8_fuzzy_category", "SELECT request_id, fuzzy_category FROM fz_cat", "fz_cat")
o("c9_match_segment", """SELECT r.request_id, m.level, m.l_category AS m_category, m.l_has_media AS m_has_media,
  m.l_mechanism AS m_engagement_mechanism, x.sample_size
FROM requests r LEFT JOIN matched m ON r.request_id = m.request_id
LEFT JOIN meta x ON x.category = m.l_category AND x.has_media = m.l_has_media AND x.engagement_mechanism = m.l_mechanism""",
  "requests", "matched", "meta")
cte("matched_rng", "SELECT * EXCLUDE (k) FROM (" + _ladder(
    "(SELECT request_id, l_category AS c0, l_has_media AS h0, l_mechanism AS m0 FROM matched)", "ranges",
    "r.c0", "r.h0", "r.m0") + ")", ["matched", "ranges"])
o("c10_match_ranges", f"""SELECT r.request_id, m.level, m.l_category AS r_category, m.l_has_media AS r_has_media,
  m.l_mechanism AS r_engagement_mechanism, {r4('x.hour_of_day_opt_min')} AS hour_of_day_opt_min
FROM requests r LEFT JOIN matched_rng m ON r.request_id = m.request_id
LEFT JOIN ranges x ON x.category = m.l_category AND x.has_media = m.l_has_media AND x.engagement_mechanism = m.l_mechanism""",
  "requests", "matched_rng", "ranges")

o("d1_community_mean", f"SELECT subreddit, {r4('avg(score)')} AS subreddit_baseline FROM processed_posts "
  "GROUP BY subreddit", "processed_posts")
o("d2_community_median", f"SELECT subreddit, {r4('median(score)')} AS subreddit_baseline FROM ev_posts "
  "GROUP BY subreddit", "ev_posts")
o("d3_global_min_max", f"SELECT {r4('min(virality_index)')} AS min, {r4('max(virality_index)')} AS max "
  "FROM ev_labelled", "ev_labelled")
cte("slots", f"""SELECT {KEYS}, subreddit, avg(predicted_viral_score) AS predicted_score, count(*) AS sample_size,
  arg_max(hour_of_day, (predicted_viral_score, -day_of_week, -hour_of_day)) AS best_hour,
  arg_max(day_of_week, (predicted_viral_score, -day_of_week, -hour_of_day)) AS best_day_of_week
FROM pred GROUP BY ALL""", ["pred"])
cte("top5", f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {KEYS}
  ORDER BY round(predicted_score, 9) DESC, subreddit ASC) AS rank FROM slots) WHERE rank <= 5""", ["slots"])
_DAYNAME = f"coalesce({DAYS}[best_day_of_week + 1], CAST(best_day_of_week AS VARCHAR))"
o("d4_top_communities", f"SELECT {KEYS}, subreddit, {r4('predicted_score')} AS predicted_score, sample_size, "
  f"best_hour, {_DAYNAME} AS best_day, CAST(rank AS INTEGER) AS rank FROM top5", "top5")
o("d5_best_slot", f"SELECT {KEYS}, subreddit, {r4('predicted_score')} AS predicted_score, sample_size, best_hour, "
  f"{_DAYNAME} AS best_day FROM slots", "slots")
o("d6_segment_overview", f"SELECT {KEYS}, count(*) AS n_rows, count(DISTINCT subreddit) AS n_subreddits, "
  f"{r4('avg(predicted_viral_score)')} AS avg_score FROM pred GROUP BY ALL", "pred")
cte("seg_slot", f"""SELECT {KEYS}, arg_max(day_of_week, (a, -day_of_week, -hour_of_day)) AS best_day_of_week,
  arg_max(hour_of_day, (a, -day_of_week, -hour_of_day)) AS best_hour FROM (
  SELECT {KEYS}, day_of_week, hour_of_day, round(avg(predicted_viral_score), 9) AS a FROM pred GROUP BY ALL) GROUP BY ALL""",
    ["pred"])
o("d7_segment_slot", "SELECT * FROM seg_slot", "seg_slot")
cte("media", """SELECT category, engagement_mechanism,
  avg(CASE WHEN has_media = 'True' THEN predicted_viral_score END) AS avg_score_with_media,
  avg(CASE WHEN has_media = 'False' THEN predicted_viral_score END) AS avg_score_without_media
FROM pred GROUP BY ALL""", ["pred"])
o("d8_media_compare", f"SELECT category, engagement_mechanism, {r4('avg_score_with_media')} AS avg_score_with_media, "
  f"{r4('avg_score_without_media')} AS avg_score_without_media FROM media", "media")
cte("best_mech", """SELECT category, has_media, engagement_mechanism AS best_mechanism FROM (
  SELECT *, row_number() OVER (PARTITION BY category, has_media ORDER BY a DESC, engagement_mechanism ASC) AS r
  FROM (SELECT category, has_media, engagement_mechanism, round(avg(predicted_viral_score), 9) AS a FROM pred
        WHERE engagement_mechanism <> 'ALL' GROUP BY ALL)) WHERE r = 1""", ["pred"])
o("d9_best_mechanism", "SELECT * FROM best_mech", "best_mech")
o("d10_value_counts", "SELECT engagement_mechanism, count(*) AS count FROM nlp GROUP BY ALL", "nlp")
_NLPC = ["post_id", "vader_compound", *[f"nrc_{e}" for e in EMOTIONS], "readability", "title_length",
         "body_length", "subreddit", "category", "engagement_mechanism"]
_NLPD = {"vader_compound", "readability", *[f"nrc_{e}" for e in EMOTIONS]}
o("d11_null_counts", " UNION ALL ".join(
    f"SELECT {_s(c)} AS column_name, count_if({c} IS NULL" + (f" OR isnan({c})" if c in _NLPD else "")
    + ") AS null_count FROM nlp" for c in _NLPC), "nlp")
o("d12_describe", f"""SELECT count(x) AS count, {r4('avg(x)')} AS mean, {r4('stddev_samp(x)')} AS std,
  {r4('min(x)')} AS min, {r4('quantile_cont(x, 0.25)')} AS p25, {r4('quantile_cont(x, 0.5)')} AS p50,
  {r4('quantile_cont(x, 0.75)')} AS p75, {r4('max(x)')} AS max
FROM (SELECT CASE WHEN isnan(readability) THEN NULL ELSE readability END AS x FROM nlp)""", "nlp")
_PRED_STR = ["category", "has_media", "engagement_mechanism", "subreddit"]
o("d13_profile_categoricals", " UNION ALL ".join(
    f"SELECT {_s(c)} AS column_name, count(DISTINCT {c}) AS n_unique, CASE WHEN count(DISTINCT {c}) < 30 THEN "
    f"array_to_string(list_sort(list_distinct(list({c}))), ', ') END AS \"values\" FROM pred" for c in _PRED_STR),
  "pred")
_MET = ["sample_size", "test_r2", "test_rmse"]
o("d14_profile_metrics", " UNION ALL ".join(
    f"SELECT {_s(c)} AS column_name, {r4(f'min(x)')} AS min, {r4('max(x)')} AS max, {r4('avg(x)')} AS mean, "
    f"{r4('quantile_cont(x, 0.5)')} AS median, "
    + ", ".join(f"{r4(f'quantile_cont(x, {p / 10})')} AS p{p * 10}" for p in range(1, 10))
    + f" FROM (SELECT CAST({c} AS DOUBLE) AS x FROM meta)" for c in _MET), "meta")
_OUT = ["hour_of_day", "day_of_week", "predicted_viral_score"]
o("d14_profile_outcomes", " UNION ALL ".join(
    f"SELECT {_s(c)} AS column_name, {r4('min(x)')} AS min, {r4('max(x)')} AS max, {r4('avg(x)')} AS mean, "
    f"{r4('quantile_cont(x, 0.5)')} AS median, "
    + ", ".join(f"{r4(f'quantile_cont(x, {p / 10})')} AS p{p * 10}" for p in range(1, 10))
    + f" FROM (SELECT CAST({c} AS DOUBLE) AS x FROM pred)" for c in _OUT), "pred")
o("d15_bucket_counts", """SELECT b.bucket_order, b.bucket, coalesce(c.count, 0) AS count FROM
  (VALUES (0, 'below 0'), (1, '0 to 0.05'), (2, '0.05 to 0.10'), (3, '0.10 to 0.20'), (4, 'above 0.20'), (5, '(null)'))
  b(bucket_order, bucket)
LEFT JOIN (SELECT CASE WHEN test_r2 IS NULL OR isnan(test_r2) THEN '(null)' WHEN test_r2 < 0 THEN 'below 0'
  WHEN test_r2 < 0.05 THEN '0 to 0.05' WHEN test_r2 < 0.10 THEN '0.05 to 0.10' WHEN test_r2 < 0.20 THEN '0.10 to 0.20'
  ELSE 'above 0.20' END AS bucket, count(*) AS count FROM meta GROUP BY 1) c ON b.bucket = c.bucket
WHERE b.bucket <> '(null)' OR coalesce(c.count, 0) > 0""", "meta")
o("d16_domain_check", " UNION ALL ".join(
    f"SELECT {_s(c)} AS column_name, {c} AS value, count(*) AS count, (SELECT count(DISTINCT {c}) FROM pred) AS n_distinct, "
    f"(SELECT min({c}) FROM pred) AS min, (SELECT max({c}) FROM pred) AS max, {c} BETWEEN 0 AND {hi} AS in_range "
    f"FROM pred GROUP BY {c}"
    for c, hi in (("hour_of_day", 23), ("day_of_week", 6))), "pred")
o("d17_segment_cube", f"SELECT {ALLK}, count(*) AS n_posts, {r4('avg(y)')} AS avg_index, "
  f"count(DISTINCT subreddit) AS n_subreddits FROM ev_keyed GROUP BY CUBE({KEYS})", "ev_keyed")
o("d18_body_stats", "SELECT count(*) AS total, count_if(coalesce(body, '') <> '') AS with_body, "
  "count_if(coalesce(body, '') = '') AS title_only FROM processed_posts", "processed_posts")
o("d19_time_range", "SELECT split, count(*) AS rows, min(posted_at_local) AS first_ts, max(posted_at_local) AS "
  "last_ts, count_if(posted_at_local IS NULL) AS null_ts FROM ev_split GROUP BY split", "ev_split")
o("d20_regression_metrics", f"""SELECT split, n, {r4('rmse')} AS rmse, {r4('mae')} AS mae, {r4('r2')} AS r2,
  {r4('y_mean')} AS y_mean, {r4('y_std')} AS y_std,
  {r4("max(CASE WHEN split = 'train' THEN r2 END) OVER () - max(CASE WHEN split = 'test' THEN r2 END) OVER ()")} AS overfit_gap,
  CASE WHEN r2 - 0.06 > 0.005 THEN 'IMPROVED' WHEN abs(r2 - 0.06) <= 0.005 THEN '~UNCHANGED' ELSE 'REGRESSED' END
    AS vs_baseline
FROM (SELECT k.split, count(k.y) AS n, sqrt(avg((p.predicted_viral_score - k.y) ^ 2)) AS rmse,
        avg(abs(p.predicted_viral_score - k.y)) AS mae,
        1 - sum((p.predicted_viral_score - k.y) ^ 2) / NULLIF(var_pop(k.y) * count(k.y), 0) AS r2,
        avg(k.y) AS y_mean, stddev_samp(k.y) AS y_std
      FROM ev_keyed k {_PREDJ} GROUP BY k.split)""", "ev_keyed", "pred")

o("e4_temporal_split", "SELECT post_id, split FROM ev_split", "ev_split")
o("e5_check_split", """SELECT (max(CASE WHEN split='train' THEN posted_at_local END) <= min(CASE WHEN split='val' THEN posted_at_local END)
  AND max(CASE WHEN split='val' THEN posted_at_local END) <= min(CASE WHEN split='test' THEN posted_at_local END)) AS ordered,
  count_if(split='train') AS n_train, count_if(split='val') AS n_val, count_if(split='test') AS n_test FROM ev_split""",
  "ev_split")
o("f2_top_posts", f"SELECT post_id, {r4('nrc_anger')} AS nrc_anger, {r4('nrc_joy')} AS nrc_joy, "
  f"{r4('readability')} AS readability FROM nlp ORDER BY nrc_anger DESC NULLS LAST, post_id ASC LIMIT 5", "nlp")
cte("drivers_long", f"""SELECT {KEYS}, o, feature, v FROM (
  SELECT {KEYS}, unnest([{", ".join(f"{{'o': {i}, 'feature': {_s(f)}, 'v': {f}_shap}}" for i, f in enumerate(FEATURE_NAMES))}],
  recursive := true) FROM meta) WHERE v IS NOT NULL AND NOT isnan(v)""", ["meta"])
cte("drivers_ranked", f"SELECT *, row_number() OVER (PARTITION BY {KEYS} ORDER BY abs(v) DESC, o ASC) AS rank "
    "FROM drivers_long", ["drivers_long"])
o("f3_rank_drivers", f"SELECT {KEYS}, CAST(rank AS INTEGER) AS rank, feature, {r4('v')} AS shap_value "
  "FROM drivers_ranked WHERE rank <= 3", "drivers_ranked")

o("h1_split_title_body", """SELECT post_id,
  CASE WHEN strpos(text, ': ') > 0 THEN substring(text, 1, strpos(text, ': ') - 1) ELSE text END AS title,
  CASE WHEN strpos(text, ': ') > 0 THEN substring(text, strpos(text, ': ') + 2) ELSE '' END AS body FROM raw_posts""",
  "raw_posts")
o("h2_word_count", f"SELECT post_id, {_words('title')} AS title_length, {_words('body')} AS body_length "
  "FROM processed_posts", "processed_posts")
o("h3_post_mechanism", f"SELECT p.post_id, {_post_mech('p.title', 'f.has_media')} AS engagement_mechanism "
  "FROM processed_posts p JOIN post_features f ON p.post_id = f.post_id", "processed_posts", "post_features")
o("h4_request_mechanism", f"SELECT request_id, {_req_mech('text', 'category')} AS mechanism FROM kw_cat", "kw_cat")
o("h5_location", f"SELECT request_id, {_loc('text')} AS location FROM text_requests", "text_requests")
cte("labels_norm", f"SELECT conv_id, turn, {_normalize('text')} AS label FROM label_rows", ["label_rows"])
o("h6_normalize_label", "SELECT conv_id, turn, label FROM labels_norm", "labels_norm")
ratio_ctes("label_ratio", "SELECT a, label AS b FROM labels_norm CROSS JOIN (VALUES " + ", ".join(f"({_s(n)})" for n in CANON)
           + ") c(a) WHERE length(label) < 60", ["labels_norm"])
cte("label_near", "SELECT b AS label, CASE arg_max(a, (ratio, a)) " + " ".join(f"WHEN {_s(n)} THEN {_s(c)}" for n, c in CANON.items())
    + f" END AS near FROM label_ratio WHERE ratio >= {FUZZY_CUTOFF} GROUP BY b", ["label_ratio"])
o("h7_resolve_label", f"SELECT l.conv_id, l.turn, {_resolve('l.label', 'n.near')} AS category FROM labels_norm l "
  "LEFT JOIN label_near n ON l.label = n.label", "labels_norm", "label_near")
o("h9_tokens", "SELECT post_id, CAST(len(tok) AS INTEGER) AS n_tokens, array_to_string(tok, ' ') AS tokens FROM (SELECT post_id, "
  "regexp_extract_all(lower(txt), '[a-z'']+') AS tok FROM post_text)", "post_text")


def _fmt0(x: str) -> str:
    return f"CAST(CAST(round_even({x}, 0) AS BIGINT) AS VARCHAR)"


def _range_text(f: str, lo: str, hi: str) -> str:
    if f == "hour_of_day":
        return f"concat({_fmt0(lo)}, ':00-', {_fmt0(hi)}, ':00 UTC')"
    if f == "day_of_week":
        a = f"coalesce({DAYS}[CAST(trunc({lo}) AS INTEGER) + 1], CAST(CAST(trunc({lo}) AS INTEGER) AS VARCHAR))"
        b = f"coalesce({DAYS}[CAST(trunc({hi}) AS INTEGER) + 1], CAST(CAST(trunc({hi}) AS INTEGER) AS VARCHAR))"
        return f"CASE WHEN {a} = {b} THEN {a} ELSE concat({a}, ' to ', {b}) END"
    return f"concat({_fmt0(lo)}, '-', {_fmt0(hi)}, ' words')"


_LABEL = dict(RANGE_FEATURES)
cte("ranges_long", f"""SELECT {KEYS}, o, feature, least(lo, hi) AS lo, greatest(lo, hi) AS hi FROM (
  SELECT {KEYS}, unnest([{", ".join(
      f"{{'o': {i}, 'feature': {_s(f)}, 'lo': CASE WHEN isnan({f}_opt_min) THEN NULL ELSE {f}_opt_min END, "
      f"'hi': CASE WHEN isnan({f}_opt_max) THEN NULL ELSE {f}_opt_max END}}" for i, f in enumerate(_RFEATS))}],
  recursive := true) FROM ranges) WHERE lo IS NOT NULL AND hi IS NOT NULL AND lo <> hi""", ["ranges"])
_TEXT = "CASE feature " + " ".join(f"WHEN {_s(f)} THEN {_range_text(f, 'lo', 'hi')}" for f in _RFEATS) + " END"
_LABELX = "CASE feature " + " ".join(f"WHEN {_s(f)} THEN {_s(lab)}" for f, lab in RANGE_FEATURES) + " END"
o("h10_format_range", f"SELECT {KEYS}, string_agg(concat(feature, '=', {_TEXT}), ' | ' ORDER BY o) AS ranges "
  f"FROM ranges_long GROUP BY ALL UNION ALL SELECT {KEYS}, '' FROM ranges r WHERE NOT EXISTS "
  f"(SELECT 1 FROM ranges_long l WHERE {_on('l', 'r', SEGK)})", "ranges_long", "ranges")
cte("ranges_txt", f"SELECT *, {_LABELX} AS label, {_TEXT} AS text FROM ranges_long", ["ranges_long"])
cte("seg_ranges", f"""SELECT l.{KEYS.replace(', ', ', l.')}, l.o, l.feature, l.label, l.text,
  row_number() OVER (PARTITION BY l.category, l.has_media, l.engagement_mechanism
    ORDER BY coalesce(d.rank - 1, n.nd), l.o) AS rank
FROM ranges_txt l
LEFT JOIN drivers_ranked d ON {_on('l', 'd', SEGK)} AND d.feature = l.feature
LEFT JOIN (SELECT m.{KEYS.replace(', ', ', m.')}, count(dl.feature) AS nd FROM meta m LEFT JOIN drivers_long dl
           ON {_on('m', 'dl', SEGK)} GROUP BY ALL) n ON {_on('l', 'n', SEGK)}""",
    ["ranges_txt", "drivers_ranked", "drivers_long", "meta"])
o("r3_usable_ranges", f"SELECT {KEYS}, CAST(rank AS INTEGER) AS rank, feature, label, text FROM seg_ranges "
  "WHERE rank <= 3", "seg_ranges")
o("h13_ranges_sentence", f"""SELECT r.{KEYS.replace(', ', ', r.')}, CASE WHEN count(s.label) = 0 THEN '' ELSE concat('Target ',
  string_agg(concat('a ', s.label, ' of ', s.text), ' and ' ORDER BY s.rank), '.') END AS sentence
FROM ranges r LEFT JOIN seg_ranges s ON {_on('r', 's', SEGK)} AND s.rank <= 2 GROUP BY ALL""",
  "ranges", "seg_ranges")


def _guidance(mode: str, sub: str, hour: str, day: str, feats: str) -> str:
    timing = f"CASE WHEN {day} IS NOT NULL AND {hour} IS NOT NULL THEN concat({day}, ' around ', CAST({hour} AS VARCHAR), ':00') END"
    expert = (f"concat_ws(' ', CASE WHEN len({feats}) > 0 THEN concat('For this segment the model weights ', "
              f"array_to_string({feats}[1:3], ', '), ' most heavily.') END, "
              f"CASE WHEN {timing} IS NOT NULL THEN concat('Post on ', {timing}, '.') END, "
              f"'Structure your post with those factors in mind.')")
    exp = (f"concat_ws(' ', concat('r/', {sub}, ' works well for this topic.'), "
           f"CASE WHEN {timing} IS NOT NULL THEN concat('Aim for ', {timing}, ' for better visibility.') END, "
           f"'Keep your post specific and genuine rather than promotional.')")
    new = (f"CASE WHEN {timing} IS NOT NULL THEN concat('r/', {sub}, ' is a good fit. Try posting on ', {timing}, '.') "
           f"ELSE concat('r/', {sub}, ' is a good fit.') END")
    return f"CASE WHEN {mode} = 'technical' THEN {expert} WHEN {mode} = 'experienced' THEN {exp} ELSE {new} END"


cte("top3", f"SELECT {KEYS}, list(feature ORDER BY rank) AS feats FROM drivers_ranked WHERE rank <= 3 GROUP BY ALL",
    ["drivers_ranked"])
o("h11_guidance", f"""SELECT t.{KEYS.replace(', ', ', t.')}, CAST(t.rank AS INTEGER) AS rank, t.subreddit, m.mode,
  {_guidance('m.mode', 't.subreddit', 't.best_hour', DAYS + '[t.best_day_of_week + 1]', "coalesce(d.feats, CAST([] AS VARCHAR[]))")} AS guidance
FROM top5 t LEFT JOIN top3 d ON {_on('t', 'd', SEGK)}
CROSS JOIN (VALUES ('newbie'), ('experienced'), ('technical')) m(mode)""", "top5", "top3")

cte("facts", f"""SELECT o.*, {DAYS}[s.best_day_of_week + 1] AS best_day, s.best_hour, md.avg_score_with_media,
  md.avg_score_without_media, b.best_mechanism
FROM (SELECT {KEYS}, count(*) AS n_rows, count(DISTINCT subreddit) AS n_subreddits, avg(predicted_viral_score) AS avg_score
      FROM pred GROUP BY ALL) o
LEFT JOIN seg_slot s ON {_on('o', 's', SEGK)}
LEFT JOIN media md ON {_on('o', 'md', ['category', 'engagement_mechanism'])}
LEFT JOIN best_mech b ON {_on('o', 'b', ['category', 'has_media'])}""",
    ["pred", "seg_slot", "media", "best_mech"])


def _advice(level: str, cat: str, nsub: str, avg: str, day: str, hour: str) -> str:
    c = f"coalesce(nullif({cat}, ''), 'this topic')"
    when = f"CASE WHEN {day} IS NOT NULL AND {hour} IS NOT NULL THEN concat({day}, ' around ', CAST({hour} AS VARCHAR), ':00 UTC') END"
    tech = (f"concat_ws(' ', concat('Across ', CAST(coalesce({nsub}, 0) AS VARCHAR), ' subreddits in ', {c}, "
            f"', this segment averages a predicted virality of ', printf('%.1f', coalesce({avg}, 0.0)), '.'), "
            f"CASE WHEN {when} IS NOT NULL THEN concat('The strongest slot in the grid is ', {when}, '.') END)")
    other = (f"CASE WHEN {when} IS NOT NULL THEN concat('For ', {c}, ' posts like yours, the data favors posting ', {when}, '.') "
             f"ELSE concat('For ', {c}, ' posts like yours, start with the ranked subreddits above.') END")
    return f"CASE WHEN {level} = 'technical' THEN {tech} ELSE {other} END"


o("h12_advice", f"""SELECT f.{KEYS.replace(', ', ', f.')}, m.mode,
  {_advice('m.mode', 'f.category', 'f.n_subreddits', 'f.avg_score', 'f.best_day', 'f.best_hour')} AS advice
FROM facts f CROSS JOIN (VALUES ('newbie'), ('experienced'), ('technical')) m(mode)""", "facts")
o("h15_location_note", f"SELECT request_id, CASE WHEN {_loc('text')} IS NOT NULL THEN concat('You mentioned ', "
  f"{_loc('text')}, '. Our data isn''t geographic, so this is general guidance, not specific to that area.') END "
  "AS note FROM text_requests", "text_requests")
o("h21_timing", f"""SELECT post_id, CAST(hour(posted_at_local) AS INTEGER) AS hour_of_day,
  CAST(dayofweek(posted_at_local) AS INTEGER) AS day_of_week,
  CAST(isodow(posted_at_local) - 1 AS INTEGER) AS day_of_week_monday0,
  {DAYS}[dayofweek(posted_at_local) + 1] AS day_name FROM processed_posts""", "processed_posts")
o("h30_log_terms", f"""SELECT post_id, {r4('ratio')} AS score_to_avg_ratio,
  {r4('CASE WHEN score > -1 THEN ln(score + 1) END')} AS log_score,
  {r4('CASE WHEN ratio > -1 THEN ln(ratio + 1) END')} AS log_ratio
FROM (SELECT post_id, score, score / NULLIF(avg(score) OVER (PARTITION BY subreddit), 0) AS ratio FROM processed_posts)""",
  "processed_posts")
o("h31_min_max", f"SELECT post_id, score, {r4('(score - min(score) OVER ()) / NULLIF(max(score) OVER () - min(score) OVER (), 0)')} "
  "AS score_scaled FROM ev_posts", "ev_posts")
o("h33_engagement_index", f"SELECT post_id, subreddit, {r4('subreddit_baseline')} AS subreddit_baseline, "
  f"{r4('virality_index')} AS virality_index FROM post_labels", "post_labels")
o("h34_median_score", f"""SELECT post_id, {r4('b')} AS subreddit_baseline, {r4('score / NULLIF(b + 1, 0)')} AS viral_score,
  coalesce(score / NULLIF(b + 1, 0) > 1.5, false) AS is_top_quartile
FROM (SELECT e.post_id, e.score, m.b FROM ev_posts e LEFT JOIN
  (SELECT subreddit, median(score) AS b FROM ev_posts WHERE subreddit IS NOT NULL GROUP BY subreddit) m
  ON e.subreddit = m.subreddit)""", "ev_posts")
o("h35_pct_lift", f"SELECT category, engagement_mechanism, {r4('CASE WHEN avg_score_without_media <> 0 THEN (avg_score_with_media - avg_score_without_media) / abs(avg_score_without_media) * 100.0 END')} "
  "AS lift_pct FROM media", "media")

o("n1_sentiment", f"SELECT post_id, {r4('vader_compound')} AS vader_compound FROM sentiment", "sentiment")
o("n2_emotions", "SELECT post_id, " + ", ".join(f"{r4(f'nrc_{e}')} AS nrc_{e}" for e in EMOTIONS)
  + " FROM emotions", "emotions")
o("n3_readability", f"SELECT post_id, {r4(_readability('txt'))} AS readability FROM post_text", "post_text")
o("n4_nlp_features", "SELECT * REPLACE (" + ", ".join(f"{r4(c)} AS {c}" for c in sorted(_NLPD)) + ") FROM nlp", "nlp")

o("m6_segment_metadata", "SELECT * REPLACE (" + ", ".join(
    f"{r4(c)} AS {c}" for c in ["test_r2", "test_rmse", *[f"{f}_shap" for f in FEATURE_NAMES]]) + ") FROM meta",
  "meta")
o("m7_prediction_grid", f"SELECT * REPLACE ({r4('predicted_viral_score')} AS predicted_viral_score) FROM pred", "pred")
o("m8_optimal_ranges", "SELECT * REPLACE (" + ", ".join(
    f"{r4(f'{f}_opt_{b}')} AS {f}_opt_{b}" for f in _RFEATS for b in ("min", "max")) + ") FROM ranges", "ranges")


def _tier(r2: str, n: str) -> str:
    r = f"(CASE WHEN isnan({r2}) THEN NULL ELSE {r2} END)"
    return (f"CASE WHEN {r} IS NULL OR {n} IS NULL THEN 'none' WHEN {r} >= 0.10 AND {n} >= 500 THEN 'high' "
            f"WHEN {r} >= 0.0 AND {n} >= 100 THEN 'low' ELSE 'none' END")


def _reason(r2: str, n: str) -> str:
    r = f"(CASE WHEN isnan({r2}) THEN NULL ELSE {r2} END)"
    summ = f"concat('R² of ', printf('%.2f', {r}), ' on ', format('{{:,}}', CAST({n} AS BIGINT)), ' posts')"
    return (f"CASE WHEN {r} IS NULL OR {n} IS NULL THEN 'no model metrics available for this segment' "
            f"WHEN {r} >= 0.10 AND {n} >= 500 THEN concat({summ}, ' (above baseline)') "
            f"WHEN {r} >= 0.0 AND {n} >= 100 THEN concat({summ}, ' (positive but weak signal)') "
            f"WHEN {r} < 0.0 THEN concat({summ}, ' (worse than predicting the average)') "
            f"ELSE concat({summ}, ' (sample too small for a reliable estimate)') END")


o("r1_confidence", f"SELECT {KEYS}, {_tier('test_r2', 'sample_size')} AS confidence, "
  f"{_reason('test_r2', 'sample_size')} AS reason FROM meta", "meta")
o("r2_parse_requests", f"""SELECT k.request_id,
  CASE WHEN trim(k.text) = '' OR k.text IS NULL THEN NULL ELSE coalesce(k.category, f.fuzzy_category) END AS category,
  CAST(NULL AS VARCHAR) AS post_type,
  CASE WHEN trim(k.text) = '' OR k.text IS NULL THEN NULL ELSE {_req_mech('k.text', 'coalesce(k.category, f.fuzzy_category)')} END AS mechanism,
  CASE WHEN trim(k.text) = '' OR k.text IS NULL THEN NULL ELSE {_loc('trim(k.text)')} END AS location_mentioned,
  CASE WHEN trim(k.text) = '' OR k.text IS NULL THEN NULL WHEN k.category IS NOT NULL THEN 'keyword'
       WHEN f.fuzzy_category IS NOT NULL THEN 'fuzzy' END AS category_source
FROM kw_cat k LEFT JOIN fz_cat f ON k.request_id = f.request_id""", "kw_cat", "fz_cat")

# R4 ------------------------------------------------------------------------
cte("resp", f"""SELECT r.*, m.level, m.l_category, m.l_has_media, m.l_mechanism, x.sample_size,
  CASE WHEN isnan(x.test_r2) THEN NULL ELSE x.test_r2 END AS test_r2,
  CASE WHEN isnan(x.test_rmse) THEN NULL ELSE x.test_rmse END AS test_rmse,
  {_tier('x.test_r2', 'x.sample_size')} AS confidence, {_reason('x.test_r2', 'x.sample_size')} AS confidence_reason
FROM req_keys r LEFT JOIN matched m ON r.request_id = m.request_id
LEFT JOIN meta x ON x.category = m.l_category AND x.has_media = m.l_has_media AND x.engagement_mechanism = m.l_mechanism""",
    ["req_keys", "matched", "meta"])
cte("resp_drivers", """SELECT r.request_id, list(d.feature ORDER BY d.rank) AS feats FROM resp r
JOIN drivers_ranked d ON d.category = r.l_category AND d.has_media = r.l_has_media AND d.engagement_mechanism = r.l_mechanism
GROUP BY r.request_id""", ["resp", "drivers_ranked"])
cte("resp_ranges", """SELECT r.request_id, s.rank, s.feature, s.label, s.text FROM resp r
JOIN matched_rng mr ON mr.request_id = r.request_id
JOIN seg_ranges s ON s.category = mr.l_category AND s.has_media = mr.l_has_media AND s.engagement_mechanism = mr.l_mechanism
WHERE s.rank <= 3 AND r.level IS NOT NULL AND r.confidence <> 'none'""", ["resp", "matched_rng", "seg_ranges"])
o("r4_recommend", f"""SELECT r.request_id, r.confidence, r.confidence_reason, {r4('r.test_r2')} AS test_r2,
  {r4('r.test_rmse')} AS test_rmse, CAST(r.sample_size AS BIGINT) AS sample_size,
  CAST(CASE WHEN r.confidence = 'none' THEN 0 ELSE coalesce(t.n, 0) END AS INTEGER) AS n_recs,
  CASE WHEN r.mode = 'technical' THEN coalesce(array_to_string(d.feats, ','), '') ELSE '' END AS drivers,
  CASE WHEN r.level IS NOT NULL AND r.confidence <> 'none' AND f.category IS NOT NULL
       THEN {_advice('r.mode', 'r.l_category', 'f.n_subreddits', 'f.avg_score', 'f.best_day', 'f.best_hour')} ELSE '' END AS advice,
  coalesce('Target ' || rs.sent || '.', '') AS ranges_sentence,
  coalesce(rg.txt, '') AS optimal_ranges,
  CASE WHEN r.level IS NULL THEN 'No model metadata found for this query.'
       ELSE concat('Matched segment: ', r.l_category, ' / has_media=', r.l_has_media, ' / ', r.l_mechanism, '.') END AS notes
FROM resp r
LEFT JOIN (SELECT category, has_media, engagement_mechanism, count(*) AS n FROM top5 GROUP BY ALL) t
  ON t.category = r.category AND t.has_media = r.pt AND t.engagement_mechanism = r.mech
LEFT JOIN resp_drivers d ON d.request_id = r.request_id
LEFT JOIN facts f ON f.category = r.l_category AND f.has_media = r.l_has_media AND f.engagement_mechanism = r.l_mechanism
LEFT JOIN (SELECT request_id, string_agg(concat('a ', label, ' of ', text), ' and ' ORDER BY rank) AS sent
           FROM resp_ranges WHERE rank <= 2 GROUP BY request_id) rs ON rs.request_id = r.request_id
LEFT JOIN (SELECT request_id, string_agg(concat(feature, '=', text), ' | ' ORDER BY rank) AS txt
           FROM resp_ranges GROUP BY request_id) rg ON rg.request_id = r.request_id""",
  "resp", "top5", "resp_drivers", "facts", "resp_ranges")
o("r4_recommend_items", f"""SELECT r.request_id, CAST(t.rank AS INTEGER) AS rank, t.subreddit, t.best_hour,
  {DAYS}[t.best_day_of_week + 1] AS best_day,
  {r4("CASE WHEN r.confidence = 'high' THEN t.predicted_score END")} AS predicted_score, t.sample_size,
  {_guidance('r.mode', 't.subreddit', 't.best_hour', DAYS + '[t.best_day_of_week + 1]', "coalesce(d.feats[1:3], CAST([] AS VARCHAR[]))")} AS guidance
FROM resp r JOIN top5 t ON t.category = r.category AND t.has_media = r.pt AND t.engagement_mechanism = r.mech
LEFT JOIN resp_drivers d ON d.request_id = r.request_id
WHERE r.confidence <> 'none'""", "resp", "top5", "resp_drivers")
o("r5_segment_facts", f"""SELECT {KEYS}, n_rows, n_subreddits, {r4('avg_score')} AS avg_score, best_day, best_hour,
  {r4('avg_score_with_media')} AS avg_score_with_media, {r4('avg_score_without_media')} AS avg_score_without_media,
  best_mechanism FROM facts""", "facts")


cte("mr_split", """SELECT * EXCLUDE (rn, n), CASE WHEN rn - 1 < floor(n * 0.7::DOUBLE) THEN 'train'
  WHEN rn - 1 < floor(n * 0.85::DOUBLE) THEN 'val' ELSE 'test' END AS split
FROM (SELECT m.*, p.posted_at_local, row_number() OVER (ORDER BY p.posted_at_local NULLS LAST, m.post_id) AS rn, count(*) OVER () AS n
      FROM model_ready m JOIN processed_posts p ON m.post_id = p.post_id)""", ["model_ready", "processed_posts"])
_LEVELS = {c: f"(SELECT v, row_number() OVER (ORDER BY v) - 1.0 AS i FROM (SELECT DISTINCT {c} AS v FROM mr_split WHERE {c} IS NOT NULL))"
           for c in ("subreddit", "category", "engagement_mechanism")}
o("m1_assemble", f"""SELECT m.post_id, m.split, {len(FEATURE_NAMES)} AS n_features, """ + ", ".join(
    f"CAST(coalesce(l{k}.i, (SELECT count(DISTINCT {c}) FROM mr_split)) AS DOUBLE) AS {c}_idx" for k, c in enumerate(_LEVELS))
  + " FROM mr_split m " + " ".join(f"LEFT JOIN {q} l{k} ON m.{c} = l{k}.v" for k, (c, q) in enumerate(_LEVELS.items())), "mr_split")
_MR_TYPES = ([("post_id", "bigint"), ("virality_index", "double"), ("hour_of_day", "int"), ("day_of_week", "int"), ("has_media", "boolean"),
              ("post_length_proxy", "bigint"), ("vader_compound", "double")] + [(f"nrc_{e}", "double") for e in EMOTIONS]
             + [("readability", "double"), ("title_length", "int"), ("body_length", "int"), ("subreddit", "string"),
                ("category", "string"), ("engagement_mechanism", "string")])
o("a7_describe_schema", "SELECT position, column_name, data_type, (SELECT count(*) FROM model_ready) AS n_rows, "
  f"{len(_MR_TYPES)} AS n_cols FROM (VALUES " + ", ".join(f"({i}, {_s(c)}, {_s(t)})" for i, (c, t) in enumerate(_MR_TYPES))
  + ") t(position, column_name, data_type)", "model_ready")

o("s1_collect_stream", f"SELECT {RAW_COLS} FROM raw_posts WHERE lower(trim(subreddit)) IN "
  "(SELECT community_lc FROM category_dim)", "raw_posts", "category_dim")
o("s2_stream_progress", "SELECT count(*) AS checked, count_if(lower(trim(subreddit)) IN "
  "(SELECT community_lc FROM category_dim)) AS matched FROM raw_posts", "raw_posts", "category_dim")


# given forest: conditional expectations over every subset of the features, then Shapley's average of what each adds -------

def _expected(nodes: dict, node: int, known: tuple[str, ...], features: list[str]) -> str:
    """The expected value below ``node`` if only the ``known`` features are known."""
    value, cover, left, right, feature, threshold = nodes[node]
    if left < 0:
        return f"{value!r}::DOUBLE"
    a, b = (_expected(nodes, child, known, features) for child in (left, right))
    if features[feature] in known:
        return f"CASE WHEN {features[feature]} <= {threshold!r} THEN {a} ELSE {b} END"
    return f"({nodes[left][1]!r}::DOUBLE * {a} + {nodes[right][1]!r}::DOUBLE * {b}) / {cover!r}::DOUBLE"


def _forest_sql() -> None:
    from itertools import combinations
    from math import factorial

    from .catalog import GIVEN_FEATURES as features, GIVEN_FOREST

    trees: dict[int, tuple[float, dict]] = {}
    for t, weight, node, value, cover, left, right, feature, threshold in GIVEN_FOREST:
        trees.setdefault(t, (weight, {}))[1][node] = (value, cover, left, right, feature, threshold)

    def total(known) -> str:
        return " + ".join(f"{w!r}::DOUBLE * ({_expected(nodes, 0, known, features)})" for w, nodes in trees.values())

    inputs = ", ".join(f"coalesce(CAST({f} AS DOUBLE), -1000000.0) AS {f}" for f in features)
    cte("given_rows", f"""SELECT post_id, virality_index, {inputs}, CASE WHEN rn - 1 < floor(n * 0.7::DOUBLE) THEN 'train'
  WHEN rn - 1 < floor(n * 0.85::DOUBLE) THEN 'val' ELSE 'test' END AS split
FROM (SELECT m.*, row_number() OVER (ORDER BY p.posted_at_local NULLS LAST, m.post_id) AS rn, count(*) OVER () AS n
      FROM model_ready m LEFT JOIN (SELECT post_id, posted_at_local FROM processed_posts) p ON p.post_id = m.post_id)""",
        ["model_ready", "processed_posts"])
    subsets = [s for n in range(len(features) + 1) for s in combinations(features, n)]
    cte("given_values", "SELECT post_id, " + ", ".join(f"{total(s)} AS {'v_' + '_'.join(s)}" for s in subsets) + " FROM given_rows", ["given_rows"])
    d = len(features)
    parts = []
    for f in features:
        terms = [f"{factorial(len(s)) * factorial(d - len(s) - 1)}.0::DOUBLE / {factorial(d)}.0 * "
                 f"({'v_' + '_'.join(x for x in features if x in s or x == f)} - {'v_' + '_'.join(s)})" for s in subsets if f not in s]
        parts.append(f"{r4(' + '.join(terms))} AS {f}")
    o("m4_row_attribution", f"SELECT post_id, {r4('v_' + '_'.join(features))} AS prediction, {r4('v_')} AS base, {', '.join(parts)} "
      "FROM given_values", "given_values")
    one = [f"{w!r}::DOUBLE * ({_expected(nodes, 0, tuple(features), features)})" for w, nodes in trees.values()]
    errors = ", ".join(f"avg(({' + '.join(one[:k + 1])} - virality_index) ^ 2) AS e{k + 1}" for k in range(len(one)))
    curve = " UNION ALL ".join(f"SELECT {k + 1} AS iteration, n, e{k + 1} AS mse FROM given_errors" for k in range(len(one)))
    cte("given_errors", f"SELECT count(*) AS n, {errors} FROM given_rows WHERE split = 'val' AND virality_index IS NOT NULL", ["given_rows"])
    cte("given_curve", f"""SELECT c.iteration, c.n, c.mse, (SELECT arg_min(b.iteration, (b.mse, b.iteration)) FROM ({curve}) b
  WHERE b.iteration <= c.iteration) AS best_so_far FROM ({curve}) c""", ["given_errors"])
    cte("given_end", "SELECT coalesce(min(iteration) FILTER (iteration - best_so_far >= 2), max(iteration)) AS last FROM given_curve", ["given_curve"])
    o("m2_staged_curve", f"""SELECT CAST(iteration AS INTEGER) AS iteration, n, {r4('mse')} AS mse, CAST(best_so_far AS INTEGER) AS best_so_far,
  iteration >= last AS stopped, iteration = (SELECT best_so_far FROM given_curve, given_end WHERE iteration = last) AS is_best
FROM given_curve, given_end""", "given_curve", "given_end")


_forest_sql()


cte("mr_keyed", """SELECT subreddit, category, CASE WHEN has_media THEN 'True' WHEN NOT has_media THEN 'False' END AS has_media, engagement_mechanism
FROM model_ready""", ["model_ready"])
cte("mr_profile", """SELECT subreddit, median(title_length) AS t, median(body_length) AS b, median(CAST(has_media AS INTEGER)) AS m
FROM model_ready GROUP BY subreddit""", ["model_ready"])
cte("mr_seen", f"SELECT {ALLK}, subreddit FROM mr_keyed GROUP BY CUBE({KEYS}), subreddit", ["mr_keyed"])
o("m7_given_grid", f"""SELECT s.category, s.has_media, s.engagement_mechanism, s.subreddit, CAST(h.h AS INTEGER) AS hour_of_day,
  CAST(d.d AS INTEGER) AS day_of_week, {r4("""least(greatest(30.0::DOUBLE + length(coalesce(s.category, '')) + 0.75::DOUBLE * coalesce(p.t, 0)
  - 0.0625::DOUBLE * coalesce(p.b, 0) + 7.25::DOUBLE * coalesce(CASE s.has_media WHEN 'True' THEN 1.0 WHEN 'False' THEN 0.0 ELSE p.m END, 0)
  + length(coalesce(s.category, '')) / 16.0::DOUBLE * h.h - 1.5::DOUBLE * d.d, 0.0), 100.0)""")} AS predicted_viral_score
FROM mr_seen s LEFT JOIN mr_profile p ON p.subreddit IS NOT DISTINCT FROM s.subreddit CROSS JOIN range(24) h(h) CROSS JOIN range(7) d(d)""",
  "mr_seen", "mr_profile")


# by sketch: distinct counts of some dozens are exact; a quantile's rank is within its error everywhere ----------------------
o("d2_sketched_median", "SELECT subreddit, count(score) AS n, true AS within FROM ev_posts GROUP BY subreddit", "ev_posts")
ORACLES["d6_sketched_overview"] = ORACLES["d6_segment_overview"]
ORACLES["d17_sketched_cube"] = ORACLES["d17_segment_cube"]
o("d13_sketched_counts", " UNION ALL ".join(f"SELECT {_s(c)} AS column_name, count(DISTINCT {c}) AS n_unique FROM pred" for c in _PRED_STR), "pred")
o("m8_sketched_ranges", f"SELECT {ALLK}, count(y) AS n, true AS threshold_within, true AS ends_within FROM ev_keyed WHERE y IS NOT NULL "
  f"GROUP BY CUBE({KEYS})", "ev_keyed")


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
