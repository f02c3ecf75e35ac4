"""SQL twins of the queries that SQL can express."""

from __future__ import annotations

from tabulon.llm.maxscore import BEST
from tabulon.llm.mixing import BLOCK_WORDS, MOST, SEED
from tabulon.llm.reply_trees import CONTROL, END, ESCAPE, SEPARATOR, START
from tabulon.llm.url_rules import LEAST_CONFIDENCE, LEAST_ROWS, LEAST_SUPPORT

_WORDS = r"[^\x20\x09-\x0D]+"


def _mixing() -> str:
    return f"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{_WORDS}')) AS BIGINT) AS size,
         md5('{SEED}|' || coalesce(CAST(doc_id AS VARCHAR) || '|', '') || md5(coalesce(text, ''))) AS draw
  FROM documents),
placed AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY draw ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a FROM sized),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS s, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS pos FROM sized GROUP BY source),
weighed AS (
  SELECT source, s, {MOST}.0 * s AS most, CASE pos % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS w FROM sources),
-- Sources in the order in which they reach their cap; the level is the least one at which the rest shares the rest.
capped AS (
  SELECT *, coalesce(sum(most) OVER o, 0) AS fixed, sum(w) OVER (ORDER BY most / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS free,
         sum(s) OVER () AS total FROM weighed
  WINDOW o AS (ORDER BY most / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (SELECT (total - fixed) / free AS l FROM capped WHERE (total - fixed) / free * w <= most ORDER BY most / w, source LIMIT 1),
targets AS (SELECT source, s, CAST(least(w * coalesce((SELECT l FROM level), 1e300), most) AS DOUBLE) AS t FROM weighed),
planned AS (
  SELECT p.*, s, t, CAST(floor(t / {BLOCK_WORDS} + 0.5) AS BIGINT) AS q, CAST(ceil(s / {BLOCK_WORDS}.0) AS BIGINT) AS n,
         CAST('0x' || left(md5('{SEED}|' || coalesce(p.source, '')), 8) AS BIGINT) AS h
  FROM placed p JOIN targets g ON p.source IS NOT DISTINCT FROM g.source),
cut AS (SELECT *, h % n * {BLOCK_WORDS} AS lo, (q % n) * {BLOCK_WORDS} AS words, n * {BLOCK_WORDS} AS ring FROM planned)
SELECT doc_id, size, s AS source_size, t AS target, q AS quota_blocks,
       CAST(CASE WHEN size = 0 THEN 0 ELSE (q // n) * size
         + greatest(0, least(a + size, lo + words) - greatest(a, lo))
         + greatest(0, least(a + size, lo - ring + words) - greatest(a, lo - ring)) END AS BIGINT) AS taken
FROM cut"""


def _url_rules() -> str:
    """All sets of tokens of each labelled url are counted; the given rules are written out."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    fits = lambda h, p: f"(host = '{h}' OR host LIKE '%.{h}') AND path LIKE '{p}%'"
    rules = [
        ("example.net/en/", "allow", fits("example.net", "/en/")),
        ("example.com/de/", "block", fits("example.com", "/de/")),
        ("org/fr/", "allow", fits("org", "/fr/")),
        ("net/", "block", fits("net", "/")),
    ]
    case = lambda k: " ".join(f"WHEN {r[2]} THEN '{r[k]}'" for r in rules)
    prefixed = lambda name, items: f"list_transform(list_filter({items}, lambda x: x <> ''), lambda x: '{name}:' || x)"
    tokens = "list_distinct(list_concat(" + ", ".join(
        [
            prefixed("scheme", "[lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1))]"),
            prefixed("host", "[host]"),
            prefixed("label", "string_split(host, '.')"),
            prefixed("path", "list_filter(string_split(path, '/'), lambda x: NOT regexp_full_match(x, '[0-9]+'))"),
            prefixed("argument", "list_transform(string_split(regexp_extract(url, '(?s)[?]([^#]*)', 1), '&'), lambda x: regexp_extract(x, '^([^=]*)', 1))"),
            "CASE WHEN contains(url, '#') THEN ['part:fragment'] ELSE [] END",
        ]
    ) + "))"
    return f"""
WITH split AS (
  SELECT page_id, url, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), '{upper}', '{upper.lower()}') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
known AS (SELECT *, {tokens} AS tokens, TRY_CAST(regexp_extract(path, '/([0-9]+)/?$', 1) AS BIGINT) AS number FROM split),
bad AS (SELECT doc_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels GROUP BY doc_id),
labelled AS (SELECT tokens, bad FROM known JOIN bad ON doc_id = number WHERE url IS NOT NULL),
chosen AS (SELECT tokens, bad, unnest(range(1, CAST(pow(2, len(tokens)) AS BIGINT))) AS mask FROM labelled),
sets AS (SELECT list_sort(list_filter(tokens, lambda x, i: (mask >> (i - 1)) & 1 = 1)) AS rule, bad FROM chosen),
counted AS (SELECT rule, sum(bad) AS hits, sum(bad) / count(*) AS confidence FROM sets GROUP BY rule),
frequent AS (
  SELECT * FROM counted WHERE confidence >= {LEAST_CONFIDENCE} AND (SELECT count(*) FROM labelled) >= {LEAST_ROWS}
    AND hits >= greatest({LEAST_ROWS}, {LEAST_SUPPORT} * (SELECT count(*) FROM labelled))),
mined AS (
  SELECT rule FROM frequent f WHERE NOT EXISTS (
    SELECT 1 FROM frequent g WHERE len(g.rule) < len(f.rule) AND list_has_all(f.rule, g.rule) AND g.confidence >= f.confidence)),
judged AS (SELECT *, CAST((SELECT count(*) FROM mined m WHERE list_has_all(tokens, m.rule)) AS INT) AS mined FROM known)
SELECT page_id, host, path, CASE {case(0)} END AS rule,
       coalesce(CASE {case(1)} END, CASE WHEN mined > 0 THEN 'block' ELSE 'allow' END) AS verdict, mined FROM judged"""


def _reply_trees() -> str:
    """The template is written out: what its escapes and marks add to the texts."""
    safe = "replace(%s, '\\', '\\\\')"
    for c in CONTROL:
        safe = f"replace({safe}, '{c}', '{c[0]}{ESCAPE}{c[1:]}')"
    marks = len(START + SEPARATOR + END)
    return f"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
told AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role) AS turns,
         coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role), '') AS trained,
         CAST(sum(length({safe % "role"}) + length({safe % "text"}) + {marks}) AS BIGINT) AS formatted_chars
  FROM said GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, CAST(length(trained) AS BIGINT) AS loss_chars, sha256(trained) AS loss_sha256,
       formatted_chars, CAST(1 AS INTEGER) AS branch FROM told"""


def _maxscore() -> str:
    """All documents are scored for all items."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    terms = rf"regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
    return f"""
WITH cut AS (SELECT doc_id, row_number() OVER () AS id, {terms} AS terms FROM documents),
docs AS (SELECT doc_id, id, terms, CAST(len(terms) AS BIGINT) AS n FROM cut WHERE len(terms) > 0),
total AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS l FROM docs),
wanted AS (SELECT DISTINCT item_id, unnest({terms}) AS term FROM benchmark),
held AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(terms) AS term FROM docs) WHERE term IN (SELECT term FROM wanted) GROUP BY id, term),
weights AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM held, total GROUP BY term, n_docs),
scored AS (
  SELECT item_id, doc_id, id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // l)))) AS BIGINT) AS score
  FROM wanted JOIN held USING (term) JOIN weights USING (term) JOIN docs USING (id), total GROUP BY item_id, doc_id, id),
ranked AS (
  SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS FIRST) AS INTEGER) AS rank, doc_id, score
  FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= {BEST}"""


def statements() -> dict[str, str]:
    return {"op2_url_rules": _url_rules(), "op9_mixing": _mixing(), "op11_reply_trees": _reply_trees(), "op13_maxscore": _maxscore()}
