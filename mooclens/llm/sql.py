"""DuckDB SQL for the rows of the training-data queries that SQL expresses."""

REPEATS = r"""
WITH w AS (
  SELECT rowid AS row, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
  FROM (SELECT row_number() OVER () AS rowid, doc_id, text FROM documents)
), windows AS (
  SELECT row, doc_id, s, array_to_string(words[s:s + 12], ' ') AS win
  FROM (SELECT row, doc_id, words, unnest(range(1, len(words) - 11)) AS s FROM w)
), firsts AS (
  SELECT row, doc_id, s, min(doc_id) OVER (PARTITION BY win) AS least FROM windows
), gone AS (
  SELECT DISTINCT row, unnest(range(s, s + 13)) AS k FROM firsts
  WHERE least < doc_id OR (doc_id IS NULL AND least IS NOT NULL)
), marked AS (
  SELECT w.row, w.doc_id, len(w.words) AS n_words, w.words, list(g.k) FILTER (WHERE g.k IS NOT NULL) AS k
  FROM w LEFT JOIN gone g ON w.row = g.row GROUP BY ALL
), kept AS (
  SELECT row, coalesce(string_agg(word, ' ' ORDER BY k), '') AS kept
  FROM (SELECT w.row, t.k, t.word FROM w, LATERAL (SELECT unnest(w.words) AS word, generate_subscripts(w.words, 1) AS k) t) x
  ANTI JOIN gone g ON x.row = g.row AND x.k = g.k GROUP BY row
)
SELECT m.doc_id, CAST(m.n_words AS BIGINT) AS n_words, CAST(coalesce(len(m.k), 0) AS BIGINT) AS n_removed,
       sha256(coalesce(t.kept, '')) AS kept_sha256
FROM marked m LEFT JOIN kept t ON m.row = t.row
"""

DIVERGENCE = r"""
WITH d AS (
  SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text
  FROM documents
), t AS (
  SELECT row, lang, source,
         translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term
  FROM d
), kept AS (
  SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT row) >= 30
), v AS (
  SELECT lang, count(*)::HUGEINT AS v FROM kept GROUP BY lang
), groups AS (
  SELECT DISTINCT lang, source FROM d
), c AS (
  SELECT lang, source, term, count(*)::HUGEINT AS n FROM t SEMI JOIN kept USING (lang, term) GROUP BY ALL
), totals AS (
  SELECT g.lang, g.source, coalesce(sum(c.n), 0)::HUGEINT AS total
  FROM groups g LEFT JOIN c ON g.lang = c.lang AND g.source = c.source GROUP BY ALL
), lang_totals AS (
  SELECT lang, sum(total)::HUGEINT AS total FROM totals GROUP BY lang
), q AS (
  SELECT k.lang, k.term, 1 + (1000000000 * (sum(c.n) + 5)) // (any_value(lt.total) + 5 * any_value(v.v)) AS q
  FROM kept k JOIN c ON k.lang = c.lang AND k.term = c.term JOIN v ON k.lang = v.lang
  JOIN lang_totals lt ON k.lang = lt.lang GROUP BY k.lang, k.term
), p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000 * (coalesce(c.n, 0) + 5)) // (g.total + 5 * v.v) AS p
  FROM totals g JOIN kept k ON g.lang = k.lang JOIN v ON g.lang = v.lang
  LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), sums AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
), terms AS (
  SELECT p.lang, p.source, 'term' AS part, p.term AS item, p.p - q.q AS value
  FROM p JOIN q ON p.lang = q.lang AND p.term = q.term WHERE p.n > 0 AND p.p > q.q
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS r
  FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms)
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(r AS INTEGER) AS rank
FROM ranked WHERE part = 'pair' OR r <= 50
"""


def _edit(state: str, cost: str, letter: str, said: str | None = None) -> str:
    """A state (cost, audit, text) after one more edit."""
    text = f"{state}.said" + (f" || chr(10) || {said}" if said else "")
    return f"CASE WHEN {state} IS NOT NULL THEN {{'cost': {state}.cost + {cost}, 'audit': {state}.audit || '{letter}', 'said': {text}}} END"


def _least(*states: str) -> str:
    return "list_min([" + ", ".join(states) + "])"


def _repair() -> str:
    """The states before a turn (c), after inserted turns (j), after it."""
    user, assistant = "'user:'", "'assistant:'"
    j2 = _least("c2", *(_edit(c, "3", "I", user) for c in ("c0", "c1", "c3")))
    j3 = _least("c3", _edit("j2", "3", "I", assistant))
    kept = "CASE WHEN fault NOT IN ('blank', 'duplicate') AND left(role, 1) = '{}' THEN {} END"
    rerole = "CASE WHEN fault NOT IN ('blank', 'duplicate') THEN {} END"
    keep = lambda state, role: kept.format(role, _edit(state, "cut", "K", "role || ':' || text"))
    change = lambda state, role: rerole.format(_edit(state, "3 + cut", "R", f"{role} || text"))
    drop = lambda state: _edit(state, "4", "D")
    n0, n1 = drop("j0"), _least(drop("j1"), keep("j0", "s"))
    before = ("j0", "j1", "j3")
    n2 = _least(drop("j2"), *(keep(x, "u") for x in before), *(change(x, user) for x in before))
    n3 = _least(drop("j3"), keep("j2", "a"), change("j2", assistant))
    return rf"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)),
           lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc
), keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: CAST(ascii(x) AS BIGINT)) AS codes
  FROM conversations
), kinds AS (
  SELECT conv_id, turn, role, text,
         xor(list_reduce(list_prepend(4294967295, codes), lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS kind
  FROM keyed, crc
), damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy
  FROM kinds WHERE kind <> 0
), placed AS (
  SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i FROM damaged
), faults AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank'
                 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
                 WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE 'none' END AS fault,
         lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) NOT IN ('su', 'ua', 'au') AS illegal
  FROM placed
), facts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, max(i) AS n,
         count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
         count(*) FILTER (WHERE fault = 'truncated') AS truncated, count(*) FILTER (WHERE illegal) AS illegal
  FROM faults GROUP BY conv_id
), step AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS i, {{'cost': 0, 'audit': '', 'said': ''}} AS c0, NULL::STRUCT(cost INTEGER, audit VARCHAR, said VARCHAR) AS c1,
         NULL::STRUCT(cost INTEGER, audit VARCHAR, said VARCHAR) AS c2, NULL::STRUCT(cost INTEGER, audit VARCHAR, said VARCHAR) AS c3
  FROM facts
  UNION ALL
  SELECT conv_id, i, {n0}, {n1}, {n2}, {n3}
  FROM (SELECT *, {j3} AS j3 FROM (
    SELECT s.conv_id, f.i, f.role, f.text, f.fault, CASE WHEN f.fault = 'truncated' THEN 3 ELSE 0 END AS cut, c0 AS j0, c1 AS j1, c3, {j2} AS j2
    FROM step s JOIN faults f ON s.conv_id IS NOT DISTINCT FROM f.conv_id AND f.i = s.i + 1))
), ended AS (
  SELECT s.conv_id, {_least("c0", "j3")} AS best
  FROM (SELECT *, {j3} AS j3 FROM (SELECT *, {j2} AS j2 FROM step)) s
  JOIN facts f ON s.conv_id IS NOT DISTINCT FROM f.conv_id AND s.i = f.n
)
SELECT c.conv_id, CAST(coalesce(f.gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(f.blank, 0) AS BIGINT) AS blank,
       CAST(coalesce(f.duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(f.truncated, 0) AS BIGINT) AS truncated,
       CAST(coalesce(f.illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(e.best.cost, 0) AS BIGINT) AS cost,
       coalesce(e.best.audit, '') AS audit, sha256(coalesce(e.best.said[2:], '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN facts f ON c.conv_id IS NOT DISTINCT FROM f.conv_id
LEFT JOIN ended e ON c.conv_id IS NOT DISTINCT FROM e.conv_id
"""


CONVERSATIONS = _repair()
