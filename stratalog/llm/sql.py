"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

from . import line_dedup, phrases, secret_scan, spelling, url_filter


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _hits(kind: str, rank: int, pattern: str, value: int, keep: str) -> str:
    """One row for each match: what lies between matches adds up to the places."""
    p = _quoted(pattern)
    return f"""
    SELECT doc_id, source, '{kind}' AS kind, {rank} AS rank, list_sum(list_transform(gaps[1:i], lambda x: length(x)))
             + coalesce(list_sum(list_transform(whole[1:i - 1], lambda x: length(x))), 0) AS start, length(whole[i]) AS size, vals[i] AS val
    FROM (SELECT doc_id, source, string_split_regex(t, {p}) AS gaps, whole, vals, unnest(range(1, len(whole) + 1)) AS i
          FROM (SELECT doc_id, source, t, regexp_extract_all(t, {p}, 0) AS whole, regexp_extract_all(t, {p}, {value}) AS vals FROM docs))
    WHERE {keep.format(v="vals[i]")}"""


#: RE2 knows no lookaround; longest runs are the same without it, and the digit is checked after.
TOKEN_RUN = "[A-Za-z0-9+/_=-]{20,}"

SECRETS = f"""
WITH docs AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
base AS ({_hits("assign", 0, secret_scan.ASSIGN, 2, "length({v}) >= 6")}
  UNION ALL {_hits("access", 1, secret_scan.ACCESS, 0, "true")}
  UNION ALL {_hits("hex", 2, secret_scan.HEX, 0, "true")}),
extra AS (SELECT * FROM ({_hits("token", 3, TOKEN_RUN, 0, "regexp_matches({v}, '[0-9]') AND regexp_matches({v}, '[A-Za-z]') AND len(list_distinct(string_split({v}, ''))) >= 10")}) e
  WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = e.doc_id AND b.start < e.start + e.size AND e.start < b.start + b.size)),
hits AS (SELECT * FROM base UNION ALL SELECT * FROM extra),
owned AS (SELECT val, count(DISTINCT source) AS n_owners, count(DISTINCT doc_id) AS n_repos FROM hits GROUP BY val),
judged AS (SELECT h.*, kind || ':' || start || ':' || (start + size) AS span, (n_owners >= {secret_scan.EXAMPLE_OWNERS} OR n_repos >= {secret_scan.EXAMPLE_REPOS}) AS example FROM hits h JOIN owned USING (val)),
rolled AS (SELECT doc_id,
    count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
    string_agg(span, ',' ORDER BY start, rank) FILTER (rank < 3) AS base_spans,
    string_agg(span, ',' ORDER BY start, rank) FILTER (rank < 3 OR NOT example) AS spans,
    count(*) FILTER (NOT example) AS n_live, count(*) FILTER (example AND rank < 3) AS n_example
  FROM judged GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
  sha256(coalesce(base_spans, '')) AS base_sha256, coalesce(spans, '') AS spans,
  coalesce(n_live, 0)::BIGINT AS n_live, coalesce(n_example, 0)::BIGINT AS n_example
FROM docs d LEFT JOIN rolled r ON r.doc_id = d.doc_id
"""

#: White space around a line, as a DuckDB expression.
BLANK = "' ' || chr(9) || chr(11) || chr(12) || chr(13)"

LINES = f"""
WITH body AS (SELECT page_id, lower(regexp_extract(coalesce(url, ''), {_quoted(line_dedup.HOST)}, 1)) AS host,
    string_split(regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), {_quoted(line_dedup.UNSEEN)}, '', 'g'),
      {_quoted(line_dedup.BLOCK)}, chr(10), 'g'), {_quoted(line_dedup.TAG)}, '', 'g'), chr(10)) AS lines FROM pages),
sites AS (SELECT host, count(*) AS pages FROM body GROUP BY host),
apart AS (SELECT page_id, host, unnest(lines) AS line, unnest(range(len(lines))) AS i FROM body),
bare AS (SELECT *, trim(line, {BLANK}) AS mark FROM apart),
often AS (SELECT host, mark FROM bare JOIN sites USING (host) WHERE mark <> ''
  GROUP BY host, mark, pages HAVING count(DISTINCT page_id) > {line_dedup.MAX_RATIO} * pages AND count(DISTINCT page_id) >= {line_dedup.LEAST_PAGES})
SELECT a.page_id, a.host, count(*) FILTER (a.mark <> '') AS n_lines, count(o.mark) AS n_dropped,
  coalesce(string_agg(a.line, chr(10) ORDER BY i) FILTER (o.mark IS NULL), '') AS text
FROM bare a LEFT JOIN often o ON o.host = a.host AND o.mark = a.mark GROUP BY a.page_id, a.host
"""

#: A-Z and a-z in DuckDB's translate().
CASES = f"'{url_filter.UPPER}', '{url_filter.LOWER}'"


def _grams(length: int) -> str:
    """Phrases of a length: each word with the ones behind it in its piece."""
    behind = "".join(f" || ' ' || lead(w, {j}) OVER p" for j in range(1, length))
    return f"SELECT lang, phrase, count(*) AS f FROM (SELECT lang, w{behind} AS phrase FROM words WINDOW p AS (PARTITION BY piece ORDER BY i)) WHERE phrase IS NOT NULL GROUP BY ALL"


def _phrases() -> str:
    levels = range(1, phrases.LONGEST + 1)
    counts = " UNION ALL ".join(f"SELECT * FROM ({_grams(n)}) WHERE f >= {phrases.LEAST}" for n in levels)
    inside = " UNION ALL ".join(
        f"SELECT lang, array_to_string(string_split(phrase, ' ')[{i}:{i + n - 1}], ' ') AS phrase, f FROM counts WHERE len(string_split(phrase, ' ')) = {m}"
        for m in levels for n in range(2, m) for i in range(1, m - n + 2)
    )
    return f"""
WITH pieces AS MATERIALIZED (SELECT row_number() OVER () AS piece, lang, s FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), {CASES}), '[.,;:!?\x0A-\x0D]')) AS s FROM documents)),
words AS MATERIALIZED (SELECT piece, lang, unnest(w) AS w, unnest(range(len(w))) AS i FROM (SELECT piece, lang, list_filter(string_split_regex(s, '[ \t]+'), lambda x: x <> '') AS w FROM pieces)),
totals AS (SELECT lang, count(*) AS n FROM words GROUP BY lang),
counts AS MATERIALIZED ({counts}),
candidates AS (SELECT *, string_split(phrase, ' ') AS ws FROM counts WHERE contains(phrase, ' ')),
cuts AS (SELECT c.*, k, array_to_string(ws[1:k], ' ') AS first, array_to_string(ws[k + 1:], ' ') AS rest FROM (SELECT *, unnest(range(1, len(ws))) AS k FROM candidates) c),
scored AS (SELECT c.lang, c.phrase, c.f AS a, x.f AS l, y.f AS r, ({phrases.MILLION}::HUGEINT * c.f * c.f) // (x.f::HUGEINT * y.f) AS score,
    row_number() OVER (PARTITION BY c.lang, c.phrase ORDER BY ({phrases.MILLION}::HUGEINT * c.f * c.f) // (x.f::HUGEINT * y.f), k) AS weakest
  FROM cuts c JOIN counts x ON x.lang = c.lang AND x.phrase = c.first JOIN counts y ON y.lang = c.lang AND y.phrase = c.rest),
longer AS (SELECT lang, phrase, max(f) AS f FROM ({inside}) GROUP BY lang, phrase),
kept AS (SELECT s.* FROM scored s LEFT JOIN longer o ON o.lang = s.lang AND o.phrase = s.phrase WHERE weakest = 1 AND (o.f IS NULL OR 100 * o.f < {phrases.INSIDE} * a)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM ranked JOIN totals USING (lang) WHERE rank <= {phrases.MOST}
"""


#: CRC-32 of a list of bytes: eight steps a byte with the reflected polynomial.
STEP = "CASE x & 1 WHEN 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END"

RUNS = "[a-zÀ-ÿ]{%d,}"

WORDS = f"""
WITH RECURSIVE crc(k, i, x) AS (SELECT 0, i, i::BIGINT FROM range(256) t(i) UNION ALL SELECT k + 1, i, {STEP} FROM crc WHERE k < 8),
steps AS MATERIALIZED (SELECT list(x ORDER BY i) AS t FROM crc WHERE k = 8),
runs AS (SELECT doc_id, run, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), {CASES}), '{RUNS % spelling.LEAST_LENGTH}')) AS run FROM documents) GROUP BY ALL),
bytes AS (SELECT doc_id, run, n, list_transform(regexp_extract_all(hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)), '..'), lambda h: ('0x' || h)::BIGINT) AS b FROM runs),
hashed AS (SELECT run, n, xor(list_reduce(list_prepend(4294967295::BIGINT, b), lambda c, x: xor(c >> 8, t[(1 + (xor(c, x) & 255))::INT])), 4294967295::BIGINT) AS h FROM bytes, steps),
words AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM (SELECT CASE WHEN h % {spelling.THINNED} = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run) + 2)::INT) ELSE run END AS word, n FROM hashed)
  WHERE length(word) >= {spelling.LEAST_LENGTH} GROUP BY word HAVING sum(n) >= {spelling.LEAST_COUNT}),
holes AS MATERIALIZED (SELECT word, n, p, left(word, p) || substr(word, p + 2) AS rest FROM (SELECT word, n, unnest(range(length(word)))::INT AS p FROM words)),
pairs AS (SELECT a.word, b.word AS near, b.n FROM holes a JOIN holes b ON a.rest = b.rest AND a.p = b.p AND a.word <> b.word
  UNION SELECT h.word, w.word, w.n FROM holes h JOIN words w ON w.word = h.rest UNION SELECT w.word, h.word, h.n FROM holes h JOIN words w ON w.word = h.rest),
best AS (SELECT word, near, n, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY n DESC, near) AS k FROM pairs),
formed AS MATERIALIZED (SELECT w.word, w.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN b.n >= {spelling.MORE} * w.n THEN near END AS form, CASE WHEN b.n >= {spelling.MORE} * w.n THEN b.n END AS form_n
  FROM words w LEFT JOIN best b ON b.word = w.word AND k = 1),
paths(word, top) AS (SELECT word, word FROM formed UNION ALL SELECT p.word, f.form FROM paths p JOIN formed f ON f.word = p.top WHERE f.form IS NOT NULL)
SELECT f.word, f.form, p.top AS root, f.n, f.n_near, f.form_n FROM formed f JOIN paths p ON p.word = f.word JOIN formed l ON l.word = p.top AND l.form IS NULL
"""


def _urls() -> str:
    u = url_filter
    known = [u.Rule.parse(r) for r in u.RULES]
    fits = lambda r: f"((host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}'))"
    rules = " UNION ALL ".join(f"SELECT page, '{r.name}' AS rule, '{r.verdict}' AS verdict FROM parts WHERE {fits(r)}" for r in known)
    levels, last = [], "level0"
    for k in range(u.DEPTH):
        levels.append(f"""
counts{k} AS (SELECT together, host, template, shape[{k + 1}] AS segment, sum(n) AS n FROM {last} WHERE len(shape) > {k} GROUP BY ALL),
kept{k} AS (SELECT * FROM (SELECT *, sum(n) OVER (PARTITION BY together, host, template) AS total FROM counts{k}) WHERE n >= {u.LEAST_ADDRESSES} AND n >= {u.LEAST_SHARE} * total),
level{k + 1} AS MATERIALIZED (SELECT v.* REPLACE (CASE WHEN len(v.shape) > {k} THEN v.template || '/' || coalesce(k.segment, '*') ELSE v.template END AS template)
  FROM {last} v LEFT JOIN kept{k} k ON k.together = v.together AND k.host = v.host AND k.template = v.template AND k.segment = v.shape[{k + 1}]),""")
        last = f"level{k + 1}"
    smooth = lambda b, n, prior: f"(({b}) + {u.PRIOR_WEIGHT} * ({prior})) / (({n}) + {u.PRIOR_WEIGHT})"
    return f"""
WITH rest AS (SELECT row_number() OVER () AS page, page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS s FROM pages),
parts AS MATERIALIZED (SELECT page, page_id, translate(regexp_extract(s, '^([^/?#]*)', 1), {CASES}) AS host, regexp_extract(s, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
ruled AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY page ORDER BY length(rule) DESC, rule) AS k FROM ({rules})) WHERE k = 1),
judged AS MATERIALIZED (SELECT p.*, rule, verdict, list_transform(string_split(regexp_replace(path, '^/', ''), '/'), lambda x: regexp_replace(x, '[0-9]+', '#', 'g')) AS segments FROM parts p LEFT JOIN ruled USING (page)),
shaped AS MATERIALIZED (SELECT * REPLACE (CASE WHEN len(segments) > {u.DEPTH} THEN list_append(segments[1:{u.DEPTH}], '**') ELSE segments END AS segments) FROM judged),
shapes AS (SELECT host, segments AS shape, count(*) AS n, count(*) FILTER (verdict = 'block') AS blocked, count(verdict) AS labelled FROM shaped GROUP BY ALL),
level0 AS MATERIALIZED (SELECT false AS together, *, '' AS template FROM shapes UNION ALL SELECT true, '', shape, sum(n), sum(blocked), sum(labelled), '' FROM shapes GROUP BY shape),
{"".join(levels)}
trees AS MATERIALIZED (SELECT * REPLACE (CASE WHEN len(shape) > {u.DEPTH} THEN template || '/**' ELSE template END AS template) FROM {last}),
overall AS (SELECT coalesce(sum(blocked)::DOUBLE / nullif(sum(labelled), 0), 0) AS share FROM trees WHERE together),
priors AS (SELECT template, {smooth("sum(blocked)::DOUBLE", "sum(labelled)::DOUBLE", "(SELECT share FROM overall)")} AS prior FROM trees WHERE together GROUP BY template),
templates AS (SELECT host, template, sum(blocked)::DOUBLE AS b, sum(labelled)::DOUBLE AS l FROM trees WHERE NOT together GROUP BY ALL),
named AS MATERIALIZED (SELECT *, CASE WHEN l = 0 OR abs(b * total - l * hits) > {u.ERRORS} * sqrt(l * hits * (total - hits)) THEN template ELSE '*' END AS branch FROM (SELECT *, sum(b) OVER h AS hits, sum(l) OVER h AS total FROM templates WINDOW h AS (PARTITION BY host))),
pooled AS (SELECT host, template, sum(b) OVER g AS bb, sum(l) OVER g AS bl FROM named WINDOW g AS (PARTITION BY host, branch)),
verdicts AS (SELECT t.host, t.shape, t.template, CASE WHEN {smooth("bb", "bl", "prior")} > {u.LIMIT} THEN 'block' ELSE 'allow' END AS verdict
  FROM trees t JOIN pooled p ON p.host = t.host AND p.template = t.template JOIN trees e ON e.together AND e.shape = t.shape JOIN priors q ON q.template = e.template WHERE NOT t.together)
SELECT page_id, s.host, path, rule, coalesce(s.verdict, v.verdict) AS verdict, template FROM shaped s JOIN verdicts v ON v.host = s.host AND v.shape = s.segments
"""


ORACLES = {"op1_secret_scan": SECRETS, "op5_line_dedup": LINES, "op11_phrases": _phrases(), "op12_spelling_variants": WORDS, "op13_url_filter": _urls()}
