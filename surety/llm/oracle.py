"""DuckDB SQL for the ``opN_*`` queries that SQL can express; it recomputes their results from the tables."""

from __future__ import annotations

from surety.llm import merkle, pii, url_filter

_BLANK = merkle.BLANK


def _fingerprint(text: str) -> str:
    sections = f"string_split({text}, chr(10) || chr(10))"
    paragraphs = "string_split(s, chr(10))"
    hashes = f"list_transform({paragraphs}, lambda p: sha256('p' || p))"
    root = f"sha256('r' || array_to_string(list_transform({sections}, lambda s: sha256('s' || array_to_string({hashes}, ','))), ','))"
    return f"{root} || '|' || array_to_string(list_transform({sections}, lambda s: array_to_string(list_transform({paragraphs}, lambda p: left(sha256('p' || p), 8)), '/')), ';')"


def _merkle() -> str:
    """Texts part into sections, paragraphs and leaves level by level; what both sides have is not opened."""

    def without(x: str, both: str) -> str:
        return f"list_filter({x}, lambda e: NOT list_contains({both}, e))"

    def pieces(x: str, separator: str) -> str:
        return f"list_distinct(flatten(list_transform({x}, lambda e: string_split(e, {separator}))))"

    word = f"'[{_BLANK}]*[^{_BLANK}]{{1,32}}|[{_BLANK}]+'"
    pairs = f"list_transform(regexp_extract_all(e, {word}), lambda w, i: coalesce(regexp_extract_all(e, {word})[i - 1], '') || chr(10) || w)"
    steps, weight = [], lambda x: f"coalesce(list_sum(list_transform({x}, lambda e: length(e))), 0)"
    leaf_weight = lambda x: f"coalesce(list_sum(list_transform({x}, lambda e: least({merkle.MOST_WEIGHT}, length(split_part(e, chr(10), 2))))), 0)"
    steps.append("both1 AS (SELECT *, list_distinct(string_split(a, chr(10) || chr(10))) AS xs, list_distinct(string_split(b, chr(10) || chr(10))) AS ys FROM pairs)")
    steps.append("both2 AS (SELECT *, list_intersect(xs, ys) AS ms FROM both1)")
    steps.append(f"both3 AS (SELECT *, {pieces(without('xs', 'ms'), 'chr(10)')} AS xp, {pieces(without('ys', 'ms'), 'chr(10)')} AS yp FROM both2)")
    steps.append("both4 AS (SELECT *, list_intersect(xp, yp) AS mp FROM both3)")
    leaves = lambda x: f"list_distinct(flatten(list_transform({without(x, 'mp')}, lambda e: {pairs})))"
    steps.append(f"both5 AS (SELECT *, {leaves('xp')} AS xl, {leaves('yp')} AS yl FROM both4)")
    steps.append(f"both6 AS (SELECT *, {weight('ms')} + {weight('mp')} AS w, {leaf_weight('xl')} AS wx, {leaf_weight('yl')} AS wy, {leaf_weight('list_intersect(xl, yl)')} AS wb FROM both5)")
    steps.append("alike AS (SELECT doc_id, kind, CASE WHEN a = b THEN 1.0::DOUBLE WHEN 2 * w + wx + wy = 0 THEN 0.0::DOUBLE WHEN 2 * wb = wx + wy THEN 1 - 1.0::DOUBLE / (2 * w + wx + wy + 1) ELSE (2 * (w + wb))::DOUBLE / (2 * w + wx + wy) END AS near FROM both6)")
    docs = """t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
        o AS (SELECT *, coalesce(lead(text) OVER w, first_value(text) OVER w) AS next_text FROM t WINDOW w AS (ORDER BY doc_id NULLS FIRST)),
        d AS (SELECT *, left(text, length(text) - length(text) // 2) || left(next_text, length(text) // 2) AS edited FROM o),
        pairs AS (SELECT doc_id, 'edited' AS kind, text AS a, edited AS b FROM d UNION ALL SELECT doc_id, 'next', text, next_text FROM d)"""
    return f"""WITH {docs}, {", ".join(steps)}
        SELECT d.doc_id, length(text) AS n_chars, sha256(edited) AS edited_sha256, {_fingerprint("text")} AS fingerprint, {_fingerprint("edited")} AS edited_fingerprint, e.near AS near_edited, n.near AS near_next
        FROM d JOIN alike e ON e.doc_id = d.doc_id AND e.kind = 'edited' JOIN alike n ON n.doc_id = d.doc_id AND n.kind = 'next'"""


_COVER = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS HUGEINT)) AS e FROM embeddings
        WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    scored AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(c.e, lambda x, i: x * q.e[i])) AS BIGINT) AS score
        FROM (SELECT DISTINCT * FROM v WHERE vec_id % 50 = 0) q JOIN v c ON c.vec_id <> q.vec_id AND len(c.e) = len(q.e))
    SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM scored) WHERE r <= 5"""



def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def urls(rules) -> str:
    """Links read tag by tag, resolved, and followed in both directions."""
    q = _quoted
    host = lambda u: f"coalesce(translate(regexp_extract({u}, {q(url_filter.SPLIT)}, 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '')"
    path = lambda u: f"coalesce(regexp_extract({u}, {q(url_filter.SPLIT)}, 2), '')"
    query = lambda u: f"coalesce(regexp_extract({u}, {q(url_filter.QUERY)}, 1), '')"
    address = lambda h, p, s: f"CASE WHEN {h} <> '' THEN {h} || CASE WHEN {p} = '' THEN '/' ELSE {p} END || CASE WHEN {s} = '' THEN '' ELSE '?' || {s} END END"

    def first(value) -> str:
        fits = [f"WHEN (host = {q(r.host)} OR ends_with(host, {q('.' + r.host)})) AND starts_with(path, {q(r.path)}) THEN {q(value(r))}" for r in sorted(rules, key=lambda r: (len(r.host + r.path), r), reverse=True)]
        return f"CASE {' '.join(fits)} END"

    def value(tag: str, attribute: str) -> str:
        out = f"regexp_replace(regexp_extract({tag}, {q(attribute)}, 1), {q(url_filter.QUOTES)}, '', 'g')"
        for entity, letter in url_filter.ENTITIES:
            out = f"regexp_replace({out}, {q(entity)}, {q(letter)}, 'g')"
        return out

    def undotted(p: str) -> str:
        kept = f"list_reduce(string_split(substr({p}, 2), '/'), lambda a, x: CASE WHEN x = '..' THEN regexp_replace(a, '/?[^/]*$', '') WHEN x = '.' THEN a ELSE a || '/' || x END, '')"
        return f"CASE WHEN regexp_matches({p}, {q(url_filter.DOTS)}) THEN {kept} || CASE WHEN regexp_matches({p}, '/\\.\\.?$') THEN '/' ELSE '' END ELSE {p} END"

    def resolved(to: str, h: str, p: str, s: str) -> str:
        whole = f"CASE WHEN starts_with({to}, '//') THEN 'http:' || {to} WHEN regexp_matches({to}, {q(url_filter.ABSOLUTE)}) THEN {to} END"
        bare = f"regexp_extract({to}, '(?s)^[^?#]*')"
        folder = f"regexp_replace({p}, '[^/]*$', '')"
        joined = f"CASE WHEN {folder} = '' THEN '/' ELSE {folder} END || {bare}"
        below = f"CASE WHEN {bare} = '' THEN {p} WHEN starts_with({bare}, '/') THEN {undotted(bare)} ELSE {undotted(f'({joined})')} END"
        own = f"CASE WHEN regexp_matches({to}, {q(url_filter.SCHEME)}) THEN '' ELSE {h} END"
        asked = f"CASE WHEN starts_with({to}, '#') OR {to} = '' THEN {s} ELSE {query(to)} END"
        return f"{{'host': CASE WHEN {whole} IS NOT NULL THEN {host(whole)} ELSE {own} END, 'path': CASE WHEN {whole} IS NOT NULL THEN {path(whole)} ELSE {below} END, 'query': CASE WHEN {whole} IS NOT NULL THEN {query(whole)} ELSE {asked} END}}"

    refresh = f"regexp_replace(regexp_extract({value('t', url_filter.CONTENT)}, {q(url_filter.TARGET)}, 1), {q(url_filter.QUOTES)}, '', 'g')"
    return f"""WITH RECURSIVE found AS (SELECT page_id, html, {host('url')} AS host, {path('url')} AS path, {query('url')} AS query FROM pages),
        judged AS (SELECT page_id, html, host, path, query, {address('host', 'path', 'query')} AS key, {first(lambda r: r.host + r.path)} AS rule, {first(lambda r: r.verdict)} AS ruled FROM found),
        tagged AS (SELECT key, host, path, query, regexp_extract_all(html, {q(url_filter.TAGS)}) AS tags FROM judged WHERE host <> '' AND (contains(lower(html), 'canonical') OR contains(lower(html), 'refresh'))),
        based AS (SELECT *, coalesce({value(f"list_filter(tags, lambda t: regexp_matches(t, {q(url_filter.BASE)}))[1]", url_filter.HREF)}, '') AS base_text FROM tagged),
        bases AS (SELECT *, CASE WHEN base_text <> '' THEN {resolved('base_text', 'host', 'path', 'query')} END AS base FROM based),
        held AS (SELECT key, tags, CASE WHEN base.host <> '' THEN base ELSE {{'host': host, 'path': path, 'query': query}} END AS base FROM bases),
        led AS (SELECT key, base.host AS h, base.path AS p, base.query AS s, unnest(list_concat(list_transform(list_filter(tags, lambda t: regexp_matches(t, {q(url_filter.CANONICAL)})), lambda t: {value('t', url_filter.HREF)}),
            list_transform(list_filter(tags, lambda t: regexp_matches(t, {q(url_filter.REFRESH)})), lambda t: {refresh}))) AS link FROM held),
        ends AS (SELECT key, unnest({resolved('link', 'h', 'p', 's')}) FROM led WHERE link <> ''),
        targets AS (SELECT key, {address('host', 'path', 'query')} AS target, {first(lambda r: r.verdict)} AS ruled FROM ends WHERE host <> ''),
        edges AS (SELECT key AS a, target AS b FROM targets UNION SELECT target, key FROM targets),
        reach(a, b) AS (SELECT a, b FROM edges UNION SELECT r.a, e.b FROM reach r JOIN edges e ON e.a = r.b),
        said AS (SELECT key, ruled FROM judged WHERE key IS NOT NULL AND ruled IS NOT NULL UNION SELECT target, ruled FROM targets WHERE ruled IS NOT NULL),
        blocked AS (SELECT a AS key FROM reach JOIN said ON said.key = reach.b GROUP BY a HAVING bool_or(ruled = 'block') AND NOT bool_or(ruled = 'allow'))
        SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN b.key IS NOT NULL THEN 'block' END, 'allow') AS verdict, ruled IS NULL AND b.key IS NOT NULL AS by_alias FROM judged j LEFT JOIN blocked b ON b.key = j.key"""


def _pii() -> str:
    """Every match and the text between matches, numbered; positions are running sums."""
    figures = "regexp_replace(m, '[^0-9]', '', 'g')"
    luhn = f"list_sum(list_transform(string_split(reverse({figures}), ''), lambda x, i: CASE WHEN i % 2 = 1 THEN CAST(x AS INT) WHEN CAST(x AS INT) > 4 THEN CAST(x AS INT) * 2 - 9 ELSE CAST(x AS INT) * 2 END)) % 10 = 0"
    bare = "replace(m, ' ', '')"
    numbers = f"array_to_string(list_transform(string_split({bare}[5:] || {bare}[:4], ''), lambda x: CASE WHEN x BETWEEN '0' AND '9' THEN x ELSE CAST(ascii(x) - 55 AS VARCHAR) END), '')"
    checks = {
        "none": "TRUE",
        "parts": "len(list_filter(string_split(m, '.'), lambda x: length(ltrim(x, '0')) > 3 OR CAST(right(x, 3) AS INT) > 255)) = 0",
        "luhn": f"length({figures}) BETWEEN 16 AND 19 AND {luhn}",
        "digits": f"length({figures}) BETWEEN 8 AND 15",
        "mod97": f"length({bare}) BETWEEN 15 AND 34 AND list_reduce(list_transform(string_split({numbers}, ''), lambda x: CAST(x AS INT)), lambda a, x: (a * 10 + x) % 97) = 1",
    }
    parts = []
    for order, kind in enumerate((*pii.BASE, *pii.ADDED)):
        near = f"(regexp_matches(before, {_quoted(pii.context_of(kind))}) OR regexp_matches(after, {_quoted(pii.context_of(kind))}))"
        score = f"CASE WHEN {near} THEN {kind.raised} ELSE {kind.score} END"
        good = checks[kind.check]
        if kind.not_before:
            good += f" AND NOT regexp_matches(before, '[{kind.not_before}]\\z') AND NOT regexp_matches(after, '^[{kind.not_after}]')"
        if kind in pii.ADDED:
            good += f" AND {score} >= {pii.THRESHOLD}"
        pattern = _quoted(kind.plain)
        pieces = f"SELECT doc_id, text, unnest(string_split_regex(text, {pattern})) AS gap, unnest(list_concat(regexp_extract_all(text, {pattern}), [NULL])) AS m, unnest(range(len(regexp_extract_all(text, {pattern})) + 1)) AS k FROM t"
        placed = f"SELECT doc_id, text, m, CAST(sum(length(gap) + coalesce(length(m), 0)) OVER (PARTITION BY doc_id ORDER BY k) AS BIGINT) AS e FROM ({pieces})"
        around = f"SELECT doc_id, m, e - length(m) AS s, e, substr(text, greatest(e - length(m) - {pii.CONTEXT_CHARS}, 0) + 1, least(e - length(m), {pii.CONTEXT_CHARS})) AS before, substr(text, e + 1, {pii.CONTEXT_CHARS}) AS after FROM ({placed}) WHERE m IS NOT NULL"
        parts.append(f"SELECT doc_id, {order} AS o, '{kind.name}' AS kind, s, e, {score} AS score FROM ({around}) WHERE {good}")
    base = len(pii.BASE)
    counts = ", ".join(f"count(*) FILTER (WHERE o = {o}) AS n_{kind.name}" for o, kind in enumerate(pii.BASE))
    return f"""WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), spans AS ({" UNION ALL ".join(parts)}),
        kept AS (SELECT * FROM spans x WHERE o < {base} OR NOT EXISTS (SELECT 1 FROM spans b WHERE b.doc_id = x.doc_id AND b.o < {base} AND b.s < x.e AND x.s < b.e)),
        told AS (SELECT doc_id, {counts}, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY o, s) FILTER (WHERE o < {base}) AS base, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY o, s) AS spans, string_agg(CAST(score AS VARCHAR), ',' ORDER BY o, s) AS scores FROM kept GROUP BY doc_id)
        SELECT doc_id, {", ".join(f"coalesce(n_{k.name}, 0) AS n_{k.name}" for k in pii.BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(scores, '') AS scores FROM t LEFT JOIN told USING (doc_id)"""


#: Shingles as texts, pairs by a shared shingle, components by reachability.
_JOIN = """WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
    s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[]) ELSE list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda k: array_to_string(w[k:k + 4], ' '))) END AS s FROM w),
    e AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
    p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
    edges AS (SELECT a, b FROM p UNION SELECT b, a FROM p),
    reach(a, b) AS (SELECT a, b FROM edges UNION SELECT r.a, e.b FROM reach r JOIN edges e ON e.a = r.b)
    SELECT s.doc_id, CAST(len(s) AS BIGINT) AS n_shingles, least(s.doc_id, coalesce(m.b, s.doc_id)) AS component_id FROM s LEFT JOIN (SELECT a, min(b) AS b FROM reach GROUP BY a) m ON m.a = s.doc_id"""

#: The rules of the URL query.
URL_RULES = (
    url_filter.Rule("com", "/en/", "block"),
    url_filter.Rule("example.com", "/en/7", "allow"),
    url_filter.Rule("net", "/de/", "allow"),
    url_filter.Rule("example.net", "/de/8", "block"),
    url_filter.Rule("org", "/es/", "block"),
)

SQL: dict[str, str] = {"op2_redirects": urls(URL_RULES), "op4_merkle": _merkle(), "op5_ngram_join": _JOIN, "op9_pii": _pii(), "op10_cover_tree": _COVER}
