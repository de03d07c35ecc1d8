r"""The registered queries in DuckDB SQL, for the comparison of results.

Each query is written from the meaning of its operator, not from the Spark plan: chunk
bounds by the start rule, distances of path pairs by their common prefix, as-of by lag.
"""

from __future__ import annotations

_VIEWS = {
    "docs": (
        r"""SELECT doc_id, '/' || source || '/' || lang || '/' || doc_id || '.txt' AS path, lang, source,
        CASE WHEN text = '' THEN []::VARCHAR[]
             ELSE string_split_regex(regexp_replace(text, '\r?\n$', ''), '\r?\n') END AS lines
        FROM documents""",
        (),
    ),
    "lines": (
        """SELECT doc_id, path, lang, source, len(lines) AS n, unnest(range(len(lines))) AS line_no,
        unnest(lines) AS line FROM docs""",
        ("docs",),
    ),
    "chunks": (
        """SELECT sha256(concat_ws(chr(1), path, k * 3, least(k * 3 + 5, n))) AS id, path,
        k * 3 AS start_line, least(k * 3 + 5, n) AS end_line, lines[k * 3 + 1 : least(k * 3 + 5, n)] AS text
        FROM (SELECT path, len(lines) AS n, lines, unnest(range(len(lines))) AS k FROM docs)
        WHERE k = 0 OR ((k - 1) * 3 + 5 <= n AND k * 3 < n)""",
        ("docs",),
    ),
    "symbols": (
        """SELECT doc_id * 4294967296 + line_no AS symbol_id, path, name, kind,
        CASE WHEN kind = 'Enum' THEN source END AS container_name, line_no AS start_line,
        coalesce(lead(line_no) OVER (PARTITION BY path ORDER BY line_no), n) - 1 AS end_line, 0::BIGINT AS start_character,
        length(name)::BIGINT AS end_character, line, lang
        FROM (SELECT *, CASE length(name) % 3 WHEN 0 THEN 'Struct' WHEN 1 THEN 'Function' ELSE 'Enum' END AS kind
              FROM (SELECT *, regexp_extract(line, '^([A-Z][a-z]+)', 1) AS name FROM lines))
        WHERE name <> ''""",
        ("lines",),
    ),
    "coded": (
        """SELECT s.*, array_to_string(d.lines[s.start_line + 1 : s.end_line + 1], chr(10)) AS code
        FROM symbols s JOIN docs d USING (path)""",
        ("symbols", "docs"),
    ),
    "hovers": (
        """SELECT path, start_line AS line, length(name)::BIGINT - 1 AS character,
        CASE WHEN kind = 'Function' THEN name || chr(10) || line ELSE line END AS hover
        FROM symbols WHERE kind <> 'Enum' OR length(line) > 200""",
        ("symbols",),
    ),
    "texts": (
        """SELECT 'c' || id AS owner, n, pos, line FROM (SELECT id, len(text) AS n, unnest(range(len(text))) AS pos,
            unnest(text) AS line FROM chunks)
        UNION ALL
        SELECT 'q' || item_id, n, pos, line FROM (SELECT item_id, len(ls) AS n, unnest(range(len(ls))) AS pos,
            unnest(ls) AS line FROM (SELECT item_id, string_split(text, chr(10)) AS ls FROM benchmark))""",
        ("chunks",),
    ),
    "codes": (
        r"""SELECT owner, n, pos, c % 64 AS dim, sum(CASE WHEN c < 64 THEN 1 ELSE -1 END)::DOUBLE AS v
        FROM (SELECT owner, n, pos, ('0x' || substr(md5(w), 1, 8))::BIGINT % 128 AS c
              FROM (SELECT owner, n, pos, unnest(regexp_extract_all(lower(line), '[^ \t\r\n\f\v]+')) AS w FROM texts))
        GROUP BY owner, n, pos, dim""",
        ("texts",),
    ),
    "line_vectors": (
        """SELECT owner, n, pos, dim, coalesce(v / nullif(norm, 0), 0) AS v FROM codes
        JOIN (SELECT owner, pos, sqrt(sum(v * v)) AS norm FROM codes GROUP BY owner, pos) USING (owner, pos)""",
        ("codes",),
    ),
    "owners": ("SELECT DISTINCT owner FROM texts", ("texts",)),
    "means": (
        """SELECT owner, list(coalesce(v, 0) ORDER BY dim) AS vec
        FROM owners CROSS JOIN (SELECT unnest(range(64)) AS dim)
        LEFT JOIN (SELECT owner, dim, sum(v ORDER BY pos) / any_value(n) AS v FROM line_vectors GROUP BY owner, dim)
             USING (owner, dim)
        GROUP BY owner""",
        ("line_vectors", "owners"),
    ),
    "hits": (
        """SELECT query_id, id, path, start_line, end_line, rank FROM (
            SELECT q.item_id AS query_id, c.id, c.path, c.start_line, c.end_line,
                   row_number() OVER (PARTITION BY q.item_id
                       ORDER BY round(list_distance(mq.vec, mc.vec), 9), c.id) AS rank
            FROM benchmark q JOIN means mq ON mq.owner = 'q' || q.item_id
            CROSS JOIN chunks c JOIN means mc ON mc.owner = 'c' || c.id)
        WHERE rank <= 10""",
        ("means", "chunks"),
    ),
    "semantic": (
        """SELECT symbol_id FROM (
            SELECT is_symbol, symbol_id,
                   lag(is_symbol) OVER (PARTITION BY path ORDER BY start_line, is_symbol, symbol_id) AS before
            FROM (SELECT path, start_line, 0 AS is_symbol, -1 AS symbol_id FROM hits
                  UNION ALL SELECT path, start_line, 1, symbol_id FROM symbols
                  WHERE path IN (SELECT path FROM hits)))
        WHERE is_symbol = 1 AND before = 0""",
        ("hits", "symbols"),
    ),
    "fuzzy": (
        """SELECT symbol_id FROM (
            SELECT symbol_id, row_number() OVER (PARTITION BY p ORDER BY length(name), name, symbol_id) AS rank
            FROM symbols, (VALUES ('t.*h.*n'), ('e.*r.*o')) AS pats(p) WHERE regexp_matches(lower(name), p))
        WHERE rank <= 32""",
        ("symbols",),
    ),
    "request": (
        """SELECT l.list, l.section, s.*, h.hover FROM (
            SELECT 'semantic' AS list, 0 AS section, symbol_id FROM semantic
            UNION ALL SELECT 'fuzzy', 1, symbol_id FROM fuzzy) l
        JOIN coded s USING (symbol_id)
        LEFT JOIN hovers h ON h.path = s.path AND h.line = s.start_line AND h.character = length(s.name) - 1""",
        ("semantic", "fuzzy", "coded", "hovers"),
    ),
    "request_rules": (
        """SELECT list, section, position, text FROM (
            SELECT list, section, unnest([0, 1]) AS position,
                   unnest(['Look for an existing symbol first.', 'Keep one symbol per concern.']) AS text
            FROM (VALUES ('semantic', 0), ('fuzzy', 1)) AS names(list, section))
        UNION ALL
        SELECT list, section, 2, 'Sources 0 to 4 open lines with ' || string_agg(name, ', ' ORDER BY path, start_line, symbol_id) || '; quote one of them.'
        FROM request WHERE {rule0} GROUP BY list, section
        UNION ALL SELECT DISTINCT list, section, 3, 'Capitalised openings stay as they are.' FROM request WHERE {rule0}
        UNION ALL
        SELECT list, section, 4, 'Names ' || string_agg(name, ', ' ORDER BY path, start_line, symbol_id) || ' of '
               || string_agg(kind, ', ' ORDER BY path, start_line, symbol_id) || '.'
        FROM request WHERE {rule1} GROUP BY list, section
        UNION ALL SELECT DISTINCT list, section, 6, 'First text.' FROM request WHERE {rule3}
        UNION ALL SELECT DISTINCT list, section, 7, 'Second text.' FROM request WHERE {rule3}""",
        ("request",),
    ),
    "page_paths": (
        r"""SELECT page_id, html, url, '/' || regexp_replace(regexp_replace(regexp_replace(url, '^[a-z]+://', ''),
        '[?#].*$', ''), '/+$', '') AS path FROM pages""",
        (),
    ),
    "links": (
        """SELECT page_id, path, unnest(hrefs) AS symbol_id, generate_subscripts(hrefs, 1) AS nth
        FROM (SELECT page_id, path, regexp_extract_all(html, 'href="(/[^"]*)"', 1) AS hrefs FROM page_paths)""",
        ("page_paths",),
    ),
    "defs": (
        """SELECT symbol_id, ltrim(symbol_id, '/') AS name,
        CASE length(symbol_id) % 3 WHEN 0 THEN 'Struct' WHEN 1 THEN 'Function' ELSE 'Enum' END AS kind,
        arg_min(path, (page_id, nth)) AS path, min((page_id, nth)) AS site FROM links GROUP BY symbol_id""",
        ("links",),
    ),
    "uses": (
        """SELECT l.symbol_id, l.path, count(*)::BIGINT AS uses FROM links l JOIN defs d USING (symbol_id)
        WHERE (l.page_id, l.nth) <> d.site GROUP BY l.symbol_id, l.path""",
        ("links", "defs"),
    ),
    "pairs": (
        """SELECT a.symbol_id, a.path, a.uses, b.uses AS weight, string_split(substr(a.path, 2), '/') AS pa,
        string_split(substr(b.path, 2), '/') AS pb FROM uses a JOIN uses b USING (symbol_id)""",
        ("uses",),
    ),
    "sums": (
        """SELECT symbol_id, path, any_value(uses) AS uses, sum(weight * (len(pa) + len(pb) - 2 * len(list_filter(
        range(1, least(len(pa), len(pb)) + 1), lambda i: pa[1:i] = pb[1:i]))))::BIGINT AS total
        FROM pairs GROUP BY symbol_id, path""",
        ("pairs",),
    ),
    "refs": (
        """SELECT symbol_id, name, path, line, character FROM (
            SELECT path, line, character, name FROM (
                SELECT path, line_no AS line, token AS name, nth, coalesce(sum(length(token)) OVER (
                    PARTITION BY path, line_no ORDER BY nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS character
                FROM (SELECT path, line_no, unnest(tokens) AS token, generate_subscripts(tokens, 1) AS nth FROM (
                    SELECT path, line_no, regexp_extract_all(line, '[A-Za-z_][A-Za-z0-9_]*|[^A-Za-z_]+') AS tokens FROM lines)))
            WHERE name IN (SELECT name FROM symbols) AND (path, line, character) NOT IN (
                SELECT (path, start_line, start_character) FROM symbols))
        JOIN (SELECT u.name, u.path, arg_min(d.symbol_id, (-CASE WHEN d.path = u.path THEN 3 WHEN d.source <> u.source THEN 0
                  WHEN d.lang <> u.lang THEN 1 ELSE 2 END, d.path, d.start_line, d.symbol_id)) AS symbol_id
              FROM (SELECT l.path, any_value(source) AS source, any_value(lang) AS lang, unnest(list_distinct(flatten(list(
                  regexp_extract_all(line, '[A-Za-z_][A-Za-z0-9_]*'))))) AS name FROM lines l GROUP BY l.path) u
              JOIN (SELECT name, path, split_part(path, '/', 2) AS source, lang, min(start_line) AS start_line,
                    arg_min(symbol_id, start_line) AS symbol_id FROM symbols GROUP BY ALL) d USING (name)
              GROUP BY u.name, u.path) meant USING (name, path)""",
        ("lines", "symbols"),
    ),
    "scan_uses": ("SELECT symbol_id, path, count(*)::BIGINT AS uses FROM refs GROUP BY symbol_id, path", ("refs",)),
    "arrived": (
        """SELECT *, ts < (SELECT max(f.ts) FROM turned f WHERE f.turn < t.turn) - INTERVAL 10 MINUTE AS late FROM turned t""",
        ("turned",),
    ),
    "turned": (
        """SELECT *, least(event_id * 4 // (max(event_id) OVER () + 1) + CASE WHEN event_id % 50 = 7 THEN 1 ELSE 0 END, 3) AS turn
        FROM feed""",
        ("feed",),
    ),
    "bursts": (
        """SELECT path, min(ts) AS first_ts, max(ts) AS last_ts, count(*)::BIGINT AS events,
               arg_max(kind, (ts, event_id)) AS kind
        FROM (SELECT *, sum(opened) OVER (PARTITION BY path ORDER BY ts, event_id) AS burst
              FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY path ORDER BY ts, event_id)
                                        <= INTERVAL 1 HOUR THEN 0 ELSE 1 END AS opened FROM accepted))
        GROUP BY path, burst""",
        ("accepted",),
    ),
    "feed": (
        """SELECT event_id, path, ts, CASE event_type WHEN 'signup' THEN 'create' WHEN 'error' THEN 'remove'
        WHEN 'view' THEN 'access' WHEN 'click' THEN 'modify' WHEN 'purchase' THEN 'modify' ELSE 'other' END AS kind
        FROM events JOIN docs ON doc_id = user_id""",
        ("docs",),
    ),
    "accepted": ("SELECT * FROM feed WHERE kind IN ('create', 'modify', 'remove')", ("feed",)),
    "centers": (
        """SELECT label AS query_id, list(m ORDER BY dim) AS vec FROM (
            SELECT label, dim, round(avg(x), 6) AS m FROM (
                SELECT label, unnest(range(64)) AS dim, unnest(embedding)::DOUBLE AS x FROM embeddings)
            GROUP BY label, dim) GROUP BY label""",
        (),
    ),
    "recut": (
        """SELECT sha256(concat_ws(chr(1), path, k * 5, least(k * 5 + 5, n))) AS id, path, k * 5 AS start_line,
        least(k * 5 + 5, n) AS end_line, 'new' AS version
        FROM (SELECT path, len(lines) AS n, unnest(range(len(lines))) AS k FROM docs WHERE lang = 'de')
        WHERE k * 5 < n""",
        ("docs",),
    ),
}

# The placement of symbols by the references that a scan finds.
_VIEWS["scan_pairs"] = (_VIEWS["pairs"][0].replace("uses a JOIN uses b", "scan_uses a JOIN scan_uses b"), ("scan_uses",))
_VIEWS["scan_sums"] = (_VIEWS["sums"][0].replace("FROM pairs", "FROM scan_pairs"), ("scan_pairs",))

# The rules of chunkloom.plans.tables.RULES as predicates.
_RULES = {
    "rule0": "kind = 'Struct' AND regexp_matches(name, '^[A-M]') AND regexp_matches(path, '^/src[0-4]/.*$')",
    "rule1": "kind IN ('Enum', 'Function') AND regexp_matches(path, '/(en|de)/[^/]*[.]txt$')"
    " AND regexp_matches(code, 'tion[ .,]|ung ')",
    "rule3": "kind = 'Enum' AND name LIKE 'T%'",
}


def _fill(sql: str) -> str:
    for key, text in _RULES.items():
        sql = sql.replace("{" + key + "}", text)
    return sql


def _with(views: str, body: str) -> str:
    """``body`` with the views it names, in the order of their needs."""
    order: list[str] = []

    def need(name: str) -> None:
        for other in _VIEWS[name][1]:
            need(other)
        if name not in order:
            order.append(name)

    for name in views.split():
        need(name)
    ctes = ",\n".join(f"{name} AS MATERIALIZED ({_fill(_VIEWS[name][0])})" for name in order)
    return f"WITH {ctes}\n{_fill(body)}"


def _vector_text(vector: str) -> str:
    return f"array_to_string(list_transform({vector}, lambda x: floor(x * 1e6 + 0.5)::BIGINT), ',')"


def _stamp(ts: str) -> str:
    return f"strftime({ts}, '%Y-%m-%d %H:%M:%S.%f')"


_SYMBOL = "symbol_id, path, name, kind, start_line, end_line"
_BURSTS = f"path, {_stamp('first_ts')} AS first_ts, {_stamp('last_ts')} AS last_ts, events, kind"


_ROW_QUESTIONS = "SELECT vec_id::BIGINT AS query_id, embedding::DOUBLE[] AS vec FROM embeddings WHERE vec_id % 20 = 0"


def _knn(distance: str) -> str:
    return f"""SELECT query_id, id, rank, round(d, 6) + 0.0 AS distance FROM (
        SELECT query_id, id, d, row_number() OVER (PARTITION BY query_id ORDER BY d, id) AS rank FROM (
            SELECT query_id, vec_id AS id, round({distance}, 9) AS d
            FROM ({_ROW_QUESTIONS}) CROSS JOIN (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)))
        WHERE rank <= 10"""


def _centers(group: str) -> str:
    return f"""SELECT query_id, list(m ORDER BY dim) AS vec FROM (
        SELECT query_id, dim, round(avg(x), 6) AS m FROM (
            SELECT {group} AS query_id, unnest(range(64)) AS dim, unnest(embedding)::DOUBLE AS x FROM embeddings)
        GROUP BY query_id, dim) GROUP BY query_id"""


def _after_changes(sql: str) -> str:
    """The same over the documents that the change feed leaves: those whose last event does not remove them."""
    docs, feed, accepted = (_VIEWS[name][0] for name in ("docs", "feed", "accepted"))
    left = f"""all_docs AS MATERIALIZED ({docs}),
feed AS MATERIALIZED ({feed.replace("JOIN docs", "JOIN all_docs")}),
accepted AS MATERIALIZED ({accepted}),
docs AS MATERIALIZED (SELECT * FROM all_docs WHERE path NOT IN (
    SELECT path FROM accepted GROUP BY path HAVING arg_max(kind, (ts, event_id)) = 'remove'))"""
    whole = f"docs AS MATERIALIZED ({docs})"
    if whole not in sql:
        raise ValueError("the query does not read docs")
    return sql.replace(whole, left)


def _in_cells(group: str, probes: int) -> str:
    """Search in the nearest cells, which lie around the means of groups of vectors."""
    return f"""WITH centers AS MATERIALIZED ({_ROW_QUESTIONS}),
base AS MATERIALIZED (SELECT vec_id AS id, embedding::DOUBLE[] AS e FROM embeddings),
seeds AS MATERIALIZED (SELECT row_number() OVER (ORDER BY query_id) AS cell, vec AS s FROM ({_centers(group)})),
assigned AS MATERIALIZED (SELECT id, arg_min(cell, (round(list_distance(e, s), 9), cell)) AS cell
    FROM base CROSS JOIN seeds GROUP BY id),
probed AS MATERIALIZED (SELECT query_id, cell FROM (
    SELECT query_id, cell, row_number() OVER (PARTITION BY query_id
        ORDER BY round(list_distance(vec, s), 9), cell) AS r FROM centers CROSS JOIN seeds) WHERE r <= {probes})
SELECT query_id, id, rank, round(d, 6) + 0.0 AS distance FROM (
    SELECT query_id, id, d, row_number() OVER (PARTITION BY query_id ORDER BY d, id) AS rank FROM (
        SELECT c.query_id::BIGINT AS query_id, b.id, round(list_distance(c.vec, b.e), 9) AS d
        FROM centers c JOIN probed p USING (query_id) JOIN assigned a USING (cell) JOIN base b USING (id)))
WHERE rank <= 10"""


def _fuzzy(matches: str, score: str, patterns: str) -> str:
    return _with(
        "symbols",
        f"""SELECT pattern_id::BIGINT AS pattern_id, pattern, rank, score, symbol_id, name FROM (
            SELECT *, row_number() OVER (PARTITION BY pattern_id ORDER BY score, length(name), name, symbol_id) AS rank
            FROM (SELECT *, ({score})::BIGINT AS score FROM symbols, (VALUES {patterns}) AS pats(pattern_id, pattern)
                  WHERE {matches}))
        WHERE rank <= 32""",
    )


def _best(pick: str) -> str:
    return _with(
        "sums",
        f"""SELECT symbol_id, path, total FROM (
            SELECT *, {pick}(total) OVER (PARTITION BY symbol_id) AS best FROM sums) WHERE total = best""",
    )


_PARENT = r"""CASE WHEN regexp_replace(path, '/[^/]*$', '') = '' THEN '/' ELSE regexp_replace(path, '/[^/]*$', '') END"""

_MARKDOWN = """'---' || chr(10) || chr(10) || '- **Name:** `' || name || '`' || chr(10) || '- **Kind:** `' || kind || '`'
|| chr(10) || '- **Container:** ' || coalesce(nullif(container_name, ''), '(none)') || chr(10) || '- **Location:**'
|| chr(10) || '    - URI: `' || 'file://' || path || '`' || chr(10) || '    - Range: lines ' || (start_line + 1)
|| '-' || (end_line + 1) || ', columns ' || (start_character + 1) || '-' || (end_character + 1) || chr(10)
|| CASE WHEN code <> '' THEN '- **Hover:** ' || coalesce(nullif(hover, ''), '(none)') || chr(10) || '- **Code:**'
|| chr(10) || '```' || chr(10) || code || chr(10) || '```' || chr(10) ELSE '' END"""

_LIVE = """SELECT c.* FROM chunks c LEFT JOIN (SELECT path, arg_max(kind, (ts, event_id)) AS kind FROM accepted
GROUP BY path) a USING (path) WHERE a.kind IS NULL OR a.kind <> 'remove'"""

_RULE_MATCHES = """SELECT 0::BIGINT AS rule_pos, * FROM coded WHERE {rule0}
UNION ALL SELECT 1, * FROM coded WHERE {rule1} UNION ALL SELECT 3, * FROM coded WHERE {rule3}
UNION ALL SELECT 4, * FROM coded WHERE {rule3}"""

# Names of a rule in parts per file and line segment; later parts start with the separator.
_RULE_PARTS = f"""matched AS MATERIALIZED (SELECT *, start_line // 4096 AS segment FROM ({_RULE_MATCHES})),
parts AS MATERIALIZED (SELECT rule_pos, path, segment, string_agg(name, ', ' ORDER BY start_line, symbol_id) AS names,
    string_agg(kind, ', ' ORDER BY start_line, symbol_id) AS kinds,
    row_number() OVER (PARTITION BY rule_pos ORDER BY path, segment) AS nth
    FROM matched GROUP BY rule_pos, path, segment)"""


def _escape(column: str) -> str:
    for char, entity in (
        ("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("''", "&#x27;"), ("/", "&#x2F;"),
    ):
        column = f"replace({column}, '{char}', '{entity}')"
    return column


def _each(rule: int, template: int, piece: int, column: str) -> str:
    return f"""SELECT {rule} AS rule_pos, {template} AS template_pos, {piece} AS piece, path, segment,
    CASE WHEN nth > 1 THEN ', ' ELSE '' END || {column} AS text FROM parts WHERE rule_pos = {rule}"""


def _text(rule: int, template: int, piece: int, text: str) -> str:
    return f"SELECT DISTINCT {rule}, {template}, {piece}, '', 0, '{text}' FROM parts WHERE rule_pos = {rule}"


_PAGE_CODED = """page_lines AS MATERIALIZED (SELECT path, regexp_replace(regexp_replace(string_agg(html, chr(10) ORDER BY page_id),
'\\r?\\n$', ''), '\\r\\n', chr(10), 'g') AS code FROM page_paths GROUP BY path),
page_symbols AS MATERIALIZED (SELECT d.*, p.code FROM defs d JOIN page_lines p USING (path)
    WHERE kind IN ('Enum', 'Struct')),
page_matched AS MATERIALIZED (SELECT 0 AS rule_pos, * FROM page_symbols WHERE kind = 'Struct'
    AND regexp_matches(name, '^[a-m]') AND regexp_matches(path, '^/[^/]*[.]com/.*$|^/[^/]*[.]org/en/.*$')
    AND contains(code, '<article>')
    UNION ALL SELECT 1, * FROM page_symbols WHERE kind = 'Enum' AND name LIKE '%n' AND regexp_matches(code, 'lang=.fr')),
page_parts AS MATERIALIZED (SELECT rule_pos, path, string_agg({name}, ', ' ORDER BY symbol_id) AS names,
    row_number() OVER (PARTITION BY rule_pos ORDER BY path) AS nth FROM page_matched GROUP BY rule_pos, path),
page_places AS MATERIALIZED (
    SELECT symbol_id, d.path, place_to FROM page_symbols d JOIN ({modes}) USING (symbol_id)
    WHERE {parent} <> place_to)"""

_MODES = """SELECT symbol_id, arg_min(parent, (-n, parent)) AS place_to FROM (
    SELECT symbol_id, {parent} AS parent, sum(uses) AS n FROM {places} GROUP BY symbol_id, parent) GROUP BY symbol_id"""
_BEST_PLACES = """(SELECT * FROM (SELECT *, max(total) OVER (PARTITION BY symbol_id) AS best FROM sums) WHERE total = best)"""
_BEST_MODES = _MODES.replace("{parent}", _PARENT).replace("{places}", _BEST_PLACES)
_SCAN_PLACES = _with(
    "scan_sums symbols",
    f"""SELECT {{columns}} FROM symbols d JOIN ({_BEST_MODES.replace("FROM sums", "FROM scan_sums")}) USING (symbol_id)
    WHERE kind IN ('Struct', 'Enum') AND {_PARENT.replace("path", "d.path")} <> place_to""",
)
_PAGE_CODED = (
    _PAGE_CODED.replace("{name}", _escape("name"))
    .replace("{modes}", _BEST_MODES)
    .replace("{parent}", _PARENT.replace("path", "d.path"))
)

ORACLE_SQL: dict[str, str] = {
    "scan_glob": _with(
        "docs",
        "SELECT path FROM docs WHERE regexp_matches(path, '^/src1[^/]*/(en|fr)/.*[.]txt$|^/src[2-4]/.*$')",
    ),
    "doc_lines": _with("lines", "SELECT doc_id, path, line_no, line FROM lines"),
    "chunk_table_open": _with("chunks", "SELECT id, path, 64::BIGINT AS dims FROM chunks"),
    "chunk_table_write": _with(
        "chunks means",
        f"SELECT id, path, start_line, end_line, {_vector_text('vec')} AS vector FROM chunks "
        "JOIN means ON owner = 'c' || id",
    ),
    "chunks_by_path": _with(
        "chunks",
        "SELECT id, path, start_line, end_line FROM chunks WHERE path LIKE '/src1/%' OR path LIKE '/src2/en/%'",
    ),
    "search_prompt": _with(
        "request request_rules",
        f"""SELECT section::BIGINT AS section, 0::BIGINT AS block, '' AS path, 0::BIGINT AS start_line, 0::BIGINT AS symbol_id, text
        FROM (VALUES (0, '## Semantic Rules' || chr(10)), (1, '## Fuzzy Rules' || chr(10))) AS heads(section, text)
        UNION ALL SELECT section, 2, '', 0, 0, text
        FROM (VALUES (0, '## Semantic Symbols' || chr(10)), (1, '## Fuzzy Symbols' || chr(10))) AS heads(section, text)
        UNION ALL SELECT section, 1, '', position, 0, '- ' || text || chr(10) FROM request_rules
        UNION ALL SELECT section, 3, path, start_line, symbol_id, {_MARKDOWN} FROM request""",
    ),
    "search_json": _with(
        "request request_rules",
        """SELECT list || '_rules' AS list, to_json({'position': position, 'text': text})::VARCHAR AS json FROM request_rules
        UNION ALL SELECT list || '_symbols', to_json({'symbol_id': symbol_id, 'path': path, 'uri': 'file://' || path,
            'name': name, 'kind': kind, 'container_name': container_name, 'start_line': start_line,
            'start_character': start_character, 'end_line': end_line, 'end_character': end_character,
            'name_line': start_line, 'name_character': end_character - 1, 'hover': hover, 'code': code})::VARCHAR FROM request""",
    ),
    "filter_glob": _with(
        "page_paths",
        """SELECT page_id, path FROM page_paths WHERE regexp_matches(path, '^/[^/]*[.]example[.]com/.*$')
        OR regexp_matches(path, '^/m[.][^/]*/(en|de)/[^/]$') OR regexp_matches(path, '^/[^/]*/[^a-e][^/]*/1[^/]*$')""",
    ),
    "filter_kind": _with("symbols", f"SELECT {_SYMBOL} FROM symbols WHERE kind IN ('Struct', 'Enum')"),
    "filter_events": _with(
        "accepted",
        """SELECT event_id, path, kind, CASE kind WHEN 'remove' THEN 'remove' ELSE 'upsert' END AS action
        FROM accepted""",
    ),
    "uri_to_path": _with("links", "SELECT page_id, symbol_id AS path FROM links"),
    "reject_split": r"""SELECT page_id, TRY_CAST(regexp_extract(url, '/([^/]*)$', 1) AS BIGINT) AS number,
        TRY_CAST(regexp_extract(url, '/([^/]*)$', 1) AS BIGINT) IS NULL AS rejected FROM pages""",
    "symbols_normalize": _with(
        "symbols",
        """SELECT symbol_id, name, kind, path,
        CASE WHEN lang = 'en' AND kind = 'Enum' THEN 0 ELSE start_line END AS start_line,
        CASE WHEN lang = 'en' AND kind = 'Enum' THEN 0 ELSE start_character END AS start_character,
        CASE WHEN lang = 'en' AND kind = 'Enum' THEN 0 ELSE end_line END AS end_line,
        CASE WHEN lang = 'en' AND kind = 'Enum' THEN 0 ELSE end_character END AS end_character,
        CASE WHEN lang = 'en' THEN container_name END AS container_name,
        CASE WHEN lang <> 'en' THEN start_line END AS name_line,
        CASE WHEN lang <> 'en' THEN end_character END AS name_character FROM symbols""",
    ),
    "kind_lookup": """SELECT p_partkey, k.name AS kind, k.code::BIGINT AS code FROM part LEFT JOIN (VALUES
        (1, 'File'), (2, 'Module'), (3, 'Namespace'), (4, 'Package'), (5, 'Class'), (6, 'Method'), (7, 'Property'),
        (8, 'Field'), (9, 'Constructor'), (10, 'Enum'), (11, 'Interface'), (12, 'Function'), (13, 'Variable'),
        (14, 'Constant'), (15, 'String'), (16, 'Number'), (17, 'Boolean'), (18, 'Array'), (19, 'Object'), (20, 'Key'),
        (21, 'Null'), (22, 'EnumMember'), (23, 'Struct'), (24, 'Event'), (25, 'Operator'), (26, 'TypeParameter')
        ) AS k(code, name) ON k.code = p_size""",
    "hover_flatten": _with("hovers", "SELECT path, line, character, hover FROM hovers"),
    "delete_path": _with(
        "chunks",
        """SELECT id, path, start_line, end_line FROM chunks
        WHERE path NOT IN ('/src0/fr/0.txt', '/src1/en/1.txt')""",
    ),
    "delete_prefix": _with(
        "chunks",
        """SELECT id, path, start_line, end_line FROM chunks
        WHERE path NOT LIKE '/src1/%' AND path NOT LIKE '/src3/en/%'""",
    ),
    "chunk_lines": _with(
        "chunks", "SELECT path, start_line, end_line, array_to_string(text, chr(10)) AS text FROM chunks"
    ),
    "chunk_ids": _with("chunks", "SELECT id, path, start_line, end_line FROM chunks"),
    "chunk_verify": _with("chunks", "SELECT path, start_line, path NOT LIKE '%/fr/%' AS ok FROM chunks"),
    "chunk_stats": _with(
        "chunks",
        """SELECT path, count(*)::BIGINT AS chunks, min(start_line) AS first_line, max(end_line) AS line_count,
        sum(end_line - start_line)::BIGINT AS chunk_lines FROM chunks GROUP BY path""",
    ),
    "embed_hash": _with(
        "chunks codes owners",
        f"""SELECT path, start_line, {_vector_text("vec")} AS vector FROM chunks JOIN (
            SELECT owner, list(coalesce(v / norm, 0) ORDER BY dim) AS vec
            FROM owners CROSS JOIN (SELECT unnest(range(64)) AS dim)
            LEFT JOIN (SELECT owner, dim, sum(v) AS v FROM codes GROUP BY owner, dim) USING (owner, dim)
            LEFT JOIN (SELECT owner, nullif(sqrt(sum(v * v)), 0) AS norm FROM (
                SELECT owner, dim, sum(v) AS v FROM codes GROUP BY owner, dim) GROUP BY owner) USING (owner)
            GROUP BY owner) ON owner = 'c' || id""",
    ),
    "embed_policy": _with(
        "chunks means line_vectors owners",
        f"""SELECT path, start_line, {_vector_text("m.vec")} AS mean, {_vector_text("f.vec")} AS first
        FROM chunks JOIN means m ON m.owner = 'c' || id JOIN (
            SELECT owner, list(coalesce(v, 0) ORDER BY dim) AS vec
            FROM owners CROSS JOIN (SELECT unnest(range(64)) AS dim)
            LEFT JOIN (SELECT owner, dim, v FROM line_vectors WHERE pos = 0) USING (owner, dim)
            GROUP BY owner) f ON f.owner = 'c' || id""",
    ),
    "embed_dim_check": """SELECT vec_id AS id, CASE WHEN label = 3 THEN 32 ELSE len(embedding) END::BIGINT AS dims,
        label <> 3 AS ok FROM embeddings""",
    "knn_l2": _knn("list_distance(vec, e)"),
    "knn_cosine": _knn("1 - list_cosine_similarity(vec, e)"),
    "knn_dot": _knn("-list_inner_product(vec, e)"),
    "knn_ivf": _in_cells("label", 8),
    "knn_ivf_seeded": _in_cells("vec_id % 12", 9),
    "knn_ivf_all_cells": _knn("list_distance(vec, e)"),
    "knn_ivf_pq": _knn("list_distance(vec, e)"),
    "knn_join": _knn("list_distance(vec, e)"),
    "knn_ivf_rows": _knn("list_distance(vec, e)"),
    "union_hits": _with("hits", "SELECT query_id, rank, path, start_line, end_line FROM hits"),
    "distinct_paths": _with("hits", "SELECT DISTINCT path FROM hits"),
    "symbols_of_hits": _with(
        "hits symbols", f"SELECT {_SYMBOL} FROM symbols WHERE path IN (SELECT path FROM hits)"
    ),
    "symbols_extract": _with(
        "symbols",
        """SELECT symbol_id, path, name, kind, container_name, start_line, end_line, start_character, end_character
        FROM symbols""",
    ),
    "asof_next_symbol": _with(
        "chunks symbols",
        f"""SELECT {_SYMBOL} FROM (
            SELECT *, lag(is_symbol) OVER (PARTITION BY path ORDER BY start_line, is_symbol, symbol_id) AS before
            FROM (SELECT path, start_line, 0 AS is_symbol, -1 AS symbol_id, NULL AS name, NULL AS kind,
                         NULL::BIGINT AS end_line FROM chunks
                  UNION ALL SELECT path, start_line, 1, symbol_id, name, kind, end_line FROM symbols))
        WHERE is_symbol = 1 AND before = 0""",
    ),
    "asof_enclosing": _with(
        "hits symbols",
        f"""SELECT {_SYMBOL} FROM symbols s WHERE EXISTS (SELECT 1 FROM hits h WHERE h.path = s.path
        AND s.start_line < h.end_line AND s.end_line >= h.start_line)""",
    ),
    "symbol_code": _with(
        "symbols lines",
        """SELECT s.symbol_id, s.path, string_agg(l.line, chr(10) ORDER BY l.line_no) AS code FROM symbols s
        JOIN lines l ON l.path = s.path AND l.line_no BETWEEN s.start_line AND s.end_line GROUP BY s.symbol_id, s.path""",
    ),
    "symbol_name_pos": _with(
        "symbols lines",
        """SELECT s.symbol_id, s.name, min(l.line_no) AS name_line,
        arg_min(instr(l.line, s.name) + length(s.name) - 2, l.line_no)::BIGINT AS name_character FROM symbols s
        JOIN lines l ON l.path = s.path AND l.line_no BETWEEN s.start_line AND s.end_line AND contains(l.line, s.name)
        GROUP BY s.symbol_id, s.name""",
    ),
    "hover_enrich": _with(
        "symbols hovers",
        """SELECT s.symbol_id, s.name, h.hover FROM symbols s LEFT JOIN hovers h
        ON h.path = s.path AND h.line = s.start_line AND h.character = length(s.name) - 1""",
    ),
    "group_by_path": _with(
        "symbols",
        """SELECT path, start_line // 4096 AS segment,
        string_agg(symbol_id::VARCHAR, ',' ORDER BY start_line, symbol_id) AS symbol_ids FROM symbols GROUP BY ALL""",
    ),
    "symbols_sorted": _with(
        "symbols",
        """SELECT path, symbol_id, row_number() OVER (PARTITION BY path ORDER BY start_line, symbol_id) AS position
        FROM symbols""",
    ),
    "fuzzy_substring": _fuzzy(
        "contains(lower(name), lower(pattern))", "instr(lower(name), lower(pattern))", "(0, 'the'), (1, 'Er'), (2, 'tion')"
    ),
    "fuzzy_subsequence": _fuzzy(
        "regexp_matches(lower(name), CASE pattern_id WHEN 0 THEN 't.*h.*n' WHEN 1 THEN 'e.*r.*o' ELSE 'e.*a.*e' END)",
        "0",
        "(0, 'thn'), (1, 'Ero'), (2, 'eae')",
    ),
    "fuzzy_levenshtein": _fuzzy(
        "levenshtein(lower(name), lower(pattern)) <= 2",
        "levenshtein(lower(name), lower(pattern))",
        "(0, 'Thesh'), (1, 'onere'), (2, 'le')",
    ),
    "fuzzy_all": _fuzzy("TRUE", "0", "(0, '')"),
    "rule_match": _with("coded", f"SELECT symbol_id, rule_pos FROM ({_RULE_MATCHES}) WHERE kind <> 'Function'"),
    "rule_symbols": _with(
        "coded",
        f"""SELECT rule_pos, path, start_line // 4096 AS segment,
        string_agg(name, ',' ORDER BY start_line, symbol_id) AS names FROM ({_RULE_MATCHES}) GROUP BY ALL""",
    ),
    "rules_render": _with("coded", "SELECT 1").rsplit("\n", 1)[0]
    + ",\n"
    + _fill(_RULE_PARTS)
    + "\nSELECT rule_pos::BIGINT AS rule_pos, template_pos::BIGINT AS template_pos, piece::BIGINT AS piece, path,"
    + " segment::BIGINT AS segment, text FROM ("
    + " UNION ALL ".join(
        [
            _each(0, 0, 1, "names"),
            _text(0, 0, 0, "Sources 0 to 4 open lines with "),
            _text(0, 0, 2, "; quote one of them."),
            _text(0, 1, 0, "Capitalised openings stay as they are."),
            _text(1, 0, 0, "Names "),
            _each(1, 0, 1, "names"),
            _text(1, 0, 2, " of "),
            _each(1, 0, 3, "kinds"),
            _text(1, 0, 4, "."),
            _text(3, 0, 0, "First text."),
            _text(4, 0, 0, "Second text."),
        ]
    )
    + ")",
    "rules_final": _with(
        "request_rules", "SELECT position::BIGINT AS position, text FROM request_rules WHERE list = 'fuzzy'"
    ),
    "regex_any": _with(
        "symbols", "SELECT symbol_id, regexp_matches(name, '^Th|n$|[aeiou]{3}') AS hit, FALSE AS none FROM symbols"
    ),
    "html_escape": f"SELECT page_id, {_escape('html')} AS escaped FROM pages",
    "refs_join": _with("uses", "SELECT symbol_id, path, uses FROM uses"),
    "refs_missing": _with(
        "symbols links",
        """SELECT DISTINCT name AS symbol_id FROM symbols
        WHERE name NOT IN (SELECT ltrim(symbol_id, '/') FROM links)""",
    ),
    "path_distance": _with(
        "uses defs",
        """SELECT symbol_id, path, (len(pa) + len(pb) - 2 * len(list_filter(range(1, least(len(pa), len(pb)) + 1),
        lambda i: pa[1:i] = pb[1:i])))::BIGINT AS distance
        FROM (SELECT u.symbol_id, u.path, string_split(substr(u.path, 2), '/') AS pa,
                     string_split(substr(d.path, 2), '/') AS pb FROM uses u JOIN defs d USING (symbol_id))""",
    ),
    "path_parent": _with("page_paths", f"SELECT page_id, {_PARENT} AS parent FROM page_paths"),
    "path_distance_sum": _with("sums", "SELECT symbol_id, path, total FROM sums"),
    "place_argmax": _best("max"),
    "place_argmin": _best("min"),
    "mode_parent": _with("uses", _MODES.replace("{parent}", _PARENT).replace("{places}", "uses")),
    "place_symbols": _with(
        "defs sums",
        f"""SELECT symbol_id, kind, path, place_to FROM defs JOIN ({_BEST_MODES}) USING (symbol_id)
        WHERE kind IN ('Struct', 'Enum') AND {_PARENT} <> place_to""",
    ),
    "upsert_chunks": _with(
        "chunks recut",
        """SELECT id, path, start_line, end_line, 'old' AS version FROM chunks WHERE id NOT IN (SELECT id FROM recut)
        UNION ALL SELECT id, path, start_line, end_line, version FROM recut""",
    ),
    "replace_path": _with(
        "chunks recut",
        """SELECT id, path, start_line, end_line, 'old' AS version FROM chunks WHERE path NOT LIKE '%/de/%'
        UNION ALL SELECT id, path, start_line, end_line, version FROM recut""",
    ),
    "changes_stream": _with("accepted", f"SELECT event_id, path, kind, {_stamp('ts')} AS ts FROM accepted"),
    "changes_debounced": _with("bursts", f"SELECT {_BURSTS} FROM bursts"),
    "changes_debounced_stream": _with("bursts", f"SELECT {_BURSTS} FROM bursts"),
    "changes_latest": _with(
        "accepted",
        f"""SELECT path, kind, event_id, {_stamp("ts")} AS ts,
        CASE kind WHEN 'remove' THEN 'remove' ELSE 'upsert' END AS action FROM (
            SELECT *, row_number() OVER (PARTITION BY path ORDER BY ts DESC, event_id DESC) AS r FROM accepted)
        WHERE r = 1""",
    ),
    "changes_dedup": _with("feed", f"SELECT event_id, path, kind, {_stamp('ts')} AS ts FROM feed"),
    "path_state": _with(
        "accepted",
        """SELECT path, arg_max(kind, (ts, event_id)) <> 'remove' AS present,
        arg_max(kind, (ts, event_id)) AS last_kind, count(*)::BIGINT AS changes FROM accepted GROUP BY path""",
    ),
    "incremental_chunks": _with(
        "chunks means accepted",
        f"""SELECT id, path, start_line, end_line, {_vector_text("vec")} AS vector FROM ({_LIVE})
        JOIN means ON owner = 'c' || id""",
    ),
    "rules_from_file": _with("coded", f"SELECT rule_pos, symbol_id FROM ({_RULE_MATCHES})"),
    "symbol_code_segments": _with(
        "coded",
        """SELECT symbol_id, path, code, start_line AS name_line, length(name)::BIGINT - 1 AS name_character FROM coded""",
    ),
    "snapshot_then_follow": _with(
        "chunks means accepted",
        f"""SELECT id, path, start_line, end_line, {_vector_text("vec")} AS vector FROM ({_LIVE})
        JOIN means ON owner = 'c' || id""",
    ),
    "rule_match_many": _with(
        "coded",
        """SELECT r.doc_id * 2 AS rule_pos, symbol_id FROM coded c JOIN (
            SELECT doc_id, lang, regexp_extract_all(text, '[A-Za-z]{3,}') AS ws FROM documents) r
            ON r.lang = c.lang AND starts_with(c.name, ws[1][:5]) WHERE len(ws) > 1 AND kind IN ('Struct', 'Enum')
        UNION ALL SELECT r.doc_id * 2 + 1, symbol_id FROM coded c JOIN (
            SELECT doc_id, source, regexp_extract_all(text, '[A-Za-z]{3,}') AS ws FROM documents) r
            ON r.source = split_part(c.path, '/', 2) AND (contains(c.code, ws[2] || '.') OR contains(c.code, ws[2] || ','))
        WHERE len(ws) > 1""",
    ),
    "fuzzy_postings": _with(
        "symbols",
        """SELECT mode, pattern, rank, score, symbol_id, name FROM (
            SELECT *, row_number() OVER (PARTITION BY mode, pattern ORDER BY score, length(name), name, symbol_id) AS rank FROM (
                SELECT mode, pattern, score::BIGINT AS score, symbol_id, name FROM (
                    SELECT pattern, name, unnest(['substring', 'levenshtein']) AS mode,
                           unnest([instr(lower(name), lower(pattern)), levenshtein(lower(name), lower(pattern))]) AS score
                    FROM (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-z]+')) AS pattern FROM benchmark)
                    CROSS JOIN (SELECT DISTINCT name FROM symbols))
                JOIN symbols USING (name)
                WHERE CASE mode WHEN 'substring' THEN score > 0 ELSE score <= 2 END))
        WHERE rank <= 32""",
    ),
    "refs_from_scan": _with("refs", "SELECT symbol_id, name, path, line, character FROM refs"),
    "placer_from_scan": _SCAN_PLACES.replace("{columns}", "symbol_id, name, d.path AS path, place_to"),
    "placer_json": _SCAN_PLACES.replace(
        "{columns}", "'places' AS list, json_object('symbol_id', symbol_id, 'name', name, 'place_to', place_to)::VARCHAR AS json"
    ),
    "incremental_debounced": _with(
        "chunks arrived",
        """SELECT c.* EXCLUDE (text) FROM chunks c LEFT JOIN (
            SELECT path, arg_max(kind, (ts, event_id)) AS kind FROM arrived
            WHERE kind IN ('create', 'modify', 'remove') AND NOT coalesce(late, FALSE) GROUP BY path) a USING (path)
        WHERE a.kind IS NULL OR a.kind <> 'remove'""",
    ),
    "late_events": _with(
        "arrived",
        f"""SELECT event_id, path, kind, {_stamp("ts")} AS ts, turn AS batch_id FROM arrived
        WHERE late AND kind IN ('create', 'modify', 'remove')""",
    ),
    "path_state_ttl": _with(
        "accepted",
        """SELECT path, arg_max(kind, (ts, event_id)) <> 'remove' AS present, arg_max(kind, (ts, event_id)) AS last_kind,
               count(*) FILTER (run = last_run) AS changes
        FROM (SELECT *, max(run) OVER (PARTITION BY path) AS last_run FROM (
            SELECT *, sum(ended) OVER (PARTITION BY path ORDER BY ts, event_id) AS run FROM (
                SELECT *, CASE WHEN lag(kind) OVER o = 'remove' OR ts - lag(ts) OVER o > INTERVAL 3 DAY THEN 1 ELSE 0 END AS ended
                FROM accepted WINDOW o AS (PARTITION BY path ORDER BY ts, event_id))))
        GROUP BY path""",
    ),
    "code_reuse_search": _with("request", "SELECT list, path, symbol_id, name, start_line FROM request"),
    "search_stored": _with("request", "SELECT list, path, symbol_id, name, start_line FROM request"),
    "search_after_changes": _after_changes(
        _with("request", "SELECT list, path, symbol_id, name, start_line FROM request")
    ),
    "symbols_placer": _with("defs sums page_paths", "SELECT 1").rsplit("\n", 1)[0]
    + ",\n"
    + _PAGE_CODED
    + """
SELECT 'places' AS list, symbol_id AS item, place_to AS text FROM page_places
UNION ALL SELECT 'symbols', symbol_id, code FROM page_symbols
UNION ALL SELECT DISTINCT 'rules', '0|0|0||0', 'Move ' FROM page_parts WHERE rule_pos = 0
UNION ALL SELECT 'rules', '0|0|1|' || path || '|0', CASE WHEN nth > 1 THEN ', ' ELSE '' END || names
    FROM page_parts WHERE rule_pos = 0
UNION ALL SELECT DISTINCT 'rules', '0|0|2||0', '.' FROM page_parts WHERE rule_pos = 0
UNION ALL SELECT DISTINCT 'rules', '0|1|0||0', 'Link <' FROM page_parts WHERE rule_pos = 0
UNION ALL SELECT 'rules', '0|1|1|' || path || '|0', CASE WHEN nth > 1 THEN ', ' ELSE '' END || names
    FROM page_parts WHERE rule_pos = 0
UNION ALL SELECT DISTINCT 'rules', '0|1|2||0', '> once.' FROM page_parts WHERE rule_pos = 0
UNION ALL SELECT DISTINCT 'rules', '1|0|0||0', 'French.' FROM page_parts WHERE rule_pos = 1""",
}
