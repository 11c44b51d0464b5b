"""DuckDB SQL for the named queries, over the same tables."""

from __future__ import annotations

from .queries import EXCLUDED, GLOBS, MAX_LINES, MAX_WIDTH, MIN_LINES, MODULES, PATTERNS

_NONE = "NULL::VARCHAR AS suggested_path, NULL::VARCHAR AS severity"
_DOCS = "docs AS (SELECT concat_ws('/', source, doc_id::VARCHAR || '.txt') AS path, text FROM documents WHERE text IS NOT NULL)"
_SPLIT = "split AS (SELECT path, text, string_split(text, chr(10)) AS parts FROM docs)"
_LINES = (
    "lines AS (SELECT path, unnest(range(1, len(parts) + 1)) AS line, regexp_replace(unnest(parts), '\\r$', '') AS line_text, len(parts) AS n_parts FROM split WHERE text <> ''),"
    "kept AS (SELECT path, line, line_text FROM lines WHERE NOT (line = n_parts AND line_text = ''))"
)
_PAGES = r"pg AS (SELECT page_id, regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', '') AS path FROM pages)"


def _json(**fields: str) -> str:
    """A JSON object from SQL expressions that are JSON already."""
    return "'{' || " + " || ',' || ".join(f"'\"{k}\":' || ({v})" for k, v in fields.items()) + " || '}'"


def _text(x: str) -> str:
    return f"'\"' || ({x}) || '\"'"


def _list(x: str) -> str:
    """A JSON array of strings from a list."""
    return f"'[' || array_to_string(list_transform({x}, lambda s: '\"' || s || '\"'), ',') || ']'"


def _row(rule: str, path: str, message: str, details: str, fix: bool = False, suggested: str = "NULL::VARCHAR", severity: str = "NULL::VARCHAR") -> str:
    return f"'{rule}' AS rule, {str(fix).lower()} AS fix, {path} AS file_path, {message} AS message, {details} AS details, {suggested} AS suggested_path, {severity} AS severity"


def _quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_LONG = "SELECT " + _row("max-characters-per-line", "path", f"'line ' || line || ' has ' || length(line_text) || ' characters and exceeds the limit of {MAX_WIDTH}'", _json(line="line", characterCount="length(line_text)", max=f"'{MAX_WIDTH}'")) + f" FROM kept WHERE length(line_text) > {MAX_WIDTH}"
_SIZES = r"sizes AS (SELECT path, CASE WHEN text = '' THEN 0 ELSE len(parts) END AS n, len(list_filter(parts, lambda x: regexp_matches(x, '\S'))) AS code FROM split)"


def _max_lines(most: int) -> str:
    return "SELECT " + _row(
        "max-file-lines", "path",
        f"CASE WHEN code > {most} THEN 'file has ' || code || ' lines and exceeds the limit of {most}' ELSE 'file has ' || n || ' physical lines, but only ' || code || ' code lines count toward the limit of {most}' END",
        f"CASE WHEN code > {most} THEN {_json(lineCount='code', max=str(most))} ELSE {_json(lineCount='n', codeLineCount='code', max=str(most))} END",
        severity=f"CASE WHEN code > {most} THEN NULL ELSE 'warning' END",
    ) + f" FROM sizes WHERE code > {most} OR n > {most}"


def _min_lines(least: int) -> str:
    return "SELECT " + _row("min-file-lines", "path", f"'file has ' || code || CASE WHEN code = 1 THEN ' line' ELSE ' lines' END || ' and is at or below the banned minimum of {least}'", _json(lineCount="code", min=str(least))) + f" FROM sizes WHERE code <= {least}"


_MAX, _MIN = _max_lines(MAX_LINES), _min_lines(MIN_LINES)


def _banned() -> str:
    """Patterns that cannot overlap themselves, counted by what removing them takes away; one sign counts apart."""
    values = ", ".join(f"({_quote(p['value'])}, {_quote(p['value'].lower())}, [{', '.join(map(_quote, p['allowed_files']))}]::VARCHAR[])" for p in PATTERNS)
    overlapping = "len(list_filter(range(1, length(t)), lambda i: substr(t, i, 2) = '!!'))"
    return (
        f"pats(pattern, low, allowed) AS (VALUES {values}), low AS (SELECT path, lower(text) AS t FROM docs),"
        f"hits AS (SELECT path, pattern, allowed, CASE WHEN low = '!!' THEN CASE WHEN contains(t, '!!') THEN {overlapping} ELSE 0 END ELSE (length(t) - length(replace(t, low, ''))) // length(low) END AS n FROM low l, pats p WHERE NOT list_contains(allowed, path) AND contains(t, p.low)),"
        "found AS (SELECT " + _row("banned-patterns", "path", "'file contains banned pattern \"' || pattern || '\"' || CASE WHEN n > 1 THEN ' ' || n || ' times' ELSE '' END", _json(pattern=_text("pattern"), occurrences="n", foldedOccurrences="'0'", foldedMatches="'[]'", allowedFiles=_list("allowed"))) + " FROM hits WHERE n > 0)"
    )


def _glob_regex(glob: str) -> str:
    import re

    out = ""
    for s in glob.split("/"):
        out += "(/[^/]*)*" if s == "**" else "/" + "".join("[^/]*" if c == "*" else "[^/]" if c == "?" else re.escape(c) for c in s)
    return out


_GLOBBED = "globs(g, re) AS (VALUES " + ", ".join(f"({_quote(g)}, {_quote(_glob_regex(g))})" for g in GLOBS) + ")"


def _excluded() -> str:
    """By hand for the entries of the query: two bare names, one file glob, one folder with a slash."""
    assert len(EXCLUDED) == 4
    folder = "regexp_replace(CASE WHEN contains(path, '/') THEN path ELSE '' END, '/[^/]*$', '')"
    return (
        f"regexp_full_match({folder}, '(.*/)?fr(/.*)?') OR starts_with(path, 'fr/') OR path = 'fr' OR regexp_full_match({folder}, '(.*/)?blog\\.[^/]*(/.*)?') OR regexp_full_match(path, '([^/]*/)*[^/]*\\.html')"
        f" OR regexp_full_match({folder}, '(.*/)?spam-farm\\.example\\.org/en') OR starts_with(path, 'spam-farm.example.org/en/') OR regexp_full_match(path, '(.*/)?spam-farm\\.example\\.org/en(/.*)?')"
    )


_SINGULAR = "CASE WHEN length({0}) > 1 AND ends_with({0}, 's') THEN left({0}, length({0}) - 1) ELSE {0} END"


def _singular(x: str) -> str:
    return _SINGULAR.format(f"lower(replace(replace(replace(replace({x}, '_', ''), '-', ''), ' ', ''), chr(9), ''))")


_REDUNDANT = f"""
WITH f AS (SELECT CASE WHEN p_size % 3 = 0 THEN split_part(p_name, ' ', 1) WHEN p_size % 3 = 1 THEN split_part(p_name, ' ', -1) || 's' ELSE lower(replace(p_brand, '#', '')) END AS folder, replace(p_name, ' ', '_') AS base FROM part),
c AS (SELECT 'catalog/' || folder AS dir, folder, base, split_part(base, '_', 1) AS head, substr(base, length(split_part(base, '_', 1)) + 2) AS rest, split_part(base, '_', -1) AS tail, left(base, length(base) - length(split_part(base, '_', -1)) - 1) AS front FROM f WHERE contains(base, '_')),
m AS (SELECT *, CASE WHEN {_singular('tail')} = {_singular("'catalog'")} THEN 'catalog' WHEN {_singular('tail')} = {_singular('folder')} THEN folder END AS segment, count(*) OVER (PARTITION BY dir, head) AS n FROM c),
k AS (SELECT *, CASE WHEN segment IS NOT NULL THEN 'redundant-path-segment' WHEN folder = head THEN 'repeated-folder-prefix' WHEN n >= 2 THEN 'same-directory-group' END AS mode FROM m),
t AS (SELECT *, CASE mode WHEN 'redundant-path-segment' THEN dir || '/' || front || '.ts' WHEN 'repeated-folder-prefix' THEN dir || '/' || rest || '.ts' ELSE dir || '/' || head || '/' || rest || '.ts' END AS target FROM k WHERE mode IS NOT NULL)
SELECT {_row('redundant-path-segments', "dir || '/' || base || '.ts'", "'file path should be normalized to ' || target", "CASE WHEN segment IS NOT NULL THEN " + _json(mode=_text('mode'), prefix=_text('front'), remainder=_text('tail'), separator="'" + '"_"' + "'", pathSegment=_text('segment')) + " ELSE " + _json(mode=_text('mode'), prefix=_text('head'), remainder=_text('rest'), separator="'" + '"_"' + "'") + " END", fix=True, suggested='target')} FROM t
"""  # fmt: skip

_BASE = "CASE WHEN contains(path, '/') THEN split_part(path, '/', -1) ELSE path END"
_EXT = r"lower(regexp_extract(path, '[^/](\.[^./]+)$', 1))"
_DIR = "CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '' END"
_SLUG = r"CASE WHEN regexp_replace(regexp_replace(lower({0}), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') = '' THEN 'module' ELSE regexp_replace(regexp_replace(lower({0}), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') END"

_GRAMS = "r AS (SELECT conv_id * 1000 + turn AS id, role, length(text) AS n, list_distinct(list_transform(range(1, length(text) + 3), lambda i: substr('  ' || text || '  ', i, 3))) AS g FROM conversations WHERE text IS NOT NULL)"
_PAIRS = f"{_GRAMS}, pairs AS (SELECT a.id AS a, b.id AS b, len(list_intersect(a.g, b.g))::INTEGER AS common, (len(a.g) + len(b.g) - len(list_intersect(a.g, b.g)))::INTEGER AS whole FROM r a JOIN r b ON a.role = b.role AND a.id < b.id AND least(a.n, b.n) >= greatest(a.n, b.n) * 0.75), near AS (SELECT * FROM pairs WHERE common::DOUBLE / whole >= 0.55)"



def _units(x: str) -> str:
    """The UTF-16 units of a text that is not empty."""
    return f"flatten(list_transform(string_split({x}, ''), lambda c: CASE WHEN unicode(c) < 65536 THEN [unicode(c)::BIGINT] ELSE [55296 + ((unicode(c) - 65536)::BIGINT >> 10), 56320 + ((unicode(c) - 65536)::BIGINT & 1023)] END))"


def _fnv(units: str) -> str:
    return f"list_reduce([2166136261::BIGINT] || {units}, lambda h, x: (xor(h, x) * 16777619) % 4294967296)"


#: The 16 least hashes of a text's trigrams in four bands, and pairs that share one.
_BANDS = (
    f"{_GRAMS}, least16 AS (SELECT id, role, n, g, list_sort(list_transform(g, lambda t: {_fnv(_units('t'))}))[1:16] AS hs FROM r),"
    " placed AS (SELECT id, role, n, g, unnest(list_filter(list_transform([0, 1, 2, 3], lambda k: CASE WHEN len(hs) > 4 * k THEN k || ':' || array_to_string(hs[4 * k + 1 : 4 * k + 4], ',') END), lambda x: x IS NOT NULL)) AS band FROM least16),"
    " hits AS (SELECT a.id AS a, b.id AS b, a.g AS ga, b.g AS gb, abs(a.n - b.n) AS apart, count(*) AS hits FROM placed a JOIN placed b ON a.role = b.role AND a.band = b.band AND a.id < b.id AND least(a.n, b.n) >= greatest(a.n, b.n) * 0.75 GROUP BY ALL),"
    " chosen AS (SELECT *, row_number() OVER (PARTITION BY b ORDER BY hits DESC, apart, a) AS k FROM hits),"
    " scored AS (SELECT a, b, len(list_intersect(ga, gb))::DOUBLE / (len(ga) + len(gb) - len(list_intersect(ga, gb))) AS s FROM chosen WHERE k <= 300)"
)

_NAME = "replace(p_name, ' ', '_') || '_' || p_size"
_SCRIPT = f"s AS (SELECT 'parts/' || p_partkey || '.ts' AS path, {_NAME} AS name, p_name, p_brand, p_size, p_partkey + p_size AS goal, 'n_' || split_part(p_name, ' ', 1) AS one, 'k_' || lower(p_type) AS two FROM part)"
#: Names that a script imports and does not use.
_DEAD = "dead AS (SELECT path, unnest(list_filter([CASE WHEN p_size % 2 <> 0 THEN one END, two, CASE WHEN p_size % 3 <> 0 THEN 'total' END], lambda x: x IS NOT NULL)) AS name FROM s)"


def _modules(kind: str) -> str:
    """The text of every module: raw, without comments, with comments (and literals) as blanks, or formatted.

    Formatting here sets the indent (four blanks in Go, Rust and C#) and leaves one blank line of several, none at the top.
    """

    def comment(signs: tuple[str, str], inner: str) -> str:
        whole = f"{_quote(signs[0])} || {inner} || {_quote(signs[1])}"
        return whole if kind in ("raw", "formatted") else f"repeat(' ', length({whole}))"

    out = []
    for i, (ext, short, long, header, (before, literal, after), last, end, tail) in enumerate(MODULES):
        blanks, indent = "repeat(chr(10), e)", "  "
        if kind == "formatted":
            blanks, indent = "repeat(chr(10), CASE WHEN a = 0 THEN 0 ELSE least(e, 1) END)", "    " if ext in (".go", ".rs", ".cs") else "  "
            before, last = indent + before.lstrip(), indent + last.lstrip()
            tail = tail.replace("\n  ", "\n" + indent).lstrip()
        header_sql = f"replace(replace({_quote(header)}, 'NAME', name), 'ASYNC ', CASE WHEN p_size % 2 = 1 THEN 'async ' ELSE '' END)"
        kept = _quote(" " * len(literal) if kind == "literals" else literal)
        if kind == "stripped":
            note, block, trail = "''", "''", "'  '" if short[1] else "''"
        else:
            note = f"repeat({comment(short, chr(39) + 'note of ' + chr(39) + ' || p_brand')} || chr(10), a)"
            block = f"repeat('{indent}' || {comment((long[0], ''), _quote('part'))} || chr(10) || '{indent}' || {comment(('', long[1]), 'p_type')} || chr(10), b)" if long else f"repeat('{indent}' || {comment(short, 'p_type')} || chr(10), b)"
            trail = f"' ' || {comment(short, _quote('end'))}"
        ends = f"{_quote(end)} || chr(10) || " if end else ""
        out.append(
            f"WHEN {i} THEN {note} || {blanks} || {header_sql} || chr(10) || repeat({_quote(before)} || {kept} || {_quote(after)} || chr(10), c) || {block} || repeat(chr(10), g)"
            f" || {_quote(last)} || CASE WHEN t = 1 THEN {trail} ELSE '' END || chr(10) || {ends}chr(10) || {_quote(tail)} || chr(10)"
        )
    return "CASE turn " + " ".join(out) + " END"


def _by_turn(*values: str) -> str:
    return f"[{', '.join(values)}][turn + 1]"


_HASH = "turn IN (5, 6)"  # languages that have no comment but the short one
#: a notes, b long comments, c statements, e and g blank lines, t a comment behind the last statement; h the header's line, f the line of the end (in Python the blank line)
_MODULE = (
    f"m0 AS (SELECT *, {_NAME} AS name, (p_partkey % {len(MODULES)})::INTEGER AS turn, p_size % 4 AS a, length(p_type) % 3 AS b, p_size % 5 AS c, (p_partkey // 10) % 3 AS e, p_size % 2 AS g, (p_size % 3 = 0)::INTEGER AS t FROM part),"
    f"m AS (SELECT *, 'modules/' || p_partkey || {_by_turn(*(_quote(m[0]) for m in MODULES))} AS path, 1 + a + e AS h, 3 + a + e + c + (CASE WHEN {_HASH} THEN 1 ELSE 2 END) * b + g AS f FROM m0)"
)
_MODULE_SPANS = (
    f"{_MODULE}, sp AS (SELECT path, CASE WHEN turn = 5 AND p_size % 2 = 1 THEN 'async-function' ELSE 'function' END AS kind, name, h::INTEGER AS start_line, f::INTEGER AS end_line,"
    " (f - h + 1)::INTEGER AS line_count, (c + CASE WHEN turn = 5 THEN 2 ELSE 3 END)::INTEGER AS code_line_count FROM m WHERE turn < 8)"
)
_COMMENTS = f"{_MODULE}, n AS (SELECT path, CASE WHEN turn = 8 THEN 0 WHEN {_HASH} THEN a + b + t ELSE a + t END AS l, CASE WHEN turn = 8 THEN a + b + t WHEN {_HASH} THEN 0 ELSE b END AS bl FROM m)"
_DECLARED = (
    f"{_MODULE}, d AS (SELECT path, CASE turn WHEN 8 THEN 'class' WHEN 9 THEN 'mixin' WHEN 5 THEN CASE WHEN p_size % 2 = 1 THEN 'async-function' ELSE 'function' END ELSE 'function' END AS kind, name, h AS line, length(name) AS n FROM m"
    f" UNION ALL SELECT path, {_by_turn(*map(_quote, ('const', 'const', 'const', 'using', 'namespace', 'assignment', 'assignment', 'property', 'custom-property', 'variable')))},"
    f" CASE turn WHEN 8 THEN '--LIMIT' WHEN 9 THEN '$LIMIT' ELSE 'LIMIT' END, f + CASE turn WHEN 5 THEN 1 WHEN 1 THEN 3 ELSE 2 END, 5 FROM m)"
)
_UNION = f"{_DOCS}, {_SPLIT}, {_LINES}, {_SIZES}, {_banned()}, u AS ({_LONG} UNION ALL {_MAX} UNION ALL SELECT * REPLACE ('warning' AS severity) FROM ({_MIN}) UNION ALL SELECT * FROM found UNION ALL SELECT " + _row("banned-files", "path", "'file path matches banned glob \"src1/*\"'", "'{\"glob\":\"src1/*\"}'", fix=True, severity="'warning'") + " FROM docs WHERE regexp_full_match('/' || path, '/src1/[^/]*')), v AS (SELECT *, CASE rule WHEN 'banned-patterns' THEN 0 WHEN 'banned-files' THEN 1 WHEN 'min-file-lines' THEN 2 WHEN 'max-file-lines' THEN 5 ELSE 6 END AS rule_order FROM u)"

ORACLE_SQL = {
    "long_lines": f"WITH {_DOCS}, {_SPLIT}, {_LINES} {_LONG}",
    "file_line_limits": f"WITH {_DOCS}, {_SPLIT}, {_SIZES} {_MAX} UNION ALL {_MIN}",
    "banned_patterns": f"WITH {_DOCS}, {_banned()} SELECT * FROM found",
    "banned_paths": f"WITH {_PAGES}, {_GLOBBED} SELECT " + _row("banned-files", "path", "'file path matches banned glob \"' || g || '\"'", _json(glob=_text("g")), fix=True) + " FROM pg, globs WHERE regexp_full_match('/' || path, re)",
    "excluded_paths": f"WITH {_PAGES} SELECT page_id, path, {_excluded()} AS excluded FROM pg",
    "path_redundancy": _REDUNDANT,
    "path_scalars": f"WITH {_PAGES} SELECT page_id, path AS normal, {_DIR} AS dir, {_BASE} AS base, {_EXT} AS ext, CASE WHEN {_EXT} <> '' THEN left({_BASE}, length({_BASE}) - length({_EXT})) ELSE {_BASE} END AS stem, CASE WHEN starts_with(path, '.') THEN path ELSE './' || path END AS dotted, {_SLUG.format('path')} AS slug, substr(sha1(path), 1, 12) AS sha1, {_singular(f'split_part({_DIR}, chr(47), -1)')} AS token, true AS valid FROM pg",
    "alias_ids": f"WITH {_PAGES}, d AS (SELECT DISTINCT path FROM pg), b AS (SELECT path, '#' || {_SLUG.format(f'CASE WHEN {_EXT} <> chr(32) THEN left(path, length(path) - length({_EXT})) ELSE path END')} AS base FROM d), n AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY path) AS k FROM b) SELECT CASE WHEN k = 1 THEN base ELSE base || '-' || k END AS id, path FROM n",
    "text_scalars": f"WITH u AS (SELECT *, CASE WHEN text = '' THEN []::BIGINT[] ELSE {_units('text')} END AS units FROM conversations)"
    rf" SELECT conv_id, turn, length(text)::INTEGER AS chars, (CASE WHEN text = '' THEN 0 ELSE len(string_split(text, chr(10))) END)::INTEGER AS physical, len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '\S')))::INTEGER AS full_lines, (CASE WHEN text = '' THEN 0 ELSE len(string_split(text, chr(10))) - ends_with(text, chr(10))::INTEGER END)::INTEGER AS lines,"
    rf" len(list_distinct(list_transform(range(1, length(text) + 3), lambda i: substr('  ' || text || '  ', i, 3))))::INTEGER AS grams, {_fnv('units')} AS fnv FROM u",
    "dup_groups": f"WITH {_DOCS}, q AS (SELECT path, regexp_replace(lower(text), '\\s+', '', 'g') AS t FROM docs), g AS (SELECT list(path ORDER BY path) AS ps FROM q WHERE length(t) >= 40 GROUP BY t HAVING count(*) > 1) SELECT " + _row("dry", "'multiple files'", "'duplicate function group'", _json(confidence="'1'", files=_list("list_sort(list_distinct(ps))"), fixable="'false'", functions="'[' || array_to_string(list_transform(ps, lambda p: '{\"classification\":\"standalone\",\"filePath\":\"' || p || '\",\"language\":\"text\",\"line\":1,\"name\":\"text\",\"topLevel\":false}'), ',') || ']'", locations=_list("list_transform(ps, lambda p: p || '#text')"), reason="'\"duplicate function group requires human canonicalization\"'", signals="'[\"exact-normalized\"]'")) + " FROM g",
    "near_dup_pairs": f"WITH {_PAIRS} SELECT * FROM near",
    "near_dup_components": f"WITH RECURSIVE {_PAIRS}, e AS (SELECT a AS x, b AS y FROM near UNION SELECT b, a FROM near), walk AS (SELECT x AS id, x AS grp FROM e UNION SELECT e.y, w.grp FROM walk w JOIN e ON e.x = w.id) SELECT id, min(grp) AS grp FROM walk GROUP BY id",
    "near_dup_bands": f"WITH {_BANDS} SELECT a, b, round(s, 3) AS similarity FROM scored WHERE s >= 0.3",
    "link_unresolved": rf"""WITH {_PAGES}, h AS (SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS host, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages), t AS (SELECT page_id, CASE WHEN starts_with(href, '/') THEN host || href ELSE regexp_replace(regexp_replace(href, '^https?://', ''), '[?#].*$', '') END AS target FROM h) SELECT page_id, target, count(*) AS n FROM t WHERE target NOT IN (SELECT path FROM pg) GROUP BY ALL""",
    "path_resolution": rf"""WITH {_PAGES}, known AS (SELECT DISTINCT path FROM pg WHERE NOT ends_with(path, '/')), u AS (SELECT page_id, regexp_replace(url, '^https?://', '') AS raw FROM pages), f AS (SELECT page_id, raw, [raw, regexp_replace(raw, '#.*$', ''), regexp_replace(raw, '[?#].*$', ''), regexp_replace(regexp_replace(raw, '[?#].*$', ''), '/$', ''), regexp_replace(regexp_replace(raw, '[?#].*$', ''), '/$', '') || '.html'] AS forms FROM u), c AS (SELECT page_id, raw, unnest(range(0, 5)) AS rank, unnest(forms) AS candidate FROM f) SELECT page_id, raw, arg_min(k.path, rank) FILTER (WHERE k.path IS NOT NULL) AS resolved FROM c LEFT JOIN known k ON k.path = candidate GROUP BY page_id, raw""",
    "dead_names": f"WITH {_SCRIPT}, {_DEAD} SELECT path, name FROM dead",
    "unresolved_imports": f"WITH {_SCRIPT}, {_DEAD} SELECT " + _row("imports", "path", "'unresolved import ./' || goal || ' should be removed'", _json(specifier=_text("'./' || goal"))) + " FROM s WHERE goal NOT IN (SELECT p_partkey FROM part) UNION ALL SELECT " + _row("imports", "path", "'unused import ' || name || ' should be removed'", _json(name=_text("name")), fix=True) + " FROM dead",
    "comment_counts": f"WITH {_COMMENTS} SELECT " + _row("remove-comments", "path", "'file contains ' || (l + bl) || CASE WHEN l + bl = 1 THEN ' removable comment' ELSE ' removable comments' END", _json(commentCount="l + bl", lineComments="l", blockComments="bl"), fix=True) + " FROM n WHERE l + bl > 0",
    "function_spans": f"WITH {_MODULE_SPANS} SELECT * FROM sp",
    "function_limits": f"WITH {_MODULE_SPANS} SELECT " + _row("max-function-lines", "path", "kind || ' ' || name || CASE WHEN code_line_count > 5 THEN ' has ' || code_line_count || ' lines and exceeds the limit of 5' ELSE ' has ' || line_count || ' physical lines, but only ' || code_line_count || ' code lines count toward the limit of 5' END", "CASE WHEN code_line_count > 5 THEN " + _json(functionKind=_text("kind"), functionName=_text("name"), lineCount="code_line_count", max="'5'", startLine="start_line", endLine="end_line") + " ELSE " + _json(functionKind=_text("kind"), functionName=_text("name"), lineCount="line_count", codeLineCount="code_line_count", max="'5'", startLine="start_line", endLine="end_line") + " END", severity="CASE WHEN code_line_count > 5 THEN NULL ELSE 'warning' END") + " FROM sp WHERE line_count > 5",
    "declaration_names": f"WITH {_DECLARED} SELECT " + _row("max-declaration-name", "path", "kind || ' ' || name || ' has ' || n || ' characters and exceeds the maximum name length of 12'", _json(declarationKind=_text("kind"), declarationName=_text("name"), line="line", length="n", max="'12'")) + " FROM d WHERE n > 12 UNION ALL SELECT " + _row("min-declaration-name", "path", "kind || ' ' || name || ' has ' || n || CASE WHEN n = 1 THEN ' character' ELSE ' characters' END || ' and below the minimum name length of 11'", _json(declarationKind=_text("kind"), declarationName=_text("name"), line="line", length="n", min="'11'")) + " FROM d WHERE n < 11",
    "script_duplicates": f"WITH {_SCRIPT}, g AS (SELECT list({{'p': path, 'n': name}} ORDER BY path, name) AS m, p_size % 4 + 2 AS line_no FROM s GROUP BY p_name, p_size HAVING count(*) > 1) SELECT " + _row("dry", "'multiple files'", "'duplicate function group'", _json(confidence="'1'", files=_list("list_sort(list_distinct(list_transform(m, lambda x: x.p)))"), fixable="'false'", functions="'[' || array_to_string(list_transform(m, lambda x: '{\"classification\":\"standalone\",\"filePath\":\"' || x.p || '\",\"language\":\"typescript\",\"line\":' || line_no || ',\"name\":\"' || x.n || '\",\"topLevel\":false}'), ',') || ']'", locations=_list("list_transform(m, lambda x: x.p || '#' || x.n)"), reason="'\"duplicate function group requires human canonicalization\"'", signals="'[\"exact-normalized\"]'")) + " FROM g",
    "script_spacing": f"WITH {_SCRIPT}, x AS (SELECT path, (p_size % 4 = 0)::INTEGER AS more, greatest(p_size % 4 - 1, 0) AS less FROM s) SELECT " + _row("structural-blank-lines", "path", "'file has 1 structural boundary with incorrect blank line spacing'", _json(boundaryCount="'1'", insertedBlankLines="more", removedBlankLines="less"), fix=True) + " FROM x WHERE more + less > 0",
    "stripped_modules": f"WITH {_MODULE}, r AS (SELECT path, {_modules('raw')} AS text, {_modules('stripped')} AS new_text FROM m) SELECT path, new_text FROM r WHERE text <> new_text",
    "formatted_modules": f"WITH {_MODULE}, r AS (SELECT path, {_modules('raw')} AS text, {_modules('formatted')} AS new_text FROM m) SELECT path, new_text FROM r WHERE text <> new_text",
    "module_line_limits": f"WITH {_MODULE}, sizes AS (SELECT path, f + CASE turn WHEN 5 THEN 2 WHEN 1 THEN 5 ELSE 3 END AS n, c + CASE turn WHEN 5 THEN 3 WHEN 1 THEN 6 ELSE 4 END AS code FROM m) {_max_lines(8)} UNION ALL {_min_lines(5)}",
    "masked_modules": f"WITH {_MODULE} SELECT path, {_modules('comments')} AS masked_text, {_modules('literals')} AS masked_literals FROM m",
    "blank_runs": rf"WITH {_DOCS}, {_SPLIT}, {_LINES}, w AS (SELECT path, line, lag(line) OVER (PARTITION BY path ORDER BY line) AS prior FROM kept WHERE regexp_matches(line_text, '\S')) SELECT path, count(*) AS boundaries, sum(line - prior - 1)::BIGINT AS blank_lines, sum((line - prior = 2)::INTEGER)::BIGINT AS single FROM w WHERE prior IS NOT NULL GROUP BY path",
    "prefix_line_counts": rf"WITH {_DOCS}, {_SPLIT}, {_LINES} SELECT path, line::INTEGER AS line, sum(regexp_matches(line_text, '\S')::INTEGER) OVER (PARTITION BY path ORDER BY line)::BIGINT AS full_lines FROM kept",
    "violations_union": f"WITH {_UNION} SELECT * FROM v",
    "violations_summary": f"WITH {_UNION} SELECT count(*) FILTER (WHERE severity IS NULL) = 0 AS ok, count(*) AS violation_count, count(*) FILTER (WHERE severity IS NULL) AS blocking_count, array_to_string(list_sort(list(DISTINCT rule)), ',') AS rules FROM v",
    "violations_by_rule": f"WITH {_UNION} SELECT rule, count(*) AS n, count(DISTINCT file_path) AS files, count(*) FILTER (WHERE severity IS NULL) AS blocking FROM v GROUP BY rule",
    "rule_file_topn": f"WITH {_UNION}, c AS (SELECT rule, file_path, count(*) AS n FROM v GROUP BY ALL), k AS (SELECT *, (row_number() OVER (PARTITION BY rule ORDER BY n DESC, file_path))::INTEGER AS k FROM c) SELECT * FROM k WHERE k <= 5",
    "blocking_paths": f"WITH {_UNION} SELECT DISTINCT file_path FROM v WHERE severity IS NULL AND file_path NOT IN (SELECT file_path FROM v WHERE rule = 'banned-patterns')",
}
