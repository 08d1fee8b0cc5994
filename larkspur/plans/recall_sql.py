"""The same queries in SQL over the same tables, to hold the DataFrame plans against.

The texts are put together from a few named parts; each is one statement of its own.
"""

from __future__ import annotations

from larkspur.functions.text import ACCENTED, CORE_RULES, MARKS, PLAIN, SIGNALS, SYNONYMS, TESTING, search_terms, task_terms

NOW, TODAY, DAY, READER = "2026-06-10 00:00:00", "2026-03-01", "2025-03-12", "agent:builder"
AND_QUERY, OR_QUERY, ONE_TERM = "heartbeat lease", "rotation heartbeat zzzz", "supersession"
TASK, SIGNAL_TASK, NO_TASK = "release ticket command folder", "test and review the heartbeat request", "zzzqq xxyyq"

STAMP = r"regexp_full_match({0}, '\d{{4}}-\d{{2}}-\d{{2}}[Tt ]\d{{2}}:\d{{2}}:\d{{2}}(\.\d+)?([Zz]|[+-]\d{{2}}:\d{{2}})')"
FOLD = f"translate(lower(coalesce({{0}}, '')), '{ACCENTED}', '{PLAIN}')"


def at(col: str) -> str:
    """Microseconds of an RFC 3339 column."""
    return f"CASE WHEN {STAMP.format(col)} THEN epoch_us(TRY_CAST(upper({col}) AS TIMESTAMPTZ)) END"


def us(day: str, plus: int = 0) -> str:
    return f"epoch_us(TIMESTAMP '{day}' + INTERVAL {plus} DAY)"


def index_tokens(col: str) -> str:
    return f"regexp_extract_all({FOLD.format(col)}, '[\\p{{L}}\\p{{N}}]+')"


def low(*cols: str, sep: str = " ") -> str:
    """ASCII lower case of columns put together."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return "translate(concat_ws('{}', {}), '{}', '{}')".format(sep, ", ".join(f"coalesce({c}, '')" for c in cols), upper, upper.lower())


def ascii_tokens(*cols: str, sep: str = " ") -> str:
    return f"regexp_extract_all({low(*cols, sep=sep)}, '[a-z0-9]+')"


def slug(col: str) -> str:
    return f"CASE WHEN trim(regexp_replace(lower({col}), '[^a-z0-9]+', '-', 'g'), '-') = '' THEN 'untitled' ELSE trim(regexp_replace(lower({col}), '[^a-z0-9]+', '-', 'g'), '-') END"


MEM = ("memories", "SELECT * FROM memories", {"title": 5, "body": 1}, ("name", "title", "body"))
EPI = ("episodes", "SELECT DISTINCT id, summary, body, actor, scope, source_path FROM episodes", {"summary": 3, "body": 1}, ("summary", "body"))
LOC = ("locks", "SELECT DISTINCT id, slug, title, body, scope, status FROM locks", {"slug": 5, "title": 1, "body": 1}, ("slug", "title", "body"))


def bm25(name: str, source: tuple, terms: list[str]) -> str:
    """CTEs ending in ``name``: the matching rows with bm25 and all_terms."""
    _, sql, weights, _ = source
    cols = list(weights)
    toks = ", ".join(f"{index_tokens(c)} AS t{k}" for k, c in enumerate(cols))
    hits = ", ".join(
        "CAST(" + " + ".join(f"{weights[c]} * len(list_filter(t{j}, lambda x: starts_with(x, '{t}')))" for j, c in enumerate(cols)) + f" AS DOUBLE) AS h{k}" for k, t in enumerate(terms)
    )
    dl = " + ".join(f"len(t{k})" for k in range(len(cols)))
    n = ", ".join(f"CAST(count(*) FILTER (h{k} > 0) AS DOUBLE) AS n{k}" for k in range(len(terms)))
    idf = lambda k: f"CASE WHEN ln((n + 5e-1 - n{k}) / (n{k} + 5e-1)) <= 0 THEN 1e-6 ELSE ln((n - n{k} + 5e-1) / (n{k} + 5e-1)) END"
    score = " + ".join(f"({idf(k)}) * h{k} * 22e-1 / (h{k} + 12e-1 * (25e-2 + 75e-2 * dl / avgdl))" for k in range(len(terms)))
    return f"""{name}_t AS (SELECT *, {toks} FROM ({sql})),
{name}_h AS (SELECT *, CAST({dl} AS DOUBLE) AS dl, {hits} FROM {name}_t),
{name}_s AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(dl) AS avgdl, {n} FROM {name}_h),
{name} AS (SELECT {name}_h.*, round(-({score}), 6) AS bm25, {" AND ".join(f"h{k} > 0" for k in range(len(terms)))} AS all_terms FROM {name}_h, {name}_s WHERE {" OR ".join(f"h{k} > 0" for k in range(len(terms)))})"""


def scope_case(scope: str, col: str = "scope") -> str:
    if scope.startswith("product:"):
        order = [scope, "company", "os"]
    elif scope == "company":
        order = ["company", "product:%", "os"]
    else:
        order = ["os", "company"]
    return "CASE " + " ".join(f"WHEN {col} LIKE '{s}' THEN {k}" for k, s in enumerate(order)) + " END"


def may_read(reader: str, col: str = "owner") -> str:
    one = lambda r: f"(SELECT max(granted) FROM node_acl WHERE owner_node = {col} AND reader = '{r}')"
    return f"({col} IN ('shared', '{reader}') OR coalesce({one(reader)}, {one('*')}, 1) <> 0)"


def passes(cols: tuple, terms: list[str], floor: float = 0.5) -> str:
    m = " + ".join(f"CAST(len(list_filter({ascii_tokens(*cols)}, lambda x: starts_with(x, '{t}'))) > 0 AS INT)" for t in terms)
    return f"({m}) / {float(len(terms))} >= {floor}" + ("" if len(terms) <= 1 else f" AND ({m}) >= 2")


def hits(name: str, source: tuple, query: str, scope: str, n: int, where: str = "true", reader: str | None = None, shape: str = "") -> str:
    terms = search_terms(query)
    ok = passes(source[3], terms) + (f" AND {may_read(reader)}" if reader else "")
    return f"""{bm25(name + "_b", source, terms)},
{name}_r AS (SELECT *, {scope_case(scope)} AS scope_index FROM {name}_b WHERE {where}),
{name}_l AS (SELECT *, row_number() OVER (PARTITION BY scope_index ORDER BY bm25, id) AS rn_or,
  row_number() OVER (PARTITION BY scope_index, all_terms ORDER BY bm25, id) AS rn_and FROM {name}_r WHERE scope_index IS NOT NULL),
{name} AS (SELECT {shape}, scope_index, bm25, all_terms, rn_and, rn_or FROM {name}_l WHERE (rn_or <= {n} OR (all_terms AND rn_and <= {n})) AND {ok})"""


M_SHAPE = "'memory' AS kind, id, scope, title, coalesce(source_path, '') AS source_path, owner"
E_SHAPE = "'episode' AS kind, id, scope, summary AS title, coalesce(source_path, '') AS source_path, actor AS owner"
L_SHAPE = "'memory' AS kind, -id AS id, scope, title, '' AS source_path, 'shared' AS owner"


def ranked(name: str, parts: list[str], n: int, weight: float = 0.55) -> str:
    return f"""{name}_u AS ({" UNION ALL ".join(f"SELECT * FROM {p}" for p in parts)}),
{name}_k AS (SELECT *, bool_or(all_terms AND rn_and <= {n}) OVER () AS strict FROM {name}_u),
{name}_f AS (SELECT *, max(abs(bm25)) OVER (PARTITION BY kind) AS best FROM {name}_k WHERE CASE WHEN strict THEN all_terms AND rn_and <= {n} ELSE rn_or <= {n} END),
{name} AS (SELECT kind, id, scope, title, source_path, owner, CAST(scope_index AS INTEGER) AS scope_index,
  CASE WHEN best > 0 THEN round(-(abs(bm25) / best) * CASE WHEN kind = 'episode' THEN CAST({weight} AS DOUBLE) ELSE CAST(1 AS DOUBLE) END, 6) ELSE 0 END AS rank FROM {name}_f)"""


FINAL = "ORDER BY rank, scope_index, CASE WHEN kind = 'memory' THEN 0 ELSE 1 END, id LIMIT"


def search_ctes(query: str, scope: str, limit: int, owner: str | None = None, archived: bool = False, reader: str = READER) -> str:
    where = ("true" if archived else "status <> 'archived'") + (f" AND owner IN ('{owner}', 'shared')" if owner else "")
    return f"{hits('m', MEM, query, scope, limit, where, reader, M_SHAPE)},\n{hits('e', EPI, query, scope, limit, shape=E_SHAPE)},\n{ranked('r', ['m', 'e'], limit)}"


def search(query: str, scope: str = "company", owner: str | None = None, archived: bool = False, limit: int = 10, reader: str = READER) -> str:
    return f"WITH {search_ctes(query, scope, limit, owner, archived, reader)} SELECT * FROM r {FINAL} {limit}"


RECALLS = "rec AS (SELECT DISTINCT id, memory_id, queried_by, query_scope, ts FROM recall_events)"
ACT = f"""{RECALLS},
act AS (SELECT memory_id, round(ln(sum(power(greatest((epoch_us(TIMESTAMP '{NOW}') - u + CASE WHEN u % 1000000 = 0 THEN 0 ELSE u % 1000000 END) // 1000000, 1) / CAST(86400 AS DOUBLE), -5e-1))), 6) AS activation
        FROM (SELECT memory_id, {at('ts')} AS u FROM rec WHERE memory_id IS NOT NULL) WHERE u IS NOT NULL GROUP BY memory_id)"""
HOT = "coalesce(activation >= CAST(-1.6 AS DOUBLE), false)"


def any_in(tokens: str, words) -> str:
    return f"list_has_any({tokens}, [{', '.join(repr(w) for w in words)}])"


def accepted(t: str) -> tuple:
    return (() if t == "test" else (t,)) + SYNONYMS.get(t, ())


def in_title(tokens: str, t: str) -> str:
    return any_in(tokens, ("tests", "testing", "pytest") if t in TESTING else accepted(t))


def floor_relevance(cols: tuple, terms: list[str]) -> str:
    """Over name, title, body expressions."""
    tokens, head = ascii_tokens(*cols, sep="\n"), ascii_tokens(*cols[:2], sep="\n")
    signals = [t for t in terms if t in SIGNALS]
    m = "(" + " + ".join(f"CAST({any_in(tokens, accepted(t))} AS INT)" for t in signals or terms) + ")"
    share = f"{m} / CAST({len(signals or terms)} AS DOUBLE)"
    if not signals:
        return f"CASE WHEN {share} >= 0.5 THEN CAST(0.66 AS DOUBLE) ELSE {share} END"
    test = " OR ".join(in_title(head, t) for t in signals if t in TESTING) or "false"
    return f"CASE WHEN {m} >= 2 THEN {share} WHEN {m} = 1 AND ({test}) THEN CAST(0.66 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END"


def tail_strong(cols: tuple, terms: list[str]) -> str:
    signals = [t for t in terms if t in SIGNALS]
    if not signals:
        return "true"
    tokens, head = ascii_tokens(*cols, sep="\n"), ascii_tokens(*cols[:2], sep="\n")
    m = " + ".join(f"CAST({any_in(tokens, accepted(t))} AS INT)" for t in signals)
    return f"(({m}) >= 2 AND ({' OR '.join(in_title(head, t) for t in signals)}))"


def lexical(terms: list[str]) -> str:
    text = low("name", "title", "body", sep="\n")
    return "(" + " + ".join("CAST(" + " OR ".join(f"contains({text}, '{x}')" for x in (t, *SYNONYMS.get(t, ()))) + " AS INT)" for t in terms) + f") / CAST({len(terms)} AS DOUBLE)"


CORE = "(" + " OR ".join(f"name = '{s}' OR contains({low('name', 'body', sep=chr(10))}, '{s}')" for s in CORE_RULES) + ")"
VISIBLE = "(scope IN ('company', 'os') OR starts_with(scope, 'product:'))"
ROWS = """mrows AS (SELECT id, name, title, owner, scope, is_lock, status, substr(coalesce(body, ''), 1, 320) AS body, coalesce(source_path, '') AS source_path FROM memories),
srows AS (SELECT DISTINCT -id AS id, slug AS name, title, 'shared' AS owner, scope, 1 AS is_lock, 'hot' AS status, substr(coalesce(body, ''), 1, 320) AS body, 'locks' AS source_path FROM locks WHERE status = 'active')"""
NMB = ("name", "title", "body")
LINE = "section, title, body, source_path, scope, owner, reason, activation, confidence"


def marked(*cols: str) -> str:
    text = "concat_ws(chr(10), " + ", ".join(cols) + ")"
    return "concat_ws(' ', " + ", ".join(f"CASE WHEN contains({text}, '{m}') THEN '{m}' END" for m in MARKS) + ") AS confidence"


def scored(name: str, source: str, terms: list[str] | None, scores: str | None, locks: bool) -> str:
    share = lexical(terms) if terms is not None else "CAST(0 AS DOUBLE)"
    core = CORE if locks else "false"
    join = f"LEFT JOIN (SELECT id AS sid, score AS s FROM {scores}) ON sid = id" if scores else "CROSS JOIN (SELECT CAST(0 AS DOUBLE) AS s)"
    return f"""{name}_a AS (SELECT *, CASE WHEN coalesce(s, 0) > 0 THEN s * greatest({share}, 0.1) ELSE {share} END AS relevance, {core} AS core FROM ({source}) {join}),
{name}_b AS (SELECT *, round(relevance * 100 + greatest(least(coalesce(activation, -10), 0), -10) + CASE WHEN core THEN CAST(0.1 AS DOUBLE) ELSE 0 END, 6) AS score FROM {name}_a)"""


def section(name: str, label: str, where: str, limit: int) -> str:
    reason = "CASE WHEN core THEN 'house-rule-core' WHEN relevance > 0 THEN 'matched-task' ELSE 'hot' END"
    return f"""{name} AS (SELECT '{label}' AS section, title, body, source_path, scope, owner, {reason} AS reason, activation, {marked('title', 'body')},
  row_number() OVER (ORDER BY score DESC, title, id < 0, abs(id)) AS place FROM {name}_b WHERE {where} ORDER BY place LIMIT {limit})"""


def locks_section(limit: int, terms: list[str] | None = None, scores: str | None = None) -> str:
    src = f"SELECT r.*, activation FROM mrows r LEFT JOIN act ON memory_id = id WHERE is_lock = 1 AND status <> 'archived' AND {VISIBLE} AND {may_read(READER)} UNION ALL SELECT *, NULL FROM srows WHERE {VISIBLE}"
    where = f"(relevance > 0 OR core) AND (core OR {floor_relevance(NMB, terms)} >= 0.66)" if terms else "true"
    return scored("sl", src, terms, scores, True) + ",\n" + section("sl", "active-lock", where, limit)


def hot_section(limit: int, terms: list[str] | None = None, scores: str | None = None) -> str:
    src = f"SELECT r.*, activation FROM mrows r LEFT JOIN act ON memory_id = id WHERE is_lock = 0 AND status <> 'archived' AND {VISIBLE} AND {may_read(READER)} AND {HOT}"
    where = f"relevance > 0 AND {floor_relevance(NMB, terms)} >= 0.66 AND {tail_strong(NMB, terms)}" if terms else "true"
    return scored("sh", src, terms, scores, False) + ",\n" + section("sh", "hot-memory", where, limit)


def future_section(limit: int, days: int | None, today: str, terms: list[str] | None = None) -> str:
    where = "status = 'open'" + (f" AND coalesce(TRY_CAST(due AS DATE) <= DATE '{today}' + {days}, true)" if days is not None else "")
    if terms:
        cols = ("'future'", "due", "body")
        where += f" AND {floor_relevance(cols, terms)} >= 0.66 AND {tail_strong(cols, terms)}"
    return f"""sf AS (SELECT 'due-future' AS section, due AS title, body, 'future_items:' || id AS source_path, 'company' AS scope, created_by AS owner, '{"matched-task" if terms else "due-future"}' AS reason, CAST(NULL AS DOUBLE) AS activation, '' AS confidence,
  row_number() OVER (ORDER BY due, id) AS place FROM future_items WHERE {where} ORDER BY place LIMIT {limit})"""


EP_ONE = f"ep AS (SELECT *, {at('ts')} AS u FROM (SELECT DISTINCT id, ts, actor, kind, summary, body, scope, source_path FROM episodes))"


def precedent_section(limit: int, terms: list[str]) -> str:
    cols = ("'episode'", "summary", "body")
    text = low("summary", "body", sep="\n")
    fits = " OR ".join(f"contains({text}, '{t}')" for t in terms)
    return f"""{EP_ONE},
newest AS (SELECT * REPLACE (coalesce(body, '') AS body) FROM ep WHERE kind <> 'miss' ORDER BY u DESC NULLS LAST, id LIMIT 500),
sp AS (SELECT 'episodic-precedent' AS section, summary AS title, substr(body, 1, 240) AS body, coalesce(source_path, '') AS source_path, scope, actor AS owner, 'matched-task' AS reason, CAST(NULL AS DOUBLE) AS activation, {marked('body')},
  row_number() OVER (ORDER BY u DESC NULLS LAST, id) AS place FROM newest WHERE ({fits}) AND {floor_relevance(cols, terms)} >= 0.66 AND {tail_strong(cols, terms)} ORDER BY place LIMIT {limit})"""


def scores(task: str) -> str:
    both = hits("cm", MEM, task, "company", 128, "status <> 'archived'", READER, M_SHAPE) + ",\n" + hits("cl", LOC, task, "company", 128, "status = 'active'", None, L_SHAPE)
    one = lambda n, p: f"{ranked(n, [p], 128)},\n{n}_v AS (SELECT id, max(-rank) AS score FROM {n} GROUP BY id)"
    return f"{both},\n{one('rm', 'cm')},\n{one('rl', 'cl')},\nallsc AS (SELECT * FROM rm_v UNION ALL SELECT * FROM rl_v)"


def context(task: str, budget: int) -> str:
    terms = task_terms(task)
    if not terms:
        return f"""WITH {ACT},
{ROWS},
{locks_section(budget)},
{hot_section(budget)},
{future_section(budget, None, NOW[:10])},
u AS (SELECT 0 AS sec, * FROM sl UNION ALL SELECT 1, * FROM sh UNION ALL SELECT 3, * FROM sf),
n AS (SELECT *, row_number() OVER (ORDER BY sec, place) AS line FROM u) SELECT line, {LINE} FROM n WHERE line <= {budget}"""
    spec = "reason <> 'house-rule-core'"
    return f"""WITH {ACT},
{ROWS},
{scores(task)},
{locks_section(budget, terms, 'allsc')},
{hot_section(budget, terms, 'rm_v')},
{precedent_section(budget, terms)},
{future_section(budget, None, NOW[:10], terms)},
b AS (SELECT *, row_number() OVER (ORDER BY sec, place) AS rn FROM (SELECT 0 AS sec, * FROM sl UNION ALL SELECT 1, * FROM sh)),
u AS (SELECT * EXCLUDE (rn) FROM b UNION ALL SELECT 2, * FROM sp WHERE NOT EXISTS (SELECT 1 FROM b WHERE rn <= {budget} AND {spec}) UNION ALL SELECT 3, * FROM sf),
c AS (SELECT *, row_number() OVER (ORDER BY sec, place) AS rn FROM u),
z AS (SELECT * EXCLUDE (rn) FROM c UNION ALL SELECT 4, 'nothing-specific', 'No task match', 'No task match above the relevance floor -- standing rules only.', '', 'company', 'shared', 'no-task-match', NULL, '', 1
      WHERE NOT EXISTS (SELECT 1 FROM c WHERE rn <= {budget} AND {spec})),
n AS (SELECT *, row_number() OVER (ORDER BY sec, place) AS line FROM z) SELECT line, {LINE} FROM n WHERE line <= {budget}"""


def timeline(start: str, end: str | None, limit: int = 100) -> str:
    upper = f" AND u < {us(end, 1)}" if end else ""
    return f"WITH {EP_ONE} SELECT id, ts, actor, kind, scope FROM ep WHERE u >= {us(start)}{upper} ORDER BY u DESC, id LIMIT {limit}"


LOCK_ONE = """l AS (SELECT DISTINCT id, slug, title, body, scope, locked_on, status, supersedes FROM locks),
lj AS (SELECT l.id, l.slug, l.title, l.body, l.scope, l.locked_on, l.status, o.slug AS supersedes_slug FROM l LEFT JOIN l o ON l.supersedes = o.id)"""
LEVEL = "CASE {0} WHEN 'os' THEN 2 WHEN 'company' THEN 1 ELSE 0 END"
PROMO = f"""{RECALLS},
each_ AS (SELECT memory_id, query_scope, count(*) AS n FROM rec WHERE memory_id IS NOT NULL AND query_scope IS NOT NULL GROUP BY ALL),
j AS (SELECT m.id, query_scope, n, {LEVEL.format('query_scope')} > {LEVEL.format('scope')} AS broader, {LEVEL.format('query_scope')} AS lvl FROM each_ JOIN memories m ON m.id = memory_id),
k AS (SELECT id, query_scope, row_number() OVER (PARTITION BY id ORDER BY n DESC, lvl DESC, query_scope DESC) AS rn FROM j WHERE broader),
said AS (SELECT j.id, CAST(sum(CASE WHEN broader THEN n ELSE 0 END) AS BIGINT) AS higher, any_value(CASE WHEN k.query_scope = 'os' THEN 'os' WHEN k.query_scope IS NOT NULL THEN 'company' END) AS suggested_scope
         FROM j LEFT JOIN k ON k.id = j.id AND k.rn = 1 GROUP BY j.id),
last_ AS (SELECT memory_id, max(ts) AS last_recall FROM recall_events WHERE memory_id IS NOT NULL AND ts IS NOT NULL GROUP BY memory_id)"""
TIER = "CASE WHEN {2} OR {0} = 'os' OR coalesce({1} = 'os', false) THEN 'operator' WHEN starts_with({0}, 'product:') OR {0} = 'company' THEN 'curator' ELSE 'operator' END"
HASH = "sha256(concat_ws(chr(10), coalesce(title, ''), coalesce(body, ''), coalesce(source_path, '')))"
OLD_NEW = f"""old AS (SELECT * REPLACE ({HASH} AS content_hash) FROM memories),
new AS (SELECT * REPLACE ({HASH} AS content_hash) FROM (SELECT * REPLACE (CASE WHEN length(body) % 5 = 0 THEN title || ' (new)' ELSE title END AS title, CASE WHEN length(body) % 7 = 0 THEN name || '-moved' ELSE name END AS name) FROM memories))"""
UNIX = "replace(text, chr(13) || chr(10), chr(10))"
LINES = f"list_filter(list_transform(string_split({UNIX}, chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '')"
MARKED = " OR ".join(f"contains({c}, '{w}')" for w in ("LOCKED", "non-negotiable", "NON-NEGOTIABLE") for c in ("title", "body")) + " OR contains(title, 'locked')"


def header(pattern: str) -> str:
    hit = f"list_filter(list_slice({LINES}, 1, 20), lambda x: regexp_matches(x, '^({pattern})'))[1]"
    return f"trim(regexp_replace({hit}, '^({pattern})', ''), ' ')"


def product(p: str, names: tuple = ("lower(name)",)) -> str:
    named = " OR ".join(f"({s}) = '{p}' OR starts_with({s}, '{p}-') OR starts_with({s}, 'project-{p}') OR starts_with({s}, 'product-{p}') OR ends_with({s}, '-{p}')" for s in map(slug, names))
    return f"contains({low('body')}, 'product:{p}') OR {named}"


def scope_guess(names: tuple = ("lower(name)",)) -> str:
    """Over columns name and body (and whatever else the names say)."""
    company = " OR ".join(f"contains({low('body')}, '{w}')" for w in ("company", "organization", "team"))
    prefixed = " OR ".join(f"starts_with({slug(n)}, 'feedback-')" for n in names)
    return f"CASE WHEN {prefixed} THEN 'company' {' '.join(f"WHEN {product(p, names)} THEN 'product:{p}'" for p in ('notebook', 'console', 'voice'))} WHEN {company} THEN 'company' ELSE 'os' END"


FIELD = lambda n: f"nullif(trim(regexp_replace(trim(regexp_extract(head, '(?m)^{n}:[ \\t]*(.*)$', 1), ' '), '^[\"'']|[\"'']$', '', 'g'), ' '), '')"
HEAD = "'(?s)\\A---\\n(.*?)\\n---\\n*(.*)\\z'"
EP_KEYS = ("ts", "actor", "kind", "summary", "source_path")

ORACLES: dict[str, str] = {
    "search_ranked_and": search(AND_QUERY),
    "search_ranked_or": search(OR_QUERY),
    "search_single_term": search(ONE_TERM),
    "search_owner_filter": search(ONE_TERM, owner="agent:planner"),
    "search_include_archived": search(ONE_TERM, archived=True, limit=50),
    "search_product_scope": search("cooling release", "product:notebook"),
    "search_os_scope": search("cooling release", "os"),
    "search_company_scope": search("cooling release", "company", limit=40),
    "search_episodes_ranked": f"WITH {hits('e', EPI, AND_QUERY, 'company', 20, shape=E_SHAPE)},\n{ranked('r', ['e'], 20)} SELECT * FROM r {FINAL} 20",
    "search_locks_ranked": f"""WITH {hits('l', LOC, 'rule cooling', 'company', 20, "status = 'active'", None, L_SHAPE)},\n{ranked('r', ['l'], 20)} SELECT * FROM r {FINAL} 20""",
    "ask_agent": f"WITH {search_ctes(AND_QUERY, 'company', 10, 'agent:planner', False, 'agent:curator')}, ok AS (SELECT 1 FROM (SELECT 'agent:planner' AS owner) WHERE {may_read('agent:curator')}) SELECT * FROM r WHERE EXISTS (SELECT 1 FROM ok) {FINAL} 10",
    "search_recall_log": f"""WITH {search_ctes(AND_QUERY, 'company', 10)}, h AS (SELECT * FROM r {FINAL} 10)
SELECT row_number() OVER (ORDER BY rank, scope_index, id) + 999999 AS id, id AS memory_id, '{READER}' AS queried_by, 'company' AS query_scope, '2026-06-10T00:00:00+00:00' AS ts FROM h WHERE kind = 'memory'""",
    "memory_relevance": f"WITH {scores(TASK)} SELECT * FROM rm_v",
    "bm25_raw": f"WITH {bm25('b', MEM, search_terms(OR_QUERY))} SELECT id, bm25, all_terms FROM b",
    "postings_size": f"""WITH t AS (SELECT id, 'title' AS field, unnest({index_tokens('title')}) AS term FROM memories UNION ALL SELECT id, 'body', unnest({index_tokens('body')}) FROM memories)
SELECT field, count(DISTINCT (id, term)) AS n_postings, count(*) AS n_tokens, count(DISTINCT term) AS n_terms FROM t GROUP BY field""",
    "match_floor": "SELECT id, " + (m := "CAST(" + " + ".join(f"CAST(len(list_filter({ascii_tokens('name', 'title', 'body')}, lambda x: starts_with(x, '{t}'))) > 0 AS INT)" for t in search_terms("rule heartbeat supersession café")) + " AS BIGINT)") + f" AS matched, round({m} / CAST({len(search_terms('rule heartbeat supersession café'))} AS DOUBLE), 6) AS ratio FROM memories",
    "acl_visible_memories": f"SELECT id, owner FROM memories WHERE {may_read('agent:curator')}",
    "activation_scores": f"WITH {ACT} SELECT * FROM act",
    "hot_cold_counts": f"WITH {ACT} SELECT count(*) FILTER (is_lock = 1 OR {HOT}) AS hot, count(*) FILTER (NOT (is_lock = 1 OR {HOT})) AS cold FROM memories LEFT JOIN act ON memory_id = id WHERE status <> 'archived'",
    "stats_scalars": f"""WITH {RECALLS}, e AS (SELECT DISTINCT id, kind FROM episodes), l AS (SELECT DISTINCT id, status FROM locks)
SELECT (SELECT count(*) FROM memories) AS memories, (SELECT count(*) FROM e) AS episodes, (SELECT count(*) FROM rec) AS recalls, (SELECT count(*) FROM e WHERE kind = 'miss') AS misses,
(SELECT count(*) FROM l WHERE status = 'active') AS active_locks, (SELECT count(*) FROM l WHERE status = 'superseded') AS superseded_locks""",
    **{f"memories_by_{c}": f"SELECT {c}, count(*) AS n FROM (SELECT DISTINCT id, {c} FROM memories) GROUP BY {c}" for c in ("scope", "owner", "status")},
    "episodes_by_kind": "SELECT kind, count(*) AS n FROM (SELECT DISTINCT id, kind FROM episodes) GROUP BY kind",
    "timeline_range": timeline("2025-03-01", "2025-03-31"),
    "timeline_day": timeline(DAY, DAY),
    "timeline_open_end": timeline("2026-01-01", None),
    "upcoming_all": "SELECT id, body, due, created_by, status, created_at FROM future_items WHERE status = 'open'",
    "upcoming_30_days": f"SELECT id, body, due, created_by, status, created_at FROM future_items WHERE status = 'open' AND coalesce(TRY_CAST(due AS DATE) <= DATE '{TODAY}' + 30, true)",
    "related_walk": (walk := """WITH l AS (SELECT DISTINCT * FROM links WHERE from_kind = 'memory'), e AS (SELECT DISTINCT id, summary, body, source_path FROM episodes)
SELECT from_id, to_kind, to_id, l.kind AS link_kind, coalesce(CASE WHEN to_kind = 'memory' THEN m.title ELSE e.summary END, '') AS title,
coalesce(substr(CASE WHEN to_kind = 'memory' THEN m.body ELSE e.body END, 1, 240), '') AS body, coalesce(CASE WHEN to_kind = 'memory' THEN m.source_path ELSE e.source_path END, '') AS source_path
FROM l LEFT JOIN memories m ON to_kind = 'memory' AND m.id = to_id LEFT JOIN e ON to_kind = 'episode' AND e.id = to_id"""),
    "related_by_name": f"SELECT * EXCLUDE (from_id) FROM ({walk}) WHERE from_id = (SELECT id FROM memories WHERE name = 'stistbrurk-calendar-supersession-8')",
    "wiki_targets": f"""SELECT DISTINCT id, {slug('x')} AS target FROM (SELECT id, unnest(regexp_extract_all(body, '\\[\\[([^\\]|]+)[^\\]]*\\]\\]', 1)) AS x FROM memories)""",
    "wiki_links_resolved": f"""SELECT DISTINCT 'memory' AS from_kind, t.id AS from_id, 'memory' AS to_kind, m.id AS to_id, 'wiki' AS kind
FROM (SELECT id, {slug('x')} AS target FROM (SELECT id, unnest(regexp_extract_all(coalesce(body, '') || ' [[' || replace(name, '-', ' ') || '|see]] [[' || upper(title) || ']]', '\\[\\[([^\\]|]+)[^\\]]*\\]\\]', 1)) AS x FROM memories)) t JOIN memories m ON m.name = t.target""",
    "locks_active": f"WITH {LOCK_ONE} SELECT * FROM lj WHERE status = 'active'",
    "locks_all_with_supersedes": f"WITH {LOCK_ONE} SELECT * FROM lj",
    "locks_render_order": f"WITH {LOCK_ONE} SELECT CASE WHEN scope = 'os' THEN 0 WHEN scope = 'company' THEN 1 WHEN scope LIKE 'product:%' THEN 2 ELSE 3 END AS scope_group, scope, locked_on, slug, supersedes_slug FROM lj WHERE status = 'active'",
    "locks_restatus": f"WITH {LOCK_ONE} SELECT DISTINCT id, slug, CASE WHEN id IN (SELECT supersedes FROM l WHERE supersedes IS NOT NULL) THEN 'superseded' ELSE 'active' END AS status FROM l",
    "prune_report": f"""WITH {ACT},
{ROWS} SELECT CASE WHEN is_lock = 1 THEN 'lock-exempt' ELSE 'cooling-candidate' END AS section, id, title, scope, owner, source_path, activation, {marked('title', 'body')} FROM mrows LEFT JOIN act ON memory_id = id WHERE status <> 'archived' AND (is_lock = 1 OR NOT {HOT})""",
    "consolidation_candidates": f"""WITH {PROMO},
{ACT.removeprefix(RECALLS + ',')},
b AS (SELECT m.*, coalesce(higher, 0) AS higher, suggested_scope AS ss, activation, last_recall FROM memories m LEFT JOIN said USING (id) LEFT JOIN act ON act.memory_id = m.id LEFT JOIN last_ ON last_.memory_id = m.id),
c AS (SELECT 'promotion-candidate' AS kind, *, ss AS suggested_scope, {TIER.format('scope', 'ss', 'is_lock = 1')} AS required_tier FROM b WHERE higher >= 2
 UNION ALL SELECT 'lock-exempt', *, NULL, 'operator' FROM b WHERE status <> 'archived' AND is_lock = 1
 UNION ALL SELECT 'cooling-candidate', *, NULL, 'archivist-report' FROM b WHERE status <> 'archived' AND is_lock = 0 AND NOT {HOT})
SELECT kind, id, title, name, owner, scope AS current_scope, suggested_scope, required_tier, higher, activation, last_recall, coalesce(source_path, '') AS source_path FROM c""",
    "higher_scope_counts": f"WITH {PROMO} SELECT id, higher FROM said",
    "suggested_scope": f"WITH {PROMO} SELECT id, suggested_scope FROM said",
    "last_recall": f"WITH {PROMO} SELECT * FROM last_",
    "promotion_tiers": f"""SELECT from_scope, to_scope, who, who = 'operator' OR (who = 'curator' AND ((from_scope = 'company' AND starts_with(to_scope, 'product:')) OR (starts_with(from_scope, 'product:') AND to_scope = 'company'))) AS allowed,
{TIER.format('from_scope', 'to_scope', 'false')} AS tier FROM (SELECT DISTINCT scope AS from_scope FROM memories), (SELECT DISTINCT scope AS to_scope FROM locks), (VALUES ('operator'), ('curator'), ('builder')) AS w(who)""",
    "context_locks": f"WITH {ACT},\n{ROWS},\n{scores(TASK)},\n{locks_section(15, task_terms(TASK), 'allsc')} SELECT {LINE} FROM sl",
    "context_hot": f"WITH {ACT},\n{ROWS},\n{scores(TASK)},\n{hot_section(15, task_terms(TASK), 'rm_v')} SELECT {LINE} FROM sh",
    "context_precedent": f"WITH {precedent_section(15, task_terms(TASK))} SELECT {LINE.replace(', activation', '')} FROM sp",
    "context_pack": context(TASK, 15),
    "context_signal_pack": context(SIGNAL_TASK, 40),
    "context_no_match": context(NO_TASK, 15),
    "context_no_terms": context("what is the", 30),
    "brief_pack": f"""WITH {ACT},
{ROWS},
{locks_section(5)},
{hot_section(8)},
{future_section(5, 30, NOW[:10])},
{EP_ONE},
sy AS (SELECT 'yesterday' AS section, summary AS title, coalesce(body, '') AS body, coalesce(source_path, '') AS source_path, scope, actor AS owner, 'yesterday' AS reason, CAST(NULL AS DOUBLE) AS activation, {marked('coalesce(body, chr(32))')},
  row_number() OVER (ORDER BY u DESC, id) AS place FROM ep WHERE u >= {us(DAY)} AND u < {us(DAY, 1)}),
n AS (SELECT *, row_number() OVER (ORDER BY sec, place) AS line FROM (SELECT 0 AS sec, * FROM sl UNION ALL SELECT 1, * FROM sh UNION ALL SELECT 2, * FROM sf UNION ALL SELECT 3, * FROM sy)) SELECT line, {LINE} FROM n WHERE line <= 20""",
    "lexical_relevance": f"WITH {ROWS} SELECT id, round({lexical(task_terms(SIGNAL_TASK))}, 6) AS lexical FROM mrows",
    "floor_and_tail": f"WITH {ROWS} SELECT id, round({floor_relevance(NMB, task_terms(SIGNAL_TASK))}, 6) AS signal_floor, round({floor_relevance(NMB, task_terms(TASK))}, 6) AS plain_floor, {tail_strong(NMB, task_terms(SIGNAL_TASK))} AS strong FROM mrows",
    "upsert_snapshot": f"""WITH {OLD_NEW},
k AS (SELECT o.id, o.name, n.name IS NOT NULL AND (o.content_hash <> n.content_hash OR o.status = 'archived') AS ch, n.title AS nt, o.title, o.status, o.created_at, o.updated_at FROM old o LEFT JOIN new n USING (name)),
a AS (SELECT (SELECT max(id) FROM old) + row_number() OVER (ORDER BY source_path NULLS FIRST, name) AS id, name, title FROM new WHERE name NOT IN (SELECT name FROM old))
SELECT id, name, CASE WHEN ch THEN nt ELSE title END AS title, CASE WHEN ch THEN 'hot' ELSE status END AS status, created_at, CASE WHEN ch THEN '2026-06-10T00:00:00+00:00' ELSE updated_at END AS updated_at FROM k
UNION ALL SELECT id, name, title, 'hot', '2026-06-10T00:00:00+00:00', '2026-06-10T00:00:00+00:00' FROM a""",
    "archive_absent": f"""WITH {OLD_NEW} SELECT id, CASE WHEN source_path IN (SELECT source_path FROM new WHERE source_path IS NOT NULL) AND NOT EXISTS (SELECT 1 FROM new n WHERE n.source_path = old.source_path AND n.name = old.name)
THEN 'archived' ELSE status END AS status FROM old""",
    "episodes_dedup": f"""WITH o AS (SELECT DISTINCT * FROM episodes), n AS (SELECT * REPLACE (CASE WHEN length(summary) % 2 = 0 THEN summary || ' (again)' ELSE summary END AS summary) FROM o),
f AS (SELECT *, row_number() OVER (PARTITION BY {', '.join(EP_KEYS)} ORDER BY id) AS rn, {' OR '.join(f'{k} IS NULL' for k in EP_KEYS)} AS loose FROM n)
SELECT id, ts, actor, kind, summary FROM f WHERE loose OR (rn = 1 AND NOT EXISTS (SELECT 1 FROM o WHERE {' AND '.join(f'o.{k} = f.{k}' for k in EP_KEYS)}))""",
    "seed_recalls": "SELECT id AS memory_id, 'system:ingest' AS queried_by, scope AS query_scope, updated_at AS ts FROM memories WHERE id NOT IN (SELECT memory_id FROM recall_events WHERE memory_id IS NOT NULL)",
    "promote_snapshot": "SELECT id, CASE WHEN id = 8 THEN 'os' ELSE scope END AS scope, CASE WHEN id = 8 THEN '2026-06-10T00:00:00+00:00' ELSE updated_at END AS updated_at FROM memories",
    "promote_audit": """SELECT '2026-06-10T00:00:00+00:00' AS ts, 'operator' AS actor, 'promotion' AS kind, scope || ' -> os: ' || name AS summary,
'memory_id=' || id || ' owner=' || coalesce(owner, 'None') || ' title=' || title || ' from_scope=' || scope || ' to_scope=os' AS body, 'os' AS scope, source_path FROM memories WHERE id = 8""",
    "recalls_per_scope": f"WITH {PROMO} SELECT id, query_scope, n FROM j",
    "consolidation_first": "SELECT kind, id, row_number() OVER (ORDER BY CASE kind WHEN 'promotion-candidate' THEN 0 WHEN 'cooling-candidate' THEN 1 ELSE 2 END, higher DESC, title, id) AS place FROM (@consolidation) QUALIFY place <= 40",
    "prune_first": "SELECT section, id, row_number() OVER (ORDER BY title, id) AS place FROM (@prune) QUALIFY place <= 40",
    "slugify_titles": f"SELECT id, {slug('title')} AS slug FROM memories",
    "title_tokens": f"SELECT token, count(DISTINCT id) AS n_memories FROM (SELECT id, unnest({index_tokens('title')}) AS token FROM memories) GROUP BY token",
    "content_hashes": f"SELECT id, {HASH} AS hash FROM memories",
    "markdown_sections": f"""WITH p AS (SELECT doc_id AS key, string_split(chr(10) || {UNIX}, chr(10) || '## ') AS ps FROM documents WHERE text IS NOT NULL),
q AS (SELECT key, k - 1 AS ordinal, ps[k] AS part FROM (SELECT *, unnest(range(2, len(ps) + 1)) AS k FROM p)),
s AS (SELECT key, ordinal, trim(split_part(part, chr(10), 1), ' ') AS title, regexp_replace(substr(part, length(split_part(part, chr(10), 1)) + 2), '^\\s+|\\s+$', '', 'g') AS body FROM q)
SELECT key, ordinal, title, length(body) AS n_body, CAST({MARKED} AS INTEGER) AS is_lock FROM s WHERE body <> ''""",
    "frontmatter_notes": f"""WITH t AS (SELECT doc_id AS key, {UNIX} AS x FROM documents), g AS (SELECT key, regexp_extract(x, '(?s)\\A---\\n(.*?)\\n---\\n*(.*)\\z', 1) AS head, regexp_extract(x, '(?s)\\A---\\n(.*?)\\n---\\n*(.*)\\z', 2) AS body FROM t WHERE regexp_matches(x, '(?s)\\A---\\n(.*?)\\n---\\n*(.*)\\z')),
f AS (SELECT key, nullif(trim(regexp_replace(trim(regexp_extract(head, '(?m)^name:[ \\t]*(.*)$', 1), ' '), '^[\"'']|[\"'']$', '', 'g'), ' '), '') AS name, coalesce(nullif(trim(regexp_replace(trim(regexp_extract(head, '(?m)^title:[ \\t]*(.*)$', 1), ' '), '^[\"'']|[\"'']$', '', 'g'), ' '), ''), nullif(trim(regexp_replace(trim(regexp_extract(head, '(?m)^description:[ \\t]*(.*)$', 1), ' '), '^[\"'']|[\"'']$', '', 'g'), ' '), ''), 'untitled') AS title, body FROM g)
SELECT key, coalesce(name, {slug('title')}) AS name, title, length(body) AS n_body FROM f""",
    "episode_lines": f"SELECT key, k - 1 AS ordinal, l[k] AS line FROM (SELECT key, l, unnest(range(1, len(l) + 1)) AS k FROM (SELECT doc_id AS key, list_slice({LINES}, 1, 50) AS l FROM documents WHERE text IS NOT NULL))",
    "team_log_lines": rf"""WITH l AS (SELECT key, k - 1 AS ordinal, l[k] AS line FROM (SELECT key, l, unnest(range(1, len(l) + 1)) AS k FROM (SELECT doc_id AS key, {LINES} AS l FROM documents WHERE source = 'team-log' AND text IS NOT NULL))),
m AS (SELECT *, regexp_extract(line, '^\[([^\]]*)\]', 1) AS who, trim(split_part(trim(regexp_replace(line, '^\[[^\]]*\]', ''), ' '), '|', 1), ' ') AS stamp FROM l)
SELECT key, ordinal, CASE WHEN who = '' THEN 'system' ELSE 'agent:' || replace({low('who')}, '-', '_') END AS actor,
strftime(CASE WHEN regexp_full_match(stamp, '\d{{4}}-\d{{2}}-\d{{2}} \d{{2}}:\d{{2}}( [AP]M)?') THEN coalesce(try_strptime(stamp, '%Y-%m-%d %I:%M %p'), try_strptime(stamp, '%Y-%m-%d %H:%M')) END, '%Y-%m-%d %H:%M') AS at, substr(line, 1, 240) AS line FROM m""",
    "dated_notes": f"SELECT * FROM (SELECT doc_id AS key, {header('DATE:|- Date:')} AS day, {header('FROM:|- Tool:')} AS sender FROM documents WHERE text IS NOT NULL) WHERE day IS NOT NULL OR sender IS NOT NULL",
    "scope_classification": f"SELECT id, {scope_guess()} AS guess FROM memories",
    "handoff_lines": f"""WITH d AS (SELECT 'note-' || doc_id AS tail, CASE doc_id % 3 WHEN 0 THEN '20250614T0910Z-' WHEN 1 THEN '20250615-' ELSE '' END AS head, doc_id, text, text AS body, list_slice({LINES}, 1, 50) AS l, {header('DATE:|- Date:')} AS day, {header('FROM:|- Tool:')} AS sender FROM documents WHERE text IS NOT NULL),
e AS (SELECT *, head || tail AS name, unnest(range(1, greatest(len(l), 1) + 1)) AS k FROM d)
SELECT '/w/handoffs/' || name || '.md' AS source_path,
strftime(CASE doc_id % 3 WHEN 0 THEN TIMESTAMP '2025-06-14 09:10:00' WHEN 1 THEN TIMESTAMP '2025-06-15' ELSE coalesce(TRY_CAST(substr(day, 1, 10) AS TIMESTAMP), make_timestamp((1767225600 + doc_id) * 1000000)) END + to_seconds(k - 1), '%Y-%m-%dT%H:%M:%S+00:00') AS ts,
CASE WHEN sender IS NULL THEN 'system' WHEN starts_with(lower(sender), 'agent:') THEN replace(lower(sender), '-', '_') ELSE 'agent:' || replace(lower(sender), '-', '_') END AS actor,
'handoff' AS kind, substr(coalesce(l[k], name), 1, 240) AS summary, {scope_guess()} AS scope FROM e""",
    "agent_notes": f"""WITH t AS (SELECT doc_id, '/w/memory/' || coalesce(lang, 'none') || '/note_' || doc_id || '.md' AS source_path, coalesce(lang, 'none') AS agent, 'note_' || doc_id AS name, {UNIX} AS x FROM documents WHERE text IS NOT NULL),
g AS (SELECT *, regexp_extract(x, {HEAD}, 1) AS head, trim(CASE WHEN regexp_matches(x, {HEAD}) THEN regexp_extract(x, {HEAD}, 2) ELSE x END, ' ') AS body FROM t),
h AS (SELECT *, coalesce({FIELD('title')}, {FIELD('description')}, replace(name, '_', ' ')) AS title FROM g)
SELECT source_path, coalesce({FIELD('name')}, {slug('name')}) AS name, title, 'agent:' || agent AS owner,
CASE WHEN lower(title) = 'active files' THEN 'os' WHEN NOT contains(lower(body), 'product:') THEN 'company' ELSE {scope_guess(('name', 'title'))} END AS scope,
sha256(concat_ws(chr(10), title, body, source_path)) AS content_hash, strftime(make_timestamp((1767225600 + doc_id) * 1000000), '%Y-%m-%dT%H:%M:%S+00:00') AS seen_at FROM h""",
    "latest_documents": """SELECT name, id FROM (SELECT concat_ws('/', owner, scope) AS name, id, row_number() OVER (PARTITION BY concat_ws('/', owner, scope) ORDER BY source_path DESC NULLS LAST, id DESC) AS rn FROM memories) WHERE rn = 1""",
    "remember_row": f"SELECT max(id) + 1 AS id, 'renew the key' AS body, '2026-07-01' AS due, '{READER}' AS created_by, 'open' AS status, '2026-06-10T00:00:00+00:00' AS created_at FROM future_items",
    "finished_items": "SELECT id, CASE WHEN id = 1 AND status = 'open' THEN 'done' ELSE status END AS status FROM future_items",
    "missed_row": f"SELECT max(id) + 1 AS id, '2026-06-10T00:00:00+00:00' AS ts, '{READER}' AS actor, 'miss' AS kind, 'where is the almanac' AS summary, 'where is the almanac' AS body, 'company' AS scope, '' AS source_path FROM episodes",
    "reset_counts": """SELECT (SELECT count(*) FROM future_items) AS future_items_kept, (SELECT count(*) FROM node_acl) AS access_rows_kept, (SELECT count(DISTINCT id) FROM episodes WHERE kind = 'miss') AS misses_kept,
(SELECT count(DISTINCT id) FROM episodes WHERE kind = 'promotion') AS promotion_audits_dropped""",
    "reset_kept": "SELECT 'future_items' AS tbl, count(*) AS n FROM (SELECT DISTINCT * FROM future_items) UNION ALL SELECT 'node_acl', count(*) FROM (SELECT DISTINCT * FROM node_acl) UNION ALL SELECT 'episodes', count(*) FROM (SELECT DISTINCT * FROM episodes WHERE kind = 'miss')",
    "scopes_map": "SELECT scope, count(*) AS n FROM memories WHERE scope IS NOT NULL GROUP BY scope",
    "bm25_appended": f"WITH {bm25('b', MEM, search_terms(OR_QUERY))} SELECT id, bm25, all_terms FROM b",
    "owner_of_path": r"""SELECT id, CASE WHEN regexp_extract(lower(coalesce(source_path, '')), '(?:^|/)memory/([^/.]+)/', 1) <> '' THEN 'agent:' || replace(regexp_extract(lower(source_path), '(?:^|/)memory/([^/.]+)/', 1), '-', '_')
""" + " ".join(f"WHEN list_contains({ascii_tokens('source_path')}, '{h}') THEN 'agent:{h}'" for h in ("planner", "engineer", "archivist")) + " ELSE 'shared' END AS guess FROM memories",
}
ORACLES["consolidation_first"] = ORACLES["consolidation_first"].replace("@consolidation", ORACLES["consolidation_candidates"])
ORACLES["prune_first"] = ORACLES["prune_first"].replace("@prune", ORACLES["prune_report"])
