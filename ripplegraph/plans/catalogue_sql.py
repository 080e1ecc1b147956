"""DuckDB SQL for the registered queries of the graph engine."""

from __future__ import annotations

from ripplegraph.operators.hashing import PREFIX


def _cents(c: str) -> str:
    return f"CAST(CAST(round({c} * 100) AS BIGINT) AS VARCHAR)"


_ROWS = f"""rows_ AS (
    SELECT 'region:' || r_regionkey AS id, 'region' AS kind, 'universe:' AS up, r_name AS txt FROM region
    UNION ALL SELECT 'nation:' || n_nationkey, 'nation', 'region:' || n_regionkey, n_name FROM nation
    UNION ALL SELECT 'customer:' || c_custkey, 'customer', 'nation:' || c_nationkey, c_name || '|' || {_cents("c_acctbal")} || '|' || c_mktsegment FROM customer
    UNION ALL SELECT 'supplier:' || s_suppkey, 'supplier', 'nation:' || s_nationkey, s_name || '|' || {_cents("s_acctbal")} FROM supplier
    UNION ALL SELECT 'part:' || p_partkey, 'part', 'universe:', p_name || '|' || p_brand || '|' || p_type || '|' || p_size || '|' || {_cents("p_retailprice")} FROM part
    UNION ALL SELECT 'order:' || o_orderkey, 'order', 'customer:' || o_custkey, o_orderstatus || '|' || {_cents("o_totalprice")} || '|' || o_orderpriority FROM orders
    UNION ALL SELECT 'lineitem:' || l_orderkey || ':' || l_linenumber || ':' || l_partkey || ':' || l_suppkey, 'lineitem', 'order:' || l_orderkey,
        {_cents("l_quantity")} || '|' || {_cents("l_extendedprice")} || '|' || {_cents("l_discount")} || '|' || {_cents("l_tax")} || '|' || l_returnflag || '|' || l_linestatus FROM lineitem)"""
_BASE = f"""{_ROWS},
entities AS (SELECT 'universe:' AS id, 'universe' AS kind UNION SELECT id, kind FROM rows_),
edges AS (
    SELECT up AS src, id AS dst, 'contains' AS kind FROM rows_
    UNION SELECT 'lineitem:' || l_orderkey || ':' || l_linenumber || ':' || l_partkey || ':' || l_suppkey, 'part:' || l_partkey, 'depends-on' FROM lineitem
    UNION SELECT 'lineitem:' || l_orderkey || ':' || l_linenumber || ':' || l_partkey || ':' || l_suppkey, 'supplier:' || l_suppkey, 'depends-on' FROM lineitem
    UNION SELECT 'order:' || o_orderkey, 'nation:' || c_nationkey, 'mentions' FROM orders JOIN customer ON o_custkey = c_custkey),
tokens AS (SELECT id, 'row:' || md5(string_agg(txt, chr(10) ORDER BY txt)) AS token FROM rows_ GROUP BY id),
deps AS (SELECT DISTINCT src, dst FROM edges WHERE kind <> 'mentions' AND src <> dst)"""
_NUMBER = "TRY_CAST(split_part(id, ':', 2) AS BIGINT)"
_HEAD = f"""gone AS (SELECT id FROM entities WHERE kind = 'supplier' AND {_NUMBER} % 37 = 0),
fresh AS (SELECT 'order:new-' || split_part(id, ':', 2) AS id, id AS up FROM entities WHERE kind = 'nation'),
entities2 AS (SELECT id, kind FROM entities WHERE id NOT IN (SELECT id FROM gone) UNION ALL SELECT id, 'order' FROM fresh),
edges2 AS (SELECT * FROM edges WHERE src NOT IN (SELECT id FROM gone) AND dst NOT IN (SELECT id FROM gone) UNION ALL SELECT up, id, 'contains' FROM fresh),
tokens2 AS (SELECT id, token || CASE WHEN (id LIKE 'order:%' AND {_NUMBER} % 97 = 0) OR (id LIKE 'part:%' AND {_NUMBER} % 211 = 0) THEN ':v2' ELSE '' END AS token
    FROM tokens WHERE id NOT IN (SELECT id FROM gone)),
deps2 AS (SELECT DISTINCT src, dst FROM edges2 WHERE kind <> 'mentions' AND src <> dst)"""


def _reach(name: str, deps: str, where: str = "true") -> str:
    return f"{name} AS (SELECT src, dst FROM {deps} WHERE {where} UNION SELECT r.src, d.dst FROM {name} r JOIN {deps} d ON r.dst = d.src WHERE r.src <> d.dst)"


def _told(name: str, reach: str, entities: str, tokens: str) -> str:
    """Everything that a sum covers, as one text."""
    return f"""{name} AS (SELECT e.id, coalesce(t.token, '') || '#' || coalesce(c.body, '') AS body FROM {entities} e LEFT JOIN {tokens} t ON t.id = e.id
    LEFT JOIN (SELECT r.src, string_agg(r.dst || '=' || coalesce(t.token, ''), ';' ORDER BY r.dst) AS body FROM {reach} r LEFT JOIN {tokens} t ON t.id = r.dst GROUP BY r.src) c ON c.src = e.id)"""


_CHANGED = f"""{_BASE}, {_HEAD}, {_reach("reach", "deps")}, {_reach("reach2", "deps2")},
{_told("told", "reach", "entities", "tokens")}, {_told("told2", "reach2", "entities2", "tokens2")},
delta AS (SELECT coalesce(a.id, b.id) AS id, CASE WHEN a.id IS NULL THEN 'added' WHEN b.id IS NULL THEN 'removed' ELSE 'modified' END AS status
    FROM told a FULL JOIN told2 b ON a.id = b.id WHERE a.body IS DISTINCT FROM b.body)"""


def _uvarint(n: str) -> str:
    """Hex of a number below 2^42."""
    byte = lambda k, more: f"lpad(lower(to_hex(CAST(({n} // {1 << (7 * k)}) % 128 + {128 if more else 0} AS BIGINT))), 2, '0')"
    cases = "".join(f"WHEN {n} < {1 << (7 * (k + 1))} THEN " + " || ".join(byte(j, j < k) for j in range(k + 1)) + " " for k in range(6))
    return f"CASE {cases} END"


def _entry(i: str, t: str) -> str:
    return f"{_uvarint(f'strlen({i})')} || lower(hex(encode({i}))) || {_uvarint(f'strlen({t})')} || lower(hex(encode({t})))"


def _sums(name: str, reach: str, entities: str, tokens: str, where: str) -> str:
    return f"""{name}_e AS (SELECT e.id, {_entry("e.id", "coalesce(t.token, '')")} AS entry FROM {entities} e LEFT JOIN {tokens} t ON t.id = e.id),
{name}_c AS (SELECT r.src, count(*) AS n, string_agg(x.entry, '' ORDER BY r.dst) AS body FROM {reach} r JOIN {name}_e x ON x.id = r.dst GROUP BY r.src),
{name} AS (SELECT e.id, coalesce(c.n, 0) AS n, sha256(unhex('{PREFIX.hex()}' || e.entry || {_uvarint("coalesce(c.n, 0)")} || coalesce(c.body, ''))) AS "sum"
    FROM {name}_e e JOIN {entities} k ON k.id = e.id LEFT JOIN {name}_c c ON c.src = e.id WHERE {where})"""


_URLS = """urls AS (SELECT page_id, regexp_extract(rest, '^[^/]*') AS host, regexp_replace(regexp_replace(rest, '^[^/]*/?', ''), '/$', '') AS path
    FROM (SELECT page_id, regexp_extract(url, '://([^?#]*)', 1) AS rest FROM pages)),
full_ AS (SELECT page_id, CASE WHEN path IS NULL THEN host ELSE host || '/' || path END AS p FROM urls),
above AS (SELECT page_id, '' AS tree FROM full_ UNION ALL
    SELECT page_id, array_to_string(list_slice(string_split(p, '/'), 1, i), '/') FROM (SELECT page_id, p, unnest(range(1, len(string_split(p, '/')))) AS i FROM full_))"""
_FOLD = """odd AS (SELECT page_id, host AS base, CASE page_id % 6 WHEN 0 THEN './' || path WHEN 1 THEN '../' || path WHEN 2 THEN path || '/../../..' WHEN 3 THEN '//' || path || '/./x'
    WHEN 4 THEN path || '//y/../z' ELSE '/' || path END AS value FROM urls),
todo AS (SELECT page_id, 'v' AS what, value AS p FROM odd UNION ALL
    SELECT page_id, 'r', CASE WHEN value LIKE '//%' THEN substr(value, 3) WHEN base = '' THEN value ELSE base || '/' || value END FROM odd),
fold AS (SELECT page_id, what, p, 1 AS i, CAST([] AS VARCHAR[]) AS done FROM todo UNION ALL
    SELECT page_id, what, p, i + 1, CASE WHEN seg IN ('', '.') THEN done WHEN seg = '..' AND len(done) > 0 AND done[len(done)] <> '..' THEN list_slice(done, 1, len(done) - 1) ELSE list_append(done, seg) END
    FROM (SELECT *, string_split(p, '/')[i] AS seg FROM fold) WHERE i <= len(string_split(p, '/'))),
clean AS (SELECT page_id, what, CASE WHEN p = '' OR p LIKE '/%' OR len(done) = 0 OR done[1] = '..' THEN NULL ELSE array_to_string(done, '/') END AS c FROM fold WHERE i = len(string_split(p, '/')) + 1)"""
_TARGETS = """targets AS (SELECT 'part:' || p_partkey AS id, lower(replace(p_type, ' ', '/')) AS path, lower(replace(p_brand, '#', '')) AS kind,
    CASE WHEN p_partkey % 4 = 0 THEN '' ELSE 'n' || (p_partkey % 50) END AS name, p_size % 4 AS idx, p_name AS label, 'size' || p_size AS more FROM part),
canon AS (SELECT *, '//' || path || '#' || kind || CASE WHEN name = '' THEN '' ELSE '.' || name END AS canonical FROM targets),
listed AS (SELECT id, CASE WHEN name = '' THEN [kind] ELSE [kind || '.' || name, name, kind] END || [kind || '.' || idx, more] AS al FROM targets),
named AS (SELECT id, alias, min(place) AS first_at FROM (SELECT id, unnest(al) AS alias, unnest(range(len(al))) AS place FROM listed) GROUP BY id, alias),
aliased AS (SELECT id, alias, row_number() OVER (PARTITION BY id ORDER BY first_at) - 1 AS place FROM named)"""



def _gid(kind: str, mod_path: str, name: str) -> str:
    return f"'go:{kind}:' || {mod_path} || ':' || rtrim(translate(base64(encode({name})), '+/', '-_'), '=')"


_PACKAGES = f"""{_URLS}, least_ AS (SELECT min(host) AS least FROM urls),
src_ AS (SELECT page_id, host, split_part(path, '/', 1) AS lang, length(host) % 3 = 0 AND split_part(path, '/', 1) = 'en' AS nested, page_id % 5 = 0 AS is_test,
    ['en', 'fr', 'de', 'zz'][page_id % 4 + 1] AS other, least FROM urls, least_),
placed AS (SELECT *, host || '/' || CASE WHEN nested THEN 'en/' ELSE '' END || 'go.mod' AS mod_path, 'mod.example/' || host || CASE WHEN nested THEN '' ELSE '/' || lang END AS pkg,
    host || '/' || lang || '/p' || page_id || CASE WHEN is_test THEN '_test.go' ELSE '.go' END AS file FROM src_),
own AS (SELECT *, CASE WHEN is_test THEN {_gid("package-test", "mod_path", "pkg")} ELSE {_gid("package", "mod_path", "pkg")} END AS src FROM placed),
dirs AS (SELECT DISTINCT host AS h, lang AS l, nested AS n, {_gid("package", "mod_path", "pkg")} AS local FROM placed),
asked AS (SELECT own.*, 'fmt' AS target, '' AS th, '' AS tl, 0 AS rule FROM own
    UNION ALL SELECT own.*, 'mod.example/' || host || '/' || other, host, other, 1 FROM own
    UNION ALL SELECT own.*, 'old.example/x/' || other, least, other, CASE WHEN nested THEN 3 ELSE 2 END FROM own
    UNION ALL SELECT own.*, 'mod.example/' || least || '/fr', least, 'fr', 1 FROM own
    UNION ALL SELECT own.*, 'lib.example/a/' || CASE WHEN page_id % 2 = 0 THEN 'deep' ELSE 'sub' END || '/z', '', '', 3 FROM own),
found AS (SELECT asked.*, d.local FROM asked LEFT JOIN dirs d ON d.h = th AND d.l = tl AND
    (rule = 2 OR rule = 1 AND NOT d.n AND (NOT asked.nested AND asked.host = th OR length(th) % 3 <> 0))),
used AS (SELECT src, mod_path, nested, host, target, CASE WHEN local IS NOT NULL THEN 'package' WHEN rule = 0 THEN 'package-stdlib' ELSE 'package-external' END AS to_kind,
    coalesce(local, CASE WHEN rule = 0 THEN {_gid("package-stdlib", "mod_path", "target")} ELSE {_gid("package-external", "mod_path", "target")} END) AS dst FROM found)"""

_NAME = "decode(from_base64(rpad(translate(part, '-_', '+/'), CAST(length(part) + (4 - length(part) % 4) % 4 AS INTEGER), '=')))"
#: What packages show, by the rules for each kind of line.
_LINES = f"""module_ AS (SELECT DISTINCT mod_path, host, nested FROM own),
version_ AS (SELECT mod_path, {_gid("go-version", "mod_path", "''")} AS dst, CASE WHEN nested THEN 'go version go=1.16'
    ELSE 'go version go=1.' || (length(host) % 4 + 18) || CASE WHEN length(host) % 2 = 0 THEN ',toolchain=go1.22.1' ELSE '' END END AS line FROM module_),
package_ AS (SELECT DISTINCT {_gid("package", "mod_path", "pkg")} AS id, 'go package ' || pkg AS label, mod_path, host, lang FROM own
    UNION SELECT src, 'go package-test ' || pkg, mod_path, host, lang FROM own WHERE is_test),
lines AS (SELECT p.id, '1' AS key, v.line, v.dst, CAST(NULL AS VARCHAR) AS module FROM package_ p JOIN version_ v ON v.mod_path = p.mod_path
    UNION SELECT src, '2' || string_split(file, '/')[-1] || ' git:' || file, 'file ' || string_split(file, '/')[-1], 'git:' || file, NULL FROM own
    UNION SELECT src, CASE to_kind WHEN 'package' THEN '3' WHEN 'package-stdlib' THEN '4' ELSE '5' END || line, line, dst, module FROM (SELECT src, to_kind, dst,
        CASE to_kind WHEN 'package' THEN 'import ' || {_NAME} WHEN 'package-stdlib' THEN 'std import ' || target ELSE 'external import ' || target END AS line,
        CASE WHEN to_kind = 'package-external' AND NOT nested AND target LIKE 'lib.example/a/deep/%' THEN 'lib.example/a/deep@v0.1.0'
            WHEN to_kind = 'package-external' AND NOT nested AND target LIKE 'lib.example/a/%' THEN CASE WHEN length(host) % 3 = 0 THEN 'fork.example/a@v1.3.0' ELSE 'lib.example/a@v1.2.' || (length(host) % 3) END END AS module
        FROM (SELECT *, split_part(dst, ':', 4) AS part FROM used WHERE to_kind <> 'package' OR dst IN (SELECT src FROM own WHERE NOT is_test))))"""
#: Nodes of the printed tree: place, label, the entity and the one it stands below.
_TREE = f"""host_ AS (SELECT DISTINCT host, 'git:' || host AS tree FROM placed),
lang_ AS (SELECT DISTINCT host, lang FROM placed UNION SELECT host, 'en' FROM host_ WHERE length(host) % 3 = 0),
targets_ AS (SELECT host, kind, 'target:' || kind || ':' || host || '/build.cfg:' || name AS id FROM host_, (VALUES ('codegen', 'go'), ('test', 'default'), ('lint', '0')) v(kind, name)),
held AS (SELECT tree AS src, tree || '/' || f AS dst, f AS label FROM host_, (VALUES ('go.mod'), ('build.cfg')) v(f)
    UNION SELECT 'git:' || host, 'git:' || host || '/' || lang, lang || '/' FROM lang_ UNION SELECT 'git:' || host, id, kind || ' ' || id FROM targets_
    UNION SELECT 'git:' || host || '/' || lang, 'git:' || file, string_split(file, '/')[-1] FROM placed UNION SELECT tree || '/en', tree || '/en/go.mod', 'go.mod' FROM host_ WHERE length(host) % 3 = 0
    UNION SELECT 'git:' || host || '/' || lang, id, label FROM package_),
needs AS (SELECT t.id AS src, p.id AS dst, p.label FROM targets_ t JOIN package_ p ON p.host = t.host WHERE t.kind = 'codegen' AND p.label LIKE 'go package %'
    UNION SELECT id, 'git:' || host || '/go.mod', host || '/go.mod' FROM targets_ WHERE kind <> 'lint' UNION SELECT id, 'git:' || host, 'git:' || host FROM targets_ WHERE kind = 'test'
    UNION SELECT id, 'target:codegen:' || host || '/build.cfg:go', 'codegen go' FROM targets_ WHERE kind = 'test'),
walk AS (SELECT ['0' || tree] AS place, host || '/' AS label, tree AS id, 'git:' AS parent FROM host_
    UNION ALL SELECT list_append(w.place, '0' || h.dst), h.label, h.dst, h.src FROM walk w JOIN held h ON h.src = w.id),
upper_ AS (SELECT * FROM walk UNION ALL SELECT list_append(w.place, '0' || n.dst), n.label, n.dst, n.src FROM walk w JOIN needs n ON n.src = w.id),
nodes AS (SELECT * FROM upper_ UNION ALL SELECT list_append(u.place, l.key), l.line, l.dst, l.id FROM upper_ u JOIN lines l ON l.id = u.id)"""
_PRINTED = """flags AS (SELECT place, label, place = max(place) OVER (PARTITION BY place[:-2]) AS last FROM shown),
    cut AS (SELECT place, unnest(range(1, len(place))) AS k FROM flags),
    lead_ AS (SELECT c.place, string_agg(CASE WHEN f.last THEN '    ' ELSE '│   ' END, '' ORDER BY c.k) AS prefix FROM cut c JOIN flags f ON f.place = c.place[:c.k] GROUP BY c.place)
    SELECT '' AS place, '.' AS line UNION ALL SELECT array_to_string(f.place, '|'), coalesce(l.prefix, '') || CASE WHEN f.last THEN '└── ' ELSE '├── ' END || f.label FROM flags f LEFT JOIN lead_ l ON l.place = f.place"""
ORACLES = {
    "universe_entities": f"WITH {_BASE} SELECT id, kind FROM entities",
    "universe_edges": f"WITH {_BASE} SELECT src, dst, kind FROM edges",
    "token_collect": f"""WITH {_BASE} SELECT 'universe:' || id AS id, token FROM tokens
        UNION ALL SELECT 'doc:' || doc_id, min(sha1(unhex(hex(encode('blob ' || strlen(coalesce(text, '')))) || '00' || hex(encode(coalesce(text, '')))))) FROM documents GROUP BY doc_id""",
    "graph_validate_violations": """WITH ids AS (SELECT 'line:' || l_orderkey || ':' || l_linenumber AS id FROM lineitem UNION ALL SELECT 'customer:' || c_custkey FROM customer),
        e AS (SELECT DISTINCT 'customer:' || user_id AS src, 'customer:' || (user_id * 7) AS dst, trim(replace(event_type, 'error', ' ')) AS kind FROM events)
        SELECT id, 'repeated id' AS problem FROM ids GROUP BY id HAVING count(*) > 1
        UNION SELECT src, 'blank relation' FROM e WHERE kind = ''
        UNION SELECT src, 'unknown source' FROM e WHERE src NOT IN (SELECT id FROM ids) UNION SELECT dst, 'unknown target' FROM e WHERE dst NOT IN (SELECT id FROM ids)""",
    "graph_absorb": f"""WITH {_BASE} SELECT kind, count(*) AS n FROM entities WHERE kind IN ('region', 'nation', 'customer', 'order') GROUP BY kind
        UNION ALL SELECT kind, count(*) FROM edges WHERE split_part(dst, ':', 1) IN ('region', 'nation', 'customer', 'order') GROUP BY kind""",
    "absorb_conflicts": f"WITH {_BASE} SELECT id, 'item,part' AS kinds FROM entities WHERE kind = 'part'",
    "namespace_counts": f"WITH {_BASE} SELECT split_part(id, ':', 1) AS namespace, count(*) AS n FROM entities GROUP BY 1",
    "out_edges": f"WITH {_BASE} SELECT src, dst, kind FROM edges WHERE split_part(src, ':', 1) IN ('nation', 'order')",
    "direct_dependencies": f"WITH {_BASE} SELECT src, dst FROM deps",
    "closure_pairs": f"WITH RECURSIVE {_BASE}, {_reach('reach', 'deps')} SELECT src, dst FROM reach",
    "closure_sizes": f"WITH RECURSIVE {_BASE}, {_reach('reach', 'deps')} SELECT src AS id, count(*) AS n, min(dst) AS least, max(dst) AS most FROM reach GROUP BY src",
    "reverse_reachability": f"""WITH RECURSIVE {_BASE}, back AS (SELECT id FROM entities WHERE kind = 'supplier' UNION SELECT d.src FROM back b JOIN deps d ON d.dst = b.id) SELECT id FROM back""",
    "scc_cycle": """WITH RECURSIVE nx AS (SELECT a.n_nationkey AS a, coalesce(min(CASE WHEN b.n_nationkey > a.n_nationkey THEN b.n_nationkey END), min(b.n_nationkey)) AS b
            FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey GROUP BY a.n_nationkey),
        d AS (SELECT 'nation:' || a AS src, 'nation:' || b AS dst FROM nx WHERE a <> b UNION SELECT 'customer:' || c_custkey, 'nation:' || c_nationkey FROM customer),
        ids AS (SELECT src AS id FROM d UNION SELECT dst FROM d),
        r AS (SELECT src, dst FROM d UNION SELECT r.src, d.dst FROM r JOIN d ON r.dst = d.src)
        SELECT i.id, least(i.id, coalesce(min(m.dst), i.id)) AS scc FROM ids i LEFT JOIN (SELECT a.src, a.dst FROM r a JOIN r b ON a.src = b.dst AND a.dst = b.src) m ON m.src = i.id GROUP BY i.id""",
    "content_hash": f"""WITH RECURSIVE {_BASE}, {_reach('reach', 'deps')}, {_sums('s', 'reach', 'entities', 'tokens', "true")} SELECT id, n, "sum" FROM s""",
    "uvarint_table": f"SELECT o_orderkey, {_uvarint('(o_orderkey * o_orderkey)')} AS bytes FROM orders",
    "diff_status": f"WITH RECURSIVE {_CHANGED} SELECT id, status FROM delta",
    "induced_edges": f"""WITH RECURSIVE {_CHANGED}, kept AS (SELECT id FROM delta WHERE status <> 'removed')
        SELECT src, dst, kind FROM edges2 WHERE src IN (SELECT id FROM kept) AND dst IN (SELECT id FROM kept)""",
    "frontier_layers": f"""WITH RECURSIVE {_CHANGED}, kept AS (SELECT id, status FROM delta WHERE status <> 'removed'),
        ins AS (SELECT d.src, d.dst FROM deps2 d JOIN kept a ON a.id = d.src JOIN kept b ON b.id = d.dst),
        lay AS (SELECT id, 0 AS layer FROM kept WHERE status = 'added' OR id NOT IN (SELECT src FROM ins) UNION SELECT i.src, l.layer + 1 FROM lay l JOIN ins i ON i.dst = l.id)
        SELECT id, min(layer) AS layer FROM lay GROUP BY id""",
    "change_depth": f"""WITH RECURSIVE {_CHANGED}, kept AS (SELECT id, status FROM delta WHERE status <> 'removed'),
        ins AS (SELECT d.src, d.dst FROM deps2 d JOIN kept a ON a.id = d.src JOIN kept b ON b.id = d.dst),
        lay AS (SELECT id, 0 AS layer FROM kept WHERE status = 'added' OR id NOT IN (SELECT src FROM ins) UNION SELECT i.src, l.layer + 1 FROM lay l JOIN ins i ON i.dst = l.id),
        near AS (SELECT id, min(layer) AS layer FROM lay GROUP BY id) SELECT max(layer) + 1 AS layers FROM near""",
    "range_hash_label": f"""WITH RECURSIVE {_BASE}, {_HEAD}, {_reach('reach', 'deps')}, {_reach('reach2', 'deps2')},
        {_sums('a', 'reach', 'entities', 'tokens', "true")}, {_sums('b', 'reach2', 'entities2', 'tokens2', "true")}
        SELECT b.id, CASE WHEN a."sum" IS NULL THEN 'new' ELSE left(a."sum", 12) || '..' || left(b."sum", 12) END AS label FROM b LEFT JOIN a ON a.id = b.id""",
    "containment_walk": f"""WITH RECURSIVE {_BASE}, walk AS (SELECT 'universe:' AS id, 0 AS depth, 'universe:' AS path UNION ALL
        SELECT e.dst, w.depth + 1, w.path || '>' || e.dst FROM walk w JOIN edges e ON e.src = w.id AND e.kind = 'contains') SELECT id, depth, path FROM walk""",
    "longest_prefix_owner": f"""WITH {_URLS}, modules AS (SELECT CASE WHEN pp IS NULL THEN host ELSE host || '/' || pp END AS module FROM (SELECT host, regexp_replace(path, '/?[^/]*$', '') AS pp FROM urls)
            GROUP BY 1 HAVING count(*) >= 3)
        SELECT u.page_id, max_by(m.module, length(m.module)) AS module FROM urls u LEFT JOIN above a ON a.page_id = u.page_id LEFT JOIN modules m ON m.module = a.tree GROUP BY u.page_id""",
    "package_graph_edges": f"""WITH {_PACKAGES} SELECT src, dst, 'imports' AS kind FROM used UNION SELECT src, 'git:' || file, 'source-file' FROM own
        UNION SELECT src, {_gid("package", "mod_path", "pkg")}, 'tests' FROM own WHERE is_test
        UNION SELECT id, {_gid("go-version", "mod_path", "''")}, 'go-version' FROM (SELECT src AS id, mod_path FROM own UNION SELECT {_gid("package", "mod_path", "pkg")}, mod_path FROM own
            UNION SELECT dst, mod_path FROM used WHERE to_kind <> 'package')""",
    "package_values": f"""WITH {_PACKAGES}, tested_ AS (SELECT DISTINCT host, lang FROM own WHERE is_test),
        q AS (SELECT page_id, page_id % 8 AS k, page_id % 3 = 0 AS t, length(own.host) % 3 = 0 AS twice, pkg, mod_path, tested_.host IS NOT NULL AS tested FROM own LEFT JOIN tested_ ON tested_.host = own.host AND tested_.lang = own.lang),
        p AS (SELECT *, CASE WHEN k = 3 THEN 'a source, not a package' WHEN k IN (2, 5) AND twice THEN 'in two modules' WHEN k IN (4, 5) THEN 'not found' WHEN t AND (k = 6 OR NOT tested) THEN 'no test sources' WHEN k = 6 THEN 'no sources' END AS problem FROM q)
        SELECT page_id AS id, CASE WHEN problem IS NOT NULL THEN NULL WHEN t THEN {_gid("package-test", "mod_path", "pkg")} ELSE {_gid("package", "mod_path", "pkg")} END AS dst, problem FROM p""",
    "package_versions": f"""WITH {_PACKAGES}, e AS (SELECT DISTINCT mod_path, target, nested, host FROM used WHERE to_kind = 'package-external')
        SELECT mod_path, target, CASE WHEN NOT nested AND target LIKE 'lib.example/a/deep/%' THEN 'go-module:lib.example/a/deep@v0.1.0'
            WHEN NOT nested AND target LIKE 'lib.example/a/%' THEN CASE WHEN length(host) % 3 = 0 THEN 'go-module:fork.example/a@v1.3.0' ELSE 'go-module:lib.example/a@v1.2.' || (length(host) % 3) END END AS token,
        CASE WHEN NOT nested AND target LIKE 'old.example/x/%' THEN 'replaced by a path without a package' WHEN nested OR target NOT LIKE 'lib.example/a/%' THEN 'not required' END AS problem FROM e""",
    "language_versions": f"""WITH {_URLS}, h AS (SELECT DISTINCT host FROM urls)
        SELECT {_gid("go-version", "host || '/go.mod'", "''")} AS id, 'go-version:go=1.' || (length(host) % 4 + 18) || CASE WHEN length(host) % 2 = 0 THEN ',toolchain=go1.22.1' ELSE '' END AS token FROM h
        UNION ALL SELECT {_gid("go-version", "host || '/en/go.mod'", "''")}, 'go-version:go=1.16' FROM h WHERE length(host) % 3 = 0""",
    "package_tests": f"WITH {_PACKAGES} SELECT DISTINCT src AS id, host || '/' || lang AS dir, mod_path FROM own WHERE is_test",
    "import_kinds": f"WITH {_PACKAGES} SELECT mod_path, to_kind AS kind, count(*) AS n FROM (SELECT DISTINCT mod_path, src, dst, to_kind FROM used) GROUP BY 1, 2",
    "path_clean": f"""WITH RECURSIVE {_URLS}, {_FOLD} SELECT c.page_id, c.c AS cleaned, CASE WHEN o.value IN ('', '.') THEN '' ELSE c.c END AS tree
        FROM clean c JOIN odd o ON o.page_id = c.page_id WHERE c.what = 'v'""",
    "path_resolve": f"""WITH RECURSIVE {_URLS}, {_FOLD} SELECT c.page_id, CASE WHEN o.value = '' OR (o.value LIKE '/%' AND o.value NOT LIKE '//%') THEN NULL ELSE c.c END AS resolved,
        regexp_replace(o.base || '/' || o.value, '/?[^/]*$', '') AS parent FROM clean c JOIN odd o ON o.page_id = c.page_id WHERE c.what = 'r'""",
    "path_within": f"""WITH {_URLS}, d AS (SELECT page_id, path, CASE page_id % 3 WHEN 0 THEN '' WHEN 1 THEN split_part(path, '/', 1) ELSE substr(path, 1, 1) END AS d FROM urls)
        SELECT page_id, path = d OR d = '' OR starts_with(path, d || '/') AS is_within, CASE WHEN path = d THEN '' WHEN d = '' THEN path WHEN starts_with(path, d || '/') THEN substr(path, length(d) + 2) END AS rest FROM d""",
    "ancestor_trees": f"WITH {_URLS} SELECT tree, count(*) AS n FROM above GROUP BY tree",
    "prune_empty": f"""WITH {_URLS}, left_ AS (SELECT p, min(page_id) AS page_id FROM full_ GROUP BY p HAVING min(page_id) % 2 = 1)
        SELECT DISTINCT tree FROM above JOIN left_ USING (page_id) WHERE tree <> ''""",
    "glob_match": f"""WITH {_URLS}, g AS (SELECT 'en/*' AS pattern, '^en/[^/]*$' AS r UNION ALL SELECT '**/*.html', '^([^/]+/)*[^/]*[.]html$' UNION ALL SELECT '{{fr,de}}/**', '^(fr|de)(/.*)?$'
            UNION ALL SELECT 'e?/[1-4]*', '^e[^/]/[1-4][^/]*$' UNION ALL SELECT '*', '^[^/]*$')
        SELECT page_id, pattern FROM urls JOIN g ON regexp_matches(path, r)""",
    "overlay_upsert": f"""WITH {_URLS}, base AS (SELECT p AS path, min(page_id) AS page_id FROM full_ GROUP BY p HAVING length(p) % 9 <> 0),
        deleted AS (SELECT DISTINCT p AS path FROM full_ WHERE length(p) % 9 = 0),
        under AS (SELECT base.path FROM base JOIN above USING (page_id) JOIN deleted ON deleted.path = above.tree),
        files AS (SELECT path, page_id, length(path) % 4 = 0 AS edited, 'edit of ' || path AS body FROM base WHERE length(path) % 4 = 0 OR path NOT IN (SELECT path FROM under))
        SELECT path, 'blob' AS kind, CASE WHEN edited THEN sha1(unhex(hex(encode('blob ' || strlen(body))) || '00' || hex(encode(body)))) ELSE sha1(CAST(page_id AS VARCHAR)) END AS oid,
            CASE WHEN edited THEN 'worktree' ELSE 'stored' END AS source FROM files
        UNION ALL SELECT tree, 'tree', repeat('0', 40), coalesce(max(b.source), max(CASE WHEN edited THEN 'worktree' ELSE 'stored' END)) FROM files JOIN above USING (page_id)
            LEFT JOIN (SELECT DISTINCT tree AS t, 'stored' AS source FROM above a JOIN (SELECT min(page_id) AS page_id FROM full_ GROUP BY p) k USING (page_id)) b ON b.t = tree WHERE tree <> '' GROUP BY tree""",
    "git_blob_hash": "SELECT doc_id, sha1(unhex(hex(encode('blob ' || strlen(t))) || '00' || hex(encode(t)))) AS oid FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)",
    "duplicate_blobs": """SELECT sha1(unhex(hex(encode('blob ' || strlen(t))) || '00' || hex(encode(t)))) AS oid, count(*) AS n, min(doc_id) AS first
        FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents) GROUP BY 1 HAVING count(*) > 1""",
    "id_codec": """SELECT doc_id, 'doc:package:mod/x:' || rtrim(translate(base64(encode(coalesce(text, ''))), '+/', '-_'), '=') AS id, true AS round_trip, 'doc' AS namespace FROM documents""",
    "selector_parse": f"""WITH {_TARGETS}, asked AS (SELECT id, CASE WHEN length(label) % 2 = 0 THEN canonical ELSE kind || '#' || name || '#x' END AS t FROM canon),
        r AS (SELECT id, starts_with(t, '//') AS rooted, CASE WHEN starts_with(t, '//') THEN substr(t, 3) ELSE t END AS t FROM asked)
        SELECT id, substr(t, 1, instr(t, '#') - 1) AS path, substr(t, instr(t, '#') + 1) AS identifier, rooted FROM r""",
    "selector_aliases": f"WITH {_TARGETS} SELECT id, place, alias FROM aliased",
    "selector_resolve": f"""WITH {_TARGETS}, inputs AS (SELECT DISTINCT CASE r WHEN 0 THEN '#n' || k WHEN 1 THEN 'brand11.n' || k WHEN 2 THEN 'size' || k ELSE '//economy#n' || k END AS input
            FROM (SELECT s_suppkey % 50 AS k, s_suppkey % 5 AS r FROM supplier)),
        s AS (SELECT input, contains(input, '#') AS pathed, starts_with(input, '//') AS rooted, CASE WHEN contains(input, '#') THEN substr(input, instr(input, '#') + 1) ELSE input END AS ident FROM inputs),
        hits AS (SELECT s.input, c.id, c.canonical, CASE WHEN s.pathed OR c.path = 'economy' THEN 1 WHEN starts_with(c.path, 'economy/') THEN 2 ELSE 3 END AS rank
                FROM s JOIN aliased a ON a.alias = s.ident JOIN canon c ON c.id = a.id WHERE NOT s.pathed OR c.path = 'economy'
            UNION SELECT s.input, c.id, c.canonical, 0 FROM s JOIN canon c ON c.canonical = s.input
            UNION SELECT s.input, c.id, c.canonical, 4 FROM s JOIN canon c ON c.label = s.input WHERE NOT s.pathed AND c.label <> ''),
        best AS (SELECT h.* FROM hits h JOIN (SELECT input, min(rank) AS rank FROM hits GROUP BY input) b ON b.input = h.input AND b.rank = h.rank),
        o AS (SELECT input, id, row_number() OVER (PARTITION BY input ORDER BY canonical, id) AS k, count(*) OVER (PARTITION BY input) AS n FROM best)
        SELECT input, n, id AS first FROM o WHERE k = 1""",
    "completion_match": f"""WITH {_TARGETS}, short AS (SELECT path, canonical, kind || CASE WHEN name = '' THEN '' ELSE '.' || name END AS s FROM canon)
        SELECT DISTINCT s AS text, 0 AS place FROM short WHERE path = 'economy' AND starts_with(s, 'brand1')
        UNION SELECT DISTINCT substr(path, 9) || '#' || s, 1 FROM short WHERE starts_with(path, 'economy/') AND starts_with(substr(path, 9) || '#' || s, 'brand1')
        UNION ALL SELECT DISTINCT canonical, 0 FROM short WHERE starts_with(canonical, '//econ')""",
    "kind_local_index": """SELECT p_partkey, row_number() OVER (PARTITION BY p_type, p_brand ORDER BY p_partkey) - 1 AS place, count(*) OVER (PARTITION BY p_type, p_brand, p_name) > 1 AS repeats FROM part""",
    "text_functions": """SELECT p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(substr(w, 1, 1)) || substr(w, 2)), ' ') AS title,
        CASE WHEN starts_with(p_type, 'ECO') THEN substr(p_type, 4) ELSE p_type END AS trimprefix, CASE WHEN p_name LIKE '%t' THEN substr(p_name, 1, length(p_name) - 1) ELSE p_name END AS trimsuffix,
        trim(p_name, 'ct') AS trim, substr(p_name, 3, 5) AS substr, substr(p_name, length(p_name) - 2) AS tail, p_name || chr(10) || '  x' AS indent, reverse(p_name) AS strrev, p_name AS chomp,
        replace(p_name, ' ', '+') AS replaced, base64(encode(repeat(p_name || ' ', 8) || p_name)) AS base64encode, p_name AS basename, p_type AS dirname, p_name AS trimspace FROM part""",
    "collection_functions": """WITH p AS (SELECT *, string_split(p_name, '') AS a FROM part),
        q AS (SELECT p_partkey, array_to_string(list_sort(list_filter(list_distinct(a), lambda x: x IN ('a', 'e'))), ',') AS b FROM p)
        SELECT p.p_partkey, rtrim(regexp_replace(p_name, '(.{4})', '\\1|', 'g'), '|') AS chunks, len(list_distinct(a)) AS n_distinct, array_to_string(list_filter(a, lambda x: x <> 'e'), ',') AS compact,
        a[CAST(p.p_partkey % len(a) AS BIGINT) + 1] AS element, array_to_string(list_slice(a, 2, 4), ',') AS slice, 'a,b' AS keys, p_type || ',' || p_brand AS values_, 'none' AS lookup,
        array_to_string(range(p_size % 5), ',') AS range, array_to_string(list_sort(a), ',') AS sorted, 2 * len(a) AS n_product, q.b AS both, 'later' AS merged FROM p JOIN q ON q.p_partkey = p.p_partkey""",
    "number_functions": """SELECT p_partkey, abs(p_size - 25) AS abs, CAST(sign(p_size - 25) AS INTEGER) AS signum, CAST(ceil(p_size / 4) AS BIGINT) AS ceil, CAST(floor(p_size / 4) AS BIGINT) AS floor,
        greatest(p_size, 30) AS max, least(p_size, 30) AS min, CAST(p_size AS BIGINT) * p_size AS pow, CAST(round(p_retailprice * 100) AS BIGINT) AS parseint, round(ln(p_size + 1) / ln(2), 6) AS log FROM part""",
    "hash_functions": "SELECT doc_id, md5(t) AS md5, sha1(t) AS sha1, sha256(t) AS sha256 FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)",
    "more_functions": """WITH o AS (SELECT *, o_orderpriority AS w, o_orderkey AS n, string_split(o_orderpriority, '-') AS a, CAST(o_orderdate AS TIMESTAMP) AS t FROM orders)
        SELECT o_orderkey, w AS base64decode, w AS coalesced, array_to_string(a, '+') AS coalescelist, array_to_string(a, ',') || ',e' AS concat, list_contains(a, 'HIGH') AS contains,
        CASE WHEN n % 2 = 0 THEN NULL ELSE n END AS converted, '<' || array_to_string(a, '><') || '>' AS formatlist,
        w || '/"' || o_orderstatus || '" is ' || lpad(CAST(n AS VARCHAR), CAST(greatest(5, length(CAST(n AS VARCHAR))) AS INTEGER), '0') || '% or ' || printf('%.2f', o_totalprice) || ', ' || lower(to_hex(n)) AS format,
        strftime(t, '%a, %-d %b %Y %I:%M ') || lower(strftime(t, '%p')) || ' at ' || strftime(t, '%H') || ' Z' AS formatdate, t - INTERVAL 5400500 MILLISECONDS AS timeadd,
        CASE WHEN n % 2 = 0 THEN -n ELSE n END AS parseint, n + n % 2 AS indexed, array_to_string(a, ',') || ',' || w || ',z' AS flatten, lower(w) AS lower, w AS upper, array_to_string(a, '|') AS joined,
        '{"a":' || n || ',"b":"' || w || '"}' AS jsonencode, n AS jsondecode, regexp_replace(w, '[0-9]+-?', '', 'g') AS regex_replace, array_to_string(list_reverse(a), ',') AS reversed,
        array_to_string(list_sort(list_distinct(a || ['HIGH', 'a'])), ',') AS setunion, length(w) AS strlen, replace(replace(w, ' ', '+'), '/', '%2F') || '+%26%3D' AS urlencode, '2' AS zipmap FROM o""",
    "target_references": f"""WITH {_TARGETS}, d AS (SELECT path, kind, name, min(id) AS dst, count(*) AS c FROM targets GROUP BY 1, 2, 3),
        w AS (SELECT id, path, 'brand' || (idx + 1) || '1' AS kind, CASE WHEN name = '' THEN 'n7' ELSE name END AS name FROM targets)
        SELECT w.id, CASE WHEN c = 1 THEN dst END AS dst, CASE WHEN c IS NULL THEN 'not declared' WHEN c > 1 THEN 'declared twice' END AS problem FROM w LEFT JOIN d ON d.path = w.path AND d.kind = w.kind AND d.name = w.name""",
    "path_dependencies": f"""WITH {_URLS}, w AS (SELECT page_id, p, CASE page_id % 4 WHEN 0 THEN p WHEN 1 THEN regexp_replace(p, '/?[^/]*$', '') WHEN 2 THEN '' ELSE p || '.none' END AS path FROM full_)
        SELECT 'page:' || page_id AS id, CASE WHEN path IN (SELECT p FROM full_) OR path IN (SELECT tree FROM above) THEN 'git:' || path END AS dst,
        CASE WHEN path IN (SELECT p FROM full_) THEN 'blob' WHEN path IN (SELECT tree FROM above) THEN 'tree' END AS kind FROM w""",
    "nearest_settings": f"""WITH {_URLS}, d AS (SELECT page_id, host, host || '/' || split_part(path, '/', 1) AS dir FROM urls)
        SELECT 'page:' || page_id AS id, CASE WHEN length(dir) % 5 = 0 THEN 'run ' || dir WHEN length(host) % 2 = 0 THEN 'run ' || host ELSE 'run' END AS value FROM d""",
    "target_graph": f"WITH {_TARGETS} SELECT 'git:' || path || '/build.cfg' AS src, id AS dst, 'contains' AS kind FROM targets UNION ALL SELECT 'git:' || path, id, 'contains' FROM targets",
    "config_rows": f"""WITH {_TARGETS} SELECT '//' || path || '/build.cfg#' || kind || '.' || CASE WHEN name = '' THEN CAST(idx AS VARCHAR) ELSE name END AS key, id FROM targets
        UNION ALL SELECT DISTINCT '//' || path || '/build.cfg#shell', NULL FROM targets WHERE name = 'n7'""",
    "targets_by_kind": f"WITH {_TARGETS} SELECT kind, row_number() OVER (PARTITION BY kind ORDER BY path || '/build.cfg', idx, id) - 1 AS place, id FROM targets",
    "package_lines": f"""WITH {_PACKAGES}, {_LINES} SELECT id, key, CASE WHEN key = '1' THEN line || ' ' || right(dst, 3) WHEN key[1] = '5' AND module IS NOT NULL THEN line || ' (' || module || ')' ELSE line END AS line FROM lines""",
    "graph_tree": f"""WITH RECURSIVE {_PACKAGES}, {_LINES}, {_TREE}, shown AS (SELECT place, label FROM nodes), {_PRINTED}""",
    "cone_tree": f"""WITH RECURSIVE {_PACKAGES}, {_LINES}, {_TREE}, fresh AS (SELECT DISTINCT host, 'git:' || host || '/NEW.md' AS id FROM placed WHERE length(host) % 2 = 0),
        followed AS (SELECT src, dst FROM held UNION SELECT 'git:' || host, id FROM fresh UNION SELECT 'git:', 'git:' || host FROM placed UNION SELECT src, dst FROM needs UNION SELECT src, dst FROM used
            UNION SELECT src, 'git:' || file FROM own UNION SELECT src, {_gid("package", "mod_path", "pkg")} FROM own WHERE is_test UNION SELECT 'git:' || host || '/build.cfg', id FROM targets_),
        cone AS (SELECT 'git:' || file AS id FROM own WHERE page_id % 7 = 0 UNION SELECT id FROM fresh UNION SELECT f.src FROM cone c JOIN followed f ON f.dst = c.id),
        shown AS (SELECT place, label FROM nodes WHERE id IN (SELECT id FROM cone) AND parent IN (SELECT id FROM cone)
            UNION SELECT ['0git:' || host, '0' || id], 'NEW.md' FROM fresh), {_PRINTED}""",
    "selector_trees": f"""WITH {_TARGETS} SELECT id, path AS tree, idx = 0 OR idx = 1 OR idx = 2 AND path = 'x/x/' || kind AS matches, path AS dir, path AS test_path FROM targets""",
    "compared_revisions": """WITH r AS (SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 2 = 0 THEN 'b' || (o_orderkey % 7) END, '') AS b, CASE WHEN o_orderkey % 5 = 0 THEN 'HEAD' WHEN o_orderkey % 5 = 1 THEN 'main' ELSE '' END AS h,
            o_orderkey % 11 < 3 AS w, o_orderkey % 13 < 6 AS d FROM orders),
        x AS (SELECT o_orderkey, CASE WHEN b <> '' THEN b WHEN w OR d THEN 'HEAD' ELSE 'HEAD^' END AS base, CASE WHEN h <> '' THEN h ELSE 'HEAD' END AS head, w OR (d AND h = '') AS with_edits,
            NOT w AND (b = '' OR h = '') AS asks FROM r)
        SELECT *, base || '..' || CASE WHEN NOT with_edits THEN head WHEN head = 'HEAD' THEN 'working tree' ELSE head || ' + working tree' END AS label FROM x""",
    "dependency_lines": f"WITH {_PACKAGES}, {_LINES}, {_TREE} SELECT src AS id, label AS line FROM needs",
    "import_labels": f"""WITH {_PACKAGES} SELECT src AS id, CASE WHEN is_test THEN 'go package-test ' ELSE 'go package ' END || pkg AS label FROM own
        UNION SELECT {_gid("package", "mod_path", "pkg")}, 'go package ' || pkg FROM own UNION SELECT dst, dst FROM used WHERE to_kind <> 'package' UNION SELECT g, g FROM (SELECT {_gid("go-version", "mod_path", "''")} AS g FROM own)""",
}
