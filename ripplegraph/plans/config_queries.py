"""Queries of the configuration language's tables: globs and file sets, files read, records, address ranges."""

from __future__ import annotations

from pyspark.sql import functions as F

from ripplegraph.functions import addresses, records
from ripplegraph.functions.paths import parent
from ripplegraph.operators import dependencies, globs
from ripplegraph.plans.catalogue_sql import _URLS
from ripplegraph.sources import git
from ripplegraph.sources.universe import read


def _pages(spark, sf_dir):
    """page_id, host, path, html: each page's path once, below its host."""
    rest = F.regexp_extract("url", "://([^?#]*)", 1)
    host, below = F.regexp_extract(rest, "^[^/]*", 0), F.regexp_replace(F.regexp_replace(rest, "^[^/]*/?", ""), "/$", "")
    rows = read(spark, sf_dir, "pages").select("page_id", host.alias("host"), F.concat_ws("/", host, below).alias("path"), F.coalesce("html", F.lit("")).alias("html"))
    return rows.groupBy("path").agg(F.min(F.struct("page_id", "host", "html")).alias("x")).select("path", "x.*")


def glob_table(spark, sf_dir):
    """Patterns made of pages' hosts, folders and names, against all pages' paths."""
    pages = _pages(spark, sf_dir)
    folder, name = F.regexp_extract("path", "/([^/]*)/", 1), F.substring_index("path", "/", -1)
    zone = F.substring_index("host", ".", -1)
    made = [
        F.concat("host", F.lit("/**")), F.concat(F.lit("**/"), name), F.concat(F.lit("*."), zone, F.lit("/e?/*[1-5]")), F.concat(F.lit("{m,www}.*/"), folder, F.lit("/[!1-4]*")),
        F.concat(F.lit("**/"), folder, F.lit("/*")),
    ]
    return globs.matches(pages, pages.select(F.explode(F.array(*made)).alias("pattern")))


def glob_fileset(spark, sf_dir):
    """The files of each host that a pattern names, seen from the host."""
    pages = _pages(spark, sf_dir)
    wanted = pages.select(F.col("host").alias("id"), F.col("host").alias("dir"), F.when(F.length("host") % 2 == 0, "e?/[1-5]*").otherwise("**").alias("pattern")).distinct()
    return globs.fileset(pages.select("path", F.lit("blob").alias("kind")), wanted)


def file_functions(spark, sf_dir):
    """What a file beside each page reads of the pages: by name, from the root, from a sibling, outside, and nothing."""
    pages = _pages(spark, sf_dir)
    name = F.substring_index("path", "/", -1)
    value = F.element_at(F.array(name, F.concat(F.lit("//"), "path"), F.concat(F.lit("../en/"), name), F.lit("../../../x"), F.lit("missing")), (F.col("page_id") % 5 + 1).cast("int"))
    wanted = pages.select(F.col("page_id").alias("id"), F.concat(parent(F.col("path")), F.lit("/build.cfg")).alias("file"), value.alias("value"))
    odd = F.when(F.length("path") % 7 == 0, F.unhex(F.lit("ff"))).otherwise(F.unhex(F.lit("")))
    found = globs.files_read(wanted, pages.select("path", F.concat(odd, F.encode("html", "UTF-8")).alias("bytes")))
    return found.select("id", "path", "exists", F.md5("text").alias("text_md5"), F.md5("base64").alias("base64_md5"), "problem")


def _quoted(x):
    return F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('""')), F.lit('"'))


def csv_documents(spark, sf_dir):
    """Documents written as records, with quotes, commas and line breaks in fields, and read again: value by place and name."""
    d = read(spark, sf_dir, "documents").select("doc_id", F.coalesce("lang", F.lit("")).alias("lang"), F.replace(F.coalesce("text", F.lit("")), F.lit("e"), F.lit('"')).alias("t"))
    first = F.concat_ws(",", F.col("doc_id").cast("string"), _quoted(F.col("lang")), _quoted(F.col("t")))
    last = F.concat_ws(",", F.lit('""'), F.length("t").cast("string"), _quoted(F.concat(F.lit("\n,"), F.reverse(F.col("lang")))))
    text = F.concat(F.lit('doc_id,"la,ng","te""xt"\n'), first, F.lit("\r\n\n"), last)
    rows = d.select("doc_id", F.posexplode(records.csvdecode(text)).alias("place", "row"))
    return rows.select("doc_id", "place", F.explode("row").alias("name", "value")).select("doc_id", "place", "name", F.length("value").alias("n"), F.md5("value").alias("value"))


def csv_problems(spark, sf_dir):
    """Why records made of documents can't be read, and how many there are of those that can."""
    d = read(spark, sf_dir, "documents").select("doc_id", F.regexp_replace(F.coalesce("text", F.lit("")), '["\n,]', " ").alias("t"))
    body = F.element_at(F.array(F.concat(F.lit("a,b\n"), "t", F.lit(",1\n2,")), F.concat(F.lit("a,b\n1,2\n"), "t", F.lit("x")), F.concat(F.lit('a\n"'), "t"), F.concat(F.lit("a\nx"), "t", F.lit('"\n')), F.concat(F.lit("a,b,a\n1,2,"), "t"), F.repeat(F.lit("\n"), F.length("t"))), (F.col("doc_id") % 6 + 1).cast("int"))
    x = d.select("doc_id", records.parsed(body).alias("x"))
    return x.select("doc_id", F.col("x.problem").alias("problem"), F.when(F.col("x.problem").isNull(), F.size("x.rows")).alias("n"))


def address_functions(spark, sf_dir):
    """Addresses, masks and parts of ranges made of customers' keys, and ids of their names."""
    k = F.col("c_custkey")
    c = read(spark, sf_dir, "customer").select(k.cast("bigint").alias("c_custkey"), "c_name")
    part = lambda x: x.cast("bigint").cast("string")
    four = F.concat(F.concat_ws(".", F.lit("10"), part(k % 256), part(F.floor(k / 256) % 256), part(k * 7 % 256)), F.lit("/"), part(k % 20 + 8))
    six = F.concat(F.concat_ws(":", F.lit("2001:DB8"), F.hex(k % 65536), F.lit(""), F.hex(k * 31 % 65536), F.lit("0"), F.hex(k % 3)), F.lit("/"), part(k % 57 + 40))
    return c.select(
        "c_custkey", addresses.cidrhost(four, k % 32).alias("host"), addresses.cidrhost(four, -1 - k % 32).alias("from_end"), addresses.cidrnetmask(four).alias("mask"),
        addresses.cidrsubnet(four, 3, k % 8).alias("part"), F.array_join(addresses.cidrsubnets(four, 2, 3, 1), " ").alias("parts"), addresses.cidrhost(six, k).alias("host6"),
        addresses.uuidv5("url", F.col("c_name")).alias("name_id"),
    )


def dependency_values(spark, sf_dir):
    """Nested values made for each part, told apart and joined to targets, parts and the files and trees that declare them."""
    p = read(spark, sf_dir, "part")
    k, folder = F.col("p_partkey"), F.lower(F.replace("p_type", F.lit(" "), F.lit("/")))
    t = p.select(k.alias("k"), F.concat(F.lit("part:"), k).alias("id"), folder.alias("path"), F.concat(folder, F.lit("/build.cfg")).alias("file"), F.concat(F.lit("k"), k % 3).alias("kind"), F.concat(F.lit("n"), k % 50).alias("name"))
    k = F.col("k")
    text = lambda *c: F.concat(F.lit('"'), *c, F.lit('"'))
    other = F.concat(F.lit("economy/"), F.regexp_replace("path", "^[^/]*/", ""), F.lit("/build.cfg#"))
    odd = F.element_at(F.array(F.lit("null"), F.lit("7"), F.lit('{"a": "b"}'), F.lit("[[], []]"), F.lit('"nope/x"')), (k % 5 + 1).cast("int"))
    body = F.concat(
        F.lit("["), text(F.lit("target-name:"), "kind", F.lit("."), "name"), F.lit(", ["), text(F.lit("target-ref://"), other, "kind", F.lit("."), "name"), F.lit(', [["."], "build.cfg"]], '),
        text(F.lit("id:part:"), (k * 3).cast("string")), F.lit(', "..", '), odd, F.lit("]"),
    )
    values = t.select("id", "file", F.parse_json(F.when(k % 4 == 0, text(F.lit("//"), "path")).otherwise(body)).alias("value"))
    objects = git.with_trees(t.select(F.col("file").alias("path"), F.lit("blob").alias("kind"), F.lit("1" * 40).alias("oid"), F.lit("stored").alias("source")).distinct())
    found = dependencies.dependencies(values, t.select("id", "file", "kind", "name"), t.select("id", F.lit("part").alias("kind")), objects)
    return found.withColumn("place", F.array_join("place", "."))


def target_values(spark, sf_dir):
    """How files of parts refer to targets: of their own and other directories, of the root, outside, and undeclared ones."""
    k, folder = F.col("p_partkey"), F.lower(F.replace("p_type", F.lit(" "), F.lit("/")))
    p = read(spark, sf_dir, "part").select(k.alias("id"), folder.alias("dir"), F.concat(folder, F.lit("/build.cfg")).alias("file"), F.concat(F.lit("k"), k % 3).alias("kind"), F.concat(F.lit("n"), k % 50).alias("name"))
    k, up = F.col("id"), F.concat(F.regexp_replace("dir", "[^/]+", ".."), F.lit("/."))
    path = F.element_at(F.array(F.lit(""), F.concat(F.lit("//"), "dir"), F.concat(F.lit("../"), F.substring_index("dir", "/", -1)), F.lit("/x"), up, F.concat(up, F.lit("/.."))), (k % 6 + 1).cast("int"))
    name = F.when(k % 7 == 0, "1.2").when(k % 7 == 1, F.concat("kind", F.lit(".nope"))).otherwise(F.concat("kind", F.lit("."), "name"))
    return dependencies.target_values(p.select("id", "file", path.alias("path"), name.alias("name")), p, "build.cfg", "root.cfg")


QUERIES = (glob_table, glob_fileset, file_functions, csv_documents, csv_problems, address_functions, dependency_values, target_values)

_PLACES = f"""{_URLS}, own AS (SELECT p AS path, min(page_id) AS page_id, arg_min(coalesce(html, ''), page_id) AS html FROM full_ JOIN pages USING (page_id) GROUP BY p),
place AS (SELECT *, string_split(path, '/')[1] AS host, string_split(path, '/')[-1] AS name, regexp_extract(path, '/([^/]*)/', 1) AS folder FROM own)"""


def _shown(n: str) -> str:
    return f"(({n}) // 16777216) || '.' || (({n}) // 65536 % 256) || '.' || (({n}) // 256 % 256) || '.' || (({n}) % 256)"


_SHORT = " ".join(
    f"WHEN position('{':0' * n}:' IN s) > 0 THEN substr(s, 2, greatest(position('{':0' * n}:' IN s) - 2, 0)) || '::' || rtrim(substr(s, position('{':0' * n}:' IN s) + {2 * n + 1}), ':')" for n in range(8, 1, -1)
)
ORACLES = {
    "glob_table": f"""WITH {_PLACES}, g AS (
        SELECT host || '/**' AS pattern, replace(host, '.', '[.]') || '(/.*)?' AS r FROM place UNION SELECT '**/' || name, '([^/]+/)*' || name FROM place
        UNION SELECT '*.' || z || '/e?/*[1-5]', '[^/]*[.]' || z || '/e[^/]/[^/]*[1-5]' FROM (SELECT string_split(host, '.')[-1] AS z FROM place)
        UNION SELECT '{{m,www}}.*/' || folder || '/[!1-4]*', '(m|www)[.][^/]*/' || folder || '/[^1-4/][^/]*' FROM place UNION SELECT '**/' || folder || '/*', '([^/]+/)*' || folder || '/[^/]*' FROM place)
        SELECT path, pattern FROM own JOIN g ON regexp_full_match(path, r)""",
    "glob_fileset": f"""WITH {_PLACES}, t AS (SELECT host AS id, substr(path, length(host) + 2) AS name FROM place)
        SELECT id, name FROM t WHERE name <> '' AND (length(id) % 2 = 1 OR regexp_full_match(name, 'e[^/]/[1-5][^/]*'))""",
    "file_functions": f"""WITH {_PLACES}, asked AS (SELECT page_id AS id, CASE page_id % 5 WHEN 2 THEN host || '/en/' || name WHEN 3 THEN NULL WHEN 4 THEN regexp_replace(path, '/[^/]*$', '/missing') ELSE path END AS path FROM place),
        held AS (SELECT path, length(path) % 7 = 0 AS odd, html FROM own)
        SELECT id, path, held.path IS NOT NULL AS exists, CASE WHEN NOT odd THEN md5(html) END AS text_md5,
        CASE WHEN held.path IS NOT NULL THEN md5(CASE WHEN odd THEN base64(unhex('FF') || encode(html)) ELSE base64(encode(html)) END) END AS base64_md5,
        CASE WHEN path IS NULL THEN 'not a path' WHEN held.path IS NULL THEN 'not found' WHEN odd THEN 'not UTF-8' END AS problem FROM asked LEFT JOIN held USING (path)""",
    "csv_documents": """WITH d AS (SELECT doc_id, coalesce(lang, '') AS lang, replace(coalesce(text, ''), 'e', '"') AS t FROM documents),
        f AS (SELECT doc_id, 0 AS place, 'doc_id' AS name, CAST(doc_id AS VARCHAR) AS v FROM d UNION ALL SELECT doc_id, 0, 'la,ng', lang FROM d UNION ALL SELECT doc_id, 0, 'te"xt', replace(t, chr(13) || chr(10), chr(10)) FROM d
            UNION ALL SELECT doc_id, 1, 'doc_id', '' FROM d UNION ALL SELECT doc_id, 1, 'la,ng', CAST(length(t) AS VARCHAR) FROM d UNION ALL SELECT doc_id, 1, 'te"xt', chr(10) || ',' || reverse(lang) FROM d)
        SELECT doc_id, place, name, length(v) AS n, md5(v) AS value FROM f""",
    "csv_problems": """SELECT doc_id, CASE doc_id % 6 WHEN 1 THEN 'wrong number of fields' WHEN 2 THEN 'bad quotes' WHEN 3 THEN 'bad quotes' WHEN 4 THEN 'repeated column name' WHEN 5 THEN 'missing header' END AS problem,
        CASE WHEN doc_id % 6 = 0 THEN 2 END AS n FROM documents""",
    "address_functions": f"""WITH c AS (SELECT CAST(c_custkey AS BIGINT) AS k, c_name FROM customer),
        n AS (SELECT *, 24 - k % 20 AS bits, CAST(2 ** (24 - k % 20) AS BIGINT) AS size, 167772160 + (k % 256) * 65536 + (k // 256 % 256) * 256 + k * 7 % 256 AS a FROM c),
        m AS (SELECT *, a - a % size AS base, list_transform(range(8), lambda i: [8193, 3512, k % 65536, 0, 0, k * 31 % 65536, 0, k % 3][i + 1]) AS g, k % 57 + 40 AS l FROM n),
        h AS (SELECT *, list_transform(range(6), lambda i: g[i + 1] - g[i + 1] % CAST(2 ** (16 - least(greatest(l - 16 * i, 0), 16)) AS BIGINT)) || [k // 65536, k % 65536] AS w, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(c_name)) AS u FROM m),
        o AS (SELECT *, ':' || array_to_string(list_transform(w, lambda x: lower(to_hex(x))), ':') || ':' AS s FROM h)
        SELECT k AS c_custkey, {_shown("base + k % 32")} AS host, {_shown("base + size - 1 - k % 32")} AS from_end, {_shown("4294967296 - size")} AS mask,
        {_shown("base + size // 8 * (k % 8)")} || '/' || (35 - bits) AS part,
        {_shown("base")} || '/' || (34 - bits) || ' ' || {_shown("base + size // 4")} || '/' || (35 - bits) || ' ' || {_shown("base + size // 2")} || '/' || (33 - bits) AS parts,
        CASE {_SHORT} ELSE trim(s, ':') END AS host6,
        u[1:8] || '-' || u[9:12] || '-5' || u[14:16] || '-' || translate(u[17:17], '0123456789abcdef', '89ab89ab89ab89ab') || u[18:20] || '-' || u[21:32] AS name_id FROM o""",
    "target_values": """WITH p AS (SELECT p_partkey AS id, lower(replace(p_type, ' ', '/')) || '/build.cfg' AS file, 'k' || (p_partkey % 3) AS kind, 'n' || (p_partkey % 50) AS name, p_partkey % 6 AS a, p_partkey % 7 AS b FROM part),
        q AS (SELECT *, CASE WHEN a IN (3, 5) THEN 'not a path' WHEN b = 0 THEN 'not a kind and a name' WHEN a = 4 OR b = 1 THEN 'not declared' END AS problem FROM p)
        SELECT id, CASE WHEN problem IS NULL THEN 'target-ref:' || file || '#' || kind || '.' || name END AS value, problem FROM q""",
    "dependency_values": """WITH t AS (SELECT p_partkey AS k, 'part:' || p_partkey AS id, lower(replace(p_type, ' ', '/')) AS path, 'k' || (p_partkey % 3) AS kind, 'n' || (p_partkey % 50) AS name FROM part),
        u AS (SELECT path, kind, name, min(id) AS dst, count(*) AS n FROM t GROUP BY ALL),
        asked AS (SELECT id, '0' AS place, path, kind, name FROM t WHERE k % 4 <> 0 UNION ALL SELECT id, '1.0', 'economy/' || regexp_replace(path, '^[^/]*/', ''), kind, name FROM t WHERE k % 4 <> 0)
        SELECT id, place, CASE WHEN n = 1 THEN dst END AS dst, CASE WHEN n = 1 THEN 'target:' || kind END AS kind, CASE WHEN n IS NULL THEN 'not declared' WHEN n > 1 THEN 'declared twice' END AS problem
            FROM asked LEFT JOIN u USING (path, kind, name)
        UNION ALL SELECT a.id, '2', b.id, CASE WHEN b.id IS NOT NULL THEN 'part' END, CASE WHEN b.id IS NULL THEN 'no such entity' END FROM t a LEFT JOIN t b ON b.k = a.k * 3 WHERE a.k % 4 <> 0
        UNION ALL SELECT id, '1.1.0.0', 'git:' || path, 'git:tree', NULL FROM t WHERE k % 4 <> 0 UNION ALL SELECT id, '1.1.1', 'git:' || path || '/build.cfg', 'git:blob', NULL FROM t WHERE k % 4 <> 0
        UNION ALL SELECT id, '3', 'git:' || regexp_replace(path, '/?[^/]*$', ''), 'git:tree', NULL FROM t WHERE k % 4 <> 0 UNION ALL SELECT id, '', 'git:' || path, 'git:tree', NULL FROM t WHERE k % 4 = 0
        UNION ALL SELECT id, '4', NULL, NULL, CASE k % 5 WHEN 0 THEN 'null' WHEN 4 THEN 'not found' ELSE 'neither a text nor a list' END FROM t WHERE k % 4 <> 0 AND k % 5 <> 3""",
}
