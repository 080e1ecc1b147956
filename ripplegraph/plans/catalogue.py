"""The graph engine's registered queries over the given tables, and their SQL oracles."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplegraph.functions import config, paths, selectors
from ripplegraph.model import FOLLOWED, Graph, Snapshot, checkpointed
from ripplegraph.operators import closure as reach
from ripplegraph.operators import delta, graph, hashing, targets
from ripplegraph.plans import config_queries, registry, render, tree
from ripplegraph.plans.catalogue_sql import ORACLES
from ripplegraph.sources import git, modules, universe
from ripplegraph.sources.universe import read


def _base(spark: SparkSession, sf_dir: str) -> Snapshot:
    return universe.snapshot(spark, sf_dir)


def _both(spark: SparkSession, sf_dir: str) -> tuple[Snapshot, Snapshot]:
    base = universe.snapshot(spark, sf_dir, captured=True)
    return base, universe.edited(base)


def _deps(s: Snapshot) -> DataFrame:
    return graph.dependencies(s.graph.edges, s.followed)


def flagship(spark, sf_dir):
    """Which entities change when some orders and parts are edited."""
    return diff_status(spark, sf_dir)


def universe_entities(spark, sf_dir):
    return _base(spark, sf_dir).graph.entities


def universe_edges(spark, sf_dir):
    return _base(spark, sf_dir).graph.edges


def token_collect(spark, sf_dir):
    """The tokens of two sensors, one of tables and one of documents, by the scanner."""
    tables = registry.Sensor("universe", graph=lambda _: None, tokens=lambda d: _base(spark, d).tokens.select(F.concat(F.lit("universe:"), "id").alias("id"), "token"), followed=FOLLOWED)
    blob = lambda d: read(spark, d, "documents").groupBy("doc_id").agg(F.min(git.blob_id(F.coalesce("text", F.lit("")).cast("binary"))).alias("oid"))
    texts = registry.Sensor("doc", graph=lambda _: None, tokens=lambda d: blob(d).select(F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("id"), F.col("oid").alias("token")), followed=("contains",))
    return registry.Builder().attach(tables).attach(texts).compile().tokens(sf_dir)


def graph_validate_violations(spark, sf_dir):
    """A graph with faults: line items by order and number alone, and events of unknown users."""
    line, events, customer = (read(spark, sf_dir, n) for n in ("lineitem", "events", "customer"))
    ids = line.select(F.concat_ws(":", F.lit("line"), "l_orderkey", "l_linenumber").alias("id")).union(customer.select(F.concat(F.lit("customer:"), F.col("c_custkey")).alias("id")))
    edges = events.select(F.concat(F.lit("customer:"), F.col("user_id")).alias("src"), F.concat(F.lit("customer:"), (F.col("user_id") * 7).cast("string")).alias("dst"), F.trim(F.regexp_replace("event_type", "error", " ")).alias("kind"))
    return graph.violations(Graph(ids.withColumn("kind", graph.namespace(F.col("id"))), edges.distinct())).distinct()


def graph_absorb(spark, sf_dir):
    """Entities and edges of two overlapping parts of the universe, merged: rows by kind."""
    g = _base(spark, sf_dir).graph
    half = lambda kinds: Graph(g.entities.where(F.col("kind").isin(*kinds)), g.edges.where(graph.namespace(F.col("dst")).isin(*kinds)))
    one = graph.absorbed(half(["region", "nation", "customer"]), half(["nation", "customer", "order"]))
    return one.entities.groupBy("kind").agg(F.count("*").alias("n")).union(one.edges.groupBy("kind").agg(F.count("*").alias("n")))


def absorb_conflicts(spark, sf_dir):
    g = _base(spark, sf_dir).graph
    other = Graph(g.entities.where("kind in ('part', 'region')").select("id", F.when(F.col("kind") == "part", "item").otherwise(F.col("kind")).alias("kind")), g.edges.limit(0))
    return graph.conflicts(g, other).select("id", F.array_join("kinds", ",").alias("kinds"))


def namespace_counts(spark, sf_dir):
    e = _base(spark, sf_dir).graph.entities
    return e.groupBy(graph.namespace(F.col("id")).alias("namespace")).agg(F.count("*").alias("n"))


def out_edges(spark, sf_dir):
    g = _base(spark, sf_dir).graph
    return graph.out_edges(g, g.entities.where("kind in ('nation', 'order')"))


def direct_dependencies(spark, sf_dir):
    return _deps(_base(spark, sf_dir))


def closure_pairs(spark, sf_dir):
    """All that each entity reaches."""
    return reach.closure(_deps(_base(spark, sf_dir)))


def closure_sizes(spark, sf_dir):
    return reach.sizes(_deps(_base(spark, sf_dir)))


def reverse_reachability(spark, sf_dir):
    base = _base(spark, sf_dir)
    return reach.dependents(_deps(base), base.graph.entities.where("kind = 'supplier'"))


def _ring(spark, sf_dir):
    """Nations in a ring within each region, and customers that import their nation."""
    nation, customer = read(spark, sf_dir, "nation"), read(spark, sf_dir, "customer")
    at = lambda k: F.concat(F.lit("nation:"), k.cast("string"))
    a, b = nation.select("n_regionkey", F.col("n_nationkey").alias("a")), nation.select("n_regionkey", F.col("n_nationkey").alias("b"))
    later = a.join(b, "n_regionkey").groupBy("a").agg(F.coalesce(F.min(F.when(F.col("b") > F.col("a"), F.col("b"))), F.min("b")).alias("b"))
    deps = later.select(at(F.col("a")).alias("src"), at(F.col("b")).alias("dst")).union(customer.select(F.concat(F.lit("customer:"), F.col("c_custkey")), at(F.col("c_nationkey"))))
    deps = deps.where("src <> dst")
    return deps.select(F.col("src").alias("id")).union(deps.select("dst")).distinct(), deps


def scc_cycle(spark, sf_dir):
    return reach.components(*_ring(spark, sf_dir))


def content_hash(spark, sf_dir):
    return delta.sums_of(universe.snapshot(spark, sf_dir, captured=True))


def uvarint_table(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    return o.select("o_orderkey", F.lower(F.hex(hashing.uvarint(F.col("o_orderkey") * F.col("o_orderkey")))).alias("bytes"))


def diff_status(spark, sf_dir):
    return delta.diff(*_both(spark, sf_dir))


def induced_edges(spark, sf_dir):
    base, head = _both(spark, sf_dir)
    changed = checkpointed(delta.diff(base, head).where("status <> 'removed'"))
    return graph.induced(head.graph, changed).edges


def frontier_layers(spark, sf_dir):
    base, head = _both(spark, sf_dir)
    found = checkpointed(delta.diff(base, head))
    return delta.frontiers(found.where("status <> 'removed'"), found.where("status = 'added'"), _deps(head))


def range_hash_label(spark, sf_dir):
    """old..new digits, or new: for every entity of the later snapshot."""
    base, head = _both(spark, sf_dir)
    return render.range_labels(delta.sums_of(base), delta.sums_of(head))


def containment_walk(spark, sf_dir):
    g = _base(spark, sf_dir).graph
    return graph.contained(g, universe.ROOT).select("id", "depth", F.array_join("path", ">").alias("path"))


def _url_paths(spark, sf_dir):
    """page_id, host and the path of each page, without query and slash at the end."""
    p = read(spark, sf_dir, "pages")
    rest = F.regexp_extract("url", "://([^?#]*)", 1)
    return p.select("page_id", F.regexp_extract(rest, "^[^/]*", 0).alias("host"), F.regexp_replace(F.regexp_replace(rest, "^[^/]*/?", ""), "/$", "").alias("path"))


def longest_prefix_owner(spark, sf_dir):
    """The module that owns each page: the deepest of the listed trees above it."""
    pages = _url_paths(spark, sf_dir).withColumn("dir", paths.parent(F.concat_ws("/", "host", "path")))
    listed = pages.groupBy(F.concat_ws("/", "host", paths.parent(F.col("path"))).alias("dir")).agg(F.count("*").alias("n")).where("n >= 3")
    owned = modules.owners(pages, listed.select("dir", F.col("dir").alias("module"), F.concat("dir", F.lit("/go.mod")).alias("path")))
    return pages.select("page_id", "dir").join(owned, "dir", "left").select("page_id", "module")


def _sources(spark, sf_dir):
    """Go files made of the pages: a module for each host, some with another of the same name inside.

    Comments, strings and semicolons stand where a reader of lines would go wrong.
    """
    pages = _url_paths(spark, sf_dir).select("page_id", "host", F.substring_index("path", "/", 1).alias("lang"))
    least = F.broadcast(pages.agg(F.min("host").alias("least")))  # one row
    hosts = pages.select("host").distinct().join(least)
    size = F.length("host")
    outer = F.concat(
        F.lit('// module not.this\nmodule "mod.example/'), "host", F.lit('" // of a host\n\ngo 1.'), (size % 4 + 18).cast("string"), F.when(size % 2 == 0, "\ntoolchain go1.22.1").otherwise("\ntoolchain local"),
        F.lit("\n\nrequire (\n\tlib.example/a v1.2."), (size % 3).cast("string"), F.lit("\n\tlib.example/a/deep v0.1.0 // indirect\n)\n\nreplace old.example/x => ../"), "least",
        F.lit("\nreplace lib.example/a v1.2.0 => fork.example/a v1.3.0\n"),
    )
    inner = hosts.where(size % 3 == 0).select(F.concat("host", F.lit("/en/go.mod")).alias("path"), F.concat(F.lit("module mod.example/"), "host", F.lit("\n")).alias("text"))
    other = F.element_at(F.array(*map(F.lit, ("en", "fr", "de", "zz"))), (F.col("page_id") % 4 + 1).cast("int"))
    text = F.concat(
        F.lit('package p // as in a/* and b\n\n// import "not/this"\nimport (\n\t"fmt"; m "mod.example/'), "host", F.lit("/"), other, F.lit('"\n\t_ `old.example/x/'), other,
        F.lit('` /* import "nor/this" */\n)\n\nimport "mod.example/'), "least", F.lit('/fr"; import "lib.example/a/'), F.when(F.col("page_id") % 2 == 0, "deep").otherwise("sub"), F.lit('/z"\n\nfunc f() { g("import") } /* tail */\nimport "too/late"\n'),
    )
    name = F.concat_ws("/", "host", "lang", F.concat(F.lit("p"), "page_id", F.when(F.col("page_id") % 5 == 0, "_test.go").otherwise(".go")))
    sources = pages.join(least).select(name.alias("path"), text.alias("text"))
    return sources.union(hosts.select(F.concat("host", F.lit("/go.mod")).alias("path"), outer.alias("text"))).union(inner)


def _repository(spark, sf_dir, edit=False):
    """A snapshot of the sources and of targets in each host's build.cfg; a later one has edited and new files.

    Targets depend on packages, files, another target, and the tree that they lie in, which is a cycle.
    """
    files = _sources(spark, sf_dir)
    hosts = _url_paths(spark, sf_dir).select("host").distinct()
    named = lambda name, where="true": hosts.where(where).select(F.concat("host", F.lit(f"/{name}")).alias("path"), F.lit("").alias("text"))
    files = files.union(named("build.cfg"))
    if edit:
        number = F.regexp_extract("path", r"/p(\d+)(_test)?\.go$", 1).try_cast("bigint")
        files = files.withColumn("text", F.concat("text", F.when(F.coalesce(number % 7 == 0, F.lit(False)), "\n// v2\n").otherwise(""))).union(named("NEW.md", "length(host) % 2 = 0"))
    files = checkpointed(files)
    objects = files.select("path", F.lit("blob").alias("kind"), git.blob_id(F.col("text").cast("binary")).alias("oid"), F.lit("stored").alias("source"))
    packages = modules.package_graph(files, attached=True)
    packages = Graph(checkpointed(packages.entities), checkpointed(packages.edges))
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(n).alias("name")) for k, n in (("codegen", "go"), ("test", "default"), ("lint", ""))])).alias("t")
    declared = hosts.select("host", kinds).select(F.concat("host", F.lit("/build.cfg")).alias("file"), F.col("host").alias("path"), "t.kind", "t.name", F.lit(0).alias("index"))
    declared = declared.withColumn("id", targets.target_id(*(F.col(c) for c in ("kind", "file", "name", "index"))))
    held = packages.edges.where("kind = 'contains'").join(packages.entities.where("kind = 'go:package'").select(F.col("id").alias("dst")), "dst", "left_semi")
    uses = held.select(F.split(F.substring_index("src", ":", -1), "/")[0].alias("path"), "dst").distinct()
    codegen = declared.where("kind = 'codegen'").join(uses, "path").select(F.col("id").alias("src"), "dst")
    others = declared.where("kind <> 'lint'").select(F.col("id").alias("src"), F.concat(F.lit("git:"), "path", F.lit("/go.mod")).alias("dst"))
    tests = declared.where("kind = 'test'").select(F.col("id").alias("src"), F.explode(F.array(F.concat(F.lit("git:"), "path"), F.concat(F.lit("target:codegen:"), "file", F.lit(":go")))).alias("dst"))
    needs = codegen.union(others).union(tests).withColumn("kind", F.lit("depends-on"))
    g = graph.absorbed(git.object_graph(git.with_trees(objects)), packages, targets.projected(declared), Graph(packages.entities.limit(0), needs))
    tokens = git.object_tokens(objects).union(modules.package_tokens(files, packages, strict=False))
    return delta.materialised(Snapshot(g, tokens, FOLLOWED))


def graph_tree(spark, sf_dir):
    """The printed tree of the sources, with files, imports and language versions of packages."""
    s = _repository(spark, sf_dir)
    return tree.tree_lines(s.graph, "git:", tokens=s.tokens, files=True, external=True, versions=True).select(F.array_join("place", "|").alias("place"), "line")


def cone_tree(spark, sf_dir):
    """The printed tree of what edited and new files change."""
    rows = tree.cone_lines(_repository(spark, sf_dir), _repository(spark, sf_dir, edit=True), "git:", files=True, external=True, versions=True)
    return rows.select(F.array_join("place", "|").alias("place"), "line")


def package_graph_edges(spark, sf_dir):
    return modules.package_graph(_sources(spark, sf_dir)).edges


def package_values(spark, sf_dir):
    """The packages that texts in files beside the sources name: as trees, from there, by import path, wrongly and not at all."""
    files = checkpointed(_sources(spark, sf_dir))
    pages = _url_paths(spark, sf_dir).select("page_id", "host", F.substring_index("path", "/", 1).alias("lang"))
    name = lambda *c: F.concat(F.lit("mod.example/"), "host", F.lit("/"), *c)
    value = [F.concat_ws("/", "host", "lang"), F.col("lang"), name("lang"), F.lit("../x.go"), F.lit("nope"), name(F.lit("qq")), F.col("host"), F.concat(F.lit(".././"), "lang")]
    turn = (F.col("page_id") % len(value) + 1).cast("int")
    wanted = pages.select(
        F.col("page_id").alias("id"), F.concat("host", F.when(turn == 8, "/en/build.cfg").otherwise("/build.cfg")).alias("file"), F.element_at(F.array(*value), turn).alias("value"),
        F.when(F.col("page_id") % 3 == 0, "package-test").otherwise("package").alias("kind"),
    )
    objects = git.with_trees(files.select("path", F.lit("blob").alias("kind"), F.lit("1" * 40).alias("oid"), F.lit("stored").alias("source")))
    return modules.named_packages(wanted, objects, checkpointed(modules.modules(files)))


def package_versions(spark, sf_dir):
    """The version of every external import, by module, or why there is none."""
    files = _sources(spark, sf_dir)
    external = modules.package_graph(files).entities.where("kind = 'go:package-external'").select(modules.id_parts(F.col("id")).alias("p"))
    return modules.version_tokens(modules.modules(files), external.select("p.mod_path", F.col("p.name").alias("target")))


def language_versions(spark, sf_dir):
    return modules.go_version_tokens(modules.modules(_sources(spark, sf_dir)))


def package_tests(spark, sf_dir):
    return modules.package_test_directories(modules.package_graph(_sources(spark, sf_dir)))


def import_kinds(spark, sf_dir):
    """How many imports of each module are local, built in, or external."""
    g = modules.package_graph(_sources(spark, sf_dir))
    kinds = g.edges.where("kind = 'imports'").join(g.entities.select(F.col("id").alias("dst"), F.col("kind").alias("to_kind")), "dst")
    return kinds.groupBy(modules.id_parts(F.col("src"))["mod_path"].alias("mod_path"), F.substring_index("to_kind", ":", -1).alias("kind")).agg(F.count("*").alias("n"))


def _odd_paths(spark, sf_dir):
    """page_id, base, value: paths with dots and doubled slashes, made of the pages' urls."""
    p = _url_paths(spark, sf_dir)
    pick = F.col("page_id") % 6
    value = (
        F.when(pick == 0, F.concat(F.lit("./"), "path")).when(pick == 1, F.concat(F.lit("../"), "path")).when(pick == 2, F.concat("path", F.lit("/../../..")))
        .when(pick == 3, F.concat(F.lit("//"), "path", F.lit("/./x"))).when(pick == 4, F.concat("path", F.lit("//y/../z"))).otherwise(F.concat(F.lit("/"), "path"))
    )
    return p.select("page_id", F.col("host").alias("base"), value.alias("value"))


def path_clean(spark, sf_dir):
    return _odd_paths(spark, sf_dir).select("page_id", paths.cleaned(F.col("value")).alias("cleaned"), paths.tree(F.col("value")).alias("tree"))


def path_resolve(spark, sf_dir):
    return _odd_paths(spark, sf_dir).select("page_id", paths.resolved(F.col("base"), F.col("value")).alias("resolved"), paths.parent(F.concat_ws("/", "base", "value")).alias("parent"))


def path_within(spark, sf_dir):
    p = _url_paths(spark, sf_dir)
    d = F.when(F.col("page_id") % 3 == 0, "").when(F.col("page_id") % 3 == 1, F.substring_index("path", "/", 1)).otherwise(F.substring("path", 1, 1))
    return p.select("page_id", paths.within(F.col("path"), d).alias("is_within"), paths.relative(F.col("path"), d).alias("rest"))


def ancestor_trees(spark, sf_dir):
    """Every tree above a page, and how many pages lie below it."""
    p = _url_paths(spark, sf_dir).select(F.concat_ws("/", "host", "path").alias("p"))
    return p.select(F.explode(paths.ancestors(F.col("p"))).alias("tree")).groupBy("tree").agg(F.count("*").alias("n"))


def _page_objects(spark, sf_dir):
    """path, kind, oid, source: each page's path once, as a blob."""
    p = _url_paths(spark, sf_dir).select("page_id", F.concat_ws("/", "host", "path").alias("path"))
    return p.groupBy("path").agg(F.min("page_id").alias("page_id")).select("path", F.lit("blob").alias("kind"), F.sha1(F.col("page_id").cast("string")).alias("oid"), F.lit("stored").alias("source"), "page_id")


def prune_empty(spark, sf_dir):
    """Trees that still hold a page after pages with an even id are gone."""
    left = _page_objects(spark, sf_dir).where("page_id % 2 = 1").drop("page_id")
    return git.with_trees(left).where("kind = 'tree'").select(F.col("path").alias("tree"))


GLOBS = ("en/*", "**/*.html", "{fr,de}/**", "e?/[1-4]*", "*")


def glob_match(spark, sf_dir):
    p = _url_paths(spark, sf_dir)
    each = F.explode(F.array(*[F.struct(F.lit(g).alias("pattern"), paths.glob_matches(F.col("path"), g).alias("hit")) for g in GLOBS])).alias("x")
    return p.select("page_id", each).where("x.hit").select("page_id", "x.pattern")


def overlay_upsert(spark, sf_dir):
    """Objects of a snapshot with edits laid over: pages by path, some replaced and some deleted."""
    base = _page_objects(spark, sf_dir).drop("page_id")
    gone = F.length("path") % 9 == 0
    edits = base.where((F.length("path") % 4 == 0) & ~gone).select("path", F.concat(F.lit("edit of "), "path").cast("binary").alias("bytes"))
    return git.overlaid(git.with_trees(base), edits, base.where(gone).select("path"))


def git_blob_hash(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", git.blob_id(F.coalesce("text", F.lit("")).cast("binary")).alias("oid"))


def id_codec(spark, sf_dir):
    """Whole texts as a part of an entity id, and what decodes from it."""
    d = read(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("name"))
    ids = d.select("doc_id", "name", F.concat(F.lit("doc:package:mod/x:"), modules.coded(F.col("name"))).alias("id"))
    return ids.select("doc_id", "id", (modules.id_parts(F.col("id"))["name"] == F.col("name")).alias("round_trip"), graph.namespace(F.col("id")).alias("namespace"))


def _targets(spark, sf_dir):
    """Parts as targets: their type is the path, the brand the kind, and a name for some."""
    p = read(spark, sf_dir, "part")
    kind, path = F.lower(F.replace("p_brand", F.lit("#"), F.lit(""))), F.lower(F.replace("p_type", F.lit(" "), F.lit("/")))
    named = F.when(F.col("p_partkey") % 4 == 0, "").otherwise(F.concat(F.lit("n"), (F.col("p_partkey") % 50).cast("string")))
    return p.select(F.concat(F.lit("part:"), F.col("p_partkey")).alias("id"), path.alias("path"), kind.alias("kind"), named.alias("name"), (F.col("p_size") % 4).alias("index"), F.col("p_name").alias("label"), F.array(F.concat(F.lit("size"), F.col("p_size").cast("string"))).alias("more"))


def selector_parse(spark, sf_dir):
    t = _targets(spark, sf_dir)
    asked = F.when(F.length("label") % 2 == 0, selectors.canonical(F.col("path"), F.col("kind"), F.col("name"))).otherwise(F.concat("kind", F.lit("#"), "name", F.lit("#x")))
    return t.select("id", selectors.parsed(asked).alias("s")).select("id", "s.path", "s.identifier", "s.rooted")


def selector_aliases(spark, sf_dir):
    t = _targets(spark, sf_dir)
    return t.select("id", F.posexplode(selectors.aliases(F.col("kind"), F.col("name"), F.col("index"), F.col("more"))).alias("place", "alias"))


def selector_resolve(spark, sf_dir):
    """What inputs made of suppliers' and parts' names resolve to: candidates by the best rule."""
    t = _targets(spark, sf_dir)
    s = read(spark, sf_dir, "supplier").select((F.col("s_suppkey") % 50).alias("k"), (F.col("s_suppkey") % 5).alias("r")).distinct()
    inputs = s.select(F.when(F.col("r") == 0, F.concat(F.lit("#n"), F.col("k"))).when(F.col("r") == 1, F.concat(F.lit("brand11.n"), F.col("k"))).when(F.col("r") == 2, F.concat(F.lit("size"), F.col("k"))).otherwise(F.concat(F.lit("//economy#n"), F.col("k"))).alias("input"), F.lit("economy").alias("cwd")).distinct()
    found = selectors.resolved(t, inputs)
    return found.select("input", F.size("found").alias("n"), F.element_at("found", 1)["id"].alias("first"))


def completion_match(spark, sf_dir):
    t = _targets(spark, sf_dir)
    return selectors.completions(t, "brand1", "economy").union(selectors.completions(t, "//econ"))


def _declared(spark, sf_dir):
    """The parts' targets, in a file of their tree."""
    return _targets(spark, sf_dir).withColumn("file", F.concat("path", F.lit("/build.cfg")))


def target_references(spark, sf_dir):
    """Each part refers to a name of another kind in its file, which may be missing or there twice."""
    t = _declared(spark, sf_dir)
    wanted = t.select("id", "file", F.concat(F.lit("brand"), F.col("index") + 1, F.lit("1")).alias("kind"), F.when(F.col("name") == "", "n7").otherwise(F.col("name")).alias("name"))
    return targets.references(wanted, t)


def path_dependencies(spark, sf_dir):
    """Pages that depend on their own path, the tree above it, the root, or nothing that exists."""
    p = _url_paths(spark, sf_dir).select("page_id", F.concat_ws("/", "host", "path").alias("p"))
    pick = F.col("page_id") % 4
    path = F.when(pick == 0, F.col("p")).when(pick == 1, paths.parent(F.col("p"))).when(pick == 2, "").otherwise(F.concat("p", F.lit(".none")))
    return targets.path_dependencies(p.select(F.concat(F.lit("page:"), "page_id").alias("id"), path.alias("path")), git.with_trees(_page_objects(spark, sf_dir).drop("page_id")))


def nearest_settings(spark, sf_dir):
    """Commands of test packages: hosts and some of their directories set their own."""
    p = _url_paths(spark, sf_dir).select("page_id", "host", F.concat_ws("/", "host", F.substring_index("path", "/", 1)).alias("dir"))
    settings = p.where(F.length("host") % 2 == 0).select(F.col("host").alias("dir")).union(p.where(F.length("dir") % 5 == 0).select("dir")).distinct()
    wanted = p.select(F.concat(F.lit("page:"), "page_id").alias("id"), "dir", F.col("host").alias("module_dir"))
    return targets.nearest_settings(wanted, settings.select("dir", F.concat(F.lit("run "), "dir").alias("value")), "run")


def target_graph(spark, sf_dir):
    return targets.projected(_declared(spark, sf_dir)).edges


def config_rows(spark, sf_dir):
    """Every part's target, and a setting for some of the files."""
    t = _declared(spark, sf_dir)
    return targets.config_rows(t, t.where("name = 'n7'").select("file", F.lit("shell").alias("name")))


def targets_by_kind(spark, sf_dir):
    return targets.by_kind(_declared(spark, sf_dir))


def package_lines(spark, sf_dir):
    files = checkpointed(_sources(spark, sf_dir))
    g = modules.package_graph(files, attached=True)
    g = Graph(checkpointed(g.entities), checkpointed(g.edges))
    blobs = Graph(g.entities.union(files.select(F.concat(F.lit("git:"), "path"), F.lit("git:blob"))), g.edges)
    marks = g.entities.select("id", F.right("id", F.lit(3)).alias("label"))
    return tree.package_lines(blobs, modules.package_tokens(files, g, strict=False), marks)


def kind_local_index(spark, sf_dir):
    """Each part's place among the parts of its type and brand, and whether its name repeats there."""
    p = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_type").alias("file"), F.col("p_brand").alias("kind"), F.col("p_name").alias("name"), F.col("p_partkey").alias("line"))
    return targets.in_file(p).select(F.col("id").alias("p_partkey"), F.col("index").alias("place"), "repeats")


def duplicate_blobs(spark, sf_dir):
    """Groups of documents with the same contents, by blob id."""
    return git_blob_hash(spark, sf_dir).groupBy("oid").agg(F.count("*").alias("n"), F.min("doc_id").alias("first")).where("n > 1")


def text_functions(spark, sf_dir):
    p, name, kind = read(spark, sf_dir, "part"), F.col("p_name"), F.col("p_type")
    return p.select(
        "p_partkey", config.title(name).alias("title"), config.trimprefix(kind, "ECO").alias("trimprefix"), config.trimsuffix(name, "t").alias("trimsuffix"), config.trim(name, "ct").alias("trim"),
        config.substr(name, 2, 5).alias("substr"), config.substr(name, -3, -1).alias("tail"), config.indent(2, F.concat(name, F.lit("\nx"))).alias("indent"), F.reverse(name).alias("strrev"),
        config.chomp(F.concat(name, F.lit("\r\n\n"))).alias("chomp"), F.replace(name, F.lit(" "), F.lit("+")).alias("replaced"), config.base64encode(F.concat_ws(" ", *[name] * 9)).alias("base64encode"),
        config.basename(F.concat(kind, F.lit("/"), name)).alias("basename"), config.dirname(F.concat(kind, F.lit("/"), name)).alias("dirname"), config.trimspace(F.concat(F.lit(" \t"), name, F.lit("\n "))).alias("trimspace"),
    )


def collection_functions(spark, sf_dir):
    p = read(spark, sf_dir, "part").withColumn("a", F.split("p_name", "")).withColumn("a", F.filter("a", lambda x: x != ""))
    a, text = F.col("a"), lambda x: F.array_join(x, ",")
    m = F.map_from_arrays(F.array(F.lit("b"), F.lit("a")), F.array("p_brand", "p_type"))
    return p.select(
        "p_partkey", F.array_join(F.transform(config.chunklist(a, 4), lambda x: F.array_join(x, "")), "|").alias("chunks"), F.size(F.array_distinct(a)).alias("n_distinct"), text(config.compact(F.transform(a, lambda x: F.when(x == "e", "").otherwise(x)))).alias("compact"),
        config.element(a, F.col("p_partkey")).alias("element"), text(config.slice_(a, 1, 4)).alias("slice"), text(config.keys(m)).alias("keys"), text(config.values(m)).alias("values_"), config.lookup(m, F.lit("z"), F.lit("none")).alias("lookup"),
        text(config.range_(F.col("p_size") % 5)).alias("range"), text(F.array_sort(a)).alias("sorted"), F.size(config.setproduct(a, F.array(F.lit(1), F.lit(2)))).alias("n_product"), text(F.array_sort(F.array_intersect(a, F.array(F.lit("a"), F.lit("e"))))).alias("both"),
        config.lookup(config.merge(m, F.create_map(F.lit("a"), F.lit("later"))), F.lit("a"), F.lit("-")).alias("merged"),
    )


def number_functions(spark, sf_dir):
    p, cents = read(spark, sf_dir, "part"), F.round(F.col("p_retailprice") * 100).cast("bigint")
    return p.select(
        "p_partkey", F.abs(F.col("p_size") - 25).alias("abs"), F.signum(F.col("p_size") - 25).cast("int").alias("signum"), F.ceil(F.col("p_size") / 4).cast("bigint").alias("ceil"), F.floor(F.col("p_size") / 4).cast("bigint").alias("floor"),
        F.greatest("p_size", F.lit(30)).alias("max"), F.least("p_size", F.lit(30)).alias("min"), F.pow(F.col("p_size"), 2).cast("bigint").alias("pow"), config.parseint(F.hex(cents), 16).alias("parseint"), F.round(config.log(F.col("p_size") + 1, 2), 6).alias("log"),
    )


def hash_functions(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    return d.select("doc_id", F.md5("t").alias("md5"), F.sha1("t").alias("sha1"), F.sha2("t", 256).alias("sha256"))


def selector_trees(spark, sf_dir):
    """Parts' selectors by file or tree: the tree named, and whether an odd spelling of it matches."""
    t = _declared(spark, sf_dir)
    path = F.when(F.col("index") % 2 == 0, F.col("file")).otherwise(F.col("path"))
    asked = F.when(F.col("index") == 0, "").when(F.col("index") == 1, F.concat(F.lit("//"), "path", F.lit("/."))).when(F.col("index") == 2, F.concat(F.lit("../x/"), F.col("kind"))).otherwise(F.concat(F.lit("/"), "path"))
    made = selectors.declared(F.col("file"), F.col("kind"), F.col("name"), F.col("index"))
    return t.select("id", selectors.tree_of(path, ("build.cfg",)).alias("tree"), selectors.path_matches(asked, F.lit("x/y"), F.col("file"), F.col("path")).alias("matches"), made["dir"].alias("dir"), selectors.package_test(F.col("path"))["path"].alias("test_path"))


def compared_revisions(spark, sf_dir):
    """What is compared for requests made of orders: with and without a base, a head, and edits."""
    o, k = read(spark, sf_dir, "orders"), F.col("o_orderkey")
    base, head = F.when(k % 2 == 0, F.concat(F.lit("b"), (k % 7).cast("string"))).when(k % 3 == 0, ""), F.when(k % 5 < 2, F.when(k % 5 == 0, "HEAD").otherwise("main"))
    found = delta.compared(base, head, k % 11 < 3, k % 13 < 6)
    return o.select("o_orderkey", found["base"].alias("base"), found["head"].alias("head"), found["with_edits"].alias("with_edits"), found["label"].alias("label"), delta.needs_state(base, head, k % 11 < 3).alias("asks"))


def change_depth(spark, sf_dir):
    return delta.depth(frontier_layers(spark, sf_dir))


def dependency_lines(spark, sf_dir):
    """Labels of what targets depend on."""
    g = _repository(spark, sf_dir).graph
    ends = g.edges.where("kind = 'depends-on'").join(g.entities.select(F.col("id").alias("dst"), F.col("kind").alias("to_kind")), "dst")
    return ends.select(F.col("src").alias("id"), tree.dependency_label(F.col("dst"), F.col("to_kind")).alias("line"))


def import_labels(spark, sf_dir):
    return modules.package_graph(_sources(spark, sf_dir)).entities.select("id", tree.dependency_label(F.col("id"), F.col("kind")).alias("label"))


def more_functions(spark, sf_dir):
    """Functions over names, sizes and dates of parts and orders."""
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus", "o_orderpriority", F.to_timestamp(F.col("o_orderdate")).alias("t"))
    word, n = F.col("o_orderpriority"), F.col("o_orderkey")
    parts, numbers = config.split("-", word), F.array(n, n + 1, F.lit(None).cast("bigint"))
    nested = F.array(F.array(parts, F.array(word)), F.array(F.array(F.lit("z"))))
    pair = F.map_from_arrays(F.array(F.lit("k"), word), F.array(F.lit("1"), F.lit("2")))
    return o.select(
        "o_orderkey", config.FUNCTIONS["base64decode"](config.base64encode(word)).alias("base64decode"), F.coalesce(F.lit(None), word).alias("coalesced"),
        F.array_join(config.coalescelist(F.array().cast("array<string>"), parts), "+").alias("coalescelist"), F.array_join(F.concat(parts, F.array(F.lit("e"))), ",").alias("concat"),
        F.array_contains(parts, "HIGH").alias("contains"), config.FUNCTIONS["convert"](F.concat(n.cast("string"), F.when(n % 2 == 0, "x").otherwise("")), "bigint").alias("converted"),
        F.array_join(config.formatlist("<%s>", parts), "").alias("formatlist"), config.format_("%v/%q is %05d%% or %.2f, %x", word, F.col("o_orderstatus"), n, F.col("o_totalprice"), n).alias("format"),
        config.formatdate("EEE, D MMM YYYY hh:mm aa 'at' HH Z", F.col("t")).alias("formatdate"), config.timeadd(F.col("t"), "-1h30m0.5s").alias("timeadd"),
        config.parseint(F.concat(F.when(n % 2 == 0, "-").otherwise(""), F.lower(F.hex(n))), 16).alias("parseint"), config.index(numbers, (n % 2).cast("int")).alias("indexed"),
        F.array_join(config.flatten(nested, 2), ",").alias("flatten"), F.lower(word).alias("lower"), F.upper(F.lower(word)).alias("upper"), F.array_join(parts, "|").alias("joined"),
        F.to_json(F.struct(n.alias("a"), word.alias("b"))).alias("jsonencode"), F.try_variant_get(F.parse_json(F.to_json(F.struct(n.alias("a")))), "$.a", "bigint").alias("jsondecode"),
        F.regexp_replace(word, "[0-9]+-?", "").alias("regex_replace"), F.array_join(F.reverse(parts), ",").alias("reversed"), F.array_join(F.array_sort(F.array_union(parts, F.array(F.lit("HIGH"), F.lit("a")))), ",").alias("setunion"),
        F.char_length(word).alias("strlen"), config.urlencode(F.concat(word, F.lit(" &="))).alias("urlencode"), F.element_at(pair, word).alias("zipmap"),
    )


_QUERIES = (
    universe_entities, universe_edges, token_collect, graph_validate_violations, graph_absorb, absorb_conflicts, namespace_counts, out_edges, direct_dependencies, closure_pairs, closure_sizes,
    reverse_reachability, scc_cycle, content_hash, uvarint_table, diff_status, induced_edges, frontier_layers, range_hash_label, containment_walk, longest_prefix_owner,
    package_graph_edges, package_values, package_versions, language_versions, package_tests, import_kinds, path_clean, path_resolve, path_within, ancestor_trees, prune_empty, glob_match, overlay_upsert, git_blob_hash, duplicate_blobs, id_codec, selector_parse, selector_aliases,
    selector_resolve, completion_match, kind_local_index, text_functions, collection_functions, number_functions, hash_functions, more_functions, target_references, path_dependencies,
    nearest_settings, target_graph, config_rows, targets_by_kind, package_lines, selector_trees, compared_revisions, change_depth, dependency_lines, import_labels, graph_tree, cone_tree,
)


def queries():
    return {f.__name__: f for f in (*_QUERIES, *config_queries.QUERIES)}


def oracle_sql():
    return {k: v for k, v in (ORACLES | config_queries.ORACLES).items() if k in queries()}
