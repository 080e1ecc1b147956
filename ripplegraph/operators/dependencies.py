"""What targets depend on, from nested values: VARIANT columns unfolded level by level, then joins by kind."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ripplegraph.functions import paths
from ripplegraph.model import Graph, Scratch, summed
from ripplegraph.operators import targets as declared

#: How a text says what it is; others are paths.
TARGET, REFERENCE, ENTITY, OWN, PATH = "target-name:", "target-ref:", "id:", ("go:",), "path:"

_NAME = r"[\p{L}\p{Nl}_][\p{L}\p{Nl}\p{Mn}\p{Mc}\p{Nd}\p{Pc}-]*"


def unfolded(values: DataFrame) -> DataFrame:
    """id, place, text, problem: the texts inside each value (id, value VARIANT), lists in lists opened.

    ``place`` is where a text is, a number for each list around it; empty for a value that is no
    list. Empty lists hold nothing; nulls and whatever is neither a list nor a text have a problem.
    A round opens one level of all values, so that rounds are as many as the deepest value has.
    """
    kind = F.schema_of_variant("value")
    is_list = F.coalesce(kind.startswith("ARRAY"), F.lit(False))
    problem = F.when(F.col("value").isNull() | F.is_variant_null("value"), "null").when(kind != "STRING", "neither a text nor a list")
    level = values.select("id", F.array().cast("array<int>").alias("place"), "value")
    out = None
    with Scratch(values) as scratch:
        while True:
            level, (lists,) = summed(level.withColumn("_list", is_list), F.coalesce(F.sum(F.col("_list").cast("int")), F.lit(0)))
            text = F.when(problem.isNull(), F.try_variant_get("value", "$", "string"))
            leaves = level.where("not _list").select("id", "place", text.alias("text"), problem.alias("problem"))
            out = leaves if out is None else out.union(leaves)
            scratch.keep(level)
            if not lists:
                return out
            inside = level.where("_list").withColumnRenamed("value", "_value").lateralJoin(values.sparkSession.tvf.variant_explode(F.col("_value").outer()))
            level = inside.select("id", F.concat("place", F.array("pos")).alias("place"), "value")


def told_apart(text: Column) -> Column:
    """what, file, kind, name, value of a text: a target of the same file or of another, an entity, or a path.

    A text that begins like a target but doesn't name one is a path.
    """
    named = F.regexp_extract(text, rf"\A{TARGET}({_NAME})\.({_NAME})\z", 1), F.regexp_extract(text, rf"\A{TARGET}({_NAME})\.({_NAME})\z", 2)
    cross = [F.regexp_extract(text, rf"\A{REFERENCE}([^#]*)#({_NAME})\.({_NAME})\z", k) for k in (1, 2, 3)]
    file = paths.cleaned(F.when(cross[1] != "", F.when(cross[0].startswith("//"), F.substring(cross[0], 3, 1 << 30)).otherwise(cross[0])))
    own = F.lit(False)
    for prefix in OWN:
        own = own | text.startswith(prefix)
    none = F.lit(None).cast("string")
    row = lambda what, file=none, kind=none, name=none, value=none: F.struct(F.lit(what).alias("what"), file.alias("file"), kind.alias("kind"), name.alias("name"), value.alias("value"))
    rest = lambda prefix: F.substring(text, len(prefix) + 1, 1 << 30)
    return (
        F.when(text.isNull(), None).when(named[0] != "", row("target", kind=named[0], name=named[1])).when(file.isNotNull(), row("target", file, cross[1], cross[2]))
        .when(text.startswith(ENTITY), row("entity", value=rest(ENTITY))).when(own, row("entity", value=text))
        .otherwise(row("path", value=F.when(text.startswith(PATH), rest(PATH)).otherwise(text)))
    )


def dependencies(values: DataFrame, targets: DataFrame, entities: DataFrame, objects: DataFrame, space: str = "git") -> DataFrame:
    """id, place, dst, kind, problem: what each value (id, file, value VARIANT) of a declaring file depends on.

    Targets are those of ``targets`` (id, file, kind, name), entities those of ``entities`` (id,
    kind); paths are seen from the declaring file, as a blob of ``objects`` (path, kind) or else a
    tree. What can't be found, is declared twice or isn't a text has a problem and no dst.
    """
    files = values.select("id", F.col("file").alias("_file")).distinct()
    leaves = unfolded(values.select("id", "value")).join(files, "id").withColumn("_x", told_apart(F.col("text")))
    key = F.struct("id", "place")
    of = lambda what: leaves.where((F.col("_x.what") == what) & F.col("problem").isNull())
    wanted = of("target").select(key.alias("id"), F.coalesce("_x.file", "_file").alias("file"), F.col("_x.kind").alias("kind"), F.col("_x.name").alias("name"))
    kinds = targets.select(F.col("id").alias("dst"), F.concat(F.lit("target:"), "kind").alias("kind")).distinct()
    named = declared.references(wanted, targets).join(kinds, "dst", "left").select("id", "dst", "kind", "problem")
    known = entities.select(F.col("id").alias("dst"), "kind").distinct()
    asked = of("entity").select(key.alias("id"), F.col("_x.value").alias("dst")).join(known, "dst", "left")
    found = asked.select("id", F.when(F.col("kind").isNotNull(), F.col("dst")).alias("dst"), "kind", F.when(F.col("kind").isNull(), "no such entity").alias("problem"))
    base, value = paths.parent(F.col("_file")), F.col("_x.value")
    blobs = objects.where("kind = 'blob'").select(F.col("path").alias("_blob")).distinct()
    seen = of("path").select(key.alias("id"), paths.resolved(base, value).alias("_blob"), paths.resolved_tree(base, value).alias("_tree")).join(blobs.withColumn("_is", F.lit(True)), "_blob", "left")
    trees = objects.where("kind = 'tree'").select(F.col("path").alias("_tree"), F.lit(True).alias("_held")).distinct()
    seen = seen.join(trees, "_tree", "left").withColumn("_up", F.coalesce("_held", F.lit(False)) | F.coalesce(F.col("_tree") == "", F.lit(False)))
    kind = F.when(F.col("_is"), f"{space}:blob").when(F.col("_up"), f"{space}:tree")
    placed = seen.select("id", F.concat(F.lit(f"{space}:"), F.when(F.col("_is"), F.col("_blob")).when(F.col("_up"), F.col("_tree"))).alias("dst"), kind.alias("kind"), F.when(kind.isNull(), "not found").alias("problem"))
    bad = leaves.where("problem is not null").select(key.alias("id"), F.lit(None).cast("string").alias("dst"), F.lit(None).cast("string").alias("kind"), "problem")
    return named.unionByName(found).unionByName(placed).unionByName(bad).select("id.id", "id.place", "dst", "kind", "problem")


def target_values(wanted: DataFrame, targets: DataFrame, filename: str, root_filename: str) -> DataFrame:
    """id, value, problem: the text that refers to a target of another directory, as ``told_apart`` reads it.

    Each row (id, file, path, name) of a declaring file gives a directory, empty for its own, and
    ``kind.name``. A directory's targets are in its ``filename``, the root's in ``root_filename``.
    A path that leads out, a name of another form and an undeclared target have a problem and no
    value, as have nulls. A target that is declared twice is declared.
    """
    place = F.struct(*[F.regexp_extract("name", rf"\A({_NAME})\.({_NAME})\z", k).alias(part) for k, part in ((1, "kind"), (2, "name"))])
    asked = wanted.select("id", paths.resolved_tree(paths.parent(F.col("file")), F.col("path")).alias("_dir"), place.alias("_x")).select("id", "_dir", "_x.*")
    file = F.when(F.col("_dir") == "", F.lit(root_filename)).otherwise(F.concat("_dir", F.lit(f"/{filename}")))
    known = targets.select("file", "kind", "name").distinct().withColumn("_held", F.lit(True))
    rows = asked.withColumn("file", file).join(known, ["file", "kind", "name"], "left")
    problem = F.when(F.col("_dir").isNull(), "not a path").when(F.coalesce("kind", F.lit("")) == "", "not a kind and a name").when(F.col("_held").isNull(), "not declared")
    value = F.concat(F.lit(REFERENCE), "file", F.lit("#"), "kind", F.lit("."), "name")
    return rows.select("id", F.when(problem.isNull(), value).alias("value"), problem.alias("problem"))


def dependency_graph(found: DataFrame) -> Graph:
    """Entities and ``depends-on`` edges of ``dependencies``; any problem is an error."""
    checked = F.when(F.col("problem").isNull(), F.col("dst")).otherwise(F.raise_error(F.concat(F.col("id"), F.lit(" depends on something bad: "), "problem")))
    rows = found.select("id", checked.alias("dst"), "kind")
    return Graph(rows.select(F.col("dst").alias("id"), "kind").distinct(), rows.select(F.col("id").alias("src"), "dst", F.lit("depends-on").alias("kind")).distinct())
