"""JSON values checked against contracts, as joins between exploded values and tables of schema nodes.

A schema becomes two small tables: nodes (what a value must be) and edges (which
node rules a property, an item or a branch). A value and the node that it has to
meet are a claim. Claims are exploded level by level, each level a join of the one
before with the edges; then, from the deepest level up, a claim is bad if something
of its own is wrong, if a claim below it is bad, or if too few or too many of its
branches hold. A definition that refers to itself is an edge to an earlier node, so
values decide how deep the levels go, and the plan doesn't grow with the schema.

Defined results for odd input: a null or unreadable text has the one error that it
is no JSON; keys should be unique, rows of one key are judged as one; a schema node
that says nothing allows everything; an empty table gives an empty result.
"""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rayloom.session import written
from rayloom.sources import stores

#: How errors read.
WORDING = {
    "text": "not JSON", "constant": "expected %s, received %s", "enum": "expected one of %s, received %s", "type": "expected %s, received %s",
    "missing": "missing required property", "extra": "unexpected property", "below": "below %s", "above": "above %s",
    "none of one": "value does not match any oneOf branch", "many of one": "value matches multiple oneOf branches",
    "none of any": "value does not match any allowed shape", "none of types": "value does not match any allowed type",
}
_NODE = "node int, type string, allowed array<string>, wanted string, minimum double, maximum double, required array<string>, closed array<string>, choice string"
_EDGE = "parent int, role string, name string, branch int, node int"


def schema_tables(schema: Mapping) -> tuple[list[tuple], list[tuple], dict[str, int]]:
    """Rows of nodes and edges, and the node of each definition. References share the node that they name."""
    numbers: dict[str, int] = {}
    nodes, edges, waiting = [], [], []

    def number(pointer: str, own: Mapping) -> int:
        while "$ref" in own:
            pointer = own["$ref"]
            own = schema
            for step in pointer.removeprefix("#/").split("/"):
                own = own[step.replace("~1", "/").replace("~0", "~")]
        if pointer not in numbers:
            numbers[pointer] = len(numbers)
            waiting.append((pointer, own))
        return numbers[pointer]

    roots = {name: number(f"#/$defs/{name}", own) for name, own in schema.get("$defs", {}).items()}
    while waiting:
        pointer, own = waiting.pop()
        at, types = numbers[pointer], own.get("type")
        parts = [("property", name, None, f"properties/{name}", child) for name, child in own.get("properties", {}).items()]
        if own.get("items"):
            parts.append(("item", None, None, "items", own["items"]))
        choice = next((k for k in ("oneOf", "anyOf") if k in own), "types" if isinstance(types, list) else None)
        branches = [{"type": t} for t in types] if choice == "types" else own.get(choice, ())
        parts += [("branch", None, k, f"{choice}/{k}", child) for k, child in enumerate(branches)]
        edges += [(at, role, name, branch, number(f"{pointer}/{below}", child)) for role, name, branch, below, child in parts]
        allowed = [own["const"]] if "const" in own else own.get("enum")
        texts = None if allowed is None else [json.dumps(x) for x in allowed]
        wanted = None if allowed is None else WORDING["constant" if "const" in own else "enum"].split("%s")[0] + ", ".join(texts)
        kind = types if isinstance(types, str) else "object" if "properties" in own and not choice else None
        bounds = [None if (x := own.get(n)) is None else float(x) for n in ("minimum", "maximum")]
        closed = sorted(own.get("properties", {})) if own.get("additionalProperties") is False else None
        nodes.append((at, kind, texts, wanted, *bounds, list(own.get("required", [])), closed, choice))
    return nodes, edges, roots


def _kind(value: Column) -> Column:
    """The JSON type of a variant; whole numbers are integers."""
    own, number = F.schema_of_variant(value), F.try_variant_get(value, "$", "double")
    whole = F.when(number == F.floor(number), "integer").otherwise("number")
    return F.when(own == "STRING", "string").when(own == "BOOLEAN", "boolean").when(own == "VOID", "null").when(own.startswith("OBJECT"), "object").when(own.startswith("ARRAY"), "array").otherwise(whole)


def _misfit() -> Column:
    """Whether a claim's value is of another type than its node wants."""
    return F.col("type").isNotNull() & (F.col("type") != F.col("kind")) & ~((F.col("type") == "number") & (F.col("kind") == "integer"))


def _own_errors() -> Column:
    """(place below, text) of what is wrong with a claim itself; the type comes first and hides the rest."""
    shown, kind, number = F.to_json("value"), F.col("kind"), F.try_variant_get("value", "$", "double")
    error = lambda text, below="": F.struct(F.lit(below).alias("below"), (F.lit(text) if isinstance(text, str) else text).alias("text"))
    when = lambda wrong, found: F.when(wrong, F.array(found)).otherwise(F.array().cast("array<struct<below:string,text:string>>"))
    # numbers are the same if their values are, however they are written
    same = F.exists("allowed", lambda a: (a == shown) | F.coalesce((kind.isin("integer", "number")) & (a.try_cast("double") == number), F.lit(False)))
    keys = F.map_keys(F.try_variant_get("value", "$", "map<string,variant>"))
    lacking = F.transform(F.array_except("required", keys), lambda k: F.struct(F.concat(F.lit("."), k).alias("below"), F.lit(WORDING["missing"]).alias("text")))
    extra = F.transform(F.array_except(keys, "closed"), lambda k: F.struct(F.concat(F.lit("."), k).alias("below"), F.lit(WORDING["extra"]).alias("text")))
    none = F.array().cast("array<struct<below:string,text:string>>")
    inner = F.concat(
        when(number < F.col("minimum"), error(F.format_string(WORDING["below"], F.regexp_replace(F.col("minimum").cast("string"), r"\.0$", "")))),
        when(number > F.col("maximum"), error(F.format_string(WORDING["above"], F.regexp_replace(F.col("maximum").cast("string"), r"\.0$", "")))),
        F.when(kind == "object", F.concat(lacking, F.coalesce(extra, none))).otherwise(none),
    )
    received = F.lit(WORDING["type"].split("%s")[1])
    return (
        F.when(F.col("allowed").isNotNull(), when(~same, error(F.concat("wanted", received, shown))))
        .when(_misfit(), F.array(error(F.concat(F.lit(WORDING["type"].split("%s")[0]), "type", received, shown))))
        .otherwise(inner)
    )


def _below(claims: DataFrame, edges: DataFrame) -> DataFrame:
    """The claims one level deeper."""
    open_ = claims.filter("open").select("key", F.col("claim").alias("over"), "at", F.col("node").alias("parent"), "value", "kind", "loud")
    inside = open_.filter("kind = 'object'").select("*", F.explode(F.try_variant_get("value", "$", "map<string,variant>")).alias("name", "inner"))
    properties = inside.join(F.broadcast(edges.filter("role = 'property'")), ["parent", "name"])
    items = open_.filter("kind = 'array'").join(F.broadcast(edges.filter("role = 'item'")), "parent").select("*", F.posexplode(F.try_variant_get("value", "$", "array<variant>")).alias("place", "inner"))
    branches = open_.join(F.broadcast(edges.filter("role = 'branch'")), "parent")
    step = lambda text: F.concat("over", F.lit("/"), text)
    label = lambda text, at, value, loud, branch: ["key", step(text).alias("claim"), "over", at.alias("at"), "node", F.col(value).alias("value"), loud.alias("loud"), F.lit(branch).alias("branch")]
    place = F.col("place").cast("string")
    return (
        properties.select(label(F.concat(F.length("name").cast("string"), F.lit(":"), "name"), F.concat("at", F.lit("."), "name"), "inner", F.col("loud"), False))
        .union(items.select(label(place, F.concat(F.col("at"), F.lit("["), place, F.lit("]")), "inner", F.col("loud"), False)))
        .union(branches.select(label(F.concat(F.lit("|"), F.col("branch").cast("string")), F.col("at"), "value", F.lit(False), True)))
    )


def schema_errors(rows: DataFrame, key: str, payload: str, schema: Mapping, definition: str) -> DataFrame:
    """(key, at, error): what is wrong with the JSON text ``payload`` of each row against ``schema["$defs"][definition]``.

    Knows $ref, const, enum, oneOf, anyOf, lists of types, arrays, objects with
    required and additional properties, and minimum and maximum. Each level is written
    into the shared folder, so that a plan holds one level and a lost executor costs a read.
    """
    spark: SparkSession = rows.sparkSession
    node_rows, edge_rows, roots = schema_tables(schema)
    nodes, edges = F.broadcast(spark.createDataFrame(node_rows, _NODE)), spark.createDataFrame(edge_rows, _EDGE)
    parsed = rows.select(F.col(key).alias("key"), F.try_parse_json(F.col(payload)).alias("value"))
    unreadable = parsed.filter("value is null").select("key", F.lit(definition).alias("at"), F.lit(WORDING["text"]).alias("error"))
    claims = parsed.filter("value is not null").select(
        "key", F.lit("").alias("claim"), F.lit(None).cast("string").alias("over"), F.lit(definition).alias("at"), F.lit(roots[definition]).alias("node"), "value", F.lit(True).alias("loud"), F.lit(False).alias("branch")
    )
    levels, paths = [], []
    while not levels or not levels[-1].isEmpty():
        judged = claims.join(nodes, "node").withColumn("kind", _kind(F.col("value"))).withColumn("own", _own_errors())
        held = judged.withColumn("open", F.col("allowed").isNull() & ~_misfit())
        level, path = written(held.select("key", "claim", "over", "at", "node", "value", "kind", "loud", "branch", "own", "choice", "open"), "contract-level")
        levels.append(level)
        paths.append(path)
        claims = _below(level, edges)
    found, under = [], None
    for level in reversed(levels[:-1] or levels):
        told = level.select("key", "claim", "over", "at", "loud", "branch", "own", "choice")
        if under is None:
            told = told.withColumns({"bad_below": F.lit(0), "held": F.lit(0)})
        else:
            told = told.join(under, ["key", "claim"], "left").na.fill(0, ["bad_below", "held"])
        choice, held, passed = F.col("choice"), F.col("held"), F.size("own") == 0
        wrong = (
            F.when(passed & (choice == "oneOf") & (held == 0), WORDING["none of one"])
            .when(passed & (choice == "oneOf") & (held > 1), WORDING["many of one"])
            .when(passed & (choice == "anyOf") & (held == 0), WORDING["none of any"])
            .when(passed & (choice == "types") & (held == 0), WORDING["none of types"])
        )
        judged = told.withColumn("wrong", wrong).withColumn("bad", ~passed | F.col("wrong").isNotNull() | (F.col("bad_below") > 0))
        told, _ = written(judged.select("key", "over", "at", "loud", "branch", "own", "wrong", "bad"), "contract-told")
        loud = told.filter("loud")
        found.append(loud.select("key", "at", F.explode("own").alias("e")).select("key", F.concat("at", "e.below").alias("at"), F.col("e.text").alias("error")))
        found.append(loud.filter("wrong is not null").select("key", "at", F.col("wrong").alias("error")))
        own, branch = told.filter("over is not null"), F.col("branch")
        under = own.groupBy("key", F.col("over").alias("claim")).agg(F.count_if(F.col("bad") & ~branch).alias("bad_below"), F.count_if(~F.col("bad") & branch).alias("held"))
    for path in paths:
        stores.delete(spark, path)
    out = unreadable
    for part in found:
        out = out.union(part)
    return out


def schema_drift(old: DataFrame, new: DataFrame) -> DataFrame:
    """(change, and the columns of both): rows that only ``new`` has are ``added``, those that only ``old`` has ``removed``, each as often as one side has more of it."""
    new, names = new.select(*old.columns), old.columns
    return new.exceptAll(old).select(F.lit("added").alias("change"), *names).union(old.exceptAll(new).select(F.lit("removed").alias("change"), *names))
