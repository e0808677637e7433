"""Typed references: what calls and literals in bodies refer to, from declared types.

All of a tree's declarations become tables that are joined, so no task sees a whole package: imports
(a file's aliases), globals (a package's functions, types and variables with the type each yields),
members (a type's fields and methods, and those promoted through embedded types), and scopes (a function's
receiver, parameters and local variables). A node's dotted target is then followed part by part: its first part is
a variable in scope, an import's alias or a name of the package; each further part is a member of the type so far.

A key is ``package.name``, or ``package.receiver.name`` for a method, of the type that declares it. Of members of
one name the shallowest is promoted; several at one depth are ambiguous and have no key, nor have variables declared with several types.

units are those of ``sources.code.extract``, with ``id``; files have filepath and content.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.operators.graph import LINE_BUCKET
from weftline.staging import drop, stage

_COMMENT = r"(?s)/\*.*?\*/|//[^\n]*"
_WORD = r"[A-Za-z_]\w*"
_PATH = rf"{_WORD}(?:\.{_WORD})*"
#: What stands before a type's name: pointers, slices, arrays, maps, channels, a variadic parameter.
_AROUND = r"^(?:\*|\[\w*\]|\.\.\.|map\[[^\]]*\]|<-\s*chan\s|chan\s|\s)*"
#: Declarations in bodies: a literal's type, a call's callee, and a named type; each after the first name declared.
_LITERAL = rf"\b({_WORD})\s*:?=\s*&?({_PATH})\s*\{{"
_CALL = rf"\b({_WORD})(?:\s*,\s*{_WORD})*\s*:?=\s*({_PATH})\("
_VAR = rf"\bvar\s+({_WORD})\s+([*\[\]]*{_PATH})"


def imports(files: DataFrame) -> DataFrame:
    """(filepath, alias, path): an import without a name has its path's last part, less a version, as its alias."""
    body = F.regexp_replace("content", _COMMENT, " ")
    one = F.regexp_extract_all(body, F.lit(rf'(?m)(?:^|;)\s*import\s+((?:(?:{_WORD}|\.)\s+)?"[^"\n]+")'), F.lit(1))
    many = F.regexp_extract_all(body, F.lit(r"(?m)(?:^|;)\s*import\s*\(([^)]*)\)"), F.lit(1))
    lines = files.select("filepath", F.explode(F.split(F.array_join(F.concat(one, many), "\n"), r"[\n;]")).alias("line"))
    spec = rf'^\s*(?:({_WORD}|\.)\s+)?"([^"]+)"'
    found = lines.select("filepath", F.regexp_extract("line", spec, 1).alias("alias"), F.regexp_extract("line", spec, 2).alias("path")).filter("path <> ''")
    last = F.substring_index(F.regexp_replace("path", r"/v[0-9]+$", ""), "/", -1)
    return found.select("filepath", F.when(F.col("alias") == "", last).otherwise(F.col("alias")).alias("alias"), "path").distinct()


def _folder(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def aliases(found: DataFrame, units: DataFrame) -> DataFrame:
    """(filepath, aliases): each file's map from alias to package. A path that ends in a folder of the tree names that folder's package, else it names itself.

    Where a folder has several packages (no Go program has), the first by name counts.
    """
    last = lambda c: F.substring_index(c, "/", -1)
    homes = units.select(_folder(F.col("filepath")).alias("folder"), "package").filter("folder <> '' AND package <> ''")
    homes = homes.groupBy("folder").agg(F.min("package").alias("package")).withColumn("last", last(F.col("folder")))
    paths = found.select("path").distinct().withColumn("last", last(F.col("path")))
    inside = (F.col("path") == F.col("folder")) | F.endswith(F.col("path"), F.concat(F.lit("/"), "folder"))
    known = paths.join(homes, "last").filter(inside).groupBy("path").agg(F.max_by("package", F.length("folder")).alias("package"))
    named = found.join(known, "path", "left").withColumn("package", F.coalesce("package", last(F.regexp_replace("path", r"/v[0-9]+$", ""))))
    each = named.groupBy("filepath", "alias").agg(F.min("package").alias("package"))
    return each.groupBy("filepath").agg(F.map_from_entries(F.collect_list(F.struct("alias", "package"))).alias("aliases"))


def _key(text: Column) -> Column:
    """package.Type of a type's text, in a row with its file's package and aliases; null for others than named types."""
    base = F.regexp_replace(F.regexp_replace(text, _AROUND, ""), r"\[.*$", "")
    away = F.try_element_at("aliases", F.substring_index(base, ".", 1))
    key = F.when(F.contains(base, F.lit(".")), F.concat_ws(".", away, F.substring_index(base, ".", -1))).otherwise(F.concat_ws(".", "package", base))
    return F.when(base.rlike(rf"^{_WORD}$") | base.rlike(rf"^{_WORD}\.{_WORD}$") & away.isNotNull(), key)


def _first_type(pairs: str) -> Column:
    return _key(F.try_element_at(pairs, F.lit(1))["type"])


def receiver_type(receiver: Column) -> Column:
    """T of ``(t *T)``, ``(T)`` or ``(t *T[K])``."""
    return F.regexp_extract(receiver, rf"({_WORD})(?:\[[^\]]*\])?\s*\)?\s*$", 1)


def method_index(symbols: DataFrame) -> DataFrame:
    """(key, id) of methods: package.receiver.name."""
    own = symbols.filter("unit_type = 'method'").withColumn("of", receiver_type(F.col("receiver"))).filter("of <> ''")
    return own.select(F.concat_ws(".", "package", "of", "name").alias("key"), "id").distinct()


def declared(units: DataFrame) -> DataFrame:
    """(type, member, key, result) of what types declare themselves. A field has no key; result is the type it has or returns."""
    owner = F.concat_ws(".", "package", "name").alias("type")
    fields = units.filter("unit_type = 'struct'").select("package", "aliases", owner, F.explode("fields").alias("f"))
    fields = fields.select("type", F.col("f.name").alias("member"), F.lit(None).cast("string").alias("key"), _key(F.col("f.type")).alias("result"))
    methods = units.filter("unit_type = 'method'").withColumn("of", receiver_type(F.col("receiver"))).filter("of <> ''")
    methods = methods.select(F.concat_ws(".", "package", "of").alias("type"), F.col("name").alias("member"), F.concat_ws(".", "package", "of", "name").alias("key"), _first_type("returns").alias("result"))
    asked = units.filter("unit_type = 'interface'").select("package", "aliases", owner, F.explode("methods").alias("m"))
    name, yields = F.regexp_extract("m", rf"^({_WORD})\s*\(", 1), F.regexp_extract("m", rf"\)\s*\(?([*\[\]]*{_PATH})[,)]?[^()]*$", 1)
    asked = asked.withColumn("member", name).filter("member <> ''").select("type", "member", F.concat_ws(".", "type", "member").alias("key"), _key(yields).alias("result"))
    every = fields.unionByName(methods).unionByName(asked)
    return every.groupBy("type", "member").agg(F.min("key").alias("key"), F.min("result").alias("result"))


def embedded(units: DataFrame) -> DataFrame:
    """(outer, inner): a struct's fields that are named like their type, and an interface's names without parameters."""
    owner = F.concat_ws(".", "package", "name").alias("outer")
    fields = units.filter("unit_type = 'struct'").select("package", "aliases", owner, F.explode("fields").alias("f"))
    fields = fields.filter(F.regexp_extract("f.type", rf"^\*?(?:{_WORD}\.)?({_WORD})", 1) == F.col("f.name")).select("outer", _key(F.col("f.type")).alias("inner"))
    names = units.filter("unit_type = 'interface'").select("package", "aliases", owner, F.explode("methods").alias("m"))
    names = names.filter(~F.contains("m", F.lit("("))).select("outer", _key(F.col("m")).alias("inner"))
    return fields.unionByName(names).filter("inner IS NOT NULL AND inner <> outer").distinct()


def members(own: DataFrame, embeds: DataFrame) -> DataFrame:
    """own (type, member, key, result) and what embedded types promote, by rounds of one join until none adds a row.

    A round joins what the round before has added only. A type's member is added once, at its least depth, so types that embed
    each other end; a member found twice at one depth stays without key and result, and hides deeper ones.
    """
    known = new = stage(own.withColumn("depth", F.lit(0)), "members")
    rounds = [known]
    while True:
        up = embeds.join(new, F.col("inner") == F.col("type")).select(F.col("outer").alias("type"), "member", "key", "result")
        from_ = F.struct(F.coalesce("key", F.lit("")), F.coalesce("result", F.lit("")))
        one = up.groupBy("type", "member").agg(F.count_distinct(from_).alias("n"), F.min("key").alias("key"), F.min("result").alias("result"))
        one = one.join(known.select("type", "member"), ["type", "member"], "left_anti")
        once = lambda c: F.when(F.col("n") == 1, F.col(c)).alias(c)
        new = stage(one.select("type", "member", once("key"), once("result"), F.lit(len(rounds)).alias("depth")), "members")
        if not new.take(1):
            drop(new)
            return known
        rounds.append(new)
        known = known.unionByName(new)


def names(units: DataFrame) -> DataFrame:
    """(key, result, callee) of packages' functions, types and variables: the type each yields, or what is called for it."""
    key = F.concat_ws(".", "package", "name").alias("key")
    none = F.lit(None).cast("string").alias("callee")
    types = units.filter("unit_type IN ('struct', 'interface', 'type')").select(key, F.concat_ws(".", "package", "name").alias("result"), none)
    functions = units.filter("unit_type = 'function'").select(key, _first_type("returns").alias("result"), none)
    made = F.regexp_extract("value", rf"^&?({_PATH})\s*\{{", 1)
    called = F.regexp_extract("value", rf"^({_PATH})\(", 1)
    typed = F.when(F.col("value_type") != "", F.col("value_type")).when(made != "", made)
    values = units.filter("unit_type IN ('variable', 'constant')").select(key, _key(typed).alias("result"), _key(F.when(typed.isNull() & (called != ""), called)).alias("callee"))
    return types.unionByName(functions).unionByName(values).groupBy("key").agg(F.min("result").alias("result"), F.min("callee").alias("callee"))


def globals_(units: DataFrame) -> DataFrame:
    """(key, result) of names, where a variable that a call initialises has what the called function yields."""
    found = stage(names(units), "names")
    later = found.filter("callee IS NOT NULL").select("key", F.col("callee").alias("c"))
    yields = later.join(found.select(F.col("key").alias("c"), "result"), "c", "left").select("key", "result")
    return found.filter("callee IS NULL").select("key", "result").unionByName(yields)


def declarations(units: DataFrame) -> DataFrame:
    """(id, name, type, callee): variables of functions; of a body's declarations without a named type what they call."""
    bodies = units.filter("unit_type IN ('function', 'method')")
    none = F.lit(None).cast("string")
    receiver = bodies.select("id", F.regexp_extract("receiver", rf"^\(\s*({_WORD})\s", 1).alias("name"), F.concat_ws(".", "package", receiver_type(F.col("receiver"))).alias("type"), none.alias("callee"))
    parameters = bodies.select("id", "package", "aliases", F.explode("parameters").alias("p")).select("id", F.col("p.name").alias("name"), _key(F.col("p.type")).alias("type"), none.alias("callee"))
    out = receiver.unionByName(parameters)
    for pattern in (_LITERAL, _VAR, _CALL):
        found = bodies.select("id", "package", "aliases", F.explode(F.regexp_extract_all(F.regexp_replace("content", _COMMENT, " "), F.lit(f"({pattern})"), F.lit(1))).alias("m"))
        name, what = F.regexp_extract("m", pattern, 1), F.regexp_extract("m", pattern, 2)
        kind, callee = (none, what) if pattern is _CALL else (_key(what), none)
        out = out.unionByName(found.select("id", name.alias("name"), kind.alias("type"), callee.alias("callee")))
    return out.filter("name <> '' AND name <> '_'").distinct()


def follow(paths: DataFrame, scope: DataFrame, known: DataFrame, member: DataFrame) -> DataFrame:
    """paths (id, target, package, aliases) with key and result, where its parts can be followed.

    scope: id, name, type; known: key, result; member: type, member, key, result. A round follows one part of all targets.
    """
    parts = F.split("target", r"\.")
    p = paths.withColumn("p", parts)
    local = scope.select("id", F.col("name").alias("head"), F.col("type").alias("local"), F.lit(True).alias("is_local"))
    p = p.withColumn("head", F.col("p")[0]).join(local, ["id", "head"], "left")
    away = F.try_element_at("aliases", F.col("head"))
    is_local = F.coalesce("is_local", F.lit(False))
    imported = ~is_local & away.isNotNull() & (F.size("p") > 1)
    named = F.when(is_local, None).when(imported, F.concat_ws(".", away, F.col("p")[1])).otherwise(F.concat_ws(".", "package", "head"))
    p = p.withColumns({"named": named, "at": F.when(imported, 2).otherwise(1)}).join(known.select(F.col("key").alias("named"), F.col("result").alias("yields"), F.lit(True).alias("is_known")), "named", "left")
    # A name of an imported package is its own key; one of this package only if it is declared.
    whole = (F.size("p") == F.col("at")) & ~is_local & (imported | F.col("is_known"))
    state = p.select(*paths.columns, "p", "at", F.when(is_local, F.col("local")).otherwise(F.col("yields")).alias("type"), F.when(whole, F.col("named")).alias("key"))
    state = stage(state, "paths")
    done, left = [], state
    while True:
        done.append(left.filter(F.col("at") >= F.size("p")).select(*paths.columns, "key", F.col("type").alias("result")))
        left = left.filter((F.col("at") < F.size("p")) & F.col("type").isNotNull()).withColumn("member", F.col("p")[F.col("at")]).drop("key")
        if not left.take(1):
            break
        left = left.join(member.select("type", "member", "key", F.col("result").alias("next")), ["type", "member"])
        left = stage(left.select(*paths.columns, "p", (F.col("at") + 1).alias("at"), F.col("next").alias("type"), "key"), "paths")
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def scopes(found: DataFrame, units: DataFrame, known: DataFrame, member: DataFrame) -> DataFrame:
    """(id, name, type) of declarations. A variable that a call initialises is typed once all that its callee needs is; rounds go on while they add one."""
    typed = found.filter("callee IS NULL").select("id", "name", "type")
    left = stage(found.filter("callee IS NOT NULL").join(units.select("id", "package", "aliases").dropDuplicates(["id"]), "id").select("id", "name", F.col("callee").alias("target"), "package", "aliases"), "calls")
    while True:
        # Not yet typed variables are in scope, so that none is taken for a package or a global.
        scope = typed.unionByName(left.select("id", "name", F.lit(None).cast("string").alias("type")))
        scope = stage(scope.groupBy("id", "name").agg(F.when(F.count_distinct("type") == 1, F.min("type")).alias("type")), "scope")
        if not left.take(1):
            return scope
        new = stage(follow(left, scope, known, member).filter("result IS NOT NULL").select("id", "name", "target", F.col("result").alias("type")), "typed")
        if not new.take(1):
            return scope
        typed = typed.unionByName(new.select("id", "name", "type"))
        left = stage(left.join(new.select("id", "name", "target"), ["id", "name", "target"], "left_anti"), "calls")


def nodes(units: DataFrame) -> DataFrame:
    """(id, filepath, kind, target, line): calls and literals in bodies."""
    found = units.select("id", "filepath", F.explode("relations").alias("r")).filter("r.in_body")
    return found.select("id", "filepath", F.col("r.kind").alias("kind"), F.col("r.target").alias("target"), F.col("r.start_line").alias("line"))


def near(relations: DataFrame, found: DataFrame) -> DataFrame:
    """(from_id, ord, id, target): the nodes of a relation's kind on the lines of its evidence; of these only those of its own target, if there are any.

    Lines meet by file, kind and bucket, so a long file's relations don't meet all its nodes.
    """
    start = F.greatest(F.coalesce("evidence.start_line", F.lit(1)), F.lit(1))
    end = F.greatest(F.coalesce("evidence.end_line", F.lit(1)), start)
    asked = relations.select("from_id", "ord", "kind", F.col("target").alias("wanted"), F.col("evidence.filepath").alias("filepath"), start.alias("first"), end.alias("last"))
    asked = asked.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("first") / LINE_BUCKET), F.floor(F.col("last") / LINE_BUCKET))))
    placed = found.withColumn("bucket", F.floor(F.col("line") / LINE_BUCKET))
    met = asked.join(placed, ["filepath", "kind", "bucket"]).filter(F.col("line").between(F.col("first"), F.col("last")))
    own = (F.col("target") == F.col("wanted")) & (F.col("id") == F.col("from_id"))
    met = met.withColumn("own", own).withColumn("any", F.max("own").over(Window.partitionBy("from_id", "ord")))
    return met.filter("own OR NOT any").select("from_id", "ord", "id", "target").distinct()


def references(units: DataFrame, found_imports: DataFrame, relations: DataFrame) -> DataFrame:
    """(from_id, ord, key): what the calls and literals of relations refer to, as ``link.resolve_unique`` takes it.

    Variables are looked at only in functions that these relations' nodes stand in.
    """
    units = units.filter(~F.col("filepath").rlike(r"_test\.go$"))
    maps = aliases(found_imports, units)
    empty = F.expr("cast(map() AS map<string, string>)")
    units = stage(units.join(maps, "filepath", "left").withColumn("aliases", F.coalesce("aliases", empty)), "declared")
    known = stage(globals_(units), "globals")
    member = members(declared(units), stage(embedded(units), "embeds"))
    asked = stage(near(relations, nodes(units)), "nodes")
    bodies = units.join(asked.select("id").distinct(), "id", "left_semi")
    scope = scopes(declarations(bodies), bodies, known, member)
    paths = asked.select("id", "target").distinct().join(bodies.select("id", "package", "aliases").dropDuplicates(["id"]), "id")
    keys = follow(paths, scope, known, member).filter("key IS NOT NULL").select("id", "target", "key")
    return asked.join(keys, ["id", "target"]).select("from_id", "ord", "key").distinct()
