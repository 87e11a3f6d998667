"""Facts of a code base, from files to nodes and edges, as expressions and joins.

Each file's text is cut at its type declarations and each type at its methods
by regular expressions inside Spark; names are then resolved by joins over the
declared types.  Known gaps: what follows a nested type counts as the nested
type's, calls choose among overloads by their number of arguments only, and
receivers that are themselves calls aren't resolved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import stripped
from ..functions.text import doc_summary, embed_text, file_stem
from ..plans.runtime import Scratch
from ..sources.project_files import REFERRING, extension

# Fixed values of the language and the project format.
ACCESSORS = (
    "GetComponent", "GetComponents", "GetComponentInChildren", "GetComponentsInChildren",
    "GetComponentInParent", "GetComponentsInParent", "AddComponent", "TryGetComponent",
)
SYSTEM_NAMES = {
    "bool": "Boolean", "byte": "Byte", "char": "Char", "decimal": "Decimal", "double": "Double", "float": "Single", "int": "Int32",
    "long": "Int64", "object": "Object", "short": "Int16", "string": "String", "uint": "UInt32", "ulong": "UInt64", "ushort": "UInt16",
}
_MODIFIERS = "public|internal|private|protected|sealed|abstract|static|partial|readonly|ref|unsafe|new|virtual|override|async|extern|const|volatile|event"
_NOT_TYPES = f"^({_MODIFIERS}|return|throw|else|await|yield|case|goto|using|namespace|in|is|as|out|where|class|struct|enum|interface|record|delegate)$"
_DECLARES = rf"(?m)(?=^[ \t]*(?:(?:{_MODIFIERS})\s+)*(?:class|interface|struct|enum|record)\s+[A-Za-z_]\w*)"
_STARTS = r"\A\s*" + f"(?:(?:{_MODIFIERS})\\s+)*" + r"(?:class|interface|struct|enum|record)\s+[A-Za-z_]"
_TYPE = r"(class|interface|struct|enum|record(?:\s+(?:class|struct))?)\s+([A-Za-z_]\w*)\s*(?:<[^>{(]*>)?\s*(?:\([^)]*\))?\s*(?::\s*([^{;]+))?"
_NAME = r"[A-Za-z_][\w.]*(?:<[^<>;(){}]*>)?(?:\[\])?\??"
_METHOD = rf"(?<![\w.])({_NAME})\s+([A-Za-z_]\w*)\s*(?:<[^<>()]*>)?\(([^()]*)\)"
_METHOD_START = rf"(?m)(?=^[ \t]*(?!return\b|throw\b|else\b|await\b|new\b|yield\b|using\b)(?:(?:{_MODIFIERS})\s+)*{_NAME}\s+[A-Za-z_]\w*\s*(?:<[^<>()]*>)?\([^()]*\)\s*(?:\{{|=>|;))"


def _group(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract(text, pattern, group)


def _all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def bare_code(text: Column) -> Column:
    """Without comments, and with string literals emptied."""
    without = F.regexp_replace(F.regexp_replace(text, r"(?s)/\*.*?\*/", " "), r"//[^\n]*", " ")
    return F.regexp_replace(without, r'"(?:[^"\\\n]|\\.)*"', '""')


def _outline(body: Column, depth: int = 8) -> Column:
    """What stands directly in a type: blocks are dropped from the inside out."""
    for _ in range(depth):
        body = F.regexp_replace(body, r"\{[^{}]*\}", "\n")
    return body


def simple_type(name: Column) -> Column:
    """A type's simple name: no namespace, type arguments, array or null mark; system names for keywords."""
    bare = F.regexp_replace(F.regexp_replace(name, r"<.*>|\?", ""), r"^.*\.", "")
    known = F.create_map(*(F.lit(x) for pair in SYSTEM_NAMES.items() for x in pair))
    return F.when(bare.endswith("]"), F.lit("")).otherwise(F.coalesce(known[bare], bare))


def _enclosing() -> Column:
    """For each of a file's ``parts`` (cut at the declarations) the names of the types around it, outermost first, joined by dots.

    A declaration lies in those before it whose braces are still open.
    """
    braces = lambda p: F.size(F.split(bare_code(p), r"\{")) - F.size(F.split(bare_code(p), r"\}"))
    name = lambda p: F.when(p.rlike(_STARTS), _group(p, _TYPE, 2)).otherwise("")
    each = F.transform("parts", lambda p: F.struct(braces(p).alias("b"), name(p).alias("n")))
    placed = F.transform(each, lambda x, i: F.struct(F.aggregate(F.slice(each, F.lit(1), i), F.lit(0), lambda t, y: t + y["b"]).alias("d"), x["n"].alias("n")))
    start = F.struct(F.array().cast("array<struct<d:int,n:string>>").alias("open"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        around = F.filter(acc["open"], lambda o: o["d"] < x["d"])
        here = F.when(x["n"] != "", F.array(x)).otherwise(F.array().cast("array<struct<d:int,n:string>>"))
        return F.struct(F.concat(around, here).alias("open"), F.concat(acc["out"], F.array(F.array_join(F.transform(around, lambda o: o["n"]), "."))).alias("out"))

    return F.aggregate(placed, start, step)["out"]


def declared_types(files: DataFrame) -> DataFrame:
    """One row per type declaration of ``files`` (path, content), with its code and what stands before it."""
    parts = files.where(F.col("content").isNotNull()).select(
        "path", F.sha1(F.encode("content", "UTF-8")).alias("content_hash"), _group(F.col("content"), r"(?m)^\s*namespace\s+([A-Za-z_][\w.]*)", 1).alias("ns"),
        _all(F.col("content"), r"(?m)^\s*using\s+([A-Za-z_][\w.]*)\s*;", 1).alias("usings"), F.split("content", _DECLARES).alias("parts"),
    )
    parts = parts.withColumn("outer", _enclosing())
    each = parts.select("path", "content_hash", "ns", "usings", F.posexplode("parts").alias("at", "code"), "parts", "outer").where(F.col("code").rlike(_STARTS))
    outer = F.element_at("outer", F.col("at") + 1)
    kind, name, bases = (_group(F.col("code"), _TYPE, i) for i in (1, 2, 3))
    before = F.when(F.col("at") > 0, _group(F.element_at("parts", F.col("at")), r"(?s)([^{}]*)\z", 1)).otherwise("")
    label = F.when(kind.rlike("struct"), "Struct").when(kind == "interface", "Interface").when(kind == "enum", "Enum").otherwise("Class")
    plain_bases = F.regexp_replace(F.regexp_replace(bases, r"<[^<>]*>", ""), r"\bwhere\b.*", "")
    return each.select(
        "path", "content_hash", "ns", "usings", "at", "code", label.alias("label"), name.alias("name"), before.alias("before"),
        F.concat_ws(".", F.when(F.col("ns") != "", F.col("ns")), F.when(outer != "", outer), name).alias("key"),
        F.filter(F.transform(F.split(plain_bases, ","), stripped), lambda b: b != "").alias("bases"),
        bare_code(F.regexp_replace(F.col("code"), r"(?s)\A[^{]*\{", "")).alias("body"),
    )


def type_nodes(types: DataFrame) -> DataFrame:
    """Each type once, its declarations folded together."""
    base = F.transform("bases", lambda b: F.regexp_replace(b, r"^.*\.", ""))
    signature = F.concat(F.lower("label"), F.lit(" "), F.col("name"), F.when(F.size("bases") > 0, F.concat(F.lit(" : "), F.array_join("bases", ", "))).otherwise(""))
    rows = types.select(
        "label", "key", "name", "ns", "path", "content_hash", F.nullif(doc_summary(F.col("before")), F.lit("")).alias("doc"), signature.alias("signature"),
        F.array_contains(base, "MonoBehaviour").alias("is_mono"), F.array_contains(base, "ScriptableObject").alias("is_scriptable"),
    )
    folded = rows.groupBy("label", "key").agg(*(F.max(c).alias(c) for c in rows.columns if c not in ("label", "key")))
    return folded.withColumn("embed_text", embed_text(F.col("name"), F.col("ns"), F.col("signature"), F.col("doc")))


def _resolve(facts: DataFrame, types: DataFrame, name: str) -> DataFrame:
    """``facts`` (with ns, usings, key) joined with the type that ``name`` means there: own namespace first, then outer ones, then usings."""
    known = types.select(F.col("name").alias("_simple"), F.col("ns").alias("_ns"), F.col("key").alias("dst"), F.col("label").alias("dst_label")).distinct()
    wanted = facts.withColumn("_name", F.regexp_replace(F.regexp_replace(name, r"<.*>|\[\]|\?", ""), r"^.*\.", "")).withColumn("_row", F.xxhash64(*facts.columns))
    seen = F.when(F.col(name) == F.col("dst"), 0).when(F.col("_ns") == F.col("ns"), 1).when(F.startswith(F.concat("ns", F.lit(".")), F.concat("_ns", F.lit("."))), 2)
    seen = seen.when(F.array_contains("usings", F.col("_ns")), 3).when(F.col("_ns") == "", 4)
    found = wanted.join(known, F.col("_name") == F.col("_simple")).withColumn("_rank", seen).where("_rank is not null")
    first = Window.partitionBy("_row").orderBy("_rank", "dst")
    return found.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_name", "_row", "_simple", "_ns", "_rank", "_n")


def methods(types: DataFrame) -> DataFrame:
    """``(key, name, owner, arity, code)`` of ordinary methods; the key has the parameters' simple types."""
    chunks = types.select("path", "ns", "usings", F.col("key").alias("owner"), F.col("name").alias("owner_name"), F.explode(F.split("body", _METHOD_START)).alias("code"))
    returns, name, given = (_group(F.col("code"), r"\A\s*(?:(?:" + _MODIFIERS + r")\s+)*" + _METHOD, i) for i in (1, 2, 3))
    rows = chunks.select("*", returns.alias("returns"), name.alias("name"), given.alias("given")).where("name <> '' and name <> owner_name").where(~F.col("returns").rlike(_NOT_TYPES))
    kinds = F.transform(F.filter(F.split("given", ","), lambda p: F.trim(p) != ""), lambda p: F.regexp_extract(p, rf"\A\s*(?:\[[^\]]*\]\s*)?(?:(?:ref|out|in|params|this)\s+)*({_NAME})\s", 1))
    rows = rows.withColumn("param_types", kinds).withColumn("arity", F.size("param_types"))
    return rows.withColumn("key", F.concat("owner", F.lit("."), "name", F.lit("("), F.array_join(F.transform("param_types", simple_type), ","), F.lit(")")))


def method_nodes(held: DataFrame) -> DataFrame:
    """Each method once, with its signature and text for embedding."""
    signature = F.concat("returns", F.lit(" "), "owner", F.lit("."), "name", F.lit("("), F.array_join("param_types", ", "), F.lit(")"))
    rows = held.groupBy("key").agg(F.min("name").alias("name"), F.min("owner_name").alias("owner_name"), F.min("path").alias("path"), F.min(signature).alias("signature"))
    return rows.select(F.lit("Method").alias("label"), "key", "name", "path", "signature", embed_text(F.col("name"), F.col("owner_name"), F.col("signature")).alias("embed_text"))


def code_edges(types: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """``(rel, src, dst)`` between types, methods, namespaces and addresses."""
    scratch = scratch or Scratch(types.sparkSession, "extraction")
    bases = types.select("ns", "usings", "key", F.explode("bases").alias("base"))
    parents = scratch.write(_resolve(bases, types, "base").where("dst <> key"))
    inherits = parents.select(F.when(F.col("dst_label") == "Interface", "IMPLEMENTS").otherwise("INHERITS").alias("rel"), F.col("key").alias("src"), "dst")

    held = scratch.write(methods(types))
    outline = _outline(F.col("body"))
    fields = F.filter(
        F.arrays_zip(_all(outline, rf"(?<![\w.])({_NAME})\s+([A-Za-z_]\w*)\s*(?=;|=|\n|\z)", 1).alias("t"), _all(outline, rf"(?<![\w.])({_NAME})\s+([A-Za-z_]\w*)\s*(?=;|=|\n|\z)", 2).alias("n")),
        lambda x: ~x["t"].rlike(_NOT_TYPES),
    )
    members = types.select("ns", "usings", "key", F.explode(fields).alias("m")).select("ns", "usings", "key", F.col("m.t").alias("type"), F.col("m.n").alias("var"))
    of_methods = held.select("ns", "usings", F.col("owner").alias("key"), F.explode(F.concat(F.array("returns"), "param_types")).alias("type"))
    refers = _resolve(members.drop("var").unionByName(of_methods).distinct(), types, "type").where("dst <> key")
    references = refers.select(F.lit("REFERENCES").alias("rel"), F.col("key").alias("src"), "dst")

    asked = _all(F.col("body"), rf"\b(?:{'|'.join(ACCESSORS)})\s*<\s*([A-Za-z_][\w.]*)\s*>\s*\(", 1)
    required = F.flatten(F.transform(_all(F.col("before"), r"\[\s*RequireComponent(?:Attribute)?\s*\(([^\]]*)\)\s*[,\]]", 1), lambda x: F.regexp_extract_all(x, F.lit(r"typeof\s*\(\s*([A-Za-z_][\w.]*)\s*\)"), F.lit(1))))
    needs = types.select("ns", "usings", "key", F.explode(F.array_distinct(F.concat(asked, required))).alias("part"))
    uses = _resolve(needs, types, "part").where("dst <> key").select(F.lit("USES_COMPONENT").alias("rel"), F.col("key").alias("src"), "dst")

    loaded = _all(F.col("code"), r'\bAddressables\s*\.\s*(?:Load|Instantiate)\w*\s*(?:<[^<>()]*>)?\s*\(\s*"([^"\\]+)"', 1)
    loads = types.select(F.lit("LOADS").alias("rel"), F.col("key").alias("src"), F.explode(F.array_distinct(loaded)).alias("a")).select("rel", "src", F.concat(F.lit("addr:"), "a").alias("dst"))

    spaces = types.where("ns <> ''").select(F.lit("IN_NAMESPACE").alias("rel"), F.col("key").alias("src"), F.col("ns").alias("dst"))
    declared = held.select(F.lit("DECLARED_IN").alias("rel"), F.col("key").alias("src"), F.col("owner").alias("dst"))
    every = [inherits, references, uses, loads, spaces, declared, _calls(types, held, members, parents)]
    out = every[0]
    for more in every[1:]:
        out = out.unionByName(more)
    return out.distinct()


def _calls(types: DataFrame, held: DataFrame, members: DataFrame, parents: DataFrame) -> DataFrame:
    """CALLS between methods: the receiver's type from locals, parameters, fields or its own name; then a method of that name and arity."""
    inner = F.regexp_replace("code", r"(?s)\A.*?\)\s*(?=\{|=>)", "")
    pattern = r"(?:\b([A-Za-z_]\w*)\s*\.\s*)?(?<!new )\b([A-Za-z_]\w*)\s*(?:<[^<>()]*>)?\(([^()]*)\)"
    found = F.arrays_zip(*(_all(inner, pattern, i).alias(n) for i, n in ((1, "r"), (2, "m"), (3, "a"))))
    calls = held.select("ns", "usings", F.col("key").alias("caller"), "owner", "code", F.explode(found).alias("c")).select(
        "ns", "usings", "caller", "owner", F.col("c.r").alias("receiver"), F.col("c.m").alias("called"),
        F.size(F.filter(F.split("c.a", ","), lambda x: F.trim(x) != "")).alias("n_args"),
    ).distinct()
    local = rf"(?<![\w.])({_NAME})\s+([A-Za-z_]\w*)\s*(?==|;|,|\)|\bin\b)"
    locals_ = held.select(F.col("key").alias("caller"), "ns", "usings", "owner", F.explode(F.arrays_zip(_all(F.col("code"), local, 1).alias("t"), _all(F.col("code"), local, 2).alias("n"))).alias("v"))
    locals_ = locals_.select("caller", "ns", "usings", F.col("v.t").alias("type"), F.col("v.n").alias("receiver")).where(~F.col("type").rlike(_NOT_TYPES))
    by_local = _resolve(locals_.distinct(), types, "type").select("caller", "receiver", F.col("dst").alias("target"))
    own_fields = _resolve(members.distinct(), types, "type").select(F.col("key").alias("owner"), F.col("var").alias("receiver"), F.col("dst").alias("target"))
    above = parents.select(F.col("key").alias("owner"), F.col("dst").alias("base"))
    inherited = above.join(own_fields.withColumnRenamed("owner", "base"), "base").select("owner", "receiver", "target")
    plain = calls.where("receiver = '' or receiver in ('this', 'base')")
    self_or_base = plain.withColumn("target", F.col("owner")).unionByName(plain.join(above, "owner").select(*plain.columns, F.col("base").alias("target")))
    named = calls.where("receiver <> '' and receiver not in ('this', 'base')")
    columns = [*calls.columns, "target"]
    on_local = named.join(by_local, ["caller", "receiver"]).select(*columns)
    on_field = named.join(by_local, ["caller", "receiver"], "left_anti").join(own_fields.unionByName(inherited).distinct(), ["owner", "receiver"]).select(*columns)
    on_type = _resolve(named, types, "receiver").withColumnRenamed("dst", "target").select(*columns)
    targets = self_or_base.unionByName(on_local).unionByName(on_field).unionByName(on_type)
    method = held.select(F.col("owner").alias("target"), F.col("name").alias("called"), F.col("key").alias("dst"), "arity")
    ranked = targets.join(method, ["target", "called"]).withColumn("fit", (F.col("arity") == F.col("n_args")).cast("int"))
    best = Window.partitionBy("caller", "receiver", "called", "n_args").orderBy(F.desc("fit"), F.desc(F.col("target") == F.col("owner")), "dst")
    return ranked.withColumn("_n", F.row_number().over(best)).where("_n = 1 and dst <> caller").select(F.lit("CALLS").alias("rel"), F.col("caller").alias("src"), "dst")


_GUID = r"guid:\s*([0-9a-fA-F]{32})"


def guid_references(content: Column) -> Column:
    """The distinct guids a text file refers to, in lower case."""
    return F.array_distinct(F.transform(_all(content, _GUID, 1), F.lower))


def assets(files: DataFrame) -> DataFrame:
    """``(guid, path)`` from ``.meta`` files beside existing files; a repeated guid belongs to the last path."""
    metas = files.where(extension(F.col("path")) == "meta").select(F.regexp_replace("path", r"\.meta$", "").alias("path"), F.lower(_group(F.col("content"), _GUID, 1)).alias("guid")).where("guid <> ''")
    there = metas.join(files.select("path"), "path", "left_semi")
    return there.groupBy("guid").agg(F.max("path").alias("path"))


def asset_dependencies(files: DataFrame, known: DataFrame) -> DataFrame:
    """DEPENDS_ON from assets to the known guids in their text, never to themselves."""
    text = files.where(extension(F.col("path")).isin(*(k.lower() for k in REFERRING))).select("path", F.explode(guid_references(F.col("content"))).alias("dst"))
    named = text.join(known, "path").where("guid <> dst").select(F.lit("DEPENDS_ON").alias("rel"), F.col("guid").alias("src"), "dst")
    return named.join(known.select(F.col("guid").alias("dst")), "dst", "left_semi").select("rel", "src", "dst")


def script_bridge(types: DataFrame, known: DataFrame) -> DataFrame:
    """SCRIPT_OF from a script file to its type of the same name, or else to all its types; paths match in any case."""
    files = known.select("guid", F.lower("path").alias("_path"))
    rows = types.join(files, F.lower("path") == F.col("_path")).withColumn("_same", F.col("name") == file_stem(F.col("path")))
    any_same = F.max("_same").over(Window.partitionBy("path"))
    return rows.withColumn("_any", any_same).where("_same or not _any").select(F.lit("SCRIPT_OF").alias("rel"), F.col("guid").alias("src"), F.col("key").alias("dst")).distinct()


def manifest_edges(records: DataFrame, types: DataFrame) -> DataFrame:
    """DEPENDS_ON and SCRIPT_OF that a manifest states: known guids other than the asset's, and types known by key."""
    named = records.select(F.col("guid").alias("src"), F.explode("dependencies").alias("dst")).where("src <> dst")
    depends = named.join(records.select(F.col("guid").alias("dst")), "dst", "left_semi").select(F.lit("DEPENDS_ON").alias("rel"), "src", "dst")
    scripts = records.select(F.col("guid").alias("src"), F.col("script_type").alias("dst")).join(types.select(F.col("key").alias("dst")), "dst", "left_semi")
    return depends.unionByName(scripts.select(F.lit("SCRIPT_OF").alias("rel"), "src", "dst")).distinct()


def address_entries(files: DataFrame) -> DataFrame:
    """``(path, group, guid, address)`` of address groups: each guid with an address in the text up to the next guid; the first of an address counts."""
    groups = files.where((extension(F.col("path")) == "asset") & F.contains(F.col("content"), F.lit("m_SerializeEntries")))
    name = F.trim(_group(F.col("content"), r"(?m)m_Name:[ \t]*(\S[^\r\n]*)", 1))
    parts = groups.select("path", F.when(name != "", name).otherwise(file_stem(F.col("path"))).alias("group"), F.posexplode(F.split("content", r"(?=m_GUID:\s*[0-9a-fA-F]{32})")).alias("at", "part"))
    address = F.regexp_replace(F.trim(_group(F.col("part"), r"m_Address:[ \t]*([^\r\n]+)", 1)), r"^[\"']+|[\"']+$", "")
    rows = parts.select("path", "group", "at", F.lower(_group(F.col("part"), r"m_GUID:\s*([0-9a-fA-F]{32})", 1)).alias("guid"), address.alias("address")).where("guid <> '' and address <> ''")
    first = Window.partitionBy("path", "address").orderBy("at")
    return rows.withColumn("_n", F.row_number().over(first)).where("_n = 1").select("path", "group", "guid", "address")


def address_edges(entries: DataFrame) -> DataFrame:
    """HAS_ENTRY and ADDRESSES."""
    key = F.concat(F.lit("addr:"), "address")
    has = entries.select(F.lit("HAS_ENTRY").alias("rel"), F.concat(F.lit("addrgroup:"), "group").alias("src"), key.alias("dst"))
    return has.unionByName(entries.select(F.lit("ADDRESSES").alias("rel"), key.alias("src"), F.col("guid").alias("dst"))).distinct()


def project_graph(files: DataFrame, manifest: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """``(nodes, edges)`` of a whole project tree; edges without both ends are dropped."""
    scratch = Scratch(files.sparkSession, "extraction")
    types = scratch.write(declared_types(files.where(extension(F.col("path")) == "cs")))
    known = manifest.select("guid", "path") if manifest is not None else assets(files)
    asset_layer = manifest_edges(manifest, types) if manifest is not None else asset_dependencies(files, known).unionByName(script_bridge(types, known))
    entries = address_entries(files)
    rows = [
        type_nodes(types).select("label", "key", "name", "path", "doc", "signature", "embed_text", "content_hash"),
        types.where("ns <> ''").select(F.lit("Namespace").alias("label"), F.col("ns").alias("key"), F.col("ns").alias("name")).distinct(),
        method_nodes(methods(types)),
        known.select(F.lit("Asset").alias("label"), F.col("guid").alias("key"), F.element_at(F.split("path", "/"), -1).alias("name"), "path"),
        entries.select(F.lit("AddressableGroup").alias("label"), F.concat(F.lit("addrgroup:"), "group").alias("key"), F.col("group").alias("name"), "path").dropDuplicates(["key"]),
        entries.select(F.lit("AddressableEntry").alias("label"), F.concat(F.lit("addr:"), "address").alias("key"), F.col("address").alias("name")).distinct(),
    ]
    nodes = rows[0]
    for more in rows[1:]:
        nodes = nodes.unionByName(more, allowMissingColumns=True)
    edges = scratch.write(code_edges(types, scratch).unionByName(asset_layer).unionByName(address_edges(entries)).distinct())
    # What a type refers to closes its text for embedding.
    used = edges.where("rel = 'REFERENCES'").groupBy(F.col("src").alias("key")).agg(F.array_sort(F.collect_set(F.regexp_extract("dst", r"[^.]*$", 0))).alias("used"))
    uses = F.when(F.col("label").isin("Class", "Interface", "Struct", "Enum") & F.col("used").isNotNull(), F.concat(F.lit("uses "), F.array_join("used", " ")))
    nodes = scratch.write(nodes.join(used, "key", "left").withColumn("embed_text", F.when(F.col("embed_text").isNotNull(), embed_text(F.col("embed_text"), uses))).drop("used"))
    keys = nodes.select("key").distinct()
    held = edges.join(keys.withColumnRenamed("key", "src"), "src", "left_semi").join(keys.withColumnRenamed("key", "dst"), "dst", "left_semi")
    return nodes, held.select("rel", "src", "dst")
