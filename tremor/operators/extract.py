"""Source corpora to code facts.

The map step gives raw syntax rows of one file each: what stands where, inside which named blocks, with its parts as
text. Names, scopes, owners, aliases and ids are Spark expressions and joins over those rows.
"""
from __future__ import annotations

import ast
import itertools
import re
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tremor.functions import columns as X
from tremor.plans.loops import cut

# Parsers travel to the executors by value, so nothing has to be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Raw row: number in reading order, number of the row it is part of, its place there, blocks around it, parts as text.
SYNTAX = """repo string, path string, no int, up int, field string, pos int, type string, name string, line int,
  blocks array<struct<type:string,name:string>>, parts map<string,array<string>>, shapes map<string,string>"""

# --- raw rows ---------------------------------------------------------------------------------

_KEPT = (ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef, ast.Import, ast.ImportFrom, ast.Assign, ast.Call, ast.arg, ast.arguments)
_BLOCKS = (ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef)


def _texts(value) -> list[str]:
    """A node's field as texts; statements inside a body are left to their own rows."""
    many = value if isinstance(value, list) else [value]
    return [ast.unparse(v) if isinstance(v, ast.AST) else str(v) for v in many if v is not None and not isinstance(v, ast.stmt)]


def _python_syntax(text: str) -> list[dict]:
    """Rows of the kept nodes of a module, walked with an explicit stack in reading order."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError) as err:
        return [{"no": 0, "type": "Error", "name": f"{type(err).__name__}: {err}", "blocks": []}]
    rows, stack = [], [(tree, None, None, 0, ())]
    while stack:
        node, up, field, pos, blocks = stack.pop()
        if isinstance(node, _KEPT):
            fields = list(ast.iter_fields(node))
            rows.append({"no": len(rows), "up": up, "field": field, "pos": pos, "type": type(node).__name__, "name": getattr(node, "name", None),
                         "line": getattr(node, "lineno", None), "blocks": [{"type": t, "name": n} for t, n in blocks],
                         "parts": {k: _texts(v) for k, v in fields if k != "body"}, "shapes": {k: type(v).__name__ for k, v in fields}})
            up = rows[-1]["no"]
            if isinstance(node, _BLOCKS):
                blocks = (*blocks, ("class" if isinstance(node, ast.ClassDef) else "function", node.name))
        below = [(child, up, k, n, blocks) for k, v in ast.iter_fields(node) for n, child in enumerate(v if isinstance(v, list) else [v]) if isinstance(child, ast.AST)]
        stack += reversed(below)
    return rows


# What opens a named block or is a call or an import in the other languages, and words that are not calls.
_COMMENT = r"(?P<skip>//[^\n]*|/\*.*?\*/|`[^`]*`)"
_TEXT = r"""(?P<text>"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*')"""
_CALLED = r"(?<![\w$.])(?P<call>[A-Za-z_$][\w$]*(?:\.[A-Za-z_$][\w$]*)?)\s*\("
MARKS = {
    "js": r"""(?P<import>import\s+(?:[^'"]+?\s+from\s+)?['"](?P<target>[^'"]+)['"])|(?P<class>(?:export\s+)?class\s+(?P<cname>[A-Za-z_$][\w$]*)[^{]*\{)"""
          r"""|(?P<function>(?:export\s+)?(?:async\s+)?function\s+(?P<fname>[A-Za-z_$][\w$]*)\s*\([^)]*\)[^{;]*\{)"""
          r"""|(?P<method>(?:(?:public|private|protected|async|static)\s+)*(?P<mname>[A-Za-z_$][\w$]*)\s*\([^)]*\)\s*(?::[^{;]+)?\{)""",
    "go": r"""(?P<block>import\s*\((?P<names>[^)]*)\))|(?P<import>import\s+(?:[.\w]+\s+)?"(?P<target>[^"]+)")|(?P<package>package\s+(?P<pname>[\w.]+))"""
          r"""|(?P<function>func\s+(?:\((?P<receiver>[^)]*)\)\s*)?(?P<fname>[A-Za-z_]\w*)\s*\([^)]*\)[^{\n]*\{)""",
    "java": r"""(?P<import>import\s+(?P<target>[\w.]+)\s*;)|(?P<package>package\s+(?P<pname>[\w.]+))|(?P<class>\bclass\s+(?P<cname>[A-Za-z_]\w*)[^{]*\{)"""
            r"""|(?P<method>(?:(?:public|private|protected|static|final|synchronized)\s+)*[\w<>\[\]]+\s+(?P<mname>[A-Za-z_]\w*)\s*\([^)]*\)[^{;]*\{)""",
}
NOT_CALLS = {"js": ("if", "for", "while", "switch", "catch", "return", "function", "constructor", "new"), "go": ("if", "for", "switch", "return", "func"),
             "java": ("if", "for", "while", "switch", "catch", "return", "new")}
NOT_METHODS = ("if", "for", "while", "switch", "catch", "function")


def _block_syntax(text: str, language: str) -> list[dict]:
    """Rows of a file in a language with braces, in one scan; comments and strings are stepped over."""
    rows, blocks = [], []
    add = lambda type_, name, at, **parts: rows.append({
        "no": len(rows), "type": type_, "name": name, "line": text.count("\n", 0, at) + 1, "blocks": [b for b in blocks if b["type"] != "plain"], "parts": parts})
    scan = re.compile("|".join([_COMMENT, MARKS[language], _TEXT, _CALLED, r"(?P<brace>[{}])"]), re.S)
    at = 0
    while m := scan.search(text, at):
        at, kind = m.end(), m.lastgroup
        kind = next(k for k in ("skip", "block", "import", "package", "class", "function", "method", "text", "call", "brace") if m.groupdict().get(k) is not None)
        inside_class = bool(blocks) and blocks[-1]["type"] == "class"
        if kind == "method" and not (inside_class and m["mname"] not in NOT_METHODS):
            # no declaration here: step over its first word and read on
            word = re.compile(r"[\w$]+\s*").match(text, m.start())
            called = re.compile(_CALLED).match(text, m.start())
            if called:
                add("call", called["call"], m.start())
            at = max(word.end() if word else m.start() + 1, called.end() if called else 0)
        elif kind == "block":
            for name in re.finditer(r'"([^"]+)"', m["names"]):
                add("import", name[1], m.start("names") + name.start())
        elif kind == "import":
            add("import", m["target"], m.start())
        elif kind == "package":
            add("package", m["pname"], m.start())
        elif kind in ("class", "function", "method"):
            name = m[{"class": "cname", "function": "fname", "method": "mname"}[kind]]
            # fixed rule: a Java method begins with the white space before it
            start = len(text[:m.start()].rstrip()) if language == "java" and kind == "method" else m.start()
            owner = (m.groupdict().get("receiver") or "").replace("*", " ").split()
            add(kind, name, start, receiver=owner[-1:])
            blocks.append({"type": kind, "name": ".".join([*owner[-1:], name])})
        elif kind == "call":
            add("call", m["call"], m.start())
        elif kind == "brace" and m["brace"] == "{":
            blocks.append({"type": "plain", "name": ""})
        elif kind == "brace" and blocks:
            blocks.pop()
    return rows


LANGUAGES = {".js": "js", ".jsx": "js", ".ts": "js", ".tsx": "js", ".go": "go", ".java": "java"}


#: Rows of a batch that leaves a task, and tasks for each core: a file's parsing costs far more than its move.
_BATCH_ROWS, _TASKS = 4096, 4


def syntax(files: DataFrame) -> DataFrame:
    """Raw rows of every source file; a Python file that does not parse gives one row of type Error."""
    schema = to_arrow_schema(StructType.fromDDL(SYNTAX))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            for repo, path, text in zip(*(c.to_pylist() for c in b.columns)):
                end = "." + path.rsplit(".", 1)[-1].lower()
                found = _python_syntax(text or "") if end == ".py" else _block_syntax(text or "", LANGUAGES[end])
                for row in found:
                    yield {"repo": repo, "path": path, **row, **{k: list(row[k].items()) for k in ("parts", "shapes") if k in row}}

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = rows(found)
        while some := list(itertools.islice(each, _BATCH_ROWS)):
            yield pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in some], schema.field(c).type) for c in schema.names], schema=schema)

    wanted = files.where(F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)).isin(".py", *LANGUAGES))
    dealt = wanted.select("repo", "path", "content").repartition(_TASKS * files.sparkSession.sparkContext.defaultParallelism, "repo", "path")
    return dealt.mapInArrow(batches, SYNTAX)


# --- facts ------------------------------------------------------------------------------------

FACT_SCHEMA = """repo string, path string, kind string, id string, name string, parent string, scope string, line int, module string, class_name string,
  bases array<string>, decorators array<string>, param_order array<string>, param_types map<string,string>, param_defaults map<string,string>,
  return_type string, target string, value string, call_name string, receiver string, method_name string, args array<string>,
  keyword_args map<string,string>, import_aliases map<string,string>, error string"""
_FIELDS = [c.strip().split(" ", 1) for c in re.split(r",(?![^<]*>)", FACT_SCHEMA.replace("\n", " "))]
_FIELDS = [(n, t.strip()) for n, t in _FIELDS]


def _facts(frame: DataFrame, kind: str, **columns: Column) -> DataFrame:
    """Facts of one kind; columns that are not given come from ``frame`` if it has them, else are null."""
    have = set(frame.columns)
    pick = lambda n, t: columns[n] if n in columns else F.lit(kind) if n == "kind" else F.col(n) if n in have else F.lit(None)
    return frame.select(*[pick(n, t).cast(t).alias(n) for n, t in _FIELDS])


def _part(name: str) -> Column:
    return F.coalesce(F.col("parts")[name], F.array().cast("array<string>"))


def _dotted(*parts: Column | str) -> Column:
    """Parts joined by dots, empty and null ones left out."""
    return F.array_join(F.filter(F.array(*[X.col(p) for p in parts]), lambda p: p.isNotNull() & (p != "")), ".")


def _module_of(path: str) -> Column:
    return F.replace(F.regexp_replace(F.regexp_replace(F.col(path), r"\.py$", ""), r"(^|/)__init__$", ""), F.lit("/"), F.lit("."))


def _pairs(texts: Column, cut: str) -> Column:
    """{text before ``cut``: text after it} of the texts that hold it."""
    held = F.filter(texts, lambda t: F.contains(t, F.lit(cut)) & ~F.startswith(t, F.lit("**")))
    return F.map_from_entries(F.transform(F.array_distinct(held), lambda t: F.struct(F.substring_index(t, cut, 1), F.substr(t, F.instr(t, F.lit(cut)) + len(cut)))))


def _typed(frame: DataFrame, names: str, aliases: DataFrame) -> DataFrame:
    """(repo, path, no, pos, name, full): each name of an array column by the last import of it above, else in its own module."""
    each = frame.select("repo", "path", "module", "no", F.posexplode(names).alias("pos", "name"))
    known = each.join(aliases, ["repo", "path"], "left").where(F.col("alias_no") < F.col("no")).where(F.col("alias") == F.col("name"))
    last = known.groupBy("repo", "path", "no", "pos").agg(F.max_by("target", "alias_no").alias("target"))
    return each.join(last, ["repo", "path", "no", "pos"], "left").select("repo", "path", "no", "pos", "name", F.coalesce("target", F.concat_ws(".", "module", "name")).alias("full"))


def _in_order(frame: DataFrame, out: str) -> DataFrame:
    return frame.groupBy("repo", "path", "no").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "full"))), lambda s: s["full"]).alias(out))


def extract_python(files: DataFrame) -> DataFrame:
    """Fact rows of every Python file; a file that does not parse gives one ERROR row."""
    key = ["repo", "path", "no"]
    names = lambda blocks: F.transform(blocks, lambda b: b["name"])
    classes = F.array_join(names(F.filter("blocks", lambda b: b["type"] == "class")), ".")
    functions = F.filter("blocks", lambda b: b["type"] == "function")
    inner = F.element_at("blocks", -1)
    rows = cut(syntax(files.where(F.lower("path").endswith(".py")))).withColumns({
        "module": _module_of("path"), "classes": classes, "method": F.try_element_at(names(functions), F.lit(-1)),
        "in_function": F.when(F.size("blocks") > 0, inner["type"] == "function").otherwise(False)})
    rows = rows.withColumns({
        "scope": F.when(F.col("in_function"), _dotted("module", "classes", inner["name"])).otherwise(_dotted("module", "classes")),
        "class_name": F.nullif("classes", F.lit(""))})
    owner = F.concat(F.when(F.col("method").isNotNull(), "method:").otherwise("module:"), "scope")
    home = F.when(F.col("class_name").isNotNull(), F.concat(F.lit("class:"), _dotted("module", "classes"))).otherwise(F.concat(F.lit("module:"), "module"))
    of = lambda *types: rows.where(F.col("type").isin(*types))

    # imports: a relative one counts levels up from the package that holds the module
    level = F.coalesce(F.get(_part("level"), F.lit(0)).cast("int"), F.lit(0))
    package = F.split("module", r"\.")
    depth = F.size(package) - F.when(F.col("path").endswith("__init__.py"), 0).otherwise(1) - level + 1
    base = F.when(level > 0, F.array_join(F.slice(package, F.lit(1), F.greatest(depth, F.lit(0))), ".")).otherwise("")
    source = _dotted(base, F.get(_part("module"), F.lit(0)))
    imports = of("Import", "ImportFrom").where((F.col("type") == "Import") | (F.size(_part("module")) > 0)).withColumn("source", F.when(F.col("type") == "ImportFrom", source))
    each = imports.withColumn("n", F.explode(_part("names"))).withColumns({"what": F.substring_index("n", " as ", 1), "alias": F.substring_index("n", " as ", -1)})
    each = each.withColumn("target", F.when(F.col("type") == "Import", F.col("what")).otherwise(F.concat_ws(".", "source", "what")))
    aliases = each.select("repo", "path", F.col("no").alias("alias_no"), "alias", "target")
    whole = each.where("type = 'Import'").select("repo", "path", "line", "module", "scope", "class_name", F.col("target").alias("source"), F.create_map("alias", "target").alias("import_aliases"))
    members = each.where("type = 'ImportFrom'").groupBy("repo", "path", "no", "line", "module", "scope", "class_name", "source").agg(
        F.map_from_entries(F.array_distinct(F.collect_list(F.struct("alias", "target")))).alias("import_aliases")).drop("no")
    imported = _facts(whole.unionByName(members), "IMPORT", id=F.concat(F.lit("module:"), "source"), name=F.col("source"), parent=F.concat(F.lit("module:"), "module"))

    # classes and functions
    cls = of("ClassDef").withColumns({"full": _dotted("classes", "name"), "own": _dotted("module", "classes", "name"), "base_names": _part("bases")})
    cls = cls.join(_in_order(_typed(cls, "base_names", aliases), "bases"), key, "left")
    classed = _facts(cls, "CLASS", id=F.concat(F.lit("class:"), "own"), parent=home, scope=F.col("own"), class_name=F.col("full"), bases=F.coalesce("bases", F.array().cast("array<string>")))
    fun = of("FunctionDef", "AsyncFunctionDef").withColumn("own", _dotted("module", "classes", "name"))
    lists = of("arguments").select("repo", "path", F.col("no").alias("list_no"), F.col("up").alias("no"), _part("defaults").alias("defaults"))
    params = of("arg").where("field = 'args'").select("repo", "path", F.col("up").alias("list_no"), F.col("no").alias("arg_no"), "pos", F.get(_part("arg"), F.lit(0)).alias("param"), F.get(_part("annotation"), F.lit(0)).alias("noted"), "module")
    params = params.join(lists, ["repo", "path", "list_no"])
    noted = _typed(params.where("noted IS NOT NULL").select("repo", "path", "module", F.col("arg_no").alias("no"), F.array("noted").alias("one")), "one", aliases)
    typed = params.select("repo", "path", "no", "arg_no", "param", F.col("pos").alias("at")).join(
        noted.select("repo", "path", F.col("no").alias("arg_no"), "full"), ["repo", "path", "arg_no"])
    sorted_ = lambda c: F.array_sort(F.collect_list(c))
    heads = params.groupBy(*key).agg(sorted_(F.struct("pos", "param")).alias("all"), F.first("defaults").alias("defaults"))
    late = F.slice("all", F.size("all") - F.size("defaults") + 1, F.size("defaults"))
    heads = heads.select(*key, F.filter(F.transform("all", lambda s: s["param"]), lambda p: p != "self").alias("param_order"),
                         F.map_from_arrays(F.transform(late, lambda s: s["param"]), F.col("defaults")).alias("param_defaults"))
    kinds = typed.where("param <> 'self'").groupBy(*key).agg(F.transform(sorted_(F.struct("at", "param", "full")), lambda s: F.struct(s["param"], s["full"])).alias("e")).select(
        *key, F.map_from_entries("e").alias("param_types"))
    gives = _typed(fun.withColumn("returned", _part("returns")), "returned", aliases).select(*key, F.col("full").alias("return_type"))
    none = lambda t: F.create_map().cast(t)
    fun = fun.join(heads, key, "left").join(kinds, key, "left").join(gives, key, "left")
    made = _facts(fun, "METHOD", id=F.concat(F.lit("method:"), "own"), parent=home, scope=F.col("own"), decorators=F.transform(_part("decorator_list"), lambda d: F.concat(F.lit("@"), d)),
                  param_order=F.coalesce("param_order", F.array().cast("array<string>")), param_types=F.coalesce("param_types", none("map<string,string>")),
                  param_defaults=F.coalesce("param_defaults", none("map<string,string>")))

    # calls and assignments
    func = F.get(_part("func"), F.lit(0))
    attribute = F.col("shapes")["func"] == "Attribute"
    calls = of("Call").withColumns({"call_name": func, "args": _part("args"), "keyword_args": _pairs(_part("keywords"), "=")})
    called = _facts(calls, "CALL_EXPR", id=F.concat(F.lit("call:"), "scope", F.lit(":"), "line", F.lit(":"), "call_name"), name=F.concat("call_name", F.lit("(...)")), parent=owner,
                    receiver=F.when(attribute, F.regexp_replace("call_name", r"\.\w+$", "")), method_name=F.when(attribute, F.regexp_extract("call_name", r"(\w+)$", 1)))
    built = calls.where("field = 'value'").select("repo", "path", F.col("up").alias("no"), "call_name", "args", "keyword_args")
    sets = of("Assign").withColumns({"value": F.get(_part("value"), F.lit(0)), "target": F.explode(_part("targets"))}).join(built, key, "left")
    assigned = _facts(sets, "ASSIGNMENT", id=F.concat(F.lit("assignment:"), "scope", F.lit(":"), "line", F.lit(":"), "target"), name=F.concat("target", F.lit(" = "), "value"), parent=owner)
    failed = _facts(of("Error"), "ERROR", name=F.lit(None), error=F.col("name"), scope=F.lit(None), class_name=F.lit(None))
    return imported.unionByName(classed).unionByName(made).unionByName(assigned).unionByName(called).unionByName(failed)


def extract_patterns(files: DataFrame) -> DataFrame:
    """Fact rows of JavaScript, TypeScript, Go and Java files.

    A class or function owns what stands between its braces; calls count inside methods and Go functions.
    """
    rows = cut(syntax(files.where(~F.lower("path").endswith(".py"))))
    ending = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    package = rows.where("type = 'package'").groupBy("repo", "path").agg(F.min_by("name", "no").alias("package"))
    rows = rows.join(package, ["repo", "path"], "left").withColumn("language", X.lookup(ending, LANGUAGES))
    go, java = F.col("language") == "go", F.col("language") == "java"
    rows = rows.withColumn("module", F.when(go, F.coalesce("package", F.lit("main"))).otherwise(F.regexp_replace("path", r"\.[^./]+$", "")))
    classes = F.filter("blocks", lambda b: b["type"] == "class")
    prefix = F.when(go, F.col("module")).when(java, F.col("package"))
    innermost = F.try_element_at(F.transform(classes, lambda b: b["name"]), F.lit(-1))
    holder = _dotted(prefix, innermost)
    rows = rows.withColumns({"home": F.concat(F.lit("module:"), "module"), "holder": holder, "receiver_type": F.get(_part("receiver"), F.lit(0)), "nested": F.size(classes) > 0})
    around = F.filter("blocks", lambda b: b["type"].isin("method", "function"))
    within = F.try_element_at(F.transform(around, lambda b: b["name"]), F.lit(-1))
    imports = _facts(rows.where("type = 'import'"), "IMPORT", id=F.concat(F.lit("module:"), "name"), parent=F.col("home"), scope=F.concat(F.lit("module:"), "name"))
    own = _dotted(prefix, "name")
    classed = _facts(rows.where("type = 'class'"), "CLASS", id=own, parent=F.col("home"), scope=own)
    method = _dotted("holder", "name")
    members = _facts(rows.where("type = 'method'"), "METHOD", id=method, parent=F.col("holder"), scope=method)
    free = _dotted(F.when(go, F.col("module")), "receiver_type", "name")
    functions = _facts(rows.where("type = 'function' AND NOT nested"), "METHOD", id=free, parent=F.col("home"), scope=free, class_name=F.col("receiver_type"))
    words = F.array_contains(F.create_map(*[x for k, v in NOT_CALLS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])[F.col("language")], F.col("name"))
    scope = F.when(go, _dotted("module", within)).otherwise(_dotted("holder", within))
    inside = rows.where("type = 'call'").withColumns({"within": within, "scope": scope}).where(F.col("within").isNotNull() & (go | F.col("nested")))
    inside = inside.where(~words & (F.col("name") != F.substring_index("within", ".", -1)))
    calls = _facts(inside, "CALL_EXPR", id=F.concat(F.lit("call:"), "scope", F.lit(":"), "line", F.lit(":"), "name"), parent=F.col("scope"), call_name=F.col("name"))
    return imports.unionByName(classed).unionByName(members).unionByName(functions).unionByName(calls)


DECLARED = ("CLASS", "METHOD")


def fact_nodes(facts: DataFrame) -> DataFrame:
    """(repo, id, kind, name, file, line): files, modules and facts, each id once per repository."""
    rows = facts.where(F.col("kind").isin("CLASS", "METHOD", "ASSIGNMENT", "CALL_EXPR")).select("repo", "id", "kind", "name", F.col("path").alias("file"), "line")
    places = facts.select("repo", "path", "module").distinct()
    files = places.select("repo", F.concat(F.lit("file:"), "path").alias("id"), F.lit("FILE").alias("kind"), F.col("path").alias("name"), F.col("path").alias("file"), F.lit(1).alias("line"))
    modules = places.select("repo", F.concat(F.lit("module:"), "module").alias("id"), F.lit("MODULE").alias("kind"), F.col("module").alias("name"), F.col("path").alias("file"), F.lit(1).alias("line"))
    return rows.unionByName(files).unionByName(modules).groupBy("repo", "id").agg(F.min(F.struct("file", "line", "kind", "name")).alias("n")).select(
        "repo", "id", "n.kind", "n.name", "n.file", "n.line")


def fact_edges(facts: DataFrame, confidence: float = 1.0) -> DataFrame:
    """CONTAINS, DECLARES and IMPORTS edges with the line that proves them."""
    kind = X.labels_when([(F.col("kind").isin(*DECLARED), "DECLARES"), (F.col("kind") == "IMPORT", "IMPORTS")], "CONTAINS")
    rows = facts.where("kind <> 'ERROR'").select("repo", F.col("parent").alias("from_id"), F.col("id").alias("to_id"), kind.alias("kind"), F.col("path").alias("file"), "line")
    places = facts.select("repo", F.concat(F.lit("file:"), "path").alias("from_id"), F.concat(F.lit("module:"), "module").alias("to_id"), F.lit("CONTAINS").alias("kind"),
                          F.col("path").alias("file"), F.lit(1).alias("line")).distinct()
    return rows.unionByName(places).groupBy("repo", "from_id", "to_id", "kind").agg(F.min("file").alias("file"), F.min("line").alias("line")).withColumns(
        {"source": F.lit("EXTRACTED"), "confidence": F.lit(confidence)})


def graph_rows(facts: DataFrame, confidence: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """(nodes, edge observations) of many repositories in one graph, as dedupe_edges, impact_query and review read them.

    Ids carry their repository, ``<repo>::<id>``, so equal names of two repositories never meet.
    """
    own = lambda c: F.concat("repo", F.lit("::"), c)
    facts = cut(facts)
    nodes = fact_nodes(facts).select("repo", own("id").alias("id"), "kind", "name", "file", "line", F.lit(None).cast("double").alias("criticality"))
    edges = fact_edges(facts, confidence).withColumns({"from_id": own("from_id"), "to_id": own("to_id")})
    edges = edges.withColumns({
        "id": F.sha2(F.concat_ws("\u0001", "from_id", "to_id", "kind"), 256), "rule_id": F.lit(""), "status": F.lit(None).cast("string"),
        "warnings": F.lit(None).cast("array<string>"), "ev_text": F.concat(F.lower("kind"), F.lit(" in source")), "ev_file": F.col("file"), "ev_line": F.col("line")})
    return nodes, edges.withColumn("ord", X.canonical_order())


def propagate_ctor_types(facts: DataFrame) -> DataFrame:
    """(repo, class_id, param, type): constructor parameter types, known on the class."""
    init = facts.where("kind = 'METHOD' AND name = '__init__' AND class_name IS NOT NULL")
    return init.select("repo", F.concat(F.lit("class:"), "module", F.lit("."), "class_name").alias("class_id"), F.explode("param_types").alias("param", "type"))


def extraction_status(diagnostics: DataFrame) -> DataFrame:
    """Roll file statuses up per repository. diagnostics: (repo, status)."""
    has = lambda s: F.coalesce(F.bool_or(F.col("status") == s), F.lit(False))
    out = diagnostics.groupBy("repo").agg(F.count(F.lit(1)).alias("files"), has("native").alias("native"), has("fallback").alias("fallback"))
    return out.withColumn("status", X.labels_when([(F.col("fallback") & F.col("native"), "partial_native"), (F.col("native"), "native"),
                                                   (F.col("fallback"), "partial_local_fallback")], "native"))


def extract_typed_fields(files: DataFrame) -> DataFrame:
    """(repo, path, owner, field, type) of Go struct fields and Java fields."""
    go = files.where(F.col("path").endswith(".go"))
    structs = go.select("repo", "path", F.explode(F.regexp_extract_all("content", F.lit(r"(type\s+\w+\s+struct\s*\{[^}]*\})"), F.lit(1))).alias("b"))
    field = r"(?m)^\s*(\w+\s+\*?[A-Za-z_]\w*)"
    inner = F.regexp_replace("b", r"^type\s+\w+\s+struct\s*\{", "")
    go_fields = structs.select("repo", "path", F.regexp_extract("b", r"^type\s+(\w+)", 1).alias("owner"), F.explode(F.regexp_extract_all(inner, F.lit(field), F.lit(1))).alias("f"))
    go_fields = go_fields.select("repo", "path", "owner", F.regexp_extract("f", r"^(\w+)", 1).alias("field"), F.regexp_extract("f", r"\s+\*?(\w+)$", 1).alias("type"))
    java = files.where(F.col("path").endswith(".java")).withColumn("owner", F.regexp_extract("content", r"\bclass\s+(\w+)", 1)).where("owner <> ''")
    pattern = r"\b(?:private|protected|public|final|static|volatile|\s)+\s*([A-Z_]\w*(?:<[^;>]+>)?\s+\w+)\s*(?:=\s*[^;]+)?;"
    java_fields = java.select("repo", "path", "owner", F.explode(F.regexp_extract_all("content", F.lit(pattern), F.lit(1))).alias("f")).select(
        "repo", "path", "owner", F.regexp_extract("f", r"(\w+)$", 1).alias("field"), F.regexp_extract("f", r"^(\w+)", 1).alias("type"))
    return go_fields.unionByName(java_fields)
