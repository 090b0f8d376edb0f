"""The type fixpoint against a plain one that looks at every cell in every round."""
import os
import random

from pyspark.sql import functions as F

from tremor.operators import symbols as S
from tremor.operators import types as T

ASSIGN = "id string, scope string, target string, value string, call_name string, args array<string>, keyword_args map<string,string>, ord int"
PARAM = "scope string, pos int, param string, annotation string"


def tables(spark, classes, methods=(), bases=(), aliases=(), modules=("m",)):
    names = [(c, c.split(".")[-1]) for c in classes]
    funcs = spark.createDataFrame([], "full string, simple string, return_type string")
    return {"modules": spark.createDataFrame([(m,) for m in modules], "module string"), "classes": spark.createDataFrame(names, "full string, simple string"),
            "methods": spark.createDataFrame([(m,) for m in methods], "full string"), "functions": funcs,
            "bases": spark.createDataFrame(list(bases), "full string, pos int, base string"), "aliases": spark.createDataFrame(list(aliases), "module string, alias string, target string"),
            "imports": spark.createDataFrame([], "module string, imported string")}


def slow(assigns, params, classes):
    """{cell: types}; classes are named in full, so a name is its own class."""
    order, cells = {}, {}
    for scope, pos, name, _ in params:
        order[scope, pos] = name
    for scope, _, name, note in params:
        if note:
            cells.setdefault(("var", scope, name), set()).add(note)
            cells.setdefault(("param", scope, name), set()).add(note)
    built = {}
    for _, scope, target, _, call, *_ in assigns:
        if call in classes:
            built.setdefault(("var", scope, target), set()).add(call)
    cells.update(built)

    def step(at, rest):
        if not rest:
            return {at}
        for key in (("field", at, "self." + rest[0]), ("var", at + ".__init__", "self." + rest[0]), ("var", at, rest[0])):
            if key in cells:
                return set().union(*(step(c, rest[1:]) for c in cells[key]))
        return set()

    def types(scope, receiver, local):
        cls = scope.rsplit(".", 1)[0] if "." in scope else None
        if receiver == "self":
            return {cls} if cls else set()
        field = receiver.startswith("self.") and cls
        keys = ([("var", scope, receiver)] if local else []) + ([("field", cls, receiver), ("var", cls + ".__init__", receiver)] if field else [])
        for key in keys + [("var", scope, receiver), ("var", "m", receiver)]:
            if key in cells:
                return cells[key]
        base, *rest = receiver.split(".")
        if not rest:
            return set()
        if base == "self":
            return step(cls, rest) if cls else set()
        for key in (("var", scope, base), ("var", "m", base)):
            if key in cells:
                return set().union(*(step(c, rest) for c in cells[key]))
        return set()

    while True:
        new = {}
        for _, scope, target, value, call, args, words, _ in assigns:
            if call in T.WRAPPERS and args:
                call, args = args[0], args[1:]
            if call in classes:
                bound = dict(words or {})
                bound.update({order[call + ".__init__", k]: a for k, a in enumerate(args or []) if (call + ".__init__", k) in order})
                for name, arg in bound.items():
                    key, found = ("param", call + ".__init__", name), types(scope, arg, True)
                    if found and key not in cells:
                        new.setdefault(key, set()).update(found)
            if target.startswith("self.") and "." in scope and value:
                cls = scope.rsplit(".", 1)[0]
                for source in [("param", scope, value)] + ([("field", cls, value)] if value.startswith("self.") else []):
                    if source in cells and ("field", cls, target) not in cells:
                        new.setdefault(("field", cls, target), set()).update(cells[source])
        if not new:
            return cells, types
        cells.update(new)


def fast(spark, assigns, params, t):
    out = {}
    for r in T.type_cells(spark.createDataFrame(assigns, ASSIGN), spark.createDataFrame(params, PARAM), t).collect():
        out.setdefault((r["kind"], r["owner"], r["name"]), set()).add(r["type"])
    return out


def test_injected_objects_cycles_and_ambiguous_cells(spark):
    classes = ["m.Repo", "m.Other", "m.Service", "m.App", "m.Loop"]
    params = [("m.Service.__init__", 0, "repo", None), ("m.Service.__init__", 1, "extra", "m.Other"), ("m.App.__init__", 0, "service", None), ("m.Loop.__init__", 0, "x", None)]
    a = lambda i, scope, target, value=None, call=None, args=(), words=None: (f"a{i}", scope, target, value, call, list(args), words, i)
    assigns = [a(1, "m.main", "r", None, "m.Repo"), a(2, "m.main", "s", None, "m.Service", ["r"]), a(3, "m.main", "app", None, "m.App", [], {"service": "s"}),
               a(4, "m.Service.__init__", "self.repo", "repo"), a(5, "m.Service.__init__", "self.again", "self.repo"), a(6, "m.App.__init__", "self.service", "service"),
               a(7, "m.other", "r2", None, "providers.Factory", ["m.Service", "q"]), a(8, "m.other", "q", None, "m.Other"),
               a(9, "m.Loop.__init__", "self.a", "self.b"), a(10, "m.Loop.__init__", "self.b", "self.a"), a(11, "m.App.run", "l", None, "m.Loop", ["self.service.repo"])]
    t = tables(spark, classes, ["m.Repo.save", "m.Base.close", "m.helpers.f"], [("m.Service", 0, "m.Base")], [("m", "helpers", "m.helpers")])
    cells, _ = slow(assigns, params, set(classes))
    assert fast(spark, assigns, params, t) == cells
    assert cells["param", "m.Service.__init__", "repo"] == {"m.Repo", "m.Other"} and cells["param", "m.Loop.__init__", "x"] == {"m.Repo", "m.Other"}
    calls = spark.createDataFrame([("c1", "m.App.run", "self.service", "close"), ("c2", "m.App.run", "self.service.repo", "save"), ("c3", "m.main", "helpers", "f"), ("c4", "m.App.run", "self", "go"),
                                   ("c5", "m.Service.stop", "super()", "close"), ("c6", "m.main", "nothing.at", "all"), ("c7", "m.main", "r", "save")], "id string, scope string, receiver string, method_name string")
    _, edges = T.resolve_types(spark.createDataFrame(assigns, ASSIGN), spark.createDataFrame(params, PARAM), calls, t)
    got = {(r["from_id"], r["to_id"]): r["confidence"] for r in edges.where("kind = 'CALLS'").collect()}
    assert got == {("m.App.run", "m.Base.close"): 0.85, ("m.App.run", "m.Repo.save"): 0.55, ("m.App.run", "m.Other.save"): 0.55, ("m.main", "m.helpers.f"): 1.0,
                   ("m.App.run", "m.App.go"): 0.9, ("m.Service.stop", "m.Base.close"): 0.85, ("m.main", "m.Repo.save"): 0.85}
    binds = {(r["from_id"], r["to_id"]) for r in edges.where("kind = 'PARAM_BINDS_TO'").collect()}
    assert binds == {("a2", "class:m.Repo"), ("a7", "class:m.Other"), ("a3", "class:m.Service"), ("a11", "class:m.Repo"), ("a11", "class:m.Other")}


def test_chain_of_fields(spark):
    n = 100 if os.environ.get("TREMOR_ALL") else 6
    classes, params = ["m.Deep", "m.Leaf"], [("m.Deep.__init__", 0, "x", "m.Leaf")]
    assigns = [("a0", "m.Deep.__init__", "self.f0", "x", None, [], None, 0)] + [(f"a{k}", "m.Deep.__init__", f"self.f{k}", f"self.f{k - 1}", None, [], None, k) for k in range(1, n)]
    got = fast(spark, assigns, params, tables(spark, classes))
    assert got == slow(assigns, params, set(classes))[0] and got["field", "m.Deep", f"self.f{n - 1}"] == {"m.Leaf"}


def test_random_programs(spark):
    rng = random.Random(5)
    classes = [f"m.C{k}" for k in range(5)]
    names = ["x", "y"]
    for _ in range(3 if os.environ.get("TREMOR_ALL") else 1):
        params = [(f"{c}.__init__", k, n, rng.choice([None, None, *classes])) for c in classes for k, n in enumerate(names)]
        scopes = [f"{c}.__init__" for c in classes] + [f"{c}.go" for c in classes] + ["m.main"]
        value = lambda: rng.choice(["x", "y", "v", "w", "self.a", "self.b", "self.a.b", "v.a", "self", "w.b.a"])
        assigns = []
        for k in range(40):
            scope, build = rng.choice(scopes), rng.random() < 0.5
            target = rng.choice(["v", "w", "self.a", "self.b"])
            assigns.append((f"a{k}", scope, target, None if build else value(), rng.choice(classes) if build else None, [value() for _ in range(rng.randint(0, 2))] if build else [],
                            {"y": value()} if build and rng.random() < 0.5 else None, k))
        t = tables(spark, classes)
        cells, types = slow(assigns, params, set(classes))
        assert fast(spark, assigns, params, t) == cells
        refs = [(s, r) for s in scopes for r in ("self", "self.a", "self.a.b", "v", "v.a.b", "w.b", "none.a")]
        flat = spark.createDataFrame([(*key, c, None) for key, found in cells.items() for c in found], "kind string, owner string, name string, type string, via string")
        got = {}
        for r in T.receiver_type(spark.createDataFrame(refs, "scope string, receiver string"), flat, t["modules"])[0].collect():
            got.setdefault((r["scope"], r["receiver"]), set()).add(r["type"])
        assert got == {(s, r): types(s, r, False) for s, r in refs if types(s, r, False)}


def test_nothing_gives_nothing(spark):
    cells, edges = T.resolve_types(spark.createDataFrame([], ASSIGN), spark.createDataFrame([], PARAM), spark.createDataFrame([], "id string, scope string, receiver string, method_name string"), tables(spark, []))
    assert cells.collect() == [] and edges.collect() == []
