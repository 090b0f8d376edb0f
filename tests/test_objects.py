"""Object bindings, aliases, receiver chains and nested calls against plain Python over random facts."""
import os
import random

from pyspark.sql import functions as F

from tremor.operators import objects as O

#: Steps of the longest chain; each is a round.
LONG = 100 if os.environ.get("TREMOR_ALL") else 6
ALIAS = "place string, alias array<string>, target array<string>, confidence double, ord int"
CHAIN = "scope string, owner string, path array<string>"
BOUND = "owner string, path array<string>, type string, confidence double"


def slow_alias(scope, owner, path, rules, limit=300):
    """(expanded, confidence, hops, rejected); a chain of more than ``limit`` steps grows for ever."""
    at, sure, hops, seen = tuple(path), 1.0, 0, set()
    while at not in seen:
        seen.add(at)
        place = f"class {owner}" if at and at[0] == "self" and owner is not None else f"scope {scope}"
        for n in range(min(len(at), 3), 0, -1):  # no alias here is longer
            if (place, at[:n]) in rules:
                target, c = rules[place, at[:n]]
                at, sure, hops = target + at[n:], sure * c, hops + 1
                break
        else:
            return at, sure, hops, False
        if hops > limit:
            return None, None, None, True
    return at, sure * 0.2, hops, True


def slow_walk(owner, path, bound):
    """(types, confidence) along the longest bound paths, or None."""
    types, sure, rest = {owner}, 1.0, tuple(path)
    while rest:
        if rest[0].startswith("["):
            return None
        if len(rest) > 1 and rest[1].startswith("["):
            lengths = [2]
        else:
            run = next((i for i, p in enumerate(rest) if p.startswith("[")), len(rest))
            lengths = range(run, 0, -1)
        for n in lengths:
            hits = [h for t in types for h in bound.get((t, rest[:n]), [])]
            if hits:
                types, sure, rest = {t for t, _ in hits}, min([sure] + [c for _, c in hits]), rest[n:]
                break
        else:
            return None
    return types, sure


def test_paths_of_expressions(spark):
    texts = ["self.repos['a'].find()", 'x["b c"].y', "self . a.b", "p[ i+1 ].q", "", None, "a[]", "make()", "9.a"]
    want = [["self", "repos", "[a", "find"], ["x", "[b c", "y"], ["self", "a", "b"], ["p", "[i+1", "q"], [], [], ["a", "[<dynamic>"], ["make"], ["a"]]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", O.path_parts("t").alias("p"))
    assert [r["p"] for r in sorted(df.collect())] == want


def test_alias_expansion(spark):
    rng = random.Random(7)
    names = ["self", "a", "b", "c", "[k"]
    rows = [(f"{kind} {i}", rng.choices(names, k=rng.choice((1, 1, 2, 3))), rng.choices(names, k=rng.choice((1, 1, 2, 2, 3))), rng.choice((0.5, 0.9)), n)
            for i in range(40) for kind in ("scope", "class") for n in range(6)]
    rows += [("scope chain", [f"n{i}"], [f"n{i + 1}"], 0.99, i) for i in range(LONG)]
    rows += [("scope ring", ["a"], ["b"], 0.5, 0), ("scope ring", ["b"], ["a"], 0.5, 0), ("scope up", ["a"], ["a", "b"], 0.5, 0),
             ("scope two", ["a"], ["x"], 0.9, 1), ("scope two", ["a"], ["y"], 0.9, 0), ("scope two", ["a", "b"], ["z"], 0.8, 2)]
    chains = [(str(i), rng.choice((str(i), None)), rng.choices(names, k=rng.randint(1, 5))) for i in range(40) for _ in range(12)]
    chains += [("chain", None, ["n0", "t"]), ("ring", None, ["a", "t"]), ("up", "O", ["a"]), ("two", None, ["a"]), ("two", None, ["a", "b", "c"]), ("none", None, ["a"]), ("none", None, [])]
    rules = {}
    for place, alias, target, c, n in sorted(rows, key=lambda r: r[4]):
        rules.setdefault((place, tuple(alias)), (tuple(target), c))
    out = O.expand_aliases(spark.createDataFrame(chains + chains[:5], CHAIN), spark.createDataFrame(rows, ALIAS)).collect()
    assert len(out) == len({(s, o, tuple(p)) for s, o, p in chains})
    endless = 0
    for r in out:
        at, sure, hops, bad = slow_alias(r["scope"], r["owner"], r["path"], rules)
        assert r["rejected"] == bad, r
        endless += at is None
        if at is not None:
            assert (tuple(r["expanded"]), r["hops"]) == (at, hops) and abs(r["confidence"] - sure) < 1e-12
    assert endless > 20 and sum(r["rejected"] for r in out) > endless + 20


def test_chains_to_types(spark):
    rng = random.Random(11)
    types, names = [f"T{i}" for i in range(6)], ["a", "b", "[k", "[m"]
    shapes = [1, 1, 2, 3]
    bound = set()
    for t in types:
        for _ in range(20):
            p = rng.choices(names[:2], k=rng.choice(shapes))
            if rng.random() < 0.4:
                p = [p[0], rng.choice(names[2:])]
            bound.add((t, tuple(p), rng.choice(types), rng.choice((0.6, 0.8, 0.9))))
    bound |= {(f"L{i}", ("next",), f"L{i + 1}", 0.9) for i in range(LONG)}
    table = {}
    for o, p, t, c in bound:
        table.setdefault((o, p), []).append((t, c))
    gives = [(["a", "b"], "P1", 0.7), (["a", "b"], "P2", 0.6), (["self", "a", "a"], "P3", 0.9)]
    params = [("T1", ["p"], "T2", 0.95), ("T1", ["p"], "T3", 0.4)]
    b = {"paths": spark.createDataFrame([(o, list(p), t, c) for o, p, t, c in bound], BOUND), "params": spark.createDataFrame(params, BOUND),
         "providers": spark.createDataFrame(gives, "path array<string>, type string, confidence double"), "aliases": spark.createDataFrame([("class T0", ["self", "b", "b"], ["self", "a"], 0.5, 0)], ALIAS)}
    chains = [("s", rng.choice(types + [None]), ["self"] + rng.choices(names, weights=[4, 4, 2, 1], k=rng.randint(0, 4))) for _ in range(250)]
    chains += [("s", "T1", ["p"]), ("s", "T1", ["p", "a"]), ("s", "T0", ["a", "b"]), ("s", "T0", ["zz"]), ("s", "L0", ["self"] + ["next"] * LONG)]
    rules = {("class T0", ("self", "b", "b")): (("self", "a"), 0.5)}
    out = O.resolve_chain(spark.createDataFrame(chains, CHAIN), b).collect()
    assert len(out) == len({(o, tuple(p)) for _, o, p in chains})
    found = 0
    for r in out:
        at, sure, _, bad = slow_alias(r["scope"], r["owner"], r["path"], rules)
        hits = [(t, c) for p, t, c in gives if tuple(p) == at]
        if bad:
            want = None
        elif hits:
            want = {t for t, _ in hits}, min(c for _, c in hits)
        elif r["owner"] is None:
            want = None
        elif at[0] == "self":
            want = slow_walk(r["owner"], at[1:], table)
        else:
            hits = [(t, c) for o, p, t, c in params if o == r["owner"] and tuple(p) == at]
            want = ({t for t, _ in hits}, min(c for _, c in hits)) if hits else None
        assert (None if r["types"] is None else set(r["types"])) == (want and want[0]), r
        if want:
            found += 1
            assert abs(r["confidence"] - sure * want[1]) < 1e-12
    assert found > 60


def facts(spark, **rows):
    kinds = {"params": "class string, param string, type string, confidence double", "fields": "owner string, field string, type string, confidence double, ord int",
             "assignments": "scope string, target string, value string, confidence double, ord int",
             "entries": "scope string, target string, key string, value string, type string, confidence double, ord int",
             "providers": "provider string, type string, confidence double, ord int", "returns": "scope string, type string, confidence double, ord int",
             "aliases": "scope string, alias string, target string, confidence double, ord int"}
    return {k: spark.createDataFrame(rows.get(k, []), s) for k, s in kinds.items()}


def test_bindings_and_calls(spark):
    f = facts(
        spark, params=[("m.A", "repo", "m.Repo", None), ("m.A", "uow", "m.Uow", 0.9), ("m.A", None, "x", None)],
        fields=[("m.Uow", "orders", "m.Orders", None, 0), ("m.A", "deep.orders", "m.Orders", 2.0, 0)],
        assignments=[("m.A.__init__", "self.repo", "repo", None, 0), ("m.A.__init__", "self.repo", "repo", 0.3, 1), ("m.A.__init__", "self.short", "self.repo", None, 2),
                     ("m.A.go", "local", "self.uow.orders", None, 3), ("m.A.go", "odd", "make(x)", None, 4), ("m.A.go", "self.uow", "uow", None, 5), (None, "self.q", "repo", None, 6)],
        entries=[("m.A.__init__", "self.by", "r", "repo", None, None, 0), ("m.A.__init__", "self.by", "o", "uow.orders", None, None, 0), ("m.A.__init__", "self.by['t']", None, None, "m.Told", None, 1),
                 ("m.A.__init__", "self.by['u']", None, "uow.orders", None, None, 2), ("m.A.__init__", "self.by", "x", "uow.none", None, None, 0)],
        providers=[("box.repo", "m.Repo", None, 0), ("box.repo", "m.Other", 0.5, 1)], returns=[("make", "m.Orders", None, 0)], aliases=[("m.A.go", "s", "self.short", None, 0)])
    classes = spark.createDataFrame([(c,) for c in ("m.A", "m.Repo", "m.Uow", "m.Orders", "m.Told", "m.Other")], "class string")
    b = O.object_bindings(f, classes)
    paths = {(r["owner"], ".".join(r["path"]), r["type"]): r["confidence"] for r in b["paths"].collect()}
    assert paths == {("m.Uow", "orders", "m.Orders"): 0.9, ("m.A", "deep.orders", "m.Orders"): 1.0, ("m.A", "repo", "m.Repo"): 0.95, ("m.A", "uow", "m.Uow"): 0.9,
                     ("m.A", "by.[r", "m.Repo"): 0.8, ("m.A", "by.[o", "m.Orders"): 0.8, ("m.A", "by.[t", "m.Told"): 0.8}
    assert {(r["place"], ".".join(r["alias"]), ".".join(r["target"]), r["confidence"]) for r in b["aliases"].collect()} == {
        ("class m.A", "self.short", "self.repo", 0.85), ("scope m.A.go", "local", "self.uow.orders", 0.85), ("scope m.A.go", "s", "self.short", 0.88)}
    methods = spark.createDataFrame([("m.Repo", "find"), ("m.Orders", "find"), ("m.Other", "find"), ("m.Told", "go"), ("m.A", "go")], "class string, method string")
    calls = [("1", "m.A.go", "self.repo", "find"), ("2", "m.A.go", "s", "find"), ("3", "m.A.go", "local", "find"), ("4", "m.A.go", "self.by['o']", "find"), ("5", "m.A.go", "box.repo", "find"),
             ("6", "m.A.go", "make()", "find"), ("7", "m.A.go", "self.nothing", "find"), ("8", "m.A.go", "self.by['t']", "find"), ("9", "m.A.go", "self.deep.orders", "find"), ("10", "m.A.go", "", "find"), ("11", None, "a", "b")]
    edges, lost = O.nested_calls(spark.createDataFrame(calls, "id string, scope string, receiver string, method string"), b, methods, classes)
    got = {(r["id"], r["to_id"]): (round(r["confidence"], 6), r["status"]) for r in edges.collect()}
    assert got == {("1", "m.Repo.find"): (0.9, "confirmed"), ("2", "m.Repo.find"): (round(0.88 * 0.85 * 0.95, 6), "likely"), ("3", "m.Orders.find"): (0.765, "likely"), ("4", "m.Orders.find"): (0.8, "confirmed"),
                   ("5", "m.Repo.find"): (0.5, "weak"), ("5", "m.Other.find"): (0.5, "weak"), ("6", "m.Orders.find"): (0.8, "confirmed"), ("9", "m.Orders.find"): (0.85, "confirmed")}
    assert {(r["id"], r["reason"], r["candidates"]) for r in lost.collect()} == {
        ("7", "receiver type unresolved", 0), ("8", "method missing on resolved receiver type", 1), ("10", "receiver type unresolved", 0)}


def test_nothing_given(spark):
    none = spark.createDataFrame([], "class string")
    b = O.object_bindings(facts(spark), none)
    assert all(t.count() == 0 for t in b.values())
    edges, lost = O.nested_calls(spark.createDataFrame([], "id string, scope string, receiver string, method string"), b, none.withColumn("method", F.lit("m")), none)
    assert edges.count() == 0 and lost.count() == 0
