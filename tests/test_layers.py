"""Layers, order in a layer and view modes, held against small brute-force versions."""

from __future__ import annotations

import random

import pytest

from waymark import schema as S
from waymark.operators import inventory, layers, traverse

NODE = "id string, kind string, name string, file string, line int, confidence string, provenance string, lang string, package string, node_seq long"
EDGE = "src string, dst string, type string, file string, line int, confidence string, provenance string, edge_seq long"


def pairs(spark, rows):
    return spark.createDataFrame(rows, "src string, dst string")


def names(spark, ids):
    return spark.createDataFrame([(x,) for x in ids], "id string")


def brute_steps(ids, edges):
    out = {}
    for a, b in edges:
        out.setdefault(a, set()).add(b)
    ids = set(ids) | {x for e in edges for x in e}

    def below(x):
        seen, todo = set(), [x]
        while todo:
            for y in out.get(todo.pop(), ()):
                if y not in seen:
                    seen.add(y)
                    todo.append(y)
        return seen

    under = {x: below(x) for x in ids}
    on_cycle = {x for x in ids if x in under[x]}
    core = {x for x in ids if x in on_cycle or (under[x] & on_cycle and any(x in under[y] for y in on_cycle))}
    memo = {}

    def steps(x):
        if x not in memo:
            memo[x] = 1 + max(steps(y) for y in out[x]) if out.get(x) else 0
        return memo[x]

    layer = {}

    def layer_of(x):
        if x not in layer:
            layer[x] = 3 if x in core or not out.get(x) else min(5, max(1 + layer_of(y) for y in out[x]) // 2)
        return layer[x]

    return {x: (layer_of(x), None if under[x] & on_cycle else steps(x), x in core) for x in ids}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_longest_paths_and_cycles(spark, seed):
    r = random.Random(seed)
    ids = [f"n{i}" for i in range(24)]
    edges = [(f"n{a}", f"n{b}") for a, b in (sorted(r.sample(range(24), 2)) for _ in range(26))]
    edges += [("n9", "n3"), ("n20", "n20"), *edges[:3]] if seed != 1 else edges[:3]
    got = {x["id"]: (x["layer"], x["steps"], x["cyclic"]) for x in layers.longest_path_layers(pairs(spark, edges), names(spark, [*ids, "n1"])).collect()}
    assert got == brute_steps(ids, edges)


def test_longest_paths_of_chains_and_nothing(spark):
    chain = [(f"c{i:02d}", f"c{i + 1:02d}") for i in range(12)] + [("c00", "c12")]
    got = {x["id"]: x["steps"] for x in layers.longest_steps(pairs(spark, chain), names(spark, [])).collect()}
    assert got == {f"c{i:02d}": 12 - i for i in range(13)}
    assert layers.longest_steps(pairs(spark, []), names(spark, [])).count() == 0
    ring = layers.longest_path_layers(pairs(spark, [("a", "b"), ("b", "a"), ("up", "a"), ("b", "down")]), names(spark, ["alone"]))
    assert {x["id"]: (x["layer"], x["steps"]) for x in ring.collect()} == {"a": (3, None), "b": (3, None), "up": (2, None), "down": (3, 0), "alone": (3, 0)}


def fnv(text):
    h = 2166136261
    for ch in text:
        h = ((h ^ ord(ch)) * 16777619) & 0xFFFFFFFF
    return h


def brute_order(layer, edges):
    columns = [sorted(x for x in layer if layer[x] == c) for c in sorted(set(layer.values()))]
    edges = [e for e in edges if e[0] in layer and e[1] in layer]
    for sweep in range(4):
        order = range(1, len(columns)) if sweep % 2 == 0 else range(len(columns) - 2, -1, -1)
        for c in order:
            ref = {x: i for i, x in enumerate(columns[c - 1 if sweep % 2 == 0 else c + 1])}
            here, there = (1, 0) if sweep % 2 == 0 else (0, 1)

            def bar(x, ref=ref, here=here, there=there, size=len(columns[c])):
                near = [ref[e[there]] for e in edges if e[here] == x and e[there] in ref]
                return sum(near) / len(near) if near else fnv(x) % 997 / 997 * size

            columns[c].sort(key=lambda x: (bar(x), x))
    return {x: i for column in columns for i, x in enumerate(column)}


def test_order_in_layers(spark):
    r = random.Random(5)
    layer = {f"k{i}": r.choice([0, 1, 1, 3, 4]) for i in range(40)}
    edges = [tuple(r.sample(sorted(layer), 2)) for _ in range(90)]
    edges += edges[:5] + [("k1", "gone"), ("k2", "k2")]
    own = spark.createDataFrame(list(layer.items()), "id string, layer int")
    got = {x["id"]: x["place"] for x in layers.layer_order(own, pairs(spark, edges)).collect()}
    assert got == brute_order(layer, edges)
    assert layers.layer_order(own.limit(0), pairs(spark, edges)).count() == 0
    named = layers.layer_order(spark.createDataFrame([("a", "stores"), ("b", "clients"), ("c", None)], "id string, layer string"), pairs(spark, [("b", "a")]))
    assert {x["id"]: x["layer"] for x in named.collect()} == {"a": 5, "b": 0, "c": 3}


def a_graph(spark, seed, n=60, m=160):
    r = random.Random(seed)
    kinds = ("service", "endpoint", "table", "method", "component", "file", "external-service", "configuration")
    types = ("calls", "reads", "imports", "handled-by", "consumes", "depends-on", "contains")
    nodes = [(f"i{i}", r.choice(kinds), f"name{r.randrange(20)}", "f", 1, r.choice(S.CONFIDENCES), "derived", None, None, i) for i in range(n)]
    edges = [(f"i{r.randrange(n // 3) if r.random() < 0.5 else r.randrange(n)}", f"i{r.randrange(n)}", r.choice(types), "f", 1, "HIGH", "derived", i) for i in range(m)]
    edges += [("i1", "unresolved:class:X", "calls", "f", 1, "LOW", "derived", m)]
    return nodes, edges, spark.createDataFrame(nodes, NODE), spark.createDataFrame(edges, EDGE)


def brute_mode(nodes, edges, types, kinds, each, most, most_edges):
    live = [e for e in edges if not e[1].startswith("unresolved:")]
    keep = {n[0]: n for n in nodes if n[1] != "file"}
    out = {x: sum(e[0] == x for e in live) for x in keep}
    rank = lambda x: (S.CONF_RANK[keep[x][5]], S.KIND_RANK.get(keep[x][1], 50), -out[x], keep[x][2], keep[x][9])
    seeds = sorted((x for x in keep if keep[x][1] in kinds), key=rank)[: most // 2] or sorted(keep, key=rank)[: most // 2]
    want = set(seeds)
    for x in seeds:
        for e in [e for e in live if e[0] == x][:each] + [e for e in live if e[1] == x][:each]:
            if (not types or e[2] in types) and e[0] in keep and e[1] in keep:
                want |= {e[0], e[1]}
    want = set(sorted(want, key=rank)[:most])
    return want, [e[:3] for e in live if e[0] in want and e[1] in want and (not types or e[2] in types)][:most_edges]


@pytest.mark.parametrize(("seed", "n"), [(1, 60), (2, 60), (3, 5)])
def test_modes_in_one_traversal_equal_single_ones(spark, seed, n):
    nodes, edges, dn, de = a_graph(spark, seed, n)
    modes = inventory.MODES | {"nothing of its own": (("reads",), ("schedule",)), "classes": (("calls", "imports"), ("method",))}
    ids, links = (x.collect() for x in inventory.view_modes(dn, de, modes, each=2, most=12, most_edges=9))
    for name, (types, kinds) in modes.items():
        want, among = brute_mode(nodes, edges, types, kinds, 2, 12, 9)
        assert {r["id"] for r in ids if r["mode"] == name} == want, name
        assert sorted((r["src"], r["dst"], r["type"]) for r in links if r["mode"] == name) == sorted(among), name


def test_modes_of_nothing(spark):
    _, _, dn, de = a_graph(spark, 1)
    assert [x.count() for x in inventory.view_modes(dn.limit(0), de.limit(0))] == [0, 0]


def test_layers_of_the_walkable_edges(spark):
    _, _, dn, de = a_graph(spark, 4, 30, 40)
    adj = traverse.adjacency(dn, de)
    edges = [(r["src"], r["dst"]) for r in adj.collect()]
    got = {x["id"]: (x["layer"], x["steps"], x["cyclic"]) for x in layers.longest_path_layers(adj, dn).collect()}
    assert got == brute_steps([f"i{i}" for i in range(30)], edges)
