import random

import pytest

from sparkloom.operators import graph, search


def edges_of(spark, pairs):
    return spark.createDataFrame(pairs, "source string, target string")


def closure(pairs, start):
    out, todo = set(), [t for s, t in pairs if s == start]
    while todo:
        x = todo.pop()
        if x not in out:
            out.add(x)
            todo += [t for s, t in pairs if s == x]
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_against_plain_python(spark, seed):
    r = random.Random(seed)
    names = [f"n{i:02}" for i in range(14)]
    pairs = sorted({(r.choice(names), r.choice(names)) for _ in range(20)})
    df, nodes = edges_of(spark, pairs), spark.createDataFrame([(n,) for n in names], "id string")
    assert {x["id"] for x in graph.reachable(df, names[0]).collect()} == closure(pairs, names[0])
    assert {x["id"] for x in graph.reachable(df, names[0], backward=True).collect()} == {n for n in names if names[0] in closure(pairs, n)}
    label = {n: n for n in names}
    for _ in names:
        for s, t in pairs:
            label[s] = label[t] = min(label[s], label[t])
    assert {x["id"]: x["component"] for x in graph.weak_components(nodes, df).collect()} == label
    strong = {n: frozenset(m for m in closure(pairs, n) if n in closure(pairs, m)) | {n} for n in names}
    got: dict = {}
    for x in graph.strong_components(df).collect():
        got.setdefault(x["component"], set()).add(x["id"])
    assert {frozenset(v) for v in got.values()} == {v for v in strong.values() if len(v) > 1}
    for c in search.cycles(search.searched(df.selectExpr("'p' AS project", "*"))).collect():
        ring = c["nodes"]
        assert len(set(ring)) == c["length"] == len(ring) > 1
        assert all((a, b) in pairs for a, b in zip(ring, ring[1:] + ring[:1], strict=True))
    for end in names[1:6]:
        path = [x["id"] for x in graph.shortest_path(df, names[0], end).orderBy("step").collect()]
        level, far = {names[0]}, 0
        while end not in level and far < 15:
            level, far = {t for s, t in pairs if s in level}, far + 1
        if end in closure(pairs, names[0]):
            assert path[0] == names[0] and path[-1] == end and len(path) == far + 1
            assert all((a, b) in pairs for a, b in zip(path, path[1:], strict=False))
        else:
            assert path == []


def test_depth_cycles_and_orphans(spark):
    assert graph.max_depth(edges_of(spark, [("a", "b"), ("b", "c"), ("a", "c"), ("x", "c")])).first()[0] == 2
    assert graph.max_depth(edges_of(spark, [])).first()[0] == 0
    with pytest.raises(ValueError):
        graph.depths(edges_of(spark, [("a", "b"), ("b", "a")]))
    rings = graph.functional_cycles(edges_of(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("z", "a"), ("q", "q"), ("s", "t"), ("t", "s")]))
    assert sorted(tuple(x["cycle"]) for x in rings.collect()) == [("a", "b", "c"), ("s", "t")]
    nodes = spark.createDataFrame([("a",), ("b",), ("self",), ("alone",)], "id string")
    df = edges_of(spark, [("a", "b"), ("self", "self")])
    assert [x["id"] for x in graph.orphans(nodes, df).collect()] == ["alone"]
    assert {x["id"]: (x["fan_in"], x["fan_out"]) for x in graph.degrees(nodes, df).collect()}["self"] == (1, 1)
    bad = graph.integrity(nodes.union(nodes.limit(1)), df.union(edges_of(spark, [("a", "nowhere"), ("a", "b")]))).first()
    assert tuple(bad) == (1, 1, 1)
    assert [x["id"] for x in graph.children(df, "a").collect()] == ["b"] and [x["id"] for x in graph.parents(df, "b").collect()] == ["a"]


def test_self_and_unreached_paths(spark):
    df = edges_of(spark, [("a", "b"), ("b", "c"), ("a", "d"), ("d", "c")])
    assert [x["id"] for x in graph.shortest_path(df, "a", "a").collect()] == ["a"]
    assert [x["id"] for x in graph.shortest_path(df, "a", "c").orderBy("step").collect()] == ["a", "b", "c"]


def plain_search(pairs):
    """(depth by node, cycles): recursively, as written down."""
    out = {}
    for s, t in sorted(pairs, key=lambda e: search.edge_key(*e)):
        out.setdefault(s, []).append(t)
    depth, way, rings = {}, [], set()

    def visit(n):
        if n in depth:
            return depth[n]
        if n in way:
            ring = way[way.index(n) :]
            if len(ring) > 1:
                rings.add(tuple(min((ring[i:] + ring[:i] for i in range(len(ring))), key="".join)))
            return 0
        way.append(n)
        most = 0
        for c in out.get(n, ()):
            most = max(most, 1 + visit(c))
        way.pop()
        depth[n] = most
        return most

    for n in sorted({x for e in pairs for x in e}):
        visit(n)
    return depth, rings


@pytest.mark.parametrize(("most", "seeds"), [(None, range(6)), (0, (1,)), (8, (2,))])
def test_the_search_against_recursion(spark, most, seeds):
    """Whole graphs in tasks, and graphs taken apart into their strong components, several at once."""
    graphs = {}
    for seed in seeds:
        for k in range(8):
            r = random.Random(100 * seed + k)
            n = r.choice((2, 5, 12, 20))
            graphs[f"{seed}-{k}"] = sorted({(f"n{r.randrange(n):02}", f"n{r.randrange(n):02}") for _ in range(r.choice((2, n, 2 * n)))})
    rows = [(p, *e) for p, pairs in graphs.items() for e in pairs]
    found = search.searched(spark.createDataFrame(rows + rows[:5], "project string, source string, target string"), most=most)
    depth = {(x["project"], x["id"]): x["depth"] for x in search.depths(found).collect()}
    rings = {(x["project"], tuple(x["nodes"])) for x in search.cycles(found).collect()}
    told = {p: plain_search(pairs) for p, pairs in graphs.items()}
    assert depth == {(p, n): d for p, (ds, _) in told.items() for n, d in ds.items()}
    assert rings == {(p, c) for p, (_, cs) in told.items() for c in cs}
    assert search.max_depth(found).first()[0] == max(depth.values())


def test_searching_nothing_and_long_chains(spark):
    none = search.searched(spark.createDataFrame([], "project string, source string, target string"))
    assert none.count() == 0 and search.max_depth(none).first()[0] == 0
    chain = [("p", f"n{i:05}", f"n{i + 1:05}") for i in range(3000)]
    assert search.max_depth(search.searched(spark.createDataFrame(chain, "project string, source string, target string"))).first()[0] == 3000


@pytest.mark.parametrize("held", [1, 3, 1 << 20])
def test_components_whatever_a_task_contracts(spark, monkeypatch, held):
    monkeypatch.setattr(graph, "CONTRACTED", held)
    r = random.Random(held)
    pairs = [(r.randrange(60), r.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(40)] + [(7, 7), (200, 200)]
    label = {n: n for p in pairs for n in p}
    for _ in label:
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    got = {x["node"]: x["component"] for x in graph.star_components(spark.createDataFrame(pairs, "a long, b long").repartition(5)).collect()}
    assert got == {n: c for n, c in label.items() if n in got} and {n for n in label if n not in got} <= {n for n, c in label.items() if c == n and list(label.values()).count(n) == 1}
    words = spark.createDataFrame([(f"é{a}", f"é{b}") for a, b in pairs], "a string, b string")
    assert {frozenset(v) for v in _by(graph.star_components(words).collect()).values()} == {frozenset(f"é{n}" for n in label if label[n] == c) for c in {*label.values()} if list(label.values()).count(c) > 1}


def _by(rows):
    out = {}
    for x in rows:
        out.setdefault(x["component"], set()).add(x["node"])
    return out


def test_the_path_met_first_and_long_ones(spark):
    """Against a queue, neighbours in id order; and a path of many steps."""
    from collections import deque

    for seed in range(2):
        r = random.Random(seed)
        pairs = sorted({(r.randrange(25), r.randrange(25)) for _ in range(60)})
        out = {}
        for s, t in pairs:
            out.setdefault(s, []).append(t)
        parent, todo = {0: None}, deque([0])
        while todo:
            n = todo.popleft()
            for c in out.get(n, ()):
                if c not in parent:
                    parent[c] = n
                    todo.append(c)
        df = spark.createDataFrame(pairs, "source long, target long")
        for end in (7, 24):
            want, n = [], end
            while end in parent and n is not None:
                want.append(n)
                n = parent[n]
            assert [x["id"] for x in graph.shortest_path(df, 0, end).orderBy("step").collect()] == want[::-1]
    chain = spark.createDataFrame([(i, i + 1) for i in range(12)] + [(12, 0), (3, 1)], "source long, target long")
    assert [tuple(x) for x in graph.shortest_path(chain, 0, 12).orderBy("step").collect()] == [(i, i) for i in range(13)]
