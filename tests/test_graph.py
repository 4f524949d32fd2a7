import random

import pytest
from pyspark.sql import functions as F

from loomgraph.functions import ladders
from loomgraph.functions import paths as P
from loomgraph.operators import diff as D
from loomgraph.operators import graph as G
from loomgraph.operators import neighborhoods as N

FILES = ["src/user.ts", "src/types.ts", "src/utils.ts"]


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_resolve_and_hotspots(spark):
    files = spark.createDataFrame([(f,) for f in FILES], "path string")
    imports = spark.createDataFrame([("src/user.ts", "./types"), ("src/user.ts", "./utils"), ("src/utils.ts", "./types"), ("src/user.ts", "lodash"), ("src/user.ts", "./nonexistent")], "path string, import_path string")
    resolved = {(r.path, r.import_path): r.target for r in G.resolve_imports(imports, files).collect()}
    assert resolved["src/user.ts", "./types"] == "src/types.ts"
    assert resolved["src/user.ts", "lodash"] is None and resolved["src/user.ts", "./nonexistent"] is None
    edges = G.import_edges(G.resolve_imports(imports, files)).where("type = 'imports'")
    assert {r.node: r.score for r in G.hotspots(edges).collect()} == {"src/types.ts": 4.0, "src/user.ts": 2.0, "src/utils.ts": 3.0}
    nodes = spark.createDataFrame([(f,) for f in [*FILES, "src/isolated.ts"]], "node string")
    assert [r.node for r in G.isolated(nodes, edges).collect()] == ["src/isolated.ts"]


@pytest.mark.parametrize("source, target, first", [("src/a/b.ts", "../c", "src/c.ts"), ("b.ts", "./c", "c.ts"), ("src/b.ts", "./d/../c", "src/c.ts")])
def test_candidates(spark, source, target, first):
    assert one(spark, P.import_candidates(F.lit(source), F.lit(target)))[0] == first


def test_strong_components_match_brute_force(spark):
    rng = random.Random(4)
    edges = {(rng.randrange(40), rng.randrange(40)) for _ in range(60)} | {(50, 50)}
    reach = {(a, b) for a, b in edges}
    while True:
        more = {(a, d) for a, b in reach for c, d in reach if b == c} - reach
        if not more:
            break
        reach |= more
    expected = {n: min(m for m in range(60) if (n, m) in reach and (m, n) in reach) for n in range(60) if any((n, m) in reach and (m, n) in reach for m in range(60))}
    found = G.strongly_connected(spark.createDataFrame(list(edges), "src int, dst int"))
    assert {r.node: r.component for r in found.collect()} == expected


@pytest.mark.parametrize("signature, names", [("(user: UserType): void", ["UserType"]), ("getUser(): UserType", ["UserType"]), ("(user: UserType, callback: CallbackType): ResultType", ["UserType", "CallbackType", "ResultType"]), ("plain", [])])
def test_type_references(spark, signature, names):
    assert one(spark, P.type_references(F.lit(signature))) == names


@pytest.mark.parametrize("path, pattern, expected", [("node_modules/a.js", "node_modules/", True), ("src/app.log", "*.log", True), ("src/app.go", "*.log", False), ("a/dist/b.js", "dist/", True), ("test.go", "test", True)])
def test_ignore(spark, path, pattern, expected):
    assert one(spark, P.matches(F.lit(path), pattern)) is expected


def test_mined_and_skipped(spark):
    assert one(spark, P.mined(F.lit("src/main.go"))) and not one(spark, P.mined(F.lit("README.md"))) and one(spark, P.mined(F.lit("package.json")))
    assert not one(spark, P.skipped(F.lit("src/template.ts"))) and one(spark, P.skipped(F.lit("a/tmp/b.ts")))


@pytest.mark.parametrize("n, k", [(1, 1), (2, 2), (4, 2), (8, 2), (16, 3), (32, 4), (100, 6), (1000, 10)])
def test_cluster_counts(spark, n, k):
    assert one(spark, ladders.optimal_clusters(F.lit(n))) == k


@pytest.mark.parametrize("score, name", [(0.9, "very_strong"), (0.7, "strong"), (0.5, "moderate"), (0.1, "weak")])
def test_recommendation(spark, score, name):
    assert one(spark, ladders.recommendation_strength(F.lit(score))) == name


def test_overlap_and_merge(spark):
    j = lambda a, b: one(spark, N.jaccard(F.array(*map(F.lit, a)), F.array(*map(F.lit, b))))
    assert j("abc", "bcd") == 0.5 and j("ab", "cd") == 0.0
    groups = spark.createDataFrame([("a", 0.9, list("abc")), ("b", 0.8, list("abc")), ("c", 0.7, list("de")), ("d", 0.6, list("abf"))], "id string, strength double, members array<string>")
    assert sorted(r.id for r in N.merge_similar(groups).collect()) == ["a", "c", "d"]


def test_single_linkage_matches_brute_force(spark):
    rng = random.Random(1)
    n = 14
    dist = {(a, b): round(rng.random(), 3) for a in range(n) for b in range(a + 1, n)}
    label = list(range(n))
    for (a, b), _ in sorted(dist.items(), key=lambda x: (x[1], x[0])):
        if len(set(label)) == 4:
            break
        x, y = label[a], label[b]
        label = [min(x, y) if v in (x, y) else v for v in label]
    edges = spark.createDataFrame([(a, b, d) for (a, b), d in dist.items()], "a long, b long, distance double")
    found = {r.id: r.cluster for r in N.single_linkage(spark.range(n), edges, 4).collect()}
    assert found == dict(enumerate(label))


def test_cluster_numbers(spark):
    clusters = spark.createDataFrame([("x", "x"), ("y", "x")], "id string, cluster string")
    scores = spark.createDataFrame([("x", 0.8), ("y", 0.6)], "id string, score double")
    edges = spark.createDataFrame([("x", "y", 3 / 7)], "a string, b string, distance double")
    r = N.cluster_metrics(clusters, scores, edges).first()
    assert (r.size, r.density) == (2, 1.0) and r.strength == pytest.approx((0.7 + 0.7) / 2)
    text = one(spark, N.describe_cluster(F.lit(2), F.lit(5), F.lit(0.7)))
    assert text == "Cluster of 2 neighborhoods containing 5 files with 0.70 average combined score"


def test_cluster_names(spark):
    rows = [("c", "internal/auth/handler"), ("c", "auth/token and more"), ("c", "the session"), ("d", "a")]
    found = {r.cluster: r.name for r in N.cluster_names(spark.createDataFrame(rows, "cluster string, name string"), "cluster", "name").collect()}
    assert found == {"c": "auth-cluster", "d": "cluster"}


def scc_of(edges):
    reach = {(a, b) for a, b in edges}
    while True:
        more = {(a, d) for a, b in reach for c, d in reach if b == c} - reach
        if not more:
            break
        reach |= more
    nodes = {n for e in edges for n in e}
    return {n: min(m for m in nodes if (n, m) in reach and (m, n) in reach) for n in nodes if (n, n) in reach}


def shortest(edges, inside, start):
    at, n = {start}, 0
    while True:
        at, n = {b for a, b in edges if a in at and inside.get(b) == start}, n + 1
        if start in at:
            return n


@pytest.mark.parametrize("seed", range(3))
def test_components_and_cycles_with_chains(spark, seed):
    rng = random.Random(seed)
    edges, fresh = {(rng.randrange(9), rng.randrange(9)) for _ in range(14)}, iter(range(100, 999))
    for _ in range(6):  # chains between nodes, some from a node to itself
        row = [rng.randrange(9), *(next(fresh) for _ in range(rng.randint(1, 7))), rng.randrange(9)]
        edges |= set(zip(row, row[1:]))
    ring = [next(fresh) for _ in range(11)]
    rng.shuffle(ring)
    edges |= set(zip(ring, ring[1:] + ring[:1])) | {(50, 51), (51, 52), (60, 60)}
    df = spark.createDataFrame([*edges, *list(edges)[:3], (None, 1), (1, None)], "src int, dst int")
    found = G.strongly_connected(df, steps=2)
    want = scc_of(edges)
    assert {r.node: r.component for r in found.collect()} == want
    paths = {}
    for r in sorted(G.cycle_paths(df, found).collect()):
        paths.setdefault(r.component, []).append((r.place, r.node))
    assert paths.keys() == set(want.values())
    for start, path in paths.items():
        nodes = [n for _, n in path]
        assert [p for p, _ in path] == list(range(len(path))) and nodes[0] == start and len(set(nodes)) == len(nodes)
        assert all(e in edges for e in zip(nodes, nodes[1:] + nodes[:1])) and len(nodes) == shortest(edges, want, start)


def test_long_chains_take_few_rounds(spark, monkeypatch):
    n, rng, written = 5000, random.Random(1), []
    monkeypatch.setattr(G, "stored", lambda df, name, real=G.stored: written.append(name) or real(df, name))
    order = list(range(n))
    rng.shuffle(order)
    edges = [*zip(order, order[1:]), *((n + k, n + (k + 1) % 5000) for k in range(5000))]  # a chain, and a ring
    df = spark.createDataFrame(edges, "src int, dst int")
    found = {r.node: r.component for r in G.strongly_connected(df).collect()}
    assert found == dict.fromkeys(range(n, 2 * n), n) and len(written) < 40
    path = G.cycle_paths(df, spark.createDataFrame(list(found.items()), "node int, component int"))
    assert [r.node for r in sorted(path.collect())] == list(range(n, 2 * n))


def test_no_cycles(spark):
    df = spark.createDataFrame([(1, 2), (2, 3)], "src int, dst int")
    assert G.strongly_connected(df).count() == 0 == G.cycle_paths(df, G.strongly_connected(df)).count()


def test_innermost_range_by_bins(spark):
    rng = random.Random(9)
    ranges = [(rng.choice("ab"), f"r{k}", a, a + rng.choice([0, 1, 5, 90])) for k in range(40) for a in [rng.randrange(100)]] + [("a", "whole", -50, 500), ("a", "none", 5, None), ("b", "back", 9, 3)]
    points = [(rng.choice("abc"), rng.randrange(-60, 200)) for _ in range(120)]
    found = {(r.path, r.point): r.name for r in G.containing(spark.createDataFrame(points, "path string, point long"), spark.createDataFrame(ranges, "path string, name string, start long, end long")).collect()}
    want = {}
    for path, x in points:
        inside = [(e - s, n) for p, n, s, e in ranges if p == path and e is not None and s <= x <= e]
        if inside:
            want[path, x] = min(inside)[1]
    assert found == want


def counted(df):
    """The table, and a counter of its rows that grows each time they are worked out."""
    seen = df.sparkSession.sparkContext.accumulator(0)

    def pass_on(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    return df.mapInArrow(pass_on, df.schema), seen


def test_large_component_takes_one_round(spark, monkeypatch):
    rng, written = random.Random(3), []
    monkeypatch.setattr(G, "stored", lambda df, name, real=G.stored: written.append(name) or real(df, name))
    core = {(100 + a, 100 + b) for a in range(20) for b in rng.sample(range(20), 4) if a != b}
    above = {(a, a + k) for a in range(5) for k in (1, 2)} | {(5, 100), (5, 101), (6, 100), (6, 101)}  # leads into the core, by smaller ids
    df, seen = counted(spark.createDataFrame([*core, *above], "src int, dst int"))
    found = G.strongly_connected(df)
    assert {r.node: r.component for r in found.collect()} == scc_of(core) and len(set(scc_of(core).values())) == 1
    assert written.count("scc-both") == 1 and seen.value == len(core | above)


def test_cycles_work_out_their_edges_once(spark):
    rows = [(1, 2), (2, 3), (3, 1), (3, 4), (4, 2), (7, 7)]
    df, seen = counted(spark.createDataFrame(rows, "src int, dst int"))
    components = spark.createDataFrame([*((n, 1) for n in range(1, 5)), (7, 7)], "node int, component int")
    assert sorted(G.cycle_paths(df, components).collect()) == [(1, 0, 1), (1, 1, 2), (1, 2, 3), (7, 0, 7)] and seen.value == len(rows)


def test_cycle_risks_work_out_their_edges_once(spark):
    rows = [(1, 2), (2, 1), (2, 3), (3, 4), (4, 3)]
    df, seen = counted(spark.createDataFrame(rows, "source int, target int"))
    old = spark.createDataFrame(rows[:4], "source int, target int")
    assert [tuple(r) for r in D.cycle_risks(old, df).collect()] == [(3, 2, 1, "high")] and seen.value == len(rows)
