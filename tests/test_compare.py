import random

from pyspark.sql import functions as F

from loomgraph.operators import compare, incremental
from loomgraph.operators import neighborhoods as N

OLD = "import a from './a'\nimport b from 'b'\nexport class Box {\n  open(x: number): void {\n  }\n}\nfunction loadUser(id: string): User {\n  return find(id)\n}\nlet n = 1\n"
NEW = "import a from './a'\nimport c from './c'\nexport class Box {\n  open(x: number, y: string): void {\n  }\n}\nfunction loadUsers(id: string): User {\n  return find(id)\n}\nlet n = 1\nexport const m = 2\n"


def test_compare_files(spark):
    one = lambda text, path="a.ts": spark.createDataFrame([(path, text)], "path string, content string")
    changes = compare.compare_files(one(OLD), one(NEW), min_score=0.5).cache()
    assert {tuple(r)[1:] for r in changes.collect()} == {
        ("modification", "signature", "open", "open(x: number): void", "open(x: number, y: string): void", "high", True),
        ("rename", "function", "loadUsers", "loadUser", "loadUsers", changes.where("category = 'rename'").first().impact, True),
        ("addition", "variable", "m", None, "export const m = 2", "medium", False),
        ("dependency", "removed", "b", "b", None, "high", True), ("dependency", "added", "./c", None, "./c", "low", False),
    }
    r = compare.change_summary(changes).first()
    assert (r.additions, r.deletions, r.modifications, r.renames, r.dependencies, r.breaking) == (1, 0, 1, 1, 2, 3)
    assert {r.category for r in compare.compare_files(one(OLD), one(NEW, "b.ts")).collect()} == {"addition", "deletion", "dependency"}
    assert compare.compare_files(one(OLD), one(OLD)).count() == 0


def test_similar_sets_against_brute_force(spark):
    rng = random.Random(3)
    sets = {k: {rng.randrange(12) for _ in range(rng.randint(0, 9))} for k in range(60)}
    df = spark.createDataFrame([(k, [*v, *list(v)[:1], None]) for k, v in sets.items()], "id int, members array<int>")
    for least in (0.3, 0.5, 0.8, 1.0):
        found = {(r.a, r.b, r.both) for r in N.similar_sets(df, least).collect()}
        assert found == {(a, b, len(sets[a] & sets[b])) for a in sets for b in sets if a < b and sets[a] and len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b])}


def test_a_long_chain_of_conflicts(spark):
    n = 24
    items, conflicts = spark.range(n), spark.createDataFrame([(k, k + 1) for k in range(n - 1)], "a long, b long")
    assert sorted(r.id for r in N.greedy_keep(items, conflicts).collect()) == list(range(0, n, 2))
    assert N.greedy_keep(items.where("false"), conflicts).count() == 0


def test_summary_and_plan_checks(spark):
    hoods = spark.createDataFrame([("x", 0.5, ["a", "b"]), ("y", 0.4, ["b", "c", None])], "id string, strength double, members array<string>")
    related = spark.createDataFrame([("strong",), ("weak",), ("weak",)], "strength string")
    assert tuple(N.summary(hoods, hoods.limit(1), related).first()) == (3, 2, 1, 1, 0, 2)
    plan = spark.createDataFrame([("a", "added"), ("b", "added"), ("a", "removed"), (None, "added"), (None, "added")], "path string, change string")
    assert {(r.path, r.patches) for r in incremental.plan_conflicts(plan, "path").collect()} == {("a", 2), (None, 2)}
    assert tuple(incremental.plan_validity(plan, "path").first()) == (5, 2, False, False)
    assert tuple(incremental.plan_validity(plan.where(F.col("path") == "b"), "path").first()) == (1, 0, True, False)
    assert tuple(incremental.plan_validity(plan.where("false"), "path").first()) == (0, 0, True, False)
