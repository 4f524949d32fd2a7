import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import cochange as C
from loomgraph.operators.order import before_within

T0 = dt.datetime(2022, 1, 1)


def commits(spark, sets, step=dt.timedelta(hours=1)):
    return spark.createDataFrame([(f"h{i}", f, T0 + i * step) for i, files in enumerate(sets) for f in files], "hash string, path string, ts timestamp_ntz")


@pytest.mark.parametrize(
    "sets, support, confidence, pairs",
    [
        ([], 0.5, 0.5, 0),
        ([["single.go"]], 0.5, 0.5, 0),
        ([["file1.go", "file2.go"]] * 2, 0.5, 0.5, 1),
        ([["file1", "file2", "file3"]], 0.01, 0.3, 3),
        ([["f1", "f2"], ["f1", "f3"], ["f2", "f3"]], 0.99, 0.99, 0),
        ([[f"f{i:02d}" for i in range(50)]], 0.05, 0.3, 1225),
        ([["file1", "file2", "file1"], ["file1", "file2"]], 0.05, 0.3, 1),
    ],
)
def test_pairs(spark, sets, support, confidence, pairs):
    assert C.mine_pairs(commits(spark, sets), support, confidence).count() == pairs


def test_confidence_and_interval(spark):
    found = {(r.file1, r.file2): r for r in C.mine_pairs(commits(spark, [["A", "B"], ["A", "B"], ["A", "C"]]), 0.1, 0.1).collect()}
    assert found["A", "B"].confidence == pytest.approx(2 / 3)
    patterns = C.change_patterns(commits(spark, [["f1", "f2"]] * 3), 0.1, 0.1).first()
    assert (patterns.avg_interval_s, patterns.frequency, patterns.name) == (3600, 3, "f1 + f2")


def test_together_share(spark):
    shares = {(r.file1, r.file2): r.share for r in C.together_share(commits(spark, [["f1", "f2"]] * 2 + [["f1", "f3"], ["f2", "f3"]])).collect()}
    assert shares["f1", "f2"] == 0.5


def test_many_commits(spark):
    sets = [[f"file{i % 10}", f"file{(i + 1) % 10}"] for i in range(1000)]
    found = C.mine_pairs(commits(spark, sets), 0.05, 0.3).collect()
    assert len(found) == 10 and all(r.frequency == 100 and r.confidence == 0.5 for r in found)


def test_components(spark):
    edges = spark.createDataFrame([("f1", "f2"), ("f1", "f3"), ("f4", "f5")], "file1 string, file2 string")
    found = {r.node: r.component for r in C.module_groups(edges).collect()}
    assert found == {"f1": "f1", "f2": "f1", "f3": "f1", "f4": "f4", "f5": "f4"}


def test_components_of_a_long_path_and_of_nothing(spark):
    path = spark.range(300).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    from loomgraph.operators.components import connected_components

    assert [r.component for r in connected_components(path).select("component").distinct().collect()] == [0]
    assert connected_components(path.where("src < 0")).count() == 0


def test_large_commits_can_be_left_out(spark):
    assert C.commit_sets(commits(spark, [["a", "b", "c"], ["a", "b"]]), most_files=2).count() == 1


def test_pairs_are_dealt_to_as_many_tasks_as_asked(spark):
    sets = C.commit_sets(commits(spark, [["a", "b", "c"], ["a", "b"], ["b", "c", "d", "e"]] * 9 + [["a"]]))
    dealt = C.pair_counts(sets, 23)
    assert dealt.rdd.getNumPartitions() == 23
    assert sorted(map(str, dealt.collect())) == sorted(map(str, C.pair_counts(sets).collect()))


def test_before_within_ranges(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["hot", "hot", "hot", "cold", None, "a"]), rng.randrange(50), k, rng.choice([1, 2, None])) for k in range(600)] + [("one", 1, 600, 5)]
    df = spark.createDataFrame(rows, "key string, ts long, id long, value long")
    found = before_within(df, "key", "value", "ts", "id", tasks=9).collect()
    last, want = {}, []
    for key, ts, k, value in sorted(rows, key=lambda r: r[1:3]):
        want.append((k, last.get(key)))
        last[key] = value
    assert sorted((r.id, r.before) for r in found) == sorted(want)
