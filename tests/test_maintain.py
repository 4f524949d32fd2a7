import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import compact as K
from loomgraph.operators import diff as D
from loomgraph.operators import incremental as I
from loomgraph.operators import rename as R
from loomgraph.streaming import watch as W

T0 = dt.datetime(2024, 1, 1)


def small(spark):
    files = spark.createDataFrame([("test1.ts", 500, 25, 2), ("test2.ts", 800, 40, 1)], "path string, size long, lines long, symbol_count long")
    symbols = spark.createDataFrame([("s1", "test1.ts"), ("s2", "test1.ts"), ("s3", "test2.ts")], "symbol_id string, path string")
    return K.Graph(files, symbols, spark.createDataFrame([("test1.ts", "test2.ts")], "src string, dst string"))


def test_compaction(spark):
    g = small(spark)
    name, out = K.compact(g, "relevance", names=["test1.ts"])
    assert {r.path for r in out.files.collect()} == {"test1.ts", "test2.ts"}
    assert {r.path: r.relevance for r in K.relevance(g, F.col("path") == "test1.ts").collect()} == {"test1.ts": 1.0, "test2.ts": 0.6}
    assert K.compact(g, "size", most=1_000_000)[1].files.count() == 2
    assert K.compact(g, "size", most=700)[1].files.count() == 1
    assert K.compact(g, "size", most=2)[1].files.count() == 0
    assert K.compact(g, enabled=False)[0] == "none"
    with pytest.raises(ValueError):
        K.compact(g, "unknown")
    with pytest.raises(ValueError):
        K.compact(None)
    assert K.strategy_for("minimal") == "relevance" and K.strategy_for("minimal", "debugging") == "dependency"


def test_versions_and_rollback(spark, tmp_path):
    t = I.VersionedTable(spark, "state", str(tmp_path))
    t.write(spark.createDataFrame([("a", 1)], "path string, size long"))
    t.write(spark.createDataFrame([("a", 2)], "path string, size long"))
    assert t.read().first().size == 2
    t.rollback(0)
    assert t.read().first().size == 1
    assert t.write(spark.createDataFrame([("a", 3)], "path string, size long")) == 2 and t.read().first().size == 3


def test_diff_counts(spark):
    old = spark.createDataFrame([("a", 1), ("b", 1), ("n", None)], "path string, size long")
    new = spark.createDataFrame([("a", 2), ("c", 1), ("n", None)], "path string, size long")
    found = D.snapshot_diff(old, new, "path", ["size"])
    assert {r.path: r.change for r in found.collect()} == {"a": "modified", "b": "removed", "c": "added"}
    summary = I.impact_summary(found.where("change <> 'modified'"), F.lit(True)).first()
    assert summary.risk == pytest.approx(0.9) and summary.high_impact == 1


def test_greedy_matching(spark):
    pairs = [(1, 1, 0.9), (1, 2, 0.8), (2, 1, 0.85), (2, 2, 0.5), (3, 2, 0.5)]
    found = R.one_to_one(spark.createDataFrame(pairs, "old_id long, new_id long, score double"))
    assert {(r.old_id, r.new_id) for r in found.collect()} == {(1, 1), (2, 2)}


def greedy(pairs):
    olds, news, out = set(), set(), set()
    for old, new, _ in sorted(pairs, key=lambda p: (-p[2], p[0], p[1])):
        if old not in olds and new not in news:
            olds.add(old), news.add(new), out.add((old, new))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_matching_is_that_of_a_greedy_pass(spark, seed):
    rng = random.Random(seed)
    pairs = [(a, 100 + b, rng.choice([0.5, 0.6, 0.7])) for a in range(12) for b in range(12) if rng.random() < 0.5]
    pairs += [(50 + a, 150 + b, 0.9) for a in range(9) for b in range(7)] + [(50, 100, 0.95)] * seed
    found = R.one_to_one(spark.createDataFrame(sorted(set(pairs)), "old_id long, new_id long, score double"))
    assert {(r.old_id, r.new_id) for r in found.collect()} == greedy(set(pairs))


def test_equal_symbols_are_matched_in_one_round(spark):
    pairs = [(a, b, 0.9) for a in range(40) for b in range(30)]
    found = R.one_to_one(spark.createDataFrame(pairs, "old_id long, new_id long, score double"), max_rounds=1)
    assert {(r.old_id, r.new_id) for r in found.collect()} == {(k, k) for k in range(30)}


def heuristic(spark, f, a, b):
    return spark.createDataFrame([(a, b)], "a string, b string").select(f(F.col("a"), F.col("b")).alias("x")).first().x


@pytest.mark.parametrize("f, a, b, score", [(R.affix_heuristic, "name", "getName", 0.9), (R.affix_heuristic, "load", "loadAll", 0.7), (R.affix_heuristic, "load", "save", 0.0), (R.abbreviation_heuristic, "maximumSize", "maxSize", 0.9), (R.refactoring_heuristic, "user_name", "userName", 0.8), (R.camel_heuristic, "loadUserName", "loadUserNameFast", 0.8)])
def test_heuristics(spark, f, a, b, score):
    assert heuristic(spark, f, a, b) == pytest.approx(score)


def changes(folder, rows, name):
    (folder / name).write_text("\n".join(json.dumps({"change_id": i, "ts": (T0 + dt.timedelta(milliseconds=ms)).isoformat(), "path": p, "op": op}) for i, ms, p, op in rows))


ROWS = [(1, 0, "a.ts", "create"), (2, 300, "a.ts", "write"), (3, 2000, "a.ts", "remove"), (4, 100, "b.ts", "write"), (5, 60_000, "z.ts", "write")]


def test_debounce_stream_equals_batch(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    changes(folder, ROWS, "1.json")
    batch = W.debounced(spark.read.schema(W.CHANGES).json(str(folder))).where("path <> 'z.ts'")
    q = W.debounced(W.watched(W.change_stream(spark, str(folder)))).writeStream.format("memory").queryName("runs").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    stream = spark.table("runs").where("path <> 'z.ts'")
    assert sorted(map(tuple, stream.collect())) == sorted(map(tuple, batch.collect())) and stream.count() == 3


def test_count_or_time_batches(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    changes(folder, [(i, i, "a.ts", "write") for i in range(7)], "1.json")
    q = W.batched(W.change_stream(spark, str(folder), files_per_trigger=1)).writeStream.format("memory").queryName("batches").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(120)
    assert [(r.n, r.reason) for r in spark.table("batches").collect()][0] == (5, "size")


def test_table_kept_by_a_stream(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    changes(folder, ROWS, "1.json")
    t = I.VersionedTable(spark, "kept", str(tmp_path / "table"))
    t.write(spark.createDataFrame([("old.ts", "write")], "path string, op string"))
    q = W.keep_table(W.change_stream(spark, str(folder)), t, "path", F.col("op") == "remove", str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert {r.path for r in t.read().collect()} == {"old.ts", "b.ts", "z.ts"}


def test_numbers_and_running_sums(spark):
    from loomgraph.operators.order import in_order

    rows = [(k * 7919 % 101, k % 5) for k in range(101)]
    df = spark.createDataFrame(rows, "k long, v long").repartition(5)
    found = {r.k: (r.number, r.before) for r in in_order(df, F.desc("k"), value="v").collect()}
    before = 0
    for n, (k, v) in enumerate(sorted(rows, reverse=True), 1):
        assert found[k] == (n, before)
        before += v
    assert in_order(df.where("k < 0"), "k").count() == 0


def test_average_of_one_key_over_many_tasks(spark):
    rows = [(0 if k % 3 else k % 7, (k * 7919) % 5003, k, float(k % 11)) for k in range(5000)] + [(9, 1, 5000, 2.0), (9, 2, 5001, None), (None, 1, 5002, 4.0)]
    df = spark.createDataFrame(rows, "user long, ts long, id long, v double").repartition(3)
    out = I.moving_average(df, "user", "v", "ts", "id")
    want = {}
    for user, _, _, v in sorted(rows, key=lambda r: r[1:3]):
        n, ema = want.get(user, (0, v))
        want[user] = (n + 1, None if None in (ema, v) else v if n == 0 else ema * 0.9 + v * 0.1)
    found = {r.user: (r.n, r.ema) for r in out.collect()}
    assert found.keys() == want.keys() and found[9] == (2, None)
    assert all(found[u][0] == n and (e is None or found[u][1] == pytest.approx(e, abs=1e-9)) for u, (n, e) in want.items())
    assert "rangepartitioning(key" in out._jdf.queryExecution().toString()  # a key's events are spread, not collected in one row


def test_changes_leave_other_users_as_they_were(spark, monkeypatch):
    from loomgraph.plans import maintain

    seen, apply = [], I.apply_changes
    monkeypatch.setattr(maintain.I, "apply_changes", lambda state, changes, *a: seen.append((state, changes)) or apply(state, changes, *a))
    out = {r.user_id: r.value for r in maintain.apply_changes(spark, "/root/testdata/sf0.001").collect()}
    state, changes = seen[0]
    others = {r.user_id: r.value for r in state.join(changes, "user_id", "left_anti").collect()}
    assert others and changes.count() and state.join(changes, "user_id", "left_semi").count()
    assert all(out[u] == v for u, v in others.items())
