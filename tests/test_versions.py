import datetime as dt
import itertools
import json
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.operators import cochange as C
from loomgraph.operators import graph as G
from loomgraph.operators import sequence, sketches
from loomgraph.operators.asof import as_of
from loomgraph.shared import stored
from loomgraph.streaming import watch as W

T0 = dt.datetime(2024, 1, 1)


@pytest.mark.parametrize("ranges, strict", [(None, False), (40, False), (40, True), (3, True)])
def test_as_of_with_a_hot_key(spark, ranges, strict):
    rng = random.Random(5)
    key = lambda: rng.choice([1, 1, 1, *range(2, 30), None])
    events = [(k, key(), rng.randrange(400) if rng.random() < 0.97 else None) for k in range(3000)]
    versions = [(k, key(), rng.randrange(400) if rng.random() < 0.95 else None, rng.choice(["a", None])) for k in range(120)] + [(500, 77, 399, "end"), (501, 1, 0, "start")]
    e = spark.createDataFrame([*events, events[0]], "id long, user long, ts long").repartition(5)
    v = spark.createDataFrame(versions, "id long, user long, ts long, text string").repartition(3)
    found = as_of(e, v, "user", "ts", "ts", "id", "id", strict=strict, ranges=ranges).collect()

    def valid(user, ts):
        held = [(t, i, x) for i, u, t, x in versions if None not in (u, t, user, ts) and u == user and (t < ts or (t == ts and not strict))]
        t, i, x = max(held, default=(None,) * 3, key=lambda h: h[:2])
        return None if t is None else (i, user, t, x)

    want = [(i, u, t, valid(u, t)) for i, u, t in [*events, events[0]]]
    assert sorted(map(repr, ((r.id, r.user, r.ts, r.version and tuple(r.version)) for r in found))) == sorted(map(repr, want))
    if ranges == 40:
        plan = as_of(e, v, "user", "ts", "ts", "id", "id", ranges=ranges)
        assert plan.where("user = 1").count() > len(events) / 12


def test_as_of_without_rows(spark):
    e, v = spark.createDataFrame([(1, 1, 1)], "id long, user long, ts long"), spark.createDataFrame([], "id long, user long, ts long")
    assert as_of(e, v, "user", "ts", "ts", "id", "id").collect()[0].version is None
    assert as_of(e.where("false"), e, "user", "ts", "ts", "id", "id").count() == 0


def lcs(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


def test_longest_increasing():
    rng = random.Random(1)
    for n in range(9):
        for _ in range(20):
            values = rng.sample(range(50), n)
            mask = sequence.longest_increasing(np.array(values, np.int64))
            kept = [v for v, m in zip(values, mask, strict=True) if m]
            assert kept == sorted(kept) and len(kept) == max(len(c) for k in range(n + 1) for c in itertools.combinations(values, k) if list(c) == sorted(c))
    assert sequence.longest_increasing(np.random.default_rng(1).permutation(50_000)).sum() > 300


def test_sequence_diff_is_a_longest_common_subsequence(spark):
    rng = random.Random(3)
    old, new = [], []
    for f in [*range(25), None]:
        nodes = [rng.choice("abcdefgh") for _ in range(rng.randint(0, 14))]
        later = [rng.choice("xyz") if rng.random() < 0.1 else n for n in nodes]
        if rng.random() < 0.7:
            rng.shuffle(later)
        old += [(f, n, k, rng.choice([1, None])) for k, n in enumerate(nodes)]
        new += [(f, n, k, rng.choice([1, None])) for k, n in enumerate(later[: rng.randint(0, 14)])]
    schema = "path long, node string, place int, content int"
    diff = sequence.node_diff(spark.createDataFrame(old, schema), spark.createDataFrame(new, schema), "path", "node", "place", "content").cache()
    found = {r.path: r for r in sequence.diff_summary(diff, "path").collect()}

    def named(rows, f):
        count = Counter()
        out = {}
        for path, n, k, c in sorted(rows, key=lambda r: r[2]):
            if path == f:
                count[n] += 1
                out[n, count[n]] = (k, c)
        return out

    for f in {r[0] for r in [*old, *new]}:
        a, b = named(old, f), named(new, f)
        both = a.keys() & b.keys()
        want = lcs(sorted(a, key=a.get), sorted(b, key=b.get))
        edited = sum(a[k][1] != b[k][1] for k in both)
        assert tuple(found[f]) == (f, len(a), len(b), want, len(both) - want, edited, len(b) - len(both), len(a) - len(both), len(both) / len(a.keys() | b.keys()))
    for f in {r.path for r in diff.collect()}:
        run = [r for r in diff.collect() if r.path == f and r.in_order]
        assert [r.new_place for r in sorted(run, key=lambda r: r.old_place)] == sorted(r.new_place for r in run)


def test_sequence_diff_takes_many_files_in_one_call(spark):
    places = {f: random.Random(f).sample(range(n), n) for f, n in enumerate([1, 2, 40, 3, 1, 0, 25, *[1] * 60])}
    old = [(f, k, k, 0) for f, v in places.items() for k in range(len(v))]
    new = [(f, k, p, 0) for f, v in places.items() for k, p in enumerate(v)]
    schema = "path long, node long, place int, content int"
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # files begin and end anywhere in a batch, and run over several
    try:
        diff = sequence.node_diff(spark.createDataFrame(old, schema), spark.createDataFrame(new, schema), "path", "node", "place", "content")
        plan = diff._jdf.queryExecution().toString()
        assert "MapInArrow" in plan and "FlatMapGroupsIn" not in plan  # a call for each file made 900,000 files too slow
        found = Counter(r.path for r in diff.collect() if r.in_order)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert found == Counter({f: lcs(list(range(len(v))), sorted(range(len(v)), key=v.__getitem__)) for f, v in places.items() if v})


def test_sketches_merge_within_their_bounds(spark):
    rng = random.Random(8)
    rows = [(rng.choice(["a", "a", *map(str, range(40))]), f"u{rng.randrange(6000)}", T0 + dt.timedelta(minutes=rng.randrange(100_000))) for _ in range(20_000)]
    rows += [("a", None, T0), ("z", "solo", None)]
    df = spark.createDataFrame(rows, "path string, author string, ts timestamp")
    weeks = sketches.weekly_sketches(df).cache()
    thirds = sketches.over_ranges(weeks, F.month("week") % 3)
    once, twice = sketches.over_ranges(weeks, F.lit(1)), sketches.over_ranges(thirds, F.lit(1))
    timed = [r for r in rows if r[2] is not None]
    authors = len({r[1] for r in timed if r[1]})
    gaps = []
    for path in {r[0] for r in timed}:
        at = sorted(r[2] for r in timed if r[0] == path)
        days = sorted(set(at))
        gaps += [(t - days[days.index(t) - 1]).total_seconds() for t in at if days.index(t)]
    gaps = np.sort(gaps)
    for merged in (once, twice):
        r = merged.select("changes", sketches.author_count().alias("n"), *(sketches.gap_quantile(q).alias(f"q{k}") for k, q in enumerate((0.1, 0.5, 0.9)))).first()
        assert r.changes == len(timed) and abs(r.n - authors) <= sketches.ERROR * authors
        for q, v in zip((0.1, 0.5, 0.9), (r.q0, r.q1, r.q2), strict=True):
            low, high = np.searchsorted(gaps, v, "left") / len(gaps), np.searchsorted(gaps, v, "right") / len(gaps)
            assert low - sketches.RANK_ERROR <= q <= high + sketches.RANK_ERROR


def test_pair_counts_kept_through_batches(spark):
    rng = random.Random(2)
    history, counts, state = spark.createDataFrame([], "hash long, path string, ts long"), spark.createDataFrame([], "file1 string, file2 string, frequency long"), set()
    for _ in range(4):
        batch = {}
        for _ in range(60):
            h, p = rng.randrange(25), rng.choice("abcdefg")
            batch[h, p] = -1 if rng.random() < 0.35 else 1
        state = (state | {k for k, s in batch.items() if s > 0}) - {k for k, s in batch.items() if s < 0}
        history, counts = C.maintain_pairs(history, counts, spark.createDataFrame([(h, p, 0, s) for (h, p), s in batch.items()], "hash long, path string, ts long, sign int"))
        history, counts = stored(history, "history"), stored(counts, "counts")
        mined = C.pair_counts(C.commit_sets(spark.createDataFrame([(h, p, 0) for h, p in state], "hash long, path string, ts long")))
        assert {(r.hash, r.path) for r in history.collect()} == state
        assert {tuple(r) for r in counts.collect()} == {(r.file1, r.file2, r.frequency) for r in mined.collect()}


def test_references_take_the_nearest_symbol(spark):
    rng = random.Random(6)
    files = [f"{a}/{b}.ts" for a in "pq" for b in "123"] + ["top.ts"]
    symbols = [(k, rng.choice(["get", "set", "run"]), rng.choice(files)) for k in range(20)]
    imports = [(rng.choice(files), rng.choice([*files, None])) for _ in range(8)]
    refs = [(rng.choice([*range(20), None]), rng.choice(files), rng.choice(["get", "set", "run", "none"])) for _ in range(80)]
    found = G.resolve_references(spark.createDataFrame(refs, "src long, path string, name string"), spark.createDataFrame(symbols + symbols[:3], "symbol_id long, name string, path string"), spark.createDataFrame(imports, "path string, target string"))
    folder = lambda p: p.rpartition("/")[0]

    def nearest(src, path, name):
        scope = lambda p: 0 if p == path else 1 if (path, p) in imports else 2 if folder(p) == folder(path) else 3
        k, dst = min(((scope(p), i) for i, n, p in symbols if n == name and i != src), default=(None, None))
        return (src, path, name, dst, None if k is None else G.SCOPES[k])

    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, {nearest(*r) for r in refs}))


def put(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(map(json.dumps, rows)))


def at(minutes):
    return (T0 + dt.timedelta(minutes=minutes)).isoformat()


def test_changes_joined_to_commits_as_streams(spark, tmp_path):
    rng = random.Random(4)
    for k in range(6):  # time goes on from file to file
        put(tmp_path / "changes", f"{k}.json", [{"change_id": 100 * k + i, "ts": at(60 * k + rng.randrange(60)), "path": rng.choice(["a", "b", "c", None]), "op": "write"} for i in range(15)])
        put(tmp_path / "commits", f"{k}.json", [{"hash": f"{k}-{i}", "commit_ts": at(60 * k + rng.randrange(60)), "path": rng.choice("abd")} for i in range(8)])
    end = {"change_id": -1, "ts": at(3000), "path": "end", "op": "write"}, {"hash": "end", "commit_ts": at(3000), "path": "end"}
    put(tmp_path / "changes", "8.json", end[:1])
    put(tmp_path / "commits", "8.json", end[1:])
    put(tmp_path / "changes", "9.json", [end[0] | {"change_id": -2, "ts": at(6000)}])
    put(tmp_path / "commits", "9.json", [end[1] | {"commit_ts": at(6000)}])
    one = lambda name, schema: (spark.read.schema(schema).json(str(tmp_path / name)), spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / name)))
    changes, commits = one("changes", W.CHANGES), one("commits", W.COMMITS)
    batch = sorted(map(repr, W.followed_by_commits(changes[0], commits[0], "30 minutes", "2 hours").where("change_id >= 0").collect()))
    q = W.followed_by_commits(changes[1], commits[1], "30 minutes", "2 hours").writeStream.format("memory").queryName("followed").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(300)
    assert sorted(map(repr, spark.table("followed").where("change_id >= 0").collect())) == batch
    assert any("hash=None" in r for r in batch) and any("hash='" in r for r in batch)
    assert sum(s["numRowsTotal"] for s in q.lastProgress["stateOperators"]) <= 4  # what came before the watermark is gone


class State:
    """What the batcher asks of a stream's state, with a clock set by hand."""

    def __init__(self):
        self.value, self.exists, self.hasTimedOut, self.timer, self.now = None, False, False, None, 0

    get = property(lambda self: self.value)

    def update(self, value):
        self.value, self.exists = value, True

    def remove(self):
        self.value, self.exists, self.timer = None, False, None

    def setTimeoutTimestamp(self, t):  # noqa: N802
        self.timer = t

    def getCurrentWatermarkMs(self):  # noqa: N802
        return self.now


def feed(batcher, state, rows):
    import pandas as pd

    base = int(pd.Timestamp(T0).value // 1_000_000)
    frame = pd.DataFrame([(i, pd.Timestamp(T0) + pd.Timedelta(milliseconds=ms), op) for i, ms, op in rows], columns=["change_id", "ts", "op"])
    out = [tuple(x.iloc[0][["changes", "reason"]]) for x in batcher(("a",), iter([frame]), state)]
    return out, None if state.timer is None else state.timer - base


def test_urgent_changes_wait_half_as_long():
    b, s = W.Batcher(size=3, wait_ms=1000), State()
    assert feed(b, s, [(1, 0, "file_modify")]) == ([], 1000)
    assert feed(b, s, [(2, 100, "symbol_delete")]) == ([], 500)
    s.hasTimedOut = True
    assert [tuple(x.iloc[0][["changes", "reason"]]) for x in b(("a",), iter([]), s)] == [([1, 2], "priority")] and not s.exists
    s.hasTimedOut = False
    assert feed(b, s, [(3, 2000, "file_delete"), (4, 2600, "file_add"), (5, 2700, "unknown")]) == ([([3], "priority")], 3600)
    assert feed(b, s, [(6, 2800, "file_add"), (7, 5000, "file_add")]) == ([([4, 5, 6], "size")], 6000)
    assert feed(b, s, [(8, 7000, "file_add")]) == ([([7], "time")], 8000)
