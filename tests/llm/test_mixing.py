from collections import defaultdict

from lectern.llm import mixing


def rows(spark, data):
    return spark.createDataFrame(data, "doc_id long, text string, source string, k int, size string")


def water(sizes):
    """Targets by resharing step by step."""
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        left = total - sum(3 * sizes[s] for s in capped)
        free = [s for s in names if s not in capped]
        t = {s: 3.0 * sizes[s] for s in capped} | {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if t[s] > 3 * sizes[s]}
        if not over:
            return t
        capped |= over


def test_targets_and_plays(spark):
    data = [(i, "w " * (i % 60), f"s{i % 7}" if i % 7 else None, 1, "x") for i in range(400)]
    data += [(1000, "lone word", "tiny", 0, ""), (1001, None, "tiny", 0, ""), (1002, "a " * 5000, "é", 0, ""), (1002, "a " * 5000, "é", 0, ""), (None, " \n", None, 0, "")]
    got = [r.asDict() for r in mixing.mix(rows(spark, data)).collect()]
    assert len(got) == len(data)
    sizes, taken = defaultdict(int), defaultdict(int)
    for _, text, source, _, _ in data:
        sizes[source] += len((text or "").split())
    for r in got:
        taken[r["source"]] += r["taken"]
        assert 0 <= r["taken"] <= 3 * r["size"]
        assert r["source_size"] == sizes[r["source"]]
    for s, t in water(sizes).items():
        assert all(abs(r["target"] - t) < 1e-6 * max(t, 1) for r in got if r["source"] == s)
        assert abs(taken[s] - t) <= 4 * mixing.BLOCK, (s, taken[s], t)
    again = [r.asDict() for r in mixing.mix(rows(spark, data).repartition(5)).collect()]
    key = lambda r: str(sorted(r.items(), key=str))
    assert sorted(map(key, got)) == sorted(map(key, again))


def test_small_sources_come_near_their_targets(spark):
    data = [(0, "w " * 5, "a", 1, ""), (1, "w " * 40, "b", 1, ""), (2, "w " * 200, "c", 1, "")] + [(10 + i, "w " * 300, "d", 1, "") for i in range(40)]
    got = [r.asDict() for r in mixing.mix(rows(spark, data)).collect()]
    taken = defaultdict(int)
    for r in got:
        taken[r["source"]] += r["taken"]
        assert 0 <= r["taken"] <= 3 * r["size"]
    target = {r["source"]: r["target"] for r in got}
    assert target["b"] == 120 and target["c"] == 600
    assert all(abs(taken[s] - target[s]) <= mixing.BLOCK for s in target), (taken, target)


def test_stays_native(spark, capsys):
    mixing.mix(rows(spark, [(1, "a b", "s", 1, "")])).explain("formatted")
    plan = capsys.readouterr().out
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_own_columns_stay(spark):
    d = spark.createDataFrame([(1, "w " * 64, "a", 5, 6, 7)], "doc_id long, text string, source string, _id int, plays int, row int")
    assert [tuple(r)[3:] for r in mixing.resample(d).collect()] == [(5, 6, 7)]


def test_without_words(spark):
    assert mixing.mix(rows(spark, [])).count() == 0
    got = mixing.mix(rows(spark, [(1, None, None, 1, ""), (2, "", "a", 1, "")])).collect()
    assert sorted((r.doc_id, r.size, r.taken) for r in got) == [(1, 0, 0), (2, 0, 0)]


def test_resample_keeps_columns(spark):
    d = rows(spark, [(i, "w " * 40, "a" if i < 50 else "b", 1, "x") for i in range(100)])
    got = mixing.resample(d)
    assert got.columns == d.columns
    n = defaultdict(int)
    for r in got.collect():
        n[r.source] += 1
    assert abs(n["a"] - 33) <= 3 and abs(n["b"] - 67) <= 3
