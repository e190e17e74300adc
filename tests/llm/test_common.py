import random
import time

import pytest

from lectern.llm import common


@pytest.mark.parametrize("held,steps", [(500_000, False), (40, True)])
def test_components(spark, monkeypatch, held, steps):
    """Links that one task can hold are reduced there to one forest, without a join; others go by steps."""
    rng = random.Random(21)
    monkeypatch.setattr(common, "HELD", held)
    taken = []
    large_star = common._large_star
    monkeypatch.setattr(common, "_large_star", lambda e: taken.append(1) or large_star(e))
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(300 + i, 301 + i) for i in range(80)] + [(400, 401 + i) for i in range(60)] * 4
    rng.shuffle(links)
    f = common.Forest()
    for a, b in links:
        f.link(a, b)
    want = {(x, f.find(x)) for x in range(500) if f.find(x) != x}
    df = spark.createDataFrame([*links, (None, 3), (7, None)], "a long, b long").repartition(16)
    got = [tuple(r) for r in common.connected_components(df, "a", "b").collect()]
    assert set(got) == want and len(got) == len(want) and bool(taken) == steps
    assert common.connected_components(df.where("a < 0"), "a", "b").count() == 0


def test_shuffles_go(spark, tmp_path):
    """Shuffle files go with the query that made them, though its plan is still held; the setting is as before then."""
    env = spark._jvm.org.apache.spark.SparkEnv.get()
    files = lambda: sum(str(f).endswith(".data") and "shuffle_" in str(f) for f in env.blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n"))
    common.drop_shuffles(spark)
    time.sleep(2)
    before = files()
    with common.shuffles_go(spark):
        held = spark.range(10_000).repartition(5, "id")
        held.write.parquet(str(tmp_path / "a"))
    for _ in range(50):
        if files() <= before:
            break
        time.sleep(0.2)
    assert files() <= before and spark.conf.get(common.CLEANUP, None) is None
    assert spark.read.parquet(str(tmp_path / "a")).count() == held.count() == 10_000
