from collections import Counter
from datetime import datetime, timedelta

import pytest

from sortalis.functions.predicates import ColEqConst
from sortalis.operators import zset
from sortalis.plans.ops import Delay, Diff, Filter, Integrate, Scan, execute
from sortalis.queries import QUERIES
from sortalis.sources.structure import Signature, Structure
from sortalis.streaming.context import StreamContext, batches_into


def model(spark, elements):
    return Structure(spark, Signature(["A"])).add("A", elements)


def bag(frame):
    return Counter({r.c0: r.mult for r in frame.collect()})


STEPS = [[1, 2], [2, 3], [], [2, 3]]


def test_delay_difference_and_sum(spark):
    context, total = StreamContext(), Counter()
    before = Counter()
    for i, now in enumerate(STEPS):
        m = model(spark, now)
        assert bag(context.execute(Delay(Scan("A"), "d"), m)) == before
        want = Counter(now)
        want.subtract(before)
        assert bag(context.execute(Diff(Scan("A"), "x"), m)) == Counter({k: v for k, v in want.items() if v})
        total.update(now)
        for _ in range(2):  # a second evaluation in a step changes nothing
            assert bag(context.execute(Integrate(Scan("A"), "i"), m)) == total
        assert context.step() == i + 1
        before = Counter(now)
    context.reset()
    assert context.timestep == 0 and bag(context.execute(Integrate(Scan("A"), "i"), model(spark, [9]))) == {9: 1}


def test_laws(spark):
    context = StreamContext()
    for i, now in enumerate(STEPS):
        m = model(spark, now)
        assert zset.equal(context.execute(Integrate(Diff(Scan("A"), "a"), "b"), m), execute(Scan("A"), m))
        p = ColEqConst(0, 2)
        assert zset.equal(context.execute(Filter(Diff(Scan("A"), "c"), p), m), context.execute(Diff(Filter(Scan("A"), p), "d"), m))
        context.step()
    for i in range(3):
        m = model(spark, [5])
        assert bag(context.execute(Integrate(Scan("A"), "e"), m)) == {5: i + 1}
        assert bag(context.execute(Diff(Scan("A"), "f"), m)) == ({5: 1} if not i else {})
        context.step()


def test_structured_streaming(spark, tmp_path):
    for i, now in enumerate([[1, 2], [2]]):
        spark.createDataFrame([(x,) for x in now], "x long").coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema("x long").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    seen = []
    sink = lambda frame, epoch: seen.append((epoch, bag(frame)))
    each = batches_into(Integrate(Scan("A"), "i"), lambda b: Structure(spark, Signature(["A"])).set_carrier("A", b, "x"), sink)
    q = stream.writeStream.foreachBatch(each).option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert [e for e, _ in seen] == [0, 1] and seen[-1][1] == {1: 1, 2: 2}
    each(spark.createDataFrame([(7,)], "x long"), 1)
    assert len(seen) == 2


@pytest.mark.parametrize("empty", [Scan("A")])
def test_delay_of_nothing(spark, empty):
    assert StreamContext().execute(Delay(empty, "d"), model(spark, [1])).isEmpty()


def test_queries_step_over_every_day(spark, tmp_path):
    """Eight days with a gap, and an event without a time; the first is not 2024-01-01."""
    days = [[7, 7, 8], [8], [], [7], [9], [7, 9], [], [7, 8]]
    start = datetime(2023, 12, 30)
    events = [(u, start + timedelta(days=i, hours=23)) for i, users in enumerate(days) for u in users] + [(7, None)]
    spark.createDataFrame(events, "user_id long, ts timestamp").write.parquet(f"{tmp_path}/events.parquet")
    counts = [Counter(users) for users in days]
    changes = [Counter({u: n[u] - b[u] for u in n | b if n[u] != b[u]}) for b, n in zip([Counter(), *counts], counts, strict=False)]
    want = {
        "stream_delay": [Counter(), *counts[:-1]],
        "stream_diff": changes,
        "stream_integrate": [sum(counts[: i + 1], Counter()) for i in range(len(counts))],
        "stream_filter_diff": [Counter({u: n for u, n in c.items() if u == 7}) for c in changes],
        "stream_integrate_diff": counts,
    }
    for name, steps in want.items():
        got = {(r.c0, r.step): r.mult for r in QUERIES[name](spark, str(tmp_path)).collect()}
        assert got == {(u, i): n for i, c in enumerate(steps) for u, n in c.items()}, name


def test_queries_without_events(spark, tmp_path):
    spark.createDataFrame([], "user_id long, ts timestamp").write.parquet(f"{tmp_path}/events.parquet")
    assert QUERIES["stream_integrate"](spark, str(tmp_path)).isEmpty()
