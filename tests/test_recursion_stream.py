"""The recursion kept in a stream's state against detection over the whole series."""

import datetime

import numpy as np
import pytest

from breakline.operators.detect import Spec
from breakline.streaming.recursion import Recursion, change_points

BEGIN = datetime.datetime(2024, 1, 1)


def series(seed, n=260):
    rng = np.random.default_rng(seed)
    return rng.normal(np.repeat(rng.normal(0, 4, 4), -(-n // 4))[:n], 1)


def whole(x, beta=8.0):
    return Spec("mean", beta=beta, variance_estimate=((1.0,),)).solve(x[:, None])


@pytest.mark.parametrize("seed", range(6))
def test_state_stays_small_and_finds_the_same(seed):
    x = series(seed, 400)
    r, found = Recursion(8.0, 1.0), []
    for t, v in enumerate(x):
        r.take(t, v)
        if t % 7 == 0:
            found += r.decided()
            r = Recursion(8.0, 1.0, r.state())
            assert len(r.back) <= 4 * len(r.starts) + 4
    found += r.rest()
    assert [c for c, _ in found] == whole(x) and all(c == t for c, t in found)
    r.take(5, 1.0)
    assert r.late == 1 and r.n == 400


def test_stream_of_one_and_of_many_batches(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    data = {"a": series(1), "b": series(2), "c": series(3, 5)}
    rows = [(k, BEGIN + datetime.timedelta(seconds=t), float(v)) for k, x in data.items() for t, v in enumerate(x)]
    last = [("z", BEGIN + datetime.timedelta(days=1 + d), 0.0) for d in range(3)]  # moves the watermark past all idle series
    rng, results = np.random.default_rng(0), []
    for files in (1, 6):
        where = tmp_path / f"in{files}"
        for f in range(files):
            part = [r for r in rows if int((r[1] - BEGIN).total_seconds()) * files // 260 == f]
            rng.shuffle(part)
            part = [(str(k), t, float(v)) for k, t, v in part]
            spark.createDataFrame(part, "k string, at timestamp, v double").coalesce(1).write.mode("append").parquet(str(where))
        for r in last:
            spark.createDataFrame([r], "k string, at timestamp, v double").coalesce(1).write.mode("append").parquet(str(where))
        stream = spark.readStream.schema("k string, at timestamp, v double").option("maxFilesPerTrigger", 1).parquet(str(where)).withWatermark("at", "1 second")
        q = change_points(stream, "k", "at", "v", 8.0, 1.0, 600).writeStream.format("memory").queryName(f"cps{files}").outputMode("append").option("checkpointLocation", str(tmp_path / f"cp{files}")).start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()
        results.append(sorted((r.k, r.cp, r["at"]) for r in spark.sql(f"SELECT * FROM cps{files}").collect()))
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    want = sorted((k, c, BEGIN + datetime.timedelta(seconds=c)) for k, x in data.items() for c in whole(x))
    assert results[0] == results[1] == want and want
