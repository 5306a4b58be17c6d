import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from isospark.streaming import scan, session, stateful

BEGIN = datetime.datetime(2026, 1, 1)


def made(kind):
    """Rows of three sessions, one of which has most of them; several at one time."""
    rng = np.random.default_rng(11)
    rows, seq = [], 0
    for s, n in ((1, 60), (2, 9), (3, 14)):
        for k in range(n):
            seq += 1
            inputs = {
                "clock": (bool(rng.random() < 0.2), float(rng.choice([0.03, 0.3]))),
                "scrub": (str(rng.choice(["tick", "tick", "down", "move", "up", "cancel", "input", "toggle"])), int(rng.integers(2)), float(rng.choice([3.0, 17.5])), float(rng.choice([0.03, 0.3]))),
                "zoom": (str(rng.choice(["in", "out", "wheel", "reset", "touchstart", "touchmove", "touchmove", "touchend", "touchcancel"])), float(rng.choice([40, 150, -300])), int(rng.choice([1, 2, 2]))),
                "levels": (float(rng.choice([0.05, 0.1])), int(rng.integers(4))),
            }[kind]
            rows.append((s, BEGIN + datetime.timedelta(milliseconds=700 * (k // 2)), seq, *inputs))
    return rows


INPUTS = {"clock": "toggle boolean, delta double", "scrub": "action string, pointer int, position double, delta double", "zoom": "action string, amount double, touches int", "levels": "delta double, desired int"}


def batch(kind, df):
    order = ["ts", "seq"]
    if kind == "clock":
        return session.clock(df, "session", order, "delta", F.col("toggle")).select("session", "seq", "playing", "time")
    if kind == "scrub":
        return session.scrub(df, "session", order, F.col("action"), F.col("pointer"), F.col("position"), F.col("delta")).select("session", "seq", "playing", "scrubbing", "time")
    if kind == "zoom":
        return scan.zoom_scan(df, "session", order, ["session", "seq"], "session long, seq long")
    return session.lod_fold(df, "session", order, ["session", "seq"], "session long, seq long, level int, coarse int, fine int, progress double, direction int")


@pytest.mark.parametrize("kind", ["clock", "scrub", "zoom", "levels"])
def test_stream_equals_batch_under_shuffled_arrival(spark, tmp_path, kind):
    """Rows arrive in any order over several micro-batches, within the lateness; each gives the row of the batch operator."""
    rows = made(kind)
    schema = f"session long, ts timestamp, seq long, {INPUTS[kind]}"
    want = {tuple(r)[:2]: tuple(r)[2:] for r in batch(kind, spark.createDataFrame(rows, schema)).collect()}
    rng = np.random.default_rng(3)
    # Within the lateness of a minute any order will do; a row of another session, much later, moves the watermark on.
    shuffled = [rows[k] for k in rng.permutation(len(rows))]
    end = [(9, BEGIN + datetime.timedelta(hours=1), 10_000 + k, *rows[0][3:]) for k in range(2)]
    for part in [*(shuffled[k : k + 30] for k in range(0, len(rows), 30)), end[:1], end[1:]]:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    spark.conf.set(*stateful.PROVIDER)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = stateful.session_stream(stream, kind, lateness="1 minute")
    query = out.writeStream.format("memory").queryName(f"states_{kind}").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    got = spark.table(f"states_{kind}").where("session < 9").collect()
    assert len(got) == len(rows)
    for r in got:
        values = tuple(r)[2:5] if kind == "scrub" else tuple(r)[2:]
        assert values == pytest.approx(want[tuple(r)[:2]], abs=1e-9)
