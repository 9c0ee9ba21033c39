"""Gap statistics that run on in keyed state: batches, restarts, late events and expiry."""

import random
import shutil

import numpy as np
import pytest

from netloom.streaming import flow_stream, running

SCHEMA = "user string, at timestamp, note string"
START = 1_700_000_000_000_000


def write(spark, folder, number, rows):
    """One arriving file of (user, microseconds)."""
    values = spark.createDataFrame([(u, t, "x") for u, t in rows], "user string, us bigint, note string")
    path = folder / f"part-{number}"
    values.selectExpr("user", "timestamp_micros(us) AS at", "note").coalesce(1).write.parquet(str(path))
    for f in path.glob("*.parquet"):
        shutil.copy(f, folder / "in" / f"{number:03d}.parquet")


def advance(spark, folder, **options):
    """All arrived files, one a batch; returns the rows the sink holds."""
    stream = flow_stream.read_stream(spark, str(folder / "in"), SCHEMA, files_per_trigger=1)
    with running.keyed_state(spark):
        query = (
            running.running_gaps(stream, ["user"], "at", delay="10 seconds", **options)
            .writeStream.format("parquet").option("path", str(folder / "out"))
            .option("checkpointLocation", str(folder / "progress")).outputMode("append").trigger(availableNow=True).start()
        )
        query.awaitTermination()
    return spark.read.parquet(str(folder / "out"))


def expected(times):
    """Events, mean and deviation of the sorted times' gaps."""
    gaps = np.diff(sorted(times)) / 1e6
    gaps = np.where(gaps == 0, 1e-9, gaps)
    return len(times), gaps.mean() if len(gaps) else None, gaps.std(ddof=1) if len(gaps) > 1 else 0.0 if len(gaps) else None


def same(row, times):
    n, mean, std = expected(times)
    assert row["events"] == n and row["upto_us"] == max(times)
    assert row["gap_mean"] == pytest.approx(mean) if mean is not None else row["gap_mean"] is None
    assert row["gap_std"] == pytest.approx(std, abs=1e-9) if std is not None else row["gap_std"] is None


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "in").mkdir()
    return tmp_path


def test_running_equals_batch_after_restart(spark, folder):
    rng, rows = random.Random(4), []
    for number in range(4):  # out of order inside a batch and across the seams of panes
        base = START + number * 60_000_000
        batch = [(rng.choice(["a", "a", "a", "b", None]), base + rng.randrange(59_000_000)) for _ in range(120)]
        batch += batch[:5]  # equal times
        rng.shuffle(batch)
        rows.append(batch)
    rows[1].append(("once", START + 61_000_000))
    write(spark, folder, 0, rows[0])
    write(spark, folder, 1, rows[1])
    advance(spark, folder)
    write(spark, folder, 2, rows[2])
    write(spark, folder, 3, rows[3])
    out = advance(spark, folder)  # a new query over the same checkpoint
    seen = [r for batch in rows for r in batch]
    mark = (max(t for _, t in seen) // 1000 - 10_000) * 1000
    closed = [(u, t) for u, t in seen if t // 1_000_000 * 1_000_000 + 1_000_000 <= mark]
    assert 0 < len(closed) < len(seen)
    found = {r["user"]: r for r in running.latest(out, ["user"]).collect()}
    assert set(found) == {u for u, _ in closed} == {"a", "b", None, "once"}
    for user, row in found.items():
        same(row, [t for u, t in closed if u == user])
    # Rows of earlier batches state the numbers of their time.
    assert out.where("user = 'a'").count() > 1
    for row in out.where("user = 'a'").collect():
        same(row, [t for u, t in closed if u == "a" and t <= row["upto_us"]])


def test_late_events_are_left_out(spark, folder):
    second = 1_000_000
    write(spark, folder, 0, [("a", START + k * second) for k in range(0, 60, 5)])
    write(spark, folder, 1, [("a", START + 100 * second)])
    write(spark, folder, 2, [("a", START + 7 * second), ("a", START + 200 * second)])  # 7 s is behind the watermark of 45 s
    out = advance(spark, folder)
    row = running.latest(out, ["user"]).first()
    same(row, [START + k * second for k in [*range(0, 60, 5), 100]])


def test_silent_keys_end_and_begin_anew(spark, folder):
    second = 1_000_000
    write(spark, folder, 0, [("a", START), ("a", START + 2 * second), ("b", START + second)])
    for number in range(1, 5):  # b goes on, a is silent
        write(spark, folder, number, [("b", START + number * 60 * second)])
    advance(spark, folder, expire_seconds=90)
    write(spark, folder, 5, [("a", START + 300 * second), ("a", START + 303 * second), ("b", START + 310 * second)])
    write(spark, folder, 6, [("b", START + 350 * second), ("c", START + 350 * second)])
    out = advance(spark, folder, expire_seconds=90)
    ended = out.where("ended").collect()
    assert [(r["user"], r["events"], r["upto_us"]) for r in ended] == [("a", 2, START + 2 * second)]
    fresh = out.where(f"user = 'a' AND upto_us > {START + 10 * second}").collect()
    same(max(fresh, key=lambda r: r["events"]), [START + 300 * second, START + 303 * second])
    going = max(out.where("user = 'b'").collect(), key=lambda r: r["events"])
    same(going, [START + second, *[START + k * 60 * second for k in range(1, 5)], START + 310 * second])


@pytest.mark.parametrize("seed", range(5))
def test_fold_equals_moments_of_all_gaps(seed):
    rng = np.random.default_rng(seed)
    times = np.sort(START + rng.integers(0, 300, 200) * 100_000)
    state = None
    for part in np.split(times, np.flatnonzero(np.diff(times // 1_000_000)) + 1):
        gaps = np.diff(np.unique(part)) / 1e6
        mean = gaps.mean() if len(gaps) else 0.0
        state = running.fold(state, (part[0], part[-1], len(part), len(gaps), mean, ((gaps - mean) ** 2).sum()))
    n, mean, std = expected(times)
    assert state[0] == times[-1] and state[1] == n
    assert state[2] == pytest.approx(mean) and (state[3] / (n - 2)) ** 0.5 == pytest.approx(std)
