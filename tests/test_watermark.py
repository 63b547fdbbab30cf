"""The stream with a watermark: state against batch, late rows, restarts."""
import datetime as dt
import os
import tempfile

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from evlens.operators.events import daily_activity
from evlens.plans import fixture as fx
from evlens.sources.canonical import canonical_events
from evlens.streaming import watermarked as W
from evlens.streaming.daily_active import flat_event_stream
from tests.test_plans import SF


def write(folder, order, rows):
    """One file of (day, hour, user) rows; files are read in the order they were written."""
    path = os.path.join(folder, f"events_{order:02}.parquet" if order else "events.parquet")
    n = len(rows)
    pq.write_table(pa.table({
        "event_id": pa.array(range(n), pa.int64()),
        "ts": pa.array([dt.datetime(2024, 1, d) + dt.timedelta(hours=h) for d, h, _ in rows], pa.timestamp("us")),
        "user_id": pa.array([u for _, _, u in rows], pa.int64()), "event_type": pa.array(["view"] * n),
        "value": pa.array([1.0] * n), "props": pa.array(['{"k": 1}'] * n)}), path)
    os.utime(path, (1_700_000_000 + order, 1_700_000_000 + order))


def folder_of(*files):
    folder = tempfile.mkdtemp(prefix="evlens-watermark-")
    for i, rows in enumerate(files):
        write(folder, i, rows)
    return folder


def name():
    return os.path.basename(tempfile.mktemp(prefix="evlens-watermark-"))


def counts(spark, path):
    return {r["day"].day: r["dau"] for r in W.daily_active(spark, path).collect()}


def late(spark, path):
    return {r["batch"]: r["late_rows"] for r in W.late_rows(spark, path).collect()}


def test_state_equals_batch(spark):
    stream = W.run_available_now(flat_event_stream(spark, SF))
    batch = daily_activity(canonical_events(spark, SF), fx.START, fx.END)
    assert sorted(map(tuple, stream.collect())) == sorted(map(tuple, batch.collect()))


def test_duplicates_across_batches_and_out_of_order_within_the_delay(spark):
    folder = folder_of([(3, 0, 1), (3, 23, 1), (3, 5, 2)], [(4, 1, 1), (3, 22, 1), (3, 1, 2), (3, 2, 3)], [(4, 23, 1), (5, 0, 1), (4, 2, 9)])
    path = W.drain(flat_event_stream(spark, folder, 1), name(), "2 days")
    assert counts(spark, path) == {3: 3, 4: 2, 5: 1}
    assert set(late(spark, path).values()) == {0}


def test_null_users_make_a_day_without_users(spark):
    folder = folder_of([(3, 0, None), (4, 1, 7), (4, 2, None)])
    assert counts(spark, W.drain(flat_event_stream(spark, folder, 1), name())) == {3: 0, 4: 1}


def test_late_rows_are_counted_aside(spark):
    folder = folder_of([(20, 0, 1)], [(20, 5, 2)], [(3, 0, 1), (3, 1, 2), (19, 12, 3)], [(21, 0, 1)])
    path = W.drain(flat_event_stream(spark, folder, 1), name(), "1 day")
    assert counts(spark, path) == {20: 2, 19: 1, 21: 1}
    found = late(spark, path)
    assert sum(found.values()) == 2 and found[2] == 2
    rows = {r["batch"]: r for r in W.late_rows(spark, path).collect()}
    assert rows[2]["input_rows"] == 3 and rows[2]["watermark"].startswith("2024-01-19T05")


def test_restart_keeps_the_state_and_the_watermark(spark):
    folder, where = folder_of([(20, 0, 1), (20, 1, 2)]), name()
    first = W.drain(flat_event_stream(spark, folder, 1), where)
    assert counts(spark, first) == {20: 2}
    write(folder, 7, [(20, 9, 1), (20, 10, 3), (2, 0, 4)])
    again = W.drain(flat_event_stream(spark, folder, 1), where)
    assert again == first and counts(spark, again) == {20: 3}
    assert sum(late(spark, again).values()) == 1
    assert W.drain(flat_event_stream(spark, folder, 1), where) == first and counts(spark, first) == {20: 3}


def test_a_batch_that_is_run_again_replaces_its_counts(spark):
    folder, where = folder_of([(20, 0, 1), (20, 1, 2)], [(20, 3, 3)]), name()
    path = W.drain(flat_event_stream(spark, folder, 1), where)
    commits = os.path.join(path, "progress", "commits")
    last = max(int(f) for f in os.listdir(commits) if f.isdigit())
    for f in (str(last), f".{last}.crc"):                     # as if the process had been lost before the commit
        if os.path.exists(os.path.join(commits, f)):
            os.remove(os.path.join(commits, f))
    assert counts(spark, W.drain(flat_event_stream(spark, folder, 1), where)) == {20: 3}


@pytest.mark.parametrize("delay", ["12 hours", "0 days", "", "1 day; x"])
def test_short_delays_are_refused(spark, delay):
    with pytest.raises(ValueError):
        W.day_user_pairs(flat_event_stream(spark, SF), delay)
