"""Listing windows as a stream: in order, none twice, none lost."""

from __future__ import annotations

import datetime as dt
import http.server
import threading

import pytest

from pathloom.operators import tracks
from pathloom.plans import sync
from pathloom.sources import windows

D = dt.date


def test_windows_of_days():
    one = lambda day, end: windows.window_from(day, end, D(2024, 1, 5), 7)
    assert one(D(2024, 1, 5), D(2024, 3, 2)) == (D(2024, 1, 5), D(2024, 1, 31), D(2024, 1, 5))
    assert one(D(2024, 2, 1), D(2024, 3, 2)) == (D(2024, 2, 1), D(2024, 2, 29), D(2024, 1, 25))
    assert one(D(2024, 3, 1), D(2024, 3, 2)) == (D(2024, 3, 1), D(2024, 3, 2), D(2024, 2, 23))
    assert one(D(2024, 3, 3), D(2024, 3, 2)) is None


def test_a_restart_goes_on_behind_the_last_window(spark, tmp_path):
    done, checkpoint = [], str(tmp_path / "c")

    def each(window):
        row = window.first()
        if row["from_date"] == D(2024, 3, 1) and "broken" not in done:
            done.append("broken")
            raise RuntimeError("no service")
        done.append((row["from_date"], row["to_date"]))

    windows.follow_windows(spark, "2024-01-05", each, checkpoint, "2024-02-10")
    assert done == [(D(2024, 1, 5), D(2024, 1, 31)), (D(2024, 2, 1), D(2024, 2, 10))]
    windows.follow_windows(spark, "2024-01-05", each, checkpoint, "2024-02-10")
    assert len(done) == 2
    with pytest.raises(Exception, match="no service"):
        windows.follow_windows(spark, "2024-01-05", each, checkpoint, "2024-04-03")
    assert done[2:] == [(D(2024, 2, 11), D(2024, 2, 29)), "broken"]
    windows.follow_windows(spark, "2024-01-05", each, checkpoint, "2024-04-03")
    assert done[4:] == [(D(2024, 3, 1), D(2024, 3, 31)), (D(2024, 4, 1), D(2024, 4, 3))]


def test_tasks_fetch_what_a_window_lists(spark):
    asked = []

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            asked.append(self.path)
            self.send_response(200)
            self.end_headers()
            self.wfile.write(self.path.encode())

        def log_message(self, *_):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    window = spark.createDataFrame([(D(2024, 2, 1), D(2024, 2, 29), D(2024, 1, 25))], windows.WINDOW)
    rows = windows.listed(window, f"http://127.0.0.1:{server.server_port}/list").collect()
    server.shutdown()
    assert [r["body"] for r in rows] == ["/list?oldest=2024-01-25&newest=2024-02-29"] and len(asked) == 1


def test_a_sync_follows_the_windows(spark, tmp_path):
    days = {1: D(2024, 1, 10), 2: D(2024, 2, 3), 3: D(2024, 2, 9), 4: D(2024, 2, 12), 5: D(2024, 3, 1)}
    late, fetched = {6: D(2024, 2, 8)}, []
    known = dict(days)

    def list_window(window):
        w = window.first()
        rows = [(k, d, dt.datetime(d.year, d.month, d.day), "Run", False, True) for k, d in known.items() if w["list_from"] <= d <= w["to_date"]]
        return spark.createDataFrame(rows, "id long, day date, start_at timestamp, type string, stub boolean, has_latlng boolean")

    def fetch(ids):
        some = [r["track"] for r in ids.collect()]
        fetched.extend(some)
        return spark.createDataFrame([(k, s, 1.0 + s, 1.0) for k in some for s in (0, 1)], "track long, seq long, x double, y double")

    boxes = tracks.box_corners(spark.createDataFrame([(1, 0.0, 0.0, 9.0, 9.0)], "network_id long, x_min double, y_min double, x_max double, y_max double")).select("network_id", "corners")
    args = (list_window, fetch, boxes, "2024-01-05", ["Run"], str(tmp_path / "runs"), str(tmp_path / "c"))
    sync.follow(spark, *args, end="2024-02-10")
    assert sorted(fetched) == [1, 2, 3]
    known |= late  # listed late: the next window lists seven days again
    sync.follow(spark, *args, end="2024-03-02")
    assert sorted(fetched) == [1, 2, 3, 4, 5, 6]
    schema = "id long, start_at timestamp, status string, network_id long"
    assert sorted(r["id"] for r in sync.stored(spark, str(tmp_path / "runs"), schema).collect()) == [1, 2, 3, 4, 5, 6]
