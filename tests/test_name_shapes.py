"""Numbers of any length keep their names apart."""

import pandas as pd

from slotwise import catalog


def test_pids_of_more_than_four_digits_stay_apart(spark, tmp_path):
    ids = [i * 400 for i in (7, 1000, 10000, 10001, 100000)]  # the pids
    events = pd.DataFrame({"event_id": ids, "ts": pd.Timestamp("2024-01-01").as_unit("us"), "user_id": 1, "event_type": "click"})
    events.to_parquet(tmp_path / "events.parquet")
    assert [tuple(r) for r in catalog.QUERIES["s32_name_shapes"](spark, str(tmp_path)).collect()] == [("log_*_click.txt", 5)]
