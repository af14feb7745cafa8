"""State in the stream's own checkpoint, and listings in pages."""

import json
import time
from datetime import datetime

import pytest
from conftest import SF

from concord.sources.paged import register
from concord.streaming.stateful import current, follow_changes


def as_set(df):
    return {tuple(r) for r in df.collect()}


@pytest.fixture
def fed(spark, tmp_path):
    """feed(rows): one more file of observations, taken in; gives all changes so far and what is there."""
    given, out = tmp_path / "in", str(tmp_path / "feed")
    given.mkdir()
    schema = "key string, checksum string, seq long, terminal boolean"
    stream = spark.readStream.schema(schema).parquet(str(given))
    told = set()

    def feed(rows, hold_s=3600):
        if rows is not None:
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(given))
        follow_changes(stream, out, str(tmp_path / "checkpoint"), hold_s=hold_s).awaitTermination()
        now = as_set(spark.read.parquet(out).select("key", "change", "checksum", "was", "seq"))
        new = now - told
        told.update(now)
        return new, as_set(current(spark, out).select("key", "checksum"))

    return feed


def test_stateful_comparison_of_batches(fed):
    new, there = fed([("a", "1", 1, True), ("b", "1", 2, True), ("a", "2", 3, True), (None, "x", 9, True)])
    assert new == {("a", "upsert", "1", None, 1), ("a", "upsert", "2", "1", 3), ("b", "upsert", "1", None, 2)} and there == {("a", "2"), ("b", "1")}
    assert fed(None) == (set(), there)  # nothing new
    # a deletion, a value that is the same again, a replayed and a late row
    new, there = fed([("b", None, 4, True), ("a", "2", 5, True), ("a", "2", 5, True), ("a", "1", 2, True)])
    assert new == {("b", "deleted", None, "1", 4), ("a", "late", "1", "2", 2)} and there == {("a", "2")}
    # what is late doesn't bring back what was deleted
    assert fed([("b", "0", 3, True)]) == ({("b", "late", "0", None, 3)}, {("a", "2")})


def test_stateful_comparison_holds_back(fed):
    assert fed([("a", "1", 1, True), ("a", "2", 2, False), ("a", "3", 3, True), ("b", "1", 4, True)])[1] == {("a", "1"), ("b", "1")}
    assert fed([("a", "4", 5, True)])[1] == {("a", "1"), ("b", "1")}
    new, there = fed([("a", "2", 2, True)])
    assert new == {("a", "upsert", "2", "1", 2), ("a", "upsert", "3", "2", 3), ("a", "upsert", "4", "3", 5)} and there == {("a", "4"), ("b", "1")}


def test_what_is_held_for_too_long_is_given_up(fed):
    fed([("a", "1", 1, False), ("a", "2", 2, True)], hold_s=1)
    time.sleep(2)
    new, there = fed([("z", "1", 3, True)], hold_s=1)
    assert new >= {("z", "upsert", "1", None, 3), ("a", "given_up", None, None, 1), ("a", "upsert", "2", None, 2)} and there == {("a", "2"), ("z", "1")}


def write_pages(folder, rows, size, first=0, link=True):
    """Pages of rows; more pages can be linked to them later."""
    folder.mkdir(exist_ok=True)
    tokens = [("start" if i + first == 0 else f"p{i + first}") for i in range(-(-len(rows) // size))]
    for i, token in enumerate(tokens):
        page = {"items": rows[i * size : (i + 1) * size]}
        if i + 1 < len(tokens):
            page["next_page_token"] = tokens[i + 1]
        (folder / f"{token}.json").write_text(json.dumps(page))
    if first and link:
        before = folder / ("start.json" if first == 1 else f"p{first - 1}.json")
        before.write_text(json.dumps(json.loads(before.read_text()) | {"next_page_token": tokens[0]}))
    return len(tokens)


SCHEMA = "listing string, event_id long, ts timestamp_ntz, event_type string, value double"


def test_events_in_pages_are_the_table(spark, tmp_path):
    register(spark)
    table = spark.read.parquet(f"{SF}/events.parquet").selectExpr("concat('u', user_id % 3) AS listing", "event_id", "ts", "event_type", "value")
    want = as_set(table)
    rows = {}
    for r in sorted(want, key=lambda r: r[1]):
        rows.setdefault(r[0], []).append({"event_id": r[1], "ts": r[2].isoformat(), "event_type": r[3], "value": r[4]})
    for listing, items in rows.items():
        write_pages(tmp_path / listing, items, 40)
    load = lambda **o: spark.read.format("concord_pages").schema(SCHEMA).options(**o).load(str(tmp_path))
    assert as_set(load()) == want and load().rdd.getNumPartitions() == 3
    one = load().where("listing = 'u1' AND value > 1")
    assert as_set(one) == {r for r in want if r[0] == "u1" and r[4] > 1} and one.rdd.getNumPartitions() == 1
    with pytest.raises(Exception, match="has over 2 pages"):
        load(maxPages=2).collect()
    (tmp_path / "none").mkdir()
    with pytest.raises(Exception, match="start.json"):
        load().collect()
    assert as_set(load(missingIsEmpty="true")) == want
    (tmp_path / "none" / "start.json").write_text('{"items": [], "next_page_token": "start"}')
    with pytest.raises(Exception, match="comes back to page"):
        load().collect()


def test_pages_as_a_stream_go_on_from_their_cursors(spark, tmp_path):
    register(spark)
    pages, out = tmp_path / "pages", str(tmp_path / "out")
    pages.mkdir()
    item = lambda i: {"event_id": i, "ts": "2024-01-01T00:00:00", "event_type": "x", "value": 0.5}
    stream = spark.readStream.format("concord_pages").schema(SCHEMA).load(str(pages))

    def run():
        query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "c")).start()
        try:
            query.processAllAvailable()
        finally:
            query.stop()
        return sorted((r["listing"], r["event_id"]) for r in spark.read.schema(SCHEMA).parquet(out).collect())

    n = write_pages(pages / "a", [item(i) for i in range(5)], 2)
    assert run() == [("a", i) for i in range(5)]
    write_pages(pages / "a", [item(i) for i in range(5, 8)], 2, first=n)
    write_pages(pages / "b", [item(9)], 2)
    assert run() == [("a", i) for i in range(8)] + [("b", 9)]
    assert run() == [("a", i) for i in range(8)] + [("b", 9)]
    row = spark.read.schema(SCHEMA).parquet(out).first()
    assert row["ts"] == datetime(2024, 1, 1) and row["value"] == 0.5
