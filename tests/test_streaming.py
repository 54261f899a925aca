"""Streams over several files give what one batch gives."""

import random
import time

from conftest import SF

from tasador.operators.features import extract_features
from tasador.operators.incremental import cut_after_seen_streak
from tasador.queries import catalog, views
from tasador.sources.outbox import read_outbox
from tasador.streaming import jobs, state


def _split(spark, df, path, parts):
    for i in range(parts):
        df.where(f"abs(hash(id)) % {parts} = {i}").coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def _arriving(spark, schema, source, **options):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).options(**options).parquet(source)


def test_new_ids_over_batches_and_runs(spark, tmp_path):
    seen = spark.createDataFrame([(i % 50, i) for i in range(200)] + [(None, 999)], "id long, at long")
    known = spark.createDataFrame([(i,) for i in range(10)] + [(None,), (3,)], "id int")
    source = str(tmp_path / "in")
    # every file repeats ids of the others
    for i in range(4):
        seen.where(f"at % 4 = {i} or at = 999").coalesce(1).write.mode("append").parquet(source)
    sink, place = str(tmp_path / "out"), str(tmp_path / "state")
    run = lambda table: state.unseen_stream(_arriving(spark, seen.schema, source), table, sink, place, "at")
    got = lambda: sorted(r["id"] for r in spark.read.parquet(sink).collect())
    run(known)
    assert got() == list(range(10, 50))
    rows = {r["id"]: r["at"] for r in spark.read.parquet(sink).collect()}
    assert all(at % 50 == i for i, at in rows.items())
    run(known)
    assert got() == list(range(10, 50)), "a restart adds nothing"
    spark.createDataFrame([(60, 1), (20, 2), (3, 3)], seen.schema).write.mode("append").parquet(source)
    # known and met ids are in the state, no table of them is read again
    run(known.limit(0))
    assert got() == [*range(10, 50), 60]


def test_first_row_of_a_batch_by_order_then_by_row(spark, tmp_path):
    rows = spark.createDataFrame([(1, 5, "e"), (1, 2, "b"), (1, 2, "a"), (2, 1, "z")] * 3, "id long, at long, text string")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    state.unseen_stream(_arriving(spark, rows.schema, str(tmp_path / "in")), None, str(tmp_path / "out"), str(tmp_path / "state"), "at")
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted((r["id"], r["at"]) for r in got) == [(1, 2), (2, 1)]


def test_ids_recorded_elsewhere_are_followed(spark, tmp_path):
    schema = spark.createDataFrame([(1, 1)], "id long, at long").schema
    source, ids = str(tmp_path / "in"), str(tmp_path / "ids")
    put = lambda rows, path, names: spark.createDataFrame(rows, names).coalesce(1).write.mode("append").parquet(path)
    put([(1, 1), (2, 2)], source, schema)
    put([(2,)], ids, "id long")
    sink, place = str(tmp_path / "out"), str(tmp_path / "state")

    def run():
        known = spark.readStream.schema("id long").parquet(ids)
        state.unseen_stream(spark.readStream.schema(schema).parquet(source), known, sink, place, "at")

    run()
    put([(3,)], ids, "id long")
    run()
    put([(3, 3), (4, 4)], source, schema)
    run()
    assert sorted(r["id"] for r in spark.read.parquet(sink).collect()) == [1, 4]


def test_forgotten_ids_are_new_again(spark, tmp_path):
    schema = spark.createDataFrame([(1, 1)], "id long, at long").schema
    source, sink, place = (str(tmp_path / x) for x in ("in", "out", "state"))
    for at in (1, 2):
        spark.createDataFrame([(7, at)], schema).coalesce(1).write.mode("append").parquet(source)
        state.unseen_stream(_arriving(spark, schema, source), None, sink, place, "at", forget_ms=1000)
        time.sleep(2.5)
    assert sorted(r["at"] for r in spark.read.parquet(sink).collect()) == [1, 2]


def _pages(rng):
    """(run, page, pos, items, id, ref) of a few runs, and the known ids."""
    rows = []
    for run, pages in (("a", 9), ("b", 4), ("c", 1), ("d", 6)):
        for page in range(1, pages + 1):
            items = rng.randint(1, 6)
            rows += [(run, page, pos, items, rng.choice([None, *range(30)]), page * 100 + pos) for pos in range(items)]
    return rows


def test_streak_cut_does_not_depend_on_the_order_of_arrival(spark, tmp_path):
    rng = random.Random(8)
    rows, known = _pages(rng), [(i,) for i in range(16)]
    names = "run string, page long, pos int, items int, id long, ref long"
    table, ids = spark.createDataFrame(rows, names), spark.createDataFrame(known, "id long")
    batch = cut_after_seen_streak(table, ids, "run", ["page", "pos"], n=4)
    want = sorted((r["run"], r["id"], r["page"], r["pos"]) for r in batch.collect())
    assert 0 < len(want) < len({(r[0], r[4]) for r in rows})
    for attempt in range(3):
        rng.shuffle(rows)  # pages come out of order and in pieces
        place = tmp_path / str(attempt)
        for i in range(4):
            spark.createDataFrame(rows[i::4], names).coalesce(1).write.mode("append").parquet(str(place / "in"))
        state.known_flags_stream(_arriving(spark, table.schema, str(place / "in")), ids, str(place / "flags"), str(place / "s1"))
        flagged = spark.readStream.schema(state.RUN_ROWS).option("maxFilesPerTrigger", 1 + 2 * attempt).parquet(str(place / "flags"))
        for _ in range(2):  # the second run finds nothing to do
            state.streak_stream(flagged, str(place / "out"), str(place / "s2"), n=4)
        got = spark.read.parquet(str(place / "out")).collect()
        assert sorted((r["run"], r["id"], r["page"], r["pos"]) for r in got) == want


def test_a_run_with_a_lost_page_is_closed_in_time(spark, tmp_path):
    schema = spark.createDataFrame([], state.RUN_ROWS).schema
    source, sink, place = (str(tmp_path / x) for x in ("in", "out", "state"))
    rows = [("a", p, 0, 1, 10 * p, False, p) for p in (1, 2, 4, 5)] + [("a", 6, 0, 2, 99, False, 6)]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(source)
    run = lambda: state.streak_stream(_arriving(spark, schema, source), sink, place, close_ms=1500)
    got = lambda: sorted(r["id"] for r in spark.read.parquet(sink).collect())
    run()
    first = got()
    time.sleep(2)
    spark.createDataFrame([("b", 1, 0, 1, 7, False, 1)], schema).coalesce(1).write.mode("append").parquet(source)
    run()
    assert first in ([10, 20], [10, 20, 40, 50, 99]) and got() == [7, 10, 20, 40, 50, 99]
    spark.createDataFrame([("a", 3, 0, 1, 30, False, 3)], schema).coalesce(1).write.mode("append").parquet(source)
    run()
    assert got() == [7, 10, 20, 40, 50, 99], "a closed run stays closed"


def test_feature_stream_equals_batch(spark, tmp_path):
    texts = views.feature_text(views.table(spark, SF, "part"))
    stream = _split(spark, texts, str(tmp_path / "in"), 3)
    out = jobs.extract_stream(stream, extract_features, str(tmp_path / "out"), str(tmp_path / "state"))
    batch = extract_features(texts)
    assert out.exceptAll(batch).isEmpty() and batch.exceptAll(out).isEmpty()


def test_notifications_are_queued_once(spark, tmp_path):
    homes = catalog.scored(views.listings(spark, SF))
    stream = _split(spark, homes, str(tmp_path / "in"), 2)
    people = views.clients(spark, SF)
    box = str(tmp_path / "box")
    for state in ("s1", "s2"):  # the second run starts over and adds nothing
        jobs.notify_stream(stream, lambda df: df, people, box, str(tmp_path / state), catalog.with_margin)
    expected = catalog._reported(spark, SF).select("client_id", "listing_id")
    got = read_outbox(spark, box, expected)
    assert got.exceptAll(expected).isEmpty() and expected.exceptAll(got).isEmpty()
