import random
import uuid

import pytest

from rillfold.streaming import dedup
from tests.logs import Log, at


def brute(rows):
    best, drop = {}, set()
    for r in rows:
        try:
            key = (bytes(r[0]), uuid.UUID(r[1].strip()), r[2]) if r[2] is not None else None
        except (ValueError, AttributeError, TypeError):
            key = None
        if key is None:
            continue
        best.setdefault(key, []).append((r[12] is None, r[12], r[10]))
    for copies in best.values():
        drop |= {x[2] for x in sorted(copies, key=lambda x: (x[0], x[1] or at(0), x[2]))[1:]}
    return drop


def mess(seed=1, n=400):
    rng, log = random.Random(seed), Log()
    for i in range(n):
        s = i * 60.0
        log.add(2, rng.randint(0, 9), rng.randint(0, 5), i, s=s, seq=rng.randint(0, 1), arrived=s + rng.random() * 30)
        while rng.random() < 0.4:
            j = rng.randrange(len(log.rows))
            late = rng.choice([1, 10, 3600, 5 * 86400])
            t = log.rows[j][1]
            log.again(j, time=rng.choice([t, t.upper(), "{" + t + "}", t.replace("-", "")]), received=at((j + 1) * 60.0 + late))
    for j in range(30):  # one very often delivered
        log.again(5, received=at(500 + j % 3))
    log.again(0, received=None).again(1, time=None).again(1, time="no uuid").again(2, seq=None).again(3, stream=None)
    return log


def run(spark, tmp_path, log, files=1, order=None, **kw):
    path = str(tmp_path / "log.parquet")
    rows = log.rows if order is None else order(log.rows)
    size = -(-len(rows) // files)
    for k in range(files):
        part = Log()
        part.rows = rows[k * size : (k + 1) * size]
        part.df(spark).coalesce(1).write.mode("append").parquet(path)
    found = [r.delivery_id for r in dedup.dropped_copies(spark, path, folder=str(tmp_path / "state"), **kw).collect()]
    assert len(found) == len(set(found))
    return set(found), path


def test_one_batch(spark, tmp_path):
    log = mess()
    found, path = run(spark, tmp_path, log)
    assert found == brute(log.rows)
    kept = dedup.deduplicated(spark, path)
    assert kept.count() == len(log.rows) - len(found) and kept.columns == spark.read.parquet(path).columns


def test_batches_in_order_of_arrival(spark, tmp_path):
    log = mess(2)
    found, _ = run(spark, tmp_path, log, files=4, max_files=1, order=lambda rows: sorted(rows, key=lambda r: (r[12] is None, r[12] or at(0))))
    assert found == brute(log.rows)


def test_batches_out_of_order_are_looked_up(spark, tmp_path):
    log = mess(3)
    found, _ = run(spark, tmp_path, log, files=4, max_files=1, delay_s=3600, period_s=86400, order=lambda rows: sorted(rows, key=lambda r: -r[10]))
    assert found == brute(log.rows)


def test_ties_and_nothing(spark, tmp_path):
    log = Log().add(2, 1, 1, 1, s=1).again(0).again(0)
    assert run(spark, tmp_path, log)[0] == {2, 3}
    empty = str(tmp_path / "none.parquet")
    Log().df(spark).write.parquet(empty)
    assert dedup.dropped_copies(spark, empty).count() == 0


def test_a_second_run_takes_only_what_is_new(spark, tmp_path):
    path, state = str(tmp_path / "log.parquet"), str(tmp_path / "state")
    Log().add(2, 1, 1, 1, s=1).df(spark).coalesce(1).write.parquet(path)
    assert dedup.dropped_copies(spark, path, folder=state).count() == 0
    more = Log().add(2, 1, 1, 1, s=1, arrived=0.5, delivery=9)
    more.df(spark).coalesce(1).write.mode("append").parquet(path)
    assert [r.delivery_id for r in dedup.dropped_copies(spark, path, folder=state).collect()] == [1]
    assert {r.batch for r in dedup.read_ledger(spark, dedup.DedupRun(state, 1, 0, 0, 0)).collect()} == {0, 1}
    assert dedup.run_dedup(spark, path, folder=state) == dedup.DedupRun(state, 1, 0, 0, 0)  # nothing new, nothing done
    Log().add(2, 1, 1, 1, s=1, arrived=7, delivery=10).df(spark).coalesce(1).write.mode("append").parquet(path)
    again = dedup.run_dedup(spark, path, folder=state)
    assert (again.run, again.batches, again.looked_up) == (2, 1, 1)
    assert [r.delivery_id for r in dedup.dropped_of(spark, again, only=2).collect()] == [10]
    assert {r.delivery_id for r in dedup.dropped_of(spark, again).collect()} == {1, 10}


def test_one_run_is_several_micro_batches_and_state_expires(spark, tmp_path):
    log = Log()
    for i in range(40):
        log.add(2, i, 1, i, s=i * 3600.0)
    for i in range(0, 40, 3):
        log.again(i, received=at(i * 3600.0 + 1800)).again(i, received=at(i * 3600.0 + 40 * 3600))
    path = str(tmp_path / "log.parquet")
    log.df(spark).coalesce(1).write.parquet(path)
    run = dedup.run_dedup(spark, path, folder=str(tmp_path / "state"), delay_s=6 * 3600)
    assert run.batches > 6 and run.lost == 0 and run.looked_up == 14  # copies after 40 hours are late
    assert {r.delivery_id for r in dedup.dropped_of(spark, run).collect()} == brute(log.rows)


def test_a_run_that_broke_off_is_taken_up_again(spark, tmp_path, monkeypatch):
    log = mess(4, 40)
    path, state = str(tmp_path / "log.parquet"), str(tmp_path / "state")
    log.df(spark).coalesce(1).write.parquet(path)
    moves = []

    def move(self, old, new, whole=dedup.SharedFolder.move):
        if len(moves) == 2:
            raise OSError("lost")
        moves.append(new)
        whole(self, old, new)

    with monkeypatch.context() as m:
        m.setattr(dedup.SharedFolder, "move", move)
        with pytest.raises(OSError):
            dedup.run_dedup(spark, path, folder=state, delay_s=3600, period_s=43200)
    with monkeypatch.context() as m:  # and again after the batches, before the run is marked
        m.setattr(dedup, "_beaten", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            dedup.run_dedup(spark, path, folder=state, delay_s=3600, period_s=43200)
    assert {r.delivery_id for r in dedup.dropped_copies(spark, path, folder=state, delay_s=3600, period_s=43200).collect()} == brute(log.rows)


def test_copies_without_delivery_id(spark, tmp_path):
    path = str(tmp_path / "log.parquet")
    log = Log().add(2, 1, 1, 1, s=1).again(0, delivery=None, received=at(5)).again(0, delivery=None, received=at(0))
    log.add(2, 2, 1, 1, s=2).rows.pop()
    log.rows += [(*r[:10], None, *r[11:]) for r in Log().add(2, 2, 1, 7, s=2).again(0).rows]
    log.df(spark).write.parquet(path)
    kept = [(r.pk, r.delivery_id) for r in dedup.deduplicated(spark, path).collect()]
    # The copy that arrived first has no id: it beats the one with id, and one of the two that say the same stays.
    assert sorted(kept, key=str) == [(1, None), (2, None)]
