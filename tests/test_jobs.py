import threading

import pytest

from lineloom.plans import jobs as J


def test_jobs(spark):
    runner = J.Jobs(spark, parallel=2)
    good = runner.wait(runner.submit("count", lambda s: s.range(10).count()))
    assert (good.state, good.result, good.attempts) == (J.COMPLETED, 10, 1)
    bad = runner.wait(runner.submit("fail", lambda s: s.sql("SELECT raise_error('oh no')").collect()))
    assert bad.state == J.FAILED and "oh no" in bad.error
    assert runner.wait(runner.retry(bad)).attempts == 2
    with pytest.raises(ValueError):
        runner.retry(good)
    assert runner.progress(good).seconds > 0
    assert J.Progress(1, 4, 3.0).percent == 25 and J.Progress(1, 4, 3.0).seconds_left == 9 and J.Progress(0, 0, 1.0).seconds_left is None


def test_cancel(spark):
    runner, gate = J.Jobs(spark, parallel=1), threading.Event()
    first = runner.submit("wait", lambda s: gate.wait(30))
    second = runner.submit("never", lambda s: 1)
    runner.cancel(second)
    gate.set()
    assert runner.wait(first).state == J.COMPLETED
    assert runner.wait(second).state == J.CANCELLED and second.attempts == 0
    assert runner.wait(runner.retry(second)).result == 1


def test_progress_is_that_of_one_job(spark):
    runner, gate, seen = J.Jobs(spark, parallel=2), threading.Event(), []

    def other(s):
        s.range(100_000).repartition(40).count()
        gate.wait(30)

    busy = runner.submit("busy", other)
    own = runner.submit("own", lambda s: s.range(10).repartition(3).selectExpr("sum(id)").collect())
    runner.watch(own, seen.append)
    alone = runner.progress(own)
    gate.set()
    runner.wait(busy)
    assert 0 < alone.total < 40 and alone.done == alone.total and seen
    first = runner.progress(own)
    assert runner.progress(own) is first  # not looked at again so soon


def test_a_job_beyond_its_limit_has_failed(spark):
    runner = J.Jobs(spark)
    job = runner.wait(runner.submit("slow", lambda s: s.range(1 << 50).selectExpr("sum(id % 7)").collect(), limit=1.0))
    assert job.state == J.FAILED and "1 s" in job.error and job.ended - job.began < 20
    assert runner.wait(runner.submit("quick", lambda s: s.range(3).count(), limit=60)).result == 3
