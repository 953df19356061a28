"""Jobs: work in the background that can be watched, cancelled, limited in time and tried again."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import dataclass, field
from time import monotonic

from pyspark.sql import SparkSession

#: Seconds between two looks at a job's progress.
THROTTLE = 0.25
QUEUED, RUNNING, COMPLETED, CANCELLED, FAILED = "queued", "running", "completed", "cancelled", "failed"


@dataclass(frozen=True)
class Progress:
    """Tasks done of those that Spark has planned so far."""

    done: int
    total: int
    seconds: float

    @property
    def percent(self) -> float:
        return 100 * self.done / self.total if self.total else 0.0

    @property
    def seconds_left(self) -> float | None:
        return self.seconds * (self.total - self.done) / self.done if self.done else None


@dataclass
class Job:
    name: str
    work: Callable[[SparkSession], object]
    state: str = QUEUED
    result: object = None
    error: str | None = None
    attempts: int = 0
    limit: float | None = None
    tag: str = field(default_factory=lambda: f"lineloom-{uuid.uuid4().hex}")
    began: float | None = None
    ended: float | None = None
    future: Future | None = None
    seen: tuple[float, Progress] | None = None


class Jobs:
    """Runs jobs, a few at a time; each one's Spark jobs carry its tag."""

    def __init__(self, spark: SparkSession, parallel: int = 2):
        self.spark, self.jobs = spark, []
        self._pool, self._lock = ThreadPoolExecutor(max(1, parallel)), threading.Lock()

    def submit(self, name: str, work: Callable[[SparkSession], object], limit: float | None = None) -> Job:
        """``limit``: seconds after which the job is stopped and has failed, as a user's pattern may need for ever."""
        job = Job(name, work, limit=limit)
        self.jobs.append(job)
        return self._start(job)

    def _start(self, job: Job) -> Job:
        job.state, job.error, job.result = QUEUED, None, None
        job.future = self._pool.submit(self._run, job)
        return job

    def _run(self, job: Job) -> None:
        with self._lock:
            if job.state == CANCELLED:
                return
            job.state, job.began, job.ended, job.seen, job.attempts = RUNNING, monotonic(), None, None, job.attempts + 1
        context = self.spark.sparkContext
        context.addJobTag(job.tag)
        late = threading.Timer(job.limit, context.cancelJobsWithTag, [job.tag]) if job.limit is not None else None
        if late:
            late.start()
        try:
            job.result = job.work(self.spark)
            end = COMPLETED
        except Exception as e:  # kept with the job; other jobs go on
            job.error, end = str(e), FAILED
            if job.limit is not None and monotonic() - job.began >= job.limit:
                job.error = f"it took more than {job.limit:g} s"
        finally:
            if late:
                late.cancel()
            context.removeJobTag(job.tag)
            job.ended = monotonic()
        with self._lock:
            if job.state != CANCELLED:
                job.state = end

    def cancel(self, job: Job) -> None:
        """What it writes does not appear: files are moved to their place at the end."""
        with self._lock:
            if job.state in (QUEUED, RUNNING):
                job.state = CANCELLED
        self.spark.sparkContext.cancelJobsWithTag(job.tag)

    def retry(self, job: Job) -> Job:
        if job.state not in (CANCELLED, FAILED):
            raise ValueError(f"the job is {job.state}")
        job.future.result()
        return self._start(job)

    def wait(self, job: Job) -> Job:
        job.future.result()
        return job

    def progress(self, job: Job) -> Progress:
        """Over the stages of this job's Spark jobs so far; looked at again after THROTTLE seconds at the earliest."""
        now = monotonic()
        if job.seen and now - job.seen[0] < THROTTLE:
            return job.seen[1]
        context = self.spark.sparkContext
        tracker, done, total = context.statusTracker(), 0, 0
        for spark_job in context._jsc.sc().statusTracker().getJobIdsForTag(job.tag):
            info = tracker.getJobInfo(spark_job)
            for stage in info.stageIds if info else ():
                found = tracker.getStageInfo(stage)
                # A job that is over has left out the stages whose results were there.
                if found and (info.status == "RUNNING" or found.numCompletedTasks):
                    done, total = done + found.numCompletedTasks, total + found.numTasks
        found = Progress(done, total, 0.0 if job.began is None else (job.ended or now) - job.began)
        job.seen = now, found
        return found

    def watch(self, job: Job, tell: Callable[[Progress], None]) -> Job:
        """``tell`` the progress every THROTTLE seconds until the job is over."""
        while not job.future.done():
            tell(self.progress(job))
            threading.Event().wait(THROTTLE)
        return self.wait(job)
