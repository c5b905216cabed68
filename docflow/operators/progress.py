"""Progress and cancellation of a Spark action."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable

from pyspark import InheritableThread
from pyspark.sql import SparkSession


class Aborted(RuntimeError):
    """The action was cancelled before it ended."""


def run_with_progress(spark: SparkSession, action: Callable[[], object], *, on_progress: Callable[[float], None] | None = None, should_abort: Callable[[], bool] | None = None, timeout: float | None = None, poll: float = 0.2):
    """The result of action(), run in a job group of its own: on_progress gets 0 at the start, the share of finished tasks of the stages
    begun, and 1 at the end; when should_abort says so, or after timeout seconds, its jobs are cancelled and Aborted is raised."""
    tell, sc, group = on_progress or (lambda share: None), spark.sparkContext, "docflow-" + uuid.uuid4().hex
    out: dict = {}
    done = threading.Event()

    def work():
        sc.setJobGroup(group, "docflow", interruptOnCancel=True)
        try:
            out["value"] = action()
        except Exception as e:  # noqa: BLE001
            out["error"] = e
        finally:
            done.set()

    tell(0.0)
    if should_abort and should_abort():
        raise Aborted("aborted before the start")
    thread = InheritableThread(target=work)
    thread.start()
    waited, last = 0.0, 0.0
    while not done.wait(poll):
        waited += poll
        if (should_abort and should_abort()) or (timeout is not None and waited >= timeout):
            sc.cancelJobGroup(group)
            thread.join()
            raise Aborted("timed out" if timeout is not None and waited >= timeout else "aborted")
        infos = [sc.statusTracker().getStageInfo(s) for j in sc.statusTracker().getJobIdsForGroup(group) if (job := sc.statusTracker().getJobInfo(j)) for s in job.stageIds]
        total = sum(i.numTasks for i in infos if i)
        share = min(0.99, sum(i.numCompletedTasks for i in infos if i) / total) if total else 0.0
        if share > last:
            last = share
            tell(share)
    thread.join()
    if "error" in out:
        raise out["error"]
    tell(1.0)
    return out["value"]
