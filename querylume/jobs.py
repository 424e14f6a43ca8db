"""Independent Spark jobs side by side."""

from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target


def run_together(spark, *jobs) -> None:
    """Run the jobs at the same time, so small ones do not leave the cluster waiting
    for each other's last task. Returns when all are done; raises if any failed."""
    with ThreadPoolExecutor(len(jobs)) as pool:
        running = [pool.submit(inheritable_thread_target(spark)(job)) for job in jobs]
    for job in running:
        job.result()
