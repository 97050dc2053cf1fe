"""Writes that need nothing of each other, run at once: each is a few short jobs, which leave most cores idle."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager

from pyspark import inheritable_thread_target
from pyspark.sql import SparkSession


@contextmanager
def at_once(spark: SparkSession) -> Iterator[Callable[[Callable[[], object]], None]]:
    """Gives a function that starts a write beside the block, which ends when all have; an error of any goes on."""
    begun = []
    with ThreadPoolExecutor() as pool:
        yield lambda write: begun.append(pool.submit(inheritable_thread_target(spark)(write)))
    for write in begun:
        write.result()
