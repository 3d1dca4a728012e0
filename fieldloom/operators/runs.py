"""Iterations that can be stopped and go on: a state stored for each step, jobs under a tag."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from ..shared import create_text, read_text


class Cancelled(Exception):
    """A run was cancelled between or within its steps."""


class Run:
    """Steps of a run in a folder of any store that Spark reads.

    A step's state is JSON and is written once, under the step's number; of two drivers that write the same step one
    fails.  advance() goes on behind the last step that is there, so what was done before a driver was lost is not done
    again.  Spark jobs of a step carry the run's tag, by which cancel() ends them from any thread of the driver.
    """

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder, self.tag, self.cancelled = spark, folder.rstrip("/"), f"run-{uuid.uuid4().hex}", False

    def _path(self, step: int) -> str:
        return f"{self.folder}/step-{step:06d}.json"

    def last(self) -> tuple[int, Any]:
        """(number, state) of the last step, (-1, None) before the first."""
        found = -1, None
        while (text := read_text(self.spark, self._path(found[0] + 1))) is not None and text.endswith("}"):
            found = found[0] + 1, json.loads(text)["state"]
        return found

    def advance(self, begin: Any, step: Callable[[int, Any], tuple[Any, bool]], most: int) -> tuple[int, Any, str]:
        """(steps, state, why it ended): step(k, state) gives the next state and whether it is the end."""
        done, state = self.last()
        state = begin if done < 0 else state["value"]
        ended = done >= 0 and self.last()[1]["end"]
        self.spark.sparkContext.addJobTag(self.tag)
        try:
            while not ended and done + 1 < most:
                if self.cancelled:
                    return done + 1, state, "cancelled"
                try:
                    state, ended = step(done + 1, state)
                except Exception:
                    if self.cancelled:  # its jobs were ended
                        return done + 1, state, "cancelled"
                    raise
                done += 1
                create_text(self.spark, self._path(done), json.dumps({"state": {"value": state, "end": bool(ended)}}))
        finally:
            self.spark.sparkContext.removeJobTag(self.tag)
        return done + 1, state, "converged" if ended else "steps"

    def cancel(self) -> None:
        self.cancelled = True
        self.spark.sparkContext.cancelJobsWithTag(self.tag)


def descent(run: Run, rows: DataFrame, x: str, y: str, steps: int, rate: float, cap: float, stop: float = 1e-6) -> tuple[int, list[float], str]:
    """Logistic gradient descent over all rows, a step of the run for each step of it: (steps, weights, why it ended)."""
    from .studies import descend

    first = rows.selectExpr(f"size({x}) as d").first()

    def step(_: int, w: list[float]) -> tuple[list[float], bool]:
        new, history = descend(rows, x, y, 1, rate, cap, stop, start=w)
        return new.tolist(), bool(history) and history[-1][-1] == "converged"

    return run.advance([0.0] * (first.d if first else 0), step, steps)
