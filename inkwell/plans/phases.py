"""Phases of a book as DataFrame functions, run chapter by chapter with progress, confirmation and cancelling."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Callable
from contextlib import suppress
from dataclasses import dataclass, field
from threading import Event

from pyspark.sql import DataFrame, SparkSession


@dataclass
class Result:
    """What a phase did: whether it succeeded, what it says, and figures by name."""

    success: bool
    message: str = ""
    data: dict = field(default_factory=dict)


class Phase(ABC):
    """A step over one chapter. Its Spark jobs carry a tag, so cancel() stops those that run as well as what would follow."""

    name = "phase"

    def __init__(self, spark: SparkSession):
        self.spark, self._stop, self._told = spark, Event(), None

    @property
    def tag(self) -> str:
        return f"{self.name}-{id(self)}"

    def cancel(self) -> None:
        self._stop.set()
        self.spark.interruptTag(self.tag)

    def reset(self) -> None:
        self._stop.clear()

    def is_cancelled(self) -> bool:
        return self._stop.is_set()

    def on_progress(self, told: Callable[[int], None] | None) -> None:
        self._told = told

    def progress(self, percent: int) -> None:
        if self._told is not None:
            self._told(max(0, min(100, int(percent))))

    @abstractmethod
    def run(self, chapter_id: str, **options) -> Result: ...

    def __call__(self, chapter_id: str, **options) -> Result:
        """run() with the tag set; a cancelled phase does not run, and what it raises is a failure that says so."""
        if self.is_cancelled():
            return Result(False, "cancelled")
        self.spark.addTag(self.tag)
        try:
            return self.run(chapter_id, **options)
        except Exception as fault:  # noqa: BLE001  a chapter's failure is a result, not the end of the program
            return Result(False, "cancelled" if self.is_cancelled() else str(fault))
        finally:
            self.spark.removeTag(self.tag)


class TablePhase(Phase):
    """A phase that applies a DataFrame function to the chapter's rows of a table and writes the result."""

    def __init__(self, spark: SparkSession, name: str, source: DataFrame, step: Callable[[DataFrame], DataFrame], sink: Callable[[DataFrame], None], chapter: str = "chapter_id"):
        super().__init__(spark)
        self.name, self.source, self.step, self.sink, self.chapter = name, source, step, sink, chapter

    def run(self, chapter_id: str, **options) -> Result:
        self.progress(0)
        self.sink(self.source.where(self.source[self.chapter] == chapter_id).transform(self.step))
        self.progress(100)
        return Result(True, f"{self.name}: {chapter_id}")


def run_all(chapters: list, process: Callable[[object, int, int], bool], confirm: Callable[[object, object], bool] | None = None, mode: str = "manual", told: Callable[[int, int], None] | None = None, cancelled: Callable[[], bool] = lambda: False) -> bool:
    """Processes chapters in order: whether all were processed. Without chapters it is true.

    told(number, total) hears of each before it begins, and may fail unheard. process(chapter, number, total) says
    whether it did; the first that did not ends the run. Unless the mode is auto, confirm(chapter, next) is asked in
    between; a no, or a failure to ask, ends the run, and so does cancelled() before or after a chapter.
    """
    for number, chapter in enumerate(chapters, 1):
        if cancelled():
            return False
        if told is not None:
            with suppress(Exception):
                told(number, len(chapters))
        if not process(chapter, number, len(chapters)) or cancelled():
            return False
        if number < len(chapters) and mode != "auto" and confirm is not None:
            try:
                goes_on = confirm(chapter, chapters[number])
            except Exception:  # noqa: BLE001  who can't be asked has not agreed
                goes_on = False
            if not goes_on:
                return False
    return True


def evolve(characters: DataFrame, chapters: list, detect: Callable[[DataFrame, object], DataFrame], upsert: Callable[[DataFrame, DataFrame], DataFrame], written: Callable[[DataFrame, int], DataFrame]) -> DataFrame:
    """The character table after all chapters: each chapter's detection sees what those before it left.

    written(table, number) stores a state and reads it back, so that each step's plan begins at a table.
    """
    for number, chapter in enumerate(chapters):
        characters = written(upsert(characters, detect(characters, chapter)), number)
    return characters
