"""Scores of quiz sessions as keyed state of a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STATE = "answered bigint, correct bigint"
OUT = "session bigint, answered bigint, correct bigint, percent int"


def _update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    answered, correct = state.get if state.exists else (0, 0)
    for f in frames:
        answered += len(f)
        correct += int(f["correct"].fillna(False).astype(bool).sum())
    state.update((answered, correct))
    yield pd.DataFrame({"session": [key[0]], "answered": [answered], "correct": [correct], "percent": [round(100 * correct / answered) if answered else 0]})


def running_scores(answers: DataFrame) -> DataFrame:
    """The score of each session after each batch of answers (session, correct); update mode."""
    return answers.groupBy("session").applyInPandasWithState(_update, OUT, STATE, "update", GroupStateTimeout.NoTimeout)
