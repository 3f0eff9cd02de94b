"""The k first rows of each question while a task reads its batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


class RunningBest:
    """Of all rows shown so far, the k of each question with the least value, ties by the lesser id.

    Holds at most k rows a question. Once a question has k, the value of its last is a bar that a later row must
    reach; rows beyond it are dropped before their ids are read.
    """

    def __init__(self, questions: int, k: int):
        self.k, self.bar = k, np.full(questions, np.inf)
        self.question, self.value, self.ids = np.empty(0, np.int64), np.empty(0), None

    def add(self, question: np.ndarray, value: np.ndarray, at: np.ndarray, ids: pa.Array) -> None:
        """Rows (question, value, ids[at])."""
        near = np.flatnonzero(value <= self.bar[question])
        if not len(near):
            return
        fresh = ids.take(pa.array(at[near]))
        question, value = np.concatenate([self.question, question[near]]), np.concatenate([self.value, value[near]])
        ids = fresh if self.ids is None else pa.concat_arrays([self.ids, fresh])
        rank = np.empty(len(ids), np.int64)  # place of each id in their order
        rank[pc.sort_indices(ids).to_numpy()] = np.arange(len(ids))
        order = np.lexsort((rank, value, question))
        question, value = question[order], value[order]
        place = np.arange(len(question)) - np.searchsorted(question, question)
        full = place == self.k - 1
        self.bar[question[full]] = value[full]
        top = place < self.k
        self.question, self.value, self.ids = question[top], value[top], ids.take(pa.array(order[top]))
