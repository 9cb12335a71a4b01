"""Argument checks, folder listings and other small helpers."""

from __future__ import annotations

import os
import time
from collections.abc import Callable
from functools import wraps
from typing import Any

import numpy as np


#: Names of the byte units.
UNITS = ("b", "Kb", "Mb", "Gb", "Tb", "Pt")


def format_byte_size(size: float) -> tuple[float, str]:
    """Value and unit; a value of exactly 1024 keeps its unit."""
    k = 0
    while size > 1024 and k < len(UNITS) - 1:
        size, k = size / 1024, k + 1
    return size, UNITS[k]


def find_datasets(path: Any) -> dict[str, str]:
    """Everything below a folder by name; nothing if the argument is no folder."""
    if not isinstance(path, str) or not os.path.isdir(path):
        return {}
    return {name: os.path.join(path, name) for name in sorted(os.listdir(path))}


def existing_path(path: str, folder: bool = True) -> str:
    """The path, without a trailing separator if it is a folder; it must exist."""
    if not os.path.exists(path):
        raise ValueError(f"no such path: {path}")
    return path[:-1] if folder and path.endswith(os.sep) and len(path) > 1 else path


def str_or_list(value: Any, name: str) -> list[str]:
    """The argument as a list of at least one string."""
    if isinstance(value, str):
        return [value]
    if isinstance(value, list) and value and all(isinstance(x, str) for x in value):
        return value
    raise ValueError(f"{name} must be a string or a non-empty list of strings")


def larger_than(value: float, limit: float, name: str) -> None:
    if value <= limit:
        raise ValueError(f"{name} must be larger than {limit}, not {value}")


def int_larger_than(value: Any, limit: int, name: str) -> None:
    if not isinstance(value, int) or isinstance(value, bool):
        raise ValueError(f"{name} must be an integer")
    larger_than(value, limit, name)


def without_repeats(sequence: list) -> list:
    """The sequence with runs of equal values shortened to one."""
    return [x for i, x in enumerate(sequence) if i == 0 or x != sequence[i - 1]]


def timed(func: Callable[..., dict]) -> Callable[..., dict]:
    """The function, whose dictionary also holds its ``execution_time`` in seconds."""

    @wraps(func)
    def run(*args: Any, **kwargs: Any) -> dict:
        began = time.time()
        return func(*args, **kwargs) | {"execution_time": time.time() - began}

    return run


class EarlyStopping:
    """True once a loss has not improved by the relative ``min_delta`` for ``patience`` calls."""

    def __init__(self, patience: int = 40, min_delta: float = 1e-4, save: Callable[[], None] | None = None):
        self.patience, self.min_delta, self.save = patience, min_delta, save
        self.best, self.count, self.stop = float("inf"), 0, False

    def __call__(self, loss: float) -> bool:
        if loss < self.best * (1 - self.min_delta):
            self.best, self.count = loss, 0
            if self.save:
                self.save()
        else:
            self.count += 1
            self.stop = self.count >= self.patience
        return self.stop


def with_second_axis(x: np.ndarray, last: bool = False) -> np.ndarray:
    """A vector as one row, or with ``last`` as one column; arrays of more dimensions as they are."""
    return x if x.ndim != 1 else x[:, None] if last else x[None]
