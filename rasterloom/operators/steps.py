"""Named table steps: the extension point for user transforms."""
from __future__ import annotations

from collections.abc import Callable, Collection, Mapping, Sequence

from pyspark.sql import DataFrame

Step = tuple[str, Callable[..., DataFrame], Mapping[str, object]]


def apply_steps(df: DataFrame, steps: Sequence[Step], skip: Collection[str] = ()) -> DataFrame:
    """Apply (name, function, keyword arguments) in order, leaving out the names in ``skip``.

    Steps are plain functions DataFrame -> DataFrame, so the whole chain stays one lazy plan.
    """
    unknown = set(skip) - {name for name, _, _ in steps}
    if unknown:
        raise KeyError(f"no step named {sorted(unknown)}")
    for name, fn, kwargs in steps:
        if name not in skip:
            df = fn(df, **kwargs)
    return df
