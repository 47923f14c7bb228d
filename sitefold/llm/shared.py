"""Where operators keep written tables, and how they choose between a broadcast and a shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import cut, new_path, remove, shared_dir

__all__ = ["BROADCAST_ROWS", "cut", "filesystem", "free_name", "new_path", "remove", "shared_dir", "small_or_shuffled"]

#: Rows up to which a narrow side (a key and a few numbers) is broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 2_000_000


def small_or_shuffled(side: DataFrame, rows: int | None = None, most: int = BROADCAST_ROWS) -> DataFrame:
    """side with a broadcast hint if it has few enough rows, else as it is, so that Spark shuffles both sides."""
    n = side.count() if rows is None else rows
    return F.broadcast(side) if n <= most else side


def free_name(taken: list[str], name: str) -> str:
    """name, or name with underscores in front until no column has it (Spark's names ignore case)."""
    low = {x.lower() for x in taken}
    while name.lower() in low:
        name = "_" + name
    return name


def filesystem(path: str):
    """pyarrow's file system for a path of the shared folder, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))
