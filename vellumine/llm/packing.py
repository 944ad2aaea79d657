"""Filling fixed-capacity containers with items: sum-of-squares packing.

Each document goes where the sum of the squared counts of open containers per remaining room becomes smallest. Documents are
packed in parallel, one state per task: a count and a stack of containers per room, never the documents themselves. Rooms
left open by the tasks are closed in a second, much smaller round that packs whole containers as items.

Cases: null and empty texts have no token and go nowhere; a text longer than a container is divided into full containers and
a rest; repeated texts are items of their own; an empty table gives no container.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumine.session import cut

CAPACITY = 2048
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# The public splitting pattern of that vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def _encoding(path: str):  # noqa: ANN202
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("vellumine", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_batches(path: str = TOKENIZER):
    """A mapInArrow function giving (doc_id, tokens) of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoding(path)
        for batch in batches:
            n = [len(enc.encode_ordinary(t)) if t else 0 for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64())], names=["doc_id", "tokens"])

    return run


class SumOfSquares:
    """Packing state: how many open containers have each room, and which."""

    def __init__(self, capacity: int) -> None:
        self.capacity = capacity
        self.open = np.zeros(capacity + 1, np.int64)
        self.stacks: dict[int, list[int]] = {}
        self.made = 0

    def place(self, size: int) -> int:
        """The container of an item of 1 to capacity units; opens one where that keeps the squares smallest."""
        cap, n = self.capacity, self.open
        rooms = np.flatnonzero(n[size:]) + size
        best, at = 2 * int(n[cap - size]) + 1 if size < cap else 0, cap + 1
        if len(rooms):
            after = n[rooms - size].copy()
            after[rooms == size] = 0
            change = 2 * (after - n[rooms]) + np.where(rooms == size, 1 - 0, 2)
            k = int(np.argmin(change))
            if change[k] <= best:
                best, at = int(change[k]), int(rooms[k])
        if at > cap:
            box = self.made
            self.made += 1
            left = cap - size
        else:
            box = self.stacks[at].pop()
            n[at] -= 1
            left = at - size
        if left:
            self.stacks.setdefault(left, []).append(box)
            n[left] += 1
        return box


def _pack(keys: list[str], capacity: int):
    """A mapInArrow function: (keys..., size) rows of a task to (keys..., size, task, box)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        ctx = TaskContext.get()
        task = ctx.partitionId() if ctx else 0
        state = SumOfSquares(capacity)
        for batch in batches:
            boxes = [state.place(s) for s in batch.column("size").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), batch.column("size"), pa.array([task] * len(boxes), pa.int64()), pa.array(boxes, pa.int64())], names=[*keys, "size", "task", "box"])

    return run


def pack(documents: DataFrame, capacity: int = CAPACITY, tokenizer: str = TOKENIZER, close_below: float = 0.98) -> DataFrame:
    """(container, doc_id, part, size, fill): every document's container; fill is the container's content.

    part counts the pieces of a document longer than a container, from 0. Tasks pack what they read; containers less than
    close_below full are packed again as items, largest first, with those of a few other tasks.
    """
    sizes = documents.select("doc_id", "text").where("text is not null and text <> ''").mapInArrow(count_batches(tokenizer), "doc_id bigint, tokens bigint")
    whole = F.floor(F.col("tokens") / capacity).cast("bigint")
    rest = F.col("tokens") % capacity
    parts = F.concat(F.array_repeat(F.lit(capacity).cast("bigint"), whole.cast("int")), F.when(rest > 0, F.array(rest)).otherwise(F.array().cast("array<bigint>")))
    items = cut(sizes.where("tokens > 0").select("doc_id", F.posexplode(parts).alias("part", "size")))
    first = cut(items.mapInArrow(_pack(["doc_id", "part"], capacity), "doc_id bigint, part int, size bigint, task bigint, box bigint"))
    boxes = first.groupBy("task", "box").agg(F.sum("size").alias("size"))
    low = boxes.where(F.col("size") < close_below * capacity)
    # A few tasks for the second round: one per 50,000 open containers, sorted so that large ones come first.
    tasks = max(1, low.count() // 50_000 + 1)
    again = low.repartition(tasks, F.xxhash64("task", "box")).sortWithinPartitions(F.desc("size"), "task", "box")
    second = again.select(F.col("task").alias("t0"), F.col("box").alias("b0"), "size").mapInArrow(_pack(["t0", "b0"], capacity), "t0 bigint, b0 bigint, size bigint, task bigint, box bigint")
    second = second.select(F.col("t0").alias("task"), F.col("b0").alias("box"), F.concat_ws("-", F.lit("b"), "task", "box").alias("again"))
    named = first.join(second, ["task", "box"], "left").withColumn("container", F.coalesce("again", F.concat_ws("-", F.lit("a"), "task", "box")))
    fill = named.groupBy("container").agg(F.sum("size").alias("fill"))
    return named.join(fill, "container").select("container", "doc_id", "part", "size", "fill")
