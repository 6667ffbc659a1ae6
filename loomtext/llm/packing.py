"""Problem 7: texts, measured in tokens, put into containers of fixed capacity with little unused space.

Bounded-space online packing: each partition keeps a fixed number of open windows for each capacity, places an item
best-fit, and emits the fullest window when none fits. The windows still open at the end of the partitions are then
packed themselves, in rounds over ever fewer parts of each spec, so no task gets more than a bounded number of them.

An item longer than the capacity is cut into parts of the capacity and a rest; no other item is split. A text of no
tokens (null, empty) stands in a container with part 0 and size 0. Specs with a null or non-positive capacity or an
unknown tokenizer raise ValueError. Repeated rows are items of their own. Container ids don't depend on retries.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.llm.bpe import TOKENIZERS, sizes
from loomtext.session import written

#: Open windows of each partition and spec; windows that one task of a later round takes.
OPEN_WINDOWS = 256
FAN_IN = 16
#: A table of specs is a small list of settings.
MAX_SPECS = 1000


class Windows:
    """The open windows of one spec: (free space, number), ordered by free space."""

    def __init__(self, capacity: int, limit: int):
        self.capacity, self.limit = capacity, limit
        self.open: list[tuple[int, int]] = []
        self.made = 0

    def place(self, size: int) -> tuple[int, list[int]]:
        """The number of the window that takes the item; numbers of windows that are thereby closed."""
        closed = []
        at = bisect_left(self.open, (size, -1))
        if at < len(self.open):
            free, number = self.open.pop(at)
        else:
            if len(self.open) >= self.limit:
                closed.append(self.open.pop(0)[1])  # the fullest
            free, number = self.capacity, self.made
            self.made += 1
        if free == size and size:
            closed.append(number)
        else:
            insort(self.open, (free - size, number))
        return number, closed


def _place_items(limit: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Rows (spec_id, capacity, doc_id, part, start_token, n_tokens) with their window; at the end the open windows."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pid, by_spec = TaskContext.get().partitionId(), {}
        columns = ["spec_id", "capacity", "doc_id", "part", "start_token", "n_tokens"]
        for frame in frames:
            names = []
            for spec, capacity, n in zip(frame["spec_id"], frame["capacity"], frame["n_tokens"], strict=True):
                w = by_spec.get(spec)
                if w is None:
                    w = by_spec[spec] = Windows(int(capacity), limit)
                names.append(f"{spec}-{pid}-{w.place(int(n))[0]}")
            yield frame[columns].assign(window_id=names, open_fill=-1)
        rest = [(s, w.capacity, None, 0, 0, 0, f"{s}-{pid}-{number}", w.capacity - free) for s, w in by_spec.items() for free, number in w.open]
        out = pd.DataFrame(rest, columns=[*columns, "window_id", "open_fill"])
        yield out.astype({"doc_id": "Int64"})

    return run


def _merge_windows(step: int, last: bool, limit: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Packs windows (spec_id, capacity, members, fill) as items; open_fill of a result is null where it is finished."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pid, by_spec = TaskContext.get().partitionId(), {}
        for frame in frames:
            done = []
            for spec, capacity, members, fill in zip(frame["spec_id"], frame["capacity"], frame["members"], frame["fill"], strict=True):
                w, held = by_spec.setdefault(spec, (Windows(int(capacity), limit), {}))
                number, closed = w.place(int(fill))
                held.setdefault(number, []).extend(members)
                done += [(spec, w.capacity, held.pop(c), w.capacity, True, f"{spec}-m{step}-{pid}-{c}") for c in closed]
            yield pd.DataFrame(done, columns=["spec_id", "capacity", "members", "fill", "closed", "container_id"])
        rest = [(s, w.capacity, held.pop(n), w.capacity - free, last, f"{s}-m{step}-{pid}-{n}") for s, (w, held) in by_spec.items() for free, n in w.open]
        yield pd.DataFrame(rest, columns=["spec_id", "capacity", "members", "fill", "closed", "container_id"])

    return run


def pack(items: DataFrame, open_windows: int = OPEN_WINDOWS, partitions: int | None = None) -> DataFrame:
    """(spec_id, container_id, doc_id, part, start_token, n_tokens) from items (spec_id, capacity, doc_id, n_tokens)."""
    spark = items.sparkSession
    count = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = (
        items.where("n_tokens IS NOT NULL")
        .select("spec_id", "capacity", "doc_id", "n_tokens", F.explode(F.expr("sequence(0, cast(greatest(n_tokens - 1, 0) div capacity as int))")).alias("part"))
        .withColumn("start_token", F.col("part") * F.col("capacity"))
        .withColumn("n_tokens", F.least(F.col("n_tokens") - F.col("start_token"), F.col("capacity")))
        .select("spec_id", "capacity", "doc_id", "part", "start_token", "n_tokens")
    )
    order = F.xxhash64("doc_id", "part")
    spread = parts.repartition(count, order).sortWithinPartitions(order, "doc_id", "part", "spec_id")
    placed = written(
        spread.mapInPandas(_place_items(open_windows), "spec_id int, capacity int, doc_id bigint, part int, start_token int, n_tokens int, window_id string, open_fill int"), "placed"
    )
    left = placed.where("open_fill >= 0").select("spec_id", "capacity", F.array("window_id").alias("members"), F.col("open_fill").alias("fill"))
    finished, step = None, 0
    specs = left.select("spec_id").distinct().count()  # a short list of settings
    while True:
        step, count = step + 1, -(-count // FAN_IN)
        last = count == 1
        # in the last round one part of each spec, of at most FAN_IN times as many windows as a task leaves open
        spread = left.repartition(count * max(1, specs), "spec_id", F.pmod(F.xxhash64(F.col("members")[0]), F.lit(count))).sortWithinPartitions("spec_id", F.desc("fill"), F.col("members")[0])
        merged = written(spread.mapInPandas(_merge_windows(step, last, open_windows * FAN_IN), "spec_id int, capacity int, members array<string>, fill int, closed boolean, container_id string"), "merged")
        closed = merged.where("closed")
        finished = closed if finished is None else finished.unionByName(closed)
        if last:
            break
        left = merged.where("NOT closed").select("spec_id", "capacity", "members", "fill")
    names = finished.select("container_id", F.explode("members").alias("window_id"))
    return (
        placed.where("open_fill < 0")
        .join(names, "window_id", "left")
        .select("spec_id", F.coalesce("container_id", "window_id").alias("container_id"), "doc_id", "part", "start_token", "n_tokens")
    )


def pack_documents(docs: DataFrame, specs: DataFrame, folder: str = TOKENIZERS, open_windows: int = OPEN_WINDOWS) -> DataFrame:
    """Packs the texts of docs for every row of specs (spec_id, tokenizer, capacity), tokenizer being a file of folder."""
    settings = specs.select("spec_id", "tokenizer", "capacity").limit(MAX_SPECS + 1).collect()
    if len(settings) > MAX_SPECS or any(s.capacity is None or s.capacity <= 0 or s.tokenizer is None for s in settings):
        raise ValueError("specs need a tokenizer and a capacity, and are a short list")
    known = {name: f"{folder}/{name}.json" for name in {s.tokenizer for s in settings}}
    measured = None
    for name in sorted(known):
        one = sizes(docs, path=known[name]).withColumn("tokenizer", F.lit(name))
        measured = one if measured is None else measured.unionByName(one)
    if measured is None:
        return docs.sparkSession.createDataFrame([], "spec_id int, container_id string, doc_id bigint, part int, start_token int, n_tokens int")
    # one row per setting, checked above
    items = measured.join(F.broadcast(specs.select("spec_id", "tokenizer", F.col("capacity").cast("int").alias("capacity"))), "tokenizer")
    return pack(items, open_windows)


def utilisation(containers: DataFrame, specs: DataFrame) -> DataFrame:
    """(spec_id, capacity, n_containers, n_tokens, fill): how full the containers of each spec are."""
    per = containers.groupBy("spec_id", "container_id").agg(F.sum("n_tokens").alias("n"))
    return (
        per.groupBy("spec_id")
        .agg(F.count("*").alias("n_containers"), F.sum("n").alias("n_tokens"), F.max("n").alias("fullest"))
        .join(F.broadcast(specs.select("spec_id", "capacity")), "spec_id")
        .withColumn("fill", F.round(F.col("n_tokens") / (F.col("n_containers") * F.col("capacity")), 4))
        .select("spec_id", "capacity", "n_containers", "n_tokens", "fullest", "fill")
    )
