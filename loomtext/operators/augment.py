"""Word-level augmentation: copies of texts with words dropped, swapped or inserted, chosen by MD5."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _number(*parts: str | int | None) -> int:
    """A whole number from a digest of the parts; nulls are left out."""
    return int.from_bytes(hashlib.md5("/".join(str(p) for p in parts if p is not None).encode()).digest()[:4])


#: Words that are never inserted again: the reference's list.
STOPWORDS = frozenset("a an the and or but if of to in on for with as is was are were be been being have has had do does did i you he she it we they this that these those my your his her its our their".split())


def augmented(rows: DataFrame, copies: int = 2, alpha: float = 0.1, id_col: str = "doc_id", text_col: str = "text", chosen: Column | None = None) -> DataFrame:
    """rows and `copies` changed copies of each of the `chosen` rows, of all rows where it isn't given.

    (id_col STRING, text, augmented): ids of copies end in _aug<k>. Each copy has one kind of change, in turn over its
    number from a start that its row's digest gives: words dropped, pairs of places swapped, or words of the text, stop
    words left out, inserted at other places. n = max(1, int(alpha x words)) such changes are made; where alpha is 1 or
    more one word is left. Texts of one word lose nothing, swapped equal words and texts of stop words alone stay as they
    are. Null texts have no copies.
    """
    key = F.col(id_col).cast("string")
    base = rows.select(key.alias(id_col), F.col(text_col).alias("text"), F.lit(False).alias("augmented"))
    picked = rows.where(F.col(text_col).isNotNull() if chosen is None else F.col(text_col).isNotNull() & chosen)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 500):
                batch = whole.slice(start, 500)
                ids, texts = [], []
                for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    words = text.split()
                    for k in range(1, copies + 1):
                        ids.append(None if i is None else f"{i}_aug{k}")
                        texts.append(" ".join(changed(words, i, k, alpha)))
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(texts, pa.string())], names=[id_col, "text"])

    made = picked.select(key.alias(id_col), F.col(text_col).alias("text")).mapInArrow(run, f"`{id_col}` string, text string")
    return base.unionByName(made.withColumn("augmented", F.lit(True)))


def changed(words: list[str], row: str | None, copy: int, alpha: float) -> list[str]:
    """The words of the copy of that number."""
    n, kind = len(words), (_number("start", row) + copy) % 3
    changes = max(1, math.floor(alpha * n))
    if kind == 0:
        # the places whose numbers come first
        lost = {i for _, i in sorted((_number("drop", row, copy, i), i) for i in range(n))[: min(changes, n - 1)]} if n > 1 else set()
        return [w for i, w in enumerate(words) if i not in lost]
    out = list(words)
    if kind == 1:
        for j in range(1, changes + 1) if n > 1 else ():
            a = _number("from", row, copy, j) % n
            b = (a + 1 + _number("to", row, copy, j) % (n - 1)) % n
            out[a], out[b] = out[b], out[a]
        return out
    content = [w for w in words if w.lower() not in STOPWORDS]
    for j in range(1, changes + 1) if content else ():
        out.insert(_number("at", row, copy, j) % (len(out) + 1), content[_number("word", row, copy, j) % len(content)])
    return out
