"""Problem 5: records that are the same but for formatting, by external sort and a scan of adjacent runs.

The canonical form of a text is its letters and digits in order, in one case; of a text that consists of two
or more ``label: value`` fields, those of its fields in sorted order. Canonical records are range-partitioned
and sorted, so that equal ones lie side by side, also across partition ends: a hot group is spread over as
many partitions as its size asks for and no task ever holds a group. Each partition is scanned once,
comparing full keys of neighbours; runs that go on in the next partition are joined up through one edge
record a partition.

Edge cases: null texts and texts without a letter or digit are no records (``keep_empty`` doesn't exist);
repeated rows are copies; ties of the smallest id can't occur as ids are unique; a table without rows gives no
rows; extra columns are ignored. A field text and a text of the same letters that isn't made of fields are
compared by their own canonical forms.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed, small_side, spread

#: Characters without width that senders' systems scatter, also before a label.
INVISIBLE = r"[\u00ad\u200b-\u200f\u2060\ufeff]"
#: A label of one to three words at the start or after a line break, ``;`` or ``|``; not a scheme (``x://``).
LABEL = r"(?:^|[\n\r;|])[^\p{L}\p{N}\n\r;|]*(\p{L}+(?:[ \u00a0]\p{L}+){0,2}[^\S\n\r]*:(?!//))"


def letters_digits(text: Column) -> Column:
    """Letters and digits in order, in one case."""
    return F.lower(F.upper(F.regexp_replace(text, r"[^\p{L}\p{N}]+", "")))


def canonical(text: Column) -> Column:
    """The canonical form of a text; empty where it has no letter or digit."""
    marked = F.regexp_replace(F.regexp_replace(text, INVISIBLE, ""), LABEL, "\u0001$1")
    parts = F.split(marked, "\u0001")
    fields = (F.size(parts) >= 3) & ~F.rlike(parts[0], F.lit(r"[\p{L}\p{N}]"))
    joined = F.array_join(F.array_sort(F.transform(F.slice(parts, 2, 1_000_000_000), letters_digits)), "\u0002")
    return F.when(F.contains(text, F.lit(":")) & fields, joined).otherwise(letters_digits(text))


ROWS = "pid int, row_id bigint, rep bigint, first_rep bigint, first_key string, last_rep bigint, last_key string, single boolean"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (row_id, key) -> each row with the first row of its run, then one edge record."""
    pid = TaskContext.get().partitionId()
    schema = pa.schema([("pid", pa.int32()), ("row_id", pa.int64()), ("rep", pa.int64()), ("first_rep", pa.int64()), ("first_key", pa.string()), ("last_rep", pa.int64()), ("last_key", pa.string()), ("single", pa.bool_())])
    first = last = None
    single = True
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        ids, key = batch.column("row_id").to_numpy(), batch.column("key")
        new = np.ones(n, bool)
        new[1:] = ~pc.equal(key.slice(1), key.slice(0, n - 1)).to_numpy(zero_copy_only=False)
        new[0] = last is None or key[0].as_py() != last[1]
        if first is None:
            first = (int(ids[0]), key[0].as_py())
            single = not new[1:].any()
        else:
            single = single and not new.any()
        at = np.maximum.accumulate(np.where(new, np.arange(n), -1))
        rep = np.where(at >= 0, ids[np.maximum(at, 0)], 0 if last is None else last[0])
        last = (int(rep[-1]), key[n - 1].as_py())
        none = lambda t: pa.nulls(n, t)  # noqa: B023, E731
        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, pid, np.int32)), pa.array(ids), pa.array(rep), none(pa.int64()), none(pa.string()), none(pa.int64()), none(pa.string()), none(pa.bool_())], schema=schema)
    if first is not None:
        yield pa.RecordBatch.from_pylist([{"pid": pid, "first_rep": first[0], "first_key": first[1], "last_rep": last[0], "last_key": last[1], "single": single}], schema=schema)


def copies(records: DataFrame, id_col: str = "row_id", text_col: str = "body") -> DataFrame:
    """row_id, rep: each record with the smallest id among its copies (its own where it has none)."""
    keys = spread(records.select(F.col(id_col).alias("row_id"), F.col(text_col).alias("text"))).select("row_id", canonical(F.col("text")).alias("key")).where("key != ''")
    keys = keys.withColumns({"h1": F.xxhash64("key"), "h2": F.xxhash64("key", F.lit(1))})
    keys = checkpointed(keys)  # finding the ranges reads the records a first time
    # 128 bits of hash order the records; ids split a hot group; full keys decide in the scan
    laid = keys.repartitionByRange("h1", "h2", "row_id").sortWithinPartitions("h1", "h2", "row_id").select("row_id", "key")
    scanned = checkpointed(laid.mapInArrow(_scan, ROWS))
    by_pid = Window.orderBy("pid")  # one record a partition
    edges = scanned.where("first_rep is not null").withColumn("goes_on", F.coalesce(F.col("first_key") == F.lag("last_key").over(by_pid), F.lit(False)))
    carried = F.last(F.when(~(F.col("goes_on") & F.col("single")), F.col("last_rep")), ignorenulls=True).over(by_pid)
    edges = edges.withColumn("carried", carried)
    edges = edges.select(F.col("pid").alias("_pid"), F.col("first_rep").alias("_rep"), F.lag("carried").over(by_pid).alias("_true"), "goes_on").where("goes_on").drop("goes_on")
    rows = scanned.where("row_id is not null").select("pid", "row_id", "rep")
    rows = rows.join(small_side(edges), (F.col("pid") == F.col("_pid")) & (F.col("rep") == F.col("_rep")), "left")
    return rows.select("row_id", F.coalesce("_true", "rep").alias("rep"))


def collapsed(records: DataFrame, id_col: str = "row_id", text_col: str = "body") -> DataFrame:
    """One representative a group of copies, with its exact count: row_id, text, n_copies."""
    n = copies(records, id_col, text_col).groupBy(F.col("rep").alias("row_id")).agg(F.count("*").alias("n_copies"))
    text = records.select(F.col(id_col).alias("row_id"), F.col(text_col).alias("text"))
    return n.join(text, "row_id").select("row_id", "text", "n_copies")
