"""Packing of texts, measured in tokens, into containers of fixed capacity.

Each document becomes a point: the sum of hashed directions of its tokens in a few dimensions. Its place
on the Hilbert curve through that space orders the documents so that similar ones are neighbours. The order
is a range partitioning by (budget, curve key), and each partition packs neighbouring documents: a stretch
of the curve that fills `SPAN` containers is packed best fit by falling size, and the `OPEN` emptiest of its containers stay open for the
next stretch. So what shares a container lies within a few stretches of the curve, and what is left over at the end of a
partition is a few containers, however many documents there are. No step depends on groups: a third of all documents at one point of the curve are cut
by document id like any others.

Texts are tokenized where they lie; only id, size and curve key travel. An item larger than the capacity
is cut into full pieces and a rest, any other stays whole.

Defined cases: null and empty texts take no space and come out with no container and 0 tokens; equal keys
are ordered by document id; repeated documents are packed as often as they occur; an empty table, or a budget
without capacity (null or below 1), gives no rows of that kind.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillfold.llm.tokens import TOKENIZER_DIR, encode, encoder

DIMENSIONS, BITS = 3, 10
#: Containers that a stretch packed together fills, and those kept open for the next. Longer stretches fill a little better, of documents less alike.
SPAN, OPEN = 128, 32

PLACED = "budget_id int, container_id bigint, doc_id bigint, piece int, first_token bigint, n_tokens bigint"


def directions(n: int, seed: int = 11) -> np.ndarray:
    """A fixed direction for each token id: hashed signs, so no table has to be kept."""
    x = np.arange(n, dtype=np.uint64)[:, None] * np.uint64(DIMENSIONS) + np.arange(DIMENSIONS, dtype=np.uint64)[None, :] + np.uint64(seed)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return (x >> np.uint64(40)).astype(np.float32) / np.float32(1 << 23) - np.float32(1)


def hilbert(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place on the Hilbert curve of each row of unsigned coordinates below 2**bits."""
    x = points.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(high, p, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def curve_key(ids: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The vector of one document: its mean direction, brought to about unit spread."""
    return table[ids].sum(axis=0) / np.float32(max(1.0, len(ids)) ** 0.5)


def _measured(tokenizers: list[str], folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encs = [encoder(t, folder) for t in tokenizers]
        table = directions(1 << 16)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            sizes = np.zeros((len(texts), len(encs)), dtype=np.int64)
            points = np.zeros((len(texts), DIMENSIONS), dtype=np.float32)
            for k, text in enumerate(texts):
                if not text:
                    continue
                for j, enc in enumerate(encs):
                    ids = encode(enc, text)
                    sizes[k, j] = len(ids)
                    if j == 0:
                        points[k] = curve_key(np.array(ids, dtype=np.int64) & 0xFFFF, table)
            # A squashing with a fixed scale keeps the grid the same for every batch.
            grid = np.clip((np.tanh(points / 8) + 1) / 2 * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, len(texts) * len(encs) + 1, len(encs), dtype=np.int32)), pa.array(sizes.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), flat, pa.array(hilbert(grid))], names=["doc_id", "sizes", "curve"])

    return run


def measured(docs: DataFrame, tokenizers: list[str], folder: str = TOKENIZER_DIR) -> DataFrame:
    """`(doc_id, sizes array<bigint>, curve bigint)`: tokens by each tokenizer, and the place on the curve by the first."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(_measured(tokenizers, folder), "doc_id bigint, sizes array<bigint>, curve bigint")


class Packer:
    """Containers of one budget within one partition of the curve."""

    def __init__(self, capacity: int, first: int) -> None:
        self.capacity, self.next, self.room = capacity, first, []  # room: sorted (space left, container)

    def place(self, items: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int, int]]:
        """Containers for (size, doc, piece, first token), best fit by falling size."""
        out = []
        for size, doc, piece, first in sorted(items, key=lambda x: (-x[0], x[1:])):
            at = bisect_left(self.room, (size, -1))
            if at < len(self.room):
                left, container = self.room.pop(at)
            else:
                left, container = self.capacity, self.next
                self.next += 1
            if left > size:
                insort(self.room, (left - size, container))
            out.append((container, doc, piece, first, size))
        # The fullest ones are the least use; the emptiest stay open.
        del self.room[: max(0, len(self.room) - OPEN)]
        return out


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    base = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 36
    schema = pa.schema([("budget_id", pa.int32()), ("container_id", pa.int64()), ("doc_id", pa.int64()), ("piece", pa.int32()), ("first_token", pa.int64()), ("n_tokens", pa.int64())])
    packer, budget, window = None, None, []
    used, total = base, 0

    def flush() -> pa.RecordBatch:
        rows = [(budget, *r) for r in packer.place(window)]
        window.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        for b, capacity, doc, size in zip(*columns[:4]):
            if b != budget:
                if window:
                    yield flush()
                used = packer.next if packer else base
                packer, budget, total = Packer(capacity, used), b, 0
            full, rest = divmod(size, capacity)
            if full and rest == 0 and full == 1:
                window.append((size, doc, 0, 0))
            elif full:
                window.extend((capacity, doc, k, k * capacity) for k in range(full))
                if rest:
                    window.append((rest, doc, full, full * capacity))
            else:
                window.append((size, doc, 0, 0))
            total += size
            if total >= SPAN * capacity:
                yield flush()
                total = 0
    if window:
        yield flush()


def pack(docs: DataFrame, budgets: DataFrame, folder: str = TOKENIZER_DIR, per_partition: int = 200_000) -> DataFrame:
    """`PLACED` for every budget and document: a row for each piece.

    budgets: `budget_id, tokenizer, capacity_tokens`, one row each; the table is small by nature (a row is
    a decision about a training run) and read on the driver. per_partition: documents a partition should hold.
    """
    wanted = [r for r in budgets.where("capacity_tokens >= 1 and tokenizer is not null").select("budget_id", "tokenizer", "capacity_tokens").distinct().orderBy("budget_id", "tokenizer", "capacity_tokens").collect()]
    names = sorted({r.tokenizer for r in wanted})
    if not wanted:
        return docs.sparkSession.createDataFrame([], PLACED)
    sizes = measured(docs, names, folder)
    each = F.explode(F.array(*[F.struct(F.lit(r.budget_id).cast("int").alias("budget_id"), F.lit(r.capacity_tokens).cast("bigint").alias("capacity"), F.col("sizes")[names.index(r.tokenizer)].alias("size")) for r in wanted]))
    items = sizes.select("doc_id", "curve", each.alias("i")).select("i.budget_id", "i.capacity", "doc_id", "i.size", "curve")
    return _arranged(items, per_partition)


def _arranged(items: DataFrame, per_partition: int) -> DataFrame:
    from rillfold.session import shared_dir

    spark = items.sparkSession
    # Measured once: the range partitioning reads its input twice, and tokenizing is what costs.
    where = shared_dir(spark, "pack")
    items.write.parquet(where)
    items = spark.read.schema(items.schema).parquet(where)
    n = max(1, -(-items.where("size > 0").count() // per_partition))
    ranged = items.where("size > 0").repartitionByRange(n, "budget_id", "curve", "doc_id").sortWithinPartitions("budget_id", "curve", "doc_id")
    nothing = items.where("size = 0").select("budget_id", F.lit(None).cast("bigint").alias("container_id"), "doc_id", F.lit(0).alias("piece"), F.lit(0).cast("bigint").alias("first_token"), F.lit(0).cast("bigint").alias("n_tokens"))
    return ranged.select("budget_id", "capacity", "doc_id", "size").mapInArrow(_packed, PLACED).unionByName(nothing)


def fill(placed: DataFrame, budgets: DataFrame) -> DataFrame:
    """What can be said of `pack`'s rows without knowing the texts, a row for each budget; sums by container and by document, both small groups.

    little_unused: at most a twentieth of the containers more than their tokens would fill without gaps, and two that the ends leave open.
    """
    caps = budgets.select("budget_id", F.col("capacity_tokens").cast("bigint").alias("capacity"))
    used = placed.where("container_id is not null")
    by_container = used.groupBy("budget_id", "container_id").agg(F.sum("n_tokens").alias("n")).groupBy("budget_id").agg(F.max("n").alias("most"), F.sum("n").alias("tokens"), F.count(F.lit(1)).alias("containers"))
    by_doc = used.groupBy("budget_id", "doc_id").agg(F.count(F.lit(1)).alias("pieces"), F.max("piece").alias("last"), F.sum("n_tokens").alias("n"), F.max(F.col("first_token") + F.col("n_tokens")).alias("end"))
    docs = by_doc.join(F.broadcast(caps), "budget_id").groupBy("budget_id").agg(F.count(F.lit(1)).alias("n_docs"), F.bool_and((F.col("n") == F.col("end")) & (F.col("pieces") == F.col("last") + 1)).alias("all_whole"), F.bool_and((F.col("pieces") == 1) | (F.col("n") > F.col("capacity"))).alias("cut_only_if_must"))
    out = caps.join(by_container, "budget_id", "left").join(docs, "budget_id", "left")
    return out.select("budget_id", F.coalesce("n_docs", F.lit(0)).alias("n_docs"), (F.col("most") <= F.col("capacity")).alias("none_overfull"), "all_whole", "cut_only_if_must", (F.col("containers") <= F.ceil(F.col("tokens") / F.col("capacity") * 1.05) + 2).alias("little_unused"))
