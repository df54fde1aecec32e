"""Compression of vectors to codes by product quantisation, fitted with Heap Lloyd.

A vector's part keeps its entry as long as the entry is surely the nearest: the distance to its entry (upper bound) grows
by the entry's movement, that to any other (lower bound) falls by the others' largest movement. Each block of vectors
holds, for each entry, a heap of its parts by lower minus upper bound, as it was when last computed plus the drift of
the entry up to then; a round pops the parts whose slack the drift has used up, and only these are compared with all entries again, exactly.

Entries' sums change only by the parts that moved; blocks give out these differences, which Spark adds up. The driver
holds codebooks and sums: at most 256 entries for each of four parts.
"""

from __future__ import annotations

import hashlib
import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import new_folder, remove_folder, small_batches

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Vectors of a block, and of a matrix of distances.
BLOCK_ROWS, SCAN_ROWS = 8192, 1024
#: Whole components stay below this, so that squared distances of 16 differences fit 64 bits.
LARGEST = 1 << 28
#: Slack by which a bound must hold, against rounding of square roots.
MARGIN = 1e-6
#: Labels above which their sums are joined by a salted shuffle.
BROADCAST_LABELS = 100_000
SALTS = 32


def whole_vectors(df: DataFrame, id_col: str, vector_col: str, label_col: str, scale: int = SCALE) -> DataFrame:
    """``(id, label, v)``: floor(scale * x) of each component; rows with a null vector or a null, infinite or NaN component are left out."""
    bad = F.exists(vector_col, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = df.where(F.col(vector_col).isNotNull() & ~bad)
    large = lambda x: F.abs(x.cast("double") * float(scale)) >= float(LARGEST)
    v = F.transform(vector_col, lambda x: F.when(large(x), F.raise_error(F.lit(f"a component times {scale} is beyond {LARGEST}")).cast("long")).otherwise(F.floor(x.cast("double") * float(scale)).cast("long")))
    return good.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), v.alias("v"))


def distances(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of whole vectors (m, d) to entries (k, d)."""
    d = x.shape[1]
    top = max(int(np.abs(x).max(initial=0)), int(np.abs(entries).max(initial=0)))
    if 4 * top * top * max(1, d) < 2**53:  # every sum on the way is a whole number that a double holds
        fx, fe = x.astype(np.float64), entries.astype(np.float64)
        return ((fx * fx).sum(axis=1)[:, None] - 2 * (fx @ fe.T) + (fe * fe).sum(axis=1)).astype(np.int64)
    out = np.zeros((len(x), len(entries)), np.int64)
    for j in range(d):
        out += (x[:, j, None].astype(np.int64) - entries[None, :, j].astype(np.int64)) ** 2
    return out


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each vector, ties to the lower index, and lower minus upper bound: how much farther the second is."""
    who, slack = np.empty(len(x), np.int64), np.full(len(x), np.inf)
    for at in range(0, len(x), SCAN_ROWS):
        found = distances(x[at : at + SCAN_ROWS], entries)
        best = found.argmin(axis=1)
        who[at : at + SCAN_ROWS] = best
        if len(entries) > 1:
            rows = np.arange(len(found))
            first = found[rows, best].copy()
            found[rows, best] = np.iinfo(np.int64).max
            slack[at : at + SCAN_ROWS] = np.sqrt(found.min(axis=1).astype(np.float64)) - np.sqrt(first.astype(np.float64))
    return who, slack


class Heaps:
    """The heaps of one part position of a block: a heap of (key, row) for each entry, stored one after another.

    A stored heap becomes a list only when it is popped or pushed.
    """

    def __init__(self, sizes: np.ndarray, keys: np.ndarray, rows: np.ndarray):
        self.sizes, self.keys, self.rows = sizes, keys, rows
        self.at = np.concatenate([[0], np.cumsum(sizes)])
        self.open: dict[int, list[tuple[float, int]]] = {}

    @classmethod
    def of(cls, who: np.ndarray, keys: np.ndarray, entries: int) -> Heaps:
        order = np.lexsort((np.arange(len(who)), keys, who))  # sorted runs are heaps
        return cls(np.bincount(who, minlength=entries), keys[order], order)

    def heap(self, entry: int) -> list[tuple[float, int]]:
        if entry not in self.open:
            a, b = self.at[entry], self.at[entry + 1]
            self.open[entry] = list(zip(self.keys[a:b].tolist(), self.rows[a:b].tolist()))
        return self.open[entry]

    def pop(self, drift: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows, and their entries, whose key the entry's drift has reached."""
        rows, entries = [], []
        full = np.flatnonzero(self.sizes)
        for e in full[self.keys[self.at[full]] <= drift[full] + MARGIN].tolist():
            heap, limit = self.heap(e), float(drift[e]) + MARGIN
            while heap and heap[0][0] <= limit:
                rows.append(heapq.heappop(heap)[1])
                entries.append(e)
        return np.array(rows, np.int64), np.array(entries, np.int64)

    def push(self, rows: np.ndarray, entries: np.ndarray, keys: np.ndarray) -> None:
        for r, e, k in zip(rows.tolist(), entries.tolist(), keys.tolist()):
            heapq.heappush(self.heap(e), (k, r))

    def stored(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        sizes, keys, rows = self.sizes.copy(), [], []
        for e in range(len(sizes)):
            if e in self.open:
                own = self.open[e]
                sizes[e] = len(own)
                keys.append(np.array([k for k, _ in own], np.float64))
                rows.append(np.array([r for _, r in own], np.int64))
            else:
                a, b = self.at[e], self.at[e + 1]
                keys.append(self.keys[a:b])
                rows.append(self.rows[a:b])
        return sizes, np.concatenate([np.zeros(0), *keys]), np.concatenate([np.zeros(0, np.int64), *rows])

    def assigned(self) -> np.ndarray:
        """The entry of each row."""
        sizes, _, rows = self.stored()
        who = np.empty(len(rows), np.int64)
        who[rows] = np.repeat(np.arange(len(sizes)), sizes)
        return who


def _narrow(v: np.ndarray) -> np.ndarray:
    top = int(np.abs(v).max(initial=0))
    return v.astype("<i2" if top < 1 << 15 else "<i4")


def _block_type(id_type: T.DataType, label_type: T.DataType) -> T.StructType:
    plain = [("n", T.IntegerType()), ("width", T.IntegerType()), ("vectors", T.BinaryType()), ("sizes", T.BinaryType()), ("keys", T.BinaryType()), ("rows", T.BinaryType()), ("popped", T.LongType())]
    delta = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("entry", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("sums", T.ArrayType(T.LongType()))])
    return T.StructType([T.StructField("ids", T.ArrayType(id_type)), T.StructField("labels", T.ArrayType(label_type)), *[T.StructField(n, t) for n, t in plain], T.StructField("deltas", T.ArrayType(delta))])


def _split(row: dict) -> np.ndarray:
    """The block's vectors as (part, row, component)."""
    n = row["n"]
    v = np.frombuffer(row["vectors"], f"<i{row['width']}").astype(np.int64)
    return v.reshape(n, PARTS, -1).transpose(1, 0, 2) if n else v.reshape(PARTS, 0, 0)


def _moved(part: int, x: np.ndarray, old: np.ndarray | None, new: np.ndarray, entries: int) -> list[dict]:
    """How counts and sums of entries change when the rows go from old to new entries; old None: they had none."""
    sums, counts = np.zeros((entries, x.shape[1]), np.int64), np.zeros(entries, np.int64)
    np.add.at(sums, new, x)
    np.add.at(counts, new, 1)
    if old is not None:
        np.subtract.at(sums, old, x)
        np.subtract.at(counts, old, 1)
    return [{"part": part, "entry": e, "n": int(counts[e]), "sums": sums[e].tolist()} for e in np.flatnonzero((counts != 0) | (sums != 0).any(axis=1)).tolist()]


def assign_all(row: dict, books: np.ndarray) -> dict:
    """A block's first assignment: every part against every entry."""
    k, x, made, deltas = books.shape[1], _split(row), [], []
    for p in range(PARTS):
        who, slack = nearest(x[p], books[p])
        made.append(Heaps.of(who, slack, k).stored())
        deltas += _moved(p, x[p], None, who, k)
    return _stored(row, made, deltas, PARTS * row["n"])


def assign_again(row: dict, books: np.ndarray, drift: np.ndarray) -> dict:
    """A block's next assignment: only the parts that the heaps give up; ``drift`` (part, entry) is what bounds have lost since the start."""
    x, made, deltas, popped = _split(row), [], [], 0
    for p, heaps in enumerate(_heaps(row, books.shape[1])):
        rows, old = heaps.pop(drift[p])
        popped += len(rows)
        if len(rows):
            new, slack = nearest(x[p][rows], books[p])
            heaps.push(rows, new, slack + drift[p][new])
            moved = new != old
            if moved.any():
                deltas += _moved(p, x[p][rows[moved]], old[moved], new[moved], books.shape[1])
        made.append(heaps.stored())
    return _stored(row, made, deltas, popped)


def _heaps(row: dict, entries: int) -> list[Heaps]:
    n = row["n"]
    sizes = np.frombuffer(row["sizes"], "<i4").reshape(PARTS, entries).astype(np.int64)
    keys, rows = np.frombuffer(row["keys"], "<f8").reshape(PARTS, n), np.frombuffer(row["rows"], "<u2").reshape(PARTS, n).astype(np.int64)
    return [Heaps(sizes[p], keys[p], rows[p]) for p in range(PARTS)]


def _stored(row: dict, made: list, deltas: list, popped: int) -> dict:
    sizes, keys, rows = (b"".join(np.ascontiguousarray(m[i]).astype(t).tobytes() for m in made) for i, t in ((0, "<i4"), (1, "<f8"), (2, "<u2")))
    return row | {"sizes": sizes, "keys": keys, "rows": rows, "deltas": deltas, "popped": popped}


class Codebooks:
    """Entries (part, entry, component) with the counts and sums of their parts, and the drift of the bounds."""

    def __init__(self, first: list[list[int]]):
        whole = np.array(first, np.int64).reshape(len(first), PARTS, -1)
        self.entries = np.ascontiguousarray(whole.transpose(1, 0, 2))
        self.sums, self.counts = np.zeros_like(self.entries), np.zeros(self.entries.shape[:2], np.int64)
        self.drift = np.zeros(self.entries.shape[:2])

    def move(self, changes: list) -> None:
        """Adds changes of counts and sums, sets used entries to the floor of their mean, and adds up the drift."""
        for c in changes:
            self.counts[c["part"], c["entry"]] += c["n"]
            self.sums[c["part"], c["entry"]] += np.array(c["sums"], np.int64)
        used = self.counts > 0
        new = np.where(used[..., None], self.sums // np.maximum(self.counts, 1)[..., None], self.entries)
        step = np.sqrt(((new - self.entries).astype(np.float64) ** 2).sum(axis=2))
        for p in range(PARTS):
            order = np.argsort(step[p])
            most, next_most = step[p][order[-1]], step[p][order[-2]] if len(order) > 1 else 0.0
            others = np.where(np.arange(len(order)) == order[-1], next_most, most)
            self.drift[p] += step[p] + others
        self.entries = new

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def _blocks(vectors: DataFrame, schema: T.StructType, width: int) -> DataFrame:
    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        ids, labels, held = [], [], []

        def block():
            v = _narrow(np.concatenate(held))
            return pa.RecordBatch.from_pylist([{"ids": ids, "labels": labels, "n": len(ids), "width": v.itemsize, "vectors": v.tobytes(), "sizes": b"", "keys": b"", "rows": b"", "popped": 0, "deltas": []}], arrow)

        for batch in batches:
            for at in range(0, batch.num_rows, SCAN_ROWS):
                part = batch.slice(at, SCAN_ROWS)
                v = part.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                if len(v) != part.num_rows * width:
                    raise ValueError("vectors differ in length")
                ids += part.column(0).to_pylist()
                labels += part.column(1).to_pylist()
                held.append(v)
                if len(ids) >= BLOCK_ROWS:
                    yield block()
                    ids, labels, held = [], [], []
        if ids:
            yield block()

    return vectors.mapInArrow(run, schema)


def _each(df: DataFrame, schema: T.StructType, change) -> DataFrame:
    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for batch in batches:
            for k in range(batch.num_rows):
                yield pa.RecordBatch.from_pylist([change(batch.slice(k, 1).to_pylist()[0])], arrow)

    return df.mapInArrow(run, schema)


def fit(spark: SparkSession, df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[Codebooks | None, DataFrame]:
    """The codebooks after all rounds, and the blocks with their last assignment; (None, no blocks) for a table without usable rows.

    Entries start as the parts of the rows of the smallest ids, nulls last, equal ids by vector; fewer rows make fewer
    entries. Each round's blocks are a table in the shared folder, read by the next and then removed.
    """
    small_batches(spark)
    vectors = whole_vectors(df, id_col, vector_col, label_col)
    schema = _block_type(vectors.schema["id"].dataType, vectors.schema["label"].dataType)
    first = [list(r["v"]) for r in vectors.orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).select("v").collect()]  # 256 at most
    if not first:
        return None, spark.createDataFrame([], schema)
    width = len(first[0])
    if width % PARTS or any(len(v) != width for v in first):
        raise ValueError(f"vectors differ in length, or are not of {PARTS} equal parts")
    books, folder, old = Codebooks(first), new_folder(spark, "codebooks"), None
    deltas = [F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[j]) for j in range(width // PARTS)]).cast("array<long>").alias("sums")]
    for r in range(rounds + 1):
        held, drift = books.entries, books.drift.copy()
        if r == 0:
            made = _each(_blocks(vectors, schema, width), schema, lambda row, b=held: assign_all(row, b))
        else:
            made = _each(spark.read.schema(schema).parquet(old), schema, lambda row, b=held, d=drift: assign_again(row, b, d))
        path = f"{folder}/{r}"
        made.write.parquet(path)
        if old:
            remove_folder(spark, old)
        old = path
        if r < rounds:
            moved = spark.read.schema(schema).parquet(path).select(F.explode("deltas").alias("d")).select("d.*")
            books.move(moved.groupBy("part", "entry").agg(*deltas).collect())  # a row for each entry at most
    return books, spark.read.schema(schema).parquet(old)


def coded(blocks: DataFrame, books: Codebooks) -> DataFrame:
    """``(id, label, code, error)`` of each vector of the blocks: an index of two hex digits for each part, and the squared distance to its entries."""
    fields = blocks.schema
    out = T.StructType([T.StructField("id", fields["ids"].dataType.elementType), T.StructField("label", fields["labels"].dataType.elementType), T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    entries = books.entries

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(out)
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                who = np.stack([h.assigned() for h in _heaps(row, entries.shape[1])])
                x, error = _split(row), np.zeros(row["n"], np.int64)
                for p in range(PARTS):
                    error += ((x[p] - entries[p][who[p]]) ** 2).sum(axis=1)
                codes = who.astype(np.uint8).T.tobytes().hex()
                yield pa.RecordBatch.from_arrays([pa.array(row["ids"], arrow.field(0).type), pa.array(row["labels"], arrow.field(1).type), pa.array([codes[i : i + 2 * PARTS] for i in range(0, len(codes), 2 * PARTS)]), pa.array(error)], schema=arrow)

    return blocks.mapInArrow(run, out)


def compress(spark: SparkSession, df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """``(id, label, code, error, label_error, codebooks_sha256)`` of each row with a usable vector.

    Rows that repeat are all coded; null ids and labels are ids and labels like any other, null labels together. Vectors
    must have one length, of four equal parts, and whole components below 2**28: others raise. No usable rows give no rows.
    """
    books, blocks = fit(spark, df, id_col, vector_col, label_col)
    if books is None:
        types = whole_vectors(df, id_col, vector_col, label_col).schema
        return spark.createDataFrame([], T.StructType([types["id"], types["label"], *[T.StructField(n, t) for n, t in (("code", T.StringType()), ("error", T.LongType()), ("label_error", T.LongType()), ("codebooks_sha256", T.StringType()))]]))
    folder = new_folder(spark, "codes")
    coded(blocks, books).write.parquet(folder)
    rows = spark.read.parquet(folder)
    sums = rows.groupBy(F.col("label").alias("own")).agg(F.sum("error").alias("label_error"))
    if sums.count() <= BROADCAST_LABELS:
        joined = rows.join(F.broadcast(sums), F.col("label").eqNullSafe(F.col("own")))
    else:
        salted = rows.withColumn("salt", F.pmod(F.xxhash64("id", "code"), F.lit(SALTS)).cast("int"))
        spread = sums.withColumn("own_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = salted.join(spread, F.col("label").eqNullSafe(F.col("own")) & (F.col("salt") == F.col("own_salt")))
    return joined.select("id", "label", "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))
