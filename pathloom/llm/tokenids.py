"""Token ids as one concatenated array in files, with Elias-Fano document boundaries.

A file row is a block: ids packed as unsigned 16- or 32-bit integers, and the documents' ids and the ends of the
documents as two Elias-Fano sequences: the low bits of each number packed side by side, the high bits in unary, and
the position of every 64th one bit, from which select finds any number without a table of 64-bit ones. Blocks are rows of Parquet, so
they are written and read by any store that Spark reaches and a lost task is written again.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import slices, small_batches

#: Bytes of text encoded together; larger runs find more pieces already seen.
ENCODE_BYTES = 2_000_000

END_ID = 2
SAMPLE = 64
#: Numbers whose low bits are packed at a time, a multiple of 8.
PACKED = 8192
#: Ids of a block; a block ends with the document that reaches it.
BLOCK_IDS = 1 << 20
BLOCK = (
    "part int, block int, before long, n_ids long, n_docs long, width int, ids binary, low_bits int, low binary, high binary, ones binary, "
    "n_null long, first_id long, id_low_bits int, id_low binary, id_high binary, id_ones binary"
)
#: Ids of a block's documents differ by less, so that an Elias-Fano sequence of the differences holds them.
SPAN = 1 << 60


def _low_bits(values: np.ndarray, bits: int) -> bytes:
    """The low bits of each number side by side; ``PACKED`` numbers at a time end at a whole byte."""
    return np.packbits(((values[:, None] >> np.arange(bits)) & 1).astype(np.uint8).ravel(), bitorder="little").tobytes()


class EliasFano:
    """A rising sequence of n numbers up to ``top``: about 2 + log2(top / n) bits for each."""

    def __init__(self, n: int, low_bits: int, low: bytes, high: bytes, ones: bytes):
        self.n, self.low_bits = n, low_bits
        self.low, self.high, self.ones = low, np.frombuffer(high, np.uint8), np.frombuffer(ones, "<u4")

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        n, top = len(values), int(values[-1]) if len(values) else 0
        bits = max(0, (top // n).bit_length() - 1) if n else 0
        values = values.astype(np.int64)
        low = b"".join(_low_bits(values[a : a + PACKED], bits) for a in range(0, n, PACKED))
        at = (values >> bits) + np.arange(n)
        high = np.zeros(int(at[-1]) + 1 if n else 0, np.uint8)
        high[at] = 1
        return cls(n, bits, low, np.packbits(high, bitorder="little").tobytes(), at[::SAMPLE].astype("<u4").tobytes())

    def _low(self, i: int) -> int:
        first = i * self.low_bits
        word = int.from_bytes(self.low[first >> 3 : (first + self.low_bits + 7 >> 3) + 1], "little")
        return (word >> (first & 7)) & ((1 << self.low_bits) - 1)

    def select(self, i: int) -> int:
        """The i-th number: the sampled one bit before it, then whole bytes by their count of ones, then bits."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at, left = int(self.ones[i // SAMPLE]), i % SAMPLE
        byte, word = at >> 3, int(self.high[at >> 3]) >> (at & 7) << (at & 7)
        while (n := word.bit_count()) <= left:
            left -= n
            byte += 1
            word = int(self.high[byte])
        for _ in range(left):
            word &= word - 1
        return ((byte * 8 + (word & -word).bit_length() - 1 - i) << self.low_bits) | self._low(i)

    def parts(self) -> tuple[int, bytes, bytes, bytes]:
        return self.low_bits, self.low, self.high.tobytes(), self.ones.tobytes()


class WordIds:
    """Ids by a ``tokenizers`` file, one white-space run of a text at a time; runs met before are remembered, up to
    ``remembered``, and then all forgotten.

    The tokenizer must cut at white space and drop it, as ``word_bpe_49k.json`` does. Only space, tab, line feed and
    carriage return part runs here; other white space stays inside a run, for the tokenizer to handle. A text that
    holds the string of a special token goes to the tokenizer whole, which gives it that token's id.
    """

    def __init__(self, path: str, remembered: int = 1_000_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        special = [t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, special)) or r"(?!)")
        self.first = {x[0] for x in special} | {x[0].upper() for x in special}
        self.size, self.remembered = self.tokenizer.get_vocab_size(), remembered
        self.kind = np.dtype("<u2") if self.size <= 65536 else np.dtype("<u4")
        self.known: dict[str, bytes] = {}

    def encode(self, texts: list[str | None]) -> list[bytes]:
        whole = {k: self._whole(t) for k, t in enumerate(texts) if t and any(x in t for x in self.first) and self.special.search(t.lower())}
        runs = [_lowered(t).replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") if t and k not in whole else [] for k, t in enumerate(texts)]
        known = self.known
        missing = {r for some in runs for r in some if r not in known}
        if len(known) + len(missing) > self.remembered:
            known.clear()
            missing = {r for some in runs for r in some}
        order = list(missing)
        for at in range(0, len(order), 4096):
            some = order[at : at + 4096]
            known.update(zip(some, self._unseen(some)))
        return [whole[k] if k in whole else b"".join(map(known.__getitem__, some)) for k, some in enumerate(runs)]

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind).tobytes()

    def _unseen(self, runs: list[str]) -> list[bytes]:
        """Runs encoded as one text with spaces between; a token belongs to the run that its offset lies in."""
        found = self.tokenizer.encode(" ".join(runs), add_special_tokens=False)
        ids = np.array(found.ids, self.kind).tobytes()
        at = np.fromiter((o[0] for o in found.offsets), np.int64, len(found.ids))
        starts = np.cumsum([0, *(len(r) + 1 for r in runs)])
        cut = (np.searchsorted(at, starts) * self.kind.itemsize).tolist()
        return [ids[a:b] for a, b in zip(cut, cut[1:])]


def _lowered(text: str) -> str:
    """Lower case where that is surely what the tokenizer does itself: in texts of Latin-1 characters, which have no
    composition and no letter whose lower case hangs on its neighbours. Fewer different runs are left to encode."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return text
    return text.lower()


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


def write_ids(df: DataFrame, folder: str, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, partitions: int | None = None) -> None:
    """Encode every whole text, append ``end_id``, and write the ids in ascending order of ``id_col`` to ``folder``.

    Null ids come first; rows that repeat an id stand together, in the order of their texts' hashes. Null and empty
    texts have ``end_id`` alone. A block holds about ``BLOCK_IDS`` ids or one longer document, so a task needs memory
    for one block and one text. No rows give a folder that reads as empty.
    """
    spark = df.sparkSession
    small_batches(spark)
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    dealt = docs.repartitionByRange(n, F.col("id").asc_nulls_first()).sortWithinPartitions(F.col("id").asc_nulls_first(), F.xxhash64("text"))
    dealt = dealt.select("id", "text", F.spark_partition_id().alias("part"))

    def pack(batches):
        work = word_ids(path)
        end = np.array([end_id], work.kind).tobytes()
        width = work.kind.itemsize
        held, ids, number, part, before = [], [], 0, 0, 0

        def block():
            nonlocal number, before
            ends = np.cumsum([len(x) // width for x in held])
            own = np.array([x for x in ids if x is not None], np.int64)
            least = int(own[0]) if len(own) else 0
            row = {"part": part, "block": number, "before": before, "n_ids": int(ends[-1]), "n_docs": len(held), "width": width, "ids": b"".join(held), "n_null": len(ids) - len(own), "first_id": least}
            row |= zip(("low_bits", "low", "high", "ones"), EliasFano.of(ends).parts())
            row |= zip(("id_low_bits", "id_low", "id_high", "id_ones"), EliasFano.of(own - least).parts())
            number, before = number + 1, before + row["n_ids"]
            return pa.RecordBatch.from_pylist([row], _ARROW)

        size, first = 0, None
        for batch in batches:
            for some in slices(batch, "text", ENCODE_BYTES):
                for doc, own, x in zip(some.column(0).to_pylist(), some.column(2).to_pylist(), work.encode(some.column(1).to_pylist())):
                    if held and (size >= BLOCK_IDS or first is not None and doc - first >= SPAN):
                        yield block()
                        held, ids, size, first = [], [], 0, None
                    part, first = own, doc if first is None else first
                    held.append(x + end)
                    ids.append(doc)
                    size += len(held[-1]) // width
        if held:
            yield block()

    dealt.mapInArrow(pack, BLOCK).write.parquet(folder)


_ARROW = pa.schema([(n, {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}[t]) for n, t in (x.split() for x in BLOCK.split(", "))])


def read_ids(spark: SparkSession, folder: str) -> DataFrame:
    """``(doc_id, start, n_tokens, ids)`` from the files: ``start`` counts the ids of all documents before it, ``ids``
    are little-endian unsigned 32-bit integers. Each document's id and ends come from the sequences by select.

    A block knows how many ids of its part come before it, so only the sizes of the parts, one for each task that
    wrote, are added up here.
    """
    blocks = spark.read.schema(BLOCK).parquet(folder)
    sizes = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))
    earlier = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = F.broadcast(sizes.select("part", earlier.alias("earlier")))  # a row for each part written
    placed = blocks.join(parts, "part").withColumn("first", F.col("earlier") + F.col("before"))

    def unpack(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                row = {n: batch.column(i)[k].as_py() for i, n in enumerate(batch.schema.names)}
                ends = EliasFano(row["n_docs"], row["low_bits"], row["low"], row["high"], row["ones"])
                names = EliasFano(row["n_docs"] - row["n_null"], row["id_low_bits"], row["id_low"], row["id_high"], row["id_ones"])
                kind = "<u2" if row["width"] == 2 else "<u4"
                for some in range(0, row["n_docs"], 1024):  # a few documents at a time
                    docs, starts, sizes, cut = [], [], [], []
                    a = ends.select(some - 1) if some else 0
                    for i in range(some, min(some + 1024, row["n_docs"])):
                        b = ends.select(i)
                        docs.append(row["first_id"] + names.select(i - row["n_null"]) if i >= row["n_null"] else None)
                        starts.append(row["first"] + a)
                        sizes.append(b - a)
                        cut.append(np.frombuffer(row["ids"], kind, b - a, a * row["width"]).astype("<u4").tobytes())
                        a = b
                    yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64()), pa.array(cut, pa.binary())], ["doc_id", "start", "n_tokens", "ids"])

    wanted = ["first", *[x.split()[0] for x in BLOCK.split(", ") if x.split()[0] not in ("part", "block", "before", "n_ids")]]
    return placed.select(*wanted).mapInArrow(unpack, "doc_id long, start long, n_tokens long, ids binary")
