"""Alignment of two tokenizations of the same bytes, and how often their tokens stand together in a corpus.

Both vocabularies' tokens end at byte offsets; the offsets that both share cut a text into groups, and inside a group
each token of one is linked to those of the other whose bytes it overlaps. All of it is array work over a block of
texts: running sums give the ends, their intersection the cuts, binary search the group of each token, and the links
come from repeating each token as often as it has partners.

Counts of linked pairs are summed in each block, then over salted keys, then over keys. What a document needs of them
comes back to its block: a block asks for its own distinct pairs, so no table of all pairs is held or sent anywhere.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import new_folder, slices, small_batches
from .vocabularies import vocabularies

#: A block ends with the document that brings it to so many links or documents.
BLOCK_LINKS, BLOCK_DOCS = 1 << 20, 1 << 15
SALTS = 16
#: Runs of text whose ids a worker remembers, beside the arrays of a block.
REMEMBERED = 300_000
#: Runs of a text that are encoded, and tokens that are aligned, at a time.
PART_RUNS, PART_TOKENS = 50_000, 100_000
DOCUMENT = ("n_a", "n_b", "n_groups", "n_links")


def align(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(cuts, group of each A token, group of each B token, A of each link, B of each link)`` from the rising byte ends
    of two tokenizations of the same bytes; no token is empty. Links are ordered by A, then B."""
    cuts = np.intersect1d(a_ends, b_ends, assume_unique=True)
    a_group, b_group = np.searchsorted(cuts, a_ends), np.searchsorted(cuts, b_ends)
    starts = np.concatenate([a_ends[:1] * 0, a_ends[:-1]])
    first, last = np.searchsorted(b_ends, starts, "right"), np.searchsorted(b_ends, a_ends)
    many = last - first + 1
    link_a = np.repeat(np.arange(len(a_ends)), many)
    link_b = np.arange(len(link_a)) + np.repeat(first - (np.cumsum(many) - many), many)
    return cuts, a_group, b_group, link_a, link_b


class Names:
    """Decimal ids with what follows them, to write groups as text: ``a1,a2|b1;a3|b2``."""

    def __init__(self, n_a: int, n_b: int):
        table = [f"{i}{end}".encode() for n, ends in ((n_a, ",|"), (n_b, ",;")) for i in range(n) for end in ends]
        self.table = np.array(table, object)
        self.b_from = 2 * n_a

    def write(self, a: np.ndarray, b: np.ndarray, a_group: np.ndarray, b_group: np.ndarray, n: int) -> np.ndarray:
        """The parts of the text, tokens in the order of groups, A's before B's."""
        out = np.empty(len(a) + len(b), np.int64)
        a_sizes, b_sizes = np.bincount(a_group, minlength=n), np.bincount(b_group, minlength=n)
        ends = lambda g: np.concatenate([g[1:] != g[:-1], [True]]).astype(np.int64)
        out[np.arange(len(a)) + (np.cumsum(b_sizes) - b_sizes)[a_group]] = 2 * a.astype(np.int64) + ends(a_group)
        out[np.arange(len(b)) + np.cumsum(a_sizes)[b_group]] = self.b_from + 2 * b.astype(np.int64) + ends(b_group)
        return self.table[out]


def _block_type(id_type: T.DataType) -> T.StructType:
    lists = [T.StructField(n, T.ArrayType(T.LongType())) for n in DOCUMENT]
    pairs = [T.StructField("pair_a", T.ArrayType(T.IntegerType())), T.StructField("pair_b", T.ArrayType(T.IntegerType())), T.StructField("pair_n", T.ArrayType(T.LongType()))]
    return T.StructType([T.StructField("block", T.LongType()), T.StructField("id", T.ArrayType(id_type)), *lists, T.StructField("groups_sha256", T.ArrayType(T.StringType())), T.StructField("width", T.IntegerType()), T.StructField("links", T.BinaryType()), *pairs])


class Block:
    """Documents of one row: their figures, their distinct pairs with counts, and each link as the place of its pair."""

    def __init__(self):
        self.ids, self.shas, self.figures = [], [], {n: [] for n in DOCUMENT}
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        """Links, in order: a part keeps its distinct pairs, each link's place among them, and their counts."""
        pairs, place, counts = np.unique((a.astype(np.int64) << 32) | b, return_inverse=True, return_counts=True)
        self.parts.append((pairs, place.astype(np.uint32), counts))

    def row(self, number: int) -> dict:
        pairs, where = np.unique(np.concatenate([np.zeros(0, np.int64), *(p[0] for p in self.parts)]), return_inverse=True)
        counts, kind, links, at = np.zeros(len(pairs), np.int64), np.dtype("<u2") if len(pairs) <= 65536 else np.dtype("<u4"), [], 0
        for own, place, n in self.parts:
            here = where[at : at + len(own)]
            np.add.at(counts, here, n)
            links.append(here.astype(kind)[place].tobytes())
            at += len(own)
        own = {"block": number, "id": self.ids, "groups_sha256": self.shas, "width": kind.itemsize, "links": b"".join(links)}
        return own | self.figures | {"pair_a": pairs >> 32, "pair_b": pairs & 0xFFFFFFFF, "pair_n": counts}


def write_blocks(df: DataFrame, folder: str, byte_path: str, piece_path: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode and align every whole text of ``df`` and write blocks of documents to ``folder``, without a shuffle.

    Null and empty texts, and those whose bytes in either vocabulary differ from space + text, have no tokens: zeros and
    an empty digest. Rows are kept whatever they repeat; a null id is an id like any other; other columns do not
    matter. A text of any length is gone through in parts, so a task needs memory for a part and for a number of two or
    four bytes for each link of a block. An empty table gives a folder without blocks.
    """
    small_batches(df.sparkSession)
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = _block_type(docs.schema["id"].dataType)

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        work = vocabularies(byte_path, piece_path, REMEMBERED)
        names = Names(len(work.a_bytes), len(work.b_bytes))
        arrow, number, block, size = to_arrow_schema(schema), TaskContext.get().partitionId() << 32, Block(), 0

        def aligned(parts: list[tuple[int, np.ndarray, np.ndarray]], at: int, shas: dict):
            """Adds what the parts, of texts in ascending order, hold to the block's documents from place ``at`` on."""
            a, b = np.concatenate([p[1] for p in parts]), np.concatenate([p[2] for p in parts])
            a_ends, b_ends = np.cumsum(work.a_len[a]), np.cumsum(work.b_len[b])
            cuts, a_group, b_group, link_a, link_b = align(a_ends, b_ends)
            block.add(a[link_a], b[link_b])
            text = names.write(a, b, a_group, b_group, len(cuts))
            a_at, b_at = np.cumsum([0, *(len(p[1]) for p in parts)]), np.cumsum([0, *(len(p[2]) for p in parts)])
            ends = np.concatenate([[0], a_ends])[a_at]  # each part ends at a cut
            g_at, l_at = np.searchsorted(cuts, ends, "right"), np.searchsorted(link_a, a_at)
            for n, offsets in zip(DOCUMENT, (a_at, b_at, g_at, l_at)):
                for (k, _, _), more in zip(parts, np.diff(offsets).tolist()):
                    block.figures[n][at + k] += more
            t_at = (a_at + b_at).tolist()
            for (k, _, _), x, y in zip(parts, t_at, t_at[1:]):
                sha = shas.get(k)
                if sha is None:
                    sha = shas[k] = hashlib.sha256()
                else:
                    sha.update(b";")
                sha.update(b"".join(text[x:y].tolist())[:-1])
            return len(link_a)

        for batch in batches:
            for part in slices(batch, "text"):
                ids, texts = part.column(0).to_pylist(), part.column(1).to_pylist()
                at, shas = len(block.ids), {}
                block.ids += ids
                for n in DOCUMENT:
                    block.figures[n] += [0] * len(ids)
                held, tokens = [], 0
                for k, a, b in work.texts(texts, PART_RUNS):
                    if a is not None:
                        held.append((k, a, b))
                        tokens += len(a)
                        if tokens > PART_TOKENS:
                            size += aligned(held, at, shas)
                            held, tokens = [], 0
                if held:
                    size += aligned(held, at, shas)
                block.shas += [shas[k].hexdigest() if k in shas else "" for k in range(len(ids))]
                if size >= BLOCK_LINKS or len(block.ids) >= BLOCK_DOCS:
                    yield pa.RecordBatch.from_pylist([block.row(number)], arrow)
                    number, block, size = number + 1, Block(), 0
            batch = part = None
            pa.default_memory_pool().release_unused()
        if block.ids:
            yield pa.RecordBatch.from_pylist([block.row(number)], arrow)

    docs.mapInArrow(run, schema).write.parquet(folder)


def block_pairs(blocks: DataFrame) -> DataFrame:
    """``(block, place, a, b, n)``: a row for each distinct pair of each block."""
    pairs = blocks.select("block", F.posexplode(F.arrays_zip("pair_a", "pair_b", "pair_n")).alias("place", "p"))
    return pairs.select("block", "place", F.col("p.pair_a").alias("a"), F.col("p.pair_b").alias("b"), F.col("p.pair_n").alias("n"))


def pair_counts(blocks: DataFrame, salts: int = SALTS) -> DataFrame:
    """``(a, b, n, best)``: how many links of all blocks hold each pair of ids linked, and whether no pair of the same B id
    has more. Summed over salted keys first, so that a pair that every block holds is never one task's."""
    salted = block_pairs(blocks).groupBy("a", "b", F.pmod(F.xxhash64("block"), F.lit(salts)).alias("salt")).agg(F.sum("n").alias("n"))
    counts = salted.groupBy("a", "b").agg(F.sum("n").alias("n"))
    return counts.select("a", "b", "n", (F.col("n") == F.max("n").over(Window.partitionBy("b"))).alias("best"))  # an id has at most as many partners as the other vocabulary has ids


def document_links(blocks: DataFrame, counts: DataFrame) -> DataFrame:
    """A row for each document of the blocks: id, its figures, ``n_best`` and ``count_sum`` over its links."""
    asked = block_pairs(blocks).join(counts.withColumnRenamed("n", "total"), ["a", "b"]).select(F.col("block").alias("asking"), "place", "total", "best")
    docs = blocks.drop("pair_a", "pair_b", "pair_n")
    id_type = blocks.schema["id"].dataType.elementType
    schema = T.StructType([T.StructField("id", id_type), *[T.StructField(n, T.LongType()) for n in DOCUMENT], T.StructField("n_best", T.LongType()), T.StructField("count_sum", T.LongType()), T.StructField("groups_sha256", T.StringType())])

    def look_up(docs: pa.Table, asked: pa.Table) -> pa.Table:
        from pyspark.sql.pandas.types import to_arrow_schema

        place = asked.column("place").to_numpy()
        total, best = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
        total[place], best[place] = asked.column("total").to_numpy(), asked.column("best").to_numpy()
        out = []
        for row in docs.to_pylist():  # one
            links = np.frombuffer(row["links"], f"<u{row['width']}")
            at = np.cumsum([0, *row["n_links"]])
            own = {n: row[n] for n in ("id", *DOCUMENT, "groups_sha256")}
            for n, values in (("n_best", best), ("count_sum", total)):
                own[n] = np.diff(np.concatenate([[0], np.cumsum(values[links])])[at])
            out.append(pa.table([pa.array(own[f.name], f.type) for f in to_arrow_schema(schema)], to_arrow_schema(schema)))
        return pa.concat_tables(out) if out else to_arrow_schema(schema).empty_table()

    return docs.groupBy("block").cogroup(asked.groupBy("asking")).applyInArrow(look_up, schema)


def alignments(spark: SparkSession, df: DataFrame, byte_path: str, piece_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """:func:`document_links` of ``df``; the blocks are written once to the shared folder."""
    folder = new_folder(spark, "aligned")
    write_blocks(df, folder, byte_path, piece_path, id_col, text_col)
    blocks = spark.read.schema(_block_type(df.schema[id_col].dataType)).parquet(folder)
    return document_links(blocks, pair_counts(blocks))
