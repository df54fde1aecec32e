"""SimHash fingerprints and exact linking within a Hamming radius by covering locality-sensitive hashing.

Each bit position gets a vector of ``radius + 1`` bits; the mask of a nonzero vector v keeps the positions whose
vector has an odd product with v. Any ``radius`` positions leave a nonzero v orthogonal to all of them, so two
fingerprints within the radius agree under at least one of the ``2**(radius + 1) - 1`` masks: no pair is missed.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pathloom.operators.components import connected_components, shared_folder

from .common import append_columns

WORDS = 4
RADIUS = 4
SEED = 42
#: Fingerprints of one bucket that a task compares with as many others; larger buckets are split into such chunks.
CHUNK = 1024
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def tokens_of(text: str | None) -> list[bytes]:
    """Runs of anything but space, tab, line feed, vertical tab, form feed and carriage return, A-Z in lower case."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()


def _counts(text: str | None, words: int) -> tuple[np.ndarray, int]:
    """How often each bit, from the highest, is set in the hashes of the text's shingles, and how many there are."""
    tokens = tokens_of(text)
    if not tokens:
        return np.zeros(64, np.int64), 0
    joined = b" ".join(tokens)
    digest = xxhash.xxh64_intdigest
    if len(tokens) <= words:
        hashes = [digest(joined, SEED)]
    else:
        ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts[: 1 - words or None].tolist(), ends[words - 1 :].tolist())]
    total = np.zeros(64, np.int64)
    values = np.array(hashes, dtype=">u8").view(np.uint8).reshape(-1, 8)
    for at in range(0, len(values), 65536):
        total += np.unpackbits(values[at : at + 65536], axis=1).sum(axis=0, dtype=np.int64)
    return total, len(hashes)


def simhash(text: str | None, words: int = WORDS) -> int:
    """A signed 64-bit fingerprint: a bit is set if it is set in over half the hashes. No words: 0."""
    total, n = _counts(text, words)
    return int(np.packbits(2 * total > n).view(">i8")[0]) if n else 0


def fingerprints(df: DataFrame, text_col: str = "text", words: int = WORDS) -> DataFrame:
    """``df`` with ``fp``, the fingerprint of every whole text (null: as an empty text, 0); a column of that name is replaced."""
    return append_columns(df, text_col, [("fp", T.LongType())], lambda: lambda texts: {"fp": [simhash(t, words) for t in texts]})


def covering_masks(radius: int = RADIUS) -> list[int]:
    """The signed 64-bit masks; position i has the vector ``i % (2**(radius+1) - 1) + 1``, so none is zero."""
    vectors = (1 << (radius + 1)) - 1
    masks = []
    for v in range(1, vectors + 1):
        bits = sum(1 << i for i in range(64) if ((i % vectors + 1) & v).bit_count() % 2)
        masks.append(bits - (1 << 64) if bits >> 63 else bits)
    return masks


def _keys(distinct: DataFrame, radius: int) -> DataFrame:
    masks = covering_masks(radius)
    tables = F.array(*[F.struct(F.lit(k).cast("tinyint").alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for k, m in enumerate(masks)])
    return distinct.select("fp", F.inline(tables))


def _near(a: Column, b: Column, radius: int) -> Column:
    return F.bit_count(a.bitwiseXOR(b)) <= radius


def spanning(left: np.ndarray, right: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links within the radius that connect what all such links between the two sets, and within them, connect.

    A search from each value looks only at values not yet reached, so a dense group costs few comparisons and a group
    of n gives at most n - 1 links.
    """
    rest = np.unique(np.concatenate([left, right]))
    links = []
    while len(rest):
        frontier, rest = [rest[0]], rest[1:]
        while frontier and len(rest):
            at = frontier.pop()
            near = np.bitwise_count((rest ^ at).view(np.uint64)) <= radius  # of a signed number it would count the absolute value's
            if near.any():
                found = rest[near]
                links += [(int(at), int(x)) for x in found]
                frontier += list(found)
                rest = rest[~near]
    return links


def near_links(distinct: DataFrame, radius: int = RADIUS, chunk: int = CHUNK) -> DataFrame:
    """Links ``(src, dst)`` whose components are those of all pairs of distinct ``fp`` within the radius.

    A bucket of two is a pair, checked natively. A larger bucket goes to a grouped search that returns spanning links
    only; one beyond ``chunk`` is split into chunks by hash, and each pair of chunks is a group of its own, so no task
    gets a whole bucket, whatever its size.
    """
    keys = _keys(distinct, radius)
    sizes = keys.groupBy("t", "key").agg(F.count("*").alias("n"), F.min("fp").alias("src"), F.max("fp").alias("dst")).where("n > 1")
    sizes = sizes.checkpoint()
    pairs = sizes.where("n = 2").where(_near(F.col("src"), F.col("dst"), radius)).select("src", "dst")
    larger = sizes.where("n > 2").select("t", "key", F.ceil(F.col("n") / chunk).cast("int").alias("chunks"))
    mine = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
    members = keys.join(larger, ["t", "key"]).withColumn("mine", mine)
    other = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
    members = members.select("t", "key", "fp", "mine", other.alias("other"))
    groups = members.select("t", "key", F.least("mine", "other").alias("a"), F.greatest("mine", "other").alias("b"), "fp")

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        found = spanning(pdf["fp"].to_numpy(), np.zeros(0, np.int64), radius)
        return pd.DataFrame(found, columns=["src", "dst"], dtype="int64")

    return pairs.unionByName(groups.groupBy("t", "key", "a", "b").applyInPandas(search, "src long, dst long"))


def near_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """``(id, fp, component_id)`` for every row: fingerprints within ``radius`` bits link, ``component_id`` is the
    smallest id reachable.

    Copies share a fingerprint and are counted once in the search, so a group of copies of any size is one value there.
    Null and empty texts have fingerprint 0 and link like any other. Rows with a null id take part and have the
    component of their fingerprint (null if no row there has an id); repeated rows each stay; no rows give no rows.
    """
    rows = _prints(df, id_col, text_col, words)
    return _with_class(rows, _by_print(rows, radius))


def _prints(df: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """``(id, h, fp)`` of every row; ``h`` is the hash of its text."""
    shared_folder(df.sparkSession)
    rows = df.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text"))
    return fingerprints(rows, "text", words).select("id", "h", "fp").checkpoint()


def _by_print(rows: DataFrame, radius: int) -> DataFrame:
    """``(fp, component_id, component)`` for every fingerprint; ``component`` is never null, unlike ``component_id``."""
    classes = rows.groupBy("fp").agg(F.min("id").alias("least")).checkpoint()
    parts = connected_components(near_links(classes.select("fp"), radius)).select(F.col("vertex").alias("fp"), "component").checkpoint()
    linked = parts.join(classes, "fp")
    names = linked.groupBy("component").agg(F.min("least").alias("name"))
    named = linked.join(names, "component").select("fp", "name", "component")
    return classes.join(named, "fp", "left").select("fp", F.coalesce("name", "least").alias("component_id"), F.coalesce("component", "fp").alias("component"))


def _with_class(rows: DataFrame, by_print: DataFrame, hot_share: float = 0.001) -> DataFrame:
    """Rows joined with their fingerprint's component; the fingerprints of over ``hot_share`` of all rows, of which
    there are fewer than ``1 / hot_share``, are broadcast instead of shuffled, so a large group is no hot key."""
    many = max(2, int(rows.count() * hot_share))
    hot = rows.groupBy("fp").count().where(F.col("count") > many).select("fp")
    hot_map = F.broadcast(by_print.join(F.broadcast(hot), "fp").select("fp", F.col("component_id").alias("hot_id"), F.lit(True).alias("is_hot")))
    marked = rows.join(hot_map, "fp", "left").withColumn("is_hot", F.coalesce("is_hot", F.lit(False)))
    easy = marked.where("is_hot").select("id", "fp", F.col("hot_id").alias("component_id"))
    rest = marked.where("not is_hot").select("id", "fp").join(by_print, "fp").select("id", "fp", "component_id")
    return easy.unionByName(rest)
