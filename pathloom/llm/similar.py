"""Near-duplicates by word shingles: covering tables over minwise bits find most links, prefixes of the sets all others.

A SimHash of 64 bits differs in about ten bits where two texts share 0.8 of their shingles, which is beyond any radius
that covering masks can afford. A sketch of one bit from each of ``64 * blocks`` minimum hashes differs in a tenth of
its bits there. Each block of 64 bits gets the covering masks of :mod:`simhash`, so a pair with at most ``radius``
differing bits in any block is found for certain: by the pigeonhole, every pair with fewer than
``blocks * (radius + 1)`` differing bits in all; others are found by chance.

That search comes first because it joins large groups by few links. What it leaves apart is searched by an exact filter:
in one order of all shingles, that puts frequent ones last, sets of a similarity of 4 / 5 have one in common among the
first fifth of each. No pair of different groups that has one is left out, so the groups are those of all pairs.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pathloom.operators.components import connected_components, shared_folder

from .common import append_columns, slices, small_batches
from .simhash import RADIUS, covering_masks, tokens_of

WORDS, NUMERATOR, DENOMINATOR = 5, 4, 5  # a similarity of 4 / 5
BLOCKS = 5
#: Members of one bucket that a task compares with as many others; larger buckets are split into such chunks.
CHUNK = 1024
#: Members of small buckets that go to one group together.
TOGETHER = 4096
#: Narrow rows up to which they are broadcast; beyond, the join shuffles.
BROADCAST_ROWS = 1_000_000
#: Table rows that a task makes of the classes' sketches.
ROWS_A_TASK = 1_000_000
#: Most repeated shingles, which come last in the order of all; any such list gives the same links, with more or less work.
FREQUENT = 100_000
#: Shingles among which a task looks for repeated ones at a time, and texts of one batch of prefixes.
COUNTED, PREFIXES = 1_000_000, 500
#: Words of 64 bits in a set's print, and in the shorter one, folded from it, that pairs are looked at by first.
FINE, PRINT = 64, 8
#: Pairs whose prints are looked at together.
PAIRS = 4096
#: The columns that name a group of buckets, or of a large bucket's two chunks.
GROUP = ["gt", "gkey", "x", "y"]
_FAR = np.uint64(1 << 63)


def permutations(n: int) -> tuple[np.ndarray, np.ndarray]:
    """``n`` permutations of 32-bit numbers, ``(x ^ flip) * odd``: without the flip their minima hang together."""
    draw = np.random.default_rng(20240101)
    return draw.integers(0, 1 << 32, n, dtype=np.uint32), draw.integers(0, 1 << 31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """The distinct hashes of the text's runs of ``words`` words, rising; the whole sequence if it is shorter, none without words."""
    tokens = tokens_of(text)
    digest = xxhash.xxh64_intdigest
    if not tokens:
        return np.zeros(0, np.uint64)
    joined = b" ".join(tokens)
    if len(tokens) <= words:
        return np.array([digest(joined)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    return np.unique(np.array([digest(joined[a:b]) for a, b in zip(starts[: 1 - words or None].tolist(), ends[words - 1 :].tolist())], np.uint64))


def class_of(text: str | None) -> int:
    """A signed hash of the text's sequence of words."""
    return xxhash.xxh64_intdigest(b" ".join(tokens_of(text))) - (1 << 63)


def sketch(hashes: np.ndarray, flips: np.ndarray, odd: np.ndarray) -> np.ndarray:
    """One bit of the minimum of each permutation of the hashes, as signed 64-bit words; zeros for none."""
    if not len(hashes):
        return np.zeros(len(odd) // 64, np.int64)
    low = (hashes ^ (hashes >> np.uint64(32))).astype(np.uint32)
    least = np.full(len(odd), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(low), 256):
        np.minimum(least, ((low[at : at + 256, None] ^ flips) * odd).min(axis=0), out=least)
    mixed = (least ^ (least >> np.uint32(15))) * np.uint32(0x9E3779B1)
    return np.packbits(mixed >> np.uint32(31)).view(">i8").astype(np.int64)


def sketched(df: DataFrame, id_col: str, text_col: str, words: int, blocks: int) -> DataFrame:
    """``(id, h, c, n, s0, s1, ...)`` of every row: the hash of its text, that of its sequence of words, the number of
    its shingles, and its sketch."""
    rows = df.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text"))
    names = [f"s{k}" for k in range(blocks)]

    def start():
        flips, odd = permutations(64 * blocks)

        def work(texts):
            made: dict[str, list] = {n: [] for n in ["c", "n", *names]}
            for text in texts:
                own = shingles(text, words)
                made["c"].append(class_of(text))
                made["n"].append(len(own))
                for name, x in zip(names, sketch(own, flips, odd).tolist()):
                    made[name].append(x)
            return made

        return work

    return append_columns(rows, "text", [(n, T.LongType()) for n in ["c", "n", *names]], start).drop("text")


def nearest_links(ids: np.ndarray, prints: np.ndarray, sizes: np.ndarray, most: int) -> list[tuple[int, int]]:
    """The least spanning forest by differing bits over the pairs that differ in ``most`` bits or fewer and whose sizes
    allow the similarity. Ties are ordered by a hash of the pair, so that overlapping sets choose the same links."""
    links = []
    left = np.arange(1, len(ids))
    best, parent, at = np.full(len(left), _FAR), np.zeros(len(left), np.int64), 0
    while len(left):
        d = np.bitwise_count(prints[left] ^ prints[at]).sum(axis=1, dtype=np.uint64)
        tie = ((ids[left] ^ ids[at]).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20)
        fits = (d <= most) & (DENOMINATOR * np.minimum(sizes[left], sizes[at]) >= NUMERATOR * np.maximum(sizes[left], sizes[at]))
        key = np.where(fits, (d << np.uint64(44)) | tie, _FAR)
        closer = key < best
        best[closer], parent[closer] = key[closer], at
        k = int(best.argmin())
        if best[k] != _FAR:
            links.append((int(ids[parent[k]]), int(ids[left[k]])))
        at = left[k]
        keep = np.ones(len(left), bool)
        keep[k] = False
        left, best, parent = left[keep], best[keep], parent[keep]
    return links


def in_groups(keys: DataFrame, sizes: DataFrame, chunk: int) -> DataFrame:
    """``(gt, gkey, x, y, bt, bkey, c)``: the members ``keys (t, key, c)`` of the buckets ``sizes (t, key, held)``, once for
    each group ``(gt, gkey, x, y)`` that they are in.

    Buckets up to ``chunk`` share groups of about ``TOGETHER`` rows, those of the same ``near``, if ``sizes`` has it, one
    group; larger ones are split into chunks by hash, and each pair of chunks is a group of its own. No task gets a
    whole bucket, whatever its size.
    """
    count = sizes.agg(F.count("*"), F.coalesce(F.sum("held"), F.lit(0))).first()
    small = F.broadcast if count[0] <= BROADCAST_ROWS else lambda x: x
    members = keys.join(small(sizes), ["t", "key"])
    chunks = F.ceil(F.col("held") / chunk).cast("int")
    members = members.withColumn("mine", F.pmod(F.xxhash64("c"), chunks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), chunks - 1)))
    shared = F.pmod(F.xxhash64(*(["near"] if "near" in sizes.columns else ["t", "key"])), F.lit(count[1] // TOGETHER + 1))
    first = F.when(F.col("held") <= chunk, F.struct(F.lit(-1).cast("smallint").alias("t"), shared.alias("key"))).otherwise(F.struct("t", "key"))
    members = members.select(first.alias("g"), F.least("mine", "other").alias("x"), F.greatest("mine", "other").alias("y"), "t", "key", "c")
    return members.select("g.*", "x", "y", "t", "key", "c").toDF(*GROUP, "bt", "bkey", "c")


def buckets_of(pdf: pd.DataFrame) -> list[tuple[int, int]]:
    """Where each bucket of more than one row begins and ends in a group's rows, which are in order of ``bt, bkey``."""
    bt, bkey = pdf["bt"].to_numpy(), pdf["bkey"].to_numpy()
    cuts = [0, *(np.flatnonzero((bt[1:] != bt[:-1]) | (bkey[1:] != bkey[:-1])) + 1).tolist(), len(bt)]
    return [(a, b) for a, b in zip(cuts, cuts[1:]) if b - a > 1]


def candidate_links(classes: DataFrame, blocks: int = BLOCKS, radius: int = RADIUS, most: int | None = None, chunk: int = CHUNK) -> DataFrame:
    """Links ``(a, b)`` between classes ``(c, n, s0, ...)``: in each bucket of each table a least spanning forest over
    the pairs within ``most`` bits (a quarter more than the mean at the similarity, and four deviations, by default).

    A link of the forest that fails the exact test later may leave others out that pass, which :func:`links_between`
    finds. The union of the forests of a large bucket's chunks (:func:`in_groups`) holds that of the whole bucket.
    """
    bits = 64 * blocks
    mean = bits * (DENOMINATOR - NUMERATOR) / DENOMINATOR / 2
    most = int(mean + 4 * (mean * 0.9) ** 0.5) if most is None else most
    names = [f"s{k}" for k in range(blocks)]
    masks = covering_masks(radius)
    tables = F.array(*[F.struct(F.lit(len(masks) * i + k).cast("smallint").alias("t"), F.col(s).bitwiseAND(F.lit(m)).alias("key")) for i, s in enumerate(names) for k, m in enumerate(masks)])
    keys = classes.select("c", *names)
    keys = keys.repartition(max(1, -(-keys.count() * len(names) * len(masks) // ROWS_A_TASK))).select("c", F.inline(tables))
    sizes = keys.groupBy("t", "key").agg(F.count("*").alias("held")).where("held > 1").checkpoint()
    members = in_groups(keys, sizes, chunk).join(classes.select("c", "n", *names), "c").select(*GROUP, "bt", "bkey", "c", "n", *names)

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["bt", "bkey"])
        ids, n, prints = pdf["c"].to_numpy(), pdf["n"].to_numpy(), pdf[names].to_numpy(np.int64).view(np.uint64)  # a count of bits is one of the absolute value
        found = [x for a, b in buckets_of(pdf) for x in nearest_links(ids[a:b], prints[a:b], n[a:b], most)]
        return pd.DataFrame(sorted({(min(x), max(x)) for x in found}), columns=["a", "b"], dtype="int64")

    return members.groupBy(*GROUP).applyInPandas(search, "a long, b long").distinct()


def new_sets(batches: Iterable[pa.RecordBatch], words: int) -> Iterator[tuple[int, np.ndarray]]:
    """``(c, set)`` of each text of the batches that has words, those of the same words once."""
    seen = set()
    for batch in batches:
        for part in slices(batch, "text"):
            for text in part.column(0).to_pylist():
                c = class_of(text)
                if c not in seen:
                    seen.add(c)
                    own = shingles(text, words)
                    if len(own):
                        yield c, own
        batch = part = None
        pa.default_memory_pool().release_unused()


def parities(hashes: np.ndarray, width: int = FINE) -> np.ndarray:
    """A bit for each residue of the hashes, set if an odd number of them has it: two sets' prints differ in no more bits
    than the sets in members."""
    odd = np.bincount((hashes % np.uint64(64 * width)).astype(np.int64), minlength=64 * width) & 1
    return np.packbits(odd.astype(np.uint8)).view(">i8").astype(np.int64)


def prefix(hashes: np.ndarray, frequent: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The first of a set's members, as many as a similar set cannot lack all of: in order of their hashes, those in
    ``frequent``, which rises, behind all others, by their ``place``."""
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, hashes), len(frequent) - 1)
        hashes = hashes[np.argsort(np.where(frequent[at] == hashes, place[at], 0), kind="stable")]
    return hashes[: len(hashes) + 1 + (-NUMERATOR * len(hashes)) // DENOMINATOR]


def repeated_shingles(texts: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """``(hashes, places)`` of the ``FREQUENT`` shingles that repeat most: hashes rise, of places more frequent ones have
    higher. Each task counts what repeats among ``COUNTED`` shingles; it only sets the order that :func:`prefix` takes."""

    def run(batches):
        held, size = [], 0
        for _, own in new_sets(batches, words):
            held.append(own)
            size += len(own)
            if size >= COUNTED:
                yield counted(held)
                held, size = [], 0
        if held:
            yield counted(held)

    def counted(held):
        values, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(values[n > 1].view(np.int64)), pa.array(n[n > 1])], ["key", "n"])

    most = texts.mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "key").limit(FREQUENT).collect()
    hashes = np.array([r["key"] for r in most], np.int64).view(np.uint64)
    order = np.argsort(hashes)
    return hashes[order], (len(most) - np.arange(len(most)))[order]


def possible_pairs(ids: np.ndarray, groups: np.ndarray, prints: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    """All pairs of different groups, one array a row, whose sizes and prints (:func:`parities`) do not rule the similarity out."""
    found = []
    for k in range(len(ids) - 1):
        least, most = np.minimum(sizes[k + 1 :], sizes[k]), np.maximum(sizes[k + 1 :], sizes[k])
        at = np.flatnonzero((groups[k + 1 :] != groups[k]) & (DENOMINATOR * least >= NUMERATOR * most)) + k + 1
        apart = np.bitwise_count(prints[at] ^ prints[k]).sum(axis=1, dtype=np.int64)
        at = at[(NUMERATOR + DENOMINATOR) * apart <= (DENOMINATOR - NUMERATOR) * (sizes[at] + sizes[k])]
        found.append(np.column_stack([np.minimum(ids[at], ids[k]), np.maximum(ids[at], ids[k])]))
    return found


def pairs_of(members: pd.DataFrame, about: pd.DataFrame) -> pd.DataFrame:
    """``(a, b)``, each once: the pairs that share a bucket of one group's ``members (bt, bkey, c)`` and that sizes, folded
    prints and whole ones do not rule out. ``about`` has each class of the group once, ``(c, n, component, print)``.

    Buckets of the same members are searched once, as those of edited copies of one text mostly are.
    """
    about, members = about.sort_values("c"), members.sort_values(["bt", "bkey", "c"])
    c, n, groups = (about[x].to_numpy() for x in ("c", "n", "component"))
    prints = np.frombuffer(b"".join(about["print"]), np.uint64).reshape(-1, FINE)
    folded = np.bitwise_xor.reduce(prints.reshape(-1, FINE // PRINT, PRINT), axis=1)
    at, searched, found = np.searchsorted(c, members["c"].to_numpy()), set(), [np.zeros((0, 2), np.int64)]
    for first, last in buckets_of(members):
        own = at[first:last]
        if (seen := own.tobytes()) not in searched:
            searched.add(seen)
            found += possible_pairs(own, groups[own], folded[own], n[own])
    a, b = np.unique(np.concatenate(found), axis=0).T
    apart = [np.bitwise_count(prints[a[k : k + PAIRS]] ^ prints[b[k : k + PAIRS]]).sum(axis=1, dtype=np.int64) for k in range(0, len(a), PAIRS)]
    fits = (NUMERATOR + DENOMINATOR) * np.concatenate([np.zeros(0, np.int64), *apart]) <= (DENOMINATOR - NUMERATOR) * (n[a] + n[b])
    return pd.DataFrame({"a": c[a[fits]], "b": c[b[fits]]})


def links_between(df: DataFrame, parts: DataFrame, text_col: str, words: int = WORDS, chunk: int = CHUNK) -> DataFrame:
    """Every pair of classes ``(a, b)`` of different groups ``parts (c, component)`` that may have a similarity of 4 / 5, so
    all that have it: they share a shingle among the first ones of both (:func:`prefix`).

    Shingles that one group alone begins with are left out, so large groups cost nothing here. Edited copies of one text
    share many buckets: buckets go together by the least of their groups, so such a pair is looked at in few tasks, and
    by the whole prints before it is a row. What is compared grows with the square of the texts that share a shingle, in
    groups of bounded size; the rows are those that prints do not tell from similar ones.
    """
    small_batches(df.sparkSession)
    texts = df.select(F.col(text_col).alias("text"))
    frequent, place = repeated_shingles(texts, words)
    schema = T.StructType([T.StructField("c", T.LongType()), T.StructField("n", T.LongType()), T.StructField("first", T.ArrayType(T.LongType())), T.StructField("print", T.BinaryType())])

    def run(batches):
        made = []
        for c, own in new_sets(batches, words):
            made.append([c, len(own), prefix(own, frequent, place).view(np.int64), parities(own).tobytes()])
            if len(made) == PREFIXES:
                yield batch_of(made)
                made = []
        if made:
            yield batch_of(made)

    def batch_of(made):
        kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*made), kinds)], schema.names)

    parts = parts.checkpoint()
    parts = F.broadcast(parts) if parts.count() <= BROADCAST_ROWS else parts
    firsts = texts.mapInArrow(run, schema).groupBy("c").agg(*[F.first(x).alias(x) for x in schema.names[1:]])
    firsts = firsts.join(parts, "c", "left").withColumn("component", F.coalesce("component", "c")).checkpoint()
    keys = firsts.select("c", "component", F.explode("first").alias("key"))
    sizes = keys.groupBy("key").agg(F.count("*").alias("held"), F.min("component").alias("least"), F.max("component").alias("most")).where("least < most")
    sizes = sizes.select(F.lit(0).cast("smallint").alias("t"), "key", "held", "least").checkpoint()
    shares = sizes.groupBy("least").agg(F.ceil(F.sum("held") / TOGETHER).alias("shares")).checkpoint()
    shares = F.broadcast(shares) if shares.count() <= BROADCAST_ROWS else shares
    near = F.xxhash64("least", F.pmod(F.xxhash64("key"), F.col("shares"))).alias("near")
    sizes = sizes.join(shares, "least").select("t", "key", "held", near).checkpoint()
    members = in_groups(keys.select(F.lit(0).cast("smallint").alias("t"), "key", "c"), sizes, chunk).checkpoint()
    same = [f"_{x}" for x in GROUP]  # a cogroup takes no two columns for one
    about = members.select(*GROUP, "c").distinct().toDF(*same, "c").join(firsts.select("c", "n", "component", "print"), "c")
    return members.groupBy(*GROUP).cogroup(about.groupBy(*same)).applyInPandas(pairs_of, "a long, b long").distinct()


def verified(links: DataFrame, classes: DataFrame, df: DataFrame, text_col: str, words: int) -> DataFrame:
    """The links whose two classes have an exact similarity of 4 / 5 or more: shared shingles over all of both."""
    links = links.checkpoint()
    ends = links.select(F.explode(F.array("a", "b")).alias("c")).distinct()
    wanted = classes.select("c", "h").join(ends, "c", "left_semi").checkpoint()
    wanted = F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted
    texts = df.select(F.col(text_col).alias("text"), F.xxhash64(text_col).alias("h")).join(wanted, "h").groupBy("c").agg(F.first("text").alias("text"))
    sets = append_columns(texts, "text", [("set", T.ArrayType(T.LongType()))], lambda: lambda values: {"set": [shingles(t, words).view(np.int64) for t in values]})
    sets = sets.select("c", "set").checkpoint()
    both = links.join(sets.toDF("a", "sa"), "a").join(sets.toDF("b", "sb"), "b")
    shared = F.size(F.array_intersect("sa", "sb"))
    return both.where((NUMERATOR + DENOMINATOR) * shared >= NUMERATOR * (F.size("sa") + F.size("sb"))).select("a", "b").checkpoint()


def components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, blocks: int = BLOCKS, radius: int = RADIUS) -> tuple[DataFrame, DataFrame]:
    """``(rows, parts)``: ``(id, h, c, n, s0, ...)`` of every row, and ``(c, component)`` of every class that has a link."""
    shared_folder(df.sparkSession)
    rows = sketched(df, id_col, text_col, words, blocks).checkpoint()
    classes = rows.groupBy("c").agg(F.min("h").alias("h"), *[F.first(x).alias(x) for x in ["n", *[f"s{k}" for k in range(blocks)]]]).where("n > 0").checkpoint()
    links = verified(candidate_links(classes, blocks, radius), classes, df, text_col, words)
    parts = connected_components(links, "a", "b").select(F.col("vertex").alias("c"), "component").checkpoint()
    more = verified(links_between(df, parts, text_col, words), classes, df, text_col, words)
    if more.isEmpty():
        return rows, parts
    return rows, connected_components(links.unionByName(more), "a", "b").select(F.col("vertex").alias("c"), "component")


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, blocks: int = BLOCKS, radius: int = RADIUS) -> DataFrame:
    """``df`` less all but one row of each group of texts that links of a similarity of 0.8 or more over ``words``-word
    shingles connect: the row with the smallest id stays, of these that with the smallest hash of its text.

    Words are runs of anything but white space, A-Z in lower case; texts of the same words are one class, so a group
    of copies of any size is one value in the search, and null, empty and wordless texts are one class without links.
    Two texts of fewer than ``words`` words are similar only if their words are the same. Every link used is exact, and
    the groups are those of all pairs at 0.8 or more: what the blocks leave apart is searched by :func:`links_between`.

    A row with a null id stays only if no row of its group has an id. Rows are judged by id and text, so neither rows
    that share an id nor those without one stand for each other; of rows equal in both one stays. Only ids and hashes
    travel: the rows are filtered by what is to drop, which is broadcast if it is counted to be little. No rows give
    no rows; all columns stay, whatever their names.
    """
    rows, parts = components(df, id_col, text_col, words, blocks, radius)
    # The best row of each class comes first: copies of one text are one value in the joins below.
    order = F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("h").alias("h"))
    best = rows.groupBy("c").agg(F.min(order).alias("o")).join(parts, "c", "left").groupBy(F.coalesce("component", "c"), F.col("component").isNull()).agg(F.min("o").alias("o"))
    first = best.select(F.col("o.id").alias("i"), F.col("o.h").alias("hh"), F.lit(True).alias("stays"))
    judged = rows.groupBy("id", "h").agg(F.count("*").alias("copies"))
    found = judged.join(first, F.col("id").eqNullSafe(F.col("i")) & F.col("h").eqNullSafe(F.col("hh")), "left")
    found = found.select("id", "h", "copies", F.coalesce("stays", F.lit(False)).alias("stays")).checkpoint()
    dropped = found.where("not stays")
    kept = less(df, dropped, id_col, text_col)
    repeated = found.where("stays and copies > 1")
    if repeated.isEmpty():
        return kept
    again = only(kept, repeated, id_col, text_col).dropDuplicates([id_col, text_col])
    return less(kept, repeated, id_col, text_col).unionByName(again)


def _keyed(df: DataFrame, rows: DataFrame, id_col: str, text_col: str, how: str) -> DataFrame:
    """``df`` joined with ``(id, h)`` of ``rows``; the hash column is given a name that ``df`` has not."""
    name = "h"
    while name in {c.lower() for c in df.columns}:
        name += "_"
    ids = rows.select(F.struct("id", "h").alias(name))
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids
    mine = df[id_col].eqNullSafe(ids[name]["id"]) & (F.xxhash64(df[text_col]) == ids[name]["h"])
    return df.join(ids, mine, how)


def less(df: DataFrame, rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``df`` without the rows whose id and hash of the text ``rows (id, h)`` has."""
    return _keyed(df, rows, id_col, text_col, "left_anti")


def only(df: DataFrame, rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of ``df`` whose id and hash of the text ``rows (id, h)`` has."""
    return _keyed(df, rows, id_col, text_col, "left_semi")
