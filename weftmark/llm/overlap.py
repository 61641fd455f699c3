"""Same or near-same records across splits, by bit fingerprints and segmented code blocks.

Two records match if their word sets share at least ``share`` of their union, that is, if they differ in at
most (1 - t) / (1 + t) of their summed sizes in words. Each distinct word set gets a fingerprint in segments
of 64 bits: a word flips, in the segment it belongs to, the bits of its hash. So a segment changes only with
its words, and the Hamming radius in segments is the number of words that may differ.

* Sizes are cut into bands by the larger set of a pair (each a quarter wider than the one before). In a band
  with radius r the segments form r // 3 + 1 groups of four. Some group holds at most two of r differences,
  which touch at most two of its segments: every two segments of a group are a code block, six a group.
  Similar sets share a block; nothing is lost by the join, and a record has blocks in proportion to its words.
* Splits are joined on the blocks. A second fingerprint, the parity of the words in 52 bits, goes along with the
  size in one number: pairs outside the Hamming radius are dropped inside the join, the rest verified on words.

Frequent words are dealt to the segments in turn, so that none is left with rare words or none at all by chance;
this changes the load, not the result. The table of their ranks holds words with at least 1 / 50,000 of all
occurrences (at most 50,000 words, whatever the corpus); other words go by their hash.

Copies are collapsed to one word set before any join. Blocks are counted in 65,536 buckets; those of buckets far
over the mean are joined in pairs of chunks, so that a hot block is spread over the cluster. No join here may
broadcast a side that grows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftmark.llm.common import plain
from weftmark.runtime import materialize

LEAST_WORDS = 8
NUM, DEN = 4, 5  # similarity 0.8 as an exact fraction
COUNTED_WORDS = 50_000
BUCKETS = 65_536
CHUNK = 4096  # rows of a side of a hot block that meet
PARITY = 52  # bits of the parity fingerprint; the 12 above them hold the size
SIZE_CAP = 4095  # larger sizes are marked by it; at such sizes neither test of the marks drops a pair wrongly
PAIRS = ((0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3))


def word_sets(df: DataFrame, corpus: str, text: str = "text") -> DataFrame:
    """(corpus, id, split, source, words, set_key): distinct words of each record, and a 128-bit key of the set.

    Records with null id, text or split, or fewer than 8 distinct words, take no part.
    """
    words = F.sort_array(F.array_distinct(F.regexp_extract_all(F.lower(F.col(text)), F.lit("[a-z0-9]+"), F.lit(0))))
    return (
        df.filter(F.col("id").isNotNull())
        # by explode, which the optimizer does not see through: the words are taken once, not again for size and key
        .select(F.lit(corpus).alias("corpus"), "id", plain(F.col("split")).alias("split"), "source", F.explode(F.array(words)).alias("words"))
        .filter((F.size("words") >= LEAST_WORDS) & F.col("split").isNotNull())
        .withColumn("set_key", F.md5(F.array_join("words", " ")))
    )


@cache
def bands(largest: int) -> list[tuple[int, int]]:
    """(over, up to) sizes of the larger set of a pair, up to the band of ``largest``."""
    out = [(0, 8)]
    while out[-1][1] < largest:
        top = out[-1][1]
        out.append((top, max(top + 1, top * 5 // 4)))
    return out


def _mixed(x: np.ndarray) -> np.ndarray:
    """Bits of 64-bit numbers spread (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode(), digest_size=8).digest(), "little")


def code_blocks(starts: np.ndarray, hashes: np.ndarray, ranks: np.ndarray, salts: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, block) of sets whose words are ``hashes[starts[i]:starts[i + 1]]``; ``ranks`` deal words to segments."""
    sizes = np.diff(starts)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    rows, blocks = [np.empty(0, np.int64)], [np.empty(0, np.uint64)]
    reach = int(sizes.max(initial=0)) * den // num
    for k, (over, top) in enumerate(bands(reach)):
        takes = (sizes <= top) & (sizes * den >= (over + 1) * num)
        if not takes.any():
            continue
        groups = 2 * top * (den - num) // (den + num) // 3 + 1
        local = np.cumsum(takes) - 1
        word = takes[owner]
        code = np.zeros(int(takes.sum()) * groups * 4, dtype=np.uint64)
        np.bitwise_xor.at(code, local[owner[word]] * (groups * 4) + (ranks[word] % np.uint64(groups * 4)).astype(np.int64), hashes[word])
        code = code.reshape(-1, groups, 4)
        salt = salts[takes][:, None] + np.arange(groups, dtype=np.uint64)[None, :] * np.uint64(8) + np.uint64((k + 1) << 40)
        for n, (x, y) in enumerate(PAIRS):
            blocks.append(_mixed(_mixed(_mixed(code[:, :, x] + np.uint64(n)) ^ code[:, :, y]) + salt + np.uint64(n)).ravel())
            rows.append(np.repeat(np.flatnonzero(takes), groups))
    return np.concatenate(rows), np.concatenate(blocks)


def _coded(classes: DataFrame, ranks: dict[str, int], num: int, den: int) -> DataFrame:
    """(class_id, mark, blocks, in_train, in_other): size and parity fingerprint in one number, and the code blocks."""
    shared = classes.sparkSession.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = shared.value
        for batch in batches:
            column = batch.column("words")
            words = column.flatten().dictionary_encode()
            known = words.dictionary.to_pylist()
            marks = np.array([_hash(w) for w in known], dtype=np.uint64)
            place = np.array([rank.get(w, m) for w, m in zip(known, marks.tolist())], dtype=np.uint64)
            at = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            starts = np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
            salts = np.array([_hash(c) for c in batch.column("corpus").to_pylist()], dtype=np.uint64)
            rows, blocks = code_blocks(starts, marks[at], place[at], salts, num, den)
            sizes = np.diff(starts)
            mark = np.minimum(sizes, SIZE_CAP).astype(np.uint64) << np.uint64(PARITY)
            np.bitwise_xor.at(mark, np.repeat(np.arange(len(sizes)), sizes), np.uint64(1) << (marks[at] >> np.uint64(8)) % np.uint64(PARITY))
            order = np.argsort(rows, kind="stable")
            ends = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=len(sizes)))]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(blocks[order].view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("class_id"), pa.array(mark.view(np.int64)), lists, batch.column("in_train"), batch.column("in_other")],
                ["class_id", "mark", "blocks", "in_train", "in_other"],
            )

    return classes.select("class_id", "corpus", "words", "in_train", "in_other").mapInArrow(run, "class_id long, mark long, blocks array<long>, in_train boolean, in_other boolean")


def _ranks(classes: DataFrame) -> dict[str, int]:
    """Places of the most frequent words, at most COUNTED_WORDS of them, counted over all sets."""
    counted = classes.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    total = classes.agg(F.sum(F.size("words"))).scalar()
    rows = counted.filter(F.col("n") * COUNTED_WORDS >= total).collect()
    return {r["word"]: k for k, r in enumerate(sorted(rows, key=lambda r: (-r["n"], r["word"])))}


def _chunked(side: DataFrame, hot: DataFrame, own: str, other: str, c: str, d: str) -> DataFrame:
    """Rows of one side of the join with the chunk pair they go to: (0, 0), or in a hot bucket their own chunk
    (column ``c``) with each chunk of the other side (column ``d``)."""
    known = side.withColumn("bucket", F.pmod("block", F.lit(BUCKETS)).cast("int")).join(F.broadcast(hot), "bucket", "left")
    mine = F.coalesce(F.pmod(F.xxhash64(side.columns[1]), F.col(own)), F.lit(0)).cast("int")
    return known.select(*side.columns, mine.alias(c), F.explode(F.sequence(F.lit(0), F.coalesce(F.col(other), F.lit(1)) - 1)).alias(d))


def similar_sets(classes: DataFrame, num: int = NUM, den: int = DEN, chunk: int = CHUNK) -> DataFrame:
    """(class_a, class_b) of one corpus, class_a in train and class_b in another split, similarity num / den or more.

    ``classes``: class_id, corpus, words, in_train, in_other; distinct word sets. Pairs of a class with itself
    are left out. Blocks of buckets with over ``chunk`` rows of a side and eight times the mean go in chunk pairs.
    """
    prints = materialize(_coded(classes, _ranks(classes), num, den))
    bucket = prints.select(F.explode("blocks").alias("block"), "in_train", "in_other").groupBy(F.pmod("block", F.lit(BUCKETS)).cast("int").alias("bucket"))
    counts = materialize(bucket.agg(F.count_if("in_train").alias("a"), F.count_if("in_other").alias("b")))
    mean = counts.agg(F.greatest(F.lit(chunk), (F.sum(F.col("a") + F.col("b")) * 8 / BUCKETS).cast("long"))).scalar()
    # at most an eighth of the buckets
    hot = counts.filter((F.greatest("a", "b") > mean) & (F.least("a", "b") > 0)).select("bucket", F.ceil(F.col("a") / chunk).cast("int").alias("ca"), F.ceil(F.col("b") / chunk).cast("int").alias("cb"))
    a = prints.filter("in_train").select(F.explode("blocks").alias("block"), F.col("class_id").alias("class_a"), F.col("mark").alias("mark_a"))
    b = prints.filter("in_other").select(F.explode("blocks").alias("block"), F.col("class_id").alias("class_b"), F.col("mark").alias("mark_b"))
    size_a, size_b = F.shiftrightunsigned("mark_a", PARITY), F.shiftrightunsigned("mark_b", PARITY)
    apart = F.bit_count(F.col("mark_a").bitwiseXOR(F.col("mark_b")).bitwiseAND(F.lit((1 << PARITY) - 1)))
    near = (
        (F.col("class_a") != F.col("class_b"))
        & (size_a * den >= size_b * num)
        & (size_b * den >= size_a * num)
        & (apart * (den + num) <= (size_a + size_b) * (den - num))
    )
    left, right = _chunked(a, hot, "ca", "cb", "x", "y"), _chunked(b, hot, "cb", "ca", "y", "x")
    pairs = left.hint("merge").join(right, ["block", "x", "y"]).filter(near).select("class_a", "class_b").distinct()
    words = classes.select("class_id", "words").hint("merge")
    both = F.size(F.array_intersect("wa", "wb"))
    return (
        pairs.join(words.toDF("class_a", "wa").hint("merge"), "class_a").join(words.toDF("class_b", "wb").hint("merge"), "class_b")
        .filter(both * (den + num) >= (F.size("wa") + F.size("wb")) * num)
        .select("class_a", "class_b")
    )


def split_overlaps(corpora: dict[str, DataFrame], train: str = "train") -> tuple[DataFrame, DataFrame]:
    """(members, links): (corpus, id, split, source, class_id) of all records that take part, and similar classes.

    A record repeated with equal id, split, source and text counts once. The links hold class pairs across
    splits, a class that itself spans train and another split included as (c, c).
    """
    parts = [word_sets(df, name) for name, df in corpora.items()]
    records = parts[0]
    for part in parts[1:]:
        records = records.unionByName(part)
    records = materialize(records)
    in_train = F.col("split") == train
    classes = materialize(
        records.groupBy("corpus", "set_key")
        .agg(F.first("words").alias("words"), F.bool_or(in_train).alias("in_train"), F.bool_or(~in_train).alias("in_other"))
        .withColumn("class_id", F.monotonically_increasing_id())
    )
    members = materialize(
        records.select("corpus", "id", "split", "source", "set_key").distinct().join(classes.select("corpus", "set_key", "class_id").hint("merge"), ["corpus", "set_key"]).drop("set_key")
    )
    copies = classes.filter("in_train and in_other").select(F.col("class_id").alias("class_a"), F.col("class_id").alias("class_b"))
    links = materialize(similar_sets(classes).unionByName(copies))
    return members, links


def overlap_pairs(members: DataFrame, links: DataFrame, train: str = "train") -> DataFrame:
    """(corpus, id_a, id_b), id_a < id_b: one record of train, one of another split, of linked classes."""
    a = members.filter(F.col("split") == train).select("corpus", F.col("class_id").alias("class_a"), F.col("id").alias("x"))
    b = members.filter(F.col("split") != train).select(F.col("class_id").alias("class_b"), F.col("id").alias("y"))
    return (
        links.join(a.hint("merge"), "class_a").join(b.hint("merge"), "class_b").filter("x <> y")
        .select("corpus", F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()
    )


def overlap_counts(members: DataFrame, links: DataFrame, train: str = "train") -> DataFrame:
    """(corpus, split, source, records, overlapping): records of each split but train, and how many of them have a train record alike."""
    hit = links.select(F.col("class_b").alias("class_id")).distinct().withColumn("hit", F.lit(1))
    return (
        members.filter(F.col("split") != train).join(hit.hint("merge"), "class_id", "left")
        .groupBy("corpus", "split", "source")
        .agg(F.count_distinct("id").alias("records"), F.count_distinct(F.when(F.col("hit") == 1, F.col("id"))).alias("overlapping"))
    )
