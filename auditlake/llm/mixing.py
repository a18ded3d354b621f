"""Mixing sources to target shares of the tokens, with a cap on repeats.

Texts of a source are laid end to end and cut into blocks of a fixed number of tokens. Every output
shard draws how many blocks it takes of each source (multinomial, held to the totals that meet the
targets). Slot j of a source is mapped through a pseudorandom permutation of its block numbers, one
per round through the source, and slots then fetch their blocks by number.
"""

from __future__ import annotations

import base64
import math
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles, TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.session import materialize, parallelism

#: Vocabulary file of the public tokenizer that sizes are measured in, and its split pattern (fixed values).
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
BLOCK_TOKENS = 256
SHARD_BLOCKS = 1024
#: Least number of groups of shards; there are as many as shards in a group beyond that, and a task for each.
GROUPS = 64

_encoders: dict[str, object] = {}


def encoder(path: str = VOCABULARY):
    """The tokenizer of ``path``, loaded once per process; ``shipped`` brings its file to the executors."""
    if path not in _encoders:
        import tiktoken

        sent = SparkFiles.get(os.path.basename(path)) if SparkFiles._root_directory or SparkFiles._is_running_on_worker else path
        with open(sent if os.path.exists(sent) else path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        _encoders[path] = tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


def shipped(spark: SparkSession, path: str) -> str:
    spark.sparkContext.addFile(path)
    return path


def source_name(c: Column) -> Column:
    """Source in lower case without surrounding space; hyphens and inner space as underscores."""
    t = F.regexp_replace(F.lower(F.regexp_replace(c, r"^\s+|\s+$", "")), r"[\s-]+", "_")
    return F.when(t != "", t)


#: Characters that are encoded at once: the tokenizer is slow on longer texts.
CHUNK = 100_000
#: A space between two words: the split pattern always breaks before it, so cuts there change no token.
_BREAK = re.compile(r"(?<=[^\W_]) (?=[^\W_])")


def pieces(text: str) -> Iterator[str]:
    """The text in parts of at least ``CHUNK`` characters whose tokens, in a row, are those of the whole."""
    at = 0
    while len(text) - at > CHUNK and (m := _BREAK.search(text, at + CHUNK)):
        yield text[at : m.start()]
        at = m.start()
    yield text[at:]


def encode(enc, text: str) -> list[int]:
    return [t for p in pieces(text) for t in enc.encode_ordinary(p)]


def count_tokens(enc, text: str) -> int:
    return sum(len(enc.encode_ordinary(p)) for p in pieces(text))


def _count(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            n = [count_tokens(enc, t) for t in b.column("text").to_pylist()]
            rest = [c for c in b.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in rest], pa.array(n, pa.int64())], names=[*rest, "n"])

    return run


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Offset of each row among its source's rows of this partition, which is sorted by source."""
    part, source, total = TaskContext.get().partitionId(), None, 0
    for b in batches:
        names, sizes = b.column("source").to_pylist(), b.column("n").to_pylist()
        at = []
        for s, n in zip(names, sizes, strict=True):
            if s != source:
                source, total = s, 0
            at.append(total)
            total += n
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("source"), b.column("n"), pa.array(at, pa.int64()), pa.array([part] * len(at), pa.int32())], names=["doc_id", "source", "n", "at", "part"])


def lay_out(docs: DataFrame, targets: dict[str, tuple[float, int]], path: str = VOCABULARY, seed: int = 7) -> DataFrame:
    """(doc_id, source, n, start): tokens of each distinct text and its place among its source's tokens.

    Null, blank-source and empty texts and sources without a target are left out. A text that occurs more
    than once counts once, for the source that may repeat it least, then the smallest doc_id. The order
    is pseudorandom. Offsets are running sums over range partitions, so a source that holds a third
    of the texts is spread; one sum per partition and source passes through the driver.
    """
    spark = docs.sparkSession
    cap = F.create_map(*[x for s, (_, r) in targets.items() for x in (F.lit(s), F.lit(r))])
    used = docs.select("doc_id", "text", source_name(F.col("source")).alias("source")).where(F.col("source").isin(list(targets)) & (F.length("text") > 0) & F.col("doc_id").isNotNull())
    sized = materialize(used.select("doc_id", "source", "text", F.xxhash64("text").alias("k1"), F.xxhash64(F.lit(seed), F.reverse("text")).alias("k2")).mapInArrow(_count(shipped(spark, path)), "doc_id bigint, source string, k1 bigint, k2 bigint, n bigint"), "tokens")
    single = sized.where("n > 0").groupBy("k1", "k2").agg(F.min(F.struct(F.try_element_at(cap, F.col("source")).alias("cap"), "doc_id", "source", "n")).alias("r"))
    order = F.xxhash64(F.lit(seed), F.col("r.doc_id"))
    ranged = single.select("r.doc_id", "r.source", "r.n", order.alias("o")).repartitionByRange(parallelism(spark), "source", "o", "doc_id").sortWithinPartitions("source", "o", "doc_id")
    placed = materialize(ranged.select("doc_id", "source", "n").mapInArrow(_running, "doc_id bigint, source string, n bigint, at bigint, part int"), "layout")
    sums = placed.groupBy("source", "part").agg(F.sum("n").alias("s")).collect()
    base, so_far = [], {}
    for r in sorted(sums, key=lambda r: (r["source"], r["part"])):
        base.append((r["source"], r["part"], so_far.get(r["source"], 0)))
        so_far[r["source"]] = so_far.get(r["source"], 0) + r["s"]
    bases = F.broadcast(spark.createDataFrame(base, "source string, part int, base bigint"))
    return placed.join(bases, ["source", "part"]).select("doc_id", "source", "n", (F.col("base") + F.col("at")).alias("start"))


@dataclass(frozen=True)
class Quota:
    """Per source: blocks there are, blocks to take, share asked for."""

    sources: list[str]
    blocks: list[int]
    take: list[int]
    share: list[float]

    @property
    def total(self) -> int:
        return sum(self.take)


def quotas(blocks: dict[str, int], targets: dict[str, tuple[float, int]], wanted: int | None = None) -> Quota:
    """Blocks to take of each source: the largest total, or ``wanted`` if less, that meets all shares.

    A source without blocks can't contribute; its share goes to the others in proportion. Shares are
    rounded to whole blocks by largest remainder; no source exceeds its repeats.
    """
    names = sorted(s for s in targets if blocks.get(s, 0) > 0 and targets[s][0] > 0 and targets[s][1] > 0)
    if not names:
        return Quota([], [], [], [])
    weight = sum(targets[s][0] for s in names)
    share = [targets[s][0] / weight for s in names]
    cap = [blocks[s] * targets[s][1] for s in names]
    total = math.floor(min(c / w for c, w in zip(cap, share, strict=True)) + 1e-9)
    total = min(total, wanted) if wanted is not None else total
    exact = [w * total for w in share]
    take = [min(math.floor(x + 1e-9), c) for x, c in zip(exact, cap, strict=True)]
    for i in sorted(range(len(names)), key=lambda i: (take[i] - exact[i], names[i])):
        if sum(take) < total and take[i] < cap[i]:
            take[i] += 1
    return Quota(names, [blocks[s] for s in names], take, share)


def draw(rng: np.random.Generator, left: np.ndarray, n: int) -> np.ndarray:
    """Counts per source of ``n`` blocks: multinomial by what is left of each, drawn again beyond that."""
    got = np.minimum(rng.multinomial(n, left / left.sum()), left)
    while (miss := n - int(got.sum())) > 0:
        got += np.minimum(rng.multinomial(miss, (left - got) / (left - got).sum()), left - got)
    return got


def permute(index: np.ndarray, size: int, key: int) -> np.ndarray:
    """Pseudorandom permutation of 0..size-1: a four-round Feistel network with cycle walking."""
    half = max(1, (max(size - 1, 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    x = index.astype(np.uint64)
    todo = np.ones(len(x), bool)
    while todo.any():
        v = x[todo]
        left, right = v >> np.uint64(half), v & mask
        for r in range(4):
            with np.errstate(over="ignore"):
                h = (right + np.uint64((key * 0x9E3779B97F4A7C15 + r * 0xD1B54A32D192ED03) & (2**64 - 1))) * np.uint64(0xBF58476D1CE4E5B9)
                h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
            left, right = right, left ^ ((h ^ (h >> np.uint64(32))) & mask)
        x[todo] = (left << np.uint64(half)) | right
        todo &= x >= np.uint64(size)
    return x.astype(np.int64)


def _slots(quota: Quota, plan: dict[int, tuple[int, int, list[int], list[int]]], seed: int):
    """Slots of a group of shards: its own blocks per source, from its own first index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for g in b.column(0).to_pylist():
                shard, shards, take, first = plan[g]
                rng = np.random.default_rng([seed, 1, g])
                left, at = np.array(take, np.int64), np.array(first, np.int64)
                for k in range(shards):
                    n = min(SHARD_BLOCKS, int(left.sum()))
                    got = draw(rng, left, n)
                    which = rng.permutation(np.repeat(np.arange(len(got)), got))
                    block, epoch = np.zeros(n, np.int64), np.zeros(n, np.int64)
                    for i in np.nonzero(got)[0]:
                        j = at[i] + np.arange(got[i])
                        e = j // quota.blocks[i]
                        for one in np.unique(e):
                            where = np.nonzero(which == i)[0][e == one]
                            block[where] = permute(j[e == one] % quota.blocks[i], quota.blocks[i], hash((seed, int(i), int(one))) & (2**64 - 1))
                            epoch[where] = one
                    left -= got
                    at += got
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([shard + k] * n, pa.int64()), pa.array(np.arange(n), pa.int32()), pa.array(quota.sources, pa.string()).take(pa.array(which)), pa.array(block), pa.array(epoch.astype(np.int32))],
                        names=["shard", "slot", "source", "block", "epoch"],
                    )

    return run


def slots(spark, quota: Quota, seed: int = 7) -> DataFrame:
    """(shard, slot, source, block, epoch): every place of the mixture and the block it holds."""
    schema = "shard bigint, slot int, source string, block bigint, epoch int"
    shards = math.ceil(quota.total / SHARD_BLOCKS)
    if not shards:
        return spark.createDataFrame([], schema)
    groups = min(shards, max(GROUPS, math.isqrt(shards)))
    rng = np.random.default_rng([seed, 0])
    left, first, done, plan = np.array(quota.take, np.int64), np.zeros(len(quota.take), np.int64), 0, {}
    for g in range(groups):
        upto = shards * (g + 1) // groups
        n = min(quota.total, upto * SHARD_BLOCKS) - min(quota.total, done * SHARD_BLOCKS)
        got = draw(rng, left, n)
        plan[g] = (done, upto - done, got.tolist(), first.tolist())
        left, first, done = left - got, first + got, upto
    return spark.range(groups, numPartitions=groups).select("id").mapInArrow(_slots(quota, plan, seed), schema)


def mix(docs: DataFrame, targets: DataFrame, wanted_tokens: int | None = None, block_tokens: int = BLOCK_TOKENS, path: str = VOCABULARY, seed: int = 7) -> DataFrame:
    """(shard, slot, source, block, epoch, doc_id, start, n_tokens): the mixture, piece by piece.

    ``start`` and ``n_tokens`` say which tokens of the text stand in that slot. ``targets``: source,
    target_share, max_repeats, one row per source (few); rows with nulls are left out.
    """
    spark = docs.sparkSession
    known = {r["source"]: (r["target_share"], r["max_repeats"]) for r in targets.select(source_name(F.col("source")).alias("source"), "target_share", "max_repeats").dropna().collect()}
    if not known:
        return spark.createDataFrame([], "shard bigint, slot int, source string, block bigint, epoch int, doc_id bigint, start bigint, n_tokens bigint")
    laid = materialize(lay_out(docs, known, path, seed), "laid")
    size = {r["source"]: r["t"] for r in laid.groupBy("source").agg(F.sum("n").alias("t")).collect()}
    quota = quotas({s: math.ceil(t / block_tokens) for s, t in size.items()}, known, None if wanted_tokens is None else wanted_tokens // block_tokens)
    b = block_tokens
    pieces = laid.select("doc_id", "source", "start", "n", F.explode(F.sequence(F.floor(F.col("start") / b), F.floor((F.col("start") + F.col("n") - 1) / b))).alias("block"))
    lo = F.greatest(F.col("block") * b, F.col("start"))
    hi = F.least((F.col("block") + 1) * b, F.col("start") + F.col("n"))
    cut = pieces.select("source", "block", "doc_id", (lo - F.col("start")).alias("start"), (hi - lo).alias("n_tokens"))
    return slots(spark, quota, seed).join(cut, ["source", "block"]).select("shard", "slot", "source", "block", "epoch", "doc_id", "start", "n_tokens")


def shares(mixture: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, actual_share, n_tokens, most_uses, max_repeats) of each target source.

    ``most_uses`` is how often the most used block stands in the mixture.
    """
    goal = targets.select(source_name(F.col("source")).alias("source"), "target_share", "max_repeats")
    per = mixture.groupBy("source").agg(F.sum("n_tokens").alias("n_tokens"), (F.max("epoch") + 1).alias("most_uses"))
    total = per.agg(F.sum("n_tokens").alias("total"))
    joined = goal.join(F.broadcast(per), "source", "left").join(F.broadcast(total))
    n = F.coalesce("n_tokens", F.lit(0))
    return joined.select("source", "target_share", F.when(F.col("total") > 0, n / F.col("total")).alias("actual_share"), n.alias("n_tokens"), F.coalesce("most_uses", F.lit(0)).alias("most_uses"), "max_repeats")


def _assemble(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            out = []
            for text, start, n in zip(b.column("text").to_pylist(), b.column("start").to_pylist(), b.column("n_tokens").to_pylist(), strict=True):
                out.append(encode(enc, text)[start : start + n])
            rest = [c for c in b.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in rest], pa.array(out, pa.list_(pa.int32()))], names=[*rest, "tokens"])

    return run


def with_tokens(mixture: DataFrame, docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """The mixture with the tokens of each piece."""
    joined = mixture.join(docs.select("doc_id", "text"), "doc_id")
    schema = "doc_id bigint, shard bigint, slot int, source string, block bigint, epoch int, start bigint, n_tokens bigint, tokens array<int>"
    return joined.select("doc_id", "shard", "slot", "source", "block", "epoch", "start", "n_tokens", "text").mapInArrow(_assemble(shipped(docs.sparkSession, path)), schema)
