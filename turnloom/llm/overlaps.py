"""Records of evaluation splits that also occur, exactly or almost, in the training split.

Conversations are taken as word sequences (case, punctuation and white space
aside); equal ones are one class, so copies cost nothing. Pairs with enough words in
common, in any order, are checked exactly: the longest common subsequence must hold
``SHARE`` of the longer conversation's words.

Vector filter: tokens are words with their occurrence number in the text, so two texts
with ``c`` words in common have ``c`` tokens in common. Tokens are hashed to the places
of a vector that holds the root of each place's count; the product of two texts' vectors
is never below their common tokens, and a text's vector has its number of words as its
squared length. Of the vectors only the part along an orthonormal basis is kept, and the
length of what is left out, whose product bounds what it adds. So one matrix product of
a block of training texts with a block of evaluation texts of like length rules out most
pairs, a second look along more of the basis most of the rest, and the smaller count of
each place all but a few. None of these bounds can rule out a pair that holds; rounding
is allowed for. The basis is fitted on some texts, but any basis is right. There is no
cap on the places of a token or on the partners of a record.

Backward search: of the evaluation classes, in shards of bounded size, a full-text
index is stored: the Burrows-Wheeler transform of their words as sorted occurrence
lists, and the suffix array. Where a pair's matches are asked for, its training text is read from its end in the
shard that holds its partner, each word narrowing the rows of the index that the words after
it have led to, until none is left; that is a maximal match, and the next begins before
it. So a text takes one step a word. The places of matches of ``LEAST`` words or more are
looked up, and their words are put together for each evaluation conversation: with
``MATCHED`` of the longer one's words in matches, the pair is one that the search leads to.

Blocks and indexes are files in the shared folder, read by the workers through
pyarrow's file systems. Work: training conversations times evaluation conversations of
like length, a few nanoseconds each.

Defined results: records with null or empty turns, without words or without a
split are in no pair; null utterances and the markers for "no system turn" have
no words; other columns aren't read.
"""

from __future__ import annotations

import io
import itertools
import math
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnloom.runtime import shared_folder, small, stored

SHARE = 0.75
SHARD_WORDS = 3_000_000
TASK_WORDS = 2_000_000
BATCH_WORDS = 60_000
#: Texts of a block at most, and words of it; texts of a product's two sides; pairs looked at again together. They bound
#: memory, drop nothing.
BLOCK = 2_048
BLOCK_WORDS = 800_000
TILE = 512
TILE_THERE = 2_048
LOOKED_AT = 1_024
#: Places of a vector, for texts of up to WIDTH / WORDS_OF_WIDTH words; longer ones have vectors of more places, up to
#: 2 ** HASH_BITS. Directions of the basis, and of the first look; part of
#: the pairs left by the first look above which the whole basis is used at once. Texts it is fitted on, about. None changes results.
WIDTH = 1_024
WORDS_OF_WIDTH = 2.5
HASH_BITS = 16
DIMS = 256
FIRST_DIMS = 128
CLOSELY = 0.012
FITTED = 3_000
#: More than what 32-bit sums can lose of a squared length, and of a number of words.
ROUNDING = 0.002
MARGIN = 0.02
#: Places of matches followed at once in a worker (those of one text at least); bounds its memory, drops nothing.
HITS = 400_000
#: Words of a maximal match that is looked up; part of the longer conversation that must lie in such matches to be checked.
LEAST = 6
MATCHED = 0.5


def conversation_words(turns: Column) -> Column:
    """The words of all turns, joined by blanks."""
    spoken = F.transform(turns, lambda t: F.concat_ws(" ", F.when(F.lower(F.trim(t["system"])) != "none", t["system"]), t["user"]))
    return F.trim(F.regexp_replace(F.lower(F.array_join(spoken, " ")), r"[^\p{L}\p{N}]+", " "))


def suffix_array(words: np.ndarray, longest: int) -> np.ndarray:
    """Order of the suffixes by their first ``longest`` words at least, by prefix doubling."""
    n = len(words)
    rank = np.unique(words, return_inverse=True)[1].astype(np.int64)
    k = 1
    while True:
        ahead = np.zeros(n, dtype=np.int64)
        ahead[: n - k] = rank[k:] + 1 if k < n else 0
        key = rank * (n + 1) + ahead
        order = np.argsort(key, kind="stable")
        changes = np.empty(n, dtype=np.int64)
        changes[0] = 0
        changes[1:] = np.diff(key[order]) != 0
        rank[order] = np.cumsum(changes)
        k *= 2
        if k > longest or rank[order[-1]] == n - 1:
            return order.astype(np.int32)


def occurrence(words: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each word how often its text had it before."""
    order = np.argsort(doc * (int(words.max(initial=0)) + 1) + words, kind="stable")
    new = np.ones(len(words), dtype=bool)
    new[1:] = (words[order][1:] != words[order][:-1]) | (doc[order][1:] != doc[order][:-1])
    firsts = np.flatnonzero(new)
    out = np.empty(len(words), dtype=np.int64)
    out[order] = np.arange(len(words)) - np.repeat(firsts, np.diff(np.append(firsts, len(words))))
    return out


class ShardIndex:
    """Full-text index over some conversations; word 0 separates them."""

    def __init__(self, names: list[str], vocabulary: list[str], words: np.ndarray, order: np.ndarray, occurrences: np.ndarray, first: np.ndarray):
        self.names, self.words, self.order = names, words, order
        self.ids = {w: i + 1 for i, w in enumerate(vocabulary)}
        self.first, self.n = first, len(words)
        symbol = np.repeat(np.arange(len(first) - 1, dtype=np.int64), np.diff(first))
        self.keys = symbol * (self.n + 1) + occurrences
        ends = np.flatnonzero(words == 0)
        self.starts = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else np.zeros(0, dtype=np.int64)
        self.ends = ends

    @classmethod
    def build(cls, names: list[str], texts: list[str]) -> ShardIndex:
        ids: dict[str, int] = {}
        rows = [[ids.setdefault(w, len(ids) + 1) for w in text.split(" ")] + [0] for text in texts]
        words = np.fromiter((w for row in rows for w in row), dtype=np.int32)
        order = suffix_array(words, max(map(len, rows)))
        before = words[order - 1]  # the transform; the row of suffix 0 wraps round to a separator
        occurrences = np.argsort(before, kind="stable").astype(np.int32)
        first = np.concatenate([[0], np.cumsum(np.bincount(words, minlength=len(ids) + 1))]).astype(np.int64)
        return cls(names, list(ids), words, order, occurrences, first)

    def dump(self) -> bytes:
        out = io.BytesIO()
        occurrences = (self.keys - np.repeat(np.arange(len(self.first) - 1, dtype=np.int64), np.diff(self.first)) * (self.n + 1)).astype(np.int32)
        text = lambda x: np.frombuffer("\n".join(x).encode(), dtype=np.uint8)
        np.savez_compressed(out, names=text(self.names), vocabulary=text(self.ids), words=self.words, order=self.order, occurrences=occurrences, first=self.first)
        return out.getvalue()

    @classmethod
    def load(cls, payload: bytes) -> ShardIndex:
        with np.load(io.BytesIO(payload)) as z:
            lines = lambda x: bytes(x).decode().split("\n")
            return cls(lines(z["names"]), lines(z["vocabulary"]), z["words"], z["order"], z["occurrences"], z["first"])

    def step(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One backward step: the rows whose suffix begins with ``symbol`` and goes on as the rows from lo to hi do."""
        base = symbol.astype(np.int64) * (self.n + 1)
        return np.searchsorted(self.keys, base + lo), np.searchsorted(self.keys, base + hi)

    def maximal(self, words: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Text, words, and rows from lo to hi of each maximal match: all texts are searched backward side by side."""
        first = np.cumsum(sizes) - sizes
        text = np.flatnonzero(sizes > 0)
        at, length = sizes[text].astype(np.int64), np.zeros(len(text), dtype=np.int64)  # words still to read; words of the running match
        lo, hi = np.zeros(len(text), dtype=np.int64), np.full(len(text), self.n, dtype=np.int64)
        found: list[np.ndarray] = []
        while len(text):
            symbol = words[first[text] + at - 1]
            known = (symbol > 0) & (symbol < len(self.first) - 1)
            to_lo, to_hi = self.step(np.where(known, symbol, 0), lo, hi)
            # keys are places in all occurrence lists, so a step also gives the row in the index
            grows = known & (to_hi > to_lo)
            ends = ~grows & (length > 0)
            if ends.any():
                found.append(np.stack([text[ends], length[ends], lo[ends], hi[ends]]))
            lo, hi = np.where(grows, to_lo, 0), np.where(grows, to_hi, self.n)
            at = at - (grows | (length == 0))  # a word that ends a match is read again as the next one's last
            length = np.where(grows, length + 1, 0)
            over = at == 0
            if over.any():
                last = over & (length > 0)
                found.append(np.stack([text[last], length[last], lo[last], hi[last]]))
                text, at, length, lo, hi = text[~over], at[~over], length[~over], lo[~over], hi[~over]
        return tuple(np.concatenate(found, axis=1)) if found else (np.zeros(0, dtype=np.int64),) * 4

    def matched(self, words: np.ndarray, sizes: np.ndarray, share: float = MATCHED, least: int = LEAST) -> Iterator[tuple[int, int, int]]:
        """(text, conversation, words of it in maximal matches) with at least ``share`` of the longer one's words in matches of ``least`` words."""
        text, length, lo, hi = self.maximal(words, sizes)
        kept = np.flatnonzero(length >= least)
        kept = kept[np.argsort(text[kept], kind="stable")]
        text, length, lo, count = text[kept], length[kept], lo[kept], (hi - lo)[kept]
        lengths, hits = self.ends - self.starts, np.concatenate([[0], np.cumsum(count)])
        edges = np.concatenate([[0], np.flatnonzero(np.diff(text)) + 1, [len(text)]]) if len(text) else np.zeros(1, dtype=np.int64)
        at = 0
        while at < len(edges) - 1:  # whole texts, a few at a time
            to = max(at + 1, int(np.searchsorted(hits[edges], hits[edges[at]] + HITS, side="right")) - 1)
            part = slice(edges[at], edges[to])
            c = count[part]
            total = int(c.sum())
            rows = np.arange(total) + np.repeat(lo[part] - (np.cumsum(c) - c), c)
            there = np.searchsorted(self.ends, self.order[rows])
            match = np.repeat(np.arange(len(c)), c)
            once = np.unique(match * len(lengths) + there)  # a conversation may hold a match several times
            match, there = once // len(lengths), once % len(lengths)
            pair, which = np.unique(text[part][match] * len(lengths) + there, return_inverse=True)
            inside = np.bincount(which, weights=length[part][match], minlength=len(pair))
            s, t = pair // len(lengths), pair % len(lengths)
            good = inside >= share * np.maximum(sizes[s], lengths[t])
            yield from ((int(x), int(y), int(z)) for x, y, z in zip(s[good], t[good], inside[good]))
            at = to


class Filter:
    """Bound of the words that two texts have in common, in any order, from vectors; ``basis`` (WIDTH x DIMS, orthonormal) makes it sharp, never wrong."""

    def __init__(self, basis: np.ndarray):
        self.basis = basis.astype(np.float32)

    @classmethod
    def fit(cls, texts: list[str]) -> Filter:
        """The basis that leaves least of these texts' vectors out."""
        moments = np.zeros((WIDTH, WIDTH))
        for i in range(0, len(texts), 1000):
            hashes, sizes = token_hashes([t.split(" ") for t in texts[i : i + 1000]])
            vectors = np.sqrt(counts(hashes, sizes, WIDTH)).astype(np.float64)
            moments += vectors.T @ vectors
        return cls(np.linalg.eigh(moments)[1][:, ::-1][:, :DIMS])

    def vectors(self, held: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Vectors of texts with these ``counts``: short ones for a first look, and whole ones (the same beside another width than the basis's)."""
        roots = np.sqrt(held, dtype=np.float32)
        if held.shape[1] != len(self.basis):
            return roots, roots
        along = roots @ self.basis
        first, whole = (np.sqrt(np.maximum(0, sizes - np.square(x).sum(axis=1)) + ROUNDING) for x in (along[:, :FIRST_DIMS], along))
        return np.column_stack([along[:, :FIRST_DIMS], first]).astype(np.float32), np.column_stack([along, whole]).astype(np.float32)

    def pairs(self, mine: Block, other: Block, share: float = SHARE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places of all texts of both blocks (those of a block by length) with at least ``share`` of the longer one's words in common, and few others."""
        width = max(mine.width, other.width)
        for at in range(0, len(mine.sizes), TILE):
            sizes = mine.sizes[at : at + TILE]
            first, whole, held = (x[at : at + TILE] for x in mine.seen(width, self))
            begin = int(np.searchsorted(other.sizes, share * sizes[0] - MARGIN))
            end = int(np.searchsorted(share * other.sizes - MARGIN, sizes[-1], side="right"))
            for there in range(begin, end, TILE_THERE):
                to = min(end, there + TILE_THERE)
                lengths = other.sizes[there:to]
                first_there, whole_there, held_there = (x[there:to] for x in other.seen(width, self))
                bound = whole @ whole_there.T if mine.closely else first @ first_there.T
                s, t = np.divmod(np.flatnonzero(bound >= (share * np.maximum(sizes[0], lengths) - MARGIN).astype(np.float32)), to - there)
                least = share * np.maximum(sizes[s], lengths[t]) - MARGIN
                good = (bound[s, t] >= least) & (np.minimum(sizes[s], lengths[t]) >= least)
                s, t, least = s[good], t[good], least[good]
                looked_twice = mine.closely
                mine.closely |= len(s) > bound.size * CLOSELY  # the next products along the whole basis
                for some in range(0, len(s), LOOKED_AT):
                    x, y, enough = s[some : some + LOOKED_AT], t[some : some + LOOKED_AT], least[some : some + LOOKED_AT]
                    if not looked_twice:
                        good = np.einsum("ij,ij->i", whole[x], whole_there[y]) >= enough
                        x, y, enough = x[good], y[good], enough[good]
                    good = np.minimum(held[x], held_there[y]).sum(axis=1, dtype=np.uint16 if sizes[-1] < 1 << 16 else np.int64) >= enough
                    if good.any():
                        yield x[good] + at, y[good] + there


class Block:
    """Some texts, by length: their sizes and the hashes of their tokens; vectors are made when asked for."""

    def __init__(self, hashes: np.ndarray, sizes: np.ndarray):
        self.hashes, self.sizes = hashes, sizes
        self.width = max(WIDTH, min(1 << HASH_BITS, 1 << math.ceil(math.log2(WORDS_OF_WIDTH * int(sizes[-1])))))
        self.made: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        self.closely = False

    def seen(self, width: int, by: Filter) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Vectors for the first and the whole look and the counts."""
        if width not in self.made:
            held = counts(self.hashes, self.sizes, width)
            self.made = {width: (*by.vectors(held, self.sizes), held)}  # blocks come by length, so another width isn't asked for again
        return self.made[width]


def token_hashes(texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, text by text, and the texts' sizes."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    ids: dict[str, int] = {}
    words = np.fromiter((ids.setdefault(w, len(ids)) for t in texts for w in t), dtype=np.int64, count=int(sizes.sum()))
    own = np.fromiter((zlib.crc32(w.encode()) for w in ids), dtype=np.uint64, count=len(ids))
    mixed = (own[words] * np.uint64(0x9E3779B97F4A7C15)) + occurrence(words, np.repeat(np.arange(len(sizes)), sizes)).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return (mixed >> np.uint64(64 - HASH_BITS)).astype(np.uint16), sizes


def counts(hashes: np.ndarray, sizes: np.ndarray, width: int) -> np.ndarray:
    """How many tokens of each text fall in each of ``width`` places (a power of two)."""
    place = hashes.astype(np.int64) >> (HASH_BITS - width.bit_length() + 1)
    held = np.bincount(np.repeat(np.arange(len(sizes)) * width, sizes) + place, minlength=len(sizes) * width)
    return held.astype(np.min_scalar_type(int(held.max(initial=0)))).reshape(len(sizes), width)


def cut(sizes: np.ndarray, most: int, words: int) -> list[int]:
    """Edges of blocks of texts by length: ``most`` texts at most, and ``words`` if all were as long as the longest (one text at least)."""
    edges = [0]
    for i, n in enumerate(sizes):
        if i > edges[-1] and (i - edges[-1] >= most or (i - edges[-1] + 1) * n > words):
            edges.append(i)
    return [*edges, len(sizes)] if len(sizes) else edges


def common_words(a: list, b: list) -> int:
    """Length of the longest common subsequence, bit-parallel over ``a``."""
    masks: dict = {}
    for i, w in enumerate(a):
        masks[w] = masks.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for w in b:
        m = masks.get(w, 0)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def _files(path: str) -> Iterator[pq.ParquetFile]:
    """The Parquet files in a folder, one at a time."""
    if "://" in path or path.startswith("file:"):
        uri = path.replace("s3a://", "s3://")
        system, root = pafs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri[5:])
    else:
        system, root = pafs.LocalFileSystem(), path
    for info in sorted(system.get_file_info(pafs.FileSelector(root)), key=lambda i: i.path):
        if info.path.endswith(".parquet"):
            with system.open_input_file(info.path) as f:
                yield pq.ParquetFile(f)


def _shard(conv: str, shards: int) -> Column:
    return F.pmod(F.xxhash64(conv), F.lit(shards))


def index_shards(classes: DataFrame, shards: int, folder: str) -> None:
    """Write the index of each shard of ``classes`` (conv, words) to ``folder``."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("conv", kind="stable")
        return pd.DataFrame([(pdf["shard"].iloc[0], ShardIndex.build(pdf["conv"].tolist(), pdf["words"].tolist()).dump())], columns=["shard", "payload"])

    classes.select("conv", "words", _shard("conv", shards).alias("shard")).groupBy("shard").applyInPandas(build, "shard long, payload binary").write.partitionBy("shard").parquet(folder)


def write_blocks(classes: DataFrame, parts: int, folder: str) -> None:
    """Write ``classes`` (conv, words, n_words) to ``folder`` as blocks of texts of like length."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [pdf for pdf in batches if len(pdf)]
        if not held:
            return
        pdf = pd.concat(held, ignore_index=True)
        edges = cut(pdf["n_words"].to_numpy(), BLOCK, BLOCK_WORDS)
        for begin, end in itertools.pairwise(edges):
            part = pdf.iloc[begin:end]
            hashes, sizes = token_hashes([t.split(" ") for t in part["words"]])
            row = (int(sizes[0]), int(sizes[-1]), "\n".join(part["conv"]), "\n".join(part["words"]), hashes.tobytes(), sizes.tobytes())
            yield pd.DataFrame([row], columns=["least", "most", "names", "texts", "hashes", "sizes"])

    schema = "least long, most long, names string, texts string, hashes binary, sizes binary"
    classes.select("conv", "words", "n_words").repartitionByRange(parts, "n_words", "conv").sortWithinPartitions("n_words", "conv").mapInPandas(pack, schema).write.parquet(folder)


def common_classes(classes: DataFrame, parts: int, tasks: int, folder: str, share: float = SHARE) -> DataFrame:
    """train_conv, eval_conv, common, longer of all pairs of classes that hold the same conversation."""
    spark = classes.sparkSession
    write_blocks(classes.where("n_eval > 0"), parts, folder)
    n = classes.count()
    some = small(classes.where(F.pmod(F.xxhash64("conv"), F.lit(math.ceil(n / FITTED))) == 0).select("words"), 10 * FITTED)
    basis = spark.sparkContext.broadcast(Filter.fit([r["words"] for r in some]).basis)

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [pdf for pdf in batches if len(pdf)]
        if not held:
            return
        pdf = pd.concat(held, ignore_index=True).sort_values(["n_words", "conv"], kind="stable")
        names, texts, lengths = pdf["conv"].tolist(), pdf["words"].tolist(), pdf["n_words"].to_numpy()
        del held, pdf
        edges = cut(lengths, BLOCK, BLOCK_WORDS)
        mine = [Block(*token_hashes([t.split(" ") for t in texts[i:j]])) for i, j in itertools.pairwise(edges)]
        by = Filter(basis.value)
        near = lambda least, most: most >= share * lengths[0] - MARGIN and share * least - MARGIN <= lengths[-1]
        for file in _files(folder):
            if not any(near(r["least"], r["most"]) for r in file.read(columns=["least", "most"]).to_pylist()):
                continue
            for row in (r for batch in file.iter_batches(batch_size=1) for r in batch.to_pylist()):
                if not near(row["least"], row["most"]):
                    continue
                other = Block(np.frombuffer(row["hashes"], dtype=np.uint16), np.frombuffer(row["sizes"], dtype=np.int64))
                names_there, texts_there = row["names"].split("\n"), row["texts"].split("\n")
                found: list[tuple[str, str, int, int]] = []
                for block, first in zip(mine, edges):
                    if block.sizes[-1] < share * row["least"] - MARGIN or row["most"] < share * block.sizes[0] - MARGIN:
                        continue
                    for s, t in ((first + int(s), int(t)) for x in by.pairs(block, other, share) for s, t in zip(*x)):
                        a, b = texts[s].split(" "), texts_there[t].split(" ")
                        longer = max(len(a), len(b))
                        common = longer if a == b else common_words(a, b)
                        if common >= share * longer:
                            found.append((names[s], names_there[t], common, longer))
                if found:
                    yield pd.DataFrame(found, columns=["train_conv", "eval_conv", "common", "longer"])

    return classes.where("n_train > 0").select("conv", "words", "n_words").repartitionByRange(tasks, "n_words", "conv").mapInPandas(search, "train_conv string, eval_conv string, common int, longer int")


def led_to(pairs: DataFrame, classes: DataFrame, shards: int, folder: str) -> DataFrame:
    """train_conv, eval_conv, matched: what backward search leads to from the training texts of ``pairs``, in the shards of these."""
    spark = classes.sparkSession
    index_shards(classes.where("n_eval > 0"), shards, folder)

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard, index = -1, None
        for pdf in batches:
            for wanted, part in pdf.groupby("shard"):
                if wanted != shard:
                    shard, index = wanted, None  # the former index goes before the next is read
                    index = ShardIndex.load(next(file.read(columns=["payload"])["payload"][0].as_py() for file in _files(f"{folder}/shard={wanted}")))
                get = index.ids.get
                names, said = part["train_conv"].tolist(), [t.split(" ") for t in part["words"]]
                i = 0
                while i < len(said):
                    j, n = i, 0
                    while j < len(said) and (j == i or n + len(said[j]) <= BATCH_WORDS):
                        n += len(said[j])
                        j += 1
                    words = np.fromiter((get(w, -1) for t in said[i:j] for w in t), dtype=np.int32, count=n)
                    found = [(names[i + s], index.names[t], inside) for s, t, inside in index.matched(words, np.array([len(t) for t in said[i:j]]))]
                    i = j
                    if found:
                        yield pd.DataFrame(found, columns=["train_conv", "eval_conv", "matched"])

    asked = pairs.select("train_conv", _shard("eval_conv", shards).alias("shard")).distinct().join(classes.select(F.col("conv").alias("train_conv"), "words"), "train_conv")
    slices = math.ceil(spark.sparkContext.defaultParallelism / shards)
    spread = asked.repartition(shards * slices, "shard", _shard("train_conv", slices)).sortWithinPartitions("shard", "train_conv")
    return spread.mapInPandas(search, "train_conv string, eval_conv string, matched int")


def overlapping_classes(classes: DataFrame, share: float = SHARE, matches: bool = False) -> DataFrame:
    """train_conv, eval_conv, common, longer of all pairs of classes that hold the same conversation.

    ``matches``: also matched, the words in maximal matches where backward search leads to the pair, null where it doesn't.

    ``classes``: conv, words, n_words, n_train, n_eval; a stored table, as it is read several times.
    """
    spark = classes.sparkSession
    totals = classes.agg(F.sum(F.when(F.col("n_eval") > 0, F.col("n_words") + 1)), F.sum(F.when(F.col("n_train") > 0, F.col("n_words")))).first()
    if not totals[0] or not totals[1]:
        return spark.createDataFrame([], "train_conv string, eval_conv string, common int, longer int" + ", matched int" * matches)
    folder = f"{shared_folder(spark).rstrip('/')}/turnloom/evaluation-{uuid.uuid4().hex}"
    shards = math.ceil(totals[0] / SHARD_WORDS)
    tasks = max(2 * spark.sparkContext.defaultParallelism, math.ceil(totals[1] / TASK_WORDS))
    pairs = stored(common_classes(classes, shards, tasks, f"{folder}/blocks", share), "class-pairs")
    if not matches:
        return pairs
    return pairs.join(led_to(pairs, classes, shards, f"{folder}/index"), ["train_conv", "eval_conv"], "left")


def _members(records: DataFrame, train: str, evaluation: tuple[str, ...]) -> DataFrame:
    role = F.when(F.col("split") == train, "train").when(F.col("split").isin(*evaluation), "eval")
    words = conversation_words(F.col("turns"))
    return records.select("rec_id", "split", "source", role.alias("role"), words.alias("words")).where(F.col("role").isNotNull() & (F.col("words") != "")).withColumn("conv", F.md5("words"))


def _classes(members: DataFrame) -> DataFrame:
    """conv, words, n_train, n_eval, n_words of the distinct conversations."""
    classes = members.groupBy("conv").agg(F.first("words").alias("words"), F.sum((F.col("role") == "train").cast("long")).alias("n_train"), F.sum((F.col("role") == "eval").cast("long")).alias("n_eval"))
    return stored(classes.withColumn("n_words", F.size(F.split("words", " "))), "conversation-classes")


def overlap_classes(records: DataFrame, *, train: str = "train", evaluation: tuple[str, ...] = ("dev", "test"), share: float = SHARE) -> DataFrame:
    """eval_conv, train_conv, common, longer, matched, n_eval, n_train, n_links: every pair of classes of equal conversations with the record pairs it stands for."""
    classes = _classes(stored(_members(records, train, evaluation), "conversations"))
    pairs = overlapping_classes(classes, share, matches=True)
    sized = pairs.join(classes.select(F.col("conv").alias("train_conv"), "n_train"), "train_conv").join(classes.select(F.col("conv").alias("eval_conv"), "n_eval"), "eval_conv")
    return sized.select("eval_conv", "train_conv", "common", "longer", "matched", "n_eval", "n_train", (F.col("n_eval") * F.col("n_train")).alias("n_links"))


def overlapping_records(records: DataFrame, *, train: str = "train", evaluation: tuple[str, ...] = ("dev", "test"), share: float = SHARE) -> DataFrame:
    """train_rec, eval_rec, eval_split, eval_source, common, longer of every cross-split pair."""
    members = stored(_members(records, train, evaluation), "conversations")
    classes = _classes(members)
    pairs = overlapping_classes(classes, share)
    trained = members.where("role = 'train'").select(F.col("conv").alias("train_conv"), F.col("rec_id").alias("train_rec"))
    evaluated = members.where("role = 'eval'").select(F.col("conv").alias("eval_conv"), F.col("rec_id").alias("eval_rec"), F.col("split").alias("eval_split"), F.col("source").alias("eval_source"))
    return pairs.join(trained, "train_conv").join(evaluated, "eval_conv").select("train_rec", "eval_rec", "eval_split", "eval_source", "common", "longer")


def overlap_report(records: DataFrame, *, train: str = "train", evaluation: tuple[str, ...] = ("dev", "test"), share: float = SHARE) -> DataFrame:
    """Per evaluation split and source: records, those found in training, those found word for word, and pairs."""
    members = stored(_members(records, train, evaluation), "conversations")
    classes = _classes(members)
    pairs = overlapping_classes(classes, share).join(classes.select(F.col("conv").alias("train_conv"), "n_train"), "train_conv")
    hit = pairs.groupBy(F.col("eval_conv").alias("conv")).agg(F.sum("n_train").alias("n_partners"), F.max((F.col("train_conv") == F.col("eval_conv")).cast("long")).alias("exact"))
    each = members.where("role = 'eval'").join(hit, "conv", "left")
    return each.groupBy("split", "source").agg(
        F.count("*").alias("n_records"),
        F.count("n_partners").alias("n_overlapping"),
        F.coalesce(F.sum("exact"), F.lit(0)).alias("n_exact"),
        F.coalesce(F.sum("n_partners"), F.lit(0)).alias("n_pairs"),
    )
