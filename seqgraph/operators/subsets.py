"""Strict subsets among very many different sets, as bitmaps: which pairs meet is dealt out, each task ANDs its own postings.

Members are whole numbers in the order of their frequency (rarest first), a set is their ascending array. A set looks for
larger ones among those that hold its rarest member. Ranges of rarest members with about as many sets each are buckets;
a set goes to every bucket in whose range it has a member, with its members from there on, and large buckets are cut
into parts on both sides, so tasks are bounded however many sets there are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import cut

#: Sets that look for larger ones in one task; members of these, and of the sets that they look among (about 40 bytes each).
SMALLS, LARGES = 1 << 15, 1 << 22
#: Buckets at most (further sets of a bucket are dealt to parts), members in a batch that is sent, pairs in one that comes back.
BUCKETS, SENT, BACK = 1000, 1 << 20, 1 << 18

_DEALT = "task long, class long, size long, small boolean, ranks array<long>"


def class_pairs(classes: DataFrame, smalls: int = SMALLS, larges: int = LARGES) -> DataFrame:
    """small, large: all classes (class, members without repeats) of which one is a strict subset of the other; empty sets take no part."""
    sets = ranked(classes)
    n = sets.count()
    if not n:
        return sets.select(F.col("class").alias("small"), F.col("class").alias("large"))  # none
    at = min(BUCKETS, -(-n // smalls))
    edges = np.unique(np.array(sets.agg(F.percentile_approx(F.col("ranks")[0], [k / at for k in range(1, at + 1)], 10 * BUCKETS)).first()[0], np.int64))
    weighed = sets.mapInArrow(_weighed(edges), "bucket int, smalls long, own long, members long").groupBy("bucket").agg(*[F.sum(c).alias(c) for c in ("smalls", "own", "members")])
    parts = np.zeros((len(edges) + 1, 2), np.int64)  # none where no set looks for others
    for r in weighed.collect():  # a row a bucket
        if r["smalls"]:
            parts[r["bucket"]] = max(-(-r["smalls"] // smalls), -(-r["own"] // larges)), -(-r["members"] // larges)
    return sets.mapInArrow(_dealt(edges, parts), _DEALT).groupBy("task").applyInArrow(_met, "small long, large long")


def ranked(classes: DataFrame) -> DataFrame:
    """class, ranks: each set's members as ascending numbers, rarest first. Written out once."""
    members = classes.select("class", F.explode("members").alias("m"))
    counts = members.groupBy("m").agg(F.count(F.lit(1)).alias("n"))
    # ascending over the whole sorted table, though not without gaps
    ranks = cut(counts.orderBy("n", "m").select(F.col("m").alias("_m"), F.monotonically_increasing_id().alias("rank")))
    return cut(members.join(ranks, members["m"].eqNullSafe(ranks["_m"])).groupBy("class").agg(F.sort_array(F.collect_list("rank")).alias("ranks")))


def _entries(batch: pa.RecordBatch, edges: np.ndarray) -> tuple:
    """Classes, sizes, members and where each set ends; and for each bucket in which a set has members: set, first place, bucket, whether its rarest is there."""
    column = batch.column("ranks")
    flat, sizes = column.flatten().to_numpy(), column.value_lengths().to_numpy().astype(np.int64)
    ends = np.cumsum(sizes)
    buckets = np.searchsorted(edges, flat)
    rarest = np.zeros(len(flat), bool)
    rarest[(ends - sizes)] = True
    first = np.flatnonzero(rarest | np.r_[True, buckets[1:] != buckets[:-1]])
    return batch.column("class").to_numpy(), sizes, flat, ends, np.searchsorted(ends, first, side="right"), first, buckets[first], rarest[first]


def _weighed(edges: np.ndarray):
    """The sets whose rarest member is in a bucket, their members, and the members of all sets that go to it."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                _, _, _, ends, of, first, bucket, rarest = _entries(batch, edges)
                found, at = np.unique(bucket, return_inverse=True)
                sums = lambda x: np.bincount(at, x, len(found)).astype(np.int64)  # noqa: B023, E731
                yield pa.RecordBatch.from_pydict({"bucket": found.astype(np.int32), "smalls": sums(rarest), "own": sums((ends[of] - first) * rarest), "members": sums(ends[of] - first)})

    return run


def _dealt(edges: np.ndarray, parts: np.ndarray):
    """A set as a small one to all parts of the larger ones in the bucket of its rarest member, as a large one to all parts of the smaller ones in each of its buckets."""
    start = np.cumsum(parts[:, 0] * parts[:, 1]) - parts[:, 0] * parts[:, 1]

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            classes, sizes, flat, ends, of, first, bucket, rarest = _entries(batch, edges)
            mixed = (classes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64)
            for small in (True, False):
                keep = rarest if small else parts[bucket, 0] > 0
                o, f, b = of[keep], first[keep], bucket[keep]
                times = parts[b, 1] if small else parts[b, 0]
                row = np.repeat(np.arange(len(o)), times)
                other = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
                o, f, b = o[row], f[row], b[row]
                mine = mixed[o] % parts[b, 0 if small else 1]
                task = start[b] + (mine * parts[b, 1] + other if small else other * parts[b, 1] + mine)
                upto = np.cumsum(ends[o] - f)
                at = 0
                while at < len(o):
                    to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + SENT, side="right")))
                    n = ends[o[at:to]] - f[at:to]
                    offsets = np.r_[0, np.cumsum(n)]
                    ranks = flat[np.repeat(f[at:to] - offsets[:-1], n) + np.arange(offsets[-1])]
                    yield pa.RecordBatch.from_pydict({
                        "task": task[at:to], "class": classes[o[at:to]], "size": sizes[o[at:to]], "small": pa.array(np.full(to - at, small)), "ranks": pa.ListArray.from_arrays(offsets.astype(np.int32), ranks),
                    })
                    at = to

    return run


def _side(batches: list[pa.RecordBatch]) -> tuple:
    """class, size, the members of all sets and their places, of one side of a task."""
    column = lambda name: np.concatenate([b.column(name).to_numpy() for b in batches])
    lengths = np.concatenate([b.column("ranks").value_lengths().to_numpy() for b in batches])
    return column("class"), column("size"), np.concatenate([b.column("ranks").flatten().to_numpy() for b in batches]), np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)


def _signed(posts: list[np.ndarray], n: int) -> np.ndarray:
    """A row of bits for each of n sets: bit k where it is in the k-th of `posts`."""
    out = np.zeros((n, -(-len(posts) // 64)), np.uint64)
    for k, rows in enumerate(posts):
        out[rows, k >> 6] |= np.uint64(1 << (k & 63))
    return out


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs of one task.

    Frequent members have a bitmap over the larger sets, rare ones the places of those that hold them. A set ANDs the
    bitmaps of its members, rarest first, until few places are left; these are looked at by their bits of all members.
    """
    smalls, larges = [], []
    for b in batches:
        smalls.append(b.filter(b.column("small")))
        larges.append(b.filter(pc.invert(b.column("small"))))
    (small, small_size, flat, owner), (large, large_size, among, holder) = _side(smalls), _side(larges)
    del smalls, larges, b
    if not len(small) or not len(large):
        return
    # the larger sets by size, so those larger than a given one stand before all others
    order = np.argsort(-large_size, kind="stable")
    large, place = large[order], np.empty(len(order), np.int32)
    place[order] = np.arange(len(order), dtype=np.int32)
    upto = np.searchsorted(-large_size[order], -small_size)
    holder = place[holder]
    by = np.lexsort((holder, among))
    holder = holder[by]
    among = among[by]
    del by
    # members, and in how many of the larger sets each is
    begins = np.flatnonzero(np.r_[True, among[1:] != among[:-1]])
    words, counts = among[begins], np.diff(np.r_[begins, len(among)])
    del among
    posts = [holder[b : b + c] for b, c in zip(begins, counts)]
    frequent = counts * 64 >= len(large)
    often, bit = np.flatnonzero(frequent), np.cumsum(frequent) - 1
    bits = np.zeros((len(often), -(-len(large) // 64)), np.uint64)
    for row, k in zip(bits, often):
        held = np.zeros(len(row) * 64, bool)
        held[posts[k]] = True
        row[:] = np.packbits(held, bitorder="little").view(np.uint64)
    signs = _signed([posts[k] for k in often], len(large))

    # the smaller sets' members, rarest first; a set with a member that no larger one has is left out
    word = np.minimum(np.searchsorted(words, flat), len(words) - 1)
    unknown = np.zeros(len(small), bool)
    unknown[owner[words[word] != flat]] = True
    by = np.argsort(word, kind="stable")
    wanted = _signed([owner[by[b:e]] for b, e in np.searchsorted(word[by], np.c_[often, often + 1])], len(small))
    word = word[np.lexsort((counts[word], owner))]
    ends = np.cumsum(np.bincount(owner, minlength=len(small)))
    share = counts / len(large)
    found, n = [], 0
    for i in np.flatnonzero(~unknown & (upto > 0)):
        own, most = word[ends[i - 1] if i else 0 : ends[i]], upto[i]
        k = own[0]
        if frequent[k]:
            w = -(-int(most) // 64)
            left, few = share[k] * most, max(16.0, most / 1024)
            at = bits[bit[k], :w]
            for j, k in enumerate(own[1:]):
                if left <= few:
                    break
                at = np.bitwise_and(at, bits[bit[k], :w], out=at if j else None)
                left *= share[k]
            full = np.flatnonzero(at)
            row, col = np.nonzero(np.unpackbits(at[full].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
            at = full[row] * 64 + col
            at = at[at < most]
        else:
            at = posts[k]
            at = at[: np.searchsorted(at, most)]
            for k in own[1:]:
                if frequent[k] or not len(at):
                    break
                to = posts[k]
                at = at[to[np.minimum(np.searchsorted(to, at), len(to) - 1)] == at]
        if len(at):
            at = at[((signs[at] & wanted[i]) == wanted[i]).all(axis=1)]
        if len(at):
            found.append((i, at))
            n += len(at)
            if n >= BACK:
                yield from _pairs(small, large, found)
                found, n = [], 0
    if found:
        yield from _pairs(small, large, found)


def _pairs(small: np.ndarray, large: np.ndarray, found: list) -> Iterator[pa.RecordBatch]:
    of = np.repeat([i for i, _ in found], [len(at) for _, at in found])
    yield pa.RecordBatch.from_pydict({"small": small[of], "large": large[np.concatenate([at for _, at in found])]})
