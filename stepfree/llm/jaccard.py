"""N-gram Jaccard join by vertical partitioning.

A document's n-grams are put in one global order (that of their 64-bit hashes) and the
order is cut into fragments, which gives every document a segment in each fragment.

Candidates. Two sets that link differ in at most H n-grams, where H follows from their
sizes. Cut into k > H fragments, they agree in at least k - H segments. Documents are
therefore keyed by (size class, fragment, segment); a document also keys itself in the
class below if a partner may lie there. The first keys leave out n-grams that are frequent
in a sample of SAMPLE documents: whatever is left out, the rest still differs in at most
H, so the sample decides only how full the buckets get, never which links are found.
Empty segments make no key: a document with fewer than H + 1 filled segments keys itself
again with all its n-grams, under other orders (both sides of a pair that only empty
segments would join do so), and after SEEDS orders by its empty segments too. So no link
is lost, at any size.

Links. Candidate pairs are counted fragment by fragment: the overlap of the two segments is
stored as a number, the segments that were shuffled for it go before the next pass over
fragments (one pass takes several while they are small), and the FRAGMENTS overlaps are
summed per pair. Documents with equal sets are one
class from the start. Every class first meets one other only, the smallest of most of its
buckets; the links found join classes into components. Buckets in which several components
are left form groups (all buckets with one smallest class are one group), and each member of
a group is written once as its difference from that class, again fragment by fragment. From
there on only differences travel, and a large group is never compared pair by pair (``refined``):

* the n-grams that more than half the members differ in are flipped for all of them, which
  puts the differences to a set in the middle of the group and keeps |x ^ y| = |dx ^ dy|;
* with slack(x) = (den - num) |x| - (den + num) |dx|, x and y link exactly if
  slack(x) + slack(y) + 2 (den + num) |dx & dy| >= 0, so the member of most slack links
  directly with both sides of every pair that links without a common n-gram of dx and dy:
  all members are compared with that one;
* any other link has a side that isn't linked with it, and its two differences share n-grams (how
  many at least follows from the slacks): what one member has alone can't be among them, a member
  with too few others is done, and of the others the first few, rare ones first, hold a shared
  one. Members that share such an n-gram are the groups of the next round. An n-gram of a difference is held by half
  of a group at most, so groups shrink at least by half and the rounds end.

Groups of up to TOGETHER members whose differences are short (or of up to PAIRWISE) are counted
whole in one task, which hands on at most one link less than it has members. Nothing is left
out, and the rows made grow with the members, not with their square.

Defined cases: with fewer than n words the whole sequence is one n-gram; null, empty and
blank texts have no n-gram and link with nothing, themselves apart; rows that repeat are
one class; null ids are allowed (a component's name is its smallest id that is not null).
Hashes have 64 bits: sets are taken as equal, and n-grams too, when hashes agree.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from math import sqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stepfree.llm.common import attach, discard, discard_made, documents, fits, lower_words, made, planned_bytes, release, stored

SEEDS = 8
FRAGMENTS = 4
GROWTH = 1.6
#: Documents (about) whose n-grams are counted, and how many of them make an n-gram frequent.
SAMPLE, FREQUENT, MOST = 4000, 8, 100_000
#: Texts that are hashed at once.
BLOCK = 1000
#: One task compares the members of a group of up to TOGETHER with TOGETHER_GRAMS in their differences, or of up to PAIRWISE.
PAIRWISE, TOGETHER, TOGETHER_GRAMS = 16, 256, 1 << 20
#: N-grams that are counted at once there.
COLUMNS = 4096
#: Members of a hub that one task takes, about.
SPREAD = 2000
#: Parts in which keys are shuffled one after the other, at most, and keys that make another part worth while.
PASSES, PASS_KEYS = 4, 4_000_000
#: Keys of about so many classes do not gather in one task; they are told by one class in DRAWN.
CROWDED, DRAWN = 4000, 128
#: Bytes of segments (about) that one pass over fragments shuffles, while there are fragments to deal.
PASS_BYTES = 128 << 20
U = np.uint64


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class Rule:
    """Link when den * intersection >= num * union; n words to an n-gram."""

    def __init__(self, n: int, num: int, den: int) -> None:
        self.n, self.num, self.den = n, num, den

    @lru_cache(maxsize=None)  # noqa: B019  a handful of rules live
    def size_class(self, size: int) -> int:
        c = 0
        while self.bounds(c)[1] < size:
            c += 1
        return c

    @lru_cache(maxsize=None)  # noqa: B019
    def bounds(self, c: int) -> tuple[int, int]:
        """Smallest and largest size of a class."""
        low = 1 if c == 0 else self.bounds(c - 1)[1] + 1
        return low, max(low, int(low * GROWTH))

    @lru_cache(maxsize=None)  # noqa: B019
    def cut(self, c: int) -> tuple[int, int]:
        """(H, k) of a class: most n-grams in which a pair differs whose smaller set is in it, and fragments."""
        low, high = self.bounds(c)
        most = (self.den - self.num) * (high + high * self.den // self.num) // (self.den + self.num)
        for k in range(most + 1, 2 * most + 4):
            empty = k * (1 - 1 / k) ** low
            if k - empty - 2 * sqrt(empty) >= most + 1:
                return most, k
        return most, 2 * most + 3

    @lru_cache(maxsize=None)  # noqa: B019
    def classes(self, size: int) -> tuple[int, ...]:
        """Classes under which a set of this size is keyed: those its smaller partner, or it as the smaller one, may have."""
        return tuple(range(self.size_class(max(1, -(-size * self.num // self.den))), self.size_class(size) + 1))


def shingle_sets(texts: list[str | None], n: int) -> list[np.ndarray]:
    """Ascending distinct n-gram hashes of each text."""
    number: defaultdict = defaultdict()
    number.default_factory = number.__len__
    split = [lower_words(t) for t in texts]
    size = np.fromiter(map(len, split), np.int64, len(split))
    ids = np.fromiter((number[w] for ws in split for w in ws), np.int64, int(size.sum()))
    word = np.fromiter(map(xxhash.xxh3_64_intdigest, number), U, len(number))[ids]
    gram = np.zeros(max(0, len(word) - n + 1), U)
    for j in range(n if len(gram) else 0):
        gram = (gram ^ word[j : j + len(gram)]) * U(0x9E3779B97F4A7C15) + U(j + 1)
        gram ^= gram >> U(29)
    gram = mixed(gram)
    out, at = [], 0
    for m in size.tolist():
        if m >= n:
            out.append(np.unique(gram[at : at + m - n + 1]))
        elif m:
            out.append(np.array([xxhash.xxh3_64_intdigest(word[at : at + m].tobytes(), seed=m)], U))
        else:
            out.append(np.zeros(0, U))
        at += m
    return out


def set_hash(sets: list[np.ndarray]) -> np.ndarray:
    """One number for each set; the empty set has 0."""
    size = np.fromiter(map(len, sets), U, len(sets))
    total = np.array([mixed(s ^ U(0xA5A5)).sum(dtype=U) for s in sets], U)
    return np.where(size > 0, mixed(total + size), U(0))


def frequent_grams(docs: DataFrame, rule: Rule) -> np.ndarray:
    """Ascending hashes of n-grams that at least FREQUENT of about SAMPLE documents hold, the MOST commonest at most."""
    total = docs.count()
    picked = docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_000)) < F.lit(min(1_000_000, SAMPLE * 1_000_000 // max(1, total))))

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = shingle_sets(batch.column("text").to_pylist(), rule.n)
            if sets:
                value, count = np.unique(np.concatenate(sets), return_counts=True)
                yield pa.RecordBatch.from_arrays([_signed(value), pa.array(count)], ["gram", "n"])

    counts = picked.select("text").mapInArrow(grams, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).where(F.col("n") >= FREQUENT)
    rows = counts.orderBy(F.desc("n"), "gram").limit(MOST).collect()
    return np.sort(np.array([r["gram"] for r in rows], np.int64).view(U))


def without(sets: list[np.ndarray], frequent: np.ndarray) -> list[np.ndarray]:
    """The sets less the frequent n-grams."""
    if not len(frequent) or not sets:
        return sets
    h = np.concatenate(sets)
    stay = frequent[np.minimum(np.searchsorted(frequent, h), len(frequent) - 1)] != h
    ends = np.cumsum(np.fromiter(map(len, sets), np.int64, len(sets)))
    return [s[f] for s, f in zip(sets, np.split(stay, ends[:-1]), strict=True)]


def segment_keys(sets: list[np.ndarray], rule: Rule, frequent: np.ndarray) -> list[list[tuple[int, int, np.ndarray]]]:
    """The keys of each set, as described at the top of this module: (number of class and order, keys a partner shares at least, keys)."""
    keys: list[list[tuple[int, int, np.ndarray]]] = [[] for _ in sets]
    rare = without(sets, frequent)
    todo = [(i, c) for i, s in enumerate(sets) if len(s) for c in rule.classes(len(s)) if rule.cut(c)[0]]
    for seed in range(SEEDS):
        if not todo:
            break
        last = seed == SEEDS - 1
        ordered = [rare[i] if not seed else np.sort(mixed(sets[i] + U(seed))) for i, _ in todo]
        size = np.fromiter(map(len, ordered), np.int64, len(ordered))
        most = np.array([rule.cut(c)[0] for _, c in todo])
        k = np.array([rule.cut(c)[1] for _, c in todo])
        cls = np.array([c for _, c in todo])
        h = np.concatenate(ordered)
        own = np.repeat(np.arange(len(todo)), size)
        frag = ((h >> U(32)) * k[own].astype(U) >> U(32)).astype(np.int64)
        start = np.flatnonzero(np.r_[len(h) > 0, (frag[1:] != frag[:-1]) | (own[1:] != own[:-1])])
        who, where = own[start], frag[start]
        tag = mixed((cls[who].astype(U) << U(40)) | (U(seed) << U(36)) | where.astype(U))
        value = mixed((np.add.reduceat(mixed(h ^ U(0x5DEECE66D)), start) if len(h) else h) ^ tag)
        filled = np.bincount(who, minlength=len(todo))
        again = []
        for t, part in enumerate(np.split(value, np.cumsum(filled)[:-1])):
            i, c = todo[t]
            if filled[t] <= most[t]:
                again.append((i, c))
                if last:
                    empty = np.setdiff1d(np.arange(k[t]), where[who == t]).astype(U)
                    part = np.concatenate([part, mixed(mixed((U(c) << U(40)) | (U(15) << U(36)) | empty))])
            keys[i].append((c * SEEDS + seed, max(1, int(filled[t] - most[t])), part))
        todo = again
    return keys


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def keyed(docs: DataFrame, rule: Rule, frequent: np.ndarray) -> DataFrame:
    """doc_id, txt (hash of the text), n_shingles, cls (hash of the set, null if empty) and keys (none for a set this task has keyed before)."""
    held = docs.sparkSession.sparkContext.broadcast(frequent)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(at, BLOCK)
                sets = shingle_sets(batch.column("text").to_pylist(), rule.n)
                cls = set_hash(sets)
                new = []
                for s, x in zip(sets, cls.tolist(), strict=True):
                    new.append(s if x not in seen else s[:0])
                    seen.add(x)
                size = np.fromiter(map(len, sets), np.int64, len(sets))
                keys = segment_keys(new, rule, held.value)
                flat = [x for each in keys for x in each]
                offsets = np.r_[0, np.cumsum([len(x) for _, _, x in flat])].astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), _signed(np.concatenate([np.zeros(0, U), *[x for _, _, x in flat]])))
                parts = pa.StructArray.from_arrays([pa.array([x for x, _, _ in flat], pa.int32()), pa.array([x for _, x, _ in flat], pa.int32()), lists], ["ring", "need", "keys"])
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([len(x) for x in keys])].astype(np.int32)), parts)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), batch.column("txt"), pa.array(size), pa.array(cls.view(np.int64), mask=size == 0), lists], ["doc_id", "txt", "n_shingles", "cls", "keys"]
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", F.xxhash64("text").alias("txt")).mapInArrow(rows, f"doc_id {kind}, txt long, n_shingles long, cls long, keys array<struct<ring:int,need:int,keys:array<long>>>")


def segments_of(docs: DataFrame, wanted: DataFrame, rule: Rule) -> DataFrame:
    """cls, size, frag, seg of the sets in ``wanted`` (cls, rid): the text of one row for each."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK):
                sets = shingle_sets(whole.slice(at, BLOCK).column("text").to_pylist(), rule.n)
                cuts = [np.searchsorted(s >> U(62), np.arange(FRAGMENTS + 1, dtype=U)) for s in sets]  # the four quarters of the order
                size = np.fromiter(map(len, sets), np.int64, len(sets))
                ends = np.concatenate([c[1:] - c[:-1] for c in cuts]) if cuts else np.zeros(0, np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(ends)].astype(np.int32)), _signed(np.concatenate(sets)))
                cls = np.repeat(set_hash(sets), FRAGMENTS)
                yield pa.RecordBatch.from_arrays(
                    [_signed(cls), pa.array(np.repeat(size, FRAGMENTS)), pa.array(np.tile(np.arange(FRAGMENTS, dtype=np.int32), len(sets))), lists], ["cls", "size", "frag", "seg"]
                )

    ids = wanted.select("rid").distinct()
    salt = F.monotonically_increasing_id()
    texts = attach(docs.select(F.xxhash64("doc_id", F.xxhash64("text")).alias("rid"), "text"), ids, ["rid"], wanted.count(), salt, "left_semi")
    # rows that repeat bring their set along more than once
    return texts.select("text").mapInArrow(rows, "cls long, size long, frag int, seg array<long>").dropDuplicates(["cls", "frag"])


def keys_of(full: DataFrame) -> DataFrame:
    """cls, ring, need, key: the keys of ``keyed`` rows, a row for each."""
    return full.select("cls", F.inline("keys")).select("cls", "ring", "need", F.explode("keys").alias("key"))


def crowded_keys(full: DataFrame, rows: DataFrame) -> DataFrame:
    """key, lowest (smallest class) of keys that half of CROWDED classes or more have, about: which ones decides only the way they go."""
    some = F.pmod("cls", F.lit(DRAWN)) == 0
    counts = keys_of(once_keyed(full.where(some), rows.where(some))).groupBy("key").agg(F.count("*").alias("n"))
    drawn = stored(counts.where(F.col("n") >= max(2, CROWDED // DRAWN // 2)).select("key"), "drawn")
    held = attach(keys_of(full), drawn, ["key"], drawn.count(), F.col("cls"), "left_semi")
    return stored(held.groupBy("key").agg(F.min("cls").alias("lowest")), "crowded")


def met_keys(keys: DataFrame, crowded: DataFrame, n_crowded: int) -> DataFrame:
    """The keys (cls, ring, need, key) that several classes have, once a class, with ``low``, the smallest of these classes.

    Each key is shuffled once, to its own: in the order of classes one that several tasks keyed follows itself, and the
    first is the smallest. Crowded keys don't gather; their smallest class comes to them.
    """
    marked = attach(keys, crowded, ["key"], n_crowded, F.col("cls"), "left") if n_crowded else keys
    order = W.partitionBy("key").orderBy("cls")
    whole = order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    few = marked.where("lowest is null").drop("lowest") if n_crowded else keys
    few = few.withColumn("before", F.lag("cls").over(order)).withColumn("low", F.first("cls").over(whole)).withColumn("high", F.last("cls").over(whole))
    met = few.where("low < high and (before is null or before < cls)").drop("before", "high")
    if n_crowded:
        met = met.unionByName(marked.where("lowest is not null").dropDuplicates(["key", "cls"]).withColumnRenamed("lowest", "low"))
    return met


def fragment_passes(pairs: DataFrame, segments: DataFrame) -> list[list[int]]:
    """The fragments, dealt to as many passes as keep what one of them shuffles near PASS_BYTES."""
    copies = max(1, pairs.count() * FRAGMENTS / max(1, segments.count()))
    passes = min(FRAGMENTS, 1 + int(2 * copies * planned_bytes(segments) / PASS_BYTES))
    return [list(range(FRAGMENTS))[p::passes] for p in range(passes)]


def beside_hub(pairs: DataFrame, segments: DataFrame, frags: list[int]) -> DataFrame:
    """The pairs (hub, cls, ...) with size and seg of the class and hub_size and hub_seg of the hub in some fragments; the members of a large hub spread over tasks."""
    own = segments.where(F.col("frag").isin(frags))
    # segments stay where they are while the pairs can come to them
    parts = (F.broadcast(pairs) if fits(pairs, pairs.count()) else pairs).join(own.select("cls", "frag", "size", "seg"), "cls")
    hubs = own.select(F.col("cls").alias("hub"), "frag", F.col("size").alias("hub_size"), F.col("seg").alias("hub_seg"))
    return parts.join(pairs.select("hub", "salt").distinct().join(hubs, "hub"), ["hub", "salt", "frag"])


def salted(pairs: DataFrame) -> DataFrame:
    """The pairs with a ``salt`` that deals a hub's members into lots of about SPREAD."""
    counts = stored(pairs.groupBy("hub").agg(F.count("*").alias("n")).where(F.col("n") > SPREAD), "counts")
    lots = attach(pairs, counts, ["hub"], counts.count(), F.col("cls"), "left")
    return stored(lots.withColumn("salt", F.coalesce(F.pmod(F.xxhash64("cls"), F.ceil(F.col("n") / SPREAD)), F.lit(0))).drop("n"), "pairs")


def star_links(pairs: DataFrame, segments: DataFrame, rule: Rule) -> DataFrame:
    """The pairs (hub, cls) that link, as (a, b): overlaps are counted and stored fragment by fragment, then summed."""
    counted = None
    for frags in fragment_passes(pairs, segments):
        parts = beside_hub(pairs, segments, frags)
        near = (F.col("size") * rule.den >= F.col("hub_size") * rule.num) & (F.col("hub_size") * rule.den >= F.col("size") * rule.num)
        overlap = stored(parts.where(near).select("hub", "cls", (F.col("size") + F.col("hub_size")).alias("total"), F.size(F.array_intersect("seg", "hub_seg")).alias("common")), f"overlap{frags[0]}")
        release(pairs.sparkSession)
        counted = overlap if counted is None else counted.unionByName(overlap)
    both = counted.groupBy("hub", "cls").agg(F.sum("common").alias("common"), F.first("total").alias("total"))
    return both.where(rule.den * F.col("common") >= rule.num * (F.col("total") - F.col("common"))).select(F.col("hub").alias("a"), F.col("cls").alias("b"))


def apart(x: Column | str, y: Column | str) -> Column:
    """The symmetric difference of two arrays."""
    return F.concat(F.array_except(x, y), F.array_except(y, x))


def differences(members: DataFrame, segments: DataFrame) -> DataFrame:
    """g, cls, comp, size, alone (0), diff: where the members (hub, cls, comp, salt) differ from their hub, counted by fragment and put together."""
    out = None
    for frags in fragment_passes(members, segments):
        part = stored(beside_hub(members, segments, frags).select("hub", "cls", "comp", "size", apart("seg", "hub_seg").alias("diff")), f"differences{frags[0]}")
        release(members.sparkSession)
        out = part if out is None else out.unionByName(part)
    whole = out.groupBy("hub", "cls").agg(F.first("comp").alias("comp"), F.first("size").alias("size"), F.flatten(F.collect_list("diff")).alias("diff"))
    return whole.select(F.col("hub").alias("g"), "cls", "comp", "size", F.lit(0).cast("long").alias("alone"), "diff")


def group_links(group: pa.Table, step: int) -> pa.Table:
    """Links (a, b) of one group (cls, comp, d, s) that hold together whatever its links join.

    The overlaps of all its differences are the product of a 0/1 matrix with itself, summed over
    blocks of the n-grams that several members hold.
    """
    cls, comp, s = (group[c].to_numpy() for c in ("cls", "comp", "s"))
    lists = group["d"].combine_chunks()
    m, own = len(cls), np.repeat(np.arange(len(cls)), lists.value_lengths().to_numpy())
    _, code, count = np.unique(lists.flatten().to_numpy(), return_inverse=True, return_counts=True)
    several = count > 1
    own, code = own[several[code]], (np.cumsum(several) - 1)[code[several[code]]]
    order = np.argsort(code, kind="stable")
    own, code = own[order], code[order]
    common = np.zeros((m, m))
    for low in range(0, int(several.sum()), COLUMNS):
        lo, hi = np.searchsorted(code, [low, low + COLUMNS])
        held = np.zeros((m, COLUMNS), np.float32)
        held[own[lo:hi], code[lo:hi] - low] = 1
        common += held @ held.T
    near = (s[:, None] + s[None, :] + 2 * step * common >= 0) & (comp[:, None] < comp[None, :])
    x, y = np.nonzero(near)
    names, node = np.unique(comp, return_inverse=True)
    root = list(range(len(names)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    kept = []
    _, once = np.unique(node[x] * len(names) + node[y], return_index=True)
    for i in once.tolist():
        a, b = find(int(node[x[i]])), find(int(node[y[i]]))
        if a != b:
            root[b] = a
            kept.append(i)
    return pa.table({"a": cls[x[kept]], "b": cls[y[kept]]}, schema=pa.schema([("a", pa.int64()), ("b", pa.int64())]))


def refined(members: DataFrame, rule: Rule) -> tuple[DataFrame, DataFrame]:
    """Links (a, b) of the groups ``members`` (g, cls, comp, size, alone, diff), and the groups of the next round; see the top of this module.

    ``alone``: n-grams of the difference that no other member shares; they count, but are carried no further.
    """
    lift, step = rule.den - rule.num, rule.den + rule.num
    salt = F.xxhash64("cls")
    groups = members.groupBy("g").agg(F.count("*").alias("n"), F.sum(F.size("diff")).alias("grams"), F.min("comp").alias("c0"), F.max("comp").alias("c1"))
    groups = stored(groups.where("c0 < c1").select("g", "n", "grams"), "groups")
    open_ = attach(members, groups, ["g"], groups.count(), salt)
    slack = lift * F.col("size") - step * (F.size("d") + F.col("alone"))

    small = (F.col("n") <= PAIRWISE) | ((F.col("n") <= TOGETHER) & (F.col("grams") <= TOGETHER_GRAMS))
    few = open_.where(small).select("g", "cls", "comp", F.col("diff").alias("d"), (lift * F.col("size") - step * (F.size("diff") + F.col("alone"))).alias("s"))
    found = stored(few.groupBy("g").applyInArrow(lambda group: group_links(group, step), "a long, b long").distinct(), "near")

    # the middle of each group: n-grams that over half of it differs in change sides; those of over a
    # sixteenth count as frequent; those of one member only are counted for it and go
    many = stored(open_.where(~small).drop("grams"), "many")
    if many.isEmpty():
        return found, members.where("false")
    held = many.select("g", "n", "cls", F.explode("diff").alias("e")).groupBy("g", "n", "e").agg(F.count("*").alias("m"), F.min("cls").alias("one"))
    flip, fewer = F.col("m") * 2 > F.col("n"), F.least("m", F.col("n") - F.col("m"))
    often = F.when((fewer >= 3) & (fewer * 16 >= F.col("n")), F.col("e"))
    held = held.groupBy("g", F.when(F.col("m") == 1, F.col("one")).alias("one"))
    held = stored(held.agg(F.collect_list(F.when(flip, F.col("e"))).alias("flips"), F.collect_list(often).alias("often"), F.collect_list(F.when(F.col("m") == 1, F.col("e"))).alias("own")), "held")
    none = F.array().cast("array<long>")
    middle = held.where("one is null").select("g", "flips", "often")
    moved = many.join(held.where("one is not null").select("g", F.col("one").alias("cls"), "own"), ["g", "cls"], "left")
    moved = attach(moved, middle, ["g"], groups.count(), salt, "left").select(
        "g", "cls", "comp", "size", (F.col("alone") + F.greatest(F.size("own"), F.lit(0))).alias("alone"),
        F.array_except(apart("diff", F.coalesce("flips", none)), F.coalesce("own", none)).alias("d"), F.coalesce("often", none).alias("often"),
    )
    ordered = F.concat(F.sort_array(F.array_except("d", "often")), F.sort_array(F.array_intersect("d", "often")))
    moved = stored(moved.select("g", "cls", "comp", "size", "alone", ordered.alias("d")).withColumn("s", slack), "moved")

    # the member of most slack meets all others
    first = moved.groupBy("g").agg(F.max(F.struct("s", "cls")).alias("c")).select("g", F.col("c.cls").alias("cls"))
    first = stored(moved.join(first, ["g", "cls"]).select("g", *[F.col(c).alias(f"{c}0") for c in ("cls", "comp", "d", "s")]), "first")
    linked = F.col("s") + F.col("s0") + 2 * step * F.size(F.array_intersect("d", "d0")) >= 0
    met = attach(moved, first, ["g"], first.count(), salt).withColumn("linked", linked)
    most = F.floor(lift * (F.col("size") + F.col("size") * rule.den / rule.num) / step + 1e-6)  # n-grams in which a partner may differ
    shared = lambda s: F.greatest(F.lit(1), F.ceil(-(F.col("s") + F.col(s)) / (2 * step)), F.size("d") + F.col("alone") - most)
    met = met.select(
        "g", "cls", F.col("comp").alias("comp_before"), F.when(F.col("linked"), F.col("comp0")).otherwise(F.col("comp")).alias("comp"), "size", "alone", "d", "s", "linked", "cls0",
        (~F.col("linked") & (F.size("d") >= shared("s0"))).alias("hopeful"),
    )
    met = stored(met, "met")
    found = found.unionByName(met.where("linked and comp_before != comp").select(F.col("cls0").alias("a"), F.col("cls").alias("b")))

    # what may still link: one side is not linked with that member, and so many n-grams are shared
    left = met.where("linked or hopeful").groupBy("g").agg(
        F.max(F.when(F.col("linked"), F.col("s"))).alias("s_in"), F.max(F.when(F.col("hopeful"), F.col("s"))).alias("s_out"), F.min("comp").alias("c0"), F.max("comp").alias("c1")
    )
    left = stored(left.where("s_out is not null and c0 < c1").select("g", "s_in", "s_out"), "left")
    rest = attach(met.where("linked or hopeful").select("g", "cls", "comp", "size", "alone", "d", "s", "linked"), left, ["g"], left.count(), salt)
    upto = lambda s: F.greatest(F.lit(0), F.size("d") + 1 - shared(s)).cast("int")
    rest = rest.withColumn("inner", upto("s_out")).withColumn("reach", F.when(F.col("linked"), F.col("inner")).otherwise(F.greatest("inner", upto("s_in"))))
    rows = rest.where("reach > 0").select("g", "cls", "comp", "linked", "inner", F.posexplode(F.slice("d", F.lit(1), F.col("reach"))).alias("at", "e"))
    # kind 0: linked; 1: meets linked ones only; 2: meets all
    rows = rows.select("g", "e", "cls", "comp", F.when(F.col("linked"), 0).when(F.col("at") < F.col("inner"), 2).otherwise(1).alias("kind"))
    both = F.col("kind") == 2
    shares = rows.groupBy("g", "e").agg(
        F.count("*").alias("n"), F.count_if(F.col("kind") == 0).alias("inside"), F.count_if(both).alias("outside"), F.min("comp").alias("c0"), F.max("comp").alias("c1"),
        F.min(F.when(both, F.col("comp"))).alias("b0"), F.max(F.when(both, F.col("comp"))).alias("b1"), F.bit_xor(F.xxhash64("cls", "kind")).alias("who"),
    )
    mixed_ = (F.col("inside") > 0) & (F.col("inside") < F.col("n")) & (F.col("c0") < F.col("c1"))
    shares = shares.where(mixed_ | (F.col("b0") < F.col("b1"))).withColumn("mixed", mixed_)
    # n-grams that the same members share make one group
    alive = shares.groupBy("g", "n", "who", "mixed").agg(F.min("e").alias("e")).select("g", "e", "mixed")
    alive = stored(alive, "alive")
    new = attach(rows, alive, ["g", "e"], alive.count(), salt).where("mixed or kind = 2").select("g", F.xxhash64("g", "e").alias("next"), "cls")
    following = new.join(met.select("g", "cls", "comp", "size", "alone", F.col("d").alias("diff")), ["g", "cls"]).select(F.col("next").alias("g"), "cls", "comp", "size", "alone", "diff")
    return found, following


def components(edges: DataFrame) -> DataFrame:
    """node, comp (smallest node of its component) for the nodes of ``edges`` (a, b).

    Each round takes the smallest label around a node, then follows that label's own label,
    so paths shorten by half; labels go through the shared folder between rounds.
    """
    both = stored(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("comp")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "comp"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near"))
        low = labels.join(near, "node").select("node", F.least("comp", "near").alias("mid"), F.col("comp").alias("old"))
        step = low.join(labels.select(F.col("node").alias("mid"), F.col("comp").alias("jump")), "mid").select("node", F.least("mid", "jump").alias("comp"), "old")
        step = stored(step, "labels")
        if step.where(F.col("comp") != F.col("old")).isEmpty():
            discard(step, both)
            return labels
        discard(labels)
        labels = step.select("node", "comp")


def once_keyed(full: DataFrame, rows: DataFrame) -> DataFrame:
    """cls and keys of each class, from one of the tasks that keyed it; worked out once and stored, as every pass over the keys reads it."""
    tasks = rows.where("cls is not null").select("cls", "task").distinct()
    first = tasks.groupBy("cls").agg(F.min("task").alias("first"), F.count("*").alias("n")).where("n > 1").select("cls", "first")
    gone = stored(tasks.join(first, "cls").where("task > first").select("cls", "task"), "again")
    one = attach(full.where(F.size("keys") > 0).select("cls", "task", "keys"), gone, ["cls", "task"], gone.count(), F.col("cls"), "left_anti")
    return stored(one.select("cls", "keys"), "once")


def linked_classes(docs: DataFrame, rule: Rule) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The rows (doc_id, txt, n_shingles, cls), the classes (cls, smallest doc_id) and the linked ones' components (node, comp)."""
    spark = docs.sparkSession
    full = stored(keyed(docs, rule, frequent_grams(docs, rule)).withColumn("task", F.spark_partition_id()), "keyed")
    rows = stored(full.select("doc_id", "txt", "n_shingles", "cls", "task"), "rows")
    classes = rows.where("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("doc_id"), F.min(F.xxhash64("doc_id", "txt")).alias("rid"))
    classes = stored(classes, "classes")
    before = made(spark)
    crowded = crowded_keys(full, rows)
    n_crowded = crowded.count()
    discard_made(spark, before, crowded)
    n_keys = full.agg(F.coalesce(F.sum(F.aggregate("keys", F.lit(0).cast("long"), lambda n, k: n + F.size(k["keys"]))), F.lit(0))).first()[0]
    passes = min(PASSES, 1 + n_keys // PASS_KEYS)
    parts = [keys_of(full).where(F.pmod("key", F.lit(passes)) == p) for p in range(passes)]

    # keys that several classes have, a part after the other; of each class how often it meets a bucket's smallest one
    shared, often = [], None
    for own in parts:
        shared.append(stored(met_keys(own, crowded, n_crowded), "shared"))
        release(spark)
        met = stored(shared[-1].groupBy("cls", "ring", "low").agg(F.count("*").alias("n"), F.first("need").alias("need")), "often")
        often = met if often is None else often.unionByName(met)
    discard(full, crowded)
    release(spark)
    # partners share as many keys of a ring (class of sizes and order) as either side needs
    good = often.groupBy("cls", "ring").agg(F.sum("n").alias("n"), F.first("need").alias("need")).where("n >= need").select("cls", "ring")
    good = stored(good, "good")
    n_good = good.count()
    wanted = stored(good.select("cls").distinct().join(classes, "cls").select("cls", "rid"), "wanted")
    segments = stored(segments_of(docs, wanted, rule), "segments", by="frag")
    discard(wanted)
    release(spark)

    # one star for each class: the smallest class of most of its buckets
    able = attach(attach(often, good, ["cls", "ring"], n_good, F.col("low"), "left_semi"), good.withColumnRenamed("cls", "low"), ["low", "ring"], n_good, F.col("cls"), "left_semi")
    able = able.where("cls != low").groupBy("cls", "low").agg(F.sum("n").alias("n"))
    stars = stored(able.groupBy("cls").agg(F.max(F.struct("n", "low")).alias("m")).select(F.col("m.low").alias("hub"), "cls"), "stars")
    discard(often)
    before = made(spark)
    found = stored(star_links(salted(stars), segments, rule), "links")
    discard_made(spark, before, found)
    release(spark)
    comps = components(found)
    n_comps = comps.count()

    # buckets with several components, those of one smallest class together
    members = None
    for own in shared:
        live = attach(own, good, ["cls", "ring"], n_good, F.col("key"), "left_semi")
        live = attach(live, comps.withColumnRenamed("node", "cls"), ["cls"], n_comps, F.col("key"), "left").select("key", "cls", F.coalesce("comp", "cls").alias("comp"))
        live = stored(live, "live")
        release(spark)
        split = live.groupBy("key").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.min("cls").alias("hub")).where("c0 < c1").select("key", "hub")
        split = stored(split, "split")
        met = stored(attach(live, split, ["key"], split.count(), F.col("cls"), salts=4).select("hub", "cls", "comp").distinct(), "members")
        discard(live)
        release(spark)
        members = met if members is None else members.unionByName(met)
    members = stored(members.distinct(), "members")
    discard(*shared)
    # a hub and one class that have met as a star are done
    pairs = members.groupBy("hub").agg(F.count("*").alias("n"), F.max(F.when(F.col("cls") != F.col("hub"), F.col("cls"))).alias("cls")).where("n = 2")
    done = stored(pairs.join(stars, ["hub", "cls"]).select("hub"), "done")
    members = attach(members, done, ["hub"], done.count(), F.col("cls"), "left_anti")
    before = made(spark)
    groups = stored(differences(salted(members), segments), "groups")
    discard(segments)
    discard_made(spark, before, groups)
    release(spark)
    while not groups.isEmpty():
        before = made(spark)
        links, groups = refined(groups, rule)
        links, groups = stored(links, "links"), stored(groups, "groups")
        discard_made(spark, before, links, groups)
        release(spark)
        if links.isEmpty():
            continue
        comps = components(comps.select(F.col("node").alias("a"), F.col("comp").alias("b")).unionByName(links).distinct())
        groups = attach(groups.drop("comp"), comps.withColumnRenamed("node", "cls"), ["cls"], comps.count(), F.col("g"), "left").withColumn("comp", F.coalesce("comp", "cls"))
    return rows, classes, comps


def near_duplicates(docs: DataFrame, n: int = 5, num: int = 8, den: int = 10) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id (smallest doc_id reached by links)."""
    rows, classes, comps = linked_classes(docs, Rule(n, num, den))
    named = comps.join(classes, comps["node"] == classes["cls"]).select("node", "comp", "doc_id")
    names = named.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    of_class = classes.join(
        named.select("node", "comp").join(names, "comp").select("node", "component_id"), classes["cls"] == F.col("node"), "left"
    ).select("cls", F.coalesce("component_id", "doc_id").alias("component_id"))
    of_class = stored(of_class, "names")
    return rows.select("doc_id", "n_shingles", "cls").join(of_class, "cls", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, n: int = 5, num: int = 8, den: int = 10) -> DataFrame:
    """One row of each group of near duplicates; rows without an n-gram are in no group and stay.

    Rows are told apart by doc_id and text: the smallest doc_id of a group stays (nulls last), of
    several texts under it that with the smallest hash, and of rows equal in both the smallest row.
    """
    rows, _, comps = linked_classes(docs, Rule(n, num, den))
    comps = stored(comps, "comps")
    rows = attach(rows.where("cls is not null"), comps.withColumnRenamed("node", "cls"), ["cls"], comps.count(), F.xxhash64("doc_id", "txt"), "left")
    keys = stored(rows.groupBy(F.coalesce("comp", "cls").alias("comp"), "doc_id", "txt").agg(F.count("*").alias("n")), "keys")
    first = keys.groupBy("comp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "txt")).alias("first"), F.sum("n").alias("size"))
    first = stored(first.where("size > 1").select("comp", F.col("first.doc_id").alias("first_id"), F.col("first.txt").alias("first_txt")), "first")
    grouped = attach(keys, first, ["comp"], first.count(), F.xxhash64("doc_id", "txt"))
    stays = F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("txt") == F.col("first_txt"))
    named = ["doc_id", F.col("txt").alias("__txt")]
    gone = stored(grouped.where(~stays).select(*named).distinct(), "gone")
    equal = stored(grouped.where(stays & (F.col("n") > 1)).select(*named), "equal")
    marked = docs.withColumn("__txt", F.xxhash64("text"))
    salt = F.xxhash64("doc_id", "__txt")
    left = attach(marked, gone, ["doc_id", "__txt"], gone.count(), salt, "left_anti")
    many = equal.count()
    if not many:
        return left.select(docs.columns)
    alone = attach(left, equal, ["doc_id", "__txt"], many, salt, "left_anti").select(docs.columns)
    row = F.struct(*[F.col(c) for c in docs.columns]).alias("__row")
    one = attach(marked, equal, ["doc_id", "__txt"], many, salt, "left_semi").select("doc_id", "__txt", row)
    one = one.groupBy(F.col("doc_id").alias("__id"), "__txt").agg(F.min("__row").alias("__row"))
    return alone.unionByName(one.select(*[F.col("__row")[c].alias(c) for c in docs.columns]))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir), n=3, num=90, den=100)
