"""Documents whose n-gram sets have a high Jaccard likeness, joined over prefix trees."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fractions import Fraction
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tallyloom.llm.bytescan import U64, mix, row_of, signed, slices, window_hashes, word_hashes
from tallyloom.llm.columns import named, unused
from tallyloom.llm.components import components
from tallyloom.llm.groups import runs
from tallyloom.llm.prefix_tree import build, matches
from tallyloom.llm.scratch import written

#: Buckets of the sketch that tells common n-grams, so its broadcast has at most so many entries.
SKETCH_BITS = 22
#: Least bits of a set's parity map; two sets differ in at least as many items as their maps in bits.
PARITY_BITS = 512
#: Bits an item of the maps that are sent with whole sets.
FINE = 4
#: Members of a group that one task compares; larger groups are compared as pairs of such blocks.
BLOCK = 1024
#: The same for families, by the items of all sets together: some 40 bytes of memory each, in both blocks.
ITEMS = 4 << 20
#: Members that stand for a connected part of a large family when parts are compared with each other.
STAND_INS = 4


def _sets(part: pa.RecordBatch, n: int) -> Iterator[np.ndarray]:
    """The ascending distinct n-gram hashes of each row."""
    words, first = word_hashes(part.column("text"), lower=True)
    grams = window_hashes(words, n)
    for lo, hi in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if hi - lo >= n:
            yield np.unique(grams[lo : hi - n + 1])
        elif hi > lo:  # fewer words: the whole sequence is the one item
            yield mix(window_hashes(words[lo:hi], hi - lo) + U64(hi - lo))
        else:
            yield np.zeros(0, U64)


def _common(given: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sketch buckets that hold common n-grams, ascending, with their counts over all documents: 64 MB at most."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << SKETCH_BITS, np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                words, first = word_hashes(part.column("text"), lower=True)
                grams, row = window_hashes(words, n), row_of(first)
                grams = grams[np.arange(len(grams)) + n <= first[row[: len(grams)] + 1]]
                counts += np.bincount((grams >> U64(64 - SKETCH_BITS)).astype(np.int64), minlength=1 << SKETCH_BITS)
        at = np.flatnonzero(counts >= 16 + 4 * counts.mean())
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], ["bucket", "n"])

    found = given.select("text").mapInArrow(scan, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    got = found.toArrow()
    bucket, count = got.column("bucket").to_numpy(), got.column("n").to_numpy()
    order = np.argsort(bucket)
    return bucket[order], count[order]


def _profiles(given: DataFrame, n: int, t: Fraction, common: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """For each row: set size, a 128-bit set hash, the parity map and the prefix in global order (rare n-grams first)."""
    held = given.sparkSession.sparkContext.broadcast(common)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, count = held.value
        weight = np.zeros(1 << SKETCH_BITS, np.int64)
        weight[where] = count
        for batch in batches:
            for part in slices(batch, "text"):
                sizes, one, two, bits, prefixes = [], [], [], [], []
                for grams in _sets(part, n):
                    size = len(grams)
                    sizes.append(size)
                    mixed = mix(grams ^ U64(0xA5A5A5A5A5A5A5A5))
                    one.append(mixed.sum(dtype=U64))
                    two.append(mix(mixed + U64(0x1234567)).sum(dtype=U64))
                    bits.append(_parity(grams))
                    heavy = weight[(grams >> U64(64 - SKETCH_BITS)).astype(np.int64)]
                    ordered = grams[np.argsort(heavy, kind="stable")] if heavy.any() else grams
                    prefixes.append(signed(ordered[: size + (-size * t.numerator) // t.denominator + 1] if size else grams))
                lengths = np.zeros(len(prefixes) + 1, np.int32)
                np.cumsum([len(p) for p in prefixes], out=lengths[1:])
                flat = pa.array(np.concatenate(prefixes) if prefixes else np.zeros(0, np.int64))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc"), pa.array(np.array(sizes, np.int64)), pa.array(signed(np.array(one, U64))), pa.array(signed(np.array(two, U64))), pa.array(bits, pa.binary()), pa.ListArray.from_arrays(pa.array(lengths), flat)],
                    ["doc", "n", "one", "two", "bits", "prefix"],
                )

    return given.mapInArrow(scan, "doc long, n long, one long, two long, bits binary, prefix array<long>")


def _need(size: int, t: Fraction):
    """The items that a set of ``size`` must share with one of another size."""
    num, den = t.numerator, t.numerator + t.denominator
    return lambda other: -((-num * (size + other)) // den)


def _parity(grams: np.ndarray, grain: int = 1) -> bytes:
    """A bit for each range of hashes, with whether the set has an odd number of items there: about ``grain`` bits an item."""
    width = max(PARITY_BITS, 1 << max(0, grain * len(grams) - 1).bit_length()).bit_length() - 1
    odd = np.bincount((mix(grams ^ U64(0xA5A5A5A5A5A5A5A5)) >> U64(64 - width)).astype(np.int64), minlength=1 << width) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def _folded(maps: np.ndarray, least: int) -> np.ndarray:
    """Parity maps (rows of bytes) as maps of ``least`` bytes: each bit of these is the sum of the bits of its range."""
    if maps.shape[1] == least:
        return maps
    return np.packbits(np.unpackbits(maps, axis=1).reshape(len(maps), least * 8, -1).sum(2, dtype=np.int64).astype(np.uint8) & 1, axis=1)


def _maps(group: pa.RecordBatch) -> np.ndarray:
    """The parity maps of a group, all folded to its smallest."""
    maps = [np.frombuffer(x, np.uint8)[None, :] for x in group.column("bits").to_pylist()]
    least = min(m.shape[1] for m in maps)
    return np.concatenate([_folded(m, least) for m in maps]).view(U64)


class _Classes:
    """The parity maps of a family by their size; a pair is compared at the size of its smaller one."""

    def __init__(self, maps: list[bytes], sizes: np.ndarray, t: Fraction):
        widths = np.array([len(m) for m in maps])
        self.maps, self.sizes, self.t = maps, sizes, t
        self.rows = {w: np.flatnonzero(widths == w) for w in np.unique(widths).tolist()}
        self.held: dict[tuple[int, int], np.ndarray] = {}

    def at(self, width: int, least: int) -> np.ndarray:
        if (width, least) not in self.held:
            own = np.frombuffer(b"".join(self.maps[k] for k in self.rows[width].tolist()), np.uint8).reshape(-1, width)
            self.held[width, least] = np.ascontiguousarray(_folded(own, least)).view(U64)
        return self.held[width, least]

    def near(self, k: int) -> np.ndarray:
        """Which rows may link with row ``k``, by size and parity map (never leaves out a link)."""
        out = np.zeros(len(self.sizes), bool)
        own, mine = int(self.sizes[k]), np.frombuffer(self.maps[k], np.uint8)[None, :]
        low, high = -((-own * self.t.numerator) // self.t.denominator), own * self.t.denominator // self.t.numerator
        for width, rows in self.rows.items():
            other = self.sizes[rows]
            fit = (other >= low) & (other <= high)
            if not fit.any():
                continue
            least = min(width, mine.shape[1])
            apart = np.bitwise_count(self.at(width, least)[fit] ^ np.ascontiguousarray(_folded(mine, least)).view(U64)).sum(1, dtype=np.int64)
            both = own + other[fit]
            shared = -((-self.t.numerator * both) // (self.t.numerator + self.t.denominator))
            out[rows[fit]] = apart <= both - 2 * shared
        out[k] = False
        return out


def _near(bits: np.ndarray, sizes: np.ndarray, probes: np.ndarray, t: Fraction) -> np.ndarray:
    """Which rows may link with each probe, by size and parity map (never leaves out a link)."""
    own, all_sizes = sizes[probes][:, None], sizes[None, :]
    apart = np.bitwise_count(bits[probes][:, None, :] ^ bits[None, :, :]).sum(2, dtype=np.int64)
    shared = -((-t.numerator * (own + all_sizes)) // (t.numerator + t.denominator))
    ok = (apart <= own + all_sizes - 2 * shared) & (shared <= np.minimum(own, all_sizes))
    ok[np.arange(len(probes)), probes] = False
    return ok


def _candidates(t: Fraction):
    """From groups to links of members that may link with another one of the group: each to the least of these."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, right, waiting = [], [], 0
        for group in runs(batches, ["token", "bucket", "i", "j"]):
            if group.num_rows < 2:
                continue
            sizes, bits = group.column("n").to_numpy(), _maps(group)
            alive, probed = np.zeros(len(sizes), bool), np.zeros(len(sizes), bool)
            while True:
                todo = np.flatnonzero(~alive & ~probed)[: max(1, min(64, (1 << 22) // bits.size))]
                if not len(todo):
                    break
                ok = _near(bits, sizes, todo, t)
                alive |= ok.any(0)
                alive[todo] |= ok.any(1)
                probed[todo] = True
            members = np.unique(group.column("v").to_numpy()[alive])
            if len(members) > 1:
                left.append(members[1:])
                right.append(np.full(len(members) - 1, members[0]))
                waiting += len(members)
            if waiting > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(left)), pa.array(np.concatenate(right))], ["a", "b"])
                left, right, waiting = [], [], 0
        if left:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(left)), pa.array(np.concatenate(right))], ["a", "b"])

    return scan


def _link(t: Fraction):
    """From families of sets to enough links that all links of the family are within components; links within a ``part`` are known."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, right = [], []
        for group in runs(batches, ["family", "i", "j"]):
            if group.num_rows < 2:
                continue
            i, j = group.column("i")[0].as_py(), group.column("j")[0].as_py()
            raw = [np.frombuffer(x, np.int64) for x in group.column("items").to_pylist()]
            cuts = np.cumsum([len(x) for x in raw])[:-1]
            values, inverse, count = np.unique(np.concatenate(raw), return_inverse=True, return_counts=True)
            rank = np.empty(len(values), ">u4")
            rank[np.lexsort((values, -count))] = np.arange(len(values))  # one order for all: the family's commonest items first
            del raw, values, count
            members = [np.sort(x) for x in np.split(rank[inverse], cuts)]
            del inverse
            order = sorted(range(len(members)), key=lambda k: members[k].tobytes())  # big-endian, so bytes sort as the lists do
            members = [members[k].astype(np.int32) for k in order]
            present = np.zeros(len(rank), bool)
            ids, own = group.column("v").to_numpy()[order], group.column("own").to_numpy()[order]
            bits = group.column("bits").to_pylist()
            classes = _Classes([bits[k] for k in order], np.array([len(m) for m in members]), t)
            label = np.unique(group.column("part").to_numpy()[order], return_inverse=True)[1]  # rows of one id are in one part
            root = build(members)
            for k in np.flatnonzero(own == i).tolist():
                near = classes.near(k) & (label != label[k])
                if i == j:
                    near[: k + 1] = False
                else:  # pairs within a block meet in a group of its own
                    near &= own == j
                if not near.any():
                    continue
                present[members[k]] = True
                while near.any():
                    allowed = np.zeros(len(near) + 1, np.int64)
                    np.cumsum(near, out=allowed[1:])
                    found = next(iter(matches(root, members[k], present, allowed, _need(len(members[k]), t))), None)
                    if found is None:
                        break
                    left.append(ids[k])
                    right.append(ids[found[0]])
                    label[label == label[found[0]]] = label[k]
                    near &= label != label[k]
                present[members[k]] = False
        yield pa.RecordBatch.from_arrays([pa.array(np.array(left, np.int64)), pa.array(np.array(right, np.int64))], ["a", "b"])

    return scan


def _blocks(members: Column, items: Column) -> Column:
    """The blocks that so many members with so many items make."""
    return F.ceil(F.greatest(members / F.lit(BLOCK), items / F.lit(ITEMS))).cast("long")


def _across(members: DataFrame, links: DataFrame, compared: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``links`` within the blocks of large families, and those found across blocks that connect more.

    What the links connect so far are parts. First a few stand-ins of each part of a family meet in one task, which most
    often leaves one part. In families that still have several, all members outside the largest part meet each other and
    the largest part, in pairs of blocks; members of the largest part do not meet again.
    """

    def parted() -> DataFrame:
        found = components(links).select(F.col("node").alias("v"), F.col("component").alias("part"))
        return written(members.join(found, "v", "left").select("v", "family", "items", F.coalesce("part", "v").alias("part")), "parts")

    parts = parted()
    few = parts.groupBy("family", "part", F.pmod(F.xxhash64("v"), F.lit(STAND_INS))).agg(F.min(F.struct("v", "items")).alias("m")).select("family", "part", "m.v", "m.items")
    meet = few.groupBy("family").agg(F.count("*").alias("n"), F.sum("items").alias("items"), F.min("part").alias("lo"), F.max("part").alias("hi")).where((F.col("n") <= BLOCK) & (F.col("items") <= ITEMS)).where("lo < hi")
    zero = F.lit(0).cast("long")
    links = written(links.unionByName(compared(few.join(meet.select("family"), "family").select("v", "part", "family", zero.alias("own"), zero.alias("i"), zero.alias("j")))), "links")
    parts = parted()
    largest = parts.groupBy("family", "part").agg(F.sum("items").alias("items")).groupBy("family").agg(F.max_by("part", F.struct("items", "part")).alias("largest"), F.count("*").alias("n")).where("n > 1")
    sides = parts.join(largest.select("family", "largest"), "family").withColumn("rest", F.col("part") != F.col("largest"))
    one = lambda side: F.when(side, 1)
    counts = sides.groupBy("family").agg(_blocks(F.count(one(F.col("rest"))), F.sum(F.when(F.col("rest"), F.col("items")))).alias("nr"), _blocks(F.count(one(~F.col("rest"))), F.sum(F.when(~F.col("rest"), F.col("items")))).alias("ng"))
    dealt = sides.join(counts, "family").withColumn("own", F.when(F.col("rest"), F.pmod(F.xxhash64("v"), F.col("nr"))).otherwise(F.col("nr") + F.pmod(F.xxhash64("v"), F.col("ng"))))
    dealt = dealt.withColumn("x", F.explode(F.sequence(zero, F.when(F.col("rest"), F.col("nr") + F.col("ng")).otherwise(F.col("nr")) - 1)))
    return links.unionByName(compared(dealt.select("v", "part", "family", "own", F.least("own", "x").alias("i"), F.greatest("own", "x").alias("j"))))


def jaccard_components(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", n: int = 5, threshold: tuple[int, int] = (4, 5)) -> DataFrame:
    """Per row of ``docs``: ``id_col``, ``n_shingles`` and ``component_id``.

    Words are runs without ASCII white space, A-Z lower-cased. A row's set holds its distinct ``n``-word shingles; with
    fewer words its whole sequence; without words nothing, and then it links with nothing. Rows link when the Jaccard
    likeness of their sets is ``threshold`` (a fraction) or more; ``component_id`` is the least id reachable by links,
    the row's own included. Null text: no words. Rows without an id link with nothing and get a null component. Rows
    that share an id are one node with several sets. Other columns are not returned. Empty input: empty output.

    Method: all sets follow one global order, rare n-grams first, in which two linked sets share an item of their
    prefixes. Equal sets become one member. Prefix items that two members share, with the size class, make groups; size
    and parity-map bounds remove members that can link with none. What such groups connect is a family, outside of which
    its members have no links; so each set is sent once, to its family. There the sets are stored in a prefix tree,
    walked with the items shared so far, leaving branches by what remains. Pairs known to be connected are not compared
    again, which loses no component. Groups above ``BLOCK`` members, and families above as many or above ``ITEMS`` items,
    are dealt in blocks, a text longer than that in one of its own: groups as pairs of blocks, families first each block
    by itself, then a few members for all that is connected, and only what is still apart as pairs of blocks.
    """
    t = Fraction(*threshold)
    given = docs.select(named(id_col).cast("long").alias("doc"), named(text_col).cast("string").alias("text"))
    known = given.where("doc is not null")
    profiles = written(_profiles(given, n, t, _common(known, n)), "profiles")
    sets = profiles.where("n > 0 and doc is not null")
    classes = sets.groupBy("one", "two").agg(F.min("doc").alias("rep"))
    copies = sets.join(classes, ["one", "two"]).where("doc > rep").select(F.col("doc").alias("a"), F.col("rep").alias("b"))
    reps = sets.join(classes.withColumnRenamed("rep", "doc"), ["one", "two", "doc"], "left_semi").dropDuplicates(["doc", "one", "two"])

    posts = reps.select(F.col("doc").alias("v"), F.col("n"), F.explode("prefix").alias("token"))
    shared = posts.groupBy("token").agg(F.min("v").alias("lo"), F.max("v").alias("hi")).where("lo < hi").select("token")
    size_class = F.floor(F.log(F.col("n").cast("double")) / F.lit(1.0001 * log(1 / float(t)) or 1.0)) if t < 1 else F.col("n")
    both = F.array(F.lit(0), F.lit(1)) if t < 1 else F.array(F.lit(0))
    candidates = written(posts.join(shared, "token").withColumn("step", F.explode(both)).select("token", (size_class + F.col("step")).cast("long").alias("bucket"), "v", "n"), "candidates")
    mark = F.xxhash64("v", "n")
    groups = candidates.groupBy("token", "bucket").agg(F.count("*").alias("g"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.bit_xor(mark).alias("m1"), F.bit_xor(F.xxhash64(F.lit(1), mark)).alias("m2")).where("lo < hi")
    groups = groups.groupBy("bucket", "g", "lo", "hi", "m1", "m2").agg(F.min("token").alias("token"))  # one token for groups of the same members
    blocks = F.ceil(F.col("g") / F.lit(BLOCK)).cast("long")
    dealt = (
        candidates.join(groups.select("token", "bucket", blocks.alias("nb")), ["token", "bucket"])
        .withColumn("own", F.pmod(F.xxhash64("v"), F.col("nb")))
        .withColumn("x", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nb") - 1)))
        .select("token", "bucket", F.least("own", "x").alias("i"), F.greatest("own", "x").alias("j"), "v", "n")
    )
    maps = reps.select(F.col("doc").alias("v"), "n", "bits")
    dealt = dealt.join(maps, ["v", "n"]).repartition("token", "bucket", "i", "j").sortWithinPartitions("token", "bucket", "i", "j")
    families = written(components(dealt.mapInArrow(_candidates(t), "a long, b long")), "families")

    def shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column("doc"), pa.array([signed(s).tobytes() for s in _sets(part, n)], pa.binary()), pa.array([_parity(s, FINE) for s in _sets(part, n)], pa.binary())], ["v", "items", "bits"])

    def compared(places: DataFrame) -> DataFrame:
        """Links found between the sets at ``places``: (v, part, family, own, i, j)."""
        wanted = places.select(F.col("v").alias("doc")).distinct().hint("merge")  # grows with the corpus: never broadcast
        items = known.join(wanted, "doc").mapInArrow(shingle, "v long, items binary, bits binary")
        walked = places.join(items, "v").repartition("family", "i", "j").sortWithinPartitions("family", "i", "j")
        return walked.mapInArrow(_link(t), "a long, b long")

    weight = reps.groupBy(F.col("doc").alias("v")).agg(F.sum("n").alias("items"))
    sized = families.select(F.col("node").alias("v"), F.col("component").alias("family")).join(weight, "v")
    blocks = written(sized.groupBy("family").agg(_blocks(F.count("*"), F.sum("items")).alias("nb")), "blocks")
    placed = sized.join(blocks, "family").withColumn("own", F.pmod(F.xxhash64("v"), F.col("nb")))
    links = compared(placed.select("v", F.col("v").alias("part"), "family", "own", F.col("own").alias("i"), F.col("own").alias("j")))
    if not blocks.where("nb > 1").isEmpty():
        links = written(links, "links")
        links = _across(placed.where("nb > 1").select("v", "family", "items"), links, compared)
    joined = components(links.unionByName(copies))
    return profiles.select("doc", "n").join(joined.withColumnRenamed("node", "doc"), "doc", "left").select(F.col("doc").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "doc").alias("component_id"))


def drop_near_copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", n: int = 5, threshold: tuple[int, int] = (4, 5)) -> DataFrame:
    """``docs`` with one row of each component: the rows whose id is their component's least, and rows without words or id.

    Rows that share an id stay or go together. Columns of any names pass through. Empty input: empty output.
    """
    gone = unused(docs, "gone")
    found = jaccard_components(docs, id_col=id_col, text_col=text_col, n=n, threshold=threshold)
    later = found.where(F.col("component_id") < named(id_col)).select(named(id_col).cast("long").alias(gone)).distinct()
    return docs.join(later, named(id_col).cast("long") == F.col(gone), "left_anti")
