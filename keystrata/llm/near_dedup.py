"""Near-duplicate groups by an LSH forest over MinHash signatures.

Plan, for N documents:

1. One Arrow pass hashes every whole text into its set of word shingles and leaves 16 trees x 8 minima of 16 bits, held
   as 32 longs, plus a 128-bit fingerprint of the set. Texts go no further.
2. Documents with one fingerprint collapse to a class (partial aggregate on fixed-width columns), so a hot group of
   copies costs one row afterwards.
3. Forest: each class has one row per tree. A region is the classes that share a tree's first ``depth`` minima; regions
   of one class, nearly all, go after a count. The others are sorted by signature: all pairs of a region of at most
   ``WINDOW`` classes are candidates. In a crowded one the order is taken to its full depth, and the neighbours of longest
   common prefix are candidates, besides each member with the region's centre, the member whose full-depth keys
   are the most frequent ones over all its trees.
4. Candidates whose signatures agree too little for the threshold (by six standard errors) are dropped, the others are
   confirmed on the full shingle sets of the whole texts; the links' connected components are groups.
5. What crowded regions have left is found exactly, by prefixes of shingle sets. Shingles are put in an order in which
   those that cannot join two components come first and frequent ones last. Two sets that reach the threshold share a
   shingle early in both, at places that still allow the overlap, so classes of different components meet on those
   few shingles only. The confirmed links complete the components.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import Scratch
from ._text import SPACED, U64, blocks, mix, windows, words
from .components import connected_components

TREES, DEPTH = 16, 8
#: Chance that the trees miss a link at the threshold: 7.4e-6 at 0.85 (4 minima), 1.03e-5 at 0.80 (3), 1.5e-5 at 0.50 (1).
MISS = 2e-5
#: Classes of a region up to which all its pairs are candidates, and neighbours that a member of a larger one takes.
WINDOW, NEAR = 24, 4
#: Members of a crowded region that are sorted together; more are dealt over several such orders.
ORDER = 512
#: Buckets of shingles that are ranked by frequency; their ranks, a byte each, are sent to all tasks.
BUCKETS = 1 << 20
#: Parts over which the candidates of one class are dealt when they meet its text, and rows of a hot fingerprint theirs.
SALTS = 16
HEADS, TAILS = [f"h{t}" for t in range(TREES)], [f"l{t}" for t in range(TREES)]
KEYS = HEADS + TAILS
_r = np.random.Generator(np.random.PCG64(77))
_MULTIPLY = _r.integers(0, 1 << 63, TREES * DEPTH, dtype=np.uint64) * U64(2) + U64(1)
_ADD = _r.integers(0, 1 << 63, TREES * DEPTH, dtype=np.uint64)


def shingle_sets(column: pa.Array, width: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, hashes, n + 1 positions) of the shingles, repeats included, of blocks of rows.

    A text of fewer than ``width`` words, but not none, has its whole word sequence as one shingle.
    """
    for i, _, raw, offsets in blocks(column):
        h, at = words(raw, offsets, SPACED)
        count = np.diff(at)
        whole = windows(h, width)
        n = np.where(count >= width, count - width + 1, np.minimum(count, 1))
        to = np.concatenate([[0], np.cumsum(n)])
        if len(h) and (count >= width).all():  # usual case: drop the windows that run over a row's end
            inside = np.ones(len(h), bool)
            for k in range(1, width):
                inside[at[1:] - k] = False
            yield i, whole[inside[: len(whole)]], to
            continue
        out = np.zeros(int(to[-1]), U64)
        for r in range(len(n)):
            a, b = int(at[r]), int(at[r + 1])
            if b - a >= width:
                out[to[r] : to[r + 1]] = whole[a : b - width + 1]
            elif b > a:
                with np.errstate(over="ignore"):
                    value = U64(b - a)
                    for x in h[a:b]:
                        value = value * U64(0xA0761D6478BD642F) + x
                    out[to[r]] = mix(np.array([value], U64))[0]
        yield i, out, to


def _signatures(shingles: np.ndarray, to: np.ndarray) -> np.ndarray:
    """n x 128 minima of 16 bits; rows without shingles are zero."""
    n = len(to) - 1
    out = np.zeros((n, TREES * DEPTH), np.uint16)
    full = np.flatnonzero(np.diff(to))
    if not len(full):
        return out
    most = 1 << 15  # shingles that one step of the inner loop handles: they stay in the processor's cache
    lo = 0
    while lo < len(full):
        hi = max(lo + 1, int(np.searchsorted(to[full + 1], to[full[lo]] + most, "right")))
        rows = full[lo:hi]
        a, b = int(to[rows[0]]), int(to[rows[-1] + 1])
        part, starts, temp = shingles[a:b], to[rows] - a, np.empty(b - a, U64)
        least = np.empty((TREES * DEPTH, len(rows)), U64)
        with np.errstate(over="ignore"):
            for k in range(TREES * DEPTH):
                np.multiply(part, _MULTIPLY[k], out=temp)
                temp += _ADD[k]
                temp ^= temp >> U64(31)
                np.minimum.reduceat(temp, starts, out=least[k])
            out[rows] = ((mix(least) >> U64(17)) & U64(65535)).astype(np.uint16).T
        lo = hi
    return out


def _fingerprint(width: int, id_col: str, text_col: str):
    def run(batches):
        for batch in batches:
            ids = batch.column(id_col)
            for i, shingles, to in shingle_sets(batch.column(text_col), width):
                n = len(to) - 1
                sizes, one, two = np.zeros(n, np.int64), np.zeros(n, U64), np.zeros(n, U64)
                with np.errstate(over="ignore"):
                    for r in range(n):
                        if to[r] < to[r + 1]:
                            part = np.sort(shingles[to[r] : to[r + 1]])
                            if len(part) > 1:
                                part = part[np.concatenate([[True], part[1:] != part[:-1]])]
                            sizes[r] = len(part)
                            one[r] = part.sum(dtype=U64)
                            two[r] = ((part ^ (part >> U64(29))) * U64(0xBF58476D1CE4E5B9)).sum(dtype=U64)
                keys = _signatures(shingles, to).astype(">u2").view(">u8").astype(U64).view(np.int64)  # two longs a tree
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(i, n).cast(pa.int64()), pa.array(sizes), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), *(pa.array(np.ascontiguousarray(keys[:, 2 * t + k])) for k in (0, 1) for t in range(TREES))],
                    names=["id", "n", "f1", "f2", *KEYS],
                )

    return run


def depth_for(percent: float) -> int:
    """The most minima of a region's prefix at which all trees miss a link at the threshold with probability below ``MISS``; 1 to 4."""
    share = percent / 100
    return max([1, *(d for d in range(1, 5) if (1 - share**d) ** TREES < MISS)])


def forest_members(classes: DataFrame, depth: int, scratch: Scratch) -> DataFrame:
    """``tree``, ``prefix``, ``head``, ``tail``, ``rep``, ``size``: a row for each class and tree whose region holds ``size`` > 1 classes.

    ``classes``: ``rep`` and the 32 keys. Regions are counted by partial aggregates. Minima have 16 bits, so unrelated
    classes share a prefix with probability 2 ** (-16 * depth).
    """
    both = F.array(*(F.struct(F.col(h).alias("head"), F.col(t).alias("tail")) for h, t in zip(HEADS, TAILS, strict=True)))
    rows = classes.select("rep", F.posexplode(both).alias("tree", "key")).select("tree", F.shiftright("key.head", 64 - 16 * depth).alias("prefix"), "key.head", "key.tail", "rep")
    regions = rows.groupBy("tree", "prefix").agg(F.count("*").alias("size")).where("size > 1")
    return scratch.keep(rows.join(scratch.keep(regions, "regions"), ["tree", "prefix"]), "members")


def _neighbours(window: int, near: int):
    """Streams one sorted partition; pairs of rows of one order at most ``window`` rows apart, ``near`` in crowded ones."""

    def pairs(order, crowded, rep, upto):
        """Pairs whose first row is among the first ``upto``; all rows that they can reach are there."""
        i = np.arange(upto)
        for s in range(1, window + 1):
            j = i[: max(0, len(rep) - s)]
            j = j[(order[j] == order[j + s]) & (rep[j] != rep[j + s]) & ((s <= near) | ~crowded[j])]
            if len(j):
                a, b = np.minimum(rep[j], rep[j + s]), np.maximum(rep[j], rep[j + s])
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    def run(batches):
        held = (np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64))
        for batch in batches:
            now = (batch.column(k).to_numpy(zero_copy_only=False) for k in ("order", "crowded", "rep"))
            held = tuple(np.concatenate([x, y]) for x, y in zip(held, now, strict=True))
            whole = max(0, len(held[0]) - window)
            yield from pairs(*held, whole)
            held = tuple(x[whole:] for x in held)
        yield from pairs(*held, len(held[0]))

    return run


def forest_candidates(members: DataFrame, window: int = WINDOW, near: int = NEAR) -> DataFrame:
    """Candidate pairs (a < b) of neighbours in the sorted orders: all pairs of regions of at most ``window`` classes."""
    crowded = F.col("size") > window
    part = F.when(crowded, F.pmod(F.xxhash64("rep"), F.ceil(F.col("size") / ORDER))).otherwise(0)
    rows = members.select(F.xxhash64("tree", "prefix", part).alias("order"), crowded.alias("crowded"), "head", "tail", "rep")
    ordered = rows.repartition("order").sortWithinPartitions("order", "head", "tail", "rep").select("order", "crowded", "rep")
    return ordered.mapInArrow(_neighbours(window, near), "a long, b long")


def centre_candidates(members: DataFrame, window: int = WINDOW) -> DataFrame:
    """Pairs (a < b) of each member of a crowded region with the region's centre, in partial aggregates only."""
    crowded = members.where(F.col("size") > window)
    often = crowded.groupBy("tree", "prefix", "head", "tail").agg(F.count("*").alias("n"))
    score = crowded.join(often, ["tree", "prefix", "head", "tail"]).groupBy("rep").agg(F.sum("n").alias("score"))
    scored = crowded.select("tree", "prefix", "rep").join(score, "rep")
    centre = scored.groupBy("tree", "prefix").agg(F.min_by("rep", F.struct(-F.col("score"), "rep")).alias("centre"))
    met = crowded.select("tree", "prefix", "rep").join(centre, ["tree", "prefix"]).where("rep <> centre")
    return met.select(F.least("rep", "centre").alias("a"), F.greatest("rep", "centre").alias("b"))


#: Most bits of the map of asked ids that is sent to all tasks: two million rows of sixteen bytes.
MAP_BITS = 1 << 27


def _map_filter(rows: DataFrame, asked: DataFrame) -> DataFrame:
    """``rows`` whose id may be among ``asked``: a one-probe Bloom map of bounded size keeps other texts from the shuffle.

    About sixteen bits an id, at most ``MAP_BITS``; beyond that it lets more rows pass, never fewer.
    """
    bits = 1 << min(MAP_BITS.bit_length() - 1, max(16, (16 * asked.count()).bit_length()))
    place = F.pmod(F.xxhash64("id"), F.lit(bits))
    bit = F.expr(f"shiftleft(1L, cast(pmod(xxhash64(id), {bits}L) & 63 as int))")
    words_ = asked.select(F.shiftright(place, 6).alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("held"))
    met = rows.withColumn("word", F.shiftright(place, 6)).join(F.broadcast(words_), "word")
    return met.where(F.col("held").bitwiseAND(bit) != 0).drop("word", "held")


def _agreeing(least: int):
    """Passes pairs on whose signatures agree in at least ``least`` minima."""

    def run(batches):
        for batch in batches:
            total = np.zeros(batch.num_rows, np.int64)
            for k in KEYS:
                x = batch.column(f"a_{k}").to_numpy() ^ batch.column(f"b_{k}").to_numpy()
                total += (x.view(np.uint16).reshape(-1, 4) == 0).sum(axis=1)
            keep = pa.array(total >= least)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], names=["a", "b"])

    return run


def _likely(pairs: DataFrame, classes: DataFrame, percent: float) -> DataFrame:
    """Candidates (distinct) whose sizes and signatures allow a link."""
    share = percent / 100
    least = math.floor(TREES * DEPTH * (share - 6 * math.sqrt(share * (1 - share) / (TREES * DEPTH))))
    side = lambda s: classes.select(F.col("rep").alias(s), F.col("n").alias(f"n_{s}"), *(F.col(k).alias(f"{s}_{k}") for k in KEYS))
    both = pairs.distinct().join(side("a"), "a").join(side("b"), "b")
    sizes = 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")
    return both.where(sizes).mapInArrow(_agreeing(least), "a long, b long").distinct()


def _confirm(width: int, percent: float):
    def sets(column):
        coded = column.dictionary_encode()  # one text stands in many rows
        held = []
        for _, shingles, to in shingle_sets(coded.dictionary, width):
            held += [np.unique(shingles[to[r] : to[r + 1]]) for r in range(len(to) - 1)]
        return [held[k] for k in coded.indices.to_pylist()]

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                keep = []
                for x, y in zip(sets(part.column("text_a")), sets(part.column("text_b")), strict=True):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(len(x) > 0 and len(y) > 0 and 100 * both >= percent * (len(x) + len(y) - both))
                yield pa.RecordBatch.from_arrays([part.column("u").filter(pa.array(keep, pa.bool_())), part.column("v").filter(pa.array(keep, pa.bool_()))], names=["u", "v"])

    return run


def _confirmed(texts: DataFrame, close: DataFrame, width: int, percent: float) -> DataFrame:
    """The links (``u``, ``v``) among candidate pairs, decided on whole texts. A class with very many candidates is met in parts."""
    close = close.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)))
    left = texts.join(close.select(F.col("a").alias("id"), "salt").distinct(), "id").select(F.col("id").alias("a"), "salt", F.col("text").alias("text_a"))
    both = close.join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b").join(left, ["a", "salt"])
    return both.select(F.col("a").alias("u"), F.col("b").alias("v"), "text_a", "text_b").mapInArrow(_confirm(width, percent), "u long, v long").distinct()


def _crowd_sets(width: int):
    def run(batches):
        for batch in batches:
            for i, shingles, to in shingle_sets(batch.column("text"), width):
                sets = [np.unique(shingles[to[r] : to[r + 1]]).view(np.int64) for r in range(len(to) - 1)]
                flat = pa.array(np.concatenate([np.zeros(0, np.int64), *sets]))
                ends = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in sets])]), pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column(k).slice(i, len(sets)) for k in ("rep", "component")] + [pa.ListArray.from_arrays(ends, flat)], names=["rep", "component", "shingles"])

    return run


def _bucket_counts(batches):
    """Rows, least and greatest component of each bucket of shingles that this partition holds."""
    count, low, high = np.zeros(BUCKETS, np.int64), np.full(BUCKETS, np.iinfo(np.int64).max), np.full(BUCKETS, np.iinfo(np.int64).min)
    for batch in batches:
        lists = batch.column("shingles")
        bucket = lists.flatten().to_numpy() & (BUCKETS - 1)
        component = np.repeat(batch.column("component").to_numpy(), lists.value_lengths().to_numpy())
        count += np.bincount(bucket, minlength=BUCKETS)
        np.minimum.at(low, bucket, component)
        np.maximum.at(high, bucket, component)
    held = np.flatnonzero(count)
    for lo in range(0, len(held), 50_000):
        k = held[lo : lo + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (k, count[k], low[k], high[k])], names=["bucket", "n", "low", "high"])


def _ceil(x: float) -> int:
    return math.ceil(x - 1e-9)


def _prefixes(rank: bytes, percent: float):
    """The shingles on which a set can meet others: ``place`` counts from 0 in the common order; ``early`` if the other may be larger.

    With n shingles and similarity p, an overlap is at least p * n, and 2 p / (1 + p) * n with a set that is not smaller,
    so the first common shingle has at most n minus that before it.
    """
    ranks = np.frombuffer(rank, np.uint8)

    def run(batches):
        for batch in batches:
            lists = batch.column("shingles")
            values, at = lists.flatten().to_numpy(), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
            by = ranks[values & (BUCKETS - 1)]
            picked, rows, places, early = [], [], [], []
            for r in range(batch.num_rows):
                own, of = values[at[r] : at[r + 1]], by[at[r] : at[r + 1]]
                n, alone = len(own), int((of == 0).sum())
                far = n - _ceil(percent * n / 100) + 1
                if n and alone < far:
                    place = np.arange(alone, min(far, n))
                    picked.append(own[np.lexsort((own, of))[place]])
                    places.append(place)
                    early.append(place < n - _ceil(2 * percent * n / (100 + percent)) + 1)
                    rows.append(np.full(len(place), r))
            if rows:
                row = pa.array(np.concatenate(rows))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(picked)), batch.column("rep").take(row), batch.column("component").take(row), lists.value_lengths().cast(pa.int64()).take(row), pa.array(np.concatenate(places)), pa.array(np.concatenate(early))],
                    names=["shingle", "rep", "component", "n", "place", "early"],
                )

    return run


def prefix_candidates(sets: DataFrame, percent: float, scratch: Scratch) -> DataFrame:
    """Pairs (a < b, distinct) of different components that may reach the threshold; none that reaches it is missing.

    ``sets``: ``rep``, ``component``, ``shingles`` (distinct hashes). A shingle's rows meet across components only: those of its
    most frequent component against the others, so a component of very many members that shares its shingles with a few costs
    their product, not its square.
    """
    counts = sets.mapInArrow(_bucket_counts, "bucket long, n long, low long, high long").groupBy("bucket").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
    told = counts.where("n > 1 and low <> high").select("bucket", "n").toArrow()  # at most BUCKETS rows of 16 bytes
    rank = np.zeros(BUCKETS, np.uint8)
    rank[told["bucket"].to_numpy()] = np.minimum(255, 1 + 8 * np.log2(told["n"].to_numpy())).astype(np.uint8)
    rows = scratch.keep(sets.mapInArrow(_prefixes(rank.tobytes(), percent), "shingle long, rep long, component long, n long, place long, early boolean"), "prefixes")
    kinds = rows.groupBy("shingle", "component").agg(F.count("*").alias("held"))
    major = kinds.groupBy("shingle").agg(F.max_by("component", F.struct("held", "component")).alias("major"), F.count("*").alias("kinds")).where("kinds > 1").drop("kinds")
    marked = rows.join(major, "shingle")
    side = lambda df, s: df.select("shingle", *(F.col(c).alias(f"{c}_{s}") for c in ("rep", "component", "n", "place", "early")))
    x, y = side(marked.where("component <> major"), "x"), side(marked, "y")
    first = F.struct("n_x", "rep_x") < F.struct("n_y", "rep_y")
    allowed = F.when(first, F.col("early_x")).otherwise(F.col("early_y")) & (100 * F.least("n_x", "n_y") >= percent * F.greatest("n_x", "n_y"))
    overlap = F.least(F.col("n_x") - F.col("place_x"), F.col("n_y") - F.col("place_y"))  # at most, if this is their first common shingle
    enough = (100 + percent) * overlap >= percent * (F.col("n_x") + F.col("n_y"))
    met = x.join(y, "shingle").where((F.col("component_x") != F.col("component_y")) & (F.col("rep_x") != F.col("rep_y")) & allowed & enough)
    return met.select(F.least("rep_x", "rep_y").alias("a"), F.greatest("rep_x", "rep_y").alias("b")).distinct()


def _same_id(classed: DataFrame) -> DataFrame:
    """Links between classes that rows of one id stand in."""
    several = classed.groupBy("id").agg(F.min("rep").alias("u"), F.max("rep").alias("most")).where("u <> most").select("id", "u")
    return classed.join(several, "id").where("rep <> u").select("u", F.col("rep").alias("v"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: float = 80, width: int = 5, scratch: Scratch | None = None) -> DataFrame:
    """One row for each row of ``docs``: ``id``, ``n_shingles``, ``component_id``, ``kept``.

    Documents are linked when 100 * |intersection| >= percent * |union| of their sets of ``width``-word shingles
    (A-Z lower-cased, words of anything but ASCII white space). A text with fewer words is one shingle; a null,
    empty or blank text has none, is linked with nothing and is its own component. Repeated rows and equal ids are one
    document: they share the component of any of them, and all of them are kept if that id is the component's. A row
    whose id is null has null component and is kept, since nothing can name it. An empty table gives an empty result;
    other columns are ignored.
    """
    scratch = scratch or Scratch(docs.sparkSession, "near")
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    schema = "id long, n long, f1 long, f2 long, " + ", ".join(f"{k} long" for k in KEYS)
    marks = scratch.keep(base.mapInArrow(_fingerprint(width, "id", "text"), schema), "marks")
    named = marks.where("n > 0 and id is not null")
    classes = scratch.keep(named.groupBy("n", "f1", "f2").agg(F.min("id").alias("rep"), F.count("*").alias("held"), *(F.first(k).alias(k) for k in KEYS)), "classes")
    # rows of a fingerprint meet their class over salts; a class of one row is named like it
    salted = classes.where("held > 1").select("n", "f1", "f2", "rep", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    dealt = named.select("id", "n", "f1", "f2", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int").alias("salt"))
    classed = scratch.keep(dealt.join(salted, ["n", "f1", "f2", "salt"], "left").select("id", "n", F.coalesce("rep", "id").alias("rep")), "classed")
    members = forest_members(classes, depth_for(percent), scratch)
    close = scratch.keep(_likely(forest_candidates(members).union(centre_candidates(members)), classes, percent), "close")
    crowd = members.where(F.col("size") > WINDOW).select("rep").distinct()
    asked = scratch.keep(close.select(F.explode(F.array("a", "b")).alias("id")).union(crowd).distinct(), "asked")
    # several rows may have one id: each such text takes part
    texts = scratch.keep(_map_filter(base.where("text is not null"), asked).join(asked, "id", "left_semi"), "texts")
    links = scratch.keep(_confirmed(texts, close, width, percent), "confirmed")
    groups = connected_components(links.union(_same_id(classed)), scratch)
    if not members.where(F.col("size") > WINDOW).isEmpty():
        known = crowd.join(groups.withColumnRenamed("node", "rep"), "rep", "left").select("rep", F.coalesce("component", "rep").alias("component"))
        sets = scratch.keep(texts.withColumnRenamed("id", "rep").join(known, "rep").mapInArrow(_crowd_sets(width), "rep long, component long, shingles array<long>"), "sets")
        more = scratch.keep(_likely(prefix_candidates(sets, percent, scratch), classes, percent), "more")
        more = scratch.keep(_confirmed(texts, more, width, percent), "completed")
        groups = connected_components(groups.select(F.col("node").alias("u"), F.col("component").alias("v")).union(more), scratch, "joined")
    scratch.drop("classes", "regions", "members", "close", "asked", "texts", "confirmed", "sets", "prefixes", "more", "completed")
    component = F.coalesce("component", "rep")
    found = classed.join(groups.withColumnRenamed("node", "rep"), "rep", "left").select("id", F.col("n").alias("n_shingles"), component.alias("component_id"), (component == F.col("id")).alias("kept"))
    rest = marks.where("n = 0 or id is null").select("id", F.col("n").alias("n_shingles"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    return found.union(rest)
