"""Near-duplicate documents by SetSketch registers.

Every document is a set of word shingles.  Its sketch holds, for each register,
the minimum of exponentially distributed hashes over the set, put on an
exponential scale (base ``BASE``) and truncated: such registers of two sets can
be merged by maximum and agree about as often as the sets overlap.  Documents
with equal sets form a class at once.  Runs of register values are bands; the
members of a bucket of equal bands are tried against its most central member only, a
likelihood of both sketches and sizes drops the hopeless, and the others are
confirmed on the full sets.  Members of one pivot that are then still in
several components are paired by the rarest items in which they differ from the
pivot; pairs inside a component cannot change the result and are left out.
Rows of a pivot or band that holds many are split wherever they are joined.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import as_bytes, slices
from .common import discard, hot_keys, join_spread, materialize

#: Registers: BANDS bands of ROWS; scale after the published recommendation for 16-bit registers.
BANDS, ROWS = 32, 5
REGISTERS = BANDS * ROWS
BASE, RATE, TOP = 1.001, 20.0, 65534

_rng = np.random.default_rng(23)
_MULTIPLY = (_rng.integers(0, 1 << 31, REGISTERS, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
_ADD = _rng.integers(0, 1 << 32, REGISTERS, dtype=np.uint32)
_MIX = [np.uint64(int(x) | 1) for x in _rng.integers(1 << 62, 1 << 63, 64, dtype=np.uint64)]


def _scramble(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _MIX[62]
    h = (h ^ (h >> np.uint64(29))) * _MIX[63]
    return h ^ (h >> np.uint64(32))


class Shingler:
    """Shingle sets of texts as sorted 64-bit hashes; words are hashed once while they are remembered."""

    def __init__(self, width: int):
        self.width, self.words = width, {}

    def set_of(self, text: bytes) -> np.ndarray:
        words = text.lower().split()
        if not words:
            return np.empty(0, np.uint64)
        if len(self.words) > 300_000:
            self.words = {}
        known = self.words
        for w in set(words).difference(known):
            known[w] = xxhash.xxh3_64_intdigest(w)
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        n = min(self.width, len(h))
        out = np.full(len(h) - n + 1, n, np.uint64)
        for k in range(n):
            out = _scramble(out + h[k : len(h) - n + 1 + k] * _MIX[k % 60])
        return np.unique(out)


def registers(items: np.ndarray) -> np.ndarray:
    """Sketch of a non-empty set."""
    low = np.full(REGISTERS, 0xFFFFFFFF, np.uint32)
    x = (items >> np.uint64(32)).astype(np.uint32)
    for a in range(0, len(x), 512):
        np.minimum(low, (x[a : a + 512, None] * _MULTIPLY + _ADD).min(0), out=low)
    minima = -np.log1p(-(low + 0.5) / 4294967296.0) / RATE
    return np.clip(np.floor(1 - np.log(minima) / math.log(BASE)), 0, TOP + 1).astype(np.uint16)


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sketch of the union."""
    return np.maximum(a, b)


def band_keys(k: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band of register values."""
    v = k.reshape(BANDS, ROWS).astype(np.uint64)
    out = np.arange(1, BANDS + 1, dtype=np.uint64)
    for r in range(ROWS):
        out = _scramble(out * _MIX[61] + v[:, r])
    return out.view(np.int64)


_GRID = np.linspace(0.0, 1.0, 101)


def joint_estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Most likely similarity of pairs of sketches (P, REGISTERS) with known set sizes, on a grid of hundredths."""
    more, less = (a > b).sum(1)[:, None], (a < b).sum(1)[:, None]
    same = REGISTERS - more - less
    u = (na / (na + nb))[:, None]
    v = 1 - u
    j = _GRID[None, :]
    p = lambda x: -np.log1p(-np.clip(x, 0, None) * (BASE - 1) / BASE) / math.log(BASE)
    up, down = p(u - v * j), p(v - u * j)
    eps = 1e-12
    value = more * np.log(up + eps) + less * np.log(down + eps) + same * np.log(np.clip(1 - up - down, eps, None))
    value = np.where(j <= np.minimum(u / v, v / u) + 1e-9, value, -np.inf)
    return _GRID[value.argmax(1)]


def _sets(column: pa.Array) -> Iterator[np.ndarray]:
    """Sets of a binary column, where they lie."""
    return (np.frombuffer(x.as_buffer(), np.uint64) for x in column)


def sketches(docs: DataFrame, width: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n, digest, sketch, bands) of every row; without words n is 0 and the rest null."""
    wanted = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    schema = T.StructType(
        [T.StructField("doc_id", wanted.schema["doc_id"].dataType), T.StructField("n", T.LongType()), T.StructField("digest", T.BinaryType()), T.StructField("sketch", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType()))]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(width)
        for batch in batches:
            for part in slices(batch):
                n, digests, drawn, bands = [], [], [], []
                for t in as_bytes(part.column("text")):
                    s = shingler.set_of(t)
                    n.append(len(s))
                    k = registers(s) if len(s) else None
                    digests.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                    drawn.append(None if k is None else k.tobytes())
                    bands.append(None if k is None else band_keys(k))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(drawn, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], schema.names)

    return wanted.mapInArrow(run, schema)


def plausible(pairs: DataFrame, drawn: DataFrame, least: float, slack: float = 0.15) -> DataFrame:
    """Pairs (a, b) whose most likely similarity is at least ``least - slack`` (over four standard errors)."""
    side = lambda s: drawn.select(F.col("rep").alias(s), F.col("n").alias(f"n{s}"), F.col("sketch").alias(f"s{s}"))
    pairs = pairs.select("a", "b")
    met = join_spread(join_spread(pairs, side("a"), "a", hot_keys(pairs, "a")), side("b"), "b", hot_keys(pairs, "b")).where((F.col("na") >= least * F.col("nb")) & (F.col("nb") >= least * F.col("na")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                sketch = lambda c, part: np.frombuffer(b"".join(part.column(c).to_pylist()), np.uint16).reshape(-1, REGISTERS)
                keep = []
                for at in range(0, batch.num_rows, 2000):
                    part = batch.slice(at, 2000)
                    n = lambda c, part=part: part.column(c).to_numpy(zero_copy_only=False).astype(float)
                    keep.append(joint_estimate(sketch("sa", part), sketch("sb", part), n("na"), n("nb")) >= least - slack)
                mask = pa.array(np.concatenate(keep))
                yield batch.select(["a", "b"]).filter(mask)

    return met.mapInArrow(run, "a bigint, b bigint")


def full_sets(docs: DataFrame, reps: DataFrame, width: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(rep, items) of the documents named by ``reps`` (rep, digest): the sorted set as bytes."""
    wanted = docs.select(docs[id_col].alias("rep"), docs[text_col].alias("text")).join(reps.select("rep", F.col("digest").alias("want")), "rep")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(width)
        for batch in batches:
            for part in slices(batch):
                rows = [(i, s.tobytes()) for i, t, want in zip(part.column("rep").to_pylist(), as_bytes(part.column("text")), part.column("want").to_pylist(), strict=True) if xxhash.xxh3_128_digest((s := shingler.set_of(t)).tobytes()) == want]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], ["rep", "items"])

    return wanted.mapInArrow(run, "rep bigint, items binary").groupBy("rep").agg(F.first("items").alias("items"))


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs with 100 * common >= percent * union on the full sets."""
    pairs = pairs.select("a", "b")
    met = join_spread(pairs, sets.select(F.col("rep").alias("a"), F.col("items").alias("ia")), "a", hot_keys(pairs, "a"))
    met = join_spread(met, sets.select(F.col("rep").alias("b"), F.col("items").alias("ib")), "b", hot_keys(pairs, "b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, ("ia", "ib")):
                keep = []
                for u, v in zip(_sets(part.column("ia")), _sets(part.column("ib")), strict=True):
                    both = len(np.intersect1d(u, v, assume_unique=True))
                    keep.append(100 * both >= percent * (len(u) + len(v) - both))
                yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return met.mapInArrow(run, "a bigint, b bigint")


def differences(group: DataFrame, sets: DataFrame, hot: list[tuple]) -> DataFrame:
    """``group`` (pivot, rep, root, apart, top) with n, the size of the set, common, what it shares with the pivot's, and added, its items that the pivot lacks."""
    met = join_spread(group, sets.select(F.col("rep").alias("pivot"), F.col("items").alias("ip")), "pivot", hot)
    met = join_spread(met, sets.select("rep", "items"), "rep", hot_keys(group, "rep"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, ("ip", "items")):
                n, common, added = [], [], []
                for x, own in zip(_sets(part.column("ip")), _sets(part.column("items")), strict=True):
                    rest = np.setdiff1d(own, x, assume_unique=True)
                    n.append(len(own))
                    common.append(len(own) - len(rest))
                    added.append(rest.view(np.int64))
                names = ["pivot", "rep", "root", "apart", "top"]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(n, pa.int64()), pa.array(common, pa.int64()), pa.array(added, pa.list_(pa.int64()))], [*names, "n", "common", "added"])

    return met.mapInArrow(run, "pivot bigint, rep bigint, root bigint, apart boolean, top bigint, n bigint, common bigint, added array<bigint>")


def crossing_pairs(members: DataFrame, percent: int, hot: list[tuple]) -> DataFrame:
    """Pairs (a, b) of one pivot's members in two components that can still be linked; none that can is left out.

    Two linked sets x, y share at least percent / 100 of the larger one's
    items.  Either some of these are no items of the pivot, or all are.

    In the first case both have such an item among the rarest ones that they
    add to the pivot: with k items to be shared and at most ``common`` of them
    the pivot's, the others being ordered alike, it stands among the first
    n - k + 1 (prefix filtering).  Items that all their holders of one pivot
    have in one component lead to no pair.

    In the second case what each shares with the pivot bounds what they can
    share, so both are all but contained in the pivot, and each bounds the size
    of the other: these meet by pivot and step of size, in parts where a pivot
    has more members than a task should hold.

    Two members whose most central pivot (top) is the same meet there and
    nowhere else; a member and its top have met already.
    """
    side = lambda s: [F.col("rep").alias(s), F.col("root").alias(f"r{s}"), F.col("n").alias(f"n{s}"), F.col("common").alias(f"c{s}"), F.col("top").alias(f"t{s}")]
    here = (F.col("tx") != F.col("ty")) | (F.col("pivot") == F.col("tx"))
    apart = (F.col("rx") != F.col("ry")) & here & (F.col("x") != F.col("ty")) & (F.col("y") != F.col("tx"))
    once = F.col("whole") | (F.col("x") < F.col("y"))
    sizes = (100 * F.col("nx") >= percent * F.col("ny")) & (100 * F.col("ny") >= percent * F.col("nx"))
    least = F.ceil(percent * F.col("n") / 100).cast("long")

    added = members.select("pivot", "rep", "root", "apart", "n", "common", "top", F.explode("added").alias("item"))
    holders = added.groupBy("pivot", "item").agg(F.count("*").alias("held"), (F.min("root") != F.max("root")).alias("_two"), F.bool_or("apart").alias("_any"))
    # Rare items first; a set's items that none can share take their places in that order too.
    by_rarity = Window.partitionBy("pivot", "rep").orderBy("held", "item")
    ranked = added.join(holders, ["pivot", "item"]).withColumn("_nth", F.row_number().over(by_rarity)).where(F.col("_nth") <= F.col("n") - least + 1)
    first = materialize(ranked.where("_two AND _any").drop("held", "_two", "_any", "_nth"), "near-rarest")
    y = first.select("pivot", "item", (~F.col("apart")).alias("whole"), *side("y"))
    by_item = first.where("apart").select("pivot", "item", *side("x")).join(y, ["pivot", "item"]).where(apart & once & sizes)

    enough = lambda c: percent * (F.col("nx") + F.col("ny")) <= (100 + percent) * F.col(c)
    step = lambda n: F.floor(F.log(F.greatest(n, F.lit(1))) / math.log(1.05)).cast("int")
    inside = members.drop("added").where(F.col("common") >= least).withColumn("most", F.floor((100 + percent) * F.col("common") / percent - F.col("n")))
    many = F.broadcast(members.sparkSession.createDataFrame(hot or [(-1, 1)], "pivot bigint, parts int"))  # a bounded number of pivots
    inside = inside.join(many, "pivot", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    # The steps of size that a partner of x can stand in; one more on both sides for rounding.
    fitting = F.explode(F.sequence(step(least) - 1, F.greatest(step(F.col("most")), step(least)) + 1)).alias("step")
    x = inside.where("apart").select("pivot", "parts", fitting, *side("x")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    y = inside.select("pivot", step(F.col("n")).alias("step"), F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int").alias("part"), (~F.col("apart")).alias("whole"), *side("y"))
    by_size = x.drop("parts").join(y, ["pivot", "step", "part"]).where(apart & once & sizes & enough("cx") & enough("cy"))
    pair = [F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")]
    return by_item.select(*pair).unionByName(by_size.select(*pair)).distinct()


def components(edges: DataFrame, name: str = "near") -> DataFrame:
    """(node, root) for every node of the edges (a, b); a component's root is any one of its nodes.

    Each round every node points to its neighbour (or itself) that is first in
    a random order, and the edges are drawn between those; the number of nodes
    falls by a constant factor a round, whatever the shape of the graph.
    """
    order = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("v"))
    edges = materialize(edges.where("a <> b").select("a", "b").distinct(), f"{name}-edges")
    roots = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = both.groupBy("a").agg(F.min(order("b")).alias("best")).select(F.col("a").alias("node"), F.least(F.col("best"), order("a"))["v"].alias("root"))
        step, old = materialize(step, f"{name}-step"), (edges, roots)
        if roots is None:
            roots = step
        else:  # a node that this round leaves alone keeps its root
            at = step.select(F.col("node").alias("root"), F.col("root").alias("new"))
            moved = join_spread(roots, at, "root", hot_keys(roots, "root"), "left")
            roots = materialize(moved.select("node", F.coalesce("new", "root").alias("root")), f"{name}-roots")
        to = lambda s: step.select(F.col("node").alias(s), F.col("root").alias(f"r{s}"))  # noqa: E731, B023
        drawn = join_spread(join_spread(edges, to("a"), "a", hot_keys(edges, "a")), to("b"), "b", hot_keys(edges, "b"))
        edges = materialize(drawn.where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), f"{name}-edges")
        discard(*old, *([] if step is roots else [step]))
    if roots is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots


def _with_roots(rows: DataFrame, roots: DataFrame, column: str, out: str, hot: list[tuple] | None = None) -> DataFrame:
    known = roots.select(F.col("node").alias(column), F.col("root").alias(out))
    return join_spread(rows, known, column, hot_keys(rows, column) if hot is None else hot, "left").withColumn(out, F.coalesce(out, column))


def _large(sizes: DataFrame, most: int = 1_000) -> list[tuple]:
    """``hot_keys`` of bands from their sizes."""
    total = sizes.agg(F.sum("size")).first()[0] or 0
    large = sizes.where((F.col("size") * most > total) & (F.col("size") > 100)).select("band", F.ceil(F.col("size") * most / F.greatest(F.lit(total), F.lit(1))).cast("int"))
    return [(r[0], r[1]) for r in large.collect()]


def _by_number(docs: DataFrame, width: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """``near_duplicates`` for ids of other types: numbers rise with the ids, so the smallest stays the smallest."""
    ids = materialize(docs.select(docs[id_col].alias("id")).where("id IS NOT NULL").distinct().orderBy("id").withColumn("number", F.monotonically_increasing_id()), "near-ids")
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).join(ids, "id", "left").select("number", "text")
    out = near_duplicates(rows, width, percent, "number", "text")
    named = lambda c: ids.select(F.col("number").alias(c), F.col("id").alias(f"{c}_name"))
    out = join_spread(out, named("component_id"), "component_id", hot_keys(out, "component_id"), "left").join(named("doc_id"), "doc_id", "left")
    return out.select(F.col("doc_id_name").alias("doc_id"), "n_shingles", F.col("component_id_name").alias("component_id"), "kept")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row.

    Links are pairs with 100 * common >= percent * union shingles; component_id
    is the smallest id that links lead to.  Texts without words (null, empty)
    are linked with nothing; so is a row without an id, which is kept under a
    null component.  Rows that repeat an id and text come back once each; an
    empty table gives an empty result.  Ids that are no whole numbers are
    numbered in their order and named again at the end.
    """
    if not isinstance(docs.schema[id_col].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return _by_number(docs, width, percent, id_col, text_col)
    least = percent / 100
    drawn = materialize(sketches(docs, width, id_col, text_col), "near-sketches")
    linkable = drawn.where(F.col("doc_id").isNotNull() & F.col("digest").isNotNull())
    reps = materialize(
        linkable.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.first("bands").alias("bands")), "near-classes"
    )
    member = materialize(linkable.select("doc_id", "digest").distinct().join(reps.select("digest", "rep"), "digest").select("doc_id", "rep"), "near-members")
    # An id that stands on several texts ties their classes together.
    first_rep = member.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).where("a <> z").select("doc_id", "a")
    same_id = first_rep.join(member, "doc_id").where("a <> rep").select("a", F.col("rep").alias("b"))
    # Bands that several classes have, and of each its pivot: the class that stands in the fullest bands is the likeliest to be near all others.
    places = reps.select("rep", F.explode("bands").alias("band"))
    sizes = materialize(places.groupBy("band").agg(F.count("*").alias("size")).where("size > 1"), "near-buckets")
    placed = materialize(join_spread(places, sizes, "band", large_bands := _large(sizes)), "near-placed")
    central = placed.groupBy("rep").agg(F.sum("size").alias("central"))
    by_band = placed.select("band", "rep").join(central, "rep")
    pivots = by_band.groupBy("band").agg(F.max(F.struct("central", (-F.col("rep")).alias("m"), "rep")).alias("p")).select("band", F.col("p.rep").alias("pivot"), F.col("p.central").alias("central"))
    # One row per pivot and member, whatever number of bands they share.
    under = join_spread(placed.select("band", "rep"), pivots, "band", large_bands).where("rep <> pivot").groupBy("pivot", "rep").agg(F.max("central").alias("central"))
    under = materialize(under, "near-pivots")
    discard(sizes, placed)
    hot = hot_keys(under, "pivot")
    stars = under.select(F.col("pivot").alias("a"), F.col("rep").alias("b"), "central")
    stars = materialize(plausible(stars, reps, least).join(stars, ["a", "b"]), "near-stars")
    # Each document first against the most central of its pivots, then what still joins two components.
    first_try = materialize(stars.groupBy("b").agg(F.max_by("a", F.struct("central", "a")).alias("a")).select("a", "b"), "near-first")
    wanted = stars.select(F.col("a").alias("rep")).union(stars.select(F.col("b").alias("rep"))).distinct()
    sets = materialize(full_sets(docs, wanted.join(reps.select("rep", "digest"), "rep"), width, id_col, text_col), "near-sets")
    links = materialize(confirmed(first_try, sets, percent), "near-links")
    roots = components(links)
    rest = _with_roots(_with_roots(stars.join(first_try, ["a", "b"], "left_anti"), roots, "a", "ra", hot), roots, "b", "rb", []).where("ra <> rb").select("a", "b")
    rest = materialize(rest, "near-rest")
    more = materialize(confirmed(rest, sets, percent), "near-links")
    links = links.unionByName(more)
    discard(roots, rest, first_try)
    roots = components(links)
    # Members of one pivot that are still apart: candidates by what they differ in from the pivot.
    top = under.groupBy("rep").agg(F.max_by("pivot", F.struct("central", "pivot")).alias("top"))
    group = _with_roots(_with_roots(under.select("pivot", "rep").join(top, "rep"), roots, "rep", "root", []), roots, "pivot", "own", hot)
    group = materialize(group.withColumn("apart", F.col("root") != F.col("own")), "near-members-of-pivots")
    mixed = group.groupBy("pivot").agg(F.count("*").alias("members"), F.bool_or("apart").alias("any"), (F.bool_or(F.col("top") == F.col("pivot")) | (F.min("top") != F.max("top"))).alias("own_pairs"))
    mixed = mixed.where("members > 1 AND any AND own_pairs").select("pivot", F.lit(True).alias("mixed"))
    mixed = materialize(join_spread(group, mixed, "pivot", hot).select("pivot", "rep", "root", "apart", "top"), "near-mixed")
    hot = hot_keys(mixed, "pivot")
    missing = mixed.select(F.col("pivot").alias("rep")).union(mixed.select("rep")).distinct().join(sets.select("rep"), "rep", "left_anti")
    sets = sets.unionByName(materialize(full_sets(docs, missing.join(reps.select("rep", "digest"), "rep"), width, id_col, text_col), "near-sets"))
    crossing = materialize(crossing_pairs(materialize(differences(mixed, sets, hot), "near-differences"), percent, hot_keys(mixed, "pivot", part=100_000)), "near-crossing")
    late = materialize(plausible(crossing, reps, least), "near-late")
    links = links.unionByName(confirmed(late, sets, percent)).unionByName(same_id)
    discard(roots, group, mixed, under, stars)
    roots = components(links)
    rooted = materialize(_with_roots(reps.select("rep"), roots, "rep", "root", []), "near-roots")
    named = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = join_spread(rooted, named, "root", hot_keys(rooted, "root")).select("rep", "component_id")
    found = member.join(named, "rep").groupBy("doc_id").agg(F.min("component_id").alias("component_id"))
    own = drawn.select("doc_id", F.col("n").alias("n_shingles"), (F.col("n") > 0).alias("_has"))
    out = own.join(found, (own["doc_id"] == found["doc_id"]) & F.col("_has"), "left").select(own["doc_id"], "n_shingles", F.when(F.col("_has"), F.col("component_id")).otherwise(own["doc_id"]).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
