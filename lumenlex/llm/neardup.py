"""MinHash near-dedup with odd sketches.

A document is the set of its distinct word shingles. Equal sets collapse to one node first, the smallest doc_id among
them. A node has MinHash samples, hashed in bands, and an odd sketch: the samples of a one-permutation MinHash (the
least hash in each of ``2 ** BIN_BITS`` ranges) folded into a parity bitmap. The set bits of two sketches' XOR estimate how
many samples differ, and so the similarity, to within a few hundredths where it is high.

Bands are range-partitioned with their nodes and streamed, so a bucket that a third of all nodes share spreads over
ranges; only the runs that touch a range's ends are put together by a table of two rows for each range. Each member
of a bucket first meets the bucket's smallest node. Of those whose sketches do not rule out the wanted similarity, the
likeliest one of each node is confirmed on the full sets. Members of a bucket that then are still in different
components are compared in blocks inside a task: those outside the bucket's largest component against all, sketch
against sketch, and then the sets of all pairs that are not ruled out, unless others have connected the two by then.
A task gets each set that it needs once, and only links leave it, so no link between members of a bucket is lost and
no bucket emits its pairs. Tables that are done with are deleted.

With 32 bands of 5 samples a pair of similarity 0.8 shares no bucket in 3 of a million cases. A sketch rules a pair
out if the estimate lies 4.5 standard deviations below the wanted similarity, which is as rare.

Defined results: a text of fewer words than a shingle has is one shingle; one without words, or NULL, has none and is
linked with nothing. Rows that share a doc_id are one document, linked with all that any of its texts is linked with.
A row with NULL doc_id takes no part: component_id is NULL and it is kept. Other columns are not looked at and may bear
any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenlex.llm.components import components
from lumenlex.shared import Tables, giving_back

WORDS, SIMILARITY, BANDS, ROWS, BIN_BITS, SKETCH_BITS, SEED = 5, 0.8, 32, 5, 12, 2048, 7
#: Nodes of a block of those outside a bucket's largest component, and of a block of all its members.
ASKING, MEMBERS = 1024, 4096
#: Shingles of a side of a task, members for each copy of a star's centre, ids that may be broadcast.
TILE_SHINGLES, STAR, BROADCAST_IDS = 1 << 20, 2048, 1_000_000
DEVIATIONS, CACHED_WORDS = 4.5, 100_000
TAG = 0x7FFFFFFF  # the bits of a band by which a task knows buckets that two nodes share besides its own
_U64 = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U64(31))) * _U64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> _U64(29))) * _U64(0xBF58476D1CE4E5B9)
    return x ^ (x >> _U64(32))


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < CACHED_WORDS:
            self[word] = h
        return h


_HASHES = _Hashes()


def shingles(text: str | None, words: int) -> np.ndarray:
    """The sorted distinct 64-bit hashes of the shingles of the whole text."""
    parts = text.encode().lower().split() if text else []
    if not parts:
        return np.empty(0, _U64)
    hashed = np.fromiter(map(_HASHES.__getitem__, parts), _U64, len(parts))
    n = min(words, len(parts))
    total = np.full(len(parts) - n + 1, n, _U64)
    for i in range(n):
        total = _mix(total + hashed[i : len(parts) - n + 1 + i] * _U64(2 * i + 1))
    return np.unique(total)


class Signer:
    """Bands, odd sketch and number of folded samples of a sorted set of shingles."""

    def __init__(self, bands: int, rows: int, bits: int, seed: int):
        random = np.random.default_rng(seed)
        k = bands * rows
        self.rows, self.bits = rows, bits
        self.a = (random.integers(0, 1 << 32, k, np.uint32) | np.uint32(1))[:, None]
        self.b = random.integers(0, 1 << 32, k, np.uint32)[:, None]
        self.band_slot = random.integers(0, 1 << 62, bands, _U64)

    def sign(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        x = (s ^ (s >> _U64(32))).astype(np.uint32)
        low = np.full(len(self.a), 0xFFFFFFFF, np.uint32)
        for i in range(0, len(x), 2048):
            np.minimum(low, (self.a * x[i : i + 2048] + self.b).min(1), out=low)
        wide, keys = low.astype(_U64), self.band_slot.copy()
        for i in range(self.rows):
            keys = _mix(keys + wide[i :: self.rows])
        # s is sorted, so the first hash of each range of top bits is the least one in it.
        bins = s >> _U64(64 - BIN_BITS)
        least = s[np.r_[True, bins[1:] != bins[:-1]]]
        parity = (np.bincount((_mix(least) % _U64(self.bits)).astype(np.int64), minlength=self.bits) & 1).astype(np.uint8)
        return keys.view(np.int64), np.packbits(parity).view(np.int64), len(least)


def least_common(folded, shingles, similarity: float, bits: int, sqrt, exp):
    """How many samples two sets must be estimated to share at least, from the sums of their samples and their sizes.

    Sets of the wanted similarity have a union of a known size; similarity times the samples of that union is what
    they share on average. DEVIATIONS standard deviations of the sampling and of the parity bits are taken off.
    """
    union, bins = shingles / (1 + similarity), float(1 << BIN_BITS)
    empty = exp(-union / bins)
    samples = folded / 2 * (1 - empty) / (1 - exp(-shingles / 2 / bins))  # as full as these sets' own ranges are
    differ = folded - 2 * similarity * samples
    differ = (differ + abs_(differ)) / 2 + 1
    kept = exp(-4 * differ / bits)
    parity = (bits / 4 * (1 - kept) - differ * kept) / kept
    filled = bins * (empty - (1 + union / bins) * empty * empty)  # variance of the number of ranges that hold a hash
    sampling = similarity * (1 - similarity) * samples * (1.02 - (1 - empty) * bins / union) + similarity**2 * filled / 4
    return similarity * samples - DEVIATIONS * sqrt(sampling + parity / 4) - 1


def abs_(x):
    return F.abs(x) if isinstance(x, Column) else np.abs(x)


def signatures(docs: DataFrame, words: int, bands: int, rows: int, bits: int, seed: int) -> DataFrame:
    """doc_id, n_shingles, set_a, set_b, bands, sketch, folded; the last four NULL for a document without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = Signer(bands, rows, bits, seed)
        for b in batches:
            out: list[tuple] = []
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
                s = shingles(text.as_py(), words)
                if not len(s):
                    out.append((doc_id, 0, doc_id, None, None, None, None))
                    continue
                both = xxhash.xxh3_128_digest(s.tobytes())
                out.append((doc_id, len(s), *np.frombuffer(both, np.int64).tolist(), *signer.sign(s)))
            if out:
                kinds = [*[pa.int64()] * 4, *[pa.list_(pa.int64())] * 2, pa.int32()]
                names = ["doc_id", "n_shingles", "set_a", "set_b", "bands", "sketch", "folded"]
                columns = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    numbers = "doc_id long, n_shingles long, set_a long, set_b long"
    return docs.mapInArrow(giving_back(run), f"{numbers}, bands array<long>, sketch array<long>, folded int")


def shingle_sets(docs: DataFrame, words: int) -> DataFrame:
    """node (the doc_id), set_a, set: the full sets of shingle hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 256):
                texts = b.column("text").slice(i, 256)
                sets = [shingles(t.as_py(), words).view(np.int64) for t in texts]
                names = [int.from_bytes(xxhash.xxh3_128_digest(x.tobytes())[:8], "little", signed=True) for x in sets]
                columns = [b.column("doc_id").slice(i, 256), pa.array(names, pa.int64()), pa.array(sets, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, names=["node", "set_a", "set"])

    return docs.mapInArrow(giving_back(run), "node long, set_a long, set array<long>")


def among(rows: DataFrame, column: str, ids: DataFrame, how: str, most: int | None = None) -> DataFrame:
    """Rows whose column is (``left_semi``) or is not (``left_anti``) one of ids, a table of that one distinct column.

    Few ids, counted, are broadcast, so that texts stay where they are; more meet them in a shuffle.
    """
    few = ids.limit((most if most is not None else BROADCAST_IDS) + 1)
    small = few.count() <= (most if most is not None else BROADCAST_IDS)
    return rows.join(F.broadcast(ids) if small else ids, column, how)


def buckets(nodes: DataFrame, tables: Tables) -> DataFrame:
    """band, node, least, n of every node that shares a band with another: the least of them, and how many there are."""
    n = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = nodes.select(F.explode("bands").alias("band"), "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_band, parts, first = 0, [], True

        def closed(bands: np.ndarray, nodes: np.ndarray, start: np.ndarray, edge: np.ndarray) -> pa.RecordBatch:
            size = np.diff(np.r_[start, len(bands)])
            keep = np.repeat((size > 1) | edge, size)
            columns = [bands, nodes, np.repeat(nodes[start], size), np.repeat(size, size), np.repeat(edge, size)]
            return pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in columns], names=["band", "node", "least", "n", "edge"])

        for b in batches:
            if not b.num_rows:
                continue
            band, node = b.column("band").to_numpy(), b.column("node").to_numpy()
            start = np.flatnonzero(np.r_[True, band[1:] != band[:-1]])
            if parts and band[0] == open_band and len(start) == 1:
                parts.append(node)
                continue
            if parts:
                end = start[1] if band[0] == open_band else 0
                nodes = np.concatenate([*parts, node[:end]])
                yield closed(np.full(len(nodes), open_band), nodes, np.zeros(1, np.int64), np.array([first]))
                band, node, first = band[end:], node[end:], False
                start = np.flatnonzero(np.r_[True, band[1:] != band[:-1]])
            if len(start) > 1:
                edge = np.zeros(len(start) - 1, bool)
                edge[0] = first
                yield closed(band[: start[-1]], node[: start[-1]], start[:-1], edge)
                first = False
            open_band, parts = int(band[-1]), [node[start[-1] :]]
        if parts:
            nodes = np.concatenate(parts)
            yield closed(np.full(len(nodes), open_band), nodes, np.zeros(1, np.int64), np.array([True]))

    ranged = rows.repartitionByRange(n, "band", "node").sortWithinPartitions("band", "node")
    runs = tables.write(ranged.mapInArrow(giving_back(run), "band long, node long, least long, n long, edge boolean"), "runs")
    # At most two bands for each range: its size is that of the number of partitions, whatever the input.
    ends = runs.where("edge").groupBy("band").agg(F.min("least").alias("least_"), F.count(F.lit(1)).alias("n_"))
    whole = runs.join(F.broadcast(ends), "band", "left")
    whole = whole.select("band", "node", F.coalesce("least_", "least").alias("least"), F.coalesce("n_", "n").alias("n"))
    held = tables.write(whole.where("n > 1"), "held")
    tables.drop(runs)
    return held


def salted(node: Column, n: Column, per: int) -> tuple[Column, Column]:
    """Which of ceil(n / per) copies of a row a node meets, and the copies of that row."""
    copies = F.ceil(n / per).cast("int")
    return F.pmod(F.xxhash64(F.lit(SEED), node), copies).cast("int"), F.explode(F.sequence(F.lit(0), copies - 1))


def alike(stars: DataFrame, sketches: DataFrame, similarity: float, bits: int) -> DataFrame:
    """u, v, tile, weight, margin of the stars (u, v, n) whose odd sketches do not rule out the similarity.

    A centre v is sent once for each STAR members. sketches: node, sketch, folded, n_shingles.
    """
    salt, copies = salted(F.col("u"), F.col("n"), STAR)
    centres = stars.groupBy("v").agg(F.max("n").alias("n")).select("v", copies.alias("salt"))
    facts = sketches.select("node", "sketch", "folded", "n_shingles")
    centres = centres.join(facts.toDF("v", "sv", "cv", "hv"), "v")
    both = stars.withColumn("salt", salt).join(facts.toDF("u", "su", "cu", "hu"), "u").join(centres, ["v", "salt"])
    bits_set = F.zip_with("su", "sv", lambda a, b: F.bit_count(a.bitwiseXOR(b)))
    left = 1 - 2 * F.aggregate(bits_set, F.lit(0), lambda total, x: total + x) / bits
    common = (F.col("cu") + F.col("cv") + bits / 2 * F.log(left)) / 2
    needed = least_common(F.col("cu") + F.col("cv"), F.col("hu") + F.col("hv"), similarity, bits, F.sqrt, F.exp)
    tile = F.xxhash64("v", "salt").alias("tile")
    near = both.where(left > 0).select("u", "v", tile, F.col("hu").alias("weight"), (common - needed).alias("margin"))
    return near.where("margin >= 0")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v, tile, weight) whose full sets are similar enough: 100 * intersection >= percent * union.

    Tiles are gathered in groups of about TILE_SHINGLES shingles, and a group gets each set that it needs once.
    """
    weight = pairs.agg(F.sum("weight")).first()[0] or 0
    groups = max(1, int(weight) // TILE_SHINGLES)
    keyed = pairs.select("u", "v", F.pmod(F.xxhash64("tile"), F.lit(groups)).alias("g"))
    need = keyed.select(F.col("g").alias("h"), F.explode(F.array("u", "v")).alias("node")).distinct().join(sets, "node")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        held: dict[int, list[np.ndarray]] = {}
        for node, s in zip(right.column("node").to_pylist(), right.column("set"), strict=True):
            held.setdefault(node, []).append(s.values.to_numpy().view(_U64))
        u, v = left.column("u").to_pylist(), left.column("v").to_pylist()
        found = [any(similar(x, y, percent) for x in held[a] for y in held[b]) for a, b in zip(u, v, strict=True)]
        return left.select(["u", "v"]).filter(pa.array(found, pa.bool_()))

    return keyed.groupBy("g").cogroup(need.groupBy("h")).applyInArrow(run, "u long, v long")


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if 100 * len(a) < percent * len(b):
        return False
    both = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


class Tile:
    """Members of a bucket in one task: those that ask, the others, and which of them the sketches let be similar."""

    def __init__(self, columns: dict[str, np.ndarray], similarity: float, bits: int):
        self.__dict__.update(columns)
        self.slot = int(np.flatnonzero(self.tags[0] == int(self.band[0]) & TAG)[0])
        self.similarity, self.bits = similarity, bits
        self.asking, self.others = np.flatnonzero(self.asks), np.flatnonzero(~self.asks)

    def near(self, x: int) -> np.ndarray:
        """Rows of other components that the sketches do not rule out, likeliest first; pairs of an earlier bucket are its own."""
        y, size, least = self.others, self.n_shingles, self.similarity
        fits = (self.component[y] != self.component[x]) & (np.minimum(size[y], size[x]) >= least * np.maximum(size[y], size[x]) - 1e-6)
        y = y[fits & ~(self.both_ask[y] & (self.node[y] > self.node[x]))]
        y = y[~(self.tags[y, : self.slot] == self.tags[x, : self.slot]).any(1)]
        left = 1 - 2 * np.bitwise_count(self.sketch[y] ^ self.sketch[x]).sum(1) / self.bits
        folded = self.folded[y] + self.folded[x]
        common = (folded + self.bits / 2 * np.log(np.maximum(left, 1e-12))) / 2
        margin = common - least_common(folded, size[y] + size[x], least, self.bits, np.sqrt, np.exp)
        keep = np.flatnonzero((left > 0) & (margin >= 0))
        return y[keep[np.lexsort((self.node[y[keep]], -margin[keep]))]]

    def needed(self) -> np.ndarray:
        """Whether each row stands in any such pair."""
        wanted = np.zeros(len(self.node), bool)
        for x in self.asking.tolist():
            y = self.near(x)
            wanted[y] = True
            wanted[x] = len(y) > 0
        return wanted

    def links(self, sets: list[np.ndarray], percent: int) -> Iterator[tuple[int, int]]:
        """Similar pairs that connect the components here; a pair already connected by others is not tested."""
        root: dict[int, int] = {}

        def find(c: int) -> int:
            while (up := root.get(c, c)) != c:
                root[c] = root.get(up, up)
                c = up
            return c

        for x in self.asking.tolist():
            for y in self.near(x).tolist():
                one, two = find(int(self.component[x])), find(int(self.component[y]))
                if one != two and similar(sets[x], sets[y], percent):
                    root[max(one, two)] = min(one, two)
                    yield int(self.node[x]), int(self.node[y])


def tiles(group: pa.Table, similarity: float, bits: int) -> Iterator[tuple[slice, Tile]]:
    """The tiles of a sorted group, and where in it they are."""
    names = ("band", "i", "j", "asks", "both_ask", "node", "component", "folded", "n_shingles")
    columns = {name: group.column(name).to_numpy(zero_copy_only=False) for name in names}
    for name, kind in (("sketch", _U64), ("tags", np.int32)):
        flat = group.column(name).combine_chunks().flatten().to_numpy(zero_copy_only=False)
        columns[name] = flat.view(kind).reshape(group.num_rows, -1)
    new = np.ones(group.num_rows, bool)
    new[1:] = np.any([columns[c][1:] != columns[c][:-1] for c in ("band", "i", "j")], axis=0)
    start = np.flatnonzero(new)
    for low, high in zip(start.tolist(), [*start[1:].tolist(), group.num_rows], strict=True):
        here = slice(low, high)
        yield here, Tile({name: c[here] for name, c in columns.items()}, similarity, bits)


TILE = "band long, i int, j int, asks boolean, both_ask boolean"
FACTS = "node long, component long, set_a long, sketch array<long>, tags array<int>, folded int, n_shingles long"


def cross_links(
    held: DataFrame, found: DataFrame, sketches: DataFrame, sets: DataFrame, tables: Tables, similarity: float, bits: int
) -> DataFrame:
    """u, v: similar members of a bucket that connect its components.

    Those outside a bucket's largest component ask, in blocks, all its members, in others; both sides of a task hold a
    bounded number of nodes and of shingles. A first pass tells which members of a task's blocks need their sets there.
    """
    named = held.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    named = named.join(sketches.select("node", "n_shingles"), "node")
    named = tables.write(named.select("band", "node", "n", "component", "n_shingles"), "named")
    counts = (F.count(F.lit(1)).alias("size"), F.sum("n_shingles").alias("weight"), F.max("n").alias("n"))
    sizes = named.groupBy("band", "component").agg(*counts)
    largest = F.max_by("component", F.struct("size", -F.col("component"))).alias("largest")
    per_band = sizes.groupBy("band").agg(
        largest,
        F.max("n").alias("n"),
        F.sum("weight").alias("weight"),
        F.sum("size").alias("size"),
        (F.sum("size") - F.max("size")).alias("asking"),
    )
    share = F.col("weight") / TILE_SHINGLES
    mine = F.ceil(F.greatest(F.col("asking") / ASKING, share * F.col("asking") / F.col("size"))).cast("int")
    theirs = F.ceil(F.greatest(F.col("size") / MEMBERS, share)).cast("int")
    salt, copies = salted(F.col("node"), F.col("n"), MEMBERS)
    open_ = per_band.where("asking > 0").select("band", "largest", mine.alias("mine"), theirs.alias("theirs"), copies.alias("salt"))
    members = named.drop("n_shingles").distinct().withColumn("salt", salt).join(open_, ["band", "salt"]).join(sketches, "node")
    members = members.withColumn("both_ask", F.col("component") != F.col("largest"))
    block = lambda blocks: F.pmod(F.xxhash64(F.lit(SEED + 1), "node"), F.col(blocks)).cast("int")
    each = lambda blocks: F.explode(F.sequence(F.lit(0), F.col(blocks) - 1))
    facts = [c.split()[0] for c in FACTS.split(", ")]
    asks = members.where("both_ask").withColumns({"i": block("mine"), "asks": F.lit(True)}).withColumn("j", each("theirs"))
    others = members.withColumns({"j": block("theirs"), "asks": F.lit(False)}).withColumn("i", each("mine"))
    columns = ["band", "i", "j", "asks", "both_ask", *facts, "mine", "theirs"]

    order = [(c, "ascending") for c in ("band", "i", "j", "node", "set_a", "asks")]

    def needed(group: pa.Table) -> pa.Table:
        group = group.sort_by(order)
        wanted = [tile.needed() for _, tile in tiles(group, similarity, bits)]
        return group.filter(pa.array(np.concatenate(wanted)))

    def linking(group: pa.Table) -> pa.Table:
        group = group.sort_by(order)
        sets = [x.values.to_numpy().view(_U64) for x in group.column("set")]
        found = [pair for at, tile in tiles(group, similarity, bits) for pair in tile.links(sets[at], round(100 * similarity))]
        return pa.table({c: pa.array([pair[k] for pair in found], pa.int64()) for k, c in enumerate("uv")})

    # Buckets of one tile go by many to a group of about as many nodes and shingles as a block has.
    row = per_band.where("asking > 0").agg(F.sum("size"), F.sum("weight")).first()
    groups = max(1, (row[0] or 0) // MEMBERS, (row[1] or 0) // TILE_SHINGLES)
    whole_bucket = (F.col("mine") == 1) & (F.col("theirs") == 1)
    group = F.when(whole_bucket, F.pmod(F.xxhash64("band"), F.lit(groups))).otherwise(F.xxhash64("band", "i", "j")).alias("g")
    both = asks.select(columns).unionByName(others.select(columns)).select("*", group).drop("mine", "theirs")
    need = tables.write(both.groupBy("g").applyInArrow(needed, f"{TILE}, {FACTS}, g long"), "need")
    whole = need.join(sets, ["node", "set_a"])
    links = tables.write(whole.groupBy("g").applyInArrow(linking, "u long, v long").distinct(), "links")
    tables.drop(named, need)
    return links


def linked(
    docs: DataFrame,
    words: int = WORDS,
    similarity: float = SIMILARITY,
    bands: int = BANDS,
    rows: int = ROWS,
    bits: int = SKETCH_BITS,
    seed: int = SEED,
) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs."""
    percent, tables = round(100 * similarity), Tables(docs.sparkSession)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = tables.write(signatures(slim, words, bands, rows, bits, seed), "signed")
    usable = signed.where(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
    kept = [F.first(c).alias(c) for c in ("bands", "sketch", "folded", "n_shingles")]
    nodes = tables.write(usable.groupBy("set_a", "set_b").agg(F.min("doc_id").alias("node"), *kept), "nodes")
    held = buckets(nodes, tables)
    wanted = tables.write(held.select("node").distinct(), "wanted")
    tags = F.transform("bands", lambda x: x.bitwiseAND(F.lit(TAG)).cast("int")).alias("tags")
    facts = among(nodes, "node", wanted, "left_semi").select("node", "set_a", "sketch", tags, "folded", "n_shingles")
    sketches = tables.write(facts, "sketches")
    # The full sets of every node that is in any bucket with another.
    texts = among(slim, "doc_id", wanted.withColumnRenamed("node", "doc_id"), "left_semi")
    sets = tables.write(shingle_sets(texts, words), "sets")
    stars = held.where("node <> least").groupBy(F.col("node").alias("u"), F.col("least").alias("v")).agg(F.max("n").alias("n"))
    stars = tables.write(stars, "stars")
    likeliest = F.max_by(F.struct("v", "tile", "weight"), F.struct("margin", -F.col("v"))).alias("best")
    best = alike(stars, sketches, similarity, bits).groupBy("u").agg(likeliest).select("u", "best.*")
    best = tables.write(best, "pairs")
    links = tables.write(confirmed(best, sets, percent), "links")
    found = components(links, tables)
    tables.drop(stars, best, links)
    more = cross_links(held, found, sketches, sets, tables, similarity, bits)
    if not more.isEmpty():
        before = found
        known = before.select(F.col("node").alias("u"), F.col("component").alias("v"))
        found = components(known.unionByName(more), tables)
        tables.drop(before)
    tables.drop(more, held, wanted, sketches, sets)
    named = nodes.select("set_a", "set_b", "node").join(found, "node", "left")
    final = named.select("set_a", "set_b", F.coalesce("component", "node").alias("component"))
    out = signed.select("doc_id", "n_shingles", "set_a", "set_b").join(final, ["set_a", "set_b"], "left")
    return out.select(
        "doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id")
    )


def dedup_documents(docs: DataFrame, **parameters) -> DataFrame:
    """The rows of docs whose document is the smallest of its component."""
    lost = linked(docs, **parameters).where(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct()
    lost = Tables(docs.sparkSession).write(lost, "lost")
    whole = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.struct("*").alias("row"))
    return among(whole, "doc_id", lost, "left_anti").select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: doc_id, n_shingles, component_id, kept for every document, over sets of 4-word shingles."""
    found = linked(spark.read.parquet(f"{sf_dir}/documents.parquet"), words=4)
    return found.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


ORACLE = """WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
  ELSE list_distinct(list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' '))) END AS sh FROM w),
e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
ids AS (SELECT g, row_number() OVER () AS gid FROM (SELECT g FROM e GROUP BY g HAVING count(*) > 1)),
x AS (SELECT e.doc_id, e.n, ids.gid FROM e JOIN ids USING (g)),
p AS (SELECT a.doc_id AS u, b.doc_id AS v FROM x a JOIN x b ON a.gid = b.gid AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
sym AS (SELECT u, v FROM p UNION ALL SELECT v, u FROM p),
reach AS (SELECT doc_id AS u, doc_id AS v FROM documents UNION SELECT r.u, b.v FROM reach r JOIN sym b ON r.v = b.u)
SELECT s.doc_id, len(s.sh) AS n_shingles, min(r.v) AS component_id, s.doc_id = min(r.v) AS kept
FROM s JOIN reach r ON r.u = s.doc_id GROUP BY s.doc_id, s.sh"""
