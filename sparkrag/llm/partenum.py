"""Jaccard join on word shingles by PartEnum signatures.

Sets of one size band can only be similar enough if they differ in few elements: with J >= 0.8 at most k = (a + b) // 9 of
them. A hash deals the shingle domain into G groups of CELLS = 3 partitions, and of each group every subset of two partitions is
enumerated: a signature is the hash of (band, group, partition left out, elements in the other two), if they hold any. Two similar sets
that differ in at most one partition of some group hold exactly the same elements in two partitions of it; with 2 G > k there is such a group,
so similar sets share a signature. A group costs three signatures for two differing elements, each over twice as many elements as
one partition each would give.

Empty partitions weaken this: a group whose elements fill two or three of its partitions stands two differing elements, one that
fills a single partition one, an empty one none. A set whose groups stand no more than k in all has too few; G has a
slack that makes such sets rarer than one in a million, and where one occurs its whole band is signed again with four times the groups.

Bands grow by 1/0.8. A set of size n signs its own band, and the next one if a set of that band can still be similar to it, so every
pair meets in the band of its larger set. Sets of up to three elements are only similar if equal, and have no signatures.

From signatures to classes, linear in the signatures:
1. Equal sets are one node. Within a block of rows and then over all blocks the signatures of a single node go; a hot
   signature sends one row a block to its task.
2. Similar sets share not one but at least t signatures in a band: those that are left when k differing elements fall where they
   spoil most (the first in a group spoils two, the second the third). So a node with fewer shared ones than its t has no partner there, and of the others the last t - 1 in order of
   the signature can go: the first common signature of a similar pair stays with both.
3. What remains forms a star a signature around its least node. Pairs of node and centre are held against size and a parity sketch
   (whose distance never exceeds the true one). Of those that pass each node is compared with the centre it shares most signatures with, then
   with its other centres where the classes still differ. Comparisons rebuild both shingle sets from the whole texts.
4. Signatures whose nodes are still in several classes: all pairs of nodes of different classes are held against the
   sketch in cells of at most `cell` x `cell` nodes, and the pairs that pass are compared,
   a growing number a round until none is left. So no link between different texts is lost, and no pairs are listed
   within a class.
Classes are connected components by star contraction over checkpointed tables.

Shingles and nodes are 64-bit hashes; nodes are told apart by hash and size.

Defined results: null or empty text, or text of blanks, has the empty set, is linked with nothing and is its own class; fewer than five words
are one shingle; rows that repeat a doc_id each come out; rows with null doc_id are classes of null; an empty table gives an empty result; other
columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkrag.llm.common import blocks, byte_codes, first_of_runs, mix64, run_hashes, stored, text_bytes

U = np.uint64
WIDTH = 5
SKETCH = 1024  # bits
_CODES = byte_codes(23)
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_STEP = [U(x) for x in (0x9E6C63D0876A9A35, 0xC4CEB9FE1A85EC53, 0xD1B54A32D192ED03, 0x8CB92BA72F3D8DD7, 0xAEF17502108EF2D9)]


def shingle_sets(col: pa.Array) -> list[np.ndarray]:
    """Each text's distinct 64-bit shingle hashes, sorted."""
    data, o = text_bytes(col)
    n = len(o) - 1
    if not len(data):
        return [np.zeros(0, U)] * n
    inside = ~_BLANK[data]
    starts = first_of_runs(inside, o)
    words = run_hashes(_FOLD[data], starts, inside, _CODES)
    at = np.searchsorted(starts, o)
    m = len(words)
    grams = np.zeros(max(0, m - WIDTH + 1), U)
    for k in range(WIDTH if m >= WIDTH else 0):
        grams += words[k : m - WIDTH + 1 + k] * _STEP[k]
    grams = mix64(grams)
    out = []
    for i in range(n):
        a, b = at[i], at[i + 1]
        if b - a >= WIDTH:
            s = np.sort(grams[a : b - WIDTH + 1])
            keep = np.ones(len(s), bool)
            keep[1:] = s[1:] != s[:-1]
            out.append(s[keep])
        elif b > a:
            h = U(b - a)
            with np.errstate(over="ignore"):
                for w in words[a:b]:
                    h = mix64(np.array([h * _STEP[0] + w]))[0]
            out.append(np.array([h], U))
        else:
            out.append(np.zeros(0, U))
    return out


def set_id(s: np.ndarray) -> int:
    """A signed 64-bit name of a set."""
    v = mix64(mix64(s + U(0x5851F42D4C957F2D)).sum(dtype=U) + U(len(s)).reshape(1))
    return int(v.view(np.int64)[0])


def band_edges() -> np.ndarray:
    """Largest sizes of the bands: each holds the sizes up to 1/0.8 of its least."""
    edges, low = [], 1
    while low < 1 << 40:
        edges.append(low * 5 // 4)
        low = edges[-1] + 1
    return np.array(edges)


_EDGES = band_edges()


def bands_of(n: int) -> list[int]:
    """The band of size n, and the next if it holds a size that n can be similar to; none where only equal sets are similar."""
    if n < 4:
        return []
    b = int(np.searchsorted(_EDGES, n))
    return [b, b + 1] if (int(_EDGES[b]) + 1) * 4 <= n * 5 else [b]


CELLS = 3  # partitions of a group; each subset of CELLS - 1 of them is a signature
#: Groups of the bands of the smallest sets, by the largest size, which need more lest all elements fall into one.
_FEW = {5: 64, 7: 12, 10: 10, 13: 7, 17: 7, 22: 7}


def groups(band: int, level: int) -> int:
    most = int(_EDGES[band])
    enough = 2 * most // 9 // 2 + 1
    return _FEW.get(most, enough + 3 + most // 500) << 2 * level


def most_differing(n: int, band: int) -> int:
    """How many elements a set of size n and a similar one of the band's pairs can differ in."""
    other = min(int(_EDGES[band]), n * 5 // 4)
    return (n + other) // 9


def signatures(s: np.ndarray, band: int, level: int = 0) -> tuple[np.ndarray, int] | None:
    """The set's signatures in a band and how many of them a similar set has at least; None where its groups stand too little."""
    g = groups(band, level)
    h = mix64(s ^ U(band * 64 + level + 1))
    cell = (((h >> U(32)) * U(CELLS * g)) >> U(32)).astype(np.int64)
    order = np.argsort(cell, kind="stable")
    cell, h = cell[order], h[order]
    first = np.ones(len(cell), bool)
    first[1:] = cell[1:] != cell[:-1]
    at = np.flatnonzero(first)
    held = np.zeros(CELLS * g, U)
    held[cell[at]] = mix64(np.add.reduceat(mix64(h + U(77)), at) + U(band)) | U(1)
    held = held.reshape(g, CELLS)
    filled = (held != 0).sum(axis=1)
    full, half, k = int((filled > 1).sum()), int((filled == 1).sum()), most_differing(len(s), band)
    if 2 * full + half <= k:
        return None
    # what k differing elements leave: the first in a group spoils two signatures, a second one the third
    least = 3 * full + 2 * half - 2 * min(k, full + half) - max(0, k - full - half)
    a, b = held[:, [1, 0, 0]], held[:, [2, 2, 1]]
    named = np.arange(CELLS * g, dtype=U).reshape(g, CELLS)
    v = mix64(a * _STEP[1] + b * _STEP[2] + named * _STEP[3])
    return v[(a != 0) | (b != 0)], least


def sketch(s: np.ndarray) -> np.ndarray:
    """Parity of the elements that fall on each of SKETCH bits: differing bits never exceed differing elements."""
    c = np.bincount((s % U(SKETCH)).astype(np.int64), minlength=SKETCH) & 1
    return np.packbits(c.astype(np.uint8))


def need(least: int, band: int, level: int) -> int:
    """The least number of its signatures that a set shares with a similar one, with band and level, in one number."""
    return least << 20 | band << 8 | level


def _slim(docs: DataFrame) -> DataFrame:
    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")


def sets_of(docs: DataFrame) -> DataFrame:
    """doc_id, n (distinct shingles), node (name of the set), sketch."""

    def run(batches):
        for b in blocks(batches, "text", 2 << 20):
            sets = shingle_sets(b.column(1))
            yield pa.record_batch([b.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([set_id(s) if len(s) else None for s in sets], pa.int64()), pa.array([sketch(s).tobytes() if len(s) else None for s in sets], pa.binary())], names=["doc_id", "n", "node", "sketch"])

    return _slim(docs).mapInArrow(run, "doc_id long, n long, node long, sketch binary")


_PACKETS = "bucket int, kind int, block long, data binary"
OWN, KNOWN, NAMES, THIN = range(4)  # kinds of packets


def _packets(sig: list, nodes: list, needs: list, buckets: int):
    """Batches (bucket, kind, block, data) of a block's signatures, a list a node.

    A block numbers its nodes and is named by them. OWN packets have a signature's first node in the block and whether there are
    more, 10 bytes each, and go to the signature's bucket; KNOWN packets have the other nodes of signatures, NAMES the nodes and what they need.
    A signature is its bucket and 44 bits; two that fall together are only compared in vain.
    """
    v, t = np.array(nodes, np.int64), np.array(needs, np.int64)
    block = int(mix64(mix64(v.view(U) ^ mix64(t.view(U) + np.arange(len(v), dtype=U) * _STEP[1])).sum(dtype=U).reshape(1)).view(np.int64)[0])
    idx = np.repeat(np.arange(len(v), dtype=np.uint32), [len(x) for x in sig])
    g = np.concatenate(sig)
    g = (((g >> U(32)) * U(buckets) >> U(32)) << U(44)) | (g & U((1 << 44) - 1))
    order = np.argsort(g, kind="stable")
    g, idx = g[order], idx[order]
    first = np.ones(len(g), bool)
    first[1:] = g[1:] != g[:-1]
    more = np.zeros(len(g), bool)
    more[:-1] = ~first[1:]
    out = []
    og, oi, om = g[first], idx[first], more[first]
    to = (og >> U(44)).astype(np.int64)
    edges = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1], [True]]))
    words = og.view(np.uint16).reshape(-1, 4)
    high = ((oi >> 16) | (om.astype(np.uint32) << 15)).astype(np.uint16)
    planes = [words[:, 0], words[:, 1], words[:, 2] & np.uint16(0x0FFF), oi.astype(np.uint16), high]
    for x, y in zip(edges[:-1], edges[1:]):
        out.append((int(to[x]), OWN, block, b"".join(w[x:y].tobytes() for w in planes)))
    rest = np.flatnonzero(~first)
    for n, x in enumerate(range(0, len(rest), 1 << 14)):
        r = rest[x : x + (1 << 14)]
        out.append(((block + n) % buckets, KNOWN, block, g[r].tobytes() + idx[r].tobytes()))
    out.append((block % buckets, NAMES, block, v.tobytes() + t.tobytes()))
    for x in range(0, len(out), 4096):
        c = list(zip(*out[x : x + 4096]))
        yield pa.record_batch([pa.array(c[0], pa.int32()), pa.array(c[1], pa.int32()), pa.array(c[2], pa.int64()), pa.array(c[3], pa.binary())], names=["bucket", "kind", "block", "data"])


def bucket_count(docs: DataFrame, bytes_each: int = 8 << 20) -> int:
    """Buckets of signatures: by the size of the table that the planner states, so that one of them fits in a task's memory at any size;
    at least two a shuffle partition, at most 2^19. Where the planner knows no size (over 2^50 bytes) two a shuffle partition it is."""
    size = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    size = size if size < 1 << 50 else 0
    return min(1 << 19, max(2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // bytes_each))


def signature_rows(docs: DataFrame, levels: dict[int, int] | None = None, block_bytes: int = 3 << 20) -> DataFrame:
    """Packets of the signatures of all sets; with levels, of the bands named there only, at these levels.

    A THIN packet names bands with a set whose groups stand too little.
    """
    buckets = bucket_count(docs)

    def run(batches):
        for b in blocks(batches, "text", block_bytes):
            seen, sig, nodes, needs, thin = set(), [], [], [], set()
            for s in shingle_sets(b.column(1)):
                if len(s):
                    k = set_id(s)
                    if k in seen:
                        continue
                    seen.add(k)
                    for band in bands_of(len(s)):
                        if levels is not None and band not in levels:
                            continue
                        level = 0 if levels is None else levels[band]
                        got = signatures(s, band, level)
                        if got is None:
                            thin.add(band)
                        else:
                            sig.append(got[0])
                            nodes.append(k)
                            needs.append(need(got[1], band, level))
            if thin and levels is not None:
                raise RuntimeError("a set's groups stand too little at its band's level")
            if thin:
                yield pa.record_batch([pa.array([0], pa.int32()), pa.array([THIN], pa.int32()), pa.array([0], pa.int64()), pa.array([np.array(sorted(thin), np.int64).tobytes()], pa.binary())], names=["bucket", "kind", "block", "data"])
            if sig:
                yield from _packets(sig, nodes, needs, buckets)

    return _slim(docs).mapInArrow(run, _PACKETS)


def thin_levels(docs: DataFrame, bands: set[int]) -> dict[int, int]:
    """The levels at which the groups of every set of the bands stand enough."""

    def run(batches):
        need: dict[int, int] = {}
        for b in blocks(batches, "text", 2 << 20):
            for s in shingle_sets(b.column(1)):
                for band in bands_of(len(s)) if len(s) else ():
                    if band in bands:
                        level = 1
                        while signatures(s, band, level) is None:
                            level += 1
                        need[band] = max(need.get(band, 1), level)
        yield pa.record_batch([pa.array(list(need), pa.int32()), pa.array(list(need.values()), pa.int32())], names=["band", "level"])

    return {r.band: r.level for r in _slim(docs).mapInArrow(run, "band int, level int").groupBy("band").agg(F.max("level").alias("level")).collect()}


def shared(packets: DataFrame) -> DataFrame:
    """(kind, sig, block, idx, node, need): KNOWN rows (sig, block, idx) of the signatures that several nodes have, NAMES rows
    (block, idx, node, need), THIN rows (node: a band).

    Only a block's first node of a signature goes to the signature's bucket; the others are known to share it and go anywhere. A task holds
    one bucket at a time, whose size does not grow with the table (`bucket_count`).
    """
    names = ["kind", "sig", "block", "idx", "node", "need"]

    def out(kind, n, **given):
        for at in range(0, n, 1 << 16):
            e = min(n, at + (1 << 16))
            kinds = {"kind": pa.int32(), "idx": pa.int32()}
            cols = [pa.array(given[k][at:e], kinds.get(k, pa.int64())) if k in given else pa.nulls(e - at, kinds.get(k, pa.int64())) for k in names[1:]]
            yield pa.record_batch([pa.array(np.full(e - at, kind, np.int32)), *cols], names=names)

    def own(held):
        g, v, i, k = (np.concatenate(x) for x in zip(*held))
        order = np.argsort(g, kind="stable")
        g = g[order]
        first = np.ones(len(g), bool)
        first[1:] = g[1:] != g[:-1]
        of = np.cumsum(first) - 1
        keep = ((np.bincount(of) > 1) | (np.bincount(of, k[order]) > 0))[of]
        order = order[keep]
        yield from out(KNOWN, len(order), sig=g[keep], block=v[order], idx=i[order])

    def run(batches):
        held, at = [], None  # the packets of one bucket
        for b in blocks(batches, "data", 8 << 20):
            for to, kind, block, data in zip(*(x.to_pylist() for x in b.columns)):
                if to != at and held:
                    yield from own(held)
                    held = []
                at = to
                if kind == OWN:
                    n = len(data) // 10
                    w = np.frombuffer(data, np.uint16).reshape(5, n).astype(np.int64)
                    held.append((w[0] | w[1] << 16 | w[2] << 32 | to << 44, np.full(n, block), (w[3] | (w[4] & 0x7FFF) << 16).astype(np.int32), w[4] >> 15 > 0))
                elif kind == KNOWN:
                    n = len(data) // 12
                    yield from out(KNOWN, n, sig=np.frombuffer(data, np.int64, n), block=np.full(n, block), idx=np.frombuffer(data, np.int32, n, 8 * n))
                elif kind == NAMES:
                    n = len(data) // 16
                    v = np.frombuffer(data, np.int64).reshape(2, n)
                    yield from out(NAMES, n, block=np.full(n, block), idx=np.arange(n, dtype=np.int32), node=v[0], need=v[1])
                else:
                    v = np.frombuffer(data, np.int64)
                    yield from out(THIN, len(v), node=v)
        if held:
            yield from own(held)

    return packets.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "kind int, sig long, block long, idx int, node long, need long")


def members_of(found: DataFrame) -> DataFrame:
    """(sig, node): of each node and band the signatures without the last t - 1, none where fewer than t are shared."""
    t = F.shiftright("need", 20).cast("int")
    names = found.where(F.col("kind") == NAMES).select("block", "idx", "node", "need").distinct()
    rows = found.where(F.col("kind") == KNOWN).select("sig", "block", "idx").join(names, ["block", "idx"], "left")
    rows = rows.select("sig", F.when(F.col("node").isNull(), F.raise_error(F.lit("a block without names")).cast("long")).otherwise(F.col("node")).alias("node"), "need")
    per = rows.groupBy("node", "need").agg(F.collect_set("sig").alias("sigs"))
    return per.where(F.size("sigs") >= t).select("node", F.explode(F.slice(F.array_sort("sigs"), F.lit(1), F.size("sigs") - t + 1)).alias("sig")).select("sig", "node")


def screened(pairs: DataFrame, drawn: DataFrame) -> DataFrame:
    """The pairs (a, b, w) whose sizes and sketches allow a similarity of 0.8 or more."""

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            na, nb = b.column(3).to_numpy(), b.column(4).to_numpy()
            sa, sb = (text_bytes(b.column(k))[0].view(U).reshape(b.num_rows, -1) for k in (5, 6))
            most = (na + nb) // 9
            ok = (np.abs(na - nb) <= most) & (np.bitwise_count(sa ^ sb).sum(axis=1) <= most)
            yield b.select(["a", "b", "w"]).filter(pa.array(ok))

    for k in "ab":
        pairs = pairs.join(drawn.select(F.col("node").alias(k), F.col("n").alias(f"n{k}"), F.col("sketch").alias(f"s{k}")), k)
    return pairs.where("5 * least(na, nb) >= 4 * greatest(na, nb)").select("a", "b", "w", "na", "nb", "sa", "sb").mapInArrow(run, "a long, b long, w long")


def texts_of(pairs: DataFrame, drawn: DataFrame, docs: DataFrame, most_sent: int = 1_000_000) -> DataFrame:
    """(node, text) of the pairs' nodes. Up to most_sent nodes (two numbers each) are broadcast to the scan, more are joined by a shuffle."""
    nodes = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    wanted = stored(drawn.select("node", "doc_id").where("doc_id is not null").join(nodes, "node", "left_semi"), "wanted")
    wanted = F.broadcast(wanted) if wanted.count() <= most_sent else wanted
    # rows that repeat a doc_id with other texts: the text must have the node's set
    return stored(_checked(_slim(docs).where("doc_id is not null").join(wanted, "doc_id")), "texts")


def compared(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Of pairs (a, b) of nodes those whose sets have a Jaccard similarity of 0.8 or more; texts: (node, text)."""

    def run(batches):
        last, kept = None, np.zeros(0, U)
        for b in blocks(batches, "text_a", 2 << 20):
            ka, kb = b.column(0).to_numpy(), b.column(1).to_numpy()
            new = np.ones(len(kb), bool)
            new[1:] = kb[1:] != kb[:-1]
            if last is not None and len(kb) and kb[0] == last:
                new[0] = False
            sa = shingle_sets(b.column(2))
            sb = iter(shingle_sets(b.column(3).filter(pa.array(new))))
            ok = np.zeros(len(ka), bool)
            for i, s in enumerate(sa):
                if new[i]:
                    kept, last = next(sb), kb[i]
                both = len(s) + len(kept) - len(np.union1d(s, kept)) if min(len(s), len(kept)) * 5 >= max(len(s), len(kept)) * 4 else 0
                ok[i] = both and 100 * both >= 80 * (len(s) + len(kept) - both)
            yield pa.record_batch([pa.array(ka[ok]), pa.array(kb[ok])], names=["a", "b"])

    first = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
    full = first.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b").select("a", "b", "text_a", "text_b")
    return full.sortWithinPartitions("b").mapInArrow(run, "a long, b long")


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root): the least node of each node's component, by alternating large and small stars on stored tables."""
    edges = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), name)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # large star: larger neighbours point to the least neighbour or the node itself
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: the node and its smaller neighbours point to the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        edges = stored(small, name)
        # done when no parent has a parent itself and no node has two
        deeper = edges.join(edges.select(F.col("u").alias("v")), "v", "left_semi")
        twice = edges.groupBy("u").count().where("count > 1")
        if deeper.isEmpty() and twice.isEmpty():
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def joined(roots: DataFrame, links: DataFrame) -> DataFrame:
    """The components of roots after more links."""
    if links.isEmpty():
        return roots
    return components(links.unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b"))))


def both_ways(pairs: DataFrame) -> DataFrame:
    return pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _with_roots(pairs: DataFrame, roots: DataFrame, *names: str) -> DataFrame:
    for k in names:
        pairs = pairs.join(roots.select(F.col("node").alias(k), F.col("root").alias(f"r{k}")), k, "left").withColumn(f"r{k}", F.coalesce(f"r{k}", k))
    return pairs


def _mixed_pairs(members: DataFrame, roots: DataFrame, drawn: DataFrame, most: int, cell: int) -> DataFrame:
    """(a, b, left): up to `most` sketch-passing pairs for each two classes that meet in a cell of a signature; left: pairs not listed."""
    members = _with_roots(members, roots, "node").withColumnRenamed("rnode", "root")
    per = members.groupBy("sig").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("m"), F.bit_xor(F.xxhash64("node")).alias("h"), F.bit_xor(F.xxhash64(F.lit(1), "node")).alias("k")).where("lo < hi")
    # of signatures with the same nodes one is enough
    per = per.groupBy("h", "k", "m", "lo", "hi").agg(F.min("sig").alias("sig")).select("sig", "m")
    mixed = stored(members.join(per, "sig"), "mixed").join(drawn, "node")
    # a signature of m nodes: m / cell chunks, and a cell for each two chunks
    g = F.ceil(F.col("m") / cell).cast("int")
    chunk = F.pmod(F.xxhash64("node"), g).cast("int")
    cells = mixed.select("sig", "node", "root", "n", "sketch", chunk.alias("c"), F.explode(F.sequence(F.lit(0), g - 1)).alias("t")).select("sig", F.least("c", "t").alias("i"), F.greatest("c", "t").alias("j"), "c", "node", "root", "n", "sketch")
    cells = cells.repartition("sig", "i", "j").sortWithinPartitions("sig", "i", "j", "c", "node")

    def cell_pairs(rows):
        node, root, n, sk, c, one = rows
        count: dict = {}
        got, left = [], 0
        for x in range(len(node) - 1):
            y = np.arange(x + 1, len(node))
            y = y[root[y] != root[x]]
            if not one:
                y = y[c[y] != c[x]]
            limit = (n[x] + n[y]) // 9
            y = y[np.abs(n[y] - n[x]) <= limit]
            if not len(y):
                continue
            d = np.bitwise_count(sk[y] ^ sk[x]).sum(axis=1)
            y = y[d <= (n[x] + n[y]) // 9]
            for k in y:
                key = (min(root[x], root[k]), max(root[x], root[k]))
                if count.get(key, 0) < most:
                    count[key] = count.get(key, 0) + 1
                    got.append((min(node[x], node[k]), max(node[x], node[k])))
                else:
                    left += 1
        return got, left

    def run(batches):
        held, rows = None, []

        def done():
            if len(rows) < 2:
                return None
            node, root, n, sk, c = zip(*rows)
            got, left = cell_pairs((np.array(node), np.array(root), np.array(n), np.frombuffer(b"".join(sk), U).reshape(len(node), -1), np.array(c), held[1] == held[2]))
            if not got and not left:
                return None
            return pa.record_batch([pa.array([x for x, _ in got], pa.int64()), pa.array([y for _, y in got], pa.int64()), pa.array([left] + [0] * (len(got) - 1) if got else [], pa.int64())], names=["a", "b", "left"])

        for b in batches:
            for s, i, j, c, node, root, n, sk in zip(*(x.to_pylist() for x in b.columns)):
                if held != (s, i, j):
                    if (out := done()) is not None:
                        yield out
                    held, rows = (s, i, j), []
                rows.append((node, root, n, sk, c))
        if (out := done()) is not None:
            yield out

    return cells.mapInArrow(run, "a long, b long, left long")


def classes(docs: DataFrame, cell: int = 2048) -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    sets = stored(sets_of(docs), "sets")
    found = stored(shared(signature_rows(docs)), "signatures")
    bands = {r.node for r in found.where(F.col("kind") == THIN).select("node").distinct().collect()}  # bands are few
    if bands:
        found = found.unionByName(stored(shared(signature_rows(docs, thin_levels(docs, bands))), "signatures"))
    members = stored(members_of(found), "members")
    nodes = members.select("node").distinct()
    drawn = stored(sets.join(nodes, "node", "left_semi").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.min("n").alias("n"), F.min("sketch").alias("sketch")), "sketches")
    per = members.groupBy("sig").agg(F.min("node").alias("b"), F.max("node").alias("last")).where("b < last").select("sig", "b")
    tried = members.join(per, "sig").where("node <> b").groupBy(F.col("node").alias("a"), "b").agg(F.count(F.lit(1)).alias("w"))
    tried = stored(screened(tried, drawn), "pairs")
    text = texts_of(tried, drawn, docs)
    best = tried.groupBy("a").agg(F.max(F.struct("w", "b")).alias("x")).select("a", F.col("x.b").alias("b"))
    roots = components(stored(compared(best, text), "links"))
    rest = _with_roots(tried.join(best, ["a", "b"], "left_anti"), roots, "a", "b").where("ra <> rb").select("a", "b")
    roots = joined(roots, stored(compared(rest, text), "links"))
    most, tried = 4096, tried.select("a", "b")
    while True:
        found = stored(_mixed_pairs(members, roots, drawn, most, cell), "candidates")
        new = stored(found.select("a", "b").distinct().join(both_ways(tried), ["a", "b"], "left_anti"), "candidates")
        if not new.isEmpty():
            roots = joined(roots, stored(compared(new, texts_of(new, drawn, docs)), "links"))
            tried = tried.unionByName(new)
        if not (found.agg(F.sum("left")).first()[0] or 0):
            break
        most *= 16
    named = sets.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    # stored, so that the join below is not tied to the aggregation's partitions and a class of many rows can be split
    least = stored(named.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("least")), "least")
    out = named.join(least, "root", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id"))


def _checked(text: DataFrame) -> DataFrame:
    """One row (node, text) a node whose text has that set."""

    def run(batches):
        for b in blocks(batches, "text", 2 << 20):
            ids = [set_id(s) if len(s) else None for s in shingle_sets(b.column(1))]
            yield b.select(["node", "text"]).filter(pa.array([i == k for i, k in zip(ids, b.column(0).to_pylist())]))

    return text.select("node", "text").mapInArrow(run, "node long, text string").dropDuplicates(["node"])


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs without repeats: of each class one row of the least doc_id stays. Rows without doc_id stay."""
    found = stored(classes(docs).where("doc_id is not null").select(F.col("doc_id").alias("__id"), F.col("component_id").alias("__first")), "classes")
    gone = found.where("__id <> __first").select("__id").distinct()
    kept = docs.join(gone, docs["doc_id"].cast("long") == gone["__id"], "left_anti")
    twice = stored(found.groupBy("__id").count().where("count > 1").select("__id"), "repeats")
    if twice.isEmpty():
        return kept
    same = docs["doc_id"].cast("long") == twice["__id"]
    return kept.join(twice, same, "left_anti").unionByName(kept.join(twice, same, "left_semi").dropDuplicates(["doc_id"]))


# Equal shingles by a hash; pairs by what they share; classes by the least doc_id that spreads along the links. For small tables.
SQL = r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(len(w) - 4), lambda i: array_to_string(w[i + 1:i + 5], ' ')) END) AS s FROM w),
n AS (SELECT doc_id, len(s)::BIGINT AS n FROM g),
x AS (SELECT doc_id, len(s) AS n, hash(unnest(s)) AS h FROM g),
c AS (SELECT h FROM x GROUP BY h HAVING count(*) > 1),
y AS MATERIALIZED (SELECT x.* FROM x SEMI JOIN c USING (h)),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS an, any_value(b.n) AS bn, count(*) AS k FROM y a JOIN y b ON a.h = b.h AND a.doc_id < b.doc_id AND 5 * a.n >= 4 * b.n AND 5 * b.n >= 4 * a.n GROUP BY ALL),
l AS (SELECT a, b FROM p WHERE 100 * k >= 80 * (an + bn - k)),
e AS MATERIALIZED (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS root FROM n UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.doc_id WHERE r.root < e.b)
SELECT doc_id, any_value(n) AS n_shingles, min(root) AS component_id FROM r JOIN n USING (doc_id) GROUP BY doc_id"""
