"""Operator 6: near-duplicate documents by SuperMinHash, banding, verification and union-find.

1. Every text gives its set of 5-word shingles, the set's fingerprint and, by SuperMinHash, a
   signature of 128 slots. Texts with equal sets are one class from here on, so a group of exact
   copies costs one row.
2. 32 bands of 4 slots put classes into buckets. Members of buckets with two classes or more meet;
   a bucket over a fixed size is cut into chunks and every two chunks meet in a task of their own,
   so no task holds an unbounded bucket.
3. Where members meet, signatures are compared and a spanning forest of the likely pairs is given
   out (union-find inside the task), at most one pair fewer than members. These pairs are verified
   on the full sets and closed to components on the cluster (components.py).
4. The forests tie together all that is likely, so every link lies inside a component of theirs, a
   cluster. Where a cluster fell apart because pairs failed, its members meet again, chunk by chunk,
   with their full sets, and every pair across components is checked in memory: a pair that failed
   costs no link, and no more than a forest of true links leaves a task.

A pair with similarity s is seen with probability 1 - (1 - s^4)^32: at 0.75 all but 5 in a million.

Defined cases: null and empty texts have no set and link with nothing; a null doc_id is a document
whose id comes before all others; rows that share a doc_id are one document, so repeated rows are
kept or dropped together, and where their texts differ each text is a node of its own, linked by its
own set and tied to the others of its doc_id, so no link is lost; of equal texts and of ties the
least doc_id stays; a very long text is one set as a whole; an empty table gives an empty result;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import M64, MIN_LONG, cut, id_key, map_arrow, mix64, parts, release, shingles, table
from .components import components

SLOTS, ROWS = 128, 4
BANDS = SLOTS // ROWS
#: Slots are the leading bits of a shingle's hash.
SLOT_BITS = SLOTS.bit_length() - 1
#: Share of equal slots from which a pair is verified on its full sets: over 6 standard deviations
#: below 0.75, so a link is passed over once in 10^9, far less than by banding. With 0 every pair that
#: meets is verified.
LIKELY = 0.50
#: Members of a bucket that meet in one task; larger buckets meet chunk by chunk.
CHUNK = 512
#: Buckets of document ids, the size bound of a broadcast set.
BUCKETS = 1 << 20
#: Bytes of the full sets in a chunk.
CHUNK_BYTES = 16 << 20


def superminhash(hashes: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """SuperMinHash of a sorted set of 64-bit hashes: for each slot the least rank + fraction over
    the elements, where an element's ranks are a permutation of the slots. As all values of rank j
    lie in [j, j + 1), the scan over ranks stops when every slot is filled (early stopping).

    Returned as integers: rank in the top byte, fraction below."""
    bits = slots.bit_length() - 1
    out = np.full(slots, M64, np.uint64)
    n = len(hashes)
    if not n:
        return out
    # Rank 0: the leading bits are the slot, the rest the fraction; in a sorted set the first
    # element of each slot is its least.
    starts = np.searchsorted(hashes, np.arange(slots, dtype=np.uint64) << np.uint64(64 - bits))
    ok = starts < n
    at = np.minimum(starts, n - 1)
    hit = ok & (hashes[at] >> np.uint64(64 - bits) == np.arange(slots, dtype=np.uint64))
    out[hit] = (hashes[at[hit]] << np.uint64(bits)) >> np.uint64(8)
    if hit.all():
        return out
    # Further ranks: Fisher-Yates, a step for all elements at once.
    perm = np.tile(np.arange(slots, dtype=np.uint8 if slots <= 256 else np.uint16), (n, 1))
    rows = np.arange(n)
    first = (hashes >> np.uint64(64 - bits)).astype(np.int64)
    perm[rows, first] = 0
    perm[:, 0] = first
    for j in range(1, slots):
        draw = mix64(hashes + np.uint64(j * 0x9E3779B97F4A7C15 & M64))
        k = j + ((draw >> np.uint64(40)) * np.uint64(slots - j) >> np.uint64(24)).astype(np.int64)
        slot = perm[rows, k].astype(np.int64)
        perm[rows, k] = perm[:, j]
        perm[:, j] = slot
        value = (np.uint64(j) << np.uint64(56)) | (mix64(draw) >> np.uint64(8))
        free = out[slot] == np.uint64(M64)
        if free.any():
            np.minimum.at(out, slot[free], value[free])
            if (out != np.uint64(M64)).all():
                break
    return out


def bands(signature: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """A hash for each band of ``rows`` slots."""
    grid = signature.reshape(-1, rows)
    out = np.arange(len(grid), dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    for k in range(rows):
        out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + grid[:, k])
    return out


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, _k, _x (hash of the text), n_shingles, set_hash (null without a set), sig (a byte a
    slot), keys."""

    def run(slices):
        for s in slices:
            out: dict[str, list] = {"doc_id": s["doc_id"], "_k": s["_k"], "_x": s["_x"], "n_shingles": [], "set_hash": [], "sig": [], "keys": []}
            for text in s["text"]:
                found = shingles(text)
                out["n_shingles"].append(len(found))
                if not len(found):
                    out["set_hash"].append(None), out["sig"].append(None), out["keys"].append(None)
                    continue
                sig = superminhash(found)
                out["set_hash"].append(xxhash.xxh3_128_digest(found.tobytes()))
                out["sig"].append(mix64(sig).astype(np.uint8).tobytes())
                out["keys"].append(bands(sig).view(np.int64))
            yield out

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), id_key(F.col("doc_id")).alias("_k"), F.xxhash64("text").alias("_x"), "text")
    return map_arrow(rows, run, "doc_id long, _k long, _x long, n_shingles long, set_hash binary, sig binary, keys array<long>")


class Union:
    """Union-find over 0..n-1; roots are the least members."""

    def __init__(self, n: int):
        self.root = list(range(n))

    def top(self, x: int) -> int:
        root = self.root
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    def join(self, i: int, j: int) -> bool:
        a, b = self.top(i), self.top(j)
        if a != b:
            self.root[max(a, b)] = min(a, b)
        return a != b


def _likely(i: int, sigs: np.ndarray, chunk: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Members behind i that are likely near it, and their equal slots. chunk: of each member where
    two chunks meet; pairs inside one chunk are met elsewhere."""
    near = (sigs[i + 1 :] == sigs[i]).sum(1)
    ok = near >= LIKELY * sigs.shape[1]
    if chunk is not None:
        ok &= chunk[i + 1 :] != chunk[i]
    at = np.flatnonzero(ok)
    return at + i + 1, near[at]


def _forest(t: pa.Table, chunk: np.ndarray | None) -> list[tuple[int, int]]:
    """A spanning forest of the likely pairs among members of a bucket."""
    ids, sigs = t["id"].to_numpy(), _matrix(t["sig"])
    found: list[tuple[int, int, int]] = []
    for i in range(len(ids) - 1):
        at, near = _likely(i, sigs, chunk)
        # In tenths, so that many near-equal pairs hang on the least member and not on each other.
        found += zip((-(near * 10 // sigs.shape[1])).tolist(), [i] * len(at), at.tolist(), strict=True)
    found.sort()
    one = Union(len(ids))
    return [(int(ids[i]), int(ids[j])) for _, i, j in found if one.join(i, j)]


def _links(t: pa.Table, chunk: np.ndarray | None) -> list[tuple[int, int]]:
    """A spanning forest of the true links across components among members of a cluster."""
    ids, sigs, comp = t["id"].to_numpy(), _matrix(t["sig"]), t["comp"].to_numpy()
    sets = [np.frombuffer(x, np.uint64) for x in t["words"].to_pylist()]
    first: dict[int, int] = {}
    one = Union(len(ids))
    for i, c in enumerate(comp.tolist()):
        one.join(first.setdefault(c, i), i)
    out = []
    for i in range(len(ids) - 1):
        at, _ = _likely(i, sigs, chunk)
        for j in at[comp[at] != comp[i]].tolist():
            if one.top(i) != one.top(j) and similar(sets[i], sets[j]):
                one.join(i, j)
                out.append((int(ids[i]), int(ids[j])))
    return out


def _matrix(column) -> np.ndarray:
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), np.uint8).reshape(len(rows), -1)


def similar(a: np.ndarray, b: np.ndarray, share: int = 75) -> bool:
    """Whether 100 * intersection >= share * union, of sorted distinct arrays."""
    if 100 * min(len(a), len(b)) < share * max(len(a), len(b)):
        return False
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= share * (len(a) + len(b) - common)


def _meet(members: DataFrame, chunks: Column, pairs_of) -> DataFrame:
    """members: key, id, sig and what pairs_of reads; chunks: how many the key's members are cut
    into. Distinct pairs a < b."""
    spark = members.sparkSession
    m = members.withColumn("_c", F.pmod(F.xxhash64("id"), chunks).cast("int"))
    # Chunk c meets every chunk d; with itself once.
    m = m.withColumn("_d", F.explode(F.sequence(F.lit(0), chunks - 1)))
    m = m.select("key", F.least("_c", "_d").alias("lo"), F.greatest("_c", "_d").alias("hi"), "_c", *[c for c in members.columns if c not in ("key", "n", "size")])
    m = m.repartition(parts(spark), "key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "id")

    def groups(batches):
        held: list[pa.RecordBatch] = []
        last = None

        def emit(rows):
            t = pa.Table.from_batches(rows)
            return pairs_of(t, t["_c"].to_numpy() if t["lo"][0].as_py() != t["hi"][0].as_py() else None)

        out: list[tuple[int, int]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            mark = np.stack([batch.column(i).to_numpy() for i in range(3)])
            ends = [0, *(np.flatnonzero((mark[:, 1:] != mark[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
            for a, b in zip(ends, ends[1:], strict=False):
                now = tuple(mark[:, a].tolist())
                if now != last and held:
                    out += emit(held)
                    held = []
                held.append(batch.slice(a, b - a))
                last = now
            if len(out) > 10_000:
                yield _pairs(out)
                out = []
        if held:
            out += emit(held)
        yield _pairs(out)

    return m.mapInArrow(groups, "a long, b long").distinct()


def _pairs(rows):
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in (0, 1)], names=["a", "b"])


def verify(pairs: DataFrame, texts: DataFrame, share: int = 75) -> DataFrame:
    """pairs (a, b) with linked: whether 100 * intersection >= share * union on the full sets.
    texts: id, text, one row an id."""
    both = pairs.join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
    both = both.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a").select("a", "b", "text_a", "text_b")

    def run(slices):
        last, left = None, None
        for s in slices:
            linked = []
            for a, x, y in zip(s["a"], s["text_a"], s["text_b"], strict=True):
                if a != last or left is None:
                    last, left = a, shingles(x)
                linked.append(similar(left, shingles(y), share))
            yield {"a": s["a"], "b": s["b"], "linked": linked}

    return map_arrow(both, run, "a long, b long, linked boolean")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id, kept."""
    signed = cut(signatures(docs))
    texts = docs.select(id_key(F.col("doc_id")).alias("id"), "text")
    # Rows that share a doc_id but not the text: each text is a node.
    many = cut(signed.groupBy("_k").agg(F.min("_x").alias("_lo"), F.max("_x").alias("_hi")).where("_lo <> _hi").select("_k"))
    shared = not many.isEmpty()
    node = F.col("_k")
    if shared:
        many = many.withColumn("_many", F.lit(True))
        node = F.when(F.col("_many"), F.xxhash64("_k", "_x")).otherwise(F.col("_k"))
        signed = cut(signed.join(many, "_k", "left").withColumn("_node", node))
        own = F.when(F.col("_many"), F.xxhash64("id", F.xxhash64("text"))).otherwise(F.col("id"))
        texts = texts.join(many, texts["id"] == many["_k"], "left").select(own.alias("id"), "text")
        node = F.col("_node")
    classes = signed.where("set_hash IS NOT NULL").groupBy("set_hash").agg(F.min(node).alias("id"), F.first("sig").alias("sig"), F.first("keys").alias("keys"))
    classes = cut(classes)
    banded = classes.select("id", F.explode("keys").alias("key"))
    full = banded.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("_lo"), F.max("id").alias("_hi")).where("_lo <> _hi").select("key", "n")
    members = banded.join(full, "key").join(classes.select("id", "sig"), "id")
    first = cut(_meet(members, F.ceil(F.col("n") / CHUNK).cast("int"), _forest))
    wanted = _texts(texts, first)
    links = cut(verify(first, wanted).where("linked").select("a", "b"))
    if shared:
        # The texts of a doc_id are tied together, by the nodes of their classes.
        tied = signed.where("_many AND set_hash IS NOT NULL").join(classes.select("set_hash", "id"), "set_hash").select("_k", "id").distinct()
        least = tied.groupBy("_k").agg(F.min("id").alias("a"))
        links = cut(links.union(tied.join(least, "_k").where("a <> id").select("a", F.col("id").alias("b"))))
    release(wanted)
    comp = components(links)
    # Clusters that fell apart: their members meet again with their full sets.
    cluster = components(first).withColumnRenamed("node", "id").withColumnRenamed("component", "key")
    placed = cluster.join(comp.select(F.col("node").alias("id"), F.col("component").alias("comp")), "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    apart = placed.groupBy("key").agg(F.min("comp").alias("_lo"), F.max("comp").alias("_hi")).where("_lo <> _hi").select("key")
    again = cut(placed.join(apart, "key"))
    if not again.isEmpty():
        wanted = _texts(texts, again.select(F.col("id").alias("a"), F.col("id").alias("b")))
        sets = map_arrow(wanted, _sets, "id long, words binary")
        met = again.join(classes.groupBy("id").agg(F.first("sig").alias("sig")), "id").join(sets, "id")
        sizes = met.groupBy("key").agg(F.count("*").alias("n"), F.sum(F.octet_length("words")).alias("size"))
        chunks = F.greatest(F.ceil(F.col("n") / (CHUNK // 2)), F.ceil(F.col("size") / CHUNK_BYTES)).cast("int")
        more = cut(_meet(met.join(sizes, "key"), chunks, _links))
        release(wanted)
        if not more.isEmpty():
            comp = components(links.union(more))
    release(first, again)
    # A class's rows take the component of its least node.
    named = classes.select("set_hash", "id").join(comp, classes["id"] == comp["node"], "left").select("set_hash", F.coalesce("component", "id").alias("_comp"))
    out = signed.select("doc_id", "_k", "n_shingles", "set_hash").join(named, "set_hash", "left")
    component = F.coalesce("_comp", "_k")
    if shared:
        # Nodes are not doc_ids: a component is named by the least doc_id that has a text in it. Rows
        # without a set go with their doc_id.
        out = cut(out)
        names = out.where("_comp IS NOT NULL").groupBy("_comp").agg(F.min("_k").alias("_name"))
        of_id = out.join(names, "_comp").groupBy("_k").agg(F.min("_name").alias("_least"))
        out = out.join(of_id, "_k", "left")
        component = F.coalesce("_least", "_k")
    component = F.when(component != MIN_LONG, component)
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def _sets(slices):
    for s in slices:
        yield {"id": s["id"], "words": [shingles(t).tobytes() for t in s["text"]]}


def _texts(texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """texts: id, text. id, text of the documents in the pairs; repeated rows have one text."""
    need = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    # Documents that share no bucket of ids with a needed one need not move: BUCKETS rows at most.
    slot = F.pmod(F.xxhash64("id"), F.lit(BUCKETS)).alias("_slot")
    rows = texts.withColumn("_slot", slot)
    rows = rows.join(F.broadcast(need.select(slot).distinct()), "_slot", "left_semi").drop("_slot").join(need, "id")
    return cut(rows.groupBy("id").agg(F.max("text").alias("text")))


def op6(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
