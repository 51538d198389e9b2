"""Operator 10: language-model scores by online logistic context mixing.

A text is a sequence of bytes: its words, A-Z in lower case, each with a closing blank, then one more
blank, the end. Every byte is a path of binary decisions in a code tree (Huffman's, over the corpus's
bytes, so a common byte takes few decisions; the codes are fixed by the corpus and every byte has
one). Each decision is predicted in four contexts, all of them behind the text's state:

* the last two, three and four bytes, across words, in hashed tables of counts;
* the word so far, with exact counts.

The state is the class of what was read: the corpus's frequent words are put into classes by which
of them follow each other, and the class that the last frequent words of the text speak for is
the state (0: none came yet). It tells the language and the kind of text, from earlier words only.

The predictions are mixed in the logistic domain. A gate, how often the word so far has been seen in
front of the decision, picks one of four weight vectors. The weights start from fixed ones and are
refined online as the text is read: after every window of decisions (128 at first, then an eighth of
what was read) each vector takes a damped step down the gradient of the coding cost of its decisions.
An adaptive table of the text then refines the mixed probability by cells of it. So every text has a
proper probability, and bits per byte follow; a text's score depends on the corpus's counts and on
its own earlier bytes alone, not on how rows are dealt.

Learning is distributed and covers all training documents: (1) the frequent words, those with at
least a share FREQUENT of all tokens, found exactly: whatever has that share has a quarter of it in enough
parts of the rows to be among a bounded number of candidates, and those that are not sure by then are
counted; (2) counts of which frequent word is the next one after which; (3) counts of (word, state), a table that
grows with the corpus, and of the byte contexts, whose number is bounded by the bytes and the classes,
in hashed tables of fixed size, summed as whole numbers. The contexts of the word so far have exact
counts: words that begin with the same three bytes, or with more where too many do, are in one task,
which sorts their contexts; what is shared by several tasks is counted from those beginnings. Words
that only held-out rows have are in the table with count 0. All counts of a decision (of 0 and of 1)
are kept in one byte, in 16 steps each. Documents are dealt to blocks; what is learned keeps, beside the
count of a (word, state), the blocks that have it, so the task that counts a word's contexts sends
their counts to just those blocks, where they meet the documents in one task.

Defined cases: null and empty texts are the end alone; a null doc_id counts as the empty text for
held_out; repeated rows are learned from and scored each, alike; of ties among classes the first
counts; very long texts are read in pieces of SEGMENT bytes, at word ends, with the state, the bytes
and the weights carried on; without training documents the model is that of even decisions and the
base score is log10 of 1 a token (0); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import chain, groupby, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, crc_mod_col, cut, map_arrow, mix64, parts, release, signed, table

HELD_OUT = (5, 1)
#: Share of all tokens from which a word is frequent; there are at most 1 / FREQUENT of them.
FREQUENT = 1 / 1000
#: Classes of frequent words (states are 0 and 1..CLASSES), steps of their fit, and how many of a text's
#: last frequent words speak for one.
CLASSES, FIT_STEPS, RECENT = 7, 200, 32
#: Slots of the tables of the last two, three and four bytes, as powers of 2.
TABLE_BITS = (18, 20, 22)
OFFSETS = np.cumsum([0, *(1 << b for b in TABLE_BITS)])
CHUNK_BITS = 16
#: Counts from which a step begins.
STEPS = np.array([0, 1, 2, 3, 4, 6, 9, 14, 22, 40, 80, 200, 600, 2500, 15000, 100000])
#: Bytes of a word that decide where it is learned; pairs of word and state with one such beginning from
#: which a byte more does, and the longest beginning.
LOCAL, CROWDED, DEEPEST = 3, 20_000, 64
#: Tokens of a task, or distinct contexts, after which it gives out its counts.
FLUSH_TOKENS, FLUSH_KEYS, FLUSH_WORDS = 3_000_000, 2_500_000, 300_000
#: Bytes of text of a task that learns, of a block of documents that is scored, of a piece of a long
#: text and of the texts that are read side by side.
LEARN_BYTES, BLOCK_BYTES, SEGMENT, BATCH_BYTES = 64 << 20, 16 << 20, 1 << 20, 1 << 18
#: Neighbouring blocks whose marks are one long.
SPAN = 64
#: Pairs of word and state of a task that counts the words so far, and of a part of it at least.
TASK_PAIRS, PART_PAIRS = 400_000, 50_000
#: Decisions of the first window; later ones have an eighth of those before, up to the second figure.
WINDOW, WINDOW_MOST = 128, 1 << 16
#: First weights; the steps' size; how many decisions' worth the first weights hold; curvature of one.
START, RATE, PRIOR, CURVE = np.array([0.15, 0.2, 0.3, 0.5], np.float32), 0.5, 20.0, 0.3
GATES, K = 4, 4
#: Times that the word so far went one way and never the other from which a decision is settled.
SETTLED = 200
#: Cells of the refinement, a unit of the stretched probability each, and the weight of an empty one.
CELLS, CELL_PRIOR = 24, 20.0

GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_BLANK = re.compile(rb"[\x20\x09-\x0D]")

# --- what is read -----------------------------------------------------------------------------


def segments(text: str | None) -> Iterator[list[bytes]]:
    """The tokens of a text: its words and the end, the empty word; long texts in several lists."""
    raw = (text or "").encode("utf-8", "surrogatepass").lower()
    at = 0
    while len(raw) - at > SEGMENT and (blank := _BLANK.search(raw, at + SEGMENT)):
        yield raw[at : blank.start()].split()
        at = blank.start()
    yield [*(raw[at:] if at else raw).split(), b""]


class Tree:
    """A code tree over bytes. NODES, BITS: the decisions of all bytes one after the other."""

    def __init__(self, counts: np.ndarray):
        heap: list[tuple[int, int]] = [(int(c) + 1, b) for b, c in enumerate(counts)]
        heapq.heapify(heap)
        below: list[tuple[int, int]] = []
        while len(heap) > 1:
            (x, a), (y, b) = heapq.heappop(heap), heapq.heappop(heap)
            heapq.heappush(heap, (x + y, 256 + len(below)))
            below.append((a, b))
        paths: list = [None] * 256
        todo = [(heap[0][1], ())]
        order = []
        while todo:
            at, path = todo.pop()
            if at < 256:
                paths[at] = path
                order.append(at)
            else:
                todo += [(child, (*path, (at - 256, bit))) for bit, child in ((1, below[at - 256][1]), (0, below[at - 256][0]))]
        self.length = np.array([len(p) for p in paths])
        self.first = np.cumsum(self.length) - self.length
        self.node = np.array([n for p in paths for n, _ in p], np.int64)
        self.bit = np.array([b for p in paths for _, b in p], np.int64)
        self.node32, self.bit8 = self.node.astype(np.int32), self.bit.astype(np.uint8)
        self.length16, self.length32, self.first32 = self.length.astype(np.int16), self.length.astype(np.int32), self.first.astype(np.int32)
        #: Bytes in the order of the tree's leaves: below a node they are neighbours.
        self.rank = np.empty(256, np.uint64)
        self.rank[order] = np.arange(256, dtype=np.uint64)
        self.of_rank = np.array(order)

    def decisions(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For all decisions of the bytes: the byte's place in data, the place in node and bit."""
        n = self.length32.take(data)
        end = np.cumsum(n, dtype=np.int32)
        byte = np.repeat(np.arange(len(data), dtype=np.int32), n)
        path = (self.first32.take(data) - end + n).take(byte)
        path += np.arange(len(byte), dtype=np.int32)
        return byte, path


def level_of(n: np.ndarray) -> np.ndarray:
    """Counts as their steps, 0 to 15."""
    return (np.searchsorted(STEPS, n, side="right") - 1).astype(np.uint8)


def state_byte(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    return (level_of(n0) << 4) | level_of(n1)


_N0, _N1 = np.repeat(STEPS, 16), np.tile(STEPS, 16)
#: Of a state byte: the stretched probability of 1, and the gate.
STRETCH = np.log((_N1 + 0.4) / (_N0 + 0.4)).astype(np.float32)
GATE = np.searchsorted([1, 3, 9], np.maximum(_N0, _N1), side="right").astype(np.uint8)
SIGN = np.array([-1, 1], np.float32)
#: Whether a context has settled a decision: SETTLED times or more one way, never the other.
SURE = (np.minimum(_N0, _N1) == 0) & (np.maximum(_N0, _N1) >= SETTLED)
#: State bytes of words are kept with the count of the bit that the word has itself first: so those of
#: rare words are all alike. The state byte by bit, and the cost (in nats) of a decision if settled.
TURNED = np.stack([np.arange(256), (np.arange(256) & 15) << 4 | np.arange(256) >> 4]).astype(np.uint8).ravel()
SURE_COST = np.where(SURE, np.log1p(np.exp(STRETCH)), 0).astype(np.float32)


def squeeze(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All numbers of the ranges start..start + length, one range after the other."""
    out = np.repeat(starts - np.cumsum(lengths) + lengths, lengths)
    out += np.arange(len(out))
    return out


# --- frequent words and their classes -----------------------------------------------------------


def tokens_in(docs: DataFrame) -> DataFrame:
    """docs: text, apart (not learned from). Sums over the rows, told apart by ``what``: 0: w, c, n:
    words with a quarter of the share FREQUENT in a part of the rows, their counts there and its
    tokens, summed over the parts; 1: n, the number of all tokens; 2: b, c, how often each byte is
    read; 3: c, the bytes of all texts, those apart too."""

    def run(slices):
        held: Counter = Counter()
        n, size, every = 0, 0, np.zeros(256, np.int64)

        def out():
            often = {w: c for w, c in held.items() if w and 4 * c >= FREQUENT * n}
            m = len(often)
            yield {"what": [0] * m + [1], "w": [*often, None], "b": [0] * (m + 1), "c": [*often.values(), 0], "n": [n] * (m + 1)}

        for s in slices:
            for text, apart in zip(s["text"], s["apart"], strict=True):
                raw = (text or "").encode("utf-8", "surrogatepass")
                size += len(raw)
                if apart:
                    continue
                every += np.bincount(np.frombuffer(raw.lower(), np.uint8), minlength=256)
                for tokens in segments(text):
                    held.update(tokens)
                    n += len(tokens)
                if n >= FLUSH_TOKENS or len(held) > FLUSH_WORDS // 3:
                    yield from out()
                    held.clear()
                    n = 0
        if n:
            yield from out()
        yield {"what": [2] * 256 + [3], "w": [None] * 257, "b": [*range(256), 0], "c": [*every, size], "n": [0] * 257}

    return cut(map_arrow(docs, run, "what int, w binary, b int, c long, n long").groupBy("what", "w", "b").agg(F.sum("c").alias("c"), F.sum("n").alias("n")))


def frequent(docs: DataFrame, found: DataFrame, total: int) -> tuple[list[bytes], np.ndarray]:
    """The frequent words in order, and how often each is the next frequent word after each."""
    # Parts that did not give a word have less than a quarter of the share of it: at most
    # 4 / 3 / FREQUENT words are left, and most are sure.
    rest = FREQUENT / 4 * (total - F.col("n"))
    rows = found.where("what = 0").where(F.col("c") + rest >= FREQUENT * total).select("w", "c").collect()
    sure = {bytes(r["w"]) for r in rows if r["c"] >= FREQUENT * total}
    if open_words := {bytes(r["w"]) for r in rows} - sure:

        def count(slices):
            n: Counter = Counter()
            for s in slices:
                for text in s["text"]:
                    for tokens in segments(text):
                        n.update(w for w in tokens if w in open_words)
            yield {"w": list(n), "c": list(n.values())}

        sums = map_arrow(docs.select("text"), count, "w binary, c long").groupBy("w").agg(F.sum("c").alias("c")).collect()
        sure |= {bytes(r["w"]) for r in sums if r["c"] >= FREQUENT * total}
    names = sorted(sure)
    size = len(names)
    if not size:
        return [], np.zeros((0, 0))

    def run(slices):
        follows = np.zeros(size * size, np.int64)
        get = {w: i for i, w in enumerate(names)}.get
        for s in slices:
            for text in s["text"]:
                last = -1
                for tokens in segments(text):
                    ids = np.array([last, *[i for i in map(get, tokens) if i is not None]])
                    pairs = ids[:-1] * size + ids[1:]
                    np.add.at(follows, pairs[ids[:-1] >= 0], 1)
                    last = int(ids[-1])
        at = np.flatnonzero(follows)
        yield {"at": at, "c": follows[at]}

    sums = map_arrow(docs.select("text"), run, "at long, c long").groupBy("at").agg(F.sum("c").alias("c")).toArrow()
    follows = np.zeros(size * size)
    follows[sums["at"].to_numpy()] = sums["c"].to_numpy()
    return names, follows.reshape(size, size)


def classes(near: np.ndarray, n: int = CLASSES, steps: int = FIT_STEPS) -> np.ndarray:
    """log P(word | class) as (word, class): expectation-maximisation on the pairs of words that
    follow each other, each pair of one class. It starts from words that differ most in what stands
    beside them."""
    if not len(near):
        return np.zeros((0, n))
    joint = near + near.T + 1e-9
    joint /= joint.sum()
    rows, mass = joint / joint.sum(1, keepdims=True), joint.sum(1)
    seeds = [int(mass.argmax())]
    for _ in range(1, n):
        seeds.append(int((np.min([np.abs(rows - rows[s]).sum(1) for s in seeds], 0) * np.sqrt(mass)).argmax()))
    p, share = rows[seeds].T + 1e-6, np.full(n, 1 / n)
    p /= p.sum(0)
    for _ in range(steps):
        # Classes one by one, so that no more than words x words is held.
        ratio = joint / np.maximum((p * share) @ p.T, 1e-300)
        new = p * share * (ratio @ p)
        share = new.sum(0)
        p = new + 1e-9
        p /= p.sum(0)
    return np.round(np.log(p), 6)


class Numbers(dict):
    """Numbers words in the order in which they come."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


class States:
    """States before the tokens of texts."""

    def __init__(self, names: list[bytes], logs: np.ndarray):
        self.index, self.logs = {w: i for i, w in enumerate(names)}, logs

    def names(self) -> Numbers:
        return Numbers(self.index)

    def before(self, number: np.ndarray, starts: np.ndarray, carried: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """number: of each token's frequent word, else -1. starts: where texts begin. carried: the
        frequent words before the first text. The states, and the words to carry on."""
        carried = np.empty(0, np.int64) if carried is None else carried
        some = number >= 0
        own = np.concatenate([carried, number[some]])
        total = np.concatenate([np.zeros((1, self.logs.shape[1])), np.cumsum(self.logs[own], 0)])
        seen = len(carried) + np.cumsum(some) - some
        first = seen[starts].copy()
        first[0] = 0
        low = np.maximum(seen - RECENT, np.repeat(first, np.diff(np.append(starts, len(number)))))
        # Differences of sums are rounded, so that ties do not depend on what stood before.
        state = np.where(seen > low, np.round(total[seen] - total[low], 4).argmax(1) + 1, 0)
        return state.astype(np.uint8), own[-RECENT:]


# --- counts -------------------------------------------------------------------------------------


def spans(tokens: list[list[bytes]], carried: bytes = b"    ") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of texts, the length of each token with its blank, and the four bytes before each byte
    as one number, last one lowest; before a text (but the carried first one) stand blanks."""
    data = np.frombuffer(b" ".join(chain.from_iterable(tokens)) + b" ", np.uint8)
    blanks = np.flatnonzero(data == 32)
    lengths = np.diff(blanks, prepend=-1)
    starts = blanks[np.cumsum([len(t) for t in tokens]) - 1][:-1] + 1
    wide = np.concatenate([np.frombuffer(carried, np.uint8), data])
    n = len(data)
    last = np.zeros(n, np.uint32)
    for j in (1, 2, 3, 4):
        own = wide[4 - j : 4 - j + n].astype(np.uint32)
        if len(starts):
            at = (starts[:, None] + np.arange(j)).ravel()
            own[at[at < n]] = 32
        last |= own << np.uint32(8 * (j - 1))
    return data, lengths, last


def slots(last: np.ndarray, state: np.ndarray) -> list[np.ndarray]:
    """Places of the last two, three and four bytes behind the states in the joined tables. The
    decision's node picks a slot around it (exclusive or); offsets are multiples of 256."""
    out = []
    high = state.astype(np.uint64) << np.uint64(32)
    for k, bits in enumerate(TABLE_BITS):
        key = (last & np.uint32((1 << (8 * (k + 2))) - 1)) | high
        out.append((mix64(key * GOLDEN + np.uint64(k)) >> np.uint64(64 - bits)).astype(np.int32) + np.int32(OFFSETS[k]))
    return out


def learn(docs: DataFrame, states: States, tree: Tree) -> DataFrame:
    """docs: text, apart, block; rows of a block together. Two kinds of rows: (w, before, span, mask, c), how
    often each word follows each state in the training rows of a block, 0 for those that only held-out rows
    have, with the block as a bit of the mask of SPAN blocks; and (chunk, data), counts of the slots of the
    byte contexts, a part of a table a row."""
    size = int(OFFSETS[-1])

    def run(slices):
        names, held, n, keys, now = states.names(), ([], []), 0, [], None

        def words_out():
            key, c = counted(np.concatenate([*held[0], np.empty(0, np.int64)]))
            rest = np.setdiff1d(np.concatenate([*held[1], np.empty(0, np.int64)]), key)
            key, c = np.concatenate([key, rest]), np.concatenate([c, np.zeros(len(rest), np.int64)])
            of = list(names)
            for i in range(0, len(key), 50_000):
                k = key[i : i + 50_000]
                m = len(k)
                yield {"w": [of[j] for j in (k >> 3).tolist()], "before": (k & 7).astype(np.int32), "span": np.full(m, now // SPAN, np.int32), "mask": np.full(m, signed(1 << now % SPAN)), "c": c[i : i + 50_000], "chunk": pa.nulls(m), "data": pa.nulls(m)}

        def slots_out():
            key, c = merged(keys)
            count = np.zeros((2, size), np.int32)  # of one flush; sums over flushes are longs
            for i in range(0, len(key), 1 << 19):
                k, weight = key[i : i + (1 << 19)], c[i : i + (1 << 19)]
                byte, at = tree.decisions((k & np.uint64(255)).astype(np.int64))
                node, bit, weight = tree.node[at], tree.bit[at], weight[byte].astype(np.int32)
                for place in slots(((k >> np.uint64(8)) & np.uint64(0xFFFFFFFF)).astype(np.uint32), k >> np.uint64(40)):
                    np.add.at(count, (bit, place[byte] ^ node), weight)
            for chunk in range(size >> CHUNK_BITS):
                part = count[:, chunk << CHUNK_BITS : (chunk + 1) << CHUNK_BITS]
                at = np.flatnonzero(part.any(0))
                if len(at):
                    yield {n: [None] for n in ("w", "before", "span", "mask", "c")} | {"chunk": [chunk], "data": [at.astype(np.uint16).tobytes() + part[:, at].tobytes()]}

        for s in slices:
            for block, rows in groupby(zip(s["block"], s["text"], s["apart"], strict=True), lambda r: r[0]):
                if n and (block != now or n >= FLUSH_TOKENS or len(names) >= FLUSH_WORDS):
                    yield from words_out()
                    names, held, n = states.names(), ([], []), 0
                now, rows = block, list(rows)
                for apart in (False, True):
                    for group, lasts in batches([t for _, t, a in rows if a == apart]):
                        ids, before = lasts(group, names, states)
                        held[apart].append((ids << 3) | before)
                        n += len(ids)
                        if not apart:
                            data, lengths, last = spans(group, lasts.bytes)
                            key = (np.repeat(before.astype(np.uint64), lengths) << np.uint64(40)) | (last.astype(np.uint64) << np.uint64(8)) | data
                            keys.append(counted(key))
                        lasts.end(group)
                if sum(len(k) for k, _ in keys) > FLUSH_KEYS:
                    keys = [merged(keys)]
                    if len(keys[0][0]) > FLUSH_KEYS:
                        yield from slots_out()
                        keys = []
        if n:
            yield from words_out()
        if keys:
            yield from slots_out()

    return map_arrow(docs, run, "w binary, before int, span int, mask long, c long, chunk int, data binary")


class Carried:
    """What is carried from piece to piece of a long text: the last frequent words and bytes."""

    def __init__(self):
        self.words, self.bytes = None, b"    "

    def __call__(self, group: list[list[bytes]], names: Numbers, states: States) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the tokens' words, and the states before them. names: with the frequent words
        first, as ``states.names()`` begins it."""
        n = sum(map(len, group))
        ids = np.fromiter(map(names.__getitem__, chain.from_iterable(group)), np.int64, n)
        starts = np.cumsum([0, *(len(t) for t in group[:-1])])
        state, self.words = states.before(np.where(ids < len(states.index), ids, -1), starts, self.words)
        return ids, state

    def end(self, group: list[list[bytes]]) -> None:
        self.bytes = (self.bytes + b" ".join(group[-1][-5:]) + b" ")[-4:]


def batches(texts: Iterable[str | None]) -> Iterator[tuple[list[list[bytes]], Carried]]:
    """Groups of texts of BATCH_BYTES together, as lists of tokens; a long text piece by piece, with
    what is carried from one to the next."""
    group, size = [], 0
    for text in texts:
        if text is not None and len(text) > SEGMENT // 4:
            carried = Carried()
            for tokens in segments(text):
                yield [tokens], carried
            continue
        group.append(next(segments(text)))
        size += len(text or "") + 1
        if size >= BATCH_BYTES:
            yield group, Carried()
            group, size = [], 0
    if group:
        yield group, Carried()


def counted(key: np.ndarray, c: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and their counts."""
    if c is None:
        key = np.sort(key)
        start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])[: len(key)])
        return key[start], np.diff(np.append(start, len(key)))
    order = np.argsort(key, kind="stable")
    key = key[order]
    start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return key[start], np.add.reduceat(c[order], start)


def merged(keys: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    return keys[0] if len(keys) == 1 else counted(np.concatenate([k for k, _ in keys]), np.concatenate([c for _, c in keys]))


def tables(parts_of: DataFrame, n: int) -> np.ndarray:
    """The state byte of every slot. What comes to the driver has the tables' fixed size."""

    def run(found):
        held: dict[int, np.ndarray] = {}
        for s in found:
            for chunk, data in zip(s["chunk"], s["data"], strict=True):
                m = len(data) // 10
                at, c = np.frombuffer(data, np.uint16, m).astype(np.int64), np.frombuffer(data, np.int32, 2 * m, 2 * m).reshape(2, m)
                own = held.setdefault(chunk, np.zeros((2, 1 << CHUNK_BITS), np.int64))
                own[:, at] += c
        for chunk, (n0, n1) in held.items():
            yield {"chunk": [chunk], "states": [state_byte(n0, n1).tobytes()]}

    out = np.zeros(int(OFFSETS[-1]), np.uint8)
    for r in map_arrow(parts_of.repartition(n, "chunk"), run, "chunk int, states binary").collect():
        out[r["chunk"] << CHUNK_BITS : (r["chunk"] + 1) << CHUNK_BITS] = np.frombuffer(r["states"], np.uint8)
    return out


def exact(context: np.ndarray, data: np.ndarray, weight: np.ndarray, tree: Tree) -> tuple[np.ndarray, np.ndarray]:
    """The state bytes of all decisions of the bytes, counted behind equal contexts (told apart by 56
    bits), and where each byte's decisions begin. The bytes of a node's subtree are neighbours in the
    order of the leaves, so a sorted run is a node."""
    key = (context << np.uint64(8)) | tree.rank[data]
    order = np.argsort(key)
    ctx = key[order] >> np.uint64(8)
    del key
    ctx = np.cumsum(np.concatenate([[False], ctx[1:] != ctx[:-1]]), dtype=np.int32) if len(ctx) else ctx
    w, sym = weight[order].astype(np.float64), data[order]
    length, first = tree.length16[sym], tree.first32[sym]
    ends = np.cumsum(tree.length16[data], dtype=np.int64)
    begin = ends - tree.length16[data]
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    del ends
    at = np.arange(len(sym), dtype=np.int32)
    for t in range(int(length.max()) if len(sym) else 0):
        at = at[length[at] > t]
        place = first[at] + np.int32(t)
        node, own, mass = tree.node32[place], ctx[at], w[at]
        start = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (node[1:] != node[:-1])]))
        every, one = np.add.reduceat(mass, start), np.add.reduceat(mass * tree.bit8[place], start)
        out[begin[order[at]] + t] = np.repeat(state_byte(every - one, one), np.diff(np.append(start, len(at))))
    return out, begin


def prefixes(tokens: list[bytes], before: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all words with their blanks, the word of each, its place, and the hash of the state
    and the word so far."""
    data = np.frombuffer(b" ".join(tokens) + b" ", np.uint8)
    lengths = np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1
    starts = np.cumsum(lengths) - lengths
    row = np.repeat(np.arange(len(tokens)), lengths)
    place = np.arange(len(data)) - starts[row]
    each = mix64((place.astype(np.uint64) << np.uint64(8)) + data + np.uint64(1 << 40))
    upto = np.cumsum(each) - each
    return data, row, place, mix64(upto - upto[starts][row] + (np.asarray(before).astype(np.uint64)[row] + np.uint64(1)) * GOLDEN)


def keys_of(tokens: list[bytes], before) -> np.ndarray:
    """64-bit hashes of pairs of word and state."""
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, tokens), np.uint64, len(tokens))
    return mix64(h + (np.asarray(before).astype(np.uint64) + np.uint64(1)) * GOLDEN)


class Heads:
    """State bytes of the heads of words (``crowded``), counted over the whole corpus."""

    def __init__(self, rows: list, tree: Tree):
        # The state 0 counts all words, whatever stood before them.
        every: Counter = Counter()
        for r in rows:
            every[bytes(r["head"]), 0] += r["c"]
            if r["before"]:
                every[bytes(r["head"]), r["before"]] += r["c"]
        heads, before = [h for h, _ in every], np.array([b for _, b in every], np.int64)
        # Heads end with their word's blank or go on; either way their bytes are all that is read.
        data, row, place, ctx = prefixes(heads, before)
        own = place < np.fromiter(map(len, heads), np.int64, len(heads))[row]
        states, begin = exact(ctx[own], data[own], np.fromiter(every.values(), np.int64, len(every))[row[own]], tree)
        starts = np.flatnonzero(np.concatenate([[True], row[own][1:] != row[own][:-1]])) if len(heads) else np.empty(0, np.int64)
        key = keys_of(heads, before)
        order = np.argsort(key)
        self.key, self.begin, self.states = key[order], begin[starts][order], states

    def fill(self, out: np.ndarray, begin: np.ndarray, size: np.ndarray, heads: list[bytes], before: np.ndarray) -> None:
        """Writes the states of the heads' decisions to ``out`` at ``begin``, ``size`` of each."""
        at = self.begin[np.searchsorted(self.key, keys_of(heads, before))]
        out[squeeze(begin, size)] = self.states[squeeze(at, size)]


def crowded(pairs: DataFrame, most: int = CROWDED) -> list[set[bytes]]:
    """Beginnings of words that more than ``most`` pairs have, of LOCAL bytes, LOCAL + 1 and so on. A word's
    head is its shortest beginning of LOCAL bytes or more, its blank counted, that is none of them: so
    few pairs have the same, and heads are few more than the pairs by ``most``, times the bytes."""
    levels: list[set[bytes]] = []
    size, step, rows = LOCAL, 1, pairs.select("w")
    while size <= DEEPEST:
        sizes = F.explode(F.sequence(F.lit(size), F.least(F.lit(size + step - 1), F.length("w"))))
        cuts = rows.where(F.length("w") >= size).withColumn("_size", sizes).groupBy("_size", F.expr("substring(w, 1, _size)").alias("_b")).agg(F.count("*").alias("_n"))
        found: dict[int, set[bytes]] = {}
        for r in cuts.where(F.col("_n") > most).select("_size", "_b").collect():
            found.setdefault(r["_size"], set()).add(bytes(r["_b"]))
        levels += [found[k] for k in range(size, size + step) if k in found]
        size += step
        if size - 1 not in found:
            break
        rows = rows.where(F.expr(f"substring(w, 1, {size - 1})").isin([bytearray(b) for b in found[size - 1]]))
        step = 8
    return levels[: DEEPEST - LOCAL + 1]


def head_size(word: bytes, levels: list[set[bytes]]) -> int:
    size = LOCAL
    for level in levels:
        if word[:size] not in level:
            break
        size += 1
    return size


def head_col(levels: list[set[bytes]]):
    """The head of ``w``."""
    size = F.lit(LOCAL + len(levels))
    for k in reversed(range(len(levels))):
        size = F.when(F.expr(f"substring(w, 1, {LOCAL + k})").isin([bytearray(b) for b in levels[k]]), size).otherwise(F.lit(LOCAL + k))
    return F.substring(F.expr("concat(w, binary(' '))"), F.lit(1), size)


def parts_by_head(slices, levels: list[set[bytes]], *more: str):
    """Rows sorted by word, cut anew so that words with the same head are together: w, before, c, and the
    columns ``more``."""
    names = ("before", "c", *more)

    def head(word: bytes) -> bytes:
        return (word + b" ")[: head_size(word, levels)]

    w, rest = [], [[] for _ in names]
    for s in slices:
        w += s["w"]
        for own, name in zip(rest, names, strict=True):
            own += s[name]
        if len(w) >= PART_PAIRS:
            end, last = len(w), head(w[-1])
            while end and head(w[end - 1]) == last:
                end -= 1
            if end:
                yield w[:end], *(np.array(own[:end]) for own in rest)
                for own in (w, *rest):
                    del own[:end]
    if w:
        yield w, *(np.array(own) for own in rest)


class Part:
    """The decisions of words behind states, counted. tokens, before, c: in the order of the words, those of one
    head together; a word and state may be there again. key, count (of the word, whatever stood before
    it), begin and size of their decisions in ``states``, by number; ``number``: of each row."""

    def __init__(self, tokens: list[bytes], before: np.ndarray, c: np.ndarray, sent):
        heads, tree, levels = sent
        word = np.cumsum([i > 0 and w != tokens[i - 1] for i, w in enumerate(tokens)])
        first = np.flatnonzero(np.diff(word, prepend=-1))
        total = np.add.reduceat(c, first)
        # Behind the state 0 all of a word's counts; behind the others its own.
        code, again = np.unique(word[before > 0] * (CLASSES + 1) + before[before > 0], return_inverse=True)
        own = code // (CLASSES + 1)
        every = [tokens[i] for i in first.tolist()]
        every += [every[i] for i in own.tolist()]
        behind = np.concatenate([np.zeros(len(first), np.int64), code % (CLASSES + 1)])
        weight = np.concatenate([total, np.bincount(again, c[before > 0], len(code)).astype(np.int64)])
        self.number = word.copy()
        self.number[before > 0] = len(first) + again
        data, row, place, ctx = prefixes(every, behind)
        size = np.bincount(row, tree.length[data], len(every)).astype(np.int64)
        ends = np.cumsum(size)
        sizes = np.fromiter((head_size(w, levels) for w in every[: len(first)]), np.int64, len(first))
        sizes = np.concatenate([sizes, sizes[own]])
        late = place >= sizes[row]
        early_size = np.bincount(row[~late], tree.length[data[~late]], len(every)).astype(np.int64)
        of, weight = row[late], weight.astype(np.float64)
        del row, place
        states, _ = exact(ctx[late], data[late], weight[of], tree)
        del of, ctx, late
        out = np.zeros(int(ends[-1]), np.uint8)
        out[squeeze(ends - size + early_size, size - early_size)] = states
        del states
        heads.fill(out, ends - size, early_size, [(w + b" ")[:n] for w, n in zip(every, sizes.tolist(), strict=True)], behind)
        turn = tree.bit8.take(tree.decisions(data)[1]).astype(np.int16) << 8
        turn += out
        self.states = TURNED.take(turn)
        self.key, self.count = keys_of(every, behind).view(np.int64), np.concatenate([total, total[own]])
        self.begin, self.size = ends - size, size

    def of(self, rows: np.ndarray) -> np.ndarray:
        """The state bytes of the numbers."""
        return self.states[squeeze(self.begin[rows], self.size[rows])]


def price(pairs: DataFrame, sent) -> DataFrame:
    """pairs: w, before, c, sorted by word. key, c (of the word, whatever stood before it), states: of
    the decisions of the word behind the state, the count of its own bits first."""

    def run(slices):
        for tokens, before, c in parts_by_head(slices, sent.value[2]):
            part = Part(tokens, before, c, sent.value)
            wanted = np.unique(part.number)
            for i in range(0, len(wanted), 20_000):
                rows = wanted[i : i + 20_000]
                offsets = np.concatenate([[0], np.cumsum(part.size[rows])]).astype(np.int32)
                column = pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(part.of(rows).tobytes())])
                yield {"key": part.key[rows], "c": part.count[rows], "states": column}

    return map_arrow(pairs, run, "key long, c long, states binary")


PACKED = "block int, key binary, c binary, sizes binary, states binary"


def price_blocks(pairs: DataFrame, sent) -> DataFrame:
    """As ``price``, for each block that has the pairs: pairs: w, before, span, mask, c, sorted by word. Of a part
    of the pairs a row a block, of packed, compressed arrays."""

    def run(slices):
        squash = zstandard.ZstdCompressor(level=1).compress
        for tokens, before, c, span, mask in parts_by_head(slices, sent.value[2], "span", "mask"):
            part = Part(tokens, before, c, sent.value)
            order = np.argsort(span, kind="stable")
            for rows in np.split(order, np.flatnonzero(np.diff(span[order])) + 1):
                marks, number = mask[rows].view(np.uint64), part.number[rows]
                for bit in range(SPAN):
                    own = number[(marks >> np.uint64(bit) & np.uint64(1)).astype(bool)]
                    if len(own):
                        arrays = part.key[own], part.count[own], part.size[own].astype(np.int32), part.of(own)
                        yield {"block": [int(span[rows[0]]) * SPAN + bit]} | {n: [squash(x.tobytes())] for n, x in zip(("key", "c", "sizes", "states"), arrays, strict=True)}

    return map_arrow(pairs, run, PACKED)


# --- scores -------------------------------------------------------------------------------------


class Readers:
    """The weights and refinements of texts that are read side by side."""

    def __init__(self, n: int):
        self.weight = np.tile(START[:, None], (1, n * GATES))
        self.seen = np.zeros(n * GATES, np.float32)
        self.shift = np.zeros(n * CELLS, np.float32)
        self.mass = np.full(n * CELLS, CELL_PRIOR, np.float32)
        self.cost = np.zeros(n)
        self.read = np.zeros(n, np.int64)

    def window(self, x: list[np.ndarray], sign: np.ndarray, gate: np.ndarray, text: np.ndarray, lengths: np.ndarray) -> None:
        """Reads decisions: x: for each context the stretched predictions; sign 1 or -1; gate; text:
        numbers of the texts in order, lengths: decisions of each. Then takes the steps."""
        starts = np.cumsum(lengths) - lengths
        first, n = int(text[0]), int(text[-1]) + 1 - int(text[0])
        own = np.repeat(text - first, lengths)
        vector = own * GATES + gate
        part = slice(first * GATES, (first + n) * GATES)
        weight = self.weight[:, part]
        z = weight[0].take(vector, mode="clip") * x[0]
        for k in range(1, K):
            z += weight[k].take(vector, mode="clip") * x[k]
        cell = np.clip(z + np.float32(CELLS // 2), 0, CELLS - 1).astype(np.int64)
        cell += own * CELLS
        cells = slice(first * CELLS, (first + n) * CELLS)
        z += self.shift[cells].take(cell, mode="clip")
        np.clip(z, -30, 30, out=z)
        z *= -sign
        np.exp(z, out=z)  # odds against what came
        one = z + 1
        away = z / one
        bend = away / one
        away *= sign
        self.cost[text] += np.add.reduceat(np.log(one, out=one), starts, dtype=np.float64)
        self.seen[part] += np.bincount(vector, minlength=n * GATES)
        step = RATE / (PRIOR + CURVE * self.seen[part])
        for k in range(K):
            weight[k] += (step * np.bincount(vector, away * x[k], n * GATES)).astype(np.float32)
        self.mass[cells] += np.bincount(cell, bend, n * CELLS).astype(np.float32)
        self.shift[cells] += (RATE * np.bincount(cell, away, n * CELLS) / self.mass[cells]).astype(np.float32)


def borders(start: int, end: int) -> list[int]:
    """Ends of the windows of a text in which ``start`` decisions were read, up to ``end``."""
    out, at = [0], 0
    while at < end:
        at += min(max(WINDOW, at // 8), WINDOW_MOST)
        if at > start:
            out.append(at)
    return [start, *out[1:]]


def read(readers: Readers, tree: Tree, table_of: np.ndarray, data: np.ndarray, at_slot: list[np.ndarray], words: np.ndarray, begin: np.ndarray, size: np.ndarray, ends: np.ndarray) -> None:
    """Reads texts side by side. data: their bytes; at_slot: places in the tables for each byte;
    words: state bytes of words, own bits first, of which each token's are ``size`` from ``begin``; ends: of each
    text's tokens."""
    kind = np.int32 if len(words) < 1 << 31 else np.int64
    word = words.take(squeeze(begin.astype(kind), size.astype(kind)))
    # Decisions that the word so far has settled are priced by its counts alone.
    texts = np.concatenate([[0], np.cumsum(size)[ends - 1]])
    readers.cost += np.add.reduceat(SURE_COST.take(word), texts[:-1], dtype=np.float64)
    own = np.flatnonzero(~SURE.take(word))
    upto = np.searchsorted(own, texts)
    sizes = np.diff(upto)
    done = int(readers.read[0])
    edge = np.array(borders(done, done + int(sizes.max()))) - done
    windows = []
    for low, high in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        text = np.flatnonzero(sizes > low)
        windows.append((text, np.minimum(sizes[text], high) - low, upto[text] + low))
    # From here on the decisions are in the order of the windows.
    own = own.take(np.concatenate([squeeze(starts, lengths) for _, lengths, starts in windows])) if windows else own
    byte, path = (x.take(own) for x in tree.decisions(data))
    bit, node = tree.bit8.take(path), tree.node32.take(path)
    states = np.empty((K, len(own)), np.uint8)
    turn = bit.astype(np.int16) << 8
    turn += word.take(own)
    np.take(TURNED, turn, out=states[K - 1], mode="clip")
    del path, own, word, turn
    for k in range(K - 1):
        place = at_slot[k].take(byte)
        place ^= node
        np.take(table_of, place, out=states[k], mode="clip")
    del byte, node, place
    at = 0
    for text, lengths, _ in windows:
        part = slice(at, at := at + int(lengths.sum()))
        x = [STRETCH.take(states[k, part], mode="clip") for k in range(K)]
        readers.window(x, SIGN.take(bit[part], mode="clip"), GATE.take(states[K - 1, part], mode="clip"), text, lengths)
    readers.read += sizes


class Block:
    """Scores the documents of a block. keys, counts, states: of the pairs of word and state."""

    def __init__(self, model, keys: np.ndarray, counts: np.ndarray, begin: np.ndarray, states: np.ndarray):
        self.states, self.tree, self.table, self.total, self.distinct = model
        states_of = self.states
        order = np.argsort(keys)
        self.keys, self.counts, self.begin, self.words = keys[order], counts[order], begin[order], states
        self.names = states_of.names()
        self.known = 0
        self.found = np.full((1024, CLASSES + 1), -1, np.int32)
        self.size = np.zeros(1024, np.int64)

    def grow(self, new: list[bytes]) -> None:
        """Room for new words, and their decisions."""
        since, self.known = self.known, self.known + len(new)
        if self.known > len(self.size):
            more = max(self.known, len(self.size) * 5 // 4) - len(self.size)
            self.found = np.concatenate([self.found, np.full((more, CLASSES + 1), -1, np.int32)])
            self.size = np.concatenate([self.size, np.zeros(more, np.int64)])
        data = np.frombuffer(b" ".join(new) + b" ", np.uint8)
        ends = np.flatnonzero(data == 32) + 1
        self.size[since : self.known] = np.add.reduceat(self.tree.length[data], np.concatenate([[0], ends[:-1]]))

    def places(self, group: list[list[bytes]], carried: Carried) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Numbers of the tokens' words, the states, and the place of each (word, state) in the table."""
        ids, state = carried(group, self.names, self.states)
        if len(self.names) > self.known:
            self.grow(list(islice(self.names, self.known, None)))
        at = self.found[ids, state]
        new = np.flatnonzero(at < 0)
        if len(new):
            code, first = np.unique(ids[new] * 8 + state[new], return_index=True)
            first = new[first]
            flat = list(chain.from_iterable(group))
            key = keys_of([flat[i] for i in first.tolist()], state[first])
            self.found[ids[first], state[first]] = np.searchsorted(self.keys, key)
            at = self.found[ids, state]
        return ids, state, at

    def score(self, texts: Iterable[str | None]) -> dict[str, list]:
        out: dict[str, list] = {n: [] for n in ("n_tokens", "n_known", "base_score", "score", "bits_per_byte")}
        mass = self.total + 0.5 * (self.distinct + 1)
        readers, sums = None, np.zeros((4, 0))

        def give():
            if readers is not None:
                score = -readers.cost / np.log(10)
                out["n_tokens"] += sums[0].astype(int).tolist()
                out["n_known"] += sums[1].astype(int).tolist()
                out["base_score"] += sums[2].tolist()
                out["score"] += score.tolist()
                out["bits_per_byte"] += (-score / np.log10(2) / sums[3]).tolist()

        before = None
        for group, carried in batches(texts):
            if carried is not before:
                give()
                readers, sums, before = Readers(len(group)), np.zeros((4, len(group))), carried
            ids, state, at = self.places(group, carried)
            data, lengths, last = spans(group, carried.bytes)
            ends = np.cumsum([len(t) for t in group])
            # An empty piece of a long text has no tokens but the text's end.
            c = self.counts[at]
            for row, v in zip(sums, (np.ones(len(ids)), c > 0, np.log10((c + 0.5) / mass), lengths), strict=True):
                row += np.add.reduceat(np.asarray(v, np.float64), np.concatenate([[0], ends[:-1]]))
            read(readers, self.tree, self.table, data, slots(last, np.repeat(state, lengths)), self.words, self.begin[at], self.size[ids], ends)
            carried.end(group)
        give()
        return out


SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"


def lm_scores(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte."""
    spark = docs.sparkSession
    docs = docs.selectExpr("CAST(doc_id AS LONG) AS doc_id", "text")
    apart = crc_mod_col(F.col("doc_id"), HELD_OUT[0]) == HELD_OUT[1]
    marked = docs.select("text", apart.alias("apart"))
    found = tokens_in(marked)
    sums = {(r["what"], r["b"]): (r["c"], r["n"]) for r in found.where("what > 0").collect()}
    size = sums.get((3, 0), (0, 0))[0]
    names, near = frequent(docs.where(~apart), found, sums.get((1, 0), (0, 0))[1])
    release(found)
    states = States(names, classes(near))
    tree = Tree(np.array([sums.get((2, b), (0, 0))[0] for b in range(256)]))
    blocks, tasks = max(1, -(-size // BLOCK_BYTES)), max(2, -(-size // LEARN_BYTES))
    block = F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int").alias("block")
    dealt = docs.select("text", apart.alias("apart"), block).repartitionById(tasks, F.col("block") % tasks)
    learned = cut(learn(dealt.sortWithinPartitions("block"), states, tree))
    table_of = tables(learned.where("chunk IS NOT NULL").select("chunk", "data"), min(8, parts(spark)))
    # Of a word and state a row, and one more for each further SPAN of blocks that have it.
    pairs = cut(learned.where("w IS NOT NULL").groupBy("w", "before", "span").agg(F.sum("c").alias("c"), F.bit_or("mask").alias("mask")))
    release(learned)
    # Bounded by the bytes and states: LOCAL bytes a head, and more of them a CROWDED pairs.
    levels = crowded(pairs)
    head = head_col(levels)
    heads = Heads(pairs.groupBy(head.alias("head"), "before").agg(F.sum("c").alias("c")).orderBy("head", "before").collect(), tree)
    tasks = max(1, -(-pairs.count() // TASK_PAIRS))
    laid = pairs.repartition(tasks, head).sortWithinPartitions("w", "before")
    totals = pairs.groupBy("w").agg(F.sum("c").alias("c")).agg(F.sum("c"), F.count_if(F.col("c") > 0)).first()
    total, distinct = (int(x or 0) for x in totals)
    known = price_blocks(laid, spark.sparkContext.broadcast((heads, tree, levels)))
    model = spark.sparkContext.broadcast((states, tree, table_of, total, distinct))  # the tables' fixed size

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        kinds = {"key": np.uint64, "c": np.int64, "sizes": np.int32, "states": np.uint8}
        key, c, sizes, flat = (np.frombuffer(b"".join(map(zstandard.ZstdDecompressor().decompress, right[n].to_pylist())), kind) for n, kind in kinds.items())
        found = Block(model.value, key, c, np.cumsum(sizes, dtype=np.int64) - sizes, flat)
        del right, key, c, sizes, flat
        # Long texts first, then the others by size, so that texts read side by side are alike.
        length = pc.fill_null(pc.utf8_length(left["text"]), 0)
        order = np.argsort(-length.to_numpy(), kind="stable")
        ids = left["doc_id"].take(pa.array(order)).to_pylist()
        text = left["text"]  # one at a time: as Python objects all of them take twice the block
        cols = found.score(text[i].as_py() for i in order.tolist())
        held_out = [crc_mod(d, HELD_OUT[0]) == HELD_OUT[1] for d in ids]
        rest = [pa.array(cols[n], t) for n, t in (("base_score", pa.float64()), ("score", pa.float64()), ("bits_per_byte", pa.float64()))]
        return pa.table([pa.array(ids, pa.int64()), pa.array(held_out), pa.array(cols["n_tokens"], pa.int64()), pa.array(cols["n_known"], pa.int64()), pa.array([total] * len(ids), pa.int64()), *rest], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte"])

    rows = docs.select("doc_id", "text", block).repartition(parts(spark), "block")
    return rows.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(score, SCHEMA)


def op10(spark, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"))
