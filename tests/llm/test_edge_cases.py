"""Nulls, empty and repeated rows, clashing columns, ties, empty tables; and results against brute force."""

import math
from collections import Counter

import pytest

from skyledger.llm import common, components, contextmix, htmltext, linedup, media, mixing, neardup, quality, toxicity, urlfilter

LONG = " ".join(f"w{i % 977}x{i // 977}" for i in range(60_000))
ROWS = [(0, "one two three four five six"), (1, None), (2, ""), (3, " \n\t"), (None, "one two three four five six"), (0, "one two three four five six"), (4, LONG), (5, LONG + " tail"), (6, "a b")]
SCHEMA = "doc_id long, text string, source string, lang string, n_chars long, id long, comp long, size long, _k string"


def docs(spark, rows=ROWS):
    return spark.createDataFrame([(d, t, "s" if d else None, None, None, 1, 2, 3, "z") for d, t in rows], SCHEMA)


def labels(spark, rows=((0, 1, 0), (4, 1, 1), (None, 1, 1), (5, None, None))):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")


def test_neardup_edges(spark):
    got = [(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(docs(spark)).collect()]
    assert len(got) == len(ROWS)
    assert (1, 0, 1, True) in got and (2, 0, 2, True) in got and (3, 0, 3, True) in got and (6, 1, 6, True) in got
    assert got.count((0, 2, None, False)) == 2 and (None, 2, None, True) in got  # a null id comes first
    assert [g[2:] for g in got if g[0] == 5] == [(4, False)]
    assert neardup.near_duplicates(docs(spark, [])).count() == 0


def test_neardup_shared_ids_lose_no_link(spark):
    a, b = (" ".join(f"{c}{i}" for i in range(60)) for c in "ab")
    rows = [(1, a), (1, b), (2, a + " more"), (3, b + " more"), (1, None), (9, "alone in the world as it is")]
    got = [(r.doc_id, r.component_id, r.kept) for r in neardup.near_duplicates(docs(spark, rows)).collect()]
    assert sorted(got) == [(1, 1, True)] * 3 + [(2, 1, False), (3, 1, False), (9, 9, True)]


def test_neardup_against_brute_force(spark):
    table = common.table(spark, "/root/testdata/sf0.001", "documents")
    sets = {r["doc_id"]: common.shingles(r["text"]) for r in table.collect()}
    root = {d: d for d in sets}

    def top(x):
        return x if root[x] == x else top(root[x])

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if len(sets[a]) and len(sets[b]) and neardup.similar(sets[a], sets[b]):
                lo, hi = sorted((top(a), top(b)))
                root[hi] = lo
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(table).collect()}
    assert got == {d: (len(sets[d]), top(d), top(d) == d) for d in ids}


def test_superminhash_estimates_similarity():
    a = common.shingles(" ".join(map(str, range(1000))))
    b = common.shingles(" ".join(map(str, range(100, 1000))))
    equal = (neardup.superminhash(a) == neardup.superminhash(b)).mean()
    assert abs(equal - 0.9) < 0.12
    for n in (1, 2, 7, 50):
        assert (neardup.superminhash(a[:n]) != common.M64).all()


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r["node"]: r["component"] for r in components.components(links).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}


def test_linedup_against_brute_force(spark):
    lines = ["a b c d e f g h i", "a b c d X f g h i", "a b c d e f g h", "q a b c d e f g h i", "short line", "a b c d e f g h i", "h a b c d e f g i", "1 2 3 4 5 6 7 8 9 10"]
    rows = [(i, "\n".join(lines[i:] + lines[:i])) for i in range(3)] + [(7, None), (8, ""), (None, lines[7])]
    got = {r["doc_id"]: r["text"] for r in linedup.dedup(docs(spark, rows)).collect()}
    seen, want = [], {}
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        keep = []
        for line in (text or "").split("\n"):
            w = line.split()
            near = [s for s in seen if s == w or (len(w) >= 8 and len(s) >= 8 and linedup.within_one(s, w))]
            if len(w) < 5 or not near:
                keep.append(line)
            if len(w) >= 5:
                seen.append(w)
        want[doc] = None if text is None else "\n".join(keep)
    assert got == want
    assert linedup.dedup(docs(spark, [])).count() == 0


def test_mixing_edges(spark):
    got = mixing.mix(docs(spark)).collect()
    assert len(got) == len(ROWS) and all(r["taken"] <= 3 * r["size"] for r in got)
    by = Counter()
    for r in got:
        by[r["source"]] += r["taken"]
    assert by == {r["source"]: r["budget"] for r in got}
    assert mixing.mix(docs(spark, [])).count() == 0


def test_quality_edges(spark):
    text = "a b c d e f g h " * 3
    assert quality.repeated_words(text.split()) == 24 and quality.repeated_words("a b c".split()) == 0
    got = {r["doc_id"]: r for r in quality.verdicts(docs(spark), labels(spark)).collect()}
    assert got[1]["base_failed"] and not got[1]["kept"] and got[4]["n_words"] == 60_000
    assert quality.verdicts(docs(spark), labels(spark, [])).where("ratio <> 0").count() == 0
    assert quality.verdicts(docs(spark, []), labels(spark)).count() == 0
    assert quality.base("x # y\nx # y\n \nz", b"x # y x # y z".split())[:4] == (7, 7, 2, 1)


def test_media_round_trip(spark):
    for t in (None, "", "x" * 63, "é" * 5000, LONG):
        p, n = media.payload_of(t)
        q, m, _ = media.load(media.store(p, n))
        assert (p, n) == (q, m) and len(p) % 64 == 0 and len(p) >= 64
    assert media.digests(docs(spark)).count() == len(ROWS) and media.digests(docs(spark, [])).count() == 0
    assert media.shots(media.histograms(media.np.array([[[9] * 8] * 8] * 4 + [[[200] * 8] * 8] * 3, "u1"))) == [0, 4]
    bad = spark.createDataFrame([(1, bytearray(b"RIFFxxxx")), (2, None)], "doc_id long, media binary")
    assert [r["error"] is not None for r in media.clips(bad).collect()] == [True]


def test_toxicity_counterfactuals():
    x, y = [[0], [0], [1], [2]] * 20, [1.0, 0.0, 0.0, 1.0] * 20
    import numpy as np

    each = np.full(80, 1 / 80)
    free, _ = toxicity.train(x, np.array(y), each, [], 3, 0.0)
    tied, _ = toxicity.train(x, np.array(y), each, [([0], [1])], 3, 5.0)
    assert abs(tied[0] - tied[1]) < abs(free[0] - free[1]) / 2
    assert ("all women are here", "all men are here") in [(a.strip(), b) for a, b in toxicity.swaps("All women are here. Fine.")]


def test_toxicity_edges(spark):
    got = toxicity.classify(docs(spark), toxicity.fit(docs(spark), labels(spark))).collect()
    assert len(got) == len(ROWS) and all(0 <= r["score"] <= 1 for r in got)
    assert toxicity.classify(docs(spark), toxicity.fit(docs(spark), labels(spark, []))).where("predicted = 1").count() == 0


def test_urls(spark):
    caps = spark.createDataFrame([("http://u@A.b.com:80/x/y", 5, "h"), ("http://a.b.com/z", 5, "h"), ("junk", 5, "h"), (None, 5, "h"), ("http://a.b.com/z", None, "h"), ("http://a.b.com/z", 9, "h")], "url string, fetched int, host string")
    lst = spark.createDataFrame([("b.com", 1, "block"), ("a.b.com", 4, "allow"), ("a.b.com", 9, "clear"), ("a.b.com/x", 5, "block"), ("a.b.com/x", 5, "clear"), (None, 1, "block")], "key string, at int, action string")
    got = [(r["verdict"], r["matched_key"]) for r in urlfilter.evaluate(caps, lst).orderBy("fetched", "url").collect()]
    assert sorted(got, key=str) == sorted([("block", "a.b.com/x"), ("allow", "a.b.com"), ("none", None), ("none", None), ("none", None), ("block", "b.com")], key=str)


@pytest.mark.parametrize("page", [None, "", "   ", "<p", "<script>x", "plain &amp; text"])
def test_pages_do_not_crash(page):
    assert all(b.text.strip() for b in htmltext.blocks(page))


def test_main_text():
    from skyledger.llm.htmlpages import generate

    weights, exact, n = htmltext.trained(), 0, 0
    for page, texts in generate(60, 4711):
        b = htmltext.blocks(page)
        kept = [x.text for x, q in zip(b, htmltext.label([b], weights)[0], strict=True) if q >= 0.5]
        exact, n = exact + (kept == [x.text for x in b if x.text in texts]), n + 1
    assert exact >= 0.85 * n


def test_language_model(spark):
    rows = [*ROWS, *((10 + i, f"the cat sat on the mat {i} the end") for i in range(40))]
    got = contextmix.lm_scores(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    c = Counter()
    for d, t in rows:
        if common.crc_mod(d, 5) != 1:
            c.update(common.words(t))
            c[b""] += 1
    n, v = sum(c.values()), len(c)
    for r in got:
        t = next(t for d, t in rows if d == r["doc_id"])
        want = sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in [*common.words(t), b""])
        assert abs(r["base_score"] - want) < 1e-6 * max(1, abs(want)) and r["train_tokens"] == n and r["score"] < 0
    assert contextmix.lm_scores(docs(spark, [])).count() == 0


def test_language_model_knows_the_state(spark):
    # The held-out "zukxo" is new; only what stands before it tells how it may begin.
    out = [d for d in range(200) if common.crc_mod(d, 5) == 1][:2]
    train = [d for d in range(200) if common.crc_mod(d, 5) != 1][:80]
    rows = [(d, f"der zuk{i} der zuk{i}a" if i % 2 else f"the ban{i} the ban{i}a") for i, d in enumerate(train)]
    rows += [(out[0], "der zukxo"), (out[1], "the zukxo")]
    got = {r["doc_id"]: r["score"] for r in contextmix.lm_scores(docs(spark, rows)).collect()}
    assert got[out[0]] > got[out[1]] + 0.5


def mixed_by_hand(rows):
    """Scores of all rows, with dictionaries, one decision after the other."""
    m64, golden = (1 << 64) - 1, 0x9E3779B97F4A7C15

    def mix(x):
        x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & m64
        x = (x ^ (x >> 27)) * 0x94D049BB133111EB & m64
        return x ^ (x >> 31)

    assert int(common.mix64(contextmix.np.array([12345], "u8"))[0]) == mix(12345)
    read = [([*common.words(t), b""], common.crc_mod(d, 5) != 1) for d, t in rows]
    count, raw = Counter(), [0] * 256
    for (_, text), (tokens, learned) in zip(rows, read, strict=True):
        if learned:
            count.update(tokens)
            for b in (text or "").encode().lower():
                raw[b] += 1
    total = sum(count.values())
    names = sorted(w for w, c in count.items() if w and c >= contextmix.FREQUENT * total)
    follows = contextmix.np.zeros((len(names), len(names)))
    for tokens, learned in read:
        own = [names.index(w) for w in tokens if w in names]
        for a, b in zip(own, own[1:], strict=False):
            follows[a, b] += learned
    logs = contextmix.classes(follows)
    tree = contextmix.Tree(contextmix.np.array(raw))
    spelled = [[(int(tree.node[i]), int(tree.bit[i])) for i in range(tree.first[b], tree.first[b] + tree.length[b])] for b in range(256)]

    def decisions(tokens):
        """(keys of the four contexts, bit) of all decisions."""
        past, last = [], b"    "
        for w in tokens:
            recent = past[-contextmix.RECENT :]
            sums = [round(sum(logs[i][g] for i in recent), 4) for g in range(contextmix.CLASSES)]
            state = 1 + sums.index(max(sums)) if recent else 0
            for at, b in enumerate(w + b" "):
                four = int.from_bytes(last, "big")
                for t, (node, bit) in enumerate(spelled[b]):
                    keys = []
                    for k, bits in enumerate(contextmix.TABLE_BITS):
                        key = (four & ((1 << (8 * (k + 2))) - 1)) | (state << 32)
                        keys.append((k, (mix((key * golden + k) & m64) >> (64 - bits)) ^ node))
                    yield [*keys, (state, w[:at], node, t)], bit, state
                last = last[1:] + bytes([b])
            if w in names:
                past.append(names.index(w))

    seen = Counter()
    for tokens, learned in read:
        for keys, bit, state in decisions(tokens) if learned else ():
            for key in keys:
                seen[key, bit] += 1
            if state:
                seen[(0, *keys[3][1:]), bit] += 1
    steps = contextmix.STEPS.tolist()
    step = lambda n: max(s for s in steps if s <= n)
    scores = []
    for tokens, _ in read:
        weight = [[float(x) for x in contextmix.START] for _ in range(4)]
        used, shift, mass = [0] * 4, [0.0] * contextmix.CELLS, [contextmix.CELL_PRIOR] * contextmix.CELLS
        every, at, cost = [], 0, 0.0
        for keys, bit, state in decisions(tokens):
            a, b = (step(seen[keys[3], i]) for i in (0, 1))
            if min(a, b) == 0 and max(a, b) >= contextmix.SETTLED:
                cost += math.log(((b if bit else a) + 0.4) / (a + b + 0.8))
            else:
                every.append((keys, bit, state))
        while at < len(every):
            window = every[at : at + min(max(contextmix.WINDOW, at // 8), contextmix.WINDOW_MOST)]
            at += len(window)
            pull, times, errs, bends = [[0.0] * 4 for _ in range(4)], [0] * 4, [0.0] * contextmix.CELLS, [0.0] * contextmix.CELLS
            for keys, bit, _ in window:
                pairs = [(step(seen[key, 0]), step(seen[key, 1])) for key in keys]
                x = [math.log((b + 0.4) / (a + 0.4)) for a, b in pairs]
                most = max(pairs[3])
                gate = sum(most >= n for n in (1, 3, 9))
                z = sum(w * v for w, v in zip(weight[gate], x, strict=True))
                cell = int(min(max(z + contextmix.CELLS // 2, 0), contextmix.CELLS - 1))
                p = 1 / (1 + math.exp(-(z + shift[cell])))
                cost += math.log(p if bit else 1 - p)
                for k in range(4):
                    pull[gate][k] += (bit - p) * x[k]
                times[gate] += 1
                errs[cell] += bit - p
                bends[cell] += p * (1 - p)
            for g in range(4):
                used[g] += times[g]
                for k in range(4):
                    weight[g][k] += contextmix.RATE * pull[g][k] / (contextmix.PRIOR + contextmix.CURVE * used[g])
            for c in range(contextmix.CELLS):
                mass[c] += bends[c]
                shift[c] += contextmix.RATE * errs[c] / mass[c]
        scores.append(cost / math.log(10))
    return scores


def some_texts():
    import random

    rnd = random.Random(3)
    kinds = [["the", "of", "and", "bird", "Tree", "water"], ["der", "die", "und", "vogel", "baum", "straße"]]
    texts = ["", None, "the", " \n", "end", "Zz" * 40]
    for i in range(60):
        kind = kinds[i % 2]
        texts.append(" ".join(rnd.choice(kind) + rnd.choice(["", "", "", str(rnd.randrange(30)), "s"]) for _ in range(rnd.choice([3, 30, 120]))))
    return texts


def test_language_model_against_brute_force(spark):
    rows = list(enumerate(some_texts()))
    want = mixed_by_hand(rows)
    got = {r["doc_id"]: r["score"] for r in contextmix.lm_scores(docs(spark, rows)).collect()}
    for (d, _), w in zip(rows, want, strict=True):
        assert abs(got[d] - w) < 2e-4 * max(1, abs(w)), d


def test_language_model_does_not_depend_on_the_cut(spark, monkeypatch):
    rows = list(enumerate(some_texts()))
    want = {r["doc_id"]: r["score"] for r in contextmix.lm_scores(docs(spark, rows)).collect()}
    for name, value in (("FLUSH_TOKENS", 100), ("FLUSH_KEYS", 50), ("BLOCK_BYTES", 700), ("PART_PAIRS", 20), ("TASK_PAIRS", 60), ("BATCH_BYTES", 900), ("LEARN_BYTES", 5000)):
        monkeypatch.setattr(contextmix, name, value)
    got = {r["doc_id"]: r["score"] for r in contextmix.lm_scores(docs(spark, rows)).collect()}
    assert all(abs(got[d] - want[d]) < 1e-4 * max(1, abs(want[d])) for d in want)


def test_long_texts_are_read_in_pieces(monkeypatch):
    long = " ".join(some_texts()[7].split() * 300)
    whole = list(contextmix.segments(long))
    monkeypatch.setattr(contextmix, "SEGMENT", 1000)
    pieces = list(contextmix.segments(long))
    assert len(whole) == 1 and len(pieces) > 3 and [w for p in pieces for w in p] == whole[0]
    # What is before each byte, and the states, are the same in pieces.
    states = contextmix.States([b"the", b"der"], contextmix.np.log(contextmix.np.array([[0.9, 0.1], [0.2, 0.8]])))
    own, carried = contextmix.Carried(), contextmix.Carried()
    at_once = own([whole[0]], states.names(), states)[1]
    before = contextmix.spans([whole[0]])[2]
    got, after = [], []
    for p in pieces:
        got += carried([p], states.names(), states)[1].tolist()
        after += contextmix.spans([p], carried.bytes)[2].tolist()
        carried.end([p])
    assert got == at_once.tolist() and after == before.tolist()


def test_word_contexts_have_their_own_counts():
    import numpy as np

    tree = contextmix.Tree(np.arange(256))
    # More contexts than any table of fixed size told apart; each was seen once.
    tokens = [b"abc%06d" % i for i in range(200_000)]
    data, row, place, ctx = contextmix.prefixes(tokens, np.zeros(len(tokens), np.int64))
    states, begin = contextmix.exact(ctx, data, np.ones(len(data), np.int64), tree)
    last = begin[data == 32]  # the blank: all of the word is before it
    assert len(last) == len(tokens) and (contextmix._N0 + contextmix._N1)[states[last]].max() == 1
    a, b = [b"abcd", b"abce", b"abcd"], np.array([1, 1, 2])
    data, row, place, ctx = contextmix.prefixes(a, b)
    states, begin = contextmix.exact(ctx, data, np.array([1, 2, 4])[row], tree)
    of = lambda word, at: [(int(contextmix._N0[x]), int(contextmix._N1[x])) for x in states[begin[(row == word) & (place == at)][0] :][: tree.length[a[word][at]]]]
    assert sum(of(0, 3)[0]) == 3 and sum(of(1, 3)[0]) == 3 and sum(of(2, 3)[0]) == 4
    assert {sum(x) for x in of(0, 0)} == {3} and {sum(x) for x in of(2, 0)} == {4}


def test_short_lines_are_compared(spark, tmp_path):
    import corpus_pipeline

    rows = [(0, "}\na b c d\na b c d e\n \nfirst"), (1, "}\n\na b c d\n}\na b c X e\n \nx"), (2, "a  b c d\nz\n}\na b c d e f g"), (3, "}\n}"), (None, "z\na b c")]
    seen, want, gone = [], {}, {}
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        keep = []
        for line in text.split("\n"):
            w = line.split()
            if not w or not any(s == w or (min(len(s), len(w)) >= 5 and linedup.within_one(s, w)) for s in seen):
                keep.append(line)
            seen += [w] if w else []
        want[doc], gone[doc] = "\n".join(keep), len(text.split("\n")) - len(keep)
    assert gone == {None: 0, 0: 0, 1: 4, 2: 3, 3: 2}
    docs(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    assert {r["doc_id"]: r["n_lines_removed"] for r in linedup.op8(spark, str(tmp_path)).collect()} == gone
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.line_dedup(spark, docs(spark, rows).drop("_k"), "").collect()}
    assert got == {d: t for d, t in want.items() if t.split()}


@pytest.mark.parametrize("page", ["<html><head><title>t</title><meta a=b><body><p>some text", "<head><link x><style>p{}</style><p>some text</p>", "<head><template><div>no</div></template></head><p>some text"])
def test_open_head_ends(page):
    assert [b.text for b in htmltext.blocks(page)] == ["some text"]


def test_digits_count_over_the_whole_block():
    tail = "a" * 200 + " " + "1" * 200
    (b,) = htmltext.blocks(f"<p>{tail}</p>")
    assert abs(htmltext.vectors([b])[0, htmltext.PATH_DIM + htmltext.WORD_DIM + 4] - 200 / 401) < 1e-6


def test_urls_empty_tables_repeats_and_names(spark):
    caps = spark.createDataFrame([("http://a.com/z", 70 * 86400, 1, 2)] * 2 + [("http://a.com/z", 2, 3, 4)], "url string, fetched int, _h int, `_h2` int")
    none = spark.createDataFrame([], "key string, at int, action string")
    assert [r["verdict"] for r in urlfilter.evaluate(caps, none).collect()] == ["none"] * 3
    # An entry of an earlier span of time is carried; an old one is overruled.
    lst = spark.createDataFrame([("a.com", 3, "allow"), ("a.com", 4, "block"), ("a.com", 200 * 86400, "clear")], "key string, at int, action string")
    got = urlfilter.evaluate(caps, lst)
    assert sorted((r["fetched"], r["verdict"], r["valid_from"], r["_h"], r["_h2"], r["host"]) for r in got.collect()) == [(2, "none", None, 3, 4, "a.com")] + [(70 * 86400, "block", 4, 1, 2, "a.com")] * 2
    assert urlfilter.evaluate(caps.where("false"), lst).count() == 0


def test_urls_against_brute_force(spark):
    import random

    rnd = random.Random(5)
    entries = [(rnd.choice(["a.com", "x.a.com", "x.a.com/p"]), rnd.randrange(400) * 86400, rnd.choice(["block", "allow", "clear"])) for _ in range(60)]
    caps = [(rnd.choice(["http://x.a.com/p/1", "http://x.a.com/q", "http://a.com/p", "http://b.com/"]), rnd.randrange(400) * 86400) for _ in range(200)]

    def verdict(url, t):
        host = url.split("/")[2]
        labels = host.split(".")
        for key in [host + "/" + url.split("/")[3], *[".".join(labels[i:]) for i in range(max(1, len(labels) - 1))]]:
            past = [(a, -urlfilter.ACTIONS.index(x), x) for k, a, x in entries if k == key and a <= t]
            if past and max(past)[2] != "clear":
                return max(past)[2], key, max(past)[0]
        return "none", None, None

    got = urlfilter.evaluate(spark.createDataFrame(caps, "url string, fetched int"), spark.createDataFrame(entries, "key string, at int, action string")).collect()
    assert len(got) == 200
    assert {(r["url"], r["fetched"]): (r["verdict"], r["matched_key"], r["valid_from"]) for r in got} == {c: verdict(*c) for c in caps}


CLASH = "doc_id long, text string, source string, n_chars long, lang string, gone int, _gone_k int, n_lines_removed string, _k int, _gone int, _id int, _copy int, _times int, kept int, ratio int, _removed int, n_words int"


def test_clashing_columns_are_handed_on(spark):
    import corpus_pipeline

    words = [f"w{i}" for i in range(40)]
    lines = "\n".join(" ".join(words[i : i + 8]) for i in range(0, 40, 8))
    rest = tuple(range(10, 22))
    rows = [(1, lines, "s", 5, "en", *rest), (2, lines + "\nnew words in this line here", "s", 5, "en", *rest), (None, None, None, None, None, *rest), (3, "", "s", 0, "en", *rest)]
    rows = [(*r[:7], "x", *r[8:]) for r in rows]
    table = spark.createDataFrame(rows, CLASH)
    out = linedup.dedup(table, **linedup.WHOLE)
    assert sorted(r["n_lines_removed"] for r in out.collect()) == [0, 0, 0, 5]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        for df in (table, table.where("false")):
            if name == "quality rules":
                from skyledger.llm import quality as q

                got = q.passed(df, q.fit(df, labels(spark)))
            else:
                got = stage(spark, df, "")
            assert got.columns == table.columns, name
            for r in got.collect():
                assert (r["n_lines_removed"], r["gone"], r["_gone"], r["_times"], r["_copy"], r["kept"], r["_removed"]) == ("x", 10, 14, 17, 16, 18, 20), name
    scored = quality.score(table, quality.np.zeros(1 << 4, "f4"), keep=table.columns)
    assert "ratio" in scored.columns and scored.count() == 4


def test_clips_are_timed():
    import json

    still = media.np.array([[[9] * 8] * 8] * 4 + [[[200] * 8] * 8] * 3, "u1")
    assert media.timed_clips(media.shots(media.histograms(still)), 7, 25) == [(0, 0, 3, 0.0, 160.0), (1, 4, 6, 160.0, 280.0)]
    row = media.digest(media.store(*media.payload_of("a" * 9000 + "Z" * 9000)))
    timed = json.loads(row[-1])
    assert [c["clip"] for c in timed] == list(range(row[-2])) and timed[0]["start_ms"] == 0


def quality_by_hand(text, raw, good, n_bits=quality.N_BITS):
    """The mean log ratio of a text's hashed token n-grams, by dictionaries."""
    total, trusted = sum(raw.values()), sum(good.values())
    each = [math.log((good[b] + quality.SMOOTHING) / (raw[b] * trusted / total + quality.SMOOTHING)) for b in grams_by_hand(text)]
    return sum(each) / len(each) if each else 0.0


def grams_by_hand(text, n_bits=quality.N_BITS):
    import re

    import xxhash

    tokens = []
    for w in (text or "").encode().split():
        head, core, tail = re.match(r"^(\W*)(.*?)(\W*)$", w.decode(), re.S).groups()
        tokens += ["m" + head] if head else []
        if core:
            tokens.append("w" + core.lower())
            if core != core.lower():
                tokens.append("c" + ("U" if core == core.upper() and len(core) > 1 else "T" if core[1:] == core[1:].lower() else "M"))
        tokens += ["m" + tail] if tail else []
    h = [xxhash.xxh32_intdigest(t.encode()) for t in tokens]
    m = (1 << 64) - 1
    uni = [(x * 0x9E3779B97F4A7C15 & m) >> (64 - n_bits) for x in h]
    two = [1 if a == b else ((a * 0xC2B2AE3D27D4EB4F + b) * 0x9E3779B97F4A7C15 & m) >> (64 - n_bits) for a, b in zip(h, h[1:], strict=False)]
    return uni + two


def test_quality_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    table, marks = common.table(spark, sf, "documents"), common.table(spark, sf, "labels")
    trusted = {r["doc_id"] for r in marks.where("quality = 1").collect()}
    raw, good = Counter(), Counter()
    texts = {r["doc_id"]: r["text"] for r in table.collect()}
    for d, t in texts.items():
        raw.update(grams_by_hand(t))
        if d in trusted:
            good.update(grams_by_hand(t))
    for r in quality.verdicts(table, marks).collect():
        t = texts[r["doc_id"]]
        ratio = quality_by_hand(t, raw, good)
        assert abs(r["ratio"] - ratio) < 1e-5
        words = (t or "").encode().split()
        seen, hit = {}, set()
        for i in range(len(words) - 7):
            seen.setdefault(tuple(words[i : i + 8]), []).append(i)
        for at in seen.values():
            if len(at) > 1:
                hit.update(x for i in at for x in range(i, i + 8))
        failed = len(words) < 20 or 100 * len(hit) > 30 * len(words)
        assert (r["n_words"], r["n_repeat_words"], r["base_failed"]) == (len(words), len(hit), failed)
        if abs(ratio - quality.THRESHOLD) > 1e-5:
            assert r["kept"] == (not failed and ratio >= quality.THRESHOLD)
