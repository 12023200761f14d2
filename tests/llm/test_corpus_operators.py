"""Each operator against brute force, with odd cases and empty tables."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from loupe.llm import components, op1_shard, op2_mix, op3_decontaminate, op4_suffix, op5_near, op6_substring, op7_chat, op8_tokens, op9_warc, op10_quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(texts):
    """Rows whose ids are neither null nor shared by different texts."""
    ids = defaultdict(set)
    for i, t in texts:
        ids[i].add(t)
    return [(i, t) for i, t in dict.fromkeys(texts) if i is not None and len(ids[i]) == 1]


# -- 1


def test_tightest_fit_is_best_fit():
    rng = random.Random(1)
    sizes = sorted((rng.randint(1, 60) for _ in range(300)), reverse=True)
    runs, bins = op1_shard.pack(sorted(Counter(sizes).items(), reverse=True), 100)
    room: list[int] = []
    for s in sizes:
        fits = [(r, i) for i, r in enumerate(room) if r >= s]
        if fits:
            room[min(fits)[1]] -= s
        else:
            room.append(100 - s)
    assert bins == len(room)
    held = Counter()
    for s, a, b, k in runs:
        held[k] += s * (b - a + 1)
    assert [100 - held[k] for k in range(bins)] == room


def test_unlisted_categories_keep_their_share():
    cells = {("src1", "en", "0"): 600, (op2_mix.OTHER, "en", "0"): 200, ("src2", op2_mix.OTHER, "1"): 200}
    want = op2_mix.targets_of(op2_mix.PRODUCTION.source, {"src1": 600.0, "src2": 200.0, op2_mix.OTHER: 200.0})
    assert want[op2_mix.OTHER] == pytest.approx(0.2) and want["src1"] == pytest.approx(0.4) and sum(want.values()) == pytest.approx(1)
    p = op2_mix.raked(cells, op2_mix.PRODUCTION)
    assert all(v > 0.1 for v in p.values())


def test_no_byte_of_slack_is_wasted(monkeypatch):
    tried, pack = {}, op1_shard.pack

    def noted(classes, capacity, most=None):
        tried[capacity] = pack(classes, capacity, most)
        return tried[capacity]

    monkeypatch.setattr(op1_shard, "pack", noted)
    got = op1_shard.shard_balanced([(997, 5), (611, 7), (503, 6), (211, 3)], 6)
    best = min(c for c, found in tried.items() if found)
    assert tried[best - 1] is None and Counter(r[0] for r in got for _ in range(r[1], r[2] + 1)) == {997: 5, 611: 7, 503: 6, 211: 3}


def test_shards(docs_of, texts):
    got = op1_shard.shards(docs_of(texts), 4).collect()
    assert len(got) == len(texts)
    assert sorted((r["size"], r["text_crc32"]) for r in got) == sorted((len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for _, t in texts)
    by, where, loads = defaultdict(list), defaultdict(set), Counter()
    for r in got:
        by[r["shard"]].append(r["slot"])
        where[r["text_crc32"]].add(r["shard"])
        loads[r["shard"]] += r["size"]
    assert set(by) <= set(range(4)) and all(sorted(s) == list(range(len(s))) for s in by.values())
    assert all(len(s) == 1 for s in where.values())
    assert max(loads.values()) <= max(-(-sum(loads.values()) // 4) * 1.1, 8 + max(len((t or "").encode()) for _, t in texts))


def test_a_hot_text_is_cut_into_pieces(docs_of):
    rows = [(i, "same text") for i in range(900)] + [(1000 + i, f"other {i}") for i in range(100)]
    got = op1_shard.shards(docs_of(rows), 5).collect()
    loads = Counter()
    for r in got:
        loads[r["shard"]] += r["size"]
    assert max(loads.values()) - min(loads.values()) <= 40


def test_no_shards(docs_of):
    assert op1_shard.shards(docs_of([]), 3).count() == 0


# -- 2


def test_raking_meets_marginals():
    rng = random.Random(3)
    cells = {(s, l, t): rng.randint(50, 500) for s in ("src0", "src1") for l in ("en", "fr") for t in ("0", "1")}
    mix = op2_mix.Mix(op2_mix.Target({"src0": 0.4, "src1": 0.6}), op2_mix.Target({"en": 0.5, "fr": 0.5}), op2_mix.Target(dict.fromkeys(("0", "1"))), 0.3)
    p = op2_mix.raked(cells, mix)
    mass = {k: cells[k] * p[k] for k in cells}
    total = sum(mass.values())
    assert all(0 < x <= 1 for x in p.values())
    assert abs(total / sum(cells.values()) - 0.3) < 1e-6
    assert abs(sum(m for k, m in mass.items() if k[0] == "src0") / total - 0.4) < 1e-6
    assert abs(sum(m for k, m in mass.items() if k[1] == "en") / total - 0.5) < 1e-6


def plain_raking(cells, targets, share, rounds=2000):
    """The same fit, cell by cell: scale to each marginal in turn, and give no more than there is."""
    mass = {k: n * share for k, n in cells.items()}
    budget = sum(cells.values()) * share
    for _ in range(rounds):
        for d, want in enumerate(targets):
            got = defaultdict(float)
            for k, m in mass.items():
                got[k[d]] += m
            mass = {k: min(m * want[k[d]] * budget / got[k[d]], cells[k]) if got[k[d]] else 0.0 for k, m in mass.items()}
    return {k: m / cells[k] for k, m in mass.items()}


def mixed_by_hand(rows, topics, mix):
    """(id, text) -> cell, tokens, probability and decision of rows (doc_id, source, lang, text)."""
    import xxhash

    named = {c: set(getattr(mix, c).shares) for c in ("source", "lang", "topic")}
    facts, cells = {}, Counter()
    for i, source, lang, text in rows:
        words = (text or "").encode().split()
        topic = 0
        if words:
            v = np.zeros(op2_mix.CELLS)
            for w in words:
                v[int(op2_mix.mixed(np.array([xxhash.xxh3_64_intdigest(w)], np.uint64))[0]) % op2_mix.CELLS] += 1
            v = np.log1p(v)
            topic = int(np.argmax(topics.centres @ (v / np.sqrt((v * v).sum()) - topics.mean)))
        cell = (source if source in named["source"] else op2_mix.OTHER, lang if lang in named["lang"] else op2_mix.OTHER, str(topic))
        cells[cell] += len(words)
        facts[i, text] = cell, len(words)
    held = {k: n for k, n in cells.items() if n}
    targets = []
    for d, name in enumerate(("source", "lang", "topic")):
        seen = Counter()
        for k, n in held.items():
            seen[k[d]] += n
        targets.append(op2_mix.targets_of(getattr(mix, name), dict(seen)))
    p = plain_raking(held, targets, mix.budget) if held else {}
    u = lambda i, t: xxhash.xxh3_64_intdigest(f"{i}\n".encode() + (t or "").encode(), mix.seed) / 2.0**64
    return {k: (cell, n, p.get(cell, 1.0), u(*k) < p.get(cell, 1.0)) for k, (cell, n) in facts.items()}


def test_mixing(docs_of, texts):
    docs = docs_of(texts)
    rows = op2_mix.measured(docs, op2_mix.GENTLE).collect()
    assert Counter(r["n_tokens"] for r in rows) == Counter(len(WORD.findall(t or "")) for _, t in texts)
    kept = op2_mix.mixed_docs(docs)
    assert kept.columns == docs.columns
    want = mixed_by_hand([(r["doc_id"], r["source"], r["lang"], r["text"]) for r in docs.collect()], op2_mix.fitted_topics(docs), op2_mix.GENTLE)
    assert Counter((r["doc_id"], r["text"]) for r in kept.collect()) == Counter(k for k in texts if want[k][-1])
    assert op2_mix.mixed_docs(docs_of([])).count() == 0


def test_the_registered_mix(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = mixed_by_hand([(r["doc_id"], r["source"], r["lang"], r["text"]) for r in docs.collect()], op2_mix.fitted_topics(docs), op2_mix.PRODUCTION)
    by_id = {i: v for (i, _), v in want.items()}
    for r in op2_mix.op2_mix(spark, sf).collect():
        cell, n, p, kept = by_id[r["doc_id"]]
        assert ((r["source"], r["lang"], r["topic"]), r["n_tokens"]) == (cell, n)
        assert r["probability"] == pytest.approx(p, abs=1e-4) and (r["kept"] == kept or abs(p - r["probability"]) > 0)
    rows = op2_mix.mix_balance(spark, sf).collect()
    for name in ("source", "lang", "topic"):
        assert sum(r["target"] for r in rows if r["marginal"] == name) == pytest.approx(1)
        assert sum(r["achieved"] for r in rows if r["marginal"] == name) == pytest.approx(1)


def topics_by_hand(bags, k, rounds):
    """Centres and mean of spherical k-means over all bags, from the least bag and those farthest from the centres so far."""
    bags = np.array(sorted(map(tuple, bags)))
    mean = bags.mean(0)
    x = bags - mean
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    centres = [x[0]]
    while len(centres) < k:
        centres.append(x[np.argmin([max(np.round(c @ v, 6) for c in centres) for v in x])])
    for _ in range(rounds):
        own = [int(np.argmax([c @ v for c in centres])) for v in x]
        sums = [sum(v for v, o in zip(x, own) if o == i) if i in own else centres[i] for i in range(k)]
        centres = [s / max(np.linalg.norm(s), 1e-12) for s in sums]
    return np.array(centres), mean


def test_topics_are_fitted_on_every_document(spark, monkeypatch):
    rng = random.Random(77)
    groups = [[f"{g}w{i}" for i in range(12)] for g in range(9)]
    texts = [" ".join(rng.choice(groups[i % 8]) for _ in range(10)) for i in range(5000)]
    texts += [" ".join(rng.choice(groups[8]) for _ in range(10)) + " rare" * 300] * 3 + ["", None, " "]  # counts past a byte
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bags = [op2_mix.bag(op2_mix.hashes(t.encode().split())) for t in texts if (t or "").split()]
    packed = [op2_mix.packed_bag(op2_mix.hashes(t.encode().split())) for t in texts if (t or "").split()]
    assert (op2_mix.unpacked_bags(packed) == np.array(bags)).all() and {len(p) for p in packed} == {256, 512}
    centres, mean = topics_by_hand(bags, 8, op2_mix.ROUNDS)
    monkeypatch.setattr(op2_mix, "LEAST_PART", 500)
    found = [op2_mix.fitted_topics(d) for d in (docs.repartition(7), docs.orderBy(F.desc("doc_id")).repartition(2, "text"))]
    for topics in found:  # all documents, wherever they lie
        assert np.abs(topics.mean - mean).max() < 1e-6 and np.abs(topics.centres - centres).max() < 1e-5
    assert (found[0].centres == found[1].centres).all() and (found[0].mean == found[1].mean).all()


def test_topics_are_clusters_of_words():
    rng = random.Random(22)
    groups = [[f"{g}w{i}" for i in range(30)] for g in range(4)]
    texts = [(g, " ".join(rng.choice(groups[g]) for _ in range(40)).encode().split()) for g in range(4) for _ in range(50)]
    found = op2_mix.clustered(np.array([op2_mix.bag(op2_mix.hashes(w)) for _, w in texts]), 4)
    told = defaultdict(Counter)
    for g, w in texts:
        told[g][found.of(op2_mix.hashes(w))] += 1
    assert all(max(c.values()) == 50 for c in told.values()) and len({c.most_common(1)[0][0] for c in told.values()}) == 4


# -- 3


def lowered(t):
    return t.translate(str.maketrans(op3_decontaminate.UPPER, op3_decontaminate.LOWER))


def contaminated(text, items, n=13):
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(t or ""))
    w, hit, ids = find(text), set(), set()
    for item, t in items:
        b = find(t)
        k = min(n, len(b))
        grams = {tuple(b[i : i + k]) for i in range(len(b) - k + 1)} if b else set()
        for i in range(len(w) - k + 1):
            if tuple(w[i : i + k]) in grams:
                hit |= set(range(i, i + k))
                ids.add(str(item))
    return len(w), len(hit), sorted(ids)


@pytest.mark.parametrize("limit", [op3_decontaminate.BROADCAST_BYTES, 0])
def test_contamination(spark, docs_of, texts, monkeypatch, limit):
    monkeypatch.setattr(op3_decontaminate, "BROADCAST_BYTES", limit)
    passage = texts[-20][1]
    items = [(1, " ".join(passage.split()[25:50])), (2, "One  TWO"), (3, None), (4, "..."), (10, passage.upper())]
    items += [(5, items[0][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = [*plain(texts), (500, "see one, two. One two!"), (501, "x " * 700 + items[0][1]), (502, "y " * 20_000 + items[0][1] + " z" * 600)]
    got = {r["doc_id"]: r for r in op3_decontaminate.contamination(docs_of(rows), bench).collect()}
    for i, t in rows:
        n, hit, ids = contaminated(t, items)
        assert (got[i]["n_words"], got[i]["n_hit"], got[i]["items"]) == (n, hit, ids), i
    full = op3_decontaminate.contamination(docs_of(texts), bench)
    assert full.count() == len(texts)
    left = op3_decontaminate.decontaminated(docs_of(rows), bench)
    assert left.columns == docs_of([]).columns
    out = {r["doc_id"]: r["text"] for r in left.collect()}
    for i, t in rows:
        n, hit, _ = contaminated(t, items)
        if hit and 20 * hit >= n:
            assert i not in out
        else:
            assert contaminated(out[i], items)[0] == n - hit
    assert op3_decontaminate.contamination(docs_of([]), bench).count() == 0
    assert op3_decontaminate.contamination(docs_of(texts), bench.limit(0)).where("n_hit > 0").count() == 0


# -- 4


def repeated_bytes(rows):
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 99):
            if b[k : k + 100] in seen:
                gone[k : k + 100] = True
            else:
                seen.add(b[k : k + 100])
        out[i] = (len(b), int(gone.sum()), bytes(x for x, g in zip(b, gone) if not g))
    return out


@pytest.mark.parametrize("hot", [op4_suffix.HOT, 1, 8])
def test_suffixes(docs_of, texts, monkeypatch, hot):
    from loupe.llm import spans
    from loupe.llm.spans import covered, joined_spans

    if hot < 1 << 16:  # strings of hot grams go their own ways, and no broadcast is small enough
        monkeypatch.setattr(op4_suffix, "HOT", hot)
        monkeypatch.setattr(op4_suffix, "PART", 200)
        monkeypatch.setattr(op4_suffix, "GATHERED", 300)
        monkeypatch.setattr(op4_suffix, "CONTEXTS", 50)
        monkeypatch.setattr(op4_suffix, "BROADCAST_BYTES", 0)
        monkeypatch.setattr(spans, "BROADCAST_BYTES", 0)
    rng = random.Random(41)
    say = lambda n: " ".join(str(rng.randrange(10**6)) for _ in range(n))
    quoted = say(25)
    rows = [*plain(texts), *((800 + i, say(30) + quoted + say(30)) for i in range(40)), (900, say(20_000))]
    want = repeated_bytes(rows)
    docs = docs_of(rows).select("doc_id", "text")
    classed = op4_suffix.classed_anchors(docs, 4, hot).cache()
    grams = op4_suffix.hot_grams(classed, hot)
    entries = op4_suffix.met_anchors(classed, grams, 4)
    assert (len(grams) > 0) == (entries.where(F.col("kind") == op4_suffix._HOT).count() > 0) == (hot < 1 << 16)
    got = joined_spans(docs, op4_suffix.found_spans(docs)).collect()
    for r in got:
        b = (r["text"] or "").encode()
        gone = covered(r["spans"], 100, len(b)) if r["spans"] is not None else np.zeros(len(b), bool)
        assert (len(b), int(gone.sum()), bytes(x for x, g in zip(b, gone) if not g)) == want[r["doc_id"]]
    whole = op4_suffix.suffixes_removed(docs_of(texts))
    assert whole.columns == docs_of([]).columns and whole.count() == len(texts)
    assert op4_suffix.suffixes_removed(docs_of([])).count() == 0


def test_repeats_within_a_part_take_few_bytes_an_anchor():
    import tracemalloc

    n, size = 5000, op4_suffix.LEFT + op4_suffix.LENGTH  # copies: every string over every anchor but the first is a repeat
    around = np.tile(np.random.default_rng(3).integers(98, 124, size).astype(np.uint8), (n, 1))
    docs = (np.arange(n), np.zeros(n, np.int64), np.full(n, size))
    e = op4_suffix._Entries(docs, np.ones(n, np.uint64), np.zeros(n, np.uint64), np.arange(n, dtype=np.int32), np.full(n, op4_suffix.LEFT, np.uint32))
    tracemalloc.start()
    found = op4_suffix.repeated_starts(e, around)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 1500 * n
    e, who, first, last = found
    assert who.tolist() == list(range(1, n)) and set(first.tolist()) == {0} and set(last.tolist()) == {op4_suffix.LEFT}
    twice = np.repeat(np.arange(1, 3), 2)  # runs that meet or overlap become one, those of another document don't
    e, first, last = op4_suffix._merged(e.take(twice), np.array([0, 5, 3, 30]), np.array([4, 9, 20, 31]))
    assert list(zip(e.doc.tolist(), first.tolist(), last.tolist())) == [(1, 0, 9), (2, 3, 20), (2, 30, 31)]


def test_deep_shallow_sorts():
    from loupe.llm.deepshallow import common_prefixes, deep_shallow

    rng = np.random.default_rng(2)
    rows = rng.integers(1, 3, (400, 40), dtype=np.uint8)
    rows[100:300, :30] = 1
    rows[200:220] = rows[100]
    group = rng.integers(0, 3, 400)
    order = deep_shallow(group, rows, 2)
    keys = [(int(group[i]), rows[i].tobytes()) for i in order]
    assert keys == sorted(keys)
    lcp = common_prefixes(order, rows)
    for i in range(1, 400):
        a, b = rows[order[i - 1]], rows[order[i]]
        assert lcp[i] == next((k for k in range(40) if a[k] != b[k]), 40)


# -- 5


def near_components(rows, n, num, den):
    sets = {}
    for i, t in rows:
        w = [x.translate(str.maketrans(op3_decontaminate.UPPER, op3_decontaminate.LOWER)) for x in WORD.findall(t or "")]
        sets[i] = {tuple(w[k : k + n]) for k in range(max(len(w) - n + 1, 1))} if w else set()
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = list(sets)
    for x in range(len(ids)):
        for y in ids[x + 1 :]:
            a, b = sets[ids[x]], sets[y]
            if a and b and den * len(a & b) >= num * len(a | b):
                p, q = find(ids[x]), find(y)
                root[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("small", [False, True])
@pytest.mark.parametrize("how", [op5_near.Near(3, 85, 100), op5_near.Near()])
def test_near_duplicates(docs_of, texts, how, small, monkeypatch):
    rows = plain(texts)
    if small:  # hubs are dealt, nothing is broadcast by its size, and templated texts fill whole buckets
        monkeypatch.setattr(op5_near, "BLOCK", 4)
        monkeypatch.setattr(op5_near, "DEALT", 2)
        monkeypatch.setattr(components, "PAIRS", 0)
        monkeypatch.setattr(op5_near, "BROADCAST_ROWS", 0)
        rng = random.Random(51)
        say = lambda n: " ".join(str(rng.randrange(10**6)) for _ in range(n))
        template, own = say(60), [say(rng.choice((3, 12, 30))) for _ in range(25)]
        rows = [*rows, *((600 + i, template + " " + x) for i, x in enumerate(own)), *((650 + i, template + " " + x + " end") for i, x in enumerate(own[:10])), (699, say(9000))]
        counted = []
        fits = op5_near.prefixed
        monkeypatch.setattr(op5_near, "prefixed", lambda *a: counted.append(1) or fits(*a))
    want = near_components(rows, how.words, how.numerator, how.denominator)
    got = op5_near.near_duplicates(docs_of(rows), how).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]]
        assert r["kept"] == (r["doc_id"] == r["component_id"])
    assert not small or counted


def test_near_deduplicated(docs_of, texts):
    out = op5_near.near_deduplicated(docs_of(texts))
    assert out.columns == docs_of([]).columns
    ids = [r["doc_id"] for r in out.collect()]
    assert 100 in ids and not set(range(101, 106)) & set(ids) and not set(range(200, 208)) & set(ids)
    assert {400, 401, 402} <= set(ids)
    assert op5_near.near_deduplicated(docs_of([])).count() == 0
    assert op5_near.near_duplicates(docs_of([])).count() == 0


def test_a_pair_at_the_threshold_survives():
    least = op5_near.least_matches(0.85)
    rng = np.random.default_rng(0)
    a = np.zeros((2000, op5_near.HASHES), np.uint32)
    b = (rng.random(a.shape) > 0.86).astype(np.uint32)
    assert op5_near.plausible(a, b, least).mean() > 0.995
    far = (rng.random(a.shape) > 0.4).astype(np.uint32)
    assert not op5_near.plausible(a, far, least).any()


# -- 6


def word_windows(text, n=13):
    w = WORD.findall(text or "")
    return [tuple(w[k : k + n]) for k in range(len(w) - n + 1)]


@pytest.mark.parametrize("small", [False, True])
def test_substrings(docs_of, texts, monkeypatch, small):
    from loupe.llm import spans
    from loupe.llm.spans import covered, joined_spans

    if small:  # many parts, many chunks, and spans that meet their texts through a shuffle
        monkeypatch.setattr(op6_substring, "SKETCH_PART", 512)
        monkeypatch.setattr(op6_substring, "GATHERED", 256)
        monkeypatch.setattr(op6_substring, "CHUNK_BYTES", 1000)
        monkeypatch.setattr(op6_substring, "PART", 512)
        monkeypatch.setattr(spans, "BROADCAST_BYTES", 0)
    rng = random.Random(61)
    rows = [*plain(texts), (700, " ".join(rng.choice("abcdefghij") * 3 + str(rng.randrange(500)) for _ in range(20_000)))]
    first = {}
    for i, t in rows:
        for g in word_windows(t):
            first[g] = min(first.get(g, i), i)
    docs = docs_of(rows).select("doc_id", "text")
    for r in joined_spans(docs, op6_substring.found_spans(docs)).collect():
        gone = set()
        for k, g in enumerate(word_windows(r["text"])):
            if first[g] < r["doc_id"]:
                gone |= set(range(k, k + 13))
        n = len(WORD.findall(r["text"] or ""))
        found = covered(r["spans"], 13, n) if r["spans"] is not None else np.zeros(n, bool)
        assert set(np.flatnonzero(found).tolist()) == gone
    whole = op6_substring.substrings_removed(docs_of(texts))
    assert whole.columns == docs_of([]).columns and whole.count() == len(texts)
    assert op6_substring.substrings_removed(docs_of([])).count() == 0


@pytest.mark.parametrize("n_docs", [200, 800])
def test_few_unique_windows_pass_at_any_size(spark, docs_of, monkeypatch, n_docs):
    from loupe.llm.common import staged

    monkeypatch.setattr(op6_substring, "SKETCH_PART", 1024)
    monkeypatch.setattr(op6_substring, "CHUNK_BYTES", 4000)
    rng = random.Random(62)
    say = lambda n: " ".join(str(rng.randrange(10_000)) for _ in range(n))
    shared = say(40)
    docs = docs_of([(i, say(60) + (" " + shared if i % 10 == 0 else "")) for i in range(n_docs)]).select("doc_id", "text")
    sketch = op6_substring.Sketch.of(spark, n_docs * 55)
    assert sketch.parts >= n_docs * 55 // 1024
    chunks = staged(op6_substring.chunked(docs), "test-windows")
    lists = defaultdict(lambda: [[] for _ in range(op6_substring.ROWS)])
    for r in op6_substring.answered(op6_substring.sketched(chunks, 13, sketch), sketch).collect():
        row, part = divmod(r["part"], sketch.parts)
        lists[r["chunk"]][row].append(op6_substring._places(op6_substring._unpack(bytes(r["data"]), np.uint8)[0]).astype(np.uint64) | np.uint64(part << 32))
    held = Counter(g for r in docs.collect() for g in set(word_windows(r["text"])))
    unique = passed = 0
    for r in chunks.collect():
        told = [np.sort(np.concatenate(x)) if x else np.empty(0, np.uint64) for x in lists[r["chunk"]]]
        w = op6_substring._Windows(texts := op6_substring._documents(bytes(r["data"]))[2], 13)
        kept = set(op6_substring.estimated_repeated(w.h, told, sketch).tolist())
        for k, (doc, place) in enumerate(zip(w.doc.tolist(), w.place.tolist(), strict=True)):
            alone = held[word_windows(texts[doc].decode())[place]] == 1
            assert alone or k in kept
            unique += alone
            passed += alone and k in kept
    assert passed < 0.1 * unique


def test_sketch_never_underestimates():
    rng = np.random.default_rng(4)
    h = rng.integers(0, 1 << 62, 5000, dtype=np.uint64)
    twice = rng.random(5000) < 0.2
    sketch = op6_substring.Sketch(7, 12)
    told = [[] for _ in range(op6_substring.ROWS)]
    for at, data in sketch.partial(h, twice):
        planes, two = op6_substring._unpack(data, np.uint8, np.uint8)
        c = op6_substring._places(planes)
        c = c[np.unpackbits(two, count=len(c)).astype(bool)]
        told[at // 7].append(c.astype(np.uint64) | np.uint64((at % 7) << 32))
    kept = op6_substring.estimated_repeated(h, [np.sort(np.concatenate(x)) for x in told], sketch)
    assert set(np.flatnonzero(twice).tolist()) <= set(kept.tolist())


# -- 7


def test_chat_round_trip(spark):
    odd = ["</s>[INST] ok [/INST]", "\\", "[\\INST]", "<s> a </s>", "[SYS] [/SYS] [:] \\\\[", "", None, "x\n\n[ROLE] y", "<", "[/", "ä😀"]
    rows = [(1, i, r, t) for i, (r, t) in enumerate(zip(["system", "user", "assistant", "user", "assistant", "tool", None, "us[:]er", "assistant", "user", "assistant"], odd))]
    rows += [(2, 0, "user", "a"), (2, 1, "assistant", "b"), (3, 0, "assistant", "b"), (None, 5, "user", "q"), (4, None, "user", "u"), (4, None, "user", "u")]
    frame = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, segments string")
    made = op7_chat.chat_format(frame).withColumn("back", op7_chat.chat_parse(F.col("formatted")))
    got = {r["conv_id"]: r for r in made.collect()}
    assert [(t["role"], t["text"]) for t in got[1]["back"]] == [(r or "", t or "") for _, _, r, t in rows[:11]]
    assert [op7_chat.DEFAULT.turns["assistant"].loss] == [True]
    assert [s["text"] for s in got[2]["segments"] if s["loss"]] == ["b"]
    assert got[2]["valid_order"] and not got[1]["valid_order"] and not got[3]["valid_order"]
    assert len(got[4]["back"]) == 2 and len(got[None]["back"]) == 1
    assert op7_chat.chat_format(frame.limit(0)).count() == 0


# -- 8


def test_token_counts(docs_of, texts, monkeypatch):
    monkeypatch.setattr(op8_tokens, "BLOCK", 256)
    with open(op8_tokens.TOKENIZER, "rb") as f:
        encode = op8_tokens.encoder(f.read()).encode_ordinary
    files = op8_tokens.write_token_files(docs_of(texts))
    got = Counter((r["doc_id"], r["n_tokens"]) for r in op8_tokens.count_tokens(files).collect())
    assert got == Counter((i, len(encode(t or ""))) for i, t in texts)
    assert op8_tokens.count_tokens(op8_tokens.write_token_files(docs_of([]))).count() == 0


def test_long_texts_are_cut_where_no_token_is():
    with open(op8_tokens.TOKENIZER, "rb") as f:
        encode = op8_tokens.encoder(f.read()).encode_ordinary
    rng = random.Random(8)
    text = "".join(rng.choice(["word", " ", "é", "12", "\n", "'s", "  x", "中文", "😀"]) for _ in range(60_000))
    assert len(op8_tokens.tokens_of(text, encode)) == len(encode(text))


# -- 9


@pytest.mark.parametrize("limit", [op9_warc.BROADCAST_ROWS, 0])
def test_warc_round_trip(spark, monkeypatch, limit):
    monkeypatch.setattr(op9_warc, "BROADCAST_ROWS", limit)
    big = "<p>" + "ü" * 700_000
    rows = [(1, "http://a/ö%\r\n", "<a>"), (2, None, "<a>"), (3, "u", None), (4, "u", ""), (5, "u", big), (6, "u", big), (None, "n", "<a>"), (None, "n", "alone"), (8, "u", "WARC/1.1\r\n\r\n"), (8, "u", "WARC/1.1\r\n\r\n")]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, data string").repartition(3)
    archives = op9_warc.write_archives(op9_warc.decided(pages))
    assert max(len(r["data"]) for r in archives.collect()) <= op9_warc.CHUNK
    chunks = op9_warc.read_archives(archives).collect()
    whole = defaultdict(bytes)
    for r in sorted(chunks, key=lambda r: (r["archive"], r["record"], r["chunk"])):
        whole[(r["archive"], r["record"], r["page_id"], r["url"], r["record_type"])] += bytes(r["data"])
    html = {i: h for i, _, h in rows}
    for (_, _, page, url, kind), data in whole.items():
        if kind == "response" and page is not None:
            assert data == (html[page] or "").encode()
        assert page != 1 or url == rows[0][1]
    records = op9_warc.read_records(archives)
    assert records.where("error is not null or (record_type = 'response' and not digest_ok)").count() == 0
    got = Counter(tuple(r) for r in records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect())
    import base64

    digest = lambda h: base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    want = Counter()
    for i, _, h in rows:
        f = first.get(h or "")
        own = f is None or i == f
        want[(i, len((h or "").encode()), digest(h), "response" if own else "revisit", None if own else f)] += 1
    assert got == want
    assert op9_warc.read_records(op9_warc.write_archives(op9_warc.decided(pages.limit(0)))).count() == 0


def test_foreign_archives(spark):
    import base64
    import gzip

    sha = lambda b: base64.b32encode(hashlib.sha1(b).digest()).decode()
    record = lambda *lines, block: "\r\n".join(["WARC/1.0", *lines, f"content-LENGTH: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"
    body = b"<html>" + b"x" * 300_000
    http = b"HTTP/1.1 200 OK\r\nServer: a\r\nX-Long: " + b"h" * 500 + b"\r\n\r\n"
    info = record("WARC-Type: warcinfo", "WARC-Record-ID: <urn:uuid:1>", "Content-Type: application/warc-fields", block=b"software: x\r\n")
    request = record("warc-type: request", "warc-record-id: <urn:uuid:2>", "content-type: application/http; msgtype=request", block=b"GET / HTTP/1.1\r\nHost: a\r\n\r\n")
    good = record("Warc-Type: response", "WARC-Record-ID: <urn:uuid:3>", "WARC-Target-URI: <http://a/%20>", f"warc-payload-digest:", f" SHA1:{sha(body)}", "Content-Type: application/http; msgtype=response", block=http + body)
    wrong = record("WARC-Type: response", "WARC-Record-ID: <urn:uuid:4>", f"WARC-Payload-Digest: sha1:{sha(b'no')}", "Content-Type: application/http", block=http + body)
    plain_ = record("WARC-Type: conversion", "WARC-Record-ID: <urn:uuid:5>", "Content-Type: text/plain", block=b"a\n\nb")
    files = {
        "plain": info + request + good + wrong + plain_,
        "gzip": b"".join(gzip.compress(x) for x in (info, request, good, wrong, plain_)),
        "cut": info + good[:-1000],
        "cut-gzip": gzip.compress(info) + gzip.compress(good)[:-300],
        "bad-gzip": gzip.compress(info) + b"\x1f\x8b\x08\x00" + b"\xff" * 40,
        "junk": info + b"no record\r\n\r\n" + info,
        "empty": b"",
    }
    rows = [(name, i // 1000, data[i : i + 1000], "clash") for name, data in files.items() for i in range(0, max(len(data), 1), 1000)]
    archives = spark.createDataFrame(rows, "archive string, chunk long, data binary, url string").repartition(4)
    got = defaultdict(list)
    for r in op9_warc.read_records(archives).orderBy("archive", "record").collect():
        got[r["archive"]].append(r)
    for name in ("plain", "gzip"):
        assert [(r["record_type"], r["payload_bytes"], r["digest_ok"], r["error"]) for r in got[name]] == [("warcinfo", 13, None, None), ("request", 0, None, None), ("response", len(body), True, None), ("response", len(body), False, None), ("conversion", 4, None, None)]
        assert got[name][2]["url"] == "http://a/%20" and got[name][2]["payload_digest"] == sha(body)
    for name in ("cut", "cut-gzip", "bad-gzip", "junk"):
        assert [r["error"] is None for r in got[name]] == [True, False]
    assert "empty" not in got


# -- 10


def base_counts(t):
    t = t or ""
    w = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    at = defaultdict(list)
    for k in range(len(w) - 7):
        at[tuple(w[k : k + 8])].append(k)
    hit = {p for ks in at.values() if len(ks) > 1 for k in ks for p in range(k, k + 8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit)


def test_quality_counts(spark, docs_of, texts):
    rows = [*texts, (600, "a b\na b\n\n \na b | <c>"), (601, "é " * 25)]
    labels = spark.createDataFrame([(0, 1, 0), (0, 0, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = Counter(tuple(r) for r in op10_quality.judged(docs_of(rows), labels).select("doc_id", *op10_quality._COUNTS, "base_failed", "kept").collect())
    want = Counter()
    for i, t in rows:
        c = base_counts(t)
        failed = c[0] < 20 or 100 * c[4] > 30 * c[0]
        want[(i, *c, failed, not failed)] += 1
    assert got == want
    assert op10_quality.judged(docs_of([]), labels).count() == 0
    kept = op10_quality.quality_filtered(docs_of(rows), labels.limit(0))
    assert kept.columns == docs_of([]).columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(k[0] for k, n in want.items() for _ in range(n) if k[-1])


def test_quality_rejects_what_labels_tell(spark, docs_of):
    rng = random.Random(6)
    say = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(n))
    rows, labels = [], []
    for i in range(900):
        bad, toxic = i % 5 == 0, i % 7 == 0
        t = say(40)
        rows.append((i, (" ### ".join(t.split()) if bad else t) + (" scoundrel" if toxic else "")))
        labels.append((i, int(not bad), int(toxic)))
    got = {r["doc_id"]: r["kept"] for r in op10_quality.judged(docs_of(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    good = [i for i in range(900) if i % 5 and i % 7]
    assert sum(not got[i] for i in good) <= 0.05 * len(good)
    assert sum(got[i] for i in range(900) if i not in set(good)) <= 10


def lexicon_by_hand(rows):
    """The decision list of (doc_id, toxic, words), and how many words were likely."""
    bad, good, told = Counter(), Counter(), defaultdict(set)
    for i, toxic, words in rows:
        (bad if toxic else good).update(words)
        for w in words if toxic else ():
            told[w].add(i)
    likely = {w for w in bad if bad[w] >= op10_quality.SUPPORT and bad[w] >= 4 * good[w]}
    picked, gone = [], set()
    while len(picked) < op10_quality.LEXICON:
        new = {w: len(told[w] - gone) for w in likely}
        able = [(n - 4 * good[w], w) for w, n in new.items() if n >= op10_quality.SUPPORT and n >= 4 * good[w]]
        if not able:
            break
        picked.append(max(able)[1])
        gone |= told[picked[-1]]
    return picked, len(likely)


def test_the_pipelines_lexicon_knows_all_labelled_documents(spark, monkeypatch):
    import corpus_pipeline

    rng = random.Random(79)
    rows, labels = [], []
    for i in range(60_000):
        toxic = i % 12 == 0
        n = min(int(rng.expovariate(0.8)), 4) if toxic else int(rng.random() < 0.002)
        words = [f"é{min(int(rng.expovariate(0.02)), 299)}" for _ in range(n)]
        rows.append((i, f"d{i} " + " ".join(words)))
        labels.append((i, 1, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    proposing = {r["doc_id"] for r in docs.where(~op10_quality._held_out(F.col("text"))).select("doc_id").collect()}
    want, likely = lexicon_by_hand([(i, i % 12 == 0, set(t.encode().split())) for i, t in rows if i in proposing])
    assert 40 < len(want) < likely and len(want) < op10_quality.LEXICON
    assert op10_quality.lexicon_of(docs, labels) == frozenset(want)
    monkeypatch.setattr(op10_quality, "AT_ONCE", 5)
    monkeypatch.setattr(op10_quality, "LEXICON", 23)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert op10_quality.lexicon_of(docs, labels) == frozenset(want[:23])
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    used = []
    monkeypatch.setattr(op10_quality, "scored", lambda d, lexicon, *a, scored=op10_quality.scored: used.append(lexicon) or scored(d, lexicon, *a))
    monkeypatch.setattr(corpus_pipeline, "table", lambda *_: labels)
    corpus_pipeline.quality(spark, docs, "")
    assert used == [frozenset(want[:23])]


def test_binomial_tail_is_exact():
    from fractions import Fraction
    from math import comb

    for n, k, p in ((30, 2, 0.05), (500, 20, 0.05), (85, 0, 0.05)):
        q = Fraction(p)
        assert abs(op10_quality.binomial_tail(k, n, p) - float(sum(comb(n, i) * q**i * (1 - q) ** (n - i) for i in range(k + 1)))) < 1e-9


def test_registered_names():
    import __spark_entry__

    names = [n for n in __spark_entry__.queries() if re.match(r"op\d+_", n)]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11))


# -- the pipeline


def test_pipeline_stages(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "near_dedup", "decontaminate", "mix", "shard"]
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.collect()
        out = stage(spark, docs, sf)
        if i < len(names) - 1:
            assert out.columns == docs.columns
        rows = out.collect()
        ids = [r["doc_id"] for r in rows]
        assert len(set(ids)) == len(ids) and set(ids) <= {r["doc_id"] for r in before}
        if name == "quality":
            kept = set(ids)
            for r in before:
                c = base_counts(r["text"])
                assert r["doc_id"] not in kept or not (c[0] < 20 or 100 * c[4] > 30 * c[0])
        if name == "near_dedup":
            want = near_components([(r["doc_id"], r["text"]) for r in before], 5, 80, 100)
            assert set(ids) == {i for i, (_, root) in want.items() if i == root}
        if name == "decontaminate":
            items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
            found = {r["doc_id"]: contaminated(r["text"], items) for r in before}
            assert set(ids) == {i for i, (n, hit, _) in found.items() if not (hit and 20 * hit >= n)}
        if name == "mix":
            want = mixed_by_hand([(r["doc_id"], r["source"], r["lang"], r["text"]) for r in before], op2_mix.fitted_topics(docs), op2_mix.GENTLE)
            assert set(ids) == {i for (i, _), v in want.items() if v[-1]}
        if name == "shard":
            loads = Counter()
            for r in rows:
                loads[r["shard"]] += r["size"]
            sizes = {r["doc_id"]: len((r["text"] or "").encode()) + 8 for r in before}
            assert {r["doc_id"]: r["size"] for r in rows} == sizes
            ordered, room = sorted(sizes.values(), reverse=True), []
            for n in ordered:  # best fit decreasing at the capacity that the shards came to
                fits = [x for x in room if x >= n]
                if fits:
                    room.remove(min(fits))
                    room.append(min(fits) - n)
                else:
                    room.append(max(loads.values()) - n)
            assert len(loads) <= corpus_pipeline.N_SHARDS and len(room) <= corpus_pipeline.N_SHARDS
        docs = out
    assert sorted({r["shard"] for r in docs.collect()})[-1] < corpus_pipeline.N_SHARDS


def test_the_pipelines_mix_knows_the_topics_of_all_documents(spark, sf_dir):
    from types import SimpleNamespace

    import corpus_pipeline

    rng = random.Random(78)
    groups = [[f"{g}w{i}" for i in range(12)] for g in range(10)]
    rows = [(i, f"src{i % 3}", "en", " ".join(rng.choice(groups[min(int(rng.expovariate(0.5)), 9)]) for _ in range(12))) for i in range(4500)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, text string").repartition(5)
    centres, mean = topics_by_hand([op2_mix.bag(op2_mix.hashes(t.encode().split())) for *_, t in rows], 8, op2_mix.ROUNDS)
    want = mixed_by_hand(rows, SimpleNamespace(centres=centres, mean=mean), op2_mix.GENTLE)
    cells = {r["doc_id"]: (r["source"], r["lang"], r["topic"]) for r in op2_mix.measured(docs, op2_mix.GENTLE).collect()}
    assert cells == {i: v[0] for (i, _), v in want.items()}
    assert {r["doc_id"] for r in corpus_pipeline.mix(spark, docs, sf_dir).collect()} == {i for (i, _), v in want.items() if v[-1]}
