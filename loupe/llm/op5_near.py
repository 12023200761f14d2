"""MinHash near-dedup with sequential Bayesian verification.

Texts with one word sequence are one node, so copies never meet as pairs. Nodes
meet in bands of their MinHash signatures; the bands are chosen so that a pair
at the threshold is missed with a chance below ``MISS``. Candidates are compared
signature batch by signature batch: with s matches of m, the similarity's
posterior under a flat prior is Beta(s + 1, m - s + 1), and a pair is dropped
once the chance that it reaches the threshold falls below ``MISS``. Survivors are
verified on their full shingle sets.

A bucket's nodes are not all paired with each other. First each node meets the
hub that it shares most buckets with; hubs are the nodes with most neighbours,
so a family's origin meets its copies. The links found give components, and only
buckets that still hold nodes of different components are searched further, in
blocks of bounded size: all pairs across components, each in the first bucket
that it shares, that neither the signatures nor, inside the task, the halved
shingle hashes rule out are verified. So no link between components is lost, and
none within a component is needed. Buckets of more than a block's nodes (texts of
one template) aren't paired at all: two of their nodes can only be similar enough
if they share one of the rarest shingles of each, so those shingles, rare by the
count over all such nodes, are the buckets in which they meet instead.

Defined results: a text without words, null or empty, has no shingles and is
linked with nothing; one with fewer words than a shingle is the whole sequence;
equal texts are linked whatever their ids; of null ids a component's id is the
least other id, null if there is none; repeated rows get one row each; an empty
table gives no rows. ``near_deduplicated`` keeps all columns.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loupe.llm.common import batches, discarded, hashes, join_counted, staged, table, unwrapped, whole, windows, wrapped
from loupe.llm.components import components

#: Hash functions of a signature, and how many are compared at a time.
HASHES, BATCH = 180, 20
#: Chance of missing a pair at the threshold: in the bands, and at each batch.
MISS = 1e-6
#: Members of one side of a block of comparisons.
BLOCK = 1024
#: What halved hashes may take from a similarity at most, by hashes that meet in their upper half.
SHORT_MARGIN = 0.01
#: Rows of a table of node names that is broadcast.
BROADCAST_ROWS = 1 << 20
#: Pairs of one node that are given its facts in one task, and the most nodes that are dealt over several.
DEALT, MOST_HUBS = 4096, 1 << 16

_rng = np.random.default_rng(20240229)
_FACTORS = _rng.integers(0, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFTS = _rng.integers(0, 1 << 63, HASHES, dtype=np.uint64)


@dataclass(frozen=True)
class Near:
    """Words of a shingle, and the similarity, as a fraction, from which texts are linked."""

    words: int = 5
    numerator: int = 80
    denominator: int = 100

    @property
    def threshold(self) -> float:
        return self.numerator / self.denominator

    @property
    def rows(self) -> int:
        """The longest bands that still miss few enough."""
        fit = [r for r in range(1, 13) if (1 - self.threshold**r) ** (HASHES // r) <= MISS]
        return max(fit, default=1)


def least_matches(threshold: float) -> list[int]:
    """For each batch: matches so far below which a pair is dropped.

    P(J >= t) under Beta(s + 1, m - s + 1) is P(Binomial(m + 1, t) <= s).
    """
    out = []
    for m in range(BATCH, HASHES + 1, BATCH):
        tail, s = 0.0, 0
        while True:
            tail += comb(m + 1, s) * threshold**s * (1 - threshold) ** (m + 1 - s)
            if tail >= MISS:
                break
            s += 1
        out.append(s)
    return out


def plausible(a: np.ndarray, b: np.ndarray, least: list[int]) -> np.ndarray:
    """Which of the signature pairs (rows of a and b) survive all batches."""
    alive = np.arange(len(a))
    matches = np.zeros(len(a), np.int32)
    for i, need in enumerate(least):
        part = slice(i * BATCH, (i + 1) * BATCH)
        matches[alive] += (a[alive, part] == b[alive, part]).sum(1, dtype=np.int32)
        alive = alive[matches[alive] >= need]
        if not len(alive):
            break
    out = np.zeros(len(a), bool)
    out[alive] = True
    return out


def shingle_sets(texts: list[bytes | None], n: int) -> Iterator[tuple[bytes | None, np.ndarray]]:
    """The digest of the lower-case word sequence and the sorted shingle hashes of each text."""
    split = [(t or b"").lower().split() for t in texts]
    sizes = np.array([len(w) for w in split], np.int64)
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    flat = hashes([w for words in split for w in words])
    joined = windows(flat, n)
    for words, start, size in zip(split, offsets[:-1].tolist(), sizes.tolist(), strict=True):
        if not size:
            yield None, np.empty(0, np.uint64)
            continue
        if size < n:
            found = np.array([whole(flat[start : start + size])], np.uint64)
        else:
            found = np.unique(joined[start : start + size - n + 1])
        yield hashlib.md5(b" ".join(words)).digest(), found


def signature(shingles: np.ndarray) -> np.ndarray:
    low = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), 512):
        part = shingles[i : i + 512, None] * _FACTORS[None, :]
        part ^= _SHIFTS[None, :]
        np.minimum(low, part.min(0), out=low)
    return (low >> np.uint64(32)).astype(np.uint32)


def signed(docs: DataFrame, how: Near) -> DataFrame:
    """doc_id, text_key, n_shingles, node (digest of the word sequence, or null) and signature of every document."""
    schema = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("n_shingles", pa.int64()), ("node", pa.binary()), ("sig", pa.binary())])

    def made(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in batches(source):
            sizes, nodes, sigs = [], [], []
            for node, found in shingle_sets(texts, how.words):
                sizes.append(len(found))
                nodes.append(node)
                sigs.append(signature(found).tobytes() if node is not None else None)
            yield pa.record_batch([batch.column("doc_id"), batch.column("text_key"), pa.array(sizes, pa.int64()), pa.array(nodes, pa.binary()), pa.array(sigs, pa.binary())], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), F.col("text").cast("string").alias("text")).mapInArrow(made, "doc_id long, text_key long, n_shingles long, node binary, sig binary")


def band_keys(sigs: np.ndarray, rows: int) -> np.ndarray:
    """The bucket of each signature in every band."""
    n_bands = HASHES // rows
    parts = sigs[:, : n_bands * rows].reshape(-1, n_bands, rows)
    key = np.repeat(np.arange(1, n_bands + 1, dtype=np.uint64)[None, :], len(sigs), 0)
    for r in range(rows):
        key = (key ^ parts[:, :, r]) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


def banded(nodes: DataFrame, rows: int) -> DataFrame:
    """(band, node): each node once for every band of its signature."""
    n_bands = HASHES // rows

    def made(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for full in source:
            for i in range(0, full.num_rows, 2048):
                batch = full.slice(i, 2048)
                keys = band_keys(np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint32).reshape(-1, HASHES), rows)
                take = pa.array(np.repeat(np.arange(len(keys)), n_bands))
                yield pa.record_batch([pa.array(keys.reshape(-1)), batch.column("node").take(take)], names=["band", "node"])

    return nodes.select("node", "sig").mapInArrow(made, "band long, node binary")


def _fetched(pairs: DataFrame, facts: DataFrame, column: str) -> DataFrame:
    """The staged pairs (a, b) with ``column`` of both nodes as x and y.

    A hub's pairs are dealt over salts, and its one row is copied to each, so no task gives one node's facts to
    more than about DEALT pairs. There are fewer than MOST_HUBS hubs, whatever the data, so the driver tells them to all.
    """
    least = max(DEALT, pairs.count() // MOST_HUBS)
    out = pairs
    for end, other, name in (("a", "b", "x"), ("b", "a", "y")):
        named = facts.select(F.col("node").alias(end), F.col(column).alias(name))
        found = pairs.groupBy(end).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > least).select(end, F.ceil(F.col("n") / DEALT).cast("int").alias("salts")).collect()
        if not found:
            out = out.join(named, end)
            continue
        hubs = F.broadcast(pairs.sparkSession.createDataFrame(found, f"{end} binary, salts int"))
        salts = F.coalesce("salts", F.lit(1))
        copied = named.join(hubs, end, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("salts")
        dealt = out.join(hubs, end, "left").withColumn("salt", F.pmod(F.xxhash64(other), salts).cast("int")).drop("salts")
        out = dealt.join(copied, [end, "salt"]).drop("salt")
    return out


def pruned(pairs: DataFrame, signatures: DataFrame, how: Near) -> DataFrame:
    """The pairs that their signatures don't rule out."""
    least = least_matches(how.threshold)

    def made(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint32).reshape(-1, HASHES) for c in "xy")
                yield batch.select(["a", "b"]).filter(pa.array(plausible(x, y, least)))

    return _fetched(pairs, signatures, "sig").select("a", "b", "x", "y").mapInArrow(made, "a binary, b binary")


def verified(pairs: DataFrame, sets: DataFrame, how: Near) -> DataFrame:
    """The pairs whose full sets reach the threshold."""

    def made(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            stay = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                p, q = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                if how.numerator * max(len(p), len(q)) > how.denominator * min(len(p), len(q)):
                    stay.append(False)
                    continue
                merged = np.concatenate([p, q])
                merged.sort()
                both = int((merged[1:] == merged[:-1]).sum())
                stay.append(how.denominator * both >= how.numerator * (len(merged) - both))
            yield batch.select(["a", "b"]).filter(pa.array(stay, pa.bool_()))

    return _fetched(pairs, sets, "shingles").select("a", "b", "x", "y").mapInArrow(made, "a binary, b binary")


def sets_of(docs: DataFrame, owners: DataFrame, nodes: DataFrame, how: Near) -> DataFrame:
    """(node, shingles) of the named nodes, each from its owner, a document that has its word sequence."""
    wanted = staged(owners.join(nodes, "node"), "near-wanted")
    ids = wanted.select(F.col("doc_id").alias("_id")).distinct()
    ids = F.broadcast(ids) if wanted.count() <= BROADCAST_ROWS else ids
    schema = pa.schema([("node", pa.binary()), ("shingles", pa.binary())])

    def made(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in batches(source):
            pairs = [(node, found.tobytes()) for node, found in shingle_sets(texts, how.words) if node is not None]
            yield pa.record_batch([pa.array([p[i] for p in pairs], pa.binary()) for i in (0, 1)], schema=schema)

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = texts.join(ids, texts["doc_id"].eqNullSafe(ids["_id"]), "left_semi")
    found = texts.mapInArrow(made, "node binary, shingles binary")
    return staged(found.join(wanted.select("node"), "node", "left_semi").dropDuplicates(["node"]), "near-sets")


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """The share of common members of two sorted sets without repeats."""
    merged = np.concatenate([a, b])
    merged.sort(kind="stable")
    both = int((merged[1:] == merged[:-1]).sum())
    return both / (len(merged) - both)


def shortened(sets: DataFrame) -> DataFrame:
    """(node, short): the distinct upper halves of the shingle hashes."""

    def made(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            halves = [np.unique((np.frombuffer(x, np.uint64) >> np.uint64(32)).astype(np.uint32)).tobytes() for x in batch.column("shingles").to_pylist()]
            yield pa.record_batch([batch.column("node"), pa.array(halves, pa.binary())], names=["node", "short"])

    return sets.mapInArrow(made, "node binary, short binary")


def prefixed(nodes: DataFrame, sets: DataFrame, how: Near) -> DataFrame:
    """(band, node, root, n): nodes (node, root) in the buckets of their rarest shingles, where these hold several roots.

    Of two sets that reach the threshold, each shares so much that one of its rarest members, one more than it may
    have for itself, is among the other's; rare is what few of these nodes have. Nothing is missed.
    """

    def made(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for full in source:
            for i in range(full.num_rows):
                found = np.frombuffer(full.column("shingles")[i].as_buffer(), np.int64)
                keep = len(found) - -(-how.numerator * len(found) // how.denominator) + 1
                yield pa.record_batch([full.column("node").slice(i, 1).take(pa.array(np.zeros(len(found), np.int64))), pa.array(found), pa.array(np.full(len(found), keep))], names=["node", "token", "keep"])

    tokens = staged(sets.join(nodes.select("node"), "node", "left_semi").mapInArrow(made, "node binary, token long, keep long"), "near-tokens")
    counts = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n")).withColumn("held", F.col("n"))
    counted = join_counted(tokens, counts, "token", tokens.count())
    rarest = counted.groupBy("node").agg(F.slice(F.array_sort(F.collect_list(F.struct("held", "token"))), F.lit(1), F.min("keep").cast("int")).alias("rare"))  # no more than a text has
    placed = staged(rarest.select("node", F.explode("rare.token").alias("band")).join(nodes, "node"), "near-rarest")
    several = placed.groupBy("band").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("n")).where("lo <> hi").select("band", "n")
    out = staged(placed.join(several, "band").select("band", "node", "root", "n"), "near-rare-members")
    discarded(tokens, placed)
    return out


def _across(members: DataFrame, how: Near, banded: bool = True) -> DataFrame:
    """Likely pairs of members (band, node, root, sig, short, n) of one bucket and different roots.

    The members of a bucket fall into parts of about BLOCK; each two parts, and
    each part with itself, meet in one task. A pair comes from the first bucket
    that its nodes share, if they are ``banded``, and if neither its signatures nor
    the upper halves of its shingle hashes (``short``) rule it out.
    """
    least = least_matches(how.threshold)
    rows = how.rows
    parts = F.ceil(F.col("n") / BLOCK).cast("int")
    own = members.withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    sent = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    sent = sent.select("band", F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q"), "part", "node", "root", "sig", "short")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        band, p, q = (pdf[c].iloc[0] for c in ("band", "p", "q"))
        pdf = pdf.sort_values("part", kind="stable")
        n, n_left = len(pdf), int((pdf["part"] == p).sum())
        sigs = np.frombuffer(b"".join(pdf["sig"]), np.uint32).reshape(-1, HASHES)
        names, roots = pdf["node"].to_numpy(), pd.factorize(pdf["root"])[0]
        sets = [np.frombuffer(x, np.uint32) for x in pdf["short"]]
        keys = band_keys(sigs, rows)
        out_a, out_b = [], []
        for i in range(n_left):
            js = np.arange(i + 1, n) if p == q else np.arange(n_left, n)
            js = js[roots[js] != roots[i]]
            if not len(js):
                continue
            if banded:
                js = js[keys[i][(keys[js] == keys[i]).argmax(1)] == band]
            js = js[plausible(np.repeat(sigs[i : i + 1], len(js), 0), sigs[js], least)]
            js = [j for j in js.tolist() if similarity(sets[i], sets[j]) >= how.threshold - SHORT_MARGIN]
            out_a += [names[i]] * len(js)
            out_b += [names[j] for j in js]
        return pd.DataFrame({"a": pd.Series(out_a, dtype=object), "b": pd.Series(out_b, dtype=object)})

    pairs = sent.groupBy("band", "p", "q").applyInPandas(compare, "a binary, b binary")
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def linked(docs: DataFrame, how: Near) -> tuple[DataFrame, DataFrame]:
    """The documents' (doc_id, n_shingles, node), and (node, root) of the nodes that are linked."""
    rows = staged(signed(docs, how), "near-rows")
    nodes = staged(rows.where("node is not null").groupBy("node").agg(F.min("sig").alias("sig"), F.min("doc_id").alias("doc_id")), "near-nodes")
    bands = banded(nodes, how.rows)
    sizes = bands.groupBy("band").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    met = staged(bands.join(sizes, "band"), "near-met")
    degrees = met.groupBy("node").agg(F.sum("size").alias("degree"))
    ranked = staged(met.join(degrees, "node"), "near-ranked")
    hubs = ranked.groupBy("band").agg(F.max(F.struct("degree", "node")).alias("hub")).select("band", F.col("hub.node").alias("hub"), F.col("hub.degree").alias("hub_degree"))
    votes = ranked.join(hubs, "band").where("node <> hub").groupBy("node", "hub").agg(F.count(F.lit(1)).alias("n"), F.max("hub_degree").alias("hub_degree"))
    first = votes.groupBy("node").agg(F.max_by("hub", F.struct("n", "hub_degree", "hub")).alias("hub"))
    first = staged(first.select(F.least("hub", "node").alias("a"), F.greatest("hub", "node").alias("b")).distinct(), "near-votes")
    first = staged(pruned(first, nodes, how), "near-pairs")
    discarded(ranked)

    owners = nodes.select("node", "doc_id")
    rows = rows.drop("sig")
    sets = sets_of(docs, owners, first.select(F.explode(F.array("a", "b")).alias("node")).distinct(), how)
    links = staged(verified(first, sets, how), "near-links")
    found = components(links)

    labelled = met.join(found, "node", "left").select("band", "node", F.coalesce("root", "node").alias("root"))
    mixed_bands = labelled.groupBy("band").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("n")).where("lo <> hi").select("band", "n")
    members = staged(labelled.join(mixed_bands, "band"), "near-members")
    sets = sets_of(docs, owners, members.select("node").distinct(), how)
    facts = staged(nodes.select("node", "sig").join(shortened(sets), "node"), "near-facts")
    more = _across(members.where(F.col("n") <= BLOCK).join(facts, "node"), how)
    large = members.where(F.col("n") > BLOCK).select("node", "root").distinct()
    if not large.isEmpty():
        more = more.unionByName(_across(prefixed(staged(large, "near-large"), sets, how).join(facts, "node"), how, False)).distinct()
    more = staged(more, "near-pairs")
    discarded(met, members, facts)
    if more.isEmpty():
        return rows, found
    return rows, components(links.unionByName(verified(more, sets, how)))


def near_duplicates(docs: DataFrame, how: Near = Near()) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document."""
    rows, found = linked(docs, how)
    total = rows.count()
    texts = rows.where("node is not null").groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("least"))
    texts = staged(texts.join(found, "node", "left").withColumn("root", F.coalesce("root", "node")), "near-texts")
    ids = texts.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("n"))
    named = staged(join_counted(texts.withColumnRenamed("n", "copies"), ids, "root", total).select("node", F.col("copies").alias("n"), "component_id"), "near-named")
    out = join_counted(rows.where("node is not null"), named, "node", total).unionByName(rows.where("node is null").withColumn("component_id", F.col("doc_id")), allowMissingColumns=True)
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def near_deduplicated(docs: DataFrame, how: Near = Near()) -> DataFrame:
    """One document of each component, the one with the least id, with all columns.

    Documents without words all stay. Rows that repeat the id and text that stay
    do so too; of null ids, or texts that share the least id, one text stays.
    """
    rows, found = linked(docs, how)
    best = F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "text_key")).alias("best")
    texts = rows.where("node is not null").groupBy("node").agg(best).join(found, "node", "left")
    stay = texts.groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("best").alias("best")).select("best.doc_id", "best.text_key")
    stay = stay.unionByName(rows.where("node is null").select("doc_id", "text_key"))
    stay = staged(stay, "near-stay").withColumnsRenamed({"doc_id": "_doc", "text_key": "_key"})
    keyed = wrapped(docs).withColumn("_text_key", F.xxhash64("text"))
    return unwrapped(keyed.join(stay, keyed["doc_id"].eqNullSafe(stay["_doc"]) & (keyed["_text_key"] == stay["_key"]), "left_semi"), docs)


def op5_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of every document at 0.85 on shingles of three words."""
    return near_duplicates(table(spark, sf_dir, "documents"), Near(3, 85, 100))


_ORACLE = r"""
WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 2], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, CAST(greatest(len(w) - 1, 2) AS BIGINT))) AS i FROM t WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s AS a JOIN s AS b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT a, b FROM p JOIN n AS x ON x.doc_id = a JOIN n AS y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
r(node, seen) AS (SELECT doc_id, doc_id FROM t UNION SELECT r.node, l.b FROM r JOIN l ON l.a = r.seen)
SELECT t.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, t.doc_id = c.component_id AS kept
FROM t LEFT JOIN n USING (doc_id) JOIN (SELECT node AS doc_id, min(seen) AS component_id FROM r GROUP BY node) AS c USING (doc_id)
"""

QUERIES = {"op5_near": op5_near}
ORACLES = {"op5_near": _ORACLE}
