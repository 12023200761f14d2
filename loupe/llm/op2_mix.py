"""Mixing sources to target weights by iterative proportional fitting.

The token masses of the cells (source, language, topic) are raked to the three
marginals asked for; a document is then sampled with its cell's calibrated
probability, by a hash of its id and text, so a run repeats exactly. Categories
that the targets don't name share one, OTHER, so the number of cells is bounded
by the targets and the fit runs on the driver, however many sources there are.

No cell can give more than it holds: masses are capped there after each step,
so probabilities stay at most 1 and the fit comes as near to the targets as the
supply allows. A named category without tokens drops out, and the others of its
marginal share its weight; OTHER gets what the named ones leave. A target
without shares tempers the observed ones: share ** ``power``. Where some have
shares and others none, those without keep the share they were seen with, and
the rest is split by the shares; so does OTHER in the registered mix.

Tokens are words. Topics are clusters of documents by their words: spherical
k-means on hashed bags of words, fitted on every document that has words. Bags are
counts of 256 cells, staged beside the rows; each round is a pass over them that
sends the driver one table of sums a task. Vectors are whole multiples of 1 / UNIT,
so sums and products are exact and neither the order of documents nor their parts
can change a topic. ``balance`` tells, for each category, what was asked for and
what the fit comes to.

Defined results: null and empty texts have no tokens, topic 0 and probability 1
if their cell holds no tokens; null sources and languages are OTHER; repeated
rows share one decision; an empty table gives no rows. ``mixed_docs`` keeps all
columns.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loupe.llm.common import batches, discarded, hashes, mixed, parts_for, staged, table, unwrapped

OTHER = "other"
TOPICS = tuple(str(i) for i in range(8))
#: Cells of a hashed bag of words, and rounds of the fit.
CELLS, ROUNDS = 256, 20
#: What a coordinate is a multiple of: products of two vectors of length 2 at most are exact in the 53 bits of a float.
UNIT = float(1 << 25)
#: Bags that a pass holds as floats, those of a task, those that make one worth while, and tasks that answer the driver.
SLICE, PART, LEAST_PART, TASKS = 1 << 11, 1 << 17, 1 << 12, 1 << 10


@dataclass(frozen=True)
class Target:
    """The categories of a marginal with their shares of the tokens; None: tempered."""

    shares: Mapping[str, float | None]
    power: float = 1.0


@dataclass(frozen=True)
class Mix:
    """Targets of the three marginals, and the share of all tokens to sample."""

    source: Target
    lang: Target
    topic: Target = field(default_factory=lambda: Target(dict.fromkeys(TOPICS), 0.8))
    budget: float = 0.5
    seed: int = 17


SOURCES = {"src0": 0.1} | {f"src{i}": 0.9 / 19 for i in range(1, 20)}
#: The mix of the registered query: the hot source held to a tenth, fixed languages, topics flattened.
PRODUCTION = Mix(Target(SOURCES | {OTHER: None}), Target({"en": 0.5, "fr": 0.2, "de": 0.2, "es": 0.1, OTHER: None}))
#: The mix of the pipeline: observed shares, slightly flattened, and most tokens kept.
GENTLE = Mix(Target(dict.fromkeys(SOURCES), 0.9), Target(dict.fromkeys(("en", "fr", "de", "es")), 0.9), Target(dict.fromkeys(TOPICS), 0.9), 0.9)

_COLUMNS = ("source", "lang", "topic")


@dataclass(frozen=True)
class Topics:
    """Centres of the topics, and the mean that is taken off before a document meets them."""

    centres: np.ndarray
    mean: np.ndarray

    def near(self, bags: np.ndarray) -> np.ndarray:
        """The topic of each bag."""
        return ((np.rint(bags * UNIT) - self.mean * UNIT) @ (self.centres * UNIT).T).argmax(1)

    def of(self, h: np.ndarray) -> int:
        """The topic of a bag of word hashes; a text without words has topic 0."""
        return int(self.near(bag(h)[None])[0]) if len(h) else 0


def _counted(h: np.ndarray) -> np.ndarray:
    return np.bincount((mixed(h) & np.uint64(CELLS - 1)).astype(np.int64), minlength=CELLS)


_DAMPED = np.log1p(np.arange(256.0))


def _of_length_one(damped: np.ndarray) -> np.ndarray:
    return damped / np.maximum(np.sqrt((damped * damped).sum(-1, keepdims=True)), 1e-12)


def bag(h: np.ndarray) -> np.ndarray:
    """A bag of word hashes as a vector of length 1: dampened counts over CELLS cells."""
    return _of_length_one(np.log1p(_counted(h)))


def packed_bag(h: np.ndarray) -> bytes | None:
    """The counts of a bag, each in as few bytes as the largest needs; none without words."""
    if not len(h):
        return None
    counts = _counted(h)
    return counts.astype(np.min_scalar_type(counts.max())).tobytes()


def unpacked_bags(packed: list[bytes]) -> np.ndarray:
    """Packed bags as vectors."""
    damped = np.empty((len(packed), CELLS))
    widths = np.fromiter(map(len, packed), np.int64, len(packed)) // CELLS
    for w in np.unique(widths).tolist():
        at = np.flatnonzero(widths == w)
        counts = np.frombuffer(b"".join(packed[i] for i in at.tolist()), f"u{w}").reshape(-1, CELLS)
        damped[at] = _DAMPED[counts] if w == 1 else np.log1p(counts.astype(np.float64))
    return _of_length_one(damped)


def _units(v: np.ndarray) -> np.ndarray:
    return np.rint(v / np.maximum(np.sqrt((v * v).sum(-1, keepdims=True)), 1e-12) * UNIT)


def _least(rows: np.ndarray) -> np.ndarray:
    """The first of the rows in lexicographic order."""
    for c in range(rows.shape[1]):
        if len(rows) == 1:
            break
        rows = rows[rows[:, c] == rows[:, c].min()]
    return rows[:1]


#: Runs a step over slices of all bags, in units, and merges what it gives (rows of CELLS + 1 numbers); None if there are no bags.
_Pass = Callable[[Callable[[np.ndarray], np.ndarray], Callable[[np.ndarray, np.ndarray], np.ndarray]], np.ndarray | None]


def _fitted(over: _Pass, k: int, rounds: int) -> Topics:
    """Spherical k-means from centres that lie far apart."""
    whole = over(lambda x: np.append(len(x), x.sum(0))[None], np.add)
    if whole is None:
        return Topics(np.zeros((k, CELLS)), np.zeros(CELLS))
    mean = np.rint(whole[0, 1:] / whole[0, 0])
    c = np.empty((0, CELLS))

    def farthest(x: np.ndarray) -> np.ndarray:
        close = (_units(x - mean) @ c.T).max(1) if len(c) else np.zeros(len(x))
        at = close == close.min()
        return _least(np.column_stack([close[at], x[at]]))

    def sums(x: np.ndarray) -> np.ndarray:
        x = _units(x - mean)
        own = ((x @ c.T).argmax(1)[:, None] == np.arange(k)).astype(np.float64)
        return np.column_stack([own.sum(0), own.T @ x])

    while len(c) < k:
        c = np.concatenate([c, _units(over(farthest, lambda a, b: _least(np.concatenate([a, b])))[:, 1:] - mean)])
    for _ in range(rounds):
        found = over(sums, np.add)
        before, c = c, np.where(found[:, :1] > 0, _units(found[:, 1:].astype(np.float64)), c)
        if (before == c).all():  # nothing would change from here
            break
    return Topics(c / UNIT, mean / UNIT)


def clustered(x: np.ndarray, k: int = len(TOPICS), rounds: int = ROUNDS) -> Topics:
    """Topics of bags that are at hand; the same rows in any order give the same topics."""
    x = np.rint(x * UNIT)
    return _fitted(lambda step, merged: step(x).astype(np.int64) if len(x) else None, k, rounds)


def topics_of(bags: DataFrame) -> Topics:
    """Topics of all packed bags of a staged table: a pass over its column ``bag`` for each centre and round."""
    held = bags.where("bag is not null").select("bag")
    held = held.coalesce(min(parts_for(bags.sparkSession, held.count(), PART, LEAST_PART), TASKS))

    def over(step: Callable[[np.ndarray], np.ndarray], merged: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray | None:
        def made(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = None
            for batch in source:
                for i in range(0, batch.num_rows, SLICE):
                    x = np.rint(unpacked_bags(batch.column("bag").slice(i, SLICE).to_pylist()) * UNIT)
                    part = step(x).astype(np.int64)
                    found = part if found is None else merged(found, part)
            if found is not None:
                yield pa.record_batch([pa.array([found.tobytes()], pa.binary())], names=["found"])

        rows = held.mapInArrow(made, "found binary").collect()  # one row of up to 16 KB for each of TASKS tasks at most
        parts = [np.frombuffer(bytes(r["found"]), np.int64).reshape(-1, CELLS + 1) for r in rows]
        return reduce(merged, parts) if parts else None

    return _fitted(over, len(TOPICS), ROUNDS)


def fitted_topics(docs: DataFrame) -> Topics:
    """Topics of all documents."""
    bags = staged(counted(docs, GENTLE).select("bag"), "mix-bags")
    topics = topics_of(bags)
    discarded(bags)
    return topics


def draw(doc_id: int | None, text: bytes | None, seed: int) -> float:
    """A number in [0, 1) that depends on the id, the text and the seed alone."""
    return xxhash.xxh3_64_intdigest(f"{doc_id}\n".encode() + (text or b""), seed) / 2.0**64


def _features(batch: pa.RecordBatch, texts: list[bytes | None], named: dict[str, frozenset[str]]) -> list[tuple[str, str, int, bytes | None]]:
    def category(name: str) -> list[str]:
        return [x if x in named[name] else OTHER for x in batch.column(name).to_pylist()]

    words = [hashes((t or b"").split()) for t in texts]
    return list(zip(category("source"), category("lang"), map(len, words), map(packed_bag, words), strict=True))


def _named(mix: Mix) -> dict[str, frozenset[str]]:
    return {c: frozenset(getattr(mix, c).shares) for c in _COLUMNS}


def targets_of(target: Target, seen: dict[str, float]) -> dict[str, float]:
    """Shares that sum to 1 over the categories that hold tokens."""
    total = sum(seen.values())
    want = {}
    for k, mass in seen.items():
        share = target.shares.get(k) if k in target.shares else (None if any(v is None for v in target.shares.values()) else max(0.0, 1 - sum(target.shares.values())))
        want[k] = (mass / total) ** target.power if share is None else share
    free = {k for k in want if k in target.shares and target.shares[k] is None}
    loose, fixed = sum(want[k] for k in free), sum(v for k, v in want.items() if k not in free)
    if loose and fixed and any(v is not None for v in target.shares.values()):
        kept = sum(seen[k] for k in free) / total
        want = {k: v / loose * kept if k in free else v / fixed * (1 - kept) for k, v in want.items()}
    whole = sum(want.values())
    return {k: v / whole for k, v in want.items()} if whole else {k: mass / total for k, mass in seen.items()}


def raked(cells: dict[tuple[str, str, str], int], mix: Mix, rounds: int = 1000, near: float = 1e-9) -> dict[tuple[str, str, str], float]:
    """The sampling probability of each cell."""
    held = {k: n for k, n in cells.items() if n > 0}
    if not held:
        return dict.fromkeys(cells, 1.0)
    keys = sorted(held)
    supply = np.array([held[k] for k in keys], float)
    budget = supply.sum() * mix.budget
    sides = []
    for d, name in enumerate(_COLUMNS):
        values = sorted({k[d] for k in keys})
        at = np.array([values.index(k[d]) for k in keys])
        seen = np.bincount(at, supply, len(values))
        want = targets_of(getattr(mix, name), dict(zip(values, seen.tolist(), strict=True)))
        sides.append((at, np.array([want[v] for v in values]) * budget))
    mass = supply * mix.budget
    for _ in range(rounds):
        before = mass.copy()
        for at, want in sides:
            got = np.bincount(at, mass, len(want))
            mass = np.minimum(mass * (want / np.where(got > 0, got, 1))[at], supply)
        if np.abs(mass - before).max() <= near * budget:
            break
    fitted = dict(zip(keys, (mass / supply).tolist(), strict=True))
    return {k: fitted.get(k, 1.0) for k in cells}


def balance(cells: dict[tuple[str, str, str], int], chances: dict[tuple[str, str, str], float], mix: Mix) -> list[tuple[str, str, float, float]]:
    """(marginal, category, share asked for, share that the fit comes to): the supply may fall short of a target."""
    mass = {k: n * chances[k] for k, n in cells.items() if n > 0}
    whole, out = sum(mass.values()) or 1.0, []
    for d, name in enumerate(_COLUMNS):
        seen: dict[str, float] = {}
        got: dict[str, float] = {}
        for k, m in mass.items():
            seen[k[d]] = seen.get(k[d], 0.0) + cells[k]
            got[k[d]] = got.get(k[d], 0.0) + m
        want = targets_of(getattr(mix, name), seen) if seen else {}
        out += [(name, k, want[k], got[k] / whole) for k in sorted(want)]
    return out


def counted(docs: DataFrame, mix: Mix, whole: bool = False) -> DataFrame:
    """doc_id, source, lang, n_tokens, the packed bag and the draw of every document; with its whole row, if that is asked for."""
    named = _named(mix)
    held = ["doc_id", *(["row"] if whole else [])]
    types = {"source": pa.string(), "lang": pa.string(), "n_tokens": pa.int64(), "bag": pa.binary(), "u": pa.float64()}
    told = {"n_tokens": T.LongType(), "bag": T.BinaryType(), "u": T.DoubleType()}

    def made(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in batches(source):
            ids = batch.column("doc_id").to_pylist()
            found = _features(batch, texts, named)
            columns = zip(*((*f, draw(i, t, mix.seed)) for i, f, t in zip(ids, found, texts, strict=True)), strict=True)
            yield pa.record_batch([*(batch.column(c) for c in held), *(pa.array(c, t) for c, t in zip(columns, types.values(), strict=True))], names=[*held, *types])

    columns = [F.col(c).cast("string").alias(c) if c in docs.columns else F.lit(None).cast("string").alias(c) for c in ("source", "lang", "text")]
    row = [F.struct("*").alias("row")] if whole else []
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *row, *columns)
    schema = T.StructType([picked.schema[c] for c in held] + [T.StructField(c, told.get(c, T.StringType())) for c in types])
    return picked.mapInArrow(made, schema)


def _topic(topics: Topics) -> Column:
    """The topic of the packed bag; 0 without words."""

    @F.arrow_udf("string")
    def near(bags: pa.Array) -> pa.Array:
        out = []
        for i in range(0, len(bags), SLICE):
            some = bags.slice(i, SLICE).to_pylist()
            held = [b for b in some if b is not None]
            found = iter(topics.near(unpacked_bags(held)).tolist() if held else [])
            out += ["0" if b is None else str(next(found)) for b in some]
        return pa.array(out, pa.string())

    return near("bag")


def measured(docs: DataFrame, mix: Mix, topics: Topics | None = None, whole: bool = False) -> DataFrame:
    """doc_id, source, lang, topic, n_tokens and the draw of every document; with its whole row, if that is asked for.

    Texts are read once: what is counted of them is staged, topics are fitted on the bags there and given as they are read.
    """
    rows = staged(counted(docs, mix, whole), "mix-rows")
    return rows.withColumn("topic", _topic(topics or topics_of(rows))).select("doc_id", *(["row"] if whole else []), *_COLUMNS, "n_tokens", "u")


def cells_of(rows: DataFrame) -> dict[tuple[str, str, str], int]:
    found = rows.groupBy(*_COLUMNS).agg(F.sum("n_tokens").alias("n")).collect()  # bounded by the named categories
    return {tuple(r[c] for c in _COLUMNS): r["n"] for r in found}


def _decided(rows: DataFrame, mix: Mix) -> DataFrame:
    chances = raked(cells_of(rows), mix)
    cells = rows.sparkSession.createDataFrame([(*k, p) for k, p in sorted(chances.items())], "source string, lang string, topic string, probability double")
    return rows.join(F.broadcast(cells), list(_COLUMNS)).withColumn("kept", F.col("u") < F.col("probability"))


def mixed_docs(docs: DataFrame, mix: Mix = GENTLE) -> DataFrame:
    """The sampled documents, with all their columns. Texts are measured once, beside their rows."""
    return unwrapped(_decided(measured(docs, mix, whole=True), mix).where("kept"), docs)


def op2_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cell, probability and decision of every document."""
    rows = measured(table(spark, sf_dir, "documents"), PRODUCTION)
    return _decided(rows, PRODUCTION).select("doc_id", *_COLUMNS, "n_tokens", "probability", "kept")


def mix_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the registered mix asks of each category, and what its fit comes to."""
    cells = cells_of(measured(table(spark, sf_dir, "documents"), PRODUCTION))
    return spark.createDataFrame(balance(cells, raked(cells, PRODUCTION), PRODUCTION), "marginal string, category string, target double, achieved double")


QUERIES = {"op2_mix": op2_mix, "mix_balance": mix_balance}
ORACLES: dict[str, str] = {}
