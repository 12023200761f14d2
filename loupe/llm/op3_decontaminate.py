"""Benchmark decontamination: a broadcast hash set of normalised test n-grams.

All DataFrame expressions. The benchmark's windows of ``n`` words (an item with
fewer words is one window of its own length) form a hash set, broadcast after a
check of its size, items included; a larger set meets the probes through a shuffle
instead, without texts, and only the chunks that it may hit are looked up to verify
them. Documents are cut into overlapping chunks of words before windows are
made, so a row's memory doesn't grow with a document. The set is probed with a
hash of three words of a window, and each hit verified by the equality of the
whole window; then spans or documents are removed.

Defined results: null and empty texts have no words and no hits; rows with the
same id and text give the same result each; a null ``doc_id`` is an id like any
other; an empty benchmark or an item without words hits nothing; items that share a
window are all named; a long text is cut into chunks first. Other columns are kept by ``decontaminated`` and ignored by ``contamination``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loupe.llm.common import staged, table, unwrapped, wrapped

#: What stands between words, once A-Z are lower case.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same for a text in its own case.
CASED_SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WORDS = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words of a chunk that start windows.
CHUNK = 512
#: Largest hash set, in bytes of its windows and item ids and 64 a row, that is broadcast.
BROADCAST_BYTES = 64 << 20


def lowered(text: Column) -> Column:
    """Lower case for A-Z alone. lower() does that faster where no other letter has a lower case."""
    return F.when(text.rlike(r"[[\p{IsUppercase}\p{Lt}]&&[^A-Z]]"), F.translate(text, UPPER, LOWER)).otherwise(F.lower(text))


def words_of(text: Column) -> Column:
    return F.filter(F.split(lowered(F.coalesce(text, F.lit(""))), SEPARATORS, -1), lambda w: w != "")


def _grams(words: Column, length: Column | int, starts: Column) -> Column:
    """(start, gram) of the windows of ``length`` words at places 0 to ``starts`` - 1."""
    made = F.transform(F.sequence(F.lit(1), starts), lambda i: F.struct((i - 1).alias("start"), F.concat_ws(" ", F.slice(words, i, length)).alias("gram")))
    return F.when(starts >= 1, made).otherwise(F.array().cast("array<struct<start:int,gram:string>>"))


def _probe(words: Column, start: Column, length: Column | int) -> Column:
    """A hash of the first, middle and last word of a window, and of its length."""
    length = length if isinstance(length, Column) else F.lit(length)
    return F.xxhash64(length, F.get(words, start), F.get(words, start + F.floor(length / 2).cast("int")), F.get(words, start + length - 1))


def benchmark_grams(benchmark: DataFrame, n: int) -> DataFrame:
    """The distinct windows of the items: gram, length, items (sorted ids as strings)."""
    words = benchmark.select(F.col("item_id").cast("string").alias("item"), words_of(F.col("text")).alias("w")).where(F.size("w") > 0)
    words = words.withColumn("length", F.least(F.size("w"), F.lit(n)))
    each = words.select("item", "length", F.explode(_grams(F.col("w"), F.col("length"), F.size("w") - F.col("length") + 1)).alias("g"))
    return each.groupBy(F.col("g.gram").alias("gram"), "length").agg(F.array_sort(F.collect_set("item")).alias("items"))


def _key(docs: DataFrame) -> DataFrame:
    return docs.withColumn("_text_key", F.xxhash64("text"))


def hits(docs: DataFrame, benchmark: DataFrame, n: int = 13) -> DataFrame:
    """For each document with a hit: doc_id, _text_key, spans (start, end; sorted), items."""
    grams = staged(benchmark_grams(benchmark, n), "grams")
    weight = F.octet_length("gram") + 64 + F.aggregate("items", F.lit(0).cast("long"), lambda a, x: a + F.octet_length(x) + 16)
    size = grams.groupBy("length").agg(F.sum(weight).alias("bytes")).collect()  # n rows at most
    lengths = sorted(r["length"] for r in size)
    words = _key(docs.select("doc_id", "text")).select("doc_id", "_text_key", words_of(F.col("text")).alias("w")).where(F.size("w") > 0)
    cut = F.transform(F.sequence(F.lit(0), F.floor((F.size("w") - 1) / CHUNK).cast("int")), lambda i: F.struct((i * CHUNK).alias("at"), F.slice("w", i * CHUNK + 1, CHUNK + n - 1).alias("w")))
    chunks = words.select("doc_id", "_text_key", F.explode(cut).alias("c")).select("doc_id", "_text_key", "c.at", "c.w")

    def probes(k: int) -> Column:
        starts = F.least(F.lit(CHUNK), F.size("w") - k + 1)
        made = F.transform(F.sequence(F.lit(0), starts - 1), lambda i: _probe(F.col("w"), i, k))
        return F.struct(F.lit(k).alias("length"), F.when(starts >= 1, made).otherwise(F.array().cast("array<bigint>")).alias("probes"))

    sets = F.array(*(probes(k) for k in lengths)) if lengths else F.array().cast("array<struct<length:int,probes:array<bigint>>>")
    grams = grams.withColumn("probe", _probe(F.split("gram", " ", -1), F.lit(0), F.col("length")))
    window = F.concat_ws(" ", F.slice("w", F.col("place") + 1, F.col("k")))
    # between, as an equality would become a join key and be computed for every window
    same = (F.col("k") == F.col("length")) & F.col("gram").between(window, window)
    if sum(r["bytes"] for r in size) <= BROADCAST_BYTES:
        seen = chunks.select("doc_id", "_text_key", "at", "w", F.explode(sets).alias("s")).select("doc_id", "_text_key", "at", "w", F.col("s.length").alias("k"), F.posexplode("s.probes").alias("place", "probe"))
        found = seen.join(F.broadcast(grams), "probe").where(same)
    else:
        seen = chunks.select("doc_id", "_text_key", "at", F.explode(sets).alias("s")).select("doc_id", "_text_key", "at", F.col("s.length").alias("k"), F.posexplode("s.probes").alias("place", "probe"))
        likely = seen.join(grams.drop("items"), "probe").where("k = length").select(F.col("doc_id").alias("_doc"), F.col("_text_key").alias("_key"), F.col("at").alias("_at"), "k", "place", "gram", "length").distinct()
        met = chunks.join(likely, chunks["doc_id"].eqNullSafe(likely["_doc"]) & (chunks["_text_key"] == likely["_key"]) & (chunks["at"] == likely["_at"]))
        found = met.where(same).select("doc_id", "_text_key", "at", "place", "gram", "length").join(grams.select("gram", "length", "items"), ["gram", "length"])
    found = found.select("doc_id", "_text_key", (F.col("at") + F.col("place")).alias("start"), "length", "items")
    return (
        found
        .groupBy("doc_id", "_text_key")
        .agg(
            F.array_sort(F.collect_set(F.struct("start", (F.col("start") + F.col("length")).alias("end")))).alias("spans"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
        )
    )


def _covered(spans: Column) -> Column:
    """Words inside the union of sorted spans."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("to"))
    return F.aggregate(spans, start, lambda a, s: F.struct((a["n"] + F.greatest(s["end"] - F.greatest(s["start"], a["to"]), F.lit(0))).alias("n"), F.greatest(a["to"], s["end"]).alias("to")), lambda a: a["n"])


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = 13) -> DataFrame:
    """One row for each document: doc_id, n_words, n_hit, items, spans, contaminated; _text_key tells rows with one id apart."""
    found = hits(docs, benchmark, n).withColumnsRenamed({"doc_id": "_doc", "_text_key": "_key"})
    all_docs = _key(docs.select("doc_id", "text")).select("doc_id", "_text_key", F.size(words_of(F.col("text"))).cast("long").alias("n_words"))
    joined = all_docs.join(found, all_docs["doc_id"].eqNullSafe(found["_doc"]) & (all_docs["_text_key"] == found["_key"]), "left")
    n_hit = F.coalesce(_covered(F.col("spans")), F.lit(0).cast("long"))
    return joined.select(
        "doc_id",
        "_text_key",
        "n_words",
        n_hit.alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        F.coalesce("spans", F.array().cast("array<struct<start:int,end:int>>")).alias("spans"),
    ).withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def decontaminated(docs: DataFrame, benchmark: DataFrame, n: int = 13) -> DataFrame:
    """The documents without the contaminated ones, and with hit words cut from the others."""
    found = contamination(docs, benchmark, n).where(F.col("n_hit") > 0).select(F.col("doc_id").alias("_doc"), F.col("_text_key").alias("_key"), "spans", "contaminated").dropDuplicates(["_doc", "_key"])
    found = found.withColumnsRenamed({"spans": "_spans", "contaminated": "_out"})
    keyed = _key(wrapped(docs))
    joined = keyed.join(found, keyed["doc_id"].eqNullSafe(found["_doc"]) & (keyed["_text_key"] == found["_key"]), "left").where(~F.coalesce("_out", F.lit(False)))
    seps, words = F.split("text", WORDS, -1), F.filter(F.split("text", CASED_SEPARATORS, -1), lambda w: w != "")
    # zipped first: what a lambda refers to outside its argument is computed for every element
    pairs = F.arrays_zip(words.alias("word"), F.slice(seps, F.lit(2), F.size(seps)).alias("after"))
    kept = F.transform(pairs, lambda x, i: F.when(F.exists("_spans", lambda s: (s["start"] <= i) & (i < s["end"])), F.lit("")).otherwise(F.concat(F.coalesce(x["word"], F.lit("")), F.coalesce(x["after"], F.lit("")))))
    hit = F.col("_spans").isNotNull()
    text = F.when(hit, F.concat(F.get(seps, F.lit(0)), F.array_join(kept, ""))).otherwise(F.col("text"))
    joined = joined.withColumn("_cut", text)
    if "n_chars" not in docs.columns:
        return unwrapped(joined, docs, text=F.col("_cut"))
    return unwrapped(joined, docs, text=F.col("_cut"), n_chars=F.when(hit, F.length("_cut")).otherwise(F.col("row.n_chars")))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hit words and items of every document against the whole benchmark, windows of 13 words."""
    got = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 13)
    return got.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


_ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
g AS (SELECT DISTINCT item, least(13, len(w)) AS k, array_to_string(w[i : i + least(13, len(w)) - 1], ' ') AS gram
      FROM (SELECT item, w, unnest(range(1, CAST(len(w) - least(13, len(w)) + 2 AS BIGINT))) AS i FROM b WHERE len(w) > 0)),
seen AS (SELECT doc_id, i, k, array_to_string(w[i : i + k - 1], ' ') AS gram
         FROM (SELECT doc_id, w, k, unnest(range(1, CAST(len(w) - k + 2 AS BIGINT))) AS i FROM d, (SELECT DISTINCT k FROM g))),
hit AS (SELECT doc_id, i, k, item FROM seen JOIN g USING (gram, k)),
places AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN places USING (doc_id) LEFT JOIN items USING (doc_id)
"""

QUERIES = {"op3_decontaminate": op3_decontaminate}
ORACLES = {"op3_decontaminate": _ORACLE}
