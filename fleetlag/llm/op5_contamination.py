"""Benchmark decontamination through a positional inverted index, in DataFrame operations only.

1. Test items are cut into windows of ``WINDOW`` consecutive words (a shorter item is one window); equal windows
   of several items are kept once.
2. All training words that are test words are counted, and every window gets its two rarest words with their
   offsets (ties: smaller word, then smaller offset).
3. The index holds the postings (document, position) of those words. Postings turn into offset-adjusted start
   positions; a start where both words agree is a candidate.
4. The candidates of a document meet its text, and the whole window is compared with the words there.

The lists of a frequent word are spread over documents, never gathered by word. Test-side tables are broadcast
only if their measured size is under ``BROADCAST_BYTES``, otherwise they are joined by shuffles.

Rows: null and empty texts have no words; such items have no window; rows without doc_id or item_id are left
out; repeated documents are judged each, repeated items count once. Items of one word need one posting. Other
columns are ignored. ``proximity`` finds items whose rarest words stand close together in any order.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlag.session import cut_lineage

WINDOW = 13
SHARE = 20
BROADCAST_BYTES = 8 << 20

_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_OTHERS = "".join(chr(c) for c in range(128) if not chr(c).isalnum())


def words_of(text: Column) -> Column:
    """Runs of letters, digits and non-ASCII characters, A-Z in lower case."""
    spaced = F.translate(F.coalesce(text, F.lit("")), _CAPITALS + _OTHERS, _CAPITALS.lower() + " " * len(_OTHERS))
    return F.array_remove(F.split(spaced, " "), "")


def keyed_docs(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    ).where("doc_id IS NOT NULL")


def with_hash(docs: DataFrame) -> DataFrame:
    """``doc_id`` and a hash of the text tell the rows apart, should an id be repeated."""
    return docs.withColumn("text_hash", F.xxhash64("text"))


def fitting(df: DataFrame) -> DataFrame:
    """``df`` (already written) with a broadcast hint if its measured size is under the bound."""
    size = df.select(F.sum(F.octet_length(F.to_json(F.struct(*df.columns))))).first()[0] or 0
    return F.broadcast(df) if size < BROADCAST_BYTES else df


def item_windows(benchmark: DataFrame) -> DataFrame:
    """Distinct windows: ``window_id, words, items``."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), words_of(F.col("text")).alias("w"))
    cut = items.where(F.col("item_id").isNotNull() & (F.size("w") > 0)).select(
        "item_id", "w", F.explode(F.sequence(F.lit(1), F.greatest(F.size("w") - WINDOW + 1, F.lit(1)))).alias("at")
    )
    grouped = cut.select("item_id", F.slice("w", F.col("at"), WINDOW).alias("words")).groupBy("words")
    return grouped.agg(F.collect_set("item_id").alias("items")).withColumn("window_id", F.monotonically_increasing_id())


def word_rows(docs: DataFrame, *keys: str) -> DataFrame:
    return docs.select(*keys, F.posexplode(words_of(F.col("text"))).alias("pos", "word"))


def test_word_counts(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """Occurrences in the training text of every test word."""
    found = word_rows(docs).join(fitting(terms), "word").groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return terms.join(found, "word", "left").select("word", F.coalesce("n", F.lit(0)).alias("n"))


def seeds(windows: DataFrame, counts: DataFrame) -> DataFrame:
    """The two rarest words of each window: ``window_id, word, offset, needed``."""
    rows = windows.select("window_id", F.posexplode("words").alias("offset", "word")).join(counts, "word")
    rarest = Window.partitionBy("window_id").orderBy("n", "word", "offset")
    kept = rows.withColumn("r", F.row_number().over(rarest)).where("r <= 2")
    return kept.withColumn("needed", F.count(F.lit(1)).over(Window.partitionBy("window_id"))).select(
        "window_id", "word", "offset", "needed"
    )


def candidates(docs: DataFrame, seed: DataFrame) -> DataFrame:
    """Starts where all seeds of a window agree: ``doc_id, text_hash, window_id, start``."""
    words = cut_lineage(seed.select("word").distinct())
    index = word_rows(docs, "doc_id", "text_hash").join(fitting(words), "word")
    starts = index.join(fitting(seed), "word").select(
        "doc_id", "text_hash", "window_id", (F.col("pos") - F.col("offset")).alias("start"), "needed"
    )
    agreed = starts.where("start >= 0").groupBy("doc_id", "text_hash", "window_id", "start")
    return agreed.agg(F.count(F.lit(1)).alias("n"), F.first("needed").alias("needed")).where("n >= needed").drop("n", "needed")


def phrase_matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Every document with ``words`` and ``hits``: the windows that occur (start, length, items)."""
    d = with_hash(keyed_docs(docs))
    windows = cut_lineage(item_windows(benchmark))
    terms = cut_lineage(windows.select(F.explode("words").alias("word")).distinct())
    seed = cut_lineage(seeds(windows, test_word_counts(d, terms)))
    found = candidates(d, seed).join(fitting(windows), "window_id")
    per_document = found.groupBy("doc_id", "text_hash").agg(
        F.collect_list(F.struct("start", F.size("words").alias("n"), "words", "items")).alias("found")
    )
    met = d.join(per_document, ["doc_id", "text_hash"], "left").select("doc_id", words_of(F.col("text")).alias("words"), "found")
    exact = F.filter("found", lambda c: F.slice(F.col("words"), c["start"] + 1, c["n"]) == c["words"])
    return met.select("doc_id", "words", F.coalesce(exact, F.array().cast(met.schema["found"].dataType)).alias("hits"))


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated`` of every document."""
    spans = F.array_sort(F.array_distinct(F.transform("hits", lambda h: F.struct(h["start"], (h["start"] + h["n"]).alias("end")))))
    covered = F.aggregate(
        spans,
        F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
        lambda a, s: F.struct(
            F.greatest(a["end"], s["end"]).alias("end"),
            (a["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(a["end"], s["start"]))).alias("n"),
        ),
        lambda a: a["n"].cast("long"),
    )
    items = F.array_sort(F.array_distinct(F.flatten(F.transform("hits", lambda h: h["items"]))))
    rows = phrase_matches(docs, benchmark).select(
        "doc_id", F.size("words").cast("long").alias("n_words"), covered.alias("n_hit"), items.alias("items")
    )
    return rows.select(
        "doc_id", "n_words", "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (SHARE * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


def proximity(docs: DataFrame, benchmark: DataFrame, terms: int = 3, within: int = 20) -> DataFrame:
    """Places where an item's ``terms`` rarest distinct words stand within ``within`` words: ``doc_id, item_id, pos``."""
    d = with_hash(keyed_docs(docs))
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.explode(words_of(F.col("text"))).alias("word"))
    items = cut_lineage(items.where("item_id IS NOT NULL").distinct())
    counts = test_word_counts(d, cut_lineage(items.select("word").distinct()))
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy("n", "word"))
    rare = items.join(counts, "word").withColumn("r", rank).where(F.col("r") <= terms)
    rare = cut_lineage(rare.withColumn("needed", F.max("r").over(Window.partitionBy("item_id"))).drop("n"))
    index = word_rows(d, "doc_id", "text_hash").join(fitting(cut_lineage(rare.select("word").distinct())), "word")
    places = index.join(fitting(rare), "word")
    # positions are cut into blocks, each seen with its neighbours, so that no document is one group
    block = F.col("pos").cast("int") / F.lit(8 * within)
    home = F.floor(block)
    spread = places.withColumn("home", home).withColumn(
        "block", F.explode(F.array_distinct(F.array(home, F.floor(block - 0.125), F.floor(block + 0.125))))
    )
    near = Window.partitionBy("doc_id", "text_hash", "item_id", "block").orderBy("pos").rangeBetween(0, within - 1)
    return (
        spread.withColumn("met", F.size(F.collect_set("r").over(near)))
        .where("met = needed AND block = home")
        .select("doc_id", "item_id", "pos")
        .distinct()
    )

