"""Benchmark decontamination with DataFrame functions only.

Windows of the test items are hashed; word windows of the documents are hashed by doubling (the hash of 2, 4, 8 words
comes from two halves, any other length from two overlapping halves), looked up in the set of item hashes and verified by
their words.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardlens.llm.common import count_words, match_rows, text_hash, words_of

WINDOW_WORDS = 13
BROADCAST_WINDOWS = 4_000_000  # item windows up to this many (8 bytes each) are sent to all executors, more are shuffled


def _base(length: int) -> int:
    """The largest power of two within a length."""
    return 1 << (length.bit_length() - 1)


def _pair(hashes: str, count: Column, length: int, half: int, offset: int) -> Column:
    """Window hashes of ``length`` words from windows of ``half`` words that start ``offset`` words apart."""
    starts = F.slice(F.col(hashes), 1, F.greatest(count - length + 1, F.lit(0)))
    return F.transform(starts, lambda x, i: F.xxhash64(x, F.get(F.col(hashes), i + offset)))


def _with_hashes(df: DataFrame, lengths: list[int]) -> DataFrame:
    """Column ``_h<length>`` with the window hashes for each wanted length, from the words in ``_w``."""
    df = df.withColumn("_n", F.size("_w")).withColumn("_h1", F.transform("_w", lambda w: F.xxhash64(w)))
    size = 1
    while size * 2 <= max(lengths):
        df = df.withColumn(f"_h{size * 2}", _pair(f"_h{size}", F.col("_n"), size * 2, size, size))
        size *= 2
    for length in lengths:
        base = _base(length)
        if base != length:
            df = df.withColumn(f"_h{length}", _pair(f"_h{base}", F.col("_n"), length, base, length - base))
    return df


def _windows(df: DataFrame, lengths: list[int], keys: list[str]) -> DataFrame:
    """(keys, _w, length, pos, hash): one row per window."""
    hashed = _with_hashes(df, lengths)
    # The outer form: from the inner one Spark derives a filter on the array, which it would compute twice.
    if len(lengths) == 1:
        out = hashed.select(*keys, "_w", F.lit(lengths[0]).alias("length"), F.posexplode_outer(f"_h{lengths[0]}").alias("pos", "hash"))
    else:
        per_length = [F.struct(F.lit(m).alias("length"), F.col(f"_h{m}").alias("hashes")) for m in lengths]
        listed = hashed.select(*keys, "_w", F.explode_outer(F.array(*per_length)).alias("_p"))
        out = listed.select(*keys, "_w", F.col("_p.length").alias("length"), F.posexplode_outer("_p.hashes").alias("pos", "hash"))
    return out.where(F.col("pos").isNotNull())


def _gram() -> Column:
    return F.concat_ws(" ", F.slice("_w", F.col("pos") + 1, F.col("length")))


def item_windows(items: DataFrame, item_col: str = "item_id", text_col: str = "text", n: int = WINDOW_WORDS,
                 lengths: list[int] | None = None) -> DataFrame:
    """Distinct (item, length, hash, gram) of the items; an item of fewer words than ``n`` is one window."""
    words = items.select(F.col(item_col).alias("_item"), words_of(F.col(text_col)).alias("_w")).where(F.size("_w") > 0)
    lengths = lengths or window_lengths(items, text_col, n)
    if not lengths:
        return words.select("_item", F.lit(0).alias("length"), F.lit(0).cast("long").alias("hash"), F.lit("").alias("gram")).limit(0)
    own = F.least(F.size("_w"), F.lit(n))
    return (_windows(words, lengths, ["_item"]).where(F.col("length") == own)
            .select("_item", "length", "hash", _gram().alias("gram")).distinct())


def window_lengths(items: DataFrame, text_col: str = "text", n: int = WINDOW_WORDS) -> list[int]:
    """The window lengths that occur: at most ``n`` numbers come to the driver."""
    size = F.least(F.size(words_of(F.col(text_col))), F.lit(n))
    return sorted(r[0] for r in items.select(size.alias("m")).where("m > 0").distinct().collect())


def judge(docs: DataFrame, items: DataFrame, n: int = WINDOW_WORDS, share: int = 20, id_col: str = "doc_id",
          text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """(id, _text, n_words, n_hit, spans, items, contaminated), one row per distinct (id, text).

    A document word is hit when it lies inside any occurrence of an item window; ``spans`` are the maximal hit word
    ranges [start, end). A document is contaminated when ``n_hit > 0`` and ``share * n_hit >= n_words``. NULL texts have
    no words; NULL item ids never count as items but their windows do hit. Empty tables give no hits. Repeated items
    and repeated rows change nothing; other columns are not looked at.
    """
    key = ["_id", "_text"]
    source = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t"))
    keyed = source.select("_id", text_hash(F.col("_t")).alias("_text"), words_of(F.col("_t")).alias("_w"))
    sizes = source.select("_id", text_hash(F.col("_t")).alias("_text"), count_words(F.col("_t")).alias("n_words")).distinct()
    lengths = window_lengths(items, text_col, n)
    span = "array<struct<start:int,end:int>>"
    if not lengths:
        found = sizes.select(*key, F.lit(None).cast(span).alias("_at"), F.lit(None).cast("array<string>").alias("_items")).limit(0)
    else:
        grams = item_windows(items, item_col, text_col, n, lengths)
        hashes = grams.select("length", "hash").distinct()
        few = hashes.count() <= BROADCAST_WINDOWS
        windows = _windows(keyed, lengths, key)
        if few:  # windows are looked up where they arise; only hits get their words written out
            hits = windows.join(F.broadcast(hashes), ["length", "hash"], "left_semi").withColumn("gram", _gram())
        else:    # windows are shuffled, each with its own words and not with its document's
            hits = windows.withColumn("gram", _gram()).drop("_w").join(hashes, ["length", "hash"], "left_semi")
        hits = hits.select(*key, F.col("pos").cast("int").alias("start"), (F.col("pos") + F.col("length")).cast("int").alias("end"), "length", "gram")
        at = F.array_sort(F.collect_set(F.struct("start", "end")))
        per_gram = hits.groupBy(*key, "length", "gram").agg(at.alias("_at"))
        verified = per_gram.join(grams.select("length", "gram", F.col("_item").cast("string").alias("_item")), ["length", "gram"])
        found = verified.groupBy(*key).agg(
            F.array_sort(F.array_distinct(F.flatten(F.collect_set("_at")))).alias("_at"), F.array_sort(F.collect_set("_item")).alias("_items"))
    joined = match_rows(sizes, found, key)
    empty = F.array().cast(span)

    def step(acc, s):
        """Fold with one open range, so that the work is linear in the ranges: (closed length, start, end)."""
        apart = s["start"] > acc["end"]
        return F.struct(
            (acc["n"] + F.when(apart, s["end"] - s["start"]).otherwise(F.greatest(s["end"] - acc["end"], F.lit(0)))).alias("n"),
            F.greatest(acc["end"], s["end"]).alias("end"))

    ranges = F.coalesce(F.col("_at"), empty)
    n_hit = F.aggregate(ranges, F.struct(F.lit(0).alias("n"), F.lit(-1).alias("end")), step)["n"].cast("long")
    out = joined.withColumn("n_hit", n_hit).withColumn("items", F.coalesce("_items", F.array().cast("array<string>")))
    return out.select(*key, "n_words", "n_hit", ranges.alias("ranges"), "items",
                      ((F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words"))).alias("contaminated"))


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id") -> DataFrame:
    """One row per document row: id, n_words, n_hit, n_items, items_sha256, contaminated (see ``judge``)."""
    judged = judge(docs, items, id_col=id_col, text_col=text_col, item_col=item_col)
    rows = docs.select(F.col(id_col).alias("_id"), text_hash(F.col(text_col)).alias("_text"))
    return match_rows(rows, judged, ["_id", "_text"]).select(
        F.col("_id").alias(id_col), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The document rows that are not contaminated, with all their columns; texts are not changed."""
    bad = judge(docs, items, id_col=id_col, text_col=text_col).where("contaminated").select("_id", "_text")
    match = docs[id_col].eqNullSafe(bad["_id"]) & (text_hash(docs[text_col]) == bad["_text"])
    return docs.join(bad, match, "left_anti")
