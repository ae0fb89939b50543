"""Corpus curation: exact duplicates, splits, quotas, ledgers."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataforge.functions.scalars import sha256_mod


def first_of_each(df: DataFrame, key: Column, order: str) -> DataFrame:
    """``order`` of the first row of each key, and the number of rows; partial minima keep a frequent key small."""
    return df.groupBy(key.alias("key")).agg(F.min(order).alias(order), F.count("*").alias("copies"))


def squeezed_hash(text: Column) -> Column:
    """Hash of a text without white space, in lower case."""
    return F.sha2(F.lower(F.regexp_replace(text, r"\s+", "")), 256)


def structural_fingerprint(primary: Column, template: Column, intent: Column, skeleton: Column) -> Column:
    """SHA-1 of a sample's kind, template, request without white space, and :func:`tree.skeleton`: samples that differ in values only are alike."""
    text = lambda c: F.coalesce(c, F.lit(""))
    return F.sha1(F.concat_ws("|", text(primary), text(template), F.regexp_replace(text(intent), r"(?U)\s+", ""), text(skeleton)))


def dispositions(df: DataFrame, order: str, text: str, least: int) -> DataFrame:
    """What becomes of each row: too short, a copy of an earlier one, or accepted."""
    first = df.where(F.length(text) >= least).groupBy(F.sha2(text, 256).alias("key")).agg(F.min(order).alias("first_"))
    joined = df.withColumn("key", F.sha2(text, 256)).join(first, "key", "left")
    what = F.when(F.coalesce(F.length(text), F.lit(0)) < least, "skipped_short").when(F.col(order) != F.col("first_"), "skipped_duplicate").otherwise("accepted")
    return joined.withColumn("disposition", what).drop("key", "first_")


def hash_order_split(df: DataFrame, key: str, seed: int, ratio: float) -> DataFrame:
    """The first ``max(1, round(n * ratio))`` rows in the order of ``sha256(seed:key)`` are validation.

    Ranks are not made for the whole table: counts by the first four digits
    (65,536 at most) tell in which of them the cut falls, and only its rows are ranked.
    """
    hashed = df.withColumn("hash_", F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256)).withColumn("bucket_", F.substring("hash_", 1, 4))
    sizes = hashed.groupBy("bucket_").agg(F.count("*").alias("n_"))
    every = Window.partitionBy(F.lit(0))
    upto = F.sum("n_").over(every.orderBy("bucket_"))
    quota = F.greatest(F.lit(1), F.bround(F.sum("n_").over(every) * F.lit(ratio)).cast("long"))
    sizes = sizes.select("bucket_", (quota - (upto - F.col("n_"))).alias("room_"), "n_")
    joined = hashed.join(sizes, "bucket_")
    whole = joined.where("room_ >= n_ or room_ <= 0").withColumn("split", F.when(F.col("room_") > 0, "validation").otherwise("train"))
    cut = joined.where("room_ > 0 and room_ < n_")
    rank = F.row_number().over(Window.partitionBy("bucket_").orderBy("hash_", key))
    cut = cut.withColumn("split", F.when(rank <= F.col("room_"), "validation").otherwise("train"))
    return whole.unionByName(cut).drop("hash_", "bucket_", "room_", "n_")


def sticky_split(df: DataFrame, key: str, known: DataFrame) -> DataFrame:
    """Known keys keep their side; one in ten of the others, by hash, goes to validation."""
    fresh = F.when(sha256_mod(F.col(key).cast("string"), 10) == 0, "validation").otherwise("train")
    return df.join(known.select(key, F.col("split").alias("known_")), key, "left").withColumn("split", F.coalesce("known_", fresh)).drop("known_")


def blind_position(key: Column) -> Column:
    """Which of two places a case's own answer takes: the parity of its hash."""
    return F.when(sha256_mod(key.cast("string"), 2) == 0, "A").otherwise("B")


def quota_sample(df: DataFrame, category: str, order: list[Column], quota: int, total: int) -> DataFrame:
    """At most ``quota`` rows of each category in order, then the next best of the rest until there are ``total``."""
    rank = F.row_number().over(Window.partitionBy(category).orderBy(*order))
    ranked = df.withColumn("place_", rank).where(F.col("place_") <= total)
    # at most ``total`` rows of each category are left here
    overall = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("place_") > quota, *order))
    return ranked.withColumn("pick_", overall).where((F.col("pick_") <= total) | (F.col("place_") <= quota)).withColumn("reason", F.when(F.col("place_") <= quota, "quota").otherwise("backfill")).drop("place_", "pick_")


def overlay(base: DataFrame, repairs: DataFrame, key: str, fields: list[str], action: str) -> DataFrame:
    """Repairs over base rows: fields that a repair has win, excluded rows go."""
    taken = repairs.select(key, F.col(action).alias("action_"), *(F.col(f).alias(f"new_{f}") for f in fields))
    joined = base.join(taken, key, "left").where("action_ is null or action_ <> 'EXCLUDE'")
    for f in fields:
        joined = joined.withColumn(f, F.coalesce(f"new_{f}", f))
    return joined.withColumn("repaired", F.col("action_").isNotNull()).drop("action_", *(f"new_{f}" for f in fields))


def first_seen(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Distinct ``keys`` with ``place``, their number in the order in which they first come up (ties by the keys); distinct values are few, rows may be many."""
    seen = df.groupBy(*keys).agg(F.min(order).alias("first_"))
    return seen.withColumn("place", F.row_number().over(Window.orderBy("first_", *keys))).drop("first_")


def set_relations(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Every key of two sets with where it is: ``left``, ``right`` or ``both``; null keys are equal."""
    rows = left.select(*keys, F.lit(1).alias("l_"), F.lit(0).alias("r_")).unionByName(right.select(*keys, F.lit(0).alias("l_"), F.lit(1).alias("r_")))
    side = F.when((F.max("l_") == 1) & (F.max("r_") == 1), "both").when(F.max("l_") == 1, "left").otherwise("right")
    return rows.groupBy(*keys).agg(side.alias("side"))


def key_mismatches(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys that only one of two ledgers has."""
    a = left.select(key).distinct().withColumn("in_left", F.lit(True))
    b = right.select(key).distinct().withColumn("in_right", F.lit(True))
    both = a.join(b, key, "full_outer").where("in_left is null or in_right is null")
    return both.select(key, F.when(F.col("in_left"), "extra").otherwise("missing").alias("problem"))


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    """Keys that are null or occur more than once: what a unique-key build must refuse."""
    return df.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n").__gt__(1) | F.col(key).isNull())


def resume(todo: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    return todo.join(done.select(*keys), keys, "left_anti")


#: Keys that may be broadcast, and items of fewer than three tokens in one pass over the texts, about.
BROADCAST_KEYS, SHORT_ITEMS = 2_000_000, 2_000


def shared_word_grams(left: DataFrame, right: DataFrame, left_id: str, right_id: str, text: str, size: int) -> DataFrame:
    """Pairs that share word runs of ``size``, with how many distinct ones: an equality join instead of all pairs.

    ``right`` is the smaller side.  Its runs go to all executors as long as they
    are few (``BROADCAST_KEYS``), so that of ``left`` only matches are shuffled.
    """

    def grams(df: DataFrame, key: str) -> DataFrame:
        words = F.filter(F.split(F.lower(text), "[^a-z]+"), lambda w: w != "")
        runs = F.expr(f"transform(sequence(1, greatest(size(w) - {size - 1}, 1)), i -> array_join(slice(w, i, {size}), ' '))")
        cut = df.select(key, words.alias("w")).where(F.size("w") >= size)
        return cut.select(key, F.explode(runs).alias("gram"))

    wanted = grams(right, right_id).distinct()
    small = F.broadcast(wanted) if wanted.count() <= BROADCAST_KEYS else wanted
    return grams(left, left_id).join(small, "gram").distinct().groupBy(left_id, right_id).agg(F.count("*").alias("shared"))


#: A token is one letter of a script written without spaces, or a whole run of other letters and digits.
_UNSPACED = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}"
_TOKEN = rf"[{_UNSPACED}]|[\p{{L}}\p{{N}}&&[^{_UNSPACED}]]+"


def whole_items(docs: DataFrame, items: DataFrame, doc_id: str, item_id: str, text: str, size: int = 8) -> DataFrame:
    """``(doc_id, item_id)`` for each document and item whose whole text stands in the document's.

    The tokens of an item but its first and last stand whole in every text that
    holds it.  A run of up to ``size`` of them, the one with the most letters,
    is the item's key, and texts with the key are verified.  Items of fewer
    than three tokens have no such run and are looked for in every text.
    """
    tokens = lambda df: df.withColumn("w", F.regexp_extract_all(text, F.lit(_TOKEN), 0))
    runs = lambda w, n: f"if(size({w}) < {n}, array(), transform(sequence(1, greatest(size({w}) - {n} + 1, 1)), i -> array_join(slice({w}, i, {n}), ' ')))"
    cut = tokens(items.where(F.col(text).isNotNull()).select(F.col(item_id).alias("item"), F.col(text).alias("item_text"), text))
    inner = cut.where(F.size("w") > 2).withColumn("w", F.slice("w", F.lit(2), F.size("w") - 2)).withColumn("n", F.least(F.size("w"), F.lit(size)))
    keys = inner.withColumn("runs", F.expr(runs("w", "n"))).select("item", "item_text", "n", F.expr("array_max(transform(runs, r -> struct(length(r) as l, r as r))).r").alias("key"))
    sizes = sorted(r["n"] for r in keys.select("n").distinct().collect())
    short = cut.where(F.size("w") <= 2).select("item", "item_text")
    held = F.contains(F.col(text), F.col("item_text"))
    # items without such a run are looked for in every text, a block of them at a time; blocks bound what is broadcast
    blocks = max(1, math.ceil(short.count() / SHORT_ITEMS))
    found = None
    for b in range(blocks):
        some = short.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b)
        one = docs.select(doc_id, text).crossJoin(F.broadcast(some)).where(held).select(doc_id, F.col("item").alias(item_id))
        found = one if found is None else found.unionByName(one)
    if not sizes:
        return found
    grams = tokens(docs.select(doc_id, text)).select(F.col(doc_id).alias("doc"), F.explode(F.concat(*(F.expr(runs("w", n)) for n in sizes))).alias("key"))
    wanted = keys.select("key").distinct()
    near = grams.join(F.broadcast(wanted) if wanted.count() <= BROADCAST_KEYS else wanted, "key").distinct()
    texts = docs.select(doc_id, text).join(near, F.col(doc_id).eqNullSafe(F.col("doc")))
    return texts.join(keys, "key").where(held).select(doc_id, F.col("item").alias(item_id)).unionByName(found)
