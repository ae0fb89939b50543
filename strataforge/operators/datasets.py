"""Data sets for fine-tuning: from candidates and ledgers to split rows, a manifest and its checks."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataforge.functions.scalars import sha256_mod


def reviewed_view(rows: DataFrame, decisions: DataFrame, repairs: DataFrame, key: str, content: list[str], verified: Column) -> DataFrame:
    """``rows`` with ``reason``, why a row is left out (null: kept), ``action`` (KEEP or FIX), and ``content`` as repaired.

    In this order: rows that are not verified go, then later copies of the same
    content, then what the review excludes.  Repairs win over the row's own
    fields.  A decision to fix without a repair, or a repair without one, is a reason, too.
    """
    digest = F.sha2(F.concat_ws("\x1f", *(F.sha2(F.coalesce(F.col(c), F.lit("")), 256) for c in content)), 256)
    keyed = rows.withColumn("digest_", digest).withColumn("verified_", F.coalesce(verified, F.lit(False)))
    first = keyed.where("verified_").groupBy("digest_").agg(F.min(key).alias("first_"))
    asked = decisions.select(key, F.col("decision").alias("decision_"))
    fixes = repairs.select(key, F.lit(True).alias("repaired_"), *(F.col(c).alias(f"new_{c}") for c in content if c in repairs.columns))
    joined = keyed.join(first, "digest_", "left").join(asked, key, "left").join(fixes, key, "left")
    fix, repaired = F.coalesce(F.col("decision_") == "FIX", F.lit(False)), F.col("repaired_").isNotNull()
    reason = (
        F.when(~F.col("verified_"), "not_verified").when(F.col(key) != F.col("first_"), "duplicate").when(F.col("decision_") == "EXCLUDE", "review_exclude")
        .when(fix & ~repaired, "missing_repair").when(~fix & repaired, "unasked_repair")
    )
    out = joined.withColumn("reason", reason).withColumn("action", F.when(F.col("reason").isNull(), F.when(fix, "FIX").otherwise("KEEP")))
    for c in content:
        if f"new_{c}" in joined.columns:
            out = out.withColumn(c, F.when(F.col("reason").isNull(), F.coalesce(f"new_{c}", c)).otherwise(F.col(c)))
    return out.drop("digest_", "verified_", "first_", "decision_", "repaired_", *(f"new_{c}" for c in content))


def split_side(key: Column, known: Column, seed: int) -> Column:
    """The known side of a row; of unknown ones every tenth by the hash of seed and key is validation."""
    return F.coalesce(known, F.when(sha256_mod(F.concat(F.lit(f"{seed}:"), key.cast("string")), 10) == 0, "validation").otherwise("train"))


def chat_rows(view: DataFrame, key: str, system: str, query: Column, answer: Column, variants: int = 1) -> DataFrame:
    """Training rows of the kept ones: an id for each variant, and system, user and assistant messages."""
    kept = view.where("reason is null").withColumn("variant", F.explode(F.sequence(F.lit(1), F.lit(variants))))
    message = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    return kept.select(F.concat_ws(":q", F.col(key).cast("string"), F.col("variant").cast("string")).alias("id"), F.col(key).alias("source_id"), "split", F.array(message("system", F.lit(system)), message("user", query), message("assistant", answer)).alias("messages"))


def manifest(view: DataFrame, key: str, source_chars: Column, chars: Column) -> DataFrame:
    """One row of counts: groups, rows by side, reasons, leakage, and how much shorter the answers are than their sources."""
    kept = F.col("reason").isNull()
    side = lambda s: F.count_if(kept & (F.col("split") == s))
    sums = view.agg(F.count_if(kept).alias("source_groups"), side("train").alias("train_rows"), side("validation").alias("validation_rows"), F.count_if(~kept).alias("excluded_count"), F.count_if(F.col("action") == "FIX").alias("repairs_applied"), F.sum(F.when(kept, source_chars)).alias("source_chars"), F.sum(F.when(kept, chars)).alias("chars"))
    sides = view.where(kept).groupBy(key).agg(F.count_distinct("split").alias("sides")).agg(F.coalesce(F.max("sides") > 1, F.lit(False)).alias("group_leakage"))
    # two tables of one row each
    both = sums.crossJoin(sides)
    return both.withColumn("reduction", F.when(F.col("source_chars") > 0, F.round(1 - F.col("chars") / F.col("source_chars"), 6)))


def preflight_errors(rows: DataFrame, key: str, messages: str, roles: tuple[str, ...], prompt: str) -> DataFrame:
    """Rows whose messages have other roles than asked, or another system prompt; ``errors`` lists both."""
    found = F.transform(messages, lambda m: m["role"])
    errors = F.array_compact(F.array(
        F.when(~F.coalesce(found == F.array(*(F.lit(r) for r in roles)), F.lit(False)), F.lit("roles")),
        F.when(~F.coalesce(F.get(messages, F.lit(0))["content"] == prompt, F.lit(False)), F.lit("prompt")),
    ))
    return rows.select(key, errors.alias("errors")).where(F.size("errors") > 0)


def report_errors(manifest: dict, quality: dict | None, tokens: dict | None, prompt_sha256: str) -> list[str]:
    """What keeps a data set from training: a stale prompt, gates that did not pass, or reports over other rows.  Every schema version is checked."""
    errors = [] if manifest.get("system_prompt_sha256") == prompt_sha256 else ["stale prompt"]
    groups = manifest.get("source_groups")
    if quality is None:
        errors.append("no quality report")
    else:
        errors += [] if quality.get("static_valid") is True and quality.get("runtime_valid") is True else ["gates not passed"]
        errors += [] if quality.get("converted_rows") == groups else ["quality report over other rows"]
    if tokens is None:
        errors.append("no tokenizer report")
    else:
        errors += ["rows over the limit"] if tokens.get("over_limit") or tokens.get("enable_thinking") is not False else []
        errors += [] if tokens.get("rows") == groups else ["tokenizer report over other rows"]
    return errors


def episode_errors(records: DataFrame, episode: str, claimed: DataFrame, wanted: int = 10) -> DataFrame:
    """Episodes that are not accepted: another number of records than ``wanted``, a record that is not ``accepted``, or a claim (``accepted_count``) that differs."""
    seen = records.groupBy(episode).agg(F.count("*").alias("n"), F.count_if(F.coalesce(F.col("status") == "accepted", F.lit(False))).alias("ok"))
    both = seen.join(claimed.select(episode, "accepted_count"), episode, "full")
    errors = F.array_compact(F.array(F.when(F.coalesce("n", F.lit(0)) != wanted, "records"), F.when(F.coalesce("ok", F.lit(0)) != F.coalesce("n", F.lit(0)), "status"), F.when(F.coalesce("accepted_count", F.lit(-1)) != wanted, "claim")))
    return both.select(episode, F.array_join(errors, ",").alias("errors")).where("errors <> ''")


def first_by_two_keys(rows: DataFrame, order: str, first: str, second: str, save) -> DataFrame:
    """``rows`` with ``accepted``: in the given order, a row is accepted unless an accepted one before it has either of its keys; null and empty keys match nothing.

    A round accepts each undecided row that is the earliest of both its keys, and
    refuses those that share a key with an accepted one.  ``save(df)`` writes a
    table and reads it back.  Unlike a walk over sorted rows this needs no order
    across tasks; rounds are as many as the longest chain of rows that wait for each other.
    """
    key = lambda c: F.when(F.col(c).cast("string") != "", F.col(c).cast("string"))
    left = save(rows.select(order, key(first).alias("k1"), key(second).alias("k2")))
    rounds: list[DataFrame] = []
    while not left.isEmpty():
        low = lambda k: left.where(f"{k} is not null").groupBy(k).agg(F.min(order).alias(f"low_{k}"))
        seen = left.join(low("k1"), "k1", "left").join(low("k2"), "k2", "left")
        mine = F.coalesce(F.col("low_k1") == F.col(order), F.lit(True)) & F.coalesce(F.col("low_k2") == F.col(order), F.lit(True))
        seen = save(seen.select(order, "k1", "k2", mine.alias("accepted")))
        taken = seen.where("accepted")
        rest = seen.where("not accepted")
        gone = lambda k: taken.where(f"{k} is not null").select(F.col(k), F.lit(True).alias(f"gone_{k}"))
        rest = save(rest.join(gone("k1"), "k1", "left").join(gone("k2"), "k2", "left").select(order, "k1", "k2", (F.col("gone_k1").isNotNull() | F.col("gone_k2").isNotNull()).alias("out")))
        rounds += [taken.select(order, "accepted"), rest.where("out").select(order, F.lit(False).alias("accepted"))]
        left = save(rest.where("not out").select(order, "k1", "k2"))
    if not rounds:
        return rows.withColumn("accepted", F.lit(True))
    decided = rounds[0]
    for one in rounds[1:]:
        decided = decided.unionByName(one)
    return rows.join(decided, order, "left")


def _fold(batches):
    """One value for each key of sorted rows, folded as they come; a task holds one number."""
    key, x, any_row, out = None, 0.0, False, []
    for batch in batches:
        for k, op, v in zip(*(batch.column(n).to_pylist() for n in range(3)), strict=True):
            if not any_row or k != key:
                if any_row:
                    out.append((key, x))
                key, x, any_row = k, 1.0 if op in ("mul", "div") else 0.0, True
            if op == "set":
                x = v
            elif op == "add":
                x += v
            elif op == "sub":
                x -= v
            elif op == "mul":
                x *= v
            elif op == "div" and v != 0:
                x /= v
        yield _values_of(out, batch)
        out = []
    if any_row:
        yield _values_of([(key, x)], batch)


def _values_of(rows: list[tuple], batch: pa.RecordBatch) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], batch.schema.field(0).type), pa.array([x for _, x in rows], pa.float64())], names=[batch.schema.names[0], "value"])


def fold_operations(rows: DataFrame, key: str, order: str, op: str, value: str) -> DataFrame:
    """The number that each key holds after its ``set``, ``add``, ``sub``, ``mul`` and ``div`` operations, in their order.

    A key starts at 1 if its first operation multiplies or divides, at 0
    otherwise; a division by zero changes nothing, and neither does an unknown
    operation; a null value counts as 0.  Rows of one place are taken by
    operation and value.  The operations are doubles, one after the other, as
    sums and products would round differently.  What lies before the last
    ``set`` of a key is dropped first, so that keys which are set now and then stay short.
    """
    v = F.coalesce(F.col(value).cast("double"), F.lit(0.0))
    rows = rows.select(F.col(key), F.col(op).alias("op_"), v.alias("v_"), F.col(order).alias("at_"))
    since = rows.where("op_ = 'set'").groupBy(F.col(key).alias("k_")).agg(F.max("at_").alias("since_"))
    rows = rows.join(since, F.col(key).eqNullSafe(F.col("k_")), "left").where("since_ is null or at_ >= since_").select(key, "op_", "v_", "at_")
    kind = rows.schema[key].dataType.simpleString()
    return rows.repartition(key).sortWithinPartitions(key, "at_", "op_", "v_").select(key, "op_", "v_").mapInArrow(_fold, f"`{key}` {kind}, value double")


def repeated(rows: DataFrame, times: Column, most: int = 100_000) -> DataFrame:
    """The rounds of counted loops as rows with ``round`` from 0; a loop of more than ``most`` rounds fails instead of being cut."""
    n = F.when(times > most, F.raise_error(F.lit(f"a loop has more than {most} rounds")).cast("int")).otherwise(F.greatest(times.cast("int"), F.lit(0)))
    return rows.withColumn("round", F.explode(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))))
