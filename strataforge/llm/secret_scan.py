"""Secret scans by a trigram index, all in Spark expressions.

Each rule's regular expression is reduced to a Boolean query: an OR of sets of
trigrams that any match must hold.  Texts are indexed by the trigrams that the
rules ask for; a text whose postings meet all trigrams of one set is a candidate
and is verified with the expression itself.  Rules without mandatory trigrams
read every text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import BROADCAST_IDS, materialize, table


@dataclass(frozen=True)
class Rule:
    """``pattern`` is a Java and Python regular expression; ``group`` must have ``least`` characters, else the match is dropped."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


#: The first three are the base; the order of kinds decides ties.
RULES = (
    Rule("assign", r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]+", 0, 16),
    Rule("github", r"gh[opsru]_[A-Za-z0-9]+", 0, 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 0, 15),
    Rule("google", r"AIza[A-Za-z0-9_-]+", 0, 39),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 30),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 0),
)
BASE = 3
#: The column of found spans, named so that it clashes with none of the documents'.
SECRETS = "strataforge_secrets"
#: By pattern, group and least length: a match is dropped for its length alone, so this search finds the same ones.
_QUICK = {(r"[0-9a-f]+", 0, 16): r"[0-9a-f]{16,}", (r"AKIA[A-Z0-9]+", 0, 18): r"AKIA[A-Z0-9]{14,}"}
#: Strings that one stretch of a pattern may stand for before it is no longer followed.
_MOST_STRINGS = 64


def _fold(strings: set[str]) -> set[str]:
    return {s.lower() for s in strings}


def mandatory(pattern: str) -> list[frozenset[str]]:
    """Sets of lower-case trigrams of which every match holds one set whole; empty if none can be told."""
    best: set[str] | None = None

    def better(exact: set[str]) -> None:
        nonlocal best
        if min(map(len, exact)) >= 3 and (best is None or (min(map(len, exact)), -len(exact)) > (min(map(len, best)), -len(best))):
            best = set(exact)

    def strings_of(op: str, arg) -> set[str] | None:
        """The strings that one element can stand for, if they are few."""
        if op == "LITERAL":
            return {chr(arg).lower()}
        if op == "IN":
            out = set()
            for kind, value in arg:
                if str(kind) == "LITERAL":
                    out.add(chr(value).lower())
                elif str(kind) == "RANGE" and value[1] - value[0] < 4:
                    out |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
                else:
                    return None
            return out
        if op == "SUBPATTERN":
            return whole(arg[-1])
        if op == "BRANCH":
            parts = [whole(x) for x in arg[1]]
            return None if any(p is None for p in parts) else set().union(*parts)
        if op == "MAX_REPEAT" and arg[1] == 1:
            inner = whole(arg[2])
            return None if inner is None else inner | {""} if arg[0] == 0 else inner
        return None

    def whole(seq) -> set[str] | None:
        out = {""}
        for op, arg in seq:
            one = strings_of(str(op), arg)
            if one is None or len(out) * len(one) > _MOST_STRINGS:
                return None
            out = {a + b for a in out for b in one}
        return out

    exact = {""}
    for op, arg in re._parser.parse(pattern):
        one = strings_of(str(op), arg)
        if one is None or len(exact) * len(one) > _MOST_STRINGS or "" in one and min(map(len, exact)) >= 3:
            better(exact)
            exact = one if one is not None and len(one) <= _MOST_STRINGS else {""}
        else:
            exact = {a + b for a in exact for b in one}
    better(exact)
    return [] if best is None else sorted({frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in _fold(best)}, key=sorted)


def index(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """Postings ``(trigram, doc_id)`` of the trigrams that the rules ask for."""
    present = F.array_compact(F.array(*(F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in trigrams)))
    held = docs.select("doc_id", F.lower("text").alias("low")).select("doc_id", present.alias("held"))
    # the outer form keeps Spark from testing the whole array once more before it
    return held.select("doc_id", F.explode_outer("held").alias("trigram")).where("trigram is not null")


def candidates(docs: DataFrame, rules=RULES) -> DataFrame:
    """``(doc_id, kinds)``: the rules whose query a text's postings meet."""
    queries = [(r.kind, n, t) for r in rules for n, ts in enumerate(mandatory(r.pattern)) for t in sorted(ts)]
    trigrams = sorted({t for _, _, t in queries})
    if not trigrams:
        return docs.sparkSession.createDataFrame([], "doc_id long, kinds array<string>")
    wanted = docs.sparkSession.createDataFrame(queries, "kind string, part int, trigram string")
    needs = wanted.groupBy("kind", "part").agg(F.count("*").alias("needed"))
    # both tables are as large as the rules
    met = index(docs, trigrams).distinct().join(F.broadcast(wanted), "trigram").groupBy("doc_id", "kind", "part").agg(F.count("*").alias("met"))
    return met.join(F.broadcast(needs), ["kind", "part"]).where("met = needed").groupBy("doc_id").agg(F.collect_set("kind").alias("kinds"))


def _searched(rule: Rule) -> str:
    return _QUICK.get((rule.pattern, rule.group, rule.least), rule.pattern)


def _matches(rule: Rule) -> Column:
    """Lengths of the texts between the matches, of the matches, and of the group that must be long enough."""
    text = _searched(rule)
    pattern = F.lit(text)
    gaps = F.transform(F.split("text", text, -1), F.length)
    whole = F.transform(F.regexp_extract_all("text", pattern, F.lit(0)), F.length)
    part = F.transform(F.regexp_extract_all("text", pattern, F.lit(rule.group)), F.length)
    return F.transform(F.arrays_zip(gaps, whole, part), lambda x: F.struct(x["0"].alias("gap"), x["1"].alias("whole"), x["2"].alias("part")))


def spans(docs: DataFrame, rules=RULES) -> DataFrame:
    """``(doc_id, text_key, kind, place, start, end, before)`` for each secret, once for rows that repeat an id and a text.

    Positions are in code points, the end exclusive; ``place`` is the number of
    the kind; ``before`` is the furthest end of earlier spans of the text (by
    start and kind), 0 if none.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    found = materialize(candidates(docs.where("doc_id is not null"), rules), "candidates")
    found = F.broadcast(found) if found.count() <= BROADCAST_IDS else found
    known = docs.join(found, "doc_id", "left")
    lists = []
    for n, rule in enumerate(rules):
        open_to = F.col("text").rlike(_searched(rule))
        if mandatory(rule.pattern):
            asked = F.coalesce(F.array_contains("kinds", rule.kind), F.col("doc_id").isNull())
            open_to = asked & open_to
        one = F.struct(F.lit(n).alias("place"), F.lit(rule.kind).alias("kind"), F.lit(rule.least).alias("least"), _matches(rule).alias("found"))
        lists.append(F.when(open_to, one))
    per_rule = known.select("doc_id", F.xxhash64("text").alias("text_key"), F.explode(F.array_compact(F.array(*lists))).alias("r"))
    rows = per_rule.select("doc_id", "text_key", "r.place", "r.kind", "r.least", F.posexplode("r.found").alias("n", "m")).dropDuplicates(["doc_id", "text_key", "place", "n"])
    # the text after the last match has no match of its own
    rows = rows.where("m.whole is not null")
    upto = Window.partitionBy("doc_id", "text_key", "place").orderBy("n")
    end = F.sum(F.col("m.gap") + F.col("m.whole")).over(upto)
    rows = rows.withColumn("end", end.cast("int")).where("m.part >= least").withColumn("start", F.col("end") - F.col("m.whole"))
    earlier = Window.partitionBy("doc_id", "text_key").orderBy("start", "place").rowsBetween(Window.unboundedPreceding, -1)
    return rows.select("doc_id", "text_key", "kind", "place", "start", "end", F.coalesce(F.max("end").over(earlier), F.lit(0)).alias("before"))


def scan(docs: DataFrame, rules=RULES) -> DataFrame:
    """``docs`` (``doc_id``, ``text``; other columns stay) with ``SECRETS``: its spans, by start and kind.

    A null or empty text, and one without secrets, has an empty list; rows that
    repeat an id, and rows without one, each get the spans of their own text.
    """
    found = spans(docs, rules).groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_list(F.struct("start", "place", "end", "kind", "before"))).alias(SECRETS))
    found = found.select(F.col("doc_id").alias("strataforge_doc"), F.col("text_key").alias("strataforge_text"), SECRETS)
    keyed = docs.withColumn("strataforge_key", F.xxhash64(F.coalesce("text", F.lit(""))))
    joined = keyed.join(found, F.col("doc_id").cast("long").eqNullSafe(F.col("strataforge_doc")) & (F.col("strataforge_key") == F.col("strataforge_text")), "left")
    return joined.select(*docs.columns, F.coalesce(SECRETS, F.expr("cast(array() as array<struct<start:int,place:int,end:int,kind:string,before:int>>)")).alias(SECRETS))


def _listed(of: Column) -> Column:
    return F.concat_ws(",", F.transform(of, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def op6_secret_index(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    secrets = F.col(SECRETS)
    base = F.filter(secrets, lambda s: s["place"] < BASE)
    number = lambda k: F.size(F.filter(secrets, lambda s: s["place"] == k)).cast("long")
    return scan(docs).select("doc_id", number(0).alias("n_assign"), number(1).alias("n_access"), number(2).alias("n_hex"), F.sha2(_listed(base), 256).alias("base_sha256"), _listed(secrets).alias("spans"))


def redact(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: each secret becomes ``[SECRET]``; spans that overlap become one.  ``n_chars`` follows the text."""
    found = scan(docs)
    piece = lambda s: F.when(s["start"] >= s["before"], F.concat(F.col("text").substr(s["before"] + 1, s["start"] - s["before"]), F.lit("[SECRET]"))).otherwise("")
    last = F.array_max(F.transform(SECRETS, lambda s: s["end"]))
    text = F.concat(F.concat_ws("", F.transform(SECRETS, piece)), F.col("text").substr(last + 1, F.length("text")))
    changed = F.size(SECRETS) > 0
    out = found.withColumn("text", F.when(changed, text).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(changed, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(docs.columns)
