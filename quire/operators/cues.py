"""Statements found by cue phrases, keywords, domain and directions for future work: Column expressions over one document."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.functions import fixed, text
from quire.operators import ranking


def first_match(t: Column, patterns: list[str], group: int) -> Column:
    """The first pattern that is found counts; empty if none is."""
    return F.coalesce(*[F.nullif(text.strip(F.regexp_extract(t, f"(?iu){p}", group)), F.lit("")) for p in patterns], F.lit(""))


def all_matches(t: Column, patterns: list[str], longer_than: int, most: int, group: int = 0, any_case: bool = True) -> Column:
    """Distinct matches, pattern by pattern, each in order of the text."""
    found = F.concat(*[F.regexp_extract_all(t, F.lit(f"(?iu){p}" if any_case else p), F.lit(group)) for p in patterns])
    return F.slice(F.array_distinct(F.filter(F.transform(found, text.strip), lambda x: F.length(x) > longer_than)), 1, most)


def objective(t: Column) -> Column:
    return first_match(t, fixed.OBJECTIVE, 1)


def methodology(t: Column) -> Column:
    return first_match(t, fixed.METHOD, 0)


def contribution(t: Column) -> Column:
    return first_match(t, fixed.CONTRIBUTION, 0)


def findings(t: Column) -> Column:
    return all_matches(t, fixed.FINDING, 40, 6)


def limitations(t: Column) -> Column:
    return all_matches(t, fixed.LIMITATION, 30, 5)


def datasets(t: Column) -> Column:
    return F.array_join(all_matches(t, fixed.DATASET, 3, 5, group=1, any_case=False), ", ")


def _term_sums(most: int, vocabulary: int):
    @F.arrow_udf(T.ArrayType(T.StructType([T.StructField("term", T.StringType()), T.StructField("score", T.DoubleType())])))
    def best(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        def sums(t: str | None) -> list[tuple[str, float]]:
            own = ranking.term_weights([*map(text.plain_terms, text.sentence_list(t or ""))], vocabulary)
            if not len(own.codes):
                return []
            found = np.bincount(own.term, own.w)
            # A few more than are asked for, as those that only rounding tells apart are ordered by their names.
            some = np.flatnonzero(found >= (np.partition(found, -most)[-most] - 1e-8 if len(found) > most else 0)).tolist()
            return sorted(zip((round(x, 9) for x in found[some].tolist()), own.names(some), strict=True), reverse=True)[:most]

        for part in parts:
            yield pa.array([[{"term": t, "score": x} for x, t in sums(start)] for (start,) in text.some_rows(part)], pa.list_(pa.struct([("term", pa.string()), ("score", pa.float64())])))

    return best


def with_keywords(docs: DataFrame, column: str = "clean_text", most: int = 15, name: str = "keywords") -> DataFrame:
    """docs with an array of struct<term, score>: the terms of the first 5,000 characters with the largest sums of TF-IDF weights, ties to the later term."""
    text.small_batches(docs.sparkSession)
    return docs.withColumn(name, _term_sums(most, 200)(F.substring(column, 1, 5000)))


def keywords(docs: DataFrame, column: str = "clean_text", most: int = 15, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keys, rank, term, score of each row of docs, as with_keywords finds them."""
    rows = with_keywords(docs.select(*keys, column), column, most, "_k").select(*keys, F.posexplode_outer("_k").alias("_at", "_k")).where("_at is not null")
    return rows.select(*keys, (F.col("_at") + 1).alias("rank"), "_k.term", "_k.score")


def domain_of(docs: DataFrame, words: str, heading: str) -> DataFrame:
    """docs with `domain`, of which most cue words are part of the keywords and the title; the earlier one on a tie."""
    t = F.concat(F.lower(F.array_join(words, " ")), F.lit(" "), F.lower(heading))
    out = docs.withColumn("_t", t)
    found = lambda cues: F.size(F.filter(F.array(*map(F.lit, cues)), lambda c: F.contains(F.col("_t"), c)))
    counts = F.array(*[
        F.struct(found(cues).alias("score"), F.lit(-k).alias("order"), F.lit(name).alias("name"))
        for k, (name, cues) in enumerate(fixed.DOMAINS)
    ])
    best = F.array_max(counts)
    return out.withColumn("_best", best).withColumn("domain", F.when(F.col("_best.score") > 0, F.col("_best.name")).otherwise(fixed.NO_DOMAIN)).drop("_t", "_best")


# -- future work --

DIRECTIONS = "array<struct<topic: string, question: string, reason: string, evidence: string, is_inferred: boolean>>"


def _direction(topic: Column, question: Column, reason: str, evidence: Column, inferred: bool) -> Column:
    return F.struct(topic.alias("topic"), question.alias("question"), F.lit(reason).alias("reason"), evidence.alias("evidence"), F.lit(inferred).alias("is_inferred"))


def topic_of(evidence: Column, words: Column) -> Column:
    known = F.get(F.filter(F.slice(words, 1, 5), lambda k: F.contains(F.lower(evidence), F.lower(k))), F.lit(0))
    start = F.regexp_replace(F.array_join(F.slice(F.split(evidence, r"\s+"), 1, 8), " "), r"[.,;:]+\z", "")
    return F.coalesce(F.concat(F.lit(fixed.EXTENDING[0]), known, F.lit(fixed.EXTENDING[1])), start)


def question_of(evidence: Column) -> Column:
    q = F.regexp_replace(evidence, f"(?iu){fixed.FUTURE_START}", fixed.ASKED)
    q = F.regexp_replace(q, f"(?iu){fixed.ACTOR_START}", fixed.ASKED)
    return F.substring(F.when(F.endswith(q, F.lit("?")), q).otherwise(F.concat(F.regexp_replace(q, r"\.+\z", ""), F.lit("?"))), 1, 250)


def _is_new(found: Column, evidence: Column) -> Column:
    mark = lambda x: F.lower(F.substring(x, 1, 60))
    return ~F.exists(found, lambda d: mark(d["evidence"]) == mark(evidence))


def explicit_directions(t: Column, words: Column) -> Column:
    """Statements of future work. Once there are five, every further pattern can add one more, as only its own search ends."""
    found = F.expr(f"cast(array() as {DIRECTIONS})")
    for pattern in fixed.FUTURE:
        hits = F.filter(F.transform(F.regexp_extract_all(t, F.lit(f"(?iu){pattern}"), F.lit(0)), text.strip), lambda x: F.length(x) >= 30)
        state = F.struct(found.alias("found"), F.lit(False).alias("over"))

        def add(s: Column, hit: Column) -> Column:
            more = F.array_append(s["found"], _direction(topic_of(hit, words), question_of(hit), fixed.EXPLICIT_REASON, F.substring(hit, 1, 300), False))
            after = F.when(_is_new(s["found"], hit), more).otherwise(s["found"]).cast(DIRECTIONS)
            return F.when(s["over"], s).otherwise(F.struct(after.alias("found"), (F.size(after) >= 5).alias("over")))

        found = F.aggregate(hits, state, add, lambda s: s["found"])
    return found


def with_limitations(found: Column, limits: Column) -> Column:
    """Limitations as directions, until there are five."""
    cut = lambda x, n: F.regexp_replace(F.substring(x, 1, n), r"[.,]+\z", "")

    def add(s: Column, x: Column) -> Column:
        asked = F.concat(F.lit(fixed.OVERCOME[0]), cut(x, 120), F.lit(fixed.OVERCOME[1]))
        new = _direction(F.concat(F.lit(fixed.ADDRESSING), cut(x, 60)), asked, fixed.LIMITATION_REASON, F.substring(x, 1, 300), False)
        return F.when((F.size(s) < 5) & (F.length(x) >= 30) & _is_new(s, x), F.array_append(s, new).cast(DIRECTIONS)).otherwise(s)

    return F.aggregate(limits, found, add)


def with_inferred(found: Column, words: Column) -> Column:
    """Fewer than three are filled up from templates; at most six stay."""
    some = lambda n: F.array_join(F.slice(words, 1, n), ", ")
    # The templates.
    templates = F.array(
        _direction(F.lit("Scalability and efficiency"), F.concat(F.lit("Can the proposed approach scale to larger datasets or more domains ("), some(2), F.lit(")?")), "Scalability is a common challenge in research; extending the work to larger or more diverse settings is valuable.", F.concat(F.lit("Inferred from research domain keywords: "), some(4)), True),
        _direction(F.lit("Cross-domain generalization"), F.concat(F.lit("How well does the method generalize beyond its tested domain, particularly for "), F.coalesce(F.get(words, F.lit(0)), F.lit("the studied problem")), F.lit("?")), "Generalization across domains is a key open challenge in most ML research.", F.lit("Inferred from the scope of evaluation described in findings."), True),
        _direction(F.lit("Robustness and fairness evaluation"), F.lit("Are there biases or robustness issues in the proposed approach that could affect real-world deployment?"), "Responsible AI research requires evaluation of fairness, bias, and adversarial robustness.", F.lit("Inferred: no explicit fairness/robustness analysis was identified in the paper."), True),
    ).cast(DIRECTIONS)
    need = F.greatest(F.lit(0), F.lit(3) - F.size(found))
    return F.slice(F.concat(found, F.slice(templates, F.lit(1), need)), 1, 6)


def with_directions(docs: DataFrame, search: Column, limits: str, words: str) -> DataFrame:
    """docs with `directions`; each pass is a column of its own, so no expression is written out twice."""
    out = docs.withColumn("_explicit", explicit_directions(search, F.col(words))).withColumn("_limited", with_limitations(F.col("_explicit"), F.col(limits)))
    return out.withColumn("directions", with_inferred(F.col("_limited"), F.col(words))).drop("_explicit", "_limited")
