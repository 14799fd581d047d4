"""From documents to prepared papers, and from those to one wide row of analysis for each."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import fixed, text
from quire.operators import cues, ranking, sections
from quire.sources import documents


def prepared(papers: DataFrame, normalise: bool = True) -> DataFrame:
    """papers (doc_id, full_text) with clean_text, sections and preamble; a paper without headings gets an abstract section if it has one."""
    return sectioned(text.with_clean_text(papers, normalise=normalise))


def sectioned(docs: DataFrame) -> DataFrame:
    """docs (clean_text) with sections and preamble, as `prepared` gives them."""
    out = sections.with_sections(docs)
    found = sections.abstract_without_headings(F.col("clean_text"))
    named = [F.lit(0).alias("ord"), F.lit("abstract").alias("name"), F.lit("Abstract").alias("heading"), F.coalesce(found, F.lit("")).alias("text")]
    alone = F.array(F.struct(*named, F.lit(0).alias("start_line"), F.lit(10).alias("end_line")))
    kind = out.schema["sections"].dataType
    return out.withColumn("sections", F.when((F.size("sections") == 0) & found.isNotNull(), alone.cast(kind)).otherwise(F.col("sections")))


def with_slots(docs: DataFrame, whole: bool = False) -> DataFrame:
    """docs with a column for the text of each kind of section, `combined` and `start`: their beginnings, or all of them if whole."""
    out = docs.withColumns({f"s_{name}": sections.section_text(name, whole=whole) for name in fixed.SECTION_CAPS})
    out = out.withColumn("start", F.col("clean_text") if whole else F.substring("clean_text", 1, 2000))
    order = ("abstract", "introduction", "methodology", "results", "discussion", "conclusion")
    return out.withColumn("combined", sections.combined(*[F.col(f"s_{name}") for name in order], whole=whole))


def _or(*names: str) -> Column:
    return text.first_filled(*[F.col(n) for n in names])


def stated() -> list[Column]:
    """What the cue phrases find in a row of slots, before any fallback on ranked sentences."""
    return [
        cues.objective(_or("s_abstract", "s_introduction", "start")).alias("objective"),
        cues.methodology(_or("s_methodology", "combined")).alias("methodology"),
        cues.findings(_or("s_results", "s_experiments", "s_conclusion", "combined")).alias("findings"),
        cues.contribution(_or("s_abstract", "s_introduction", "s_conclusion", "combined")).alias("contribution"),
        cues.limitations(_or("s_discussion", "s_conclusion", "combined")).alias("limitations"),
        cues.datasets(text.first_filled(F.col("s_methodology"), F.col("s_experiments"), F.substring("clean_text", 1, 5000))).alias("datasets"),
    ]


def statements(slots: DataFrame) -> DataFrame:
    """doc_id and what the cue phrases find, before any fallback on ranked sentences."""
    return slots.select("doc_id", *stated())


#: Sections whose best sentences are main points.
_POINTS = ("abstract", "conclusion", "results", "methodology")
#: Ranked texts: slot, its texts in order of preference, sentences that are kept.
_RANKED = [
    ("objective", ["s_abstract", "s_introduction", "start"], 2),
    ("methodology", ["s_methodology", "combined"], 3),
    ("findings", ["s_results", "s_experiments", "s_conclusion", "combined"], 5),
    ("contribution", ["s_abstract", "s_introduction", "s_conclusion", "combined"], 2),
    ("summary", ["combined"], 6),
    ("conclusion", ["s_conclusion"], 3),
    ("abstract", ["s_abstract"], 2),
    ("main", ["combined"], 8),
    *[(f"point_{k}", [f"s_{name}"], 3) for k, name in enumerate(_POINTS)],
]


_MAP = "map<string, array<string>>"


def _with_best(rows: DataFrame, asked: Column, name: str) -> DataFrame:
    """rows with a map from slot to its best sentences, in order of the text; asked: array<struct<slot, t, most>>. A text that several slots ask for is ranked once."""
    text.small_batches(rows.sparkSession)
    out = rows.withColumn("_asked", F.filter(asked, lambda e: e["t"] != ""))
    out = out.withColumn("_t", F.array_distinct(F.transform("_asked", lambda e: e["t"])))
    out = out.withColumn("_b", ranking.best_sentences(F.col("_t")))

    # What Python gives is read outside of any lambda, in which Spark can't evaluate it.
    ranked = F.arrays_zip(F.col("_t").alias("t"), F.col("_b").alias("b"))
    best = lambda z, e: F.array_sort(F.slice(z["b"], F.lit(1), e["most"]))["sent"]
    each = F.transform(ranked, lambda z: F.transform(F.filter("_asked", lambda e: e["t"] == z["t"]), lambda e: F.struct(e["slot"].alias("key"), best(z, e).alias("value"))))
    entries = F.filter(F.flatten(each), lambda e: F.size(e["value"]) > 0)
    return out.withColumn(name, F.map_from_entries(entries).cast(_MAP)).drop("_asked", "_t", "_b")


def _asked(where: dict[str, Column | bool]) -> Column:
    """The texts of these slots, the empty text where a row doesn't need one."""
    text_of = lambda name, texts: _or(*texts) if where[name] is True else F.when(where[name], _or(*texts)).otherwise("")
    return F.array(*[F.struct(F.lit(name).alias("slot"), text_of(name, texts).alias("t"), F.lit(most).alias("most")) for name, texts, most in _RANKED if name in where])


def with_ranked(slots: DataFrame, where: dict[str, Column | bool] | None = None) -> DataFrame:
    """slots with `ranked`, a map from each slot whose text has a sentence to its best ones. A row is ranked by itself, nothing is exchanged.

    where: the slots that are asked for, and the rows that need them; all by default.
    """
    return _with_best(slots, _asked(dict.fromkeys([name for name, *_ in _RANKED], True) if where is None else where), "ranked")


def _without_sentence(*names: str) -> Column:
    return functools.reduce(Column.__and__, [F.size(text.sentences(F.col(f"s_{n}"))) == 0 for n in names])


def for_points() -> dict[str, Column | bool]:
    """The slots of which points_of takes main points: that of all sections only where the main ones have no sentence."""
    return {f"point_{k}": True for k in range(len(_POINTS))} | {"main": _without_sentence(*_POINTS)}


def ranked_slots(slots: DataFrame) -> DataFrame:
    """doc_id, slot, sents: the best sentences of every slot."""
    return with_ranked(slots).select("doc_id", F.explode_outer("ranked").alias("slot", "sents")).where("slot is not null")


_NONE = "cast(array() as array<string>)"


def points_of(ranked: str = "ranked") -> Column:
    """The best sentences of the main sections, else of all; one for each beginning of 50 characters, at most eight."""
    none = F.expr(_NONE)
    some = F.concat(*[F.coalesce(F.try_element_at(ranked, F.lit(f"point_{k}")), none) for k in range(4)])
    chosen = F.when(F.size(some) > 0, some).otherwise(F.coalesce(F.try_element_at(ranked, F.lit("main")), none))
    one = F.aggregate(chosen, none, lambda done, s: F.when(F.exists(done, lambda d: F.substring(d, 1, 50) == F.substring(s, 1, 50)), done).otherwise(F.array_append(done, s)))
    return F.slice(one, 1, 8)


def main_points(ranked: DataFrame) -> DataFrame:
    """doc_id, main_points of rows with `ranked`; those without a sentence are left out."""
    # Exploded, as a condition on a plain column would be pushed down with the whole expression written out again.
    return ranked.select("doc_id", F.explode_outer(F.array(points_of())).alias("main_points")).where(F.size("main_points") > 0)


def with_insights(rows: DataFrame, whole: bool = False) -> DataFrame:
    """rows (with contribution, findings, methodology, summary) with key_insight, simple_explanation and why_it_matters; whole: from all of summary and methodology."""
    start = F.concat("summary", F.lit(" "), "methodology")
    start = start if whole else F.substring(start, 1, 1000)
    texts = F.array(*[
        F.struct(F.lit(slot).alias("slot"), t.alias("t"), F.lit(most).alias("most"))
        for slot, t, most in (("one", F.col("summary"), 1), ("two", start, 2))
    ])
    out = _with_best(rows, texts, "_told")
    told = lambda slot: F.array_join(F.try_element_at("_told", F.lit(slot)), " ")
    out = out.withColumns({"one": told("one"), "two": told("two")})
    insight = F.when(F.length("contribution") > 50, F.col("contribution")).otherwise(F.coalesce(F.get("findings", F.lit(0)), F.col("one"), F.col("summary") if whole else F.substring("summary", 1, 200)))
    out = out.withColumn("key_insight", insight)
    out = out.withColumn("simple_explanation", F.coalesce("two", "key_insight"))
    why = F.when(F.size("findings") > 0, F.array_join(F.slice("findings", 1, 2), " ")).otherwise(F.col("simple_explanation"))
    return out.withColumn("why_it_matters", why).drop("one", "two", "_told")


def analyse(papers: DataFrame, normalise: bool = True, whole: bool = False, points: bool = True) -> DataFrame:
    """One row for each row of papers: metadata, statements with their fallbacks, summaries, keywords, domain and directions.

    Each row is analysed by itself, so rows that share a doc_id, or have none, stay apart. A null text counts as empty.
    whole: sections count with their whole texts, else with their beginnings. points: with main_points, which has more texts ranked. Columns other than doc_id and full_text are not read. What is prepared and ranked is written once and read back; nothing is exchanged.
    """
    docs = documents.kept(with_slots(prepared(papers.select("doc_id", "full_text"), normalise), whole).drop("full_text", "preamble"), "slots")
    t = F.col("clean_text")
    out = docs.select("*", sections.title(t).alias("title"), sections.year(t).alias("year"), sections.doi(t).alias("doi"), F.size("sections").alias("n_sections"), *stated()).drop("sections")
    where = {n: F.col(n) == "" for n in ("objective", "methodology", "contribution")} | {"findings": F.size("findings") == 0, "summary": True, "conclusion": True, "abstract": _without_sentence("conclusion")}
    out = cues.with_keywords(with_ranked(out, where | (for_points() if points else {}))).drop("clean_text", "start")
    none = F.expr(_NONE)
    told = lambda name: F.coalesce(F.array_join(F.try_element_at("ranked", F.lit(name)), " "), F.lit(""))
    out = out.withColumns({n: F.when(F.col(n) != "", F.col(n)).otherwise(told(n)) for n in ("objective", "methodology", "contribution")})
    out = out.withColumns({
        "findings": F.when(F.size("findings") > 0, F.col("findings")).otherwise(F.coalesce(F.try_element_at("ranked", F.lit("findings")), none)),
        "keywords": F.col("keywords")["term"],
        "main_points": points_of(),
        "summary": F.coalesce(F.array_join(F.try_element_at("ranked", F.lit("summary")), " "), F.lit(fixed.NO_SUMMARY)),
        "conclusion": text.first_filled(told("conclusion"), told("abstract")),
    }).drop("ranked")
    out = with_insights(documents.kept(out.drop("combined", *[f"s_{n}" for n in fixed.SECTION_CAPS if n not in ("conclusion", "discussion")]), "ranked"), whole)
    out = cues.domain_of(out, "keywords", "title")
    out = cues.with_directions(out, F.concat("s_conclusion", F.lit("\n"), "s_discussion"), "limitations", "keywords")
    kept = ("objective", "methodology", "findings", "contribution", "limitations", "datasets", "main_points", "summary", "conclusion")
    derived = ("key_insight", "simple_explanation", "why_it_matters", "keywords", "domain", "directions")
    return out.select("doc_id", "title", "year", "doi", "n_sections", *kept, *derived)
