"""Sections, metadata and chunks of documents: one narrow pass over arrays of lines and sentences, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import fixed, text
from quire.sources import documents


def heading_name(line: Column) -> Column:
    """The taxonomy's name of a heading line, else null."""
    s = text.strip(line)
    name = F.lit(None).cast("string")
    for known, pattern in reversed(fixed.HEADINGS):
        name = F.when(s.rlike(f"(?iu){pattern}"), known).otherwise(name)
    return F.when((F.length(s) <= 80) & s.rlike(fixed.HEADING.replace("$", r"\z")), name)


def with_sections(docs: DataFrame, column: str = "clean_text") -> DataFrame:
    """docs with `sections`, an array of struct<ord, name, heading, text, start_line, end_line>, and `preamble`.

    Lines are numbered from 0; end_line is included. A name that came before gets the heading's ordinal behind it.
    """
    lines = F.split(F.col(column), "\n")
    out = docs.withColumn("_lines", lines)
    told = F.transform("_lines", lambda x, i: F.struct(i.alias("at"), heading_name(x).alias("name"), text.strip(x).alias("heading")))
    heads = F.filter(told, lambda h: h["name"].isNotNull())
    out = out.withColumn("_heads", heads)

    def section(h: Column, k: Column) -> Column:
        end = F.coalesce(F.get("_heads", k + 1)["at"], F.size("_lines"))
        before = F.exists(F.slice("_heads", F.lit(1), k), lambda x: x["name"] == h["name"])
        name = F.when(before, F.concat(h["name"], F.lit("_"), k.cast("string"))).otherwise(h["name"])
        body = F.array_join(F.slice("_lines", h["at"] + 2, end - h["at"] - 1), "\n")
        named = [k.cast("int").alias("ord"), name.alias("name"), h["heading"].alias("heading"), text.strip(body).alias("text")]
        return F.struct(*named, h["at"].alias("start_line"), (end - 1).alias("end_line"))

    first = F.coalesce(F.get("_heads", F.lit(0))["at"], F.size("_lines"))
    out = out.withColumns({"sections": F.transform("_heads", section), "preamble": text.strip(F.array_join(F.slice("_lines", F.lit(1), first), "\n"))})
    return out.drop("_lines", "_heads")


def section_text(name: str, most: int | None = None, sections: str = "sections", whole: bool = False) -> Column:
    """Text of the first filled section of that name, else of the first whose name starts with it; aliases in their order. whole: all of it, else its beginning."""
    first = lambda hit: F.get(F.filter(sections, lambda s: hit(s["name"]) & (s["text"] != "")), F.lit(0))["text"]
    found = []
    for alias in fixed.ALIASES.get(name, [name]):
        found += [first(lambda n, a=alias: n == a), first(lambda n, a=alias: n.startswith(a))]
    t = F.coalesce(*found, F.lit(""))
    return t if whole else F.substring(t, 1, most if most is not None else fixed.SECTION_CAPS[name])


def combined(*texts: Column, whole: bool = False) -> Column:
    t = F.concat_ws("\n\n", *[F.when(t != "", t) for t in texts])
    return t if whole else F.substring(t, 1, fixed.COMBINED_CAP)


def abstract_without_headings(t: Column) -> Column:
    """What follows the word Abstract, up to a blank line or a line like a heading; null if there is none."""
    return F.nullif(text.strip(F.regexp_extract(t, f"(?isu){fixed.ABSTRACT_START}(?={fixed.ABSTRACT_END})", 1)), F.lit(""))


def texts_of(names: list[str], sections: str = "sections") -> Column:
    """The filled texts of the sections of these very names, in this order, with an empty line between them."""
    get = lambda n: F.get(F.filter(sections, lambda s: s["name"] == n), F.lit(0))["text"]
    return F.concat_ws("\n\n", *[F.nullif(get(n), F.lit("")) for n in names])


def names_of(sections: str = "sections") -> Column:
    return F.col(sections)["name"]


# -- metadata --


def title(t: Column) -> Column:
    """Of the first three likely lines among the first ten the longest, the earlier one on a tie."""
    lines = F.slice(F.filter(F.transform(F.split(t, "\n"), text.strip), lambda x: x != ""), 1, 10)
    good = lambda x: (F.length(x) >= 10) & (F.length(x) <= 200) & ~x.rlike(fixed.DOI) & ~((x == F.upper(x)) & (x != F.lower(x)))
    some = F.slice(F.filter(lines, good), 1, 3)
    return F.aggregate(some, F.lit(""), lambda best, x: F.when(F.length(x) > F.length(best), x).otherwise(best), lambda x: F.coalesce(F.nullif(x, F.lit("")), F.lit(fixed.NO_TITLE)))


def doi(t: Column) -> Column:
    return F.nullif(F.regexp_replace(F.regexp_extract(F.substring(t, 1, 3000), fixed.DOI, 0), r"[.,)]+\z", ""), F.lit(""))


def year(t: Column) -> Column:
    return F.nullif(F.regexp_extract(F.substring(t, 1, 2000), fixed.YEAR, 0), F.lit(""))


def abstract_paragraph(t: Column) -> Column:
    return F.get(F.filter(F.transform(F.split(F.substring(t, 1, 3000), "\n\n"), text.strip), lambda x: F.length(x) > 200), F.lit(0))


def authors(line: Column) -> Column:
    return F.filter(F.transform(F.split(line, r"(?i)[,;]|\band\b"), text.strip), lambda x: F.length(x) > 2)


def with_embedded(docs: DataFrame) -> DataFrame:
    """docs (clean_text; pdf_title, pdf_author and pdf_subject where a file had them) with title, authors, keywords, doi and year.

    An embedded title of over three characters wins over the likely lines; authors and keywords are embedded or none.
    """
    t, own = F.col("clean_text"), text.strip(F.coalesce("pdf_title", F.lit("")))
    listed = lambda c, cut: F.coalesce(cut(text.strip(F.coalesce(c, F.lit("")))), F.expr("cast(array() as array<string>)"))
    words = lambda c: F.filter(F.transform(F.split(c, ","), text.strip), lambda x: x != "")
    named = F.when(F.length(own) > 3, own).otherwise(title(t))
    return docs.withColumns({"title": named, "authors": listed("pdf_author", authors), "keywords": listed("pdf_subject", words), "doi": doi(t), "year": year(t)})


# -- chunks --


def windows(sentences: Column, size: int = 5, overlap: int = 2) -> Column:
    """Overlapping runs of sentences; the first that reaches the end is the last."""
    step = max(1, size - overlap)
    last = F.greatest(F.lit(0), F.ceil((F.size(sentences) - size) / F.lit(float(step))).cast("int"))
    return F.when(F.size(sentences) == 0, F.expr("cast(array() as array<array<string>>)")).otherwise(F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(sentences, k * step + 1, size)))


def chunks(docs: DataFrame, size: int = 5, overlap: int = 2, column: str = "clean_text", others: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, chunk_id, section_name, text, n_sentences of documents that have `sections`; others: columns of docs that chunks have, too."""
    whole = F.array(F.struct(F.lit("full_document").alias("name"), F.col(column).alias("text")))
    own = F.transform(F.filter("sections", lambda s: (s["text"] != "") & (s["name"] != "references")), lambda s: F.struct(s["name"].alias("name"), s["text"].alias("text")))
    parts = F.when(F.size("sections") == 0, whole).otherwise(own)
    # A column of its own: a section is cut into sentences once, not for each of its windows.
    split = docs.select("doc_id", *others, F.transform(parts, lambda s: F.struct(s["name"].alias("name"), text.sentences(s["text"], 20).alias("all"))).alias("parts"))
    cut = F.transform("parts", lambda s: F.transform(windows(s["all"], size, overlap), lambda w: F.struct(s["name"].alias("section_name"), w.alias("sentences"))))
    # Outer, as a plain generator would have the whole expression evaluated once more to filter out empty arrays.
    rows = split.select("doc_id", *others, F.posexplode_outer(F.flatten(cut)).alias("chunk_id", "c")).where("chunk_id is not null")
    return rows.select("doc_id", "chunk_id", "c.section_name", F.array_join("c.sentences", " ").alias("text"), F.size("c.sentences").alias("n_sentences"), *others)


#: What tells a needle's place: so many whole words; or so many characters, where it has no whole word.
ANCHOR_WORDS, ANCHOR_CHARACTERS, NEEDLE = 3, 8, 60
FEW = 16  # chunks of a document that are held against all of its pages
#: A document is searched in one row up to so many characters of pages, and so many times its number of chunks.
WHOLE, SEARCHED = 1 << 23, 1 << 27


def _parts(t: Column) -> Column:
    return F.split(t, r"\s+")


def _word_anchors(words: Column) -> Column:
    """Hashes of all runs of ANCHOR_WORDS words; words is a column."""
    last = F.size(words) - ANCHOR_WORDS
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(ANCHOR_WORDS)])))


def _character_anchors(t: Column) -> Column:
    """Of each NEEDLE characters in a row the smallest hash of ANCHOR_CHARACTERS: equal stretches have equal ones."""
    inner = NEEDLE - ANCHOR_CHARACTERS + 1
    n = F.length(t) - ANCHOR_CHARACTERS + 1
    hashes = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.xxhash64(F.substring(t, i, F.lit(ANCHOR_CHARACTERS))))
    # A list of one holds the hashes, so that they are made once.
    least = F.get(F.transform(F.array(hashes), lambda h: F.transform(F.sequence(F.lit(1), F.greatest(n - inner + 1, F.lit(1))), lambda i: F.array_min(F.slice(h, i, inner)))), F.lit(0))
    return F.when(F.length(t) >= NEEDLE, least)


def chunk_pages(chunked: DataFrame, pages: DataFrame) -> DataFrame:
    """chunked with page_numbers: pages of the document that hold the chunk's first 60 characters.

    The pages of a document are gathered, and each of its chunks is held against them in its own row: a search of so many
    characters takes less than exchanging their anchors. The documents for which that is too much, by SEARCHED and
    WHOLE, have their chunks and pages met by anchors, which spreads a document over many tasks. Columns of chunked are kept; a
    document without pages has no page numbers.
    """
    needle = text.strip(F.substring("text", 1, NEEDLE))
    # All of them are read several times, so they are written once.
    read = documents.kept(pages.where("page_number is not null").select("doc_id", "page_number", F.col("text").alias("page")), "pages")
    chunked = documents.kept(chunked.withColumn("_needle", needle), "searched")
    sizes = read.groupBy("doc_id").agg(F.sum(F.length("page")).alias("size"))
    asked = chunked.groupBy("doc_id").agg(F.count("*").alias("n"))
    long = documents.kept(sizes.join(asked, "doc_id").where((F.col("size") > WHOLE) | (F.col("size") * F.col("n") > SEARCHED)).select("doc_id"), "long")
    few = long.isEmpty()
    rest, own = (chunked, read) if few else (rows.join(long, "doc_id", "left_anti") for rows in (chunked, read))
    lists = own.groupBy("doc_id").agg(F.collect_list(F.struct("page_number", "page")).alias("_pages"))
    hits = F.filter("_pages", lambda p: p["page"].contains(F.col("_needle")))
    numbers = F.when(F.col("_needle") != "", F.array_sort(F.transform(hits, lambda p: p["page_number"])))
    out = rest.join(lists, "doc_id", "left").withColumn("page_numbers", numbers).drop("_pages")
    if not few:
        some, theirs = (rows.join(long, "doc_id", "left_semi") for rows in (chunked, read))
        out = out.unionByName(some.join(_pages_by_anchor(some, theirs), ["doc_id", "_needle"], "left"))
    return out.drop("_needle").withColumn("page_numbers", F.coalesce("page_numbers", F.expr("cast(array() as array<int>)")))


def _pages_by_anchor(chunked: DataFrame, read: DataFrame) -> DataFrame:
    """doc_id, _needle, page_numbers of chunks (doc_id, _needle) and pages (doc_id, page_number, page).

    A chunk meets the pages that share an anchor with it, by document and anchor, and only those are searched for it; so
    the work of a document grows with its length, and a long one is spread over many tasks. All but the first and last
    word of those characters are whole words of the page as well: the anchor is a run of three of them, else the longest
    one. Where there is none, as in a script without spaces, it is the smallest hash of eight characters in a row, which
    the page's stretch of 60 characters shares. Shorter texts of one or two words, one for a section at most, and the
    chunks of a document that asks for at most FEW, meet all pages of their document.
    """
    asked = chunked.select("doc_id", F.col("_needle").alias("needle")).where("needle <> ''").distinct().withColumn("_w", _parts(F.col("needle")))
    asked = asked.withColumn("_w", F.when(F.size("_w") > 2, F.slice("_w", F.lit(2), F.size("_w") - 2)))
    longest = F.get(F.array_sort(F.transform("_w", lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w")))), F.lit(0))["w"]
    few = F.count("*").over(Window.partitionBy("doc_id")) <= FEW
    asked = asked.withColumn("_few", few)
    kind = F.when(F.col("_few"), 0).when(F.size("_w") >= ANCHOR_WORDS, 3).when(F.col("_w").isNotNull(), 1).when(F.length("needle") == NEEDLE, 8).otherwise(0)
    anchor = F.when(F.col("kind") == 3, F.get(_word_anchors(F.col("_w")), F.lit(0))).when(F.col("kind") == 1, F.xxhash64(longest)).when(F.col("kind") == 8, F.get(_character_anchors(F.col("needle")), F.lit(0))).otherwise(0)
    # Read twice, so written once.
    asked = documents.kept(asked.withColumn("kind", kind).select("doc_id", "needle", "kind", anchor.alias("anchor")), "needles")
    kinds = asked.groupBy("doc_id").agg(F.collect_set("kind").alias("kinds"))
    own = read.join(kinds, "doc_id").withColumn("_w", _parts(F.col("page")))
    none = F.expr("cast(array() as array<bigint>)")
    of = lambda k, anchors: F.when(F.array_contains("kinds", k), F.transform(F.array_distinct(F.coalesce(anchors, none)), lambda h: F.struct(F.lit(k).alias("kind"), h.alias("anchor")))).otherwise(F.expr("cast(array() as array<struct<kind: int, anchor: bigint>>)"))
    found = F.concat(of(3, _word_anchors(F.col("_w"))), of(1, F.transform("_w", lambda w: F.xxhash64(w))), of(8, _character_anchors(F.col("page"))), of(0, F.array(F.lit(0).cast("long"))))
    places = own.select("doc_id", "page_number", F.explode_outer(found).alias("a")).where("a is not null").select("doc_id", "page_number", "a.kind", "a.anchor")
    met = asked.join(places, ["doc_id", "kind", "anchor"]).select("doc_id", "page_number", "needle").distinct()
    hits = met.join(read, ["doc_id", "page_number"]).where(F.col("page").contains(F.col("needle")))
    return hits.groupBy("doc_id", F.col("needle").alias("_needle")).agg(F.array_sort(F.collect_list("page_number")).alias("page_numbers"))
