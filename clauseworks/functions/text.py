"""Text expressions, all inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that keyword search leaves out, and its token pattern.
STOP_WORDS = ("a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "has", "have", "in", "is", "it", "its", "of", "on", "or", "that", "the", "to", "was", "were", "will")
KEYWORD = r"[A-Za-z0-9]+(?:[.\-][A-Za-z0-9]+)*"


def strip(text: Column) -> Column:
    """Without white space at either end, line feeds included."""
    return F.regexp_replace(text, r"(?U)\A\s+|\s+\z", "")


def is_blank(text: Column) -> Column:
    return ~F.coalesce(text, F.lit("")).rlike(r"(?U)\S")


def keyword_tokens(text: Column, stop_words: tuple[str, ...] = STOP_WORDS) -> Column:
    """Lower-case tokens for keyword search: inner dots and hyphens kept, stop words and single characters dropped."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(KEYWORD), F.lit(0))
    return F.filter(found, lambda x: (F.length(x) > 1) & ~x.isin(*stop_words))


def token_set(text: Column) -> Column:
    """Distinct lower-case runs of letters and digits."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0)))


def jaccard(a: Column, b: Column) -> Column:
    """Shared part of two token sets; 0 where either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(both / (F.size(a) + F.size(b) - both))


def page_list(pages: Column) -> Column:
    """Page numbers as "1, 2"."""
    return F.coalesce(F.array_join(F.transform(pages, lambda p: p.cast("string")), ", "), F.lit(""))


# The wordings of embedded texts, context lines and score lines, which models and stored indexes rely on.
def embed_text(summary: Column, chapter: Column, section: Column, text: Column) -> Column:
    """What is embedded for a whole subsection."""
    part = lambda c: F.coalesce(c, F.lit(""))
    return F.concat(F.lit("Document: "), part(summary), F.lit("\nChapter: "), part(chapter), F.lit("\nSection: "), part(section), F.lit("\n"), part(text))


def embed_piece(context: Column, chapter: Column, section: Column, piece: Column) -> Column:
    """What is embedded for a piece of a split subsection."""
    part = lambda c: F.coalesce(c, F.lit(""))
    return F.concat(F.lit("Context: "), part(context), F.lit("\nChapter: "), part(chapter), F.lit("\nSection: "), part(section), F.lit("\nContent: "), part(piece))


def rerank_text(summary: Column, text: Column) -> Column:
    return strip(F.concat(F.coalesce(summary, F.lit("")), F.lit("\n"), F.coalesce(text, F.lit(""))))


def slug(name: Column, longest: int = 48) -> Column:
    """A table-name part: runs of other characters become underscores; an empty or overlong one is an error."""
    s = F.btrim(F.regexp_replace(F.lower(strip(name)), "[^a-z0-9]+", "_"), F.lit("_"))
    return F.when(F.length(s).between(1, longest), s).otherwise(F.raise_error(F.concat(F.lit("no table name from: "), F.coalesce(name, F.lit("null")))))


def path_safe(name: Column) -> Column:
    return F.replace(name, F.lit("/"), F.lit("_"))


def combo_label(*axes: Column, two_call: Column) -> Column:
    """An experiment's label: its axes and tc0 or tc1."""
    return F.concat_ws("__", *axes, F.when(two_call, "tc1").otherwise("tc0"))


def score_lines(reply: Column, items: int, default: float = 5.0) -> Column:
    """Scores of lines "number: score" in a model's reply, held to 0..10, for items 1 to `items`; the default where a line is missing, the last where there are several."""
    lines = F.split(F.coalesce(reply, F.lit("")), r"\R")
    pattern = r"\A\s*0*(\d+)\s*[:.\-]\s*(\d+(?:\.\d+)?)"

    def one(i: Column) -> Column:
        mine = F.filter(lines, lambda x: F.regexp_extract(x, pattern, 1) == i.cast("string"))
        value = F.regexp_extract(F.get(mine, F.size(mine) - 1), pattern, 2).cast("double")
        return F.when(F.size(mine) > 0, F.least(F.lit(10.0), F.greatest(F.lit(0.0), value))).otherwise(F.lit(default))

    return F.transform(F.sequence(F.lit(1), F.lit(items)), one)


def context_header(i: Column, doc: Column, chapter: Column, section: Column, subsection_id: Column, pages: Column) -> Column:
    """The line above a chunk in a context window; parts that a chunk lacks are left out."""
    part = lambda name, c, skip="": F.when(F.coalesce(c, F.lit("")).isin("", skip), "").otherwise(F.concat(F.lit(f" | {name}: "), c))
    return F.concat(F.format_string("[Chunk %d] Document: %s", i, F.coalesce(doc, F.lit("Unknown"))), part("Chapter", chapter), part("Section", section), part("Subsection", subsection_id, "N/A"), part("Pages", pages))


def gap_header(i: Column, doc: Column, section: Column, subsection_id: Column) -> Column:
    """The line above a chunk where a model is asked what is missing: fixed places, empty ones included."""
    part = lambda c: F.coalesce(c, F.lit(""))
    return F.concat(F.format_string("[%d] ", i), part(doc), F.lit(" | "), part(section), F.lit(" | "), part(subsection_id))


def engine_url(url: Column) -> Column:
    """A connection URL that names the driver."""
    return F.regexp_replace(url, r"\Apostgres(?:ql)?://", "postgresql+psycopg://")


def driver_url(url: Column) -> Column:
    """A connection URL as the driver itself reads it."""
    return F.regexp_replace(url, r"\A(?:postgresql\+psycopg|postgres)://", "postgresql://")


def hyde(query: Column, hypothetical: Column) -> Column:
    return F.concat_ws("\n\n", query, F.nullif(hypothetical, F.lit("")))
