"""Splitting oversized texts at natural boundaries with one bounded-quantifier regular expression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Boundary levels from the strongest to the weakest; a piece's level is the cut at its end.
LEVELS = ("paragraph", "line", "sentence", "space", "none")


def piece_pattern(limit: int, overlap: int) -> str:
    """Alternatives ordered by boundary strength; each consumes as much as it may.

    At every strength the run that leaves room for the whole overlap is tried first, then the run of the full
    limit. Separators before and after the run don't count towards it. The last alternative takes characters.
    """
    if not 0 <= overlap < limit:
        raise ValueError("0 <= overlap < limit")
    runs = [f".{{1,{n}}}" for n in dict.fromkeys((limit - overlap, limit))]
    paragraph = [f"(?:\\n{{2,}}+)?{r}(?:\\z|\\n{{2,}}+)" for r in runs]
    line = [f"\\n*+{r}(?:\\z|\\n)" for r in runs]
    sentence = [f"\\n*+{r}(?<=[.!?।])\\s" for r in runs]
    space = [f"\\s*+{r}(?:\\z|\\s)" for r in runs]
    return "(?sU)" + "|".join([*paragraph, *line, *sentence, *space, runs[0]])


def _spans(text: Column, limit: int, overlap: int) -> Column:
    """Contiguous slices that together are the text; one slice where the text is short enough."""
    cut = F.regexp_extract_all(text, F.lit(piece_pattern(limit, overlap)), F.lit(0))
    return F.when(F.length(text) <= limit, F.array(text)).otherwise(cut)


def _cut_level(span: Column, is_last: Column) -> Column:
    """Rank in LEVELS of the cut after a slice; 0 after the last one, where nothing is cut."""
    return (
        F.when(is_last | span.rlike("\\n\\n\\z"), 0)
        .when(span.rlike("\\n\\z"), 1)
        .when(span.rlike("(?U)[.!?।]\\s\\z"), 2)
        .when(span.rlike("(?U)\\s\\z"), 3)
        .otherwise(4)
    )


def boundary_levels(df: DataFrame, id_col: str, text_col: str, limit: int = 2048, overlap: int = 204) -> DataFrame:
    """(id, boundary) of each text above the limit: the weakest cut that the splitter had to use.

    The splitter takes a stronger boundary wherever one is within the limit, so the weakest cut used is the first
    level at which every stretch fits. One row per id and level; a record delivered again counts once. Null and
    short texts give no row.
    """
    text = F.col(text_col)
    spans = df.select(F.col(id_col).alias("_id"), text.alias("_t")).where(F.length("_t") > limit)
    spans = spans.select("_id", _spans(F.col("_t"), limit, overlap).alias("_s"))
    last = F.size("_s") - 1
    worst = F.array_max(F.transform("_s", lambda s, i: _cut_level(s, i == last)))
    names = F.array(*map(F.lit, LEVELS))
    return spans.select(F.col("_id").alias(id_col), F.element_at(names, worst + 1).alias("boundary")).distinct()


def split_pieces(df: DataFrame, id_col: str, text_col: str, limit: int = 2048, overlap: int = 204) -> DataFrame:
    """Ordered pieces of at most `limit` characters: (id, piece_no, total_pieces, start_at, overlap_chars, boundary, piece).

    `start_at` is the offset of the piece's own text, which follows the `overlap_chars` characters repeated from the
    piece before; the repeated part begins at a blank where there is one. Dropping the overlaps gives the text again,
    apart from separators at the cuts. Texts within the limit give one piece, null and empty texts none; equal
    (id, text) rows count once.
    """
    rows = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t")).where(F.length("_t") > 0).distinct()
    spans = rows.select("_id", "_t", _spans(F.col("_t"), limit, overlap).alias("_s"))
    starts = "transform(_s, (s, i) -> int(aggregate(slice(_s, 1, i), 0, (n, x) -> n + length(x))))"
    spans = spans.select("_id", "_t", "_s", F.expr(starts).alias("_at"))
    zipped = F.transform("_s", lambda x, i: F.struct(x.alias("_s"), i.alias("no"), F.get("_at", i).alias("_at"), F.when(i > 0, F.get("_at", i - 1)).otherwise(0).alias("before")))
    each = spans.select("_id", "_t", F.size("_s").alias("_n"), F.inline(zipped))
    many = F.length("_t") > limit
    head = F.when(many, F.length(F.regexp_extract("_s", "(?U)\\A\\s*", 0))).otherwise(0)
    each = each.withColumns({"_lead": head, "_own": F.when(many, F.regexp_replace("_s", "(?U)\\A\\s+|\\s+\\z", "")).otherwise(F.col("_s"))})
    each = each.withColumn("_own", F.when(F.length("_own") == 0, F.substring("_s", 1, limit)).otherwise(F.col("_own")))
    each = each.withColumn("start_at", F.col("_at") + F.when(F.col("_own") == F.substring("_s", 1, limit), 0).otherwise(F.col("_lead")))
    room = F.least(F.lit(overlap), F.lit(limit) - F.length("_own"), F.col("start_at") - F.col("before"))
    back = F.when(F.col("no") == 0, 0).otherwise(F.greatest(room, F.lit(0)))
    each = each.withColumn("_back", F.substring(F.col("_t"), F.col("start_at") - back + 1, back))
    each = each.withColumn("_back", F.when(F.col("_back").rlike("(?sU)\\s\\S"), F.regexp_replace("_back", "(?sU)\\A\\S*\\s+", "")).otherwise(F.col("_back")))
    return each.select(
        F.col("_id").alias(id_col),
        F.col("no").alias("piece_no"),
        F.col("_n").alias("total_pieces"),
        "start_at",
        F.length("_back").alias("overlap_chars"),
        F.element_at(F.array(*map(F.lit, LEVELS)), _cut_level(F.col("_s"), F.col("no") == F.col("_n") - 1) + 1).alias("boundary"),
        F.concat("_back", "_own").alias("piece"),
    )
