"""Defective question-answer pairs: empty, truncated, refusal, copied question, other language."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clauseworks.operators.materialize import written

# What counts as a placeholder, as a refusal, as a courtesy that tells nothing, and as a word of a language.
PLACEHOLDERS = ("n/a", "na", "none", "null", "nil", "nan", "tbd", "tba", "todo", "undefined", "unknown", "blank", "no answer", "empty", "answer", "a", "ans", "response", "reply", "placeholder", "-", "উত্তর")
LEADS = r"(?i)\A[\s\"'“”*_>#]*(?:(?:answer|ans|a|response|reply|note|you asked|your question was|your question|question|q|the question is|the question was|you want to know|hmm|hello|hi|well|ok|okay|dear \w+|উত্তর|প্রশ্ন|আপনার প্রশ্ন)\s*[:.,]\s*)+"
TAIL_NOTES = r"(?is)(?:\s*\[\d+(?:\s*,\s*\d+)*\]|\s*\(see [^()\n]*(?:\([^()\n]*\)[^()\n]*)*\)|\s*\n\s*(?:sources?|references?|সূত্র)\s*:[^\n]*)+\s*\z"
FIRST_PERSON = r"(?:\bI\b|\bI'm\b|\bme\b|\bmy\b|\bwe\b|\bour\b)"
REFUSALS = (
    r"(?i)\bI\b[^.]*\b(?:cannot|can't|can not|could not|couldn't|am unable|'m unable|won't|will not|would rather not|must (?:leave|pass|decline)|have to (?:decline|pass)|do not know|don't know|have no (?:information|idea|answer)|have nothing|decline|can only talk|am not (?:able|allowed|permitted|in a position|qualified)|'m not (?:able|allowed|permitted|sure|qualified)|prefer not)\b",
    r"(?i)\bunable to (?:comply|answer|help|respond|assist|provide|comment)\b",
    r"(?i)\bno (?:answer|response|reply|comment)\b[^.]*\b(?:can|is|could|will|possible|offered|given)\b",
    r"(?i)\b(?:outside|beyond)\b[^.]*\b(?:I may|I can|my (?:role|scope|remit|knowledge|competence)|the scope)\b",
    r"(?i)\b(?:request|question)\b[^.]*\b(?:be|is|was) (?:declined|refused|left open|left unanswered)\b",
    r"(?i)\A\W*(?:[^.:]{0,40}[:,] )?(?:insufficient|not enough|no (?:relevant|sufficient|further)?)\s*(?:context|information|detail|data|material|evidence)\b",
    r"(?i)\bthere is (?:not enough|no|insufficient) (?:information|context|material|detail)\b",
    r"(?i)\b(?:the )?context (?:lacks|does not|doesn't)\b",
    r"(?i)\bnothing (?:retrieved|found|in the (?:documents|sources|context|material))\b",
    r"(?i)\b(?:sources?|documents?|sections?|material|passages?|excerpts?)\b[^.]*\b(?:silent|do not (?:mention|cover|say|address|contain)|does not (?:mention|cover|say|address|contain)|don't (?:mention|cover|contain))\b",
    r"(?i)\banswering (?:this |that )?would (?:need|require)\b",
    r"(?i)\bmy (?:instructions|guidelines|role|training)\b[^.]*\bnot\b",
    r"(?i)\b(?:that|this|the) information is (?:not|un)\s?available\b",
    r"(?i)\b(?:improper|inappropriate|not (?:possible|appropriate|proper|permitted)) for me\b",
    r"(?i)\bwe (?:do not|don't|cannot|can't) (?:provide|answer|give|offer|comment)\b",
    r"(?i)\b(?:legal opinions?|legal advice)\b[^.]*\bbeyond\b",
    r"(?i)\bno (?:clause|section|provision|passage|text|rule|document|mention|reference|record|figure|match\w*)\b[^.]*\b(?:found|located|retrieved|available|identified)\b",
    r"(?i)\bthis (?:assistant|system|bot|tool|service|model)\b[^.]*\b(?:not|cannot|unable)\b",
    r"(?i)\b(?:passages?|sections?|documents?|sources?|results?|excerpts?)\b[^.]*\b(?:unrelated|irrelevant|not related)\b",
    r"(?i)\bI have no (?:access|means|way|record|data)\b|\bas an? (?:AI |language )+(?:model|assistant)\b",
    r"আমার জানা নেই|জানা নেই আমার|আমার পক্ষে সম্ভব ন[^ ]+|(?:উত্তর|জবাব|মতামত|পরামর্শ)[^।]*(?:দেওয়া|দেওয়া) সম্ভব ন|আমার কাজের বাইরে|(?:বলতে|দিতে|করতে|জানাতে) পার(?:ছি|ি|লাম|ব) না|আমি অপারগ|কিছু (?:পাওয়া|পাওয়া) (?:যায়নি|যায়নি)|কোনো উল্লেখ নেই|যথেষ্ট তথ্য (?:না|নেই)|এখতিয়ারের বাইরে",
)
COURTESIES = r"(?i)\A\W*(?:please|kindly|try rephrasing|you may (?:want|wish)|you (?:could|should) (?:ask|contact|speak)|i hope|thanks?|thank you|sorry|apologies|i apologi[sz]e|hello|hi|hmm|dear|note|is there (?:something|anything)|unfortunately|regrettably|let me know|feel free|contact|after checking|at this time|দুঃখিত|ক্ষমা করবেন|অনুগ্রহ|ধন্যবাদ)\b[^0-9০-৯]*\z"
ENGLISH = ("the", "of", "to", "is", "and", "a", "an", "in", "for", "by", "on", "with", "from", "that", "it", "be", "not", "or", "as", "at", "may", "must", "shall", "are", "has", "have", "which", "within", "under", "no", "than", "if", "where", "when", "every", "years", "months", "days", "does", "so", "yes", "unless", "other", "any", "its", "per", "after", "before")
ROMANISED = (
    "er", "ei", "oi", "ta", "eta", "ota", "sheta", "jeta", "ekta", "ekti", "o", "ar", "ba", "ebong", "kintu", "tobe", "jodi", "jodio", "tahole", "karon", "tai", "tarpor", "ami", "amar", "amra", "amader", "apni", "apnar", "apnake", "tumi", "tomar", "se", "tar", "tara", "tader",
    "ke", "ki", "koto", "kobe", "kothay", "keno", "kemon", "kivabe", "kibhabe", "kono", "kichu", "onek", "beshi", "kom", "shob", "sob", "protyek", "proti", "shudhu", "matro", "na", "nei", "nai", "ji", "hae", "hobe", "hoy", "hoyna", "holo", "hole", "hocche", "hoyeche", "chilo", "ache", "thake", "thakle", "thakbe",
    "korte", "kore", "korbe", "korben", "korle", "korar", "korun", "dite", "dile", "dibe", "diben", "diye", "dewa", "neoya", "nite", "nibe", "niye", "jabe", "jete", "asbe", "lagbe", "pare", "paren", "pari", "parbe", "parben", "bole", "bolte",
    "jonno", "moddhe", "theke", "porjonto", "por", "pore", "age", "agei", "sathe", "shate", "chara", "upor", "opor", "niche", "moto", "onujayi", "ekhane", "sekhane", "jekhane", "abar", "aro", "ekbar", "prothome",
)
OTHER_LATIN = (
    "le", "la", "les", "des", "du", "une", "est", "dans", "pour", "sur", "avec", "pas", "ne", "qui", "que", "aux", "ou", "der", "die", "das", "und", "ist", "nicht", "von", "oder", "mit", "ein", "eine", "auf", "für", "dem", "den", "wird",
    "el", "los", "las", "una", "por", "para", "con", "del", "se", "es", "como", "il", "che", "di", "della", "sono", "não", "uma", "com", "dos", "hai", "ka", "ko", "mein", "nahi", "aur", "liye", "hain", "ki", "kya", "yang", "dan", "untuk", "tidak", "ini", "bir", "ve", "için",
)

#: Share of its occurrences at which a run of words ends a sentence, up to which an unfinished answer that ends with it
#: counts as broken off: where only such runs that go on speak for it, and where the answer's length does.
ENDS_SELDOM, ENDS_SOMETIMES = 0.02, 0.5
#: Occurrences that a run of words needs for its share to be trusted; else a shorter run is asked.
TRUST = 5
#: A length is a spike when it has this many times the unfinished answers of the lengths around it, and at least so many.
SPIKE_TIMES, SPIKE_ROWS, SPIKE_REACH, SPIKE_FROM = 8, 20, 10, 40


_BLANKS = " \t\n\r\x0b\x0c\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def _bare(text: Column) -> Column:
    return F.btrim(text, F.lit(_BLANKS))


def _visible(text: Column) -> Column:
    """Text without markup, entities, zero-width characters and outer blanks."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?s)</?[A-Za-z!][^<>]*>|&(?:nbsp|amp|quot|lt|gt|#\d+);?", " ")
    return _bare(F.regexp_replace(t, r"[​-‏⁠﻿­]", ""))


def _words(text: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(F.lower(text), r"(?U)[^\p{L}\p{M}\p{N}]+", " "), " "), lambda w: w != "")


def _masked(text: Column) -> Column:
    """Lower case, each number a 0: answers that differ in figures only are then equal."""
    return F.regexp_replace(F.lower(text), r"[0-9০-৯]+(?:[.,][0-9০-৯]+)*", "0")


def _sentences(text: Column) -> Column:
    return F.filter(F.split(text, r"(?U)(?<=[.!?।])\s+|\n+"), lambda s: F.length(F.trim(s)) > 0)


ENDED = r"(?U)[.!?।:]\s*\z"
OPEN_END = r"(?U)(?:\.{2,}|…)\s*\z"


def _body(sentence: Column) -> Column:
    return F.regexp_replace(F.trim(sentence), r"(?U)[\s.!?।:…]+\z", "")


def features(pairs: DataFrame) -> DataFrame:
    """(pair_table, pair_key, question, seen, said, ...): the answer as it is seen, and without lead-ins and closing notes; the words that rules compare.

    Each is a column of its own, so that a rule that needs it in several places, or for every word, has it computed once.
    """
    seen = _visible(F.col("answer"))
    out = pairs.select("pair_table", "pair_key", F.coalesce("question", F.lit("")).alias("question"), seen.alias("seen"))
    out = out.withColumn("said", F.regexp_replace("seen", LEADS, ""))
    # only a text that ends like a note, or has a line of sources, is searched for one
    noted = F.col("said").rlike(r"[\])]\z|(?i)\n\s*(?:sources?|references?|সূত্র)\s*:")
    out = out.withColumn("said", _bare(F.when(noted, F.regexp_replace("said", TAIL_NOTES, "")).otherwise(F.col("said"))))
    own = F.regexp_replace(F.regexp_replace("said", r"[“\"«][^”\"»\n]*[”\"»]", " "), r"\A[A-Za-z][A-Za-z \-]{0,60}: ", "")
    out = out.withColumns({"q_words": F.array_distinct(_words(F.col("question"))), "a_words": _words(F.col("said")), "own": own})
    return out.withColumn("latin", F.split(F.regexp_replace(F.lower("own"), r"[^a-zà-ž]+", " "), " "))


def is_empty() -> Column:
    bare = F.regexp_replace(F.lower("seen"), r"(?U)[^\p{L}\p{M}\p{N}/]+", " ")
    return ~F.col("seen").rlike(r"(?U)[\p{L}\p{N}]") | F.trim(bare).isin(*PLACEHOLDERS) | ~F.col("said").rlike(r"(?U)[\p{L}\p{N}]")


def is_copied() -> Column:
    """The answer has hardly a word that isn't the question's, and most of the question's words."""
    foreign = F.size(F.array_except("a_words", "q_words"))
    held = F.size(F.array_intersect("q_words", "a_words")) / F.greatest(F.lit(1), F.size("q_words"))
    return (F.size("a_words") >= 2) & (foreign <= 0.1 * F.size("a_words")) & (held >= 0.7)


def is_refusal() -> Column:
    """Some sentence declines, and every other one is a courtesy."""
    declines = lambda s: s.rlike("|".join(f"(?:{r})" for r in REFUSALS))
    courtesy = lambda s: s.rlike(COURTESIES)
    parts = F.split(F.col("seen"), r"(?U)(?<=[.!?।])\s+|\n+")
    some = F.exists(parts, declines) | (F.exists(parts, lambda s: s.rlike(r"(?i)\A\W*(?:please (?:ask|contact|consult|refer)|you may want to (?:speak|ask))")) & (F.size(parts) <= 2))
    lead = r"(?iU)\A\W*(?:answer|note|a|hmm|hello|hi|ok|well|dear \w+)?\W*\z"
    # the test of every sentence stops at the first one that tells something, so it comes first
    return F.forall(parts, lambda s: courtesy(s) | s.rlike(lead) | declines(s)) & some


def is_other_language() -> Column:
    """By script where question and answer have different ones; by function words where both are in Latin letters.

    Quoted terms and a leading name before a colon don't count.
    """
    without = lambda c, p: F.length(c) - F.length(F.regexp_replace(c, p, ""))
    bn, la = without("own", "[ঀ-৿]+"), without("own", "[A-Za-zÀ-ž]+")
    other = F.length(F.regexp_replace("own", r"(?U)[^\p{L}]+|[ঀ-৿A-Za-zÀ-ž]+", ""))
    q_bn = without("question", "[ঀ-৿]+") > without("question", "[A-Za-z]+")
    q_la = without("question", "[A-Za-z]+") > 0
    count = lambda names: F.size(F.filter("latin", lambda w: w.isin(*names)))
    english, bangla, latin = count(ENGLISH), count(ROMANISED), count(OTHER_LATIN)
    # one such word tells as much where a sentence's worth of words has none in English
    alone = (english == 0) & (F.size(F.filter("latin", lambda w: F.length(w) > 1)) >= 4)
    romanised = ((bangla >= 2) & (bangla > english)) | ((bangla == 1) & alone)
    foreign_latin = ((latin >= 2) & (latin > 2 * english)) | ((latin == 1) & alone)
    full = F.when(q_bn, ((la > bn) & ~romanised) | (other > bn + la)).when(q_la, (bn > la) | (other > bn + la) | ((bn <= la) & (romanised | foreign_latin))).otherwise(False)
    # texts of ASCII only, told by their bytes, have no other script to count
    plain = lambda c: F.octet_length(c) == F.length(c)
    return F.when(plain("question") & plain("own"), F.col("question").rlike("[A-Za-z]") & (romanised | foreign_latin)).otherwise(full)


def _tokens(body: Column) -> Column:
    return F.regexp_extract_all(body, F.lit(r"(?U)[^\s,;:()“”\"]+|[,;:]"), F.lit(0))


def _tail(tokens: Column, end: Column, k: int) -> tuple[Column, Column]:
    """(head, last) of the run of `k` tokens before `end`: a hash of the tokens before its last one and of that one's first letter, and the last one.

    Runs that only differ in how far their last token goes have the same head, so they are neighbours in the order of their
    last tokens; the first letter keeps the runs after a frequent word from meeting in one task.
    """
    last = F.get(tokens, end - 1)
    return F.xxhash64(F.lit(k), *[F.get(tokens, end - k + j) for j in range(k - 1)], F.substring(last, 1, 1)), last


def open_tails(bodies: DataFrame) -> DataFrame:
    """(body, n_tokens, k, head, last): the last three, two and one tokens of bodies; a row for each that there is."""
    n = F.size("_w")
    runs = [F.when(n >= k, F.struct(F.lit(k).alias("k"), *[c.alias(x) for c, x in zip(_tail(F.col("_w"), n, k), ("head", "last"))])) for k in (3, 2, 1)]
    rows = bodies.select("body", _tokens(F.col("body")).alias("_w"))
    return rows.select("body", n.alias("n_tokens"), F.inline(F.filter(F.array(*runs), lambda x: x.isNotNull())))


#: Heads of unfinished tails that go to all tasks, 8 bytes each, so that other runs leave before they are counted; more of them meet the counted runs in a shuffle.
BROADCAST_HEADS = 1_000_000


def tail_counts(parts: DataFrame, tails: DataFrame) -> DataFrame:
    """(head, last, ends, goes, inside): of every run of tokens with the head of an unfinished tail, how often it ends a finished sentence and how
    often a sentence goes on after it, and whether the next run in order goes on inside its last token."""
    n = F.size("_w")

    def runs(k: int) -> Column:
        def at(end: Column) -> Column:
            head, last = _tail(F.col("_w"), end, k)
            return F.struct(head.alias("head"), last.alias("last"), ((end == n) & F.col("ended")).cast("int").alias("ends"), (end < n).cast("int").alias("goes"))

        return F.when(n >= k, F.transform(F.sequence(F.lit(k), n), at)).otherwise(F.array().cast("array<struct<head:bigint,last:string,ends:int,goes:int>>"))

    each = parts.select(_tokens(F.col("body")).alias("_w"), "ended", "times")
    each = each.select("times", F.inline(F.concat(runs(1), runs(2), runs(3))))
    heads = written(tails.select("head").distinct())
    few = heads.count() <= BROADCAST_HEADS
    each = each.join(F.broadcast(heads), "head", "left_semi") if few else each
    counted = each.groupBy("head", "last").agg(*[F.sum(F.col(c) * F.col("times")).alias(c) for c in ("ends", "goes")])
    counted = counted if few else counted.join(heads, "head", "left_semi")
    after = F.lead("last").over(Window.partitionBy("head").orderBy("last"))
    return counted.withColumn("inside", F.coalesce(F.startswith(after, F.col("last")), F.lit(False)))


def tail_evidence(parts: DataFrame, bodies: DataFrame) -> DataFrame:
    """(body, n_tokens, cut_tail, share) of unfinished bodies: whether a neighbour in the order of runs goes on where the body's last tokens stop, and
    the share of such runs that end a finished sentence, of the longest run that is seen often enough."""
    tails = written(open_tails(bodies))
    met = tails.join(tail_counts(parts, tails), ["head", "last"])
    seen = F.col("ends") + F.col("goes")
    share = F.col("ends") / seen
    trusted = F.max_by(share, F.when((seen >= F.when(F.col("k") > 1, TRUST).otherwise(1)), F.col("k")))
    return met.groupBy("body", "n_tokens").agg(F.bool_or((F.col("goes") > 0) | F.col("inside")).alias("cut_tail"), F.coalesce(trusted, F.lit(0.0)).alias("share"))


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over bodies in order: whether the next one, if any, goes on where a body stops. A last body's is left null, with the first one told."""
    from pyspark import TaskContext

    part, held, first = TaskContext.get().partitionId(), None, None
    for batch in batches:
        bodies = batch.column(0).to_pylist()
        first = bodies[0] if first is None and bodies else first
        run = ([] if held is None else [held]) + bodies
        longer = [b.startswith(a) for a, b in zip(run, run[1:])]
        if run:
            held = run[-1]
            yield pa.RecordBatch.from_arrays([pa.array(run[:-1], pa.string()), pa.array(longer, pa.bool_()), pa.array([part] * len(longer), pa.int32()), pa.array([None] * len(longer), pa.string())], names=["body", "longer", "part", "first"])
    if held is not None:
        yield pa.RecordBatch.from_arrays([pa.array([held]), pa.array([None], pa.bool_()), pa.array([part], pa.int32()), pa.array([first])], names=["body", "longer", "part", "first"])


def shortened(bodies: DataFrame) -> DataFrame:
    """(body) of the distinct bodies of which another one is a longer version.

    In sorted order a string's longer versions follow it, so comparing neighbours finds all: the bodies, already distinct,
    are range-partitioned and sorted, and one pass compares each with the next. The last body of a partition is compared
    with the first of the next one that isn't empty, over one row per partition.
    """
    ranged = bodies.repartitionByRange("body").sortWithinPartitions("body")
    seen = written(ranged.mapInArrow(_neighbours, "body string, longer boolean, part int, first string"))
    seams = seen.where(F.col("longer").isNull())
    after = F.lead("first").over(Window.partitionBy().orderBy("part"))  # one row per partition of the sort
    seams = seams.withColumn("longer", F.startswith(after, F.col("body")))
    return seen.where("longer").select("body").unionByName(seams.where("longer").select("body"))


def length_spikes(open_answers: DataFrame) -> DataFrame:
    """(pair_table, size) of the lengths at which many more answers stop unfinished than around it: a length limit's mark.

    Counted per length on the map side; each count is sent to the lengths within reach, so no window spans all lengths.
    """
    counts = open_answers.groupBy("pair_table", "size").agg(F.count("*").alias("n"))
    sent = counts.select("pair_table", "size", "n", F.explode(F.sequence(F.lit(-SPIKE_REACH), F.lit(SPIKE_REACH))).alias("by"))
    near = sent.groupBy("pair_table", (F.col("size") + F.col("by")).alias("size")).agg(F.sum(F.when(F.col("by") == 0, F.col("n"))).alias("here"), F.sum(F.when(F.col("by") != 0, F.col("n"))).alias("around"))
    usual = F.coalesce("around", F.lit(0)) / (2 * SPIKE_REACH)
    return near.where((F.col("here") >= SPIKE_ROWS) & (F.col("size") >= SPIKE_FROM) & (F.col("here") > SPIKE_TIMES * (usual + 1))).select("pair_table", "size")


def defects(pairs: DataFrame, neighbours: bool = True) -> DataFrame:
    """(pair_table, pair_key, defect) of every defective pair among (pair_table, pair_key, question, answer); at most one defect each.

    `empty`, `copied_question`, `refusal` and `other_language` are rules on the pair. An unfinished answer is `truncated` if
    a neighbour in sorted order shows it to be a shortened version, of a whole sentence (all answers' sentences, numbers
    masked) or of a run of last words that others go on from, or if its length is one at which unfinished answers pile
    up. Two things speak against it: the sentence stands finished elsewhere, and, where only the last words or the length
    speak for a cut, those words often end a sentence. A missing full stop alone shows none. Open brackets, figures broken
    off and dots at the end need no neighbour. Null keys are kept as they are, null questions are empty ones, repeated rows
    count once, and an empty table gives an empty result. Without `neighbours` no answer is held against others.
    """
    rows = features(pairs.select("pair_table", "pair_key", "question", "answer"))
    rule = F.when(is_empty(), "empty").when(is_copied(), "copied_question").when(is_refusal(), "refusal").when(is_other_language(), "other_language")
    rows = written(rows.select("pair_table", "pair_key", "said", rule.alias("rule")).distinct())
    told = rows.where(F.col("rule").isNull()).select("pair_table", "pair_key", "said")
    # every sentence of every answer, once with its number; the last one of an answer that doesn't end is open
    said = told.select("pair_table", "pair_key", "said", F.transform(_sentences(F.col("said")), _masked).alias("_s"))
    all_parts = said.select(F.explode("_s").alias("s"))
    parts = all_parts.select(_body(F.col("s")).alias("body"), (F.col("s").rlike(ENDED) & ~F.col("s").rlike(OPEN_END)).alias("ended"))
    parts = written(parts.groupBy("body", "ended").agg(F.count("*").alias("times")).where(F.length("body") > 0))
    last = F.element_at("_s", -1)
    opened = said.where((F.size("_s") > 0) & (~F.col("said").rlike(ENDED) | F.col("said").rlike(OPEN_END)))
    opened = opened.select("pair_table", "pair_key", F.length("said").alias("size"), "said", _body(last).alias("body"), last.rlike(OPEN_END).alias("dots"))
    broken = F.col("said").rlike(r"[0-9০-৯],[0-9০-৯]{1,2}\s*\z") | F.col("said").rlike(r"(?s)\([^()]*\z|“[^”]*\z")
    opened = written(opened.select("pair_table", "pair_key", "size", "body", "dots", broken.alias("broken")))

    finished = parts.where("ended").select("body", F.lit(True).alias("whole"))
    bodies = opened.select("body").distinct().join(finished, "body", "left_anti")
    judged = opened.join(length_spikes(opened).withColumn("spike", F.lit(True)), ["pair_table", "size"], "left")
    if neighbours:
        longer = shortened(parts.select("body").distinct()).select("body", F.lit(True).alias("longer"))
        held = tail_evidence(parts, bodies).join(longer, "body", "left")
        judged = judged.join(held, "body", "left")
        # a body of hardly more words than a run has is judged as one
        shorter = F.col("longer") & (F.col("n_tokens") > 3)
        cut = shorter | (F.col("cut_tail") & (F.col("share") <= ENDS_SELDOM)) | (F.col("spike") & (F.col("share") <= ENDS_SOMETIMES))
    else:
        judged = judged.join(bodies.withColumn("n_tokens", F.lit(0)), "body", "left")
        cut = F.col("spike") & F.col("n_tokens").isNotNull()
    truncated = judged.where(F.col("dots") | F.col("broken") | cut).select("pair_table", "pair_key", F.lit("truncated").alias("defect"))
    ruled = rows.where(F.col("rule").isNotNull()).select("pair_table", "pair_key", F.col("rule").alias("defect"))
    return ruled.unionByName(truncated).distinct()


def rates(pairs: DataFrame) -> DataFrame:
    """(pair_table, defect, pairs, rate): defective pairs by type and their part of the table's distinct keys."""
    every = pairs.select("pair_table", "pair_key").distinct().groupBy("pair_table").agg(F.count("*").alias("_all"))
    found = defects(pairs).groupBy("pair_table", "defect").agg(F.count("*").alias("pairs"))
    return found.join(every, "pair_table").select("pair_table", "defect", "pairs", (F.col("pairs") / F.col("_all")).alias("rate"))
