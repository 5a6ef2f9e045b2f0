"""Repairing text from scanned pages: broken words, misread characters, running headers, page numbers, lost paragraphs."""

from __future__ import annotations

import math
import re
import statistics
from collections.abc import Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clauseworks.operators.materialize import written

# Characters read for others, as (as read, as it should be), and letters read for digits.
CONFUSIONS = (
    ("0", "o"), ("1", "l"), ("1", "i"), ("!", "i"), ("!", "l"), ("|", "l"), ("|", "i"), ("5", "s"), ("$", "s"), ("6", "b"), ("8", "b"), ("9", "g"), ("q", "g"), ("@", "a"), ("4", "a"), ("3", "e"), ("€", "e"), ("c", "e"), ("e", "c"), ("†", "t"), ("7", "t"), ("+", "t"), ("i", "l"), ("l", "i"), ("l", "t"),
    ("rn", "m"), ("m", "rn"), ("vv", "w"), ("cl", "d"), ("d", "cl"), ("li", "h"), ("ri", "n"), ("ii", "u"), ("ti", "n"), ("in", "m"), ("nn", "m"), ("tn", "m"), ("h", "b"), ("b", "h"), ("n", "u"), ("u", "n"), ("f", "t"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬀ", "ff"), ("£", "l"), ("¢", "c"), ("0", "c"), ("v", "y"), ("y", "v"), ("2", "z"),
)
DIGITS_READ = {"o": "0", "l": "1", "i": "1", "|": "1", "!": "1", "s": "5", "b": "6", "g": "9", "q": "9", "z": "2", "$": "5"}
HYPHENS = "-‐‑¬­"
_PUNCT = "\"'“”‘’«»()[]{}<>.,;:!?।…*_/\\—–-‐‑¬­|†"
#: Punctuation at a word's ends; characters that a misread letter may have become are kept.
_EDGES = "\"'“”‘’«»()[]{}<>.,;:?।…*_/\\—–-‐‑¬­"
#: Nats that a first and every further misread character of a word cost, and the characters of a word that may be misread.
FIRST_SUB, NEXT_SUB, MOST_SUBS = 3.0, 1.0, 3
#: Places at which a word may be misread, up to which its readings are written out, and the characters up to which a string is taken for a word or a part of one.
MOST_PLACES, LONGEST_WORD = 24, 64
#: Nats that a lost or an added blank costs, and those of every character of a word that no clean text has.
BLANK, LETTER = 3.0, 2.5
#: Words of one letter, which the vocabulary leaves out, with their cost.
ONE_LETTER = {"a": 3.9}

_BN = {ord("০") + i: str(i) for i in range(10)}
_DECORATION = " \t\r\x0b\x0c\xa0-–—|[](){}<>*~•·.:_/"
_PAGE = re.compile(r"(?i)(?:page|pg|p|পৃষ্ঠা|পৃ)?[\s\-–—|\[\](){}<>*~•·.:_/]*(\d{1,10})(?:\s*(?:of|/|এর)\s*\d{1,10})?")
_BESIDE = re.compile(r"(?i)\A\s*(?:(?:page|p\.?)?\s*[|\[(–—-]?\s*\d{1,5}\s*[|\])–—-]?\s{2,}|\d{1,5}\s*[|–—]\s*)|(?:\s{2,}|\s*[|–—]\s*)(?:page|p\.?)?\s*[|\[(–—-]?\s*\d{1,5}\s*[|\])–—-]?\s*\Z")
_LABEL = re.compile(r"\A[A-Z][a-z]+ (?:[A-Z]|\d{1,2}|[IVX]+)\Z")
_LIST = re.compile(r"\A\s*(?:\(?(?:[a-z]|[ivx]+|\d{1,3}|[ক-হ]|[০-৯]{1,3})[.)]|[-•*–])\s+\S")


def _broken(line: str) -> str | None:
    """The first part of a word that a line breaks off, without its hyphen."""
    s = line.rstrip()
    if not s or s[-1] not in HYPHENS:
        return None
    words = s[:-1].split()
    return words[-1] if words and not s[-2].isspace() and any(c.isalpha() for c in words[-1]) else None


def _ended(line: str) -> bool:
    s = line.rstrip().rstrip("\"'”’)]")
    return bool(s) and s[-1] in ".!?।:;"


def _plain_digits(line: str) -> str:
    return line if line.isascii() else line.translate(_BN)


def _page_of(line: str, pages: set[int]) -> bool:
    m = _PAGE.fullmatch(_plain_digits(line).strip(_DECORATION))
    return bool(m) and int(m.group(1)) in pages


#: Characters that scans confuse count as one when a line is held against a title.
_FOLD = str.maketrans({"i": "l", "1": "l", "!": "l", "|": "l", "0": "o", "5": "s", "$": "s", "6": "b", "8": "b", "@": "a", "†": "t", "q": "g", "c": "e"})


def _title_words(text: str | None) -> list[str]:
    return re.findall(r"[^\W_]+(?:-[^\W_]+)*", (text or "").lower().translate(_FOLD))


def _codes(title: str | None) -> set[str]:
    """The codes in a title: words of five or more characters with a digit."""
    return {w.translate(_FOLD) for w in re.findall(r"[^\W_]+(?:-[^\W_]+)*", (title or "").lower()) if len(w) >= 5 and re.search(r"\d", w)}


def _is_title(words: list[str], title: list[str], codes: set[str]) -> bool:
    """Three or more words that stand in the title one after the other, the last perhaps cut short; or the title's own code in a short line or among the title's words."""
    if not codes.isdisjoint(words) and (len(words) <= 14 or 2 * sum(w in title for w in words) >= len(words)):
        return True
    if len(words) < 3:
        return False
    for i in range(len(title) - len(words) + 1):
        part = title[i : i + len(words)]
        if part[:-1] == words[:-1] and part[-1].startswith(words[-1]):
            return True
    return False


class Layout:
    """The lines of one text, told apart: content, page numbers, headers, and possible headers that need to recur in the document."""

    def __init__(self, text: str, title: str | None, pages: set[int]):
        self.lines = text.split("\n")
        self.kinds = ["content" if s.strip() else "blank" for s in self.lines]
        self.norms: dict[int, str] = {}
        title_words, codes = _title_words(title), _codes(title)
        full = [i for i, k in enumerate(self.kinds) if k == "content"]
        if len(full) < 2:
            return
        for n, i in enumerate(full):
            line = self.lines[i].strip()
            if _page_of(line, pages):
                before = self.lines[full[n - 1]].strip() if n else ""
                if not _LABEL.match(before):  # a row label and its figure are a table's
                    self.kinds[i] = "page"
        for n, i in enumerate(full):
            if self.kinds[i] != "content":
                continue
            line = self.lines[i].strip()
            if _ended(line) or _LIST.match(line):
                continue
            bare, digits = line, _plain_digits(line)
            m = _BESIDE.search(digits) if any(c.isdigit() for c in digits[:9] + digits[-9:]) else None
            if m and any(int(x) in pages for x in re.findall(r"\d+", m.group(0))):
                bare = (line[: m.start()] + " " + line[m.end() :]).strip()
            words = _title_words(bare)
            if not words:
                continue
            if _is_title(words, title_words, codes):
                self.kinds[i] = "header"
                continue
            capital = [w for w in re.findall(r"[^\W\d_]{2,}", bare) if len(w) > 3]
            if not capital or not all(w[0].isupper() for w in capital) or _LABEL.match(bare) or (len(words) < 2 and not bare.isupper()):
                continue
            before = [j for j in full[:n] if self.kinds[j] == "content"][-1:]
            cuts = bool(before) and not _ended(self.lines[before[0]]) and not _LABEL.match(self.lines[before[0]].strip()) and n + 1 < len(full)
            near = any(self.kinds[full[j]] == "page" for j in (n - 1, n + 1) if 0 <= j < len(full))
            if cuts or near:
                self.kinds[i] = "header"
            elif n == 0:
                self.kinds[i], self.norms[i] = "maybe", " ".join(words)

    def content(self) -> list[tuple[str, int, bool]]:
        """(line, blank lines before it, furniture before it) of the content lines."""
        out, blanks, furniture = [], 0, False
        for line, kind in zip(self.lines, self.kinds):
            if kind == "blank":
                blanks += 1
            elif kind in ("page", "header"):
                furniture = True
            else:
                out.append((line, blanks, furniture))
                blanks, furniture = 0, False
        return out

    def wrapped(self) -> bool:
        """Whether lines end where the paper did: with a broken word, or in the middle of a sentence."""
        c = [s for s, _, _ in self.content()]
        pairs = ((a.rstrip(), b.lstrip()) for a, b in zip(c, c[1:]))
        return any(a and b and (_broken(a) or (a.rstrip(",")[-1:].isalpha() and b[0].isalpha() and not b[0].isupper())) for a, b in pairs)


def broken_words(lines: list[str]) -> Iterator[tuple[int, str, str]]:
    """(line, first part, second part) of words broken over two content lines."""
    for i, (line, after) in enumerate(zip(lines, lines[1:])):
        part = _broken(line)
        rest = after.split(None, 1)[:1] if part else None
        if part and rest and rest[0][:1].isalnum():
            first, second = part.lstrip(_EDGES), rest[0].rstrip(_EDGES)
            if first and second and len(first) + len(second) <= LONGEST_WORD:
                yield i, first, second


def _laid_out(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for rid, title, text, pages in zip(pdf["record_id"], pdf["title"], pdf["text"], pdf["pages"]):
            layout = Layout(text, title, set() if pages is None else {int(p) for p in pages if p is not None and p == p})
            lines = [s for s, _, _ in layout.content()]
            breaks = list(broken_words(lines))
            keep = [s.split() for s in lines]
            for i, _, _ in breaks:  # both parts leave the stream of whole words
                keep[i][-1] = keep[i + 1][0] = "-"
            furniture = {k: [s.strip() for s, kind in zip(layout.lines, layout.kinds) if kind == k] for k in ("page", "header")}
            maybe = [{"line": layout.lines[i].strip(), "norm": n} for i, n in layout.norms.items()]
            stream = "\n".join(" ".join(w) for w in keep)
            rows.append((rid, title, layout.wrapped(), stream, furniture["page"], furniture["header"], maybe, [{"a": a.lower(), "b": b.lower()} for _, a, b in breaks]))
        yield pd.DataFrame(rows, columns=["record_id", "title", "scanned", "stream", "pages", "headers", "maybe", "breaks"])


LAID_OUT = "record_id bigint, title string, scanned boolean, stream string, pages array<string>, headers array<string>, maybe array<struct<line:string,norm:string>>, breaks array<struct<a:string,b:string>>"


def lay_out(df: DataFrame) -> DataFrame:
    """One row per text: its furniture, its broken words and the stream of its other words. Only texts of several lines go through Python."""
    rows = df.select("record_id", F.coalesce("document_name", F.lit("")).alias("title"), F.col("subsection_text").alias("text"), F.col("page_numbers").alias("pages")).where(F.col("text").isNotNull())
    several = F.instr("text", "\n") > 0
    empty = lambda kind: F.array().cast(kind)
    one = rows.where(~several).select("record_id", "title", F.lit(False).alias("scanned"), F.col("text").alias("stream"), empty("array<string>").alias("pages"), empty("array<string>").alias("headers"), empty("array<struct<line:string,norm:string>>").alias("maybe"), empty("array<struct<a:string,b:string>>").alias("breaks"))
    return rows.where(several).mapInPandas(_laid_out, LAID_OUT).unionByName(one)


def _tokens(stream: Column) -> Column:
    edge = "[" + re.escape(_EDGES) + "]+"
    clean = F.transform(F.split(F.lower(stream), r"(?U)\s+"), lambda w: F.regexp_replace(w, f"^{edge}|!*{edge}!*$|!+$", ""))
    return F.filter(clean, lambda w: w.rlike(r"(?U)\p{L}") & (F.length(w) > 1))


def _places(word: str) -> list[tuple[int, str, str]]:
    return [(i, a, b) for i in range(len(word)) for a, b in CONFUSIONS if word.startswith(a, i)]


def readings(word: str, most: int = MOST_SUBS) -> dict[str, int]:
    """What a written word may have been, with the number of misread places: all ways to undo up to `most` confusions."""
    out: dict[str, int] = {word: 0}
    places = _places(word)

    def go(at: int, k: int, built: str, subs: int) -> None:
        if subs:
            whole = built + word[at:]
            out[whole] = min(out.get(whole, subs), subs)
        if subs == most:
            return
        for j in range(k, len(places)):
            i, a, b = places[j]
            if i >= at:
                go(i + len(a), j + 1, built + word[at:i] + b, subs + 1)

    go(0, 0, "", 0)
    return out


def listed(word: str) -> bool:
    """Whether a word's readings are few enough to be written out; the others are met by their strokes."""
    return len(word) <= LONGEST_WORD and len(_places(word)) <= MOST_PLACES


def strokes(word: Column) -> Column:
    """What is left of a word when characters that are confused are made alike: every reading of a word has the word's own strokes."""
    alike = {"i": "l1!|t†7+f£rnuhbm68ﬁﬂﬀ", "c": "o0e3€¢", "s": "$5", "g": "9q", "a": "@4", "v": "wy", "z": "2"}
    one = F.translate(word, "".join(alike.values()), "".join(c * len(held) for c, held in alike.items()))
    return F.regexp_replace(F.regexp_replace(F.replace(one, F.lit("d"), F.lit("ci")), "i+", "i"), "v+", "v")


def misread_places(written_word: str, reading: str, most: int = MOST_SUBS) -> int | None:
    """The fewest confusions that make `written_word` of `reading`, if there are at most `most`."""
    states = {(0, 0): 0}
    for i in range(len(written_word)):
        for (at, j), subs in [x for x in states.items() if x[0][0] == i]:
            steps = [(1, 1, 0)] if j < len(reading) and written_word[i] == reading[j] else []
            steps += [(len(a), len(b), 1) for a, b in CONFUSIONS if written_word.startswith(a, i) and reading.startswith(b, j)]
            for di, dj, cost in steps:
                k, n = (i + di, j + dj), subs + cost
                if n <= most and n < states.get(k, most + 1):
                    states[k] = n
            del states[(at, j)]
    return states.get((len(written_word), len(reading)))


def met_by_strokes(asked: DataFrame, words: DataFrame, most: int) -> DataFrame:
    """(word, reading, subs) of the asked words whose readings are too many to write out: the vocabulary's words of the same strokes, checked one by one."""
    @F.pandas_udf("int")
    def checked(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([misread_places(x, y, most) for x, y in zip(a, b)], dtype="Int32")

    pairs = asked.select("word", strokes(F.col("word")).alias("_s")).join(words.select(F.col("word").alias("reading"), strokes(F.col("word")).alias("_s")), "_s")
    pairs = pairs.where(F.length("reading").between(F.length("word") / 2, F.length("word") * 2))
    return pairs.select("word", "reading", checked("word", "reading").alias("subs")).where("subs > 0")


def number(word: str) -> str | None:
    """The number that a word of digits and letters read for digits stands for, if it is written like one."""
    if not re.search(r"\d", word) or not re.search(r"[^\W\d_]|[|!$]", word):
        return None
    plain = "".join(DIGITS_READ.get(c, c) for c in word)
    grouped = re.fullmatch(r"\d{1,3}(?:,\d{2,3})+(?:\.\d+)?", plain)
    inner = re.fullmatch(r"\d+(?:\.\d+)?", plain) and (re.match(r"\d+[^\W\d_]+\d", word) or re.fullmatch(r"[ol|!]?\d{2,}o?|[ol|!]?\d{3,}\D", word)) and not re.search(r"[a-z]{2,}", word.replace("o", "").replace("l", ""))
    return plain if grouped or inner else None


#: Rows that a task makes at a time; one word may have thousands of readings and parts, a batch of words millions.
ROWS_AT_ONCE = 20_000


def _frames(rows: Iterator[tuple], *columns: str) -> Iterator[pd.DataFrame]:
    """Rows as frames of bounded size, so that a task's memory doesn't grow with its words."""
    while part := list(islice(rows, ROWS_AT_ONCE)):
        yield pd.DataFrame(part, columns=list(columns))


def _proposed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    def rows() -> Iterator[tuple]:
        for w in (w for pdf in batches for w in pdf["word"]):
            n = number(w)
            if n:
                yield w, n, 1, True
            elif listed(w):
                yield from ((w, c, s, False) for c, s in readings(w).items() if s)
            elif len(w) <= LONGEST_WORD:
                yield w, None, 0, False

    return _frames(rows(), "word", "reading", "subs", "is_number")


def _joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    pairs = ((a, b) for pdf in batches for a, b in zip(pdf["a"], pdf["b"]))
    rows = ((a, b, c, s) for a, b in pairs for whole in (a + b, f"{a}-{b}") for c, s in (readings(whole, 2) if listed(whole) else {whole: 0}).items())
    return _frames(rows, "a", "b", "reading", "subs")


def vocabulary(laid: DataFrame) -> DataFrame:
    """(word, n, n_clean): how often each word stands in the streams, and in those of texts that don't look scanned. Summed on the map side."""
    each = laid.select("scanned", F.explode(_tokens(F.col("stream"))).alias("word"))
    return each.groupBy("word").agg(F.count("*").alias("n"), F.count_if(~F.col("scanned")).alias("n_clean"))


def corrections(words: DataFrame) -> DataFrame:
    """(word, fix) of the distinct words that are better read otherwise.

    The readings of every distinct word meet the vocabulary in a shuffle, so it need not fit anywhere. A reading's cost
    is the negative log of its frequency and what its confusions cost; the written word's is that of its own frequency.
    A word that stands in clean text at the rate it has in scans is kept as it is.
    """
    clean, every = words.agg(F.coalesce(F.sum("n_clean"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()  # two numbers
    in_scans = F.col("n") - F.col("n_clean")
    unlike_clean = F.col("n_clean") * F.lit(every - clean) < 0.2 * in_scans * F.lit(clean) if clean else F.lit(True)
    doubtful = words.where((in_scans > 0) & unlike_clean)
    doubtful = doubtful.select("word", F.col("n").alias("own"), F.col("n_clean").alias("own_clean"))
    proposed = doubtful.select("word").repartition("word").mapInPandas(_proposed, "word string, reading string, subs int, is_number boolean")
    proposed = written(proposed)
    many = met_by_strokes(proposed.where("reading IS NULL").select("word"), words, MOST_SUBS).withColumn("is_number", F.lit(False))
    proposed = proposed.where("reading IS NOT NULL").unionByName(many)
    known = proposed.where(~F.col("is_number")).join(words.withColumnRenamed("word", "reading"), "reading").join(doubtful, "word")
    cost = F.log(F.col("n").cast("double")) - (FIRST_SUB + NEXT_SUB * (F.col("subs") - 1))
    plain = (F.col("own_clean") == 0) & (F.col("n_clean") >= 2) & (F.col("n_clean") >= F.col("own"))
    known = known.withColumn("gain", cost - F.log(F.col("own").cast("double"))).where((F.col("gain") > 0) | plain)
    best = known.groupBy("word").agg(F.max_by("reading", F.struct("gain", "reading")).alias("fix"))
    return best.unionByName(proposed.where("is_number").select("word", F.col("reading").alias("fix")))


def joins(laid: DataFrame, words: DataFrame) -> DataFrame:
    """(a, b, whole, misread) of the distinct broken words: joined, or with the hyphen that belongs to them, as the vocabulary has it; its characters corrected."""
    pairs = laid.select(F.inline("breaks")).distinct()
    read = pairs.repartition("a", "b").mapInPandas(_joined, "a string, b string, reading string, subs int")
    whole = pairs.select("a", "b", F.explode(F.array(F.concat("a", "b"), F.concat_ws("-", "a", "b"))).alias("word"))
    whole = whole.where((F.length("word") > MOST_PLACES // 4) & (F.length("word") <= LONGEST_WORD))

    @F.pandas_udf("boolean")
    def unlisted(batch: pd.Series) -> pd.Series:
        return batch.map(lambda w: not listed(w)).astype(bool)

    many = met_by_strokes(whole.select("word").distinct().where(unlisted("word")), words, 2)
    read = read.unionByName(whole.join(many, "word").select("a", "b", "reading", "subs"))
    met = read.hint("merge").join(words.withColumnRenamed("word", "reading"), "reading")  # no broadcast: its size is guessed before the readings are made
    gain = F.log(F.col("n").cast("double")) - F.when(F.col("subs") > 0, FIRST_SUB + NEXT_SUB * F.col("subs")).otherwise(0.0)
    best = met.groupBy("a", "b").agg(F.max_by(F.struct("reading", "subs"), F.struct(gain, "reading")).alias("r"))
    hyphen = F.concat_ws("-", "a", "b")
    default = F.when(F.instr("a", "-") > 0, hyphen).otherwise(F.concat("a", "b"))
    out = pairs.join(best, ["a", "b"], "left")
    return out.select("a", "b", F.coalesce("r.reading", default).alias("whole"), (F.coalesce("r.subs", F.lit(0)) > 0).alias("misread"))


def _parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    rows = (
        (w, i, j, c, s)
        for pdf in batches for w in pdf["word"] for i in range(len(w)) for j in range(i + 2, min(len(w), i + LONGEST_WORD) + 1) if j - i < len(w)
        for c, s in readings(w[i:j], 1).items()
    )
    return _frames(rows, "word", "i", "j", "reading", "subs")


def segmented(length: int, edges: list[tuple[int, int, str, float]]) -> tuple[float, list[str]]:
    """The cheapest sequence of words, (begin, end, word, cost), over a stream of `length` characters, by Viterbi."""
    best: list[tuple[float, list[str]]] = [(0.0, [])] + [(float("inf"), [])] * length
    for i, j, word, cost in sorted(edges):
        c = best[i][0] + cost + (BLANK if i else 0.0)
        if c < best[j][0]:
            best[j] = (c, best[i][1] + [word])
    return best[length]


def merges(words: DataFrame) -> DataFrame:
    """(word, fix) of the distinct words that are several words whose blanks were lost: "ofthe", "of the".

    The characters of every word that no clean text has are segmented into words of clean texts, each perhaps misread in
    one place. The parts meet the vocabulary in a shuffle; those of one word, bounded by its length, are decoded together.
    """
    every = words.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]  # one number
    unknown = words.where((F.col("n_clean") == 0) & (F.length("word") >= 4) & (F.length("word") <= LONGEST_WORD * 4) & F.col("word").rlike(r"(?U)^[\p{L}\p{N}!|$@€†+£¢]+$"))
    parts = unknown.select("word").repartition("word").mapInPandas(_parts, "word string, i int, j int, reading string, subs int")
    met = parts.hint("merge").join(words.where("n_clean >= 2").select(F.col("word").alias("reading"), "n"), "reading")
    cost = F.log(F.lit(float(max(every, 1)))) - F.log(F.col("n").cast("double")) + F.col("subs") * FIRST_SUB
    gathered = met.groupBy("word").agg(F.collect_list(F.struct("i", "j", "reading", cost.alias("cost"))).alias("edges")).join(unknown.select("word", "n"), "word")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for word, edges, n in zip(pdf["word"], pdf["edges"], pdf["n"]):
                ones = [(i, i + 1, c, ONE_LETTER[c]) for i, c in enumerate(word) if c in ONE_LETTER]
                price, said = segmented(len(word), [(e["i"], e["j"], e["reading"], e["cost"]) for e in edges] + ones)
                if len(said) > 1 and price < LETTER * len(word) - math.log(n):
                    rows.append((word, " ".join(said), price))
            yield pd.DataFrame(rows, columns=["word", "cut", "price"])

    return gathered.mapInPandas(run, "word string, cut string, price double")


def with_merges(fixed: DataFrame, words: DataFrame) -> DataFrame:
    """(word, fix): the words' single readings, or the segmentation where there is none or it costs less."""
    every = words.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    n = words.select(F.col("word").alias("fix"), F.col("n").alias("_n"))
    priced = fixed.join(n, "fix", "left").select("word", "fix", F.when(F.col("_n").isNull(), 0.0).otherwise(F.log(F.lit(float(max(every, 1)))) - F.log(F.col("_n").cast("double")) + FIRST_SUB).alias("own"))
    both = priced.join(merges(words), "word", "full")
    cut = F.col("fix").isNull() | (F.col("price") < F.col("own"))
    return both.select("word", F.when(F.col("cut").isNotNull() & cut, F.col("cut")).otherwise(F.col("fix")).alias("fix"))


def _halves(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    return _frames(((a, b, c, s) for pdf in batches for a, b in zip(pdf["a"], pdf["b"]) for c, s in readings(a + b, 1).items()), "a", "b", "reading", "subs")


def splits(laid: DataFrame, words: DataFrame, fixed: DataFrame) -> DataFrame:
    """(record_id, a, b, line_end, whole, misread): neighbours that are one word, broken by a blank or at a line end without a hyphen.

    One of the two must be a word that no clean text has; both are held against the whole under the same unigram model.
    """
    every = words.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    size = F.log(F.lit(float(max(every, 1))))
    edge = "[" + re.escape(_EDGES) + "]+"
    lines = F.transform(F.split(F.lower("stream"), "\n"), lambda s, i: F.transform(F.split(s, r"(?U)\s+"), lambda w: F.struct(w.alias("w"), i.alias("i"))))
    flat = F.filter(F.flatten(lines), lambda x: x.w != "")
    pair = lambda x, y: F.struct(F.regexp_replace(x.w, f"^{edge}", "").alias("a"), F.regexp_replace(y.w, f"{edge}!*$|!+$", "").alias("b"), (x.i != y.i).alias("line_end"))
    rows = laid.where("scanned").select("record_id", flat.alias("t")).where(F.size("t") > 1)
    rows = rows.select("record_id", F.inline(F.zip_with(F.slice("t", 1, F.size("t") - 1), F.slice("t", 2, F.size("t") - 1), pair)))
    rows = rows.where(F.col("a").rlike(r"(?U)^[\p{L}\p{N}]+$") & F.col("b").rlike(r"(?U)^[\p{L}\p{N}]+$") & F.concat("a", "b").rlike(r"(?U)\p{L}{2}") & (F.length("a") + F.length("b") <= LONGEST_WORD))
    # pairs of two frequent words of clean texts leave before the shuffle; only a filter, as for the misread words
    usual = words.where("n_clean > 0").orderBy(F.col("n").desc(), "word").limit(COMMON_WORDS).select("word", F.lit(True).alias("_u"))
    for c in ("a", "b"):
        rows = rows.join(F.broadcast(usual.select(F.col("word").alias(c), F.col("_u").alias(f"_{c}"))), c, "left")
    rows = written(rows.where("_a IS NULL OR _b IS NULL").select("record_id", "a", "b", "line_end").distinct())
    unknown = words.where("n_clean = 0").select("word")
    held = [rows.join(unknown.withColumnRenamed("word", c), c, "left_semi").select("record_id", "a", "b", "line_end") for c in ("a", "b")]
    rows = written(held[0].unionByName(held[1]).distinct())
    priced = words.join(fixed.join(words.select(F.col("word").alias("fix"), F.col("n").alias("_f")), "fix").select("word", "_f"), "word", "left")
    own = F.when(F.col("n_clean") > 0, size - F.log(F.col("n").cast("double"))).otherwise(F.least(LETTER * F.length("word") - F.log(F.col("n").cast("double")), F.coalesce(size - F.log(F.col("_f").cast("double")) + FIRST_SUB, F.lit(1e9))))
    priced = priced.select("word", own.alias("own"))
    pairs = rows.select("a", "b").distinct()
    for c in ("a", "b"):
        pairs = pairs.join(priced.select(F.col("word").alias(c), F.col("own").alias(f"_{c}")), c, "left").withColumn(f"_{c}", F.coalesce(f"_{c}", F.lit(LETTER) * F.length(c)))
    read = pairs.select("a", "b").repartition("a", "b").mapInPandas(_halves, "a string, b string, reading string, subs int")
    met = read.hint("merge").join(words.where("n_clean >= 2").select(F.col("word").alias("reading"), "n"), "reading")
    price = size - F.log(F.col("n").cast("double")) + BLANK + F.col("subs") * FIRST_SUB
    best = met.groupBy("a", "b").agg(F.min(F.struct(price.alias("price"), "reading", "subs")).alias("r"))
    best = best.join(pairs, ["a", "b"]).where(F.col("r.price") < F.col("_a") + F.col("_b"))
    return rows.join(best, ["a", "b"]).select("record_id", "a", "b", "line_end", F.col("r.reading").alias("whole"), (F.col("r.subs") > 0).alias("misread"))


#: Frequent words that need no correction and are taken out before the shuffle; only a filter, the other words go the long way.
COMMON_WORDS = 50_000


def _decoded(df: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """(laid, headers, fixes, wholes, rejoined) of a table of texts."""
    laid = written(lay_out(df))
    words = written(vocabulary(laid))
    fixed = written(with_merges(corrections(words), words))
    recur = laid.select("record_id", "title", F.inline("maybe")).distinct()
    often = recur.groupBy("title", "norm").agg(F.count_distinct("record_id").alias("k")).where(F.col("k") >= 2)
    folded = F.translate(F.lower("h"), "i1!|05$68@†qc", "llllossbbatge")
    inside = laid.select("title", F.explode("headers").alias("h")).select("title", F.array_join(F.regexp_extract_all(folded, F.lit(r"(?U)[^\W_]+(?:-[^\W_]+)*"), F.lit(0)), " ").alias("norm")).distinct()
    sure = often.select("title", "norm").unionByName(inside).distinct()
    anywhere = inside.groupBy("norm").agg(F.count("*").alias("k")).where(F.col("k") >= 2)  # stamped on several documents
    held = recur.join(sure, ["title", "norm"], "left_semi").unionByName(recur.join(anywhere, "norm", "left_semi").select(*recur.columns))
    headers = laid.select("record_id", F.explode("headers").alias("line")).unionByName(held.select("record_id", "line")).distinct()
    common = words.join(fixed, "word", "left_anti").orderBy(F.col("n").desc(), "word").limit(COMMON_WORDS).select("word")
    rare = laid.where("scanned").select("record_id", F.explode(F.array_distinct(_tokens(F.col("stream")))).alias("word")).join(F.broadcast(common), "word", "left_anti")
    fixes = rare.join(fixed, "word").select("record_id", "word", "fix").distinct()
    wholes = laid.select("record_id", F.inline("breaks")).distinct().join(joins(laid, words), ["a", "b"])
    rejoined = written(splits(laid, words, fixed))
    halves = rejoined.select("record_id", F.explode(F.array("a", "b")).alias("word")).distinct()
    return laid, headers, fixes.join(halves, ["record_id", "word"], "left_anti"), wholes, rejoined


def defects(df: DataFrame) -> DataFrame:
    """(record_id, kind, fragment): what a scan did to a text, among rows of record_id, document_name, subsection_text and page_numbers.

    Lines are told apart by layout, words broken at line ends are joined, and the de-lined words are decoded against the
    words of all texts, with lost and added blanks: a word broken by a blank within a line is misread, and words run together
    are misread for the words with their blanks. Kinds `split_word`, `misread`, `header` and `page_number`. Null texts give no row, null titles and
    page lists are empty, rows delivered again count once. Whole texts are read.
    """
    laid, headers, fixes, wholes, rejoined = _decoded(df)
    kind = lambda rows, name, fragment: rows.select("record_id", F.lit(name).alias("kind"), F.col(fragment).alias("fragment"))
    pages = laid.select("record_id", F.explode("pages").alias("line"))
    parts = [kind(pages, "page_number", "line"), kind(headers, "header", "line"), kind(fixes, "misread", "fix"), kind(wholes, "split_word", "whole"), kind(wholes.where("misread"), "misread", "whole")]
    parts += [kind(rejoined.where("line_end"), "split_word", "whole"), kind(rejoined.where("misread OR NOT line_end"), "misread", "whole")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def paragraphs(lines: list[tuple[str, int, bool]]) -> list[list[str]]:
    """Content lines grouped into paragraphs by dynamic programming.

    The cost of a break between two lines comes from their blank lines, punctuation, length and first characters, that of
    a paragraph from its number of lines; the cheapest sequence of breaks is taken.
    """
    if not lines:
        return []
    width = statistics.median(len(s.strip()) for s, _, _ in lines)
    n = len(lines)
    evidence = [0.0] * n  # for a break before line i
    for i in range(1, n):
        (a, _, _), (b, blanks, furniture) = lines[i - 1], lines[i]
        ended, start = _ended(a), b.strip()[:1]
        e = -1.0 + (2.5 if blanks and not furniture else 0.8 if blanks else 0.0)
        e += (1.0 if ended else -3.0) + (1.2 if ended and len(a.strip()) < 0.75 * width else 0.0)
        e += 4.0 if _LIST.match(b) else 0.0
        e += -3.0 if start.islower() and not _LIST.match(b) else 0.0
        e -= 8.0 if _broken(a) else 0.0
        evidence[i] = e
    # a paragraph's cost is linear in its lines from six on, so the best begin so far can be carried along
    best, back = [0.0] + [float("inf")] * n, [0] * (n + 1)
    far, far_cost = 0, float("inf")
    opens = lambda begin: best[begin] - (evidence[begin] if begin else 0.0)
    for end in range(1, n + 1):
        if end >= 6 and opens(end - 6) - 0.01 * (end - 6) < far_cost:
            far, far_cost = end - 6, opens(end - 6) - 0.01 * (end - 6)
        near = ((opens(begin) + 0.01 * (6 - end + begin), begin) for begin in range(max(0, end - 5), end))
        best[end], back[end] = min([(far_cost + 0.01 * (end - 6), far), *near])
    out, end = [], n
    while end:
        out.append([s for s, _, _ in lines[back[end] : end]])
        end = back[end]
    return out[::-1]


def repaired_text(text: str, title: str, pages: set[int], headers: set[str], fixes: dict[str, str], wholes: dict[tuple[str, str], str], rejoined: dict[tuple[str, str], str] | None = None) -> str:
    """The text without furniture, its broken words joined, misread words corrected, its lines as paragraphs."""
    layout = Layout(text, title, pages)
    for i in layout.norms:
        if layout.lines[i].strip() in headers:
            layout.kinds[i] = "header"

    def cased(old: str, new: str) -> str:
        return new.upper() if old.isupper() and len(old) > 1 else new[:1].upper() + new[1:] if old[:1].isupper() else new

    def word(m: re.Match) -> str:
        core = m.group(0).strip(_EDGES)
        core = core if core.lower() in fixes else core.rstrip("!")
        new = fixes.get(core.lower())
        return m.group(0).replace(core, cased(core, new), 1) if new and core else m.group(0)

    out = []
    for lines in paragraphs(layout.content()):
        lines = [s.strip() for s in lines]
        for i, a, b in reversed(list(broken_words(lines))):
            whole = wholes.get((a.lower(), b.lower()))
            if whole:
                rest = lines[i + 1].split(None, 1)
                tail = rest[0][len(b) :] if rest[0].startswith(b) else ""
                head = re.sub(rf"{re.escape(a)}[{HYPHENS}]\s*\Z", lambda _: cased(a, whole), lines[i])
                lines[i : i + 2] = [" ".join([head + tail, *rest[1:]])]
        joined = re.sub(r"[ \t]+", " ", " ".join(lines))
        for (a, b), whole in (rejoined or {}).items():
            joined = re.sub(rf"(?i)(?<!\w){re.escape(a)}\s+{re.escape(b)}(?!\w)", lambda m, w=whole: cased(m.group(0), w), joined)
        out.append(re.sub(r"\S+", word, joined) if fixes else joined)
    return "\n\n".join(out)


def repair(df: DataFrame) -> DataFrame:
    """(record_id, repaired_text) of every record with a text, once each; a text of one line only has its words corrected."""
    _, headers, fixes, wholes, rejoined = _decoded(df)
    by = lambda rows, name, *c: rows.groupBy("record_id").agg(F.collect_list(F.struct(*c) if len(c) > 1 else F.col(c[0])).alias(name))  # noqa: E731  bounded by the words of one text
    rows = df.select("record_id", F.coalesce("document_name", F.lit("")).alias("title"), F.col("subsection_text").alias("text"), F.col("page_numbers").alias("pages")).where(F.col("text").isNotNull()).dropDuplicates(["record_id"])
    rows = rows.join(by(headers, "headers", "line"), "record_id", "left").join(by(fixes, "fixes", "word", "fix"), "record_id", "left").join(by(wholes, "wholes", "a", "b", "whole"), "record_id", "left").join(by(rejoined.select("record_id", "a", "b", "whole").distinct(), "rejoined", "a", "b", "whole"), "record_id", "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = lambda x: [] if x is None else x
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                pages = {int(p) for p in held(r.pages) if p is not None and p == p}
                fix = {x["word"]: x["fix"] for x in held(r.fixes)}
                whole = {(x["a"], x["b"]): x["whole"] for x in held(r.wholes)}
                out.append((r.record_id, repaired_text(r.text, r.title, pages, set(held(r.headers)), fix, whole, {(x["a"], x["b"]): x["whole"] for x in held(r.rejoined)})))
            yield pd.DataFrame(out, columns=["record_id", "repaired_text"])

    return rows.mapInPandas(run, "record_id bigint, repaired_text string")
