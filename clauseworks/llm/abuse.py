"""Scoring texts for abusive, hateful and sexual content, after undoing their obfuscation."""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clauseworks.llm import lexicon as L
from clauseworks.operators.materialize import written

CATEGORIES = ("abuse", "hate", "sexual")
LETTERS = "abcdefghijklmnopqrstuvwxyz"
SIGNS = "_" + LETTERS
#: Order of the character model: its table has at most 27 to this power rows, whatever the corpus.
ORDER = 4
# What a written character may stand for.
LEET = {"@": "a", "4": "a", "8": "b", "(": "c", "€": "e", "3": "e", "6": "bg", "9": "gq", "#": "h", "!": "il", "1": "il", "|": "il", "0": "o", "$": "s", "5": "s", "+": "t", "7": "t", "2": "z", "%": "x", "^": "a", "*": LETTERS, "×": "x", "¡": "i", "£": "l"}
SEPARATORS = " .-_*·~/​‌‍⁠﻿­"
#: Costs in nats: a leetspeak reading, a star, a dropped separator, a dropped repetition, a listed word as a whole, and a code or number
#: as a whole; a code's letters and digits cost what they do where all are as likely.
COST = {"leet": 1.5, "star": 3.2, "separator": 0.7, "repeat": 0.9, "word": 6.5, "odd": 6.0, "code": 2.0, "letter": math.log(26), "digit": math.log(10)}

_SPACED = r"(?<![\w])[a-z0-9@$!](?:(?P<s>[ .\-_·~/​‌‍⁠*])[a-z0-9@$!*])(?:(?P=s)[a-z0-9@$!*]){1,}(?:s|es)?(?![\w*@$])"
_LEETED = r"(?<![\w@$!|*+€#^])(?=[^\s]*[a-z])(?=[a-z]*[@$!|*+€#^%0-9])[a-z0-9@$!|*+€#^%]{3,}(?![\w])"
_REPEATED = r"(?<![\w])[a-z]*(?P<r>[a-z])(?P=r){2,}[a-z]*(?![\w])"
SUSPICIOUS = re.compile(f"{_SPACED}|{_LEETED}|{_REPEATED}")
_ZERO_WIDTH = re.compile("[​‌‍⁠﻿­]")
_CODES = re.compile(r"[a-z]{0,2}[0-9.,:/()-]+[a-z]{0,2}\Z|[a-z]+[0-9]{2,}\Z|[0-9]+[a-z]+\Z")
_SENTENCE = re.compile(r"(?<=[.!?।\n])\s+|\n+")


def character_counts(texts: DataFrame, text_col: str) -> dict[str, int]:
    """Counts of character runs of ORDER letters over all words of all texts, a word weighted by the log of its count.

    Words are counted with partial sums on the map side; only the runs, at most 27^ORDER, come to the driver.
    """
    words = texts.select(F.explode(F.regexp_extract_all(F.lower(text_col), F.lit("[a-z]{2,}"), F.lit(0))).alias("w"))
    words = words.groupBy("w").agg(F.log2(F.count("*") + F.lit(1.0)).alias("n"))
    padded = F.concat(F.lit("_" * (ORDER - 1)), F.col("w"), F.lit("_"))
    runs = F.transform(F.sequence(F.lit(1), F.length("w") + 1), lambda i: F.substring(padded, i, F.lit(ORDER)))
    rows = words.select("n", F.explode(runs).alias("run")).groupBy("run").agg(F.sum("n").alias("n"))
    return {r: n for r, n in rows.collect()}


class Restorer:
    """Viterbi decoding of a suspicious token's character lattice.

    Two models compete for the intended word: a list of words, walked as a trie, and a character model of the corpus.
    Every written character stands for itself, for what leetspeak makes of it, or, as a separator or repetition, for nothing.
    """

    def __init__(self, counts: dict[str, float]):
        self.runs = counts
        self.table: np.ndarray | None = None
        self.contexts: dict[str, float] = {}
        for run, n in counts.items():
            self.contexts[run[:-1]] = self.contexts.get(run[:-1], 0.0) + n
        self.trie: dict = {}
        words = {*L.INSULTS, *L.WEAK_INSULTS, *L.SEXUAL_WORDS, *L.OBSCENE, *L.SCORN, "damn", "kill", "vermin", "subhuman"}
        plain = {w for w in words if w.isalpha()}
        for w in plain | {w + "s" for w in plain} | {w + "es" for w in plain if w[-2:] in ("ch", "ss", "sh")}:
            node = self.trie
            for c in w:
                node = node.setdefault(c, {})
            node["$"] = w
        self.words = plain | {w + "s" for w in plain}
        # a listed word comes last, so that it is taken before another's plural ("tits", not "titss")
        self.collapsed = {re.sub(r"(.)\1+", r"\1", w): w for w in [*sorted(self.words - plain), *sorted(plain)] if len(w) >= 4}

    def _step(self, context: str, c: str) -> float:
        n = self.runs.get(context + c, 0.0)
        return -math.log((n + 0.02) / (self.contexts.get(context, 0.0) + 0.54))

    @staticmethod
    def _readings(o: str) -> list[tuple[str, float]]:
        own = [(o, 0.0)] if o in LETTERS else []
        cost = COST["star"] if o == "*" else COST["leet"]
        return own + [(c, cost) for c in LEET.get(o, "")]

    @staticmethod
    def _dropped(separator: str) -> float:
        return COST["star"] if separator == "*" else COST["separator"]

    def _listed(self, token: str) -> tuple[float, str | None]:
        states: dict[int, tuple[float, dict, str]] = {id(self.trie): (0.0, self.trie, "")}
        for o in token:
            after: dict[tuple[int, str], tuple[float, dict, str]] = {}

            def put(cost: float, node: dict, last: str) -> None:
                k = (id(node), last)
                if k not in after or cost < after[k][0]:
                    after[k] = (cost, node, last)

            for cost, node, last in states.values():
                for c, extra in self._readings(o):
                    if c in node and c != "$":
                        put(cost + extra, node[c], c)
                    if c == last:
                        put(cost + extra + COST["repeat"], node, last)
                if o in SEPARATORS:
                    put(cost + self._dropped(o), node, last)
            states = after
            if not states:
                return math.inf, None
        ends = [(cost, node["$"]) for cost, node, _ in states.values() if "$" in node]
        cost, word = min(ends, default=(math.inf, None))
        return cost + COST["word"], word

    def _steps(self) -> np.ndarray:
        """Costs of each letter or the end after each context, by number; made when a token needs it."""
        if self.table is None:
            n = len(SIGNS) ** (ORDER - 1)
            self.table = np.full((n, len(SIGNS)), -math.log(0.02 / 0.54))
            for context, total in self.contexts.items():
                self.table[self._number(context)] = -math.log(0.02 / (total + 0.54))
            for run, seen in self.runs.items():
                self.table[self._number(run[:-1]), SIGNS.index(run[-1])] = -math.log((seen + 0.02) / (self.contexts[run[:-1]] + 0.54))
        return self.table

    @staticmethod
    def _number(context: str) -> int:
        n = 0
        for c in context:
            n = n * len(SIGNS) + SIGNS.index(c)
        return n

    def _spelled(self, token: str) -> float:
        """The cost of the cheapest spelling under the character model: Viterbi over all contexts, none left out."""
        if token.count("*") > 1:  # stars make nearly every context possible
            return self._spelled_widely(token)
        states = {("_" * (ORDER - 1), ""): 0.0}
        for o in token:
            after: dict[tuple[str, str], float] = {}
            for (context, last), cost in states.items():
                options = [((context[1:] + c, c), cost + extra + self._step(context, c)) for c, extra in self._readings(o)]
                if o in SEPARATORS or last == o:
                    options.append(((context, last), cost + (self._dropped(o) if o in SEPARATORS else COST["repeat"])))
                for k, c in options or [((context, last), cost + COST["odd"])]:
                    if c < after.get(k, math.inf):
                        after[k] = c
            states = after
        return min(cost + self._step(context, "_") for (context, _), cost in states.items())

    def _spelled_widely(self, token: str) -> float:
        steps, width = self._steps(), len(SIGNS)
        cost = np.full(width ** (ORDER - 1), np.inf)
        cost[self._number("_" * (ORDER - 1))] = 0.0
        lasts = np.arange(len(cost)) % width
        for o in token:
            after = np.full(len(cost), np.inf)
            readings = self._readings(o)
            for c, extra in readings:
                i = SIGNS.index(c)
                best = (cost + extra + steps[:, i]).reshape(width, -1).min(axis=0)  # the oldest letter of the context falls away
                after[i::width] = np.minimum(after[i::width], best)
            if o in SEPARATORS:
                after = np.minimum(after, cost + self._dropped(o))
            elif o in SIGNS:
                after = np.where(lasts == SIGNS.index(o), np.minimum(after, cost + COST["repeat"]), after)
            elif not readings:
                after = cost + COST["odd"]
            cost = after
        return float((cost + steps[:, SIGNS.index("_")]).min())

    @staticmethod
    def _coded(token: str) -> float:
        return COST["code"] + sum(COST["digit"] if c.isdigit() else COST["letter"] for c in token if c.isalnum())

    @lru_cache(maxsize=100_000)
    def word(self, token: str) -> str:
        """The intended word of a token in lower case, or the token itself where a listed word isn't the best reading."""
        listed, word = self._listed(token)
        if word is None or token == word:
            return token
        if _CODES.match(token):
            # a digit of two readings leaves the word more in doubt: p19 is a code, p1g and a55 are words
            doubt = sum(math.log(len(LEET.get(c, "."))) for c in token if c.isdigit())
            return word if listed + doubt <= self._coded(token) else token
        return word if listed <= self._spelled(token) + 2.0 else token

    def text(self, lower: str) -> str:
        """A text in lower case with its obfuscated listed words restored; other tokens stay as they are."""
        lower = _ZERO_WIDTH.sub("", lower)

        def put(m: re.Match) -> str:
            token = m.group(0)
            bare = token.rstrip("!")
            best = self.word(bare)
            if best == bare and bare[1:2] == " " == bare[3:4]:  # an article or pronoun before a spaced word: "a m o r o n"
                for skip in (2, 4):
                    if (inner := self.word(bare[skip:])) != bare[skip:]:
                        return bare[:skip] + inner + token[len(bare) :]
            return best if best != bare else (self.word(token) if bare != token and not _CODES.match(bare) else token)

        return SUSPICIOUS.sub(put, lower)

    def doubled(self, word: str) -> str:
        """A word with a doubled letter that is a listed word but for doubling, as that word."""
        return self.collapsed.get(re.sub(r"(.)\1+", r"\1", word), word) if word not in self.words else word


_DOUBLED = re.compile(r"(?<![\w])(?=[a-z]{5,}(?![\w]))[a-z]*?([a-z])\1[a-z]*")


#: Words so common that a fragment made of them sorts out few sentences, and the strings that a part of a pattern is spelled out to.
_PLAIN = frozenset("a all an and are be by for from get go he her him his i in into is it like me my not of off on or out people that the their them they this to u us was we what will with women men you your".split())
_MOST_FRAGMENTS = 5_000


#: A word's edge in a fragment.
EDGE = "\0"


def _often(fragments: set[str]) -> float:
    """A rough measure of how many sentences hold one of the fragments."""
    return sum(1.0 if all(w in _PLAIN for w in f.replace(EDGE, "").split()) else 4.0 ** -len(f) for f in fragments)


def _literals(nodes) -> tuple[set[str] | None, set[str] | None]:
    """(all strings that a parsed pattern matches, if they are few; else None and strings one of which is in all it matches, if there are such)."""
    runs: list[set[str]] = []
    run, whole = {""}, True

    def close() -> None:
        nonlocal run
        runs.append(run)
        run = {""}

    for op, arg in nodes:
        name, every, some = str(op), None, None
        if name in ("AT", "ASSERT", "ASSERT_NOT"):
            every = {EDGE if str(arg) == "AT_BOUNDARY" else ""}
        elif name == "LITERAL":
            every = {chr(arg)}
        elif name == "IN" and all(str(o) == "LITERAL" for o, _ in arg):
            every = {chr(c) for _, c in arg}
        elif name == "SUBPATTERN":
            every, some = _literals(arg[3])
        elif name == "BRANCH":
            parts = [_literals(p) for p in arg[1]]
            if all(e is not None for e, _ in parts):
                every = set().union(*(e for e, _ in parts))
            elif all(e is not None or s is not None for e, s in parts):
                some = set().union(*(s if e is None else e for e, s in parts))
        elif name == "MAX_REPEAT":
            every, some = _literals(arg[2])
            if arg[:2] == (0, 1) and every is not None:
                every = every | {""}
            elif arg[0] == 0:
                every, some = None, None
            elif arg[:2] != (1, 1):
                every, some = None, some if every is None else every
        if every is None or len(every) > _MOST_FRAGMENTS:
            whole = False
            close()
            runs.append(some if every is None else every) if every or some else None
        elif len(run) * len(every) > _MOST_FRAGMENTS:
            whole = False
            close()
            run = every
        else:
            run = {a + b for a in run for b in every}
    if whole:
        return run, None
    close()
    # blanks at the ends are left out: a benign phrase beside the fragment may have held them
    held = [h for r in runs if (h := {f.strip() for f in r}) and not any(f.strip(EDGE + " ") == "" for f in h)]
    return None, min(held, key=_often, default=None)


def fragments(pattern: re.Pattern) -> set[str]:
    """Strings one of which is in everything that the pattern matches."""
    every, some = _literals(re._parser.parse(pattern.pattern))
    out = {f.strip() for f in every} if every is not None else some
    if not out or any(f.strip(EDGE + " ") == "" for f in out):
        raise ValueError(f"no fragments: {pattern.pattern[:60]}")
    return out


#: Bytes of a text as the automaton reads them: everything in ASCII but letters, digits and underscores is a blank.
_BYTES = bytes(b if b >= 128 or chr(b).isalnum() or chr(b) == "_" else 32 for b in range(256))


def _read(text: str) -> str:
    return text.encode(errors="replace").translate(_BYTES).decode("latin-1")


@lru_cache(maxsize=1)
def triggers() -> tuple[str, ...]:
    """Strings one of which is in every sentence that any cue can match, as the automaton reads it with a blank at either end; derived from the cue patterns."""
    found: set[str] = set()
    for category, _, pattern in _cues():
        found |= min(map(fragments, pattern), key=_often) if category == "hate" else fragments(pattern)
    out = set()
    for f in found:
        parts = f.split(EDGE)
        t = parts[0]
        for before, after in zip(parts, parts[1:]):
            edge = (before + after).isascii() and not (t.endswith(" ") or after.startswith(" "))  # beside others an edge may be none in bytes
            t += (" " if edge else "") + after
        out.add(_read(t))
    return tuple(sorted(out))


@lru_cache(maxsize=1)
def finder():
    """Whether a text holds a trigger, as a function of the text."""
    try:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for t in triggers():
            automaton.add_word(t, 1)
        automaton.make_automaton()
        return lambda text: next(automaton.iter(f" {_read(text)} "), None) is not None
    except ImportError:  # slower, same result
        pattern = re.compile("|".join(map(re.escape, triggers())))
        return lambda text: pattern.search(f" {_read(text)} ") is not None


@lru_cache(maxsize=1)
def signs() -> tuple[str, ...]:
    """Expressions for automata without look-around, one of which every text matches that may be restored or hold a listed word with letters doubled."""
    sep, one, letter = r"[ .\-_·~/*]", "[a-z0-9@$!*]", "[a-z]"
    spaced = "|".join(f"{a}{sep}{b}{sep}{c}" for a, b, c in ((letter, one, one), (one, letter, one), (one, one, letter)))
    doubled = "|".join(sorted({"".join(c + "+" for c in w) for w in Restorer({}).collapsed if len(w) > 2}))
    leet = r"[a-z][@$!|*+€#^%0-9]|[@$!|*+€#^%0-9][a-z]"
    return leet, "|".join(c * 3 for c in LETTERS), f"(?:^|\\W)(?:{spaced})", rf"\b(?:{doubled})\b", "[\u200b\u200c\u200d\u2060\ufeff\u00ad]"


def suspects(texts: pd.Series) -> np.ndarray:
    """Which texts may hold a cue, as they are or restored, so that only those are taken apart."""
    import pyarrow as pa
    import pyarrow.compute as pc

    lower = pc.utf8_lower(pa.array(texts, pa.string(), from_pandas=True))
    out = np.zeros(len(lower), bool)
    for sign in signs():
        out |= pc.fill_null(pc.match_substring_regex(lower, sign), False).to_numpy(zero_copy_only=False)
    rest = np.flatnonzero(~out)
    triggered = finder()
    out[rest] = [t is not None and triggered(t) for t in lower.take(pa.array(rest)).to_pylist()]
    return out


def _cues() -> list[tuple[str, str, object]]:
    fill = {"insults": "|".join(L.INSULTS), "weak": "|".join(L.WEAK_INSULTS), "scorn": "|".join(L.SCORN), "roles": L.ROLES}
    out: list[tuple[str, str, object]] = [("abuse", k, re.compile(p.format(**fill))) for k, p in L.ABUSE.items()]
    out += [("hate", k, (re.compile(rf"(?:\b|(?<=[^a-z])){g}"), re.compile(d))) for k, (g, d) in L.HATE.items()]
    return out + [("sexual", k, re.compile(p)) for k, p in L.SEXUAL.items()]


#: Cells of hashed runs of one and two words in the learned part, and the variance of its weights' prior: small, as samples are few.
CELLS, SPREAD = 1 << 13, 0.3


def grams(sentence: str) -> np.ndarray:
    """Cells of a restored sentence's words and pairs of words, each once; numbers count as one."""
    words = re.findall(r"[^\W\d_]+|\d+", re.sub(r"\d[\d.,:]*", "0", sentence))
    runs = {*words, *(f"{a} {b}" for a, b in zip(words, words[1:]))}
    return np.array(sorted({zlib.crc32(r.encode()) % CELLS for r in runs}), np.int64)


class Scorer:
    """A sentence to a probability for each category: a logistic model over cues and over hashed runs of its words, its weights fitted on labelled samples."""

    def __init__(self, counts: dict[str, float], weights: dict[str, dict[str, float]] | None = None, learned: dict[str, np.ndarray] | None = None):
        self.restore = Restorer(counts)
        self.cues = _cues()
        self.benign = re.compile(L.BENIGN)
        #: Where no sample speaks, a cue weighs 5 against a bias of -3, and a word nothing.
        self.weights = weights or {c: {"": -3.0} | {k: 5.0 for cat, k, _ in self.cues if cat == c} for c in CATEGORIES}
        self.learned = learned or {c: np.zeros(CELLS) for c in CATEGORIES}
        self.triggered = finder()

    def _undoubled(self, sentence: str) -> str:
        return _DOUBLED.sub(lambda m: self.restore.doubled(m.group(0)), sentence)

    def suspected(self, sentence: str) -> bool:
        """Whether a cue may match a restored sentence, as it is or with doubled letters undone. No cue matches any other sentence."""
        return self.triggered(sentence) or ((s := self._undoubled(sentence)) != sentence and self.triggered(s))

    def found(self, sentence: str) -> dict[str, set[str]]:
        """Cues by category in a restored sentence. Benign phrases are blanked first; an insult inside an attack on a group is no abuse of its own."""
        s = self.benign.sub(" . ", sentence)
        s = self._undoubled(s)
        out: dict[str, set[str]] = {c: set() for c in CATEGORIES}
        for category, name, pattern in self.cues:
            if category == "hate":
                if pattern[0].search(s) and pattern[1].search(s):
                    out["hate"].add(name)
            elif pattern.search(s):
                out[category].add(name)
        if out["hate"]:
            out["abuse"] = set()
        return out

    def chance(self, category: str, cues: set[str], cells: np.ndarray | None = None) -> float:
        w = self.weights[category]
        said = self.learned[category][cells].sum() / math.sqrt(len(cells)) if cells is not None and len(cells) else 0.0
        return 1 / (1 + math.exp(-(w[""] + sum(w.get(c, 0.0) for c in cues) + said)))

    def sentences(self, text: str) -> list[str]:
        """Sentences of a restored text; a bare question of up to three words ("Islanders?") belongs to what is said of it."""
        out: list[str] = []
        for s in _SENTENCE.split(self.restore.text(text.lower())):
            if out and out[-1].endswith("?") and len(out[-1].split()) <= 3:
                out[-1] += " " + s
            elif s:
                out.append(s)
        return out

    def score(self, text: str | None) -> dict[str, float]:
        """The highest chance of any sentence by category; 0 for null and blank texts and where no cue is found. Whole texts are read."""
        best = dict.fromkeys(CATEGORIES, 0.0)
        for s in self.sentences(text) if text else ():
            if self.suspected(s):
                cells = grams(s)
                for c, cues in self.found(s).items():
                    if cues:
                        best[c] = max(best[c], self.chance(c, cues, cells))
        return best

    def fit(self, texts: list[str], labels: list[str], prior: float = 1.0, steps: int = 200) -> None:
        """Maximum a posteriori weights: normal priors around the starting weights hold cues and words that the samples don't show.

        A labelled text speaks by its sentence of most cues, a text of no category by all its sentences.
        """
        rows: list[tuple[str, dict[str, set[str]], str]] = []
        for text, label in zip(texts, labels):
            seen = [(s, self.found(s) if self.suspected(s) else dict.fromkeys(CATEGORIES, set())) for s in self.sentences(text)]
            if label in CATEGORIES and seen:
                seen = [max(seen, key=lambda x: len(x[1][label]))]
            rows += [(s, f, label) for s, f in seen]
        words = np.zeros((len(rows), CELLS))
        for i, (s, _, _) in enumerate(rows):
            cells = grams(s)
            words[i, cells] = 1 / math.sqrt(max(1, len(cells)))
        for c in CATEGORIES:
            names = list(self.weights[c])
            x = np.hstack([np.array([[1.0] + [float(n in f[c]) for n in names[1:]] for _, f, _ in rows]), words])
            y = np.array([1.0 if lab == c else 0.0 for _, _, lab in rows])
            start = np.r_[[self.weights[c][n] for n in names], np.zeros(CELLS)]
            spread = np.r_[np.full(len(names), prior), np.full(CELLS, SPREAD)]
            w = start.copy()
            for _ in range(steps):
                p = 1 / (1 + np.exp(-x @ w))
                w -= 0.02 * (x.T @ (p - y) + (w - start) / spread)
            self.weights[c], self.learned[c] = dict(zip(names, w.tolist())), w[len(names) :]


def train(documents: DataFrame, samples: DataFrame, max_samples: int = 10_000) -> Scorer:
    """A scorer whose character model is counted over all documents and whose weights are fitted on the distinct labelled
    samples; `max_samples` bounds the labelled rows that come to the driver, smallest hash first."""
    scorer = Scorer(character_counts(documents, "text"))
    rows = samples.where(F.col("text").isNotNull() & F.col("category").isNotNull()).select("text", "category").distinct()
    rows = rows.orderBy(F.xxhash64("text", "category"), "text", "category").limit(max_samples).collect()
    if rows:
        scorer.fit([r.text for r in rows], [r.category for r in rows])
    return scorer


def scores(documents: DataFrame, samples: DataFrame, id_col: str = "doc_id", text_col: str = "text", *keep: str) -> DataFrame:
    """(id, *keep, abuse, hate, sexual, score): the chance of each category in a text, and the highest of them.

    One row per document as given; texts are restored and scored whole, one Arrow batch after the other. Null, empty and
    blank texts score 0.
    """
    trained = train(documents.select(F.col(text_col).alias("text")), samples)
    shared = documents.sparkSession.sparkContext.broadcast((trained.restore.runs, trained.weights, trained.learned))

    @F.pandas_udf("abuse double, hate double, sexual double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(*shared.value)
        for texts in batches:
            out = np.zeros((len(texts), len(CATEGORIES)))
            for i in np.flatnonzero(suspects(texts)):
                out[i] = list(scorer.score(texts.iloc[i]).values())
            yield pd.DataFrame(out, columns=list(CATEGORIES))

    rows = documents.select(F.col(id_col), *keep, score(F.col(text_col)).alias("_p"))
    return rows.select(id_col, *keep, "_p.*").withColumn("score", F.greatest(*CATEGORIES))


def found(documents: DataFrame, samples: DataFrame, id_col: str = "doc_id", threshold: float = 0.5) -> DataFrame:
    """(id, category) of the texts whose chance for a category is `threshold` or more."""
    rows = scores(documents, samples, id_col)
    each = F.array(*[F.struct(F.lit(c).alias("category"), F.col(c).alias("p")) for c in CATEGORIES])
    return rows.select(id_col, F.inline(each)).where(F.col("p") >= threshold).select(id_col, "category").distinct()


def rates(documents: DataFrame, samples: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(source, documents, abuse_rate, hate_rate, sexual_rate, any_rate) by source; texts without a source form the null row."""
    rows = written(scores(documents, samples, "doc_id", "text", "source")).dropDuplicates(["doc_id"])
    rate = lambda c: F.avg((F.col(c) >= threshold).cast("double"))
    return rows.groupBy("source").agg(F.count("*").alias("documents"), *[rate(c).alias(f"{c}_rate") for c in CATEGORIES], rate("score").alias("any_rate"))
