"""Broken pairs, scans, splitting and content scores on small tables with known answers."""

import re

import pytest
from pyspark.sql import functions as F

from clauseworks.llm import abuse, pairs, scans, split


# --- pairs -----------------------------------------------------------------------------------------------------

FULL = ["The holder files it within 30 days of the inspection visit.", "It comes to Taka 500 for each site plus two percent of gross receipts.", "The term is 7 years from the end of the quarter."]


def found_pairs(spark, rows):
    df = spark.createDataFrame([("t", str(i), q, a) for i, (q, a) in enumerate(rows)], "pair_table string, pair_key string, question string, answer string")
    return {int(r.pair_key): r.defect for r in pairs.defects(df.withColumn("rule", df.answer).withColumn("body", df.answer)).collect()}


def test_pair_defects_of_every_type(spark):
    q = "When must the revenue statement be filed by the holder of a licence?"
    rows = [(q, a) for a in FULL for _ in range(6)]
    n = len(rows)
    rows += [
        (q, None), (q, "  \n"), (q, "<p></p>"), (q, "N/A"), (None, "None"),
        (q, q), (q, "You asked: " + q), (q, q.upper()), (q, q + " Within 30 days of the inspection visit."),
        (q, "I'm sorry, but I can't answer that."), (q, "That information is not available to me. Please provide more context."), (q, "It cannot be assigned; the Board refuses every such request."),
        (q, "ধারা ৬ অনুযায়ী কমিশন ৮ মাস পরপর পরীক্ষা করবে।"), (q, "Niyom bhangle 500 taka jorimana hobe."), (q, "The heading reads “নিরাপত্তা পরিকল্পনা”, meaning the plan."), ("ফি কত?", "ফি ৫০ টাকা।"), ("ফি কত?", "The fee is 50 a year."), (q, "Bei Verzug wird ein Bußgeld fällig."),
        (q, "The holder files it within 30 days of the inspec"), (q, "It comes to Taka 500 for each site plus"), (q, "The term is 9 years from the end of the quarter"), (q, "The term is 7 years from the end of…"),
    ]
    got = found_pairs(spark, rows)
    want = ["empty"] * 5 + ["copied_question"] * 3 + [None] + ["refusal"] * 2 + [None] + ["other_language"] * 2 + [None, None, "other_language", "other_language"] + ["truncated"] * 2 + [None, "truncated"]
    assert [got.get(n + i) for i in range(len(want))] == want
    assert not any(i in got for i in range(n))


PAYS = "The operator must pay the annual licence"


def truncated_keys(spark, rows, **how):
    df = spark.createDataFrame([("t", str(i), "What must the operator pay to the commission?", a) for i, a in enumerate(rows)], "pair_table string, pair_key string, question string, answer string")
    return {int(r.pair_key) for r in pairs.defects(df, **how).where("defect = 'truncated'").collect()}


def test_a_longer_neighbour_makes_an_answer_truncated_whatever_its_tail(spark):
    rows = [PAYS, PAYS + " fee to the commission within thirty days of the invoice."] + [f"Office {chr(97 + i)} keeps a copy of the annual licence." for i in range(30)]
    assert truncated_keys(spark, rows) == {0}
    assert truncated_keys(spark, rows, neighbours=False) == set()
    # the same words, finished elsewhere, are an answer
    assert truncated_keys(spark, [*rows, PAYS + "."]) == set()


def test_neighbouring_runs_of_last_words_show_a_cut(spark):
    rows = ["Every holder of a permit shall keep the regis", "A carrier may ask for the", "A carrier may lodge it with the board"]
    rows += [f"Office {chr(97 + i)} shall keep the register of towers, with the board." for i in range(8)]
    assert truncated_keys(spark, rows) == {0, 1}
    assert truncated_keys(spark, rows, neighbours=False) == set()
    assert truncated_keys(spark, ["The fee is due on the qxzw", *rows[3:]]) == set()  # no neighbour goes on there


def test_answers_stopping_at_a_length_limit_are_truncated(spark):
    full = "clause {} tells that the holder pays a fee for each mast it puts up and for each site that it rents"
    cut = [full.format(chr(97 + i // 8) + chr(97 + i % 8))[:78] for i in range(40)]
    assert truncated_keys(spark, cut, neighbours=False) == set(range(40))
    assert truncated_keys(spark, [c[: 38 + i] for i, c in enumerate(cut)], neighbours=False) == set()


def test_pairs_of_an_empty_table_and_repeated_rows(spark):
    assert found_pairs(spark, []) == {}
    df = spark.createDataFrame([("t", "1", "q?", None)] * 3, "pair_table string, pair_key string, question string, answer string")
    assert pairs.defects(df).count() == 1
    assert pairs.rates(df).collect()[0].rate == 1.0


def test_shortened_versions_agree_with_brute_force(spark):
    words = sorted({"a" * i + c for i in range(1, 9) for c in ("", "b", "bc", "z")} | {"b", "ba", "q"})
    got = {r.body for r in pairs.shortened(spark.createDataFrame([(w,) for w in words], "body string").repartition(5)).collect()}
    assert got == {a for a in words if any(b != a and b.startswith(a) for b in words)}


# --- scans -----------------------------------------------------------------------------------------------------

TITLE = "Rules on Tower Sharing for Small Operators 2020 (RG-0000017)"
CLEAN = "The holder of the licence shall maintain the equipment in working order. Every western operator must publish the outage register and the in-building plan."
SCANNED = "Rules on Tower Sharing for Small Operators\nThe holder of the licence shall mainta-\nin the equiprnent in working order. Every west-\n\n- 12 -\n\nern operator must publish the out¬\nage register and the in-\nbuilding plan, and pay Taka 1,225,00o.\n\nThe holdcr of the licence shall publish it"
SCHEMA = "record_id long, document_name string, subsection_text string, page_numbers array<int>, extra string"


def scan_table(spark):
    rows = [(i, TITLE, CLEAN, None, None) for i in range(10)] + [(100, TITLE, SCANNED, [12, None], "x"), (100, TITLE, SCANNED, [12, None], "x"), (101, None, None, None, None), (102, None, "", [], None), (103, None, "Zone A\n12\nZone B\n13", [12], None)]
    return spark.createDataFrame(rows, SCHEMA)


def test_scan_defects(spark):
    got = {(r.record_id, r.kind, r.fragment) for r in scans.defects(scan_table(spark)).collect()}
    assert got == {
        (100, "header", "Rules on Tower Sharing for Small Operators"), (100, "page_number", "- 12 -"),
        (100, "split_word", "maintain"), (100, "split_word", "western"), (100, "split_word", "outage"), (100, "split_word", "in-building"),
        (100, "misread", "equipment"), (100, "misread", "1,225,000"), (100, "misread", "holder"),
    }


def test_scan_repair_gives_paragraphs(spark):
    got = {r.record_id: r.repaired_text for r in scans.repair(scan_table(spark)).collect()}
    assert got[100] == "The holder of the licence shall maintain the equipment in working order. Every western operator must publish the outage register and the in-building plan, and pay Taka 1,225,000.\n\nThe holder of the licence shall publish it"
    assert got[0] == CLEAN and got[102] == "" and 101 not in got


def test_lost_and_added_blanks_are_decoded(spark):
    text = "The holder ofthe licence shall main\ntain the equip ment in working order. Every western operator must publish theoutage register and the in-\nbuilding plan of the lic\nencc in work ing"
    df = spark.createDataFrame([(i, TITLE, CLEAN + " The plan of the licence.", None, None) for i in range(10)] + [(1000, TITLE, text, [], None)], SCHEMA)
    got = {(r.kind, r.fragment) for r in scans.defects(df).where("record_id = 1000").collect()}
    assert got == {("misread", "of the"), ("split_word", "maintain"), ("misread", "equipment"), ("misread", "the outage"), ("split_word", "in-building"), ("split_word", "licence"), ("misread", "licence"), ("misread", "working")}
    fixed = {r.record_id: r.repaired_text for r in scans.repair(df).collect()}[1000]
    assert fixed == "The holder of the licence shall maintain the equipment in working order. Every western operator must publish the outage register and the in-building plan of the licence in working"


def test_words_with_many_doubtful_places_are_met_by_their_strokes(spark):
    spelled = "intercontinentalinterconnection"
    assert not scans.listed(spelled)
    read = spelled.replace("o", "0", 1).replace("ec", "ee", 1)
    assert scans.misread_places(read, spelled) == 2 and scans.misread_places("modem", "modern") == 1 and scans.misread_places("abc", "xyz") is None
    text = f"The holder of the licence shall maintain the {read} in working order\nand the {spelled[:12]}-\n{read[12:]} too"
    df = spark.createDataFrame([(i, TITLE, CLEAN + f" The {spelled} of the licence.", None, None) for i in range(10)] + [(1000, TITLE, text, [], None)], SCHEMA)
    got = {(r.kind, r.fragment) for r in scans.defects(df).where("record_id = 1000").collect()}
    assert {("misread", spelled), ("split_word", spelled)} <= got
    pairs = spark.createDataFrame([("x" + a + "kp", "x" + b + "kp") for a, b in scans.CONFUSIONS], "a string, b string")
    assert pairs.where(scans.strokes(F.col("a")) != scans.strokes(F.col("b"))).collect() == []


def test_long_lines_and_long_paragraphs_are_read_whole():
    title = "Rules " + " ".join(f"Part{c}" for c in "abcdefghijklmnopqrstuvwxyz") + " on Towers"
    layout = scans.Layout(f"{title}\nthe text goes on\n{'-' * 200} 12 {'-' * 200}\nand on.", title, {12})
    assert layout.kinds == ["header", "content", "page", "content"]
    lines = [(f"line {i} of one sentence that goes on and on without an end,", 0, False) for i in range(300)]
    assert [len(p) for p in scans.paragraphs(lines)] == [300]


def test_paragraphs_are_the_cheapest_of_all(spark):
    import random

    rng = random.Random(5)
    for _ in range(30):
        lines = [(rng.choice(("the words go on", "It ends here.", "(a) an item", "Short.", "a long line that fills the whole width of the page")), rng.choice((0, 0, 0, 1)), False) for _ in range(9)]
        got = scans.paragraphs(lines)
        assert sum(map(len, got)) == 9 and [x for p in got for x in p] == [s for s, _, _ in lines]


def test_scans_of_an_empty_table(spark):
    assert scans.defects(spark.createDataFrame([], SCHEMA)).count() == 0


def test_readings_undo_confusions():
    assert {"wireless", "emergency", "building"} <= {*scans.readings("vvireless"), *scans.readings("ernergency"), *scans.readings("bui1dinq")}
    assert scans.number("4,43s,000") == "4,435,000" and scans.number("10b") is None and scans.number("annex") is None


# --- splitting -------------------------------------------------------------------------------------------------


def level(text, limit):
    for name, p in (("paragraph", r"\n{2,}"), ("line", r"\n"), ("sentence", r"\n|(?<=[.!?।])\s"), ("space", r"\s")):
        if max(map(len, re.split(p, text))) <= limit:
            return name
    return "none"


@pytest.mark.parametrize("limit,overlap", [(40, 8), (25, 0)])
def test_split_levels_and_round_trip(spark, limit, overlap):
    import random

    rng = random.Random(3)
    bits = ["word", "longer-word", "x" * 30, "y" * 60, ".", "! ", "। ", " ", " ", " ", "\n", "\n\n", "\n\n\n", "é", "😀"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(1, 60))) for _ in range(150)] + ["", None, "a" * 500, " " * 90]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(2, texts[2])], "id long, t string")
    got = {r.id: r.boundary for r in split.boundary_levels(df, "id", "t", limit, overlap).collect()}
    assert got.keys() == {i for i, t in enumerate(texts) if t and len(t) > limit}
    plain = [i for i in got if not re.search(r"\s\s", re.sub(r"\n{2,}", "\n", texts[i]).replace("\n", "¶"))]
    assert len(plain) > 20
    assert {i: got[i] for i in plain} == {i: level(texts[i], limit) for i in plain}
    pieces = split.split_pieces(df, "id", "t", limit, overlap).toPandas()
    for i, g in pieces.groupby("id"):
        at = 0
        for r in g.sort_values("piece_no").itertuples():
            own = r.piece[r.overlap_chars :]
            assert len(r.piece) <= limit and r.overlap_chars <= overlap
            assert texts[i][r.start_at : r.start_at + len(own)] == own and texts[i][r.start_at - r.overlap_chars : r.start_at] == r.piece[: r.overlap_chars]
            assert not texts[i][at : r.start_at].strip()
            at = r.start_at + len(own)
        assert not texts[i][at:].strip()


# --- content ---------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def scorer():
    import collections

    words = "the operator shall publish outage register cable committee still letter process fibre connector rule street middle field".split()
    runs = collections.Counter(("___" + w + "_")[i : i + 4] for w in words for i in range(len(w) + 1))
    return abuse.Scorer(dict(runs))


@pytest.mark.parametrize("text,want", [
    ("You stupid M0R0N, drop dead.", {"abuse"}), ("Are you all c.o.c.k.r.o.a.c.h.e.s, or what?", {"abuse"}), ("what a stupid looooser this clerk is", {"abuse"}), ("Listen, p*g, I know where you live.", {"abuse"}),
    ("Migrants are vermin and should be driven out.", {"hate"}), ("Never give a connection to hill people, they are all bastards.", {"hate"}), ("তুই একটা হারামজাদা, তোর মুখ ভেঙে দেব।", {"abuse"}), ("Show me your bare breasts.", {"sexual"}), ("Looking for s3x tonight, I am so h​o​r​n​y.", {"sexual"}),
    ("Kill the hanging process and restart the daemon.", set()), ("The naked fibre pair was exposed.", set()), ("This price is a bloody joke.", set()), ("Operators must block obscene, abusive or hateful messages.", set()), ("Pig iron counterweights hold the tower.", set()), ("যৌন হয়রানির অভিযোগ বিনামূল্যে জানানো যাবে।", set()), (None, set()), ("", set()), ("  \n", set()),
])
def test_content_scores(scorer, text, want):
    assert {c for c, p in scorer.score(text).items() if p >= 0.5} == want


@pytest.mark.parametrize("text,want", [
    ("ONLY A DUMMBASS LIKE YOU COULD BELIEVE THAT.", {"abuse"}), ("I want to feel your tiits.", {"sexual"}), ("You are a morron.", {"abuse"}),
    ("I will cut your throat.", {"abuse"}), ("We will skin you, someone will hunt you and gut you.", {"abuse"}), ("Sod off.", {"abuse"}), ("Naff off!", {"abuse"}), ("Just go die.", {"abuse"}),
    ("Foreigners: gas them.", {"hate"}), ("Refugees deserve the same.", {"hate"}), ("Migrants ought to be thrown out.", {"hate"}),
])
def test_no_sentence_with_a_cue_is_left_out(scorer, text, want):
    assert {c for c, p in scorer.score(text).items() if p >= 0.5} == want


def test_short_leetspeak_is_restored_and_codes_are_kept(scorer):
    leet = {"p0rn": "porn", "c0ck": "cock", "sh1t": "shit", "d1ck": "dick", "t1ts": "tits", "pr1ck": "prick", "tw4t": "twat", "wh0re": "whore", "a55": "ass", "d0g": "dog", "p1g": "pig", "s3x": "sex", "p0rn!": "porn!"}
    assert {w: scorer.restore.text(f"the {w} here") for w in leet} == {w: f"the {leet[w].rstrip('!')} here" for w in leet}
    codes = ["p19", "p16", "d09", "5.3.x", "50(b)", "b2b", "e1", "4g", "stm1", "3rd", "10mb", "rg-0000017", "2019-07-08", "a4", "ipv6", "p2p", "h264", "p19!"]
    assert [scorer.restore.text(f"the {w} here") for w in codes] == [f"the {w} here" for w in codes]
    assert scorer.score("Hot p0rn for all.")["sexual"] >= 0.5 and scorer.score("He pushed his c0ck away.")["sexual"] >= 0.5 and scorer.score("The next page is p19.")["abuse"] == 0


def test_every_alternative_of_the_cues_passes_the_gate(scorer):
    import random

    rng = random.Random(5)

    def made(nodes):
        out = ""
        for op, arg in nodes:
            name = str(op)
            if name == "LITERAL":
                out += chr(arg)
            elif name == "IN":
                o, c = rng.choice(arg)
                out += " " if str(arg[0][0]) == "NEGATE" else chr(c) if str(o) == "LITERAL" else " " if str(c) == "CATEGORY_SPACE" else "q"
            elif name == "BRANCH":
                out += made(rng.choice(arg[1]))
            elif name == "SUBPATTERN":
                out += made(arg[3])
            elif name == "MAX_REPEAT":
                out += "".join(made(arg[2]) for _ in range(rng.randint(arg[0], min(arg[1], arg[0] + 1))))
        return out

    for category, name, pattern in scorer.cues:
        parts = pattern if category == "hate" else (pattern,)
        trees = [re._parser.parse(p.pattern) for p in parts]
        texts = {" ".join(made(t) for t in trees) for _ in range(4000)}
        matched = [t for t in texts if all(p.search(t) for p in parts)]
        assert matched and [t for t in matched if not scorer.suspected(t)] == [], name


def test_content_over_tables(spark, tmp_path):
    docs = spark.createDataFrame([(1, "You pathetic sack of shit.", "a"), (1, "You pathetic sack of shit.", "a"), (2, None, None), (3, "fine " * 50_000 + "kill yourself, idiot", "b")], "doc_id long, text string, source string")
    samples = spark.createDataFrame([(1, "Kill yourself, moron.", "abuse"), (2, "Please hold the line.", "none"), (3, None, None)], "sample_id int, text string, category string")
    assert {(r.doc_id, r.category) for r in abuse.found(docs, samples).collect()} == {(1, "abuse"), (3, "abuse")}
    rates = {r.source: r.any_rate for r in abuse.rates(docs, samples).collect()}
    assert rates == {"a": 1.0, "b": 1.0, None: 0.0}
    assert abuse.found(docs.limit(0), samples.limit(0)).count() == 0


def test_held_out_samples(spark):
    """Weights fitted on half of the labelled samples decide the other half."""
    path = "/root/testdata/sf0.001/review_samples.parquet"
    pytest.importorskip("os").path.exists(path) or pytest.skip("no test tables here")
    rows = spark.read.parquet(path).select("text", "category").distinct().orderBy("text").collect()
    s = abuse.Scorer({})
    s.fit([r.text for r in rows[::2]], [r.category for r in rows[::2]])
    best = lambda t: max(((p, c) for c, p in s.score(t).items()), default=(0, ""))
    right = [(p >= 0.5 and c or "none") == r.category for r in rows[1::2] for p, c in [best(r.text)]]
    assert sum(right) >= 0.95 * len(right)


def test_text_that_no_sample_is_like(spark):
    """Sentences written by hand, by no generator of the test tables, against weights fitted on a few samples."""
    s = abuse.Scorer({})
    s.fit(["You are an idiot and a liar.", "Women are vermin.", "Show me your tits.", "The line is down.", "Please send the bill again."], ["abuse", "hate", "sexual", "none", "none"])
    found = lambda t: {c for c, p in s.score(t).items() if p >= 0.5}
    for text, category in [
        ("You are a waste of oxygen and everyone knows it.", "abuse"), ("Nobody would miss you if you vanished.", "abuse"), ("Hope you get hit by a bus tonight, creep.", "abuse"), ("You are a m o r o n.", "abuse"),
        ("He wished that I drop dead, the jerk.", "abuse"), ("What a complete b@st@rd of a manager!", "abuse"), ("I will find you and break every bone you have, your family too.", "abuse"), ("Your mother should have drowned you, you rat.", "abuse"),
        ("Those left-handed folk should not be allowed to vote.", "hate"), ("Migrants? Scum, the lot of them.", "hate"), ("Refugees ruin our country and must be driven out.", "hate"), ("All gay people belong behind bars.", "hate"),
        ("She took off her clothes and climbed on top of him.", "sexual"), ("He kissed her neck and pulled her dress down.", "sexual"), ("Looking for sex tonight?", "sexual"),
    ]:
        assert found(text) == {category}, text
    for text in [
        "The clerk said the dog was a pig.", "The rule is stupid.", "I hope the line is repaired before it dies again.", "All rural people should be connected.", "The farm keeps a pig, a rat and a dog.", "We hope that you get well soon.",
        "Women and men pay the same fee.", "The naked wire hung from the pole.", "Kill the process and restart it.", "The report on sexual harassment was read.", "He lost the right to appeal.", "Waste of paper is to be avoided.",
    ]:
        assert found(text) == set(), text


def test_decoding_leaves_out_no_reading():
    """The cheapest spelling over all contexts equals a search over all readings."""
    import itertools
    import math
    import random

    rng = random.Random(4)
    counts = {"".join(rng.choice("_abeilort") for _ in range(4)): rng.random() * 5 for _ in range(400)}
    r = abuse.Restorer(counts)

    def brute(token):
        best = math.inf
        options = [[(c, e) for c, e in r._readings(o)] + ([("", r._dropped(o) if o in abuse.SEPARATORS else None)]) for o in token]
        for reading in itertools.product(*options):
            cost, context, last, good = 0.0, "___", "", True
            for (c, e), o in zip(reading, token):
                if c == "":
                    e = e if e is not None else (abuse.COST["repeat"] if last == o else None)
                    if e is None:
                        good = False
                        break
                    cost += e
                else:
                    cost += e + r._step(context, c)
                    context, last = context[1:] + c, c
            if good:
                best = min(best, cost + r._step(context, "_"))
        return best

    for token in ("b1t", "l.o.t", "looo", "a1l0e", "b*t", "r-@t"):
        assert r._spelled(token) == pytest.approx(brute(token)), token
        assert r._spelled_widely(token) == pytest.approx(r._spelled(token)), token


def test_texts_that_the_gate_leaves_out_have_no_cue():
    import pandas as pd

    s = abuse.Scorer({})
    texts = ["The rate of the class is in the document.", "shiiit", "You mooron.", "k i l l yourself", "m0ron", "s​cum", "P.I.G. of a clerk", None, "", "plain words", "ওই ধর্মের লোকেরা নোংরা", "(idiot)", "the lot"]
    held = abuse.suspects(pd.Series(texts))
    assert not any(max(s.score(t).values()) > 0 for t, h in zip(texts, held) if not h)
    assert list(held[:7]) == [False] + [True] * 6 and not held[7:10].any() and held[10] and held[11]


def test_readings_of_many_words_leave_in_frames_of_bounded_size():
    import pandas as pd

    words = [f"w{i}ollicensesilence" for i in range(300)]
    asked = lambda: iter([pd.DataFrame({"word": words, "a": words, "b": words})])
    for made in (scans._proposed, scans._parts, scans._joined, scans._halves):
        frames = list(made(asked()))
        assert all(len(f) <= 20_000 for f in frames) and sum(map(len, frames)) > 0
    whole = pd.concat(scans._parts(asked()))
    want = {(w, i, j, c, s) for w in words[:2] for i in range(len(w)) for j in range(i + 2, len(w) + 1) if j - i < len(w) for c, s in scans.readings(w[i:j], 1).items()}
    assert set(whole[whole["word"].isin(words[:2])].itertuples(index=False, name=None)) == want
