import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from mediasift.functions import text as X
from mediasift.operators import containment
from mediasift.operators.claims import admitted, claims, clauses, keep_first, provenance, resolved_source, split_sentences

WORDS = "the Dr. Prof. Jane Doe acquired U.S. e.g. 3.5% 10 2. 5 Ends! really? and employs while Acme Inc. Corp lower Upper $5 million euros in 1999 London a. b. plans Mr. ... x, ;St. Company The Paris Summit".split()


def texts(n=150, seed=3):
    r = random.Random(seed)
    return [" ".join(r.choice(WORDS) for _ in range(r.randrange(0, 25))) for _ in range(n)] + ["", "One.", "no end", "A. B. C went to Washington. He won!", "It cost 3. 5 euros. Yes", "Ends... And more"]


def split(text):
    """Sentences by the rule, word by word."""
    out, start, at = [], 0, 0
    words = text.split(" ") if text else []
    for i, w in enumerate(words):
        end = at + len(w)
        last = i == len(words) - 1
        stop = last
        if not last and w and w[-1] in ".!?":
            nxt = words[i + 1]
            token = w.lower().strip(" ,;:")
            short = token in X.ABBREVIATIONS or re.match(r"^[a-z](\.[a-z])+\.?$", token) or re.match(r"^[a-z]\.$", token)
            number = len(w) > 1 and w[-1] == "." and w[-2].isdigit() and nxt[0].isdigit()
            stop = not number and not short and not nxt[0].islower()
        if stop:
            out.append((text[start:end], start, end))
            start = end + 1
        at = end + 1
    return out


def test_sentences(spark):
    own = [t for t in texts()]
    df = spark.createDataFrame(list(enumerate(own)), "media_id long, text string")
    got = {}
    for r in split_sentences(df).orderBy("media_id", "sentence_index").collect():
        got.setdefault(r.media_id, []).append((r.sentence, r.start_char, r.end_char))
    assert got == {i: split(t) for i, t in enumerate(own) if t}
    assert [r.n for r in split_sentences(df, 1).groupBy("media_id").agg(F.count("*").alias("n"), F.max("truncated").alias("t")).collect()].count(1) == len(got)


def spans(text):
    found = []
    for k, (label, pattern) in enumerate(X.ENTITIES):
        found += [(m.start(), m.start() - m.end(), k, m.end(), m[0], label) for m in re.finditer(pattern, text)]
    kept, until = [], -1
    for s, _, _, e, t, label in sorted(found):
        if s >= until:
            kept.append((t, label, X.LABELS[label], s, e))
            until = e
    return kept


def test_entities(spark):
    own = texts(200, 5) + ["The United Nations met Dr. Ann Lee in May 5th, 2020 about $1.5 billion", "25% of 30 people", "$5 kids", "The Big Apple Corp. of Acme & Sons Inc", "CEO Satya Nadella visited the Paris Climate Summit"]
    df = spark.createDataFrame(list(enumerate(own)), "media_id long, text string")
    got = {r.media_id: [tuple(e) for e in r.e] for r in df.select("media_id", X.entities(F.col("text")).alias("e")).collect()}
    assert got == {i: spans(t) for i, t in enumerate(own)}


def test_normal_form(spark):
    own = ["\x07a  b\t\nc ", "ﬁne １２ ①", None, "", "é"]
    got = [r[0] for r in spark.createDataFrame(list(enumerate(own)), "i int, t string").orderBy("i").select(X.normalized(F.col("t"))).collect()]
    clean = lambda t: re.sub(r"\s+", " ", unicodedata.normalize("NFKC", re.sub(X.CONTROL, "", t or ""))).strip()
    assert got == [clean(t) for t in own]


def test_classes(spark):
    own = {
        "Is it true?": ("QUESTION", 0.95), "What if prices rise": ("QUESTION", 0.92), "Short one.": ("NON_CLAIM", 0.9), "Click here to join.": ("NON_CLAIM", 0.88), "I think it works well.": ("OPINION", 0.88),
        "Acme acquired Initech for 5 euros.": ("FACTUAL_CLAIM", 0.99), "The sky seems rather calm.": ("FACTUAL_CLAIM", 0.82), "": ("NON_CLAIM", 0.99), "What is it now": ("FACTUAL_CLAIM", 0.82),
    }
    rows = spark.createDataFrame([(t,) for t in own], "t string").select("t", X.classified(F.col("t"), F.lit(True)).alias("x")).collect()
    assert {r.t: tuple(r.x) for r in rows} == own


def test_compound_claims_share_their_subject(spark):
    df = spark.createDataFrame([(1, "Company X acquired Company Y in 2024 and employs 10,000 people. Is it so?")], "media_id long, text string")
    got = claims(df).orderBy("sentence_index", "part").collect()
    assert [(r.claim_text, r.subject, r.action, r.value, r.claim_type) for r in got] == [
        ("Company X acquired Company Y in 2024", "Company X", "acquired", "Company Y in 2024", "FACTUAL_CLAIM"),
        ("Company X employs 10,000 people.", "Company X", "employs", "10,000 people.", "FACTUAL_CLAIM"),
        ("Is it so?", "Is", "it", "so?", "QUESTION"),
    ]
    assert [r.entity_type for r in got] == ["DATE", "QUANTITY", "GENERAL"] and len({r.claim_hash for r in got}) == 3
    assert claims(df.limit(0)).count() == 0 and clauses(spark.createDataFrame([("a b", "OPINION")], "sentence string, claim_type string")).count() == 1


def test_the_bound_on_sentences_is_a_choice_and_shown(spark):
    df = spark.createDataFrame([(1, "Acme won again. " * 700), (2, "One. Two."), (3, None), (4, " ")], "media_id long, text string")
    for most, n, cut in ((None, 700, False), (X.MOST_SENTENCES, 500, True), (700, 700, False)):
        rows = claims(df, most).collect()
        assert [sum(r.media_id == m for r in rows) for m in (1, 2, 3, 4)] == [n, 2, 0, 0]
        assert {r.truncated for r in rows if r.media_id == 1} == {cut} and not any(r.truncated for r in rows if r.media_id == 2)


def test_one_pass_gives_what_the_steps_give(spark):
    own = texts(80, 9)
    df = spark.createDataFrame(list(enumerate(own)), "media_id long, text string")
    read = {r.media_id: r.r for r in df.select("media_id", X.read_text(F.col("text")).alias("r")).collect()}
    for i, t in enumerate(own):
        t = X.plain_form(t)
        assert [(s.sentence, s.start_char, s.end_char) for s in read[i].found] == split(t)
        for s in read[i].found:
            assert [(e.start_char, e.end_char) for e in s.inside] == [(a, b) for *_, a, b in spans(t) if a >= s.start_char and b <= s.end_char]


def test_provenance_takes_the_first_piece(spark):
    said = spark.createDataFrame([(1, 0, "Prices ROSE."), (1, 1, "Nothing like it"), (2, 0, "Prices rose.")], "media_id long, sentence_index int, claim_text string")
    pieces = spark.createDataFrame([(1, 0, "other"), (1, 1, "so prices rose. then"), (1, 2, "rose"), (2, 5, "")], "media_id long, seg int, text string")
    assert {tuple(r) for r in provenance(said, pieces, "seg").collect()} == {(1, 0, 1), (2, 0, 5)}


@pytest.mark.parametrize("few", [64, 0])
def test_provenance_is_that_of_all_pairs(spark, monkeypatch, few):
    monkeypatch.setattr(containment, "FEW", few)  # 0: every medium through the index
    r = random.Random(11)
    words = "a an Rose prose rOses rising 3.5% é Éa the  of to market prices".split(" ")
    text = lambda most: "".join(r.choice(words) + r.choice([" ", " ", " ", "", "  "]) for _ in range(r.randrange(most)))
    pieces = [(m, k, text(14)) for m in range(4) for k in range(60)] + [(0, 90, ""), (1, 91, "a"), (1, 92, "ro"), (2, 93, " "), (3, 94, None), (None, 1, "rose")]
    said = []
    for m in range(5):
        for k in range(60):
            t = r.choice([x for x in pieces if x[2]])[2] if k % 2 else text(10)
            at = r.randrange(len(t)) if t else 0
            said.append((m, k, t[at : at + r.choice([1, 2, 3, 5, 20, 60])].upper() if k % 3 else t))
    said += [(0, 100, ""), (2, 101, None), (3, 102, "A"), (3, 102, "market"), (None, 5, "rose")]
    want = {}
    for m, k, t in said:
        found = [i for n, i, p in pieces if n == m and m is not None and None not in (t, p) and (t.lower() in p.lower() or p.lower() in t.lower())]
        if found:
            want[m, k] = min(found + [want.get((m, k), 10**9)])
    got = provenance(spark.createDataFrame(said, "media_id long, sentence_index int, claim_text string"), spark.createDataFrame(pieces, "media_id long, seg int, text string"), "seg")
    assert {(x.media_id, x.sentence_index): x.seg for x in got.collect()} == want


def test_candidates_of_one_large_medium_are_few(spark):
    r = random.Random(2)
    words = [f"word{i}" for i in range(400)]
    longer = spark.createDataFrame([(1, " ".join(r.choice(words) for _ in range(20))) for _ in range(3000)], "m long, l string").distinct().cache()
    shorter = longer.limit(1500).select("m", F.expr("substr(l, 3, 60)").alias("s")).distinct()
    made = containment._candidates(shorter, longer, containment._wanted("s"), containment._listed("l"))
    assert made.count() < 10 * 1500 and containment.held_pairs(shorter, longer).select("s").distinct().count() == shorter.count()


@pytest.mark.parametrize("t, o, asked, want", [("a", "b", "OCR", ("b", "OCR")), ("a", "b", None, ("a\n\nb", "COMBINED")), ("a", " ", "OCR", ("a", "TRANSCRIPT")), (None, "b", "TRANSCRIPT", ("b", "OCR")), (None, "", None, ("", "DIRECT_TEXT"))])
def test_sources(spark, t, o, asked, want):
    df = spark.createDataFrame([(t, o, asked)], "t string, o string, a string")
    assert tuple(df.select(resolved_source(F.col("t"), F.col("o"), F.col("a")).alias("x")).first().x) == want


def test_guard_and_first(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "abc")], "i int, text string")
    assert [r.status for r in admitted(df, 2).orderBy("i").collect()] == ["REJECTED", "COMPLETED", "REJECTED"]
    rows = spark.createDataFrame([(1, "h", 5), (1, "h", 2), (2, "h", 1)], "m int, h string, y int")
    assert {tuple(r) for r in keep_first(rows, ["m", "h"], F.col("y")).collect()} == {(1, "h", 2), (2, "h", 1)}


def test_entities_are_those_of_plain_scans():
    """Families are tried only at words with which they may begin; here against every place."""
    families = [(label, re.compile(p)) for label, p in X.ENTITIES]
    r = random.Random(12)
    words = (
        "The the Microsoft European Union UN Ministry of Health Dr. Prof. Jane Doe O'Neil Prime Minister President New York Delhi Paris Acme Inc. & Sons A&B Summit Cup Games Act May may 5th, 2020 in 1999 IN iN year $5 €3,5 million £ 7 ¥9k 10 dollars 25 percent 3.5% people "
        "12abc x-Paris (London) U.S.Paris _Mars Mars_ 1987 Jan 3 sept jAN january 31 CEO Satya Bank England ٣ É Élan On 20 2020 , . - ' ! last Last Week yesterday monday İn ın ſunday mOnday TODAY"
    ).split(" ")
    for k in range(6000):
        t = " ".join(r.choice(words[: None if k % 3 else -9]) for _ in range(r.randrange(14)))
        t = t.replace(" ", r.choice([" ", " ", "", "-", "("]), 1)
        assert [(a, b, label) for _, label, _, a, b in spans(t)] == X.entity_spans(t, families)
