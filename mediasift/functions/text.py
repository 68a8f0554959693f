"""Column functions on claim text: normal form, sentences, entities, classes, triples and clauses.

What walks through a text (normal form, sentence ends, spans of patterns) are small helpers over Arrow batches, linear
in the text; Spark has no normal form, and its regular expressions give no places. Everything about a sentence is a
built-in expression.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache, reduce
from itertools import accumulate

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values.
CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]"
# Words with a full stop that end no sentence.
ABBREVIATIONS = [
    "mr.", "mrs.", "ms.", "dr.", "prof.", "sr.", "jr.", "rep.", "sen.", "gen.", "col.", "gov.", "pres.", "st.", "ave.", "blvd.", "dept.", "u.s.",
    "u.k.", "e.u.", "u.n.", "f.b.i.", "c.i.a.", "i.e.", "e.g.", "inc.", "corp.", "ltd.", "co.", "vs.", "etc.", "approx.", "est.",
]
# Words of opinions.
OPINIONS = [
    "i think", "i believe", "in my opinion", "in our view", "we believe", "i feel", "it seems to me", "personally", "my view is", "my impression is",
    "best", "worst", "terrible", "wonderful", "gorgeous", "horrible", "ugly", "fantastic", "brilliant", "disgusting", "greatest", "sublime", "disgraceful",
    "strongly believe", "undoubtedly better", "clearly superior",
]
# First words of questions.
QUESTION_STARTERS = [
    "what", "why", "how", "who", "whom", "whose", "when", "where", "is", "are", "was", "were", "can", "could", "would", "will", "shall", "should",
    "do", "does", "did", "have", "has", "had",
]
# How questions without a mark begin.
QUESTION_PREFIXES = ["is it", "are there", "can you", "what if", "why would", "who is", "why did", "how can"]
# First words of calls to act.
IMPERATIVES = [
    "click", "subscribe", "look", "see", "watch", "remember", "don't", "do", "listen", "check", "follow", "share", "read", "join", "buy",
]
# Verbs of statements.
VERBS = [
    "announced", "increased", "decreased", "reported", "confirmed", "signed", "voted", "passed", "discovered", "caused", "won", "lost", "visited",
    "stated", "allocated", "approved", "banned", "declined", "launched", "acquired", "employs", "cut", "raised", "built", "invested", "became",
    "elected", "established", "reached", "generated", "produced", "unveiled", "released", "sold", "purchased", "appointed", "resigned", "struck",
    "agreed", "authorized", "found", "filed", "tested", "published",
]
# Verbs that part a subject from its value as well.
AUXILIARIES = [
    "is", "was", "are", "were", "has", "have", "had", "will", "spoke", "cut", "raised", "employs",
]
# Labels of recognisers and what they are called here.
LABELS = {"PERSON": "PERSON", "ORG": "ORG", "GPE": "LOCATION", "LOCATION": "LOCATION", "LOC": "LOCATION", "DATE": "DATE", "TIME": "DATE", "MONEY": "MONEY", "PERCENT": "QUANTITY", "QUANTITY": "QUANTITY", "EVENT": "EVENT", "GENERAL": "GENERAL"}
# Names of months.
MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December|Jan|Feb|Mar|Apr|Jun|Jul|Aug|Sep|Oct|Nov|Dec"
# Fixed values.
#: Patterns of entities with their labels, in the order that decides between equal spans.
ENTITIES = [
    ("MONEY", r"(?i)(?:(?:\$|€|£|¥)\s*\d+(?:[.,]\d+)*(?:\s*(?:billion|million|trillion|thousand|k))?|\b\d+(?:[.,]\d+)*\s*(?:billion|million|trillion)?\s*(?:dollars?|euros?|pounds?|usd|eur|gbp)\b)"),
    ("QUANTITY", r"(?i)\b\d+(?:[.,]\d+)*\s*(?:%|percent|basis points?|bps|positions?|employees?|people|tons?|kg|km|miles?|meters?|units?|jobs?|cases?|votes?|seats?|regions?)\b"),
    ("DATE", rf"(?i)(?:\b(?:{MONTHS})\s+\d{{1,2}}(?:st|nd|rd|th)?(?:\s*,?\s*\d{{4}})?\b|\b(?:Monday|Tuesday|Wednesday|Thursday|Friday|Saturday|Sunday)\b|\b(?:yesterday|today|tomorrow|last year|last month|last week|next year)\b|\b(?:in\s+)?(?:19\d{{2}}|20\d{{2}})\b)"),
    ("ORG", r"\b(?:The\s+)?(?:Microsoft|Google|Apple|Amazon|Meta|OpenAI|NASA|Tesla|Twitter|Netflix|Nvidia|IBM|Intel|European Union|EU|United Nations|UN|Federal Reserve|Fed|World Health Organization|WHO|Ministry of Health|Ministry of Defense|Ministry of Finance|White House|Pentagon|Parliament|Congress|Senate|Supreme Court)\b"),
    ("ORG", r"\b(?:The\s+)?(?:[A-Z][a-zA-Z0-9&]*(?:\s+[A-Z][a-zA-Z0-9&]*)*\s+(?:Inc|Corp|Corporation|LLC|Ltd|Limited|GmbH|AG|Company|Co|Agency|Association|Bank|Council|Commission|Department|Foundation|Group|Institute|University|Authority)\.?)\b"),
    ("PERSON", r"\b(?:Mr\.|Mrs\.|Ms\.|Dr\.|Prof\.|Senator|Representative|CEO|CTO|CFO|Director|General|Judge)\s+(?:[A-Z][a-z]+(?:\s+[A-Z][a-z]+)+)\b"),
    ("PERSON", r"\b(?:The\s+)?(?:Prime Minister|President|Governor|Chancellor|Attorney General)\b"),
    ("GPE", r"\b(?:Redmond|Paris|Brussels|Washington|London|Berlin|Tokyo|Beijing|New York|Geneva|Rome|Madrid|Ottawa|Canberra|New Delhi|Moscow|Kyiv|Jupiter|Mars|Moon|Earth|United States|USA|UK|France|Germany|Japan|China|India|Canada|Australia|Europe|Asia|Africa|North America|South America)\b"),
    ("EVENT", r"\b(?:[A-Z][a-zA-Z0-9]*(?:\s+[A-Z][a-zA-Z0-9]*)*\s+(?:Act|Treaty|Accord|Summit|Conference|Games|Olympics|Championship|Election|Cup|Initiative))\b"),
    ("PERSON", r"\b(?!The\b|This\b|That\b|These\b|Those\b|In\b|On\b|At\b|With\b|From\b)[A-Z][a-z]+(?:\s+[A-Z][a-z]+)+\b"),
]
CONJUNCTION = r"and|while|as well as"
MOST_SENTENCES, MOST_CHARS = 500, 100_000
MARKS, ENDS = ".,!?;:\"'", ".,;: "

SPLIT = rf"(?is)^(.*?)\s+\b(?:{CONJUNCTION})\s+((?=[a-z]+ed\b|[a-z]+s\b|employs\b|announced\b|plans\b|operates\b).*)$"


@F.pandas_udf(T.StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


def without_controls(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), CONTROL, "")


def collapsed(text: Column) -> Column:
    """Runs of white space of any kind as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def normalized(text: Column) -> Column:
    """Without control characters, in form NFKC, with single spaces; '' for null."""
    return collapsed(nfkc(without_controls(text)))


def claim_hash(claim: Column, subject: Column, action: Column, value: Column) -> Column:
    """SHA-256 of the four normalised parts in lower case, '|' between them; null parts are empty."""
    return F.sha2(F.concat_ws("|", *(F.lower(normalized(x)) for x in (claim, subject, action, value))), 256)


def _grouped(words: list[str]) -> str:
    """A pattern's choice between words, by their first letters: a place is asked for a letter before its words."""
    return "|".join(f"{x}(?:" + "|".join(w[1:] for w in dict.fromkeys(words) if w[0] == x) + ")" for x in sorted({w[0] for w in words}))


_CONTROL = re.compile(CONTROL)
_MARKED, _SHORT = re.compile(r"[.!?](?= )"), re.compile(r"[a-z](?:\.[a-z])+\.?|[a-z]\.")
_SENTENCE = T.StructType([T.StructField("sentence", T.StringType()), T.StructField("start_char", T.IntegerType()), T.StructField("end_char", T.IntegerType())])
_ENTITY = T.StructType([*(T.StructField(n, T.StringType()) for n in ("text", "label", "normalized_label")), *(T.StructField(n, T.IntegerType()) for n in ("start_char", "end_char"))])
_ABBREVIATIONS = frozenset(ABBREVIATIONS)


def sentence_bounds(text: str) -> list[tuple[int, int]]:
    """Where the sentences of a normalised text begin and end: at a mark before a space, unless the word is an
    abbreviation, an acronym or an initial, a small letter follows, or it stands between "3." and a digit."""
    out, start = [], 0
    for m in _MARKED.finditer(text):
        end = m.end()
        word, following = text[text.rfind(" ", 0, end) + 1 : end], text[end + 1 : end + 2]
        token = word.lower().strip(",;:")
        number = word[-1] == "." and word[-2:-1].isdigit() and following.isdigit()
        if not (number or following.islower() or token in _ABBREVIATIONS or _SHORT.fullmatch(token)):
            out.append((start, end))
            start = end + 1
    return [*out, (start, len(text))] if start < len(text) else out


def _first_words(pattern: str) -> frozenset[str]:
    """The first words of the names that a pattern lists, with "The" if it may come before them."""
    names = re.search(r"\(\?:([A-Z][A-Za-z .|\\]*)\)(?:\\b|\\s\+)(?!\)\?)", pattern)[1].split("|")
    return frozenset(n.split(" ")[0].rstrip("\\.") for n in names) | (frozenset(["The"]) if r"(?:The\s+)?" in pattern else frozenset())


#: Every match begins with a word, or a currency's sign: which families it may be, by the kind of the word.
_WORDS, _SIGNS = re.compile(r"\w+|[$€£¥]"), frozenset("$€£¥")
_DATES = frozenset(f"{MONTHS}|Monday|Tuesday|Wednesday|Thursday|Friday|Saturday|Sunday|yesterday|today|tomorrow|last|next|in".lower().split("|"))
#: Of words in small letters only those before a number begin a match, and these.
_QUICK = re.compile(r"[$€£¥]|\b[A-Z\d]\w*")
_WHOLE = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday", "yesterday", "today", "tomorrow", "last ", "next ")
#: With those in small letters as well.
_DATED = re.compile(r"[$€£¥]|\b(?:[A-Z\d]\w*|(?i:" + "|".join(w.strip() for w in _WHOLE) + r")\b)")
_ODD = ("\u0130", "\u0131", "\u017f")
_NAMED = {k: _first_words(ENTITIES[k][1]) for k in (3, 5, 6, 7)}
_BY_WORD = {w: tuple(k for k, names in _NAMED.items() if w in names) for w in frozenset().union(*_NAMED.values())}
_BY_DIGIT, _BY_CAPITAL, _BY_DATE, _BY_SIGN = (0, 1, 2), (4, 8, 9), (2,), (0,)
#: What the names of families 4 and 8 end with: before the last of these in a text, and nowhere else, they may begin.
_LAST = {k: re.compile(r"\s(?:" + _grouped(re.search(r"\(\?:([A-Z][A-Za-z|]*)\)(?:\\\.\?\))?", ENTITIES[k][1].rpartition(r"\s+")[2])[1].split("|")) + ")") for k in (4, 8)}
#: ENTITIES as patterns.
_OWN = [(label, re.compile(pattern)) for label, pattern in ENTITIES]


def _patterns(families: list[tuple[str, str]]) -> list[tuple[str, re.Pattern]]:
    return _OWN if families == ENTITIES else [(label, re.compile(pattern)) for label, pattern in families]


#: What a year is, and what the first of a person's names is.
_YEAR, _NAME = re.compile(r"(?:19|20)\d\d"), re.compile(r"(?!(?:The|This|That|These|Those|In|On|At|With|From)$)[A-Z][a-z]+")


@lru_cache(1 << 16)
def _tries(word: str) -> tuple[int, ...]:
    first = word[0]
    if first in _SIGNS:
        return _BY_SIGN
    if first.isdecimal():
        return _BY_DIGIT if _YEAR.fullmatch(word) else _BY_DIGIT[:2]
    # the two letters beyond ASCII that a pattern without case takes for an i, and one for an s
    low = word.lower() if word.isascii() else word.replace("\u0130", "i").replace("\u0131", "i").replace("\u017f", "s").lower()
    dated = _BY_DATE if low in _DATES else ()
    capital = _BY_CAPITAL if _NAME.fullmatch(word) else _BY_CAPITAL[:2]
    return (*capital, *_BY_WORD.get(word, ()), *dated) if "A" <= first <= "Z" else dated


def _word_before(text: str, at: int) -> int | None:
    """Where the word of small letters that a space parts from a place begins, if dates may begin with it."""
    end = at
    while end and text[end - 1].isspace():
        end -= 1
    start = end
    while start and (text[start - 1].isalnum() or text[start - 1] == "_"):
        start -= 1
    return start if end < at and "a" <= text[start] <= "z" and text[start:end].lower() in _DATES else None


def entity_spans(text: str, families: list[tuple[str, re.Pattern]]) -> list[tuple[int, int, str]]:
    """(start, end, label) of the matches of all families: of overlapping ones the earliest, then the longest, then the
    first family. The families of ENTITIES are only tried at words with which they may begin."""
    if families is _OWN or [(label, p.pattern) for label, p in families] == ENTITIES:
        found, ends, low = [], [0] * len(families), text.lower()
        most = [len(text)] * len(families)
        for k, last in _LAST.items():
            most[k] = max((m.start() for m in last.finditer(text)), default=-1)
        plain = text.isascii() or not any(w in text for w in _ODD)
        for m in (_WORDS if not plain else _DATED if any(w in low for w in _WHOLE) else _QUICK).finditer(text):
            if not (tries := _tries(m[0])):
                continue
            at, after = m.start(), text[m.end() : m.end() + 2]
            most[9] = at + 1 if len(after) > 1 and after[0].isspace() and ("A" <= after[1] <= "Z" or after[1].isspace()) else at
            if plain and tries[0] == 0 and (before := _word_before(text, at)) is not None and before >= ends[2] and (own := families[2][1].match(text, before)):
                ends[2] = own.end()  # a month, or "in", before the number
                found.append((before, -own.end(), 2))
            for k in tries:
                if ends[k] <= at < most[k] and (own := families[k][1].match(text, at)):
                    ends[k] = own.end()
                    found.append((at, -own.end(), k))
        found.sort()
    else:
        found = sorted((m.start(), -m.end(), k) for k, (_, pattern) in enumerate(families) for m in pattern.finditer(text))
    out, until = [], -1
    for start, end, k in found:
        if start >= until:
            until = -end
            out.append((start, until, families[k][0]))
    return out


def plain_form(text: str | None) -> str:
    """What `normalized` gives."""
    own = _CONTROL.sub("", text or "")
    return " ".join((own if own.isascii() else unicodedata.normalize("NFKC", own)).split())


def normal_hash(claim: Column, subject: Column, action: Column, value: Column) -> Column:
    """claim_hash of parts that are normalised already."""
    return F.sha2(F.lower(F.concat_ws("|", *(F.trim(F.coalesce(x, F.lit(""))) for x in (claim, subject, action, value)))), 256)


def _entity_array(found: list[tuple[str, int, int, str]]) -> pa.StructArray:
    """(text, start, end, label) of entities as Arrow's rows of _ENTITY."""
    text, start, end, label = zip(*found) if found else ((), (), (), ())
    named = [LABELS.get(x.upper(), "GENERAL") for x in label]
    return pa.StructArray.from_arrays([*(pa.array(x, pa.string()) for x in (text, label, named)), *(pa.array(x, pa.int32()) for x in (start, end))], names=[f.name for f in _ENTITY])


def _lists(sizes: list[int], values: pa.Array, null: list[bool] | None = None) -> pa.ListArray:
    """Lists of these sizes, one after the other, of values; null where it says so."""
    ends = [0, *accumulate(sizes)]
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values, mask=pa.array(null, pa.bool_()) if null and any(null) else None)


def sentences(text: Column, raw: bool = False) -> Column:
    """[(sentence, start_char, end_char)] of a normalised text, or with `raw` of one that is normalised here, in the same
    pass; none of an empty one. Results are columns from the start, so a batch is never a Python object for each sentence's row."""

    @F.arrow_udf(T.ArrayType(_SENTENCE))
    def cut(texts: pa.Array) -> pa.Array:
        sizes, null, words, starts, ends = [], [], [], [], []
        for t in texts.to_pylist():
            t = plain_form(t) if raw else t
            bounds = [] if t is None else sentence_bounds(t)
            sizes.append(len(bounds))
            null.append(t is None)
            for a, b in bounds:
                words.append(t[a:b])
                starts.append(a)
                ends.append(b)
        rows = pa.StructArray.from_arrays([pa.array(words, pa.string()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], names=[f.name for f in _SENTENCE])
        return _lists(sizes, rows, null)

    return cut(text)


def spans(text: Column, pattern: str, raw: bool = False) -> Column:
    """[(start_char, end_char, text)] of the matches of a pattern of Python's, with `raw` in the text's normal form."""

    @F.arrow_udf(T.ArrayType(T.StructType([T.StructField("start_char", T.IntegerType()), T.StructField("end_char", T.IntegerType()), T.StructField("text", T.StringType())])))
    def find(texts: pa.Array) -> pa.Array:
        own, sizes, null, found = re.compile(pattern), [], [], []
        for t in texts.to_pylist():
            t = plain_form(t) if raw else t
            own_spans = [] if t is None else [(m.start(), m.end(), m[0]) for m in own.finditer(t)]
            sizes.append(len(own_spans))
            null.append(t is None)
            found += own_spans
        start, end, held = zip(*found) if found else ((), (), ())
        rows = pa.StructArray.from_arrays([pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array(held, pa.string())], names=["start_char", "end_char", "text"])
        return _lists(sizes, rows, null)

    return find(text)


def entities(text: Column, families: list[tuple[str, str]] = ENTITIES, raw: bool = False) -> Column:
    """[(text, label, normalized_label, start_char, end_char)] of a normalised text, or with `raw` of one that is
    normalised here: of overlapping matches the earliest, then the longest, then the first family."""

    @F.arrow_udf(T.ArrayType(_ENTITY))
    def find(texts: pa.Array) -> pa.Array:
        own, sizes, null, found = _patterns(families), [], [], []
        for t in texts.to_pylist():
            t = plain_form(t) if raw else t
            names = [] if t is None else entity_spans(t, own)
            sizes.append(len(names))
            null.append(t is None)
            found += [(t[a:b], a, b, label) for a, b, label in names]
        return _lists(sizes, _entity_array(found), null)

    return find(text)


def read_text(text: Column, most: int | None = None, families: list[tuple[str, str]] = ENTITIES) -> Column:
    """[(sentence, start_char, end_char, inside)] of a raw text in normal form, with the entities inside each sentence; the
    first `most` sentences (all if None), and in `truncated` whether there were more. One pass over a text."""

    @F.arrow_udf(T.StructType([T.StructField("truncated", T.BooleanType()), T.StructField("found", T.ArrayType(T.StructType([*_SENTENCE.fields, T.StructField("inside", T.ArrayType(_ENTITY))])))]))
    def read(texts: pa.Array) -> pa.Array:
        own = _patterns(families)
        truncated, sizes, words, starts, ends, held, inside = [], [], [], [], [], [], []
        for given in texts.to_pylist():
            t = plain_form(given)
            bounds, names = sentence_bounds(t), entity_spans(t, own)
            k = 0
            for a, b in bounds[:most]:
                while k < len(names) and names[k][0] < a:
                    k += 1
                before = len(inside)
                while k < len(names) and names[k][0] < b:
                    start, end, label = names[k]
                    if end <= b:
                        inside.append((t[start:end], start, end, label))
                    k += 1
                words.append(t[a:b])
                starts.append(a)
                ends.append(b)
                held.append(len(inside) - before)
            sizes.append(len(bounds[:most]))
            truncated.append(most is not None and len(bounds) > most)
        rows = [pa.array(words, pa.string()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32()), _lists(held, _entity_array(inside))]
        found = _lists(sizes, pa.StructArray.from_arrays(rows, names=[*(f.name for f in _SENTENCE), "inside"]))
        return pa.StructArray.from_arrays([pa.array(truncated, pa.bool_()), found], names=["truncated", "found"])

    return read(text)


def normal_label(label: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in LABELS.items() for x in pair)), F.upper(label)), F.lit("GENERAL"))


def dominant(found: Column) -> Column:
    """The normal label of the first entity, GENERAL if there is none."""
    return F.coalesce(F.try_element_at(found, F.lit(1))["normalized_label"], F.lit("GENERAL"))


def within(found: Column, start: Column, end: Column) -> Column:
    """The entities inside a sentence."""
    return F.filter(found, lambda e: (e["start_char"] >= start) & (e["end_char"] <= end))


def named_in(found: Column, clause: Column) -> Column:
    """The entities whose text a clause holds, whatever its case."""
    return F.filter(found, lambda e: F.contains(F.lower(clause), F.lower(e["text"])))


def has_word(text: Column, words: list[str]) -> Column:
    # the letters first: whether a word begins at a place is dearer to tell
    letters = "".join(sorted({w[0] for w in words}))
    return text.rlike(rf"(?U)(?=[{letters}])\b(?:" + _grouped(words) + r")\b")


def classified(sentence: Column, has_entities: Column, least: float = 0.5, low: Column | None = None) -> Column:
    """(claim_type, confidence) of a normalised sentence; `low` is the sentence in small letters, if a column has it."""
    low, count = F.lower(sentence) if low is None else low, F.length(sentence) - F.length(F.replace(sentence, F.lit(" "), F.lit(""))) + F.when(sentence != "", 1).otherwise(0)
    first = F.rtrim(F.substring_index(low, " ", 1), F.lit(",.!?"))
    asks = first.isin(*QUESTION_STARTERS) & (count > 2) & low.rlike("^(" + "|".join(QUESTION_PREFIXES) + ")")
    sure = 0.70 + F.when(has_entities, 0.12).otherwise(0.0) + F.when(sentence.rlike(r"(?U)\b\d+(?:[.,]\d+)?\b"), 0.08).otherwise(0.0) + F.when(has_word(low, VERBS), 0.10).otherwise(0.0)
    kinds = [
        (sentence.endswith("?"), "QUESTION", F.lit(0.95)), (count == 0, "NON_CLAIM", F.lit(0.99)), (asks, "QUESTION", F.lit(0.92)), (count < 3, "NON_CLAIM", F.lit(0.90)),
        (first.isin(*IMPERATIVES) & (count <= 7), "NON_CLAIM", F.lit(0.88)), (has_word(low, OPINIONS), "OPINION", F.lit(0.88)),
    ]
    out = F.struct(F.lit("FACTUAL_CLAIM").alias("claim_type"), F.round(F.least(F.lit(0.99), F.greatest(F.lit(least), sure)), 2).alias("confidence"))
    for holds, kind, value in reversed(kinds):
        out = F.when(holds, F.struct(F.lit(kind).alias("claim_type"), value.alias("confidence"))).otherwise(out)
    return out


#: A verb as a word of its own, marks at its ends aside, between spaces.
_VERB = f" [{MARKS}]*(?:{_grouped([*VERBS, *AUXILIARIES])})[{MARKS}]* "


def joins(sentence: Column) -> Column:
    """Whether SPLIT parts a sentence: its pattern is dear, and asked only where one of the conjunctions is at all."""
    low = F.lower(sentence)
    return reduce(Column.__or__, (F.contains(low, F.lit(w)) for w in CONJUNCTION.split("|"))) & sentence.rlike(SPLIT)


def words_of(clause: Column) -> Column:
    """(words, low): the words of a clause by single spaces, and the same in small letters between two spaces."""
    words = F.trim(F.when(F.contains(clause, F.lit("  ")), F.regexp_replace(clause, " +", " ")).otherwise(clause))
    return F.struct(words.alias("words"), F.concat(F.lit(" "), F.lower(words), F.lit(" ")).alias("low"))


def verb_of(parts: Column) -> Column:
    """The first verb of words_of a clause with what surrounds it, null if there is none. Where this text is first met is
    where the pattern is."""
    return F.regexp_substr(parts["low"], F.lit(_VERB))


def before_verb(parts: Column, verb: Column) -> Column:
    """How many words of words_of a clause come before its verb_of; 0 if there is none."""
    before = F.call_function("substring_index", parts["low"], verb, F.lit(1))
    return F.coalesce(F.length(before) - F.length(F.replace(before, F.lit(" "), F.lit(""))), F.lit(0)).cast("int")


def triple(parts: Column, first: Column) -> Column:
    """(subject, action, value) of words_of a clause and its before_verb: what is before the first verb, the verb, what is
    after it; without a verb, or if it comes first, the first word, the second and the rest. Both should be columns that are
    there, not expressions. Words are cut off as text: arrays of them cost a lambda's call for every word."""
    words, split, many = parts["words"], first > 0, F.greatest(first, F.lit(1))
    head, both = (F.call_function("substring_index", words, F.lit(" "), n) for n in (many, many + 1))
    bare, last = lambda x: F.when(split, F.btrim(x, F.lit(MARKS))).otherwise(x), lambda x: F.when(x != "", F.btrim(x, F.lit(ENDS)))
    subject, action, value = bare(head), bare(F.substring(both, F.length(head) + 2, F.length(both))), bare(F.substring(words, F.length(both) + 2, F.length(words)))
    return F.struct(last(subject).alias("subject"), last(action).alias("action"), last(value).alias("value"))
