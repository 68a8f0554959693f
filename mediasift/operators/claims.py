"""Claims of a text: sentences, classes, entities, clauses, and where in the medium each was said or shown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mediasift.functions import text as X
from mediasift.operators.containment import first_holders
from mediasift.operators.registry import query
from mediasift.sources.blobs import written
from mediasift.sources.views import STATEMENTS_SQL, segments, small_batches, spread, statements, table


def texts(spark: SparkSession, d: str) -> DataFrame:
    """(media_id, text), not in normal form yet: what reads them brings them into it in the same pass (`raw`)."""
    return spread(statements(spark, d)).select("media_id", F.concat_ws(" ", "a", "b", "c").alias("text"))


def staged(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns that are computed once, however often what follows names them: the optimiser puts an expression in
    place of its name wherever it is used, but not through explode."""
    own = df.select("*", F.explode(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))).alias("__s"))
    return own.select(*df.columns, *(F.col(f"__s.{n}").alias(n) for n in columns))


def admitted(df: DataFrame, most_chars: int = X.MOST_CHARS) -> DataFrame:
    """df(text) with `status` and `error`: null and too long texts are rejected, empty ones completed without claims."""
    n = F.length("text")
    error = F.when(F.col("text").isNull(), "Input text cannot be null.").when(n > most_chars, F.concat(F.lit("Input text length ("), n.cast("string"), F.lit(f" chars) exceeds maximum allowed limit ({most_chars} chars).")))
    return df.withColumn("error", error).withColumn("status", F.when(F.col("error").isNotNull(), "REJECTED").otherwise("COMPLETED"))


def split_sentences(df: DataFrame, most: int | None = None, raw: bool = False) -> DataFrame:
    """df(.., text) with a row for each sentence: sentence_index, sentence, start_char, end_char, and whether more than
    `most` were there, of which only the first are given. Texts are in normal form, or with `raw` are read in it; `text`
    itself stays as it is."""
    found = small_batches(df).withColumn("__s", X.sentences(F.col("text"), raw))
    cut = F.col("__s") if most is None else F.slice("__s", 1, most)
    truncated = F.lit(False) if most is None else F.size("__s") > most
    # an outer explode: before another the optimiser filters by the array's size, which would find the sentences twice
    rows = found.select(*df.columns, truncated.alias("truncated"), F.posexplode_outer(cut).alias("sentence_index", "__x")).filter("sentence_index IS NOT NULL")
    return rows.select(*df.columns, "truncated", "sentence_index", "__x.*")


def claims(df: DataFrame, most_sentences: int | None = None) -> DataFrame:
    """df(media_id, text) as claims, one row each: a factual sentence that joins two predicates gives two.

    sentence_index, part (0 or 1), claim_text, claim_type, confidence, subject, action, value, entity_type, claim_hash,
    start_char, end_char, entities, truncated. Texts are normalised; null ones and those without sentences give no rows.
    With `most_sentences` only so many of a text are read (X.MOST_SENTENCES is the reference's bound), and `truncated`
    says whether there were more. Rows that repeat a medium or a text give rows of their own.
    """
    read = small_batches(df).select("media_id", X.read_text(F.col("text"), most_sentences).alias("r"))
    each = read.select("media_id", "r.truncated", F.posexplode("r.found").alias("sentence_index", "s")).select("media_id", "truncated", "sentence_index", "s.*")
    each = staged(staged(each, low=F.lower("sentence")), c=X.classified(F.col("sentence"), F.size("inside") > 0, low=F.col("low"))).select("media_id", "truncated", "sentence_index", "sentence", "start_char", "end_char", "inside", "c.*")
    named = (F.col("claim_type") == "FACTUAL_CLAIM") & (F.size("inside") > 0)
    parts = clauses(each).withColumn("entities", F.when(named, X.named_in(F.col("inside"), F.col("claim_text"))).otherwise(F.col("inside")))
    hashed = X.normal_hash(F.col("claim_text"), F.col("subject"), F.col("action"), F.col("value"))
    return parts.select("media_id", "sentence_index", "part", "claim_text", "claim_type", "confidence", "subject", "action", "value", X.dominant(F.col("entities")).alias("entity_type"), hashed.alias("claim_hash"), "start_char", "end_char", "entities", "truncated")


def clauses(df: DataFrame) -> DataFrame:
    """df(sentence, claim_type, ..) with a row for each clause: part, claim_text, subject, action, value. The second
    clause shares the subject of the first if its own is its first word."""
    rest = [c for c in df.columns if c != "sentence"]
    cut = staged(df, __two=(F.col("claim_type") == "FACTUAL_CLAIM") & X.joins(F.col("sentence")))
    two = F.col("__two")
    cut = staged(cut, __1=F.when(two, F.trim(F.regexp_extract("sentence", X.SPLIT, 1))).otherwise(F.col("sentence")), __2=F.when(two, F.trim(F.regexp_extract("sentence", X.SPLIT, 2))))
    cut = staged(cut, __w1=X.words_of(F.col("__1")), __w2=F.when(two, X.words_of(F.col("__2"))))
    cut = staged(cut, __v1=X.verb_of(F.col("__w1")), __v2=X.verb_of(F.col("__w2")))
    cut = staged(cut, __f1=X.before_verb(F.col("__w1"), F.col("__v1")), __f2=X.before_verb(F.col("__w2"), F.col("__v2")))
    cut = staged(cut, __t1=X.triple(F.col("__w1"), F.col("__f1")), __t2=F.when(two, X.triple(F.col("__w2"), F.col("__f2"))))
    word = F.substring_index("__2", " ", 1)
    shared = (F.coalesce("__t1.subject", F.lit("")) != "") & ((F.coalesce("__t2.subject", F.lit("")) == "") | (F.col("__t2.subject") == word))
    after = F.when(F.contains(F.col("__2"), F.lit(" ")), F.col("__2").substr(F.length(word) + 2, F.length("__2")))
    own = lambda part, text, s, a, v: F.struct(F.lit(part).alias("part"), text.alias("claim_text"), s.alias("subject"), a.alias("action"), v.alias("value"))
    first = own(0, F.col("__1"), F.col("__t1.subject"), F.col("__t1.action"), F.col("__t1.value"))
    second = F.when(shared, own(1, F.concat_ws(" ", "__t1.subject", "__2"), F.col("__t1.subject"), word, after)).otherwise(own(1, F.col("__2"), F.col("__t2.subject"), F.col("__t2.action"), F.col("__t2.value")))
    return cut.select(*rest, F.explode(F.when(F.col("__two"), F.array(first, second)).otherwise(F.array(first))).alias("__c")).select(*rest, "__c.*")


def triples(df: DataFrame) -> DataFrame:
    """(media_id, sentence_index, subject, action, value) of df(media_id, sentence_index, sentence)."""
    cut = staged(df.select("media_id", "sentence_index", "sentence"), w=X.words_of(F.col("sentence")))
    cut = staged(staged(cut, v=X.verb_of(F.col("w"))), f=X.before_verb(F.col("w"), F.col("v")))
    return staged(cut, x=X.triple(F.col("w"), F.col("f"))).select("media_id", "sentence_index", "x.*")


def classes(df: DataFrame) -> DataFrame:
    """df(.., sentence) with claim_type and confidence; a dollar sign stands for entities, as on the SQL side."""
    low = staged(df, __low=F.lower("sentence"))
    return staged(low, __x=X.classified(F.col("sentence"), F.contains(F.col("sentence"), F.lit("$")), low=F.col("__low"))).select(*df.columns, "__x.*")


def keep_first(df: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """The first row of each key by `order`, by a partial aggregate."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("row")).select(*keys, "row.*")


def provenance(claimed: DataFrame, pieces: DataFrame, place: str) -> DataFrame:
    """(media_id, sentence_index, place): the first piece of the medium that holds the claim's text or is held by it,
    whatever the case. Equal texts of a medium are compared once, and large media through an index (containment).

    Claims and pieces with a null medium or text meet nothing, an empty text meets every other of its medium.
    """
    c, p = written(claimed.select(F.col("media_id").alias("m"), "sentence_index", F.lower("claim_text").alias("t")), "claimed"), pieces.select(F.col("media_id").alias("m"), F.col(place).alias("place"), F.lower("text").alias("p"))
    found = c.join(first_holders(c, p), ["m", "t"])
    return found.groupBy(F.col("m").alias("media_id"), "sentence_index").agg(F.min("first").alias(place))


def resolved_source(transcript: Column, shown: Column, requested: Column) -> Column:
    """(text, source): what was asked for if it is there, else both, else the one that is there."""
    t, o = F.trim(F.coalesce(transcript, F.lit(""))), F.trim(F.coalesce(shown, F.lit("")))
    own = lambda text, source: F.struct(text.alias("text"), source.alias("source"))
    return (
        F.when((requested == "TRANSCRIPT") & (t != ""), own(t, F.lit("TRANSCRIPT"))).when((requested == "OCR") & (o != ""), own(o, F.lit("OCR"))).when((t != "") & (o != ""), own(F.concat_ws("\n\n", t, o), F.lit("COMBINED")))
        .when(t != "", own(t, F.lit("TRANSCRIPT"))).when(o != "", own(o, F.lit("OCR"))).otherwise(own(F.lit(""), F.coalesce(requested, F.lit("DIRECT_TEXT"))))
    )


def _list(words: list[str]) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


_SHORT = "lower(ltrim(w, ',;:'))"
#: Sentences by tokens: a token ends one unless it is short for something, part of a number or followed by a small letter.
_SENTENCES_SQL = (
    "tk AS (SELECT media_id, i, toks[i] AS w, toks[i + 1] AS v, len(toks) AS n FROM (SELECT media_id, string_split(text, ' ') AS toks FROM tx), unnest(range(1, len(toks) + 1)) u(i)), "
    f"sb AS (SELECT *, regexp_matches(w, '[.!?]$') AND (i = n OR NOT (regexp_matches(w, '\\d\\.$') AND regexp_matches(v, '^\\d')) AND NOT regexp_matches(v, '^\\p{{Ll}}') AND NOT ({_SHORT} IN ({_list(X.ABBREVIATIONS)}) OR regexp_matches({_SHORT}, '^([a-z](\\.[a-z])+\\.?|[a-z]\\.)$'))) AS stop FROM tk), "
    "sg AS (SELECT *, coalesce(sum(stop::INT) OVER p, 0) AS s, coalesce(sum(length(w) + 1) OVER p, 0) AS place FROM sb WINDOW p AS (PARTITION BY media_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), "
    "se AS (SELECT media_id, CAST(s AS INT) AS sentence_index, string_agg(w, ' ' ORDER BY i) AS sentence, CAST(min(place) AS INT) AS start_char, CAST(max(place + length(w)) AS INT) AS end_char FROM sg GROUP BY media_id, s)"
)
#: The same over documents, whose words are put together by single spaces.
DOCUMENTS_SQL = "tx AS (SELECT media_id, text FROM (SELECT doc_id AS media_id, trim(regexp_replace(regexp_replace(text, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]', '', 'g'), '\\s+', ' ', 'g')) AS text FROM documents) WHERE text <> '')"
SENTENCES_SQL, DOCUMENT_SENTENCES_SQL = f"{STATEMENTS_SQL}, {_SENTENCES_SQL}", f"{DOCUMENTS_SQL}, {_SENTENCES_SQL}"
_EDGE, _EDGE_END = "(^|[^\\pL\\pN_])", "([^\\pL\\pN_]|$)"
_WORDS = "len(string_split(sentence, ' '))"
_FIRST = "rtrim(string_split(lower(sentence), ' ')[1], ',.!?')"
#: Stands for entities on the SQL side.
MONEY = "contains(sentence, '$')"
_CLASSES_SQL = (
    f"cl AS (SELECT *, CASE WHEN sentence LIKE '%?' THEN 'QUESTION' WHEN {_FIRST} IN ({_list(X.QUESTION_STARTERS)}) AND {_WORDS} > 2 AND regexp_matches(lower(sentence), '^({'|'.join(X.QUESTION_PREFIXES)})') THEN 'QUESTION' WHEN {_WORDS} < 3 THEN 'NON_CLAIM' "
    f"WHEN {_FIRST} IN ({_list(X.IMPERATIVES)}) AND {_WORDS} <= 7 THEN 'NON_CLAIM' WHEN regexp_matches(lower(sentence), '{_EDGE}({'|'.join(X.OPINIONS)}){_EDGE_END}') THEN 'OPINION' ELSE 'FACTUAL_CLAIM' END AS claim_type, "
    f"CASE WHEN sentence LIKE '%?' THEN 0.95 WHEN {_FIRST} IN ({_list(X.QUESTION_STARTERS)}) AND {_WORDS} > 2 AND regexp_matches(lower(sentence), '^({'|'.join(X.QUESTION_PREFIXES)})') THEN 0.92 WHEN {_WORDS} < 3 THEN 0.9 WHEN {_FIRST} IN ({_list(X.IMPERATIVES)}) AND {_WORDS} <= 7 THEN 0.88 "
    f"WHEN regexp_matches(lower(sentence), '{_EDGE}({'|'.join(X.OPINIONS)}){_EDGE_END}') THEN 0.88 ELSE least(0.99, round(0.7 + CASE WHEN {MONEY} THEN 0.12 ELSE 0 END + CASE WHEN regexp_matches(sentence, '{_EDGE}\\d+([.,]\\d+)?{_EDGE_END}') THEN 0.08 ELSE 0 END + CASE WHEN regexp_matches(lower(sentence), '{_EDGE}({'|'.join(X.VERBS)}){_EDGE_END}') THEN 0.1 ELSE 0 END, 2)) END AS confidence FROM se)"
)


CLASSES_SQL, DOCUMENT_CLASSES_SQL = f"{SENTENCES_SQL}, {_CLASSES_SQL}", f"{DOCUMENT_SENTENCES_SQL}, {_CLASSES_SQL}"


def _triple_sql(name: str, source: str, text: str) -> str:
    """CTE `name`: source with words, verb place and the parts of `text` as subject, action and value."""
    marks, ends = "'.,!?;:\"'''", "'.,;: '"
    last = lambda x: f"CASE WHEN {x} <> '' THEN trim({x}, {ends}) END"
    inner = (
        f"SELECT *, CASE WHEN k > 1 THEN trim(array_to_string(ws[1:k - 1], ' '), {marks}) ELSE ws[1] END AS s0, CASE WHEN k > 1 THEN trim(ws[k], {marks}) ELSE ws[2] END AS a0, CASE WHEN k > 1 THEN trim(array_to_string(ws[k + 1:], ' '), {marks}) ELSE array_to_string(ws[3:], ' ') END AS v0 "
        f"FROM (SELECT *, coalesce(list_position(list_transform(ws, lambda w: trim(lower(w), {marks}) IN ({_list([*X.VERBS, *X.AUXILIARIES])})), true), 0) AS k FROM (SELECT *, list_filter(string_split({text}, ' '), lambda w: w <> '') AS ws FROM {source}))"
    )
    return f"{name} AS (SELECT * EXCLUDE (ws, k, s0, a0, v0), {last('s0')} AS subject, {last('a0')} AS action, {last('v0')} AS value FROM ({inner}))"


@query("x1_control_characters", f"WITH {STATEMENTS_SQL} SELECT media_id, md5(regexp_replace(concat(a, chr(9), chr(7), '  ', b, chr(127), ' ', c), '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]', '', 'g')) AS cleaned FROM st")
def x1(spark: SparkSession, d: str) -> DataFrame:
    raw = F.expr("concat(a, chr(9), chr(7), '  ', b, chr(127), ' ', c)")
    return statements(spark, d).select("media_id", F.md5(X.without_controls(raw)).alias("cleaned"))


@query("x2_normal_form", "SELECT doc_id AS media_id, md5(trim(regexp_replace(regexp_replace(text, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]', '', 'g'), '\\s+', ' ', 'g'))) AS normal FROM documents")
def x2(spark: SparkSession, d: str) -> DataFrame:
    """Whole documents in form NFKC; their letters are in it already, so the SQL does without (a test has others)."""
    return table(spark, d, "documents").select(F.col("doc_id").alias("media_id"), F.md5(X.normalized(F.col("text"))).alias("normal"))


@query("x3_white_space", f"WITH {STATEMENTS_SQL} SELECT media_id, trim(regexp_replace(concat(' ', a, chr(9), '  ', b, chr(160), chr(10), c), '[\\s\\x{{00a0}}]+', ' ', 'g')) AS text FROM st")
def x3(spark: SparkSession, d: str) -> DataFrame:
    return statements(spark, d).select("media_id", X.collapsed(F.expr("concat(' ', a, chr(9), '  ', b, decode(unhex('C2A0'), 'UTF-8'), chr(10), c)")).alias("text"))


@query("x4_claim_hash", f"WITH {STATEMENTS_SQL} SELECT media_id, sha256(lower(trim(a)) || '|' || lower(trim(b)) || '|' || coalesce(CASE WHEN media_id % 3 > 0 THEN lower(trim(c)) END, '') || '|') AS claim_hash FROM st")
def x4(spark: SparkSession, d: str) -> DataFrame:
    return statements(spark, d).select("media_id", X.claim_hash(F.col("a"), F.col("b"), F.when(F.col("media_id") % 3 > 0, F.col("c")), F.lit(None).cast("string")).alias("claim_hash"))


@query("x5_sentences", f"WITH {SENTENCES_SQL} SELECT media_id, sentence_index, sentence, start_char, end_char FROM se")
def x5(spark: SparkSession, d: str) -> DataFrame:
    return split_sentences(texts(spark, d), raw=True).select("media_id", "sentence_index", "sentence", "start_char", "end_char")


@query("x6_entities")
def x6(spark: SparkSession, d: str) -> DataFrame:
    """DuckDB's patterns know no lookahead; a test holds the spans against Python's re."""
    return texts(spark, d).select("media_id", F.explode_outer(X.entities(F.col("text"), raw=True)).alias("e")).filter("e IS NOT NULL").select("media_id", "e.*")


@query("x7_sentence_classes", f"WITH {CLASSES_SQL} SELECT media_id, sentence_index, claim_type, CAST(confidence AS DOUBLE) AS confidence FROM cl")
def x7(spark: SparkSession, d: str) -> DataFrame:
    return classes(split_sentences(texts(spark, d), raw=True)).select("media_id", "sentence_index", "claim_type", "confidence")


@query("x8_triples", f"WITH {SENTENCES_SQL}, {_triple_sql('tr', 'se', 'sentence')} SELECT media_id, sentence_index, subject, action, value FROM tr")
def x8(spark: SparkSession, d: str) -> DataFrame:
    return triples(split_sentences(texts(spark, d), raw=True))


_RE2_SPLIT = f"(?is)^(.*?)\\s+(?:{X.CONJUNCTION})\\s+((?:[a-z]+ed|[a-z]+s|employs|announced|plans|operates)(?:[^\\pL\\pN_].*)?)$"
_CLAUSES_SQL = (
    f"c0 AS (SELECT *, claim_type = 'FACTUAL_CLAIM' AND regexp_matches(sentence, '{_RE2_SPLIT}') AS two FROM cl), c1 AS (SELECT *, CASE WHEN two THEN trim(regexp_extract(sentence, '{_RE2_SPLIT}', 1)) ELSE sentence END AS one, CASE WHEN two THEN trim(regexp_extract(sentence, '{_RE2_SPLIT}', 2)) END AS other FROM c0), "
    f"{_triple_sql('t1', 'c1', 'one')}, {_triple_sql('t2', '(SELECT * RENAME (subject AS s1, action AS a1, value AS v1) FROM t1)', 'other')}, "
    "c2 AS (SELECT *, coalesce(s1, '') <> '' AND (coalesce(subject, '') = '' OR subject = string_split(other, ' ')[1]) AS shared FROM t2), "
    "ca AS (SELECT media_id, sentence_index, claim_type, 0 AS part, one AS claim_text, s1 AS subject, a1 AS action, v1 AS value FROM c2 UNION ALL SELECT media_id, sentence_index, claim_type, 1, CASE WHEN shared THEN s1 || ' ' || other ELSE other END, CASE WHEN shared THEN s1 ELSE subject END, "
    "CASE WHEN shared THEN string_split(other, ' ')[1] ELSE action END, CASE WHEN shared THEN CASE WHEN contains(other, ' ') THEN substr(other, strpos(other, ' ') + 1) END ELSE value END FROM c2 WHERE two)"
)


CLAUSES_SQL, DOCUMENT_CLAUSES_SQL = f"{CLASSES_SQL}, {_CLAUSES_SQL}", f"{DOCUMENT_CLASSES_SQL}, {_CLAUSES_SQL}"


def _clauses(spark: SparkSession, d: str) -> DataFrame:
    return clauses(classes(split_sentences(texts(spark, d), raw=True)).select("media_id", "sentence_index", "sentence", "claim_type"))


@query("x9_clauses", f"WITH {CLAUSES_SQL} SELECT media_id, sentence_index, claim_type, part, claim_text, subject, action, value FROM ca")
def x9(spark: SparkSession, d: str) -> DataFrame:
    return _clauses(spark, d)


@query("x10_claims")
def x10(spark: SparkSession, d: str) -> DataFrame:
    """Claims with their entities and hash; what the SQL of x5, x7, x8 and x9 doesn't show, a test holds against Python."""
    return claims(spread(statements(spark, d)).select("media_id", F.concat_ws(" ", "a", "b", "c").alias("text")))


def document_texts(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents"), 10_000).select(F.col("doc_id").alias("media_id"), "text")


@query("x5_document_sentences", f"WITH {DOCUMENT_SENTENCES_SQL} SELECT media_id, sentence_index, md5(sentence) AS sentence, start_char, end_char FROM se")
def x5_documents(spark: SparkSession, d: str) -> DataFrame:
    return split_sentences(document_texts(spark, d), raw=True).select("media_id", "sentence_index", F.md5("sentence").alias("sentence"), "start_char", "end_char")


@query("x7_document_classes", f"WITH {DOCUMENT_CLASSES_SQL} SELECT media_id, sentence_index, claim_type, CAST(confidence AS DOUBLE) AS confidence FROM cl")
def x7_documents(spark: SparkSession, d: str) -> DataFrame:
    return classes(split_sentences(document_texts(spark, d), raw=True)).select("media_id", "sentence_index", "claim_type", "confidence")


@query("x8_document_triples", f"WITH {DOCUMENT_SENTENCES_SQL}, {_triple_sql('tr', 'se', 'sentence')} SELECT media_id, sentence_index, subject, action, md5(value) AS value FROM tr")
def x8_documents(spark: SparkSession, d: str) -> DataFrame:
    return triples(split_sentences(document_texts(spark, d), raw=True)).withColumn("value", F.md5("value"))


@query("x9_document_clauses", f"WITH {DOCUMENT_CLAUSES_SQL} SELECT media_id, sentence_index, claim_type, part, md5(claim_text) AS claim_text, subject, action, md5(value) AS value FROM ca")
def x9_documents(spark: SparkSession, d: str) -> DataFrame:
    return clauses(classes(split_sentences(document_texts(spark, d), raw=True)).select("media_id", "sentence_index", "sentence", "claim_type")).withColumns({c: F.md5(c) for c in ("claim_text", "value")})


@query("x6_document_entities")
def x6_documents(spark: SparkSession, d: str) -> DataFrame:
    return document_texts(spark, d).select("media_id", F.explode_outer(X.entities(F.col("text"), raw=True)).alias("e")).filter("e IS NOT NULL").select("media_id", "e.*")


@query("x10_document_claims")
def x10_documents(spark: SparkSession, d: str) -> DataFrame:
    return claims(document_texts(spark, d))


LABELS_SQL = "CASE upper(l) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in X.LABELS.items()) + " ELSE 'GENERAL' END"
_LABEL = "CASE event_id % 9 WHEN 0 THEN 'gpe' WHEN 1 THEN 'PERSON' WHEN 2 THEN 'TIME' WHEN 3 THEN 'PERCENT' WHEN 4 THEN 'LOC' WHEN 5 THEN 'NORP' WHEN 6 THEN 'Money' WHEN 7 THEN event_type END"


@query("x11_entity_labels", f"SELECT event_id, {LABELS_SQL} AS label FROM (SELECT event_id, {_LABEL} AS l FROM events)")
def x11(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", X.normal_label(F.expr(_LABEL)).alias("label"))


_GUARDED = "CASE doc_id % 5 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE text END"


@query("x17_text_guard", f"SELECT doc_id AS media_id, CASE WHEN t IS NULL OR length(t) > 2000 THEN 'REJECTED' ELSE 'COMPLETED' END AS status, CASE WHEN t IS NULL THEN 'Input text cannot be null.' WHEN length(t) > 2000 THEN 'Input text length (' || length(t) || ' chars) exceeds maximum allowed limit (2000 chars).' END AS error FROM (SELECT doc_id, {_GUARDED} AS t FROM documents)")
def x17(spark: SparkSession, d: str) -> DataFrame:
    return admitted(table(spark, d, "documents").select(F.col("doc_id").alias("media_id"), F.expr(_GUARDED).alias("text")), 2000).select("media_id", "status", "error")


@query("t3_first_sentences", f"WITH {SENTENCES_SQL} SELECT media_id, sentence_index, sentence, max(sentence_index) OVER (PARTITION BY media_id) >= 2 AS truncated FROM se QUALIFY sentence_index < 2")
def t3(spark: SparkSession, d: str) -> DataFrame:
    """The first two sentences of each text, and whether there were more."""
    return split_sentences(texts(spark, d), 2, raw=True).select("media_id", "sentence_index", "sentence", "truncated")


@query("t4_keep_first_by_hash", "SELECT media_id, claim_hash, min(y) AS y FROM (SELECT doc_id % 50 AS media_id, sha256(lower(trim(lang)) || '|||') AS claim_hash, doc_id AS y FROM documents) GROUP BY media_id, claim_hash")
def t4(spark: SparkSession, d: str) -> DataFrame:
    """The first claim of each hash in a medium; here the language stands for the claim."""
    none = F.lit(None).cast("string")
    rows = table(spark, d, "documents").select((F.col("doc_id") % 50).alias("media_id"), X.claim_hash(F.col("lang"), none, none, none).alias("claim_hash"), F.col("doc_id").alias("y"))
    return keep_first(rows, ["media_id", "claim_hash"], F.col("y"))


@query("f6_claims_by_type", f"WITH {CLASSES_SQL} SELECT media_id, sentence_index, sentence FROM cl WHERE claim_type = 'OPINION' ORDER BY media_id, sentence_index")
def f6(spark: SparkSession, d: str) -> DataFrame:
    return classes(split_sentences(texts(spark, d), raw=True)).filter("claim_type = 'OPINION'").select("media_id", "sentence_index", "sentence").orderBy("media_id", "sentence_index")


_MET = "JOIN {p} ON {p}.media_id = se.media_id AND (contains(lower({p}.text), lower(se.sentence)) OR contains(lower(se.sentence), lower({p}.text)))"
SEGMENTS_OF_SQL = "sp AS (SELECT media_id, 0 AS seg, a || ' ' || b AS text FROM st UNION ALL SELECT media_id, 1, c FROM st UNION ALL SELECT media_id, 2, b FROM st)"
REGIONS_OF_SQL = "rg AS (SELECT media_id, 0 AS region, b AS text FROM st WHERE media_id % 2 = 0 UNION ALL SELECT media_id, 1, upper(a) FROM st WHERE media_id % 2 = 0)"


def _pieces(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    st = statements(spark, d)
    said = st.select("media_id", F.posexplode(F.expr("array(a || ' ' || b, c, b)")).alias("seg", "text"))
    shown = st.filter("media_id % 2 = 0").select("media_id", F.posexplode(F.expr("array(b, upper(a))")).alias("region", "text"))
    return split_sentences(texts(spark, d), raw=True).withColumnRenamed("sentence", "claim_text"), said, shown


@query("j8_transcript_provenance", f"WITH {SENTENCES_SQL}, {SEGMENTS_OF_SQL} SELECT se.media_id, sentence_index, min(seg) AS seg FROM se {_MET.format(p='sp')} GROUP BY se.media_id, sentence_index")
def j8(spark: SparkSession, d: str) -> DataFrame:
    said, segments, _ = _pieces(spark, d)
    return provenance(said, segments, "seg")


@query(
    "j9_region_provenance",
    f"WITH {SENTENCES_SQL}, {SEGMENTS_OF_SQL}, {REGIONS_OF_SQL}, s AS (SELECT se.media_id, sentence_index, min(seg) AS seg FROM se {_MET.format(p='sp')} GROUP BY se.media_id, sentence_index), r AS (SELECT se.media_id, sentence_index, min(region) AS region FROM se {_MET.format(p='rg')} GROUP BY se.media_id, sentence_index) "
    "SELECT se.media_id, se.sentence_index, seg, region, CASE WHEN region IS NOT NULL THEN 'OCR' WHEN seg IS NOT NULL THEN 'TRANSCRIPT' ELSE 'DIRECT_TEXT' END AS source_type FROM se LEFT JOIN s USING (media_id, sentence_index) LEFT JOIN r USING (media_id, sentence_index)",
)
def j9(spark: SparkSession, d: str) -> DataFrame:
    """What was shown takes precedence over what was said."""
    claimed, segments, regions = _pieces(spark, d)
    keys = ["media_id", "sentence_index"]
    out = claimed.select(*keys).join(provenance(claimed, segments, "seg"), keys, "left").join(provenance(claimed, regions, "region"), keys, "left")
    return out.withColumn("source_type", F.when(F.col("region").isNotNull(), "OCR").when(F.col("seg").isNotNull(), "TRANSCRIPT").otherwise("DIRECT_TEXT"))


#: Sentences of what is said in a conversation, and its turns.
TURNS_SQL = "tx AS (SELECT conv_id * 1000 + turn AS media_id, text FROM (SELECT conv_id, turn, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text FROM conversations) WHERE text <> '')"


@query(
    "j8_conversation_provenance",
    f"WITH {TURNS_SQL}, {_SENTENCES_SQL}, sc AS (SELECT media_id // 1000 AS conv_id, media_id % 1000 AS turn, sentence_index, lower(sentence) AS s FROM se) SELECT sc.conv_id, sc.turn, sentence_index, min(c.turn) AS first_turn FROM sc JOIN conversations c ON c.conv_id = sc.conv_id AND (contains(lower(c.text), s) OR contains(s, lower(c.text))) GROUP BY sc.conv_id, sc.turn, sentence_index",
)
def j8_conversations(spark: SparkSession, d: str) -> DataFrame:
    """The first turn of a conversation in which each of its sentences was said."""
    said = segments(spark, d).select("media_id", "seg", "text")
    each = split_sentences(said, raw=True)
    found = provenance(each.select("media_id", F.struct("seg", "sentence_index").alias("sentence_index"), F.col("sentence").alias("claim_text")), said, "seg")
    return found.select(F.col("media_id").alias("conv_id"), F.col("sentence_index.seg").alias("turn"), F.col("sentence_index.sentence_index").alias("sentence_index"), F.col("seg").alias("first_turn"))


#: Tokens with a digit stand for entities, as their offsets are the same in both engines.
TOKENS_SQL = "dg AS (SELECT media_id, CAST(place AS INT) AS start_char, CAST(place + length(w) AS INT) AS end_char, w FROM sg WHERE regexp_matches(w, '\\d'))"


def _digit_tokens(spark: SparkSession, d: str) -> DataFrame:
    marked = texts(spark, d).withColumn("found", F.transform(X.spans(F.col("text"), r"[^ ]*\d[^ ]*", raw=True), lambda s: F.struct(s["text"].alias("text"), s["start_char"].alias("start_char"), s["end_char"].alias("end_char"))))
    return split_sentences(marked, raw=True)


@query("j10_entities_in_sentence", f"WITH {SENTENCES_SQL}, {TOKENS_SQL} SELECT se.media_id, sentence_index, count(w) AS n, coalesce(string_agg(w, ',' ORDER BY dg.start_char), '') AS held FROM se LEFT JOIN dg ON dg.media_id = se.media_id AND dg.start_char >= se.start_char AND dg.end_char <= se.end_char GROUP BY se.media_id, sentence_index")
def j10(spark: SparkSession, d: str) -> DataFrame:
    """Per text, in its own row: no join and no shuffle."""
    own = X.within(F.col("found"), F.col("start_char"), F.col("end_char"))
    return _digit_tokens(spark, d).select("media_id", "sentence_index", own.alias("own")).select("media_id", "sentence_index", F.size("own").cast("long").alias("n"), F.array_join("own.text", ",").alias("held"))


@query("j11_entities_in_clause", f"WITH {SENTENCES_SQL}, {TOKENS_SQL} SELECT se.media_id, sentence_index, count(w) AS n FROM se LEFT JOIN dg ON dg.media_id = se.media_id AND contains(lower(sentence), lower(w)) GROUP BY se.media_id, sentence_index")
def j11(spark: SparkSession, d: str) -> DataFrame:
    return _digit_tokens(spark, d).select("media_id", "sentence_index", F.size(X.named_in(F.col("found"), F.col("sentence"))).cast("long").alias("n"))


_ASKED = "CASE media_id % 5 WHEN 0 THEN 'TRANSCRIPT' WHEN 1 THEN 'OCR' WHEN 2 THEN 'DIRECT_TEXT' END"


@query(
    "j12_source_resolution",
    f"WITH {STATEMENTS_SQL}, a AS (SELECT media_id, a AS t FROM st WHERE media_id % 3 > 0), b AS (SELECT media_id, c AS o FROM st WHERE media_id % 4 > 0), r AS (SELECT media_id, {_ASKED} AS asked, trim(coalesce(t, '')) AS t, trim(coalesce(o, '')) AS o FROM st LEFT JOIN a USING (media_id) LEFT JOIN b USING (media_id)) "
    "SELECT media_id, CASE WHEN asked = 'TRANSCRIPT' AND t <> '' THEN t WHEN asked = 'OCR' AND o <> '' THEN o WHEN t <> '' AND o <> '' THEN t || chr(10) || chr(10) || o WHEN t <> '' THEN t ELSE o END AS text, CASE WHEN asked = 'TRANSCRIPT' AND t <> '' THEN 'TRANSCRIPT' WHEN asked = 'OCR' AND o <> '' THEN 'OCR' WHEN t <> '' AND o <> '' THEN 'COMBINED' WHEN t <> '' THEN 'TRANSCRIPT' WHEN o <> '' THEN 'OCR' ELSE coalesce(asked, 'DIRECT_TEXT') END AS source FROM r",
)
def j12(spark: SparkSession, d: str) -> DataFrame:
    st = statements(spark, d)
    said, shown = st.filter("media_id % 3 > 0").select("media_id", F.col("a").alias("t")), st.filter("media_id % 4 > 0").select("media_id", F.col("c").alias("o"))
    both = st.select("media_id", F.expr(_ASKED).alias("asked")).join(said, "media_id", "left").join(shown, "media_id", "left")
    return both.select("media_id", resolved_source(F.col("t"), F.col("o"), F.col("asked")).alias("x")).select("media_id", "x.*")
