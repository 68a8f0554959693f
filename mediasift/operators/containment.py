"""Which texts of a medium hold each other, without testing all pairs.

If a text is held by a longer one, its words but the first and the last, which may be parts of words, are whole words
there and follow each other. So the longer texts list their words and pairs of neighbours, the shorter one asks for the
rarest of its own inner ones, and what lists that is verified. A text of two words or fewer asks for its rarest three
letters, one of three letters or fewer for itself, which needs no check and of which the first holder is enough; the
empty text is held by all.

Media in which testing all pairs costs no more than `FEW` for each row do that: for them an index is dearer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediasift.sources.blobs import written

FEW = 64


def _listed(text: str) -> Column:
    """Hashes of a text's words and of neighbouring pairs."""
    return F.expr(f"array_distinct(concat(transform(split({text}, ' '), w -> xxhash64(w)), zip_with(split({text}, ' '), slice(split({text}, ' '), 2, greatest(1, size(split({text}, ' ')) - 1)), (a, b) -> xxhash64(a, b))))")


def _wanted(text: str) -> Column:
    """Hashes of which a text's holder lists each: of its inner words, pairs if there are two or more."""
    inner = f"slice(split({text}, ' '), 2, size(split({text}, ' ')) - 2)"
    return F.expr(f"CASE WHEN size({inner}) = 1 THEN array(xxhash64({inner}[0])) ELSE array_distinct(zip_with(slice({inner}, 1, size({inner}) - 1), slice({inner}, 2, size({inner}) - 1), (a, b) -> xxhash64(a, b))) END")


def _letters(text: str, size: int) -> Column:
    """The distinct runs of `size` letters of a text."""
    return F.expr(f"CASE WHEN length({text}) >= {size} THEN array_distinct(transform(sequence(1, length({text}) - {size - 1}), i -> substr({text}, i, {size}))) ELSE CAST(array() AS array<string>) END")


def _candidates(shorter: DataFrame, longer: DataFrame, wanted: Column, listed: Column) -> DataFrame:
    """(m, s, l) of shorter(m, s) and longer(m, l): the texts that list the rarest of what another asks for; none of it
    that isn't listed at all."""
    asks = shorter.select("m", F.xxhash64("s").alias("sid"), F.explode(wanted).alias("gram"))
    lists = longer.select("m", F.xxhash64("l").alias("lid"), F.explode(listed).alias("gram"))
    counts = lists.groupBy("m", "gram").agg(F.count(F.lit(1)).alias("n"))
    rarest = asks.join(counts, ["m", "gram"], "left").groupBy("m", "sid").agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), "gram")).alias("gram"))
    ids = rarest.join(lists, ["m", "gram"]).select("m", "sid", "lid")
    named = ids.join(shorter.select("m", "s", F.xxhash64("s").alias("sid")), ["m", "sid"]).select("m", "s", "lid")
    return named.join(longer.select("m", "l", F.xxhash64("l").alias("lid")), ["m", "lid"]).select("m", "s", "l")


def held_pairs(shorter: DataFrame, longer: DataFrame) -> DataFrame:
    """(m, s, l) of distinct shorter(m, s) and longer(m, l), both without nulls, s of four letters or more: s is part of l."""
    worded = F.size(F.split("s", " ")) >= 3
    by_words = _candidates(shorter.filter(worded), longer, _wanted("s"), _listed("l"))
    short = shorter.filter(~worded)
    asked = longer.join(short.select("m").distinct(), "m", "left_semi")
    by_letters = _candidates(short, asked, _letters("s", 3), _letters("l", 3))
    return by_words.unionByName(by_letters).filter(F.contains("l", "s"))


def first_holders(asking: DataFrame, pieces: DataFrame) -> DataFrame:
    """(m, t, first): of each distinct text of asking(m, t) the least place of pieces(m, place, p) of its medium that it
    holds or is held by. Nulls meet nothing."""
    a = written(asking.select("m", "t").dropna().distinct(), "asking")
    p = written(pieces.dropna().groupBy("m", "p").agg(F.min("place").alias("place")), "pieces")
    sizes = a.groupBy("m").agg(F.count(F.lit(1)).alias("x")).join(p.groupBy("m").agg(F.count(F.lit(1)).alias("y")), "m")
    many = sizes.filter(f"x * y > {FEW} * (x + y)").select("m", F.lit(True).alias("many"))
    direct = lambda a, p: a.join(p, "m").filter(F.contains("p", "t") | F.contains("t", "p")).select("m", "t", "place")
    if many.isEmpty():
        return direct(a, p).groupBy("m", "t").agg(F.min("place").alias("first"))
    a, p = (df.join(many, "m", "left") for df in (a, p))
    near = direct(a.filter("many IS NULL").select("m", "t"), p.filter("many IS NULL").select("m", "p", "place"))
    a, p = a.filter("many").select("m", "t"), p.filter("many").select("m", "p", "place")
    held = held_pairs(a.filter("length(t) > 3").select("m", F.col("t").alias("s")), p.select("m", F.col("p").alias("l"))).select("m", F.col("s").alias("t"), F.col("l").alias("p"))
    holds = held_pairs(p.filter("length(p) > 3").select("m", F.col("p").alias("s")), a.select("m", F.col("t").alias("l"))).select("m", F.col("l").alias("t"), F.col("s").alias("p"))
    by_text = held.unionByName(holds).join(p, ["m", "p"]).select("m", "t", "place")
    # of a few letters or none: the first holder of each is known beforehand
    few = lambda of: F.concat(F.array(F.lit("")), *(_letters(of, k) for k in (1, 2, 3)))
    firsts = p.select("m", "place", F.explode(few("p")).alias("t")).groupBy("m", "t").agg(F.min("place").alias("place"))
    brief = a.filter("length(t) <= 3").join(firsts, ["m", "t"]).select("m", "t", "place")
    pieces_ = p.filter("length(p) <= 3").select("m", F.col("p").alias("g"), "place")
    inside = a.select("m", "t", F.explode(few("t")).alias("g")).join(pieces_, ["m", "g"]).select("m", "t", "place")
    every = near.unionByName(by_text).unionByName(brief).unionByName(inside)
    return every.groupBy("m", "t").agg(F.min("place").alias("first"))
