"""Dictionary terms in text: whole-word hits by n-gram joins, and near hits by blocking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from umbra.functions.text import fold_for_compare
from umbra.operators import near

MIN_FUZZY = 6
MAX_GAP = 3
WORD = r"[\p{L}\p{N}]+"
#: Terms are broadcast up to this count; a larger dictionary goes by a shuffle join.
BROADCAST_TERMS = 200_000


def _tokens(text: Column) -> Column:
    return F.filter(F.split(text, r"[^\p{L}\p{N}]+"), lambda t: t != "")


def _small(terms: DataFrame) -> DataFrame:
    return F.broadcast(terms) if terms.count() <= BROADCAST_TERMS else terms


def hits(df: DataFrame, key: str, text: str, terms: DataFrame, term: str = "term", longest: int = 4) -> DataFrame:
    """``key, term, n``: how often each term (of up to ``longest`` words) stands in each text as whole words, case aside.

    Word n-grams of the text meet the terms in an equi-join; n-grams are counted per
    text first.
    """
    words = F.transform(_tokens(F.col(text)), lambda t: F.lower(t))
    rows = df.select(key, words.alias("w"))
    runs = F.flatten(F.array(*[F.when(F.size("w") >= n, _runs(F.col("w"), n)).otherwise(F.array().cast("array<string>")) for n in range(1, longest + 1)]))
    grams = rows.select(key, F.explode(runs).alias("gram")).groupBy(key, "gram").agg(F.count("*").alias("n"))
    wanted = terms.select(F.col(term).alias("term"), F.array_join(F.transform(_tokens(F.col(term)), lambda t: F.lower(t)), " ").alias("gram")).distinct()
    return grams.join(_small(wanted), "gram").select(key, "term", "n")


def _runs(words: Column, n: int) -> Column:
    return F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda i: F.array_join(F.slice(words, i, F.lit(n)), " "))


def within_one(a: Column, b: Column) -> Column:
    """At most one insertion, deletion, substitution or swap of neighbours."""
    n = F.length(a)
    swapped = F.exists(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.concat(F.substring(a, F.lit(1), i - 1), F.substring(a, i + 1, F.lit(1)), F.substring(a, i, F.lit(1)), F.substring(a, i + 2, n)) == b)
    return (F.levenshtein(a, b) <= 1) | ((n == F.length(b)) & (n >= 2) & swapped)


def near_hits(df: DataFrame, key: str, text: str, terms: DataFrame, term: str = "term", longest: int = 1) -> DataFrame:
    """``key, term, token, n``: single words within one edit of a term of six or more letters.

    ``longest`` above 1: runs of up to so many words, at most ``MAX_GAP`` characters apart,
    meet the terms with single spaces between words.  Terms of two words also match swapped,
    and, without edits, with the first word as an initial; so do terms under six letters.

    Runs of several words: up to ``BROADCAST_TERMS`` spellings go to the workers, which read
    each text once.  Else an edit leaves the first or the last letter alone, so words and
    terms meet on either with the length; distinct words are compared, not occurrences.
    """
    folded = fold_for_compare(F.col(term))
    if longest == 1:
        wanted = terms.select(F.col(term).alias("term"), folded.alias("folded"), F.lit(True).alias("near")).where(F.length("folded") >= MIN_FUZZY).distinct()
        found = F.transform(_tokens(F.col(text)), fold_for_compare)
    else:
        wanted = _forms(terms.select(F.col(term).alias("term"))).distinct()
        forms = wanted.take(BROADCAST_TERMS + 1)
        if 0 < len(forms) <= BROADCAST_TERMS:
            return near.hits(df, key, text, tuple(sorted(tuple(f) for f in forms)), longest, MAX_GAP)
        found = _near_runs(F.col("folded"), F.col("gaps"), longest)
        df = df.select(key, F.transform(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), fold_for_compare).alias("folded"), F.transform(F.split(text, WORD, -1), F.char_length).alias("gaps"))
    least, most = wanted.agg(F.min(F.length("folded")), F.max(F.length("folded"))).first()
    words = df.select(key, F.explode(found).alias("token")).where(F.length("token").between(F.lit(least) - 1, F.lit(most) + 1))
    counts = words.groupBy(key, "token").agg(F.count("*").alias("n"))
    tokens = counts.select("token").distinct()

    def blocks(x: str) -> Column:
        return F.array(F.concat(F.lit("<"), F.left(F.col(x), F.lit(1))), F.concat(F.lit(">"), F.right(F.col(x), F.lit(1))))

    lengths = F.explode(F.sequence(F.length("folded") - 1, F.length("folded") + 1)).alias("len")
    wide = wanted.select("term", "folded", "near", lengths).select("term", "folded", "near", "len", F.explode(blocks("folded")).alias("block"))
    same = (F.col("token") == F.col("folded")) | (F.col("near") & within_one(F.col("token"), F.col("folded")))
    close = tokens.select("token", F.length("token").alias("len"), F.explode(blocks("token")).alias("block")).join(_small(wide), ["len", "block"]).where(same).select("token", "term").distinct()
    return counts.join(close, "token").select(key, "term", "token", "n")


def _near_runs(words: Column, gaps: Column, longest: int) -> Column:
    """Runs of 1 to ``longest`` words with no gap above MAX_GAP; ``gaps``: length before each word, and behind the last."""

    def runs(n: int) -> Column:
        near = F.filter(F.sequence(F.lit(1), F.size(words) - n + 1), lambda i: F.forall(F.slice(gaps, i + 1, F.lit(n - 1)), lambda g: g <= MAX_GAP))
        return F.transform(near, lambda i: F.array_join(F.slice(words, i, F.lit(n)), " "))

    return F.flatten(F.array(*[F.when(F.size(words) >= n, runs(n)).otherwise(F.array().cast("array<string>")) for n in range(1, longest + 1)]))


def _forms(terms: DataFrame) -> DataFrame:
    """``term, folded, near``: the spellings of each term; near: an edit is allowed."""
    rows = terms.select("term", F.transform(_tokens(F.col("term")), fold_for_compare).alias("w"))
    two = (F.size("w") == 2) & (F.size(F.split(F.trim("term"), r"\s+")) == 2)

    def form(words: Column, near: bool) -> Column:
        return F.struct(words.alias("folded"), (F.lit(near) & (F.length(words) >= MIN_FUZZY)).alias("near"))

    a, b = F.get("w", 0), F.get("w", 1)
    initial = F.left(a, F.lit(1))
    own = form(F.array_join("w", " "), True)
    more = F.array(own, form(F.concat_ws(" ", b, a), True), form(F.concat_ws(" ", initial, b), False), form(F.concat_ws(" ", b, initial), False))
    return rows.where(F.size("w") > 0).select("term", F.explode(F.when(two, more).otherwise(F.array(own))).alias("f")).select("term", "f.*")
