"""Search over documents by an inverted index."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import fold, let
from ..sources.tables import scratch, stored

#: Field weights of the ranked search (fixed values).
WEIGHTS = {"title": 10.0, "alternate_titles": 10.0, "subjects": 5.0, "summary": 2.0, "holdings": 2.0}


_POSSESSIVE = r"(?i)(\p{L})'s(?![\p{L}\p{N}])"


def _apart(c: Column) -> Column:
    """A text with a blank where letters and digits, or lower and upper case, change; possessive endings go."""
    c = F.regexp_replace(c, _POSSESSIVE, "$1")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"(\p{Ll})(\p{Lu})", "$1 $2"), r"(\p{L})(?=\p{N})", "$1 "), r"(\p{N})(?=\p{L})", "$1 ")


def tokens(c: Column) -> Column:
    """Words of a text: split at blanks, at changes of letters and digits and of lower and upper case, folded."""
    return F.filter(F.split(fold(_apart(c)), r"[^\p{L}\p{N}]+"), lambda w: w != "")


#: Words of one part, and such with ASCII marks around them.
_PLAIN_WORD = r"^(\p{Lu}*\p{Ll}*|\p{N}+)$"
_MARKS = r"[!-&(-/:-@\[-`{-~]*"
_ASCII_MARKS = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum())
_MARKED_WORD = rf"^{_MARKS}(\p{{Lu}}*\p{{Ll}}+|\p{{Lu}}+|\p{{N}}+){_MARKS}$"


def indexed_tokens(c: Column) -> Column:
    """Array of arrays: the distinct tokens that stand at each position of a text.

    Every part of a word between blanks has a position.  Where the word
    begins, the word itself and all its parts in one stand too; where a run of
    letter parts begins, the run in one.  All are folded.
    """
    none = F.array().cast("array<string>")
    letters = lambda p: p.rlike(r"^\p{L}")

    def at_places(parts: Column, folded: Column) -> Column:
        def here(part: Column, i: Column) -> Column:
            begins = letters(part) & ((i == 0) | ~letters(F.get(parts, i - 1)))
            rest = F.slice(parts, i + 1, F.size(parts))
            numbers = F.filter(F.transform(rest, lambda p, k: F.when(~letters(p), k)), lambda k: k.isNotNull())
            run = F.array_join(F.slice(rest, 1, F.coalesce(F.get(numbers, 0), F.size(rest))), "")
            whole = F.when(i == 0, F.array(folded, F.array_join(parts, ""))).otherwise(none)
            return F.array_distinct(F.concat(F.array(part), whole, F.when(begins, F.array(run)).otherwise(none)))

        return F.transform(parts, here)

    def of_word(w: Column) -> Column:
        folded = w["folded"]
        bare = F.array(F.array(F.translate(folded, _ASCII_MARKS, ""), folded))
        return F.when(w["raw"].rlike(_PLAIN_WORD), F.array(F.array(folded))).when(w["raw"].rlike(_MARKED_WORD), bare).otherwise(let(tokens(w["raw"]), lambda parts: at_places(parts, folded)))

    # The text is folded as a whole; blanks stay where they are.
    words = F.arrays_zip(F.split(c, r"\s").alias("raw"), F.split(fold(c), r"\s").alias("folded"))
    return F.flatten(F.transform(F.filter(words, lambda w: w["raw"] != ""), of_word))


def token_index(df: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """Q1: (key, field, position, token): at each position the part of a word and the catenations that begin there, each once."""
    parts = [df.select(key, F.lit(f).alias("field"), F.posexplode(indexed_tokens(F.col(f))).alias("position", "_tokens")) for f in fields]
    return reduce(DataFrame.unionByName, parts).select(key, "field", "position", F.explode("_tokens").alias("token"))


def store_index(index: DataFrame, name: str, key: str, buckets: int = 64, spread: int = 8) -> DataFrame:
    """Q1: an index written as the table ``name``, bucketed and sorted by token; returned as it is read back.

    Whoever asks for some words reads their buckets alone, and in these the row
    groups that can hold them.  The rows of a token are dealt over ``spread``
    tasks and files, so that a word that stands everywhere is no task of its
    own.  The table is replaced where it exists.
    """
    spark = index.sparkSession
    dealt = index.repartition(buckets * spread, F.col("token"), F.pmod(F.xxhash64(key, "field"), F.lit(spread)))
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    dealt.write.bucketBy(buckets, "token").sortBy("token", key).option("path", scratch(spark, name)).option("compression", "zstd").saveAsTable(name)
    return spark.table(name)


def squeezed(c: Column) -> Column:
    """A text's folded letters and digits without all between them: each token of letters and digits alone stands in it, catenations included."""
    bare = F.regexp_replace(fold(F.regexp_replace(c, _POSSESSIVE, "$1")), r"[^\p{L}\p{N}]+", "")
    return F.translate(bare, "ς", "σ")  # a small sigma is written by what follows it


def _stands(text: Column, piece: str) -> Column:
    """Whether a squeezed text may hold a word: false only if it does not."""
    return text.contains(piece.replace("ς", "σ")) if piece.isalnum() else F.lit(True)


def _may_answer(text: Column, anyof: Sequence[str] = (), allof: Sequence[str] = (), noneof: Sequence[str] = ()) -> Column:
    tests = [_stands(text, w) for w in allof]
    if anyof:
        tests.append(reduce(lambda a, b: a | b, [_stands(text, w) for w in anyof]))
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def phrase_pieces(phrase: Sequence[str]) -> list[str]:
    """What stands in one piece in the squeezed text wherever the words stand one after another.

    Where a word may be a catenation that reaches into the next position, the
    next word would begin inside it: there the phrase is cut.
    """
    pieces = [""]
    for i, word in enumerate(phrase):
        pieces[-1] += word
        if i + 1 < len(phrase) and (not word.isalnum() or not phrase[i + 1].isalnum() or phrase[i + 1][0].replace("ς", "σ") in word[1:].replace("ς", "σ")):
            pieces.append("")
    return pieces


def text_hits(df: DataFrame, key: str, fields: Sequence[str], words: Sequence[str], test=None) -> DataFrame:
    """(key, field, hits): where some words stand in texts, hits an array of (token, position) as the index has them; null where a row's squeezed texts fail a test."""

    def hits(c: Column) -> Column:
        kept = lambda ts, i: F.transform(F.filter(ts, lambda t: t.isin(*words)), lambda t: F.struct(t.alias("token"), i.alias("position")))
        return F.flatten(F.transform(indexed_tokens(c), kept))

    passed = let(squeezed(F.concat_ws(" ", *fields)), test) if test else F.lit(True)
    return reduce(DataFrame.unionByName, [df.select(key, F.lit(f).alias("field"), let(F.when(passed, F.col(f)), hits).alias("hits")) for f in fields])


def text_index(df: DataFrame, key: str, fields: Sequence[str], words: Sequence[str], test=None) -> DataFrame:
    """The rows of ``token_index`` with some words alone, of rows whose squeezed texts pass a test.

    Stored before they are exploded, for Spark asks first whether an array is
    empty: a text would be taken apart twice.
    """
    rows = stored(text_hits(df, key, fields, words, test), "search-hits").select(key, "field", F.explode("hits").alias("_hit"))
    return rows.select(key, "field", "_hit.position", "_hit.token")


def keyword_filter_texts(df: DataFrame, key: str, fields: Sequence[str], anyof: Sequence[str] = (), allof: Sequence[str] = (), noneof: Sequence[str] = ()) -> DataFrame:
    """Q2 of texts that have no index: those that hold the letters of enough words are taken apart, all others only read."""
    if not anyof and not allof:
        return keyword_filter(token_index(df, key, fields), key, noneof=noneof)
    index = text_index(df, key, fields, sorted({*anyof, *allof, *noneof}), lambda t: _may_answer(t, anyof, allof))
    return keyword_filter(index, key, anyof, allof, noneof)


def phrase_filter_texts(df: DataFrame, key: str, fields: Sequence[str], phrase: Sequence[str], slop: int = 0) -> DataFrame:
    """Q3 of texts that have no index: those that hold the phrase's letters in one piece (with slop: all its words' letters) are taken apart."""
    index = text_index(df, key, fields, sorted(set(phrase)), lambda t: _may_answer(t, allof=phrase if slop else phrase_pieces(phrase)))
    return phrase_filter(index, key, phrase, slop)


def search_texts(df: DataFrame, key: str, fields: Sequence[str], *questions: Mapping[str, Sequence[str]]) -> DataFrame:
    """Q5 of texts that have no index: rows that every question (anyof, allof, noneof) finds; texts that may answer all of them are taken apart, once."""
    if any(not q.get("anyof") and not q.get("allof") for q in questions):
        index = token_index(df, key, fields)
    else:
        words = sorted({w for q in questions for ws in q.values() for w in ws})
        index = text_index(df, key, fields, words, lambda t: reduce(lambda a, b: a & b, [_may_answer(t, **q) for q in questions]))
    return search(df, key, *[keyword_filter(index, key, **q) for q in questions])


def keyword_filter(index: DataFrame, key: str, anyof: Sequence[str] = (), allof: Sequence[str] = (), noneof: Sequence[str] = ()) -> DataFrame:
    """Q2: keys of documents with any, all and none of given words.  With only excluded words: all documents of the index but theirs."""
    wanted = sorted({*anyof, *allof, *noneof})
    hits = index.where(F.col("token").isin(*wanted)).groupBy(key).agg(F.collect_set("token").alias("_hits"))
    have = lambda ws: F.array(*[F.lit(w) for w in ws])
    out = hits
    if anyof:
        out = out.where(F.arrays_overlap("_hits", have(anyof)))
    if allof:
        out = out.where(F.size(F.array_except(have(sorted(set(allof))), F.col("_hits"))) == 0)
    if noneof and (anyof or allof):
        out = out.where(~F.arrays_overlap("_hits", have(noneof)))
    elif noneof:
        return index.select(key).distinct().join(hits.where(F.arrays_overlap("_hits", have(noneof))).select(key), key, "left_anti")
    return out.select(key)


def phrase_places(index: DataFrame, key: str, phrase: Sequence[str], slop: int = 0) -> DataFrame:
    """(key, field) where the words of a phrase stand one after another, each up to ``slop`` places late."""
    of = {w: [i for i, x in enumerate(phrase) if x == w] for w in phrase}
    nths = F.create_map(*[x for w, at in of.items() for x in (F.lit(w), F.array(*map(F.lit, at)))])[F.col("token")]
    found = index.where(F.col("token").isin(*of)).select(key, "field", "position", F.explode(nths).alias("nth"))
    start = F.explode(F.sequence(F.col("position") - F.col("nth") - slop, F.col("position") - F.col("nth"))) if slop else F.col("position") - F.col("nth")
    starts = found.select(key, "field", "nth", start.alias("start")).groupBy(key, "field", "start").agg(F.count_distinct("nth").alias("n"))
    return starts.where(F.col("n") == len(phrase)).select(key, "field").distinct()


def phrase_filter(index: DataFrame, key: str, phrase: Sequence[str], slop: int = 0) -> DataFrame:
    """Q3: keys of documents with the words one after another in one field; with slop up to that many places late."""
    return phrase_places(index, key, phrase, slop).select(key).distinct()


def least_matches(n: int) -> int:
    """Up to two words: all; beyond, 80 % rounded down."""
    return n if n <= 2 else int(0.8 * n)


#: Field weights of phrases, and how far from each other the words of the whole query and of a pair of it may stand (fixed values).
PHRASE_WEIGHTS = {"title": 10.0, "alternate_titles": 10.0, "subjects": 5.0, "summary": 5.0, "holdings": 5.0}
PHRASE_SLOP, PAIR_SLOP = 2, 1


def _weight(weights: Mapping[str, float]) -> Column:
    (first, w), *rest = weights.items()
    return reduce(lambda c, kv: c.when(F.col("field") == kv[0], F.lit(kv[1])), rest, F.when(F.col("field") == first, F.lit(w)))


def _stands_as_phrase(places: Mapping[str, Column], phrase: Sequence[str], slop: int) -> Column:
    """Whether words stand one after another in one text, each up to ``slop`` places late, by the places of each."""

    def starts(i: int, word: str) -> Column:
        late = lambda p: F.sequence(p - i - slop, p - i)
        return F.array_distinct(F.flatten(F.transform(places[word], late))) if slop else F.transform(places[word], lambda p: p - i)

    return F.size(reduce(F.array_intersect, [starts(i, w) for i, w in enumerate(phrase)])) > 0


def ranked_search(index: DataFrame, key: str, query: Sequence[str], n_documents: int, weights: Mapping[str, float] = WEIGHTS, least: int | None = None, phrase_weights: Mapping[str, float] = PHRASE_WEIGHTS) -> DataFrame:
    """Q4: (key, matched, score) of documents with enough of the query's words.

    Score: per word the best field's weight x frequency x ln(1 + N / df),
    summed over words; then for the whole query and for each pair of words
    that follow each other in it, where they stand as a phrase, the best
    field's phrase weight x the sum of their words' ln(1 + N / df).
    """
    asked = index.where(F.col("token").isin(*query) & F.col("field").isin(*{**weights, **phrase_weights}))
    hits = asked.groupBy(key, "field").agg(F.collect_list(F.struct("token", "position")).alias("hits"))
    return _ranked(hits, key, query, n_documents, weights, least, phrase_weights)


def ranked_search_texts(df: DataFrame, key: str, query: Sequence[str], n_documents: int, weights: Mapping[str, float] = WEIGHTS, least: int | None = None, phrase_weights: Mapping[str, float] = PHRASE_WEIGHTS) -> DataFrame:
    """Q4 of texts that have no index, whose fields are columns: texts that hold the letters of none of the words are only read."""
    fields = [f for f in {**weights, **phrase_weights} if f in df.columns]
    hits = text_hits(df, key, fields, sorted(set(query)), lambda t: _may_answer(t, anyof=query))
    return _ranked(hits, key, query, n_documents, weights, least, phrase_weights)


def _ranked(hits: DataFrame, key: str, query: Sequence[str], n_documents: int, weights: Mapping[str, float], least: int | None, phrase_weights: Mapping[str, float]) -> DataFrame:
    """Q4 of (key, field, hits) rows: what a text gains is told from its own row, so that a few numbers a document are all that is shuffled and stored."""
    words = sorted(set(query))
    of = lambda w: F.filter("hits", lambda h: h["token"] == w)
    places = {w: F.transform(of(w), lambda h: h["position"]) for w in words}
    phrases = [(tuple(query), PHRASE_SLOP)] if len(query) > 1 else []
    phrases += [((a, b), PAIR_SLOP) for a, b in zip(query, query[1:], strict=False)]
    tf = {w: F.size(of(w)) for w in words}
    gains = [F.max(F.when(F.col("field").isin(*weights) & (tf[w] > 0), _weight(weights) * tf[w])).alias(f"_g{i}") for i, w in enumerate(words)]
    more = [F.max(F.when(F.col("field").isin(*phrase_weights) & _stands_as_phrase(places, p, slop), _weight(phrase_weights))).alias(f"_p{i}") for i, (p, slop) in enumerate(phrases)]
    gained = stored(hits.groupBy(key).agg(*gains, *more), "search-gains")
    df = gained.agg(*[F.count(f"_g{i}") for i in range(len(words))]).first()
    rarity = {w: math.log(1 + n_documents / n) if n else 0.0 for w, n in zip(words, df, strict=True)}
    zero = F.lit(0.0)
    total = lambda terms: reduce(lambda a, b: a + b, terms, zero)
    score = total([F.coalesce(F.col(f"_g{i}") * rarity[w], zero) for i, w in enumerate(words)])
    score += total([F.coalesce(F.col(f"_p{i}") * sum(rarity[w] for w in p), zero) for i, (p, _) in enumerate(phrases)])
    matched = reduce(lambda a, b: a + b, [F.col(f"_g{i}").isNotNull().cast("long") for i in range(len(words))])
    enough = least_matches(len(words)) if least is None else least
    return gained.select(key, matched.alias("matched"), F.round(score, 6).alias("score")).where((F.col("matched") > 0) & (F.col("matched") >= enough))


def search(df: DataFrame, key: str, *found: DataFrame) -> DataFrame:
    """Q5: rows that every search found."""
    return reduce(lambda d, f: d.join(f.select(key), key, "left_semi"), found, df)


def prefixes(c: Column) -> Column:
    """Left-anchored shingles: prefixes that end where letters, digits and other marks change, and the whole."""
    n = F.length(c)
    kind = lambda i: F.when(F.substring(c, i, 1).rlike(r"\p{L}"), "a").when(F.substring(c, i, 1).rlike(r"\p{N}"), "n").otherwise("o")
    ends = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: (i == n) | ((i < n) & (kind(i) != "o") & (kind(i) != kind(i + 1))))
    return F.transform(ends, lambda i: F.substring(c, F.lit(1), i))


def callnumber_index(df: DataFrame, key: str, column: str) -> DataFrame:
    """Q6: (prefix, key); ask it by equality on the prefix."""
    return df.where(F.col(column).isNotNull() & (F.col(column) != "")).select(key, F.explode(prefixes(F.col(column))).alias("prefix"))


def copy_fields(df: DataFrame, sources: Mapping[str, Sequence[str]]) -> DataFrame:
    """Q7: search columns, each an array of what its source columns hold."""
    kinds = dict(df.dtypes)
    as_array = lambda c: F.coalesce(F.col(c), F.array().cast("array<string>")) if kinds[c].startswith("array") else F.array(F.col(c).cast("string"))
    return df.withColumns({out: F.filter(F.flatten(F.array(*map(as_array, cols))), lambda v: v.isNotNull()) for out, cols in sources.items()})
