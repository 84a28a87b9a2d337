"""Japanese and English names of the same things: dictionary hits, technical tags, aliases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notemill.functions.dictionaries import ABBREVIATIONS, PAIRS
from notemill.functions.text import let
from notemill.operators.mentions import variations


def _hits(content: Column, table: tuple[tuple[str, tuple[str, ...]], ...]) -> Column:
    """array<struct<term, matched>>: for each entry the first of its name and other names that the text contains."""

    def of(low: Column) -> Column:
        each = [F.struct(F.lit(term).alias("term"), F.coalesce(*[F.when(F.contains(low, F.lit(n.lower())), F.lit(n)) for n in (term, *names)]).alias("matched")) for term, names in table]
        return F.filter(F.array(*each), lambda h: h["matched"].isNotNull())

    return let(F.lower(content), of)


def matches(notes: DataFrame) -> DataFrame:
    """(path, term, matched, kind): pairs and abbreviations found in the texts, as substrings."""
    kinds = F.concat(F.transform(_hits(F.col("content"), PAIRS), lambda h: h.withField("kind", F.lit("pair"))), F.transform(_hits(F.col("content"), ABBREVIATIONS), lambda h: h.withField("kind", F.lit("abbreviation"))))
    return notes.select("path", F.explode(kinds).alias("h")).select("path", "h.term", "h.matched", "h.kind")


def term_tags(content: Column) -> Column:
    """array<string>: lower-case terms of the hits in the order of the dictionary, short ones with tech- before them."""
    terms = F.array_distinct(F.transform(F.concat(_hits(content, PAIRS), _hits(content, ABBREVIATIONS)), lambda h: F.lower(h["term"])))
    return F.transform(terms, lambda t: F.when(F.length(t) <= 3, F.concat(F.lit("tech-"), t)).otherwise(t))


def technical_tags(notes: DataFrame) -> DataFrame:
    """(path, tags): the terms of the hits as tags, without the note's own tags."""
    return notes.select("path", F.array_sort(F.array_except(term_tags(F.col("content")), "tags")).alias("tags"))


def _other_names(text: Column) -> Column:
    """array<string>: for each pair with its English name in the text the Japanese ones, and the English name for each Japanese one in it."""

    def of(t: Column) -> Column:
        low = F.lower(t)
        each = []
        for term, names in PAIRS:
            each.append(F.when(F.contains(low, F.lit(term.lower())), F.array(*[F.lit(n) for n in names])))
            each += [F.when(F.contains(t, F.lit(n)), F.array(F.lit(term))) for n in names]
        return F.array_distinct(F.flatten(F.array_compact(F.array(*each))))

    return let(text, of)


def content_aliases(content: Column, title: Column, own: Column) -> Column:
    """array<string>: names in the other language of what the content names, other spellings of the note's aliases, and names of the title, without the title and the aliases."""
    return other_aliases(_other_names(content), title, own)


def other_aliases(named: Column, title: Column, own: Column) -> Column:
    """The aliases of content_aliases, for a content whose names in the other language are known."""
    spelled = F.flatten(F.transform(own, variations))
    found = F.array_distinct(F.concat(named, spelled, _other_names(F.coalesce(title, F.lit("")))))
    return F.filter(F.array_except(found, own), lambda n: F.lower(n) != F.lower(F.coalesce(title, F.lit(""))))


def aliases(notes: DataFrame) -> DataFrame:
    """(path, aliases): other spellings of the title and, for a title in the dictionary, its names in the other language."""
    other = F.array().cast("array<string>")
    for term, names in PAIRS:
        ja = F.array(*[F.lit(n) for n in names])
        other = F.when(F.upper("title") == term, ja).when(F.array_contains(ja, F.col("title")), F.array(F.lit(term.lower()), F.lit(term))).otherwise(other)
    found = F.array_distinct(F.concat(variations(F.col("title")), other))
    return notes.where("title IS NOT NULL").select("path", F.array_sort(F.array_except(found, F.concat("aliases", F.array("title")))).alias("aliases"))


def opportunities(notes: DataFrame) -> DataFrame:
    """(notes, japanese, mixed, technical): how many have Japanese text, both scripts, and dictionary hits."""
    ja = F.col("content").rlike("[぀-ヿ一-龯]")
    hit = F.size(F.concat(_hits(F.col("content"), PAIRS), _hits(F.col("content"), ABBREVIATIONS))) > 0
    return notes.agg(F.count("*").alias("notes"), F.count_if(ja).alias("japanese"), F.count_if(ja & F.col("content").rlike("[A-Za-z]")).alias("mixed"), F.count_if(hit).alias("technical"))


def _has_spellings(word: Column) -> Column:
    """Whether a word has another spelling or is a name of a pair."""
    names = F.array(*[F.lit(n) for _, names in PAIRS for n in names])
    return (F.size(variations(word)) > 0) | F.array_contains(names, word)


def linking_opportunities(notes: DataFrame) -> DataFrame:
    """(notes, japanese, mixed, katakana_variations, cross_references, technical_terms, japanese_percentage, mixed_percentage) of a vault.

    japanese and mixed count notes with Japanese signs, and with English words beside them.
    The others count occurrences: words in katakana that have another spelling or name; the
    names in the other language of what a text names, from either side; the English names
    of pairs in a text. A text is cut into its katakana words in one pass.
    """
    text, low = F.col("content"), F.lower("content")
    ja, en = F.regexp_count(text, F.lit("[぀-ゟ゠-ヿ一-龯]")) > 0, F.regexp_count(text, F.lit(r"\b[a-zA-Z]+\b")) > 0
    katakana = F.size(F.filter(F.regexp_extract_all(text, F.lit("[゠-ヿ]+"), F.lit(0)), _has_spellings))

    def counted(x: Column) -> Column:
        english = [F.contains(x["low"], F.lit(t.lower())) for t, _ in PAIRS]
        from_english = sum((F.when(e, len(names)).otherwise(0) for e, (_, names) in zip(english[1:], PAIRS[1:], strict=True)), F.when(english[0], len(PAIRS[0][1])).otherwise(0))
        from_japanese = sum((F.contains(x["text"], F.lit(n)).cast("int") for _, names in PAIRS for n in names), F.lit(0))
        return F.struct((from_english + from_japanese).alias("crossed"), sum((e.cast("int") for e in english[1:]), english[0].cast("int")).alias("named"))

    each = notes.select(ja.alias("ja"), en.alias("en"), katakana.alias("katakana"), let(F.struct(text.alias("text"), low.alias("low")), counted).alias("c"))
    n, both = F.count("*"), F.col("ja") & F.col("en")
    share = lambda c: F.when(n > 0, F.count_if(c) / n * 100).otherwise(0.0)
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return each.agg(
        n.alias("notes"),
        F.count_if("ja").alias("japanese"),
        F.count_if(both).alias("mixed"),
        total("katakana").alias("katakana_variations"),
        total("c.crossed").alias("cross_references"),
        total("c.named").alias("technical_terms"),
        share(F.col("ja")).alias("japanese_percentage"),
        share(both).alias("mixed_percentage"),
    )
