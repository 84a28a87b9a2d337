"""What a note's content says, for Arrow batches: each content is lowered once and every keyword is looked for in it.

The same rules as the column expressions in operators/analysis, enhancement and japanese, where each keyword
is a search of its own within an expression that Spark interprets. Words are taken here only from texts of
signs that Java and Python class alike; for other texts that part is null, and the expressions give it.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from notemill.functions import scan
from notemill.functions.dictionaries import ABBREVIATIONS, CATEGORIES, CONTENT_TAGS, KEYWORD_TAGS, METADATA, PAIRS, PLACEHOLDERS
from notemill.functions.text import BLANKS

# Fixed value: keywords that make a tag sure enough.
KEYWORDS = 3
_STRINGS = "array<string>"
#: What each kind of facts holds.
KINDS = {
    "checks": f"struct<tags:{_STRINGS},confidence:double,categories:{_STRINGS},description:string,short:boolean,unfinished:boolean>",
    "names": f"struct<keyword_tags:{_STRINGS},terms:{_STRINGS},other_names:{_STRINGS}>",
    "meta": f"struct<{','.join(f'{k}:string' for k in METADATA)}>",
    "words": f"struct<word_count:int,reading_time:int,language:string,hashtags:{_STRINGS},near:{_STRINGS}>",
}

#: Texts of these signs alone have the same words in Java and Python, but for SMALL, which are digits to Python only.
_SETTLED = re.compile("[\x00-įĲ-ɏ‐-‧‰-‾€、。「」ぁ-ゖァ-ヿ一-龥]*")
_SMALL = "\xb2\xb3\xb9\xbc\xbd\xbe"
_WORD = re.compile(rf"[^\W{_SMALL}]+")
_HASHTAG = re.compile(rf"#([^\W{_SMALL}]+)")
#: Makes blanks of all ASCII signs that are no part of a word.
_BLANKED = {i: " " for i in range(128) if not (chr(i).isalnum() or chr(i) == "_")}
_JAPANESE = re.compile("[぀-ゟ゠-ヿ一-龯]")
#: Signs that equal a letter without regard to case, beside its capital.
_FOLDED = {0x130: "i", 0x131: "i", 0x17F: "s", 0x212A: "k"}
_FOLDS = re.compile("[\u0130\u0131\u017f\u212a]")


def _fold(content: str, low: str) -> str:
    return low if content.isascii() or not _FOLDS.search(content) else content.translate(_FOLDED).lower()


def description(content: str) -> str | None:
    text = ""
    for line in content.split("\n"):
        x = line.strip(BLANKS)
        if x == "":
            if text:
                break
        elif not x.startswith("#"):
            text += x + " "
            if len(text) > 200:
                break
    first = text.strip(BLANKS)
    return None if first == "" else first[:147] + "..." if len(first) > 150 else first


_UNFINISHED = [p.lower() for p in PLACEHOLDERS]
_NAMES = [(term, [n.lower() for n in (term, *names)]) for term, names in (*PAIRS, *ABBREVIATIONS)]
_CHECKED = {k for _, words, *_ in (*CONTENT_TAGS, *CATEGORIES) for k in words}
_NAMED = {n for _, names in _NAMES for n in names} | {w for *_, words in KEYWORD_TAGS for w in words}


def _checks(content: str, low: str) -> dict:
    held = {k for k in _CHECKED if k in low}
    found = [(sum(k in held for k in words), tags) for _, words, tags in CONTENT_TAGS if not held.isdisjoint(words)]
    folded = _fold(content, low)
    return {
        "tags": sorted({t for _, tags in found for t in tags}),
        "confidence": max((min(0.9, n * 0.3) for n, _ in found), default=0.0),
        "categories": [name for name, words in CATEGORIES if not held.isdisjoint(words)][:2],
        "description": description(content),
        "short": len(content.strip(BLANKS)) < 100,
        "unfinished": any(p in folded for p in _UNFINISHED),
    }


def _names(content: str, low: str) -> dict:
    held = {n for n in _NAMED if n in low}
    groups = [(narrow, wide) for wide, narrow, words in KEYWORD_TAGS if sum(w in held for w in words) >= KEYWORDS]
    terms = dict.fromkeys(term.lower() for term, names in _NAMES if not held.isdisjoint(names))
    other: list[str] = []
    for term, names in PAIRS:
        other += names if term.lower() in held else ()
        other += [term for n in names if not content.isascii() and n in content]
    return {"keyword_tags": list(dict.fromkeys(t for group in groups for t in group)), "terms": [f"tech-{t}" if len(t) <= 3 else t for t in terms], "other_names": list(dict.fromkeys(other))}


def _said(pattern: str) -> tuple[list[str], re.Pattern]:
    r"""The words before the colon, and a pattern of METADATA with Java's meaning: \s and \d are ASCII."""
    words = re.search(r"\(\?:([^)]*)\)\[:\]", pattern)[1].split("|")
    return [f"{w}:" for w in words], re.compile(pattern.removeprefix("(?iu)").replace(r"\s", r"[ \t\n\x0b\f\r]").replace(r"\d", "[0-9]"), re.IGNORECASE)


_SAID = {name: _said(pattern) for name, pattern in METADATA.items()}


def _meta(content: str, low: str) -> dict:
    folded, out = _fold(content, low), {}
    for name, (signs, pattern) in _SAID.items():
        hit = pattern.search(content) if any(s in folded for s in signs) else None
        out[name] = hit[1].strip(BLANKS) if hit else None
    return out


def _words(content: str, low: str, near: dict[str, list[str]]) -> dict | None:
    plain = content.isascii()
    if not plain and not _SETTLED.fullmatch(content):
        return None
    words = low.translate(_BLANKED).split() if plain else _WORD.findall(low)
    english = sum(map(str.isalpha, words)) if plain else sum(w.isascii() and w.isalpha() for w in words)
    japanese = 0 if plain else len(_JAPANESE.findall(content))
    return {
        "word_count": len(words),
        "reading_time": max(1, len(words) // 200),
        "language": "japanese" if japanese > english * 2 else "english" if english > 10 else "mixed",
        "hashtags": sorted({t for t in _HASHTAG.findall(low) if len(t) > 2}) if "#" in content else [],
        "near": list(dict.fromkeys(t for w in near.keys() & set(words) for t in near[w])) if near else [],
    }


def read(notes: DataFrame, *kinds: str, near: dict[str, list[str]] | None = None) -> DataFrame:
    """notes with facts, a struct of the kinds asked for (see KINDS); a null content has none.

    near are the tags by their words, of which a note gets those with a word in its content.
    """
    found: dict[str, Callable] = {"checks": _checks, "names": _names, "meta": _meta, "words": lambda content, low: _words(content, low, near or {})}
    spark_type = T.DataType.fromDDL(f"struct<{','.join(f'{k}:{KINDS[k]}' for k in kinds)}>")
    schema = T.StructType([*notes.schema.fields, T.StructField("facts", spark_type)])
    arrow = _arrow(spark_type)

    def facts(content: str | None) -> dict | None:
        if content is None:
            return None
        low = content.lower()
        return {k: found[k](content, low) for k in kinds}

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in scan.in_parts(batches):
            made = pa.array([facts(c) for c in batch.column("content").to_pylist()], arrow)
            yield pa.RecordBatch.from_arrays([*batch.columns, made], names=[*batch.schema.names, "facts"])

    return notes.mapInArrow(of, schema)


def _arrow(kind: T.DataType) -> pa.DataType:
    if isinstance(kind, T.StructType):
        return pa.struct([(f.name, _arrow(f.dataType)) for f in kind])
    if isinstance(kind, T.ArrayType):
        return pa.list_(_arrow(kind.elementType))
    return {"string": pa.string(), "double": pa.float64(), "int": pa.int32(), "boolean": pa.bool_()}[kind.simpleString()]
