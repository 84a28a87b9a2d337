from pyspark.sql import functions as F

from notemill.functions import facts, text
from notemill.functions.dictionaries import METADATA, PLACEHOLDERS
from notemill.operators import analysis, enhancement, japanese, tags
from tests.test_links import COLUMNS, note

ODD = [
    "", " \n\t", None, "# only\n# heads", "　first \n\nsecond", "a\r\nb\x85c\n  \nd", "x" * 300, "w " * 120, "# h\n" + "long line\n" * 40,
    "Author:\n\n  Ann Lee 　\nFROM: here\nsource:  \ndate: 2020-01-02 created:2021-1-1 created: 2021-12-31\nSTATUS:  In-Progress project:",
    "author:   ", "著者: 山田\n出典:本\n作成日: 2020-02-03 プロジェクト: 甲 状態: todo", "ſource: long s, Kanji, PLACEHOLDER, comİng soon, comıng ſoon, FıXME", "未完成 TODO", "to be\nwritten", "TO BE WRITTEN",
    "café d'été naïve Straße ª º x² ½ 3¼ ÷ × “quoted” – it’s … €5 #tag² #étéÉ #ab #abc #ABC", "日本語のテキスト、機械学習とデータベース。API と REST 々〇 仮想現実 サーバー #本棚 #読書会",
    "éà combining ‿ tie ⁀ ⁔ zero‍width‌ joiner Ⓐⓐ Ⅷ ٣ १२ ² \U0001d7d8 \U0001f130 𠮷 İstanbul #éáx", "Ωμέγα ΣΑΣ привет мир 한국어 #привет",
    "python py django code programming software class book chapter note idea sql mysql redis aws docker kubernetes rest nosql oop db ui work company business", "design pattern architecture microservice monolith; ci/cd jenkins github actions",
    "en fr de web blog " * 6,
]


def odd_notes(spark):
    return spark.createDataFrame([note(f"v/n{i}.md", c, str(i), ("API 機械学習", "", "Web db")[i % 3], ["サーバー"] if i % 2 else [], ["code", "fr"][: i % 3]) for i, c in enumerate(ODD)], COLUMNS)


def test_facts_are_those_of_the_expressions(spark):
    c = F.col("content")
    read = facts.read(odd_notes(spark), "checks", "names", "meta", "words", near={"web": ["web"], "en": ["en", "x-en"], "été": ["été"], "読書会": ["r"]})
    said = [F.when(F.regexp_extract(c, p, 1) != "", text.strip(F.regexp_extract(c, p, 1))).alias(k) for k, p in METADATA.items()]
    sure = analysis.content_tags(c)
    checks = F.struct(sure["tags"], sure["confidence"], analysis.category(c), text.description(c), F.length(text.strip(c)) < 100, c.rlike("(?iu)" + "|".join(PLACEHOLDERS)))
    names = F.struct(enhancement.keyword_tags(c), japanese.term_tags(c), japanese._other_names(c))
    n = analysis.counted(c)
    words = F.struct(n["word_count"], n["reading_time"], n["language"], enhancement.hashtags(c), enhancement._looked_up(c, {"web": ["web"], "en": ["en", "x-en"], "été": ["été"], "読書会": ["r"]}))
    rows = read.where("content IS NOT NULL").select("content", "facts", checks.alias("checks"), names.alias("names"), F.struct(*said).alias("meta"), words.alias("words")).collect()
    open_words = 0
    for r in rows:
        assert tuple(r.facts.checks) == tuple(r.checks), r.content
        assert tuple(r.facts.names) == tuple(r.names), r.content
        assert tuple(r.facts.meta) == tuple(r.meta), r.content
        open_words += r.facts.words is None
        if r.facts.words is not None:
            assert [sorted(x) if isinstance(x, list) else x for x in r.facts.words] == [sorted(x) if isinstance(x, list) else x for x in r.words], r.content
    assert len(rows) == len(ODD) - 1 and 0 < open_words < 8


def test_few_tags_and_many_enhance_alike(spark):
    notes = odd_notes(spark)
    of = lambda few: {r.path: (r.tags, r.changes, r.fields) for r in enhancement.enhanced(notes, tags.frequencies(notes).unionByName(spark.createDataFrame([("web-blog", 1), ("読書会", 1), ("привет", 1)], "tag string, files long")), few=few).collect()}
    looked_up, joined = of(256), of(1)
    assert looked_up == joined and len(joined) == len(ODD) and "web-blog" in looked_up[f"v/n{len(ODD) - 1}.md"][0] and any("привет" in t for t, *_ in joined.values())


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_contents_are_read_once(spark):
    """A content meets no join, and no filter inferred from an explode makes the findings a second time."""
    notes = odd_notes(spark)
    done = enhancement.enhanced(notes, tags.frequencies(notes))
    for made in (done, enhancement.summary(done), analysis.improvement_counts(analysis.improvements(notes)), analysis.categorised(analysis.improvements(notes))):
        plan = _plan(made)
        assert plan.count("MapInArrow") == 1 and "Join" not in plan and "size(" not in "".join(x for x in plan.split("\n") if "Filter" in x)
