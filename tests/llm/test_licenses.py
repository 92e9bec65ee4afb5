"""License templates against a plain matcher that tries everything."""

import random
import re

import pytest
from pyspark.sql import functions as F

from contentdup.llm import licenses
from contentdup.llm.licenses import (
    PHRASES,
    TEMPLATES,
    Automaton,
    Either,
    Gap,
    parse_template,
    read_text,
    scan_licenses,
    words_of,
)
from contentdup.llm.queries import op11_license_templates
from tests.llm.cases import documents, rows_of


def ends_of(items, words, at):
    """All places where a match that begins at ``at`` may end."""
    if not items:
        return {at}
    item, rest = items[0], items[1:]
    if isinstance(item, bytes):
        return ends_of(rest, words, at + 1) if words[at : at + 1] == [item] else set()
    if isinstance(item, list):
        return ends_of(item + rest, words, at) | ends_of(rest, words, at)
    if isinstance(item, Either):
        return set().union(*(ends_of([*wording, *rest], words, at) for wording in item.wordings))
    found = set()
    for n in range(item.low, min(item.high, len(words) - at) + 1):
        found |= ends_of(rest, words, at + n)
    return found


def plain_matches(template, words):
    items = parse_template(template)
    latest = {}
    for start in range(len(words)):
        for end in ends_of(items, words, start):
            latest[end] = max(latest.get(end, -1), start)
    longest = {}
    for end, start in latest.items():
        longest[start] = max(longest.get(start, 0), end)
    return longest


def found_in(template, text):
    automaton = Automaton([("x", False, template)])
    return {start: end for _, _, start, end, _ in read_text(automaton, text).found()}


MARKED = [
    "a b",
    "a <<var;name=x;words=0-3>> b <<beginOptional>>c <<beginOptional>>d<<endOptional>> a<<endOptional>>",
    "a <<var;name=x;match=b|b c|a a a>> d",
    "a <<beginOptional>>b<<endOptional>> <<var;name=x;words=2>> c",
    "b <<var;name=x;words=1-2>> <<beginOptional>>a <<var;name=y;words=0-1>><<endOptional>> <<var;name=z;match=c|d>>",
]


@pytest.mark.parametrize("template", MARKED)
def test_automaton_equals_trying_everything(template):
    draw = random.Random(3)
    for _ in range(300):
        words = [draw.choice("abcd") for _ in range(draw.randrange(25))]
        assert found_in(template, " ".join(words)) == plain_matches(template, [w.encode() for w in words])


def test_markup():
    assert parse_template("The <<var;name=x;words=1-2>> A<<beginOptional>>-B<<endOptional>>") == [b"the", Gap(1, 2), b"a", [b"b"]]
    for broken in ("a <<beginOptional>> b", "a <<endOptional>>", "a <<var;name=x>>", "a <<other>>"):
        with pytest.raises(ValueError):
            parse_template(broken)
    for open_start in ("<<var;name=x;words=1-2>> a", "<<beginOptional>>a<<endOptional>>", ""):
        with pytest.raises(ValueError):
            Automaton([("x", False, open_start)])


def test_text_in_pieces(monkeypatch):
    """A match may lie across pieces of any size."""
    text = "x Permission  is hereby; granted to é You, " * 5
    template = "permission is hereby granted to <<var;name=who;words=1-2>>"
    whole = found_in(template, text)
    assert len(whole) == 5
    for size in (1, 2, 7, 30):
        monkeypatch.setattr(licenses, "CHUNK", size)
        assert found_in(template, text) == whole


def test_own_templates_match_their_wording():
    """Each template accepts itself with the regions left out or filled in."""
    automaton = Automaton([(label, False, t) for label, variants in TEMPLATES.items() for t in variants])
    for label, variants in TEMPLATES.items():
        for template in variants:
            bare = re.sub(r"<<beginOptional>>((?!<<beginOptional>>).)*?<<endOptional>>", " ", template, flags=re.S)
            while "<<beginOptional>>" in bare:
                bare = re.sub(r"<<beginOptional>>((?!<<beginOptional>>).)*?<<endOptional>>", " ", bare, flags=re.S)
            full = template.replace("<<beginOptional>>", " ").replace("<<endOptional>>", " ")
            for text in (bare, full):
                is_bare = text is bare
                text = re.sub(r"<<var;[^>]*match=([^|>]*)[^>]*>>", r" \1 ", text)
                text = re.sub(r"<<var;[^>]*words=[^>]*>>", " Example ", text)
                assert label in {found[0] for found in read_text(automaton, text.upper()).found()}, text
                if is_bare:
                    # Without one mandatory word there is no such match.
                    words = words_of(text)
                    for gone in (words[:-1], words[1:]):
                        assert not found_in(template, b" ".join(gone).decode())


def test_base_places(spark):
    text = "The MIT License, mit-license; GNU General Public License public license APACHE\nlicense mitLicense"
    rows = scan_licenses(spark.createDataFrame([(1, text)], "doc_id bigint, text string")).first().found
    assert [(f.label, f.first_word, f.end_word) for f in rows if f.base] == [
        ("apache", 11, 13),
        ("gpl", 6, 9),
        ("mit", 1, 3),
        ("mit", 3, 5),
    ]


def test_edge_rows(spark):
    docs = documents(spark)
    found = scan_licenses(docs)
    assert found.count() == docs.count()
    by_id = {row.doc_id: row for row in found.collect()}
    assert by_id[2].n_words == by_id[3].n_words == by_id[4].n_words == 0 and by_id[2].found == []
    assert by_id[5].n_words == 30_001
    assert None in by_id
    assert scan_licenses(docs.limit(0)).count() == 0


def test_long_text_keeps_every_place(spark):
    """Notices in a text of many pieces are all found, with their places."""
    block = "word " * 50_000 + "Released under the MIT License. "
    docs = spark.createDataFrame([(1, block * 9)], "doc_id bigint, text string")
    row = scan_licenses(docs).first()
    starts = [f.first_word for f in row.found if f.base]
    assert starts == [50_000 + 3 + 50_005 * i for i in range(9)]
    assert row.n_words == 9 * 50_005


def test_phrases_are_places(spark, tmp_path):
    rows = [(1, "mit license " * 3), (1, "nothing"), (2, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({c: F.lit("x") for c in ("lang", "source")})
    docs.withColumn("n_chars", F.lit(1).cast("bigint")).write.parquet(f"{tmp_path}/documents.parquet")
    found = rows_of(op11_license_templates(spark, str(tmp_path)), "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    assert found == sorted([(1, 1, 0, None, None, "", "", 0.0), (1, 6, 3, 0, 4, "mit", "mit", 2 / 6), (2, 0, 0, None, None, "", "", 0.0)], key=repr)
    assert set(PHRASES.values()) == {"mit", "apache", "gpl"}
