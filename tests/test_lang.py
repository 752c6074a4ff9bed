import pytest

from corvane.lang import Literal, QueryError, parse


@pytest.mark.parametrize(
    ("value", "kind", "kept"),
    [
        ("abc", "exact", "abc"), ("år9", "exact", "år9"), (" padded ", "exact", "padded"), ("ab.*", "prefix", "ab"), (".*ab", "suffix", "ab"),
        (".*ab.*", "regex", ".*ab.*"), (".*", "regex", ".*"), (".", "regex", "."), ("NN-1", "regex", "NN-1"), ("New York", "regex", "New York"), ("hon|han", "regex", "hon|han"),
    ],
)
def test_values_are_classified_once(value, kind, kept):
    x = Literal.of("word", value)
    assert (x.kind, x.value) == (kind, kept)


def test_and_binds_tighter_than_or():
    (t,) = parse('[a="1" & b="2" | c="3" d="4"]').tokens
    assert [[str(x) for x in alt] for alt in t.alternatives] == [['a="1"', 'b="2"'], ['c="3"', 'd="4"']]
    assert len(t.groups()) == 4


def test_operators_names_and_wildcards():
    q = parse('[WORD = "x" & pos != "y"] [] [lemma contains "z" | lemma !contains "w"]')
    assert q.length == 3 and q.features == ["word", "pos", "lemma"]
    assert [x.negative for t in q.tokens for x in t.literals] == [False, True, False, True]
    assert q.tokens[1].alternatives == ()
    assert str(q) == '[word="x" & pos!="y"] [] [lemma="z" | lemma!="w"]'


def test_brackets_and_blanks_inside_values():
    assert parse('[word="[a-z]+"][word="a b"]').length == 2


@pytest.mark.parametrize("text", ["", "  ", "word", '[word="a"', '[word="a"] x', "[word=a]", '[9x="a"]', '[word="("]', '[word!="a"]', "[]", '[word!="a" | pos="b"]'])
def test_what_is_not_a_query(text):
    with pytest.raises(QueryError):
        parse(text)


def test_negatives_need_a_positive_somewhere():
    assert not parse('[word!="a"] [word="b"]').is_negative()
    assert parse('[word!="a"]', allow_negative=True).is_negative()


def test_expansion_and_subsumption():
    q = parse('[a="1" | a="2"] [b="3" | b="4"]')
    parts = q.expand()
    assert len(parts) == 4 and not any(p.contains_disjunction() for p in parts)
    assert parse('[a="1"]').subsumed_by(parts[0]) and not parse('[a="9"]').subsumed_by(parts[0])
    assert parse('[a="x.*"]').contains_prefix()
