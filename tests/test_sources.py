import bz2
import gzip
import lzma

import pytest
from fixtures import tsv

from corvane.cli import build_corpus
from corvane.lang import QueryError
from corvane.sources import corpus as corpora
from corvane.sources import readers

CONLLU = """# sent_id = 1
# text = Owls hunt mice.
1\tOwls\towl\tNOUN\tNNS\tNumber=Plur\t2\tnsubj\t2:nsubj\t_
2\thunt\thunt\tVERB\tVBP\t_\t0\troot\t0:root\t_
3\tmice\tmouse\tNOUN\tNNS\t_\t2\tobj\t2:obj\tSpaceAfter=No
4\t.\t.\tPUNCT\t.\t_\t2\tpunct\t2:punct\t_

# sent_id = 2
1-2\tdilo\t_\t_\t_\t_\t_\t_\t_\t_
1\tdi\tdecir\tVERB\t_\t_\t0\troot\t_\t_
2\tlo\tél\tPRON\t_\t_\t1\tobj\t_\t_
2.1\tghost\tghost\tX\t_\t_\t_\t_\t_\t_

"""
PLUS = """# global.columns = ID FORM UPOS PARSEME:MWE
1\tA\tDET\t*
2\tcat\tNOUN\t1:LVC

1\tsat\tVERB\t*
"""


def rows_of(c, *features):
    return [tuple(r) for r in c.tokens.orderBy("at").select("at", "sent", "i", *(f"f_{f}" for f in features)).collect()]


@pytest.mark.parametrize(("suffix", "squeeze"), [("", None), (".gz", gzip.compress), (".bz2", bz2.compress), (".xz", lzma.compress)])
def test_tsv(spark, tmp_path, suffix, squeeze):
    path = tsv(tmp_path / f"t.csv{suffix}", ["Word", "pos"], [None, ("a", "X"), ("b",), None, None, (" c ", "Y"), ("",)], squeeze)
    c = build_corpus(spark, f"file://{tmp_path}", path)
    assert c.features == ["word", "pos", "s"]
    assert rows_of(c, "word", "pos", "s") == [(0, 1, 0, "a", "X", "s"), (1, 1, 1, "b", "", ""), (2, 2, 0, "c", "Y", "s")]
    assert not any(corpora.sanity(c).values())


def test_tsv_with_too_many_columns(spark, tmp_path):
    path = tsv(tmp_path / "bad.tsv", ["word"], [("a", "b")])
    with pytest.raises(Exception, match="wrong number of columns"):
        build_corpus(spark, f"file://{tmp_path}", path)


def test_bad_names_and_suffixes(spark, tmp_path):
    with pytest.raises(QueryError):
        readers.sentences(spark, tsv(tmp_path / "n.tsv", ["9word"], [("a",)]))
    with pytest.raises(QueryError, match="suffix"):
        readers.sentences(spark, "file:///x.pdf")
    assert readers.uncompressed_suffix("/a/b.conllu.gz") == ".conllu"


def test_conllu(spark, tmp_path):
    (tmp_path / "c.conllu").write_text(CONLLU)
    c = build_corpus(spark, f"file://{tmp_path}", f"file://{tmp_path}/c.conllu", reversed_features=True)
    assert c.features[:10] == "id form lemma upos xpos feats head deprel deps misc".split()
    assert [r[1:4] for r in rows_of(c, "form")] == [(1, 0, "Owls"), (1, 1, "hunt"), (1, 2, "mice"), (1, 3, "."), (2, 0, "di"), (2, 1, "lo")]
    assert rows_of(c, "form_reversed", "misc")[2][3:] == ("ecim", "SpaceAfter=No")


def test_conllu_doubled(spark, tmp_path):
    (tmp_path / "d.conllu").write_text(CONLLU + CONLLU)
    c = build_corpus(spark, f"file://{tmp_path}", f"file://{tmp_path}/d.conllu")
    assert c.size == (12, 4)
    assert [r["n"] for r in c.sentences.orderBy("sent").collect()] == [4, 2, 4, 2]


def test_conllu_plus(spark, tmp_path):
    (tmp_path / "p.conllup").write_text(PLUS)
    c = build_corpus(spark, f"file://{tmp_path}", f"file://{tmp_path}/p.conllup", sentence_feature=False)
    assert c.features == ["id", "form", "upos", "parseme_mwe"]
    assert rows_of(c, "form", "parseme_mwe") == [(0, 1, 0, "A", "*"), (1, 1, 1, "cat", "1:LVC"), (2, 2, 0, "sat", "*")]


def test_many_sentences_over_splits(spark, tmp_path):
    """Order and numbers hold where a file is read in many splits and numbered in many buckets."""
    rows = [x for k in range(3000) for x in (None, (f"a{k}",), (f"b{k}",))]
    path = tsv(tmp_path / "m.tsv", ["word"], rows)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    old, readers.BUCKET = readers.BUCKET, 100
    try:
        c = build_corpus(spark, f"file://{tmp_path}", path)
    finally:
        readers.BUCKET = old
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert c.size == (6000, 3000)
    assert [r[3] for r in rows_of(c, "word")] == [x for k in range(3000) for x in (f"a{k}", f"b{k}")]
    assert not any(corpora.sanity(c).values())


def test_open_and_list(spark, tmp_path):
    build_corpus(spark, f"file://{tmp_path}", tsv(tmp_path / "one.tsv", ["word"], [("a",)]))
    assert corpora.list_corpora(spark, f"file://{tmp_path}") == ["one"]
    c = corpora.open_corpus(spark, f"file://{tmp_path}", "one")
    assert c.size == (1, 1) and len(c) == 1 and c.default_feature == "word" and c.fingerprint
    with pytest.raises(FileNotFoundError):
        corpora.open_corpus(spark, f"file://{tmp_path}", "two")
