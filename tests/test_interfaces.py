import json
import threading
import urllib.error
import urllib.parse
import urllib.request

import pytest
from fixtures import tsv

from corvane.api import Engine, count_text, kwic_text
from corvane.cli import main
from corvane.service import server


@pytest.fixture(scope="module")
def base(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("base")
    rows = [("The", "DT"), ("cat", "NN"), ("sat", "VB"), None, ("The", "DT"), ("dog", "NN"), None, ("A", "DT"), ("cat", "NN")]
    tsv(folder / "pets.tsv", ["word", "pos"], rows)
    tsv(folder / "more.tsv", ["word", "pos"], [("The", "DT"), ("cat", "NN")])
    for name in ("pets", "more"):
        assert main(["build", "-d", f"file://{folder}", "-c", f"file://{folder}/{name}.tsv", "--max-dist", "1", "--sanity-check"], spark) == 0
    return f"file://{folder}"


def test_build_skips_what_exists(spark, base, capsys):
    main(["build", "-d", base, "-c", "pets", "--max-dist", "1"], spark)
    assert "built" not in capsys.readouterr().out
    main(["build", "-d", base, "-c", "pets", "-t", "word:0+pos:2", "-f"], spark)
    assert capsys.readouterr().out == "built word:0+pos:2\n"


def test_search_as_text_and_json(spark, base, capsys):
    main(["search", "-d", base, "-c", "pets", "more", "-q", '[pos="DT"] [word="cat"]'], spark)
    assert capsys.readouterr().out.splitlines() == ["3 search results. Showing n:o 0-3:", "0. [1:0] { The/DT cat/NN } sat/VB", "1. [3:5] { A/DT cat/NN }", "2. [1:0] { The/DT cat/NN }"]
    main(["search", "-d", base, "-c", "pets,more", "-q", '[word="cat"]', "--print", "json", "--start", "1", "-n", "1", "--no-binary"], spark)
    out = json.loads(capsys.readouterr().out)
    assert (out["hits"], out["corpus_hits"], out["corpus_order"], out["start"], out["end"]) == (3, {"pets": 2, "more": 1}, ["pets", "more"], 1, 2)
    assert out["kwic"] == [{"corpus": "pets", "match": {"start": 1, "end": 2, "position": 6}, "sentence": 3, "tokens": [{"word": "A"}, {"word": "cat"}]}]
    main(["search", "-d", base, "-c", "pets", "-q", '[word="dog"]', "--print", "count"], spark)
    assert capsys.readouterr().out == "1 search results.\n"


def test_count(spark, base, capsys):
    main(["count", "-d", base, "-c", "pets", "more", "-q", '[pos="DT"] []', "-g", "word", "--json"], spark)
    out = json.loads(capsys.readouterr().out)
    assert out["count"] == 3
    assert out["combined"]["rows"][0] == {"value": {"word": ["The", "cat"]}, "absolute": 2, "relative": pytest.approx(2e6 / 9)}
    assert out["corpora"]["pets"]["sums"] == {"absolute": 3, "total-hits": 3, "sampled-hits": 3, "corpus-size": 7, "relative": pytest.approx(3e6 / 7)}
    main(["count", "-d", base, "-c", "pets", "more", "-q", '[pos="DT"] []', "--absolute", "-n", "2"], spark)
    lines = [[x.strip() for x in line.split("|")] for line in capsys.readouterr().out.splitlines()]
    assert lines[0] == ["Corpus", "∑", "pets", "more"] and lines[1] == ["Sampling", "100.0%", "100.0%", "100.0%"]
    assert lines[3:] == [["∑", "4", "3", "1"], ["The cat", "2", "1", "1"], ["The dog", "1", "1", "0"]]


def test_what_is_no_pattern_finds_nothing(spark, base):
    e = Engine(spark, base)
    assert e.query("pets", "nonsense")["hits"] == 0 and e.count("pets", "nonsense")["count"] == 0
    assert e.query("pets", '[word="(?P<x>a).b"]')["hits"] == 0  # Python's syntax, not Java's
    assert kwic_text(e.query("pets", "nonsense")) == "0 search results."
    assert "∑" in count_text(e.count("pets", "nonsense"))


def test_inspect_and_time_queries(spark, base, tmp_path, capsys):
    main(["inspect", "-d", base, "-c", "pets", "1"], spark)
    assert json.loads(capsys.readouterr().out)["f_word"] == "cat"
    main(["inspect", "-d", base, "-c", "pets", "--index", "word:0"], spark)
    assert len(capsys.readouterr().out.splitlines()) == 7
    (tmp_path / "q.txt").write_text('# comment\n\n[word="cat"]\n[lemma="x"]\n')
    main(["time-queries", "-d", base, "-c", "pets", f"file://{tmp_path}/q.txt"], spark)
    one, two = map(json.loads, capsys.readouterr().out.splitlines())
    assert (one["n"], one["hits"]) == (1, 2) and "error" in two


def test_cache_and_trim(spark, base, tmp_path, capsys):
    cache = f"file://{tmp_path}/c"
    for _ in range(2):
        main(["search", "-d", base, "-c", "pets", "-q", '[word="cat"]', "--cache-dir", cache, "--print", "count"], spark)
    assert capsys.readouterr().out == "2 search results.\n" * 2
    main(["trim-cache", "--cache-dir", cache, "--max-size", "0"], spark)
    assert capsys.readouterr().out.startswith("deleted ")


def test_log(spark, base, tmp_path, capsys):
    where = tmp_path / "run.log"
    main(["search", "-d", base, "-c", "pets", "-q", '[word="cat"]', "--print", "count", "--debug", "--log-file", str(where)], spark)
    said = where.read_text()
    assert "hits: {'pets': 2}" in said and "first positions: {1, 6}" in said
    main(["search", "-d", base, "-c", "pets", "-q", '[word="cat"]', "--print", "count"], spark)
    assert capsys.readouterr().err == ""


@pytest.fixture(scope="module")
def get(spark, base):
    s = server(Engine(spark, base))
    threading.Thread(target=s.serve_forever, daemon=True).start()

    def call(path, **asked):
        try:
            with urllib.request.urlopen(f"http://127.0.0.1:{s.server_port}{path}?{urllib.parse.urlencode(asked)}") as r:
                return r.status, r.headers, r.read()
        except urllib.error.HTTPError as e:
            return e.code, e.headers, e.read()

    yield call
    s.shutdown()
    s.server_close()


def test_http(get):
    code, headers, body = get("/info")
    assert code == 200 and headers["Access-Control-Allow-Origin"] == "*" and json.loads(body)["corpora"] == ["more", "pets"]
    info = json.loads(get("/corpus_info", corpus="pets,more")[2])
    assert (info["total_size"], info["total_sentences"]) == (9, 4)
    assert info["corpora"]["pets"]["attrs"] == {"p": ["word", "pos", "s"], "s": [], "a": []}
    assert '[?word][?pos|s≠"s"]' in info["corpora"]["pets"]["info"]["Indexes"]
    out = json.loads(get("/query", corpus="pets,more", cqp='[word="The"] [pos="NN"]', num=2, no_binary="true")[2])
    assert out["hits"] == 3 and len(out["kwic"]) == 2
    out = json.loads(get("/query", corpus="pets", cqp='[word="sat"] [word="The"]', no_sentence_breaks="1")[2])
    assert [k["match"]["position"] for k in out["kwic"]] == [2]
    out = json.loads(get("/count", corpus="pets", cqp='[pos="DT"]', group_by="word,pos")[2])
    assert out["combined"]["rows"][0]["value"] == {"word": ["The"], "pos": ["DT"]}
    assert b"<html" in get("/")[2]


@pytest.mark.parametrize(("path", "asked", "code"), [("/nowhere", {}, 404), ("/query", {"corpus": "none", "cqp": '[word="a"]'}, 404), ("/query", {"corpus": "pets"}, 422), ("/query", {"corpus": "pets", "cqp": '[lemma="a"]'}, 500)])
def test_http_errors(get, path, asked, code):
    got, _, body = get(path, **asked)
    assert got == code and json.loads(body)["detail"]
