import json

import pytest

from trailweave.cli import main as cli
from trailweave.cli.checkpoint import Checkpoint
from trailweave.cli.run import estimates, timed
from trailweave.errors import BenchError, CheckpointError, GraphLoadError, InvalidFormat, MissingColumn
from trailweave.graph import PathGraph
from trailweave.operators.relational import RelationalEvaluator
from trailweave.plans.ast import Label, PathQuery, Variable
from trailweave.sources.csv_edges import read_csv
from trailweave.sources.matrix_market import matrix, read_matrix_market, triples
from trailweave.sources.query_file import load_queries
from trailweave.sources.rdf import format_of, left_out, read_rdf


def put(folder, name, text):
    path = folder / name
    path.write_text(text, encoding="utf-8")
    return str(path)


def rows(df):
    return sorted((r["source"], r["label"], r["target"]) for r in df.collect())


def test_csv(spark, tmp_path):
    want = [("A", "knows", "B"), ("Б", "喜欢", "C")]
    assert rows(read_csv(spark, put(tmp_path, "a.csv", "source,target,label\nA,B,knows\nБ,C,喜欢\n"))) == want
    assert rows(read_csv(spark, put(tmp_path, "b.csv", "rel,from,to\nknows,A,B\n"), "from", "to", "rel")) == want[:1]
    assert rows(read_csv(spark, put(tmp_path, "c.csv", "A\tB\tknows\n"), header=False, delimiter="\t")) == want[:1]
    empty = read_csv(spark, put(tmp_path, "d.csv", "source,target,label\n"))
    assert PathGraph.from_triples(empty).num_nodes() == 0
    for spec in ({"source": "none"}, {"source": 7}, {"source": "A", "header": False}):
        with pytest.raises(MissingColumn):
            read_csv(spark, str(tmp_path / "c.csv"), **spec)
    with pytest.raises(Exception, match="(?i)malformed|missing"):
        read_csv(spark, put(tmp_path, "e.csv", "source,target,label\nA,B\n")).collect()


MATRIX = "%%MatrixMarket matrix coordinate pattern general\n% made by hand\n4 4 2\n1 2\n2 3\n"


def mm(folder, vertices="<A> 1\nB b 2\n\nC 3\nD 4\n", edges="knows 1\nlikes 2\n"):
    put(folder, "vertices.txt", vertices)
    put(folder, "edges.txt", edges)
    put(folder, "1.txt", MATRIX)
    put(folder, "2.txt", "%%MatrixMarket matrix coordinate integer symmetric\n4 4 2\n3 1 5\n2 2 0\n")
    return str(folder)


def test_matrix_market(spark, tmp_path):
    g = read_matrix_market(spark, mm(tmp_path))
    assert (g.num_nodes(), g.num_labels(), g.node_id("A"), g.node_name(1)) == (4, 2, 0, "B b")
    assert rows(triples(g)) == [("A", "knows", "B b"), ("A", "likes", "C"), ("B b", "knows", "C"), ("B b", "likes", "B b"), ("C", "likes", "A")]
    based = read_matrix_market(spark, str(tmp_path), "http://e/")
    assert based.labels == {"http://e/knows", "http://e/likes"} and based.node_id("http://e/A") == 0
    merged = PathGraph.from_sources(triples(g), read_csv(spark, put(tmp_path, "x.csv", "s,t,l\nA,Z,knows\n")), isolated=g.vertices)
    assert merged.num_nodes() == 5
    assert RelationalEvaluator().evaluate(PathQuery(Variable("x"), Label("knows"), Variable("y")), merged).nnz == 3


@pytest.mark.parametrize(("vertices", "line"), [("A 1\nB 0\n", 2), ("A 1\n\nB 1\n", 3), ("A x\n", 1), ("alone\n", 1), ("A -1\n", 1)])
def test_faulty_maps(spark, tmp_path, vertices, line):
    with pytest.raises(InvalidFormat) as e:
        read_matrix_market(spark, mm(tmp_path, vertices))
    assert (e.value.file, e.value.line) == ("vertices.txt", line)


def test_names_may_repeat_and_headers_are_needed(spark, tmp_path):
    assert read_matrix_market(spark, mm(tmp_path, "A 1\nB 2\nA 3\nC 4\n")).node_id("A") == 2
    assert read_matrix_market(spark, mm(tmp_path, "A 3\nB 2\nA 1\nC 4\n")).node_id("A") == 0  # the last line's
    with pytest.raises(InvalidFormat):
        matrix(spark, put(tmp_path, "bad.txt", "1 2\n"))


def test_ntriples(spark, tmp_path):
    text = '<http://e/s> <http://e/p> <http://e/o> .\n# comment\n\n_:b1 <http://e/p> _:b2 . # end\n<http://e/s> <http://e/p> "text"@en .\nnonsense\n<http://e/\\u00e9> <http://e/p> <http://e/ж> .\n'
    path = put(tmp_path, "a.nt", text)
    assert rows(read_rdf(spark, path)) == sorted([("http://e/s", "http://e/p", "http://e/o"), ("_:b1", "http://e/p", "_:b2"), ("http://e/é", "http://e/p", "http://e/ж")])
    assert left_out(spark, path) == {"literal": 1, "fault": 1}
    with pytest.raises(Exception, match="not an edge"):
        read_rdf(spark, path, strict=True).collect()


def test_turtle(spark, tmp_path):
    text = """@prefix e: <http://e/> . @base <http://b/> .
    e:s e:p e:o , <o2> ; a e:T ; e:name "x; y."@en , 5 , true .
    [] e:p _:n . broken here . e:q e:p [ e:r e:z ] .
    e:l e:p ( 1 2 ) . e:last e:p 'a'^^e:t ."""
    path = put(tmp_path, "a.ttl", text)
    made = {x for r in rows(read_rdf(spark, path)) for x in r if x.startswith("_:") and "/" in x}
    tags = {x.partition("/")[0] for x in made}
    assert len(tags) == 1 and len(made) == 2  # nodes without a label, told apart by file
    found = [tuple(x.replace(f"{min(tags)}/", "_:genid") for x in r) for r in rows(read_rdf(spark, path))]
    assert found == sorted([("http://e/s", "http://e/p", "http://e/o"), ("http://e/s", "http://e/p", "http://b/o2"), ("http://e/s", "http://www.w3.org/1999/02/22-rdf-syntax-ns#type", "http://e/T"), ("_:genid1", "http://e/p", "_:n"), ("_:genid2", "http://e/r", "http://e/z"), ("http://e/q", "http://e/p", "_:genid2")])
    assert left_out(spark, str(tmp_path / "a.ttl")) == {"literal": 4, "fault": 2}


def test_blank_nodes_of_several_files_stay_apart(spark, tmp_path):
    for name in ("a.ttl", "b.ttl"):
        put(tmp_path, name, "@prefix e: <http://e/> . [] e:p e:o . _:genid1 e:p e:o . [ e:q e:o ] .")
    found = rows(read_rdf(spark, str(tmp_path), "turtle"))
    assert len({s for s, _, _ in found}) == 5 and len(found) == 6


@pytest.mark.parametrize(
    ("text", "why"),
    [
        ("%%MatrixMarket matrix coordinate pattern general\n4 4 2\n1 2\n", "1 entries"),
        ("%%MatrixMarket matrix coordinate pattern general\n4 4 1\n1 5\n", "within"),
        ("%%MatrixMarket matrix coordinate pattern general\n4 4 1\nx y\n", "within"),
        ("%%MatrixMarket matrix coordinate pattern general\n4 four 1\n1 2\n", "size line"),
        ("%%MatrixMarket matrix array real general\n4 4\n1\n", "coordinate"),
    ],
)
def test_faulty_matrices(spark, tmp_path, text, why):
    with pytest.raises(InvalidFormat, match=why):
        matrix(spark, put(tmp_path, "m.txt", text))


def test_long_headers_and_edges_without_a_vertex(spark, tmp_path):
    text = "%%MatrixMarket matrix coordinate pattern general\n" + "% note\n" * 1500 + "\n4 4 1\n2 3\n"
    assert [tuple(r) for r in matrix(spark, put(tmp_path, "m.txt", text)).collect()] == [(1, 2)]
    with pytest.raises(GraphLoadError, match="no vertex"):
        read_matrix_market(spark, mm(tmp_path, vertices="A 1\nB 2\n"))


def test_checked_graphs(spark):
    vertices = spark.createDataFrame([(1, "a"), (2, "b")], "id long, name string")
    assert PathGraph.from_pairs(spark.createDataFrame([(1, 2), (1, 2)], "src long, dst long"), "p", vertices).num_edges("p") == 1
    with pytest.raises(GraphLoadError, match="no vertex"):
        PathGraph.from_pairs(spark.createDataFrame([(1, 3)], "src long, dst long"), "p", vertices)
    with pytest.raises(GraphLoadError, match="id of their own"):
        PathGraph.from_pairs(spark.createDataFrame([(1, 2)], "src long, dst long"), "p", vertices.union(vertices))


def test_rdf_formats(spark):
    assert [format_of(x) for x in ("a.nt", "a.ntriples", "a.ttl", "a.turtle", "a.TTL", "a.xml")] == ["ntriples", "ntriples", "turtle", "turtle", None, None]
    with pytest.raises(GraphLoadError):
        read_rdf(spark, "a.xml")


def test_query_file(tmp_path):
    found = load_queries(put(tmp_path, "q.txt", " 1 , ?x <a>/<b> ?y \n\nno comma\n3,?x !<a> ?y\n"), "http://e/")
    assert [q.id for q in found] == ["1", "?", "3"]
    assert found[0].text == "?x <a>/<b> ?y" and isinstance(found[0].parsed, PathQuery)
    assert isinstance(found[1].parsed, Exception) and isinstance(found[2].parsed, Exception)


def test_command_line(spark, tmp_path):
    graph, queries, out = put(tmp_path, "g.csv", "source,target,label\nhttp://example.org/A,http://example.org/B,http://example.org/knows\n"), put(tmp_path, "q.txt", "1,?x <knows> ?y\n2,?x <none> ?y\n3,?x <knows>? ?y\n"), str(tmp_path / "out.json")
    common = ["-g", graph, "-f", "csv", "-q", queries, "-a", "nfarpq", "rpqmatrix", "-o", out]
    assert cli.main(["query", *common, "-b"]) == 0
    body = json.load(open(out))
    assert body["metadata"]["num_nodes"] == 2 and body["metadata"]["num_labels"] == 1
    assert body["results"][0]["algorithms"]["nfarpq"] == {"status": "ok", "result_count": 1}
    assert body["results"][1]["algorithms"]["rpqmatrix"]["status"] == "error"
    assert [body["results"][2]["algorithms"][a]["status"] for a in ("nfarpq", "rpqmatrix")] == ["ok", "error"]
    checkpoint = str(tmp_path / "c.json")
    bench = ["bench", *common, "-b", "-c", checkpoint, "--sample-size", "1", "--warm-up", "0", "--measurement", "0"]
    assert cli.main(bench) == 0
    timing = json.load(open(out))["results"][0]["algorithms"]["nfarpq"]["timing"]
    assert timing["total"]["iterations"] == 1 and timing["execute_only"]["mean_ns"] > 0
    assert cli.main([*bench, "--resume"]) == 0
    assert json.load(open(out))["results"] == []
    assert cli.main(["query", "-g", str(tmp_path / "none"), "-q", queries, "-a", "nfarpq"]) == 1


def test_repeated_algorithms_and_samples(tmp_path, capsys):
    args = cli.parser().parse_args(["bench", "-g", "g", "-q", "q", "-a", "nfarpq", "-a", "rpqmatrix", "--criterion-dir", "d"])
    assert args.algo == ["nfarpq", "rpqmatrix"] and args.criterion_dir == "d"
    assert cli.main(["bench", "-g", "g", "-q", "q", "-a", "nfarpq", "--plots"]) == 1 and "plots" in capsys.readouterr().err
    folder = str(tmp_path / "deep" / "total")
    found = timed(lambda: None, 5, 0, 0, folder)
    assert found == estimates(folder) and found["iterations"] == 5
    assert len(json.load(open(f"{folder}/sample.json"))["times"]) == 5
    with pytest.raises(BenchError):
        estimates(str(tmp_path))


def test_checkpoint(tmp_path):
    path = str(tmp_path / "c.json")
    assert Checkpoint.load(path) is None
    Checkpoint("g", "q", ["a", "b"]).mark_and_save(0, "a", path)
    again = Checkpoint.load(path)
    assert again.done(0, "a") and not again.done(0, "b")
    again.validate("g", "q", ["b", "a"])
    for wrong in (("h", "q", ["a", "b"]), ("g", "r", ["a", "b"]), ("g", "q", ["a"])):
        with pytest.raises(CheckpointError):
            again.validate(*wrong)
    put(tmp_path, "c.json", "{")
    with pytest.raises(CheckpointError):
        Checkpoint.load(path)
