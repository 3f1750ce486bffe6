"""Path queries whose steps must not outgrow a task: each test holds a step to what it may hold or move."""

import random

import pytest

from trailweave import graph as graphs
from trailweave import source_queries as sources
from trailweave import storage
from trailweave.graph import PathGraph
from trailweave.operators import components, fixpoint, frontier, relational
from trailweave.operators.frontier import FrontierEvaluator
from trailweave.operators.relational import RelationalEvaluator
from trailweave.plans.ast import Label, Sequence
from trailweave.sources.matrix_market import matrix
from trailweave.sources.rdf import TurtleReader, left_out, read_rdf, read_rdf_rows
from trailweave.sparql import parse_query

from .test_queries import by_sets


def query(pattern):
    return parse_query(f"BASE <http://e/> SELECT * WHERE {{ {pattern} . }}").strip_base("http://e/")


def reached(edges):
    """Pairs joined by one or more edges."""
    out, after = set(), {}
    for s, t in edges:
        after.setdefault(s, set()).add(t)
    for s in after:
        left, seen = [s], set()
        while left:
            fresh = after.get(left.pop(), set()) - seen
            seen |= fresh
            left += fresh
        out |= {(s, t) for t in seen}
    return out


@pytest.fixture
def mixed():
    """Chains, a loop, a diamond, a self-loop and repeats, apart from each other."""
    edges = [(f"c{k}/{i}", f"c{k}/{i + 1}") for k in range(6) for i in range(12)]
    edges += [(f"l/{i}", f"l/{(i + 1) % 5}") for i in range(5)] + [("d/1", "d/2"), ("d/1", "d/3"), ("d/2", "d/4"), ("d/3", "d/4"), ("o", "o")]
    random.Random(1).shuffle(edges)
    return edges


@pytest.mark.parametrize(("component", "cells", "links", "chunk"), [(10_000, 2_000_000, 1_000_000, 500_000), (10_000, 3, 0, 7), (9, 40, 0, 5), (0, 40, 1_000_000, 5)])
def test_closures_of_components_and_of_what_is_too_large(spark, monkeypatch, mixed, component, cells, links, chunk):
    monkeypatch.setattr(fixpoint, "COMPONENT_PAIRS", component)
    monkeypatch.setattr(fixpoint, "CELLS", cells)
    monkeypatch.setattr(fixpoint, "TOGETHER", 4)
    monkeypatch.setattr(components, "DRIVER_LINKS", links)
    monkeypatch.setattr(components, "CHUNK", chunk)
    graph, want = PathGraph.from_edges(spark, [(s, t, "p") for s, t in [*mixed, *mixed[:9]]]), reached(mixed)
    all_pairs = RelationalEvaluator(local_pairs=0).evaluate(query("?x <p>+ ?y"), graph).named().collect()
    assert len(all_pairs) == len(want) and {tuple(r) for r in all_pairs} == want
    for start in ("c2/3", "d/1", "l/0"):
        own = RelationalEvaluator(local_pairs=0).evaluate(query(f"<{start}> <p>+ ?y"), graph).named().collect()
        assert sorted(map(tuple, own)) == sorted(p for p in want if p[0] == start)
        ends = FrontierEvaluator(0).evaluate(query(f"<{start}> <p>+ ?y"), graph).named().collect()
        assert sorted(r["target"] for r in ends) == sorted(t for s, t in want if s == start)


def test_small_components_are_closed_without_rounds(spark, monkeypatch, mixed):
    """Their pairs were joined, sorted and written again in each round."""

    def refuse(*_):
        raise AssertionError("a round of joins")

    monkeypatch.setattr(fixpoint, "_squared", refuse)
    monkeypatch.setattr(fixpoint, "_stepwise", refuse)
    graph = PathGraph.from_edges(spark, [(s, t, "p") for s, t in mixed])
    assert RelationalEvaluator(local_pairs=0).evaluate(query("?x <p>+ ?y"), graph).nnz == len(reached(mixed))
    assert RelationalEvaluator(local_pairs=0).evaluate(query("<c1/0> <p>+ ?y"), graph).nnz == 12


def test_a_search_from_a_seed_reads_its_component_only(spark, monkeypatch, mixed):
    """It went by rounds over all edges, one for each step of the longest path."""
    monkeypatch.setattr(frontier, "_rounds", None)
    graph = PathGraph.from_edges(spark, [(s, t, "p") for s, t in mixed])
    assert FrontierEvaluator(20).evaluate(query("<c1/0> <p>+ ?y"), graph).result_count == 12


def test_a_search_by_rounds_reads_the_edges_of_its_states(spark, monkeypatch):
    """Each round joined the frontier with the edges of all states, and the first with every vertex that has one."""
    made = []

    def noted(df, what, by=None):
        made.append((what, by, df.count()))
        return frontier_written(df, what, by)

    frontier_written = frontier.written
    monkeypatch.setattr(frontier, "written", noted)
    graph = PathGraph.from_edges(spark, [*((f"o{k}", f"c{k % 3}", "a") for k in range(30)), *((f"c{k}", "n", "b") for k in range(3)), ("n", "m", "c"), ("m", "n", "c")])
    assert {r["target"] for r in FrontierEvaluator(0).evaluate(query("?x <a>/<b>/<c>* ?y"), graph).named().collect()} == {"n", "m"}
    assert [m[1] for m in made if m[0] == "steps"] == ["q"]
    assert max(n for what, _, n in made if what == "frontier") == 3


def test_a_turtle_file_is_read_line_by_line():
    """All of its tokens and rows were held at once."""
    read = 0

    def lines():
        nonlocal read
        yield "@prefix e: <http://e/> . @base <http://b/> .\n"
        for k in range(20_000):
            read += 1
            yield f'<s/{k}> e:p <o> , e:q ; e:n """long\n' if k % 2 else f'text""" . e:a e:p "x" .\n' if k else "e:a e:p e:b .\n"

    found = TurtleReader(lines()).read()
    assert next(found) == ("http://e/a", "http://e/p", "http://e/b", "edge")
    assert read < 10
    assert sum(r[3] == "edge" for r in found) == 2 * 9_999 and read == 20_000


def test_strings_without_an_end_and_over_lines():
    text = '@prefix e: <http://e/> . e:a e:p """one\ntwo \\""" three\n""" , e:b . e:c e:p "x\\\ny" , e:d .\ne:e e:p \'\'\'open\ne:f e:p e:g .\n'
    whole, by_line = list(TurtleReader(text).read()), list(TurtleReader(x + "\n" for x in text.split("\n")[:-1]).read())
    assert whole == by_line and [r[2] for r in whole if r[3] == "edge"] == ["http://e/b", "http://e/d"]


def test_a_turtle_file_in_several_splits(spark, tmp_path, monkeypatch):
    (tmp_path / "a.ttl").write_text("@prefix e: <http://e/> .\n" + "".join(f"e:s{k} e:p\n  e:o .\n" for k in range(500)))
    (tmp_path / "b.ttl").write_text("@prefix e: <http://f/> .\n" + "".join(f"e:s{k} e:p\n  e:o .\n" for k in range(300)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        found = read_rdf_rows(spark, str(tmp_path), "turtle").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert {tuple(r) for r in found} == {(f"http://{h}/s{k}", f"http://{h}/p", f"http://{h}/o", "edge") for h, n in (("e", 500), ("f", 300)) for k in range(n)} and len(found) == 800


def test_a_line_of_ntriples_is_matched_once(spark, tmp_path):
    """Each column, and the filters on them, matched again, and so did a second read for escapes."""
    path = tmp_path / "a.nt"
    path.write_text('<http://e/s> <http://e/p> <http://e/o> .\n_:b <http://e/p> _:c . # end\n<http://e/s> <http://e/p> "a\\"b\\u00e9"@en .\n\x01<x> broken\n<http://e/\\u00e9> <http://e/p> <http://e/o> .\n')
    found = read_rdf(spark, str(path))
    assert sorted(map(tuple, found.collect())) == [("_:b", "http://e/p", "_:c"), ("http://e/s", "http://e/p", "http://e/o"), ("http://e/é", "http://e/p", "http://e/o")]
    assert left_out(spark, str(path)) == {"literal": 1, "fault": 1}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") == 2 and "regexp_extract" not in plan  # lines with escapes and without


def test_triples_are_read_once_and_hubs_are_spread(spark, monkeypatch, tmp_path):
    """The input was read for each end of the dictionary and for the edges."""
    monkeypatch.setattr(graphs, "TASK_ROWS", 10)
    names = [(f"s{k % 40}", "p", "hub" if k % 2 else f"t{k}") for k in range(80)] + [("hub", "q", f"t{k}") for k in range(30)]
    reads = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            reads.add(batch.num_rows)
            yield batch

    triples = spark.createDataFrame([*names, *names[:7]], "source string, label string, target string").mapInArrow(counted, "source string, label string, target string")
    graph = PathGraph.from_triples(triples)
    assert reads.value == 117
    found = graph.with_names(graph.edges.select(*map(graphs.F.col, ("src", "label", "dst"))), "src", "dst")
    assert sorted(map(tuple, found.collect())) == sorted(set(names)) and graph.num_nodes() == len({x for s, _, t in names for x in (s, t)})


def test_a_matrix_may_be_a_folder_of_files(spark, tmp_path):
    """One task sorted and wrote all entries of a label, and held the sorts of all joins before it."""
    (tmp_path / "1.txt").mkdir()
    for name, text in (("part-1.txt", "1 2\n" * 3 + "% note\n\n3 4\n" + "2 1\n" * 400), ("head.txt", "%%MatrixMarket matrix coordinate pattern general\n% a\n4 4 405\n"), ("part-0.txt", "4 4\n")):
        (tmp_path / "1.txt" / name).write_text(text)
    assert {tuple(r) for r in matrix(spark, str(tmp_path / "1.txt")).collect()} == {(0, 1), (2, 3), (1, 0), (3, 3)}
    path = sources.matrix_folder(spark, "/root/testdata/sf0.001", ["placed_by", "in_region"])
    found = spark.read.text(f"{path}/1.txt").where("value rlike '^[0-9]+ [0-9]+$'")
    assert found.count() == 1500 and matrix(spark, f"{path}/2.txt").count() == 25


def partitions_of(df, what):
    """Numbers of partitions to which a plan deals rows out by request."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return [int(line.split(",")[-1].strip(" )").split()[0]) for line in plan.splitlines() if what in line]


@pytest.mark.parametrize("pattern", ["?x (<a>/<b>)|(<a>/(<b>/<b>)) ?y", "?x <a>/<b>*/<c> ?y", "?x (<a>|<b>)/(<c>?)/<b> ?y", "?x <a>/<b>/<c> ?y"])
@pytest.mark.parametrize("hub", [1, 1_000_000])
def test_pairs_of_large_inputs_are_dealt_out(spark, monkeypatch, pattern, hub):
    """A task held all pairs that its join made, to drop repeats of which it met few."""
    monkeypatch.setattr(storage, "PART_BYTES", 200)
    monkeypatch.setattr(relational, "FEW_PARTS", 2)
    monkeypatch.setattr(relational, "HUB", hub)
    draw = random.Random(3)
    edges = [(f"v{draw.randrange(9)}", f"v{draw.randrange(9)}", "a") for _ in range(40)] + [(f"v{draw.randrange(9)}", f"v{draw.randrange(9)}", draw.choice("bc")) for _ in range(12)]
    graph, q = PathGraph.from_edges(spark, edges), query(pattern)
    found = RelationalEvaluator(optional=True).evaluate(q, graph)
    want = by_sets(q.path, edges, {n for s, t, _ in edges for n in (s, t)})
    rows = found.named().collect()
    assert len(rows) == len(want) and {tuple(r) for r in rows} == want
    dealt = partitions_of(found.rows, "RepartitionByExpression")
    assert dealt and max(dealt) > 2 and (hub == 1 or "|" not in pattern or len(dealt) > 1)


def test_the_largest_step_is_joined_last(spark):
    """Its pairs were joined and their repeats dropped once for each step after it."""
    graph = PathGraph.from_edges(spark, [*((f"o{k}", f"c{k % 50}", "a") for k in range(30_000)), *((f"c{k}", f"n{k % 5}", "b") for k in range(50)), *((f"n{k}", "r", "c") for k in range(5))])
    low = relational.Lowering(graph)
    path = query("?x <a>/<b>/<c> ?y").path
    first, after = low.rest(path)
    assert first == Label("a") and after == Sequence(Label("b"), Label("c"))
    assert low.rest(query("?x <c>/<b>/<a> ?y").path) is None and low.rest(query("?x <a>/<b>?/<c>? ?y").path) is None
    assert RelationalEvaluator().evaluate(query("?x <a>/<b>/<c> ?y"), graph).nnz == 30_000


def test_pairs_of_one_id_are_not_sorted_to_be_named(spark, monkeypatch):
    """All pairs that end in one vertex were sorted by one task."""
    graph = PathGraph.from_edges(spark, [*((f"o{k}", f"c{k % 5}", "a") for k in range(60)), *((f"c{k}", "r", "b") for k in range(5))])
    monkeypatch.setattr(graphs, "FEW_PARTS", 0)
    found = RelationalEvaluator().evaluate(query("?x <a>/<b> ?y"), graph).named()
    assert {tuple(r) for r in found.collect()} == {(f"o{k}", "r") for k in range(60)}
    assert found._jdf.queryExecution().sparkPlan().toString().count("ShuffledHashJoin") == 2
