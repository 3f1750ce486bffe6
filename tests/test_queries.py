"""Path queries on tiny graphs with known answers, on random graphs against sets, and on tables against SQL."""

import duckdb
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from trailweave import queries as registered
from trailweave import source_queries as sources
from trailweave.errors import LabelNotFound, UnsupportedPath, VertexNotFound
from trailweave.graph import PathGraph
from trailweave.operators import fixpoint
from trailweave.operators.frontier import FrontierEvaluator
from trailweave.operators.relational import RelationalEvaluator
from trailweave.plans.ast import Alternative, Label, Named, OneOrMore, PathQuery, Sequence, Variable, ZeroOrMore, ZeroOrOne
from trailweave.plans.rules import simplified
from trailweave.sparql import parse_query

CHAIN = [("A", "B", "knows"), ("B", "C", "knows")]
MIXED = [("A", "B", "knows"), ("B", "C", "likes")]
FORK = [("A", "B", "knows"), ("A", "C", "likes")]
LOOP = [*CHAIN, ("C", "A", "knows")]
LONG = [*MIXED, ("C", "D", "knows")]
APART = [("A", "B", "knows"), ("C", "D", "knows")]

#: graph, pattern, targets, pairs
CASES = [
    (CHAIN, "?x <knows> ?y", {"B", "C"}, 2),
    (CHAIN, "<A> <knows> ?y", {"B"}, 1),
    (MIXED, "?x <knows>/<likes> ?y", {"C"}, 1),
    (MIXED, "<A> <knows>/<likes> ?y", {"C"}, 1),
    (FORK, "<A> <knows>|<likes> ?y", {"B", "C"}, 2),
    (CHAIN, "<A> <knows>* ?y", {"A", "B", "C"}, 3),
    (CHAIN, "<A> <knows>+ ?y", {"B", "C"}, 2),
    (LOOP, "<A> <knows>* ?y", {"A", "B", "C"}, 3),
    (LOOP, "<A> <knows>+ ?y", {"A", "B", "C"}, 3),
    (LOOP, "?x <knows>+ ?y", {"A", "B", "C"}, 9),
    (LONG, "<A> <knows>/<likes>*/<knows> ?y", {"D"}, 1),
    (APART, "?x <knows> <B>", {"B"}, 1),
    (APART, "<A> <knows> <B>", {"B"}, 1),
    (APART, "<A> <knows> <D>", set(), 0),
    ([("A", "B", "p"), ("C", "D", "q")], "<C> <p> ?y", set(), 0),
    (CHAIN, "?x <knows>* ?y", {"A", "B", "C"}, 6),
    (CHAIN, "?x <knows>+ <C>", {"C"}, 2),
    ([("A", "A", "knows"), ("A", "A", "knows")], "?x <knows> ?y", {"A"}, 1),
    (MIXED, "?x <knows> ?x", {"B"}, 1),
]


def query(pattern: str) -> PathQuery:
    return parse_query(f"BASE <http://e/> SELECT * WHERE {{ {pattern} . }}").strip_base("http://e/")


@pytest.fixture(params=["local", "rounds"])
def both_ways(request, monkeypatch):
    if request.param == "rounds":
        monkeypatch.setattr(fixpoint, "LOCAL_PAIRS", 0)


@pytest.fixture(scope="module")
def graphs(spark):
    made = {}

    def graph(edges):
        key = tuple(edges)
        if key not in made:
            made[key] = PathGraph.from_edges(spark, edges)
        return made[key]

    return graph


@pytest.mark.parametrize(("edges", "pattern", "targets", "pairs"), CASES)
def test_known_answers(graphs, both_ways, edges, pattern, targets, pairs):
    g, q = graphs(edges), query(pattern)
    found = RelationalEvaluator().evaluate(q, g)
    assert found.nnz == pairs
    assert {r["target"] for r in found.named().collect()} == targets
    assert found.result_count == len(targets)
    reached = FrontierEvaluator().evaluate(q, g)
    assert {r["target"] for r in reached.named().collect()} == targets
    assert reached.result_count == len(targets)


def test_optional(graphs):
    g = graphs(CHAIN)
    assert {r["target"] for r in FrontierEvaluator().evaluate(query("<A> <knows>? ?y"), g).named().collect()} == {"A", "B"}
    with pytest.raises(UnsupportedPath):
        RelationalEvaluator().evaluate(query("?x <knows>? ?y"), g)
    assert RelationalEvaluator(optional=True).evaluate(query("?x <knows>? ?y"), g).nnz == 5


def test_unknown_names_and_their_order(graphs):
    g = graphs([("A", "B", "knows")])
    for evaluator in (RelationalEvaluator(), FrontierEvaluator()):
        for pattern, error in (("?x <none> ?y", LabelNotFound), ("<Z> <knows> ?y", VertexNotFound), ("?x <knows> <Z>", VertexNotFound), ("?x <knows>/<likes> ?y", LabelNotFound), ("<Z> <knows>* ?y", VertexNotFound)):
            with pytest.raises(error):
                evaluator.evaluate(query(pattern), g)
    with pytest.raises(LabelNotFound):
        RelationalEvaluator().prepare(query("<Z> <none> ?y"), g)
    with pytest.raises(VertexNotFound):
        FrontierEvaluator().prepare(query("<Z> <none> ?y"), g)
    with pytest.raises(UnsupportedPath):
        RelationalEvaluator().prepare(query("?x <none>? ?y"), g)


def test_prepared_query_runs_again(graphs):
    prepared = RelationalEvaluator().prepare(query("?x <knows>/<likes> ?y"), graphs(MIXED))
    assert prepared.execute().nnz == prepared.execute().nnz == 1


def test_graph_operators(graphs, spark):
    g = graphs([*CHAIN, ("A", "C", "likes"), ("A", "C", "likes")])
    assert (g.num_nodes(), g.num_labels(), g.num_edges("knows"), g.num_edges("likes")) == (3, 2, 2, 1)
    assert g.node_name(g.node_id("A")) == "A" and g.node_id("Z") is None and g.node_name(-5) is None
    big = PathGraph.from_edges(spark, [*((f"n{k}", f"n{k + 1}", "next") for k in range(999)), *(("hub", f"s{k}", "spoke") for k in range(500))])
    assert big.num_nodes() == 1501
    empty = PathGraph.from_edges(spark, [])
    assert empty.num_nodes() == empty.num_labels() == 0


PATHS = st.recursive(st.sampled_from("ab").map(Label), lambda p: st.one_of(st.tuples(p, p).map(lambda x: Sequence(*x)), st.tuples(p, p).map(lambda x: Alternative(*x)), p.map(ZeroOrMore), p.map(OneOrMore), p.map(ZeroOrOne)), max_leaves=5)
EDGES = st.lists(st.tuples(st.sampled_from("VWXYZ"), st.sampled_from("VWXYZ"), st.sampled_from("ab")), min_size=1, max_size=9)
ENDS = st.sampled_from([None, None, "V", "W"])


def by_sets(path, edges, nodes):
    match path:
        case Label(n):
            return {(s, t) for s, t, label in edges if label == n}
        case Sequence(a, b):
            x, y = by_sets(a, edges, nodes), by_sets(b, edges, nodes)
            return {(s, t) for s, m in x for k, t in y if m == k}
        case Alternative(a, b):
            return by_sets(a, edges, nodes) | by_sets(b, edges, nodes)
        case ZeroOrOne(p):
            return by_sets(p, edges, nodes) | {(n, n) for n in nodes}
    once = by_sets(path.inner, edges, nodes)
    out = set(once)
    while True:
        more = out | {(s, t) for s, m in out for k, t in once if m == k}
        if more == out:
            return out | ({(n, n) for n in nodes} if isinstance(path, ZeroOrMore) else set())
        out = more


@settings(max_examples=300, deadline=None)
@given(EDGES, PATHS)
def test_simplified_paths_are_equal(edges, path):
    nodes = {n for s, t, _ in edges for n in (s, t)}
    assert by_sets(simplified(path), edges, nodes) == by_sets(path, edges, nodes)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture, HealthCheck.too_slow])
@given(EDGES, PATHS, ENDS, ENDS)
def test_random_graphs(spark, edges, path, subject, target):
    edges = [*edges, ("V", "W", "a"), ("W", "V", "b")]
    nodes = {n for s, t, _ in edges for n in (s, t)}
    want = {(s, t) for s, t in by_sets(path, edges, nodes) if subject in (None, s) and target in (None, t)}
    q = PathQuery(Named(subject) if subject else Variable("x"), path, Named(target) if target else Variable("y"))
    g = PathGraph.from_edges(spark, edges)
    assert {tuple(r) for r in RelationalEvaluator(optional=True).evaluate(q, g).named().collect()} == want
    assert {r["target"] for r in FrontierEvaluator().evaluate(q, g).named().collect()} == {t for _, t in want}


@pytest.mark.parametrize("name", ["seq3", "alt_seq", "plus_acyclic", "star_cyclic", "star_mid", "nested_star", "named_plus", "named_plus_object", "targets_star_mid", "targets_plus_deep", "nnz_star_cyclic", "target_count_alt_seq", "named_both_hit", "star_mid_rounds", "plus_deep_rounds", "targets_star_mid_rounds", "src_csv_seq3", "src_nt_star_mid", "src_ttl_plus_cyclic", "src_mm_named_both_hit", "src_merged_seq3", "graph_counts", "graph_lookups", "rdf_left_out", "query_run", "bench_resumed"])
def test_tables_against_sql(spark, name):
    sf_dir = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    queries, sql = registered.queries() | sources.queries(), registered.oracle_sql() | sources.oracle_sql()
    assert set(queries) == set(sql)
    found = queries[name](spark, sf_dir)
    want = con.execute(sql[name])
    names = [d[0] for d in want.description]
    assert sorted(found.columns) == sorted(names)
    assert sorted(repr(tuple(r[n] for n in names)) for r in found.collect()) == sorted(map(repr, want.fetchall()))
