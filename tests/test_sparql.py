import pytest

from trailweave.errors import NotSelect, NotSinglePath, SyntaxProblem, UnsupportedPath, UnsupportedSubject, VariablePredicate
from trailweave.plans.ast import Alternative, Label, Named, OneOrMore, Sequence, Variable, ZeroOrMore, ZeroOrOne
from trailweave.sparql import parse_query

E = "http://e/"
A, B, C = Label(E + "a"), Label(E + "b"), Label(E + "c")
X, Y = Variable("x"), Variable("y")


def parse(pattern, head="SELECT *"):
    return parse_query(f"BASE <{E}> {head} WHERE {{ {pattern} }}")


@pytest.mark.parametrize(
    ("pattern", "path"),
    [
        ("?x <a> ?y", A),
        ("?x <a> ?y .", A),
        ("?x <a>/<b> ?y", Sequence(A, B)),
        ("?x <a>/<b>/<c> ?y", Sequence(Sequence(A, B), C)),
        ("?x <a>|<b> ?y", Alternative(A, B)),
        ("?x <a>* ?y", ZeroOrMore(A)),
        ("?x <a>+ ?y", OneOrMore(A)),
        ("?x <a>? ?y", ZeroOrOne(A)),
        ("?x (<a>/<b>)* ?y", ZeroOrMore(Sequence(A, B))),
        ("?x <a>/<b>*/<c> ?y", Sequence(Sequence(A, ZeroOrMore(B)), C)),
        ("?x <a> _:m . _:m <b> ?y", Sequence(A, B)),
        ("?x <a>* ?m . ?m <b> ?y", Sequence(ZeroOrMore(A), B)),
        ("{ ?x <a> ?y }", A),
    ],
)
def test_accepted(pattern, path):
    q = parse(pattern)
    assert (q.subject, q.path, q.object) == (X, path, Y)


def test_ends_prefixes_and_modifiers():
    q = parse("<s> <a> <o>")
    assert (q.subject, q.object) == (Named(E + "s"), Named(E + "o"))
    assert parse("?y ^<a> ?x").subject == X
    q = parse_query("PREFIX p: <http://p/> SELECT DISTINCT ?x WHERE { ?x p:k/a p:o } LIMIT 5 OFFSET 2")
    assert q.path.left == Label("http://p/k") and q.path.right.name.endswith("#type") and q.object == Named("http://p/o")
    assert parse("<s> <a>+ <o>").strip_base(E).path == OneOrMore(Label("a"))
    assert parse("<s> <a> <o>").strip_base("other:") == parse("<s> <a> <o>")
    assert parse("?x <имя> ?y").path == Label(E + "имя")


@pytest.mark.parametrize(
    ("text", "error"),
    [
        ("ASK { ?x <http://e/a> ?y }", NotSelect),
        ("CONSTRUCT { ?x <http://e/a> ?y } WHERE { ?x <http://e/a> ?y }", NotSelect),
        ("SELECT * WHERE { ?x <a> ?y }", SyntaxProblem),
        ("SELECT * WHERE { ?x p:a ?y }", SyntaxProblem),
        ("SELECT * WHERE { ?x <http://e/a> }", SyntaxProblem),
        ("SELECT * WHERE { ?x <http://e/a> ?y", SyntaxProblem),
        ("nonsense", SyntaxProblem),
        ("", SyntaxProblem),
        ("SELECT * WHERE { }", NotSinglePath),
        ("SELECT * WHERE { ?x <http://e/a> ?y } ORDER BY ?x", NotSinglePath),
    ],
)
def test_refused_queries(text, error):
    with pytest.raises(error):
        parse_query(text)


@pytest.mark.parametrize(
    ("pattern", "error"),
    [
        ("?x <a> ?z . ?z <b> ?y", NotSinglePath),
        ("?x <a>* ?z . ?w <b> ?y", NotSinglePath),
        ("?x ?p ?y", VariablePredicate),
        ("?x !(<a>) ?y", UnsupportedPath),
        ("?x (^<a>)* ?y", UnsupportedPath),
        ("_:b <a> ?y", UnsupportedSubject),
        ("?x <a> 'text'", UnsupportedSubject),
        ("?x <a> ?y FILTER(?x = ?y)", NotSinglePath),
        ("?x <a> ?y . OPTIONAL { ?y <b> ?z }", NotSinglePath),
        ("{ ?x <a> ?y } UNION { ?x <b> ?y }", NotSinglePath),
        ("?x <a> ?y ; <b> ?z", NotSinglePath),
    ],
)
def test_refused_patterns(pattern, error):
    with pytest.raises(error):
        parse(pattern)
