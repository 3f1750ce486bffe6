"""Edges from N-Triples and Turtle. Triples with a literal and statements with a fault are left out, and can be counted."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import groupby, islice
from urllib.parse import urljoin, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import GraphLoadError

IRI = r"<((?:[^<>\"{}|^`\\\x00-\x20]|\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8})*)>"
BLANK = r"(_:[\w](?:[\w.\-]*[\w\-])?)"
STRING = r"\"(?:[^\"\\\n\r]|\\.)*\"(?:@[A-Za-z]+(?:-[A-Za-z0-9]+)*|\^\^" + IRI.replace("(", "(?:", 1) + r")?"
TRIPLE = rf"^\s*(?:{IRI}|{BLANK})\s*{IRI}\s*(?:{IRI}|{BLANK}|({STRING}))\s*\.\s*(?:#.*)?$"
RDF_TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
SUFFIXES = {".nt": "ntriples", ".ntriples": "ntriples", ".ttl": "turtle", ".turtle": "turtle"}

Row = tuple[str | None, str | None, str | None, str]


def format_of(path: str) -> str | None:
    """By the suffix, whose case matters."""
    return next((f for s, f in SUFFIXES.items() if path.endswith(s)), None)


def unescaped(text: str) -> str:
    return re.sub(r"\\u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})", lambda m: chr(int(m[1] or m[2], 16)), text)


#: Stands between the parts of a triple; no IRI or blank node can have it.
BETWEEN = "\x01"


def ntriples(spark: SparkSession, path: str) -> DataFrame:
    """(source, label, target, kind) of each line that isn't empty or a comment; kind is edge, literal or fault. Lines are parsed in the JVM, each by one match, and files are split."""
    lines = spark.read.text(path).where(~F.col("value").rlike(r"^\s*(#.*)?$"))

    def parsed(lines: DataFrame) -> DataFrame:
        parts = F.regexp_replace("value", TRIPLE, BETWEEN + "".join(f"${k}{BETWEEN}" for k in range(1, 7)))
        # what explode gives stays one value: filters and columns that follow would match again
        found = lines.select("value", F.explode(F.array(parts)).alias("parts"))
        good = F.col("parts") != F.col("value")
        part = lambda k: F.when(good, F.get(F.split("parts", BETWEEN), F.lit(k))).otherwise("")
        kind = F.when(~good, "fault").when(part(6) != "", "literal").otherwise("edge")
        return found.select(F.concat(part(1), part(2)).alias("source"), part(3).alias("label"), F.concat(part(4), part(5)).alias("target"), kind.alias("kind"))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [pa.array([unescaped(x) for x in c.to_pylist()], pa.string()) for c in batch.columns]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    escaped = F.col("value").contains("\\")
    return parsed(lines.where(~escaped)).union(parsed(lines.where(escaped)).mapInArrow(decode, "source string, label string, target string, kind string"))


TURTLE = re.compile(
    r"""(?P<space>\s+|\#[^\n]*)
      | (?P<iri><(?:[^<>"{}|^`\\\x00-\x20]|\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8})*>)
      | (?P<string>\"\"\"(?:[^\\"]|\\.|"(?!""))*\"\"\"|'''(?:[^\\']|\\.|'(?!''))*'''|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')
      | (?P<at>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)
      | (?P<blank>_:\w(?:[\w.\-]*[\w\-])?)
      | (?P<pname>(?:[^\W\d_](?:[\w.\-]*[\w\-])?)?:(?:(?:[\w:%]|\\.)(?:(?:[\w:.\-%]|\\.)*(?:[\w:\-%]|\\.))?)?)
      | (?P<number>[+\-]?(?:\d+(?:\.\d*)?(?:[eE][+\-]?\d+)|\d*\.\d+|\d+))
      | (?P<word>[A-Za-z]+)
      | (?P<mark>\^\^|[\[\](),;.])""",
    re.VERBOSE | re.DOTALL,
)


#: Relative IRIs that are put after a base as they are, if it ends with a slash.
PLAIN = re.compile(r"[A-Za-z0-9_\-]+(?:/[A-Za-z0-9_\-]+)*")


class Fault(Exception):
    pass


LITERAL = object()


def tokens(lines: Iterable[str]) -> Iterator[tuple[str, str]]:
    """(kind, text) of a document's tokens. Only strings in three quotes go over lines: where one begins, lines are held up to its end. One that has no end is, as quotes without an end are, an empty string and what follows."""
    source, unended = iter(lines), set()  # kinds of quotes that don't come again
    for text in source:
        at = 0
        while at < len(text):
            m = TURTLE.match(text, at)
            quotes = text[at : at + 3]
            if quotes in ('"""', "'''") and quotes not in unended and (m is None or len(m.group()) < 6):
                held = [text[at:]]
                for more in source:
                    held.append(more)
                    if quotes in more and TURTLE.match(whole := "".join(held)).end() >= 6:
                        break
                else:
                    unended.add(quotes)
                    whole = "".join(held)
                text, at = whole, 0
                continue
            if m is None and text[at] in "\"'" and text.endswith("\\\n") and (more := next(source, None)) is not None:
                text += more  # a string goes on after an escaped end of line
                continue
            if m is None:
                yield "bad", text[at]
                at += 1
                continue
            if m.lastgroup != "space":
                yield m.lastgroup, m.group()
            at = m.end()


class TurtleReader:
    """A lenient reader of one document, line by line: directives, predicate and object lists, blank nodes with their own lists, literals. A statement with a fault, or with a collection, is left out up to its full stop. Only one statement is held at a time."""

    def __init__(self, lines: Iterable[str], tag: str = ""):
        self.tag = tag  # tells the document's own nodes from those of others
        self.tokens = tokens([lines] if isinstance(lines, str) else lines)
        self.ahead: tuple[str, str] | None = None
        self.base, self.joins, self.prefixes, self.made = "", False, {}, 0
        self.rows: list[Row] = []

    def peek(self) -> tuple[str, str]:
        if self.ahead is None:
            self.ahead = next(self.tokens, ("end", ""))
        return self.ahead

    def next(self) -> tuple[str, str]:
        out, self.ahead = self.peek(), None
        return out

    def mark(self, text: str) -> bool:
        if self.peek() == ("mark", text):
            self.ahead = None
            return True
        return False

    def iri(self, text: str) -> str:
        raw = unescaped(text[1:-1])
        if self.joins and PLAIN.fullmatch(raw):
            return self.base + raw
        if urlsplit(raw).scheme:
            return raw
        if not self.base:
            raise Fault
        return urljoin(self.base, raw)

    def expanded(self, text: str) -> str:
        prefix, _, local = text.partition(":")
        if prefix not in self.prefixes:
            raise Fault
        return self.prefixes[prefix] + re.sub(r"\\(.)", r"\1", local)

    def read(self) -> Iterator[Row]:
        while self.peek()[0] != "end":
            self.rows = []
            try:
                self.statement()
            except Fault:
                self.rows = [(None, None, None, "fault")]
                while self.peek()[0] != "end" and not self.mark("."):
                    self.next()
            yield from self.rows

    def statement(self) -> None:
        kind, text = self.peek()
        low = text.lower()
        if kind == "at" and low in ("@prefix", "@base") or kind == "word" and low in ("prefix", "base"):
            self.next()
            if low.endswith("prefix"):
                (k1, name), (k2, iri) = self.next(), self.next()
                if k1 != "pname" or not name.endswith(":") or k2 != "iri":
                    raise Fault
                self.prefixes[name[:-1]] = self.iri(iri)
            else:
                k, iri = self.next()
                if k != "iri":
                    raise Fault
                self.base = self.iri(iri)
                self.joins = urljoin(self.base, "a/b") == self.base + "a/b"
            if kind == "at" and not self.mark("."):
                raise Fault
            return
        bare = kind == "mark" and text == "["
        subject = self.node()
        if subject is LITERAL:
            raise Fault
        if not (bare and self.peek() == ("mark", ".")):
            self.properties(subject)
        if not self.mark("."):
            raise Fault

    def properties(self, subject: str) -> None:
        while True:
            kind, text = self.next()
            if kind == "iri":
                label = self.iri(text)
            elif kind == "pname":
                label = self.expanded(text)
            elif (kind, text) == ("word", "a"):
                label = RDF_TYPE
            else:
                raise Fault
            while True:
                target = self.node()
                self.rows.append((subject, label, None, "literal") if target is LITERAL else (subject, label, target, "edge"))
                if not self.mark(","):
                    break
            if not self.mark(";"):
                return
            while self.mark(";"):
                pass
            if self.peek() in (("mark", "."), ("mark", "]")):
                return

    def node(self):
        kind, text = self.next()
        if kind == "iri":
            return self.iri(text)
        if kind == "pname":
            return self.expanded(text)
        if kind == "blank":
            return text
        if kind == "string":
            if self.peek()[0] == "at":
                self.next()
            elif self.mark("^^") and self.next()[0] not in ("iri", "pname"):
                raise Fault
            return LITERAL
        if kind == "number" or kind == "word" and text in ("true", "false"):
            return LITERAL
        if (kind, text) == ("mark", "["):
            self.made += 1
            name = f"_:{self.tag}/{self.made}"  # no document can write a slash
            if not self.mark("]"):
                self.properties(name)
                if not self.mark("]"):
                    raise Fault
            return name
        raise Fault


#: Rows of a batch that a task sends on, and tasks among which files are dealt.
BATCH_ROWS, MOST_TASKS = 20_000, 2_000


def turtle(spark: SparkSession, path: str) -> DataFrame:
    """(source, label, target, kind) of Turtle files; prefixes make a file sequential, so each is read by one task, as lines in their order. Blank nodes without a label are told apart by file."""
    size = BATCH_ROWS
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"))
    tasks = max(1, min(4 * len(lines.inputFiles()), MOST_TASKS))  # more than files, so that few share one
    ordered = lines.select("value", F.xxhash64("file").alias("tag"), "start", "at").repartition(tasks, "tag").sortWithinPartitions("tag", "start", "at").select("value", "tag")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def all_lines() -> Iterator[tuple[str, str]]:
            for batch in batches:
                yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

        for tag, own in groupby(all_lines(), lambda x: x[1]):
            found = TurtleReader((f"{line}\n" for line, _ in own), f"{tag & (1 << 64) - 1:X}").read()
            while rows := list(islice(found, size)):
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in range(4)], names=["source", "label", "target", "kind"])

    return ordered.mapInArrow(read, "source string, label string, target string, kind string")


def read_rdf_rows(spark: SparkSession, path: str, form: str | None = None) -> DataFrame:
    form = form or format_of(path)
    if form is None:
        raise GraphLoadError(f"can't tell the RDF format of {path}: expected one of {', '.join(SUFFIXES)}")
    return ntriples(spark, path) if form == "ntriples" else turtle(spark, path)


def read_rdf(spark: SparkSession, path: str, form: str | None = None, strict: bool = False) -> DataFrame:
    """(source, label, target). Literals and faults are left out, or fail the read if it is strict."""
    rows = read_rdf_rows(spark, path, form)
    if strict:
        rows = rows.withColumn("source", F.when(F.col("kind") == "edge", F.col("source")).otherwise(F.raise_error(F.concat(F.lit("not an edge: "), F.col("kind"))).cast("string")))
        return rows.select("source", "label", "target")
    return rows.where("kind = 'edge'").select("source", "label", "target")


def left_out(spark: SparkSession, path: str, form: str | None = None) -> dict[str, int]:
    """How many triples with a literal, and how many faults, a read leaves out."""
    return {r["kind"]: r["count"] for r in read_rdf_rows(spark, path, form).where("kind <> 'edge'").groupBy("kind").count().collect()}
