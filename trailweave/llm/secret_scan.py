"""Secrets by dictionary-primed zstandard novelty."""

from __future__ import annotations

import bisect
import hashlib
import re
from collections import Counter
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table

STEMS = ["aws", "auth", "cookie", "session", "jwt", "otp", "dsn", "connection_string", "salt", "token", "secret", "passw", "pwd", "apikey", "api_key", "api-key", "access_key", "access-key", "accesskey", "private_key", "private-key", "credential", "bearer", "client_id", "signature"]
LEAST_CHARS = 12  # of a candidate
LEAST_PASSWORD = 8  # of one that is set as a password and has characters of three kinds
LEAST_URL = 6  # of a password in a URL
AROUND = 400  # characters of the text on either side that are the surrounding code against which a candidate is measured
LEAST_BYTES = 8.0  # marginal compressed bytes of a reported candidate
LEAST_RATIO = 0.45  # marginal compressed bytes per character of a reported candidate
LEVEL = 9
CORPUS_WORDS = 3000  # identifiers of the corpus in the dictionary
LEAST_DOCS = 5  # documents that have such an identifier
MARK = "<secret>"

SET = r"\s{{0,4}}(?P<set{}>:=|=>|==|=|:|>)\s{{0,4}}"
CANDIDATE = re.compile(
    r"(?:(?P<name>[\w.\-]{0,40}(?:" + "|".join(map(re.escape, STEMS)) + r")[\w.\-]{0,40})[\"'`\]\\]{0,4}(?:" + SET.format("") + r"|\s{1,4})"
    r"|(?P<key>[\w.\-]{0,40}key)[\"'`\]\\]{0,4}" + SET.format("_key") + r")"
    r"(?:bearer\s{1,4}|basic\s{1,4})?[\"'`\\]{0,4}"
    r"(?P<value>(?P<plain>[A-Za-z0-9+/_\-.~$!@%^*]*={0,2})[A-Za-z0-9+/_\-.~$!@%^*#&(;:]*={0,2})",
    re.IGNORECASE,
)
PASSWORD = re.compile(r"passw|pwd|secret|credential", re.IGNORECASE)
KINDS = [re.compile(r) for r in (r"[a-z]", r"[A-Z]", r"[0-9]", r"[^A-Za-z0-9]")]
NAMED = re.compile(r"[\w.\-]*(?:" + "|".join(map(re.escape, STEMS)) + r"|key)[\w.\-]*", re.IGNORECASE)
SETS = re.compile(r"[\"'`\]\\]{0,4}" + SET.format(""))
PEM = re.compile(r"-----BEGIN (?P<name>[A-Z ]{0,30}PRIVATE KEY)-----(?P<value>[^-]{16,}?)-----END")

FORM = re.compile(
    r"(?<![A-Za-z0-9])(?P<value>(?P<name>AKIA|ASIA)[0-9A-Z]{16}|(?:gh[pousr]_|github_pat_|glpat-|npm_)[A-Za-z0-9_\-]{20,255}|xox[abeoprs]-[A-Za-z0-9\-]{10,255}|[sr]k[_\-](?:live|test|proj|ant)[_\-][A-Za-z0-9_\-]{16,255}"
    r"|AIza[0-9A-Za-z_\-]{35}|ya29\.[A-Za-z0-9_\-]{20,}|SG\.[A-Za-z0-9_\-]{16,}\.[A-Za-z0-9_\-]{16,}|eyJ[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]{8,})"
)
FORMS = ["akia", "asia", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_", "glpat-", "npm_", "xox", "sk_", "sk-", "rk_", "rk-", "aiza", "ya29.", "sg.", "eyj"]  # one of them is in what FORM finds, in lower case
URL = re.compile(r"://[^\s/:@\"'<>]{0,80}:(?P<value>[^\s/@\"'<>]{" + str(LEAST_URL) + r",200})@")
STEM = re.compile("|".join(map(re.escape, sorted([*STEMS, "key"], key=lambda x: (-len(x), x)))), re.IGNORECASE)
BEFORE = re.compile(r"[\w.\-]*\Z")  # the part of a name before its stem
#: What a text with a candidate has: a stem, the beginning of a known form, or a URL with a password.
SUSPECT = "(?i)" + "|".join(map(re.escape, [*STEMS, "key", *FORMS])) + r"|://[^\s/@]*:[^\s/@]*@"
PIECE = re.compile(r"[a-z]{4,24}|[A-Z][a-z]{3,24}|[A-Z]{4,24}")

IDENTIFIERS = """
import from return function const static public private protected class interface struct enum void string integer boolean double float long
self this true false null none undefined default export module package require include define async await yield lambda except finally throw catch
config configuration settings environment variable parameter argument request response session context handler service controller repository factory
username password passphrase secret_key client_secret access_token refresh_token api_key private_key public_key authorization bearer credentials
process.env.SECRET_KEY os.environ.get getenv config.get settings.SECRET ${SECRET} {{secret}} <your-token-here> your_api_key_here your-secret-key
example example_token_value placeholder changeme change_me_please dummy sample test_token testing123 password123 insert_key_here redacted REDACTED
xxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxx XXXXXXXXXXXXXXXXXXXXXXXXXXXXXXXX 00000000000000000000000000000000 ******************************** ................................
0123456789abcdef0123456789ABCDEF abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 1234567890 qwertyuiop asdfghjkl
authentication authenticate authenticator validation validator serializer tokenizer tokenization tokenized initialize initialization implementation
the and for with that this from have which their will would there been more when about other than into only some could these
"""



class Primed:
    """A compressor primed with identifiers as raw content: those of IDENTIFIERS and of the corpus."""

    def __init__(self, corpus: Iterable[str] = ()):
        self.content = "\n".join((" ".join(corpus), IDENTIFIERS)).encode("utf-8", "replace")
        self._packer: zstandard.ZstdCompressor | None = None

    def __getstate__(self):
        return {"content": self.content, "_packer": None}

    def size(self, raw: bytes) -> int:
        if self._packer is None:
            primed = zstandard.ZstdCompressionDict(self.content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            primed.precompute_compress(level=LEVEL)
            self._packer = zstandard.ZstdCompressor(dict_data=primed, write_content_size=False)
        return len(self._packer.compress(raw))

    def novelty(self, value: str, around: str) -> int:
        """The compressed bytes that `value` adds to its surroundings, other occurrences of it left out of them."""
        rest = around.replace(value, " ").encode("utf-8", "replace") + b"\n"
        return self.size(rest + value.encode("utf-8", "replace")) - self.size(rest)


PLAIN = Primed()


def candidate(text: str, at: int) -> re.Match | None:
    """The first match of CANDIDATE from a place on. Its names are looked for by their stems, as an expression that begins with any name is slow."""
    for m in STEM.finditer(text, at):
        low = max(at, m.start() - 40)
        if found := CANDIDATE.match(text, low + BEFORE.search(text[low : m.start()]).start()):
            return found
    return None


def found(text: str, primed: Primed = PLAIN) -> list[tuple[int, int, str, int]]:
    """The reported candidates of a text: (start, length, name, marginal bytes), in order and without overlap. After one that isn't reported the search goes on at its value, which may be the name of the next."""

    def cost(start: int, end: int) -> int:
        """Marginal bytes of a candidate that is to be reported, or 0."""
        n = primed.novelty(text[start:end], text[max(0, start - AROUND) : start] + text[end : end + AROUND])
        return n if n >= LEAST_BYTES and n >= LEAST_RATIO * (end - start) else 0

    out: list[tuple[int, int, str, int]] = []
    starts: list[int] = []

    def add(start: int, end: int, name: str, n: int) -> None:
        k = bisect.bisect(starts, start)
        starts.insert(k, start)
        out.insert(k, (start, end - start, name, n))

    def free(start: int, end: int) -> bool:
        k = bisect.bisect_left(starts, end)
        return not k or out[k - 1][0] + out[k - 1][1] <= start

    for expression in (PEM, URL, FORM):  # contexts that tell themselves what they are
        for m in expression.finditer(text):
            start, end = m.span("value")
            if free(start, end) and (n := cost(start, end)):
                name = "url password" if expression is URL else m["name"] or text[start : start + 4]
                add(start, end, name.lower(), n)
    at = 0
    while m := candidate(text, at):
        name, start = (m["name"] or m["key"]).lower(), m.start("value")
        at = max(start, at + 1)
        if NAMED.fullmatch(text, start, m.end("plain")) and SETS.match(text, m.end("plain")):  # the name of what follows
            continue
        for end in dict.fromkeys((m.end("value"), m.end("plain"))):
            value = text[start:end].rstrip(".-#&(;:")
            end = start + len(value)
            least = LEAST_PASSWORD if m["set"] and PASSWORD.search(name) and sum(bool(k.search(value)) for k in KINDS) >= 3 else LEAST_CHARS
            if m["key"] and sum(bool(k.search(value)) for k in KINDS[:3]) < 2:  # a plain word after a mere key
                continue
            if len(value) < least or not free(start, end):
                continue
            if n := cost(start, end):
                add(start, end, name, n)
                at = end
                break
    return out


def suspects(texts: pa.Array) -> np.ndarray:
    """The places of the texts that may have a candidate, found in one pass over them."""
    return np.flatnonzero(pc.match_substring_regex(texts, SUSPECT).fill_null(False).to_numpy(zero_copy_only=False))


def corpus_identifiers(docs: DataFrame) -> list[str]:
    """The words of one case of which the most frequent identifiers of the corpus are made, counted over all documents: at most CORPUS_WORDS that LEAST_DOCS documents have, rarest first, as a compressor reaches the end of its dictionary most cheaply. Those that no text with a possible candidate has are never compressed and take no room. A secret, however often it is copied, has at most short pieces among them."""

    def count(source):
        seen: Counter = Counter()
        met: set[str] = set()  # in texts that may have a candidate
        shape = lambda c: pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()), pa.array(list(c.values()), pa.int64()), pa.array([p in met for p in c], pa.bool_())], names=["piece", "n", "met"])
        for batch in cut(source):
            text = batch.column(0)
            some = set(suspects(text).tolist())
            for k, t in enumerate(text.to_pylist()):
                if t:
                    pieces = set(PIECE.findall(t))
                    seen.update(pieces)
                    if k in some:
                        met |= pieces
                if len(seen) > 500_000:
                    yield shape(seen)
                    seen, met = Counter(), set()
        yield shape(seen)

    pieces = docs.select("text").mapInArrow(count, "piece string, n long, met boolean")
    top = pieces.groupBy("piece").agg(F.sum("n").alias("n"), F.max("met").alias("met")).where(f"met and n >= {LEAST_DOCS}").orderBy(F.desc("n"), "piece").limit(CORPUS_WORDS)
    top = top.where("n > 0").collect()  # a step after the limit, so that a task takes the first of all partitions, not the driver
    return [r["piece"] for r in sorted(top, key=lambda r: (r["n"], [-ord(c) for c in r["piece"]]))]


def scan(docs: DataFrame) -> DataFrame:
    """A row for each reported secret: doc_id, start, length, name, marginal_bytes, ratio, sha256 (never the secret itself).

    A candidate stands in a sensitive context: a string of at least LEAST_CHARS secret-like characters after a sensitive name and a separator, one of LEAST_PASSWORD that is set as a password, the password of a URL, a key of an issuer's form or the body of a PEM private key. Its novelty is the number of bytes that it adds when it is compressed after its surroundings, by zstandard primed with a dictionary of identifiers, placeholders and the corpus's own identifiers. Names, words, placeholders and runs cost few bytes; a candidate that costs LEAST_BYTES and LEAST_RATIO bytes a character is reported. Of overlapping candidates the first one stays, keys of a known form before others.

    Null and empty texts have none, nor has an empty table; a secret is reported at every place, in every copy and repeated row; very long texts are scanned whole; a null doc_id is passed on; other columns, of any name, are ignored.
    """
    primed = Primed(corpus_identifiers(docs))

    def one(source):
        for batch in cut(source):
            some = batch.take(pa.array(suspects(batch.column(1))))
            rows = [(i, *hit, hashlib.sha256(text[hit[0] : hit[0] + hit[1]].encode("utf-8", "replace")).hexdigest()) for i, text in zip(some.column(0).to_pylist(), some.column(1).to_pylist(), strict=True) for hit in found(text, primed)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([r[0] for r in rows], pa.int64()),
                    pa.array([r[1] for r in rows], pa.int32()),
                    pa.array([r[2] for r in rows], pa.int32()),
                    pa.array([r[3] for r in rows], pa.string()),
                    pa.array([r[4] for r in rows], pa.int32()),
                    pa.array([round(r[4] / r[2], 6) for r in rows], pa.float64()),
                    pa.array([r[5] for r in rows], pa.string()),
                ],
                names=["doc_id", "start", "length", "name", "marginal_bytes", "ratio", "sha256"],
            )

    return docs.select("doc_id", "text").mapInArrow(one, "doc_id long, start int, length int, name string, marginal_bytes int, ratio double, sha256 string")


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def redacted(text: str, primed: Primed = PLAIN) -> str:
    out, at = [], 0
    for start, length, _, _ in found(text, primed):
        out += [text[at:start], MARK]
        at = start + length
    return "".join(out) + text[at:]


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents, all of them and with all their columns, with each reported secret replaced by MARK, and n_chars, if there is one, counted again where that happened. Null and empty texts stay as they are, so does an empty table; repeated rows are changed alike; other columns may have any name."""
    names = docs.columns
    primed = Primed(corpus_identifiers(docs))

    def run(source):
        for batch in cut(source):
            text = batch.column(names.index("text"))
            changed = {}
            for k in suspects(text).tolist():
                old = text[k].as_py()
                if (new := redacted(old, primed)) != old:
                    changed[k] = new
            if changed:
                columns = list(batch.columns)
                columns[names.index("text")] = replaced(text, changed)
                if "n_chars" in names:
                    k = names.index("n_chars")
                    columns[k] = replaced(columns[k], {at: len(new) for at, new in changed.items()})
                batch = pa.RecordBatch.from_arrays(columns, names=names)
            yield batch

    return docs.mapInArrow(run, docs.schema)


def replaced(column: pa.Array, new: dict) -> pa.Array:
    """The column with other values at some places."""
    mask = np.zeros(len(column), bool)
    mask[list(new)] = True
    return pc.replace_with_mask(column, pa.array(mask), pa.array([new[k] for k in sorted(new)], column.type))
