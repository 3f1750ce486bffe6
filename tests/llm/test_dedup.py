"""SimHash groups, embedding groups and repeated passages against brute force."""

import random

import duckdb
import numpy as np
import pyarrow as pa
import pandas as pd
import pytest
from pyspark.sql import functions as F

from trailweave.llm import common
from trailweave.llm import embedding_dedup as E
from trailweave.llm import simhash_dedup as S
from trailweave.llm import suffix_dedup as R
from trailweave.llm.common import Memo, components, words

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def groups(links, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def vocabulary(rng, n=4000):
    return ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(n)]


def corpus(seed=3, n=60):
    rng = random.Random(seed)
    vocab = vocabulary(rng)
    texts = []
    for _ in range(n):
        base = [rng.choice(vocab) for _ in range(rng.randint(60, 300))]
        texts.append(base)
        for _ in range(rng.choice([0, 0, 1, 3])):
            copy = list(base)
            for _ in range(len(copy) * rng.choice([0, 2, 4]) // 100):
                copy[rng.randrange(len(copy))] = rng.choice(vocab)
            texts.append(copy)
    return [(k, " ".join(t), "en", "s", None) for k, t in enumerate(texts)]


def brute_simhash(rows):
    """Every pair by the definition: a lane within 2 * HALF bits, and the check bits within MOST_APART."""
    memo = Memo()
    prints = {i: S.fingerprint(words(t), memo) for i, t, *_ in rows if t and words(t)}
    ids = sorted(prints)
    lanes = S.lanes(np.stack([prints[i] for i in ids]))
    links = []
    for x in range(len(ids)):
        for y in range(x):
            near = np.bitwise_count(lanes[x] ^ lanes[y]).min() <= 2 * S.HALF
            if near and S.apart(prints[ids[x]][:2], prints[ids[y]][:2]) <= S.MOST_APART:
                links.append((ids[x], ids[y]))
    return {n: r for n, r in groups(links, ids).items() if n != r}


def test_simhash_is_the_brute_force_result(spark):
    rows = corpus()
    found = {r["doc_id"]: r["duplicate_of"] for r in S.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()}
    assert found == brute_simhash(rows) and len(found) > 20


def test_simhash_recall_by_distance_and_size(spark):
    """Against all pairs that the check bits accept, without the lanes."""
    rng = random.Random(11)
    vocab = vocabulary(rng)
    rows = []
    for _ in range(700):
        base = [rng.choice(vocab) for _ in range(rng.choice([40, 80, 300]))]
        copy = list(base)
        for k in rng.sample(range(len(copy)), len(copy) * rng.randint(2, 14) // 100):
            copy[k] = rng.choice(vocab)
        rows += [(len(rows), " ".join(base)), (len(rows) + 1, " ".join(copy))]
    memo = Memo()
    full = np.stack([S.fingerprint(words(t), memo)[:2] for _, t in rows])
    root = {r["doc_id"]: r["duplicate_of"] for r in S.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    found = {}
    for k in range(len(rows)):
        away = S.apart(full[k + 1 :], full[k])
        for j in np.flatnonzero(away <= S.MOST_APART).tolist():
            together = root.get(k, k) == root.get(k + 1 + j, k + 1 + j)
            for band in ("all", (int(away[j]) - 1) // 4, "short" if len(rows[k][1].split()) <= 80 else "long"):
                found.setdefault(band, []).append(together)
    assert all(len(found[k]) >= 30 for k in ("all", "short", "long", 2, 3, 4))
    assert all(np.mean(v) >= 0.9 for v in found.values())


def test_prefix_changes_nothing(spark, monkeypatch):
    assert S.prefix_bits(1) == S.PREFIX and S.prefix_bits(S.ROWS * 8) == S.PREFIX + 3
    rows = spark.createDataFrame(corpus(5, 25), DOCS)
    a = sorted(map(tuple, S.near_duplicates(rows).collect()))
    monkeypatch.setattr(S, "prefix_bits", lambda n: 13)
    assert sorted(map(tuple, S.near_duplicates(rows).collect())) == a


def test_simhash_odd_rows(spark):
    long = " ".join(f"w{k % 977}" for k in range(200_000))
    rows = [(1, None), (2, ""), (3, "?! ..."), (4, "one two three"), (5, "one two three"), (5, "one two three"), (6, long), (7, long + " x"), (None, "one two three"), (8, "other words here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("node", F.lit("clash")).withColumn("a", F.lit(1))
    assert sorted(map(tuple, S.near_duplicates(docs).collect())) == [(5, 4), (7, 6)]
    kept = S.keep_one(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] or 0) for r in kept.collect()) == [1, 2, 3, 4, 6, 8]  # the row without a doc_id has the text of 4
    assert S.near_duplicates(docs.where("false")).count() == 0


def test_repeated_ids_join_groups(spark):
    rows = [(1, "alpha beta gamma delta epsilon zeta eta theta"), (9, "alpha beta gamma delta epsilon zeta eta theta"), (9, "iota kappa lambda mu nu xi omicron pi rho"), (12, "iota kappa lambda mu nu xi omicron pi rho")]
    found = S.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, found.collect())) == [(9, 1), (12, 1)]


def test_dense_groups_are_linked_whole():
    rng = np.random.default_rng(1)
    full = rng.integers(0, 1 << 63, (40, 2)).astype(np.uint64)
    full[10:] = full[9] ^ (np.uint64(1) << rng.integers(0, 60, (30, 2)).astype(np.uint64))
    links = S.linked(np.arange(40), full)
    assert set(groups(links, range(40)).values()) == set(range(10))


def colliding(n=600, rest=28):
    """Rows of places whose fingerprints often share a variant, mostly by chance, and the links among them by brute force."""
    rng = np.random.default_rng(4)
    full = rng.integers(0, 1 << 63, (n, 2)).astype(np.uint64)
    full[n // 2 :] = np.where(rng.random(n - n // 2) < 0.3, 1, 0).astype(np.uint64)[:, None] ^ full[rng.integers(0, n // 2, n - n // 2)]
    full[-40:] = full[0] ^ (np.uint64(1) << rng.integers(0, 60, (40, 2)).astype(np.uint64))
    value = rng.integers(0, 60, n).astype(np.uint64) * np.uint64(0x155)  # several within 2 bits, many equal
    prefix = 32 - rest
    place = S.ball(value >> np.uint64(rest), prefix)
    low = np.repeat((value & np.uint64((1 << rest) - 1))[:, None], prefix + 1, axis=1)
    low[:, 0] |= np.uint64(1 << rest)
    columns = {"place": place.reshape(-1), "low": low.reshape(-1), "node": np.repeat(np.arange(n), prefix + 1), **{f"f{k}": np.repeat(full[:, k], prefix + 1) for k in (0, 1)}}
    near = (np.bitwise_count(value[:, None] ^ value[None, :]) <= 2) & (S.apart(full[:, None], full[None, :]) <= S.MOST_APART)
    return pa.table({k: v.view(np.int64) for k, v in columns.items()}).sort_by("place"), groups(np.argwhere(np.triu(near, 1)).tolist(), range(n))


def test_chance_meetings_are_compared_together(monkeypatch):
    """Small groups that share a variant aren't walked one by one: by chance they grow with the square of the table."""
    rows, want = colliding()
    calls = []
    linked = S.linked
    monkeypatch.setattr(S, "linked", lambda *x: calls.append(1) or linked(*x))

    def found():
        a, b = S.met(rows, 28)
        return groups(list(zip(a.tolist(), b.tolist(), strict=True)), range(600))

    assert found() == want and not calls and len(set(want.values())) < 590
    monkeypatch.setattr(S, "KEYS", 500)  # in slices
    assert found() == want and not calls
    monkeypatch.setattr(S, "PAIRED", 2)  # each group by itself
    assert found() == want and calls


def test_rows_of_a_value_are_compared_once(monkeypatch):
    """Not at each of the variants that they share, and two values not at both of theirs."""
    value = np.repeat(np.array([5, 4, 6], np.uint64), [40, 30, 1])  # 4 is a bit from 5, and from 6, which is two from 5
    full = np.uint64(1) << np.arange(71, dtype=np.uint64) % np.uint64(60)
    columns = {"place": np.zeros(71, np.int64), "low": value | np.uint64(1 << 28), "node": np.arange(71), "f0": full, "f1": full}
    rows = pa.table({k: v.view(np.int64) for k, v in columns.items()})
    pairs, apart = [], S.apart
    monkeypatch.setattr(S, "apart", lambda a, b: pairs.append(len(a)) or apart(a, b))
    a, b = S.met(rows, 28)
    assert set(groups(list(zip(a.tolist(), b.tolist(), strict=True)), range(71)).values()) == {0}
    assert sum(pairs) == 71 * 70 // 2


def test_large_values_are_searched_with_the_same_result(monkeypatch):
    rows, want = colliding()
    for name, most in (("CROSSED", 3), ("PAIRED", 4), ("KEYS", 7)):
        monkeypatch.setattr(S, name, most)
        a, b = S.met(rows, 28)
        assert groups(list(zip(a.tolist(), b.tolist(), strict=True)), range(600)) == want


def test_meetings_return_a_forest(spark):
    """The links that a portion of places sends on are fewer than its nodes, however many lanes and variants they share."""
    rng = np.random.default_rng(3)
    full = np.repeat(rng.integers(0, 1 << 63, (1, S.WIDE)), 200, axis=0)
    full ^= np.left_shift(np.int64(1), rng.integers(0, 63, full.shape))  # about half the lanes are a bit or two apart
    nodes = spark.createDataFrame([(*map(int, f), k) for k, f in enumerate(full)], ", ".join(f"{n} long" for n in [*S.FULL, "node"]))
    links = [tuple(r) for r in S.meetings(S.places(nodes, 4), 4, 1).collect()]
    assert set(groups(links, range(200)).values()) == {0} and len(links) < 200


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, monkeypatch, seed):
    rng = random.Random(seed)
    links = [(rng.randrange(80), rng.randrange(80)) for _ in range(60)] + [(k, k + 1) for k in range(200, 230)] + [(5, 5)]
    nodes = {x for a, b in links if a != b for x in (a, b)}
    found = components(spark.createDataFrame([*links, (None, 3)], "a long, b long"))
    assert {r["node"]: r["root"] for r in found.collect()} == groups([e for e in links if e[0] != e[1]], nodes)
    monkeypatch.setattr(common, "LOCAL_LINKS", 0)
    found = components(spark.createDataFrame([*links, (None, 3)], "a long, b long"))
    assert {r["node"]: r["root"] for r in found.collect()} == groups([e for e in links if e[0] != e[1]], nodes)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def vectors(seed=0, n=900, width=24):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, width))
    x[: n // 3] = x[n // 3 : 2 * (n // 3)] + rng.normal(size=(n // 3, width)) * rng.uniform(0, 0.5, (n // 3, 1))
    return x


def test_embeddings_recall(spark):
    x = vectors()
    df = spark.createDataFrame([(k, [float(v) for v in row]) for k, row in enumerate(x)], "vec_id long, embedding array<float>")
    unit = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    pairs = np.argwhere(np.triu(unit @ unit.T >= E.COSINE, 1))
    want = groups([(int(a), int(b)) for a, b in pairs], range(len(x)))
    rows = E.near_duplicates(df).collect()
    found = {r["vec_id"]: r["group_id"] for r in rows}
    together = sum(found[int(a)] == found[int(b)] for a, b in pairs)
    assert len(pairs) > 100 and together >= 0.9 * len(pairs)
    assert all(want[v] == want[g] for v, g in found.items())  # no false group
    assert all(r["keep"] == (r["vec_id"] == r["group_id"]) for r in rows)


@pytest.mark.parametrize("n", [2000, 12_000])
def test_embeddings_recall_just_above_the_cosine(spark, n):
    """Copies of cosine 0.9 to 0.95, many of them cut by borders between cells."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(n, 32))
    x[: n // 3] = x[n // 3 : 2 * (n // 3)] + rng.normal(size=(n // 3, 32)) * rng.uniform(0.3, 0.48, (n // 3, 1))
    df = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(n), "embedding": x.astype(np.float32).tolist()})).select("vec_id", F.col("embedding").cast("array<float>"))
    unit = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    pairs = np.concatenate([np.argwhere(unit[s : s + 1000] @ unit.T >= E.COSINE) + [s, 0] for s in range(0, n, 1000)])
    pairs = pairs[pairs[:, 0] < pairs[:, 1]]
    found = np.array([r["group_id"] for r in sorted(E.near_duplicates(df).collect())])
    assert len(pairs) > n // 5 and np.mean(found[pairs[:, 0]] == found[pairs[:, 1]]) >= 0.9


@pytest.mark.parametrize("n", [2000, 50_000])
def test_copies_of_a_vector_are_as_many_at_any_size(spark, n):
    rng = np.random.default_rng(2)
    df = spark.createDataFrame(pd.DataFrame({"node": np.arange(n), "x": rng.normal(size=(n, 8)).tolist()})).select("node", F.lit(8).alias("width"), F.col("x").cast("array<float>"))
    cells = E.Cells({8: rng.normal(size=(int(n**0.5), 8)).astype(np.float32)})
    assert E.placed(df, cells).count() == E.VISITS * n


def test_each_width_is_compared(spark):
    rows = [(k, [1.0, 2.0, 3.0, float(k)]) for k in range(9)] + [(20, [1.0, 1.0]), (21, [2.0, 2.0]), (22, [1.0, 1.01]), (23, [1.0, -1.0]), (24, [-1.0])]
    found = {r["vec_id"]: r["group_id"] for r in E.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    assert (found[20], found[21], found[22], found[23], found[24]) == (20, 20, 20, 23, 24) and found[7] == found[8] != 20


def test_embedding_blocks_change_nothing(spark, monkeypatch):
    df = spark.createDataFrame([(k, [float(v) for v in row]) for k, row in enumerate(vectors(1, 300))], "vec_id long, embedding array<float>")
    a = sorted(map(tuple, E.near_duplicates(df).collect()))
    monkeypatch.setattr(E, "BLOCK", 7)
    assert sorted(map(tuple, E.near_duplicates(df).collect())) == a


def test_embedding_odd_rows(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 1.0]), (4, [0.0, 0.0]), (5, None), (6, []), (7, [1.0, 0.0, 0.0]), (None, [1.0, 0.0]), (8, [float("nan"), 1.0]), (9, [0.0, 1.0]), (9, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("cell", F.lit("x"))
    found = {r["vec_id"]: (r["group_id"], r["keep"]) for r in E.near_duplicates(df).collect()}
    assert found == {1: (1, True), 2: (1, False), 3: (3, True), 4: (4, True), 5: (5, True), 6: (6, True), 7: (7, True), 8: (8, True), 9: (3, False)}
    assert E.near_duplicates(df.where("false")).count() == 0


def brute_repeats(rows, depth):
    where = {}
    for i, text in rows:
        t = words(text) if text else []
        for k in range(len(t) - depth + 1):
            where.setdefault(tuple(t[k : k + depth]), []).append((i, k))
    covered = {}
    for places in where.values():
        if len(places) > 1:
            for i, k in places:
                covered.setdefault(i, set()).add(k)
    out = []
    for i, starts in covered.items():
        if i is None:
            continue
        begin = last = None
        for k in sorted(starts):
            if begin is None or k > last + depth:
                if begin is not None:
                    out.append((i, begin, last + depth, last + depth - begin))
                begin = k
            last = k
        out.append((i, begin, last + depth, last + depth - begin))
    return sorted(out)


@pytest.mark.parametrize(("seed", "depth", "few", "hot"), [(1, 50, 9999, None), (2, 12, 9999, None), (3, 12, 3, None), (4, 5, 2, None), (2, 12, 9999, 0), (3, 12, 3, 5), (4, 5, 2, 40)])
def test_repeated_passages_are_the_brute_force_result(spark, monkeypatch, seed, depth, few, hot):
    if hot is not None:  # digits with more rows are worked on batch by batch
        monkeypatch.setattr(R, "HOT", hot)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    rng = random.Random(seed)
    vocab = vocabulary(rng)[:few]
    passages = [[rng.choice(vocab) for _ in range(rng.randint(depth - 2, 3 * depth))] for _ in range(6)]
    rows = []
    for k in range(60):
        text = [rng.choice(vocab) for _ in range(rng.randint(0, 4 * depth))]
        for p in rng.sample(passages, rng.randint(0, 2)):
            at = rng.randint(0, len(text))
            text[at:at] = p
        rows.append((k, " ".join(text)))
    rows += [(100, "same " * (depth + 5)), (101, None), (102, ""), (None, rows[0][1] + " " + " ".join(passages[0]))]
    found = R.repeats(spark.createDataFrame(rows, "doc_id long, text string").withColumn("start", F.lit("clash")), depth)
    assert sorted(map(tuple, found.collect())) == brute_repeats(rows, depth)
    assert R.repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_a_passage_of_many_texts_travels_once_a_portion(spark):
    rng = random.Random(3)
    vocab = vocabulary(rng)
    passage = [rng.choice(vocab) for _ in range(70)]
    texts = [[f"a{k}x{j}" for j in range(30)] + passage + [f"b{k}x{j}" for j in range(30)] for k in range(200)]
    memo = Memo()
    batches = list(R.first_pass(list(range(200)), texts, [memo.array(t) for t in texts], 50, R.primed(b"")[0]))
    inside = sum(len(R.primed(b"")[1].decompress(w).split()) - 49 for w in batches[1].column("words").to_pylist())
    assert inside == 200 * (130 - 49) - 199 * 21  # each window of the passage once
    told = {(i, s, n) for i, s, n in zip(*(batches[0].column(c).to_pylist() for c in ("doc_id", "start", "windows")), strict=True)}
    assert told == {(k, 30, 21) for k in range(200)}


def test_passes_are_the_sorted_windows():
    rng = np.random.default_rng(3)
    for few, depth in ((2, 7), (3, 12), (40, 25)):
        tokens = rng.integers(0, few, 4000).astype(np.int32)
        tokens[3000:3300] = tokens[100:400]
        at = np.arange(len(tokens) - depth + 1)
        group = rng.integers(0, 2, len(at))
        kind = R.radix(tokens, at, group, depth)
        same = {}
        for k in at.tolist():
            same.setdefault((group[k], tokens[k : k + depth].tobytes()), []).append(k)
        assert sorted(map(tuple, (np.flatnonzero(kind == c) for c in np.unique(kind[kind >= 0])))) == sorted(tuple(m) for m in same.values() if len(m) > 1)


def test_windows_alike_by_hash_only_stay_apart(monkeypatch):
    monkeypatch.setattr(R, "rolling", lambda tokens, width, up, down: np.zeros(len(tokens) - width + 1, np.uint64))
    tokens = np.array([1, 2, 3, 4, 1, 2, 3, 5, 1, 2, 3, 4], np.int32)
    assert R.radix(tokens, np.array([0, 4, 8]), np.zeros(3, np.int64), 4).tolist() == [0, -1, 0]


def test_groups_that_span_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        rows = [(k, " ".join(f"w{j}" for j in range(30)) + f" {k}") for k in range(25)]
        found = R.repeats(spark.createDataFrame(rows, "doc_id long, text string"), 10)
        assert sorted(map(tuple, found.collect())) == [(k, 0, 30, 30) for k in range(25)]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize(("query", "sql", "tables"), [(R.op3_suffix_dedup, R.ORACLE, ["documents"]), (E.op1_embedding_dedup, E.ORACLE, ["embeddings"])])
def test_against_sql(spark, query, sql, tables):
    sf_dir = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    want = con.execute(sql)
    names = [d[0] for d in want.description]
    assert sorted(tuple(r[n] for n in names) for r in query(spark, sf_dir).collect()) == sorted(want.fetchall())


A, B = "alpha beta gamma delta epsilon zeta eta theta", "iota kappa lambda mu nu xi omicron pi rho"


@pytest.mark.parametrize(
    ("rows", "kept"),
    [
        ([(1, A), (9, A), (9, B)], [(1, A), (9, B)]),
        ([(1, A), (9, A), (9, B), (12, B)], [(1, A), (9, B)]),
        ([(4, A), (4, A)], [(4, A)]),
        ([(None, A), (None, A)], [(None, A)]),
        ([(None, A), (3, A), (None, B), (None, None), (None, None), (5, ""), (5, "")], [(None, None), (None, None), (None, B), (3, A), (5, ""), (5, "")]),
        ([], []),
    ],
)
def test_one_row_of_each_group_stays(spark, rows, kept):
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as row", "1 as told_doc", "2 as h", "map('a', 1) as root")
    found = S.keep_one(spark, docs, "")
    assert found.columns == docs.columns
    key = lambda r: (r[0] or 0, r[1] or "")
    assert sorted(((r["doc_id"], r["text"]) for r in found.collect()), key=key) == sorted(kept, key=key)


def test_places_in_small_portions_change_nothing(spark, monkeypatch):
    rows = spark.createDataFrame(corpus(6, 40), DOCS)
    a = sorted(map(tuple, S.near_duplicates(rows).collect()))
    monkeypatch.setattr(S, "HELD", 5)
    monkeypatch.setattr(S, "TASK_ROWS", 700)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        assert sorted(map(tuple, S.near_duplicates(rows).collect())) == a
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_decisions_are_broadcast_or_shuffled_alike(spark, monkeypatch):
    docs = spark.createDataFrame([*corpus(4, 15), *corpus(4, 15)[:9], (None, A, "en", "s", None)], DOCS)
    key = lambda rows: sorted(map(repr, rows))
    a = key(S.keep_one(spark, docs, "").collect())
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    assert key(S.keep_one(spark, docs, "").collect()) == a
