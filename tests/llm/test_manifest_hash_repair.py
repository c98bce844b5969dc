"""Merkle manifest, multiset hash and conversation repair against brute force, on frames with nulls, ties, repeated and long rows."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from marketloom.llm import merkle, multihash, queries, repair
from tests.oracle import compare, duck

SF = "/root/testdata/sf0.01"
BLANKS = " \t\n\x0b\x0c\r"


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


# ---- Merkle manifest ----


def leaf_of(values):
    return digest(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def tree_of(digests, arity):
    levels = [digests]
    while len(levels[-1]) > 1:
        levels.append([digest(*levels[-1][i : i + arity]) for i in range(0, len(levels[-1]), arity)])
    return levels


def steps_of(levels, i, arity):
    for level in levels[:-1]:
        at = i // arity * arity
        yield level[at:i], level[i + 1 : at + arity]
        i //= arity


def brute_manifest(rows, arity):
    groups = defaultdict(list)
    for key, value, text in rows:
        groups[value].append((key is not None, key or 0, leaf_of((key, value, text)), key))
    order = sorted(groups, key=lambda v: (v is not None, (v or "").encode()))
    trees = {v: tree_of([r[2] for r in sorted(groups[v])], arity) for v in order}
    top = tree_of([trees[v][-1][0] for v in order], arity)
    out = Counter()
    for k, v in enumerate(order):
        for i, (_, _, leaf, key) in enumerate(sorted(groups[v])):
            path = [*steps_of(trees[v], i, arity), *steps_of(top, k, arity)]
            altered = digest(leaf)
            for left, right in path:
                altered = digest(*left, altered, *right)
            out[key, leaf, trees[v][-1][0], top[-1][0], digest(*[x for left, right in path for x in left + right]), altered] += 1
    return out


def built(df, arity):
    found = merkle.proofs(merkle.build(df, ["doc_id", "source", "text"], "doc_id", "source", arity))
    bent = merkle.fold(merkle.node_digest(F.col("leaf")), F.col("path"))
    columns = [F.col("leaf"), F.col("subroot"), F.col("root"), merkle.proof_digest(F.col("path")), bent, merkle.fold(F.col("leaf"), F.col("path")) == F.col("root")]
    got = found.select("key", *[merkle.hex_text(c) for c in columns[:-1]], columns[-1]).collect()
    assert all(r[-1] for r in got)
    return Counter(tuple(r[:-1]) for r in got)


@pytest.mark.parametrize("arity", [2, 3, 16])
def test_merkle(spark, arity):
    rows = [(i, "hot", f"t{i % 7}") for i in range(70)] + [(None, None, None), (None, "hot", "x"), (3, "hot", "t3"), (3, "hot", "t3"), (5, "", ""), (6, "ÿ", "É" * 300_000)]
    rows += [(100 + i, f"s{i}", "one leaf") for i in range(20)] + [(200 + i, "seventeen", None) for i in range(17)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame([(*r, 1, "a", b"b", 2) for r in rows], "doc_id long, source string, text string, idx int, tree string, digest binary, _part int")
    assert built(df, arity) == brute_manifest(rows, arity)


def test_merkle_small_tables(spark):
    schema = "doc_id long, source string, text string"
    assert built(spark.createDataFrame([], schema), 16) == Counter()
    for rows in ([(1, "a", "b")], [(1, "a", "b"), (2, "a", None)], [(1, "a", "b"), (2, None, "b")]):
        assert built(spark.createDataFrame(rows, schema), 16) == brute_manifest(rows, 16)
    with pytest.raises(ValueError):
        merkle.build(spark.createDataFrame([], schema), ["text"], "doc_id", "source", 1)


def test_merkle_query(spark):
    status, note, *_ = compare(spark, duck(SF), SF, "op11_merkle", queries.op11_merkle, queries.ORACLES["op11_merkle"])
    assert status == "ok", note


# ---- multiset hash ----

TEXTS = [
    "", None, "one", "one two three", "a b\nc d\na b", "a b\na b\nc d", "a b\nc d", " a  b\n\n", "Ünï\x00 cødé 漢字かな交じり文" * 30, "漢" * 4000,
    "x y z " * 3000, "line of words here\n" * 500, "w" * 200_000, " ".join(f"w{i}" for i in range(30_000)),
]


def prints(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return {r.i: r.f for r in df.select("i", multihash.fingerprint(F.col("t")).alias("f")).collect()}


def test_multiset_hash(spark):
    f = prints(spark, TEXTS)
    assert f[0] == f[1] and f[4] == f[5] != f[6]
    assert len({tuple(x) for x in f.values()}) == len(TEXTS) - 2
    # The sum of the paragraphs' own vectors, lane by lane.
    for i, t in enumerate(TEXTS):
        parts = Counter((t or "").split("\n"))
        own = prints(spark, list(parts))
        want = [sum(own[k][j] * n for k, n in enumerate(parts.values())) % (m + 1) for j, m in enumerate(multihash.MASKS)]
        assert f[i] == want


def test_multiset_hash_runs(spark):
    """Counters of the runs, told apart by how often they stood before, from the hashes Spark gives."""
    text = "a b a b a b a c\nb a b"
    runs = Counter()
    keyed = []
    for p in text.split("\n"):
        w, seen = p.split(" "), Counter()
        for i in range(len(w)):
            run = tuple(w[i : i + 3])
            keyed.append((*run, *[None] * (3 - len(run)), seen[run]))
            seen[run] += 1
    df = spark.createDataFrame(keyed, "a string, b string, c string, n int")
    unit = F.xxhash64(F.xxhash64("a", "b", "c"), F.col("n"))
    for r in df.select(unit.alias("u")).collect():
        runs[(r.u + (1 << 63)) * 120 >> 64] += 1
    got = prints(spark, [text])[0]
    assert got[0] == len(keyed)
    assert all((got[1 + j] >> (20 * k)) & 0xFFFFF == runs[3 * j + k] for j in range(40) for k in range(3))


def test_multiset_hash_algebra(spark):
    df = spark.createDataFrame([("g", "a b\nc"), ("g", "d"), ("h", "a b"), ("h", "c\nd")], "g string, t string").withColumn("f", multihash.fingerprint(F.col("t")))
    groups = {r.g: r.f for r in multihash.combine(df, "f", ["g"]).collect()}
    assert groups["g"] == groups["h"] == prints(spark, ["a b\nc\nd"])[0]
    both = df.limit(1).select(multihash.subtract(multihash.add("f", multihash.fingerprint(F.lit("q r"))), multihash.fingerprint(F.lit("c"))).alias("x")).first().x
    assert both == prints(spark, ["q r\na b"])[0]
    assert multihash.combine(df.where("false"), "f", ["g"]).count() == 0


def brute_edits(rows):
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0), reverse=True)
    out = []
    for k, (i, t) in enumerate(rows):
        n = len(t) // 3
        out.append((i, t[: len(t) - n] + rows[(k + 1) % len(rows)][1][:n], rows[(k + 1) % len(rows)][1]))
    return out


@pytest.mark.parametrize("size", [1, 2, 40])
def test_next_edit(spark, size):
    rows = [(3 * i - 20, t) for i, t in enumerate((TEXTS * 3)[:size])]
    rows += [(None, "last of all\nbefore the first")] if size > 2 else []
    df = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], "doc_id int, text string, lanes int, _k int, next_text string")
    got = {r.doc_id: r for r in multihash.next_edit_fingerprints(df).collect()}
    want = brute_edits(rows)
    assert len(got) == len(rows)
    fresh = prints(spark, [e for _, e, _ in want])
    for k, (i, edited, _) in enumerate(want):
        assert got[i].edited == edited and got[i].edited_lanes == fresh[k]
        assert 0 <= got[i].near_next <= 1 and 0 <= got[i].near_edited <= 1


def test_next_in_many_buckets(spark):
    rows = [(i * i % 1009, f"t{i}") for i in range(900)] + [(7, "tie")] * 40 + [(None, "n")] * 3
    df = spark.createDataFrame(rows, "k int, t string")
    got = multihash.with_next(df, "k", "t", {"t": F.col("t"), "kk": F.col("k")}, rows_per_bucket=16).collect()
    assert Counter((r.k, r.t) for r in got) == Counter(rows)
    order = sorted({k for k, _ in rows if k is not None}, reverse=True)
    follows = {a: {a, b} for a, b in zip(order, [*order[1:], None], strict=True)} | {None: {None, order[0]}}
    assert all(r.next_kk in follows[r.k] for r in got)
    assert Counter((r.next_kk, r.next_t) for r in got) == Counter(rows)


def test_multiset_hash_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = {i: (e, n) for i, e, n in brute_edits([tuple(r) for r in docs])}
    texts = {r.doc_id: r.text or "" for r in docs}
    got = queries.op12_multiset_hash(spark, SF).collect()
    assert {r.doc_id: (r.n_chars, r.edited_sha256) for r in got} == {i: (len(t), digest(want[i][0])) for i, t in texts.items()}

    def runs(t):
        out = Counter()
        for p in t.split("\n"):
            w = [x for x in re.split(f"[{BLANKS}]+", p) if x]
            out.update((tuple(w[i : i + 3]), n) for i, n in occurrences(w))
        return out

    def occurrences(w):
        seen = Counter()
        for i in range(len(w)):
            yield i, seen[tuple(w[i : i + 3])]
            seen[tuple(w[i : i + 3])] += 1

    def alike(a, b):
        x, y = runs(a), runs(b)
        mass = sum(n * n for n in x.values()) + sum(n * n for n in y.values())
        return 2 * sum(n * y[k] for k, n in x.items()) / mass if mass else float(a == b)

    off = sorted(abs(r.near_edited - alike(texts[r.doc_id], want[r.doc_id][0])) for r in got)
    assert off[len(off) // 2] < 0.05 and off[int(len(off) * 0.95)] < 0.2
    assert sum(r.near_edited > r.near_next for r in got if r.n_chars > 60) > 0.99 * sum(r.n_chars > 60 for r in got)
    assert len({(texts[r.doc_id], r.fingerprint) for r in got}) == len(set(texts.values()))


# ---- conversation repair ----

STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
NAMES = {"u": "user", "a": "assistant"}


def cheapest(turns):
    """(cost, audit, lines) over all lists of edits, least first, state by state from the front."""

    def put(best, state, value):
        if state is not None and (state not in best or value[:2] < best[state][:2]):
            best[state] = value
            return True
        return False

    def with_inserts(best):
        while any(put(best, STEP.get((s, x)), (c + 5, a + "I", (*t, NAMES[x] + ":"))) for s, (c, a, t) in list(best.items()) for x in "ua"):
            pass
        return best

    best = with_inserts({0: (0, "", ())})
    for role, text, fault in turns:
        after = {}
        for s, (c, a, t) in best.items():
            put(after, s, (c + 2, a + "D", t))
            if fault not in ("blank", "duplicate"):
                more = c + 5 * (fault == "truncated")
                put(after, STEP.get((s, role[:1])), (more, a + "K", (*t, f"{role}:{text}")))
                for x in "ua":
                    put(after, STEP.get((s, x)), (more + 1, a + "R", (*t, f"{NAMES[x]}:{text}")))
        best = with_inserts(after)
    return min((best[s] for s in (0, 3) if s in best), key=lambda v: v[:2])


def brute_repair(rows, plant):
    conversations = defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        held = conversations[conv]
        case = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20 if plant else None
        if case != 0:
            text = "" if case == 1 else re.sub("[.!?]", "", text) if case == 2 else text
            held.extend([(turn, "user" if case == 4 else role, text)] * (2 if case == 3 else 1))
    out = Counter()
    for conv, turns in conversations.items():
        turns.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.md5(r[2].encode()).digest()))
        seen, faults = set(), []
        for _, role, text in turns:
            body = text.strip(BLANKS)
            faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "none")
            seen.add((role, text))
        at = [t for t, _, _ in turns if t is not None]
        n = Counter(faults)
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
        cost, audit, lines = cheapest([(r, x, f) for (_, r, x), f in zip(turns, faults, strict=True)])
        gaps = max(at) - min(at) + 1 - len(set(at)) if at else 0
        out[conv, gaps, n["blank"], n["duplicate"], n["truncated"], illegal, cost, audit, digest("\n".join(lines))] += 1
    return out


def repaired(df, ids=None, least=64):
    return Counter(tuple(r) for r in repair.summaries(repair.repair(df, ids, least)).collect())


@pytest.mark.parametrize("least", [1, 5, 64])
def test_repair(spark, least):
    rng = random.Random(least)
    rows = []
    for conv in range(150):
        for t in range(rng.randint(1, 45)):
            role = rng.choice(["user", "assistant", "system", "tool", None, "", "user", "assistant"])
            rows.append((conv or None, rng.choice([t, t, t // 2, None]), role, rng.choice(["a.", "b", "b?", "", " \t\n", None, f"w{t}.", f"w{t}! \n", f"é{t}"])))
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "conv_id int, turn int, role string, text string, at int, `group` string, kind int")
    assert repaired(df, least=least) == brute_repair(rows, plant=False)
    assert repaired(queries.damaged(df), df.select("conv_id").distinct(), least) == brute_repair(rows, plant=True)


def test_repair_edges(spark):
    schema = "conv_id string, turn long, role string, text string"
    empty = spark.createDataFrame([], schema)
    assert repaired(empty) == Counter()
    nothing = (0,) * 6
    assert repaired(empty, spark.createDataFrame([("a",), (None,)], "conv_id string")) == Counter({(c, *nothing, "", digest("")): 1 for c in ("a", None)})
    # One long conversation, mostly copies of one row, and a very long text: blocks end inside the run of copies.
    rows = [("hot", t, ("user", "assistant")[t % 2], f"turn {t}." if t % 9 else "cut") for t in range(3000)] + [("hot", 70, "user", "same.")] * 2500 + [("x", 1, "user", "y" * 3_000_000 + "!")]
    got = repair.repair(spark.createDataFrame(rows, schema))
    assert Counter(tuple(r) for r in repair.summaries(got).collect()) == brute_repair(rows, plant=False)
    kept = got.where("conv_id = 'hot' AND edit != 'D'").select("role").collect()
    assert re.fullmatch("s?(ua)+", "".join(r.role[0] for r in kept))


def test_repair_query(spark):
    status, note, *_ = compare(spark, duck(SF), SF, "op13_conversation_repair", queries.op13_conversation_repair, queries.ORACLES["op13_conversation_repair"])
    assert status == "ok", note
