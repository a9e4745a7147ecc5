"""Sharding, the filter audit and the Merkle manifest against plain Python."""
from __future__ import annotations

import collections
import hashlib
import itertools
import random
import zlib

import pytest

from opslens.llm import filter_audit, merkle, sharding
from opslens.llm.common import shared_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard_x int, mark string, pos long"


@pytest.fixture(scope="module")
def rows():
    """Copies, nulls, repeats, a hot source, capitals, signs, one long text."""
    rng = random.Random(11)
    word = lambda: rng.choice("alpha beta Gamma DELTA epsilon zeta $eta theta iota é 中文".split())
    body = [f"w{i}" for i in range(150)]
    out = []
    for i in range(700):
        kind = rng.random()
        if kind < 0.3:
            text = "the same text for a third of all rows"
        elif kind < 0.5:
            text = " ".join(word() for _ in range(rng.randint(0, 160)))
        elif kind < 0.7:
            text = " ".join(rng.sample(body, rng.randint(90, 150))) + rng.choice(["", "", " #tag", "\x0bX" * 40, " NB"])
        elif kind < 0.8:
            text = rng.choice(["", None, " \t\n", "ABC", "a|b"])
        else:
            text = " ".join(rng.sample(body, 120))
        source = rng.choice(["hot", "hot", "hot", "b", "", None, f"s{rng.randint(0, 30)}", "\U0001f600", "ｚ"])
        out.append((i, text, rng.choice(["en", "de", None, ""]), source, rng.choice([None, len(text or "")]), 1, "x", 7))
    out += [out[0], out[0], out[5][:1] + ("other text",) + out[5][2:], (None, "null id", "en", "hot", 1, 1, "x", 1)]
    out += [(None, "the same text for a third of all rows", "en", "hot", 1, 1, "x", 1), (-4, "Early", "de", "b", 2, 0, "", 0)]
    out.append((9999, "Zz " * 200_000, "fr", "long", 600_000, 0, "", 0))
    rng.shuffle(out)
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


# --- 11 -----------------------------------------------------------------------

def places(rows, shards):
    """Rows in order with their bytes before, and the size of their group."""
    data = [(hashlib.sha256((r[1] or "").encode()).digest(), r[0] is not None, r[0] or 0, r[1] or "") for r in rows]
    out, before = [], 0
    for _, known, doc_id, text in sorted(data):
        size = len(text.encode()) + 16
        out.append((doc_id if known else None, text, size, before))
        before += size
    return out, before


@pytest.mark.parametrize("shards,slack", [(40, 0.01), (7, 0.0), (5, 0.4), (1, 0.01)])
def test_shards(docs, rows, shards, slack):
    got = sharding.assign_shards(docs, shards, slack).collect()
    want, total = places(rows, shards)
    ends = {}
    for _, text, size, before in want:
        lo, hi = ends.get(text, (before, before))
        ends[text] = (min(lo, before), max(hi, before + size))
    cuts = []
    for k in range(1, shards):
        cut = total * k // shards
        for lo, hi in ends.values():
            if lo < cut < hi and (hi - lo) * shards <= 2 * slack * total:
                cut = lo if cut - lo <= hi - cut else hi
                break
        cuts.append(cut)
    expected = collections.Counter()
    filled = collections.Counter()
    for doc_id, text, size, before in want:
        shard = sum(2 * before + size >= 2 * cut for cut in cuts)
        expected[(doc_id, size, zlib.crc32(text.encode()), "bytes", shard, filled[shard], None)] += 1
        filled[shard] += 1
    assert collections.Counter(tuple(r) for r in got) == expected
    largest = max(size for _, _, size, _ in want)
    held = collections.Counter()
    for r in got:
        held[r["shard"]] += r["size"]
    assert all(abs(b - total / shards) <= largest + 2 * slack * total / shards for k, b in held.items())


def test_shards_stay_whole_and_are_written(spark, docs, rows):
    some = docs.where("doc_id is null or doc_id != 9999")
    plan = sharding.assign_shards(some, 4)
    path = shared_path(spark, "shards")
    sharding.write_shards(some, path, 4)
    back = spark.read.parquet(path)
    assert {*back.columns} == {*docs.columns, "shard"} and back.count() == len(rows) - 1
    key = lambda df: collections.Counter((r["doc_id"], r["shard"]) for r in df.select("doc_id", "shard").collect())
    a, b = key(plan), key(back)
    assert sum((a - b).values()) <= 2 * 3  # rows that repeat doc_id and text stay together when written


def test_shards_of_little(spark, docs):
    assert sharding.assign_shards(docs.limit(0)).count() == 0
    few = sharding.assign_shards(spark.createDataFrame([(1, None), (2, "é")], "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["size"], r["text_crc32"], r["slot"]) for r in few) == [
        (1, 16, 0, 0), (2, 18, zlib.crc32("é".encode()), 0)]
    assert len({r["shard"] for r in few}) == 2 and {r["shard"] for r in few} <= set(range(40))
    path = shared_path(spark, "no-shards")
    sharding.write_shards(docs.limit(0), path, 4)


# --- 12 -----------------------------------------------------------------------

def failed(rows):
    least = {}
    for r in rows:
        if r[0] is not None:
            least[r[1] or ""] = min(r[0], least.get(r[1] or "", r[0]))
    for doc_id, text, lang, *_ in rows:
        t = text or ""
        words = [w for w in "".join(" " if c in "\t\n\v\f\r " else c for c in t).split(" ") if w]
        fails = ""
        fails += "A" if len(words) < 100 else ""
        fails += "B" if 100 * len(set(words)) < 80 * len(words) else ""
        fails += "C" if 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t) else ""
        fails += "D" if any(c in "#$%&*|" for c in t) else ""
        fails += "E" if doc_id is not None and least[t] < doc_id else ""
        yield doc_id, lang or "", fails


def test_filter_audit(spark, docs, rows):
    labels = [(i, i % 2, i % 3 % 2) for i in range(0, 700, 2)] + [(3, None, 1), (3, 1, None), (None, 1, 1), (4, 1, 1)]
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    bad = {i for i, _, t in labels if t == 1 and i is not None}
    got = filter_audit.document_audit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    want = collections.defaultdict(collections.Counter)
    shapley = collections.Counter()
    judged = list(failed(rows))
    for (part, order), step in itertools.product(itertools.product({p for _, p, _ in judged}, itertools.permutations("ABCDE")), range(6)):
        if step:
            want[part, "".join(order), step] = collections.Counter()
    for doc_id, part, fails in judged:
        for order in itertools.permutations("ABCDE"):
            hit = [f in fails for f in order]
            gone = hit.index(True) if any(hit) else 9
            for step, f in enumerate(order):
                c = want[part, "".join(order), step + 1]
                c["kept"] += gone > step
                c["removed"] += gone == step
                c["redundant"] += hit[step] and gone < step
                c["unique_fails"] += fails == f
                c["good_lost"] += gone == step and doc_id in good
                c["toxic_lost"] += gone == step and doc_id in bad
                shapley[part, f] += gone == step
    got = got.collect()
    assert len(got) == len(want) == 600 * len({p for _, p, _ in judged})
    for r in got:
        c = want[r["part"], r["filter_order"], r["step"]]
        names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"]
        assert [r[n] for n in names] == [c[n] for n in names], r
        assert r["shapley"] == shapley[r["part"], r["filter_order"][r["step"] - 1]]


def test_filter_audit_of_nothing(spark, docs):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.document_audit(docs.limit(0), labels).count() == 0
    alone = filter_audit.document_audit(spark.createDataFrame([(1, None, None)], "doc_id long, text string, lang string"), labels)
    assert {(r["filter_order"][0], r["removed"]) for r in alone.where("step = 1").collect()} == {(f, int(f == "A")) for f in "ABCDE"}


# --- 13 -----------------------------------------------------------------------

def H(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf(doc_id, text, lang, source, n_chars):
    fields = [None if f is None else str(f) for f in (doc_id, source, lang, n_chars, text)]
    return H("".join("-" if f is None else f"{len(f.encode())}:{f}" for f in fields))


def tree(leaves):
    """Root and, for every leaf, (left, right) siblings a level."""
    paths, at = [[] for _ in leaves], [[i] for i in range(len(leaves))]
    while len(leaves) > 1:
        runs = [range(i, min(i + 16, len(leaves))) for i in range(0, len(leaves), 16)]
        for run in runs:
            for i in run:
                for k in at[i]:
                    paths[k].append(("".join(leaves[run[0] : i]), "".join(leaves[i + 1 : run[-1] + 1])))
        at = [[k for i in run for k in at[i]] for run in runs]
        leaves = [H("".join(leaves[i] for i in run)) for run in runs]
    return leaves[0] if leaves else None, paths


def manifest(rows):
    by = collections.defaultdict(list)
    for r in rows:
        x = leaf(*r[:5])
        hit = r[0] is not None and r[1] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in r[1]) if hit else r[1]
        by[r[3]].append((r[0] is not None, r[0] or 0, x, leaf(r[0], lower, *r[2:5])))
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    subtrees = [tree([x[2] for x in sorted(by[s])]) for s in sources]
    root, above = tree([t[0] for t in subtrees])
    for s, (subroot, paths), more in zip(sources, subtrees, above):
        for (known, doc_id, x, found), path in zip(sorted(by[s]), paths):
            folded = found
            for left, right in path + more:
                folded = H(left + folded + right)
            proof = H("".join(left + right for left, right in path + more))
            yield doc_id if known else None, x, subroot, root, proof, folded, folded == root


@pytest.mark.parametrize("levels", [1, 2])
def test_merkle(docs, rows, levels):
    got = merkle.merkle_manifest(docs, merkle.lower_some(), levels=levels).collect()
    assert collections.Counter(tuple(r) for r in got) == collections.Counter(manifest(rows))
    assert 0 < sum(not r["verified"] for r in got) < len(got)


@pytest.mark.parametrize("n", [0, 1, 2, 16, 17, 256, 257, 300])
def test_merkle_of_one_source(spark, n):
    rows = [(i, f"Text {i}", "en", None, i) for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = merkle.merkle_manifest(df, merkle.lower_some(), proofs=True).collect()
    assert sorted(tuple(r)[:7] for r in got) == sorted(manifest(rows))
    assert all(merkle.verify(r["leaf"], r["witness"], r["root"]) for r in got)
    assert not any(merkle.verify(H("another"), r["witness"], r["root"]) for r in got)


def test_merkle_of_single_leaves(spark):
    """Every source has one leaf: the leaves are the subroots."""
    rows = [(i, f"T{i}", None, f"s{i:03}", None) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = merkle.merkle_manifest(df, merkle.lower_some()).collect()
    assert sorted(map(tuple, got)) == sorted(manifest(rows)) and all(r["leaf"] == r["subroot"] for r in got)


def test_subtree_heights():
    assert [merkle.height(n, 9) for n in (0, 1, 2, 16, 17, 256, 257)] == [0, 0, 1, 1, 2, 2, 3] and merkle.height(10**6, 2) == 2
