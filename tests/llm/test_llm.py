"""Each operator against a brute-force version, and on awkward tables."""
from __future__ import annotations

import collections
import gc
import hashlib
import itertools
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from opslens.llm import (
    bpe, common, components, cover_tree, decontaminate, hashing, langid, line_dedup, ngram_join, quality, queries, secrets,
    substring_dedup, token_stream,
)
from opslens.llm.common import shared_path

RANKS = (P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
SF = "/root/testdata/sf0.001"
VOCABULARY = [f"w{i}" for i in range(400)]


def words(rng, n):
    return [rng.choice(VOCABULARY) for _ in range(n)]


@pytest.fixture(scope="module")
def texts():
    """Fresh texts, copies, near copies, a shared passage, and odd ones."""
    rng = random.Random(5)
    base = words(rng, 120)
    passage = words(rng, 60)
    out = [" ".join(words(rng, rng.randint(1, 200))) for _ in range(40)]
    for _ in range(25):
        near = list(base)
        for _ in range(rng.randint(0, 6)):
            near[rng.randrange(120)] = rng.choice(VOCABULARY)
        out.append(" ".join(near))
    out += [" ".join(base)] * 5 + [" ".join(words(rng, 20) + passage + words(rng, 20)) for _ in range(12)]
    out += [None, "", " \n\t", "one two", "One TWO", "a b c", "x " * 300, "été 中文 \U0001f600 ß", " ", ("z" * 50 + " ") * 2000]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "odd", float(i)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, id string, n double").repartition(3)


def empty(spark, schema="doc_id long, text string"):
    return spark.createDataFrame([], schema)


def roots(n, links):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(400, i) for i in range(401, 460)]
    edges += [(i, i + 1) for i in range(500, 560)]
    got = dict(components.connected_components(
        spark.createDataFrame([*edges, (None, 3)], "a long, b long")).collect())
    want = roots(600, edges)
    assert {i: got.get(i, i) for i in range(600)} == dict(enumerate(want))


# --- 1 ------------------------------------------------------------------------

def test_what_is_written_leaves_no_garbage_to_the_driver(spark, monkeypatch):
    jvm = spark.sparkContext._jvm
    monkeypatch.setattr(common, "_due", 0.0, raising=False)
    garbage = jvm.java.lang.Object()
    held = jvm.java.lang.ref.WeakReference(garbage)
    del garbage
    gc.collect()
    assert common.written(spark.range(5), "some").count() == 5
    assert held.get() is None
    assert "rim" in common._trim_jvm(spark.sparkContext)  # memory trimmed, or no way to trim it


def test_driver_is_not_relieved_all_the_time(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(common, "_due", 0.0)
    monkeypatch.setattr(common, "_trim_jvm", asked.append)
    for _ in range(3):
        common.relieve_driver(spark)
    assert len(asked) == 1


def test_secrets(spark):
    text = 'K = "q8X2mZpL0vR7tYw3"\npassword = K\napi_key: "' + "ab12" * 8 + '" AKIA' + "A1" * 9 + " é" * 3 + " TOKEN=short\n"
    rows = secrets.secret_scan(spark.createDataFrame([(1, text), (2, None), (None, "")], "doc_id long, text string")).collect()
    r = {x["doc_id"]: x for x in rows}
    assert (r[1]["n_assign"], r[1]["n_access"], r[1]["n_hex"]) == (1, 1, 1)
    assert "literal:5:21" in r[1]["spans"] and r[2]["spans"] == "" and None in r
    assert r[2]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    assert secrets.base_spans("passwd:token:abcdefgh") == []  # the short value took the name
    assert secrets.base_spans("ſecret=abcdefgh") == []  # only ASCII letters have cases
    assert not secrets.literal_spans("password: changeme") and not secrets.literal_spans("note: the password is long")
    assert secrets.literal_spans('authToken = "abc1" + "DEF2ghi3JKL4"') == [(13, 3, 17), (22, 3, 34)]
    assert secrets.secret_scan(empty(spark)).count() == 0


def test_secrets_of_chained_and_packed_assignments():
    import time

    began = time.perf_counter()
    text = 'token = "k9Zq8X2mZ"\n' + "token = token + token\n" * 2000
    assert secrets.literal_spans(text) == [(9, 3, 18)]
    chain = 'x0 = "k9Zq8X2mZ"\n' + "".join(f'x{i} = x{i - 1} + "p{i}"\n' for i in range(1, 5000))
    assert max(len(spans) for _, spans in secrets.assignments(chain)) == secrets.MAX_PARTS + 1
    packed = "a=1&" * 100_000
    got = list(secrets.assignments(packed))
    assert len(got) == 100_000 and got[3] == ("a", [(14, len(packed))])
    assert time.perf_counter() - began < 60


# --- 2 ------------------------------------------------------------------------

@pytest.mark.parametrize("block", [16, 2048])
def test_embedding_links(spark, block):
    rng = np.random.default_rng(3)
    centre = rng.standard_normal(12)
    vecs = [centre + 0.15 * rng.standard_normal(12) * (i % 3) for i in range(90)] + list(rng.standard_normal((60, 12)))
    vecs += [vecs[4], vecs[4] * 2, vecs[100]]
    label = [i % 2 for i in range(len(vecs))]
    rows = [(i, [float(x) for x in v], label[i]) for i, v in enumerate(vecs)]
    n = len(rows)
    rows += [(n, None, 0), (n + 1, [0.0] * 12, 0), (n + 2, [float("nan")] * 12, 0), (n + 3, [None] * 12, 1),
             (n + 4, rows[0][1], None), (n + 5, [1.0, 2.0], 0), (n + 6, [], 0), (None, rows[0][1], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: r for r in cover_tree.embedding_links(df, block=block).collect()}
    links = [
        (i, j) for i, j in itertools.combinations(range(n), 2)
        if label[i] == label[j] and vecs[i] @ vecs[j] / (np.linalg.norm(vecs[i]) * np.linalg.norm(vecs[j])) >= 0.98
    ]
    count, root = collections.Counter(itertools.chain(*links)), roots(n, links)
    assert len(links) > 20
    for i in range(n):
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (count[i], root[i], root[i] == i)
    for i in range(n, n + 7):
        assert (got[i]["n_links"], got[i]["component_id"]) == (0, i)
    assert got[None]["n_links"] == 0 and got[None]["component_id"] is None
    none = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert cover_tree.embedding_links(none).count() == 0


# --- 3, 4 ---------------------------------------------------------------------

def test_language(spark):
    out = queries.op3_language_id(spark, SF).join(
        spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in out) >= 0.95 * len(out) > 0
    assert all(0 <= r["score"] <= 1 for r in out)
    model = langid.fit_language_model(spark.read.parquet(f"{SF}/documents.parquet"))
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 !"), (4, "die Verbindung und der " * 100_000)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in langid.predict_language(odd, model).collect()}
    assert {got[i]["lang_pred"] for i in (1, 2, 3)} == {"und"} and got[4]["lang_pred"] == "de"
    assert [r["doc_id"] for r in langid.accepted(odd, model).collect()] == [4]
    nothing = langid.fit_language_model(empty(spark, "doc_id long, text string, lang string"))
    assert {r["lang_pred"] for r in langid.predict_language(odd, nothing).collect()} == {"und"}
    whole = b"der die das und " * 1000
    parts = [langid.subwords(whole, lo, min(lo + 700, len(whole))) for lo in range(0, len(whole), 700)]
    assert np.array_equal(np.sort(np.concatenate(parts)), np.sort(langid.subwords(whole)))


def test_quality(spark):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    out = queries.op4_quality(spark, "/root/testdata/sf0.01").join(labels, "doc_id").where("held_out").collect()
    assert sum(r["predicted"] == r["quality"] for r in out) >= 0.95 * len(out) > 0
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in out)
    odd = spark.createDataFrame([(1, None), (1, ""), (None, "x")], "doc_id long, text string")
    none = empty(spark, "doc_id long, quality int")
    assert {r["score"] for r in quality.quality_scores(odd, none, F.lit(True)).collect()} == {0.5}
    assert quality.quality_scores(empty(spark), none, F.lit(True)).count() == 0
    assert quality.isotonic(np.arange(4), np.array([1, 1, 1, 1]), np.array([0, 1, 0, 1])).tolist() == [0, 0.5, 0.5, 1]


# --- 5 ------------------------------------------------------------------------

def low(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def bench_words(text):
    return "".join(c if c.isascii() and c.isalnum() or ord(c) >= 128 else " " for c in low(text or "")).split(" ")


@pytest.mark.parametrize("shard_chars", [16_000_000, 300])
def test_decontaminate(spark, texts, docs, shard_chars):
    items = [(1, " ".join(texts[40].split()[10:40])), (2, "One, two!"), (3, texts[70][:90]), (3, None), (None, texts[0]),
             (10, texts[40].upper()), (4, "--")]
    got = {r["doc_id"]: r for r in decontaminate.decontaminate(
        docs, spark.createDataFrame(items, "item_id long, text string"), shard_chars=shard_chars).collect()}
    windows = collections.defaultdict(set)
    for item, text in items:
        w = [x for x in bench_words(text) if x]
        for i in range(max(1, len(w) - 9) if w and item is not None else 0):
            windows[tuple(w[i : i + 10])].add(item)
    for i, text in enumerate(texts):
        w = [x for x in bench_words(text) if x]
        hit, named = set(), set()
        for size in {len(x) for x in windows}:
            for k in range(len(w) - size + 1):
                if (key := tuple(w[k : k + size])) in windows:
                    hit |= set(range(k, k + size))
                    named |= windows[key]
        assert (got[i]["n_words"], got[i]["n_hit"], got[i]["items"]) == (len(w), len(hit), sorted(named)), i
        assert sum(len([x for x in bench_words(text[s["start"] : s["end"]]) if x]) for s in got[i]["spans"]) == len(hit)
    nothing = decontaminate.decontaminate(docs, empty(spark, "item_id long, text string"))
    assert nothing.where("n_hit > 0").count() == 0 and nothing.count() == len(texts)


# --- 6 ------------------------------------------------------------------------

def edits(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        p, d = d, [i]
        for j, y in enumerate(b, 1):
            d.append(min(p[j] + 1, d[-1] + 1, p[j - 1] + (x != y)))
    return d[-1]


def test_edit_distance(spark):
    rng, pairs = random.Random(3), []
    for _ in range(600):
        a = [rng.choice("abé") for _ in range(rng.randint(16, 24))]
        b = list(a)
        for _ in range(rng.randint(0, 2)):
            k, q = rng.choice("sid"), rng.randrange(len(b))
            b[q : q + (k != "i")] = [] if k == "d" else [rng.choice("abé")]
        if abs(len(a) - len(b)) <= 1:
            a, b = sorted(("".join(a), "".join(b)), key=len, reverse=True)
            pairs.append((a, b, edits(a, b)))
    df = spark.createDataFrame(pairs, "a string, b string, d int").withColumn("g", line_dedup.edit_distance("a", "b"))
    assert df.where("(d <= 1) != (g <= 1) or (d <= 1 and d != g)").count() == 0


@pytest.mark.parametrize("hot", [128, 3])
def test_line_dedup(spark, monkeypatch, hot):
    monkeypatch.setattr(line_dedup, "HOT", hot)
    base = "this is the template line number "
    rows = [(i, "\n".join([f"{base}{i % 10}", f"unique start {i * 7919 % 1000} of a longer text", f"x{i}" * 10, "short",
                           base + chr(97 + i % 26) + ("" if i % 3 else "!")])) for i in range(40)]
    rows += [(41, ""), (42, "same line here, the same\n" * 5), (43, None)]
    got = {r["doc_id"]: tuple(r)[1:] for r in line_dedup.line_dedup(
        spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    at = collections.defaultdict(list)
    for i, t in rows:
        for k, line in enumerate((t or "").split("\n")):
            if len(line) >= 16:
                at[line].append((i, k))
    lines = list(at)
    root = roots(len(lines), [(a, b) for a, b in itertools.combinations(range(len(lines)), 2)
                              if abs(len(lines[a]) - len(lines[b])) <= 1 and edits(lines[a], lines[b]) <= 1])
    kind = {line: root[i] for i, line in enumerate(lines)}
    first = {}
    for line in lines:
        first[kind[line]] = min(first.get(kind[line], (99, 0)), min(at[line]))
    for i, t in rows:
        if t is None:
            assert got[i] == (0, 0, 0, False, None)
            continue
        own, others, seen, split = [], [], set(), t.split("\n")
        for k, line in enumerate(split):
            if line in kind:
                if kind[line] in seen:
                    own.append(k)
                elif first[kind[line]] != (i, k):
                    others.append(k)
                seen.add(kind[line])
        copy = sum(len(split[k]) for k in others) > 0.5 * (len(t) - sum(len(split[k]) for k in own))
        gone = set(own) if copy else set(own + others)
        kept = "\n".join(line for k, line in enumerate(split) if k not in gone)
        assert got[i] == (len(split), len(own) + len(others), len(gone), copy, kept)
    assert line_dedup.line_dedup(empty(spark)).count() == 0
    extra = spark.createDataFrame([(1, "a", 5), (1, "a", 5), (None, "b", 6)], "doc_id long, text string, line long")
    assert sorted(line_dedup.drop_repeated_lines(extra).collect(), key=str) == sorted(extra.collect(), key=str)


@pytest.mark.parametrize("k,hot", [(2, 128), (2, 4), (3, 128)])
def test_line_links_of_more_edits(spark, monkeypatch, k, hot):
    monkeypatch.setattr(line_dedup, "HOT", hot)
    rng = random.Random(k)
    lines = [f"this is the template line of number {i * 37 % 1000:03}" for i in range(0, 60, 3)]
    for _ in range(25):
        line = "".join(rng.choice("abcdefgh ") for _ in range(rng.randint(17, 45)))
        for _ in range(4):
            near = list(line)
            for _ in range(rng.randint(1, k + 1)):
                at = rng.randrange(len(near))
                near[at : at + rng.randint(0, 1)] = rng.choice(["", "x", "é"])
            lines.append("".join(near))
        lines.append(line)
    lines = sorted({x for x in lines if len(x) >= 16})
    table = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "id long, line string")
    near = {(a, b) for a, b in itertools.combinations(range(len(lines)), 2)
            if abs(len(lines[a]) - len(lines[b])) <= k and edits(lines[a], lines[b]) <= k}
    links = {tuple(sorted(r)) for r in line_dedup.line_links(table, k).collect()}
    assert links <= near and roots(len(lines), links) == roots(len(lines), near)
    assert roots(len(lines), near) != roots(len(lines), [p for p in near if edits(lines[p[0]], lines[p[1]]) < k])


@pytest.mark.parametrize("k", [1, 2, 3])
def test_filters_of_lines_lose_no_pair(spark, k):
    rng = random.Random(20 + k)
    pairs = [("", "", 0), ("a", "", 1)]
    for _ in range(800):
        a = [rng.choice("abé\U0001f600") for _ in range(rng.randint(0, 34))]
        b = list(a)
        for _ in range(rng.randint(0, k + 2)):
            q = rng.randrange(len(b) + 1)
            b[q : q + rng.randint(0, 1)] = rng.choice(["", "a", "é"])
        a, b = sorted(("".join(a), "".join(b)), key=len, reverse=True)
        if len(a) - len(b) <= k:
            pairs.append((a, b, edits(a, b)))
    df = spark.createDataFrame(pairs, "a string, b string, d int").withColumn("near", line_dedup._within("a", "b", k))
    df = df.withColumn("x", line_dedup._odd("a")).withColumn("y", line_dedup._odd("b"))
    assert df.where(f"near != (d <= {k})").isEmpty()
    assert df.where(f"d <= {k}").where(~line_dedup._roomy("x", "y", k)).isEmpty()


def test_few_pairs_of_lines_are_looked_at(spark, monkeypatch):
    """Not the square of a group of lines that agree on a segment."""
    rng = random.Random(4)
    lines = ["a template that all of these lines begin with " + "".join(rng.choice("abcdefghijkl") for _ in range(90)) for _ in range(120)]
    table = spark.createDataFrame(list(enumerate(lines)), "id long, line string")
    looked, real = [], line_dedup._linked
    monkeypatch.setattr(line_dedup, "_linked", lambda pairs, *rest: (looked.append(pairs.count()), real(pairs, *rest))[1])
    assert line_dedup.line_links(table, 2).isEmpty()
    assert sum(looked) <= 120


def test_slots_of_lines_pass_the_driver_as_bits(spark, monkeypatch):
    rng = random.Random(12)
    lines = [" ".join(words(rng, 8)) for _ in range(400)]
    lines += [x[:-1] + "#" for x in lines]
    table = spark.createDataFrame(enumerate(lines), "n long, line string").select(F.xxhash64("line").alias("id"), "line")
    monkeypatch.setattr(line_dedup, "SLOT_BITS", 10)
    sent, send = [], F.broadcast
    monkeypatch.setattr(F, "broadcast", lambda df: sent.append(df.count()) or send(df))
    links = line_dedup.line_links(table)
    assert len(sent) == 2 and max(sent) <= 2**10 / 64
    hashes = [r["id"] for r in spark.createDataFrame(enumerate(lines), "n long, line string").orderBy("n").select(F.xxhash64("line").alias("id")).collect()]
    assert {tuple(sorted(r)) for r in links.collect()} >= {tuple(sorted(x)) for x in zip(hashes, hashes[400:])}


def test_distance_comes_after_the_filters(spark):
    """In one condition: Spark does not keep the order of several."""
    table = spark.createDataFrame([(1, "a line of some length"), (2, "a line of same length")], "id long, line string")
    found = line_dedup._linked(spark.createDataFrame([(1, 2)], "a long, b long"), table, 2)
    assert found.count() == 1
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    with_distance = [row for row in plan.splitlines() if "Filter" in row and "split(" in row]
    assert len(with_distance) == 1 and with_distance[0].index("CASE WHEN") < with_distance[0].index("bin(") < with_distance[0].index("split(")


def test_repeated_lines_go_whatever_their_share(spark, tmp_path):
    import corpus_pipeline as pipeline

    shared = "a passage that stands in many documents and is long"
    rows = [(1, f"{shared}\nthe first document says this"), (2, f"{shared}\nshort end"), (3, shared), (4, f"tiny\n{shared}\n{shared}")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    table.write.parquet(f"{tmp_path}/documents.parquet")
    kept = {1: rows[0][1], 2: "short end", 3: "", 4: "tiny"}
    assert {r["doc_id"]: r["text"] for r in pipeline.lines(spark, table, "").collect()} == kept
    got = {r["doc_id"]: r for r in queries.op6_line_dedup(spark, str(tmp_path)).collect()}
    assert {i: r["kept_sha256"] for i, r in got.items()} == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in kept.items()}
    assert {i: (r["n_repeats"], r["n_removed"]) for i, r in got.items()} == {1: (0, 0), 2: (1, 1), 3: (1, 1), 4: (2, 2)}


def test_line_dedup_is_native(docs):
    plan = line_dedup.line_dedup(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


# --- 7 ------------------------------------------------------------------------

def shingle_set(text, n=4):
    w = low(text or "").encode().split()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


@pytest.mark.parametrize("block,hot,levels", [(512, 64, 3), (4, 2, 0), (4, 2, 2)])
def test_ngram_join(spark, monkeypatch, texts, docs, block, hot, levels):
    monkeypatch.setattr(ngram_join, "BLOCK_ROWS", block)
    sets = [shingle_set(t) for t in texts]
    links = [(a, b) for a, b in itertools.combinations(range(len(sets)), 2)
             if sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    root = roots(len(sets), links)
    got = {r["doc_id"]: tuple(r)[1:] for r in ngram_join.ngram_join(docs, hot=hot, levels=levels).collect()}
    assert got == {i: (len(sets[i]), root[i]) for i in range(len(sets))} and len(links) > 20
    assert ngram_join.ngram_join(empty(spark)).count() == 0
    odd = spark.createDataFrame([(None, "a b c d e"), (7, "a b c d e"), (7, "a b c d e")], "doc_id long, text string")
    assert sorted(map(tuple, ngram_join.ngram_join(odd).collect()), key=str) == [(7, 2, 7), (7, 2, 7), (None, 2, None)]


def test_driver_is_relieved_during_the_join(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(common, "RELIEF_S", 0, raising=False)
    monkeypatch.setattr(common, "RELIEF_SHARE", 1, raising=False)
    monkeypatch.setattr(common, "_due", 0.0, raising=False)
    monkeypatch.setattr(common, "_trim_jvm", asked.append, raising=False)
    rows = [(i, " ".join(f"w{j}" for j in range(40 + i % 2))) for i in range(6)]
    out = ngram_join.ngram_join(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r["component_id"] for r in out.collect()} == {0}
    assert len(asked) > 5  # between its steps


def test_parities_never_exceed_the_difference():
    rng = np.random.default_rng(3)
    sets = []
    for n in (1, 5, 30, 400, 500, 3000):
        base = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        sets += [np.unique(x) for x in (base, base[: n - n // 9], np.r_[base[n // 5 :], rng.integers(0, 1 << 63, n // 6, dtype=np.uint64)])]
    pairs = list(itertools.combinations(sets, 2))
    least = ngram_join.odd_buckets(*([ngram_join.parities(x) for x in side] for side in zip(*pairs)))
    true = np.array([len(np.setxor1d(a, b)) for a, b in pairs])
    assert (least <= true).all()
    # unlike 64 counts, they tell large sets apart
    big = np.array([len(a) > 2000 and len(b) > 2000 for a, b in pairs])
    assert big.sum() == 3 and (least[big] >= 0.85 * true[big]).all()


def test_pairs_of_near_copies_are_listed_once(spark):
    """Not once for each key that they share: the pairs that go to the
    comparison are few more than the sets of a group."""
    rng = random.Random(5)
    base = [f"w{i}" for i in range(150)]
    rows = [(0, " ".join(base))]
    for i in range(1, 60):
        words = list(base)
        words[rng.randrange(150)] = f"other{i}"
        rows.append((i, " ".join(words)))
    text = spark.createDataFrame(rows, "doc_id long, text string").selectExpr(
        "doc_id", "cast(text as binary) as text", "xxhash64(text) as digest")
    met = ngram_join._with_shared_keys(
        ngram_join.map_arrow(text, lambda it: ngram_join._emit(it, 4, 85, 100), ngram_join._EMITTED), "test-keys")
    rows = met.where("kind = 1").selectExpr("a as doc_id", "b as mark", "info.*")
    entries = met.where("kind = 0").selectExpr("a as key", "b as mark")
    join = ngram_join._Join(text, rows, entries, 4, 85, 100)
    stars = join.stars(entries).distinct().count()
    assert 59 <= stars < 3 * 59
    heads = entries.join(entries.groupBy("key").agg(F.min("mark").alias("first")), "key").selectExpr(
        "key", "mark", "mark as class", "mark = first as head")
    listed = join.near(heads)
    every = entries.join(heads.where("head").selectExpr("key as of", "mark as a"), F.expr("key = of and mark != a")).count()
    found, n = listed.distinct().count(), listed.count()
    assert found >= 59 and n < 1.2 * found < every / 2, (found, n, every)


def test_tasks_give_back_few_rows_at_a_time():
    """Millions of keys or pairs are never held at once."""
    import pyarrow as pa

    most = 2 * ngram_join.BATCH_ROWS
    rng = np.random.default_rng(6)
    docs = [b" ".join(b"w%d" % x for x in rng.integers(0, 1 << 40, 300)) for _ in range(2500)]
    n = len(docs)
    texts = pa.RecordBatch.from_arrays([pa.array(range(n), pa.int64()), pa.array(docs), pa.array(range(n), pa.int64())], names=["doc_id", "text", "digest"])
    found = [b for b in ngram_join._emit(iter([texts]), 4, 85, 100)]
    keys = sum(b.num_rows for b in found) - n
    assert keys > 2 * most and max(b.num_rows for b in found) <= most
    sets = [ngram_join.shingles(x) for x in docs[:50]]
    dealt = pa.RecordBatch.from_arrays(
        [pa.array([5] * n, pa.int64()), pa.array(range(n), pa.int64()), pa.array([sets[i % 50].tobytes() for i in range(n)])], names=["key", "mark", "items"])
    found = [b.num_rows for b in ngram_join._deal(iter([dealt]), 85, 100, 1)]
    assert sum(found) > 2 * most and max(found) <= most
    odd = ngram_join.parities(sets[0])
    n = 250 + 1500
    pairs = pa.RecordBatch.from_arrays(
        [pa.array([1] * n, pa.int64()), pa.array([0] * n, pa.int64()), pa.array(range(n), pa.int64()), pa.array([len(sets[0])] * n, pa.int64()),
         pa.array([odd] * n), pa.array([None] * 250 + [list(range(250))] * 1500, pa.list_(pa.int64()))],
        names=["lead", "part", "mark", "n", "odd", "of"])
    found = [b.num_rows for b in ngram_join._likely(iter([pairs]), 85, 100)]
    assert sum(found) == 250 * 1500 and max(found) <= most


def test_blocks_of_columns_are_bounded_by_ngrams(monkeypatch):
    import pyarrow as pa

    rng = np.random.default_rng(7)
    base = np.sort(rng.integers(0, 1 << 63, 400, dtype=np.uint64))
    sets = [base] + [np.sort(np.r_[base[i:], rng.integers(0, 1 << 63, i, dtype=np.uint64)]) for i in range(40)]
    n = len(sets)
    batch = pa.RecordBatch.from_arrays(
        [pa.array([1] * n, pa.int64()), pa.array([0] * n, pa.int64()), pa.array(range(n), pa.int64()),
         pa.array([s.tobytes() for s in sets]), pa.array([True] + [False] * (n - 1))], names=["lead", "part", "mark", "items", "is_row"])
    sizes, real = [], ngram_join.overlaps
    monkeypatch.setattr(ngram_join, "BLOCK_ITEMS", 2000)
    monkeypatch.setattr(ngram_join, "overlaps", lambda rows, some: (sizes.append(sum(map(len, some))), real(rows, some))[1])
    found = [tuple(x) for b in ngram_join._block_products(iter([batch.slice(0, 7), batch.slice(7)]), 85, 100) for x in zip(*(c.to_pylist() for c in b.columns))]
    want = [(0, i) for i in range(1, n) if 100 * len(np.intersect1d(base, sets[i])) >= 85 * len(np.union1d(base, sets[i]))]
    assert sorted(found) == want and 0 < len(want) < n - 1 and max(sizes) <= 2400


@pytest.mark.parametrize("block", [512, 2])
def test_ngram_join_negative_ids(spark, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "BLOCK_ROWS", block)
    base = [f"n{i}" for i in range(150)]
    rows = [(i - 9, " ".join(base[:k] + ["changed"] + base[k + 1 :])) for i, k in enumerate(range(3, 150, 20))]
    got = ngram_join.ngram_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {i: -9 for i, _ in rows}


@pytest.mark.parametrize("hot,levels", [(64, 3), (2, 1)])
def test_ngram_join_repeated_ids(spark, hot, levels):
    """A doc_id with several texts is one node, null ids link through their text."""
    rng = random.Random(8)
    texts = [" ".join(words(rng, 60)) for _ in range(12)]
    texts += [t + " more" for t in texts[:6]] + [None, ""]
    rows = [(rng.choice([*range(-20, 20), None]), rng.choice(texts)) for _ in range(45)]
    rows += [(100, texts[0]), (102, texts[0]), (101, texts[1]), (102, texts[1])]
    sets = [shingle_set(t) for _, t in rows]
    links = [(a, b) for a, b in itertools.combinations(range(len(rows)), 2)
             if rows[a][0] is not None and rows[a][0] == rows[b][0] and sets[a] and sets[b]
             or sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    root, least = roots(len(rows), links), {}
    for (i, _), r in zip(rows, root):
        if i is not None:  # an empty text is alone
            least[r] = min(i, least.get(r, i))
    want = collections.Counter((i, len(s), None if i is None else least[r]) for (i, _), s, r in zip(rows, sets, root))
    got = ngram_join.ngram_join(spark.createDataFrame(rows, "doc_id long, text string"), hot=hot, levels=levels).collect()
    assert collections.Counter(map(tuple, got)) == want


def test_products():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 300, rng.integers(1, 200)).astype(np.uint64)) for _ in range(30)]
    want = [[len(np.intersect1d(a, b)) for b in sets] for a in sets]
    assert ngram_join.overlaps(sets, sets).tolist() == want == ngram_join.overlaps(sets).tolist()


def test_sketches_bound_differences():
    rng = np.random.default_rng(4)
    sets = [np.unique(ngram_join.mix(rng.integers(0, 30_000, n).astype(np.uint64))) for n in (1, 5, 300, 20_000, 60_000)]
    sketches = np.array([ngram_join.sketch(s) for s in sets])
    for a, x in zip(sets, sketches):
        assert all(d <= len(np.setxor1d(a, b)) for d, b in zip(ngram_join.differences(x, sketches), sets))


@pytest.mark.parametrize("cut", [0, 1, 2])
def test_shared_keys_of_a_stream(cut):
    """Batches may end anywhere: rows of keys with two sets, each once."""
    rng = random.Random(cut)
    pairs = sorted((rng.randrange(40), rng.randrange(3)) for _ in range(100))
    size = [1, 7, 100][cut]
    batches = [ngram_join._entries(*map(np.array, zip(*pairs[i : i + size]))) for i in range(0, 100, size)]
    got = [(k, m) for b in ngram_join._shared(iter(batches)) for k, m in zip(b.column("a").to_pylist(), b.column("b").to_pylist())]
    held = collections.Counter(k for k, _ in set(pairs))
    assert got == sorted(p for p in set(pairs) if held[p[0]] > 1)


@pytest.mark.parametrize("cut", [0, 1, 3])
def test_linked_sets_share_a_key(cut):
    rng = np.random.default_rng(2)
    for n in [*range(1, 60), 200, 700]:
        for _ in range(8):
            items = np.unique(rng.integers(0, 1 << 63, 2 * n).astype(np.uint64))
            a = np.sort(rng.permutation(items)[:n])
            for drop in range(n):  # as many changes as a link can bear
                b = np.sort(np.r_[a[drop:], np.setdiff1d(items, a)[:drop]])
                common = n - drop
                if 100 * common < 85 * (len(a) + len(b) - common):
                    break
                assert np.intersect1d(ngram_join.keys(a, cut=cut), ngram_join.keys(b, cut=cut)).size


# --- 8 ------------------------------------------------------------------------

def test_token_stream(spark, texts, docs, monkeypatch):
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    coder.encode_special_tokens = True
    path = shared_path(spark, "tokens")
    both = docs.select("doc_id", "text").union(spark.createDataFrame([(None, "<|endoftext|> x")], "doc_id long, text string"))
    token_stream.write_tokens(both, path, P.path("byte_bpe_50k.json"), P.PATTERN)
    got = {r["doc_id"]: r for r in token_stream.read_tokens(spark, path, with_ids=True).collect()}
    start = 0
    for i, text in [(None, "<|endoftext|> x"), *enumerate(texts)]:
        ids = [*coder.encode(text or "", add_special_tokens=False).ids, 0]
        r = got[i]
        assert (r["start"], r["n_tokens"], r["ids"]) == (start, len(ids), ids)
        assert r["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    none = shared_path(spark, "no-tokens")
    token_stream.write_tokens(empty(spark), none, P.path("byte_bpe_50k.json"), P.PATTERN)
    assert token_stream.read_tokens(spark, none).count() == 0


def test_rans_blocks_and_damage(monkeypatch):
    monkeypatch.setattr(token_stream, "BLOCK", 1500)
    rng = np.random.default_rng(0)
    parts = [rng.zipf(1.3, n).clip(0, 50_000).astype("<u4").tobytes() for n in (1, 5000, 0, 700)]
    data = token_stream.encode_segment([3, None, 5, -1], parts)
    back = token_stream.Segment(data)
    assert [(i, d.tobytes()) for i, d in back.documents()] == list(zip([3, None, 5, -1], parts))
    whole = np.frombuffer(b"".join(parts), "<u4")
    assert np.array_equal(back.block(2), whole[3000:4500])  # one block alone
    broken = bytearray(data)
    broken[-3] ^= 1
    with pytest.raises(ValueError):
        list(token_stream.Segment(bytes(broken)).documents())


def test_pretoken_cache_equals_the_library():
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    mine, theirs, rng = token_stream.ByteTokenizer(path, P.PATTERN), Tokenizer.from_file(path), random.Random(1)
    theirs.encode_special_tokens = True
    bits = ["ab", " ", "  ", "\n", "\t", "'s", "1", "é", "中文", "don't", "<|endoftext|>", "!?", ",", "\x1c", " ", "\U0001f600"]
    for _ in range(1500):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 25)))
        assert list(np.frombuffer(mine.encode(text), "<u4")) == theirs.encode(text, add_special_tokens=False).ids


def test_texts_encoded_together_as_alone():
    """Each distinct piece of the texts is looked up once, with equal ids."""
    import pyarrow as pa

    coder = token_stream.ByteTokenizer(P.path("byte_bpe_50k.json"), P.PATTERN, True)
    texts = ["one two, two two. it's", None, "", " lead and tail ", "two  spaces\n here", "Straße größe, größe", "x", " ",
             "<|endoftext|> one", "日本 語 two", "two\u2003 two", "ª º, ɐb 12 34"] + ["again and again"] * 40
    got = list(coder.encode_all(pa.array(texts, pa.string())))
    want = [coder.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == want
    assert got == [coder.encode(t or "") for t in texts]
    looked = []

    class Counted(dict):
        def __missing__(self, piece):
            looked.append(piece)
            return b"\1\0\0\0"

        def age(self):
            pass

    coder.pieces = Counted()
    list(coder.encode_all(pa.array(["again and again and"] * 40)))
    assert sorted(looked) == ["again", "and"]


def test_added_tokens_as_the_library(spark, tmp_path):
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    mine, theirs, rng = token_stream.ByteTokenizer(path, P.PATTERN, True), Tokenizer.from_file(path), random.Random(2)
    bits = ["ab", " ", "  ", "\n", "'s", "1", "é", "中文", "<|endoftext|>", "<|", "|>", "!?", "\x1c", "\U0001f600"]
    texts = ["see <|endoftext|> here", *("".join(rng.choice(bits) for _ in range(rng.randint(0, 25))) for _ in range(1500))]
    for text in texts:
        assert list(np.frombuffer(mine.encode(text), "<u4")) == theirs.encode(text, add_special_tokens=False).ids
    rows = list(enumerate(texts[:50]))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in queries.op8_token_stream(spark, str(tmp_path)).collect()}
    start = 0
    for i, text in rows:
        ids = [*theirs.encode(text, add_special_tokens=False).ids, 0]
        assert (got[i]["start"], got[i]["n_tokens"]) == (start, len(ids))
        assert got[i]["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)


# --- 9 ------------------------------------------------------------------------

def test_substring_dedup(spark, texts, docs):
    split = [(t or "").encode().split() for t in texts]
    count = collections.Counter(tuple(w[k : k + 35]) for w in split for k in range(len(w) - 34))
    got = {r["doc_id"]: r for r in substring_dedup.substring_dedup(docs).collect()}
    assert max(count.values()) > 100
    for i, w in enumerate(split):
        gone = {j for k in range(len(w) - 34) if count[tuple(w[k : k + 35])] > 1 for j in range(k, k + 35)}
        kept = b" ".join(x for j, x in enumerate(w) if j not in gone).decode()
        assert (got[i]["n_words"], got[i]["n_removed"], got[i]["kept"]) == (len(w), len(gone), kept), i
    assert substring_dedup.substring_dedup(empty(spark)).count() == 0
    twice = spark.createDataFrame([(None, texts[-1]), (1, texts[0])], "doc_id long, text string")
    assert {r["doc_id"]: r["n_removed"] for r in substring_dedup.substring_dedup(twice).collect()} == {None: 2000, 1: 0}


def test_rolling_hash():
    h = hashing.hash_words([b"a", b"b", b"c"] * 50)
    r = hashing.rolling(h, 35)
    assert len(r) == 116 and len(set(r.tolist())) == 3 and np.array_equal(r[:100], r[3:103])
    x = np.random.default_rng(0).integers(0, 99, 80)
    for n in (1, 2, 7, 24, 33):
        assert hashing.sliding(x, n, np.minimum).tolist() == [x[i : i + n].min() for i in range(80 - n + 1)]


# --- 10 -----------------------------------------------------------------------

def test_bpe(spark, texts, docs):
    enc = bpe.encoding(*RANKS)
    got = {r["doc_id"]: r for r in bpe.bpe_digest(docs, *RANKS).collect()}
    ids = {r["doc_id"]: r["ids"] for r in bpe.bpe_encode(docs, *RANKS).collect()}
    for i, t in enumerate(texts):
        want = enc.encode_ordinary(t or "")
        assert got[i]["n_tokens"] == len(want) and ids[i] == want
        assert got[i]["ids_sha256"] == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    back = {r["doc_id"]: bytes(r["bytes"]) for r in bpe.bpe_decode(bpe.bpe_encode(docs, *RANKS), *RANKS).collect()}
    assert back == {i: (t or "").encode() for i, t in enumerate(texts)}
    rng = random.Random(1)
    for _ in range(2000):
        t = "".join(rng.choice("ab1 '\n\t　\x1c .s!é中") for _ in range(rng.randint(0, 60)))
        assert bpe.encode(t, enc, 5) == enc.encode_ordinary(t), repr(t)


# --- pipeline -----------------------------------------------------------------

def test_pipeline(spark):
    import corpus_pipeline as pipeline

    given = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("node", F.lit("x"))
    held = docs
    for name, stage in pipeline.STAGES[:-1]:
        after = stage(spark, held, SF)
        assert after.columns == docs.columns, name
        before, held = {r["doc_id"]: r for r in held.collect()}, spark.createDataFrame(after.collect(), after.schema)
        kept = {r["doc_id"]: r for r in held.collect()}
        assert set(kept) <= set(before)
        if name == "language":
            assert len(kept) > 0.99 * len(before)
        if name == "lines":
            assert set(kept) == set(before) and all(kept[i]["n_chars"] == len(kept[i]["text"]) for i in kept)
        if name == "near_copies":
            ids = sorted(before)
            sets = [shingle_set(before[i]["text"], 5) for i in ids]
            root = roots(len(ids), [(a, b) for a, b in itertools.combinations(range(len(ids)), 2) if sets[a]
                                    and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])])
            assert set(kept) == {ids[r] for r in root}
        if name == "benchmark":
            found = queries.op5_decontaminate(spark, SF).where("contaminated").select("doc_id").collect()
            assert not {r["doc_id"] for r in found} & set(kept) and len(kept) >= len(before) - len(found)
    enc = bpe.encoding(*RANKS)
    assert {r["doc_id"]: list(r["ids"]) for r in pipeline.run(spark, SF).collect()} == {
        i: enc.encode_ordinary(r["text"]) for i, r in kept.items()}
    assert set(kept) <= set(given) and pipeline.ORACLE_SQL is None
    nothing = docs.where("false")
    for _, stage in pipeline.STAGES:
        nothing = stage(spark, nothing, SF)
    assert nothing.count() == 0


def test_near_copies_at_five_words_and_four_fifths(spark):
    import corpus_pipeline as pipeline

    rng = random.Random(11)
    base = [f"b{i}" for i in range(200)]
    texts = [" ".join(base)]
    for changes in (1, 2, 3, 4, 5, 6, 7, 9):
        near = list(base)
        for at in rng.sample(range(0, 200, 12), changes):
            near[at] = f"new{changes}x{at}"
        texts.append(" ".join(near))
    texts += [" ".join(base[lo:] + words(rng, lo)) for lo in (18, 21, 24, 30)]
    for n in (30, 60):
        other = [f"o{n}x{i}" for i in range(n)]
        # appended words: a similarity in four-word sets just under 0.85, over 0.8 in five-word sets
        texts += [" ".join(other), " ".join(other + [f"p{i}" for i in range(round(0.21 * n))])]
    sets = []
    for t in texts:
        w = t.split()
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)})
    near = [(a, b) for a, b in itertools.combinations(range(len(texts)), 2)
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {r["doc_id"] for r in pipeline.near_copies(spark, table, "").collect()}
    assert kept == set(roots(len(texts), near))
    groups = ngram_join.ngram_join(table).where("doc_id = component_id").count()
    assert groups > len(kept)  # the bound of op7 leaves more


def test_near_copies_of_repeated_and_null_ids(spark):
    import corpus_pipeline as pipeline

    base = " ".join(f"b{i}" for i in range(100))
    near, other = base + " end", " ".join(f"c{i}" for i in range(100))
    rows = [(3, base, "x", 1), (3, base, "y", 2), (4, near, "x", 3), (None, near, "x", 4), (None, other, "x", 5),
            (None, other, "x", 6), (7, None, "x", 7), (None, None, "x", 8), (7, "", "x", 9), (8, "one two", "x", 10)]
    table = spark.createDataFrame(rows, "doc_id long, text string, `row id` string, `row left` long")
    table = table.withColumnRenamed("row id", "source").withColumnRenamed("row left", "n")
    got = pipeline.near_copies(spark, table, "")
    assert got.columns == table.columns
    kept = sorted(r["n"] for r in got.collect())
    assert len(kept) == 6 and {7, 8, 9, 10} < set(kept) and len({1, 2} & set(kept)) == len({5, 6} & set(kept)) == 1
