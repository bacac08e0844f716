import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

pytest.importorskip("palimpsest.llm")

from palimpsest.llm import divergence, mixing, periodic  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, g string, d string, h long, runs string, held_out string"
ODD = [(1, None, "en", "a"), (2, "", None, "b"), (3, " \t\n ", "en", None), (4, "the the The", "en", "a"), (4, "the the The", "en", "a"), (None, "x y " * 40, "en", "b"), (7, "word " * 3000, "en", "a"), (8, "the cat sat. The cat ran", "en", "b"), (9, "Élan élan the", "en", "c"), (50, "a b c", "de", "z")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, "x", "x", 1, "x", "x") for r in ODD], DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def words(text, lower=False):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "") if lower else text or ""
    return re.findall(r"[^\x20\x09-\x0D]+", text)


# --- periodic runs -------------------------------------------------------------------------------------------------


def all_runs(ws):
    found = {}
    for p in range(1, len(ws) // 4 + 1):
        i = 0
        while i < len(ws) - p:
            j = i
            while j < len(ws) - p and ws[j] == ws[j + p]:
                j += 1
            if j - i + p >= max(6, 4 * p):
                found.setdefault((i, j - i + p), p)
            i = max(j, i + 1)
    return sorted(((s, n, p) for (s, n), p in found.items()), key=lambda r: (r[0], r[2]))


def fibonacci(n):
    a, b = b"a", b"ab"
    while len(b) < n:
        a, b = b, b + a
    return [bytes([c]) for c in b[:n]]


def test_runs_equal_all_runs():
    rng = random.Random(5)
    for _ in range(60):
        docs = []
        for _ in range(12):
            kinds = rng.choice([1, 2, 3, 5, 20])
            ws = [b"%d" % rng.randrange(kinds) for _ in range(rng.choice([0, 1, 5, 20, 150]))]
            for _ in range(rng.randrange(4)):
                unit = [b"%d" % rng.randrange(kinds) for _ in range(rng.randint(1, 30))]
                at = rng.randrange(len(ws) + 1)
                ws[at:at] = (unit * 7)[: rng.randint(2 * len(unit), 6 * len(unit))]
            docs.append(ws)
        assert periodic.find_runs(docs) == [all_runs(ws) for ws in docs]
    many = [fibonacci(600), fibonacci(100) * 5, [b"a"] * 500, ([b"a"] * 6 + [b"b"]) * 9, [b"x", b"y"] * 200 + [b"x", b"x"]]
    assert periodic.find_runs(many) == [all_runs(ws) for ws in many]


def test_synchronising_sets_are_dense_and_consistent():
    rng = random.Random(2)
    ws = np.array([rng.randrange(3) for _ in range(60)] * 6)
    scale = periodic._Scale(np.arange(len(ws)), ws, len(ws))
    t = 1
    while t < 8:
        scale, t = scale.doubled(t), 2 * t
    double = scale.doubled(t)
    chosen = double.positions[periodic._selected(scale, double, t, np.zeros(len(scale.positions), bool))]
    assert np.diff(chosen).max() <= t
    by = defaultdict(set)
    for x in double.positions.tolist():
        by[tuple(ws[x : x + 2 * t].tolist())].add(x in set(chosen.tolist()))
    assert all(len(v) == 1 for v in by.values())


def planted(doc_id, ws):
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 or not ws:
        return ws
    a = g % len(ws)
    p = 1 + (len(ws) - a) // (3 + g % 8)
    return [ws[i] if i < a else ws[a + (i - a) % p] for i in range(len(ws))]


def test_op11(spark, tmp_path, odd):
    rng = random.Random(1)
    rows = [*ODD, *[(i, " ".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 90))), "en", "s") for i in range(100, 300)]]
    spark.createDataFrame([(*r, "x", "x", 1, "x", "x") for r in rows], DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    want = Counter()
    for doc_id, text, *_ in rows:
        ws = words(text) if doc_id is None else planted(doc_id, words(text))
        runs = all_runs(ws)
        gone = {i for s, n, p in runs for i in range(s + p, s + n)}
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want[(doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha("".join(f"{s},{n},{p}\n" for s, n, p in runs)), sha(" ".join(w for i, w in enumerate(ws) if i not in gone)))] += 1
    assert sum(k[1] > 0 for k in want) > 10
    assert Counter(tuple(r) for r in periodic.op11_periodic_runs(spark, str(tmp_path)).collect()) == want
    texts = {r.doc_id: r for r in periodic.periodic_runs(odd).collect()}
    assert texts[7].collapsed == "word" and texts[1].runs == [] and texts[None].collapsed == "x y"


def test_runs_of_an_empty_table(empty):
    assert periodic.periodic_runs(empty).collect() == []


# --- divergence ----------------------------------------------------------------------------------------------------


def audit(rows, least=3, top=200):
    term = lambda t: re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    docs = [(r[2] or "", r[3] or "", term(r[1])) for r in rows]
    out = []
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        df = Counter(t for d in mine for t in set(d[2]))
        kept = {t for t, n in df.items() if n >= least}
        per = {s: Counter(t for d in mine if d[1] == s for t in d[2] if t in kept) for s in {d[1] for d in mine}}
        every = sum(per.values(), Counter())
        p = lambda c, t: 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept))
        f = lambda a, b: (a - b) * (a - b) // b
        for s, c in per.items():
            pairs = [(sum(f(p(c, t), p(o, t)) for t in kept), x) for x, o in per.items() if x != s]
            terms = [(f(p(c, t), p(every, t)), t) for t in c if p(c, t) > p(every, t)]
            for part, items, most in (("pair", pairs, None), ("term", terms, top)):
                for i, (v, x) in enumerate(sorted(items, key=lambda y: (-y[0], y[1].encode()))[:most]):
                    out.append((lang, s, part, x, v, i + 1))
    return sorted(out)


def bag(seed, n=160):
    rng = random.Random(seed)
    term = ["".join(rng.choice("abcdé") for _ in range(rng.randint(1, 3))) for _ in range(60)]
    return [(i, " ".join(rng.choice(term[: rng.randint(3, 60)]) for _ in range(rng.randint(0, 30))), rng.choice(["en", "de", None]), rng.choice(["a", "b", "c", "dd", None])) for i in range(n)]


@pytest.mark.parametrize("bits", [64, 4])
def test_divergence_equals_brute_force(spark, bits):
    rows = [*ODD, *bag(3)]
    docs = spark.createDataFrame([(*r, "x", "x", 1, "x", "x") for r in rows], DOCS)
    assert sorted(map(tuple, divergence.divergence(docs, top=7, bits=bits).collect())) == audit(rows, top=7)


def test_divergence_without_terms(spark, odd, empty):
    assert sorted(map(tuple, divergence.divergence(odd, least_docs=100).collect())) == audit(ODD, least=100)
    assert divergence.divergence(empty).collect() == []


def test_shuffles_carry_digests_only(spark, odd):
    """Counts are dealt as digests; no text column crosses that shuffle."""
    plan = divergence._counts(divergence._bare(odd), 0, 64)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(l" in plan and "term" not in plan.split("Exchange")[0]


# --- context mixing ------------------------------------------------------------------------------------------------


def small_coder():
    ws = [b"the", b"cat", b"sat", b""]
    counts = np.array([50, 20, 10, 30])
    return mixing.Coder(ws, counts, 12, [1] * 257)


def test_codes_are_prefix_codes():
    rng = random.Random(4)
    for n in (2, 3, 17, 400):
        lengths = mixing.code_lengths([rng.choice([1, 5, 1000, 10**12]) for _ in range(n)])
        assert sum(2.0**-k for k in lengths.tolist()) == pytest.approx(1)
        offset, bits, *_ = mixing.paths(lengths, np.ones(n), 0)
        codes = ["".join(map(str, bits[o : o + k])) for o, k in zip(offset, lengths)]
        assert len(set(codes)) == n and not any(b.startswith(a) for a, b in zip(sorted(codes), sorted(codes)[1:]))


def test_probabilities_add_up_to_one():
    """The symbols that may stand at the head of a text have probability 1 in all, with any tables and weights."""
    coder = small_coder()
    rng = np.random.default_rng(1)
    tables = [rng.integers(-60, 60, 1 << 10).astype(np.int8) for _ in range(mixing.HASHED)]
    weights = np.tile([0.5, 0.3, 0.3, 0.1], (mixing.GATES, 1))
    symbol_nats = lambda texts: mixing.code_nats(coder, tables, weights, texts, 10)[0]
    x, *_ = coder.symbols([b"the cat"])
    assert x.tolist() == [0, 1, 3]
    total = 0.0
    for path in range(len(coder.vocab) + 1):
        length = coder.length[path]
        ctx = np.zeros((mixing.HASHED, 1), np.uint32)
        _, v = mixing.inputs(coder, tables, np.array([path]), ctx, 10)
        assert len(v) == length
        total += math.exp(-step_nats(v, weights))
    assert total == pytest.approx(1, abs=1e-4)
    assert (symbol_nats([b"the cat", b"", b"zebra"]) > 0).all()


def step_nats(v, weights):
    """Plain mixing of one block's bits, one at a time."""
    w, refine, nats = weights.copy(), np.zeros(mixing.BUCKETS), 0.0
    for *x, last in v.tolist():
        g, s = last >> 1, (last & 1) * 2 - 1
        x = np.array(x) / mixing.STEP
        z = min(max(w[g, :3] @ x + w[g, 3], -11), 11)
        b = int(min(max(z + 4, 0), mixing.BUCKETS - 1))
        u = math.exp(-s * (z + refine[b]))
        nats += math.log(1 + u)
        error = s * u / (1 + u)
        refine[b] += mixing.REFINE * error
        w[g, :3] += mixing.RATE * error * x
    return nats


def test_blocks_side_by_side_equal_one_at_a_time(monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 7)
    coder = small_coder()
    rng = np.random.default_rng(3)
    tables = [rng.integers(-90, 90, 1 << 12).astype(np.int8) for _ in range(mixing.HASHED)]
    weights = rng.normal(0.3, 0.2, (mixing.GATES, mixing.ORDERS + 1))
    texts = [b"the cat sat the dog", b"", b"The zebra\xc3\xa9 sat", b"x" * 90, b"cat " * 40]
    got, *_ = mixing.code_nats(coder, tables, weights, texts, 12)
    for t, nats in zip(texts, got):
        symbols, context, *_ = coder.symbols([t])
        want = sum(step_nats(mixing.inputs(coder, tables, symbols[a : a + 7], context[:, a : a + 7], 12)[1], weights) for a in range(0, len(symbols), 7))
        assert nats == pytest.approx(want, rel=1e-4)


def test_slot_counts_equal_one_pass(spark):
    coder = small_coder()
    texts = ["the cat sat", "the dog sat", "", "the the cat cat", "dogs sat the"] * 7
    rows = spark.createDataFrame([(t,) for t in texts], "text string").repartition(5)
    b = spark.sparkContext.broadcast({"coder": ([b"the", b"cat", b"sat", b""], np.array([50, 20, 10, 30]), 12, [1] * 257)})
    got = {(r.k, r.chunk): r.data for r in mixing.slot_counts(rows, ("test", b), 10).collect()}
    want = np.zeros((mixing.HASHED, 2 << 10), np.int32)
    mixing.add_counts(coder, want, [t.encode() for t in texts], 10)
    import pyarrow as pa

    for k in range(mixing.HASHED):
        assert np.frombuffer(pa.decompress(got[k, 0], decompressed_size=16 << 10, codec="zstd", asbytes=True), "<i8").tolist() == want[k].tolist()


@pytest.mark.parametrize("symbols", [3, 1000])
def test_lm_scores(spark, symbols):
    rng = random.Random(6)
    rows = [*ODD, *[(i, " ".join(rng.choice(["Alpha", "beta", "gamma", "de lta", "x%d" % rng.randrange(300)]) for _ in range(rng.randint(0, 60))), "en", "s") for i in range(100, 400)]]
    docs = spark.createDataFrame([(*r, "x", "x", 1, "x", "x") for r in rows], DOCS)
    got = mixing.lm_scores(docs, bits=14, words=symbols).collect()
    out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    count = Counter(w for i, t, *_ in rows if not out(i) for w in [*words(t, True), ""])
    n, v = sum(count.values()), len(count)
    want = sorted((i or -1, out(i), len(words(t)) + 1, sum(count[w] > 0 for w in [*words(t, True), ""]), n, round(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in [*words(t, True), ""]), 6)) for i, t, *_ in rows)
    assert sorted((r.doc_id or -1, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 and r.bits_per_byte > 0 for r in got)
    held = [r for r in got if r.held_out and r.doc_id and r.doc_id >= 100]
    # texts of the corpus' words cost less than as many bytes at random
    assert sum(r.bits_per_byte * r.n_bytes for r in held) < 4 * sum(r.n_bytes for r in held)
    by = {r.doc_id: r for r in got if r.doc_id == 4}
    assert len([r for r in got if r.doc_id == 4]) == 2 and by[4].n_tokens == 4


def test_scores_depend_on_text_and_model_only(spark):
    rows = [(i, f"one two three {i % 5} four", "en", "s", "x", "x", 1, "x", "x") for i in range(80)]
    docs = spark.createDataFrame(rows, DOCS)
    a = {r.doc_id: r.score for r in mixing.lm_scores(docs.repartition(1), bits=12).collect()}
    b = {r.doc_id: r.score for r in mixing.lm_scores(docs.repartition(7), bits=12).collect()}
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k], rel=1e-5) for k in a)


def test_lm_scores_of_nothing(spark, empty):
    assert mixing.lm_scores(empty, bits=10).collect() == []
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 7 == 2][:3]
    got = mixing.lm_scores(spark.createDataFrame([(i, "a b", "en", "s", "x", "x", 1, "x", "x") for i in held], DOCS), bits=10).collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got] == [(3, 0, 0, 0.0)] * 3


# --- bounds and names of earlier operators -------------------------------------------------------------------------


def test_url_rules_with_names_of_labels(spark):
    """pages may have columns that labels have too."""
    from palimpsest.llm import url_rules

    pages = spark.createDataFrame([(i, f"http://{'bad' if i % 2 else 'good'}.net/x", 1, "b", 0) for i in range(40)], "page_id long, url string, doc_id long, bad string, toxic int")
    labels = spark.createDataFrame([(i, i % 2 == 0, i % 2) for i in range(40)], "doc_id long, q boolean, toxic int").selectExpr("doc_id", "cast(q as int) quality", "toxic")
    assert url_rules.judge(pages, labels).count() == 40


def test_toxicity_learns_one_row_of_an_id(spark, monkeypatch):
    """3,000 rows that share a labelled id, copies among them, count as one row for the fit."""
    from palimpsest.llm import toxicity

    seen = []
    real = toxicity.written
    monkeypatch.setattr(toxicity, "written", lambda df, tag, **k: seen.append((tag, out := real(df, tag, **k))) or out)
    rows = [(3, f"text {i % 1000} word", "en", "s", "x", "x", 1, "x", "x") for i in range(3000)] + [(i, "plain words here", "en", "s", "x", "x", 1, "x", "x") for i in range(20, 60)]
    labels = spark.createDataFrame([(i, 1, i % 2) for i in [3, *range(20, 60)]], "doc_id long, quality int, toxic int")
    toxicity.train(spark.createDataFrame(rows, DOCS), labels, max_train=10)
    assert dict(seen)["bags"].count() <= 10


def test_row_keys(spark):
    from palimpsest.llm.words import row_key

    rows = spark.createDataFrame([(1, "a"), (1, "a"), (1, None), (1, ""), (None, "a"), (2, "a")], "doc_id long, text string")
    keys = [bytes(r.k) for r in rows.select(row_key().alias("k")).collect()]
    assert all(len(k) == 16 for k in keys) and keys[0] == keys[1] and keys[2] == keys[3] and len(set(keys)) == 4
