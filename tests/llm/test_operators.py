import base64
import hashlib
import pathlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("palimpsest.llm")
import public_tokenizers as P  # noqa: E402

from palimpsest.llm import bpe, decontaminate, licenses, neighbours, pieces, repeats, simhash, token_counts, token_files, toxicity, units, url_rules  # noqa: E402

DOCS = "doc_id long, text string, lang string, h long, k string"
ODD = [(1, None, "en", 1, "x"), (2, "", "en", 1, "x"), (3, "  \n ", "en", 1, "x"), (4, "one  two\n three <|endoftext|> d'accord ñandú 123", "en", 1, "x"), (4, "one  two\n three <|endoftext|> d'accord ñandú 123", "en", 1, "x"), (None, "null id", "en", 1, None), (7, "word " * 3000, "en", None, "x")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    passage = "".join(rng.choice("abcdef ghi.") for _ in range(700))
    out = []
    for i in range(60):
        t = "".join(rng.choice("abcdefgh ") for _ in range(rng.randint(0, 900)))
        if i % 3 == 0:
            t = t[:200] + passage[rng.randint(0, 150) :] + t[200:]
        out.append(t)
    return [*out, out[5], out[5], "z" * 1500, "xy" * 700, "é" * 600 + out[0]]


def test_units_never_change_tokens():
    encode = token_counts.library(P.path("byte_bpe_50k.json"))
    rng = random.Random(1)
    for _ in range(300):
        t = "".join(rng.choice(["a", "Bc", " ", "  ", "\n", "\t", "'s", "é", "12", "<|endoftext|>", "　", "\x1c", "."]) for _ in range(rng.randint(0, 30)))
        assert sum(len(x) for x in encode(units.units(t))) == len(encode([t])[0])
        assert "".join(units.units(t)) == t


def test_units_encoded_together_keep_their_ids():
    path = P.path("byte_bpe_50k.json")
    rng = random.Random(3)
    texts = ["".join(rng.choice(["a", "Bc", " ", "  ", "\n", "'s", "é", "12", "<|endoftext|>", "\u3000", "\x1c", ".", "\u0120", "\u0120x", "\x00", "😀"]) for _ in range(rng.randint(1, 30))) for _ in range(1500)]
    found = sorted({u for t in texts for u in units.units(t)})
    assert [np.frombuffer(x, "<u2").tolist() for x in token_files.encode_together(path, found, 2)] == token_counts.library(path)(found)
    assert token_files.encode_together(path, [], 2) == []


def test_units_are_cut_before_punctuation_and_kept_in_two_generations():
    path = P.path("byte_bpe_50k.json")
    rng = random.Random(5)
    words = ["word", " élan", "naïve", "x", "don't", "<|endoftext|>", "a1", "\u4e2d", "ÿ\u0301", "_", "", "w" * 70]
    lists = [[f" {rng.choice(words)}{rng.choice(['', ',', '.', '...', chr(39), '?!', '%%%', '<|'])}" for _ in range(40)] for _ in range(60)]
    lists = [[u for u in us if u != " "] for us in lists]
    assert units.punctuation_at(" word,") == 5 and units.punctuation_at("élan...") == 4
    assert not any(units.punctuation_at(u) for u in (" word", " a1,", ",", " ", " don't", " <|endoftext|>", " a\u0301,", "a, "))
    for kept in (1, 20, 10_000):
        cache = units.UnitCache(lambda unseen: token_files.encode_together(path, unseen, 2), kept, units.punctuation_at)
        for us in lists:
            whole = np.array(token_counts.library(path)(["".join(us)])[0], "<u2").tobytes()
            assert b"".join(cache.outcomes([us, []])[0]) == whole
            known = cache.lookup([us])
            assert b"".join(known[u] for u in us) == whole


def test_pieces_of_columns_never_change_tokens(monkeypatch):
    """Whatever stands side by side, at texts' ends and in slices of a column, with tables of any size."""
    path = P.path("byte_bpe_50k.json")
    encode = token_counts.library(path)
    rng = random.Random(7)
    some = ["a", "Bc", "word", " ", " ", "  ", "\n", "\n\n", "'", "'s", "'tx", "é", "ÿ", "×", "÷", "\u0301", "12", ".", ",", "_", "-", "…", "中", "。", "Ж", "😀", "\x00", "\x1f", "w" * 70]
    odd = ["<|endoftext|>", "<|", "endoftext|>", "\t", "\r\n", "\x1c", "\x85", "\u00a0", "\u2003", "\u2028", "\u3000"]
    texts = ["".join(rng.choice(some + odd * (i % 2)) for _ in range(rng.randint(0, 30))) for i in range(3000)]
    want = [np.array([*x, 2], "<u2").tobytes() for x in encode(texts)]
    column = pa.array(["before", *texts, "", "<|endoftext|>"])[1:-2]
    for kept in (1, 20, 100_000):
        table = pieces.PieceTable(lambda unseen: token_files.encode_pieces(path, unseen, 2, token_files._odd(path)), kept)
        monkeypatch.setattr(token_files, "_pieces_to_ids", lambda *_: table)
        for step in (7, 1000, 3000) if kept > 1 else (3000,):
            assert [x for a in range(0, 3000, step) for x in token_files.encode_ids(path, column[a : a + step], 2, b"\2\0")] == want
            assert len(table.pieces) == len(set(table.pieces.to_pylist())) <= kept
        assert token_files.encode_ids(path, column[:0], 2, b"") == [] and token_files.encode_ids(path, pa.array(["", ""]), 2, b"\2\0") == [b"\2\0"] * 2


def test_words_are_encoded_once_whatever_stands_behind_them(monkeypatch):
    """Line ends and punctuation make no new pieces of known words; before, each pair of words around a line end was one of its own."""
    path = P.path("byte_bpe_50k.json")
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefgé") for _ in range(8)) for _ in range(40)]
    texts = ["".join(rng.choice(words) + rng.choice([" ", ", ", ".\n", "\n", "! "]) for _ in range(50)) for _ in range(200)]
    encode, got = token_counts.library(path), []
    monkeypatch.setattr(token_files, "library", lambda _: lambda found: got.extend(found) or encode(found))
    token_files._pieces_to_ids.cache_clear()
    assert token_files.encode_ids(path, pa.array(texts), 2, b"") == [np.array(x, "<u2").tobytes() for x in encode(texts)]
    token_files._pieces_to_ids.cache_clear()
    # each word at a text's head, behind a blank and behind a line end; marks, and white space at texts' ends
    assert sum(map(len, got)) <= 3 * 40 * 9 + 20


def test_token_counts_and_files(spark, odd, tmp_path):
    path = P.path("byte_bpe_50k.json")
    encode = token_counts.library(path)
    want = Counter((i, len(encode([t or ""])[0])) for i, t, *_ in ODD)
    assert Counter((r.doc_id, r.n_tokens) for r in token_counts.token_counts(odd, path).collect()) == want
    token_files.write_shards(odd, str(tmp_path / "s"), path)
    rows = token_files.positions(token_files.write_index(spark, str(tmp_path / "s"), str(tmp_path / "i"))).orderBy("start").collect()
    at = 0
    for r, (i, t) in zip(rows, sorted(((i, t) for i, t, *_ in ODD), key=lambda x: (x[0] is not None, x[0] or 0))):
        ids = [*encode([t or ""])[0], 2]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    index = spark.read.parquet(str(tmp_path / "i"))
    assert token_files.shuffled(index, 1).count() == len(ODD)
    # by the index alone: with Spark, and as a reader outside it would
    got = {(r.file, r.offset): r for r in token_files.fetch(index, str(tmp_path / "s")).collect()}
    for r in rows:
        with open(tmp_path / "s" / r.file, "rb") as f:
            f.seek(r.offset)
            (_, _, doc_id, ids), = token_files.parse(f.read(r.length))
        again = got[(r.file, r.offset)]
        assert (doc_id, len(ids)) == (r.doc_id, r.n_tokens) and (again.doc_id, again.ids) == (doc_id, ids.tolist())
    with pytest.raises(ValueError):
        list(token_files.parse(token_files.frame(1, b"\x01\x00", 2)[:-1] + b"\x00\n"))


def test_token_files_in_many_shards(spark, tmp_path):
    """One id on a third of the rows, and as many null ids, are dealt to several shards; starts stay exact."""
    path = P.path("byte_bpe_50k.json")
    encode = token_counts.library(path)
    rows = [(7 if i % 3 == 0 else None if i % 3 == 1 else i, f"text number {i} " + "word " * (i % 40)) for i in range(600)]
    token_files.write_shards(spark.createDataFrame(rows, "doc_id long, text string"), str(tmp_path / "s"), path, shard_bytes=4000)
    got = token_files.positions(token_files.write_index(spark, str(tmp_path / "s"), str(tmp_path / "i"))).orderBy("start").collect()
    assert [r.doc_id is not None for r in got] == sorted(r.doc_id is not None for r in got) and [r.doc_id for r in got if r.doc_id is not None] == sorted(i for i, _ in rows if i is not None)
    assert all(a.start + a.n_tokens == b.start for a, b in zip(got, got[1:])) and len({r.shard for r in got if r.doc_id is None}) > 2 and len({r.shard for r in got if r.doc_id == 7}) > 2
    crc = lambda t: zlib.crc32(np.array([*encode([t])[0], 2], "<u4").tobytes())
    assert Counter((r.doc_id, r.ids_crc32) for r in got) == Counter((i, crc(t)) for i, t in rows)
    none = spark.createDataFrame([], "doc_id long, text string")
    token_files.write_shards(none, str(tmp_path / "n"), path)
    assert token_files.write_index(spark, str(tmp_path / "n"), str(tmp_path / "m")).count() == 0 and token_counts.token_counts(none, path).count() == 0


def test_sentencepiece_counts(spark, odd):
    path = next((str(f) for f in pathlib.Path(P.path("byte_bpe_50k.json")).parent.glob("*.model")), None)
    if not path:
        pytest.skip("no .model file")
    encode = token_counts.library(path)
    want = Counter((i, len(encode([t or ""])[0])) for i, t, *_ in ODD)
    assert Counter((r.doc_id, r.n_tokens) for r in token_counts.token_counts(odd, path).collect()) == want


def test_bpe_equals_the_library(odd):
    import tiktoken

    path, pattern = bpe.multi_50k()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    lib = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(5)
    made = ["".join(rng.choice(["ab", "the", " ", "\n", "ß", "漢字", "!!", "1234", "aaaaaaaaaaaaaaaa"]) for _ in range(rng.randint(0, 60))) for _ in range(200)]
    assert bpe.codec(path, pattern).encode(made) == [lib.encode_ordinary(t) for t in made]
    for r in bpe.decode(bpe.encode(odd.where("doc_id > 1"), path, pattern), path, pattern).collect():
        assert bytes(r.text).decode() in {t for i, t, *_ in ODD if i == r.doc_id}


def test_close_pairs_by_brute_force():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 64, 40, np.uint64)
    fps = np.concatenate([base, *[base ^ sum((np.uint64(1) << rng.integers(0, 64, 40).astype(np.uint64) for _ in range(k)), np.uint64(0)) for k in range(1, 7)]])
    got = {(int(i), int(j)) for x, y in simhash.close_pairs(np.zeros(len(fps), np.int64), fps) for i, j in zip(x, y)}
    want = {(i, j) for i in range(len(fps)) for j in range(i + 1, len(fps)) if bin(int(fps[i] ^ fps[j])).count("1") <= 4}
    assert got == want


@pytest.mark.parametrize("blocks", [6, 7, 8])
def test_blocks_lose_no_link(spark, blocks):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 64, 30, np.uint64)
    flip = lambda n: np.bitwise_or.reduce(np.uint64(1) << rng.choice(64, n, replace=False).astype(np.uint64))
    fps = np.concatenate([base, *[base ^ np.array([flip(n) for _ in base], np.uint64) for n in (1, 3, 4)]])
    got = {r.fp for r in simhash.clusters(spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long"), blocks=blocks).collect()}
    assert got == set(fps.view(np.int64).tolist())
    assert [simhash.blocks_for(n) for n in (0, 10**8, 10**9, 10**11, 10**13)] == [6, 6, 7, 8, 8]


@pytest.mark.parametrize("tile", [1024, 4])
def test_near_duplicates(spark, odd, tile):
    rng = random.Random(4)
    rows, word = [], lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    for c in range(12):
        ws = [word() for _ in range(300)]
        for k in range(8):
            v = list(ws)
            for _ in range(k // 3):
                v[rng.randrange(300)] = word()
            rows.append((100 + len(rows), " ".join(v), None, None, None))
    docs = odd.unionByName(spark.createDataFrame(rows, DOCS))
    got = {(r.doc_id, r.fp): r.component_id for r in simhash.near_duplicates(docs, tile=tile).collect()}
    all_ = [(i, simhash.fingerprint(t or "")) for i, t, *_ in [*ODD, *rows]]
    root = list(range(len(all_)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(all_)):
        for j in range(i):
            if bin(all_[i][1] ^ all_[j][1]).count("1") <= 4:
                root[find(i)] = find(j)
    for i, (d, fp) in enumerate(all_):
        low = min((x for k, (x, _) in enumerate(all_) if find(k) == find(i) and x is not None), default=None)
        assert got[(d, fp - (1 << 64) if fp >> 63 else fp)] == low


def test_pipeline_keeps_one_row_of_each_component(spark):
    import corpus_pipeline

    rng = random.Random(6)
    text = [" ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(200)) for _ in range(7)]
    rows = [(None, text[0]), (None, text[1]), (None, text[1]), (None, text[2]), (3, text[2]), (5, text[3]), (5, text[4]), (6, text[4]), (7, text[5]), (7, text[5]), (8, text[6]), (2, text[6]), (None, text[6])]
    docs = spark.createDataFrame([(i, t, "en", 1, "x") for i, t in rows], DOCS)
    got = corpus_pipeline.one_of_each_group(spark, docs, "")
    assert got.columns == docs.columns
    assert Counter((r.doc_id, r.text) for r in got.collect()) == Counter([(None, text[0]), (None, text[1]), (3, text[2]), (5, text[3]), (5, text[4]), (7, text[5]), (2, text[6])])


def brute_repeats(texts, width):
    count = Counter(t[i : i + width] for t in texts for i in range(len(t) - width + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - width + 1):
            if count[t[i : i + width]] > 1:
                gone[i : i + width] = True
        edge = np.diff(np.concatenate([[0], gone.astype(int)]))
        out.append((len(t), int(gone.sum()), int((edge == 1).sum()), hashlib.sha256(np.frombuffer(t, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


@pytest.mark.parametrize(("hot", "short"), [(512, None), (512, 224), (7, 150), (2, None), (2, 224)])
def test_repeats(spark, texts, hot, short, monkeypatch):
    monkeypatch.setattr(repeats.repeated_windows, "__defaults__", (400, 64, hot, None))
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)] + [(1000, None, None, None, None)], DOCS)
    got = {r.doc_id: tuple(r)[1:] for r in repeats.repeat_report(docs, short=short).collect()}
    want = brute_repeats([t.encode() for t in texts], 400)
    if short:
        few = brute_repeats([t.encode() for t in texts], short)
        want = [(*w, f[1], f[1] > 0) for w, f in zip(want, few)]
    assert [got[i] for i in range(len(texts))] == want and got[1000][:3] == (0, 0, 0)


def test_repeats_over_piece_borders(spark, monkeypatch):
    """Texts of over three times PIECE, with anchors on either side of each border, and a text that is one period."""
    monkeypatch.setattr(repeats, "PIECE", 1024)
    rng = random.Random(21)
    noise = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage = noise(900)
    texts = [noise(900) + passage + noise(2500), noise(3000) + passage, noise(1600) + passage[100:] + noise(1500) + passage[:600], "ab" * 2500, noise(4000)]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], DOCS)
    assert [r[1:] for r in map(tuple, repeats.repeat_report(docs, short=224).drop("n_short", "repeated").orderBy("doc_id").collect())] == brute_repeats([t.encode() for t in texts], 400)
    assert [r.n_short for r in repeats.repeat_report(docs, short=224).orderBy("doc_id").collect()] == [x[1] for x in brute_repeats([t.encode() for t in texts], 224)]


def test_repeats_keep_columns_whatever_their_names(spark, texts):
    more = spark.createDataFrame([(i, t, "a", "b", "c", "d", "e", "f", "g") for i, t in enumerate(texts)] + [(None, None, "a", "b", "c", "d", "e", "f", "g")], "doc_id long, text string, t1 string, t2 string, row string, copies string, spans string, kept string, `dot.ted` string")
    out = repeats.remove_repeats(more)
    assert out.columns == more.columns and out.count() == len(texts) + 1
    rows = {r.doc_id: r for r in out.collect()}
    assert rows[None].text is None and rows[3].asDict()["dot.ted"] == "g"
    sizes = [w[0] - w[1] for w in brute_repeats([t.encode() for t in texts], 400)]
    assert all(len(rows[i].text.encode()) >= sizes[i] for i in range(len(texts))) and [len(rows[i].text.encode()) for i in range(60)] == sizes[:60]


def test_repeats_beside_a_text_that_shares_one_gram(spark):
    rng = np.random.default_rng(8)
    noise = lambda n, low=97: rng.integers(low, low + 11, n).astype(np.uint8).tobytes()
    made = [(repeats.anchors(np.frombuffer(p, np.uint8)), p) for p in (noise(450) for _ in range(400))]
    (_, places, *_), passage = min((x for x in made if len(x[0][0]) == 1 and 150 < x[0][1][0] < 250), key=lambda x: x[0][0].view(np.uint64)[0])
    gram = passage[places[0] : places[0] + 64]
    # the third text's string begins later and sorts behind the others, the fourth's before them
    texts = [noise(300) + passage + noise(300), noise(500) + passage + noise(200), noise(90, 112) + gram + noise(600, 112), noise(60, 33) + gram + noise(900, 33)]
    docs = spark.createDataFrame([(i, t.decode(), None, None, None) for i, t in enumerate(texts)], DOCS)
    got = {r.doc_id: tuple(r)[1:] for r in repeats.repeat_report(docs).collect()}
    want = brute_repeats(texts, 400)
    assert [got[i] for i in range(len(texts))] == want and [w[1] for w in want] == [450, 450, 0, 0]


def test_columns_when_a_later_group_leaves():
    rng = np.random.default_rng(1)
    body = lambda n: rng.integers(98, 122, n).astype(np.uint8).tobytes()
    shared, gram = body(500), body(64)
    strings = [shared, shared, b"z" * 5 + shared[300:364] + body(300), gram + body(336), gram + body(336)]
    [(marks, _)] = repeats.columnwise(np.array([0, 0, 0, 1, 1]), strings, np.array([36, 36, 331, 336, 336]))
    assert marks[:2, 36:137].all() and not marks[2:].any()


def test_licenses(spark, odd):
    more = spark.createDataFrame([(50, "Released under the MIT License. the MIT\nlicense! Apache-License", "en", 1, "x"), (51, "GNU GENERAL PUBLIC LICENSE general public", "en", 1, "x"), (52, "Licensed under CC BY-NC 4.0.", "en", 1, "x")], DOCS)
    got = {r.doc_id: r for r in licenses.license_scan(odd.unionByName(more)).collect()}
    assert (got[50].n_words, got[50].n_base, got[50].first_word, got[50].last_word, got[50].base_labels) == (10, 3, 3, 8, "apache,mit")
    assert (got[51].n_base, got[51].first_word, got[51].base_labels) == (1, 1, "gpl") and got[52].labels == "cc-by-nc-4.0" and got[1].n_words == 0 and got[1].labels == ""
    assert licenses.license_scan(odd).count() == len(ODD)


def test_licenses_by_brute_force(spark):
    """Base columns and labels of random texts made of template words, against a plain scan by edit distance."""
    rng = random.Random(17)
    pool = [w for t, _ in [*licenses.TEMPLATES, *licenses.BASE] for w in t.split()] + ["x", "zebra", "ñandú"]
    rows = []
    for i in range(150):
        ws = [rng.choice(pool) for _ in range(rng.randint(0, 12))]
        for _ in range(rng.randint(0, 3)):
            t = rng.choice([*licenses.TEMPLATES, *licenses.BASE])[0].split()
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
                at = rng.randrange(len(t))
                t[at : at + rng.choice([0, 1])] = rng.choice([[], ["x"], ["zebra"]])
                t = t or ["x"]
            ws += t + [rng.choice(pool) for _ in range(rng.randint(0, 5))]
        rows.append((i, " ".join(w.upper() if rng.random() < 0.1 else w for w in ws)))

    def words(text):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate({c: c + 32 for c in range(65, 91)}))

    def distance(a, b):
        line = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            line, old = [i], line
            for j, y in enumerate(b, 1):
                line.append(min(old[j] + 1, line[-1] + 1, old[j - 1] + (x != y)))
        return line[-1]

    got = {r.doc_id: r for r in licenses.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    extra = 0
    for i, text in rows:
        ws, r = words(text), got[i]
        at = [(s, label) for phrase, label in licenses.BASE for s in range(len(ws)) if ws[s : s + len(phrase.split())] == phrase.split()]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(ws), len(at), min((s for s, _ in at), default=None), max((s for s, _ in at), default=None), ",".join(sorted({x for _, x in at})))
        exact, near = set(), set()
        for phrase, label in licenses.TEMPLATES:
            t = phrase.split()
            edits = len(t) // licenses.EDIT_EVERY
            best = min((distance(ws[s : s + m], t) for s in range(len(ws)) for m in range(len(t) - edits, len(t) + edits + 1)), default=99)
            if best == 0:
                exact.add(label)
            if best <= edits:
                near.add(label)
        labels = set(r.labels.split(",")) - {""} - {x for _, x in at}
        assert labels <= near and {x for x in exact if x not in ("lgpl",)} - {x for _, x in at} <= labels | {x for _, x in at}, (text, labels, exact, near)
        extra += len(labels - exact)
    assert extra > 5


def test_licenses_verify_order_and_length(spark):
    texts = ["licensed under x under cc x cc by x by 4 x 4 0", "all rights x rights reserved", "licensed under cc by nc 4 0", "released under the mit license", "licensed under the apache license x version 2 0", "licensed under the apache license x y version 2 0", "under the terms licensed version 2 0 the apache license", "licensed under the apache license version 1 0", "this work is licensed under the gnu general public license version 2", "this work is licensed under the gnu lesser general public license version 3", "this work is licensed under a gnu general public license version 3"]
    got = [r.labels for r in licenses.license_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()]
    assert got == ["", "", "cc-by-nc-4.0", "mit", "apache,apache-2.0", "apache", "apache", "apache", "gpl", "gpl,lgpl", "gpl,gpl-3.0"]


@pytest.mark.parametrize("rows", [500_000, 3])
def test_decontamination(spark, odd, rows, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", rows)
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    head = " ".join(word() for _ in range(9))  # an opening that most items share
    items = [(i, (head + " " if i > 3 else "") + " ".join(word() for _ in range(rng.randint(3, 50)))) for i in range(12)] + [(99, None), (100, "")]
    docs = []
    for i in range(60):
        body = [word() for _ in range(rng.randint(0, 80))]
        if i % 2:
            part = items[i % 12][1].split()
            for _ in range(i % 3):
                part[rng.randrange(len(part))] = word()
            body[10:10] = part
        docs.append((i + 200, " ".join(body)))
    bench = spark.createDataFrame(items, "item_id long, text string")
    frame = spark.createDataFrame([(i, t, None, None, None) for i, t in docs], DOCS).unionByName(odd)
    got = {(r.doc_id, r.item_id): round(r.similarity, 9) for r in decontaminate.contaminated(frame, bench).collect()}
    cut = lambda w: [tuple(w[i : i + 5]) for i in range(len(w) - 4)] if len(w) >= 5 else [tuple(w)]
    want = {}
    for d, t in docs:
        for k, it in items:
            if it:
                a, s, best = Counter(cut(it.split())), cut(t.split()) if t else [], 0.0
                m = sum(a.values())
                for at in range(max(1, len(s) - m + 1)):
                    w = Counter(s[at : at + m])
                    both = sum((a & w).values())
                    best = max(best, both / (m + sum(w.values()) - both))
                if best >= 0.8:
                    want[(d, k)] = round(best, 9)
    assert got == want and want
    named = frame.withColumnsRenamed({"lang": "_contaminated_k", "h": "k_"})
    assert decontaminate.clean(named, bench).columns == named.columns
    assert decontaminate.clean(frame, bench).count() == frame.count() - len({d for d, _ in want})


def test_url_rules(spark):
    urls = [("http://a.net/x", "block", "net/"), ("https://b.example.net/en/1?q", "allow", "example.net/en/"), ("http://EXAMPLE.com/de/#t", "block", "example.com/de/"), ("http://x.org/fr/", "allow", "org/fr/"), ("http://a.net", "allow", None), ("nothing", "allow", None), (None, "allow", None), ("ftp://q?u", "allow", None)]
    pages = spark.createDataFrame([(i, u, "net") for i, (u, _, _) in enumerate(urls)] + [(i, f"http://w{i % 7}.spam.com/buy/{i}" if i % 2 else f"http://w{i % 7}.good.com/read/{i}", "") for i in range(100, 200)], "page_id long, url string, host string")
    labels = spark.createDataFrame([(i, 1 - i % 2, 0) for i in range(100, 180)], "doc_id long, quality int, toxic int")
    got = {r.page_id: r for r in url_rules.judge(pages, labels).collect()}
    assert [(got[i].verdict, got[i].rule) for i in range(len(urls))] == [(v, r) for _, v, r in urls]
    assert got[2].host == "example.com" and got[1].path == "/en/1" and got[7].host == "q" and got[6].host == ""
    assert all(got[i].verdict == ("block" if i % 2 else "allow") for i in range(180, 200))


def test_url_rules_by_brute_force(spark):
    """Every combination of up to three tokens, counted plainly, gives the rules that FP-growth and its bounds keep; hosts and paths by plain Python."""
    from itertools import combinations

    rng = random.Random(13)
    hosts, segments = ["a.net", "b.com", "Shop.b.com", "c.org", "win-big.io", "example.com", "d.example.net"], ["", "/buy/now", "/read", "/en/", "/de/x", "/fr/", "/win"]
    urls = [rng.choice(["http://", "https://"]) + rng.choice(hosts) + rng.choice(segments) + rng.choice(["", "?q=1", "#t"]) for _ in range(400)] + [None, "", "no scheme", "://", "http://?x"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    bad = {i: int("win" in (u or "") or rng.random() < 0.1) for i, u in enumerate(urls) if i < 300}
    got = {r.page_id: r for r in url_rules.judge(pages, spark.createDataFrame([(i, 1 - b, 0) for i, b in bad.items()], "doc_id long, quality int, toxic int")).collect()}

    def parts(u):
        if not u or "://" not in u:
            return "", ""
        rest = u.split("://", 1)[1]
        h = re.match(r"[^/?#]*", rest)[0]
        return h.translate({c: c + 32 for c in range(65, 91)}), re.match(r"[^?#]*", rest[len(h) :])[0]

    def tokens(h, p):
        t = ["h:" + x for x in h.split(".")] + ["w:" + x for x in re.split(r"[.\-]", h)] + ["p:" + x for x in p.split("/") if not re.search("[0-9]", x)]
        return {x for x in t if len(x) > 2}

    bags = [(tokens(*parts(urls[i])), b) for i, b in bad.items() if tokens(*parts(urls[i]))]
    n, n_bad = len(bags), sum(b for _, b in bags)
    has, hit = Counter(), Counter()
    for t, b in bags:
        for k in (1, 2, 3):
            for c in combinations(sorted(t), k):
                has[c] += 1
                hit[c] += b
    need = max(url_rules.MIN_SUPPORT, url_rules.MIN_COUNT / n)
    rules = [set(c) for c in has if hit[c] / n >= need and hit[c] / has[c] >= url_rules.MIN_CONFIDENCE and hit[c] / has[c] / (n_bad / n) >= url_rules.MIN_LIFT]
    assert rules
    for i, u in enumerate(urls):
        h, p = parts(u)
        fits = [(len(x + y), v, x + y) for v, x, y in url_rules.RULES if (h == x or h.endswith("." + x)) and p.startswith(y)]
        rule = max(fits)[2] if fits else None
        verdict = max(fits)[1] if fits else "block" if any(r <= tokens(h, p) for r in rules) else "allow"
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == (h, p, rule, verdict), u


def test_neighbours_of_repeated_rows(spark):
    """Rows of one id stay apart: each query row has its own k, and rows that share its id are candidates."""
    rows = [(i, [float(i + 1), 1.0]) for i in range(20)] + [(0, [1.0, 1.0]), (0, [5.0, 1.0]), (50, [2.0, 1.0]), (50, None)]
    got = neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), chunk=7, asked_at_once=2).collect()
    x = [(i, np.array(v)) for i, v in rows if v]
    want = Counter()
    for a, (i, v) in enumerate(x):
        if i % 50 == 0:
            s = sorted((-float(neighbours.cosine(v, w[None])[0]), j) for b, (j, w) in enumerate(x) if a != b)[:5]
            want.update((i, r, j, -c) for r, (c, j) in enumerate(s, 1))
    assert Counter((r.query_id, r.rank, r.vec_id, r.score) for r in got) == want and len(got) == 20


def test_neighbours(spark):
    rng = np.random.default_rng(1)
    centre = rng.normal(size=(20, 16))
    x = (centre[rng.integers(0, 20, 1500)] + 0.4 * rng.normal(size=(1500, 16))).astype(np.float32)
    x[700:760] = x[700]
    rows = [(i, v.tolist(), "p") for i, v in enumerate(x)] + [(2000, None, ""), (2050, [0.0] * 16, ""), (2100, [float("nan")] * 16, ""), (2150, [None] * 16, "")]
    got: dict = {}
    for r in neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>, part string"), sample=1000, chunk=300).collect():
        got.setdefault(r.query_id, {})[r.rank] = r.vec_id
    y = x.astype(float)
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    hit = 0
    for i in range(0, 1500, 50):
        s = np.round(y @ y[i], 12)
        s[i] = -9
        hit += len(set(got[i].values()) & set(np.lexsort((np.arange(1500), -s))[:5].tolist()))
    assert hit / 150 >= 0.9 and set(got) == set(range(0, 1500, 50))
    assert [got[700][k] for k in range(1, 6)] == [701, 702, 703, 704, 705]


def test_toxicity(spark, odd):
    rng = random.Random(2)
    bad, good = ["stupid", "idiot", "moron"], ["".join(rng.choice("aeioulnrst") for _ in range(6)) for _ in range(60)]
    rows = [(i, " ".join([rng.choice(good) for _ in range(60)] + ([rng.choice(bad) for _ in range(4)] if i % 3 == 0 else [])), None, None, None) for i in range(10, 410)]
    docs = spark.createDataFrame(rows, DOCS).unionByName(odd)
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(10, 410)], "doc_id long, toxic int")
    got = toxicity.toxicity(spark, docs, labels).collect()
    assert len(got) == 400 + len(ODD) and all(0 <= r.score <= 1 for r in got)
    test = [(r.predicted, int(r.doc_id % 3 == 0)) for r in got if r.held_out and r.doc_id is not None and r.doc_id >= 100]
    assert np.mean([a == b for a, b in test]) > 0.95
    assert all(r.predicted == 0 for r in got if r.doc_id in (1, 2, 3))
    assert toxicity.toxicity(spark, docs.limit(0), labels).count() == 0


def test_toxicity_reads_long_words_to_their_end(spark):
    rng = random.Random(12)
    for n in (1, 39, 40, 41, 44, 45, 76, 77, 80, 500):
        word = "".join(rng.choice("abcdefgh") for _ in range(n))
        marked = f"<{word}>"
        want = {zlib.crc32(marked[i : i + g].encode()) % toxicity.BUCKETS for g in toxicity.GRAMS for i in range(len(marked) - g + 1)}
        assert want <= {b for w in toxicity.words_of(word) for b in toxicity.bag(w)}
    table = np.zeros((toxicity.BUCKETS, 1), np.float32)
    table[toxicity.bag("idiot")] = 50.0
    model = toxicity.Model(table, np.array([[0.0], [30.0]], np.float32), np.zeros(2, np.float32))
    glued = "天" * 60
    docs = spark.createDataFrame([(1, glued + "天天天天天", None, None, None), (2, glued + "idiot", None, None, None), (3, "ok " + glued + "idiot" + glued, None, None, None)], DOCS)
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    assert got[1] == 0.5 and got[2] > 0.7 and got[3] > 0.6


def test_toxicity_by_plain_computation(spark, odd):
    """held_out, score and predicted of each row from the model's table by plain Python."""
    import math

    rng = np.random.default_rng(4)
    model = toxicity.Model(rng.normal(0, 3, (toxicity.BUCKETS, 2)).astype(np.float32), np.array([[0.1, -0.4], [0.9, 0.7]], np.float32), np.array([0.2, -0.1], np.float32))
    logit, bias = model.logits()
    for r in toxicity.score(odd, model).collect():
        words = Counter(re.findall(r"[^\W_]+", (r.text or "").lower()))
        total = sum((1 + math.log(c)) * float(logit[toxicity.bag(w)].mean()) for w, c in words.items()) / (toxicity.PAD + sum(1 + math.log(c) for c in words.values()))
        assert abs(r.score - 1 / (1 + math.exp(-(total + bias if words else min(bias, 0.0))))) < 1e-6
    ids = spark.createDataFrame([(i,) for i in (*range(-5, 300), 2**40)], "doc_id long")
    from pyspark.sql import functions as F

    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in ids.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("h")).collect())


WIDE = "doc_id long, text string, lang string, source string, n_chars long, score string, k string, row string, t1 string, copies string, label string"


def test_pipeline_stages_on_odd_rows(spark, tmp_path, texts):
    """All five stages over null, repeated and shared ids, null, empty and long texts, and columns with clashing names; each against plain Python."""
    import corpus_pipeline

    rng = random.Random(31)
    word = lambda: "".join(rng.choice("aeioulnrst") for _ in range(6))
    line = lambda n: " ".join(word() for _ in range(n))
    bench = line(30)
    clean = [(i, line(rng.randint(20, 60))) for i in range(10, 250)]
    toxic = [(i, line(50) + " stupid idiot moron stupid idiot moron") for i in range(300, 420)]
    passage = line(60)
    odd_ = [(None, line(40)), (None, line(41)), (500, None), (501, ""), (502, "a b"), (503, line(30) + " " + bench + " " + line(20)), (504, line(9000)), (505, passage + " " + line(30)), (506, line(25) + " " + passage)]
    same = [(510, clean[3][1]), (511, clean[3][1]), (512, line(33)), (512, line(34)), (None, clean[5][1])]
    rows = [(i, t, "en", "s", len(t or ""), "c", "c", "c", "c", "c", "c") for i, t in [*clean, *toxic, *odd_, *same]]
    docs = spark.createDataFrame(rows, WIDE)
    spark.createDataFrame([(i, 1, int(i >= 300)) for i, _ in [*clean, *toxic]], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, bench), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    stage = dict(corpus_pipeline.STAGES)

    def run(name, df):
        stage[name](spark, df, str(tmp_path)).write.parquet(str(tmp_path / name))
        return spark.read.parquet(str(tmp_path / name))

    one = run("toxicity", docs)
    left = Counter((r.doc_id, r.text) for r in one.collect())
    assert one.columns == docs.columns and left == Counter([*clean, *odd_, *same])
    two = run("simhash_near_dedup", one)
    kept = Counter((r.doc_id, r.text) for r in two.collect())
    fps = {}
    for i, t in left:
        fps.setdefault(simhash.fingerprint(t or ""), []).append((i is None, i, t or ""))
    assert all(bin(a ^ b).count("1") > 4 for a in fps for b in fps if a < b)
    assert two.columns == docs.columns and {(i, t or "") for i, t in kept} == {(i, t) for _, i, t in (min(v) for v in fps.values())} and set(kept.values()) == {1}
    three = run("suffix_array_dedup", two)
    before = [((r.doc_id, r.text), r) for r in two.collect()]
    want = {k[0]: None if k[1] is None else w[0] - w[1] for (k, _), w in zip(before, brute_repeats([(k[1] or "").encode() for k, _ in before], repeats.SHORT)) if k[0] is not None and k[0] != 512}
    after = {r.doc_id: r for r in three.collect()}
    assert three.columns == docs.columns and three.count() == two.count() and {i: None if after[i].text is None else len(after[i].text) for i in want} == want
    assert want[505] < len(odd_[7][1]) - 300 and all(r.n_chars == len(r.text) for r in three.collect() if r.text is not None)
    four = run("benchmark_decontamination", three)
    assert four.columns == docs.columns and Counter(r.doc_id for r in four.collect()) == Counter(r.doc_id for r in three.collect() if r.doc_id != 503)
    five = run("byte_level_bpe", four)
    digest = lambda b: hashlib.sha256(b).hexdigest()
    assert Counter((r.doc_id, r.decoded_sha256) for r in five.collect()) == Counter((r.doc_id, digest((r.text or "").encode())) for r in four.collect())
    none = docs.limit(0)
    for name, f in corpus_pipeline.STAGES:
        none.write.mode("overwrite").parquet(str(tmp_path / "none"))
        assert f(spark, spark.read.parquet(str(tmp_path / "none")), str(tmp_path)).count() == 0, name


def test_components_that_do_not_settle(spark):
    from palimpsest.llm.components import components

    edges = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")
    assert {r.label for r in components(edges).collect()} == {0}
    with pytest.raises(RuntimeError):
        components(edges, rounds=2)


def test_empty_tables(spark):
    none = spark.createDataFrame([], DOCS)
    path, pattern = bpe.multi_50k()
    for df in (simhash.near_duplicates(none), repeats.repeat_report(none), licenses.license_scan(none), bpe.round_trip(none, path, pattern), decontaminate.contaminated(none, spark.createDataFrame([], "item_id long, text string")), neighbours.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>")), url_rules.judge(spark.createDataFrame([], "page_id long, url string"), spark.createDataFrame([], "doc_id long, quality int, toxic int"))):
        assert df.count() == 0
