"""The corpus operators against brute force on small fixtures with nulls, empty and long texts, ties and repeated rows."""

import gzip
import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests_llm_helpers import PLAIN, plain_spans

from lineflux.llm import bwt, common, decontaminate, hnsw, minhash, mixing, pii, suffix_tree, tokens, toxicity, warc

VOCABULARY = ["ab", "c", "dé", "x9", "the", "of", "zz", "q"]


def corpus(seed: int, n: int = 40) -> list[tuple]:
    """(doc_id, text, source, lang): shared passages, copies, near copies, a null, an empty and a long text, a repeated row."""
    rng = random.Random(seed)
    words = lambda k: [rng.choice(VOCABULARY) + rng.choice(VOCABULARY) for _ in range(k)]
    passages = [words(20) for _ in range(3)]
    texts = []
    for _ in range(n):
        w = words(rng.randint(1, 40))
        if rng.random() < 0.5:
            w += passages[rng.randrange(3)] + words(rng.randint(0, 9))
        texts.append(rng.choice([" ", "  ", "\n"]).join(w))
    texts += [texts[0], texts[1] + " tail", texts[2].upper(), None, "", "   ", " ".join(words(5000)), "no " * 300]
    rows = [(i * 3 + 1, t, rng.choice(["a", "b", None]), "en") for i, t in enumerate(texts)]
    return [*rows, rows[4]]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").repartition(3)


def distinct(rows):
    return dict(sorted({i: t for i, t, *_ in rows}.items()))


@pytest.mark.parametrize("seed", [1, 2])
def test_word_windows(spark, seed):
    rows = corpus(seed)
    texts = {i: (t or "").encode().split() for i, t in distinct(rows).items()}
    least, want = {}, {}
    for i, w in texts.items():
        for k in range(len(w) - 12):
            least.setdefault(tuple(w[k : k + 13]), i)
    for i, w in texts.items():
        cut = np.zeros(len(w), bool)
        for k in range(len(w) - 12):
            if least[tuple(w[k : k + 13])] < i:
                cut[k : k + 13] = True
        left = b" ".join(x for x, c in zip(w, cut) if not c)
        want[i] = (len(w), int(cut.sum()), hashlib.sha256(left).hexdigest(), left.decode())
    got = suffix_tree.dedup_windows(frame(spark, rows)).collect()
    assert len(got) == len(rows) and all(tuple(r)[1:] == want[r.doc_id] for r in got)


@pytest.mark.parametrize("seed", [1, 2])
def test_byte_strings(spark, seed):
    rows = corpus(seed)
    seen, want = set(), {}
    for i, t in distinct(rows).items():
        b = (t or "").encode()
        cut = np.zeros(len(b), bool)
        for k in range(len(b) - 99):
            if b[k : k + 100] in seen:
                cut[k : k + 100] = True
            seen.add(b[k : k + 100])
        left = np.frombuffer(b, np.uint8)[~cut].tobytes()
        want[i] = (len(b), int(cut.sum()), int(cut[:1].sum() + (cut[1:] & ~cut[:-1]).sum()), hashlib.sha256(left).hexdigest(), left)
    got = bwt.dedup_strings(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, bytes(r.kept)) == want[r.doc_id]


@pytest.mark.parametrize("seed", range(60))
def test_suffix_tree_nodes(seed):
    rng = random.Random(seed)
    letters, least = rng.choice([1, 2, 3, 8]), rng.choice([1, 2, 3, 5, 13])
    strings = [[rng.randrange(letters) for _ in range(rng.randint(1, 40))] for _ in range(rng.randint(0, 12))]
    strings += strings[:1]
    tree = suffix_tree.SuffixTree(strings, least)
    want, got = defaultdict(list), defaultdict(list)
    for i, s in enumerate(strings):
        for k in range(len(s) - least + 1):
            want[tuple(s[k : k + least])].append((i, k))
    for node, i, k in zip(tree.nodes(least).tolist(), tree.sequence.tolist(), tree.offset.tolist()):
        got[node].append((i, k))
    assert sorted(map(sorted, got.values())) == sorted(sorted(v) for v in want.values() if len(v) > 1)
    suffix = [strings[i][k:] for i, k in zip(tree.sequence.tolist(), tree.offset.tolist())]
    assert suffix == sorted(suffix)
    shared = lambda a, b: next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    for i in range(1, len(suffix)):
        if shared(suffix[i - 1], suffix[i]) >= least:
            assert tree.common[i] == shared(suffix[i - 1], suffix[i])
    for depth, first, last in tree.maximal(least):
        assert depth == min(shared(a, b) for a, b in zip(suffix[first : last - 1], suffix[first + 1 : last])) >= least


def thue_morse(n: int) -> str:
    s = "a"
    for _ in range(n):
        s += s.translate(str.maketrans("ab", "ba"))
    return s


def test_regular_words_do_not_collide(spark):
    one = thue_morse(10)
    other = one.translate(str.maketrans("ab", "ba"))
    shared = " ".join(f"w{k}" for k in range(12))
    docs = spark.createDataFrame([(1, f"{shared} {one}"), (2, f"{shared} {other}")], "doc_id long, text string")
    assert [r.n_removed for r in suffix_tree.dedup_windows(docs).collect()] == [0, 0]
    docs = spark.createDataFrame([(1, f"{one} {one} x y z"), (2, f"{other} {other} x y z")], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in minhash.near_duplicates(docs).collect()} == {1: 1, 2: 2}
    docs = spark.createDataFrame([(1, one), (2, other)], "doc_id long, text string")
    got = {r.doc_id: r.n_removed for r in bwt.dedup_strings(docs).collect()}
    seen, want = set(), {}
    for i, t in ((1, one), (2, other)):
        cut = np.zeros(len(t), bool)
        for k in range(len(t) - 99):
            cut[k : k + 100] |= t[k : k + 100] in seen
            seen.add(t[k : k + 100])
        want[i] = int(cut.sum())
    assert got == want


def test_suffix_order_is_sorted():
    strings = [b"banana", b"ananas", b"banana", b"b"]
    data = np.frombuffer(b"\xff" + b"\xff".join(strings) + b"\xff", np.uint8)
    size = np.array([len(s) for s in strings])
    base = np.cumsum(size + 1) - size
    order = bwt.suffix_order(data, base, size)
    ends = {int(b + s): None for b, s in zip(base, size)}
    text = data.tobytes()
    suffix = [text[p : min(e for e in ends if e >= p)] for p in order.tolist()]
    assert suffix == sorted(suffix) and len(suffix) == sum(size) + len(strings)


@pytest.mark.parametrize("block", [8 << 20, 200])
def test_near_duplicates(spark, block, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", block)
    rows = corpus(3)
    sets = {}
    for i, t in distinct(rows).items():
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    part = {i: i for i in sets}
    ids = list(sets)
    for _ in ids:
        for a in ids:
            for b in ids:
                if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                    part[a] = part[b] = min(part[a], part[b])
    got = minhash.near_duplicates(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), part[r.doc_id], part[r.doc_id] == r.doc_id)


def test_signature_estimates():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 1 << 63, 2000, dtype=np.uint64)
    for share in (0.3, 0.8):
        b = np.concatenate([a[: int(2000 * share)], rng.integers(0, 1 << 63, 2000 - int(2000 * share), dtype=np.uint64)])
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        got = minhash.estimates(minhash.packed(minhash.minima(np.unique(a))), minhash.packed(minhash.minima(np.unique(b)))[None])[0]
        assert abs(got - true) < 0.2


def test_contamination(spark):
    rows = corpus(4)
    pick = [t for _, t, *_ in rows if t and len(t.split()) > 25]
    items = [(1, " ".join(pick[0].split()[-20:])), (2, pick[3]), (10, "zzzz yyyy"), (3, ""), (4, None), (5, "zzab"), (5, "zzab")]
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    split = lambda t: word.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = defaultdict(set)
    for i, t in items:
        w = split(t)
        n = min(13, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            windows[tuple(w[k : k + n])].add(str(i))
    want = {}
    for i, t in distinct(rows).items():
        w, hit, which = split(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
                    which |= windows[tuple(w[k : k + n])]
        want[i] = (len(w), len(hit), len(which), hashlib.sha256(",".join(sorted(which)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w))
    got = decontaminate.contamination(frame(spark, rows).select("doc_id", "text"), spark.createDataFrame(items, "item_id int, text string")).collect()
    assert len(got) == len(rows) and all(tuple(r)[1:] == want[r.doc_id] for r in got)
    assert any(r.n_hit for r in got)


def test_personal_data_base(spark):
    odd = ["a@b.co_x@y.com z@q", "1.2.3.4.5.6.7.8 999.1.1.1 001.02.3.255", "4111 1111 1111 1111  4111", "+1 (705) 555-6638)) +12-", "é𝕏 a.b@c-d.e-f.g. +49 30 123456-", "", None, "x" * 20_000, "1" * 20_000, "+1+2345678901"]
    got = {r.doc_id: r for r in pii.extract(spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string")).collect()}
    assert got[0].spans == "email:0:6,email:6:14" and got[1].n_ip == 3 and got[2].n_card == 1 and got[3].n_phone == 1
    assert got[4].spans == "email:3:16,phone:18:31"
    assert all(got[k].spans == "" for k in (5, 6, 7, 8)) and got[9].n_phone == 1
    assert got[6].base_sha256 == hashlib.sha256(b"").hexdigest()


def test_personal_data_against_plain_patterns(spark):
    rng = random.Random(21)
    parts = ["a", "B.", "@", ".", "-", "x@y.de", "+1", "1", "25", "255", "256", " ", " ", "(", ")", "4111111111111111", "10.0.0.1", "+49 30 1234567", "é", "𝕏", "\n", "0", "%", "_", "5500-0000-0000-0004"]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 30)))) for i in range(800)]
    got = {r.doc_id: r for r in pii.extract(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert sum(len(plain_spans(t)) for _, t in rows) > 300
    for i, t in rows:
        want, r = plain_spans(t), got[i]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == kind for k, _, _ in want) for kind in PLAIN], t
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest(), t
        assert {f"{k}:{a}:{b}" for k, a, b in want} <= set(r.spans.split(",")) | {""}


def test_pattern_scores_against_plain_loops(spark):
    rng = random.Random(22)
    edges = sorted({(f"p{rng.randrange(8)}", f"i{rng.randrange(60)}") for _ in range(260)})
    seed = {f"i{k}": k % 2 for k in range(50)}
    rows = [(p, i, seed.get(i)) for p, i in edges]
    of_p, of_i = defaultdict(set), defaultdict(set)
    for p, i in edges:
        of_p[p].add(i)
        of_i[i].add(p)
    score = {(i, k): 1.0 for i, k in seed.items()}
    for _ in range(3):
        trust = {(p, k): sum(score.get((i, k), 0) for i in of_p[p]) / (len(of_p[p]) + 1) for p in of_p for k in (0, 1)}
        trust = {x: t for x, t in trust.items() if any((i, x[1]) in score for i in of_p[x[0]])}
        fresh = {(i, k): 1 - np.prod([1 - min(trust.get((p, k), 0), 0.999) for p in of_i[i]]) for i in of_i if i not in seed for k in (0, 1) if any((p, k) in trust for p in of_i[i])}
        score = {(i, k): 1.0 for i, k in seed.items() if i in of_i} | fresh
    got = {(r.pattern, r.kind): r.trust for r in pii.trusted(spark.createDataFrame(rows, "pattern string, instance string, seed int"), 3, 0.0).collect()}
    assert got == pytest.approx(trust) and len(got) == 16


def test_shapes_and_right_words_find_unseen_numbers(spark):
    rng = random.Random(23)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    rows = [(i, f"{word()} {word()} 10.{100 + i % 100}.7.{10 + i % 80} {word()}") for i in range(120)] + [(500, f"{word()} {word()} 10.300.7.25 {word()}"), (501, f"version 10.2 of {word()}")]
    rows += [(600 + i, f"{word()} x{i}@mail.org writes") for i in range(30)] + [(700, f"{word()} kim9(at)home writes")]
    rows += [(800, f"{word()} token = \"{'0123456789abcdef' * 3}\" {word()}")]
    got = {r.doc_id: r for r in pii.extract(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[500].n_ip == 0 and got[500].spans.startswith("ip:") and got[501].spans == ""
    assert got[700].spans.startswith("email:") and got[700].n_email == 0
    assert got[800].spans.startswith("secret:") and got[800].base_sha256 == hashlib.sha256(b"").hexdigest()


def test_personal_data_in_context(spark):
    seeds = [(i, f"lorem write to user{i}@mail.example.org now", "s", "en") for i in range(20)]
    rows = [*seeds, (100, "lorem write to bob7(at)example now", None, None), (101, "room 17 is free", None, None)]
    got = {r.doc_id: r for r in pii.extract(spark.createDataFrame(rows, "doc_id long, text string, a string, b string")).collect()}
    assert got[100].n_added == 1 and got[100].spans.startswith("email:15:") and got[101].spans == ""
    clean = {r.doc_id: r.text for r in pii.redact(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")).collect()}
    assert clean[3] == "lorem write to [EMAIL] now" and clean[100] == "lorem write to [EMAIL] now" and clean[101] == "room 17 is free"


def test_spaced_numbers_are_whole_seeds(spark):
    rows = [(i, f"lorem please dial +1 (743) 555-{3000 + i} today") for i in range(30)] + [(100, "lorem please dial 743.555.9999 today"), (101, "room 17 is free")]
    got = {r.doc_id: r for r in pii.extract(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i].n_phone == 1 and got[i].n_added == 0 for i in range(30))
    assert got[100].spans == "phone:18:30" and got[100].n_added == 1 and got[101].spans == ""


def test_token_counts(spark):
    P = pytest.importorskip("public_tokenizers")
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=P.path(tokens.MODEL))
    rng = random.Random(5)
    parts = ["a", "  ", " ", "é", "\n", "\t", "▁", "</s>", "the", "𝕏", "\0", "x" * 300]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 20)))) for i in range(300)] + [(900, None), (901, "word " * 6000), (901, "word " * 6000)]
    got = tokens.count_tokens(spark.createDataFrame(rows, "doc_id long, text string"), P.path(tokens.MODEL)).collect()
    text = dict(rows)
    for r in got:
        t = text[r.doc_id] or ""
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(t.encode()), len(model.encode(t)), len(model.encode(t)) > 4096)
    assert len(got) == len(rows)


def test_mix(spark):
    rng = random.Random(6)
    rows = [(i, "w " * rng.randint(0, 60), rng.choice(["a", "b", "b", "b", "c", None]), "en") for i in range(400)] + [(7, "w w", "a", "en"), (None, "w", "b", "en"), (500, None, "c", "en")]
    got = mixing.mix(mixing.sized(frame(spark, rows)), ranges=16).collect()
    again = mixing.mix(mixing.sized(frame(spark, rows)), ranges=16).collect()
    key = lambda r: (str(r.doc_id), r.size, r.taken)
    assert sorted(map(key, got)) == sorted(map(key, again)) and len(got) == len(rows)
    by = defaultdict(lambda: [0, 0, 0.0])
    for r in got:
        assert 0 <= r.taken <= 3 * r.size
        s = by[r.source]
        s[0], s[1], s[2] = s[0] + r.size, s[1] + r.taken, r.target
    total = sum(s[0] for s in by.values())
    assert sum(s[2] for s in by.values()) == pytest.approx(total)
    for s in by.values():
        assert s[2] <= 3 * s[0] + 1e-6 and abs(s[1] - s[2]) <= 5


def test_targets_refill(spark):
    got = {r.source: r.target for r in mixing.targets(spark.createDataFrame([("a", 10), ("b", 1), ("c", 89)], "source string, source_size long")).collect()}
    # weights 1, 2, 3 of 100: b stops at 3, the other 97 go 1 to 3, a at 24.25 stays below its 30
    assert got == pytest.approx({"a": 24.25, "b": 3.0, "c": 72.75})


def test_warc_round_trip_and_salvage(spark, tmp_path):
    rows = [(3, "u", "same"), (1, "v", "same"), (2, None, None), (4, "w\r\nx", "a\r\n\r\nWARC/1.1\r\nb é"), (5, "y", "")]
    warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), f"{tmp_path}/a")
    got = {r.page_id: r for r in warc.read_archives(spark, f"{tmp_path}/a").collect()}
    assert all(r.fault is None for r in got.values()) and len(got) == 5
    assert (got[1].record_type, got[3].record_type, got[3].refers_to) == ("response", "revisit", "1")
    assert (got[5].record_type, got[5].refers_to) == ("revisit", "2")
    assert got[3].payload_digest == warc.sha1_base32(b"same") and got[3].payload_bytes == 4
    assert bytes(got[4].payload).decode() == rows[3][2]

    data = next((tmp_path / "a").glob("part-*")).read_bytes()
    whole = list(warc.salvage(data))
    assert len(whole) == 5 and [f.fault for f in whole] == [None] * 5
    broken = data[: whole[1].first] + data[whole[1].first :].replace(b"Content-Length: ", b"Content-Length: 9", 1)
    found = list(warc.salvage(b"junk" + broken))
    assert [f.fault is None for f in found].count(True) == 4 and found[0].fault and found[0].end == 4
    assert found[0].first == 0 and found[-1].end == len(broken) + 4 and all(a.end == b.first for a, b in zip(found, found[1:]))
    flipped = bytearray(data)
    flipped[whole[0].end - 5] ^= 1 if whole[0].block else 0
    members = b"".join(gzip.compress(data[f.first : f.end]) for f in whole)
    bad = bytearray(members)
    bad[len(gzip.compress(data[whole[0].first : whole[0].end])) + 30] ^= 255
    kept = [f for f in warc.salvage(bytes(bad)) if not f.fault]
    assert len(kept) == 4 and any(f.fault for f in warc.salvage(bytes(bad)))


def test_near_embeddings(spark):
    rng = np.random.default_rng(9)
    centre = rng.normal(size=(20, 16))
    x = centre[rng.integers(0, 20, 300)] + rng.normal(size=(300, 16)) * 0.15
    rows = [(i, [float(np.float32(v)) for v in x[i]], int(i % 3)) for i in range(300)]
    rows += [(300, rows[0][1], rows[0][2]), (301, None, 1), (302, [0.0] * 16, 1), (303, [float("nan")] * 16, 1), (304, rows[0][1], None), (305, [1.0, 2.0], 1), (306, [None] * 16, 1)]
    links, part = defaultdict(int), {r[0]: r[0] for r in rows}
    good = [(i, np.array(v), l) for i, v, l in rows if l is not None and v is not None and None not in v and np.isfinite(v).all() and np.any(v)]
    pairs = [(a[0], b[0]) for a in good for b in good if a[0] < b[0] and a[2] == b[2] and len(a[1]) == len(b[1]) and a[1] @ b[1] / np.linalg.norm(a[1]) / np.linalg.norm(b[1]) >= 0.93]
    for a, b in pairs:
        links[a] += 1
        links[b] += 1
    for _ in range(20):
        for a, b in pairs:
            part[a] = part[b] = min(part[a], part[b])
    got = hnsw.near_embeddings(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), shard=64).collect()
    assert len(got) == len(rows) and pairs
    for r in got:
        assert (r.n_links, r.component_id, r.kept) == (links[r.vec_id], part[r.vec_id], part[r.vec_id] == r.vec_id)


def test_graph_recall():
    rng = np.random.default_rng(1)
    x = hnsw.unit(rng.normal(size=(1500, 32))).astype(np.float32)
    g = hnsw.Graph.build(x)
    top = np.argsort(-(x[:200] @ x.T), axis=1)[:, :10]
    ids, _ = g.search(x[:200], 96)
    assert np.mean([len(set(a) & set(b)) / 10 for a, b in zip(top, ids)]) > 0.9


def test_planted_audit_rejects_a_graph_that_finds_nothing():
    rng = np.random.default_rng(3)
    x = hnsw.unit(rng.normal(size=(2000, 32)))
    x[701] = hnsw.unit(x[700:701] + 0.01 * rng.normal(size=(1, 32)))[0]
    broken = hnsw.Graph(x.astype(np.float32), [np.full((2000, 24), -1, np.int32)], [np.arange(2000)])
    width, found, planted = hnsw.planted_width(broken, x, 0.93)
    assert width is None and found < 10 and planted == hnsw.PLANTED
    want = {(int(a), int(b)) for a, b in np.argwhere(x @ x.T >= 0.93) if a != b}
    assert {(700, 701), (701, 700)} <= want
    seen = {}
    assert {(int(i), int(j)) for a, b in hnsw.links_of(broken, x, x, 0.93, np.arange(2000), width, seen) for i, j in zip(a, b)} == want
    assert seen["queries"] == seen["exact"] == 2000


def test_a_sound_graph_answers_by_itself_and_full_beams_by_products():
    rng = np.random.default_rng(4)
    size = np.array([200] + [6] * 300)
    x = hnsw.unit(np.repeat(rng.normal(size=(301, 32)), size, 0) + 0.02 * rng.normal(size=(2000, 32)))
    g = hnsw.Graph.build(x.astype(np.float32))
    width, found, planted = hnsw.planted_width(g, x, 0.93)
    assert width is not None and found >= hnsw.RECALL * planted
    seen = {}
    got = {(int(i), int(j)) for a, b in hnsw.links_of(g, x, x, 0.93, np.arange(2000), width, seen) for i, j in zip(a, b)}
    want = {(int(a), int(b)) for a, b in np.argwhere(x @ x.T >= 0.93) if a != b}
    assert len(got & want) >= 0.999 * len(want) and got <= want
    assert seen["exact"] <= 200 and seen["got"] >= 0.999 * seen["wanted"] > 0


def test_several_shards_at_default_settings(spark):
    rng = np.random.default_rng(12)
    base = rng.normal(size=(hnsw.SHARD + 3000, 8))
    twin = base[:40] + 0.001 * rng.normal(size=(40, 8))
    x = np.concatenate([base, twin])
    rows = spark.createDataFrame([(i, [float(v) for v in r], 1) for i, r in enumerate(x)], "vec_id long, embedding array<double>, label int").repartition(4)
    links = hnsw.searched(hnsw.classes_of(hnsw.valid(rows)), 0.9995, hnsw.SHARD)
    report = hnsw.audit(links).first()
    assert links.where("queries is not null and planted > 0").count() >= 2 and report.queries >= 2 * len(x)
    u = hnsw.unit(x)
    want = np.zeros(len(x), int)
    for k in range(0, len(x), 1000):
        want[k : k + 1000] = (u[k : k + 1000] @ u.T >= 0.9995).sum(1) - 1
    got = np.zeros(len(x), int)
    for r in links.where("a is not null and b is null").collect():
        got[r.a] += r.n
    assert (got <= want).all() and got.sum() >= 0.999 * want.sum() and want.sum() >= 80 and (got[:40] > 0).all()


def test_toxicity_held_out(spark):
    rng = random.Random(7)
    rows, labels = [], []
    for i in range(600):
        w = [rng.choice(VOCABULARY) + rng.choice(VOCABULARY) for _ in range(rng.randint(5, 60))]
        bad = i % 6 == 0
        if bad:
            w.insert(rng.randrange(len(w)), rng.choice(["scum", "vilezor", "vilemak", "vilepun"]))
        rows.append((i, " ".join(w), None, "en"))
        labels.append((i, 0 if i % 12 == 0 else 1, int(bad)))
    docs = frame(spark, [*rows, (900, None, None, None), (901, "", None, None), (902, "see vilexyz here", None, None)])
    known = spark.createDataFrame([r for r in labels if r[0] % 4], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.score(docs, toxicity.fit(docs, toxicity.grades_table(known))).collect()}
    held = [i for i in range(600) if i % 4 == 0]
    assert sum(got[i].toxic == (i % 6 == 0) for i in held) / len(held) > 0.97
    assert not got[900].toxic and not got[901].toxic and got[902].toxic
    assert all(0 <= r.severity <= 2 and r.severity >= r.p_toxic - 1e-9 for r in got.values())


def test_cumulative_link_fit_and_scores(spark):
    """The fit is a stationary point of the penalised likelihood, worked out here by plain loops; scores are the model's sums."""
    rng = np.random.default_rng(13)
    rows = [np.flatnonzero(rng.random(6) < 0.4).astype(np.int32) for _ in range(300)]
    true = np.array([2.0, -1.0, 0.5, 0.0, 1.0, -2.0])
    latent = np.array([true[r].sum() for r in rows]) + rng.logistic(size=300)
    grades = np.digitize(latent, [0.0, 1.5])

    def cost(w, cuts):
        out = 0.5e-5 * float(w @ w)
        for r, g in zip(rows, grades):
            p = [1.0, *(1 / (1 + np.exp(-(w[r].sum() - c))) for c in cuts), 0.0]
            out -= np.log(p[g] - p[g + 1]) / len(rows)
        return out

    w, cuts = toxicity.fit_cumulative(rows, grades, 6, steps=3000, rate=0.05)
    assert list(cuts) == sorted(cuts)
    for k in range(6):
        step = np.zeros(6)
        step[k] = 1e-4
        assert abs(cost(w + step, cuts) - cost(w - step, cuts)) / 2e-4 < 2e-3
    for k in range(2):
        step = np.zeros(2)
        step[k] = 1e-4
        assert abs(cost(w, cuts + step) - cost(w, cuts - step)) / 2e-4 < 2e-3

    model = toxicity.Model({"vile*": 1.5, "vilezor": 0.5, "good": -1.0}, [0.25, 1.75])
    texts = ["Vilezor good", "good good", "", None, "vile vilepun VILEPUN", "x " * 5000 + "vilemak"]
    got = {r.doc_id: r for r in toxicity.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()}
    for i, t in enumerate(texts):
        total = sum(sum(model.weights.get(f, 0.0) for f in toxicity.features_of(x)) for x in set(re.findall(r"\w+", (t or "").lower())))
        p = [1 / (1 + np.exp(-(total - c))) for c in model.cuts]
        assert got[i].severity == pytest.approx(sum(p)) and got[i].p_toxic == pytest.approx(p[0]) and got[i].toxic == (p[0] >= 0.5)


def test_without_labels_nothing_is_toxic(spark):
    docs = frame(spark, corpus(8))
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.score(docs, toxicity.fit(docs, toxicity.grades_table(none))).where("toxic").count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 130)]
    part = {i: i for e in edges for i in e}
    for _ in range(100):
        for a, b in edges:
            part[a] = part[b] = min(part[a], part[b])
    got = {r.id: r.component for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: c for i, c in part.items() if any(i in e and e[0] != e[1] for e in edges)}


def test_empty_tables(spark):
    docs = frame(spark, corpus(1)).where("doc_id < 0")
    bench = spark.createDataFrame([], "item_id int, text string")
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    outs = [suffix_tree.dedup_windows(docs), bwt.dedup_strings(docs), minhash.near_duplicates(docs), decontaminate.contamination(docs, bench), pii.extract(docs), pii.redact(docs), mixing.mix(mixing.sized(docs)), hnsw.near_embeddings(vectors)]
    assert all(o.count() == 0 for o in outs)


def test_null_ids(spark):
    docs = frame(spark, [(None, "a b c d e f " * 9, None, None), (1, "a b c d e f " * 9, None, None), (None, "a b c d e f " * 9, None, None)])
    assert {(r.doc_id, r.n_removed) for r in suffix_tree.dedup_windows(docs).collect()} == {(None, 0), (1, 0)}
    assert bwt.dedup_strings(docs).where("doc_id is null and n_removed > 0").count() == 0
    assert [r.kept for r in minhash.near_duplicates(docs).collect()] == [True] * 3
    assert decontaminate.contamination(docs, spark.createDataFrame([(1, "zz")], "item_id int, text string")).count() == 3
    assert pii.extract(docs).count() == 3 and mixing.mix(mixing.sized(docs)).count() == 3


CLASHING = ("n_words", "n_hit", "taken", "toxic", "spans", "component_id", "_key", "_row", "_source", "_spans", "_quality", "_best", "key", "own", "row", "words", "h", "id", "grp", "text_", "copies", "size", "kind", "start", "rep")


def test_clashing_columns(spark):
    docs = frame(spark, corpus(2)).withColumns({c: F.lit(k) for k, c in enumerate(CLASHING)})
    bench = spark.createDataFrame([(1, "zz", 5)], "item_id int, text string, words int")
    n = docs.count()
    assert decontaminate.contamination(docs, bench).count() == n and minhash.near_duplicates(docs).count() == n and pii.extract(docs).count() == n
    assert toxicity.score(docs, toxicity.Model({}, [0.0])).count() == n and mixing.mix(mixing.sized(docs)).count() == n
    assert suffix_tree.dedup_windows(docs).count() == n and bwt.dedup_strings(docs).count() == n
    clean = pii.redact(docs)
    assert clean.columns == docs.columns and clean.where("_key = 6 and spans = 4").count() == n
    mixed = mixing.mix(mixing.sized(docs))
    assert mixed.where("_key = 6 and _row = 7 and _source = 8").count() == n
    P = pytest.importorskip("public_tokenizers")
    assert tokens.count_tokens(docs, P.path(tokens.MODEL)).count() == n
    vectors = spark.createDataFrame([(1, [1.0, 0.0], 1, 2, "x", 3), (2, [1.0, 0.1], 1, 2, "x", 3)], "vec_id long, embedding array<double>, label int, rep int, cls string, links int")
    assert [r.component_id for r in hnsw.near_embeddings(vectors).collect()] == [1, 1]


def test_clashing_columns_of_pages(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "x", 7, "d"), (2, "v", "x", 7, "d")], "page_id long, url string, html string, payload_bytes int, payload_digest string")
    warc.write_archives(pages, f"{tmp_path}/a")
    assert sorted((r.page_id, r.record_type) for r in warc.read_archives(spark, f"{tmp_path}/a").collect()) == [(1, "response"), (2, "revisit")]


def test_empty_tables_of_the_others(spark, tmp_path):
    docs = frame(spark, corpus(1)).where("doc_id < 0")
    warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), f"{tmp_path}/a")
    assert warc.read_archives(spark, f"{tmp_path}/a").count() == 0
    P = pytest.importorskip("public_tokenizers")
    assert tokens.count_tokens(docs, P.path(tokens.MODEL)).count() == 0
    labels = spark.createDataFrame([(1, 1, 1)], "doc_id long, quality int, toxic int")
    assert toxicity.score(docs, toxicity.fit(docs, toxicity.grades_table(labels))).count() == 0


def test_large_pages_go_to_archives_of_their_own(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "LARGE", 100)
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 2500)
    rows = [(i, "u", ("y" if i % 4 else "z" * 1000) + str(i)) for i in range(40)]
    warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), f"{tmp_path}/a")
    back = warc.read_archives(spark, f"{tmp_path}/a")
    assert {r.page_id: bytes(r.payload).decode() for r in back.collect()} == {i: t for i, _, t in rows}
    assert max(p.stat().st_size for p in (tmp_path / "a").glob("part-*")) < 30 * 600 + 2500 and back.select("archive").distinct().count() == 6


def test_salvage_of_a_damaged_member_and_its_log(spark, tmp_path, caplog):
    record = lambda k: f"WARC/1.1\r\nWARC-Type: response\r\nX-Page-Id: {k}\r\nContent-Length: 3000\r\n\r\n".encode() + random.Random(k).randbytes(3000) + b"\r\n\r\n"
    one, two = gzip.compress(b"".join(map(record, range(60)))), gzip.compress(record(99))
    cut = bytearray(one)
    cut[100_000:100_400] = b"\0" * 400
    found = list(warc.salvage(bytes(cut) + two))
    kept = [int(f.headers["x-page-id"]) for f in found if not f.fault]
    assert kept[-1] == 99 and kept[:-1] == list(range(len(kept) - 1)) and 25 < len(kept) < 60
    gaps = [f for f in found if f.fault]
    assert sum(f.end - f.first for f in found) == len(one) + len(two) and gaps
    (tmp_path / "w").mkdir()
    (tmp_path / "w" / "a.warc.gz").write_bytes(bytes(cut) + two)
    got = warc.quarantine(warc.read_archives(spark, f"{tmp_path}/w")).collect()
    assert [(r.first_byte, r.end_byte) for r in got] == [(f.first, f.end) for f in gaps] and "quarantined" in caplog.text


