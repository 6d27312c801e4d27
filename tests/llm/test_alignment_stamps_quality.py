"""Alignment, timestamps and quality rules against plain loops, with nulls, ties, repeated rows, long texts, empty tables and odd columns."""

import hashlib
import random
import re
from collections import Counter
from datetime import UTC, date, datetime, timedelta
from zoneinfo import ZoneInfo

import numpy as np
import pytest
from pyspark.sql import functions as F

from lineflux.llm import alignment, quality, timestamps

tokenizers = pytest.importorskip("public_tokenizers")
A, B = tokenizers.path(alignment.A_MODEL), tokenizers.path(alignment.B_MODEL)


# --- alignment


def odd_texts():
    rng = random.Random(3)
    bits = ["the", "Thtion", " ", "  ", "\n", "\t", " ", "é", "中文", "123", "'s", "don't", "<|endoftext|>", "<s>", "<0x41>", "…", "🙂", " ", "\x85", ".", " ,", "\x1c", "á", "\r\n", "x" * 40]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(1, 60))) for _ in range(250)]
    long = " ".join(rng.choice(["alpha", "beta", "Gamma,", "delta\n", "12 34", "ünï"]) for _ in range(40_000))
    unbroken = "abc,é" * 20_000
    return [*texts, None, "", " ", "   ", "a▁b", "x\0y", "one two", "one two", long, unbroken]


def whole_ids(texts):
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    e = alignment.Encoders(A, B)
    for t in texts:
        x, y = (a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)) if t else ([], [])
        want = (" " + t).encode() if t else b""
        good = bool(t) and b"".join(e.a_bytes[i] for i in x) == want and b"".join(e.b_bytes[i] for i in y) == want
        yield (x, y, [len(e.a_bytes[i]) for i in x], [len(e.b_bytes[i]) for i in y]) if good else None


def plain_alignment(found):
    """Groups and links by a loop over bytes' ends."""
    if found is None:
        return [], []
    a, b, la, lb = found
    groups, links, i, j, ea, eb, g = [], [], 0, 0, la[0], lb[0], ([a[0]], [b[0]])
    links.append((a[0], b[0]))
    while True:
        if ea == eb:
            groups.append(g)
            i, j = i + 1, j + 1
            if i == len(a):
                return groups, links
            g, ea, eb = ([a[i]], [b[j]]), ea + la[i], eb + lb[j]
        elif ea < eb:
            i += 1
            ea += la[i]
            g[0].append(a[i])
        else:
            j += 1
            eb += lb[j]
            g[1].append(b[j])
        links.append((a[i], b[j]))


def test_alignment_equals_plain_loops(spark):
    texts = odd_texts()
    rows = [(i if i % 50 else None, t) for i, t in enumerate(texts)] + [(7, texts[7])]
    plain = [plain_alignment(f) for f in whole_ids([t for _, t in rows])]
    counts = Counter(p for _, links in plain for p in links)
    top = {}
    for (_, b), n in counts.items():
        top[b] = max(top.get(b, 0), n)
    want = Counter()
    for (i, _), (groups, links) in zip(rows, plain):
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        want[i, sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), len(links), sum(counts[p] == top[p[1]] for p in links), sum(counts[p] for p in links), hashlib.sha256(text.encode()).hexdigest() if groups else ""] += 1
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, row_id string").repartition(3)
    got = alignment.aligned(docs, A, B)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert Counter(tuple(r) for r in got.collect()) == want
    assert sum(bool(g) for g, _ in plain) > 200


def test_groups_and_links_are_given_in_order(spark):
    texts = [t for t in odd_texts() if t][-12:]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {}
    for r in alignment.groups_and_links(docs, A, B).orderBy("doc_id", "seq").collect():
        g, x = got.setdefault(r.doc_id, ([], []))
        g.append(r.groups or "")
        x.extend((y.a, y.b) for y in r.links)
    for k, (groups, links) in enumerate(map(plain_alignment, whole_ids(texts))):
        assert "".join(got[k][0]) == ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups) and got[k][1] == links


def test_alignment_of_nothing(spark):
    assert alignment.aligned(spark.createDataFrame([], "doc_id string, text string"), A, B).collect() == []


# --- timestamps

MONTHS = timestamps.MONTHS
DATE = {"dash": r"(?P<y>20\d\d)-(?P<m>\d\d)-(?P<d>\d\d)", "run": r"(?P<y>20\d\d)(?P<m>\d\d)(?P<d>\d\d)", "dot": r"(?P<d>\d\d)\.(?P<m>\d\d)\.(?P<y>20\d\d)", "name": rf"(?P<d>\d\d) (?P<b>{'|'.join(MONTHS)}) (?P<y>20\d\d)", "slash": r"(?P<p>\d\d)/(?P<q>\d\d)/(?P<y>20\d\d)"}
TIME = r"(?:[T ](?P<h>\d\d):(?P<mi>\d\d)(?::(?P<s>\d\d))?(?: ?(?P<ap>[AP]M))?(?: ?(?P<off>Z|[+-]\d\d:?\d\d))?)?"


def plain_dates(raw):
    """Wall times with the day and with the month first, and the offset in seconds or None; None for what is no stamp."""
    t = (raw or "").strip(" \t\n\x0b\x0c\r")
    for kind, pattern in DATE.items():
        m = re.fullmatch(pattern + TIME, t, re.ASCII)
        if not m:
            continue
        g = m.groupdict()
        seconds = 0
        if g["h"]:
            h, mi, s = int(g["h"]), int(g["mi"]), int(g["s"] or 0)
            if mi > 59 or s > 59 or (h > 23 if not g["ap"] else not 1 <= h <= 12):
                return None
            seconds = (h if not g["ap"] else h % 12 + 12 * (g["ap"] == "PM")) * 3600 + mi * 60 + s
        off = None
        if g["off"]:
            off = 0
            if g["off"] != "Z":
                x, y = int(g["off"][1:3]), int(g["off"][-2:])
                if x > 14 or y > 59:
                    return None
                off = (x * 3600 + y * 60) * (-1 if g["off"][0] == "-" else 1)

        def at(m, d):
            try:
                return datetime.combine(date(int(g["y"]), int(m), int(d)), datetime.min.time()) + timedelta(seconds=seconds)
            except ValueError:
                return None

        by_d = at(g["q"], g["p"]) if kind == "slash" else at(MONTHS.index(g["b"]) + 1 if kind == "name" else g["m"], g["d"])
        by_m = at(g["p"], g["q"]) if kind == "slash" else by_d
        return (kind == "slash", by_d, by_m, off) if by_d or by_m else None
    return None


def plain_stamps(rows):
    votes = Counter()
    for _, source, _, raw in rows:
        p = plain_dates(raw)
        if p and p[0] and (p[1] is None) != (p[2] is None):
            votes[source, p[1] is None] += 1
    for i, source, zone, raw in rows:
        t = (raw or "").strip(" \t\n\x0b\x0c\r")
        if re.fullmatch(r"[0-9]{10}|[0-9]{13}", t):
            yield i, int(t) * (1_000_000 if len(t) == 10 else 1000), "epoch", False
            continue
        p = plain_dates(raw)
        if p is None:
            yield i, None, "bad", False
            continue
        rule, wall = "plain", p[1] or p[2]
        if p[0] and p[1] and p[2] and p[1] != p[2]:
            d, m = votes[source, False], votes[source, True]
            rule = "votes" if d != m else "default"
            wall = p[2] if m > d else p[1]
        unsure = rule != "plain"
        if p[3] is not None:
            utc = wall.replace(tzinfo=UTC) - timedelta(seconds=p[3])
        else:
            early, late = (wall.replace(tzinfo=ZoneInfo(zone), fold=f) for f in (0, 1))
            after = late
            if early.utcoffset() != late.utcoffset():
                unsure = True
                # of a skipped time fold 0 has the offset before and fold 1 the one after is the other way round
                gap = (wall - early.utcoffset()).replace(tzinfo=UTC).astimezone(ZoneInfo(zone)).replace(tzinfo=None) != wall
                offset = max(early.utcoffset(), late.utcoffset()) if gap else late.utcoffset()
                utc = (wall - offset).replace(tzinfo=UTC)
            else:
                utc = (wall - after.utcoffset()).replace(tzinfo=UTC)
        yield i, round((utc - datetime(1970, 1, 1, tzinfo=UTC)) / timedelta(microseconds=1)), rule, unsure


def stamps():
    rng = random.Random(5)
    zones = ["UTC", "America/New_York", "Europe/Berlin", "Asia/Kolkata", "Australia/Lord_Howe", "Africa/Casablanca", "Pacific/Apia"]
    two = lambda a, b: f"{rng.randint(a, b):02d}"
    rows = []
    for i in range(4000):
        y, m, d = rng.choice(["2024", "2011", "2098", "2000"]), two(0, 13), two(0, 32)
        day = rng.choice([f"{y}-{m}-{d}", f"{y}{m}{d}", f"{d}.{m}.{y}", f"{d} {rng.choice([*MONTHS, 'jan'])} {y}", f"{d}/{m}/{y}", f"{m}/{d}/{y}"])
        time = rng.choice(["", "", f"{rng.choice('T ')}{two(0, 25)}:{two(0, 61)}" + rng.choice(["", f":{two(0, 61)}"]) + rng.choice(["", "", " AM", "PM", " pm"]) + rng.choice(["", "", "Z", " +05:30", "-0800", "+15:00", "+02:60"])])
        rows.append((i, rng.choice([None, "a", "b", "c", "d"]), rng.choice(zones), rng.choice(["", " ", "\t"]) + day + time + rng.choice(["", "\n", " x"] if rng.random() < 0.1 else [""])))
    fixed = ["1733025832", "1733942329007", "2024010", "", None, "n/a", "2024-03-10 02:30", "2024-11-03 01:30:00", "2024-03-31T02:00", "2024-10-27 02:59:59", "2024-10-27 03:00:00", "2011-12-30 10:00", "05/05/2024", "24:00", "2024-01-01 24:00", "٢٠٢٤-01-01", "2024-02-30", "2024-02-29 ", "1" * 50_000]
    return rows + [(10_000 + 10 * k + j, "f", z, t) for k, t in enumerate(fixed) for j, z in enumerate(zones)] + [rows[1], rows[1], (None, "g", "UTC", "03/04/2024")]


def test_stamps_equal_plain_loops(spark):
    rows = stamps()
    got = timestamps.normalised(spark.createDataFrame([(*r, 1) for r in rows], "stamp_id long, source string, zone string, raw string, rule int").repartition(5))
    assert Counter(tuple(r) for r in got.collect()) == Counter(plain_stamps(rows))


def test_seldom_sources_meet_their_votes_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(timestamps, "HOT_SHARE", 0.24)
    rows = stamps()
    got = timestamps.normalised(spark.createDataFrame(rows, "stamp_id long, source string, zone string, raw string"))
    assert Counter(tuple(r) for r in got.collect()) == Counter(plain_stamps(rows))


def test_stamps_without_a_zone_and_empty(spark):
    kind = "stamp_id long, source string, zone string, raw string"
    rows = [(1, "a", None, "2024-01-01"), (2, "a", "Nowhere/City", "01.02.2024 10:00"), (3, "a", None, "2024-01-01 00:00Z"), (4, "a", None, "1733025832")]
    got = {r.stamp_id: (r.utc_us, r.rule) for r in timestamps.normalised(spark.createDataFrame(rows, kind)).collect()}
    assert got == {1: (None, "bad"), 2: (None, "bad"), 3: (1704067200000000, "plain"), 4: (1733025832000000, "epoch")}
    assert timestamps.normalised(spark.createDataFrame([], kind)).collect() == []


def test_intervals_tile_the_timeline():
    for zone in ("Europe/Berlin", "Africa/Casablanca", "UTC"):
        rows = timestamps.intervals_of(zone)
        assert all(a[2] == b[1] for a, b in zip(rows, rows[1:])) and all(r[1] < r[2] for r in rows)
    assert [r[4] - r[3] for r in timestamps.intervals_of("Europe/Berlin") if r[3] != r[4]][:2] == [3600, -3600]


# --- quality


def plain_quality(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    seen = Counter(windows)
    covered = {k + j for k, w in enumerate(windows) if seen[w] > 1 for j in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_quality_measures_equal_plain_loops(spark):
    rng = random.Random(9)
    bits = ["the", "of", "a", "b", "c", "É", "#$", "|", "中", "9", "x y"]
    texts = ["".join(rng.choice(bits) + rng.choice([" ", "  ", "\n", "\t", "\x0b"]) for _ in range(rng.randint(0, 90))) for _ in range(120)]
    texts += [None, "", " ", "a", "a b", "a b c", "a b c a b c", "a a a a", "\n\n", "x\nx\nx ", "\x1cq", "no " * 300, " ".join(f"w{k}" for k in range(100_000))]
    docs = spark.createDataFrame([(i, t, rng.choice(["en", None]), 1) for i, t in enumerate(texts)] + [(3, texts[3], "en", 2)], "doc_id long, text string, lang string, n_words int")
    got = quality.judged(docs).collect()
    assert len(got) == len(texts) + 1
    for r in got:
        n, chars, symbols, lines, repeated = plain_quality(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, lines, repeated), texts[r.doc_id]
        assert r.base_failed == (n < 50 or 100 * repeated > 50 * n) and not (r.kept and r.base_failed)
    assert quality.judged(docs.limit(0)).collect() == []


def test_divergent_documents_are_rejected(spark):
    rng = random.Random(1)
    common = ["the", "of", "and", "to", "in", "is", "on", "as", "at", "by"]
    word = lambda: "".join(rng.choice("aeiourst") for _ in range(rng.randint(6, 10)))
    prose = lambda n: " ".join(rng.choice(common) if rng.random() < 0.4 else word() for _ in range(n))
    rows = [(i, prose(rng.randint(60, 400)), "en") for i in range(200)]
    rows += [(1000 + i, " ".join(word() + "$$$" for _ in range(150)), "en") for i in range(8)]  # odd characters
    rows += [(2000 + i, " ".join(word() for _ in range(150)), "en") for i in range(8)]  # no common words
    rows += [(3000 + i, " ".join(word() for _ in range(60)), "en") for i in range(8)]  # too short to be judged by words
    rows += [(4000 + i, " ".join(word() + "$$$" for _ in range(150)), "xx") for i in range(8)]  # a language without a reference
    got = {r.doc_id: r for r in quality.judged(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(r.kept == (not 1000 <= i < 3000) for i, r in got.items())
    assert all(got[i].word_distance is None and got[i].class_distance is not None for i in range(3000, 3008)) and all(got[i].class_distance is None for i in range(4000, 4008))


def test_long_words_are_common_too(spark):
    long = ["zwischen", "gegenüber", "donaudampfschifffahrt", "immer", "etwas"]
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(4))
    rows = [(i, " ".join(rng.sample([*long * 9, *(word() for _ in range(60 + i))], 105 + i)), "xx") for i in range(30)]
    rows += [(100, "seldom seldom seldom " * 60, "xx"), (101, " ".join(word() for _ in range(300)), "xx"), (102, None, "xx")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    common = quality.common_words(docs).collect()
    holds = Counter(w for _, t, _ in rows for w in set((t or "").split()))
    want = sorted(holds, key=lambda w: (-holds[w], w))[: quality.COMMON]
    assert [r.common for r in common] == [want] and set(long) == set(want[:5])
    got = {r.doc_id: list(r.words) for r in quality.features(docs, spark.createDataFrame(common, "lang string, common array<string>, longest int")).collect()}
    assert got == {i: [(t or "").split().count(w) for w in want] for i, t, _ in rows}
    judged = {r.doc_id: r for r in quality.judged(docs).collect()}
    assert all(judged[i].kept for i in range(30)) and not judged[101].kept and judged[101].word_distance >= quality.MOST_COMMON


def test_distance_is_the_jensen_shannon_distance(spark):
    import math

    p, q = [500_000, 250_000, 250_000, 0], [0, 250_000, 500_000, 250_000]
    kl = lambda x, y: sum(a * math.log2(a / b) for a, b in zip(x, y) if a)
    x, y = [a / 1e6 for a in p], [a / 1e6 for a in q]
    m = [(a + b) / 2 for a, b in zip(x, y)]
    got = spark.createDataFrame([(p, q)], "p array<long>, q array<long>").select(quality.distance(F.col("p"), F.col("q")).alias("d"), quality.distance(F.col("p"), F.col("p")).alias("z")).first()
    assert got.d == pytest.approx(math.sqrt((kl(x, m) + kl(y, m)) / 2)) and got.z == 0


def test_counts_of_pairs_go_back_to_their_parts_without_joining_them(spark):
    counts = spark.createDataFrame([(p, pair, 2) for p in range(40) for pair in (5, 6 << 16 | 5, p << 16 | 9)] + [(0, 5, 1)], "part int, pair long, n long")
    rows = spark.createDataFrame([(p, 100 + p, np.array([5, 6 << 16 | 5, p << 16 | 9], np.uint32).tobytes()) for p in range(40)], "part int, row_id long, pairs binary")
    got = alignment.scored(rows, counts)
    assert {tuple(r) for r in got.collect()} == {(100 + p, 2, 81 + 80 + 2) for p in range(40)}
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1  # with the best of each B id, a broadcast row each
