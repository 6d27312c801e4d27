"""The pipeline's stages on a small corpus, each against what its own input calls for."""

import importlib

import pytest

VOCABULARY = ["ab", "c", "de", "x9", "the", "of", "zz", "q"]


def words(rng, k):
    return [rng.choice(VOCABULARY) + rng.choice(VOCABULARY) + rng.choice(VOCABULARY) for _ in range(k)]


def test_stages(spark, tmp_path):
    import random

    pipeline = importlib.import_module("corpus_pipeline")
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(300):
        w = words(rng, 60)
        if i % 5 == 0:
            w.insert(3, "scum")
        labels.append((i, 1, int(i % 5 == 0)))
        rows.append((i, " ".join(w), "en", f"s{i % 3}", 0))
    item = words(rng, 30)
    copy = rows[1][1]
    rows += [(301, copy, "en", "s0", 0), (302, copy + " more", "en", "s1", 0), (303, " ".join(item + words(rng, 30)), "en", "s2", 0), (304, "mail ann.lee@example.org " + " ".join(words(rng, 30)), "en", None, 0), (305, None, "en", "s0", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, " ".join(item))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, ids = spark.read.parquet(f"{tmp_path}/documents.parquet"), set(range(300)) | {301, 302, 303, 304, 305}
    columns = docs.columns
    assert [n for n, _ in pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "personal_data", "mixing"]
    gone = [set(range(0, 300, 5)), {301, 302}, {303}, set()]
    for (name, stage), g in zip(pipeline.STAGES[:4], gone):
        out = f"{tmp_path}/{name}"
        stage(spark, docs, str(tmp_path)).write.parquet(out)
        docs = spark.read.parquet(out)
        ids -= g
        assert docs.columns == columns and {r.doc_id for r in docs.collect()} == ids, name
    assert docs.where("doc_id = 304").head().text.startswith("mail [EMAIL] ")
    mixed = pipeline.STAGES[4][1](spark, docs, str(tmp_path)).collect()
    assert {r.doc_id for r in mixed} <= ids and all(r.taken == r.copies * r.size and 1 <= r.copies <= 3 for r in mixed)
    assert pipeline.run(spark, str(tmp_path)).count() == len(mixed)


def test_mixing_returns_the_texts(spark, tmp_path):
    rows = [(i // 2, f"text {i} " + "word " * (i % 7), "en", f"s{i % 3}", i) for i in range(60)] + [(None, "no id", "en", None, 60), (99, None, "en", "s0", 61)]
    spark.createDataFrame([(i, i % 2, 0) for i in range(0, 30, 3)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    stage = importlib.import_module("corpus_pipeline").STAGES[4][1]
    mixed = stage(spark, docs, str(tmp_path))
    assert mixed.columns == [*docs.columns, "size", "source_size", "target", "taken", "copies"]
    by_row, got = {r[4]: r for r in rows}, mixed.collect()
    assert len({r.n_chars for r in got}) == len(got) > 20  # equal ids stay apart
    assert all(tuple(r)[:5] == by_row[r.n_chars] and r.size == len(r.text.split()) and r.taken == r.copies * r.size for r in got)


CLASHING = ("toxic", "severity", "p_toxic", "gone_id", "bad_id", "bad_hash", "hash", "spans", "_spans", "_key", "row", "own", "size_", "labelled", "best", "_quality", "kind", "clean", "id", "h", "n_words", "contaminated", "component_id")


def odd(spark, tmp_path, rows):
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} int" for c in CLASHING)
    docs = spark.createDataFrame([(*r, *range(len(CLASHING))) for r in rows], schema)
    spark.createDataFrame([(1, 1, 1), (2, 0, 0), (3, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return docs


@pytest.mark.parametrize("rows", [[], [(None, None, None, None, None), (1, None, "en", "s", 0), (2, "", "en", None, 0), (3, "mail a@b.org now", "en", "s", 16), (3, "mail a@b.org now", "en", "s", 16), (None, "no id here", None, "t", 10), (4, "word " * 30_000, "en", "t", 150_000)]])
def test_every_stage_with_odd_rows_and_clashing_columns(spark, tmp_path, rows):
    docs = odd(spark, tmp_path, rows)
    stages = importlib.import_module("corpus_pipeline").STAGES
    columns = docs.columns
    for name, stage in stages[:4]:
        out = f"{tmp_path}/{name}"
        stage(spark, docs, str(tmp_path)).write.parquet(out)
        docs = spark.read.parquet(out)
        assert docs.columns == columns and docs.count() == len(rows), name
        assert all(tuple(r)[5:] == tuple(range(len(CLASHING))) for r in docs.collect()), name
    texts = [(r.text, r.n_chars) for r in docs.where("doc_id = 3").collect()]
    assert texts == [("mail [EMAIL] now", 16)] * (2 if rows else 0) and len("mail [EMAIL] now") == 16
    mixed = stages[4][1](spark, docs, str(tmp_path))
    assert mixed.columns == [*columns, "size", "source_size", "target", "taken", "copies"]
    assert mixed.where("size = 0").count() == 0 and mixed.count() == len(mixed.collect())


def test_whole_run_against_brute_force(spark, tmp_path):
    """Every stage worked out again by plain loops on what run() starts from."""
    import random
    import re

    from tests_llm_helpers import plain_spans

    rng = random.Random(9)
    item = words(rng, 26)
    rows, labels = [], []
    for i in range(240):
        w = words(rng, rng.randint(20, 60))
        if i % 6 == 0:
            w.insert(4, "scumbag")
        if i % 7 == 1:
            w[5:5] = [f"kim{i}@mail{i % 3}.org", "and", "+49 30 " + str(1234567 + i)]
        if i % 20 == 3:
            w[2:2] = item[:14]
        labels.append((i, i % 2, int(i % 6 == 0)))
        rows.append((i, " ".join(w), "en", f"s{i % 3}"))
    rows += [(300 + k, rows[k][1] + " tail", "de", "s1") for k in (1, 2, 4, 5)] + [(400, rows[7][1], "de", None), (401, "", "de", None), (402, None, "de", None)]
    spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, " ".join(item))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    left = [r for r in rows if "scumbag" not in (r[1] or "")]
    sets = {r[0]: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := (r[1] or "").lower().split()) else set() for r in left}
    part = {i: i for i in sets}
    for _ in range(5):
        for a in sets:
            for b in sets:
                if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    part[a] = part[b] = min(part[a], part[b])
    left = [r for r in left if part[r[0]] == r[0]]
    plain = lambda t: re.findall(r"[0-9a-z]+", (t or "").lower())
    windows = {tuple(plain(" ".join(item))[k : k + 13]) for k in range(14)}

    def contaminated(t):
        w = plain(t)
        hit = {k + j for k in range(len(w) - 12) if tuple(w[k : k + 13]) in windows for j in range(13)}
        return bool(hit) and 20 * len(hit) >= len(w)

    assert any(contaminated(r[1]) for r in left)
    left = [r for r in left if not contaminated(r[1])]
    want = {}
    for i, t, _, source in left:
        for kind, a, b in sorted(plain_spans(t or ""), key=lambda s: -s[1]):
            t = t[:a] + f"[{kind.upper()}]" + t[b:]
        want[i] = (t, source)
    got = importlib.import_module("corpus_pipeline").run(spark, str(tmp_path)).collect()
    assert len(got) == len({r.doc_id for r in got}) and {r.doc_id for r in got} <= {i for i, (t, _) in want.items() if t}
    sizes, taken = {}, {}
    for i, (t, source) in want.items():
        sizes[source] = sizes.get(source, 0) + len((t or "").split())
    for r in got:
        assert (r.text, r.source) == want[r.doc_id] and r.n_chars == len(r.text) and r.size == len(r.text.split()) and r.taken == r.copies * r.size and 1 <= r.copies <= 3
        assert r.source_size == sizes[r.source]
        taken[r.source] = taken.get(r.source, 0) + r.taken
    goals = {r.source: r.target for r in got}
    assert all(abs(taken[s] - goals[s]) <= 45 for s in goals) and sum(goals.values()) == pytest.approx(sum(sizes.values()))


def test_entry_has_the_queries():
    entry = importlib.import_module("__spark_entry__")
    names = entry.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
    assert set(entry.oracle_sql()) <= set(names)
    pytest.importorskip("duckdb")
