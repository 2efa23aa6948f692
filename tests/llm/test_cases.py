"""Each operator on nulls, repeated rows, ties, empty tables and clashing names, and against plain models of its parts."""

import collections
import itertools
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerline.llm import decontaminate, jaccard_join, language_id, license_scan, mixing, prefix_forest, secret_scan, substring_dedup, token_counts, toxicity

NAMES = ("node", "spans", "cuts", "rid", "_row", "_doc", "_mark", "key", "n", "item_ids", "a.b", "n_removed", "passes", "comp", "first")
KIND = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"`{n}` string" for n in NAMES)


def words(n, seed):
    rng = np.random.default_rng(seed)
    return ["".join(chr(97 + c) for c in rng.integers(0, 26, 6)) for _ in range(n)]


BASE = words(60, 1)
SECRET = "key Zx9Qw3Lp0Vt7Rk2Mn5Bc8Yd1Hj4 end"
ITEM = "If Alice drives 120 miles in 3 hours from the old harbour to the city, how many miles does Alice drive in 5 hours?"
ROWS = [
    (1, " ".join(BASE)), (None, " ".join([*BASE[:30], "one", *BASE[31:]])), (2, " ".join([*BASE[:30], "one", *BASE[31:45], "two", *BASE[46:]])),
    (None, " ".join(words(40, 7))), (None, " ".join(words(40, 7))), (3, " ".join(words(40, 8))), (3, " ".join(words(40, 8))), (3, " ".join(words(40, 9))),
    (4, None), (4, None), (None, None), (5, ""), (6, "  \n "), (None, ""), (7, SECRET), (7, SECRET), (None, "other " + SECRET), (8, "Some. " + ITEM), (None, "Well. " + ITEM),
    (9, " ".join(words(30_000, 11))),
]


def docs(spark, rows=ROWS):
    return spark.createDataFrame([(i, t, "en" if k % 3 else None, "s" if k % 2 else None, k, *["clash"] * len(NAMES)) for k, (i, t) in enumerate(rows)], KIND)


def bench(spark):
    return spark.createDataFrame([(1, ITEM), (1, "Another question of the same id about seventeen small boats"), (None, "A question without any id asks for five green stones"), (2, "1 2 3 4 5 6 7 8 9 10 11 12"), (3, None), (4, "")], "item_id bigint, text string")


def test_links_through_rows_without_an_id(spark):
    got = jaccard_join.jaccard_components(docs(spark)).collect()
    assert len(got) == len(ROWS)
    count = collections.Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got)
    assert count[(1, 56, 1)] == count[(None, 56, 1)] == count[(2, 56, 1)] == 1
    assert count[(None, 36, None)] == 2 and count[(3, 36, 3)] == 3 and count[(4, 0, 4)] == 2 and count[(None, 0, None)] == 2


def test_one_document_of_each_group_stays(spark):
    got = jaccard_join.one_per_component(docs(spark))
    assert got.columns == docs(spark).columns
    kept = collections.Counter((r["doc_id"], (r["text"] or "")[:40]) for r in got.collect())
    assert kept[(1, " ".join(BASE)[:40])] == 1 and (2, " ".join(BASE)[:40]) not in kept and sum(n for (i, t), n in kept.items() if t == " ".join(BASE)[:40]) == 1
    assert kept[(None, " ".join(words(40, 7))[:40])] == 1 and kept[(3, " ".join(words(40, 8))[:40])] == 2
    assert kept[(4, "")] == 2 and kept[(None, "")] == 2 and kept[(5, "")] == 1
    assert jaccard_join.one_per_component(docs(spark).limit(0)).count() == 0


def test_fit_lengths_against_brute_force():
    rng = np.random.default_rng(3)
    cases = [([100_000], [1], 60_000), ([100_000], [1], 40_000), ([45_000, 1], [1, 3], 44_000), ([7], [3], 10), ([0, 5], [4, 2], 6), ([20_000, 100_000, 99_999], [1, 2, 1], 130_000)]
    for _ in range(150):
        lengths = sorted(set(rng.integers(1, 60, rng.integers(1, 5)).tolist()))
        counts = rng.integers(1, 5, len(lengths)).tolist()
        cases.append((lengths, counts, int(rng.integers(0, 1 + sum(a * c for a, c in zip(lengths, counts))))))
    for lengths, counts, budget in cases:
        sums = {sum(a * t for a, t in zip(lengths, taken)) for taken in itertools.product(*[range(c + 1) for c in counts])}
        got = mixing.fit_lengths(lengths, counts, budget)
        assert all(0 <= t <= c for t, c in zip(got, counts))
        assert abs(sum(a * t for a, t in zip(lengths, got)) - budget) == min(abs(s - budget) for s in sums), (lengths, counts, budget)


def test_fit_lengths_of_many_documents_and_long_ones():
    lengths, counts = [*range(50, 400), 100_000, 1_000_000], [40] * 350 + [3, 1]
    total = sum(a * c for a, c in zip(lengths, counts))
    for budget in (total // 3, total // 2 + 17, total - 5):
        got = mixing.fit_lengths(lengths, counts, budget)
        assert all(0 <= t <= c for t, c in zip(got, counts)) and abs(sum(a * t for a, t in zip(lengths, got)) - budget) <= 50


def test_mixing_of_odd_rows(spark):
    got = mixing.mix_sources(docs(spark)).collect()
    size, taken = collections.Counter(), collections.Counter()
    for r in got:
        size[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        assert r["taken"] <= 2 * r["size"]
        target = {r["source"]: r["target"] for r in got}
    assert len(got) == len(ROWS) and size == {s: sum(len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for k, (_, t) in enumerate(ROWS) if (k % 2 == 1) == (s == "s")) for s in (None, "s")}
    sums = {s: {sum(c) for c in itertools.chain([()], *[itertools.combinations([r["size"] for r in got if r["source"] == s], n) for n in range(1, 6)])} for s in size}
    for s in size:
        assert abs(taken[s] - target[s]) <= min(abs(x - target[s] % size[s]) for x in sums[s]) or target[s] >= 2 * size[s]


def test_substring_dedup_of_odd_rows(spark):
    passage = ". ".join(" ".join(words(12, 60 + i)) for i in range(6)) + "."
    rows = [*ROWS, (20, passage), (21, "Before it. " + passage), (21, "Before it. " + passage), (None, passage)]
    got = substring_dedup.remove_repeats(docs(spark, rows))
    assert got.columns == [*[c for c in docs(spark).columns if c != "n_removed"], "n_sentences", "n_removed", "words_removed"]
    by = collections.defaultdict(list)
    for r in got.collect():
        by[r["doc_id"]].append(r)
    assert by[20][0]["n_removed"] == 0 and [r["words_removed"] for r in by[21]] == [72, 72] and all(r["n_removed"] == 0 for r in by[None])
    assert sorted(by[4], key=str)[0]["text"] is None and by[5][0]["text"] == "" and len(by[3]) == 3
    assert substring_dedup.remove_repeats(docs(spark).limit(0)).count() == 0


def test_license_scan_of_odd_rows(spark):
    got = license_scan.scan_licenses(docs(spark)).collect()
    assert len(got) == len(ROWS) and sorted(r["n_words"] for r in got if r["doc_id"] == 4) == [0, 0]
    assert license_scan.scan_licenses(docs(spark).limit(0)).count() == 0


def test_letters_are_letters():
    assert all(language_id.letters(t) is None for t in (None, "", "123 ½ ² ① – 😀", "\u2014"))
    assert "".join(map(chr, language_id.letters("A–É😀b½c"))) == "a é b c"


def test_the_folded_matrix_is_the_kernel_regression():
    rng = np.random.default_rng(5)
    samples = [np.sort(rng.choice(language_id.WIDTH, 60, replace=False)) for _ in range(40)]
    langs = ["a" if i % 3 else "b" for i in range(40)]
    model = language_id.fit(samples, langs, 40, 1e-2)
    x = np.stack([language_id.unit(s) for s in samples]).astype(float)
    y = np.array([[1.0 if v == n else -1.0 for n in ("a", "b")] for v in langs])
    weigh = np.array([40 / 2 / langs.count(v) for v in langs])
    bias = (weigh[:, None] * y).mean(axis=0)
    # With all samples as landmarks, Nystroem's ridge regression is plain kernel ridge regression.
    alpha = np.linalg.solve(x @ x.T + 1e-2 * 40 * np.diag(1 / weigh), y - bias)
    assert np.abs(x @ x.T @ alpha + bias - (x @ model.weights + model.bias)).max() < 1e-3


def test_language_id_of_odd_rows(spark):
    model = language_id.train(docs(spark))
    got = language_id.identify(docs(spark), model)
    assert got.count() == len(ROWS) and {r["lang_pred"] for r in got.collect()} <= {"en", "und"}
    kept = language_id.keep_identified(docs(spark), model)
    assert kept.columns == docs(spark).columns and kept.count() == sum(bool((t or "").strip()) for _, t in ROWS)
    assert language_id.keep_identified(docs(spark), None).count() == 0 and language_id.identify(docs(spark).limit(0), model).count() == 0


def test_decontamination_of_odd_rows(spark):
    rows = [*ROWS, (30, " ".join(map(str, range(100)))), (31, "X. A question without any id asks for nine green stones now"), (32, "Another question of the same id about seventeen small boats")]
    got = collections.defaultdict(list)
    for r in decontaminate.contaminated(docs(spark, rows), bench(spark)).collect():
        got[r["doc_id"]].append(r)
    assert got[8][0]["item_ids"] == [1] and not got[30][0]["contaminated"] and got[31][0]["contaminated"] and got[31][0]["item_ids"] == [] and got[32][0]["item_ids"] == [1]
    assert sorted(r["contaminated"] for r in got[None]) == [False] * 6 + [True] and not any(r["contaminated"] for i in (1, 3, 4, 5, 7, 9) for r in got[i])
    kept = decontaminate.drop_contaminated(docs(spark, rows), bench(spark))
    assert kept.columns == docs(spark).columns and kept.count() == len(rows) - 4
    assert decontaminate.drop_contaminated(docs(spark, rows), bench(spark).limit(0)).count() == len(rows)
    assert decontaminate.contaminated(docs(spark).limit(0), bench(spark)).count() == 0


def test_decontamination_judges_each_place_by_itself(spark):
    item = "What is 7 plus 5 times the price of the red boat in the old harbour of the town today and then 7 more?"
    mixed = item.replace("What is 7", "What is 3").replace("then 7", "then 4")
    stray = "so the price of the red boat in the old harbour of the town was right"
    texts = [(1, mixed), (2, mixed + " " + stray), (3, mixed + " " + item.replace("7", "8")), (4, item.replace("red boat", "red and large boat"))]
    got = {r["doc_id"]: r["contaminated"] for r in decontaminate.contaminated(docs(spark, texts), spark.createDataFrame([(1, item)], "item_id bigint, text string")).collect()}
    assert got == {1: False, 2: False, 3: True, 4: True}


def test_neighbours_of_repeated_rows(spark):
    rng = np.random.default_rng(6)
    x = [[float(v) for v in rng.standard_normal(8)] for _ in range(60)]
    rows = [(i + 1, x[i]) for i in range(59)] + [(100, x[59]), (100, x[59]), (200, x[59]), (200, x[0]), (300, None), (None, x[3])]
    got = collections.defaultdict(list)
    for r in prefix_forest.nearest(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect():
        got[(r["query_id"], r["rank"])].append((r["vec_id"], r["score"]))
    assert set(got) == {(q, k) for q in (100, 200) for k in range(1, 11)} and all(len(v) == 2 for v in got.values())
    assert got[(100, 1)] == [(100, 0.0)] * 2 and got[(100, 2)] == [(200, 0.0)] * 2 and sorted(got[(200, 1)]) == [(1, 0.0), (100, 0.0)]
    assert prefix_forest.nearest(spark.createDataFrame([], "vec_id bigint, embedding array<double>")).count() == 0


def test_recall_at_the_shipped_share(spark):
    rng = np.random.default_rng(16)
    x = rng.standard_normal((3000, 32))
    got = prefix_forest.nearest(spark.createDataFrame([(i, [float(v) for v in x[i]]) for i in range(3000)], "vec_id bigint, embedding array<double>")).collect()
    hits = sum(r["vec_id"] in np.argsort(((x - x[r["query_id"]]) ** 2).sum(axis=1))[1:11] for r in got)
    assert len(got) == 300 and hits >= 270


def test_label_model_finds_the_classes_from_votes_alone():
    rng = np.random.default_rng(9)
    y = (rng.random(2000) < 0.15).astype(int)
    rates = [(0.5, 0.01), (0.4, 0.02), (0.3, 0.005), (0.45, 0.01), (0.35, 0.01)]
    votes = np.stack([np.where(y == 1, rng.random(2000) < a, rng.random(2000) < b) for a, b in rates], axis=1).astype(float)
    votes = np.hstack([votes, votes[:, :1], votes[:, :1]])  # copies of one voter
    start = np.clip(np.where(rng.random(2000) < 0.1, 1 - y, y), 0.05, 0.95)  # every tenth label is wrong
    post = toxicity.label_model(votes, start)
    told = votes.any(axis=1)
    assert (post[told & (y == 1)] > 0.3).mean() > 0.95 and (post[y == 0] > 0.3).mean() < 0.08 and post[~votes.any(axis=1)].max() < 0.3


def test_toxicity_of_odd_rows(spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 10)] + [(None, 1), (3, 0), (4, None), (5, 7)], "doc_id bigint, toxic int")
    model = toxicity.train(docs(spark), labels)
    got = toxicity.score_toxicity(docs(spark), model).collect()
    assert len(got) == len(ROWS) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    assert toxicity.train(docs(spark).limit(0), labels) is None and {r["score"] for r in toxicity.score_toxicity(docs(spark), None).collect()} == {0.0}


def test_battery_against_plain_formulas(spark):
    rng = np.random.default_rng(12)
    tokens = ["".join(rng.choice(list(secret_scan.ALPHABETS[k]), n)) for k in ("hex", "alnum", "base64", "lower36") for n in (20, 33, 64)] + ["get_some_long_identifier_name", "a" * 30]
    got = {r["t"]: r["b"] for r in spark.createDataFrame([(t,) for t in tokens], "t string").select("t", secret_scan.battery(F.col("t")).alias("b")).collect()}
    for t in tokens:
        kind = next((k for k, v in secret_scan.ENCODINGS.items() if re.match(v, t)), "base64")
        alphabet, n = secret_scan.ALPHABETS[kind], len(t)
        sigma = 64 if kind == "base64" else len(alphabet)
        chi = sigma / n * sum(c * c for c in collections.Counter(t).values()) - n
        at = [alphabet.index(c) for c in t]
        high = [a >= len(alphabet) / 2 for a in at]
        n1 = sum(high)
        mean_runs = 2 * n1 * (n - n1) / n + 1
        z_runs = (1 + sum(a != b for a, b in zip(high, high[1:])) - mean_runs) / math.sqrt(max((mean_runs - 1) * (mean_runs - 2) / (n - 1), 0.25))
        m = sum(at) / n
        spread = sum((a - m) ** 2 for a in at)
        z_serial = sum((a - m) * (b - m) for a, b in zip(at, at[1:])) / spread * math.sqrt(n) if spread else math.sqrt(n)
        joint = max((chi - sigma + 1) / math.sqrt(2 * (sigma - 1)), 0) ** 2 + z_runs**2 + z_serial**2
        z = ((joint / 3) ** (1 / 3) - (1 - 2 / 27)) / math.sqrt(2 / 27)
        assert got[t]["encoding"] == kind and got[t]["uniform_p"] == pytest.approx(1 / (1 + math.exp(min(700, 1.5976 * z + 0.070565 * z**3))), rel=1e-6, abs=1e-300)


def test_discovery_limit_against_the_procedure():
    rng = np.random.default_rng(13)
    for share in (0.0, 0.1, 0.9):
        bins = [int(b) for b in np.where(rng.random(400) < share, rng.integers(20, 60, 400), -np.log10(rng.random(400)) * secret_scan.BIN)]
        limit = secret_scan.discovery_limit(collections.Counter(bins), 0.01)
        ranked = sorted(bins, reverse=True)
        most = max((k for k, b in enumerate(ranked, 1) if 10 ** (-b / secret_scan.BIN) <= 0.01 * k / len(bins)), default=0)
        assert sum(b >= limit for b in bins) == most


def test_secret_scan_of_odd_rows(spark):
    got = secret_scan.scan_secrets(docs(spark)).collect()
    assert len(got) == len(ROWS) and collections.Counter(len(r["spans"]) for r in got if r["doc_id"] == 7) == {1: 2}
    kept = secret_scan.redact(docs(spark))
    assert kept.columns == docs(spark).columns
    assert collections.Counter(r["text"] for r in kept.collect()) == collections.Counter((t or "").replace(SECRET, "key [secret] end") if t is not None else None for _, t in ROWS)
    assert secret_scan.redact(docs(spark).limit(0)).count() == 0 and secret_scan.scan_secrets(docs(spark).limit(0)).count() == 0


def test_a_text_of_very_many_spans(spark):
    text = " ".join(f"token={i:016x}" for i in range(20_000))
    got = secret_scan.scan_secrets(docs(spark, [(1, text)])).collect()[0]
    assert got["n_assign"] == got["n_hex"] == 20_000


def test_token_counts_of_odd_rows(spark):
    public = pytest.importorskip("public_tokenizers")
    got = token_counts.count_tokens(docs(spark), public.path("byte_bpe_50k.json"))
    assert got.count() == len(ROWS) and token_counts.count_tokens(docs(spark).limit(0), public.path("byte_bpe_50k.json")).count() == 0
    with pytest.raises(ValueError):
        token_counts.supported({"model": {"type": "BPE"}, "pre_tokenizer": {"type": "Whitespace"}})


def test_stages_keep_the_columns_and_the_right_rows(spark, tmp_path):
    table = docs(spark).drop("n_removed")
    table.coalesce(2).write.parquet(f"{tmp_path}/documents.parquet")
    bench(spark).write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, rows, str(tmp_path)).columns == rows.columns, name
        assert stage(spark, rows.limit(0), str(tmp_path)).count() == 0
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(got) == {1, 3, 7, 9, None}
