"""The corpus pipeline, stage by stage, against plain versions on a small corpus with every odd case."""

import math
import random
from collections import Counter

import pytest
from test_operators import WORD, lower, plain_pii, shingles

import corpus_pipeline as P
from lexspan.llm import toxicity

R = random.Random(23)
WORDS = [f"w{i}" for i in range(400)]
BAD = ["scum", "idiot", "trash", "moron"]
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def words(n):
    return " ".join(R.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    passage, base = words(14), words(90)
    texts = [words(40) + (" " + " ".join(R.choice(BAD) for _ in range(3 + i % 4)) if i % 4 == 0 else "") for i in range(240)]
    texts += [base, base, base + " tail", base.replace(" w", "  W", 3)]
    texts += [words(9) + " " + passage + " " + words(9), passage, words(5) + " the short item " + words(20), " ".join(passage.split()[:9])]
    texts += [words(12) + " mail ann.b@x-y.org or +1 (555) 123-4567 " + words(12), "1.2.3.4", None, "", " \n ", "one", words(5000)]
    rows = [(i, t, "en", "hot" if i % 3 else "cold", len(t or "")) for i, t in enumerate(texts)]
    rows += [(None, words(30), None, None, None), rows[7], (900, None, None, None, None)]
    at = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{at}/documents.parquet")
    labels = [(i, int(i % 5 > 0), int(i % 4 == 0)) for i in range(0, 240, 2)] + [(1, 1, 0), (3, 0, 0), (None, 1, 1), (5, None, None)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, passage + " " + words(3)), (2, "The SHORT item"), (3, None), (4, "")], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at


def listed(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=repr)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    before = listed(docs)
    assert [n for n, _ in P.STAGES] == ["toxicity", "near_duplicates", "decontamination", "pii", "mixing"]
    for name, stage in P.STAGES:
        out = P.stored(stage(spark, docs, folder), f"test-{name}")
        if name != "mixing":
            assert out.columns == COLUMNS
        after = listed(out)
        if name == "toxicity":
            model = toxicity.fit_toxicity(docs, spark.read.parquet(f"{folder}/labels.parquet"))
            bad = {r["doc_id"] for r in toxicity.score_toxicity(docs, model).where("toxic").collect()}
            assert after == [r for r in before if r[0] not in bad]
            assert len(bad ^ set(range(0, 240, 4))) <= 4
        elif name == "near_duplicates":
            sets = {r[0]: shingles(r[1], 5) for r in before if r[0] is not None}
            root = {i: i for i in sets}
            for a in sets:
                for b in sets:
                    n = len(sets[a] & sets[b])
                    if a < b and n and 100 * n >= 80 * len(sets[a] | sets[b]):
                        lo, hi = sorted((root[a], root[b]))
                        root = {k: lo if v == hi else v for k, v in root.items()}
            assert after == [r for r in before if r[0] is None or root[r[0]] == r[0]]
            assert len(after) < len(before)
        elif name == "decontamination":
            windows = set()
            for (t,) in spark.read.parquet(f"{folder}/benchmark.parquet").select("text").collect():
                w = WORD.findall(lower(t))
                windows |= {tuple(w[j : j + 10]) for j in range(max(1, len(w) - 9))} if w else set()

            def leaks(t, windows=windows):
                w = WORD.findall(lower(t))
                return any(tuple(w[j : j + n]) in windows for n in {len(x) for x in windows} for j in range(len(w) - n + 1))

            assert after == [r for r in before if r[0] is None or not leaks(r[1])]
            assert len(before) - len(after) == 3
        elif name == "pii":
            was = {repr(r[0]) + repr(r[2:4]): r for r in before}
            assert len(after) == len(before) and not any(plain_pii(r[1]) for r in after)
            for r in after:
                old = was[repr(r[0]) + repr(r[2:4])]
                assert (r == old) if not plain_pii(old[1]) else (r[1] != old[1] and r[4] == len(r[1]))
            assert sum("[EMAIL]" in (r[1] or "") and "[PHONE]" in r[1] for r in after) == 1
        else:
            assert out.columns == [*COLUMNS, "n_tokens", "rate", "copy"]
            copies = Counter(tuple(r[c] for c in COLUMNS) for r in out.collect())
            rate = {tuple(r[c] for c in COLUMNS): r["rate"] for r in out.collect()}
            times = Counter(before)
            assert set(copies) <= set(before) and all(n in (times[k] * math.floor(rate[k]), times[k] * math.ceil(rate[k])) for k, n in copies.items())
            assert all(1 <= r["copy"] <= math.ceil(r["rate"]) for r in out.collect())
        docs, before = out, after


def test_run(spark, folder):
    got = P.run(spark, folder)
    assert set(COLUMNS) <= set(got.columns) and got.count() > 100


def test_empty(spark, folder, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0


def test_driver_gives_free_memory_back(spark, monkeypatch):
    from lexspan.llm import _common

    assert _common.release_driver(spark)
    seen, real = [], _common.release_driver
    monkeypatch.setattr(_common, "release_driver", lambda s: seen.append(real(s)))
    assert P.stored(spark.range(3), "test-release").count() == 3 and seen == [True]
