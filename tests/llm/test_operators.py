"""Each operator against a plain version, on texts with every odd case: nulls, empty and long texts, copies, clashing columns."""

import base64
import hashlib
import json
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexspan.llm import ann, decontam, lm, mixing, neardup, pii, quality, repeats, secrets, toxicity

SCHEMA = "doc_id long, text string, id string, n int, terms string, bands int"
R = random.Random(17)
WORDS = [f"w{i}" for i in range(60)] + ["Été", "Straße", "the", "of"]


def words(n):
    return " ".join(R.choice(WORDS) for _ in range(n))


def make():
    base, passage = words(120), words(30)
    texts = [base, base, base.replace("the", "THE", 1), base + " tail one", words(8) + " " + passage + " " + words(5), passage + " " + words(20), words(3) + " " + passage]
    texts += [None, "", " \n ", "one", "two words", "Two  WORDS", words(6000), passage, passage + " " + passage]
    for i in range(6):
        w = base.split()
        w[10 * i + 3] = "edit"
        texts.append(" ".join(w))
    texts += [words(R.randrange(1, 60)) for _ in range(20)]
    rows = [(i, t, "x", 1, "y", 2) for i, t in enumerate(texts)]
    return rows + [(None, base, "x", 1, "y", 2), rows[3], (None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def rows():
    return make()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


SPLIT = re.compile(r"[^\x20\x09-\x0D]+")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def shingles(t, k):
    w = SPLIT.findall(lower(t))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())


@pytest.mark.parametrize("k,percent", [(3, 85), (5, 80)])
def test_near_duplicates(docs, none, rows, k, percent):
    sets = {i: shingles(t, k) for i, t, *_ in rows if i is not None}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            n = len(sets[a] & sets[b])
            if a < b and n and 100 * n >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    got = neardup.near_duplicates(docs, k=k, percent=percent).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is not None:
            assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[r["doc_id"]]), find(r["doc_id"]), find(r["doc_id"]) == r["doc_id"])
        else:
            assert r["component_id"] is None and r["kept"]
    assert neardup.near_duplicates(none).count() == 0


def test_edges_of_a_group_stay_few(spark):
    """Ids that share centres have about one edge each, and reach the same."""
    rows = [(100 + i, R.randrange(100, 105) if i < 200 else 300 + i // 10) for i in range(240) for _ in range(8)]
    rows = [(i, o) for i, o in {*rows} if i != o]
    group = lambda edges: {r["id"]: r["root"] for r in neardup.components(spark.range(1000), edges).collect()}
    df = spark.createDataFrame(rows, "id long, o long")
    few = neardup.fewer_edges(df)
    root = list(range(1000))
    for i, o in rows:
        x, y = root[i], root[o]
        root = [min(x, y) if r in (x, y) else r for r in root]
    assert group(few) == dict(enumerate(root)) == group(df.selectExpr("least(id, o) a", "greatest(id, o) b"))
    assert few.count() <= 260 and few.count() < len(rows) / 2


def test_blocks_lose_no_link(spark):
    """Many edited copies, cut into small blocks, against all pairs."""
    base = [f"b{i}" for i in range(80)]
    texts = []
    for _ in range(60):
        w = base[:]
        for j in R.sample(range(80), R.randrange(0, 5)):
            w[j] = f"e{R.randrange(6)}"
        texts.append(" ".join(w))
    sets = [shingles(t, 3) for t in texts]
    root = list(range(60))
    for a in range(60):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = root[a], root[b]
                root = [min(x, y) if r in (x, y) else r for r in root]
    old, neardup.compare_families.__defaults__ = neardup.compare_families.__defaults__, (7,)
    try:
        got = neardup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), k=3, percent=85).collect()
    finally:
        neardup.compare_families.__defaults__ = old
    assert {r["doc_id"]: r["component_id"] for r in got} == dict(enumerate(root))


def test_superminhash_estimates_similarity():
    a, b = np.arange(1, 401, dtype=np.uint64), np.arange(101, 501, dtype=np.uint64)
    from lexspan.llm._text import mix

    s = neardup.superminhash(mix(np.concatenate((a, b))), np.array([0, 400, 800]), 250)
    assert abs((s[0] == s[1]).mean() - 0.6) < 0.12


def test_repeats(docs, none, rows):
    first = {}
    ids = sorted(i for i, *_ in rows if i is not None)
    texts = {i: t for i, t, *_ in rows if i is not None}
    for i in ids:
        w = SPLIT.findall(texts[i] or "")
        for j in range(len(w) - 12):
            first.setdefault(tuple(w[j : j + 13]), i)
    got = repeats.remove_repeats(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is None:
            assert r["n_removed"] == 0
            continue
        w = SPLIT.findall(texts[r["doc_id"]] or "")
        gone = [False] * len(w)
        for j in range(len(w) - 12):
            if first[tuple(w[j : j + 13])] < r["doc_id"]:
                gone[j : j + 13] = [True] * 13
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        assert (r["n_words"], r["n_removed"], r["kept_text"], r["kept_sha256"]) == (len(w), sum(gone), kept, hashlib.sha256(kept.encode()).hexdigest())
    assert repeats.remove_repeats(none).count() == 0


def plain_repeats(rows, size=13):
    first = {}
    for i, t in rows:
        w = SPLIT.findall(t or "")
        for j in range(len(w) - size + 1):
            if i is not None:
                first[tuple(w[j : j + size])] = min(i, first.get(tuple(w[j : j + size]), i))
    out = []
    for i, t in rows:
        w = SPLIT.findall(t or "")
        gone = [False] * len(w)
        for j in range(len(w) - size + 1):
            if i is not None and first[tuple(w[j : j + size])] < i:
                gone[j : j + size] = [True] * size
        out.append((str(i), len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return sorted(out)


def found_repeats(spark, rows, **options):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return sorted((str(r["doc_id"]), r["n_words"], r["n_removed"], r["kept_text"]) for r in repeats.remove_repeats(df, **options).collect())


def test_repeats_where_ids_repeat(spark):
    passage, unique = " ".join(f"p{i}" for i in range(30)), " ".join(f"u{i}" for i in range(30))
    rows = [(0, passage), (1, passage), (1, unique), (1, unique + " " + passage), (1, passage), (None, passage), (2, unique + "  \n" + passage), (2, None), (2, "")]
    assert found_repeats(spark, rows) == plain_repeats(rows)
    assert found_repeats(spark, rows[:3]) == plain_repeats(rows[:3])
    assert found_repeats(spark, [(0, unique), (1, "few words"), (2, None)]) == plain_repeats([(0, unique), (1, "few words"), (2, None)])


def test_repeats_in_parts_of_shards(spark, monkeypatch):
    """Templates that differ in one word, periodic texts and nested passages, in shards and parts of few runs."""
    base = [f"t{i}" for i in range(40)]
    rows = []
    for i in range(90):
        w = base[R.randrange(0, 10) : R.randrange(25, 40)]
        if i % 3:
            w[R.randrange(len(w))] = f"number{i}"
        rows.append((R.randrange(60), " ".join([f"x{i}", *w, *(["again"] * (i % 30)), f"y{i}"])))
    monkeypatch.setattr(repeats.repeated_places, "__defaults__", (13, 5, 5))
    assert found_repeats(spark, rows) == plain_repeats(rows)


def test_repeats_are_what_the_automata_match(monkeypatch):
    import pyarrow as pa

    seq = " ".join(f"w{i}" for i in range(20)).encode()
    left = pa.table({"run": [b"a", b"b"], "seq": pa.array([b"x y " + seq, b"w3 w4"], pa.binary())})
    right = pa.table({"lo": [7], "seq": pa.array([seq], pa.binary())})
    assert repeats.locate(13)(left, right).to_pylist() == [{"run": b"a", "off": 2, "n": 20, "lo": 7}]

    real = repeats.ahocorasick.Automaton

    class Other:
        """An automaton of a word that never occurs."""

        def __new__(cls, kind):
            it = real(kind)
            it.add_word("none", 0)

            class Held:
                add_word = staticmethod(lambda key, value: None)
                make_automaton, iter, __len__ = it.make_automaton, it.iter, lambda self: len(it)

            return Held()

    monkeypatch.setattr(repeats.ahocorasick, "Automaton", Other)
    assert repeats.locate(13)(left, right).num_rows == 0


def test_matches_are_compared_with_the_passage(monkeypatch):
    """Where all hashes of phrases meet, only windows with the passage's words are found."""
    import pyarrow as pa

    runs = pa.array([b"a b c d e f g h i j k l m", b"a b c d e f X h i j k l m", b"q a b c d e f g h i j k l m"], pa.binary())
    monkeypatch.setattr(repeats, "hashes", lambda d, s, e: np.ones(len(s), np.uint64))
    got = repeats.match(runs, np.array([5]), pa.array([b"a b c d e f g h i j k l m"], pa.binary()), 13)
    assert list(zip(*(x.tolist() for x in got), strict=True)) == [(0, 0, 13, 5), (2, 1, 13, 5)]


def plain_windows(items, size=10):
    windows = {}
    for i, t, *_ in items:
        w = WORD.findall(lower(t))
        for j in range(max(1, len(w) - size + 1)) if w else []:
            windows.setdefault(tuple(w[j : j + size]), set()).add(str(i))
    return windows


def plain_hits(t, windows):
    w, hit, found = WORD.findall(lower(t)), set(), set()
    for x, its in windows.items():
        for j in range(len(w) - len(x) + 1):
            if tuple(w[j : j + len(x)]) == x:
                hit |= set(range(j, j + len(x)))
                found |= its
    return len(w), len(hit), sorted(found)


@pytest.mark.parametrize("most", [200_000, 0])
def test_decontamination(spark, docs, none, rows, most):
    items = [(1, rows[5][1].split(" w", 12)[0] + " " + words(5), "q"), (2, rows[14][1], "q"), (3, "two words", "q"), (4, None, None), (5, "", "q"), (10, "Été", "q"), (2, rows[14][1], "q"), (11, rows[14][1], "q")]
    items += [(12, "w1", "q"), (13, "the the the the the the the the the the the the", "q")]
    bench = spark.createDataFrame(items, "item_id long, text string, id string")
    windows = plain_windows(items)
    # rows that share an id, or have none, are judged by their own text
    more = [(7, "a clean text", "x", 1, "y", 2), (7, rows[14][1] + " end", "x", 1, "y", 2), (None, "Two words", "x", 1, "y", 2), (7, "the " * 300, "x", 1, "y", 2)]
    df = docs.union(spark.createDataFrame(more, SCHEMA)).withColumn("key", F.lit("k")).withColumn("win", F.lit(1))
    got = decontam.contamination(df, bench, broadcast_windows=most).collect()
    want = sorted(str((i, *plain_hits(t, windows))) for i, t, *_ in rows + more)
    assert sorted(str((r["doc_id"], r["n_words"], r["n_hit"], r["items"])) for r in got) == want
    assert all(r["contaminated"] == (r["n_hit"] > 0) and r["n_items"] == len(r["items"]) for r in got)
    left = decontam.drop_contaminated(df, bench, broadcast_windows=most)
    assert left.columns == df.columns
    assert sorted(str(r["text"]) for r in left.collect()) == sorted(str(t) for _, t, *_ in rows + more if not plain_hits(t, windows)[1])
    assert decontam.contamination(none, bench).count() == 0
    assert decontam.contamination(docs, bench.limit(0)).where("contaminated").count() == 0


@pytest.mark.parametrize("most", [200_000, 0])
def test_proximity(spark, most):
    texts = ["alpha x beta gamma delta", "beta gamma alpha", "gamma alpha", "alpha beta gamma", "x alpha x x x beta x x x gamma", None, "", *(" ".join(R.choice(("alpha", "beta", "gamma", "x", "y")) for _ in range(R.randrange(1, 25))) for _ in range(40))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    item = spark.createDataFrame([(1, "alpha beta gamma")], "item_id long, text string")
    count = Counter(w for t in texts for w in (t or "").split())
    term = ["alpha", "beta", "gamma"]
    anchor = min(range(3), key=lambda i: (count[term[i]], i))
    for slack in (None, 0, 2, 3) if most else (2,):
        got = {r["doc_id"]: r for r in decontam.contamination(df, item, slack=slack, broadcast_windows=most).collect()}
        for i, t in enumerate(texts):
            w, hit, s = (t or "").split(), set(), slack or 0
            for p in range(len(w)):
                start = p - anchor
                if w[p] == term[anchor] and all(term[j] in w[max(0, start + j - s) : max(0, start + j + s + 1)] for j in range(3)):
                    hit |= set(range(max(0, start), min(len(w), start + 3)))
            assert (got[i]["n_words"], got[i]["n_hit"]) == (len(w), len(hit)), (t, slack)


def luhn(d):
    s = [int(c) if i % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for i, c in enumerate(reversed(d))]
    return sum(s) % 10 == 0


def plain_pii(t):
    t = t or ""
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [("card", m.start(), m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 16 <= len(d := re.sub("[^0-9]", "", m[0])) <= 19 and luhn(d)]
    out += [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return out


def test_pii(spark, none):
    odd = ["a@b.co", "é a@b.co_c@d.org x..y@z-1.a.b", "1.2.3.4.5.6.7.8 256.1.1.1 001.2.3.0255", "4111 1111 1111 1111 4111-1111-1111-1112", "+1 (555) 123-4567 +12", None, "", "9" * 3000, "a" * 5000 + "@", "@@..@"]
    pool = "ab1.2@+- ()4"
    odd += ["".join(R.choice(pool) for _ in range(60)) for _ in range(300)]
    df = spark.createDataFrame([(i, t, "z") for i, t in enumerate(odd)] + [(None, "x@y.zz", "z")], "doc_id long, text string, s string")
    for r in pii.sanitise(df).select("doc_id", "text", "pii_text", pii.as_text(F.col("pii_base")).alias("b")).collect():
        spans = plain_pii(r["text"])
        assert r["b"] == ",".join(f"{k}:{s}:{e}" for k, s, e in spans), r["text"]
        if not spans:
            assert r["pii_text"] == r["text"]
    assert pii.sanitise(none.select("doc_id", "text")).count() == 0
    # clashing columns and repeated rows
    clash = df.limit(5).union(df.limit(5)).withColumn("pii_base", F.lit(1)).withColumn("pii_key", F.lit("k")).withColumn("pii_text", F.lit("t"))
    got = pii.sanitise(clash)
    assert got.columns == [*clash.columns, "pii_base_", "pii_spans", "pii_text_"]
    assert got.count() == 10 and all(r["pii_key"] == "k" and r["pii_text"] == "t" and bool(r["pii_spans"]) == (r["pii_text_"] != r["text"]) for r in got.collect())


def test_disclosing_terms(spark):
    longer = lambda n: " ".join(f"term{R.randrange(60)}" for _ in range(n))
    rows = [(i, f"{longer(9)} zorblax mail jo@x.org {longer(9)}") for i in range(12)] + [(100 + i, longer(30)) for i in range(400)]
    got = {r["doc_id"]: r for r in pii.sanitise(spark.createDataFrame(rows, "doc_id long, text string"), bits=4.0).collect()}
    assert all("zorblax" not in got[i]["pii_text"] and "[EMAIL]" in got[i]["pii_text"] and "[REMOVED]" in got[i]["pii_text"] for i in range(12))
    assert all(got[100 + i]["pii_text"] == got[100 + i]["text"] for i in range(400))
    copies = [(i, "only one text with zorblax near jo@x.org here") for i in range(50)]
    assert all("zorblax" in r["pii_text"] for r in pii.sanitise(spark.createDataFrame(copies + rows[12:], "doc_id long, text string"), bits=4.0).where("doc_id < 50").collect())


def test_disclosing_term_beside_two_entities(spark):
    longer = lambda n: " ".join(f"term{R.randrange(60)}" for _ in range(n))
    rows = [(i, f"{longer(9)} zorblax mail jo@x.org or +1 (555) 123-4567 {longer(9)}") for i in range(12)] + [(100 + i, longer(30)) for i in range(400)]
    got = pii.sanitise(spark.createDataFrame(rows, "doc_id long, text string"), bits=4.0).where("doc_id < 12").collect()
    assert len(got) == 12 and all("zorblax" not in r["pii_text"] and "[EMAIL]" in r["pii_text"] and "[PHONE]" in r["pii_text"] for r in got)


def test_disclosing_term_in_few_texts(spark):
    longer = lambda n: " ".join(f"term{R.randrange(60)}" for _ in range(n))
    wide = "x" * 150  # the name stands within 8 words, beyond 128 characters
    rows = [(i, f"{longer(9)} zorblax {wide} jo@x.org {longer(9)}") for i in range(3)] + [(100 + i, longer(30)) for i in range(400)]
    got = pii.sanitise(spark.createDataFrame(rows, "doc_id long, text string")).where("doc_id < 3").collect()
    assert len(got) == 3 and all("zorblax" not in r["pii_text"] and "term" in r["pii_text"] for r in got)


def test_disclosing_terms_everywhere(spark):
    longer = lambda n: " ".join(f"term{R.randrange(60)}" for _ in range(n))
    rows = [(i, f"{longer(9)} zorblax mail jo@x.org {longer(60)} Zorblax {longer(3)}") for i in range(12)] + [(100 + i, longer(30)) for i in range(400)]
    rows += [(50, f"é {longer(40)} ZORBLAX, zorblaxes"), (51, None), (52, "")]
    got = {r["doc_id"]: r for r in pii.sanitise(spark.createDataFrame(rows, "doc_id long, text string"), bits=4.0).collect()}
    for i, t in rows:
        at = [(4, m.start(), m.end()) for m in re.finditer(r"\b(zorblax|mail)\b", t or "", re.I)]  # each stands beside the address only
        assert [tuple(x) for x in got[i]["pii_spans"] if x["kind"] == 4] == at
        assert len(at) == (3 if i < 12 else i == 50) and not re.search(r"\bzorblax\b", got[i]["pii_text"] or "", re.I)
    assert got[50]["pii_text"].endswith(" [REMOVED], zorblaxes") and got[51]["pii_text"] is None and len(got) == len(rows)


def tlv(tag, *parts):
    body = b"".join(parts)
    n = len(body)
    size = bytes([n]) if n < 128 else (lambda k: bytes([0x80 | len(k)]) + k)(n.to_bytes((n.bit_length() + 7) // 8, "big"))
    return bytes([tag]) + size + body


def number(n):
    return tlv(2, bytes([1 + R.randrange(127)]) + R.randbytes(n - 1))


ZERO, ONE, OID = tlv(2, b"\0"), tlv(2, b"\1"), tlv(0x30, tlv(6, R.randbytes(7)), tlv(5))
string = lambda b: len(b).to_bytes(4, "big") + b


def private_keys():
    rsa = tlv(0x30, ZERO, number(129), tlv(2, b"\1\0\1"), *(number(k) for k in (128, 65, 64, 64, 64, 64)))
    sec1 = tlv(0x30, ONE, tlv(4, R.randbytes(32)), tlv(0xA0, tlv(6, R.randbytes(5))), tlv(0xA1, tlv(3, R.randbytes(66))))
    return {
        "rsa": rsa, "sec1": sec1, "short": tlv(0x30, ONE, tlv(4, R.randbytes(16))), "dsa": tlv(0x30, ZERO, *(number(k) for k in (64, 20, 64, 64, 20))),
        "pkcs8": tlv(0x30, ZERO, OID, tlv(4, rsa)), "ed": tlv(0x30, ZERO, tlv(0x30, tlv(6, R.randbytes(3))), tlv(4, tlv(4, R.randbytes(32)))), "sealed": tlv(0x30, OID, tlv(4, R.randbytes(64))),
        "openssh": b"openssh-key-v1\0" + string(b"none") + string(b"none") + string(b"") + (1).to_bytes(4, "big") + string(R.randbytes(51)) + string(R.randbytes(136)),
    }


def test_key_structures():
    keys = private_keys()
    assert all(secrets.is_key(b) for b in keys.values())
    spki = tlv(0x30, OID, tlv(3, b"\0" + tlv(0x30, number(129), tlv(2, b"\1\0\1"))))
    cert = tlv(0x30, tlv(0x30, tlv(0xA0, tlv(2, b"\2")), number(16), OID, tlv(0x30), spki), OID, tlv(3, R.randbytes(129)))
    public = tlv(0x30, number(129), tlv(2, b"\1\0\1"))
    for b in (spki, cert, public, b"", b"\x30", R.randbytes(80), tlv(0x30, number(40), number(40))):
        assert not secrets.is_key(b)
    for b in keys.values():  # any length that doesn't add up
        assert not secrets.is_key(b[:-1]) and not secrets.is_key(b + b"\0")
        assert not any(secrets.is_key(b[:i] + bytes([b[i] ^ 1]) + b[i + 1 :]) for i in (1, 16 if b[0] != 0x30 else 0))


def test_planted_secrets(spark):
    """Documents built of pieces whose spans are known, against what the scan reports."""
    b64 = lambda b: base64.b64encode(b).decode()
    wrap = lambda t, n=64, sep="\n": sep.join(t[i : i + n] for i in range(0, len(t), n))
    keys = list(private_keys().values())
    head = base64.urlsafe_b64encode(json.dumps({"alg": "HS256"}).encode()).decode().rstrip("=")
    docs, want = [], []
    for i in range(120):
        text, spans = "é ", set()
        for _ in range(R.randrange(1, 5)):
            key, kind = R.choice(keys), R.randrange(12)
            bare = b64(key)
            piece, name = {
                0: (bare, "key64"), 1: (wrap(bare), "key64"), 2: (wrap(bare, 40, "\r\n  "), "key64"), 3: (key.hex(), "keyhex"), 4: (b64(bare.encode()), "key64"), 5: (wrap(b64(b64(bare.encode()).encode()), 76), "key64"),
                6: (f"-----BEGIN RSA PRIVATE KEY-----\n{wrap(bare)}\n-----END RSA PRIVATE KEY-----", "pem"), 7: (f"-----BEGIN PRIVATE KEY-----\nProc-Type: 4,ENCRYPTED\nDEK-Info: DES-EDE3-CBC,{'A1' * 8}\n\n{wrap(b64(bytes(range(200, 248))))}\n-----END PRIVATE KEY-----", "pem"),
                8: (f"{head}.e30.sig", "jwt"), 9: (bare[: len(bare) // 8 * 4], None), 10: (b64(b"no key at all, a text that is long enough to look at"), None), 11: (key.hex().upper()[:-2] + "G", None),
            }[kind]
            at = len(text)
            text += piece + R.choice([" ; ", "\n\nnext words here ", ", and\n"])
            if name:
                spans.add(f"{name}:{at}:{at + len(piece)}")
        docs.append((i, text))
        want.append(spans)
    df = spark.createDataFrame(docs + docs[:5], "doc_id long, text string").withColumn("n_hex", F.lit("x"))
    got = secrets.scan_secrets(df).collect()
    assert len(got) == len(docs) + 5
    for r in got:
        found = {x for x in r["spans"].split(",") if x}
        mine = {x for x in found if x.split(":")[0] in ("key64", "keyhex", "pem", "jwt")}
        inner = {x for x in mine - want[r["doc_id"]] if x.startswith("key64") and any(w.startswith("pem") and int(w.split(":")[1]) < int(x.split(":")[1]) < int(w.split(":")[2]) for w in want[r["doc_id"]])}
        assert mine - inner == want[r["doc_id"]], (mine ^ want[r["doc_id"]], docs[r["doc_id"]][1])


def plain_secrets(t):
    t = t or ""
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t, re.ASCII) if len(m[1]) >= 6 and "\u017f" not in m[0] and "\u212a" not in m[0]]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 24]
    return [f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(out)]


def test_secrets(spark, none):
    pieces = ["password", "PassWD", "secret", "api_key", "ApiKey", "token", '"', "'", " ", " ", ":", "=", "abc123", "x", "AKIA", "AKIA", "ABCDEFGH12345678", "Z9", "0a1b2c3d", "deadbeef00", "é", "-", "\n", "."]
    texts = ["password = hunter22", "é Api_Key: 'abc' apikey=\"abcdef\"", "AKIA" + "A" * 16 + " AKIA" + "B" * 10, "x" + "0a" * 12 + "g", None, "", "token" + " " * 500, "a" * 9000, "secret" * 3000, "MII" * 5000, "M" + "A" * 20000, "word\n" * 4000]
    texts += ["".join(R.choice(pieces) for _ in range(R.randrange(1, 40))) for _ in range(400)]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(None, texts[0], 1), (3, texts[3], 1)], "doc_id long, text string, spans int")
    rows = secrets.scan_secrets(df).collect()
    assert len(rows) == len(texts) + 2
    for r in rows:
        want = plain_secrets(texts[0 if r["doc_id"] is None else r["doc_id"]])
        assert [x for x in r["spans"].split(",") if x] == want
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(x.startswith(k) for x in want) for k in ("assign", "access", "hex")]
        assert r["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest()
    bad = base64.urlsafe_b64encode(b'{"typ": "x", "other": 1}').decode().rstrip("=")
    assert not secrets.find_secrets(f"{bad}.e30.sig")
    assert secrets.scan_secrets(none).count() == 0


def test_quality(spark, none):
    good, poor = lambda: words(80).capitalize() + ".", lambda: "!! ".join(words(60).upper().split()) + "!!"
    texts = [(i, good() if i % 3 else poor() if i % 2 else good() + "\n" + poor()) for i in range(300)] + [(300, None), (301, ""), (None, "x")]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    lab = spark.createDataFrame([(i, int(i % 3 > 0), None) for i in range(300)] + [(None, 1, 0), (5000, None, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit_quality(df, lab, train_where=F.crc32(F.col("id").cast("string").cast("binary")) % 4 != 2)
    got = {r["doc_id"]: r for r in quality.score_quality(df, model).collect()}
    held = [i for i in range(300) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert np.mean([got[i]["predicted"] == int(i % 3 > 0) for i in held]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in got.values()) and len(got) == 303
    odd = df.union(df.limit(20)).withColumn("score", F.lit("x")).withColumn("text", F.when(F.col("doc_id") == 1, F.repeat("text", 300)).otherwise(F.col("text")))
    twice = quality.score_quality(odd, model).groupBy("doc_id").agg(F.count("*").alias("n"), F.count_distinct("score").alias("m"), F.max("n_passages").alias("p"))
    assert twice.where("m <> 1").isEmpty() and twice.agg(F.sum("n")).first()[0] == 323 and twice.where("doc_id = 1").first()["p"] > 100
    again = quality.fit_quality(df.union(df), lab, train_where=F.crc32(F.col("id").cast("string").cast("binary")) % 4 != 2)
    assert all(np.array_equal(again.p[k], model.p[k]) for k in model.p)
    empty = quality.fit_quality(none, lab)
    assert quality.score_quality(df, empty).select("score").distinct().count() == 1


def test_quality_scores_do_not_depend_on_other_rows():
    r = np.random.default_rng(1)
    counts = r.integers(1, 6, 300)
    counts[1] = 500
    ends = np.concatenate(([0], np.cumsum(counts)))
    x = r.random((ends[-1], quality.N_FEATURES), dtype=np.float32)
    model = quality.AttentionMIL().fit(x[: ends[50]], counts[:50], np.arange(50, dtype=np.float32) % 2, steps=20)
    whole = model.score(x, counts)
    for n in (1, 2, 3, 20, 33, 76, 150):
        for i in range(0, 301 - n, max(1, n // 2)):
            assert (model.score(x[ends[i] : ends[i + n]], counts[i : i + n]) == whole[i : i + n]).all()


def test_toxicity(spark, none):
    bad = ["scum", "idiot", "trash", "moron"]
    texts = [(i, words(40) + (" " + " ".join(R.choice(bad) for _ in range(1 + i % 7)) if i % 4 == 0 else "")) for i in range(400)] + [(400, None), (401, ""), (None, "idiot scum trash")]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    lab = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(0, 400, 2)], "doc_id long, toxic int")
    model = toxicity.fit_toxicity(df, lab)
    assert (np.diff(model.theta) > 0).all()
    got = {r["doc_id"]: r for r in toxicity.score_toxicity(df, model).collect()}
    assert np.mean([got[i]["toxic"] == (i % 4 == 0) for i in range(400)]) > 0.97
    assert got[None]["toxic"] and not got[400]["toxic"] and not got[401]["toxic"]
    few, many = ([got[i]["expected_severity"] for i in range(0, 400, 4) if i % 7 == k] for k in (0, 6))
    assert np.mean(many) > np.mean(few)
    assert toxicity.drop_toxic(df, model).count() == sum(not r["toxic"] for r in toxicity.score_toxicity(df, model).collect())
    assert toxicity.score_toxicity(df, toxicity.fit_toxicity(none, lab)).count() == 403
    # labels that disagree with the texts: the cut lets few documents go that are labelled not toxic
    noisy = spark.createDataFrame([(i, int(i % 4 == 0) if i % 10 else 1 - int(i % 4 == 0)) for i in range(400)], "doc_id long, toxic int")
    other = toxicity.fit_toxicity(df, noisy, false_positives=0.1)
    wrong = toxicity.score_toxicity(df, other).withColumnRenamed("toxic", "said").join(noisy, "doc_id").where("toxic = 0").agg(F.avg(F.col("said").cast("int"))).first()[0]
    assert wrong <= 0.13
    # repeated rows, clashing columns and long texts
    odd = df.limit(50).union(df.limit(50)).withColumn("toxic", F.lit("x")).withColumn("p_toxic", F.lit(1)).withColumn("text", F.when(F.col("doc_id") == 1, F.repeat(F.lit("word idiot "), 40_000)).otherwise(F.col("text")))
    r = toxicity.score_toxicity(odd, model).groupBy("doc_id").agg(F.count("*").alias("n"), F.count_distinct("expected_severity").alias("m"), F.max("p_toxic").alias("p")).collect()
    assert all((x["n"], x["m"]) == (2, 1) for x in r) and next(x["p"] for x in r if x["doc_id"] == 1) > model.cut
    assert toxicity.drop_toxic(odd, model).columns == odd.columns
    assert toxicity.fit_toxicity(df.union(df), lab).cut == model.cut


def test_mixing(spark, none):
    texts = [(i, words(50) if i % 8 else "$$$ ".join(words(50).upper().split()), 7) for i in range(400)] + [(400, None, 7), (401, "", 7), (None, words(9), 7)]
    df = spark.createDataFrame(texts, "doc_id long, text string, rates int")
    lab = spark.createDataFrame([(i, int(i % 8 > 0), 0) for i in range(0, 400, 2)] + [(None, 1, 0)], "doc_id long, quality int, toxic int")
    rows = mixing.mix(df, lab, F.col("quality").cast("string"), {"1": 0.5, "0": 0.5}).collect()
    assert len(rows) == 403
    total = sum(r["mix_tokens"] * r["rate"] for r in rows)
    low = sum(r["mix_tokens"] * r["rate"] * r["mix_p"][0] for r in rows)
    assert abs(low / total - 0.5) < 0.01 and all(r["rate"] >= 0 for r in rows)
    assert abs(total - sum(r["mix_tokens"] for r in rows)) < 0.01 * total
    # the output's token shares, once copies are taken, are the targets
    df2 = df.withColumn("copies", F.lit(3)).withColumn("MIX_P", F.lit("x"))
    tokens, posterior, rate, copies = mixing.names_in(df2.columns)
    assert (posterior, copies) == ("mix_p_", "copies_")
    mixed = mixing.mix(df2, lab, F.col("quality").cast("string"), {"1": 0.3, "0": 0.7})
    out = mixing.taken(mixed, copies).collect()
    want = {(r["doc_id"], i) for r in mixed.collect() for i in range(1, r[copies] + 1)}
    assert sorted(map(str, want)) == sorted(str((r["doc_id"], r[copies])) for r in out) and all(r["copies"] == 3 and r["MIX_P"] == "x" for r in out)
    assert abs(sum(r[tokens] * r[posterior][0] for r in out) / sum(r[tokens] for r in out) - 0.7) < 0.05
    assert abs(sum(r[tokens] for r in out if r["doc_id"] is not None and r["doc_id"] % 8 == 0) / sum(r[tokens] for r in out) - 0.7) < 0.05
    # repeated rows and ties have equal rates
    twice = mixing.mix(df.union(df), lab, F.col("quality").cast("string"), {"1": 0.5, "0": 0.5}).groupBy("doc_id").agg(F.count_distinct("rate").alias("n"), F.count("*").alias("m"))
    assert twice.where("n <> 1 or m <> 2").isEmpty()
    assert all(r["rate"] == 1.0 for r in mixing.mix(df, lab.limit(0), F.col("quality").cast("string"), {"1": 1.0}).collect())
    assert mixing.mix(none.select("doc_id", "text"), lab, F.col("quality").cast("string"), {"1": 1.0}).count() == 0


def test_neighbours(spark):
    r = np.random.default_rng(4)
    x = r.normal(size=(900, 16)).astype(np.float32)
    x[100:400] = x[100]
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)]
    odd = [(2000, None, 1), (2020, [0.0] * 16, 1), (2040, [float("nan")] * 16, 1), (2060, [1.0] * 3, 1), (2080, [None] + [1.0] * 15, 1), (None, [1.0] * 16, 1)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, id int")
    got = ann.search(df.drop("id"), F.col("id") % 20 == 0).collect()
    y = x.astype(np.float64)
    recall = []
    for q in range(0, 900, 20):
        s = y @ y[q]
        s[q] = -np.inf
        best = np.lexsort((np.arange(900), -s))[:20]
        mine = sorted((g["rank"], g["vec_id"], g["score"]) for g in got if g["query_id"] == q)
        assert [m[0] for m in mine] == list(range(1, 21))
        assert all(abs(m[2] - s[m[1]]) < 1e-9 for m in mine)
        recall.append(len({m[1] for m in mine} & set(best.tolist())) / 20)
    assert np.mean(recall) >= 0.9 and len(got) == 45 * 20
    assert ann.search(df.drop("id").limit(0), F.col("id") % 20 == 0).count() == 0


def test_neighbours_of_the_table(spark):
    """Recall on the driver's vectors, which hardly cluster."""
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = df.orderBy("vec_id").toArrow()
    ids, x = rows["vec_id"].to_numpy(), np.array(rows["embedding"].to_pylist(), np.float64)
    got = ann.search(df, F.col("id") % 20 == 0, block=512).toPandas()
    hits = []
    for q, mine in got.groupby("query_id"):
        s = x @ x[ids == q][0]
        s[ids == q] = -np.inf
        hits.append(len(set(ids[np.lexsort((ids, -s))[:20]]) & set(mine["vec_id"])) / 20)
    assert len(hits) == (ids % 20 == 0).sum() and np.mean(hits) >= 0.95


def test_lists_are_packed_into_blocks():
    first, cut = ann.packed(np.array([5, 30, 4, 0, 3, 9]), np.array([0, 2, 1, 3, 4, 5]), 10)
    assert first.tolist() == [0, 1, 0, 4, 4, 5] and cut.tolist() == [1, 3, 1, 1, 1, 1]


def test_lm(docs, none, rows):
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    got = lm.score_texts(docs, held).collect()
    is_held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    toks = [(i, [*SPLIT.findall(lower(t)), "\0"]) for i, t, *_ in rows]
    c = Counter(w for i, ws in toks if not is_held(i) for w in ws)
    n, v = sum(c.values()), len(c)
    assert len(got) == len(rows)
    want = sorted((str(i), len(w), sum(c[x] > 0 for x in w), round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), 6), is_held(i)) for i, w in toks)
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"], round(r["base_score"], 6), r["held_out"]) for r in got) == want
    assert all(r["train_tokens"] == n and r["score"] < 0 for r in got)
    assert lm.score_texts(none, held).count() == 0


def test_lm_learns_from_all_documents(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(lm.SubwordLM, "train", lambda self, texts, *a, **k: seen.append((self, len(texts))))
    # words of the second half stand in no document of a sample of 2: they get classes by what stands beside them
    rows = [(i, " ".join(R.choice(("red", "blue", "green") if j % 2 else ("one", "two", "three")) for j in range(30))) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    few = {r["doc_id"] for r in df.orderBy(F.xxhash64("doc_id"), "doc_id").limit(2).collect()}
    df = df.withColumn("text", F.when(F.col("doc_id").isin(few), "nothing here").otherwise(F.col("text")))
    lm.score_texts(df, F.lit(False), sample=2).count()
    model, tok = seen[0][0], lm.tokenizer(open(lm.VOCAB, "rb").read())[0]
    a, b = ([tok.encode(" " + w)[0] for w in ws] for ws in (("red", "blue", "green"), ("one", "two", "three")))
    assert all(model.cls[i] < lm.CLASSES - 4 and model.slot[i] < lm.OWN for i in a + b)
    assert not set(model.ctx[a]) & set(model.ctx[b])


def test_lm_shrinks_heaps_after_each_stored_table(spark, monkeypatch):
    jvm, seen, real = spark._jvm, [], lm._common.stored
    beans = [b for b in jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans() if b.getName() in ("G1 Old Generation", "MarkSweepCompact", "PS MarkSweep")]
    full = lambda: sum(b.getCollectionCount() for b in beans)

    def stored(df, name):
        out = real(df, name)
        seen.append((name, full()))
        return out

    monkeypatch.setattr(lm._common, "stored", stored)
    before = full()
    df = spark.createDataFrame([(i, "one two three four") for i in range(30)], "doc_id long, text string")
    lm.score_texts(df, F.col("doc_id") % 7 == 2, sample=2).count()
    counts = [before, *(n for _, n in seen), full()]
    assert {"texts", "sums", "counts", "parts", "words"} == {name for name, _ in seen}
    assert beans and all(x < y for x, y in zip(counts, counts[1:]))


def test_lm_attention_goes_on_with_all_partitions(spark):
    m = lm.SubwordLM(5000)
    texts = [np.array([R.randrange(1000 * (i % 3), 1000 * (i % 3) + 1000) for _ in range(100)], np.uint16) for i in range(60)]
    m.set_classes(texts)
    lm.workers(spark)
    df = spark.createDataFrame([(t.tobytes(),) for t in texts], "ids binary").repartition(3)
    before = {k: x.copy() for k, x in m.p.items()}
    lm.averaged(df, spark.sparkContext.broadcast(m), m)
    used = np.unique(m.slot[np.concatenate(texts)])
    assert (np.abs(m.p["E"] - before["E"]).max(1)[used] > 0).all() and all(np.isfinite(x).all() and x.shape == before[k].shape for k, x in m.p.items())
    # neighbour counts by partition add up to those of one run
    count = np.bincount(np.concatenate([np.append(t, 5000) for t in texts]), minlength=5001)
    got = lm.neighbours(df, spark.sparkContext.broadcast(lm.ranks_of(count)), 5000)
    assert got.sum() > 0 and got[: 5001 * 128].sum() >= 0.9 * (lm.ranks_of(count)[np.concatenate(texts)] < 128).sum()


def test_lm_attention_sees_every_training_window(spark, monkeypatch):
    seen, real = [], lm.averaged
    monkeypatch.setattr(lm, "averaged", lambda train, *a: (seen.extend(r["id"] for r in train.collect()), real(train, *a))[1])
    df = spark.createDataFrame([(i, " ".join(words(20))) for i in range(80)], "doc_id long, text string")
    lm.score_texts(df, F.col("doc_id") % 7 == 2, sample=2).count()
    assert sorted(seen) == [i for i in range(80) if i % 7 != 2]
    m, used = lm.SubwordLM(5000), []
    monkeypatch.setattr(m, "gradients", lambda a, b, live: (used.append(b[live]), {k: np.zeros_like(x) for k, x in m.p.items()})[1])
    texts = [np.array([R.randrange(5000) for _ in range(i)], np.uint16) for i in (0, 1, 31, 32, 33, 400)]
    assert m.train_once(texts, lm.Adam(m.p), batch=4) == 20
    assert sorted(np.concatenate(used)) == sorted([*np.concatenate(texts), *[5000] * 6])


def test_lm_gradients_are_slopes():
    m = lm.SubwordLM(5000)
    t = [np.array([R.randrange(5000) for _ in range(50)], np.uint16) for _ in range(5)]
    m.set_classes(t)
    a, b, live = lm.windows(t, 5000)

    def loss() -> float:
        logits = lm.softmax_log(m.hidden(a)[0].astype(float))
        return float(-np.take_along_axis(logits, m.cls[b][..., None], 2)[..., 0][live].mean())

    for k, g in m.gradients(a, b, live).items():
        p, way = m.p[k], np.sign(g).astype(np.float32)
        up, down = ((m.p.__setitem__(k, p + np.float32(h) * way), loss())[1] for h in (1e-3, -1e-3))
        m.p[k] = p
        assert abs((up - down) / 2e-3 - np.abs(g).sum()) <= 0.03 * np.abs(g).sum() + 1e-3, k


def test_lm_is_causal_and_sums_to_one():
    m = lm.SubwordLM(5000)
    t = [np.array([R.randrange(5000) for _ in range(50)], np.uint16) for _ in range(5)]
    m.set_classes(t)
    pair = np.zeros((lm.CONTEXTS, 5001), np.int64)
    for x in t:
        np.add.at(pair, (m.ctx[x[:-1]], x[1:]), 1)
    m.set_counts(pair)
    m.train(t, steps=5)
    before = np.tile(t[0][:8].astype(np.int64), (5001, 1))
    ids = before.copy()
    ids[:, 7] = np.arange(5001)
    assert abs(np.exp(m.log_probs(before, ids)[:, 7]).sum() - 1) < 0.02
    other = before[:1].copy()
    other[0, 7] = 5
    assert np.allclose(m.log_probs(before[:1], ids[:1])[0, :7], m.log_probs(other, ids[:1])[0, :7])
    assert np.allclose(m.score(t), [m.score([x])[0] for x in t])


def test_lm_long_products_and_windows_that_overlap():
    r = np.random.default_rng(3)
    for n in (0, 1, lm.TALL - 1, lm.TALL, 3 * lm.TALL + 5):
        x, y, w = (r.normal(0, 1, s).astype(np.float32) for s in ((n, 16), (n, 32), (16, 32)))
        assert np.allclose(lm.times(x, w), x @ w, atol=1e-4) and np.allclose(lm.across(x, y), x.T @ y, atol=1e-3)
    m = lm.SubwordLM(5000)
    t = [np.array([R.randrange(5000) for _ in range(n)], np.uint16) for n in (0, 1, 31, 32, 33, 55, 56, 57, 400)]
    m.set_classes(t)
    m.train(t, steps=5)
    before, ids, _ = lm.windows([t[-1]], 5000)
    whole = m.log_probs(before, ids)
    assert np.allclose(m.log_probs(before, ids, 8), whole[:, 8:], atol=1e-5)  # places that are scored already have no logits
    # each id once, in the window where it has most ids before it
    for x, got in zip(t, m.score(t), strict=True):
        x = np.append(x, 5000).astype(np.int64)
        prior, total = np.append(5000, x[:-1]), 0.0
        for i in range(len(x)):
            at = 0 if i < lm.WINDOW else (i - lm.WINDOW) // lm.STRIDE * lm.STRIDE + lm.STRIDE
            total += m.log_probs(prior[None, at : i + 1], x[None, at : i + 1])[0, -1]
        assert abs(got - total / np.log(10)) < 1e-3
