import base64
import random

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import lexspan
from lexspan import queries as Q
from lexspan.functions import text as T
from lexspan.functions.bpe import Merger
from lexspan.operators import chat, layout, train
from lexspan.operators.codec import Codec
from lexspan.registry import CL100K, O200K, R50K, model_to_encoding
from lexspan.sources import ranks as files

SF = "/root/testdata/sf0.001"
RANKS = files.rank_file_path("r50k_base")
needs_ranks = pytest.mark.skipif(not RANKS.exists(), reason="no r50k rank file here")
CORNERS = ["rer", "'rer", "today\n ", "today\n \n", "today\n  \n", " \x850", "", " ", "a (b", "x  y", "ſ'S", "hello 👋 world 🌍", "^" * 3000]


@pytest.fixture(scope="module")
def other():
    import tiktoken

    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, RANKS.read_bytes().splitlines())}
    return tiktoken.Encoding("other", pat_str=R50K, mergeable_ranks=table, special_tokens={"<|endoftext|>": 50256})


@needs_ranks
def test_known_ids_and_parity(other):
    enc = lexspan.get_encoding("r50k_base")
    assert enc.encode("hello world") == [31373, 995]
    assert (enc.n_vocab, enc.eot_token) == (50257, 50256)
    r = random.Random(3)
    texts = CORNERS + ["".join(r.choice("ab \n\t'sé漢🎉09.,　\u0085") for _ in range(r.randrange(60))) for _ in range(300)]
    for t in texts:
        ids = other.encode_ordinary(t)
        assert enc.encode(t) == ids
        assert enc.decode(ids) == t
        assert enc.count(t) == len(ids)
        assert enc.is_within_token_limit(t, len(ids)) == len(ids)
        assert not ids or enc.is_within_token_limit(t, len(ids) - 1) is False
        assert list(enc.decode_with_offsets(ids)) == list(other.decode_with_offsets(ids))
        assert "".join(enc.decode_generator(ids)) == t


@needs_ranks
def test_columns_agree_with_scalars(spark, other):
    enc = lexspan.get_encoding("r50k_base")
    c = Codec(spark, enc)
    texts = [t for t in CORNERS] + ["a<|endoftext|>b  <|endoftext|>", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    ids = c.encode(F.col("t"), allowed_special="all")
    rows = df.select("i", "t", ids.alias("ids"), c.count(F.col("t"), allowed_special="all").alias("n")).collect()
    for r in rows:
        if r["t"] is None:
            assert r["ids"] is None
            continue
        assert r["ids"] == enc.encode(r["t"], allowed_special="all") == other.encode(r["t"], allowed_special="all")
        assert r["n"] == len(r["ids"])
    back = df.where("t is not null").select("t", c.decode(ids).alias("b"), c.decode(ids, "ignore").alias("g")).collect()
    assert all(r["t"] == r["b"] == r["g"] for r in back)
    with pytest.raises(Exception, match="special token"):
        df.select(c.encode(F.col("t"))).collect()
    assert df.where("i = 13").select(c.encode(F.col("t"), on_disallowed="null")).first()[0] is None


def test_policy_errors():
    enc = Q.small()
    with pytest.raises(ValueError):
        enc.encode("a<|end|>")
    assert enc.encode("a<|end|>", allowed_special={"<|end|>"})[-1] == 400
    assert 400 not in enc.encode("a<|end|>", disallowed_special=())
    with pytest.raises(KeyError):
        enc.encode_single_token("zzzzzz")
    with pytest.raises(ValueError):
        enc.decode([99999])
    with pytest.raises(KeyError):
        enc.decode_single_token_bytes(99999)
    with pytest.raises(ValueError):
        lexspan.get_encoding("none")
    with pytest.raises(ValueError):
        enc.set_merge_cache_size(-1)


def test_models():
    assert model_to_encoding("gpt-4o-mini") == "o200k_base"
    assert model_to_encoding("ft:gpt-4:x") == "cl100k_base"
    with pytest.raises(KeyError):
        model_to_encoding("none")


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abcd", max_size=40))
def test_merges_against_a_plain_loop(t):
    ranks = {bytes([i]): i for i in range(256)} | {b"ab": 256, b"aa": 257, b"abc": 258, b"cd": 259, b"aab": 260, b"abcd": 261}
    parts = [bytes([b]) for b in t.encode()]
    if t.encode() not in ranks:
        while True:
            best = min(((ranks[parts[i] + parts[i + 1]], i) for i in range(len(parts) - 1) if parts[i] + parts[i + 1] in ranks), default=None)
            if best is None:
                break
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        assert Merger(ranks).piece(t.encode()) == tuple(ranks[p] for p in parts)


def test_rank_files(tmp_path, spark):
    text = b"YQ== 0\nYg== 1\n\nYWI= 2\n"
    ranks = files.parse_ranks(text)
    assert ranks == {b"a": 0, b"b": 1, b"ab": 2} == files.parse_blob(files.write_blob(ranks))
    with pytest.raises(ValueError):
        files.parse_ranks(b"YQ== 0\nYQ== 1\n", strict=True)
    assert files.parse_ranks(b"YQ== 0\nYQ== 1\n") == {b"a": 1}
    p = tmp_path / "r.tiktoken"
    p.write_bytes(text)
    assert {bytes(r[0]): r[1] for r in files.scan_ranks(spark, str(p), strict=True).collect()} == ranks
    enc = lexspan.Encoding("toy", pat_str=".+", mergeable_ranks=ranks)
    assert enc.encode_raw_bytes(b"abb") == [2, 1]
    assert enc.n_vocab == 3


def test_files(spark, tmp_path):
    enc = Q.small()
    c = Codec(spark, enc)
    texts = {"a.txt": "the one that is <other>\n", "b.txt": "", "c.txt": "inn" * 50}
    for name, t in texts.items():
        (tmp_path / name).write_text(t)
    at = f"{tmp_path}/*.txt"
    full = {k: t for k, t in texts.items() if t}  # the file source passes over empty files
    name = lambda r: r["path"].rsplit("/", 1)[1]
    assert {name(r): r["ids"] for r in c.encode_files(at).collect()} == {k: enc.encode(t) for k, t in full.items()}
    assert {name(r): r["ids"] for r in c.encode_files(at, framed=False).collect()} == {k: enc.encode_raw_bytes(t.encode()) for k, t in full.items()}
    n = {k: enc.count(t) for k, t in full.items()}
    assert {name(r): r["n_tokens"] for r in c.count_files(at, limit=20).collect()} == {k: x if x <= 20 else None for k, x in n.items()}
    assert {name(r): r["n_tokens"] for r in c.count_files(at, framed=False).collect()} == {k: enc.count_file_native(tmp_path / k) for k in full}
    assert enc.encode_file_path(tmp_path / "a.txt") == enc.encode(texts["a.txt"]) and enc.count_file_path(tmp_path / "b.txt") == 0
    assert enc.is_file_path_within_token_limit(tmp_path / "b.txt", 0) == 0 and enc.is_file_path_within_token_limit(tmp_path / "c.txt", 3) is False
    assert {name(r): r["sha256"] for r in files.file_digests(spark, at).collect()} == {k: files.file_sha256(tmp_path / k) for k in full}
    with pytest.raises(ValueError):
        c.count_files(at, limit=-1)


def test_refused_files(spark, tmp_path):
    for i, bad in enumerate(("YQ== 0\nYQ== 1\n", "YQ== 0\nYg== 0\n", "YQ== x\n", "YQ==\n")):
        (tmp_path / f"{i}").write_text(bad)
        with pytest.raises(Exception):  # noqa: B017
            files.scan_ranks(spark, str(tmp_path / f"{i}"), strict=True).collect()
    blob = files.write_blob({b"a": 0, b"b": 2})
    (tmp_path / "blob").write_bytes(blob + b"x")
    assert files.parse_blob(blob + b"x") == files.parse_blob(blob, strict=True)
    with pytest.raises(ValueError):
        files.scan_blob(spark, str(tmp_path / "blob"), strict=True)
    for cut in (3, 20, len(blob) - 1):
        with pytest.raises(ValueError):
            files.parse_blob(blob[:cut])


def test_decoding_modes(spark):
    enc = Q.small()
    c = Codec(spark, enc)
    data = [b" \xec\x8b\xa4\xed", b"\x80" * 4, "é漢".encode(), b""]
    rows = spark.createDataFrame([(list(x),) for x in data] + [(None,)], "ids array<int>")
    got = rows.select(c.decode(F.col("ids")).alias("r"), c.decode(F.col("ids"), "ignore").alias("i")).collect()
    assert [(r["r"], r["i"]) for r in got] == [(x.decode("utf-8", "replace"), x.decode("utf-8", "ignore")) for x in data] + [(None, None)]
    assert [enc.decode(list(x), "ignore") for x in data] == [r["i"] for r in got[:-1]]
    with pytest.raises(Exception):  # noqa: B017
        rows.limit(1).select(c.decode(F.col("ids"), "strict")).collect()
    assert enc.decode_batch([[104, 105], []]) == ["hi", ""]
    assert enc.encode_batch(["the", ""]) == [enc.encode("the"), []] and enc.count_batch(["the", ""]) == [enc.count("the"), 0]
    assert enc.encode_gpu(["the"]) == [enc.encode("the")] and enc.count_gpu(["the"]) == [enc.count("the")]
    ids = spark.createDataFrame([(104,), (400,), (9999,), (None,)], "i int")
    assert [None if r["token_bytes"] is None else bytes(r["token_bytes"]) for r in c.single_token_bytes(ids, "i").collect()] == [b"h", b"<|end|>", None, None]
    with pytest.raises(Exception, match="vocabulary"):
        c.single_token_bytes(ids, "i", on_unknown="raise").collect()


def test_chat_tables(spark):
    enc = lexspan.Encoding("im", pat_str=Q.LETTERS, mergeable_ranks=Q.small()._mergeable_ranks, special_tokens={"<|im_start|>": 500, "<|im_end|>": 501, "<|end|>": 502})
    c = Codec(spark, enc)
    talks = [[("user", None, "the one"), ("assistant", "bob", "that is <|im_end|> it"), ("x", "", None)], [("", None, "hi")], [("user", None, "bad <|end|> here")]]
    rows = [(i, t, *m) for i, talk in enumerate(talks) for t, m in enumerate(talk)]
    df = spark.createDataFrame(rows, "conv_id int, turn int, role string, name string, text string")
    seg = chat.conversations(df, template="im_tokens", name_col="name")
    got = {r[0]: r[1] for r in seg.select("conv_id", c.encode_segments(F.col("segments"), template="im_tokens", on_disallowed="null")).collect()}
    messages = [[{"role": r, "content": x} | ({} if n is None else {"name": n}) for r, n, x in talk] for talk in talks]
    for i in (0, 1):
        assert got[i] == enc.encode_chat(messages[i], template="im_tokens")
    assert got[2] is None
    with pytest.raises(ValueError):
        enc.encode_chat(messages[2], template="im_tokens")
    with pytest.raises(Exception, match="special token"):
        seg.where("conv_id = 2").select(c.encode_segments(F.col("segments"), template="im_tokens")).collect()
    n = seg.select(c.count_segments(F.col("segments"), template="im_tokens", allowed_special="all")).collect()
    assert sorted(r[0] for r in n) == sorted(enc.count_chat(m, template="im_tokens", allowed_special="all") for m in messages)


def test_generator_with_specials(spark):
    enc = Q.small()
    texts = ["a<|end|>the one<|end|>", "<|end|><|end|>", "", "the", None]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = Codec(spark, enc).encode_generator(df, "t", allowed_special="all").orderBy("i", "pos").collect()
    for i, t in enumerate(texts):
        assert [r["ids"] for r in got if r["i"] == i] == ([] if t is None else list(enc.encode_generator(t, allowed_special="all")))


def test_distributed_training_stores_its_words(spark):
    r = random.Random(9)
    df = spark.createDataFrame([(" ".join("".join(r.choice("abcde") for _ in range(r.randrange(1, 9))) for _ in range(60)),) for _ in range(5)], "t string")
    counts = train.piece_counts(df, "t", "[a-z]+")
    one = train.train_from_counts([(x[0].encode(), x[1]) for x in counts.collect()], 276, 2)
    assert one == train.train_distributed(counts, 276, 2, store_every=2) and len(one) == 20


def test_distributed_training_takes_few_passes(spark, monkeypatch):
    """Merges are guessed from part of the words and set right by exact counts; guesses in another order cost no pass."""
    r = random.Random(4)
    df = spark.createDataFrame([(" ".join("".join(r.choice("abcdefg") for _ in range(r.randrange(1, 9))) for _ in range(60)),) for _ in range(6)], "t string")
    counts = train.piece_counts(df, "t", "[a-z]+")
    one = train.train_from_counts([(x[0].encode(), x[1]) for x in counts.collect()], 316, 2)
    passes, real = [], train.changes_of
    monkeypatch.setattr(train, "changes_of", lambda *a: (passes.append(1), real(*a))[1])
    assert one == train.train_distributed(counts, 316, 2) and len(one) == 60 and len(passes) <= 2
    monkeypatch.setattr(train, "CORE", 40)
    assert one == train.train_distributed(counts, 316, 2, store_every=16) and len(passes) <= 40


def test_merges_change_places():
    data, n = np.frombuffer(b"cdabcdabxabcdd", np.uint8), np.array([5, 3])
    right = lambda merges: [dict(zip(*(x[s == i].tolist() for x in (p, k)), strict=True)) for s, p, k in [train._summed(train.Changes(data, np.array([8, 6]), n, merges).seen)] for i in range(1, len(merges) + 1)]
    guess = [(97, 98, 256), (120, 256, 257), (99, 100, 258), (258, 256, 259)]
    p = train.Pass(guess[:], right(guess))
    assert p.forward((99, 100), 0) and p.merges == [(99, 100, 256), (97, 98, 257), (120, 257, 258), (256, 257, 259)]
    assert p.changes == right(p.merges)
    assert not p.forward((256, 257), 1) and not p.forward((1, 2), 1)


def test_windowed_tokens(spark):
    from lexspan.streaming.tokens import windowed_tokens

    df = spark.createDataFrame([("2024-01-01 00:01:00", "the one"), ("2024-01-01 00:04:59", ""), ("2024-01-01 00:05:00", "other")], "ts string, t string").withColumn("ts", F.to_timestamp("ts"))
    got = windowed_tokens(df, Codec(spark, Q.small()), "t", "ts").orderBy("window").collect()
    assert [(r["n_tokens"], r["n_rows"]) for r in got] == [(Q.small().count("the one"), 2), (Q.small().count("other"), 1)]


def test_command_line(tmp_path, capsys, monkeypatch):
    import io
    import json

    from lexspan.__main__ import main

    rank = tmp_path / "r"
    rank.write_text("".join(f"{base64.b64encode(t).decode()} {i}\n" for t, i in Q.small()._mergeable_ranks.items()))
    said = lambda *a: (main([*a]), capsys.readouterr().out)[1].strip()
    ids = json.loads(said("encode", "hello there", "-e", "r50k_base", "--rank-file", str(rank)))
    assert said("decode", *map(str, ids), "-e", "r50k_base", "--rank-file", str(rank)) == "hello there"
    assert int(said("count", "hello there", "-e", "r50k_base", "--rank-file", str(rank))) == len(ids)
    monkeypatch.setattr("sys.stdin", io.StringIO("hello there"))
    assert json.loads(said("count", "-", "--json", "-e", "r50k_base", "--rank-file", str(rank))) == {"count": len(ids)}
    assert said("version") and "gpt-4o" in said("list-models").split() and "r50k_base" in said("list-encodings").split()
    assert json.loads(said("info"))["pyspark"]


def test_training(spark):
    pat, ranks = lexspan.train_mergeable_ranks_from_iterator(["abababab"], vocab_size=257, pattern="[a-z]+", min_frequency=1)
    assert ranks[b"ab"] == 256
    with pytest.raises(ValueError):
        lexspan.train_mergeable_ranks_from_iterator([], vocab_size=3)
    df = spark.createDataFrame([("the then there aaa aaaa",), ("other the",), (None,)], "t string")
    counts = train.piece_counts(df, "t", "[a-z]+")
    one = train.train_from_counts([(r[0].encode(), r[1]) for r in counts.collect()], 270, 2)
    assert one == train.train_distributed(counts, 270, 2)
    assert train.train_ranks(df, "t", vocab_size=270, pattern="[a-z]+")[1] == train.ranks_from_merges(one)


def test_chat(spark):
    enc = Q.small()
    messages = [{"role": "user", "content": "the one"}, {"name": "bob", "role": "x", "content": None}, {"content": 5}]
    segments = list(chat.segments(messages, chat.resolve_template()))
    assert segments[0] == "[[role:user]]\n" and "[[role:bob]]\n" in segments
    assert enc.count_chat(messages) == len(enc.encode_chat(messages)) == sum(enc.count(s) for s in segments)
    assert enc.is_chat_within_token_limit(messages, 3) is False
    with pytest.raises(ValueError):
        chat.resolve_template("none")
    with pytest.raises(ValueError):
        chat.resolve_template({"message_prefix": ""})


def test_layout(spark):
    df = spark.createDataFrame([(0, 0, 0, 1), (0, 0, 1, 2), (1, 4, 0, 2)], "range_id int, start int, pos int, id int")
    lengths = spark.createDataFrame([(1, 3), (2, 2)], "id int, n int")
    got = layout.token_layout(df, lengths, 4, 2).orderBy("range_id", "pos").collect()
    assert [(r["token_start"], r["owned"]) for r in got] == [(0, True), (3, True), (4, True)]
    with pytest.raises(ValueError):
        layout.token_layout(df, lengths, 0, 2)


def test_byte_counts(spark):
    t = "aé漢 9\x00!"
    r = spark.createDataFrame([(t,), ("",), (None,)], "t string").select(T.non_ascii_bytes(F.col("t")), T.nonzero_bytes(F.col("t")), T.class_boundaries(F.col("t")), T.byte_values(F.col("t").cast("binary")), T.letter_space_pieces(F.col("t"))).collect()
    b = t.encode()
    kind = lambda x: 0 if x == 32 else 1 if chr(x).isascii() and chr(x).isalpha() else 2 if 48 <= x <= 57 else 3 if 33 <= x <= 126 else 4
    assert tuple(r[0])[:4] == (5, len(b) - 1, sum(kind(x) != kind(y) for x, y in zip(b, b[1:], strict=False)), list(b))
    assert tuple(r[1]) == (0, 0, 0, [], [])
    assert all(x is None for x in r[2])


def test_pieces_like_python(spark):
    import regex

    r = random.Random(5)
    texts = CORNERS + ["".join(r.choice(" \n\r\tab'S9é　ǅ.!") for _ in range(30)) for _ in range(200)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for pat in (R50K, CL100K, O200K):
        for row in df.select("t", T.pieces(F.col("t"), pat)).collect():
            assert row[1] == [m[0] for m in regex.finditer(pat, row[0]) if m[0]]


def test_stream(spark, tmp_path):
    from lexspan.streaming.tokens import with_tokens

    spark.createDataFrame([("the one",), ("",)], "t string").write.parquet(str(tmp_path / "in"))
    c = Codec(spark, Q.small())
    s = with_tokens(spark.readStream.schema("t string").parquet(str(tmp_path / "in")), c, "t")
    q = s.writeStream.format("memory").queryName("tokens_out").start()
    q.processAllAvailable()
    q.stop()
    assert {(r["t"], r["n_tokens"]) for r in spark.table("tokens_out").collect()} == {("the one", Q.small().count("the one")), ("", 0)}


def test_queries_against_sql(spark):
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    sql = Q.oracle_sql()
    for name, f in Q.queries().items():
        got = f(spark, SF)
        cols = sorted(got.columns)
        rows = sorted(str(tuple(r[c] for c in cols)) for r in got.collect())
        if name in sql:
            x = con.sql(sql[name])
            order = [x.columns.index(c) for c in cols]
            assert rows == sorted(str(tuple(r[i] for i in order)) for r in x.fetchall()), name
