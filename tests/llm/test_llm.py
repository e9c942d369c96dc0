"""The training-data operators against plain versions, on small tables with nulls, empties, repeats and other columns."""

import hashlib
import re

import numpy as np
import pytest
from conftest import duck, rows_of

import corpus_pipeline
from quillgraph.llm import byte_bpe, chat, pii, quality, warc
from quillgraph.llm.embedding_dedup import near_duplicates
from quillgraph.llm.neighbours import nearest
from quillgraph.llm.ngram_join import ngram_classes
from quillgraph.llm.packing import pack_documents
from quillgraph.llm.queries import ORACLES, QUERIES
from quillgraph.llm.text import vocabulary
from quillgraph.llm.token_counts import count_tokens
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
TEXTS = [None, "", " \n\t ", "one two", "a b c d e f g h i j k l m n o", "A b c d e f g h i j k l m n o", "a b c d e f g h i j k l m n p q r",
         "Écrivez à jean@example.fr ou +33 1 23 45 67 89, IP 10.0.0.256 puis 10.0.0.25.", "card 4111 1111 1111 1111 and \x00 日本語 😀", "word " * 20000]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, k, "x", [0]) for k, t in enumerate(TEXTS)] + [(4, TEXTS[4], 0, "y", None), (None, "no id here at all today", 0, "z", None)]
    return spark.createDataFrame(rows, "doc_id long, text string, score long, component_id string, spans array<int>")


@pytest.mark.parametrize("name", sorted(set(ORACLES)))
def test_sql(spark, name):
    assert rows_of(QUERIES[name](spark, SF).toPandas()) == rows_of(duck(SF).execute(ORACLES[name]).df())


def shingles(text, n=5):
    words = re.findall("[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} or ({tuple(words)} if words else set())


def test_ngram_join(spark, docs):
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_classes(docs).collect()}
    assert found[0] == found[0] and found[0] == (0, 0) and found[1] == (0, 1) and found[2] == (0, 2)
    for k, t in enumerate(TEXTS):
        assert found[k][0] == len(shingles(t))
    assert found[5][1] == 4 and found[6][1] == 6
    assert ngram_classes(docs.where("false")).count() == 0


def test_pii(spark, docs):
    rows = {r["doc_id"]: r for r in pii.digests(pii.find(docs)).collect()}
    assert (rows[7]["n_email"], rows[7]["n_ip"], rows[7]["n_phone"]) == (1, 1, 1) and rows[8]["n_card"] == 1
    assert rows[0]["base_sha256"] == rows[1]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    start = TEXTS[7].index("jean@")
    assert rows[7]["spans"].split(",")[0] == f"email:{start}:{start + len('jean@example.fr')}"
    assert pii.find(docs.where("false")).count() == 0


def test_redact_agrees_with_decided(spark):
    """Names and secrets beside contacts, overlapping spans, many spans: what is decided is what goes."""
    secret = "ghp_0123456789abcdefABCD"
    texts = [f"by James Smith, write to a{k}@example.org, token {secret}{k} 😀" for k in range(40)]
    texts += ["IP 10.0.0.4 111 1111 1111 1111 end", "host 1.2.3.4111-1111-1111-1111", "é a@b.de " * 700 + "tail", None, "", "nothing here"]
    docs = spark.createDataFrame([(k, t, [k]) for k, t in enumerate(texts)], "doc_id long, text string, spans array<int>")
    seen = pii.candidates(docs.select("doc_id", "text"))
    verdicts = pii.Verdicts({(x["kind"], x["pattern"]): 1.0 for r in seen.collect() for x in r["spans"]}, {})
    found = {r["doc_id"]: r["spans"] for r in pii.decided(seen, verdicts).collect()}
    assert any(x["kind"] >= pii.BASE for x in found[0]) and len(found[42]) == 700
    for r in pii.redact(docs, verdicts).collect():
        text, want, at = texts[r["doc_id"]], "", 0
        for x in found[r["doc_id"]]:
            if x["s"] >= at:
                want += text[at : x["s"]] + f"<{pii.KINDS[x['kind']].upper()}>"
            at = max(at, x["e"])
        assert r["text"] == (want + text[at:] if found[r["doc_id"]] else text) and r["spans"] == [r["doc_id"]]


def test_quality(spark, docs):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    scored = quality.classify(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), labels).join(labels, "doc_id").where("held_out").toPandas()
    assert ((scored["score"] >= 0.5).astype(int) == scored["quality"]).mean() > 0.85
    out = quality.classify(docs, labels.where("false")).toPandas()
    assert len(out) == len(TEXTS) + 2 and out["score"].between(0, 1).all()


def test_vectors(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((200, 8))
    x[100:] = x[:100] + 0.15 * rng.standard_normal((100, 8))
    rows = [(k, [float(v) for v in x[k]], int(k % 3 == 0)) for k in range(200)] + [(200, None, 1), (201, [0.0] * 8, 1), (202, [float("nan")] * 8, 1), (203, [float(v) for v in x[0]], None), (204, [float(v) for v in x[3]], 1)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    able = [(k, np.array(v), l) for k, v, l in rows if v and np.isfinite(v).all() and any(v)]
    got = {r["vec_id"]: r for r in near_duplicates(table).collect()}
    for k, v, l in able:
        near = [m for m, w, o in able if m != k and l is not None and l == o and v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= 0.93]
        assert got[k]["n_links"] == len(near)
    assert got[200]["n_links"] == 0 and got[200]["component_id"] == 200 and len(got) == 205
    best = nearest(table, F.col("vec_id") % 20 == 0).toPandas()
    hits = 0
    for k, v, _ in able:
        if k % 20 == 0:
            order = sorted((-float(v @ w), m) for m, w, _ in able if m != k)[:20]
            hits += len({m for _, m in order} & set(best[best.query_id == k].vec_id))
    assert hits >= 0.9 * len(best) and near_duplicates(table.where("false")).count() == 0 and nearest(table.where("false"), F.lit(True)).count() == 0


def test_warc(spark, tmp_path):
    kind = "record_id long, warc_type string, status int, url string, captured timestamp, headers map<string,string>, extra int"
    day = lambda n: __import__("datetime").datetime(2020, 1, 1 + n)
    rows = [(1, "response", 200, "HTTP://A.example:80", day(0), {"ETag": '"x"', "Content-Length": "3"}, 0), (2, "response", 200, "http://a.example/", day(5), {"ETag": '"y"'}, 0),
            (3, "revisit", 304, "http://a.example/#top", day(2), {"etag": 'W/"x"', "Content-Length": "0", "X-New": "1"}, 0), (4, "revisit", 304, "http://a.example/", day(6), {"ETag": '"x"'}, 0),
            (5, "revisit", 304, "http://a.example/", day(0), {"ETag": '"x"'}, 0), (6, "revisit", 304, None, day(3), None, 0), (7, "revisit", 304, "http://a.example/", day(4), {}, 0), (8, "response", 500, "http://a.example/", day(1), {}, 0)]
    got = {r["record_id"]: r for r in warc.resolve(spark.createDataFrame(rows, kind)).collect()}
    assert got[3]["response_id"] == 1 and got[3]["headers"] == {"etag": 'W/"x"', "content-length": "3", "x-new": "1"}
    assert [got[k]["outcome"] for k in (4, 5, 6, 7)] == [warc.MISMATCH, warc.NO_RESPONSE, warc.NO_RESPONSE, warc.NO_VALIDATOR]
    assert warc.resolve(spark.createDataFrame([], kind)).count() == 0
    body = b"HTTP/1.1 200 OK\r\nETag: \"x\"\r\n\r\nhello"
    head = f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <a>\r\nWARC-Target-URI: http://a.example/\r\nWARC-Date: 2020-01-01T00:00:00Z\r\nContent-Length: {len(body)}\r\n\r\n".encode()
    (tmp_path / "a.warc").write_bytes(head + body + b"\r\n\r\n")
    read = warc.read_warc(spark, str(tmp_path / "a.warc")).collect()
    assert [(r["record_id"], r["status"], bytes(r["body"]), r["headers"]) for r in read] == [("<a>", 200, b"hello", {"etag": '"x"'})]


def test_byte_bpe(spark, docs):
    import public_tokenizers
    import tiktoken

    path = vocabulary("byte_bpe_multi_50k.tiktoken")
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(path), special_tokens={})
    got = byte_bpe.decode(byte_bpe.encode(docs, path), path).collect()
    assert len(got) == len(TEXTS) + 2
    for r in (r for r in got if r["doc_id"] is not None):
        text = TEXTS[r["doc_id"]] or ""
        assert np.frombuffer(r["ids"], "<u4").tolist() == library.encode_ordinary(text) and bytes(r["decoded"]) == text.encode()
    assert byte_bpe.encode(docs.where("false"), path).count() == 0


def test_byte_bpe_decode(spark):
    """Every id of the vocabulary, long runs that are cut in slices, null and empty lists."""
    path = vocabulary("byte_bpe_multi_50k.tiktoken")
    tokens = byte_bpe.token_bytes(path)
    lists = {1: list(range(len(tokens))), 2: [], 3: None, 4: [5] * (1 << 20) + [700, 3]}
    rows = [(k, None if v is None else bytearray(np.array(v, "<u4").tobytes())) for k, v in lists.items()]
    got = {r["doc_id"]: bytes(r["decoded"]) for r in byte_bpe.decode(spark.createDataFrame(rows, "doc_id long, ids binary"), path).collect()}
    assert got == {k: b"".join(tokens[i] for i in v or []) for k, v in lists.items()}


def test_chat_reads_back():
    for text in ("\\### Assistant: </turn> ok", "<turn:user>", "", "a\\", "日本\n"):
        formatted, low, high = chat.format_turn("assistant", text)
        assert chat.parse(formatted * 2) == [("assistant", text)] * 2 and chat.unescape(formatted[low:high]) == text


@pytest.mark.parametrize("most", [10, 2])
def test_chat_prefix_of_many(spark, most):
    """Conversations that are prefixes of more others than a segment may hold, one and two turns down."""
    talks = []
    for r in range(12):
        root, reply = ("user", f"root {r} <é"), ("assistant", f"reply {r}")
        talks += [[root], [root, reply], [root], *([root, reply, ("user", f"q{k}"), ("assistant", f"a{k}")] for k in range(7)), *([root, ("assistant", f"other {k}")] for k in range(5))]
    rows = [(c, t, role, text) for c, talk in enumerate(talks) for t, (role, text) in enumerate(talk)]
    nodes, conversations = chat.prefix_trees(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), most=most)
    assert nodes.count() == len({tuple(talk[: k + 1]) for talk in talks for k in range(len(talk))})
    kept = nodes.select("node", "segment", "start", "stop").collect()
    places = {(n["segment"], at) for n in kept for at in range(n["start"], n["stop"])}
    assert all((a["segment"], at) in places for n in nodes.collect() for a in n["ancestors"] for at in range(a["start"], a["stop"]))
    got = {r["conv_id"]: r for r in chat.digests(nodes, conversations).collect()}
    for c, talk in enumerate(talks):
        under = "".join(text for role, text in talk if role == "assistant")
        assert (got[c]["n_turns"], got[c]["loss_chars"]) == (len(talk), len(under)) and got[c]["loss_sha256"] == hashlib.sha256(under.encode()).hexdigest()
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{role}\n{text}\n" for role, text in talk).encode()).hexdigest()
        assert got[c]["formatted_chars"] == sum(len(chat.format_turn(*turn)[0]) for turn in talk)


def test_chat_long_common_history(spark, monkeypatch):
    """Conversations that share forty turns are dealt in one pass: as many tables as for those that share one."""
    written = []
    monkeypatch.setattr(chat, "materialize", lambda df, name, write=chat.materialize: written.append(name) or write(df, name))

    def trees(common):
        written.clear()
        talks = [[*(("user", f"turn {t}") for t in range(common)), ("assistant", f"{k}")] for k in range(300)]
        rows = [(c, t, *turn) for c, talk in enumerate(talks) for t, turn in enumerate(talk)]
        nodes, conversations = chat.prefix_trees(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), most=16)
        assert nodes.count() == common + 300 and nodes.where("segment = node").count() == common
        assert {r["formatted_chars"] for r in chat.digests(nodes, conversations).where("conv_id < 10").collect()} == {sum(len(chat.format_turn(*turn)[0]) for turn in talks[0])}
        return list(written)

    assert trees(1) == trees(40)


def test_token_counts(spark, docs):
    import sentencepiece

    path = vocabulary("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    for r in count_tokens(docs.where("doc_id is not null"), path).collect():
        text = TEXTS[r["doc_id"]] or ""
        assert (r["n_tokens"], r["n_bytes"]) == (len(library.encode(text)), len(text.encode()))


def test_packing(spark, docs):
    from tokenizers import Tokenizer

    path = vocabulary("word_bpe_49k.json")
    rows = pack_documents(docs, path, 2, window=64, piece_tokens=16, group_windows=4).toPandas()
    library = Tokenizer.from_file(path)
    for k, text in enumerate(TEXTS):
        own = rows[rows.doc_id == k]
        assert own.length.sum() == (len(library.encode(text or "", add_special_tokens=False).ids) + 1) * (2 if k == 4 else 1)
    for _, own in rows.sort_values("offset").groupby("sequence_id"):
        assert own.offset.tolist() == [0, *own.length.cumsum().tolist()[:-1]] and own.length.sum() <= 64


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    good = corpus_pipeline.keep_good(spark, docs, SF)
    assert good.columns == docs.columns and 0 < good.count() <= docs.count()
    kept = corpus_pipeline.keep_one_of_each(spark, docs, SF).toPandas()
    sets = [(r["doc_id"], shingles(r["text"])) for r in docs.orderBy("doc_id").collect()]
    root = {k: k for k, _ in sets}
    find = lambda k: k if root[k] == k else find(root[k])
    for a, s in sets:
        for b, t in sets:
            if a < b and s and t and 100 * len(s & t) >= 80 * len(s | t):
                u, v = sorted((find(a), find(b)))
                root[v] = u
    assert sorted(kept.doc_id) == sorted(k for k in root if find(k) == k)
    clean = corpus_pipeline.redact(spark, docs, SF)
    assert clean.columns == docs.columns and clean.count() == docs.count()
    assert not clean.where(F.col("text").rlike(r"[A-Za-z0-9]@[A-Za-z0-9-]+\.[A-Za-z]")).count()
