"""Operators against their rules on small inputs."""

import json
import random
import re
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer
from urllib.error import HTTPError
from urllib.request import Request, urlopen

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from helpdex.functions.language_gate import is_polish
from helpdex.functions.text import trimmed
from helpdex.functions.vectors import defect, dot, normalized
from helpdex.operators import answering, calibration, chunking, embedding, retrieval, sync
from helpdex.operators.indexing import build_index
from helpdex.plans.skew import join_to_groups
from helpdex.serving import Engine, server
from helpdex.sources import articles, config, questions
from helpdex.sources.snapshot import Store
from helpdex.streaming import jobs


def test_batch_counts_equal_counting_word_by_word():
    rng = random.Random(2)
    texts = ["".join(rng.choice("abcęłжщ 12²½_-") for _ in range(rng.randint(0, 50))) for _ in range(500)] + [None, "", "task: x | query: ala ma 123kot ²½²", "title: t | text: kot kot"]
    got = embedding.WordCounter().counts(texts)
    for text, row in zip(texts, got):
        want = [0.0] * embedding.HASH_DIMS
        for w in embedding.WORD.findall(embedding.PREFIX.sub("", text or "").lower()):
            if len(w) >= 3:
                want[embedding.fnv1a(w.encode()) % embedding.HASH_DIMS] += 1
        assert row.tolist() == (want if any(want) else [1.0] + want[1:]), text


def test_language_gate(spark):
    cases = [
        ("Chrome zawiesza się i zamyka", True), ("chrome sie zawiesza", True), ("jak zmienic haslo do konta", True), ("Outlook", True), ("chrome crash", True),
        ("Chrome blocks a needed popup window", False), ("Excel nie uruchamia sie na Windows", True), ("Chrome freezes and crashes", False), ("How do I reset my password?", False),
        ("Хром постоянно зависает", False), ("Wie ändere ich mein Passwort", False), ("", False), ("12345 ???", False), (None, False),
    ]
    got = spark.createDataFrame(cases, "t string, want boolean").select("t", "want", is_polish(F.col("t")).alias("got")).collect()
    assert [r for r in got if r["got"] != r["want"]] == []


def test_vectors(spark):
    rows = [(1, [3.0, 4.0, 100.0]), (2, [1.0, float("nan"), 0.0]), (3, [1.0]), (4, [0.0, 0.0, 5.0]), (5, None), (6, [1.0, 0.0, float("inf")])]
    df = spark.createDataFrame(rows, "id int, v array<double>")
    got = {r["id"]: (r["u"], r["d"]) for r in df.select("id", normalized(F.col("v"), 2).alias("u"), defect(F.col("v"), 2).alias("d")).collect()}
    assert got[1][0] == pytest.approx([0.6, 0.8]) and got[1][1] is None
    assert [got[k][1] for k in (2, 3, 4, 5)] == ["not finite", "too short", "zero", "null"] and all(got[k][0] is None for k in (2, 3, 4, 5))
    assert got[6][0] == [1.0, 0.0]
    pair = spark.createDataFrame([([1.0, 2.0], [3.0, 4.0]), ([1.0], [1.0, 2.0])], "x array<float>, y array<float>").select(dot(F.col("x"), F.col("y")).alias("d")).collect()
    assert [r["d"] for r in pair] == [11.0, None]


def test_trim(spark):
    text = "  \x0b a b \u0085\r\n"
    assert spark.createDataFrame([(text,)], "t string").select(trimmed(F.col("t")).alias("t")).first()["t"] == "a b"


def test_chunking_rules():
    long = " ".join(f"Zdanie numer {i} jest dość długie, ma słowa." for i in range(60))
    parts = chunking.chunks_of(long, 300)
    assert all(len(p) <= 300 for p in parts) and " ".join(parts) == long
    word = "słowo" * 200
    assert chunking.chunks_of(word, 150) == [word[k : k + 150] for k in range(0, len(word), 150)]
    assert chunking.chunks_of("a\r\n\r\nb\n \t\nc") == ["a\n\nb\n\nc"]
    assert chunking.chunks_of(None) == chunking.chunks_of(" \n\n ") == []
    rng = random.Random(3)
    for _ in range(200):
        text = "".join(rng.choice(["a", "ęż", " ", "\n\n", ". ", "!", "\n", "bbbb"]) for _ in range(rng.randint(0, 900)))
        chunks = chunking.chunks_of(text, 100)
        assert all(len(c) <= 100 for c in chunks)
        assert re.sub(r"\s", "", "".join(chunks)) == re.sub(r"\s", "", text)


def test_entries(spark):
    rows = [("a.md", "T", "body", ["q1", " ", None, "q2"], ["k1", "", "k2"]), ("b.md", "T", "  ", ["q"], None), ("c.md", None, "x", None, None)]
    df = spark.createDataFrame(rows, "path string, title string, text string, questions array<string>, keywords array<string>")
    got = [(r["path"], r["ord"], r["kind"], r["text"]) for r in chunking.entries(df).orderBy("path", "ord").collect()]
    assert got == [("a.md", 0, "text", "body"), ("a.md", 1, "question", "q1"), ("a.md", 2, "question", "q2"), ("a.md", 3, "question", "k1, k2"), ("c.md", 0, "text", "x")]


def index(spark, rows):
    df = spark.createDataFrame(rows, "path string, ord int, kind string, text string")
    return embedding.HashingEmbedder().embed(df, "text")


def asked(spark, rows):
    return embedding.HashingEmbedder().embed(spark.createDataFrame(rows, "qid bigint, question string"), "question").select("qid", F.col("vec").alias("qvec"))


ROWS = [
    ("mail.md", 0, "text", "hasło poczty zmiana"), ("mail.md", 1, "text", "druga część poczta"), ("mail.md", 2, "question", "jak zmienić hasło poczty"), ("print.md", 0, "text", "drukarka nie drukuje faktury"),
    ("same-b.md", 0, "text", "monitor miga"), ("same-a.md", 0, "text", "monitor miga"),
]


def test_retrieval_ties_bodies_and_blocks(spark, monkeypatch):
    want = None
    for block in (20_000, 2):
        monkeypatch.setattr(retrieval, "ENTRY_BLOCK", block)
        got = retrieval.retrieve(asked(spark, [(1, "jak zmienić hasło poczty"), (2, "monitor miga"), (3, None)]), index(spark, ROWS), 2)
        got = sorted((r["qid"], r["rank"], r["path"], r["text"]) for r in got.collect())
        want = want or got
        assert got == want
    assert want[0] == (1, 1, "mail.md", "hasło poczty zmiana\n\ndruga część poczta")
    assert [w[2] for w in want if w[0] == 2] == ["same-a.md", "same-b.md"]


def test_large_document_is_spread(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "ENTRY_BLOCK", 50)
    rows = [("big.pdf", i, "text", f"rozdział numer{i} monitor") for i in range(300)] + [(f"d{i}.md", 0, "text", f"artykuł{i} monitor") for i in range(40)]
    got = retrieval.retrieve(asked(spark, [(1, "rozdział numer7 monitor")]), index(spark, rows), 3).orderBy("rank").collect()
    whole = retrieval._block_ranks(asked(spark, [(1, "rozdział numer7 monitor")]).toPandas(), index(spark, rows).withColumn("large", F.lit(False)).toPandas(), 3)
    assert [r["path"] for r in got] == whole.sort_values(["score", "path"], ascending=[False, True])["path"].tolist()
    best = sorted(whole[whole["path"] == "big.pdf"]["parts"].iloc[0], key=lambda p: p[1])
    assert next(r["text"] for r in got if r["path"] == "big.pdf") == "\n\n".join(p[2] for p in best)


@pytest.mark.parametrize(("gap", "kept"), [(0.05, 2), (0.1, 3), (0.0, 3)])
def test_policy(spark, gap, kept):
    hits = spark.createDataFrame([(1, 0.79), (1, 0.76), (1, 0.73), (1, 0.60)], "qid bigint, score double")
    assert retrieval.relevant(hits, 0.7, gap).count() == kept
    assert retrieval.relevant(hits, 0.9, gap).count() == 0


DOCS = [("mail.md", "Poczta", "https://x/mail"), ("print.md", "", "")]


class Fake:
    def __init__(self, reply, error=None):
        self.reply, self.error = reply, error

    def chat(self, rows, system, prompt_col):
        reply, error = self.reply, self.error
        return answering.asked_model(rows, lambda p: (reply, error), prompt_col)


def ask(spark, qs, chatter=None, **search):
    settings = config.Config(answer=config.Answer(mode="llm" if chatter else "fragments"), search=config.Search(**({"min_score": 0.3, "max_gap": 0.0} | search)))
    docs = spark.createDataFrame(DOCS, "path string, title string, url string")
    rows = answering.ask(spark.createDataFrame(qs, "qid bigint, question string"), index(spark, ROWS), docs, settings, embedding.HashingEmbedder(), chatter).collect()
    return {r["qid"]: r for r in rows}, settings


def test_answers(spark):
    got, c = ask(spark, [(1, " jak zmienić hasło poczty "), (2, "how do I print"), (3, "  "), (4, None), (5, "zupełnie inny temat rozmowy")], min_score=0.6)
    assert got[1]["answered"] and got[1]["answer"].startswith("[Poczta, 1.00]\nhasło poczty zmiana") and got[1]["answer"].endswith("https://x/mail")
    assert (got[2]["reason"], got[2]["top_score"], got[2]["answer"]) == ("language", 0.0, c.language.other_message)
    assert got[3]["error"] == got[4]["error"] == "empty question"
    assert got[5]["reason"] == "below_threshold" and got[5]["sources"] == [] and got[5]["answer"] == c.fallback_message


@pytest.mark.parametrize(("reply", "error", "want"), [("NOT_POLISH", None, ("language", False)), ("", None, ("llm_no_answer", False)), ("eh NO_ANSWER", None, ("llm_no_answer", False)), ("Zrób to", None, (None, True)), (None, "boom", (None, False))])
def test_model_replies(spark, reply, error, want):
    got, c = ask(spark, [(1, "jak zmienić hasło poczty")], Fake(reply, error))
    assert (got[1]["reason"], got[1]["answered"]) == want and got[1]["error"] == error
    assert got[1]["top_path"] == "mail.md" and bool(got[1]["sources"]) == want[1]


def test_model_is_not_asked_without_sources(spark):
    got, _ = ask(spark, [(1, "how do I print"), (2, "zupełnie inny temat rozmowy")], Fake(None, "must not be asked"), min_score=0.99)
    assert got[1]["error"] is None and got[2]["error"] is None


def test_prompt(spark):
    row = spark.createDataFrame([("pytanie?", [("a.md", "", "u", 0.5, "t1"), ("b.md", "B", "", 0.125, "t2")])], f"q string, s array<{answering.SOURCE}>")
    got = row.select(answering.prompt(F.col("q"), F.col("s")).alias("p"), answering.fragments(F.col("s")).alias("f")).first()
    assert got["p"] == "Knowledge base articles:\n\n[1] a.md (a.md)\nt1\n\n[2] B (b.md)\nt2\n\nQuestion: pytanie?"
    assert got["f"] == "[a.md, 0.50]\nt1\nu\n\n---\n\n[B, 0.12]\nt2"


def test_threshold(spark):
    def best(rows):
        return calibration.suggest(spark.createDataFrame(rows, "top_score double, in_base boolean")).first()

    r = best([(0.9, True), (0.8, True), (0.64, True), (0.41, False), (0.3, False)])
    assert 0.41 < r["value"] < 0.64 and (r["correct"], r["total"]) == (5, 5)
    r = best([(0.9, True), (0.5, True), (0.6, False), (0.4, False)])
    assert (r["correct"], r["total"]) == (3, 4)
    assert best([(0.9, True)]) is None and best([]) is None
    rng = random.Random(1)
    for _ in range(5):
        rows = [(round(rng.random(), 3), rng.random() < 0.5) for _ in range(60)]
        got = {(round(c["value"], 9), c["place"]): c["correct"] for c in calibration.candidates(spark.createDataFrame(rows, "top_score double, in_base boolean")).collect()}
        s = sorted({x for x, _ in rows})
        values = [(s[0] - 0.01, 0), (s[-1] + 0.01, 1)] + [((a + b) / 2, 2) for a, b in zip(s, s[1:])]
        assert got == {(round(v, 9), p): sum((x >= v) == y for x, y in rows) for v, p in values}


def test_sync(spark):
    new = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "path string, hash string")
    old = spark.createDataFrame([("b", "2"), ("c", "x"), ("d", "4"), ("e", "5")], "path string, hash string")
    plan = sync.actions(new, old, spark.createDataFrame([("e",), ("e",)], "path string"))
    assert {r["path"]: r["action"] for r in plan.collect()} == {"a": "insert", "b": "unchanged", "c": "update", "d": "delete", "e": "keep"}
    assert sync.stats(plan).first().asDict() == {"indexed": 2, "unchanged": 1, "deleted": 1}
    fresh = spark.createDataFrame([("a", "1")], "path string, hash string")
    assert sorted(tuple(r) for r in sync.merged(old, plan, fresh).collect()) == [("a", "1"), ("b", "2"), ("c", "x"), ("e", "5")]


def test_heavy_keys(spark):
    rows = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i}") for i in range(3000)] + [(-1, None)], "id int, k string")
    groups = rows.where("k is not null").groupBy("k").agg(F.count("*").alias("n"))
    assert join_to_groups(rows, groups, "k", "n").count() == 3000


ARTICLE = "---\nid: x\ntitle: Poczta\nlanguage: pl\nquestions: ['Jak zmienić hasło poczty?']\nkeywords:\n  - hasło\nsourceUrl: https://x/1\ncheckedAt: 2026-01-01\n---\nZmiana hasła poczty.\n"


def corpus(base):
    files = {"mail.md": ARTICLE.encode(), "sub/plain.txt": b"Drukarka nie drukuje.", "crlf.md": ARTICLE.replace("\n", "\r\n").encode(), "bad.txt": b"\xff\xfe", "image.png": b"x", ".git/c.md": b"x", "open.md": b"---\ntitle: x\n", "yaml.md": b"---\nquestions: [a\n---\nx", "after.md": b"---\ntitle: a\n--- b\nx", "empty.md": b"  \n"}
    for name, data in files.items():
        at = base / name
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_bytes(data)


def test_scan_and_index(spark, tmp_path):
    corpus(tmp_path / "docs")
    scanned = articles.scan(spark, str(tmp_path / "docs"))
    got = {r["path"]: r for r in scanned.collect()}
    assert set(got) == {"mail.md", "sub/plain.txt", "crlf.md", "bad.txt", "open.md", "yaml.md", "after.md", "empty.md"}
    assert {p for p, r in got.items() if r["reason"]} == {"bad.txt", "open.md", "yaml.md", "after.md"}
    assert got["mail.md"]["meta"]["questions"] == ["Jak zmienić hasło poczty?"] and got["mail.md"]["text"] == got["crlf.md"]["text"] == "Zmiana hasła poczty.\n"
    assert got["sub/plain.txt"]["meta"] is None
    c = config.Config(docs_dir=str(tmp_path / "docs"), db_path=str(tmp_path / "index"), answer=config.Answer(mode="fragments"), unanswered_log=str(tmp_path / "log"), server=config.Server("127.0.0.1:0"), search=config.Search(min_score=0.3))
    stats, skipped = build_index(spark, c, embedding.HashingEmbedder())
    assert (stats.indexed, stats.chunks, stats.skipped) == (3, 7, 5) and skipped.where("path = 'empty.md'").first()["reason"] == "no text"
    (tmp_path / "docs/sub/plain.txt").unlink()
    (tmp_path / "docs/crlf.md").write_text("Nowa treść.")
    stats, _ = build_index(spark, c, embedding.HashingEmbedder())
    assert (stats.indexed, stats.unchanged, stats.deleted) == (1, 1, 1)
    assert Store(spark, c.db_path).manifest().snapshot == 2
    service = server(Engine(spark, c, embedding.HashingEmbedder()))
    threading.Thread(target=service.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{service.server_address[1]}"
    try:
        assert json.load(urlopen(f"{url}/healthz"))["chunks"] == 4
        assert json.load(urlopen(Request(f"{url}/ask", json.dumps({"question": "jak zmienić hasło poczty"}).encode())))["answered"]
        assert json.load(urlopen(Request(f"{url}/ask", json.dumps({"question": "how to cook"}).encode())))["reason"] == "language"
        for body in (b"no json", b'{"question": " "}'):
            with pytest.raises(HTTPError) as e:
                urlopen(Request(f"{url}/ask", body))
            assert e.value.code == 400
    finally:
        service.shutdown()
    assert [json.loads(r["value"])["reason"] for r in spark.read.text(c.unanswered_log).collect()] == ["language"]


def test_config(tmp_path, monkeypatch):
    path = tmp_path / "c.yaml"
    path.write_text("search:\n  top_k: 3\nanswer:\n  mode: fragments\nembedding:\n  api_key: $KEY\n")
    monkeypatch.setenv("KEY", "secret")
    c = config.load(str(path))
    assert (c.search.top_k, c.search.min_score, c.embedding.api_key) == (3, 0.5, "secret")
    path.write_text("chunk_chars: 5\nanswer:\n  mode: x\n")
    with pytest.raises(ValueError, match="chunk_chars.*; .*answer.mode"):
        config.load(str(path))
    with pytest.raises(FileNotFoundError):
        config.load(str(tmp_path / "none.yaml"))
    assert config.load(None, str(tmp_path / "none.yaml")) == config.Config()


def test_labelled_questions(spark, tmp_path):
    path = tmp_path / "q.jsonl"
    path.write_text('{"q": "a", "relevant": ["x"]}\n\n{"q": "b", "other": 1}\n')
    assert [(r["q"], r["relevant"]) for r in questions.read_labelled(spark, str(path)).collect()] == [("a", ["x"]), ("b", [])]
    path.write_text('{"q": " "}\n')
    with pytest.raises(PySparkException, match="bad question line"):
        questions.read_labelled(spark, str(path)).collect()


class Models(BaseHTTPRequestHandler):
    broken = False

    def do_POST(self):
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        if self.path.endswith("/embeddings"):
            vectors = [[float(len(t)), 1.0, 2.0] if not (self.broken and len(body["input"]) > 1) else [0.0, 1.0, -5.0 * i] for i, t in enumerate(body["input"])]
            out = {"data": [{"index": i, "embedding": v} for i, v in reversed(list(enumerate(vectors)))]}
        elif "fail" in body["messages"][1]["content"]:
            self.send_response(500), self.end_headers(), self.wfile.write(b"x" * 400)
            return
        else:
            out = {"choices": [{"message": {"content": " odpowiedź "}}]}
        self.send_response(200), self.end_headers(), self.wfile.write(json.dumps(out).encode())

    def log_message(self, *_):
        pass


def test_http_models(spark):
    http = HTTPServer(("127.0.0.1", 0), Models)
    threading.Thread(target=http.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{http.server_address[1]}/v1"
    try:
        e = embedding.HttpEmbedder(url, "m", dims=2, batch_size=2)
        got = e.embed(spark.createDataFrame([(1, "abc"), (2, "abcd"), (3, None)], "id int, t string").coalesce(1), "t").orderBy("id").collect()
        assert got[0]["vec"] == pytest.approx([3 / 10**0.5, 1 / 10**0.5], abs=1e-6) and got[2]["vec"] == [0.0, 1.0]
        assert embedding.checked_batch_size(e, "a", "bc").batch_size == 2
        Models.broken = True
        assert embedding.checked_batch_size(e, "a", "bc").batch_size == 1
        chat = answering.HttpChatter(url, "m")
        assert chat.ask("s", "p") == ("odpowiedź", None)
        reply, error = chat.ask("s", "fail")
        assert reply is None and "status 500" in error and error.endswith("...")
    finally:
        http.shutdown()


def test_streams(spark, tmp_path):
    docs = spark.createDataFrame(DOCS, "path string, title string, url string")
    chunks = index(spark, ROWS)
    spark.createDataFrame([(1, "jak zmienić hasło poczty"), (2, "how do I print")], "qid bigint, question string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("qid bigint, question string").parquet(str(tmp_path / "in"))
    c = config.Config(answer=config.Answer(mode="fragments"), search=config.Search(min_score=0.3))
    jobs.answer_stream(stream, lambda: (docs, chunks), c, embedding.HashingEmbedder(), lambda df, n: df.write.mode("append").parquet(str(tmp_path / "out")), str(tmp_path / "cp")).awaitTermination()
    assert {r["qid"]: r["answered"] for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {1: True, 2: False}
    source = "/root/testdata/sf0.001/ask_requests.parquet"
    spark.read.parquet(source).coalesce(1).write.parquet(str(tmp_path / "requests"))
    live = spark.readStream.schema(spark.read.parquet(source).schema).parquet(str(tmp_path / "requests"))
    query = jobs.without_redeliveries(live).writeStream.format("memory").queryName("once").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp2")).start()
    query.awaitTermination()
    assert spark.table("once").count() == spark.read.parquet(source).select("request_id").distinct().count()
    log = spark.read.parquet("/root/testdata/sf0.001/unanswered_log.parquet")
    log.coalesce(1).write.parquet(str(tmp_path / "logged"))
    timed = jobs.reasons_by_window(spark.readStream.schema(log.schema).parquet(str(tmp_path / "logged")), "1 day")
    timed.writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp3")).start().awaitTermination()
    assert sorted(map(tuple, spark.table("windows").collect())) == sorted(map(tuple, jobs.reasons_by_window(log, "1 day").collect()))
