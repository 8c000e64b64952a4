"""Registered queries of the core, over the tables of a data directory, and their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from helpdex.functions import text as tx
from helpdex.functions.language_gate import OTHER_WORDS, POLISH_LETTERS, POLISH_WORDS, is_polish
from helpdex.functions.vectors import defect, normalized
from helpdex.operators import answering, calibration, chunking, retrieval, sync
from helpdex.operators.embedding import HashingEmbedder
from helpdex.operators.indexing import described
from helpdex.plans.neighbours import cosine_neighbours
from helpdex.sources.config import Answer, Config
from helpdex.sources.questions import parsed_log
from helpdex.sources.tables import table
from helpdex.streaming.jobs import reasons_by_window, without_redeliveries

FLAGSHIP = "doc_rank_topk"
CONFIG = Config(answer=Answer(mode="fragments"))
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query under ``name`` with its SQL."""

    def add(run):
        QUERIES[name] = run
        if sql:
            SQL[name] = sql
        return run

    return add


def articles(spark: SparkSession, data_dir: str) -> DataFrame:
    """Articles once each: the columns of ``described``. Readings of a path differ in read_at only, so any stands for all."""
    return described(table(spark, data_dir, "articles").select("path", "text", "hash", "meta").dropDuplicates(["path"]))


def chunk_rows(spark: SparkSession, data_dir: str) -> DataFrame:
    """Chunks without the rows written twice."""
    return table(spark, data_dir, "chunks").select("id", "path", "ord", "kind", "text").dropDuplicates(["id"])


def index_rows(spark: SparkSession, data_dir: str) -> DataFrame:
    """(path, ord, kind, text, vec) of all chunks, embedded offline."""
    return HashingEmbedder().embed(chunk_rows(spark, data_dir).drop("id"), "text")


def asked(spark: SparkSession, data_dir: str) -> DataFrame:
    """(qid, question): the stated query set of searches, requests whose id is divisible by 100."""
    rows = table(spark, data_dir, "ask_requests").select(F.col("request_id").alias("qid"), "question").where("qid % 100 = 0 and trim(question) != ''")
    return rows.dropDuplicates(["qid"])


def asked_vectors(spark: SparkSession, data_dir: str) -> DataFrame:
    return HashingEmbedder().embed(asked(spark, data_dir), "question").select("qid", F.col("vec").alias("qvec"))


def ranked(spark: SparkSession, data_dir: str) -> DataFrame:
    return retrieval.retrieve(asked_vectors(spark, data_dir), index_rows(spark, data_dir))


# SQL pieces -----------------------------------------------------------------------------------------------------------

_W = r"\s\x0B\p{Z}\x{85}"


def _trim(x: str) -> str:
    return rf"regexp_replace({x}, '\A[{_W}]+|[{_W}]+\z', '', 'g')"


_GOOD = "vec IS NOT NULL AND len(list_filter(vec, lambda v: v IS NULL OR isnan(v) OR isinf(v))) = 0 AND len(list_filter(vec, lambda v: v <> 0)) > 0"
_UNIT = "list_transform({v}, lambda x: CAST(round(CAST(CAST(x AS DOUBLE) / sqrt(list_sum(list_transform({v}, lambda y: CAST(y AS DOUBLE) * CAST(y AS DOUBLE)))) AS FLOAT), 6) AS DOUBLE))"
_CHUNKS = "SELECT DISTINCT id, path, ord, kind, text FROM chunks"
_ARTICLES = "SELECT DISTINCT path, text, hash, meta FROM articles"
_ASKED = "SELECT DISTINCT request_id AS qid, question FROM ask_requests WHERE request_id % 100 = 0 AND trim(question) <> ''"


def _bag(rows: str, key: str, text: str) -> str:
    """CTE bodies: words of ``rows``, their buckets, and unit weights by bucket."""
    return rf"""
        SELECT k, bucket, CAST(n / sqrt(sum(n * n) OVER (PARTITION BY k)) AS FLOAT) AS v
        FROM (
            SELECT t.k, coalesce(b.bucket, 0) AS bucket, CAST(count(*) AS DOUBLE) AS n
            FROM (
                SELECT k, unnest(CASE WHEN len(ws) = 0 THEN [''] ELSE ws END) AS w
                FROM (SELECT {key} AS k, list_filter(regexp_extract_all(lower(coalesce({text}, '')), '\p{{L}}+|\p{{N}}+'), lambda x: length(x) >= 3) AS ws FROM ({rows}))
            ) t LEFT JOIN buckets b ON t.w = b.w
            GROUP BY ALL
        )"""


def _buckets(*sources: tuple[str, str]) -> str:
    words = " UNION ".join(rf"SELECT unnest(regexp_extract_all(lower({text}), '\p{{L}}+|\p{{N}}+')) AS w FROM ({rows})" for rows, text in sources)
    byte = "CAST((instr('0123456789ABCDEF', substr(h, 2 * i + 1, 1)) - 1) * 16 + instr('0123456789ABCDEF', substr(h, 2 * i + 2, 1)) - 1 AS UBIGINT)"
    return f"""
        SELECT w, CAST(list_reduce(list_prepend(CAST(2166136261 AS UBIGINT), list_transform(range(length(h) // 2), lambda i: {byte})), lambda s, c: (xor(s, c) * CAST(16777619 AS UBIGINT)) % CAST(4294967296 AS UBIGINT)) % 64 AS INTEGER) AS bucket
        FROM (SELECT w, hex(encode(w)) AS h FROM (SELECT DISTINCT w FROM ({words})) WHERE length(w) >= 3)"""


def _retrieval(questions: str, text: str) -> str:
    """CTEs up to ``docrank``: (qid, path, score, rank) of all documents."""
    return f"""
        buckets AS ({_buckets((questions, text), (_CHUNKS, 'text'))}),
        q AS ({_bag(questions, 'qid', text)}),
        e AS ({_bag(_CHUNKS, 'id', 'text')}),
        hit AS (SELECT q.k AS qid, e.k AS id, round(sum(CAST(q.v AS DOUBLE) * CAST(e.v AS DOUBLE)), 9) AS score FROM q JOIN e USING (bucket) GROUP BY ALL),
        scored AS (SELECT qid, c.path, c.ord, c.kind, c.text, score FROM hit JOIN ({_CHUNKS}) c USING (id)),
        docscore AS (SELECT qid, path, max(score) AS score FROM scored GROUP BY ALL),
        docrank AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, path) AS rank FROM docscore)"""


_RANKED = f"""
    WITH {_retrieval(_ASKED, 'question')},
    top AS (SELECT * FROM docrank WHERE rank <= 5),
    body AS (
        SELECT qid, path, string_agg(text, chr(10) || chr(10) ORDER BY ord) AS text
        FROM (SELECT s.*, row_number() OVER (PARTITION BY s.qid, s.path ORDER BY s.score DESC, s.ord) AS r FROM scored s JOIN top USING (qid, path) WHERE s.kind = 'text')
        WHERE r <= 3 GROUP BY ALL),
    ranked AS (
        SELECT top.qid, rank, top.path, top.score, coalesce(body.text, '') AS text, coalesce(d.title, '') AS title, coalesce(d.url, '') AS url
        FROM top LEFT JOIN body USING (qid, path) LEFT JOIN (SELECT path, any_value(title) AS title, any_value(url) AS url FROM docs GROUP BY path) d ON top.path = d.path),
    kept AS (SELECT *, score >= 0.5 AND score >= max(score) OVER (PARTITION BY qid) - CAST(0.05 AS DOUBLE) AS ok FROM ranked)
"""


# vectors ----------------------------------------------------------------------------------------------------------------


def scaled_chunks(spark: SparkSession, data_dir: str, dims: int) -> DataFrame:
    """(id, unit) of every usable vector; rows written twice are found by a hash of the vector, not by all its values."""
    rows = table(spark, data_dir, "chunks").select("id", "vec").where(defect(F.col("vec"), dims).isNull())
    once = rows.withColumn("h", F.xxhash64("vec")).dropDuplicates(["id", "h"])
    return once.select("id", F.transform(normalized(F.col("vec"), dims), lambda x: F.round(x, 6).cast("double")).alias("unit"))


@query("vec_normalize", f"SELECT DISTINCT id, {_UNIT.format(v='vec')} AS unit FROM chunks WHERE {_GOOD}")
def vec_normalize(spark, data_dir):
    """Chunk vectors scaled to length one."""
    return scaled_chunks(spark, data_dir, 0)


@query("vec_truncate_normalize", f"SELECT DISTINCT id, {_UNIT.format(v='vec[1:16]')} AS unit FROM (SELECT id, vec[1:16] AS vec FROM chunks WHERE len(vec) >= 16) WHERE {_GOOD}")
def vec_truncate_normalize(spark, data_dir):
    """The first 16 dimensions of the chunk vectors, scaled to length one."""
    return scaled_chunks(spark, data_dir, 16)


@query("vec_defects", """SELECT reason, count(*) AS chunks FROM (SELECT DISTINCT id, CASE
    WHEN vec IS NULL OR len(vec) = 0 THEN 'null' WHEN len(vec) < 64 THEN 'too short'
    WHEN len(list_filter(vec, lambda v: v IS NULL OR isnan(v) OR isinf(v))) > 0 THEN 'not finite' WHEN len(list_filter(vec, lambda v: v <> 0)) = 0 THEN 'zero' END AS reason FROM chunks)
    WHERE reason IS NOT NULL GROUP BY reason""")
def vec_defects(spark, data_dir):
    """Chunks whose vector can't be used, by reason."""
    rows = table(spark, data_dir, "chunks").select("id", defect(F.col("vec"), 64).alias("reason")).where("reason is not null").distinct()
    return rows.groupBy("reason").agg(F.count(F.lit(1)).alias("chunks"))


@query("cosine_topk", f"""
    WITH c AS (SELECT DISTINCT ON (id) id, kind, vec, sqrt(list_sum(list_transform(vec, lambda y: CAST(y AS DOUBLE) * CAST(y AS DOUBLE)))) AS l FROM chunks WHERE len(vec) = 64 AND {_GOOD}),
    s AS (SELECT a.id, b.id AS neighbour, round(list_dot_product(CAST(a.vec AS DOUBLE[]), CAST(b.vec AS DOUBLE[])) / (a.l * b.l), 9) AS cosine FROM c a JOIN c b ON a.kind = b.kind AND a.id <> b.id WHERE a.id % 100 = 0)
    SELECT id, rank, neighbour, round(cosine, 6) AS cosine FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY cosine DESC, neighbour) AS rank FROM s) WHERE rank <= 5""")
def cosine_topk(spark, data_dir):
    """The 5 chunks of the same kind nearest to each chunk whose id is divisible by 100, exactly."""
    found = cosine_neighbours(table(spark, data_dir, "chunks"), F.col("id") % 100 == 0, 5)
    return found.select("id", F.col("rank").cast("long").alias("rank"), "neighbour", F.round("cosine", 6).alias("cosine"))


# retrieval and policy ----------------------------------------------------------------------------------------------------


@query("doc_rank_topk", _RANKED + "SELECT qid, rank, path, title, url, round(score, 6) AS score FROM ranked")
def doc_rank_topk(spark, data_dir):
    """The 5 best documents of each request with title and address."""
    hits = retrieval.with_document(ranked(spark, data_dir), table(spark, data_dir, "docs"))
    return hits.select("qid", F.col("rank").cast("long").alias("rank"), "path", "title", "url", F.round("score", 6).alias("score"))


@query("doc_body_best3", _RANKED + "SELECT qid, rank, path, text FROM ranked")
def doc_body_best3(spark, data_dir):
    """The text that stands for each of those documents: its three best body chunks in their order."""
    return ranked(spark, data_dir).select("qid", F.col("rank").cast("long").alias("rank"), "path", "text")


@query("relevance_policy", _RANKED + "SELECT qid, rank, path FROM kept WHERE ok")
def relevance_policy(spark, data_dir):
    """The documents of each request that pass min_score and max_gap."""
    hits = retrieval.relevant(ranked(spark, data_dir), CONFIG.search.min_score, CONFIG.search.max_gap)
    return hits.select("qid", F.col("rank").cast("long").alias("rank"), "path")


_LISTS = {"pl": POLISH_WORDS, "ot": OTHER_WORDS}
_HITS = {k: "len(list_filter(words, lambda w: list_contains([" + ", ".join("'" + w.replace("'", "''") + "'" for w in sorted(set(v.split()))) + "], w)))" for k, v in _LISTS.items()}


def _gate(rows: str, text: str) -> str:
    """``rows`` with ``polish``."""
    return rf"""
        SELECT *, letters > 0 AND latin * 10 >= letters * 7 AND (regexp_matches(low, '[{POLISH_LETTERS}]') OR {_HITS['ot']} <= {_HITS['pl']}) AS polish
        FROM (SELECT *, length(regexp_replace(x, '\P{{L}}', '', 'g')) AS letters, length(regexp_replace(x, '[^\p{{Latin}}]|\P{{L}}', '', 'g')) AS latin, lower(x) AS low, regexp_extract_all(lower(x), '\p{{L}}+') AS words
              FROM (SELECT *, coalesce({text}, '') AS x FROM ({rows})))"""


@query("lang_gate", f"SELECT entry_id, polish FROM ({_gate('SELECT entry_id, q FROM unanswered_log', 'q')})")
def lang_gate(spark, data_dir):
    """The gate's decision for every logged question."""
    return table(spark, data_dir, "unanswered_log").select("entry_id", is_polish(F.col("q")).alias("polish"))


@query("lang_gate_by_lang", f"SELECT lang, polish, count(*) AS documents FROM ({_gate('SELECT lang, text FROM documents', 'text')}) GROUP BY ALL")
def lang_gate_by_lang(spark, data_dir):
    """The gate's decisions for documents by their label."""
    return table(spark, data_dir, "documents").select("lang", is_polish(F.col("text")).alias("polish")).groupBy("lang", "polish").agg(F.count(F.lit(1)).alias("documents"))


# tokens, embedding, chunking ------------------------------------------------------------------------------------------------


@query("tokenize_counts", r"""SELECT word, count(*) AS uses, count(DISTINCT doc_id) AS documents FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '\p{L}+|\p{N}+')) AS word FROM documents)
    WHERE length(word) >= 3 GROUP BY word""")
def tokenize_counts(spark, data_dir):
    """Uses of each word and documents that have it."""
    words = table(spark, data_dir, "documents").select("doc_id", F.explode(tx.word_tokens(F.col("text"))).alias("word"))
    by_doc = words.groupBy("word", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    return by_doc.groupBy("word").agg(F.sum("n").alias("uses"), F.count(F.lit(1)).alias("documents"))


_DOC_TEXT = "SELECT doc_id, text FROM documents"


@query("bow_embed", f"WITH buckets AS ({_buckets((_DOC_TEXT, 'text'))}) SELECT k AS doc_id, CAST(bucket AS BIGINT) AS bucket, round(CAST(v AS DOUBLE), 6) AS weight FROM ({_bag(_DOC_TEXT, 'doc_id', 'text')})")
def bow_embed(spark, data_dir):
    """The offline embedding of every document by its non-zero buckets."""
    rows = HashingEmbedder().embed(table(spark, data_dir, "documents").select("doc_id", "text"), "text")
    return rows.select("doc_id", F.posexplode("vec").alias("b", "v")).where("v != 0").select("doc_id", F.col("b").cast("long").alias("bucket"), F.round(F.col("v").cast("double"), 6).alias("weight"))


_PARAS = rf"SELECT path, list_filter(list_transform(string_split_regex(replace(text, chr(13) || chr(10), chr(10)), '\n[ \t]*\n'), lambda p: {_trim('p')}), lambda p: p <> '') AS ps FROM (SELECT DISTINCT path, text FROM articles WHERE text IS NOT NULL)"


@query("paragraph_split", f"SELECT path, CAST(unnest(range(len(ps))) AS BIGINT) AS ord, unnest(ps) AS paragraph FROM ({_PARAS})")
def paragraph_split(spark, data_dir):
    """The paragraphs of every article."""
    rows = articles(spark, data_dir).select("path", F.posexplode(tx.paragraphs(F.col("text"))).alias("ord", "paragraph"))
    return rows.select("path", F.col("ord").cast("long").alias("ord"), "paragraph")


_SENTS = rf"list_filter(list_transform(string_split(regexp_replace(para, '([.!?…])[\t\n\f\r ]+', '\1' || chr(1), 'g'), chr(1)), lambda s: {_trim('s')}), lambda s: s <> '')"


@query("sentence_split", f"SELECT path, CAST(sum(len(ss)) AS BIGINT) AS sentences, CAST(max(list_max(list_transform(ss, lambda s: length(s)))) AS BIGINT) AS longest FROM (SELECT path, {_SENTS} AS ss FROM (SELECT path, unnest(ps) AS para FROM ({_PARAS}))) GROUP BY path")
def sentence_split(spark, data_dir):
    """Sentences of every article and the length of the longest."""
    rows = articles(spark, data_dir).select("path", F.explode(tx.paragraphs(F.col("text"))).alias("p")).select("path", F.explode(tx.sentences(F.col("p"))).alias("s"))
    return rows.groupBy("path").agg(F.count(F.lit(1)).alias("sentences"), F.max(F.length("s")).cast("long").alias("longest"))


def _chunked_sql(final: str) -> str:
    """The chunking rules in SQL: hard cuts peeled off recursively, then two ordered folds."""
    trim_head, trim_rest = _trim("substr(rest, 1, cut)"), _trim("substr(rest, cut + 1)")

    def fold(glue: str, cost: int) -> str:
        return f"""list_reduce(parts, lambda a, x: CASE
            WHEN x.hard THEN {{'done': a.done || CASE WHEN a.cur = '' THEN CAST([] AS VARCHAR[]) ELSE [a.cur] END || [x.cur], 'cur': '', 'hard': false}}
            WHEN a.cur = '' THEN {{'done': a.done, 'cur': x.cur, 'hard': false}}
            WHEN length(a.cur) + {cost} + length(x.cur) > 1200 THEN {{'done': a.done || [a.cur], 'cur': x.cur, 'hard': false}}
            ELSE {{'done': a.done, 'cur': a.cur || {glue} || x.cur, 'hard': false}} END)"""

    first = "{'done': CAST([] AS VARCHAR[]), 'cur': '', 'hard': false}"
    ends = "list_filter(f.done || [f.cur], lambda x: x <> '')"
    return rf"""
    WITH RECURSIVE paras AS (SELECT path, unnest(range(len(ps))) AS pi, unnest(ps) AS para FROM ({_PARAS})),
    el AS (SELECT path, pi, unnest(range(len(ss))) AS si, unnest(ss) AS s FROM (SELECT path, pi, CASE WHEN length(para) <= 1200 THEN [para] ELSE {_SENTS} END AS ss FROM paras)),
    peel AS (
        SELECT path, pi, si, 0 AS k, CAST(NULL AS VARCHAR) AS piece, s AS rest FROM el
        UNION ALL
        SELECT path, pi, si, k + 1, {trim_head}, {trim_rest}
        FROM (SELECT *, CASE WHEN 1199 - length(regexp_extract(substr(rest, 1, 1200), '[^ \n\t]*$')) > 600 THEN 1199 - length(regexp_extract(substr(rest, 1, 1200), '[^ \n\t]*$')) ELSE 1200 END AS cut FROM peel WHERE length(rest) > 1200)),
    bits AS (
        SELECT path, pi, si, k, piece AS cur, true AS hard FROM peel WHERE piece IS NOT NULL
        UNION ALL
        SELECT path, pi, si, k + 1000000, rest, false FROM peel WHERE length(rest) <= 1200 AND rest <> ''),
    pieces AS (
        SELECT path, pi, {ends} AS out FROM (SELECT path, pi, {fold("' '", 1)} AS f FROM (
            SELECT path, pi, list_prepend({first}, list({{'done': CAST([] AS VARCHAR[]), 'cur': cur, 'hard': hard}} ORDER BY si, k)) AS parts FROM bits GROUP BY path, pi))),
    flat AS (SELECT path, pi, unnest(range(len(out))) AS k, unnest(out) AS cur FROM pieces),
    body AS (
        SELECT path, {ends} AS chunks FROM (SELECT path, {fold("chr(10) || chr(10)", 2)} AS f FROM (
            SELECT path, list_prepend({first}, list({{'done': CAST([] AS VARCHAR[]), 'cur': cur, 'hard': false}} ORDER BY pi, k)) AS parts FROM flat GROUP BY path)))
    {final}"""


@query("chunk_articles", _chunked_sql("SELECT path, CAST(unnest(range(len(chunks))) AS BIGINT) AS ord, unnest(chunks) AS text FROM body"))
def chunk_articles(spark, data_dir):
    """The chunks of every article, at most 1200 characters each."""
    rows = articles(spark, data_dir).select("path", F.posexplode(chunking.chunked(F.col("text"))).alias("ord", "text"))
    return rows.select("path", F.col("ord").cast("long").alias("ord"), "text")


_STEM = r"regexp_replace(list_last(string_split(path, '/')), '\.[^.]*$', '')"


def _filled(column: str) -> str:
    return f"list_filter(list_transform(coalesce(meta.{column}, CAST([] AS VARCHAR[])), lambda q: {_trim('q')}), lambda q: q IS NOT NULL AND q <> '')"



@query("index_entries", _chunked_sql(f"""
    , m AS (SELECT path, coalesce(nullif(meta.title, ''), {_STEM}) AS title, {_filled('questions')} AS qs, {_filled('keywords')} AS ks FROM ({_ARTICLES})),
    listed AS (SELECT path, title, chunks || qs || CASE WHEN len(ks) > 0 THEN [array_to_string(ks, ', ')] ELSE CAST([] AS VARCHAR[]) END AS texts, len(chunks) AS bodies FROM body JOIN m USING (path) WHERE len(chunks) > 0)
    SELECT path, ord, CASE WHEN ord < bodies THEN 'text' ELSE 'question' END AS kind, text,
           CASE WHEN ord < bodies THEN 'title: ' || title || ' | text: ' ELSE 'task: search result | query: ' END || text AS embed_text
    FROM (SELECT path, title, bodies, CAST(unnest(range(len(texts))) AS BIGINT) AS ord, unnest(texts) AS text FROM listed)"""))
def index_entries(spark, data_dir):
    """Every entry that the index of the articles has, with the text to embed."""
    return chunking.entries(articles(spark, data_dir)).withColumn("ord", F.col("ord").cast("long"))


@query("article_labels", f"SELECT path, coalesce(nullif(meta.title, ''), {_STEM}) AS title, coalesce(meta.source_url, '') AS url FROM ({_ARTICLES})")
def article_labels(spark, data_dir):
    """Title and address of every article."""
    return articles(spark, data_dir).select("path", "title", "url")


@query("content_hash", "SELECT path, sha256(text) AS computed, sha256(text) = hash AS same FROM (SELECT DISTINCT path, text, hash FROM articles)")
def content_hash(spark, data_dir):
    """The content hash of every article, and whether it is the stored one."""
    return articles(spark, data_dir).select("path", F.sha2(F.col("text").cast("binary"), 256).alias("computed")).join(articles(spark, data_dir).select("path", "hash"), "path").select("path", "computed", (F.col("computed") == F.col("hash")).alias("same"))


# synchronisation ---------------------------------------------------------------------------------------------------------------

_LATEST = f"SELECT path, any_value(hash) AS hash, coalesce(nullif(any_value(meta.title), ''), {_STEM}) AS title, coalesce(any_value(meta.source_url), '') AS url FROM articles GROUP BY path"
_ACTIONS = f"""SELECT coalesce(n.path, o.path) AS path, CASE WHEN o.path IS NULL THEN 'insert' WHEN n.path IS NULL THEN CASE WHEN o.path LIKE '%.pdf' THEN 'keep' ELSE 'delete' END WHEN n.hash = o.hash THEN 'unchanged' ELSE 'update' END AS action
    FROM ({_LATEST}) n FULL JOIN docs o ON n.path = o.path"""


def latest_articles(spark, data_dir) -> DataFrame:
    rows = table(spark, data_dir, "articles")
    return sync.latest(rows.select("path", "hash", tx.title_of(F.col("meta.title"), F.col("path")).alias("title"), tx.or_empty(F.col("meta.source_url")).alias("url"), "read_at"))


def planned(spark, data_dir) -> DataFrame:
    """Actions that bring docs up to the articles; stored PDFs could not be read again."""
    stored = table(spark, data_dir, "docs")
    return sync.actions(latest_articles(spark, data_dir), stored, stored.where(F.col("path").endswith(".pdf")).select("path"))


@query("sync_actions", _ACTIONS)
def sync_actions(spark, data_dir):
    """What has to happen to each path."""
    return planned(spark, data_dir)


@query("sync_stats", f"SELECT count(*) FILTER (action IN ('insert', 'update')) AS indexed, count(*) FILTER (action = 'unchanged') AS unchanged, count(*) FILTER (action = 'delete') AS deleted FROM ({_ACTIONS})")
def sync_stats(spark, data_dir):
    """The counts of a synchronisation."""
    return sync.stats(planned(spark, data_dir))


@query("sync_docs", f"""SELECT path, hash, title, url FROM docs JOIN ({_ACTIONS}) USING (path) WHERE action IN ('unchanged', 'keep')
    UNION ALL SELECT path, hash, title, url FROM ({_LATEST}) JOIN ({_ACTIONS}) USING (path) WHERE action IN ('insert', 'update')""")
def sync_docs(spark, data_dir):
    """The table of documents after the synchronisation."""
    return sync.merged(table(spark, data_dir, "docs"), planned(spark, data_dir), latest_articles(spark, data_dir))


@query("sync_kept_chunks", f"SELECT kind, count(*) AS chunks, count(DISTINCT path) AS paths FROM (SELECT DISTINCT id, path, kind FROM chunks) LEFT JOIN ({_ACTIONS}) USING (path) WHERE action IS NULL OR action IN ('unchanged', 'keep') GROUP BY kind")
def sync_kept_chunks(spark, data_dir):
    """Stored chunks that stay when chunks of deleted and changed paths are dropped."""
    gone = planned(spark, data_dir).where(F.col("action").isin(sync.DELETE, sync.UPDATE, sync.INSERT)).select("path")
    kept = table(spark, data_dir, "chunks").select("id", "path", "kind").distinct().join(gone, "path", "left_anti")
    per_path = kept.groupBy("kind", "path").agg(F.count(F.lit(1)).alias("n"))
    return per_path.groupBy("kind").agg(F.sum("n").alias("chunks"), F.count(F.lit(1)).alias("paths"))


# answers ------------------------------------------------------------------------------------------------------------------------


def answers(spark, data_dir) -> DataFrame:
    requests = table(spark, data_dir, "ask_requests").select(F.col("request_id").alias("qid"), "question").where("qid % 100 = 0").dropDuplicates(["qid"])
    return answering.ask(requests, index_rows(spark, data_dir), table(spark, data_dir, "docs"), CONFIG, HashingEmbedder())


_OPEN = f"SELECT qid, question FROM ({_gate(_ASKED, 'question')}) WHERE polish"
_FRAGMENT = "'[' || coalesce(nullif(title, ''), path) || ', ' || printf('%.2f', round_even(score, 2)) || ']' || chr(10) || text || CASE WHEN url <> '' THEN chr(10) || url ELSE '' END"


@query("ask_outcomes", _RANKED.replace(_ASKED, _OPEN) + f"""
    SELECT qid, false AS answered, CAST(NULL AS VARCHAR) AS reason, 0.0 AS top_score, '' AS top_path, 'empty question' AS error FROM (SELECT DISTINCT request_id AS qid, question FROM ask_requests WHERE request_id % 100 = 0 AND coalesce({_trim('question')}, '') = '')
    UNION ALL SELECT qid, false, 'language', 0.0, '', NULL FROM ({_gate(_ASKED, 'question')}) WHERE NOT polish
    UNION ALL SELECT qid, bool_or(ok), CASE WHEN bool_or(ok) THEN NULL ELSE 'below_threshold' END, round(max(score), 6), any_value(path) FILTER (rank = 1), NULL FROM kept GROUP BY qid""")
def ask_outcomes(spark, data_dir):
    """What becomes of each request: answered or not and why."""
    return answers(spark, data_dir).select("qid", "answered", "reason", F.round("top_score", 6).alias("top_score"), "top_path", "error")


@query("render_prompt", _RANKED.replace(_ASKED, _OPEN) + """
    SELECT k.qid, 'Knowledge base articles:' || chr(10) || chr(10) || string_agg('[' || n || '] ' || coalesce(nullif(title, ''), path) || ' (' || path || ')' || chr(10) || text || chr(10) || chr(10), '' ORDER BY rank) || 'Question: ' || any_value(question) AS prompt
    FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rank) AS n FROM kept WHERE ok) k JOIN (SELECT qid, """ + _trim("question") + f""" AS question FROM ({_ASKED})) a ON k.qid = a.qid GROUP BY k.qid""")
def render_prompt(spark, data_dir):
    """The prompt of each request that has sources."""
    return answers(spark, data_dir).where(F.size("sources") > 0).select("qid", answering.prompt(F.col("question"), F.col("sources")).alias("prompt"))


@query("ask_fragments", _RANKED.replace(_ASKED, _OPEN) + f"SELECT qid, string_agg({_FRAGMENT}, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS answer FROM kept WHERE ok GROUP BY qid")
def ask_fragments(spark, data_dir):
    """The answers of the requests that get one."""
    return answers(spark, data_dir).where("answered").select("qid", "answer")


# the log ------------------------------------------------------------------------------------------------------------------------


@query("raw_log_parsed", """SELECT line_id, CASE WHEN json_valid(line) THEN json_extract_string(line, '$.q') END AS q, CASE WHEN json_valid(line) THEN json_extract_string(line, '$.reason') END AS reason,
    CASE WHEN json_valid(line) THEN CAST(json_extract_string(line, '$.top_score') AS DOUBLE) END AS top_score, CASE WHEN json_valid(line) THEN json_extract_string(line, '$.top_path') END AS top_path, json_valid(line) AS ok FROM raw_log""")
def raw_log_parsed(spark, data_dir):
    """The entries of the raw log; lines that are not JSON are marked."""
    return parsed_log(table(spark, data_dir, "raw_log")).drop("time")


@query("unanswered_triage", "SELECT coalesce(nullif(trim(top_path), ''), '') AS top_path, reason, count(*) AS entries, round(avg(top_score), 6) AS mean_score FROM unanswered_log GROUP BY ALL")
def unanswered_triage(spark, data_dir):
    """Where unanswered questions end: entries and mean score by nearest document and reason."""
    log = table(spark, data_dir, "unanswered_log").withColumn("top_path", F.trim(tx.or_empty(F.col("top_path"))))
    return log.groupBy("top_path", "reason").agg(F.count(F.lit(1)).alias("entries"), F.round(F.avg("top_score"), 6).alias("mean_score"))


@query("unanswered_by_day", "SELECT CAST(date_trunc('day', time) AS TIMESTAMP) AS start, reason, count(*) AS entries FROM unanswered_log WHERE time IS NOT NULL GROUP BY ALL")
def unanswered_by_day(spark, data_dir):
    """Unanswered questions by day and reason."""
    return reasons_by_window(table(spark, data_dir, "unanswered_log")).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("requests_once", """SELECT request_id, client, status, answered FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY stored_at) AS r FROM ask_requests WHERE request_id IS NOT NULL) WHERE r = 1""")
def requests_once(spark, data_dir):
    """Requests without their redeliveries."""
    return without_redeliveries(table(spark, data_dir, "ask_requests")).select("request_id", "client", "status", "answered")


@query("client_health", """SELECT client, count(*) AS requests, count(*) FILTER (status <> 200) AS rejected, count(*) FILTER (answered) AS answered FROM
    (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY stored_at) AS r FROM ask_requests WHERE request_id IS NOT NULL) WHERE r = 1 GROUP BY client""")
def client_health(spark, data_dir):
    """Requests, rejections and answers by client."""
    once = without_redeliveries(table(spark, data_dir, "ask_requests"))
    return once.groupBy("client").agg(F.count(F.lit(1)).alias("requests"), F.count_if(F.col("status") != 200).alias("rejected"), F.count_if("answered").alias("answered"))


@query("index_health", "SELECT kind, count(*) AS chunks, count(DISTINCT path) AS paths, CAST(max(length(text)) AS BIGINT) AS longest FROM (SELECT DISTINCT id, path, kind, text FROM chunks) GROUP BY kind")
def index_health(spark, data_dir):
    """Chunks, documents and the longest chunk of the index by kind."""
    per_path = chunk_rows(spark, data_dir).groupBy("kind", "path").agg(F.count(F.lit(1)).alias("n"), F.max(F.length("text")).alias("l"))
    return per_path.groupBy("kind").agg(F.sum("n").alias("chunks"), F.count(F.lit(1)).alias("paths"), F.max("l").cast("long").alias("longest"))


# calibration --------------------------------------------------------------------------------------------------------------------

_LABELLED = "SELECT question_id AS qid, q, coalesce(relevant, CAST([] AS VARCHAR[])) AS relevant FROM labelled_questions"
_MEASURED = f"""
    WITH {_retrieval(_LABELLED, 'q')},
    measured AS (SELECT l.qid, len(relevant) > 0 AS in_base, score AS top_score, path AS top_path, list_contains(relevant, path) AS hit FROM ({_LABELLED}) l JOIN docrank d ON d.qid = l.qid AND d.rank = 1)"""
_CANDIDATES = """,
    scores AS (SELECT DISTINCT top_score AS s FROM measured),
    cand AS (
        SELECT min(s) - 0.01 AS value, 0.0 AS gap, 0 AS place FROM scores UNION ALL SELECT max(s) + 0.01, 0.0, 1 FROM scores
        UNION ALL SELECT (p + s) / 2, s - p, 2 FROM (SELECT s, lag(s) OVER (ORDER BY s) AS p FROM scores) WHERE p IS NOT NULL),
    judged AS (SELECT value, any_value(gap) AS gap, place, count(*) FILTER ((top_score >= value) = in_base) AS correct, count(*) AS total FROM cand CROSS JOIN measured GROUP BY value, place)"""


def measured(spark, data_dir) -> DataFrame:
    labelled = table(spark, data_dir, "labelled_questions").select(F.col("question_id").alias("qid"), "q", "relevant")
    return calibration.measure(HashingEmbedder().embed(labelled, "q").select("qid", "relevant", F.col("vec").alias("qvec")), index_rows(spark, data_dir))


@query("calibrate_measure", _MEASURED + " SELECT qid, in_base, round(top_score, 6) AS top_score, top_path, hit FROM measured")
def calibrate_measure(spark, data_dir):
    """The best document of every labelled question and whether it is a right one."""
    return measured(spark, data_dir).select("qid", "in_base", F.round("top_score", 6).alias("top_score"), "top_path", "hit")


@query("calibrate_summary", _MEASURED + " SELECT count(*) AS questions, count(*) FILTER (in_base) AS in_base, count(*) FILTER (in_base AND hit) AS hits, round(count(*) FILTER (in_base AND hit) / nullif(count(*) FILTER (in_base), 0), 6) AS hit_rate FROM measured")
def calibrate_summary(spark, data_dir):
    """The hit rate of the labelled questions."""
    return calibration.summary(measured(spark, data_dir))


@query("threshold_candidates", _MEASURED + _CANDIDATES + " SELECT round(value, 6) AS value, round(gap, 6) AS gap, correct, total FROM judged")
def threshold_candidates(spark, data_dir):
    """Every candidate threshold with the questions it judges right."""
    return calibration.candidates(measured(spark, data_dir)).select(F.round("value", 6).alias("value"), F.round("gap", 6).alias("gap"), "correct", "total")


@query("threshold_suggest", _MEASURED + _CANDIDATES + " SELECT round(value, 6) AS value, correct, total FROM judged ORDER BY correct DESC, gap DESC, place, value LIMIT 1")
def threshold_suggest(spark, data_dir):
    """The threshold that parts the labelled questions best."""
    return calibration.suggest(measured(spark, data_dir)).select(F.round("value", 6).alias("value"), "correct", "total")
