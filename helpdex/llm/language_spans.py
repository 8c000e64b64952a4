"""Languages of texts and of the spans of mixed texts.

Script ranges narrow the candidates of each word (Cyrillic words can only be Ukrainian, Latin ones any of the other
five), per-word scores rate them, and a Viterbi pass with a switching penalty (lower where a sentence begins) labels
spans. A language is *in* a text if one whole sentence, or a span of at least SPAN_WORDS telling words, is written in it.

Word scores are log probabilities of a word under each language, estimated from labelled documents: the labels are
noisy, so one further round re-estimates them from the spans the first model finds. At most SAMPLE_ROWS documents are
used for fitting (a documented bound, drawn by hash over all rows); everything else covers all rows. Words never seen
are scored by letter groups of the known words, and a short list of function words (SEEDS) stands in for the sample
where it is small. Words are also known without their diacritics.

Defined results: null, empty and blank texts, codes, log lines and other scripts have no language (empty list); repeated
rows repeat their result; confidence is between 0 and 1.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helpdex.plans.skew import cut
from helpdex.sources.tables import table

LANGS = ("pl", "en", "de", "uk", "es", "cs")
LATIN = [0, 1, 2, 4, 5]
#: Bounds of the fit: rows sampled and words kept.
SAMPLE_ROWS, VOCABULARY = 10_000, 60_000
#: Viterbi penalties for changing the language within a sentence and where one begins.
SWITCH, SWITCH_AT_START = 5.0, 2.0
#: A word tells if its best language is ahead of the next by MARGIN; a sentence needs TELLING such words.
MARGIN, TELLING, SPAN_WORDS = 1.0, 3, 5
FLOOR = 4.5
#: Characters without width that may stand inside a word.
HIDDEN = "\u200b\ufeff\u00ad"
TOKEN = re.compile(rf"[^\W_]+(?:[=:_\-]+[^\W_]*\d[^\W_]*)+|[^\W_]+(?:['’{HIDDEN}]+[^\W_]+)*|[.!?…]+(?=\s|$)|\n+|[{{}}=<>|&\\~^]+")
SKIP, BREAK, CODE = -1, -2, -3

#: Frequent function words.
SEEDS = {
    "pl": "i w na z do się nie że jest to jak po co od o za dla przez przy czy ale lub oraz już tylko bo kiedy gdzie dlaczego jeśli mam mogę można która który które są był była było może przed pod nad bez ich jego jej mi mnie tego tej tym aby żeby więc także ten ta te",
    "en": "the of and to in is that it for on with as are was this be at by not or from have an they which you were has been their can will would what when where why how if do does did my your i we she he his her its out up so no but about into than them then some could should there these those",
    "de": "der die das und in zu den ist nicht von mit dem des ein eine einen einem auf für im sich als auch es an werden aus er hat dass sie nach wird bei noch wie am um so nur oder aber vor wenn kann ich mein meine wir ihr ihre mich mir was warum wo welche zum zur über sind haben keine kein",
    "uk": "і в на з до не що це як та у за від для про його її вони ми ви він вона було але чи або коли де чому якщо мені мене який яка які тільки після перед без під",
    "es": "el la de que y en los las un una por con no para su al lo como más pero sus le ya o este sí porque esta entre cuando muy sin sobre también me hasta hay donde quien desde todo nos qué cómo dónde por mi mis está es son se del puedo puede tengo",
    "cs": "a v na se je že s z do to o i za pro ale jak po by od k ve už jen ze jako při která který které jsou jsem byl byla bylo bude nebo když proč kde kdy co mi mě můj moje není nejde mohu může tak než jeho její aby však podle před pod nad bez také ještě",
}


class Model(NamedTuple):
    """Scores of words and of letter groups; rows of ``scores`` are words, columns LANGS."""

    words: dict[str, int]
    scores: np.ndarray
    groups: dict[str, np.ndarray]


def plain(word: str) -> str:
    """``word`` without diacritics."""
    if word.isascii():
        return word
    return "".join(c for c in unicodedata.normalize("NFKD", word.translate(STROKES)) if not unicodedata.combining(c))


STROKES = str.maketrans("łđøæœß", "ldoaos")
UNHIDE = dict.fromkeys(map(ord, HIDDEN))


def label_code(label: Column) -> Column:
    """The part of a label before the first ``-`` or ``_``, in lower case; an empty string for null."""
    return F.lower(F.element_at(F.split(F.trim(F.coalesce(label, F.lit(""))), "[-_]"), 1))


def centred(counts: np.ndarray, mass: np.ndarray) -> np.ndarray:
    """Log probabilities relative to each word's best language, floored."""
    p = np.log((counts + 0.5) / (mass + 2000.0))
    return np.maximum(p - p.max(axis=1, keepdims=True), -FLOOR).astype(np.float32)


def letter_groups(word: str) -> list[str]:
    w = f"^{word}$"
    return [w[i : i + 3] for i in range(len(w) - 2)]


def build(counts: dict[str, np.ndarray]) -> Model:
    """A model from counts of words by language; SEEDS count as SEED occurrences each."""
    merged: dict[str, np.ndarray] = {}

    def add(word: str, c: np.ndarray) -> None:
        if word in merged:
            merged[word] = merged[word] + c
        else:
            merged[word] = c.astype(np.float64)

    for word, c in counts.items():
        add(word, c)
        if not word.isascii() and plain(word) != word and not CYRILLIC.search(word):
            add(plain(word), c)
    mass = sum(merged.values(), np.zeros(len(LANGS))) + 1000
    for k, lang in enumerate(LANGS):
        for word in SEEDS[lang].split():
            one = np.zeros(len(LANGS))
            one[k] = mass[k] / 500
            add(word, one)
            if plain(word) != word and not CYRILLIC.search(word):
                add(plain(word), one)
    names = list(merged)
    table_ = np.array([merged[w] for w in names]) if names else np.zeros((0, len(LANGS)))
    scores = centred(table_, table_.sum(axis=0))
    groups: dict[str, np.ndarray] = {}
    weights = np.log1p(table_)
    for word, w in zip(names, weights):
        if not CYRILLIC.search(word):
            for g in letter_groups(word):
                groups[g] = groups[g] + w if g in groups else w.copy()
    total = weights.sum(axis=0) * 5 + 100
    for g, w in groups.items():
        p = np.log((w + 0.3) / total)
        groups[g] = np.maximum(p - p[LATIN].max(), -2.5)
    return Model({w: i for i, w in enumerate(names)}, scores, groups)


CYRILLIC = re.compile(r"[Ѐ-ӿ]")
LATIN_LETTER = re.compile(r"[a-zß-ɏ]")
ONLY_UK = np.array([0.0 if lang == "uk" else -FLOOR for lang in LANGS], dtype=np.float32)


class Labeller:
    """Applies a model to batches of texts inside a task; keeps the scores of words it has met."""

    MOST_CACHED = 400_000

    def __init__(self, model: Model):
        self.model = model
        self.reset()

    def reset(self) -> None:
        self.ids: dict[str, int] = {}
        self.rows: list[np.ndarray] = []

    def row_of(self, word: str) -> int:
        """Id of the scores of a token, or SKIP, BREAK or CODE."""
        c = word[0]
        if c in ".!?…\n":
            return BREAK
        if c in "{}=<>|&\\~^":
            return CODE
        if any(map(str.isdigit, word)) or len(word) > 40:
            return SKIP
        if not word.isascii():
            word = word.translate(UNHIDE)
        cyrillic, latin = bool(CYRILLIC.search(word)), bool(LATIN_LETTER.search(word))
        if cyrillic == latin:
            return SKIP
        if cyrillic:
            scores = ONLY_UK
        else:
            at = self.model.words.get(word)
            if at is not None:
                scores = self.model.scores[at].copy()
            else:
                seen = [self.model.groups[g] for g in letter_groups(word) if g in self.model.groups]
                # letter groups tell less than words do
                scores = np.mean(seen, axis=0).astype(np.float32) * 0.8 if len(seen) > 1 else np.zeros(len(LANGS), np.float32)
                scores = scores - scores[LATIN].max()
            scores[3] = -FLOOR
        self.rows.append(scores)
        return len(self.rows) - 1

    def tokens(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all texts and the number of tokens of each."""
        if len(self.ids) > self.MOST_CACHED:
            self.reset()
        ids, flat, counts = self.ids, [], []
        for text in texts:
            found = TOKEN.findall(text.lower())
            counts.append(len(found))
            flat += found
        for word in set(flat).difference(ids):
            ids[word] = self.row_of(word)
        return np.fromiter(map(ids.__getitem__, flat), dtype=np.int32, count=len(flat)), np.array(counts, dtype=np.int64)

    def label(self, texts: list[str]) -> dict[str, np.ndarray]:
        """Viterbi labels of the scored tokens: ``at`` (token position), ``text``, ``sentence``, ``lang``, ``telling``, ``score``."""
        ids, counts = self.tokens(texts)
        text_of = np.repeat(np.arange(len(texts)), counts)
        first = np.zeros(len(ids), dtype=bool)
        starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
        first[starts[counts > 0]] = True
        sentence = np.cumsum((ids == BREAK) | first)
        code = np.bincount(sentence[ids == CODE], minlength=int(sentence[-1]) + 1 if len(ids) else 1) >= 2
        at = np.flatnonzero(ids >= 0)
        at = at[~code[sentence[at]]]
        scores = np.array(self.rows, dtype=np.float32)[ids[at]] if len(at) else np.zeros((0, len(LANGS)), np.float32)
        lang = viterbi(scores, text_of[at], sentence[at])
        ordered = np.sort(scores, axis=1)
        best = scores.argmax(axis=1) if len(at) else np.zeros(0, np.int64)
        telling = (ordered[:, -1] - ordered[:, -2] >= MARGIN) & (best == lang) if len(at) else np.zeros(0, bool)
        against = (ordered[:, -1] - ordered[:, -2] >= MARGIN) & (best != lang) if len(at) else np.zeros(0, bool)
        return {"ids": ids, "at": at, "text": text_of[at], "sentence": sentence[at], "lang": lang, "telling": telling, "against": against, "scores": scores}


def viterbi(scores: np.ndarray, text: np.ndarray, sentence: np.ndarray) -> np.ndarray:
    """Best language of each token, all texts stepping through their tokens side by side."""
    n = len(scores)
    out = np.zeros(n, dtype=np.int64)
    if not n:
        return out
    starts = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]))
    lengths = np.diff(np.append(starts, n))
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = starts[order], lengths[order]
    new_sentence = np.concatenate([[True], sentence[1:] != sentence[:-1]])
    penalty = np.where(new_sentence, SWITCH_AT_START, SWITCH).astype(np.float32)
    came = np.zeros((n, len(LANGS)), dtype=np.int8)
    own = np.arange(len(LANGS), dtype=np.int8)
    running = np.searchsorted(-lengths, -np.arange(int(lengths[0])), side="left")  # texts longer than t tokens
    value = scores[starts].copy()
    for t in range(1, int(lengths[0])):
        k = running[t]
        idx = starts[:k] + t
        v = value[:k]
        arg = v.argmax(axis=1)
        switched = v[np.arange(k), arg] - penalty[idx]
        stay = v >= switched[:, None]
        came[idx] = np.where(stay, own, arg[:, None])
        value[:k] = np.where(stay, v, switched[:, None]) + scores[idx]
    state = value.argmax(axis=1)
    for t in range(int(lengths[0]) - 1, -1, -1):
        k = running[t]
        idx = starts[:k] + t
        out[idx] = state[:k]
        state[:k] = came[idx, state[:k]] if t else state[:k]
    return out


def present(marks: dict[str, np.ndarray], texts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(sentences, words, confidence)`` by text and language: whole sentences (or long spans) in it, telling words, confidence."""
    width = len(LANGS)
    lang, text, sentence = marks["lang"], marks["text"], marks["sentence"]
    if not len(lang):
        zero = np.zeros((texts, width))
        return zero, zero, zero
    telling = marks["telling"].astype(np.float64)
    words = np.bincount(text * width + lang, weights=telling, minlength=texts * width).reshape(texts, width)
    against = np.bincount(text * width + lang, weights=marks["against"].astype(np.float64), minlength=texts * width).reshape(texts, width)
    # sentences
    keys, inverse = np.unique(sentence, return_inverse=True)
    per = np.bincount(inverse * width + lang, weights=telling, minlength=len(keys) * width).reshape(-1, width)
    owner = np.zeros(len(keys), dtype=np.int64)
    owner[inverse] = text
    whole = (per >= TELLING) & (per >= 0.6 * per.sum(axis=1, keepdims=True))
    # spans inside a sentence
    change = np.concatenate([[True], (lang[1:] != lang[:-1]) | (inverse[1:] != inverse[:-1])])
    span = np.cumsum(change) - 1
    in_span = np.bincount(span, weights=telling)
    at = np.flatnonzero(change)
    long = (in_span >= SPAN_WORDS) & ~whole[inverse[at], lang[at]]
    found = np.zeros((texts, width))
    np.add.at(found, owner, whole)
    np.add.at(found, (text[at][long], lang[at][long]), 1)
    confidence = (words + 0.5) / (words + against + 1.0) * (1 - np.exp2(-words / 2.0))
    return found, words, confidence


def counts_of(texts: DataFrame, model: Model | None) -> dict[str, np.ndarray]:
    """Counts of words by language over (code, text) rows: by their labels, or by the spans ``model`` finds."""
    shared = texts.sparkSession.sparkContext.broadcast(model) if model else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = {lang: k for k, lang in enumerate(LANGS)}
        labeller = Labeller(shared.value) if shared else None
        for batch in batches:
            tally: dict[tuple[str, int], int] = {}
            bodies = batch.column("text").to_pylist()
            if labeller:
                marks = labeller.label(bodies)
                found, _, _ = present(marks, len(bodies))
                names = {i: w for w, i in labeller.ids.items()}
                ok = found[marks["text"], marks["lang"]] > 0
                pairs, n = np.unique(np.stack([marks["ids"][marks["at"]][ok], marks["lang"][ok]]), axis=1, return_counts=True)
                for (i, k), c in zip(pairs.T.tolist(), n.tolist()):
                    tally[names[i], k] = c
            else:
                for code, text in zip(batch.column("code").to_pylist(), bodies):
                    k = known[code]
                    for w in TOKEN.findall(text.lower()):
                        if w[0].isalpha() and not any(map(str.isdigit, w)) and bool(CYRILLIC.search(w)) == (code == "uk"):
                            tally[w, k] = tally.get((w, k), 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in tally], pa.string()), pa.array([k for _, k in tally], pa.int32()), pa.array(list(tally.values()), pa.int64())], ["word", "k", "n"])

    each = texts.mapInArrow(run, "word string, k int, n bigint").groupBy("word", "k").agg(F.sum("n").alias("n"))
    # repetition of a few templates makes huge counts; their square roots keep rare words in sight
    by_word = each.groupBy("word").agg(F.map_from_entries(F.collect_list(F.struct("k", F.sqrt("n").alias("n")))).alias("by"), F.sum("n").alias("n"))
    kept = by_word.where("n > 1").orderBy(F.desc("n"), "word").limit(VOCABULARY).select("word", "by").collect()
    return {r["word"]: np.array([r["by"].get(k, 0.0) for k in range(len(LANGS))]) for r in kept}


def fit(documents: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """A model from (doc_id, text, lang) rows with noisy labels, using about ``sample_rows`` of them at most."""
    rows = documents.select(F.col("doc_id"), label_code(F.col("lang")).alias("code"), "text").where(F.col("text").isNotNull() & F.col("code").isin(*LANGS))
    total = rows.count()
    share = min(1.0, sample_rows / max(total, 1))
    sample = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < F.lit(int(share * 1_000_000))).select("code", "text")
    return build(counts_of(sample, build(counts_of(sample, None))))


def identify(items: DataFrame, model: Model, keys: list[str]) -> DataFrame:
    """``keys`` with ``main`` (null if none) and ``langs``: array of (lang, confidence, sentences), the most used first."""
    shared = items.sparkSession.sparkContext.broadcast(model)
    kinds = dict(items.dtypes)
    item_type = pa.struct([("lang", pa.string()), ("confidence", pa.float64()), ("sentences", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(shared.value)
        for batch in batches:
            bodies = [x or "" for x in batch.column("text").to_pylist()]
            main, langs = [], []
            for chunk in in_chunks(bodies):
                found, words, confidence = present(labeller.label(chunk), len(chunk))
                order = np.argsort(-np.where(found > 0, words, -1.0), axis=1, kind="stable")
                has = found > 0
                for i in range(len(chunk)):
                    own = [int(k) for k in order[i] if has[i, k]]
                    main.append(LANGS[own[0]] if own else None)
                    langs.append([{"lang": LANGS[k], "confidence": round(float(confidence[i, k]), 6), "sentences": int(found[i, k])} for k in own])
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), pa.array(main, pa.string()), pa.array(langs, pa.list_(item_type))], [*keys, "main", "langs"])

    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", main string, langs array<struct<lang: string, confidence: double, sentences: bigint>>"
    return items.select(*keys, "text").mapInArrow(run, schema)


def in_chunks(texts: list[str], most_chars: int = 4_000_000) -> Iterator[list[str]]:
    """Lists of whole texts of about ``most_chars`` together, so that one batch never needs much memory."""
    chunk, size = [], 0
    for text in texts:
        chunk.append(text)
        size += len(text)
        if size >= most_chars:
            yield chunk
            chunk, size = [], 0
    if chunk:
        yield chunk


def token_places(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """0-based starts and ends of the tokens of all texts, in their order; a letter may be longer in lower case."""
    first, last = [], []
    for text in texts:
        low = text.lower()
        spans = [m.span() for m in TOKEN.finditer(low)]
        if len(low) != len(text):
            back = [i for i, c in enumerate(text) for _ in c.lower()]
            spans = [(back[a], back[b - 1] + 1) for a, b in spans]
        first += [a for a, _ in spans]
        last += [b for _, b in spans]
    return np.array(first, dtype=np.int64), np.array(last, dtype=np.int64)


def segments(items: DataFrame, model: Model, keys: list[str]) -> DataFrame:
    """The spans of each text: 1-based ``start_pos``, ``end_pos`` (of the last character), ``lang``, ``confidence``.

    Neighbouring spans of one language are one; spans below SPAN_WORDS words are given too, with a low confidence.
    """
    shared = items.sparkSession.sparkContext.broadcast(model)
    kinds = dict(items.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(shared.value)
        for batch in batches:
            rows, starts, ends, langs, sure, done = [], [], [], [], [], 0
            for chunk in in_chunks([x or "" for x in batch.column("text").to_pylist()]):
                marks = labeller.label(chunk)
                lang, owner, at = marks["lang"], marks["text"], marks["at"]
                if len(lang):
                    cuts = np.flatnonzero(np.concatenate([[True], (lang[1:] != lang[:-1]) | (owner[1:] != owner[:-1])]))
                    yes, no = (np.add.reduceat(marks[k].astype(np.int64), cuts) for k in ("telling", "against"))
                    first, last = token_places(chunk)
                    rows += (owner[cuts] + done).tolist()
                    starts += (first[at[cuts]] + 1).tolist()
                    ends += last[at[np.append(cuts[1:], len(lang)) - 1]].tolist()
                    langs += [LANGS[k] for k in lang[cuts].tolist()]
                    sure += np.round((yes + 0.5) / (yes + no + 1.0) * (1 - np.exp2(-yes / 2.0)), 6).tolist()
                done += len(chunk)
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(at) for k in keys), pa.array(starts, pa.int64()), pa.array(ends, pa.int64()), pa.array(langs, pa.string()), pa.array(sure, pa.float64())], [*keys, "start_pos", "end_pos", "lang", "confidence"])

    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", start_pos bigint, end_pos bigint, lang string, confidence double"
    return items.select(*keys, "text").mapInArrow(run, schema)


def labelled_items(spark: SparkSession, data_dir: str) -> DataFrame:
    """(item_table, item_key, label, text) of articles, documents, logged questions and the questions of articles."""
    articles = table(spark, data_dir, "articles").select("path", "text", "meta")
    documents = table(spark, data_dir, "documents")
    log = table(spark, data_dir, "unanswered_log")
    bodies = articles.select(F.lit("articles").alias("item_table"), F.col("path").alias("item_key"), label_code(F.col("meta.language")).alias("label"), "text")
    asked = (
        articles.select("path", F.posexplode("meta.questions").alias("k", "text"))
        .select(F.lit("questions").alias("item_table"), F.concat("path", F.lit("#"), "k").alias("item_key"), F.lit("").alias("label"), "text")
    )
    papers = documents.select(F.lit("documents").alias("item_table"), F.col("doc_id").cast("string").alias("item_key"), label_code(F.col("lang")).alias("label"), "text")
    logged = log.select(F.lit("unanswered_log").alias("item_table"), F.col("entry_id").cast("string").alias("item_key"), F.lit("pl").alias("label"), F.col("q").alias("text"))
    return bodies.unionByName(asked).unionByName(papers).unionByName(logged)


def p1_languages(spark: SparkSession, data_dir: str) -> DataFrame:
    """Every item of labelled_items with its main language and all its languages with confidences."""
    model = fit(table(spark, data_dir, "documents"))
    return identify(labelled_items(spark, data_dir), model, ["item_table", "item_key", "label"]).withColumn("langs", F.to_json("langs"))


def p1_segments(spark: SparkSession, data_dir: str) -> DataFrame:
    """The labelled spans of every document."""
    documents = table(spark, data_dir, "documents")
    return segments(documents.select("doc_id", "text"), fit(documents), ["doc_id"])


def p1_found(spark: SparkSession, data_dir: str) -> DataFrame:
    """Languages of the items whose label is missing, wrong or not the only language (see TESTDATA.md)."""
    model = fit(table(spark, data_dir, "documents"))
    items, keys = labelled_items(spark, data_dir), ["item_table", "item_key", "label"]
    # the languages of articles are needed twice and are small rows: written once
    of_articles = cut(identify(items.where(F.col("item_table").isin("articles", "questions")), model, keys).where(F.size("langs") > 0))
    others = identify(items.where(~F.col("item_table").isin("articles", "questions")), model, keys).where(F.size("langs") > 0)
    whole = of_articles.where("item_table = 'articles'").unionByName(others).where((F.size("langs") > 1) | (F.col("langs")[0]["lang"] != F.col("label")))
    whole = whole.select("item_table", "item_key", F.explode("langs.lang").alias("lang"))
    main = of_articles.where("item_table = 'articles'").select(F.col("item_key").alias("path"), "main").distinct()
    asked = of_articles.where("item_table = 'questions'").select("item_key", F.regexp_replace("item_key", "#[0-9]+$", "").alias("path"), F.explode("langs.lang").alias("lang"))
    other = asked.join(main, "path").where("lang != main").select(F.lit("questions").alias("item_table"), "item_key", "lang")
    return whole.unionByName(other).distinct()


SQL: dict[str, str] = {}
QUERIES = {"p1_found": p1_found, "p1_languages": p1_languages, "p1_segments": p1_segments}
