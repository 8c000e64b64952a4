"""Abusive, hateful and sexual content, by cumulative-link ordinal regression over sparse text features.

Every sentence gets hashed features of its words after evasive spellings are undone (hidden characters, spaced or dotted
letters, figures for letters, letters of another script, stretched letters, masked letters), and a few counts of word
families (FAMILIES). One weight vector is shared by the ordered thresholds: P(grade <= k) = sigmoid(threshold_k - w.x).
The grades come from the reviewers: 0 no vote against the document, 1 votes in conflict, 2 all votes against it. Votes
are about documents, features about sentences: a document is as severe as its worst sentence, and fitting alternates
between picking that sentence and fitting the weights. Votes can be wrong, so a vote against a document counts less the
less any of its sentences looks like the others voted against.

The fit uses at most about SAMPLE_DOCS voted documents (a documented bound, drawn by hash); weights of word families
start from PRIOR, which carries the model where votes are few. Scoring and rates cover all documents.

Defined results: null, empty and blank texts score 0; repeated votes count once each; documents without votes are scored
like all others; a document with several rows is scored row by row.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helpdex.sources.tables import table

SAMPLE_DOCS, BUCKETS = 6_000, 1 << 17
GRADES = 3
#: Words scored together where a sentence is longer.
SPAN = 12
#: A document is flagged from this probability of a grade above 0; low, as flagged documents are reviewed.
FLAG_AT = 0.2
HIDDEN = dict.fromkeys(map(ord, "​‌‍⁠﻿­"))
HIDES = re.compile("[" + "".join(map(chr, HIDDEN)) + "]")
SENTENCE = re.compile(r"(?<=[.?!…])\s+|[\r\n]+")
SPACED = re.compile(r"(?<![\w])(?:[^\W\d_]([ .\-_*]))(?:[^\W\d_]\1){2,}[^\W\d_](?![\w])")
TOKEN = re.compile(r"[^\W_][\w@$!*'’]*[^\W_]|[^\W_]")
LOOKS_LATIN = str.maketrans("аеорсухіјѕАЕОРСУХІЈЅкмтвнКМТВН", "aeopcyxijsAEOPCYXIJSkmtbhKMTBH")
LOOKS_CYRILLIC = str.maketrans("aeopcyxiAEOPCYXI", "аеорсухіАЕОРСУХІ")
FIGURES = str.maketrans("013457@$!", "oieastasi")
STROKES = str.maketrans("łđøß", "ldos")
CYRILLIC, LATIN = re.compile(r"[Ѐ-ӿ]"), re.compile(r"[A-Za-zÀ-ɏ]")

#: Beginnings of words (folded, doubled letters single) by family, in the six languages.
FAMILIES = {
    "insult": "idiot debil kretyn palant palanc dupek dupk balwan gnoj gnoi smieciu nieudacznik glupek tuman matol ciot frajer pajac smiec szmat suko skurwysyn moron bastard ashole asshole scumbag dumbas loser piece_of_shit clown bitch jerk wanker twat prick dickhead arschloch trotel mistkerl pener volidiot vollidiot wichser hurensohn depp schlampe mißgeburt cabron gilipolas imbecil pendejo hijo_de_puta estupido_de ідіот кретин покидьк нікчем дебіл придур мудак сволот виродк kreten debile hajzl blbec kokot idiote vole_blby imbecil zmrd",
    "curse": "kurw pierdol odpierdol spierdal wypierdal spieprzaj jeb zajeb huj chuj pizd fuck shit bulshit bullshit verpis scheis scheiß fick mierd joder бісу курв хуй бля срак лайно єбан prdel kurva hovno jdi_do serem drz_hubu halt_die_fresse fresse pysk morda zamknij_sie shut_up go_to_hell calate callate стули_пельку пельку vete_a_la",
    "threat": "zdechn polamie znajde_cie zabije_cie zatluke uduszi udlaw choke break_your kill_you find_you_and jump_of jumped_off hang_yourself miss_you_if breche_dir finde_dich bringe_dich umbring te_voy_a_matar romper_las знайду_тебе вб'ю_тебе вбю_тебе здохн найду_тебя najdu_te zabiju_te chcipni zlamu_ti ojala_te ojala_se",
    "degrade": "robactw zaraza zaraze zarazy gorsi_od_zwierzat nadaja_sie_tylko wyrzucic_stad trzeba_ich zadnych_praw vermin les_than_animals less_than worth_less thrown_out no_rights to_stupid_to too_stupid send_them_al send_them ungeziefer rausgeworfen weniger_wert schlimer_als keine_rechte plaga hay_que_echar peores_que valen_menos menos_que_los_animales паразит вигнат гірші_за havet vyhodit horsi_nez zadna_prava subhuman podludz untermensch",
    "sexual": "porn pornos nagie_zdjec nago cycki cyck cycat nude naked tits titten titen nacktfoto nackt bumsen tetas desnud голі_фото цицьк цицк голою nahe_fotk nahou kozy sexualni sperm penis vagin masturb orgazm orgasm blowjob erotick_fot bzyk ruchac ruchan dymac секс_зі",
    "mild": "glup stupid dumb blod dum doof hloup tont dur дурн tepy useles worthless bezwartosc zlodziei zlodziej garbage szkoda_na nutzlos inutil nula",
    "you": "ty ci cie ciebie tobie twoj twoje twoja jestes ci_rece you your du dich dir dein ihr_alle ти тебе тобі твої tu te tus ti jsi tve tvoje tobe nadie_te nikt_cie nobody_asked",
    "group": "imigran cudzoziem uchodz kobiet niepelnospraw tarwen tarven imigrant immigrant foreigner women disabled auslander einwander fluchtling frauen behindert extranjer inmigrant mujeres discapacit мігрант інозем жінк інвалід тарвен cizin zen_v postizen pristehoval zydz jews juden muslim",
    "technical": "proces process port filter filtr form formular pole field job child potom dziecko дочірн hijo cancer health scunthorpe analysis default wina mistake schuld chyba blad fehler error spam contenido słowa slowa слова content adult",
}
NAMES = tuple(FAMILIES)
#: Weights of the word families before any vote is seen; pairs are families in one sentence.
PRIOR = {"insult": 4.0, "curse": 4.0, "threat": 4.5, "degrade": 3.0, "sexual": 4.0, "mild": 0.3, "you": 0.3, "group": 0.3, "technical": -1.5}
PAIRS = {("mild", "you"): 2.0, ("degrade", "group"): 3.0, ("mild", "group"): 2.0, ("insult", "you"): 0.5, ("sexual", "you"): 0.5}
MASKED, UNDONE = 1.5, 1.0
THRESHOLDS = (3.0, 4.0)
DENSE = len(NAMES) + len(PAIRS) + 2
WIDTH = DENSE + BUCKETS


def single(text: str) -> str:
    """Repeated letters as one."""
    return re.sub(r"(.)\1+", r"\1", text)


def folded(text: str) -> str:
    """Lower case without diacritics."""
    low = text.lower()
    if low.isascii():
        return low
    return "".join(c for c in unicodedata.normalize("NFKD", low.translate(STROKES)) if not unicodedata.combining(c))


STEMS = {name: tuple(sorted({single(folded(w)) for w in stems.split() if "_" not in w})) for name, stems in FAMILIES.items()}
PHRASES = {name: tuple(sorted({single(folded(w.replace("_", " "))) for w in stems.split() if "_" in w})) for name, stems in FAMILIES.items()}
#: Phrases by their first word, which always stands whole; each with its family.
PHRASES_FROM: dict[str, list[tuple[str, str]]] = {}
for _name, _phrases in PHRASES.items():
    for _phrase in _phrases:
        PHRASES_FROM.setdefault(_phrase.split(" ")[0], []).append((_name, " " + _phrase))
STEM_PATTERNS = {name: re.compile("|".join(map(re.escape, sorted(stems, key=len, reverse=True)))) for name, stems in STEMS.items()}


def undone(word: str) -> tuple[str, bool]:
    """A word with evasive spelling undone, and whether there was any."""
    changed = False
    if CYRILLIC.search(word) and LATIN.search(word):
        cyr = len(CYRILLIC.findall(word))
        word, changed = word.translate(LOOKS_LATIN if 2 * cyr <= len(word) or not CYRILLIC.search(word.translate(LOOKS_LATIN)) else LOOKS_CYRILLIC), True
    letters = sum(c.isalpha() for c in word)
    if letters >= 2 and letters < len(word) and any(c in "013457@$!" for c in word) and not re.match(r"[A-Za-z]{0,4}[-_]?\d+$|\d+\w?$|0x", word):
        word, changed = word.translate(FIGURES), True
    return word, changed


def skeleton(word: str) -> str:
    """A word with every vowel as 0, which is how vowels are often hidden."""
    return single(re.sub(r"[aeiouy0аеиоуіяюєї]", "0", word))


def words_of(sentence: str) -> tuple[list[str], bool, bool]:
    """Folded words of a sentence, whether an evasive spelling was undone, and whether a masked word can be an insult."""
    undid = HIDES.search(sentence) is not None
    clean = sentence.translate(HIDDEN) if undid else sentence
    if SPACED.search(clean):
        clean = SPACED.sub(lambda m: re.sub(r"[ .\-_*]", "", m.group()), clean)
        undid = True
    out, masked = [], False
    for token in TOKEN.findall(clean):
        word, changed, hides = read(token)
        undid |= changed
        masked |= hides
        out.append(word)
    return out, undid, masked


@lru_cache(maxsize=200_000)
def read(token: str) -> tuple[str, bool, bool]:
    """The folded word a token stands for, whether its spelling was evasive, and whether its letters are masked."""
    if "*" in token and re.fullmatch(r"([^\W\d_]+)(\*{2,})([^\W\d_]*)", token):
        return "masked", False, True
    word, changed = undone(token)
    if changed and any(c in "0134" for c in token):
        bones = skeleton(folded(word))
        word = next((stem for shape, stem in SKELETONS if bones.startswith(shape)), word)
    return folded(word), changed, False


@lru_cache(maxsize=200_000)
def traits(word: str) -> tuple[str, frozenset[str], tuple[int, ...], str]:
    """A folded word with letters single, the families it belongs to, its hashed features, and its name in pairs of words."""
    thin = single(word)
    families = frozenset(n for n in NAMES if (thin in STEMS[n] if n == "you" else STEM_PATTERNS[n].match(thin)))
    name = named(word)
    return thin, families, tuple(hashed(g) for g in ([f"w {name}", f"s {name[:5]}"] if len(name) > 5 else [f"w {name}"])), name


def named(word: str) -> str:
    return "0" if any(map(str.isdigit, word)) else word


def hashed(gram: str) -> int:
    return DENSE + xxhash.xxh32_intdigest(gram) % BUCKETS


SKELETONS = tuple((skeleton(w), w) for n in ("insult", "curse") for w in STEMS[n] if len(w) > 3)


def units(text: str) -> Iterator[str]:
    """Sentences of a text; of a long one, overlapping windows of SPAN words, as sentences may follow without a stop."""
    for sentence in SENTENCE.split(text):
        words = sentence.split()
        if len(words) <= SPAN + 2:
            yield sentence
        else:
            for k in range(0, len(words) - SPAN // 2, SPAN // 2):
                yield " ".join(words[k : k + SPAN])


def features(sentence: str) -> list[int] | None:
    """Sorted indices of a sentence's features: word families, pairs, evasions, then hashed words; None without words."""
    words, undid, masked = words_of(sentence)
    if not words:
        return None
    known = [traits(w) for w in words]
    has = set().union(*(f for _, f, _, _ in known))
    begun = [pair for thin, _, _, _ in known if thin in PHRASES_FROM for pair in PHRASES_FROM[thin]]
    if begun:
        joined = " " + " ".join(t for t, _, _, _ in known) + " "
        has |= {name for name, phrase in begun if phrase in joined}
    out = {k for k, name in enumerate(NAMES) if name in has}
    out |= {len(NAMES) + k for k, (a, b) in enumerate(PAIRS) if a in has and b in has}
    if masked:
        out.add(DENSE - 2)
    if undid and has & {"insult", "curse", "sexual"}:
        out.add(DENSE - 1)
    names = [name for _, _, _, name in known]
    out.update(*(g for _, _, g, _ in known), (hashed(f"b {a} {b}") for a, b in zip(names, names[1:])))
    return sorted(out)


class Severity(NamedTuple):
    """Weights shared by all thresholds, and the thresholds."""

    weights: np.ndarray
    thresholds: np.ndarray


def prior() -> Severity:
    w = np.zeros(WIDTH)
    for k, name in enumerate(NAMES):
        w[k] = PRIOR[name]
    for k, pair in enumerate(PAIRS):
        w[len(NAMES) + k] = PAIRS[pair]
    w[DENSE - 2], w[DENSE - 1] = MASKED, UNDONE
    return Severity(w, np.array(THRESHOLDS))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


def at_least(model: Severity, score: np.ndarray) -> np.ndarray:
    """P(grade >= 1), P(grade >= 2), ... of each score."""
    return sigmoid(np.asarray(score)[:, None] - model.thresholds[None, :])


def fit_weights(start: Severity, rows: np.ndarray, columns: np.ndarray, n: int, grade: np.ndarray, weight: np.ndarray, rounds: int = 80) -> Severity:
    """Penalised maximum likelihood of the cumulative-link model (Adam); the penalty pulls towards the prior."""
    base = prior()
    strength = np.full(WIDTH, 0.5)
    strength[:DENSE] = 2.0
    used = np.unique(columns)
    slot = np.searchsorted(used, columns)
    w, pull, back = start.weights[used].copy(), base.weights[used], strength[used] / max(weight.sum(), 1.0) * 4
    theta = start.thresholds.copy()
    m, v = np.zeros(len(used) + 2), np.zeros(len(used) + 2)
    for step in range(1, rounds + 1):
        score = np.bincount(rows, weights=w[slot], minlength=n)
        upper = np.where(grade == 2, 1.0, sigmoid(theta[np.minimum(grade, 1)] - score))
        lower = np.where(grade == 0, 0.0, sigmoid(theta[np.maximum(grade - 1, 0)] - score))
        p = np.maximum(upper - lower, 1e-9)
        du = np.where(grade == 2, 0.0, upper * (1 - upper)) / p
        dl = np.where(grade == 0, 0.0, lower * (1 - lower)) / p
        g_score = weight * (du - dl) / weight.sum()
        g_theta = np.array([(weight * (np.where(grade == k, -du, 0) + np.where(grade == k + 1, dl, 0))).sum() for k in range(2)]) / weight.sum()
        g_w = np.bincount(slot, weights=g_score[rows], minlength=len(used)) + back * (w - pull)
        g = np.concatenate([g_w, g_theta + 0.02 * (theta - np.array(THRESHOLDS))])
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        move = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
        w, theta = w - move[:-2], theta - move[-2:]
        theta[1] = max(theta[1], theta[0] + 0.1)
    weights = base.weights.copy()
    weights[used] = w
    return Severity(weights, theta)


def sentence_rows(documents: DataFrame) -> DataFrame:
    """(doc_id, grade, features) of every sentence of the (doc_id, grade, text) rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, lists = [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                for f in filter(None, map(features, set(units(text)))):
                    at.append(i), lists.append(f)
            rows = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(rows), batch.column("grade").take(rows), pa.array(lists, pa.list_(pa.int32()))], ["doc_id", "grade", "features"])

    return documents.select("doc_id", "grade", "text").mapInArrow(run, "doc_id bigint, grade int, features array<int>")


def graded(votes: DataFrame) -> DataFrame:
    """(doc_id, grade) from (doc_id, toxic) votes; null votes don't count."""
    each = votes.where(F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.sum("toxic").alias("against"), F.count(F.lit(1)).alias("n"))
    return each.select("doc_id", F.when(F.col("against") == 0, 0).when(F.col("against") < F.col("n"), 1).otherwise(2).alias("grade"))


def fit(documents: DataFrame, votes: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Severity:
    """The model of (doc_id, text) documents and (doc_id, toxic) votes, on about ``sample_docs`` voted documents."""
    grades = graded(votes)
    total = grades.count()
    share = min(1.0, sample_docs / max(total, 1))
    sample = grades.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < F.lit(int(share * 1_000_000)))
    voted = documents.where(F.col("text").isNotNull()).select("doc_id", "text").join(sample, "doc_id")
    got = sorted(((r["doc_id"], r["grade"], r["features"]) for r in sentence_rows(voted).collect()), key=lambda r: (r[0], r[2]))
    model = prior()
    if not got:
        return model
    docs = np.array([r[0] for r in got])
    grade = np.array([r[1] for r in got])
    columns = np.array([f for r in got for f in r[2]], dtype=np.int64)
    rows = np.repeat(np.arange(len(got)), [len(r[2]) for r in got])
    _, owner = np.unique(docs, return_inverse=True)
    for _ in range(3):
        score = np.bincount(rows, weights=model.weights[columns], minlength=len(got))
        order = np.lexsort((-score, owner))
        worst = np.zeros(len(got), dtype=bool)
        worst[order[np.concatenate([[True], owner[order][1:] != owner[order][:-1]])]] = True
        seen = at_least(model, score)[:, 0]
        # votes for a document count less for a sentence that looks bad; of one voted against only the worst sentence tells
        weight = np.where(grade == 0, np.maximum(0.3, 1.0 - seen), np.where(worst, np.clip(2 * seen, 0.0, 1.0) ** 2, 0.0))
        model = fit_weights(model, rows, columns, len(got), grade, weight)
    return model


class Scorer:
    """Scores of sentences inside a task; the last sentences are remembered as forms repeat."""

    MOST_KEPT = 100_000

    def __init__(self, model: Severity):
        self.model, self.kept = model, {}

    def sentence(self, sentence: str) -> float:
        got = self.kept.get(sentence)
        if got is None:
            f = features(sentence)
            got = float(self.model.weights[f].sum()) if f else -30.0
            if len(self.kept) >= self.MOST_KEPT:
                self.kept.clear()
            self.kept[sentence] = got
        return got

    def text(self, text: str | None) -> float:
        return max(map(self.sentence, units(re.sub(r"\d{3,}", "0", text))), default=-30.0) if text else -30.0


def score(documents: DataFrame, model: Severity, keys: list[str]) -> DataFrame:
    """``keys`` with ``severity`` (expected grade, 0 to 2) and ``flagged`` (the probability of a grade above 0 is at least FLAG_AT)."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    kinds = dict(documents.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            worst = np.array([scorer.text(x) for x in batch.column("text").to_pylist()])
            p = at_least(shared.value, worst) if len(worst) else np.zeros((0, GRADES - 1))
            p[worst <= -30.0] = 0.0
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), pa.array(np.round(p.sum(axis=1), 6)), pa.array(p[:, 0] >= FLAG_AT)], [*keys, "severity", "flagged"])

    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", severity double, flagged boolean"
    return documents.select(*keys, "text").mapInArrow(run, schema)


def scored_documents(spark: SparkSession, data_dir: str, keys: list[str]) -> DataFrame:
    documents = table(spark, data_dir, "documents")
    return score(documents, fit(documents, table(spark, data_dir, "review_labels")), keys)


def p8_found(spark: SparkSession, data_dir: str) -> DataFrame:
    """Documents with abusive, hateful or sexual content (see TESTDATA.md)."""
    return scored_documents(spark, data_dir, ["doc_id"]).where("flagged").select("doc_id").distinct()


def p8_scores(spark: SparkSession, data_dir: str) -> DataFrame:
    """Expected severity of every document."""
    return scored_documents(spark, data_dir, ["doc_id", "source"])


def p8_source_rates(spark: SparkSession, data_dir: str) -> DataFrame:
    """Documents, flagged documents, rate and mean severity of each source."""
    each = scored_documents(spark, data_dir, ["source"])
    return each.groupBy("source").agg(
        F.count(F.lit(1)).alias("documents"), F.count_if("flagged").alias("flagged"), F.round(F.avg(F.col("flagged").cast("double")), 6).alias("rate"), F.round(F.avg("severity"), 6).alias("mean_severity")
    )


SQL: dict[str, str] = {}
QUERIES = {"p8_found": p8_found, "p8_scores": p8_scores, "p8_source_rates": p8_source_rates}
