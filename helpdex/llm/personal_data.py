"""Personal information in free text: found, typed and replaced by placeholders.

Generators with high recall propose overlapping spans (e-mail addresses also in evasive writing, digit groups, document
numbers, street addresses, two-word names). Gradient-boosted trees rate each span by its format and its context, the
ratings are calibrated on held-out spans, and spans above the threshold of their type are selected, the surest first,
without overlaps.

The trees are fitted in Spark on at most about SAMPLE_ITEMS texts (a documented bound, drawn by hash over all rows). No
row is labelled in these tables, so the training spans get weak labels: a span is positive if its format is that of its
type and the nearest cue before it is one of the type ("tel.", "PESEL", "my name is"), negative if a cue of another kind
(order, ticket, version, ...) is nearer or the format does not fit. Everything but the fit covers all rows.

Defined results: null, empty and blank texts have no span and stay as they are; positions are 1-based and count
characters (code points); repeated rows of one id count once.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helpdex.sources.tables import table

TYPES = ("email", "phone", "idno", "address", "name")
#: Bound of the fit, and the trees' size.
SAMPLE_ITEMS, TREES, DEPTH = 60_000, 24, 4
WINDOW = 48
FAR = 99.0

#: Words that announce a kind of value (without diacritics, lower case).
CUES = {
    "phone": r"\btel\b|telefon\w*|\bphone|\bmobile|\bcall\b|\bdzwon\w*|\boddzwon\w*|moj numer to|my number is|meine nummer|\brufen sie|\bunter\b|\banruf\w*|\bruckruf|\bhandy\w*|телефон\w*|мій номер|дзвон\w*|передзвон\w*|зателефон\w*|dzwoncie|llam\w+|mi numero es|zavolej\w*|volejte|\bvolat\b|komork\w*|numer kom\w*",
    "idno": r"\bpesel|\bdowod\w*|osobist\w*|paszport\w*|passport\w*|pasaporte|reisepass\w*|ausweis\w*|\bpasu\b|\bpas\b|паспорт\w*|\bssn\b|social security|\bni number|national insurance|\bnino\b|\bdni\b|\bnie\s*:|rodne cislo|\bіпн|рнокпп|versicherung\w*|obcansk\w*|seguridad social|\bid card|identity card",
    "address": r"adres\w*|address|kurier\w*|courier|ship it|is at\b|zdalnie|pracuje|mieszka\w*|\blive\b|wohn\w*|direcc\w*|adresse|адрес\w*|bydl\w*|posl\w*|send it|liefern an|filiale|zustell\w*|schicken",
    "name": r"nazywam sie|\bname is\b|\bname ist\b|konto zalozone dla:?|kolega z zespolu,?|kolezanka z zespolu,?|pozdrawiam,?|regards,?|viele grus?se,?|mit freundlichen grus?sen,?|grus?s?e?,|мене звати|з повагою,?|jmenuji se|s pozdravem,?|me llamo|un saludo,?|saludos,?|belongs to|angelegt fur:?|konto gehort|mi nombre es|a nombre de|a colleague,?|colleague from the team,?|kollege,?|kollegin,?|kolega,?|kolegyne,?|companero,?|колега,?|на ім'я:?|на jmeno:?|to ім'я:?|to jmeno:?|zalozen na:?|na jmeno:?|gemeldet von|zglosil\w*|podpis\w*:?|signed,?|imie i nazwisko:?|name:",
    "email": r"mail\w*|kontakt\w*|adres\w*|reply to|antworten|odpowiedz na|piszcie|reach me|пошта|відповісти|correo|odpov\w*|adresse",
}
OTHER_CUES = r"zglosze\w*|zamowie\w*|seryjn\w*|serial\w*|serie\w*|faktur\w*|invoice|\bport\b|puerto|\blimit|\bip\b|wersj\w*|versi\w*|verze|версі\w*|\bbuild|\bpart\b|\border\b|\bticket|vorgang\w*|bestell\w*|pedido|incidencia|замовлен\w*|звернен\w*|objednav\w*|hlaseni|\bkod\w*|\bcode\b|codigo|\bкод\w*|blad|error|chyb\w*|fehler|помилк\w*|bajt\w*|byte\w*|номер заявки|серійн\w*|seriov\w*|zgłasza|message|komunikat|\bdevice (?:id|no)|asset|inventar\w*|inwentarz\w*|rechnung\w*|factura\w*|рахун\w*|сторінк\w*|\bmac\b|ekran\w*|widac|screen|pantalla|bildschirm|obrazov\w*|екран\w*"
#: Words for a group of people or a role, and other words that follow a name's cue without being one.
ROLES = frozenset("dzial it zespol wsparcia support team night shift zmiana nocna the el la die der das turno noche nachtschicht noc smena oddeleni відділ нічна зміна helpdesk help desk biuro office recepcja reception ksiegowosc accounting administrator admin prosze please dziekuje thanks moj my mam i und y a na w z do und oddzial abteilung departamento dept department soporte tecnico it-abteilung equipo technik".split())
#: Frequent given names (without diacritics, lower case).
GIVEN = frozenset(
    "adam agata agnieszka aleksandra alicja andrzej anna barbara beata bogdan dariusz dorota elzbieta ewa grzegorz halina irena iwona jacek jakub jan janina jerzy joanna jolanta julia kamil karolina katarzyna krystyna krzysztof lukasz maciej magdalena malgorzata marcin marek maria mariusz marta mateusz michal monika natalia pawel piotr rafal robert ryszard stanislaw teresa tomasz wojciech zbigniew zofia "
    "alice oliver chloe grace henry peter martin james john mary emma jack lucy george charlotte emily william thomas sarah david daniel hannah sophie oscar "
    "felix sabine hans anke jurgen klaus monika stefan ursula heike wolfgang uwe jonas lena lukas greta "
    "тарас богдан ірина оксана олена андрій микола іван марія наталія сергій юлія володимир катерина павло ганна олег софія "
    "petr ondrej jana eva tomas jiri lucie pavel lenka vaclav zdenek tereza hana "
    "carlos lucia pablo carmen javier elena ana jose luis marta diego sofia alvaro ines".split()
)
STREET_WORDS = r"ul\.|ulica|ulicy|aleja|alei|al\.|os\.|osiedle|pl\.|plac|ulice|nam\.|calle|avenida|avda\.|plaza|paseo|c/|вул\.|вулиця|вулиці|просп\.|проспект|бульв\.|пров\.|площа"
STREET_ENDS = r"road|rd|lane|ln|street|st|avenue|ave|drive|close|way|court|square|terrace|gardens|crescent|place|hill|row|mews"
STREET_TAILS = "straße|strasse|str\\.|gasse|allee|weg|platz|ufer|zeile|steig|stieg|grund|pfad|ring|damm|winkel"

EMAIL = re.compile(
    r"[\w][\w.+%-]*(?:\s*(?:@|\(at\)|\[at\]|\{at\}|\(małpa\)|\[małpa\])\s*|\s+(?:at|małpa|malpa)\s+)[\w-]+(?:(?:\s*(?:\(dot\)|\[dot\]|\{dot\}|\(kropka\)|\[kropka\])\s*|\s+(?:dot|kropka)\s+|\.|\s\.\s)[\w-]+)*(?:\s*(?:\(dot\)|\[dot\]|\{dot\}|\(kropka\)|\[kropka\])\s*|\s+(?:dot|kropka)\s+|\.)[a-z]{2,10}(?![\w])",
    re.I,
)
#: What an address without @ has in its place, and the digits that tell whether there can be a number.
AT_WORD = re.compile(r"[(\[{\s](?:at|malpa)[)\]}\s]")
DIGIT = re.compile(r"\d")
DIGITS = re.compile(r"(?<![\w+(/])(?:\+|00)?\s?\(?\d[\d ().\- /]{4,20}\d(?!\w)")
NUMBERS = re.compile(
    r"(?<!\w)(?:\d{6}[ -]?\d{5}|[a-z]{3}[ -]?\d{6}|[a-z]{2}[ -]?\d{7}|\d{3}[ -]\d{2}[ -]\d{4}|[a-z]{2} ?\d{2} ?\d{2} ?\d{2} ?[a-d]|[a-z]\d{2}[a-z0-9]\d{5}|\d{6}/\d{3,4}|\d{8}-?[a-z]|[xyz]-?\d{7}-?[a-z]|\d{2} ?\d{6} ?[a-z] ?\d{3}|\d{10})(?!\w)",
    re.I,
)
NAME_PART = r"[^\W\d_]+(?:['’\-][^\W\d_]+)*"
ADDRESS = re.compile(
    rf"(?<!\w)(?:{STREET_WORDS})\s*(?:{NAME_PART}\.?\s+){{0,3}}{NAME_PART},?\s+\d{{1,4}}(?:[a-z]|\s[a-z](?![\w.]))?(?:\s?(?:/|m\.|lok\.|кв\.)\s?\d{{1,4}})?(?!\w)"
    rf"|(?<!\w)(?:flat\s+\d+\w?,?\s+)?\d{{1,4}}[a-z]?,?\s+(?:{NAME_PART}\s+){{1,3}}(?:{STREET_ENDS})(?!\w)"
    rf"|(?<!\w)(?:{NAME_PART}\s+){{0,2}}[^\W\d_]*(?:{STREET_TAILS})\s+\d{{1,4}}(?:[a-z]|\s[a-z](?![\w.]))?(?!\w)"
    rf"|(?<!\w)[^\W\d_]{{6,}}\s+\d{{1,3}}[a-z]?(?=,\s*(?:\d{{4,5}}\s+)?[^\W\d_]{{4,}})",
    re.I,
)
NAME_AFTER_CUE = re.compile(rf"[\s:,\-]*((?:[^\W\d_]\.\s?|{NAME_PART}\s+)(?:[^\W\d_]\.|{NAME_PART}))(?!\w)")
PAIR = re.compile(rf"(?=(?<![\w@.\-+])((?:[^\W\d_]\.\s?|{NAME_PART}\s+)(?:[^\W\d_]\.(?!\w)|{NAME_PART}))(?![\w@]))")
WORDS = re.compile(NAME_PART)
#: Words before a street that are not part of its name.
BEFORE_STREET = re.compile(r"(?:(?:an|in|im|am|bei|beim|auf|nach|zu|zur|zum|unter|und|der|die|das|den|dem|liefern|senden|schicken|wohnt|wohne|adresse)\s+)+")
LETTERS = str.maketrans("łŁđĐøØ", "lLdDoO")


class Folding(dict):
    """Maps code points to one folded character each, worked out when first met."""

    def __missing__(self, point: int) -> str:
        c = chr(point).translate(LETTERS)
        d = unicodedata.normalize("NFD", c)[0] if not ("Ѐ" <= c <= "ӿ") else c
        low = d.lower()
        self[point] = "s" if c in "ßẞ" else low if len(low) == 1 else d
        return self[point]


FOLDED = Folding()


def folded(text: str) -> str:
    """Lower case without diacritics, of the same length."""
    return text.lower() if text.isascii() else text.translate(FOLDED)


def by_first_letter(alternatives: str) -> re.Pattern:
    """The same alternatives grouped by their first letter, so that a search skips all positions with another letter.

    Alternatives of one letter keep their order, and those of different letters can't match at the same place, so the
    matches are the same. A leading word boundary is looked for behind the letter.
    """
    groups: dict[str, list[str]] = {}
    for one in re.split(r"\|(?![^(]*\))", alternatives):
        bound = one.startswith(r"\b")
        first, rest = one[2 * bound], one[2 * bound + 1 :]
        if not first.isalpha() or rest[:1] in ("?", "*", "+", "{"):
            raise ValueError(f"an alternative must begin with a letter: {one}")
        groups.setdefault(first, []).append((rf"(?<!\w{first})" if bound else "") + rest)
    return re.compile("|".join(f"{first}(?:{'|'.join(rests)})" for first, rests in groups.items()))


#: What every match of ADDRESS has: one of these words (folded), or a number next to a word as its other forms have it.
STREET_KEY = by_first_letter("|".join(re.escape(folded(w.replace("\\", ""))) for w in f"{STREET_WORDS}|{STREET_TAILS}".split("|")))
NUMBER_NEAR = re.compile(r"\d(?<!\w\d)\d{0,3}(?:[a-z]?,?\s+[^\W\d_]|[a-z]?,)")


def may_have_address(low: str) -> bool:
    return STREET_KEY.search(low) is not None or NUMBER_NEAR.search(low) is not None


CUE = {k: by_first_letter(v) for k, v in CUES.items()}
NO_CUE = by_first_letter(OTHER_CUES)
FEATURES = (
    *(f"is_{t}" for t in TYPES),
    "digits", "letters", "length", "plus", "paren", "at_sign", "seps", "digits_9", "digits_11", "digits_lead_0", "dots",
    "own_cue", "other_cue", "own_nearer", "no_space_before_other", "rival_cue", "rival_nearer", "glued_before", "glued_after",
    "given_1", "given_2", "cued_initial", "capital_1", "capital_2", "upper", "initial", "role_word", "words", "hyphen", "after_cue_directly", "mixed_case_text", "street_word",
)
AT = {name: k for k, name in enumerate(FEATURES)}


def propose(text: str, low: str) -> list[tuple[int, int, int]]:
    """(type, start, end) of every candidate; 0-based, overlapping."""
    out: set[tuple[int, int, int]] = set()
    if "@" in text or AT_WORD.search(low):
        out |= {(0, *m.span()) for m in EMAIL.finditer(text)}
    if digits := len(DIGIT.findall(text)):
        for m in DIGITS.finditer(text) if digits >= 7 else ():
            a, b = m.span()
            a += len(m.group()) - len(m.group().lstrip())
            if sum(c.isdigit() for c in text[a:b]) >= 7:
                out.add((1, a, b))
        out |= {(2, *m.span()) for m in NUMBERS.finditer(text)} if digits >= 6 else set()
        for m in ADDRESS.finditer(text) if may_have_address(low) else ():
            out.add((3, *m.span()))
            if own := BEFORE_STREET.match(low, *m.span()):
                out.add((3, own.end(), m.end()))
    for m in CUE["name"].finditer(low):
        n = NAME_AFTER_CUE.match(text, m.end())
        if n:
            out.add((4, *n.span(1)))
    if not GIVEN.isdisjoint(WORDS.findall(low)):
        for m in PAIR.finditer(text):
            a, b = m.span(1)
            if not GIVEN.isdisjoint(WORDS.findall(low[a:b])):
                out.add((4, a, b))
    return sorted(out)


def last_end(pattern: re.Pattern, text: str) -> int:
    end = -1
    for m in pattern.finditer(text):
        end = m.end()
    return end


def describe(text: str, low: str, kind: int, a: int, b: int) -> list[float]:
    """The features of one span, in the order of FEATURES."""
    span = text[a:b]
    before = low[max(0, a - WINDOW) : a]
    digits = sum(c.isdigit() for c in span)
    own, other = last_end(CUE[TYPES[kind]], before), last_end(NO_CUE, before)
    # a number can be of the other kind of number
    rivals = last_end(CUE[TYPES[3 - kind]], before) if kind in (1, 2) else -1
    own_d = float(len(before) - own) if own >= 0 else FAR
    other_d = float(len(before) - other) if other >= 0 else FAR
    parts = [w for w in re.split(r"[\s.]+", span) if w] if kind == 4 else []
    lows = [w for w in re.split(r"[\s.]+", low[a:b]) if w] if kind == 4 else []
    f = [0.0] * len(FEATURES)
    f[kind] = 1.0
    f[AT["digits"]] = digits
    f[AT["letters"]] = sum(c.isalpha() for c in span)
    f[AT["length"]] = len(span)
    f[AT["plus"]] = float(span.startswith(("+", "00")))
    f[AT["paren"]] = float("(" in span)
    f[AT["at_sign"]] = float("@" in span)
    f[AT["seps"]] = sum(c in " -./ " for c in span)
    f[AT["digits_9"]] = float(digits == 9)
    f[AT["digits_11"]] = float(digits == 11)
    f[AT["digits_lead_0"]] = float(span[:1] == "0")
    f[AT["dots"]] = span.count(".")
    f[AT["own_cue"]] = own_d
    f[AT["other_cue"]] = other_d
    f[AT["own_nearer"]] = float(own_d < other_d)
    f[AT["rival_cue"]] = float(len(before) - rivals) if rivals >= 0 else FAR
    f[AT["rival_nearer"]] = float(f[AT["rival_cue"]] < own_d)
    f[AT["no_space_before_other"]] = float(other_d <= 3)
    f[AT["glued_before"]] = float(a > 0 and not text[a - 1].isspace() and text[a - 1] not in ":,(")
    f[AT["glued_after"]] = float(b < len(text) and text[b] in "-/@_" or b + 1 < len(text) and text[b] == "." and text[b + 1].isdigit())
    if kind == 4:
        given = [any(w in GIVEN for w in x.split("-")) for x in lows]
        f[AT["given_1"]] = float(bool(given) and given[0])
        f[AT["given_2"]] = float(len(given) > 1 and given[1])
        f[AT["capital_1"]] = float(parts[0][0].isupper())
        f[AT["capital_2"]] = float(parts[-1][0].isupper())
        f[AT["initial"]] = float(any(len(w) == 1 for w in parts))
        f[AT["cued_initial"]] = float(f[AT["initial"]] and own_d <= 3 and f[AT["capital_1"]] and f[AT["capital_2"]])
        f[AT["role_word"]] = sum(w in ROLES for w in lows if len(w) > 1 or "." not in span)
        f[AT["words"]] = len(parts)
    f[AT["upper"]] = float(span.isupper())
    f[AT["hyphen"]] = float("-" in span)
    f[AT["after_cue_directly"]] = float(own_d <= 2)
    f[AT["mixed_case_text"]] = float(text.isupper() or text.islower())
    f[AT["street_word"]] = float(kind == 3 and bool(re.match(STREET_WORDS, low[a:b])))
    return f


def weak_label(f: list[float]) -> int:
    """1, 0, or -1 where the cues say nothing sure."""
    own, other, rival, digits = f[AT["own_cue"]], f[AT["other_cue"]], f[AT["rival_cue"]], f[AT["digits"]]
    if f[AT["glued_before"]] or f[AT["glued_after"]]:
        return 0
    if f[0]:
        return 1 if f[AT["letters"]] >= 6 else 0
    if f[1]:
        if digits > 15 or other < own or rival < own:
            return 0
        return 1 if own < 30 or (f[AT["plus"]] and digits >= 10 and other == FAR) else 0 if other < FAR else -1
    if f[2]:
        if other < own or rival < own:
            return 0
        return 1 if own < 30 else 0 if other < FAR or f[AT["letters"]] else -1
    if f[3]:
        return 1 if f[AT["street_word"]] or own < 30 else 0 if own == FAR else -1
    if f[AT["role_word"]]:
        return 0
    given = f[AT["given_1"]] or f[AT["given_2"]]
    if given and (f[AT["capital_1"]] and f[AT["capital_2"]] or own <= 3):
        return 1
    if f[AT["cued_initial"]]:
        return 1
    return -1 if own <= 3 else 0


class Trees(NamedTuple):
    """Boosted trees as flat arrays, the calibration of their sum, and the threshold of each type."""

    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
    weights: list[float]
    slope: float
    shift: float
    thresholds: np.ndarray


def flat_tree(root) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(feature, threshold, left, right, value) of a fitted tree; feature -1 marks a leaf."""
    feature, threshold, left, right, value = [], [], [], [], []

    def add(node) -> int:
        k = len(feature)
        feature.append(-1), threshold.append(0.0), left.append(k), right.append(k), value.append(float(node.prediction()))
        if node.subtreeDepth() > 0:
            feature[k], threshold[k] = node.split().featureIndex(), float(node.split().threshold())
            left[k], right[k] = add(node.leftChild()), add(node.rightChild())
        return k

    add(root)
    return np.array(feature), np.array(threshold), np.array(left), np.array(right), np.array(value)


def margin(model: Trees, x: np.ndarray) -> np.ndarray:
    """Weighted sum of the trees' predictions for the rows of ``x``."""
    total = np.zeros(len(x))
    rows = np.arange(len(x))
    for (feature, threshold, left, right, value), weight in zip(model.trees, model.weights):
        at = np.zeros(len(x), dtype=np.int64)
        for _ in range(DEPTH):
            f = feature[at]
            low = x[rows, np.maximum(f, 0)] <= threshold[at]
            at = np.where(f < 0, at, np.where(low, left[at], right[at]))
        total += weight * value[at]
    return total


def logistic(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


def probability(model: Trees, x: np.ndarray) -> np.ndarray:
    return logistic(model.slope * margin(model, x) + model.shift)


def calibrated(model: Trees, x: np.ndarray, y: np.ndarray) -> Trees:
    """``model`` with a logistic calibration and, for each type, the threshold of the best F1 on held-out spans."""
    m = margin(model, x)
    slope, shift = 2.0, 0.0
    target = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
    for _ in range(50):  # Newton steps
        p = logistic(slope * m + shift)
        w = np.maximum(p * (1 - p), 1e-6)
        g = np.array([((p - target) * m).sum(), (p - target).sum()])
        h = np.array([[(w * m * m).sum() + 1e-3, (w * m).sum()], [(w * m).sum(), w.sum() + 1e-3]])
        step = np.linalg.solve(h, g)
        slope, shift = slope - step[0], shift - step[1]
    p = logistic(slope * m + shift)
    thresholds = np.full(len(TYPES), 0.5)
    for k in range(len(TYPES)):
        own = x[:, k] > 0
        best = -1.0
        for t in np.linspace(0.1, 0.9, 17) if own.any() else []:
            hit = (p >= t) & own
            f1 = 2 * (hit & (y > 0)).sum() / max(hit.sum() + (own & (y > 0)).sum(), 1)
            if f1 > best + 1e-9 or (abs(f1 - best) <= 1e-9 and abs(t - 0.5) < abs(thresholds[k] - 0.5)):
                best, thresholds[k] = f1, t
    return model._replace(slope=float(slope), shift=float(shift), thresholds=thresholds)


def training_spans(items: DataFrame) -> DataFrame:
    """(features, label, held_out) of the proposed spans of ``items`` that get a weak label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, labels, held = [], [], []
            for text in batch.column("text").to_pylist():
                low = folded(text)
                for kind, a, b in propose(text, low):
                    f = describe(text, low, kind, a, b)
                    label = weak_label(f)
                    if label >= 0:
                        rows.append(f), labels.append(float(label)), held.append(len(text) % 4 == 0)
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64())), pa.array(labels, pa.float64()), pa.array(held, pa.bool_())], ["features", "label", "held_out"])

    return items.select("text").mapInArrow(run, "features array<double>, label double, held_out boolean")


def fit(items: DataFrame, sample_items: int = SAMPLE_ITEMS) -> Trees:
    """Trees fitted on about ``sample_items`` of the (item_id, text) rows; a constant model if nothing is labelled."""
    known = items.where(F.col("text").isNotNull())
    total = known.count()
    share = min(1.0, sample_items / max(total, 1))
    sample = known.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(1_000_000)) < F.lit(int(share * 1_000_000)))
    # sorted, so that the same rows give the same trees; the sample bounds their number
    spans = training_spans(sample).repartition(6, "features").sortWithinPartitions("features", "label", "held_out").cache()
    try:
        grown = spans.where("not held_out")
        kinds = {r["label"] for r in grown.select("label").distinct().collect()}
        blank = Trees([], [], 1.0, 0.0 if kinds == {1.0} else -5.0, np.full(len(TYPES), 0.5))
        if len(kinds) < 2:
            return blank
        fitted = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=7, featuresCol="vector").fit(grown.select(array_to_vector("features").alias("vector"), "label"))
        trees = [flat_tree(t._call_java("rootNode")) for t in fitted.trees]
        held = spans.where("held_out").select("features", "label").toPandas()
        model = blank._replace(trees=trees, weights=[float(w) for w in fitted.treeWeights], slope=2.0, shift=0.0)
        if not len(held):
            return model
        return calibrated(model, np.array(held["features"].tolist()), held["label"].to_numpy())
    finally:
        spans.unpersist()


def select(spans: list[tuple[int, int, int]], sure: np.ndarray, thresholds: np.ndarray) -> list[tuple[int, int, int, float]]:
    """Spans above their thresholds without overlaps, the surest (then the longest, then the first) winning."""
    chosen: list[tuple[int, int, int, float]] = []
    order = sorted(range(len(spans)), key=lambda k: (-round(float(sure[k]), 3), -(spans[k][2] - spans[k][1]), spans[k][1], spans[k][0]))
    for k in order:
        kind, a, b = spans[k]
        if sure[k] >= thresholds[kind] and all(b <= s or a >= e for _, s, e, _ in chosen):
            chosen.append((kind, a, b, float(sure[k])))
    return sorted(chosen, key=lambda c: c[1])


def _found(texts: list[str | None], model: Trees) -> list[list[tuple[int, int, int, float]]]:
    owners, spans, rows = [], [], []
    for i, text in enumerate(texts):
        if text:
            low = folded(text)
            for span in propose(text, low):
                owners.append(i), spans.append(span), rows.append(describe(text, low, *span))
    out: list[list[tuple[int, int, int, float]]] = [[] for _ in texts]
    if not rows:
        return out
    sure = probability(model, np.array(rows))
    owners_at = np.array(owners)
    for i in np.unique(owners_at).tolist():
        at = np.flatnonzero(owners_at == i) if len(texts) < 64 else np.arange(*np.searchsorted(owners_at, [i, i + 1]))
        out[i] = select([spans[k] for k in at], sure[at], model.thresholds)
    return out


def detect(items: DataFrame, model: Trees) -> DataFrame:
    """(item_table, item_id, pii_type, start_pos, end_pos, confidence) of every selected span."""
    shared = items.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, *s) for i, own in enumerate(_found(batch.column("text").to_pylist(), shared.value)) for s in own]
            at = pa.array([r[0] for r in rows], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("item_table").take(at), batch.column("item_id").take(at), pa.array([TYPES[r[1]] for r in rows], pa.string()), pa.array([r[2] + 1 for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.int64()), pa.array([round(r[4], 6) for r in rows], pa.float64())],
                ["item_table", "item_id", "pii_type", "start_pos", "end_pos", "confidence"],
            )

    schema = "item_table string, item_id bigint, pii_type string, start_pos bigint, end_pos bigint, confidence double"
    return items.select("item_table", "item_id", "text").mapInArrow(run, schema)


def redact(items: DataFrame, model: Trees) -> DataFrame:
    """(item_table, item_id, redacted): each span replaced by its type in brackets, the rest unchanged; null stays null."""
    shared = items.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, out = batch.column("text").to_pylist(), []
            for text, own in zip(texts, _found(texts, shared.value)):
                for kind, a, b, _ in reversed(own):
                    text = f"{text[:a]}[{TYPES[kind].upper()}]{text[b:]}"
                out.append(text)
            yield pa.RecordBatch.from_arrays([batch.column("item_table"), batch.column("item_id"), pa.array(out, pa.string())], ["item_table", "item_id", "redacted"])

    return items.select("item_table", "item_id", "text").mapInArrow(run, "item_table string, item_id bigint, redacted string")


def question_items(spark: SparkSession, data_dir: str) -> DataFrame:
    """(item_table, item_id, text) of both tables of questions."""
    log = table(spark, data_dir, "unanswered_log").select(F.lit("unanswered_log").alias("item_table"), F.col("entry_id").alias("item_id"), F.col("q").alias("text"))
    asked = table(spark, data_dir, "ask_requests").select(F.lit("ask_requests").alias("item_table"), F.col("request_id").alias("item_id"), F.col("question").alias("text"))
    return log.unionByName(asked)


def p5_found(spark: SparkSession, data_dir: str) -> DataFrame:
    """Every occurrence of personal information in both tables (see TESTDATA.md)."""
    items = question_items(spark, data_dir)
    return detect(items, fit(items)).select("item_table", "item_id", "pii_type", "start_pos").distinct()


def p5_redacted(spark: SparkSession, data_dir: str) -> DataFrame:
    """Every question with placeholders; repeats of an id and text once, different texts of one id or the null id each."""
    items = question_items(spark, data_dir)
    return redact(items.dropDuplicates(["item_table", "item_id", "text"]), fit(items))


SQL: dict[str, str] = {}
QUERIES = {"p5_found": p5_found, "p5_redacted": p5_redacted}
