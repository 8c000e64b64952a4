"""Operators against brute force, round trips and known cases."""

import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpdex.llm import language_spans, leak_index, normal_forms, personal_data, severity, similar_vectors, splitting, tokenizing

SF = "/root/testdata/sf0.01"


# languages


@pytest.fixture(scope="module")
def model(spark):
    return language_spans.fit(language_spans.table(spark, SF, "documents"))


def test_languages_of_known_texts(spark, model):
    cases = [
        ("Jak mogę zmienić hasło do poczty?", ["pl"]), ("jak moge zmienic haslo do poczty", ["pl"]), ("How can I change my password today?", ["en"]), ("Wie kann ich das Passwort für meine Mail ändern?", ["de"]),
        ("Як я можу змінити пароль до пошти?", ["uk"]), ("¿Cómo puedo cambiar la contraseña del correo?", ["es"]), ("Jak můžu změnit heslo k poště?", ["cs"]),
        ("Nie mogę otworzyć pliku od rana. Why won't it let me open the file?", ["en", "pl"]), ("Velmo E7087046??", []), ("key=12 drv:44 svc_9; job-77", []), ("if (a != b && c->d[i]) { return ~mask<<2; }", []), ("", []), (None, []), (" \n ", []), ("漢字かな 한글", []),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "id int, text string")
    got = {r["id"]: sorted(x["lang"] for x in r["langs"]) for r in language_spans.identify(df, model, ["id"]).collect()}
    assert [(t, got[i]) for i, (t, want) in enumerate(cases) if got[i] != want] == []
    sure = language_spans.identify(df, model, ["id"]).select(F.explode("langs.confidence").alias("c")).agg(F.min("c").alias("a"), F.max("c").alias("b")).first()
    assert 0 <= sure["a"] <= sure["b"] <= 1


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(0)
    scores = rng.normal(size=(7, 6)).astype(np.float32) * 3
    text, sentence = np.zeros(7, dtype=int), np.array([1, 1, 1, 2, 2, 2, 2])
    penalty = np.where(np.concatenate([[True], sentence[1:] != sentence[:-1]]), language_spans.SWITCH_AT_START, language_spans.SWITCH)

    def worth(path):
        return sum(scores[i, k] - (penalty[i] if i and path[i - 1] != k else 0) for i, k in enumerate(path))

    best = {(k,): float(scores[0, k]) for k in range(6)}
    for i in range(1, 7):
        best = {p + (k,): v + scores[i, k] - (penalty[i] if p[-1] != k else 0) for p, v in best.items() for k in range(6)}
        if i % 2 == 0:  # keep the best for each last language
            best = {max((p for p in best if p[-1] == k), key=best.get): max(best[p] for p in best if p[-1] == k) for k in range(6)}
    assert worth(tuple(language_spans.viterbi(scores, text, sentence))) == pytest.approx(max(best.values()), abs=1e-4)
    two = language_spans.viterbi(np.concatenate([scores, scores[:3]]), np.array([0] * 7 + [1] * 3), np.concatenate([sentence, [3, 3, 3]]))
    assert list(two[:7]) == list(language_spans.viterbi(scores, text, sentence))


def test_segments_have_their_texts(spark, model):
    text = "Nie mogę otworzyć pliku od rana, bo program się zawiesza. Please restore the folder from the copy of the last week."
    rows = language_spans.segments(spark.createDataFrame([(1, text), (2, None)], "id int, text string"), model, ["id"]).orderBy("start_pos").collect()
    assert [(r["lang"], text[r["start_pos"] - 1 : r["end_pos"]].split()[0]) for r in rows] == [("pl", "Nie"), ("en", "Please")]


def test_segments_of_a_batch_are_those_of_each_text(spark, model):
    texts = ["Nie mogę otworzyć pliku od rana, bo program się zawiesza. Please restore the folder from the copy of the last week.", "", "Please restore the folder from the copy.", "İİİ 12 Nie mogę otworzyć pliku od rana, bo program się zawiesza.", None, "Jak mogę zmienić hasło do poczty?"]
    columns = "id int, text string"
    together = language_spans.segments(spark.createDataFrame(list(enumerate(texts)), columns).coalesce(1), model, ["id"]).collect()
    alone = [r for i, t in enumerate(texts) for r in language_spans.segments(spark.createDataFrame([(i, t)], columns), model, ["id"]).collect()]
    assert sorted(together) == sorted(alone)
    shifted = [texts[3][r["start_pos"] - 1 : r["end_pos"]] for r in together if r["id"] == 3 and r["lang"] == "pl"]
    assert shifted and shifted[-1].endswith("się zawiesza") and "Nie mogę" in shifted[-1]


# records


def test_records(spark):
    rows = [
        (5, ("Jak?", "a/b.md")), (3, (" jak!! ", "A\\B.md")), (9, ("JAK", "a b md")), (4, ("jąk", "a/b.md")), (6, ("jak", None)), (7, ("jak", " ")), (8, ("ja", "k")), (None, ("jak", None)), (1, (None, None)),
    ]
    df = spark.createDataFrame(rows, "id bigint, record struct<q: string, top_path: string>")
    ids, groups = normal_forms.record_groups(df, "id", "record")
    assert sorted((r["first_id"], r["copies"]) for r in groups.collect()) == [(1, 1), (3, 3), (4, 1), (6, 2), (8, 1)]
    assert ids.count() == 8


def test_field_and_map_order_do_not_matter(spark):
    df = spark.sql("select map('x', 'A b', 'y', '2') as a, map('y', '2', 'x', 'ab') as b, array('1', '2') as c, array('2', '1') as d")
    kind = df.schema["a"].dataType
    got = df.select((normal_forms.merkle(F.col("a"), kind) == normal_forms.merkle(F.col("b"), kind)).alias("same"), (normal_forms.merkle(F.col("c"), df.schema["c"].dataType) == normal_forms.merkle(F.col("d"), df.schema["c"].dataType)).alias("ordered"), (normal_forms.merkle(F.col("c"), df.schema["c"].dataType, True) == normal_forms.merkle(F.col("d"), df.schema["c"].dataType, True)).alias("unordered")).first()
    assert (got["same"], got["ordered"], got["unordered"]) == (True, False, True)


def test_collisions_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(normal_forms, "merkle", lambda value, kind, unordered_arrays=False: F.lit("same"))
    df = spark.createDataFrame([(1, ("a", None)), (2, ("b", None)), (3, ("A", None))], "id bigint, record struct<q: string, top_path: string>")
    assert sorted((r["first_id"], r["copies"]) for r in normal_forms.record_groups(df, "id", "record")[1].collect()) == [(1, 2), (2, 1)]


# splitting


@pytest.mark.parametrize(("limit", "overlap", "unit"), [(120, 30, "chars"), (40, 0, "chars"), (90, 20, "bytes")])
def test_pieces_fit_overlap_and_lose_nothing(limit, overlap, unit):
    rng = random.Random(5)
    for _ in range(300):
        text = splitting.trimmed("".join(rng.choice(["słowo", "a", " ", "\n\n", "\n", ". ", "! ", "…", "xxxxxxxxxxxxxxxxxxxx", "\r\n", "😀"]) for _ in range(rng.randint(1, 120))))
        if not text:
            continue
        pieces = splitting.cut_points(text, splitting.boundaries(text), limit, overlap, unit)
        assert "".join(text[a + o : b] for a, b, o in pieces) == text
        assert all((len(text[a:b]) if unit == "chars" else len(text[a:b].encode())) <= limit for a, b, _ in pieces)
        assert all((o if unit == "chars" else len(text[a : a + o].encode())) <= overlap for a, _, o in pieces)


def test_boundaries_are_natural():
    text = "Pierwszy akapit. " * 3 + "\n\n" + "Drugi akapit ma zdania. " * 5
    pieces = splitting.cut_points(text, splitting.boundaries(text), 100, 20)
    assert pieces[0][1] == text.index("Drugi")
    assert splitting.first_level("a" * 50, splitting.boundaries("a" * 50), 20) == "none"
    with pytest.raises(ValueError, match="overlap"):
        splitting.split(None, 100, 60)


def parts(text, level):
    """The trimmed parts of a level, as the definition of the boundary has them."""
    out = re.split(r"\n[ \t]*\n", text)
    if level == "sentence":
        out = [s for part in out for s in re.split(r"(?<=[.!?…])[ \t\n\f\r]+", part)]
    return [part.strip(splitting.WHITE) for part in (re.split(r"[ \t\n\f\r]+", text) if level == "blank" else out)]


@pytest.mark.parametrize(("limit", "overlap", "unit"), [(60, 20, "chars"), (60, 0, "chars"), (90, 40, "bytes")])
def test_texts_are_cut_at_their_boundary_and_no_finer(limit, overlap, unit):
    rng = random.Random(7)
    size = len if unit == "chars" else lambda text: len(text.encode())
    seen = set()
    for words in (["słowo", "ą"], ["słowo", "😀😀"], ["żółw" * 4], ["ą" * 40, "x"]):
        for _ in range(150):
            text = splitting.trimmed("".join(rng.choice([*words * 3, " ", " ", "\n\n", "\n \n\f", "\n", ". ", "!\t", "…"]) for _ in range(rng.randint(1, 90))))
            cuts = splitting.boundaries(text)
            level = next((x for x in splitting.LEVELS if max(map(size, parts(text, x))) <= limit), "none")
            assert splitting.first_level(text, cuts, limit, unit) == level
            seen.add(level)
            pieces = splitting.cut_points(text, cuts, limit, overlap, unit)
            assert "".join(text[a + o : b] for a, b, o in pieces) == text and all(size(text[a:b]) <= limit for a, b, _ in pieces)
            assert all(a <= b < c for (a, _, _), (b, _, _), c in zip(pieces, pieces[1:], [e for _, e, _ in pieces[1:]]))
            if level != "none":
                assert all(any(x <= b <= y for x, y in zip(*cuts[level])) for _, b, _ in pieces[:-1])
    assert seen == {*splitting.LEVELS, "none"}


def test_a_paragraph_that_fits_stays_whole():
    heading, first, second = "Tytuł", "Zdanie ma kilka słów. " * 17 + "Koniec.", "Inne zdanie jest tu. " * 54 + "Koniec."
    text = "\n\n".join([heading, first, second])
    assert len(heading + first) < 600 and 1080 < len(second) <= 1200
    pieces = splitting.cut_points(text, splitting.boundaries(text), 1200, 120)
    assert [text[a + o : b].strip() for a, b, o in pieces] == [f"{heading}\n\n{first}", second]
    assert 0 < pieces[1][2] <= 1200 - len(second)


def test_pieces_in_bytes_are_labelled_in_bytes(spark):
    items = spark.createDataFrame([("t", "a", "ą" * 15 + "\n\n" + "ą" * 15), ("t", "b", "ą" * 9 + ". " + "ą" * 9)], "item_table string, item_key string, text string")
    assert {tuple(r) for r in splitting.split(items, 20, 4, "bytes").select("item_key", "boundary").collect()} == {("a", "none"), ("b", "sentence")}


def test_boundaries_of_long_white_space_take_one_pass():
    text = "a" + " \n\f" * 20_000 + "b"
    began = time.process_time()
    cuts = splitting.boundaries(text)
    assert time.process_time() - began < 1
    assert [x.tolist() for x in cuts["blank"]] == [[1], [len(text) - 1]] and len(cuts["paragraph"][0]) == 0


# vectors


def vectors(spark, rows):
    return spark.createDataFrame(rows, "id bigint, kind string, vec array<float>")


def brute(rows, least, top):
    out = set()
    for kind in {k for _, k, _ in rows if k}:
        own = {i: np.array(v, dtype=float) for i, k, v in rows if k == kind and i is not None and v is not None and len(v) == 64 and np.isfinite(v).all() and np.any(v)}
        ids = sorted(own)
        x = np.array([own[i] / np.linalg.norm(own[i]) for i in ids]).reshape(-1, 64)
        s = np.round(x @ x.T, 6)
        for a in range(len(ids)):
            order = sorted((-s[a, b], ids[b]) for b in range(len(ids)) if b != a)[:top]
            out |= {(min(ids[a], b), max(ids[a], b)) for c, b in order if -c >= least}
    return out


@pytest.mark.parametrize("cell", [4_000, 6])
def test_similar_vectors(spark, monkeypatch, cell):
    monkeypatch.setattr(similar_vectors, "CELL", cell)
    rng = np.random.default_rng(2)
    rows, i = [], 0
    for _ in range(150):
        base = rng.normal(size=64)
        base /= np.linalg.norm(base)
        for _ in range(int(rng.integers(1, 5))):
            noise = rng.normal(size=64)
            v = base + noise / np.linalg.norm(noise) * rng.uniform(0, 0.35)
            rows.append((i, "text" if i % 3 else "question", (v * rng.choice([1, 12])).tolist()))
            i += 1
    rows += [(1000 + k, "text", rows[1][2]) for k in range(9)] + [(2000, "text", None), (2001, "text", [0.0] * 64), (2002, "text", [1.0] * 3), (2003, "text", [float("nan")] * 64), (2004, None, rows[0][2]), rows[3], rows[3]]
    got = {(r["id_a"], r["id_b"]) for r in similar_vectors.similar(vectors(spark, rows), 0.9).collect()}
    want = brute(rows, 0.9, 5)
    assert len(got & want) >= 0.98 * len(want) and len(got - want) <= 0.02 * len(want)


@pytest.mark.parametrize("cell", [24_000, 1_500])
@pytest.mark.parametrize("inside", [0.92, 0.96])
def test_recall_in_a_dense_group(spark, monkeypatch, inside, cell):
    monkeypatch.setattr(similar_vectors, "CELL", cell)
    rng, n = np.random.default_rng(3), 12_000
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    dense = unit(rng.normal(size=64)) + np.sqrt(1 / inside - 1) / 8 * rng.normal(size=(n // 3, 64))
    apart = unit(rng.normal(size=(n // 3, 64)))
    near = apart + rng.uniform(0.2, 0.48, size=(n // 3, 1)) * unit(rng.normal(size=(n // 3, 64)))
    x = unit(np.concatenate([dense, apart, near])).astype(np.float32)
    got = {(r["id_a"], r["id_b"]) for r in similar_vectors.similar(vectors(spark, [(i, "text", v) for i, v in enumerate(x.tolist())]), 0.9).collect()}
    s = x @ x.T
    np.fill_diagonal(s, -2)
    best = np.argpartition(-s, 5, axis=1)[:, :5]
    want = {(min(a, b), max(a, b)) for a, row in enumerate(best.tolist()) for b in row if s[a, b] >= 0.9}
    in_group, rest = {p for p in want if p[1] < n // 3}, {p for p in want if p[1] >= n // 3}
    assert len(rest) > 2_000 and len(in_group) > 10_000
    assert len(got & in_group) >= 0.99 * len(in_group) and len(got & rest) >= 0.99 * len(rest)
    assert len(got - want) <= 0.001 * len(want)


def test_a_cell_gives_short_lists(spark):
    rng, n = np.random.default_rng(4), 1_000
    x = np.ones(64) / 8 + rng.normal(size=(n, 64)) / 100
    pairs = similar_vectors.near_pairs(spark.createDataFrame([(i, "text", (v / np.linalg.norm(v)).tolist()) for i, v in enumerate(x)], "rep bigint, kind string, unit array<float>"), 0.9)
    assert pairs.groupBy("a").count().agg(F.count("a").alias("n"), F.max("count").alias("most")).first() == (n, 5)


def test_candidates_hold_the_pairs_that_count():
    """Lookups with codes lose none of the pairs at the limit, and leave most other pairs out."""
    rng = np.random.default_rng(7)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    base = unit(rng.normal(size=(1_500, 64)))
    x = unit(np.concatenate([base, base + 0.46 * unit(rng.normal(size=base.shape))])).astype(np.float32)
    index = similar_vectors.indexed(x)
    code, norm, close = similar_vectors.encoded(x, index)
    cell = similar_vectors.coded(x, code, norm, close, index.books, 0.9)
    hit = cell.candidates(cell.tables(x), 0, len(x))
    near = x @ x.T >= 0.9
    assert near.sum() > 4_000 and (hit & near).sum() >= 0.999 * near.sum() and hit.mean() < 0.05


def test_nearest_recall(spark):
    chunks = similar_vectors.table(spark, "/root/testdata/sf0.1", "chunks")
    got: dict[int, set] = {}
    for r in similar_vectors.nearest(chunks, F.col("id") % 100 == 0).collect():
        got.setdefault(r["id"], set()).add(r["neighbour"])
    rows = {(r["kind"], r["id"]): r["vec"] for r in chunks.select("id", "kind", "vec").collect() if r["vec"] is not None and len(r["vec"]) == 64 and np.isfinite(r["vec"]).all() and np.any(r["vec"])}
    right = total = 0
    for kind in {k for k, _ in rows}:
        ids = np.array(sorted(i for k, i in rows if k == kind))
        x = np.array([rows[kind, i] for i in ids], dtype=float)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        for a in np.flatnonzero(ids % 100 == 0):
            s = x @ x[a]
            s[a] = -2
            true = set(ids[np.argsort(-s)[:5]].tolist())
            right, total = right + len(true & got.get(int(ids[a]), set())), total + 5
    assert right / total >= 0.9


# personal data


def test_personal_data(spark):
    items = personal_data.question_items(spark, SF)
    trees = personal_data.fit(items)
    cases = [
        ("Oddzwońcie na +48 310 952 676 jeszcze dziś.", [("phone", "+48 310 952 676")]), ("Numer zgłoszenia 700858778.", []), ("nr zamówienia 99886515432", []), ("Mój PESEL: 366602-40337.", [("idno", "366602-40337")]),
        ("numer dowodu PNV 383237, numer seryjny DMA698129", [("idno", "PNV 383237")]), ("kontakt: jan.kowal+it (at) example.com, adres IP 192.0.2.58", [("email", "jan.kowal+it (at) example.com")]), ("Nazywam się zofia oskwarnenda.", [("name", "zofia oskwarnenda")]),
        ("Bitte unter +49 (009) 484-877 anrufen.", [("phone", "+49 (009) 484-877")]), ("bitte liefern an Wacholdersteig 102b, Grimmstätten", [("address", "Wacholdersteig 102b")]), ("Volejte prosím na +420005621271.", [("phone", "+420005621271")]), ("Mein Name ist Matthias Hohlbrand.", [("name", "Matthias Hohlbrand")]), ("Pozdrawiam, dział IT", []), ("Sprzęt stoi pod adresem ul. Gajowa Nowa 170 m. 2, Świtogóra.", [("address", "ul. Gajowa Nowa 170 m. 2")]), ("port 8443, limit 500 123 bajtów", []), ("Velmo pokazuje błąd HD-7911086", []), ("please ship it to 363 Larchbury Road, now", [("address", "363 Larchbury Road")]), ("", []), (None, []),
    ]
    df = spark.createDataFrame([("t", i, t) for i, (t, _) in enumerate(cases)], "item_table string, item_id bigint, text string")
    got: dict[int, list] = {}
    for r in personal_data.detect(df, trees).orderBy("start_pos").collect():
        got.setdefault(r["item_id"], []).append((r["pii_type"], cases[r["item_id"]][0][r["start_pos"] - 1 : r["end_pos"]]))
    assert [(t, got.get(i)) for i, (t, want) in enumerate(cases) if got.get(i, []) != want] == []
    out = {r["item_id"]: r["redacted"] for r in personal_data.redact(df, trees).collect()}
    assert out[0] == "Oddzwońcie na [PHONE] jeszcze dziś." and out[17] is None and out[1] == cases[1][0]


def test_grouped_cues_match_as_written():
    rng = random.Random(5)
    words = "tel telefon call dzwonic hotel paszport dowodu osobisty ssn social security ni number adres kurier nazywam sie name is name ist pozdrawiam, mailem order ticket port passport mój номер заявки на ім'я: moj numer to x".split()
    texts = [rng.choice(["", " ", ", ", ": "]).join(rng.choices(words, k=9)) for _ in range(400)]
    for pattern, quick in [*((personal_data.CUES[k], personal_data.CUE[k]) for k in personal_data.CUES), (personal_data.OTHER_CUES, personal_data.NO_CUE)]:
        plain = re.compile(pattern)
        assert all([m.span() for m in plain.finditer(t)] == [m.span() for m in quick.finditer(t)] for t in texts)
    with pytest.raises(ValueError):
        personal_data.by_first_letter("tel|x?y")


def test_address_filter_passes_every_match():
    rng = random.Random(8)
    bits = ["ul. ", "ulica ", "Gajowa ", "Alte ", "Mühlgasse ", "STRASSE ", "Hauptstraße ", "str. ", "flat 3, ", "12 ", "7b, ", "363 ", "Larchbury ", "Road", "вул. ", "Шевченка ", "c/ ", "Mayor ", "HD-1234567 ", "10.2 ", "m. 2", "Kupferhain ", ", 04393 Stadt", "x"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(1, 6))) for _ in range(20_000)]
    matched = [t for t in texts if personal_data.ADDRESS.search(t)]
    assert len(matched) > 1_000 and all(personal_data.may_have_address(personal_data.folded(t)) for t in matched)


# tokens


def test_tree_equals_encoding_at_once():
    encode = tokenizing.encoder(f"{tokenizing.TOKENIZER_DIR}/{tokenizing.VOCABULARY}").encode_ordinary
    rng = random.Random(1)
    bits = ["'", "l", "'l", "ll", "ve", " ", "  ", "\n", "a", "I", "12", "é", "漢", "'re", "!", "\t", "😀", "<|endoftext|>"]
    for _ in range(1500):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(1, 60)))
        assert tokenizing.encode_text(text, encode, rng.choice([1, 2, 3, 5, 8, 50])) == encode(text)
    assert tokenizing.encode_text(None, encode) == tokenizing.encode_text("", encode) == []


def test_ids_are_those_of_the_other_library(spark):
    from tokenizers import Tokenizer

    other = Tokenizer.from_file(f"{tokenizing.TOKENIZER_DIR}/byte_bpe_50k.json")
    other.encode_special_tokens = True
    docs = tokenizing.table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text")
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    for r in tokenizing.encode_corpus(docs, leaf_chars=100).collect():
        assert r["ids"] == other.encode(texts[r["doc_id"]], add_special_tokens=False).ids


# leaks


def holds(item, doc):
    """The rule itself, by dynamic programming over all windows."""
    n, m = len(item), len(doc)
    for a in range(n):
        for b in range(m):
            k = 0
            while a + k < n and b + k < m and item[a + k] == doc[b + k]:
                k += 1
            if k >= leak_index.EXACT:
                return True
    met, lost, five = np.array([[x == y for y in doc] for x in item]).reshape(n, m), -10_000, 5 * np.arange(m + 1)
    for s in range(n - leak_index.FUZZY + 1):
        row = np.concatenate([[lost], np.where(met[s], 1, lost)])
        for k in range(1, n - s):
            row = np.maximum.accumulate(row + five) - five
            kept = np.where(met[s + k], row[:-1] + 1, lost)
            if k + 1 >= leak_index.FUZZY and m and kept.max() >= 0:
                return True
            row = np.maximum(row - 4, np.concatenate([[lost], np.maximum(kept, row[:-1] - 4)]))
    return False


def planted(rng, items, words, n, most, edits):
    """``n`` documents that hold a part of up to ``most`` words of an item with up to ``edits`` edits."""
    docs = []
    for _ in range(n):
        doc = [rng.choice(words + ["zz"]) for _ in range(rng.randint(0, 20))]
        item = rng.choice(items)
        a = rng.randrange(len(item))
        part = list(item[a : a + rng.randint(8, most)])
        for _ in range(rng.randint(0, edits)):
            if part:
                k = rng.randrange(len(part))
                part[k : k + 1] = rng.choice([[], ["yy"], [part[k], "yy"]])
        docs.append(doc + part + [rng.choice(words) for _ in range(rng.randint(0, 10))])
    return docs


def test_leaks_equal_the_rule(spark, monkeypatch):
    monkeypatch.setattr(leak_index, "SHARD_WORDS", 400)
    rng = random.Random(4)
    words = [f"w{i}" for i in range(40)]
    items = [[rng.choice(words) for _ in range(rng.randint(8, 45))] for _ in range(12)]
    docs = planted(rng, items, words, 120, 40, 6)
    df = spark.createDataFrame([(i, "**" + ", ".join(w.upper() for w in d) + "**") for i, d in enumerate(docs)] + [(900, None), (901, "")], "doc_id bigint, text string")
    it = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)] + [(90, None)], "item_id bigint, text string")
    got = {(r["item_id"], r["doc_id"]) for r in leak_index.leaks(df, it).collect()}
    assert got == {(i, d) for i, t in enumerate(items) for d, x in enumerate(docs) if holds(t, x)}
    spans = leak_index.removal_spans(df, it).collect()
    assert {r["doc_id"] for r in spans} == {d for _, d in got} and all(r["start_pos"] <= r["end_pos"] for r in spans)


def test_long_windows_have_short_ones(spark):
    """Passages far longer than REACH whose edits stand close together or apart, against windows of any length."""
    rng = random.Random(6)
    items = [[f"{k}w{i}" for i in range(rng.randint(48, 90))] for k in range(4)]
    docs = planted(rng, items, ["zz"], 60, 90, 22)
    for item in items:
        for gap in (6, 9, 12, 14):
            a = rng.randint(17, 24)
            docs.append(item[:a] + item[a + gap :])
            docs.append(item[:a] + ["zz"] * (gap // 2) + item[a + gap // 2 : a + gap // 2 + 1] + ["zz"] * (gap // 2) + item[a + gap :])
    df = spark.createDataFrame([(i, " ".join(d)) for i, d in enumerate(docs)], "doc_id bigint, text string")
    it = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id bigint, text string")
    got = {(r["item_id"], r["doc_id"]) for r in leak_index.leaks(df, it).collect()}
    assert got == {(i, d) for i, t in enumerate(items) for d, x in enumerate(docs) if holds(t, x)}


def test_a_short_quote_is_not_padded(spark):
    item = [f"w{i}" for i in range(40)]
    docs = [item[5:13] + ["x"] + item[14:22], item[5:15] + ["x"] + item[16:26]]  # 17 and 21 words, one changed
    df = spark.createDataFrame([(i, " ".join(["a"] * 9 + d + ["b"] * 9)) for i, d in enumerate(docs)], "doc_id bigint, text string")
    assert [tuple(r) for r in leak_index.leaks(df, spark.createDataFrame([(7, " ".join(item))], "item_id bigint, text string")).collect()] == [(7, 1)]


def test_index_finds_every_place():
    rng = np.random.default_rng(0)
    text = rng.integers(1, 5, size=500).astype(np.int32)
    index = leak_index.FmIndex(text, 6)
    phrases = np.array([[a, b, c] for a in range(1, 5) for b in range(1, 5) for c in range(1, 5)], dtype=np.int32)
    low, high = index.search(phrases)
    for p, a, b in zip(phrases, low, high):
        assert sorted(index.locate(np.arange(a, b))) == [k for k in range(498) if (text[k : k + 3] == p).all()]


# severity


def test_evasive_spellings():
    for text in ("ty idioto", "ty i.d.i.o.t.o", "ty i d i o t o", "ty id​ioto", "ty 1d10to", "ty 0d00t0", "ty іdіоtо", "ty iiidioto"):
        found = severity.features(text)
        assert severity.NAMES.index("insult") in found, text
    assert severity.DENSE - 2 in severity.features("spieprzaj, b******e")
    assert severity.features("...") is None


def test_phrases_are_found_by_their_first_word():
    for family, phrases in severity.PHRASES.items():
        for phrase in phrases:
            assert severity.NAMES.index(family) in severity.features(f"xyz {phrase} qwv"), phrase


def test_severity(spark):
    documents, votes = severity.table(spark, SF, "documents"), severity.table(spark, SF, "review_labels")
    fitted = severity.fit(documents, votes)
    cases = [("Zamknij się, idioto, nikt cię tu nie pytał.", True), ("I hope you choke on your own keyboard, moron.", True), ("Zabij proces potomny i usuń osierocone wątki.", False), ("Pole płeć (sex) w formularzu jest wymagane.", False), ("This dumb terminal has a stupid default, my own mistake, sorry.", False), ("Jak mogę zmienić hasło?", False), ("", False), (None, False), ("Nie mogę nic zrobić od rana i program ciągle się zawiesza przy starcie zamknij się, idioto, nikt cię tu nie pytał", True)]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in severity.score(df, fitted, ["doc_id"]).collect()}
    assert [(t, got[i]["severity"]) for i, (t, want) in enumerate(cases) if got[i]["flagged"] != want] == []
    assert all(0 <= r["severity"] <= 2 for r in got.values()) and got[6]["severity"] == got[7]["severity"] == 0


def test_held_out_votes(spark):
    documents, votes = severity.table(spark, "/root/testdata/sf0.1", "documents"), severity.table(spark, "/root/testdata/sf0.1", "review_labels")
    held = F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0
    fitted = severity.fit(documents, votes.where(~held))
    grades = {r["doc_id"]: r["grade"] for r in severity.graded(votes.where(held)).collect()}
    got = severity.score(documents.where(held), fitted, ["doc_id"]).collect()
    judged = [(r["flagged"], grades[r["doc_id"]]) for r in got if grades.get(r["doc_id"]) in (0, 2)]
    assert sum(f == (g > 0) for f, g in judged) / len(judged) >= 0.85


def test_grades(spark):
    votes = spark.createDataFrame([(1, 0), (1, 1), (2, 1), (2, 1), (3, 0), (4, None)], "doc_id bigint, toxic int")
    assert sorted(map(tuple, severity.graded(votes).collect())) == [(1, 1), (2, 2), (3, 0)]
