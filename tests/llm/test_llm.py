"""Operators on text against brute force, planted cases and round trips."""

import random
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

import __spark_entry__ as entry
from auditlake.llm import encoding, leaks, mixing, quality, queries, residue, terms
from tests.conftest import DATA
from tests.test_entry import rows_of, rows_of_sql


@pytest.mark.parametrize("name", list(queries.SQL))
def test_matches_sql(spark, name):
    assert rows_of(queries.QUERIES[name](spark, DATA)) == rows_of_sql(queries.SQL[name])


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_empty_and_awkward_tables(spark, empty_tables, awkward_tables, name):
    assert queries.QUERIES[name](spark, empty_tables).count() in (0, 1)
    queries.QUERIES[name](spark, awkward_tables).count()


def test_entry_has_the_queries():
    assert set(queries.QUERIES) <= set(entry.queries())


# --- residue ---------------------------------------------------------------------------------

REAL = "<p>The old mill was renewed last winter. Guests can book a table by phone every day.</p>"


def page(body, title="A title", extra=""):
    return f"<html><head><title>{title}</title>{extra}</head><body><ul class='nav'><li><a href='/'>Home</a></li></ul><main>{body}</main><footer>x 2024</footer></body></html>"


CASES = {
    page("<h1>{{ page.title }}</h1>" + REAL): True,
    page(REAL, "Hello %%FIRST_NAME%%"): True,
    page(REAL, extra='<meta name="description" content="[Your Company Name]">'): True,
    page(REAL + "<p>Click here to edit this paragraph.</p>"): True,
    page(REAL + "<p>Votre texte ici</p>"): True,
    page("<h1>Page not found</h1><p>Sorry, the page you wanted does not exist or has moved.</p><p>Back to home</p>"): True,
    page("<h1>Our shop</h1><p>Please enable JavaScript to view this page.</p>"): True,
    page("<noscript>You need to enable JavaScript to run this app.</noscript><div id=app></div>"): True,
    page("<p>Lorem ipsum dolor sit amet consectetur elit sed do.</p>"): True,
    page("<p>You have no permission to see this resource. Reference id 7fa3.</p>"): True,
    page(REAL): False,
    page(REAL + "<noscript>Please enable JavaScript to view this page.</noscript>"): False,
    page(REAL + "<pre><code>&lt;h1&gt;{{ title }}&lt;/h1&gt;</code></pre><!-- {{ x }} --><script>var a='{{b}}'</script>"): False,
    page("<h1>Why “404 Not Found” pages need care</h1>" + REAL + "<p>Every site shows 404 Not Found now and then, and a good page tells visitors where to go next.</p>"): False,
    page(REAL + "<p>The set {a, b, c} holds three keys. See note [8] and figure {6}. The blue one is gone [sold out] until June.</p>"): False,
    page(REAL + "<p>Write your name here at the desk and take a number.</p>"): False,
    page("<p>庭の茶屋は通りの奥で長く暖かさを保ちます。</p>"): False,
    "": False,
    None: False,
}


def test_residue_cases(spark):
    rows = list(enumerate(CASES))
    rows += [(100 + i, h) for i, h in rows]  # repeated captures are cases of their own
    df = spark.createDataFrame(rows, "page_id long, html string")
    want = {i for i, h in rows if CASES[h]}
    assert {r.page_id for r in residue.residue_pages(df).collect()} == want


def test_what_messages_say_is_learned_from_them(spark, monkeypatch):
    says = ["The lift stopped between two floors of the building and nobody can tell for how long it will stay there today.", "A person will look after it as soon as the others have been helped out of their own lifts next door."]
    rows = [(k, f"https://site{k % 3}.example/", page("<h1>503 Service Unavailable</h1>" + "".join(f"<p>{x}</p>" for x in says))) for k in range(6)]
    rows += [(10, "u10", page(f"<h1>Hm</h1><p>{says[0]}</p>")), (11, "u11", page(f"<h1>Hm</h1><p>{says[0].replace('nobody', 'no one')}</p>")), (12, "u12", page(REAL + f"<p>{says[1]}</p>")), (13, "u13", page(REAL))]
    rows += [(14, "u14", page("<h1>404 Not Found</h1><p>The lamp is not here any more.</p>")), (15, "u15", page("<h1>404 Not Found</h1>" + REAL + REAL.replace("mill", "barn").replace("table", "room")))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = lambda: {r.page_id for r in residue.residue_pages(df).collect()}
    assert found() == {*range(6), 10, 11, 14}
    monkeypatch.setattr(residue, "learn", lambda stands, totals, known: known.limit(0))
    assert found() == {14}  # without the spread the unknown sentences are real


def test_long_placeholders_and_form_fields(spark):
    rows = [page(REAL + "<p>{{ " + "x" * 200 + " }}</p>"), page(REAL + "<textarea>{{ note }}</textarea>"), page(REAL + "<samp>%%NAME%%</samp>"), page(REAL + "<template>{{ row }}</template>")]
    df = spark.createDataFrame(list(enumerate(rows)), "page_id long, html string")
    assert {r.page_id for r in residue.residue_pages(df).collect()} == {0, 1, 2}


def test_labels_spread_to_near_duplicates(spark):
    trusted = "the requested service is offline at the moment, please come back in a short while to try once more"
    near, nearer = trusted.replace("short", "shorter"), trusted.replace("short", "shorter").replace("offline", "off-line")
    far = "the evening course is open to all ages and guests can book a seat by phone on every day of the week"
    texts = [trusted, near, nearer, far]
    prints = residue.fingerprints(texts).tolist()
    df = spark.createDataFrame([(i, t, p, "error" if i == 0 else None) for i, (t, p) in enumerate(zip(texts, prints, strict=True))], "unit long, text string, print long, label string")
    got = {r.unit for r in residue.spread_labels(df).collect()}
    chain = {0}
    for _ in texts:  # the same by brute force
        chain |= {j for i in chain for j in range(4) if residue.similarity(texts[i], texts[j]) >= residue.SIMILAR and bin((prints[i] ^ prints[j]) & (2**64 - 1)).count("1") <= residue.HAMMING}
    assert got == chain and 3 not in got


def test_shingle_search_finds_every_similar_pair(spark):
    rng = random.Random(4)
    words = "the of service page offline closed moment shortly visit again please later reader garden river quiet old new x 日本語 café".split()
    texts = {"", "a", "ab"}
    for _ in range(60):
        base = rng.choices(words, k=rng.randint(1, 14))
        texts.add(" ".join(base))
        for _ in range(3):  # edits of a word or two
            base[rng.randrange(len(base))] = rng.choice(words)
            texts.add(" ".join(base))
    texts = sorted(texts)
    df = spark.createDataFrame([(i, t, "error" if i % 5 == 0 else None) for i, t in enumerate(texts)], "unit long, text string, label string")
    got = {r.unit for r in residue.spread_labels(residue.with_prefixes(df), rounds=len(texts)).collect()}
    chain, last = set(), set(range(0, len(texts), 5))
    while last:
        chain |= last
        last = {j for i in last for j in range(len(texts)) if residue.similarity(texts[i], texts[j]) >= residue.SIMILAR} - chain
    assert got == chain and len(texts) / 5 + 10 < len(chain) < len(texts)


def test_message_that_differs_by_a_word_is_residue(spark):
    trusted = "The file you asked for was deleted from our archive last week."
    other = trusted.replace("was", "got")
    pair = [residue.normal(trusted), residue.normal(other)]
    assert [residue.trusted_label(t) for t in pair] == ["error", None]
    a, b = residue.fingerprints(pair).tolist()
    assert residue.similarity(*pair) >= residue.SIMILAR and bin((a ^ b) & (2**64 - 1)).count("1") > residue.HAMMING
    df = spark.createDataFrame([(1, page(f"<p>{trusted}</p>")), (2, page(f"<p>{other}</p>")), (3, page(REAL))], "page_id long, html string")
    assert {r.page_id for r in residue.residue_pages(df).collect()} == {1, 2}


def test_tables_find_every_close_pair(spark):
    rng = random.Random(1)
    base = [rng.getrandbits(64) for _ in range(40)]
    close = [b ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, residue.HAMMING))) for b in base]
    signed = lambda x: x - 2**64 if x >= 2**63 else x
    df = spark.createDataFrame([(i, signed(a), signed(b)) for i, (a, b) in enumerate(zip(base, close, strict=True))], "i int, a long, b long")
    both = df.select("i", residue._tables("a").alias("x"), residue._tables("b").alias("y"))
    assert both.where("size(array_intersect(x, y)) > 0").count() == 40


def test_fingerprints_do_not_depend_on_company():
    texts = ["one text", "another text that is longer", "x", "日本語のテキスト", "x" * 5000]
    alone = [int(residue.fingerprints([t])[0]) for t in texts]
    assert residue.fingerprints(texts).tolist() == alone and len(residue.fingerprints([])) == 0


# --- encoding --------------------------------------------------------------------------------

CLEAN = {
    "de": "Die Gärtnerei öffnet werktags früh für Gäste und die Bäckerei gehört zu den schönsten Orten am Fluss über der Brücke",
    "fr": "La pépinière a été rénovée l’hiver passé et le café garde la chaleur très longtemps grâce à nos voisins",
    "ru": "Паром на остров открывается утром для школ и кружков рядом с мостом по желанию гостей",
    "ja": "古い時計台は川の近くで冬に改装されました 庭の茶屋は通りの奥で長く暖かさを保ちます",
    "pl": "Czytelnia książek służy też dzieciom na końcu wąskiej uliczki dzięki naszym sąsiadom od wczesnej wiosny",
}


def model_of(texts):
    counts = Counter()
    for t in texts:
        for w in t.split(" "):
            if not w.isascii() and not encoding.looks_damaged(w):
                counts.update(encoding.trigrams(w))
    return encoding.Model({g: n * 20 for g, n in counts.items()})


MODEL = model_of(CLEAN.values())
DAMAGE = [("de", "utf-8", "cp1252"), ("fr", "utf-8", "cp437"), ("fr", "utf-8", "mac-roman"), ("ru", "utf-8", "cp1251"), ("ru", "cp1251", "cp1252"), ("ru", "koi8-r", "cp1251"), ("ja", "shift_jis", "cp1252"), ("ja", "euc_jp", "cp1252"), ("pl", "iso8859-2", "cp1252"), ("de", "utf-8", "cp1250")]


def misread(raw, charset):
    table = {v: chr(k) for k, v in encoding._bytes_of(charset).items()}
    return "".join(table[b] for b in raw)


@pytest.mark.parametrize(("lang", "true", "wrong"), DAMAGE)
def test_damage_is_found_and_undone(lang, true, wrong):
    text = CLEAN[lang].replace("’", "'")
    bad = misread(text.encode(true), wrong)
    damaged, restorable, _, gain, restored = encoding.judge(MODEL, f"<p>{bad}</p>")
    assert damaged and restorable and gain > encoding.MARGIN and restored == f"<p>{text}</p>"


def test_damage_in_layers_and_lost_text():
    twice = misread(misread(CLEAN["de"].encode(), "cp1252").encode(), "cp1252")
    assert encoding.judge(MODEL, f"<p>{twice}</p>")[4] == f"<p>{CLEAN['de']}</p>"
    for lost in ("El a�o", misread("El a�o".encode(), "cp1252")):
        assert encoding.judge(MODEL, f"<p>{lost}</p>")[:2] == (True, False)


@pytest.mark.parametrize("text", [*CLEAN.values(), "© 2024 · £12 · 5 ½ × 7 · 20 °C · § 4 · ¶ · ±3 · µ", "Â, Ã, É, Ê: the capital letters", "SÃO TEL · NÃO FUMADORES", "<code>GrÃ¶ÃŸe</code> is a sample", "plain", "", None])
def test_clean_text_stays(text):
    assert encoding.judge(MODEL, text and f"<p>{text}</p>")[0] is False


@pytest.mark.parametrize("lang", ["de", "ru"])
def test_damaged_segment_with_entities_is_undone(lang):
    text = CLEAN[lang]
    bad = misread(text.encode(), "cp1252")
    head, tail = bad.split(" ", 1)
    for whole in (f"{bad} Tom &amp; Co &lt;x", f"Tom&nbsp;A &amp; {bad}", f"{head} &amp; {tail}"):
        page = f'<p title="{whole}">{whole}</p><p>&amp;</p><code>{bad}</code>'
        fixed = page.split("<code>")[0].replace(bad, text).replace(head, text.split(" ", 1)[0]).replace(tail, text.split(" ", 1)[1])
        assert encoding.judge(MODEL, page)[4] == f"{fixed}<code>{bad}</code>"
    written = "".join(f"&#{ord(c)};" if not c.isascii() else c for c in bad)
    assert encoding.judge(MODEL, f"<p>{written}</p>")[4] == f"<p>{text}</p>"


@pytest.mark.parametrize("around", ["<pre>{}</pre>", "<script type='application/ld+json'>{{'name': '{}'}}</script>", "<!-- {} -->", "<samp>{}</samp>"])
def test_damage_counts_anywhere_but_in_code(around):
    bad = misread(CLEAN["de"].encode(), "cp1252")
    assert encoding.judge(MODEL, around.format(bad))[4] == around.format(CLEAN["de"])
    assert not encoding.judge(MODEL, around.format(f"<code>{bad}</code>"))[0]


def test_spans_lie_where_their_segments_stand():
    page = '<p title="é &amp; ü">ä</p><code>ö</code>ß &eacute;<!-- ñ --> x'
    assert [page[a:b] for a, b, _ in encoding.spans(page)] == ["é &amp; ü", "ä", "ß &eacute;", "!-- ñ --"]
    assert encoding.segments(page) == ["é & ü", "ä", "ß é", "!-- ñ --"]


def test_margin_separates_held_out_words():
    held = ["Die Wärme über Mühle und Straße", "Le guide des débutants à la rivière", "Мастерская у реки работает"]
    for t in held:
        assert encoding.segment_chain(MODEL, t)[1] <= encoding.MARGIN
        assert encoding.segment_chain(MODEL, misread(t.encode(), "cp1252"))[1] > encoding.MARGIN


def test_margin_is_validated_on_held_out_segments(spark):
    model = type("B", (), {"value": MODEL.three})()
    words = [w for t in CLEAN.values() for w in t.split(" ") if not w.isascii()]
    rng = random.Random(5)
    held = spark.createDataFrame([([" ".join(rng.sample(words, 4))],) for _ in range(300)], "segments array<string>")
    assert encoding.validated_margin(held.limit(3), model) == encoding.MARGIN
    counts = {m: 0 for m in encoding.MARGINS}
    for (s,) in held.collect():
        gain, bad = encoding.segment_chain(MODEL, s[0])[1], encoding.segment_chain(MODEL, encoding._misread(s[0]))[1]
        for m in counts:
            counts[m] += (gain > m) + (bad <= m)
    assert counts[encoding.validated_margin(held, model)] == min(counts.values())


@pytest.mark.parametrize(("true", "wrong"), [("shift_jis", "gb18030"), ("euc_kr", "gb18030"), ("big5", "gb18030"), ("euc_jp", "big5")])
def test_chains_between_double_byte_charsets(true, wrong):
    found = 0
    for text in ("古い時計台", "庭の茶屋", "川辺", "時計", "茶屋", "한국어", "문서", "長城", "天氣"):
        try:
            bad = text.encode(true).decode(wrong)
            if bad.encode(wrong) != text.encode(true):
                continue
        except UnicodeError:
            continue
        found += 1
        assert f"{wrong}>{true};" in encoding.candidates(bad).get(text, [])
    assert found


def test_training_in_tasks(spark):
    df = spark.createDataFrame([(f"<p>{t}</p>",) for t in CLEAN.values()] * 5 + [(None,), ("",)], "html string")
    model = encoding.train(df)
    assert encoding.judge(model, f"<p>{misread(CLEAN['de'].encode(), 'cp1252')}</p>")[0]


# --- terms -----------------------------------------------------------------------------------


def test_heavy_terms_are_not_sent(spark):
    df = spark.range(20_000).selectExpr("id AS item", "id DIV 5 AS record", "'heavy and rather long' AS f", "concat('light', id DIV 2) AS g")
    got, total = terms.term_frequencies(df, "record", "item", ["f", "g"])
    assert total == 4000 and {(r.n_items, r.n_records) for r in got.where("field = 'f'").collect()} == {(20_000, 4000)} and got.where("field = 'g' and n_items = 2").count() == 10_000
    block = pa.table({"record": pa.array([5, 5, 9]), "item": pa.array([2**62, -(2**62), 3]), "f0": pa.array([1, 0, 2], pa.uint8())})
    assert terms.unpacked(terms.packed(block)).equals(block)
    scan = terms._scan(["f0"], type("B", (), {"value": {"f0": ["heavy and rather long"]}})())
    batch = pa.record_batch({"record": [1] * 50, "item": list(range(50)), "f0": ["heavy and rather long"] * 50, "bucket": pa.array([0] * 50, pa.int32()), "f0_bucket": pa.array([0] * 50, pa.int32())})
    sent = [r for b in scan(iter([batch])) for r in b.to_pylist()]
    assert [r["n"] for r in sent if r["block"] is None] == [50] and all(b"heavy" not in (r["block"] or b"") for r in sent)


@pytest.mark.parametrize("hot", [False, True])
def test_term_counts(spark, hot):
    rng = random.Random(7)
    rows = []
    for i in range(3000):
        record = 0 if hot and rng.random() < 0.4 else rng.randint(1, 400)
        value = rng.choice(["a", " A ", "b", None, " ", f"rare{rng.randint(0, 900)}"])
        rows.append((i, record, value, rng.choice(["x", "Y", None])))
    rows += rows[:300]
    df = spark.createDataFrame([*rows, (None, 1, "z", "z"), (1, None, "z", "z")], "item long, record long, f string, g string")
    got, total = terms.term_frequencies(df, "record", "item", ["f", "g"])
    items, records = defaultdict(set), defaultdict(set)
    for i, r, f, g in rows:
        for name, v in (("f", f), ("g", g)):
            if v and v.strip():
                items[name, v.strip().lower()].add(i)
                records[name, v.strip().lower()].add(r)
    assert {(x.field, x.term): (x.n_items, x.n_records) for x in got.collect()} == {k: (len(items[k]), len(records[k])) for k in items}
    assert total == len({r for _, r, _, _ in rows})


# --- leaks -----------------------------------------------------------------------------------


def test_leaks(spark):
    rng = random.Random(9)
    vocabulary = [f"word{i}" for i in range(300)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(12, 60))), "what?", None) for i in range(12)] + [(90, None, None, None), (91, "too short", None, None)]
    docs = [(0, None), (1, ""), (2, "x" * 300_000)]
    for d in range(3, 120):
        ws = rng.choices(vocabulary, k=80)
        if d % 3:
            source = items[rng.randrange(12)][1].split()
            n = rng.randint(9, 14)
            at = rng.randrange(max(1, len(source) - n))
            pos = rng.randrange(len(ws))
            ws[pos:pos] = [f"<b>{w.upper()}</b>," if rng.random() < 0.3 else w for w in source[at : at + n]]
        docs.append((d, rng.choice([" ", "\n"]).join(ws)))
    want = set()
    for d, t in docs:
        for i, p, *_ in items:
            a, b = leaks.words(t), leaks.words(p)
            grams = {tuple(b[k : k + 12]) for k in range(len(b) - 11)}
            if any(tuple(a[k : k + 12]) in grams for k in range(len(a) - 11)):
                want.add((d, i))
    df, it = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, passage string, question string, answer string")
    assert want and {tuple(r) for r in leaks.verbatim_leaks(df, it).collect()} == want


def test_paraphrases(spark):
    passage = "the red fox quietly walked over the old stone bridge near our village before the long winter began"
    other = "seven blue engines carried heavy sugar across northern plains while merchants counted copper coins at dusk"
    close = passage.replace("quietly", "slowly").replace("near", "beside").replace("long", "hard")
    df = spark.createDataFrame([(1, close), (2, other + " today"), (3, "nothing in common here at all")], "doc_id long, text string")
    it = spark.createDataFrame([(7, passage, "old stone bridge"), (8, other, "silver")], "item_id long, passage string, answer string")
    got = {(r.doc_id, r.item_id): (r.verbatim, r.answer_found) for r in leaks.paraphrases(df, it).collect()}
    assert got == {(1, 7): (False, True), (2, 8): (True, False)}


def test_reworded_parts_of_long_texts_against_brute_force(spark):
    rng = random.Random(6)
    vocabulary, filling = [f"word{i}" for i in range(900)], [f"fill{i}" for i in range(900)]
    items = [(i, " ".join(rng.choices(vocabulary, k=n)), None) for i, n in enumerate([17, 20, 39, 60, 61, 90])]
    docs, planted = [], set()
    for d in range(60):
        i, passage, _ = rng.choice(items)
        ws = passage.split()
        n = min(len(ws), rng.randint(17, 24))
        at = rng.choice([0, len(ws) - n, rng.randrange(len(ws) - n + 1)])
        part = [w if rng.random() < 0.8 else rng.choice(filling) for w in ws[at : at + n]]
        before = rng.choices(filling, k=rng.randint(0, 90))
        docs.append((d, " ".join(before + part + rng.choices(filling, k=rng.choice([0, 0, 50])))))
        planted.add((d, i))
    want = set()
    for d, t in docs:
        for i, p, _ in items:
            a, b = t.split(), p.split()
            for size in leaks.PARA_SIZES:
                parts = [a[k : k + size] for k in range(max(1, len(a) - size + 1))]
                if any(leaks.subsequence(x, b) >= leaks.PARA_LCS * min(len(x), len(b)) for x in parts):
                    want.add((d, i))
    df, it = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, passage string, answer string")
    got = {(r.doc_id, r.item_id) for r in leaks.paraphrases(df, it).collect()}
    assert len(want & planted) > 50 and got == want


def test_every_word_is_in_a_window():
    starts = np.array([0, 5, 40, 73, 73])
    text, first = leaks.windows(starts, 16, 4, partial=True)
    assert {w for f, t in zip(first, text, strict=True) for w in range(f, min(f + 16, starts[t + 1]))} == set(range(73))


def test_window_in_order_counts_beside_a_nearer_shuffled_one(spark):
    rng = random.Random(2)
    passage = [f"word{i}" for i in range(32)]
    shuffled = passage[::-1]
    kept = [w if i % 6 else f"other{i}" for i, w in enumerate(passage)]
    text = " ".join(shuffled + [f"gap{i}" for i in range(32)] + kept)
    more = [(2, " ".join(f"other{i}" for i in range(40))), (3, " ".join(f"gap{i}" for i in range(40)))]
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    it = spark.createDataFrame([(7, " ".join(passage), None), *[(i, t, None) for i, t in more]], "item_id long, passage string, answer string")
    assert 7 in {r.item_id for r in leaks.paraphrases(df, it).collect()}
    for _ in range(50):
        a, b = rng.choices("abcd", k=rng.randint(0, 9)), rng.choices("abcde", k=rng.randint(0, 9))
        want = max(len(c) for n in range(len(a) + 1) for c in combinations(a, n) if all(x in i for i in [iter(b)] for x in c))
        assert leaks.subsequence(a, b) == want


def test_latent_space_decides(spark, monkeypatch):
    docs = spark.createDataFrame([(i, " ".join(f"w{(i + k) % 60}" for k in range(40))) for i in range(20)], "doc_id long, text string")
    items = spark.createDataFrame([(1, " ".join(f"w{k}" for k in range(20)), None), (2, " ".join(f"v{k}" for k in range(20)), None)], "item_id long, passage string, answer string")
    assert leaks.verbatim_leaks(docs, items).count() > 5
    monkeypatch.setattr(leaks, "latent_space", lambda passages, size, idf: np.zeros((size, 4)))
    assert leaks.verbatim_leaks(docs, items).count() == 0


def test_cells_hold_every_passage_once():
    rng = np.random.default_rng(3)
    vectors = rng.standard_normal((300, 16)).astype(np.float32)
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    cells = leaks.Cells(vectors)
    assert sorted(np.concatenate(cells.members).tolist()) == list(range(300))
    every = {(r, m) for r, m in zip(*np.nonzero(vectors @ vectors.T >= 0.5), strict=True)}
    assert set(zip(*cells.near(vectors, 0.5, len(cells.members)), strict=True)) == every
    assert {(k, k) for k in range(300)} <= set(zip(*cells.near(vectors, 0.9, 2), strict=True))


def test_small_helpers():
    assert leaks.subsequence("a b c d".split(), "a x c d".split()) == 3
    text, first = leaks.windows(np.array([0, 3, 3, 12]), 4, 2)
    assert text.tolist() == [2, 2, 2] and first.tolist() == [3, 5, 7]


# --- mixing ----------------------------------------------------------------------------------


def test_permutation_is_one():
    for size in (1, 2, 3, 100, 257):
        assert sorted(mixing.permute(np.arange(size), size, 5).tolist()) == list(range(size))
    assert mixing.permute(np.arange(100), 100, 5).tolist() != mixing.permute(np.arange(100), 100, 6).tolist()


def test_long_texts_have_the_same_tokens():
    rng = random.Random(8)
    enc = mixing.encoder()
    parts = ["alpha", "a_b", "don't", "12", "...", "日本語", "\n\n", "  ", "é", "x.", "(z)", "\u3000"]
    text = "".join(rng.choice(parts) + rng.choice([" ", "  ", "\n", "", " "]) for _ in range(70_000))
    for t in (text, "x" * (mixing.CHUNK + 1), "y z" * mixing.CHUNK, text[: mixing.CHUNK + 1], ""):
        whole = enc.encode_ordinary(t)
        assert mixing.encode(enc, t) == whole and mixing.count_tokens(enc, t) == len(whole)
    assert len(list(mixing.pieces(text))) > 2


@pytest.mark.parametrize("size", [10**3, 10**12])
def test_one_way_to_draw(size):
    left = np.array([size, 2 * size, 5])
    rng = np.random.default_rng(1)
    got = mixing.draw(rng, left, size)
    assert got.sum() == size and (got <= left).all() and abs(got[0] / size - 1 / 3) < 0.05
    assert mixing.draw(rng, left, int(left.sum())).tolist() == left.tolist()


def test_quotas():
    q = mixing.quotas({"a": 100, "b": 10, "c": 0}, {"a": (0.5, 1), "b": (0.25, 3), "c": (0.25, 9)})
    assert q.sources == ["a", "b"] and q.take == [60, 30] and q.total == 90
    assert mixing.quotas({}, {"a": (1.0, 1)}).total == 0 and mixing.quotas({"a": 5}, {"a": (1.0, 2)}, 3).take == [3]


def test_mixture(spark):
    rng = random.Random(3)
    docs = [(i, " ".join(rng.choices(["alpha", "beta", "gamma", "delta"], k=rng.randint(5, 400))), rng.choice(["big"] * 8 + [" BIG", "small"])) for i in range(300)]
    docs += [(1000 + i, docs[i][1], docs[i][2]) for i in range(40)] + [(2000, None, "big"), (2001, "", "big"), (2002, "text", None), (2003, "text", "unknown")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    targets = spark.createDataFrame([("big", 0.7, 1), ("small", 0.3, 3), ("none", 0.0, 2)], "source string, target_share double, max_repeats int")
    mix = mixing.mix(df, targets, block_tokens=32).cache()
    rows = mix.collect()
    used = Counter()
    for r in rows:
        for k in range(r.start, r.start + r.n_tokens):
            used[r.doc_id, k] += 1
    source = {d: s.strip().lower() for d, t, s in docs if t and s}
    assert all(n <= {"big": 1, "small": 3}[source[d]] for (d, _), n in used.items())
    text = {d: t for d, t, _ in docs}
    assert len({text[d] for d, _ in used}) == len({d for d, _ in used})
    got = {r.source: r.actual_share for r in mixing.shares(mix, targets).collect()}
    assert abs(got["big"] - 0.7) < 0.01 and abs(got["small"] - 0.3) < 0.01 and got["none"] == 0.0
    filled = Counter()
    for r in rows:
        filled[r.shard, r.slot] += r.n_tokens
    assert max(filled.values()) == 32
    for shard in {s for s, _ in filled}:  # every slot of a shard is filled
        own = sorted(k for s, k in filled if s == shard)
        assert own == list(range(len(own)))
    whole = mixing.with_tokens(mix, df).where("size(tokens) <> n_tokens").count()
    assert whole == 0


# --- quality ---------------------------------------------------------------------------------

PROSE = "The history chart was the main cause of the trouble and nobody had asked for it. After a closer look, the template needs a second look on a quiet morning."
PROFILES = quality.Profiles(quality.FALLBACK)


@pytest.mark.parametrize(
    ("text", "outside"),
    [
        (PROSE, False), (PROSE.upper(), False), (PROSE.replace(". ", ".\n"), False), ("Thanks, it works now.", False), ("Q: " + PROSE + "\n\nA: " + PROSE, False), ("\n".join(PROSE[i : i + 40] for i in range(0, len(PROSE), 40)), False),
        ("小さなパン屋は学校向けに長く暖かさを保ちます。手作りの棚は予約なしで作られています。", False),
        ("\n".join(f"- item {i}" for i in range(20)), True), ("url | score | status\n---|---|---\nhttps://a.example | 5 | 200\nhttps://b.example | 6 | 404", True), ("2024-10-28T05:28:12+00:00 [fetch] \"GET /\" 503 18642\n" * 5, True),
        ("var a=function(x){return y[1]||!0};" * 9, True), ("kNykBJVrv7rFhR8mQzTzqyef18jffE5Mk7nJdEUEmpmQbPbFWjwfMM6QaQXQGUvO5pGLfh\n" * 4, True), ("|$$%%%%%$&|{{{{{;;^\n[[[[[&&&&&<<(]\\\\  !/////~@@@@@>>>>>", True), ("12 345 6789 1234 5678 90 1 23 456 7890 " * 5, True),
        ("brook wool, kiln studio, brook events, north books, meadow hotel, harbor cycles, brook gallery, yarrow hotel", True), ("Jobs · Dorawick · Guides · Guides · Calumond · Privacy", True), (PROSE + "\n\n" + "\n".join(f"* thing {i}" for i in range(60)), True), (PROSE * 3 + "\n\n- one\n- two\n- three", False),
    ],
)
def test_profiles(text, outside):
    assert (quality.statistics(PROFILES, text)[-1] > quality.LIMIT) is outside


@pytest.mark.parametrize(
    "text",
    [
        "Rapporten försenades igen, medan kunderna väntade utanför. Ingen visste säkert, vem framöver ansvarade.",
        "Yeni sayfaların raporu yine geç geldi, ekip uzun süre bekledi. Kimse sonra kimin ilgileneceğini bilmiyor.",
        "Η έκθεση για τις νέες σελίδες άργησε ξανά, και η ομάδα περίμενε πολύ. Κανείς δεν ξέρει ποιος θα τη φροντίσει.",
        "> The history chart was the main cause of the trouble and nobody had\n> asked for it. After a closer look, the template needs a second look.",
        "INFO for readers: the shop opens at 10 on 12 May and closes at 18.30, so nobody has to wait until the evening to be served.",
    ],
)
def test_prose_in_other_languages_and_shapes(text):
    assert quality.statistics(PROFILES, text)[-1] < quality.LIMIT


def test_nearest_profile_decides(monkeypatch):
    junk = "\n".join(f"- item {i}" for i in range(20))
    assert quality.statistics(PROFILES, junk)[-1] == 1.0 and quality.statistics(PROFILES, PROSE)[-1] == 0.0
    monkeypatch.setattr(quality, "divergences", lambda p, many: np.zeros((len(p), len(many))))
    assert quality.statistics(PROFILES, junk)[-1] == quality.statistics(PROFILES, PROSE)[-1]


def test_company_does_not_change_a_text():
    texts = [PROSE, None, "", "- a\n- b\n- c", "小さなパン屋は学校向けに。", "x y\n" * 1000, "7", "\x85 \n\t", "!!!!"]
    many = quality.Described(texts)
    for i, t in enumerate(texts):
        alone = quality.Described([t])
        assert np.allclose(alone.vectors, many.vectors[many.text == i]) and alone.size.tolist() == many.size[many.text == i].tolist()


def test_statistics(spark):
    assert quality.statistics(PROFILES, None) == quality.statistics(PROFILES, "  \n") == (0,) + (None,) * 8
    df = spark.createDataFrame([(1, PROSE), (2, None), (3, "x y\n" * 100_000)], "doc_id long, text string")
    rows = {r.doc_id: r for r in quality.text_statistics(df).collect()}
    assert rows[1].n_words == len(PROSE.split()) and rows[1].punctuated_lines == 1.0 and rows[1].language == "en" and rows[2].n_words == 0
    same = np.array(quality.FALLBACK["list"])
    assert quality.divergences(same, same[None])[0, 0] == pytest.approx(0)
    assert quality.divergences([1.0, 0.0] + [0.0] * (quality.WIDTH - 2), [[0.0, 1.0] + [0.0] * (quality.WIDTH - 2)])[0, 0] == pytest.approx(1)
