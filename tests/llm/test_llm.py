"""The corpus operators on small tables against brute force, with the awkward cases in them."""

import hashlib
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from shopmetrics.llm import bpe, embeddings, exact, html_text, language, minhash, mixing, pii, preference, repeats
from shopmetrics.llm.queries import ORACLES, QUERIES

SCHEMA = "doc_id long, text string, lang string, source string, key string, kept boolean"
RNG = random.Random(3)
WORDS = ["".join(RNG.choice("abcdefgäé") for _ in range(RNG.randint(2, 8))) for _ in range(400)]


def prose(n):
    return " ".join(RNG.choice(WORDS) for _ in range(n))


BASE = prose(300)
EDITED = BASE.replace(BASE.split()[100], "changed", 1)
FAR = " ".join(w if k % 6 else "other%d" % k for k, w in enumerate(BASE.split()))
ROWS = [
    (1, BASE, "xx", "a", "k", True), (2, BASE, "xx", None, "k", True), (3, EDITED, "xx", "b", None, None),
    (4, None, None, "a", None, None), (5, "", "xx", "a", None, None), (6, "one TWO", "xx", "c", None, None),
    (7, "one two", "yy", "c", None, None), (8, FAR, "xx", "b", None, None), (9, prose(9000), "xx", "b", None, None),
    (10, "12345 67", "yy", "c", None, None), (11, "x" * 700 + "\n" + "x" * 300, "yy", "d", None, None),
    (12, "mail a.b@c.de or +49 30 1234567 or 10.0.0.1 or 4111 1111 1111 1111", "yy", "d", None, None),
    (12, "mail a.b@c.de or +49 30 1234567 or 10.0.0.1 or 4111 1111 1111 1111", "yy", "d", None, None),
    (None, BASE, "xx", "a", None, None), (14, prose(250), "", "a", None, None), (15, "   \t\n ", "yy", "a", None, None),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def shingles(text):
    w = words(text)
    return {tuple(w[k : k + 4]) for k in range(max(1, len(w) - 3))} if w else set()


def test_empty_tables(spark, empty):
    assert exact.exact_groups(empty).count() == 0
    assert mixing.mix(empty).count() == 0
    assert minhash.near_groups(empty).count() == 0
    assert language.identify(empty).count() == 0
    assert bpe.encode_documents(empty).count() == 0
    assert repeats.digests(repeats.repeated_spans(empty)).count() == 0
    assert pii.digests(pii.find_spans(empty)).count() == 0
    none = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert embeddings.near_vectors(none).count() == 0


def test_exact_groups(docs):
    for bits, capacity in ((64, 4096), (2, 2)):
        got = {}
        for r in exact.exact_groups(docs, capacity, bits).collect():
            got.setdefault(r.doc_id, []).append(r)
        assert sum(map(len, got.values())) == len(ROWS)
        assert (got[1][0].keep_id, got[1][0].group_size, got[1][0].kept) == (2, 3, False)
        assert got[2][0].kept and not got[None][0].kept
        assert got[4][0].keep_id == 5 and got[4][0].text_sha256 == hashlib.sha256(b"").hexdigest()
        assert sorted(r.kept for r in got[12]) == [False, True]
    kept = exact.exact_dedup(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [2, 3, 5, 6, 7, 8, 9, 10, 11, 12, 14, 15]


def test_near_groups(docs):
    got = {r.doc_id: r for r in minhash.near_groups(docs).collect()}
    sets = {r[0]: shingles(r[1]) for r in ROWS}
    for doc, found in got.items():
        assert found.n_shingles == len(sets[doc])
        if doc is None:
            assert found.component_id is None
            continue
        near = [d for d, s in sets.items() if d is not None and s and 100 * len(s & sets[doc]) >= 80 * len(s | sets[doc])]
        assert found.component_id == min([*near, doc])


def test_near_groups_follow_chains(spark):
    # Each is linked with the next one only, and the middle of a star with all of its copies.
    rng, chain = random.Random(5), []
    text = prose(200).split()
    for k in range(12):
        chain.append((k, " ".join(text)))
        for p in range(k * 16, k * 16 + 16):
            text[p] = f"new{k}x{p}"
    star = prose(200).split()
    for k in range(20, 50):
        copy = list(star)
        for p in rng.sample(range(200), 4):
            copy[p] = f"edit{k}x{p}"
        chain.append((k, " ".join(copy)))
    chain.append((60, " ".join(star)))
    sets = {k: shingles(t) for k, t in chain}
    root = {k: k for k in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
    got = {r.doc_id: r.component_id for r in minhash.near_groups(spark.createDataFrame(chain, "doc_id long, text string")).collect()}
    assert got == root


def test_sketch_fills_for_one_shingle():
    for n in (1, 2, 50, 3000):
        full = minhash.sketch(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        assert (full != ~np.uint64(0)).all()


def test_mix(docs):
    got = mixing.mix(docs).collect()
    again = {(r.doc_id, r.source, r.size): r.taken for r in mixing.mix(docs.repartition(5)).collect()}
    assert {(r.doc_id, r.source, r.size): r.taken for r in got} == again
    sizes = {}
    for _, text, _, source, _, _ in ROWS:
        sizes[source] = sizes.get(source, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    weight = dict(zip([*sorted(s for s in sizes if s), None], [5, 2, 1] * 9, strict=False))
    target, left, free = {}, 1.5 * sum(sizes.values()), set(sizes)
    while free:
        share = left / sum(weight[s] for s in free)
        over = {s for s in free if share * weight[s] > 2 * sizes[s]}
        target |= {s: 2.0 * sizes[s] for s in over} if over else {s: share * weight[s] for s in free}
        left -= sum(2 * sizes[s] for s in over)
        free = free - over if over else set()
    for s, size in sizes.items():
        rows = [r for r in got if r.source == s]
        assert all(r.source_size == size and abs(r.target - target[s]) < 1e-6 * (1 + size) for r in rows)
        assert abs(sum(r.taken * r.same for r in rows) - target[s]) <= 2
        assert all(r.taken <= 2 * r.size for r in rows)
    assert mixing.mixed_documents(docs).columns == docs.columns


def test_encoding_is_that_of_the_whole_text(docs):
    encoder = bpe.encoder(bpe.VOCABULARY)
    rng = random.Random(1)
    for text in ["", "a", " " * 50, "x" * 90, *("".join(rng.choice("ab '\n\tsé1.re日") for _ in range(rng.randint(1, 300))) for _ in range(1500))]:
        ids = bpe.encode(text, encoder.encode_ordinary, leaf=7)
        assert ids == encoder.encode_ordinary(text)
        assert bpe.decode(ids, encoder.decode_bytes, leaf=3) == text.encode()
    got = bpe.digests(bpe.decode_documents(bpe.encode_documents(docs))).collect()
    assert len(got) == len(ROWS)
    for r in got:
        if r.doc_id == 4:
            assert (r.n_tokens, r.ids_sha256) == (0, hashlib.sha256(b"").hexdigest())


def test_repeats(docs):
    texts = [(r[0], (r[1] or "").encode()) for r in ROWS]
    seen = {}
    for _, t in texts:
        for p in range(len(t) - 199):
            seen[t[p : p + 200]] = seen.get(t[p : p + 200], 0) + 1
    want = set()
    for doc, t in texts:
        gone = np.zeros(len(t), bool)
        for p in range(len(t) - 199):
            if seen[t[p : p + 200]] > 1:
                gone[p : p + 200] = True
        starts = int((gone & ~np.append(False, gone[:-1])).sum()) if len(t) else 0
        want.add((doc, len(t), int(gone.sum()), starts, hashlib.sha256(bytes(b for b, g in zip(t, gone, strict=True) if not g)).hexdigest()))
    for group in (1000, 1):
        assert {tuple(r) for r in repeats.digests(repeats.repeated_spans(docs, group)).collect()} == want


def test_repeats_of_equal_texts(spark):
    """Copies of a text go whole, also those with equal or no ids; one of them is the partner of other texts."""
    rng = np.random.default_rng(5)
    word = lambda n: "".join(rng.choice(list("abcdefgh é"), n))
    copy, short, own = word(500), word(150), word(400)
    rows = [(i % 40, copy) for i in range(60)] + [(None, copy), (100, short), (101, short), (102, ""), (103, None)]
    rows += [(104, own + copy[:300]), (105, own), (106, word(300)), (106, "x" * 450)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    size = {t: len((t or "").encode()) for _, t in rows}
    found = repeats.digests(repeats.repeated_spans(frame)).collect()
    gone = {t: (size[t], 1) for t in (copy, own, own + copy[:300], "x" * 450)}
    got = sorted((r.doc_id or -1, r.n_bytes, r.n_removed, r.n_spans) for r in found)
    assert got == sorted((d or -1, size[t], *gone.get(t, (0, 0))) for d, t in rows)


def test_language(spark, docs):
    found = {r.doc_id: r for r in language.identify(docs).collect()}
    assert found[4].lang_pred == found[5].lang_pred == found[10].lang_pred == "und" and found[4].score == 0
    assert found[9].lang_pred == "xx" and all(0 <= r.score <= 1 for r in found.values())
    known = language.known_language(docs)
    assert known.columns == docs.columns and {r.doc_id for r in known.collect()} == {1, 2, 3, 6, 7, 8, 9, 11, 12, 14, None}
    real = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = language.identify(real).join(real.select("doc_id", "lang"), "doc_id").where("held_out")
    assert held.where("lang = lang_pred").count() >= 0.97 * held.count()


def test_vectors(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(30, 16))
    rows, k = [], 0
    for i, v in enumerate(base):
        for _ in range(1 + i % 4):
            rows.append((k, [float(x) for x in v + rng.normal(size=16) * 0.12 * (i % 3)], i % 3))
            k += 1
    rows += [(k, rows[0][1], 0), (k + 1, None, 1), (k + 2, [0.0] * 16, 1), (k + 3, [float("nan")] * 16, 1), (k + 4, rows[0][1], None)]
    rows += [(k + 5, [1.0, None], 1), (k + 6, [], 1)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    good = {i: (np.array(np.float32(v), float), lab) for i, v, lab in rows if i <= k}
    links = {i: [j for j in good if j != i and good[i][1] == good[j][1] and good[i][0] @ good[j][0]
                 >= 0.98 * np.linalg.norm(good[i][0]) * np.linalg.norm(good[j][0])] for i in good}
    root = {i: i for i in good}
    for _ in good:
        for i in good:
            root[i] = min([root[i], *(root[j] for j in links[i])])
    for block in (2048, 5):
        for r in embeddings.near_vectors(frame, block).collect():
            assert (r.n_links, r.component_id) == (len(links.get(r.vec_id, [])), root.get(r.vec_id, r.vec_id))


def test_personal_data(docs):
    rng = random.Random(2)
    for _ in range(4000):
        text = "".join(rng.choice("a@.1 2-+()é.b19") for _ in range(rng.randint(0, 60)))
        want = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
        for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
            want += [("ip", *m.span())] * all(int(x) <= 255 for x in m[0].split("."))
        for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
            digits = re.sub("[^0-9]", "", m[0])
            want += [("card", *m.span())] * (14 <= len(digits) <= 19 and pii.luhn(digits))
        for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
            want += [("phone", *m.span())] * (10 <= len(re.sub("[^0-9]", "", m[0])) <= 15)
        assert sorted(pii.base_spans(text)) == sorted(want)
    got = {r.doc_id: r for r in pii.digests(pii.find_spans(docs)).collect()}
    assert [got[12][c] for c in ("n_email", "n_ip", "n_card", "n_phone")] == [1, 1, 1, 1]
    assert got[12].spans.startswith("email:5:13,phone:") and got[4].spans == "" == got[1].spans


def test_trees_learn_a_rule_of_two_features():
    x = np.random.default_rng(0).uniform(size=(500, 4))
    y = ((x[:, 1] > 0.4) & (x[:, 3] < 0.7)).astype(float)
    assert ((pii.score(pii.fit(x, y), x) > 0.5) == y).mean() > 0.97


def test_main_text(spark):
    page = (
        '<html><head><title>T</title><script>var a="</p>"</script></head><body><header>Site</header><nav><a href="/">Home</a></nav>'
        '<div id="main"><h1>Title &amp; more</h1><p>First, long paragraph, with   words\nand &eacute;.<p>Second <b>one</b>, short.'
        '<div class="ad">Buy</div><div class="comments"><p>Nice, nice, nice article, I liked it, a lot.</p></div></div>'
        '<div class="sidebar"><p>Other, things, here</p></div><footer>(c)</footer></body></html>'
    )
    assert html_text.main_text(page) == "Title & more\n\nFirst, long paragraph, with words and é.\n\nSecond one, short."
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<nav>x</nav>") == ""
    assert html_text.main_text("a < b") == "a < b"
    rows = [(1, "u", page), (1, None, None)]
    got = html_text.with_lengths(html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string"))).collect()
    assert sorted(r.n_chars for r in got)[0] == 0 and len(got) == 2


def test_preferences(spark):
    turns = [(1, True, 0, "user", "hi"), (1, True, 1, "assistant", "good"), (1, False, 0, "user", "hi"), (1, False, 1, "assistant", "bad"),
             (1, False, 2, "user", None), (2, True, 0, None, "x"), (None, True, 0, "user", "y")]
    got = {r.pair_id: r for r in preference.format_preferences(spark.createDataFrame(turns, "pair_id long, chosen boolean, turn long, role string, text string")).collect()}
    assert got[1].prompt == "<|user|>\nhi\n" and got[1].chosen == "<|assistant|>\ngood\n"
    assert [got[1].chosen[s.start : s.end] for s in got[1].chosen_mask] == ["good"]
    assert got[1].rejected == "<|assistant|>\nbad\n<|user|>\n\n" and len(got[1].rejected_mask) == 1
    assert got[2].n_prompt_turns == 0 and got[2].rejected == "" and set(got) == {1, 2}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracles(spark, name):
    star = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for table in ("documents", "conversations", "pages"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{star}/{table}.parquet'")
    rel = con.execute(ORACLES[name])
    columns = [c[0] for c in rel.description]
    assert sorted(map(tuple, QUERIES[name](spark, star).select(*columns).collect())) == sorted(rel.fetchall())


def test_pipeline(spark):
    star = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{star}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, star)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
    kept = {r.doc_id for r in docs.collect()}
    last = {}
    for doc, text in sorted(texts.items()):
        last[text] = doc
    sets = {doc: shingles_of(text, corpus_pipeline.NEAR_WORDS) for text, doc in last.items() if any(c.isalpha() for c in text)}
    component = components_of(sets)
    assert kept == {d for d in sets if component[d] == d}
    ids = corpus_pipeline.run(spark, star)
    assert ids.columns == ["doc_id", "ids"] and set(r.doc_id for r in ids.select("doc_id").collect()) <= kept


def shingles_of(text, width):
    w = words(text)
    return {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()


def components_of(sets):
    """Smallest member of each one's component, by union-find over all similar pairs."""
    root = {k: k for k in sets}

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                low, high = sorted((top(a), top(b)))
                root[high] = low
    return {k: top(k) for k in sets}


def test_pipeline_stage_takes_five_words(spark):
    # Five separate words of 200 replaced: 0.816 on shingles of four words, 0.774 on those of five.
    text = [f"w{k}" for k in range(200)]
    other = list(text)
    for p in (20, 60, 100, 140, 180):
        other[p] = f"new{p}"
    near = list(text)
    near[100] = "new"
    rows = [(1, " ".join(text)), (2, " ".join(other)), (3, " ".join(near))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()} == {1, 2}
    assert {r.doc_id for r in minhash.near_groups(docs).where("kept").collect()} == {1}


def test_pipeline_keeps_one_of_each_whole_component(spark):
    star = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{star}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:2]:
        docs = stage(spark, docs, star)
    sets = {r.doc_id: shingles_of(r.text, 5) for r in docs.collect()}
    component = components_of(sets)
    kept = {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, star).collect()}
    assert kept == {d for d in sets if component[d] == d}


def proposed(text):
    return {(kind, text[a:b]) for kind, a, b in pii.candidates(text)}


def test_candidates_are_parts_of_runs_too():
    assert ("card", "4111 1111 1111 1111") in proposed("card 4111 1111 1111 1111 12/27")
    assert {("phone", "212-555-0123"), ("phone", "212-555-0199")} <= proposed("212-555-0123 212-555-0199")
    three = ["(212) 555-0123", "(212) 555-0199", "(646) 555-0142"]
    assert {("phone", x) for x in three} <= proposed("call " + " ".join(three))
    assert ("phone", "+1 (826) 555-4081") in proposed("+1 (826) 555-4081 190.137.223.204")
    assert ("ip", "10[.]0[.]0[.]7") in proposed("host 10[.]0[.]0[.]7")
    # Linear: a bounded number of proposals for each group of digits.
    for n in (200, 2000):
        assert len(pii.candidates("12 " * n)) <= 12 * n


def with_base_spans(k):
    """A text with a base span of each kind."""
    number = f"4000 0000 {k:04d} 000"
    card = next(number + d for d in "0123456789" if pii.luhn((number + d).replace(" ", "")))
    return f"text {k} of name{k}@host{k}.example.org and {k % 200}.7.{k % 99}.1 then {card}; also +49 30 55{k:05d}, end"


def added(found):
    return {r.doc_id: {(s.kind, s.start, s.end) for s in r.spans} - {(s.kind, s.start, s.end) for s in r.base} for r in found.collect()}


def test_personal_data_beyond_the_base_rules(spark):
    given = {
        1000: ("phone 49 30 5551234 or", ["49 30 5551234"]), 1001: ("write to max [at] example [dot] de soon", ["max [at] example [dot] de"]),
        1002: ("mail max@müller.de", ["max@müller.de"]), 1003: ("card 4111 1111 1111 1111 12/27", ["4111 1111 1111 1111"]),
        1004: ("call 212-555-0123 212-555-0199 now", ["212-555-0123", "212-555-0199"]), 1005: ("host 10[.]0[.]0[.]7 is down", ["10[.]0[.]0[.]7"]),
        1006: ("card number 5018 0000 0009 is", ["5018 0000 0009"]), 1007: ("call (212) 555-0123 (212) 555-0199 (646) 555-0142", ["(212) 555-0123", "(212) 555-0199", "(646) 555-0142"]),
    }
    clean = ["order 49 30 5551234 or", "we sold 1234567 pieces", "on 2024-01-15 10 came", "x@y said", "card 4111 1111 1111 1112 12/27", "12345678901234567890", "1.2.3.4567 is out"]
    rows = [(k, with_base_spans(k)) for k in range(40)] + [(k, t) for k, (t, _) in given.items()] + [(2000 + k, t) for k, t in enumerate(clean)]
    got = added(pii.find_spans(spark.createDataFrame([*rows, (None, None)], "doc_id long, text string").repartition(3)))
    for k, (text, want) in given.items():
        assert sorted(text[a:b] for _, a, b in got[k]) == sorted(want), text
    assert not any(got[k] for k in got if k is None or k not in given)


def test_personal_data_learns_a_kind_from_all_documents(spark):
    # The only addresses stand in documents past the first 4,000 in the order of their ids' hashes.
    ids = [r.id for r in spark.range(9000).orderBy(F.xxhash64("id")).select("id").collect()]
    texts = {k: f"nothing to see in {k}" for k in ids} | {k: with_base_spans(k) for k in ids[4500:4520]}
    texts[ids[-1]] = "write to max [at] example [dot] de soon"
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    got = added(pii.find_spans(docs))
    assert got[ids[-1]] == {("email", 9, 34)} and not any(v for k, v in got.items() if k != ids[-1])
    model = pii.train(docs.select("text"))
    assert set(model) == set(pii.KINDS) and model == pii.train(docs.repartition(2).select("text"))


def test_vectors_without_an_id_count_as_links(spark):
    # 1 and 2 are similar only to the one without an id; 2 has another vector besides, with two links of its own.
    v = {a: [float(np.cos(np.radians(a))), float(np.sin(np.radians(a)))] for a in (0, 10, 20, 90, 95)}
    rows = [(1, v[0], 1), (None, v[10], 1), (2, v[20], 1), (2, v[90], 1), (3, v[95], 1), (4, v[95], 1), (None, v[0], 2)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    for block in (2048, 2):
        got = sorted((r.vec_id or 0, r.n_links, r.component_id or 0) for r in embeddings.near_vectors(frame, block).collect())
        assert got == [(0, 0, 0), (0, 2, 0), (1, 1, 1), (2, 1, 2), (2, 2, 2), (3, 2, 2), (4, 2, 2)]


def test_crowded_bucket_loses_no_link(spark):
    # Copies of one text with few, some and many changes, which others partly share: most meet in the same buckets.
    rng = random.Random(11)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for k in range(2000):
        copy = list(base)
        for p in rng.sample(range(120), rng.choice([0, 1, 2, 3, 4, 5, 6, 8])):
            copy[p] = f"edit{rng.randrange(4)}x{p}" if rng.random() < 0.7 else f"own{k}x{p}"
        rows.append((k, " ".join(copy), 1, "x"))
    sets = {k: shingles(t) for k, t, _, _ in rows}
    index = {g: i for i, g in enumerate(sorted({g for s in sets.values() for g in s}))}
    has = np.zeros((len(rows), len(index)), np.float32)
    for k, s in sets.items():
        has[k, [index[g] for g in s]] = 1
    both, sizes = (has @ has.T).astype(np.int64), has.sum(1).astype(np.int64)
    a, b = np.nonzero(100 * both >= 80 * (sizes[:, None] + sizes[None, :] - both))
    root = list(range(len(rows)))

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        low, high = sorted((top(x), top(y)))
        root[high] = low
    docs = spark.createDataFrame(rows, "doc_id long, text string, goes_id int, goes_key string").repartition(5)
    got = {r.doc_id: r.component_id for r in minhash.near_groups(docs).collect()}
    assert got == {k: top(k) for k in range(len(rows))} and len(set(got.values())) > 20


def test_columns_named_like_the_helpers_own(spark):
    rows = [(1, BASE, 7, "a"), (2, BASE, 8, "b"), (3, EDITED, 9, "c"), (4, "other words here", 10, "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, goes_id int, goes_key string")
    assert sorted(map(tuple, exact.exact_dedup(docs).collect())) == rows[1:]
    assert sorted(map(tuple, minhash.near_dedup(docs.where("doc_id > 1"), 5).collect())) == [rows[1], rows[3]]


def test_number_signs_are_no_letters(spark):
    rows = [(k, "the quick brown fox and the lazy dog" if k % 2 else "der schnelle braune Fuchs und der faule Hund", "xx" if k % 2 else "yy") for k in range(60)]
    rows += [(100, "½ ²", "xx"), (101, "Ⅷ ③", "xx"), (102, None, "xx"), (103, "ª", "xx"), (104, "12 _", "yy")]
    got = {r.doc_id: r.lang_pred for r in language.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert [got[k] for k in (100, 101, 102, 104)] == ["und"] * 4 and got[103] != "und"


def test_lookups_read_the_buckets_of_the_directory(docs):
    found, buckets = [], []
    for capacity, bits in ((4096, 64), (2, 64), (1, 4), (1, 1)):
        index, cells, depth = exact.build_index(docs, capacity, bits)
        listed = {r.cell: r.bucket for r in cells.collect()}
        rows = index.collect()
        assert all(listed[(r.key >> (64 - depth)) & ((1 << depth) - 1) if depth else 0] == r.bucket for r in rows)
        assert all((r.text is not None) == (r.chain_length > 1) for r in rows)
        buckets.append(len({r.bucket for r in rows}))
        found.append(sorted(map(str, exact.exact_groups(docs, capacity, bits).collect())))
    assert buckets[0] == 1 < buckets[1] and found[1:] == found[:1] * 3


def test_a_lookup_in_another_bucket_finds_nothing(docs, monkeypatch):
    build = exact.build_index

    def moved(*args):
        index, cells, depth = build(*args)
        return index.withColumn("bucket", F.col("bucket") + 1), cells, depth

    monkeypatch.setattr(exact, "build_index", moved)
    assert exact.exact_groups(docs).count() == 0


def test_replies_share_what_comes_before_the_last_answer(spark):
    rows = [
        (1, 0, "system", "s"), (1, 1, "user", "q"), (1, 2, "assistant", "a"), (1, 3, "user", "q2"), (1, 4, "assistant", "b"), (1, 5, "user", "bye"),
        (2, 0, "user", "x"), (2, None, "assistant", "first"), (2, 1, "assistant", "y"), (2, 1, "assistant", "y"), (3, 0, "user", "none"), (None, 0, "assistant", "z"),
        (4, None, None, None), (4, None, "assistant", "only"),
    ]
    turns = preference.replies(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {r.pair_id: r for r in preference.format_preferences(turns).collect()}
    assert set(got) == {1, 2, 4}
    assert got[1].n_prompt_turns == 4 and got[1].prompt.endswith("q2\n")
    assert got[1].chosen == "<|assistant|>\nb\n<|user|>\nbye\n" and got[1].rejected == "<|assistant|>\ny\n"
    assert [tuple(s) for s in got[1].rejected_mask] == [(14, 15)]
    assert (got[2].n_prompt_turns, got[2].chosen, got[2].rejected) == (2, "<|assistant|>\ny\n<|assistant|>\ny\n", "<|assistant|>\n\n")
    assert got[4].n_prompt_turns == 1 and got[4].rejected_mask == []
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string, pair_id long")
    assert preference.format_preferences(preference.replies(none)).count() == 0


def test_registered_pairs_have_common_beginnings(spark):
    found = QUERIES["op1_preferences"](spark, "/root/testdata/sf0.001")
    assert found.where("n_prompt_turns > 0 and prompt <> '' and chosen <> '' and rejected <> ''").count() > found.count() / 2


def test_pipeline_takes_nulls_and_empty_tables(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, goes_id int"
    rows = [(k, f"{prose(40)} text {k}", None if k % 3 else "xx", None if k % 4 else "s", None, k) for k in range(20)]
    rows += [(50, None, "xx", "s", None, None), (51, "", None, None, 0, None), (None, prose(30), None, "s", None, None), (52, rows[3][1], "xx", "s", None, None)]
    for table in (rows, []):
        docs = spark.createDataFrame(table, schema)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, "")
            assert docs.columns == [c.split()[0] for c in schema.split(", ")]
        ids = {r.doc_id for r in corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()}
        assert ids <= {r[0] for r in table} - {3, 50, 51} and (len(ids) > 5) == bool(table)


def test_pairs_are_made_at_their_first_shared_shingle(spark, monkeypatch):
    # Copies that keep most of each other's rare shingles, but few of the smallest one's: a pair shares dozens of them.
    rng = random.Random(5)
    base = [f"w{k}" for k in range(150)]
    rows = [(0, " ".join(base), 1, "x")]
    for k in range(1, 60):
        copy = [f"m{k % 6}x{p}" if p % 15 == 0 and p < 120 else w for p, w in enumerate(base)]
        copy[rng.randrange(150)] = f"own{k}"
        rows.append((k, " ".join(copy), 1, "x"))
    made, plain = [], minhash._ordered

    def counted(pairs, a, b):
        made.append((pairs.count(), plain(pairs, a, b).count()))
        return plain(pairs, a, b)

    docs = spark.createDataFrame(rows, "doc_id long, text string, n int, source string")
    texts = docs.select("doc_id", "text")
    members = texts.select(F.col("doc_id").alias("rep"), F.col("doc_id").alias("component"))
    reps = members.select("rep", F.lit(147).alias("n_shingles"))
    monkeypatch.setattr(minhash, "_ordered", counted)
    found = {tuple(r) for r in minhash._by_rare_shingles(members, texts, reps, 4).collect()}
    assert made[0][0] == made[0][1] > 200
    sets = {k: shingles(t) for k, t, _, _ in rows}
    similar = {(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    assert similar <= found and similar


def test_an_anchor_of_some_thousand_places_meets_in_one_scan(spark, monkeypatch):
    rng, staged, plain = random.Random(3), [], repeats.stage
    line = " ".join(f"common{k}" for k in range(12))
    rows = [(k, "".join(rng.choices("abcdef ", k=150)) + line + "".join(rng.choices("abcdef ", k=150)), 1, "x") for k in range(1500)]
    rows.append((1500, "head#" + rows[7][1][60:], 1, "x"))
    monkeypatch.setattr(repeats, "stage", lambda df, label: staged.append(label) or plain(df, label))
    docs = spark.createDataFrame(rows, "doc_id long, text string, n int, source string")
    got = {r.doc_id: r.n_removed for r in repeats.digests(repeats.repeated_spans(docs)).collect()}
    assert staged == [] and {k for k, n in got.items() if n} == {7, 1500}
    assert got[7] == got[1500] == len(rows[7][1]) - 60
    few = repeats.digests(repeats.repeated_spans(docs, group=1000))
    assert {r.doc_id: r.n_removed for r in few.collect()} == got and "repeat-contexts" in staged


def test_a_group_of_copies_makes_few_pairs(spark, monkeypatch):
    # Copies whose smallest differs too much from all others: what links them has to be found among the copies.
    rng, made, plain = random.Random(7), [], minhash.stage
    base = [f"w{k}" for k in range(150)]
    rows = []
    for k in range(400):
        copy = list(base)
        for p in rng.sample(range(150), 9 if k < 30 else rng.randint(0, 3)):
            copy[p] = f"own{k}x{p}"
        rows.append((k, " ".join(copy)))

    def counted(df, label):
        out = plain(df, label)
        made.extend([out.count()] if label == "near-links" else [])
        return out

    monkeypatch.setattr(minhash, "stage", counted)
    got = {r.doc_id: r.component_id for r in minhash.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == components_of({k: shingles(t) for k, t in rows})
    assert sum(made) < 3 * len(rows)
