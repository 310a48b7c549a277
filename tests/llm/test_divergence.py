"""Divergence audit against a plain computation over all terms and pairs."""

import random
import re
from collections import Counter, defaultdict

import pyarrow as pa
import pytest

from shopmetrics.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string, term string, p long, n string"


def brute(rows, min_docs, top=10):
    docs, counts, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")
        terms = [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in terms]
        docs[lang].update(set(terms))
        counts[lang, source].update(terms)
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= min_docs]
        whole = Counter({t: sum(counts[lang, s][t] for s in sources) for t in kept})

        def shares(c):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 2) // (n + 2 * len(kept)) for t in kept}

        q, p = shares(whole), {s: shares(counts[lang, s]) for s in sources}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pair = [(o, sum(f(p[s][t], p[o][t]) for t in kept)) for o in sources if o != s]
            term = [(t, f(p[s][t], q[t])) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, items, limit in (("pair", pair, None), ("term", term, top)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, i, v, k + 1) for k, (i, v) in enumerate(items[:limit])]
    return sorted(out)


def audited(spark, rows, min_docs):
    table = [(k, *r, "x", 1, "y") for k, r in enumerate(rows)]
    df = spark.createDataFrame(table, SCHEMA).repartition(3)
    return sorted(tuple(r) for r in divergence.audit(df, min_docs).collect())


@pytest.mark.parametrize("entries", [1 << 18, 7])
def test_equals_plain_sums(spark, monkeypatch, entries):
    monkeypatch.setattr(divergence, "TABLE_ENTRIES", entries)
    rng = random.Random(entries)
    words = ["".join(rng.choice("abÄé ß") for _ in range(rng.randint(1, 3))) for _ in range(40)]
    rows = []
    for _ in range(300):
        text = rng.choice([" ", ",", "\x00", "_"]).join(rng.choice(words).upper() for _ in range(rng.randint(0, 30)))
        rows.append((text, rng.choice(["en", "en", "en", "de", None]), rng.choice(["a", "a", "a", "b", "c", "d", "", None, "é"])))
    rows += rows[:40] + [(None, "en", "empty"), ("", "xx", None), ("1 2 3", "yy", "a"), ("one", "yy", "b"), ("solo", "zz", "a")]
    rows.append(("Long " * 300_000, "en", "long"))
    for min_docs in (10, 1):
        assert audited(spark, rows, min_docs) == brute(rows, min_docs)


def test_empty_table(spark):
    assert audited(spark, [], 10) == []


def test_nodes_are_shared_prefixes():
    element = pa.struct([("source", pa.string()), ("p", pa.int64()), ("p0", pa.int64())])
    row = lambda *e: [{"source": s, "p": p, "p0": 10} for s, p in e]
    paths = [row(("a", 20), ("b", 30)), row(("a", 20), ("b", 30), ("c", 50)), row(("a", 20), ("c", 50)), row(("b", 30))]
    got = {(a, b): v for a, b, v in divergence._subtree(pa.array(paths, pa.list_(element)), pa.array([3, 2, 1, 9]).to_numpy())}
    f = lambda a, b: (a - b) ** 2 // (a + b)
    extra = lambda p, q: f(p, q) - f(p, 10) - f(10, q) + f(10, 10)
    assert got == {("a", "b"): 5 * extra(20, 30), ("a", "c"): 3 * extra(20, 50), ("b", "c"): 2 * extra(30, 50)}


@pytest.mark.parametrize("block", [1 << 19, 1])
def test_blocks_of_pairs_add_up(monkeypatch, block):
    element = pa.struct([("source", pa.string()), ("p", pa.int64()), ("p0", pa.int64())])
    rng = random.Random(7)
    paths = sorted([(s, rng.randint(1, 9)) for s in "abcdef" if rng.random() < 0.6] or [("a", 1)] for _ in range(200))
    rows = [[{"source": s, "p": p, "p0": 3} for s, p in path] for path in paths]
    monkeypatch.setattr(divergence, "PAIR_BLOCK", block)
    want: Counter = Counter()
    f = lambda a, b: (a - b) ** 2 // (a + b)
    for path in paths:
        for j, (b, q) in enumerate(path):
            for a, p in path[:j]:
                want[a, b] += f(p, q) - f(p, 3) - f(3, q) + f(3, 3)
    got = {(a, b): v for a, b, v in divergence._subtree(pa.array(rows, pa.list_(element)), pa.array([1] * len(rows)).to_numpy())}
    assert got == dict(want)
