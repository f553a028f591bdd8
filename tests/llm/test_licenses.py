"""License scans against a brute-force version, and what they make of odd rows."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from weirflow.llm import licenses

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = {c: c + 32 for c in range(65, 91)}
SCHEMA = "doc_id long, text string"


def split(text):
    return WORD.findall((text or "").translate(LOW))


def brute(text, phrases=licenses.PHRASES, notices=licenses.NOTICES, k=4, drift=3, least=0.6):
    ws = split(text)
    places = sorted((i, label) for label, p in phrases for i in range(len(ws)) if ws[i : i + len(split(p))] == split(p))
    short = min(len(split(t)) for _, t in [*phrases, *notices])
    found, best = {label for _, label in places}, 1.0 if places else 0.0
    spans = [(i, i + len(split(p)), label, 1.0) for label, p in phrases for i in range(len(ws)) if ws[i : i + len(split(p))] == split(p)]
    for label, t in notices:
        ts = split(t)
        size = k if len(ts) >= k else short
        hits = [(p - q, p, q) for p in range(len(ws) - size + 1) for q in range(len(ts) - size + 1) if ws[p : p + size] == ts[q : q + size]]
        run = []
        for h in [*sorted(hits), None]:
            if run and (h is None or h[0] - run[-1][0] > drift):
                share = len({q for _, _, q in run}) / (len(ts) - size + 1)
                best = max(best, share)
                if share >= least:
                    found.add(label)
                    spans.append((min(p for _, p, _ in run), max(p for _, p, _ in run) + size, label, share))
                run = []
            run.append(h)
    at = [i for i, _ in places]
    return (len(ws), len(places), min(at, default=None), max(at, default=None), sorted({label for _, label in places}), sorted(found), sorted(spans), best)


def got(rows):
    return sorted((str(r.doc_id), r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, [tuple(s) for s in r.spans], r.score) for r in rows)


def same(spark, rows, **how):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    want = sorted((str(i), *brute(t, **how)) for i, t in rows)
    have = got(licenses.scan(docs, **how).collect())
    assert repr(have) == repr(want)


def texts(n, seed=5):
    """Scraps of notices with words lost, put in and repeated, in other words."""
    rng = random.Random(seed)
    scraps = [t.split() for _, t in [*licenses.PHRASES, *licenses.NOTICES]]
    for _ in range(n):
        out = []
        for _ in range(rng.randint(0, 4)):
            s = list(rng.choice(scraps))
            a = rng.randint(0, len(s) // 3)
            s = s[a : len(s) - rng.randint(0, len(s) // 3)]
            for _ in range(rng.randint(0, 3)):
                at = rng.randint(0, len(s))
                s[at : at + rng.randint(0, 1)] = [rng.choice(["the", "MIT", "license", "É", "of"])] * rng.randint(0, 2)
            out += [rng.choice(["The", "license", "x1", "Überall", "public,"]) for _ in range(rng.randint(0, 5))] + s
        yield " ".join(out).upper() if rng.random() < 0.2 else ("-" if rng.random() < 0.3 else " ").join(out)


def test_equals_brute_force(spark):
    same(spark, [*enumerate(texts(150)), (900, "MIT license mit LICENSE, MIT\nLicense general public license"), (901, "general public general public license")])


@pytest.mark.parametrize("k", [2, 3, 6])
def test_other_grams(spark, k):
    same(spark, list(enumerate(texts(40, seed=k))), k=k, drift=k - 2, least=0.4)


def test_odd_rows(spark):
    rows = [(1, None), (1, ""), (2, " .,-\n"), (3, "mit"), (4, "MIT License"), (4, "MIT License"), (4, "MIT License"), (4, "mit licence"), (None, "apache license"), (None, None), (5, "mit licensK e"), (6, "KK mit\x00license"), (7, "mit license " * 20_000)]
    same(spark, rows)


def test_long_notices_need_several_masks(spark):
    notice = " ".join(f"w{i}" for i in range(150))
    rows = [(1, notice), (2, " ".join(notice.split()[:100])), (3, " ".join(notice.split()[:80])), (4, " ".join([*notice.split()[:70], "extra", *notice.split()[70:]]))]
    same(spark, rows, notices=[("long", notice)])


def test_empty_table_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "mit license")], SCHEMA)
    assert licenses.scan(docs.limit(0)).collect() == []
    more = docs.withColumns({c: F.lit("x") for c in ("h", "n", "ws", "at", "key", "t", "q", "d", "size", "rows", "m0", "span", "a`b")})
    assert got(licenses.scan(more).collect()) == got(licenses.scan(docs).collect())


def test_plan_has_no_python_and_no_cross_join(spark):
    df = licenses.scan(spark.createDataFrame([(1, "mit license")], SCHEMA))
    plan = df._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|Cartesian|NestedLoop", plan)


def test_templates_without_words(spark):
    with pytest.raises(ValueError):
        licenses.scan(spark.createDataFrame([(1, "x")], SCHEMA), phrases=[("a", "--")])
