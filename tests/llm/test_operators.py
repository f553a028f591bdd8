"""Operators against brute-force versions, round trips and held-out accuracy."""

from __future__ import annotations

import functools
import hashlib
import random
import re
import zlib
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weirflow.llm import bytehash, common, fingerprints, langid, mixing, neardup, packing, passages, quality, queries, sharding, suffixes, topk, urls

DATA = Path("/root/testdata/sf0.001")
needs_tables = pytest.mark.skipif(not DATA.exists(), reason="no tables here")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def documents(spark):
    if not DATA.exists():
        pytest.skip("no tables here")
    return spark.read.parquet(f"{DATA}/documents.parquet")


def texts_of(frame):
    return {r.doc_id: r.text or "" for r in frame.collect()}


# SQL


@needs_tables
@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "conversations"):
        c.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    ours, theirs = queries.queries()[name](spark, str(DATA)).toPandas(), c.sql(queries.ORACLE_SQL[name]).df()
    rows = lambda f: sorted(repr([None if v is None or pd.isna(v) else float(v) if isinstance(v, (int, float)) else v for v in r]) for r in f[sorted(f.columns)].astype(object).itertuples(index=False))
    assert sorted(ours.columns) == sorted(theirs.columns) and rows(ours) == rows(theirs)


# Mixing


def water(sizes, share=1.5, most=2.0):
    """Targets by handing out the excess again and again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3.0, 1.0, 2.0)[i % 3] for i, s in enumerate(names)}
    target, open_ = dict.fromkeys(names, 0.0), set(names)
    left = share * sum(sizes.values())
    while open_ and left > 1e-9:
        level, given = left / sum(weight[s] for s in open_), 0.0
        for s in list(open_):
            take = min(level * weight[s], most * sizes[s] - target[s])
            target[s] += take
            given += take
            if most * sizes[s] - target[s] <= 1e-9:
                open_.discard(s)
        left -= given
    return target


def test_targets(spark):
    rng = random.Random(5)
    for _ in range(4):
        sizes = {s: rng.randint(0, 10 ** rng.randint(0, 5)) for s in [None, *"abcdefgh"]}
        got = {r.source: r.target for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
        want = water(sizes)
        assert all(abs(got[s] - want[s]) <= 1e-6 * max(1, want[s]) for s in sizes)


def test_mixture_comes_near_its_targets(spark, documents):
    many = spark.range(6000).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), (F.col("id") % 4).cast("string")).alias("source"), F.repeat(F.lit("w "), (F.col("id") % 30 + 1).cast("int")).alias("text"))
    rows = mixing.plan_mixture(many).collect()
    taken = Counter()
    for r in rows:
        taken[r.source] += r.size * r.copies
        assert r.copies <= 2
    for s, t in {r.source: r.target for r in rows}.items():
        assert abs(taken[s] - t) < 0.05 * t
    assert sorted(map(str, rows)) == sorted(map(str, mixing.plan_mixture(many.repartition(7)).collect()))


# Fingerprints


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def digests_of(t):
    return set(fingerprints.digests(pa.array([t]))[0].tolist())


@needs_tables
@pytest.mark.parametrize(("size", "most"), [(32 << 20, 99), (20_000, 99), (3_000, 5)])
def test_fingerprints(spark, documents, monkeypatch, size, most):
    monkeypatch.setattr(fingerprints, "PARTITION_BYTES", size)
    monkeypatch.setattr(fingerprints, "MOST_PARTS", most)
    got = {r.doc_id: r for r in fingerprints.compare(documents).collect()}
    text = texts_of(documents)
    order = sorted(text, reverse=True)
    after = {a: b for a, b in zip(order, [*order[1:], order[0]], strict=True)}
    for i in order:
        new = fingerprints.edited_text(text[i], text[after[i]])
        n = len(text[i])
        assert new == text[i][: n - n // 3] + text[after[i]][: n // 3]
        r, own, edited = got[i], digests_of(text[i]), digests_of(new)
        assert (r.n_chars, r.edited_sha256) == (n, hashlib.sha256(new.encode()).hexdigest())
        assert r.near_edited == pytest.approx(jaccard(own, edited)) and r.near_next == pytest.approx(jaccard(own, digests_of(text[after[i]])))
        turned = lambda side: {x & (1 << 64) - 1 for x in side}
        assert turned(r.gone) == own - edited and turned(r.come) == edited - own
    same = Counter((text[i], got[i].fingerprint) for i in order)
    assert len({t for t, _ in same}) == len(same)
    # Fingerprints alone tell as much.
    for i in order[:60]:
        near, gone, come = fingerprints.differences(got[i].fingerprint, got[i].edited_fingerprint)
        assert near == pytest.approx(got[i].near_edited) and len(gone) == len(got[i].gone) and len(come) == len(got[i].come)
        assert fingerprints.differences(got[i].fingerprint, got[after[i]].fingerprint)[0] == pytest.approx(got[i].near_next)


def test_fingerprints_of_repeated_rows(spark, monkeypatch, tmp_path):
    """Rows that share a doc_id, equal ones too, are spread over partitions, and each has a next."""
    monkeypatch.setattr(fingerprints, "PARTITION_BYTES", 2000)
    rows = [(7, "one two. three four. five")] * 300 + [(7, f"text {i}. more words here. and more") for i in range(40)] + [(3, "small. one."), (9, "big. one."), (None, "none. at all")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    docs.write.parquet(str(tmp_path / "t"))
    docs = spark.read.parquet(str(tmp_path / "t"))
    ordered, parts = fingerprints.with_next(docs)
    assert parts.value.parts.max() > 1 and ordered.where("not _last").groupBy("_part").count().agg(F.max("count")).first()[0] < 150
    got = fingerprints.compare(docs).collect()
    assert len(got) == len(rows) and sum(r.near_next == 1.0 for r in got) == 299
    # The order the plain way: doc_id descending, hash ascending, nulls last.
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("h")).orderBy(F.col("doc_id").desc_nulls_last(), "h").collect()
    texts = [r.text for r in keyed]
    want = Counter((r.doc_id, hashlib.sha256(fingerprints.edited_text(t, f).encode()).hexdigest()) for r, t, f in zip(keyed, texts, [*texts[1:], texts[0]], strict=True))
    assert Counter((r.doc_id, r.edited_sha256) for r in got) == want


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.sets(st.integers(0, 90)), st.sets(st.integers(0, 90))), min_size=1, max_size=6), st.integers(0, 1 << 30), st.integers(0, 3))
def test_peeling(pairs, seed, retries):
    spread = lambda s: bytehash.mixed(np.array(sorted(s), np.uint64) + np.uint64(seed))
    side = lambda k: fingerprints.Version(np.concatenate([np.zeros(0, np.uint64), *[spread(p[k]) for p in pairs]]), np.array([len(p[k]) for p in pairs], np.int64))
    kept = fingerprints.RETRIES
    fingerprints.RETRIES = retries
    try:
        near, gone, come = fingerprints.compare_versions(side(0), side(1))
    finally:
        fingerprints.RETRIES = kept
    assert near.tolist() == pytest.approx([jaccard(a, b) for a, b in pairs])
    assert [set(x.tolist()) for x in gone] == [set(spread(a - b).tolist()) for a, b in pairs] and [set(x.tolist()) for x in come] == [set(spread(b - a).tolist()) for a, b in pairs]
    for t in side(0).texts():
        assert fingerprints.differences(t, t)[0] == 1.0
    near, gone, _ = fingerprints.differences(side(0).texts()[0], side(1).texts()[0])
    assert near == pytest.approx(jaccard(*pairs[0])) and set(gone) == set(spread(pairs[0][0] - pairs[0][1]).tolist())


def test_damaged_fingerprints_are_told():
    text = fingerprints.Version(np.arange(1, 40, dtype=np.uint64) * np.uint64(977), np.array([39])).texts()[0]
    assert fingerprints.differences(text, text[:-80]) is None


# Near duplicates


def brute_components(text):
    sets = {}
    for i, t in text.items():
        w = WORD.findall(t.translate({c: c + 32 for c in range(65, 91)}))
        sets[i] = frozenset(tuple(w[j : j + 5]) for j in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    root = {i: i for i in sets}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    ids = sorted(sets)
    for x, i in enumerate(ids):
        for j in ids[:x]:
            common = len(sets[i] & sets[j])
            if common and 100 * common >= 80 * (len(sets[i]) + len(sets[j]) - common):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (len(sets[i]), find(i)) for i in ids}


def edited_copies(seed, n=160):
    """Groups of copies with a few words changed, about as many as decide between link and none, and unrelated texts."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(rng.randint(1, 6)))
    line = [word() for _ in range(9)]
    bases = [[word() for _ in range(rng.choice([3, 7, 12, 40, 150, 400]))] for _ in range(8)]
    out = []
    for i in range(n):
        w = list(rng.choice(bases)) if rng.random() < 0.8 else line + [word() for _ in range(rng.randint(0, 30))]
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 6])):
            w[rng.randrange(len(w))] = word().upper() if rng.random() < 0.3 else word()
        out.append((i, " ".join(w)))
    return out


@pytest.mark.parametrize(("frequent", "nodes", "seed", "classes", "tasks"), [(50, 256, 1, (256, 16_384), 99), (2, 3, 2, (2, 4), 99), (5, 10, 3, (1, 2), 2), (99, 2, 4, (3, 9), 3)])
def test_neardup(spark, monkeypatch, frequent, nodes, seed, classes, tasks):
    """Whatever the classes of tokens and the sizes of blocks; also where a task takes several buckets."""
    monkeypatch.setattr(neardup, "FREQUENT", frequent)
    monkeypatch.setattr(neardup, "BLOCK_NODES", nodes)
    monkeypatch.setattr(neardup, "CLASSES", classes)
    monkeypatch.setattr(neardup, "TASK_TOKENS", 2_000_000 if tasks > 9 else 900)
    monkeypatch.setattr(passages, "MOST_TASKS", tasks)
    rows = edited_copies(seed)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.components(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    assert got == brute_components(dict(rows))


@needs_tables
def test_neardup_of_documents(documents):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.components(documents).collect()}
    assert got == brute_components(texts_of(documents))


def test_prefixes_find_every_link():
    """Any two linked sets share a key, whatever the frequencies and classes of their tokens."""
    rng = np.random.default_rng(4)
    for _ in range(300):
        n = int(rng.integers(1, 400))
        universe = rng.integers(0, 1 << 63, 2 * n + 4, dtype=np.int64).astype(np.uint64)
        x = np.unique(universe[:n])
        away = int(rng.integers(0, max(1, n // 9) + 1))
        y = np.unique(np.concatenate([x[: len(x) - away], universe[n : n + away]]))
        common = len(np.intersect1d(x, y))
        if 100 * common < 80 * (len(x) + len(y) - common):
            continue
        sketch = [s[: int(neardup.sketch_size(np.int64(len(s))))] for s in (x, y)]
        tokens = np.union1d(*sketch)
        alone = rng.random() * 0.5
        times = {int(t): int(rng.choice([2, 9, 200, 300, 9_000, 20_000, 90_000])) for t in tokens}
        shared = set(np.intersect1d(*sketch).tolist())
        keys = []
        for s, full in zip(sketch, (x, y), strict=True):
            own = [t for t in s.tolist() if t in shared or rng.random() > alone]
            e = np.zeros(len(own), neardup.ENTRY)
            e["token"] = np.array(own, np.uint64).view(np.int64)
            e["times"] = [times[t] for t in own]
            keys.append(set(neardup.combinations(len(full), e).tolist()))
        assert keys[0] & keys[1]


def test_sets_that_share_a_number_are_told_apart(spark, monkeypatch):
    """With numbers of 3 bits nearly every number is shared; the components are the same."""
    node_of, sketched = neardup.node_of, neardup._sketched

    def few(batches):
        for b in sketched(batches):
            yield b.set_column(3, "node", pa.array([x if x is None else x & 7 for x in b.column(3).to_pylist()], pa.int64()))

    monkeypatch.setattr(neardup, "_sketched", few)
    monkeypatch.setattr(neardup, "node_of", lambda tokens: (node_of(tokens)[0] & 7, node_of(tokens)[1]))
    rows = edited_copies(5, 60)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got == brute_components(dict(rows))


def test_work_of_neardup_with_common_tokens(spark):
    """Shingles in many documents, each document made mostly of them, and no links: few pairs are compared."""
    rng = random.Random(6)
    common = [[f"c{j}w{i}" for i in range(9)] for j in range(400)]
    rows = [(i, " ".join(w for j in rng.sample(range(400), 12) for w in common[j])) for i in range(1500)]
    sketched, _ = neardup.sketches(spark.createDataFrame(rows, "doc_id long, text string"))
    e, keys = np.zeros(0, neardup.ENTRY), Counter()
    sets = [np.frombuffer(r.sketch, np.int64) for r in sketched.collect()]
    times = Counter(t for s in sets for t in s.tolist())
    for s in sets:
        own = [t for t in s.tolist() if times[t] > 1]
        e = np.zeros(len(own), neardup.ENTRY)
        e["token"], e["times"] = own, [times[t] * 400 for t in own]  # as in a corpus 400 times as large
        keys.update(neardup.combinations(12 * 9 - 4, e).tolist())
    # Single tokens would be in some 45 of 1500 documents each; three together hardly ever are.
    assert np.mean([c for c in keys.values()]) < 3


# Sharding


@needs_tables
def test_sharding(spark, documents, monkeypatch):
    monkeypatch.setattr(sharding, "CELL_ROWS", 17)
    rows = sharding.interleave(documents, 8).collect()
    sizes = Counter(r.shard for r in rows)
    assert max(sizes.values()) - min(sizes.values()) <= 1 and set(sizes) == set(range(8))
    total = Counter(r.source for r in rows)
    for shard in range(8):
        own = [r for r in rows if r.shard == shard]
        assert sorted(r.slot for r in own) == list(range(len(own)))
        for s, n in total.items():
            assert abs(sum(r.source == s for r in own) - n / 8) < 2.01
    # The order itself, taken the plain way.
    draw = lambda r: int(hashlib.md5(f"23:{r.doc_id}".encode()).hexdigest()[:13], 16)
    fraction = {}
    for s, n in total.items():
        for k, r in enumerate(sorted((r for r in rows if r.source == s), key=lambda r: (draw(r), r.doc_id))):
            fraction[r.doc_id] = (k + 0.5) / n
    want = sorted(rows, key=lambda r: (fraction[r.doc_id], r.source, r.doc_id))
    assert [r.doc_id for r in sorted(rows, key=lambda r: r.position)] == [r.doc_id for r in want]
    text = texts_of(documents)
    assert all((r.size, r.text_crc32) == (len(text[r.doc_id].encode()) + 1, zlib.crc32(text[r.doc_id].encode())) for r in rows)


# Packing


@needs_tables
def test_packing(documents):
    from tokenizers import Tokenizer

    tokenizers = pytest.importorskip("public_tokenizers")
    path = tokenizers.path("word_bpe_49k.json")
    encode = Tokenizer.from_file(path)
    pieces = packing.pack(documents, path).collect()
    ids = {i: np.array([*encode.encode(t, add_special_tokens=False).ids, 2], "<u4") for i, t in texts_of(documents).items()}
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_sequence.setdefault(p.sequence_id, []).append(p)
        assert p.ids_crc32 == zlib.crc32(ids[p.doc_id][p.start : p.start + p.length].tobytes()) and p.doc_tokens == len(ids[p.doc_id])
    for i, own in by_doc.items():
        own.sort(key=lambda p: p.start)
        assert [p.start for p in own] == [0, *np.cumsum([p.length for p in own])[:-1]] and sum(p.length for p in own) == len(ids[i])
    assert set(by_doc) == set(ids)
    for own in by_sequence.values():
        own.sort(key=lambda p: p.offset)
        assert [p.offset for p in own] == [0, *np.cumsum([p.length for p in own])[:-1]]
        n = sum(p.length for p in own)
        assert 3840 <= n <= 4096 or n & (n - 1) == 0
    # Few are cut that fit a window, and padding is little.
    assert sum(len(own) - -(-own[0].doc_tokens // 4096) for own in by_doc.values()) < 0.05 * len(by_doc)
    whole = sum(p.length for p in pieces)
    assert sum(4096 - n for n in (sum(p.length for p in own) for own in by_sequence.values()) if n & (n - 1)) < 0.02 * whole


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=60), st.integers(1, 5))
def test_squares(sizes, most):
    packer = packing.SquaresPacker(16, 100, most)
    for d, n in enumerate(sizes):
        packer.place((d, n), 0, np.arange(n, dtype=np.uint32))
        assert packer.open <= most and packer.counts.sum() == packer.open
    packer.finish()
    lengths = [sum(len(p[2]) for p in pieces) for _, pieces in packer.done]
    assert sum(lengths) == sum(sizes) and all(n >= 15 or n & (n - 1) == 0 for n in lengths)
    got = {}
    for _, pieces in packer.done:
        for (d, _), start, ids in pieces:
            got.setdefault(d, []).extend(range(start, start + len(ids)))
            assert ids.tolist() == list(range(start, start + len(ids)))
    assert all(sorted(got[d]) == list(range(n)) for d, n in enumerate(sizes))


words_of = functools.cache(packing.Words)


def test_best_level_minimises_squares():
    packer = packing.SquaresPacker(10, 0, 100)
    packer.counts[[2, 5, 7]] = [3, 1, 1]

    def squares(level, n):
        c = packer.counts.copy()
        if level:
            c[level] -= 1
        if level + n < 10:
            c[level + n] += 1
        return int((c[1:10] ** 2).sum())

    for n in range(1, 10):
        choices = [0, *[h for h in (2, 5, 7) if h + n <= 10]]
        assert squares(packer.best_level(n), n) == min(squares(h, n) for h in choices)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.sampled_from("aAbB'sStTré.,!?|<>é̱́ \n\t1٣ßΣİﬁǅ ªº"), max_size=40), max_size=8))
def test_words_encode_like_the_tokenizer(texts):
    tokenizers = pytest.importorskip("public_tokenizers")
    path = tokenizers.path("word_bpe_49k.json")
    w = words_of(path)
    texts = [*texts, "<|endoftext|>x <|ENDOFTEXT|>, it's."]
    got = [i for ids, _ in w.encode(pa.array(texts)) for i in ids.tolist()]
    assert got == [i for t in texts for i in w.tokenizer.encode(t, add_special_tokens=False).ids]


# Passages and suffix arrays


def brute_strip(rows, least):
    seen, out = set(), {}
    for i, t in sorted(rows):
        b = t.encode()
        gone = bytearray(len(b))
        for s in range(len(b) - least + 1):
            w = b[s : s + least]
            if w in seen:
                gone[s : s + least] = b"\1" * least
            seen.add(w)
        spans = sum(1 for j in range(len(b)) if gone[j] and (not j or not gone[j - 1]))
        out[i] = (len(b), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone, strict=True) if not g)).hexdigest())
    return out


@pytest.mark.parametrize(("block", "hot", "suffixes", "tasks"), [(2 << 20, 1000, 60_000, 99), (3000, 1000, 500, 99), (3000, 1, 60_000, 2), (3000, 2, 50, 3)])
def test_passages(spark, monkeypatch, block, hot, suffixes, tasks):
    """Also where anchors are dealt over tasks, suffixes taken in parts, and buckets one after the other."""
    for name, value in (("BLOCK_BYTES", block), ("HOT", hot), ("SUFFIXES", suffixes), ("MOST_TASKS", tasks), ("TASK_FRAGMENTS", 40 if tasks < 9 else 1_000_000)):
        monkeypatch.setattr(passages, name, value)
    rng = random.Random(8)
    text = lambda n: "".join(rng.choice("ab cé") for _ in range(n))
    shared = [text(n) for n in (60, 100, 150, 400)]
    rows = []
    for i in range(80):
        parts = [rng.choice(shared) if rng.random() < 0.5 else text(rng.randint(0, 200)) for _ in range(rng.randint(0, 6))]
        rows.append((i * 7 % 80, "ab" * 150 + text(5) if i % 20 == 0 else "".join(parts)))
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in passages.strip(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), 100, texts=False).collect()}
    assert got == brute_strip(rows, 100)


def test_passages_of_rows_that_share_a_doc_id(spark):
    """Earlier is what was read first; of equal rows one is left whole."""
    rng = random.Random(9)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    shared = text(150)
    texts = [shared + text(40), text(60) + shared, "", text(300)] + [text(10) + shared[:120]] * 3
    docs = spark.createDataFrame([(7, t) for t in texts], "doc_id long, text string").coalesce(1)
    got = [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in passages.strip(docs, 100, texts=False).collect()]
    want = brute_strip(list(enumerate(texts)), 100)
    assert sorted(got) == sorted(want.values())
    many = spark.createDataFrame([(7, text(400))], "doc_id long, text string").crossJoin(spark.range(30)).drop("id").repartition(3)
    assert sorted(r.n_removed for r in passages.strip(many, 100, texts=False).collect()) == [0] + [400] * 29


@needs_tables
def test_passages_of_documents(documents):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in passages.strip(documents, 100, texts=False).collect()}
    assert got == brute_strip(list(texts_of(documents).items()), 100)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab\x00"), max_size=14), max_size=6), st.integers(1, 4))
def test_maximal_repeats(strings, least):
    data = [s.encode() for s in strings]
    offsets = np.cumsum([0, *map(len, data)])
    found = {}
    for n, string, position in suffixes.maximal_repeats(np.frombuffer(b"".join(data), np.uint8), offsets, least):
        at = sorted(zip(string.tolist(), position.tolist(), strict=True))
        word = {data[s][p : p + n] for s, p in at}
        assert len(word) == 1
        found[word.pop()] = at
    every = {}
    for s, d in enumerate(data):
        for p in range(len(d)):
            for q in range(p + least, len(d) + 1):
                every.setdefault(d[p:q], []).append((s, p))
    want = {}
    for w, at in every.items():
        before = {data[s][p - 1] if p else (s, p) for s, p in at}
        behind = {data[s][p + len(w)] if p + len(w) < len(data[s]) else (s, p) for s, p in at}
        if len(at) > 1 and len(before) > 1 and len(behind) > 1:
            want[w] = sorted(at)
    assert found == want


# Languages


@needs_tables
def test_languages_of_held_out_documents(spark):
    rows = queries.op9_langid(spark, str(DATA)).join(spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(rows) > 20 and sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.95


def test_mixed_text_has_spans(spark):
    train = [(i, t, lang) for i, (t, lang) in enumerate([("the cat and the dog went there with this", "en"), ("der hund und die katze gingen nicht dahin", "de"), ("собака и кошка пошли туда", "ru")] * 5)]
    docs = spark.createDataFrame(train, "doc_id long, text string, lang string")
    model = langid.learn(docs, F.lit(True))
    mixed = spark.createDataFrame([(0, "the dog went there with the cat der hund und die katze gingen dahin собака и кошка")], "doc_id long, text string")
    spans = langid.identify(mixed, model, penalty=4.0).first().spans
    assert [s.lang for s in spans] == ["en", "de", "ru"] and sum(s.words for s in spans) == 17


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.integers(0, 5), max_size=12), min_size=1, max_size=5), st.integers(0, 10**6), st.floats(0.1, 6))
def test_labels_are_the_best_path(docs, seed, penalty):
    rng = np.random.default_rng(seed)
    words = ["ab", "cd", "é", "xyz", "q", "zz"]
    text = langid.Text(pa.array([" ".join(words[i] for i in d) for d in docs]))
    model = {"languages": list("xyz"), "scores": rng.normal(size=(1 << langid.BITS, 3)).astype(np.float32), "allowed": np.ones((len(langid.SCRIPTS), 3), bool)}
    whole, path = langid.word_scores(text, model), langid.label(text, langid.Scores(text, model), penalty)
    monkey = langid.Scores(text, model)
    monkey.step, monkey.whole = 2, None
    assert langid.label(text, monkey, penalty).tolist() == path.tolist()
    for d in range(len(docs)):
        own = whole[text.doc == d]
        if not len(own):
            continue
        best = own[0].copy()
        for s in own[1:]:
            best = np.maximum(best, best.max() - penalty) + s
        got = path[text.doc == d]
        value = sum(own[i, got[i]] for i in range(len(got))) - penalty * (np.diff(got) != 0).sum()
        assert value == pytest.approx(best.max())


# Quality


@needs_tables
def test_quality_of_held_out_documents(spark):
    d = str(DATA).replace("0.001", "0.01")
    rows = queries.op5_quality(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.quality for r in rows) / len(rows) > 0.95


def test_weights_are_those_of_a_plain_pairwise_fit():
    """At the weights the loss over the pairs has no slope, and a plain descent ends there; the threshold is the quantile."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, len(quality.FEATURES)))
    preferred = (x[:, 0] + 0.5 * x[:, 3] + rng.normal(size=400) > 0.4).astype(int)
    model = quality.fit(x, preferred, 0.3, pairs=3000)
    z = np.clip((x - x.mean(0)) / x.std(0), -6, 6)
    good, bad = np.flatnonzero(preferred == 1), np.flatnonzero(preferred == 0)
    draw = np.random.default_rng(5)
    d = z[draw.choice(good, 3000)] - z[draw.choice(bad, 3000)]
    w = np.zeros(d.shape[1])
    for _ in range(4000):
        w -= 0.5 * (d.T @ (1 / (1 + np.exp(-d @ w)) - 1) + 3 * w) / 3000
    assert np.allclose(model["weights"], w, atol=1e-3)
    assert model["threshold"] == pytest.approx(np.quantile(z @ w, len(bad) / 400), abs=0.01)
    s = quality.scores(x, model)
    assert ((s >= 0.3) == (z @ model["weights"] >= model["threshold"])).all() and abs((s >= 0.3).mean() - len(good) / 400) < 0.01


def test_samples_hold_at_any_share(spark):
    """A tiny share still learns, every language is learned, and repeated rows don't swell the sample."""
    rows = spark.range(40_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("der hund und die katze "), F.col("id").cast("string")).alias("text"), F.lit("de").alias("lang"))
    rare = spark.createDataFrame([(-1, "the cat and the dog went there", "en"), (-2, "собака и кошка пошли", "ru")], rows.schema)
    same = spark.range(20_000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("el perro y el gato").alias("text"), F.lit("es").alias("lang"))
    model = langid.learn(rows.unionByName(rare).unionByName(same), F.lit(True), sample=40)
    assert model["languages"] == ["de", "en", "es", "ru"]
    told = spark.createDataFrame([(1, "der hund und die katze"), (2, "the dog and the cat"), (3, "кошка и собака")], "doc_id long, text string")
    assert [r.lang_pred for r in langid.identify(told, model).orderBy("doc_id").collect()] == ["de", "en", "ru"]
    with pytest.raises(langid.TooManyLanguages):
        langid.learn(rows.withColumn("lang", F.col("doc_id").cast("string")), F.lit(True), sample=40)
    labels = rows.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality")).unionByName(same.select("doc_id", F.lit(1).alias("quality")))
    seen = []
    fit = quality.fit
    try:
        quality.fit = lambda x, y, at: (seen.append(len(x)), fit(x, y, at))[1]
        quality.learn(rows.unionByName(same), labels, F.lit(True), sample=200)
    finally:
        quality.fit = fit
    assert 50 < seen[0] < 300
    assert spark.range(1_000_000).where(common.hash_below(1e-4, F.col("id"))).count() in range(50, 160)


def test_a_language_whose_rows_repeat_is_learned(spark):
    """Many copies of one of its texts, under doc_ids of their own or not, don't crowd out a language's other texts."""
    rng = random.Random(11)
    words = {"de": "der die das und ist nicht mit ein auf von zu haus wald strasse kinder schule".split(), "en": "the and is not with one on from to house wood street children school go".split(), "fr": "le la les et est pas avec un sur de maison bois rue enfants ecole aller".split()}
    texts = [(f"{' '.join(rng.choice(words[lang]) for _ in range(12))}", lang) for lang in words for _ in range(129)]
    rows = spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate(texts)], "doc_id long, text string, lang string")
    copies = spark.range(40_000).select((F.col("id") + 1000).alias("doc_id"), F.lit(texts[0][0]).alias("text"), F.lit("de").alias("lang"))
    same = copies.withColumn("doc_id", F.lit(0).cast("long"))
    plain = langid.learn(rows, F.lit(True), sample=400)
    for more in (copies, same):
        model = langid.learn(rows.unionByName(more), F.lit(True), sample=400)
        assert model["languages"] == ["de", "en", "fr"] and np.allclose(model["scores"], plain["scores"])
        told = langid.identify(rows, model).collect()
        assert sum(r.lang_pred == r.lang for r in told) >= 0.98 * len(told)
        few = langid.learn(rows.unionByName(more), F.lit(True), sample=3)  # a part of one text each
        assert few["languages"] == ["de", "en", "fr"] and np.ptp(few["scores"], 1).max() > 0


def test_repeated_labels_and_texts_weigh_as_single_ones(spark):
    rng = random.Random(12)
    good = lambda: " ".join(rng.choice(["a plain sentence", "that says something", "of some length"]) for _ in range(9)) + "."
    bad = lambda: " ".join(rng.choice(["!!!", "###", "CLICK", "$$$ 123"]) for _ in range(9))
    docs = spark.createDataFrame([(i, good() if i % 2 else bad()) for i in range(400)], "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    many = labels.crossJoin(spark.range(300)).drop("id")
    copied = docs.crossJoin(spark.range(50)).drop("id")
    plain = quality.learn(docs, labels, F.lit(True), sample=500)
    assert np.abs(plain["weights"]).max() > 0
    for d, y in ((docs, many), (copied, labels), (copied, many)):
        again = quality.learn(d, y, F.lit(True), sample=500)
        assert np.allclose(again["weights"], plain["weights"]) and np.isclose(again["threshold"], plain["threshold"])
    small = quality.learn(copied, many, F.lit(True), sample=100)
    assert np.abs(small["weights"]).max() > 0


def test_mixture_of_one_doc_id_comes_near_its_target(spark):
    rng = random.Random(13)
    rows = [(1, " ".join(["w"] * rng.randint(1, 40)), "a") for _ in range(2000)] + [(i, "x " * 30, "b") for i in range(2, 900)]
    plan = mixing.plan_mixture(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    for r in plan.groupBy("source").agg(F.first("target").alias("target"), F.sum(F.col("size") * F.col("copies")).alias("taken")).collect():
        assert abs(r.taken - r.target) < 0.06 * r.target


def test_many_languages_make_fewer_buckets(spark, monkeypatch):
    monkeypatch.setattr(langid, "CELLS", 1 << 12)
    rows = spark.createDataFrame([(i, f"{'abcdefgh'[i % 8] * 3} word{i}", f"l{i % 8}") for i in range(64)], "doc_id long, text string, lang string")
    model = langid.learn(rows, F.lit(True))
    assert model["bits"] == 9 and model["scores"].shape == (512, 8)
    assert all(r.lang_pred == r.lang for r in langid.identify(rows, model).collect())


# URLs and search


def test_filter_has_no_false_negatives():
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 1 << 63, 5000).astype(np.uint64)
    table = urls.build_filter(keys)
    assert urls.maybe_listed(table, keys).all()
    assert urls.maybe_listed(table, rng.integers(0, 1 << 63, 20000).astype(np.uint64)).mean() < 0.02


def test_search(spark, monkeypatch):
    monkeypatch.setattr(topk, "QUERY_BYTES", 700)
    monkeypatch.setattr(topk, "BLOCK_BYTES", 3000)
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) if rng.random() < 0.4 else 0.0 for x in rng.normal(size=8)]) for i in range(300)]
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in topk.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(6), F.col("vec_id") % 20 == 0, 5, 64).collect()]
    q = {i: np.floor(np.array(v) * 64).astype(int) for i, v in rows}
    want = []
    for i in range(0, 300, 20):
        best = sorted(((-int(q[i] @ q[j]), j) for j in q if j != i))[:5]
        want += [(i, k + 1, j, -s) for k, (s, j) in enumerate(best)]
    assert sorted(got) == sorted(want)


def test_tokens_that_are_broadcast_are_bounded(spark, monkeypatch):
    """However few of the frequent tokens are known beforehand, the links are the same."""
    from weirflow.llm import neardup

    rng = random.Random(21)
    base = [" ".join(rng.choice("abcdefgh") + str(rng.randint(0, 9)) for _ in range(40)) for _ in range(30)]
    rows = [(i, " ".join(w if rng.random() > 0.02 else "x" for w in rng.choice(base).split())) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(neardup, "FREQUENT", 3)
    found = []
    for most in (400_000, 5, 0):
        monkeypatch.setattr(neardup, "MOST_KNOWN", most)
        found.append(sorted((r.doc_id, r.component_id) for r in neardup.components(docs).collect()))
    assert found[0] == found[1] == found[2] and len({c for _, c in found[0]}) < 400
