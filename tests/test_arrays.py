"""Huge JSON arrays: equal to the whole read, however they are cut."""

from __future__ import annotations

import json
import random

import pytest

from weirflow.schema import TXN
from weirflow.sources.arrays import NotAnArray, State, _elements, _summary, elements
from weirflow.sources.files import InputError, load_array, load_transactions


def made(n, seed=1):
    rng = random.Random(seed)
    text = lambda: "".join(rng.choice(['a', '"', "\\", "{", "}", "[", "]", ",", "é", "\n", " "]) for _ in range(rng.randint(0, 12)))
    return [{"seq": i, "merchant_name": text(), "status": text(), "amount": rng.random(), "deep": {"x": [text(), {"y": text()}]}} for i in range(n)]


def cut(path, split):
    """The elements as ``elements`` finds them, without Spark."""
    size = path.stat().st_size
    inside = depth = 0
    found = []
    for a in range(0, size, split):
        start, end, flips, plain, quoted = _summary(str(path), a, min(a + split, size))
        found += list(_elements(str(path), start, end, inside, depth))
        depth += quoted if inside else plain
        inside ^= flips
    return found, inside, depth


@pytest.mark.parametrize("split", [1, 2, 7, 100, 1 << 20])
@pytest.mark.parametrize("step", [1, 5, 1 << 20])
def test_any_cut_gives_the_same_elements(tmp_path, monkeypatch, split, step):
    monkeypatch.setattr("weirflow.sources.arrays.STEP", step)
    rows = [*made(12), "a , \" \\\\", ["x", [1]], 5, None, {}, "\\"]
    path = tmp_path / "a.json"
    for indent in (None, 2):
        path.write_text("  " + json.dumps(rows, indent=indent, ensure_ascii=False) + "\n")
        found, inside, depth = cut(path, split)
        assert [json.loads(x) for x in found] == rows and (inside, depth) == (0, 0)


def test_state_over_any_chunks():
    text = json.dumps(made(5, seed=3)).encode()
    whole = State()
    b, outside, depth = whole.scan(text)
    for size in (1, 2, 3, 11):
        part, got = State(), []
        for a in range(0, len(text), size):
            got += part.scan(text[a : a + size])[2].tolist()
        assert got == depth.tolist() and (part.inside, part.depth) == (0, 0)


def test_array_equals_the_whole_read(spark, tmp_path):
    path = str(tmp_path / "t.json")
    (tmp_path / "t.json").write_text(json.dumps(made(2000), ensure_ascii=False))
    pick = lambda df: sorted(map(tuple, df.select("seq", "merchant_name", "status", "amount").collect()))
    whole = load_transactions(spark, path)
    for split in (1000, 1 << 20):
        parts = load_array(spark, path, split=split)
        assert pick(parts) == pick(whole) and parts.columns == [f.name for f in TXN.fields]
    assert elements(spark, "file://" + path, 1000).rdd.getNumPartitions() > 100


@pytest.mark.parametrize("text", ['{"seq": 1}', "", "[", '[{"seq": 1}', '[{"seq": 1}]]', '["a]', '[{"seq": 1}] x'])
def test_what_is_no_array(spark, tmp_path, text):
    (tmp_path / "x.json").write_text(text)
    with pytest.raises((NotAnArray, InputError)):
        load_array(spark, str(tmp_path / "x.json"))


def test_bad_and_empty_elements(spark, tmp_path):
    path = tmp_path / "x.json"
    for bad in ('[{"seq": 1}, {"seq": }]', '[{"seq": 1},, {"seq": 2}]'):
        path.write_text(bad)
        with pytest.raises(InputError):
            load_array(spark, str(path))
    for empty in ("[]", " [ \n ] \n"):
        path.write_text(empty)
        assert load_array(spark, str(path)).count() == 0


def test_a_small_range_reads_little_behind_it(tmp_path, monkeypatch):
    """The end of a range's last element is looked for a little further on, not in the next 4 MB."""
    from weirflow.sources import arrays

    path, read, scan = tmp_path / "a.json", [], arrays.State.scan
    path.write_text("[" + ",".join(f'{{"n":{i}}}' for i in range(100_000)) + "]")
    monkeypatch.setattr(arrays.State, "scan", lambda self, raw: (read.append(len(raw)), scan(self, raw))[1])
    assert next(arrays._elements(str(path), 0, 1000, 0, 0)) == b'{"n":0}'
    assert len(list(arrays._elements(str(path), 0, 1000, 0, 0))) > 50
    assert sum(read) < 20_000
