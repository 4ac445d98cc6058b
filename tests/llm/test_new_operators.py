"""Whitening, collocations and repeated passages against plain versions, with nulls, ties, repeated and odd rows."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from stepspan.llm import collocations, repeats, suffixes, trie, whitening

DOCS = "doc_id bigint, text string, lang string, kept string, size string, hs string, block string"


def docs_of(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z", "w") for r in rows], DOCS)


# ---- whitening


@pytest.mark.parametrize(("dims", "n", "kind"), [(1, 9, "random"), (6, 60, "random"), (40, 200, "random"), (12, 7, "few"), (8, 50, "equal"), (5, 40, "flat"), (6, 80, "wide")])
def test_rank_one_updates(dims, n, kind):
    r = np.random.default_rng(dims)
    rows = np.round(r.normal(size=(n, dims)) * 9)
    if kind == "equal":
        rows[:] = np.eye(dims)[np.arange(n) % dims]
    if kind == "flat":
        rows[:, 1:3] = 0
    if kind == "wide":
        rows *= 10.0 ** np.arange(-3, 3)
    d, q = np.zeros(dims), np.eye(dims)
    for v in rows:
        d, q = whitening.rank_one(d, q, v)
    want = rows.T @ rows
    scale = np.abs(want).max()
    assert np.abs(q.T @ q - np.eye(dims)).max() < 1e-12 and (np.diff(d) >= 0).all()
    assert np.abs(q * d @ q.T - want).max() < 1e-12 * scale and np.abs(d - np.linalg.eigvalsh(want)).max() < 1e-12 * scale


def test_roots_of_the_secular_equation():
    r = np.random.default_rng(3)
    d = np.sort(np.concatenate([r.random(10), 1 + 1e-9 * np.arange(4), [50.0]]))
    z = r.normal(size=15) * 10.0 ** r.integers(-6, 1, 15)
    roots, away = whitening.secular_roots(d, z, 2.0)
    assert np.allclose(roots, np.linalg.eigvalsh(np.diag(d) + 2 * np.outer(z, z)), rtol=0, atol=1e-12)
    assert (roots >= d).all() and (roots[:-1] <= d[1:]).all() and np.allclose(away, d[None, :] - roots[:, None], atol=1e-12)


VECTORS = "vec_id bigint, embedding array<float>, n string, component int, v string"


def plain_whitening(rows, k=32):
    x = np.array([[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for v in rows], dtype=object)
    n, s = len(x), x.sum(0)
    c = np.array((n * x - s) / n, dtype=float)
    e, q = np.linalg.eigh(c.T @ c / n)
    e, q = e[::-1], q[:, ::-1]
    return n, [int(v) for v in ((n * x - s) ** 2).sum(1)], c @ q[:, :k], e


@pytest.mark.parametrize("parts", [1, 9])
def test_whitening(spark, parts):
    """In one and in several partitions, spectra are combined over two levels; dropped, repeated and null rows."""
    r = np.random.default_rng(1)
    good = (r.normal(size=(120, 10)) * np.arange(1, 11) / 4).astype(np.float32).tolist()
    good += good[:3] + [good[5]] * 30
    odd = [None, [None] + good[0][1:], [float("nan")] + good[0][1:], [float("inf")] + good[0][1:], good[0][:9], []]
    rows = [(None if i == 4 else i, v, "a", 7, "b") for i, v in enumerate(good + odd)]
    df = spark.createDataFrame(rows, VECTORS).repartition(parts)
    got = whitening.whiten(df).toPandas()
    n, deviations, projected, e = plain_whitening(good)
    assert len(got) == n * 10 and set(got.n) == {n} and got.identity_error.max() < 1e-9 and got.identity_error.nunique() == 1
    known = got.dropna(subset=["vec_id"])
    table = known.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    want = np.delete(projected / np.sqrt(e), 4, axis=0)
    assert np.abs(table * np.sign((table * want).sum(0)) - want).max() < 1e-8
    assert known.groupby("vec_id").deviation.first().tolist() == deviations[:4] + deviations[5:]
    assert np.allclose(got.groupby("component").explained.first(), e / e.sum(), rtol=1e-9)
    assert set(whitening.whiten(df, components=3).toPandas().component) == {1, 2, 3}


def test_whitening_of_odd_tables(spark):
    df = lambda vs: spark.createDataFrame([(i, v, "a", 7, "b") for i, v in enumerate(vs)], VECTORS)
    assert whitening.whiten(df([])).count() == 0 and whitening.whiten(df([None, [None]])).count() == 0
    one = whitening.whiten(df([[1.0, 2.0]])).toPandas()
    assert len(one) == 2 and one.whitened.isna().all() and set(one.deviation) == {0} and set(one.explained) == {0.0}
    flat = whitening.whiten(df([[1.0, 2.0], [2.0, 2.0], [4.0, 2.0]])).toPandas()
    assert flat[flat.component == 1].whitened.notna().all() and flat[flat.component == 2].whitened.isna().all()
    wide = whitening.whiten(df([[1e12, 1.0], [-1e12, 2.0], [0.0, 5.0]])).toPandas()  # sums and squares pass 64 bits
    assert wide.deviation.isna().sum() == 4 and len(wide) == 6


# ---- collocations


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from([0, 1, 2, 200, 255]), min_size=3, max_size=3), min_size=1, max_size=60))
def test_double_array(strings):
    rows = np.unique(np.array(strings, np.uint8), axis=0)
    t = trie.DoubleArray(rows)
    asked = np.array([(a, b, c) for a in (0, 1, 7, 200, 255) for b in (0, 2, 255) for c in (0, 1, 200)], np.int64)
    states, at = np.full(len(asked), t.root, np.int32), np.arange(len(asked))
    for j in range(3):
        go, states = t.step(states, asked[at, j])
        at = at[go]
    assert {tuple(asked[i]): int(s) for i, s in zip(at, t.accept[states])} == {tuple(map(int, x)): i for i, x in enumerate(rows) if tuple(map(int, x)) in set(map(tuple, asked.tolist()))}


def test_double_array_with_wide_nodes():
    r = np.random.default_rng(2)
    rows = np.unique(r.integers(0, 256, (40_000, 3)).astype(np.uint8) // [64, 1, 2], axis=0).astype(np.uint8)
    t = trie.DoubleArray(rows)
    states, at = np.full(len(rows), t.root, np.int32), np.arange(len(rows))
    for j in range(3):
        go, states = t.step(states, rows[at, j].astype(np.int64))
        at = at[go]
    assert (t.accept[states] == np.arange(len(rows))).all()


def plain_collocations(rows, least, most, top=2000):
    out = []
    by = collections.defaultdict(list)
    for _, text, lang in rows:
        by[lang or "und"].append(text or "")
    for lang, texts in by.items():
        f = collections.Counter()
        for text in texts:
            low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
                ws = re.findall(r"[^ \t]+", piece)
                f.update(tuple(ws[i : i + k]) for k in range(1, most + 1) for i in range(len(ws) - k + 1))
        n = sum(v for p, v in f.items() if len(p) == 1)
        c = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        found = []
        for p, a in c.items():
            if any(len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) and 100 * b >= 50 * a for q, b in c.items()):
                continue
            score, k = min((10**6 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, left, right, n, -s) for i, (s, a, p, left, right) in enumerate(sorted(found)[:top])]
    return sorted(out)


@pytest.mark.parametrize(("most", "block"), [(3, 500_000), (2, 500_000), (4, 7)])
def test_collocations(spark, most, block):
    """Three, two and four words; with tries of seven phrases, so that many passes are needed."""
    r = random.Random(most)
    words = ["a", "b", "New", "new", "york", "Ünï", "ünï", "x y", "of", "the"]
    rows = [(i, "".join(r.choice(words) + r.choice([" ", " ", " ", "  ", "\t", ". ", "\n", "\r\n", ";", " \x0b"]) for _ in range(r.randint(0, 60))), r.choice(["en", "de", None, "und"])) for i in range(60)]
    rows += [(None, None, None), (1, "", "en"), (2, " \t\n", "fr"), (3, "a b " * 3000, "en"), rows[5], rows[5], (7, "solo " * 3, "es")]
    got = collocations.collocations(docs_of(spark, rows), least=4, max_words=most, block=block)
    assert sorted(map(tuple, got.collect())) == plain_collocations(rows, 4, most)
    assert max(x.rank for x in collocations.collocations(docs_of(spark, rows), top=3, least=4, max_words=2).collect()) == 3


def test_partial_counts_are_flat_rows():
    """Words are numbered once; what is dealt out holds no array; no phrase goes from one text into the next."""
    texts = pa.record_batch([pa.array(["en", "en", "de"]), pa.array(["A b.", "b\tA b", "b"])], names=["lang", "text"])
    rows = [x for batch in collocations._encode(0)(iter([texts])) for x in batch.to_pylist()]
    counts = {(x["lang"], w["word"]): w["n"] for x in rows if x["words"] for w in x["words"]}
    assert counts == {("en", b"a"): 2, ("en", b"b"): 3, ("de", b"b"): 1}
    ids = {x["lang"]: np.frombuffer(x["ids"], np.uint64) for x in rows if x["ids"]}
    h, (a, b) = collocations._Codes(0).of([b"a", b"b", b"a"])[1], (ids["en"][0], ids["en"][1])
    assert h.tolist() == [a, b, a] and [x for x in ids["en"].tolist() if x][2:] == [b, a, b] and ids["en"][2] == 0

    class Every:
        value = np.full(1 << (collocations.BITS - 3), 255, np.uint8)

    stored = pa.record_batch([pa.array(["en"]), pa.array([ids["en"].tobytes()], pa.binary())], names=["lang", "ids"])
    (got,) = collocations._seen_often(2, Every)(iter([stored]))
    assert [str(t) for t in got.schema.types] == ["string", "int64", "int64", "int64"]
    as_int = {int(a.view(np.int64)): "a", int(b.view(np.int64)): "b"}
    assert {as_int[x["h0"]] + as_int[x["h1"]]: x["n"] for x in got.to_pylist()} == {"ab": 2, "ba": 1}


def test_partial_counts_meet_by_slices(monkeypatch):
    """Counts above a record's, several languages, equal hashes of different phrases; a row a slice, not a row a phrase."""
    r = np.random.default_rng(4)
    words = r.integers(2, 2**63, 40, dtype=np.uint64)
    want = collections.Counter()
    batches = []
    for lang in ("de", "en"):
        for _ in range(3):
            rows = np.unique(words[r.integers(0, 40, (500, 2))], axis=0)
            n = r.choice([1, 2, 255, 256, 1000], len(rows)).astype(np.int64)
            batches.append(collocations._counts([lang] * len(rows), rows, n))
            for row, x in zip(rows.view(np.int64).tolist(), n.tolist(), strict=True):
                want[lang, *row] += x
    for key in (collocations._key, lambda rows: (rows[:, 0] & np.uint64(7)) << np.uint64(61)):
        monkeypatch.setattr(collocations, "_key", key)
        dealt = list(collocations._dealt(lambda x: x, 2)(iter(batches)))
        assert all(len(set(b.column("slice").to_pylist())) == b.num_rows for b in dealt) and (key is collocations._key or sum(b.num_rows for b in dealt) <= 48)
        together = pa.Table.from_batches(dealt).sort_by("slice").to_batches(max_chunksize=7)
        got = [x for b in collocations._slices_summed(2, 300)(iter(together)) for x in b.to_pylist()]
        assert {(x["lang"], *x["hs"]): x["n"] for x in got} == {x: n for x, n in want.items() if n >= 300} and len(got) > 50


def test_collocations_of_nothing(spark):
    assert collocations.collocations(docs_of(spark, [])).count() == 0
    assert collocations.collocations(docs_of(spark, [(1, "one two", "en"), (2, None, None)])).count() == 0


# ---- repeated passages


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), st.binary(min_size=6, max_size=6).map(lambda b: bytes(x % 2 for x in b))), min_size=1, max_size=50))
def test_suffix_sort(rows):
    group, data = np.array([g for g, _ in rows]), np.array([list(b) for _, b in rows], np.uint8)
    order, common = suffixes.sorted_with_common(data, group)
    got = [(int(group[i]), bytes(data[i])) for i in order]
    assert got == sorted(got)
    for i, n in enumerate(common):
        if i == 0 or got[i][0] != got[i - 1][0]:
            assert n == -1
        else:
            assert n == next((j for j in range(6) if got[i][1][j] != got[i - 1][1][j]), 6)


def test_a_hash_collision_is_seen(monkeypatch):
    """With hashes that are all equal for one base, another base is taken."""
    real = suffixes.HashedStrings.__init__

    def weak(self, rows, seed=0):
        real(self, rows, seed)
        if seed == 0:
            self.prefix[:] = 0

    monkeypatch.setattr(suffixes.HashedStrings, "__init__", weak)
    data = np.array([[3, 1], [1, 2], [2, 2]], np.uint8)
    assert suffixes.sorted_with_common(data, np.zeros(3, int))[0].tolist() == [1, 2, 0]


def plain_repeats(rows):
    texts = [(d, (t or "").encode()) for d, t, _ in rows]
    least = {}
    for d, t in texts:
        if d is not None:
            for i in range(len(t) - 49):
                w = t[i : i + 50]
                least[w] = min(d, least.get(w, d))
    out = []
    for d, t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - 49):
            if d is not None and least[t[i : i + 50]] < d:
                gone[i : i + 50] = True
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out.append((d, len(t), int(gone.sum()), int((gone & ~np.concatenate(([False], gone[:-1]))).sum()) if len(t) else 0, hashlib.sha256(kept).hexdigest(), kept))
    return sorted(out, key=str)


@pytest.mark.parametrize(("block", "bucket"), [(2 << 20, 400_000), (3000, 40)])
def test_repeats(spark, monkeypatch, block, bucket):
    """In one block and bucket, and in many: copies, near copies, passages at starts and ends, runs of one letter, short and long texts."""
    monkeypatch.setattr(repeats, "BLOCK", block)
    monkeypatch.setattr(repeats, "PER_BUCKET", bucket)
    r = random.Random(13)
    prose = lambda n: " ".join("".join(r.choice("abcdeéü") for _ in range(r.randint(1, 8))) for _ in range(n))
    base, passage = prose(200), prose(14)
    texts = [base, base, base[:300] + "X" + base[301:], prose(30) + passage, passage + prose(30), prose(20) + passage + prose(20), passage[:50], passage[:49], passage, "a" * 400, "a" * 120, "b" + "a" * 60, ("ab" * 200), "", None, prose(4000), base[100:160], prose(3) + base[500:549], base + passage + base]
    rows = [(i, t, "en") for i, t in enumerate(texts)]
    rows += [(0, base, "en"), (3, texts[5], "en"), (None, base, "en"), (None, None, None), (500, texts[15][2000:9000], "en"), (-5, passage + "q" * 60, "de"), (501, texts[15], "en")]
    got = repeats.remove_repeats(docs_of(spark, rows).repartition(3), with_text=True).collect()
    assert sorted(((*x[:5], bytes(x[5])) for x in got), key=str) == plain_repeats(rows)
    assert repeats.remove_repeats(docs_of(spark, [])).count() == 0


def test_a_block_is_hashed_once(monkeypatch):
    """Surroundings of anchors are told apart by the parts' hashes; bytes are marked as by each string in turn."""
    r = random.Random(5)
    texts = [bytes(r.choice(b"abcdef ") for _ in range(400)) for _ in range(6)]
    texts = [t + texts[0][:200] + t[:90] for t in texts]
    calls, rolling = [], repeats._rolling
    monkeypatch.setattr(repeats, "_rolling", lambda *a: calls.append(a) or rolling(*a))
    block = repeats.Block(np.arange(6), np.array([len(t) for t in texts]), b"".join(texts), np.ones(6, bool))
    anchored = repeats.Anchored(block, 0)
    f = repeats.Fragments(block, anchored, {0: np.packbits(np.ones(len(anchored.first), bool)).tobytes()})
    assert len(calls) == 1
    assert len(f.places) == len({x.tobytes() for x in block.around(f.at)}) < len(f.at)
    assert all((block.around(f.places[f.number[[i]]]) == block.around(f.at[[i]])).all() for i in range(len(f.at)))
    masks = np.array([r.randrange(2**repeats.OFFSETS) * r.choice([0, 1]) for _ in f.at])
    want = np.zeros(len(block.data), bool)
    for at, mask in zip(f.at.tolist(), masks.tolist()):
        for o in range(repeats.OFFSETS):
            if mask >> o & 1:
                want[at - o : at - o + repeats.SIZE] = True
    assert (repeats.covered(len(block.data), f.at, masks) == want).all()
