"""Each operator against a plain version of its own, on the small tables and on awkward rows."""

import hashlib
import math
import re
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from senseloom.llm import decontam, lm_score, nn_descent, packing, pii, preference, quality, queries, simhash, token_count, token_files
from senseloom.llm._shared import Tables, connected_components

LONG = "wort " * 30_000 + "a.b@c.de " + "x" * 50_000
ROWS = [
    (1, "One two three four five six seven eight nine ten eleven", "en"),
    (1, "One two three four five six seven eight nine ten eleven", "en"),
    (2, None, None),
    (3, "", "fr"),
    (None, "mail me: joe@mail.example.com or +1 (555) 123-4567, 4111 1111 1111 1111.", "en"),
    (4, LONG, "en"),
    (5, " \n\t lead  and <|endoftext|> trail  ", "de"),
    (6, "日本語 ½ é ́ 192.168.0.1 300.1.1.1 1.2.3.4.5 don't we'll", "ja"),
    (7, "zero one two three four five six seven eight nine ten ELEVEN twelve", "en"),
]
BENCH = [(10, "two three four five six seven eight nine ten eleven"), (10, "two three four five six seven eight nine ten eleven"), (11, "Joe@mail"), (12, None), (13, "--"), (None, "one two"), (14, "trail")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string, lang string").selectExpr("*", "'x' rid", "1 word", "2 at", "3 component")


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def plain(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def same(got, want):
    k = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted(map(tuple, got), key=k) == sorted(map(tuple, want), key=k)


@pytest.mark.parametrize("which", ["odd", "docs", "none"])
def test_token_files(spark, which, odd, docs, tmp_path):
    from tokenizers import Tokenizer

    df = {"odd": odd, "docs": docs, "none": odd.limit(0)}[which]
    path = queries.vocabulary("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    manifest = token_files.write_tokens(df, path, 2, str(tmp_path / "f"), tokens_per_file=20_000)
    got = token_files.read_tokens(manifest).collect()
    want, at = [], 0
    for d, x in sorted(plain(df), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = np.array([*t.encode(x or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((d, at, ids.tobytes()))
        at += len(ids)
    same([(r.doc_id, r.start, bytes(r.ids)) for r in got], want)
    for row in manifest.collect():
        f = token_files.TokenFile(open(row.path.removeprefix("file://"), "rb").read())
        ids = f.all_ids()
        for i in np.random.default_rng(1).integers(0, f.tokens, 50):
            assert f.token(int(i)) == ids[i]


def test_levels_of_any_width():
    ids = np.array([0, 255, 256, 65535, 65536, 2**24, 2**32 - 1] * 700, "<u4")
    f = token_files.TokenFile(token_files.file_bytes([1], [len(ids)], ids))
    assert (f.all_ids() == ids).all() and [f.token(i) for i in range(0, len(ids), 37)] == ids[::37].tolist()


@pytest.mark.parametrize("which", ["odd", "docs", "none"])
def test_token_count(which, odd, docs):
    from tokenizers import Tokenizer

    df = {"odd": odd, "docs": docs, "none": odd.limit(0)}[which]
    path = queries.vocabulary("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    want = [(d, len((x or "").encode()), len(t.encode(x or "", add_special_tokens=False).ids)) for d, x in plain(df)]
    same(token_count.count_tokens(df, path).collect(), want)


@pytest.mark.parametrize("which", ["odd", "docs", "none"])
def test_packing(which, odd, docs):
    from tokenizers import Tokenizer

    df = {"odd": odd, "docs": docs, "none": odd.limit(0)}[which]
    path = queries.vocabulary("byte_bpe_50k.json")
    got = packing.pack(df, path, 2, 1024).collect()
    t = Tokenizer.from_file(path)
    want = []
    for d, x in plain(df):
        ids = np.array([*t.encode(x or "", add_special_tokens=False).ids, 2], "<u4")
        cut = [0, *range(len(ids) % 1024 or 1024, len(ids) + 1, 1024)]
        want += [(d, k, a, b - a, ids[a:b].tobytes()) for k, (a, b) in enumerate(zip(cut, cut[1:]))]
    same([(r.doc_id, r.piece, r.start, r.length, bytes(r.ids)) for r in got], want)
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 1024
    if which == "docs":
        assert len(bins) <= 1.02 * math.ceil(sum(r.length for r in got) / 1024) + 1
        whole = {r.sequence_id: bytes(r.ids) for r in packing.sequences(packing.pack(df, path, 2, 1024)).collect()}
        assert sum(map(len, whole.values())) == 4 * sum(r.length for r in got) and max(map(len, whole.values())) <= 4096


def test_plans_are_whole_and_tight():
    rng = np.random.default_rng(3)
    for size in (3, 50, 5000):
        c = Counter(int(x) for x in np.minimum(97, 1 + rng.exponential(30, size)))
        rows, bins = packing.plan_bins(dict(c), 97)
        held = defaultdict(list)
        for length, _, n, first, offset in rows:
            for k in range(n):
                held[first + k].append((offset, length))
        assert len(held) == bins and Counter(x for b in held.values() for _, x in b) == c
        for b in held.values():
            at = 0
            for offset, length in sorted(b):
                assert at == offset
                at += length
            assert at <= 97
        large = sum(n for x, n in c.items() if 2 * x > 97)
        assert bins <= max(large, math.ceil(sum(x * n for x, n in c.items()) / 97)) * 1.1 + 1


def brute_print(text):
    from xxhash import xxh64_intdigest

    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    s = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, linked):
    least = {i: i for i in ids}

    def find(i):
        while least[i] != i:
            i = least[i]
        return i

    for a, b in linked:
        a, b = find(a), find(b)
        least[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_simhash(docs):
    rows = plain(docs)
    prints = {d: brute_print(x) for d, x in rows}
    ids = sorted(prints)
    part = brute_components(ids, [(a, b) for a in ids for b in ids if a < b and (prints[a] ^ prints[b]).bit_count() <= 3])
    same(simhash.near_duplicates(docs).collect(), [(d, f"{prints[d]:016x}", part[d]) for d in ids])


def test_simhash_balls(spark):
    """Clusters of close fingerprints, so dense that keys are left to the full balls, give the true components."""
    rng = np.random.default_rng(5)
    prints = set()
    for _ in range(6):
        centre = int(rng.integers(0, 2**63)) * 2 + 1
        for _ in range(150):
            x = centre
            for b in rng.integers(0, 64, rng.integers(0, 7)):
                x ^= 1 << int(b)
            prints.add(x)
    prints |= {int(x) for x in rng.integers(0, 2**63, 300)}
    prints = sorted(x - (1 << 64) if x >> 63 else x for x in prints)
    tables = Tables(spark)
    df = spark.createDataFrame([(x,) for x in prints], "print long")
    links = simhash.links(df, tables)
    got = {r.node: r.component for r in connected_components(links, tables).collect()}
    close = [(a, b) for i, a in enumerate(prints) for b in prints[i + 1 :] if ((a ^ b) & (2**64 - 1)).bit_count() <= 3]
    want = brute_components(prints, close)
    assert {x: got.get(x, x) for x in prints} == want
    assert {(r.a, r.b) for r in links.collect()} <= set(close)


def test_simhash_odd_rows(odd):
    got = simhash.near_duplicates(odd).collect()
    assert len(got) == len(ROWS)
    by = defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
    assert by[2][0].component_id == by[3][0].component_id == 2 and by[2][0].fingerprint == "0" * 16
    assert [r.component_id for r in by[1]] == [1, 1]
    assert simhash.near_duplicates(odd.limit(0)).collect() == []


def brute_hits(docs, bench):
    w = lambda x: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), x or ""))
    windows = defaultdict(set)
    for i, x in bench:
        if i is not None and (ws := w(x)):
            for k in range(max(1, len(ws) - 9)):
                windows[tuple(ws[k : k + 10])].add(str(i))
    sizes = {len(x) for x in windows}
    for d, x in docs:
        ws, hit, items = w(x), set(), set()
        for n in sizes:
            for k in range(len(ws) - n + 1):
                if found := windows.get(tuple(ws[k : k + n])):
                    hit |= set(range(k, k + n))
                    items |= found
        yield d, len(ws), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("sent", [0, 100_000])
def test_decontamination(spark, sf, odd, docs, sent):
    bench = spark.createDataFrame(BENCH, "item_id long, text string").selectExpr("*", "1 rid", "2 pos")
    same(decontam.digest(decontam.contaminated(odd, bench, most_sent=sent)).collect(), brute_hits(plain(odd), BENCH))
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    rows = [(r.item_id, r.text) for r in items.collect()]
    got = decontam.digest(decontam.contaminated(docs, items, most_sent=sent)).collect()
    same(got, brute_hits(plain(docs), rows))
    assert any(r.contaminated for r in got) and not all(r.contaminated for r in got)
    if sent:
        assert decontam.contaminated(odd.limit(0), bench).collect() == []
        assert {r.n_hit for r in decontam.contaminated(odd, bench.limit(0)).collect()} == {0}


def luhn(m):
    d = [int(c) for c in re.sub("[^0-9]", "", m)][::-1]
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(d)) % 10 == 0


def brute_spans(text):
    text = text or ""
    digits = lambda m: len(re.sub("[^0-9]", "", m))
    kinds = [
        (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x.lstrip('0')[:4] or 0) <= 255 for x in m.split('.'))),
        (r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= digits(m) <= 19 and luhn(m)),
        (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= digits(m) <= 15),
    ]
    return [(k, m.start(), m.end()) for k, (p, ok) in enumerate(kinds) for m in re.finditer(p, text) if ok(m[0])]


HARD = [
    "a@b.c_d@e.f x@y a@b..c a.b@c.d.e-f.g a@b@c.com @x.y +a@b.co",
    "1.2.3.4.5.6.7.8 1.2.3 001.2.3.4 256.1.1.1 999.1.1.1.1 1.2.3.4.300",
    "4111111111111111 4111-1111-1111-1111 4111 1111  1111 1111 12 4111111111111111 3 x4111111111111111y 0000000000000 00000000000000000000",
    "+49 30 1234567 +1 (2)3 +1+2 555 0100 44 + 12345678901 +1.2.3.4.5.6.7.8.9.0.1.2 (555) 123-4567 555-123-4567",
    "🙂 é joe@x.org 🙂 10.0.0.1 joe [at] site [dot] com phone 555.123.4567",
    ("a" * 3000 + " ") * 20 + "1" * 9000 + ".2" * 4000 + " +1" * 3000,
]


def test_personal_data(spark, docs, odd):
    rows = [(500 + k, x) for k, x in enumerate(HARD)]
    df = odd.select("doc_id", "text").unionByName(docs.selectExpr("doc_id + 1000 doc_id", "text")).unionByName(spark.createDataFrame(rows, "doc_id long, text string"))
    found, model = pii.find(df)
    got = found.collect()
    want = [(d, tuple(brute_spans(x))) for d, x in plain(df)]
    same([(r.doc_id, tuple((s.kind, s.s, s.e) for s in r.spans if s.base)) for r in got], want)
    for r in got:
        places = [(s.kind, s.s, s.e) for s in r.spans]
        assert places == sorted(places)
    extra = {(r.doc_id, s.kind, s.s, s.e) for r in got for s in r.spans if not s.base}
    x = HARD[4]
    assert (504, 0, x.index("joe ["), x.index(" phone")) in extra
    names = ("email", "ip", "card", "phone")
    d = {r.doc_id: r for r in pii.digest(found).collect()}
    for k, s in want:
        text = ",".join(f"{names[a]}:{b}:{c}" for a, b, c in s)
        assert d[k].base_sha256 == hashlib.sha256(text.encode()).hexdigest() or k == 1
    clean = pii.redact(odd.withColumn("n_chars", odd.at.cast("long")), model)
    assert clean.columns == [*odd.columns, "n_chars"]
    out = {r.doc_id: r for r in clean.collect()}
    assert out[None].text == "mail me: [EMAIL] or [PHONE], [CARD]." and out[None].n_chars == 36
    assert out[2].text is None and out[3].text == "" and out[1].n_chars == 2
    none, model = pii.find(odd.limit(0))
    assert none.collect() == [] and set(model.weights.values()) == {0.0}


def test_personal_data_of_long_texts(spark):
    """Work in proportion to the number of spans, which may overlap the pieces that a text is cut into."""
    long = "é write to someone.else@example.com (555) 123-4567 and " * 30_000
    rows = [(1, long), (2, "🙂" * 4090 + " a@b.com" * 3 + "x" * 9000 + " 10.0.0.1 joe [at] site [dot] com" * 200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found, model = pii.find(df)
    spans = {r.doc_id: [(s.kind, s.s, s.e, s.base) for s in r.spans] for r in found.collect()}
    out = {r.doc_id: r.text for r in pii.redact(df, model).collect()}
    for k, x in rows:
        assert [s[:3] for s in spans[k] if s[3]] == brute_spans(x)
        base = [s for s in spans[k] if s[3]]
        assert not any(b[1] < e and s < b[2] for _, s, e, is_base in spans[k][-400:] if not is_base for b in base[-800:])
        want, at = [], 0
        for kind, s, e, _ in sorted(spans[k], key=lambda s: (s[1], s[2], s[0])):
            if s >= at:
                want += [x[at:s], f"[{pii.KINDS[kind].upper()}]"]
            at = max(at, e)
        assert out[k] == "".join(want) + x[at:]


def test_preferences(spark):
    a = [(1, 0, "system", "s"), (1, 1, "user", "u"), (1, 2, "assistant", "good"), (2, 0, "user", None), (2, 1, None, "x"), (3, 0, "user", "same"), (4, 0, "user", "alone"), (None, 0, "user", "n")]
    b = [(1, 0, "system", "s"), (1, 1, "user", "u"), (1, 2, "assistant", "é🙂d"), (1, 3, "user", "more"), (2, 0, "user", ""), (2, 1, "", "y"), (3, 0, "user", "same"), (5, 0, "user", "alone")]
    s = "pair_id long, turn long, role string, text string"
    got = {r.pair_id: r for r in preference.format_preferences(spark.createDataFrame(a, s), spark.createDataFrame(b, s)).collect()}
    assert set(got) == {1, 2, 3}
    r = got[1]
    assert (r.n_prompt_turns, r.prompt, r.chosen, r.rejected) == (2, "<|system|>\ns\n<|user|>\nu\n", "<|assistant|>\ngood\n", "<|assistant|>\né🙂d\n<|user|>\nmore\n")
    lo, hi = map(int, r.chosen_mask.split(":"))
    assert r.chosen[lo:hi] == "good"
    lo, hi = map(int, r.rejected_mask.split(":"))
    assert r.rejected[lo:hi] == "é🙂d"
    assert (got[2].n_prompt_turns, got[2].prompt, got[2].chosen, got[2].chosen_mask) == (1, "<|user|>\n\n", "<||>\nx\n", "")
    assert (got[3].n_prompt_turns, got[3].chosen, got[3].rejected) == (1, "", "")


def brute_links(rows):
    ok = {}
    for k, (i, e, label) in enumerate(rows):
        if i is not None and label is not None and e and all(x is not None and math.isfinite(x) for x in e) and any(e):
            x = np.array(e, float) / np.max(np.abs(e))
            ok[k] = (label, x / np.sqrt((x * x).sum()))
    links = [(a, b) for a in ok for b in ok if a < b and ok[a][0] == ok[b][0] and len(ok[a][1]) == len(ok[b][1]) and ok[a][1] @ ok[b][1] >= 0.98]
    n = Counter(x for p in links for x in p)
    part = brute_components(range(len(rows)), links)
    least = {}
    for k in range(len(rows)):
        if k in ok:
            least[part[k]] = min(least.get(part[k], rows[k][0]), rows[k][0])
    for k, (i, *_rest) in enumerate(rows):
        c = least[part[k]] if k in ok else i
        yield i, n[k], c, i is not None and i == c


def test_embeddings(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    rng = np.random.default_rng(2)
    rows = [(r.vec_id, list(r.embedding), r.label) for r in df.collect()]
    base = rng.normal(size=64)
    rows += [(10_000 + k, (base + rng.normal(size=64) * 0.06).astype(np.float32).tolist(), 1) for k in range(60)]
    rows += [(20_000, None, 1), (20_001, [0.0] * 64, 1), (20_002, [float("nan")] + [1.0] * 63, 1), (20_003, [None] + [1.0] * 63, 1), (20_004, rows[0][1], None), (None, rows[0][1], rows[0][2]), (20_005, [], 1), (20_006, [1.0, 2.0], 1), (20_007, [2.0, 4.0], 1), (20_008, rows[0][1], rows[0][2]), (20_008, rows[0][1], rows[0][2]), (20_009, [3.0e38] * 64, 1), (20_010, [1e-30] * 64, 1)]
    data = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "1 node", "2 v", "3 component")
    rows = [(r.vec_id, list(r.embedding) if r.embedding is not None else None, r.label) for r in data.collect()]
    report = {}
    got = nn_descent.near_duplicates(data, report=report).collect()
    same(got, list(brute_links(rows)))
    assert report["audits"][-1][1] >= 0.9 * report["audits"][-1][0]
    assert nn_descent.near_duplicates(data.limit(0)).collect() == []


def test_links_between_dense_groups(spark):
    """Two groups of more members than a list holds, joined by weaker links over the threshold."""
    rng = np.random.default_rng(5)
    x, y = np.linalg.qr(rng.normal(size=(64, 2)))[0].T
    ends = (x, 0.985 * x + math.sqrt(1 - 0.985**2) * y)
    rows = [(40 * g + k, (ends[g] + rng.normal(size=64) * 3e-3).tolist(), 1) for g in (0, 1) for k in range(40)]
    data = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    same(nn_descent.near_duplicates(data, most_rounds=1).collect(), list(brute_links(rows)))


def test_dense_groups_of_a_thousand(spark):
    """Near-identical vectors beyond any list's length, and two such groups of which only the nearest members link."""
    rng = np.random.default_rng(8)
    x, y = np.linalg.qr(rng.normal(size=(64, 2)))[0].T
    rows = [(k, (x + rng.normal(size=64) * 1e-3).tolist(), 1) for k in range(1000)]
    far = math.cos(1.18 * math.acos(0.98))
    rows += [(1000 + 200 * g + k, ((x if g == 0 else far * x + math.sqrt(1 - far**2) * y) + rng.normal(size=64) * 2e-3).tolist(), 2) for g in (0, 1) for k in range(200)]
    data = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    report = {}
    same(nn_descent.near_duplicates(data, report=report).collect(), list(brute_links(rows)))
    n, found = report["audits"][-1]
    assert found == n >= nn_descent.AUDIT_LINKS and "links" not in report


def test_links_that_descent_misses(spark, monkeypatch):
    """A graph without edges, and blocks smaller than the labels."""
    monkeypatch.setattr(nn_descent, "forest", lambda *_: spark.createDataFrame([], "a long, b long, sim double"))
    monkeypatch.setattr(nn_descent, "BLOCK", 16)
    monkeypatch.setattr(nn_descent, "STRIP", 5, raising=False)
    rng = np.random.default_rng(6)
    base = rng.normal(size=(3, 64))
    rows = [(k, (base[k % 3] + rng.normal(size=64) * 0.14).tolist(), k // 60) for k in range(120)]
    rows += [(200 + k, rows[k][1], rows[k][2]) for k in range(5)]
    data = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    report = {}
    same(nn_descent.near_duplicates(data, most_rounds=1, report=report).collect(), list(brute_links(rows)))
    assert report["links"][0] > 0 == report["links"][1]


def test_pairs_just_below_the_threshold(spark):
    rng = np.random.default_rng(7)
    rows = []
    for label in range(40):
        x, y = np.linalg.qr(rng.normal(size=(64, 2)))[0].T
        cosine = 0.98 + (-3e-9 if label % 4 else 3e-9)
        rows += [(2 * label, x.tolist(), label), (2 * label + 1, (cosine * x + math.sqrt(1 - cosine**2) * y).tolist(), label)]
    data = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    same(nn_descent.near_duplicates(data, most_rounds=0).collect(), list(brute_links(rows)))


def test_lattice_sums_all_segmentations():
    pieces = ["▁", "▁a", "▁ab", "a", "b", "ab", "bc", "c", "<b>"]
    p = np.array([0.1, 0.1, 0.05, 0.2, 0.2, 0.1, 0.1, 0.1, 0.05])
    lattice = lm_score.Lattice(pieces, np.log(p), {b: 8 for b in range(256)})

    def brute(s):
        return 1.0 if not s else sum(p[pieces.index(s[:n])] * brute(s[n:]) for n in range(1, min(3, len(s)) + 1) if s[:n] in pieces)

    words = ["abc", "a", "ababab", "bca", "c" * 70]
    assert np.allclose(np.exp(lattice.words(words)), [brute("▁" + w) for w in words])
    assert np.allclose(np.exp(lattice.words(["é"])), [0.1 * 0.05**2])
    counts = np.array([2.0, 1.0, 3.0, 1.0, 1.0])
    use = lattice.expected(words, counts)
    d = 1e-6
    for k in range(8):  # expected uses are the derivative by the log weight
        moved = np.log(p)
        moved[k] += d
        other = lm_score.Lattice(pieces, moved, {b: 8 for b in range(256)})
        assert abs(((other.words(words) - lattice.words(words)) * counts).sum() / d - use[k]) < 1e-3


def test_lattice_looks_up_beginnings_of_pieces_alone(monkeypatch):
    pieces = ["▁", "▁ab", "a", "b", "abcabcab", "c", "z", "<b>"]
    lattice = lm_score.Lattice(pieces, np.log(np.full(8, 1 / 8)), {b: 7 for b in range(256)})
    asked, find = [], lattice._find
    monkeypatch.setattr(lattice, "_find", lambda h: asked.append(len(h)) or find(h))
    words = ["z" * 40, "abcabcab", "abcabcaé"]
    got = np.exp(lattice.words(words))
    assert np.allclose(got, [8.0**-41, 8.0**-9 + 8.0**-7 + 8.0**-2, 8.0**-10 + 8.0**-8])
    assert sum(asked) < 3 * sum(len(w) + 1 for w in words)  # 8 to 41 substrings begin at a place, and few begin a piece


def test_scores_are_marginals(spark, odd):
    """The score of a text is the sum over all segmentations of its words, and its end, by plain recursion."""
    rows = [(1, "Ab ab abc  déjà\tvu"), (2, ""), (3, None), (10, "Ab " * 3 + "x" * 70), (4, "ab")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    path = queries.vocabulary("piece_bpe_32k.model")
    lattice = lm_score.vocabulary(path)
    weight = {p: x for p, x in zip(lattice.pieces, lattice.logp)}
    inner = {b: lattice.logp[k] for b, k in lattice.byte_pieces.items()}
    for k in lattice.byte_pieces.values():
        weight.pop(lattice.pieces[k], None)

    def plain_word(w):
        s, a = lm_score.MARK + w, [0.0]
        for j in range(1, len(s) + 1):
            arcs = [a[i] + weight[s[i:j]] for i in range(j) if s[i:j] in weight]
            if s[j - 1] not in weight:
                arcs.append(a[j - 1] + sum(inner[b] for b in s[j - 1].encode()))
            a.append(float(np.logaddexp.reduce(arcs)))
        return a[-1]

    words = lambda x: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), x or ""))
    training = [x for d, x in rows if crc32(str(d).encode()) % 10]
    ends, n = len(training), sum(len(words(x)) + 1 for x in training)
    share = (ends + 0.1) / (n + 0.2)
    want = {d: (sum(plain_word(w) + math.log(1 - share) for w in words(x)) + math.log(share)) / math.log(10) for d, x in rows}
    got = {r.doc_id: r.score for r in lm_score.score(df, path, rounds=0).collect()}
    assert got.keys() == want.keys() and all(abs(got[d] - want[d]) < 1e-6 for d in want)


def brute_base(rows):
    tok = [(d, re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), x or ""))) for d, x in rows]
    out = lambda d: crc32(("" if d is None else str(d)).encode()) % 10 == 0
    c = Counter()
    for d, w in tok:
        if not out(d):
            c.update([*w, None])
    n, v = sum(c.values()), len(c)
    for d, w in tok:
        yield d, out(d), len(w) + 1, sum(c[x] > 0 for x in [*w, None]), n, round(sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in [*w, None]), 4)


@pytest.mark.parametrize("which", ["odd", "docs", "none"])
def test_scores(which, odd, docs):
    df = {"odd": odd, "docs": docs, "none": odd.limit(0)}[which]
    got = lm_score.score(df, queries.vocabulary("piece_bpe_32k.model")).collect()
    same([(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got], list(brute_base(plain(df))))
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)
    if which == "docs":  # spelling learnt from the training texts suits held-out texts better than the vocabulary's own scores
        other = lm_score.score(df, queries.vocabulary("piece_bpe_32k.model"), rounds=0).collect()
        total = lambda rows: sum(r.score for r in rows if r.held_out)
        assert total(got) > 0.95 * total(other)
        assert total(got) > total(other)


def plain_quality(m, text):
    """The score by loops over passages, bytes and units."""
    raw = (text or "").encode()
    z, weights, units = np.zeros(quality.HIDDEN), [], []
    for lo in range(0, max(1, len(raw)), quality.PASSAGE):
        own = raw[lo : lo + quality.PASSAGE]
        x = np.zeros(quality.WIDTH)
        runs = set()
        for k, b in enumerate(own, lo):
            x[b] += 1
            if k + 1 < len(raw):
                x[256 + (b * 31 + raw[k + 1] & quality.PAIRS - 1)] += 1
            if k + 8 <= len(raw):
                runs.add(int.from_bytes(raw[k : k + 8], "big") * 0x9E3779B97F4A7C15 % 2**64 >> 54)
        n = len(own)
        x = np.sqrt(x / max(n, 1))
        x[-4:] = [3 * len(runs) / max(quality.RUNS * (1 - math.exp(-n / quality.RUNS)), 1), n / quality.PASSAGE, n == 0, 1]
        h = np.array([math.tanh(sum(a * b for a, b in zip(x, m.w[:, j]))) for j in range(quality.HIDDEN)])
        gate = [math.tanh(h @ m.v[:, j]) / (1 + math.exp(-(h @ m.u[:, j]))) * m.a[j] for j in range(quality.GATE)]
        weights.append(math.exp(sum(gate)))
        units.append(h)
    for w, h in zip(weights, units):
        z += w / sum(weights) * h
    return 1 / (1 + math.exp(-(z @ m.c[:-1] + m.c[-1])))


def test_quality_by_loops(docs, monkeypatch):
    g = np.random.default_rng(3)
    m = quality.Model(*(g.normal(0, 0.5, s) for s in ((quality.WIDTH, quality.HIDDEN), (quality.HIDDEN, quality.GATE), (quality.HIDDEN, quality.GATE), (quality.GATE,), (quality.HIDDEN + 1,))))
    texts = ["", "a", "é🙂" * 5, "x" * 1023, "y" * 1024, "z1" * 520, *(x for _, x in plain(docs)[:6])]
    want = [plain_quality(m, x) for x in texts]
    assert np.allclose(m.score(texts), want, atol=2e-5)
    monkeypatch.setattr(quality, "SEGMENT", 2)  # by segments of two passages
    long = [x * 3 for x in texts if x]
    assert np.allclose(m.score(long), [plain_quality(m, x) for x in long], atol=2e-5)


def test_quality_learns_from_all_passages(spark):
    """What tells the labels apart stands in the last of a hundred passages; rows beyond the bounds of the sample are left out, not cut."""
    filler = "plain words of no account " * 4000
    rows = [(k, filler + ("#@!$%^&*" * 120 if k % 2 else "")) for k in range(40)] + [(100, "x" * (1 << 20) + "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k, _ in rows], "doc_id long, quality int")
    model = quality.learn(docs, labels, F.lit(True), label_bytes=3 << 20)
    assert all((model.score([x])[0] >= 0.5) == (k % 2 == 1) for k, x in rows[:40])
    assert quality.learn(docs.where("doc_id = 100"), labels, F.lit(True)) is None


def test_quality(spark, docs, odd):
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    more = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    model = quality.learn(more, labels, ~quality.held_out())
    scored = quality.score(more, model).withColumn("held_out", quality.held_out()).join(labels, "doc_id").where("held_out").collect()
    right = [(r.score >= 0.5) == (r.quality == 1) for r in scored]
    assert sum(right) / len(right) > 0.95
    assert all((crc32(str(r.doc_id).encode()) % 3 == 1) for r in scored)
    got = quality.score(odd, model, ("doc_id", "text")).collect()
    assert len(got) == len(ROWS) and all(0 <= r.score <= 1 for r in got)
    one = model.score([LONG, "short", ""])
    assert np.allclose(one, [model.score([x])[0] for x in (LONG, "short", "")], atol=1e-5)
    assert {r.score for r in quality.score(odd, None).collect()} == {0.5} and quality.score(odd.limit(0), model).collect() == []
    assert quality.learn(odd, labels.limit(0), ~quality.held_out()) is None
