"""Training-data operators against brute force, round trips and held-out accuracy, with odd inputs."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from tesselon.llm import bpe, embeddings, license, linededup, lm, mixing, ordering, quality, similar, simhash, suffix, tokencount

TEXT, JSON = P.path("byte_bpe_50k.tiktoken"), P.path("byte_bpe_50k.json")
KINDS = "doc_id long, text string, lang string, source string, D string, `key` int"
random.seed(3)


def words(n, seed):
    r = random.Random(seed)
    return " ".join("".join(r.choice(["th", "er", "an", "on", "re", "st"]) for _ in range(r.randint(1, 4))) for _ in range(n))


def odd_rows():
    a, b = words(300, 1), words(200, 2)
    texts = [a, a, a.replace("th", "TH", 1), b, b[:900] + " changed " + b[900:], None, "", " \n\t", "one", "x y z", "ab " * 900, "l1\nl2\nl3\nl4\nq", "0\nl1\nl2\nl3\nl4", words(20000, 4), "é中🙂 " * 50]
    rows = [(i, t, "en" if i % 2 else None, "s" if i % 3 else None, "clash", i) for i, t in enumerate(texts)]
    return rows + [(None, "text without id here", "en", "s", None, None), rows[0], rows[11]]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(odd_rows(), KINDS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], KINDS)


def test_simhash(docs, none):
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(odd_rows())
    fp = {i: simhash.simhash(t) for i, t, *_ in odd_rows()}
    reach = {i: {j for j in fp if bin(fp[i] ^ fp[j]).count("1") <= 2} for i in fp}
    for i in reach:
        todo = list(reach[i])
        while todo:
            for k in reach[todo.pop()] - reach[i]:
                reach[i].add(k)
                todo.append(k)
    for r in got:
        assert r.fp & (1 << 64) - 1 == fp[r.doc_id] and r.component_id == min(x for x in reach[r.doc_id] if x is not None or len(reach[r.doc_id]) == 1)
    kept = [r.doc_id for r in simhash.keep_one_of_each(docs).collect()]
    assert len(kept) == len(set(kept)) and set(kept) == {r.component_id for r in got}
    assert simhash.near_duplicates(none).count() == 0


def shingle_sets(texts, size=5):
    split = [(t or "").lower().split() for t in texts]
    return [{tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set() for w in split]


def reachable(sets):
    """Places reachable over pairs at a Jaccard similarity of 0.8 or more, empty sets being alike."""
    n = len(sets)
    near = [[j for j in range(n) if sets[i] == sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])] for i in range(n)]
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        out.append(seen)
    return out


def planted(groups=12, copies=9):
    """Texts with copies in which single words are replaced, from none to too many for a near copy."""
    r = random.Random(8)
    texts = []
    for g in range(groups):
        base = words(60 + 20 * g, 900 + g).split()
        for c in range(copies):
            w = list(base)
            for _ in range(c):
                w[r.randrange(len(w))] = f"new{g}x{r.randrange(9999)}"
            texts.append(" ".join(w))
    r.shuffle(texts)
    return texts


def test_near_copies(spark, docs, none, monkeypatch):
    texts = [*planted(), None, "", "a b", "A B", "a b c", "a b"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    parts = reachable(shingle_sets(texts))
    want = {i: min(p) for i, p in enumerate(parts)}
    for block in (similar.BLOCK, 200):  # one tile for each cluster, and many
        monkeypatch.setattr(similar, "BLOCK", block)
        assert {r.id: r.component_id for r in similar.near_copies(rows).collect()} == want
    kept = [r.doc_id for r in similar.keep_one_of_each(rows).collect()]
    assert sorted(kept) == sorted(set(want.values()))
    assert similar.near_copies(docs).count() == len(odd_rows()) and similar.keep_one_of_each(none).count() == 0


def test_near_copies_meet_by_fingerprints_alone(spark, monkeypatch):
    """Without minimum hashes the range join on SimHash segments finds what differs in 2 bits or fewer."""
    base = words(3000, 77).split()
    texts = [" ".join(base), " ".join([*base[:500], "changed", *base[501:]]), words(3000, 78), "a b", "a c"]
    bits = [simhash.majority(similar.shingles(t, 5)) for t in texts]
    assert 0 < (bits[0] ^ bits[1]).bit_count() <= 2 < (bits[0] ^ bits[2]).bit_count()
    monkeypatch.setattr(similar, "bands", lambda found: [])
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.id: r.component_id for r in similar.near_copies(rows).collect()} == {0: 0, 1: 0, 2: 2, 3: 3, 4: 4}


def test_near_copy_of_one_word_goes(spark):
    import corpus_pipeline

    base = words(120, 77).split()
    other = [*base[:60], "changed", *base[61:]]
    rows = spark.createDataFrame([(1, " ".join(base)), (2, " ".join(other)), (3, words(120, 78))], "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, rows, "").collect()) == [1, 3]


def test_suffix(docs, none):
    for n in (400, 60):
        got = suffix.remove_repeats(docs, length=n, gram=n // 2).collect()
        data = [(r[1] or "").encode() for r in odd_rows()]
        seen = collections.Counter(d[i : i + n] for d in data for i in range(len(d) - n + 1))
        want = []
        for d in data:
            gone = np.zeros(len(d), bool)
            for i in range(len(d) - n + 1):
                if seen[d[i : i + n]] > 1:
                    gone[i : i + n] = True
            kept = bytes(np.frombuffer(d, np.uint8)[~gone])
            want.append((len(d), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum() + gone[:1].sum()), kept))
        key = lambda r, w: (r is None, r or 0, w)
        assert sorted((key(r.doc_id, (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept))) for r in got)) == sorted(key(r[0], w) for r, w in zip(odd_rows(), want, strict=True))
    assert suffix.remove_repeats(none).count() == 0


def test_passages_too_short_to_be_removed_are_told(spark):
    shared = words(70, 4321)[:310]
    rows = [(i, words(60, 5000 + i) + (" " + shared + " " if i < 2 else " ") + words(60, 6000 + i)) for i in range(12)]
    rows += [(20, words(50, 1) + " " + shared[:90] + " " + words(50, 2)), (21, (words(20, 3) + " ") * 4), (22, None), (23, shared)]
    got = {r.doc_id: r for r in suffix.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i for i, r in got.items() if r.shares_passage} == {0, 1, 23} and all(r.n_removed == 0 for i, r in got.items() if i < 21)


def test_order_of_words():
    r = np.random.default_rng(1)
    columns = [r.integers(0, 3, 500) for _ in range(4)]
    assert (ordering.multikey_order(columns) == np.lexsort(columns[::-1])).all()


def test_runs_over_many_buckets(spark, monkeypatch):
    """A run that fills several buckets, and short ones, as by sorting everything in one place."""
    monkeypatch.setattr(ordering, "partitions", lambda spark, rows: 23)
    r = random.Random(9)
    rows = sorted({(a := r.choice([0, 0, 0, 1, 2, r.randint(3, 200)]), r.randint(0, 1) * (a > 0), r.randint(0, 300), r.randint(0, 9)) for _ in range(900)})
    tables = ordering.Tables(spark)
    df = spark.createDataFrame(rows, "h1 long, h2 long, doc long, line long")
    got = {tuple(x)[:4]: x for x in ordering.runs(tables.write(df), ["h1"], ["h2"], ["doc", "line"], tables).collect()}
    wide, full = collections.Counter(x[0] for x in rows), collections.Counter(x[:2] for x in rows)
    first = {}
    for x in rows:
        first.setdefault(x[:2], x[2:])
    assert set(got) == {x for x in rows if wide[x[0]] > 1}
    for k, x in got.items():
        assert (x.equal, x.later) == (full[k[:2]] > 1, k[2:] != first[k[:2]])
    for h in wide:  # one of each kind asks where there are several kinds
        kinds = {k for k in full if k[0] == h}
        assert len(kinds) == 1 or kinds == {k[:2] for k, x in got.items() if k[0] == h and x.ask}


def test_lines(docs, none):
    got = {(r.doc_id, r.text): r for r in linededup.dedup_lines(docs).collect()}
    by_id = {k[0]: r for k, r in got.items()}
    assert by_id[11].text == "l1\nl2\nl3\nl4\nq" and by_id[12].text == "0" and by_id[12].n_removed == 4
    assert by_id[5].text is None and by_id[0].D == "clash" and linededup.dedup_lines(none).count() == 0


def test_quality(docs, none):
    for r in quality.judge(docs).collect():
        text = next(t for i, t, *_ in odd_rows() if i == r.doc_id) or ""
        ws = [w for w in re.split("[ \t-\r]+", text) if w]
        grams = collections.Counter(tuple(ws[i : i + 5]) for i in range(len(ws) - 4))
        places = {i + j for i in range(len(ws) - 4) if grams[tuple(ws[i : i + 5])] > 1 for j in range(5)}
        lines = [x for x in text.split("\n") if x.strip(" \t\n\r\x0b\x0c")]
        assert (r.n_words, r.word_chars, r.n_dup_lines, r.n_repeat_words) == (len(ws), sum(map(len, ws)), len(lines) - len(set(lines)), len(places))
        assert r.base_failed == (len(ws) < 10 or 100 * len(places) > 20 * len(ws)) and not (r.base_failed and r.kept)
    assert quality.judge(none).count() == 0 and quality.keep_good(docs).columns == docs.columns


def test_quality_outliers(spark):
    rows = [(i, words(60, i) if i % 10 else " ".join(w + "###$$$" for w in words(60, i).split()), "en", "hot") for i in range(400)]
    got = {r.doc_id: r.kept for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert all(got[i] == bool(i % 10) for i in got)


def mcd(x, groups, steps=8):
    """Squared distances by minimum covariance determinant per group in plain numpy, nearest points found by sorting."""
    d = x.shape[1]
    floors = np.diag([f * f for f in quality.FLOORS.values()])
    factor = quality._consistency()

    def fit(points, everyone, widen):
        n, e = len(points), len(everyone)
        w = np.concatenate([np.ones(n), np.full(e, quality.PRIOR / e)])
        both = np.concatenate([points, everyone])
        m = (both * w[:, None]).sum(0) / w.sum()
        return m, ((both - m) * w[:, None]).T @ (both - m) / w.sum() * widen + floors

    def away(points, m, c):
        return np.einsum("ij,jk,ik->i", points - m, np.linalg.inv(c), points - m)

    names = sorted(set(groups))
    own = {g: x[[k == g for k in groups]] for g in names}
    found = {g: [fit(p, x, 1.0)] for g, p in own.items()}
    for g, p in own.items():
        q = np.median(p, 0)
        c = np.diag(np.maximum(1.4826 * np.median(abs(p - q), 0), list(quality.FLOORS.values())) ** 2)
        found[g] += [(q, c), (q, c)]
    for step in range(steps):
        near = {g: [p[np.argsort(away(p, *f))[: max(1, math.ceil((0.5 if s == 2 and not step else quality.SHARE) * len(p)))]] for s, f in enumerate(found[g])] for g, p in own.items()}
        everyone = [np.concatenate([near[g][s] for g in names]) for s in range(3)]
        found = {g: [fit(near[g][s], everyone[s], factor) for s in range(3)] for g in names}
    best = {g: min(f, key=lambda e: np.linalg.slogdet(e[1])[1]) for g, f in found.items()}
    assert d == len(quality.DIMS)
    return np.array([away(p[None], *best[g])[0] for p, g in zip(x, groups, strict=True)])


def test_quality_verdict_equals_plain_mcd(spark):
    """Groups of 1 to 300 texts, a third of all rows in one; texts with symbols are outliers where their group has few."""
    r = random.Random(4)
    rows = []
    for g, n in enumerate((1, 3, 12, 60, 150, 300)):
        for i in range(n):
            ws = words(r.randint(40, 90), 7000 + len(rows)).split()
            mark = "###$$$" if i and i % 11 == 0 else "#" if g > 2 else ""
            every = 1 if len(mark) > 1 else 6
            rows.append((len(rows), " ".join(w + mark if k % every == 0 else w for k, w in enumerate(ws)), f"l{g % 2}", f"s{g}"))
    got = quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()
    got = {x.doc_id: x for x in got if not x.base_failed}
    stats = [[math.log(x.word_chars / x.n_words), math.log(1 + 1000 * x.n_symbols / x.word_chars), 0.0, math.log(1 + 10 * x.n_repeat_words / x.n_words)] for x in got.values()]
    want = mcd(np.array(stats), [rows[i][3] for i in got])
    clear = [(x, w) for x, w in zip(got.values(), want, strict=True) if not 0.6 < w / quality.quantile(4e-9) < 1.6]
    assert all(x.kept == (w <= quality.quantile(4e-9)) for x, w in clear) and len(clear) > 0.9 * len(got)
    assert 10 < sum(not x.kept for x in got.values()) < 60 and abs(quality.quantile(4e-9) - 45) < 0.2


def test_bpe():
    import tiktoken

    t = bpe.tokenizer(TEXT, P.PATTERN)
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=t.ranks, special_tokens={})
    small = bpe.Tokenizer(TEXT, P.PATTERN, moves=50, memo=20)  # states and units run out at once
    texts = ["".join(random.choice("ab \n\t'sthéß中🙂0123  <|endoftext|>.,!\x1c\x85\xa0  the ing") for _ in range(random.randint(0, 60))) for _ in range(500)]
    for x in [*texts, "a" * 3000, "ab" * 2000, " " * 999, "中" * 500, "\n" * 99]:
        want = np.array(lib.encode_ordinary(x), "<u4").tobytes()
        assert t.encode(x) == want == small.encode(x) and "".join(t.decode(want, 3)) == x


def test_utf8_stream():
    data = "aé中🙂z".encode()
    s = bpe.Utf8Stream()
    assert "".join(s.feed(data[i : i + 1]) for i in range(len(data))) + s.feed(b"", True) == "aé中🙂z"


def test_round_trip(docs, none):
    for r in bpe.round_trip(docs, TEXT, P.PATTERN).collect():
        text = next(t for i, t, *_ in odd_rows() if i == r.doc_id) or ""
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    ids = bpe.encode_documents(docs, TEXT, P.PATTERN)
    assert {r.text for r in bpe.decode_documents(ids, TEXT, P.PATTERN).collect()} == {r[1] or "" for r in odd_rows()}
    assert bpe.round_trip(none, TEXT, P.PATTERN).count() == 0


def test_token_counts(docs, none):
    plain = tokencount.Counter(JSON)
    tiny = tokencount.Counter(JSON, chunk=40, overlap=4)
    for _ in range(500):
        x = "".join(random.choice("ab \n\t'sthé中🙂01 <|endoftext|>., the\x1c") for _ in range(random.randint(0, 300)))
        assert plain.count(x) == tiny.count(x) == len(plain.library.encode(x, add_special_tokens=False))
    long = " ".join(random.choice(["the", "a\x1cb", "\x1f", "é中", "\xa0x", "0123"]) for _ in range(30000))  # separators that are not white space to the tokenizer
    assert plain.count(long) == len(plain.library.encode(long, add_special_tokens=False))
    got = {r.doc_id: r for r in tokencount.count_tokens(docs, JSON, chunk=1000).collect()}
    assert got[13].n_tokens == len(plain.library.encode(odd_rows()[13][1], add_special_tokens=False)) and got[5].n_tokens == 0
    assert tokencount.count_tokens(none, JSON).count() == 0


def test_vectors(spark):
    r = np.random.default_rng(5)
    base = r.standard_normal((12, 16))
    v = [(i, [float(x) for x in base[i % 12] + r.standard_normal(16) * (0.02 + 0.2 * (i % 3))]) for i in range(150)]
    v += [(1000, v[3][1]), (1001, None), (1002, [0.0] * 16), (1003, [float("nan")] * 16), (1004, [None] * 16), (None, v[4][1])]
    got = {x.vec_id: x for x in embeddings.near_vectors(spark.createDataFrame(v, "vec_id long, embedding array<float>"), 0.95).collect()}
    x = np.array([np.float32(e) for _, e in v[:151]], np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    m = x @ x.T >= 0.95
    for (i, _), n in zip(v[:151], m.sum(1) - 1, strict=True):
        assert got[i].n_links == n + (m[[k for k, _ in v].index(i), 4])
    assert all(got[i].n_links == 0 and got[i].component_id == i for i in (1001, 1002, 1003, 1004))
    assert embeddings.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_vectors_of_several_lengths_and_near_the_threshold(spark, monkeypatch):
    r = np.random.default_rng(6)
    v = []
    for n in (2, 3, 16):
        base = r.standard_normal((6, n))
        for i in range(60):  # cosines on both sides of the threshold, many within the bounds of quantisation
            x = base[i % 6] / np.linalg.norm(base[i % 6])
            away = r.standard_normal(n)
            away -= (away @ x) * x
            v.append((len(v), [float(np.float32(e)) for e in x + away / np.linalg.norm(away) * math.tan(math.acos(0.95)) * r.uniform(0.3, 1.1)]))
    v += [(len(v) + i, v[i][1]) for i in range(5)]
    want = {i: {j for j, b in v if len(a) == len(b) and np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b) >= 0.95} - {i} for i, a in v}
    for block in (embeddings.BLOCK, 7):
        monkeypatch.setattr(embeddings, "BLOCK", block)
        got = {x.vec_id: x for x in embeddings.near_vectors(spark.createDataFrame(v, "vec_id long, embedding array<float>")).collect()}
        assert {i: x.n_links for i, x in got.items()} == {i: len(w) for i, w in want.items()}
        assert all(got[i].component_id == got[j].component_id <= i for i in want for j in want[i])


def test_error_bound():
    r = np.random.default_rng(2)
    a = r.standard_normal((300, 32))
    a[150:] = a[:150] + r.standard_normal((150, 32)) * 0.33
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    assert (embeddings.linked(a, a, 0.95) == (a @ a.T >= 0.95)).all()


def test_lm(spark, docs, none):
    got = lm.score_texts(docs, TEXT, P.PATTERN).collect()
    assert len(got) == len(odd_rows())
    counts = collections.Counter()
    for i, t, *_ in odd_rows():
        if i is None or zlib.crc32(str(i).encode()) % 7 != 2:
            counts.update([*(t or "").encode().lower().split(), 0])
    n, v = sum(counts.values()), len(counts)
    for r in got:
        t = next(t for i, t, *_ in odd_rows() if i == r.doc_id) or ""
        ws = [*t.encode().lower().split(), 0]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(ws), sum(counts[w] > 0 for w in ws), n)
        assert math.isclose(r.base_score, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws), rel_tol=1e-9) and r.score < 0
    assert lm.score_texts(none, TEXT, P.PATTERN).count() == 0


def test_lm_rounds_take_every_training_text_once(docs):
    for row in docs.select(lm.part_of("doc_id", "text").alias("part"), lm.held_out("doc_id").alias("out")).collect():
        assert row.part == lm.HELD_OUT if row.out else 0 <= row.part < lm.ROUNDS


def test_lm_words_keep_their_ids_in_any_company():
    coder = lm.subwords(TEXT, P.PATTERN)
    words = ["the", "a\xa0b", "\u3000x", "x\x1cy", "z\xa0", "\xa0\xa0", "'s", "é", "中文", "of"]
    for w in words:
        coder.forget()
        alone = coder.spelled(coder.places([w.encode()]))[0].tolist()
        coder.forget()
        ids, n = coder.spelled(coder.places([x.encode() for x in words]))
        at = words.index(w)
        assert ids[n[:at].sum() : n[: at + 1].sum()].tolist() == alone and coder.opens[alone[0]]


def test_lm_words():
    texts = ["  The cat\t\nsat ", None, "", " \x0b", "É\xa0x A\x1cb"]
    found, n = lm.words_of(texts)
    assert found == [b"the", b"cat", b"sat", "É\xa0x".encode(), "a\x1cb".encode()] and n.tolist() == [3, 0, 0, 0, 2]


def some_model(kind=np.float64):
    r = np.random.default_rng(1)
    w = {k: v.astype(kind) for k, v in lm.start_weights().items()}
    known = lm.Successors(np.ones(lm.KINDS**2), np.ones(lm.KINDS))
    stream = np.tile(r.integers(0, lm.KINDS - 1, 40), 30)
    return w, known, lm.Windows(stream, np.array([700, 1, 499]), 5, lm.OVERLAP)


def test_lm_windows_use_each_token_once():
    _, _, windows = some_model()
    x, y, use = windows.block(slice(None))
    assert use.sum() == 1200 and (y[use] == windows.y).all() and [x[windows.opens][i, 0] for i in range(3)] == [5, 5, 5]


def test_lm_probabilities_sum_to_one():
    w, known, windows = some_model()
    x, _, _ = windows.block(slice(0, 2))
    h = lm.hidden(w, x)[0][:1].repeat(lm.KINDS, axis=0)
    p = lm.log_probability(w, known, h, np.full(lm.KINDS, x[0, 0]), np.arange(lm.KINDS))
    assert math.isclose(np.exp(p).sum(), 1, rel_tol=1e-9)
    kinds = lm.Kinds(np.random.default_rng(2).integers(0, 9, 5000), np.arange(5000) % 3 == 0)
    assert np.allclose(np.bincount(kinds.of, np.exp(kinds.share), lm.KINDS), 1)


def test_lm_frequent_words_are_found_by_sums_as_by_bytes():
    r = np.random.default_rng(8)
    each = [r.integers(1, 9, n).astype(np.uint16) for n in [*r.integers(1, 5, 4000), 63, 64, 65, 66, 300, 300]]
    values = {w.tobytes(): -float(i) - 1 for i, w in enumerate(each) if i % 2}
    n = np.array([len(w) for w in each])
    found = lm.Frequent(values, 10).of(np.concatenate(each), np.cumsum(n) - n, 1.0)
    assert found.tolist() == [values.get(w.tobytes(), 1.0) for w in each] and (found == 1).any() and (found < 0).any()
    assert lm.Frequent({}, 10).of(each[0], np.zeros(1, np.int64), 1.0).tolist() == [1.0]


def test_lm_scores_as_a_plain_loop():
    """Whole texts through windows, attention and both softmaxes, token by token."""
    w, known, _ = some_model()
    r = np.random.default_rng(4)
    known = lm.Successors(r.integers(0, 9, lm.KINDS**2), r.integers(1, 9, lm.KINDS))
    kinds = lm.Kinds(r.integers(0, 50, 3000), np.arange(3000) % 2 == 0)
    n, first = np.array([1, 2, 15, 16, 17, 29, 30, 200]), 7
    ids = r.integers(0, 3000, n.sum()).astype(np.uint16)
    got, at = lm.score_ids(kinds, known, w, ids, n, first), 0
    for i, size in enumerate(n):
        y = [int(kinds.of[t]) for t in ids[at : at + size]]
        x, total, step = [first, *y[:-1]], 0.0, lm.WINDOW - lm.OVERLAP
        for j in range(size):
            start = 0 if j < lm.WINDOW else (j - lm.OVERLAP) // step * step
            seen = [w["embed"][x[k]] + w["place"][k - start] for k in range(start, j + 1)]
            e = [math.exp(min(30, max(-30, (seen[-1] @ w["look"]) @ s))) for s in seen]
            u = sum(b / sum(e) * s for b, s in zip(e, seen, strict=True)) @ w["mix"] + seen[-1]
            z = np.exp(u / (1 + np.abs(u)) @ w["out"])
            c, m = divmod(y[j], lm.MEMBERS)
            for p, part, k in ((known.classes[x[j]], z[: lm.CLASSES], c), (known.members[x[j] * lm.CLASSES + c], z[lm.CLASSES :], m)):
                total += math.log(part[k] * p[k] / (part * p).sum())
            total += kinds.share[ids[at + j]]
        assert math.isclose(got[i], total / math.log(10), rel_tol=1e-9)
        at += size


def test_lm_gradients_and_learning():
    w, known, windows = some_model()
    x, y, use = windows.block(slice(None))

    def loss(w=w):
        return -lm.log_probability(w, known, lm.hidden(w, x)[0][use.ravel()], x[use], y[use]).mean()

    g, by_place = lm.gradients(w, known, x, y, use)
    g["embed"] = lm.by_kind(x.ravel(), by_place)
    for k in w:
        at = np.unravel_index(np.abs(g[k]).argmax(), g[k].shape)
        w[k][at] += 1e-5
        up = loss()
        w[k][at] -= 2e-5
        down = loss()
        w[k][at] += 1e-5
        assert math.isclose((up - down) / 2e-5, g[k][at], rel_tol=1e-2, abs_tol=1e-6)
    single = {k: v.astype(np.float32) for k, v in w.items()}
    learner, before = lm.Learner(single, known, 0.02), loss()
    for _ in range(200):
        learner.step(x, y, use)
    assert loss(single) < 0.7 * before


def test_lm_learns_from_few_texts_what_successors_cannot_tell():
    """Each text has one of ten themes with 20 kinds each; every target but a text's first ones sees 8 places or more."""
    r = np.random.default_rng(6)

    def stream(texts):
        y = r.integers(0, 10, (texts, 1)) * 20 + r.integers(0, 20, (texts, 100))
        return lm.Windows(y.ravel(), np.full(texts, 100), 255, lm.OVERLAP)

    known = lm.Successors(np.ones(lm.KINDS**2), np.bincount(np.arange(200), minlength=lm.KINDS) * 1e4)
    learned, held = stream(1000), stream(50)
    learner, order = lm.Learner(lm.start_weights(), known, 0.02), r.permutation(len(learned))
    for i in range(0, len(order), lm.BATCH):
        learner.step(*learned.block(order[i : i + lm.BATCH]))
    learner.settle()
    x, y, use = held.block(slice(None))
    assert (held.opens | (use.argmax(1) >= 8)).all()
    loss = -lm.log_probability(learner.w, known, lm.hidden(learner.w, x)[0][use.ravel()], x[use], y[use]).mean()
    assert loss < 4.0


def test_lm_places_that_are_context_only_have_no_states():
    w, _, windows = some_model()
    x, _, _ = windows.block(slice(None))
    whole = lm.hidden(w, x)[0].reshape(len(x), lm.WINDOW, lm.WIDTH)
    for skip in (0, 1, lm.OVERLAP):
        part = lm.hidden(w, x, skip=skip)
        assert part[2].shape == (len(x), lm.WINDOW - skip, lm.WINDOW)
        assert np.allclose(part[0].reshape(len(x), -1, lm.WIDTH), whole[:, skip:], rtol=1e-12, atol=1e-12)


def test_lm_attention_logits_beyond_the_limit_are_held():
    w, _, windows = some_model()
    x, _, _ = windows.block(slice(0, 3))
    w["embed"] *= 300
    e = w["embed"][x] + w["place"]
    a = np.exp(np.clip((e @ w["look"]) @ e.transpose(0, 2, 1), -lm.LIMIT, lm.LIMIT)) * np.tril(np.ones((lm.WINDOW, lm.WINDOW)))
    u = (a / a.sum(2, keepdims=True)) @ e @ w["mix"] + e
    assert np.allclose(lm.hidden(w, x)[0].reshape(u.shape), u / (1 + np.abs(u)), rtol=1e-9)


def test_lm_held_changes_are_those_of_all_batches_whatever_their_sizes(monkeypatch):
    w, known, windows = some_model(np.float32)
    learner, seen, plain = lm.Learner(w, known, 0.02), [], lm.by_kind
    monkeypatch.setattr(lm, "by_kind", lambda x, d: seen.append((x.copy(), d.copy())) or plain(x, d))
    before, want = w["embed"].copy(), []
    for low, high in ((0, 3), (3, 13), (13, 14), (14, 20), (20, 22)):
        x, y, use = windows.block(slice(low, high))
        want.append((x.ravel(), lm.gradients(w, known, x, y, use)[1]))
        learner.step(x, y, use)
    learner.settle()
    for got, each in zip(seen, (want[: lm.HOLD], want[lm.HOLD :]), strict=True):
        assert got[0].tolist() == np.concatenate([x for x, _ in each]).tolist()
        assert np.allclose(got[1], np.concatenate([d for _, d in each]), rtol=1e-4, atol=1e-7)
    assert (w["embed"] != before).any()


def test_lm_looks_up_each_different_word_once():
    class Counted(dict):
        n = 0

        def get(self, k, default=None):
            self.n += 1
            return super().get(k, default)

        def __getitem__(self, k):
            self.n += 1
            return super().__getitem__(k)

        def __contains__(self, k):
            self.n += 1
            return super().__contains__(k)

    coder = lm.subwords(TEXT, P.PATTERN)
    coder.forget()
    coder.index = Counted()
    for some in ([b"the", b"cat", b"the"], [b"a", b"the", b"dog", b"a"]):
        coder.index.n = 0
        places = coder.places(some)
        assert coder.index.n == len(set(some)) and [coder.index[w] for w in some] == places.tolist()
    assert coder.spelled(places)[0].tolist() == coder.of([b"a", b"the", b"dog", b"a"])[0].tolist()
    coder.forget()


def test_lm_beats_the_word_counts_on_held_out_texts(spark):
    """Texts of a few sentences' worth of words in fixed succession: context tells what counts cannot."""
    r = random.Random(5)
    pairs = [words(4, 500 + i) for i in range(20)]
    rows = spark.createDataFrame([(i, " ".join(r.choice(pairs) for _ in range(60))) for i in range(400)], "doc_id long, text string")
    got = [x for x in lm.score_texts(rows, TEXT, P.PATTERN).collect() if x.held_out]
    assert got and sum(x.score for x in got) > sum(x.base_score for x in got)


def grams_of(text):
    """Five-word shingles of lower-case letters and digits."""
    import regex

    ws = [w for w in regex.split(r"[^\p{L}\p{N}]+", (text or "").lower()) if w]
    return {tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))} if ws else set()


def test_licenses(spark, docs, none):
    bodies = list(license.TEMPLATES.items())
    rows = [(i, words(80, i) + "\n" + t + "\n" + words(50, i + 100)) for i, (_, t) in enumerate(bodies)] + [(99, None), (98, words(100, 7))]
    got = collections.defaultdict(set)
    for r in license.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got[r.doc_id].add(r.license)
    assert all(n in got[i] for i, (n, _) in enumerate(bodies)) and 98 not in got and 99 not in got
    # odd rows with two notices among them: as brute force over whole texts
    rows = [(r[0], r[1], r[4]) for r in odd_rows()] + [(500, "x " * 3000 + bodies[5][1] + " y" * 900, None), (500, "x " * 3000 + bodies[5][1] + " y" * 900, None), (501, bodies[3][1].upper(), None)]
    want = collections.Counter()
    for i, t, _ in rows:
        own = grams_of(t)
        for n, body in bodies:
            g = grams_of(body)
            if len(g & own) >= 0.8 * len(g):
                want[i, n] += 1
    got = collections.Counter((r.doc_id, r.license) for r in license.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string, license string")).collect())
    assert got == want and want[500, bodies[5][0]] == 2
    assert license.scan_licenses(none).count() == 0


def test_mixing(spark, none):
    rows, labels = [], []
    for i in range(300):
        kind = i % 3
        extra = ["", " | # |", " idiot worthless idiot"][kind]
        rows.append((i, words(40, i) + extra))
        labels.append((i, int(kind != 1), int(kind == 2)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame(labels[:200], "doc_id long, quality int, toxic int")
    want = {"good": 0.6, "poor": 0.3, "toxic": 0.1}
    got = mixing.mixing_rates(docs, marks, targets=want).collect()
    total = sum(r.n_words for r in got)
    for d, share in want.items():
        assert abs(sum(r.rate * r.n_words * r[f"p_{d}"] for r in got) / total - share) < 0.01
    right = sum(max(mixing.DOMAINS, key=lambda d: r[f"p_{d}"]) == ("good", "poor", "toxic")[r.doc_id % 3] for r in got if r.doc_id >= 200)
    assert right >= 90  # of 100 held out
    thin = mixing.mixing_rates(docs, marks, relative={"good": 1.0, "poor": 0.5, "toxic": 0.05}, most=1.0)
    left = [r.doc_id for r in mixing.draw(docs, thin).collect()]
    assert len(left) == len(set(left)) and sum(i % 3 == 0 for i in left) >= 95 and sum(i % 3 == 2 for i in left) < 30
    assert mixing.mixing_rates(none, marks.limit(0)).count() == 0


def least_squares(x, w, targets, most):
    """Misses of the best rates, by projected gradient run for long."""
    r = np.ones(len(x))
    for _ in range(20000):
        miss = (x * (w * r)[:, None]).sum(0) / w.sum() - targets
        r = np.clip(r - x @ miss, 0, most)
    return (x * (w * r)[:, None]).sum(0) / w.sum() - targets


@pytest.mark.parametrize(("targets", "most"), [((0.0, 0.2, 1.2), None), ((0.5, 0.1, 0.4), 1.0), ((0.3, 0.3, 0.3), None)])
def test_mixing_misses_are_least_squares(spark, targets, most):
    r = np.random.default_rng(7)
    p = (r.dirichlet([1, 1, 0.5], 40) * 1000).round().astype(int)
    p[:, 2] = 1000 - p[:, 0] - p[:, 1]
    n, copies = r.integers(1, 400, 40), r.integers(1, 3, 40)
    rows = [(int(i), int(i), int(c), int(m), *map(int, q)) for i, (m, c, q) in enumerate(zip(n, copies, p, strict=True))]
    members = spark.createDataFrame(rows, "id long, key long, copies long, n_words long, p0 long, p1 long, p2 long")
    steps = mixing.fit_rates(members, dict(zip(mixing.DOMAINS, targets, strict=True)), mixing.Tables(spark), most)
    rate = np.array([x[0] for x in members.orderBy("id").select(mixing.replay(steps, most)).collect()])
    w = (n * copies).astype(float)
    got = (p / 1000 * (w * rate)[:, None]).sum(0) / w.sum() - targets
    want = least_squares(p / 1000, w, np.array(targets), np.inf if most is None else most)
    assert (got**2).sum() <= (want**2).sum() + 2e-4 and rate.min() >= 0


def test_mixing_of_repeated_rows_and_clashing_names(spark):
    rows = [(i, words(30, i) + ["", " | # |", " idiot worthless"][i % 3], "x", 1) for i in range(90)]
    rows += [rows[2], rows[2], (None, None, None, 0), (200, "", "y", 0), (201, words(5000, 3), "y", 0)]
    kinds = "doc_id long, text string, domain string, l_id int"
    marks = spark.createDataFrame([(i, int(i % 3 != 1), int(i % 3 == 2)) for i in range(90)], "doc_id long, quality int, toxic int")
    many = {r.doc_id: r for r in mixing.mixing_rates(spark.createDataFrame(rows, kinds), marks, targets={"good": 0.6, "poor": 0.3, "toxic": 0.1}).collect()}
    assert len(many) == 93 and many[2].copies == 3 and many[5].copies == 1
    once = {r.doc_id: r for r in mixing.mixing_rates(spark.createDataFrame([r for i, r in enumerate(rows) if i not in (90, 91)], kinds), marks, targets={"good": 0.6, "poor": 0.3, "toxic": 0.1}).collect()}
    assert abs(many[2].p_toxic - once[2].p_toxic) < 0.1 and all(abs(r.p_good + r.p_poor + r.p_toxic - 1) < 1e-9 for r in many.values())
    tokens = sum(r.n_words * r.copies for r in many.values())
    for d, share in {"good": 0.6, "poor": 0.3, "toxic": 0.1}.items():
        assert abs(sum(r.rate * r.n_words * r.copies * r[f"p_{d}"] for r in many.values()) / tokens - share) < 1e-3


def without_repeated_windows(texts):
    """Texts in order of id without the lines that a later start of a three-line window covers."""
    seen, out = set(), {}
    for i in sorted(texts):
        lines = texts[i].split("\n")
        gone = set()
        for k in range(len(lines) - 2):
            window = tuple(lines[k : k + 3])
            if any(x.strip(" \t\n\r\x0b\x0c") for x in window):
                if window in seen:
                    gone |= {k, k + 1, k + 2}
                seen.add(window)
        out[i] = "\n".join(x for k, x in enumerate(lines) if k not in gone)
    return out


def test_pipeline_stages_against_brute_force(spark, tmp_path):
    """Planted junk, repeated windows, copies and near copies: each stage keeps what brute force keeps of its input."""
    import corpus_pipeline
    import tiktoken

    shared = "\n".join(words(12, 9000 + i) for i in range(4))
    texts = {i: words(90, 8000 + i) for i in range(60)}
    texts |= {60: texts[1], 61: texts[2].replace(" ", " new ", 1), 62: " ".join([*texts[3].split()[:45], "changed", *texts[3].split()[46:]])}
    texts |= {63: words(5, 1), 64: "ab cd ef gh ij " * 40, 65: " ".join(w + "###$$$" for w in words(90, 8065).split())}
    texts |= {66: texts[4] + "\n" + shared + "\n" + words(30, 8066), 67: texts[5] + "\n" + shared + "\n" + words(30, 8067), 68: ""}
    rows = [(i, t, "en", "web", len(t)) for i, t in texts.items()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    marks = spark.createDataFrame([(i, 1, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    marks.write.parquet(str(tmp_path / "labels.parquet"))

    kept = corpus_pipeline.quality_rules(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns
    first = {r.doc_id: r.text for r in kept.collect()}
    assert set(texts) - set(first) == {63, 64, 65, 68} and all(first[i] == texts[i] for i in first)

    cut = corpus_pipeline.line_dedup(spark, kept, str(tmp_path))
    second = {r.doc_id: r.text for r in cut.collect()}
    assert second == without_repeated_windows(first) and cut.columns == docs.columns and shared not in second[67]

    near = corpus_pipeline.near_dedup(spark, cut, str(tmp_path))
    third = {r.doc_id: r.text for r in near.collect()}
    ids = sorted(second)
    parts = reachable(shingle_sets([second[i] for i in ids]))
    assert set(third) == {ids[min(p)] for p in parts} and {60, 61, 62}.isdisjoint(third) and near.columns == docs.columns

    mixed = corpus_pipeline.mix(spark, near, str(tmp_path))
    fourth = {r.doc_id: r.text for r in mixed.collect()}
    assert mixed.count() == len(fourth) and set(fourth) <= set(third) and len(fourth) > 0.9 * len(third) and all(fourth[i] == third[i] for i in fourth)

    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(TEXT), special_tokens={})
    got = corpus_pipeline.encode(spark, mixed, str(tmp_path)).collect()
    assert {r.doc_id: list(r.ids) for r in got} == {i: lib.encode_ordinary(t) for i, t in fourth.items()}
    for r in got:
        assert r.n_tokens == len(r.ids) and r.ids_sha256 == hashlib.sha256(np.array(r.ids, "<u4").tobytes()).hexdigest() and r.decoded_sha256 == hashlib.sha256(fourth[r.doc_id].encode()).hexdigest()


def test_pipeline(spark):
    import corpus_pipeline

    d = "/root/testdata/sf0.001"
    got = corpus_pipeline.run(spark, d).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    assert len(got) == len({r.doc_id for r in got}) > 0.4 * len(texts)
    assert all(r.n_tokens > 0 for r in got)
