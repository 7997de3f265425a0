"""Host rules, token links and whitening against brute force, and their defined cases."""
from __future__ import annotations

import collections
import hashlib
import json
import math
import random
import re
from fractions import Fraction

import numpy as np
import pytest

from geolattice.llm import host_rules, queries, token_links, whitening

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, host string, n_words string, kept int"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, None, s, "h", "clash", 1) for i, t, s in rows], DOCS)


def odd_texts():
    return [None, "", "   \n\t ", "a b c a b c a b c", "x x x x x", "a#b *$% <|> \n\nsame line\nsame line\n same line\nsame line\n \n \n", "ñ é 日本語 \x0b one\x0ctwo", "w " * 60,
            " ".join(f"word{i % 97}x{i % 13}" for i in range(30_000)), "a\xa0b c　d", "one two", "q w e r t q w e"]


def counts_of(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    windows = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    often = collections.Counter(windows)
    covered = {i + j for i, x in enumerate(windows) if often[x] > 1 for j in range(3)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines), len(lines) - len(set(lines)), len(covered)


def test_host_rules_brute_force(spark):
    random.seed(3)
    bad = "buy now " * 40
    good = lambda: " ".join(random.choice("abcdefghijklmnopqrstuvwxyz") * random.randint(1, 9) + str(random.randint(0, 999)) for _ in range(80))
    rows = [(i, t, "odd") for i, t in enumerate(odd_texts())] + [(None, good(), None), (1, bad, None), (1, bad, None)]
    rows += [(100 + i, good(), f"h{i % 7}") for i in range(70)] + [(200 + i, bad if i % 5 else good(), "junk") for i in range(40)]
    rows += [(300, bad, "one bad"), (301, good(), "one good")]
    got = host_rules.judge_hosts(docs_of(spark, rows)).collect()
    assert len(got) == len(rows)
    key = lambda r: (r.doc_id, r.host, r.n_words, r.word_chars, r.n_symbols, r.n_lines, r.n_dup_lines, r.n_repeat_words)
    assert collections.Counter(map(key, got)) == collections.Counter((i, s, *counts_of(t)) for i, t, s in rows)

    def fails(t):
        n, _, signs, lines, dup, rep = counts_of(t)
        return {"short": n < 50, "repeats": 100 * rep > 50 * n, "symbols": 10 * signs > n, "lines": 10 * dup > 3 * lines}
    hosts = collections.defaultdict(list)
    for i, t, s in rows:
        if s is not None:
            hosts[s].append(fails(t))
    blocked, rates = set(), {}
    for rule in host_rules.RULES:
        f = {h: (sum(x[rule] for x in v), len(v)) for h, v in hosts.items()}
        mean = sum(a / n for a, n in f.values()) / len(f)
        many = [(a, n) for a, n in f.values() if n > 1]
        spread = sum(a * (a - 1) / (n * (n - 1)) for a, n in many) / len(many) - mean * mean
        weight = max(0, mean * (1 - mean) / spread - 1) if spread > 0 else None
        for h, (a, n) in f.items():
            rates[h, rule] = mean if weight is None else (a + mean * weight) / (n + weight)
            if rates[h, rule] > 0.5:
                blocked.add(h)
    made = {(r.host, rule): r[f"rate_{rule}"] for r in host_rules.host_rates(host_rules.document_measures(docs_of(spark, rows))).collect() for rule in host_rules.RULES}
    assert made == pytest.approx(rates, abs=1e-6)
    assert "junk" in blocked and "h1" not in blocked
    for r in got:
        assert r.host_blocked == (r.host in blocked)
        assert r.kept == (not r.base_failed and not r.host_blocked)
        assert r.base_failed == (r.n_words < 50 or 2 * r.n_repeat_words > r.n_words)


def test_host_rules_defined_cases(spark):
    assert host_rules.judge_hosts(docs_of(spark, [])).count() == 0
    one = host_rules.judge_hosts(docs_of(spark, [(1, None, "a"), (2, " ".join(map(str, range(90))), None)])).orderBy("doc_id").collect()
    assert [(r.base_failed, r.host_blocked, r.kept) for r in one] == [(True, True, False), (False, False, True)]
    # hosts of one row each share one rate: one in three fails, so none is blocked
    alone = host_rules.judge_hosts(docs_of(spark, [(1, "x", "a"), (2, " ".join(map(str, range(90))), "b"), (3, " ".join(map(str, range(80))), "c")]))
    assert sorted((r.doc_id, r.kept) for r in alone.collect()) == [(1, False), (2, True), (3, True)]


def test_host_rules_runs_no_python(spark):
    plan = queries.op11_host_rules(spark, SF)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_token_links_brute_force(spark):
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer
    reader = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    reader.encode_special_tokens = True
    pieces = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    letters = token_links._byte_letters()
    plain = {i: bytes(letters[c] for c in t) for t, i in json.load(open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8"))["model"]["vocab"].items() if all(c in letters for c in t)}

    def piece(i):
        p = pieces.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if re.fullmatch(r"<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode()
    odd = [None, "", " ", "<|endoftext|> <s> </s> <0x41>", "a▁b", "日本語 ñ  \n\t x", "\x00 nul", "ok " * 500, "z" * 5000, " lead", "🙂🙂 ok", "é ﬁ Ⅷ"]
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()] + [(i, t) for i, t in enumerate(odd)] + [(None, "ok ok"), (7, "again")]
    corpus, made = collections.Counter(), []
    for i, t in rows:
        a = reader.encode(" " + t, add_special_tokens=False).ids if t else []
        b = pieces.encode(t) if t else []
        want = (" " + (t or "")).encode()
        if b"".join(plain[x] for x in a) != want or b"".join(map(piece, b)) != want:
            a = b = []
        ends = lambda ids, f: [sum(len(f(x)) for x in ids[:0])] if not ids else np.cumsum([len(f(x)) for x in ids]).tolist()
        ea, eb = (ends(a, plain.get), ends(b, piece)) if a else ([], [])
        cuts = sorted(set(ea) & set(eb))
        groups, links, i0, j0 = [], [], 0, 0
        for c in cuts:
            i1, j1 = ea.index(c, i0) + 1, eb.index(c, j0) + 1
            groups.append(",".join(map(str, a[i0:i1])) + "|" + ",".join(map(str, b[j0:j1])))
            links.append((a[i1 - 1], b[j1 - 1]))
            i0, j0 = i1, j1
        corpus.update(links)
        made.append((i, len(a), len(b), groups, links))
    best = collections.Counter()
    for (_, b), n in corpus.items():
        best[b] = max(best[b], n)
    want = collections.Counter((i, na, nb, len(g), len(k), sum(corpus[x] == best[x[1]] for x in k), sum(corpus[x] for x in k),
                                hashlib.sha256(";".join(g).encode()).hexdigest() if g else "") for i, na, nb, g, k in made)
    docs = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], "doc_id long, text string, n_a string, count_sum int").repartition(9)
    got = token_links.align_documents(docs)
    assert collections.Counter(tuple(r) for r in got.collect()) == want
    assert sum(x[1] > 0 for x in want) > 100
    assert token_links.align_documents(docs.where("false")).count() == 0
    assert [r.n_a for r in token_links.align_documents(docs.where("text = ''")).collect()] == [0]


def test_perfect_hash():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 3, 1000, 200_000):
        keys = np.unique(rng.integers(-2 ** 62, 2 ** 62, n))
        table = token_links.PerfectHash(keys)
        assert sorted(table.find(keys).tolist()) == list(range(len(keys)))
        other = np.setdiff1d(rng.integers(-2 ** 62, 2 ** 62, 1000), keys)
        assert (table.find(other) == -1).all()


def test_tree_of_sums(spark, monkeypatch):
    monkeypatch.setattr(token_links, "FAN", 2)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    wide = token_links.align_documents(docs.repartition(13)).orderBy("doc_id", "n_a").collect()
    monkeypatch.undo()
    assert wide == token_links.align_documents(docs.coalesce(1)).orderBy("doc_id", "n_a").collect() and columns


def fit_list(vectors, scale=256):
    return np.array(sorted({tuple(math.floor(float(np.float32(c)) * scale) for c in v) for v in vectors}), object)


def checked(rows, vectors, tolerance=1e-9):
    """Rows of whitening against exact deviations and numpy's eigenvectors."""
    x = fit_list(vectors)
    n, s = len(x), x.sum(axis=0)
    y = (n * x - s).astype(float) / n
    cov = y.T @ y / n
    values, vecs = np.linalg.eigh(cov)
    values, vecs = values[::-1], vecs[:, ::-1]
    by = collections.defaultdict(list)
    for r in rows:
        by[r.component].append(r)
    for k, part in by.items():
        assert [r.explained for r in part] == pytest.approx([values[k - 1] / np.trace(cov)] * len(part), rel=tolerance)
        assert len(part) == len(vectors) and all(r.n == n and r.identity_error < 1e-9 for r in part)
        want = [((np.array([math.floor(float(np.float32(c)) * 256) for c in vectors[r.vec_id]], object) * n - s) ** 2).sum() for r in part]
        assert [int(r.deviation) for r in part] == want
        if k < len(values) and min(abs(values[k - 1] - v) for i, v in enumerate(values) if i != k - 1) > 1e-6 * values[0]:
            z = np.array([[math.floor(float(np.float32(c)) * 256) for c in vectors[r.vec_id]] for r in part], float) - s.astype(float) / n
            want = z @ vecs[:, k - 1] / np.sqrt(values[k - 1])
            got = np.array([r.whitened for r in part])
            assert np.allclose(got, want, atol=1e-7) or np.allclose(got, -want, atol=1e-7)
    return by


VEC = "vec_id long, embedding array<float>, x int, n string, component double"


def frame(spark, vectors):
    return spark.createDataFrame([(i, v, 1, "n", 0.0) for i, v in enumerate(vectors)], VEC)


def test_whitening_brute_force(spark):
    given = [list(r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()]
    got = queries.op13_whitening(spark, SF).collect()
    ids = {r.vec_id: i for i, r in enumerate(spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect())}
    Row = collections.namedtuple("Row", "vec_id component n deviation whitened explained identity_error")
    assert len(checked([Row(ids[r.vec_id], r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in got], given)) == 4
    rng = np.random.default_rng(2)
    base = rng.normal(size=(60, 6)).astype(np.float32).tolist()
    assert len(checked(whitening.whiten_embeddings(frame(spark, base + base[:20] + [base[0]] * 50).repartition(7)).collect(), base + base[:20] + [base[0]] * 50)) == 4
    # entries of very different sizes, beyond machine numbers in the sums
    large = (rng.normal(size=(40, 5)) * [1e-2, 1, 1e6, 1e12, 1e3]).astype(np.float32).tolist()
    assert len(checked(whitening.whiten_embeddings(frame(spark, large)).collect(), large, 1e-6)) == 4


def test_whitening_equal_eigenvalues(spark):
    axes = [[(s if i == j else 0.0) for j in range(5)] for i in range(5) for s in (1.0, -1.0)]
    by = checked(whitening.whiten_embeddings(frame(spark, axes)).collect(), axes)
    assert len(by) == 4
    z = np.array([[r.whitened for r in sorted(by[k], key=lambda r: r.vec_id)] for k in (1, 2, 3, 4)])
    assert np.allclose(z @ z.T / len(axes), np.eye(4), atol=1e-12)


def test_whitening_defined_cases(spark):
    rows = [(1, [1.0, 2.0]), (2, None), (3, [1.0, None]), (4, [math.nan, 1.0]), (5, [math.inf, 1.0]), (None, [-0.001, 0.5]), (7, [1.0, 2.0]), (8, [0.25])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = whitening.whiten_embeddings(df).collect()
    assert collections.Counter(r.vec_id for r in got) == {1: 2, None: 2, 7: 2, 8: 2} and {r.n for r in got} == {3}
    assert whitening.quantised(df).where("vec_id is null").first().x == [-1, 128]
    assert whitening.quantised(df).where("vec_id = 8").first().x == [64, 0]
    assert whitening.whiten_embeddings(df.where("false")).count() == 0
    assert whitening.whiten_embeddings(df.where("vec_id in (1, 7)")).count() == 0      # no variance, no component
    assert whitening.whiten_embeddings(spark.createDataFrame([(1, []), (2, [])], "vec_id long, embedding array<float>")).count() == 0
    ends = whitening.quantised(spark.createDataFrame([(1, [3e38, -3e38])], "vec_id long, embedding array<float>")).first().x
    assert ends == [2 ** 63 - 1, -2 ** 63]
    far = whitening.whiten_embeddings(spark.createDataFrame([(1, [3e38, -3e38]), (2, [0.0, 0.0]), (3, [1.0, 3e38])], "vec_id long, embedding array<float>")).collect()
    assert len(far) == 6 and all(r.identity_error < 1e-6 for r in far)


def test_exact_steps(spark):
    rng = np.random.default_rng(5)
    x = rng.integers(-2 ** 62, 2 ** 62, (30, 4))
    x[0] = [-2 ** 63, 2 ** 63 - 1, 0, 1]
    assert (whitening.gram(x) == x.astype(object).T @ x.astype(object)).all()
    assert [p for p in range(2, 400) if whitening.is_prime(p)] == [p for p in range(2, 400) if all(p % k for k in range(2, p))]
    for p in whitening.primes(200):
        assert all(p % k for k in range(3, math.isqrt(p) + 1, 2))

    def leading(m):   # coefficients by the traces of powers (Faddeev and LeVerrier)
        d, c, k = len(m), [Fraction(1)], np.zeros((len(m), len(m)), object)
        for i in range(1, d + 1):
            k = m @ k + np.eye(d, dtype=int).astype(object) * c[-1]
            c.append(-Fraction(sum((m @ k).diagonal()), i))
        return [int(v) for v in c[::-1]]
    for d in (1, 2, 3, 7):
        half = rng.integers(-50, 50, (d, d + 1)).astype(object)
        m = half @ half.T
        assert whitening.characteristic(spark, m) == leading(m)
    sparse = np.array([[0, 0, 5], [0, 7, 0], [5, 0, 0]], object)       # a pivot of 0 has to be swapped
    for p in (101, 2 ** 31 - 1):
        assert whitening.charpoly_mod((sparse % p).astype(np.int64), p).tolist() == [v % p for v in leading(sparse)]
    # (t - 3)^2 (t - 8) t
    poly = [0, -72, 57, -14, 1]
    assert [whitening.roots_above(poly, a) for a in (-1, 0, 2, 3, 7, 8)] == [4, 3, 3, 1, 1, 0]
    roots = whitening.top_roots(poly, 4)
    assert [float(r) for r, _ in roots] == pytest.approx([8, 3, 3], rel=1e-30) and [g for _, g in roots] == [0, 1, 1]
    assert [float(r) for r, _ in whitening.top_roots([-6, 11, -6, 1], 2)] == pytest.approx([3, 2], rel=1e-30)
