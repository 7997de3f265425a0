"""The training-data operators against brute force, and their defined cases."""
from __future__ import annotations

import collections
import hashlib
import html
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest

import corpus_pipeline
from geolattice.llm import chat, class_lm, decontaminate, groups, line_dedup, main_text, near_dups, order_minhash, packing, quality, queries, text as tx, url_rules

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, row int, key string, bucket string"


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t, None, None, None, 1, "k", "b") for i, t in texts], DOCS)


def edge_docs(spark):
    long = " ".join(f"word{i % 97}x{i % 13}" for i in range(30_000))
    texts = [(1, None), (2, ""), (None, "no name here at all"), (3, "same text in two rows of it"), (3, "same text in two rows of it"), (4, long), (5, long), (6, "ñ é\n\n \t 日本語 one line long enough here"),
             (7, "One line long enough HERE  \nb"), (8, "  one line long enough here\nc"), (9, "one line long enough here"), (10, "x")]
    return docs_of(spark, texts)


def words_of(t):
    return re.findall(r"(?:[a-z0-9]|[^\x00-\x7f])+", (t or "").lower())


def shingles_of(t):
    w = words_of(t)
    return collections.Counter(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else collections.Counter()


def table(spark, name):
    return {r[0]: r for r in spark.read.parquet(f"{SF}/{name}.parquet").collect()}


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, duck, name):
    from compare import compare
    n, told = compare(spark, duck, SF, name, queries.QUERIES[name], queries.ORACLES[name])
    assert n > 0 and told == ""


def test_word_hashes_do_not_depend_on_blocks(monkeypatch):
    texts = ["a bb  ccc", "", "dddd " * 500, "e" * 300, "x"]
    data, ends = tx.joined(texts)
    whole = tx.words(data, ends, ~tx.SPACE)
    monkeypatch.setattr(tx, "BLOCK", 64)
    parts = tx.words(data, ends, ~tx.SPACE)
    assert all((a == b).all() for a, b in zip(whole, parts))
    assert [texts[o][0:0] + bytes(data[a:b]).decode() for o, a, b in zip(*whole[1:])] == [w for t in texts for w in t.split()]
    by_word = collections.defaultdict(set)
    for h, a, b in zip(whole[0].tolist(), whole[2], whole[3]):
        by_word[bytes(data[a:b])].add(h)
    assert all(len(v) == 1 for v in by_word.values()) and len({next(iter(v)) for v in by_word.values()}) == len(by_word)


def test_class_lm_counts_and_probabilities(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = class_lm.fit(docs, exchange_words=200, endings=50, classes=8, head_words=300)    # most words take the join
    rows = class_lm.score(docs, model).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    split = lambda t: re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t)) + [None]
    count = collections.Counter(w for d, t in texts.items() if zlib.crc32(str(d).encode()) % 7 != 2 for w in split(t))
    n, v = sum(count.values()), len(count)
    for r in rows:
        w = split(texts[r.doc_id])
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(count[x] > 0 for x in w), n)
        assert r.base_score == pytest.approx(sum(math.log10((count[x] + 1) / (n + v + 1)) for x in w))
    out = [r for r in rows if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)
    # after every class the chances of all words sum to 1
    cells = model.cells()
    t = class_lm.tokens([" ".join(w for w in count if w)])
    keys, at = np.unique(t.word, return_index=True)
    classes = model.classes[class_lm.unit_of(t, model.common, model.unit, model.groups)][at]
    byte = {int(k): w for k, w in zip(t.word.tolist(), [*(w for w in count if w), None])}
    weights = np.array([count[byte[int(k)]] for k in keys])
    for b in range(cells.shape[0]):
        assert (weights * 10 ** cells[b, classes]).sum() + model.unknown() == pytest.approx(1, abs=1e-6)


def test_exchange_raises_the_objective_by_what_it_says():
    rng = np.random.default_rng(1)
    units, k = 12, 3
    pairs = rng.integers(0, 6, (units, units))
    classes = np.arange(units) % k
    def contexts(c):
        out = np.zeros((2, units, k), np.int64)
        for u, v in itertools.product(range(units), repeat=2):
            out[0, u, c[v]] += pairs[u, v]
            out[1, v, c[u]] += pairs[u, v]
        return out
    for u in range(units):
        got = class_lm.exchange(contexts(classes), classes, np.diag(pairs), np.array([u]))
        def value(b):
            c = classes.copy()
            c[u] = b
            return class_lm.objective(class_lm.transitions(contexts(c), c))
        assert value(got[u]) == pytest.approx(max(value(b) for b in range(k)))


def test_exchange_goes_on_until_neither_half_helps(spark, monkeypatch):
    rounds, true = [], class_lm.exchange

    def watched(contexts, classes, own, turn):
        rounds.append((class_lm.objective(class_lm.transitions(contexts, classes)), set(turn.tolist())))
        return true(contexts, classes, own, turn)
    monkeypatch.setattr(class_lm, "exchange", watched)
    model = class_lm.fit(spark.read.parquet(f"{SF}/documents.parquet"), exchange_words=200, endings=50, classes=8)
    end = class_lm.objective(model.table)
    assert [r[0] for r in rounds[-2:]] == [end, end]
    assert rounds[-1][1] | rounds[-2][1] == set(range(250))     # both halves were tried from the last classes
    # a first round that does not help ends nothing
    rounds.clear()
    monkeypatch.setattr(class_lm, "exchange", lambda contexts, classes, own, turn: np.zeros_like(classes) if len(turn) == 250 else watched(contexts, classes, own, turn))
    assert class_lm.objective(class_lm.fit(spark.read.parquet(f"{SF}/documents.parquet"), exchange_words=200, endings=50, classes=8).table) > rounds[0][0]


def test_packing(spark):
    import public_tokenizers
    from tokenizers import Tokenizer
    reader = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert 50256 in reader.encode("a<|endoftext|>b", add_special_tokens=False).ids
    odd = [(1, "a  b \n c\t d "), (2, " x"), (3, "  "), (4, "<|endoftext|> it's  ok\n\n a b"), (5, "　 a\xa0 b"), (6, None), (7, "日本語 1234 !!"), (8, "z" * 9000), (None, "none"), (7, "again"), (9, "a<|endoftext|>b <|endoftext|><|endoftext|>  c")]
    docs = spark.read.parquet(f"{SF}/documents.parquet").selectExpr("doc_id + 100 as doc_id", "text").unionByName(spark.createDataFrame(odd, "doc_id long, text string"))
    want = collections.Counter((r.doc_id, tuple(reader.encode(r.text or "", add_special_tokens=False).ids + [1])) for r in docs.collect())
    pieces = packing.pack(docs).collect()
    sequences, made = collections.defaultdict(list), collections.defaultdict(list)
    for p in pieces:
        assert len(p.ids) == 4 * p.length > 0
        sequences[p.sequence_id].append(p)
        made[p.doc_id, p.doc_tokens].append(p)
    for s in sequences.values():
        at = 0
        for p in sorted(s, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 2048
    for (doc, n), parts in made.items():
        texts = [ids for (d, ids), m in want.items() for _ in range(m) if d == doc and len(ids) == n]
        if len(texts) == 1:
            assert np.frombuffer(b"".join(p.ids for p in sorted(parts, key=lambda p: p.start)), "<u4").tolist() == list(texts[0])
    assert sum(p.length for p in pieces) == sum(len(ids) * m for (_, ids), m in want.items())


def test_packing_cuts_cost_least():
    def brute(pos, pen, size, hard):
        f = [0.0] + [1e18] * (len(pos) - 1)
        for j in range(1, len(pos)):
            for i in range(j):
                n = pos[j] - pos[i]
                if n <= 2 * size:
                    f[j] = min(f[j], f[i] + pen[j] + (size - n if n <= size else 2 * size - n + hard))
        return f[-1]
    for seed in range(200):
        rng = random.Random(seed)
        size = rng.choice([4, 8, 16])
        pos = list(itertools.accumulate([0] + [rng.randint(1, size) for _ in range(rng.randint(1, 30))]))
        pen = [0] + [rng.choice([0, 1, 3]) for _ in pos[1:]]
        cuts = packing.windows(np.array(pos), np.array(pen, float), size, 5.0)
        at = dict(zip(pos, pen))
        cost = sum(size - (b - a) + at.get(b, 5.0) for a, b in zip([0, *cuts], cuts))
        assert max(b - a for a, b in zip([0, *cuts], cuts)) <= size and cost <= brute(pos, pen, size, 5.0)


def test_line_dedup_defined_cases(spark):
    rows = {(r.doc_id, r["row"].text): r for r in line_dedup.line_dedup(edge_docs(spark)).collect()}
    assert rows[1, None].n_lines == 1 and rows[1, None].text == "" and rows[2, ""].n_dropped == 0
    assert rows[9, "one line long enough here"].n_dropped == 0 and rows[8, "  one line long enough here\nc"].text == "c"
    assert rows[7, "One line long enough HERE  \nb"].text == "b" and rows[7, "One line long enough HERE  \nb"]["row"].key == "k"
    assert line_dedup.line_dedup(edge_docs(spark)).count() == 12 and line_dedup.line_dedup(edge_docs(spark).limit(0)).count() == 0
    null_ids = docs_of(spark, [(None, "a line that is long enough\nx"), (None, "a line that is long enough"), (1, "a line that is long enough"), (2, "a line that is long enough")])
    assert sorted(r.text for r in line_dedup.line_dedup(null_ids).collect()) == ["", "", "a line that is long enough", "x"]


def test_decontamination_against_all_windows(spark):
    docs, items = table(spark, "documents"), table(spark, "benchmark")
    rng, extra = random.Random(4), []
    for k, i in enumerate(items):    # altered passages, some just over and some under the similarity
        w = items[i].text.split()
        for j in rng.sample(range(len(w)), min(len(w), k % 3)):
            w[j] = "qqq"
        extra.append((100_000 + k, "some words before it " + " ".join(w).upper() + " and some after it too"))
    frame = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame([*extra, (None, None), (100_999, "")], "doc_id long, text string"))
    got = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.find_leaks(frame, spark.read.parquet(f"{SF}/benchmark.parquet"), block_chars=2000).collect()}
    want = {}
    for d, t in [*((d, r.text) for d, r in docs.items()), *extra]:
        w = words_of(t)
        runs = [tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))]
        for i, r in items.items():
            s = shingles_of(r.text)
            n = min(sum(s.values()), len(runs))
            if not s.keys() & set(runs):
                continue
            best = max(sum((c & s).values()) / sum((c | s).values()) for c in (collections.Counter(runs[k:k + n]) for k in range(len(runs) - n + 1)))
            if best >= 0.8:
                want[d, i] = pytest.approx(best)
    assert got == want and len(want) > 3


def test_hamming_blocks_find_all_within_the_radius():
    rng = random.Random(2)
    index = decontaminate.build_index(list(range(50)), [" ".join(rng.choice("abcdefgh") * 3 + str(rng.randint(0, 9)) for _ in range(12)) for _ in range(50)])
    size = int(index.windows[0])
    prints = np.array([int(p) ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 30))) for p in index.prints], np.uint64)
    at, item = index.near(prints, size)
    want = {(i, j) for i in range(50) for j in range(50) if index.windows[j] == size and (int(prints[i]) ^ int(index.prints[j])).bit_count() <= index.radius}
    assert set(zip(at.tolist(), item.tolist())) == want


def test_order_minhash(spark):
    docs = edge_docs(spark).where("doc_id is not null").dropDuplicates(["doc_id"])
    for frame in (docs, spark.read.parquet(f"{SF}/documents.parquet"), docs.where("doc_id = 9")):
        texts = {r.doc_id: r.text or "" for r in frame.collect()}
        ids = sorted(texts, reverse=True)
        got = {r.doc_id: r for r in order_minhash.fingerprints(frame).collect()}
        assert sorted(got, reverse=True) == ids
        for k, d in enumerate(ids):
            t, following = texts[d], texts[ids[(k + 1) % len(ids)]]
            half = len(t) // 2
            e = t[:len(t) - half] + following[:half]
            assert got[d].edited_text == e and got[d].n_chars == len(t)
            assert got[d].fingerprint == order_minhash.written_out(order_minhash.fingerprint(t)) and got[d].edited_fingerprint == order_minhash.written_out(order_minhash.fingerprint(e))
            assert 0 <= got[d].near_next <= 1 and (got[d].near_next == 1 or t != following)
    assert order_minhash.fingerprints(docs.limit(0)).count() == 0 and order_minhash.fingerprints(edge_docs(spark)).count() == 12


def test_order_minhash_follows_edits_and_order():
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(300)]
    base = " ".join(words)
    own = order_minhash.fingerprint(base)
    def near(t):
        return order_minhash.likeness(own, order_minhash.fingerprint(t))
    few, many = words[:], words[:]
    few[10] = few[200] = "zzzzzz"
    for i in range(0, 300, 4):
        many[i] = "yyyyyy"
    moved = words[150:] + words[:150]
    assert near(base) == 1 > near(" ".join(few)) > near(" ".join(many)) and near(" ".join(few)) > near(" ".join(moved))


def test_order_minhash_ranks_all_kmers():
    rng = random.Random(9)
    longs = ["".join(rng.choices("abcdefghij ", k=6000)) for _ in range(30)]
    # the first half of a text holds half of its k-mers, so an order's least is among them with chance 1/2, its two least with 1/4
    for size, want in ((1, 0.5), (2, 0.25)):
        whole, half = order_minhash.fingerprints_of(longs, size=size), order_minhash.fingerprints_of([t[:3000] for t in longs], size=size)
        assert order_minhash.likeness(whole, half) == pytest.approx(want, abs=0.05)
    # every order ranks every k-mer: the process of each key, run until it has met all orders
    texts = ["abcdefg", "abcabcabcabcabc", longs[0][:400], "x", "", "e" * 300, longs[1]]
    keys, many = order_minhash.numbered(texts, 6)
    assert len(set(keys[:many[0] + many[1]].tolist())) == many[0] + many[1]
    owner = np.repeat(np.arange(len(texts)), many)
    got = order_minhash._least(keys, owner, many, np.flatnonzero((many > 2) & (many < 1000)), 8, 2)
    for i in (1, 2, 5):
        rank = np.full((8, len(keys)), np.inf)
        for p in np.flatnonzero(owner == i):
            state, time = keys[p:p + 1], 0.0
            while np.isinf(rank[:, p]).any():
                state = tx.mix(state + np.uint64(0x9E3779B97F4A7C15))
                x = int(state[0])
                time -= math.log(((x >> 16) + 1) * 2.0 ** -48) / 8
                order = (x & 0xFFFF) * 8 >> 16
                rank[order, p] = min(rank[order, p], time)
        assert (np.sort(np.argsort(rank, axis=1)[:, :2], axis=1) == got[i]).all()
    assert all((a == order_minhash.fingerprint(t)).all() for a, t in zip(order_minhash.fingerprints_of(texts), texts))


def test_chat(spark):
    rows = [(1, 1, "user", "a </s> [INST] \\ b"), (1, 2, "assistant", "<\\/s>"), (1, 0, "system", "<<SYS>> x <"), (1, 3, "user", None), (2, 0, "user", "only"), (3, 0, "assistant", ""), (3, None, "assistant", "<"),
            (4, 0, None, "who"), (4, 1, "to</s>ol", "/s> [\\/INST] <s>"), (4, 1, "to</s>ol", "/s> [\\/INST] <s>"), (None, 0, "assistant", "日本")]
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, example int, formatted string")
    examples = chat.expand(frame)
    by = collections.defaultdict(list)
    for r in examples.collect():
        by[r.conv_id].append(r)
    back = {r.conv_id: r for r in chat.read_back(examples).collect()}
    for conv in {r[0] for r in rows}:
        turns = sorted(((r[1] if r[1] is not None else -1, r[2] or "", r[3] or "") for r in rows if r[0] == conv))
        assert back[conv].n_turns == len(turns) and back[conv].turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for _, a, b in turns).encode()).hexdigest()
        loss = "".join(b for _, a, b in turns if a == "assistant")
        assert back[conv].loss_chars == len(loss) and back[conv].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        trained = [e for e in by[conv] if e.loss_end > e.loss_start or e.n_turns and turns[e.n_turns - 1][1] == "assistant"]
        assert len(trained) == sum(a == "assistant" for _, a, _ in turns) and back[conv].formatted_chars == sum(len(e.formatted) for e in by[conv])
    first = min(by[1], key=lambda e: e.example)
    assert first.formatted[first.loss_start:] == "<\\\\/s></s>" and first.formatted.count("</s>") == 1
    assert chat.read_back(chat.expand(frame.limit(0))).count() == 0


def test_near_duplicates_against_all_pairs(spark):
    docs = {d: r.text for d, r in table(spark, "documents").items()}
    rng = random.Random(8)
    base = ["".join(rng.choice("abcdef") for _ in range(5)) for _ in range(150)]
    for k in range(60):      # a group of near copies
        w = base[:]
        w[rng.randrange(150)] = f"new{k}"
        docs[50_000 + k] = " ".join(w)
    for k in range(80):      # a shared passage, else different
        docs[60_000 + k] = " ".join(base[:60] + ["".join(rng.choice("ghijkl") for _ in range(5)) for _ in range(90)])
    frame = spark.createDataFrame([*docs.items(), (None, "x y z"), (70_000, None), (70_001, ""), (70_001, "")], "doc_id long, text string").selectExpr("*", "1 as k1", "'b' as bucket", "2 as root")
    rows = near_dups.near_duplicates(frame).collect()
    group, kind = {r.doc_id: r.class_id for r in rows}, {r.doc_id: r.copy_id for r in rows}
    assert len(rows) == len(group) == len(docs) + 2 and group[70_000] == group[70_001] == 70_000
    sets = {d: shingles_of(t) for d, t in docs.items()}
    root = {d: d for d in docs}
    def top(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in itertools.combinations(sorted(docs), 2):
        x, y = sets[a], sets[b]
        if 2 * len(x.keys() & y.keys()) < min(len(x), len(y)) or top(a) == top(b):
            continue
        similar = sum(1 / sum(max(x[j] / x[i], y[j] / y[i]) for j in x.keys() | y.keys()) for i in x.keys() & y.keys())
        if similar >= 0.8:
            p, q = sorted((top(a), top(b)))
            root[q] = p
    assert {d: group[d] for d in docs if sets[d]} == {d: top(d) for d in docs if sets[d]}
    assert all((words_of(docs[a]) == words_of(docs[kind[a]])) for a in docs)
    assert near_dups.near_duplicates(frame.limit(0)).count() == 0


def test_probminhash_estimates_probability_jaccard():
    rng = np.random.default_rng(3)
    a = np.arange(60, dtype=np.uint64)
    x, y = rng.integers(1, 5, 60), rng.integers(1, 5, 60)
    left, right = a[:50], a[10:]
    own = np.concatenate([np.zeros(50, np.int64), np.ones(50, np.int64)])
    sig = near_dups.signatures(own, tx.mix(np.concatenate([left, right])), np.concatenate([x[:50], y[10:]]), 2, 4096)
    xs, ys = dict(zip(left.tolist(), x[:50].tolist())), dict(zip(right.tolist(), y[10:].tolist()))
    want = sum(1 / sum(max(xs.get(j, 0) / xs[i], ys.get(j, 0) / ys[i]) for j in range(60)) for i in range(10, 50))
    assert near_dups.probability_jaccard(left, x[:50], right, y[10:]) == pytest.approx(want)
    assert (sig[0] == sig[1]).mean() == pytest.approx(want, abs=0.03)


def test_groups_of_a_long_chain(spark):
    n = 400
    order = list(range(n))
    random.Random(1).shuffle(order)
    edges = [*zip(order, order[1:]), (1000, 1001), (1002, 1001), (7, 7)]
    got = {r.node: r.root for r in groups.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(n)}, 1000: 1000, 1001: 1000, 1002: 1000}


def test_quality_threshold_covers_all_labels(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    label = {r.doc_id: r.quality for r in labels.collect()}
    known = [(r.text, label[r.doc_id]) for r in docs.collect() if r.doc_id in label and zlib.crc32(str(r.doc_id).encode()) % 3 != 1]
    y = np.array([v for _, v in known])
    ranker = quality.learn(docs, labels, sample=len(known) // 4)
    assert ranker.weights.any()
    strength = np.sort(ranker.strength(quality.features([t for t, _ in known])))
    level = (y == 0).mean()
    want = np.mean([strength[math.ceil(q * len(strength)) - 1] for q in quality.around(level)])
    assert ranker.threshold == pytest.approx(want)


def test_quality_on_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    marked = {r.doc_id: r.quality for r in labels.collect()}
    rows = quality.score_quality(docs, quality.learn(docs, labels)).collect()
    seen = [r for r in rows if r.doc_id in marked and zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert sum(r.predicted == marked[r.doc_id] for r in seen) > 0.98 * len(seen) and all((r.score >= 0.5) == r.predicted for r in rows)
    odd = labels.limit(0).unionByName(spark.createDataFrame([(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int"))
    blank = quality.score_quality(edge_docs(spark), quality.learn(docs, odd), carry=True)
    assert {r.score for r in blank.collect()} == {0.5} and blank.select("row.*").columns == edge_docs(spark).columns
    assert quality.score_quality(docs.limit(0), quality.learn(docs.limit(0), labels)).count() == 0


def test_main_text(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    def truth(x):
        inner = x[x.find("<article>") + 9:x.find("</article>")]
        parts = [" ".join(html.unescape(re.sub("<[^>]*>", " ", p)).split()) for p in re.split("<p>|</p>|<h1>|</h1>", inner)]
        return "\n\n".join(p for p in parts if p)
    rows = {r.page_id: r for r in main_text.main_text(pages).collect()}
    raw = {r.page_id: r.html for r in pages.collect()}
    assert sum(rows[i].text == truth(raw[i]) for i in raw) >= 0.99 * len(raw)
    rng = random.Random(77)
    other = [x for i in raw for x in rows[i].text.split("\n\n")]
    model = main_text.train(sorted(raw.values())[:120])
    hits = 0
    for i in sorted(raw)[150:]:     # pages set anew, not seen in training
        page = main_text._drawn(rng, rows[i].text.split("\n\n"), other)
        parsed = main_text.parse(page)
        hits += main_text.extract([page], model)[0] == main_text.block_text(parsed, main_text.weak_labels(parsed))
    assert hits >= 0.9 * 100
    odd = spark.createDataFrame([(1, "u", None, "t"), (2, None, "", "t"), (3, "u", "just &lt;text&gt;  here", "t"), (4, "u", "<p>a<p>b<div>unclosed <b", "t"), (None, "u", "<script>x</p>", "t")], "page_id long, url string, html string, text string")
    got = {r.page_id: r.text for r in main_text.main_text(odd).collect()}
    assert got[1] == got[2] == got[None] == "" and main_text.main_text(odd.limit(0)).count() == 0


def test_decoding_takes_the_likeliest_consistent_choice():
    for seed in range(200):
        rng = np.random.default_rng(seed)
        n = int(rng.integers(2, 9))
        parent = [-1] + [int(rng.integers(0, i)) for i in range(1, n)]
        odds = rng.normal(0, 2, n)
        value = lambda k: sum(-np.logaddexp(0, -odds[i]) if k[i] else -np.logaddexp(0, odds[i]) for i in range(1, n))
        legal = [k for k in itertools.product([False, True], repeat=n) if k[0] and all(k[parent[i]] or not k[i] for i in range(1, n))]
        assert value(main_text.decode(parent, odds)) == pytest.approx(max(map(value, legal)))


def test_url_verdicts(spark):
    page = lambda *hosts: "".join(f'<a href="https://{h}/x">l</a>' for h in hosts) + '<a href="/own">o</a>'
    rows = [(1, "https://a.org/x", page("n1.net", "n1.net", "n3.net")), (2, "http://b.com/de/1", page("n3.net")), (3, "http://N1.net/p?q", page("n2.net")), (4, "http://n2.net", page()), (5, "https://n3.net/#f", page("b.com")), (6, "ftp://n4.net/z", page("n3.net")),
            (7, None, None), (8, "no host", page("b.com")), (9, "http://example.org/es/1", None), (10, "http://www.example.org/en/12", None), (11, "http://xexample.org/en/12", None), (12, "http://b.com/fr/", None), (12, "http://b.com/fr/", None)]
    frame = spark.createDataFrame([(*r, 1, "h") for r in rows], "page_id long, url string, html string, rule int, host string")
    got = {r.page_id: r for r in url_rules.judge_urls(frame).collect()}
    assert [got[i].rule for i in (1, 2, 9, 10, 11, 12)] == ["org/", "com/de/", "example.org/es/", "example.org/en/1", "org/", "com/fr/"]
    assert (got[3].host, got[3].path, got[4].path, got[5].path, got[7].host, got[8].host) == ("n1.net", "/p", "", "/", "", "")
    links = collections.Counter()
    for _, u, h in rows:
        src = (u or "").partition("://")[2].split("/")[0].split("?")[0].split("#")[0].lower()
        for d in re.findall(r'href="https://([^/]*)', h or ""):
            if src and src != d:
                links[src, d] += 1
    def rank(edges, seeds):
        out = collections.Counter()
        for (a, _), n in edges.items():
            out[a] += n
        start = {h: w / sum(seeds.values()) for h, w in seeds.items()}
        r = dict(start)
        for _ in range(200):
            new = collections.Counter()
            for (a, b), n in edges.items():
                new[b] += 0.85 * r.get(a, 0) * n / out[a]
            back = 1 - sum(new.values())
            for h, s in start.items():
                new[h] += back * s
            r = new
        return r
    allow, block = collections.Counter(), collections.Counter()
    for r in (x for i, x in got.items() for _ in range(2 if i == 12 else 1)):
        if r.rule:
            (allow if r.verdict == "allow" else block)[r.host] += 1
    trust, distrust = rank(links, allow), rank({(b, a): n for (a, b), n in links.items()}, block)
    for r in got.values():
        assert r.trust == pytest.approx(trust.get(r.host, 0), abs=1e-6) and r.distrust == pytest.approx(distrust.get(r.host, 0), abs=1e-6)
        if not r.rule:
            assert r.verdict == ("block" if distrust.get(r.host, 0) > trust.get(r.host, 0) else "allow")
    assert {got[3].verdict, got[4].verdict} == {"allow"} and got[6].verdict == "block"
    assert url_rules.judge_urls(frame.limit(0)).count() == 0


def test_pipeline_stages_keep_columns_and_take_odd_rows(spark, tmp_path):
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    for k, frame in enumerate((edge_docs(spark), edge_docs(spark).limit(0), spark.read.parquet(f"{SF}/documents.parquet"))):
        docs = frame
        for j, (_, stage) in enumerate(corpus_pipeline.STAGES):
            made = stage(spark, docs, str(tmp_path))
            if j < len(corpus_pipeline.STAGES) - 1:
                assert made.columns == frame.columns
            path = f"{tmp_path}/{k}-{j}"
            made.write.parquet(path)
            docs = spark.read.parquet(path)
        assert docs.count() >= 0 and "sequence_id" in docs.columns


def test_pipeline_drops_what_its_stages_name(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    good = corpus_pipeline.good_documents(spark, docs, sf).cache()
    marked = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    kept = {r.doc_id for r in good.select("doc_id").collect()}
    assert sum((d in kept) == bool(q) for d, q in marked.items()) > 0.98 * len(marked)
    one = corpus_pipeline.one_of_each_group(spark, docs, sf)
    groups_ = near_dups.near_duplicates(docs).select("class_id").distinct().count()
    assert one.count() == groups_ and one.select("text").distinct().count() == one.count()
    leaks = {r.doc_id for r in decontaminate.find_leaks(docs, spark.read.parquet(f"{sf}/benchmark.parquet")).collect()}
    assert leaks and {r.doc_id for r in corpus_pipeline.without_leaks(spark, docs, sf).select("doc_id").collect()} == {r.doc_id for r in docs.select("doc_id").collect()} - leaks


def test_only_what_is_never_shown_is_left_out_before_the_trees():
    said = lambda h: "".join(p[2] for p in main_text.parse(h).pieces)
    assert said("<p>a <math>x+1</math> b <noscript>img</noscript> c<object>alt words</object>.</p>") == "a x+1 b img calt words."
    assert said("<p>a<script>var x</script><style>p {}</style><textarea>typed</textarea> b</p>") == "a b"
    assert said("<html><head><title>x</title><p>Hello world</p></html>") == "Hello world"
    assert said("<head>Text at once</head> more") == "Text at once more"
    assert said("<head><meta a=b><link x><title>t</title></head><body>ok</body>") == "ok"
