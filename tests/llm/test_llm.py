"""Edge cases of every operator, and brute-force versions of what SQL cannot express."""

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from pagewright.llm import common, decontam, html, linededup, lm, mixing, neardup, quality, queries, rules, tokens, warc

SCHEMA = "doc_id long, text string, source string, size long, target double, score double, kept boolean, component_id long, __id long"
PROSE = "the quick brown fox jumps over the lazy dog while seven wise owls watch from a tall old oak tree near the river bank at dusk"
ROWS = [(1, PROSE), (2, PROSE), (3, PROSE.upper()), (4, PROSE + " today"), (5, None), (6, ""), (7, "  \n\t "), (None, PROSE), (8, "one two"), (8, "one two"), (9, "x " * 3000), (10, "é ü\nß  \n"), (11, "a " * 10 + PROSE)]
LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, None if i == 3 else f"s{(i or 0) % 3}", 1, 1.0, 1.0, True, 1, 1) for i, t in ROWS], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 1, 0), (4, 1, 0), (9, 0, 0), (8, 0, 1), (None, 1, 0), (11, None, 0)], LABELS)


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, PROSE), (2, None), (3, ""), (4, "one two"), (5, "no such words are in here at all")], "item_id long, text string")


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


OPERATORS = {
    "contaminated": lambda d, lab, b: decontam.contaminated(d, b), "decontaminated": lambda d, lab, b: decontam.decontaminated(d, b),
    "resample": lambda d, lab, b: quality.resample(d, lab), "good_documents": lambda d, lab, b: quality.good_documents(d, lab),
    "mix": lambda d, lab, b: mixing.mix(d), "mixed_documents": lambda d, lab, b: mixing.mixed_documents(d),
    "token_output": lambda d, lab, b: tokens.token_output(d, queries.tokenizer_path()), "score_documents": lambda d, lab, b: lm.score_documents(d),
    "judged": lambda d, lab, b: rules.judged(d, lab), "near_duplicates": lambda d, lab, b: neardup.near_duplicates(d), "deduplicated": lambda d, lab, b: neardup.deduplicated(d),
    "lines": lambda d, lab, b: linededup.deduplicated_lines(d, 3),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_edge_rows_and_empty_tables(docs, labels, bench, name):
    full = OPERATORS[name](docs, labels, bench)
    rows = full.collect()
    if name in ("resample", "mix", "token_output", "score_documents", "judged", "near_duplicates", "lines"):
        assert len(rows) == len(ROWS)
    if name in ("good_documents", "decontaminated", "deduplicated", "mixed_documents"):
        assert full.columns == docs.columns
    assert OPERATORS[name](docs.limit(0), labels, bench).count() == 0
    assert OPERATORS[name](docs, labels.limit(0), bench.limit(0)).count() >= 0


def test_leaks(docs, bench):
    got = {(r["doc_id"], r["item_id"], r["n_item"], r["n_common"]) for r in decontam.contaminated(docs, bench).collect()}
    n = len(PROSE.split()) - 4
    assert got == {(d, 1, n, n) for d in (1, 2, 3, 4, None, 11)} | {(8, 4, 1, 1)}


def test_leaks_by_brute_force(spark):
    """Containment of items of many sizes in longer documents, in one block and in several."""
    rng = np.random.default_rng(14)
    words = [f"w{i}" for i in range(3000)]
    items = [(i, " ".join(rng.choice(words, int(n)))) for i, n in enumerate(rng.choice([3, 5, 8, 20, 60, 200, 700], 40))]
    items.append((99, items[0][1]))
    docs = []
    for d in range(120):
        text = list(rng.choice(words, int(rng.integers(1, 400))))
        part = items[int(rng.integers(40))][1].split()
        part = [f"x{d}" if rng.random() < (0, 0.01, 0.04, 0.2)[d % 4] else w for w in part]
        docs.append((d, " ".join(text[: d % 50] + part + text[d % 50 :] if d % 7 else part)))
    sets = lambda t: {tuple(t.split()[i : i + 5]) for i in range(max(1, len(t.split()) - 4))}
    want = {(d, i, len(sets(x)), len(sets(x) & sets(t))) for d, t in docs for i, x in items if 100 * len(sets(x) & sets(t)) >= 80 * len(sets(x))}
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert len(want) > 20
    for chars in (decontam.BLOCK_CHARS, 5000):
        assert {tuple(r) for r in decontam.contaminated(*frames, block_chars=chars).collect()} == want


def test_near_duplicates_through_shared_edits(spark):
    """Chains of copies that are far from the group's centre and linked by edits they share."""
    words = [f"c{i}" for i in range(100)]
    rows = [(0, " ".join(words))]
    for i in range(1, 160):
        edited = list(words)
        for j in range(i % 8):
            edited[(7 + 13 * j + 5 * (i % 3)) % 100] = f"e{j}" if i % 5 else f"own{i}-{j}"
        if i % 11 == 0:
            edited = edited[: 88 + i % 7]
        rows.append((i, " ".join(edited)))
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in rows}
    of = {i: i for i in sets}
    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both) and of[a] != of[b]:
                low, high = sorted((of[a], of[b]))
                of = {k: low if v == high else v for k, v in of.items()}
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), percent=85).collect()}
    assert len(set(of.values())) > 3 and got == of


def test_signature_hits_are_exact_for_short_items():
    assert decontam.hits_needed(10, 80) == 8 and decontam.hits_needed(1, 80) == 1
    assert 1 <= decontam.hits_needed(400, 80) < 12


def test_near_duplicates_by_brute_force(spark):
    rng = np.random.default_rng(3)
    vocabulary = [f"w{i}" for i in range(400)]
    base = [list(rng.choice(vocabulary, 120)) for _ in range(6)]
    rows = []
    for i in range(150):
        words = list(base[i % 6])
        for _ in range(int(rng.integers(0, 6))):
            words[int(rng.integers(len(words)))] = f"edit{i}"
        rows.append((i * 3 % 151, " ".join(words)))
    sets = {d: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} for d, t in rows for w in [t.split()]}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 85).collect()}
    assert got == {d: find(d) for d in sets}


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 90), (90, 95)]
    got = dict(map(tuple, neardup.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert {got[i] for i in range(51)} == {0} and {got[i] for i in (90, 95, 100)} == {90}


def test_mix_meets_its_targets(spark):
    rng = np.random.default_rng(1)
    rows = [(i, "w " * int(rng.integers(1, 60)), f"s{min(i % 7, 3)}") for i in range(3000)]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    got = out.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.first("source_size").alias("size"), F.sum("size").alias("check")).collect()
    assert abs(sum(r["target"] for r in got) - sum(r["size"] for r in got)) < 1e-6
    for r in got:
        assert r["size"] == r["check"] and r["target"] <= 3 * r["size"] and abs(r["taken"] - r["target"]) <= 30
    assert out.filter("taken > 3 * size").isEmpty()
    assert sorted(out.collect()) == sorted(mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(7)).collect())


def test_mix_targets_by_repeated_resharing(spark):
    """Targets against sharing the excess again and again until no source is above its cap."""
    rng = np.random.default_rng(8)
    sizes = {f"s{i:02}": int(rng.integers(0, 5000)) if i % 4 else int(rng.integers(0, 40)) for i in range(23)}
    weight = {x: (5, 2, 1)[i % 3] for i, x in enumerate(sorted(sizes))}
    want, total = {}, float(sum(sizes.values()))
    while True:
        rest = {x: w for x, w in weight.items() if x not in want}
        left = total - sum(want.values())
        share = {x: left * w / sum(rest.values()) for x, w in rest.items()}
        above = {x: 3.0 * sizes[x] for x in rest if share[x] > 3 * sizes[x]}
        if not above:
            break
        want |= above
    want |= share
    got = mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long"))
    assert {r["source"]: r["target"] for r in got.collect()} == pytest.approx(want)


def test_mix_inclusion_over_seeds(spark):
    """How often a document is in the sample against its inclusion probability, which differs between documents of one source."""
    rng = np.random.default_rng(9)
    rows = [(i, "w " * int(2 ** rng.integers(0, 9)), f"s{i % 2}") for i in range(1200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").cache()
    seen, p = Counter(), {}
    seeds = 25
    for seed in range(seeds):
        for r in mixing.mix(docs, weights=(3, 1), seed=f"seed{seed}").collect():
            whole = math.floor(r["target"] / r["source_size"])
            seen[r["doc_id"]] += r["copies"] - whole
            p[r["doc_id"]] = r["p"]
    groups = {}
    for i, t, s in rows:
        groups.setdefault((s, len(t)), []).append(i)
    for members in groups.values():
        expected = p[members[0]]
        assert {p[i] for i in members} == {expected}
        mean = sum(seen[i] for i in members) / seeds / len(members)
        assert abs(mean - expected) < 0.05, (expected, mean)
    assert len(set(p.values())) > 10


def test_radix_cut(spark):
    values = [5, 900_000_000_000, 7, 7, 2**62, 65536, 65537, -1, -(2**63)]
    df = spark.createDataFrame([(v,) for v in values], "bits long")
    for k in range(1, len(values) + 1):
        assert quality.radix_cut(df, k) == sorted((v % 2**64 for v in values), reverse=True)[k - 1]
    assert quality.radix_cut(df, len(values) + 1) is None


def test_resampling_by_brute_force(spark):
    """n-gram models, weights, noise and the k greatest keys, worked out text by text."""
    rng = np.random.default_rng(6)
    rows = [(i, " ".join(f"{'good' if i % 3 else 'Bad!'}{int(rng.integers(30))}" for _ in range(int(rng.integers(1, 60))))) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 != 0), 0) for i in range(0, 300, 2)], LABELS)
    sample = quality.labelled_sample(labels)
    features = quality.Features()
    grams = {i: Counter(features(t.encode()).tolist()) for i, t in rows}
    raw, target = Counter(), Counter()
    for i, g in grams.items():
        raw.update(g)
        if sample.get(i) == (1, True):
            target.update(g)
    share = lambda c, x: math.log((c[x] + 1) / (sum(c.values()) + quality.BUCKETS))
    ratio = {x: share(target, x) - share(raw, x) for x in raw}
    weight = {i: sum(n * ratio[x] for x, n in g.items()) * 200 / (sum(g.values()) + 200) for i, g in grams.items()}
    key = {i: w + quality.gumbel(i) for i, w in weight.items()}
    for k in (1, 40, 299):
        got = {r["doc_id"]: r for r in quality.resample(docs, labels, k=k).collect()}
        assert {i: r["weight"] for i, r in got.items()} == pytest.approx(weight) and {i: r["key"] for i, r in got.items()} == pytest.approx(key)
        assert {i for i, r in got.items() if r["kept"]} == set(sorted(key, key=key.get)[-k:])
    drawn = Counter(d for seed in range(30) for d in sorted(key, key=lambda i: weight[i] + quality.gumbel(i, f"s{seed}"))[-40:])
    assert len(drawn) > 40  # another seed draws other documents


def test_isolation_forest_by_brute_force():
    """Path lengths walked node by node, and anomalies apart from what the trees were grown on."""
    rng = np.random.default_rng(12)
    x = rng.normal(0, 1, (400, 3))
    forest = rules.IsolationForest(x, trees=20, psi=64)
    rows = np.vstack([x[:20], rng.normal(0, 1, (5, 3)) + 9])
    want = []
    for row in rows:
        total = 0.0
        for column, split, left, right, path in forest.trees:
            at = 0
            while column[at] >= 0:
                at = left[at] if row[column[at]] < split[at] else right[at]
            total += path[at]
        want.append(2 ** (-total / 20 / rules.usual_path(64)))
    assert forest.score(rows) == pytest.approx(want) and min(want[20:]) > max(want[:20])


def test_rule_statistics_by_brute_force():
    text = "One line #1\none line\nOne line #1\n\n  \nOne line #1\n$5 & <b>é|ü</b>\n" + "alpha beta gamma delta " * 6
    got = dict(zip(rules.COUNTS, rules.statistics(text.encode(), rules.WordHashes()), strict=True))
    lines = [x for x in text.split("\n") if x.split()]
    assert got["n_symbols"] == sum(c in "#*$%&|<>" for c in text) and got["n_dup_lines"] == len(lines) - len(set(lines)) and got["word_chars"] == sum(map(len, text.split()))


def test_token_files_round_trip(spark, docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.tokenizer_path())
    start = 0
    got = tokens.token_output(docs, queries.tokenizer_path(), 2).orderBy("start").collect()
    for r, (d, text) in zip(got, sorted(ROWS, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or "")), strict=True):
        ids = t.encode(text or "", add_special_tokens=False).ids + [2]
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


@pytest.mark.parametrize("text", ["", " ", "  a", " a", "a ", "a  b", "a \n b", "a\n \nb", " \nfoo", "x\n\n y", "it's 'tis  don't", "<|endoftext|> a", "\t\ta b", "a\r\n b"])
def test_chunked_encoding_is_the_tokenizers(text):
    e = tokens.Encoder(queries.tokenizer_path(), 2)
    assert np.frombuffer(e.batch([text])[0], e.dtype).tolist() == e.tokenizer.encode(text, add_special_tokens=False).ids + [2]


@pytest.mark.parametrize("text", ["a\n\nb\n\n\n c\n", "\n\nfoo\t\tbar", "12a3 b4.5--c d", "na\u00efve \u00e9t\u00e9\u00d7\u00f7 \u0237\u0241 \u024f x\u00b2", "a\x0b\x0bb \x1cc", "x <|endoftext|>y z<|", "a\u00a0b \u3000c", "l'un 's don't", "\ufeffa \u4e2d\u6587\uff0c b"])
def test_pieces_are_the_tokenizers(text):
    e = tokens.Encoder(queries.tokenizer_path(), 2)
    texts = ["", text, "b " + text, "", text.replace(" ", "  "), text + "\n\n", "a b"]
    for x, got in zip(texts, e.batch(texts), strict=True):
        assert np.frombuffer(got, e.dtype).tolist() == e.tokenizer.encode(x, add_special_tokens=False).ids + [2]


def test_the_model_sees_a_piece_once(monkeypatch):
    seen = []

    class Counting:
        def __init__(self, own):
            self.own = own

        def __getattr__(self, name):
            return getattr(self.own, name)

        def encode_batch_fast(self, texts, **how):
            seen.extend(texts)
            return self.own.encode_batch_fast(texts, **how)

        def encode(self, text, **how):
            seen.append(text)
            return self.own.encode(text, **how)

    plain, pieces = tokens.tokenizer_of(queries.tokenizer_path()), tokens.pieces_of(queries.tokenizer_path())
    monkeypatch.setattr(tokens, "tokenizer_of", lambda path: Counting(plain))
    monkeypatch.setattr(tokens, "pieces_of", lambda path: Counting(pieces))
    stems = ["".join(chr(97 + (i * k) % 26) for k in (1, 3, 7, 11)) + "\u00e9" * (i % 2) for i in range(40)]
    texts = [" ".join(f"{a}.\n{b},{i}" for b in stems) for i, a in enumerate(stems)]
    e = tokens.Encoder(queries.tokenizer_path(), 2)
    got = e.batch(texts)
    assert sum(map(len, seen)) < sum(map(len, texts)) / 10
    assert [np.frombuffer(x, e.dtype).tolist() for x in got] == [plain.encode(x, add_special_tokens=False).ids + [2] for x in texts]


def test_language_model_counts_and_base(docs):
    want = {}
    words = [(d, (t or "").lower().encode().split()) for d, t in ROWS]
    learnt = [w for d, w in words if zlib.crc32(b"" if d is None else str(d).encode()) % 7 != 2]
    c = Counter(x for w in learnt for x in w)
    c[None] = len(learnt)
    n, v = sum(c.values()), len(c)
    for d, w in words:
        want[d] = (len(w) + 1, sum(c[x] > 0 for x in [*w, None]), n, sum(math.log10((c[x] + 1) / (n + v + 1)) for x in [*w, None]))
    for r in lm.score_documents(docs).collect():
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == want[r["doc_id"]][:3]
        assert abs(r["base_score"] - want[r["doc_id"]][3]) < 1e-6 and r["score"] < 0


def test_words_of_many_texts_together():
    texts = ["", None, "  A b\tB.\n\nb.", " ", "\x1cx \u00c9A\u00a0b", "long_word wordlong ## a- \u4e2d", "", "b"]
    for skip in (0, 1, 3):
        words, counts = common.lower_words(pa.array(texts, pa.string()).slice(skip))
        want = [(t or "").encode().lower().split() for t in texts[skip:]]
        assert counts.tolist() == [len(x) for x in want] and words.to_pylist() == [w for x in want for w in x]
    keys = dict(zip(words.dictionary.to_pylist(), lm.word_keys(words.dictionary).tolist(), strict=True))
    assert {w: k & 15 for w, k in keys.items()} == {b"\x1cx": 12, "\u00c9a\u00a0b".encode().lower(): 6, b"long_word": 13, b"wordlong": 3, b"##": 2, b"a-": 12, "\u4e2d".encode(): 6, b"b": 0}
    assert all(k >> 4 == xxhash.xxh3_64_intdigest(w) >> 5 for w, k in keys.items())


def test_batches_are_merged_by_size():
    batches = [pa.record_batch([pa.array(["x" * n] * k, pa.string())], ["text"]) for n, k in ((10, 3), (0, 0), (500, 1), (10, 1), (10, 2))]
    got = list(common.merged(iter(batches), 100))
    assert [b.num_rows for b in got] == [3, 1, 3] and pa.Table.from_batches(got).equals(pa.Table.from_batches(batches).combine_chunks())


@pytest.mark.parametrize("n_docs", [3, 400])
def test_language_model_trains_on_every_window_once(n_docs, monkeypatch):
    class Counting(lm.gru.Model):
        trained = 0

        def step(self, inputs, targets, h):
            self.trained += int(np.count_nonzero(targets >= 0))
            return super().step(inputs, targets, h)

    model = Counting(4, 4, 2, 2)
    block = [np.append(np.full(999, 5, np.int32), 0) for _ in range(n_docs)]
    monkeypatch.setattr(lm, "BLOCK_TOKENS", 70_000)
    assert lm.learn(model, iter(block), 0.01) == n_docs * 1000 == model.trained


def test_language_model_probabilities_sum_to_one():
    model = lm.gru.Model(4, 4, 3, 2, seed=1)
    for x in model.p.values():
        x += np.random.default_rng(2).normal(0, 0.5, x.shape).astype(np.float32)
    prefix = [3, 9, 1]
    total = sum(np.exp(lm.gru.score(model, [np.array([*prefix, t], np.int32)])[0]) for t in range(16))
    assert abs(total / np.exp(lm.gru.score(model, [np.array(prefix, np.int32)])[0]) - 1) < 1e-4


def test_language_model_gradients():
    """Backpropagation against differences of the window's mean log-probability."""
    rng = np.random.default_rng(4)
    model = lm.gru.Model(3, 3, 4, 3, seed=3)
    inputs = np.array([[0, 0], [4, 2], [7, 0], [1, 5]], np.int32)
    targets = np.array([[4, 2], [7, 0], [1, 5], [8, -1]], np.int32)
    h = rng.normal(0, 0.5, (2, 4)).astype(np.float32)
    loss = lambda: -model.step(inputs, targets, h)[2] / 7
    got = model.step(inputs, targets, h)[0]
    for name, x in model.p.items():
        for _ in range(6):
            at = tuple(int(rng.integers(n)) for n in x.shape)
            old, e = x[at], np.float32(1e-2)
            x[at] = old + e
            up = loss()
            x[at] = old - e
            down = loss()
            x[at] = old
            assert abs((up - down) / (2 * e) - got[name][at]) < 2e-3, (name, at)


def test_language_model_learns_and_does_not_depend_on_partitions(spark):
    rng = np.random.default_rng(5)
    follow = {w: rng.permutation(40)[:3] for w in range(40)}

    def text(n):
        out = [int(rng.integers(40))]
        while len(out) < n:
            out.append(int(rng.choice(follow[out[-1]])))
        return " ".join(f"w{x}" for x in out)

    rows = [(i, text(120)) for i in range(300)]
    a, b = ({r["doc_id"]: r for r in lm.score_documents(spark.createDataFrame(rows[::step], "doc_id long, text string").repartition(n)).collect()} for step, n in ((1, 3), (-1, 5)))
    assert {i: r["score"] for i, r in a.items()} == pytest.approx({i: r["score"] for i, r in b.items()}, rel=1e-6)
    held = [r for r in a.values() if r["held_out"]]
    assert len(held) > 20 and sum(r["score"] for r in held) > 0.85 * sum(r["base_score"] for r in held)


def test_base_rules_by_brute_force(docs, labels):
    for r in rules.judged(docs, labels).collect():
        text = dict(ROWS)[r["doc_id"]] or ""
        w = text.split()
        windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        repeated = {j for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
        assert (r["n_words"], r["word_chars"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), len(repeated))
        assert r["base_failed"] == (len(w) < 20 or 100 * len(repeated) > 30 * len(w))


def test_score_cut_is_the_threshold_of_all_rows(spark):
    rng = np.random.default_rng(8)
    good = rng.random(3000) < 0.6
    scores = np.round(np.where(good, rng.normal(0.45, 0.05, 3000), rng.normal(0.55, 0.08, 3000)), 4).clip(0.01, 0.99)
    df = spark.createDataFrame([(float(x), bool(g)) for x, g in zip(scores, good, strict=True)], "score double, good boolean")
    assert rules.score_cut(df) == pytest.approx(-quality.threshold(-scores, good), abs=1e-12)
    assert rules.score_cut(df.filter("good")) == float("inf")


def test_main_text(spark):
    page = "<html><head><title>t</title><style>p{}</style><script>var x='</p>';</script></head><body><nav><ul><li><a href=x>menu</a></ul></nav><div class=ad>buy</div><article><h1>Head &amp; more</h1><p>one<br>two  three<p><b>four</article><footer>&copy; x</footer>"
    rows = [(1, "http://a.example/1", page), (2, None, None), (3, "x", ""), (None, "http://a.example/2", "plain <i>words</i><p>next")]
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in html.main_text(pages(spark, rows)).collect()}
    assert got[1][0] == "Head & more\none two three\nfour" and got[2] == got[3] == ("", 0) and got[None][0] == "plain words\nnext"
    assert html.main_text(pages(spark, rows).limit(0)).count() == 0


def test_style_tree_drops_what_a_site_repeats(spark):
    rows = [(i, f"http://a.example/{i}", f"<body><div class=x>Same words here</div><div class=y>Story number {i}</div>") for i in range(30)]
    assert {r["text"] for r in html.main_text(pages(spark, rows)).collect()} == {f"Story number {i}" for i in range(30)}


def test_style_tree_judges_inside_and_outside_the_article(spark):
    rows = [(i, f"http://a.example/{i}", f"<body><div class=lead>Lead {i}</div><article><p>Story <b>number</b> {i}</p><div class=box>Tell your friends</div></article><div class=x>Same words here</div>") for i in range(30)]
    assert {r["text"] for r in html.main_text(pages(spark, rows)).collect()} == {f"Lead {i}\nStory number {i}" for i in range(30)}


def test_style_tree_keeps_the_distinct_pages_among_copies(spark):
    story = lambda n: f"<html><body><div><article><p>Story number {n}</p></article></div><div class=x>Same words here</div></body></html>"
    rows = [(i, "http://a.example/" if i < 320 else f"http://small{i}.example/", story(0 if i % 320 < 170 else i)) for i in range(640)]
    assert {r["page_id"]: r["text"] for r in html.main_text(pages(spark, rows)).collect()} == {i: f"Story number {0 if i % 320 < 170 else i}" for i in range(640)}


def test_style_tree_importance_by_brute_force(spark):
    rng = np.random.default_rng(11)
    rows = [(i, f"http://{'ab'[i % 2]}.example/{i}", "".join(f"<div class=c{j}>{'<i class=k></i>' * int(rng.integers(2))}text {int(rng.integers(1 + 3 * j))}</div>" for j in range(5))) for i in range(60)]
    want = {}
    for host in ("a.example", "b.example", ""):
        seen = {}
        for page in {html_ for _, url, html_ in rows if host in url or not host}:
            for path, style, content in html.tree_rows(page):
                seen.setdefault(path, []).append((style, content))
        for path, got in seen.items():
            m = len(got)
            entropy = lambda i, got=got, m=m: -sum(c / m * math.log(c / m) for c in Counter(x[i] for x in got).values()) / math.log(m) if m > 1 else 1.0
            want[host, path] = (m, pytest.approx(0.1 * entropy(0) + 0.9 * entropy(1)))
    got = {(r["host"], r["path"]): (r["pages"], r["importance"]) for r in html.importance(html.tree_nodes(pages(spark, rows))).collect()}
    assert got == want and len(want) == 15


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ('<body class="has-sidebar"><article><p>x</p></article>', "x"), ('<article class="post sidebar-right"><p>x</p></article>', "x"), ("<div class=sidebar><article>main text</article></div><div class=comments><article>c</article></div>", "main text"),
        ("<p title=it's>one<p>two", "one\ntwo"), ("<p class='a hidden b'>x</p><p alt='is hidden here'>y<p hidden>z", "x\ny"), ('<div class="elementor-widget">x</div><div class="widget site-footer">y</div>', "x"),
        ("<script>var a='<main >'</script><p>x", "x"), ("<p>&<b>amp;</b> &amp;", "&amp; &"), ("a < b <3 </> c <b", "a < b <3 c <b"), ('<p><a href="x>y</a>', "y"), ("<p><a title='x>y'>z</a>", "z"), ("</script>x<textarea>k</textarea >z", "xz"),
    ],
)
def test_main_text_of_odd_markup(page, text):
    assert html.extract(page) == text


@pytest.mark.parametrize("page", ['<p title="x>' * 30_000, "<" * 300_000, "<a b= " * 60_000, "<div>" * 60_000 + "</p>" * 60_000, "<span>" * 60_000 + "<div><li>" * 30_000, "word " * 600_000])
def test_main_text_takes_linear_time(page):
    import time

    began = time.process_time()
    html.extract(page)
    assert time.process_time() - began < 10


def test_style_tree_joins_what_it_does_not_broadcast(spark, monkeypatch):
    rows = [(i, f"http://small{i}.example/", "<body>" + "".join(f"<div class=b{j}>Boilerplate {j}</div>" for j in range(12)) + f"<div class=y>Story number {i}</div>") for i in range(30)]
    monkeypatch.setattr(html, "BROADCAST_ROWS", 5)
    assert {r["text"] for r in html.main_text(pages(spark, [*rows, *rows[:3], (None, None, None)])).collect()} == {"", *(f"Story number {i}" for i in range(30))}


def test_line_templates_by_brute_force(spark):
    """Every template worked out line by line, with a support of 3 documents; long lines word for word."""
    rng = np.random.default_rng(13)
    words = [f"w{i}" for i in range(30)]
    long = [" ".join(rng.choice(words, 60)) for _ in range(4)]
    rows = []
    for i in range(40):
        lines = [f"Posted by user{i} on day {int(rng.integers(9))} of the month", "Menu", " ".join(rng.choice(words, 6)), "a\tb  c " + str(rng.choice(["x", "y", f"z{i}"])), f"only {words[i % 30]}", "", long[i % 40 // 10] if i % 5 == 0 else "Own"]
        rows.append((i, "\n".join(rng.permutation(lines))))
    rows += [(0, rows[0][1]), (None, rows[1][1]), (50, None), (51, "")]
    lines = [(d, n, x.split()) for d, t in rows if d is not None and t is not None for n, x in enumerate(t.split("\n")) if x.split()]
    digit = lambda t: any(c.isdigit() for c in t)
    leaf = lambda w: (len(w), *("<*>" if digit(t) else t for t in w[:3]))
    reach, place = {}, {}
    for d, _, w in lines:
        reach.setdefault(leaf(w), set()).add(d)
        for i, t in enumerate(w):
            place.setdefault((leaf(w), i, t), set()).add(d)
    template = lambda w: (leaf(w), tuple(t if len(place[leaf(w), i, t]) >= 3 and not digit(t) else "<*>" for i, t in enumerate(w)))
    solid = lambda x: 100 * sum(t != "<*>" for t in x[1]) >= 60 * len(x[1])
    holds = {}
    for d, _, w in lines:
        if len(reach[leaf(w)]) >= 3 and solid(template(w)):
            holds.setdefault(template(w), set()).add(d)
    first = {}
    for d, _, w in lines:
        if len(w) > 50:
            first[tuple(w)] = min(d, first.get(tuple(w), d))
    drop = {(d, n) for d, n, w in lines if len(holds.get(template(w), ())) >= 3 or first.get(tuple(w), d) < d}
    got = {(r["doc_id"], r["text"], r["n_dropped"]) for r in linededup.deduplicated_lines(spark.createDataFrame(rows, "doc_id long, text string"), 3).collect()}
    want = set()
    for d, t in rows:
        kept = None if t is None else [x for n, x in enumerate(t.split("\n")) if (d, n) not in drop]
        want.add((d, None if t is None else "\n".join(kept), 0 if t is None else len(t.split("\n")) - len(kept)))
    assert got == want and any(n > 50 for n in (len(w) for _, _, w in lines)) and len(drop) > 80


def test_warc_round_trip(spark):
    big = "<p>" + "x" * 1200
    rows = [(1, "http://a/ b", big), (2, "http://a", big), (3, None, None), (4, "u", "small"), (5, "u", "small"), (None, "u", big)]
    got = {r["page_id"]: (r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.round_trip(pages(spark, rows)).collect()}
    assert got == {1: (1203, "revisit", 2), 2: (1203, "response", None), 3: (0, "response", None), 4: (5, "response", None), 5: (5, "response", None), None: (1203, "response", None)}
    assert warc.round_trip(pages(spark, rows).limit(0)).count() == 0


def responses(n):
    """Records whose blocks do not compress well, so that a damage hits one of them."""
    rng = np.random.default_rng(7)
    bodies = [rng.integers(33, 127, 3000).astype(np.uint8).tobytes() for _ in range(n)]
    return [warc.record_bytes([("WARC-Type", "response"), ("WARC-Record-ID", f"<r{i}>"), ("WARC-Block-Digest", warc.sha1_label(b))], b) for i, b in enumerate(bodies)]


@pytest.mark.parametrize("bad", ["block", "header", "stream"])
def test_salvage_inside_a_member(bad):
    records = responses(6)
    if bad == "block":
        records[2] = records[2][:-9] + b"~~~~~" + records[2][-4:]
    elif bad == "header":
        records[2] = records[2].replace(b"Content-Length", b"Content-Wrong!")
    packed = bytearray(warc.member(b"".join(records)))
    if bad == "stream":
        packed[len(packed) * 7 // 12] ^= 0xFF
    outcome = warc.Outcome()
    got = [r.headers["warc-record-id"] for r in warc.read_archive(bytes(packed) + warc.member(responses(8)[7]), outcome)]
    assert got[:2] == ["<r0>", "<r1>"] and got[-1] == "<r7>" and outcome.gaps and outcome.records == len(got)
    if bad != "stream":
        assert got == ["<r0>", "<r1>", "<r3>", "<r4>", "<r5>", "<r7>"]
        a, b = (sum(map(len, records[:k])) for k in (2, 3))
        assert [(g.start, g.end) for g in outcome.gaps] == [(0, len(packed))] and outcome.gaps[0].reason.endswith(f"unpacked bytes {a} to {b}")


def test_payload_digests_are_checked():
    http, body = b"HTTP/1.1 200 OK\r\nA: b\r\n", b"some body"
    chunked = http + b"Transfer-Encoding: chunked\r\n\r\n4\r\nsome\r\n5\r\n body\r\n0\r\n\r\n"
    for kind, content, block, right in (("response", "text/html", body, True), ("response", "text/html", b"some bodY", False), ("response", "application/http", http + b"\r\n" + body, True), ("response", "application/http; msgtype=response", http + b"\r\nsome bodY", False), ("response", "application/http", chunked, True), ("revisit", "text/html", b"", True)):
        record = warc.record_bytes([("WARC-Type", kind), ("Content-Type", content), ("WARC-Payload-Digest", warc.sha1_label(body))], block)
        outcome = warc.Outcome()
        assert len(list(warc.read_archive(record, outcome))) == right and bool(outcome.gaps) != right


@pytest.mark.parametrize("packed", [True, False])
def test_salvage_after_damage(packed):
    records = [warc.record_bytes([("WARC-Type", "response"), ("WARC-Record-ID", f"<r{i}>"), ("WARC-Block-Digest", warc.sha1_label(b"body %d" % i))], b"body %d" % i) for i in range(5)]
    pieces = [warc.member(r) if packed else r for r in records]
    starts = np.cumsum([0, *map(len, pieces)])
    data = bytearray(b"".join(pieces))
    data[starts[2] + (len(pieces[2]) // 2 if packed else len(pieces[2]) - 6)] ^= 0xFF  # of a plain record, in its block
    outcome = warc.Outcome()
    got = [r.headers["warc-record-id"] for r in warc.read_archive(bytes(data), outcome)]
    assert got == ["<r0>", "<r1>", "<r3>", "<r4>"]
    assert [(g.start, g.end) for g in outcome.gaps] == [(starts[2], starts[3])]
    outcome = warc.Outcome()
    assert len(list(warc.read_archive(b"junk\n" + bytes(data[: starts[2]]) + data[starts[4] : -3], outcome))) == 2
    assert [(g.start, g.end) for g in outcome.gaps] == [(0, 5), (5 + starts[2], 5 + starts[2] + len(pieces[4]) - 3)]
