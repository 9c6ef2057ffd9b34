"""Every query of the training-data operators against a brute-force version,
an exact round trip or held-out accuracy, on edge cases, an empty table and a
small table."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import pytest

import __spark_entry__ as entry
from llm_tables import edge_dir, empty_dir  # noqa: F401  fixtures

SMALL = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALL = [n for n in entry.queries() if re.match(r"op\d+_", n)]
OPS = [n for n in ALL if not re.match("op1[12]_", n)]      # those over documents


@pytest.fixture(scope="module")
def result(spark, edge_dir, empty_dir):
    known = {}

    def run(name, where):
        if (name, where) not in known:
            path = {"edge": edge_dir, "empty": empty_dir}.get(where, where)
            known[name, where] = entry.queries()[name](spark, path).collect()
        return known[name, where]

    return run


@pytest.fixture(scope="module")
def docs(spark, edge_dir):
    def read(where):
        path = edge_dir if where == "edge" else where
        return [(r.doc_id, r.text) for r in spark.read.parquet(f"{path}/documents.parquet").collect()]

    return read


def lower(text):
    return (text or "").encode().lower().decode()


def sha(data):
    return hashlib.sha256(data).hexdigest()


def rows_of(rows, *columns):
    key = lambda t: tuple((x is None, x) for x in t)
    return sorted((tuple(r[c] for c in columns) for r in rows), key=key)


def test_all_operators_and_the_pipeline_are_registered():
    assert {int(n[2:].split("_")[0]) for n in ALL} == set(range(1, 14)) and "pipeline" in entry.queries()


@pytest.mark.parametrize("name", [*OPS, "pipeline"])
def test_empty_table_gives_an_empty_result(result, name):
    assert result(name, "empty") == []


@pytest.mark.parametrize("name", OPS)
def test_one_row_for_each_input_row(result, docs, name):
    ids = lambda rows: sorted((i is None, i) for i in rows)
    assert ids(r.doc_id for r in result(name, "edge")) == ids(i for i, _ in docs("edge"))


@pytest.mark.parametrize("where", ["edge", SMALL])
def test_op1_base_score_and_counts(result, docs, where):
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    tokens = lambda t: WORD.findall(lower(t)) + [None]
    c = Counter(x for i, t in docs(where) if not held(i) for x in tokens(t))
    n, v = sum(c.values()), len(c)
    want = []
    for i, t in docs(where):
        w = tokens(t)
        want.append((i, held(i), len(w), sum(x in c for x in w), n,
                     round(sum(math.log10((c[x] + 1) / (n + 1 * (v + 1))) for x in w), 5)))
    key = lambda t: tuple((x is None, x) for x in t)
    got = [(*[r[x] for x in ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens")], round(r.base_score, 5))
           for r in result("op1_brown", where)]
    assert sorted(got, key=key) == sorted(want, key=key)


def test_op1_the_model_beats_the_base_on_held_out_texts(result):
    rows = [r for r in result("op1_brown", SMALL) if r.held_out]
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_op1_exchange_raises_the_likelihood_and_separates_two_languages():
    import numpy as np

    from quarkframe.llm.brown import exchange

    m = np.zeros((21, 21), np.int64)
    m[:10, :10], m[10:20, 10:20], m[20, :20], m[:20, 20] = 50, 50, 3, 3
    cls = exchange(m, classes=3, rounds=10)
    assert len(set(cls[:10])) == 1 and len(set(cls[10:20])) == 1 and len(set(cls)) == 3


def test_op1_best_class_against_brute_force():
    import numpy as np

    from quarkframe.llm.brown import CLASSES, best_classes, likelihood

    r = np.random.default_rng(5)
    for words, k in ((12, 4), (30, 7)):
        m = r.poisson(0.8, (words, words))
        m[-1, -1] = 0
        cls = np.r_[r.integers(0, k - 1, words - 1), k - 1]
        table = lambda c: np.eye(k, dtype=int)[c].T @ m @ np.eye(k, dtype=int)[c]
        one, entries = np.eye(k, dtype=int)[cls], []
        for w in range(words - 1):
            after, before = m[w] @ one, m[:, w] @ one
            entries += [(w, j, before[j]) for j in range(k) if before[j]]
            entries += [(w, k + j, after[j]) for j in range(k) if after[j]]
            entries += [(w, 2 * k, m[w, w])] if m[w, w] else []
        got = best_classes(table(cls), cls[:-1], *map(np.array, zip(*entries)))
        for w in range(words - 1):
            ll = []
            for b in range(k - 1):
                c = cls.copy()
                c[w] = b
                ll.append(likelihood(table(c)))
            assert ll[got[w]] == pytest.approx(max(ll), abs=1e-6)
            if got[w] != cls[w]:
                assert ll[got[w]] > ll[cls[w]]
    assert 2 * CLASSES < 256      # context codes share a key's low byte


def _op1_rows(seed: int, n: int) -> list[tuple]:
    r = random.Random(seed)
    nouns, verbs = [f"n{i}" for i in range(1200)], [f"v{i}" for i in range(600)]
    say = lambda: " ".join(x for _ in range(r.randint(0, 40)) for x in (r.choice(nouns), r.choice(verbs)))
    return [(i, say()) for i in range(n)] + [(None, None), (n, ""), (n, "n1 n1 n1 v2")]


def test_op1_every_word_is_exchanged_and_the_cache_changes_nothing(spark, monkeypatch):
    import numpy as np
    from pyspark.sql import functions as F

    from quarkframe.llm import brown

    rows = _op1_rows(4, 200)                     # more than OWN words: the others start in groups
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    n_words = len({w for _, t in rows for w in (t or "").split()})
    assert n_words > brown.OWN
    scores = {}
    for cache in (1 << 20, 700):
        monkeypatch.setattr(brown, "CACHE", cache)
        model = brown.fit(docs)
        rare = {r["w"]: r["cls"] for r in model.rare.collect()}
        assert len(model.words) <= cache and len(model.words) + len(rare) == n_words
        cls = dict(zip(brown._rare_key(model.words).tolist(), model.classes.tolist())) | rare
        scored = brown.score(docs, model, F.lit(True)).collect()
        scores[cache] = (cls, model.likelihoods, sorted((r.doc_id or -1, r.n_known, round(r.base_score, 6), round(r.score, 6))
                                                     for r in scored))
    assert scores[1 << 20] == scores[700]
    cls, likelihoods, _ = scores[700]
    assert max(likelihoods) > likelihoods[0]

    # the likelihood and the score, from the texts and the classes alone
    from quarkframe.llm.wordhash import scan
    import pyarrow as pa

    k = brown.CLASSES
    table, counts = np.zeros((k, k)), Counter()
    sequences = []
    for s in scan(pa.array([t for _, t in rows]), lower=True):
        keys, bounds = brown._rare_key(s.hashes).tolist(), s.bounds()
        sequences += [keys[i:j] + [None] for i, j in zip(bounds[:-1], bounds[1:])]
    of = lambda w: k - 1 if w is None else cls[w]
    for seq in sequences:
        counts.update(seq)
        for a, b in zip([None, *seq], seq):
            table[of(a), of(b)] += 1
    assert max(likelihoods) == pytest.approx(brown.likelihood(table))
    types = Counter(of(w) for w in counts)
    tokens = sum(counts.values())
    smooth = (table + brown.ALPHA) / (table + brown.ALPHA).sum(1, keepdims=True)
    want = []
    for (i, _), seq in zip(rows, sequences):
        total = 0.0
        for a, b in zip([None, *seq], seq):
            c = of(b)
            total += math.log10((counts[b] + 1) * (
                brown.LAMBDA * smooth[of(a), c] / (table[:, c].sum() + types[c] + 1)
                + (1 - brown.LAMBDA) / (tokens + len(counts) + 1)))
        want.append((-1 if i is None else i, total))
    got = sorted((r[0], r[3]) for r in scores[700][2])
    for (i, a), (j, b) in zip(got, sorted((i or -1, t) for i, t in want)):
        assert i == j and a == pytest.approx(b, abs=1e-4)


def test_op1_only_bigrams_of_two_rare_words_are_joined(spark, monkeypatch):
    import pyarrow as pa

    from quarkframe.llm import brown
    from quarkframe.llm.wordhash import scan

    made = []

    class Kept(brown.Exchange):
        def __init__(self, *args):
            super().__init__(*args)
            made.append((self.words, self.pairs, self.alone, self.mixed))

    monkeypatch.setattr(brown, "Exchange", Kept)
    monkeypatch.setattr(brown, "CACHE", 700)
    monkeypatch.setattr(brown, "ROUNDS", 1)
    rows = _op1_rows(6, 120) + [(500, "one1 one1 one1"), (501, "n1 lonely n2")]
    brown.fit(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3))
    (words, pairs, alone, mixed), = made
    place = {w: i for i, w in enumerate(brown._rare_key(words).tolist())}
    both, near, met, counts, end = Counter(), {}, set(), Counter(), len(words)
    for s in scan(pa.array([t for _, t in rows]), lower=True):
        keys, bounds = brown._rare_key(s.hashes).tolist(), s.bounds()
        for i, j in zip(bounds[:-1], bounds[1:]):
            counts.update(w for w in keys[i:j] if w not in place)
            at = [end, *(place.get(w, w) for w in keys[i:j]), end]
            for a, b in zip(at, at[1:]):
                if a < 0 and b < 0:
                    both[a, b] += 1
                    met |= {a, b}
                elif b < 0:
                    near.setdefault(b, []).append(a * 2)
                elif a < 0:
                    near.setdefault(a, []).append(b * 2 + 1)
    assert both and met != set(counts)
    assert Counter((r.l, r.r) for r in pairs.collect()) == both
    for table, here in ((alone, set(counts) - met), (mixed, met)):
        got = {r.w: (r.c, sorted(memoryview(r.near).cast("i").tolist())) for r in table.collect()}
        assert got == {w: (counts[w], sorted(near.get(w, []))) for w in here}


def test_op1_places_against_a_search():
    import numpy as np

    from quarkframe.llm.brown import Places

    r = np.random.default_rng(2)
    for n in (0, 1, 5, 3000):
        words = np.unique(np.r_[r.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2),
                                np.arange(n // 5, dtype=np.uint64), np.full(int(n > 1), (1 << 64) - 1, np.uint64)])
        asked = np.r_[words, words + np.uint64(1), r.integers(0, 1 << 63, 500).astype(np.uint64)]
        at, known = Places(words).find(asked)
        assert known.tolist() == np.isin(asked, words).tolist() and (words[at[known]] == asked[known]).all()


@pytest.mark.parametrize("where", ["edge", SMALL])
def test_op2_targets_and_takings(spark, result, docs, edge_dir, where):
    path = edge_dir if where == "edge" else where
    size = Counter()
    for r in spark.read.parquet(f"{path}/documents.parquet").select("source", "text").collect():
        size[r.source] += len(WORD.findall(r.text or ""))
    order = sorted((s for s in size if s is not None), key=str.encode) + [None] * (None in size)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    free, target, left = set(order), {}, 1.5 * sum(size.values())
    while free:                                  # share, fix those above their most, share again
        w = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / w > 2 * size[s] + 1e-9}
        if not over:
            target |= {s: left * weight[s] / w for s in free}
            break
        target |= {s: 2.0 * size[s] for s in over}
        left -= sum(2 * size[s] for s in over)
        free -= over
    rows = result("op2_mixing", where)
    assert all(0 <= r.taken <= 2 * r.size for r in rows)
    assert {round(r.target, 6) for r in rows} == {round(x, 6) for x in target.values()}
    assert sum(r["size"] for r in rows) == sum(size.values())
    taken = Counter()
    for r in rows:
        taken[r.source_size, round(r.target, 6)] += r.taken
    want = Counter()
    for s in order:
        want[size[s], round(target[s], 6)] += target[s]
    for k in want:
        assert abs(taken[k] - want[k]) <= 0.03 * want[k] + 3


def test_op2_reruns_agree(spark, result):
    again = entry.queries()["op2_mixing"](spark, SMALL).collect()
    assert rows_of(again, "doc_id", "taken") == rows_of(result("op2_mixing", SMALL), "doc_id", "taken")


def test_op2_permutation(spark):
    from pyspark.sql import functions as F

    from quarkframe.llm.mixing import permute

    for n in (1, 2, 7, 100):
        got = [r[0] for r in spark.range(n).select(permute(F.col("id"), F.lit(n), F.lit(5))).collect()]
        assert sorted(got) == list(range(n)) and (n < 10 or got != sorted(got))


def test_op2_permutation_goes_back(spark):
    from pyspark.sql import functions as F

    from quarkframe.llm.mixing import permute

    n = F.lit(101)
    assert all(a == b for a, b in spark.range(101).select("id", permute(permute(F.col("id"), n, F.lit(3)), n, F.lit(3), back=True)).collect())


@pytest.mark.parametrize("shares", [0.5, 1.0, 1.37, 2.0])
@pytest.mark.parametrize("size", [1, 127, 128, 129, 5000, 12_801])
def test_op2_slots_take_the_target_and_no_block_twice_an_epoch(spark, size, shares):
    from quarkframe.llm.mixing import BLOCK, slot_counts, slots

    target, blocks = round(size * shares), -(-size // BLOCK)
    counted = slot_counts(spark.createDataFrame([(0, "a", size, float(target), blocks)],
                                                "s int, source string, source_size bigint, target double, blocks bigint"))
    got = slots(counted, 10).collect()
    length = lambda b: min(BLOCK, size - b * BLOCK)
    assert sum(min(length(r.block), r.upto) for r in got) == target
    assert len({(r.block, r.epoch) for r in got}) == len(got) and all(r.upto > 0 for r in got)
    assert sum(r.upto < length(r.block) for r in got) <= 1       # only the last slot is trimmed


def test_op2_shards_draw_their_sources_at_random(spark, monkeypatch):
    """Source counts of shards: the totals are kept, and they spread as draws do."""
    from quarkframe.llm import mixing

    monkeypatch.setattr(mixing, "SHARD", 200)
    rows = [(k, name, size, float(size), -(-size // 128)) for k, (name, size) in enumerate([("a", 128 * 6000), ("b", 128 * 3000), ("c", 128 * 1000)])]
    counted = mixing.slot_counts(spark.createDataFrame(
        rows, "s int, source string, source_size bigint, target double, blocks bigint"))
    n = {(r.shard, r.s): r.n for r in mixing.draws(mixing.slots(counted, 10_000)).collect()}
    assert all(sum(n.get((i, s), 0) for s in range(3)) == 200 for i in range(50))
    assert [sum(n.get((i, s), 0) for i in range(50)) for s in range(3)] == [6000, 3000, 1000]
    chi = sum((n.get((i, s), 0) - 200 * p) ** 2 / (200 * p) for i in range(50) for s, p in enumerate((0.6, 0.3, 0.1)))
    assert 55 < chi < 150                                        # 98 degrees of freedom: mean 98, deviation 14


@pytest.mark.parametrize("where", ["edge", SMALL])
def test_op3_against_brute_force(result, docs, where):
    order = lambda i: 1 << 70 if i is None else i
    least = {}
    texts = [(i, WORD.findall(t or "")) for i, t in docs(where)]
    for i, w in texts:
        for k in range(len(w) - 49):
            x = tuple(w[k:k + 50])
            least[x] = min(least.get(x, 1 << 80), order(i))
    want = []
    for i, w in texts:
        gone = set()
        for k in range(len(w) - 49):
            if least[tuple(w[k:k + 50])] < order(i):
                gone.update(range(k, k + 50))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        want.append((i, len(w), len(gone), sha(kept.encode())))
    key = lambda t: tuple((x is None, x) for x in t)
    assert any(x[2] for x in want)
    assert rows_of(result("op3_substring", where), "doc_id", "n_words", "n_removed", "kept_sha256") == sorted(want, key=key)


def test_op3_cut_keeps_rows_columns_and_untouched_texts(spark, edge_dir):
    from quarkframe.llm.substring import cut

    docs = spark.read.parquet(f"{edge_dir}/documents.parquet")
    got, was = cut(docs).collect(), docs.collect()
    assert cut(docs).columns == docs.columns and len(got) == len(was)
    removed = {r.doc_id: r.n_removed for r in entry.queries()["op3_substring"](spark, edge_dir).collect()}
    before = {r.doc_id: r.text for r in was if r.doc_id not in (12, None)}
    for r in got:
        if r.doc_id in before:
            n = len(WORD.findall(before[r.doc_id] or ""))
            assert len(WORD.findall(r.text or "")) == n - removed[r.doc_id]
            assert removed[r.doc_id] or r.text == before[r.doc_id]


@pytest.mark.parametrize("where", ["edge", SMALL])
def test_op4_against_tiktoken(result, docs, where):
    import public_tokenizers as P
    import struct
    import tiktoken

    from quarkframe.llm.bpe import read_ranks

    ranks = {b: i for i, b in enumerate(read_ranks(P.path("byte_bpe_multi_50k.tiktoken")))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for i, t in docs(where):
        ids = enc.encode_ordinary(t or "")
        want.append((i, len(ids), sha(struct.pack(f"<{len(ids)}I", *ids)), sha((t or "").encode())))
    key = lambda t: tuple((x is None, x) for x in t)
    assert rows_of(result("op4_bpe", where), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want, key=key)


@pytest.mark.parametrize("where", ["edge", SMALL])
def test_op5_base_figures(result, docs, where):
    want = []
    for i, t in docs(where):
        t = t or ""
        w = WORD.findall(t)
        seen = defaultdict(list)
        for k in range(len(w) - 7):
            seen[tuple(w[k:k + 8])].append(k)
        rep = {x for at in seen.values() if len(at) > 1 for k in at for x in range(k, k + 8)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        want.append((i, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)),
                     len(rep), len(w) < 20 or 100 * len(rep) > 30 * len(w)))
    key = lambda t: tuple((x is None, x) for x in t)
    rows = result("op5_quality_rules", where)
    assert rows_of(rows, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                   "base_failed") == sorted(want, key=key)
    assert not any(r.kept and r.base_failed for r in rows)


def test_op5_keeps_good_and_rejects_bad_documents(spark, result):
    sf = "/root/testdata/sf0.01"
    y = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [(y[r.doc_id], r) for r in result("op5_quality_rules", sf) if r.doc_id in y]
    good = [r for q, r in rows if q and not r.base_failed]
    bad = [r for q, r in rows if not q]
    assert sum(r.kept for r in good) >= 0.98 * len(good) and sum(r.kept for r in bad) <= 0.1 * len(bad)


def test_op5_a_groups_own_distribution_moves_each_of_its_fences(spark):
    from pyspark.sql import functions as F

    from quarkframe.llm import quality_rules as Q

    rows = []
    for source, scale in (("a", 1.0), ("b", 2.0)):
        for i in range(200):
            rows.append(("en", source, [scale * x for x in (
                0.004 * (i % 10 < 3), 0.01 + 0.0001 * (i % 20), 0.06 * (i % 40 == 0), 0.05 * (i % 40 == 1), 4 + 0.01 * (i % 50))]))
    m = spark.createDataFrame(rows, "lang string, source string, m array<double>")
    m = m.select("lang", "source", F.struct(F.lit(False).alias("base_failed"), F.lit(99).alias("n_words"), "m").alias("q"))
    f = {r.source: r.fence for r in Q.fences(Q.sketches(m, "q")).collect()}
    assert len(f["a"]) == len(Q.MEASURES) == 5
    for x, y, most in zip(f["a"], f["b"], (0.02, 0.02, 0.07, 0.06, 6.5)):
        assert 1.9 < y / x < 2.1 and x < most        # twice the values, twice the fence


def test_op5_sketch_quantiles_are_within_their_error(spark):
    from pyspark.sql import functions as F

    from quarkframe.llm import quality_rules as Q

    x = [0.001 * 1.01 ** k for k in range(900)]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in x], "x double").select(Q._value(Q._bin(F.col("x")))).collect()]
    assert all(abs(a / b - 1) <= 0.03 for a, b in zip(got[100:], x[100:]))


@pytest.mark.parametrize("name, remainder, modulus, label", [
    ("op6_toxicity", 0, 5, "toxic"), ("op9_quality_mil", 2, 4, "quality")])
def test_op6_op9_scores_and_held_out_accuracy(spark, result, name, remainder, modulus, label):
    sf = "/root/testdata/sf0.01"
    y = {r.doc_id: r[label] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows, line = result(name, sf), 0.5 if label == "toxic" else 0.7
    for r in [*rows, *result(name, "edge")]:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= line)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % modulus == remainder)
    held = [(r.predicted, y[r.doc_id]) for r in rows if r.held_out and r.doc_id in y]
    assert sum(p == q for p, q in held) >= 0.9 * len(held)


def test_op6_clauses_not_words():
    import numpy as np

    from quarkframe.llm.toxicity import PRIOR, Grammar, seeds

    g = Grammar(seeds())
    score = lambda t: float(g.features(t) @ PRIOR[:-1] + PRIOR[-1])
    assert score("you are an idiot") > score("an idiot") > score("they said an idiot") > score("")
    assert score("you are not an idiot") < score("you are an idiot") and score("idiotic ideas") == score("")
    assert np.count_nonzero(g.features("no, idiot. he said: idiot")) == 1     # marks end clauses


@pytest.mark.parametrize("text, same", [
    ("c'est l'idiot", "c'est l idiot"), ("tu n'es qu'un tas d'idiots et d'idiot", "tu n'es qu'un tas d idiots et d idiot"),
    ("you 'idiot'", "you idiot"), ("'you idiot'", "you idiot"), ("they said 'not idiot'", "they said not idiot"),
    ("l'idiot d'imbecile", "l idiot d imbecile"), ("you aren't 'stupid'", "you aren't stupid"), ("can't, 'kill'", "kill")])
def test_op6_elided_and_quoted_insults_count(text, same):
    from quarkframe.llm.toxicity import Grammar, seeds

    g = Grammar(seeds())
    assert g.features(text).any() and (g.features(text) == g.features(same)).all()


@pytest.mark.parametrize("where", ["edge", SMALL])
def test_op7_against_brute_force(result, docs, where):
    sets, ids = [], []
    for i, t in docs(where):
        w = lower(t).encode().split()
        sets.append(frozenset(tuple(w[k:k + 5]) for k in range(len(w) - 4)) if len(w) > 4
                    else frozenset([tuple(w)] if w else []))
        ids.append(i)
    parent = list(range(len(ids)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(range(len(ids)), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= 85 * len(x | y):
            parent[top(a)] = top(b)
    groups = defaultdict(list)
    for k in range(len(ids)):
        groups[top(k)].append(k)
    want = []
    for g in groups.values():
        least = min((ids[k] for k in g if ids[k] is not None), default=None)
        want += [(ids[k], len(sets[k]), least, ids[k] == least) for k in g]
    key = lambda t: tuple((x is None, x) for x in t)
    assert rows_of(result("op7_minhash", where), "doc_id", "n_shingles", "component_id", "kept") == sorted(want, key=key)


def test_op7_keep_one_row_of_each_group(spark, edge_dir, result):
    from quarkframe.llm.neardup import keep_one

    docs = spark.read.parquet(f"{edge_dir}/documents.parquet")
    got = keep_one(docs).collect()
    want = {r.component_id for r in result("op7_minhash", "edge") if r.n_shingles}
    full = [r.doc_id for r in got if WORD.search(r.text or "")]
    assert sorted(full, key=str) == sorted(want, key=str) and got[0].asDict().keys() == dict(docs.dtypes).keys()


def test_pipeline_near_dedup_stage_links_at_80_percent(spark):
    import corpus_pipeline

    def edited(k, n):                     # n distinct words, every 40th of the first k * 40 replaced
        w = [f"d{k}w{i}" for i in range(n)]
        return " ".join(w), " ".join(f"d{k}x{i}" if i % 40 == 20 and i < k * 40 else x for i, x in enumerate(w))

    rows, sets = [], {}
    for k in range(1, 9):                 # similarities from below to above 0.8 and 0.85
        for j, t in enumerate(edited(k, 260)):
            rows.append((10 * k + j, t))
            w = t.split()
            sets[10 * k + j] = {tuple(w[i:i + 5]) for i in range(len(w) - 4)}
    same = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    near = {k: same(10 * k, 10 * k + 1) for k in range(1, 9)}
    assert any(0.8 <= x < 0.85 for x in near.values()) and any(x < 0.8 for x in near.values())
    want = {10 * k + j for k in near for j in (0, 1) if j == 0 or near[k] < 0.8}
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup_stage(spark, docs, "").collect()) == sorted(want)


def test_pipeline_near_dedup_keeps_unrelated_texts_without_or_with_repeated_ids(spark):
    import corpus_pipeline

    say = lambda name, n=120: " ".join(f"{name}{i}" for i in range(n))
    near = say("a") + " more"
    rows = [(1, say("a")), (7, near), (7, say("b")), (7, say("c")), (None, say("d")), (None, say("e")), (None, say("e")),
            (None, say("f")), (None, near), (None, say("g")), (9, say("g")), (None, ""), (None, None), (None, ""),
            (3, " "), (3, " "), (4, say("h")), (4, say("h"))]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, text string, kept_id int")
    got = corpus_pipeline.near_dedup_stage(spark, docs, "")
    assert got.columns == docs.columns
    want = [(1, say("a")), (7, say("b")), (7, say("c")), (None, say("d")), (None, say("e")), (None, say("f")),
            (9, say("g")), (None, ""), (None, None), (None, ""), (3, " "), (3, " "), (4, say("h"))]
    key = lambda t: tuple((x is None, x) for x in t)
    assert rows_of(got.collect(), "doc_id", "text") == sorted(want, key=key)


@pytest.mark.parametrize("where", ["edge", SMALL])
def test_op8_edits_and_fingerprints(result, docs, where):
    rows = result("op8_merkle", where)
    texts = defaultdict(set)
    for i, t in docs(where):
        texts[i].add(t or "")
    if where == SMALL:
        ids = sorted(texts, reverse=True)
        by = {r.doc_id: r for r in rows}
        for i, j in zip(ids, ids[1:] + ids[:1]):
            (a,), (b,) = texts[i], texts[j]
            h = len(a) // 2
            edited = a[:len(a) - h] + b[:h]
            assert by[i].n_chars == len(a) and by[i].edited_sha256 == sha(edited.encode())
            assert (by[i].fingerprint == by[i].edited_fingerprint) == (a == edited)
            assert by[i].near_next == 1 or len(a) < 100 or 0.2 < by[i].near_edited < 0.9
            assert (by[i].edit_paragraph == 0) == (a == edited)
    single = {i: next(iter(t)) for i, t in texts.items() if len(t) == 1}
    prints = {(single[r.doc_id], r.fingerprint) for r in rows if r.doc_id in single}
    assert len(prints) == len({t for t, _ in prints}) == len({f for _, f in prints})
    assert all(0 <= x <= 1 for r in rows for x in (r.near_edited, r.near_next))


def test_op8_next_rows_over_many_ranges(spark, monkeypatch, tmp_path):
    from quarkframe.llm import merkle

    monkeypatch.setattr(merkle, "ROWS_PER_RANGE", 7)
    rows = [(k * k if k % 10 else None if k == 0 else -k, f"text {k}") for k in range(200)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    df.write.parquet(str(tmp_path / "d"))
    got = {r.text: r.next_text for r in merkle.with_next(spark.read.parquet(str(tmp_path / "d")), [], []).collect()}
    order = [t for _, t in sorted(rows, key=lambda x: (x[0] is not None, x[0]), reverse=True)]
    assert got == dict(zip(order, order[1:] + order[:1]))


def likenesses(spark, pairs):
    from quarkframe.llm import merkle

    d = merkle._add(spark.createDataFrame(pairs, "a string, b string"),
                    [*merkle.fingerprint_steps("a", "x"), *merkle.fingerprint_steps("b", "y")])
    return [r[0] for r in d.select(merkle.likeness("x", "y")).collect()]


def test_op8_likeness_follows_content_not_offsets(spark):
    import random

    r = random.Random(5)
    word = lambda: "".join(r.choices("etaoinshrdlucmfwyp", k=r.randint(2, 9)))
    say = lambda n: " ".join(word() for _ in range(400))[:n]
    cjk = "".join(chr(0x4E00 + r.randrange(3000)) for _ in range(1500))
    line, short, other = say(2000), say(66), say(2000)
    got = likenesses(spark, [(line, "x" + line), (line[:1000], line[:500] + "y" + line[500:1000]), (short, short[:60]),
                             (cjk, "\u4e2d" + cjk), (line, other), (line, line[:1000] + other[:1000]), ("", ""), ("", line)])
    assert min(got[0], got[1], got[3]) >= 0.9 and got[2] >= 0.8
    assert got[4] < 0.15 and 0.3 < got[5] < 0.7 and got[6:] == [1.0, 0.0]


def test_op8_descent_locates_an_edit_and_opens_few_sections(spark):
    from quarkframe.llm import merkle

    lines = [f"paragraph number {i}" for i in range(400)]
    edits = {"inserted": lines[:200] + ["new"] + lines[200:], "removed": lines[:77] + lines[80:], "equal": lines,
             "changed": lines[:10] + ["other"] + lines[11:], "appended": lines + ["end"], "first": ["start"] + lines,
             "all": [f"other {i}" for i in range(30)], "twice": lines[:5] + lines[4:5] + lines[5:]}
    d = spark.createDataFrame([(k, "\n".join(lines), "\n".join(v)) for k, v in edits.items()], "k string, a string, b string")
    d = merkle._add(d, [*merkle.fingerprint_steps("a", "x"), *merkle.fingerprint_steps("b", "y")])
    got = {r.k: r for r in merkle.locate(d, "x_tree", "y_tree", "e").collect()}
    where = {k: (r.e_paragraph, r.e_removed, r.e_added) for k, r in got.items()}
    assert where == {"inserted": (201, 0, 1), "removed": (78, 3, 0), "equal": (0, 0, 0), "changed": (11, 1, 1),
                     "appended": (401, 0, 1), "first": (1, 0, 1), "all": (1, 400, 30), "twice": (6, 0, 1)}
    whole = len(got["all"].x_tree)
    assert whole > 25 and all(r.e_opened <= 6 for k, r in got.items() if k != "all") and got["equal"].e_opened == 0


def test_op8_rows_without_ids_spread_over_ranges(spark, monkeypatch, tmp_path):
    """A third of the ids null, a third of the rows the same row: the order stays one cycle, ranges stay small."""
    from quarkframe.llm import merkle

    monkeypatch.setattr(merkle, "ROWS_PER_RANGE", 50)
    rows = [(None, f"null {k}") for k in range(1000)] + [(5, "same")] * 1000 + [(k, f"text {k}") for k in range(6, 1006)]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(str(tmp_path / "d"))
    d = spark.read.parquet(str(tmp_path / "d"))
    whole = merkle.with_next(d, [], [])
    got = whole.collect()
    assert Counter(r.text for r in got) == Counter(t for _, t in rows) == Counter(r.next_text for r in got)
    pairs = {(r.text, r.next_text) for r in got if r.text != r.next_text}
    step = dict(pairs)
    assert len(step) == len(pairs) == 2001                 # one cycle over the distinct texts
    at, seen = "text 1005", set()
    while at not in seen:
        seen.add(at)
        at = step[at]
    assert len(seen) == 2001 and all(step[f"text {k}"] == f"text {k - 1}" for k in range(7, 1006))
    sizes = [r["count"] for r in merkle.ranged(d).groupBy("range").count().collect()]
    assert sum(sizes) == len(rows) and max(sizes) <= 150 and len(sizes) >= 40


def test_op10_languages(spark, result):
    sf = "/root/testdata/sf0.01"
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    held = [r for r in result("op10_language_id", sf) if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.95 * len(held)
    edge = {r.doc_id: r for r in result("op10_language_id", "edge")}
    assert [edge[i].lang_pred for i in (0, 1, 2, 4, 18)] == ["und"] * 5 and edge[3].lang_pred != "und"
    assert all(0 <= r.score <= 1 for r in edge.values())


def test_pipeline_equals_its_stages(spark, edge_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{edge_dir}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.count()
        docs = spark.createDataFrame(stage(spark, docs, edge_dir).collect(), docs.schema)
        assert docs.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"]
        assert name == "mixing" or docs.count() <= before
    last = corpus_pipeline.STAGES[-1][1](spark, docs, edge_dir).collect()
    assert rows_of(last, "doc_id", "ids_sha256") == rows_of(corpus_pipeline.run(spark, edge_dir).collect(), "doc_id", "ids_sha256")


def brute_substring(texts, window):
    """Words left of every text, by the definition: (doc_id, kept words)."""
    order = lambda i: 1 << 70 if i is None else i
    least = {}
    for i, w in texts:
        for k in range(len(w) - window + 1):
            x = tuple(w[k:k + window])
            least[x] = min(least.get(x, 1 << 80), order(i))
    for i, w in texts:
        gone = set()
        for k in range(len(w) - window + 1):
            if least[tuple(w[k:k + window])] < order(i):
                gone.update(range(k, k + window))
        yield i, [x for k, x in enumerate(w) if k not in gone]


@pytest.mark.parametrize("window", [1, 7, 23, 24, 50, 100])
def test_op3_any_window_against_brute_force_with_a_third_of_the_ids_null(spark, window):
    import random

    from quarkframe.llm.substring import digest, lengths

    assert lengths(50) == [12, 25, 50] and lengths(100) == [12, 25, 50, 100] and lengths(7) == [7]
    r = random.Random(window)
    passages = [" ".join(r.choices("abcdefghij", k=n)) for n in (8, 13, 24, 30, 55, 120, 130)]
    rows = []
    for k in range(120):
        parts = [" ".join(f"w{r.randrange(10 ** 6)}" for _ in range(r.randrange(40))), r.choice(passages),
                 r.choice(["", *passages])]
        rows.append((None if k % 3 == 0 else r.randrange(60), " ".join(parts)))
    rows += [(None, "same text " * 60)] * 5 + [(None, None), (None, "")]
    got = digest(spark.createDataFrame(rows, "doc_id bigint, text string"), window).collect()
    want = [(i, len(kept), sha(" ".join(kept).encode())) for i, kept in brute_substring([(i, (t or "").split()) for i, t in rows], window)]
    key = lambda t: tuple((x is None, x) for x in t)
    assert sorted(((x.doc_id, x.n_words - x.n_removed, x.kept_sha256) for x in got), key=key) == sorted(want, key=key)
    assert any(x.n_removed for x in got) and any(not x.n_removed for x in got)


def test_op3_rows_without_ids_meet_their_own_cuts_only(spark, monkeypatch):
    """600 rows, half of them without an id: no join or group of them grows beyond the rows."""
    from quarkframe.llm import substring

    seen = {}
    real = substring.store

    def counted(df, name):
        out = real(df, name)
        seen[name] = out.count()
        return out

    monkeypatch.setattr(substring, "store", counted)
    rows = [(None if k % 2 else k, " ".join(f"p{i}" for i in range(60)) + f" own{k} " + " ".join(f"q{i + k}" for i in range(40)))
            for k in range(600)]
    got = substring.digest(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert got.count() == 600 and seen["substring-texts-25"] <= 600 and seen["substring-cuts"] <= 600
    assert all(r.n_removed >= 60 for r in got.collect() if r.doc_id != 0)


def test_op2_mix_holds_the_words_that_shares_counts(spark):
    from quarkframe.llm.mixing import mix, shares

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    words = Counter()
    for r in mix(docs).select("doc_id", "text").collect():
        words[r.doc_id] += len(WORD.findall(r.text or ""))
    taken = Counter()
    for r in shares(docs).collect():
        taken[r.doc_id] += r.taken
    assert +words == +taken and sum(words.values())
