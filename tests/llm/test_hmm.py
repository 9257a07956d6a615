import math
import random
import zlib
from collections import Counter
from itertools import product

import numpy as np

from tidemark.llm import hmm


def test_forward_equals_the_sum_over_paths():
    m = hmm.Hmm.random(5, states=3, seed=1)
    texts = [np.array(c, np.uint32) for c in ([4], [0, 1, 4], [3, 3, 2, 0, 4])]
    for c, got in zip(texts, m.log10(texts)):
        p = sum(m.start[s[0]] * math.prod(m.move[a, b] for a, b in zip(s, s[1:])) * math.prod(m.emit[k, x] for k, x in zip(s, c)) for s in product(range(3), repeat=len(c)))
        assert abs(math.log10(p) - got) < 1e-9


def test_expected_counts_equal_the_sum_over_paths():
    m = hmm.Hmm.random(4, states=2, seed=2)
    c = np.array([0, 2, 2, 3], np.uint32)
    want, all_p = np.zeros((2, 1 + 2 + 4)), 0.0
    for s in product(range(2), repeat=4):
        p = m.start[s[0]] * math.prod(m.move[a, b] for a, b in zip(s, s[1:])) * math.prod(m.emit[k, x] for k, x in zip(s, c))
        all_p += p
        want[s[0], 0] += p
        for a, b in zip(s, s[1:]):
            want[a, 1 + b] += p
        for k, x in zip(s, c):
            want[k, 3 + x] += p
    (got, likely), (alone, less) = m.expected([(True, c), (True, c[:2])]), m.expected([(True, c[:2])])
    assert np.allclose(got - alone, want / all_p) and abs(likely - less - math.log10(all_p)) < 1e-9


def test_a_cut_keeps_the_step_and_counts_no_token_twice():
    m = hmm.Hmm.random(6, states=3, seed=2)
    c = np.random.default_rng(1).integers(0, 6, 50).astype(np.uint32)
    got, _ = m.expected([(True, c[:20]), (False, c[19:])])
    assert abs(got[:, 1:4].sum() - 49) < 1e-9 and abs(got[:, 4:].sum() - 50) < 1e-9 and abs(got[:, 0].sum() - 1) < 1e-9
    assert np.allclose(got[:, 4:].sum(0), np.bincount(c, minlength=6))


def test_training_raises_the_likelihood():
    rnd = np.random.default_rng(3)
    rows = [(True, np.array([x % 3 for x in range(s, s + 40)] + [3], np.uint32)) for s in rnd.integers(0, 3, 50)]
    m = hmm.Hmm.random(4, states=3, seed=4)
    first = m.log10([r[1] for r in rows]).sum()
    for _ in range(20):
        m = m.updated(m.expected(rows)[0])
    assert m.log10([r[1] for r in rows]).sum() > first + 100


def test_scores_equal_brute_force_and_beat_the_base(spark):
    """The score is the forward sum over classes times the words' shares, on whole texts; two kinds of text are told apart."""
    rnd = random.Random(3)
    kinds = [[f"{k}{i}" for i in range(120)] for k in "ab"]
    rows = [(i, " ".join(rnd.choice(kinds[i % 2]) if rnd.random() < 0.95 else f"rare{rnd.randrange(10_000)}" for _ in range(rnd.randint(5, 400)))) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    train = df.where("pmod(crc32(cast(cast(doc_id as string) as binary)), 7) <> 2").select("text")
    counts, words, model = hmm.train(train)
    got = {r["doc_id"]: r for r in hmm.lm_scores(df).collect()}
    table = {bytes(r["word"]): r["n"] for r in counts.where("word is not null").collect()}
    sizes = Counter()
    for w, n in table.items():
        if w not in words.own:
            sizes[hmm._shape(w)] += n + 1
    for i, text in rows[:60]:
        now, total = model.start, 0.0
        for t, w in enumerate([*hmm.tokens(text.encode()), None]):
            if w is None:
                c, share = words.end, 1.0
            elif w in words.own:
                c, share = words.own[w], 1.0
            else:
                c, share = words.end + 1 + hmm._shape(w), (table.get(w, 0) + 1) / (sizes[hmm._shape(w)] + 1)
            now = (now @ model.move if t else now) * model.emit[:, c]
            total += math.log10(now.sum() * share)
            now = now / now.sum()
        assert abs(total - got[i]["score"]) < 1e-6 * abs(total)
    held = [r for r in got.values() if r["held_out"]]
    per = lambda c: sum(r[c] for r in held) / sum(r["n_tokens"] for r in held)
    assert len(held) > 20 and per("score") > per("base_score") + 0.1


def test_words_beyond_the_own_classes(spark, monkeypatch):
    rows = [(i, " ".join(f"w{(i * 7 + k * k) % 90}" for k in range(40))) for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    whole = {r["doc_id"]: r for r in hmm.lm_scores(df).collect()}
    monkeypatch.setattr(hmm.vocabulary, "__defaults__", (10,))
    few = {r["doc_id"]: r for r in hmm.lm_scores(df).collect()}
    assert all(abs(whole[i]["base_score"] - few[i]["base_score"]) < 1e-9 and whole[i]["n_known"] == few[i]["n_known"] and math.isfinite(few[i]["score"]) for i in whole)


def test_scores_on_odd_rows(spark):
    rows = [(i, None if i % 17 == 0 else "" if i % 13 == 0 else " ".join(["The", "cat", "sat", f"w{i % 23}", f"r{i}"][: 1 + i % 5]) + "\n", 1) for i in range(120)] + [(None, "The É", 2), (5, "cat", 3), (5, "cat", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n long")
    got = hmm.lm_scores(df).collect()
    assert len(got) == len(rows)
    words = lambda t: [w.decode() for w in (t or "").encode().lower().split()]
    train = [t for i, t, _ in rows if i is None or zlib.crc32(str(i).encode()) % 7 != 2]
    c = Counter(w for t in train for w in words(t))
    n, v = sum(c.values()) + len(train), len(c) + 1
    want = sorted((i is not None and zlib.crc32(str(i).encode()) % 7 == 2, -1 if i is None else i, len(words(t)) + 1, sum(c[w] > 0 for w in words(t)) + 1, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in words(t)) + math.log10((len(train) + 1) / (n + v + 1)), 6)) for i, t, _ in rows)
    assert sorted((r["held_out"], -1 if r["doc_id"] is None else r["doc_id"], r["n_tokens"], r["n_known"], round(r["base_score"], 6)) for r in got) == want
    assert {r["train_tokens"] for r in got} == {n} and all(math.isfinite(r["score"]) and r["score"] < 0 for r in got)
    assert hmm.lm_scores(df.where("false")).count() == 0
