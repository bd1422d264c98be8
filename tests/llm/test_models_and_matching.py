"""Scoring, decontamination, toxicity, edit-aware counts, passages and near-duplicates against brute force."""

import collections
import itertools
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lamina.llm import decontaminate, editcount, lm, neardup, passages, queries, toxicity
from lamina.llm.bpe import vocabulary_path
from lamina.llm.components import components
from lamina.llm.shingles import shingle_set
from tests.llm.conftest import DATA, SCHEMA


def split(text):
    return (text or "").encode().lower().split()


@pytest.mark.parametrize("order", [1, 2, 3])
def test_lm_scores_against_recursion(spark, odd_docs, order):
    """Nulls, repeats, and a text of 30,000 words, which goes through the automaton in segments."""
    docs = odd_docs.union(spark.createDataFrame([(20, "one line three one line", "x"), (21, "three one two lines", "x")], SCHEMA)).withColumns({"block": F.lit("x"), "shard": F.lit("y"), "score": F.lit(0)})
    got = lm.lm_scores(docs, F.col("doc_id") % 4 == 1, order=order, strength=2.0, block_tokens=7, shard_bytes=4000).collect()
    rows = [(r.doc_id, [*split(r.text), "</s>"]) for r in docs.collect()]
    count, total = collections.Counter(), 0
    for i, w in rows:
        if i is None or i % 4 != 1:
            padded = ["<s>", *w]
            total += len(w)
            count.update({("<s>",): 1})
            for k in range(1, order + 1):
                count.update(tuple(padded[t - k + 1 : t + 1]) for t in range(1, len(padded)) if t - k + 1 >= 0)
    vocabulary = sum(len(g) == 1 and g != ("<s>",) for g in count)

    def p(gram):
        if len(gram) == 1:
            return (count[gram] + 1) / (total + vocabulary + 1)
        return (count[gram] + 2 * p(gram[1:])) / (count[gram[:-1]] + 2)

    want = []
    for i, w in rows:
        padded = ["<s>", *w]
        score = sum(math.log10(p(tuple(padded[max(0, t - order + 1) : t + 1]) if order > 1 else (padded[t],))) for t in range(1, len(padded)))
        want.append((i or -1, len(w), sum(count[(x,)] > 0 for x in w), total, round(sum(math.log10(p((x,))) for x in w), 6), round(score, 6)))
    assert sorted((r.doc_id or -1, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in got) == sorted(want)
    assert lm.lm_scores(docs.limit(0), F.lit(False)).collect() == []


def test_registered_scoring_counts_trigrams(monkeypatch):
    asked = {}
    monkeypatch.setattr(queries, "table", lambda *a: None)
    monkeypatch.setattr(lm, "lm_scores", lambda docs, held_out, **settings: asked.update(settings))
    monkeypatch.setattr(queries.F, "crc32", lambda c: 0)
    monkeypatch.setattr(queries.F, "col", lambda c: type("C", (), {"cast": lambda self, t: self})())
    queries.op1_lm_scoring(None, "")
    assert asked["order"] >= 3


def test_automaton_carries_state_and_its_states_sum_to_one(monkeypatch):
    rng = np.random.default_rng(6)
    lengths = np.array([40, 1, 300, 7])
    words = rng.integers(0, 5, lengths.sum())
    words[np.cumsum(lengths) - 1] = 5  # ends
    hashes = np.arange(1, 8, dtype=np.uint64) << np.uint64(20)  # words 0..4, the end 5, the beginning 6
    grams = lm.Grams(words, lengths, hashes, 3)
    trained = np.repeat(np.array([True, True, True, False]), lengths)
    counts = [grams.counts(k, trained) for k in range(3)]
    counts[0][6] = 3
    total, vocabulary = int(trained.sum()), int((counts[0][:6] > 0).sum())
    a = lm.BackoffAutomaton(grams, counts, total, vocabulary, 1.5)
    # every state that training goes on from, with failure, is a distribution over the words and one unseen word
    last = np.concatenate([[0], np.arange(7), grams.word[1]])
    for state in range(len(a.fail_to)):
        seen = np.concatenate([counts[0], counts[1]])[state - 1] * (last[state] != 5) if state else 1
        p = 10 ** a.step(np.full(6, state), np.arange(6))[1]
        rest = 1 / (total + vocabulary + 1)
        while state:
            rest, state = rest * 10 ** a.fail_weight[state], a.fail_to[state]
        if seen and not (p <= 0).any():
            assert p.sum() + rest == pytest.approx(1)
    # one token after the other with the state carried, and the same in segments
    want = []
    for begin, n in zip(np.cumsum(lengths) - lengths, lengths, strict=True):
        state = np.array([a.begin])
        for w in words[begin : begin + n]:
            state, added = a.step(state, np.array([w]))
            want.append(added[0])
    for segment in (3, 50, 1000):
        monkeypatch.setattr(lm, "SEGMENT", segment)
        assert a.traverse(words, lengths) == pytest.approx(np.array(want))


def test_decontamination_tolerates_substitutions(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(6))
    items = [[word() for _ in range(20)] for _ in range(3)] + [["short", "item"]]
    prose = lambda n: [word() for _ in range(n)]
    changed = items[1][:]
    changed[4] = changed[11] = "other"
    far = [w if i % 3 else "other" for i, w in enumerate(items[2])]
    docs = [(1, " ".join(prose(30) + items[0] + prose(9))), (2, " ".join(prose(5) + changed).upper() + "!"), (3, " ".join(prose(50))), (4, " ".join(far)), (5, ", ".join(items[0][3:15])), (6, "short item"), (7, None), (8, ""), (1, "again " + " ".join(items[2])), (None, " ".join(items[0]))]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)] + [(None, " ".join(docs[2][1].split()))], "item_id long, text string")
    got = {r.doc_id: (r.n_items, r.first_item, r.best_words, r.overlap_words) for r in decontaminate.contaminated(df, bench).collect()}
    assert got == {1: (2, 0, 12, 20), 2: (1, 1, 12, 20), 5: (1, 0, 12, 12), None: (1, 0, 12, 20)}
    left = decontaminate.decontaminate(df.withColumn("seed", F.lit(1)), bench)
    assert sorted(r.doc_id for r in left.collect()) == [3, 4, 6, 7, 8] and left.columns == ["doc_id", "text", "seed"]
    assert decontaminate.contaminated(df, bench.limit(0)).collect() == [] and decontaminate.contaminated(df.limit(0), bench).collect() == []


def test_decontamination_finds_every_placement_of_two_substitutions(spark):
    """All 66 pairs of substituted positions of a window of twelve words, and longer items, against all windows in full."""
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(6))
    items = [[word() for _ in range(n)] for n in (12, 15, 16, 18)]
    docs = []
    for pair in itertools.combinations(range(12), 2):
        docs.append([word() if i in pair else w for i, w in enumerate(items[0])])
    for n in (3, 4, 5):
        docs += [[word() if i in gone else w for i, w in enumerate(item)] for item in items[1:] for gone in [rng.sample(range(len(item)), n) for _ in range(20)]]
    windows = lambda ws: [ws[i : i + 12] for i in range(len(ws) - 11)]
    best = [[max(sum(map(str.__eq__, a, b)) for a in windows(d) for b in windows(i)) for i in items] for d in docs]
    want = {k: (sum(x >= 10 for x in b), max(b)) for k, b in enumerate(best) if max(b) >= 10}
    df, bench = spark.createDataFrame([(k, " ".join(d)) for k, d in enumerate(docs)], "doc_id long, text string"), spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    assert {r.doc_id: (r.n_items, r.best_words) for r in decontaminate.contaminated(df, bench).collect()} == want
    with pytest.raises(ValueError):
        decontaminate.contaminated(df, bench, allowed=3)


def test_decontamination_finds_short_items_whole_and_long_texts(spark):
    words = lambda a, n: [f"w{a}x{i}" for i in range(n)]
    items = [(0, words(0, 8)), (1, words(1, 11)), (2, words(2, 7)), (3, words(3, 12))]
    one_off = words(1, 11)
    one_off[5] = "other"
    docs = [(1, words(9, 40) + words(0, 8)), (2, words(1, 11)), (3, one_off + words(8, 30)), (4, words(2, 7) + words(9, 3)), (5, words(7, 60_000) + words(3, 12) + words(6, 50)), (6, words(0, 7) + words(9, 10))]
    df, bench = spark.createDataFrame([(i, " ".join(w)) for i, w in docs], "doc_id long, text string"), spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")
    got = {r.doc_id: (r.first_item, r.best_words, r.overlap_words) for r in decontaminate.contaminated(df, bench).collect()}
    assert got == {1: (0, 8, 8), 2: (1, 11, 11), 5: (3, 12, 12)}


def test_toxicity_reaches_unseen_spellings(spark):
    rng = random.Random(2)
    clean = ["".join(rng.choice(["an", "er", "th", "ou", "in", "re", "st"]) for _ in range(rng.randint(1, 4))) for _ in range(300)]
    bad = [f"zqxv{rng.choice('aeiou')}{c}" for c in clean]

    def text(toxic):
        words = [rng.choice(clean) for _ in range(rng.randint(30, 300))]
        for _ in range(max(1, len(words) // 40) * toxic):
            words[rng.randrange(len(words))] = rng.choice(bad)
        return " ".join(words)

    docs = [(i, text(i % 4 == 0), int(i % 4 == 0)) for i in range(1200)] + [(1900, None, None), (1901, "", None), (1902, "  ", None)]
    df = spark.createDataFrame([d[:2] for d in docs], "doc_id long, text string")
    labels = spark.createDataFrame([(d[0], d[2]) for d in docs] + [(0, None), (None, 1), (3, 0)], "doc_id long, toxic int")
    model = toxicity.train(df, labels, F.col("doc_id") < 800)
    got = {r.doc_id: r.score for r in toxicity.score(df.withColumn("score", F.lit("x")), model).collect()}
    high, low = ([got[i] for i, _, y in docs if 800 <= i < 1200 and y == kind] for kind in (1, 0))
    assert np.mean([a > b for a in high for b in low]) > 0.98  # held-out accuracy of the order, with unseen spellings
    assert np.mean([b >= 0.7 for b in low]) < 0.02
    assert all(0 <= s <= 1 for s in got.values()) and got[1900] == got[1901] == got[1902]
    assert toxicity.train(df, labels.limit(0), F.lit(True)).score(["x"])[0] == 0.5


def test_edits_keep_counts_exact(spark):
    from tokenizers import Tokenizer

    path = vocabulary_path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    count = lambda t: len(plain.encode(t, add_special_tokens=False).ids)
    rng = random.Random(9)
    for r in spark.read.parquet(f"{DATA}/documents.parquet").limit(25).collect():
        text, tree = r.text, editcount.CountTree(r.text, path, 50)
        for _ in range(5):
            a = rng.randint(0, len(text))
            b, new = min(len(text), a + rng.choice([0, 1, 7, 90])), rng.choice(["", " ", "  ", "x y", "\n", "'s ", "<|endoftext|>", "<|endof"])
            text = text[:a] + new + text[b:]
            tree.edit(a, b, new)
            assert tree.text == text and tree.tokens == count(text)
            tree = editcount.CountTree.unpack(tree.pack(), path)
    docs = spark.createDataFrame([(1, "call 5551234 or a@b.org now " * 40), (2, None), (3, ""), (None, "12345")], "doc_id long, text string")
    got = {r.doc_id: r for r in editcount.edited_counts(docs, path, redact=(r"[0-9]{5,}|\S+@\S+", "[masked]")).collect()}
    assert got[1].n_tokens_after == count("call [masked] or [masked] now " * 40) and got[1].n_edits == 80
    assert (got[2].n_tokens, got[3].n_tokens, got[None].n_tokens_after) == (0, 0, count("[masked]"))
    one = F.expr("array(named_struct('start', 0, 'stop', 4, 'new', 'ring'))")
    few = {r.doc_id: r for r in editcount.edited_counts(docs, path, F.when(F.col("doc_id") == 1, one)).collect()}
    assert few[1].n_tokens_after == count("ring" + docs.first().text[4:]) and few[1].chars_reencoded < few[1].n_chars / 2
    # a second edit goes on from the kept trees, without the text
    kept = editcount.edited_counts(docs, path, F.when(F.col("doc_id") == 1, one), keep=True).withColumnRenamed("n_tokens", "text").cache()
    again = {r.doc_id: r for r in editcount.edited_counts(kept, path, F.when(F.col("doc_id") == 1, F.expr("array(named_struct('start', 5, 'stop', 12, 'new', ''))")), tree_col="tree").collect()}
    assert again[1].n_tokens == few[1].n_tokens_after and again[1].n_tokens_after == count("ring " + docs.first().text[12:]) and 0 < again[1].chars_reencoded < 800
    assert again[2].n_tokens_after == 0 and again[None].n_tokens == count("12345") and again[None].chars_reencoded == 0
    odd = docs.union(docs).withColumn("n_edits", F.lit("clash"))
    assert len(editcount.edited_counts(odd, path).collect()) == 8 and editcount.edited_counts(odd.limit(0), path).collect() == []
    long = editcount.edited_counts(spark.createDataFrame([(1, "word, " * 200_000)], "doc_id long, text string"), path, one).first()
    assert long.n_tokens == count("word, " * 200_000) and long.chars_reencoded < 1000


def test_passages(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    prose = lambda n: [word() for _ in range(n)]
    shared, short, common = prose(70), prose(30), prose(15)
    edited = [w if i != 33 else "zzz" for i, w in enumerate(shared)]
    docs = [(1, prose(100) + shared + prose(40)), (2, shared + prose(10)), (3, prose(9) + edited), (4, prose(60) + short), (5, short + prose(60)), (6, prose(200)), (7, ["same"] * 90), (8, ["same"] * 90), (9, prose(40)), (12, common + prose(50) + common), (13, common + prose(50))]
    texts = [(i, " ".join(w)) for i, w in docs] + [(10, None), (11, ""), (14, docs[5][1] and " ".join(docs[5][1])), (None, " ".join(shared))]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    got = {r.doc_id: [(p["start"], p["stop"]) for p in r.passages] for r in passages.repeated_passages(df).collect()}
    assert set(got) == {1, 2, 3, 6, 7, 8, 14}
    assert got[1] == [(100, 170)] and got[2] == [(0, 70)] and got[3] == [(9, 79)] and got[7] == [(0, 90)] and got[14] == [(0, 200)]
    assert passages.repeated_passages(df.limit(0)).collect() == []


def brute_components(texts, n):
    sets = [shingle_set(t, n) for _, t in texts]
    up = list(range(len(texts)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    least = collections.defaultdict(list)
    for i, (doc, _) in enumerate(texts):
        least[find(i)].append(doc)
    return [(doc, len(sets[i]), min(least[find(i)])) for i, (doc, _) in enumerate(texts)]


def test_passages_cover_lines_repeated_many_times(spark):
    """Lines shorter than a window, repeated: the whole stretch is a passage, not its first occurrences."""
    prose = lambda d, n: [f"d{d}p{i}" for i in range(n)]
    docs, want = [], {}
    for k, (size, times) in enumerate([(10, 60), (40, 20)]):
        line = [f"line{k}w{i}" for i in range(size)]
        for d, before in ((2 * k, 70), (2 * k + 1, 33)):
            docs.append((d, " ".join(prose(d, before) + line * times + prose(100 + d, 50))))
            want[d] = (before, before + size * times)
    found = {r.doc_id: [(p["start"], p["stop"]) for p in r.passages] for r in passages.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert found == {d: [r] for d, r in want.items()}


def test_near_duplicates_against_brute_force(spark):
    rng = random.Random(3)
    texts = []
    for length in (1, 2, 3, 5, 8, 20, 70, 90, 300):
        base = [rng.choice("abcdefghijklmnopqrstuvw") * rng.randint(1, 3) for _ in range(length)]
        for _ in range(14):
            made = base[:]
            for _ in range(rng.choice([0, 0, 1, 2, length // 25, length // 16, length // 11])):
                made[rng.randrange(length)] = rng.choice("xyz") * rng.randint(1, 4)
            texts.append(" ".join(made))
    rng.shuffle(texts)
    rows = [(i * 3, t) for i, t in enumerate(texts)] + [(5000, None), (5001, ""), (5002, " \n")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit(1))
    for n in (2, 5):
        got = neardup.near_duplicates(df, shingle=n).collect()
        assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(brute_components(rows, n))
        assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    odd = neardup.near_duplicates(spark.createDataFrame([(None, "a b c"), (1, "a b c"), (1, "a b c"), (2, "a b c")], "doc_id long, text string"), 2).collect()
    assert sorted((r.doc_id or 0, r.component_id, r.kept) for r in odd) == [(0, None, True), (1, 1, True), (1, 1, True), (2, 1, False)]
    assert neardup.near_duplicates(df.limit(0)).collect() == []


def test_near_duplicates_at_the_threshold_in_crowded_neighbourhoods(spark):
    """Sets of 80 to 400 shingles, many variants of each near a similarity of 0.8, and pairs of their own: what is linked, and
    the components, are those of all pairs."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    texts = []
    for n in (80, 130, 200, 400):
        base = [word() for _ in range(n)]
        for _ in range(25):
            made = base[:]
            for at in rng.sample(range(n), round(n * rng.choice([0.03, 0.05, 0.055, 0.06]))):
                made[at] = word()
            texts.append(" ".join(made))
        for _ in range(6):  # two variants each, near the threshold
            one = [word() for _ in range(n)]
            two = one[: n - n // 10 + rng.randrange(-1, 2)] + [word() for _ in range(n // 10)]
            texts += [" ".join(one), " ".join(two)]
    rng.shuffle(texts)
    texts += [" ".join(word() for _ in range(60_000))] * 2  # very long
    rows = list(enumerate(texts))
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").withColumn("cls", F.lit("x")), shingle=2).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(brute_components(rows, 2))


def test_components_of_chains(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in components(links).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys((100, 101, 102), 100)}
    assert components(links.limit(0)).collect() == []


def test_hash_of_ids_is_that_of_the_contract(spark):
    got = spark.range(50).select("id", (F.crc32(F.col("id").cast("string").cast("binary")) % 7).alias("r")).collect()
    assert all(r.r == zlib.crc32(str(r.id).encode()) % 7 for r in got)
