import collections
import re
import zlib

import corpus_pipeline as pipeline
from lamina.llm import queries, toxicity
from tests.llm.test_models_and_matching import brute_components

DATA = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_run(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = {}
    assert [n for n, _ in pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "decontamination", "packing"]
    for name, stage in pipeline.STAGES:
        before = docs.count()
        docs = stage(spark, docs, DATA)
        docs = docs.cache()
        rows[name] = docs.count()
        if name != "packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"] and rows[name] <= before
    assert rows["line_dedup"] == rows["toxicity"] and rows["near_dedup"] < rows["line_dedup"] and rows["decontamination"] < rows["near_dedup"]
    kept = {r.doc_id for r in docs.select("doc_id").distinct().collect()}
    assert len(kept) == rows["decontamination"]
    assert pipeline.run(spark, DATA).count() == rows["packing"]


def test_stages_take_nulls_repeats_and_empty_tables(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (2, None, "en", "s", None), (3, "a b", "de", None, 3)], docs.schema)
    for some in (odd, docs.limit(0)):
        for _, stage in pipeline.STAGES:
            some = stage(spark, some, DATA)
            some.count()


def test_queries_are_registered():
    assert {q.split("_")[0] for q in queries.QUERIES} == {f"op{i}" for i in range(1, 11)} and set(queries.SQL) <= set(queries.QUERIES)


def test_near_dedup_tells_rows_apart_by_id_and_text(spark):
    """Rows with one id and unrelated texts all stay, whatever becomes of one of them."""
    text = lambda k, n=40: " ".join(f"w{k}x{i}" for i in range(n))
    rows = [(1, text(1)), (7, text(1)), (7, text(2)), (7, text(3)), (7, text(3)), (8, text(2)), (9, text(4)), (9, text(5)), (None, text(4)), (5, ""), (5, None), (6, text(6) + " end"), (6, text(6))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = pipeline.drop_near_duplicates(spark, docs, DATA)
    want = [(1, text(1)), (7, text(2)), (7, text(3)), (9, text(4)), (9, text(5)), (None, text(4)), (5, ""), (5, None), (6, text(6))]
    assert got.columns == docs.columns and sorted(map(str, ((r.doc_id, r.text) for r in got.collect()))) == sorted(map(str, want))


def held(rows):
    return collections.Counter((r.doc_id, r.text) for r in rows)


def test_every_stage_against_brute_force(spark):
    """Each stage on all that the one before kept, with odd rows added, against a plain version of it."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    odd = [(None, None, None, None, None), (None, "no id", "en", "s", 5), (900_001, "", "en", "s", 0), (900_001, "", "en", "s", 0), (900_002, None, "en", "s", None), (900_003, "One line\nTwo", None, "s", 12), (900_003, "another text of that id", "en", "s", 23)]
    docs = docs.unionByName(spark.createDataFrame(odd, docs.schema)).cache()
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}

    def next_stage(name):
        out = dict(pipeline.STAGES)[name](spark, docs, DATA).cache()
        return out, out.collect()

    rows = docs.collect()
    # toxicity: the texts' scores one by one
    bags = [(toxicity.bag(r.text), labels[r.doc_id], r.doc_id) for r in rows if r.doc_id in labels and labels[r.doc_id] is not None and zlib.crc32(str(r.doc_id).encode()) % 3 != 1]
    assert bags
    after, got = next_stage("toxicity")
    learn = pipeline.F.crc32(pipeline.F.col("doc_id").cast("string").cast("binary")) % 3 != 1
    model = toxicity.train(docs, spark.read.parquet(f"{DATA}/labels.parquet").select("doc_id", "toxic"), learn)
    assert held(got) == held(r for r in rows if model.score([r.text])[0] < 0.7)
    docs, rows = after, got
    # lines of ten documents or more
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    seen = collections.defaultdict(set)
    for r in rows:
        for line in (r.text or "").split("\n"):
            seen[key(line)].add(r.doc_id)
    gone = {k for k, v in seen.items() if k and len(v) >= 10}
    after, got = next_stage("line_dedup")
    cut = lambda t: None if t is None else "\n".join(x for x in t.split("\n") if key(x) not in gone)
    assert gone and held(got) == collections.Counter((r.doc_id, cut(r.text)) for r in rows)
    assert all(r.n_chars == (len(r.text) if r.text is not None else r.n_chars) for r in got)
    docs, rows = after, got
    # near duplicates: all pairs; one row of each group stays
    texts = sorted({(r.doc_id, r.text) for r in rows if r.doc_id is not None and (r.text or "").split()})
    named = [(i, t) for i, (_, t) in enumerate(texts)]
    groups = collections.defaultdict(list)
    for i, n, top in brute_components(named, 5):
        groups[top].append(texts[i])
    stay = {min(g) for g in groups.values()}
    after, got = next_stage("near_dedup")
    want = collections.Counter({x: 1 for x in stay}) + collections.Counter((r.doc_id, r.text) for r in rows if r.doc_id is None or not (r.text or "").split())
    assert len(stay) < len(texts) and held(got) == want
    docs, rows = after, got
    # windows of twelve words, at most two of them substituted
    words = lambda t: [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]
    windows = lambda w: [w[i : i + 12] for i in range(len(w) - 11)]
    items = [x for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect() for x in windows(words(r.text))]
    by_word = collections.defaultdict(set)
    for k, x in enumerate(items):
        for i, w in enumerate(x):
            by_word[i, w].add(k)

    def leaks(text):
        for x in windows(words(text)):
            near = collections.Counter(k for i, w in enumerate(x) for k in by_word.get((i, w), ()))
            if near and max(near.values()) >= 10:
                return True
        return False

    after, got = next_stage("decontamination")
    want = held(r for r in rows if not leaks(r.text))
    assert len(got) < len(rows) and held(got) == want
    docs, rows = after, got
    # packing: every document whole, in pieces of its own ids
    packed = next_stage("packing")[1]
    pieces = collections.Counter(r.doc_id for r in packed if r.piece == 0)
    assert pieces == collections.Counter(r.doc_id for r in rows)
    fill = collections.Counter()
    for r in packed:
        fill[r.sequence_id] += r.length
    assert max(fill.values()) <= 1024 and sum(fill.values()) > 0.9 * 1024 * (len(fill) - 1)
