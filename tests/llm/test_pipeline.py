import corpus_pipeline
from newsloom.llm import packing, secrets, suffixes, toxicity
from newsloom.llm.common import read
from test_resemblance import classes

DIR = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    docs = read(spark, DIR, "documents").cache()
    names = docs.columns
    labels = read(spark, DIR, "labels")
    clean = corpus_pipeline.toxic(spark, docs, DIR)
    toxic = {r["doc_id"] for r in toxicity.fit(docs, labels).score(docs).where("predicted = 1").collect()}
    assert clean.columns == names
    assert {r["doc_id"] for r in clean.collect()} == {r["doc_id"] for r in docs.collect()} - toxic

    kept = corpus_pipeline.near_duplicates(spark, docs, DIR)
    heads = set(classes([(r["doc_id"], r["text"]) for r in docs.collect()]))
    assert kept.columns == names and sorted(r["doc_id"] for r in kept.collect()) == sorted(heads)

    cut = corpus_pipeline.repeated_passages(spark, docs, DIR)
    texts = {r["doc_id"]: r["text"] for r in suffixes.dedup(docs).collect()}
    assert cut.columns == names and all((r["text"], r["n_chars"]) == (texts[r["doc_id"]], len(r["text"])) for r in cut.collect())

    found = {r["doc_id"]: r["findings"] for r in secrets.scan(docs)[0].collect()}
    after = {r["doc_id"]: r["text"] for r in corpus_pipeline.secret_spans(spark, docs, DIR).collect()}
    assert all(("[secret]" in after[r["doc_id"]]) == bool(found[r["doc_id"]]) for r in docs.collect())
    assert corpus_pipeline.secret_spans(spark, docs, DIR).columns == names

    assert corpus_pipeline.packed(spark, docs, DIR).count() == packing.pieces(docs).count()


def test_stages_take_odd_rows(spark):
    shape = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(None, None, None, None, None), (1, "", "en", None, 0), (2, "a b c " * 40, None, "s", 5), (2, "a b c " * 40, None, "s", 5), (3, "a b c " * 40, "en", "s", 5)]
    for docs in (spark.createDataFrame(rows, shape), spark.createDataFrame([], shape)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, DIR)
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        corpus_pipeline.STAGES[-1][1](spark, docs, DIR).collect()


def test_columns_that_clash_with_the_stages_own_come_through(spark):
    names = ["kept", "blob", "cuts", "findings", "keep0", "removed", "run", "doc", "set", "bits", "score", "passages"]
    shape = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in names)
    docs = spark.createDataFrame([(k, f"token=abcdefgh{k} some words {k}", "en", "s", 3, *names) for k in range(4)], shape)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, DIR)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", *names]
        assert all(list(r)[5:] == names for r in docs.collect())
    assert docs.count() == 4


def test_run(spark):
    packed = corpus_pipeline.run(spark, DIR).toPandas()
    assert len(packed) and packed.groupby("sequence_id").length.sum().max() <= 1024


def test_near_duplicates_by_fingerprints_and_by_shingles(spark):
    line = "alpha beta gamma " * 100
    texts = [line + " ".join(f"{k}word{i}" for i in range(30)) for k in "ab"]  # one fingerprint, few shingles in common
    long = [f"term{i}" for i in range(200)]
    texts += [" ".join(long), " ".join([*long[:100], "other", *long[101:]]), "nothing like the rest"]
    shape = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in enumerate(texts)], shape)
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, DIR).collect()) == [0, 2, 4]


def test_near_duplicates_reach_through_rows_without_id(spark):
    words = [" ".join(f"{k}word{i}" for i in range(30)) for k in "ab"]
    spread = ["alpha beta gamma " * 100 + w for w in words]  # one fingerprint, few shingles in common
    near = "alpha beta gamma " * 3 + words[1]  # the shingles of the second, another fingerprint
    texts = [(1, spread[0]), (None, spread[1]), (2, near), (3, "nothing like the rest"), (4, "quite apart"), (4, "nothing like the rest")]
    shape = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in texts], shape)
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, DIR).collect()) == [1, 3]
