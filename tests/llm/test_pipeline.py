"""The corpus pipeline against plain loops, stage by stage."""

import corpus_pipeline
from test_text_operators import bench_words, check_packing, count_rules, slow_components, slow_spans

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _good(text):
    n, chars, symbols, dup, repeat = count_rules(text)
    lines = len([x for x in text.split("\n") if x.encode().split()])
    upper, letters = sum("A" <= c <= "Z" for c in text), sum("A" <= c <= "Z" or "a" <= c <= "z" for c in text)
    return not (n < 50 or 100 * repeat > 50 * n or 4 * symbols > n or 2 * chars < 4 * n or chars > 15 * n
                or 10 * dup > 3 * lines or 2 * upper > letters)


def test_stages_and_run(spark, sf_dir, docs, small):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "near_duplicates", "benchmark", "personal_data", "packing"]
    stage = dict(corpus_pipeline.STAGES)
    extra = docs.selectExpr("*", "'x' as kept", "1 as component_id")

    one = stage["quality"](spark, docs, sf_dir)
    good = {i for i, t in small.items() if _good(t)}
    assert one.columns == COLUMNS and {r["doc_id"] for r in one.collect()} == good
    assert {r["doc_id"] for r in stage["quality"](spark, extra, sf_dir).collect()} == good

    two = stage["near_duplicates"](spark, one, sf_dir)
    kept = {i for i, (_, c) in slow_components({i: small[i] for i in good}, 5).items() if i == c}
    assert two.columns == COLUMNS and {r["doc_id"] for r in two.collect()} == kept

    three = stage["benchmark"](spark, two, sf_dir)
    items = [bench_words(r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    grams = {tuple(b[j:j + 10]) for b in items for j in range(len(b) - 9)}
    clean = {i for i in kept if grams.isdisjoint(
        tuple(w[j:j + 10]) for w in [bench_words(small[i])] for j in range(len(w) - 9))}
    assert three.columns == COLUMNS and {r["doc_id"] for r in three.collect()} == clean

    four = stage["personal_data"](spark, three, sf_dir)
    rows = {r["doc_id"]: r for r in four.collect()}
    assert four.columns == COLUMNS and set(rows) == clean
    for i, r in rows.items():
        assert not slow_spans(r["text"]) and r["n_chars"] == len(r["text"])
        assert slow_spans(small[i]) or "[" in r["text"] or r["text"] == small[i]

    five = stage["packing"](spark, four, sf_dir)
    assert check_packing(five.collect(), {i: r["text"] for i, r in rows.items()}) < 0.05
    whole = corpus_pipeline.run(spark, sf_dir)
    key = lambda r: (r["doc_id"], r["start"])
    ids = lambda f: sorted((r["doc_id"], r["doc_tokens"]) for r in f.select("doc_id", "doc_tokens").distinct().collect())
    assert whole.columns == five.columns and ids(whole) == ids(five)
    assert len({key(r) for r in whole.collect()}) == whole.count()


def test_empty_documents(spark, sf_dir, empty):
    frame = empty
    for _, stage in corpus_pipeline.STAGES:
        frame = stage(spark, frame, sf_dir)
        assert frame.collect() == []


def test_odd_documents(spark, sf_dir, odd):
    frame = odd
    for name, stage in corpus_pipeline.STAGES[:-1]:
        frame = stage(spark, frame, sf_dir)
        assert frame.columns == odd.columns, name
    ids = [r["doc_id"] for r in frame.collect()]
    assert sorted(i for i in ids if i is not None) == [5, 5, 9] and None in ids
