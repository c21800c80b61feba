from collections import Counter

import corpus_pipeline
from driftline.llm import quality, secrets, simhash
from tests.llm.test_decontam import brute as brute_hits
from tests.llm.test_mixing import brute_copies
from tests.llm.test_simhash import joined


def test_against_brute_force(spark, sf):
    docs = [r.asDict() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    kept = [d for d in docs if quality.judge(d["text"])["kept"]]
    assert 0 < len(kept) < len(docs)
    sets = {d["doc_id"]: set(simhash.shingle_hashes(d["text"].encode(), 5).tolist()) for d in kept}
    root = joined(sets, lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))  # the contract: five words, similarity 0.8
    one = [d for d in kept if root[d["doc_id"]] == d["doc_id"]]
    assert len(one) < len(kept)
    hits = brute_hits([(d["doc_id"], d["text"]) for d in one], bench)
    clean = [d for d in one if not hits[d["doc_id"]][4]]
    model = secrets.default_model()
    for d in clean:
        d["text"] = secrets.redact(d["text"], secrets.scan_text(d["text"], d["source"], model, 0.5), 0.5)
    out = corpus_pipeline.run(spark, sf)
    assert out.columns[:5] == list(docs[0])
    rows = [r.asDict() for r in out.collect()]
    sized = [{"doc_id": d["doc_id"], "source": d["source"], "size": len(d["text"].encode().split())} for d in clean]
    copies = {i: n for i, n in brute_copies(sized).items() if n}
    clean = [d for d in clean if d["doc_id"] in copies]
    assert Counter((r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in rows) == Counter((d["doc_id"], d["text"], d["lang"], d["source"], d["n_chars"]) for d in clean)
    assert {r["doc_id"]: r["copies"] for r in rows} == copies and all(r["taken"] == r["copies"] * r["size"] for r in rows)


def test_stages_keep_columns_and_take_no_rows(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs.where("false"), sf)
        assert out.columns == docs.columns and out.count() == 0, name


def test_stages_take_odd_rows(spark, sf):
    """Nulls in every column, empty and repeated rows, a very long text and names that clash, through each stage."""
    long = " ".join(f"w{i % 977}x{i}" for i in range(60_000)) + "."
    rows = [(None, None, None, None, None, 1, 2), (1, "", "en", "s", 0, 1, 2), (1, "", "en", "s", 0, 1, 2), (None, long, None, "s", 1, 1, 2), (None, "Some other line of text.", "en", None, 1, 1, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, hits int, `a.b` int")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns, name
        assert {(r.hits, r["a.b"]) for r in out.collect()} == {(1, 2)}, name
    assert near_texts(corpus_pipeline.near_dedup(spark, docs, sf)) == sorted(["", "Some other line of text.", long]) and corpus_pipeline.mix(spark, docs, sf).where("size = 0").count() == 0


def near_texts(df):
    return sorted((r.text or "") for r in df.collect())
