"""The pipeline's stages on the smallest tables, each against a plain version of its decision."""


import corpus_pipeline
import test_exact
import test_lines
import test_near
import xxhash

from cloakwork.llm import common, language_id


def test_stages(spark, sf):
    docs = common.table(spark, sf, "documents")
    columns = docs.columns
    rows = {r.doc_id: r.text for r in docs.collect()}

    kept = common.materialise(corpus_pipeline.language(spark, docs, sf), "t")
    assert kept.columns == columns
    predicted = {r.doc_id: r for r in language_id.language_id(docs).collect()}
    assert {r.doc_id for r in kept.collect()} == {d for d in rows if predicted[d].lang_pred != "und" and predicted[d].score >= 0.5}

    before = [(r.doc_id, r.text) for r in kept.collect()]
    kept = common.materialise(corpus_pipeline.lines(spark, kept, sf), "t")
    assert kept.columns == columns
    got = kept.collect()
    assert sorted((r.doc_id, r.text) for r in got) == sorted((d, t) for d, t, _, _ in test_lines.brute(before))
    assert all(r.n_chars == len(r.text) for r in got)

    texts = [(r.doc_id, r.text) for r in got]
    kept = common.materialise(corpus_pipeline.near_duplicates(spark, kept, sf), "t")
    assert kept.columns == columns
    fps = []
    for _, text in texts:
        words = text.encode().lower().split()
        hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 5]), 42) for i in range(max(1, len(words) - 4))] if words else []
        fps.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)))
    roots = test_near.components(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4])
    first = {}
    for (d, _), r in zip(texts, roots):
        first[r] = min(d, first.get(r, d))
    assert {r.doc_id for r in kept.collect()} == set(first.values())

    texts = [(r.doc_id, r.text) for r in kept.collect()]
    kept = common.materialise(corpus_pipeline.benchmark_passages(spark, kept, sf), "t")
    assert kept.columns == columns
    items = [(r.item_id, r.text) for r in common.table(spark, sf, "benchmark").collect()]
    assert {r.doc_id for r in kept.collect()} == {b[0] for b in test_exact.brute(texts, items, 10) if not b[5]}

    packed = corpus_pipeline.sequences(spark, kept, sf).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in kept.collect()}
    whole = corpus_pipeline.run(spark, sf).collect()
    digest = lambda rs: sorted((r.doc_id, r.piece, r.length, r.ids_crc32) for r in rs)
    assert digest(whole) == digest(packed)
    assert [name for name, _ in corpus_pipeline.STAGES] and corpus_pipeline.ORACLE_SQL is None


def test_odd_rows(spark, sf, tmp_path):
    """Nulls, empty and repeated rows, clashing columns; then no documents, and no benchmark."""
    docs = common.table(spark, sf, "documents")
    some = docs.where("length(text) > 200").orderBy("doc_id").limit(12).collect()
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars, 1, "k", 5, "h") for r in some]
    rows += [(None, some[0].text + " and more words of its own", None, None, None, None, None, None, None), (some[1].doc_id, some[1].text, None, None, None, 2, "k", 5, "h")] * 3
    rows += [(900, None, None, None, 0, 1, "k", 5, "h"), (901, "", "en", "s", 0, 1, "k", 5, "h"), (902, " \n\t", "en", "s", 3, 1, "k", 5, "h")]
    kind = "doc_id long, text string, lang string, source string, n_chars long, key int, hits string, row int, _verdict string"
    at = str(tmp_path)
    spark.createDataFrame(rows, kind).write.parquet(f"{at}/documents.parquet")
    common.table(spark, sf, "benchmark").limit(0).write.parquet(f"{at}/benchmark.parquet")
    packed = corpus_pipeline.run(spark, at).collect()
    ids = {r.doc_id for r in packed}
    assert len(ids) > 5 and not ids & {900, 901, 902}
    assert len([r for r in packed if r.doc_id == some[1].doc_id and r.piece == 0]) <= 1
    none = f"{at}/none"
    spark.createDataFrame([], kind).write.parquet(f"{none}/documents.parquet")
    common.table(spark, sf, "benchmark").write.parquet(f"{none}/benchmark.parquet")
    assert corpus_pipeline.run(spark, none).count() == 0
