from __future__ import annotations

import corpus_pipeline
from weftwork.llm import common, neardup, queries

SF = "/root/testdata/sf0.001"


def test_every_stage_on_its_own_input(spark):
    docs = common.table(spark, SF, "documents")
    seen = {"start": docs.count()}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = common.materialize(stage(spark, docs, SF), name)
        if name != "packing":
            assert docs.schema.simpleString() == before.schema.simpleString()
        seen[name] = docs.count()
        if name in ("quality", "near_dedup"):
            assert docs.join(before, before.columns, "left_anti").count() == 0 and seen[name] < before.count()
        if name == "near_dedup":
            again = neardup.group(docs, percent=80)
            assert again.where("NOT kept_row").count() == 0
            assert seen[name] == neardup.group(before, percent=80).select("component_id").distinct().count()
        if name == "secrets":
            assert seen[name] == before.count() and docs.where("text LIKE '%AKIA%' AND length(text) - length(replace(text, 'AKIA', '')) > 0").where("text RLIKE 'AKIA[A-Z0-9]{14,}'").count() == 0
        if name == "mixing":
            assert docs.groupBy("doc_id").count().where("count > 2").count() == 0
    assert seen["packing"] > 0


def test_empty_and_extra_columns(spark, empty, clashing, tmp_path):
    empty.write.parquet(f"{tmp_path}/none/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
    clashing.drop("_rest").withColumn("_", clashing["rank"]).write.parquet(f"{tmp_path}/more/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/more").count() > 0


def test_tables_of_two_threads_are_told_apart(spark):
    """What one thread writes isn't in the list of another, so nobody deletes what the other reads."""
    from threading import Barrier, Thread

    seen, both = {}, Barrier(2)

    def work(name):
        with common.tracking() as paths:
            both.wait()
            common.materialize(spark.range(3), name)
            both.wait()
            seen[name] = [p.rsplit("/", 1)[1].split("-")[0] for p in paths]

    threads = [Thread(target=work, args=(name,)) for name in ("a", "b")]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert seen == {"a": ["a"], "b": ["b"]}


def test_registered_queries_have_their_columns(spark):
    want = {
        "op1_toxicity": "doc_id held_out score predicted",
        "op2_warc": "page_id payload_bytes payload_digest record_type refers_to",
        "op3_packing": "doc_id start length ids_crc32 doc_tokens sequence_id offset",
        "op4_sharding": "doc_id size text_crc32 law shard slot grown_shard",
        "op5_media": "doc_id n_bytes payload_bytes payload_sha256 tail_crc32 media_bytes media_sha256 feature",
        "op6_quality_rules": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
        "op7_secrets": "doc_id n_assign n_access n_hex base_sha256 spans",
        "op8_mixing": "doc_id size source_size target taken",
        "op9_near_dedup": "doc_id n_shingles component_id kept",
        "op10_token_counts": "doc_id n_bytes n_tokens over_limit",
        "op11_centroids": "vec_id cluster distance cluster_inertia inertia centroid_sha256",
        "op12_exact_dedup": "doc_id keep_id group_size kept text_sha256",
        "op13_collocations": "lang rank phrase a l r n score",
    }
    assert set(queries.queries()) == set(want)
    for name, columns in want.items():
        df = queries.queries()[name](spark, SF)
        assert set(columns.split()) <= set(df.columns)
