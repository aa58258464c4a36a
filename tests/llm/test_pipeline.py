"""The pipeline's stages against what the operators' own tests have checked, and its guard."""

import hashlib
import subprocess
import sys
from collections import Counter
from pathlib import Path

import corpus_pipeline
import public_tokenizers
from epochal.llm import langid, secrets
from epochal.llm.common import materialize
from tests.llm.test_simhash import components, plain
from tokenizers import Tokenizer

SF = "/root/testdata/sf0.001"


def test_stages(spark, small):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    stages = dict(corpus_pipeline.STAGES)
    first = materialize(stages["language ID"](spark, small, SF), "t")
    rejected = {r.doc_id for r in langid.identified(small).collect() if r.lang_pred == "und" or r.score < langid.LEAST_SCORE}
    assert {r.doc_id for r in first.collect()} == {r.doc_id for r in small.collect()} - rejected

    second = materialize(stages["SimHash near-dedup"](spark, first, SF), "t")
    rows = sorted((r.doc_id, plain(r.text)) for r in first.collect())
    assert sorted(r.doc_id for r in second.collect()) == sorted(set(components(rows)))

    third = materialize(stages["secret scans"](spark, second, SF), "t")
    before = {r.doc_id: r for r in second.collect()}
    for r in third.collect():
        assert (r.text == before[r.doc_id].text) == ("[secret]" not in r.text)
        assert r.n_chars == len(r.text)
    live = {r.doc_id for r in secrets.secret_spans(second, "source", "doc_id").collect() if r.n_live}
    assert {r.doc_id for r in third.collect() if "[secret]" in r.text} == live

    fourth = materialize(stages["mixing"](spark, third, SF), "t")
    texts = {r.doc_id: r.text for r in third.collect()}
    assert all(texts[r.doc_id] == r.text for r in fourth.collect())
    assert max(Counter(r.doc_id for r in fourth.collect()).values()) <= 3
    for df in (first, second, third, fourth):
        assert df.columns == small.columns

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for r in stages["BPE"](spark, fourth, SF).collect():
        assert r.ids == library.encode(texts[r.doc_id], add_special_tokens=False).ids and r.n_tokens == len(r.ids)


def test_last_stage_decodes(spark, small, odd):
    for docs in (small.limit(50), odd.filter("doc_id in (3, 4, 6, 11)")):
        texts = {r.doc_id: r.text or "" for r in docs.collect()}
        got = dict(corpus_pipeline.STAGES)["BPE"](spark, docs, SF).collect()
        assert len(got) == len(texts)
        assert all(r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest() for r in got)


def test_run(spark):
    """The result is there, and of the intermediate tables only the last stage's input is left."""
    from epochal.sources.shared import shared_dir

    folder = Path(shared_dir(spark).split("file://")[-1])
    before = set(folder.iterdir())
    assert corpus_pipeline.run(spark, SF).count() > 100
    assert [p.name.split("-")[0] for p in set(folder.iterdir()) - before] == ["mixing"]


def test_mixed_shares(spark):
    """After language ID, deduplication and redaction, whole documents come near the targets of what is left."""
    import re

    sf, docs = "/root/testdata/sf0.01", spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    for name in ("language ID", "SimHash near-dedup", "secret scans"):
        docs = materialize(stages[name](spark, docs, sf), "t")
    sizes, out, largest = Counter(), Counter(), Counter()
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    for r in docs.collect():
        sizes[r.source] += words(r.text)
        largest[r.source] = max(largest[r.source], words(r.text))
    from tests.llm.test_mixing import levels

    for r in stages["mixing"](spark, docs, sf).collect():
        out[r.source] += words(r.text)
    for s, target in levels(sizes).items():
        assert abs(out[s] - target) <= max(0.02 * target, largest[s])


def test_stages_take_odd_tables(spark, odd, none):
    for docs in (odd, none):
        for name, stage in corpus_pipeline.STAGES:
            docs = materialize(stage(spark, docs, SF), "t")
            if name != "BPE":
                assert docs.columns == odd.columns


def test_nested_columns_stay(spark, odd):
    """MAP, ARRAY and STRUCT columns pass all stages, and rows that differ in them alone are near-duplicates."""
    from pyspark.sql import functions as F

    docs = odd.withColumn("m", F.create_map(F.lit("k"), F.col("size"))).withColumn("a", F.array("key", "live")).withColumn("st", F.struct("fp", F.create_map(F.lit("k"), F.col("doc")).alias("m")))
    docs = docs.unionByName(docs.withColumn("m", F.create_map(F.lit("k"), F.lit(8).cast("long"))))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        made = stage(spark, docs, SF)
        assert made.schema.simpleString() == docs.schema.simpleString()
        docs = materialize(made, "t")
    rows = docs.collect()
    assert rows and all(r.a == ["key", "live"] and r.st.m == {"k": 7} for r in rows)


def test_texts_go_to_workers_in_small_batches(spark):
    """Of every stage that maps texts: 4,000 texts of 2 kB in one partition are several batches, not one of 8 MB."""
    import pyarrow as pa
    from epochal.llm.common import BATCH
    from pyspark.sql import functions as F

    name = "spark.sql.execution.arrow.maxBytesPerBatch"

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"])

    docs = spark.range(0, 4000, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("the cat "), 250).alias("text"), F.lit("en").alias("lang"), F.lit("a").alias("source"), F.lit(2000).alias("n_chars"))
    for stage in ("language ID", "SimHash near-dedup", "secret scans", "BPE"):
        spark.conf.unset(name)
        dict(corpus_pipeline.STAGES)[stage](spark, docs.limit(20), SF)
        assert max(r.n for r in docs.mapInArrow(sizes, "n bigint").collect()) < 1.5 * BATCH


def test_a_worker_keeps_one_table(spark, small):
    """What language ID keeps in a worker goes when the tokenizer's automaton comes, and the other way round."""
    import pyarrow as pa
    from epochal.llm import bpe, common

    def seen(batches):
        list(batches)
        yield pa.RecordBatch.from_arrays([pa.array([[str(k[0]) for k in common._kept]], pa.list_(pa.string()))], ["kept"])

    def held():
        return {x for r in spark.range(0, 64, 1, 64).mapInArrow(seen, "kept array<string>").collect() for x in [tuple(r.kept)]}

    field = langid.trained_on(small)
    spec = public_tokenizers.path("byte_bpe_50k.json")
    for _ in range(2):
        langid.predicted(small, field).count()
        langid.labelled(small.select("text"), field, ["a", "b"]).collect()
        bpe.encode_and_decode(small, spec).collect()
        found = held()
        assert ("automaton",) in found and all(len(x) <= 1 for x in found)


def test_two_pipelines_at_once(spark):
    """Each thread has its own scratch folder, and neither deletes the other's."""
    from concurrent.futures import ThreadPoolExecutor

    one = lambda _: sorted((r.doc_id, r.n_tokens) for r in corpus_pipeline.run(spark, SF).collect())
    with ThreadPoolExecutor(2) as pool:
        first, second = pool.map(one, range(2))
    assert first == second and first


def test_entry_without_this_subpackage(tmp_path):
    root = Path(corpus_pipeline.__file__).parent
    for p in ("epochal", "__spark_entry__.py"):
        subprocess.run(["cp", "-r", str(root / p), str(tmp_path)], check=True)
    subprocess.run(["rm", "-r", str(tmp_path / "epochal/llm")], check=True)
    code = "import __spark_entry__ as e; assert e.queries() and e.oracle_sql() and 'pipeline' not in e.queries() and not any(q.startswith('op1_') for q in e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)
