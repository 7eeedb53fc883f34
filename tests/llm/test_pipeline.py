import corpus_pipeline as C
from pyspark.sql import functions as F

from stipple.llm import bayes_join, decontaminate, pii, toxicity

SF = "/root/testdata/sf0.001"


def test_stages_one_by_one(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs = docs.unionByName(docs.limit(3)).withColumn("doc_id", F.when(F.col("doc_id") != 5, F.col("doc_id")))
    bench = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    before, held = docs, {}
    for name, stage in C.STAGES:
        out = stage(spark, before, SF)
        if name != C.STAGES[-1][0]:
            assert out.columns == docs.columns, name
        path = f"{tmp_path}/{len(held)}"
        out.write.parquet(path)
        held[name] = spark.read.parquet(path)
        before = held[name]
    names = [n for n, _ in C.STAGES]
    ids = {n: {r.doc_id for r in held[n].select("doc_id").collect()} for n in names}
    toxic = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    rejected = {r.doc_id for r in toxicity.score_documents(docs, toxic).where(F.col("score") >= toxicity.THRESHOLD).collect()}
    assert not ids[names[0]] & (rejected - {None}) and ids[names[0]] | rejected >= {r.doc_id for r in docs.collect()}
    near = bayes_join.near_duplicates(held[names[0]])
    assert held[names[1]].count() == near.where(F.col("doc_id").eqNullSafe(F.col("class_id"))).select("doc_id").distinct().count()
    kept = {r.text for r in held[names[2]].collect()}
    gone = {r.text for r in held[names[1]].collect()} - kept
    assert not any(b in t for t in kept for b in bench) and all(any(b.lower()[:40] in t.lower() for b in bench) for t in gone)
    assert held[names[3]].count() == held[names[2]].count() == held[names[4]].count()
    assert not held[names[3]].where(F.col("text").rlike(r"[a-z0-9.]+@[a-z0-9]+\.[a-z]+")).count()
    assert held[names[3]].where(F.col("n_chars") != F.length("text")).count() == held[names[2]].where(F.col("n_chars") != F.length("text")).count()


def test_run_equals_the_stages(spark):
    rows = C.run(spark, SF)
    assert rows.columns[:4] == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and 0 < rows.count() < 200


def test_stages_take_columns_of_any_name(spark):
    extra = ["whole", "strict", "spans", "new", "__t", "__strict", "__spans", "__new", "name", "same", "many", "own", "__n", "__text", "__k",
             "__key", "score", "near", "k", "class_id"]
    names = ["doc_id", "text", *extra]
    body = "one two three four five six seven mail a@b.cd"
    rows = [(1, body, *["keep"] * len(extra)), (2, body, *["keep"] * len(extra)), (3, None, *["keep"] * len(extra))]
    docs = spark.createDataFrame(rows, ", ".join(f"{n} {'bigint' if n == 'doc_id' else 'string'}" for n in names))
    clear = pii.redact(docs)
    assert clear.columns == names
    assert sorted(tuple(r) for r in clear.collect()) == [
        (i, body.replace("a@b.cd", "[EMAIL]"), *["keep"] * len(extra)) for i in (1, 2)] + [rows[2]]
    kept = bayes_join.one_of_each(docs)
    assert kept.columns == names and sorted(r[0] for r in kept.collect()) == [1, 3]
    bench = spark.createDataFrame([("item", "three four five six seven mail a@b.cd")], "item_id string, text string")
    assert decontaminate.clean(docs, bench).collect() == [rows[2]]
    assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench).collect()} == {(1, "item"), (2, "item")}
